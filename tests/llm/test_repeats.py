"""Repeated passages against brute force: ties, nulls, copies, periodic and long texts, block and bucket borders."""

import random

import numpy as np
import pytest

from demandloom.llm import repeats
from demandloom.llm.repeats import multikey_order, remove_repeats


def expected(rows, length):
    """Spans and kept bytes of each distinct document, by a set of all strings seen so far."""
    docs = sorted({(k, t) for k, t in rows}, key=lambda d: (d[0] is None, d[0] or 0))
    seen, out = set(), {}
    for k, t in docs:
        data = (t or "").encode()
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - length + 1):
            s = data[i : i + length]
            if s in seen:
                gone[i : i + length] = True
            seen.add(s)
        edge = np.flatnonzero(np.diff(np.concatenate(([0], gone, [0]))))
        out[(k, t)] = (len(data), list(zip(edge[::2].tolist(), edge[1::2].tolist())), bytes(np.frombuffer(data, np.uint8)[~gone]))
    return sorted(((k, *out[(k, t)]) for k, t in rows), key=repr)


def result(spark, rows, length, partitions):
    table = spark.createDataFrame([(k, t, 1, "x", 2) for k, t in rows], "SKU long, Product_Name string, start int, key string, h int").repartition(partitions)
    got = remove_repeats(table, length=length)
    assert got.columns == ["SKU", "n_bytes", "spans", "kept"]
    return sorted(((r[0], r[1], [tuple(s) for s in r[2]], bytes(r[3])) for r in got.collect()), key=repr)


def corpus(length):
    rng = random.Random(11)
    text = lambda n: "".join(rng.choice("abc déx\x00 ") for _ in range(n))
    passage, line = text(3 * length), text(length + 3)
    rows = [(k, text(rng.randrange(5 * length))) for k in range(40)]
    rows += [(100 + k, text(rng.randrange(length)) + passage + text(rng.randrange(length))) for k in range(25)]
    rows += [(200 + k, text(7) + line + text(9) + line[: length - 1] + line) for k in range(25)]
    rows += [(300 + k, rows[3][1]) for k in range(12)] + [(400 + k, passage[k : k + length + k]) for k in range(30)]
    rows += [(500, None), (501, ""), (502, "a" * (6 * length)), (503, "ab" * (4 * length)), (504, "a" * length), (505, passage[: length - 1])]
    rows += [(506, text(60 * length) + passage + text(40) + passage), (3, rows[3][1]), (3, rows[3][1]), (507, (line + "\n") * 20)]
    return rows


@pytest.mark.parametrize("block, partitions", [(4 << 20, 1), (4 << 20, 6), (700, 3)])
def test_equals_brute_force(spark, monkeypatch, block, partitions):
    monkeypatch.setattr(repeats, "BLOCK_BYTES", block)
    rows = corpus(100)
    assert result(spark, rows, 100, partitions) == expected(rows, 100)


def test_pieces_of_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(repeats, "BUCKET_BYTES", 4096)
    rows = corpus(20)
    assert result(spark, rows, 20, 3) == expected(rows, 20)


def test_null_keys_come_last(spark):
    text = "".join(random.Random(2).choices("abcdefgh", k=150))
    rows = [(None, text), (7, text), (-2, None), (None, None)]
    assert result(spark, rows, 50, 2) == expected(rows, 50)


def test_texts_under_one_key_lose_one_copy(spark):
    text = "".join(random.Random(4).choices("abcdefgh", k=150))
    got = result(spark, [(1, text + "x"), (1, text + "y")], 100, 2)
    assert sorted(len(r[3]) for r in got) == [1, 151]
    assert sorted(r[2] for r in got) == [[], [(0, 150)]]


def test_empty_and_short_tables(spark):
    assert result(spark, [], 100, 2) == []
    assert result(spark, [(1, "short"), (2, None)], 100, 2) == [(1, 5, [], b"short"), (2, 0, [], b"")]


def test_multikey_order_sorts_rows():
    words = np.random.default_rng(1).integers(0, 4, (5000, 3)).astype(np.uint64)
    assert (words[multikey_order(words)] == words[np.lexsort(words.T[::-1])]).all()
