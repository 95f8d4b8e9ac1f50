"""Target resampling against brute force."""

import hashlib
import math
import random
import sys
import zlib
from collections import Counter
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from demandloom.llm import resample  # noqa: E402
from demandloom.llm.resample import resample_items  # noqa: E402


def expected(texts, target, longest, buckets, percent, least):
    def grams(text):
        w = brute.BENCH_WORD.findall((text or "").translate(brute.FOLD))
        return w, [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    s, t = Counter(), Counter()
    for _, x in texts:
        s.update(grams(x)[1])
    for x in target:
        t.update(grams(x)[1])
    n, m = s.total() + buckets, t.total() + buckets
    rows = []
    for key, x in texts:
        w, f = grams(x)
        gains = [math.floor(1000 * math.log((t[b] + 1) * n / ((s[b] + 1) * m))) for b in f]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"7:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        rows.append((key, len(w), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2], r[3]))
    place = {}
    for i, r in enumerate(able[: len(able) * percent // 100]):
        place.setdefault(r, []).append(i + 1)
    return sorted(((r[0], r[2], r[3], r[4], place[r].pop(0) if place.get(r) else None) for r in rows), key=repr)


def texts_and_target():
    rng = random.Random(3)
    word = lambda: rng.choice(["Alpha", "beta", "GAMMA", "déjà", "Ünï", "Èvi", "x1", "0", "end", "中文"]) + rng.choice(["", "", str(rng.randrange(9))])
    text = lambda n: "".join(word() + rng.choice([" ", ", ", "\n", "--", "\x00", "\x7f"]) for _ in range(n))
    texts = [(k, text(rng.randrange(1, 40))) for k in range(120)]
    texts += [(200, None), (201, ""), (202, " ,.\n"), (203, "word"), (204, text(30_000)), (None, text(25)), (None, None)]
    texts += [texts[3]] * 2 + [(5, text(30)), (205, "same " * 25)] + [(300 + k, "same " * 25) for k in range(9)]
    return texts, [text(12), None, "", text(50)]


@pytest.mark.parametrize("longest, slice_bytes", [(1, 4 << 20), (2, 4 << 20), (3, 4 << 20), (2, 300)])
def test_equals_brute_force(spark, monkeypatch, longest, slice_bytes):
    monkeypatch.setattr(resample, "SLICE_BYTES", slice_bytes)
    texts, target = texts_and_target()
    rows = [(k, t, 9, "x", 1.5) for k, t in texts]
    items = spark.createDataFrame(rows, "SKU long, Product_Name string, weight int, rank string, score double").repartition(5)
    goal = spark.createDataFrame([(t,) for t in target], "Product_Name string")
    got = resample_items(items, goal, longest=longest, buckets=50, percent=40, least_words=10)
    assert got.columns == ["SKU", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=repr) == expected(texts, target, longest, 50, 40, 10)


def test_empty_tables(spark):
    texts, target = texts_and_target()
    none = spark.createDataFrame([], "SKU long, Product_Name string")
    goal = spark.createDataFrame([(t,) for t in target], "Product_Name string")
    assert resample_items(none, goal).count() == 0
    items = spark.createDataFrame(texts, "SKU long, Product_Name string")
    got = resample_items(items, goal.limit(0), buckets=50, least_words=10, percent=40)
    assert sorted(map(tuple, got.collect()), key=repr) == expected(texts, [], 2, 50, 40, 10)
