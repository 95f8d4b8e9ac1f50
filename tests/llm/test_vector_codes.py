"""Vector codes against brute force in whole numbers of any size."""

import math
import random

import numpy as np
import pytest

from demandloom.llm.vector_codes import encode_vectors, nearest_entries, sequency_order, walsh


def expected(rows, parts, entries, rounds):
    kept = [(k, lab, [math.floor(256 * max(min(x, 2**54), -(2**54))) for x in v]) for k, lab, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max(-(-max((len(v) for *_, v in kept), default=0) // parts), 1)
    cut = [[(v + [0] * (parts * width))[p * width : (p + 1) * width] for p in range(parts)] for *_, v in kept]
    order = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, kept[i][2]))[:entries]
    books = [[cut[i][p] for i in order] for p in range(parts)]

    def near(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), j) for j, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for c in cut:
                groups.setdefault(near(p, c[p])[1], []).append(c[p])
            for j, g in groups.items():
                books[p][j] = [sum(x) // len(g) for x in zip(*g)]
    out, by_label = [], {}
    for (k, lab, _), c in zip(kept, cut):
        got = [near(p, c[p]) for p in range(parts)]
        error = min(sum(d for d, _ in got), 2**63 - 1)
        by_label[lab] = by_label.get(lab, 0) + error
        out.append((k, [j for _, j in got], error, lab))
    return sorted(((k, c, e, min(by_label[lab], 2**63 - 1)) for k, c, e, lab in out), key=repr), books


def check(spark, rows, parts, entries, rounds=2):
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "SKU long, Category int, features array<double>, error int, codes string").repartition(3)
    got = encode_vectors(table, parts=parts, entries=entries, rounds=rounds)
    want, books = expected(rows, parts, entries, rounds)
    assert got.codes.columns == ["SKU", "codes", "error", "label_error"]
    assert sorted(((r[0], list(r[1]), r[2], r[3]) for r in got.codes.collect()), key=repr) == want
    assert got.codebooks == (books if want else [])


def vectors(n, dim, scale=1.0, seed=1):
    rng = random.Random(seed)
    return [(k, rng.choice([None, 1, 2]), [rng.gauss(0, scale) for _ in range(dim)]) for k in range(n)]


def test_equals_brute_force(spark):
    rows = vectors(150, 24)
    rows += [(7, 1, rows[3][2]), (8, 2, rows[3][2]), (None, 1, rows[4][2]), (900, None, None), (901, 1, [1.0, None]), (902, 1, [float("nan")]), (903, 3, [float("-inf")])]
    check(spark, rows, 4, 8)
    check(spark, rows, 3, 1, 0)


def test_lengths_that_differ_and_do_not_divide(spark):
    check(spark, [*vectors(30, 10), (50, 1, []), (51, 2, [0.5] * 3), (52, None, [-0.001] * 13)], 4, 5)


@pytest.mark.parametrize("scale", [1e6, 1e12, 1e30])
def test_components_beyond_64_bits(spark, scale):
    check(spark, vectors(40, 8, scale), 2, 4)


def test_few_and_no_vectors(spark):
    check(spark, vectors(3, 32), 16, 64)
    check(spark, [(1, 1, [])], 16, 64)
    check(spark, [(1, 1, None)], 16, 64)


def test_transform_keeps_scaled_distances_in_sequency_order():
    rng = np.random.default_rng(0)
    x, y = rng.integers(-1000, 1000, (2, 50, 6))
    assert (((walsh(x) - walsh(y)) ** 2).sum(1) == 8 * ((x - y) ** 2).sum(1)).all()
    rows = walsh(np.eye(16, dtype=np.int64)).T
    assert [int((np.diff(r) != 0).sum()) for r in rows] == list(range(16))
    assert sequency_order(1).tolist() == [0]


def test_ties_go_to_the_lower_index():
    parts, entries = np.array([[0, 0], [5, 5]]), np.array([[1, 0], [0, 1], [5, 5], [5, 5]])
    code, apart = nearest_entries(parts, entries)
    assert code.tolist() == [0, 2] and apart.tolist() == [1, 0]
