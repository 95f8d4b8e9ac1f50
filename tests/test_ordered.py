"""Global scans against brute force, with more ranges than such few rows would get."""

import numpy as np
import pytest

from demandloom.operators import ordered


@pytest.fixture(autouse=True)
def many_ranges(monkeypatch):
    monkeypatch.setattr(ordered.prefix_scan, "__defaults__", (16, False))
    monkeypatch.setattr(ordered.segment_scan, "__defaults__", (16,))


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema).repartition(5)


def test_running_aggregates_follow_the_global_order(spark):
    rng = np.random.default_rng(7)
    rows = [(float(v), i, int(w)) for i, (v, w) in enumerate(zip(rng.integers(0, 40, 500), rng.integers(1, 9, 500)))]
    got = ordered.prefix_scan(frame(spark, rows, "v double, k int, w int"), ["v", "k"], {"s": ("sum", "w"), "m": ("max", "w"), "lo": ("min", "w")}).collect()
    total, high, low, want = 0, 0, 99, {}
    for v, k, w in sorted(rows):
        total, high, low = total + w, max(high, w), min(low, w)
        want[k] = (total, high, low)
    assert {r["k"]: (r["s"], r["m"], r["lo"]) for r in got} == want


def test_quantiles_match_linear_interpolation_with_a_hot_value(spark):
    rng = np.random.default_rng(3)
    values = np.concatenate([np.full(400, 7.0), rng.normal(10, 4, 600).round(3)])
    groups = ["a" if i % 3 else "b" for i in range(len(values))]
    df = frame(spark, [(g, float(v)) for g, v in zip(groups, values)], "g string, v double")
    probs = {"q10": 0.1, "q50": 0.5, "q93": 0.93}
    overall = ordered.quantiles(df, "v", probs).first()
    for name, p in probs.items():
        assert overall[name] == pytest.approx(np.quantile(values, p), abs=1e-9)
    for r in ordered.quantiles(df, "v", probs, by=["g"]).collect():
        mine = values[[g == r["g"] for g in groups]]
        for name, p in probs.items():
            assert r[name] == pytest.approx(np.quantile(mine, p), abs=1e-9)


def grouped(spark, n, groups):
    """Unique values per group: one group with nearly all of them, small ones on both sides of it, one of NULL."""
    hot = [("m", float(v), 1 + v % 3) for v in range(n)]
    small = [(g, float(v), 1 + v % 2) for i, g in enumerate(groups) for v in range(1 + i % 4)]
    return hot + small, frame(spark, hot + small, "g string, v double, n bigint")


def test_a_segment_scan_restarts_at_every_group(spark):
    rows, df = grouped(spark, 2000, [None, *[f"a{i:02d}" for i in range(30)], *[f"z{i:02d}" for i in range(30)]])
    want, sums = {}, {}
    for g, v, n in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1])):
        sums[g] = sums.get(g, 0) + n
        want[g, v] = (sums[g], None)
    got = {(r["g"], r["v"]): (r["_upto"], r["_size"]) for r in ordered.segment_scan(df, ["g"], ["v"], "n").collect()}
    assert got == {k: (upto, sums[k[0]]) for k, (upto, _) in want.items()}


def test_a_segment_scan_of_one_group_of_no_rows_and_of_single_rows(spark):
    for rows in ([], [("m", float(v), 2) for v in range(50)], [(f"g{i}", 1.0, 3) for i in range(50)]):
        df = frame(spark, rows, "g string, v double, n bigint")
        got = sorted((r["g"], r["v"], r["_upto"], r["_size"]) for r in ordered.segment_scan(df, ["g"], ["v"], "n").collect())
        size = {g: sum(n for h, _, n in rows if h == g) for g, _, _ in rows}
        assert got == sorted((g, v, int(2 * v + 2) if g == "m" else 3, size[g]) for g, v, _ in rows)


def test_grouped_quantiles_never_join_by_group(spark):
    rows, df = grouped(spark, 3000, ["a", "b", "z", None])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = ordered.quantiles(df, "v", {"q": 0.35}, by=["g"], weight="n")
        got = {r["g"]: r["q"] for r in out.collect()}
        assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    for g in ("m", "a", "b", "z", None):
        assert got[g] == pytest.approx(np.quantile(np.repeat([v for h, v, _ in rows if h == g], [n for h, _, n in rows if h == g]), 0.35), abs=1e-9)
    assert set(got) == {"m", "a", "b", "z", None}


def test_rank_min_shares_the_smallest_rank(spark):
    df = frame(spark, [("a", 5, 1.0), ("b", 9, 1.0), ("c", 5, 2.0), ("d", 1, None)], "SKU string, x int, y double")
    got = {r["SKU"]: (r["rx"], r["ry"]) for r in ordered.rank_min(df, {"x": "rx", "y": "ry"}).collect()}
    assert got == {"b": (1, 2), "a": (2, 2), "c": (2, 1), "d": (4, None)}


def test_row_numbers_cover_every_row_once(spark):
    df = frame(spark, [(float(i % 7), i) for i in range(300)], "v double, k int")
    got = sorted((r["v"], r["k"], r["row_number"]) for r in ordered.row_numbers(df, ["v", "k"]).collect())
    assert [r[2] for r in got] == list(range(1, 301))


def test_nearest_price_equals_brute_force(spark):
    from demandloom.operators.investigate import nearest_price_match

    rng = np.random.default_rng(11)
    units = [(f"S{i}", float(v)) for i, v in enumerate(rng.uniform(0, 100, 80).round(2))]
    prices = [(f"P{i}", float(v)) for i, v in enumerate(rng.uniform(0, 100, 60).round(2))]
    got = nearest_price_match(frame(spark, units, "SKU string, unit_iv double"), frame(spark, prices, "SKU string, price double"), "price")
    want = {s: min((round(abs(v - p), 2), p) for _, p in prices)[0] for s, v in units}
    assert {r["SKU"]: r["match_diff"] for r in got.collect()} == pytest.approx(want)


def test_quintiles_match_ntile(spark):
    from demandloom.operators.investigate import item_quintiles

    df = frame(spark, [(f"S{i:02d}", float((i * 37) % 23)) for i in range(23)], "SKU string, d double")
    got = sorted((r["d"], r["SKU"], r["quintile"]) for r in item_quintiles(df, "d").collect())
    assert [q for _, _, q in got] == [1] * 5 + [2] * 5 + [3] * 5 + [4] * 4 + [5] * 4
