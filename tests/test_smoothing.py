"""Smoothing of long series at any strength, and thresholds counted once per row."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from demandloom.operators import features, investigate

FIRST = dt.date(1960, 1, 5)


@pytest.mark.parametrize("alpha", [0.0, 0.001, 0.01, 0.1, 0.5, 0.95, 0.999999, 1.0])
def test_smoothing_equals_a_fold_over_long_series(spark, alpha):
    rng = random.Random(1)
    series = {"a": [10.0**rng.randrange(9) for _ in range(3000)], "b": [5.0], "c": [0.0] * 400 + [1.0] * 100}
    rows = [(k, FIRST + dt.timedelta(7 * i), i, x) for k, xs in series.items() for i, x in enumerate(xs)]
    table = spark.createDataFrame(rows, "SKU string, week_start date, t int, x double")
    got = {(r.SKU, r.t): r.s for r in table.select("SKU", "t", features.smoothed("x", alpha, "t").alias("s")).collect()}
    for k, xs in series.items():
        state = xs[0]
        for i, x in enumerate(xs):
            state = x if i == 0 else alpha * x + (1 - alpha) * state
            assert got[(k, i)] == pytest.approx(state, rel=1e-9, abs=1e-12)


def test_threshold_sweep_counts_each_row_once(spark):
    rng = random.Random(2)
    weeks = (3, 1, 8)
    rows = [(f"S{i % 9}", float(i % 9 % 4), rng.randrange(40), rng.choice([None, 0, 5])) for i in range(90)]
    table = spark.createDataFrame(rows, "SKU string, avg_demand double, position long, Safety_Stock long")
    master = spark.createDataFrame([(f"S{i}", "x" if i % 2 else "y") for i in range(9)], "SKU string, Category string")
    sweep = {(r.n_weeks, r.level): r for r in investigate.overstock_threshold_sweep(table, master, weeks).collect()}
    items = {r.n_weeks: r for r in investigate.overstock_sweep_items(table, weeks).collect()}
    for n in weeks:
        over = {i: p - (n * d + s) for i, (_, d, p, s) in enumerate(rows) if s is not None}
        for level, part in (("all", rows), ("category:x", [r for r in rows if int(r[0][1]) % 2])):
            got = sweep[(n, level)]
            excess = [p - (n * d + s) for _, d, p, s in part if s is not None and p > n * d + s]
            assert got.n_rows == len(part) and got.alert_rate_pct == pytest.approx(100 * len(excess) / len(part))
            assert got.mean_excess_units == (pytest.approx(sum(excess) / len(excess)) if excess else None)
        per = {}
        for i, e in over.items():
            per.setdefault(rows[i][0], []).append(e > 0)
        assert items[n].skus_with_any_alert == sum(map(any, per.values())) and items[n].skus_with_all_alerts == sum(map(all, per.values()))
        excess = sorted(e for e in over.values() if e > 0)
        mid = len(excess) // 2
        assert items[n].median_excess_units == pytest.approx(excess[mid] if len(excess) % 2 else (excess[mid - 1] + excess[mid]) / 2)
