import datetime as dt

import pandas as pd
from pyspark.sql import functions as F

from demandloom.functions import week_label_monday, week_start
from demandloom.operators import timegrid


def d(text):
    return dt.date.fromisoformat(text)


def test_weeks_run_tuesday_to_monday(spark):
    days = [d("2023-12-25") + dt.timedelta(i) for i in range(120)]
    got = spark.createDataFrame([(x,) for x in days], "d date").select("d", week_start(F.col("d")).alias("w"), week_label_monday(F.col("d")).alias("m"), week_start(F.col("d"), "MON").alias("iso")).collect()
    for r in got:
        end = pd.Timestamp(r["d"]).to_period("W-MON").end_time.date()
        assert (r["w"], r["m"]) == (end - dt.timedelta(6), end)
        assert r["iso"].weekday() == 0 and 0 <= (r["d"] - r["iso"]).days < 7


def sales(spark, rows):
    return spark.createDataFrame([(d(a), b, c) for a, b, c in rows], "Date date, SKU string, Units_Sold bigint")


def test_panel_fill_covers_the_common_range(spark):
    df = sales(spark, [("2024-01-02", "A", 5), ("2024-01-04", "A", 3), ("2024-01-01", "B", 1), ("2024-01-05", "B", 9)])
    got = timegrid.panel_fill(df, "Date", ["Units_Sold"], 1)
    rows = {(r["SKU"], r["Date"].day): (r["Units_Sold"], r["is_filled"]) for r in got.collect()}
    assert rows[("A", 1)] == (0, True) and rows[("A", 3)] == (0, True) and rows[("A", 5)] == (0, True)
    assert rows[("A", 2)] == (5, False) and rows[("B", 3)] == (0, True) and len(rows) == 10


def test_panel_interpolate_draws_lines_and_stays_flat_at_the_ends(spark):
    df = sales(spark, [("2024-01-02", "A", 4), ("2024-01-04", "A", 8), ("2024-01-01", "B", 1), ("2024-01-05", "B", 1)])
    got = timegrid.panel_fill(df, "Date", ["Units_Sold"], 1, policy="interpolate")
    assert {r["Date"].day: r["Units_Sold"] for r in got.collect() if r["SKU"] == "A"} == {1: 4.0, 2: 4.0, 3: 6.0, 4: 8.0, 5: 8.0}


def test_asof_join_is_backward_and_inclusive(spark):
    left = spark.createDataFrame([("A", d("2024-01-02")), ("A", d("2024-01-09")), ("A", d("2024-02-06")), ("B", d("2024-01-09"))], "SKU string, t date")
    right = spark.createDataFrame([("A", d("2024-01-09"), 7), ("A", d("2024-02-01"), 8), ("B", d("2024-01-10"), 9)], "SKU string, s date, stock int")
    got = {(r["SKU"], r["t"]): (r["s"], r["stock"]) for r in timegrid.asof_join(left, right, "SKU", "t", "s", ["stock"]).collect()}
    assert got == {
        ("A", d("2024-01-02")): (None, None), ("A", d("2024-01-09")): (d("2024-01-09"), 7),
        ("A", d("2024-02-06")): (d("2024-02-01"), 8), ("B", d("2024-01-09")): (None, None),
    }


def test_snapshot_origin_prefers_exact_then_earlier_then_earliest(spark):
    snaps = spark.createDataFrame([(d("2024-02-01"),), (d("2024-03-01"),)], "Snapshot_Date date")

    def pick(x):
        return timegrid.select_snapshot_origin(snaps, x).first()["origin_date"]

    assert pick("2024-03-01") == d("2024-03-01") and pick("2024-02-20") == d("2024-02-01")
    assert pick("2024-01-01") == d("2024-02-01") and pick(None) == d("2024-03-01")


def test_static_params_take_first_or_last_snapshot(spark):
    keys = spark.createDataFrame([("A",)], "SKU string")
    snaps = spark.createDataFrame([("A", d("2024-02-01"), 9, 1, 1), ("A", d("2024-01-01"), 4, 1, 1)], "SKU string, snapshot_date date, Lead_Time_Days int, Safety_Stock int, Reorder_Point int")
    assert timegrid.join_static_params(keys, snaps).first()["Lead_Time_Days"] == 4
    assert timegrid.join_static_params(keys, snaps, "last").first()["Lead_Time_Days"] == 9


def test_tasks_of_windows_by_item_follow_items_and_weeks(spark, capsys):
    days = spark.range(700).selectExpr("date_add(DATE'2023-01-03', CAST(id AS INT)) AS Date").where("dayofyear(Date) % 50 = 0")
    daily = days.crossJoin(spark.range(40).selectExpr("concat('SKU', id) AS SKU")).selectExpr("SKU", "Date", "1L AS Units_Sold", "0L AS Promotion")
    assert timegrid.grid_parts(daily, rows=400) >= 9 and timegrid.grid_parts(daily.limit(0)) == 1
    weekly = timegrid.weekly_filled(daily, parts=11)
    right = daily.selectExpr("SKU", "Date AS s", "1 AS stock")
    known = timegrid.asof_join(weekly, right, "SKU", "week_start", "s", ["stock"], 13)
    capsys.readouterr()
    known.groupBy("SKU").count().explain()
    plan = capsys.readouterr().out
    # What follows by item stays in the tasks of the as-of join.
    assert "hashpartitioning(SKU" in plan and plan.index(", 13)") < plan.index(", 11)") and plan.split(", 13)")[0].count("Exchange hash") == 1


def test_tasks_of_windows_by_item_grow_with_the_grid(spark):
    ends = spark.range(8000).selectExpr("concat('SKU', id % 4000) AS SKU", "date_add(DATE'2020-01-07', IF(id < 4000, 0, 7 * 599)) AS Date")
    # Tasks of one size whatever the input: 65,536 rows of the grid, so their memory does not grow from small tables to large ones.
    assert timegrid.grid_rows(ends) == 4000 * 600 and timegrid.grid_parts(ends) >= 4000 * 600 / 65_536
