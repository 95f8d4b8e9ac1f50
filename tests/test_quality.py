import datetime as dt

import pytest

from demandloom.operators import prepare, quality
from demandloom.schemas import CALENDAR, INVENTORY, SALES, SKU_MASTER

D1, D2 = dt.date(2024, 1, 1), dt.date(2024, 1, 2)


def sales(spark, *rows):
    return spark.createDataFrame(list(rows), SALES.schema)


GOOD = [(D1, "SKU001", 2, 20.0, 10.0, 0), (D1, "SKU002", 1, 5.0, 5.0, 1), (D2, "SKU001", 3, 30.0, 10.0, 1)]
MASTER = [("SKU001", "P1", "C", "S", D1, 6.0, 10.0, 4.0), ("SKU002", "P2", "C", "S", D1, 7.0, 5.0, -2.0)]
CAL = [(D1, 2024, 1, "Q1", 1, "Monday", 0, "Winter", 1, "New Year", None), (D2, 2024, 1, "Q1", 1, "Tuesday", 0, "Winter", 0, None, None)]
INV = [(D1, "SKU001", 5, 0, 7, 1, 2, 50.0), (D1, "SKU099", 5, 0, 7, 1, 2, 50.0)]


def results(df):
    return {r["check_name"]: (r["status"], r["severity"], r["affected_rows"]) for r in df.collect()}


def suite(spark):
    return quality.quality_suite(
        sales(spark, *GOOD), spark.createDataFrame(MASTER, SKU_MASTER.schema), spark.createDataFrame(CAL, CALENDAR.schema),
        spark.createDataFrame(INV, INVENTORY.schema), (2024, 2024),
    )


def test_good_inputs_pass_with_known_warnings(spark):
    rows = suite(spark).collect()
    off = {(r["dataset"], r["check_name"]): (r["status"], r["affected_rows"]) for r in rows if r["status"] != "PASS"}
    assert off == {
        ("sku_master", "negative_margin"): ("WARNING", 1), ("cross", "inventory_sku_in_master"): ("WARNING", 1), ("sales_daily", "panel_complete"): ("FAIL", 1),
    }
    assert quality.halt_on_critical(suite(spark)).count() == len(rows)


@pytest.mark.parametrize(
    "row,check",
    [
        ((None, "SKU001", 2, 20.0, 10.0, 0), "no_null_dates_Date"), ((D2, None, 2, 20.0, 10.0, 0), "no_nulls_SKU"),
        ((D2, "SKU002", -1, -10.0, 10.0, 0), "non_negative_Units_Sold"), ((D2, "SKU002", 1, 0.0, 0.0, 0), "positive_Price"),
        ((D2, "SKU002", 1, 10.0, 10.0, 2), "allowed_values_Promotion"), ((D2, "SKU002", 1, 10.0, 10.0, None), "allowed_values_Promotion"),
        ((D2, "X2", 1, 10.0, 10.0, 0), "pattern_SKU"), ((D2, "SKU002", 2, 20.5, 10.0, 0), "revenue_consistency"),
    ],
)
def test_each_check_fires(spark, row, check):
    got = results(quality.run_checks(sales(spark, *GOOD, row), "sales_daily", quality.sales_checks()))
    assert got[check][0] == "FAIL" and got[check][2] == 1


def test_duplicate_keys_count_every_copy(spark):
    got = results(quality.pk_unique(sales(spark, *GOOD, GOOD[0], GOOD[0]), "s", ["Date", "SKU"]))
    assert got["pk_unique"] == ("FAIL", "CRITICAL", 3)


def test_critical_failure_halts(spark):
    bad = quality.pk_unique(sales(spark, *GOOD, GOOD[0]), "s", ["Date", "SKU"])
    with pytest.raises(Exception, match="critical check failed: s.pk_unique"):
        quality.halt_on_critical(bad).collect()


def test_holiday_nulls_are_structural_unless_flagged(spark):
    flagged = (D2, 2024, 1, "Q1", 1, "Tuesday", 0, "Winter", 1, None, None)
    got = results(quality.run_checks(spark.createDataFrame([CAL[1], flagged], CALENDAR.schema), "c", quality.holiday_nulls()))
    assert got == {"holiday_null_structural": ("PASS", "INFO", 1), "holiday_null_on_holiday": ("FAIL", "ERROR", 1)}


def test_join_grain_finds_fan_out_and_unmatched(spark):
    left = spark.createDataFrame([("a",), ("a",), ("b",), ("z",)], "k string")
    right = spark.createDataFrame([("a",), ("b",), ("b",)], "k string")
    got = results(quality.join_grain(left, right, ["k"], "j"))
    assert got["right_key_unique"][2] == 2 and got["rows_preserved"][2] == 1 and got["no_unmatched"][2] == 1


def test_normalisation_rejects_and_splits(spark):
    with pytest.raises(Exception, match="negative Units_Sold"):
        prepare.normalize_sales(sales(spark, (D1, "SKU001", -1, -10.0, 10.0, 0))).collect()
    zero = prepare.normalize_sales(sales(spark, (D1, " SKU001 ", 0, 0.0, 10.0, 0))).first()
    assert (zero["SKU"], zero["Units_Sold"]) == ("SKU001", 0)
    master = prepare.normalize_sku_master(spark.createDataFrame(MASTER, SKU_MASTER.schema))
    assert {r["SKU"]: r["negative_margin_flag"] for r in master.collect()} == {"SKU001": False, "SKU002": True}
    aligned, orphans = prepare.normalize_inventory(spark.createDataFrame(INV, INVENTORY.schema), master)
    assert [r["SKU"] for r in aligned.collect()] == ["SKU001"] and [r["SKU"] for r in orphans.collect()] == ["SKU099"]


def test_unmatched_dimension_rows_stop_the_panel(spark):
    master = prepare.normalize_sku_master(spark.createDataFrame(MASTER[:1], SKU_MASTER.schema))
    with pytest.raises(Exception, match="without master data"):
        prepare.join_sales_master(sales(spark, *GOOD), master).collect()


def test_fixed_encoding_and_dedupe(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("b",), ("x",), (None,)], "c string")
    assert [r[0] for r in df.select(prepare.encode_fixed_categories(F.col("c"), ["a", "b"])).collect()] == [1, -1, -1]
    rows = spark.createDataFrame([("k", 3, "x"), ("k", 1, "y"), ("k", 1, "z")], "k string, t int, v string")
    assert [tuple(r) for r in prepare.dedupe_by_key(rows, ["k"], ["t"]).collect()] == [("k", 1, "y")]
