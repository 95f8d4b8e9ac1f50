import datetime as dt

import pytest
from pyspark.sql import functions as F

from demandloom.operators import decide, investigate, risk

ORIGIN, SNAP = dt.date(2025, 1, 6), dt.date(2025, 1, 1)


def score(spark, items, forecast=50.0, snap=SNAP):
    """``items``: name -> (stock, on_order, lead, safety, reorder point)."""
    fc = spark.createDataFrame([(ORIGIN, k, h, float(forecast)) for k in items for h in range(1, 9)], "origin_date date, SKU string, horizon int, prediction double")
    inv = spark.createDataFrame([(snap, k, *map(float, v)) for k, v in items.items()], "Snapshot_Date date, SKU string, Current_Stock double, On_Order double, Lead_Time_Days double, Safety_Stock double, Reorder_Point double")
    keys = spark.createDataFrame([(k, ORIGIN) for k in items], "SKU string, origin_date date")
    return risk.risk_scores(keys, fc, inv)


def one(spark, *item, **kw):
    return score(spark, {"SKU001": item}, **kw).first()


def test_item_a(spark):
    r = one(spark, 200, 100, 7, 50, 100)
    assert [r[f"ip_h{h}"] for h in range(1, 9)] == [250, 200, 150, 100, 50, 0, -50, -100]
    assert (r["sb_h1"], r["sb_h8"]) == (150, -200)
    assert (r["weeks_of_cover"], r["days_of_supply"], r["stock_weeks_of_cover"], r["stock_days_of_supply"]) == (6, 42, 4, 28)
    assert r["lead_time_demand"] == 50 and r["stockout_score"] == 0 and r["excess_inventory_units"] == 0
    assert (r["earliest_ss_breach_week"], r["earliest_rp_breach_week"], r["earliest_stockout_week"]) == (6, 5, 6)
    assert r["estimated_stockout_date"] == ORIGIN + dt.timedelta(weeks=6) and r["days_since_snapshot"] == 5
    assert r["action_tier"] == "MONITOR" and r["excess_inventory_value"] is None


def test_item_b(spark):
    r = one(spark, 800, 200, 14, 100, 150)
    assert (r["ip_h1"], r["ip_h2"], r["ip_h8"]) == (750, 900, 600)
    assert r["weeks_of_cover"] == 20 and r["lead_time_demand"] == 100
    assert r["excess_inventory_units"] == 500 and r["excess_weeks_of_cover"] == 10 and r["overstock_tier"] == "CRITICAL"
    assert r["action_tier"] == "OVERSTOCK"


def test_item_c(spark):
    r = one(spark, 10, 500, 14, 50, 100)
    assert r["ip_h1"] == -40 and r["action_tier"] == "CRITICAL REORDER"
    assert r["recommendation"].startswith("CRITICAL REORDER: Stockout projected in week 1 (within lead time of 14 days)")


@pytest.mark.parametrize("weeks,tier", [(0, "HEALTHY"), (0.5, "MONITOR"), (2, "MONITOR"), (2.01, "HIGH"), (6, "HIGH"), (6.01, "CRITICAL")])
def test_overstock_borders(spark, weeks, tier):
    assert one(spark, 400 + 10 + 50 * weeks, 0, 7, 10, 5)["overstock_tier"] == tier


def test_fractional_lead_time_is_pro_rata(spark):
    assert one(spark, 500, 0, 10, 10, 5)["lead_time_demand"] == pytest.approx(50 + 50 * 3 / 7)
    assert one(spark, 500, 0, 70, 10, 5)["lead_time_demand"] == 400


def test_zero_demand_gives_infinite_cover(spark):
    r = one(spark, 100, 0, 7, 10, 5, forecast=0)
    assert r["weeks_of_cover"] == float("inf") and r["stockout_score"] == 0 and r["excess_weeks_of_cover"] == 0
    assert "inf weeks of cover" in r["recommendation"]


def test_future_snapshot_is_unknown(spark):
    r = one(spark, 100, 0, 7, 10, 5, snap=dt.date(2025, 1, 15))
    assert r["action_tier"] == "UNKNOWN" and r["ip_h1"] is None and r["avg_weekly_demand"] == 50
    assert r["recommendation"] == "UNKNOWN: No inventory snapshot available at or before 2025-01-06."


def test_layouts_agree_and_short_vectors_are_padded(spark):
    wide = spark.createDataFrame([(ORIGIN, "A", *[float(h - 2) for h in range(1, 9)])], "origin date, sku string, " + ", ".join(f"pred_h{h} double" for h in range(1, 9)))
    assert risk.normalize_forecast_layout(wide).first()["forecast"] == [0, 0, 1, 2, 3, 4, 5, 6]
    short = spark.createDataFrame([(ORIGIN, "A", 2, 7.0), (ORIGIN, "A", 1, 5.0)], "forecast_origin date, SKU string, h int, units_forecast double")
    assert risk.normalize_forecast_layout(short).first()["forecast"] == [5, 7, 7, 7, 7, 7, 7, 7]
    with pytest.raises(ValueError):
        risk.normalize_forecast_layout(wide.drop("pred_h8"))


def master(spark, *skus):
    return spark.createDataFrame([(s, "P", "C", "D") for s in skus], "SKU string, Product_Name string, Category string, Subcategory string")


def recommend(spark, **items):
    scored = score(spark, items)
    return {r["sku"]: r for r in decide.recommendations(scored, master(spark, *items)).collect()}


def test_codes_quantities_and_priorities(spark):
    got = recommend(
        spark, exped=(10, 500, 14, 50, 100), urgent=(10, 0, 14, 50, 100), order=(120, 0, 14, 10, 100), watch=(300, 0, 7, 10, 60),
        severe=(800, 200, 14, 100, 150), high=(560, 0, 7, 10, 20), mild=(450, 0, 7, 10, 20), fine=(410, 0, 7, 10, 5),
    )
    codes = {k: (r["recommendation_code"], r["priority_rank"]) for k, r in got.items()}
    assert codes == {
        "exped": ("EXPEDITE_PO", 1), "urgent": ("EXPEDITE_PO", 1), "order": ("PLACE_PO", 2), "watch": ("REVIEW_PIPELINE", 3),
        "severe": ("FREEZE_REPLENISHMENT", 3), "high": ("FREEZE_REPLENISHMENT", 4), "mild": ("FREEZE_REPLENISHMENT", 4), "fine": ("MAINTAIN_SCHEDULE", 5),
    }
    assert "~200 units with air/priority freight" in got["urgent"]["recommended_action"]
    assert "~200 units." in got["order"]["recommended_action"]
    assert got["order"]["confidence_status"] == "HIGH_CONFIDENCE"


def test_unlisted_items_are_dropped_and_missing_snapshots_kept(spark):
    scored = score(spark, {"SKU001": (100, 0, 7, 10, 5), "SKU999": (100, 0, 7, 10, 5)}, snap=dt.date(2025, 2, 1))
    rows = decide.recommendations(scored, master(spark, "SKU001")).collect()
    assert [(r["sku"], r["recommendation_code"], r["priority_rank"], r["confidence_status"]) for r in rows] == [("SKU001", "DATA_UNAVAILABLE", 0, "NO_DATA")]


def test_valuation_is_refused_until_the_basis_is_resolved(spark):
    scored = score(spark, {"SKU001": (10, 0, 14, 50, 100)})
    units = spark.createDataFrame([("SKU001", 2.0)], "SKU string, unit_iv double")
    with pytest.raises(PermissionError):
        investigate.value_at_risk_gated(scored, units, basis_resolved=False)
    assert investigate.value_at_risk_gated(scored, units, True).first()["value_at_risk_h1"] == 80


def test_inbound_policies(spark):
    keys = spark.createDataFrame([("A", ORIGIN)], "SKU string, origin_date date")
    vec = keys.withColumn("forecast", F.array_repeat(F.lit(10.0), 8))
    inv = spark.createDataFrame([(SNAP, "A", 20.0, 100.0, 21.0, 15.0, 30.0)], "Snapshot_Date date, SKU string, Current_Stock double, On_Order double, Lead_Time_Days double, Safety_Stock double, Reorder_Point double")
    rows = {p: risk.positions(keys, vec, inv, p).first()["ip"][:3] for p in risk.ARRIVALS}
    assert rows == {"Policy_A": [110, 100, 90], "Policy_B1": [10, 100, 90], "Policy_B_LT": [10, 0, 90], "Policy_D": [10, 0, -10]}


def test_dossier_of_an_unknown_item_raises(spark):
    from demandloom.operators.reports import sku_dossier

    recs = decide.recommendations(score(spark, {"SKU001": (100, 0, 7, 10, 5)}), master(spark, "SKU001"))
    fc = spark.createDataFrame([("SKU001", ORIGIN, h, float(h)) for h in range(8, 0, -1)], "SKU string, forecast_origin date, horizon int, forecast double")
    row = sku_dossier(recs, fc, "SKU001").first()
    assert [row[f"forecast_h{h}"] for h in range(1, 9)] == [1, 2, 3, 4, 5, 6, 7, 8]
    with pytest.raises(Exception, match="no active recommendation for SKU404"):
        sku_dossier(recs, fc, "SKU404").collect()


def test_one_decimal_text_equals_python(spark):
    values = [i / 20 for i in range(0, 400)] + [0.25, 1.05, 1.15, 2.675, 1e6 + 0.05, 123456.75, 0.049999999999999996, 3.0000000000000004]
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    assert [r[0] for r in df.selectExpr(risk.one_decimal("x")).collect()] == [f"{v:.1f}" for v in values]


def test_two_forecasts_for_one_horizon_raise(spark):
    rows = [(ORIGIN, "A", h, m, 5.0) for h in (1, 2) for m in ("naive", "ses")]
    fc = spark.createDataFrame(rows, "origin_date date, SKU string, horizon int, model string, prediction double")
    with pytest.raises(Exception, match="two forecasts"):
        risk.normalize_forecast_layout(fc).collect()
    assert len(risk.normalize_forecast_layout(fc.where("model = 'ses'")).collect()) == 1
