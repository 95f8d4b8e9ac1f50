"""Ranked recommendations from risk scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .risk import HORIZON, LEAD_WEEKS, MONEY, ON_ORDER_POLICY, THRESHOLD_STATUS, THRESHOLD_WEEKS, fill_template, one_decimal, quoted, whole

# Codes, titles, priorities and thresholds of the published recommendation outputs.
PRIORITIES = {
    0: "0 — UNKNOWN",
    1: "1 — CRITICAL",
    2: "2 — HIGH",
    3: "3 — MEDIUM",
    4: "4 — LOW",
    5: "5 — INFORMATIONAL",
}
CODES = (
    "EXPEDITE_PO", "PLACE_PO", "REVIEW_PIPELINE", "FREEZE_REPLENISHMENT", "MAINTAIN_SCHEDULE", "DATA_UNAVAILABLE",
)
FRESH_DAYS, AGEING_DAYS = 14, 28
CAPPED_COVER = 999.0

# One row per decision case — code, title, priority rank, triggering risk, follow-up, action, rationale.
CASES: dict[str, tuple[str, str, int, str, str, str, str]] = {
    "missing": (
        "DATA_UNAVAILABLE", "Inventory Snapshot Missing", 0, "MISSING_INVENTORY_DATA",
        "Contact inventory accounting to restore automated snapshot synchronization.",
        "Request immediate physical cycle count or verify ERP snapshot synchronization. Operational replenishment risk cannot be evaluated without stock observations.",
        "No inventory snapshot was recorded at or before origin date {origin}.",
    ),
    "expedite_open": (
        "EXPEDITE_PO", "Expedite Inbound Shipment", 1, "STOCKOUT_IMMINENT",
        "Contact supplier within 24 hours to expedite shipment and obtain tracking confirmation.",
        "Expedite existing inbound purchase order of {on_order} units immediately or arrange emergency split-shipment. Physical stock of {stock} units will be depleted in week {stockout_week}.",
        "Projected inventory position drops to {ip_stockout} units (stockout) in week {stockout_week}, which is within the supplier lead time of {lead} days. Open orders exist but require delivery acceleration.",
    ),
    "expedite_new": (
        "EXPEDITE_PO", "Expedite Inbound Shipment", 1, "STOCKOUT_IMMINENT",
        "Contact supplier within 24 hours to expedite shipment and obtain tracking confirmation.",
        "Issue emergency purchase order for ~{emergency} units with air/priority freight. Zero inbound orders exist and physical stock of {stock} units exhausts in week {stockout_week}.",
        "Stockout projected in week {stockout_week} ({ip_stockout} units balance) within lead time of {lead} days with no open replenishment orders in the pipeline.",
    ),
    "reorder_surplus": (
        "PLACE_PO", "Issue Replenishment Purchase Order", 2, "REORDER_POINT_BREACH_LT",
        "Create purchase order requisition and transmit to vendor within 48 hours.",
        "Issue a calibrated replenishment order for ~{order} units to protect week {rp_week} Reorder Point breach. Note: Long-horizon inventory indicates {excess_weeks} weeks of terminal surplus; do not exceed required batch size.",
        "Inventory position breaches Reorder Point ({rp} units) in week {rp_week} (lead time is {lead} days). Reorder takes strict precedence over terminal surplus to prevent intermediate stockout.",
    ),
    "reorder": (
        "PLACE_PO", "Issue Replenishment Purchase Order", 2, "REORDER_POINT_BREACH_LT",
        "Create purchase order requisition and transmit to vendor within 48 hours.",
        "Place replenishment purchase order for ~{order} units. Target supplier delivery on or before week {rp_week}.",
        "Projected inventory position ({ip_rp} units) breaches Reorder Point ({rp} units) in week {rp_week}, inside the supplier lead time window of {lead} days.",
    ),
    "monitor": (
        "REVIEW_PIPELINE", "Review Replenishment Pipeline", 3, "REORDER_POINT_BREACH_HORIZON",
        "Review open purchase order ETAs during weekly inventory planning meeting.",
        "Prepare replenishment purchase order for week {order_by}. Current pipeline is adequate through week {before_rp}, with Reorder Point breach projected in week {rp_week}.",
        "Inventory position remains above Reorder Point during immediate lead time, but declines to {ip_rp} units (below Reorder Point of {rp} units) in week {rp_week}.",
    ),
    "surplus_severe": (
        "FREEZE_REPLENISHMENT", "Halt Inbound Replenishment", 3, "EXCESS_INVENTORY",
        "Escalate to merchandise planning for promotional markdown or supplier return assessment.",
        "FREEZE REPLENISHMENT: Severe overstock detected ({excess} excess units, {excess_weeks} weeks of cover above safety buffer). Suspend all new purchase orders for {pause} weeks. Evaluate immediate promotional markdowns, bundle offers, or stock transfers.",
        "Projected inventory position at horizon h=8 exceeds required safety stock by {excess} units ({excess_weeks} surplus weeks of demand). Evaluated against approved 8-week production forecast horizon.",
    ),
    "surplus_high": (
        "FREEZE_REPLENISHMENT", "Halt Inbound Replenishment", 4, "EXCESS_INVENTORY",
        "Monitor weekly demand consumption and confirm no automated replenishment POs are released.",
        "Pause purchase orders for {pause} weeks. Total pipeline provides {cover} weeks of cover ({excess} units surplus above 8-week horizon).",
        "Projected inventory position at horizon h=8 exceeds required safety stock by {excess} units ({excess_weeks} surplus weeks of demand). Evaluated against approved 8-week production forecast horizon.",
    ),
    "surplus_mild": (
        "FREEZE_REPLENISHMENT", "Halt Inbound Replenishment", 4, "EXCESS_INVENTORY",
        "Review inventory position at next monthly snapshot.",
        "Elevated stock: pipeline holds {excess} units ({excess_weeks} weeks) above 8-week horizon target. Defer upcoming order placements.",
        "Projected inventory position at horizon h=8 exceeds required safety stock by {excess} units ({excess_weeks} surplus weeks of demand). Evaluated against approved 8-week production forecast horizon.",
    ),
    "balanced": (
        "MAINTAIN_SCHEDULE", "Maintain Normal Schedule", 5, "NONE",
        "Continue weekly forecast and sales monitoring.",
        "Inventory coverage is well-balanced across the 8-week horizon ({cover} weeks of cover). No supply chain intervention required.",
        "Projected inventory position remains above Reorder Point throughout planning horizon and clears naturally without excess stock.",
    ),
}
CASE_FIELDS = (
    "recommendation_code", "recommendation_title", "priority_rank", "triggering_risk", "required_follow_up",
    "recommended_action", "rationale",
)


CONFIDENCE = (
    "CASE WHEN NOT inventory_data_available THEN 'NO_DATA' WHEN days_since_snapshot IS NULL THEN 'MEDIUM_CONFIDENCE'"
    f" WHEN days_since_snapshot <= {FRESH_DAYS} THEN 'HIGH_CONFIDENCE' WHEN days_since_snapshot <= {AGEING_DAYS} THEN 'MEDIUM_CONFIDENCE'"
    " ELSE 'DEGRADED_CONFIDENCE' END"
)
# Shortage outranks surplus; a missing snapshot outranks both.
CASE_RULE = (
    "CASE WHEN action_tier = 'UNKNOWN' THEN 'missing'"
    " WHEN action_tier = 'CRITICAL REORDER' THEN IF(On_Order > 0, 'expedite_open', 'expedite_new')"
    " WHEN action_tier = 'REORDER' THEN IF(excess_inventory_units > 0, 'reorder_surplus', 'reorder')"
    " WHEN action_tier = 'MONITOR' THEN 'monitor'"
    " WHEN action_tier = 'OVERSTOCK' OR excess_weeks_of_cover > 0 THEN"
    " CASE WHEN overstock_tier = 'CRITICAL' OR excess_weeks_of_cover > 6 THEN 'surplus_severe'"
    " WHEN overstock_tier = 'HIGH' OR excess_weeks_of_cover > 2 THEN 'surplus_high' ELSE 'surplus_mild' END"
    " ELSE 'balanced' END"
)


def _at_least_one(quantity: str) -> str:
    return f"greatest(1L, CAST(bround({quantity}, 0) AS BIGINT))"


EMERGENCY_QTY = _at_least_one("greatest(Reorder_Point - Current_Stock, 4 * avg_weekly_demand)")
REORDER_QTY = _at_least_one("greatest(Reorder_Point - ip_at_rp_breach + lead_time_demand, 4 * avg_weekly_demand)")
ORDER_BY_WEEK = f"greatest(1, earliest_rp_breach_week - {LEAD_WEEKS})"


def decision_quantities(risk: DataFrame) -> DataFrame:
    """Decision case, order quantities and order-by week for every risk row."""
    ip = f"array({', '.join(f'ip_h{h}' for h in range(1, HORIZON + 1))})"
    return risk.selectExpr(
        "*", f"{CASE_RULE} AS _case", f"get({ip}, earliest_stockout_week - 1) AS ip_at_stockout",
        f"get({ip}, earliest_rp_breach_week - 1) AS ip_at_rp_breach",
    ).selectExpr(
        "*", f"CASE WHEN _case = 'expedite_new' THEN {EMERGENCY_QTY} END AS emergency_qty",
        f"CASE WHEN action_tier = 'REORDER' THEN {REORDER_QTY} END AS reorder_qty",
        f"CASE WHEN action_tier = 'MONITOR' THEN {ORDER_BY_WEEK} END AS order_by_week",
    )


TEXT_VALUES = {
    "origin": "origin_date", "on_order": whole("On_Order"), "stock": whole("Current_Stock"), "lead": whole("Lead_Time_Days"),
    "rp": whole("Reorder_Point"), "stockout_week": "earliest_stockout_week", "rp_week": "earliest_rp_breach_week",
    "before_rp": "(earliest_rp_breach_week - 1)", "order_by": "order_by_week", "ip_stockout": whole("ip_at_stockout"),
    "ip_rp": whole("ip_at_rp_breach"), "emergency": "emergency_qty", "order": "reorder_qty",
    "excess": whole("excess_inventory_units"), "excess_weeks": one_decimal("excess_weeks_of_cover"),
    "pause": "greatest(1L, ceil(excess_weeks_of_cover))", "cover": one_decimal("weeks_of_cover"),
}


def rule_table(spark: SparkSession) -> DataFrame:
    """The decision cases as a ten-row table (Spark knows its size and broadcasts it)."""
    fixed = [i for i, f in enumerate(CASE_FIELDS) if f not in ("recommended_action", "rationale")]
    rows = []
    for case, row in CASES.items():
        cells = [quoted(row[i]) if isinstance(row[i], str) else str(row[i]) for i in fixed]
        rows.append(f"({quoted(case)}, {', '.join(cells)}, {quoted(PRIORITIES[row[2]])})")
    names = ", ".join(["_case", *[CASE_FIELDS[i] for i in fixed], "priority"])
    return spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS r({names})")


def _text(position: int) -> str:
    cases = " ".join(f"WHEN {quoted(case)} THEN {fill_template(row[position], TEXT_VALUES)}" for case, row in CASES.items())
    return f"CASE _case {cases} END"


def recommendations(risk: DataFrame, master: DataFrame, status: str = THRESHOLD_STATUS) -> DataFrame:
    """One recommendation per risk row of a master item (31 columns; sort at the sink)."""
    names = master.selectExpr("SKU", "Product_Name AS product_name", "Category AS category", "Subcategory AS subcategory")
    df = decision_quantities(risk).join(rule_table(risk.sparkSession), "_case").join(names, "SKU")
    return df.selectExpr(
        "CAST(origin_date AS STRING) AS origin_date", "SKU AS sku", "product_name", "category", "subcategory", "recommendation_code",
        "recommendation_title", f"{_text(5)} AS recommended_action", "priority", "priority_rank", f"{_text(6)} AS rationale", "triggering_risk",
        f"{CONFIDENCE} AS confidence_status", "required_follow_up", "Current_Stock AS current_stock", "On_Order AS on_order",
        "Lead_Time_Days AS lead_time_days", "Safety_Stock AS safety_stock", "Reorder_Point AS reorder_point", "avg_weekly_demand",
        f"CASE WHEN weeks_of_cover = double('Infinity') THEN {CAPPED_COVER}D ELSE weeks_of_cover END AS weeks_of_cover",
        "excess_weeks_of_cover", "earliest_rp_breach_week AS earliest_breach_week", "earliest_stockout_week",
        "CAST(estimated_stockout_date AS STRING) AS projected_stockout_date", "valuation_basis_confirmed", "arrival_timing_confirmed",
        "on_order_policy", "overstock_threshold_weeks", f"{quoted(status)} AS overstock_threshold_status", "true AS monetary_valuation_blocked",
    )


def govern(recs: DataFrame, status: str = "POLICY_RATIFIED") -> DataFrame:
    """Recommendations under the ratified policies: no monetary value leaves, valuation and arrival times stay unconfirmed.

    Valuation columns become NULL where they occur; another stock policy or threshold than the ratified ones raises.
    """
    ratified = F.col("on_order_policy").eqNullSafe(ON_ORDER_POLICY) & F.col("overstock_threshold_weeks").eqNullSafe(THRESHOLD_WEEKS)
    policy = F.when(ratified, F.col("on_order_policy")).otherwise(F.raise_error(F.lit("recommendation under a policy that is not ratified")))
    return recs.withColumns({
        **{m: F.lit(None).cast("double") for m in MONEY if m in recs.columns},
        "on_order_policy": policy, "overstock_threshold_status": F.lit(status), "valuation_basis_confirmed": F.lit(False),
        "arrival_timing_confirmed": F.lit(False), "monetary_valuation_blocked": F.lit(True),
    })


def value_distribution(df: DataFrame, columns: list[str]) -> DataFrame:
    """Counts of each value of each column, from one expanded aggregate."""
    pairs = F.array(*[F.struct(F.lit(x).alias("field"), F.col(x).cast("string").alias("value")) for x in columns])
    return df.select(F.inline(pairs)).groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))


def summary_payload(recs: DataFrame) -> DataFrame:
    """Priority and code counts, for the latest origin and for the whole panel."""
    latest = recs.agg(F.max("origin_date")).scalar()
    scopes = F.when(F.col("origin_date") == latest, F.array(F.lit("latest"), F.lit("panel"))).otherwise(F.array(F.lit("panel")))
    scoped = recs.withColumn("scope", F.explode(scopes))
    pairs = F.array(*[F.struct(F.lit(x).alias("field"), F.col(x).alias("value")) for x in ("priority", "recommendation_code")])
    return scoped.select("scope", F.inline(pairs)).groupBy("scope", "field", "value").agg(F.count(F.lit(1)).alias("n"))


def nested_records(recs: DataFrame) -> DataFrame:
    """Record form: supporting metrics and governance as nested structs."""
    metrics = (
        "current_stock", "on_order", "lead_time_days", "safety_stock", "reorder_point", "avg_weekly_demand",
        "weeks_of_cover", "excess_weeks_of_cover", "earliest_breach_week", "earliest_stockout_week", "projected_stockout_date",
    )
    governance = (
        "valuation_basis_confirmed", "arrival_timing_confirmed", "on_order_policy", "overstock_threshold_weeks",
        "overstock_threshold_status", "monetary_valuation_blocked",
    )
    flat = [x for x in recs.columns if x not in metrics and x not in governance]
    return recs.select(*flat, F.struct(*metrics).alias("supporting_metrics"), F.struct(*governance).alias("governance"))
