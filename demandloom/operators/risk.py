"""Projected inventory position and risk scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .timegrid import asof_join

# Taxonomy, thresholds and policy names of the published risk outputs.
HORIZON = 8
LONG_HORIZON_DAYS = 56.0
ACTION_TIERS = ("CRITICAL REORDER", "REORDER", "MONITOR", "HEALTHY", "OVERSTOCK", "UNKNOWN")
OVERSTOCK_TIERS = ("HEALTHY", "MONITOR", "HIGH", "CRITICAL", "UNKNOWN")
OVERSTOCK_LIMITS = (0.0, 2.0, 6.0)
ON_ORDER_POLICY = "Policy_B_LT"
THRESHOLD_WEEKS = 8
THRESHOLD_STATUS = "ENGINEERING_RECOMMENDATION_PENDING_BUSINESS_APPROVAL"
# Sentence formats of the published risk outputs.
RISK_TEXT = {
    "CRITICAL REORDER": "CRITICAL REORDER: Stockout projected in week {stockout_week} (within lead time of {lead} days). Expedite replenishment immediately.",
    "REORDER": "REORDER: Projected inventory breaches Reorder Point ({rp} units) in week {rp_week} (within lead time of {lead} days). Place PO now.",
    "MONITOR": "MONITOR: Reorder Point breach projected in week {rp_week}. Review replenishment pipeline.",
    "OVERSTOCK": "OVERSTOCK ({overstock}): {excess} excess units ({excess_weeks} weeks of cover above safety buffer). Defer future orders or review promotional clearance.",
    "HEALTHY": "HEALTHY: Adequate inventory coverage across 8-week horizon ({cover} weeks of cover). No action required.",
    "UNKNOWN": "UNKNOWN: No inventory snapshot available at or before {origin}.",
}

# The column names under which published forecasts come.
ORIGIN_ALIASES = ("forecast_origin_date", "origin_date", "forecast_origin", "origin")
SKU_ALIASES = ("SKU", "sku")
HORIZON_ALIASES = ("horizon", "horizon_step", "h")
VALUE_ALIASES = ("prediction", "units_forecast", "forecast", "pred", "Units_Sold")
WIDE_ALIASES = ("h{}", "target_h{}", "pred_h{}", "forecast_h{}")


def quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def fill_template(template: str, values: dict[str, str]) -> str:
    """SQL ``concat`` of the literal pieces and the named expressions of a ``{name}`` template."""
    parts = []
    for piece in template.replace("{", "\0{").replace("}", "}\0").split("\0"):
        if piece.startswith("{"):
            parts.append(f"CAST({values[piece[1:-1]]} AS STRING)")
        elif piece:
            parts.append(quoted(piece))
    return f"concat({', '.join(parts)})"


def whole(x: str) -> str:
    """Whole-number text of an SQL expression, ties to even."""
    return f"CAST(bround({x}, 0) AS BIGINT)"


def one_decimal(x: str) -> str:
    """One-decimal text of a non-negative SQL expression; an infinite value reads ``inf``.

    Borders lie at odd multiples of 1/20. A value whose shortest text ends on a border may lie above or below it in
    binary, so the side is taken from an exact difference (the value is split into a float and its remainder,
    which 20 multiplies without rounding); true ties go to the even digit.
    """
    m = f"CAST(round({x} * 20) AS BIGINT)"
    side = f"((20 * double(float({x})) - {m}) + 20 * ({x} - double(float({x}))))"
    tie = f"IF(pmod({m} - 1, 4) = 0, {m} - 1, {m} + 1)"
    tenths = f"(CASE WHEN {m} % 2 = 0 THEN {m} WHEN {side} > 0 THEN {m} + 1 WHEN {side} < 0 THEN {m} - 1 ELSE {tie} END div 2)"
    return f"CASE WHEN {x} = double('Infinity') THEN 'inf' ELSE concat({tenths} div 10, '.', {tenths} % 10) END"


def _pick(columns: Sequence[str], aliases: Sequence[str]) -> str | None:
    return next((a for a in aliases if a in columns), None)


def normalize_forecast_layout(df: DataFrame, horizon: int = HORIZON) -> DataFrame:
    """Long or wide forecasts, under any known column names, as one vector per (origin_date, SKU).

    Short vectors are padded with their last value; negative values become 0. A missing value inside the
    vector is kept as NULL and makes that item's projections NULL. Two forecasts of an item for one horizon raise.
    """
    cols = df.columns
    sku, origin = _pick(cols, SKU_ALIASES), _pick(cols, ORIGIN_ALIASES)
    step, value = _pick(cols, HORIZON_ALIASES), _pick(cols, VALUE_ALIASES)
    if sku is None or origin is None:
        raise KeyError("forecasts need an item and an origin column")
    keys = [F.col(origin).cast("date").alias("origin_date"), F.col(sku).alias("SKU")]

    def nonneg(x: Column) -> Column:
        return F.when(x.isNotNull(), F.greatest(F.lit(0.0), x))

    if step and value:
        # One array of at most `horizon` entries per (origin, item).
        vectors = df.groupBy(*keys).agg(
            F.sort_array(
                F.collect_list(F.struct(F.col(step).alias("h"), F.col(value).cast("double").alias("y")))
            ).alias("_s")
        )
        steps = F.transform("_s", lambda s: s["h"])
        once = F.when(
            F.size(F.array_distinct(steps)) < F.size(steps), F.raise_error(F.lit("an item has two forecasts for one horizon: choose one model first"))
        ).otherwise(F.col("_s"))
        raw = F.transform(F.slice(once, 1, horizon), lambda s: nonneg(s["y"]))
        padded = F.concat(raw, F.array_repeat(F.element_at(raw, -1), horizon - F.size(raw)))
        return vectors.select("origin_date", "SKU", padded.alias("forecast"))
    wide = [next((t.format(h) for t in WIDE_ALIASES if t.format(h) in cols), None) for h in range(1, horizon + 1)]
    if None in wide:
        raise ValueError("forecasts are neither long (item, horizon, value) nor wide (h1..h8)")
    return df.select(*keys, F.array(*[nonneg(F.col(c).cast("double")) for c in wide]).alias("forecast"))


def latest_snapshot_at_origin(keys: DataFrame, snapshots: DataFrame) -> DataFrame:
    """For each (origin_date, SKU): the latest snapshot dated at or before the origin, or NULLs."""
    snaps = snapshots.select(
        "SKU", F.col("Snapshot_Date").alias("snapshot_date"),
        *[F.col(c).cast("double").alias(c) for c in ("Current_Stock", "On_Order", "Lead_Time_Days", "Safety_Stock", "Reorder_Point")],
    )
    return asof_join(
        keys, snaps, "SKU", "origin_date", "snapshot_date",
        ["Current_Stock", "On_Order", "Lead_Time_Days", "Safety_Stock", "Reorder_Point"],
    )


# --- vector formulas: SQL over the snapshot columns, the forecast vector ``_y`` and its prefix sums ``_cum`` ---

WEEKS = f"sequence(1, {HORIZON})"
# Inbound units counted at horizon ``h``: always; from week 1 when due within 7 days and else from week 2; once
# the lead time has passed; never.
ARRIVALS = {
    "Policy_A": "On_Order",
    "Policy_B1": "CASE WHEN Lead_Time_Days <= 7 OR h >= 2 THEN On_Order ELSE 0D END",
    "Policy_B_LT": "CASE WHEN Lead_Time_Days <= h * 7 THEN On_Order ELSE 0D END",
    "Policy_D": "0D",
}
RUNNING = f"transform({WEEKS}, h -> aggregate(slice(_y, 1, h), 0D, (a, x) -> a + x))"
STOCK_BALANCE = f"transform({WEEKS}, h -> Current_Stock - _cum[h - 1])"
PIPELINE = "(Current_Stock + On_Order)"
LEAD_WEEKS = f"least({HORIZON}, greatest(1, CAST(ceil(Lead_Time_Days / 7) AS INT)))"
LEAD_TIME_DEMAND = (
    f"aggregate(slice(_y, 1, least({HORIZON}, CAST(floor(Lead_Time_Days / 7) AS INT))), 0D, (a, x) -> a + x)"
    f" + CASE WHEN floor(Lead_Time_Days / 7) < {HORIZON} AND Lead_Time_Days / 7 > floor(Lead_Time_Days / 7)"
    " THEN get(_y, CAST(floor(Lead_Time_Days / 7) AS INT)) * (Lead_Time_Days / 7 - floor(Lead_Time_Days / 7)) ELSE 0D END"
)
LATE_SUPPLY = f"(Current_Stock + CASE WHEN Lead_Time_Days <= {LONG_HORIZON_DAYS}D THEN On_Order ELSE 0D END)"
EXCESS_UNITS = f"greatest(0D, {LATE_SUPPLY} - forecast_cum_8w - Safety_Stock)"
STOCKOUT_SCORE = (
    f"CASE WHEN avg_weekly_demand <= 0 THEN 0D WHEN {PIPELINE} <= 0 THEN 1D"
    " WHEN Lead_Time_Days / 7 + Safety_Stock / avg_weekly_demand > 0"
    " THEN greatest(0D, 1D - least(1D, weeks_of_cover / (Lead_Time_Days / 7 + Safety_Stock / avg_weekly_demand))) ELSE 0D END"
)


def inventory_position(policy: str = ON_ORDER_POLICY) -> str:
    return f"transform({WEEKS}, h -> Current_Stock + {ARRIVALS[policy]} - _cum[h - 1])"


def cover(units: str) -> str:
    """Weeks of cover; infinite when stock meets no demand."""
    return (
        f"CASE WHEN avg_weekly_demand > 0 THEN {units} / avg_weekly_demand"
        f" WHEN {units} > 0 THEN double('Infinity') WHEN snapshot_date IS NOT NULL THEN 0D END"
    )


def first_week(predicate: str) -> str:
    """First horizon whose position ``x`` satisfies the predicate, else NULL."""
    return f"CAST(nullif(array_position(transform(ip, x -> {predicate}), true), 0) AS INT)"


def overstock_tier(weeks: str) -> str:
    none, mild, high = OVERSTOCK_LIMITS
    return (
        f"CASE WHEN {weeks} IS NULL THEN 'UNKNOWN' WHEN {weeks} <= {none} THEN 'HEALTHY' WHEN {weeks} <= {mild} THEN 'MONITOR'"
        f" WHEN {weeks} <= {high} THEN 'HIGH' ELSE 'CRITICAL' END"
    )


ACTION_TIER = (
    "CASE WHEN snapshot_date IS NULL THEN 'UNKNOWN'"
    f" WHEN earliest_stockout_week <= {LEAD_WEEKS} THEN 'CRITICAL REORDER'"
    f" WHEN earliest_rp_breach_week <= {LEAD_WEEKS} THEN 'REORDER'"
    " WHEN earliest_rp_breach_week IS NOT NULL THEN 'MONITOR'"
    " WHEN excess_weeks_of_cover > 0 THEN 'OVERSTOCK' ELSE 'HEALTHY' END"
)


def project_positions(df: DataFrame, policy: str = ON_ORDER_POLICY) -> DataFrame:
    """Add forecast totals, the position vector ``ip`` and the stock-only vector ``sb``.

    A missing forecast counts as zero demand only where a snapshot exists.
    """
    return (
        df.selectExpr(
            "*", f"CASE WHEN snapshot_date IS NOT NULL THEN coalesce(forecast, array_repeat(0D, {HORIZON})) ELSE forecast END AS _y"
        )
        .selectExpr("*", f"{RUNNING} AS _cum")
        .selectExpr(
            "*", f"_cum[{HORIZON - 1}] AS forecast_cum_8w", f"_cum[{HORIZON - 1}] / {HORIZON} AS avg_weekly_demand",
            f"{inventory_position(policy)} AS ip", f"{STOCK_BALANCE} AS sb",
        )
    )


def risk_metrics(df: DataFrame) -> DataFrame:
    """Cover, breaches, scores and tiers from the projected vectors; rows without a snapshot stay NULL."""
    return (
        df.selectExpr(
            "*", "snapshot_date IS NOT NULL AS inventory_data_available", "datediff(origin_date, snapshot_date) AS days_since_snapshot",
            f"{cover(PIPELINE)} AS weeks_of_cover", f"{cover('Current_Stock')} AS stock_weeks_of_cover",
            f"CASE WHEN snapshot_date IS NOT NULL THEN {LEAD_TIME_DEMAND} END AS lead_time_demand",
            f"{first_week('x <= 0')} AS earliest_stockout_week", f"{first_week('x < Safety_Stock')} AS earliest_ss_breach_week",
            f"{first_week('x < Reorder_Point')} AS earliest_rp_breach_week",
            f"CASE WHEN snapshot_date IS NOT NULL THEN {EXCESS_UNITS} END AS excess_inventory_units",
        )
        .selectExpr(
            "*", "weeks_of_cover * 7 AS days_of_supply", "stock_weeks_of_cover * 7 AS stock_days_of_supply",
            "CASE WHEN snapshot_date IS NOT NULL THEN earliest_stockout_week IS NOT NULL END AS is_stockout_risk",
            "date_add(origin_date, earliest_stockout_week * 7) AS estimated_stockout_date",
            "CASE WHEN snapshot_date IS NOT NULL THEN earliest_ss_breach_week IS NOT NULL END AS is_safety_stock_breach",
            "CASE WHEN snapshot_date IS NOT NULL THEN earliest_rp_breach_week IS NOT NULL END AS is_reorder_point_breach",
            f"CASE WHEN snapshot_date IS NOT NULL THEN {STOCKOUT_SCORE} END AS stockout_score",
            "CASE WHEN avg_weekly_demand > 0 THEN excess_inventory_units / avg_weekly_demand"
            " WHEN snapshot_date IS NOT NULL THEN 0D END AS excess_weeks_of_cover",
            f"CASE WHEN {PIPELINE} > 0 THEN excess_inventory_units / {PIPELINE} WHEN snapshot_date IS NOT NULL THEN 0D END AS overstock_score",
        )
        .selectExpr("*", f"{overstock_tier('excess_weeks_of_cover')} AS overstock_tier", f"{ACTION_TIER} AS action_tier")
    )


TEXT_VALUES = {
    "stockout_week": "earliest_stockout_week", "rp_week": "earliest_rp_breach_week", "lead": whole("Lead_Time_Days"),
    "rp": whole("Reorder_Point"), "overstock": "overstock_tier", "excess": whole("excess_inventory_units"),
    "excess_weeks": one_decimal("excess_weeks_of_cover"), "cover": one_decimal("weeks_of_cover"), "origin": "origin_date",
}


def risk_text(df: DataFrame) -> DataFrame:
    """One sentence per row, chosen by the action tier."""
    cases = " ".join(f"WHEN {quoted(t)} THEN {fill_template(text, TEXT_VALUES)}" for t, text in RISK_TEXT.items())
    return df.selectExpr("*", f"CASE action_tier {cases} END AS recommendation")


RISK_COLUMNS = (
    "origin_date", "SKU", "inventory_data_available", "snapshot_date", "days_since_snapshot",
    "Current_Stock", "On_Order", "Lead_Time_Days", "Safety_Stock", "Reorder_Point",
    "avg_weekly_demand", "forecast_cum_8w", *[f"ip_h{h}" for h in range(1, HORIZON + 1)], "sb_h1", "sb_h8",
    "weeks_of_cover", "days_of_supply", "stock_weeks_of_cover", "stock_days_of_supply", "lead_time_demand",
    "is_stockout_risk", "earliest_stockout_week", "estimated_stockout_date",
    "is_safety_stock_breach", "earliest_ss_breach_week", "is_reorder_point_breach", "earliest_rp_breach_week",
    "stockout_score", "excess_inventory_units", "excess_weeks_of_cover", "overstock_score",
    "overstock_tier", "action_tier", "recommendation",
    "excess_inventory_value", "inventory_value_at_risk", "capital_at_risk",
    "valuation_basis_confirmed", "arrival_timing_confirmed", "on_order_policy",
    "overstock_threshold_weeks", "overstock_threshold_status",
)


MONEY = ("excess_inventory_value", "inventory_value_at_risk", "capital_at_risk")


def governance_values(policy: str, status: str = THRESHOLD_STATUS) -> dict[str, str]:
    return {
        **{c: "CAST(NULL AS DOUBLE)" for c in MONEY}, "valuation_basis_confirmed": "false", "arrival_timing_confirmed": "false",
        "on_order_policy": quoted(policy), "overstock_threshold_weeks": str(THRESHOLD_WEEKS), "overstock_threshold_status": quoted(status),
    }


def positions(scaffold: DataFrame, vectors: DataFrame, snapshots: DataFrame, policy: str = ON_ORDER_POLICY) -> DataFrame:
    """Scaffold rows with forecast vector, latest snapshot and projected position vectors."""
    keyed = latest_snapshot_at_origin(scaffold, snapshots)
    return project_positions(keyed.join(vectors, ["origin_date", "SKU"], "left"), policy)


def risk_scores(
    scaffold: DataFrame, forecasts: DataFrame, snapshots: DataFrame, policy: str = ON_ORDER_POLICY
) -> DataFrame:
    """One risk row per (origin_date, SKU) of ``scaffold``; items without a snapshot are UNKNOWN."""
    vectors = normalize_forecast_layout(forecasts)
    df = risk_text(risk_metrics(positions(scaffold, vectors, snapshots, policy)))
    vectors_out = {**{f"ip_h{h}": f"ip[{h - 1}]" for h in range(1, HORIZON + 1)}, "sb_h1": "sb[0]", "sb_h8": f"sb[{HORIZON - 1}]"}
    flags = governance_values(policy)
    return df.selectExpr(
        *[f"{vectors_out.get(c) or flags.get(c) or c} AS {c}" if c in vectors_out or c in flags else c for c in RISK_COLUMNS]
    )


def ip_trajectory(risk: DataFrame, sku: str | None = None) -> DataFrame:
    """Long (horizon, position) series of one item or of all items."""
    rows = risk.filter(F.col("SKU") == sku) if sku else risk
    position = F.array(*[F.col(f"ip_h{h}") for h in range(1, HORIZON + 1)])
    return rows.select("origin_date", "SKU", F.posexplode(position).alias("_p", "inventory_position")).select(
        "origin_date", "SKU", (F.col("_p") + 1).alias("horizon"), "inventory_position"
    )


def enforce_monetary_null(df: DataFrame, status: str = "POLICY_RATIFIED") -> DataFrame:
    """Force valuation columns to NULL and set the ratified governance flags."""
    return df.withColumns(
        {
            **{c: F.lit(None).cast("double") for c in MONEY},
            "valuation_basis_confirmed": F.lit(False),
            "overstock_threshold_status": F.lit(status),
        }
    )
