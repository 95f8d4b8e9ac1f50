"""Registered queries: inventory risk, decisions, fleet tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import decide, reports, risk
from ..operators.forecast import MODELS
from . import pipeline
from .context import work_dir
from .registry import query

_KEY = "origin_date, SKU"
_IPS = ", ".join(f"ip[{h}] AS ip_h{h}" for h in range(1, 9))
_SBS = ", ".join(f"sb[{h}] AS sb_h{h}" for h in range(1, 9))
_IP_FLOATS = " ".join(f"ip_h{h}" for h in range(1, 9))


def _vector(name: str, out: str):
    return [F.get(name, h - 1).alias(f"{out}_h{h}") for h in range(1, 9)]


@query("inventory_position", f"SELECT {_KEY}, {_IPS} FROM t_pos", _IP_FLOATS)
def _(c):
    return c.positions.select("origin_date", "SKU", *_vector("ip", "ip"))


@query("stock_balance", f"SELECT {_KEY}, sb[1] AS sb_h1, sb[8] AS sb_h8 FROM t_pos", "sb_h1 sb_h8")
def _(c):
    return c.positions.select("origin_date", "SKU", F.get("sb", 0).alias("sb_h1"), F.get("sb", 7).alias("sb_h8"))


@query("cover_split", f"SELECT {_KEY}, {_SBS} FROM t_pos", " ".join(f"sb_h{h}" for h in range(1, 9)))
def _(c):
    return c.positions.select("origin_date", "SKU", *_vector("sb", "sb"))


def _risk_columns(name: str, columns: str, floats: str = "") -> None:
    cols = columns.split()

    @query(name, f"SELECT {_KEY}, {', '.join(cols)} FROM t_risk", floats)
    def _(c):
        return risk.risk_metrics(c.positions).select("origin_date", "SKU", *cols)


_risk_columns(
    "weeks_of_cover", "weeks_of_cover days_of_supply stock_weeks_of_cover stock_days_of_supply",
    "weeks_of_cover days_of_supply stock_weeks_of_cover stock_days_of_supply",
)
_risk_columns("lead_time_demand", "Lead_Time_Days lead_time_demand", "lead_time_demand")
_risk_columns("stockout_breach", "is_stockout_risk earliest_stockout_week")
_risk_columns("safety_stock_breach", "is_safety_stock_breach earliest_ss_breach_week")
_risk_columns("reorder_point_breach", "is_reorder_point_breach earliest_rp_breach_week")
_risk_columns("stockout_date", "estimated_stockout_date")
_risk_columns("stockout_score", "stockout_score", "stockout_score")
_risk_columns("excess_units", "excess_inventory_units excess_weeks_of_cover overstock_score", "excess_inventory_units excess_weeks_of_cover overstock_score")
_risk_columns("overstock_tier", "overstock_tier")
_risk_columns("action_tier", "action_tier")

_RISK_FLOATS = (
    f"avg_weekly_demand forecast_cum_8w {_IP_FLOATS} sb_h1 sb_h8 weeks_of_cover days_of_supply stock_weeks_of_cover stock_days_of_supply"
    " lead_time_demand stockout_score excess_inventory_units excess_weeks_of_cover overstock_score"
)


@query("risk_text", f"SELECT {_KEY}, action_tier, recommendation FROM t_risk")
def _(c):
    return c.risk.select("origin_date", "SKU", "action_tier", "recommendation")


@query("risk_scores", "SELECT * FROM t_risk", _RISK_FLOATS)
def _(c):
    return c.risk


@query("risk_panel", "SELECT r.*, m.Product_Name, m.Category, m.Subcategory FROM t_risk r LEFT JOIN t_nmaster m ON r.SKU = m.SKU", _RISK_FLOATS)
def _(c):
    """Scores of all origins in one plan, with item names."""
    return c.risk.join(c.norm_master.select("SKU", "Product_Name", "Category", "Subcategory"), "SKU", "left")


@query("union_panel_origins", "SELECT origin_date, action_tier, count(*) AS n FROM t_risk GROUP BY 1, 2")
def _(c):
    return c.risk.groupBy("origin_date", "action_tier").agg(F.count(F.lit(1)).alias("n"))


@query("risk_report", "SELECT * FROM t_risk WHERE origin_date = (SELECT max(origin_date) FROM t_risk)", _RISK_FLOATS)
def _(c):
    return c._last_risk


@query(
    "ip_trajectory",
    f"SELECT {_KEY}, h AS horizon, ip[h] AS inventory_position FROM t_pos CROSS JOIN (SELECT CAST(unnest(range(1, 9)) AS INTEGER) AS h) hs",
    "inventory_position",
)
def _(c):
    return risk.ip_trajectory(c.risk)


# --- decisions ---------------------------------------------------------------------------------------


@query("confidence_status", "SELECT origin_date, sku, confidence_status FROM t_recs")
def _(c):
    return risk.risk_metrics(c.positions).selectExpr("CAST(origin_date AS STRING) AS origin_date", "SKU AS sku", f"{decide.CONFIDENCE} AS confidence_status")


@query("recommendation_code", "SELECT origin_date, sku, recommendation_code, recommendation_title, priority, priority_rank, triggering_risk, required_follow_up FROM t_recs")
def _(c):
    return c.recs.select("origin_date", "sku", "recommendation_code", "recommendation_title", "priority", "priority_rank", "triggering_risk", "required_follow_up")


@query("emergency_qty", f"SELECT {_KEY}, CASE WHEN kase = 'expedite_new' THEN emergency END AS emergency_qty FROM t_qty")
def _(c):
    return decide.decision_quantities(c.risk).select("origin_date", "SKU", "emergency_qty")


@query("reorder_qty", f"SELECT {_KEY}, CASE WHEN tier = 'REORDER' THEN orderq END AS reorder_qty FROM t_qty")
def _(c):
    return decide.decision_quantities(c.risk).select("origin_date", "SKU", "reorder_qty")


@query("order_by_week", f"SELECT {_KEY}, CAST(CASE WHEN tier = 'MONITOR' THEN order_by END AS INTEGER) AS order_by_week FROM t_qty")
def _(c):
    return decide.decision_quantities(c.risk).select("origin_date", "SKU", "order_by_week")


@query("recommendation_text", "SELECT origin_date, sku, recommended_action, rationale FROM t_recs")
def _(c):
    return c.recs.select("origin_date", "sku", "recommended_action", "rationale")


_REC_FLOATS = "avg_weekly_demand weeks_of_cover excess_weeks_of_cover"


@query("recommendations", "SELECT * FROM t_recs", _REC_FLOATS)
def _(c):
    return c.recs


@query("recommendation_records", "SELECT origin_date, sku, priority_rank, weeks_of_cover, on_order_policy FROM t_recs", "weeks_of_cover")
def _(c):
    """Nested record form, read back field by field."""
    return decide.nested_records(c.recs).select(
        "origin_date", "sku", "priority_rank", F.col("supporting_metrics.weeks_of_cover").alias("weeks_of_cover"),
        F.col("governance.on_order_policy").alias("on_order_policy"),
    )


@query("recommendations_batch", "SELECT 'panel' AS part, * FROM t_recs UNION ALL SELECT 'latest', * FROM t_last", _REC_FLOATS)
def _(c):
    """Panel written once; the latest slice is read back from it."""
    from ..operators.forecast import latest_origin_rows

    path = f"{work_dir(c.spark)}/recommendations"
    c.recs.write.mode("overwrite").parquet(path)
    panel = c.spark.read.parquet(path)
    return panel.select(F.lit("panel").alias("part"), "*").unionByName(
        latest_origin_rows(panel, "origin_date").select(F.lit("latest").alias("part"), "*")
    )


def _baseline_run(c):
    """The run with the five baselines as candidates, whose every value has an SQL form."""
    return pipeline.production_run(c, work_dir(c.spark), candidates=MODELS)


@query("production_run", "SELECT * REPLACE ('POLICY_RATIFIED' AS overstock_threshold_status) FROM t_hlast", _REC_FLOATS)
def _(c):
    return _baseline_run(c).recommendations


@query(
    "production_architecture",
    "SELECT horizon, selected_model, validation_micro_wape, benchmark_wape FROM t_archat",
    "validation_micro_wape benchmark_wape",
)
def _(c):
    return _baseline_run(c).architecture.select("horizon", "selected_model", "validation_micro_wape", "benchmark_wape")


_LAST = "(SELECT max(forecast_origin) FROM t_origins)"


@query(
    "production_manifest",
    f"""SELECT 'sales' AS stage, count(*) AS n_rows FROM t_sales UNION ALL SELECT 'master', count(*) FROM t_master
    UNION ALL SELECT 'inventory', count(*) FROM t_inventory
    UNION ALL SELECT 'quarantine', count(*) FROM t_quarantine WHERE "Date" = (SELECT max("Snapshot_Date") FROM t_inventory WHERE "Snapshot_Date" <= {_LAST})
    UNION ALL SELECT 'candidates', count(*) FROM t_fc WHERE forecast_origin <= {_LAST} UNION ALL SELECT 'architecture', 8
    UNION ALL SELECT s.stage, count(*) * s.each FROM t_master, (VALUES ('forecasts', 8), ('risk', 1), ('recommendations', 1), ('governed', 1), ('report', 1)) AS s(stage, each)
    GROUP BY s.stage, s.each""",
)
def _(c):
    return _baseline_run(c).manifest.where("stage <> 'checks'").select("stage", "n_rows")


@query("production_hybrid")
def _(c):
    """The run with the trained linear models among the candidates."""
    return pipeline.production_run(c, work_dir(c.spark)).recommendations


@query(
    "production_hybrid_rows",
    f"""SELECT m.SKU, h.horizon, o.forecast_origin, o.forecast_origin + 7 * h.horizon AS target_week, CAST(a.Units_Sold AS DOUBLE) AS actual, TRUE AS sound
    FROM t_nmaster AS m, (SELECT {_LAST} AS forecast_origin) AS o, (SELECT CAST(unnest(range(1, 9)) AS INTEGER) AS horizon) AS h
    LEFT JOIN t_weekly AS a ON a.SKU = m.SKU AND a.week_start = o.forecast_origin + 7 * h.horizon""",
    "actual",
)
def _(c):
    """What that run must have forecast: each item and horizon once, by the model of its horizon, never below zero."""
    run = pipeline.production_run(c, work_dir(c.spark))
    chosen = run.architecture.select("horizon", "selected_model")
    sound = (F.col("forecast") >= 0) & ~F.isnan("forecast") & (F.col("model") == F.col("selected_model"))
    rows = run.forecasts.join(chosen, "horizon")
    return rows.select("SKU", "horizon", "forecast_origin", "target_week", "actual", F.coalesce(sound, F.lit(False)).alias("sound"))


@query(
    "value_distribution",
    "SELECT 'priority' AS field, priority AS value, count(*) AS n FROM t_recs GROUP BY 2 UNION ALL SELECT 'recommendation_code', recommendation_code, count(*) FROM t_recs GROUP BY 2",
)
def _(c):
    return decide.value_distribution(c.recs, ["priority", "recommendation_code"])


@query(
    "sku_dossier",
    "SELECT l.origin_date, sku, product_name, category, recommendation_code, priority_rank, weeks_of_cover, "
    + ", ".join(f"(SELECT max(forecast) FROM t_sn s WHERE s.SKU = l.sku AND horizon = {h} AND CAST(s.forecast_origin AS VARCHAR) = l.origin_date) AS forecast_h{h}" for h in range(1, 9))
    + " FROM t_last l",
    "weeks_of_cover " + " ".join(f"forecast_h{h}" for h in range(1, 9)),
)
def _(c):
    return reports.sku_dossier(c.latest_recs, c.last_seasonal)


@query(
    "inventory_status",
    """SELECT l.sku, product_name, category, l.current_stock, l.on_order, l.lead_time_days, l.safety_stock, l.reorder_point, l.weeks_of_cover,
    r.stockout_score AS stockout_risk_score, r.action_tier FROM t_last l LEFT JOIN t_risk r ON l.sku = r.SKU AND l.origin_date = CAST(r.origin_date AS VARCHAR)""",
    "weeks_of_cover stockout_risk_score",
)
def _(c):
    return reports.inventory_status(c.latest_recs, c._last_risk)


@query(
    "risk_status",
    """SELECT SKU AS sku, origin_date, CASE WHEN isinf(weeks_of_cover) THEN 0 ELSE weeks_of_cover END AS weeks_of_cover,
    CASE WHEN isinf(days_of_supply) THEN 0 ELSE days_of_supply END AS days_of_supply, stockout_score, overstock_score, overstock_tier, action_tier,
    estimated_stockout_date, excess_inventory_value FROM t_risk WHERE origin_date = (SELECT max(origin_date) FROM t_risk)""",
    "weeks_of_cover days_of_supply stockout_score overstock_score",
)
def _(c):
    return reports.risk_status(c._last_risk)


@query(
    "recommendation_status",
    """SELECT sku, product_name, category, subcategory, recommendation_code, recommendation_title, priority, priority_rank, triggering_risk, confidence_status,
    required_follow_up FROM t_last""",
)
def _(c):
    return reports.recommendation_status(c.latest_recs)


# --- fleet tables ------------------------------------------------------------------------------------


@query(
    "category_posture",
    """SELECT category, count(*) AS total_skus, count(*) FILTER (priority_rank = 1) AS p1_critical, count(*) FILTER (priority_rank = 2) AS p2_reorder,
    count(*) FILTER (priority_rank = 4) AS p4_overstock, avg(weeks_of_cover) AS avg_cover FROM t_last GROUP BY 1""",
    "avg_cover",
)
def _(c):
    return reports.category_posture(c.latest_recs)


@query(
    "fleet_scorecard",
    """SELECT count(*) AS total_skus, count(*) FILTER (priority_rank = 1) AS p1_count, count(*) FILTER (priority_rank = 2) AS p2_count,
    count(*) FILTER (priority_rank = 3) AS p3_count, count(*) FILTER (priority_rank = 4) AS p4_count, count(*) FILTER (priority_rank = 5) AS p5_count,
    count(*) FILTER (priority_rank IN (1, 2)) / count(*) * 100 AS stockout_pct, count(*) FILTER (priority_rank = 4) / count(*) * 100 AS overstock_pct,
    count(*) FILTER (priority_rank = 5) / count(*) * 100 AS balanced_pct, avg(weeks_of_cover) AS mean_cover, median(weeks_of_cover) AS median_cover FROM t_last""",
    "stockout_pct overstock_pct balanced_pct mean_cover median_cover",
)
def _(c):
    return reports.fleet_scorecard(c.latest_recs)


@query("breach_timing", "SELECT earliest_stockout_week, count(*) AS sku_count FROM t_last WHERE earliest_stockout_week IS NOT NULL GROUP BY 1")
def _(c):
    return reports.breach_timing(c.latest_recs)


@query("category_forward_demand", "SELECT category, sum(avg_weekly_demand) * 8 AS projected_8w_units FROM t_last GROUP BY 1", "projected_8w_units")
def _(c):
    return reports.category_forward_demand(c.latest_recs)


@query("inventory_totals", "SELECT count(*) AS n_skus, sum(current_stock) AS total_current_stock, sum(on_order) AS total_on_order FROM t_last", "total_current_stock total_on_order")
def _(c):
    return reports.inventory_totals(c.latest_recs)
