"""Registered queries: sources, sinks, normalisation, filters, joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import decide, forecast, prepare, profile, reports, risk, timegrid
from ..schemas import SALES
from ..sources import fingerprints, sinks, tables
from .context import Context, work_dir
from .registry import query


def _csv_round_trip(c: Context, df: DataFrame, contract) -> DataFrame:
    path = sinks.sink_csv_report(df, f"{work_dir(c.spark)}/{contract.name}")
    return tables.scan_csv_contract(c.spark, path, contract)


@query("scan_csv_contract", 'SELECT *, CASE WHEN Units_Sold > 100 THEN \'extra\' END AS note FROM t_sales')
def _(c):
    extra = c.sales.withColumn("note", F.when(F.col("Units_Sold") > 100, "extra"))
    return _csv_round_trip(c, extra, SALES)


@query("load_sales", "SELECT * FROM t_sales")
def _(c):
    return tables.load_sales(c.spark, sinks.sink_csv_report(c.sales, f"{work_dir(c.spark)}/sales"))


@query("load_sku_master", "SELECT * FROM t_master")
def _(c):
    return tables.load_sku_master(c.spark, sinks.sink_csv_report(c.master, f"{work_dir(c.spark)}/master"))


@query("load_calendar", "SELECT * FROM t_calendar")
def _(c):
    return tables.load_calendar(c.spark, sinks.sink_csv_report(c.calendar, f"{work_dir(c.spark)}/calendar"))


@query("load_inventory", "SELECT * FROM t_inventory")
def _(c):
    return tables.load_inventory(c.spark, sinks.sink_csv_report(c.inventory, f"{work_dir(c.spark)}/inventory"))


@query("scan_parquet", "SELECT l_orderkey, l_suppkey, l_quantity FROM lineitem WHERE l_quantity >= 45")
def _(c):
    df = tables.scan_parquet(c.spark, f"{c.sf_dir}/lineitem.parquet", ["l_orderkey", "l_suppkey", "l_quantity"])
    return df.filter(F.col("l_quantity") >= 45)


@query("sink_parquet", "SELECT * FROM t_sales")
def _(c):
    by_year = c.sales.withColumn("y", F.year("Date"))
    path = sinks.sink_parquet(by_year.hint("rebalance", "y"), f"{work_dir(c.spark)}/sales", ["y"])
    return tables.scan_parquet(c.spark, path, SALES.required)


@query("sink_csv_report", 'SELECT origin_date, sku, recommendation_code, CAST(priority_rank AS VARCHAR) AS priority_rank, recommended_action FROM t_recs')
def _(c):
    rows = c.recs.select("origin_date", "sku", "recommendation_code", "priority_rank", "recommended_action")
    path = sinks.sink_csv_report(rows, f"{work_dir(c.spark)}/recs", ["origin_date", "priority_rank", "sku"])
    return c.spark.read.csv(path, header=True)


@query(
    "sink_json_records",
    """SELECT CAST(origin_date AS VARCHAR) AS origin_date, SKU, action_tier, CASE WHEN isinf(weeks_of_cover) THEN NULL ELSE weeks_of_cover END AS weeks_of_cover,
    CAST(estimated_stockout_date AS VARCHAR) AS estimated_stockout_date FROM t_risk""",
    "weeks_of_cover",
)
def _(c):
    rows = c.risk.select("origin_date", "SKU", "action_tier", "weeks_of_cover", "estimated_stockout_date")
    path = sinks.sink_json_records(rows, f"{work_dir(c.spark)}/risk")
    return c.spark.read.schema(
        "origin_date STRING, SKU STRING, action_tier STRING, weeks_of_cover DOUBLE, estimated_stockout_date STRING"
    ).json(path)


@query(
    "sink_analysis_ready",
    """SELECT 'analysis_ready' AS artifact, count(*) AS n FROM t_panel UNION ALL SELECT 'inventory_quarantine', count(*) FROM t_quarantine
    UNION ALL SELECT 'data_dictionary', 31 UNION ALL SELECT 'lineage', 2""",
)
def _(c):
    lineage = fingerprints.table_fingerprint(c.sales, "sales_daily").unionByName(
        fingerprints.table_fingerprint(c.inventory, "inventory_snapshots")
    )
    paths = sinks.sink_analysis_ready(
        c.panel, c.quarantine, profile.data_dictionary_counts(c.panel), lineage, work_dir(c.spark)
    )
    out = None
    for name, path in paths.items():
        row = c.spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("artifact"), "n")
        out = row if out is None else out.unionByName(row)
    return out


@query(
    "summary_payload",
    """SELECT scope, field, value, count(*) AS n FROM (
      SELECT 'panel' AS scope, 'priority' AS field, priority AS value FROM t_recs UNION ALL SELECT 'panel', 'recommendation_code', recommendation_code FROM t_recs
      UNION ALL SELECT 'latest', 'priority', priority FROM t_last UNION ALL SELECT 'latest', 'recommendation_code', recommendation_code FROM t_last) GROUP BY ALL""",
)
def _(c):
    return decide.summary_payload(c.recs)


@query("file_fingerprint")
def _(c):
    return fingerprints.file_fingerprint(c.spark, c.sf_dir, "*.parquet")


@query("file_tree_fingerprint")
def _(c):
    return fingerprints.tree_fingerprint(c.spark, c.sf_dir, "*.parquet")


@query("assert_unchanged", "SELECT 'sales_daily' AS file, 'changed' AS change")
def _(c):
    before = fingerprints.table_fingerprint(c.sales, "sales_daily").unionByName(fingerprints.table_fingerprint(c.master, "sku_master"))
    touched = c.sales.withColumn("Units_Sold", F.when(F.col("Promotion") == 1, F.col("Units_Sold") + 1).otherwise(F.col("Units_Sold")))
    after = fingerprints.table_fingerprint(touched, "sales_daily").unionByName(fingerprints.table_fingerprint(c.master, "sku_master"))
    return fingerprints.assert_unchanged(before, after)


# --- normalisation, filters --------------------------------------------------------------------------


@query("normalize_sales", "SELECT * FROM t_sales")
def _(c):
    return c.norm_sales


@query("normalize_sku_master", "SELECT * FROM t_nmaster")
def _(c):
    return c.norm_master


@query("normalize_calendar", 'SELECT * EXCLUDE ("date"), "date" AS "Date" FROM t_calendar')
def _(c):
    return c.norm_calendar


@query("normalize_inventory", "SELECT * FROM t_aligned UNION ALL SELECT * FROM t_quarantine")
def _(c):
    return c.aligned.unionByName(c.quarantine)


@query(
    "apply_quality_policies",
    """SELECT 'preserve_and_flag_negative_margin' AS policy, count(*) FILTER (negative_margin_flag) AS observed, CAST(NULL AS BIGINT) AS expected, 'OK' AS status FROM t_nmaster
    UNION ALL SELECT 'quarantine_orphan_skus', count(DISTINCT SKU), 0, 'WARNING' FROM t_quarantine
    UNION ALL SELECT 'quarantine_orphan_rows', count(*), NULL, 'OK' FROM t_quarantine UNION ALL SELECT 'keep_aligned_rows', count(*), NULL, 'OK' FROM t_aligned""",
)
def _(c):
    return prepare.apply_quality_policies(c.norm_master, c.aligned, c.quarantine, {"quarantine_orphan_skus": 0})


@query(
    "price_tier_fixed",
    "SELECT SKU, CASE WHEN Cost_Price < 4000 THEN 'Budget' WHEN Cost_Price < 8000 THEN 'Mid-Range' ELSE 'Premium' END AS Price_Tier FROM t_master",
)
def _(c):
    return c.master.select("SKU", prepare.price_tier_fixed(F.col("Cost_Price")).alias("Price_Tier"))


@query(
    "price_tier_quantile",
    """SELECT SKU, Selling_Price, CASE WHEN Selling_Price <= lo THEN 'Budget' WHEN Selling_Price <= hi THEN 'Mid-Range' ELSE 'Premium' END AS Price_Tier
    FROM t_master CROSS JOIN (SELECT quantile_cont(Selling_Price, 0.33) AS lo, quantile_cont(Selling_Price, 0.66) AS hi FROM t_master) q""",
)
def _(c):
    return prepare.price_tier_quantile(c.master.select("SKU", "Selling_Price"), "Selling_Price")


@query("filter_universe", "SELECT * FROM t_inventory WHERE SKU IN (SELECT SKU FROM t_master)")
def _(c):
    return prepare.filter_universe(c.inventory, c.master)


@query("filter_universe_pattern", "SELECT * FROM t_inventory WHERE regexp_matches(SKU, '^SKU0[0-4][0-9]$|^SKU050$')")
def _(c):
    return prepare.filter_universe_pattern(c.inventory, r"^SKU0[0-4][0-9]$|^SKU050$")


@query(
    "select_snapshot_origin",
    """SELECT coalesce(max(Snapshot_Date) FILTER (Snapshot_Date <= DATE '2000-05-20'), min(Snapshot_Date)) AS origin_date,
    count(DISTINCT Snapshot_Date) AS available_dates FROM t_inventory""",
)
def _(c):
    return timegrid.select_snapshot_origin(c.inventory, "2000-05-20")


@query("select_origin_slice", "SELECT * FROM t_fc WHERE forecast_origin = (SELECT max(forecast_origin) FROM t_fc)", "forecast")
def _(c):
    return forecast.select_origin_slice(c.forecasts)


_WORK = """SELECT priority_rank, sku, product_name, category, recommendation_code, current_stock, on_order, reorder_point, weeks_of_cover,
    recommended_action, required_follow_up FROM t_last WHERE priority_rank = 2"""


@query("filter_worklist", _WORK, "weeks_of_cover")
def _(c):
    return reports.filter_worklist(c.latest_recs, rank=2).orderBy("priority_rank", "sku")


_ROSTER = """SELECT l.sku, product_name, category, l.current_stock, l.on_order, l.lead_time_days, l.safety_stock, l.reorder_point, l.weeks_of_cover,
    stockout_score, l.earliest_stockout_week, priority_rank FROM t_last l LEFT JOIN t_risk r ON l.sku = r.SKU AND l.origin_date = CAST(r.origin_date AS VARCHAR)"""


@query("filter_risk_roster", _ROSTER + " WHERE category IN ('ASIA', 'EUROPE') AND priority_rank IN (1, 2, 3)", "weeks_of_cover stockout_score")
def _(c):
    merged = reports.join_risk_to_recs(c.latest_recs, c._last_risk)
    return reports.filter_risk_roster(merged, ["ASIA", "EUROPE"], [1, 2, 3]).orderBy("priority_rank", F.desc("stockout_score"))


@query("clamp_nonnegative", "SELECT SKU, greatest(Gross_Margin_Per_Unit, 0) AS clamped FROM t_master")
def _(c):
    return c.master.select("SKU", prepare.clamp_nonnegative(F.col("Gross_Margin_Per_Unit")).alias("clamped"))


@query(
    "encode_fixed_categories",
    """SELECT SKU, CAST(CASE Category WHEN 'AFRICA' THEN 0 WHEN 'AMERICA' THEN 1 WHEN 'ASIA' THEN 2 ELSE -1 END AS INTEGER) AS code FROM t_master""",
)
def _(c):
    return c.master.select("SKU", prepare.encode_fixed_categories(F.col("Category"), ["AFRICA", "AMERICA", "ASIA"]).alias("code"))


@query(
    "enforce_monetary_null",
    """SELECT origin_date, SKU, action_tier, excess_inventory_value, inventory_value_at_risk, capital_at_risk, false AS valuation_basis_confirmed,
    'POLICY_RATIFIED' AS overstock_threshold_status FROM t_risk""",
)
def _(c):
    return risk.enforce_monetary_null(
        c.risk.select("origin_date", "SKU", "action_tier", "excess_inventory_value", "inventory_value_at_risk", "capital_at_risk")
    )


@query(
    "normalize_forecast_layout",
    """SELECT origin_date, SKU, h AS horizon, y AS value FROM (
      SELECT forecast_origin AS origin_date, SKU, horizon AS h, greatest(forecast, 0) AS y FROM t_fc WHERE model = 'ses')
    UNION ALL SELECT forecast_origin_date, SKU, h, CASE h WHEN 1 THEN target_h1 WHEN 2 THEN target_h2 WHEN 3 THEN target_h3 WHEN 4 THEN target_h4
      WHEN 5 THEN target_h5 WHEN 6 THEN target_h6 WHEN 7 THEN target_h7 ELSE target_h8 END
    FROM t_features CROSS JOIN (SELECT CAST(unnest(range(1, 9)) AS INTEGER) AS h) hs
    WHERE forecast_origin_date = (SELECT min(forecast_origin) FROM t_origins)""",
    "value",
)
def _(c):
    from ..operators.features import targets_multi_horizon

    long = risk.normalize_forecast_layout(forecast.baseline_forecasts(c.weekly, c.origins, ["ses"]).select("SKU", "forecast_origin", "horizon", "forecast"))
    first = c.origins.agg(F.min("forecast_origin")).scalar()
    wide_rows = targets_multi_horizon(c.weekly).filter(F.col("week_start") == first).withColumnRenamed("week_start", "origin_date")
    wide = risk.normalize_forecast_layout(wide_rows.drop("Units_Sold"))
    both = long.unionByName(wide)
    return both.select("origin_date", "SKU", F.posexplode("forecast").alias("p", "value")).select(
        "origin_date", "SKU", (F.col("p") + 1).alias("horizon"), "value"
    )


# --- joins -------------------------------------------------------------------------------------------


@query("join_sales_master", "SELECT s.*, m.* EXCLUDE (SKU) FROM t_sales s LEFT JOIN t_nmaster m ON s.SKU = m.SKU")
def _(c):
    return prepare.join_sales_master(c.sales, c.norm_master)


@query("join_calendar", 'SELECT s.*, c.* EXCLUDE ("date") FROM t_sales s LEFT JOIN t_calendar c ON s."Date" = c."date"')
def _(c):
    return prepare.join_calendar(c.sales, c.norm_calendar)


@query(
    "join_inventory_exact",
    """SELECT s.*, a.Current_Stock, a.On_Order, a.Lead_Time_Days, a.Safety_Stock, a.Reorder_Point, a.Inventory_Value, a.SKU IS NOT NULL AS has_inventory_snapshot
    FROM t_sales s LEFT JOIN t_aligned a ON s.SKU = a.SKU AND s."Date" = a."Date\"""",
)
def _(c):
    return prepare.join_inventory_exact(c.sales, c.aligned)


@query("integrate_daily_panel", "SELECT * FROM t_panel")
def _(c):
    return c.panel


@query(
    "asof_snapshot_to_week",
    """SELECT w.SKU, w.week_start, w.Units_Sold, a.snap AS snapshot_date, a.Current_Stock, a.On_Order FROM t_weekly w
    ASOF LEFT JOIN (SELECT SKU AS k2, "Date" AS snap, Current_Stock, On_Order FROM t_aligned) a ON w.SKU = a.k2 AND w.week_start >= a.snap""",
)
def _(c):
    return timegrid.asof_join(
        c.weekly.select("SKU", "week_start", "Units_Sold"), c.snapshots, "SKU", "week_start", "snapshot_date", ["Current_Stock", "On_Order"]
    )


@query(
    "latest_snapshot_at_origin",
    "SELECT origin_date, SKU, snap AS snapshot_date, stock AS Current_Stock, oo AS On_Order, lt AS Lead_Time_Days, ss AS Safety_Stock, rp AS Reorder_Point FROM t_pos",
)
def _(c):
    return risk.latest_snapshot_at_origin(c.scaffold, c.origin_snapshots)


@query("scaffold_origin_sku", "SELECT m.SKU, o.forecast_origin AS origin_date FROM t_nmaster m CROSS JOIN t_origins o")
def _(c):
    return c.scaffold


@query("join_forecast_actuals", "SELECT SKU, target_week, forecast_origin, horizon, model, forecast, actual FROM t_fc", "forecast")
def _(c):
    return forecast.join_forecast_actuals(c.forecasts.drop("actual"), c.weekly)


@query(
    "join_sku_metadata",
    "SELECT f.SKU, forecast_origin, horizon, forecast, Product_Name, Category, Subcategory FROM t_sn f LEFT JOIN t_master m ON f.SKU = m.SKU",
    "forecast",
)
def _(c):
    return prepare.join_sku_metadata(c.seasonal.select("SKU", "forecast_origin", "horizon", "forecast"), c.master)


@query(
    "join_category_median",
    "SELECT SKU, Category, Selling_Price, category_median_price, price_vs_category_median_ratio FROM t_price",
    "category_median_price price_vs_category_median_ratio",
)
def _(c):
    return prepare.join_category_median(c.norm_master.select("SKU", "Category", "Selling_Price"))


@query("join_static_params", "SELECT w.*, s.* EXCLUDE (SKU) FROM (SELECT SKU, week_start FROM t_weekly) w LEFT JOIN t_static s ON w.SKU = s.SKU")
def _(c):
    return timegrid.join_static_params(c.weekly.select("SKU", "week_start"), c.snapshots)


@query(
    "join_risk_to_recs",
    """SELECT l.origin_date, l.sku, l.priority_rank, r.stockout_score, r.overstock_tier, r.action_tier, r.excess_inventory_units FROM t_recs l
    LEFT JOIN t_risk r ON l.sku = r.SKU AND l.origin_date = CAST(r.origin_date AS VARCHAR)""",
    "stockout_score excess_inventory_units",
)
def _(c):
    return reports.join_risk_to_recs(c.recs.select("origin_date", "sku", "priority_rank"), c.risk)


@query("semi_eval_origins", "SELECT * FROM t_fc WHERE forecast_origin IN (SELECT forecast_origin FROM t_origins ORDER BY 1 OFFSET 3)", "forecast")
def _(c):
    # The origins are at most twelve rows, so the bounded sort stays small.
    dates = c.origins.agg(F.sort_array(F.collect_set("forecast_origin")).alias("o"))
    later = dates.select(F.explode(F.slice("o", 4, 99)).alias("forecast_origin"))
    return forecast.semi_eval_origins(c.forecasts, later)


@query("anti_orphans", "SELECT DISTINCT SKU FROM t_inventory WHERE SKU NOT IN (SELECT SKU FROM t_master)")
def _(c):
    return prepare.anti_orphans(c.inventory, c.master)


@query("distinct_rows", "SELECT DISTINCT SKU, Lead_Time_Days FROM t_inventory")
def _(c):
    return prepare.distinct_rows(c.inventory.select("SKU", "Lead_Time_Days"))


@query(
    "dedupe_by_key",
    'SELECT SKU, min("Date") AS "Date", arg_min(Units_Sold, "Date") AS Units_Sold FROM t_sales GROUP BY SKU',
)
def _(c):
    return prepare.dedupe_by_key(c.sales.select("SKU", "Date", "Units_Sold"), ["SKU"], ["Date"])


@query("except_keys", "SELECT DISTINCT SKU FROM t_inventory EXCEPT SELECT SKU FROM t_sales")
def _(c):
    return prepare.except_keys(c.inventory, c.sales, "SKU")


@query("sort_deterministic", 'SELECT "Date", SKU, Units_Sold FROM t_sales')
def _(c):
    return prepare.sort_deterministic(c.sales.select("Date", "SKU", "Units_Sold"), "Date", "SKU")


