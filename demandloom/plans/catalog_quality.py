"""Registered queries: data-quality checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as feat
from ..operators import forecast, profile, quality, risk, timegrid
from ..schemas import SALES
from ..sources import sinks
from ..sources.checkpoints import shuffles_let_go
from .context import work_dir
from .registry import query


def _row(dataset: str, check: str, n: str, severity: str = "ERROR", fires: str = "FAIL") -> str:
    """SELECT list of one result row whose affected-row count is the expression ``n``."""
    sev = "'INFO'" if severity == "INFO" else f"CASE WHEN n > 0 THEN '{severity}' ELSE 'INFO' END"
    return (
        f"SELECT '{dataset}' AS dataset, '{check}' AS check_name, CASE WHEN n > 0 THEN '{fires}' ELSE 'PASS' END AS status, "
        f"{sev} AS severity, CAST(n AS BIGINT) AS affected_rows FROM ({n})"
    )


def _count(table: str, condition: str) -> str:
    return f"SELECT count(*) FILTER ({condition}) AS n FROM {table}"


def _all(*rows: str) -> str:
    return " UNION ALL ".join(rows)


def _dups(table: str, key: str) -> str:
    return f"SELECT coalesce(sum(k), 0) AS n FROM (SELECT count(*) AS k FROM {table} GROUP BY {key} HAVING count(*) > 1)"


@query("dq_required_columns", _row("sales_daily", "required_columns", "SELECT 0 AS n", "CRITICAL"))
def _(c):
    return quality.required_columns(c.sales, "sales_daily", SALES.required)


@query(
    "dq_pk_unique",
    _all(
        _row("lineitem", "pk_unique", _dups("lineitem", "l_orderkey, l_linenumber"), "CRITICAL"),
        _row("sales_daily", "pk_unique", _dups("t_sales", '"Date", SKU'), "CRITICAL"),
    ),
)
def _(c):
    return quality.pk_unique(c.lineitem, "lineitem", ["l_orderkey", "l_linenumber"]).unionByName(
        quality.pk_unique(c.sales, "sales_daily", ["Date", "SKU"])
    )


@query(
    "dq_pk_samples",
    """SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1
    ORDER BY copies DESC, l_orderkey, l_linenumber LIMIT 5""",
)
def _(c):
    return quality.duplicate_samples(c.lineitem, ["l_orderkey", "l_linenumber"])


@query("dq_no_null_dates", _row("panel", "no_null_dates_Launch_Date", _count("t_panel", "Launch_Date IS NULL"), "CRITICAL"))
def _(c):
    return quality.run_checks(c.panel, "panel", quality.no_null_dates("Launch_Date"))


@query(
    "dq_no_nulls",
    _all(
        _row("panel", "no_nulls_Category", _count("t_panel", "Category IS NULL")),
        _row("panel", "no_nulls_Current_Stock", _count("t_panel", "Current_Stock IS NULL")),
    ),
)
def _(c):
    return quality.run_checks(c.panel, "panel", quality.not_null("Category", "Current_Stock"))


@query(
    "dq_non_negative",
    _all(
        _row("supplier", "non_negative_s_acctbal", _count("supplier", "s_acctbal < 0")),
        _row("supplier", "non_negative_s_suppkey", _count("supplier", "s_suppkey < 0")),
    ),
)
def _(c):
    return quality.run_checks(c.supplier, "supplier", quality.non_negative("s_acctbal", "s_suppkey"))


@query("dq_positive", _row("inventory_snapshots", "positive_On_Order", _count("t_inventory", "On_Order <= 0")))
def _(c):
    return quality.run_checks(c.inventory, "inventory_snapshots", quality.positive("On_Order"))


@query(
    "dq_allowed_values",
    _all(
        _row("calendar", "allowed_values_holiday", _count("t_calendar", "holiday IS NULL OR holiday NOT IN ('Christmas', 'New Year')")),
        _row("calendar", "allowed_values_is_weekend", _count("t_calendar", "is_weekend IS NULL OR is_weekend NOT IN (0, 1)")),
    ),
)
def _(c):
    checks = [quality.allowed_values("holiday", ["Christmas", "New Year"]), quality.allowed_values("is_weekend", [0, 1])]
    return quality.run_checks(c.calendar, "calendar", checks)


@query("dq_sku_pattern", _row("inventory_snapshots", "pattern_SKU", _count("t_inventory", "NOT regexp_matches(SKU, '^SKU\\d{3}$')")))
def _(c):
    return quality.run_checks(c.inventory, "inventory_snapshots", [quality.sku_pattern(pattern=r"^SKU\d{3}$")])


@query("dq_revenue_consistency", _row("sales_daily", "revenue_consistency", _count("t_sales", "abs(Revenue - Units_Sold * Price) > 0.01")))
def _(c):
    return quality.run_checks(c.sales, "sales_daily", [quality.revenue_consistency()])


@query("dq_margin_consistency", _row("sku_master", "margin_consistency", _count("t_master", "abs(Gross_Margin_Per_Unit - (Selling_Price - Cost_Price)) > 0.02")))
def _(c):
    return quality.run_checks(c.master, "sku_master", [quality.margin_consistency()])


@query("dq_negative_margin", _row("sku_master", "negative_margin", _count("t_master", "Cost_Price > Selling_Price"), "WARNING", "WARNING"))
def _(c):
    return quality.run_checks(c.master, "sku_master", [quality.negative_margin()])


@query(
    "dq_value_ranges",
    _all(
        _row("calendar", "range_year", _count("t_calendar", '"year" NOT BETWEEN 1996 AND 2000')),
        _row("calendar", "range_month", _count("t_calendar", '"month" NOT BETWEEN 1 AND 12')),
        _row("calendar", "range_week", _count("t_calendar", '"week" NOT BETWEEN 1 AND 53')),
    ),
)
def _(c):
    checks = [quality.value_range("year", 1996, 2000), quality.value_range("month", 1, 12), quality.value_range("week", 1, 53)]
    return quality.run_checks(c.calendar, "calendar", checks)


_HOLIDAY = _all(
    _row("calendar", "holiday_null_structural", _count("t_calendar", "holiday IS NULL AND is_holiday = 0"), "INFO", "PASS"),
    _row("calendar", "holiday_null_on_holiday", _count("t_calendar", "holiday IS NULL AND is_holiday = 1")),
)


@query("dq_holiday_nulls", _HOLIDAY)
def _(c):
    return quality.run_checks(c.calendar, "calendar", quality.holiday_nulls())


@query("dq_event_nulls", _row("calendar", "promotion_event_null_structural", _count("t_calendar", "promotion_event IS NULL"), "INFO", "PASS"))
def _(c):
    return quality.run_checks(c.calendar, "calendar", [quality.event_nulls()])


@query("dq_orphan_skus", 'SELECT SKU, count(*) AS "rows" FROM t_inventory WHERE SKU NOT IN (SELECT SKU FROM t_master) GROUP BY SKU')
def _(c):
    return quality.orphan_skus(c.inventory, c.master)


_CROSS = _all(
    _row("cross", "sales_sku_in_master", _count("t_sales", "SKU NOT IN (SELECT SKU FROM t_master)"), "CRITICAL"),
    _row("cross", "sales_date_in_calendar", _count("t_sales", '"Date" NOT IN (SELECT "date" FROM t_calendar)'), "CRITICAL"),
    _row("cross", "inventory_sku_in_master", _count("t_inventory", "SKU NOT IN (SELECT SKU FROM t_master)"), "WARNING", "WARNING"),
    _row("cross", "inventory_date_in_calendar", _count("t_inventory", 'Snapshot_Date NOT IN (SELECT "date" FROM t_calendar)'), "CRITICAL"),
)


@query("dq_ref_integrity", _CROSS)
def _(c):
    a, b, d, e = quality.cross_checks(c.sales, c.master, c.calendar, c.inventory)
    return a.unionByName(b).unionByName(d).unionByName(e)


_COMPLETE = _row("sales_daily", "panel_complete", 'SELECT count(DISTINCT SKU) * count(DISTINCT "Date") - count(*) AS n FROM t_sales')


@query("dq_panel_complete", _COMPLETE)
def _(c):
    return quality.panel_complete(c.sales, "SKU", "Date", "sales_daily")


def _nulls(dataset: str, table: str, *cols: str) -> list[str]:
    return [_row(dataset, f"no_nulls_{x}", _count(table, f'"{x}" IS NULL')) for x in cols]


def _dates(dataset: str, table: str, col: str) -> str:
    return _row(dataset, f"no_null_dates_{col}", _count(table, f'"{col}" IS NULL'), "CRITICAL")


def _negatives(dataset: str, table: str, *cols: str) -> list[str]:
    return [_row(dataset, f"non_negative_{x}", _count(table, f"{x} < 0")) for x in cols]


_STOCK = ("Current_Stock", "On_Order", "Safety_Stock", "Reorder_Point", "Inventory_Value")
_PATTERN = "NOT regexp_matches(SKU, '^SKU\\d+$')"
_SUITE = _all(
    _dates("sales_daily", "t_sales", "Date"), *_nulls("sales_daily", "t_sales", "SKU", "Units_Sold", "Revenue", "Price", "Promotion"),
    *_negatives("sales_daily", "t_sales", "Units_Sold", "Revenue"), _row("sales_daily", "positive_Price", _count("t_sales", "Price <= 0")),
    _row("sales_daily", "allowed_values_Promotion", _count("t_sales", "Promotion NOT IN (0, 1)")),
    _row("sales_daily", "pattern_SKU", _count("t_sales", _PATTERN)),
    _row("sales_daily", "revenue_consistency", _count("t_sales", "abs(Revenue - Units_Sold * Price) > 0.01")),
    _row("sales_daily", "pk_unique", _dups("t_sales", '"Date", SKU'), "CRITICAL"),
    *_nulls("sku_master", "t_master", "SKU", "Product_Name", "Category", "Subcategory", "Cost_Price", "Selling_Price"),
    _dates("sku_master", "t_master", "Launch_Date"),
    _row("sku_master", "positive_Cost_Price", _count("t_master", "Cost_Price <= 0")),
    _row("sku_master", "positive_Selling_Price", _count("t_master", "Selling_Price <= 0")),
    _row("sku_master", "pattern_SKU", _count("t_master", _PATTERN)),
    _row("sku_master", "margin_consistency", _count("t_master", "abs(Gross_Margin_Per_Unit - (Selling_Price - Cost_Price)) > 0.02")),
    _row("sku_master", "negative_margin", _count("t_master", "Cost_Price > Selling_Price"), "WARNING", "WARNING"),
    _row("sku_master", "pk_unique", _dups("t_master", "SKU"), "CRITICAL"),
    _dates("calendar", "t_calendar", "date"), *_nulls("calendar", "t_calendar", "year", "month", "week", "quarter", "day_of_week", "season"),
    _row("calendar", "range_year", _count("t_calendar", '"year" NOT BETWEEN 1995 AND 2001')),
    _row("calendar", "range_month", _count("t_calendar", '"month" NOT BETWEEN 1 AND 12')),
    _row("calendar", "range_week", _count("t_calendar", '"week" NOT BETWEEN 1 AND 53')),
    _row("calendar", "allowed_values_is_weekend", _count("t_calendar", "is_weekend NOT IN (0, 1)")),
    _row("calendar", "allowed_values_is_holiday", _count("t_calendar", "is_holiday NOT IN (0, 1)")),
    _HOLIDAY, _row("calendar", "promotion_event_null_structural", _count("t_calendar", "promotion_event IS NULL"), "INFO", "PASS"),
    _row("calendar", "pk_unique", _dups("t_calendar", '"date"'), "CRITICAL"),
    _dates("inventory_snapshots", "t_inventory", "Snapshot_Date"),
    *_nulls("inventory_snapshots", "t_inventory", "SKU", *_STOCK, "Lead_Time_Days"),
    *_negatives("inventory_snapshots", "t_inventory", *_STOCK),
    _row("inventory_snapshots", "positive_Lead_Time_Days", _count("t_inventory", "Lead_Time_Days <= 0")),
    _row("inventory_snapshots", "pattern_SKU", _count("t_inventory", _PATTERN)),
    _row("inventory_snapshots", "pk_unique", _dups("t_inventory", "Snapshot_Date, SKU"), "CRITICAL"),
    _CROSS, _COMPLETE,
)


def _suite(c):
    """The four inputs are views here, so they are stored before some thirty checks read them."""
    return quality.quality_suite(c.stored(c.sales), c.stored(c.master), c.stored(c.calendar), c.stored(c.inventory), (1995, 2001))


@query("dq_suite", _SUITE)
def _(c):
    return _suite(c)


@query("dq_suite_counts", f"SELECT status, count(*) AS checks FROM ({_SUITE}) GROUP BY status")
def _(c):
    return quality.status_counts(_suite(c))


@query("dq_report", f"SELECT dataset, check_name, status, severity, CAST(affected_rows AS VARCHAR) AS affected_rows FROM ({_SUITE})")
def _(c):
    path = sinks.sink_csv_report(_suite(c), f"{work_dir(c.spark)}/dq", ["status", "dataset", "check_name"])
    return c.spark.read.csv(path, header=True)


def _inv(check: str, n: str) -> str:
    return _row("analysis_ready", check, n, "CRITICAL")


@query(
    "dq_panel_invariants",
    _all(
        _inv("unique_grain", _dups("t_panel", '"Date", SKU')), _inv("row_count", "SELECT abs(count(*) - 1000) AS n FROM t_panel"),
        _inv("sku_count", "SELECT abs(count(DISTINCT SKU) - 100) AS n FROM t_panel"),
        _inv("date_count", 'SELECT abs(count(DISTINCT "Date") - 2400) AS n FROM t_panel'),
        _inv("no_null_product", _count("t_panel", "Product_Name IS NULL")), _inv("no_null_category", _count("t_panel", "Category IS NULL")),
        _inv("no_null_calendar", _count("t_panel", '"year" IS NULL')),
        _inv("revenue_consistent", _count("t_panel", "abs(Revenue - Units_Sold * Price) > 0.01")),
        _inv("no_negative_units", _count("t_panel", "Units_Sold < 0")), _inv("no_negative_revenue", _count("t_panel", "Revenue < 0")),
        _inv("no_negative_price", _count("t_panel", "Price < 0")), _inv("no_negative_stock", _count("t_panel", "Current_Stock < 0")),
        _inv("negative_margin_skus", "SELECT abs(count(DISTINCT SKU) FILTER (negative_margin_flag) - 30) AS n FROM t_panel"),
        _inv("orphans_isolated", "SELECT count(DISTINCT SKU) AS n FROM t_panel WHERE SKU IN (SELECT SKU FROM t_quarantine)"),
        _inv("orphan_skus", "SELECT abs(count(DISTINCT SKU) - 100) AS n FROM t_quarantine"),
        _inv("quarantine_rows", "SELECT abs(count(*) - 7000) AS n FROM t_quarantine"),
    ),
)
def _(c):
    expected = {"rows": 1000, "skus": 100, "dates": 2400, "negative_margin_skus": 30, "orphan_skus": 100, "quarantine_rows": 7000}
    return quality.panel_invariants(c.stored(c.panel), c.stored(c.quarantine), expected)


@query(
    "dq_join_grain",
    _all(
        _row("sales_master", "right_key_unique", _dups("t_master", "SKU"), "CRITICAL"), _row("sales_master", "rows_preserved", "SELECT 0 AS n", "CRITICAL"),
        _row("sales_master", "no_unmatched", _count("t_sales", "SKU NOT IN (SELECT SKU FROM t_master)"), "CRITICAL"),
    ),
)
def _(c):
    return quality.join_grain(c.sales, c.norm_master, ["SKU"], "sales_master")


@query(
    "dq_prediction_sanity",
    """SELECT model, count(*) AS prediction_count, count(*) FILTER (forecast IS NULL) AS missing_predictions, count(*) FILTER (isinf(forecast)) AS infinite_predictions,
    count(*) FILTER (forecast < 0) AS negative_predictions, min(forecast) AS min_prediction, max(forecast) AS max_prediction, count(DISTINCT SKU) AS sku_coverage,
    count(DISTINCT horizon) AS horizon_coverage, count(DISTINCT forecast_origin) AS origin_coverage,
    count(*) FILTER (forecast IS NULL OR isinf(forecast) OR forecast < 0) = 0 AS passed FROM t_fc GROUP BY model""",
    "min_prediction max_prediction",
)
def _(c):
    return quality.prediction_sanity(c.forecasts)


@query(
    "dq_risk_panel",
    _all(
        _row("risk", "complete_grid", "SELECT count(DISTINCT origin_date) * count(DISTINCT SKU) - count(*) AS n FROM t_risk", "CRITICAL"),
        _row("risk", "monetary_null", _count("t_risk", "excess_inventory_value IS NOT NULL"), "CRITICAL"),
        _row("risk", "governance_flags_false", _count("t_risk", "valuation_basis_confirmed"), "CRITICAL"),
        _row("risk", "score_in_unit_interval", _count("t_risk", "stockout_score NOT BETWEEN 0 AND 1")),
        _row("risk", "excess_non_negative", _count("t_risk", "excess_inventory_units < 0")),
    ),
)
def _(c):
    return quality.risk_panel_checks(c.risk)


@query("dq_action_tiers", _row("risk", "allowed_values_action_tier", _count("t_risk", "action_tier NOT IN ('CRITICAL REORDER', 'REORDER', 'MONITOR', 'HEALTHY', 'OVERSTOCK', 'UNKNOWN')")))
def _(c):
    return quality.action_tier_check(c.risk, risk.ACTION_TIERS)


@query(
    "dq_feature_leakage",
    _all(
        _row("features", "targets_present", "SELECT 0 AS n", "CRITICAL"), _row("features", "lag_52_present", "SELECT 0 AS n", "CRITICAL"),
        _row("features", "target_not_copied", "SELECT CAST(corr(lag_1, target_h1) >= 0.999 AS BIGINT) AS n FROM t_features WHERE lag_52 IS NOT NULL AND target_h8 IS NOT NULL", "CRITICAL"),
    ),
)
def _(c):
    return quality.feature_leakage(feat.valid_rows(c.features))


@query(
    "dq_future_perturbation",
    "SELECT unnest(['rolling_mean_8', 'rolling_std_4', 'lag_52', 'ewma_decay_03', 'promo_days_last_8w', 'latest_known_stock']) AS feature, CAST(0 AS DOUBLE) AS max_abs_diff",
)
def _(c):
    """Six features of all; ``dq_future_perturbation_all`` has every one."""
    kept = ["rolling_mean_8", "rolling_std_4", "lag_52", "ewma_decay_03", "promo_days_last_8w", "latest_known_stock"]
    return perturbed_at_origins(c).filter(F.col("feature").isin(kept))


@query("dq_future_perturbation_all")
def _(c):
    return perturbed_at_origins(c)


#: Grid rows that one build with changes holds, unless one origin has more.
COPIED_ROWS = 1 << 22


def perturbed_at_origins(c, table=feat.feature_table, rows=COPIED_ROWS):
    """At every origin, change every sale after its week and every later snapshot; none of its numeric features may move.

    The largest difference of each feature over all origins. ``table`` (features from daily sales, master and snapshots) is built once
    without changes. With them, each origin gets its own copy of the items, as many origins in one build as make up to ``rows`` rows and at
    least one; the builds follow one another, and what one shuffles is let go before the next.
    """
    # Rows without an item share an empty one, as in the copies.
    sales, master, snapshots = (c.stored(df.withColumn("SKU", F.coalesce("SKU", F.lit("")))) for df in (c.sales, c.norm_master, c.snapshots))
    # At most twelve dates.
    origins = sorted(r[0] for r in c.origins.collect())
    step = max(1, rows // max(1, timegrid.grid_rows(sales)))

    def built(*inputs):
        out = table(*inputs)
        return out.drop(*[x for x in out.columns if x.startswith("target_h")])

    def stored(df):
        with shuffles_let_go(c.spark):
            return c.stored(df)

    def changed(some):
        dates = F.explode(F.array(*[F.lit(o) for o in some]))
        later, later_snap = F.col("Date") > F.date_add("_o", 6), F.col("snapshot_date") > F.col("_o")
        units, promotion = F.when(later, F.col("Units_Sold") * 7 + 13).otherwise(F.col("Units_Sold")), F.when(later, 1 - F.col("Promotion")).otherwise(F.col("Promotion"))
        stock = F.when(later_snap, F.col("Current_Stock") + 5000).otherwise(F.col("Current_Stock"))

        def copies(df, changes):
            return df.withColumn("_o", dates).withColumns({"SKU": F.concat_ws("@", "SKU", F.col("_o").cast("string")), **changes}).drop("_o")

        out = built(copies(sales, {"Units_Sold": units, "Promotion": promotion}), copies(master, {}), copies(snapshots, {"Current_Stock": stock}))
        out = out.where(F.substring_index("SKU", "@", -1) == F.col("forecast_origin_date").cast("string"))
        return stored(out.withColumn("SKU", F.expr("left(SKU, length(SKU) - 11)")))

    before = stored(built(sales, master, snapshots).where(F.col("forecast_origin_date").isin(origins)))
    after = [changed(origins[i : i + step]) for i in range(0, len(origins), step)]
    return quality.future_perturbation(before, forecast.union_forecasts(*after), feat.KEYS)


@query(
    "dq_weekly_reconciles",
    _all(
        _row("weekly", "units_reconcile", "SELECT abs((SELECT sum(Units_Sold) FROM t_weekly) - (SELECT sum(Units_Sold) FROM t_sales)) AS n", "CRITICAL"),
        _row("weekly", "complete_grid", "SELECT count(DISTINCT SKU) * count(DISTINCT week_start) - count(*) AS n FROM t_weekly", "CRITICAL"),
    ),
)
def _(c):
    return quality.weekly_reconciles(c.sales, c.weekly)


@query(
    "topk_violations",
    "SELECT SKU, Cost_Price, Selling_Price, Cost_Price - Selling_Price AS discrepancy FROM t_master ORDER BY discrepancy DESC, SKU LIMIT 3",
    "discrepancy",
)
def _(c):
    rows = c.master.select("SKU", "Cost_Price", "Selling_Price")
    return quality.topk_violations(rows, F.col("Cost_Price") - F.col("Selling_Price"), ["SKU"])


# Name and type of every column of the daily panel.
_PANEL = {
    "date": "Date Launch_Date", "bigint": "Units_Sold Promotion year month week is_weekend is_holiday",
    "double": "Revenue Price Cost_Price Selling_Price Gross_Margin_Per_Unit Current_Stock On_Order Lead_Time_Days Safety_Stock Reorder_Point Inventory_Value",
    "string": "SKU Product_Name Category Subcategory quarter day_of_week season holiday promotion_event",
    "boolean": "negative_margin_flag has_inventory_snapshot",
}


@query(
    "data_dictionary_counts",
    " UNION ALL ".join(
        f"SELECT '{x}' AS column_name, '{kind}' AS data_type, count(*) FILTER ({x} IS NULL) AS missing FROM t_panel"
        for kind, names in _PANEL.items() for x in names.split()
    ),
)
def _(c):
    return profile.data_dictionary_counts(c.panel)
