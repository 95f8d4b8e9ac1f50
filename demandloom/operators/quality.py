"""Data-quality checks. Row-level checks of a table share one aggregate pass; each gives one result row."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

RESULT = ("dataset", "check_name", "status", "severity", "affected_rows")


@dataclass(frozen=True)
class Check:
    """``broken`` marks an offending row; ``severity`` applies when any row is broken."""

    name: str
    broken: Column
    severity: str = "ERROR"
    fires_as: str = "FAIL"


def not_null(*columns: str, severity: str = "ERROR") -> list[Check]:
    return [Check(f"no_nulls_{c}", F.col(c).isNull(), severity) for c in columns]


def no_null_dates(*columns: str) -> list[Check]:
    return [Check(f"no_null_dates_{c}", F.col(c).isNull(), "CRITICAL") for c in columns]


def non_negative(*columns: str) -> list[Check]:
    return [Check(f"non_negative_{c}", F.col(c) < 0) for c in columns]


def positive(*columns: str) -> list[Check]:
    return [Check(f"positive_{c}", F.col(c) <= 0) for c in columns]


def allowed_values(column: str, values: Sequence) -> Check:
    """A missing value counts as not allowed."""
    return Check(f"allowed_values_{column}", ~F.coalesce(F.col(column).isin(list(values)), F.lit(False)))


def sku_pattern(column: str = "SKU", pattern: str = r"^SKU\d+$") -> Check:
    return Check(f"pattern_{column}", ~F.coalesce(F.col(column).rlike(pattern), F.lit(False)))


def revenue_consistency(tolerance: float = 0.01) -> Check:
    return Check("revenue_consistency", F.abs(F.col("Revenue") - F.col("Units_Sold") * F.col("Price")) > tolerance)


def margin_consistency(tolerance: float = 0.02) -> Check:
    gap = F.abs(F.col("Gross_Margin_Per_Unit") - (F.col("Selling_Price") - F.col("Cost_Price")))
    return Check("margin_consistency", gap > tolerance)


def negative_margin() -> Check:
    return Check("negative_margin", F.col("Cost_Price") > F.col("Selling_Price"), "WARNING", "WARNING")


def value_range(column: str, lo: int, hi: int) -> Check:
    return Check(f"range_{column}", ~F.coalesce(F.col(column).between(lo, hi), F.lit(False)))


def holiday_nulls() -> list[Check]:
    missing = F.col("holiday").isNull()
    return [
        Check("holiday_null_structural", missing & (F.col("is_holiday") == 0), "INFO", "PASS"),
        Check("holiday_null_on_holiday", missing & (F.col("is_holiday") == 1)),
    ]


def event_nulls() -> Check:
    return Check("promotion_event_null_structural", F.col("promotion_event").isNull(), "INFO", "PASS")


def _result(dataset: str, name: str, affected: Column, severity: str, fires_as: str) -> Column:
    hit = affected > 0
    always_info = severity == "INFO"
    return F.struct(
        F.lit(dataset).alias("dataset"), F.lit(name).alias("check_name"),
        F.when(hit, fires_as).otherwise("PASS").alias("status"),
        (F.lit("INFO") if always_info else F.when(hit, severity).otherwise("INFO")).alias("severity"),
        affected.cast("bigint").alias("affected_rows"),
    )


def run_checks(df: DataFrame, dataset: str, checks: Sequence[Check]) -> DataFrame:
    """All row-level checks of one table in a single aggregate."""
    counted = df.agg(*[F.count_if(c.broken).alias(f"_{i}") for i, c in enumerate(checks)])
    rows = [_result(dataset, c.name, F.col(f"_{i}"), c.severity, c.fires_as) for i, c in enumerate(checks)]
    return counted.select(F.inline(F.array(*rows)))


def _one(df: DataFrame, dataset: str, name: str, severity: str, fires_as: str = "FAIL") -> DataFrame:
    """Result row from a one-row frame with the column ``n``."""
    return df.select(F.inline(F.array(_result(dataset, name, F.col("n"), severity, fires_as))))


def required_columns(df: DataFrame, dataset: str, required: Sequence[str]) -> DataFrame:
    """Schema check; looks at the schema only, one result row derived from the (possibly empty) table."""
    missing = len([c for c in required if c not in df.columns])
    return _one(df.agg(F.lit(missing).alias("n")), dataset, "required_columns", "CRITICAL")


def pk_unique(df: DataFrame, dataset: str, key: Sequence[str]) -> DataFrame:
    """Counts every row of a duplicated key."""
    dup = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).agg(
        F.coalesce(F.sum(F.when(F.col("_n") > 1, F.col("_n"))), F.lit(0)).alias("n")
    )
    return _one(dup, dataset, "pk_unique", "CRITICAL")


def duplicate_samples(df: DataFrame, key: Sequence[str], n: int = 5) -> DataFrame:
    """The first ``n`` duplicated keys with their row counts (a report sample)."""
    return (
        df.groupBy(*key).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")
        .orderBy(F.desc("copies"), *key).limit(n)
    )


def topk_violations(df: DataFrame, size: Column, key: Sequence[str], k: int = 3) -> DataFrame:
    """The ``k`` largest discrepancies."""
    return df.withColumn("discrepancy", size).orderBy(F.desc("discrepancy"), *key).limit(k)


def ref_integrity(
    child: DataFrame, parent: DataFrame, child_key: str, parent_key: str, dataset: str, name: str,
    severity: str = "CRITICAL", fires_as: str = "FAIL",
) -> DataFrame:
    """Child rows whose key has no parent. Child keys are counted first, so a hot key costs one row."""
    keys = child.groupBy(F.col(child_key).alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
    orphans = keys.join(parent.select(F.col(parent_key).alias("_k")), "_k", "left_anti")
    return _one(orphans.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n")), dataset, name, severity, fires_as)


def orphan_skus(inventory: DataFrame, master: DataFrame) -> DataFrame:
    """Items with snapshots but without master data: item and row counts."""
    keys = inventory.groupBy("SKU").agg(F.count(F.lit(1)).alias("rows"))
    return keys.join(master.select("SKU"), "SKU", "left_anti")


def panel_complete(df: DataFrame, item: str, date: str, dataset: str) -> DataFrame:
    """Missing cells of the item x date grid."""
    gap = df.agg(
        (F.count_distinct(item) * F.count_distinct(date) - F.count(F.lit(1))).alias("n")
    )
    return _one(gap, dataset, "panel_complete", "ERROR")


def join_grain(left: DataFrame, right: DataFrame, key: Sequence[str], dataset: str) -> DataFrame:
    """Pre- and post-conditions of an n:1 left join: unique right key, unmatched rows, row count kept."""
    right_keys = right.groupBy(*key).agg(F.count(F.lit(1)).alias("_copies"))
    left_keys = left.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    stats = left_keys.join(right_keys, list(key), "left").agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("_before"),
        F.coalesce(F.sum(F.col("_n") * F.coalesce("_copies", F.lit(1))), F.lit(0)).alias("_after"),
        F.coalesce(F.sum(F.when(F.col("_copies").isNull(), F.col("_n"))), F.lit(0)).alias("_unmatched"),
    )
    dup = right_keys.agg(F.coalesce(F.sum(F.when(F.col("_copies") > 1, F.col("_copies"))), F.lit(0))).scalar()
    rows = [
        _result(dataset, "right_key_unique", F.col("_dup"), "CRITICAL", "FAIL"),
        _result(dataset, "rows_preserved", F.abs(F.col("_after") - F.col("_before")), "CRITICAL", "FAIL"),
        _result(dataset, "no_unmatched", F.col("_unmatched"), "CRITICAL", "FAIL"),
    ]
    return stats.withColumn("_dup", dup).select(F.inline(F.array(*rows)))


# --- suites ----------------------------------------------------------------------------------------


def sales_checks() -> list[Check]:
    return [
        *no_null_dates("Date"), *not_null("SKU", "Units_Sold", "Revenue", "Price", "Promotion"),
        *non_negative("Units_Sold", "Revenue"), *positive("Price"),
        allowed_values("Promotion", [0, 1]), sku_pattern(), revenue_consistency(),
    ]


def master_checks() -> list[Check]:
    return [
        *not_null("SKU", "Product_Name", "Category", "Subcategory", "Cost_Price", "Selling_Price"),
        *no_null_dates("Launch_Date"), *positive("Cost_Price", "Selling_Price"), sku_pattern(),
        margin_consistency(), negative_margin(),
    ]


def calendar_checks(first_year: int, last_year: int) -> list[Check]:
    return [
        *no_null_dates("date"), *not_null("year", "month", "week", "quarter", "day_of_week", "season"),
        value_range("year", first_year, last_year), value_range("month", 1, 12), value_range("week", 1, 53),
        allowed_values("is_weekend", [0, 1]), allowed_values("is_holiday", [0, 1]), *holiday_nulls(), event_nulls(),
    ]


def inventory_checks() -> list[Check]:
    counts = ("Current_Stock", "On_Order", "Safety_Stock", "Reorder_Point", "Inventory_Value")
    return [
        *no_null_dates("Snapshot_Date"), *not_null("SKU", *counts, "Lead_Time_Days"),
        *non_negative(*counts), *positive("Lead_Time_Days"), sku_pattern(),
    ]


def quality_suite(
    sales: DataFrame, master: DataFrame, calendar: DataFrame, inventory: DataFrame, years: tuple[int, int]
) -> DataFrame:
    """Every per-table and cross-table check, one row each."""
    parts = [
        run_checks(sales, "sales_daily", sales_checks()),
        pk_unique(sales, "sales_daily", ["Date", "SKU"]),
        run_checks(master, "sku_master", master_checks()),
        pk_unique(master, "sku_master", ["SKU"]),
        run_checks(calendar, "calendar", calendar_checks(*years)),
        pk_unique(calendar, "calendar", ["date"]),
        run_checks(inventory, "inventory_snapshots", inventory_checks()),
        pk_unique(inventory, "inventory_snapshots", ["Snapshot_Date", "SKU"]),
        *cross_checks(sales, master, calendar, inventory),
        panel_complete(sales, "SKU", "Date", "sales_daily"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def cross_checks(sales: DataFrame, master: DataFrame, calendar: DataFrame, inventory: DataFrame) -> list[DataFrame]:
    return [
        ref_integrity(sales, master, "SKU", "SKU", "cross", "sales_sku_in_master"),
        ref_integrity(sales, calendar, "Date", "date", "cross", "sales_date_in_calendar"),
        ref_integrity(inventory, master, "SKU", "SKU", "cross", "inventory_sku_in_master", "WARNING", "WARNING"),
        ref_integrity(inventory, calendar, "Snapshot_Date", "date", "cross", "inventory_date_in_calendar"),
    ]


def halt_on_critical(results: DataFrame) -> DataFrame:
    """Fails the job when it meets a CRITICAL failure."""
    stop = (F.col("status") == "FAIL") & (F.col("severity") == "CRITICAL")
    message = F.concat(F.lit("critical check failed: "), F.col("dataset"), F.lit("."), F.col("check_name"))
    return results.filter(F.when(stop, F.raise_error(message).cast("boolean")).otherwise(True))


def status_counts(results: DataFrame) -> DataFrame:
    return results.groupBy("status").agg(F.count(F.lit(1)).alias("checks"))


def stack_metrics(one_row: DataFrame, metrics: Mapping[str, Column], name: str = "metric", value: str = "value") -> DataFrame:
    """One-row aggregate to (name, value) rows."""
    pairs = [F.struct(F.lit(k).alias(name), v.cast("double").alias(value)) for k, v in metrics.items()]
    return one_row.select(F.inline(F.array(*pairs)))


def panel_invariants(panel: DataFrame, quarantine: DataFrame, expected: Mapping[str, int]) -> DataFrame:
    """Sixteen invariants of the integrated panel; ``expected`` holds the counts that must be met.

    Keys of ``expected``: ``rows``, ``skus``, ``dates``, ``negative_margin_skus``, ``orphan_skus``, ``quarantine_rows``.
    """
    c = F.col
    orphans = quarantine.select("SKU").distinct().withColumn("_orphan", F.lit(1))
    grain = panel.groupBy("Date", "SKU").agg(F.count(F.lit(1)).alias("_k")).agg(
        F.coalesce(F.sum(F.when(c("_k") > 1, c("_k"))), F.lit(0))
    ).scalar()
    leaked = panel.select("SKU").distinct().join(orphans, "SKU", "left_semi").agg(F.count(F.lit(1))).scalar()
    side = quarantine.agg(
        F.struct(F.count_distinct("SKU").alias("skus"), F.count(F.lit(1)).alias("rows"),
                 F.count_if(~c("inventory_quarantine_flag")).alias("unflagged")).alias("s")
    ).scalar()
    one = panel.agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("SKU").alias("skus"), F.count_distinct("Date").alias("dates"),
        F.count_if(c("Product_Name").isNull()).alias("null_product"), F.count_if(c("Category").isNull()).alias("null_category"),
        F.count_if(c("year").isNull()).alias("null_calendar"),
        F.count_if(F.abs(c("Revenue") - c("Units_Sold") * c("Price")) > 0.01).alias("revenue"),
        F.count_if(c("Units_Sold") < 0).alias("neg_units"), F.count_if(c("Revenue") < 0).alias("neg_revenue"),
        F.count_if(c("Price") < 0).alias("neg_price"), F.count_if(c("Current_Stock") < 0).alias("neg_stock"),
        F.count_distinct(F.when(c("negative_margin_flag"), c("SKU"))).alias("margin_skus"),
    ).withColumn("grain", grain).withColumn("leaked", leaked).withColumn("s", side)

    def off(column: Column, key: str) -> Column:
        return F.abs(column - F.lit(expected[key]))

    gaps = {
        "unique_grain": c("grain"), "row_count": off(c("rows"), "rows"), "sku_count": off(c("skus"), "skus"),
        "date_count": off(c("dates"), "dates"), "no_null_product": c("null_product"),
        "no_null_category": c("null_category"), "no_null_calendar": c("null_calendar"),
        "revenue_consistent": c("revenue"), "no_negative_units": c("neg_units"),
        "no_negative_revenue": c("neg_revenue"), "no_negative_price": c("neg_price"),
        "no_negative_stock": c("neg_stock"),
        "negative_margin_skus": off(c("margin_skus"), "negative_margin_skus"), "orphans_isolated": c("leaked"),
        "orphan_skus": off(c("s.skus"), "orphan_skus"), "quarantine_rows": off(c("s.rows"), "quarantine_rows") + c("s.unflagged"),
    }
    rows = [_result("analysis_ready", k, v, "CRITICAL", "FAIL") for k, v in gaps.items()]
    return one.select(F.inline(F.array(*rows)))


def prediction_sanity(df: DataFrame, prediction: str = "forecast", origin: str = "forecast_origin") -> DataFrame:
    """Per model: row, missing, infinite and negative counts, extremes, coverage, verdict."""
    p = F.col(prediction)
    infinite = p.isin(float("inf"), float("-inf"))
    return df.groupBy("model").agg(
        F.count(F.lit(1)).alias("prediction_count"), F.count_if(p.isNull()).alias("missing_predictions"),
        F.count_if(infinite).alias("infinite_predictions"), F.count_if(p < 0).alias("negative_predictions"),
        F.min(p).alias("min_prediction"), F.max(p).alias("max_prediction"),
        F.count_distinct("SKU").alias("sku_coverage"), F.count_distinct("horizon").alias("horizon_coverage"),
        F.count_distinct(origin).alias("origin_coverage"),
    ).withColumn(
        "passed",
        (F.col("missing_predictions") + F.col("infinite_predictions") + F.col("negative_predictions")) == 0,
    )


def risk_panel_checks(risk: DataFrame) -> DataFrame:
    c = F.col
    money = c("excess_inventory_value").isNotNull() | c("inventory_value_at_risk").isNotNull() | c("capital_at_risk").isNotNull()
    grid = risk.agg(
        (F.count_distinct("origin_date") * F.count_distinct("SKU") - F.count(F.lit(1))).alias("_gap"),
        F.count_if(money).alias("_money"), F.count_if(c("valuation_basis_confirmed") | c("arrival_timing_confirmed")).alias("_flags"),
        F.count_if((c("stockout_score") < 0) | (c("stockout_score") > 1)).alias("_score"),
        F.count_if(c("excess_inventory_units") < 0).alias("_excess"),
    )
    rows = [
        _result("risk", "complete_grid", F.abs("_gap"), "CRITICAL", "FAIL"),
        _result("risk", "monetary_null", c("_money"), "CRITICAL", "FAIL"),
        _result("risk", "governance_flags_false", c("_flags"), "CRITICAL", "FAIL"),
        _result("risk", "score_in_unit_interval", c("_score"), "ERROR", "FAIL"),
        _result("risk", "excess_non_negative", c("_excess"), "ERROR", "FAIL"),
    ]
    return grid.select(F.inline(F.array(*rows)))


def action_tier_check(risk: DataFrame, tiers: Sequence[str]) -> DataFrame:
    return run_checks(risk, "risk", [allowed_values("action_tier", tiers)])


def feature_leakage(features: DataFrame, limit: float = 0.999) -> DataFrame:
    """On training rows: missing targets, missing yearly lag, and a target that copies the current value."""
    targets = [c for c in features.columns if c.startswith("target_h")]
    missing = F.lit(False)
    for t in targets:
        missing = missing | F.col(t).isNull()
    one = features.agg(
        F.count_if(missing).alias("_t"), F.count_if(F.col("lag_52").isNull()).alias("_l"),
        F.corr(F.col("lag_1").cast("double"), F.col("target_h1").cast("double")).alias("_c"),
    )
    rows = [
        _result("features", "targets_present", F.col("_t"), "CRITICAL", "FAIL"),
        _result("features", "lag_52_present", F.col("_l"), "CRITICAL", "FAIL"),
        _result("features", "target_not_copied", (F.coalesce("_c", F.lit(0.0)) >= limit).cast("bigint"), "CRITICAL", "FAIL"),
    ]
    return one.select(F.inline(F.array(*rows)))


def future_perturbation(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Largest absolute difference per numeric column of two builds of a table; must be 0 at the origin."""
    numeric = [f.name for f in before.schema.fields if f.name not in keys and f.dataType.typeName() in ("double", "long", "integer")]
    b = before.select(*keys, F.struct(*numeric).alias("b"))
    a = after.select(*keys, F.struct(*numeric).alias("a"))
    joined = b.join(a, list(keys), "full")
    gaps = [
        F.max(
            F.when(F.col(f"b.{n}").isNull() & F.col(f"a.{n}").isNull(), 0.0)
            .otherwise(F.coalesce(F.abs(F.col(f"b.{n}") - F.col(f"a.{n}")).cast("double"), F.lit(float("inf"))))
        ).alias(n)
        for n in numeric
    ]
    return stack_metrics(joined.agg(*gaps), {n: F.col(n) for n in numeric}, "feature", "max_abs_diff")


def weekly_reconciles(daily: DataFrame, weekly: DataFrame) -> DataFrame:
    """Weekly total equals daily total, and the item x week grid is complete."""
    total = daily.agg(F.sum("Units_Sold")).scalar()
    one = weekly.agg(
        F.sum("Units_Sold").alias("_w"),
        (F.count_distinct("SKU") * F.count_distinct("week_start") - F.count(F.lit(1))).alias("_gap"),
    ).withColumn("_d", total)
    rows = [
        _result("weekly", "units_reconcile", F.abs(F.col("_w") - F.col("_d")), "CRITICAL", "FAIL"),
        _result("weekly", "complete_grid", F.abs("_gap"), "CRITICAL", "FAIL"),
    ]
    return one.select(F.inline(F.array(*rows)))
