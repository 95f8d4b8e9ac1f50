"""Normalisation, quarantine and the integrated daily panel."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

REVENUE_TOLERANCE = 0.01


def _guarded(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Fail the job on the first row that breaks a rule; no extra pass over the data."""
    guard = F.lit(True)
    for message, broken in reversed(rules.items()):
        guard = F.when(F.coalesce(broken, F.lit(False)), F.raise_error(F.lit(message)).cast("boolean")).otherwise(guard)
    return df.filter(guard)


def normalize_sales(df: DataFrame, tolerance: float = REVENUE_TOLERANCE) -> DataFrame:
    """Trim and cast; negative quantities or a revenue that is not units x price stop the job."""
    typed = df.select(
        F.col("Date").cast("date").alias("Date"),
        F.trim("SKU").alias("SKU"),
        F.col("Units_Sold").cast("bigint").alias("Units_Sold"),
        F.col("Revenue").cast("double").alias("Revenue"),
        F.col("Price").cast("double").alias("Price"),
        F.col("Promotion").cast("bigint").alias("Promotion"),
    )
    return _guarded(
        typed,
        {
            "negative Units_Sold": F.col("Units_Sold") < 0,
            "negative Revenue": F.col("Revenue") < 0,
            "negative Price": F.col("Price") < 0,
            "Revenue differs from Units_Sold x Price":
                F.abs(F.col("Revenue") - F.col("Units_Sold") * F.col("Price")) > tolerance,
        },
    )


def normalize_sku_master(df: DataFrame) -> DataFrame:
    return df.select(
        *[F.trim(c).alias(c) for c in ("SKU", "Product_Name", "Category", "Subcategory")],
        F.col("Launch_Date").cast("date").alias("Launch_Date"),
        *[F.col(c).cast("double").alias(c) for c in ("Cost_Price", "Selling_Price", "Gross_Margin_Per_Unit")],
        (F.col("Cost_Price") > F.col("Selling_Price")).alias("negative_margin_flag"),
    )


def normalize_calendar(df: DataFrame) -> DataFrame:
    """``date`` becomes ``Date``; missing holiday and event names are structural and stay NULL."""
    ints = ("year", "month", "week", "is_weekend", "is_holiday")
    texts = ("quarter", "day_of_week", "season", "holiday", "promotion_event")
    return df.select(
        F.col("date").cast("date").alias("Date"),
        *[F.col(c).cast("bigint").alias(c) for c in ints],
        *[F.trim(c).alias(c) for c in texts],
    )


INVENTORY_NUMBERS = (
    "Current_Stock", "On_Order", "Lead_Time_Days", "Safety_Stock", "Reorder_Point", "Inventory_Value",
)


def normalize_inventory(inventory: DataFrame, master: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split snapshots into those with master data and the quarantined rest. ANSI casts raise on bad numbers."""
    typed = inventory.select(
        F.col("Snapshot_Date").cast("date").alias("Date"),
        F.trim("SKU").alias("SKU"),
        *[F.col(c).cast("double").alias(c) for c in INVENTORY_NUMBERS],
    )
    known = master.select("SKU")

    def flagged(df: DataFrame, matched: bool) -> DataFrame:
        return df.withColumn("inventory_master_match_flag", F.lit(matched)).withColumn(
            "inventory_quarantine_flag", F.lit(not matched)
        )

    return (
        flagged(typed.join(known, "SKU", "left_semi"), True),
        flagged(typed.join(known, "SKU", "left_anti"), False),
    )


def apply_quality_policies(
    master: DataFrame, aligned: DataFrame, quarantine: DataFrame, expected: Mapping[str, int] | None = None
) -> DataFrame:
    """One row per named policy: observed count, expected count, and whether they agree."""
    expected = dict(expected or {})
    rows = [
        ("preserve_and_flag_negative_margin", master.agg(F.count_if("negative_margin_flag").alias("observed"))),
        ("quarantine_orphan_skus", quarantine.agg(F.count_distinct("SKU").alias("observed"))),
        ("quarantine_orphan_rows", quarantine.agg(F.count(F.lit(1)).alias("observed"))),
        ("keep_aligned_rows", aligned.agg(F.count(F.lit(1)).alias("observed"))),
    ]
    out = None
    for policy, counted in rows:
        row = counted.select(
            F.lit(policy).alias("policy"),
            F.col("observed").cast("bigint").alias("observed"),
            F.lit(expected.get(policy)).cast("bigint").alias("expected"),
        )
        out = row if out is None else out.unionByName(row)
    return out.withColumn(
        "status",
        F.when(F.col("expected").isNull() | (F.col("expected") == F.col("observed")), "OK").otherwise("WARNING"),
    )


def filter_universe(df: DataFrame, master: DataFrame, key: str = "SKU") -> DataFrame:
    """Keep items that the master lists."""
    return df.join(master.select(F.col("SKU").alias(key)), key, "left_semi")


def filter_universe_pattern(df: DataFrame, pattern: str, key: str = "SKU") -> DataFrame:
    return df.filter(F.col(key).rlike(pattern))


# --- joins -----------------------------------------------------------------------------------------


def _matched_or_fail(df: DataFrame, marker: str, message: str) -> DataFrame:
    """Stop on a left row without a partner; ``marker`` is a non-null column of the right side."""
    return _guarded(df, {message: F.col(marker).isNull()}).drop(marker)


def join_sales_master(sales: DataFrame, master: DataFrame) -> DataFrame:
    """Left join n:1. No hint: Spark broadcasts the master only while it is below the size threshold."""
    marked = master.withColumn("_master", F.lit(True))
    return _matched_or_fail(sales.join(marked, "SKU", "left"), "_master", "sales row without master data")


def join_calendar(df: DataFrame, calendar: DataFrame) -> DataFrame:
    """Left join n:1. A calendar has one row per day (a century is 36,525 rows), so it is broadcast."""
    marked = calendar.withColumn("_day", F.lit(True))
    return _matched_or_fail(df.join(F.broadcast(marked), "Date", "left"), "_day", "date missing in calendar")


def join_inventory_exact(df: DataFrame, aligned: DataFrame) -> DataFrame:
    """Left join on (SKU, Date); days without a snapshot keep NULL stock.

    Snapshots are items x periods and may be far more than Spark guesses where they are derived, so they are never broadcast.
    """
    snaps = aligned.select("Date", "SKU", *INVENTORY_NUMBERS, F.lit(True).alias("_snap")).hint("merge")
    return (
        df.join(snaps, ["SKU", "Date"], "left")
        .withColumn("has_inventory_snapshot", F.col("_snap").isNotNull())
        .drop("_snap")
    )


PANEL_COLUMNS = (
    "Date", "SKU", "Units_Sold", "Revenue", "Price", "Promotion",
    "Product_Name", "Category", "Subcategory", "Launch_Date", "Cost_Price", "Selling_Price",
    "Gross_Margin_Per_Unit", "negative_margin_flag",
    "year", "month", "week", "is_weekend", "is_holiday", "quarter", "day_of_week", "season", "holiday",
    "promotion_event", *INVENTORY_NUMBERS, "has_inventory_snapshot",
)


def integrate_daily_panel(sales: DataFrame, master: DataFrame, calendar: DataFrame, aligned: DataFrame) -> DataFrame:
    """Sales with master, calendar and same-day snapshot columns, one row per (Date, SKU)."""
    joined = join_inventory_exact(join_calendar(join_sales_master(sales, master), calendar), aligned)
    return joined.select(*PANEL_COLUMNS)


def join_sku_metadata(df: DataFrame, master: DataFrame, columns: Sequence[str] = ("Product_Name", "Category", "Subcategory")) -> DataFrame:
    """Left join of descriptive columns after reducing the master to one row per item."""
    return df.join(dedupe_by_key(master, ["SKU"], ["Product_Name"]).select("SKU", *columns), "SKU", "left")


def dedupe_by_key(df: DataFrame, key: Sequence[str], tie_break: Sequence[str]) -> DataFrame:
    """One row per key, the smallest along ``tie_break`` then all columns.

    A ``min`` over a struct combines on the map side, so copies of a hot key never meet in one task.
    """
    order = [*tie_break, *[c for c in df.columns if c not in tie_break and c not in key]]
    return (
        df.groupBy(*key).agg(F.min(F.struct(*order)).alias("_row"))
        .select(*[F.col(c) if c in key else F.col(f"_row.{c}").alias(c) for c in df.columns])
    )


def distinct_rows(df: DataFrame) -> DataFrame:
    return df.distinct()


def anti_orphans(inventory: DataFrame, master: DataFrame) -> DataFrame:
    """Items that have snapshots but no master data."""
    return inventory.select("SKU").distinct().join(master.select("SKU"), "SKU", "left_anti")


def except_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Set difference of key values."""
    return left.select(key).subtract(right.select(key))


def join_category_median(master: DataFrame, value: str = "Selling_Price") -> DataFrame:
    """Attach the median of the item's category and the ratio to it."""
    from .ordered import quantiles

    medians = quantiles(master, value, {"category_median_price": 0.5}, by=["Category"])
    return master.join(medians, "Category", "left").withColumn(
        "price_vs_category_median_ratio", F.try_divide(F.col(value), F.col("category_median_price"))
    )


# --- scalar rules ----------------------------------------------------------------------------------


def price_tier_fixed(price: Column) -> Column:
    # The published limits and tier names.
    return F.when(price < 4000.0, "Budget").when(price < 8000.0, "Mid-Range").otherwise("Premium")


def price_tier_quantile(df: DataFrame, column: str = "Price") -> DataFrame:
    """Tier by the 33 % and 66 % quantiles of ``column`` over the rows of ``df``."""
    from .ordered import quantiles

    cuts = quantiles(df, column, {"lo": 0.33, "hi": 0.66}).select(F.struct("lo", "hi").alias("c")).scalar()
    return (
        df.withColumn("_c", cuts)
        .withColumn(
            "Price_Tier",
            F.when(F.col(column) <= F.col("_c.lo"), "Budget")
            .when(F.col(column) <= F.col("_c.hi"), "Mid-Range")
            .otherwise("Premium"),
        )
        .drop("_c")
    )


def clamp_nonnegative(value: Column) -> Column:
    return F.greatest(F.lit(0.0), value)


def encode_fixed_categories(value: Column, labels: Sequence[str]) -> Column:
    """Position in a declared list; unknown or missing gives -1."""
    return F.coalesce(F.array_position(F.array(*[F.lit(x) for x in labels]), value) - 1, F.lit(-1)).cast("int")


def sort_deterministic(df: DataFrame, *columns: str) -> DataFrame:
    """Range-partitioned total order, meant for the sink."""
    return df.orderBy(*columns)
