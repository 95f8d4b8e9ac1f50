"""Weekly panels, gap filling and the as-of join."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions import iso_year, week_label_monday, week_start

#: Rows of the weekly grid in one task: at most, since windows by item widen and sort them several times, and where cores are idle.
GRID_ROWS, LEAST_ROWS = 1 << 16, 1 << 15


def grid_rows(daily: DataFrame) -> int:
    """About how many rows the weekly grid of ``daily`` has: items x weeks."""
    items = daily.groupBy("SKU").agg(F.min("Date").alias("lo"), F.max("Date").alias("hi"))
    n, days = items.agg(F.count(F.lit(1)), F.datediff(F.max("hi"), F.min("lo"))).first()
    return n * ((days or 0) // 7 + 1)


def grid_parts(daily: DataFrame, rows: int = GRID_ROWS) -> int:
    """Tasks for windows by item over the weekly grid of ``daily``.

    The rows shuffled by item are few and narrow until gaps are filled and windows added, so their bytes say little about a task's memory.
    """
    grid = grid_rows(daily)
    idle = min(daily.sparkSession.sparkContext.defaultParallelism, math.ceil(grid / min(rows, LEAST_ROWS)))
    return max(1, math.ceil(grid / rows), idle)


def weekly_panel(daily: DataFrame, anchor: str = "TUE") -> DataFrame:
    """Units, promotion days and a promotion flag per (SKU, week)."""
    return (
        daily.groupBy("SKU", week_start(F.col("Date"), anchor).alias("week_start"))
        .agg(
            F.sum("Units_Sold").cast("bigint").alias("Units_Sold"),
            F.sum("Promotion").cast("bigint").alias("promo_days"),
        )
        .withColumn("promo_active", (F.col("promo_days") > 0).cast("int"))
    )


def panel_fill(
    df: DataFrame,
    date: str,
    zero: Sequence[str],
    step_days: int,
    key: str = "SKU",
    policy: str = "zero_fill",
    bounds: DataFrame | None = None,
) -> DataFrame:
    """Give every item one row per period between the earliest and the latest period of the whole table.

    ``bounds`` (one row: lo, hi) names that range when it is already known, which saves a pass over the input.

    Each row is stretched over the gap that follows it, which needs one window by item and no join with a
    scaffold; later windows by item reuse the same partitioning. Rows per item are bounded by the number
    of periods, whatever the number of source rows behind them.

    ``zero_fill`` sets the ``zero`` columns of an added row to 0, ``interpolate`` draws a line between the
    neighbours (flat at both ends); columns not listed become NULL. Both add the flag ``is_filled``.
    """
    if policy not in ("zero_fill", "interpolate"):
        raise ValueError(f"unknown gap policy {policy!r}")
    if bounds is None:
        bounds = df.agg(F.min(date).alias("lo"), F.max(date).alias("hi"))
    w = W.partitionBy(key).orderBy(date)
    ends = {f"_to_{c}": F.lead(c).over(w) for c in zero} if policy == "interpolate" else {}
    framed = df.withColumns(
        {"_b": bounds.select(F.struct("lo", "hi")).scalar(), "_next": F.lead(date).over(w), "_first": F.lag(date).over(w).isNull(), **ends}
    )
    start = F.when(F.col("_first"), F.col("_b.lo")).otherwise(F.col(date))
    stop = F.coalesce(F.date_sub("_next", step_days), F.col("_b.hi"))
    periods = F.sequence(start, stop, F.make_interval(days=F.lit(step_days)))
    added = F.col("_at") != F.col(date)

    def filled(name: str):
        if policy == "zero_fill":
            return F.when(added, F.lit(0)).otherwise(F.col(name)).cast(df.schema[name].dataType)
        span = F.try_divide(F.datediff("_at", date), F.datediff("_next", date))
        line = F.col(name) + (F.col(f"_to_{name}") - F.col(name)) * span
        after = added & (F.col("_at") > F.col(date)) & F.col("_next").isNotNull()
        return F.when(after, line).otherwise(F.col(name)).cast("double")

    columns = []
    for c in df.columns:
        if c == date:
            columns.append(F.col("_at").alias(c))
        elif c == key:
            columns.append(F.col(c))
        elif c in zero:
            columns.append(filled(c).alias(c))
        else:
            columns.append(F.when(~added, F.col(c)).alias(c))
    return framed.withColumn("_at", F.explode(periods)).select(*columns, added.alias("is_filled"))


def flag_gaps(df: DataFrame, date: str, key: str = "SKU", step_days: int = 1) -> DataFrame:
    """``flag_only`` gap policy: missing periods per item, inside the item's own range and overall."""
    total = df.agg(((F.datediff(F.max(date), F.min(date)) / step_days).cast("bigint") + 1).alias("n")).scalar()
    return df.groupBy(key).agg(
        F.count(F.lit(1)).alias("periods"),
        ((F.datediff(F.max(date), F.min(date)) / step_days).cast("bigint") + 1 - F.count(F.lit(1))).alias("inner_gaps"),
    ).withColumn("missing_periods", (total - F.col("periods")).cast("bigint"))


def week_span(days: DataFrame, anchor: str = "TUE") -> DataFrame:
    """First and last week of a one-row (lo, hi) date range."""
    return days.select(week_start(F.col("lo"), anchor).alias("lo"), week_start(F.col("hi"), anchor).alias("hi"))


def weekly_filled(daily: DataFrame, anchor: str = "TUE", days: DataFrame | None = None, parts: int | None = None) -> DataFrame:
    """Gap-free weekly panel: the input of every positional window. ``days`` is the known (lo, hi) date range, ``parts`` the known ``grid_parts``."""
    dealt = weekly_panel(daily, anchor).repartition(grid_parts(daily) if parts is None else parts, "SKU")
    return panel_fill(
        dealt, "week_start", ["Units_Sold", "promo_days", "promo_active"], 7,
        bounds=None if days is None else week_span(days, anchor),
    ).drop("is_filled")


def weekly_iso(daily: DataFrame) -> DataFrame:
    return daily.groupBy(
        "SKU", iso_year(F.col("Date")).alias("iso_year"), F.weekofyear("Date").alias("iso_week")
    ).agg(
        F.sum("Units_Sold").cast("bigint").alias("Weekly_Units"),
        F.count("Date").alias("Days_Count"),
        F.sum("Promotion").cast("bigint").alias("Active_Promo_Days"),
    )


def weekly_label(daily: DataFrame) -> DataFrame:
    """Weekly units labelled by the closing Monday."""
    return daily.groupBy("SKU", week_label_monday(F.col("Date")).alias("Date")).agg(
        F.sum("Units_Sold").cast("bigint").alias("Units_Sold")
    )


def weekly_demand_meta(weekly: DataFrame, meta: DataFrame) -> DataFrame:
    """Weekly units with category, subcategory and intermittency class of the item."""
    return weekly.select("SKU", "week_start", "Units_Sold").join(
        meta.select("SKU", "Category", "Subcategory", "Intermittency_Class"), "SKU", "left"
    )


def asof_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    left_date: str,
    right_date: str,
    columns: Sequence[str],
    parts: int | None = None,
) -> DataFrame:
    """Backward as-of join: the latest ``right`` row of the same key with ``right_date <= left_date``.

    Both sides go into one union, sorted once per key; the last right-hand row is carried forward. Work is
    linear, with one shuffle. Rows per key are bounded by the periods of the grid plus the snapshots.
    ``right`` must be unique on (key, right_date). ``parts`` fixes the number of tasks of the shuffle.
    """
    payload = F.struct(F.col(right_date).alias(right_date), *[F.col(c) for c in columns])
    rights = right.select(
        F.col(key), F.col(right_date).alias("_ts"), F.lit(0).alias("_side"), payload.alias("_snap")
    )
    lefts = left.select(
        F.col(key), F.col(left_date).alias("_ts"), F.lit(1).alias("_side"), F.struct("*").alias("_row")
    )
    w = W.partitionBy(key).orderBy("_ts", "_side").rowsBetween(W.unboundedPreceding, 0)
    both = rights.unionByName(lefts, allowMissingColumns=True)
    carried = (
        (both if parts is None else both.repartition(parts, key))
        .withColumn("_snap", F.last("_snap", ignorenulls=True).over(w))
        .filter(F.col("_side") == 1)
    )
    # The key is taken as the shuffle knows it, so what follows by key needs no other one.
    return carried.select(
        *[F.col(c if c == key else f"_row.{c}").alias(c) for c in left.columns],
        *[F.col(f"_snap.{c}").alias(c) for c in (right_date, *columns)],
    )


def scaffold_origin_sku(master: DataFrame, origins: DataFrame) -> DataFrame:
    """Every (origin, item) pair. Origins are at most a few dozen dates, carried as one array per row."""
    dates = origins.agg(F.sort_array(F.collect_set("origin_date")).alias("o")).scalar()
    return master.select("SKU").withColumn("origin_date", F.explode(dates))


def join_static_params(
    df: DataFrame, snapshots: DataFrame, mode: str = "first", date: str = "snapshot_date",
    columns: Sequence[str] = ("Lead_Time_Days", "Safety_Stock", "Reorder_Point"),
) -> DataFrame:
    """Attach per-item parameters taken from the item's first (``first``) or last (``last``) snapshot."""
    pick = {"first": F.min_by, "last": F.max_by}[mode]
    static = snapshots.groupBy("SKU").agg(*[pick(c, date).alias(c) for c in columns])
    return df.join(static, "SKU", "left")


def select_snapshot_origin(snapshots: DataFrame, requested: str | None, date: str = "Snapshot_Date") -> DataFrame:
    """The requested date if a snapshot exists, else the latest earlier one, else the earliest; latest when no request."""
    if requested is None:
        chosen = F.max(date)
    else:
        at = F.to_date(F.lit(requested))
        chosen = F.coalesce(F.max(F.when(F.col(date) <= at, F.col(date))), F.min(date))
    return snapshots.agg(chosen.alias("origin_date"), F.count_distinct(date).alias("available_dates"))
