"""Leakage-safe model features on the weekly panel.

All windows share ``partitionBy("SKU").orderBy(week)``, so the whole chain needs one shuffle by item. The
demand of the origin week is known; everything later is a target.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import ratio
from .prepare import join_category_median, price_tier_fixed
from .timegrid import asof_join, grid_parts, join_static_params, week_span, weekly_filled

# The published feature definitions.
HORIZON = 8
LAGS = (1, 2, 3, 4, 8, 12, 13, 26, 52)
MEAN_WINDOWS = (4, 8, 13)
STD_WINDOWS = (4, 8)
RANGE_WINDOW = 4
SMOOTHING = {"ewma_decay_03": 0.3, "ewma_decay_01": 0.1}
EPSILON = 1e-5
WEEKS_PER_YEAR = 52.1775
PROMO_WINDOWS = (4, 8)
PROMO_INTENSITY_WINDOW = 13
STALE_DAYS = 35


def by_item(date: str = "week_start") -> W:
    return W.partitionBy("SKU").orderBy(date)


def full_window(agg, column: str, width: int, date: str = "week_start", position: str | None = None) -> Column:
    """Trailing aggregate that stays NULL until ``width`` rows exist.

    A known zero-based ``position`` on a gap-free grid saves the count over the frame.
    """
    frame = by_item(date).rowsBetween(-(width - 1), 0)
    full = F.col(position) >= width - 1 if position else F.count(F.lit(1)).over(frame) == width
    return F.when(full, agg(column).over(frame))


def moving_avg_partial(column: str, width: int, window: W) -> Column:
    """Trailing mean that accepts a shorter window at the start."""
    return F.avg(column).over(window.rowsBetween(-(width - 1), 0))


def target_columns(horizon: int = HORIZON, date: str = "week_start") -> dict[str, Column]:
    return {f"target_h{h}": F.lead("Units_Sold", h).over(by_item(date)) for h in range(1, horizon + 1)}


def lag_columns(lags: Sequence[int] = LAGS, date: str = "week_start") -> dict[str, Column]:
    """``lag_1`` is the origin week itself."""
    return {f"lag_{k}": F.lag("Units_Sold", k - 1).over(by_item(date)) for k in lags}


def rolling_columns(date: str = "week_start", position: str | None = None) -> dict[str, Column]:
    def trailing(agg, width: int) -> Column:
        return full_window(agg, "Units_Sold", width, date, position)

    columns = {f"rolling_mean_{w}": trailing(F.avg, w) for w in MEAN_WINDOWS}
    columns |= {f"rolling_std_{w}": trailing(F.stddev_samp, w) for w in STD_WINDOWS}
    columns[f"rolling_min_{RANGE_WINDOW}"] = trailing(F.min, RANGE_WINDOW)
    columns[f"rolling_max_{RANGE_WINDOW}"] = trailing(F.max, RANGE_WINDOW)
    return columns


def ewma_columns(position: str, date: str = "week_start") -> dict[str, Column]:
    return {name: smoothed("Units_Sold", alpha, position, date) for name, alpha in SMOOTHING.items()}


def promo_columns(date: str = "week_start", position: str | None = None) -> dict[str, Column]:
    def total(width: int) -> Column:
        return full_window(F.sum, "promo_days", width, date, position)

    columns = {f"promo_days_last_{w}w": F.coalesce(total(w), F.lit(0)).cast("bigint") for w in PROMO_WINDOWS}
    w13 = PROMO_INTENSITY_WINDOW
    columns[f"promo_intensity_last_{w13}w"] = total(w13) / F.lit(w13 * 7.0)
    columns["promo_active_last_week"] = F.col("promo_active")
    return columns


def targets_multi_horizon(df: DataFrame, horizon: int = HORIZON, date: str = "week_start") -> DataFrame:
    return df.withColumns(target_columns(horizon, date))


def demand_lags(df: DataFrame, lags: Sequence[int] = LAGS, date: str = "week_start") -> DataFrame:
    return df.withColumns(lag_columns(lags, date))


def rolling_stats(df: DataFrame, date: str = "week_start") -> DataFrame:
    return df.withColumns(rolling_columns(date))


#: Powers of ten that decayed weights of one running sum may span; a weight one whole segment back is below any double's precision.
DECADES = 150


def segment_length(alpha: float) -> int:
    """Periods per running sum, so that powers of the decay stay inside the double range for any ``alpha`` in [0, 1]."""
    decay = 1.0 - alpha
    return max(1, int(DECADES / -math.log10(decay))) if 0 < decay < 1 else 1 << 40


def smoothed(value: str, alpha: float, position: str, date: str = "week_start") -> Column:
    """Recursive exponential smoothing seeded with the first value, for series of any length.

    The recursion unrolls to a running sum of ``a * x_k * (1-a)^(t-k)``. The sum is taken within segments whose length follows
    from ``alpha``, and the segment before brings its decayed total along; what is older weighs less than 1e-150.
    """
    if alpha == 1:
        return F.col(value).cast("double")
    decay, length = 1.0 - alpha, segment_length(alpha)
    segment = F.floor(F.col(position) / length)
    inside = (F.col(position) % length).cast("double")
    term = F.col(value) * F.when(F.col(position) == 0, F.lit(1.0)).otherwise(F.lit(alpha))
    run = F.sum(term * F.pow(F.lit(decay), -inside)).over(W.partitionBy("SKU", segment).orderBy(date).rowsBetween(W.unboundedPreceding, 0))
    ended = F.sum(term * F.pow(F.lit(decay), length - 1 - inside))
    before = F.coalesce(ended.over(W.partitionBy("SKU").orderBy(segment).rangeBetween(-1, -1)), F.lit(0.0))
    return F.pow(F.lit(decay), inside) * run + F.pow(F.lit(decay), inside + 1) * before


def ewma(df: DataFrame, date: str = "week_start") -> DataFrame:
    indexed = df.withColumn("_t", F.row_number().over(by_item(date)) - 1)
    return indexed.withColumns(ewma_columns("_t", date)).drop("_t")


def trend_ratios(df: DataFrame) -> DataFrame:
    """Momentum ratios and mean weekly change; needs rolling means and lags."""
    return df.withColumns(
        {
            "trend_ratio_4_8": F.col("rolling_mean_4") / (F.col("rolling_mean_8") + EPSILON),
            "trend_ratio_4_13": F.col("rolling_mean_4") / (F.col("rolling_mean_13") + EPSILON),
            "demand_acceleration": (F.col("lag_1") - F.col("lag_4")) / 3.0,
        }
    )


def calendar_features(df: DataFrame, date: str = "week_start") -> DataFrame:
    week = F.weekofyear(date)
    angle = F.lit(2.0 * math.pi) * week / F.lit(WEEKS_PER_YEAR)
    return df.withColumns(
        {
            "origin_week_of_year": week,
            "origin_month": F.month(date),
            "origin_quarter": F.quarter(date),
            "sin_week_annual": F.sin(angle),
            "cos_week_annual": F.cos(angle),
        }
    )


def promo_features(df: DataFrame, date: str = "week_start") -> DataFrame:
    return df.withColumns(promo_columns(date))


def price_features(df: DataFrame, master: DataFrame, date: str = "week_start") -> DataFrame:
    """Static price, margin and hierarchy columns of the item. ``master`` is the normalised item table."""
    meta = join_category_median(master).select(
        "SKU", "Category", "Subcategory", "Selling_Price", F.ln("Selling_Price").alias("log_price"),
        "Cost_Price", "Gross_Margin_Per_Unit",
        ratio(F.col("Gross_Margin_Per_Unit"), F.col("Selling_Price")).alias("margin_rate"),
        "price_vs_category_median_ratio",
        price_tier_fixed(F.col("Selling_Price")).alias("Price_Tier"),
        "negative_margin_flag", "Launch_Date",
    )
    return (
        df.join(meta, "SKU", "left")
        .withColumn("days_since_launch", F.datediff(date, "Launch_Date"))
        .drop("Launch_Date")
    )


def known_snapshots(df: DataFrame, snapshots: DataFrame, date: str, static_params: str, parts: int | None = None) -> DataFrame:
    """Latest known stock and the lead-time parameters of every (item, week)."""
    stock = ["Current_Stock", "On_Order"]
    params = ["Lead_Time_Days", "Safety_Stock", "Reorder_Point"]
    out = asof_join(df, snapshots, "SKU", date, "snapshot_date", [*stock, *params] if static_params == "asof" else stock, parts)
    return join_static_params(out, snapshots, "first") if static_params == "first" else out


def stock_columns(df: DataFrame, date: str) -> DataFrame:
    """Derived stock columns; a missing snapshot gives flags of 0 and no imputed stock."""
    age = F.datediff(date, "snapshot_date")
    return (
        df.withColumnsRenamed({"Current_Stock": "latest_known_stock", "On_Order": "latest_known_on_order"})
        .withColumns(
            {
                "days_since_inventory_snapshot": age,
                "has_inventory_snapshot_at_origin": F.coalesce(age == 0, F.lit(False)).cast("int"),
                "is_inventory_stale": F.coalesce(age > STALE_DAYS, F.lit(False)).cast("int"),
                "stock_to_trailing_demand_ratio":
                    F.col("latest_known_stock") / (F.col("rolling_mean_4") + EPSILON),
            }
        )
        .drop("snapshot_date")
    )


def inventory_features(
    df: DataFrame, snapshots: DataFrame, date: str = "week_start", static_params: str = "first"
) -> DataFrame:
    """Stock known at the origin, its age, and lead-time parameters; nothing is imputed.

    ``snapshots`` has one row per (SKU, snapshot_date). ``static_params``: ``first`` takes each item's first
    snapshot; ``asof`` takes the values known at the origin.
    """
    return stock_columns(known_snapshots(df, snapshots, date, static_params), date)


KEYS = ["SKU", "forecast_origin_date"]


def feature_table(
    daily: DataFrame, master: DataFrame, snapshots: DataFrame, static_params: str = "first", days: DataFrame | None = None
) -> DataFrame:
    """Keys, eight targets, and the feature columns in name order, for every (item, week).

    The as-of join runs on the narrow weekly panel; every window feature then comes from one further pass
    over the same partitioning by item, in as many tasks as the grid of items and weeks needs.
    """
    week = "week_start"
    parts = grid_parts(daily)
    df = known_snapshots(weekly_filled(daily, days=days, parts=parts), snapshots, week, static_params, parts)
    span = week_span(days) if days is not None else df.agg(F.min(week).alias("lo"))
    df = df.withColumn("_t", (F.datediff(week, span.select("lo").scalar()) / 7).cast("int"))
    df = df.withColumns(
        {**target_columns(), **lag_columns(), **rolling_columns(position="_t"), **ewma_columns("_t"), **promo_columns(position="_t")}
    )
    df = price_features(stock_columns(calendar_features(trend_ratios(df)), week), master)
    df = df.drop("Units_Sold", "promo_days", "promo_active", "_t").withColumnRenamed(week, "forecast_origin_date")
    targets = [f"target_h{h}" for h in range(1, HORIZON + 1)]
    features = sorted(c for c in df.columns if c not in KEYS and c not in targets)
    return df.select(*KEYS, *targets, *features)


def valid_rows(features: DataFrame) -> DataFrame:
    """Rows with a full year of history and all targets."""
    targets = [c for c in features.columns if c.startswith("target_h")]
    return features.dropna(subset=["lag_52", *targets])


def feature_names(features: DataFrame) -> list[str]:
    return [c for c in features.columns if c not in KEYS and not c.startswith("target_h")]
