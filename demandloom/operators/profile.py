"""Exploratory tables of the daily panel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import corrected_kurtosis, corrected_skewness, ratio
from ..sources.checkpoints import cut_lineage
from .metrics import equal_width_bin
from .ordered import quantiles, rank_min
from .prepare import price_tier_quantile
from .quality import stack_metrics
from .timegrid import weekly_iso

# Class limits and outlier rules of the published profile.
ADI_LIMIT, CV2_LIMIT = 1.32, 0.49
IQR_FACTOR, SIGMA_FACTOR = 3.0, 3.5
QUANTILES = {"q01": 0.01, "q05": 0.05, "q10": 0.10, "q25": 0.25, "q50": 0.50, "q75": 0.75, "q90": 0.90, "q95": 0.95, "q99": 0.99}


def profile_dataset(df: DataFrame) -> DataFrame:
    """Size, key and null statistics as (metric, value) rows, two passes in all."""
    dup = df.groupBy("SKU", "Date").agg(F.count(F.lit(1)).alias("n")).agg(F.sum(F.col("n") - 1)).scalar()
    nulls = {f"null_{c}": F.count_if(F.col(c).isNull()) for c in df.columns}
    one = df.agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("SKU").alias("skus"), F.count_distinct("Date").alias("dates"),
        F.unix_date(F.min("Date")).alias("lo"), F.unix_date(F.max("Date")).alias("hi"),
        *[v.alias(k) for k, v in nulls.items()],
    ).withColumn("dup", dup)
    metrics = {
        "rows": F.col("rows"), "columns": F.lit(len(df.columns)), "unique_skus": F.col("skus"),
        "unique_dates": F.col("dates"), "date_min_epoch_day": F.col("lo"), "date_max_epoch_day": F.col("hi"),
        "expected_panel_rows": F.col("skus") * F.col("dates"),
        "is_complete_panel": (F.col("skus") * F.col("dates") == F.col("rows")).cast("int"),
        "duplicate_grain_count": F.col("dup"), **{k: F.col(k) for k in nulls},
    }
    return stack_metrics(one, metrics)


def counted_moments(value: str = "Units_Sold", weight: str = "n") -> dict[str, Column]:
    """Count, total, mean, sample deviation and zero share of pre-counted values."""
    n, v = F.sum(weight), F.col(value).cast("double")
    total, squares = F.sum(v * F.col(weight)), F.sum(v * v * F.col(weight))
    spread = F.sqrt(F.greatest(F.lit(0.0), squares - total * total / n) / (n - 1))
    return {
        "count": n, "total": total.cast("bigint"), "mean": total / n, "std": F.when(n > 1, spread),
        "zero_pct": F.sum(F.when(v == 0, F.col(weight)).otherwise(0)) / n * 100,
    }


def demand_distribution(df: DataFrame, column: str = "Units_Sold") -> DataFrame:
    """Moments, exact quantiles and zero share of daily demand, one row.

    One pass counts the distinct values; everything else is computed from those counts.
    """
    counts = cut_lineage(df.groupBy(F.col(column).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n")))
    n, mean = F.sum("n"), counts.agg((F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("m")).scalar()
    d = F.col("v") - F.col("_m")

    def power(k: int) -> Column:
        return F.sum(F.pow(d, F.lit(float(k))) * F.col("n"))

    size = n.cast("double")
    g1 = F.sqrt(size) * power(3) / F.pow(power(2), F.lit(1.5))
    g2 = size * power(4) / F.pow(power(2), F.lit(2.0)) - 3.0
    spread = F.sqrt(power(2) / (size - 1))
    zeros = F.sum(F.when(F.col("v") == 0, F.col("n")).otherwise(0))
    moments = counts.withColumn("_m", mean).agg(
        F.sum(F.col("v") * F.col("n")).cast("bigint").alias("total_units"), F.max("_m").alias("mean"), spread.alias("std"),
        F.min("v").cast("bigint").alias("min"), F.max("v").cast("bigint").alias("max"),
        corrected_skewness(g1, size).alias("skewness"), corrected_kurtosis(g2, size).alias("kurtosis"),
        zeros.alias("zero_demand_count"), (zeros / n * 100).alias("zero_demand_pct"), ratio(spread, F.max("_m")).alias("cv"),
    )
    marks = quantiles(counts, "v", QUANTILES, weight="n", counted=True).select(F.struct(*QUANTILES).alias("q")).scalar()
    return moments.withColumn("_q", marks).select(
        "*", *[F.col(f"_q.{q}").alias(q) for q in QUANTILES], F.col("_q.q50").alias("median")
    ).drop("_q")


def intermittency_class(adi: Column, cv2: Column) -> Column:
    """Smooth, Intermittent, Erratic or Lumpy; an item without any demand (NULL interval) is Lumpy."""
    frequent = F.coalesce(adi < ADI_LIMIT, F.lit(False))
    sparse = F.coalesce(adi >= ADI_LIMIT, F.lit(False))
    return (
        F.when(frequent & (cv2 < CV2_LIMIT), "Smooth").when(sparse & (cv2 < CV2_LIMIT), "Intermittent")
        .when(frequent & (cv2 >= CV2_LIMIT), "Erratic").otherwise("Lumpy")
    )


def item_demand(df: DataFrame, extra: Sequence[Column] = ()) -> DataFrame:
    """Per-item totals, moments and intermittency measures (combines on the map side)."""
    u = F.col("Units_Sold").cast("double")
    sold = F.when(F.col("Units_Sold") > 0, u)
    n, nz = F.count(F.lit(1)), F.count(sold)
    spread = F.coalesce(F.stddev_samp(sold), F.lit(0.0))
    cv2 = F.when(nz > 0, F.pow(spread / F.avg(sold), F.lit(2.0))).otherwise(0.0)
    return df.groupBy("SKU").agg(
        F.sum("Units_Sold").cast("bigint").alias("Total_Units_Sold"), F.avg(u).alias("Mean_Daily_Demand"),
        F.stddev_samp(u).alias("Std_Daily_Demand"), F.min("Units_Sold").alias("Min_Daily_Demand"),
        F.max("Units_Sold").alias("Max_Daily_Demand"), F.count_if(F.col("Units_Sold") == 0).alias("Zero_Demand_Days"),
        (F.count_if(F.col("Units_Sold") == 0) / n * 100).alias("Zero_Demand_Pct"),
        F.when(F.avg(u) > 0, F.stddev_samp(u) / F.avg(u)).otherwise(0.0).alias("CV"),
        ratio(n, nz).alias("ADI"), cv2.alias("CV2"), F.sum("Revenue").alias("Total_Revenue"), *extra,
    ).withColumn("Intermittency_Class", intermittency_class(F.col("ADI"), F.col("CV2")))


def sparse_classes(df: DataFrame, periods: Column) -> DataFrame:
    """Intermittency class per item from its non-zero rows alone; ``periods`` is the length of the full grid."""
    u = F.when(F.col("Units_Sold") > 0, F.col("Units_Sold").cast("double"))
    stats = df.groupBy("SKU").agg(
        F.count(u).alias("_nz"), F.pow(ratio(F.coalesce(F.stddev_samp(u), F.lit(0.0)), F.avg(u)), F.lit(2.0)).alias("_cv2")
    ).withColumn("_n", periods)
    adi, cv2 = ratio(F.col("_n"), F.col("_nz")), F.coalesce("_cv2", F.lit(0.0))
    return stats.select("SKU", adi.alias("ADI"), cv2.alias("CV2"), intermittency_class(adi, cv2).alias("Intermittency_Class"))


def sku_demand_profile(df: DataFrame, master: DataFrame) -> DataFrame:
    """Item profile with median, master columns and the three ranks.

    The median per item reads value counts bounded by the item's number of days. The per-item table is
    checkpointed, as the ranks and the result both read it.
    """
    stats = item_demand(df, [F.percentile(F.col("Units_Sold"), 0.5).alias("Median_Daily_Demand")]).withColumns(
        {"CV": F.round("CV", 3), "Total_Revenue": F.round("Total_Revenue", 2)}
    )
    names = master.select("SKU", "Product_Name", "Category", "Subcategory", "Selling_Price", "Cost_Price", "negative_margin_flag")
    ranked = rank_min(
        cut_lineage(stats), {"Total_Units_Sold": "Volume_Rank", "Total_Revenue": "Revenue_Rank", "CV": "Variability_Rank"}
    )
    return ranked.join(names, "SKU", "left")


def temporal_patterns(panel: DataFrame) -> DataFrame:
    """Demand by weekday, weekend, month, quarter, year and season.

    The panel is read once into counts per (units, calendar cell); the grouping sets and the medians use those.
    """
    dims = {
        "Day_of_Week": F.col("day_of_week"),
        "Weekend": F.when(F.col("is_weekend") == 1, "Weekend").otherwise("Weekday"),
        "Month": F.concat(F.lit("Month_"), F.lpad(F.col("month").cast("string"), 2, "0")),
        "Quarter": F.col("quarter"), "Year": F.col("year").cast("string"), "Season": F.col("season"),
    }
    counted = cut_lineage(
        panel.groupBy("Units_Sold", *[v.alias(k) for k, v in dims.items()]).agg(F.count(F.lit(1)).alias("n"))
    )
    total = counted.agg(F.sum(F.col("Units_Sold") * F.col("n"))).scalar()
    name, level = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k in dims:
        name = F.when(F.grouping(k) == 0, k).otherwise(name)
        level = F.when(F.grouping(k) == 0, F.col(k)).otherwise(level)
    m = counted_moments()
    stats = counted.groupingSets([[F.col(k)] for k in dims], *[F.col(k) for k in dims]).agg(
        name.alias("Dimension"), level.alias("Level"), m["count"].alias("Observations"), m["total"].alias("Total_Units"),
        m["mean"].alias("Mean_Units"), m["std"].alias("Std_Units"),
    )
    pairs = F.array(*[F.struct(F.lit(k).alias("Dimension"), F.col(k).alias("Level")) for k in dims])
    medians = quantiles(
        counted.select("Units_Sold", "n", F.inline(pairs)), "Units_Sold", {"Median_Units": 0.5}, ["Dimension", "Level"], "n"
    )
    return (
        stats.drop(*dims).join(medians, ["Dimension", "Level"])
        .withColumn("Share_Pct", F.col("Total_Units") / total * 100)
        .select("Dimension", "Level", "Observations", "Total_Units", "Mean_Units", "Median_Units", "Std_Units", "Share_Pct")
    )


def weekly_vs_daily_snr(daily: DataFrame) -> DataFrame:
    """Count, mean, zero share, variation and signal-to-noise at both grains."""

    def stats(df: DataFrame, column: str, grain: str) -> DataFrame:
        u = F.col(column).cast("double")
        return df.agg(
            F.lit(grain).alias("grain"), F.count(F.lit(1)).alias("observations"), F.avg(u).alias("mean"),
            (F.count_if(u == 0) / F.count(F.lit(1)) * 100).alias("zero_pct"),
            ratio(F.stddev_samp(u), F.avg(u)).alias("cv"), ratio(F.avg(u), F.stddev_samp(u)).alias("signal_to_noise"),
        )

    return stats(daily, "Units_Sold", "daily").unionByName(stats(weekly_iso(daily), "Weekly_Units", "weekly"))


def category_summary(panel: DataFrame) -> DataFrame:
    u = F.col("Units_Sold").cast("double")
    grouped = panel.groupBy("Category", "Subcategory").agg(
        F.count_distinct("SKU").alias("SKU_Count"), F.sum("Units_Sold").cast("bigint").alias("Total_Units"),
        F.avg(u).alias("Mean_Daily_Units"), F.stddev_samp(u).alias("Std_Daily_Units"),
        F.round(F.sum("Revenue"), 2).alias("Total_Revenue"), F.avg("Price").alias("Mean_Price"),
    )
    totals = panel.agg(F.struct(F.sum("Units_Sold").alias("u"), F.sum("Revenue").alias("r")).alias("t")).scalar()
    return grouped.withColumn("_t", totals).select(
        "*", (F.col("Total_Units") / F.col("_t.u") * 100).alias("Volume_Share_Pct"),
        (F.col("Total_Revenue") / F.col("_t.r") * 100).alias("Revenue_Share_Pct"),
        ratio(F.col("Std_Daily_Units"), F.col("Mean_Daily_Units")).alias("CV"),
    ).drop("_t")


def promotion_lift(panel: DataFrame) -> DataFrame:
    """Demand with and without promotion, overall and per category, and the lift in percent; one pass over the panel."""
    counted = cut_lineage(panel.groupBy("Category", "Promotion", "Units_Sold").agg(F.count(F.lit(1)).alias("n")))
    both = F.explode(F.array(F.lit("Global"), F.concat(F.lit("Category_"), F.col("Category"))))
    scoped = counted.withColumn("Scope", both)
    m = counted_moments()
    stats = scoped.groupBy("Scope", "Promotion").agg(
        m["count"].alias("Observations"), m["total"].alias("Total_Units"), m["mean"].alias("Mean_Daily_Units"),
        m["std"].alias("Std_Daily_Units"), m["zero_pct"].alias("Zero_Demand_Pct"),
    )
    medians = quantiles(scoped, "Units_Sold", {"Median_Daily_Units": 0.5}, ["Scope", "Promotion"], "n")
    # At most two rows (with and without promotion) per scope meet in this window.
    base = F.max(F.when(F.col("Promotion") == 0, F.col("Mean_Daily_Units"))).over(W.partitionBy("Scope"))
    return (
        stats.join(medians, ["Scope", "Promotion"]).withColumn("_base", base)
        .select(
            "Scope", F.when(F.col("Promotion") == 1, "Promotion (1)").otherwise("No Promotion (0)").alias("Group"),
            "Observations", "Total_Units", "Mean_Daily_Units", "Median_Daily_Units", "Std_Daily_Units", "Zero_Demand_Pct",
            F.when(F.col("Promotion") == 0, 0.0)
            .otherwise(F.coalesce(ratio(F.col("Mean_Daily_Units") - F.col("_base"), F.col("_base")) * 100, F.lit(0.0)))
            .alias("Promotional_Lift_Pct"),
        )
    )


def price_demand(panel: DataFrame) -> DataFrame:
    """Per item: catalogue price, demand, revenue and quantile price tier."""
    per_item = panel.groupBy("SKU", "Category").agg(
        F.max("Selling_Price").alias("Price"), F.avg(F.col("Units_Sold").cast("double")).alias("Mean_Daily_Units"),
        F.sum("Units_Sold").cast("bigint").alias("Total_Units_Sold"), F.round(F.sum("Revenue"), 2).alias("Total_Revenue"),
    )
    return price_tier_quantile(per_item, "Price")


def demand_outliers(panel: DataFrame) -> DataFrame:
    """Rows far above the usual demand, with the known reasons; nothing is removed from the data."""
    counts = cut_lineage(panel.groupBy(F.col("Units_Sold").alias("v")).agg(F.count(F.lit(1)).alias("n")))
    marks = quantiles(counts, "v", {"q25": 0.25, "q75": 0.75}, weight="n", counted=True).select(F.struct("q25", "q75").alias("q")).scalar()
    m = counted_moments("v")
    spread = counts.agg((m["mean"] + SIGMA_FACTOR * m["std"]).alias("z")).scalar()
    # The labels of the published outlier report.
    reasons = F.concat_ws(
        "; ",
        F.when(F.col("Promotion") == 1, "Active_Promotion"),
        F.when(F.col("is_holiday") == 1, F.concat(F.lit("Holiday_"), F.col("holiday"))),
        F.when(F.col("is_weekend") == 1, "Weekend"),
        F.when(F.col("promotion_event").isNotNull(), F.concat(F.lit("Event_"), F.col("promotion_event"))),
    )
    limit = F.least(F.col("_q.q75") + IQR_FACTOR * (F.col("_q.q75") - F.col("_q.q25")), F.col("_z"))
    return (
        panel.withColumns({"_q": marks, "_z": spread}).filter(F.col("Units_Sold") >= limit)
        .select(
            "Date", "SKU", "Product_Name", "Category", "Units_Sold", "Price", "Revenue", "Promotion", "is_holiday", "holiday",
            "promotion_event",
            F.when(reasons != "", F.concat(F.lit("Legitimate_Event ("), reasons, F.lit(")")))
            .otherwise("Unexplained_Demand_Surge (Review Required)").alias("Context_Classification"),
        )
    )


def inventory_coverage(panel: DataFrame, quarantine: DataFrame) -> DataFrame:
    """Snapshot coverage and stock level of the aligned panel and of the quarantine."""

    def layer(df: DataFrame, name: str, has: Column) -> DataFrame:
        stock = F.when(has, F.col("Current_Stock"))
        seen = df.filter(has)
        median = quantiles(seen, "Current_Stock", {"m": 0.5}).scalar()
        return df.agg(
            F.lit(name).alias("Dataset_Layer"), F.count(F.lit(1)).alias("Total_Rows"), F.count_distinct("SKU").alias("Unique_SKUs"),
            F.count_if(has).alias("Snapshot_Observations"), (F.count_if(has) / F.count(F.lit(1)) * 100).alias("Snapshot_Coverage_Pct"),
            F.avg(stock).alias("Mean_Current_Stock"), F.avg(F.when(has, F.col("On_Order"))).alias("Mean_On_Order"),
            F.avg(F.when(has, F.col("Inventory_Value"))).alias("Mean_Inventory_Value"),
        ).withColumn("Median_Current_Stock", median)

    return layer(panel, "Master_Aligned_Panel", F.col("has_inventory_snapshot")).unionByName(
        layer(quarantine, "Inventory_Quarantine", F.lit(True))
    )


# --- chart series ----------------------------------------------------------------------------------


def daily_total_ma(daily: DataFrame, widths: tuple[int, ...] = (7, 30)) -> DataFrame:
    """Fleet units per day with trailing means; the window sees one row per day."""
    totals = daily.groupBy("Date").agg(F.sum("Units_Sold").cast("bigint").alias("Units_Sold"))
    w = W.orderBy("Date")
    return totals.withColumns({f"ma_{k}": F.avg("Units_Sold").over(w.rowsBetween(-(k - 1), 0)) for k in widths})


def monthly_total(daily: DataFrame) -> DataFrame:
    return daily.groupBy(F.date_trunc("month", "Date").cast("date").alias("month")).agg(
        F.sum("Units_Sold").cast("bigint").alias("Units_Sold")
    )


def year_month_mean(panel: DataFrame) -> DataFrame:
    return panel.groupBy("year", "month").agg(F.avg(F.col("Units_Sold").cast("double")).alias("mean_units"))


def category_totals(panel: DataFrame) -> DataFrame:
    return panel.groupBy("Category").agg(F.sum("Units_Sold").cast("bigint").alias("Units_Sold"))


def iso_week_total(daily: DataFrame) -> DataFrame:
    return weekly_iso(daily).groupBy("iso_year", "iso_week").agg(F.sum("Weekly_Units").cast("bigint").alias("Weekly_Units"))


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Equal-width histogram between the extremes."""
    span = df.agg(F.struct(F.min(column).alias("lo"), F.max(column).alias("hi")).alias("s")).scalar()
    return (
        df.filter(F.col(column).isNotNull()).withColumn("_s", span)
        .withColumn("bin", equal_width_bin(column, "_s.lo", "_s.hi", bins))
        .groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("min_value"), F.max(column).alias("max_value"))
    )


def feature_statistics(df: DataFrame) -> DataFrame:
    """Null share, distinct count and range per numeric column, from one aggregate."""
    numeric = [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "long", "integer")]
    stats = []
    for c in numeric:
        v = F.col(c).cast("double")
        stats.append(
            F.struct(
                F.lit(c).alias("feature"), (F.count_if(v.isNull()) / F.count(F.lit(1)) * 100).alias("null_pct"),
                F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
            ).alias(c)
        )
    return df.agg(*stats).select(F.inline(F.array(*[F.col(c) for c in numeric])))


def distinct_counts(df: DataFrame) -> DataFrame:
    """Exact distinct count per column: one (column, value) exchange instead of one expansion per column."""
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value")) for c in df.columns])
    values = df.select(F.inline(pairs)).filter(F.col("value").isNotNull()).distinct()
    return values.groupBy("feature").agg(F.count(F.lit(1)).alias("distinct_values"))


def data_dictionary_counts(df: DataFrame) -> DataFrame:
    """Type and missing count per column."""
    one = df.agg(*[F.count_if(F.col(f.name).isNull()).alias(f.name) for f in df.schema.fields])
    rows = [
        F.struct(F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("data_type"), F.col(f.name).alias("missing"))
        for f in df.schema.fields
    ]
    return one.select(F.inline(F.array(*rows)))


def null_percentage(df: DataFrame) -> DataFrame:
    one = df.agg(*[(F.count_if(F.col(c).isNull()) / F.count(F.lit(1)) * 100).alias(c) for c in df.columns])
    return stack_metrics(one, {c: F.col(c) for c in df.columns}, "feature", "null_pct")


def lag_correlation(features: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of every pair of lag columns, long form, one aggregate."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    one = features.agg(*[F.expr(f"corr(double({a}), double({b}))").alias(f"{a}__{b}") for a, b in pairs])
    both = [*pairs, *[(b, a) for a, b in pairs if a != b]]
    rows = [
        F.expr(f"struct('{a}' AS lag_a, '{b}' AS lag_b, {a}__{b} AS r)" if (a, b) in pairs else f"struct('{a}' AS lag_a, '{b}' AS lag_b, {b}__{a} AS r)")
        for a, b in both
    ]
    return one.select(F.inline(F.array(*rows)))


def topk_sku_volume(daily: DataFrame, k: int = 15) -> DataFrame:
    """The ``k`` best and worst selling items (a top-k report)."""
    totals = daily.groupBy("SKU").agg(F.sum("Units_Sold").cast("bigint").alias("Total_Units"))
    best = totals.orderBy(F.desc("Total_Units"), "SKU").limit(k).withColumn("side", F.lit("top"))
    worst = totals.orderBy("Total_Units", "SKU").limit(k).withColumn("side", F.lit("bottom"))
    return best.unionByName(worst)


def representative_skus(daily: DataFrame, place: int = 25) -> DataFrame:
    """Highest volume, ``place``-th by volume (NULL with fewer items), most variable and lowest volume item."""
    stats = item_demand(daily).select("SKU", "Total_Units_Sold", F.round("CV", 9).alias("CV"))
    ends = stats.agg(
        F.min_by("SKU", F.struct(-F.col("Total_Units_Sold"), F.col("SKU"))).alias("highest_volume"),
        F.min_by("SKU", F.struct(-F.col("CV"), F.col("SKU"))).alias("most_variable"),
        F.min_by("SKU", F.struct("Total_Units_Sold", "SKU")).alias("lowest_volume"),
    )
    head = stats.orderBy(F.desc("Total_Units_Sold"), "SKU").limit(place)
    last = F.max_by("SKU", F.struct(-F.col("Total_Units_Sold"), F.col("SKU")))
    mid = head.agg(F.when(F.count(F.lit(1)) == place, last)).scalar()
    roles = ("highest_volume", "mid_volume", "most_variable", "lowest_volume")
    one = ends.withColumn("mid_volume", mid)
    return one.select(F.inline(F.array(*[F.struct(F.lit(r).alias("role"), F.col(r).alias("SKU")) for r in roles])))
