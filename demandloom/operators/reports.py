"""Fleet and single-item tables built from risk scores, recommendations and forecasts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions import ratio
from .ordered import quantiles


def filter_worklist(recs: DataFrame, rank: int | None = None, category: str | None = None, code: str | None = None) -> DataFrame:
    """Action queue; order by (priority_rank, sku) at the sink."""
    for column, value in (("priority_rank", rank), ("category", category), ("recommendation_code", code)):
        if value is not None:
            recs = recs.filter(F.col(column) == value)
    return recs.select(
        "priority_rank", "sku", "product_name", "category", "recommendation_code", "current_stock", "on_order",
        "reorder_point", "weeks_of_cover", "recommended_action", "required_follow_up",
    )


def join_risk_to_recs(recs: DataFrame, risk: DataFrame) -> DataFrame:
    """Recommendations with the risk columns the dashboards show."""
    extra = risk.select(
        F.col("SKU").alias("sku"), F.col("origin_date").cast("string").alias("origin_date"), "stockout_score", "overstock_tier",
        "action_tier", "excess_inventory_units",
    )
    return recs.join(extra, ["origin_date", "sku"], "left")


def filter_risk_roster(
    merged: DataFrame, categories: Sequence[str] = (), ranks: Sequence[int] = ()
) -> DataFrame:
    """Risk roster; order by rank, then stockout score descending, at the sink."""
    if categories:
        merged = merged.filter(F.col("category").isin(list(categories)))
    if ranks:
        merged = merged.filter(F.col("priority_rank").isin(list(ranks)))
    return merged.select(
        "sku", "product_name", "category", "current_stock", "on_order", "lead_time_days", "safety_stock", "reorder_point",
        "weeks_of_cover", "stockout_score", "earliest_stockout_week", "priority_rank",
    )


def category_posture(recs: DataFrame) -> DataFrame:
    rank = F.col("priority_rank")
    return recs.groupBy("category").agg(
        F.count("sku").alias("total_skus"), F.count_if(rank == 1).alias("p1_critical"),
        F.count_if(rank == 2).alias("p2_reorder"), F.count_if(rank == 4).alias("p4_overstock"),
        F.avg("weeks_of_cover").alias("avg_cover"),
    )


def fleet_scorecard(recs: DataFrame) -> DataFrame:
    """Counts by priority, shares, mean and exact median cover of one origin's fleet."""
    rank, n = F.col("priority_rank"), F.count(F.lit(1))
    median = quantiles(recs, "weeks_of_cover", {"m": 0.5}).scalar()
    return recs.agg(
        n.alias("total_skus"), *[F.count_if(rank == i).alias(f"p{i}_count") for i in range(1, 6)],
        (F.count_if(rank.isin(1, 2)) / n * 100).alias("stockout_pct"), (F.count_if(rank == 4) / n * 100).alias("overstock_pct"),
        (F.count_if(rank == 5) / n * 100).alias("balanced_pct"), F.avg("weeks_of_cover").alias("mean_cover"),
    ).withColumn("median_cover", median)


def breach_timing(recs: DataFrame) -> DataFrame:
    return recs.filter(F.col("earliest_stockout_week").isNotNull()).groupBy("earliest_stockout_week").agg(
        F.count(F.lit(1)).alias("sku_count")
    )


def category_forward_demand(recs: DataFrame) -> DataFrame:
    return recs.groupBy("category").agg((F.sum("avg_weekly_demand") * 8.0).alias("projected_8w_units"))


def inventory_totals(recs: DataFrame) -> DataFrame:
    return recs.agg(
        F.count(F.lit(1)).alias("n_skus"), F.sum("current_stock").alias("total_current_stock"), F.sum("on_order").alias("total_on_order")
    )


def cum_forecast(forecasts: DataFrame) -> DataFrame:
    """Running sum over the eight horizons of each (item, origin)."""
    w = W.partitionBy("SKU", "forecast_origin").orderBy("horizon").rowsBetween(W.unboundedPreceding, 0)
    return forecasts.withColumn("cum_forecast", F.sum("forecast").over(w))


def cum_share(forecasts: DataFrame) -> DataFrame:
    """Running share (percent) of the item's forward demand by horizon."""
    group = W.partitionBy("SKU", "forecast_origin")
    running = group.orderBy("horizon").rowsBetween(W.unboundedPreceding, 0)
    return forecasts.withColumn("cum_share", ratio(F.sum("forecast").over(running), F.sum("forecast").over(group)) * 100)


def tail_n(df: DataFrame, n: int = 26, date: str = "week_start", sku: str | None = None) -> DataFrame:
    """The last ``n`` periods of each item (or of one)."""
    rows = df.filter(F.col("SKU") == sku) if sku else df
    w = W.partitionBy("SKU").orderBy(F.desc(date))
    return rows.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def peak_horizon(forecasts: DataFrame) -> DataFrame:
    """Horizon with the highest forecast; the earliest one on ties."""
    return forecasts.groupBy("SKU", "forecast_origin").agg(
        F.max_by(F.struct("horizon", "forecast"), F.struct("forecast", -F.col("horizon"))).alias("p")
    ).select("SKU", "forecast_origin", F.col("p.horizon").alias("peak_horizon"), F.col("p.forecast").alias("peak_forecast"))


def forward_trajectory(forecasts: DataFrame, history: DataFrame) -> DataFrame:
    """Sum, mean, peak and drift against each item's mean weekly demand."""
    ahead = forecasts.groupBy("SKU", "forecast_origin").agg(
        F.sum("forecast").alias("cum_forward_demand"), F.avg("forecast").alias("mean_forward_demand"),
        F.max_by("horizon", F.struct("forecast", -F.col("horizon"))).alias("peak_horizon"),
    )
    base = history.groupBy("SKU").agg(F.avg(F.col("Units_Sold").cast("double")).alias("baseline"))
    drift = (F.col("mean_forward_demand") - F.col("baseline")) / F.greatest(F.lit(1.0), F.col("baseline")) * 100
    return ahead.join(base, "SKU", "left").withColumn("demand_drift_pct", drift)


def sku_dossier(recs: DataFrame, forecasts: DataFrame, sku: str | None = None) -> DataFrame:
    """Recommendation and ordered forecasts of one item (an unknown item raises) or of every item."""
    steps = forecasts.groupBy(F.col("SKU").alias("sku"), F.col("forecast_origin").cast("string").alias("origin_date")).agg(
        F.sort_array(F.collect_list(F.struct("horizon", "forecast"))).alias("s")
    )
    if sku is not None:
        known = recs.agg(F.bool_or(F.col("sku") == sku)).scalar()
        missing = F.raise_error(F.lit(f"no active recommendation for {sku}")).cast("boolean")
        recs = recs.withColumn("_known", known).filter(F.when(~F.col("_known"), missing).otherwise(F.col("sku") == sku))
    return recs.join(steps, ["sku", "origin_date"], "left").select(
        "origin_date", "sku", "product_name", "category", "recommendation_code", "priority_rank", "weeks_of_cover",
        *[F.get("s.forecast", h - 1).alias(f"forecast_h{h}") for h in range(1, 9)],
    )


def inventory_status(recs: DataFrame, risk: DataFrame) -> DataFrame:
    """Fleet stock table with score and tier taken from the risk table."""
    scores = risk.select(
        F.col("SKU").alias("sku"), F.col("origin_date").cast("string").alias("origin_date"),
        F.col("stockout_score").alias("stockout_risk_score"), "action_tier",
    )
    return recs.join(scores, ["origin_date", "sku"], "left").select(
        "sku", "product_name", "category", "current_stock", "on_order", "lead_time_days", "safety_stock", "reorder_point",
        "weeks_of_cover", "stockout_risk_score", "action_tier",
    )


def risk_status(risk: DataFrame) -> DataFrame:
    inf = float("inf")
    return risk.select(
        F.col("SKU").alias("sku"), "origin_date",
        *[F.when(F.col(c) == inf, 0.0).otherwise(F.col(c)).alias(c) for c in ("weeks_of_cover", "days_of_supply")],
        "stockout_score", "overstock_score", "overstock_tier", "action_tier", "estimated_stockout_date", "excess_inventory_value",
    )


def recommendation_status(recs: DataFrame) -> DataFrame:
    return recs.select(
        "sku", "product_name", "category", "subcategory", "recommendation_code", "recommendation_title", "priority",
        "priority_rank", "triggering_risk", "confidence_status", "required_follow_up",
    )
