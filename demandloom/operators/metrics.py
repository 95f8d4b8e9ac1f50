"""Forecast accuracy tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import ratio
from .features import HORIZON


def metric_columns(actual: str = "actual", forecast: str = "forecast") -> list[Column]:
    """WAPE (percent; NULL without demand), MAE, RMSE and the row count."""
    error = F.col(actual) - F.col(forecast)
    demand = F.sum(actual)
    return [
        F.when(demand > 0, ratio(F.sum(F.abs(error)), demand) * 100).alias("WAPE"),
        F.avg(F.abs(error)).alias("MAE"),
        F.sqrt(F.avg(error * error)).alias("RMSE"),
        F.count(F.lit(1)).alias("n_forecasts"),
    ]


def forecast_metrics(df: DataFrame, by: Sequence[str] = ("model",), forecast: str = "forecast") -> DataFrame:
    return df.dropna(subset=["actual"]).groupBy(*by).agg(*metric_columns(forecast=forecast))


def evaluate_forecasts(
    df: DataFrame,
    levels: dict[str, Sequence[str]] | None = None,
    forecast: str = "forecast",
) -> DataFrame:
    """All accuracy levels from one grouping-sets aggregate; ``level`` names the set."""
    levels = levels or {
        "overall": [], "by_sku": ["SKU"], "by_horizon": ["horizon"], "by_category": ["Category"],
        "by_intermittency": ["Intermittency_Class"],
    }
    dims = list(dict.fromkeys(c for cols in levels.values() for c in cols))
    label = F.lit(None).cast("string")
    for name, cols in levels.items():
        bits = [(F.grouping(c) == (0 if c in cols else 1)) for c in dims]
        match = bits[0]
        for b in bits[1:]:
            match = match & b
        label = F.when(match, name).otherwise(label)
    sets = [[F.col("model"), *[F.col(c) for c in cols]] for cols in levels.values()]
    return (
        df.dropna(subset=["actual"])
        .groupingSets(sets, F.col("model"), *[F.col(c) for c in dims])
        .agg(label.alias("level"), *metric_columns(forecast=forecast))
        .select("level", "model", *dims, "WAPE", "MAE", "RMSE", "n_forecasts")
    )


def macro_wape(df: DataFrame, forecast: str = "forecast") -> DataFrame:
    """Unweighted mean of the items' WAPE beside the pooled WAPE."""
    usable = df.dropna(subset=["actual"])
    per_item = usable.groupBy("model", "SKU").agg(
        F.sum(F.abs(F.col("actual") - F.col(forecast))).alias("_err"), F.sum("actual").alias("_dem")
    )
    macro = F.avg(F.when(F.col("_dem") > 0, F.col("_err") / F.col("_dem") * 100))
    micro = ratio(F.sum("_err"), F.sum("_dem")) * 100
    return per_item.groupBy("model").agg(
        macro.alias("Macro_WAPE"), micro.alias("Micro_WAPE"), (macro - micro).alias("WAPE_difference"),
        F.count(F.lit(1)).alias("n_skus"),
    )


def wape_heatmap(df: DataFrame, models: Sequence[str]) -> DataFrame:
    """Per-item WAPE, one column per model."""
    err = F.abs(F.col("actual") - F.col("forecast"))
    aggs = []
    for m in models:
        mine = F.col("model") == m
        demand = F.sum(F.when(mine, F.col("actual")))
        aggs.append(F.when(demand > 0, F.sum(F.when(mine, err)) / demand * 100).alias(m))
    return df.dropna(subset=["actual"]).groupBy("SKU").agg(*aggs)


def forecast_totals_by_week(df: DataFrame) -> DataFrame:
    return df.groupBy("model", "target_week").agg(
        F.sum("forecast").alias("forecast_total"), F.sum("actual").alias("actual_total")
    )


def residual_histogram(df: DataFrame, bins: int = 40, prediction: str = "forecast") -> DataFrame:
    """Counts of ``actual - prediction`` in equal-width bins between each model's extremes."""
    rows = df.dropna(subset=["actual"]).select("model", (F.col("actual") - F.col(prediction)).alias("residual"))
    span = rows.groupBy("model").agg(F.min("residual").alias("lo"), F.max("residual").alias("hi"))
    binned = rows.join(F.broadcast(span), "model").withColumn("bin", equal_width_bin("residual", "lo", "hi", bins))
    return binned.groupBy("model", "bin").agg(F.count(F.lit(1)).alias("n"))


def equal_width_bin(value: str, lo: str, hi: str, bins: int) -> Column:
    """One-based bin; the upper edge belongs to the last bin, a zero-width range to the first."""
    place = F.floor(F.try_divide((F.col(value) - F.col(lo)) * bins, F.col(hi) - F.col(lo))) + 1
    return F.coalesce(F.least(place, F.lit(bins)), F.lit(1)).cast("int")


def select_architecture(horizon_metrics: DataFrame, priority: Sequence[str], benchmark: str = "seasonal_naive") -> DataFrame:
    """Best model per horizon; equal WAPE goes to the model listed first."""
    rank = F.array_position(F.array(*[F.lit(m) for m in priority]), F.col("model"))
    best = F.min_by("model", F.struct("WAPE", rank.alias("r")))
    bench = F.max(F.when(F.col("model") == benchmark, F.col("WAPE")))
    challenger = F.min(F.when(F.col("model") != benchmark, F.col("WAPE")))
    return (
        horizon_metrics.filter(F.col("model").isin(list(priority)))
        .groupBy("horizon")
        .agg(
            best.alias("selected_model"), F.min("WAPE").alias("validation_micro_wape"),
            bench.alias("benchmark_wape"), challenger.alias("best_challenger_wape"),
        )
        .withColumn("validation_delta", F.col("validation_micro_wape") - F.col("benchmark_wape"))
        .withColumn(
            "selection_reason",
            F.when(F.col("validation_delta") < 0, "challenger beats benchmark").otherwise("benchmark kept"),
        )
    )


def architecture_at(forecasts: DataFrame, origin, priority: Sequence[str], benchmark: str = "seasonal_naive", horizon: int = HORIZON) -> DataFrame:
    """The model that serves each horizon at ``origin``, chosen by what was known then: earlier origins, target weeks up to it.

    A horizon that no earlier origin can judge is served by the benchmark, and ``selection_reason`` says so. ``version`` is a digest of the whole map.
    """
    at = F.lit(origin).cast("date")
    known = forecasts.where((F.col("forecast_origin") < at) & (F.col("target_week") <= at))
    chosen = select_architecture(forecast_metrics(known, ["model", "horizon"]), priority, benchmark)
    every = forecasts.sparkSession.range(1, horizon + 1, numPartitions=1).select(F.col("id").cast("int").alias("horizon"))
    served = every.join(chosen, "horizon", "left").withColumns({
        "selected_model": F.coalesce("selected_model", F.lit(benchmark)),
        "selection_reason": F.coalesce("selection_reason", F.lit("no earlier origin")),
        "forecast_origin": at,
    })
    # One row per horizon reaches this window.
    entries = F.sort_array(F.collect_list(F.struct("horizon", "selected_model")).over(W.partitionBy("forecast_origin")))
    text = F.concat_ws(",", F.transform(entries, lambda e: F.concat_ws(":", e["horizon"].cast("string"), e["selected_model"])))
    return served.withColumn("version", F.substring(F.sha2(text, 256), 1, 12))


def argmin_config(trials: DataFrame) -> DataFrame:
    """Best trial per (model, horizon); the earliest trial wins ties."""
    return trials.groupBy("model", "horizon").agg(
        F.min_by(F.struct("trial_id", "config", "WAPE"), F.struct("WAPE", "trial_id")).alias("best")
    ).select("model", "horizon", "best.*")


def final_scorecards(df: DataFrame, candidate: str, benchmark: str) -> DataFrame:
    """Candidate against benchmark by item: WAPE of both and the difference."""
    wide = wape_heatmap(df, [candidate, benchmark])
    return wide.select(
        "SKU", F.col(candidate).alias("candidate_wape"), F.col(benchmark).alias("benchmark_wape"),
        (F.col(candidate) - F.col(benchmark)).alias("wape_delta"),
    )


def tuned_vs_untuned(tuned: DataFrame, untuned: DataFrame) -> DataFrame:
    return (
        tuned.select("model", "horizon", F.col("WAPE").alias("tuned_wape"))
        .join(untuned.select("model", "horizon", F.col("WAPE").alias("untuned_wape")), ["model", "horizon"])
        .withColumn("improvement", F.col("untuned_wape") - F.col("tuned_wape"))
    )


def actual_vs_prediction(df: DataFrame, models: Sequence[str], sku: str | None = None, horizon: int = 1) -> DataFrame:
    """Series at one horizon, models side by side, of one item or of all items."""
    rows = df.filter(F.col("SKU") == sku) if sku else df
    return (
        rows.filter(F.col("horizon") == horizon)
        .groupBy("SKU", "target_week", "actual").pivot("model", list(models)).agg(F.max("forecast"))
    )
