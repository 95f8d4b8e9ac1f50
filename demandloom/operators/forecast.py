"""Rolling origins and statistical baselines, evaluated for every origin in one plan.

On a gap-free weekly grid each baseline at origin ``t`` is a window value at the row of week ``t``, so the
forecasts of all origins come from one pass: no loop over origins, no history join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import half_even
from .features import by_item, moving_avg_partial, smoothed

# Published experiment settings.
HORIZON = 8
SEASON = 52
FOLDS = 12
MIN_TRAIN = 52
HOLDOUT = 8
SES_ALPHA = 0.3
MODELS = ("seasonal_naive", "naive", "ma4", "ma8", "ses")


def rolling_origins(
    weekly: DataFrame, n_folds: int = FOLDS, min_train: int = MIN_TRAIN, horizon: int = HORIZON,
    holdout: int = HOLDOUT, week: str = "week_start",
) -> DataFrame:
    """Evenly spaced forecast origins (at most ``n_folds`` rows). Too short a history raises.

    The grid has no gaps, so first and last week fix every index; one aggregate row is all that is read.
    """
    first = min_train - 1
    last = F.col("n") - holdout - horizon
    folds = F.least(F.lit(n_folds), last - first + 1)
    spot = half_even(
        F.lit(first) + F.col("i") * (last - first).cast("double") / F.greatest(F.col("k") - 1, F.lit(1))
    ).cast("int")
    return (
        weekly.agg(F.min(week).alias("lo"), F.max(week).alias("hi"))
        .withColumn("n", (F.datediff("hi", "lo") / 7).cast("int") + 1)
        .withColumn(
            "k", F.when(last > first, folds).otherwise(F.raise_error(F.lit("history too short")).cast("int"))
        )
        .withColumn("i", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
        .select(F.date_add("lo", spot * 7).alias("forecast_origin"))
        .distinct()
    )


def holdout_weeks(weekly: DataFrame, n: int = HOLDOUT, week: str = "week_start") -> DataFrame:
    """The last ``n`` weeks of the grid."""
    return weekly.agg(F.max(week).alias("hi")).select(
        F.explode(F.sequence(F.date_sub("hi", 7 * (n - 1)), F.col("hi"), F.expr("INTERVAL 7 DAYS"))).alias("week_start")
    )


def history_to_origin(weekly: DataFrame, origins: DataFrame) -> DataFrame:
    """All weeks an origin may look at: ``week_start <= forecast_origin``."""
    dates = origins.agg(F.sort_array(F.collect_set("forecast_origin")).alias("o")).scalar()
    return (
        weekly.withColumn("_o", dates)
        .withColumn("forecast_origin", F.explode(F.filter("_o", lambda o: o >= F.col("week_start"))))
        .drop("_o")
    )


def _seasonal(h: int, window: W, season: int) -> Column:
    history_mean = F.avg("Units_Sold").over(window.rowsBetween(W.unboundedPreceding, 0))
    return F.coalesce(F.lag("Units_Sold", season - h).over(window).cast("double"), history_mean)


def _model_column(model: str, h: int, window: W, season: int = SEASON) -> Column:
    if model == "seasonal_naive":
        return _seasonal(h, window, season)
    if model == "naive":
        return F.col("Units_Sold").cast("double")
    if model == "ses":
        return smoothed("Units_Sold", SES_ALPHA, "_t")
    if model.startswith("ma"):
        return moving_avg_partial("Units_Sold", int(model[2:]), window)
    raise ValueError(f"unknown model {model!r}")


def baseline_forecasts(
    weekly: DataFrame,
    origins: DataFrame,
    models: Sequence[str] = MODELS,
    horizon: int = HORIZON,
    meta: Sequence[str] = (),
) -> DataFrame:
    """Forecast and actual per (SKU, forecast_origin, horizon, model)."""
    w = by_item()
    columns: dict[str, Column] = {}
    for m in models:
        for h in range(1, horizon + 1) if m == "seasonal_naive" else (0,):
            columns[f"{m}_{h}"] = _model_column(m, h, w)
    columns |= {f"actual_{h}": F.lead("Units_Sold", h).over(w).cast("double") for h in range(1, horizon + 1)}
    at_week = weekly.withColumn("_t", F.row_number().over(w) - 1).withColumns(columns)
    at_origin = at_week.join(origins.withColumnRenamed("forecast_origin", "week_start"), "week_start", "left_semi")

    def step(h: int) -> Column:
        values = [
            F.struct(F.lit(m).alias("model"), F.col(f"{m}_{h if m == 'seasonal_naive' else 0}").alias("forecast"))
            for m in models
        ]
        return F.struct(
            F.lit(h).alias("horizon"), F.col(f"actual_{h}").alias("actual"), F.array(*values).alias("f")
        )

    return (
        at_origin.select(
            "SKU", F.col("week_start").alias("forecast_origin"), *meta,
            F.inline(F.array(*[step(h) for h in range(1, horizon + 1)])),
        )
        .select("*", F.inline("f"))
        .select(
            "SKU", "forecast_origin",
            F.date_add("forecast_origin", F.col("horizon") * 7).alias("target_week"),
            "horizon", "model", "forecast", "actual", *meta,
        )
    )


def join_forecast_actuals(forecasts: DataFrame, weekly: DataFrame) -> DataFrame:
    """Attach the observed units of the target week (NULL beyond the history)."""
    actuals = weekly.select(
        "SKU", F.col("week_start").alias("target_week"), F.col("Units_Sold").cast("double").alias("actual")
    )
    return forecasts.join(actuals, ["SKU", "target_week"], "left")


def union_forecasts(*parts: DataFrame) -> DataFrame:
    """Forecasts of several models, or predictions and their benchmarks, under each other; a column that a part lacks is NULL there."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def semi_eval_origins(df: DataFrame, origins: DataFrame, column: str = "forecast_origin") -> DataFrame:
    return df.join(origins.select(F.col("forecast_origin").alias(column)), column, "left_semi")


def hybrid_assemble(forecasts: DataFrame, architecture: DataFrame) -> DataFrame:
    """Keep, per horizon, the rows of the selected model. The map has one row per horizon."""
    chosen = architecture.select("horizon", F.col("selected_model").alias("model"))
    return forecasts.join(F.broadcast(chosen), ["horizon", "model"], "left_semi")


def latest_origin_rows(df: DataFrame, column: str = "forecast_origin", model_prefix: str | None = None) -> DataFrame:
    latest = df.agg(F.max(column)).scalar()
    out = df.filter(F.col(column) == latest)
    return out.filter(F.col("model").startswith(model_prefix)) if model_prefix else out


def select_origin_slice(
    df: DataFrame, origin: str | None = None, skus: Sequence[str] | None = None, column: str = "forecast_origin"
) -> DataFrame:
    """Rows of one origin (latest when not given). An origin that does not occur raises."""
    if origin is None:
        out = latest_origin_rows(df, column)
    else:
        at = F.to_date(F.lit(origin))
        known = df.agg(F.coalesce(F.bool_or(F.col(column) == at), F.lit(False)).alias("k")).scalar()
        out = df.filter(
            F.when(known, F.col(column) == at)
            .otherwise(F.raise_error(F.lit(f"unknown forecast origin {origin}")).cast("boolean"))
        )
    return out.filter(F.col("SKU").isin(list(skus))) if skus else out


def forecast_records(forecasts: DataFrame) -> DataFrame:
    """Forecasts in the published record layout; the bounds are not estimated."""
    return forecasts.select(
        F.col("forecast_origin").alias("origin_date"), F.col("SKU").alias("sku"),
        F.col("horizon").alias("horizon_step"), F.col("target_week").alias("target_date"),
        F.greatest(F.lit(0.0), F.col("forecast")).alias("units_forecast"),
        F.lit(None).cast("double").alias("lower_bound"), F.lit(None).cast("double").alias("upper_bound"),
        F.col("model").alias("model_used"),
    )
