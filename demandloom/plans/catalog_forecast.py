"""Registered queries: origins, baselines, accuracy tables, models."""

from __future__ import annotations

import json
from dataclasses import asdict, replace

from pyspark.sql import functions as F

from ..operators import features as feat
from ..operators import forecast, linear, metrics, ml, reports, trees
from .context import work_dir
from .oracle_tables import METRICS
from .registry import query


@query("rolling_origins", "SELECT * FROM t_origins")
def _(c):
    return c.origins


@query("holdout_weeks", "SELECT week_start FROM t_weeks ORDER BY week_start DESC LIMIT 8")
def _(c):
    return forecast.holdout_weeks(c.weekly)


@query("history_to_origin", "SELECT SKU, week_start, Units_Sold, forecast_origin FROM t_weekly JOIN t_origins ON week_start <= forecast_origin")
def _(c):
    return forecast.history_to_origin(c.weekly.select("SKU", "week_start", "Units_Sold"), c.origins)


def _baseline(name: str, *models: str) -> None:
    listed = ", ".join(f"'{m}'" for m in models)

    @query(name, f"SELECT * FROM t_fc WHERE model IN ({listed})", "forecast")
    def _(c):
        return forecast.baseline_forecasts(c.weekly, c.origins, models)


_baseline("fc_naive", "naive")
_baseline("fc_seasonal_naive", "seasonal_naive")
_baseline("fc_moving_average", "ma4", "ma8")
_baseline("fc_ses", "ses")


@query("baseline_forecasts", "SELECT * FROM t_fcm", "forecast")
def _(c):
    return c.forecasts_meta


@query("union_forecasts", "SELECT * FROM t_fc", "forecast")
def _(c):
    """All five baselines, each forecast by itself at every origin; ``_backtest`` unites them with the trained models."""
    return forecast.union_forecasts(*[forecast.baseline_forecasts(c.weekly, c.origins, [m]) for m in forecast.MODELS])


@query("hybrid_assemble", "SELECT f.* FROM t_fc f JOIN t_arch a ON f.horizon = a.horizon AND f.model = a.selected_model", "forecast")
def _(c):
    arch = metrics.select_architecture(metrics.forecast_metrics(c.forecasts, ["model", "horizon"]), forecast.MODELS)
    return forecast.hybrid_assemble(c.forecasts, arch)


@query("latest_origin_rows", "SELECT * FROM t_fc WHERE forecast_origin = (SELECT max(forecast_origin) FROM t_fc) AND model LIKE 'ma%'", "forecast")
def _(c):
    return forecast.latest_origin_rows(c.forecasts, model_prefix="ma")


@query(
    "forecast_records",
    """SELECT forecast_origin AS origin_date, SKU AS sku, horizon AS horizon_step, target_week AS target_date, greatest(forecast, 0) AS units_forecast,
    CAST(NULL AS DOUBLE) AS lower_bound, CAST(NULL AS DOUBLE) AS upper_bound, model AS model_used FROM t_sn""",
    "units_forecast",
)
def _(c):
    return forecast.forecast_records(c.seasonal)


@query(
    "forecast_totals_by_week",
    "SELECT model, target_week, sum(forecast) AS forecast_total, sum(actual) AS actual_total FROM t_fc GROUP BY 1, 2",
    "forecast_total:4 actual_total",
)
def _(c):
    return metrics.forecast_totals_by_week(c.forecasts)


# --- accuracy ----------------------------------------------------------------------------------------

_M = "WAPE MAE RMSE"


@query("forecast_metrics", f"SELECT model, horizon, {METRICS} FROM t_fc WHERE actual IS NOT NULL GROUP BY 1, 2", _M)
def _(c):
    return metrics.forecast_metrics(c.forecasts, ["model", "horizon"])


def _levels(table: str, levels: dict[str, list[str]], dims: list[str]) -> str:
    parts = []
    for name, cols in levels.items():
        shown = ", ".join(d if d in cols else f"CAST(NULL AS {'INTEGER' if d == 'horizon' else 'VARCHAR'}) AS {d}" for d in dims)
        group = ", ".join(["model", *cols])
        parts.append(f"SELECT '{name}' AS level, model, {shown}, {METRICS} FROM {table} WHERE actual IS NOT NULL GROUP BY {group}")
    return " UNION ALL ".join(parts)


_LEVELS = {"overall": [], "by_sku": ["SKU"], "by_horizon": ["horizon"], "by_category": ["Category"], "by_intermittency": ["Intermittency_Class"]}


@query("evaluate_forecasts", _levels("t_fcm", _LEVELS, ["SKU", "horizon", "Category", "Intermittency_Class"]), _M)
def _(c):
    return metrics.evaluate_forecasts(c.forecasts_meta)


_ML_LEVELS = {"summary": [], "by_horizon": ["horizon"], "by_sku": ["SKU"], "by_category": ["Category"]}


@query("evaluate_models", _levels("t_fcm", _ML_LEVELS, ["horizon", "SKU", "Category"]), _M)
def _(c):
    return metrics.evaluate_forecasts(c.forecasts_meta, _ML_LEVELS)


@query(
    "macro_wape",
    """SELECT model, avg(CASE WHEN d > 0 THEN e / d * 100 END) AS Macro_WAPE, sum(e) / sum(d) * 100 AS Micro_WAPE,
    avg(CASE WHEN d > 0 THEN e / d * 100 END) - sum(e) / sum(d) * 100 AS WAPE_difference, count(*) AS n_skus
    FROM (SELECT model, SKU, sum(abs(actual - forecast)) AS e, sum(actual) AS d FROM t_fc WHERE actual IS NOT NULL GROUP BY 1, 2) GROUP BY model""",
    "Macro_WAPE Micro_WAPE WAPE_difference",
)
def _(c):
    return metrics.macro_wape(c.forecasts)


def _wape(model: str) -> str:
    return f"sum(abs(actual - forecast)) FILTER (model = '{model}') / nullif(sum(actual) FILTER (model = '{model}'), 0) * 100"


@query("wape_heatmap", "SELECT SKU, " + ", ".join(f"{_wape(m)} AS {m}" for m in forecast.MODELS) + " FROM t_fc WHERE actual IS NOT NULL GROUP BY SKU", " ".join(forecast.MODELS))
def _(c):
    return metrics.wape_heatmap(c.forecasts, forecast.MODELS)


@query("model_vs_benchmark_by_sku", f"SELECT SKU, {_wape('ses')} AS ses, {_wape('seasonal_naive')} AS seasonal_naive FROM t_fc WHERE actual IS NOT NULL GROUP BY SKU", "ses seasonal_naive")
def _(c):
    return metrics.wape_heatmap(c.forecasts, ["ses", "seasonal_naive"])


@query(
    "final_scorecards",
    f"SELECT SKU, {_wape('ma8')} AS candidate_wape, {_wape('seasonal_naive')} AS benchmark_wape, {_wape('ma8')} - {_wape('seasonal_naive')} AS wape_delta FROM t_fc WHERE actual IS NOT NULL GROUP BY SKU",
    "candidate_wape benchmark_wape wape_delta",
)
def _(c):
    return metrics.final_scorecards(c.forecasts, "ma8", "seasonal_naive")


@query(
    "select_architecture",
    """SELECT *, validation_micro_wape - benchmark_wape AS validation_delta,
    CASE WHEN validation_micro_wape - benchmark_wape < 0 THEN 'challenger beats benchmark' ELSE 'benchmark kept' END AS selection_reason FROM t_arch""",
    "validation_micro_wape benchmark_wape best_challenger_wape validation_delta",
)
def _(c):
    return metrics.select_architecture(metrics.forecast_metrics(c.forecasts, ["model", "horizon"]), forecast.MODELS)


@query("argmin_model", "SELECT horizon, selected_model, validation_micro_wape FROM t_arch", "validation_micro_wape")
def _(c):
    table = metrics.select_architecture(metrics.forecast_metrics(c.forecasts, ["model", "horizon"]), forecast.MODELS)
    return table.select("horizon", "selected_model", "validation_micro_wape")


_TRIALS = """SELECT 'ma' AS model, horizon, CASE model WHEN 'ma4' THEN 0 ELSE 1 END AS trial_id, model AS config,
    sum(abs(actual - forecast)) / sum(actual) * 100 AS WAPE FROM t_fc WHERE model IN ('ma4', 'ma8') AND actual IS NOT NULL GROUP BY horizon, model"""


@query(
    "argmin_config",
    f"SELECT model, horizon, arg_min(trial_id, w) AS trial_id, arg_min(config, w) AS config, min(WAPE) AS WAPE FROM (SELECT *, {{'a': WAPE, 'b': trial_id}} AS w FROM ({_TRIALS})) GROUP BY 1, 2",
    "WAPE",
)
def _(c):
    scored = metrics.forecast_metrics(forecast.baseline_forecasts(c.weekly, c.origins, ["ma4", "ma8"]), ["model", "horizon"])
    trials = scored.select(
        F.lit("ma").alias("model"), "horizon", F.when(F.col("model") == "ma4", 0).otherwise(1).alias("trial_id"), F.col("model").alias("config"), "WAPE"
    )
    return metrics.argmin_config(trials)


@query(
    "tuned_vs_untuned",
    """SELECT 'ma' AS model, horizon, max(WAPE) FILTER (model = 'ma4') AS tuned_wape, max(WAPE) FILTER (model = 'ma8') AS untuned_wape,
    max(WAPE) FILTER (model = 'ma8') - max(WAPE) FILTER (model = 'ma4') AS improvement FROM t_hm GROUP BY horizon""",
    "tuned_wape untuned_wape improvement",
)
def _(c):
    scored = metrics.forecast_metrics(c.forecasts, ["model", "horizon"])

    def only(m: str):
        return scored.filter(F.col("model") == m).withColumn("model", F.lit("ma"))

    return metrics.tuned_vs_untuned(only("ma4"), only("ma8"))


@query(
    "actual_vs_prediction",
    "SELECT SKU, target_week, actual, max(forecast) FILTER (model = 'naive') AS naive, max(forecast) FILTER (model = 'ses') AS ses FROM t_fc WHERE horizon = 1 GROUP BY 1, 2, 3",
    "naive ses",
)
def _(c):
    return metrics.actual_vs_prediction(c.forecasts, ["naive", "ses"])


# --- forward series ----------------------------------------------------------------------------------


@query(
    "cum_forecast",
    "SELECT *, sum(forecast) OVER (PARTITION BY SKU, forecast_origin ORDER BY horizon) AS cum_forecast FROM t_sn",
    "forecast cum_forecast",
)
def _(c):
    return reports.cum_forecast(c.seasonal)


@query(
    "cum_share",
    """SELECT SKU, forecast_origin, horizon, sum(forecast) OVER (PARTITION BY SKU, forecast_origin ORDER BY horizon) / nullif(sum(forecast) OVER (PARTITION BY SKU, forecast_origin), 0) * 100 AS cum_share FROM t_sn""",
    "cum_share",
)
def _(c):
    return reports.cum_share(c.seasonal).select("SKU", "forecast_origin", "horizon", "cum_share")


@query("tail_n", "SELECT SKU, week_start, Units_Sold FROM t_weekly WHERE week_start > (SELECT max(week_start) FROM t_weeks) - 182")
def _(c):
    return reports.tail_n(c.weekly.select("SKU", "week_start", "Units_Sold"), 26)


_PEAK = """SELECT SKU, forecast_origin, arg_max(horizon, k) AS peak_horizon, max(forecast) AS peak_forecast, sum(forecast) AS s, avg(forecast) AS m
    FROM (SELECT *, {'a': forecast, 'b': -horizon} AS k FROM t_sn) GROUP BY 1, 2"""


@query("peak_horizon", f"SELECT SKU, forecast_origin, peak_horizon, peak_forecast FROM ({_PEAK})", "peak_forecast")
def _(c):
    return reports.peak_horizon(c.seasonal)


@query(
    "forward_trajectory",
    f"""SELECT p.SKU, forecast_origin, s AS cum_forward_demand, m AS mean_forward_demand, peak_horizon, b AS baseline, (m - b) / greatest(1, b) * 100 AS demand_drift_pct
    FROM ({_PEAK}) p LEFT JOIN (SELECT SKU, avg(Units_Sold) AS b FROM t_weekly GROUP BY SKU) h ON p.SKU = h.SKU""",
    "cum_forward_demand mean_forward_demand baseline demand_drift_pct",
)
def _(c):
    return reports.forward_trajectory(c.seasonal, c.weekly)


# --- Models ------------------------------------------------------------------------------------------

#: Own grid: least squares, and ridges from 1e-4 to 1e4 in quarter decades.
RIDGES = (0.0, *[round(10.0 ** (k / 4), 10) for k in range(-16, 17)])
VALIDATION_ORIGINS = 4


def _boosted(loss: str, rate: float, least_rows: int, row_share: float, column_share: float, l1: float, l2: float, **size) -> trees.Growth:
    return trees.Growth(loss=loss, rate=rate, least_rows=least_rows, row_share=row_share, column_share=column_share, l1=l1, l2=l2, **size)


def _forest(depth: int, least_split: int, least_rows: int, column_share: float) -> trees.Growth:
    return replace(trees.FAMILIES["random_forest"], depth=depth, least_split=least_split, least_rows=least_rows, column_share=column_share)


#: Depth that trees with a number of leaves may reach.
LEAF_WISE_DEPTH = 10
# The published grids (loss, rate, rows in a leaf, shares of rows and predictors, L1, L2, leaves or depth; forests: depth, rows to split,
# rows in a leaf, share of predictors).
GRIDS = {
    "gbt_leaf_wise": [
        _boosted(*x, depth=LEAF_WISE_DEPTH, leaves=leaves)
        for *x, leaves in (
            ("squared", 0.05, 20, 0.8, 0.8, 0.0, 0.0, 31), ("absolute", 0.05, 20, 0.8, 0.8, 0.0, 0.0, 31), ("absolute", 0.03, 25, 0.8, 0.8, 0.5, 0.5, 31),
            ("absolute", 0.04, 25, 0.75, 0.75, 0.5, 1.0, 20), ("squared", 0.04, 25, 0.75, 0.75, 0.5, 1.0, 20), ("absolute", 0.03, 30, 0.7, 0.7, 1.0, 1.0, 15),
            ("squared", 0.03, 30, 0.7, 0.7, 1.0, 1.0, 15), ("absolute", 0.03, 35, 0.7, 0.65, 1.5, 2.0, 10), ("absolute", 0.02, 40, 0.7, 0.6, 2.0, 2.0, 7),
            ("squared", 0.02, 40, 0.7, 0.6, 2.0, 2.0, 7), ("absolute", 0.02, 30, 0.8, 0.7, 1.0, 1.0, 15), ("absolute", 0.06, 20, 0.85, 0.85, 0.2, 0.2, 25),
        )
    ],
    "gbt_level_wise": [
        _boosted(*x, depth=depth)
        for *x, depth in (
            ("squared", 0.05, 1, 0.8, 0.8, 0.0, 1.0, 6), ("absolute", 0.05, 1, 0.8, 0.8, 0.0, 1.0, 6), ("absolute", 0.04, 2, 0.8, 0.75, 0.5, 1.0, 5),
            ("absolute", 0.03, 3, 0.75, 0.7, 1.0, 1.5, 4), ("squared", 0.03, 3, 0.75, 0.7, 1.0, 1.5, 4), ("absolute", 0.03, 4, 0.7, 0.65, 1.5, 2.0, 3),
            ("squared", 0.03, 4, 0.7, 0.65, 1.5, 2.0, 3), ("absolute", 0.02, 5, 0.7, 0.6, 2.0, 3.0, 3), ("absolute", 0.02, 3, 0.8, 0.7, 1.0, 1.0, 4),
            ("absolute", 0.06, 2, 0.85, 0.85, 0.2, 0.5, 6), ("squared", 0.06, 2, 0.85, 0.85, 0.2, 0.5, 5), ("absolute", 0.04, 2, 0.8, 0.8, 0.5, 1.0, 4),
        )
    ],
    "random_forest": [
        _forest(*x)
        for x in (
            (15, 2, 1, 1.0), (12, 4, 2, 0.8), (10, 5, 2, 0.8), (10, 6, 3, 0.7), (8, 8, 3, 0.7), (8, 10, 4, 0.6), (6, 10, 4, 0.6), (6, 12, 5, 0.5),
            (5, 15, 6, 0.5), (12, 3, 1, 0.75),
        )
    ],
}
_ROW = ["model", "SKU", "forecast_origin_date", "horizon", "target_date", "actual", "prediction"]
#: Origins at which a target eight weeks ahead of a row with 52 weeks of history is known, as ``ml.usable_origins`` finds them.
_USABLE = "(SELECT forecast_origin FROM t_origins WHERE forecast_origin >= (SELECT min(week_start) FROM t_weeks) + 413)"
_HORIZONS = "(SELECT CAST(unnest(range(1, 9)) AS INTEGER) AS horizon)"


def _last_origins(c, n: int) -> list:
    """The last ``n`` of the at most twelve rolling origins."""
    return sorted(r[0] for r in c.origins.collect())[-n:]


def _usable_origins(c, table) -> list:
    return ml.usable_origins(table, [r[0] for r in c.origins.collect()])


def _saved_features(c):
    """Features written once, since every fit reads them again."""
    path = f"{work_dir(c.spark)}/features"
    c.features.write.mode("overwrite").parquet(path)
    return c.spark.read.parquet(path)


def _encoded(table):
    """The saved features with their numeric predictors, and the names of these."""
    step = ml.encoder(table, feat.feature_names(table))
    return step.transform(table), step.get_feature_names()


def _tree_backtest(c, family: str, table=None, origins=None):
    """Predictions of every usable origin and horizon; all trees of the family are grown side by side."""
    table = _saved_features(c) if table is None else table
    rows, names = _encoded(table)
    growth = trees.FAMILIES[family]
    found, borders = trees.grow_trees(rows, names, _usable_origins(c, table) if origins is None else origins, growth)
    return trees.predict_trees(rows, names, found, borders, growth, family)


def _one_model(name: str, family: str) -> None:
    @query(name)
    def _(c):
        return _tree_backtest(c, family).select(_ROW)


@query(
    "tree_start",
    f"""SELECT forecast_origin AS forecast_origin_date, horizon, count(*) AS n_train, avg(CAST(t.Units_Sold AS DOUBLE)) AS mean_target
    FROM {_USABLE} AS o, {_HORIZONS} AS h, t_weekly AS w, t_weekly AS t
    WHERE w.week_start >= (SELECT min(week_start) FROM t_weeks) + 357 AND w.week_start <= o.forecast_origin - 7 * h.horizon
    AND t.SKU = w.SKU AND t.week_start = w.week_start + 7 * h.horizon GROUP BY 1, 2""",
    "mean_target",
)
def _(c):
    """Boosting starts at the mean of the targets known at the origin: the leaf of every model's first tree."""
    table = _saved_features(c)
    rows, names = _encoded(table)
    found, _ = trees.grow_trees(rows, names, _usable_origins(c, table), replace(trees.FAMILIES["gbt_squared"], rounds=2, depth=1))
    return trees.start_values(found.where("round = 0"), rows)


_one_model("model_random_forest", "random_forest")
_one_model("model_gbt", "gbt_squared")
_one_model("model_gbt_absolute", "gbt_absolute")


def _linear_backtest(c, table, ridges=(0.0,), origins=None):
    """Predictions of every usable origin, horizon and ridge, all models from one pass over the rows."""
    rows, names = _encoded(table)
    fits = c.stored(linear.running_linear(rows, names, _usable_origins(c, table) if origins is None else origins, ridges=ridges))
    return linear.predict_linear(rows, names, fits)


@query("model_linear")
def _(c):
    return _linear_backtest(c, _saved_features(c)).select(_ROW)


@query(
    "linear_residuals",
    f"""SELECT forecast_origin AS forecast_origin_date, horizon, count(*) AS n_train, TRUE AS unbiased, TRUE AS orthogonal
    FROM {_USABLE} AS o, {_HORIZONS} AS h, t_weekly AS w
    WHERE w.week_start >= (SELECT min(week_start) FROM t_weeks) + 357 AND w.week_start <= o.forecast_origin - 7 * h.horizon GROUP BY 1, 2""",
)
def _(c):
    """Every model's training rows end before its origin; its residuals sum to zero and depend on no predictor."""
    table = _saved_features(c)
    rows, names = _encoded(table)
    fits = c.stored(linear.running_linear(rows, names, _usable_origins(c, table)))
    got = linear.training_residuals(rows, names, fits)
    unbiased = F.abs("residual_sum") <= 1e-6 * F.col("n_train")
    return got.select("forecast_origin_date", "horizon", "n_train", unbiased.alias("unbiased"), (F.col("residual_cosine") < 1e-6).alias("orthogonal"))


def _as_model_rows(baselines):
    return baselines.select(
        "model", "SKU", F.col("forecast_origin").alias("forecast_origin_date"), "horizon", F.col("target_week").alias("target_date"), "actual",
        F.greatest(F.lit(0.0), F.col("forecast")).alias("prediction"),
    )


def _backtest(c):
    """The linear model and the five baselines at the same origins, stored."""
    table = _saved_features(c)
    origins = _usable_origins(c, table)
    baselines = _as_model_rows(c.forecasts.where(F.col("forecast_origin").isin(origins)))
    return c.stored(forecast.union_forecasts(_linear_backtest(c, table, origins=origins).select(_ROW), baselines.select(_ROW)))


@query("backtest_models")
def _(c):
    return _backtest(c)


def _model_rows(models) -> str:
    return f"""SELECT m.model, w.SKU, o.forecast_origin AS forecast_origin_date, h.horizon, o.forecast_origin + 7 * h.horizon AS target_date,
    CAST(a.Units_Sold AS DOUBLE) AS actual, TRUE AS sound
    FROM {_USABLE} AS o, {_HORIZONS} AS h, (SELECT unnest([{", ".join(f"'{m}'" for m in models)}]) AS model) AS m
    JOIN t_weekly AS w ON w.week_start = o.forecast_origin LEFT JOIN t_weekly AS a ON a.SKU = w.SKU AND a.week_start = o.forecast_origin + 7 * h.horizon"""


_BACKTEST_ROWS = _model_rows(["linear", *forecast.MODELS])


def _sound_rows(rows):
    sound = F.coalesce(F.col("prediction") >= 0, F.lit(False)) & ~F.isnan("prediction")
    return rows.select(*_ROW[:-2], F.col("actual").cast("double").alias("actual"), sound.alias("sound"))


@query("tree_rows", _model_rows(["gbt_squared"]), "actual")
def _(c):
    return _sound_rows(_tree_backtest(c, "gbt_squared"))


@query("backtest_rows", _BACKTEST_ROWS, "actual")
def _(c):
    """What every model must have predicted: each item, usable origin and horizon once, on its date, with its actual, never below zero."""
    return _sound_rows(_backtest(c))


@query("model_scorecards")
def _(c):
    """Accuracy of the linear model and the baselines by summary, horizon, item and category."""
    rows = _backtest(c).join(c.item_class.select("SKU", "Category"), "SKU", "left")
    return metrics.evaluate_forecasts(rows, _ML_LEVELS, forecast="prediction")


@query(
    "scorecard_rows",
    f"""SELECT model, horizon, count(*) AS n_forecasts, sum(actual) AS demand FROM ({_BACKTEST_ROWS}) AS b WHERE actual IS NOT NULL GROUP BY model, horizon""",
    "demand",
)
def _(c):
    rows = _backtest(c).dropna(subset=["actual"])
    return rows.groupBy("model", "horizon").agg(F.count(F.lit(1)).alias("n_forecasts"), F.sum(F.col("actual").cast("double")).alias("demand"))


@query("direct_multi_horizon")
def _(c):
    return _linear_backtest(c, _saved_features(c), origins=_last_origins(c, 1)).select(_ROW)


def _scored(preds, configs):
    """One row per model, horizon and trial with its configuration."""
    scored = metrics.forecast_metrics(preds, ["model", "horizon", "trial_id"], forecast="prediction")
    return scored.withColumn("config", F.element_at(F.array(*map(F.lit, configs)), F.col("trial_id") + 1))


def _validation_origins(c, table) -> list:
    return _usable_origins(c, table)[:VALIDATION_ORIGINS]


def _linear_trials(c, table):
    """Every ridge at the first usable origins, all from one pass; one aggregate scores all trials."""
    preds = _linear_backtest(c, table, RIDGES, _validation_origins(c, table))
    return c.stored(_scored(preds, [json.dumps({"ridge": r}) for r in RIDGES]))


def _tree_trials(c, table, family: str):
    """Every configuration of a family's grid at the first usable origins; all of them learn from the same bins."""
    rows, names = _encoded(table)
    grid = GRIDS[family]
    found, borders = trees.grow_trees(rows, names, _validation_origins(c, table), grid)
    preds = c.stored(trees.predict_trees(rows, names, found, borders, grid, family))
    scored = _scored(preds, [json.dumps(asdict(g)) for g in grid])
    return c.stored(scored)


def _trials(c, table):
    """The whole grids: boosted trees by leaf and by level, forests, and the ridges of the linear family."""
    return forecast.union_forecasts(_linear_trials(c, table), *[_tree_trials(c, table, family) for family in GRIDS])


@query("tune_grid")
def _(c):
    return _trials(c, _saved_features(c))


@query("tuned_linear", f"SELECT 'linear' AS model, horizon, TRUE AS tuned_is_best, {len(RIDGES)} AS n_trials FROM {_HORIZONS}")
def _(c):
    """Per horizon the best trial of the stored ones, against least squares at the same origins."""
    trials = _linear_trials(c, _saved_features(c))
    untuned = trials.where("trial_id = 0")
    compared = metrics.tuned_vs_untuned(metrics.argmin_config(trials), untuned)
    counts = trials.groupBy("model", "horizon").agg(F.count(F.lit(1)).cast("int").alias("n_trials"))
    return compared.join(counts, ["model", "horizon"]).select("model", "horizon", (F.col("improvement") >= 0).alias("tuned_is_best"), "n_trials")


@query("retrain_best")
def _(c):
    """Each horizon with its best ridge, fitted on all that is known at the last origin."""
    table = _saved_features(c)
    best = metrics.argmin_config(_linear_trials(c, table)).select("horizon", "trial_id")
    return _linear_backtest(c, table, RIDGES, _last_origins(c, 1)).join(best, ["horizon", "trial_id"]).select(_ROW)


def _choice(c, before):
    """Per horizon the model with the lowest pooled WAPE, the seasonal one if equal."""
    scored = metrics.forecast_metrics(before, ["model", "horizon"], forecast="prediction")
    others = [m for m in forecast.MODELS if m != "seasonal_naive"]
    return metrics.select_architecture(scored, ["seasonal_naive", "linear", *others])


@query("model_architecture")
def _(c):
    return _choice(c, _backtest(c))


@query("hybrid_predict")
def _(c):
    """At the last usable origin each horizon is served by the model that was best at the usable origins before it."""
    rows = _backtest(c)
    last = rows.agg(F.max("forecast_origin_date")).scalar()
    chosen = _choice(c, rows.where(F.col("forecast_origin_date") < last)).select("horizon", F.col("selected_model").alias("model"))
    return rows.where(F.col("forecast_origin_date") == last).join(chosen, ["horizon", "model"]).select(_ROW)


@query("dq_serialization_parity", "SELECT CAST((SELECT count(*) FROM t_nmaster) * 8 AS BIGINT) AS n, CAST(0 AS DOUBLE) AS max_abs_diff", "max_abs_diff")
def _(c):
    table = _saved_features(c)
    origin = _last_origins(c, 1)[0]
    models = ml.direct_multi_horizon(table, "linear", origin)
    root = f"{work_dir(c.spark)}/models"
    ml.save_models(models, root)
    at = table.filter(F.col("forecast_origin_date") == F.lit(origin))
    return ml.serialization_parity(ml.predict_multi(models, at, "linear"), ml.predict_multi(ml.load_models(root, list(models)), at, "linear"))


@query("feature_transformer", "SELECT SKU, week_start, CASE WHEN Units_Sold IS NULL THEN -1 ELSE CAST(Units_Sold AS DOUBLE) END AS x_lag_1, coalesce(CAST(lag_52 AS DOUBLE), -1) AS x_lag_52 FROM (SELECT *, lag(Units_Sold, 51) OVER (PARTITION BY SKU ORDER BY week_start) AS lag_52 FROM t_weekly)")
def _(c):
    step = ml.DemandFeatures(inputCols=["lag_1", "lag_52"])
    return step.transform(feat.demand_lags(c.weekly)).select("SKU", "week_start", *step.get_feature_names())
