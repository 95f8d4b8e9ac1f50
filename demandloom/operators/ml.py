"""MLlib regressors, backtests and tuning. Fits run as Spark jobs; only model and metric objects reach the driver."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.param.shared import HasInputCols, Param, Params, TypeConverters
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, functions as F

from .features import HORIZON, KEYS, feature_names, feature_table
from .metrics import argmin_config, forecast_metrics

PARALLEL_FITS, MOST_LABELS = 4, 10_000

# Declared label order of the encoded text features.
PRICE_TIERS = ("Budget", "Mid-Range", "Premium")

LEARNERS: dict[str, Callable] = {
    "random_forest": lambda **p: RandomForestRegressor(**{"numTrees": 40, "maxDepth": 8, "seed": 42, **p}),
    "gbt_squared": lambda **p: GBTRegressor(**{"maxIter": 30, "maxDepth": 5, "stepSize": 0.1, "lossType": "squared", "seed": 42, **p}),
    "gbt_absolute": lambda **p: GBTRegressor(**{"maxIter": 30, "maxDepth": 5, "stepSize": 0.1, "lossType": "absolute", "seed": 42, **p}),
    "linear": lambda **p: LinearRegression(**{"regParam": 0.0, "solver": "auto", **p}),
}


class DemandFeatures(Transformer, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Text and boolean predictors to numbers, missing predictors to a marked value.

    Text becomes its place in the declared labels of its column (``vocabulary``, saved with the step); an unknown label counts as missing.
    A text column without declared labels raises.
    """

    missing = Param(Params._dummy(), "missing", "value that stands for a missing predictor", TypeConverters.toFloat)
    vocabulary = Param(Params._dummy(), "vocabulary", "JSON of the declared labels of each text column", TypeConverters.toString)

    def __init__(self, inputCols: Sequence[str] | None = None, missing: float = -1.0, vocabulary: Mapping[str, Sequence[str]] | None = None):
        super().__init__()
        self._setDefault(missing=-1.0, vocabulary="{}")
        self._set(missing=missing)
        if inputCols is not None:
            self._set(inputCols=list(inputCols))
        if vocabulary is not None:
            self._set(vocabulary=json.dumps({k: list(v) for k, v in vocabulary.items()}, sort_keys=True))

    def get_feature_names(self) -> list[str]:
        return [f"x_{c}" for c in self.getInputCols()]

    def _transform(self, dataset: DataFrame) -> DataFrame:
        fill = F.lit(self.getOrDefault(self.missing))
        types = {f.name: f.dataType.typeName() for f in dataset.schema.fields}
        declared = {"Price_Tier": PRICE_TIERS, **json.loads(self.getOrDefault(self.vocabulary))}
        out = {}
        for c in self.getInputCols():
            if types[c] == "string":
                if c not in declared:
                    raise ValueError(f"no labels are declared for the text column {c}")
                labels = F.array(*[F.lit(x) for x in declared[c]]).cast("array<string>")
                place = F.array_position(labels, F.col(c))
                value = F.when(place > 0, (place - 1).cast("double"))
            else:
                value = F.col(c).cast("double")
            out[f"x_{c}"] = F.coalesce(value, fill)
        return dataset.withColumns(out)


def label_vocabulary(features: DataFrame, predictors: Sequence[str]) -> dict[str, list[str]]:
    """The labels of every text predictor in order. More than ``MOST_LABELS`` in a column raise: it is no category."""
    text = [f.name for f in features.schema.fields if f.name in set(predictors) and f.dataType.typeName() == "string" and f.name != "Price_Tier"]
    if not text:
        return {}
    pairs = features.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("label")) for c in text])).alias("p")).select("p.*")
    found = pairs.where("label IS NOT NULL").distinct().limit(MOST_LABELS * len(text) + 1).collect()
    out = {c: sorted(r["label"] for r in found if r["column"] == c) for c in text}
    for c, labels in out.items():
        if len(labels) > MOST_LABELS:
            raise ValueError(f"{c} has more than {MOST_LABELS} labels")
    return out


def encoder(features: DataFrame, predictors: Sequence[str]) -> DemandFeatures:
    """The encoding step with the labels that ``features`` has; static over time, so it tells nothing of the future."""
    return DemandFeatures(inputCols=list(predictors), vocabulary=label_vocabulary(features, predictors))


def model_pipeline(family: str, predictors: Sequence[str], target: str, vocabulary: Mapping[str, Sequence[str]] | None = None, **params) -> Pipeline:
    encode = DemandFeatures(inputCols=list(predictors), vocabulary=vocabulary)
    assemble = VectorAssembler(inputCols=encode.get_feature_names(), outputCol="features", handleInvalid="error")
    learner = LEARNERS[family](featuresCol="features", labelCol=target, predictionCol="raw_prediction", **params)
    return Pipeline(stages=[encode, assemble, learner])


def fit_model(train: DataFrame, family: str, horizon: int, predictors: Sequence[str], vocabulary: Mapping[str, Sequence[str]] | None = None, **params) -> PipelineModel:
    if vocabulary is None:
        vocabulary = label_vocabulary(train, predictors)
    return model_pipeline(family, predictors, f"target_h{horizon}", vocabulary, **params).fit(train)


def predict(model: PipelineModel, df: DataFrame, family: str, horizon: int) -> DataFrame:
    """Non-negative predictions in the long prediction layout."""
    origin = F.col("forecast_origin_date")
    return model.transform(df).select(
        F.lit(family).alias("model"), "SKU", "forecast_origin_date", F.lit(horizon).alias("horizon"),
        F.date_add(origin, 7 * horizon).alias("target_date"), F.col(f"target_h{horizon}").cast("double").alias("actual"),
        F.greatest(F.lit(0.0), F.col("raw_prediction")).alias("prediction"),
    )


def training_rows(features: DataFrame, eval_origin, horizon: int) -> DataFrame:
    """Rows whose target was already observed at the evaluation origin."""
    cutoff = F.date_sub(F.to_date(F.lit(str(eval_origin))), 7 * horizon)
    return features.filter((F.col("forecast_origin_date") <= cutoff) & F.col("lag_52").isNotNull() & F.col(f"target_h{horizon}").isNotNull())


def _run(jobs: Sequence[Callable[[], DataFrame]]) -> DataFrame:
    """Submit independent fits concurrently and union their predictions."""
    with ThreadPoolExecutor(PARALLEL_FITS) as pool:
        parts = list(pool.map(lambda job: job(), jobs))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def backtest_models(
    features: DataFrame,
    origins: Sequence,
    families: Sequence[str],
    horizons: Sequence[int] = tuple(range(1, HORIZON + 1)),
    params: Mapping[str, dict] | None = None,
    root: str | None = None,
) -> DataFrame:
    """Expanding-window backtest: for every origin and horizon train on the past, predict at the origin.

    With ``root`` the predictions of each origin are written there and read back, so the plan does not grow with the origins.
    """
    params = params or {}
    predictors = feature_names(features)
    labels = label_vocabulary(features, predictors)

    def job(origin, h: int, family: str) -> Callable[[], DataFrame]:
        def go() -> DataFrame:
            model = fit_model(training_rows(features, origin, h), family, h, predictors, labels, **params.get(family, {}))
            return predict(model, features.filter(F.col("forecast_origin_date") == F.to_date(F.lit(str(origin)))), family, h)

        return go

    if root is None:
        return _run([job(o, h, f) for o in origins for h in horizons for f in families])
    paths = [f"{root}/{i}" for i in range(len(origins))]
    for origin, path in zip(origins, paths):
        _run([job(origin, h, f) for h in horizons for f in families]).write.parquet(path)
    return features.sparkSession.read.parquet(*paths)


def usable_origins(features: DataFrame, origins: Sequence) -> list:
    """The origins at which every horizon has a training row."""
    targets = [F.min(F.when(F.col(f"target_h{h}").isNotNull(), F.date_add("forecast_origin_date", 7 * h))) for h in range(1, HORIZON + 1)]
    known = features.filter(F.col("lag_52").isNotNull()).agg(*targets).first()
    return sorted(o for o in origins if all(k is not None and k <= o for k in known))


def direct_multi_horizon(
    train: DataFrame, family: str, cutoff, horizons: Sequence[int] = tuple(range(1, HORIZON + 1)), **params
) -> dict[int, PipelineModel]:
    """One independent model per horizon, from rows whose target was known at ``cutoff``, the origin to be served."""
    predictors = feature_names(train)
    labels = label_vocabulary(train, predictors)

    def fit(h: int) -> PipelineModel:
        return fit_model(training_rows(train, cutoff, h), family, h, predictors, labels, **params)

    with ThreadPoolExecutor(PARALLEL_FITS) as pool:
        return dict(zip(horizons, pool.map(fit, horizons)))


def predict_multi(models: Mapping[int, PipelineModel], df: DataFrame, family: str) -> DataFrame:
    return _run([lambda h=h, m=m: predict(m, df, family, h) for h, m in models.items()])


def save_models(models: Mapping[int, PipelineModel], root: str) -> None:
    for h, m in models.items():
        m.write().overwrite().save(f"{root}/h{h}")


def load_models(root: str, horizons: Sequence[int]) -> dict[int, PipelineModel]:
    return {h: PipelineModel.load(f"{root}/h{h}") for h in horizons}


def tune_grid(
    features: DataFrame, origins: Sequence, grids: Mapping[str, Sequence[dict]], horizons: Sequence[int]
) -> DataFrame:
    """Trial table: pooled WAPE over the validation origins of every configuration and horizon.

    Each trial is scored as soon as it is fitted, one row per horizon, so the plan does not grow with the grid.
    """
    rows = []
    for family, configs in grids.items():
        for trial, config in enumerate(configs):
            preds = backtest_models(features, origins, [family], horizons, {family: config})
            scored = forecast_metrics(preds, ["model", "horizon"], forecast="prediction")
            text = json.dumps(config, sort_keys=True)
            rows += [(*r, trial, text) for r in scored.select("model", "horizon", "WAPE", "MAE", "RMSE", "n_forecasts").collect()]
    schema = "model string, horizon int, WAPE double, MAE double, RMSE double, n_forecasts bigint, trial_id int, config string"
    return features.sparkSession.createDataFrame(rows, schema)


def retrain_best(features: DataFrame, trials: DataFrame, family: str, cutoff, horizons: Sequence[int]) -> dict[int, PipelineModel]:
    """Refit each horizon with its best configuration (one row per horizon is read) on all rows known at ``cutoff``."""
    best = {r["horizon"]: json.loads(r["config"]) for r in argmin_config(trials).filter(F.col("model") == family).collect()}
    predictors = feature_names(features)
    labels = label_vocabulary(features, predictors)
    return {h: fit_model(training_rows(features, cutoff, h), family, h, predictors, labels, **best[h]) for h in horizons}


def hybrid_predict(
    features: DataFrame, seasonal: DataFrame, models: Mapping[str, Mapping[int, PipelineModel]], choice: Mapping[int, str],
) -> DataFrame:
    """Per horizon either a trained model or the seasonal-naive forecast, floored at zero.

    ``seasonal`` holds seasonal-naive rows (SKU, forecast_origin, horizon, target_week, forecast, actual).
    """
    parts = []
    for h, name in choice.items():
        if name == "seasonal_naive":
            parts.append(
                seasonal.filter(F.col("horizon") == h).select(
                    F.lit(name).alias("model"), "SKU", F.col("forecast_origin").alias("forecast_origin_date"), "horizon",
                    F.col("target_week").alias("target_date"), "actual", F.greatest(F.lit(0.0), F.col("forecast")).alias("prediction"),
                )
            )
        else:
            parts.append(predict(models[name][h], features, name, h))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def serialization_parity(before: DataFrame, after: DataFrame) -> DataFrame:
    """Largest difference between predictions of a model and of its reloaded copy."""
    keys = ["model", "SKU", "forecast_origin_date", "horizon"]
    joined = before.select(*keys, F.col("prediction").alias("b")).join(after.select(*keys, F.col("prediction").alias("a")), keys, "full")
    gap = F.coalesce(F.abs(F.col("b") - F.col("a")), F.lit(float("inf")))
    return joined.agg(F.count(F.lit(1)).alias("n"), F.max(gap).alias("max_abs_diff"))


__all__ = [
    "DemandFeatures", "backtest_models", "direct_multi_horizon", "feature_table", "fit_model", "hybrid_predict", "load_models",
    "predict", "predict_multi", "retrain_best", "save_models", "serialization_parity", "training_rows", "tune_grid",
    "usable_origins", "KEYS",
]
