"""The production run: ingest, check, train, choose, forecast, score, decide, govern, export; it can be taken up where it stopped."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import week_start
from ..operators import decide, features as feat, forecast, linear, metrics, ml, quality, risk, timegrid
from ..sources import sinks
from .context import Context

#: Models that may serve a horizon; equal accuracy goes to the one listed first, the benchmark.
CANDIDATES = ("seasonal_naive", "linear", *[m for m in forecast.MODELS if m != "seasonal_naive"])
COMMIT = "stage string, position int, token string, after string, n_rows bigint"


@dataclass
class ProductionRun:
    """Output tables of one run: governed recommendations, forecasts, the model per horizon, and the rows of every stage."""

    recommendations: DataFrame
    forecasts: DataFrame
    architecture: DataFrame
    manifest: DataFrame


@dataclass
class Stages:
    """The stages of a run under ``root``. A stage is a stored table and then a commit.

    A commit names the commit of the stage before it, and the first one names the run. So a stage counts as done only on top of the very
    tables it was made from: a rerun skips what was committed, and redoes everything from the first stage that was not.
    """

    spark: SparkSession
    root: str
    run: str
    committed: dict = field(default_factory=dict)
    rows: dict[str, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.last = self.run
        try:
            found = self.spark.read.schema(COMMIT).json(f"{self.root}/committed/*").collect()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            found = []
        self.committed = {r["stage"]: r for r in found}

    def table(self, name: str, build: Callable[[], DataFrame], expected: int | None = None) -> DataFrame:
        """The stored table of a stage; another number of rows than ``expected`` stops the run before the commit."""
        path = f"{self.root}/{name}"
        self._once(name, lambda: sinks.sink_parquet(build(), path), lambda: self.spark.read.parquet(path).count(), expected)
        return self.spark.read.parquet(path)

    def report(self, name: str, write: Callable[[str], None], n_rows: int) -> None:
        """A stage whose output no later stage reads."""
        self._once(name, lambda: write(f"{self.root}/{name}"), lambda: n_rows, None)

    def _once(self, name: str, write: Callable[[], object], count: Callable[[], int], expected: int | None) -> None:
        done = self.committed.get(name)
        if done is not None and done["after"] == self.last:
            self.last, self.rows[name] = done["token"], done["n_rows"]
            return
        write()
        n_rows = count()
        if expected is not None and n_rows != expected:
            raise ValueError(f"stage {name} has {n_rows} rows instead of {expected}")
        token = uuid.uuid4().hex
        values = {"stage": F.lit(name), "position": F.lit(len(self.rows)), "token": F.lit(token), "after": F.lit(self.last), "n_rows": F.lit(n_rows).cast("bigint")}
        one = self.spark.range(1, numPartitions=1).select(*[v.alias(k) for k, v in values.items()])
        one.write.mode("overwrite").json(f"{self.root}/committed/{name}")
        self.last, self.rows[name] = token, n_rows

    def manifest(self) -> DataFrame:
        rows = ", ".join(f"({i}, '{name}', {n}L)" for i, (name, n) in enumerate(self.rows.items()))
        return self.spark.sql(f"SELECT * FROM VALUES {rows} AS m(position, stage, n_rows)")


def forecast_origin(c: Context, requested: str | None = None) -> DataFrame:
    """The requested weekly origin, or the latest rolling origin. A date that starts no week of the panel raises."""
    if requested is None:
        return c.last_origin
    day = F.to_date(F.lit(requested))
    span = timegrid.week_span(c.days).select("lo", "hi", day.alias("forecast_origin"))
    on_grid = (day == week_start(day)) & day.between(F.col("lo"), F.col("hi"))
    if not span.select(F.coalesce(on_grid, F.lit(False))).first()[0]:
        raise ValueError(f"{requested} is not the start of a week of the panel")
    return span.select("forecast_origin")


def _run_name(c: Context, origin, candidates: Sequence[str]) -> str:
    return hashlib.sha256(json.dumps([c.sf_dir, str(origin), list(candidates)]).encode()).hexdigest()


def _linear_forecasts(stages: Stages, c: Context, origins: Sequence) -> DataFrame:
    """Forecasts of the stored linear models, trained for every origin with enough history."""
    table = stages.table("features", lambda: c.features)
    encode = ml.encoder(table, feat.feature_names(table))
    rows, names = encode.transform(table), encode.get_feature_names()
    fits = stages.table("models", lambda: linear.running_linear(rows, names, ml.usable_origins(table, origins)))
    return linear.predict_linear(rows, names, fits).select(
        "SKU", F.col("forecast_origin_date").alias("forecast_origin"), F.col("target_date").alias("target_week"), "horizon", "model",
        F.col("prediction").alias("forecast"), "actual",
    )


def _candidate_forecasts(c: Context, origins: Sequence, candidates: Sequence[str], learned: DataFrame | None) -> DataFrame:
    at = c.spark.createDataFrame([(o,) for o in origins], "forecast_origin date")
    parts = [forecast.baseline_forecasts(c.weekly, at, [m for m in candidates if m in forecast.MODELS])]
    return forecast.union_forecasts(*parts, *([learned] if learned is not None else []))


def production_run(c: Context, root: str, requested: str | None = None, candidates: Sequence[str] = CANDIDATES) -> ProductionRun:
    """Execute the plan under ``root``, or take it up there: stages already committed for the same data, origin and candidates are skipped.

    A critical check stops the run. Each horizon is served by the candidate with the lowest pooled WAPE over what was known at the origin
    (see ``metrics.architecture_at``); ``linear`` is the trained candidate, the others are the baselines. Every item of the master gets one forecast
    per horizon, one risk row and one recommendation, or the run stops. The folder belongs to unchanged data: use another one for new data.
    """
    unknown = set(candidates) - set(CANDIDATES)
    if unknown or "seasonal_naive" not in candidates:
        raise ValueError(f"candidates are {CANDIDATES} and include the benchmark, got {tuple(candidates)}")
    origin = forecast_origin(c, requested).first()[0]
    stages = Stages(c.spark, root, _run_name(c, origin, candidates))
    # The inputs are stored once; everything below reads the stored tables.
    inputs = Context(c.spark, c.sf_dir)
    inputs.days = c.days
    for name in ("sales", "master", "inventory"):
        setattr(inputs, name, stages.table(name, lambda name=name: getattr(c, name)))
    items = stages.rows["master"]

    def checks() -> DataFrame:
        results = quality.cross_checks(inputs.norm_sales, inputs.norm_master, c.calendar, inputs.inventory)
        return quality.halt_on_critical(forecast.union_forecasts(*results))

    stages.table("checks", checks)

    def orphans() -> DataFrame:
        served = timegrid.select_snapshot_origin(inputs.inventory, str(origin)).select("origin_date").scalar()
        return inputs.quarantine.where(F.col("Date") == served)

    stages.table("quarantine", orphans)
    # At most twelve rolling origins, and the one that is served.
    origins = sorted({origin} | {r[0] for r in c.origins.collect() if r[0] < origin})
    learned = _linear_forecasts(stages, inputs, origins) if "linear" in candidates else None
    rows = stages.table("candidates", lambda: _candidate_forecasts(inputs, origins, candidates, learned))
    architecture = stages.table("architecture", lambda: metrics.architecture_at(rows, origin, candidates), forecast.HORIZON)
    served = rows.where(F.col("forecast_origin") == F.lit(origin))
    fc = stages.table("forecasts", lambda: forecast.hybrid_assemble(served, architecture), items * forecast.HORIZON)
    at_origin = c.spark.createDataFrame([(origin,)], "origin_date date")
    scaffold = timegrid.scaffold_origin_sku(inputs.norm_master, at_origin)
    scored = stages.table("risk", lambda: risk.risk_scores(scaffold, fc, inputs.origin_snapshots), items)
    recs = stages.table("recommendations", lambda: decide.recommendations(scored, inputs.norm_master), items)
    governed = stages.table("governed", lambda: decide.govern(recs), items)
    stages.report("report", lambda path: sinks.sink_csv_report(governed, path, ["priority_rank", "sku"]), items)
    manifest = stages.manifest()
    sinks.sink_json_records(manifest, f"{root}/manifest")
    return ProductionRun(governed, fc, architecture, manifest)
