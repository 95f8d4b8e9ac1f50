"""Linear models of every origin and horizon from running sufficient statistics: one pass over the rows, however many models.

The training rows of a later origin contain those of an earlier one, so their cross products are running sums along the weeks.
A row is added to the sums of its stretch between two cutoffs; the sums of a cutoff are those of all stretches up to it,
and every model with that cutoff, for any strength of the ridge, is solved from them in a task.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from .features import HORIZON, KEYS

DATE = "forecast_origin_date"
#: Directions in which the standardised predictors vary less than this share of the largest are left out.
FLAT = 1e-10
#: Rows whose values for all models of an origin are added up together.
ROWS_AT_ONCE = 256


def day_number(column: str):
    return F.datediff(F.col(column), F.lit("1970-01-01").cast("date"))


def cutoff_days(origins: Sequence, horizons: Sequence[int]) -> list[int]:
    """Days since the epoch of the last training week of every model, each once, ascending."""
    epoch = np.datetime64("1970-01-01")
    return sorted({int((np.datetime64(str(o)) - epoch).astype(int)) - 7 * h for o in origins for h in horizons})


def solve(gram: np.ndarray, right: np.ndarray, ridge: float) -> tuple[np.ndarray, np.ndarray]:
    """Slopes and intercept per right-hand side of least squares with a ridge on the slopes; row and column 0 belong to the intercept.

    The mean squared error plus ``ridge`` times the squared slopes is least. Predictors that depend on others share their slope
    (the solution of least norm), so it is unique.
    """
    n, sums = gram[0, 0], gram[0, 1:]
    spread = gram[1:, 1:] - np.outer(sums, sums) / n
    power, axes = np.linalg.eigh(spread / n)
    kept = power > FLAT * max(power.max(initial=0.0), 1e-300)
    inverse = np.where(kept, 1 / np.where(kept, power + ridge, 1.0), 0.0)
    slopes = axes @ (inverse[:, None] * (axes.T @ (right[1:] - np.outer(sums, right[0]) / n) / n))
    return slopes, (right[0] - sums @ slopes) / n


def running_linear(rows: DataFrame, predictors: Sequence[str], origins: Sequence, horizons: Sequence[int] = tuple(range(1, HORIZON + 1)), ridges: Sequence[float] = (0.0,)) -> DataFrame:
    """Coefficients of every model: (``forecast_origin_date``, ``horizon``, ``trial_id``, ``n_train``, ``intercept``, ``slopes``).

    ``rows`` are feature rows with numeric ``predictors`` and the targets. The model of an origin and a horizon learns from the rows with a
    full year of history whose target was known at the origin, as in ``ml.training_rows``; ``trial_id`` counts ``ridges``.
    A null predictor or a missing target among them raises. A model without training rows is left out.
    """
    spark = rows.sparkSession
    horizons, ridges, size = list(horizons), [float(r) for r in ridges], len(predictors) + 1
    cutoffs = cutoff_days(origins, horizons)
    targets = [F.col(f"target_h{h}").cast("double").alias(f"y{h}") for h in horizons]
    day = day_number(DATE)
    learned = rows.where(F.col("lag_52").isNotNull() & (day <= (cutoffs[-1] if cutoffs else 0)))
    x = F.array(*[F.col(c).cast("double") for c in predictors])
    learned = learned.select(day.alias("day"), x.alias("x"), *targets)
    stats = learned.agg(*[f(F.get("x", F.lit(i))).alias(f"{n}{i}") for i in range(size - 1) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    mean = np.array([stats[f"m{i}"] or 0.0 for i in range(size - 1)])
    scale = np.array([stats[f"s{i}"] or 1.0 for i in range(size - 1)])
    width = size * size + (size + 1) * len(horizons)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Cross products of the standardised predictors, and of them with each target, by stretch of weeks."""
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            n = batch.num_rows
            values = batch.column("x").flatten()
            if values.null_count:
                raise ValueError("a predictor is null")
            z = np.ones((n, size))
            z[:, 1:] = (values.to_numpy(zero_copy_only=False).reshape(n, size - 1) - mean) / scale
            y = np.column_stack([batch.column(f"y{h}").to_numpy(zero_copy_only=False) for h in horizons])
            known = ~np.isnan(y)
            stretch = np.searchsorted(cutoffs, batch.column("day").to_numpy())
            for s in np.unique(stretch).tolist():
                at = stretch == s
                a, b = z[at], np.where(known[at], y[at], 0.0)
                part = np.concatenate(((a.T @ a).ravel(), (a.T @ b).ravel(), known[at].sum(0)))
                totals[s] = totals[s] + part if s in totals else part
        for s, total in totals.items():
            columns = [pa.array(np.full(width, s, np.int32)), pa.array(np.arange(width, dtype=np.int32)), pa.array(total)]
            yield pa.RecordBatch.from_arrays(columns, names=["stretch", "place", "total"])

    sums = learned.mapInArrow(summed, "stretch int, place int, total double").groupBy("stretch", "place").agg(F.sum("total").alias("total"))
    upto = W.partitionBy("place").orderBy("stretch").rowsBetween(W.unboundedPreceding, 0)
    running = sums.select("stretch", "place", F.sum("total").over(upto).alias("total"))
    # A stretch without rows of its own stands at the one before it.
    served = [(c, o, h) for o in origins for h in horizons for c in [bisect_left(cutoffs, cutoff_days([o], [h])[0])]]
    wanted = spark.createDataFrame([(c, str(o), h) for c, o, h in served], "cutoff int, origin string, horizon int") if served else None
    if wanted is None:
        return spark.createDataFrame([], f"{DATE} date, horizon int, trial_id int, n_train bigint, intercept double, slopes array<double>")
    met = sums.select("stretch").distinct()
    last = wanted.join(met, F.col("stretch") <= F.col("cutoff")).groupBy("origin", "horizon").agg(F.max("stretch").alias("stretch"))
    jobs = last.groupBy("stretch").agg(F.collect_list(F.struct("origin", "horizon")).alias("models"))

    def solved(group: pa.Table) -> pa.Table:
        total = np.empty(width)
        total[group.column("place").to_numpy()] = group.column("total").to_numpy()
        gram = total[: size * size].reshape(size, size)
        right = total[size * size : width - len(horizons)].reshape(size, len(horizons))
        counts, out = total[width - len(horizons) :], []
        for model in group.column("models")[0].as_py():
            k = horizons.index(model["horizon"])
            if counts[k] != gram[0, 0]:
                raise ValueError(f"{int(gram[0, 0] - counts[k])} targets are missing among the training rows of horizon {model['horizon']}")
            for trial, ridge in enumerate(ridges):
                slopes, intercept = solve(gram, right[:, k : k + 1], ridge)
                slopes = slopes[:, 0] / scale
                out.append((model["origin"], model["horizon"], trial, int(round(gram[0, 0])), float(intercept[0] - slopes @ mean), slopes.tolist()))
        names = ["origin", "horizon", "trial_id", "n_train", "intercept", "slopes"]
        types = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.list_(pa.float64())]
        return pa.table([pa.array(list(c), t) for c, t in zip(zip(*out), types)], names=names)

    fits = running.join(jobs, "stretch").groupBy("stretch").applyInArrow(solved, "origin string, horizon int, trial_id int, n_train bigint, intercept double, slopes array<double>")
    return fits.select(F.to_date("origin").alias(DATE), "horizon", "trial_id", "n_train", "intercept", "slopes")


def linear_values(rows: DataFrame, predictors: Sequence[str], fits: DataFrame, kept: Sequence[str]) -> DataFrame:
    """The ``kept`` columns of the rows of each model's origin with ``horizon``, ``trial_id`` and ``raw_prediction``; ``fits`` as ``running_linear`` gives them.

    A row meets all models of its origin at once and is unfolded afterwards. Terms are added up in the order of the predictors, so
    values do not depend on how rows are dealt. A null predictor gives a null value.
    """
    # One row per model: their number is that of origins, horizons and ridges, whatever the number of items.
    models = fits.select(DATE, "horizon", "trial_id", "intercept", "slopes").orderBy(DATE, "horizon", "trial_id").collect()
    n, epoch, found = len(predictors), np.datetime64("1970-01-01"), {}
    for k, r in enumerate(models):
        found.setdefault(int((np.datetime64(r[DATE]) - epoch).astype(int)), []).append(k)
    terms = {day: (at[0], np.array([models[k]["intercept"] for k in at]), np.array([models[k]["slopes"] for k in at], float).reshape(len(at), n)) for day, at in found.items()}

    def valued(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, day = batch.column("x").flatten(), batch.column("day").to_numpy()
            x = values.to_numpy(zero_copy_only=False).reshape(batch.num_rows, n)
            unknown = values.is_null().to_numpy(zero_copy_only=False).reshape(batch.num_rows, n).any(1)
            for d in np.unique(day).tolist():
                first, intercept, slopes = terms[d]
                at, m = np.flatnonzero(day == d), len(intercept)
                raw = np.zeros((len(at), m))
                for lo in range(0, len(at), ROWS_AT_ONCE):
                    part, some = raw[lo : lo + ROWS_AT_ONCE], x[at[lo : lo + ROWS_AT_ONCE]]
                    for i in range(n):
                        part += some[:, i : i + 1] * slopes[:, i]
                raw += intercept
                cells = pa.array(raw.ravel(), mask=np.repeat(unknown[at], m))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, raw.size + 1, m, dtype=np.int32)), cells)
                take = pa.array(at)
                columns = [*(batch.column(c).take(take) for c in kept), pa.array(np.full(len(at), first, np.int32)), lists]
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, "_first", "_raw"])

    met = rows.where(F.col(DATE).isin(sorted({r[DATE] for r in models}))) if models else rows.limit(0)
    x = F.array(*[F.col(c).cast("double") for c in predictors])
    out = T.StructType([*(rows.schema[c] for c in kept), T.StructField("_first", T.IntegerType()), T.StructField("_raw", T.ArrayType(T.DoubleType()))])
    served = met.select(*kept, x.alias("x"), day_number(DATE).alias("day")).mapInArrow(valued, out)
    unfolded = served.select(*kept, "_first", F.posexplode("_raw").alias("_i", "raw_prediction"))

    def of_model(name: str):
        return F.get(F.array(*[F.lit(r[name]) for r in models]).cast("array<int>"), F.col("_first") + F.col("_i")).alias(name)

    return unfolded.select(*kept, of_model("horizon"), of_model("trial_id"), "raw_prediction")


def predict_linear(rows: DataFrame, predictors: Sequence[str], fits: DataFrame, name: str = "linear") -> DataFrame:
    """Non-negative predictions at the origins in the long prediction layout, with ``trial_id``."""
    horizons = sorted(int(c.removeprefix("target_h")) for c in rows.columns if c.startswith("target_h"))
    targets = [f"target_h{h}" for h in horizons]
    actual = F.element_at(F.array(*[F.col(c).cast("double") for c in targets]), F.array_position(F.array(*map(F.lit, horizons)), F.col("horizon")).cast("int"))
    return linear_values(rows, predictors, fits, [*KEYS, *targets]).select(
        F.lit(name).alias("model"), *KEYS, "horizon", F.expr(f"date_add({DATE}, 7 * horizon)").alias("target_date"), actual.alias("actual"),
        F.greatest(F.lit(0.0), F.col("raw_prediction")).alias("prediction"), "trial_id",
    )


def training_residuals(rows: DataFrame, predictors: Sequence[str], fits: DataFrame) -> DataFrame:
    """Per model the sum of its training residuals and the largest cosine between them and a predictor.

    All models are met in one pass over the rows, by matrix products in tasks; sums per model are all that is shuffled.
    Both are zero for least squares with an intercept: (``forecast_origin_date``, ``horizon``, ``n_train``, ``residual_sum``, ``residual_cosine``).
    """
    learned = rows.where(F.col("lag_52").isNotNull())
    x = F.array(*[F.col(c).cast("double") for c in predictors])
    ahead = sorted(int(c.removeprefix("target_h")) for c in rows.columns if c.startswith("target_h"))
    target = F.array(*[F.col(f"target_h{h}").cast("double") for h in ahead])
    # One row per model: their number is that of origins, horizons and ridges, whatever the number of items.
    models = fits.select(day_number(DATE).alias("origin"), "horizon", "intercept", "slopes").collect()
    n, m = len(predictors), len(models)
    if not m:
        return rows.sparkSession.createDataFrame([], f"{DATE} date, horizon int, n_train bigint, residual_sum double, residual_cosine double")
    cutoff = np.array([r["origin"] - 7 * r["horizon"] for r in models], np.int64)
    step = np.array([ahead.index(r["horizon"]) for r in models], np.int64)
    slopes = np.array([r["slopes"] for r in models], float).reshape(m, n)
    intercept = np.array([r["intercept"] for r in models], float)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per model the number of rows, the sums of residuals and of their squares, and by predictor the products with the residuals and the squares."""
        total = np.zeros((m, 3 + 2 * n))
        for batch in batches:
            a = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
            y = batch.column("y").flatten().to_numpy(zero_copy_only=False).reshape(len(a), -1)
            met = batch.column("day").to_numpy()[:, None] <= cutoff
            r = y[:, step] - (a @ slopes.T + intercept)
            # A missing target among the training rows counts as a row, without a residual.
            r = np.where(met & ~np.isnan(r), r, 0.0)
            total[:, 0] += met.sum(0)
            total[:, 1] += r.sum(0)
            total[:, 2] += (r * r).sum(0)
            total[:, 3 : 3 + n] += r.T @ a
            total[:, 3 + n :] += met.T.astype(float) @ (a * a)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(m, dtype=np.int32)), pa.array(total[:, 0].astype(np.int64)), *[pa.array(np.ascontiguousarray(c)) for c in total[:, 1:].T]], names=names
        )

    cells = [f"{k}{i}" for k in ("d", "q") for i in range(n)]
    names = ["model", "n_train", "residual_sum", "rr", *cells]
    schema = "model int, n_train bigint, " + ", ".join(f"{c} double" for c in names[2:])
    parts = learned.select(day_number(DATE).alias("day"), x.alias("x"), target.alias("y")).mapInArrow(summed, schema)
    date = F.date_add(F.lit("1970-01-01").cast("date"), F.get(F.array(*[F.lit(r["origin"]) for r in models]), F.col("model")))
    horizon = F.get(F.array(*[F.lit(r["horizon"]) for r in models]), F.col("model"))
    sums = parts.groupBy(date.alias(DATE), horizon.alias("horizon")).agg(*[F.sum(c).alias(c) for c in names[1:]]).where("n_train > 0")
    cosine = F.greatest(*[F.coalesce(F.abs(F.col(f"d{i}")) / F.sqrt(F.nullif(F.col(f"q{i}") * F.col("rr"), F.lit(0.0))), F.lit(0.0)) for i in range(n)])
    return sums.select(DATE, "horizon", "n_train", "residual_sum", cosine.alias("residual_cosine"))
