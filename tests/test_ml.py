"""Properties of the MLlib operators on a small panel (learned values have no closed form)."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from demandloom.operators import features, ml

FIRST = dt.date(2023, 1, 3)


@pytest.fixture(scope="module")
def table(spark):
    rows = [(f"SKU{s:03d}", FIRST + dt.timedelta(7 * w), int(20 + 5 * s + 8 * math.sin(w / 8)), 0, 0) for s in range(1, 5) for w in range(100)]
    weekly = spark.createDataFrame(rows, "SKU string, week_start date, Units_Sold bigint, promo_days bigint, promo_active int")
    out = features.demand_lags(features.targets_multi_horizon(weekly), lags=(1, 2, 4, 52))
    return out.drop("Units_Sold", "promo_days", "promo_active").withColumnRenamed("week_start", "forecast_origin_date").cache()


def test_training_rows_never_see_the_future(table):
    origin = FIRST + dt.timedelta(7 * 80)
    latest = ml.training_rows(table, origin, 3).agg(F.max("forecast_origin_date")).first()[0]
    assert latest + dt.timedelta(21) <= origin


@pytest.mark.parametrize("family", ["linear", "random_forest", "gbt_squared", "gbt_absolute"])
def test_backtest_covers_items_and_stays_non_negative(table, family):
    small = {"random_forest": {"numTrees": 3, "maxDepth": 3}, "gbt_squared": {"maxIter": 2}, "gbt_absolute": {"maxIter": 2}}
    got = ml.backtest_models(table, [FIRST + dt.timedelta(7 * 85)], [family], [1, 2], small).collect()
    assert len(got) == 8 and all(r["prediction"] >= 0 and r["actual"] is not None for r in got)
    if family == "linear":
        assert sum(abs(r["prediction"] - r["actual"]) for r in got) / sum(r["actual"] for r in got) < 0.1


def test_models_survive_saving(table, tmp_path):
    models = ml.direct_multi_horizon(table, "linear", FIRST + dt.timedelta(7 * 85), [1])
    ml.save_models(models, str(tmp_path))
    at = table.filter(F.col("forecast_origin_date") == F.lit(FIRST + dt.timedelta(7 * 85)))
    gap = ml.serialization_parity(ml.predict_multi(models, at, "linear"), ml.predict_multi(ml.load_models(str(tmp_path), [1]), at, "linear")).first()
    assert (gap["n"], gap["max_abs_diff"]) == (4, 0.0)


def test_tuning_prefers_the_better_configuration(table):
    from demandloom.operators.metrics import argmin_config

    trials = ml.tune_grid(table, [FIRST + dt.timedelta(7 * 85)], {"linear": [{"regParam": 500.0}, {"regParam": 0.0}]}, [1])
    assert argmin_config(trials).first()["trial_id"] == 1


def test_training_rows_end_before_the_served_origin(table):
    origin = FIRST + dt.timedelta(7 * 85)
    for h in (1, 8):
        last = ml.training_rows(table, origin, h).agg(F.max("forecast_origin_date")).first()[0]
        assert last + dt.timedelta(7 * h) <= origin


def test_backtest_written_by_origin_covers_usable_origins_and_all_horizons(table, tmp_path):
    origins = [FIRST + dt.timedelta(7 * w) for w in (40, 58, 75, 85)]
    usable = ml.usable_origins(table, origins)
    assert usable == origins[2:]  # the first target eight weeks ahead of a row with a lag of 52 weeks is known in week 60
    got = ml.backtest_models(table, usable, ["linear"], root=str(tmp_path / "b")).collect()
    assert {(r["forecast_origin_date"], r["horizon"]) for r in got} == {(o, h) for o in usable for h in range(1, 9)} and len(got) == 4 * 2 * 8


def test_registered_model_queries_ask_for_the_whole_job(spark, monkeypatch):
    from demandloom.operators import linear, trees
    from demandloom.plans import catalog_forecast, load_catalog
    from demandloom.plans.context import Context

    sf, asked = "/root/testdata/sf0.001", []
    c = Context(spark, sf)
    saved = c.features.cache()
    usable = ml.usable_origins(saved, [r[0] for r in c.origins.collect()])
    monkeypatch.setattr(catalog_forecast, "_saved_features", lambda c: saved)

    def record(rows, predictors, origins, growth, horizons=tuple(range(1, 9)), in_task=trees.IN_TASK):
        asked.append((list(origins), len(predictors), list(horizons), growth))
        return grown(rows, predictors, [], growth)

    grown = trees.grow_trees
    monkeypatch.setattr(trees, "grow_trees", record)
    for name in ("model_random_forest", "model_gbt", "model_gbt_absolute"):
        load_catalog()[name].run(spark, sf)
    families = [trees.FAMILIES[f] for f in ("random_forest", "gbt_squared", "gbt_absolute")]
    assert len(usable) >= 9 and asked == [(usable, 50, list(range(1, 9)), g) for g in families]
    assert all(g.rounds * g.bags == 100 for g in families)
    real, fitted = linear.running_linear, []

    def fit(rows, predictors, origins, horizons=tuple(range(1, 9)), ridges=(0.0,)):
        fitted.append((list(origins), len(predictors), list(horizons), len(ridges)))
        return real(rows, predictors, origins, horizons, ridges)

    monkeypatch.setattr(linear, "running_linear", fit)
    for name in ("model_linear", "tune_grid"):
        load_catalog()[name].run(spark, sf)
    assert fitted == [(usable, 50, list(range(1, 9)), 1), (usable[:4], 50, list(range(1, 9)), 34)]


def test_future_perturbation_sees_a_leak_in_any_feature_at_any_origin(spark):
    from demandloom.plans.catalog_quality import perturbed_at_origins
    from demandloom.plans.context import Context

    c = Context(spark, "/root/testdata/sf0.001")
    origin = min(r[0] for r in c.origins.collect())

    def leaking(*inputs):
        leak = F.when(F.col("forecast_origin_date") == F.lit(origin), F.col("target_h3")).otherwise(0)
        return features.feature_table(*inputs).withColumn("log_price", F.col("log_price") + leak)

    gaps = {r["feature"]: r["max_abs_diff"] for r in perturbed_at_origins(c, leaking).collect()}
    assert len(gaps) > 40 and [k for k, v in gaps.items() if v] == ["log_price"]


@pytest.mark.parametrize("rows, builds", [(1, lambda n: [1] * n), (1 << 22, lambda n: [n])])
def test_future_perturbation_copies_as_many_origins_as_fit(spark, rows, builds):
    from demandloom.plans.catalog_quality import perturbed_at_origins
    from demandloom.plans.context import Context

    c, sizes = Context(spark, "/root/testdata/sf0.001"), []
    leaky = min(r[0] for r in c.origins.collect())

    def summed(sales, master, snapshots):
        sizes.append((sales.count(), master.count(), snapshots.count()))
        week = F.expr("date_sub(Date, dayofweek(date_sub(Date, 2)) - 1)").alias("forecast_origin_date")
        weekly = sales.groupBy("SKU", week).agg(F.sum("Units_Sold").alias("now"))
        total = sales.groupBy("SKU").agg(F.sum("Units_Sold").alias("ever"))
        leak = F.when(F.col("forecast_origin_date") == F.lit(leaky), F.col("ever")).otherwise(0)
        return weekly.join(total, "SKU").select("SKU", "forecast_origin_date", "now", leak.alias("leak"))

    gaps = {r["feature"]: r["max_abs_diff"] for r in perturbed_at_origins(c, summed, rows).collect()}
    assert gaps["now"] == 0 and 0 < gaps["leak"] < float("inf")
    one, n = (c.sales.count(), c.norm_master.count(), c.snapshots.count()), c.origins.count()
    assert sizes == [tuple(k * x for x in one) for k in [1, *builds(n)]]
