"""Linear models from running sums against one fit per model."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from demandloom.operators import features, linear, ml

FIRST = dt.date(2023, 1, 3)
ORIGINS = [FIRST + dt.timedelta(7 * w) for w in (75, 80, 85)]


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(4)
    rows = [(f"SKU{s:03d}", FIRST + dt.timedelta(7 * w), rng.randrange(5, 60) + 4 * s, 0, 0) for s in range(1, 7) for w in range(100)]
    weekly = spark.createDataFrame(rows, "SKU string, week_start date, Units_Sold bigint, promo_days bigint, promo_active int")
    out = features.demand_lags(features.targets_multi_horizon(weekly), lags=(1, 2, 4, 52))
    out = out.drop("Units_Sold", "promo_days", "promo_active").withColumnRenamed("week_start", "forecast_origin_date")
    # A constant predictor and one that depends on others leave the predictions as they are.
    return out.withColumns({"still": F.lit(3.0), "both": F.col("lag_1") + F.col("lag_2") * 1e4}).fillna(-1, ["lag_1", "lag_2", "lag_4", "both"]).cache()


PREDICTORS = ["lag_1", "lag_2", "lag_4", "lag_52", "still", "both"]


def test_equals_single_fits(spark, table):
    fits = linear.running_linear(table, PREDICTORS, ORIGINS, ridges=[0.0, 0.5])
    got = {(r.SKU, r.forecast_origin_date, r.horizon, r.trial_id): r for r in linear.predict_linear(table, PREDICTORS, fits).collect()}
    assert len(got) == 6 * 3 * 8 * 2
    rows = table.toPandas()
    for origin in ORIGINS:
        for h in (1, 5, 8):
            known = rows[(rows.forecast_origin_date <= origin - dt.timedelta(7 * h)) & rows.lag_52.notna()]
            a = np.column_stack([np.ones(len(known)), known[PREDICTORS].to_numpy(float)])
            w = np.linalg.lstsq(a, known[f"target_h{h}"].to_numpy(float), rcond=None)[0]
            for _, r in rows[rows.forecast_origin_date == origin].iterrows():
                one = got[(r.SKU, origin, h, 0)]
                want = max(0.0, float(np.concatenate(([1.0], r[PREDICTORS].to_numpy(float))) @ w))
                assert one.prediction == pytest.approx(want, rel=1e-6) and one.actual == r[f"target_h{h}"]
                assert one.target_date == origin + dt.timedelta(7 * h)
    n = {(r.forecast_origin_date, r.horizon): r.n_train for r in fits.where("trial_id = 0").collect()}
    assert n[(ORIGINS[0], 8)] == 6 * (75 - 8 - 51 + 1)


def test_residuals_sum_to_zero_and_a_ridge_shrinks(table):
    fits = linear.running_linear(table, PREDICTORS, ORIGINS, [1, 8], [0.0, 1000.0])
    got = linear.training_residuals(table, PREDICTORS, fits.where("trial_id = 0")).collect()
    assert len(got) == 6 and all(abs(r.residual_sum) < 1e-6 * r.n_train and r.residual_cosine < 1e-8 for r in got)
    small = {(r.forecast_origin_date, r.horizon, r.trial_id): abs(r.slopes[3]) for r in fits.collect()}
    assert all(small[(o, h, 1)] < 0.01 * small[(o, h, 0)] + 1e-9 for o, h, t in small if t == 0)


def test_origins_without_history_and_missing_predictors(spark, table):
    early = [FIRST + dt.timedelta(7 * w) for w in (20, 60)]
    models = {(r.forecast_origin_date, r.horizon) for r in linear.running_linear(table, PREDICTORS, early).collect()}
    assert models == {(early[1], h) for h in range(1, 9)}
    assert linear.running_linear(table, PREDICTORS, []).collect() == []
    with pytest.raises(Exception, match="a predictor is null"):
        linear.running_linear(table.withColumn("lag_1", F.lit(None).cast("long")), PREDICTORS, ORIGINS).collect()


def test_text_predictors_take_the_place_of_their_declared_label(spark, tmp_path):
    rows = spark.createDataFrame([("b", "Premium", 1.0), ("a", None, None), (None, "Budget", 2.0)], "Category string, Price_Tier string, x double")
    columns = ["Category", "Price_Tier", "x"]
    ml.encoder(rows, columns).write().overwrite().save(str(tmp_path / "step"))
    step = ml.DemandFeatures.load(str(tmp_path / "step"))
    more = rows.union(spark.createDataFrame([("new", "Other", 0.0)], rows.schema))
    got = [tuple(r) for r in step.transform(more).select(*step.get_feature_names()).collect()]
    assert got == [(1.0, 2.0, 1.0), (0.0, -1.0, -1.0), (-1.0, 0.0, 2.0), (-1.0, -1.0, 0.0)]
    with pytest.raises(ValueError, match="no labels are declared"):
        ml.DemandFeatures(inputCols=columns).transform(rows)
    with pytest.raises(ValueError, match="more than"):
        ml.label_vocabulary(spark.range(10_001).select(F.col("id").cast("string").alias("Category")), ["Category"])


def test_residuals_take_one_pass_without_pairing_rows_with_models(spark, table, capsys):
    fits = linear.running_linear(table, PREDICTORS, ORIGINS, [2, 8]).withColumn("slopes", F.transform("slopes", lambda s: s + 0.5))
    residuals = linear.training_residuals(table, PREDICTORS, fits)
    got = {(r.forecast_origin_date, r.horizon): r for r in residuals.collect()}
    capsys.readouterr()
    residuals.explain()
    assert "Join" not in capsys.readouterr().out
    rows = table.toPandas()
    for f in fits.collect():
        known = rows[(rows.forecast_origin_date <= f.forecast_origin_date - dt.timedelta(7 * f.horizon)) & rows.lag_52.notna()]
        a = known[PREDICTORS].to_numpy(float)
        r = known[f"target_h{f.horizon}"].to_numpy(float) - f.intercept - a @ np.array(f.slopes)
        one = got.pop((f.forecast_origin_date, f.horizon))
        cosine = max(abs(a.T @ r) / np.sqrt((a * a).sum(0) * (r @ r)))
        assert (one.n_train, one.residual_sum, one.residual_cosine) == (len(known), pytest.approx(r.sum()), pytest.approx(cosine))
    assert not got


def test_a_row_meets_all_models_of_its_origin_at_once(spark, table):
    """No join with the models; values are sums in the order of the predictors, and a null predictor gives none."""
    fits = linear.running_linear(table, PREDICTORS, ORIGINS, [2, 5], [0.0, 0.5, 2.0]).cache()
    blank = table.withColumn("lag_4", F.when(F.col("SKU") != "SKU002", F.col("lag_4")))
    got = linear.linear_values(blank, PREDICTORS, fits, ["SKU", "forecast_origin_date"])
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    values = {(r.SKU, r.forecast_origin_date, r.horizon, r.trial_id): r.raw_prediction for r in got.collect()}
    x = {(r.SKU, r.forecast_origin_date): [float(r[c]) for c in PREDICTORS] for r in table.where(F.col("forecast_origin_date").isin(ORIGINS)).collect()}
    assert len(values) == 6 * 3 * 2 * 3
    for m in fits.collect():
        for sku in {k[0] for k in x}:
            total = 0.0
            for a, b in zip(x[sku, m.forecast_origin_date], m.slopes):
                total += a * b
            want = None if sku == "SKU002" else m.intercept + total
            assert values[sku, m.forecast_origin_date, m.horizon, m.trial_id] == want
    early = linear.running_linear(table, PREDICTORS, [FIRST])
    assert linear.predict_linear(table, PREDICTORS, early).count() == 0
