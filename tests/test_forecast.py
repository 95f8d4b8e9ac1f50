import datetime as dt

import numpy as np
import pandas as pd
import pytest

from demandloom.operators import features, forecast, metrics

FIRST = dt.date(2023, 12, 26)


def weekly_rows(weeks=90, skus=3, seed=42):
    rng = np.random.default_rng(seed)
    return [(f"SKU{s:03d}", FIRST + dt.timedelta(7 * w), int(rng.integers(1, 30)), int(rng.integers(0, 8)), 1) for s in range(1, skus + 1) for w in range(weeks)]


@pytest.fixture(scope="module")
def weekly(spark):
    return spark.createDataFrame(weekly_rows(), "SKU string, week_start date, Units_Sold bigint, promo_days bigint, promo_active int")


def test_origins_are_even_and_leave_the_holdout(spark, weekly):
    got = sorted(r[0] for r in forecast.rolling_origins(weekly, n_folds=4).collect())
    first, last = 51, 90 - 8 - 8
    want = sorted({round(first + i * (last - first) / 3) for i in range(4)})
    assert [(x - FIRST).days // 7 for x in got] == want
    assert len(forecast.holdout_weeks(weekly).collect()) == 8


def test_short_history_raises(spark, weekly):
    with pytest.raises(Exception, match="history too short"):
        forecast.rolling_origins(weekly, min_train=80).collect()


def test_baselines_equal_their_definitions(spark, weekly):
    origins = forecast.rolling_origins(weekly, n_folds=3)
    got = {(r["model"], r["SKU"], r["forecast_origin"], r["horizon"]): (r["forecast"], r["actual"]) for r in forecast.baseline_forecasts(weekly, origins).collect()}
    series = {}
    for sku, week, units, *_ in weekly_rows():
        series.setdefault(sku, []).append(units)
    assert len(got) == 5 * 3 * 3 * 8
    for (model, sku, origin, h), (value, actual) in got.items():
        t = (origin - FIRST).days // 7
        hist = series[sku][: t + 1]
        lag = len(hist) - 52 + h - 1
        want = {
            "naive": hist[-1], "ma4": np.mean(hist[-4:]), "ma8": np.mean(hist[-8:]),
            "ses": pd.Series(hist, dtype=float).ewm(alpha=0.3, adjust=False).mean().iloc[-1],
            "seasonal_naive": hist[lag] if lag >= 0 else np.mean(hist),
        }[model]
        assert value == pytest.approx(want, rel=1e-12)
        assert actual == (series[sku][t + h] if t + h < 90 else None)


def test_unknown_origin_raises_and_known_origin_filters(spark, weekly):
    fc = forecast.baseline_forecasts(weekly, forecast.rolling_origins(weekly, n_folds=2), ["naive"])
    with pytest.raises(Exception, match="unknown forecast origin"):
        forecast.select_origin_slice(fc, "2020-01-01").collect()
    assert forecast.select_origin_slice(fc, skus=["SKU002"]).count() == 8


def test_metric_values(spark):
    df = spark.createDataFrame([("m", "A", 1, 10.0, 12.0), ("m", "A", 1, 20.0, 16.0), ("m", "B", 1, 0.0, 1.0), ("m", "B", 1, None, 5.0)], "model string, SKU string, horizon int, actual double, forecast double")
    r = metrics.forecast_metrics(df).first()
    assert r["WAPE"] == pytest.approx(7 / 30 * 100) and r["MAE"] == pytest.approx(7 / 3) and r["n_forecasts"] == 3
    assert r["RMSE"] == pytest.approx(np.sqrt((4 + 16 + 1) / 3))
    by = {x["SKU"]: x["WAPE"] for x in metrics.forecast_metrics(df, ["SKU"]).collect()}
    assert by["B"] is None
    macro = metrics.macro_wape(df).first()
    assert macro["Macro_WAPE"] == pytest.approx(20.0) and macro["n_skus"] == 2


def test_architecture_keeps_the_first_listed_model_on_ties(spark):
    table = spark.createDataFrame([("seasonal_naive", 1, 10.0), ("naive", 1, 10.0), ("naive", 2, 8.0), ("seasonal_naive", 2, 9.0)], "model string, horizon int, WAPE double")
    got = {r["horizon"]: r["selected_model"] for r in metrics.select_architecture(table, ["seasonal_naive", "naive"]).collect()}
    assert got == {1: "seasonal_naive", 2: "naive"}


def test_window_features_equal_pandas(spark, weekly):
    out = features.promo_features(features.ewma(features.rolling_stats(features.demand_lags(features.targets_multi_horizon(weekly))))).toPandas()
    for _, g in out.sort_values("week_start").groupby("SKU"):
        u = g["Units_Sold"].astype(float).reset_index(drop=True)
        g = g.reset_index(drop=True)
        np.testing.assert_allclose(g["lag_13"].astype(float), u.shift(12))
        np.testing.assert_allclose(g["target_h8"].astype(float), u.shift(-8))
        np.testing.assert_allclose(g["rolling_mean_8"].astype(float), u.rolling(8).mean())
        np.testing.assert_allclose(g["rolling_std_4"].astype(float), u.rolling(4).std(), atol=1e-9)
        np.testing.assert_allclose(g["ewma_decay_01"], u.ewm(alpha=0.1, adjust=False).mean())
        np.testing.assert_allclose(g["promo_days_last_4w"], g["promo_days"].rolling(4).sum().fillna(0))



def test_smoothing_of_a_long_series_of_large_demand_equals_a_fold(spark):
    rng = np.random.default_rng(8)
    units = [int(x) for x in rng.integers(0, 10_000_000, 3000)]
    units[1000:1400] = [0] * 400
    rows = [(s, FIRST + dt.timedelta(7 * w), u) for s in ("A", "B") for w, u in enumerate(units)]
    got = features.ewma(spark.createDataFrame(rows, "SKU string, week_start date, Units_Sold bigint")).orderBy("SKU", "week_start").collect()
    for name, alpha in features.SMOOTHING.items():
        level, want = float(units[0]), []
        for u in units:
            level = alpha * u + (1 - alpha) * level if want else level
            want.append(level)
        assert [r[name] for r in got[:3000]] == pytest.approx(want, rel=1e-9, abs=1e-6)
        assert [r[name] for r in got[3000:]] == pytest.approx(want, rel=1e-9, abs=1e-6)


def test_a_production_run_off_the_weekly_grid_raises(spark, tmp_path):
    from demandloom.plans.context import Context
    from demandloom.plans.pipeline import production_run

    with pytest.raises(ValueError, match="not the start of a week"):
        production_run(Context(spark, "/root/testdata/sf0.001"), str(tmp_path), "2001-07-20")
