"""A cross-section of the registered queries against their SQL at the smallest scale."""

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries

SF = "/root/testdata/sf0.001"
NAMES = (
    "integrate_daily_panel", "dq_suite", "panel_fill_weekly", "temporal_patterns", "promotion_lift", "demand_distribution", "sku_demand_profile",
    "feature_table", "dq_future_perturbation", "evaluate_forecasts", "risk_scores", "recommendations", "production_run", "overstock_sweep_items",
    "valuation_hypotheses",
)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("region", "nation", "supplier", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_every_oracle_belongs_to_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry_scores_every_horizon(spark):
    assert sorted(r["horizon"] for r in entry(spark).collect()) == list(range(1, 9))


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    df = queries()[name](spark, SF)
    cur = duck.execute(oracle_sql()[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted((tuple(r[names.index(c)] for c in df.columns) for r in cur.fetchall()), key=repr)
    assert sorted((tuple(r) for r in df.collect()), key=repr) == want
