"""Registered queries that had done a part of their job, on a small star schema of their own."""

import datetime as dt
import json
import random
from dataclasses import asdict, replace

import pytest

from __spark_entry__ import queries
from demandloom.operators.forecast import MODELS
from demandloom.plans import catalog_forecast as plans
from demandloom.plans.context import Context
from demandloom.schemas import STAR

WEEKS = 80


@pytest.fixture(scope="module")
def star(spark, tmp_path_factory):
    root, rng = tmp_path_factory.mktemp("star"), random.Random(8)
    lines = [
        (w * 3 + s, s, s, 1, float(rng.randrange(1, 9) + 5 * s), float(rng.randrange(100, 900)), 0.01 * rng.randrange(0, 10), 0.0, "N", "O", dt.datetime(2022, 1, 4) + dt.timedelta(7 * w + s))
        for w in range(WEEKS) for s in range(3)
    ]
    tables = {
        "region": [(0, "HERE")], "nation": [(0, "PLACE", 0)], "supplier": [(s, f"Supplier {s}", 0, 0.0) for s in range(3)], "lineitem": lines,
    }
    for name, rows in tables.items():
        spark.createDataFrame(rows, STAR[name]).write.parquet(f"{root}/{name}.parquet")
    return str(root)


def test_the_union_has_every_baseline_at_every_origin(spark, star):
    got = queries()["union_forecasts"](spark, star)
    keys = {(r["model"], r["forecast_origin"]) for r in got.select("model", "forecast_origin").collect()}
    origins = [r[0] for r in Context(spark, star).origins.collect()]
    assert keys == {(m, o) for m in MODELS for o in origins}
    assert got.count() == 3 * 8 * len(keys)


def test_tuning_tries_every_configuration_of_every_family(spark, star, monkeypatch):
    """The grids of three tree families and the ridges, every horizon; trees are kept small here, their number of configurations is not."""
    assert all(len(set(grid)) == len(grid) for grid in plans.GRIDS.values())
    sizes = {"linear": len(plans.RIDGES), **{family: len(grid) for family, grid in plans.GRIDS.items()}}
    assert sizes == {"linear": 34, "gbt_leaf_wise": 12, "gbt_level_wise": 12, "random_forest": 10}
    small = {f: [replace(g, rounds=min(g.rounds, 2), bags=min(g.bags, 2), depth=min(g.depth, 3)) for g in grid] for f, grid in plans.GRIDS.items()}
    monkeypatch.setattr(plans, "GRIDS", small)
    rows = queries()["tune_grid"](spark, star).collect()
    assert sorted((r["model"], r["horizon"], r["trial_id"]) for r in rows) == sorted((f, h, k) for f, n in sizes.items() for h in range(1, 9) for k in range(n))
    assert all(r["n_forecasts"] == 3 * min(4, r["n_forecasts"] // 3) > 0 and r["WAPE"] > 0 for r in rows)
    assert all(r["config"] == json.dumps(asdict(small[r["model"]][r["trial_id"]])) for r in rows if r["model"] in small)
