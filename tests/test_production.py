"""The production run: taking it up after a stop, the choice per horizon, governance."""

import datetime as dt

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from demandloom.operators import decide, metrics
from demandloom.operators.forecast import MODELS
from demandloom.plans import pipeline
from demandloom.plans.context import Context

SF = "/root/testdata/sf0.001"
STAGES = ["sales", "master", "inventory", "checks", "quarantine", "candidates", "architecture", "forecasts", "risk", "recommendations", "governed", "report"]


class Killed(Exception):
    pass


def sorted_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_a_run_killed_around_every_commit_ends_with_the_same_tables(spark, tmp_path, monkeypatch):
    c = Context(spark, SF)
    whole = pipeline.production_run(c, str(tmp_path / "whole"), candidates=MODELS)
    assert [r["stage"] for r in whole.manifest.orderBy("position").collect()] == STAGES
    root, once, ran = str(tmp_path / "killed"), pipeline.Stages._once, []

    def stopping(self, name, write, count, expected):
        def noted():
            ran.append(name)
            write()
            if ran.count(name) == 1 and STAGES.index(name) % 3 == 1:
                raise Killed  # the table is there, its commit is not

        before = len(ran)
        once(self, name, noted, count, expected)
        if len(ran) > before and STAGES.index(name) % 3 == 2:
            raise Killed  # committed, nothing after it has begun

    monkeypatch.setattr(pipeline.Stages, "_once", stopping)
    for stops in range(len(STAGES) + 1):
        try:
            again = pipeline.production_run(c, root, candidates=MODELS)
            break
        except Killed:
            pass
    assert stops == 8
    assert sorted(ran) == sorted(STAGES + [s for i, s in enumerate(STAGES) if i % 3 == 1])
    for table in ("recommendations", "forecasts", "architecture", "manifest"):
        assert sorted_rows(getattr(again, table)) == sorted_rows(getattr(whole, table))
    monkeypatch.setattr(pipeline.Stages, "_once", once)
    # Another choice of candidates in the same folder is another run.
    other = pipeline.production_run(c, root, candidates=["seasonal_naive"])
    assert {r[0] for r in other.architecture.select("selected_model").collect()} == {"seasonal_naive"}
    # Going back may not take up tables that the other run has overwritten.
    ran.clear()
    monkeypatch.setattr(pipeline.Stages, "_once", lambda self, name, *a: (once(self, name, *a), ran.append(self.committed[name]["after"] == self.run)))
    back = pipeline.production_run(c, root, candidates=MODELS)
    assert not any(ran)
    assert sorted_rows(back.forecasts) == sorted_rows(whole.forecasts)


def test_unknown_candidates_raise(spark, tmp_path):
    for wrong in (["naive"], ["seasonal_naive", "oracle"]):
        with pytest.raises(ValueError, match="candidates are"):
            pipeline.production_run(Context(spark, SF), str(tmp_path), candidates=wrong)


def test_a_stage_with_other_rows_than_expected_is_not_committed(spark, tmp_path):
    stages = pipeline.Stages(spark, str(tmp_path), "run")
    with pytest.raises(ValueError, match="3 rows instead of 4"):
        stages.table("a", lambda: spark.range(3), 4)
    assert pipeline.Stages(spark, str(tmp_path), "run").committed == {}


def day(week):
    return dt.date(2024, 1, 2) + dt.timedelta(7 * week)


def forecasts_of(spark, rows):
    """(model, origin week, horizon, forecast, actual)"""
    rows = [("A", m, day(o), h, day(o + h), float(f), None if a is None else float(a)) for m, o, h, f, a in rows]
    return spark.createDataFrame(rows, "SKU string, model string, forecast_origin date, horizon int, target_week date, forecast double, actual double")


def test_architecture_uses_only_what_was_known_at_the_origin(spark):
    rows = [
        ("seasonal_naive", 0, 1, 5, 10), ("naive", 0, 1, 9, 10),  # naive is better at horizon 1
        ("seasonal_naive", 0, 2, 8, 10), ("naive", 0, 2, 12, 10),  # equal: the benchmark stays
        ("seasonal_naive", 8, 3, 0, 10), ("naive", 8, 3, 10, 10),  # its target is after the origin
        ("seasonal_naive", 9, 1, 10, 10), ("naive", 9, 1, 0, 10),  # the origin itself
    ]
    got = metrics.architecture_at(forecasts_of(spark, rows), day(9), ["seasonal_naive", "naive"], horizon=3).orderBy("horizon").collect()
    assert [(r["horizon"], r["selected_model"], r["selection_reason"]) for r in got] == [
        (1, "naive", "challenger beats benchmark"), (2, "seasonal_naive", "benchmark kept"), (3, "seasonal_naive", "no earlier origin"),
    ]
    assert len({r["version"] for r in got}) == 1 and len(got[0]["version"]) == 12
    same = metrics.architecture_at(forecasts_of(spark, rows[::-1]), day(9), ["seasonal_naive", "naive"], horizon=3)
    assert {r["version"] for r in same.collect()} == {got[0]["version"]}
    other = metrics.architecture_at(forecasts_of(spark, rows), day(9), ["seasonal_naive"], horizon=3)
    assert {r["version"] for r in other.collect()} != {got[0]["version"]}


def test_governance_blocks_money_and_foreign_policies(spark):
    rows = spark.createDataFrame([("A", "Policy_B_LT", 8, 12.5)], "sku string, on_order_policy string, overstock_threshold_weeks int, capital_at_risk double")
    got = decide.govern(rows).first()
    assert got["capital_at_risk"] is None and got["monetary_valuation_blocked"] and not got["valuation_basis_confirmed"]
    assert got["overstock_threshold_status"] == "POLICY_RATIFIED"
    for column, wrong in (("on_order_policy", "'Policy_A'"), ("overstock_threshold_weeks", "6"), ("on_order_policy", "CAST(NULL AS STRING)")):
        with pytest.raises(PySparkException, match="not ratified"):
            decide.govern(rows.withColumn(column, F.expr(wrong))).collect()
