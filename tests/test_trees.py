"""Trees grown side by side: both ways of growing agree, sums give the best split, nothing of the future is learned."""

import datetime as dt
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from demandloom.operators import ml, trees
from demandloom.operators.trees import FAMILIES, Growth

FIRST, WEEKS = dt.date(2023, 1, 3), 90
X = ["lag_1", "lag_52", "price", "flat"]


def weekly_rows(change=lambda day, y: y):
    rng, rows = np.random.default_rng(3), []
    for s in range(6):
        series = [float(20 + 6 * s + 10 * ((w // 5) % 2) + int(rng.integers(0, 4))) for w in range(WEEKS + 8)]
        for w in range(WEEKS):
            day = FIRST + dt.timedelta(7 * w)
            ahead = [change(day + dt.timedelta(7 * h), series[w + h]) if not (s == 2 and w == 60) else None for h in (1, 2)]
            rows.append((f"SKU{s:03d}", day, series[w], series[w - 52] if w >= 52 else None, 5.0 + s % 3, 1.0, *ahead))
    return rows


def table(spark, rows):
    schema = "SKU string, forecast_origin_date date, lag_1 double, lag_52 double, price double, flat double, target_h1 double, target_h2 double"
    return spark.createDataFrame(rows, schema)


ORIGINS = [FIRST + dt.timedelta(7 * w) for w in (75, 85)]
SMALL = [
    Growth(rounds=4, depth=3, least_rows=3, rate=0.3),
    Growth(rounds=3, depth=2, least_rows=3, loss="absolute", l1=0.5, l2=1.0),
    Growth(rounds=1, bags=4, depth=3, rate=1.0, least_rows=2, bootstrap=True, column_share=0.5),
]


@pytest.mark.parametrize("growth", SMALL)
def test_levels_over_the_whole_table_give_the_trees_of_single_tasks(spark, growth):
    rows = table(spark, weekly_rows()).repartition(5)
    near, _ = trees.grow_trees(rows, X, ORIGINS, growth, (1, 2))
    far, _ = trees.grow_trees(rows, X, ORIGINS, growth, (1, 2), in_task=0)
    got, want = ([tuple(map(bytes_or_value, r)) for r in t.orderBy("origin", "horizon", "bag", "round").collect()] for t in (far, near))
    assert got == want and len(got) == 2 * 2 * growth.bags * (growth.rounds + 1 - growth.first)
    assert any(np.frombuffer(r[4], np.int16).max() >= 0 for r in got)


def bytes_or_value(v):
    return bytes(v) if isinstance(v, bytearray) else v


def test_best_split_is_that_of_brute_force():
    rng, growth = np.random.default_rng(5), Growth(least_rows=4, l1=0.2, l2=1.5)
    bins, y = rng.integers(0, trees.BINS, (3, 200)).astype(np.uint8), rng.normal(0, 2, 200)
    pull = np.rint(y * trees.SCALE)
    at, border = trees.best_splits(trees.level_sums(bins, np.arange(3), np.zeros(200, int), 1, np.ones(200), pull), growth)

    def score(part):
        return max(abs(part.sum()) - 0.2 * trees.SCALE, 0) ** 2 / (len(part) + 1.5)

    cuts = [(score(pull[bins[c] <= b]) + score(pull[bins[c] > b]), -c, -b) for c in range(3) for b in range(trees.BINS) if 4 <= (bins[c] <= b).sum() <= 196]
    best = max(cuts)
    assert (at[0], border[0]) == (-best[1], -best[2])


def test_boosting_learns_and_medians_resist_outliers():
    rng = np.random.default_rng(7)
    bins = rng.integers(0, trees.BINS, (4, 3000)).astype(np.uint8)
    truth = np.where(bins[0] > 30, 50.0, 10.0) + bins[1] / 8
    y = truth + np.where(rng.random(3000) < 0.05, 400.0, 0.0)
    row, gap = rng.integers(0, 1 << 62, 3000), {}
    for name, growth in FAMILIES.items():
        found = list(trees.grow(bins, row, y, replace(growth, bags=min(growth.bags, 10))))
        fitted = sum((growth.rate if t else 1.0) * tree.value[tree.leaves(bins, growth.depth if t else 0)] for _, t, tree in found) / min(growth.bags, 10)
        gap[name] = np.abs(fitted - truth).mean()
    assert gap["gbt_absolute"] < 3 < gap["gbt_squared"] < 40


@pytest.mark.parametrize("in_task", [0, trees.IN_TASK])
def test_targets_after_the_origin_change_nothing(spark, in_task):
    growth = Growth(rounds=2, depth=2, least_rows=3)
    late = [(lambda day, y: y), (lambda day, y: y * 100 if day > ORIGINS[0] else y)]
    got = []
    for change in late:
        found, borders = trees.grow_trees(table(spark, weekly_rows(change)), X, ORIGINS[:1], growth, (1, 2), in_task=in_task)
        rows = found.orderBy("origin", "horizon", "round").collect()
        got.append(([tuple(map(bytes_or_value, r)) for r in rows], {o: b.tolist() for o, b in borders.items()}))
    assert got[0] == got[1]


def test_predictions_cover_every_item_and_beat_the_mean(spark):
    rows, growth = table(spark, weekly_rows()), Growth(rounds=30, depth=3, least_rows=3, rate=0.2)
    found, borders = trees.grow_trees(rows, X, ORIGINS, growth, (1, 2))
    got = trees.predict_trees(rows, X, found, borders, growth, "gbt", (1, 2)).toPandas()
    assert len(got) == 2 * 2 * 6 and (got.prediction >= 0).all() and not got.duplicated(["SKU", "forecast_origin_date", "horizon"]).any()
    assert (got.prediction - got.actual).abs().mean() < 0.6 * (got.actual - got.actual.mean()).abs().mean()


def test_empty_tables_and_early_origins_give_no_trees(spark):
    rows, growth = table(spark, weekly_rows()), Growth(rounds=2, depth=2)
    for source, origins in ((rows.limit(0), ORIGINS), (rows, [FIRST]), (rows, [])):
        found, borders = trees.grow_trees(source, X, origins, growth, (1, 2))
        assert found.count() == 0 and trees.predict_trees(source, X, found, borders, growth, "gbt", (1, 2)).count() == 0


def test_training_rows_are_those_of_single_fits(spark):
    """A tree of one leaf is the mean target of the training rows."""
    rows = table(spark, weekly_rows())
    found, _ = trees.grow_trees(rows, X, ORIGINS, Growth(rounds=2, depth=1), (1, 2))
    for r in found.where("round = 0").collect():
        origin = dt.date(1970, 1, 1) + dt.timedelta(r["origin"])
        mean = ml.training_rows(rows, origin, r["horizon"]).agg(F.avg(f"target_h{r['horizon']}")).first()[0]
        assert abs(np.frombuffer(r["value"])[0] - mean) < 1e-6


@pytest.mark.parametrize("growth", [Growth(least_rows=3, l1=0.3), Growth(bootstrap=True, least_rows=2)])
def test_sums_of_children_are_those_of_counting_every_row(growth):
    rng = np.random.default_rng(11)
    bins, node = rng.integers(0, trees.BINS, (5, 400)).astype(np.uint8), rng.integers(0, 4, 400)
    weight, pull = trees.row_weights(rng.integers(0, 1 << 62, 400), growth, 0, 1), rng.integers(-(1 << 30), 1 << 30, 400).astype(float)
    columns, split = np.array([0, 2, 3]), np.array([True, False, True, True])
    above = trees.level_sums(bins, columns, node, 4, weight, pull)
    going = split[node]
    child = (2 * node + (bins[1] > 40))[going]
    part = bins[:, going], columns, child
    got = trees.child_sums(*part, above, split, weight[going], pull[going])
    assert (got == trees.level_sums(*part, 8, weight[going], pull[going])).all()


def test_rows_are_counted_once_on_the_way_down(monkeypatch):
    """Below the root at most every second row is summed up."""
    rng, seen = np.random.default_rng(2), []
    counted = trees.level_sums
    monkeypatch.setattr(trees, "level_sums", lambda bins, *rest: seen.append(bins.shape[1]) or counted(bins, *rest))
    bins = rng.integers(0, trees.BINS, (4, 2000)).astype(np.uint8)
    list(trees.grow(bins, rng.integers(0, 1 << 62, 2000), bins[0] * 1.0 + bins[1], Growth(rounds=1, depth=4, row_share=1.0)))
    assert seen[0] == 2000 and len(seen) == 4 and max(seen[1:]) <= 1000


def item_and_week_bins():
    """Three predictors of an item, two of a week, four of both."""
    rng = np.random.default_rng(13)
    item, week = (a.ravel() for a in np.meshgrid(np.arange(60), np.arange(100), indexing="ij"))
    of_item, of_week = rng.integers(0, trees.BINS, (3, 60))[:, item], rng.integers(0, trees.BINS, (2, 100))[:, week]
    return np.concatenate([np.tile(np.concatenate((of_item, of_week)), 5), rng.integers(0, 20, (4, 30_000))]).astype(np.uint8)


def test_bundles_hold_every_predictor_once():
    bins = item_and_week_bins()
    found = trees.bundles(bins)
    assert sorted(c for b in found for c in b.members) == list(range(9))
    assert any({0, 1, 2} <= set(b.members) for b in found)
    for b in found:
        assert len(b.bins) <= trees.COMBINATIONS and (b.bins[b.code].T == bins[list(b.members)]).all()


@pytest.mark.parametrize("growth", [Growth(rounds=3, l1=0.2), Growth(rounds=2, loss="absolute"), Growth(rounds=1, bags=3, depth=6, rate=1.0, least_rows=2, bootstrap=True, column_share=0.5)])
def test_bundles_change_no_tree_and_count_rows_less_often(monkeypatch, growth):
    bins, counted, count = item_and_week_bins(), [], np.bincount
    y, row = bins[0] / 3.0 + bins[4] + bins[7] / 9.0, np.arange(30_000) * 7919

    def grown():
        counted.clear()
        out = [(bag, turn, t.column.tobytes(), t.border.tobytes(), t.value.tobytes()) for bag, turn, t in trees.grow(bins, row, y, growth)]
        return out, sum(counted)

    monkeypatch.setattr(np, "bincount", lambda x, *rest, **more: counted.append(len(x)) or count(x, *rest, **more))
    found = trees.bundles(bins)
    monkeypatch.setattr(trees, "bundles", lambda bins: found)
    got, rows = grown()
    monkeypatch.setattr(trees, "bundles", lambda bins: [])
    want, more = grown()
    assert got == want
    assert rows < 0.95 * more


def test_medians_are_those_of_sorted_rows(monkeypatch):
    rng = np.random.default_rng(17)
    place, key, w = rng.integers(0, 7, 500), rng.integers(-40, 40, 500), rng.integers(1, 4, 500).astype(float)
    growth = Growth(loss="absolute", l1=0.3, l2=2.0)
    got = trees.leaf_values(place, key, w, w, growth, 7)
    monkeypatch.setattr(trees, "CELLS", 0)
    assert (got == trees.leaf_values(place, key, w, w, growth, 7)).all() and (got != 0).any()


@pytest.mark.parametrize("growth", [Growth(rounds=1, bags=3, depth=9, rate=1.0, least_rows=2, least_split=7, bootstrap=True, column_share=0.6), Growth(rounds=3, depth=8, least_rows=3, l1=0.1, l2=1.0)])
def test_bins_that_occur_give_the_splits_of_all_bins(monkeypatch, growth):
    rng = np.random.default_rng(23)
    bins, row = rng.integers(0, 20, (5, 2500)).astype(np.uint8), rng.integers(0, 1 << 62, 2500)
    y = bins[0] / 2.0 + (bins[1] > 9) * bins[2] + rng.normal(0, 2, 2500)
    used, few = [], trees.gains_of_few_rows
    monkeypatch.setattr(trees, "gains_of_few_rows", lambda *x: used.append(1) or few(*x))

    def grown():
        used.clear()
        return [(t.column.tobytes(), t.border.tobytes(), t.value.tobytes()) for _, _, t in trees.grow(bins, row, y, growth)], len(used)

    monkeypatch.setattr(trees, "FEW_NODES", 0)
    got, times = grown()
    monkeypatch.setattr(trees, "FEW_NODES", 1 << 20)
    assert grown() == (got, 0) and times


def test_leaf_limits_keep_the_splits_of_growing_at_the_best_leaf():
    rng = np.random.default_rng(29)
    bins, row = rng.integers(0, trees.BINS, (4, 3000)).astype(np.uint8), rng.integers(0, 1 << 62, 3000)
    y = np.where(bins[0] < 8, 3.0 * bins[1], 0.0) + bins[2] / 50 + rng.normal(0, 0.1, 3000)
    growth = Growth(rounds=1, depth=7, least_rows=5, row_share=1.0, column_share=1.0, leaves=6)
    (_, _, tree), = trees.grow(bins, row, y, growth)
    pull, open_, kept = np.rint(y * trees.SCALE), {0: np.arange(3000)}, set()

    def split(rows):
        at, border, gain = trees.best_gains(trees.level_sums(bins[:, rows], np.arange(4), np.zeros(len(rows), int), 1, np.ones(len(rows)), pull[rows]), growth)
        return gain[0], int(at[0]), int(border[0])

    for _ in range(5):
        (gain, column, border), node = max((split(rows), node) for node, rows in open_.items())
        assert column >= 0 and (tree.column[node], tree.border[node]) == (column, border)
        rows = open_.pop(node)
        left = bins[column, rows] <= border
        open_ |= {2 * node + 1: rows[left], 2 * node + 2: rows[~left]}
        kept.add(node)
    assert set(np.flatnonzero(tree.column >= 0)) == kept and max(kept) > 6
    for node, rows in open_.items():
        assert tree.value[node] == pytest.approx(y[rows].mean(), abs=1e-4)


GRID = [Growth(rounds=3, depth=4, least_rows=3, rate=0.3, leaves=5), Growth(rounds=1, bags=2, depth=6, rate=1.0, least_rows=1, least_split=4, bootstrap=True, column_share=0.7), SMALL[1]]


@pytest.mark.parametrize("in_task", [0, trees.IN_TASK])
def test_trials_of_a_grid_are_the_trees_of_single_growths(spark, in_task):
    rows = table(spark, weekly_rows()).repartition(3)
    found, borders = trees.grow_trees(rows, X, ORIGINS[:1], GRID, (1, 2), in_task=in_task)
    got = {(r.trial, r.horizon, r.bag, r.round): bytes(r.column) + bytes(r.border) + bytes(r.value) for r in found.collect()}
    preds = {(r.trial_id, r.SKU, r.horizon): r.prediction for r in trees.predict_trees(rows, X, found, borders, GRID, "m", (1, 2)).collect()}
    assert len(preds) == 3 * 6 * 2
    for k, growth in enumerate(GRID):
        one, edges = trees.grow_trees(rows, X, ORIGINS[:1], growth, (1, 2))
        assert {x[1:]: v for x, v in got.items() if x[0] == k} == {(r.horizon, r.bag, r.round): bytes(r.column) + bytes(r.border) + bytes(r.value) for r in one.collect()}
        for r in trees.predict_trees(rows, X, one, edges, growth, "m", (1, 2)).collect():
            assert preds[k, r.SKU, r.horizon] == r.prediction


def test_every_model_is_grown_in_a_task_of_its_own(spark):
    """Each task writes a file: as many as there are models and parts of the grid."""
    rows = table(spark, weekly_rows())
    found, _ = trees.grow_trees(rows, X, ORIGINS, [Growth(rounds=2, depth=1)] * 11, (1, 2))
    assert found.groupBy("origin", "horizon", "trial").count().where("count = 3").count() == 2 * 2 * 11
    assert len(found.inputFiles()) == 2 * 2 * 3
