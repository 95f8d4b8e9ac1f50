"""Tree ensembles of every origin and horizon, grown side by side from binned predictors.

Predictors are cut once per origin at quantiles of the rows known there. A tree is then grown from sums per node, predictor and
bin alone. Where the training rows of a model are more than ``in_task`` of them, each level is one aggregate of these sums over
the whole table, for all horizons and bags together. A smaller model is grown to its end in one task, and all such models in one job.
Gradients are whole multiples of 1 / ``SCALE``, so sums do not depend on the order of rows, and both ways give the same trees.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..sources.checkpoints import work_dir
from .features import HORIZON, KEYS
from .linear import DATE, cutoff_days

BINS, SCALE, IN_TASK, ROWS_AT_ONCE = 64, 65536.0, 1 << 21, 100_000
#: Cells of node, predictor and bin that one task holds.
CELLS = 4_000_000
#: Combinations of bins of predictors that are summed up together, and rows looked at to choose these predictors.
COMBINATIONS, LOOKED_AT = 4096, 5_000
#: Levels of more nodes than these and one for so many rows are split by the bins that occur instead of by tables of all bins.
FEW_NODES, ROWS_OF_NODE = 32, 48
#: Medians of leaves are taken on a grid of this many steps per unit of log(1 + |residual|).
STEPS = 1024
TREES = "origin int, horizon int, bag int, round int, column binary, border binary, value binary, trial int"
#: Configurations of a grid that one task grows for a model, one after the other.
TRIALS_AT_ONCE = 5


@dataclass(frozen=True)
class Growth:
    """How the trees of one model are grown.

    ``rounds`` trees follow one another, each on what those before it leave (times ``rate``); ``bags`` such rows of trees are independent and
    averaged. ``row_share`` of the rows (or a bootstrap) and ``column_share`` of the predictors serve a tree. ``l1`` and ``l2`` shrink leaves.
    A node of fewer than ``least_split`` rows stays a leaf. With ``leaves`` a tree grows at its leaf of the greatest gain until it has so many.
    """

    rounds: int = 100
    bags: int = 1
    depth: int = 5
    rate: float = 0.05
    loss: str = "squared"
    least_rows: int = 20
    l1: float = 0.0
    l2: float = 0.0
    row_share: float = 0.8
    bootstrap: bool = False
    column_share: float = 0.8
    seed: int = 42
    least_split: int = 2
    leaves: int | None = None

    @property
    def first(self) -> int:
        """Boosting starts with a tree of one leaf, round 0, that is not shrunk."""
        return 0 if self.rounds > 1 else 1


FAMILIES = {
    "gbt_squared": Growth(),
    "gbt_absolute": Growth(loss="absolute"),
    "random_forest": Growth(rounds=1, bags=100, depth=8, rate=1.0, least_rows=2, bootstrap=True, column_share=0.5),
}


class Tree:
    """A tree in heap order: the children of node i are 2i + 1 and 2i + 2; ``column`` is -1 in leaves, a row goes left up to ``border``."""

    def __init__(self, depth: int):
        size = 2 ** (depth + 1) - 1
        self.column, self.border, self.value = np.full(size, -1, np.int16), np.zeros(size, np.uint8), np.zeros(size)

    def descend(self, bins: np.ndarray, place: np.ndarray) -> np.ndarray:
        """One level down from ``place``; rows in leaves stay. ``bins`` has a line per predictor."""
        column = self.column[place]
        left = bins[np.maximum(column, 0), np.arange(len(place))] <= self.border[place]
        return np.where(column < 0, place, 2 * place + np.where(left, 1, 2))

    def leaves(self, bins: np.ndarray, depth: int) -> np.ndarray:
        place = np.zeros(bins.shape[1], np.int64)
        for _ in range(depth):
            place = self.descend(bins, place)
        return place


def row_weights(row: np.ndarray, growth: Growth, bag: int, turn: int) -> np.ndarray:
    """How often each row serves the tree, from its hash: zero or one, or drawn from Poisson(1) for a bootstrap."""
    if turn == 0:
        return np.ones(len(row))
    with np.errstate(over="ignore"):
        x = row.astype(np.uint64) + np.uint64((growth.seed * 1_000_003 + bag * 4099 + turn) % 2**32) * np.uint64(0x9E3779B97F4A7C15)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    u = (x ^ (x >> np.uint64(31))) / 2.0**64
    if growth.bootstrap:
        steps = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(10)])
        return np.searchsorted(steps, u).astype(float)
    return (u < growth.row_share).astype(float)


def columns_of(growth: Growth, bag: int, turn: int, n: int) -> np.ndarray:
    size = max(1, math.ceil(growth.column_share * n))
    return np.sort(np.random.default_rng([growth.seed, bag, turn]).choice(n, size, replace=False))


def gradients(y: np.ndarray, margin: np.ndarray, growth: Growth) -> np.ndarray:
    rest = y - margin
    return np.rint((np.sign(rest) if growth.loss == "absolute" else rest) * SCALE)


@dataclass(frozen=True)
class Bundle:
    """Predictors with few combinations of bins: ``code`` tells each row's combination, ``bins`` has a line per combination and a column per member."""

    members: tuple[int, ...]
    code: np.ndarray
    bins: np.ndarray

    @cached_property
    def by_bin(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Per member the combinations by bin, the first of each bin, and the bins."""
        out = []
        for line in self.bins.T:
            order = np.argsort(line, kind="stable")
            value, first = np.unique(line[order], return_index=True)
            out.append((order, first, value))
        return out

    def joined(self, column: int, bins: np.ndarray) -> Bundle | None:
        """With one more predictor; None if there are too many combinations."""
        pairs = self.code.astype(np.intp) * BINS + bins
        met = np.flatnonzero(np.bincount(pairs, minlength=len(self.bins) * BINS))
        if len(met) > COMBINATIONS:
            return None
        place = np.zeros(len(self.bins) * BINS, np.uint16)
        place[met] = np.arange(len(met))
        return Bundle((*self.members, column), place[pairs], np.column_stack([self.bins[met // BINS], met % BINS]))


def bundles(bins: np.ndarray) -> list[Bundle]:
    """Every predictor in one bundle: that whose combinations it multiplies least, judged by some rows and checked on all of them.

    None if the rows are too few for sums by combination to be worth while.
    """
    found: list[Bundle] = []
    if bins.shape[1] < 4 * COMBINATIONS:
        return found
    some = slice(None, None, max(1, bins.shape[1] // LOOKED_AT))
    codes, kinds = [], []
    for c, line in enumerate(bins):
        pairs = [code * BINS + line[some] for code in codes]
        seen = [np.count_nonzero(np.bincount(x)) / n for x, n in zip(pairs, kinds)]
        for k in np.argsort(seen, kind="stable").tolist():
            if (wider := found[k].joined(c, line)) is not None:
                found[k] = wider
                break
        else:
            k = len(found)
            found.append(Bundle((), np.zeros(bins.shape[1], np.uint16), np.zeros((1, 0), np.intp)).joined(c, line))
            codes, kinds = [*codes, None], [*kinds, 0]
        codes[k] = found[k].code[some].astype(np.intp)
        kinds[k] = np.count_nonzero(np.bincount(codes[k]))
    return found


class Bundled:
    """Bins of some ``rows`` as a line per predictor, like the array ``bins``, with bundles of predictors for ``level_sums``."""

    def __init__(self, bins: np.ndarray, rows: np.ndarray, found: list[Bundle]):
        self.bins, self.rows, self.found, self.shape = bins, rows, found, (len(bins), len(rows))

    def __getitem__(self, key):
        """``[c]``: bins of a predictor; ``[:, rows]``: fewer rows."""
        if isinstance(key, tuple):
            return Bundled(self.bins, self.rows[key[1]], self.found)
        return self.bins[key][self.rows]

    def together(self, columns: Sequence[int], nodes: int) -> list[tuple[Bundle, list[tuple[int, int]]]]:
        """Bundles worth their combinations, with the places of their members among ``columns`` and in the bundle."""
        at = {int(c): i for i, c in enumerate(columns)}
        out = []
        for b in self.found:
            met = [(at[c], k) for k, c in enumerate(b.members) if c in at]
            if len(self.rows) + len(met) * (len(b.bins) * nodes + COMBINATIONS) < len(met) * len(self.rows):
                out.append((b, met))
        return out


def level_sums(bins, columns, node, nodes: int, weight, pull) -> np.ndarray:
    """Weights and weighted gradients per (node, predictor, bin), the two in the first axis."""
    out = np.zeros((2, nodes, len(columns), BINS))
    start, weight, left = node * BINS, None if (weight == 1).all() else weight, dict(enumerate(columns))
    for bundle, met in bins.together(columns, nodes) if isinstance(bins, Bundled) else ():
        size, cell = len(bundle.bins), bundle.code[bins.rows] * np.intp(nodes) + node
        sums = [np.bincount(cell, x, size * nodes).reshape(size, nodes) for x in (weight, pull)]
        for i, k in met:
            del left[i]
            order, first, value = bundle.by_bin[k]
            for total, part in zip(out, sums):
                total[:, i, value] = np.add.reduceat(part[order], first, axis=0).T
    for i, c in left.items():
        cell = start + bins[c]
        out[0, :, i] = np.bincount(cell, weight, nodes * BINS).reshape(nodes, BINS)
        out[1, :, i] = np.bincount(cell, pull, nodes * BINS).reshape(nodes, BINS)
    return out


def child_sums(bins, columns, node, above: np.ndarray, split: np.ndarray, weight, pull) -> np.ndarray:
    """``level_sums`` of the children of ``split`` nodes: the child of fewer rows is summed up, the other one is the rest of the sums ``above``.

    All sums are whole numbers, so the rest is exact.
    """
    parents, out = len(split), np.zeros((2, 2 * len(split), *above.shape[2:]))
    few = 2 * np.arange(parents) + np.bincount(node, minlength=2 * parents).reshape(-1, 2).argmin(1)
    at = np.flatnonzero(node == few[node >> 1])
    part = level_sums(bins[:, at], columns, node[at] >> 1, parents, weight[at], pull[at])
    out[:, few] = part
    out[:, few ^ 1] = np.where(split[:, None, None], above - part, 0.0)
    return out


def best_gains(sums: np.ndarray, growth: Growth) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per node the place of the best predictor (-1 where no split gains), its border and its gain; ties go to the first."""
    w, g = np.cumsum(sums[0], 2), np.cumsum(sums[1], 2)
    all_w, all_g = w[:, :1, -1:], g[:, :1, -1:]

    def score(g, w):
        return np.maximum(np.abs(g) - growth.l1 * SCALE, 0.0) ** 2 / np.maximum(w + growth.l2, 1e-9)

    fair = (w >= growth.least_rows) & (all_w - w >= growth.least_rows) & (all_w >= growth.least_split)
    whole = score(all_g, all_w)
    gain = np.where(fair, score(g, w) + score(all_g - g, all_w - w) - whole, -np.inf).reshape(len(w), -1)
    at = gain.argmax(1)
    best = gain[np.arange(len(at)), at]
    return np.where(best > 1e-9 * np.maximum(whole[:, 0, 0], 1.0), at // BINS, -1), at % BINS, best


def best_splits(sums: np.ndarray, growth: Growth) -> tuple[np.ndarray, np.ndarray]:
    """Place of the predictor and border of ``best_gains``."""
    return best_gains(sums, growth)[:2]


def keep_best_leaves(tree: Tree, gain: np.ndarray, leaves: int) -> None:
    """Takes back the splits that growing at the leaf of the greatest ``gain`` would not have made before there are ``leaves`` leaves.

    Splits further down only use up more of that number, so what is taken back on one level stays back on the next.
    """
    kept, open_ = np.zeros(len(gain), bool), [(-gain[0], 0)] if tree.column[0] >= 0 else []
    for _ in range(leaves - 1):
        if not open_:
            break
        node = heappop(open_)[1]
        kept[node] = True
        for child in (2 * node + 1, 2 * node + 2):
            if child < len(gain) and tree.column[child] >= 0:
                heappush(open_, (-gain[child], child))
    tree.column[~kept], tree.border[~kept] = -1, 0


def node_places(ids: np.ndarray, size: int) -> np.ndarray:
    """Place of each node of a tree in ``ids``, -1 for the others."""
    out = np.full(size, -1, np.int64)
    out[ids] = np.arange(len(ids))
    return out


def children_of_splits(tree: Tree, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the split nodes among ``ids``, and the children of these nodes."""
    split = np.flatnonzero(tree.column[ids] >= 0)
    return split, (2 * ids[split][:, None] + [1, 2]).ravel()


def grid(rest: np.ndarray) -> np.ndarray:
    """Residuals as whole steps of a logarithmic grid."""
    return np.rint(np.sign(rest) * np.log1p(np.abs(rest)) * STEPS).astype(np.int64)


def leaf_keys(y, margin, growth: Growth) -> np.ndarray:
    """What is counted in leaves: grid steps for medians, else nothing."""
    return grid(y - margin) if growth.loss == "absolute" else np.zeros(len(y), np.int64)


def leaf_values(place, key, w, g, growth: Growth, size: int) -> np.ndarray:
    """Values of all leaves from sums (``w``, ``g``) per (``place``, ``key``)."""
    value = np.zeros(size)
    if growth.loss != "absolute":
        total = np.bincount(place, w, size)
        pull = np.bincount(place, g, size)
        shrunk = np.sign(pull) * np.maximum(np.abs(pull) - growth.l1 * SCALE, 0.0) / SCALE
        return np.where(total > 0, shrunk / np.maximum(total + growth.l2, 1e-9), 0.0)
    least, kinds = (int(key.min()), int(np.ptp(key)) + 1) if len(key) else (0, 1)
    if size * kinds <= min(CELLS, 8 * len(key)):
        # Few keys for so many rows, which are counted per leaf and key instead of being sorted.
        cells = np.bincount(place * kinds + (key - least), w, size * kinds)
        met = np.flatnonzero(cells)
        place, key, w = met // kinds, met % kinds + least, cells[met]
    else:
        order = np.lexsort((key, place))
        place, key, w = place[order], key[order], w[order]
    for leaf in np.unique(place):
        lo, hi = np.searchsorted(place, [leaf, leaf + 1])
        run = np.cumsum(w[lo:hi])
        k = key[lo + np.searchsorted(run, run[-1] / 2)] / STEPS
        middle = np.sign(k) * np.expm1(np.abs(k)) if run[-1] else 0.0
        shrunk = np.sign(middle) * max(abs(middle) - growth.l1 / max(run[-1], 1.0), 0.0)
        value[leaf] = shrunk * run[-1] / max(run[-1] + growth.l2, 1e-9)
    return value


def grow(bins: np.ndarray, row: np.ndarray, y: np.ndarray, growth: Growth) -> Iterator[tuple[int, int, Tree]]:
    """All trees (bag, round, tree) of one model whose rows are at hand."""
    found, by_row = bundles(bins) if growth.depth else [], np.ascontiguousarray(bins.T)
    for bag in range(growth.bags):
        margin = np.zeros(len(y))
        for turn in range(growth.first, growth.rounds + 1):
            depth = growth.depth if turn else 0
            tree, weight = Tree(depth), row_weights(row, growth, bag, turn)
            pull, used = gradients(y, margin, growth), np.flatnonzero(weight)
            columns = columns_of(growth, bag, turn, len(bins))
            b, w, p = Bundled(bins, used, found), weight[used], (weight * pull)[used]
            # Rows that follow the tree: those that serve it, and where another tree builds on it all of them.
            boosted = growth.rounds > growth.first
            going = by_row if boosted else by_row[used]
            mine = used if boosted else slice(None)
            at, ids, sums, gain = np.zeros(len(going), np.int64), np.zeros(1, np.int64), None, np.zeros(len(tree.value))
            for level in range(depth):
                if level:
                    above, (split, ids) = sums, children_of_splits(tree, ids)
                    if not len(ids):
                        break
                node = node_places(ids, len(tree.value))[at[mine]]
                live = node >= 0
                met = slice(None) if live.all() else live
                part, node, wm, pm = b[:, met], node[met], w[met], p[met]
                if len(ids) > FEW_NODES + len(node) // ROWS_OF_NODE:
                    sums, found_splits = None, gains_of_few_rows(part, columns, node, len(ids), wm, pm, growth)
                else:
                    if level and above is not None:
                        sums = child_sums(part, columns, node, above[:, split], np.ones(len(split), bool), wm, pm)
                    else:
                        sums = level_sums(part, columns, node, len(ids), wm, pm)
                    found_splits = best_gains(sums, growth)
                set_splits(tree, ids, columns, *found_splits[:2])
                if growth.leaves:
                    gain[ids] = found_splits[2]
                    keep_best_leaves(tree, gain, growth.leaves)
                at = tree.descend(going.T, at)
            if growth.leaves:
                at = tree.leaves(going.T, depth)
            tree.value[:] = leaf_values(at[mine], leaf_keys(y[used], margin[used], growth), w, p, growth, len(tree.value))
            if boosted:
                margin += (growth.rate if turn else 1.0) * tree.value[at]
            yield bag, turn, tree


def gains_of_few_rows(bins, columns, node, nodes: int, weight, pull, growth: Growth) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``best_gains`` of many nodes with few rows each: only the bins that rows of a node are in are met, one predictor after the other.

    A border at an empty bin parts the rows like the one before it, which is taken there too, and all sums are whole numbers, so splits are the same.
    """
    at, border, gain = np.full(nodes, -1), np.zeros(nodes, np.int64), np.full(nodes, -np.inf)
    wide = np.bincount(node, weight, nodes) >= max(growth.least_split, 2 * growth.least_rows)
    rows = np.flatnonzero(wide[node])
    node, weight, pull, bins = node[rows], weight[rows], pull[rows], bins[:, rows]
    all_w, all_g = np.bincount(node, weight, nodes), np.bincount(node, pull, nodes)

    def score(g, w):
        return np.maximum(np.abs(g) - growth.l1 * SCALE, 0.0) ** 2 / np.maximum(w + growth.l2, 1e-9)

    whole, start = score(all_g, all_w), node * BINS
    for i, c in enumerate(columns if len(rows) else ()):
        cell = start + bins[c]
        w, g = np.bincount(cell, weight, nodes * BINS), np.bincount(cell, pull, nodes * BINS)
        met = np.flatnonzero(w)
        of, w, g = met // BINS, np.cumsum(w[met]), np.cumsum(g[met])
        first = np.flatnonzero(np.diff(of, prepend=-1))
        runs = np.diff(first, append=len(of))
        w, g = (x - np.repeat(np.where(first > 0, x[first - 1], 0.0), runs) for x in (w, g))
        rest_w, rest_g = all_w[of] - w, all_g[of] - g
        fair = (w >= growth.least_rows) & (rest_w >= growth.least_rows)
        found = np.where(fair, score(g, w) + score(rest_g, rest_w) - whole[of], -np.inf)
        best = np.maximum.reduceat(found, first)
        top = np.flatnonzero(found == np.repeat(best, runs))
        top = top[np.diff(of[top], prepend=-1) != 0]
        better = best > gain[of[first]]
        mine = of[first][better]
        at[mine], border[mine], gain[mine] = i, met[top][better] % BINS, best[better]
    return np.where(gain > 1e-9 * np.maximum(whole, 1.0), at, -1), border, gain


def set_splits(tree: Tree, nodes: np.ndarray, columns: np.ndarray, at: np.ndarray, border: np.ndarray) -> None:
    split = at >= 0
    tree.column[nodes[split]] = columns[at[split]]
    tree.border[nodes[split]] = border[split]


def start_values(first: DataFrame, rows: DataFrame) -> DataFrame:
    """Leaf of the first tree of each boosted model beside its number of training rows: (``forecast_origin_date``, ``horizon``, ``n_train``, ``mean_target``)."""
    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = pa.array([float(np.frombuffer(v)[0]) for v in batch.column("value").to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("origin"), batch.column("horizon"), value], names=["origin", "horizon", "mean_target"])

    weeks = rows.where("lag_52 IS NOT NULL").groupBy(day_of().alias("day")).agg(F.count(F.lit(1)).alias("n"))
    models = first.mapInArrow(opened, "origin int, horizon int, mean_target double")
    counted = models.join(weeks, F.expr("day <= origin - 7 * horizon")).groupBy("origin", "horizon", "mean_target").agg(F.sum("n").alias("n_train"))
    return counted.select(F.date_add(F.lit("1970-01-01").cast("date"), F.col("origin")).alias(DATE), "horizon", "n_train", "mean_target")


def day_of(column: str = DATE):
    return F.datediff(F.col(column), F.lit("1970-01-01").cast("date"))


def bin_borders(rows: DataFrame, predictors: Sequence[str], origins: Sequence[int], horizons: Sequence[int]) -> dict[int, np.ndarray]:
    """Per origin the ascending quantiles (predictor x border) of the rows whose every target was known there."""
    shares = [i / BINS for i in range(1, BINS)]
    known = F.array(*[F.when(F.col("day") <= o - 7 * max(horizons), F.lit(o)) for o in origins])
    spread = rows.select(F.explode(F.array_compact(known)).alias("origin"), *predictors)
    found = spread.groupBy("origin").agg(*[F.percentile_approx(c, shares, 2000).alias(f"q{i}") for i, c in enumerate(predictors)])
    return {r["origin"]: np.array([r[f"q{i}"] for i in range(len(predictors))], float) for r in found.collect()}


def binned(rows: DataFrame, predictors: Sequence[str], borders: dict[int, np.ndarray], last: int) -> DataFrame:
    """Rows known ``last`` days before each origin: (``origin``, ``day``, ``row``, ``bins``, ``y``), bins as one byte per predictor."""
    sent = rows.sparkSession.sparkContext.broadcast(borders)  # origins x predictors x 63 numbers

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            day = batch.column("day").to_numpy()
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(predictors))
            for origin, edges in sent.value.items():
                at = np.flatnonzero(day <= origin - last)
                if len(at):
                    codes = np.column_stack([np.searchsorted(edges[i], x[at, i], side="left") for i in range(len(predictors))]).astype(np.uint8)
                    take = pa.array(at)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(at), origin, np.int32)), batch.column("day").take(take), batch.column("row").take(take), pa.array([c.tobytes() for c in codes], pa.binary()), batch.column("y").take(take)],
                        names=["origin", "day", "row", "bins", "y"],
                    )

    x = F.array(*[F.col(c).cast("double") for c in predictors])
    return rows.select("day", "row", x.alias("x"), "y").mapInArrow(cut, "origin int, day int, row bigint, bins binary, y array<double>")


def as_matrix(column, n: int) -> np.ndarray:
    """Bins as a line per predictor."""
    return np.ascontiguousarray(np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, n).T)


def tree_row(origin: int, horizon: int, bag: int, turn: int, tree: Tree, trial: int = 0) -> tuple:
    """A tree up to its last node that a row can reach."""
    used = 2 * int(np.flatnonzero(tree.column >= 0).max(initial=-1)) + 3
    return origin, horizon, bag, turn, *(x[:used].tobytes() for x in (tree.column, tree.border, tree.value)), trial


def tree_table(rows: list[tuple]) -> pa.Table:
    types = [pa.int32()] * 4 + [pa.binary()] * 3 + [pa.int32()]
    names = ["origin", "horizon", "bag", "round", "column", "border", "value", "trial"]
    return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)


def grow_trees(rows: DataFrame, predictors: Sequence[str], origins: Sequence, growth: Growth | Sequence[Growth], horizons: Sequence[int] = tuple(range(1, HORIZON + 1)), in_task: int = IN_TASK) -> tuple[DataFrame, dict[int, np.ndarray]]:
    """Stored trees of every origin and horizon (``TREES``), and the borders of their bins by origin. ``trial`` counts the configurations of a grid.

    ``rows`` are feature rows with numeric ``predictors`` and the targets. The model of an origin and a horizon learns from the rows with a full year
    of history whose target was known at the origin, as in ``ml.training_rows``; rows without their target are left out, and a model without rows
    has no trees. Origins at which no row has all its targets known are left out. A null predictor raises.
    """
    spark, horizons, growths = rows.sparkSession, list(horizons), [growth] if isinstance(growth, Growth) else list(growth)
    root, days, n = work_dir(rows.sparkSession), [cutoff_days([o], [0])[0] for o in origins], len(predictors)
    targets = F.array(*[F.col(f"target_h{h}").cast("double") for h in horizons])
    keyed = rows.where("lag_52 IS NOT NULL").select(day_of().alias("day"), F.xxhash64(*KEYS).alias("row"), targets.alias("y"), *[F.col(c).cast("double") for c in predictors])
    counts = keyed.groupBy("day").count().collect()
    known = {o: sum(r["count"] for r in counts if r["day"] <= o - 7 * min(horizons)) for o in days}
    borders = bin_borders(keyed, predictors, days, horizons) if days else {}
    small = {o: b for o, b in borders.items() if known[o] <= in_task}
    paths = []
    if small:
        def grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            got = [batch for batch in batches if batch.num_rows]
            if not got:
                return
            group = pa.Table.from_batches(got)
            y, model = group.column("target").to_numpy(), group.column("model")
            if len(model.unique()) != 1:
                raise RuntimeError("several models met in a task")
            served, part = divmod(model[0].as_py(), parts)
            origin, horizon = latest[served // len(horizons)], horizons[served % len(horizons)]
            bins, row, mine = as_matrix(group.column("bins"), n), group.column("row").to_numpy(), range(part, len(growths), parts)
            yield from tree_table([tree_row(origin, horizon, *t, k) for k in mine for t in grow(bins, row, y, growths[k])]).to_batches()

        # The models differ in size, so each is a partition of its own, the largest ones first.
        latest, parts = sorted(small, reverse=True), math.ceil(len(growths) / TRIALS_AT_ONCE)
        models = binned(keyed, predictors, small, 7 * min(horizons)).select("*", F.posexplode("y").alias("i", "target"))
        models = models.where(F.col("target").isNotNull() & (F.col("day") <= F.col("origin") - 7 * F.get(F.array(*map(F.lit, horizons)), F.col("i"))))
        place = (F.array_position(F.array(*map(F.lit, latest)), F.col("origin")).cast("int") - 1) * len(horizons) + F.col("i")
        part = F.explode(F.array(*map(F.lit, range(parts))))
        models = models.select(place.alias("place"), "row", "bins", "target", part.alias("part")).select((F.col("place") * parts + F.col("part")).alias("model"), "row", "bins", "target")
        paths.append(f"{root}/small")
        models.repartitionById(len(latest) * len(horizons) * parts, "model").mapInArrow(grown, TREES).write.parquet(paths[-1])
    for o in sorted(set(borders) - set(small)):
        path = f"{root}/{o}"
        binned(keyed, predictors, {o: borders[o]}, 7 * min(horizons)).write.parquet(f"{path}/rows")
        for k, one in enumerate(growths):
            trees = [(*t, k) for t in grow_by_level(spark.read.parquet(f"{path}/rows"), o, n, horizons, one, f"{path}/margins/{k}")]
            paths.append(f"{path}/trees/{k}")
            spark.createDataFrame(tree_table(trees).to_pandas(), TREES).write.parquet(paths[-1])
    return (spark.read.schema(TREES).parquet(*paths) if paths else spark.createDataFrame([], TREES)), borders


def grow_by_level(rows: DataFrame, origin: int, n: int, horizons: Sequence[int], growth: Growth, root: str) -> list[tuple]:
    """The trees of one origin, all horizons and bags together, from one aggregate per level and one per set of leaves.

    Boosting keeps what the trees so far give each row in a table that is written anew every round. The driver holds trees only.
    """
    learned = [F.count(F.when((F.col("day") <= origin - 7 * h) & F.get("y", F.lit(i)).isNotNull(), 1)) for i, h in enumerate(horizons)]
    units = [(i, h, bag) for (i, h), k in zip(enumerate(horizons), rows.agg(*learned).first()) if k for bag in range(growth.bags)]
    spark, out = rows.sparkSession, []
    if not units:
        return out
    names = rows.columns
    state = rows.withColumn("margin", F.array_repeat(F.lit(0.0), len(units)))

    def prepared(batch, unit: int, turn: int):
        """Rows of a batch that serve a unit's tree: bins, weights, targets, margins."""
        i, h, bag = units[unit]
        y = batch.column("y").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)[:, i]
        weight = row_weights(batch.column("row").to_numpy(), growth, bag, turn)
        at = np.flatnonzero(~np.isnan(y) & (batch.column("day").to_numpy() <= origin - 7 * h) & (weight > 0))
        margin = batch.column("margin").flatten().to_numpy().reshape(batch.num_rows, -1)[:, unit]
        return at, weight[at], y[at], margin[at]

    for turn in range(growth.first, growth.rounds + 1):
        depth = growth.depth if turn else 0
        trees = [Tree(depth) for _ in units]
        columns = [columns_of(growth, bag, turn, n) for _, _, bag in units]
        ids, gains, most = [np.zeros(1, np.int64)] * len(units), [np.zeros(len(t.value)) for t in trees], max(1, CELLS // (len(columns[0]) * BINS))
        for level in range(depth):
            if level:
                ids = [children_of_splits(tree, nodes)[1] for tree, nodes in zip(trees, ids)]
            for block in node_blocks(ids, most):
                for unit, node, at, border, gain in level_splits(state, trees, columns, block, level, turn, n, growth, prepared):
                    set_splits(trees[unit], np.array([node]), columns[unit], np.array([at]), np.array([border]))
                    gains[unit][node] = gain
            if growth.leaves:
                for tree, gain in zip(trees, gains):
                    keep_best_leaves(tree, gain, growth.leaves)
        sent = spark.sparkContext.broadcast(trees)

        def leaf_sums(batches, sent=sent, turn=turn, depth=depth):
            for batch in batches:
                bins = as_matrix(batch.column("bins"), n)
                for unit, tree in enumerate(sent.value):
                    at, w, y, margin = prepared(batch, unit, turn)
                    place, key = tree.leaves(bins[:, at], depth), leaf_keys(y, margin, growth)
                    columns = [pa.array(np.full(len(at), unit, np.int32)), pa.array(place.astype(np.int32)), pa.array(key), pa.array(w), pa.array(w * gradients(y, margin, growth))]
                    yield pa.RecordBatch.from_arrays(columns, names=["unit", "place", "key", "w", "g"])

        sums = state.mapInArrow(leaf_sums, "unit int, place int, key bigint, w double, g double").groupBy("unit", "place", "key").agg(F.sum("w").alias("w"), F.sum("g").alias("g"))

        size = len(trees[0].value)

        def valued(group: pa.Table) -> pa.Table:
            place, key, w, g = (group.column(c).to_numpy() for c in ("place", "key", "w", "g"))
            value = leaf_values(place.astype(np.int64), key, w, g, growth, size)
            leaf = int(place[0])
            return pa.table([group.column("unit")[:1], pa.array([leaf], pa.int32()), pa.array([value[leaf]])], names=["unit", "place", "value"])

        for r in sums.groupBy("unit", "place").applyInArrow(valued, "unit int, place int, value double").collect():
            trees[r["unit"]].value[r["place"]] = r["value"]
        out += [tree_row(origin, h, bag, turn, trees[u])[:-1] for u, (_, h, bag) in enumerate(units)]
        if turn < growth.rounds:
            final = spark.sparkContext.broadcast(trees)

            def moved(batches, final=final, turn=turn, depth=depth):
                rate = growth.rate if turn else 1.0
                for batch in batches:
                    bins = as_matrix(batch.column("bins"), n)
                    margin = batch.column("margin").flatten().to_numpy().reshape(batch.num_rows, -1).copy()
                    for unit, tree in enumerate(final.value):
                        margin[:, unit] += rate * tree.value[tree.leaves(bins, depth)]
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, margin.size + 1, margin.shape[1], dtype=np.int32)), pa.array(margin.ravel()))
                    yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), lists], names=[*names, "margin"])

            state.mapInArrow(moved, state.schema).write.parquet(f"{root}/{turn}")
            state = spark.read.parquet(f"{root}/{turn}")
    return out


def node_blocks(ids: Sequence[np.ndarray], most: int) -> list[list[tuple[int, np.ndarray]]]:
    """Nodes of all units in blocks of at most ``most``, as (unit, nodes)."""
    blocks, room = [], 0
    for unit, nodes in enumerate(ids):
        while len(nodes):
            if not room:
                blocks, room = [*blocks, []], most
            blocks[-1].append((unit, nodes[:room]))
            nodes, room = nodes[room:], room - min(room, len(nodes))
    return blocks


def level_splits(state, trees, columns, block, level: int, turn: int, n: int, growth: Growth, prepared) -> list:
    """Best splits (unit, node, place of the predictor, border, gain) of a block of nodes of one level."""
    sent, width = state.sparkSession.sparkContext.broadcast(trees), len(columns[0])
    places = {unit: node_places(nodes, len(trees[unit].value)) for unit, nodes in block}

    def cells(batches):
        totals = {}
        for batch in batches:
            bins = as_matrix(batch.column("bins"), n)
            for unit, nodes in block:
                at, w, y, margin = prepared(batch, unit, turn)
                place = places[unit][sent.value[unit].leaves(bins[:, at], level)]
                live = place >= 0
                at, w, place = at[live], w[live], place[live]
                pull = w * gradients(y[live], margin[live], growth)
                part = level_sums(bins[:, at], columns[unit], place, len(nodes), w, pull)
                totals[unit] = totals[unit] + part if unit in totals else part
        for unit, nodes in block:
            if unit in totals:
                total = totals[unit]
                met = np.flatnonzero(total[0])
                node, rest = np.divmod(met, width * BINS)
                cols = [np.full(len(met), unit), nodes[node], rest, total[0].ravel()[met], total[1].ravel()[met]]
                kinds = [pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["unit", "node", "cell", "w", "g"])

    def chosen(group: pa.Table) -> pa.Table:
        sums = np.zeros((2, 1, width * BINS))
        for k, name in enumerate(("w", "g")):
            sums[k, 0, group.column("cell").to_numpy()] = group.column(name).to_numpy()
        at, border, gain = best_gains(sums.reshape(2, 1, width, BINS), growth)
        split = [group.column("unit")[:1], group.column("node")[:1], pa.array(at, pa.int32()), pa.array(border, pa.int32()), pa.array(gain)]
        return pa.table(split, names=["unit", "node", "at", "border", "gain"])

    sums = state.mapInArrow(cells, "unit int, node int, cell int, w double, g double").groupBy("unit", "node", "cell").agg(F.sum("w").alias("w"), F.sum("g").alias("g"))
    return [tuple(r) for r in sums.groupBy("unit", "node").applyInArrow(chosen, "unit int, node int, at int, border int, gain double").where("at >= 0").collect()]


def predict_trees(rows: DataFrame, predictors: Sequence[str], trees: DataFrame, borders: dict[int, np.ndarray], growth: Growth | Sequence[Growth], name: str, horizons: Sequence[int] = tuple(range(1, HORIZON + 1))) -> DataFrame:
    """Non-negative predictions at the origins in the long prediction layout, with ``trial_id`` for the configurations of a grid.

    The rows of an origin are dealt into parts of about ``ROWS_AT_ONCE``; each part meets the trees of one model in a task.
    """
    n, horizons, growths = len(predictors), list(horizons), [growth] if isinstance(growth, Growth) else list(growth)
    at = rows.withColumn("origin", day_of()).where(F.col("origin").isin(list(borders)))
    sizes = at.groupBy("origin").count().collect()
    parts = max([1, *[math.ceil(r["count"] / ROWS_AT_ONCE) for r in sizes]])
    x = F.array(*[F.col(c).cast("double") for c in predictors])
    targets = F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"target_h{h}").cast("double").alias("actual")) for h in horizons])
    part = F.pmod(F.xxhash64(*KEYS), F.lit(parts)).cast("int").alias("part")
    asked = at.select("SKU", "origin", part, x.alias("x"), F.explode(targets).alias("t")).select("SKU", "origin", "part", "x", "t.*")
    asked = asked.withColumn("trial", F.explode(F.array(*map(F.lit, range(len(growths))))))
    models = trees.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    sent = rows.sparkSession.sparkContext.broadcast(borders)

    def served(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return left.select(kept).slice(0, 0).append_column("raw", pa.array([], pa.float64()))
        edges, growth = sent.value[left.column("origin")[0].as_py()], growths[left.column("trial")[0].as_py()]
        values = left.column("x").combine_chunks().flatten().to_numpy().reshape(-1, n)
        bins = np.stack([np.searchsorted(edges[i], values[:, i], side="left") for i in range(n)]).astype(np.uint8)
        right, total = right.sort_by([("bag", "ascending"), ("round", "ascending")]), np.zeros(left.num_rows)
        for r in right.select(["round", "column", "border", "value"]).to_pylist():
            depth = growth.depth if r["round"] else 0
            tree = Tree(depth)
            tree.column, tree.border, tree.value = (np.frombuffer(r[c], k) for c, k in (("column", np.int16), ("border", np.uint8), ("value", np.float64)))
            total += (growth.rate if r["round"] else 1.0) * tree.value[tree.leaves(bins, depth)]
        return left.select(kept).append_column("raw", pa.array(total / growth.bags))

    keys, kept = ["origin", "horizon", "part", "trial"], ["SKU", "origin", "horizon", "actual", "trial"]
    sku = rows.schema["SKU"].dataType.simpleString()
    got = asked.groupBy(*keys).cogroup(models.groupBy(*keys)).applyInArrow(served, f"SKU {sku}, origin int, horizon int, actual double, trial int, raw double")
    date = F.date_add(F.lit("1970-01-01").cast("date"), F.col("origin"))
    return got.select(F.lit(name).alias("model"), "SKU", date.alias(DATE), "horizon", F.date_add(date, 7 * F.col("horizon")).alias("target_date"), "actual", F.greatest(F.lit(0.0), F.col("raw")).alias("prediction"), F.col("trial").alias("trial_id"))
