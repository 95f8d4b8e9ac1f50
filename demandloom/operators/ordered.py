"""Global order statistics without a single-partition window.

``Window.orderBy`` without ``partitionBy`` moves every row into one task. The operators here cut the
order into ranges first: a uniform sample (smallest hashes, so it is deterministic) gives the range
borders, each range is scanned by its own task, and one small row per range carries the totals forward.
Rows must be unique on the ordering columns, so a value shared by very many rows is counted first and
never fills a range on its own. The counted input is checkpointed, because it is read several times. The number of ranges
follows from the number of counted rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..sources.checkpoints import cut_lineage

LEAST_RANGES = 4
ROWS_PER_RANGE = 1_000_000
SAMPLES_PER_RANGE = 32

_SCANS = {"sum": F.sum, "max": F.max, "min": F.min}


def _order_key(order: Sequence[str]) -> Column:
    return F.struct(*[F.col(c) for c in order])


def assign_ranges(df: DataFrame, order: Sequence[str], ranges: int = LEAST_RANGES) -> DataFrame:
    """Add ``_range``: an order-preserving bucket number in ``[0, ranges)``."""
    sample = (
        df.select(*order)
        .orderBy(F.xxhash64(*order), *order)
        .limit(ranges * SAMPLES_PER_RANGE)
        .agg(F.sort_array(F.collect_list(_order_key(order))).alias("s"))
    )
    step = F.greatest(F.lit(1), F.ceil(F.size("s") / F.lit(ranges)).cast("int"))
    borders = sample.select(F.filter("s", lambda _, i: (i > 0) & (i % step == 0)).alias("b")).scalar()
    steps = ", ".join(str(2**i) for i in reversed(range(ranges.bit_length())))
    # Binary search: the number of borders at or below the row's key.
    search = f"aggregate(array({steps}), 0, (p, s) -> IF(coalesce(get(_borders, p + s - 1) <= _key, false), p + s, p))"
    return (
        df.withColumns({"_borders": borders, "_key": _order_key(order)})
        .withColumn("_range", F.expr(search))
        .drop("_borders", "_key")
    )


def prefix_scan(
    df: DataFrame,
    order: Sequence[str],
    measures: Mapping[str, tuple[str, str]],
    ranges: int = LEAST_RANGES,
    materialised: bool = False,
) -> DataFrame:
    """Inclusive running aggregates along a global ascending order.

    ``measures`` maps an output name to ``(function, column)`` with function ``sum``, ``max`` or ``min``.
    """
    if not materialised:
        df = cut_lineage(df)
    ranged = assign_ranges(df, order, max(ranges, df.count() // ROWS_PER_RANGE))
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    inside = W.partitionBy("_range").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    totals = ranged.groupBy("_range").agg(
        *[_SCANS[fn](col).alias(f"_t_{out}") for out, (fn, col) in measures.items()]
    )
    # One total per range, a millionth of the counted rows, reaches this window.
    carried = totals.select(
        "_range",
        *[_SCANS[fn](f"_t_{out}").over(before).alias(f"_c_{out}") for out, (fn, _) in measures.items()],
    )
    joined = ranged.join(F.broadcast(carried), "_range")
    for out, (fn, col) in measures.items():
        local, carry = _SCANS[fn](col).over(inside), F.col(f"_c_{out}")
        if fn == "sum":
            value = local + F.coalesce(carry, F.lit(0))
        else:
            value = (F.greatest if fn == "max" else F.least)(local, carry)
        joined = joined.withColumn(out, value)
    return joined.drop("_range", *[f"_c_{out}" for out in measures])


def segment_scan(df: DataFrame, by: Sequence[str], order: Sequence[str], weight: str, ranges: int = LEAST_RANGES) -> DataFrame:
    """Add ``_upto``, the running sum of ``weight`` along ``order`` inside each group of ``by``, and ``_size``, the group's total.

    ``df`` is checkpointed and unique on ``by`` and ``order``. The order by group and value is cut into ranges, so a group of any size is the
    work of many tasks and many small groups are the work of one. Only the first and the last group of a range can go on in
    another one; their totals, two rows per range, are all that is handed over. NULL is a group of its own.
    """
    by = list(by)
    ranged = assign_ranges(df, [*by, *order], max(ranges, df.count() // ROWS_PER_RANGE))
    # Groups inside a range are read where the range is: no exchange by group.
    part = W.partitionBy("_range", *by)
    local = ranged.withColumns({
        "_upto": F.sum(weight).over(part.orderBy(*order).rowsBetween(W.unboundedPreceding, 0)), "_size": F.sum(weight).over(part),
    })
    totals = ranged.groupBy("_range", *by).agg(F.sum(weight).alias("_t"))
    cell = F.struct(*by, "_t")
    # At most two rows per range from here on.
    edges = totals.groupBy("_range").agg(F.array_distinct(F.array(F.min(cell), F.max(cell))).alias("_e")).select("_range", F.inline("_e"))
    along = W.partitionBy(*by).orderBy("_range")
    carried = edges.select(
        F.col("_range").alias("_er"), *[F.col(b).alias(f"_e{i}") for i, b in enumerate(by)],
        F.coalesce(F.sum("_t").over(along.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("_t").over(W.partitionBy(*by)).alias("_all"),
    )
    same = F.col("_range") == F.col("_er")
    for i, b in enumerate(by):
        same = same & F.col(b).eqNullSafe(F.col(f"_e{i}"))
    joined = local.join(F.broadcast(carried), same, "left")
    return joined.withColumns({
        "_upto": F.col("_upto") + F.coalesce("_before", F.lit(0)), "_size": F.coalesce("_all", "_size"),
    }).drop("_range", "_er", "_before", "_all", *[f"_e{i}" for i in range(len(by))])


def row_numbers(df: DataFrame, order: Sequence[str], name: str = "row_number") -> DataFrame:
    """Global one-based position along ``order`` (unique columns, ascending)."""
    return prefix_scan(df.withColumn("_one", F.lit(1).cast("bigint")), order, {name: ("sum", "_one")}).drop("_one")


def rank_min(df: DataFrame, columns: Mapping[str, str], key: str = "SKU") -> DataFrame:
    """Descending ranks where ties share the smallest rank, one per ``columns`` entry (source to rank name).

    All columns are ranked in one scan over their distinct values; NULL values get no rank.
    """
    long = df.select(
        key, F.inline(F.array(*[F.struct(F.lit(c).alias("_m"), (-F.col(c).cast("double")).alias("_v")) for c in columns]))
    ).filter(F.col("_v").isNotNull())
    counts = cut_lineage(long.groupBy("_m", "_v").agg(F.count(F.lit(1)).alias("_n")))
    scanned = prefix_scan(counts, ["_m", "_v"], {"_upto": ("sum", "_n")}, materialised=True)
    # One row per ranked column.
    base = counts.groupBy("_m").agg(F.sum("_n").alias("_n")).select(
        "_m", F.coalesce(F.sum("_n").over(W.orderBy("_m").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_base")
    )
    ranks = scanned.join(F.broadcast(base), "_m").select("_m", "_v", (F.col("_upto") - F.col("_n") + 1 - F.col("_base")).alias("_r"))
    per_key = long.join(ranks, ["_m", "_v"]).groupBy(key).agg(
        *[F.max(F.when(F.col("_m") == c, F.col("_r"))).alias(name) for c, name in columns.items()]
    )
    return df.join(per_key, key, "left")


def quantiles(
    df: DataFrame,
    column: str,
    probabilities: Mapping[str, float],
    by: Sequence[str] = (),
    weight: str | None = None,
    counted: bool = False,
) -> DataFrame:
    """Exact linear-interpolation quantiles, overall or per group; ``weight`` holds repeat counts.

    ``counted`` says that ``df`` is already checkpointed with one row per value.

    Equal values collapse to one counted row, running counts are scanned range by range, and every
    quantile is then read with a plain aggregate, so no task holds a whole group. A NULL group has a row of its own.
    """
    by = list(by)
    value = F.col(column).cast("double")
    rows = df.select(*by, value.alias("_v"), (F.col(weight) if weight else F.lit(1)).cast("bigint").alias("_n"))
    counts = rows.filter(F.col("_v").isNotNull())
    if not counted:
        counts = cut_lineage(counts.groupBy(*by, "_v").agg(F.sum("_n").alias("_n")))
    if by:
        scanned = segment_scan(counts, by, ["_v"], "_n")
    else:
        total = counts.agg(F.sum("_n")).scalar()
        scanned = prefix_scan(counts, ["_v"], {"_upto": ("sum", "_n")}, materialised=True).withColumn("_size", total)
    position = F.col("_upto")
    picks = []
    for name, p in probabilities.items():
        spot = (F.col("_size") - 1) * F.lit(float(p))
        picks += [
            F.min(F.when(position > F.floor(spot), F.col("_v"))).alias(f"_lo_{name}"),
            F.min(F.when(position > F.ceil(spot), F.col("_v"))).alias(f"_hi_{name}"),
            F.max(spot - F.floor(spot)).alias(f"_w_{name}"),
        ]
    read = scanned.groupBy(*by).agg(*picks)
    return read.select(
        *by,
        *[
            (F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_w_{n}")).alias(n)
            for n in probabilities
        ],
    )
