"""Product codes of vectors in exact integer arithmetic: Walsh-Hadamard transform, squared differences in sequency order."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from ..sources.checkpoints import work_dir
from .components import stored

SCALE = 256
#: Components are held to this size, so that sums over any table fit 38 decimal digits.
LIMIT = 1 << 62
LARGEST = (1 << 63) - 1
BATCH_ROWS = 1024


class VectorCodes(NamedTuple):
    """``codes``: one row per vector; ``codebooks[part][entry]``: the integer components of an entry."""

    codes: DataFrame
    codebooks: list[list[list[int]]]


def sequency_order(n: int) -> np.ndarray:
    """Rows of the natural-order Hadamard matrix of size ``n`` (a power of two), sorted by their number of sign changes."""
    bits = n.bit_length() - 1
    gray = np.arange(n) ^ (np.arange(n) >> 1)
    return np.array([int(f"{g:0{bits}b}"[::-1], 2) if bits else 0 for g in gray.tolist()], np.int64)


def walsh(x: np.ndarray) -> np.ndarray:
    """Unscaled transform of the last axis, zero-padded to a power of two, coefficients in sequency order."""
    width = 1 << max(x.shape[-1] - 1, 0).bit_length()
    out = np.zeros((*x.shape[:-1], width), x.dtype)
    out[..., : x.shape[-1]] = x
    step = 1
    while step < width:
        pairs = out.reshape(*x.shape[:-1], width // (2 * step), 2, step)
        a, b = pairs[..., 0, :], pairs[..., 1, :]
        out = np.stack((a + b, a - b), -2).reshape(out.shape)
        step *= 2
    return out[..., sequency_order(width)]


def nearest_entries(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of each part (the lowest one if equal) and its squared distance, exactly.

    The transform multiplies squared distances by its width and gathers most of them in the first coefficients. Sums grow
    coefficient by coefficient; an entry is given up once its sum exceeds the whole distance of another one.
    """
    x, e = walsh(parts), walsh(entries)
    width, n = x.shape[1], len(x)
    first = max(width // 4, 1)
    sums = np.zeros((n, len(e)), x.dtype)
    for k in range(first):
        sums += (x[:, k, None] - e[None, :, k]) ** 2
    guess = sums.argmin(1)
    limit = sums[np.arange(n), guess] + ((x[:, first:] - e[guess, first:]) ** 2).sum(1)
    row, entry = np.nonzero(sums <= limit[:, None])
    left = sums[row, entry]
    for k in range(first, width):
        left = left + (x[row, k] - e[entry, k]) ** 2
        near = left <= limit[row]
        row, entry, left = row[near], entry[near], left[near]
    least = np.full(n, LARGEST, np.int64) if x.dtype != object else np.array([None] * n, object)
    if x.dtype == object:
        for r, d in zip(row.tolist(), left.tolist()):
            least[r] = d if least[r] is None else min(least[r], d)
    else:
        np.minimum.at(least, row, left)
    best = left == least[row]
    code = np.full(n, len(e), np.int64)
    np.minimum.at(code, row[best], entry[best])
    return code, least // width


def integers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and components, times ``SCALE`` and rounded down, of a list column without nulls."""
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    x = pc.list_flatten(column).to_numpy(zero_copy_only=False).astype(np.float64)
    held = np.clip(x, -(LIMIT // SCALE), LIMIT // SCALE)
    return np.concatenate(([0], np.cumsum(sizes))), np.floor(held * SCALE).astype(np.int64)


def padded(column: pa.Array, parts: int, width: int) -> np.ndarray:
    """Rows of integers, zero-padded on the right, as (rows, parts, width)."""
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(sizes), parts * width), np.int64)
    out[np.arange(parts * width)[None, :] < sizes[:, None]] = pc.list_flatten(column).to_numpy(zero_copy_only=False)
    return out.reshape(len(sizes), parts, width)


def assign(x: np.ndarray, books: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Codes (rows, parts) and squared distances of all parts; whole numbers of any size where 64 bits could not hold them."""
    width = 1 << max(x.shape[2] - 1, 0).bit_length()
    most = max([int(np.abs(b).max(initial=0)) for b in books] + [int(np.abs(x).max(initial=0))])
    kind = np.int64 if 4 * width * width * most * most < LARGEST else object
    got = [nearest_entries(x[:, p].astype(kind), b.astype(kind)) for p, b in enumerate(books)]
    return np.column_stack([c for c, _ in got]), np.column_stack([d for _, d in got])


def encode_vectors(
    records: DataFrame, key: str = "SKU", label: str = "Category", vector: str = "features", parts: int = 16, entries: int = 64, rounds: int = 2,
) -> VectorCodes:
    """Compress feature vectors to one codebook index per part: (key, ``codes``, ``error``, ``label_error``) and the codebooks.

    A component x becomes the integer floor(256 x); vectors are cut into ``parts`` consecutive parts. The codebook of a part
    starts as that part of the ``entries`` smallest keys; ``rounds`` times every part goes to its nearest entry (the lowest one if equal) and
    each entry becomes the floored mean of its parts. All distances are exact whole numbers. ``error`` sums a
    vector's squared distances to its final entries, ``label_error`` the errors of its label (null labels count as one).

    Each round sends one row of sums per task and entry to a shuffle; codebooks (``parts`` x ``entries`` vectors) are all that
    reaches the driver and the tasks. A vector that is null or holds a null or a non-finite component is dropped. Vectors of
    different or indivisible length are read as if zeros followed, up to the longest one. Components beyond 2**54
    count as 2**54, and sums beyond a long as the largest long. Null keys come last in the order for the codebook, equal keys are ordered by their
    integers; fewer vectors than ``entries`` give a smaller codebook, none give no rows and an empty one. Repeated rows count
    each; other columns are dropped.
    """
    spark = records.sparkSession
    v = F.col("v")
    rows = records.select(F.col(key).alias("key"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.where(v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))

    def round_down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, x = integers(batch.column("v"))
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(x))
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("label"), lists], names=["key", "label", "v"])

    kept_schema = rows.drop("v").schema.add("v", T.ArrayType(T.LongType()))
    kept = stored(rows.mapInArrow(round_down, kept_schema), work_dir(spark), "integers")
    longest = kept.agg(F.max(F.size("v"))).first()[0] or 0
    width = max(-(-longest // parts), 1)
    start = kept.select("v").orderBy(F.col("key").asc_nulls_last(), "v").limit(entries).toArrow()["v"].combine_chunks()
    books = list(padded(start, parts, width).transpose(1, 0, 2)) if len(start) else []
    if not books:
        nothing = kept.select(F.col("key").alias(key), F.array().cast("array<int>").alias("codes"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"))
        return VectorCodes(nothing, [])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        for part in (b.slice(i, BATCH_ROWS) for b in batches for i in range(0, b.num_rows, BATCH_ROWS)):
            yield part, padded(part.column("v"), parts, width)

    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(books)

        def summed(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            spots = parts * entries
            count, total = np.zeros(spots, np.int64), np.zeros((spots, width), object)
            for _, x in pieces(batches):
                spot = (assign(x, sent.value)[0] + np.arange(parts) * entries).ravel()
                flat = x.reshape(-1, width)
                order = np.argsort(spot, kind="stable")
                met, at, n = np.unique(spot[order], return_index=True, return_counts=True)
                count[met] += n
                small = int(np.abs(flat).max(initial=0)) < 1 << 40  # sums of a batch then stay far from 64 bits
                total[met] += np.add.reduceat(flat[order] if small else flat[order].astype(object), at).astype(object)
            met = np.flatnonzero(count)
            sums = pa.array([s for s in total[met].ravel().tolist()], pa.decimal128(38, 0))
            columns = [np.repeat(met, width), np.tile(np.arange(width), len(met)), np.repeat(count[met], width)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), sums], names=["spot", "place", "n", "total"])

        moved = kept.select("v").mapInArrow(summed, "spot bigint, place bigint, n bigint, total decimal(38,0)")
        moved = moved.groupBy("spot", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()
        books = [b.copy() for b in books]
        for r in moved:
            books[r["spot"] // entries][r["spot"] % entries, r["place"]] = int(r["total"]) // r["n"]
    sent = spark.sparkContext.broadcast(books)
    schema = rows.drop("v").schema.add("codes", T.ArrayType(T.IntegerType())).add("error", "long")

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in pieces(batches):
            codes, apart = assign(x, sent.value)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(codes) + 1, dtype=np.int32) * parts), pa.array(codes.astype(np.int32).ravel()))
            error = pa.array([min(e, LARGEST) for e in apart.astype(object).sum(1).tolist()], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("key"), part.column("label"), lists, error], names=schema.names)

    codes = kept.mapInArrow(coded, schema)
    by_label = codes.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("total"))
    by_label = by_label.select(F.col("label").alias("of"), F.least("total", F.lit(LARGEST)).cast("long").alias("label_error"))
    out = codes.join(by_label, F.col("label").eqNullSafe(F.col("of")))
    return VectorCodes(out.select(F.col("key").alias(key), "codes", "error", "label_error"), [b.tolist() for b in books])
