"""Importance resampling towards a target: hashed n-gram frequencies of two tables, gains per bucket and a Gumbel draw."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.ordered import row_numbers
from ..sources.checkpoints import work_dir
from .arrays import slices, text_arrays
from .components import stored

# Fixed value: what lies between words once A-Z are lower case.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SLICE_BYTES = 4 << 20


def crc_remainders(words: list[bytes], grams: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of each n-gram, given as a row of word numbers: crc32 of the words joined by one space."""
    first = [zlib.crc32(w) for w in words]
    if grams.shape[1] == 1:
        sums = [first[i] for i in grams[:, 0].tolist()]
    else:
        spaced = [b" " + w for w in words]
        sums = []
        for row in grams.tolist():
            c = first[row[0]]
            for i in row[1:]:
                c = zlib.crc32(spaced[i], c)
            sums.append(c)
    return np.array(sums, np.int64) % buckets


def text_features(column: pa.Array, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and bucket of every run of 1 to ``longest`` words, row after row within a length; and the words of each row."""
    # Built anew from its bytes: kernels for text misread columns that are slices of longer ones.
    data, bounds = text_arrays(column)
    lowered = pc.ascii_lower(pa.Array.from_buffers(pa.large_string(), len(column), [None, pa.py_buffer(bounds), pa.py_buffer(data)]))
    parts = pc.split_pattern_regex(lowered, BETWEEN)
    flat, row = pc.list_flatten(parts), pc.list_parent_indices(parts)
    full = pc.not_equal(flat, "")
    coded = pc.filter(flat, full).dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    words = [w.encode() for w in coded.dictionary.to_pylist()]
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    row = pc.filter(row, full).to_numpy(zero_copy_only=False).astype(np.int64)
    rows, found = [row], [crc_remainders(words, np.arange(len(words))[:, None], buckets)[code]]
    gram, tail = code, np.arange(len(words))[:, None]  # number of the gram from each place; the words of each number
    for n in range(2, longest + 1):
        size = max(len(words), 1)
        both = gram[: max(len(gram) - 1, 0)] * size + code[n - 1 :]
        inside = row[: len(both)] == row[n - 1 :]
        # A gram that crosses a border keeps its place as a number of its own, so longer ones can be shifted too.
        distinct, gram = np.unique(np.where(inside, both, -1), return_inverse=True)
        known = distinct >= 0
        left = np.where(known, distinct // size, 0)
        tail = np.column_stack((tail[left], np.where(known, distinct % size, 0))) if len(tail) else np.zeros((len(distinct), n), np.int64)
        bucket = np.zeros(len(distinct), np.int64)
        bucket[known] = crc_remainders(words, tail[known], buckets)
        rows.append(row[: len(both)][inside])
        found.append(bucket[gram[inside]])
    return np.concatenate(rows), np.concatenate(found), np.bincount(row, minlength=len(column))


def bucket_counts(texts: DataFrame, text: str, longest: int, buckets: int) -> np.ndarray:
    """How many features of all texts fall into each bucket; every task sends one row per bucket that it met."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for part in slices(batches, text, SLICE_BYTES):
            total += np.bincount(text_features(part.column(text), longest, buckets)[1], minlength=buckets)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], names=["bucket", "n"])

    sums = texts.select(text).mapInArrow(count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[sums["bucket"].to_numpy()] = sums["n"].to_numpy()
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandfold log ratio of target to source frequency of each bucket, smoothed by one, rounded down."""
    n = len(source)
    t, s = target.astype(np.float64) + 1, source.astype(np.float64) + 1
    return np.floor(1000 * np.log(t * float(source.sum() + n) / (s * float(target.sum() + n)))).astype(np.int64)


def gumbel(key: Column, seed: int) -> Column:
    """Thousandfold Gumbel noise, rounded down, from the first 32 bits of a digest of seed and key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def resample_items(
    records: DataFrame, target: DataFrame, key: str = "SKU", text: str = "Product_Name", target_text: str = "Product_Name", longest: int = 2,
    buckets: int = 10_000, percent: int = 25, least_words: int = 20, seed: int = 7,
) -> DataFrame:
    """Draw items whose names look like ``target``: (key, ``n_features``, ``weight``, ``score``, ``rank``), one row per input row.

    A feature is a run of 1 to ``longest`` words (A-Z taken as a-z), repeats counted, and falls into the bucket crc32 modulo
    ``buckets``. The gain of a bucket is the log ratio of its smoothed frequencies in all target and all item texts; ``weight``
    is the mean gain of an item's features and ``score`` adds Gumbel noise that depends on ``seed`` and key alone, so the draw
    is one without replacement. Of the items with at least ``least_words`` words, the ``percent`` with the highest scores are
    ranked from 1; equal scores go to the smaller key.

    All texts of both tables are read whole, twice for the items; only ``buckets`` counts reach the driver and go back to the
    tasks. The order is cut into ranges, so no task holds all scores. A null or empty text has no features and weight 0. A null key draws the noise of
    an empty one and comes last among equals; repeated rows are drawn each for itself, with neighbouring ranks. An empty
    target or item table counts no features (all gains follow from smoothing alone), an empty item table gives no rows. Other
    columns are dropped.
    """
    spark = records.sparkSession
    gains = bucket_gains(bucket_counts(records, text, longest, buckets), bucket_counts(target, target_text, longest, buckets))
    sent = spark.sparkContext.broadcast(gains)
    items = records.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = items.drop("text").schema.add("n_words", "long").add("n_features", "long").add("weight", "long")

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SLICE_BYTES):
            row, bucket, n_words = text_features(part.column("text"), longest, buckets)
            order = np.argsort(row, kind="stable")
            n = np.bincount(row, minlength=part.num_rows)
            gained = np.append(sent.value[bucket[order]], 0)
            total = np.add.reduceat(gained, np.minimum(np.cumsum(n) - n, len(order)))
            weight = np.where(n > 0, total // np.maximum(n, 1), 0)
            yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(n_words.astype(np.int64)), pa.array(n.astype(np.int64)), pa.array(weight)], names=schema.names)

    weighed = items.mapInArrow(weigh, schema).withColumn("score", F.col("weight") + gumbel(F.col("key"), seed))
    weighed = stored(weighed, work_dir(spark), "weighed")
    able = weighed.where(F.col("n_words") >= least_words)
    drawn = able.count() * percent // 100
    able = able.withColumns({"_last": F.col("key").isNull(), "_score": -F.col("score")})
    ranked = row_numbers(able, ["_score", "_last", "key", "n_features", "weight"], "rank")
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    others = weighed.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    shown = [F.col("key").alias(key), "n_features", "weight", "score", "rank"]
    return ranked.select(shown).union(others.select(shown))
