"""Toxicity categories by a chain of linear models over hashed words."""

from __future__ import annotations

import pickle
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .arrays import NO_LETTER, slices, text_arrays, word_hashes

BUCKET_BITS = 18
FOLDS = 3


def word_buckets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Text number and bucket of every distinct word bucket of every text, in order."""
    data, bounds = text_arrays(column)
    hashes, row = word_hashes(data, bounds, NO_LETTER)
    pair = np.unique((row.astype(np.int64) << BUCKET_BITS) | (hashes & np.uint64((1 << BUCKET_BITS) - 1)).astype(np.int64))
    return pair >> BUCKET_BITS, pair & ((1 << BUCKET_BITS) - 1)


def sums(row: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(row, values, n)


def probability(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_linear(row: np.ndarray, bucket: np.ndarray, extra: np.ndarray, y: np.ndarray, used: np.ndarray, rounds: int = 80, l2: float = 2.0):
    """Weights of words, of the extra columns and of the constant, by full-batch gradient steps with adaptive rates.

    Classes weigh equally. ``used`` selects the texts to learn from. Words are scaled by the log ratio of their smoothed shares
    in the two classes, so words that tell nothing start with no influence.
    """
    n = len(y)
    keep = used[row] > 0
    r, b = row[keep], bucket[keep]
    pos, neg = max((y * used).sum(), 1), max(((1 - y) * used).sum(), 1)
    size = 1 << BUCKET_BITS
    scale = np.log(((np.bincount(b, y[r], size) + 1) / (pos + 2)) / ((np.bincount(b, 1 - y[r], size) + 1) / (neg + 2)))
    seen = np.bincount(b, minlength=size)
    scale[seen < 3] = 0
    weight = used * np.where(y == 1, 0.5 / pos, 0.5 / neg)
    s = scale[b]
    w, u, c = np.zeros(size), np.zeros(extra.shape[1]), 0.0
    gw, gu, gc = np.full(size, 1e-8), np.full(extra.shape[1], 1e-8), 1e-8
    for _ in range(rounds):
        z = sums(r, w[b] * s, n) + extra @ u + c
        err = weight * (probability(z) - y)
        dw = np.bincount(b, err[r] * s, size) + l2 / (pos + neg) * w * (scale != 0)
        du, dc = extra.T @ err + l2 / (pos + neg) * u, err.sum()
        gw += dw * dw
        gu += du * du
        gc += dc * dc
        w -= 0.3 * dw / np.sqrt(gw)
        u -= 0.3 * du / np.sqrt(gu)
        c -= 0.3 * dc / np.sqrt(gc)
    return w * scale, u, c


def fit_chain(row: np.ndarray, bucket: np.ndarray, y: np.ndarray, fold: np.ndarray) -> list:
    """A model per category; later ones see the earlier categories' probabilities, out of fold while learning."""
    n, k = y.shape
    extra, chain = np.zeros((n, 0)), []
    for j in range(k):
        everyone = np.ones(n)
        model = fit_linear(row, bucket, extra, y[:, j], everyone)
        chain.append(model)
        if j + 1 < k:
            held = np.zeros(n)
            for f in range(FOLDS):
                w, u, c = fit_linear(row, bucket, extra, y[:, j], (fold != f).astype(float))
                p = probability(sums(row, w[bucket], n) + extra @ u + c)
                held[fold == f] = p[fold == f]
            extra = np.column_stack((extra, held))
    return chain


def classify_toxicity(
    records: DataFrame, labels: DataFrame, categories: Sequence[str] = ("quality", "toxic"), key: str = "SKU", text: str = "Product_Name",
    labelled_rows: int = 10_000, threshold: float = 0.5,
) -> DataFrame:
    """Probability of every category for every item text, in chain order: (key, ``<category>_probability`` ..., ``<last>_predicted``).

    ``labels`` has the key and a 0/1 column per category. The chain is fitted in one task on a bounded sample, about ``labelled_rows``
    labelled rows chosen by a hash of the key; rows with a null key, a null label or a null text teach nothing. Each model is a
    logistic regression over the distinct words of a text (letters, A-Z as a-z, hashed to 2^18 buckets) and the probabilities of
    the categories before it, which are out of fold in training. The last category is predicted where its probability is at
    least ``threshold``. Without labelled rows every probability is 0. A null or empty text has no words and gets the
    constants' probability. Null keys and repeated rows are scored like any other; several labels for one key each
    count; an empty table gives no rows; other columns are dropped.
    """
    cats = list(categories)
    known = labels.select(F.col(key).alias("k"), *[F.col(c).cast("double").alias(f"y{i}") for i, c in enumerate(cats)]).na.drop()
    n = known.count()
    share = min(1 << 20, -(-labelled_rows * (1 << 20) // max(n, 1)))
    # About labelled_rows rows, whatever the size of the table: bounded, so it may be broadcast and gathered.
    sample = known.where(F.pmod(F.xxhash64("k"), F.lit(1 << 20)) < share)
    teach = records.select(F.col(key).alias("k"), F.col(text).alias("t")).where("t IS NOT NULL").join(F.broadcast(sample), "k")
    teach = teach.withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), "k"), F.lit(FOLDS)).cast("int"))

    def featured(batches):
        for batch in slices(batches, "t"):
            row, bucket = word_buckets(batch.column("t"))
            cut = np.searchsorted(row, np.arange(batch.num_rows + 1))
            words = [bucket[cut[i] : cut[i + 1]].astype("<u4").tobytes() for i in range(batch.num_rows)]
            rest = [batch.column("k"), batch.column("fold"), *[batch.column(f"y{i}") for i in range(len(cats))]]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(words, pa.binary())], names=["k", "fold", *[f"y{i}" for i in range(len(cats))], "words"])

    fields = [T.StructField("k", records.schema[key].dataType), T.StructField("fold", T.IntegerType())]
    fields += [T.StructField(f"y{i}", T.DoubleType()) for i in range(len(cats))] + [T.StructField("words", T.BinaryType())]

    def fitted(batches):
        full = [b for b in batches if b.num_rows]
        if not full:
            return
        table = pa.Table.from_batches(full)
        words = [np.frombuffer(x, "<u4").astype(np.int64) for x in table.column("words").to_pylist()]
        row = np.repeat(np.arange(len(words)), np.array([len(x) for x in words], np.int64))
        y = np.column_stack([table.column(f"y{i}").to_numpy() for i in range(len(cats))])
        chain = fit_chain(row, np.concatenate(words), y, table.column("fold").to_numpy())
        slim = []
        for w, u, c in chain:
            at = np.flatnonzero(w)
            slim.append((at.astype(np.int32), w[at].astype(np.float32), u, c))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(slim)], pa.binary())], names=["model"])

    found = teach.mapInArrow(featured, T.StructType(fields)).repartition(1).sortWithinPartitions("k", "words")
    got = found.mapInArrow(fitted, "model binary").collect()
    chain = pickle.loads(got[0]["model"]) if got else []
    sent = records.sparkSession.sparkContext.broadcast(chain)
    schema = T.StructType([T.StructField(key, records.schema[key].dataType), *[T.StructField(f"{c}_probability", T.DoubleType()) for c in cats],
                           T.StructField(f"{cats[-1]}_predicted", T.BooleanType())])

    def score(batches):
        models = []
        for at, w, u, c in sent.value:
            dense = np.zeros(1 << BUCKET_BITS)
            dense[at] = w
            models.append((dense, u, c))
        for batch in slices(batches, text):
            n = batch.num_rows
            extra = np.zeros((n, 0))
            if models:
                row, bucket = word_buckets(batch.column(text))
                for w, u, c in models:
                    extra = np.column_stack((extra, probability(sums(row, w[bucket], n) + extra @ u + c)))
            else:
                extra = np.zeros((n, len(cats)))
            columns = [pa.array(extra[:, i]) for i in range(len(cats))]
            yield pa.RecordBatch.from_arrays([batch.column(key), *columns, pa.array(extra[:, -1] >= threshold)], names=schema.names)

    return records.select(key, text).mapInArrow(score, schema)
