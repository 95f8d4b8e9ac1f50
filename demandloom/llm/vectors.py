"""Near-duplicate vectors: spherical k-means cells, blocked cosine products inside cells, one vector kept per group."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..sources.checkpoints import work_dir
from .components import connected_components, stored

BLOCK_ROWS = 512


def matrix(column: pa.Array) -> np.ndarray:
    """A list column whose rows have one length as a double-precision matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def spherical_kmeans(sample: np.ndarray, cells: int, rounds: int = 8) -> np.ndarray:
    """Unit centroids of unit rows; a cell that loses all rows keeps its centroid."""
    centroids = sample[np.linspace(0, len(sample) - 1, cells).astype(int)]
    for _ in range(rounds):
        nearest = (sample @ centroids.T).argmax(1)
        total = np.zeros_like(centroids)
        np.add.at(total, nearest, sample)
        norm = np.sqrt((total * total).sum(1, keepdims=True))
        centroids = np.where(norm > 0, total / np.maximum(norm, 1e-300), centroids)
    return centroids


def block_links(home: np.ndarray, other: np.ndarray, least: float) -> np.ndarray:
    """Which rows of two blocks have at least the cosine ``least``."""
    lengths = np.sqrt((home * home).sum(1))[:, None] * np.sqrt((other * other).sum(1))[None, :]
    return home @ other.T >= least * lengths


def similar_vectors(
    records: DataFrame, key: str = "SKU", label: str = "Category", vector: str = "features", least: float = 0.98, sample_rows: int = 20_000,
    cell_rows: int = 4096, most_cells: int = 2048,
) -> DataFrame:
    """Groups of items of one category with similar feature vectors: (key, ``n_links``, ``component_id``, ``kept``).

    Items are compared only if their labels are equal and not null; two link when the cosine in double precision is at least
    ``least``. Equal vectors are one class and never compared with each other. Spherical k-means, fitted on about ``sample_rows``
    classes, gives centroids (one per ``cell_rows`` classes, at most ``most_cells``; cells then grow and are cut into more blocks).
    Each class has the cell of its nearest centroid and is a guest in every cell where a vector that links with it may live: if v
    has home h, a partner with home c satisfies v.h - v.c <= |v - u| |c - h| and |v - u|^2 <= 2 - 2 ``least``, so no
    pair is missed and recall is 1. Cells are cut into blocks of about 512 and pairs of blocks are multiplied; each home
    row's links are counted there, and a spanning set of links goes on to the components, not all pairs.

    ``component_id`` is the smallest key reachable by links, ``kept`` marks the row that bears it. A vector that is null, empty,
    zero or holds a null or a non-finite value, a null label and a null key link with nothing (a null key is kept). Vectors of
    different length do not link. Repeated rows link like other equal vectors. Empty tables give no rows; other columns are
    dropped.
    """
    spark = records.sparkSession
    root = work_dir(spark)
    key_type, label_type = records.schema[key].dataType, records.schema[label].dataType
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    rows = records.select(F.col(key).alias("key"), F.col(label).alias("label"), v.alias("v"))
    sound = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    sound = F.col("key").isNotNull() & F.col("label").isNotNull() & F.coalesce(sound, F.lit(False))
    marks = {"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(1), "v"), "dim": F.size("v")}
    rows = rows.withColumn("sound", sound).withColumns(marks)
    classes = rows.where("sound").groupBy("label", "dim", "h1", "h2").agg(F.min("key").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("v").alias("v"))
    classes = stored(classes, root, "classes")
    sizes = {r["dim"]: r["n"] for r in classes.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
    centroids = {}
    for dim, n in sizes.items():
        cells = min(most_cells, max(1, n // cell_rows))
        if cells > 1:
            share = min(1 << 20, -(-sample_rows * (1 << 20) // n))
            drawn = classes.where((F.col("dim") == dim) & (F.pmod("h1", F.lit(1 << 20)) < share)).orderBy("h1", "h2").select("v").toArrow()
            centroids[dim] = spherical_kmeans(unit(matrix(drawn["v"])), min(cells, max(1, len(drawn))))
    sent = spark.sparkContext.broadcast(centroids)
    reach = float(np.sqrt(max(2 - 2 * least, 0))) + 1e-9

    placed_type = T.StructType([
        T.StructField("label", label_type), T.StructField("dim", T.IntegerType()), T.StructField("cell", T.IntegerType()), T.StructField("home", T.BooleanType()),
        T.StructField("rep", key_type), T.StructField("copies", T.LongType()), T.StructField("v", T.ArrayType(T.DoubleType())),
    ])

    def place(batches):
        for batch in (b.slice(i, 1024) for b in batches for i in range(0, b.num_rows, 1024)):
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                part = batch.take(pa.array(at))
                c = sent.value.get(dim)
                if c is None:
                    row, cell, home = np.arange(len(at)), np.zeros(len(at), np.int32), np.ones(len(at), bool)
                else:
                    near = unit(matrix(part.column("v"))) @ c.T
                    first = near.argmax(1)
                    apart = np.sqrt(np.maximum(2 - 2 * (c @ c.T), 0))
                    row, cell = np.nonzero(near[np.arange(len(at)), first][:, None] - near <= reach * apart[first] + 1e-9)
                    home = cell == first[row]
                take = pa.array(row)
                out = [part.column(x).take(take) for x in ("label", "dim")] + [pa.array(cell.astype(np.int32)), pa.array(home)]
                yield pa.RecordBatch.from_arrays(out + [part.column(x).take(take) for x in ("rep", "copies", "v")], names=placed_type.names)

    placed = stored(classes.mapInArrow(place, placed_type), root, "placed")
    cell = ["label", "dim", "cell"]
    blocks = placed.groupBy(*cell).agg(
        F.ceil(F.sum(F.col("home").cast("long")) / BLOCK_ROWS).cast("int").alias("homes"), F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("all")
    ).where("homes > 0")
    spot = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    sided = placed.join(blocks, cell)
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    homes = sided.where("home").select(*cell, spot("homes").alias("i"), upto("all").alias("j"), F.lit(True).alias("left"), "rep", "copies", "v")
    others = sided.select(*cell, upto("homes").alias("i"), spot("all").alias("j"), F.lit(False).alias("left"), "rep", "copies", "v")

    linked_type = T.StructType([T.StructField("a", key_type), T.StructField("b", key_type), T.StructField("n", T.LongType())])

    def multiply(block: pa.Table) -> pa.Table:
        left = block.column("left").to_numpy(zero_copy_only=False).astype(bool)
        h, o = np.flatnonzero(left), np.flatnonzero(~left)
        names, copies, x = block.column("rep").combine_chunks(), block.column("copies").to_numpy(), matrix(block.column("v"))
        codes = names.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        near = block_links(x[h], x[o], least) & (codes[h][:, None] != codes[o][None, :])
        count = near @ copies[o]
        mark_h, mark_o = codes[h].astype(np.int64), codes[o].astype(np.int64)
        big = np.int64(1 << 60)
        while near.any():
            new_h = np.minimum(mark_h, np.where(near, mark_o[None, :], big).min(1, initial=big))
            new_o = np.minimum(mark_o, np.where(near, new_h[:, None], big).min(0, initial=big))
            if (new_h == mark_h).all() and (new_o == mark_o).all():
                break
            mark_h, mark_o = new_h, new_o
        where = np.zeros(int(codes.max()) + 1, np.int64)
        where[codes] = np.arange(len(codes))
        node = np.concatenate((h[count > 0], o[near.any(0)])) if len(h) and len(o) else np.zeros(0, np.int64)
        mark = np.concatenate((mark_h[count > 0], mark_o[near.any(0)])) if len(node) else np.zeros(0, np.int64)
        n = np.concatenate((count[count > 0], np.zeros(len(node) - int((count > 0).sum()), np.int64))).astype(np.int64)
        return pa.table([names.take(pa.array(node)), names.take(pa.array(where[mark])), pa.array(n)], names=linked_type.names)

    linked = stored(homes.union(others).groupBy(*cell, "i", "j").applyInArrow(multiply, linked_type), root, "linked")
    groups = connected_components(linked.select("a", "b"))
    counts = linked.groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("near"))
    named = classes.drop("v").join(groups.withColumnRenamed("node", "rep"), "rep", "left").join(counts, "rep", "left")
    named = named.select("label", "dim", "h1", "h2", "copies", F.coalesce("near", F.lit(0)).alias("near"), F.coalesce("component", "rep").alias("group"))
    out = rows.drop("v").withColumn("label", F.when(F.col("sound"), F.col("label"))).join(named, ["label", "dim", "h1", "h2"], "left")
    component = F.coalesce("group", "key")
    return out.select(
        F.col("key").alias(key), F.coalesce(F.col("copies") - 1 + F.col("near"), F.lit(0)).alias("n_links"), component.alias("component_id"),
        F.col("key").eqNullSafe(component).alias("kept"),
    )
