"""Connected components of a table of links by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..sources.checkpoints import shuffles_let_go, work_dir


def stored(df: DataFrame, root: str, name: str) -> DataFrame:
    """``df`` written once under ``root`` and read back, so later steps do not repeat its work; what it shuffled is let go."""
    with shuffles_let_go(df.sparkSession):
        df.write.option("compression", "zstd").parquet(f"{root}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{root}/{name}")


def connected_components(links: DataFrame) -> DataFrame:
    """Smallest reachable node of every linked node: (``node``, ``component``) from links (``a``, ``b``) in any order.

    Each round joins every node's links with the node's smallest neighbour; nothing but two sums per round reaches the
    driver. Nulls and links to oneself are left out; repeated links count once; no links give no rows.
    """
    root = work_dir(links.sparkSession)
    pairs = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges, before, step = stored(pairs, root, "0"), None, 0
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 32)))).first()
        if state == before:
            break
        before, step = state, step + 1
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(small.union(least.select("u", F.col("m").alias("v"))).distinct(), root, str(step))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
