"""Chat logs as training text: snapshots of a growing conversation collapse to the longest one, which is rendered."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..sources.checkpoints import work_dir
from .components import stored

HASH_SPACE = 1 << 40
START, END = "<|im_start|>", "<|im_end|>"


def format_conversations(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Maximal conversations, rendered: (conversation, ``n_turns``, ``n_copies``, ``rendered``).

    The demand records hold no conversations, so the operator is general. A logged conversation that is a proper prefix of
    another one, turn by turn, is dropped; of equal ones the smallest id stays and ``n_copies`` counts them. The rolling hash of
    a prefix is a pair of running sums of hashes of (position, role, text), so one pass in turn order gives all prefixes and
    equal prefixes meet in a join instead of being compared pair by pair. A turn is rendered as start mark, role, line feed, text,
    end mark and line feed.

    Turns with equal number are ordered by role and text, nulls first; rows repeated in full count once. A null role is rendered
    as ``unknown``, a null text as empty. Turns without an id form one conversation with a null id. An empty table gives no rows;
    other columns are dropped.
    """
    root = work_dir(turns.sparkSession)
    rows = turns.select(F.col(conversation).alias("id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text")).distinct()
    order = Window.partitionBy("id").orderBy("turn", "role", "text")
    rows = rows.withColumn("pos", F.row_number().over(order)).withColumn("last", F.lead("pos").over(order).isNull())
    # A null and an empty string hash alike, so nullness is hashed too.
    parts = ["pos", "role", F.col("role").isNull(), "text", F.col("text").isNull()]
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({
        "p1": F.sum(F.pmod(F.xxhash64(*parts), F.lit(HASH_SPACE))).over(running),
        "p2": F.sum(F.pmod(F.xxhash64(F.lit("second"), *parts), F.lit(HASH_SPACE))).over(running),
    })
    rows = stored(rows, root, "prefixes")
    whole = rows.where("last").groupBy("pos", "p1", "p2").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n_copies"))
    prefixes = rows.where("NOT last").select("pos", "p1", "p2").distinct()
    kept = whole.join(prefixes, ["pos", "p1", "p2"], "left_anti").select("id", F.col("pos").cast("long").alias("n_turns"), "n_copies")
    kept = stored(kept, root, "kept")
    line = F.concat(F.lit(START), F.coalesce("role", F.lit("unknown")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit(f"{END}\n"))
    mine = rows.alias("r").join(kept.alias("k"), F.col("r.id").eqNullSafe(F.col("k.id"))).select("k.*", "pos", line.alias("line"))
    lines = mine.groupBy("id", "n_turns", "n_copies").agg(F.sort_array(F.collect_list(F.struct("pos", "line"))).alias("lines"))
    rendered = F.array_join(F.transform("lines", lambda x: x["line"]), "")
    return lines.select(F.col("id").alias(conversation), "n_turns", "n_copies", rendered.alias("rendered"))
