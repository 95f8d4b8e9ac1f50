"""Shared passages between item texts and a benchmark by winnowed fingerprints, extended to exact windows of words."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..sources.checkpoints import work_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Fixed value: what lies between words once A-Z are lower case.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def benchmark_words(text: Column) -> Column:
    """Words of a text in order; null has none."""
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.filter(F.split(lowered, BETWEEN), lambda w: w != "")


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def sliding(values: Column, size: int, combine: Callable[..., Column]) -> Column:
    """``combine`` of every ``size`` consecutive values of an array; none if it has fewer."""
    steps = lambda v: F.when(F.size(v) >= size, F.sequence(F.lit(0), F.size(v) - size)).otherwise(F.array().cast("array<int>"))
    return bound(values, lambda v: F.transform(steps(v), lambda i: combine(*[F.get(v, i + j) for j in range(size)])))


def gram_hashes(words: Column, size: int) -> Column:
    """A hash of the ``size`` words from each position, as far as there are so many."""
    return sliding(words, size, F.xxhash64)


def winnowed(hashes: Column, window: int) -> Column:
    """The smallest hash of every ``window`` consecutive ones, each value once."""
    return F.array_distinct(sliding(hashes, window, F.least))


def prints_of_kind(hashes: Column, kind: int) -> Column:
    return F.transform(hashes, lambda h: F.struct(F.lit(kind).alias("kind"), h.alias("print")))


def shared_passages(
    records: DataFrame, benchmark: DataFrame, key: str = "SKU", text: str = "Product_Name", item: str = "item_id", item_text: str = "text",
    window: int = 10, gram: int = 5,
) -> DataFrame:
    """Words of item texts that lie in a benchmark passage: (key, ``n_words``, ``n_hit``, ``items``).

    A passage is ``window`` consecutive words of a benchmark item, or all words of an item with fewer. Both sides keep the
    smallest ``gram``-word hash of every ``window - gram + 1`` consecutive ones, so any shared passage has a fingerprint in
    common; matching fingerprints are extended left and right by comparing the words themselves. Items shorter than
    ``window`` are found by the hash of all their words instead, and compared likewise. ``n_hit`` counts the positions inside any
    passage, ``items`` lists the ids of the items with passages found, as sorted text. A null text has no words; items
    without words match nothing; a null item id is left out of ``items`` but its words count as hit; repeated rows and null keys
    are judged each for itself; tables may be empty. Other columns are dropped.
    """
    spark = records.sparkSession
    root = work_dir(spark)
    apart = window - gram + 1

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.option("compression", "zstd").parquet(f"{root}/{name}")
        return spark.read.schema(df.schema).parquet(f"{root}/{name}")

    items = benchmark.select(F.col(item).cast("string").alias("item"), benchmark_words(F.col(item_text)).alias("words")).where(F.size("words") > 0)
    items = stored(items.select("item", "words", F.least(F.size("words"), F.lit(window)).alias("m")), "items")
    short = sorted(r["m"] for r in items.where(F.col("m") < window).select("m").distinct().collect())
    # Kind 0: winnowed grams; kind m: all words of an item with m words. At most ``window`` kinds.
    kinds = [prints_of_kind(winnowed(gram_hashes(F.col("words"), gram), apart), 0)]
    for m in short:
        kinds.append(prints_of_kind(F.array_distinct(gram_hashes(F.col("words"), m)), m))
    own = [F.when(F.col("m") == (window if i == 0 else short[i - 1]), k) for i, k in enumerate(kinds)]
    prints = stored(items.select(F.inline(F.coalesce(*own))).distinct(), "prints")

    # First look: all texts, but only hashes leave the row. Small files of fingerprints are broadcast, larger ones are shuffled.
    row = [F.xxhash64(F.col(key), F.col(text)).alias("h1"), F.xxhash64(F.lit(1), F.col(key), F.col(text)).alias("h2")]
    hashed = records.select(F.col(key).alias("key"), *row, benchmark_words(F.col(text)).alias("words"))
    hashed = stored(hashed.select("key", "h1", "h2", F.size("words").cast("long").alias("n_words"), F.concat(*kinds).alias("prints")), "hashed")
    seen = hashed.select("h1", "h2", F.inline("prints"))
    near = stored(seen.join(prints, ["kind", "print"], "left_semi").select("h1", "h2").distinct(), "near")

    # Second look: texts with a common fingerprint. A hit is extended to the windows around it, which are compared as text.
    texts = records.select(*row, F.col(text).alias("text")).join(near, ["h1", "h2"], "left_semi").dropDuplicates(["h1", "h2"])
    texts = stored(texts.select("h1", "h2", benchmark_words(F.col("text")).alias("words")), "texts")
    hit = texts.select("h1", "h2", F.posexplode(gram_hashes(F.col("words"), gram)).alias("p", "print")).join(prints.where("kind = 0"), "print", "left_semi")
    around = F.explode(F.sequence(F.greatest(F.col("p") - apart + 1, F.lit(0)), F.col("p")))
    starts = hit.select("h1", "h2", around.alias("s")).groupBy("h1", "h2").agg(F.collect_set("s").alias("s"))
    windows = texts.join(starts, ["h1", "h2"]).select("h1", "h2", "words", F.explode("s").alias("s"), F.lit(window).alias("m"))
    for m in short:
        more = texts.select("h1", "h2", "words", F.explode(F.sequence(F.lit(0), F.greatest(F.size("words") - m, F.lit(0)))).alias("s"), F.lit(m).alias("m"))
        windows = windows.union(more)
    span = F.array_join(F.slice("words", F.col("s") + 1, F.col("m")), " ")
    windows = windows.where(F.col("s") + F.col("m") <= F.size("words")).select("h1", "h2", "s", "m", span.alias("span"))
    wanted = items.select("item", "m", "words", F.explode(F.sequence(F.lit(0), F.size("words") - F.col("m"))).alias("s")).select("item", "m", span.alias("span"))
    hits = stored(windows.join(stored(wanted.distinct(), "wanted"), ["m", "span"]).select("h1", "h2", "s", "m", "item"), "hits")
    inside = hits.select("h1", "h2", "s", "m").distinct().select("h1", "h2", F.explode(F.sequence(F.col("s"), F.col("s") + F.col("m") - 1)).alias("at"))
    counts = inside.distinct().groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_hit"))
    named = hits.groupBy("h1", "h2").agg(F.sort_array(F.collect_set("item")).alias("items"))
    found = hashed.select("key", "h1", "h2", "n_words").join(counts.join(named, ["h1", "h2"]), ["h1", "h2"], "left")
    none = F.array().cast("array<string>")
    return found.select(F.col("key").alias(key), "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", none).alias("items"))
