"""The stages of the corpus pipeline: each applies one operator to all documents that it is given."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .decontaminate import shared_passages
from .language import identify_language
from .queries import as_items, language_items, language_training, pack_items, piece_digests, table
from .secret_scan import scan_secrets
from .similar import similar_groups


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language cannot be told: null or empty texts and those without a letter. Repeated rows are judged each."""
    items = language_items(docs, docs.columns)
    return identify_language(items, language_training(docs)).where(F.col("lang_pred") != "und").select("SKU.*")


def beside(docs: DataFrame, *mark: Column) -> DataFrame:
    """(``doc``, ``me``): whole rows, and what tells a document apart, so no column of the documents clashes with a helper."""
    return docs.select(F.struct("*").alias("doc"), F.to_json(F.struct(*mark)).alias("me"))


def keep_one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of similar texts; repeated rows count as one document.

    Null ids come before others; documents without words are similar to none but their own repeats.
    """
    mark = [F.col("doc_id"), F.xxhash64("text").alias("h")]
    groups = similar_groups(docs.select(F.struct(*mark).alias("SKU"), F.col("text").alias("Product_Name")))
    kept = groups.where(F.to_json("SKU") == F.to_json("component_id")).select(F.to_json("SKU").alias("me")).distinct()
    return beside(docs, *mark).join(kept, "me", "left_semi").dropDuplicates(["me"]).select("doc.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents with a benchmark passage; a null text has none. Repeated rows share one verdict, null ids are told apart by their texts."""
    mark = [F.col("doc_id"), F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2")]
    items = docs.select(F.struct(*mark).alias("SKU"), F.col("text").alias("Product_Name"))
    bad = shared_passages(items, table(spark, sf_dir, "benchmark")).where("n_hit > 0").select(F.to_json("SKU").alias("me")).distinct()
    return beside(docs, *mark).join(bad, "me", "left_anti").select("doc.*")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep every document; replace its secrets by a mark and bring ``n_chars``, if there is one, up to date. A null text stays null."""
    others = [c for c in docs.columns if c not in ("text", "n_chars")]
    sizes = [c for c in docs.columns if c == "n_chars"]
    items = docs.select(F.struct(*others, *sizes).alias("SKU"), F.col("text").alias("Product_Name"))
    text = F.col("redacted")
    n_chars = [F.when(F.size("spans") > 0, F.length(text).cast("long")).otherwise(F.col(f"SKU.{c}")).alias(c) for c in sizes]
    out = scan_secrets(items, keep_text=True).select(*[F.col(f"SKU.{c}") for c in others], text.alias("text"), *n_chars)
    return out.select(*docs.columns)


def pack_kept(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed; every row is packed for itself, a null text or id too."""
    return piece_digests(pack_items(as_items(docs)))
