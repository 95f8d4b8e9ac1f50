"""Documents to packed sequences in five stages; every stage reads what the one before it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from demandloom.llm.stages import drop_contaminated, keep_known_languages, keep_one_of_similar, pack_kept, redact_secrets
from demandloom.sources.checkpoints import work_dir

STAGES = [
    ("language", keep_known_languages),
    ("similar", keep_one_of_similar),
    ("decontaminate", drop_contaminated),
    ("secrets", redact_secrets),
    ("pack", pack_kept),
]

#: Learned languages and token ids have no SQL form; tests compare the run with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root = work_dir(spark)
    for i, (name, stage) in enumerate(STAGES):
        path = f"{root}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
