"""Writers. Every sink writes one file per task; nothing is funnelled through a single task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T


def sink_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> str:
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return path


def sink_csv_report(df: DataFrame, path: str, order_by: Sequence[str | Column] = ()) -> str:
    """CSV with a header; ``order_by`` range-partitions, so the files are globally ordered by name."""
    out = df.orderBy(*order_by) if order_by else df
    out.write.mode("overwrite").option("header", True).csv(path)
    return path


def json_safe(df: DataFrame) -> DataFrame:
    """Replace infinities and NaN by NULL and dates by text, as JSON cannot hold them."""
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(F.isnan(c) | c.isin(float("inf"), float("-inf")), None).otherwise(c)
        elif isinstance(f.dataType, (T.DateType, T.TimestampType)):
            c = c.cast("string")
        out.append(c.alias(f.name))
    return df.select(*out)


def sink_json_records(df: DataFrame, path: str) -> str:
    json_safe(df).write.mode("overwrite").option("ignoreNullFields", False).json(path)
    return path


def sink_analysis_ready(
    panel: DataFrame, quarantine: DataFrame, dictionary: DataFrame, lineage: DataFrame, root: str
) -> dict[str, str]:
    """Persist panel (partitioned by month), quarantine, data dictionary and lineage under ``root``."""
    by_month = panel.withColumn("month_start", F.date_trunc("month", "Date").cast("date"))
    return {
        "analysis_ready": sink_parquet(
            by_month.hint("rebalance", "month_start"),
            f"{root}/analysis_ready", ["month_start"],
        ),
        "inventory_quarantine": sink_parquet(quarantine, f"{root}/inventory_quarantine"),
        "data_dictionary": sink_parquet(dictionary, f"{root}/data_dictionary"),
        "lineage": sink_parquet(lineage, f"{root}/lineage"),
    }
