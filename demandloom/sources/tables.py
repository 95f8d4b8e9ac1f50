"""Typed readers for delimited and columnar files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..schemas import CONTRACTS, Contract


class MissingColumns(ValueError):
    """An input lacks columns its contract requires."""


def require_columns(df: DataFrame, required: Sequence[str], name: str) -> DataFrame:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise MissingColumns(f"{name}: missing columns {missing}")
    return df


def scan_csv_contract(spark: SparkSession, path: str, contract: Contract) -> DataFrame:
    """Read a CSV file or directory; unreadable dates and numbers become NULL, extra columns are kept.

    Only the header is looked at while planning. A missing path fails there.
    """
    raw = spark.read.csv(path, header=True, inferSchema=False)
    require_columns(raw, contract.required, contract.name)
    typed = {f.name: f"try_cast(trim(`{f.name}`) AS {f.dataType.simpleString()})" for f in contract.schema.fields}
    return raw.select(
        *[F.expr(typed[c]).alias(c) if c in typed else F.col(c) for c in raw.columns]
    )


def load_input(spark: SparkSession, name: str, path: str) -> DataFrame:
    """One of ``sales_daily``, ``sku_master``, ``calendar``, ``inventory_snapshots`` from CSV."""
    return scan_csv_contract(spark, path, CONTRACTS[name])


def load_sales(spark: SparkSession, path: str) -> DataFrame:
    return load_input(spark, "sales_daily", path)


def load_sku_master(spark: SparkSession, path: str) -> DataFrame:
    return load_input(spark, "sku_master", path)


def load_calendar(spark: SparkSession, path: str) -> DataFrame:
    return load_input(spark, "calendar", path)


def load_inventory(spark: SparkSession, path: str) -> DataFrame:
    return load_input(spark, "inventory_snapshots", path)


def scan_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df
