"""Declared schemas of the four logical inputs and of the star-schema tables they are derived from."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


_TYPES = {
    "DATE": T.DateType(), "STRING": T.StringType(), "BIGINT": T.LongType(), "INT": T.IntegerType(),
    "DOUBLE": T.DoubleType(), "TIMESTAMP_NTZ": T.TimestampNTZType(),
}


def _schema(spec: str) -> T.StructType:
    """Struct type from ``name TYPE, ...``; unlike ``fromDDL`` it needs no running session."""
    fields = [f.split() for f in spec.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in fields])


@dataclass(frozen=True)
class Contract:
    """Column contract of one logical input: types, dates, key, and the checks that apply to it."""

    name: str
    schema: T.StructType
    dates: tuple[str, ...]
    key: tuple[str, ...]

    @property
    def required(self) -> list[str]:
        return self.schema.fieldNames()


SALES = Contract(
    "sales_daily",
    _schema("Date DATE, SKU STRING, Units_Sold BIGINT, Revenue DOUBLE, Price DOUBLE, Promotion BIGINT"),
    ("Date",),
    ("Date", "SKU"),
)
SKU_MASTER = Contract(
    "sku_master",
    _schema(
        "SKU STRING, Product_Name STRING, Category STRING, Subcategory STRING, Launch_Date DATE,"
        " Cost_Price DOUBLE, Selling_Price DOUBLE, Gross_Margin_Per_Unit DOUBLE"
    ),
    ("Launch_Date",),
    ("SKU",),
)
CALENDAR = Contract(
    "calendar",
    _schema(
        "date DATE, year BIGINT, month BIGINT, quarter STRING, week BIGINT, day_of_week STRING,"
        " is_weekend BIGINT, season STRING, is_holiday BIGINT, holiday STRING, promotion_event STRING"
    ),
    ("date",),
    ("date",),
)
INVENTORY = Contract(
    "inventory_snapshots",
    _schema(
        "Snapshot_Date DATE, SKU STRING, Current_Stock BIGINT, On_Order BIGINT, Lead_Time_Days BIGINT,"
        " Safety_Stock BIGINT, Reorder_Point BIGINT, Inventory_Value DOUBLE"
    ),
    ("Snapshot_Date",),
    ("Snapshot_Date", "SKU"),
)
CONTRACTS = {c.name: c for c in (SALES, SKU_MASTER, CALENDAR, INVENTORY)}

STAR = {
    "region": _schema("r_regionkey INT, r_name STRING"),
    "nation": _schema("n_nationkey INT, n_name STRING, n_regionkey INT"),
    "supplier": _schema("s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE"),
    "lineitem": _schema(
        "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE,"
        " l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING,"
        " l_linestatus STRING, l_shipdate TIMESTAMP_NTZ"
    ),
}
