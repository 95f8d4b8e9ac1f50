"""The four logical inputs as views over a star schema (``lineitem``, ``supplier``, ``nation``, ``region``).

Money is rounded to whole cents with integer arithmetic before it is used, so the derived prices do not
depend on the order in which a distributed sum was added up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import season_name
from ..schemas import STAR

# Holidays as (month, day, name) and promotion events as (month, first day, last day, name).
HOLIDAYS = (
    (1, 1, "New Year"),
    (5, 1, "Labour Day"),
    (10, 31, "Halloween"),
    (12, 25, "Christmas"),
)
EVENTS = (
    (3, 10, 20, "Spring Sale"),
    (7, 1, 14, "Summer Sale"),
    (11, 20, 30, "Black Week"),
)
PROMOTION_DISCOUNT = 0.09


def read_star(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """Scan one parquet table with its declared schema (no inference job)."""
    reader = spark.read
    if table in STAR:
        reader = reader.schema(STAR[table])
    return reader.parquet(f"{sf_dir}/{table}.parquet")


def sku_label(key: Column) -> Column:
    """``SKU`` plus the one-based key, padded to at least three digits."""
    text = (key + 1).cast("string")
    return F.concat(F.lit("SKU"), F.when(F.length(text) < 3, F.lpad(text, 3, "0")).otherwise(text))


def sales_daily(lineitem: DataFrame, key: str = "l_suppkey") -> DataFrame:
    day = F.col("l_shipdate").cast("date")
    promo = (F.col("l_discount") >= PROMOTION_DISCOUNT).cast("bigint")
    return (
        lineitem.groupBy(day.alias("Date"), F.col(key).alias("_key"))
        .agg(
            F.sum("l_quantity").cast("bigint").alias("Units_Sold"),
            F.round(F.sum("l_extendedprice"), 2).alias("Revenue"),
            F.max(promo).alias("Promotion"),
        )
        .select(
            "Date",
            sku_label(F.col("_key")).alias("SKU"),
            "Units_Sold",
            "Revenue",
            (F.col("Revenue") / F.col("Units_Sold")).alias("Price"),
            "Promotion",
        )
    )


def sku_master(lineitem: DataFrame, supplier: DataFrame, nation: DataFrame, region: DataFrame) -> DataFrame:
    # nation and region are fixed lists (25 and 5 rows), so broadcasting them is bounded by definition.
    places = nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))
    facts = lineitem.groupBy("l_suppkey").agg(
        F.sum("l_quantity").alias("_units"),
        F.round(F.sum("l_extendedprice") * 100, 0).alias("_cents"),
        F.min(F.col("l_shipdate").cast("date")).alias("_first"),
    )
    selling = F.round(F.col("_cents") / F.col("_units"), 0).cast("bigint")
    share = F.lit(70) + F.lit(5) * (F.col("s_suppkey") % 10)
    return (
        supplier.join(facts, F.col("s_suppkey") == F.col("l_suppkey"))
        .join(F.broadcast(places), F.col("s_nationkey") == F.col("n_nationkey"))
        .withColumn("_sell", selling)
        .withColumn("_cost", F.floor((F.col("_sell") * share + 50) / 100).cast("bigint"))
        .select(
            sku_label(F.col("s_suppkey")).alias("SKU"),
            F.col("s_name").alias("Product_Name"),
            F.col("r_name").alias("Category"),
            F.col("n_name").alias("Subcategory"),
            F.date_sub("_first", 90).alias("Launch_Date"),
            (F.col("_cost") / 100.0).alias("Cost_Price"),
            (F.col("_sell") / 100.0).alias("Selling_Price"),
            ((F.col("_sell") - F.col("_cost")) / 100.0).alias("Gross_Margin_Per_Unit"),
        )
    )


def ship_span(lineitem: DataFrame) -> DataFrame:
    return lineitem.agg(
        F.min("l_shipdate").cast("date").alias("lo"), F.max("l_shipdate").cast("date").alias("hi")
    )


def calendar(lineitem: DataFrame) -> DataFrame:
    """One row per day from the start of the first shipping month to the last shipping date."""
    day = F.col("date")
    month, dom = F.month(day), F.dayofmonth(day)
    holiday = F.lit(None).cast("string")
    for m, d, name in HOLIDAYS:
        holiday = F.when((month == m) & (dom == d), name).otherwise(holiday)
    event = F.lit(None).cast("string")
    for m, first, last, name in EVENTS:
        event = F.when((month == m) & dom.between(first, last), name).otherwise(event)
    weekday = F.weekday(day)
    return (
        ship_span(lineitem)
        .select(F.explode(F.sequence(F.date_trunc("month", "lo").cast("date"), F.col("hi"))).alias("date"))
        .select(
            "date",
            F.year(day).cast("bigint").alias("year"),
            month.cast("bigint").alias("month"),
            F.concat(F.lit("Q"), F.quarter(day)).alias("quarter"),
            F.weekofyear(day).cast("bigint").alias("week"),
            (weekday >= 5).cast("bigint").alias("is_weekend"),
            season_name(month).alias("season"),
            holiday.isNotNull().cast("bigint").alias("is_holiday"),
            holiday.alias("holiday"),
            event.alias("promotion_event"),
            F.date_format(day, "EEEE").alias("day_of_week"),
        )
        .select(
            "date", "year", "month", "quarter", "week", "day_of_week", "is_weekend", "season",
            "is_holiday", "holiday", "promotion_event",
        )
    )


def inventory_snapshots(lineitem: DataFrame, supplier: DataFrame) -> DataFrame:
    """Month-start stock positions for twice as many items as the master holds; about 1 in 13 is missing."""
    months = (
        ship_span(lineitem)
        .select(F.sequence(F.date_trunc("month", "lo").cast("date"), F.col("hi"), F.expr("INTERVAL 1 MONTH")).alias("m"))
        .scalar()
    )
    items = supplier.agg(F.count(F.lit(1))).scalar()
    key, m = F.col("_key"), F.col("_m").cast("bigint")
    stock = F.lit(5) + (key * 7919 + m * 104729) % 400
    value = stock * (100000 + (key * 451300 + F.when(key % 5 == 0, m * 700).otherwise(0)) % 900000)
    return (
        supplier.select(F.explode(F.array(F.col("s_suppkey"), F.col("s_suppkey") + items)).alias("_key"))
        .select("_key", F.posexplode(months).alias("_m", "Snapshot_Date"))
        .filter((key * 31 + m * 17) % 13 != 0)
        .select(
            "Snapshot_Date",
            sku_label(key).alias("SKU"),
            stock.cast("bigint").alias("Current_Stock"),
            F.when((key * 13 + m * 7) % 4 == 0, 0).otherwise((key * 6007 + m * 15013) % 300)
            .cast("bigint").alias("On_Order"),
            (F.lit(3) + (key * 37 + m * 11) % 60).cast("bigint").alias("Lead_Time_Days"),
            (F.lit(10) + (key * 53 + m * 29) % 60).cast("bigint").alias("Safety_Stock"),
            (F.lit(40) + (key * 71 + m * 43) % 160).cast("bigint").alias("Reorder_Point"),
            (value / 100.0).alias("Inventory_Value"),
        )
    )
