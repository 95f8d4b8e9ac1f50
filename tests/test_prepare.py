from pyspark.sql import functions as F

from demandloom.operators import investigate, prepare

NUMBERS = prepare.INVENTORY_NUMBERS


def snapshots(spark, date):
    """Three months of two items, made from one row per item as the star schema does."""
    months = F.array(*[F.to_date(F.lit(f"2024-0{m}-01")) for m in (1, 2, 3)])
    items = spark.range(2).select(F.when(F.col("id") == 0, "A").otherwise("B").alias("SKU"), (F.col("id") + 4.0).alias("v"))
    return items.select(
        "SKU", F.explode(months).alias(date), *[F.col("v").alias(c) for c in NUMBERS]
    )


def broadcast_inputs(df):
    """The plans below broadcasts that read exploded rows."""
    lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
    out = []
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            inner = lines[i + 1 :]
            depth = line.index("BroadcastExchange")
            stop = next((k for k, x in enumerate(inner) if len(x) - len(x.lstrip(" :+-")) < depth), len(inner))
            out += [x for x in inner[:stop] if "Generate" in x]
    return out


def test_snapshots_are_not_broadcast_to_the_panel(spark):
    sales = spark.createDataFrame([("A", "2024-01-01", 1), ("A", "2024-01-02", 2), ("B", "2024-03-01", 3)], "SKU string, Date string, n int").withColumn("Date", F.to_date("Date"))
    got = prepare.join_inventory_exact(sales, snapshots(spark, "Date"))
    assert not broadcast_inputs(got)
    rows = {(r["SKU"], str(r["Date"])): (r["n"], r["Current_Stock"], r["has_inventory_snapshot"]) for r in got.collect()}
    assert rows == {("A", "2024-01-01"): (1, 4.0, True), ("A", "2024-01-02"): (2, None, False), ("B", "2024-03-01"): (3, 5.0, True)}


def test_snapshots_are_not_broadcast_to_the_prices(spark):
    master = spark.createDataFrame([("A", 1.0, 2.0, 1.0), ("B", 1.0, 1.0, 0.0)], "SKU string, Cost_Price double, Selling_Price double, Gross_Margin_Per_Unit double")
    got = investigate.valuation_hypotheses(snapshots(spark, "Snapshot_Date"), master)
    assert not broadcast_inputs(got)
    assert {r["basis"]: (r["n"], r["exact_matches"]) for r in got.collect()} == {
        "cost": (6, 6), "sell": (6, 3), "mid": (6, 3), "two_thirds_cost": (6, 3), "margin": (6, 3),
    }
