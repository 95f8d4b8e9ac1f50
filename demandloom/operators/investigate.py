"""Investigation tables on orphans, margins, unit values and thresholds."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import ratio
from .ordered import prefix_scan, quantiles, row_numbers
from .risk import ARRIVALS

# Weeks tested and tolerance bands of the published analyses.
SWEEP_WEEKS = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12)
TOLERANCE_BANDS = (0.01, 0.05, 0.10, 0.20)
QUANTITIES = {
    "Current_Stock": "stock", "On_Order": "on_order", "Lead_Time_Days": "lead_time", "Safety_Stock": "safety_stock",
    "Reorder_Point": "reorder_point", "Inventory_Value": "inv_value",
}


def orphan_profile(inventory: DataFrame, master: DataFrame, sales: DataFrame) -> DataFrame:
    """Per item without master data: snapshot span, range of every quantity, and whether it was ever sold."""
    orphans = inventory.join(master.select("SKU"), "SKU", "left_anti")
    columns = [F.count(F.lit(1)).alias("n_records"), F.min("Snapshot_Date").alias("first_snapshot"), F.max("Snapshot_Date").alias("last_snapshot")]
    for source, name in QUANTITIES.items():
        columns += [F.avg(source).alias(f"{name}_avg"), F.min(source).alias(f"{name}_min"), F.max(source).alias(f"{name}_max")]
        if name in ("stock", "on_order", "inv_value"):
            columns.append(F.sum(source).alias(f"{name}_total"))
    sold = sales.select("SKU").distinct().withColumn("_sold", F.lit(True))
    return orphans.groupBy("SKU").agg(*columns).join(sold, "SKU", "left").select(
        "*", F.coalesce("_sold", F.lit(False)).alias("in_sales")
    ).drop("_sold")


def orphan_vs_master(inventory: DataFrame, master: DataFrame) -> DataFrame:
    """Mean of every quantity for both populations, and their ratio."""
    known = master.select("SKU", F.lit(True).alias("_k"))
    tagged = inventory.join(known, "SKU", "left")
    is_master = F.coalesce("_k", F.lit(False))
    one = tagged.agg(
        *[F.avg(F.when(is_master, F.col(q))).alias(f"m_{q}") for q in QUANTITIES],
        *[F.avg(F.when(~is_master, F.col(q))).alias(f"o_{q}") for q in QUANTITIES],
    )
    rows = [
        F.struct(
            F.lit(q).alias("field"), F.col(f"m_{q}").alias("master_mean"), F.col(f"o_{q}").alias("orphan_mean"),
            ratio(F.col(f"o_{q}"), F.col(f"m_{q}")).alias("ratio"),
        )
        for q in QUANTITIES
    ]
    return one.select(F.inline(F.array(*rows)))


def _sales_by_item(sales: DataFrame) -> DataFrame:
    return sales.groupBy("SKU").agg(
        F.sum("Units_Sold").cast("bigint").alias("total_units"), F.round(F.sum("Revenue"), 2).alias("total_revenue"),
        F.avg("Price").alias("sales_price_avg"), F.min("Price").alias("sales_price_min"), F.max("Price").alias("sales_price_max"),
        F.count(F.lit(1)).alias("n_transactions"),
    )


def price_consistency(master: DataFrame, sales: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Catalogue price against the mean transaction price."""
    mean = sales.groupBy("SKU").agg(F.avg("Price").alias("sales_price_avg"))
    gap = F.abs(F.col("Selling_Price") - F.col("sales_price_avg"))
    return master.join(mean, "SKU", "left").select(
        "SKU", "Selling_Price", "sales_price_avg", gap.alias("price_gap"), F.coalesce(gap <= tolerance, F.lit(False)).alias("price_agrees")
    )


def negative_margin_profile(master: DataFrame, sales: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Items sold below cost: size of the loss, sales behind it and a reading of the evidence."""
    gap = F.col("Cost_Price") - F.col("Selling_Price")
    pct = ratio(gap, F.col("Cost_Price")) * 100
    flagged = master.filter(F.col("Cost_Price") > F.col("Selling_Price"))
    agrees = F.coalesce(F.abs(F.col("Selling_Price") - F.col("sales_price_avg")) <= tolerance, F.lit(False))
    # The three class labels.
    return flagged.join(_sales_by_item(sales), "SKU", "left").select(
        "SKU", "Category", "Subcategory", "Cost_Price", "Selling_Price", "Gross_Margin_Per_Unit",
        F.round(gap, 2).alias("abs_diff"), pct.alias("pct_diff"), "total_units", "total_revenue",
        "sales_price_avg", "sales_price_min", "sales_price_max", "n_transactions", agrees.alias("price_agrees"),
        F.when(pct < 5, "POSSIBLY INTENTIONAL").when(F.col("n_transactions").isNull(), "NO SALES").otherwise("INSUFFICIENT EVIDENCE").alias("classification"),
    )


def margin_group_comparison(master: DataFrame, sales: DataFrame) -> DataFrame:
    """Flagged against normal items: units, prices and margins; overall and per category with the flagged share."""
    units = sales.groupBy("SKU").agg(F.sum("Units_Sold").cast("bigint").alias("units"))
    flag = (F.col("Cost_Price") > F.col("Selling_Price")).alias("negative_margin")
    df = master.join(units, "SKU", "left").select("Category", flag, "units", "Selling_Price", "Gross_Margin_Per_Unit")
    scope = F.when(F.grouping("Category") == 1, "all").otherwise(F.col("Category"))
    group = F.when(F.grouping("negative_margin") == 1, "all").when(F.col("negative_margin"), "flagged").otherwise("normal")
    sets = [[F.col("negative_margin")], [F.col("Category")]]
    return df.groupingSets(sets, F.col("negative_margin"), F.col("Category")).agg(
        scope.alias("scope"), group.alias("item_group"), F.count(F.lit(1)).alias("skus"), F.avg("units").alias("units_avg"),
        F.min("units").alias("units_min"), F.max("units").alias("units_max"), F.min("Selling_Price").alias("price_min"),
        F.max("Selling_Price").alias("price_max"), F.min("Gross_Margin_Per_Unit").alias("margin_min"),
        F.max("Gross_Margin_Per_Unit").alias("margin_max"), (F.count_if("negative_margin") / F.count(F.lit(1)) * 100).alias("flagged_pct"),
    ).drop("negative_margin", "Category")


def unit_value_constancy(inventory: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Implied value per unit and item: number of distinct values, spread, constant or not."""
    unit = F.round(ratio(F.col("Inventory_Value"), F.col("Current_Stock")), 2)
    return inventory.withColumn("unit_value", unit).filter(F.col("unit_value").isNotNull()).groupBy("SKU").agg(
        F.count_distinct("unit_value").alias("distinct_values"), F.avg("unit_value").alias("unit_mean"),
        F.stddev_samp("unit_value").alias("unit_std"), F.min("unit_value").alias("unit_min"), F.max("unit_value").alias("unit_max"),
    ).withColumn("is_constant", F.col("unit_max") - F.col("unit_min") <= tolerance)


def implied_unit_value(inventory: DataFrame) -> DataFrame:
    """Value per unit of each item over all its snapshots."""
    return inventory.groupBy("SKU").agg(
        F.round(ratio(F.sum("Inventory_Value"), F.sum("Current_Stock")), 2).alias("unit_iv")
    )


def nearest_price_match(units: DataFrame, master: DataFrame, price: str) -> DataFrame:
    """For each item's unit value the closest catalogue ``price`` of any item, and whether it is exact.

    Values and prices are laid on one line; the nearest price is the last one below or the first one above,
    so two range scans replace the comparison of every value with every price. Ties go to the lower price.
    """
    catalogue = master.groupBy(F.col(price).alias("v")).agg(F.min("SKU").alias("match_sku"))
    line = (
        units.filter(F.col("unit_iv").isNotNull()).select(F.col("unit_iv").alias("v"), F.lit(1).alias("side"), "SKU", F.lit(None).cast("double").alias("p"))
        .unionByName(catalogue.select("v", F.lit(0).alias("side"), F.col("match_sku").alias("SKU"), F.col("v").alias("p")))
    )
    below = prefix_scan(line, ["v", "side", "SKU"], {"below": ("max", "p")})
    mirrored = line.select((-F.col("v")).alias("v"), "side", "SKU", (-F.col("p")).alias("p"))
    above = prefix_scan(mirrored, ["v", "side", "SKU"], {"above": ("max", "p")})
    asked = below.filter(F.col("side") == 1).select("SKU", F.col("v").alias("unit_iv"), "below").join(
        above.filter(F.col("side") == 1).select("SKU", (-F.col("above")).alias("above")), "SKU"
    )
    gap_below, gap_above = F.round(F.col("unit_iv") - F.col("below"), 2), F.round(F.col("above") - F.col("unit_iv"), 2)
    best = F.when(F.col("above").isNull() | (gap_below <= gap_above), F.col("below")).otherwise(F.col("above"))
    matched = asked.select("SKU", "unit_iv", best.alias("match_price"))
    return (
        matched.join(catalogue.withColumnRenamed("v", "match_price"), "match_price", "left")
        .withColumn("match_diff", F.round(F.abs(F.col("unit_iv") - F.col("match_price")), 2))
        .withColumn("exact_match", F.col("match_diff") == 0)
        .select("SKU", "unit_iv", "match_price", "match_sku", "match_diff", "exact_match")
    )


def valuation_hypotheses(inventory: DataFrame, master: DataFrame) -> DataFrame:
    """How well stock x {cost, sell, mid, (2 cost + sell) / 3, margin} explains the inventory value.

    Per hypothesis: mean percent error, exact matches, rows within each tolerance band, and the distance of
    the two value vectors after each was sorted. Snapshots are items x periods, so they are never broadcast.
    """
    joined = inventory.hint("merge").join(master.select("SKU", "Cost_Price", "Selling_Price", "Gross_Margin_Per_Unit"), "SKU")
    c, s, stock = F.col("Cost_Price"), F.col("Selling_Price"), F.col("Current_Stock")
    bases = {"cost": c, "sell": s, "mid": (c + s) / 2.0, "two_thirds_cost": (c * 2.0 + s) / 3.0, "margin": F.col("Gross_Margin_Per_Unit")}
    guesses = F.array(*[F.struct(F.lit(k).alias("basis"), F.round(stock * v, 2).alias("guess")) for k, v in bases.items()])
    rows = joined.select("SKU", "Snapshot_Date", "Inventory_Value", F.inline(guesses))
    error = F.abs(ratio(F.col("guess") - F.col("Inventory_Value"), F.col("Inventory_Value")))
    fit = rows.groupBy("basis").agg(
        F.count(F.lit(1)).alias("n"), (F.avg(error) * 100).alias("mean_pct_error"),
        F.count_if(F.abs(F.col("guess") - F.col("Inventory_Value")) < 0.005).alias("exact_matches"),
        *[F.count_if(error <= b).alias(f"within_{int(b * 100)}pct") for b in TOLERANCE_BANDS],
    )
    left = row_numbers(rows.select("basis", "Inventory_Value", "SKU", "Snapshot_Date"), ["basis", "Inventory_Value", "SKU", "Snapshot_Date"], "r")
    right = row_numbers(rows.select("basis", "guess", "SKU", "Snapshot_Date"), ["basis", "guess", "SKU", "Snapshot_Date"], "r")
    distance = (
        left.select("basis", "r", "Inventory_Value").join(right.select("basis", "r", "guess"), ["basis", "r"])
        .groupBy("basis").agg(F.avg(F.abs(F.col("guess") - F.col("Inventory_Value"))).alias("sorted_distance"))
    )
    return fit.join(distance, "basis")


def on_order_behavior(inventory: DataFrame) -> DataFrame:
    return inventory.groupBy("SKU").agg(
        F.avg("On_Order").alias("oo_mean"), F.min("On_Order").alias("oo_min"), F.max("On_Order").alias("oo_max"),
        F.stddev_samp("On_Order").alias("oo_std"), F.count_if(F.col("On_Order") == 0).alias("oo_zero_months"),
        F.avg("Lead_Time_Days").alias("lt_mean"), F.min("Lead_Time_Days").alias("lt_min"), F.max("Lead_Time_Days").alias("lt_max"),
        F.avg("Current_Stock").alias("cs_mean"),
    )


def value_at_risk_gated(risk: DataFrame, unit_values: DataFrame, basis_resolved: bool) -> DataFrame:
    """Unmet units per horizon times value per unit; refuses while the valuation basis is unresolved."""
    if not basis_resolved:
        raise PermissionError("inventory valuation basis is unresolved; monetary metrics are blocked")
    shortfall = [
        (F.greatest(F.lit(0.0), -F.col(f"ip_h{h}")) * F.col("unit_iv")).alias(f"value_at_risk_h{h}") for h in range(1, 9)
    ]
    return risk.filter("inventory_data_available").join(unit_values.select("SKU", "unit_iv"), "SKU", "left").select(
        "origin_date", "SKU", "unit_iv", *shortfall
    )


def onhand_policy_variants(positions: DataFrame, policies: Sequence[str] = ("Policy_A", "Policy_B1", "Policy_B_LT", "Policy_D")) -> DataFrame:
    """Breach counts at week 8 and at week 1 per inbound policy, and how many rows differ from counting nothing.

    ``positions`` carries stock, on-order, lead time, safety stock, reorder point and the vector ``_cum``.
    """
    known = positions.filter(F.col("snapshot_date").isNotNull())

    def position(policy: str, h: int) -> str:
        inbound = re.sub(r"\bh\b", str(h), ARRIVALS[policy])
        return f"Current_Stock + {inbound} - _cum[{h - 1}]"

    variants = ", ".join(f"struct('{p}' AS policy, {position(p, 1)} AS ip1, {position(p, 8)} AS ip8)" for p in policies)
    rows = known.selectExpr(
        "Safety_Stock", "Reorder_Point", f"{position('Policy_D', 1)} AS d1", f"{position('Policy_D', 8)} AS d8", f"inline(array({variants}))"
    )
    ss, rp = F.col("Safety_Stock"), F.col("Reorder_Point")
    return rows.groupBy("policy").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("ip1") < ss).alias("ss_breach_h1"), F.count_if(F.col("ip1") < rp).alias("rp_breach_h1"),
        F.count_if(F.col("ip8") < ss).alias("ss_breach_h8"), F.count_if(F.col("ip8") < rp).alias("rp_breach_h8"),
        F.count_if((F.col("ip1") < ss) != (F.col("d1") < ss)).alias("ss_changed_h1"),
        F.count_if((F.col("ip1") < rp) != (F.col("d1") < rp)).alias("rp_changed_h1"),
        F.count_if((F.col("ip8") < rp) != (F.col("d8") < rp)).alias("rp_changed_h8"),
    )


def item_quintiles(df: DataFrame, value: str, name: str = "quintile") -> DataFrame:
    """Fifths of the items by ``value`` (ties by item key); sizes differ by at most one, larger first."""
    ranked = row_numbers(df, [value, "SKU"], "_r")
    n = df.agg(F.count(F.lit(1))).scalar()
    small, extra = F.floor(F.col("_n") / 5), F.col("_n") % 5
    edge = extra * (small + 1)
    fifth = F.when(F.col("_r") <= edge, F.floor((F.col("_r") - 1) / (small + 1))).otherwise(
        extra + F.floor(F.try_divide(F.col("_r") - 1 - edge, small))
    )
    return ranked.withColumn("_n", n).withColumn(name, (fifth + 1).cast("int")).drop("_r", "_n")


def stock_against_demand(panel_weekly: DataFrame, snapshots_at_week: DataFrame) -> DataFrame:
    """Per snapshot: position (stock + on order), safety stock, and the item's mean weekly demand."""
    mean = panel_weekly.groupBy("SKU").agg(F.avg(F.col("Units_Sold").cast("double")).alias("avg_demand"))
    return snapshots_at_week.join(mean, "SKU").withColumn("position", F.col("Current_Stock") + F.col("On_Order"))


def alerting_weeks(weeks: Sequence[int]) -> Column:
    """How many of the ascending ``weeks`` alert: ``position > N x demand + safety stock`` holds up to some N and for none beyond it."""
    base = F.col("avg_demand").isNotNull() & F.col("position").isNotNull() & F.col("Safety_Stock").isNotNull()
    alerts = [(F.col("position") > n * F.col("avg_demand") + F.col("Safety_Stock")).cast("int") for n in weeks]
    return F.when(base, sum(alerts[1:], alerts[0]))


def by_week(weeks: Sequence[int]) -> Column:
    """One row per N with its place ``i``; for counted rows only."""
    return F.inline(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(n).alias("n_weeks")) for i, n in enumerate(weeks)]))


def overstock_threshold_sweep(rows: DataFrame, master: DataFrame, weeks: Sequence[int] = SWEEP_WEEKS) -> DataFrame:
    """Alert rate of ``position > N x demand + safety stock`` for every N: overall, by category, by demand quintile.

    Each row is counted once, by its number of alerting N; sums over all larger numbers give every N.
    """
    weeks = sorted(weeks)
    per_item = rows.select("SKU", "avg_demand").distinct()
    fifths = item_quintiles(per_item, "avg_demand").select("SKU", "quintile")
    tagged = rows.join(fifths, "SKU").join(master.select("SKU", "Category"), "SKU", "left").withColumn("k", alerting_weeks(weeks))
    level = (
        F.when(F.grouping("Category") == 0, F.concat(F.lit("category:"), F.col("Category")))
        .when(F.grouping("quintile") == 0, F.concat(F.lit("quintile:"), F.col("quintile").cast("string")))
        .otherwise("all")
    )
    k = F.col("k")
    above = (F.col("position") - F.col("Safety_Stock")).cast("double")
    counted = tagged.groupingSets([[k], [k, F.col("Category")], [k, F.col("quintile")]], k, F.col("Category"), F.col("quintile")).agg(
        level.alias("level"), F.count(F.lit(1)).alias("n"), F.sum(above).alias("above"), F.sum(F.col("avg_demand")).alias("demand"),
    )
    alert = k > F.col("i")
    alerts = F.sum(F.when(alert, F.col("n")).otherwise(0))
    excess = F.sum(F.when(alert, F.col("above") - F.col("n_weeks") * F.col("demand")))
    return counted.select("level", "k", "n", "above", "demand", by_week(weeks)).groupBy("n_weeks", "level").agg(
        F.sum("n").alias("n_rows"), (alerts / F.sum("n") * 100).alias("alert_rate_pct"), F.try_divide(excess, alerts).alias("mean_excess_units"),
    )


def overstock_sweep_items(rows: DataFrame, weeks: Sequence[int] = SWEEP_WEEKS) -> DataFrame:
    """For every N: items with any and with only alerts, and the exact median excess of alerted rows.

    An item alerts somewhere if the largest number of alerting N among its rows exceeds N's place, and everywhere if the smallest does.
    """
    weeks = sorted(weeks)
    placed = rows.withColumn("k", alerting_weeks(weeks))
    per_item = placed.groupBy("SKU").agg(F.max("k").alias("most"), F.min("k").alias("least")).groupBy("most", "least").agg(F.count(F.lit(1)).alias("n"))

    def total(column: str) -> Column:
        return F.sum(F.when(F.col(column) > F.col("i"), F.col("n")).otherwise(0))

    counts = per_item.select("most", "least", "n", by_week(weeks)).groupBy("n_weeks").agg(
        total("most").alias("skus_with_any_alert"), total("least").alias("skus_with_all_alerts"))
    alerted = placed.where("k > 0").withColumn("n_weeks", F.explode(F.slice(F.array(*map(F.lit, weeks)), F.lit(1), F.col("k"))))
    excess = F.col("position") - (F.col("n_weeks") * F.col("avg_demand") + F.col("Safety_Stock"))
    median = quantiles(alerted.select("n_weeks", excess.alias("excess")), "excess", {"median_excess_units": 0.5}, ["n_weeks"])
    return counts.join(median, "n_weeks", "left")


def demand_quintiles(rows: DataFrame) -> DataFrame:
    """Stock and cover by fifth of mean weekly demand."""
    fifths = item_quintiles(rows.select("SKU", "avg_demand").distinct(), "avg_demand").select("SKU", "quintile")
    return rows.join(fifths, "SKU").groupBy("quintile").agg(
        F.count_distinct("SKU").alias("skus"), F.avg("avg_demand").alias("mean_demand"), F.avg("Current_Stock").alias("mean_stock"),
        F.avg(ratio(F.col("position"), F.col("avg_demand"))).alias("mean_cover"),
    )


def demand_correlations(rows: DataFrame) -> DataFrame:
    d = F.col("avg_demand")
    return rows.agg(
        F.corr(d, F.col("Current_Stock").cast("double")).alias("demand_stock"), F.corr(d, F.col("On_Order").cast("double")).alias("demand_on_order"),
        F.corr(d, ratio(F.col("position"), d)).alias("demand_cover"),
    )


def threshold_stability(rows: DataFrame, n_weeks: int = 8) -> DataFrame:
    """Alert rate by snapshot month."""
    alert = F.col("position") > n_weeks * F.col("avg_demand") + F.col("Safety_Stock")
    return rows.groupBy(F.date_trunc("month", "Snapshot_Date").cast("date").alias("month")).agg(
        F.count(F.lit(1)).alias("n_rows"), (F.count_if(alert) / F.count(F.lit(1)) * 100).alias("alert_rate_pct")
    )


def rop_vs_theory(rows: DataFrame) -> DataFrame:
    """Stored reorder point against lead time x demand + safety stock."""
    theory = F.col("Lead_Time_Days") / 7.0 * F.col("avg_demand") + F.col("Safety_Stock")
    rp = F.col("Reorder_Point").cast("double")
    return rows.agg(F.corr(rp, theory).alias("correlation"), F.avg(rp).alias("mean_reorder_point"), F.avg(theory).alias("mean_theory"))


def inventory_field_audit(inventory: DataFrame) -> DataFrame:
    """Nulls, range, mean, exact median and spread of every inventory field."""
    fields = list(QUANTITIES)
    long = inventory.select(F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("v")) for f in fields])))
    medians = quantiles(long, "v", {"median": 0.5}, ["field"])
    stats = long.groupBy("field").agg(
        F.count("v").alias("non_nulls"), F.count_if(F.col("v").isNull()).alias("nulls"), F.min("v").alias("min"), F.avg("v").alias("mean"),
        F.max("v").alias("max"), F.stddev_samp("v").alias("std"),
    )
    return stats.join(medians, "field")
