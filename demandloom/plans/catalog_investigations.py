"""Registered queries: investigation tables."""

from __future__ import annotations

from ..operators import investigate
from .registry import query

_Q = investigate.QUANTITIES


def _rows(c):
    return investigate.stock_against_demand(c.weekly, c.origin_snapshots)


@query(
    "orphan_profile",
    "SELECT SKU, count(*) AS n_records, min(Snapshot_Date) AS first_snapshot, max(Snapshot_Date) AS last_snapshot, "
    + ", ".join(f"avg({q}) AS {n}_avg, min({q}) AS {n}_min, max({q}) AS {n}_max" for q, n in _Q.items())
    + ", CAST(sum(Current_Stock) AS BIGINT) AS stock_total, CAST(sum(On_Order) AS BIGINT) AS on_order_total, sum(Inventory_Value) AS inv_value_total, SKU IN (SELECT SKU FROM t_sales) AS in_sales "
    "FROM t_inventory WHERE SKU NOT IN (SELECT SKU FROM t_master) GROUP BY SKU",
    " ".join(f"{n}_avg" for n in _Q.values() if n != "inv_value") + " inv_value_avg:2 inv_value_total:2",
)
def _(c):
    return investigate.orphan_profile(c.inventory, c.master, c.sales)


@query(
    "orphan_vs_master",
    " UNION ALL ".join(
        f"SELECT '{q}' AS field, (SELECT avg({q}) FROM t_aligned) AS master_mean, (SELECT avg({q}) FROM t_quarantine) AS orphan_mean, (SELECT avg({q}) FROM t_quarantine) / (SELECT avg({q}) FROM t_aligned) AS ratio"
        for q in _Q
    ),
    "master_mean:3 orphan_mean:3 ratio",
)
def _(c):
    return investigate.orphan_vs_master(c.inventory, c.master)


_SOLD = """(SELECT SKU, CAST(sum(Units_Sold) AS BIGINT) AS total_units, round(sum(Revenue), 2) AS total_revenue, avg(Price) AS sales_price_avg, min(Price) AS sales_price_min,
    max(Price) AS sales_price_max, count(*) AS n_transactions FROM t_sales GROUP BY SKU)"""


@query(
    "price_consistency",
    f"""SELECT m.SKU, Selling_Price, sales_price_avg, abs(Selling_Price - sales_price_avg) AS price_gap, coalesce(abs(Selling_Price - sales_price_avg) <= 0.01, false) AS price_agrees
    FROM t_master m LEFT JOIN {_SOLD} s ON m.SKU = s.SKU""",
    "sales_price_avg price_gap",
)
def _(c):
    return investigate.price_consistency(c.master, c.sales)


@query(
    "negative_margin_profile",
    f"""SELECT m.SKU, Category, Subcategory, Cost_Price, Selling_Price, Gross_Margin_Per_Unit, round(Cost_Price - Selling_Price, 2) AS abs_diff,
    (Cost_Price - Selling_Price) / Cost_Price * 100 AS pct_diff, total_units, total_revenue, sales_price_avg, sales_price_min, sales_price_max, n_transactions,
    coalesce(abs(Selling_Price - sales_price_avg) <= 0.01, false) AS price_agrees, CASE WHEN (Cost_Price - Selling_Price) / Cost_Price * 100 < 5 THEN 'POSSIBLY INTENTIONAL'
    WHEN n_transactions IS NULL THEN 'NO SALES' ELSE 'INSUFFICIENT EVIDENCE' END AS classification
    FROM t_master m LEFT JOIN {_SOLD} s ON m.SKU = s.SKU WHERE Cost_Price > Selling_Price""",
    "abs_diff:2 pct_diff sales_price_avg sales_price_min sales_price_max total_revenue:2",
)
def _(c):
    return investigate.negative_margin_profile(c.master, c.sales)


_GROUP = """count(*) AS skus, avg(units) AS units_avg, min(units) AS units_min, max(units) AS units_max, min(Selling_Price) AS price_min, max(Selling_Price) AS price_max,
    min(Gross_Margin_Per_Unit) AS margin_min, max(Gross_Margin_Per_Unit) AS margin_max, count(*) FILTER (negative_margin_flag) / count(*) * 100 AS flagged_pct
    FROM t_nmaster m LEFT JOIN (SELECT SKU, CAST(sum(Units_Sold) AS BIGINT) AS units FROM t_sales GROUP BY SKU) s ON m.SKU = s.SKU GROUP BY 1, 2"""


@query(
    "margin_group_comparison",
    f"SELECT 'all' AS scope, CASE WHEN negative_margin_flag THEN 'flagged' ELSE 'normal' END AS item_group, {_GROUP} UNION ALL SELECT Category, 'all', {_GROUP}",
    "units_avg flagged_pct",
)
def _(c):
    return investigate.margin_group_comparison(c.master, c.sales)


@query(
    "unit_value_constancy",
    """SELECT SKU, count(DISTINCT v) AS distinct_values, avg(v) AS unit_mean, stddev_samp(v) AS unit_std, min(v) AS unit_min, max(v) AS unit_max, max(v) - min(v) <= 0.01 AS is_constant
    FROM (SELECT SKU, round(Inventory_Value / nullif(Current_Stock, 0), 2) AS v FROM t_inventory) WHERE v IS NOT NULL GROUP BY SKU""",
    "unit_mean unit_std",
)
def _(c):
    return investigate.unit_value_constancy(c.inventory)


_UNIT = "(SELECT SKU, round(sum(Inventory_Value) / sum(Current_Stock), 2) AS unit_iv FROM t_aligned GROUP BY SKU)"


def _nearest(price: str) -> str:
    return f"""SELECT u.SKU, unit_iv, {price} AS match_price, m.SKU AS match_sku, round(abs(unit_iv - {price}), 2) AS match_diff, round(abs(unit_iv - {price}), 2) = 0 AS exact_match
    FROM {_UNIT} u CROSS JOIN t_master m QUALIFY row_number() OVER (PARTITION BY u.SKU ORDER BY round(abs(unit_iv - {price}), 2), {price}, m.SKU) = 1"""


@query("nearest_price_match", _nearest("Cost_Price"), "match_diff:2")
def _(c):
    return investigate.nearest_price_match(investigate.implied_unit_value(c.origin_snapshots), c.master, "Cost_Price")


@query("nearest_price_match_selling", _nearest("Selling_Price"), "match_diff:2")
def _(c):
    return investigate.nearest_price_match(investigate.implied_unit_value(c.origin_snapshots), c.master, "Selling_Price")


@query(
    "valuation_hypotheses",
    """WITH g AS (SELECT basis, a.SKU, a."Date", Inventory_Value AS v, round(Current_Stock * CASE basis WHEN 'cost' THEN Cost_Price WHEN 'sell' THEN Selling_Price
        WHEN 'mid' THEN (Cost_Price + Selling_Price) / 2 WHEN 'two_thirds_cost' THEN (Cost_Price * 2 + Selling_Price) / 3 ELSE Gross_Margin_Per_Unit END, 2) AS guess
      FROM t_aligned a JOIN t_master m ON a.SKU = m.SKU CROSS JOIN (SELECT unnest(['cost', 'sell', 'mid', 'two_thirds_cost', 'margin']) AS basis) b),
    x AS (SELECT *, row_number() OVER (PARTITION BY basis ORDER BY v) AS rv, row_number() OVER (PARTITION BY basis ORDER BY guess) AS rg FROM g)
    SELECT f.*, d.sorted_distance FROM (SELECT basis, count(*) AS n, avg(abs((guess - v) / v)) * 100 AS mean_pct_error, count(*) FILTER (abs(guess - v) < 0.005) AS exact_matches,
      count(*) FILTER (abs((guess - v) / v) <= 0.01) AS within_1pct, count(*) FILTER (abs((guess - v) / v) <= 0.05) AS within_5pct,
      count(*) FILTER (abs((guess - v) / v) <= 0.1) AS within_10pct, count(*) FILTER (abs((guess - v) / v) <= 0.2) AS within_20pct FROM g GROUP BY basis) f
    JOIN (SELECT a.basis, avg(abs(b.guess - a.v)) AS sorted_distance FROM x a JOIN x b ON a.basis = b.basis AND a.rv = b.rg GROUP BY 1) d ON f.basis = d.basis""",
    "mean_pct_error sorted_distance:2",
)
def _(c):
    return investigate.valuation_hypotheses(c.origin_snapshots, c.master)


@query(
    "on_order_behavior",
    """SELECT SKU, avg(On_Order) AS oo_mean, min(On_Order) AS oo_min, max(On_Order) AS oo_max, stddev_samp(On_Order) AS oo_std, count(*) FILTER (On_Order = 0) AS oo_zero_months,
    avg(Lead_Time_Days) AS lt_mean, min(Lead_Time_Days) AS lt_min, max(Lead_Time_Days) AS lt_max, avg(Current_Stock) AS cs_mean FROM t_inventory GROUP BY SKU""",
    "oo_mean oo_std lt_mean cs_mean",
)
def _(c):
    return investigate.on_order_behavior(c.inventory)


@query(
    "value_at_risk_gated",
    "SELECT origin_date, p.SKU, unit_iv, " + ", ".join(f"greatest(0, -ip[{h}]) * unit_iv AS value_at_risk_h{h}" for h in range(1, 9)) + f" FROM t_pos p LEFT JOIN {_UNIT} u ON p.SKU = u.SKU WHERE snap IS NOT NULL",
    " ".join(f"value_at_risk_h{h}:3" for h in range(1, 9)),
)
def _(c):
    return investigate.value_at_risk_gated(c.risk, investigate.implied_unit_value(c.origin_snapshots), basis_resolved=True)


def _ip(policy: str, h: int) -> str:
    inbound = {
        "Policy_A": "oo", "Policy_B1": f"CASE WHEN lt <= 7 OR {h} >= 2 THEN oo ELSE 0 END", "Policy_B_LT": f"CASE WHEN lt <= {7 * h} THEN oo ELSE 0 END", "Policy_D": "0",
    }[policy]
    return f"(stock + {inbound} - cum[{h}])"


def _policy(p: str) -> str:
    a, b, d1, d8 = _ip(p, 1), _ip(p, 8), _ip("Policy_D", 1), _ip("Policy_D", 8)
    return (
        f"SELECT '{p}' AS policy, count(*) AS n_rows, count(*) FILTER ({a} < ss) AS ss_breach_h1, count(*) FILTER ({a} < rp) AS rp_breach_h1, count(*) FILTER ({b} < ss) AS ss_breach_h8, "
        f"count(*) FILTER ({b} < rp) AS rp_breach_h8, count(*) FILTER (({a} < ss) <> ({d1} < ss)) AS ss_changed_h1, count(*) FILTER (({a} < rp) <> ({d1} < rp)) AS rp_changed_h1, "
        f"count(*) FILTER (({b} < rp) <> ({d8} < rp)) AS rp_changed_h8 FROM t_pos WHERE snap IS NOT NULL"
    )


@query("onhand_policy_variants", " UNION ALL ".join(_policy(p) for p in ("Policy_A", "Policy_B1", "Policy_B_LT", "Policy_D")))
def _(c):
    return investigate.onhand_policy_variants(c.positions)


_FIFTHS = "(SELECT SKU, avg_demand AS ad, CAST(ntile(5) OVER (ORDER BY avg_demand, SKU) AS INTEGER) AS quintile FROM (SELECT DISTINCT SKU, avg_demand FROM t_snapdemand))"
_SWEEP = "(SELECT *, \"position\" - (n_weeks * avg_demand + Safety_Stock) AS excess FROM t_snapdemand CROSS JOIN (SELECT unnest([1, 2, 3, 4, 5, 6, 7, 8, 10, 12]) AS n_weeks) n)"
_ALERT = "count(*) AS n_rows, count(*) FILTER (excess > 0) / count(*) * 100 AS alert_rate_pct, avg(excess) FILTER (excess > 0) AS mean_excess_units"


@query(
    "overstock_threshold_sweep",
    f"""SELECT n_weeks, 'all' AS level, {_ALERT} FROM {_SWEEP} GROUP BY 1
    UNION ALL SELECT n_weeks, 'category:' || Category, {_ALERT} FROM {_SWEEP} s JOIN t_master m ON s.SKU = m.SKU GROUP BY 1, 2
    UNION ALL SELECT n_weeks, 'quintile:' || quintile, {_ALERT} FROM {_SWEEP} s JOIN {_FIFTHS} f ON s.SKU = f.SKU GROUP BY 1, 2""",
    "alert_rate_pct mean_excess_units",
)
def _(c):
    return investigate.overstock_threshold_sweep(_rows(c), c.master)


@query(
    "overstock_sweep_items",
    f"""SELECT a.*, median_excess_units FROM (SELECT n_weeks, count(*) FILTER (x) AS skus_with_any_alert, count(*) FILTER (y) AS skus_with_all_alerts FROM (
      SELECT n_weeks, SKU, bool_or(excess > 0) AS x, bool_and(excess > 0) AS y FROM {_SWEEP} GROUP BY 1, 2) GROUP BY 1) a
    LEFT JOIN (SELECT n_weeks, median(excess) AS median_excess_units FROM {_SWEEP} WHERE excess > 0 GROUP BY 1) b ON a.n_weeks = b.n_weeks""",
    "median_excess_units",
)
def _(c):
    return investigate.overstock_sweep_items(_rows(c))


@query(
    "demand_quintiles",
    f"""SELECT quintile, count(DISTINCT s.SKU) AS skus, avg(avg_demand) AS mean_demand, avg(Current_Stock) AS mean_stock, avg("position" / nullif(avg_demand, 0)) AS mean_cover
    FROM t_snapdemand s JOIN {_FIFTHS} f ON s.SKU = f.SKU GROUP BY 1""",
    "mean_demand mean_stock mean_cover",
)
def _(c):
    return investigate.demand_quintiles(_rows(c))


@query(
    "demand_correlations",
    'SELECT corr(avg_demand, Current_Stock) AS demand_stock, corr(avg_demand, On_Order) AS demand_on_order, corr(avg_demand, "position" / nullif(avg_demand, 0)) AS demand_cover FROM t_snapdemand',
    "demand_stock demand_on_order demand_cover",
)
def _(c):
    return investigate.demand_correlations(_rows(c))


@query(
    "threshold_stability",
    """SELECT CAST(date_trunc('month', Snapshot_Date) AS DATE) AS "month", count(*) AS n_rows, count(*) FILTER ("position" > 8 * avg_demand + Safety_Stock) / count(*) * 100 AS alert_rate_pct
    FROM t_snapdemand GROUP BY 1""",
    "alert_rate_pct",
)
def _(c):
    return investigate.threshold_stability(_rows(c))


@query(
    "rop_vs_theory",
    """SELECT corr(Reorder_Point, th) AS correlation, avg(Reorder_Point) AS mean_reorder_point, avg(th) AS mean_theory FROM (SELECT Reorder_Point, Lead_Time_Days / 7 * avg_demand + Safety_Stock AS th FROM t_snapdemand)""",
    "correlation mean_reorder_point mean_theory",
)
def _(c):
    return investigate.rop_vs_theory(_rows(c))


@query(
    "inventory_field_audit",
    " UNION ALL ".join(
        f"SELECT '{q}' AS field, count({q}) AS non_nulls, count(*) FILTER ({q} IS NULL) AS nulls, CAST(min({q}) AS DOUBLE) AS \"min\", avg({q}) AS mean, CAST(max({q}) AS DOUBLE) AS \"max\", stddev_samp({q}) AS std, median({q}) AS median FROM t_inventory"
        for q in _Q
    ),
    "mean:3 std:3 median:3",
)
def _(c):
    return investigate.inventory_field_audit(c.inventory)
