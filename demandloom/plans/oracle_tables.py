"""Shared tables of the check SQL (DuckDB), written independently of the DataFrame code.

A query names the tables it needs; ``with_tables`` prepends them and everything they depend on.
"""

from __future__ import annotations

import re


def sku(key: str) -> str:
    text = f"CAST({key} + 1 AS VARCHAR)"
    return f"('SKU' || CASE WHEN length({text}) < 3 THEN lpad({text}, 3, '0') ELSE {text} END)"


def week(date: str) -> str:
    return f"(CAST(date_trunc('week', {date} - INTERVAL 1 DAY) AS DATE) + 1)"


SPAN = "SELECT min(CAST(l_shipdate AS DATE)) AS lo, max(CAST(l_shipdate AS DATE)) AS hi FROM lineitem"

TABLES: dict[str, str] = {}

TABLES["t_sales"] = f"""
SELECT CAST(l_shipdate AS DATE) AS "Date", {sku('l_suppkey')} AS SKU,
  CAST(sum(l_quantity) AS BIGINT) AS Units_Sold, round(sum(l_extendedprice), 2) AS Revenue,
  round(sum(l_extendedprice), 2) / CAST(sum(l_quantity) AS BIGINT) AS Price,
  CAST(max(CASE WHEN l_discount >= 0.09 THEN 1 ELSE 0 END) AS BIGINT) AS Promotion
FROM lineitem GROUP BY CAST(l_shipdate AS DATE), l_suppkey"""

TABLES["t_master"] = f"""
SELECT {sku('s_suppkey')} AS SKU, s_name AS Product_Name, r_name AS Category, n_name AS Subcategory,
  first_day - 90 AS Launch_Date, CAST(cost AS DOUBLE) / 100 AS Cost_Price, CAST(sell AS DOUBLE) / 100 AS Selling_Price,
  CAST(sell - cost AS DOUBLE) / 100 AS Gross_Margin_Per_Unit
FROM (
  SELECT *, (sell * (70 + 5 * (s_suppkey % 10)) + 50) // 100 AS cost
  FROM supplier
  JOIN (SELECT l_suppkey, CAST(round(round(sum(l_extendedprice) * 100, 0) / sum(l_quantity), 0) AS BIGINT) AS sell,
          min(CAST(l_shipdate AS DATE)) AS first_day
        FROM lineitem GROUP BY l_suppkey) f ON s_suppkey = l_suppkey
  JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) m"""

TABLES["t_nmaster"] = "SELECT *, Cost_Price > Selling_Price AS negative_margin_flag FROM t_master"

TABLES["t_calendar"] = f"""
SELECT d AS "date", CAST(year(d) AS BIGINT) AS "year", CAST(month(d) AS BIGINT) AS "month", 'Q' || quarter(d) AS "quarter",
  CAST(week(d) AS BIGINT) AS "week", dayname(d) AS day_of_week,
  CAST(CASE WHEN isodow(d) >= 6 THEN 1 ELSE 0 END AS BIGINT) AS is_weekend,
  CASE WHEN month(d) IN (12, 1, 2) THEN 'Winter' WHEN month(d) IN (3, 4, 5) THEN 'Spring'
       WHEN month(d) IN (6, 7, 8) THEN 'Summer' ELSE 'Autumn' END AS season,
  CAST(CASE WHEN strftime(d, '%m-%d') IN ('01-01', '05-01', '10-31', '12-25') THEN 1 ELSE 0 END AS BIGINT) AS is_holiday,
  CASE strftime(d, '%m-%d') WHEN '01-01' THEN 'New Year' WHEN '05-01' THEN 'Labour Day' WHEN '10-31' THEN 'Halloween'
       WHEN '12-25' THEN 'Christmas' END AS holiday,
  CASE WHEN strftime(d, '%m-%d') BETWEEN '03-10' AND '03-20' THEN 'Spring Sale'
       WHEN strftime(d, '%m-%d') BETWEEN '07-01' AND '07-14' THEN 'Summer Sale'
       WHEN strftime(d, '%m-%d') BETWEEN '11-20' AND '11-30' THEN 'Black Week' END AS promotion_event
FROM (SELECT CAST(unnest(generate_series(date_trunc('month', CAST(lo AS TIMESTAMP)), CAST(hi AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS d FROM ({SPAN})) c"""

TABLES["t_inventory"] = f"""
SELECT md AS Snapshot_Date, {sku('key')} AS SKU, CAST(stock AS BIGINT) AS Current_Stock,
  CAST(CASE WHEN (key * 13 + m * 7) % 4 = 0 THEN 0 ELSE (key * 6007 + m * 15013) % 300 END AS BIGINT) AS On_Order,
  CAST(3 + (key * 37 + m * 11) % 60 AS BIGINT) AS Lead_Time_Days, CAST(10 + (key * 53 + m * 29) % 60 AS BIGINT) AS Safety_Stock,
  CAST(40 + (key * 71 + m * 43) % 160 AS BIGINT) AS Reorder_Point,
  CAST(stock * (100000 + (key * 451300 + CASE WHEN key % 5 = 0 THEN m * 700 ELSE 0 END) % 900000) AS DOUBLE) / 100 AS Inventory_Value
FROM (
  SELECT key, m, md, 5 + (key * 7919 + m * 104729) % 400 AS stock
  FROM (SELECT s_suppkey AS key FROM supplier UNION ALL SELECT s_suppkey + (SELECT count(*) FROM supplier) FROM supplier) k
  CROSS JOIN (SELECT md, row_number() OVER (ORDER BY md) - 1 AS m FROM (
    SELECT CAST(unnest(generate_series(date_trunc('month', CAST(lo AS TIMESTAMP)), CAST(hi AS TIMESTAMP), INTERVAL 1 MONTH)) AS DATE) AS md
    FROM ({SPAN}) s) g) ms
  WHERE (key * 31 + m * 17) % 13 <> 0) i"""

_NUMBERS = ", ".join(
    f"CAST({c} AS DOUBLE) AS {c}"
    for c in ("Current_Stock", "On_Order", "Lead_Time_Days", "Safety_Stock", "Reorder_Point", "Inventory_Value")
)
TABLES["t_aligned"] = f"""
SELECT Snapshot_Date AS "Date", SKU, {_NUMBERS}, true AS inventory_master_match_flag, false AS inventory_quarantine_flag
FROM t_inventory WHERE SKU IN (SELECT SKU FROM t_master)"""
TABLES["t_quarantine"] = f"""
SELECT Snapshot_Date AS "Date", SKU, {_NUMBERS}, false AS inventory_master_match_flag, true AS inventory_quarantine_flag
FROM t_inventory WHERE SKU NOT IN (SELECT SKU FROM t_master)"""

TABLES["t_panel"] = """
SELECT s."Date", s.SKU, s.Units_Sold, s.Revenue, s.Price, s.Promotion, m.Product_Name, m.Category, m.Subcategory, m.Launch_Date,
  m.Cost_Price, m.Selling_Price, m.Gross_Margin_Per_Unit, m.negative_margin_flag, c."year", c."month", c."week", c.is_weekend,
  c.is_holiday, c."quarter", c.day_of_week, c.season, c.holiday, c.promotion_event, a.Current_Stock, a.On_Order, a.Lead_Time_Days,
  a.Safety_Stock, a.Reorder_Point, a.Inventory_Value, a.SKU IS NOT NULL AS has_inventory_snapshot
FROM t_sales s LEFT JOIN t_nmaster m ON s.SKU = m.SKU LEFT JOIN t_calendar c ON s."Date" = c."date"
LEFT JOIN t_aligned a ON s.SKU = a.SKU AND s."Date" = a."Date\""""

TABLES["t_dfill"] = """
SELECT k.SKU, c."date" AS "Date", coalesce(s.Units_Sold, 0) AS Units_Sold, coalesce(s.Revenue, 0) AS Revenue,
  coalesce(s.Promotion, 0) AS Promotion, s.SKU IS NULL AS is_filled
FROM (SELECT DISTINCT SKU FROM t_sales) k CROSS JOIN (SELECT "date" FROM t_calendar WHERE "date" >= (SELECT min("Date") FROM t_sales)) c
LEFT JOIN t_sales s ON s.SKU = k.SKU AND s."Date" = c."date\""""

TABLES["t_weekly0"] = f"""
SELECT SKU, {week('"Date"')} AS week_start, CAST(sum(Units_Sold) AS BIGINT) AS Units_Sold,
  CAST(sum(Promotion) AS BIGINT) AS promo_days, CAST(sum(Promotion) > 0 AS INTEGER) AS promo_active
FROM t_sales GROUP BY 1, 2"""

TABLES["t_weeks"] = """
SELECT CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 7 DAY)) AS DATE) AS week_start
FROM (SELECT min(week_start) AS lo, max(week_start) AS hi FROM t_weekly0) b"""

TABLES["t_weekly"] = """
SELECT k.SKU, g.week_start, coalesce(w.Units_Sold, 0) AS Units_Sold, coalesce(w.promo_days, 0) AS promo_days,
  coalesce(w.promo_active, 0) AS promo_active
FROM (SELECT DISTINCT SKU FROM t_weekly0) k CROSS JOIN t_weeks g
LEFT JOIN t_weekly0 w ON w.SKU = k.SKU AND w.week_start = g.week_start"""

TABLES["t_items"] = """
SELECT *, CASE WHEN ADI < 1.32 AND CV2 < 0.49 THEN 'Smooth' WHEN ADI >= 1.32 AND CV2 < 0.49 THEN 'Intermittent'
  WHEN ADI < 1.32 AND CV2 >= 0.49 THEN 'Erratic' ELSE 'Lumpy' END AS Intermittency_Class
FROM (
  SELECT SKU, CAST(sum(Units_Sold) AS BIGINT) AS Total_Units_Sold, avg(Units_Sold) AS Mean_Daily_Demand,
    median(Units_Sold) AS Median_Daily_Demand, stddev_samp(Units_Sold) AS Std_Daily_Demand, min(Units_Sold) AS Min_Daily_Demand,
    max(Units_Sold) AS Max_Daily_Demand, count(*) FILTER (Units_Sold = 0) AS Zero_Demand_Days,
    count(*) FILTER (Units_Sold = 0) / count(*) * 100 AS Zero_Demand_Pct,
    CASE WHEN avg(Units_Sold) > 0 THEN stddev_samp(Units_Sold) / avg(Units_Sold) ELSE 0 END AS CV,
    count(*) / nullif(count(*) FILTER (Units_Sold > 0), 0) AS ADI,
    CASE WHEN count(*) FILTER (Units_Sold > 0) > 0
      THEN pow(coalesce(stddev_samp(Units_Sold) FILTER (Units_Sold > 0), 0) / avg(Units_Sold) FILTER (Units_Sold > 0), 2) ELSE 0 END AS CV2,
    sum(Revenue) AS Total_Revenue
  FROM t_dfill GROUP BY SKU) s"""

TABLES["t_meta"] = """
SELECT i.SKU, i.Intermittency_Class, m.Category, m.Subcategory FROM t_items i LEFT JOIN t_nmaster m ON i.SKU = m.SKU"""

TABLES["t_origins"] = """
SELECT DISTINCT CAST(lo + 7 * CAST(round_even(51 + i * CAST(n - 16 - 51 AS DOUBLE) / greatest(k - 1, 1), 0) AS INTEGER) AS DATE) AS forecast_origin
FROM (SELECT lo, n, k, unnest(range(k)) AS i FROM (
  SELECT lo, n, least(12, n - 16 - 51 + 1) AS k FROM (
    SELECT min(week_start) AS lo, CAST(count(*) AS INTEGER) AS n FROM t_weeks) a) b) c"""

TABLES["t_windows"] = """
SELECT SKU, week_start, CAST(Units_Sold AS DOUBLE) AS y, row_number() OVER w AS n, avg(Units_Sold) OVER (w ROWS UNBOUNDED PRECEDING) AS hist,
  avg(Units_Sold) OVER (w ROWS 3 PRECEDING) AS ma4, avg(Units_Sold) OVER (w ROWS 7 PRECEDING) AS ma8,
  list_reduce(list(CAST(Units_Sold AS DOUBLE)) OVER (w ROWS UNBOUNDED PRECEDING), lambda a, x: 0.7 * a + 0.3 * x) AS ses
FROM t_weekly WINDOW w AS (PARTITION BY SKU ORDER BY week_start)"""

TABLES["t_fc"] = """
SELECT w.SKU, w.week_start AS forecast_origin, CAST(w.week_start + 7 * h AS DATE) AS target_week, h AS horizon, model,
  CASE model WHEN 'naive' THEN w.y WHEN 'ma4' THEN w.ma4 WHEN 'ma8' THEN w.ma8 WHEN 'ses' THEN w.ses
    ELSE coalesce(s.y, w.hist) END AS forecast, CAST(a.Units_Sold AS DOUBLE) AS actual
FROM t_windows w JOIN t_origins o ON w.week_start = o.forecast_origin
CROSS JOIN (SELECT CAST(unnest(range(1, 9)) AS INTEGER) AS h) hs
CROSS JOIN (SELECT unnest(['seasonal_naive', 'naive', 'ma4', 'ma8', 'ses']) AS model) ms
LEFT JOIN t_windows s ON s.SKU = w.SKU AND s.week_start = w.week_start + 7 * h - 364
LEFT JOIN t_weekly a ON a.SKU = w.SKU AND a.week_start = w.week_start + 7 * h"""

TABLES["t_fcm"] = """
SELECT f.*, m.Intermittency_Class, m.Category, m.Subcategory FROM t_fc f LEFT JOIN t_meta m ON f.SKU = m.SKU"""

TABLES["t_sn"] = "SELECT * FROM t_fc WHERE model = 'seasonal_naive'"

METRICS = (
    "CASE WHEN sum(actual) > 0 THEN sum(abs(actual - forecast)) / sum(actual) * 100 END AS WAPE, "
    "avg(abs(actual - forecast)) AS MAE, sqrt(avg((actual - forecast) * (actual - forecast))) AS RMSE, count(*) AS n_forecasts"
)

TABLES["t_hm"] = f"SELECT model, horizon, {METRICS} FROM t_fc WHERE actual IS NOT NULL GROUP BY 1, 2"

TABLES["t_arch"] = """
SELECT horizon, min_by(model, {'w': WAPE, 'r': list_position(['seasonal_naive', 'naive', 'ma4', 'ma8', 'ses'], model)}) AS selected_model,
  min(WAPE) AS validation_micro_wape, max(WAPE) FILTER (model = 'seasonal_naive') AS benchmark_wape,
  min(WAPE) FILTER (model <> 'seasonal_naive') AS best_challenger_wape
FROM t_hm GROUP BY horizon"""

TABLES["t_pos"] = """
SELECT *, stock + oo AS pipe, cum[8] AS c8, cum[8] / 8 AS avgd,
  list_transform(range(1, 9), lambda h: stock + CASE WHEN lt <= 7 * h THEN oo ELSE 0 END - cum[h]) AS ip,
  list_transform(range(1, 9), lambda h: stock - cum[h]) AS sb
FROM (
  SELECT *, list_transform(range(1, 9), lambda h: list_sum(y[1:h])) AS cum
  FROM (
    SELECT o.forecast_origin AS origin_date, m.SKU FROM t_origins o CROSS JOIN t_nmaster m) k
  ASOF LEFT JOIN (
    SELECT SKU AS k2, "Date" AS snap, Current_Stock AS stock, On_Order AS oo, Lead_Time_Days AS lt, Safety_Stock AS ss,
      Reorder_Point AS rp FROM t_aligned) a ON k.SKU = a.k2 AND k.origin_date >= a.snap
  LEFT JOIN (SELECT forecast_origin, SKU AS k3, list(greatest(forecast, 0) ORDER BY horizon) AS y FROM t_sn GROUP BY 1, 2) f
    ON f.forecast_origin = k.origin_date AND f.k3 = k.SKU) p"""

TABLES["t_score"] = """
SELECT *, CASE WHEN snap IS NULL THEN 'UNKNOWN' WHEN xw <= 0 THEN 'HEALTHY' WHEN xw <= 2 THEN 'MONITOR' WHEN xw <= 6 THEN 'HIGH' ELSE 'CRITICAL' END AS ost,
  CASE WHEN snap IS NULL THEN 'UNKNOWN' WHEN w0 <= lead THEN 'CRITICAL REORDER' WHEN wr <= lead THEN 'REORDER' WHEN wr IS NOT NULL THEN 'MONITOR'
    WHEN xw > 0 THEN 'OVERSTOCK' ELSE 'HEALTHY' END AS tier
FROM (
  SELECT *, CASE WHEN snap IS NOT NULL THEN CASE WHEN avgd > 0 THEN xu / avgd ELSE 0 END END AS xw,
    CASE WHEN snap IS NOT NULL THEN CASE WHEN avgd <= 0 THEN 0 WHEN pipe <= 0 THEN 1
      ELSE greatest(0, least(1, 1 - least(1, CASE WHEN lt / 7 + ss / avgd > 0 THEN woc / (lt / 7 + ss / avgd) ELSE 1 END))) END END AS score
  FROM (
    SELECT *, CASE WHEN avgd > 0 THEN pipe / avgd WHEN pipe > 0 THEN CAST('inf' AS DOUBLE) WHEN snap IS NOT NULL THEN 0 END AS woc,
      CASE WHEN avgd > 0 THEN stock / avgd WHEN stock > 0 THEN CAST('inf' AS DOUBLE) WHEN snap IS NOT NULL THEN 0 END AS swoc,
      nullif(list_position(list_transform(ip, lambda x: x <= 0), true), 0) AS w0,
      nullif(list_position(list_transform(ip, lambda x: x < ss), true), 0) AS ws,
      nullif(list_position(list_transform(ip, lambda x: x < rp), true), 0) AS wr,
      least(8, greatest(1, CAST(ceil(lt / 7) AS INTEGER))) AS lead,
      coalesce(list_sum(y[1:least(8, CAST(floor(lt / 7) AS INTEGER))]), 0)
        + CASE WHEN floor(lt / 7) < 8 AND lt / 7 > floor(lt / 7) THEN y[CAST(floor(lt / 7) AS INTEGER) + 1] * (lt / 7 - floor(lt / 7)) ELSE 0 END AS ltd,
      CASE WHEN snap IS NOT NULL THEN greatest(0, stock + CASE WHEN lt <= 56 THEN oo ELSE 0 END - c8 - ss) END AS xu
    FROM t_pos) a) b"""

_ips = ", ".join(f"ip[{h}] AS ip_h{h}" for h in range(1, 9))


def _n0(x: str) -> str:
    return f"CAST(CAST(round_even({x}, 0) AS BIGINT) AS VARCHAR)"


def _n1(x: str) -> str:
    return f"printf('%.1f', {x})"


# The texts, codes and thresholds below repeat the published outputs, as the operators must match them.
TABLES["t_risk"] = f"""
SELECT origin_date, SKU, snap IS NOT NULL AS inventory_data_available, snap AS snapshot_date, CAST(origin_date - snap AS INTEGER) AS days_since_snapshot,
  stock AS Current_Stock, oo AS On_Order, lt AS Lead_Time_Days, ss AS Safety_Stock, rp AS Reorder_Point, avgd AS avg_weekly_demand,
  c8 AS forecast_cum_8w, {_ips}, sb[1] AS sb_h1, sb[8] AS sb_h8, woc AS weeks_of_cover, woc * 7 AS days_of_supply,
  swoc AS stock_weeks_of_cover, swoc * 7 AS stock_days_of_supply, CASE WHEN snap IS NOT NULL THEN ltd END AS lead_time_demand,
  CASE WHEN snap IS NOT NULL THEN w0 IS NOT NULL END AS is_stockout_risk, CAST(w0 AS INTEGER) AS earliest_stockout_week,
  CAST(origin_date + CAST(7 * w0 AS INTEGER) AS DATE) AS estimated_stockout_date,
  CASE WHEN snap IS NOT NULL THEN ws IS NOT NULL END AS is_safety_stock_breach, CAST(ws AS INTEGER) AS earliest_ss_breach_week,
  CASE WHEN snap IS NOT NULL THEN wr IS NOT NULL END AS is_reorder_point_breach, CAST(wr AS INTEGER) AS earliest_rp_breach_week,
  score AS stockout_score, xu AS excess_inventory_units, xw AS excess_weeks_of_cover,
  CASE WHEN snap IS NOT NULL THEN CASE WHEN pipe > 0 THEN xu / pipe ELSE 0 END END AS overstock_score, ost AS overstock_tier, tier AS action_tier,
  CASE tier
    WHEN 'CRITICAL REORDER' THEN 'CRITICAL REORDER: Stockout projected in week ' || w0 || ' (within lead time of ' || {_n0('lt')} || ' days). Expedite replenishment immediately.'
    WHEN 'REORDER' THEN 'REORDER: Projected inventory breaches Reorder Point (' || {_n0('rp')} || ' units) in week ' || wr || ' (within lead time of ' || {_n0('lt')} || ' days). Place PO now.'
    WHEN 'MONITOR' THEN 'MONITOR: Reorder Point breach projected in week ' || wr || '. Review replenishment pipeline.'
    WHEN 'OVERSTOCK' THEN 'OVERSTOCK (' || ost || '): ' || {_n0('xu')} || ' excess units (' || {_n1('xw')} || ' weeks of cover above safety buffer). Defer future orders or review promotional clearance.'
    WHEN 'HEALTHY' THEN 'HEALTHY: Adequate inventory coverage across 8-week horizon (' || {_n1('woc')} || ' weeks of cover). No action required.'
    ELSE 'UNKNOWN: No inventory snapshot available at or before ' || origin_date || '.' END AS recommendation,
  CAST(NULL AS DOUBLE) AS excess_inventory_value, CAST(NULL AS DOUBLE) AS inventory_value_at_risk, CAST(NULL AS DOUBLE) AS capital_at_risk,
  false AS valuation_basis_confirmed, false AS arrival_timing_confirmed, 'Policy_B_LT' AS on_order_policy, 8 AS overstock_threshold_weeks,
  'ENGINEERING_RECOMMENDATION_PENDING_BUSINESS_APPROVAL' AS overstock_threshold_status
FROM t_score"""

TABLES["t_qty"] = """
SELECT s.*, ip[w0] AS ip0, ip[wr] AS ipr,
  CASE WHEN tier = 'UNKNOWN' THEN 'missing'
    WHEN tier = 'CRITICAL REORDER' THEN CASE WHEN oo > 0 THEN 'expedite_open' ELSE 'expedite_new' END
    WHEN tier = 'REORDER' THEN CASE WHEN xu > 0 THEN 'reorder_surplus' ELSE 'reorder' END
    WHEN tier = 'MONITOR' THEN 'monitor'
    WHEN xw > 6 THEN 'surplus_severe' WHEN xw > 2 THEN 'surplus_high' WHEN xw > 0 THEN 'surplus_mild' ELSE 'balanced' END AS kase,
  greatest(1, CAST(round_even(greatest(rp - stock, 4 * avgd), 0) AS BIGINT)) AS emergency,
  greatest(1, CAST(round_even(greatest(rp - ip[wr] + ltd, 4 * avgd), 0) AS BIGINT)) AS orderq,
  greatest(1, wr - lead) AS order_by
FROM t_score s"""

_SEV = f"{_n0('xu')} || ' units (' || {_n1('xw')} || ' surplus weeks of demand). Evaluated against approved 8-week production forecast horizon.'"

TABLES["t_recs"] = f"""
SELECT CAST(origin_date AS VARCHAR) AS origin_date, q.SKU AS sku, m.Product_Name AS product_name, m.Category AS category, m.Subcategory AS subcategory,
  CASE split_part(kase, '_', 1) WHEN 'missing' THEN 'DATA_UNAVAILABLE' WHEN 'expedite' THEN 'EXPEDITE_PO' WHEN 'reorder' THEN 'PLACE_PO'
    WHEN 'monitor' THEN 'REVIEW_PIPELINE' WHEN 'surplus' THEN 'FREEZE_REPLENISHMENT' ELSE 'MAINTAIN_SCHEDULE' END AS recommendation_code,
  CASE split_part(kase, '_', 1) WHEN 'missing' THEN 'Inventory Snapshot Missing' WHEN 'expedite' THEN 'Expedite Inbound Shipment'
    WHEN 'reorder' THEN 'Issue Replenishment Purchase Order' WHEN 'monitor' THEN 'Review Replenishment Pipeline'
    WHEN 'surplus' THEN 'Halt Inbound Replenishment' ELSE 'Maintain Normal Schedule' END AS recommendation_title,
  CASE kase
    WHEN 'missing' THEN 'Request immediate physical cycle count or verify ERP snapshot synchronization. Operational replenishment risk cannot be evaluated without stock observations.'
    WHEN 'expedite_open' THEN 'Expedite existing inbound purchase order of ' || {_n0('oo')} || ' units immediately or arrange emergency split-shipment. Physical stock of ' || {_n0('stock')} || ' units will be depleted in week ' || w0 || '.'
    WHEN 'expedite_new' THEN 'Issue emergency purchase order for ~' || emergency || ' units with air/priority freight. Zero inbound orders exist and physical stock of ' || {_n0('stock')} || ' units exhausts in week ' || w0 || '.'
    WHEN 'reorder_surplus' THEN 'Issue a calibrated replenishment order for ~' || orderq || ' units to protect week ' || wr || ' Reorder Point breach. Note: Long-horizon inventory indicates ' || {_n1('xw')} || ' weeks of terminal surplus; do not exceed required batch size.'
    WHEN 'reorder' THEN 'Place replenishment purchase order for ~' || orderq || ' units. Target supplier delivery on or before week ' || wr || '.'
    WHEN 'monitor' THEN 'Prepare replenishment purchase order for week ' || order_by || '. Current pipeline is adequate through week ' || (wr - 1) || ', with Reorder Point breach projected in week ' || wr || '.'
    WHEN 'surplus_severe' THEN 'FREEZE REPLENISHMENT: Severe overstock detected (' || {_n0('xu')} || ' excess units, ' || {_n1('xw')} || ' weeks of cover above safety buffer). Suspend all new purchase orders for ' || CAST(ceil(xw) AS BIGINT) || ' weeks. Evaluate immediate promotional markdowns, bundle offers, or stock transfers.'
    WHEN 'surplus_high' THEN 'Pause purchase orders for ' || CAST(ceil(xw) AS BIGINT) || ' weeks. Total pipeline provides ' || {_n1('woc')} || ' weeks of cover (' || {_n0('xu')} || ' units surplus above 8-week horizon).'
    WHEN 'surplus_mild' THEN 'Elevated stock: pipeline holds ' || {_n0('xu')} || ' units (' || {_n1('xw')} || ' weeks) above 8-week horizon target. Defer upcoming order placements.'
    ELSE 'Inventory coverage is well-balanced across the 8-week horizon (' || {_n1('woc')} || ' weeks of cover). No supply chain intervention required.' END AS recommended_action,
  CASE kase WHEN 'missing' THEN '0 — UNKNOWN' WHEN 'expedite_open' THEN '1 — CRITICAL' WHEN 'expedite_new' THEN '1 — CRITICAL' WHEN 'reorder_surplus' THEN '2 — HIGH'
    WHEN 'reorder' THEN '2 — HIGH' WHEN 'monitor' THEN '3 — MEDIUM' WHEN 'surplus_severe' THEN '3 — MEDIUM' WHEN 'surplus_high' THEN '4 — LOW'
    WHEN 'surplus_mild' THEN '4 — LOW' ELSE '5 — INFORMATIONAL' END AS priority,
  CAST(CASE kase WHEN 'missing' THEN 0 WHEN 'expedite_open' THEN 1 WHEN 'expedite_new' THEN 1 WHEN 'reorder_surplus' THEN 2 WHEN 'reorder' THEN 2
    WHEN 'monitor' THEN 3 WHEN 'surplus_severe' THEN 3 WHEN 'surplus_high' THEN 4 WHEN 'surplus_mild' THEN 4 ELSE 5 END AS INTEGER) AS priority_rank,
  CASE kase
    WHEN 'missing' THEN 'No inventory snapshot was recorded at or before origin date ' || origin_date || '.'
    WHEN 'expedite_open' THEN 'Projected inventory position drops to ' || {_n0('ip0')} || ' units (stockout) in week ' || w0 || ', which is within the supplier lead time of ' || {_n0('lt')} || ' days. Open orders exist but require delivery acceleration.'
    WHEN 'expedite_new' THEN 'Stockout projected in week ' || w0 || ' (' || {_n0('ip0')} || ' units balance) within lead time of ' || {_n0('lt')} || ' days with no open replenishment orders in the pipeline.'
    WHEN 'reorder_surplus' THEN 'Inventory position breaches Reorder Point (' || {_n0('rp')} || ' units) in week ' || wr || ' (lead time is ' || {_n0('lt')} || ' days). Reorder takes strict precedence over terminal surplus to prevent intermediate stockout.'
    WHEN 'reorder' THEN 'Projected inventory position (' || {_n0('ipr')} || ' units) breaches Reorder Point (' || {_n0('rp')} || ' units) in week ' || wr || ', inside the supplier lead time window of ' || {_n0('lt')} || ' days.'
    WHEN 'monitor' THEN 'Inventory position remains above Reorder Point during immediate lead time, but declines to ' || {_n0('ipr')} || ' units (below Reorder Point of ' || {_n0('rp')} || ' units) in week ' || wr || '.'
    WHEN 'balanced' THEN 'Projected inventory position remains above Reorder Point throughout planning horizon and clears naturally without excess stock.'
    ELSE 'Projected inventory position at horizon h=8 exceeds required safety stock by ' || {_SEV} END AS rationale,
  CASE split_part(kase, '_', 1) WHEN 'missing' THEN 'MISSING_INVENTORY_DATA' WHEN 'expedite' THEN 'STOCKOUT_IMMINENT' WHEN 'reorder' THEN 'REORDER_POINT_BREACH_LT'
    WHEN 'monitor' THEN 'REORDER_POINT_BREACH_HORIZON' WHEN 'surplus' THEN 'EXCESS_INVENTORY' ELSE 'NONE' END AS triggering_risk,
  CASE WHEN snap IS NULL THEN 'NO_DATA' WHEN origin_date - snap <= 14 THEN 'HIGH_CONFIDENCE' WHEN origin_date - snap <= 28 THEN 'MEDIUM_CONFIDENCE'
    ELSE 'DEGRADED_CONFIDENCE' END AS confidence_status,
  CASE kase WHEN 'missing' THEN 'Contact inventory accounting to restore automated snapshot synchronization.'
    WHEN 'expedite_open' THEN 'Contact supplier within 24 hours to expedite shipment and obtain tracking confirmation.'
    WHEN 'expedite_new' THEN 'Contact supplier within 24 hours to expedite shipment and obtain tracking confirmation.'
    WHEN 'reorder_surplus' THEN 'Create purchase order requisition and transmit to vendor within 48 hours.'
    WHEN 'reorder' THEN 'Create purchase order requisition and transmit to vendor within 48 hours.'
    WHEN 'monitor' THEN 'Review open purchase order ETAs during weekly inventory planning meeting.'
    WHEN 'surplus_severe' THEN 'Escalate to merchandise planning for promotional markdown or supplier return assessment.'
    WHEN 'surplus_high' THEN 'Monitor weekly demand consumption and confirm no automated replenishment POs are released.'
    WHEN 'surplus_mild' THEN 'Review inventory position at next monthly snapshot.'
    ELSE 'Continue weekly forecast and sales monitoring.' END AS required_follow_up,
  stock AS current_stock, oo AS on_order, lt AS lead_time_days, ss AS safety_stock, rp AS reorder_point, avgd AS avg_weekly_demand,
  CASE WHEN isinf(woc) THEN 999 ELSE woc END AS weeks_of_cover, xw AS excess_weeks_of_cover, CAST(wr AS INTEGER) AS earliest_breach_week,
  CAST(w0 AS INTEGER) AS earliest_stockout_week, CAST(CAST(origin_date + CAST(7 * w0 AS INTEGER) AS DATE) AS VARCHAR) AS projected_stockout_date,
  false AS valuation_basis_confirmed, false AS arrival_timing_confirmed, 'Policy_B_LT' AS on_order_policy, 8 AS overstock_threshold_weeks,
  'ENGINEERING_RECOMMENDATION_PENDING_BUSINESS_APPROVAL' AS overstock_threshold_status, true AS monetary_valuation_blocked
FROM t_qty q JOIN t_nmaster m ON q.SKU = m.SKU"""

TABLES["t_last"] = "SELECT * FROM t_recs WHERE origin_date = (SELECT max(origin_date) FROM t_recs)"

# The run that chooses among the baselines: the same chain of tables over the chosen forecasts of the last origin.
TABLES["t_archat"] = f"""
SELECT horizon, min_by(model, {{'w': WAPE, 'r': list_position(['seasonal_naive', 'naive', 'ma4', 'ma8', 'ses'], model)}}) AS selected_model,
  min(WAPE) AS validation_micro_wape, max(WAPE) FILTER (model = 'seasonal_naive') AS benchmark_wape
FROM (SELECT model, horizon, {METRICS} FROM t_fc, (SELECT max(forecast_origin) AS o FROM t_origins)
  WHERE actual IS NOT NULL AND forecast_origin < o AND target_week <= o GROUP BY 1, 2) GROUP BY horizon"""
TABLES["t_hyb"] = """
SELECT f.* FROM t_fc f JOIN t_archat a ON f.horizon = a.horizon AND f.model = a.selected_model
WHERE forecast_origin = (SELECT max(forecast_origin) FROM t_origins)"""
_CHAIN = {"t_sn": "t_hyb", "t_pos": "t_hpos", "t_score": "t_hscore", "t_risk": "t_hrisk", "t_qty": "t_hqty", "t_recs": "t_hrecs"}
for _old, _new in list(_CHAIN.items())[1:]:
    TABLES[_new] = re.sub(r"\bt_[a-z]+\b", lambda m: _CHAIN.get(m.group(), m.group()), TABLES[_old])
TABLES["t_hlast"] = "SELECT * FROM t_hrecs WHERE origin_date = (SELECT max(origin_date) FROM t_hrecs)"

TABLES["t_snapdemand"] = """
SELECT a."Date" AS Snapshot_Date, a.SKU, a.Current_Stock, a.On_Order, a.Lead_Time_Days, a.Safety_Stock, a.Reorder_Point, a.Inventory_Value,
  d.avg_demand, a.Current_Stock + a.On_Order AS "position"
FROM t_aligned a JOIN (SELECT SKU, avg(Units_Sold) AS avg_demand FROM t_weekly GROUP BY SKU) d ON a.SKU = d.SKU"""

_LAGS = ", ".join(f"lag(Units_Sold, {k - 1}) OVER w AS lag_{k}" for k in (1, 2, 3, 4, 8, 12, 13, 26, 52))
_TARGETS = ", ".join(f"lead(Units_Sold, {h}) OVER w AS target_h{h}" for h in range(1, 9))


def _full(fn: str, col: str, width: int, name: str) -> str:
    frame = f"(w ROWS {width - 1} PRECEDING)"
    return f"CASE WHEN count(*) OVER {frame} = {width} THEN {fn}({col}) OVER {frame} END AS {name}"


ROLLING = ", ".join(
    [_full("avg", "Units_Sold", k, f"rolling_mean_{k}") for k in (4, 8, 13)]
    + [_full("stddev_samp", "Units_Sold", k, f"rolling_std_{k}") for k in (4, 8)]
    + [_full("min", "Units_Sold", 4, "rolling_min_4"), _full("max", "Units_Sold", 4, "rolling_max_4")]
)
EWMA = ", ".join(
    f"list_reduce(list(CAST(Units_Sold AS DOUBLE)) OVER (w ROWS UNBOUNDED PRECEDING), lambda a, x: {1 - a:.1f} * a + {a} * x) AS {n}"
    for n, a in (("ewma_decay_03", 0.3), ("ewma_decay_01", 0.1))
)
PROMO = (
    ", ".join(f"CAST(coalesce(CASE WHEN count(*) OVER (w ROWS {k - 1} PRECEDING) = {k} THEN sum(promo_days) OVER (w ROWS {k - 1} PRECEDING) END, 0) AS BIGINT) AS promo_days_last_{k}w" for k in (4, 8))
    + ", CASE WHEN count(*) OVER (w ROWS 12 PRECEDING) = 13 THEN sum(promo_days) OVER (w ROWS 12 PRECEDING) / 91 END AS promo_intensity_last_13w, promo_active AS promo_active_last_week"
)
CALENDAR = (
    "CAST(week(week_start) AS INTEGER) AS origin_week_of_year, CAST(month(week_start) AS INTEGER) AS origin_month, "
    "CAST(quarter(week_start) AS INTEGER) AS origin_quarter, sin(2 * pi() * week(week_start) / 52.1775) AS sin_week_annual, "
    "cos(2 * pi() * week(week_start) / 52.1775) AS cos_week_annual"
)
TREND = (
    "rolling_mean_4 / (rolling_mean_8 + 0.00001) AS trend_ratio_4_8, rolling_mean_4 / (rolling_mean_13 + 0.00001) AS trend_ratio_4_13, "
    "(lag_1 - lag_4) / 3 AS demand_acceleration"
)
WINDOW = "WINDOW w AS (PARTITION BY SKU ORDER BY week_start)"
LAGS, TARGETS = _LAGS, _TARGETS

TABLES["t_price"] = """
SELECT m.SKU, m.Category, m.Subcategory, Selling_Price, ln(Selling_Price) AS log_price, Cost_Price, Gross_Margin_Per_Unit,
  Gross_Margin_Per_Unit / Selling_Price AS margin_rate, Selling_Price / med AS price_vs_category_median_ratio,
  CASE WHEN Selling_Price < 4000 THEN 'Budget' WHEN Selling_Price < 8000 THEN 'Mid-Range' ELSE 'Premium' END AS Price_Tier,
  negative_margin_flag, Launch_Date, med AS category_median_price
FROM t_nmaster m JOIN (SELECT Category, quantile_cont(Selling_Price, 0.5) AS med FROM t_nmaster GROUP BY 1) c ON m.Category = c.Category"""

TABLES["t_static"] = """
SELECT SKU, min_by(Lead_Time_Days, "Date") AS Lead_Time_Days, min_by(Safety_Stock, "Date") AS Safety_Stock, min_by(Reorder_Point, "Date") AS Reorder_Point
FROM t_aligned GROUP BY SKU"""

TABLES["t_wf"] = f"""
SELECT SKU, week_start, {_TARGETS}, {_LAGS}, {ROLLING}, {EWMA}, {PROMO}, {CALENDAR} FROM t_weekly {WINDOW}"""

TABLES["t_features"] = f"""
SELECT f.* EXCLUDE (week_start), f.week_start AS forecast_origin_date, {TREND}, a.Current_Stock AS latest_known_stock, a.On_Order AS latest_known_on_order,
  CAST(f.week_start - a.snap AS INTEGER) AS days_since_inventory_snapshot,
  CAST(coalesce(f.week_start = a.snap, false) AS INTEGER) AS has_inventory_snapshot_at_origin,
  CAST(coalesce(f.week_start - a.snap > 35, false) AS INTEGER) AS is_inventory_stale,
  a.Current_Stock / (rolling_mean_4 + 0.00001) AS stock_to_trailing_demand_ratio, s.Lead_Time_Days, s.Safety_Stock, s.Reorder_Point,
  p.* EXCLUDE (SKU, Launch_Date, category_median_price), CAST(f.week_start - p.Launch_Date AS INTEGER) AS days_since_launch
FROM t_wf f
ASOF LEFT JOIN (SELECT SKU AS k2, "Date" AS snap, Current_Stock, On_Order FROM t_aligned) a ON f.SKU = a.k2 AND f.week_start >= a.snap
LEFT JOIN t_static s ON f.SKU = s.SKU LEFT JOIN t_price p ON f.SKU = p.SKU"""

_NAME = re.compile(r"\bt_[a-z0-9]+\b")


def with_tables(body: str) -> str:
    """Prepend the referenced tables and their dependencies, in order, as materialised CTEs."""
    ordered: list[str] = []

    def add(name: str) -> None:
        if name in ordered:
            return
        for needed in dict.fromkeys(_NAME.findall(TABLES[name])):
            if needed in TABLES and needed != name:
                add(needed)
        ordered.append(name)

    for name in dict.fromkeys(_NAME.findall(body)):
        if name in TABLES:
            add(name)
    if not ordered:
        return body
    ctes = ",\n".join(f"{n} AS MATERIALIZED ({TABLES[n]})" for n in ordered)
    return f"WITH {ctes}\n{body}"
