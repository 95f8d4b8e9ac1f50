"""Registered queries: weekly panels, profile tables, features, windows, top-k."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import features as feat
from ..operators import profile, timegrid
from ..operators.metrics import residual_histogram
from ..operators.ordered import rank_min
from . import oracle_tables as o
from .registry import query


@query("weekly_panel", "SELECT * FROM t_weekly0")
def _(c):
    return timegrid.weekly_panel(c.sales)


@query("weekly_demand_meta", "SELECT w.SKU, week_start, Units_Sold, Category, Subcategory, Intermittency_Class FROM t_weekly w LEFT JOIN t_meta m ON w.SKU = m.SKU")
def _(c):
    return c.weekly_meta


_ISO = """SELECT SKU, CAST(isoyear("Date") AS INTEGER) AS iso_year, CAST(week("Date") AS INTEGER) AS iso_week, CAST(sum(Units_Sold) AS BIGINT) AS Weekly_Units,
    count("Date") AS Days_Count, CAST(sum(Promotion) AS BIGINT) AS Active_Promo_Days FROM t_sales GROUP BY 1, 2, 3"""


@query("weekly_iso", _ISO)
def _(c):
    return timegrid.weekly_iso(c.sales)


@query("weekly_label_monday", f"""SELECT SKU, {o.week('"Date"')} + 6 AS "Date", CAST(sum(Units_Sold) AS BIGINT) AS Units_Sold FROM t_sales GROUP BY 1, 2""")
def _(c):
    return timegrid.weekly_label(c.sales)


@query("panel_fill", "SELECT * FROM t_dfill", "Revenue:2")
def _(c):
    return c.daily_filled


@query("panel_fill_weekly", "SELECT * FROM t_weekly")
def _(c):
    return c.weekly


@query(
    "panel_flag_gaps",
    """SELECT SKU, count(*) AS periods, CAST(max("Date") - min("Date") + 1 - count(*) AS BIGINT) AS inner_gaps,
    CAST((SELECT max("Date") - min("Date") + 1 FROM t_sales) - count(*) AS BIGINT) AS missing_periods FROM t_sales GROUP BY SKU""",
)
def _(c):
    return timegrid.flag_gaps(c.sales, "Date")


@query(
    "panel_interpolate",
    """SELECT k.SKU, g.week_start, s.Units_Sold IS NULL AS is_filled, CASE WHEN s.Units_Sold IS NOT NULL THEN s.Units_Sold WHEN p.y IS NULL THEN n.y WHEN n.y IS NULL THEN p.y
      ELSE p.y + (n.y - p.y) * (CAST(g.week_start - p.d AS DOUBLE) / (n.d - p.d)) END AS Units_Sold
    FROM (SELECT DISTINCT SKU FROM t_weekly0) k CROSS JOIN t_weeks g LEFT JOIN t_weekly0 s ON s.SKU = k.SKU AND s.week_start = g.week_start
    ASOF LEFT JOIN (SELECT SKU, week_start AS d, CAST(Units_Sold AS DOUBLE) AS y FROM t_weekly0) p ON p.SKU = k.SKU AND g.week_start >= p.d
    ASOF LEFT JOIN (SELECT SKU, week_start AS d, CAST(Units_Sold AS DOUBLE) AS y FROM t_weekly0) n ON n.SKU = k.SKU AND g.week_start <= n.d""",
    "Units_Sold",
)
def _(c):
    weekly = timegrid.weekly_panel(c.sales).select("SKU", "week_start", "Units_Sold")
    return timegrid.panel_fill(weekly, "week_start", ["Units_Sold"], 7, policy="interpolate", bounds=timegrid.week_span(c.days))


# --- profile -----------------------------------------------------------------------------------------


@query(
    "profile_dataset",
    """SELECT metric, CAST(value AS DOUBLE) AS value FROM (SELECT unnest([
      {'metric': 'rows', 'value': n}, {'metric': 'columns', 'value': 6}, {'metric': 'unique_skus', 'value': k}, {'metric': 'unique_dates', 'value': d},
      {'metric': 'date_min_epoch_day', 'value': lo}, {'metric': 'date_max_epoch_day', 'value': hi}, {'metric': 'expected_panel_rows', 'value': k * d},
      {'metric': 'is_complete_panel', 'value': CAST(k * d = n AS BIGINT)}, {'metric': 'duplicate_grain_count', 'value': 0}, {'metric': 'null_Date', 'value': 0},
      {'metric': 'null_SKU', 'value': 0}, {'metric': 'null_Units_Sold', 'value': 0}, {'metric': 'null_Revenue', 'value': 0}, {'metric': 'null_Price', 'value': 0},
      {'metric': 'null_Promotion', 'value': 0}], recursive := true)
    FROM (SELECT count(*) AS n, count(DISTINCT SKU) AS k, count(DISTINCT "Date") AS d, min("Date") - DATE '1970-01-01' AS lo, max("Date") - DATE '1970-01-01' AS hi FROM t_sales))""",
)
def _(c):
    return profile.profile_dataset(c.sales)


@query(
    "demand_distribution",
    """SELECT CAST(sum(Units_Sold) AS BIGINT) AS total_units, avg(Units_Sold) AS mean, stddev_samp(Units_Sold) AS std, min(Units_Sold) AS "min", max(Units_Sold) AS "max",
    skewness(Units_Sold) AS skewness, kurtosis(Units_Sold) AS kurtosis, count(*) FILTER (Units_Sold = 0) AS zero_demand_count,
    count(*) FILTER (Units_Sold = 0) / count(*) * 100 AS zero_demand_pct, stddev_samp(Units_Sold) / avg(Units_Sold) AS cv,
    quantile_cont(Units_Sold, 0.01) AS q01, quantile_cont(Units_Sold, 0.05) AS q05, quantile_cont(Units_Sold, 0.1) AS q10, quantile_cont(Units_Sold, 0.25) AS q25,
    quantile_cont(Units_Sold, 0.5) AS q50, quantile_cont(Units_Sold, 0.75) AS q75, quantile_cont(Units_Sold, 0.9) AS q90, quantile_cont(Units_Sold, 0.95) AS q95,
    quantile_cont(Units_Sold, 0.99) AS q99, median(Units_Sold) AS median FROM t_dfill""",
    "mean std skewness kurtosis zero_demand_pct cv q01 q05 q10 q25 q50 q75 q90 q95 q99 median",
)
def _(c):
    return profile.demand_distribution(c.daily_filled)


@query(
    "sku_demand_profile",
    """SELECT i.* EXCLUDE (CV, Total_Revenue), round(CV, 3) AS CV, round(Total_Revenue, 2) AS Total_Revenue, Product_Name, Category, Subcategory, Selling_Price, Cost_Price,
      negative_margin_flag, rank() OVER (ORDER BY Total_Units_Sold DESC) AS Volume_Rank, rank() OVER (ORDER BY round(Total_Revenue, 2) DESC) AS Revenue_Rank,
      rank() OVER (ORDER BY round(CV, 3) DESC) AS Variability_Rank FROM t_items i LEFT JOIN t_nmaster m ON i.SKU = m.SKU""",
    "Mean_Daily_Demand Std_Daily_Demand Zero_Demand_Pct ADI CV2 CV:3 Total_Revenue:2 Median_Daily_Demand",
)
def _(c):
    return profile.sku_demand_profile(c.daily_filled, c.norm_master)


@query("intermittency_class", "SELECT SKU, ADI, CV2, Intermittency_Class FROM t_items", "ADI CV2")
def _(c):
    return profile.item_demand(c.daily_filled).select("SKU", "ADI", "CV2", "Intermittency_Class")


_LUMPY = f"""SELECT SKU, ADI, CV2, CASE WHEN ADI < 1.32 AND CV2 < 0.49 THEN 'Smooth' WHEN ADI >= 1.32 AND CV2 < 0.49 THEN 'Intermittent'
    WHEN ADI < 1.32 AND CV2 >= 0.49 THEN 'Erratic' ELSE 'Lumpy' END AS Intermittency_Class FROM (
    SELECT SKU, CAST((SELECT hi - lo + 1 FROM ({o.SPAN})) AS DOUBLE) / count(*) AS ADI, pow(coalesce(stddev_samp(u), 0) / avg(u), 2) AS CV2
    FROM (SELECT l_partkey AS SKU, CAST(sum(l_quantity) AS BIGINT) AS u FROM lineitem GROUP BY l_partkey, CAST(l_shipdate AS DATE)) GROUP BY SKU)"""


@query("intermittency_class_parts", _LUMPY, "ADI CV2")
def _(c):
    """Sparse series by part: the gaps are counted, not filled."""
    day = c.lineitem.groupBy(F.col("l_partkey").alias("SKU"), F.col("l_shipdate").cast("date").alias("Date")).agg(F.sum("l_quantity").alias("u"))
    days = c.days.select(F.datediff("hi", "lo") + 1).scalar()
    spread = F.coalesce(F.stddev_samp("u"), F.lit(0.0))
    stats = day.groupBy("SKU").agg(F.count(F.lit(1)).alias("n"), F.pow(spread / F.avg("u"), F.lit(2.0)).alias("CV2"))
    adi = days.cast("double") / F.col("n")
    return stats.select("SKU", adi.alias("ADI"), "CV2", profile.intermittency_class(adi, F.col("CV2")).alias("Intermittency_Class"))


_STATS = """count(*) AS Observations, CAST(sum(Units_Sold) AS BIGINT) AS Total_Units, avg(Units_Sold) AS Mean_Units, median(Units_Sold) AS Median_Units,
    stddev_samp(Units_Sold) AS Std_Units, sum(Units_Sold) / (SELECT sum(Units_Sold) FROM t_panel) * 100 AS Share_Pct FROM t_panel GROUP BY 1, 2"""


@query(
    "temporal_patterns",
    " UNION ALL ".join(
        f"SELECT '{d}' AS \"Dimension\", {e} AS Level, {_STATS}"
        for d, e in {
            "Day_of_Week": "day_of_week", "Weekend": "CASE WHEN is_weekend = 1 THEN 'Weekend' ELSE 'Weekday' END",
            "Month": "'Month_' || lpad(CAST(\"month\" AS VARCHAR), 2, '0')", "Quarter": '"quarter"', "Year": 'CAST("year" AS VARCHAR)', "Season": "season",
        }.items()
    ),
    "Mean_Units Median_Units Std_Units Share_Pct",
)
def _(c):
    return profile.temporal_patterns(c.panel)


@query(
    "weekly_vs_daily_snr",
    f"""SELECT grain, count(*) AS observations, avg(u) AS mean, count(*) FILTER (u = 0) / count(*) * 100 AS zero_pct, stddev_samp(u) / avg(u) AS cv,
    avg(u) / stddev_samp(u) AS signal_to_noise FROM (SELECT 'daily' AS grain, Units_Sold AS u FROM t_sales UNION ALL SELECT 'weekly', Weekly_Units FROM ({_ISO})) GROUP BY grain""",
    "mean zero_pct cv signal_to_noise",
)
def _(c):
    return profile.weekly_vs_daily_snr(c.sales)


@query(
    "category_summary",
    """SELECT Category, Subcategory, count(DISTINCT SKU) AS SKU_Count, CAST(sum(Units_Sold) AS BIGINT) AS Total_Units, avg(Units_Sold) AS Mean_Daily_Units,
    stddev_samp(Units_Sold) AS Std_Daily_Units, round(sum(Revenue), 2) AS Total_Revenue, avg(Price) AS Mean_Price,
    sum(Units_Sold) / (SELECT sum(Units_Sold) FROM t_panel) * 100 AS Volume_Share_Pct, round(sum(Revenue), 2) / (SELECT sum(Revenue) FROM t_panel) * 100 AS Revenue_Share_Pct,
    stddev_samp(Units_Sold) / avg(Units_Sold) AS CV FROM t_panel GROUP BY 1, 2""",
    "Mean_Daily_Units Std_Daily_Units Total_Revenue:2 Mean_Price Volume_Share_Pct Revenue_Share_Pct CV",
)
def _(c):
    return profile.category_summary(c.panel)


_PROMO = """count(*) AS Observations, CAST(sum(Units_Sold) AS BIGINT) AS Total_Units, avg(Units_Sold) AS Mean_Daily_Units, median(Units_Sold) AS Median_Daily_Units,
    stddev_samp(Units_Sold) AS Std_Daily_Units, count(*) FILTER (Units_Sold = 0) / count(*) * 100 AS Zero_Demand_Pct FROM t_panel GROUP BY 1, 2"""


@query(
    "promotion_lift",
    f"""SELECT Scope, CASE WHEN p = 1 THEN 'Promotion (1)' ELSE 'No Promotion (0)' END AS "Group", Observations, Total_Units, Mean_Daily_Units, Median_Daily_Units,
    Std_Daily_Units, Zero_Demand_Pct, CASE WHEN p = 0 THEN 0 ELSE (Mean_Daily_Units - b) / b * 100 END AS Promotional_Lift_Pct
    FROM (SELECT *, max(CASE WHEN p = 0 THEN Mean_Daily_Units END) OVER (PARTITION BY Scope) AS b FROM (
      SELECT 'Global' AS Scope, Promotion AS p, {_PROMO} UNION ALL SELECT 'Category_' || Category, Promotion, {_PROMO}))""",
    "Mean_Daily_Units Median_Daily_Units Std_Daily_Units Zero_Demand_Pct Promotional_Lift_Pct",
)
def _(c):
    return profile.promotion_lift(c.panel)


@query(
    "price_demand",
    """SELECT p.*, CASE WHEN Price <= lo THEN 'Budget' WHEN Price <= hi THEN 'Mid-Range' ELSE 'Premium' END AS Price_Tier FROM (
      SELECT SKU, Category, max(Selling_Price) AS Price, avg(Units_Sold) AS Mean_Daily_Units, CAST(sum(Units_Sold) AS BIGINT) AS Total_Units_Sold,
        round(sum(Revenue), 2) AS Total_Revenue FROM t_panel GROUP BY 1, 2) p
    CROSS JOIN (SELECT quantile_cont(Selling_Price, 0.33) AS lo, quantile_cont(Selling_Price, 0.66) AS hi FROM t_master) q""",
    "Mean_Daily_Units Total_Revenue:2",
)
def _(c):
    return profile.price_demand(c.panel)


@query(
    "demand_outliers",
    """SELECT p."Date", SKU, Product_Name, Category, Units_Sold, Price, Revenue, Promotion, is_holiday, holiday, promotion_event,
    CASE WHEN r = '' THEN 'Unexplained_Demand_Surge (Review Required)' ELSE 'Legitimate_Event (' || r || ')' END AS Context_Classification
    FROM (SELECT *, concat_ws('; ', CASE WHEN Promotion = 1 THEN 'Active_Promotion' END, CASE WHEN is_holiday = 1 THEN 'Holiday_' || holiday END,
      CASE WHEN is_weekend = 1 THEN 'Weekend' END, 'Event_' || promotion_event) AS r FROM t_panel) p
    CROSS JOIN (SELECT quantile_cont(Units_Sold, 0.25) AS q1, quantile_cont(Units_Sold, 0.75) AS q3, avg(Units_Sold) + 3.5 * stddev_samp(Units_Sold) AS z FROM t_panel) q
    WHERE Units_Sold >= q3 + 3 * (q3 - q1) OR Units_Sold >= z""",
)
def _(c):
    return profile.demand_outliers(c.panel)


@query(
    "inventory_coverage",
    """SELECT 'Master_Aligned_Panel' AS Dataset_Layer, count(*) AS Total_Rows, count(DISTINCT SKU) AS Unique_SKUs, count(*) FILTER (has_inventory_snapshot) AS Snapshot_Observations,
    count(*) FILTER (has_inventory_snapshot) / count(*) * 100 AS Snapshot_Coverage_Pct, avg(Current_Stock) AS Mean_Current_Stock, avg(On_Order) AS Mean_On_Order,
    avg(Inventory_Value) AS Mean_Inventory_Value, median(Current_Stock) AS Median_Current_Stock FROM t_panel
    UNION ALL SELECT 'Inventory_Quarantine', count(*), count(DISTINCT SKU), count(*), 100, avg(Current_Stock), avg(On_Order), avg(Inventory_Value), median(Current_Stock) FROM t_quarantine""",
    "Snapshot_Coverage_Pct Mean_Current_Stock Mean_On_Order Mean_Inventory_Value:2 Median_Current_Stock",
)
def _(c):
    return profile.inventory_coverage(c.panel, c.quarantine)


@query(
    "daily_total_ma",
    """SELECT "Date", u AS Units_Sold, avg(u) OVER (ORDER BY "Date" ROWS 6 PRECEDING) AS ma_7, avg(u) OVER (ORDER BY "Date" ROWS 29 PRECEDING) AS ma_30
    FROM (SELECT "Date", CAST(sum(Units_Sold) AS BIGINT) AS u FROM t_sales GROUP BY 1)""",
    "ma_7 ma_30",
)
def _(c):
    return profile.daily_total_ma(c.sales)


@query("monthly_total", 'SELECT CAST(date_trunc(\'month\', "Date") AS DATE) AS "month", CAST(sum(Units_Sold) AS BIGINT) AS Units_Sold FROM t_sales GROUP BY 1')
def _(c):
    return profile.monthly_total(c.sales)


@query("year_month_mean", 'SELECT "year", "month", avg(Units_Sold) AS mean_units FROM t_panel GROUP BY 1, 2', "mean_units")
def _(c):
    return profile.year_month_mean(c.panel)


@query("category_totals", "SELECT Category, CAST(sum(Units_Sold) AS BIGINT) AS Units_Sold FROM t_panel GROUP BY 1")
def _(c):
    return profile.category_totals(c.panel)


@query("iso_week_total", f"SELECT iso_year, iso_week, CAST(sum(Weekly_Units) AS BIGINT) AS Weekly_Units FROM ({_ISO}) GROUP BY 1, 2")
def _(c):
    return profile.iso_week_total(c.sales)


# All columns of the feature table, by kind.
_DOUBLES = (
    "Cost_Price Gross_Margin_Per_Unit Lead_Time_Days Reorder_Point Safety_Stock Selling_Price cos_week_annual demand_acceleration ewma_decay_01"
    " ewma_decay_03 latest_known_on_order latest_known_stock log_price margin_rate price_vs_category_median_ratio promo_intensity_last_13w"
    " rolling_mean_13 rolling_mean_4 rolling_mean_8 rolling_std_4 rolling_std_8 sin_week_annual stock_to_trailing_demand_ratio trend_ratio_4_13"
    " trend_ratio_4_8"
).split()
_WHOLE = (
    "target_h1 target_h2 target_h3 target_h4 target_h5 target_h6 target_h7 target_h8 days_since_inventory_snapshot days_since_launch"
    " has_inventory_snapshot_at_origin is_inventory_stale lag_1 lag_12 lag_13 lag_2 lag_26 lag_3 lag_4 lag_52 lag_8 origin_month origin_quarter"
    " origin_week_of_year promo_active_last_week promo_days_last_4w promo_days_last_8w rolling_max_4 rolling_min_4"
).split()
_OTHERS = "SKU forecast_origin_date Category Price_Tier Subcategory negative_margin_flag".split()
# Distinct values are counted at six digits, off the borders that decimal weights end on.
_OFF = 3.7e-8


def _distinct_sql(x: str) -> str:
    return f"round({x} + {_OFF!r}, 6)" if x in _DOUBLES else x


@query(
    "feature_statistics",
    " UNION ALL ".join(
        f"SELECT '{x}' AS feature, count(*) FILTER ({x} IS NULL) / count(*) * 100 AS null_pct, CAST(min({x}) AS DOUBLE) AS \"min\", CAST(max({x}) AS DOUBLE) AS \"max\", "
        f"avg({x}) AS mean, stddev_samp({x}) AS std, count(DISTINCT {_distinct_sql(x)}) AS distinct_values FROM t_features"
        for x in (*_DOUBLES, *_WHOLE)
    ),
    "null_pct min max mean std",
)
def _(c):
    rows = c.stored(c.features.select(*_DOUBLES, *_WHOLE))
    rounded = rows.withColumns({x: F.round(F.col(x) + _OFF, 6) for x in _DOUBLES})
    return profile.feature_statistics(rows).join(profile.distinct_counts(rounded), "feature")


_HIST = """SELECT CAST(coalesce(least(floor((x - lo) * {b} / nullif(hi - lo, 0)) + 1, {b}), 1) AS INTEGER) AS bin, count(*) AS n, min(x) AS min_value, max(x) AS max_value
    FROM (SELECT CAST({col} AS DOUBLE) AS x FROM {t} WHERE {col} IS NOT NULL) CROSS JOIN (SELECT CAST(min({col}) AS DOUBLE) AS lo, CAST(max({col}) AS DOUBLE) AS hi FROM {t}) GROUP BY 1"""


@query("demand_histogram", _HIST.format(b=40, col="Units_Sold", t="t_sales"), "min_value max_value")
def _(c):
    return profile.histogram(c.sales.select(F.col("Units_Sold").cast("double").alias("u")), "u", 40)


@query("feature_histogram", _HIST.format(b=25, col="rolling_mean_8", t="t_wf"), "min_value max_value")
def _(c):
    return profile.histogram(feat.rolling_stats(c.weekly), "rolling_mean_8", 25)


@query(
    "residual_histogram",
    """SELECT model, CAST(coalesce(least(floor((x - lo) * 40 / nullif(hi - lo, 0)) + 1, 40), 1) AS INTEGER) AS bin, count(*) AS n
    FROM (SELECT model, x, min(x) OVER (PARTITION BY model) AS lo, max(x) OVER (PARTITION BY model) AS hi FROM (
      SELECT model, actual - forecast AS x FROM t_fc WHERE actual IS NOT NULL)) GROUP BY 1, 2""",
)
def _(c):
    return residual_histogram(c.forecasts)


@query(
    "lag_correlation",
    "SELECT a.l AS lag_a, b.l AS lag_b, corr(a.v, b.v) AS r FROM (UNPIVOT (SELECT SKU, forecast_origin_date, "
    + ", ".join(f"CAST(lag_{k} AS DOUBLE) AS lag_{k}" for k in feat.LAGS)
    + " FROM t_features) ON COLUMNS('lag_.*') INTO NAME l VALUE v) a JOIN (UNPIVOT (SELECT SKU, forecast_origin_date, "
    + ", ".join(f"CAST(lag_{k} AS DOUBLE) AS lag_{k}" for k in feat.LAGS)
    + " FROM t_features) ON COLUMNS('lag_.*') INTO NAME l VALUE v) b ON a.SKU = b.SKU AND a.forecast_origin_date = b.forecast_origin_date GROUP BY 1, 2",
    "r",
)
def _(c):
    return profile.lag_correlation(feat.demand_lags(c.weekly), [f"lag_{k}" for k in feat.LAGS])


@query(
    "null_percentage",
    " UNION ALL ".join(f"SELECT '{x}' AS feature, count(*) FILTER ({x} IS NULL) / count(*) * 100 AS null_pct FROM t_features" for x in (*_DOUBLES, *_WHOLE, *_OTHERS)),
    "null_pct",
)
def _(c):
    return profile.null_percentage(c.features)


# --- windows and features ----------------------------------------------------------------------------

_W = f"FROM t_weekly {o.WINDOW}"
_BASE = "SKU, week_start, Units_Sold, promo_days, promo_active"


@query("targets_multi_horizon", f"SELECT {_BASE}, {o.TARGETS} {_W}")
def _(c):
    return feat.targets_multi_horizon(c.weekly)


@query("demand_lags", f"SELECT {_BASE}, {o.LAGS} {_W}")
def _(c):
    return feat.demand_lags(c.weekly)


_ROLL_FLOATS = "rolling_mean_4 rolling_mean_8 rolling_mean_13 rolling_std_4 rolling_std_8"


@query("rolling_stats", f"SELECT {_BASE}, {o.ROLLING} {_W}", _ROLL_FLOATS)
def _(c):
    return feat.rolling_stats(c.weekly)


@query("ewma", f"SELECT {_BASE}, {o.EWMA} {_W}", "ewma_decay_03:6~ ewma_decay_01:6~")
def _(c):
    return feat.ewma(c.weekly)


_TREND_FLOATS = "trend_ratio_4_8 trend_ratio_4_13 demand_acceleration"


@query("trend_ratios", f"SELECT SKU, week_start, {o.TREND} FROM t_wf", _TREND_FLOATS)
def _(c):
    names = _TREND_FLOATS.split()
    return feat.trend_ratios(feat.rolling_stats(feat.demand_lags(c.weekly))).select("SKU", "week_start", *names)


@query("calendar_features", f"SELECT {_BASE}, {o.CALENDAR} FROM t_weekly", "sin_week_annual cos_week_annual")
def _(c):
    return feat.calendar_features(c.weekly)


@query("promo_features", f"SELECT {_BASE}, {o.PROMO} {_W}", "promo_intensity_last_13w")
def _(c):
    return feat.promo_features(c.weekly)


_PRICE_FLOATS = "log_price margin_rate price_vs_category_median_ratio"


@query(
    "price_features",
    f"SELECT w.*, p.* EXCLUDE (SKU, Launch_Date, category_median_price), CAST(w.week_start - Launch_Date AS INTEGER) AS days_since_launch FROM (SELECT {_BASE} FROM t_weekly) w LEFT JOIN t_price p ON w.SKU = p.SKU",
    _PRICE_FLOATS,
)
def _(c):
    return feat.price_features(c.weekly, c.norm_master)


_INV = ("latest_known_stock", "latest_known_on_order", "days_since_inventory_snapshot", "has_inventory_snapshot_at_origin", "is_inventory_stale",
        "stock_to_trailing_demand_ratio", "Lead_Time_Days", "Safety_Stock", "Reorder_Point")


@query("inventory_features", f"SELECT SKU, forecast_origin_date AS week_start, {', '.join(_INV)} FROM t_features", "stock_to_trailing_demand_ratio")
def _(c):
    return feat.inventory_features(feat.rolling_stats(c.weekly), c.snapshots).select("SKU", "week_start", *_INV)


@query(
    "inventory_features_asof",
    """SELECT w.SKU, w.week_start, a.lt AS Lead_Time_Days, a.ss AS Safety_Stock, a.rp AS Reorder_Point FROM t_weekly w
    ASOF LEFT JOIN (SELECT SKU AS k2, "Date" AS snap, Lead_Time_Days AS lt, Safety_Stock AS ss, Reorder_Point AS rp FROM t_aligned) a ON w.SKU = a.k2 AND w.week_start >= a.snap""",
)
def _(c):
    """Lead-time parameters as known at the origin instead of each item's first snapshot."""
    return feat.inventory_features(feat.rolling_stats(c.weekly), c.snapshots, static_params="asof").select(
        "SKU", "week_start", "Lead_Time_Days", "Safety_Stock", "Reorder_Point"
    )


_FEATURE_FLOATS = f"{_ROLL_FLOATS} {_TREND_FLOATS} {_PRICE_FLOATS} ewma_decay_03:6~ ewma_decay_01:6~ sin_week_annual cos_week_annual promo_intensity_last_13w stock_to_trailing_demand_ratio"


@query("feature_table", "SELECT * FROM t_features", _FEATURE_FLOATS)
def _(c):
    return c.features


@query("feature_table_valid", "SELECT * FROM t_features WHERE lag_52 IS NOT NULL AND target_h8 IS NOT NULL", _FEATURE_FLOATS)
def _(c):
    return feat.valid_rows(c.features)


@query("rank_min", "SELECT SKU, u AS Total_Units, rank() OVER (ORDER BY u DESC) AS Volume_Rank FROM (SELECT SKU, CAST(sum(Units_Sold) AS BIGINT) AS u FROM t_sales GROUP BY SKU)")
def _(c):
    totals = c.sales.groupBy("SKU").agg(F.sum("Units_Sold").cast("bigint").alias("Total_Units"))
    return rank_min(totals, {"Total_Units": "Volume_Rank"})


@query(
    "moving_avg_partial",
    'SELECT SKU, "Date", Units_Sold, avg(Units_Sold) OVER (PARTITION BY SKU ORDER BY "Date" ROWS 13 PRECEDING) AS ma_14 FROM t_sales',
    "ma_14",
)
def _(c):
    w = W.partitionBy("SKU").orderBy("Date")
    return c.sales.select("SKU", "Date", "Units_Sold", feat.moving_avg_partial("Units_Sold", 14, w).alias("ma_14"))


# --- top-k -------------------------------------------------------------------------------------------

_TOTALS = "(SELECT SKU, CAST(sum(Units_Sold) AS BIGINT) AS Total_Units FROM t_sales GROUP BY SKU)"


@query(
    "topk_sku_volume",
    f"SELECT *, 'top' AS side FROM (SELECT * FROM {_TOTALS} ORDER BY Total_Units DESC, SKU LIMIT 15) UNION ALL SELECT *, 'bottom' FROM (SELECT * FROM {_TOTALS} ORDER BY Total_Units, SKU LIMIT 15)",
)
def _(c):
    return profile.topk_sku_volume(c.sales)


@query(
    "representative_skus",
    """SELECT 'highest_volume' AS role, (SELECT SKU FROM t_items ORDER BY Total_Units_Sold DESC, SKU LIMIT 1) AS SKU
    UNION ALL SELECT 'mid_volume', (SELECT SKU FROM t_items ORDER BY Total_Units_Sold DESC, SKU LIMIT 1 OFFSET 24)
    UNION ALL SELECT 'most_variable', (SELECT SKU FROM t_items ORDER BY round(CV, 9) DESC, SKU LIMIT 1)
    UNION ALL SELECT 'lowest_volume', (SELECT SKU FROM t_items ORDER BY Total_Units_Sold, SKU LIMIT 1)""",
)
def _(c):
    return profile.representative_skus(c.daily_filled)
