"""Lazily built inputs and intermediate tables of one star-schema directory."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import decide, features, forecast, prepare, profile, risk, timegrid
from ..sources import star
from ..sources.checkpoints import work_dir


__all__ = ["Context", "work_dir"]


class Context:
    """Every attribute is a DataFrame, built when it is first asked for; tables with exact quantiles checkpoint value counts."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return star.read_star(self.spark, self.sf_dir, name)

    @cached_property
    def lineitem(self) -> DataFrame:
        return self.table("lineitem")

    @cached_property
    def supplier(self) -> DataFrame:
        return self.table("supplier")

    @cached_property
    def days(self) -> DataFrame:
        """First and last day of the data, read from column statistics where the format keeps them."""
        return star.ship_span(self.lineitem)

    @cached_property
    def sales(self) -> DataFrame:
        return star.sales_daily(self.lineitem)

    @cached_property
    def master(self) -> DataFrame:
        return star.sku_master(self.lineitem, self.supplier, self.table("nation"), self.table("region"))

    @cached_property
    def calendar(self) -> DataFrame:
        return star.calendar(self.lineitem)

    @cached_property
    def inventory(self) -> DataFrame:
        return star.inventory_snapshots(self.lineitem, self.supplier)

    @cached_property
    def norm_sales(self) -> DataFrame:
        return prepare.normalize_sales(self.sales)

    @cached_property
    def norm_master(self) -> DataFrame:
        return prepare.normalize_sku_master(self.master)

    @cached_property
    def norm_calendar(self) -> DataFrame:
        return prepare.normalize_calendar(self.calendar)

    @cached_property
    def _split(self) -> tuple[DataFrame, DataFrame]:
        return prepare.normalize_inventory(self.inventory, self.norm_master)

    @property
    def aligned(self) -> DataFrame:
        return self._split[0]

    @property
    def quarantine(self) -> DataFrame:
        return self._split[1]

    @cached_property
    def panel(self) -> DataFrame:
        return prepare.integrate_daily_panel(self.norm_sales, self.norm_master, self.norm_calendar, self.aligned)

    @cached_property
    def daily_filled(self) -> DataFrame:
        day = self.sales.select("SKU", "Date", "Units_Sold", "Revenue", "Promotion")
        return timegrid.panel_fill(day, "Date", ["Units_Sold", "Revenue", "Promotion"], 1, bounds=self.days)

    @cached_property
    def weekly(self) -> DataFrame:
        return timegrid.weekly_filled(self.sales, days=self.days)

    @cached_property
    def item_class(self) -> DataFrame:
        # Filling the gaps would only add zeros, so the classes come from the sales rows and the number of days.
        periods = self.days.select(F.datediff("hi", "lo") + 1).scalar()
        classes = profile.sparse_classes(self.sales, periods).select("SKU", "Intermittency_Class")
        return classes.join(self.norm_master.select("SKU", "Category", "Subcategory"), "SKU", "left")

    def stored(self, df: DataFrame) -> DataFrame:
        """``df`` written once to the shared folder and read back: for derived inputs that several checks read."""
        path = f"{work_dir(self.spark)}/stored"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    @cached_property
    def weekly_meta(self) -> DataFrame:
        return timegrid.weekly_demand_meta(self.weekly, self.item_class)

    @cached_property
    def origins(self) -> DataFrame:
        # The calendar's first and last week are those of the grid, so no panel is built to find them.
        return forecast.rolling_origins(timegrid.week_span(self.days).select(F.explode(F.array("lo", "hi")).alias("week_start")))

    @cached_property
    def forecasts(self) -> DataFrame:
        """All five baselines at every origin."""
        return forecast.baseline_forecasts(self.weekly, self.origins)

    @cached_property
    def forecasts_meta(self) -> DataFrame:
        return self.forecasts.join(self.item_class, "SKU", "left")

    @cached_property
    def seasonal(self) -> DataFrame:
        return forecast.baseline_forecasts(self.weekly, self.origins, ["seasonal_naive"])

    @cached_property
    def snapshots(self) -> DataFrame:
        return self.aligned.withColumnRenamed("Date", "snapshot_date").drop(
            "inventory_master_match_flag", "inventory_quarantine_flag"
        )

    @cached_property
    def features(self) -> DataFrame:
        return features.feature_table(self.sales, self.norm_master, self.snapshots, days=self.days)

    @cached_property
    def scaffold(self) -> DataFrame:
        return timegrid.scaffold_origin_sku(
            self.norm_master, self.origins.withColumnRenamed("forecast_origin", "origin_date")
        )

    @cached_property
    def origin_snapshots(self) -> DataFrame:
        return self.aligned.withColumnRenamed("Date", "Snapshot_Date")

    @cached_property
    def positions(self) -> DataFrame:
        """Projected positions of every (origin, item)."""
        return risk.positions(self.scaffold, risk.normalize_forecast_layout(self.seasonal), self.origin_snapshots)

    @cached_property
    def risk(self) -> DataFrame:
        return risk.risk_scores(self.scaffold, self.seasonal, self.origin_snapshots)

    @cached_property
    def latest_risk(self) -> DataFrame:
        return forecast.latest_origin_rows(self.risk, "origin_date")

    @cached_property
    def recs(self) -> DataFrame:
        return decide.recommendations(self.risk, self.norm_master)

    @cached_property
    def latest_recs(self) -> DataFrame:
        """Recommendations of the last origin, planned for that origin alone."""
        return decide.recommendations(self._last_risk, self.norm_master)

    @cached_property
    def last_origin(self) -> DataFrame:
        return self.origins.agg(F.max("forecast_origin").alias("forecast_origin"))

    @cached_property
    def last_seasonal(self) -> DataFrame:
        return forecast.baseline_forecasts(self.weekly, self.last_origin, ["seasonal_naive"])

    @cached_property
    def _last_risk(self) -> DataFrame:
        scaffold = timegrid.scaffold_origin_sku(
            self.norm_master, self.last_origin.withColumnRenamed("forecast_origin", "origin_date")
        )
        return risk.risk_scores(scaffold, self.last_seasonal, self.origin_snapshots)
