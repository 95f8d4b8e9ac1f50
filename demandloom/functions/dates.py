"""Calendar arithmetic on DateType columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

WEEK_DAYS = ("MON", "TUE", "WED", "THU", "FRI", "SAT", "SUN")


def week_start(date: Column, anchor: str = "TUE") -> Column:
    """First day of the seven-day week that contains ``date`` and begins on ``anchor``.

    The default runs Tuesday to Monday, which is what a week "ending on Monday" means.
    """
    shift = WEEK_DAYS.index(anchor.upper())
    monday = F.date_trunc("week", F.date_sub(date, shift)).cast("date")
    return F.date_add(monday, shift)


def week_label_monday(date: Column) -> Column:
    """Closing Monday of the Tuesday-to-Monday week that contains ``date``."""
    return F.date_add(week_start(date), 6)


def iso_year(date: Column) -> Column:
    return F.extract(F.lit("YEAROFWEEK"), date)


def season_name(month: Column) -> Column:
    return (
        F.when(month.isin(12, 1, 2), "Winter")
        .when(month.isin(3, 4, 5), "Spring")
        .when(month.isin(6, 7, 8), "Summer")
        .otherwise("Autumn")
    )
