"""Column expressions shared by the operators (all JVM side, no Python UDF)."""

from .dates import iso_year, season_name, week_label_monday, week_start
from .numbers import corrected_kurtosis, corrected_skewness, half_even, ratio

__all__ = [
    "corrected_kurtosis",
    "corrected_skewness",
    "half_even",
    "iso_year",
    "ratio",
    "season_name",
    "week_label_monday",
    "week_start",
]
