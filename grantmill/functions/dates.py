"""Mixed-precision dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def leading_year(c: Column) -> Column:
    """First four characters as a year, null unless all four are digits."""
    head = F.substring(c, 1, 4)
    return F.when(head.rlike(r"^\p{Nd}{4}$"), head).try_cast("int")


def in_window(year: Column, first: int, last: int) -> Column:
    return F.coalesce(year.between(first, last), F.lit(False))


def mixed_date(c: Column) -> Column:
    """YYYY-MM-DD, YYYY-MM (first day) or YYYY (mid-year)."""
    return F.coalesce(
        F.when(F.length(c) == 4, F.try_to_date(F.concat(c, F.lit("-07-01")), "yyyy-MM-dd")),
        F.when(F.length(c) == 7, F.try_to_date(F.concat(c, F.lit("-01")), "yyyy-MM-dd")),
        F.when(F.length(c) == 10, F.try_to_date(c, "yyyy-MM-dd")),
    )


def recency_weight(source_date: Column, now: Column) -> Column:
    """Weight by age in 365.25-day years; unreadable dates get the lowest."""
    start = mixed_date(source_date).cast("timestamp").cast("double")
    years = (now.cast("timestamp").cast("double") - start) / (365.25 * 24 * 3600)
    return (
        F.when(years.isNull(), 0.3)
        .when(years <= 2, 1.0)
        .when(years <= 5, 0.75)
        .when(years <= 10, 0.5)
        .otherwise(0.3)
    )
