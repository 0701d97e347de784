"""Closed forms of the statistics, on count columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def share(part: Column, whole: Column, digits: int | None = None) -> Column:
    """part / whole as DOUBLE, null when the whole is zero."""
    value = F.when(whole != 0, part.cast("double") / whole.cast("double"))
    return value if digits is None else F.round(value, digits)


def f1(precision: Column, recall: Column) -> Column:
    """Null when either input is null or zero."""
    return F.when(
        (precision > 0) & (recall > 0), 2 * precision * recall / (precision + recall)
    )


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Lower and upper bound of the score interval, clamped, 4 digits."""
    k, n = k.cast("double"), n.cast("double")
    p = k / n
    denom = 1 + z * z / n
    centre = p + z * z / (2 * n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    low = F.round(F.greatest(F.lit(0.0), (centre - half) / denom), 4)
    high = F.round(F.least(F.lit(1.0), (centre + half) / denom), 4)
    return F.when(n > 0, low), F.when(n > 0, high)


def half_up(c: Column) -> Column:
    return F.floor(c + 0.5)


def pairs(n: Column) -> Column:
    """Unordered pairs among n, without listing them."""
    return n * (n - 1) / 2


def contention(yes: Column, no: Column, borderline: Column) -> Column:
    """Mean pairwise distance: yes/no 2, either/borderline 1, equal 0."""
    n = yes + no + borderline
    return F.when(
        n >= 2, (2 * yes * no + borderline * (yes + no)) / pairs(n)
    ).otherwise(0.0)
