"""Amount parsing, conversion and display."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import vocab
from .text import strip

MONEY = "decimal(18,2)"


def comma_decimal(c: Column) -> Column:
    """'6999962,25' -> 6999962.25; blank or malformed -> null."""
    return F.replace(strip(c), F.lit(","), F.lit(".")).try_cast("double")


def plain_decimal(c: Column) -> Column:
    return F.when(c != "", c).try_cast("double")


def checked_amount(amount: Column, record_id: Column) -> Column:
    """Blank or a number 0 -> null (text '0' is an amount); malformed or negative values fail the job by record."""
    raw = F.when(strip(amount.cast("string")) != "", strip(amount.cast("string")))
    value = raw.try_cast("double")
    return (
        F.when(raw.isNull() | ((F.typeof(amount) != "string") & (value == 0)), F.lit(None).cast(MONEY))
        .when(
            value.isNull() | F.isnan(value),
            F.raise_error(F.concat(record_id.cast("string"), F.lit(": unparsable amount "), raw)),
        )
        .when(
            value < 0,
            F.raise_error(F.concat(record_id.cast("string"), F.lit(": negative amount "), raw)),
        )
        .otherwise(raw.cast("double").cast(MONEY))
    )


def amount_problem(amount: Column) -> Column:
    """'malformed' / 'negative' / null, for a quarantine split."""
    raw = F.when(strip(amount.cast("string")) != "", strip(amount.cast("string")))
    value = raw.try_cast("double")
    return F.when(raw.isNotNull() & (value.isNull() | F.isnan(value)), "malformed").when(value < 0, "negative")


def to_eur(amount: Column, currency: Column, rates: Mapping[str, float] = vocab.RATES_PER_EUR) -> Column:
    """Convert through a fixed rate table; an unknown currency is an error."""
    rate = None
    for code, per_eur in rates.items():
        rate = F.when(currency == code, F.lit(per_eur)) if rate is None else rate.when(currency == code, F.lit(per_eur))
    missing = F.raise_error(F.concat(F.lit("no rate for currency "), F.coalesce(currency, F.lit("<null>"))))
    return F.when(amount.isNotNull(), F.round(amount / rate.otherwise(missing.cast("double")), 2))


def _digits(v: Column, places: int, ties: str) -> Column:
    """``v`` with 0 or 1 decimal places, rounded by its exact binary value.

    ``format_string`` would round the shortest decimal form.  A tie is an odd
    number of halves (of quarters, for one place); ``up``: away from zero.
    """
    if ties == "up":
        tie = F.abs(v * (4 if places else 2) % 2) == 1
        v = F.when(tie, v + F.signum(v) * (0.05 if places else 0.25)).otherwise(v)
    return F.replace(F.format_number(v, places), F.lit(","), F.lit(""))


def display_eur(c: Column, ties: str = "up") -> Column:
    """Short display form in billions, millions or thousands; ``ties``: ``up`` or ``even``."""
    size = F.abs(c)
    fmt = lambda v, places, unit: F.concat(F.lit("€"), _digits(v, places, ties), F.lit(unit))
    return (
        F.when(c.isNull() | F.isnan(c) | (size == float("inf")), "—")
        .when(size >= 1e9, fmt(c / 1e9, 1, "B"))
        .when(size >= 1e6, fmt(c / 1e6, 1, "M"))
        .when(size >= 1e3, fmt(c / 1e3, 0, "k"))
        .otherwise(fmt(F.floor(c + 0.5).cast("double"), 0, ""))
    )
