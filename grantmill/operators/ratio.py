"""Funding-ratio aggregates and their sensitivities.

One conditional aggregate feeds every ratio, so a rollup over several levels
is one scan and one shuffle with map-side combine.  Money is summed as
DECIMAL and published as DOUBLE.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import vocab
from ..functions.money import MONEY
from ..functions.stats import share


def _sum(c: Column) -> Column:
    return F.coalesce(F.sum(c), F.lit(0).cast(MONEY))


def measures(label: Column, amount: Column) -> list[Column]:
    """Counts and money per label, plus the rows that carry no amount."""
    amount = amount.cast(MONEY)
    out = [F.count(F.lit(1)).alias("records")]
    out += [F.count_if(label == v).alias(f"n_{v}") for v in vocab.LABELS]
    out += [_sum(F.when(label == v, amount)).alias(f"d_{v}") for v in vocab.LABELS]
    out += [F.count_if(amount.isNull()).alias("eur_missing_records")]
    return out


def _total(names: Sequence[str]) -> Column:
    total = F.col(f"d_{names[0]}")
    for n in names[1:]:
        total = total + F.col(f"d_{n}")
    return total


def finish(df: DataFrame, *keys: str | Column) -> DataFrame:
    """Ratio and undecided share from the measures."""
    num, den = _total(vocab.NUMERATOR), _total(vocab.CATEGORIES)
    amb = F.col("d_ambiguous")
    return df.select(
        *keys,
        "records",
        *[f"n_{v}" for v in vocab.LABELS],
        *[F.col(f"d_{v}").cast("double").alias(f"eur_{v}") for v in vocab.LABELS],
        num.cast("double").alias("numerator_eur"),
        den.cast("double").alias("denominator_eur"),
        share(num, den, 4).alias("ratio"),
        share(amb, den + amb, 4).alias("ambiguous_share"),
        "eur_missing_records",
    )


def compare_labels(df: DataFrame, *by: str, before: str, after: str, amount: str = "amount_eur") -> DataFrame:
    """Ratio and undecided share by either of two label columns of the same rows, from one aggregate."""
    money = F.col(amount).cast(MONEY)
    out = df.groupBy(*by).agg(*[_sum(F.when(F.col(column) == v, money)).alias(f"{side}_d_{v}")
                                for side, column in (("before", before), ("after", after)) for v in vocab.LABELS])

    def shares(side: str) -> list[Column]:
        def total(names: Sequence[str]) -> Column:
            return sum((F.col(f"{side}_d_{n}") for n in names[1:]), F.col(f"{side}_d_{names[0]}"))

        den, amb = total(vocab.CATEGORIES), F.col(f"{side}_d_ambiguous")
        return [share(total(vocab.NUMERATOR), den, 4).alias(f"{side}_ratio"), share(amb, den + amb, 4).alias(f"{side}_ambiguous_share")]

    return out.select(*by, *shares("before"), *shares("after"))


def funding_ratio(df: DataFrame, *by: str, label: str = "label", amount: str = "amount_eur") -> DataFrame:
    return finish(df.groupBy(*by).agg(*measures(F.col(label), F.col(amount))), *by)


def ratio_rollup(
    df: DataFrame, region: str = "region", funder: str = "funder", label: str = "label", amount: str = "amount_eur"
) -> DataFrame:
    """Grand total, regions and (region, funder) pairs in one pass."""
    r, f = F.col(region), F.col(funder)
    # cells first: the grouping sets then expand cells, not grants
    cells = df.groupBy(r, f).agg(*measures(F.col(label), F.col(amount)))
    names = [c for c in cells.columns if c not in (region, funder)]
    agg = cells.groupingSets([[r, f], [r], []], r, f).agg(
        F.grouping_id().alias("gid"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names]
    )
    level = F.when(F.col("gid") == 0, "funder").when(F.col("gid") == 1, "region").otherwise("total")
    return finish(agg.withColumn("level", level), "level", region, funder)


def category_distribution(
    df: DataFrame, *by: str, label: str = "label", amount: str = "amount", amount_eur: str = "amount_eur"
) -> DataFrame:
    """Count, native and EUR sums and record share per group and category."""
    cells = df.groupBy(*by, F.col(label).alias("category")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col(amount).cast(MONEY)).alias("native"),
        F.sum(F.col(amount_eur).cast(MONEY)).alias("eur"),
    )
    # the window runs over cells: at most one row per category and group
    whole = F.sum("n").over(Window.partitionBy(*[F.col(b) for b in by]))
    return cells.select(
        *by, "category", "n",
        F.coalesce(F.col("native"), F.lit(0)).cast("double").alias("amount_native"),
        F.coalesce(F.col("eur"), F.lit(0)).cast("double").alias("amount_eur"),
        F.round(F.col("n") / whole, 4).alias("record_share"),
    )


def count_and_money(df: DataFrame, *by: str, amount_eur: str = "amount_eur") -> DataFrame:
    """Count and EUR per group: by year, country or funder type."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(F.col(amount_eur).cast(MONEY)), F.lit(0)).cast("double").alias("amount_eur"),
    )


def ratio_bounds(df: DataFrame, *by: str, label: str = "label", amount: str = "amount_eur") -> DataFrame:
    """Ratio over the four legacy categories; the undecided money bounds it.

    Lower: undecided joins the denominator.  Upper: it joins both sides.
    """
    agg = df.groupBy(*by).agg(*measures(F.col(label), F.col(amount)))
    part, whole, amb = F.col(f"d_{vocab.LEGACY_CATEGORIES[0]}"), _total(vocab.LEGACY_CATEGORIES), F.col("d_ambiguous")
    return agg.select(
        *by,
        share(part, whole, 4).alias("point"),
        share(part, whole + amb, 4).alias("lower"),
        share(part + amb, whole + amb, 4).alias("upper"),
    )


def excluding(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """Rows without the given classes, for a sensitivity run."""
    return df.filter(~F.coalesce(F.col(column).isin(list(values)), F.lit(False)))


def headline_counters(df: DataFrame, region: str = "region", label: str = "label", amount: str = "amount_eur") -> DataFrame:
    numerator = F.when(F.col(label).isin(vocab.NUMERATOR), F.col(amount).cast(MONEY))
    return df.agg(
        F.count(F.lit(1)).alias("grants"),
        F.coalesce(F.sum(numerator), F.lit(0)).cast("double").alias("numerator_eur"),
        F.count_distinct(region).alias("jurisdictions"),
    )


def label_transitions(df: DataFrame, before: str, after: str, amount: str = "amount_eur") -> DataFrame:
    """Records and money moved from one label to another."""
    return df.groupBy(F.col(before).alias("before"), F.col(after).alias("after")).agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(F.col(amount).cast(MONEY)), F.lit(0)).cast("double").alias("eur"),
    )


def leave_one_out(
    df: DataFrame, region: str = "region", record_id: str = "record_id", label: str = "label", amount: str = "amount_eur"
) -> DataFrame:
    """The grant whose removal moves a region's ratio most; the smallest id of equals.

    On either side of the ratio the move grows with the amount taken out, so only
    the largest and the smallest amount of each side can win: one aggregate with
    map-side combine, whatever the number of grants.  Where one grant holds all
    money it has no ratio without it, and a grant without money wins with no move.
    """
    money = F.coalesce(F.col(amount).cast(MONEY), F.lit(0).cast(MONEY))
    counted, upper = F.col(label).isin(vocab.CATEGORIES), F.col(label).isin(vocab.NUMERATOR)
    rows = df.filter(counted).select(F.col(region).alias("region"), F.col(record_id).alias("record_id"), money.alias("m"), upper.alias("upper"))
    sides = {"upper_most": (F.col("upper"), -1), "upper_least": (F.col("upper"), 1), "lower_most": (~F.col("upper"), -1),
             "lower_least": (~F.col("upper"), 1), "none": (F.col("m") == 0, 1)}
    best = rows.groupBy("region").agg(
        F.sum(F.when(F.col("upper"), F.col("m")).otherwise(F.lit(0).cast(MONEY))).alias("num"), F.sum("m").alias("den"),
        *[F.min(F.when(side, F.struct((sign * F.col("m")).alias("k"), "record_id", F.col("m").alias("m"), "upper"))).alias(name)
          for name, (side, sign) in sides.items()])

    def without(grant: Column) -> Column:
        num = F.when(grant["upper"], F.col("num") - grant["m"]).otherwise(F.col("num"))
        return F.when(grant.isNotNull(), share(num, F.col("den") - grant["m"]))

    base = share(F.col("num"), F.col("den"))
    moves = F.array(*[F.struct((-F.abs(without(F.col(n)) - base)).alias("s"), F.col(n)["record_id"].alias("record_id"), without(F.col(n)).alias("without"))
                      for n in sides])
    return best.select("region", base.alias("base"), F.array_min(F.filter(moves, lambda v: v["s"].isNotNull())).alias("b")).filter("b IS NOT NULL").select(
        "region",
        F.col("b.record_id").alias("record_id"),
        F.round("base", 6).alias("ratio"),
        F.round("b.without", 6).alias("ratio_without"),
        F.round(-F.col("b.s"), 6).alias("swing"),
    )


def stratum_extrapolated(
    population: DataFrame, sample: DataFrame, stratum: str = "label", corrected: str = "corrected", amount: str = "amount_eur"
) -> DataFrame:
    """Apply the corrected-label rates of a reviewed sample to all money.

    ``sample`` carries the stratum and the corrected label of reviewed rows.
    """
    rates = sample.groupBy(F.col(stratum).alias("stratum")).agg(
        F.avg(F.col(corrected).isin(vocab.NUMERATOR).cast("double")).alias("num_rate"),
        F.avg(F.col(corrected).isin(vocab.CATEGORIES).cast("double")).alias("den_rate"),
    )
    money = population.groupBy(F.col(stratum).alias("stratum")).agg(
        F.coalesce(F.sum(F.col(amount).cast(MONEY)), F.lit(0)).cast("double").alias("eur")
    )
    joined = money.join(rates, "stratum")
    num, den = F.sum(F.col("eur") * F.col("num_rate")), F.sum(F.col("eur") * F.col("den_rate"))
    return joined.agg(
        F.round(num, 2).alias("numerator_eur"), F.round(den, 2).alias("denominator_eur"), share(num, den, 4).alias("ratio")
    )


def capture_share(df: DataFrame, totals: DataFrame, keys: Sequence[str] = ("funder", "year"), amount: str = "amount_eur") -> DataFrame:
    """Corpus money over a published total per key."""
    mine = df.groupBy(*keys).agg(F.coalesce(F.sum(F.col(amount).cast(MONEY)), F.lit(0)).alias("corpus"))
    return totals.join(mine, list(keys), "left").select(
        *keys,
        F.coalesce(F.col("corpus"), F.lit(0)).cast("double").alias("corpus_eur"),
        F.col("total_eur").cast("double").alias("total_eur"),
        share(F.coalesce(F.col("corpus"), F.lit(0)), F.col("total_eur"), 4).alias("capture_share"),
    )


UNDECIDED_CLASS = {
    "anchor_only": "no_match",
    "boundary_undecided": "boundary",
    "single_weak": "weak_evidence",
    "tie_undecided": "near_tie",
}


def ambiguous_by_rule(df: DataFrame, *by: str, amount: str = "amount_eur") -> DataFrame:
    """Undecided records and money by the kind of rule that left them so."""
    kind = None
    for path, name in UNDECIDED_CLASS.items():
        c = F.col("rule_path") == path
        kind = F.when(c, name) if kind is None else kind.when(c, name)
    return count_and_money(
        df.filter(F.col("label") == "ambiguous").withColumn("undecided", kind), *by, "undecided", amount_eur=amount
    )
