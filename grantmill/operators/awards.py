"""Human-coded award benchmark and negative control."""

from __future__ import annotations

import importlib
from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab
from ..functions import stats
from ..functions.money import MONEY
from ..functions.text import strip
from .matching import screen
from .ranking import top_k


def load_awards(wide: DataFrame) -> DataFrame:
    """Wide award rows to arrays; rows without an id are dropped."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    slots = lambda stem, n: F.filter(F.array(*[strip(text(f"{stem}_{i}")) for i in range(1, n + 1)]), lambda x: x != "")
    return wide.filter(text("HRCS2022_ID") != "").select(
        F.col("HRCS2022_ID").alias("award_id"), text("FundingOrganisation").alias("funder"),
        text("AwardTitle").alias("title"), text("AwardAbstract").alias("abstract"),
        F.coalesce(F.col("`2022AnnualisedValue`").try_cast("double"), F.lit(0.0)).alias("value_gbp"),
        slots("HC", 5).alias("health_categories"),
        F.transform(slots("RA", 4), lambda x: F.get(F.split(x, r"\."), F.lit(0))).alias("activity_groups"),
        text("CodingType").alias("coding_type"),
    )


def award_text(title: str = "title", abstract: str = "abstract") -> Column:
    return strip(F.concat_ws(" ", F.col(title), F.col(abstract)))


def is_redacted(text: Column) -> Column:
    """Blank, or a placeholder where the text should be."""
    low = F.lower(text)
    out = low == ""
    for m in vocab.REDACTION_MARKERS:
        out = out | F.contains(low, F.lit(m))
    return F.coalesce(out, F.lit(True))


def ground_truth(awards: DataFrame) -> DataFrame:
    return awards.filter(F.col("coding_type") == "Manual")


def keyword_screen(df: DataFrame, text: str = "text", out: str = "predicted") -> DataFrame:
    """Default predictor: any cancer term as a whole word."""
    terms = list(dict.fromkeys(vocab.CANCER_TERMS_EN + vocab.CANCER_TERMS_SV))
    low = df.withColumn("__t", F.lower(text))
    return screen(low, "__t", terms, out, "__m").drop("__t", "__m")


def predictor(spec: str | Callable | None) -> Callable[[DataFrame], DataFrame]:
    """Pluggable predicate over ``text``.

    None is the keyword screen; a Column function runs as it is; a
    ``module:function`` spec names a text -> truthy Python function, run as an
    Arrow-batched UDF.
    """
    if spec is None:
        return keyword_screen
    if callable(spec):
        return lambda df: df.withColumn("predicted", F.coalesce(spec(F.col("text")), F.lit(False)))
    module, _, name = spec.partition(":")
    if not module or not name:
        raise ValueError(f"predictor must be module:function, got {spec!r}")
    getattr(importlib.import_module(module), name)

    @F.pandas_udf("boolean")
    def apply(texts: pd.Series) -> pd.Series:
        fn = getattr(importlib.import_module(module), name)
        return texts.map(lambda t: bool(fn(t)))

    return lambda df: df.withColumn("predicted", apply(F.col("text")))


def binary_scores(df: DataFrame, predicted: str, runs: Mapping[str, tuple[Column, Column]], value: str) -> DataFrame:
    """Counts, precision, recall, F1 and misassigned money per run.

    A run is (rows to score, truth); all runs share one scan and one aggregate.
    """
    p, v = F.col(predicted), F.col(value).cast(MONEY)
    names = ["tp", "fp", "fn", "tn", "wrongly_included", "missed"]
    sums = []
    for i, (where, truth) in enumerate(runs.values()):
        w, a = F.coalesce(where, F.lit(False)), F.coalesce(truth, F.lit(False))
        cells = [w & p & a, w & p & ~a, w & ~p & a, w & ~p & ~a]
        sums += [F.count_if(c).alias(f"{n}_{i}") for n, c in zip(names, cells)]
        for n, c in zip(names[4:], cells[1:3]):
            sums.append(F.coalesce(F.sum(F.when(c, v)), F.lit(0)).cast("double").alias(f"{n}_{i}"))
    rows = F.array(*[
        F.struct(F.lit(run).alias("run"), *[F.col(f"{n}_{i}").alias(n) for n in names]) for i, run in enumerate(runs)
    ])
    agg = df.agg(*sums).select(F.explode(rows).alias("r")).select("r.*")
    precision, recall = stats.share(F.col("tp"), F.col("tp") + F.col("fp")), stats.share(F.col("tp"), F.col("tp") + F.col("fn"))
    return agg.select(
        "run", "tp", "fp", "fn", "tn", F.round(precision, 6).alias("precision"), F.round(recall, 6).alias("recall"),
        F.round(stats.f1(precision, recall), 6).alias("f1"), "wrongly_included", "missed",
    )


def any_slot(categories: str, category: str) -> Column:
    return F.array_contains(categories, category)


def first_slot(categories: str, category: str) -> Column:
    return F.coalesce(F.get(F.col(categories), F.lit(0)) == category, F.lit(False))


def score_awards(awards: DataFrame, predict=None, category: str = vocab.CANCER_CATEGORY) -> DataFrame:
    """Three scores: any slot, first slot, and any slot with redacted rows."""
    rows = predictor(predict)(ground_truth(awards).withColumn("text", award_text())).withColumn("redacted", is_redacted(F.col("text")))
    clean, anywhere = ~F.col("redacted"), any_slot("health_categories", category)
    runs = {
        "any_category": (clean, anywhere),
        "primary_category": (clean, first_slot("health_categories", category)),
        "including_redacted": (F.lit(True), anywhere),
    }
    return binary_scores(rows, "predicted", runs, "value_gbp")


def apportioned_profile(df: DataFrame, groups: str, value: str) -> DataFrame:
    """Each award's value split equally over its groups; ``exact`` is not rounded."""
    part = F.col(value).cast("double") / F.size(groups)
    rows = df.filter(F.size(groups) > 0).select(F.explode(groups).alias("activity_group"), part.alias("v"))
    agg = rows.groupBy("activity_group").agg(F.count(F.lit(1)).alias("awards"), F.sum("v").alias("exact"))
    name = F.col("activity_group")
    for k, v in vocab.ACTIVITY_GROUPS.items():
        name = F.when(F.col("activity_group") == k, v).otherwise(name)
    side = F.when(F.col("activity_group").isin(vocab.PREVENTION_GROUPS), "prevention").when(
        F.col("activity_group").isin(vocab.CONSEQUENCE_GROUPS), "consequences"
    ).otherwise("unmapped")
    return agg.select("activity_group", name.alias("group_name"), side.alias("side"), "awards", F.round("exact", 2).alias("apportioned"), "exact")


def profile_sides(profile: DataFrame) -> DataFrame:
    """Prevention, consequences, unmapped money and the prevention share."""
    s = lambda n: F.coalesce(F.sum(F.when(F.col("side") == n, F.col("exact"))), F.lit(0.0))
    agg = profile.agg(s("prevention").alias("prevention"), s("consequences").alias("consequences"), s("unmapped").alias("unmapped"))
    return agg.select(
        *[F.round(c, 2).alias(c) for c in ("prevention", "consequences", "unmapped")],
        F.round(stats.share(F.col("prevention"), F.col("prevention") + F.col("consequences")), 6).alias("prevention_share"),
    )


def coverage_counts(awards: DataFrame, hidden: str | None = None) -> DataFrame:
    """Awards and money by coding type; ``hidden`` names a column that says which texts are redacted, found before a join."""
    manual = F.col("coding_type") == "Manual"
    redacted = F.col(hidden) if hidden else is_redacted(award_text())
    money = lambda c: F.coalesce(F.sum(c.cast(MONEY)), F.lit(0)).cast("double")
    return awards.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(manual).alias("manual"),
        F.count_if(F.col("coding_type") == "Automated").alias("automated"), F.count_if(F.col("coding_type") == "Mixed").alias("mixed"),
        F.count_if(manual & redacted).alias("redacted"), F.count_if(manual & ~redacted).alias("scoreable"),
        money(F.col("value_gbp")).alias("total_value"), money(F.when(manual, F.col("value_gbp"))).alias("manual_value"),
    )


def error_breakdown(df: DataFrame, predicted: str, actual: Column, categories: str) -> DataFrame:
    """False positives by the human coder's first category."""
    wrong = df.filter(F.col(predicted) & ~F.coalesce(actual, F.lit(False)))
    first = F.coalesce(F.get(F.col(categories), F.lit(0)), F.lit(""))
    return wrong.groupBy(first.alias("category")).agg(F.count(F.lit(1)).alias("n"))


def negative_control(df: DataFrame, label: str = "label", value: str = "value_gbp") -> DataFrame:
    """What the instrument reads on a corpus with no such focus."""
    l, v = F.col(label), F.col(value).cast(MONEY)
    num, den = l.isin(vocab.NUMERATOR), l.isin(vocab.CATEGORIES)
    agg = df.agg(
        F.count(F.lit(1)).alias("awards"), F.count_if(num).alias("numerator_awards"),
        F.sum(F.when(num, v)).alias("n"), F.sum(F.when(den, v)).alias("d"),
    )
    return agg.select(
        "awards", F.round(stats.share(F.col("numerator_awards"), F.col("awards")), 6).alias("numerator_share"),
        F.round(stats.share(F.coalesce("n", F.lit(0)), F.coalesce("d", F.lit(0))), 6).alias("ratio"),
    )


def suspicious(df: DataFrame, categories: str, label: str = "label", listed: Sequence[str] = tuple(vocab.NON_AGEING_HEALTH_CATEGORIES)) -> DataFrame:
    """Numerator labels whose first human category is on the list."""
    first = F.get(F.col(categories), F.lit(0))
    return df.filter(F.col(label).isin(vocab.NUMERATOR) & first.isin(list(listed))).withColumn("human_category", first)


def keyword_drivers(df: DataFrame, k: int = 15, label: str = "label", matched: str = "matched_keywords") -> DataFrame:
    """Most frequent matched terms of each assigned label."""
    terms = df.select(F.col(label).alias("label"), F.explode(F.try_element_at(matched, F.col(label))).alias("term"))
    counts = terms.groupBy("label", "term").agg(F.count(F.lit(1)).alias("n"))
    return top_k(counts, ["label"], [F.desc("n"), F.col("term")], k)
