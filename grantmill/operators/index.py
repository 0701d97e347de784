"""Country index over verified findings."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab
from ..functions.dates import recency_weight
from ..functions.stats import half_up


def lookup(key: Column, table: Mapping[str, float], default: float) -> Column:
    out = None
    for k, v in table.items():
        out = F.when(key == k, F.lit(float(v))) if out is None else out.when(key == k, F.lit(float(v)))
    return out.otherwise(F.lit(float(default)))


def verification_state(reviewed: Column, correct: Column) -> Column:
    return F.when(~F.coalesce(reviewed, F.lit(False)), "pending").when(F.coalesce(correct, F.lit(False)), "verified").otherwise("failed")


def score_findings(findings: DataFrame, verdicts: DataFrame, now: Column) -> DataFrame:
    """Points per finding: class x confidence x verification x recency."""
    v = verdicts.select(F.col("finding_id").alias("id"), "reviewed", "correct")
    state = verification_state(F.col("reviewed"), F.col("correct"))
    points = (
        lookup(F.col("classification"), vocab.CLASS_WEIGHT, 0.4)
        * lookup(F.col("confidence"), vocab.CONFIDENCE_WEIGHT, 0.4)
        * lookup(F.col("state"), vocab.VERIFICATION_WEIGHT, 0.0)
        * recency_weight(F.col("source_date"), now)
    )
    known = lambda c, t: ~F.coalesce(F.col(c).isin(list(t)), F.lit(False))
    return (
        findings.join(v, "id", "left").withColumn("state", state)
        .withColumn("points", F.when(F.col("type") == "finding", points))
        .withColumns({
            "unknown_classification": known("classification", vocab.CLASS_WEIGHT),
            "unknown_confidence": known("confidence", vocab.CONFIDENCE_WEIGHT),
        })
    )


def index_of(total: Column) -> Column:
    """Saturating 0..100 index, rounded half up."""
    return half_up(100 * total / (total + vocab.INDEX_HALFWAY))


def country_index(scored: DataFrame) -> DataFrame:
    finding = F.col("type") == "finding"
    tally = lambda s: F.count_if(finding & (F.col("state") == s)).alias(s)
    agg = scored.groupBy("country").agg(
        F.count_if(finding).alias("findings"), F.count_if(F.col("type") == "nothing_reliable_found").alias("nothing"),
        F.round(F.coalesce(F.sum("points"), F.lit(0.0)), 6).alias("total_points"), tally("verified"), tally("failed"), tally("pending"),
    )
    return agg.select(
        "country", "findings", "total_points",
        F.when(F.col("findings") > 0, index_of(F.col("total_points"))).alias("index"),
        F.when(F.col("findings") > 0, "scored").when(F.col("nothing") > 0, "nothing").otherwise("empty").alias("status"),
        "verified", "failed", "pending",
    )


def rank_countries(index: DataFrame) -> DataFrame:
    return index.orderBy(F.desc_nulls_last("index"), "country")


def points_by_class(scored: DataFrame) -> DataFrame:
    return scored.filter(F.col("type") == "finding").groupBy("country", "classification").agg(
        F.round(F.sum("points"), 6).alias("points"), F.count(F.lit(1)).alias("findings")
    )


def checks_correct(checks: Column) -> Column:
    out = F.lit(True)
    for c in vocab.FINDING_CHECKS:
        out = out & F.coalesce(F.try_element_at(checks, F.lit(c)), F.lit(False))
    return out


def checks_reviewed(checks: Column) -> Column:
    out = F.lit(True)
    for c in vocab.FINDING_CHECKS:
        out = out & F.try_element_at(checks, F.lit(c)).isNotNull()
    return out


def accuracy(verdicts: DataFrame, country: str = "country") -> DataFrame:
    """Correct over reviewed per country and overall."""
    c = F.col("country")
    cells = verdicts.groupBy(F.col(country).alias("country")).agg(
        F.count_if("reviewed").alias("reviewed"), F.count_if(F.col("reviewed") & F.col("correct")).alias("correct")
    )
    agg = cells.groupingSets([[c], []], c).agg(
        F.grouping_id().alias("gid"), F.sum("reviewed").alias("reviewed"), F.sum("correct").alias("correct")
    )
    return agg.select(
        F.when(F.col("gid") == 1, "all").otherwise(c).alias("country"), "reviewed", "correct",
        F.when(F.col("reviewed") > 0, F.round(F.col("correct") / F.col("reviewed"), 4)).alias("accuracy"),
    )


def jurisdiction(iso: Column) -> Column:
    """Own corpus, the union's for its other members, else null."""
    return F.when(iso.isin(vocab.OWN_JURISDICTION), iso).when(iso.isin(vocab.EU27), "EU")


def ratio_index(ratio: Column) -> Column:
    return F.when(ratio.isNotNull() & ~F.isnan(ratio), half_up(100 * ratio))


def country_of_id(df: DataFrame, countries: DataFrame, id_column: str) -> tuple[DataFrame, DataFrame]:
    """Attach a country by id prefix; the second result holds the orphans."""
    keyed = df.withColumn("country", F.upper(F.substring(F.col(id_column), 1, 2)))
    known = countries.select("country").distinct()
    return keyed.join(known, "country", "left_semi"), keyed.join(known, "country", "left_anti")


def finding_counters(index: DataFrame) -> DataFrame:
    return index.agg(
        F.count_if(F.col("status") == "scored").alias("scored_countries"),
        F.coalesce(F.sum("findings"), F.lit(0)).alias("findings"), F.coalesce(F.sum("verified"), F.lit(0)).alias("verified"),
    )
