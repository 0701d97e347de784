"""Census to labels to ratio, and the adjudicated scenario."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import vocab
from ..functions.hashing import part_digests
from ..functions.money import checked_amount
from ..functions.text import strip
from ..operators.overlay import compare_scenarios, latest_success, overlay
from ..operators.ratio import ratio_rollup
from ..operators.validation import require_unchanged
from ..operators.rules import RuleSet, classify


@dataclass(frozen=True)
class Scenario:
    labels: DataFrame
    rollup: DataFrame


def region_of(source: F.Column) -> F.Column:
    out = None
    for s, r in vocab.REGION_BY_SOURCE.items():
        out = F.when(source == s, r) if out is None else out.when(source == s, r)
    return out.otherwise(F.raise_error(F.concat(F.lit("unknown source "), F.coalesce(source, F.lit("<null>")))))


def label_census(census: DataFrame, rules: RuleSet) -> DataFrame:
    """Label rows: scan, project, classify; no shuffle."""
    out = classify(census, "title", "abstract", rules)
    return out.select(
        "record_id", "source", region_of(F.col("source")).alias("region"), "year",
        strip(F.coalesce("funder", F.lit(""))).alias("funder"),
        checked_amount(F.col("amount_eur"), F.col("record_id")).alias("amount_eur"),
        "title", "url", "label", "matched_keywords", "anchor_terms", "reason", "confidence", "rule_path",
    )


def build(census: DataFrame, rules: RuleSet) -> Scenario:
    """Labels and rollup.  Write the labels once and aggregate from the table
    when both are needed, so the texts are read once."""
    labels = label_census(census, rules)
    return Scenario(labels, ratio_rollup(labels))


def build_adjudicated(labels: DataFrame, log: DataFrame) -> Scenario:
    merged = overlay(labels, latest_success(log))
    return Scenario(merged, ratio_rollup(merged))


def scenario_table(labels: DataFrame, log: DataFrame) -> DataFrame:
    return compare_scenarios(labels, latest_success(log), "region")


DIGESTED = ("record_id", "region", "funder", "label", "amount_eur")


def store_rollup(labels: DataFrame, path: str) -> None:
    """Write the rollup, and beside it the digests of the labels it was made from."""
    ratio_rollup(labels).write.mode("overwrite").parquet(f"{path}/rollup")
    part_digests(labels, "record_id", *DIGESTED).write.mode("overwrite").parquet(f"{path}/digests")


def load_rollup(labels: DataFrame, path: str) -> DataFrame:
    """The stored rollup; reading it fails where ``labels`` are not those it was made from, and names the parts that differ."""
    spark = labels.sparkSession
    stored = spark.read.parquet(f"{path}/digests")
    return require_unchanged(spark.read.parquet(f"{path}/rollup"), stored, part_digests(labels, "record_id", *DIGESTED))
