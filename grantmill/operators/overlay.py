"""Adjudication overlay, scenario comparison and record joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import keep_one
from .ratio import compare_labels


def latest_success(log: DataFrame, key: str = "record_id", order: Sequence[str] = ("seq",)) -> DataFrame:
    """Last row without an error per record."""
    return keep_one(log.filter(F.col("error").isNull()), [key], [F.col(c) for c in order], last=True)


def overlay(labels: DataFrame, adjudicated: DataFrame, default_by: str = "model", key: str = "record_id") -> DataFrame:
    """Replace label, reason and confidence where an adjudication exists.

    ``adjudicated`` holds one row per record (see ``latest_success``).
    """
    have = set(adjudicated.columns)
    a = adjudicated.select(
        key,
        *[(F.col(c) if c in have else F.lit(None)).cast("string").alias(f"a_{c}") for c in
          ("label", "reason", "confidence", "quote", "adjudicated_by")],
        F.lit(True).alias("a_hit"),
    )
    hit = F.col("a_hit").isNotNull()
    old = set(labels.columns)
    reason = F.col("reason") if "reason" in old else F.lit(None).cast("string")
    confidence = F.col("confidence").cast("string") if "confidence" in old else F.lit(None).cast("string")
    keep = [c for c in labels.columns if c not in ("label", "reason", "confidence")]
    return labels.join(a, key, "left").select(
        *keep,
        F.when(hit, F.col("a_label")).otherwise(F.col("label")).alias("label"),
        F.when(hit, F.coalesce("a_reason", reason)).otherwise(reason).alias("reason"),
        F.when(hit, F.col("a_confidence")).otherwise(confidence).alias("confidence"),
        F.when(hit, F.col("a_quote")).alias("quote"),
        F.when(hit, F.coalesce("a_adjudicated_by", F.lit(default_by))).alias("adjudicated_by"),
    )


def compare_scenarios(labels: DataFrame, adjudicated: DataFrame, *by: str, key: str = "record_id") -> DataFrame:
    """Ratios before and after adjudication side by side per group: one scan of the labels, one aggregate."""
    both = overlay(labels.withColumn("rules_label", F.col("label")), adjudicated, key=key)
    out = compare_labels(both, *by, before="rules_label", after="label")
    names = {"before_ratio": "rules_ratio", "before_ambiguous_share": "rules_ambiguous_share",
             "after_ratio": "adjudicated_ratio", "after_ambiguous_share": "adjudicated_ambiguous_share"}
    return out.withColumnsRenamed(names)


def attach(labels: DataFrame, other: DataFrame, key: str = "record_id", how: str = "inner") -> DataFrame:
    return labels.join(other, key, how)


def pending(labels: DataFrame, done: DataFrame, region: str | None = None, key: str = "record_id") -> DataFrame:
    """Undecided records without a successful adjudication."""
    todo = labels.filter(F.col("label") == "ambiguous")
    if region:
        todo = todo.filter(F.col("region") == region)
    return todo.join(done.select(key), key, "left_anti")


def undecided_records(census: DataFrame, labels: DataFrame, key: str = "record_id") -> DataFrame:
    return census.join(labels.filter(F.col("label") == "ambiguous").select(key), key, "left_semi")


def run_overlap(a: DataFrame, b: DataFrame, key: str = "record_id", label: str = "label") -> DataFrame:
    """Shared ids of two passes and how many carry the same label."""
    shared = a.select(key, F.col(label).alias("x")).join(b.select(key, F.col(label).alias("y")), key)
    same = F.col("x").eqNullSafe(F.col("y"))
    return shared.agg(
        F.count(F.lit(1)).alias("shared"),
        F.count_if(same).alias("agreeing"),
        F.round(F.avg(same.cast("double")), 4).alias("agreement"),
    )


def net_recall(published: DataFrame, corpus: DataFrame, key: str, amount: str) -> DataFrame:
    """How many listed awards the corpus holds, and with equal amounts."""
    c = corpus.select(key, F.col(amount).alias("__have"), F.lit(True).alias("__found"))
    j = published.join(c, key, "left")
    found = F.coalesce(F.col("__found"), F.lit(False))
    return j.agg(
        F.count(F.lit(1)).alias("listed"),
        F.count_if(found).alias("found"),
        F.count_if(found & F.col(amount).eqNullSafe(F.col("__have"))).alias("equal_amount"),
        F.round(F.avg(found.cast("double")), 4).alias("recall"),
    )


def resolve_keys(items: DataFrame, keys: DataFrame, rules: DataFrame, adjudicated: DataFrame, item: str = "input_id") -> DataFrame:
    """Benchmark item -> record -> rules and adjudicated label (falling back
    to rules).  An item without a record fails the job."""
    j = items.join(keys.select(item, "record_id"), item, "left")
    problem = F.raise_error(F.concat(F.lit("no record for item "), F.col(item).cast("string")))
    # the id column itself carries the check, so no plan can skip it
    checked = j.withColumn("record_id", F.coalesce(F.col("record_id"), problem.cast(j.schema["record_id"].dataType)))
    r = rules.select("record_id", F.col("label").alias("rules_label"))
    a = adjudicated.select("record_id", F.col("label").alias("adjudicated_raw"))
    return (
        checked.join(r, "record_id", "left").join(a, "record_id", "left")
        .withColumn("adjudicated_label", F.coalesce("adjudicated_raw", "rules_label")).drop("adjudicated_raw")
    )


def id_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.join(b.select(key), key, "left_anti")


def id_intersection(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).intersect(b.select(key))


def vocabulary_drift(a: DataFrame, b: DataFrame, label: str) -> DataFrame:
    """Labels in exactly one of two tables (empty when they agree)."""
    left, right = a.select(label).distinct(), b.select(label).distinct()
    return (
        left.exceptAll(right).withColumn("only_in", F.lit("left"))
        .unionByName(right.exceptAll(left).withColumn("only_in", F.lit("right")))
    )
