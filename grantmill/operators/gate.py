"""Review gate: staleness, effective verdicts, summary, consensus export."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab
from ..functions.stats import wilson
from ..functions.text import csv_cell_guard


def mark_stale(attestations: DataFrame, records: DataFrame, key: str = "record_id") -> DataFrame:
    """Stale when the record is gone or its fingerprint changed.

    ``records`` has the key and a ``fingerprint`` column.
    """
    current = records.select(key, F.col("fingerprint").alias("__fp"), F.lit(True).alias("__here"))
    fresh = F.col("__here").isNotNull() & F.col("record_fingerprint").eqNullSafe(F.col("__fp"))
    return attestations.join(current, key, "left").withColumn("stale", ~fresh).drop("__fp", "__here")


def effective_verdicts(verdicts: DataFrame) -> DataFrame:
    """Explicitly fresh, well-formed verdicts with a known label."""
    return verdicts.filter(
        (F.col("stale") == F.lit(False)) & F.col("verdict").isin("agree", "disagree") & F.col("label").isin(vocab.LABELS)
    )


def review_state(records: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Records with their verdict labels folded: reviewed, conflict, consensus."""
    v = effective_verdicts(verdicts).groupBy("record_id").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
    j = records.join(v, "record_id", "left")
    reviewed = F.col("lo").isNotNull()
    conflict = reviewed & (F.col("lo") != F.col("hi"))
    settled = reviewed & ~conflict
    return j.withColumns(
        {
            "reviewed": reviewed,
            "conflict": F.coalesce(conflict, F.lit(False)),
            "consensus_label": F.when(settled, F.col("lo")),
            "agreed": F.coalesce(settled & (F.col("lo") == F.col("label")), F.lit(False)),
        }
    ).drop("lo", "hi")


def conflict_list(records: DataFrame, verdicts: DataFrame) -> DataFrame:
    """``record_id, split, label, verdicts``: records whose reviewers differ, with each reviewer's label in order of the reviewers."""
    told = effective_verdicts(verdicts).groupBy("record_id").agg(
        F.array_sort(F.collect_set(F.struct("reviewer", F.col("label").alias("verdict_label")))).alias("verdicts"),
        F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi")
    return records.select("record_id", "split", "label").join(told.select("record_id", "verdicts"), "record_id")


def judge_flagged(judges: Column, stale: Column, dimensions: Sequence[str] = tuple(vocab.GATE_JUDGE_DIMENSIONS)) -> Column:
    """Missing, stale, or any dimension that is not a pass."""
    passes = F.lit(True)
    for d in dimensions:
        passes = passes & F.coalesce(F.try_element_at(judges, F.lit(d))["verdict"] == "pass", F.lit(False))
    return judges.isNull() | F.coalesce(stale, F.lit(False)) | ~passes


GATE_CELLS = "split string, reviewed boolean, conflict boolean, settled boolean, agreed boolean, ambiguous boolean, judge_flag boolean"


def gate_cells(records: DataFrame, verdicts: DataFrame, judge_marks: DataFrame | None = None) -> DataFrame:
    """Records counted by all that the gate's metrics ask of them; ``judge_marks`` has record_id, judges, stale."""
    s = review_state(records, verdicts)
    if judge_marks is not None:
        s = s.join(judge_marks.select("record_id", "judges", F.col("stale").alias("judge_stale")), "record_id", "left")
        s = s.withColumn("judge_flag", judge_flagged(F.col("judges"), F.col("judge_stale")))
    else:
        s = s.withColumn("judge_flag", F.lit(True))
    settled, ambiguous = F.col("consensus_label").isNotNull(), F.coalesce(F.col("label") == "ambiguous", F.lit(False))
    cells = s.groupBy("split", "reviewed", "conflict", settled.alias("settled"), "agreed", ambiguous.alias("ambiguous"), "judge_flag")
    return cells.agg(F.count(F.lit(1)).alias("n"))


def gate_summary(cells: DataFrame) -> DataFrame:
    """Gate metrics combined and per split, from the cells.

    A record counts once however many reviewers it has; conflicting reviewers
    leave the agreement figures.
    """
    zero = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    agreed, settled, amb = F.col("agreed"), F.col("settled"), F.col("ambiguous")
    agg = cells.groupingSets([[F.col("split")], []], F.col("split")).agg(
        F.grouping_id().alias("gid"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"), zero(F.col("reviewed")).alias("reviewed"), zero(F.col("conflict")).alias("conflicts"),
        zero(settled).alias("consensus_reviewed"), zero(agreed).alias("agreed"),
        zero(settled & amb).alias("ambiguous_reviewed"), zero(agreed & amb).alias("ambiguous_confirmed"),
        zero(F.col("judge_flag")).alias("judge_flagged"),
    )
    low, high = wilson(F.col("agreed"), F.col("consensus_reviewed"))
    n = F.col("consensus_reviewed")
    return agg.select(
        F.when(F.col("gid") == 1, "all").otherwise(F.col("split")).alias("split"),
        "total", "reviewed", "conflicts", "consensus_reviewed", "agreed",
        F.when(n > 0, F.round(F.col("agreed") / n, 4)).alias("agreement"), low.alias("ci_low"), high.alias("ci_high"),
        "ambiguous_reviewed", "ambiguous_confirmed", "judge_flagged", F.lit(vocab.AGREEMENT_TARGET).alias("target"),
    )


def summarise(records: DataFrame, verdicts: DataFrame, judge_marks: DataFrame | None = None) -> DataFrame:
    """Gate metrics of all records and verdicts, combined and per split."""
    return gate_summary(gate_cells(records, verdicts, judge_marks))


def consensus(verdicts: DataFrame) -> DataFrame:
    """Agreed label per record, with the first reviewer's note."""
    return (
        effective_verdicts(verdicts).groupBy("record_id")
        .agg(F.min("label").alias("label"), F.max("label").alias("hi"), F.min_by("note", "reviewer").alias("note"))
        .filter("label = hi").drop("hi")
    )


def consensus_export(benchmark: DataFrame, keys: DataFrame, verdicts: DataFrame, item: str = "input_id") -> DataFrame:
    """Benchmark rows with the human columns filled from consensus only."""
    old = ("human_category", "human_confidence", "human_notes")
    base = benchmark.drop(*old)
    j = base.join(keys.select(item, "record_id"), item, "left").join(consensus(verdicts), "record_id", "left")
    hit = F.col("label").isNotNull()
    legacy = F.when(~F.col("label").isin(vocab.GUIDE_LABELS), "legacy_equiv=ambiguous")
    notes = F.concat_ws("; ", F.lit("review gate"), legacy, F.when(F.col("note") != "", F.col("note")))
    return j.select(
        *base.columns,
        F.coalesce("label", F.lit("")).alias("human_category"),
        F.when(hit, "1.0").otherwise("").alias("human_confidence"),
        F.when(hit, csv_cell_guard(notes)).otherwise("").alias("human_notes"),
    )
