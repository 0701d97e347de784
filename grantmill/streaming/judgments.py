"""Judgment log to current state, with a live study summary and a live gate summary.

Events go through ``KeyedState``: no key is held in memory for ever, a batch
reads the buckets it touches, and summaries follow by signed deltas.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import vocab
from ..operators import gate
from ..operators.agreement import ANSWERS, answer_counts, fleiss_of_counts, latest_judgments
from ..operators.validation import split_judgments
from .state import KeyedState

KEY = ("record_id", "labeller_id")
STUDY_CELLS = "kind string, who string, n_yes bigint, n_no bigint, n_borderline bigint"
OnBatch = Callable[[KeyedState, int], None]


def study_contributions(ids: DataFrame, rows: DataFrame) -> DataFrame:
    """Records by their answer counts, and labellers by their judgments; an undone judgment (null answer) is none."""
    live = without_undone(rows)
    counts = answer_counts(live).groupBy(*[f"n_{a}" for a in ANSWERS]).agg(F.count(F.lit(1)).alias("n"))
    records = counts.select(F.lit("record").alias("kind"), F.lit(None).cast("string").alias("who"), *[f"n_{a}" for a in ANSWERS], "n")
    none = [F.lit(None).cast("bigint").alias(f"n_{a}") for a in ANSWERS]
    labellers = live.groupBy(F.col("labeller_id").cast("string").alias("who")).agg(F.count(F.lit(1)).alias("n"))
    return records.unionByName(labellers.select(F.lit("labeller").alias("kind"), "who", *none, "n"))


def study_summary(cells: DataFrame) -> DataFrame:
    """Fleiss' kappa and the coverage of a study, from its cells."""
    records = cells.where("kind = 'record'")
    kappa = fleiss_of_counts(records, "n")
    size, n = F.col("n_yes") + F.col("n_no") + F.col("n_borderline"), F.col("n")
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    covered = records.agg(
        zero(F.when(size > 0, n)).alias("records_with_any"), zero(F.when(size >= vocab.MIN_JUDGMENTS, n)).alias("records_with_two_or_more"),
        zero(size * n).alias("total_judgments"))
    labellers = cells.where("kind = 'labeller'").agg(F.count(F.lit(1)).alias("n_labellers"))
    return kappa.join(covered).join(labellers)  # one row each


def study_state(path: str, rows: str, buckets: int = 64) -> KeyedState:
    """State of judgments; ``rows``: DDL with record_id, labeller_id, geroscience, labelled_at, seq and any other column."""
    return KeyedState(path, rows, KEY, ("labelled_at", "seq"), buckets=buckets, cells=STUDY_CELLS, contributions=study_contributions)


def gate_state(path: str, rows: str, records: DataFrame, judge_marks: DataFrame | None = None, buckets: int = 64) -> KeyedState:
    """State of review verdicts (record_id, reviewer, verdict, label, record_fingerprint, ...) beside the cells of the gate summary.

    ``records`` must not change while the stream runs.
    """
    spark = records.sparkSession

    def contributions(ids: DataFrame, rows: DataFrame) -> DataFrame:
        mine = records.join(ids, "record_id", "left_semi")
        marks = None if judge_marks is None else judge_marks.join(ids, "record_id", "left_semi")
        return gate.gate_cells(mine, gate.mark_stale(rows, records), marks)

    state = KeyedState(path, rows, ("record_id", "reviewer"), ("labelled_at", "seq"), buckets=buckets, cells=gate.GATE_CELLS, contributions=contributions)
    nothing = gate.mark_stale(spark.createDataFrame([], rows), records)
    return state.open(spark, gate.gate_cells(records, nothing, judge_marks))


def run_state(
    events: DataFrame, state: KeyedState, checkpoint: str, known: DataFrame | None = None,
    on_batch: OnBatch | None = None, once: bool = True,
) -> StreamingQuery:
    """Start the stream that takes judgment events into ``state``.

    ``events`` is a streaming DataFrame with the columns of ``state.rows``;
    ``known`` lists the valid records.  ``on_batch`` is called after each version.
    """
    good = split_judgments(events, known).filter("rejected IS NULL").drop("rejected")
    return run_events(good, state, checkpoint, on_batch, once)


def run_events(events: DataFrame, state: KeyedState, checkpoint: str, on_batch: OnBatch | None = None, once: bool = True) -> StreamingQuery:
    state.open(events.sparkSession)

    def take(batch: DataFrame, batch_id: int) -> None:
        state.apply(batch, batch_id)
        if on_batch:
            on_batch(state, batch_id)

    writer = events.writeStream.option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer
    return writer.foreachBatch(take).start()


def run_rejected(
    events: DataFrame, path: str, checkpoint: str, known: DataFrame | None = None, once: bool = True
) -> StreamingQuery:
    """Keep rejected events, with the reason, in a table of their own."""
    bad = split_judgments(events, known).filter("rejected IS NOT NULL")
    writer = bad.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def without_undone(state: DataFrame) -> DataFrame:
    return state.filter(F.col("geroscience").isNotNull())


def batch_state(events: DataFrame) -> DataFrame:
    """The same state from a finished log."""
    return latest_judgments(split_judgments(events).filter("rejected IS NULL").drop("rejected"))
