"""Blind labelling study: draw, serve blind, summarise, export."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import fingerprint
from ..operators import agreement
from ..operators.sampling import quota_sample


def draw_batch(labels: DataFrame, census: DataFrame, experts: DataFrame, size: int, seed: int) -> DataFrame:
    """Batch rows with what the labeller sees and a ``_hidden`` struct."""
    text = census.select("record_id", "title", "abstract", "funder", "year", "amount_eur", "url", "source")
    e = experts.select("record_id", "expert_label", F.col("reason").alias("expert_reason"))
    pool = labels.select("record_id", "label", "reason").join(text, "record_id").join(e, "record_id", "left")
    drawn = quota_sample(pool, size, seed)
    return pool.join(drawn, "record_id").select(
        "record_id", "title", "abstract", "funder", "year", "amount_eur", "url", "source",
        fingerprint(F.col("record_id"), F.col("title"), F.col("abstract")).alias("fingerprint"),
        F.struct(
            "stratum", F.col("label").alias("classifier_label"), F.col("reason").alias("classifier_reason"),
            F.coalesce("expert_label", F.lit("")).alias("expert_label"),
            F.coalesce("expert_reason", F.lit("")).alias("expert_reason"),
        ).alias("_hidden"),
    )


def results(batch: DataFrame, judgments: DataFrame) -> dict[str, DataFrame]:
    """Contested ranking, coverage, agreement, kappa, classifier comparison."""
    flat = batch.withColumn("label", F.col("_hidden.classifier_label"))
    rows = agreement.per_record(flat, judgments)
    return {
        "contested": agreement.contested_ranking(rows.withColumn("amount_eur", F.coalesce("amount_eur", F.lit(0)))).orderBy("rank"),
        "coverage": agreement.study_coverage(batch, judgments),
        "observed_agreement": agreement.observed_agreement(judgments),
        "fleiss_kappa": agreement.fleiss_kappa(judgments),
        "classifier": agreement.classifier_comparison(rows),
    }


def export(batch: DataFrame, judgments: DataFrame) -> DataFrame:
    """Judgments beside their batch record; records without any stay."""
    return batch.select("record_id", "title", "funder", "year").join(judgments, "record_id", "left")
