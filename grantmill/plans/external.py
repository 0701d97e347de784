"""External human-coded benchmark and negative control."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import awards as aw


def benchmark(awards: DataFrame, predict=None) -> dict[str, DataFrame]:
    scoreable = aw.ground_truth(awards).filter(~aw.is_redacted(aw.award_text()))
    profile = aw.apportioned_profile(scoreable, "activity_groups", "value_gbp")
    return {
        "coverage": aw.coverage_counts(awards),
        "scores": aw.score_awards(awards, predict),
        "profile": profile,
        "sides": aw.profile_sides(profile),
    }


def control(awards: DataFrame, classify: Callable[[DataFrame], DataFrame]) -> dict[str, DataFrame]:
    """``classify`` adds label and matched_keywords to (title, abstract) rows."""
    scoreable = aw.ground_truth(awards).filter(~aw.is_redacted(aw.award_text()))
    labelled = classify(scoreable)
    return {
        "labels": labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n")),
        "summary": aw.negative_control(labelled),
        "drivers": aw.keyword_drivers(labelled),
        "suspicious": aw.suspicious(labelled, "health_categories"),
    }
