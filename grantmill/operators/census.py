"""The simpler census labeller and its per-source summary."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.money import MONEY
from ..functions.text import evidence_text, fence
from .lexicon import Lexicon
from .matching import int_array, literal, match_terms, term_names
from .ranking import top_k


def label_census(df: DataFrame, title: str, body: str, lexicon: Lexicon) -> DataFrame:
    """Highest category score wins, the earlier category on a tie.

    Anchors count in English only.  Without any score, exclusion hits make a
    record not_relevant and anything else ambiguous.
    """
    base, cats = df.columns, lexicon.categories()
    df = df.withColumn("_t", evidence_text(F.col(title), F.col(body)))
    df = match_terms(df, "_t", lexicon, "_h")
    df = df.withColumn(
        "anchor_matched", F.size(F.array_intersect("_h", int_array(lexicon.ids("anchor", lang="en")))) > 0
    )
    allowed = F.when(F.col("anchor_matched"), int_array(lexicon.ids("keyword"))).otherwise(
        int_array(lexicon.ids("keyword", requires=None))
    )
    df = df.withColumn("_kw", fence(F.array_intersect("_h", allowed)))
    weights = literal([float(t.weight or 0.0) for t in lexicon.terms], "double")

    def score(ids):
        return F.round(F.aggregate(ids, F.lit(0.0), lambda a, i: a + F.element_at(weights, i + 1)), 3)

    df = df.withColumn(
        "_scores",
        F.array(
            *[
                F.struct(
                    score(F.array_intersect("_kw", int_array(lexicon.ids("keyword", c)))).alias("score"),
                    F.lit(-i).alias("rank"),
                    F.lit(c).alias("category"),
                )
                for i, c in enumerate(cats)
            ]
        ),
    ).withColumn("_best", F.array_max("_scores"))
    flags = term_names(F.col("_h"), lexicon, lexicon.ids("exclusion"))

    def per_category(hits, role):
        return F.map_from_entries(
            F.array(
                *[
                    F.struct(F.lit(c).alias("key"), term_names(hits, lexicon, lexicon.ids(role, c)).alias("value"))
                    for c in cats
                ]
            )
        )

    return df.select(
        *base,
        F.when(F.col("_best.score") > 0, F.col("_best.category"))
        .when(F.size(flags) > 0, "not_relevant").otherwise("ambiguous").alias("rule_category"),
        F.col("_best.score").alias("rule_score"),
        "anchor_matched",
        per_category(F.col("_kw"), "keyword").alias("matched_terms"),
        per_category(F.col("_h"), "trap").alias("trap_terms"),
        flags.alias("exclusion_flags"),
    )


def summarise_census(labelled: DataFrame, amount: str = "amount_eur") -> DataFrame:
    """Counts and money per source and category, with the source's flags."""
    from pyspark.sql import Window

    cells = labelled.groupBy("source", "rule_category").agg(
        F.count(F.lit(1)).alias("records"),
        F.coalesce(F.sum(F.col(amount).cast(MONEY)), F.lit(0)).cast("double").alias("amount_eur"),
        F.count_if("anchor_matched").alias("anchor_matched"),
        F.count_if(F.size("exclusion_flags") > 0).alias("exclusion_flagged"),
        F.count_if(F.coalesce(F.col("broad_only"), F.lit(False))).alias("broad_only_records"),
    )
    w = Window.partitionBy("source")  # at most one row per category
    return cells.withColumn("source_records", F.sum("records").over(w))


def top_terms(labelled: DataFrame, k: int = 20, by: Sequence[str] = ("source",)) -> DataFrame:
    """Most frequent ``category/term`` pairs per source."""
    pairs = labelled.select(*by, F.explode("matched_terms").alias("category", "terms")).select(
        *by, "category", F.explode("terms").alias("term")
    )
    counts = pairs.groupBy(*by, "category", "term").agg(F.count(F.lit(1)).alias("n"))
    return top_k(counts, list(by), [F.desc("n"), F.col("category"), F.col("term")], k)
