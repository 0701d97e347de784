"""Lexicon statistics, audits and label agreement."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab
from .lexicon import Lexicon, term_problem
from .matching import explode_hits, hits_of, int_array
from .ranking import top_k


def proxy_of(category: Column, proxies: Mapping[str, str] = vocab.PROXY_LABEL) -> Column:
    """The label a category is measured against."""
    out = category
    for c, p in proxies.items():
        out = F.when(category == c, p).otherwise(out)
    return out


def hits_by_label(df: DataFrame, text: str, label: str, lexicon: Lexicon, hits: str | None = None) -> DataFrame:
    """Long table ``(term position, label, n)`` of document counts.

    Where labels come from a join, match first and name the column of ``hits``.
    """
    matched = hits_of(df, text, lexicon, hits, F.col(label).alias("label"))
    return matched.select("label", F.explode("hits").alias("ord")).groupBy("ord", "label").agg(F.count(F.lit(1)).alias("n"))


def term_stats(df: DataFrame, text: str, label: str, lexicon: Lexicon, hits: str | None = None) -> DataFrame:
    """Hits and precision against the (proxy) category label, per term.

    Terms without a hit stay, with zeros.
    """
    counts = hits_by_label(df, text, label, lexicon, hits)
    table = lexicon.to_table(df.sparkSession).withColumn("target", proxy_of(F.col("category")))
    j = table.join(counts, "ord", "left")
    agg = j.groupBy("ord", "term", "role", "category", "lang").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("hits"),
        F.coalesce(F.sum(F.when(F.col("label") == F.col("target"), F.col("n"))), F.lit(0)).alias("target_hits"),
    )
    exact = F.when(F.col("hits") > 0, F.col("target_hits") / F.col("hits")).otherwise(0.0)
    return agg.withColumn("exact_precision", exact).withColumn("precision", F.round(exact, 3))


def false_hits(df: DataFrame, text: str, label: str, lexicon: Lexicon, record_id: str, title: str, k: int = 3,
               hits: str | None = None) -> DataFrame:
    """First k documents per term whose label is not the target."""
    matched = hits_of(df, text, lexicon, hits, record_id, label, title)
    rows = explode_hits(matched, lexicon, record_id, F.col(label).alias("label"), F.substring(title, 1, 110).alias("title"))
    wrong = rows.filter(~F.coalesce(F.col("label") == proxy_of(F.col("category")), F.lit(False)))
    slim = wrong.select("ord", "term", "category", record_id, "label", "title")
    return top_k(slim, ["ord"], [F.col(record_id)], k)


def coverage(df: DataFrame, text: str, label: str, lexicon: Lexicon, hits: str | None = None) -> DataFrame:
    """Share of a category's records that some keyword of it matches."""
    matched = hits_of(df, text, lexicon, hits, F.col(label).alias("label"))
    cats = lexicon.categories()
    cells = F.array(
        *[
            F.struct(
                F.lit(c).alias("category"),
                (F.col("label") == vocab.PROXY_LABEL.get(c, c)).alias("mine"),
                (F.size(F.array_intersect("hits", int_array(lexicon.ids("keyword", c)))) > 0).alias("hit"),
            )
            for c in cats
        ]
    )
    rows = matched.select(F.explode(cells).alias("c")).select("c.*").filter("mine")
    return rows.groupBy("category").agg(
        F.count(F.lit(1)).alias("records"), F.round(F.avg(F.col("hit").cast("double")), 3).alias("coverage")
    )


def audit_terms(stats: DataFrame, table: DataFrame, thresholds: Mapping[str, tuple[int, float]]) -> DataFrame:
    """Violations table ``(term, role, category, lang, violation)``.

    ``thresholds`` maps a language to (min_hits, min_precision); exact ratios
    are compared.  A variant skips only the hit floor.
    """
    def by_lang(i, default):
        out = F.lit(default)
        for lang, t in thresholds.items():
            out = F.when(F.col("lang") == lang, F.lit(t[i])).otherwise(out)
        return out

    keywords = table.filter("role = 'keyword'")
    parents = keywords.filter("variant_of IS NULL").select(
        "category", "lang", F.col("term").alias("variant_of"), F.lit(True).alias("parent")
    ).distinct()
    kept = keywords.select("category", "term", F.lit(True).alias("is_kept")).distinct()
    j = (
        table.join(stats.select("ord", "hits", "exact_precision"), "ord", "left")
        .join(parents, ["category", "lang", "variant_of"], "left")
        .join(kept, ["category", "term"], "left")
    )
    bad = term_problem(F.col("term"))
    fine, kw, cond = bad.isNull(), F.col("role") == "keyword", F.col("role") == "conditional"
    variant, low = F.col("variant_of").isNotNull(), F.col("hits") < vocab.LOW_EVIDENCE_HITS
    imprecise = F.col("exact_precision") < by_lang(1, 0.0)
    checks = [
        (bad.isNotNull(), F.concat(F.lit("malformed: "), bad)),
        (fine & kw & variant & F.col("parent").isNull(), F.lit("variant of no kept term")),
        (fine & kw & variant & (F.col("hits") < 1), F.lit("variant without hits")),
        (fine & kw & variant & (F.col("hits") >= 1) & imprecise, F.lit("variant below precision")),
        (fine & kw & ~variant & ((F.col("hits") < by_lang(0, 0)) | imprecise), F.lit("below threshold")),
        (fine & kw & low & ~F.coalesce(F.col("low_evidence"), F.lit(False)), F.lit("low_evidence must be true")),
        (fine & kw & ~low & F.col("low_evidence").isNotNull(), F.lit("low_evidence must be absent")),
        (fine & cond & ~F.coalesce(F.col("requires").isin("anchor", "dev_cues"), F.lit(False)), F.lit("unknown requirement")),
        (fine & cond & ~F.coalesce(F.col("weight").between(0.0, 1.0), F.lit(False)), F.lit("weight outside 0..1")),
        (fine & cond & F.coalesce(F.col("is_kept"), F.lit(False)), F.lit("already a kept keyword")),
    ]
    found = F.array_compact(F.array(*[F.when(c, m) for c, m in checks]))
    return j.select("term", "role", "category", "lang", F.explode(found).alias("violation"))


def stale_stats(stored: DataFrame, fresh: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Rows whose stored statistics differ, with the differing column names."""
    f = fresh.select(*keys, *[F.col(c).alias(f"fresh_{c}") for c in columns])
    j = stored.join(f, keys)
    differing = F.array_compact(
        F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"fresh_{c}")), F.lit(c)) for c in columns])
    )
    return j.withColumn("stale", differing).filter(F.size("stale") > 0)


def exclusion_stats(df: DataFrame, text: str, label: str, lexicon: Lexicon, hits: str | None = None) -> DataFrame:
    """Hits and undecided share of the exclusion markers; ``hits`` are positions in ``lexicon``."""
    only = lexicon.to_table(df.sparkSession).where("role = 'exclusion'")
    counts = hits_by_label(df, text, label, lexicon, hits)
    j = only.select("ord", "term").join(counts, "ord", "left")
    return j.groupBy("ord", "term").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("hits"),
        F.coalesce(F.sum(F.when(F.col("label") == "ambiguous", F.col("n"))), F.lit(0)).alias("amb"),
    ).select(
        "term", "hits", F.when(F.col("hits") > 0, F.round(F.col("amb") / F.col("hits"), 3)).otherwise(0.0).alias("ambiguous_share")
    )


def label_distribution(df: DataFrame, label: str = "label") -> DataFrame:
    return df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def legacy_agreement(df: DataFrame, label: str = "label", legacy: str = "llm_category") -> DataFrame:
    """Agreement over records whose legacy label is substantive."""
    counted = F.col(legacy).isin(vocab.CATEGORIES)
    agg = df.agg(
        F.count_if(counted).alias("compared"),
        F.count_if(counted & (F.col(label) == F.col(legacy))).alias("agreeing"),
    )
    return agg.withColumn("agreement", F.when(F.col("compared") > 0, F.round(F.col("agreeing") / F.col("compared"), 4)))


def agreement_by_label(
    df: DataFrame, label: str = "label", expert: str = "expert_label", baseline: Mapping[str, float] = vocab.BASELINE_AGREEMENT
) -> DataFrame:
    """n, agreeing and rate per predicted label and overall, beside a baseline.

    A record without an expert label counts and does not agree.
    """
    same = F.coalesce(F.col(label) == F.col(expert), F.lit(False))
    cells = df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"), F.count_if(same).alias("agreeing"))
    agg = cells.groupingSets([[F.col("label")], []], F.col("label")).agg(
        F.grouping_id().alias("gid"), F.sum("n").alias("n"), F.sum("agreeing").alias("agreeing")
    )
    name = F.when(F.col("gid") == 1, "overall").otherwise(F.col("label"))
    known = F.lit(None).cast("double")
    for k, v in baseline.items():
        known = F.when(name == k, F.lit(v)).otherwise(known)
    return agg.select(
        name.alias("label"), "n", "agreeing", F.round(F.col("agreeing") / F.col("n"), 4).alias("rate"), known.alias("baseline")
    )
