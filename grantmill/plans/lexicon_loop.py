"""Mine, validate and audit lexicon terms."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import vocab
from ..functions.text import evidence_text
from ..operators.lexicon import Lexicon, well_formed
from ..operators.lexicon_stats import agreement_by_label, audit_terms, coverage, term_stats
from ..operators.mining import as_lexicon, mine_candidates, validate_candidates
from ..operators.rules import RuleSet, classify


def mine(
    corpus: DataFrame, experts: DataFrame, rules: RuleSet, stopwords: Iterable[str], title: str = "title", quote: str = "llm_quote"
) -> DataFrame:
    """Candidates from records with an expert label the rules left undecided."""
    joined = corpus.join(experts.select("record_id", F.col("expert_label").alias("expert")), "record_id")
    labelled = classify(joined, title, quote, rules).select(
        "record_id", F.col(title).alias("title"), "expert", "label",
        F.concat(F.coalesce(F.col(title), F.lit("")), F.lit(" "), F.coalesce(F.col(quote), F.lit(""))).alias("text"),
        F.col("amount_eur").try_cast("double").alias("amount"),
    )
    return mine_candidates(labelled, rules.lexicon, stopwords)


def gate(
    candidates: DataFrame, corpus: DataFrame, experts: DataFrame, undecided: DataFrame,
    thresholds: Mapping[str, tuple[int, float]], per_category: int = 60,
) -> DataFrame:
    """Two-gate validation of a mined candidate table.

    The table holds at most ``per_category`` terms per category, so its terms
    fit on the driver; more than that is refused.
    """
    limit = per_category * len(vocab.CATEGORIES)
    rows = candidates.select("term", "category", "is_trap").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} candidates")
    lex = as_lexicon(r.asDict() for r in rows)
    labelled = corpus.join(experts.select("record_id", F.col("expert_label").alias("expert")), "record_id", "left").select(
        evidence_text(F.col("title"), F.col("llm_quote")).alias("text"), F.col("llm_category").alias("legacy"), "expert"
    )
    census = undecided.select(
        evidence_text(F.col("title"), F.col("abstract")).alias("text"), F.col("amount_eur").cast("double").alias("amount")
    )
    decided = validate_candidates(lex, labelled, census, thresholds)
    return decided.join(candidates.select("category", "term", "example_record_id", "context"), ["category", "term"], "left")


def audit(corpus: DataFrame, table: DataFrame, thresholds: Mapping[str, tuple[int, float]]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Fresh statistics, category coverage and violations of a term table."""
    lex = Lexicon.from_table(well_formed(table))
    text = corpus.select(evidence_text(F.col("title"), F.col("llm_quote")).alias("text"), "llm_category")
    stats = term_stats(text, "text", "llm_category", lex)
    full = table.join(stats.select("term", "role", "category", "lang", "hits", "exact_precision").withColumn("ok", F.lit(True)),
                      ["term", "role", "category", "lang"], "left")
    keyed = table.withColumn("ord", F.col("ord"))
    violations = audit_terms(full.select("ord", "hits", "exact_precision"), keyed, thresholds)
    return stats, coverage(text, "text", "llm_category", lex), violations


def accept(corpus: DataFrame, experts: DataFrame, rules: RuleSet) -> DataFrame:
    """Agreement of the rules with the expert labels."""
    labelled = classify(corpus, "title", "llm_quote", rules).select("record_id", "label")
    return agreement_by_label(labelled.join(experts.select("record_id", "expert_label"), "record_id", "left"))
