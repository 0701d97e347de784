"""The table flow around an external adjudicator."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import vocab
from ..functions.text import squeeze, strip, strip
from .matching import quote_found
from .overlay import pending
from .ranking import largest


def work_queue(labels: DataFrame, done: DataFrame, census: DataFrame, region: str | None = None,
               ids: Sequence[str] | None = None, limit: int | None = None) -> DataFrame:
    """Records to adjudicate with their text, largest amount first."""
    todo = labels.filter(F.col("record_id").isin(list(ids))) if ids else pending(labels, done, region)
    amount = F.coalesce(F.col("amount_eur"), F.lit(0))
    slim = todo.select("record_id", amount.alias("amount_eur")).join(census.select("record_id", "title", "abstract"), "record_id")
    order = [F.desc("amount_eur"), F.col("record_id")]
    return slim.orderBy(*order) if limit is None else largest(slim, order, limit)


def prompt(df: DataFrame, template: str, limit: int = vocab.PROMPT_ABSTRACT_LIMIT) -> DataFrame:
    """One request text per record; ``template`` has %s for id, title, abstract."""
    body = F.coalesce("abstract", F.lit(""))
    cut = F.when(F.length(body) > limit, F.concat(F.substring(body, 1, limit), F.lit("..."))).otherwise(body)
    return df.withColumn("prompt", F.format_string(template, F.col("record_id").cast("string"), F.col("title"), cut))


RESPONSE = "label STRING, quote STRING, confidence STRING, reason STRING"


def parse_response(df: DataFrame, content: str = "content", schema: str = RESPONSE) -> DataFrame:
    """Parsed fields of a reply; an unreadable one becomes an error row that
    stays ambiguous."""
    text = strip(F.col(content))
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)
    body = F.when(fenced != "", fenced).otherwise(text)
    braces = F.regexp_extract(body, r"(?s)(\{.*\})", 1)
    parsed = F.from_json(braces, schema + ", __corrupt STRING", {"columnNameOfCorruptRecord": "__corrupt"})
    ok = (braces != "") & parsed.isNotNull() & parsed["__corrupt"].isNull()
    return df.withColumn("__p", F.when(ok, parsed)).withColumns(
        {
            "label": F.coalesce("__p.label", F.lit("ambiguous")),
            "quote": F.coalesce("__p.quote", F.lit("")),
            "confidence": F.coalesce("__p.confidence", F.when(F.col("__p").isNull(), "low")),
            "reason": F.coalesce("__p.reason", F.when(F.col("__p").isNull(), "no readable answer")),
            "error": F.when(F.col("__p").isNull(), "unreadable answer"),
        }
    ).drop("__p")


def check_quotes(answers: DataFrame, sources: DataFrame, key: str = "record_id") -> DataFrame:
    """``quote_valid`` against the record's own title and abstract."""
    src = sources.select(key, F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("abstract", F.lit(""))).alias("__src"))
    j = answers.join(src, key, "left")
    return j.withColumn("quote_valid", F.coalesce(quote_found(F.col("quote"), F.col("__src")), F.lit(False))).drop("__src")


def run_tally(answers: DataFrame) -> DataFrame:
    return answers.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("quote_valid").alias("valid_quotes"), F.count_if(F.col("error").isNotNull()).alias("errors")
    )


def verify(answers: DataFrame, sources: DataFrame, labels: Sequence[str] = tuple(vocab.LABELS), key: str = "record_id") -> DataFrame:
    """Per answer: what is wrong with it, and whether the quote is exact.

    Duplicates are found by a count per record, joined back.
    """
    src = sources.select(key, F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("abstract", F.lit(""))).alias("__src"))
    counts = answers.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    j = answers.join(counts, key).join(src, key, "left")
    here = F.col("__src").isNotNull()
    quote = strip(squeeze(F.coalesce("quote", F.lit(""))))
    missing = F.coalesce((quote == "") | ~F.contains(squeeze(F.col("__src")), quote), F.lit(True))
    found = F.array_compact(F.array(
        F.when(F.col("__n") > 1, "duplicate"),
        F.when(~here, "no source record"),
        F.when(here & ~F.coalesce(F.col("label").isin(list(labels)), F.lit(False)), "unknown label"),
        F.when(here & missing, "quote not found"),
    ))
    return j.withColumn("violations", found).withColumn(
        "exact", F.coalesce(F.contains(F.col("__src"), F.coalesce("quote", F.lit(""))), F.lit(False))
    ).drop("__n", "__src")


def label_counts(verified: DataFrame) -> DataFrame:
    """Answers with a source record by label, the most frequent first."""
    known = verified.filter(~F.array_contains("violations", "no source record"))
    return known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label")


def verification_report(verified: DataFrame, key: str = "record_id") -> DataFrame:
    """Totals of ``verify``: of the rows of one id all but one are duplicates, and a
    row without a source is never resolved, whatever its label."""
    has = lambda v: F.count_if(F.array_contains("violations", v))
    return verified.agg(
        F.count(F.lit(1)).alias("answers"), (F.count(F.lit(1)) - F.count_distinct(F.coalesce(F.col(key).cast("string"), F.lit("")))).alias("duplicates"), has("no source record").alias("missing_source"),
        has("unknown label").alias("unknown_label"), has("quote not found").alias("quote_missing"),
        F.count_if("exact").alias("case_exact"), F.count_if((F.col("label") != "ambiguous") & ~F.array_contains("violations", "no source record")).alias("resolved"),
    )

