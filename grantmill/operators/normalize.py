"""Raw funder rows to the canonical census record; deduplication; funnel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab
from ..functions.dates import in_window, leading_year
from ..functions.money import comma_decimal, plain_decimal, to_eur
from ..functions.text import evidence_text, first_non_empty, strip, title_key, url_quote
from .matching import net_filter
from .ranking import keep_one


def dedupe_collect(df: DataFrame, keys: Sequence[str], order: str, phrase: str, out: str = "phrases") -> DataFrame:
    """First row per key with the sorted set of phrases seen for it.

    The set is bounded by the search net; partial sets merge map-side.
    """
    rest = [c for c in df.columns if c not in (*keys, phrase)]
    return (
        df.groupBy(*keys)
        .agg(F.min_by(F.struct(*rest), F.col(order)).alias("__r"), F.array_sort(F.collect_set(phrase)).alias(out))
        .select(*keys, "__r.*", out)
    )


def dedupe_prefer_parent(df: DataFrame, key: str, order: str, child: str, phrase: str, out: str = "phrases") -> DataFrame:
    """Like ``dedupe_collect``, but the first row without a child id wins."""
    is_child = F.coalesce(F.col(child).cast("string") != "", F.lit(False))
    rest = [c for c in df.columns if c not in (key, phrase)]
    pick = F.min_by(F.struct(*rest), F.struct(is_child.alias("c"), F.col(order).alias("o")))
    return (
        df.groupBy(key).agg(pick.alias("__r"), F.array_sort(F.collect_set(phrase)).alias(out)).select(key, "__r.*", out)
    )


def dedupe_last(df: DataFrame, key: str, order: str) -> DataFrame:
    return keep_one(df, [key], [F.col(order)], last=True)


def dedupe_title(df: DataFrame, source: str, title: str, order: str) -> DataFrame:
    """One row per source and normalised title, the first by ``order``."""
    keyed = df.withColumn("title_key", title_key(F.col(title)))
    return keep_one(keyed, [source, "title_key"], [F.col(order)])


def rename_collisions(df: DataFrame, native: str, suffix: str, order: str, prefix: str, out: str = "record_id") -> DataFrame:
    """``prefix:native`` for the first row of an id, ``prefix:native:suffix``
    for the others.  The first is found by an aggregate and joined back, so
    the many rows of one id never share a sort."""
    first = df.groupBy(native).agg(F.min(order).alias("__first"))
    base = F.concat(F.lit(f"{prefix}:"), F.col(native).cast("string"))
    renamed = F.concat(base, F.lit(":"), F.col(suffix).cast("string"))
    return (
        df.join(first, native)
        .withColumn(out, F.when(F.col(order) == F.col("__first"), base).otherwise(renamed))
        .drop("__first")
    )


def first_lookup(df: DataFrame, key: str, value: str, order: str, where: Column) -> DataFrame:
    """First value per key among the rows that qualify."""
    return df.filter(where).groupBy(key).agg(F.min_by(F.col(value), F.col(order)).alias(value))


def only_broad(phrases: Column, broad: Sequence[str] = vocab.BROAD_ONLY_PHRASES) -> Column:
    """True when nothing but broad phrases matched."""
    return F.size(F.array_except(phrases, F.array(*[F.lit(b) for b in broad]))) == 0


def _census(source: str, **c: Column) -> list[Column]:
    extras = c.pop("extra")
    names = [
        ("matched_phrases", "array<string>"), ("funder_type", "string"), ("coordinating_organisation", "string"),
        ("programme", "string"), ("acronym", "string"), ("status", "string"), ("total_cost", "double"),
        ("organization", "string"), ("activity_code", "string"), ("subproject_id", "string"), ("broad_only", "boolean"),
    ]
    extra = F.struct(*[extras.get(n, F.lit(None)).cast(t).alias(n) for n, t in names])
    return [
        c["record_id"].alias("record_id"), F.lit(source).alias("source"), c["source_id"].cast("string").alias("source_id"),
        c["title"].alias("title"), F.substring(c["abstract"], 1, vocab.ABSTRACT_LIMIT).alias("abstract"),
        c["funder"].alias("funder"), c["country"].alias("country"), c["year"].cast("int").alias("year"),
        c["amount"].alias("amount"), F.lit(c["currency"]).alias("currency"),
        to_eur(c["amount"], F.lit(c["currency"])).alias("amount_eur"), F.lit(vocab.FX_DATE).alias("fx_date"),
        c["url"].alias("url"), extra.alias("extra"), c["retrieved"].cast("string").alias("retrieved_at"),
    ]


def swecris(raw: DataFrame, retrieved_at: str, order: str = "ord", phrase: str = "phrase") -> DataFrame:
    """Deduplicate by funding row, drop broad-only and out-of-window rows."""
    keys = ["ProjectId", "FundingOrganisationId", "FundingStartDate"]
    unique = dedupe_collect(raw, keys, order, phrase)
    year = leading_year(F.col("FundingStartDate"))
    title = first_non_empty(F.col("ProjectTitleEn"), F.col("ProjectTitleSv"))
    kept = unique.filter(
        ~only_broad(F.col("phrases")) & in_window(year, vocab.FIRST_YEAR, vocab.LAST_YEAR) & (title != "")
    )
    named = rename_collisions(kept, "ProjectId", "FundingOrganisationId", order, "swecris")
    quoted = url_quote(F.col("ProjectId"))
    return named.select(
        *_census(
            "swecris", record_id=F.col("record_id"), source_id=F.col("ProjectId"), title=title,
            abstract=first_non_empty(F.col("ProjectAbstractEn"), F.col("ProjectAbstractSv")),
            funder=first_non_empty(F.col("FundingOrganisationNameEn"), F.col("FundingOrganisationNameSv")),
            country=F.lit("SE"), year=year, amount=plain_decimal(F.col("FundingsSek")), currency="SEK",
            url=F.concat(F.lit("https://www.vr.se/english/swecris.html?searchText="), quoted),
            retrieved=F.lit(retrieved_at),
            extra={
                "matched_phrases": F.col("phrases"),
                "funder_type": first_non_empty(F.col("FundingOrganisationTypeOfOrganisationEn")),
                "coordinating_organisation": first_non_empty(F.col("CoordinatingOrganisationNameEn")),
            },
        )
    )


def cordis(
    projects: DataFrame, organisations: DataFrame, phrases: Sequence[str], retrieved_at: str,
    order: str = "programme_ord", org_order: str = "ord",
) -> DataFrame:
    """Net-matched projects, last programme wins, coordinator country attached."""
    texted = projects.withColumn("__t", evidence_text(F.col("title"), F.col("objective")))
    matched = dedupe_last(net_filter(texted, "__t", phrases, "phrases").drop("__t"), "id", order)
    country = first_lookup(
        organisations.select(F.col("projectID").alias("id"), strip(F.col("country")).alias("country"), "role", org_order),
        "id", "country", org_order,
        (F.lower(strip(F.col("role"))) == "coordinator") & (F.col("id") != ""),
    )
    year = leading_year(strip(F.col("startDate")))
    kept = matched.filter(in_window(year, vocab.FIRST_YEAR, vocab.LAST_YEAR)).join(country, "id", "left")
    text = lambda c: first_non_empty(F.col(c))
    return kept.select(
        *_census(
            "cordis", record_id=F.concat(F.lit("cordis:"), F.col("id")), source_id=F.col("id"), title=text("title"),
            abstract=text("objective"), funder=F.lit("European Commission"), country=F.coalesce("country", F.lit("")),
            year=year, amount=comma_decimal(F.col("ecMaxContribution")), currency="EUR",
            url=F.concat(F.lit("https://cordis.europa.eu/project/id/"), F.col("id")), retrieved=F.lit(retrieved_at),
            extra={
                "matched_phrases": F.col("phrases"), "programme": F.col("programme"), "acronym": text("acronym"),
                "status": text("status"), "total_cost": comma_decimal(F.col("totalCost")),
            },
        )
    )


def reporter(raw: DataFrame, retrieved_at: str, order: str = "ord", phrase: str = "phrase") -> DataFrame:
    """Deduplicate by project number preferring the parent row; needs an abstract."""
    unique = dedupe_prefer_parent(raw.filter(F.col("project_num") != ""), "project_num", order, "subproject_id", phrase)
    abstract = first_non_empty(F.col("abstract_text"))
    agency = F.coalesce(F.when(F.col("agency_ic_admin.name") != "", F.col("agency_ic_admin.name")), F.lit("NIH"))
    return unique.filter(abstract != "").select(
        *_census(
            "reporter", record_id=F.concat(F.lit("reporter:"), F.col("project_num")), source_id=F.col("project_num"),
            title=first_non_empty(F.col("project_title")), abstract=abstract, funder=strip(agency), country=F.lit("US"),
            year=F.col("fiscal_year"), amount=F.col("award_amount"), currency="USD",
            url=F.concat(F.lit("https://reporter.nih.gov/project-details/"), F.col("project_num")),
            retrieved=F.lit(retrieved_at),
            extra={
                "matched_phrases": F.col("phrases"), "organization": first_non_empty(F.col("organization.org_name")),
                "activity_code": F.col("activity_code"), "subproject_id": F.col("subproject_id"),
            },
        )
    )


def union_sources(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def funnel(df: DataFrame, source: str, stages: dict[str, Column]) -> DataFrame:
    """Stage counts ``(source, stage, n)`` from one pass over the data."""
    agg = df.groupBy(F.col(source).alias("source")).agg(
        *[F.count_if(F.coalesce(c, F.lit(False))).alias(s) for s, c in stages.items()]
    )
    cells = F.array(*[F.struct(F.lit(s).alias("stage"), F.col(s).alias("n")) for s in stages])
    return agg.select("source", F.explode(cells).alias("c")).select("source", "c.stage", "c.n")


def phrase_ledger(df: DataFrame, groups: dict[str, Sequence[str]], phrases: str = "matched_phrases") -> DataFrame:
    """Rows per (tier group, phrase); a phrase may sit in several groups."""
    tier = F.array(*[F.when(F.col("phrase").isin(list(p)), F.lit(g)) for g, p in groups.items()])
    return (
        df.select(F.explode(phrases).alias("phrase"))
        .groupBy("phrase").agg(F.count(F.lit(1)).alias("rows"))
        .select(F.explode(F.array_compact(tier)).alias("tier"), "phrase", "rows")
    )
