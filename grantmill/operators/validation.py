"""Validation reports: every check is a column, every violation a row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab
from ..functions.hashing import fingerprint
from ..functions.text import explode_once, is_slug

ID, COUNTRY = r"^[a-z]{2}-[0-9]{3}\z", r"^[A-Z]{2}\z"
DATE = r"^\d{4}(-\d{2}(-\d{2})?)?\z"
TIMESTAMP = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(Z|[+-]\d{2}:\d{2})\z"


def _like(c: Column, pattern: str) -> Column:
    return F.coalesce(c.rlike(pattern), F.lit(False))


def _in(c: Column, values: Sequence[str]) -> Column:
    return F.coalesce(c.isin(list(values)), F.lit(False))


def _report(checks: Sequence[tuple[Column, str | Column]]) -> Column:
    return F.array_compact(
        F.array(*[F.when(bad, F.lit(m) if isinstance(m, str) else m) for bad, m in checks])
    )


def finding_violations(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Violations of finding records given as JSON text in ``raw``.

    The raw object is inspected, so unexpected fields and non-text values show.
    """
    r = F.col(raw)
    # one parse per record; values of any JSON type arrive as text
    df = df.withColumn("__m", F.from_json(r, "map<string,string>"))
    keys, text = F.map_keys("__m"), lambda n: F.try_element_at("__m", F.lit(n))
    # where a number or object could pass for text, look at the raw value
    quoted = lambda n: F.when(r.rlike(rf'"{n}"\s*:\s*"'), text(n))
    kind, fid, country = text("type"), text("id"), text("country")
    finding = F.coalesce(kind == "finding", F.lit(False))
    required = F.when(finding, F.array(*map(F.lit, vocab.FINDING_REQUIRED))).otherwise(F.array(*map(F.lit, vocab.NOTHING_REQUIRED)))
    allowed = F.when(finding, F.array(*map(F.lit, vocab.FINDING_REQUIRED + vocab.FINDING_OPTIONAL))).otherwise(
        F.array(*map(F.lit, vocab.NOTHING_REQUIRED + vocab.NOTHING_OPTIONAL))
    )
    both = _like(fid, ID) & _like(country, COUNTRY)
    claim = F.coalesce(quoted("claim"), F.lit(""))
    fixed = _report([
        (~_in(kind, ["finding", "nothing_reliable_found"]), "bad type"),
        (~_like(fid, ID), "bad id"),
        (~_like(country, COUNTRY), "bad country"),
        (both & (F.substring(fid, 1, 2) != F.lower(country)), "id does not match country"),
        (~_like(text("retrieved_at"), TIMESTAMP), "bad retrieved_at"),
        (finding & ~_in(text("classification"), list(vocab.CLASS_WEIGHT)), "bad classification"),
        (finding & ~_in(text("confidence"), list(vocab.CONFIDENCE_WEIGHT)), "bad confidence"),
        (finding & ~F.length(claim).between(20, 700), "claim length"),
        (finding & ~F.startswith(F.coalesce(text("source_url"), F.lit("")), F.lit("https://")), "source_url must be https"),
        (finding & ~_like(quoted("source_date"), DATE), "bad source_date"),
        (~finding & (F.length(F.coalesce(quoted("search_note"), F.lit(""))) < 20), "search_note too short"),
    ])
    missing = F.transform(F.array_except(required, keys), lambda k: F.concat(F.lit("missing field "), k))
    extra = F.transform(F.array_except(keys, allowed), lambda k: F.concat(F.lit("unexpected field "), k))
    listed = F.when(keys.isNull(), F.array(F.lit("not an object"))).otherwise(F.concat(missing, extra, fixed))
    return df.withColumn("violation", explode_once(listed)).drop("__m")


def verdict_violations(df: DataFrame, key: str = "key") -> DataFrame:
    """Violations of finding verdicts: ``key`` plus the verdict's fields.

    ``checks`` is map<string, string> holding the JSON text of each value.
    """
    value = lambda c: F.try_element_at("checks", F.lit(c))
    ok_values = [value(c).isNull() | value(c).isin("true", "false", "null") for c in vocab.FINDING_CHECKS]
    reviewed, correct = F.lit(True), F.lit(True)
    for c in vocab.FINDING_CHECKS:
        reviewed = reviewed & F.coalesce(value(c) != "null", F.lit(False))
        correct = correct & F.coalesce(value(c) == "true", F.lit(False))
    bad = _report([
        (~F.col("finding_id").eqNullSafe(F.col(key)), "finding_id mismatch"),
        *[(~ok, f"bad check {c}") for ok, c in zip(ok_values, vocab.FINDING_CHECKS)],
        (~F.col("reviewed").eqNullSafe(reviewed), "reviewed flag inconsistent"),
        (~F.col("correct").eqNullSafe(reviewed & correct), "correct flag inconsistent"),
    ])
    return df.withColumn("violation", explode_once(bad))


JUDGE_FIELDS = ["verdict", "reason"]
JUDGE_EXTRAS = {"recency": ["newer_source"], "classification": ["proposed_classification"]}


def judge_mark_violations(df: DataFrame, key: str = "key", raw: str = "raw") -> DataFrame:
    """Violations of judge marks given as JSON text in ``raw``."""
    r = F.col(raw)
    keys = F.json_object_keys(r)
    need = F.array(*map(F.lit, ["finding_id", "finding_fingerprint", "judged_at", "judges"]))
    judges = F.from_json(F.get_json_object(r, "$.judges"), "map<string,string>")
    dims = F.array(*map(F.lit, sorted(vocab.FINDING_JUDGE_DIMENSIONS)))

    def of_dimension(dim: Column, g: Column) -> Column:
        fields = F.json_object_keys(g)
        extra = F.lit(None).cast("array<string>")
        for d, e in JUDGE_EXTRAS.items():
            extra = F.when(dim == d, F.array(*map(F.lit, JUDGE_FIELDS + e))).otherwise(extra)
        allowed = F.coalesce(extra, F.array(*map(F.lit, JUDGE_FIELDS)))
        newer, proposed = F.get_json_object(g, "$.newer_source"), F.get_json_object(g, "$.proposed_classification")
        url, date = F.get_json_object(g, "$.newer_source.url"), F.get_json_object(g, "$.newer_source.date")
        has = newer.isNotNull()
        fixed = _report([
            (~_in(F.get_json_object(g, "$.verdict"), vocab.JUDGE_VERDICTS), "bad verdict"),
            (~_like(F.get_json_object(g, "$.reason"), r"\S"), "empty reason"),
            (has & ~F.coalesce(F.array_sort(F.json_object_keys(newer)) == F.array(F.lit("date"), F.lit("url")), F.lit(False)), "newer_source needs url and date"),
            (has & ~F.startswith(F.coalesce(url, F.lit("")), F.lit("https://")), "newer_source url must be https"),
            (has & ~_like(date, DATE), "bad newer_source date"),
            (proposed.isNotNull() & ~_in(proposed, list(vocab.CLASS_WEIGHT)), "bad proposed_classification"),
        ])
        parts = F.concat(
            F.transform(F.array_except(F.array(*map(F.lit, JUDGE_FIELDS)), fields), lambda k: F.concat(F.lit("missing field "), k)),
            F.transform(F.array_except(fields, allowed), lambda k: F.concat(F.lit("unexpected field "), k)),
            fixed,
        )
        listed = F.when(fields.isNull(), F.array(F.lit("not an object"))).otherwise(parts)
        return F.transform(listed, lambda m: F.concat(dim, F.lit(": "), m))

    nested = F.flatten(F.transform(F.map_entries(judges), lambda e: of_dimension(e["key"], e["value"])))
    bad = F.concat(
        F.transform(F.array_except(need, keys), lambda k: F.concat(F.lit("missing field "), k)),
        F.transform(F.array_except(keys, need), lambda k: F.concat(F.lit("unexpected field "), k)),
        _report([
            (~F.get_json_object(r, "$.finding_id").eqNullSafe(F.col(key)), "finding_id mismatch"),
            (~_like(F.get_json_object(r, "$.judged_at"), TIMESTAMP), "bad judged_at"),
            (~F.coalesce(F.array_sort(F.map_keys(judges)) == dims, F.lit(False)), "judges must cover every dimension"),
        ]),
        F.coalesce(nested, F.array().cast("array<string>")),
    )
    return df.withColumn("violation", explode_once(F.when(keys.isNull(), F.array(F.lit("not an object"))).otherwise(bad)))


def duplicate_ids(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def referential_report(records: DataFrame, attestations: DataFrame, key: str = "record_id") -> DataFrame:
    """Duplicate ids, attestations to unknown ids, and stale attestations."""
    dup = duplicate_ids(records, key).select(F.col(key).cast("string").alias("id"), F.lit("duplicate id").alias("violation"))
    current = records.groupBy(key).agg(F.min("fingerprint").alias("__fp"), F.lit(True).alias("__here"))
    j = attestations.join(current, key, "left")
    problem = F.when(F.col("__here").isNull(), "unknown id").when(
        ~F.col("record_fingerprint").eqNullSafe(F.col("__fp")), "stale fingerprint"
    )
    bad = j.select(F.col(key).cast("string").alias("id"), problem.alias("violation")).filter("violation IS NOT NULL")
    return dup.unionByName(bad)


def misfiled(df: DataFrame, slug: str, country: str, expected: dict[str, str]) -> DataFrame:
    """Records whose country is not the one their file stands for."""
    want = F.lit(None).cast("string")
    for s, c in expected.items():
        want = F.when(F.col(slug) == s, c).otherwise(want)
    problem = F.when(want.isNull(), "unknown file").when(~F.col(country).eqNullSafe(want), "misfiled")
    return df.withColumn("violation", problem).filter("violation IS NOT NULL")


def label_file_violations(df: DataFrame, required: Sequence[str], label: str = "label", key: str = "record_id") -> DataFrame:
    """Missing fields, unknown labels and repeated ids of a label table."""
    have = set(df.columns)
    absent = [c for c in required if c not in have]
    if absent:
        raise ValueError(f"label table lacks {absent}")
    bad = _report([
        *[(F.col(c).isNull(), f"missing {c}") for c in required],
        (~_in(F.col(label), vocab.LABELS), F.concat(F.lit("unknown label "), F.coalesce(F.col(label), F.lit("<null>")))),
    ])
    rows = df.select(F.col(key).cast("string").alias("id"), F.explode(bad).alias("violation"))
    dup = duplicate_ids(df, key).select(F.col(key).cast("string").alias("id"), F.lit("duplicate id").alias("violation"))
    return rows.unionByName(dup)


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    absent = sorted(set(columns) - set(df.columns))
    if absent:
        raise ValueError(f"missing column(s) {absent}")
    return df


def require_rows(df: DataFrame, expected: int) -> DataFrame:
    """Fail when the row count is not the expected one (one count job)."""
    n = df.count()
    if n != expected:
        raise ValueError(f"expected {expected} rows, got {n}")
    return df


def with_fingerprint(df: DataFrame, *columns: str, out: str = "fingerprint") -> DataFrame:
    return df.withColumn(out, fingerprint(*[F.col(c) for c in columns]))


def split_judgments(df: DataFrame, known: DataFrame | None = None, answers: Sequence[str] = tuple(vocab.ANSWERS)) -> DataFrame:
    """Incoming judgments with the reason for rejecting one (null = accepted)."""
    problem = (
        F.when(~is_slug(F.col("labeller_id"), 64), "labeller_id must be a slug")
        .when(F.col("geroscience").isNotNull() & ~_in(F.col("geroscience"), answers), "unknown answer")
    )
    if known is None:
        return df.withColumn("rejected", problem)
    here = known.select("record_id", F.lit(True).alias("__here"))
    j = df.join(here, "record_id", "left")
    return j.withColumn("rejected", F.coalesce(problem, F.when(F.col("__here").isNull(), "unknown record"))).drop("__here")


def population_digest(df: DataFrame, first: str, second: str) -> DataFrame:
    """Order-free digest of an id list, from per-row hashes."""
    from ..functions.hashing import table_digest

    return table_digest(df, first, second)


def drifted(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """True when a stored digest no longer matches its inputs."""
    return fresh.select((~F.col("digest").eqNullSafe(stored.select("digest").scalar())).alias("drifted"))


def changed_parts(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """``(part, stored_rows, fresh_rows)`` of the parts whose digests differ; a part that one side lacks has 0 rows there."""
    rows = lambda df, name: df.select("part", F.col("n_rows").alias(f"{name}_rows"), F.col("digest").alias(name))
    both = rows(stored, "stored").join(rows(fresh, "fresh"), "part", "full")
    return both.filter(~F.col("stored").eqNullSafe(F.col("fresh"))).select(
        "part", F.coalesce("stored_rows", F.lit(0)).alias("stored_rows"), F.coalesce("fresh_rows", F.lit(0)).alias("fresh_rows"))


def require_unchanged(df: DataFrame, stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """``df``, which fails to be read where the digests of its inputs changed; the error names the parts."""
    names = changed_parts(stored, fresh).agg(F.array_sort(F.collect_list("part")).alias("parts"))  # at most one entry a part
    failed = F.raise_error(F.concat(F.lit("inputs changed in parts "), F.array_join(F.col("__parts").cast("array<string>"), ",")))
    checked = df.crossJoin(F.broadcast(names.withColumnRenamed("parts", "__parts")))  # one row
    return checked.filter(F.when(F.size("__parts") > 0, failed.cast("boolean")).otherwise(F.lit(True))).drop("__parts")
