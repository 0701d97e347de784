"""The lexicon: flattening, well-formedness, and its driver-side form.

A lexicon is small reference data (hundreds of terms).  It travels as a *term
table* DataFrame and is read to the driver once, behind a size check, to turn
terms into literal expressions that compile once per task.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field, fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import vocab

MAX_TERMS = 20_000
TERM_TABLE = (
    "term STRING, role STRING, category STRING, lang STRING, weight DOUBLE,"
    " requires STRING, variant_of STRING, low_evidence BOOLEAN, ord INT"
)


@dataclass(frozen=True)
class Term:
    """One row of the term table.

    ``role`` is keyword, trap, conditional, anchor, exclusion, engineering or
    ecology; ``requires`` is None, 'anchor' or 'dev_cues'.
    """

    term: str
    role: str = "keyword"
    category: str | None = None
    lang: str = "en"
    weight: float | None = None
    requires: str | None = None
    variant_of: str | None = None
    low_evidence: bool | None = None
    ord: int = 0


@dataclass(frozen=True)
class Lexicon:
    terms: tuple[Term, ...] = field(default_factory=tuple)

    @classmethod
    def of(cls, terms: Iterable[Term]) -> "Lexicon":
        return cls(tuple(replace(t, ord=i) for i, t in enumerate(terms)))

    @classmethod
    def phrases(cls, phrases: Iterable[str], role: str = "keyword", **kw) -> "Lexicon":
        return cls.of(Term(p, role=role, **kw) for p in phrases)

    @classmethod
    def from_table(cls, table: DataFrame) -> "Lexicon":
        """Read a term table to the driver; refuses anything but a small one."""
        names = [f.name for f in fields(Term)]
        rows = table.select(*names).orderBy("ord", "term").limit(MAX_TERMS + 1).collect()
        if len(rows) > MAX_TERMS:
            raise ValueError(f"term table has more than {MAX_TERMS} rows")
        return cls.of(Term(**r.asDict()) for r in rows)

    def to_table(self, spark: SparkSession) -> DataFrame:
        rows = [tuple(getattr(t, f.name) for f in fields(Term)) for t in self.terms]
        return spark.createDataFrame(rows, TERM_TABLE)

    def __len__(self) -> int:
        return len(self.terms)

    def ids(self, role: str | Sequence[str], category: str | None = None, **attrs) -> list[int]:
        roles = [role] if isinstance(role, str) else list(role)
        return [
            t.ord
            for t in self.terms
            if t.role in roles
            and (category is None or t.category == category)
            and all(getattr(t, k) == v for k, v in attrs.items())
        ]

    def with_gate_terms(self) -> "Lexicon":
        """This lexicon plus the two fixed off-domain term lists."""
        gates = [Term(t, role="ecology") for t in vocab.OFF_DOMAIN_ECOLOGY]
        gates += [Term(t, role="engineering") for t in vocab.OFF_DOMAIN_ENGINEERING]
        return Lexicon.of([*self.terms, *gates])

    def categories(self) -> list[str]:
        seen = [t.category for t in self.terms if t.role in ("keyword", "conditional") and t.category]
        return list(dict.fromkeys(seen))


def flatten_document(doc: DataFrame, categories: Sequence[str] = vocab.CATEGORIES) -> DataFrame:
    """Term table of a lexicon document (one row, nested arrays).

    A category flag or an entry flag makes a keyword depend on an anchor.  The
    job fails when the document's category set differs from ``categories``.
    """
    have = F.array_sort(F.map_keys("categories"))
    want = F.array_sort(F.array(*[F.lit(c) for c in categories]))
    checked = doc.select(
        F.when(have == want, F.col("categories"))
        .otherwise(F.raise_error(F.concat(F.lit("category drift: "), F.array_join(have, ","))))
        .alias("categories"),
        "meta",
    )
    blocks = checked.select(F.explode("categories").alias("category", "b"), "meta")

    def entries(df, array, role, lang, category=F.col("category")):
        e = df.select(category.alias("category"), "flag", F.posexplode(array).alias("pos", "e"))
        anchored = F.col("flag") | F.coalesce(F.col("e.requires_ageing_anchor"), F.lit(False))
        requires = F.col("e.requires") if role == "conditional" else F.when(anchored, "anchor")
        return e.select(
            F.col("e.term").alias("term"),
            F.lit(role).alias("role"),
            "category",
            F.lit(lang).alias("lang"),
            (F.col("e.weight") if role == "conditional" else F.col("e.precision")).alias("weight"),
            (requires if role in ("keyword", "conditional") else F.lit(None).cast("string")).alias("requires"),
            F.col("e.variant_of").alias("variant_of"),
            F.col("e.low_evidence").alias("low_evidence"),
            "pos",
        )

    flagged = blocks.withColumn("flag", F.coalesce(F.col("b.requires_ageing_anchor"), F.lit(False)))
    meta = checked.withColumn("flag", F.lit(False))
    none = F.lit(None).cast("string")
    parts = [
        entries(flagged, F.col("b.en"), "keyword", "en"),
        entries(flagged, F.col("b.sv"), "keyword", "sv"),
        entries(flagged, F.col("b.conditional_voters"), "conditional", "en"),
        entries(flagged, F.col("b.trap_terms"), "trap", "en"),
        entries(meta, F.col("meta.broad_net.en"), "anchor", "en", none),
        entries(meta, F.col("meta.broad_net.sv"), "anchor", "sv", none),
        entries(meta, F.col("meta.exclusion_markers"), "exclusion", "en", none),
    ]
    table = None
    for i, part in enumerate(parts):
        part = part.withColumn("part", F.lit(i))
        table = part if table is None else table.unionByName(part)
    rank = F.array_position(F.array(*[F.lit(c) for c in categories]), F.col("category"))
    order = (F.col("part") * 1_000_000 + F.coalesce(rank, F.lit(0)) * 10_000 + F.col("pos")).cast("int")
    return table.withColumn("ord", order).drop("part", "pos")


def term_problem(term) -> "F.Column":
    """Why a term is malformed, null when it is fine (a Column of text)."""
    words = F.split(term, r"(?U)\s+")
    bad_star = F.exists(
        words,
        lambda w: F.contains(w, F.lit("*"))
        & (
            (F.regexp_count(w, F.lit(r"\*")) > 1)
            | ~F.endswith(w, F.lit("*"))
            | ~w.rlike(r"(?U)^.*\w.*\*\z")
        ),
    )
    return (
        F.when(term.isNull() | ~term.rlike(r"(?U)\w"), "no word character")
        .when(F.length(term) > vocab.MAX_TERM_LENGTH, "too long")
        .when(F.regexp_count(term, F.lit(r"\*")) > vocab.MAX_WILDCARDS, "too many wildcards")
        .when(bad_star, "misplaced wildcard")
    )


def well_formed(table: DataFrame) -> DataFrame:
    """Term table without malformed terms."""
    return table.filter(term_problem(F.col("term")).isNull())
