"""Rule classification: one chain of projections, no shuffle.

Terms vote with their weights after two relevance gates; near-ties are decided
by cue rules, a relative margin and an evidence floor.  Every row names the
rule that decided it in ``rule_path``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab
from ..functions.text import evidence_text, fence
from .lexicon import Lexicon
from .matching import cue, int_array, literal, match_terms, string_array, term_names

FA, INT, ARD, CARE, SOC = vocab.CATEGORIES

# rule -> label; None means the leading category
RULE_LABEL: dict[str, str | None] = {
    "off_domain_ecology": "not_relevant",
    "off_domain_engineering": "not_relevant",
    "no_evidence": "not_relevant",
    "anchor_only": "ambiguous",
    "boundary_mechanism": FA,
    "boundary_developing": INT,
    "boundary_contested": FA,
    "boundary_undecided": "ambiguous",
    "single_category": None,
    "single_weak": "ambiguous",
    "tie_mechanism": FA,
    "tie_service": CARE,
    "tie_society": SOC,
    "tie_treatment": ARD,
    "tie_relative": None,
    "tie_undecided": "ambiguous",
    "decisive": None,
}
NO_CONFIDENCE = [
    "off_domain_ecology", "off_domain_engineering", "no_evidence", "anchor_only",
    "single_category", "single_weak",
]


@dataclass(frozen=True)
class RuleSet:
    """Lexicon (gate terms included), cues and thresholds of one classifier."""

    lexicon: Lexicon
    cues: Mapping[str, Sequence[str]] = field(default_factory=lambda: dict(vocab.CUES))
    waivable: Sequence[str] = tuple(vocab.WAIVABLE_BIOMEDICAL)
    tie_margin: float = vocab.TIE_MARGIN
    evidence_floor: float = vocab.EVIDENCE_FLOOR
    rel_margin: float = vocab.REL_MARGIN


def _lookup(key: Column, table: Mapping[str, Column]) -> Column:
    out = None
    for k, v in table.items():
        out = F.when(key == k, v) if out is None else out.when(key == k, v)
    return out


def evidence(df: DataFrame, title: str, body: str, rules: RuleSet) -> DataFrame:
    """Text, hits, anchors, cues and the ranked category votes of each row."""
    lex, cues = rules.lexicon, rules.cues
    text = F.col("_text")
    df = df.withColumn("_text", evidence_text(F.col(title), F.col(body)))
    df = match_terms(df, "_text", lex, "_hits")
    df = df.withColumn("_older", cue(text, cues["older_reference"]))

    free = lex.ids("keyword", requires=None)
    every = lex.ids("keyword")
    df = df.withColumn(
        "_anchor_hits", F.array_intersect("_hits", int_array(lex.ids("anchor")))
    ).withColumn("_anchored", (F.size("_anchor_hits") > 0) | (F.col("_older") != ""))
    df = df.withColumns(
        {
            "_kw": F.array_intersect(
                "_hits", F.when(F.col("_anchored"), int_array(every)).otherwise(int_array(free))
            ),
            "_eco": F.array_intersect("_hits", int_array(lex.ids("ecology"))),
            "_eng": F.array_intersect("_hits", int_array(lex.ids("engineering"))),
        }
    )
    matched = F.size("_kw") > 0

    def when_matched(name):
        return F.when(matched, cue(text, cues[name])).otherwise("")

    unmatched_eng = ~matched & (F.size("_eng") > 0)
    df = df.withColumns(
        {
            "_human": F.when(F.size("_eco") > 0, cue(text, cues["human_biomedical"])).otherwise(""),
            "_bio": F.when(unmatched_eng, cue(text, cues["biomedical"])).otherwise(""),
            "_dev": when_matched("developing"),
            "_mech": when_matched("mechanism"),
        }
    )
    df = df.withColumn(
        "_bio",
        F.when(
            F.col("_bio").isin(list(rules.waivable)) & (cue(text, cues["battery"]) != ""), ""
        ).otherwise(F.col("_bio")),
    )
    by_anchor = int_array(lex.ids("conditional", requires="anchor"))
    by_dev = int_array(lex.ids("conditional", requires="dev_cues"))
    none = int_array([])
    conditional = F.array_intersect(
        "_hits",
        F.concat(
            F.when(F.col("_anchored"), by_anchor).otherwise(none),
            F.when(F.col("_dev") != "", by_dev).otherwise(none),
        ),
    )
    df = df.withColumn("_votes", F.when(matched, F.concat(F.col("_kw"), conditional)).otherwise(none))

    weights = literal([float(t.weight or 0.0) for t in lex.terms], "double")
    keyword_ids = int_array(every)
    per_category = []
    for c in vocab.CATEGORIES:
        mine = F.array_intersect("_votes", int_array(lex.ids(["keyword", "conditional"], c)))
        df = df.withColumn(f"_v_{c}", mine)
        mine = F.col(f"_v_{c}")
        per_category.append(
            F.struct(
                (-F.round(F.aggregate(mine, F.lit(0.0), lambda a, i: a + F.element_at(weights, i + 1)), 3)).alias("neg"),
                F.lit(c).alias("category"),
                F.size(mine).alias("n"),
                F.size(F.array_intersect(mine, keyword_ids)).alias("kept"),
                F.exists(
                    mine, lambda i: F.element_at(weights, i + 1) >= rules.evidence_floor
                ).alias("strong"),
            )
        )
    ranked = F.array_sort(F.filter(F.array(*per_category), lambda v: v["n"] > 0))
    return df.withColumn("_ranked", F.when(matched, ranked))


def decide(df: DataFrame, rules: RuleSet) -> DataFrame:
    """Add leader, runner-up, margin and the deciding ``rule_path``."""
    df = df.withColumns(
        {
            "_top": F.get("_ranked", F.lit(0)),
            "_second": F.get("_ranked", F.lit(1)),
        }
    )
    df = df.withColumns(
        {
            "top_category": F.col("_top.category"),
            "top_score": -F.col("_top.neg"),
            "second_category": F.col("_second.category"),
            "second_score": F.coalesce(-F.col("_second.neg"), F.when(F.col("_top").isNotNull(), 0.0)),
        }
    )
    df = df.withColumn("margin", F.round(F.col("top_score") - F.col("second_score"), 3))

    text, top, second = F.col("_text"), F.col("top_category"), F.col("second_category")
    margin, mech, dev = F.col("margin"), F.col("_mech") != "", F.col("_dev") != ""
    matched = F.size("_kw") > 0
    close = margin < rules.tie_margin

    def pair(a, b):
        return F.coalesce(((top == a) & (second == b)) | ((top == b) & (second == a)), F.lit(False))

    def has_cue(name):
        return cue(text, rules.cues[name]) != ""

    floor = (
        F.col("_top.strong")
        | ((F.col("_top.n") >= 2) & (F.col("_top.kept") >= 1))
        | ((top == FA) & mech)
    )
    contested = pair(FA, INT)
    alone = second.isNull()
    boundary = (contested | ((top == INT) & alone)) & ((top == INT) | close)
    tie = close & ~alone
    care_social = tie & pair(CARE, SOC)
    in_pair_ard = (top == ARD) | F.coalesce(second == ARD, F.lit(False))
    relative = F.when(F.col("top_score") != 0, margin / F.col("top_score")).otherwise(0.0)

    path = (
        F.when((F.size("_eco") > 0) & (F.col("_human") == "") & (F.col("_older") == ""), "off_domain_ecology")
        .when(~matched & (F.size("_eng") > 0) & (F.col("_bio") == ""), "off_domain_engineering")
        .when(~matched & ~F.col("_anchored"), "no_evidence")
        .when(~matched, "anchor_only")
        .when(boundary & mech, "boundary_mechanism")
        .when(boundary & dev, "boundary_developing")
        .when(boundary & contested, "boundary_contested")
        .when(boundary, "boundary_undecided")
        .when(alone & floor, "single_category")
        .when(alone, "single_weak")
        .when(tie & pair(FA, ARD) & mech, "tie_mechanism")
        .when(care_social & has_cue("service") & ~has_cue("society"), "tie_service")
        .when(care_social & has_cue("society") & ~has_cue("service"), "tie_society")
        .when(tie & in_pair_ard & F.col("_anchored") & has_cue("treatment"), "tie_treatment")
        .when(tie & (relative >= rules.rel_margin) & floor, "tie_relative")
        .when(tie, "tie_undecided")
        .otherwise("decisive")
    )
    return df.withColumn("rule_path", fence(path))


def _reason(rules: RuleSet) -> Column:
    lex = rules.lexicon
    names = lambda c: F.array_join(term_names(F.col(c), lex), ", ")
    top, second = F.col("top_category"), F.col("second_category")
    numbers = F.format_string(
        "%s (%.3f) against %s (%.3f), margin %.3f",
        top, F.col("top_score"), second, F.col("second_score"), F.col("margin"),
    )
    winners = F.coalesce(*[F.when(top == c, names(f"_v_{c}")) for c in vocab.CATEGORIES])
    s = F.lit
    return _lookup(
        F.col("rule_path"),
        {
            "off_domain_ecology": F.concat(s("Plant or ecology vocabulary without a human or biomedical marker: "), names("_eco"), s(".")),
            "off_domain_engineering": F.concat(s("Engineering or materials vocabulary without biomedical context: "), names("_eng"), s(".")),
            "no_evidence": s("Neither an anchor nor a lexicon keyword occurs."),
            "anchor_only": s("An anchor occurs, but no category keyword does."),
            "boundary_mechanism": F.concat(s("Mechanism wording assigns the intervention boundary to ageing biology: "), F.col("_mech"), s(".")),
            "boundary_developing": F.concat(s("Developing or testing wording supports an intervention: "), names(f"_v_{INT}"), s(".")),
            "boundary_contested": s("Intervention vocabulary without developing or testing wording goes to ageing biology."),
            "boundary_undecided": s("Intervention vocabulary alone, with neither testing nor mechanism wording."),
            "single_category": F.concat(s("Only "), top, s(" has keywords: "), winners, s(".")),
            "single_weak": F.concat(s("Only "), top, s(" has keywords, below the evidence floor: "), winners, s(".")),
            "tie_mechanism": F.concat(s("Mechanism wording decides a close call for ageing biology: "), F.col("_mech"), s(".")),
            "tie_service": s("Service wording decides a close call for care."),
            "tie_society": s("Society wording decides a close call for population ageing."),
            "tie_treatment": s("Treatment wording in an older population decides a close call for disease."),
            "tie_relative": F.concat(s("A clear relative lead decides: "), numbers, s(".")),
            "tie_undecided": F.concat(s("Too close to call: "), numbers, s(".")),
            "decisive": F.concat(s("Keywords decide for "), top, s(": "), winners, s(".")),
        },
    )


def classify(df: DataFrame, title: str, body: str, rules: RuleSet) -> DataFrame:
    """Label every row.

    Adds label, rule_path, confidence, reason, matched_keywords, anchor_terms,
    top/second category and score, and margin; input columns stay.  Unused
    outputs cost nothing (column pruning).
    """
    base = df.columns
    lex = rules.lexicon
    out = decide(evidence(df, title, body, rules), rules)
    path = F.col("rule_path")
    label = F.coalesce(
        _lookup(path, {r: F.lit(v) for r, v in RULE_LABEL.items() if v}), F.col("top_category")
    )
    gated = path.isin("off_domain_ecology", "off_domain_engineering", "no_evidence", "anchor_only")
    suffix = string_array([t.term + (" (conditional)" if t.role == "conditional" else "") for t in lex.terms])
    shown = [
        F.struct(
            F.lit(c).alias("key"),
            F.transform(
                F.when(gated, F.array_intersect("_kw", int_array(lex.ids("keyword", c)))).otherwise(F.col(f"_v_{c}")),
                lambda i: F.element_at(suffix, i + 1),
            ).alias("value"),
        )
        for c in vocab.CATEGORIES
    ]
    anchor_terms = F.array_union(
        term_names(F.col("_anchor_hits"), lex),
        F.when(F.col("_older") != "", F.array("_older")).otherwise(string_array([])),
    )
    return out.select(
        *base,
        label.alias("label"),
        "rule_path",
        F.when(~path.isin(NO_CONFIDENCE), F.col("margin")).alias("confidence"),
        _reason(rules).alias("reason"),
        F.map_from_entries(F.filter(F.array(*shown), lambda e: F.size(e["value"]) > 0)).alias("matched_keywords"),
        anchor_terms.alias("anchor_terms"),
        "top_category",
        "top_score",
        "second_category",
        "second_score",
        "margin",
    )
