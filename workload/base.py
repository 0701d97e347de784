"""Registry, table access and the mapping of test tables to grant data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grantmill.functions.text import evidence_text
from grantmill.operators.agreement import latest_judgments
from grantmill.operators.lexicon import Lexicon, Term
from grantmill.operators.rules import RuleSet
from grantmill.sources.readers import spread
from grantmill import vocab

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is its twin on the same tables."""

    def register(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


class Tables:
    """Lazy access to ``<sf_dir>/<name>.parquet`` as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


FA, INT, ARD, CARE, SOC = vocab.CATEGORIES
TYPE_LABEL = {"ECONOMY": FA, "LARGE": INT, "MEDIUM": ARD, "SMALL": CARE, "STANDARD": SOC}
PRIORITY_LABEL = {
    "1-URGENT": FA, "2-HIGH": INT, "3-MEDIUM": ARD, "4-NOT SPECIFIED": CARE, "5-LOW": SOC,
}


def case(column, table, default=None):
    out = None
    for k, v in table.items():
        out = F.when(column == k, v) if out is None else out.when(column == k, v)
    return out if default is None else out.otherwise(default)


def sql_case(column: str, table: dict, default: str = "NULL") -> str:
    arms = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items())
    return f"CASE {column} {arms} ELSE {default} END"


def sql_list(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


# ---- grants: line items as awards ----------------------------------------
def grants(t: Tables) -> DataFrame:
    """Money by region and funder; a quantity of 1 stands for a missing amount."""
    li = t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate",
        F.when(F.col("l_quantity") != 1, F.col("l_extendedprice").cast("decimal(18,2)")).alias("amount_eur"),
    )
    part = t.part.select("p_partkey", "p_type", "p_brand", "p_name")
    supplier = t.supplier.select("s_suppkey", "s_nationkey")
    place = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        "n_nationkey", F.col("n_name").alias("funder"), F.col("r_name").alias("region")
    )
    promo = F.when(F.col("p_partkey") % 2 == 1, "not_relevant").otherwise("ambiguous")
    return (
        li.join(part, F.col("l_partkey") == F.col("p_partkey"))
        .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(place, F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("record_id"),
            "l_orderkey", "region", "funder", F.year("l_shipdate").alias("year"), "amount_eur", "p_brand", "p_type",
            F.coalesce(case(F.col("p_type"), TYPE_LABEL), promo).alias("label"),
        )
    )


GRANTS = f"""
grants AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS record_id, l_orderkey,
         r_name AS region, n_name AS funder, year(l_shipdate) AS year, p_brand, p_type,
         CASE WHEN l_quantity <> 1 THEN CAST(l_extendedprice AS DECIMAL(18,2)) END AS amount_eur,
         {sql_case('p_type', TYPE_LABEL, "CASE WHEN p_partkey % 2 = 1 THEN 'not_relevant' ELSE 'ambiguous' END")} AS label
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def measures_sql(label: str = "label", amount: str = "amount_eur") -> str:
    n = ", ".join(f"count(*) FILTER ({label} = '{v}') AS n_{v}" for v in vocab.LABELS)
    d = ", ".join(f"coalesce(sum({amount}) FILTER ({label} = '{v}'), 0) AS d_{v}" for v in vocab.LABELS)
    return f"count(*) AS records, {n}, {d}, count(*) FILTER ({amount} IS NULL) AS eur_missing_records"


NUM_SQL = "(" + " + ".join(f"d_{v}" for v in vocab.NUMERATOR) + ")"
DEN_SQL = "(" + " + ".join(f"d_{v}" for v in vocab.CATEGORIES) + ")"


def finish_sql(keys: str) -> str:
    n = ", ".join(f"n_{v}" for v in vocab.LABELS)
    e = ", ".join(f"CAST(d_{v} AS DOUBLE) AS eur_{v}" for v in vocab.LABELS)
    return f"""{keys} records, {n}, {e}, CAST({NUM_SQL} AS DOUBLE) AS numerator_eur,
      CAST({DEN_SQL} AS DOUBLE) AS denominator_eur,
      round(CAST({NUM_SQL} AS DOUBLE) / nullif(CAST({DEN_SQL} AS DOUBLE), 0), 4) AS ratio,
      round(CAST(d_ambiguous AS DOUBLE) / nullif(CAST({DEN_SQL} + d_ambiguous AS DOUBLE), 0), 4) AS ambiguous_share,
      eur_missing_records"""


# ---- adjudication log: orders --------------------------------------------
def adjudication_log(t: Tables) -> DataFrame:
    """One answer per order about the customer's record, some with an error."""
    return t.orders.select(
        F.col("o_custkey").alias("record_id"), case(F.col("o_orderpriority"), PRIORITY_LABEL).alias("label"),
        F.when(F.col("o_orderstatus") == "P", "no answer").alias("error"), F.col("o_orderdate").alias("answered"),
        F.col("o_orderkey").alias("seq"), F.concat(F.lit("order "), F.col("o_orderkey")).alias("reason"),
    )


ADJUDICATION_LOG = f"""
adj_log AS (
  SELECT o_custkey AS record_id, {sql_case('o_orderpriority', PRIORITY_LABEL)} AS label,
         CASE WHEN o_orderstatus = 'P' THEN 'no answer' END AS error, o_orderdate AS answered, o_orderkey AS seq,
         concat('order ', o_orderkey) AS reason
  FROM orders),
adjudicated AS (
  SELECT record_id, label, error, reason FROM adj_log WHERE error IS NULL
  QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY answered DESC, seq DESC) = 1)"""


# ---- customers as labelled records ---------------------------------------
SEGMENT_LABEL = {"AUTOMOBILE": FA, "BUILDING": CARE, "FURNITURE": "ambiguous", "MACHINERY": "ambiguous", "HOUSEHOLD": SOC}


def labelled_customers(t: Tables) -> DataFrame:
    place = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        "n_nationkey", F.col("n_name").alias("funder"), F.col("r_name").alias("region")
    )
    return t.customer.join(place, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("record_id"), F.col("c_name").alias("title"), "region", "funder",
        F.coalesce(case(F.col("c_mktsegment"), SEGMENT_LABEL), F.lit("not_relevant")).alias("label"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal").cast("decimal(18,2)")).alias("amount_eur"),
    )


CUSTOMERS = f"""
labelled AS (
  SELECT c_custkey AS record_id, c_name AS title, r_name AS region, n_name AS funder,
         {sql_case('c_mktsegment', SEGMENT_LABEL, "'not_relevant'")} AS label,
         CASE WHEN c_acctbal >= 0 THEN CAST(c_acctbal AS DECIMAL(18,2)) END AS amount_eur
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


# ---- judgments: events ----------------------------------------------------
ANSWER = {"view": "yes", "click": "no", "signup": "borderline"}
MARK_LABEL = {"view": FA, "click": INT, "signup": "ambiguous", "purchase": CARE, "error": "not_relevant"}


def judgment_log(t: Tables) -> DataFrame:
    return t.events.select(
        F.get_json_object("props", "$.k").cast("int").alias("record_id"), F.col("user_id").alias("labeller_id"),
        case(F.col("event_type"), ANSWER).alias("geroscience"), F.col("ts").alias("labelled_at"), F.col("event_id").alias("seq"),
        (F.col("value") > 15).alias("cancer"), (F.col("event_type") == "error").alias("cant_tell"), "event_type",
    )


def judgments(t: Tables) -> DataFrame:
    return latest_judgments(judgment_log(t))


JUDGMENTS = f"""
log AS (
  SELECT CAST(json_extract_string(props, '$.k') AS INT) AS record_id, user_id AS labeller_id,
         {sql_case('event_type', ANSWER)} AS geroscience, ts AS labelled_at, event_id AS seq,
         value > 15 AS cancer, event_type = 'error' AS cant_tell, event_type
  FROM events),
judgments AS (
  SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY record_id, labeller_id ORDER BY labelled_at DESC, seq DESC) = 1),
counts AS (
  SELECT record_id, count(*) AS n_judgments, count(*) FILTER (geroscience = 'yes') AS n_yes,
         count(*) FILTER (geroscience = 'no') AS n_no, count(*) FILTER (geroscience = 'borderline') AS n_borderline,
         count(*) FILTER (cancer) AS cancer_ticks, count(*) FILTER (cant_tell) AS flags
  FROM judgments GROUP BY 1)"""


# ---- grant text: documents ------------------------------------------------
def documents(t: Tables) -> DataFrame:
    """Whole texts; the title is the first line and the body the rest."""
    title = F.substring_index("text", "\n", 1)
    return spread(t.documents).select(
        F.col("doc_id").alias("record_id"), title.alias("title"),
        F.expr("substring(text, length(substring_index(text, '\\n', 1)) + 2)").alias("abstract"),
        F.lower("text").alias("t"), "text", "lang", "source", F.col("n_chars").cast("decimal(18,2)").alias("amount_eur"),
    )


DOCUMENTS = r"""
docs AS (
  SELECT doc_id AS record_id, split_part(text, chr(10), 1) AS title,
         substring(text, length(split_part(text, chr(10), 1)) + 2) AS abstract, lower(text) AS t, text, lang, source,
         lower(split_part(text, chr(10), 1) || ' ' || substring(text, length(split_part(text, chr(10), 1)) + 2)) AS ev,
         CAST(n_chars AS DECIMAL(18,2)) AS amount_eur
  FROM documents)"""

EXPERT_LABELS = [FA, INT, ARD, CARE, SOC, "ambiguous"]


def with_experts(t: Tables, docs: DataFrame) -> DataFrame:
    """Expert label and legacy label where ``labels`` covers the document."""
    lab = t.labels.select(F.col("doc_id").alias("record_id"), "quality", "toxic")
    j = docs.join(lab, "record_id", "left")
    return j.withColumns(
        {
            "expert_label": F.when((F.col("toxic") == 1), SOC).when(F.col("quality") == 0, ARD).when(
                F.col("quality").isNotNull(), case(F.col("lang"), {"en": FA, "fr": INT}, CARE)
            ),
            "llm_category": F.when(F.col("quality").isNotNull(), case(F.col("lang"), {"en": FA, "fr": INT, "de": ARD}, "ambiguous")),
        }
    )


EXPERTS = DOCUMENTS + f""",
expert AS (
  SELECT docs.*, quality, toxic,
         CASE WHEN toxic = 1 THEN '{SOC}' WHEN quality = 0 THEN '{ARD}'
              WHEN quality IS NOT NULL THEN CASE lang WHEN 'en' THEN '{FA}' WHEN 'fr' THEN '{INT}' ELSE '{CARE}' END END AS expert_label,
         CASE WHEN quality IS NOT NULL THEN CASE lang WHEN 'en' THEN '{FA}' WHEN 'fr' THEN '{INT}' WHEN 'de' THEN '{ARD}' ELSE 'ambiguous' END END AS llm_category
  FROM docs LEFT JOIN labels ON doc_id = record_id)"""


# ---- fixture lexicon and rule set ----------------------------------------
def _keyword(category, lang, *terms, requires=None):
    return [Term(t, "keyword", category, lang, w, requires) for t, w in terms]


LEXICON = Lexicon.of(
    _keyword(FA, "en", ("from", 0.4), ("with", 0.35), ("tion*", 0.65))
    + _keyword(INT, "en", ("dans", 0.7), ("avec", 0.65), ("pour", 0.45), ("erly", 0.35))
    + _keyword(ARD, "en", ("nicht", 0.8), ("und", 0.6), ("mit", 0.55), ("ered", 0.3))
    + _keyword(CARE, "en", ("para", 0.7), ("con", 0.6), ("una", 0.65), ("this", 0.3))
    + _keyword(SOC, "sv", ("which", 0.7))
    + _keyword(SOC, "en", ("are", 0.35), requires="anchor")
    + [
        Term("worthless", "conditional", SOC, "en", 0.3, "anchor"), Term("trash", "conditional", SOC, "en", 0.3, "anchor"),
        Term("stupid", "conditional", SOC, "en", 0.25, "anchor"), Term("idiot", "conditional", SOC, "en", 0.25, "anchor"),
        Term("sur", "conditional", INT, "en", 0.2, "dev_cues"),
        Term("mit", "trap", FA, "en"), Term("con", "trap", INT, "en"),
        Term("the", "anchor"), Term("les", "anchor"), Term("der", "anchor", lang="sv"), Term("los", "anchor"),
        Term("license", "exclusion"), Term("apache", "exclusion"), Term("copyright", "exclusion"),
        Term("license", "ecology"), Term("enung", "ecology"), Term("erung", "ecology"),
        Term("ciónue", "engineering"), Term("ément", "engineering"), Term("ntble", "engineering"), Term("es", "engineering"),
    ]
)
CUES = {
    "older_reference": ["trash", r"thn\w*"],
    "human_biomedical": ["enlich", "tible"],
    "biomedical": ["was", "las", "es"],
    "battery": ["por", "del"],
    "developing": ["than", "sur", r"ciónas\w*"],
    "mechanism": ["erly", "des", "tied"],
    "service": ["thin", "erat", "atnd", "threly"],
    "society": ["then", "ersh"],
    "treatment": ["thor", "ver"],
}
RULES = RuleSet(LEXICON, cues=CUES, waivable=("es",))


def sql_pattern(term: str) -> str:
    body = "".join("[\\p{L}\\p{N}_]*" if ch == "*" else "\\s+" if ch == " " else ch for ch in term.lower())
    return f"(^|[^\\p{{L}}\\p{{N}}_]){body}($|[^\\p{{L}}\\p{{N}}_])"


def sql_has(text: str, term: str) -> str:
    return f"regexp_matches({text}, '{sql_pattern(term)}')"


def sql_cue(text: str, alternatives) -> str:
    """First matching cue, '' when there is none."""
    alt = "|".join(a.replace("\\w", "[\\p{L}\\p{N}_]") for a in alternatives)
    return f"regexp_extract({text}, '(^|[^\\p{{L}}\\p{{N}}_])({alt})($|[^\\p{{L}}\\p{{N}}_])', 2)"


def sql_hits(text: str, lexicon: Lexicon) -> str:
    picks = ", ".join(f"CASE WHEN {sql_has(text, t.term)} THEN {t.ord} END" for t in lexicon.terms)
    return f"list_filter([{picks}], lambda x: x IS NOT NULL)"


def sql_ids(ids) -> str:
    return "[" + ", ".join(str(i) for i in ids) + "]::INT[]"


def rules_sql(rules: RuleSet, source: str, text: str) -> str:
    """CTE ``ruled`` with label, rule_path and scores for each row of ``source``."""
    lex = rules.lexicon
    cues = ", ".join(f"{sql_cue(text, a)} AS c_{n}" for n, a in rules.cues.items())
    w = "[" + ", ".join(str(float(t.weight or 0)) for t in lex.terms) + "]::DOUBLE[]"

    def only(values, ids):
        return f"list_filter({values}, lambda x: list_contains({sql_ids(ids)}, x))"

    cats = []
    for c in vocab.CATEGORIES:
        mine = only("votes", lex.ids(["keyword", "conditional"], c))
        cats.append(f"{mine} AS v_{c}")
    structs = ", ".join(
        f"{{'neg': -round(coalesce(list_sum(list_transform(v_{c}, lambda i: ({w})[i + 1])), 0), 3), 'cat': '{c}', 'n': len(v_{c}), "
        f"'kept': len({only(f'v_{c}', lex.ids('keyword'))}), "
        f"'strong': len(list_filter(v_{c}, lambda i: ({w})[i + 1] >= {rules.evidence_floor})) > 0}}"
        for c in vocab.CATEGORIES
    )
    pair = lambda a, b: f"coalesce((top = '{a}' AND second = '{b}') OR (top = '{b}' AND second = '{a}'), false)"
    close = f"margin < {rules.tie_margin}"
    boundary = f"(({pair(FA, INT)} OR (top = '{INT}' AND second IS NULL)) AND (top = '{INT}' OR {close}))"
    floor = f"(r[1].strong OR (r[1].n >= 2 AND r[1].kept >= 1) OR (top = '{FA}' AND c_mechanism <> ''))"
    waived = f"(c_biomedical IN ({sql_list(rules.waivable)}) AND c_battery <> '')"
    return f"""
r0 AS (SELECT *, {sql_hits(text, lex)} AS hits, {cues} FROM {source}),
r1 AS (SELECT *, (len({only('hits', lex.ids('anchor'))}) > 0 OR c_older_reference <> '') AS anchored FROM r0),
r2 AS (SELECT *, list_filter(hits, lambda x: list_contains(CASE WHEN anchored THEN {sql_ids(lex.ids('keyword'))}
         ELSE {sql_ids(lex.ids('keyword', requires=None))} END, x)) AS kw FROM r1),
r3 AS (SELECT *, CASE WHEN len(kw) = 0 THEN []::INT[] ELSE list_concat(kw, list_filter(hits, lambda x:
         (anchored AND list_contains({sql_ids(lex.ids('conditional', requires='anchor'))}, x))
         OR (c_developing <> '' AND list_contains({sql_ids(lex.ids('conditional', requires='dev_cues'))}, x)))) END AS votes FROM r2),
r4 AS (SELECT *, {", ".join(cats)} FROM r3),
r5 AS (SELECT *, list_sort(list_filter([{structs}], lambda s: s.n > 0)) AS r FROM r4),
r6 AS (SELECT *, r[1].cat AS top, r[2].cat AS second, -r[1].neg AS top_score, coalesce(-r[2].neg, CASE WHEN len(r) > 0 THEN 0.0::DOUBLE END) AS second_score FROM r5),
r7 AS (SELECT *, round(top_score - second_score, 3) AS margin FROM r6),
r8 AS (SELECT *, CASE
    WHEN len({only('hits', lex.ids('ecology'))}) > 0 AND c_human_biomedical = '' AND c_older_reference = '' THEN 'off_domain_ecology'
    WHEN len(kw) = 0 AND len({only('hits', lex.ids('engineering'))}) > 0 AND (c_biomedical = '' OR {waived}) THEN 'off_domain_engineering'
    WHEN len(kw) = 0 AND NOT anchored THEN 'no_evidence'
    WHEN len(kw) = 0 THEN 'anchor_only'
    WHEN {boundary} AND c_mechanism <> '' THEN 'boundary_mechanism'
    WHEN {boundary} AND c_developing <> '' THEN 'boundary_developing'
    WHEN {boundary} AND {pair(FA, INT)} THEN 'boundary_contested'
    WHEN {boundary} THEN 'boundary_undecided'
    WHEN second IS NULL AND {floor} THEN 'single_category'
    WHEN second IS NULL THEN 'single_weak'
    WHEN {close} AND {pair(FA, ARD)} AND c_mechanism <> '' THEN 'tie_mechanism'
    WHEN {close} AND {pair(CARE, SOC)} AND c_service <> '' AND c_society = '' THEN 'tie_service'
    WHEN {close} AND {pair(CARE, SOC)} AND c_society <> '' AND c_service = '' THEN 'tie_society'
    WHEN {close} AND '{ARD}' IN (top, second) AND c_treatment <> '' AND anchored THEN 'tie_treatment'
    WHEN {close} AND margin / nullif(top_score, 0) >= {rules.rel_margin} AND {floor} THEN 'tie_relative'
    WHEN {close} THEN 'tie_undecided'
    ELSE 'decisive' END AS rule_path FROM r7),
ruled AS (SELECT *, CASE
    WHEN rule_path IN ('off_domain_ecology', 'off_domain_engineering', 'no_evidence') THEN 'not_relevant'
    WHEN rule_path IN ('anchor_only', 'boundary_undecided', 'single_weak', 'tie_undecided') THEN 'ambiguous'
    WHEN rule_path IN ('boundary_mechanism', 'boundary_contested', 'tie_mechanism') THEN '{FA}'
    WHEN rule_path = 'boundary_developing' THEN '{INT}'
    WHEN rule_path = 'tie_service' THEN '{CARE}'
    WHEN rule_path = 'tie_society' THEN '{SOC}'
    WHEN rule_path = 'tie_treatment' THEN '{ARD}'
    ELSE top END AS label,
    CASE WHEN rule_path NOT IN ('off_domain_ecology', 'off_domain_engineering', 'no_evidence', 'anchor_only',
      'single_category', 'single_weak') THEN margin END AS confidence FROM r8)"""


def ruled_documents(t: Tables, experts: bool = False) -> DataFrame:
    """Documents labelled by the fixture rules (whole texts)."""
    from grantmill.operators.rules import classify

    # rules run on the scan: a join below them would carry the texts
    ruled = classify(documents(t), "title", "abstract", RULES)
    return with_experts(t, ruled) if experts else ruled


RULED = DOCUMENTS + "," + rules_sql(RULES, "docs", "ev")
RULED_EXPERTS = EXPERTS + "," + rules_sql(RULES, "expert", "ev")

__all__ = [n for n in dir() if not n.startswith("_")] + ["evidence_text"]
