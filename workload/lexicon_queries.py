"""Matching, lexicon statistics, rule labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from grantmill import vocab
from grantmill.functions.text import evidence_text, keyword_in_context, squeeze, term_pattern
from grantmill.operators import awards, census, lexicon_stats, matching, overlay
from grantmill.operators.lexicon import Lexicon, Term, term_problem
from grantmill.operators.rules import classify

from .base import (
    CUES, DOCUMENTS, EXPERTS, LEXICON, RULED, RULED_EXPERTS, RULES, documents, query, ruled_documents, sql_case, sql_cue,
    INT, sql_has, sql_hits, sql_ids, sql_list, sql_pattern, with_experts,
)

NET = ["from", "dans", "nicht", "para", "license", "worthless", "tion*"]


def names_sql(terms, text="t", sort=False):
    picks = ", ".join(f"CASE WHEN {sql_has(text, w)} THEN '{w}' END" for w in terms)
    out = f"list_filter([{picks}], lambda x: x IS NOT NULL)"
    return f"list_sort({out})" if sort else out


@query("net_filter", f"WITH {DOCUMENTS}, m AS (SELECT record_id, {names_sql(NET, sort=True)} AS matched_phrases FROM docs) SELECT * FROM m WHERE len(matched_phrases) > 0")
def net_filter(t):
    return matching.net_filter(documents(t).select("record_id", "t"), "t", NET).select("record_id", "matched_phrases")


MANY = [
    "the", "of the", "in the", "tion*", "ther*", "er", "la", "de la", "que", "und", "der", "mit", "los", "con", "license", "apache license",
    "with the", "from", "no such words", "password", "worthless", "en*", "ing*", "es que", "the the", "von",
]


@query(
    "match_pairs",
    f"""WITH {DOCUMENTS}, m AS (SELECT record_id, unnest({names_sql(MANY)}) AS term FROM docs) SELECT term, count(*) AS n, sum(record_id)::BIGINT AS ids FROM m GROUP BY 1""",
)
def match_pairs(t):
    lex = Lexicon.phrases(MANY)
    hit = matching.match_terms(documents(t).select("record_id", "t"), "t", lex, "hits")
    rows = matching.explode_hits(hit, lex, "record_id")
    return rows.groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.sum("record_id").alias("ids"))


SCREEN = ["worthless", "trash", "stupid", "idiot", "apache"]


@query("any_term_screen", f"WITH {DOCUMENTS}, m AS (SELECT record_id, {names_sql(SCREEN)} AS matched FROM docs) SELECT record_id, len(matched) > 0 AS flagged, matched FROM m")
def any_term_screen(t):
    return matching.screen(documents(t).select("record_id", "t"), "t", SCREEN).select("record_id", "flagged", "matched")


ANCHORS = [x.term for x in LEXICON.terms if x.role == "anchor"]


@query(
    "anchor_terms",
    f"""WITH {DOCUMENTS}, m AS (SELECT record_id, {names_sql(ANCHORS)} AS a, {sql_cue('t', CUES['older_reference'])} AS o FROM docs)
    SELECT record_id, CASE WHEN o = '' OR list_contains(a, o) THEN a ELSE list_append(a, o) END AS anchor_terms FROM m""",
)
def anchor_terms(t):
    return matching.anchors(documents(t).select("record_id", "t"), "t", LEXICON, CUES["older_reference"]).select("record_id", "anchor_terms")


@query(
    "keyword_context",
    f"""WITH {DOCUMENTS}, m AS (SELECT record_id, text, t, regexp_extract(t, '{sql_pattern('worthless')}') AS m FROM docs WHERE {sql_has('t', 'worthless')}),
    p AS (SELECT record_id, text, strpos(t, m) + CASE WHEN starts_with(m, 'worthless') THEN 0 ELSE 1 END AS pos FROM m)
    SELECT record_id, replace(substring(text, greatest(pos - 70, 1), pos + 79 - greatest(pos - 70, 1)), chr(10), ' ') AS context FROM p""",
)
def keyword_context(t):
    return matching.keyword_context(documents(t), "text", "worthless").select("record_id", "context")


# ---- lexicon statistics -------------------------------------------------------
TERM_VALUES = ", ".join(
    f"({x.ord}, '{x.term}', '{x.role}', {chr(39) + x.category + chr(39) if x.category else 'NULL'}, '{x.lang}')" for x in LEXICON.terms
)
STATS = f"""{EXPERTS}, terms(ord, term, role, category, lang) AS (VALUES {TERM_VALUES}),
h AS (SELECT unnest({sql_hits('t', LEXICON)}) AS ord, llm_category AS label FROM expert),
c AS (SELECT ord, label, count(*) AS n FROM h GROUP BY 1, 2),
stats AS (SELECT t.ord, term, role, category, lang, coalesce(sum(n), 0)::BIGINT AS hits,
  coalesce(sum(n) FILTER (label = CASE WHEN category = 'social_population_aging' THEN 'ambiguous' ELSE category END), 0)::BIGINT AS target_hits
  FROM terms t LEFT JOIN c ON t.ord = c.ord GROUP BY ALL)"""


def _labelled(t, lexicon=LEXICON):
    """Documents with their hits, found before the labels are joined; the join carries no texts."""
    found = matching.match_terms(documents(t), "t", lexicon, "hits").select("record_id", F.substring("title", 1, 110).alias("title"), "hits", "lang")
    return with_experts(t, found).select("record_id", "title", "hits", "llm_category", "expert_label", "lang")


@query("term_stats", f"WITH {STATS} SELECT ord::BIGINT AS ord, term, role, hits, target_hits, CASE WHEN hits > 0 THEN round(target_hits / hits, 3) ELSE 0 END AS precision FROM stats")
def term_stats(t):
    s = lexicon_stats.term_stats(_labelled(t), "t", "llm_category", LEXICON, "hits")
    return s.select(F.col("ord").cast("bigint").alias("ord"), "term", "role", "hits", "target_hits", "precision")


@query("term_hits_by_label", f"WITH {STATS} SELECT ord::BIGINT AS ord, label, n FROM c")
def term_hits_by_label(t):
    return lexicon_stats.hits_by_label(_labelled(t), "t", "llm_category", LEXICON, "hits").select(F.col("ord").cast("bigint").alias("ord"), "label", "n")


@query(
    "false_hits",
    f"""WITH {EXPERTS}, terms(ord, term, role, category, lang) AS (VALUES {TERM_VALUES}),
    h AS (SELECT unnest({sql_hits('t', LEXICON)}) AS ord, llm_category AS label, record_id, substring(title, 1, 110) AS title FROM expert)
    SELECT h.ord::BIGINT AS ord, term, record_id, label, title FROM h JOIN terms ON h.ord = terms.ord
    WHERE NOT coalesce(label = CASE WHEN category = 'social_population_aging' THEN 'ambiguous' ELSE category END, false)
    QUALIFY row_number() OVER (PARTITION BY h.ord ORDER BY record_id) <= 3""",
)
def false_hits(t):
    f = lexicon_stats.false_hits(_labelled(t), "t", "llm_category", LEXICON, "record_id", "title", hits="hits")
    return f.select(F.col("ord").cast("bigint").alias("ord"), "term", "record_id", "label", "title")


@query(
    "category_coverage",
    f"""WITH {EXPERTS} """ + " UNION ALL ".join(
        f"""SELECT '{c}' AS category, count(*) AS records, round(avg(({' OR '.join(sql_has('t', LEXICON.terms[i].term) for i in LEXICON.ids('keyword', c))})::INT), 3) AS coverage
        FROM expert WHERE llm_category = '{vocab.PROXY_LABEL.get(c, c)}' HAVING count(*) > 0""" for c in LEXICON.categories()
    ),
)
def category_coverage(t):
    return lexicon_stats.coverage(_labelled(t), "t", "llm_category", LEXICON, "hits")


THRESHOLDS = {"en": (30, 0.5), "sv": (5, 0.4)}
AUDITED = Lexicon.of(
    [Term(x.term, x.role, x.category, x.lang, x.weight, x.requires, low_evidence=True if x.term == "which" else None) for x in LEXICON.terms if x.role in ("keyword", "conditional")]
    + [
        Term("froms", "keyword", vocab.CATEGORIES[0], "en", 0.5, variant_of="from"),
        Term("dans la", "keyword", vocab.CATEGORIES[1], "en", 0.5, variant_of="dan"),
        Term("bad*term", "keyword", vocab.CATEGORIES[1], "en", 0.5),
        Term("nicht", "conditional", vocab.CATEGORIES[2], "en", 1.5, "sometimes"),
    ]
)


def _audit_sql() -> str:
    fine = [x for x in AUDITED.terms if x.term != "bad*term"]
    rows = ", ".join(
        f"({x.ord}, '{x.term}', '{x.role}', '{x.category}', '{x.lang}', {x.weight}, "
        f"{chr(39) + x.requires + chr(39) if x.requires else 'NULL'}, {chr(39) + x.variant_of + chr(39) if x.variant_of else 'NULL'}, {'true' if x.low_evidence else 'NULL'})"
        for x in AUDITED.terms
    )
    th = "CASE lang WHEN 'en' THEN {} ELSE {} END"
    hits, prec = th.format(30, 5), th.format(0.5, 0.4)
    return f"""WITH {EXPERTS}, terms(ord, term, role, category, lang, weight, requires, variant_of, low_evidence) AS (VALUES {rows}),
    h AS (SELECT unnest({sql_hits('t', Lexicon(tuple(fine)))}) AS ord, llm_category AS label FROM expert),
    s AS (SELECT terms.*, count(label) + count(*) FILTER (h.ord IS NOT NULL AND label IS NULL) AS hits,
      count(*) FILTER (label = CASE WHEN category = 'social_population_aging' THEN 'ambiguous' ELSE category END) AS ok
      FROM terms LEFT JOIN h ON terms.ord = h.ord GROUP BY ALL),
    x AS (SELECT *, CASE WHEN hits > 0 THEN ok / hits ELSE 0 END AS p,
      EXISTS (SELECT 1 FROM terms k WHERE k.role = 'keyword' AND k.variant_of IS NULL AND k.category = s.category AND k.lang = s.lang AND k.term = s.variant_of) AS parent,
      EXISTS (SELECT 1 FROM terms k WHERE k.role = 'keyword' AND k.category = s.category AND k.term = s.term) AS kept FROM s),
    v AS (SELECT term, role, category, lang, unnest(list_filter([
      CASE WHEN term = 'bad*term' THEN 'malformed: misplaced wildcard' END,
      CASE WHEN role = 'keyword' AND term <> 'bad*term' AND variant_of IS NOT NULL AND NOT parent THEN 'variant of no kept term' END,
      CASE WHEN role = 'keyword' AND term <> 'bad*term' AND variant_of IS NOT NULL AND hits < 1 THEN 'variant without hits' END,
      CASE WHEN role = 'keyword' AND term <> 'bad*term' AND variant_of IS NOT NULL AND hits >= 1 AND p < {prec} THEN 'variant below precision' END,
      CASE WHEN role = 'keyword' AND term <> 'bad*term' AND variant_of IS NULL AND (hits < {hits} OR p < {prec}) THEN 'below threshold' END,
      CASE WHEN role = 'keyword' AND term <> 'bad*term' AND hits < 5 AND low_evidence IS NULL THEN 'low_evidence must be true' END,
      CASE WHEN role = 'keyword' AND term <> 'bad*term' AND hits >= 5 AND low_evidence IS NOT NULL THEN 'low_evidence must be absent' END,
      CASE WHEN role = 'conditional' AND requires NOT IN ('anchor', 'dev_cues') THEN 'unknown requirement' END,
      CASE WHEN role = 'conditional' AND NOT weight BETWEEN 0 AND 1 THEN 'weight outside 0..1' END,
      CASE WHEN role = 'conditional' AND kept THEN 'already a kept keyword' END], lambda m: m IS NOT NULL)) AS violation FROM x)
    SELECT * FROM v"""


@query("term_audit", _audit_sql())
def term_audit(t):
    table = AUDITED.to_table(t.spark)
    fine = Lexicon(tuple(x for x in AUDITED.terms if x.term != "bad*term"))
    stats = lexicon_stats.term_stats(_labelled(t, fine), "t", "llm_category", fine, "hits")
    return lexicon_stats.audit_terms(stats, table, THRESHOLDS)


@query(
    "term_wellformed",
    r"""WITH p AS (SELECT unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) - 1 AS i FROM documents),
    w AS (SELECT DISTINCT CASE i % 6 WHEN 0 THEN word || '*' WHEN 1 THEN '*' || word WHEN 2 THEN word || ' *' WHEN 3 THEN word || '  ' WHEN 4 THEN word || '*' || word ELSE word END AS term FROM p)
    SELECT term, CASE WHEN NOT regexp_matches(term, '[\p{L}\p{N}\p{M}_]') THEN 'no word character' WHEN length(term) > 60 THEN 'too long'
      WHEN length(term) - length(replace(term, '*', '')) > 3 THEN 'too many wildcards'
      WHEN len(list_filter(string_split_regex(term, '\s+'), lambda w: contains(w, '*') AND (length(w) - length(replace(w, '*', '')) > 1 OR NOT ends_with(w, '*')
        OR NOT regexp_matches(w, '[\p{L}\p{N}\p{M}_].*\*$')))) > 0 THEN 'misplaced wildcard' END AS problem FROM w""",
)
def term_wellformed(t):
    # every word of every text, as a term of one of six forms
    word, m, star = F.col("word"), F.col("i") % 6, F.lit("*")
    term = (F.when(m == 0, F.concat(word, star)).when(m == 1, F.concat(star, word)).when(m == 2, F.concat(word, F.lit(" *")))
            .when(m == 3, F.concat(word, F.lit("  "))).when(m == 4, F.concat(word, star, word)).otherwise(word))
    w = t.documents.select(F.posexplode(F.split("text", " ")).alias("i", "word")).select(term.alias("term")).distinct()
    return w.select("term", term_problem(F.col("term")).alias("problem"))


STORED = [("from", 364, 0.5), ("dans", 92, 0.4), ("nicht", 1, 0.3), ("absent", 0, 0.0)]


@query(
    "stale_stats",
    f"""WITH {STATS}, stored(term, hits, precision) AS (VALUES {', '.join(f"('{a}', {b}, {c})" for a, b, c in STORED)}),
    f AS (SELECT term, hits, CASE WHEN hits > 0 THEN round(target_hits / hits, 3) ELSE 0 END AS precision FROM stats WHERE role = 'keyword')
    SELECT s.term, list_filter([CASE WHEN s.hits <> f.hits THEN 'hits' END, CASE WHEN s.precision <> f.precision THEN 'precision' END], lambda x: x IS NOT NULL) AS stale
    FROM stored s JOIN f USING (term) WHERE s.hits <> f.hits OR s.precision <> f.precision""",
)
def stale_stats(t):
    stored = t.spark.createDataFrame(STORED, "term string, hits bigint, precision double")
    fresh = lexicon_stats.term_stats(_labelled(t), "t", "llm_category", LEXICON, "hits").filter("role = 'keyword'")
    return lexicon_stats.stale_stats(stored, fresh, ["term"], ["hits", "precision"]).select("term", "stale")


EXCLUDED = [x.term for x in LEXICON.terms if x.role == "exclusion"]


@query(
    "exclusion_stats",
    f"""WITH {EXPERTS}, h AS (SELECT unnest({names_sql(EXCLUDED)}) AS term, llm_category AS label FROM expert), x(term) AS (VALUES {', '.join(f"('{e}')" for e in EXCLUDED)})
    SELECT x.term, count(h.term) AS hits, CASE WHEN count(h.term) > 0 THEN round(count(*) FILTER (label = 'ambiguous') / count(h.term), 3) ELSE 0 END AS ambiguous_share
    FROM x LEFT JOIN h ON x.term = h.term GROUP BY 1""",
)
def exclusion_stats(t):
    return lexicon_stats.exclusion_stats(_labelled(t), "t", "llm_category", LEXICON, "hits")


# ---- rule labels --------------------------------------------------------------
@query("rule_labels", f"WITH {RULED} SELECT record_id, label, rule_path, confidence FROM ruled")
def rule_labels(t):
    return ruled_documents(t).select("record_id", "label", "rule_path", "confidence")


@query("weighted_vote_top2", f"WITH {RULED} SELECT record_id, top AS top_category, top_score, second AS second_category, second_score, margin FROM ruled")
def weighted_vote_top2(t):
    return ruled_documents(t).select("record_id", "top_category", "top_score", "second_category", "second_score", "margin")


TERM_NAMES = "[" + ", ".join(f"'{x.term}{' (conditional)' if x.role == 'conditional' else ''}'" for x in LEXICON.terms) + "]"


@query(
    "matched_evidence",
    f"""WITH {RULED}, m AS (SELECT record_id, unnest([{', '.join(f"{{'category': '{c}', 'ids': CASE WHEN rule_path IN ('off_domain_ecology', 'off_domain_engineering', 'no_evidence', 'anchor_only') THEN list_filter(kw, lambda x: list_contains({sql_ids(LEXICON.ids('keyword', c))}, x)) ELSE v_{c} END}}" for c in vocab.CATEGORIES)}]) AS s FROM ruled)
    SELECT record_id, s.category AS category, list_transform(s.ids, lambda i: {TERM_NAMES}[i + 1]) AS terms FROM m WHERE len(s.ids) > 0""",
)
def matched_evidence(t):
    return ruled_documents(t).select("record_id", F.explode("matched_keywords").alias("category", "terms"))


PLAIN_NAMES = "[" + ", ".join(f"'{x.term}'" for x in LEXICON.terms) + "]"
_NAMES = lambda c: f"array_to_string(list_transform({c}, lambda i: {PLAIN_NAMES}[i + 1]), ', ')"
_ROLE = lambda role: f"list_filter(hits, lambda x: list_contains({sql_ids(LEXICON.ids(role))}, x))"
_NUMBERS = "printf('%s (%.3f) against %s (%.3f), margin %.3f', top, top_score, second, second_score, margin)"
_WINNERS = "CASE top " + " ".join(f"WHEN '{c}' THEN {_NAMES(f'v_{c}')}" for c in vocab.CATEGORIES) + " END"
REASONS = {
    "off_domain_ecology": f"'Plant or ecology vocabulary without a human or biomedical marker: ' || {_NAMES(_ROLE('ecology'))} || '.'",
    "off_domain_engineering": f"'Engineering or materials vocabulary without biomedical context: ' || {_NAMES(_ROLE('engineering'))} || '.'",
    "no_evidence": "'Neither an anchor nor a lexicon keyword occurs.'", "anchor_only": "'An anchor occurs, but no category keyword does.'",
    "boundary_mechanism": "'Mechanism wording assigns the intervention boundary to ageing biology: ' || c_mechanism || '.'",
    "boundary_developing": f"'Developing or testing wording supports an intervention: ' || {_NAMES('v_' + INT)} || '.'",
    "boundary_contested": "'Intervention vocabulary without developing or testing wording goes to ageing biology.'",
    "boundary_undecided": "'Intervention vocabulary alone, with neither testing nor mechanism wording.'",
    "single_category": f"'Only ' || top || ' has keywords: ' || {_WINNERS} || '.'", "single_weak": f"'Only ' || top || ' has keywords, below the evidence floor: ' || {_WINNERS} || '.'",
    "tie_mechanism": "'Mechanism wording decides a close call for ageing biology: ' || c_mechanism || '.'", "tie_service": "'Service wording decides a close call for care.'",
    "tie_society": "'Society wording decides a close call for population ageing.'", "tie_treatment": "'Treatment wording in an older population decides a close call for disease.'",
    "tie_relative": f"'A clear relative lead decides: ' || {_NUMBERS} || '.'", "tie_undecided": f"'Too close to call: ' || {_NUMBERS} || '.'",
    "decisive": f"'Keywords decide for ' || top || ': ' || {_WINNERS} || '.'",
}


@query(
    "rule_reasons",
    f"""WITH {RULED} SELECT record_id, CASE rule_path {' '.join(f"WHEN '{k}' THEN {v}" for k, v in REASONS.items())} END AS reason,
      list_concat(list_transform({_ROLE('anchor')}, lambda i: {PLAIN_NAMES}[i + 1]), CASE WHEN c_older_reference <> '' AND NOT list_contains(list_transform({_ROLE('anchor')}, lambda i: {PLAIN_NAMES}[i + 1]), c_older_reference)
        THEN [c_older_reference] ELSE []::VARCHAR[] END) AS anchor_terms FROM ruled""",
)
def rule_reasons(t):
    return ruled_documents(t).select("record_id", "reason", "anchor_terms")


@query("label_distribution", f"WITH {RULED} SELECT label, count(*) AS n FROM ruled GROUP BY 1")
def label_distribution(t):
    return lexicon_stats.label_distribution(ruled_documents(t))


@query(
    "legacy_agreement",
    f"""WITH {RULED_EXPERTS} SELECT count(*) FILTER (llm_category IN ({sql_list(vocab.CATEGORIES)})) AS compared,
      count(*) FILTER (llm_category IN ({sql_list(vocab.CATEGORIES)}) AND label = llm_category) AS agreeing,
      round(count(*) FILTER (llm_category IN ({sql_list(vocab.CATEGORIES)}) AND label = llm_category) / count(*) FILTER (llm_category IN ({sql_list(vocab.CATEGORIES)})), 4) AS agreement FROM ruled""",
)
def legacy_agreement(t):
    return lexicon_stats.legacy_agreement(ruled_documents(t, experts=True))


@query(
    "agreement_by_label",
    f"""WITH {RULED_EXPERTS}, g AS (SELECT CASE WHEN grouping(label) = 1 THEN 'overall' ELSE label END AS label, count(*) AS n,
      count(*) FILTER (label = expert_label) AS agreeing FROM ruled GROUP BY GROUPING SETS ((label), ()))
    SELECT label, n, agreeing, round(agreeing / n, 4) AS rate, CASE label {' '.join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in vocab.BASELINE_AGREEMENT.items())} END AS baseline FROM g""",
)
def agreement_by_label(t):
    return lexicon_stats.agreement_by_label(ruled_documents(t, experts=True))


def _drivers_sql(k=15):
    own = "CASE label " + " ".join(f"WHEN '{c}' THEN v_{c}" for c in vocab.CATEGORIES) + " ELSE []::INT[] END"
    return f"""WITH {RULED}, d AS (SELECT label, unnest(list_transform({own}, lambda i: {TERM_NAMES}[i + 1])) AS term FROM ruled), c AS (SELECT label, term, count(*) AS n FROM d GROUP BY 1, 2)
    SELECT label, term, n FROM c QUALIFY row_number() OVER (PARTITION BY label ORDER BY n DESC, term) <= {k}"""


@query("keyword_drivers", _drivers_sql())
def keyword_drivers(t):
    return awards.keyword_drivers(ruled_documents(t)).drop("rank")


@query("top_drivers", _drivers_sql(2))
def top_drivers(t):
    return awards.keyword_drivers(ruled_documents(t), k=2).drop("rank")


# ---- census labels --------------------------------------------------------------
CENSUS_LEX = Lexicon.of(x for x in LEXICON.terms if x.role in ("keyword", "anchor", "exclusion", "trap"))


def _census_sql() -> str:
    lex, w = CENSUS_LEX, "([" + ", ".join(str(float(x.weight or 0)) for x in CENSUS_LEX.terms) + "]::DOUBLE[])"
    cats = lex.categories()
    only = lambda v, ids: f"list_filter({v}, lambda x: list_contains({sql_ids(ids)}, x))"
    mine = ", ".join(f"{only('kw', lex.ids('keyword', c))} AS v{i}" for i, c in enumerate(cats))
    best = ", ".join(
        f"{{'score': round(coalesce(list_sum(list_transform(v{i}, lambda j: {w}[j + 1])), 0), 3), 'rank': {-i}, 'category': '{c}'}}" for i, c in enumerate(cats)
    )
    return f"""{DOCUMENTS}, k0 AS (SELECT *, {sql_hits('ev', lex)} AS hits FROM docs),
    k1 AS (SELECT *, len({only('hits', lex.ids('anchor', lang='en'))}) > 0 AS anchor_matched FROM k0),
    k2 AS (SELECT *, list_filter(hits, lambda x: list_contains(CASE WHEN anchor_matched THEN {sql_ids(lex.ids('keyword'))} ELSE {sql_ids(lex.ids('keyword', requires=None))} END, x)) AS kw FROM k1),
    k3 AS (SELECT *, {mine}, len({only('hits', lex.ids('exclusion'))}) AS flags FROM k2),
    k4 AS (SELECT *, list_reverse(list_sort([{best}]))[1] AS b FROM k3),
    census AS (SELECT *, CASE WHEN b.score > 0 THEN b.category WHEN flags > 0 THEN 'not_relevant' ELSE 'ambiguous' END AS rule_category, b.score AS rule_score FROM k4)"""


CENSUS = _census_sql()


def census_labelled(t):
    return census.label_census(documents(t).select("record_id", "title", "abstract", "source", "amount_eur", "lang"), "title", "abstract", CENSUS_LEX)


@query("census_labels", f"WITH {CENSUS} SELECT record_id, rule_category, rule_score, anchor_matched, flags::BIGINT AS exclusions FROM census")
def census_labels(t):
    c = census_labelled(t)
    return c.select("record_id", "rule_category", "rule_score", "anchor_matched", F.size("exclusion_flags").cast("bigint").alias("exclusions"))


@query(
    "census_summary",
    f"""WITH {CENSUS}, c AS (SELECT source, rule_category, count(*) AS records, CAST(sum(amount_eur) AS DOUBLE) AS amount_eur,
      count(*) FILTER (anchor_matched) AS anchor_matched, count(*) FILTER (flags > 0) AS exclusion_flagged, count(*) FILTER (lang = 'es') AS broad_only_records FROM census GROUP BY 1, 2)
    SELECT *, (sum(records) OVER (PARTITION BY source))::BIGINT AS source_records FROM c""",
)
def census_summary(t):
    return census.summarise_census(census_labelled(t).withColumn("broad_only", F.col("lang") == "es"))


@query(
    "census_top_terms",
    f"""WITH {CENSUS}, p AS (SELECT source, unnest(list_transform(kw, lambda i: [{', '.join(f"'{x.category}/{x.term}'" for x in CENSUS_LEX.terms)}][i + 1])) AS pair FROM census),
    c AS (SELECT source, split_part(pair, '/', 1) AS category, split_part(pair, '/', 2) AS term, count(*) AS n FROM p GROUP BY ALL)
    SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, category, term) <= 20""",
)
def census_top_terms(t):
    return census.top_terms(census_labelled(t)).drop("rank")


# ---- quotes -----------------------------------------------------------------------
@query(
    "quote_verification",
    r"""WITH q AS (SELECT item_id, text AS quote, (item_id * 7) % (SELECT count(*) FROM documents) AS doc_id FROM benchmark
      UNION ALL SELECT 1000000 + doc_id * 100000 + i, replace(line, ' ', '  ') || CASE WHEN i % 7 = 3 THEN 'x' ELSE '' END, doc_id
        FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents))
    SELECT item_id, CASE WHEN quote <> '' AND length(quote) <= 400 THEN contains(regexp_replace(lower(d.text), '\s+', ' ', 'g'), regexp_replace(lower(quote), '\s+', ' ', 'g')) ELSE false END AS quote_valid
    FROM q JOIN documents d USING (doc_id)""",
)
def quote_verification(t):
    n = t.documents.select(F.count(F.lit(1))).scalar()
    b = t.benchmark.select("item_id", F.col("text").alias("quote"), ((F.col("item_id") * 7) % n).alias("doc_id"))
    # every line of every text, some with a letter too many
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    changed = F.concat(F.replace("line", F.lit(" "), F.lit("  ")), F.when(F.col("i") % 7 == 3, "x").otherwise(""))
    d = lines.select((F.col("doc_id") * 100000 + F.col("i") + 1000000).alias("item_id"), changed.alias("quote"), "doc_id")
    # a text is folded once, below the join, not once a line
    j = b.unionByName(d).join(t.documents.select("doc_id", squeeze(F.col("text")).alias("folded")), "doc_id")
    return j.select("item_id", matching.quote_found(F.col("quote"), F.col("folded"), squeezed=True).alias("quote_valid"))


@query(
    "pending_queue",
    f"""WITH {RULED} SELECT record_id, CAST(amount_eur AS DOUBLE) AS amount_eur FROM ruled
    WHERE label = 'ambiguous' AND record_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1) ORDER BY amount_eur DESC, record_id LIMIT 50""",
)
def pending_queue(t):
    from grantmill.operators.ranking import largest

    done = t.labels.filter("quality = 1").select(F.col("doc_id").alias("record_id"))
    todo = overlay.pending(ruled_documents(t).select("record_id", "label", "amount_eur"), done)
    return largest(todo, [F.desc("amount_eur"), F.col("record_id")], 50).select("record_id", F.col("amount_eur").cast("double").alias("amount_eur"))


@query("ambiguous_semi", f"WITH {RULED} SELECT doc_id AS record_id, n_chars FROM documents WHERE doc_id IN (SELECT record_id FROM ruled WHERE label = 'ambiguous')")
def ambiguous_semi(t):
    corpus = t.documents.select(F.col("doc_id").alias("record_id"), "n_chars")
    return overlay.undecided_records(corpus, ruled_documents(t).select("record_id", "label"))


__all__ = ["classify", "evidence_text", "keyword_in_context", "term_pattern", "RULES", "sql_case"]
