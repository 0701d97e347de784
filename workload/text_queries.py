"""Grams, candidate mining and text projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from grantmill import vocab
from grantmill.functions.text import evidence_text, strip, url_quote
from grantmill.operators import awards, mining
from grantmill.operators.lexicon import Lexicon, Term
from grantmill.operators.matching import match_terms
from grantmill.operators.ranking import top_k
from grantmill.session import materialise

from .base import ARD, CARE, DOCUMENTS, FA, INT, LEXICON, RULED_EXPERTS, SOC, documents, query, ruled_documents, sql_has, sql_hits, sql_list, with_experts

STOP = ["the", "and", "for", "with", "les", "und", "los"]


def sql_grams(text: str, stop=STOP, n: int = 3, least: int = 3) -> str:
    """Expression: distinct grams of a text column."""
    stopped = f" AND w NOT IN ({sql_list(stop)})" if stop else ""
    k = f"list_transform(regexp_extract_all(lower({text}), '\\p{{L}}+'), lambda w: CASE WHEN length(w) >= {least}{stopped} THEN w END)"
    parts = ["k"] + [
        f"list_transform(range(1, len(k) - {i - 1} + 1), lambda i: " + " || ' ' || ".join(f"k[i + {j}]" for j in range(i)) + ")" for i in range(2, n + 1)
    ]
    joined = "list_concat(" + ", ".join(parts) + ")" if n > 1 else "k"
    return f"(SELECT list_distinct(list_filter({joined}, lambda g: g IS NOT NULL)) FROM (SELECT {k} AS k))"


GRAMS = f"{DOCUMENTS}, g AS (SELECT record_id, unnest({sql_grams('text')}) AS gram FROM docs)"


@query("grams", f"WITH {GRAMS} SELECT gram, count(*) AS n, sum(record_id)::BIGINT AS ids FROM g GROUP BY 1")
def grams(t):
    g = mining.grams(documents(t).select("record_id", "text"), "record_id", "text", STOP)
    return g.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), F.sum("record_id").alias("ids"))


PROPER = r"""pairs AS (SELECT record_id, regexp_extract_all(text, '([^\p{L}]*)(\p{L}+)', 1) AS s, regexp_extract_all(text, '([^\p{L}]*)(\p{L}+)', 2) AS k,
  regexp_extract(text, '[^\p{L}]*$') AS tail FROM texts),
tok AS (SELECT record_id, unnest(range(1, len(k) + 1)) AS i, s, k, tail FROM pairs),
tok2 AS (SELECT record_id, k[i] AS w, trim(replace(replace(s[i], chr(10), ' '), chr(9), ' ')) AS sep, i, s[i] AS raw, CASE WHEN i < len(k) THEN s[i + 1] ELSE tail END AS nxt FROM tok),
tok3 AS (SELECT record_id, lower(w) AS token, regexp_matches(w, '^\p{Lu}') AND NOT (regexp_matches(sep, '[.!?;:]$') OR (i = 1 AND sep = '')) AS upper
  FROM tok2 WHERE length(w) >= 3 AND NOT regexp_matches(raw, '[\p{N}_]$') AND NOT regexp_matches(nxt, '^[\p{N}_]')),
proper AS (SELECT record_id, token, count(*) AS total, count(*) FILTER (upper) AS upper FROM tok3 GROUP BY 1, 2 HAVING total >= 2 AND count(*) FILTER (upper) / total >= 0.8)"""


@query("proper_tokens", f"WITH {DOCUMENTS}, texts AS (SELECT record_id, text FROM docs), {PROPER} SELECT * FROM proper")
def proper_tokens(t):
    return mining.proper_tokens(documents(t).select("record_id", "text"), "record_id", "text")


def mining_docs(t):
    r = ruled_documents(t, experts=True)
    return r.select("record_id", "title", "text", F.col("expert_label").alias("expert"), "label", F.col("amount_eur").alias("amount"))


CATS = ", ".join(f"('{c}', {i})" for i, c in enumerate(vocab.CATEGORIES))
MINING = f"""{RULED_EXPERTS}, d AS (SELECT record_id, text, amount_eur AS amount, expert_label AS expert, label = 'ambiguous' AS blind,
  regexp_replace(lower(title), '[^\\p{{L}}\\p{{N}}\\p{{M}}_]+', ' ', 'g') AS title_key FROM ruled WHERE expert_label IN ({sql_list(vocab.CATEGORIES)})),
cats(category, rank) AS (VALUES {CATS}),
totals AS (SELECT category, count(DISTINCT title_key) FILTER (expert = category AND blind) AS n_pos, count(DISTINCT title_key) FILTER (expert <> category) AS n_bg FROM d, cats GROUP BY 1),
g AS (SELECT record_id, expert, blind, title_key, amount, length(text) AS chars, unnest({sql_grams('text')}) AS gram FROM d),
counts AS (SELECT gram, category, count(*) FILTER (expert = category AND blind) AS a, count(*) FILTER (expert <> category) AS b FROM g, cats GROUP BY 1, 2 HAVING a >= 3),
lifts AS (SELECT *, ((a + 0.5::DOUBLE) / (n_pos + 0.5::DOUBLE)) / ((b + 0.5::DOUBLE) / (n_bg + 0.5::DOUBLE)) AS lift FROM counts JOIN totals USING (category))"""


def scored(t):
    # three steps read the labelled documents, so the rules run once
    return mining.scored_grams(materialise(mining.prepare(mining_docs(t)), "mining-docs"), STOP)


@query("candidate_lift", f"WITH {MINING} SELECT gram, category, a, b, n_pos, n_bg, round(lift, 6) AS lift FROM lifts")
def candidate_lift(t):
    s = scored(t)
    return s.withColumn("lift", F.round("lift", 6))


KNOWN = [x.term for x in LEXICON.terms if x.role in ("keyword", "anchor", "exclusion")]
TRAPS = [x.term for x in LEXICON.terms if x.role == "trap"]
MINED = f"""{MINING},
passing AS (SELECT * FROM lifts WHERE lift >= 3 AND (contains(gram, ' ') OR b = 0) AND NOT ({' OR '.join(sql_has('gram', w) for w in dict.fromkeys(KNOWN))})),
pos AS (SELECT g.*, category FROM g JOIN passing USING (gram) WHERE blind AND expert = category),
eur AS (SELECT category, gram, CAST(sum(amount) AS DOUBLE) AS eur FROM (SELECT category, gram, title_key, arg_min(amount, record_id) AS amount FROM pos GROUP BY 1, 2, 3) GROUP BY 1, 2),
ex AS (SELECT category, gram, record_id FROM pos QUALIFY row_number() OVER (PARTITION BY category, gram ORDER BY chars DESC, record_id) = 1),
texts AS (SELECT DISTINCT d.record_id, d.text FROM d JOIN ex USING (record_id)), {PROPER},
named AS (SELECT DISTINCT category, gram FROM (SELECT category, gram, record_id, unnest(string_split(gram, ' ')) AS token FROM ex) JOIN proper USING (record_id, token)),
kept AS (SELECT p.*, eur, record_id FROM passing p JOIN eur USING (category, gram) JOIN ex USING (category, gram) WHERE NOT EXISTS (SELECT 1 FROM named n WHERE n.category = p.category AND n.gram = p.gram)),
top AS (SELECT * FROM kept QUALIFY row_number() OVER (PARTITION BY category ORDER BY round(lift, 2) DESC, a DESC, gram) <= 60),
best AS (SELECT top.* FROM top JOIN cats USING (category) QUALIFY row_number() OVER (PARTITION BY gram ORDER BY round(lift, 2) DESC, rank) = 1)"""


@query(
    "mined_candidates",
    f"""WITH {MINED} SELECT category, gram AS term, len(string_split(gram, ' '))::BIGINT AS words, a AS n_pos, b AS n_bg, round(lift, 2) AS lift, round(eur / 1e6, 2) AS eur_pos_m,
      gram IN ({sql_list(TRAPS)}) AS is_trap, record_id AS example_record_id FROM best""",
)
def mined_candidates(t):
    m = mining.mine_candidates(mining_docs(t), LEXICON, STOP)
    return m.drop("context").withColumn("words", F.col("words").cast("bigint"))


_EDGE = r"[^\p{L}\p{N}\p{M}_]"
_AROUND = rf"'(?s)^(.*?(?:^|{_EDGE}))(' || replace(gram, ' ', '\s+') || ')(?:$|{_EDGE})'"


@query(
    "candidate_context",
    f"""WITH {MINED}, m AS (SELECT category, gram, d.text, regexp_extract(d.text, {_AROUND}, 2) AS hit, length(regexp_extract(d.text, {_AROUND}, 1)) + 1 AS p FROM best JOIN d USING (record_id))
    SELECT category, gram AS term, CASE WHEN hit = '' THEN '' ELSE replace(substring(text, greatest(p - 70, 1)::BIGINT, (p + length(hit) + 70 - greatest(p - 70, 1))::BIGINT), chr(10), ' ') END AS context FROM m""",
)
def candidate_context(t):
    return mining.mine_candidates(mining_docs(t), LEXICON, STOP).select("category", "term", "context")


@query("top_candidates", f"WITH {MINING} SELECT category, gram, round(lift, 2) AS lift, a FROM lifts QUALIFY row_number() OVER (PARTITION BY category ORDER BY round(lift, 2) DESC, a DESC, gram) <= 5")
def top_candidates(t):
    s = scored(t).select("category", "gram", F.round("lift", 2).alias("lift"), "a")
    return top_k(s, ["category"], [F.desc("lift"), F.desc("a"), F.col("gram")], 5).drop("rank")


@query("best_category", f"WITH {MINING} SELECT gram, category, round(lift, 2) AS lift FROM lifts JOIN cats USING (category) QUALIFY row_number() OVER (PARTITION BY gram ORDER BY round(lift, 2) DESC, rank) = 1")
def best_category(t):
    s = scored(t).select("gram", "category", "lift")
    return mining.best_category(s, vocab.CATEGORIES).select("gram", "category", F.round("lift", 2).alias("lift"))


WORDS = f"{DOCUMENTS}, w AS (SELECT record_id, source, amount_eur, text, regexp_replace(lower(title), '[^\\p{{L}}\\p{{N}}\\p{{M}}_]+', ' ', 'g') AS title_key, unnest({sql_grams('text', n=1)}) AS gram FROM docs)"


@query("money_by_title_key", f"WITH {WORDS}, o AS (SELECT gram, title_key, arg_min(amount_eur, record_id) AS m FROM w GROUP BY 1, 2) SELECT gram, count(*) AS titles, CAST(sum(m) AS DOUBLE) AS amount FROM o GROUP BY 1")
def money_by_title_key(t):
    return mining.money_by_title_gram(documents(t), "record_id", "text", "title", "amount_eur", STOP)


@query("longest_example", f"WITH {DOCUMENTS} SELECT source, arg_min(record_id, -length(text) * 1000000000000 + record_id) AS example FROM docs GROUP BY 1")
def longest_example(t):
    return mining.longest_example(documents(t), "source", "text", "record_id")


# ---- candidate gates ---------------------------------------------------------------
PROPOSED = Lexicon.of([
    Term("from", "keyword", FA), Term("that is", "keyword", FA), Term("pour", "keyword", INT), Term("des", "keyword", INT), Term("nicht", "keyword", ARD),
    Term("erung", "keyword", ARD), Term("para", "keyword", CARE), Term("por", "keyword", CARE), Term("stupid", "keyword", SOC), Term("trash", "keyword", SOC, requires="trap"),
    Term("worthless", "keyword", SOC), Term("no such words", "keyword", FA), Term("the", "keyword", SOC), Term("idiot", "keyword", SOC, lang="sv"), Term("was", "keyword", ARD),
])
GATES = {"en": (20, 0.3), "sv": (5, 0.2)}


def _gates_sql() -> str:
    rows = ", ".join(f"({x.ord}, '{x.term}', '{x.category}', '{x.lang}', {'true' if x.requires else 'false'})" for x in PROPOSED.terms)
    return f"""WITH {RULED_EXPERTS}, c(ord, term, category, lang, is_trap) AS (VALUES {rows}),
    h AS (SELECT record_id, unnest({sql_hits('ev', PROPOSED)}) AS ord, llm_category, expert_label, label, amount_eur FROM ruled),
    s AS (SELECT c.*, count(h.ord) AS atlas_hits, count(*) FILTER (llm_category = CASE WHEN category = '{SOC}' THEN 'ambiguous' ELSE category END) AS ok,
      count(expert_label) AS expert_hits, count(*) FILTER (expert_label = category) AS eok, count(*) FILTER (label = 'ambiguous') AS census_ambiguous_hits,
      round(coalesce(CAST(sum(amount_eur) FILTER (label = 'ambiguous') AS DOUBLE), 0) / 1e6, 2) AS census_ambiguous_eur_m FROM c LEFT JOIN h ON c.ord = h.ord GROUP BY ALL),
    p AS (SELECT *, CASE WHEN atlas_hits > 0 THEN round(ok / atlas_hits, 3) ELSE 0 END AS prec_llm_proxy, CASE WHEN expert_hits > 0 THEN round(eok / expert_hits, 3) ELSE 0 END AS prec_expert FROM s),
    q AS (SELECT *, CASE lang WHEN 'en' THEN atlas_hits >= 20 AND prec_llm_proxy >= 0.3 ELSE atlas_hits >= 5 AND prec_llm_proxy >= 0.2 END AS gate1, expert_hits >= 3 AND prec_expert >= 0.6 AS gate2 FROM p)
    SELECT category, term, lang, is_trap, atlas_hits, prec_llm_proxy, expert_hits, prec_expert, gate1, gate2, census_ambiguous_hits, census_ambiguous_eur_m,
      CASE WHEN gate1 AND gate2 AND is_trap THEN 'conditional_candidate' WHEN gate1 AND gate2 THEN 'admit' WHEN gate1 AND expert_hits < 3 THEN 'provisional'
        WHEN gate1 THEN 'reject_gate2' WHEN gate2 THEN 'reject_gate1' ELSE 'reject_both' END AS decision FROM q"""


def gated(t):
    docs = documents(t).withColumn("text", evidence_text(F.col("title"), F.col("abstract")))
    found = match_terms(docs, "text", PROPOSED, "found").select("record_id", "lang", "found")
    labelled = with_experts(t, found).select("found", F.col("llm_category").alias("legacy"), F.col("expert_label").alias("expert"))
    low = evidence_text(F.col("title"), F.col("abstract"))
    undecided = ruled_documents(t).filter("label = 'ambiguous'").select(low.alias("text"), F.col("amount_eur").alias("amount"))
    return mining.validate_candidates(PROPOSED, labelled, undecided, GATES, hits="found")


@query("candidate_gates", _gates_sql())
def candidate_gates(t):
    return gated(t)


@query(
    "decision_order",
    f"""SELECT category, term, decision, row_number() OVER (ORDER BY list_position([{sql_list(mining.DECISION_ORDER)}], decision), category, prec_expert DESC, term) AS position
    FROM ({_gates_sql()})""",
)
def decision_order(t):
    return mining.decision_order(gated(t)).select("category", "term", "decision", "position")


@query(
    "genericity_guard",
    f"""WITH {RULED_EXPERTS}, c(ord, term, category) AS (VALUES {', '.join(f"({x.ord}, '{x.term}', '{x.category}')" for x in PROPOSED.terms)}),
    h AS (SELECT unnest({sql_hits('t', PROPOSED)}) AS ord, label FROM ruled WHERE label IN ({sql_list(vocab.CATEGORIES)}))
    SELECT term, category, count(h.ord) AS classified_hits, CASE WHEN count(h.ord) > 0 THEN round(count(*) FILTER (label = category) / count(h.ord), 3) END AS own_share FROM c LEFT JOIN h ON c.ord = h.ord GROUP BY c.ord, term, category""",
)
def genericity_guard(t):
    return mining.genericity(ruled_documents(t).select("t", "label"), "t", PROPOSED)


LANGS = ["en", "fr", "de", "es"]


@query(
    "log_odds",
    f"""WITH {DOCUMENTS}, l(category) AS (VALUES {', '.join(f"('{x}')" for x in LANGS)}), n AS (SELECT category, count(*) FILTER (lang = category) AS i, count(*) FILTER (lang <> category) AS o FROM docs, l GROUP BY 1),
    g AS (SELECT lang, unnest({sql_grams('text', n=2)}) AS gram FROM docs), f AS (SELECT gram, count(*) AS df FROM g GROUP BY 1 HAVING df >= 25),
    c AS (SELECT gram, category, df, count(*) FILTER (lang = category) AS a FROM g JOIN f USING (gram), l GROUP BY 1, 2, 3)
    SELECT category, gram, a AS in_hits, df - a AS out_hits, round(ln((a + 0.5::DOUBLE) / (i - a + 0.5::DOUBLE)) - ln((df - a + 0.5::DOUBLE) / (o - (df - a) + 0.5::DOUBLE)), 4) AS log_odds FROM c JOIN n USING (category)""",
)
def log_odds(t):
    return mining.log_odds(documents(t), "lang", "text", STOP, LANGS, min_docs=25)


NAME_TOKENS = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}]+')"


@query(
    "entity_funnel",
    f"""WITH {DOCUMENTS}, named AS (SELECT unnest(regexp_extract_all(text, '[^ ]+ [^ ]+ [^ ]+ [^ ]+ [^ ]+')) AS name FROM benchmark
      UNION ALL SELECT unnest(regexp_extract_all(text, '\\p{{Lu}}[\\p{{L}}\\p{{N}}-]+')) FROM documents),
    listed AS (SELECT array_to_string({NAME_TOKENS.format('name')}, ' ') AS gram FROM named),
    u AS (SELECT DISTINCT gram FROM listed WHERE gram <> ''), n AS (SELECT DISTINCT len(string_split(gram, ' ')) AS n FROM u WHERE length(gram) >= 3),
    t AS (SELECT record_id, lang, unnest(t) AS w, generate_subscripts(t, 1) AS i FROM (SELECT record_id, lang, {NAME_TOKENS.format('text')} AS t FROM docs)),
    r AS (SELECT record_id, lang, n, string_agg(w, ' ') OVER x AS gram, count(*) OVER x AS c FROM t, n WINDOW x AS (PARTITION BY record_id, n ORDER BY i ROWS BETWEEN CURRENT ROW AND n - 1 FOLLOWING)),
    g AS (SELECT DISTINCT record_id, lang, gram FROM r WHERE c = n),
    h AS (SELECT gram, count(*) AS hits, count(*) FILTER (lang = 'en') AS ok FROM g WHERE gram IN (SELECT gram FROM u WHERE length(gram) >= 3) GROUP BY 1), j AS (SELECT * FROM u LEFT JOIN h USING (gram))
    SELECT 0 AS step, 'listed' AS stage, count(*) AS n FROM listed UNION ALL SELECT 1, 'unique', count(*) FROM j UNION ALL SELECT 2, 'long_enough', count(*) FILTER (length(gram) >= 3) FROM j
    UNION ALL SELECT 3, 'with_hits', count(*) FILTER (hits >= 1) FROM j UNION ALL SELECT 4, 'enough_hits', count(*) FILTER (hits >= 3) FROM j UNION ALL SELECT 5, 'admitted', count(*) FILTER (hits >= 3 AND ok / hits >= 0.6) FROM j""",
)
def entity_funnel(t):
    def pieces(df, pattern):
        return df.select(F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("name"))

    names = pieces(t.benchmark, "[^ ]+ [^ ]+ [^ ]+ [^ ]+ [^ ]+").unionByName(pieces(t.documents, r"\p{Lu}[\p{L}\p{N}-]+"))
    return mining.entity_funnel(names, F.col("name"), documents(t), "text", "lang", "en")


# ---- projections -----------------------------------------------------------------------
@query(
    "screen_and_redact",
    """WITH d AS (SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN 'Award abstract Not Available in public dataset' WHEN 1 THEN ' ' ELSE text END AS text FROM documents)
    SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') = '' AS dropped, trim(text) = '' OR contains(lower(text), 'not available in public dataset') AS redacted FROM d""".replace("\\\\", "\\"),
)
def screen_and_redact(t):
    m = F.col("doc_id") % 9
    text = F.when(m == 0, "Award abstract Not Available in public dataset").when(m == 1, " ").otherwise(F.col("text"))
    d = t.documents.select("doc_id", text.alias("text"))
    return d.select("doc_id", (strip(F.col("text")) == "").alias("dropped"), awards.is_redacted(strip(F.col("text"))).alias("redacted"))


@query("abstract_truncation", "SELECT doc_id, substring(text, 1, 6000) AS abstract FROM documents")
def abstract_truncation(t):
    return t.documents.select("doc_id", F.substring("text", 1, vocab.ABSTRACT_LIMIT).alias("abstract"))


@query("url_build", "SELECT page_id, 'https://www.vr.se/english/swecris.html?searchText=' || replace(url_encode(url), '%2F', '/') AS url FROM pages")
def url_build(t):
    return t.pages.select("page_id", F.concat(F.lit("https://www.vr.se/english/swecris.html?searchText="), url_quote(F.col("url"))).alias("url"))
