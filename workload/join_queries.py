"""Record joins, set operations and the adjudication flow."""

from __future__ import annotations

from pyspark.sql import functions as F

from grantmill import vocab
from grantmill.operators import adjudication, index, overlay

from .base import (
    ADJUDICATION_LOG, CUSTOMERS, DOCUMENTS, EXPERTS, RULED, adjudication_log, documents, labelled_customers, query, ruled_documents,
    sql_list, with_experts,
)


@query("text_attach", f"WITH {RULED} SELECT r.record_id, r.label, length(d.text)::BIGINT AS chars FROM ruled r JOIN documents d ON d.doc_id = r.record_id")
def text_attach(t):
    labels = ruled_documents(t).select("record_id", "label")
    texts = t.documents.select(F.col("doc_id").alias("record_id"), F.length("text").cast("bigint").alias("chars"))
    return overlay.attach(labels, texts)


@query("expert_attach", f"WITH {EXPERTS} SELECT record_id, expert_label, llm_category FROM expert")
def expert_attach(t):
    return with_experts(t, documents(t)).select("record_id", "expert_label", "llm_category")


@query(
    "key_resolution",
    f"""WITH {CUSTOMERS}, {ADJUDICATION_LOG} SELECT item_id AS input_id, item_id * 3 AS record_id, l.label AS rules_label, coalesce(a.label, l.label) AS adjudicated_label
    FROM benchmark LEFT JOIN labelled l ON l.record_id = item_id * 3 LEFT JOIN adjudicated a ON a.record_id = item_id * 3""",
)
def key_resolution(t):
    items = t.benchmark.select(F.col("item_id").alias("input_id"))
    keys = items.withColumn("record_id", F.col("input_id") * 3)
    answers = overlay.latest_success(adjudication_log(t), order=["answered", "seq"])
    out = overlay.resolve_keys(items, keys, labelled_customers(t), answers)
    return out.select("input_id", "record_id", "rules_label", "adjudicated_label")


COUNTRY_IDS = """ids AS (SELECT lower(left(r_name, 2)) || '-' || c_custkey AS id FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
known AS (SELECT upper(left(r_name, 2)) AS country FROM region WHERE r_regionkey < 3)"""


@query("prefix_join_orphans", f"WITH {COUNTRY_IDS} SELECT id, upper(left(id, 2)) AS country, upper(left(id, 2)) NOT IN (SELECT country FROM known) AS orphan FROM ids")
def prefix_join_orphans(t):
    place = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    ids = t.customer.join(place, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.concat_ws("-", F.lower(F.substring("r_name", 1, 2)), "c_custkey").alias("id")
    )
    countries = t.region.filter("r_regionkey < 3").select(F.upper(F.substring("r_name", 1, 2)).alias("country"))
    known, orphans = index.country_of_id(ids, countries, "id")
    both = known.withColumn("orphan", F.lit(False)).unionByName(orphans.withColumn("orphan", F.lit(True)))
    return both.select("id", "country", "orphan")


@query(
    "net_recall",
    f"""WITH {CUSTOMERS}, c AS (SELECT record_id, amount_eur FROM labelled WHERE label <> 'ambiguous'),
    p AS (SELECT o_custkey AS record_id, CAST(max(c_acctbal) + CASE WHEN o_custkey % 9 = 0 THEN 1 ELSE 0 END AS DECIMAL(18,2)) AS amount_eur FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1)
    SELECT count(*) AS listed, count(c.record_id) AS found, count(*) FILTER (c.record_id IS NOT NULL AND p.amount_eur IS NOT DISTINCT FROM c.amount_eur) AS equal_amount,
      round(count(c.record_id) / count(*), 4) AS recall FROM p LEFT JOIN c USING (record_id)""",
)
def net_recall(t):
    corpus = labelled_customers(t).filter("label <> 'ambiguous'")
    j = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    listed = j.groupBy(F.col("o_custkey").alias("record_id")).agg(F.max("c_acctbal").alias("m")).select(
        "record_id", (F.col("m") + F.when(F.col("record_id") % 9 == 0, 1).otherwise(0)).cast("decimal(18,2)").alias("amount_eur")
    )
    return overlay.net_recall(listed, corpus, "record_id", "amount_eur")


@query(
    "run_overlap_agreement",
    """SELECT count(*) AS shared, count(*) FILTER (a.quality = b.toxic) AS agreeing, round(avg((a.quality = b.toxic)::INT), 4) AS agreement
    FROM labels a JOIN (SELECT * FROM labels WHERE doc_id % 3 <> 0) b USING (doc_id)""",
)
def run_overlap_agreement(t):
    a = t.labels.select(F.col("doc_id").alias("record_id"), F.col("quality").alias("label"))
    b = t.labels.filter("doc_id % 3 <> 0").select(F.col("doc_id").alias("record_id"), F.col("toxic").alias("label"))
    return overlay.run_overlap(a, b)


@query("id_difference", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def id_difference(t):
    return overlay.id_difference(t.documents.select("doc_id"), t.labels, "doc_id")


@query("id_intersection", "SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels WHERE toxic = 1")
def id_intersection(t):
    return overlay.id_intersection(t.documents, t.labels.filter("toxic = 1"), "doc_id")


@query(
    "vocabulary_drift",
    f"""WITH {CUSTOMERS}, {ADJUDICATION_LOG}, a AS (SELECT DISTINCT label FROM labelled), b AS (SELECT DISTINCT label FROM adj_log)
    SELECT label, 'left' AS only_in FROM a WHERE label NOT IN (SELECT label FROM b) UNION ALL SELECT label, 'right' FROM b WHERE label NOT IN (SELECT label FROM a)""",
)
def vocabulary_drift(t):
    return overlay.vocabulary_drift(labelled_customers(t), adjudication_log(t), "label")


# ---- adjudication --------------------------------------------------------------
@query("compaction", f"WITH {ADJUDICATION_LOG} SELECT record_id, label, reason FROM adjudicated")
def compaction(t):
    return overlay.latest_success(adjudication_log(t), order=["answered", "seq"]).select("record_id", "label", "reason")


def answers(t):
    """One answer per order about its customer, quoting the customer's name."""
    k = F.col("o_orderkey")
    quote = F.when(k % 5 == 0, F.concat(F.lit("customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"))).when(
        k % 5 == 1, F.lit("")
    ).when(k % 5 == 2, F.lit("no such words")).otherwise(F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")))
    return adjudication_log(t).select(
        F.col("record_id").alias("o_custkey"), F.col("seq").alias("o_orderkey"), "error",
        F.when(F.col("seq") % 8 == 0, "ambiguous").when(F.col("seq") % 19 == 0, "unheard").otherwise(F.col("label")).alias("label"),
    ).withColumn("quote", quote).withColumnRenamed("o_custkey", "record_id")


def sources(t):
    return t.customer.filter("c_custkey % 10 <> 0").select(
        F.col("c_custkey").alias("record_id"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("abstract")
    )


ANSWERS = f"""{ADJUDICATION_LOG}, answers AS (SELECT record_id, error, CASE WHEN seq % 8 = 0 THEN 'ambiguous' WHEN seq % 19 = 0 THEN 'unheard' ELSE label END AS label,
  CASE seq % 5 WHEN 0 THEN 'customer#' || lpad(record_id::VARCHAR, 9, '0') WHEN 1 THEN '' WHEN 2 THEN 'no such words' ELSE 'Customer#' || lpad(record_id::VARCHAR, 9, '0') END AS quote FROM adj_log),
sources AS (SELECT c_custkey AS record_id, c_name || ' ' || c_mktsegment AS src FROM customer WHERE c_custkey % 10 <> 0)"""


@query(
    "verification_report",
    f"""WITH {ANSWERS}, n AS (SELECT *, count(*) OVER (PARTITION BY record_id) AS n FROM answers), j AS (SELECT n.*, src FROM n LEFT JOIN sources USING (record_id))
    SELECT count(*) AS answers, count(*) - count(DISTINCT record_id) AS duplicates, count(*) FILTER (src IS NULL) AS missing_source,
      count(*) FILTER (src IS NOT NULL AND label NOT IN ({sql_list(vocab.LABELS)})) AS unknown_label,
      count(*) FILTER (src IS NOT NULL AND (trim(quote) = '' OR NOT contains(lower(src), lower(trim(quote))))) AS quote_missing,
      count(*) FILTER (contains(src, quote)) AS case_exact, count(*) FILTER (label <> 'ambiguous' AND src IS NOT NULL) AS resolved FROM j""",
)
def verification_report(t):
    return adjudication.verification_report(adjudication.verify(answers(t), sources(t)))


@query("verification_labels", f"WITH {ANSWERS} SELECT label, count(*) AS n FROM answers JOIN sources USING (record_id) WHERE src IS NOT NULL GROUP BY 1")
def verification_labels(t):
    return adjudication.label_counts(adjudication.verify(answers(t), sources(t)))


@query(
    "run_tally",
    f"""WITH {ANSWERS} SELECT label, count(*) AS n, count(*) FILTER (quote <> '' AND contains(lower(src), lower(quote))) AS valid_quotes, count(error) AS errors
    FROM answers LEFT JOIN sources USING (record_id) GROUP BY 1""",
)
def run_tally(t):
    return adjudication.run_tally(adjudication.check_quotes(answers(t), sources(t)))


@query(
    "work_queue",
    f"""WITH {CUSTOMERS}, {ADJUDICATION_LOG} SELECT record_id, CAST(coalesce(amount_eur, 0) AS DOUBLE) AS amount_eur, c_mktsegment AS abstract FROM labelled JOIN customer ON c_custkey = record_id
    WHERE label = 'ambiguous' AND region = 'ASIA' AND record_id NOT IN (SELECT record_id FROM adjudicated WHERE record_id % 4 = 0) ORDER BY 2 DESC, 1 LIMIT 20""",
)
def work_queue(t):
    done = overlay.latest_success(adjudication_log(t), order=["answered", "seq"]).filter("record_id % 4 = 0")
    texts = t.customer.select(F.col("c_custkey").alias("record_id"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("abstract"))
    q = adjudication.work_queue(labelled_customers(t).drop("title"), done, texts, region="ASIA", limit=20)
    return q.select("record_id", F.col("amount_eur").cast("double").alias("amount_eur"), "abstract")


@query(
    "prompt_table",
    rf"""WITH {DOCUMENTS} SELECT record_id, 'Record ' || record_id || ': ' || title || chr(10) || CASE WHEN length(abstract) > 3000 THEN substring(abstract, 1, 3000) || '...' ELSE abstract END AS prompt FROM docs""",
)
def prompt_table(t):
    d = documents(t).select("record_id", "title", "abstract")
    return adjudication.prompt(d, "Record %s: %s\n%s").select("record_id", "prompt")


REPLY = {0: "care", 1: "intervention"}


@query(
    "response_parse",
    """SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'care' WHEN 1 THEN 'intervention' WHEN 4 THEN 'care' ELSE 'ambiguous' END AS label,
      CASE doc_id % 5 WHEN 2 THEN 'unreadable answer' WHEN 3 THEN 'unreadable answer' END AS error, CASE doc_id % 5 WHEN 0 THEN lang WHEN 1 THEN source ELSE '' END AS quote FROM documents""",
)
def response_parse(t):
    m, lit = F.col("doc_id") % 5, F.lit
    content = (
        F.when(m == 0, F.concat(lit('Sure.\n```json\n{"label": "care", "quote": "'), F.col("lang"), lit('"}\n```\nDone.')))
        .when(m == 1, F.concat(lit('Answer: {"label": "intervention", "quote": "'), F.col("source"), lit('", "usage": {"n": 1}} end')))
        .when(m == 2, F.concat(lit("no braces "), F.col("lang")))
        .when(m == 3, F.concat(lit('{"label": "care", "quote": '), F.col("source"), lit("}")))
        .otherwise(lit('  {"label": "care"}  '))
    )
    parsed = adjudication.parse_response(t.documents.select("doc_id", content.alias("content")))
    return parsed.select("doc_id", "label", "error", "quote")
