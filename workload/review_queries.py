"""Sampling, gate, validation, fingerprints, country index."""

from __future__ import annotations

from pyspark.sql import functions as F

from grantmill import vocab
from grantmill.functions import hashing, stats
from grantmill.functions.text import csv_cell_guard
from grantmill.operators import adjudication, gate, index, ranking, sampling, validation
from grantmill.sources.readers import spread

from .agreement_queries import SLICES, sliced, until
from .base import (
    ARD, CARE, CUSTOMERS, FA, INT, JUDGMENTS, MARK_LABEL, RULED, RULED_EXPERTS, Tables, case, documents, judgment_log, judgments, labelled_customers,
    query, ruled_documents, sql_case, sql_list,
)

SEED = 20260912


def h(expr: str, seed=SEED) -> str:
    return f"sha256('{seed}:' || {expr})"


def half(expr: str, seed=SEED) -> str:
    return f"CASE WHEN strpos('02468ace', right({h(expr, seed)}, 1)) > 0 THEN 'tuning' ELSE 'holdout' END"


@query("hash_split", f"SELECT doc_id, {half('doc_id')} AS split FROM documents")
def hash_split(t):
    return t.documents.select("doc_id", hashing.split_half(F.col("doc_id"), SEED).alias("split"))


@query("reviewer_slices", "SELECT doc_id, ('0x' || left(sha256(doc_id::VARCHAR), 12))::BIGINT % 5 AS slice FROM documents")
def reviewer_slices(t):
    return t.documents.select("doc_id", hashing.reviewer_slice(F.col("doc_id"), 5).alias("slice"))


LOW = f"(confidence < {vocab.LOW_MARGIN} AND label IN ({sql_list(vocab.CATEGORIES)}))"
DIS = f"(llm_category IN ({sql_list(vocab.LEGACY_CATEGORIES)}) AND label <> llm_category)"


@query("boundary_flags", f"WITH {RULED_EXPERTS} SELECT record_id, list_filter([CASE WHEN {LOW} THEN 'low_margin' END, CASE WHEN {DIS} THEN 'llm_disagree' END], lambda x: x IS NOT NULL) AS flags FROM ruled")
def boundary_flags(t):
    r = ruled_documents(t, experts=True)
    return r.select("record_id", sampling.boundary_flags(F.col("label"), F.col("confidence"), F.col("llm_category")).alias("flags"))


GATE_SAMPLE = f"""{RULED_EXPERTS}, pool AS (SELECT record_id, label, source, {LOW} AS low, {DIS} AS dis, {h('record_id')} AS h, record_id IN (SELECT item_id FROM benchmark) AS b FROM ruled),
s1 AS (SELECT record_id, 'benchmark' AS why FROM pool WHERE b),
s2 AS (SELECT record_id, 'stratum_min' AS why FROM pool p WHERE NOT b AND NOT EXISTS (SELECT 1 FROM pool q WHERE q.b AND q.label = p.label AND q.source = p.source)
  QUALIFY row_number() OVER (PARTITION BY label, source ORDER BY h) = 1),
u2 AS (SELECT * FROM s1 UNION ALL SELECT * FROM s2),
s3 AS (SELECT record_id, 'low_margin' AS why FROM pool WHERE low AND record_id NOT IN (SELECT record_id FROM u2) ORDER BY h LIMIT 10),
u3 AS (SELECT * FROM u2 UNION ALL SELECT * FROM s3),
s4 AS (SELECT record_id, 'llm_disagree' AS why FROM pool WHERE dis AND record_id NOT IN (SELECT record_id FROM u3) ORDER BY h LIMIT 10),
u4 AS (SELECT * FROM u3 UNION ALL SELECT * FROM s4),
f AS (SELECT record_id, label, row_number() OVER (PARTITION BY label ORDER BY h) AS turn FROM pool WHERE record_id NOT IN (SELECT record_id FROM u4)),
f2 AS (SELECT record_id, row_number() OVER (ORDER BY turn, label) AS n FROM f),
picked AS (SELECT * FROM u4 UNION ALL SELECT record_id, 'fill' FROM f2 WHERE n <= 250 - (SELECT count(*) FROM u4)),
sample AS (SELECT p.record_id, why, pool.label, source, {half('p.record_id')} AS split FROM picked p JOIN pool USING (record_id))"""


def gate_sample_of(t):
    r = ruled_documents(t, experts=True).select("record_id", "label", "source", "confidence", "llm_category")
    return sampling.gate_sample(r, t.benchmark.select(F.col("item_id").alias("record_id")), SEED, target=250)


@query("gate_sample", f"WITH {GATE_SAMPLE} SELECT record_id, why, label, split FROM sample")
def gate_sample(t):
    return gate_sample_of(t).select("record_id", "why", "label", "split")


@query(
    "sample_manifest",
    f"""WITH {GATE_SAMPLE} SELECT 'label' AS field, label AS value, count(*) AS n FROM sample GROUP BY ALL
    UNION ALL SELECT 'why', why, count(*) FROM sample GROUP BY ALL UNION ALL SELECT 'split', split, count(*) FROM sample GROUP BY ALL""",
)
def sample_manifest(t):
    return sampling.manifest(gate_sample_of(t), ["label", "why", "split"])


@query(
    "sample_meta",
    f"""WITH {GATE_SAMPLE} SELECT {SEED} AS seed, 250 AS target, (SELECT count(*) FROM sample) AS sampled, (SELECT count(*) FROM sample WHERE why = 'benchmark') AS benchmark_records,
      (SELECT count(*) FROM ruled) AS labels_records, (SELECT sum(('0x' || {{fp}})::BIGINT)::VARCHAR FROM ruled) AS labels_digest""".replace(
        "{fp}", "left(sha256(concat_ws(',', coalesce(length(record_id::VARCHAR)::VARCHAR || ':' || record_id::VARCHAR, '-'), coalesce(length(label)::VARCHAR || ':' || label, '-'))), 12)"),
)
def sample_meta(t):
    r = ruled_documents(t).select("record_id", "label")
    return sampling.sample_meta(gate_sample_of(t), r, SEED, 250)


STRATUM = f"CASE WHEN expert_label <> label THEN 'disagreement' WHEN label IN ({sql_list([n for n, _ in vocab.STUDY_STRATA])}) THEN label END"


def quota_ctes(size: int, seed: int) -> str:
    """CTE ``drawn``: a study batch of the rows of ``ruled``."""
    quota = "CASE stratum " + " ".join(f"WHEN '{n}' THEN {round(size * s)}" for n, s in vocab.STUDY_STRATA) + " END"
    return f"""p AS (SELECT record_id, {STRATUM} AS stratum, {h('record_id', seed)} AS h FROM ruled WHERE length(regexp_replace(abstract, '^\\s+|\\s+$', '', 'g')) >= 180),
    r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY h) AS r FROM p WHERE stratum IS NOT NULL),
    c AS (SELECT record_id, stratum FROM r WHERE r <= {quota}),
    l AS (SELECT record_id, row_number() OVER (ORDER BY h) AS n FROM r WHERE r > {quota}),
    drawn AS (SELECT * FROM c UNION ALL SELECT record_id, 'topup' FROM l WHERE n <= {size} - (SELECT count(*) FROM c))"""


@query("quota_sample", f"WITH {RULED_EXPERTS}, {quota_ctes(120, 7)} SELECT * FROM drawn")
def quota_sample(t):
    r = ruled_documents(t, experts=True).select("record_id", "abstract", "label", "expert_label")
    return sampling.quota_sample(r, 120, 7)


@query(
    "stratified_cap",
    f"""WITH y AS (SELECT o_orderkey, year(o_orderdate) AS year, {h('o_orderkey', 42)} AS h FROM orders), c AS (SELECT year, count(*) AS n FROM y GROUP BY 1),
    q AS (SELECT year, least(n, CAST(round_even(n * 2000.0::DOUBLE / greatest((SELECT sum(n) FROM c), 2000), 0) AS BIGINT)) AS q FROM c)
    SELECT o_orderkey, year FROM y JOIN q USING (year) QUALIFY row_number() OVER (PARTITION BY year ORDER BY h) <= any_value(q) OVER (PARTITION BY year)""",
)
def stratified_cap(t):
    o = t.orders.select("o_orderkey", F.year("o_orderdate").cast("bigint").alias("year"))
    return sampling.stratified_cap(o, "year", "o_orderkey", 2000)


@query(
    "audit_sample",
    f"""WITH {CUSTOMERS}, s AS (SELECT record_id, label, region, coalesce(amount_eur, 0) AS a, {h('record_id', 11)} AS h FROM labelled),
    big AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY label, region ORDER BY a DESC, record_id) <= 3),
    rnd AS (SELECT * FROM s WHERE record_id NOT IN (SELECT record_id FROM big) QUALIFY row_number() OVER (PARTITION BY label, region ORDER BY h) <= 5),
    few AS (SELECT * FROM s WHERE label IN (SELECT label FROM s GROUP BY 1 HAVING count(*) <= 10)),
    u AS (SELECT record_id, label, region, 'largest' AS why FROM big UNION ALL SELECT record_id, label, region, 'random' FROM rnd UNION ALL SELECT record_id, label, region, 'rare' FROM few)
    SELECT record_id, label, region, min(why) AS why FROM u GROUP BY 1, 2, 3""",
)
def audit_sample(t):
    return sampling.audit_sample(labelled_customers(t), 11)


# ---- gate --------------------------------------------------------------------
def fp_sql(*cols: str, n: int = 16) -> str:
    net = ", ".join(f"coalesce(length({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')" for c in cols)
    return f"left(sha256(concat_ws(',', {net})), {n})"


@query(
    "blind_projection",
    f"""WITH {RULED_EXPERTS}, {quota_ctes(40, 5)} SELECT record_id, title, abstract, {fp_sql('record_id', 'title', 'abstract')} AS fingerprint FROM ruled JOIN drawn USING (record_id)""",
)
def blind_projection(t):
    """What labellers see of a drawn study batch: nothing of strata, labels or reasons."""
    from grantmill.plans.study import draw_batch

    ruled = ruled_documents(t, experts=True)
    labels = ruled.select("record_id", "label", "reason")
    census = documents(t).select("record_id", "title", "abstract", F.lit("f").alias("funder"), F.lit(2020).alias("year"), "amount_eur", F.lit("u").alias("url"), "source")
    experts = ruled.select("record_id", "expert_label", F.lit("r").alias("reason")).where("expert_label IS NOT NULL")
    return sampling.blind(draw_batch(labels, census, experts, 40, 5)).select("record_id", "title", "abstract", "fingerprint")


VERDICTS = f"""{JUDGMENTS}, {CUSTOMERS},
records AS (SELECT record_id, label, {half('record_id')} AS split, {fp_sql('record_id', 'title', 'label')} AS fingerprint FROM labelled),
verdicts AS (SELECT j.record_id, 'r' || labeller_id AS reviewer, CASE WHEN geroscience = 'yes' THEN 'agree' WHEN seq % 11 = 0 THEN 'unsure' ELSE 'disagree' END AS verdict,
  CASE WHEN seq % 3 = 0 THEN {sql_case('event_type', MARK_LABEL)} ELSE coalesce(l.label, 'care') END AS label,
  CASE WHEN seq % 13 = 0 THEN 'old' ELSE {fp_sql('l.record_id', 'title', 'l.label')} END AS record_fingerprint, 'note ' || seq AS note
  FROM judgments j LEFT JOIN labelled l USING (record_id) WHERE labeller_id % 2 = 0),
marked AS (SELECT v.*, NOT (r.record_id IS NOT NULL AND v.record_fingerprint IS NOT DISTINCT FROM r.fingerprint) AS stale FROM verdicts v LEFT JOIN records r USING (record_id)),
eff AS (SELECT * FROM marked WHERE NOT stale AND verdict IN ('agree', 'disagree') AND label IN ({sql_list(vocab.LABELS)})),
folded AS (SELECT record_id, min(label) AS lo, max(label) AS hi, arg_min(note, reviewer) AS note FROM eff GROUP BY 1),
judges AS (SELECT record_id, count(*) FILTER (geroscience = 'no') > 0 AS failed, count(*) FILTER (geroscience = 'yes') > 0 AS rel, bool_or(seq % 17 = 0) AS old FROM judgments WHERE labeller_id % 2 = 1 GROUP BY 1)"""


def verdict_rows(log, records):
    """Review verdicts from the judgments of labellers with an even number."""
    j = log.filter("labeller_id % 2 = 0").join(records.select("record_id", F.col("label").alias("rl"), "fingerprint"), "record_id", "left")
    return j.select(
        "record_id", F.concat(F.lit("r"), F.col("labeller_id")).alias("reviewer"),
        F.when(F.col("geroscience") == "yes", "agree").when(F.col("seq") % 11 == 0, "unsure").otherwise("disagree").alias("verdict"),
        F.when(F.col("seq") % 3 == 0, case(F.col("event_type"), MARK_LABEL)).otherwise(F.coalesce("rl", F.lit("care"))).alias("label"),
        F.when(F.col("seq") % 13 == 0, "old").otherwise(F.col("fingerprint")).alias("record_fingerprint"),
        F.concat(F.lit("note "), F.col("seq")).alias("note"), "labelled_at", "seq",
    )


def gate_tables(t: Tables):
    """Records, marked verdicts and judge marks built from customers and events."""
    rec = labelled_customers(t)
    fp = hashing.fingerprint(F.col("record_id"), F.col("title"), F.col("label"))
    records = rec.select("record_id", "label", hashing.split_half(F.col("record_id"), SEED).alias("split"), fp.alias("fingerprint"))
    latest = judgments(t)
    verdicts = verdict_rows(latest, records)
    marks = latest.filter("labeller_id % 2 = 1").groupBy("record_id").agg(
        F.max(F.coalesce(F.col("geroscience") == "no", F.lit(False))).alias("failed"),
        F.max(F.coalesce(F.col("geroscience") == "yes", F.lit(False))).alias("rel"), F.max(F.col("seq") % 17 == 0).alias("old"),
    )
    verdict = lambda c: F.struct(F.when(c, "pass").otherwise("fail").alias("verdict"))
    judges = F.create_map(
        F.lit("relevance"), verdict(F.col("rel")), F.lit("category"), verdict(~F.col("failed")), F.lit("evidence"), verdict(F.lit(True))
    )
    marks = marks.select("record_id", judges.alias("judges"), F.col("old").alias("stale"))
    return records, gate.mark_stale(verdicts, records), marks


@query("stale_attestations", f"WITH {VERDICTS} SELECT record_id, reviewer, stale FROM marked")
def stale_attestations(t):
    return gate_tables(t)[1].select("record_id", "reviewer", "stale")


@query("judge_flags", f"WITH {VERDICTS} SELECT record_id, j.record_id IS NULL OR old OR failed OR NOT rel AS flagged FROM records LEFT JOIN judges j USING (record_id)")
def judge_flags(t):
    records, _, marks = gate_tables(t)
    j = records.join(marks, "record_id", "left")
    return j.select("record_id", gate.judge_flagged(F.col("judges"), F.col("stale")).alias("flagged"))


@query(
    "review_order",
    f"""WITH {VERDICTS}, f AS (SELECT record_id, j.record_id IS NULL OR old OR failed OR NOT rel AS flagged FROM records LEFT JOIN judges j USING (record_id))
    SELECT record_id, flagged, row_number() OVER (ORDER BY NOT flagged, record_id) AS position FROM f""",
)
def review_order(t):
    records, _, marks = gate_tables(t)
    j = records.join(marks, "record_id", "left")
    flagged = j.select("record_id", gate.judge_flagged(F.col("judges"), F.col("stale")).alias("flagged"))
    return ranking.review_order(flagged, "flagged", "record_id")


def wilson_sql(k: str, n: str):
    z = 1.96
    c, d = f"({k} / {n} + {z * z} / (2 * {n}))", f"(1 + {z * z} / {n})"
    half_w = f"({z} * sqrt(({k} / {n}) * (1 - {k} / {n}) / {n} + {z * z} / (4 * {n} * {n})) / {d})"
    return f"CASE WHEN {n} > 0 THEN round(greatest(0, {c} / {d} - {half_w}), 4) END", f"CASE WHEN {n} > 0 THEN round(least(1, {c} / {d} + {half_w}), 4) END"


LOW_CI, HIGH_CI = wilson_sql("CAST(agreed AS DOUBLE)", "CAST(consensus_reviewed AS DOUBLE)")


GATE_SUMMARY = f"""s AS (SELECT r.*, f.record_id IS NOT NULL AS reviewed, coalesce(lo <> hi, false) AS conflict, CASE WHEN lo = hi THEN lo END AS cons,
      (j.record_id IS NULL OR old OR failed OR NOT rel) AS jf FROM records r LEFT JOIN folded f USING (record_id) LEFT JOIN judges j USING (record_id)),
    g AS (SELECT CASE WHEN grouping(split) = 1 THEN 'all' ELSE split END AS split, count(*) AS total, count(*) FILTER (reviewed) AS reviewed, count(*) FILTER (conflict) AS conflicts,
      count(cons) AS consensus_reviewed, count(*) FILTER (cons = label) AS agreed, count(*) FILTER (cons IS NOT NULL AND label = 'ambiguous') AS ambiguous_reviewed,
      count(*) FILTER (cons = label AND label = 'ambiguous') AS ambiguous_confirmed, count(*) FILTER (jf) AS judge_flagged FROM s GROUP BY GROUPING SETS ((split), ()))
    SELECT *, round(agreed / nullif(consensus_reviewed, 0), 4) AS agreement, {LOW_CI} AS ci_low, {HIGH_CI} AS ci_high, 0.85::DOUBLE AS target FROM g"""


@query("gate_summary_wilson", f"WITH {VERDICTS}, {GATE_SUMMARY}")
def gate_summary_wilson(t):
    records, verdicts, marks = gate_tables(t)
    return gate.summarise(records, verdicts, marks)


@query(
    "gate_conflicts",
    f"""WITH {VERDICTS} SELECT r.record_id, split, r.label, string_agg(reviewer || '=' || e.label, ',' ORDER BY reviewer) AS verdicts
    FROM records r JOIN eff e ON e.record_id = r.record_id GROUP BY ALL HAVING min(e.label) <> max(e.label)""",
)
def gate_conflicts(t):
    records, verdicts, _ = gate_tables(t)
    told = F.transform("verdicts", lambda v: F.concat(v["reviewer"], F.lit("="), v["verdict_label"]))
    return gate.conflict_list(records, verdicts).withColumn("verdicts", F.array_join(told, ","))


@query("live_gate", " UNION ALL ".join(
    f"SELECT {k}::BIGINT AS batch, x.* FROM (WITH {until(k, VERDICTS)}, {GATE_SUMMARY.replace('LEFT JOIN judges j USING (record_id)', 'LEFT JOIN (SELECT * FROM judges WHERE false) j USING (record_id)')}) x"
    for k in range(SLICES)))
def live_gate(t):
    """After each micro-batch of verdicts the gate summary kept by deltas equals that of the whole log so far."""
    from grantmill.session import scratch_dir
    from grantmill.streaming.judgments import gate_state, run_events

    records, _, _ = gate_tables(t)
    base, add = sliced(t, "gate-state")
    out, state = scratch_dir(t.spark, "live-gate"), None

    def note(held, k):
        gate.gate_summary(held.summary(t.spark)).withColumn("batch", F.lit(k).cast("bigint")).write.mode("overwrite").parquet(f"{out}/version={k}")

    for k in range(SLICES):
        add(k)
        shown = Tables(t.spark, t.sf_dir)
        shown.__dict__["events"] = t.spark.readStream.schema(t.events.schema).parquet(f"{base}/in")
        verdicts = verdict_rows(judgment_log(shown), records)
        if state is None:
            state = gate_state(f"{base}/state", ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in verdicts.schema.fields), records, buckets=16)
        run_events(verdicts, state, f"{base}/checkpoint", note).awaitTermination()
        if k == 1:
            state.compact(t.spark)
    return t.spark.read.parquet(*[f"{out}/version={k}" for k in range(SLICES)])


@query(
    "consensus_export",
    f"""WITH {VERDICTS} SELECT item_id AS input_id, coalesce(lo, '') AS human_category, CASE WHEN lo IS NOT NULL THEN '1.0' ELSE '' END AS human_confidence,
      CASE WHEN lo IS NOT NULL THEN concat_ws('; ', 'review gate', CASE WHEN lo NOT IN ({sql_list(vocab.GUIDE_LABELS)}) THEN 'legacy_equiv=ambiguous' END, note) ELSE '' END AS human_notes
    FROM benchmark LEFT JOIN (SELECT * FROM folded WHERE lo = hi) f ON f.record_id = item_id * 2""",
)
def consensus_export(t):
    _, verdicts, _ = gate_tables(t)
    items = t.benchmark.select(F.col("item_id").alias("input_id"))
    keys = items.select("input_id", (F.col("input_id") * 2).alias("record_id"))
    return gate.consensus_export(items, keys, verdicts)


@query(
    "cell_guard",
    r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents)
    SELECT doc_id, i, CASE WHEN regexp_matches(c, '^[=+\-@]') THEN '''' || c ELSE c END AS cell
    FROM (SELECT doc_id, i::INTEGER AS i, CASE i % 5 WHEN 0 THEN '=' WHEN 1 THEN '-' WHEN 2 THEN '@' WHEN 3 THEN '+' ELSE '' END || line AS c FROM l)""",
)
def cell_guard(t):
    # every line of every text
    m = F.col("i") % 5
    lead = F.when(m == 0, "=").when(m == 1, "-").when(m == 2, "@").when(m == 3, "+").otherwise("")
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    return lines.select("doc_id", "i", csv_cell_guard(F.concat(lead, F.col("line"))).alias("cell"))


# ---- fingerprints and validation ------------------------------------------------
@query("fingerprints", f"SELECT doc_id, {fp_sql('doc_id', 'text', 'lang')} AS fingerprint FROM documents")
def fingerprints(t):
    return validation.with_fingerprint(t.documents, "doc_id", "text", "lang").select("doc_id", "fingerprint")


DIGEST = "SELECT count(*) AS n_rows, coalesce(sum(('0x' || {fp})::BIGINT), 0)::VARCHAR AS digest FROM {table}"


@query("population_digest", DIGEST.format(fp=fp_sql("item_id", "text", n=12), table="benchmark"))
def population_digest(t):
    return validation.population_digest(t.benchmark, "item_id", "text")


@query("table_digest", DIGEST.format(fp=fp_sql("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", n=12), table="lineitem"))
def table_digest(t):
    return hashing.table_digest(t.lineitem, "l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")


@query(
    "referential_checks",
    f"""WITH {VERDICTS} SELECT CAST(record_id AS VARCHAR) AS id, CASE WHEN r.record_id IS NULL THEN 'unknown id' ELSE 'stale fingerprint' END AS violation
    FROM verdicts v LEFT JOIN records r USING (record_id) WHERE r.record_id IS NULL OR v.record_fingerprint IS DISTINCT FROM r.fingerprint""",
)
def referential_checks(t):
    records, verdicts, _ = gate_tables(t)
    return validation.referential_report(records, verdicts.drop("stale"))


@query("duplicate_ids", "SELECT text, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_ids(t):
    return validation.duplicate_ids(t.documents, "text")


FINDING = """json_object('id', CASE WHEN event_id % 10 = 0 THEN 'bad id' ELSE 'se-' || lpad(CAST(event_id % 1000 AS VARCHAR), 3, '0') END,
  'type', CASE WHEN event_id % 17 = 0 THEN 'rumour' WHEN event_type = 'error' THEN 'nothing_reliable_found' ELSE 'finding' END, 'country', CASE WHEN event_id % 23 = 0 THEN 'YY' ELSE 'SE' END,
  'classification', CASE event_type WHEN 'view' THEN 'policy' WHEN 'click' THEN 'funding' ELSE 'opinion' END, 'claim', repeat('claim ', CAST(event_id % 130 AS BIGINT)),
  'source_url', CASE WHEN user_id % 2 = 0 THEN 'https://example.org/' ELSE 'http://example.org/' END || user_id, 'source_date', CASE WHEN event_id % 7 = 0 THEN '2/2024' ELSE '2024-01' END,
  'confidence', 'high', 'retrieved_at', '2024-01-02T03:04:05Z')"""
NOTHING_KEYS = ["classification", "claim", "source_url", "source_date", "confidence"]


@query(
    "validation_report",
    f"""WITH f AS (SELECT event_id, CASE WHEN event_id % 17 = 0 THEN 'rumour' WHEN event_type = 'error' THEN 'nothing_reliable_found' ELSE 'finding' END AS kind, event_type, user_id FROM events),
    v AS (SELECT event_id, unnest(list_filter(list_concat([
      CASE WHEN kind = 'rumour' THEN 'bad type' END, CASE WHEN event_id % 10 = 0 THEN 'bad id' END,
      CASE WHEN event_id % 10 <> 0 AND event_id % 23 = 0 THEN 'id does not match country' END,
      CASE WHEN kind = 'finding' AND event_type NOT IN ('view', 'click') THEN 'bad classification' END,
      CASE WHEN kind = 'finding' AND NOT 6 * (event_id % 130) BETWEEN 20 AND 700 THEN 'claim length' END,
      CASE WHEN kind = 'finding' AND user_id % 2 = 1 THEN 'source_url must be https' END,
      CASE WHEN kind = 'finding' AND event_id % 7 = 0 THEN 'bad source_date' END],
      CASE WHEN kind <> 'finding' THEN ['missing field search_note', 'search_note too short', {', '.join(f"'unexpected field {k}'" for k in NOTHING_KEYS)}] ELSE []::VARCHAR[] END), lambda x: x IS NOT NULL)) AS violation FROM f)
    SELECT violation, count(*) AS n, sum(event_id)::BIGINT AS ids FROM v GROUP BY 1""",
)
def validation_report(t):
    e = F.col("event_id")
    s = lambda *c: F.concat(*[x if not isinstance(x, str) else F.lit(x) for x in c])
    kind = F.when(e % 17 == 0, "rumour").when(F.col("event_type") == "error", "nothing_reliable_found").otherwise("finding")
    raw = F.to_json(F.struct(
        F.when(e % 10 == 0, "bad id").otherwise(s("se-", F.lpad((e % 1000).cast("string"), 3, "0"))).alias("id"),
        kind.alias("type"), F.when(e % 23 == 0, "YY").otherwise("SE").alias("country"),
        F.when(F.col("event_type") == "view", "policy").when(F.col("event_type") == "click", "funding").otherwise("opinion").alias("classification"),
        F.repeat(F.lit("claim "), (e % 130).cast("int")).alias("claim"),
        s(F.when(F.col("user_id") % 2 == 0, "https://example.org/").otherwise("http://example.org/"), F.col("user_id").cast("string")).alias("source_url"),
        F.when(e % 7 == 0, "2/2024").otherwise("2024-01").alias("source_date"), F.lit("high").alias("confidence"),
        F.lit("2024-01-02T03:04:05Z").alias("retrieved_at"),
    ))
    v = validation.finding_violations(spread(t.events).select("event_id", raw.alias("raw")))
    return v.groupBy("violation").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


@query(
    "label_file_check",
    f"""WITH r AS (SELECT CAST(o_custkey AS VARCHAR) AS id, CASE WHEN o_orderpriority = '5-LOW' THEN 'unheard' WHEN o_orderpriority = '2-HIGH' THEN NULL ELSE 'care' END AS label FROM orders),
    v AS (SELECT id, unnest(list_filter([CASE WHEN label IS NULL THEN 'missing label' END, CASE WHEN label IS NULL THEN 'unknown label <null>' WHEN label = 'unheard' THEN 'unknown label unheard' END], lambda x: x IS NOT NULL)) AS violation FROM r
      UNION ALL SELECT id, 'duplicate id' FROM r GROUP BY id HAVING count(*) > 1)
    SELECT violation, count(*) AS n FROM v GROUP BY 1""",
)
def label_file_check(t):
    label = F.when(F.col("o_orderpriority") == "5-LOW", "unheard").when(F.col("o_orderpriority") == "2-HIGH", F.lit(None)).otherwise("care")
    rows = t.orders.select(F.col("o_custkey").alias("record_id"), label.alias("label"))
    v = validation.label_file_violations(rows, ["record_id", "label"])
    return v.groupBy("violation").agg(F.count(F.lit(1)).alias("n"))


# ---- country index -----------------------------------------------------------------
NOW = "TIMESTAMP '2024-06-01 00:00:00'"
FINDINGS = f"""findings AS (SELECT event_id, n_name AS country, CASE event_type WHEN 'error' THEN 'nothing_reliable_found' ELSE 'finding' END AS type,
  CASE user_id % 6 WHEN 0 THEN 'legislation' WHEN 1 THEN 'funding' WHEN 2 THEN 'policy' WHEN 3 THEN 'strategy' WHEN 4 THEN 'political statement' ELSE 'other' END AS classification,
  CASE event_id % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' ELSE 'none' END AS confidence,
  CASE event_type WHEN 'view' THEN 'verified' WHEN 'click' THEN 'failed' ELSE 'pending' END AS state,
  CASE event_id % 5 WHEN 0 THEN DATE '2023-07-01' WHEN 1 THEN DATE '2021-03-01' WHEN 2 THEN DATE '2016-05-05' WHEN 3 THEN DATE '2001-07-01' END AS d
  FROM events JOIN nation ON n_nationkey = user_id % 25),
scored AS (SELECT *, CASE WHEN type = 'finding' THEN
  CASE classification WHEN 'legislation' THEN 1.0::DOUBLE WHEN 'funding' THEN 0.9 WHEN 'policy' THEN 0.8 WHEN 'strategy' THEN 0.7 ELSE 0.4 END
  * CASE confidence WHEN 'high' THEN 1.0::DOUBLE WHEN 'medium' THEN 0.7 ELSE 0.4 END
  * CASE state WHEN 'verified' THEN 1.0::DOUBLE WHEN 'pending' THEN 0.7 ELSE 0.0 END
  * CASE WHEN d IS NULL THEN 0.3::DOUBLE WHEN epoch({NOW} - d::TIMESTAMP) / 31557600.0 <= 2 THEN 1.0 WHEN epoch({NOW} - d::TIMESTAMP) / 31557600.0 <= 5 THEN 0.75 WHEN epoch({NOW} - d::TIMESTAMP) / 31557600.0 <= 10 THEN 0.5 ELSE 0.3 END END AS points FROM findings)"""


def scored_findings(t: Tables):
    e, u = F.col("event_id"), F.col("user_id")
    cls = F.when(u % 6 == 0, "legislation").when(u % 6 == 1, "funding").when(u % 6 == 2, "policy").when(u % 6 == 3, "strategy").when(u % 6 == 4, "political statement").otherwise("other")
    conf = F.when(e % 4 == 0, "high").when(e % 4 == 1, "medium").when(e % 4 == 2, "low").otherwise("none")
    date = F.when(e % 5 == 0, "2023").when(e % 5 == 1, "2021-03").when(e % 5 == 2, "2016-05-05").when(e % 5 == 3, "2001").otherwise("soon")
    j = t.events.join(t.nation, F.col("n_nationkey") == u % 25)
    findings = j.select(
        e.alias("id"), F.col("n_name").alias("country"), F.when(F.col("event_type") == "error", "nothing_reliable_found").otherwise("finding").alias("type"),
        cls.alias("classification"), conf.alias("confidence"), date.alias("source_date"),
    )
    verdicts = t.events.filter("event_type IN ('view', 'click', 'signup')").select(
        e.alias("finding_id"), (F.col("event_type") != "signup").alias("reviewed"), (F.col("event_type") == "view").alias("correct")
    )
    return index.score_findings(findings, verdicts, F.lit("2024-06-01 00:00:00").cast("timestamp"))


INDEX = f"""{FINDINGS}, c AS (SELECT country, count(*) FILTER (type = 'finding') AS findings, count(*) FILTER (type <> 'finding') AS nothing, round(coalesce(sum(points), 0), 6) AS total_points,
  count(*) FILTER (type = 'finding' AND state = 'verified') AS verified, count(*) FILTER (type = 'finding' AND state = 'failed') AS failed, count(*) FILTER (type = 'finding' AND state = 'pending') AS pending FROM scored GROUP BY 1),
idx AS (SELECT country, findings, total_points, CASE WHEN findings > 0 THEN CAST(floor(100 * total_points / (total_points + 4) + 0.5) AS BIGINT) END AS index,
  CASE WHEN findings > 0 THEN 'scored' WHEN nothing > 0 THEN 'nothing' ELSE 'empty' END AS status, verified, failed, pending FROM c)"""


@query("country_index", f"WITH {INDEX} SELECT * FROM idx")
def country_index(t):
    return index.country_index(scored_findings(t))


@query("country_rank", f"WITH {INDEX} SELECT country, index FROM idx ORDER BY index DESC NULLS LAST, country")
def country_rank(t):
    return index.rank_countries(index.country_index(scored_findings(t))).select("country", "index")


@query("finding_counters", f"WITH {INDEX} SELECT count(*) FILTER (status = 'scored') AS scored_countries, sum(findings)::BIGINT AS findings, sum(verified)::BIGINT AS verified FROM idx")
def finding_counters(t):
    return index.finding_counters(index.country_index(scored_findings(t)))


@query("points_by_class", f"WITH {FINDINGS} SELECT country, classification, round(sum(points), 6) AS points, count(*) AS findings FROM scored WHERE type = 'finding' GROUP BY 1, 2")
def points_by_class(t):
    return index.points_by_class(scored_findings(t))


ISO = {0: "SE", 1: "US", 2: "DE", 3: "FR", 4: "NO"}


@query("jurisdiction_lookup", f"SELECT c_custkey, CASE c_nationkey % 7 {' '.join(f'WHEN {k} THEN {chr(39)}{v if v in (chr(83) + chr(69), chr(85) + chr(83)) else chr(69) + chr(85)}{chr(39)}' for k, v in ISO.items() if v != 'NO')} END AS jurisdiction FROM customer")
def jurisdiction_lookup(t):
    iso = case(F.col("c_nationkey") % 7, ISO)
    return t.customer.select("c_custkey", index.jurisdiction(iso).alias("jurisdiction"))


@query(
    "accuracy_rollup",
    """WITH v AS (SELECT n_name AS country, event_type <> 'error' AS reviewed, event_type = 'view' AS correct FROM events JOIN nation ON n_nationkey = user_id % 25),
    g AS (SELECT CASE WHEN grouping(country) = 1 THEN 'all' ELSE country END AS country, count(*) FILTER (reviewed) AS reviewed, count(*) FILTER (reviewed AND correct) AS correct FROM v GROUP BY GROUPING SETS ((country), ()))
    SELECT *, CASE WHEN reviewed > 0 THEN round(correct / reviewed, 4) END AS accuracy FROM g""",
)
def accuracy_rollup(t):
    j = t.events.join(t.nation, F.col("n_nationkey") == F.col("user_id") % 25)
    ok = F.when(F.col("event_type") == "error", F.lit(None)).otherwise(F.col("event_type") == "view")
    checks = F.create_map(*[x for c in vocab.FINDING_CHECKS for x in (F.lit(c), ok)])
    v = j.select(F.col("n_name").alias("country"), index.checks_reviewed(checks).alias("reviewed"), index.checks_correct(checks).alias("correct"))
    return index.accuracy(v)


@query("wilson_by_label", f"""WITH g AS (SELECT o_orderpriority, count(*) AS consensus_reviewed, count(*) FILTER (o_orderstatus = 'F') AS agreed FROM orders GROUP BY 1) SELECT o_orderpriority, {LOW_CI} AS low, {HIGH_CI} AS high FROM g""")
def wilson_by_label(t):
    g = t.orders.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("k"))
    low, high = stats.wilson(F.col("k"), F.col("n"))
    return g.select("o_orderpriority", low.alias("low"), high.alias("high"))


__all__ = ["ARD", "CARE", "FA", "INT", "RULED", "adjudication"]
