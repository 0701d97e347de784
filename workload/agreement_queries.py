"""Judgments, agreement and classifier scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from grantmill import vocab
from grantmill.functions.hashing import fingerprint
from grantmill.operators import agreement, sampling, validation

from .base import (
    ANSWER, CUSTOMERS, JUDGMENTS, PRIORITY_LABEL, RULED_EXPERTS, Tables, case, judgment_log, judgments, labelled_customers,
    query, ruled_documents, sql_case, sql_list,
)

LABELS = sql_list(vocab.LABELS)


def batch(t: Tables):
    """Every customer is a batch record; only some carry judgments."""
    return labelled_customers(t)


@query("latest_judgments", f"WITH {JUDGMENTS} SELECT record_id, labeller_id, geroscience, seq FROM judgments")
def latest_judgments(t):
    return judgments(t).select("record_id", "labeller_id", "geroscience", "seq")


@query("judgment_pairs", f"""WITH {JUDGMENTS} SELECT record_id, CAST((n_yes + n_no + n_borderline) * (n_yes + n_no + n_borderline - 1) / 2 AS BIGINT) AS pairs,
  CAST(n_yes * (n_yes - 1) / 2 + n_no * (n_no - 1) / 2 + n_borderline * (n_borderline - 1) / 2 AS BIGINT) AS agreeing FROM counts""")
def judgment_pairs(t):
    from grantmill.functions.stats import pairs

    c = agreement.answer_counts(judgments(t))
    n = F.col("n_yes") + F.col("n_no") + F.col("n_borderline")
    same = pairs(F.col("n_yes")) + pairs(F.col("n_no")) + pairs(F.col("n_borderline"))
    return c.select("record_id", pairs(n).cast("bigint").alias("pairs"), same.cast("bigint").alias("agreeing"))


@query(
    "observed_agreement",
    f"""WITH {JUDGMENTS}, p AS (SELECT a.record_id, a.geroscience = b.geroscience AS same FROM judgments a JOIN judgments b
      ON a.record_id = b.record_id AND a.labeller_id < b.labeller_id WHERE a.geroscience IS NOT NULL AND b.geroscience IS NOT NULL)
    SELECT CAST(count(*) FILTER (same) AS DOUBLE) AS agreeing_pairs, CAST(count(*) AS DOUBLE) AS pairs, round(count(*) FILTER (same) / count(*), 6) AS observed_agreement FROM p""",
)
def observed_agreement(t):
    return agreement.observed_agreement(judgments(t))


FLEISS = """n AS (SELECT *, n_yes + n_no + n_borderline AS n FROM counts WHERE n_yes + n_no + n_borderline >= 2),
  k AS (SELECT count(*) AS records, avg((n_yes * (n_yes - 1) + n_no * (n_no - 1) + n_borderline * (n_borderline - 1)) / (n * (n - 1))) AS p,
    pow(sum(n_yes) / sum(n), 2) + pow(sum(n_no) / sum(n), 2) + pow(sum(n_borderline) / sum(n), 2) AS e FROM n)"""


@query("fleiss_kappa", f"WITH {JUDGMENTS}, {FLEISS} SELECT records, round(p, 6) AS p_bar, round(e, 6) AS p_e, CASE WHEN records >= 10 AND e < 1 THEN round((p - e) / (1 - e), 6) END AS kappa FROM k")
def fleiss_kappa(t):
    return agreement.fleiss_kappa(judgments(t))


CONS = """CASE WHEN greatest(n_yes, n_no, n_borderline) = 0 THEN NULL
    WHEN (n_yes = greatest(n_yes, n_no, n_borderline))::INT + (n_no = greatest(n_yes, n_no, n_borderline))::INT + (n_borderline = greatest(n_yes, n_no, n_borderline))::INT > 1 THEN NULL
    WHEN n_yes = greatest(n_yes, n_no, n_borderline) THEN 'yes' WHEN n_no = greatest(n_yes, n_no, n_borderline) THEN 'no' ELSE 'borderline' END"""
CONTENTION = """CASE WHEN n_yes + n_no + n_borderline >= 2 THEN (2 * n_yes * n_no + n_borderline * (n_yes + n_no)) / ((n_yes + n_no + n_borderline) * (n_yes + n_no + n_borderline - 1) / 2) ELSE 0 END"""
STUDY = f"""{JUDGMENTS}, {CUSTOMERS}, study AS (
  SELECT l.record_id, amount_eur, {', '.join(f'coalesce({c}, 0) AS {c}' for c in ('n_judgments', 'n_yes', 'n_no', 'n_borderline', 'cancer_ticks', 'flags'))},
    round(coalesce({CONTENTION}, 0), 3) AS contention, {CONS} AS consensus0, coalesce(n_judgments, 0) < 2 AS thin,
    {sql_case('label', vocab.LABEL_TO_ANSWER, "''")} AS classifier_answer FROM labelled l LEFT JOIN counts USING (record_id)),
  per_record AS (SELECT *, CASE WHEN n_judgments > 0 THEN consensus0 END AS consensus FROM study)"""


def study_rows(t):
    return agreement.per_record(batch(t), judgments(t))


STUDY_COLS = "record_id, n_judgments, n_yes, n_no, n_borderline, cancer_ticks, flags, contention, consensus, thin, classifier_answer, classifier_agrees"


@query("contention_consensus", f"WITH {STUDY} SELECT record_id, n_judgments, n_yes, n_no, n_borderline, cancer_ticks, flags, contention, consensus, thin, classifier_answer, CASE WHEN consensus IS NOT NULL AND classifier_answer <> '' THEN consensus = classifier_answer END AS classifier_agrees FROM per_record")
def contention_consensus(t):
    return study_rows(t).select(*STUDY_COLS.split(", "))


@query("contested_ranking", f"WITH {STUDY} SELECT record_id, contention, CAST(coalesce(amount_eur, 0) AS DOUBLE) AS amount_eur, row_number() OVER (ORDER BY contention DESC, coalesce(amount_eur, 0) DESC, record_id) AS rank FROM per_record")
def contested_ranking(t):
    rows = study_rows(t).select("record_id", "contention", F.coalesce(F.col("amount_eur"), F.lit(0)).cast("double").alias("amount_eur"))
    return agreement.contested_ranking(rows)


@query(
    "classifier_vs_consensus",
    f"""WITH {STUDY}, s AS (SELECT * FROM per_record WHERE consensus IS NOT NULL AND classifier_answer <> ''), a(class) AS (VALUES ('yes'), ('no'), ('borderline')),
    c AS (SELECT class, count(*) FILTER (consensus = class) AS n_human, count(*) FILTER (classifier_answer = class) AS n_pred,
      count(*) FILTER (consensus = class AND classifier_answer = class) AS tp FROM a LEFT JOIN s ON true GROUP BY 1)
    SELECT class, n_human, round(tp / nullif(n_pred, 0), 6) AS precision, round(tp / nullif(n_human, 0), 6) AS recall, n_human < 10 AS thin,
      (SELECT round(count(*) FILTER (consensus = classifier_answer) / count(*), 6) FROM s) AS agreement,
      (SELECT count(*) FROM per_record WHERE n_judgments > 0 AND consensus IS NULL) AS n_no_consensus FROM c""",
)
def classifier_vs_consensus(t):
    return agreement.classifier_comparison(study_rows(t))


@query(
    "study_coverage",
    f"""WITH {STUDY} SELECT count(*) AS records, count(*) FILTER (n_judgments > 0) AS records_with_any, count(*) FILTER (n_judgments >= 2) AS records_with_two_or_more,
      sum(n_judgments)::BIGINT AS total_judgments, (SELECT count(DISTINCT labeller_id) FROM judgments) AS n_labellers FROM per_record""",
)
def study_coverage(t):
    return agreement.study_coverage(batch(t), judgments(t))


@query(
    "batch_left_join",
    f"""WITH {JUDGMENTS}, {CUSTOMERS} SELECT l.record_id, title, labeller_id, geroscience FROM labelled l LEFT JOIN judgments USING (record_id)""",
)
def batch_left_join(t):
    return batch(t).select("record_id", "title").join(judgments(t), "record_id", "left").select("record_id", "title", "labeller_id", "geroscience")


@query(
    "cohen_kappa_pairs",
    f"""WITH {JUDGMENTS}, p AS (SELECT x.labeller_id AS a, y.labeller_id AS b, x.geroscience AS la, y.geroscience AS lb FROM judgments x JOIN judgments y
      ON x.record_id = y.record_id AND x.labeller_id < y.labeller_id WHERE x.geroscience IS NOT NULL AND y.geroscience IS NOT NULL),
    m AS (SELECT a, b, count(*) AS shared, count(*) FILTER (la = lb) / count(*) AS o,
      {' + '.join(f"(count(*) FILTER (la = '{v}') / count(*)) * (count(*) FILTER (lb = '{v}') / count(*))" for v in vocab.ANSWERS)} AS e FROM p GROUP BY 1, 2)
    SELECT a, b, shared, CASE WHEN e < 1 THEN round((o - e) / (1 - e), 6) END AS kappa FROM m""",
)
def cohen_kappa_pairs(t):
    return agreement.cohen_kappa(judgments(t))


ITEM_PAIRS = "expert_label IS NOT NULL"


@query(
    "multiclass_prf",
    f"""WITH {RULED_EXPERTS}, x AS (SELECT * FROM ruled WHERE {ITEM_PAIRS}), v(class) AS (VALUES {', '.join(f"('{c}')" for c in vocab.LABELS)}),
    c AS (SELECT class, count(*) FILTER (expert_label = class) AS n_truth, count(*) FILTER (label = class) AS n_pred, count(*) FILTER (label = class AND expert_label = class) AS tp FROM v LEFT JOIN x ON true GROUP BY 1),
    p AS (SELECT *, tp / nullif(n_pred, 0) AS p, tp / nullif(n_truth, 0) AS r FROM c)
    SELECT class, n_truth, n_pred, round(p, 6) AS precision, round(r, 6) AS recall, CASE WHEN p > 0 AND r > 0 THEN round(2 * p * r / (p + r), 6) END AS f1,
      (SELECT round(count(*) FILTER (label = expert_label) / count(*), 6) FROM x) AS agreement FROM p""",
)
def multiclass_prf(t):
    rows = ruled_documents(t, experts=True).filter("expert_label IS NOT NULL")
    return agreement.multiclass(rows, "expert_label", "label", vocab.LABELS)


@query(
    "confusion_matrix",
    f"""WITH {RULED_EXPERTS}, x AS (SELECT * FROM ruled WHERE {ITEM_PAIRS}), v(truth) AS (VALUES {', '.join(f"('{c}')" for c in vocab.LABELS)})
    SELECT truth, {', '.join(f"count(*) FILTER (label = '{c}') AS {c}" for c in vocab.LABELS)} FROM v LEFT JOIN x ON expert_label = truth GROUP BY 1""",
)
def confusion_matrix(t):
    rows = ruled_documents(t, experts=True).filter("expert_label IS NOT NULL")
    return agreement.confusion(rows, "expert_label", "label", vocab.LABELS)


@query("answer_projection", f"SELECT o_orderpriority, {sql_case('o_orderpriority', {k: vocab.LABEL_TO_ANSWER[v] for k, v in PRIORITY_LABEL.items() if k != '5-LOW'}, chr(39) * 2)} AS answer, count(*) AS n FROM orders GROUP BY 1, 2")
def answer_projection(t):
    known = {k: v for k, v in PRIORITY_LABEL.items() if k != "5-LOW"}
    label = F.coalesce(case(F.col("o_orderpriority"), known), F.lit("new label"))
    return t.orders.groupBy("o_orderpriority", agreement.answer_of(label).alias("answer")).agg(F.count(F.lit(1)).alias("n"))


@query("own_judgments", f"WITH {JUDGMENTS} SELECT record_id, geroscience FROM judgments WHERE labeller_id = 7")
def own_judgments(t):
    return sampling.own_judgments(judgments(t), 7).select("record_id", "geroscience")


@query(
    "slug_guard",
    r"""WITH j AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN lower(c_mktsegment) WHEN 1 THEN c_name WHEN 2 THEN 'user-' || c_custkey ELSE '-x' END AS who,
      CASE c_custkey % 3 WHEN 0 THEN 'yes' WHEN 1 THEN NULL ELSE 'perhaps' END AS answer FROM customer)
    SELECT c_custkey AS record_id, CASE WHEN NOT regexp_full_match(who, '[a-z0-9][a-z0-9_-]{0,63}') THEN 'labeller_id must be a slug'
      WHEN answer = 'perhaps' THEN 'unknown answer' WHEN c_custkey % 7 = 0 THEN 'unknown record' END AS rejected FROM j""",
)
def slug_guard(t):
    k = F.col("c_custkey")
    who = F.when(k % 4 == 0, F.lower("c_mktsegment")).when(k % 4 == 1, F.col("c_name")).when(k % 4 == 2, F.concat(F.lit("user-"), k)).otherwise("-x")
    answer = F.when(k % 3 == 0, "yes").when(k % 3 == 1, F.lit(None)).otherwise("perhaps")
    incoming = t.customer.select(k.alias("record_id"), who.alias("labeller_id"), answer.alias("geroscience"))
    known = t.customer.filter("c_custkey % 7 <> 0").select(F.col("c_custkey").alias("record_id"))
    return validation.split_judgments(incoming, known).select("record_id", "rejected")


SLICES = 3


def sliced(t, name):
    """``(folder, add)``: ``add(k)`` writes the k-th third of the events there; thirds overlap in time, so late events occur."""
    from grantmill.session import scratch_dir

    base = scratch_dir(t.spark, name)
    return base, lambda k: t.events.where(F.pmod("event_id", F.lit(SLICES)) == k).write.mode("append").parquet(f"{base}/in")


def until(k: int, sql: str) -> str:
    """``sql`` over the events of the first k + 1 thirds."""
    return sql.replace("FROM events)", f"FROM events WHERE event_id % {SLICES} <= {k})")


def streamed_log(t, base):
    shown = Tables(t.spark, t.sf_dir)
    shown.__dict__["events"] = t.spark.readStream.schema(t.events.schema).parquet(f"{base}/in")
    log = judgment_log(shown).withColumn("labeller_id", F.concat(F.lit("u"), F.col("labeller_id").cast("string")))
    return log.select("record_id", "labeller_id", "geroscience", "labelled_at", "seq")


def _stream(t, on_batch=None, compact_after=0):
    """Drive the events, a third a micro-batch, through the state job; fold its versions in between."""
    from grantmill.streaming.judgments import run_state, study_state

    base, add = sliced(t, "judgment-state")
    state = None
    for k in range(SLICES):
        add(k)
        log = streamed_log(t, base)
        state = state or study_state(f"{base}/state", ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in log.schema.fields), buckets=16)
        run_state(log, state, f"{base}/checkpoint", on_batch=on_batch).awaitTermination()
        if k == compact_after:
            state.compact(t.spark)
    return base, state


@query("judgment_stream", f"WITH {JUDGMENTS} SELECT record_id, 'u' || labeller_id AS labeller_id, geroscience, seq FROM judgments")
def judgment_stream(t):
    _, state = _stream(t, compact_after=1)
    return state.current(t.spark).select("record_id", "labeller_id", "geroscience", "seq")


LIVE = """SELECT {k}::BIGINT AS batch, records, round(p, 6) AS p_bar, round(e, 6) AS p_e, CASE WHEN records >= 10 AND e < 1 THEN round((p - e) / (1 - e), 6) END AS kappa,
    (SELECT count(*) FILTER (n_yes + n_no + n_borderline > 0) FROM counts) AS records_with_any, (SELECT count(*) FILTER (n_yes + n_no + n_borderline >= 2) FROM counts) AS records_with_two_or_more,
    (SELECT CAST(sum(n_yes + n_no + n_borderline) AS BIGINT) FROM counts) AS total_judgments, (SELECT count(DISTINCT labeller_id) FROM judgments WHERE geroscience IS NOT NULL) AS n_labellers FROM k"""


@query("live_summary", " UNION ALL ".join(f"SELECT * FROM (WITH {until(k, JUDGMENTS)}, {FLEISS} {LIVE.format(k=k)})" for k in range(SLICES)))
def live_summary(t):
    """After each micro-batch the summary kept by deltas equals that of the whole log so far."""
    from grantmill.session import scratch_dir
    from grantmill.streaming.judgments import study_summary

    out = scratch_dir(t.spark, "live-summary")

    def note(state, k):
        study_summary(state.summary(t.spark)).withColumn("batch", F.lit(k).cast("bigint")).write.mode("overwrite").parquet(f"{out}/version={k}")

    _stream(t, note, compact_after=1)
    return t.spark.read.parquet(*[f"{out}/version={k}" for k in range(SLICES)])


__all__ = ["ANSWER", "fingerprint", "STUDY", "sliced", "streamed_log", "until", "SLICES"]
