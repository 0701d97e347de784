import json
import tempfile

import pytest
from pyspark.sql import functions as F

from grantmill import schemas
from grantmill.operators import lexicon_stats, mining
from grantmill.operators.lexicon import Lexicon
from grantmill.operators.ratio import ratio_rollup
from grantmill.plans import lexicon_loop
from grantmill.operators.rules import RuleSet
from grantmill.sources import readers, writers
from grantmill.operators.agreement import fleiss_kappa
from grantmill.streaming.judgments import batch_state, gate_state, run_rejected, run_state, study_state, study_summary, without_undone
from lexicons import small_lexicon


@pytest.fixture()
def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def put(path, text):
    with open(path, "w", encoding="utf-8") as fh:
        fh.write(text)
    return path


def test_csv_header_and_rows(spark, folder):
    p = put(f"{folder}/a.csv", '﻿record_id,title\n1,"two\nlines, ""quoted"""\n2,ok\n')
    df = readers.read_csv(spark, p, ["record_id", "title"], expected=2)
    assert df.orderBy("record_id").first().title == 'two\nlines, "quoted"'
    with pytest.raises(ValueError, match="missing"):
        readers.read_csv(spark, p, ["funder"])
    with pytest.raises(ValueError, match="expected 5"):
        readers.read_csv(spark, p, ["title"], expected=5)
    s = put(f"{folder}/b.csv", "﻿id;objective\n1;a\u0000b, c\n")
    assert readers.read_semicolon_csv(spark, s, ["id"]).first().objective == "ab, c"


def test_json_sources(spark, folder):
    put(f"{folder}/ann.verdicts.json", json.dumps({"r1": {"verdict": "agree", "label": "care"}, "r2": {"verdict": "disagree", "label": "care"}}))
    put(f"{folder}/Bad Name.verdicts.json", json.dumps({"r1": {"verdict": "agree", "label": "care"}}))
    rows = readers.read_keyed_json(spark, f"{folder}/*.json", schemas.VERDICT, ".verdicts")
    good, rejected = readers.split_slugs(rows)
    assert {(r.slug, r.key, r.value.verdict) for r in good.collect()} == {("ann", "r1", "agree"), ("ann", "r2", "disagree")}
    assert [r.slug for r in rejected.collect()] == ["Bad%20Name"]
    put(f"{folder}/x.txt", "not json")
    with pytest.raises(Exception, match="unreadable"):
        readers.read_keyed_json(spark, f"{folder}/x.txt", schemas.VERDICT).collect()
    put(f"{folder}/se.json", json.dumps([{"id": "se-001", "type": "finding"}]))
    assert readers.read_json_array(spark, f"{folder}/se.json", schemas.FINDING).first().slug == "se"


def test_lexicon_document(spark, folder):
    cats = {c: {"en": [{"term": f"{c} term", "precision": 0.7}]} for c in ("fundamental_aging", "intervention", "age_related_disease", "care")}
    cats["social_population_aging"] = {
        "requires_ageing_anchor": True, "en": [{"term": "retirement", "precision": 0.6}], "sv": [{"term": "pension", "precision": 0.5, "variant_of": "x"}],
        "trap_terms": [{"term": "trap"}], "conditional_voters": [{"term": "lonely", "weight": 0.3, "requires": "anchor"}],
    }
    cats["care"]["en"].append({"term": "a*b", "precision": 0.1})
    doc = {"categories": cats, "meta": {"broad_net": {"en": [{"term": "ageing"}], "sv": [{"term": "äldre"}]}, "exclusion_markers": [{"term": "battery"}]}}
    p = put(f"{folder}/lex.json", json.dumps(doc))
    lex = Lexicon.from_table(readers.read_lexicon(spark, p))
    by = {t.term: t for t in lex.terms}
    assert by["retirement"].requires == "anchor" and by["care term"].requires is None and by["lonely"].weight == 0.3
    assert by["äldre"].role == "anchor" and by["battery"].role == "exclusion" and by["pension"].variant_of == "x" and len(lex) == 12
    stats, coverage, bad = lexicon_loop.audit(
        spark.createDataFrame([("care term here", "", "care"), ("retirement", "", "ambiguous")], "title string, llm_quote string, llm_category string"),
        readers.read_lexicon(spark, p), {"en": (1, 0.5), "sv": (1, 0.5)},
    )
    assert ("a*b", "malformed: misplaced wildcard") in {(r.term, r.violation) for r in bad.collect()}
    assert {r.category: r.coverage for r in coverage.collect()} == {"care": 1.0, "social_population_aging": 1.0}
    del cats["care"]
    put(f"{folder}/lex2.json", json.dumps(doc))
    with pytest.raises(Exception, match="category drift"):
        readers.read_lexicon(spark, f"{folder}/lex2.json").collect()
    assert lexicon_stats.proxy_of(F.lit("care")) is not None


def test_writers(spark, folder):
    census = spark.createDataFrame([("b", "swecris"), ("a", "cordis")], "record_id string, source string")
    writers.write_census(census, f"{folder}/census")
    back = readers.read_census(spark, f"{folder}/census", partitions=2)
    assert sorted(r.record_id for r in back.collect()) == ["a", "b"]
    nested = spark.createDataFrame([("a", ["x", "y"])], "id string, l array<string>")
    writers.write_csv(nested, f"{folder}/csv")
    assert spark.read.option("header", True).option("escape", '"').csv(f"{folder}/csv").first().l == '["x","y"]'
    labels = spark.createDataFrame([("SE", "VR", "care", 5.0), ("SE", "FORTE", "intervention", 9.0)], "region string, funder string, label string, amount_eur double")
    rollup = ratio_rollup(labels)
    doc = json.loads(writers.report_document(rollup, {"unit": "EUR"}).first().document)
    assert doc["total"]["records"] == 2 and doc["regions"]["SE"]["ratio"] == 0.6429 and doc["method"]["unit"] == "EUR"
    assert json.loads(writers.funder_lines(rollup).first().line)["funder"] == "FORTE"
    writers.write_labels(labels, f"{folder}/labels", "parquet", by="region")
    assert spark.read.parquet(f"{folder}/labels").count() == 2


EVENT = "record_id string, labeller_id string, geroscience string, labelled_at timestamp, seq bigint"


def state_rows(state, spark, before=2**31 - 1):
    return {tuple(r) for r in state.current(spark, before).select("record_id", "labeller_id", "geroscience", "seq").collect()}


def test_stream_equals_batch(spark, folder):
    files = [
        [("r1", "ann", "yes", "2024-01-01 10:00:00", 1), ("r1", "bob", "no", "2024-01-01 10:00:00", 2), ("r2", "Ann!", "no", "2024-01-01 10:00:00", 3)],
        [("r1", "ann", "no", "2024-01-02 10:00:00", 4), ("r3", "ann", "maybe", "2024-01-02 10:00:00", 5), ("r1", "bob", None, "2024-01-02 11:00:00", 6)],
        [("r1", "ann", "yes", "2023-12-31 10:00:00", 7), ("r9", "ann", "yes", "2024-01-03 10:00:00", 8), ("r2", "ann", "yes", "2024-01-03 10:00:00", 9)],
        [("r2", "bob", "no", "2024-01-04 10:00:00", 10), ("r2", "ann", "yes", "2024-01-03 10:00:00", 9)],
    ]
    schema = "record_id string, labeller_id string, geroscience string, labelled_at string, seq bigint"
    known = spark.createDataFrame([("r1",), ("r2",), ("r3",)], "record_id string")
    seen, state = [], study_state(f"{folder}/state", EVENT, buckets=4)

    def note(s, batch):
        seen.append((batch, {(r["kind"], r["who"], r["n_yes"], r["n_no"], r["n"]) for r in s.summary(spark).collect()}))

    for i, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(f"{folder}/in")
        stream = spark.readStream.schema(EVENT).json(f"{folder}/in")
        run_state(stream, state, f"{folder}/cp", known=known, on_batch=note).awaitTermination()
        log = spark.read.schema(EVENT).json(f"{folder}/in").join(known, "record_id", "left_semi")
        want = batch_state(log)
        assert state_rows(state, spark) == {tuple(r) for r in want.select("record_id", "labeller_id", "geroscience", "seq").collect()}
        live = study_summary(state.summary(spark)).first()
        assert (live.total_judgments, live.n_labellers) == want.where("geroscience IS NOT NULL").selectExpr("count(*)", "count(DISTINCT labeller_id)").first()
        assert live.kappa == fleiss_kappa(want).first().kappa
        if i == 2:
            assert state.compact(spark) == 1
    run_rejected(spark.readStream.schema(EVENT).json(f"{folder}/in"), f"{folder}/bad", f"{folder}/cp-bad", known).awaitTermination()
    bad = {(r.seq, r.rejected) for r in spark.read.parquet(f"{folder}/bad").collect()}
    assert bad == {(3, "labeller_id must be a slug"), (5, "unknown answer"), (8, "unknown record")}
    assert state_rows(state, spark) == {("r1", "ann", "no", 4), ("r1", "bob", None, 6), ("r2", "ann", "yes", 9), ("r2", "bob", "no", 10)}
    assert without_undone(state.current(spark)).count() == 3 and [b for b, _ in seen] == [0, 1, 2, 3]
    # an undo takes its contribution away, a late older event changes nothing
    assert seen[0][1] == {("record", None, 1, 1, 1), ("labeller", "ann", None, None, 1), ("labeller", "bob", None, None, 1)}
    assert seen[1][1] == {("record", None, 0, 1, 1), ("labeller", "ann", None, None, 1)}
    assert seen[2][1] == {("record", None, 0, 1, 1), ("record", None, 1, 0, 1), ("labeller", "ann", None, None, 2)}
    # a replay of the newest batch, after folding, gives the same version
    before = state_rows(state, spark)
    events = spark.read.schema(EVENT).json(f"{folder}/in").where("seq >= 9 AND record_id = 'r2'")
    state.apply(events, 3)
    assert state_rows(state, spark) == before and seen[3][1] == {(r["kind"], r["who"], r["n_yes"], r["n_no"], r["n"]) for r in state.summary(spark).collect()}
    assert state_rows(state, spark, 3) == {("r1", "ann", "no", 4), ("r1", "bob", None, 6), ("r2", "ann", "yes", 9)}


def test_batch_reads_only_its_buckets(spark, folder):
    state = study_state(f"{folder}/state-b", EVENT, buckets=8).open(spark)
    rows = [(f"r{i}", "ann", "yes", None, i) for i in range(40)]
    frame = lambda part: spark.createDataFrame(part, EVENT)
    state.apply(frame(rows), 0)
    state.apply(frame([("r3", "bob", "no", None, 50)]), 1)
    written = spark.read.parquet(f"{folder}/state-b/rows/version=1")
    assert written.select("bucket").distinct().count() == 1 and written.count() == 1
    state.apply(frame(rows[:0]), 2)
    assert state.current(spark).count() == 41 and state.compact(spark) == 0 and state.current(spark).count() == 41


def test_gate_state_starts_with_all_records(spark, folder):
    from grantmill.operators import gate

    records = spark.createDataFrame([("a", "care", "holdout", "f"), ("b", "ambiguous", "tuning", "g")], "record_id string, label string, split string, fingerprint string")
    ddl = "record_id string, reviewer string, verdict string, label string, record_fingerprint string, labelled_at timestamp, seq bigint"
    state = gate_state(f"{folder}/gate", ddl, records, buckets=2)
    state.apply(spark.createDataFrame([("a", "x", "agree", "care", "f", None, 1), ("a", "y", "disagree", "intervention", "f", None, 2), ("b", "x", "agree", "ambiguous", "old", None, 3)], ddl), 0)
    s = {r["split"]: r for r in gate.gate_summary(state.summary(spark)).collect()}
    assert (s["all"].total, s["all"].reviewed, s["all"].conflicts, s["holdout"].conflicts) == (2, 1, 1, 1)
    verdicts = gate.mark_stale(state.current(spark), records)
    assert [(r["record_id"], [tuple(v) for v in r["verdicts"]]) for r in gate.conflict_list(records, verdicts).collect()] == [("a", [("x", "care"), ("y", "intervention")])]
    state.apply(spark.createDataFrame([("a", "y", "agree", "care", "f", None, 4)], ddl), 1)
    s = {r["split"]: r for r in gate.gate_summary(state.summary(spark)).collect()}
    assert (s["all"].conflicts, s["all"].agreed) == (0, 1)
    assert {r["split"]: r for r in gate.summarise(records, gate.mark_stale(state.current(spark), records)).collect()} == s


def test_mining_small_case(spark):
    docs = [(i, f"Title {i}", f"blind spot words about Gerda. We met Gerda and Gerda again {i}", "care", "ambiguous", 1000000.0) for i in range(4)]
    docs += [(10 + i, f"Other {i}", "plain background text about trains", "intervention", "intervention", 5.0) for i in range(6)]
    df = spark.createDataFrame(docs, "record_id bigint, title string, text string, expert string, label string, amount double")
    got = {r.term: r for r in mining.mine_candidates(df, small_lexicon(), ["the", "and", "about"]).collect()}
    assert "blind spot words" in got and got["blind spot words"].eur_pos_m == 4.0 and got["blind spot words"].n_pos == 4
    assert not any("gerda" in g for g in got), "proper nouns are dropped"
    assert got["blind spot"].context.startswith("blind spot words")


def test_lexicon_loop(spark):
    corpus = spark.createDataFrame(
        [(f"r{i}", f"Ageing matter {i}", f"gardens of quiet rest {i}", "care", "1000") for i in range(5)] + [(f"s{i}", "Lifespan", "flies", "fundamental_aging", "5") for i in range(5)],
        "record_id string, title string, llm_quote string, llm_category string, amount_eur string",
    )
    experts = corpus.select("record_id", F.col("llm_category").alias("expert_label"))
    rules = RuleSet(small_lexicon())
    mined = lexicon_loop.mine(corpus, experts, rules, ["of"])
    undecided = corpus.select("title", F.col("llm_quote").alias("abstract"), "amount_eur").filter("title like 'Ageing%'")
    gated = lexicon_loop.gate(mined, corpus, experts, undecided, {"en": (3, 0.6)})
    assert {r.decision for r in gated.filter("term = 'quiet rest'").collect()} == {"admit"}
    assert {r.label: r.rate for r in lexicon_loop.accept(corpus, experts, rules).collect()}["overall"] == 0.5


def test_funnel_digest_and_misfiled(spark, folder):
    from grantmill.functions.hashing import table_digest
    from grantmill.operators.normalize import funnel
    from grantmill.operators.validation import drifted, misfiled

    raw = spark.createDataFrame([("se", 2016), ("se", 2010), ("eu", 2017)], "source string, year int")
    f = funnel(raw, "source", {"fetched": F.lit(True), "kept": F.col("year") >= 2015})
    writers.write_funnel([f.filter("source = 'se'"), f.filter("source = 'eu'")], f"{folder}/funnel")
    assert {(r.source, r.stage): r.n for r in spark.read.parquet(f"{folder}/funnel").collect()}[("se", "kept")] == 1
    stored = table_digest(raw)
    assert not drifted(stored, table_digest(raw.repartition(5))).first().drifted
    assert drifted(stored, table_digest(raw.filter("year > 2010"))).first().drifted
    bad = misfiled(spark.createDataFrame([("sweden", "SE"), ("sweden", "NO"), ("mars", "MA")], "slug string, country string"), "slug", "country", {"sweden": "SE"})
    assert {(r.country, r.violation) for r in bad.collect()} == {("NO", "misfiled"), ("MA", "unknown file")}


def test_hot_keys_stay_exact(spark):
    """One key holds most rows: results equal brute force on the same rows."""
    from grantmill.operators.agreement import answer_counts, observed_agreement
    from grantmill.operators.normalize import dedupe_collect, rename_collisions
    from grantmill.operators.ratio import leave_one_out

    n = 3000
    rows = [(i, "hot" if i % 3 else f"k{i}", ["yes", "no", "borderline"][i % 3 - 1 if i % 2 else 0], i % 7) for i in range(n)]
    df = spark.createDataFrame(rows, "ord int, key string, geroscience string, p int")
    d = {r.key: r for r in dedupe_collect(df, ["key"], "ord", "p").collect()}
    assert d["hot"].ord == 1 and d["hot"].phrases == list(range(7)) and len(d) == n // 3 + 1
    named = rename_collisions(df, "key", "ord", "ord", "s").filter("key = 'hot'")
    assert named.filter("record_id = 's:hot'").count() == 1 and named.select("record_id").distinct().count() == 2 * n // 3
    j = df.select(F.col("key").alias("record_id"), F.col("ord").cast("string").alias("labeller_id"), "geroscience")
    hot = [a for _, k, a, _ in rows if k == "hot"]
    same = sum(hot.count(a) * (hot.count(a) - 1) // 2 for a in set(hot))
    got = observed_agreement(j).first()
    assert (got.agreeing_pairs, got.pairs) == (same, len(hot) * (len(hot) - 1) // 2) and answer_counts(j).count() == len(d)
    g = df.select(F.col("ord").cast("string").alias("record_id"), F.col("key").alias("region"), F.when(F.col("p") == 0, "intervention").otherwise("care").alias("label"),
                  (F.col("ord") + 1).cast("double").alias("amount_eur"))
    mine = [(i + 1, p == 0) for i, k, _, p in rows if k == "hot"]
    num, den = sum(v for v, x in mine if x), sum(v for v, _ in mine)
    swing = max(abs((num - v * x) / (den - v) - num / den) for v, x in mine)
    assert leave_one_out(g).filter("region = 'hot'").first().swing == round(swing, 6)
