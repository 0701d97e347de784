import pytest
from pyspark.sql import functions as F

from grantmill.functions.text import term_pattern
from grantmill.operators.lexicon import Lexicon, Term, term_problem
from grantmill.operators.matching import cue_literals, explode_hits, match_terms, net_filter, quote_found, screen
from grantmill.operators.mining import entity_funnel
from grantmill.operators.rules import RuleSet, classify
from grantmill import vocab
from lexicons import small_lexicon

# title, body, label, rule
CASES = [
    ("Temperature swing and the ageing of a li-ion battery pack", "", "not_relevant", "off_domain_engineering"),
    ("Cell ageing in batteries", "cells with new electrodes", "not_relevant", "off_domain_engineering"),
    ("Human cells near a battery in ageing", "patients", "ambiguous", "anchor_only"),
    ("Bridges and pipes", "", "not_relevant", "off_domain_engineering"),
    ("Stock markets of the north", "", "not_relevant", "no_evidence"),
    ("A journal of ageing", "", "ambiguous", "anchor_only"),
    ("Leaf senescence in deciduous forests", "autumn trees", "not_relevant", "off_domain_ecology"),
    ("Plant compounds against senescence", "in old mice", "fundamental_aging", "single_category"),
    ("Plants and senescence", "for people in old age", "fundamental_aging", "single_category"),
    ("Rapamycin and lifespan", "", "fundamental_aging", "boundary_contested"),
    ("How metformin acts: pathways of senescence", "", "fundamental_aging", "boundary_mechanism"),
    ("Trial of metformin against ageing", "", "intervention", "boundary_developing"),
    ("Rapamycin in aging", "", "ambiguous", "boundary_undecided"),
    ("Cellular senescence of tissue", "", "fundamental_aging", "single_category"),
    ("Retirement savings", "portfolio choice", "not_relevant", "no_evidence"),
    ("Retirement in ageing societies", "", "social_population_aging", "single_category"),
    ("Childhood cancer", "", "ambiguous", "single_weak"),
    ("Superlongevous mammals", "organelle homeostasis", "fundamental_aging", "single_category"),
    ("Senescence and alzheimer biology", "", "fundamental_aging", "tie_mechanism"),
    ("Nursing home retirement of the elderly", "", "care", "tie_service"),
    ("Retirement, ageism and nursing home", "of older adults nursing homes", "ambiguous", "tie_undecided"),
    ("Vaccines for alzheimer in elderly care", "", "age_related_disease", "tie_treatment"),
    ("Alzheimer and cellular senescence in lifespan data", "", "fundamental_aging", "decisive"),
    ("Tau and lifespan", "", "fundamental_aging", "tie_relative"),
    ("Exercise intervention against childhood cancer", "treatment", "intervention", "decisive"),
    ("Geroprotectors in nursing homes with metformin", "", "intervention", "decisive"),
    ("Retirement and loneliness of older adults", "participation", "social_population_aging", "single_category"),
]


def test_rule_cases(spark):
    rows = [(i, t, b) for i, (t, b, _, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "id int, title string, body string")
    got = {r.id: r for r in classify(df, "title", "body", RuleSet(small_lexicon())).collect()}
    wrong = [
        (t, label, rule, got[i].label, got[i].rule_path)
        for i, (t, _, label, rule) in enumerate(CASES)
        if (got[i].label, got[i].rule_path) != (label, rule)
    ]
    assert not wrong
    assert all(r.reason for r in got.values())


def test_confidence_and_evidence(spark):
    df = spark.createDataFrame(
        [(1, "Retirement and loneliness of older adults", ""), (2, "Rapamycin and lifespan", ""), (3, None, None)],
        "id int, title string, body string",
    )
    r = {x.id: x for x in classify(df, "title", "body", RuleSet(small_lexicon())).collect()}
    assert r[1].matched_keywords == {"social_population_aging": ["retirement", "loneliness (conditional)"]}
    assert r[1].anchor_terms == ["older adults"] and r[1].confidence is None
    assert r[2].confidence == 0.0 and r[2].margin == 0.0
    assert r[3].label == "not_relevant"


def test_rules_stay_on_the_jvm_without_shuffle(spark):
    df = spark.range(10).select("id", F.lit("senescence").alias("title"), F.lit("x").alias("body"))
    plan = classify(df, "title", "body", RuleSet(small_lexicon()))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "NestedLoop" not in plan


MATCHER = [
    ("aging", "anti-aging cream", True), ("aging", "imaging managing packaging", False),
    ("senolytic*", "senolytics work", True), ("cellulär* åldrande", "cellulärt  åldrande", True),
    ("nad+", "boosting nad+ levels", True), ("nad+", "nadir of the curve", False),
    ("long-term care", "long-term care homes", True), ("long-term care", "long-term\ncare", True),
    ("c. elegans", "in c. elegans worms", True), ("c. elegans", "in cx elegans worms", False),
    ("tion*", "station", False), ("über", "überall", False), ("li-ion", "a li-ion cell", True),
    ("aging", "åaging", False), ("home care", "care home", False), ("(ai)", "some (ai) here", True), ("(ai)", "x(ai)", False),
    ("nad+", "nad++ x", True), ("nad+", "nad+x", False), ("nad+", "ends in nad+", True), ("of the of", "of the of the", True),
    ("a - b", "a  -\tb", True), ("a - b", "a-b", False), ("e* of", "ends of", True), ("it's", "it\\'s it's", True), ("b", "a, b", True),
]


def test_matcher(spark):
    lexicon = Lexicon.phrases(list(dict.fromkeys(t for t, _, _ in MATCHER)))
    df = spark.createDataFrame([(i, text) for i, (_, text, _) in enumerate(MATCHER)], "id int, t string")
    together = {r["id"]: r["hits"] for r in match_terms(df, "t", lexicon).collect()}
    place = {t.term: t.ord for t in lexicon.terms}
    wrong = [(term, text) for i, (term, text, want) in enumerate(MATCHER) if (place[term] in together[i]) is not want]
    assert not wrong
    for term, text, want in MATCHER[:6]:
        alone = match_terms(df.where(F.col("t") == text), "t", Lexicon.phrases([term])).first()["hits"]
        assert (alone == [0]) is want, (term, text)
    assert df.filter(F.col("t").rlike(term_pattern("aging"))).count() == 1


def test_malformed_terms_are_rejected(spark):
    df = spark.createDataFrame([("t",)], "t string")
    for term in ("t*n", "*aging", "", "*", " aging", "aging ", "a**", "aging *", "co*-op"):
        with pytest.raises(ValueError):
            match_terms(df, "t", Lexicon.phrases([term]))


def test_empty_and_null_texts(spark):
    df = spark.createDataFrame([(None,), ("",), (" ;",), ("aging",)], "t string")
    for terms in (["aging"], ["aging", "home care", "a*"]):
        got = match_terms(df, "t", Lexicon.phrases(terms)).collect()
        assert [r["hits"] for r in got[:3]] == [[], [], []] and 0 in got[3]["hits"]


@pytest.mark.parametrize("size", [12, 13, 400])
def test_index_agrees_with_patterns_on_documents(spark, size):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("t", F.lower("text"))
    words = ["the", "tion*", "von der", "with", "no such thing", "e*", "la", "que", "und", "license*", "of the", "en*", "in"][:size]
    some = docs.selectExpr("explode(regexp_extract_all(t, '(?U)(\\\\w+)', 1)) w").distinct().orderBy("w").limit(8000).collect()
    words += [r["w"] for r in some[:: max(1, len(some) // max(1, size - 13))]][: max(0, size - 13)]
    lex = Lexicon.phrases(list(dict.fromkeys(words)))
    found = match_terms(docs, "t", lex, "a").select("doc_id", "t", "a")
    checked = [t for t in lex.terms if t.ord < 13 or t.ord % 40 == 0]
    picks = F.array_remove(F.array(*[F.when(F.col("t").rlike(term_pattern(t.term)), F.lit(t.ord)).otherwise(F.lit(-1)) for t in checked]), -1)
    ids = F.array(*[F.lit(t.ord) for t in checked])
    both = found.withColumn("b", F.coalesce(picks, F.array().cast("array<int>"))).withColumn("a", F.array_intersect("a", ids))
    assert both.filter("a != b").count() == 0
    assert both.filter("size(a) > 0").count() > 0
    assert explode_hits(both, lex, "doc_id", hits="a").count() == both.selectExpr("sum(size(a))").first()[0]


def test_term_problem(spark):
    bad = ["", None, "*", "a*b", "a* a* a* a*", "aging *", "x" * 61, "a**"]
    good = ["cellulär* åldrande", "nad+", "long-term care"]
    df = spark.createDataFrame([(t,) for t in bad + good], "t string")
    rows = df.select("t", term_problem(F.col("t")).alias("p")).collect()
    assert [r.t for r in rows if r.p] == bad
    assert [r.t for r in rows if not r.p] == good


def test_cue_literals_are_required():
    import re

    from grantmill.functions.text import cue_pattern  # noqa: F401

    for alternatives in vocab.CUES.values():
        assert cue_literals(alternatives)
    assert "older " in cue_literals(vocab.CUES["older_reference"])
    assert re.match("batter", cue_literals(vocab.CUES["battery"])[0])


def test_cue_guard_ignores_what_may_be_absent():
    assert cue_literals(["colou*r"]) == ["colo"] and cue_literals(["(?:foo(?:x)?bar|baz)"]) == []
    assert cue_literals(["old(?:er)?", "[ab]c"]) == ["old", "c"] and cue_literals(["(?i)abc"]) == [] and cue_literals(["a\\p{L}"]) == ["a"]
    assert cue_literals(["ab|cd"]) == [] and cue_literals(["a{2,3}bcd"]) == ["bcd"] and cue_literals(["x\\.yz\\b"]) == ["x.yz"]


def test_entity_funnel_finds_long_names_and_digits(spark):
    docs = spark.createDataFrame([("x insulin like growth factor, IL-6 and heart failure", "en")] * 5, "text string, label string")
    names = spark.createDataFrame([("Insulin like growth factor",), ("IL-6",), ("heart failure",), ("no such name",), ("--",)], "name string")
    got = {r["stage"]: r["n"] for r in entity_funnel(names, F.col("name"), docs, "text", "label", "en").collect()}
    assert got == {"listed": 5, "unique": 4, "long_enough": 4, "with_hits": 3, "enough_hits": 3, "admitted": 3}


def test_gram_levels_read_the_words_once(spark):
    from grantmill.functions.text import distinct_grams

    d = spark.createDataFrame([("One two the three four two three",), ("",), (None,)], "t string").select(distinct_grams(F.col("t"), ["the"]).alias("g"))
    assert d._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
    one, two, three = ("one", "two", "four"), ("one two", "three four", "four two", "two three"), ("three four two", "four two three")
    assert [r.g and sorted(r.g) for r in d.collect()] == [sorted([*one, "three", *two, *three]), [], None]


def test_entity_funnel_counts_before_it_joins(spark):
    docs = spark.createDataFrame([("a name of five words, and IL-6", "en"), ("another name of five words", "sv")] * 3, "text string, label string")
    names = spark.createDataFrame([("name of five words",), ("IL-6",), ("words",), ("not there",), ("of",)], "name string")
    out = entity_funnel(names, F.col("name"), docs, "text", "label", "en")
    assert {r["stage"]: r["n"] for r in out.collect()} == {
        "listed": 5, "unique": 5, "long_enough": 4, "with_hits": 3, "enough_hits": 3, "admitted": 1}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" not in plan  # it would shuffle every sequence of every text


def test_money_by_title_gram_equals_money_by_title(spark):
    import random

    from grantmill.functions.text import distinct_grams, explode_once, title_key
    from grantmill.operators.mining import money_by_title, money_by_title_gram

    rnd = random.Random(2)
    rows = [(i, f"Title {rnd.randrange(60)}", " ".join(rnd.choices(["alpha", "beta", "gamma", "delta", "the"], k=4)), f"{i}.10") for i in range(90)]
    d = spark.createDataFrame([*rows, (99, None, "alpha alone", None)], "record_id long, title string, text string, a string").withColumn("amount", F.col("a").cast("decimal(18,2)"))
    long = d.select("record_id", "amount", title_key(F.col("title")).alias("title_key"), explode_once(distinct_grams(F.col("text"), ["the"], 1)).alias("gram"))
    got = money_by_title_gram(d, "record_id", "text", "title", "amount", ["the"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, money_by_title(long, ["gram"]).collect()))
    assert "title_key" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_lifts_run_the_rules_once(spark):
    from workload import QUERIES

    files = QUERIES["candidate_lift"](spark, "/root/testdata/sf0.001").inputFiles()
    assert files and not any("documents" in f or "labels" in f for f in files)


def test_quote_query_folds_a_text_once(spark):
    from workload import QUERIES

    plan = QUERIES["quote_verification"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("Join", 1)
    assert above.count("regexp_replace") == 1 and below.count("regexp_replace") == 1  # the quote's; the text's


def test_net_screen_quote(spark):
    df = spark.createDataFrame([("senescence and longevity",), ("nothing",)], "t string")
    assert [r.matched_phrases for r in net_filter(df, "t", ["senescence", "longevity"]).collect()] == [["longevity", "senescence"]]
    flags = screen(df, "t", vocab.CANCER_TERMS_EN).collect()
    assert [r.flagged for r in flags] == [False, False]
    q = spark.createDataFrame(
        [("A  b", "x a\nB y", True), ("", "x", False), ("z", "x", False), ("q" * 401, "q" * 500, False), (None, "x", False)],
        "q string, s string, want boolean",
    )
    assert q.filter(quote_found(F.col("q"), F.col("s")) != F.col("want")).count() == 0
    assert Term("x").role == "keyword"


def test_fixture_lexicon_reaches_every_rule(spark):
    from grantmill.operators.rules import RULE_LABEL
    from workload.base import Tables, ruled_documents

    paths = {r["rule_path"] for r in ruled_documents(Tables(spark, "/root/testdata/sf0.01")).select("rule_path").distinct().collect()}
    assert paths == set(RULE_LABEL)
