import pytest
from pyspark.sql import functions as F

from grantmill.functions import dates, money
from grantmill.operators import normalize, overlay, ranking, ratio
from grantmill.plans import ratio_build
from grantmill.operators.rules import RuleSet
from lexicons import small_lexicon


def one(df):
    return df.collect()[0]


def test_ratio_math(spark):
    rows = [
        ("fundamental_aging", 20.0), ("intervention", 10.0), ("social_population_aging", 70.0), ("ambiguous", 100.0),
        ("not_relevant", 300.0), ("care", None),
    ]
    r = one(ratio.funding_ratio(spark.createDataFrame(rows, "label string, amount_eur double")))
    assert (r.records, r.numerator_eur, r.denominator_eur, r.ratio, r.ambiguous_share) == (6, 30.0, 100.0, 0.3, 0.5)
    assert r.eur_missing_records == 1 and r.eur_care == 0.0 and r.n_care == 1
    empty = one(ratio.funding_ratio(spark.createDataFrame([], "label string, amount_eur double")))
    assert empty.ratio is None and empty.ambiguous_share is None
    off = one(ratio.funding_ratio(spark.createDataFrame([("not_relevant", 5.0)], "label string, amount_eur double")))
    assert off.ratio is None


def test_checked_amount_fails_loudly(spark):
    ok = spark.createDataFrame([("a", ""), ("b", "12.5"), ("c", None)], "id string, v string")
    got = [r[0] for r in ok.select(money.checked_amount(F.col("v"), F.col("id"))).collect()]
    assert got[0] is None and float(got[1]) == 12.5 and got[2] is None
    for bad in ("x1", "-3", "NaN"):
        df = spark.createDataFrame([("rec-9", bad)], "id string, v string")
        with pytest.raises(Exception, match="rec-9"):
            df.select(money.checked_amount(F.col("v"), F.col("id"))).collect()


def test_conversion_and_display(spark):
    df = spark.createDataFrame([(112.373, "SEK"), (None, "USD"), (1.1592, "USD")], "a double, c string")
    assert [r[0] for r in df.select(money.to_eur(F.col("a"), F.col("c"))).collect()] == [10.0, None, 1.0]
    with pytest.raises(Exception, match="XYZ"):
        spark.createDataFrame([(1.0, "XYZ")], "a double, c string").select(money.to_eur(F.col("a"), F.col("c"))).collect()
    shown = spark.createDataFrame([(2.5e9,), (1.25e6,), (4600.0,), (12.4,), (None,)], "v double").select(money.display_eur(F.col("v")))
    assert [r[0] for r in shown.collect()] == ["€2.5B", "€1.3M", "€5k", "€12", "—"]


def test_display_rounds_the_exact_value(spark):
    values = [336_500.0, 2_500.0, 1_500.0, 1.25e6, 1.15e6, 2.75e9, 1234.56e9, 999.5]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    even, up = ([r[0] for r in df.select(money.display_eur(F.col("v"), ties)).collect()] for ties in ("even", "up"))
    assert even == ["€336k", "€2k", "€2k", "€1.2M", "€1.1M", "€2.8B", "€1234.6B", "€1000"]
    assert up == ["€337k", "€3k", "€2k", "€1.3M", "€1.1M", "€2.8B", "€1234.6B", "€1000"]


def test_dates(spark):
    df = spark.createDataFrame([("2024-05-01",), ("2021-01",), ("2016",), ("1990",), ("soon",), (None,)], "d string")
    w = df.select(dates.recency_weight(F.col("d"), F.lit("2024-06-01").cast("timestamp")))
    assert [r[0] for r in w.collect()] == [1.0, 0.75, 0.5, 0.3, 0.3, 0.3]
    y = spark.createDataFrame([("2015-03",), ("15",), ("",), ("20x5",)], "d string").select(dates.leading_year(F.col("d")))
    assert [r[0] for r in y.collect()] == [2015, None, None, None]


SWE = (
    "phrase string, ord int, ProjectId string, FundingOrganisationId string, FundingStartDate string, ProjectTitleEn string,"
    " ProjectTitleSv string, ProjectAbstractEn string, ProjectAbstractSv string, FundingsSek string, FundingOrganisationNameEn string,"
    " FundingOrganisationNameSv string, FundingOrganisationTypeOfOrganisationEn string, CoordinatingOrganisationNameEn string"
)


def test_swecris(spark):
    def row(phrase, n, pid, org, start, title, sv="", amount="1123.73"):
        return (phrase, n, pid, org, start, title, sv, "", "svensk text ", amount, " Vinnova ", "", "Governmental", "KTH")

    rows = [
        row("aging", 1, "p/1 å", "o1", "2016-01-01", "A"), row("ageing", 2, "p/1 å", "o1", "2016-01-01", "later"),
        row("aging", 3, "p2", "o1", "2016", "only broad"), row("ageing", 4, "p3", "o1", "2012", "too early"),
        row("ageing", 5, "p4", "o1", "2017", "", ""), row("ageing", 6, "p5", "o1", "2018", "", "Titel", "n/a"),
        row("ageing", 7, "p/1 å", "o2", "2019", "B"),
    ]
    got = {r.record_id: r for r in normalize.swecris(spark.createDataFrame(rows, SWE), "2026-01-01").collect()}
    assert set(got) == {"swecris:p/1 å", "swecris:p5", "swecris:p/1 å:o2"}
    first = got["swecris:p/1 å"]
    assert first.title == "A" and first.extra.matched_phrases == ["ageing", "aging"] and first.amount_eur == 100.0
    assert first.abstract == "svensk text" and first.funder == "Vinnova" and first.url.endswith("p/1%20%C3%A5")
    assert got["swecris:p5"].title == "Titel" and got["swecris:p5"].amount is None and got["swecris:p5"].year == 2018


def test_cordis(spark):
    p = spark.createDataFrame(
        [("1", "Senescence", "x", "2016-05-01", "6999962,25", "", "AC", "SIGNED", "fp7", 1), ("1", "Senescence 2", "y", "2017-05-01", "", "5", "AC", "SIGNED", "h2020", 2),
         ("2", "nothing", "here", "2016", "1", "", "", "", "fp7", 1), ("3", "longevity", "", "", "1", "", "", "", "fp7", 1)],
        "id string, title string, objective string, startDate string, ecMaxContribution string, totalCost string, acronym string, status string, programme string, programme_ord int",
    )
    o = spark.createDataFrame([("1", "participant", "FR", 1), ("1", " Coordinator ", " SE ", 2), ("1", "coordinator", "DE", 3)], "projectID string, role string, country string, ord int")
    (r,) = normalize.cordis(p, o, ["senescence", "longevity"], "2026-01-01").collect()
    assert (r.title, r.country, r.amount, r.extra.total_cost, r.extra.programme, r.extra.matched_phrases) == ("Senescence 2", "SE", None, 5.0, "h2020", ["senescence"])


def test_reporter(spark):
    ddl = (
        "phrase string, ord int, project_num string, subproject_id string, project_title string, abstract_text string, fiscal_year int,"
        " award_amount double, organization struct<org_name:string>, agency_ic_admin struct<name:string>, activity_code string"
    )
    rows = [
        ("a", 1, "R1", "77", "sub", "text", 2016, 1.0, ("MIT",), (None,), "R01"), ("b", 2, "R1", None, "parent", "text", 2016, 115.92, ("MIT",), ("NIA",), "R01"),
        ("a", 3, "R1", "", "late parent", "text", 2016, 3.0, None, None, "R01"), ("a", 4, "R2", None, "t", "  ", 2016, 1.0, None, None, "R01"), ("a", 5, None, None, "t", "x", 2016, 1.0, None, None, "R01"),
        ("a", 6, "R3", "1", "t", "x", 2016, None, None, None, "R01"),
    ]
    got = {r.record_id: r for r in normalize.reporter(spark.createDataFrame(rows, ddl), "d").collect()}
    assert set(got) == {"reporter:R1", "reporter:R3"}
    assert got["reporter:R1"].title == "parent" and got["reporter:R1"].extra.matched_phrases == ["a", "b"] and got["reporter:R1"].amount_eur == 100.0
    assert got["reporter:R3"].funder == "NIH" and got["reporter:R3"].amount_eur is None


def test_ratio_build_and_overlay(spark):
    census = spark.createDataFrame(
        [("s:1", "swecris", "Cellular senescence of tissue", "", 2016, " VR ", "10", "u"), ("c:1", "cordis", "A journal of ageing", "", 2016, "EC", "30", "u"),
         ("r:1", "reporter", "Nursing homes in elderly care", "", 2016, "NIH", "", "u")],
        "record_id string, source string, title string, abstract string, year int, funder string, amount_eur string, url string",
    )
    s = ratio_build.build(census, RuleSet(small_lexicon()))
    top = {(r.level, r.region, r.funder): r for r in s.rollup.collect()}
    assert top[("total", None, None)].ratio == 1.0 and top[("total", None, None)].eur_missing_records == 1
    assert top[("funder", "SE", "VR")].records == 1 and top[("region", "EU", None)].ratio is None
    log = spark.createDataFrame(
        [("c:1", "care", None, "q1", 1), ("c:1", "intervention", None, "q2", 2), ("c:1", "x", "boom", "", 3), ("s:1", "care", "boom", "", 4)],
        "record_id string, label string, error string, quote string, seq bigint",
    )
    merged = {r.record_id: r for r in ratio_build.build_adjudicated(s.labels, log).labels.collect()}
    assert merged["c:1"].label == "intervention" and merged["c:1"].quote == "q2" and merged["c:1"].adjudicated_by == "model" and merged["c:1"].confidence is None
    assert merged["s:1"].label == "fundamental_aging" and merged["s:1"].adjudicated_by is None
    bad = census.withColumn("source", F.lit("other"))
    with pytest.raises(Exception, match="unknown source"):
        ratio_build.label_census(bad, RuleSet(small_lexicon())).collect()


def test_top_k_beyond_the_pruned_limit(spark):
    df = spark.range(5000).select(F.col("id"), F.when(F.col("id") % 3 == 0, "hot").otherwise("cold").alias("g"))
    got = ranking.top_k(df, ["g"], [F.col("id")], 1200).filter("g = 'hot'")
    assert sorted(r.id for r in got.collect()) == [3 * i for i in range(1200)]


def test_top_k_prunes_before_the_shuffle(spark):
    df = spark.range(100).select("id", (F.col("id") % 2).alias("g"))
    plan = ranking.top_k(df, ["g"], [F.col("id")], 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_missing_benchmark_key_fails(spark):
    items = spark.createDataFrame([("B1",), ("B2",)], "input_id string")
    keys = spark.createDataFrame([("B1", "r1")], "input_id string, record_id string")
    labels = spark.createDataFrame([("r1", "care")], "record_id string, label string")
    with pytest.raises(Exception, match="B2"):
        overlay.resolve_keys(items, keys, labels, labels).collect()


def test_main_jobs_avoid_nested_loops_and_python(spark):
    from workload import QUERIES

    for name in ("ratio_rollup", "rule_labels", "leave_one_out", "candidate_lift", "fleiss_kappa", "gate_summary_wilson", "term_stats"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "Python" not in plan, name


def shuffled_columns(plan: str) -> list[str]:
    """The column lists of the rows that each exchange by key of a formatted plan sends (spreading one file over the cores is none)."""
    import re

    found = re.finditer(r"^\(\d+\) Exchange\s*\nInput \[\d+\]: \[(.*?)\]\nArguments: (\w+)", plan, re.M)
    return [m.group(1) for m in found if m.group(2) != "RoundRobinPartitioning"]


def test_texts_are_labelled_before_they_are_joined(spark):
    """With broadcasts off no exchange carries a text, though labels are joined by id."""
    from workload import QUERIES

    names = ("multiclass_prf", "confusion_matrix", "legacy_agreement", "agreement_by_label", "boundary_flags", "term_stats", "term_hits_by_label", "category_coverage",
             "term_audit", "stale_stats", "exclusion_stats", "binary_money_score", "award_coverage", "error_breakdown", "candidate_gates", "genericity_guard")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in names:
            plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
            sent = shuffled_columns(plan)
            texts = [c for columns in sent for c in columns.split(", ") if c.split("#")[0] in ("text", "abstract", "t", "_text", "low")]
            assert sent and not texts, (name, texts)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_scenarios_and_leave_one_out_need_one_pass(spark):
    from grantmill.operators import overlay
    from grantmill.operators.ratio import leave_one_out

    labels = spark.read.parquet("/root/testdata/sf0.001/customer.parquet").selectExpr(
        "c_custkey record_id", "c_mktsegment region", "'care' label", "c_acctbal amount_eur")
    plan = leave_one_out(labels)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("FileScan") == 1
    answers = spark.range(5).selectExpr("id record_id", "'intervention' label")
    plan = overlay.compare_scenarios(labels, answers, "region")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parquet") == 1 and plan.count("Join") == 1 and plan.count("Aggregate") == 1


def test_leave_one_out_edges(spark):
    from grantmill.operators.ratio import leave_one_out

    rows = [("a", "r1", "care", 5.0), ("a", "r2", "intervention", None), ("b", "r1", "care", 0.0), ("c", "r2", "care", 3.0), ("c", "r1", "care", 3.0), ("c", "r3", "intervention", 3.0)]
    got = {r.region: (r.record_id, r.swing) for r in leave_one_out(spark.createDataFrame(rows, "region string, record_id string, label string, amount_eur double")).collect()}
    # all money in one grant: without it there is no ratio, and the grant without money moves nothing; no money at all: no row
    assert got == {"a": ("r2", 0.0), "c": ("r3", 0.333333)}
