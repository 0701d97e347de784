"""Normalisers, loaders, drift checks and the external benchmark, over tables made from the shared ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from grantmill import vocab
from grantmill.functions.hashing import part_digests
from grantmill.operators import awards, normalize, validation
from grantmill.plans import external, ratio_build
from grantmill.session import scratch_dir
from grantmill.sources import writers

from .base import CUSTOMERS, DOCUMENTS, documents, labelled_customers, query, sql_list

RATE = vocab.RATES_PER_EUR
SHOWN = ["record_id", "source", "source_id", "title", "abstract", "funder", "country", "year", "amount", "currency", "amount_eur", "url"]


def census_sql(source: str, extra: str) -> str:
    return f"SELECT record_id, '{source}' AS source, source_id, title, abstract, funder, country, year, amount, currency, round(amount / rate, 2) AS amount_eur, url, {extra}"


# ---- normalisers -----------------------------------------------------------------
def text(c):
    return F.col(c).cast("string")


@query(
    "census_swecris",
    f"""WITH raw AS (SELECT 'P' || o_custkey AS pid, o_orderstatus AS org, CASE WHEN o_orderkey % 11 = 0 THEN 'n/a' ELSE (year(o_orderdate) + 20) || '-03-01' END AS start,
        CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE ' T' || o_orderpriority END AS t_en, CASE WHEN o_orderkey % 25 <> 0 THEN 'S' || o_orderpriority || ' ' END AS t_sv,
        CASE WHEN o_orderkey % 3 <> 0 THEN 'en ' || o_orderkey END AS a_en, 'sv ' || o_orderkey AS a_sv, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE CAST(o_orderkey * 7 AS VARCHAR) END AS sek,
        CASE o_orderkey % 3 WHEN 0 THEN 'aging' WHEN 1 THEN 'livslängd' ELSE 'healthy ageing' END AS phrase, o_orderkey AS ord FROM orders),
      f AS (SELECT * EXCLUDE (phrase) FROM raw QUALIFY row_number() OVER (PARTITION BY pid, org, start ORDER BY ord) = 1),
      p AS (SELECT pid, org, start, list_sort(list(DISTINCT phrase)) AS phrases FROM raw GROUP BY ALL),
      k AS (SELECT *, TRY_CAST(left(start, 4) AS INT) AS year, trim(coalesce(nullif(t_en, ''), t_sv, '')) AS title FROM f JOIN p USING (pid, org, start)
        WHERE len(list_filter(phrases, lambda x: x NOT IN ({sql_list(vocab.BROAD_ONLY_PHRASES)}))) > 0),
      n AS (SELECT *, ord = min(ord) OVER (PARTITION BY pid) AS first FROM k WHERE year BETWEEN {vocab.FIRST_YEAR} AND {vocab.LAST_YEAR} AND title <> ''),
      c AS (SELECT 'swecris:' || pid || CASE WHEN first THEN '' ELSE ':' || org END AS record_id, pid AS source_id, title, trim(coalesce(a_en, a_sv)) AS abstract, 'Funder ' || org AS funder, 'SE' AS country, year,
        TRY_CAST(nullif(sek, '') AS DOUBLE) AS amount, 'SEK' AS currency, {RATE['SEK']}::DOUBLE AS rate, 'https://www.vr.se/english/swecris.html?searchText=' || pid AS url, phrases FROM n)
    {census_sql('swecris', 'phrases')} FROM c""",
)
def census_swecris(t):
    o, k = t.orders, F.col("o_orderkey")
    raw = o.select(
        F.concat(F.lit("P"), text("o_custkey")).alias("ProjectId"), F.col("o_orderstatus").alias("FundingOrganisationId"),
        F.when(k % 11 == 0, "n/a").otherwise(F.concat((F.year("o_orderdate") + 20).cast("string"), F.lit("-03-01"))).alias("FundingStartDate"),
        F.when(k % 5 == 0, "").otherwise(F.concat(F.lit(" T"), "o_orderpriority")).alias("ProjectTitleEn"),
        F.when(k % 25 != 0, F.concat(F.lit("S"), "o_orderpriority", F.lit(" "))).alias("ProjectTitleSv"),
        F.when(k % 3 != 0, F.concat(F.lit("en "), text("o_orderkey"))).alias("ProjectAbstractEn"), F.concat(F.lit("sv "), text("o_orderkey")).alias("ProjectAbstractSv"),
        F.concat(F.lit("Funder "), "o_orderstatus").alias("FundingOrganisationNameEn"), F.lit("x").alias("FundingOrganisationNameSv"),
        F.when(k % 4 == 0, "").otherwise((k * 7).cast("string")).alias("FundingsSek"), F.lit("t").alias("FundingOrganisationTypeOfOrganisationEn"),
        F.lit("c").alias("CoordinatingOrganisationNameEn"), F.when(k % 3 == 0, "aging").when(k % 3 == 1, "livslängd").otherwise("healthy ageing").alias("phrase"), k.alias("ord"))
    return normalize.swecris(raw, "2026-01-01").select(*SHOWN, F.col("extra.matched_phrases").alias("phrases"))


NET = ["the", "dans", "nicht"]
_HAS = "regexp_matches(ev, '(^|[^\\p{{L}}\\p{{N}}_]){}($|[^\\p{{L}}\\p{{N}}_])')"


@query(
    "census_cordis",
    f"""WITH {DOCUMENTS}, raw AS (SELECT CAST(record_id // 2 AS VARCHAR) AS id, title, abstract, ev, source AS programme, record_id AS ord, ' ' || (2010 + record_id % 18) || '-01-01' AS start,
        CASE WHEN record_id % 7 = 0 THEN '' ELSE CAST(amount_eur::BIGINT AS VARCHAR) || ',25' END AS eu FROM docs),
      m AS (SELECT *, list_sort(list_filter([{', '.join(f"CASE WHEN {_HAS.format(w)} THEN '{w}' END" for w in NET)}], lambda x: x IS NOT NULL)) AS phrases FROM raw),
      l AS (SELECT * FROM m WHERE len(phrases) > 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY ord DESC) = 1),
      o AS (SELECT CAST(c_custkey // 2 AS VARCHAR) AS id, trim(' N' || c_nationkey || ' ') AS country, c_custkey AS ord FROM customer WHERE c_custkey % 3 <> 2),
      co AS (SELECT id, arg_min(country, ord) AS country FROM o GROUP BY 1),
      c AS (SELECT 'cordis:' || id AS record_id, id AS source_id, regexp_replace(title, '^\\s+|\\s+$', '', 'g') AS title, left(regexp_replace(abstract, '^\\s+|\\s+$', '', 'g'), {vocab.ABSTRACT_LIMIT}) AS abstract,
        'European Commission' AS funder, coalesce(country, '') AS country, CAST(left(trim(start), 4) AS INT) AS year, TRY_CAST(replace(nullif(eu, ''), ',', '.') AS DOUBLE) AS amount, 'EUR' AS currency,
        1.0::DOUBLE AS rate, 'https://cordis.europa.eu/project/id/' || id AS url, phrases, programme FROM l LEFT JOIN co USING (id) WHERE CAST(left(trim(start), 4) AS INT) BETWEEN {vocab.FIRST_YEAR} AND {vocab.LAST_YEAR})
    {census_sql('cordis', 'phrases, programme')} FROM c""",
)
def census_cordis(t):
    d, k = documents(t), F.col("record_id")
    projects = d.select(
        F.floor(k / 2).cast("string").alias("id"), "title", F.col("abstract").alias("objective"), F.col("source").alias("programme"), k.alias("programme_ord"),
        F.concat(F.lit(" "), (2010 + k % 18).cast("string"), F.lit("-01-01")).alias("startDate"),
        F.when(k % 7 == 0, "").otherwise(F.concat(F.col("amount_eur").cast("bigint").cast("string"), F.lit(",25"))).alias("ecMaxContribution"),
        F.lit("1,5").alias("totalCost"), F.lit(" A ").alias("acronym"), F.lit("").alias("status"))
    c = F.col("c_custkey")
    organisations = t.customer.select(
        F.floor(c / 2).cast("string").alias("projectID"), F.concat(F.lit(" N"), text("c_nationkey"), F.lit(" ")).alias("country"),
        F.when(c % 3 == 0, "coordinator").when(c % 3 == 1, " Coordinator ").otherwise("participant").alias("role"), c.alias("ord"))
    out = normalize.cordis(projects, organisations, NET, "2026-01-01")
    return out.select(*SHOWN, F.col("extra.matched_phrases").alias("phrases"), F.col("extra.programme").alias("programme"))


@query(
    "census_reporter",
    f"""WITH raw AS (SELECT CASE WHEN user_id % 10 = 0 THEN '' ELSE 'R' || user_id END AS num, CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE CAST(event_id AS VARCHAR) END AS sub,
        CASE WHEN user_id % 7 = 0 THEN '  ' ELSE ' about ' || event_type || ' ' || event_id END AS abs, CASE WHEN user_id % 4 <> 0 THEN ' IC' || user_id % 5 END AS ic, event_type AS phrase,
        round(value * 1000) AS award, 2015 + CAST(event_id % 9 AS INT) AS fy, event_id AS ord FROM events),
      f AS (SELECT * EXCLUDE (phrase) FROM raw WHERE num <> '' QUALIFY row_number() OVER (PARTITION BY num ORDER BY coalesce(sub <> '', false), ord) = 1),
      p AS (SELECT num, list_sort(list(DISTINCT phrase)) AS phrases FROM raw WHERE num <> '' GROUP BY 1),
      c AS (SELECT 'reporter:' || num AS record_id, num AS source_id, 'Project ' || ord AS title, trim(abs) AS abstract, trim(coalesce(ic, 'NIH')) AS funder, 'US' AS country, fy AS year, award AS amount, 'USD' AS currency,
        {RATE['USD']}::DOUBLE AS rate, 'https://reporter.nih.gov/project-details/' || num AS url, phrases, sub FROM f JOIN p USING (num) WHERE trim(abs) <> '')
    {census_sql('reporter', 'phrases, sub AS subproject_id')} FROM c""",
)
def census_reporter(t):
    e, u, k = t.events, F.col("user_id"), F.col("event_id")
    raw = e.select(
        F.when(u % 10 == 0, "").otherwise(F.concat(F.lit("R"), text("user_id"))).alias("project_num"),
        F.when(k % 3 == 0, "").when(k % 3 == 2, text("event_id")).alias("subproject_id"),
        F.when(u % 7 == 0, "  ").otherwise(F.concat(F.lit(" about "), "event_type", F.lit(" "), text("event_id"))).alias("abstract_text"),
        F.struct(F.when(u % 4 != 0, F.concat(F.lit(" IC"), (u % 5).cast("string"))).alias("name")).alias("agency_ic_admin"),
        F.concat(F.lit("Project "), text("event_id")).alias("project_title"), F.round(F.col("value") * 1000).alias("award_amount"), (2015 + k % 9).cast("int").alias("fiscal_year"),
        F.struct(F.lit("o").alias("org_name")).alias("organization"), F.lit("R01").alias("activity_code"), F.col("event_type").alias("phrase"), k.alias("ord"))
    return normalize.reporter(raw, "2026-01-01").select(*SHOWN, F.col("extra.matched_phrases").alias("phrases"), F.col("extra.subproject_id").alias("subproject_id"))


# ---- drift and funnel --------------------------------------------------------------
_NET = ", ".join(f"coalesce(length({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')" for c in ("record_id", "label", "amount_eur"))


@query(
    "rollup_drift",
    f"""WITH {CUSTOMERS}, v AS (SELECT record_id, label, amount_eur, 0 AS input FROM labelled UNION ALL
        SELECT record_id, CASE WHEN record_id % 50 = 7 THEN 'care' ELSE label END, amount_eur, 1 FROM labelled WHERE record_id % 64 <> 9),
      d AS (SELECT input, ('0x' || left(sha256(record_id::VARCHAR), 12))::BIGINT % 64 AS part, count(*) AS n, sum(('0x' || left(sha256(concat_ws(',', {_NET})), 12))::BIGINT) AS digest FROM v GROUP BY ALL)
    SELECT coalesce(a.part, b.part) AS part, coalesce(a.n, 0) AS stored_rows, coalesce(b.n, 0) AS fresh_rows FROM (SELECT * FROM d WHERE input = 0) a FULL JOIN (SELECT * FROM d WHERE input = 1) b USING (part)
    WHERE a.digest IS DISTINCT FROM b.digest""",
)
def rollup_drift(t):
    """Parts that a change of labels touched; the unchanged rollup is read back without an error before."""
    labels = labelled_customers(t)
    path = scratch_dir(t.spark, "rollup")
    with_funder = labels.withColumn("funder", F.lit("f")) if "funder" not in labels.columns else labels
    ratio_build.store_rollup(with_funder, path)
    kept = ratio_build.load_rollup(with_funder, path).count()
    columns = ["record_id", "label", "amount_eur"]
    part_digests(labels.select(*columns), "record_id", *columns).write.parquet(f"{path}/three")
    changed = labels.withColumn("label", F.when(F.col("record_id") % 50 == 7, "care").otherwise(F.col("label"))).where("record_id % 64 <> 9")
    found = validation.changed_parts(t.spark.read.parquet(f"{path}/three"), part_digests(changed.select(*columns), "record_id", *columns))
    return found.where(F.lit(kept > 0))


@query(
    "written_funnel",
    """WITH d AS (SELECT source, n_chars > 500 AS a, lang = 'en' AS b FROM documents),
    g AS (SELECT source, count(*) AS fetched, count(*) FILTER (a) AS long_enough, count(*) FILTER (a AND b) AS kept, count(*) FILTER (a AND b) AS written FROM d GROUP BY 1)
    SELECT source, stage, n FROM g UNPIVOT (n FOR stage IN (fetched, long_enough, kept, written))""",
)
def written_funnel(t):
    """The funnel counted while the rows are written, and the rows that are there afterwards."""
    a, b = F.col("n_chars") > 500, F.col("lang") == "en"
    path = scratch_dir(t.spark, "counted")
    sources = [r["source"] for r in t.documents.select("source").distinct().collect()]  # the vocabulary of sources
    funnel = writers.write_counted(t.documents, path, "source", sources, {"fetched": F.lit(True), "long_enough": a, "kept": a & b})
    there = t.spark.read.parquet(path).groupBy("source").agg(F.count("*").alias("n"))
    names = t.spark.createDataFrame([(s,) for s in sources], "source string")
    return funnel.unionByName(names.join(there, "source", "left").select("source", F.lit("written").alias("stage"), F.coalesce("n", F.lit(0)).alias("n")))


# ---- awards ----------------------------------------------------------------------
WIDE_SQL = """wide AS (SELECT CASE WHEN c_custkey % 9 = 0 THEN '' ELSE 'A' || c_custkey END AS id, 'F' || c_nationkey AS funder, CASE c_custkey % 3 WHEN 0 THEN 'cancer of ' || c_mktsegment WHEN 1 THEN 'A tumour' ELSE c_name END AS title,
    CASE c_custkey % 5 WHEN 0 THEN ' ' ELSE lower(c_mktsegment) END AS abstract, CASE WHEN c_custkey % 6 = 0 THEN 'n/a' ELSE CAST(c_custkey * 3 AS VARCHAR) END AS v,
    CASE c_custkey % 4 WHEN 0 THEN ' Cancer and neoplasms ' WHEN 1 THEN '' ELSE 'Stroke' END AS hc1, CASE WHEN c_custkey % 8 = 1 THEN 'Cancer and neoplasms' END AS hc2,
    c_nationkey % 9 || '.1 x' AS ra1, CASE WHEN c_custkey % 2 = 0 THEN '5.2' END AS ra2, CASE c_custkey % 3 WHEN 2 THEN 'Automated' ELSE 'Manual' END AS coding FROM customer),
  loaded AS (SELECT id AS award_id, funder, title, abstract, coalesce(TRY_CAST(v AS DOUBLE), 0) AS value_gbp, list_filter([trim(coalesce(hc1, '')), trim(coalesce(hc2, ''))], lambda x: x <> '') AS health_categories,
    list_transform(list_filter([trim(coalesce(ra1, '')), trim(coalesce(ra2, ''))], lambda x: x <> ''), lambda x: split_part(x, '.', 1)) AS activity_groups, coding AS coding_type FROM wide WHERE id <> '')"""


def wide_awards(t):
    c = F.col("c_custkey")
    none = F.lit(None).cast("string")
    return t.customer.select(
        F.when(c % 9 == 0, "").otherwise(F.concat(F.lit("A"), text("c_custkey"))).alias("HRCS2022_ID"), F.concat(F.lit("F"), text("c_nationkey")).alias("FundingOrganisation"),
        F.when(c % 3 == 0, F.concat(F.lit("cancer of "), "c_mktsegment")).when(c % 3 == 1, "A tumour").otherwise(F.col("c_name")).alias("AwardTitle"),
        F.when(c % 5 == 0, " ").otherwise(F.lower("c_mktsegment")).alias("AwardAbstract"), F.when(c % 6 == 0, "n/a").otherwise((c * 3).cast("string")).alias("2022AnnualisedValue"),
        F.when(c % 4 == 0, " Cancer and neoplasms ").when(c % 4 == 1, "").otherwise("Stroke").alias("HC_1"), F.when(c % 8 == 1, "Cancer and neoplasms").alias("HC_2"),
        *[none.alias(f"HC_{i}") for i in (3, 4, 5)], F.concat((F.col("c_nationkey") % 9).cast("string"), F.lit(".1 x")).alias("RA_1"), F.when(c % 2 == 0, "5.2").alias("RA_2"),
        *[none.alias(f"RA_{i}") for i in (3, 4)], F.when(c % 3 == 2, "Automated").otherwise("Manual").alias("CodingType"))


@query("load_awards", f"WITH {WIDE_SQL} SELECT * FROM loaded")
def load_awards(t):
    return awards.load_awards(wide_awards(t))


@query(
    "predictor_scores",
    f"""WITH {WIDE_SQL}, m AS (SELECT *, contains(lower(title || ' ' || abstract), 'tumour') AS p, list_contains(health_categories, 'Cancer and neoplasms') AS a FROM loaded WHERE coding_type = 'Manual')
    SELECT count(*) FILTER (p AND a) AS tp, count(*) FILTER (p AND NOT a) AS fp, count(*) FILTER (NOT p AND a) AS fn, count(*) FILTER (NOT p AND NOT a) AS tn FROM m""",
)
def predictor_scores(t):
    """A predictor given as a Column function, scored against any slot."""
    rows = awards.ground_truth(awards.load_awards(wide_awards(t))).withColumn("text", awards.award_text())
    told = awards.predictor(lambda c: F.contains(F.lower(c), F.lit("tumour")))(rows)
    runs = {"any": (F.lit(True), awards.any_slot("health_categories", "Cancer and neoplasms"))}
    return awards.binary_scores(told, "predicted", runs, "value_gbp").select("tp", "fp", "fn", "tn")


@query(
    "external_control",
    f"""WITH {WIDE_SQL}, s AS (SELECT * FROM loaded WHERE coding_type = 'Manual' AND trim(title || ' ' || abstract) <> '')
    SELECT CASE WHEN contains(lower(title), 'cancer') THEN 'intervention' ELSE 'not_relevant' END AS label, count(*) AS n FROM s GROUP BY 1""",
)
def external_control(t):
    """The negative control with a classifier of its own."""
    def classify(df):
        label = F.when(F.contains(F.lower("title"), F.lit("cancer")), "intervention").otherwise("not_relevant")
        return df.withColumn("label", label).withColumn("matched_keywords", F.create_map(label, F.array(F.lit("cancer"))))

    return external.control(awards.load_awards(wide_awards(t)), classify)["labels"]


# ---- finding verdicts ------------------------------------------------------------------
CHECKS = vocab.FINDING_CHECKS


@query(
    "finding_verdicts",
    f"""WITH v AS (SELECT event_id, 'f' || event_id AS key, CASE WHEN event_id % 13 = 0 THEN 'x' ELSE 'f' || event_id END AS fid,
        CASE event_id % 4 WHEN 0 THEN 'null' WHEN 1 THEN 'false' ELSE 'true' END AS c0, CASE WHEN event_id % 17 = 0 THEN '"yes"' ELSE 'true' END AS c1, event_id % 5 <> 0 AS reviewed, event_id % 7 <> 0 AS correct FROM events),
      x AS (SELECT *, c0 <> 'null' AND c1 <> 'null' AS rev, c0 = 'true' AND c1 = 'true' AS cor FROM v)
    SELECT key, violation FROM (SELECT key, unnest(list_filter([CASE WHEN fid <> key THEN 'finding_id mismatch' END, CASE WHEN c1 NOT IN ('true', 'false', 'null') THEN 'bad check {CHECKS[1]}' END,
      CASE WHEN reviewed <> rev THEN 'reviewed flag inconsistent' END, CASE WHEN correct <> (rev AND cor) THEN 'correct flag inconsistent' END], lambda m: m IS NOT NULL)) AS violation FROM x)""",
)
def finding_verdicts(t):
    k = F.col("event_id")
    name = F.concat(F.lit("f"), text("event_id"))
    value = {c: F.lit("true") for c in CHECKS}
    value[CHECKS[0]] = F.when(k % 4 == 0, "null").when(k % 4 == 1, "false").otherwise("true")
    value[CHECKS[1]] = F.when(k % 17 == 0, '"yes"').otherwise("true")
    rows = t.events.select(
        name.alias("key"), F.when(k % 13 == 0, "x").otherwise(name).alias("finding_id"), F.create_map(*[x for c, v in value.items() for x in (F.lit(c), v)]).alias("checks"),
        (k % 5 != 0).alias("reviewed"), (k % 7 != 0).alias("correct"))
    return validation.verdict_violations(rows).select("key", "violation")


@query(
    "judge_marks",
    """WITH m AS (SELECT 'f' || event_id AS key, event_id FROM events WHERE event_id % 10 < 6)
    SELECT key, CASE event_id % 10 WHEN 0 THEN 'not an object' WHEN 1 THEN 'missing field judged_at' WHEN 2 THEN 'finding_id mismatch' WHEN 3 THEN 'unexpected field more' WHEN 4 THEN 'recency: bad verdict' ELSE 'recency: empty reason' END AS violation FROM m
    UNION ALL SELECT key, 'bad judged_at' FROM m WHERE event_id % 10 = 1""",
)
def judge_marks(t):
    k = F.col("event_id")
    name = F.concat(F.lit("f"), text("event_id"))

    def mark(verdict, reason):
        return '{"verdict":"%s","reason":"%s"}' % (verdict, reason)

    def raw(fid, judged, more="", recency=mark("pass", "fine")):
        others = ",".join(f'"{d}":{mark("pass", "fine")}' for d in sorted(vocab.FINDING_JUDGE_DIMENSIONS) if d != "recency")
        return F.concat(F.lit('{"finding_id":"'), fid, F.lit(f'","finding_fingerprint":"x"{judged}{more},"judges":{{"recency":{recency},{others}}}}}'))

    at = ',"judged_at":"2026-01-01T00:00:00Z"'
    text_of = (F.when(k % 10 == 0, "[1]").when(k % 10 == 1, raw(name, "")).when(k % 10 == 2, raw(F.lit("other"), at)).when(k % 10 == 3, raw(name, at, ',"more":1'))
               .when(k % 10 == 4, raw(name, at, recency=mark("perhaps", "fine"))).when(k % 10 == 5, raw(name, at, recency=mark("pass", " "))).otherwise(raw(name, at)))
    return validation.judge_mark_violations(t.events.select(name.alias("key"), text_of.alias("raw"))).select("key", "violation")
