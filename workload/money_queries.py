"""Ratios, distributions, sensitivities, rankings over grants."""

from __future__ import annotations

from pyspark.sql import functions as F

from grantmill import vocab
from grantmill.functions import money as fm
from grantmill.functions.dates import in_window
from grantmill.operators import awards, normalize, overlay, ranking, ratio

from .base import (
    ADJUDICATION_LOG, CUSTOMERS, DOCUMENTS, EXPERTS, GRANTS, PRIORITY_LABEL, RULED, TYPE_LABEL, adjudication_log, case,
    documents, finish_sql, grants, labelled_customers, measures_sql, query, ruled_documents, sql_case, sql_list, with_experts,
)

GRANT_AGG = f"WITH {GRANTS}, agg AS (SELECT {{keys}}, {measures_sql()} FROM grants GROUP BY {{keys}})"


@query(
    "ratio_rollup",
    f"""WITH {GRANTS}, agg AS (
      SELECT CASE WHEN grouping(region) = 1 THEN 'total' WHEN grouping(funder) = 1 THEN 'region' ELSE 'funder' END AS level,
             region, funder, {measures_sql()}
      FROM grants GROUP BY GROUPING SETS ((region, funder), (region), ()))
    SELECT {finish_sql('level, region, funder,')} FROM agg""",
)
def ratio_rollup(t):
    return ratio.ratio_rollup(grants(t))


@query(
    "funder_ranking",
    f"""{GRANT_AGG.format(keys='region, funder')}
    SELECT region, funder, CAST({' + '.join(f'd_{v}' for v in vocab.LABELS)} AS DOUBLE) AS total_eur FROM agg""",
)
def funder_ranking(t):
    agg = ratio.funding_ratio(grants(t), "region", "funder")
    # all labels count, undecided and irrelevant money too
    total = sum((F.col(f"eur_{v}").cast("decimal(28,2)") for v in vocab.LABELS), F.lit(0).cast("decimal(28,2)"))
    return agg.select("region", "funder", total.cast("double").alias("total_eur")).orderBy(F.desc("total_eur"))


@query(
    "ratio_scenario_compare",
    f"""WITH {CUSTOMERS}, {ADJUDICATION_LOG},
    merged AS (SELECT l.record_id, region, amount_eur, CASE WHEN a.record_id IS NOT NULL THEN a.label ELSE l.label END AS label
               FROM labelled l LEFT JOIN adjudicated a USING (record_id)),
    x AS (SELECT region, {measures_sql()} FROM labelled GROUP BY 1), y AS (SELECT region, {measures_sql()} FROM merged GROUP BY 1),
    fx AS (SELECT {finish_sql('region,')} FROM x), fy AS (SELECT {finish_sql('region,')} FROM y)
    SELECT region, fx.ratio AS rules_ratio, fx.ambiguous_share AS rules_ambiguous_share,
           fy.ratio AS adjudicated_ratio, fy.ambiguous_share AS adjudicated_ambiguous_share
    FROM fx JOIN fy USING (region)""",
)
def ratio_scenario_compare(t):
    return overlay.compare_scenarios(labelled_customers(t), overlay.latest_success(adjudication_log(t), order=["answered", "seq"]), "region")


@query(
    "adjudication_overlay",
    f"""WITH {CUSTOMERS}, {ADJUDICATION_LOG}
    SELECT l.record_id, CASE WHEN a.record_id IS NOT NULL THEN a.label ELSE l.label END AS label, a.reason AS reason,
           CASE WHEN a.record_id IS NOT NULL THEN 'model' END AS adjudicated_by
    FROM labelled l LEFT JOIN adjudicated a USING (record_id)""",
)
def adjudication_overlay(t):
    merged = overlay.overlay(labelled_customers(t), overlay.latest_success(adjudication_log(t), order=["answered", "seq"]))
    return merged.select("record_id", "label", "reason", "adjudicated_by")


@query(
    "category_distribution",
    f"""WITH {GRANTS}, c AS (
      SELECT region, label AS category, count(*) AS n, CAST(coalesce(sum(amount_eur * 2), 0) AS DOUBLE) AS amount_native,
             CAST(coalesce(sum(amount_eur), 0) AS DOUBLE) AS amount_eur FROM grants GROUP BY 1, 2)
    SELECT *, round(n / sum(n) OVER (PARTITION BY region), 4) AS record_share FROM c""",
)
def category_distribution(t):
    g = grants(t).withColumn("amount", F.col("amount_eur") * 2)
    return ratio.category_distribution(g, "region")


@query(
    "by_year_series",
    f"""WITH {GRANTS} SELECT region, year, count(*) AS n, CAST(coalesce(sum(amount_eur), 0) AS DOUBLE) AS amount_eur
    FROM grants GROUP BY 1, 2""",
)
def by_year_series(t):
    return ratio.count_and_money(grants(t), "region", "year").withColumn("year", F.col("year").cast("bigint"))


@query(
    "by_funder_type",
    f"""WITH {GRANTS} SELECT funder, p_brand AS funder_type, count(*) AS n, CAST(coalesce(sum(amount_eur), 0) AS DOUBLE) AS amount_eur
    FROM grants GROUP BY 1, 2""",
)
def by_funder_type(t):
    return ratio.count_and_money(grants(t).withColumnRenamed("p_brand", "funder_type"), "funder", "funder_type")


@query(
    "segment_only_split",
    f"""WITH {CUSTOMERS}, c AS (
      SELECT region, label AS category, count(*) AS n, CAST(coalesce(sum(amount_eur), 0) AS DOUBLE) AS amount_native,
             CAST(coalesce(sum(amount_eur), 0) AS DOUBLE) AS amount_eur FROM labelled WHERE funder <> 'NATION_3' GROUP BY 1, 2)
    SELECT *, round(n / sum(n) OVER (PARTITION BY region), 4) AS record_share FROM c""",
)
def segment_only_split(t):
    only = labelled_customers(t).filter("funder <> 'NATION_3'").withColumn("amount", F.col("amount_eur"))
    return ratio.category_distribution(only, "region")


@query(
    "ratio_bounds",
    f"""{GRANT_AGG.format(keys='region')}, s AS (
      SELECT region, CAST(d_fundamental_aging AS DOUBLE) AS p, CAST(d_ambiguous AS DOUBLE) AS a,
             CAST({' + '.join(f'd_{v}' for v in vocab.LEGACY_CATEGORIES)} AS DOUBLE) AS w,
             CAST({' + '.join(f'd_{v}' for v in vocab.LEGACY_CATEGORIES)} + d_ambiguous AS DOUBLE) AS wa,
             CAST(d_fundamental_aging + d_ambiguous AS DOUBLE) AS pa FROM agg)
    SELECT region, round(p / nullif(w, 0), 4) AS point, round(p / nullif(wa, 0), 4) AS lower, round(pa / nullif(wa, 0), 4) AS upper FROM s""",
)
def ratio_bounds(t):
    return ratio.ratio_bounds(grants(t), "region")


@query(
    "exclude_class_ratio",
    f"""WITH {GRANTS}, agg AS (SELECT region, {measures_sql()} FROM grants WHERE p_brand NOT IN ('Brand#1', 'Brand#2') GROUP BY 1)
    SELECT {finish_sql('region,')} FROM agg""",
)
def exclude_class_ratio(t):
    return ratio.funding_ratio(ratio.excluding(grants(t), "p_brand", ["Brand#1", "Brand#2"]), "region")


@query(
    "leave_one_out",
    f"""WITH {GRANTS}, g AS (
      SELECT region, record_id, coalesce(amount_eur, 0) AS den,
             CASE WHEN label IN ({sql_list(vocab.NUMERATOR)}) THEN coalesce(amount_eur, 0) ELSE 0 END AS num
      FROM grants WHERE label IN ({sql_list(vocab.CATEGORIES)})),
    s AS (SELECT *, sum(num) OVER w AS an, sum(den) OVER w AS ad FROM g WINDOW w AS (PARTITION BY region)),
    d AS (SELECT region, record_id, CAST(an AS DOUBLE) / CAST(ad AS DOUBLE) AS base,
                 CAST(an - num AS DOUBLE) / nullif(CAST(ad - den AS DOUBLE), 0) AS without FROM s)
    SELECT region, record_id, round(base, 6) AS ratio, round(without, 6) AS ratio_without, round(abs(without - base), 6) AS swing
    FROM d WHERE without IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY region ORDER BY abs(without - base) DESC, record_id) = 1""",
)
def leave_one_out(t):
    return ratio.leave_one_out(grants(t))


@query(
    "stratum_extrapolated_ratio",
    f"""WITH {CUSTOMERS}, {ADJUDICATION_LOG},
    s AS (SELECT l.label, a.label AS corrected FROM labelled l JOIN adjudicated a USING (record_id)),
    rates AS (SELECT label, avg((corrected IN ({sql_list(vocab.NUMERATOR)}))::INT) AS nr, avg((corrected IN ({sql_list(vocab.CATEGORIES)}))::INT) AS dr FROM s GROUP BY 1),
    money AS (SELECT label, CAST(coalesce(sum(amount_eur), 0) AS DOUBLE) AS eur FROM labelled GROUP BY 1)
    SELECT round(sum(eur * nr), 2) AS numerator_eur, round(sum(eur * dr), 2) AS denominator_eur,
           round(sum(eur * nr) / sum(eur * dr), 4) AS ratio FROM money JOIN rates USING (label)""",
)
def stratum_extrapolated_ratio(t):
    labels = labelled_customers(t)
    answers = overlay.latest_success(adjudication_log(t), order=["answered", "seq"]).select("record_id", F.col("label").alias("corrected"))
    return ratio.stratum_extrapolated(labels, labels.join(answers, "record_id"))


@query(
    "label_transitions",
    f"""WITH {CUSTOMERS}, {ADJUDICATION_LOG}
    SELECT l.label AS before, a.label AS after, count(*) AS n, CAST(coalesce(sum(amount_eur), 0) AS DOUBLE) AS eur
    FROM labelled l JOIN adjudicated a USING (record_id) GROUP BY 1, 2""",
)
def label_transitions(t):
    answers = overlay.latest_success(adjudication_log(t), order=["answered", "seq"]).select("record_id", F.col("label").alias("after_label"))
    return ratio.label_transitions(labelled_customers(t).join(answers, "record_id"), "label", "after_label")


@query(
    "capture_share",
    f"""WITH {GRANTS}, c AS (SELECT funder, year, sum(amount_eur) AS m FROM grants GROUP BY 1, 2),
    totals AS (SELECT n_name AS funder, year(o_orderdate) AS year, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS total_eur
               FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)
    SELECT funder, year, CAST(coalesce(m, 0) AS DOUBLE) AS corpus_eur, CAST(total_eur AS DOUBLE) AS total_eur,
           round(CAST(coalesce(m, 0) AS DOUBLE) / nullif(CAST(total_eur AS DOUBLE), 0), 4) AS capture_share
    FROM totals LEFT JOIN c USING (funder, year)""",
)
def capture_share(t):
    who = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("funder"))
    totals = t.orders.join(who, F.col("o_custkey") == F.col("c_custkey")).groupBy("funder", F.year("o_orderdate").alias("year")).agg(
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("total_eur")
    )
    return ratio.capture_share(grants(t), totals).withColumn("year", F.col("year").cast("bigint"))


@query(
    "ambiguous_by_rule",
    f"""WITH {RULED}
    SELECT source, CASE rule_path WHEN 'anchor_only' THEN 'no_match' WHEN 'boundary_undecided' THEN 'boundary'
      WHEN 'single_weak' THEN 'weak_evidence' WHEN 'tie_undecided' THEN 'near_tie' END AS undecided,
      count(*) AS n, CAST(sum(amount_eur) AS DOUBLE) AS amount_eur
    FROM ruled WHERE label = 'ambiguous' GROUP BY 1, 2""",
)
def ambiguous_by_rule(t):
    return ratio.ambiguous_by_rule(ruled_documents(t), "source")


@query(
    "headline_counters",
    f"""WITH {GRANTS} SELECT count(*) AS grants,
      CAST(coalesce(sum(amount_eur) FILTER (label IN ({sql_list(vocab.NUMERATOR)})), 0) AS DOUBLE) AS numerator_eur,
      count(DISTINCT region) AS jurisdictions FROM grants""",
)
def headline_counters(t):
    return ratio.headline_counters(grants(t))


# ---- rankings ---------------------------------------------------------------
@query(
    "top_funders",
    f"""{GRANT_AGG.format(keys='funder')}, f AS (SELECT {finish_sql('funder,')} FROM agg)
    SELECT funder, denominator_eur, ratio FROM f WHERE denominator_eur <> 0 ORDER BY denominator_eur DESC, funder LIMIT 8""",
)
def top_funders(t):
    return ranking.top_funders(ratio.funding_ratio(grants(t), "funder")).select("funder", "denominator_eur", "ratio")


@query(
    "region_rank",
    f"""{GRANT_AGG.format(keys='region')}, f AS (SELECT {finish_sql('region,')} FROM agg)
    SELECT region, ratio, row_number() OVER (ORDER BY ratio DESC NULLS LAST, region) AS position FROM f""",
)
def region_rank(t):
    ranked = ranking.rank_regions(ratio.funding_ratio(grants(t), "region"))
    return ranked.select("region", "ratio", F.col("position").cast("bigint").alias("position"))


@query(
    "paged_slice",
    f"""WITH {GRANTS} SELECT record_id, CAST(amount_eur AS DOUBLE) AS amount_eur FROM grants
    WHERE region = 'ASIA' AND label IN ('care', 'ambiguous')
    ORDER BY coalesce(amount_eur, 0) DESC, record_id LIMIT 25 OFFSET 25""",
)
def paged_slice(t):
    page = ranking.largest_grants(ranking.slice_view(grants(t), "ASIA", ["care", "ambiguous"]), page=1)
    return page.select("record_id", F.col("amount_eur").cast("double").alias("amount_eur"))


@query(
    "top_funders_by_source",
    f"""WITH {GRANTS}, f AS (SELECT region, funder, CAST(coalesce(sum(amount_eur), 0) AS DOUBLE) AS amount_eur FROM grants GROUP BY 1, 2)
    SELECT region, funder, amount_eur, row_number() OVER (PARTITION BY region ORDER BY amount_eur DESC, funder) AS position
    FROM f QUALIFY position <= 10""",
)
def top_funders_by_source(t):
    sums = ratio.count_and_money(grants(t), "region", "funder").drop("n")
    out = ranking.top_k(sums, ["region"], [F.desc("amount_eur"), F.col("funder")], 10, "position")
    return out.withColumn("position", F.col("position").cast("bigint"))


# ---- amounts, windows, dedupe ----------------------------------------------
CURRENCY = {"AUTOMOBILE": "SEK", "BUILDING": "USD", "FURNITURE": "GBP", "MACHINERY": "DKK", "HOUSEHOLD": "EUR"}


@query(
    "fx_convert",
    f"""SELECT o_orderkey, round(o_totalprice / CASE {' '.join(f"WHEN c_mktsegment = '{s}' THEN CAST({vocab.RATES_PER_EUR[c]} AS DOUBLE)" for s, c in CURRENCY.items())} ELSE CAST({vocab.RATES_PER_EUR['NOK']} AS DOUBLE) END, 2) AS amount_eur
    FROM orders JOIN customer ON o_custkey = c_custkey""",
)
def fx_convert(t):
    j = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    currency = F.coalesce(case(F.col("c_mktsegment"), CURRENCY), F.lit("NOK"))
    return j.select("o_orderkey", fm.to_eur(F.col("o_totalprice"), currency).alias("amount_eur"))


@query("year_window", "SELECT o_orderkey, year(o_orderdate) AS year FROM orders WHERE year(o_orderdate) BETWEEN 1997 AND 2000")
def year_window(t):
    y = F.year("o_orderdate")
    return t.orders.filter(in_window(y, 1997, 2000)).select("o_orderkey", y.cast("bigint").alias("year"))


@query(
    "amount_parse",
    r"""WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE l_returnflag WHEN 'A' THEN replace(CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR), '.', ',')
      WHEN 'N' THEN ' ' || CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) || ' ' ELSE 'n/a' END AS raw FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, TRY_CAST(replace(trim(raw), ',', '.') AS DOUBLE) AS amount FROM r""",
)
def amount_parse(t):
    text = F.col("l_extendedprice").cast("decimal(18,2)").cast("string")
    raw = F.when(F.col("l_returnflag") == "A", F.replace(text, F.lit("."), F.lit(","))).when(
        F.col("l_returnflag") == "N", F.concat(F.lit(" "), text, F.lit(" "))
    ).otherwise("n/a")
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", fm.comma_decimal(raw).alias("amount"))


@query(
    "amount_quarantine",
    """SELECT l_returnflag, CASE WHEN l_returnflag = 'R' THEN 'malformed' WHEN l_linestatus = 'O' THEN 'negative' END AS problem, count(*) AS n
    FROM lineitem GROUP BY 1, 2""",
)
def amount_quarantine(t):
    raw = F.when(F.col("l_returnflag") == "R", "n/a").when(
        F.col("l_linestatus") == "O", (-F.col("l_extendedprice")).cast("string")
    ).otherwise(F.col("l_extendedprice").cast("string"))
    return t.lineitem.groupBy("l_returnflag", fm.amount_problem(raw).alias("problem")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "checked_amounts",
    "SELECT CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total, count(*) AS n FROM lineitem",
)
def checked_amounts(t):
    amount = fm.checked_amount(F.col("l_extendedprice"), F.col("l_orderkey"))
    return t.lineitem.agg(F.sum(amount).cast("double").alias("total"), F.count(amount).alias("n"))


@query(
    "display_amount",
    """SELECT o_orderkey, CASE WHEN v >= 1e9 THEN format('€{:.1f}B', v / 1e9) WHEN v >= 1e6 THEN format('€{:.1f}M', v / 1e6)
      WHEN v >= 1e3 THEN format('€{:.0f}k', v / 1e3) ELSE format('€{:.0f}', floor(v + 0.5)) END AS shown
    FROM (SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN o_totalprice * 10007 + 0.13 WHEN 'O' THEN o_totalprice * 17 + 0.13 ELSE o_totalprice / 1009 END AS v FROM orders)""",
)
def display_amount(t):
    p = F.col("o_totalprice")
    v = F.when(F.col("o_orderstatus") == "P", p * 10007 + 0.13).when(F.col("o_orderstatus") == "O", p * 17 + 0.13).otherwise(p / 1009)
    return t.orders.select("o_orderkey", fm.display_eur(v, ties="even").alias("shown"))


@query(
    "dedupe_collect_phrases",
    """SELECT user_id, k, arg_min(event_id, event_id) AS event_id, arg_min(value, event_id) AS value, list_sort(list(DISTINCT event_type)) AS phrases
    FROM (SELECT *, json_extract_string(props, '$.k') AS k FROM events) GROUP BY user_id, k""",
)
def dedupe_collect_phrases(t):
    e = t.events.select("user_id", F.get_json_object("props", "$.k").alias("k"), "event_id", "value", "event_type")
    return normalize.dedupe_collect(e, ["user_id", "k"], "event_id", "event_type")


@query(
    "dedupe_prefer_parent",
    """SELECT user_id, event_id, value, child FROM (
      SELECT *, CASE WHEN event_type IN ('click', 'error') THEN event_type END AS child FROM events)
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY child IS NOT NULL, event_id) = 1""",
)
def dedupe_prefer_parent(t):
    child = F.when(F.col("event_type").isin("click", "error"), F.col("event_type"))
    e = t.events.select("user_id", "event_id", "value", child.alias("child"), "event_type")
    return normalize.dedupe_prefer_parent(e, "user_id", "event_id", "child", "event_type").drop("phrases")


@query(
    "dedupe_last_wins",
    "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1",
)
def dedupe_last_wins(t):
    return normalize.dedupe_last(t.events.select("user_id", "event_id", "event_type", "value"), "user_id", "event_id")


@query(
    "id_collision_rename",
    """SELECT event_id, CASE WHEN event_id = min(event_id) OVER (PARTITION BY user_id) THEN 'swecris:' || user_id
      ELSE 'swecris:' || user_id || ':' || event_type END AS record_id FROM events""",
)
def id_collision_rename(t):
    e = t.events.select("event_id", "user_id", "event_type")
    return normalize.rename_collisions(e, "user_id", "event_type", "event_id", "swecris").select("event_id", "record_id")


@query(
    "dedupe_title",
    DOCUMENTS.join(["WITH ", ""]) + r""", k AS (SELECT record_id, source, regexp_replace(lower(title), '[^\p{L}\p{N}\p{M}_]+', ' ', 'g') AS title_key FROM docs)
    SELECT source, title_key, min(record_id) AS record_id FROM k GROUP BY 1, 2""",
)
def dedupe_title(t):
    d = documents(t).select("record_id", "source", "title")
    return normalize.dedupe_title(d, "source", "title", "record_id").select("source", "title_key", "record_id")


@query(
    "first_match_lookup",
    """SELECT s_suppkey, coalesce(first_part, -1) AS first_part FROM supplier LEFT JOIN (
      SELECT l_suppkey, arg_min(l_partkey, l_orderkey * 10 + l_linenumber + l_partkey / 1e9) AS first_part FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
    ON s_suppkey = l_suppkey""",
)
def first_match_lookup(t):
    li = t.lineitem.withColumn("ord", F.col("l_orderkey") * 10 + F.col("l_linenumber") + F.col("l_partkey") / 1e9)
    first = normalize.first_lookup(li, "l_suppkey", "l_partkey", "ord", F.col("l_returnflag") == "R")
    j = t.supplier.join(first, F.col("s_suppkey") == F.col("l_suppkey"), "left")
    return j.select("s_suppkey", F.coalesce("l_partkey", F.lit(-1)).alias("first_part"))


@query(
    "source_funnel",
    """WITH d AS (SELECT source, n_chars > 500 AS a, lang = 'en' AS b FROM documents),
    g AS (SELECT source, count(*) AS fetched, count(*) FILTER (a) AS long_enough, count(*) FILTER (a AND b) AS kept FROM d GROUP BY 1)
    SELECT source, stage, n FROM g UNPIVOT (n FOR stage IN (fetched, long_enough, kept))""",
)
def source_funnel(t):
    a, b = F.col("n_chars") > 500, F.col("lang") == "en"
    return normalize.funnel(t.documents, "source", {"fetched": F.lit(True), "long_enough": a, "kept": a & b})


@query(
    "source_union",
    """SELECT source, count(*) AS n FROM (SELECT 'swecris' AS source, c_custkey AS id FROM customer UNION ALL
      SELECT 'cordis', s_suppkey FROM supplier UNION ALL SELECT 'reporter', p_partkey FROM part) GROUP BY 1""",
)
def source_union(t):
    one = lambda df, c, s: df.select(F.lit(s).alias("source"), F.col(c).alias("id"))
    u = normalize.union_sources(one(t.customer, "c_custkey", "swecris"), one(t.supplier, "s_suppkey", "cordis"), one(t.part, "p_partkey", "reporter"))
    return u.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


# ---- awards -----------------------------------------------------------------
SIDE_VALUE = "CAST(l_extendedprice AS DECIMAL(18,2))"


@query(
    "apportioned_profile",
    f"""WITH a AS (SELECT CAST(l_extendedprice AS DOUBLE) AS v, list_filter([CAST(p_size % 9 AS VARCHAR), CASE WHEN l_linenumber > 3 THEN CAST(l_linenumber AS VARCHAR) END], lambda x: x IS NOT NULL) AS g
      FROM lineitem JOIN part ON l_partkey = p_partkey),
    r AS (SELECT unnest(g) AS activity_group, v / len(g) AS v FROM a)
    SELECT activity_group, CASE activity_group {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in vocab.ACTIVITY_GROUPS.items())} ELSE activity_group END AS group_name,
      CASE WHEN activity_group = '3' THEN 'prevention' WHEN activity_group IN ('4', '5', '6', '7') THEN 'consequences' ELSE 'unmapped' END AS side,
      count(*) AS awards, round(sum(v), 1) AS apportioned FROM r GROUP BY 1""",
)
def apportioned_profile(t):
    j = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    groups = F.array_compact(F.array((F.col("p_size") % 9).cast("string"), F.when(F.col("l_linenumber") > 3, F.col("l_linenumber").cast("string"))))
    out = awards.apportioned_profile(j.select(groups.alias("g"), "l_extendedprice"), "g", "l_extendedprice")
    # float sums differ in the last cent with the order of addition
    return out.withColumn("apportioned", F.round("exact", 1)).drop("exact")


@query(
    "profile_sides",
    """WITH r AS (SELECT CASE WHEN p_size % 9 = 3 THEN 'p' WHEN p_size % 9 IN (4, 5, 6, 7) THEN 'c' ELSE 'u' END AS s, l_extendedprice AS v
      FROM lineitem JOIN part ON l_partkey = p_partkey)
    SELECT round(sum(v) FILTER (s = 'p'), 1) AS prevention, round(sum(v) FILTER (s = 'c'), 1) AS consequences, round(sum(v) FILTER (s = 'u'), 1) AS unmapped,
      round(sum(v) FILTER (s = 'p') / sum(v) FILTER (s IN ('p', 'c')), 6) AS prevention_share FROM r""",
)
def profile_sides(t):
    j = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.array((F.col("p_size") % 9).cast("string")).alias("g"), "l_extendedprice"
    )
    out = awards.profile_sides(awards.apportioned_profile(j, "g", "l_extendedprice"))
    return out.select(*[F.round(c, 1).alias(c) for c in ("prevention", "consequences", "unmapped")], "prevention_share")


CODING = "CASE WHEN quality IS NULL THEN 'Automated' WHEN toxic = 1 AND quality = 0 THEN 'Mixed' ELSE 'Manual' END"
AWARDS = EXPERTS + f""",
awards AS (SELECT *, {CODING} AS coding_type, amount_eur AS value_gbp,
  regexp_matches(t, 'license|apache') OR trim(t) = '' AS redacted,
  {' OR '.join(f"regexp_matches(t, '(^|[^{chr(92)}p{{L}}{chr(92)}p{{N}}_]){w}($|[^{chr(92)}p{{L}}{chr(92)}p{{N}}_])')" for w in ('worthless', 'stupid', 'idiot'))} AS predicted,
  quality = 0 OR toxic = 1 AS any_slot, quality = 0 AS first_slot FROM expert)"""
SCORE = """count(*) FILTER (predicted AND a) AS tp, count(*) FILTER (predicted AND NOT a) AS fp, count(*) FILTER (NOT predicted AND a) AS fn,
  count(*) FILTER (NOT predicted AND NOT a) AS tn, CAST(coalesce(sum(value_gbp) FILTER (predicted AND NOT a), 0) AS DOUBLE) AS wrongly_included,
  CAST(coalesce(sum(value_gbp) FILTER (NOT predicted AND a), 0) AS DOUBLE) AS missed"""


def human_awards(t):
    """Documents as awards: quality 0 is the first slot, toxic the second."""
    from grantmill.operators.lexicon import Lexicon
    from grantmill.functions.text import fence
    from grantmill.operators.matching import match_terms

    hit = match_terms(documents(t), "t", Lexicon.phrases(["worthless", "stupid", "idiot"]), "_p")
    found = hit.withColumns({"predicted": F.size("_p") > 0, "redacted": fence(F.col("t").rlike("license|apache")),
                              "hidden": fence(awards.is_redacted(awards.award_text()))})
    d = with_experts(t, found)
    coding = F.when(F.col("quality").isNull(), "Automated").when((F.col("toxic") == 1) & (F.col("quality") == 0), "Mixed").otherwise("Manual")
    slots = F.array_compact(F.array(F.when(F.col("quality") == 0, "low quality"), F.when(F.col("toxic") == 1, "toxic")))
    return d.select(
        "record_id", "title", "abstract", "t", "source", coding.alias("coding_type"), slots.alias("health_categories"),
        F.col("amount_eur").alias("value_gbp"), "redacted", "hidden", "quality", "toxic", "predicted",
    )


@query(
    "binary_money_score",
    f"""WITH {AWARDS}, m AS (SELECT * FROM awards WHERE coding_type = 'Manual'), s AS (
      SELECT 'any' AS run, {SCORE.replace(' a)', ' any_slot)')} FROM m WHERE NOT redacted
      UNION ALL SELECT 'first', {SCORE.replace(' a)', ' first_slot)')} FROM m WHERE NOT redacted
      UNION ALL SELECT 'with_redacted', {SCORE.replace(' a)', ' any_slot)')} FROM m),
    p AS (SELECT *, tp / nullif(tp + fp, 0) AS p, tp / nullif(tp + fn, 0) AS r FROM s)
    SELECT run, tp, fp, fn, tn, wrongly_included, missed, round(p, 6) AS precision, round(r, 6) AS recall,
      CASE WHEN p > 0 AND r > 0 THEN round(2 * p * r / (p + r), 6) END AS f1 FROM p""",
)
def binary_money_score(t):
    rows = awards.ground_truth(human_awards(t))
    clean = ~F.col("redacted")
    any_slot = awards.any_slot("health_categories", "toxic") | awards.any_slot("health_categories", "low quality")
    first = awards.first_slot("health_categories", "low quality")
    runs = {"any": (clean, any_slot), "first": (clean, first), "with_redacted": (F.lit(True), any_slot)}
    return awards.binary_scores(rows, "predicted", runs, "value_gbp")


@query(
    "award_coverage",
    f"""WITH {AWARDS} SELECT count(*) AS total, count(*) FILTER (coding_type = 'Manual') AS manual, count(*) FILTER (coding_type = 'Automated') AS automated,
      count(*) FILTER (coding_type = 'Mixed') AS mixed, count(*) FILTER (coding_type = 'Manual' AND trim(t) = '') AS redacted,
      count(*) FILTER (coding_type = 'Manual' AND trim(t) <> '') AS scoreable, CAST(sum(value_gbp) AS DOUBLE) AS total_value,
      CAST(sum(value_gbp) FILTER (coding_type = 'Manual') AS DOUBLE) AS manual_value FROM awards""",
)
def award_coverage(t):
    return awards.coverage_counts(human_awards(t), "hidden")


@query(
    "error_breakdown",
    f"""WITH {AWARDS} SELECT CASE WHEN quality = 0 THEN 'low quality' WHEN toxic = 1 THEN 'toxic' ELSE '' END AS category, count(*) AS n
    FROM awards WHERE predicted AND NOT coalesce(first_slot, false) GROUP BY 1""",
)
def error_breakdown(t):
    return awards.error_breakdown(human_awards(t), "predicted", awards.first_slot("health_categories", "low quality"), "health_categories")


NUM, CATS = sql_list(vocab.NUMERATOR), sql_list(vocab.CATEGORIES)


@query(
    "negative_control",
    f"""WITH {RULED} SELECT count(*) AS awards, round(count(*) FILTER (label IN ({NUM})) / count(*), 6) AS numerator_share,
      round(CAST(sum(amount_eur) FILTER (label IN ({NUM})) AS DOUBLE) / CAST(sum(amount_eur) FILTER (label IN ({CATS})) AS DOUBLE), 6) AS ratio
    FROM ruled""",
)
def negative_control(t):
    return awards.negative_control(ruled_documents(t), value="amount_eur")


@query(
    "suspicious_labels",
    f"""WITH {RULED} SELECT record_id, label, source AS human_category FROM ruled WHERE label IN ({NUM}) AND source IN ('src0', 'src1', 'src2')""",
)
def suspicious_labels(t):
    rows = ruled_documents(t).withColumn("hc", F.array("source"))
    return awards.suspicious(rows, "hc", listed=["src0", "src1", "src2"]).select("record_id", "label", "human_category")


@query(
    "broad_only_filter",
    f"""WITH {DOCUMENTS}, p AS (SELECT record_id, list_filter([CASE WHEN regexp_matches(t, '(^|[^\\p{{L}}\\p{{N}}_])the($|[^\\p{{L}}\\p{{N}}_])') THEN 'the' END,
        CASE WHEN regexp_matches(t, '(^|[^\\p{{L}}\\p{{N}}_])from($|[^\\p{{L}}\\p{{N}}_])') THEN 'from' END, CASE WHEN regexp_matches(t, '(^|[^\\p{{L}}\\p{{N}}_])dans($|[^\\p{{L}}\\p{{N}}_])') THEN 'dans' END], lambda x: x IS NOT NULL) AS m FROM docs)
    SELECT record_id, list_sort(m) AS matched_phrases, len(list_filter(m, lambda x: x <> 'the')) = 0 AS broad_only FROM p WHERE len(m) > 0""",
)
def broad_only_filter(t):
    from grantmill.operators.matching import net_filter

    d = documents(t).select("record_id", "t")
    hit = net_filter(d, "t", ["the", "from", "dans"])
    return hit.select("record_id", "matched_phrases", normalize.only_broad(F.col("matched_phrases"), ["the"]).alias("broad_only"))


TIERS = {"broad": ["the", "les"], "core": ["from", "dans", "nicht"], "social": ["from", "worthless"]}
LEDGER = ["the", "les", "from", "dans", "nicht", "worthless"]


@query(
    "phrase_ledger",
    f"""WITH {DOCUMENTS}, p AS (SELECT unnest([{', '.join(f"CASE WHEN regexp_matches(t, '(^|[^{chr(92)}p{{L}}{chr(92)}p{{N}}_]){w}($|[^{chr(92)}p{{L}}{chr(92)}p{{N}}_])') THEN '{w}' END" for w in LEDGER)}]) AS phrase FROM docs),
    tiers(tier, phrase) AS (VALUES {', '.join(f"('{g}', '{w}')" for g, ws in TIERS.items() for w in ws)})
    SELECT tier, phrase, count(*) AS rows FROM p JOIN tiers USING (phrase) GROUP BY 1, 2""",
)
def phrase_ledger(t):
    from grantmill.operators.matching import net_filter

    return normalize.phrase_ledger(net_filter(documents(t).select("t"), "t", LEDGER), TIERS)


__all__ = ["PRIORITY_LABEL", "TYPE_LABEL", "human_awards", "AWARDS", "sql_case"]
