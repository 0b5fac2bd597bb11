"""Registered queries of joins, series, sampling, macro panels, networks, the axis, events and statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from parlance.operators import axis, events, graphs, joins, macro, panels, paths, sampling, series, speaker_graph, stats

from . import fixtures as X
from .registry import query
from .sqlkit import bal, r6, rounded

S = [f"s{i}" for i in range(1, 6)]


def _months(spark, sf):
    return X.table(spark, sf, "orders").select(F.trunc("o_orderdate", "MM").alias("month")).distinct()


_MONTHS = "months AS (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS month FROM orders)"
_RESOLVED = f"{X.EVENTS_SQL}, {_MONTHS}, ev AS (SELECT term, event, target, kind, coalesce(min(month) FILTER (WHERE month >= target), max(month)) AS event_month FROM events_c, months GROUP BY ALL)"


def _events(spark, sf):
    return joins.resolve_month(X.events(spark), _months(spark, sf))


# joins, spines and time lookup
@query("calendar_spine", f"WITH {X.TERMS_SQL}, {X.MACRO_SQL}, sp AS (SELECT term, CAST(unnest(generate_series(start, stop, INTERVAL 1 MONTH)) AS DATE) AS month FROM terms) SELECT term, month, s1 FROM sp LEFT JOIN macro USING (month)", dates="month")
def calendar_spine(spark, sf):
    sp = joins.month_spine(X.terms(spark)).select("term", "month")
    return sp.join(X.macro_monthly(spark, sf).select("month", "s1"), "month", "left")


@query("business_day_spine", f"WITH {X.MARKET_SQL}, sp AS (SELECT CAST(unnest(generate_series(DATE '2024-01-01', DATE '2024-02-05', INTERVAL 1 DAY)) AS DATE) AS date) SELECT date, click_close FROM sp LEFT JOIN market USING (date) WHERE isodow(date) <= 5", dates="date")
def business_day_spine(spark, sf):
    b = spark.createDataFrame([("2024-01-01", "2024-02-05")], "start string, stop string").select(F.to_date("start").alias("start"), F.to_date("stop").alias("stop"))
    return joins.business_days(b).select("date").join(X.market_daily(spark, sf).select("date", "click_close"), "date", "left")


@query("term_window_join", f"WITH {X.TERMS_SQL} SELECT term, CAST(year(o_orderdate) AS INTEGER) AS y, count(*) AS n FROM orders LEFT JOIN terms ON CAST(o_orderdate AS DATE) BETWEEN start AND stop GROUP BY ALL")
def term_window_join(spark, sf):
    o = X.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("date"))
    return joins.term_of(o, X.terms(spark)).groupBy("term", F.year("date").alias("y")).agg(F.count("*").alias("n"))


@query("multiway_left_join", X.with_m(f"{X.MACRO_SQL}, a AS (SELECT month, count(*) AS mentions FROM m GROUP BY 1), b AS (SELECT month, count(DISTINCT speaker) AS speakers FROM m WHERE party = 'BUILDING' GROUP BY 1) SELECT month, s1, mentions, coalesce(speakers, 0) AS speakers FROM macro LEFT JOIN a USING (month) LEFT JOIN b USING (month)"), dates="month")
def multiway_left_join(spark, sf):
    m = X.mentions(spark, sf)
    a, b = m.groupBy("month").agg(F.count("*").alias("mentions")), m.where("party = 'BUILDING'").groupBy("month").agg(F.countDistinct("speaker").alias("speakers"))
    return joins.multiway_left(X.macro_monthly(spark, sf).select("month", "s1"), [a, b], "month").na.fill(0, ["speakers"])


@query("outer_merge_series", "WITH a AS (SELECT CAST(ts AS DATE) AS date, count(*) AS clicks FROM events WHERE event_type = 'click' AND value > 40 GROUP BY 1), b AS (SELECT CAST(ts AS DATE) AS date, count(*) AS errors FROM events WHERE event_type = 'error' AND value > 60 GROUP BY 1) SELECT date, clicks, errors FROM a FULL JOIN b USING (date)", dates="date")
def outer_merge_series(spark, sf):
    e = X.table(spark, sf, "events").withColumn("date", F.to_date("ts"))
    a = e.where("event_type = 'click' and value > 40").groupBy("date").agg(F.count("*").alias("clicks"))
    return joins.outer_merge([a, e.where("event_type = 'error' and value > 60").groupBy("date").agg(F.count("*").alias("errors"))], "date")


@query("outer_pre_post", X.with_m(f"a AS (SELECT party, avg(score) AS pre FROM m WHERE year < 1996 GROUP BY 1), b AS (SELECT party, avg(score) AS post FROM m WHERE year > 1999 AND party <> 'BUILDING' GROUP BY 1) SELECT party, {r6('coalesce(pre, 0)')} AS pre, {r6('coalesce(post, 0)')} AS post, {r6('coalesce(post, 0) - coalesce(pre, 0)')} AS delta FROM a FULL JOIN b USING (party)"))
def outer_pre_post(spark, sf):
    m = X.mentions(spark, sf)
    a, b = m.where("year < 1996").groupBy("party").agg(F.avg("score").alias("pre")), m.where("year > 1999 and party <> 'BUILDING'").groupBy("party").agg(F.avg("score").alias("post"))
    j = joins.outer_merge([a, b], "party").na.fill(0.0, ["pre", "post"])
    return rounded(j.withColumn("delta", F.col("post") - F.col("pre")))


@query("resolve_event_month", f"WITH {_RESOLVED} SELECT * FROM ev", dates="target event_month")
def resolve_event_month(spark, sf):
    return _events(spark, sf)


_STAGES = "st AS (SELECT *, CASE WHEN month < event_month THEN 'pre' WHEN month = event_month THEN 'shock' ELSE 'post' END AS stage FROM (SELECT *, CAST(unnest(generate_series(event_month - INTERVAL 3 MONTH, event_month + INTERVAL 3 MONTH, INTERVAL 1 MONTH)) AS DATE) AS month FROM ev))"


@query("stage_windows", f"WITH {_RESOLVED}, {_STAGES} SELECT event, month, stage FROM st", dates="month")
def stage_windows(spark, sf):
    return joins.stage_windows(_events(spark, sf)).select("event", "month", "stage")


_ELIGIBLE = "el AS (SELECT a.month FROM months a JOIN months b ON b.month BETWEEN a.month - INTERVAL 3 MONTH AND a.month + INTERVAL 3 MONTH GROUP BY 1 HAVING count(*) = 7)"


@query("eligible_months", f"WITH {_MONTHS}, {_ELIGIBLE} SELECT month FROM el", dates="month")
def eligible_months(spark, sf):
    return joins.eligible_months(_months(spark, sf))


@query("day_windows", f"WITH {_RESOLVED} SELECT event, CAST(event_month - INTERVAL 2 MONTH AS DATE) AS pre_start, event_month - 1 AS pre_stop, event_month AS post_start, CAST(event_month + INTERVAL 2 MONTH AS DATE) + 27 AS post_stop FROM ev", dates="pre_start pre_stop post_start post_stop")
def day_windows(spark, sf):
    return joins.day_windows(_events(spark, sf)).select("event", "pre_start", "pre_stop", "post_start", "post_stop")


@query("available_month_window", f"WITH {_RESOLVED}, r AS (SELECT event, month, CASE WHEN month < event_month THEN 'pre' ELSE 'post' END AS side, row_number() OVER (PARTITION BY event, month < event_month ORDER BY abs(datediff('month', event_month, month))) AS k FROM ev, months) SELECT event, side, month FROM r WHERE k <= 4", dates="month")
def available_month_window(spark, sf):
    return joins.available_window(_events(spark, sf), _months(spark, sf), 4).select("event", "side", "month")


@query("anchor_trading_day", f"WITH {X.MARKET_SQL}, e(event, event_date) AS (VALUES ('a', DATE '2024-01-06'), ('b', DATE '2024-01-10'), ('c', DATE '2024-03-01')) SELECT event, event_date, min(date) AS anchor FROM e LEFT JOIN market ON date >= event_date AND isodow(date) <= 5 GROUP BY ALL", dates="event_date anchor")
def anchor_trading_day(spark, sf):
    e = spark.createDataFrame([("a", "2024-01-06"), ("b", "2024-01-10"), ("c", "2024-03-01")], "event string, event_date string").withColumn("event_date", F.to_date("event_date"))
    return joins.anchor_day(e, X.market_daily(spark, sf))


@query("pair_enumeration", X.with_m("d AS (SELECT DISTINCT year, party FROM m) SELECT a.year, a.party, b.party AS party_b FROM d a JOIN d b ON a.year = b.year AND a.party < b.party"))
def pair_enumeration(spark, sf):
    return joins.pairs(X.mentions(spark, sf), ["year"], "party")


# series
@query("lag_lead", f"WITH {X.MACRO_SQL} SELECT month, s1, lag(s1) OVER w AS s1_lag1, lag(s2) OVER w AS s2_lag1, lead(s1, 1) OVER w AS s1_lead1, lead(s1, 2) OVER w AS s1_lead2, lead(s1, 3) OVER w AS s1_lead3 FROM macro WINDOW w AS (ORDER BY month)", dates="month")
def lag_lead(spark, sf):
    p = X.macro_monthly(spark, sf).select("month", "s1", "s2")
    return series.lags_leads(p, series.ordered("month"), {"s1": [1], "s2": [1]}, {"s1": [1, 2, 3]}).drop("s2")


@query("pct_change", f"WITH {X.MACRO_SQL} SELECT month, {r6('100 * (s1 / nullif(lag(s1) OVER w, 0) - 1)')} AS change_1, {r6('100 * (s1 / nullif(lag(s1, 12) OVER w, 0) - 1)')} AS change_12 FROM macro WINDOW w AS (ORDER BY month)", dates="month")
def pct_change(spark, sf):
    w = series.ordered("month")
    return rounded(X.macro_monthly(spark, sf).select("month", series.pct_change("s1", w).alias("change_1"), series.pct_change("s1", w, 12).alias("change_12")))


@query("first_difference", f"WITH {X.MACRO_SQL} SELECT month, {r6('s1 - lag(s1) OVER (ORDER BY month)')} AS change FROM macro", dates="month")
def first_difference(spark, sf):
    return rounded(X.macro_monthly(spark, sf).select("month", series.difference("s1", series.ordered("month")).alias("change")))


@query("interpolate_linear", f"""WITH {X.MACRO_SQL}, g AS (SELECT month, CASE WHEN month(month) NOT IN (1, 3, 4, 5) THEN s1 END AS v, row_number() OVER (ORDER BY month) AS n FROM macro),
  h AS (SELECT *, last_value(v IGNORE NULLS) OVER a AS va, last_value(CASE WHEN v IS NOT NULL THEN n END IGNORE NULLS) OVER a AS na, first_value(v IGNORE NULLS) OVER b AS vb, first_value(CASE WHEN v IS NOT NULL THEN n END IGNORE NULLS) OVER b AS nb FROM g
  WINDOW a AS (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
  SELECT month, v, {r6('coalesce(v, va + (vb - va) * ((n - na) / nullif(nb - na, 0)::DOUBLE))')} AS filled FROM h""", dates="month")
def interpolate_linear(spark, sf):
    g = X.macro_monthly(spark, sf).select("month", F.when(~F.month("month").isin(1, 3, 4, 5), F.col("s1")).alias("v"))
    return rounded(series.interpolate(g, "v", "month"))


@query("first_last_in_group", f"WITH {X.MACRO_SQL} SELECT CAST(year(month) AS INTEGER) AS year, arg_min(s1, month) AS first, arg_max(s1, month) AS last, count(s1) AS n, {r6('CASE WHEN count(s1) >= 2 THEN 100 * (arg_max(s1, month) / nullif(arg_min(s1, month), 0) - 1) END')} AS return_pct FROM macro GROUP BY 1")
def first_last_in_group(spark, sf):
    p = X.macro_monthly(spark, sf).withColumn("year", F.year("month"))
    return rounded(series.first_last(p, ["year"], "month", "s1"))


# sampling
@query("sample_per_group", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id || '|7'), doc_id) AS k FROM documents) SELECT lang, doc_id FROM r WHERE k <= 20")
def sample_per_group(spark, sf):
    return sampling.per_group(X.table(spark, sf, "documents").select("lang", "doc_id"), ["lang"], "doc_id", 20, 7)


@query("sample_stratified_topup", "WITH s AS (SELECT doc_id, lang, source, md5(doc_id || '|7') AS d, row_number() OVER (PARTITION BY lang, source ORDER BY md5(doc_id || '|7'), doc_id) AS k FROM documents), e AS (SELECT greatest(floor(150 / count(*)::DOUBLE), 1) AS each FROM (SELECT DISTINCT lang, source FROM documents)) SELECT doc_id, lang, source FROM s, e ORDER BY k > each, d, doc_id LIMIT 150")
def sample_stratified_topup(spark, sf):
    return sampling.stratified(X.table(spark, sf, "documents").select("doc_id", "lang", "source"), ["lang", "source"], "doc_id", 150, 7)


_HEUR = r"hr AS (SELECT doc_id, len(regexp_extract_all(text, '\bthe\b')) AS pos, len(regexp_extract_all(text, '\bof\b')) AS neg, len(regexp_extract_all(text, '[a-z]+')) AS word_count FROM (SELECT doc_id, lower(text) AS text FROM documents)), hs AS (SELECT *, (pos - neg) / (pos + neg + 1.0::DOUBLE) AS score FROM hr), hl AS (SELECT *, CASE WHEN score >= 0.2 THEN 'positive' WHEN score <= -0.2 THEN 'negative' ELSE 'mixed' END AS label FROM hs)"


def _heuristic(spark, sf):
    """A heuristic score and label of each document."""
    t = X.table(spark, sf, "documents").select("doc_id", F.lower("text").alias("t"))
    n = lambda p: F.regexp_count("t", F.lit(p))
    s = t.select("doc_id", n(r"\bthe\b").alias("pos"), n(r"\bof\b").alias("neg"), n("[a-z]+").alias("word_count"))
    s = s.withColumn("score", (F.col("pos") - F.col("neg")) / (F.col("pos") + F.col("neg") + 1.0))
    label = F.when(F.col("score") >= 0.2, "positive").when(F.col("score") <= -0.2, "negative").otherwise("mixed")
    return s.select("doc_id", "score", label.alias("label"), (F.col("pos") + F.col("neg")).alias("hits"), "word_count")


@query("sample_candidate_strata", f"WITH {_HEUR}, p AS (SELECT doc_id, CASE WHEN label <> 'mixed' THEN label WHEN abs(score) >= 0.05 OR pos + neg > 0 THEN 'border' END AS pool FROM hl WHERE word_count >= 30 AND doc_id NOT IN (SELECT doc_id FROM labels)), r AS (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY md5(doc_id || '|11'), doc_id) AS k FROM p WHERE pool IS NOT NULL) SELECT pool, doc_id FROM r WHERE k <= 25")
def sample_candidate_strata(spark, sf):
    p = sampling.candidate_pools(_heuristic(spark, sf), X.table(spark, sf, "labels"), "doc_id")
    return sampling.per_group(p, ["pool"], "doc_id", 25, 11).select("pool", "doc_id")


_GOLDS = f"{_HEUR}, v1 AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'positive' ELSE 'negative' END AS label FROM labels WHERE doc_id % 2 = 0), v2 AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN ' ' ELSE label END AS label FROM hl WHERE doc_id % 2 = 1)"


@query("gold_union", f"WITH {_GOLDS}, u AS (SELECT 'v1' AS source, label FROM v1 UNION ALL SELECT 'v2', label FROM v2 WHERE trim(label) <> '') SELECT source, label, label <> 'mixed' AS binary, count(*) AS n FROM u GROUP BY ALL")
def gold_union(spark, sf):
    one = X.table(spark, sf, "labels").where("doc_id % 2 = 0").select("doc_id", F.when(F.col("quality") == 1, "positive").otherwise("negative").alias("label"))
    two = _heuristic(spark, sf).where("doc_id % 2 = 1").select("doc_id", F.when(F.col("doc_id") % 3 == 0, " ").otherwise(F.col("label")).alias("label"))
    return sampling.gold_union(one, two).groupBy("source", "label", "binary").agg(F.count("*").alias("n"))


_FIVE = [f"ann_{i}" for i in range(1, 6)]


@query("annotation_table", f"WITH {_HEUR}, vf AS (SELECT doc_id, CASE WHEN toxic = 1 THEN NULL WHEN quality = 1 THEN 'positive' ELSE 'negative' END AS final_label, CASE WHEN quality = 1 THEN 'positive' ELSE 'negative' END AS ann_1 FROM labels WHERE doc_id IS NOT NULL) SELECT doc_id, label AS heuristic, coalesce(vf.final_label, label) AS final_label, vf.doc_id IS NOT NULL AS verified, ann_1, NULL::VARCHAR AS ann_2, NULL::VARCHAR AS ann_3, NULL::VARCHAR AS ann_4, NULL::VARCHAR AS ann_5 FROM hl LEFT JOIN vf USING (doc_id)")
def annotation_table(spark, sf):
    h = _heuristic(spark, sf).select("doc_id", F.col("label").alias("heuristic"))
    name = F.when(F.col("quality") == 1, "positive").otherwise("negative")
    v = X.table(spark, sf, "labels").where("doc_id is not null").select("doc_id", F.when(F.col("toxic") != 1, name).alias("final_label"), name.alias("ann_1"))
    return sampling.annotation_table(v.join(h, "doc_id"), h, "doc_id", "heuristic", _FIVE).select("doc_id", "heuristic", "final_label", "verified", *_FIVE)


@query("dedupe_keep_last", "WITH a AS (SELECT o_custkey, sum(o_totalprice) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT o_custkey, sum(o_totalprice) AS v FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) SELECT o_custkey, round(v, 2) AS v FROM b UNION ALL SELECT o_custkey, round(v, 2) FROM a WHERE o_custkey NOT IN (SELECT o_custkey FROM b)")
def dedupe_keep_last(spark, sf):
    o = X.table(spark, sf, "orders")
    part = lambda s: o.where(F.col("o_orderstatus") == s).groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("v"))
    return sampling.keep_last([part("F"), part("P")], ["o_custkey"])


@query("duplicate_count", "SELECT (count(*) - count(DISTINCT (l_orderkey, l_linenumber)))::BIGINT AS duplicates FROM lineitem")
def duplicate_count(spark, sf):
    return sampling.duplicate_count(X.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("membership_filters", "SELECT count(*) FILTER (WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')) AS inside, count(*) FILTER (WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')) AS outside FROM customer")
def membership_filters(spark, sf):
    inside = F.col("c_mktsegment").isin(X.GOVERNMENT)
    return X.table(spark, sf, "customer").agg(F.count_if(inside).alias("inside"), F.count_if(~inside).alias("outside"))


# macro
@query("month_avg_last", "WITH w AS (SELECT CAST(date_trunc('week', ts) AS DATE) AS date, avg(value) AS v FROM events GROUP BY 1) SELECT CAST(date_trunc('month', date) AS DATE) AS month, round(avg(v), 6) AS v_avg, round(arg_max(v, date), 6) AS v_last FROM w GROUP BY 1", dates="month")
def month_avg_last(spark, sf):
    w = X.table(spark, sf, "events").groupBy(F.to_date(F.date_trunc("week", "ts")).alias("date")).agg(F.avg("value").alias("v"))
    return rounded(macro.observations_to_month(w, ["v"]))


@query("daily_market_panel", f"WITH {X.MARKET_SQL} SELECT date, " + ", ".join(f"{t}_close, {r6(f'100 * ({t}_close / nullif(lag({t}_close) OVER w, 0) - 1)')} AS {t}_return" for t in X.TYPES) + " FROM market WINDOW w AS (ORDER BY date)", dates="date")
def daily_market_panel(spark, sf):
    w = series.ordered("date")
    d = X.market_daily(spark, sf)
    return rounded(d.select("date", *[x for t in X.TYPES for x in (F.col(f"{t}_close"), series.pct_change(f"{t}_close", w).alias(f"{t}_return"))]))


@query("zscore", f"WITH {X.MACRO_SQL} SELECT month, {r6('coalesce((s1 - avg(s1) OVER ()) / CASE WHEN coalesce(stddev_samp(s1) OVER (), 0) = 0 THEN 1 ELSE stddev_samp(s1) OVER () END, 0)')} AS sample_z, {r6('(s1 - avg(s1) OVER ()) / nullif(stddev_pop(s1) OVER (), 0)')} AS population_z FROM macro", dates="month")
def zscore(spark, sf):
    return rounded(X.macro_monthly(spark, sf).select("month", macro.zscore("s1").alias("sample_z"), macro.zscore("s1", True).alias("population_z")))


_Z = lambda c: f"((s{c} - avg(s{c}) OVER ()) / nullif(stddev_pop(s{c}) OVER (), 0))"
_STRESS = f"zz AS (SELECT month, (coalesce({_Z(1)}, 0) - coalesce({_Z(2)}, 0) + coalesce({_Z(3)}, 0)) / nullif((s1 IS NOT NULL)::INT + (s2 IS NOT NULL)::INT + (s3 IS NOT NULL)::INT, 0) AS stress FROM macro)"


def _stress(spark, sf):
    return macro.composite(X.macro_monthly(spark, sf), {"s1": 1, "s2": -1, "s3": 1}, "stress").select("month", "stress")


@query("stress_of_three", f"WITH {X.MACRO_SQL}, {_STRESS} SELECT month, {r6('stress')} AS stress, {r6('-stress')} AS improvement FROM zz", dates="month")
def stress_of_three(spark, sf):
    return rounded(_stress(spark, sf).withColumn("improvement", -F.col("stress")))


@query("crisis_month", f"WITH {X.MACRO_SQL}, {_STRESS} SELECT month, {r6('stress')} AS stress, CASE WHEN stress >= (SELECT quantile_cont(stress, 0.75) FROM zz) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS crisis FROM zz", dates="month")
def crisis_month(spark, sf):
    return rounded(macro.crisis(_stress(spark, sf), "stress"))


@query("series_catalog", f"WITH {X.MACRO_SQL} " + " UNION ALL ".join(f"SELECT '{c}' AS series, count({c}) AS observations, strftime(min(month) FILTER (WHERE {c} IS NOT NULL), '%Y-%m-%d') AS first_key, strftime(max(month) FILTER (WHERE {c} IS NOT NULL), '%Y-%m-%d') AS last_key FROM macro" for c in S))
def series_catalog(spark, sf):
    return macro.series_catalog(X.macro_monthly(spark, sf), "month", S)


# networks: long values are the signed agenda features of party and concept per year
_LONG = f"""s AS (SELECT year, party, concept, sum(mention_count) AS n, {bal('sum(pos)', 'sum(neg)')} AS b FROM m GROUP BY ALL), lo AS (SELECT year, party, concept, b * (n / sum(n) OVER (PARTITION BY year, party)::DOUBLE) AS value FROM s)"""
_ZL = "zs AS (SELECT *, coalesce((value - avg(value) OVER w) / CASE WHEN coalesce(stddev_samp(value) OVER w, 0) = 0 THEN 1 ELSE stddev_samp(value) OVER w END, 0) AS z FROM lo WINDOW w AS (PARTITION BY year, concept))"
_COS = lambda v, t: f"nm AS (SELECT year, party, sqrt(sum({v} * {v})) AS nn FROM {t} GROUP BY ALL), uu AS (SELECT year, party, concept, CASE WHEN nn > 0 THEN {v} / nn ELSE 0 END AS u FROM {t} JOIN nm USING (year, party)), pr AS (SELECT x.year, x.party AS a, y.party AS b, sum(x.u * y.u) AS w FROM uu x JOIN uu y ON x.year = y.year AND x.concept = y.concept AND x.party < y.party GROUP BY ALL)"


def _long(spark, sf, nation=False, m=None):
    f = panels.signed_agenda_feature(X.mentions(spark, sf, nation) if m is None else m, ["year", "party", "concept"])
    return f.select("year", "party", "concept", F.col("feature").alias("value"))


@query("cosine_projection", X.with_m(f"{_LONG}, {_COS('value', 'lo')} SELECT year, a, b, {r6('w')} AS w FROM pr"))
def cosine_projection(spark, sf):
    return rounded(graphs.cosine_edges(_long(spark, sf), ["year"], "party", "value"))


@query("graph_edges", X.with_m(f"{_LONG}, {_COS('value', 'lo')} SELECT year, a, b, {r6('w')} AS w, {r6('1 / w')} AS distance FROM pr WHERE w > 0"))
def graph_edges(spark, sf):
    return rounded(graphs.weighted_edges(graphs.cosine_edges(_long(spark, sf), ["year"], "party", "value")))


@query("signed_affinity", X.with_m(f"{_LONG}, {_ZL}, {_COS('z', 'zs')} SELECT year, a, b, {r6('w')} AS w FROM pr"))
def signed_affinity(spark, sf):
    return rounded(graphs.signed_affinity(_long(spark, sf), ["year"], "party", "value"))


@query("affinity_summaries", X.with_m(f"{_LONG}, {_ZL}, {_COS('z', 'zs')} SELECT year, {r6('sum(greatest(-w, 0)) / nullif(sum(abs(w)), 0)')} AS negative_share, {r6('avg(abs(w))')} AS mean_absolute, {r6('avg(greatest(-w, 0))')} AS mean_negative FROM pr GROUP BY year"))
def affinity_summaries(spark, sf):
    return rounded(graphs.affinity_summary(graphs.signed_affinity(_long(spark, sf), ["year"], "party", "value"), ["year"]))


@query("density", X.with_m(f"{_LONG}, {_COS('value', 'lo')} SELECT year, 5::BIGINT AS nodes, count(*) FILTER (WHERE w > 0) AS edges, {r6('2.0::DOUBLE * count(*) FILTER (WHERE w > 0) / 20')} AS density FROM pr GROUP BY year"))
def density(spark, sf):
    lo = _long(spark, sf)
    e = graphs.weighted_edges(graphs.cosine_edges(lo, ["year"], "party", "value"))
    return rounded(graphs.density(e, lo.select("year", "party").distinct(), ["year"]).select("year", "nodes", "edges", "density"))


@query("bloc_assortativity", X.with_m(f"""{_LONG}, {_COS('value', 'lo')}, ed AS (SELECT year, a IN ('BUILDING', 'MACHINERY') AS x, b IN ('BUILDING', 'MACHINERY') AS y FROM pr WHERE w > 0), bo AS (SELECT * FROM ed UNION ALL SELECT year, y, x FROM ed),
  tt AS (SELECT year, count(*) AS n, count(*) FILTER (WHERE x = y) AS same, count(*) FILTER (WHERE x) AS k1, count(*) FILTER (WHERE NOT x) AS k0 FROM bo GROUP BY 1)
  SELECT year, {r6('(same / n::DOUBLE - (k1 * k1 + k0 * k0) / (n * n)::DOUBLE) / nullif(1 - (k1 * k1 + k0 * k0) / (n * n)::DOUBLE, 0)')} AS assortativity FROM tt"""))
def bloc_assortativity(spark, sf):
    e = graphs.weighted_edges(graphs.cosine_edges(_long(spark, sf), ["year"], "party", "value"))
    return rounded(graphs.assortativity(e, ["year"], F.col("a").isin(X.GOVERNMENT), F.col("b").isin(X.GOVERNMENT)))


def _knn(spark, sf, long=None):
    return graphs.weighted_edges(graphs.signed_knn(graphs.signed_affinity(_long(spark, sf, True) if long is None else long, ["year"], "party", "value"), ["year"]))


_KNN = "en AS (SELECT year, a, b, w FROM pr UNION ALL SELECT year, b, a, w FROM pr), rk AS (SELECT *, row_number() OVER (PARTITION BY year, a, sign(w) ORDER BY round(abs(w), 12) DESC, b) AS k FROM en WHERE w <> 0), kn AS (SELECT year, least(a, b) AS a, greatest(a, b) AS b, sum(w) / 2 AS w FROM rk WHERE k <= 8 GROUP BY ALL)"


# the graph of speakers (customers) per year: dense rows of the active ones over all concepts
_SPEAKERS = f"""tt AS (SELECT year, speaker::VARCHAR AS party, sum(mention_count) AS n FROM m GROUP BY ALL), tc AS (SELECT year, greatest(8.0, quantile_cont(n, 0.4)) AS c FROM tt GROUP BY 1), ac AS (SELECT year, party FROM tt JOIN tc USING (year) WHERE n >= c),
  s AS (SELECT year, speaker::VARCHAR AS party, concept, sum(mention_count) AS n, {bal('sum(pos)', 'sum(neg)')} AS b FROM m GROUP BY ALL), sl AS (SELECT year, party, concept, b * (n / sum(n) OVER (PARTITION BY year, party)::DOUBLE) AS value FROM s),
  lo AS (SELECT year, ac.party, c.concept, coalesce(sl.value, 0) AS value FROM ac JOIN (SELECT DISTINCT year, concept FROM sl JOIN ac USING (year, party)) c USING (year) LEFT JOIN sl USING (year, party, concept))"""
_SPEAKER_KNN = f"{_SPEAKERS}, {_ZL}, {_COS('z', 'zs')}, {_KNN.replace('rk AS', 'rk AS MATERIALIZED').replace('kn AS', 'kn AS MATERIALIZED')}"


def _speaker_values(m, keys, tasks=None):
    """Signed agenda features of the active speakers of each graph."""
    return speaker_graph.active_values(m.withColumn("speaker", F.col("speaker").cast("string")), keys, "speaker", tasks=tasks)


@query("signed_knn_graph", X.with_m(f"{_SPEAKER_KNN} SELECT year, a, b, {r6('w')} AS w FROM kn"))
def signed_knn_graph(spark, sf):
    vectors = speaker_graph.unit_vectors(_speaker_values(X.mentions(spark, sf), ["year"], X.tasks(spark, sf)), ["year"], "speaker", "value")
    return rounded(speaker_graph.signed_knn(vectors, ["year"], "speaker"))


_GATE = """ee AS (SELECT year, a, b, w FROM kn UNION ALL SELECT year, b, a, w FROM kn),
  rr AS (SELECT e.year, e.a AS party, sum(CASE WHEN side = 1 THEN abs(w) ELSE 0 END) AS rp, sum(CASE WHEN side = -1 THEN abs(w) ELSE 0 END) AS rm, sum(CASE WHEN side = 1 AND w < 0 THEN -w ELSE 0 END) AS np, sum(CASE WHEN side = -1 AND w < 0 THEN -w ELSE 0 END) AS nm FROM ee e JOIN sd ON e.year = sd.year AND e.b = sd.party GROUP BY ALL),
  gk AS (SELECT year, party, side, least(rp, rm) / (rp + rm + 1e-9) AS balance, ln(1 + 25 * (rp + rm)) * (least(rp, rm) / (rp + rm + 1e-9)) * CASE WHEN side = 0 THEN 1.15 ELSE 1 END AS gatekeeper_score, ln(1 + 25 * (np + nm)) * (least(np, nm) / (np + nm + 1e-9)) AS cross_pressure FROM rr JOIN sd USING (year, party))"""


def _gatekeepers(spark, sf):
    return speaker_graph.gatekeepers(_speaker_values(X.mentions(spark, sf), ["year"], X.tasks(spark, sf)), ["year"], "speaker", "value").withColumnRenamed("node", "speaker")


@query("directed_edges", f"WITH {X.DIRECTED_SQL} SELECT source, target, count(DISTINCT speech_id) AS speeches, {r6('sum(total)')} AS total, {r6('sum(positive)')} AS positive, {r6('sum(negative)')} AS negative FROM directed GROUP BY ALL")
def directed_edges(spark, sf):
    return rounded(graphs.directed_edges(X.directed(spark, sf)))


@query("weighted_degree", f"WITH {X.DIRECTED_SQL}, o AS (SELECT source AS node, sum(total) AS out_strength FROM directed GROUP BY 1), i AS (SELECT target AS node, sum(total) AS in_strength FROM directed GROUP BY 1) SELECT node, {r6('coalesce(out_strength, 0)')} AS out_strength, {r6('coalesce(in_strength, 0)')} AS in_strength, {r6('coalesce(out_strength, 0) + coalesce(in_strength, 0)')} AS strength FROM o FULL JOIN i USING (node)")
def weighted_degree(spark, sf):
    return rounded(graphs.strengths(graphs.directed_edges(X.directed(spark, sf)), [], "total"))


@query("reciprocity", f"WITH {X.DIRECTED_SQL}, e AS (SELECT year, source, target, sum(total) AS w FROM directed GROUP BY ALL) SELECT a.year, {r6('coalesce(sum(CASE WHEN a.source < a.target AND b.w IS NOT NULL THEN least(a.w, b.w) END), 0) / sum(a.w)')} AS weighted, {r6('avg(CASE WHEN b.w IS NOT NULL THEN 1.0 ELSE 0.0 END)')} AS binary FROM e a LEFT JOIN e b ON a.year = b.year AND a.source = b.target AND a.target = b.source GROUP BY a.year")
def reciprocity(spark, sf):
    return rounded(graphs.reciprocity(graphs.directed_edges(X.directed(spark, sf), ["year"]), ["year"], "total"))


_NATIONS = [f"N{i}" for i in range(25)]


@query("interaction_matrix", f"WITH {X.DIRECTED_SQL} SELECT source, " + ", ".join(f"coalesce(sum(CASE WHEN target = '{n}' THEN total END), 0.0) AS {n}" for n in _NATIONS) + " FROM directed GROUP BY source")
def interaction_matrix(spark, sf):
    e = graphs.directed_edges(X.directed(spark, sf))
    return e.groupBy("source").pivot("target", _NATIONS).agg(F.sum("total")).na.fill(0.0)


@query("strongest_negative_edge", f"WITH {X.DIRECTED_SQL}, e AS (SELECT year, source, target, sum(negative) AS w FROM directed GROUP BY ALL) SELECT year, arg_max(source, (w, source, target)) AS source, arg_max(target, (w, source, target)) AS target, {r6('max(w)')} AS negative, {r6('max(w) / sum(w)')} AS share FROM e GROUP BY year")
def strongest_negative_edge(spark, sf):
    e = graphs.directed_edges(X.directed(spark, sf), ["year"])
    t = e.groupBy("year").agg(F.max(F.struct("negative", "source", "target")).alias("t"), F.sum("negative").alias("all"))
    return rounded(t.select("year", "t.source", "t.target", "t.negative", (F.col("t.negative") / F.col("all")).alias("share")))


_RANKS = ", ".join(f"r{i + 1} AS MATERIALIZED (SELECT node, 0.15::DOUBLE / n + 0.85::DOUBLE * (coalesce((SELECT sum(r.rank * s.p) FROM st s JOIN r{i} r ON r.node = s.source WHERE s.target = nd.node), 0) + (SELECT coalesce(sum(rank), 0) FROM r{i} WHERE node NOT IN (SELECT source FROM st)) / n) AS rank FROM nd)" for i in range(20))


@query("pagerank", f"WITH {X.DIRECTED_SQL}, e AS (SELECT source, target, sum(total) AS w FROM directed GROUP BY ALL), st AS MATERIALIZED (SELECT source, target, w / sum(w) OVER (PARTITION BY source) AS p FROM e), n0 AS (SELECT source AS node FROM e UNION SELECT target FROM e), nd AS MATERIALIZED (SELECT node, (SELECT count(*) FROM n0) AS n FROM n0), r0 AS (SELECT node, 1.0::DOUBLE / n AS rank FROM nd), {_RANKS} SELECT node, {r6('rank')} AS rank FROM r20")
def pagerank(spark, sf):
    e = graphs.directed_edges(X.directed(spark, sf)).withColumn("graph", F.lit(1))
    nodes = e.select("graph", F.explode(F.array("source", "target")).alias("node")).distinct()
    return rounded(paths.pagerank(e, nodes, ["graph"], "total", 20).select("node", "rank"))


# axis
_ZA = "za AS (SELECT *, coalesce((value - avg(value) OVER w) / CASE WHEN coalesce(stddev_samp(value) OVER w, 0) = 0 THEN 1 ELSE stddev_samp(value) OVER w END, 0) AS z FROM lo WINDOW w AS (PARTITION BY concept))"
_W = f"mz AS (SELECT party, concept, avg(z) AS z FROM za GROUP BY ALL), {X.ANCHORS_SQL}, w0 AS (SELECT concept, CASE WHEN stddev_pop(z) = 0 THEN 0 ELSE corr(z, anchor) END AS w FROM mz JOIN anchors USING (party) GROUP BY concept), ww AS (SELECT concept, w / sqrt(sum(w * w) OVER ()) AS w FROM w0)"
_P = "ps AS (SELECT year, party, sum(z * w) AS position FROM za JOIN ww USING (concept) GROUP BY ALL)"
_AXIS = f"{_LONG}, {_ZA}, {_W}, {_P}"


def _z(spark, sf):
    """Standardised over all rows (year, party), as the axis is one for all years."""
    return graphs.zscores(_long(spark, sf), [])


def _positions(spark, sf):
    z = _z(spark, sf)
    return axis.positions(z, axis.anchor_weights(z, X.anchors(spark)), ["year"])


@query("anchor_weights", X.with_m(f"{_AXIS} SELECT concept, {r6('w')} AS w FROM ww"))
def anchor_weights(spark, sf):
    return rounded(axis.anchor_weights(_z(spark, sf), X.anchors(spark)))


@query("axis_positions", X.with_m(f"{_AXIS} SELECT year, party, {r6('position')} AS position FROM ps"))
def axis_positions(spark, sf):
    return rounded(_positions(spark, sf))


@query("spread_and_gap", X.with_m(f"{_AXIS} SELECT year, {r6('max(position) - min(position)')} AS spread, {r6('stddev_samp(position)')} AS deviation, {r6('min(position)')} AS lowest, {r6('max(position)')} AS highest, {r6('''max(CASE WHEN party = 'BUILDING' THEN position END) - max(CASE WHEN party = 'AUTOMOBILE' THEN position END)''')} AS gap FROM ps GROUP BY year"))
def spread_and_gap(spark, sf):
    p = _positions(spark, sf)
    return rounded(axis.spread(p, ["year"]).join(axis.gap(p, ["year"], "BUILDING", "AUTOMOBILE").drop("distance"), "year"))


@query("position_spread", X.with_m(f"{_AXIS} SELECT year, {r6('max(position) - min(position)')} AS spread FROM ps GROUP BY year"))
def position_spread(spark, sf):
    return rounded(axis.spread(_positions(spark, sf), ["year"]).select("year", "spread"))


@query("net_shift", X.with_m(f"{_AXIS} SELECT party, {r6('arg_max(position, year) - arg_min(position, year)')} AS net_shift FROM ps GROUP BY party"))
def net_shift(spark, sf):
    return rounded(axis.net_shift(_positions(spark, sf), "year"))


@query("interval_summary", X.with_m(f"{_AXIS} SELECT party, {r6('median(position)')} AS center, {r6('min(position)')} AS left_end, {r6('max(position)')} AS right_end, count(*) AS years FROM ps GROUP BY party"))
def interval_summary(spark, sf):
    return rounded(axis.intervals(_positions(spark, sf)))


@query("drift_summary", X.with_m(f"{_AXIS} SELECT party, min(year) AS first_term, max(year) AS last_term, {r6('arg_min(position, year)')} AS first_center, {r6('arg_max(position, year)')} AS last_center, {r6('arg_max(position, year) - arg_min(position, year)')} AS net_drift, {r6('avg(position)')} AS mean_center, {r6('stddev_pop(position)')} AS std_center, {r6('min(position)')} AS min_center, {r6('max(position)')} AS max_center FROM ps GROUP BY party"))
def drift_summary(spark, sf):
    return rounded(axis.drift(_positions(spark, sf), "year"))


@query("axis_loo", X.with_m(f"""{_AXIS}, fp AS (SELECT party, sum(z * w) AS f FROM za JOIN ww USING (concept) GROUP BY 1), wl AS (SELECT l.party AS left_out, concept, corr(z, k.anchor) AS w FROM mz JOIN anchors k USING (party) JOIN anchors l ON l.party <> mz.party GROUP BY ALL),
  wn AS (SELECT left_out, concept, w / sqrt(sum(w * w) OVER (PARTITION BY left_out)) AS w FROM wl), pl AS (SELECT left_out, party, sum(z * w) AS p FROM za JOIN wn USING (concept) GROUP BY ALL) SELECT left_out, {r6('corr(p, f)')} AS r FROM pl JOIN fp USING (party) GROUP BY left_out"""))
def axis_loo(spark, sf):
    return rounded(axis.leave_one_out(_z(spark, sf), X.anchors(spark)))


@query("side_partition", X.with_m(f"{_AXIS}, q AS (SELECT *, min(position) OVER w AS lo, max(position) OVER w AS hi, median(position) OVER w AS md FROM ps WINDOW w AS (PARTITION BY year)) SELECT year, party, CASE WHEN position >= CASE WHEN lo >= 0 OR hi <= 0 THEN md ELSE 0 END THEN 1 ELSE -1 END AS side FROM q"))
def side_partition(spark, sf):
    return graphs.sides(_positions(spark, sf), ["year"], "party", "position")


_MOD = lambda s: f"""SELECT e.year, coalesce(sum(CASE WHEN x.side = y.side THEN greatest({s} * w, 0) ELSE 0 END) / nullif(sum(greatest({s} * w, 0)), 0), 0) - coalesce((SELECT sum(ks * ks) FROM (SELECT sum(greatest({s} * f.w, 0)) AS ks FROM en f JOIN si z ON z.year = f.year AND z.party = f.a WHERE f.year = e.year GROUP BY z.side)) / nullif(pow(sum(greatest({s} * w, 0)), 2), 0), 0) AS q FROM en e JOIN si x ON x.year = e.year AND x.party = e.a JOIN si y ON y.year = e.year AND y.party = e.b GROUP BY e.year"""


@query("signed_modularity", X.with_m(f"""{_AXIS}, {_ZL}, {_COS('z', 'zs')}, en AS (SELECT year, a, b, w FROM pr UNION ALL SELECT year, b, a, w FROM pr), q0 AS (SELECT *, min(position) OVER w AS lo, max(position) OVER w AS hi, median(position) OVER w AS md FROM ps WINDOW w AS (PARTITION BY year)),
  si AS (SELECT year, party, CASE WHEN position >= CASE WHEN lo >= 0 OR hi <= 0 THEN md ELSE 0 END THEN 1 ELSE -1 END AS side FROM q0), qp AS ({_MOD('1')}), qm AS ({_MOD('-1')}) SELECT year, {r6('qp.q - qm.q')} AS modularity FROM qp JOIN qm USING (year)"""))
def signed_modularity(spark, sf):
    pairs = graphs.signed_affinity(_long(spark, sf), ["year"], "party", "value")
    side = graphs.sides(_positions(spark, sf), ["year"], "party", "position")
    return rounded(graphs.signed_modularity(pairs, side, ["year"], "party"))


# events
_PANEL = "pn AS (SELECT month, " + ", ".join(f"sum(CASE WHEN category = '{c}' THEN mention_count ELSE 0 END) / sum(mention_count)::DOUBLE AS {c[:5]}" for c in X.CATEGORIES) + " FROM m GROUP BY month)"
_V = [c[:5] for c in X.CATEGORIES]
_MEANS = "sm AS (SELECT event, event_month, " + ", ".join(f"avg(CASE WHEN stage = '{s}' THEN {v} END) AS {v}_{s}" for v in _V for s in ("pre", "shock", "post")) + " FROM st LEFT JOIN pn USING (month) GROUP BY ALL)"


def _panel(spark, sf):
    s = panels.period_shares(X.mentions(spark, sf), ["month"], ["category"])
    wide = panels.series_wide(s, "month", "category", "agenda_share", X.CATEGORIES)
    return wide.select("month", *[F.col(c).alias(c[:5]) for c in X.CATEGORIES])


def _stage_means(spark, sf):
    return events.stage_means(_panel(spark, sf), _events(spark, sf).select("event", "event_month"), _V)


@query("stage_metrics", X.with_m(f"{_RESOLVED}, {_STAGES}, {_PANEL}, {_MEANS} SELECT event, event_month, " + ", ".join(f"{r6(f'{v}_{s}')} AS {v}_{s}" for v in _V for s in ("pre", "shock", "post")) + ", " + ", ".join(f"{r6(f'{v}_{s} - {v}_pre')} AS {v}_delta_{s}" for v in _V for s in ("shock", "post")) + " FROM sm"), dates="event_month")
def stage_metrics(spark, sf):
    return rounded(_stage_means(spark, sf))


_DISP = lambda s: f"(greatest(const_{s} - const_pre, 0) + greatest(secur_{s} - secur_pre, 0) - (macro_{s} - macro_pre))"


@query("displacement", X.with_m(f"{_RESOLVED}, {_STAGES}, {_PANEL}, {_MEANS} SELECT event, {r6(_DISP('shock'))} AS displacement_shock, {r6(_DISP('post'))} AS displacement_post, coalesce({_DISP('shock')} > 0 AND {_DISP('post')} > 0, false) AS persists FROM sm"))
def displacement(spark, sf):
    d = events.displacement(_stage_means(spark, sf), ["const", "secur"], "macro")
    # greatest() skips a null gain on both sides
    return rounded(d.select("event", "displacement_shock", "displacement_post", "persists"))


@query("placebo_null", X.with_m(f"""{_RESOLVED}, {_ELIGIBLE}, {_PANEL}, am AS (SELECT DISTINCT event_month AS atm FROM ev UNION SELECT month FROM el),
  ch AS (SELECT atm, max(CASE WHEN pn.month = atm THEN macro END) - avg(CASE WHEN pn.month < atm THEN macro END) AS change FROM am LEFT JOIN pn ON pn.month BETWEEN atm - INTERVAL 3 MONTH AND atm GROUP BY atm)
  SELECT event, {r6('any_value(o.change)')} AS observed, count(*) AS null_draws, {r6('avg(n.change)')} AS null_mean, {r6('stddev_pop(n.change)')} AS null_std, {r6('avg(CASE WHEN abs(n.change) >= abs(o.change) THEN 1.0 ELSE 0.0 END)')} AS null_p,
  {r6('(any_value(o.change) - avg(n.change)) / nullif(stddev_pop(n.change), 0)')} AS z FROM ev JOIN ch o ON o.atm = event_month JOIN el ON el.month <> event_month JOIN ch n ON n.atm = el.month GROUP BY event"""))
def placebo_null(spark, sf):
    p = events.placebo(_panel(spark, sf), _events(spark, sf).select("event", "event_month"), joins.eligible_months(_months(spark, sf)), "macro")
    return rounded(p.drop("event_month"))


@query("rate_ratio_test", X.with_m(f"""{_RESOLVED}, {_STAGES}, c AS (SELECT month, sum(neg) AS neg, sum(mention_count) AS n FROM m GROUP BY 1),
  q AS (SELECT event, sum(CASE WHEN stage = 'pre' THEN neg ELSE 0 END)::DOUBLE AS c1, sum(CASE WHEN stage = 'pre' THEN n ELSE 0 END)::DOUBLE AS e1, sum(CASE WHEN stage = 'post' THEN neg ELSE 0 END)::DOUBLE AS c2, sum(CASE WHEN stage = 'post' THEN n ELSE 0 END)::DOUBLE AS e2 FROM st JOIN c USING (month) GROUP BY event)
  SELECT event, c1 > 0 AND c2 > 0 AS ok, {r6('CASE WHEN c1 > 0 AND c2 > 0 THEN (c2 / e2) / (c1 / e1) END')} AS ratio, {r6('CASE WHEN c1 > 0 AND c2 > 0 THEN ln((c2 / e2) / (c1 / e1)) / sqrt(1 / c1 + 1 / c2) END')} AS z FROM q"""))
def rate_ratio_test(spark, sf):
    c = X.mentions(spark, sf).groupBy("month").agg(F.sum("neg").alias("neg"), F.sum("mention_count").alias("n"))
    rows = joins.stage_windows(_events(spark, sf)).join(c, "month")
    return rounded(events.rate_ratio(rows, ["event"], "neg", "n").select("event", "ok", "ratio", "z"))


# statistics
@query("ols", f"WITH {X.MACRO_SQL} SELECT CAST(year(month) AS INTEGER) AS year, {r6('regr_slope(s1, s2)')} AS slope, {r6('regr_r2(s1, s2)')} AS r2, {r6('1 - (1 - regr_r2(s1, s2)) * (regr_count(s1, s2) - 1) / nullif(regr_count(s1, s2) - 2, 0)')} AS adjusted_r2 FROM macro GROUP BY 1")
def ols(spark, sf):
    return rounded(stats.ols(X.macro_monthly(spark, sf).withColumn("year", F.year("month")), ["year"], "s1", "s2").select("year", "slope", "r2", "adjusted_r2"))


@query("correlation_table", f"""WITH {X.MACRO_SQL}, lg AS ({' UNION ALL '.join(f"SELECT month, '{c}' AS name, {c} AS v FROM macro WHERE {c} IS NOT NULL" for c in S)}), b AS (SELECT a.name AS a, b.name AS b, a.v AS x, b.v AS y FROM lg a JOIN lg b ON a.month = b.month AND a.name < b.name),
  r AS (SELECT a, b, x, y, rank() OVER (PARTITION BY a, b ORDER BY x) + (count(*) OVER (PARTITION BY a, b, x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (PARTITION BY a, b ORDER BY y) + (count(*) OVER (PARTITION BY a, b, y) - 1) / 2.0::DOUBLE AS ry FROM b)
  SELECT a, b, count(*) AS n, {r6('corr(x, y)')} AS pearson, {r6('corr(rx, ry)')} AS spearman FROM r GROUP BY ALL HAVING count(*) >= 8""")
def correlation_table(spark, sf):
    return rounded(stats.correlations(X.macro_monthly(spark, sf), "month", S))


@query("mann_kendall", f"WITH {X.MACRO_SQL}, k AS (SELECT sum(sign(b.s1 - a.s1)) AS s FROM macro a JOIN macro b ON a.month < b.month), n AS (SELECT count(*) AS n FROM macro) SELECT s::DOUBLE AS s, n, {r6('CASE WHEN s > 0 THEN (s - 1) / sqrt(n * (n - 1) * (2 * n + 5) / 18.0::DOUBLE) WHEN s < 0 THEN (s + 1) / sqrt(n * (n - 1) * (2 * n + 5) / 18.0::DOUBLE) ELSE 0 END')} AS z FROM k, n")
def mann_kendall(spark, sf):
    return rounded(stats.mann_kendall(X.macro_monthly(spark, sf).withColumn("k", F.lit(1)), ["k"], "month", "s1").select("s", "n", "z"))


_TWO = X.with_m(f"""g AS (SELECT year, concept, {X.BLOC_SQL} AS bloc, avg(score) AS v FROM m GROUP BY ALL), q AS (SELECT concept, count(v) FILTER (WHERE bloc = 'government') AS n1, count(v) FILTER (WHERE bloc = 'opposition') AS n2, avg(v) FILTER (WHERE bloc = 'government') AS m1, avg(v) FILTER (WHERE bloc = 'opposition') AS m2, var_samp(v) FILTER (WHERE bloc = 'government') AS v1, var_samp(v) FILTER (WHERE bloc = 'opposition') AS v2 FROM g GROUP BY 1),
  p AS (SELECT *, ((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) AS pv FROM q) SELECT concept, n1, n2, {r6('m1')} AS m1, {r6('m2')} AS m2, {r6('m2 - m1')} AS difference, {r6('(m2 - m1) / sqrt(pv * (1.0::DOUBLE / n1 + 1.0::DOUBLE / n2))')} AS student_t, {r6('(m2 - m1) / sqrt(v1 / n1 + v2 / n2)')} AS welch_t, {r6('(m2 - m1) / sqrt(pv) * (1 - 3 / (4 * (n1 + n2) - 9)::DOUBLE)')} AS hedges_g FROM p""")


@query("two_sample_t", _TWO)
def two_sample_t(spark, sf):
    m = X.mentions(spark, sf).withColumn("bloc", X.bloc(F.col("party"))).groupBy("year", "concept", "bloc").agg(F.avg("score").alias("v"))
    return rounded(stats.two_sample(m, ["concept"], "bloc", "government", "opposition", "v"))


@query("rank_sum", X.with_m(f"""g AS (SELECT year, concept, {X.BLOC_SQL} AS bloc, sum(mention_count) AS v FROM m GROUP BY ALL), r AS (SELECT *, rank() OVER (PARTITION BY concept ORDER BY v) + (count(*) OVER (PARTITION BY concept, v) - 1) / 2.0::DOUBLE AS k FROM g) SELECT concept, count(*) FILTER (WHERE bloc = 'government') AS n1, count(*) FILTER (WHERE bloc <> 'government') AS n2, {r6('''sum(CASE WHEN bloc = 'government' THEN k END) - count(*) FILTER (WHERE bloc = 'government') * (count(*) FILTER (WHERE bloc = 'government') + 1) / 2.0::DOUBLE''')} AS u FROM r GROUP BY 1"""))
def rank_sum(spark, sf):
    m = X.mentions(spark, sf).withColumn("bloc", X.bloc(F.col("party"))).groupBy("year", "concept", "bloc").agg(F.sum("mention_count").alias("v"))
    return rounded(stats.rank_sum(m, ["concept"], "bloc", "government", "v"))


_GOLD = "gd AS (SELECT quality AS truth, CASE WHEN n_chars > 600 THEN 1 ELSE 0 END AS prediction FROM labels JOIN documents USING (doc_id)), cf AS (SELECT truth, prediction, count(*) AS n FROM gd GROUP BY ALL)"


def _confusion(spark, sf):
    g = X.table(spark, sf, "labels").join(X.table(spark, sf, "documents"), "doc_id").select(F.col("quality").alias("truth"), F.when(F.col("n_chars") > 600, 1).otherwise(0).alias("prediction"))
    return stats.confusion(g, "truth", "prediction")


@query("confusion_matrix", f"WITH {_GOLD} SELECT truth, prediction, n, {r6('n / sum(n) OVER (PARTITION BY truth)::DOUBLE')} AS share FROM cf")
def confusion_matrix(spark, sf):
    return rounded(_confusion(spark, sf))


_CLASS = "lb AS (SELECT unnest([0, 1]) AS label), cm AS (SELECT label, coalesce((SELECT sum(n) FROM cf WHERE truth = label), 0)::BIGINT AS support, coalesce((SELECT sum(n) FROM cf WHERE prediction = label), 0)::BIGINT AS predicted, coalesce((SELECT sum(n) FROM cf WHERE truth = label AND prediction = label), 0)::BIGINT AS hit FROM lb), ck AS (SELECT *, coalesce(hit / nullif(predicted, 0)::DOUBLE, 0) AS p, coalesce(hit / nullif(support, 0)::DOUBLE, 0) AS r FROM cm), cl AS (SELECT *, coalesce(2 * p * r / nullif(p + r, 0), 0) AS f1 FROM ck)"


@query("classification_metrics", f"WITH {_GOLD}, {_CLASS}, o AS (SELECT sum(hit) / sum(support)::DOUBLE AS a, avg(f1) AS macro, sum(f1 * support) / sum(support) AS wf, sum(support * predicted) / pow(sum(support), 2) AS e FROM cl) SELECT {r6('a')} AS accuracy, {r6('macro')} AS macro_f1, {r6('wf')} AS weighted_f1, {r6('(a - e) / nullif(1 - e, 0)')} AS kappa FROM o")
def classification_metrics(spark, sf):
    return rounded(stats.overall_metrics(_confusion(spark, sf)))


@query("class_metrics", f"WITH {_GOLD}, {_CLASS} SELECT label, support, predicted, hit, {r6('p')} AS precision, {r6('r')} AS recall, {r6('f1')} AS f1 FROM cl")
def class_metrics(spark, sf):
    return rounded(stats.class_metrics(_confusion(spark, sf)))


_RATERS = ", ".join(f"CASE WHEN n_chars > {k} THEN 'long' ELSE 'short' END AS r{i}" for i, k in enumerate((400, 800, 1000, 1500, 3000)))


def _raters(spark, sf):
    return X.table(spark, sf, "documents").select("doc_id", *[F.when(F.col("n_chars") > k, "long").otherwise("short").alias(f"r{i}") for i, k in enumerate((400, 800, 1000, 1500, 3000))])


_VOTES = f"rt AS (SELECT doc_id, {_RATERS} FROM documents), ln AS (UNPIVOT rt ON r0, r1, r2, r3, r4 INTO NAME rater VALUE label), vt AS (SELECT doc_id, label, count(*) AS n FROM ln GROUP BY ALL)"


@query("fleiss_kappa", f"WITH {_VOTES}, pi AS (SELECT doc_id, (sum(n * n) - 5) / 20.0::DOUBLE AS p, max(n) = 5 AS f FROM vt GROUP BY 1), t AS (SELECT avg(p) AS p, avg(CASE WHEN f THEN 1.0 ELSE 0.0 END) AS fa, count(*) AS items FROM pi), e AS (SELECT sum(pow(n / (items * 5)::DOUBLE, 2)) AS e FROM (SELECT label, sum(n) AS n FROM vt GROUP BY 1), t) SELECT {r6('(p - e) / nullif(1 - e, 0)')} AS kappa, {r6('fa')} AS full_agreement, items FROM t, e")
def fleiss_kappa(spark, sf):
    return rounded(stats.fleiss_kappa(_raters(spark, sf), "doc_id", [f"r{i}" for i in range(5)]))


@query("majority_vote", f"WITH {_VOTES}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, label) AS k FROM vt) SELECT doc_id, label FROM r WHERE k = 1")
def majority_vote(spark, sf):
    return stats.majority(_raters(spark, sf), "doc_id", [f"r{i}" for i in range(5)])


# between terms
@query("topic_redistribution", X.with_m(f"s AS (SELECT year, concept, sum(mention_count) AS n FROM m GROUP BY ALL), p AS (SELECT year, concept, n / sum(n) OVER (PARTITION BY year)::DOUBLE AS p FROM s) SELECT y AS year, {r6('sum(abs(coalesce(a.p, 0) - coalesce(b.p, 0))) / 2')} AS variation FROM (SELECT DISTINCT year + 1 AS y, c.concept AS k FROM p, (SELECT DISTINCT concept FROM p) c WHERE year + 1 IN (SELECT year FROM p)) g LEFT JOIN p a ON a.year = y AND a.concept = k LEFT JOIN p b ON b.year = y - 1 AND b.concept = k GROUP BY y"))
def topic_redistribution(spark, sf):
    s = X.mentions(spark, sf).groupBy("year", "concept").agg(F.sum("mention_count").alias("n")).withColumn("p", panels.share(F.col("n"), ["year"]))
    now, before = s.select("year", "concept", "p"), s.select((F.col("year") + 1).alias("year"), "concept", F.col("p").alias("q"))
    both = now.join(before, ["year", "concept"], "full").join(s.select("year").distinct(), "year", "left_semi").join(before.select("year").distinct(), "year", "left_semi")
    return rounded(both.groupBy("year").agg((F.sum(F.abs(F.coalesce("p", F.lit(0.0)) - F.coalesce("q", F.lit(0.0)))) / 2).alias("variation")))


@query("affinity_memory", X.with_m(f"{_LONG}, {_ZL}, {_COS('z', 'zs')} SELECT n.year, {r6('corr(n.w, o.w)')} AS memory, {r6('avg(CASE WHEN sign(n.w) <> sign(o.w) THEN 1.0 ELSE 0.0 END)')} AS flips FROM pr n JOIN pr o ON n.year = o.year + 1 AND n.a = o.a AND n.b = o.b GROUP BY n.year"))
def affinity_memory(spark, sf):
    now = graphs.signed_affinity(_long(spark, sf), ["year"], "party", "value")
    old = now.select((F.col("year") + 1).alias("year"), "a", "b", F.col("w").alias("old"))
    rows = now.join(old, ["year", "a", "b"])
    return rounded(rows.groupBy("year").agg(F.corr("w", "old").alias("memory"), F.avg((F.signum("w") != F.signum("old")).cast("double")).alias("flips")))
