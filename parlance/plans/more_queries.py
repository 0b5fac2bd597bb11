"""Registered queries: further panels, directed networks, event tables, models."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.operators import axis, classify, graphs, joins, macro, models, panels, series, stats

from . import fixtures as X
from .registry import query
from .sqlkit import bal, r6, rounded
from .study_queries import _AXIS, _MONTHS, _RESOLVED, _STAGES, S, _events, _positions

_D = f"WITH {X.DIRECTED_SQL}"


@query("party_order", f"{_D}, n AS (SELECT source AS node, total AS o, 0.0 AS i FROM directed UNION ALL SELECT target, 0.0, total FROM directed), s AS (SELECT node, sum(o) AS o, sum(i) AS i FROM n GROUP BY 1) SELECT node, row_number() OVER (ORDER BY o DESC, i DESC, node) AS place FROM s")
def party_order(spark, sf):
    s = graphs.strengths(graphs.directed_edges(X.directed(spark, sf)), [], "total")
    ranked = panels.top_in(s, [], [F.desc("out_strength"), F.desc("in_strength"), F.col("node")], 1 << 30, "place")
    return ranked.select("node", F.col("place").cast("bigint").alias("place"))


_CROSS = "(source IN ('N1', 'N2', 'N3')) <> (target IN ('N1', 'N2', 'N3'))"


@query("directed_monthly_shares", f"{_D} SELECT month, {r6('sum(total)')} AS total, {r6('sum(negative)')} AS negative, {r6(f'sum(CASE WHEN {_CROSS} THEN total ELSE 0 END) / sum(total)')} AS cross_share, " + ", ".join(f"{r6(f'''sum(CASE WHEN topic = '{c}' THEN total ELSE 0 END) / sum(total)''')} AS {c.lower()}_share" for c in X.CONCEPTS) + f", {r6('''sum(CASE WHEN source = 'N1' AND target = 'N2' THEN total ELSE 0 END) / sum(total)''')} AS dyad_share, count(DISTINCT (source, target)) AS edges FROM directed GROUP BY month", dates="month")
def directed_monthly_shares(spark, sf):
    d = X.directed(spark, sf)
    near = ["N1", "N2", "N3"]
    part = lambda cond: F.sum(F.when(cond, F.col("total")).otherwise(0.0)) / F.sum("total")
    cross = F.col("source").isin(near) != F.col("target").isin(near)
    return rounded(d.groupBy("month").agg(
        F.sum("total").alias("total"), F.sum("negative").alias("negative"), part(cross).alias("cross_share"), *[part(F.col("topic") == c).alias(f"{c.lower()}_share") for c in X.CONCEPTS],
        part((F.col("source") == "N1") & (F.col("target") == "N2")).alias("dyad_share"), F.countDistinct("source", "target").alias("edges"),
    ))


@query("semantic_distance_years", X.with_m(f"""w AS (SELECT year, {X.BLOC_SQL} AS bloc, party, concept, sum(salience) AS v FROM m GROUP BY ALL), n AS (SELECT year, {X.BLOC_SQL} AS bloc, count(DISTINCT party) AS n FROM m GROUP BY ALL),
  b AS (SELECT w.year, w.bloc, concept, sum(v) / any_value(n.n) AS v FROM w JOIN n ON w.year = n.year AND w.bloc = n.bloc GROUP BY ALL), j AS (SELECT year, concept, max(CASE WHEN bloc = 'government' THEN v ELSE 0 END) AS g, max(CASE WHEN bloc = 'opposition' THEN v ELSE 0 END) AS o FROM b GROUP BY ALL)
  SELECT year, {r6('1 - sum(g * o) / nullif(sqrt(sum(g * g)) * sqrt(sum(o * o)), 0)')} AS distance FROM j GROUP BY year"""))
def semantic_distance_years(spark, sf):
    m = X.mentions(spark, sf).withColumn("bloc", X.bloc(F.col("party")))
    return rounded(graphs.bloc_distance(m, ["year"], "salience"))


_CLOSES = [f"{t}_close" for t in X.TYPES]


@query("monthly_market_panel", f"WITH {X.MARKET_SQL}, mo AS (SELECT CAST(date_trunc('month', date) AS DATE) AS month, count(*) AS days, " + ", ".join(f"{r6(f'avg({c})')} AS {c}_avg, {r6(f'arg_max({c}, date) FILTER (WHERE {c} IS NOT NULL)')} AS {c}_last, {r6(f'CASE WHEN count({c}) >= 2 THEN 100 * (arg_max({c}, date) FILTER (WHERE {c} IS NOT NULL) / nullif(arg_min({c}, date) FILTER (WHERE {c} IS NOT NULL), 0) - 1) END')} AS {c}_return" for c in _CLOSES) + " FROM market GROUP BY 1), rt AS (SELECT CAST(date_trunc('month', ts) AS DATE) AS month, round(max(value), 6) AS rate FROM events GROUP BY 1) SELECT * FROM mo FULL JOIN rt USING (month)", dates="month")
def monthly_market_panel(spark, sf):
    rates = X.table(spark, sf, "events").groupBy(F.trunc(F.to_date("ts"), "MM").alias("month")).agg(F.round(F.max("value"), 6).alias("rate"))
    return rounded(joins.outer_merge([macro.market_months(X.market_daily(spark, sf), _CLOSES), rates], "month"))


@query("annual_panel", f"WITH {X.MACRO_SQL} SELECT CAST(year(month) AS INTEGER) AS year, count(*) AS months, " + ", ".join(f"{r6(f'avg({c})')} AS {c}_avg, {r6(f'arg_max({c}, month) FILTER (WHERE {c} IS NOT NULL)')} AS {c}_last" for c in S) + " FROM macro GROUP BY 1")
def annual_panel(spark, sf):
    p = X.macro_monthly(spark, sf)
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("month")))
    return rounded(p.groupBy(F.year("month").alias("year")).agg(F.count("*").alias("months"), *[x for c in S for x in (F.avg(c).alias(f"{c}_avg"), last(c).alias(f"{c}_last"))]))


@query("term_panel", f"WITH {X.MACRO_SQL}, {X.TERMS_SQL}, y AS (SELECT term, CAST(year(month) AS INTEGER) AS year, avg(s1) AS v, count(*) AS w FROM macro JOIN terms ON month BETWEEN start AND stop GROUP BY ALL) SELECT term, sum(w)::BIGINT AS months, {r6('sum(v * w) FILTER (WHERE v IS NOT NULL) / nullif(sum(w) FILTER (WHERE v IS NOT NULL), 0)')} AS s1_mean FROM y GROUP BY term")
def term_panel(spark, sf):
    p = joins.term_of(X.macro_monthly(spark, sf), X.terms(spark), "month").where("term is not null")
    y = p.groupBy("term", F.year("month").alias("year")).agg(F.avg("s1").alias("v"), F.count("*").alias("w"))
    weight = F.sum(F.when(F.col("v").isNotNull(), F.col("w")))
    return rounded(y.groupBy("term").agg(F.sum("w").alias("months"), (F.sum(F.col("v") * F.col("w")) / F.nullif(weight, F.lit(0))).alias("s1_mean")))


_ZS = lambda c: f"coalesce((c{c} - avg(c{c}) OVER ()) / CASE WHEN coalesce(stddev_samp(c{c}) OVER (), 0) = 0 THEN 1 ELSE stddev_samp(c{c}) OVER () END, 0)"


@query("macro_pressure", f"WITH {X.MACRO_SQL}, ch AS (SELECT month, 100 * (s1 / lag(s1) OVER w - 1) AS c1, 100 * (s2 / lag(s2, 12) OVER w - 1) AS c2, -100 * (s3 / lag(s3) OVER w - 1) AS c3, s4 - lag(s4) OVER w AS c4 FROM macro WINDOW w AS (ORDER BY month)) SELECT month, {r6(f'({_ZS(1)} + {_ZS(2)} + {_ZS(3)} + {_ZS(4)}) / 4')} AS pressure FROM ch", dates="month")
def macro_pressure(spark, sf):
    w = series.ordered("month")
    p = X.macro_monthly(spark, sf).select("month", series.pct_change("s1", w).alias("c1"), series.pct_change("s2", w, 12).alias("c2"), (-series.pct_change("s3", w)).alias("c3"), series.difference("s4", w).alias("c4"))
    return rounded(p.select("month", macro.row_mean([macro.zscore(f"c{i}") for i in range(1, 5)]).alias("pressure")))


@query("lead_pearson", f"WITH {X.MACRO_SQL}, l AS (SELECT s1, lead(s2, 1) OVER w AS l1, lead(s2, 2) OVER w AS l2, lead(s2, 3) OVER w AS l3 FROM macro WINDOW w AS (ORDER BY month)) " + " UNION ALL ".join(f"SELECT {k}::BIGINT AS lead_months, count(*) AS n, {r6(f'corr(s1, l{k})')} AS pearson FROM l WHERE s1 IS NOT NULL AND l{k} IS NOT NULL" for k in (1, 2, 3)))
def lead_pearson(spark, sf):
    p = X.macro_monthly(spark, sf).select("month", "s1", "s2")
    w = series.ordered("month")
    long = p.select("s1", F.lead("s2", 1).over(w).alias("1"), F.lead("s2", 2).over(w).alias("2"), F.lead("s2", 3).over(w).alias("3")).unpivot("s1", ["1", "2", "3"], "lead_months", "v").dropna(subset=["s1", "v"])
    return rounded(long.groupBy(F.col("lead_months").cast("bigint").alias("lead_months")).agg(F.count("*").alias("n"), F.corr("s1", "v").alias("pearson")))


@query("threshold_groups", f"WITH {X.MACRO_SQL}, q AS (SELECT unnest([0.7, 0.75, 0.8])::DOUBLE AS q), c AS (SELECT q, CASE q WHEN 0.7 THEN (SELECT quantile_cont(s1, 0.7) FROM macro) WHEN 0.75 THEN (SELECT quantile_cont(s1, 0.75) FROM macro) ELSE (SELECT quantile_cont(s1, 0.8) FROM macro) END AS cut FROM q) SELECT q AS quantile, count(*) FILTER (WHERE s1 >= cut) AS crisis_months, count(*) FILTER (WHERE s1 < cut) AS other_months, {r6('avg(s2) FILTER (WHERE s1 >= cut)')} AS crisis_mean, {r6('avg(s2) FILTER (WHERE s1 < cut)')} AS other_mean FROM macro, c GROUP BY q")
def threshold_groups(spark, sf):
    p = X.macro_monthly(spark, sf)
    cuts = p.agg(*[F.percentile("s1", F.lit(q)).alias(f"q{round(100 * q)}") for q in (0.7, 0.75, 0.8)], F.lit(1).alias("_k")).unpivot("_k", ["q70", "q75", "q80"], "q", "cut")
    rows = p.crossJoin(F.broadcast(cuts.select((F.substring("q", 2, 2).cast("double") / 100).alias("quantile"), "cut")))  # three rows
    high = F.col("s1") >= F.col("cut")
    low = F.col("s1") < F.col("cut")
    return rounded(rows.groupBy("quantile").agg(F.count_if(high).alias("crisis_months"), F.count_if(low).alias("other_months"), F.avg(F.when(high, F.col("s2"))).alias("crisis_mean"), F.avg(F.when(low, F.col("s2"))).alias("other_mean")))


@query("ownership_panel", X.with_m(f"""{_RESOLVED}, {_STAGES}, g AS (SELECT event, stage, party, sum(mention_count) AS n, {bal('sum(pos)', 'sum(neg)')} AS b FROM st JOIN m USING (month) WHERE category = 'macro_economy' GROUP BY ALL),
  h AS (SELECT *, n / sum(n) OVER (PARTITION BY event, stage)::DOUBLE AS s FROM g) SELECT event, stage, arg_max(party, (n, party)) AS owner, {r6('max(s)')} AS owner_share, {r6('arg_max(b, (n, party))')} AS owner_balance, {r6('sum(s * s)')} AS hhi FROM h GROUP BY ALL"""))
def ownership_panel(spark, sf):
    m = X.mentions(spark, sf).where("category = 'macro_economy'")
    s = panels.sums_by(joins.stage_windows(_events(spark, sf)).select("event", "stage", "month").join(m, "month"), ["event", "stage", "party"])
    s = s.withColumns({"share": panels.share(F.col("mentions"), ["event", "stage"]), "balance": (F.col("pos") - F.col("neg")) / (F.col("pos") + F.col("neg") + 1.0)})
    top = F.max(F.struct("mentions", "party", "share", "balance"))
    out = s.groupBy("event", "stage").agg(top.alias("t"), F.sum(F.col("share") * F.col("share")).alias("hhi"))
    return rounded(out.select("event", "stage", F.col("t.party").alias("owner"), F.col("t.share").alias("owner_share"), F.col("t.balance").alias("owner_balance"), "hhi"))


@query("event_profiles", X.with_m(f"{_RESOLVED}, c AS (SELECT month, sum(mention_count)::BIGINT AS n FROM m GROUP BY 1) SELECT event, month, CAST((year(month) - year(event_month)) * 12 + month(month) - month(event_month) AS INTEGER) AS relative, n FROM ev JOIN c ON month BETWEEN event_month - INTERVAL 6 MONTH AND event_month + INTERVAL 6 MONTH"), dates="month")
def event_profiles(spark, sf):
    from parlance.functions.text import month_diff

    c = X.mentions(spark, sf).groupBy("month").agg(F.sum("mention_count").alias("n"))
    e = F.broadcast(_events(spark, sf).select("event", "event_month"))
    rows = c.join(e, F.col("month").between(F.add_months("event_month", -6), F.add_months("event_month", 6)))
    return rows.select("event", "month", month_diff(F.col("month"), F.col("event_month")).alias("relative"), "n")


@query("relative_index", X.with_m(f"""{_RESOLVED}, c AS (SELECT month, sum(mention_count)::DOUBLE AS n FROM m GROUP BY 1), k AS (SELECT event, event_month, month, n, row_number() OVER (PARTITION BY event ORDER BY month) AS r FROM ev, c),
  z AS (SELECT *, r - min(r) FILTER (WHERE month >= event_month) OVER (PARTITION BY event) AS rel FROM k), y AS (SELECT * FROM z WHERE rel BETWEEN -4 AND 4) SELECT event, month, CAST(rel AS INTEGER) AS relative, {r6('n / CASE WHEN coalesce(avg(n) FILTER (WHERE rel < 0) OVER (PARTITION BY event), 0) = 0 THEN 0.001 ELSE avg(n) FILTER (WHERE rel < 0) OVER (PARTITION BY event) END')} AS index FROM y"""), dates="month")
def relative_index(spark, sf):
    c = X.mentions(spark, sf).groupBy("month").agg(F.sum("mention_count").cast("double").alias("n"))
    r = series.relative_index(c, F.broadcast(_events(spark, sf).select("event", "event_month")), "n")
    return rounded(r.select("event", "month", "relative", "index"))


@query("side_summary", X.with_m(f"{_AXIS} SELECT year, count(*) FILTER (WHERE position >= 0) AS right_side, count(*) FILTER (WHERE position < 0) AS left_side, arg_max(party, position) AS rightmost, arg_min(party, position) AS leftmost FROM ps GROUP BY year"))
def side_summary(spark, sf):
    p = _positions(spark, sf)
    return p.groupBy("year").agg(F.count_if(F.col("position") >= 0).alias("right_side"), F.count_if(F.col("position") < 0).alias("left_side"), F.max_by("party", "position").alias("rightmost"), F.min_by("party", "position").alias("leftmost"))


@query("eligible_count", f"WITH {_MONTHS} SELECT count(*) AS months, min(month) AS first_month, max(month) AS last_month FROM months", dates="first_month last_month")
def eligible_count(spark, sf):
    m = X.table(spark, sf, "orders").select(F.trunc("o_orderdate", "MM").alias("month")).distinct()
    return m.agg(F.count("*").alias("months"), F.min("month").alias("first_month"), F.max("month").alias("last_month"))


def _labelled(spark, sf):
    return X.table(spark, sf, "documents").join(X.table(spark, sf, "labels"), "doc_id").select("doc_id", "text", "quality")


@query("text_classifier")
def text_classifier(spark, sf):
    return classify.nested(_labelled(spark, sf), "doc_id", "text", "quality", outer=2, inner=2, strengths=(0.5, 2.0), iterations=8, features=1 << 12)


@query("text_classifier_folds", "SELECT ('0x' || substr(md5('outer|' || doc_id), 1, 8))::BIGINT % 5 AS fold, quality AS label, count(*) AS n FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL GROUP BY ALL")
def text_classifier_folds(spark, sf):
    d = _labelled(spark, sf).where("quality IS NOT NULL")
    return d.groupBy(classify.fold("doc_id", 5, "outer").cast("long").alias("fold"), F.col("quality").alias("label")).agg(F.count("*").alias("n"))


@query("rank_correlations", f"WITH {X.MACRO_SQL}, r AS (SELECT rank() OVER (ORDER BY s1) AS a, rank() OVER (ORDER BY s2) AS b FROM macro WHERE s1 IS NOT NULL AND s2 IS NOT NULL) SELECT {r6('corr(a, b)')} AS spearman, count(*) AS n FROM r")
def rank_correlations(spark, sf):
    p = X.macro_monthly(spark, sf).dropna(subset=["s1", "s2"])
    r = stats.average_ranks(stats.average_ranks(p, [], "s1", "a"), [], "s2", "b")
    return rounded(r.agg(F.corr("a", "b").alias("spearman"), F.count("*").alias("n")))


@query("spread_by_term", X.with_m(f"{_AXIS}, {X.TERMS_SQL} SELECT term, {r6('avg(position)')} AS center, {r6('max(position) - min(position)')} AS spread FROM ps JOIN terms ON make_date(year, 6, 1) BETWEEN start AND stop GROUP BY term"))
def spread_by_term(spark, sf):
    p = joins.term_of(_positions(spark, sf).withColumn("date", F.make_date("year", F.lit(6), F.lit(1))), X.terms(spark))
    s = axis.spread(p, ["term"]).select("term", "spread").join(p.groupBy("term").agg(F.avg("position").alias("center")), "term")
    return rounded(s)
