"""Registered queries: macro assembly, event tables, findings."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.operators import axis, events, findings, graphs, joins, macro, panels, stats

from . import fixtures as X
from .more_queries import _D
from .registry import query
from .sqlkit import bal, r6, rounded
from .study_queries import (
    _AXIS, _COS, _DISP, _ELIGIBLE, _KNN, _LONG, _MEANS, _MOD, _MONTHS, _PANEL, _RESOLVED, _STAGES, _STRESS, _V, _ZL, S, _events, _months, _panel, _positions, _stage_means, _stress,
)

# macro assembly
_QUOTES = "q AS (SELECT user_id, avg(value) FILTER (WHERE event_type = 'click' AND value < 9) AS bid, avg(value) FILTER (WHERE event_type = 'view' AND value < 9) AS ask FROM events GROUP BY 1)"


@query("bid_ask_mid", f"WITH {_QUOTES} SELECT user_id, {r6('coalesce((bid + ask) / 2, bid, ask)')} AS mid FROM q")
def bid_ask_mid(spark, sf):
    low = lambda t: F.avg(F.when((F.col("event_type") == t) & (F.col("value") < 9), F.col("value")))
    q = X.table(spark, sf, "events").groupBy("user_id").agg(low("click").alias("bid"), low("view").alias("ask"))
    return rounded(q.select("user_id", macro.mid(F.col("bid"), F.col("ask")).alias("mid")))


@query("policy_rate_union", "WITH c AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS date, count(*) AS n FROM orders GROUP BY 1) SELECT date, CASE WHEN year(date) >= 1998 THEN n + 0.5::DOUBLE ELSE n::DOUBLE END AS rate FROM c WHERE year(date) >= 1998 OR n % 7 <> 0", dates="date")
def policy_rate_union(spark, sf):
    c = X.table(spark, sf, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.year("o_orderdate").alias("y")).agg(F.count("*").alias("n"))
    n = F.col("n").cast("string")
    older = c.where("y <= 1998").select(F.when(F.col("n") % 7 == 0, F.concat(F.lit("no date "), n)).otherwise(F.concat("month", F.lit("  "), n)).alias("raw"))
    recent = c.where("y >= 1998").select("month", F.concat(n, F.lit(",5")).alias("value")).unionByName(c.limit(1).select(F.lit("total").alias("month"), n.alias("value")))
    return macro.policy_rates(older, recent)


_CPI = f"{X.MACRO_SQL}, sp AS (SELECT CAST(unnest(generate_series(DATE '1994-01-01', DATE '2002-12-01', INTERVAL 1 MONTH)) AS DATE) AS date), w AS (SELECT date, CASE WHEN year(date) < 1999 THEN s1 END AS idx_old, CASE WHEN year(date) < 1998 THEN s2 END AS mom, CASE WHEN year(date) < 1997 THEN s3 END AS yoy, CASE WHEN year(date) >= 1995 THEN s4 END AS idx_new, s5 AS mom_new FROM sp LEFT JOIN macro ON month = date)"


@query("cpi_assembly", f"WITH {_CPI} SELECT date, idx_old, idx_new, {r6('coalesce(mom, mom_new)')} AS mom, {r6('coalesce(yoy, (idx_new / nullif(lag(idx_new, 12) OVER (ORDER BY date), 0) - 1) * 100)')} AS yoy FROM w", dates="date")
def cpi_assembly(spark, sf):
    m = X.macro_monthly(spark, sf).withColumnRenamed("month", "date")
    label = {"s1": "Index (1994=100)", "s2": "Monthly change", "s3": "Yearly change", "s4": "Index (2025=100)", "s5": "New monthly rate"}
    until = {"s1": "year(date) < 1999", "s2": "year(date) < 1998", "s3": "year(date) < 1997", "s4": "year(date) >= 1995", "s5": "true"}
    long = m.unpivot("date", S, "s", "value").where("value is not null")
    long = long.where(" or ".join(f"s = '{s}' and {u}" for s, u in until.items()))
    name = F.create_map(*[F.lit(x) for kv in label.items() for x in kv])
    long = long.select("date", name[F.col("s")].alias("series_label"), F.lit("as measured").alias("metric_label"), "value")
    spine = joins.month_spine(spark.createDataFrame([("1994-01-01", "2002-12-01")], "start string, stop string").select(F.to_date("start").alias("start"), F.to_date("stop").alias("stop")), out="date").select("date")
    picks = {"idx_old": ("Index (1994", "measured"), "mom": ("Monthly change", ""), "yoy": ("Yearly change", ""), "idx_new": ("Index (2025", "measured"), "mom_new": ("New monthly", "")}
    return rounded(macro.assemble_index(long, spine, picks, {"mom": "mom_new"}, ("yoy", "idx_new")))


_CATS = {"1": "general", "2": "youth", "3": "working_age"}


@query("labor_annual", "WITH c AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, left(o_orderpriority, 1) AS k, count(*) AS n, sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS o FROM orders GROUP BY ALL) SELECT year, " + ", ".join(f"(max(CASE WHEN k = '{k}' THEN n END) + 1000)::DOUBLE AS force_{s}, max(CASE WHEN k = '{k}' THEN o END)::DOUBLE AS unemployed_{s}, {r6(f'''max(CASE WHEN k = '{k}' THEN o / n::DOUBLE END)''')} AS rate_{s}" for k, s in _CATS.items()) + ", max(CASE WHEN k = '4' THEN n END) AS employment FROM c GROUP BY year")
def labor_annual(spark, sf):
    k = F.left("o_orderpriority", F.lit(1))
    c = X.table(spark, sf, "orders").groupBy(F.year("o_orderdate").alias("year"), k.alias("category")).agg(F.count("*").alias("n"), F.sum((F.col("o_orderstatus") == "O").cast("int")).alias("o"))
    dotted = F.concat(F.substring((F.col("n") + 1000).cast("string"), 1, 1), F.lit("."), F.substring((F.col("n") + 1000).cast("string"), 2, 9))
    rows = c.select(F.col("year").cast("string").alias("year"), "category", dotted.alias("force"), F.col("o").cast("string").alias("unemployed"), (F.col("o") / F.col("n")).cast("string").alias("rate"))
    return rounded(macro.labor_annual(rows, c.where("category = '4'").select("year", F.col("n").alias("employment")), _CATS))


# findings
_DSQL = f"{_RESOLVED}, {_STAGES}, {_PANEL}, {_MEANS}, ds AS (SELECT event, {_DISP('shock')} AS displacement_shock, {_DISP('post')} AS displacement_post, coalesce({_DISP('shock')} > 0 AND {_DISP('post')} > 0, false) AS persists, macro_shock - macro_pre AS shift FROM sm), dk AS (SELECT ds.*, term, kind FROM ds JOIN events_c USING (event))"


def _displaced(spark, sf):
    d = events.displacement(_stage_means(spark, sf), ["const", "secur"], "macro")
    return d.select("event", "displacement_shock", "displacement_post", "persists", F.col("macro_delta_shock").alias("shift")).join(F.broadcast(X.events(spark).select("event", "term", "kind")), "event")


@query("family_summary", X.with_m(f"{_DSQL} SELECT kind, count(*) AS events, {r6('avg(displacement_shock)')} AS mean_displacement_shock, {r6('avg(shift)')} AS mean_shift, {r6('avg(CASE WHEN persists THEN 1.0 ELSE 0.0 END)')} AS share_persists FROM dk GROUP BY kind"))
def family_summary(spark, sf):
    return rounded(findings.family_summary(_displaced(spark, sf), "kind", ["displacement_shock", "shift"], ["persists"]))


@query("focus_selection", X.with_m(f"{_DSQL}, fx AS (SELECT *, kind = 'core' AS c, bool_or(kind = 'core') OVER (PARTITION BY term) AS a FROM dk), fy AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY abs(shift) DESC NULLS LAST, event) AS r FROM fx WHERE c = a) SELECT term, event, {r6('shift')} AS shift FROM fy WHERE r = 1"))
def focus_selection(spark, sf):
    return rounded(findings.focus(_displaced(spark, sf), ["term"], "shift", F.col("kind") == "core", "event").select("term", "event", "shift"))


_OWNER = f"og AS (SELECT event, stage, party, sum(mention_count) AS n, {bal('sum(pos)', 'sum(neg)')} AS b FROM st JOIN m USING (month) WHERE category = 'macro_economy' GROUP BY ALL), oh AS (SELECT *, n / sum(n) OVER (PARTITION BY event, stage)::DOUBLE AS s FROM og), ow AS (SELECT event, stage, arg_max(party, (n, party)) AS owner, max(s) AS owner_share, arg_max(b, (n, party)) AS owner_balance, sum(s * s) AS hhi, arg_min(party, (b, party)) AS attack, arg_max(party, (b, party)) AS defense FROM oh GROUP BY ALL)"


def _owners(spark, sf):
    """Per event and stage the owner of the economic topic, its share and balance, the concentration, and the parties of lowest and highest balance."""
    m = X.mentions(spark, sf).where("category = 'macro_economy'").select("month", "party", F.col("mention_count").alias("n"), "pos", "neg")
    s = events.stage_rows(joins.stage_windows(_events(spark, sf)), m, ["party"], ["n", "pos", "neg"])
    s = s.withColumns({"s": panels.share(F.col("n"), ["event", "stage"]), "b": (F.col("pos") - F.col("neg")) / (F.col("pos") + F.col("neg") + 1.0)})
    by = lambda c, *o: F.max_by(c, F.struct(*o))
    return s.groupBy("event", "stage").agg(
        by("party", "n", "party").alias("owner"), F.max("s").alias("owner_share"), by("b", "n", "party").alias("owner_balance"), F.sum(F.col("s") * F.col("s")).alias("hhi"), F.min_by("party", F.struct("b", "party")).alias("attack"), by("party", "b", "party").alias("defense")
    )


@query("key_findings", X.with_m(f"{_AXIS}, {_DSQL}, {_OWNER}, iv AS (SELECT party, median(position) AS c, max(position) - min(position) AS wd FROM ps GROUP BY 1), ok AS (SELECT owner, count(*) AS n FROM ow GROUP BY 1), k1 AS (SELECT arg_max(event, (abs(shift), event)) AS event, arg_max(shift, (abs(shift), event)) AS shift FROM dk WHERE kind = 'core') SELECT event, {r6('shift')} AS shift, (SELECT owner FROM ok ORDER BY n DESC, owner LIMIT 1) AS top_owner, (SELECT max(n) FROM ok) AS owned, (SELECT arg_min(party, (c, party)) FROM iv) AS leftmost, (SELECT arg_max(party, (c, party)) FROM iv) AS rightmost, (SELECT arg_max(party, (wd, party)) FROM iv) AS widest FROM k1"))
def key_findings(spark, sf):
    return rounded(findings.key_findings(_displaced(spark, sf), _owners(spark, sf), axis.intervals(_positions(spark, sf)), F.col("kind") == "core"))


@query("event_registry", f"WITH {_RESOLVED}, {_STAGES}, {_ELIGIBLE} SELECT event, event_month, (SELECT string_agg(strftime(month, '%Y-%m'), ',' ORDER BY month) FROM st WHERE st.event = ev.event AND stage = 'pre') AS pre_months, (SELECT string_agg(strftime(month, '%Y-%m'), ',') FROM st WHERE st.event = ev.event AND stage = 'shock') AS shock_months, (SELECT string_agg(strftime(month, '%Y-%m'), ',' ORDER BY month) FROM st WHERE st.event = ev.event AND stage = 'post') AS post_months, (SELECT count(*) FROM el WHERE el.month <> ev.event_month) AS eligible_pool FROM ev", dates="event_month")
def event_registry(spark, sf):
    e = _events(spark, sf).select("event", "event_month")
    return events.registry(e, joins.stage_windows(e), joins.eligible_months(_months(spark, sf)))


_SNAP = f"sg AS (SELECT event, stage, party, sum(mention_count)::BIGINT AS mentions, sum(pos)::BIGINT AS pos, sum(neg)::BIGINT AS neg FROM st JOIN m USING (month) GROUP BY ALL)"


@query("stage_snapshot", X.with_m(f"{_RESOLVED}, {_STAGES}, {_SNAP} SELECT event, stage, party, mentions, {r6(bal('pos', 'neg'))} AS balance, {r6('mentions / sum(mentions) OVER (PARTITION BY event, stage)::DOUBLE')} AS agenda_share, {r6('neg / greatest(mentions, 1)::DOUBLE')} AS negative_rate FROM sg"))
def stage_snapshot(spark, sf):
    m = X.mentions(spark, sf).select("month", "party", F.col("mention_count").alias("mentions"), "pos", "neg")
    s = events.stage_rows(joins.stage_windows(_events(spark, sf)), m, ["party"], ["mentions", "pos", "neg"])
    s = s.select("event", "stage", "party", "mentions", ((F.col("pos") - F.col("neg")) / (F.col("pos") + F.col("neg") + 1.0)).alias("balance"), panels.share(F.col("mentions"), ["event", "stage"]).alias("agenda_share"), (F.col("neg") / F.greatest("mentions", F.lit(1))).alias("negative_rate"))
    return rounded(s)


_WIDE_OW = "oz AS (SELECT event, " + ", ".join(f"max(CASE WHEN stage = '{s}' THEN {v} END) AS {v}_{s}" for v in ("owner", "owner_share", "hhi", "attack", "defense") for s in ("pre", "shock", "post")) + " FROM ow GROUP BY event)"


def _owners_wide(spark, sf):
    return events.stage_wide(_owners(spark, sf), ["owner", "owner_share", "hhi", "attack", "defense"], ["owner_share", "hhi"])


@query("event_summary", X.with_m(f"{_DSQL}, {_OWNER}, {_WIDE_OW} SELECT event, kind, {r6('shift')} AS salience_shift, {r6('displacement_shock')} AS displacement_shock, persists, owner_pre, owner_shock, owner_post, attack_shock, defense_shock, {r6('owner_share_shock - owner_share_pre')} AS owner_share_delta, {r6('hhi_shock - hhi_pre')} AS hhi_delta, coalesce(owner_pre <> owner_shock, false) AS owner_shift, coalesce(owner_pre <> owner_shock AND owner_post = owner_shock, false) AS owner_shift_persists FROM dk LEFT JOIN oz USING (event)"))
def event_summary(spark, sf):
    j = _displaced(spark, sf).join(_owners_wide(spark, sf), "event", "left")
    moved = F.col("owner_pre") != F.col("owner_shock")
    flag = lambda c: F.coalesce(c, F.lit(False))
    out = j.select("event", "kind", F.col("shift").alias("salience_shift"), "displacement_shock", "persists", "owner_pre", "owner_shock", "owner_post", "attack_shock", "defense_shock", F.col("owner_share_delta_shock").alias("owner_share_delta"), F.col("hhi_delta_shock").alias("hhi_delta"), flag(moved).alias("owner_shift"), flag(moved & (F.col("owner_post") == F.col("owner_shock"))).alias("owner_shift_persists"))
    return rounded(out)


_NULLS = f"""am AS (SELECT DISTINCT event_month AS atm FROM ev UNION SELECT month FROM el), ch AS (SELECT atm, max(CASE WHEN pn.month = atm THEN macro END) - avg(CASE WHEN pn.month < atm THEN macro END) AS change FROM am LEFT JOIN pn ON pn.month BETWEEN atm - INTERVAL 3 MONTH AND atm GROUP BY atm),
  nu AS (SELECT event, any_value(kind) AS kind, any_value(o.change) AS observed, avg(n.change) AS null_mean, stddev_pop(n.change) AS null_std, avg(CASE WHEN abs(n.change) >= abs(o.change) THEN 1.0 ELSE 0.0 END) AS null_p FROM ev JOIN ch o ON o.atm = event_month JOIN el ON el.month <> event_month JOIN ch n ON n.atm = el.month GROUP BY event), nz AS (SELECT *, (observed - null_mean) / nullif(null_std, 0) AS z FROM nu)"""


def _nulls(spark, sf):
    p = events.placebo(_panel(spark, sf), _events(spark, sf).select("event", "event_month"), joins.eligible_months(_months(spark, sf)), "macro")
    return events.null_zscores(p.drop("z")).join(F.broadcast(X.events(spark).select("event", "kind")), "event")


@query("null_zscores", X.with_m(f"{_RESOLVED}, {_ELIGIBLE}, {_PANEL}, {_NULLS} SELECT kind, count(*) AS events, {r6('avg(null_p)')} AS mean_p, {r6('min(null_p)')} AS min_p, {r6('avg(CASE WHEN null_p <= 0.1 THEN 1.0 ELSE 0.0 END)')} AS share_low_p, {r6('avg(abs(z))')} AS mean_abs_z, {r6('max(abs(z))')} AS max_abs_z FROM nz GROUP BY kind"))
def null_zscores(spark, sf):
    return rounded(events.null_summary(_nulls(spark, sf), ["kind"]))


_HYP = f"{_DSQL}, {_ELIGIBLE}, {_OWNER}, {_WIDE_OW}, {_NULLS}, hy AS (SELECT dk.event, coalesce(shift > 0.005, false) AS salience_up, coalesce(displacement_shock > 0, false) AS displaced, coalesce(owner_pre <> owner_shock, false) AS owner_moved, coalesce(hhi_shock > hhi_pre, false) AS concentrated, coalesce(null_p <= 0.2, false) AS unusual FROM dk LEFT JOIN oz USING (event) LEFT JOIN nz USING (event)), hx AS (SELECT *, salience_up::INTEGER + displaced::INTEGER + owner_moved::INTEGER + concentrated::INTEGER + unusual::INTEGER AS support_count FROM hy), hz AS (SELECT *, CASE WHEN support_count >= 4 THEN 'strong' WHEN support_count >= 2 THEN 'partial' ELSE 'weak' END AS reading FROM hx)"


def _hypotheses(spark, sf):
    j = _displaced(spark, sf).join(_owners_wide(spark, sf), "event", "left").join(_nulls(spark, sf).select("event", "null_p"), "event", "left")
    flags = {"salience_up": F.col("shift") > 0.005, "displaced": F.col("displacement_shock") > 0, "owner_moved": F.col("owner_pre") != F.col("owner_shock"), "concentrated": F.col("hhi_shock") > F.col("hhi_pre"), "unusual": F.col("null_p") <= 0.2}
    return findings.support(j.select("event", "shift", "displacement_shock", "owner_pre", "owner_shock", "hhi_shock", "hhi_pre", "null_p"), flags).select("event", *flags, "support_count", "reading")


@query("hypothesis_matrix", X.with_m(f"{_HYP} SELECT * FROM hz"))
def hypothesis_matrix(spark, sf):
    return _hypotheses(spark, sf)


_SPOS = "sx AS (SELECT event, stage, party, avg(position) AS position FROM st JOIN ps ON ps.year = year(st.month) GROUP BY ALL), sy AS (SELECT event, stage, max(position) - min(position) AS spread, stddev_samp(position) AS deviation, arg_min(party, (position, party)) AS leftmost, arg_max(party, (position, party)) AS rightmost FROM sx GROUP BY ALL)"
_WIDE_SY = "sw AS (SELECT event, " + ", ".join(f"max(CASE WHEN stage = '{s}' THEN {v} END) AS {v}_{s}" for v in ("spread", "deviation", "leftmost", "rightmost") for s in ("pre", "shock", "post")) + " FROM sy GROUP BY event)"


def _stage_positions(spark, sf):
    w = joins.stage_windows(_events(spark, sf)).select("event", "stage", "month", F.year("month").alias("year"))
    return w.join(_positions(spark, sf), "year").groupBy("event", "stage", "party").agg(F.avg("position").alias("position"))


@query("distance_table", X.with_m(f"{_AXIS}, {_RESOLVED}, {_STAGES}, {_SPOS}, {_WIDE_SY} SELECT event, " + ", ".join(f"{r6(f'spread_{s}')} AS spread_{s}, {r6(f'deviation_{s}')} AS deviation_{s}, leftmost_{s}, rightmost_{s}" for s in ("pre", "shock", "post")) + f", {r6('spread_shock - spread_pre')} AS spread_delta_shock, {r6('spread_post - spread_pre')} AS spread_delta_post FROM sw"))
def distance_table(spark, sf):
    p = _stage_positions(spark, sf)
    d = p.groupBy("event", "stage").agg((F.max("position") - F.min("position")).alias("spread"), F.stddev_samp("position").alias("deviation"), F.min_by("party", F.struct("position", "party")).alias("leftmost"), F.max_by("party", F.struct("position", "party")).alias("rightmost"))
    return rounded(events.stage_wide(d, ["spread", "deviation", "leftmost", "rightmost"], ["spread"]))


@query("stage_position_deltas", X.with_m(f"{_AXIS}, {_RESOLVED}, {_STAGES}, {_SPOS}, dx AS (SELECT event, party, max(CASE WHEN stage = 'post' THEN position END) - max(CASE WHEN stage = 'pre' THEN position END) AS d FROM sx GROUP BY ALL) SELECT party, " + ", ".join(f"{r6(f'''max(CASE WHEN event = '{e[1]}' THEN d END)''')} AS {e[1]}" for e in X.EVENTS) + " FROM dx GROUP BY party"))
def stage_position_deltas(spark, sf):
    w = events.stage_wide(_stage_positions(spark, sf), ["position"], ["position"], ("event", "party"))
    return rounded(w.groupBy("party").pivot("event", [e[1] for e in X.EVENTS]).agg(F.first("position_delta_post")))


@query("event_topic_prepost", X.with_m(f"{_RESOLVED}, wn AS (SELECT event, CAST(event_month - INTERVAL 2 MONTH AS DATE) AS a, event_month AS b, CAST(event_month + INTERVAL 2 MONTH AS DATE) + 27 AS c FROM ev), pp AS (SELECT event, category, CASE WHEN date < b THEN 'pre' ELSE 'post' END AS side, sum(mention_count) AS n, sum(neg) AS neg FROM wn JOIN m ON date >= a AND date <= c GROUP BY ALL), sh AS (SELECT *, n / sum(n) OVER (PARTITION BY event, side)::DOUBLE AS share, neg / n::DOUBLE AS rate FROM pp) SELECT event, category, {r6('''max(CASE WHEN side = 'pre' THEN share END)''')} AS share_pre, {r6('''max(CASE WHEN side = 'post' THEN share END)''')} AS share_post, {r6('''max(CASE WHEN side = 'pre' THEN rate END)''')} AS rate_pre, {r6('''max(CASE WHEN side = 'post' THEN rate END)''')} AS rate_post FROM sh GROUP BY ALL"))
def event_topic_prepost(spark, sf):
    w = F.broadcast(joins.day_windows(_events(spark, sf)).select("event", "pre_start", "post_start", "post_stop"))
    m = X.mentions(spark, sf).join(w, F.col("date").between(F.col("pre_start"), F.col("post_stop")))
    side = F.when(F.col("date") < F.col("post_start"), "pre").otherwise("post")
    s = m.groupBy("event", "category", side.alias("side")).agg(F.sum("mention_count").alias("n"), F.sum("neg").alias("neg"))
    s = s.withColumns({"share": panels.share(F.col("n"), ["event", "side"]), "rate": F.col("neg") / F.col("n")})
    at = lambda v, x: F.max(F.when(F.col("side") == x, F.col(v))).alias(f"{v}_{x}")
    return rounded(s.groupBy("event", "category").agg(*[at(v, x) for v in ("share", "rate") for x in ("pre", "post")]))


@query("event_mean_tests", X.with_m(f"{_RESOLVED}, {_STAGES}, {_PANEL}, tt AS (SELECT event, CASE WHEN stage = 'pre' THEN 'pre' ELSE 'post' END AS side, macro AS v FROM st JOIN pn USING (month)), ag AS (SELECT event, count(*) FILTER (WHERE side = 'pre') AS n1, count(*) FILTER (WHERE side = 'post') AS n2, avg(v) FILTER (WHERE side = 'pre') AS m1, avg(v) FILTER (WHERE side = 'post') AS m2, var_samp(v) FILTER (WHERE side = 'pre') AS v1, var_samp(v) FILTER (WHERE side = 'post') AS v2 FROM tt GROUP BY 1),"
    " rk AS (SELECT event, side, rank() OVER (PARTITION BY event ORDER BY v) + (count(*) OVER (PARTITION BY event, v) - 1) / 2.0::DOUBLE AS r FROM tt), us AS (SELECT event, sum(r) FILTER (WHERE side = 'pre') AS rs FROM rk GROUP BY 1)"
    f" SELECT event, n1, n2, {r6('m1')} AS m1, {r6('m2')} AS m2, {r6('m2 - m1')} AS difference, {r6('(m2 - m1) / nullif(sqrt(v1 / n1 + v2 / n2), 0)')} AS welch_t, {r6('(m2 - m1) / nullif(sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)), 0) * (1 - 3 / (4 * (n1 + n2) - 9)::DOUBLE)')} AS hedges_g, {r6('rs - n1 * (n1 + 1) / 2')} AS u FROM ag JOIN us USING (event) WHERE n1 >= 2 AND n2 >= 2"))
def event_mean_tests(spark, sf):
    w = joins.stage_windows(_events(spark, sf)).join(_panel(spark, sf), "month")
    rows = w.select("event", F.when(F.col("stage") == "pre", "pre").otherwise("post").alias("side"), F.col("macro").alias("v"))
    return rounded(stats.mean_tests(rows, ["event"], "side", "pre", "post", "v").drop("welch_p", "u_p"))


@query("event_mean_tests_p")
def event_mean_tests_p(spark, sf):
    w = joins.stage_windows(_events(spark, sf)).join(_panel(spark, sf), "month")
    rows = w.select("event", F.when(F.col("stage") == "pre", "pre").otherwise("post").alias("side"), F.col("macro").alias("v"))
    return rounded(stats.mean_tests(rows, ["event"], "side", "pre", "post", "v").select("event", "welch_p", "u_p"))


# trading days: the mean order value of a day is its close
_DAYS = "dy AS (SELECT CAST(o_orderdate AS DATE) AS date, round(avg(o_totalprice), 2) AS close FROM orders GROUP BY 1), da AS (SELECT *, row_number() OVER (ORDER BY date) AS n FROM dy), an AS (SELECT event, min(date) AS anchor FROM ev JOIN dy ON date >= event_month AND isodow(date) <= 5 GROUP BY 1), ax AS (SELECT event, n AS an, close AS ac FROM an JOIN da ON date = anchor)"


def _traded(spark, sf, span):
    days = X.table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(F.round(F.avg("o_totalprice"), 2).alias("close"))
    anchors = joins.anchor_day(_events(spark, sf).select("event", "event_month"), days, "event_month")
    return events.trading_days(days, anchors, "close", span)


@query("relative_trade_day", f"WITH {_RESOLVED}, {_DAYS} SELECT event, date, CAST(n - an AS INTEGER) AS relative, {r6('(close / ac - 1) * 100')} AS cumulative_return FROM ax JOIN da ON n BETWEEN an - 15 AND an + 15", dates="date")
def relative_trade_day(spark, sf):
    return rounded(_traded(spark, sf, 15))


@query("market_reactions", f"WITH {_RESOLVED}, {_DAYS}, rr AS (SELECT event, n - an AS k, (close / ac - 1) * 100 AS r FROM ax JOIN da ON n BETWEEN an - 15 AND an + 15) SELECT event, {r6('max(CASE WHEN k = -5 THEN r END)')} AS before_5, {r6('max(CASE WHEN k = 5 THEN r END)')} AS after_5, {r6('max(CASE WHEN k = 15 THEN r END)')} AS after_15, {r6('min(CASE WHEN k > 0 THEN r END)')} AS lowest, {r6('max(CASE WHEN k > 0 THEN r END)')} AS highest FROM rr GROUP BY event")
def market_reactions(spark, sf):
    t, k, r = _traded(spark, sf, 15), F.col("relative"), F.col("cumulative_return")
    at = lambda d: F.max(F.when(k == d, r))
    return rounded(t.groupBy("event").agg(at(-5).alias("before_5"), at(5).alias("after_5"), at(15).alias("after_15"), F.min(F.when(k > 0, r)).alias("lowest"), F.max(F.when(k > 0, r)).alias("highest")))


# edges worth showing, brokers
@query("top_edges_display", X.with_m(f"e AS (SELECT party, concept, sum(salience) AS w FROM m GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY concept ORDER BY round(w, 6) DESC, party) AS k FROM e) SELECT concept, party, {r6('w')} AS w FROM r WHERE k <= 3 ORDER BY round(w, 6) DESC, concept, party LIMIT 12"))
def top_edges_display(spark, sf):
    e = X.mentions(spark, sf).groupBy("concept", "party").agg(F.round(F.sum("salience"), 6).alias("w"))
    return rounded(findings.top_edges(e, "concept", "party", "w", 3, 12))


@query("top_edges_directed", f"{_D}, e AS (SELECT source, target, sum(total) AS w FROM directed GROUP BY ALL), c AS (SELECT greatest(0.18 * max(w), quantile_cont(w, 0.65)) AS cut FROM e), t AS (SELECT source, target FROM e ORDER BY w DESC, source, target LIMIT 40) SELECT source, target, {r6('w')} AS w FROM e, c WHERE w >= cut OR (source, target) IN (SELECT (source, target) FROM t)")
def top_edges_directed(spark, sf):
    e = graphs.directed_edges(X.directed(spark, sf)).select("source", "target", F.col("total").alias("w"))
    return rounded(findings.strong_edges(e, "w", 40))


_STAGE_GRAPH = f"""mo AS (SELECT * FROM m), af AS (WITH mg AS (SELECT mo.* REPLACE (event || ':' || stage AS year) FROM st JOIN mo ON mo.month = st.month), {_LONG.replace('FROM m ', 'FROM mg ')}, {_ZL}, {_COS('z', 'zs')} SELECT year, a, b, w FROM pr),
  ng AS (SELECT year, sum(greatest(-w, 0)) / nullif(sum(abs(w)), 0) AS negative_share FROM af GROUP BY 1), en AS (SELECT year, a, b, w FROM af UNION ALL SELECT year, b, a, w FROM af), sq AS (SELECT event || ':' || stage AS year, party, position, min(position) OVER v AS lo, max(position) OVER v AS hi, median(position) OVER v AS md FROM sx WINDOW v AS (PARTITION BY event, stage)),
  si AS (SELECT year, party, CASE WHEN position >= CASE WHEN lo >= 0 OR hi <= 0 THEN md ELSE 0 END THEN 1 ELSE -1 END AS side FROM sq), qp AS ({_MOD('1')}), qm AS ({_MOD('-1')}), mq AS (SELECT qp.year, qp.q - qm.q AS modularity FROM qp JOIN qm USING (year))"""


@query("stage_metrics_nine", X.with_m(f"""{_AXIS}, {_RESOLVED}, {_STAGES}, {_PANEL}, {_SPOS}, {_OWNER}, {X.MACRO_SQL}, {_STRESS}, {_STAGE_GRAPH}, pm AS (SELECT event, stage, avg(macro) AS salience, avg(const) AS const_share, avg(secur) AS secur_share, avg(stress) AS pressure FROM st LEFT JOIN pn USING (month) LEFT JOIN zz USING (month) GROUP BY ALL)
  SELECT event, stage, {r6('spread')} AS spread, {r6('pressure')} AS pressure, {r6('salience')} AS salience, {r6('const_share')} AS const_share, {r6('secur_share')} AS secur_share, {r6('owner_share')} AS owner_share, {r6('hhi')} AS hhi, {r6('negative_share')} AS negative_share, {r6('modularity')} AS modularity
  FROM pm LEFT JOIN sy USING (event, stage) LEFT JOIN ow USING (event, stage) LEFT JOIN ng ON ng.year = event || ':' || stage LEFT JOIN mq ON mq.year = event || ':' || stage"""))
def stage_metrics_nine(spark, sf):
    g = F.concat_ws(":", "event", "stage")
    w = joins.stage_windows(_events(spark, sf)).select("event", "stage", "month")
    months = w.join(_panel(spark, sf), "month", "left").join(_stress(spark, sf), "month", "left")
    base = months.groupBy("event", "stage").agg(F.avg("stress").alias("pressure"), F.avg("macro").alias("salience"), F.avg("const").alias("const_share"), F.avg("secur").alias("secur_share"))
    p = _stage_positions(spark, sf)
    m = X.mentions(spark, sf).join(F.broadcast(w.select(g.alias("g"), "month")), "month")
    f = panels.signed_agenda_feature(m, ["g", "party", "concept"]).select("g", "party", "concept", F.col("feature").alias("value"))
    pairs = graphs.signed_affinity(f, ["g"], "party", "value")
    side = graphs.sides(p.withColumn("g", g), ["g"], "party", "position")
    graph = graphs.affinity_summary(pairs, ["g"]).select("g", "negative_share").join(graphs.signed_modularity(pairs, side, ["g"], "party"), "g")
    spread = p.groupBy("event", "stage").agg((F.max("position") - F.min("position")).alias("spread"))
    out = base.join(spread, ["event", "stage"], "left").join(_owners(spark, sf).select("event", "stage", "owner_share", "hhi"), ["event", "stage"], "left")
    return rounded(out.withColumn("g", g).join(graph, "g", "left").drop("g"))
