"""Registered queries: paths and summaries of networks, poles, the axis and its draws, regressions, comparison of models."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.functions import distributions as D
from parlance.operators import axis, graphs, joins, macro, models, panels, paths, resample, stats
from parlance.operators.lineage import cut

from . import fixtures as X
from .registry import query
from .sqlkit import bal, r6, rounded
from .study_queries import (
    _AXIS, _COS, _KNN, _LONG, _RESOLVED, _STAGES, _ZL, _events, _knn, _long, _positions, _raters,
)

_PRE = f"{_LONG}, {_ZL}, {_COS('z', 'zs')}, {_KNN}"
# distances by repeated squaring, five times: 32 steps, more than 25 nodes need
_SQUARE = lambda i: f"p{i + 1} AS MATERIALIZED (SELECT year, a, b, min(d) AS d FROM (SELECT * FROM p{i} UNION ALL SELECT x.year, x.a, y.b, x.d + y.d FROM p{i} x JOIN p{i} y ON x.year = y.year AND x.b = y.a AND x.a <> y.b) GROUP BY ALL)"
_PATHS = "p0 AS MATERIALIZED (SELECT year, a, b, 1 / w AS d FROM kn WHERE w > 0 UNION ALL SELECT year, b, a, 1 / w FROM kn WHERE w > 0), " + ", ".join(_SQUARE(i) for i in range(5))
_CLOSE = "cn AS (SELECT DISTINCT year, party AS node FROM lo), cr AS (SELECT year, a AS node, count(*) AS r, sum(d) AS d FROM p5 GROUP BY ALL), cl AS (SELECT year, node, coalesce((r / d) * (r / (count(*) OVER (PARTITION BY year) - 1)::DOUBLE), 0) AS closeness FROM cn LEFT JOIN cr USING (year, node))"
_LARGEST = "lr AS (SELECT year, a, least(min(b), a) AS c, count(*) + 1 AS n, avg(d) AS d FROM p5 GROUP BY year, a), lc AS (SELECT year, c, any_value(n) AS n, avg(d) AS d FROM lr GROUP BY ALL), lg AS (SELECT year, arg_max(n, (n, -rank)) AS largest_component, arg_max(d, (n, -rank)) AS average_path FROM (SELECT *, row_number() OVER (PARTITION BY year ORDER BY c) AS rank FROM lc) GROUP BY year)"


@query("shortest_paths", X.with_m(f"{_PRE}, {_PATHS} SELECT year, a, b, {r6('d')} AS distance FROM p5", nation=True))
def shortest_paths(spark, sf):
    return rounded(graphs.shortest_paths(_knn(spark, sf), ["year"]))


@query("closeness", X.with_m(f"{_PRE}, {_PATHS}, {_CLOSE} SELECT year, node, {r6('closeness')} AS closeness FROM cl", nation=True))
def closeness(spark, sf):
    return rounded(graphs.closeness(graphs.shortest_paths(_knn(spark, sf), ["year"]), _nodes(spark, sf), ["year"]))


def _nodes(spark, sf):
    return _long(spark, sf, True).select("year", F.col("party").alias("node")).distinct()


@query("largest_component_path", X.with_m(f"{_PRE}, {_PATHS}, {_LARGEST} SELECT year, largest_component, {r6('average_path')} AS average_path FROM lg", nation=True))
def largest_component_path(spark, sf):
    return rounded(graphs.largest_component_path(graphs.shortest_paths(_knn(spark, sf), ["year"]), ["year"]))


_HALF = "(substr({0}, 2)::INTEGER % 2 = 0)"


@query("network_summary", X.with_m(f"""{_PRE}, {_PATHS}, {_CLOSE}, {_LARGEST}, ed AS (SELECT year, {_HALF.format('a')} AS x, {_HALF.format('b')} AS y FROM kn WHERE w > 0), bo AS (SELECT * FROM ed UNION ALL SELECT year, y, x FROM ed),
  tt AS (SELECT year, count(*) AS n, count(*) FILTER (WHERE x = y) AS same, count(*) FILTER (WHERE x) AS k1, count(*) FILTER (WHERE NOT x) AS k0 FROM bo GROUP BY 1), nn AS (SELECT year, count(*) AS nodes, avg(closeness) AS mc FROM cl GROUP BY 1)
  SELECT year, nodes, (n // 2)::BIGINT AS edges, {r6('n / (nodes * (nodes - 1))::DOUBLE')} AS density, {r6('(same / n::DOUBLE - (k1 * k1 + k0 * k0) / (n * n)::DOUBLE) / nullif(1 - (k1 * k1 + k0 * k0) / (n * n)::DOUBLE, 0)')} AS assortativity, {r6('mc')} AS mean_closeness, largest_component, {r6('average_path')} AS average_path FROM tt JOIN nn USING (year) JOIN lg USING (year)""", nation=True))
def network_summary(spark, sf):
    even = F.substring("node", 2, 9).cast("int") % 2 == 0
    return rounded(graphs.network_summary(_knn(spark, sf), _nodes(spark, sf), ["year"], even))


# poles: power iteration as in the operator, and the sweep over its thresholds
_ROUNDS = 20
_TIMES = lambda out, of: f"{out} AS MATERIALIZED (SELECT year, ar.a AS node, sum(ar.w * x.v) AS v FROM ar JOIN {of} x USING (year) WHERE x.node = ar.b GROUP BY ALL)"
_VECTOR = "ar AS MATERIALIZED (SELECT year, a, b, w FROM kn WHERE w <> 0 UNION ALL SELECT year, b, a, w FROM kn WHERE w <> 0), v0 AS MATERIALIZED (SELECT DISTINCT year, a AS node, ('0x' || substr(md5(a), 1, 6))::INTEGER / 16777216.0::DOUBLE + 0.5 AS v FROM ar), " + ", ".join(
    f"{_TIMES(f't{i}', f'v{i}')}, {_TIMES(f'u{i}', f't{i}')}, v{i + 1} AS MATERIALIZED (SELECT year, node, coalesce(v / nullif(sqrt(sum(v * v) OVER (PARTITION BY year)), 0), 0) AS v FROM u{i})" for i in range(_ROUNDS)
) + f", lv AS MATERIALIZED (SELECT year, node, v * arg_max(sign(v), (round(abs(v), 9), node)) OVER (PARTITION BY year) AS v FROM v{_ROUNDS})"
_QS = ", ".join(str(q) for q in [*graphs.QUANTILES, 0.6])
_SWEEP = f"""qc AS (SELECT year, quantile_cont(abs(v), [{_QS}]) AS qs, count(*) AS n FROM lv GROUP BY 1), qt AS (SELECT year, n, unnest(range(0, 19)) AS i, unnest(qs) AS tau FROM qc), qq AS (SELECT year, n, CASE WHEN i = 18 THEN -1 ELSE i END AS q, tau FROM qt),
  qx AS (SELECT year, q, tau, n, node, CASE WHEN v >= tau THEN 1 WHEN v <= -tau THEN -1 ELSE 0 END AS x FROM lv JOIN qq USING (year)), qs AS (SELECT e.year, y.q, sum(e.w * y.x * z.x) AS s FROM (SELECT year, a, b, w FROM ar) e JOIN qx y ON y.year = e.year AND y.node = e.a JOIN qx z ON z.year = e.year AND z.node = e.b AND z.q = y.q WHERE y.x <> 0 AND z.x <> 0 GROUP BY ALL),
  qn AS (SELECT year, q, tau, n, count(*) FILTER (WHERE x = 1) AS n_plus, count(*) FILTER (WHERE x = -1) AS n_minus, count(*) AS active FROM qx WHERE x <> 0 GROUP BY ALL), qr AS (SELECT year, q, tau, coalesce(s, 0) / active AS score, n_plus, n_minus, active, n_plus >= greatest(4, round_even(0.02 * n, 0)) AND n_minus >= greatest(4, round_even(0.02 * n, 0)) AS ok FROM qn LEFT JOIN qs USING (year, q)),
  qb AS (SELECT *, row_number() OVER (PARTITION BY year ORDER BY (ok AND q >= 0) DESC, (q < 0) DESC, round(score, 9) DESC, q) AS k FROM qr WHERE ok OR q < 0)"""


def _vector(spark, sf):
    knn = graphs.signed_knn(graphs.signed_affinity(_long(spark, sf, True), ["year"], "party", "value"), ["year"])
    return knn, graphs.leading_vector(knn, ["year"], _ROUNDS)


@query("leading_eigenvector", X.with_m(f"{_PRE}, {_VECTOR} SELECT year, node, {r6('v')} AS v FROM lv", nation=True))
def leading_eigenvector(spark, sf):
    return rounded(_vector(spark, sf)[1])


@query("pole_threshold_sweep", X.with_m(f"{_PRE}, {_VECTOR}, {_SWEEP} SELECT year, {r6('tau')} AS tau, {r6('score')} AS score, n_plus, n_minus, active FROM qb WHERE k = 1", nation=True))
def pole_threshold_sweep(spark, sf):
    knn, v = _vector(spark, sf)
    return rounded(graphs.best_poles(graphs.pole_sweep(knn, v, ["year"]), ["year"]))


_FIXED = "ft AS (SELECT year, quantile_cont(abs(v), 0.6) AS tau FROM lv GROUP BY 1), fp AS (SELECT year, node, CASE WHEN v >= tau THEN 1 WHEN v <= -tau THEN -1 ELSE 0 END AS side FROM lv JOIN ft USING (year))"


@query("communities_fixed", X.with_m(f"{_PRE}, {_VECTOR}, {_FIXED} SELECT * FROM fp", nation=True))
def communities_fixed(spark, sf):
    return graphs.poles(_vector(spark, sf)[1], ["year"])


@query("community_composition", X.with_m(f"{_PRE}, {_VECTOR}, {_FIXED} SELECT year, substr(node, 2)::INTEGER % 5 AS grp, count(*) AS nodes, count(*) FILTER (WHERE side = 1) AS plus, count(*) FILTER (WHERE side = 0) AS neutral, count(*) FILTER (WHERE side = -1) AS minus FROM fp GROUP BY ALL", nation=True))
def community_composition(spark, sf):
    p = graphs.poles(_vector(spark, sf)[1], ["year"]).withColumn("grp", F.substring("node", 2, 9).cast("int") % 5)
    return graphs.composition(p, ["year"], "grp")


_DRAWS = 220
_SHUFFLED = f"sd AS (SELECT draw, lo.* FROM lo, range(1, {_DRAWS + 1}) t(draw)), sa AS (SELECT *, row_number() OVER (PARTITION BY draw, year, concept ORDER BY party) AS r, row_number() OVER (PARTITION BY draw, year, concept ORDER BY md5(draw || '|' || year || '|' || concept || '|' || party)) AS s FROM sd)"


@query("polarization_null", "WITH " + X.mentions_sql("m", True) + f", {_LONG.replace('lo AS', 'l0 AS')}, " + _SHUFFLED.replace("lo.*", "l0.*").replace("FROM lo", "FROM l0") + f", lo AS (SELECT a.year || '#' || a.draw AS year, a.party, a.concept, b.value FROM sa a JOIN sa b ON a.draw = b.draw AND a.year = b.year AND a.concept = b.concept AND a.r = b.s UNION ALL SELECT year || '#0', party, concept, value FROM l0), {_ZL}, {_COS('z', 'zs')}, {_KNN}, {_VECTOR}, {_SWEEP}, pz AS (SELECT split_part(year, '#', 1)::INTEGER AS year, split_part(year, '#', 2)::INTEGER AS draw, score FROM qb WHERE k = 1), po AS (SELECT year, score FROM pz WHERE draw = 0) SELECT po.year, {r6('any_value(po.score)')} AS observed, {r6('avg(pz.score)')} AS null_mean, {r6('stddev_pop(pz.score)')} AS null_std, {r6('avg(CASE WHEN pz.score >= po.score - 1e-9 THEN 1.0 ELSE 0.0 END)')} AS null_p FROM po JOIN pz ON pz.year = po.year AND pz.draw > 0 GROUP BY po.year")
def polarization_null(spark, sf):
    return rounded(graphs.polarization_null(cut(_long(spark, sf, True)), ["year"], "party", "value", _DRAWS, _ROUNDS))


_EIGEN = "ea AS MATERIALIZED (SELECT year, a, b, w FROM kn WHERE w > 0 UNION ALL SELECT year, b, a, w FROM kn WHERE w > 0), eb AS MATERIALIZED (SELECT * FROM ea UNION ALL SELECT DISTINCT year, a, a, 1.0::DOUBLE FROM ea), e0 AS MATERIALIZED (SELECT DISTINCT year, a AS node, 1.0::DOUBLE AS v FROM ea), " + ", ".join(
    f"x{i} AS MATERIALIZED (SELECT eb.year, eb.a AS node, sum(eb.w * e.v) AS v FROM eb JOIN e{i} e ON e.year = eb.year AND e.node = eb.b GROUP BY ALL), e{i + 1} AS MATERIALIZED (SELECT year, node, v / sqrt(sum(v * v) OVER (PARTITION BY year)) AS v FROM x{i})" for i in range(60)
)


@query("eigenvector_centrality", X.with_m(f"{_PRE}, {_EIGEN} SELECT year, node, {r6('v')} AS centrality FROM e60", nation=True))
def eigenvector_centrality(spark, sf):
    return rounded(graphs.eigenvector(_knn(spark, sf), ["year"]))


_WAYS = "bn AS (SELECT year, count(*) AS n FROM (SELECT year, a FROM pr UNION SELECT year, b FROM pr) GROUP BY 1), br AS MATERIALIZED (SELECT year, a, b, w, row_number() OVER (PARTITION BY year ORDER BY round(w, 9) DESC, a, b) AS r, count(*) OVER (PARTITION BY year) AS e FROM pr WHERE w > 0), b0 AS MATERIALIZED (SELECT year, a, b, r FROM br UNION ALL SELECT year, b, a, r FROM br), " + ", ".join(
    f"b{i + 1} AS MATERIALIZED (SELECT year, a, b, min(r) AS r FROM (SELECT * FROM b{i} UNION ALL SELECT x.year, x.a, y.b, greatest(x.r, y.r) FROM b{i} x JOIN b{i} y ON x.year = y.year AND x.b = y.a AND x.a <> y.b) GROUP BY ALL)" for i in range(5)
) + ", bt AS (SELECT br.*, n, br.r = b5.r AS tree FROM br JOIN b5 USING (year, a, b) JOIN bn USING (year)), bx AS (SELECT *, greatest(n - 1, ceil(e * 0.5::DOUBLE)) - sum(CASE WHEN tree THEN 1 ELSE 0 END) OVER (PARTITION BY year) AS rest, sum(CASE WHEN tree THEN 0 ELSE 1 END) OVER (PARTITION BY year ORDER BY r) AS extra FROM bt)"


@query("prune_backbone", X.with_m(f"{_LONG}, {_COS('value', 'lo')}, {_WAYS} SELECT year, a, b, {r6('w')} AS w FROM bx WHERE n <= 2 OR tree OR extra <= rest", nation=True))
def prune_backbone(spark, sf):
    return rounded(paths.backbone(graphs.cosine_edges(_long(spark, sf, True), ["year"], "party", "value"), ["year"], 0.5))


# axis
_SCALE = "sc AS (SELECT concept, avg(value) AS mu, CASE WHEN coalesce(stddev_samp(value), 0) = 0 THEN 1 ELSE stddev_samp(value) END AS sd FROM lo GROUP BY 1), kw AS (SELECT concept, mu, sd, w FROM ww JOIN sc USING (concept)), zr AS (SELECT sum(-mu / sd * w) AS zero FROM kw)"


def _known(spark, sf, m=None):
    long = cut(_long(spark, sf, m=m))  # a row per year, party and concept, read twice
    return axis.scale(long), axis.anchor_weights(graphs.zscores(long, []), X.anchors(spark))


@query("monthly_positions", X.with_m(f"{_AXIS}, {_SCALE}, ms AS (SELECT month, party, concept, sum(mention_count) AS n, {bal('sum(pos)', 'sum(neg)')} AS b FROM m GROUP BY ALL), mf AS (SELECT month, party, concept, b * (n / sum(n) OVER (PARTITION BY month, party)::DOUBLE) AS value FROM ms) SELECT month, party, {r6('sum(value / sd * w) + any_value(zero)')} AS position FROM mf JOIN kw USING (concept), zr GROUP BY ALL"), dates="month")
def monthly_positions(spark, sf):
    f = panels.signed_agenda_feature(X.mentions(spark, sf), ["month", "party", "concept"]).select("month", "party", "concept", F.col("feature").alias("value"))
    return rounded(axis.scored(f, *_known(spark, sf), ["month", "party"]))


_BOOT = 250
_BOOTED = f"{resample.draws_sql(_BOOT)}, bu AS MATERIALIZED (SELECT party, concept, mention_count, pos, neg, {resample.seed_sql("speech_id || '|' || concept || '|' || mention_count || '|' || pos || '|' || neg")} AS seed FROM m), bw AS (SELECT bu.*, draw, {resample.weight_sql("seed")} AS k FROM bu, dr), bs AS (SELECT draw, party, concept, sum(k * mention_count) AS n, sum(k * pos) AS p, sum(k * neg) AS g FROM bw GROUP BY ALL HAVING sum(k * mention_count) > 0), bf AS (SELECT draw, party, concept, {bal('p', 'g')} * n / greatest(sum(n) OVER (PARTITION BY draw, party), 1)::DOUBLE AS value FROM bs), bp AS (SELECT draw, party, sum(value / sd * w) + any_value(zero) AS position FROM bf JOIN kw USING (concept), zr GROUP BY ALL), bq AS (SELECT party, quantile_cont(position, 0.1) AS boot_q10, quantile_cont(position, 0.25) AS boot_q25, quantile_cont(position, 0.5) AS boot_median, quantile_cont(position, 0.75) AS boot_q75, quantile_cont(position, 0.9) AS boot_q90, stddev_pop(position) AS boot_std FROM bp GROUP BY 1)"
_BQ = ", ".join(f"{r6(c)} AS {c}" for c in ("boot_q10", "boot_q25", "boot_median", "boot_q75", "boot_q90", "boot_std"))


def _booted(spark, sf):
    return axis.bootstrap(X.mentions(spark, sf), ["speech_id", "concept", "mention_count", "pos", "neg"], *_known(spark, sf), _BOOT)


@query("bootstrap_positions", X.with_m(f"{_AXIS}, {_SCALE}, {_BOOTED} SELECT party, {_BQ} FROM bq"))
def bootstrap_positions(spark, sf):
    return rounded(axis.quantiles(_booted(spark, sf)))


@query("opinion_intervals", X.with_m(f"{_AXIS}, {_SCALE}, {_BOOTED}, iv AS (SELECT party, median(position) AS center, min(position) AS left_end, max(position) AS right_end, count(*) AS years FROM ps GROUP BY 1) SELECT 'ends' AS form, party, {r6('center')} AS center, {r6('left_end')} AS left_end, {r6('right_end')} AS right_end, years, {_BQ} FROM iv JOIN bq USING (party) UNION ALL SELECT 'draws', party, {r6('boot_median')}, {r6('boot_q10')}, {r6('boot_q90')}, years, {_BQ} FROM iv JOIN bq USING (party)"))
def opinion_intervals(spark, sf):
    i, b = axis.intervals(_positions(spark, sf)), axis.quantiles(_booted(spark, sf))
    form = lambda name, replace: axis.opinion_intervals(i, b, replace).withColumn("form", F.lit(name))
    return rounded(form("ends", False).unionByName(form("draws", True)))


# the axis is fitted anew to each resample of the panel's rows and without each anchor
_TAKEN = f"""za2 AS MATERIALIZED (SELECT year, party, concept, z FROM za), pn AS (SELECT year, party, row_number() OVER (ORDER BY year, party) - 1 AS place, count(*) OVER () AS n FROM (SELECT DISTINCT year, party FROM za2)),
  tk AS (SELECT draw, ('0x' || substr(md5(draw || '|' || i), 1, 8))::BIGINT % n AS place, count(*) AS k FROM range(1, {_BOOT + 1}) d(draw), (SELECT place AS i, n FROM pn) GROUP BY ALL),
  sm AS MATERIALIZED (SELECT 'full' AS kind, 'full' AS name, party, concept, z, anchor FROM mz LEFT JOIN anchors USING (party) UNION ALL
    SELECT 'without', l.party, mz.party, concept, z, CASE WHEN mz.party <> l.party THEN k.anchor END FROM mz LEFT JOIN anchors k USING (party), anchors l WHERE l.party IN (SELECT party FROM mz) UNION ALL
    SELECT 'draw', draw::VARCHAR, party, concept, sum(k * z) / sum(k), any_value(anchor) FROM tk JOIN pn USING (place) JOIN za2 USING (year, party) LEFT JOIN anchors USING (party) GROUP BY ALL)"""
_FITTED = """f0 AS (SELECT kind, name, concept, CASE WHEN count(*) < 2 OR stddev_pop(z) = 0 OR stddev_pop(anchor) = 0 THEN 0 ELSE corr(z, anchor) END AS w FROM sm WHERE anchor IS NOT NULL GROUP BY ALL),
  f1 AS MATERIALIZED (SELECT kind, name, concept, w / sqrt(sum(w * w) OVER (PARTITION BY kind, name)) AS w FROM f0), fp AS MATERIALIZED (SELECT kind, name, party, any_value(anchor) AS anchor, sum(z * w) AS position FROM sm JOIN f1 USING (kind, name, concept) GROUP BY ALL),
  fr AS MATERIALIZED (SELECT kind, name, corr(position, anchor) AS r FROM fp WHERE anchor IS NOT NULL GROUP BY ALL), fs AS (SELECT kind, name, concept, CASE WHEN r < 0 THEN -w ELSE w END AS w FROM f1 JOIN fr USING (kind, name)),
  fu AS (SELECT party, anchor, CASE WHEN r < 0 THEN -position ELSE position END AS position FROM fp JOIN fr USING (kind, name) WHERE kind = 'full')"""
_DEALT = lambda n, rows, v: f"""{n}m AS (SELECT draw, {v} AS v, anchor, row_number() OVER (PARTITION BY draw ORDER BY party) AS r, row_number() OVER (PARTITION BY draw ORDER BY md5(draw || '|' || party)) AS s FROM {rows}, range(1, 501) t(draw)),
  {n}n AS (SELECT x.draw, corr(x.v, y.anchor) AS c FROM {n}m x JOIN {n}m y ON x.draw = y.draw AND x.r = y.s GROUP BY 1), {n}o AS (SELECT corr({v}, anchor) AS r, count(*) AS n FROM {rows}), {n}p AS (SELECT avg(CASE WHEN abs(c) >= abs(r) - 1e-12 THEN 1.0 ELSE 0.0 END) AS p FROM {n}n, {n}o)"""  # noqa: E731
_MET = lambda m, v, rest="", name="NULL": f"SELECT '{m}' AS metric, {name}::VARCHAR AS name, {r6(f'({v})::DOUBLE')} AS value {rest}"
_METRICS = [
    _MET("observed_anchor_correlation", "r", "FROM uo"), _MET("anchors", "n", "FROM uo"), _MET("anchor_permutation_p", "p", "FROM up"), _MET("center_correlation", "r", "FROM co"), _MET("center_permutation_p", "p", "FROM cp"),
    _MET("bootstrap_anchor_corr_mean", "avg(abs(r))", "FROM fr WHERE kind = 'draw'"), _MET("bootstrap_anchor_corr_std", "stddev_pop(abs(r))", "FROM fr WHERE kind = 'draw'"), _MET("anchor_corr_bootstrap", "abs(r)", "FROM fr WHERE kind = 'draw'", "name"),
    _MET("leave_one_anchor_out", "abs(corr(x.position, u.position))", "FROM fp x JOIN fu u USING (party) WHERE kind = 'without' GROUP BY name", "name"), _MET("weight", "w", "FROM fs WHERE kind = 'full'", "concept"),
    *[_MET(f"weight_bootstrap_{m}", v, "FROM fs WHERE kind = 'draw' GROUP BY concept", "concept") for m, v in (("mean", "avg(w)"), ("std", "stddev_samp(w)"), ("q10", "quantile_cont(w, 0.1)"), ("q90", "quantile_cont(w, 0.9)"))],
]


@query("axis_validation", X.with_m(f"{_AXIS}, {_TAKEN}, {_FITTED}, iv AS (SELECT party, median(position) AS center, anchor FROM ps JOIN anchors USING (party) GROUP BY ALL), fa AS (SELECT * FROM fu WHERE anchor IS NOT NULL), {_DEALT('c', 'iv', 'center')}, {_DEALT('u', 'fa', 'position')} {' UNION ALL '.join(_METRICS)}"))
def axis_validation(spark, sf):
    z = graphs.zscores(cut(_long(spark, sf)), [])  # a row per year, party and concept, read by several steps
    centers = axis.intervals(axis.positions(z, axis.anchor_weights(z, X.anchors(spark)), ["year"]))
    return rounded(axis.validation(z, X.anchors(spark), centers, ["year"], _BOOT))


# regressions
def _macro(spark, sf):
    return X.macro_monthly(spark, sf).na.drop()


@query("newey_west")
def newey_west(spark, sf):
    p = _macro(spark, sf).withColumn("model", F.explode(F.array(F.lit("even"), F.lit("all")))).where("model = 'all' or year(month) % 2 = 0")
    raw = models.newey_west(p, ["model"], "month", "s1", ["s2", "s3"])
    std = models.newey_west(p, ["model"], "month", "s1", ["s2", "s3"], standardize=True).select("model", "variable", F.col("beta").alias("standardized_beta"))
    return rounded(raw.join(std, ["model", "variable"]))


_SPECS = [("h1", "s1", ["s2"], ["s3"], "+"), ("h2", "s2", ["s3"], ["s4"], "+"), ("h3", "s3", ["s4"], ["s5"], "-"), ("h4", "s4", ["s5"], ["s1"], "+"), ("h5", "s5", ["s1"], ["s2"], "-")]


@query("hypothesis_models")
def hypothesis_models(spark, sf):
    p, out = _macro(spark, sf), None
    for name, y, xs, controls, _ in _SPECS:
        c = models.newey_west(p.withColumn("model", F.lit(name)), ["model"], "month", y, [*xs, *controls])
        out = c if out is None else out.unionByName(c)
    specs = spark.createDataFrame([(n, xs[0], e) for n, _, xs, _, e in _SPECS], "model string, primary string, expected string")
    return rounded(models.supported(out, specs, ["model"]))


@query("leave_one_event_out")
def leave_one_event_out(spark, sf):
    """The two last models, each refitted without the months around one event: the standardised coefficient of its primary predictor."""
    e = F.broadcast(_events(spark, sf).select(F.col("event").alias("left_out"), "event_month"))
    p = _macro(spark, sf).join(e, ~F.col("month").between(F.add_months("event_month", -1), F.add_months("event_month", 2)))
    fits = [models.newey_west(p.withColumn("model", F.lit(n)), ["model", "left_out"], "month", y, [*xs, *more], standardize=True).where(F.col("variable") == xs[0]) for n, y, xs, more, _ in _SPECS[-2:]]
    return rounded(fits[0].unionByName(fits[1]))


@query("granger")
def granger(spark, sf):
    return rounded(models.granger(_macro(spark, sf), "month", [("s1", "s2"), ("s2", "s3"), ("s3", "s4"), ("s4", "s5")]))


# tail probabilities, which SQL has no functions for
@query("correlation_table_p")
def correlation_table_p(spark, sf):
    c = stats.correlations(X.macro_monthly(spark, sf), "month", [f"s{i}" for i in range(1, 6)])
    return rounded(stats.correlation_p(c))


@query("mann_kendall_p")
def mann_kendall_p(spark, sf):
    p = X.macro_monthly(spark, sf).select(F.lit("s1").alias("series"), "month", F.col("s1").alias("v")).where("v is not null")
    return rounded(stats.mann_kendall(p, ["series"], "month", "v").withColumn("p_value", D.normal_p("z")))


@query("two_sample_t_p")
def two_sample_t_p(spark, sf):
    m = X.mentions(spark, sf).withColumn("bloc", X.bloc(F.col("party"))).groupBy("year", "concept", "bloc").agg(F.avg("score").alias("v"))
    t = stats.two_sample(m, ["concept"], "bloc", "government", "opposition", "v")
    return rounded(t.select("concept", "student_t", D.t_p("student_t", (F.col("n1") + F.col("n2") - 2).cast("double")).alias("p_value")))


@query("rate_ratio_test_p")
def rate_ratio_test_p(spark, sf):
    from parlance.operators import events

    c = X.mentions(spark, sf).groupBy("month").agg(F.sum("neg").alias("neg"), F.sum("mention_count").alias("n"))
    r = events.rate_ratio(joins.stage_windows(_events(spark, sf)).join(c, "month"), ["event"], "neg", "n")
    return rounded(r.select("event", "log_ratio", "se", "z", D.normal_p("z").alias("p_value")))


# comparison of models on the same items: raters are the models, the longest the truth
_MODELS = ["r0", "r1", "r3"]
_B = 2000
_BM = "rt AS (SELECT doc_id, " + ", ".join(f"CASE WHEN n_chars > {k} THEN 'long' ELSE 'short' END AS r{i}" for i, k in enumerate((400, 800, 1000, 1500, 3000))) + " FROM documents), ln AS (UNPIVOT rt ON r0, r1, r3 INTO NAME model VALUE prediction)"
_BF = f"{resample.draws_sql(_B)}, mu AS MATERIALIZED (SELECT ln.*, {resample.seed_sql("doc_id::VARCHAR")} AS seed FROM ln), mc AS (SELECT draw, model, r2 AS truth, prediction, sum({resample.weight_sql("seed")}) AS n FROM mu, dr GROUP BY ALL HAVING n > 0), ml AS (SELECT draw, model, truth AS label, n AS s, 0 AS p, CASE WHEN truth = prediction THEN n ELSE 0 END AS h FROM mc UNION ALL SELECT draw, model, prediction, 0, n, 0 FROM mc), mf AS (SELECT draw, model, label, coalesce(2 * sum(h) / nullif(sum(s) + sum(p), 0)::DOUBLE, 0) AS f1 FROM ml GROUP BY ALL), mm AS (SELECT draw, model, avg(f1) AS macro_f1 FROM mf GROUP BY ALL)"


@query("bootstrap_metric_diff", f"WITH {_BM}, {_BF}, dd AS (SELECT x.model AS a, y.model AS b, y.macro_f1 - x.macro_f1 AS d FROM mm x JOIN mm y ON x.draw = y.draw AND x.model < y.model) SELECT a, b, {r6('avg(d)')} AS difference, {r6('quantile_cont(d, 0.025)')} AS low, {r6('quantile_cont(d, 0.975)')} AS high, {r6('avg(CASE WHEN d <= 0 THEN 1.0 ELSE 0.0 END)')} AS p_one_sided FROM dd GROUP BY ALL")
def bootstrap_metric_diff(spark, sf):
    s = models.bootstrap_f1(_raters(spark, sf), "doc_id", "r2", _MODELS, "short", _B)
    return rounded(models.metric_differences(s, "macro_f1"))


_MF = "ma AS (SELECT model, r2 AS truth, prediction, count(*) AS n FROM ln GROUP BY ALL), mb AS (SELECT model, truth AS label, n AS s, 0 AS p, CASE WHEN truth = prediction THEN n ELSE 0 END AS h FROM ma UNION ALL SELECT model, prediction, 0, n, 0 FROM ma), mg AS (SELECT model, label, sum(s) AS s, coalesce(2 * sum(h) / nullif(sum(s) + sum(p), 0)::DOUBLE, 0) AS f1 FROM mb GROUP BY ALL), mh AS (SELECT model, avg(f1) AS macro_f1, max(CASE WHEN label = 'short' THEN f1 END) AS negative_f1, sum(f1 * s) / sum(s) AS weighted_f1 FROM mg GROUP BY 1)"


@query("model_choice", f"WITH {_BM}, {_MF}, bs AS (SELECT * FROM mh WHERE model <> 'r0' ORDER BY macro_f1 DESC, negative_f1 DESC, weighted_f1 DESC, model DESC LIMIT 1), ow AS (SELECT * FROM mh WHERE model = 'r0') SELECT bs.model, CASE WHEN bs.macro_f1 - ow.macro_f1 >= 0.08 AND bs.negative_f1 - ow.negative_f1 >= 0.1 THEN 'replace_primary' WHEN bs.macro_f1 - ow.macro_f1 >= 0.03 THEN 'keep_with_robustness_check' ELSE 'keep_primary' END AS rule, {r6('bs.macro_f1 - ow.macro_f1')} AS macro_gain, {r6('bs.negative_f1 - ow.negative_f1')} AS negative_gain FROM bs, ow")
def model_choice(spark, sf):
    return rounded(models.choose(models.f1_scores(_raters(spark, sf).unpivot(["doc_id", "r2"], _MODELS, "model", "prediction"), "r2", "short"), "r0"))
