"""Registered queries: betweenness, directed party metrics by layer, and what is chosen by them.

The SQL twins unroll the rounds: distances by repeated squaring, path counts and dependencies hop by hop.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.operators import axis, findings, graphs, joins, panels, paths
from parlance.operators.lineage import cut

from . import fixtures as X
from .network_queries import _PRE, _WAYS
from .panel_queries import LAYERED
from .registry import query
from .sqlkit import r6, rounded
from .study_queries import _AXIS, _COS, _knn, _long, _positions

HOPS = 12
_LAYERS = ("total", "positive", "negative")


def _far_sql(arcs: str) -> str:
    """q5 (year, a, b, d): distances of the arcs (year, a, b, d), 32 steps, more than the nodes need."""
    square = lambda i: f"q{i + 1} AS MATERIALIZED (SELECT year, a, b, min(d) AS d FROM (SELECT * FROM q{i} UNION ALL SELECT x.year, x.a, y.b, x.d + y.d FROM q{i} x JOIN q{i} y ON x.year = y.year AND x.b = y.a AND x.a <> y.b) GROUP BY ALL)"
    return f"q0 AS MATERIALIZED (SELECT year, a, b, min(d) AS d FROM {arcs} GROUP BY ALL), " + ", ".join(square(i) for i in range(5))


def _between_sql(nodes: str) -> str:
    """bw (year, node, betweenness) over q0 and q5; ``nodes`` (year, node)."""
    hops = lambda n, here, there: ", ".join(f"{n}{i + 1} AS MATERIALIZED (SELECT year, x.a, tg.{there} AS node, sum(x.v) AS v FROM {n}{i} x JOIN tg USING (year, a) WHERE x.node = tg.{here} GROUP BY ALL)" for i in range(HOPS))
    total = lambda n: " UNION ALL ".join(f"SELECT * FROM {n}{i}" for i in range(HOPS + 1))
    return f"""rc AS MATERIALIZED (SELECT * FROM q5 UNION ALL SELECT year, node, node, 0.0 FROM {nodes}),
      tg AS MATERIALIZED (SELECT x.year, x.a, e.a AS u, e.b AS v FROM rc x JOIN q0 e ON x.year = e.year AND x.b = e.a JOIN rc y ON y.year = x.year AND y.a = x.a AND y.b = e.b WHERE abs(x.d + e.d - y.d) <= {paths.SAME} * y.d),
      f0 AS (SELECT year, node AS a, node, 1.0::DOUBLE AS v FROM {nodes}), {hops("f", "u", "v")}, sg AS MATERIALIZED (SELECT year, a, node, sum(v) AS v FROM ({total("f")}) GROUP BY ALL),
      g0 AS (SELECT year, a, node, 1 / v AS v FROM sg), {hops("g", "v", "u")}, bk AS (SELECT year, a, node, sum(v) AS v FROM ({total("g")}) GROUP BY ALL),
      bp AS (SELECT year, node, sum(bk.v * sg.v - 1) AS s FROM bk JOIN sg USING (year, a, node) WHERE a <> node GROUP BY ALL), bc AS (SELECT year, count(*) AS n FROM {nodes} GROUP BY 1),
      bw AS (SELECT year, node, CASE WHEN n > 2 THEN coalesce(s, 0) / ((n - 1) * (n - 2)) ELSE 0 END AS betweenness FROM {nodes} JOIN bc USING (year) LEFT JOIN bp USING (year, node))"""


_BOTH = "(SELECT year, a, b, 1 / w AS d FROM kn WHERE w > 0 UNION ALL SELECT year, b, a, 1 / w FROM kn WHERE w > 0)"


@query("betweenness", X.with_m(f"{_PRE}, {_far_sql(_BOTH)}, nd AS (SELECT DISTINCT year, party AS node FROM lo), {_between_sql('nd')} SELECT year, node, {r6('betweenness')} AS betweenness FROM bw", nation=True))
def betweenness(spark, sf):
    long = cut(_long(spark, sf, True))  # a row per year, nation and concept, read by every hop
    nodes = long.select("year", F.col("party").alias("node")).distinct()
    return rounded(paths.betweenness(paths.both_ways(_knn(spark, sf, long), ["year"], "distance"), nodes, ["year"]))


# directed networks of a year in three layers
_E = f"{X.DIRECTED_SQL}, ev AS (SELECT year, source, target, sum(total) AS total, sum(positive) AS positive, sum(negative) AS negative FROM directed GROUP BY ALL), eu AS (UNPIVOT ev ON total, positive, negative INTO NAME layer VALUE w), ed AS MATERIALIZED (SELECT year || ':' || layer AS year, source AS a, target AS b, w, 1 / w AS d FROM eu WHERE w > 0), nd AS MATERIALIZED (SELECT DISTINCT year || ':' || layer AS year, node FROM (SELECT year, unnest([source, target]) AS node FROM ev), (VALUES ('total'), ('positive'), ('negative')) l(layer))"
_RANK = "pc AS MATERIALIZED (SELECT year, a, b, w / sum(w) OVER (PARTITION BY year, a) AS p FROM ed), pn AS MATERIALIZED (SELECT year, node, count(*) OVER (PARTITION BY year) AS n, (year, node) IN (SELECT (year, a) FROM ed) AS leads FROM nd), k0 AS (SELECT year, node, 1 / n::DOUBLE AS rank FROM pn), " + ", ".join(
    f"i{i} AS MATERIALIZED (SELECT year, b AS node, sum(rank * p) AS v FROM k{i} JOIN pc USING (year) WHERE node = a GROUP BY ALL), j{i} AS MATERIALIZED (SELECT year, sum(CASE WHEN leads THEN 0 ELSE rank END) AS v FROM k{i} JOIN pn USING (year, node) GROUP BY 1), k{i + 1} AS MATERIALIZED (SELECT year, node, 0.15 / n + 0.85::DOUBLE * (coalesce(i{i}.v, 0) + j{i}.v / n) AS rank FROM pn LEFT JOIN i{i} USING (year, node) JOIN j{i} USING (year))"
    for i in range(40)
)


def _layers(spark, sf):
    """Edges (year, layer, source, target, w, distance) of positive weight, and all parties of each year in each layer."""
    e = graphs.directed_edges(X.directed(spark, sf), ["year"])
    nodes = e.select("year", F.explode(F.array("source", "target")).alias("node")).distinct().select("year", F.explode(F.array(*map(F.lit, _LAYERS))).alias("layer"), "node")
    return graphs.layer_arcs(e, ["year"], list(_LAYERS)), nodes


@query("directed_metrics", f"""WITH {_E}, {_far_sql("(SELECT year, a, b, d FROM ed)")}, {_between_sql("nd")}, {_RANK}, so AS (SELECT year, a AS node, sum(w) AS o FROM ed GROUP BY ALL), si AS (SELECT year, b AS node, sum(w) AS i FROM ed GROUP BY ALL), cr AS (SELECT year, a AS node, count(*) AS r, sum(d) AS s FROM q5 GROUP BY ALL)
  SELECT split_part(year, ':', 1)::INTEGER AS year, split_part(year, ':', 2) AS layer, node, {r6('coalesce(o, 0)')} AS out_strength, {r6('coalesce(i, 0)')} AS in_strength, {r6('betweenness')} AS betweenness, {r6('coalesce(r / s * (r / (n - 1)::DOUBLE), 0)')} AS closeness, {r6('rank')} AS pagerank
  FROM bw JOIN pn USING (year, node) JOIN k40 USING (year, node) LEFT JOIN so USING (year, node) LEFT JOIN si USING (year, node) LEFT JOIN cr USING (year, node)""")
def directed_metrics(spark, sf):
    return rounded(graphs.directed_metrics(*_layers(spark, sf), ["year", "layer"]))


@query("directed_summary", f"""WITH {_E}, sn AS (SELECT year, count(*) AS n FROM nd GROUP BY 1), se AS (SELECT x.year, count(*) AS e, avg(CASE WHEN y.w IS NOT NULL THEN 1.0 ELSE 0.0 END) AS bin, coalesce(sum(CASE WHEN x.a < x.b AND y.w IS NOT NULL THEN least(x.w, y.w) END), 0) / sum(x.w) AS wgt FROM ed x LEFT JOIN ed y ON x.year = y.year AND x.a = y.b AND x.b = y.a GROUP BY 1)
  SELECT split_part(year, ':', 1)::INTEGER AS year, split_part(year, ':', 2) AS layer, n AS nodes, coalesce(e, 0) AS edges, {r6('coalesce(e, 0) / (n * (n - 1))::DOUBLE')} AS density, {r6('bin')} AS binary_reciprocity, {r6('wgt')} AS weighted_reciprocity FROM sn LEFT JOIN se USING (year)""")
def directed_summary(spark, sf):
    return rounded(graphs.directed_summary(*_layers(spark, sf), ["year", "layer"]))


# the broker of all terms and layers: similarity networks of nations over concepts, pruned, by betweenness
_TL = f"{LAYERED}, {X.TERMS_SQL}, lo AS (SELECT term || ':' || layer AS year, party, concept, sum(weight) AS value FROM l JOIN terms ON date BETWEEN start AND stop GROUP BY ALL)"
_PRUNED = "kn AS MATERIALIZED (SELECT year, a, b, w FROM bx WHERE n <= 2 OR tree OR extra <= rest)"


@query("top_broker_overall", X.with_m(f"{_TL}, {_COS('value', 'lo')}, {_WAYS}, {_PRUNED}, {_far_sql(_BOTH)}, nd AS (SELECT DISTINCT year, party AS node FROM lo), {_between_sql('nd')} SELECT split_part(year, ':', 1)::INTEGER AS term, split_part(year, ':', 2) AS layer, node AS party, {r6('betweenness')} AS betweenness FROM bw ORDER BY round(betweenness, 9) DESC, year DESC, node DESC LIMIT 1", nation=True))
def top_broker_overall(spark, sf):
    m = joins.term_of(X.mentions(spark, sf, True), X.terms(spark)).where("term IS NOT NULL")
    long = panels.layered(m).groupBy("term", "layer", "party", "concept").agg(F.sum("weight").alias("value"))
    return rounded(graphs.layer_brokers(long, ["term", "layer"], "party", "value").transform(findings.largest, "betweenness", ["term", "layer", "party"]))


@query("regime_counts", X.with_m(f"{_AXIS}, {X.TERMS_SQL}, sp AS (SELECT term, max(position) - min(position) AS spread FROM ps JOIN terms ON make_date(year, 6, 1) BETWEEN start AND stop GROUP BY term), sc AS (SELECT spread - lag(spread) OVER (ORDER BY term) AS d FROM sp) SELECT CASE WHEN round(d, 9) > 0 THEN 'widening' WHEN round(d, 9) < 0 THEN 'narrowing' ELSE 'level' END AS regime, count(*) AS terms FROM sc WHERE d IS NOT NULL GROUP BY 1"))
def regime_counts(spark, sf):
    p = joins.term_of(_positions(spark, sf).withColumn("date", F.make_date("year", F.lit(6), F.lit(1))), X.terms(spark))
    return findings.regimes(axis.spread(p.where("term IS NOT NULL"), ["term"]).select("term", "spread"), "term", "spread")
