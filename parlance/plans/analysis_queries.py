"""Registered queries over the monthly analysis panel: speeches, layer features and macro indices on one spine of months."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.functions import distributions as D
from parlance.operators import graphs, joins, macro, panels, series, stats

from . import fixtures as X
from .panel_queries import LAYERED
from .registry import query
from .sqlkit import r6, rounded

_SPINE = f"{X.TERMS_SQL}, sp AS (SELECT DISTINCT CAST(unnest(generate_series(start, stop, INTERVAL 1 MONTH)) AS DATE) AS month FROM terms)"
_BLOCS = ["government", "opposition"]
_LAYERS = ["total", "positive", "negative"]
_CRISIS = ["constitutional_conflict", "security_conflict"]

# speeches: whole and blocs
_WHOLE = {
    "speeches": "count(DISTINCT speech_id)", "speakers": "count(DISTINCT speaker)", "words": "sum(mention_count)::BIGINT", "mean_words": "avg(mention_count)", "mean_score": "avg(score)",
    **{f"{k}_share": f"avg(CASE WHEN label = '{k}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)" for k in ("positive", "negative", "mixed")},
}
_EACH = {f"{b}_{n}": (b, n) for b in _BLOCS for n in ("speeches", "speakers", "words", "positive_share", "negative_share")}
_SPEECH_SQL = f"""un AS (SELECT *, 'all' AS g FROM m UNION ALL SELECT *, {X.BLOC_SQL} AS g FROM m), pa AS (SELECT month, g, {", ".join(f"{v} AS {n}" for n, v in _WHOLE.items())} FROM un GROUP BY ALL),
  pw AS (SELECT month, {", ".join(f"max(CASE WHEN g = 'all' THEN {n} END) AS {n}" for n in _WHOLE)}, {", ".join(f"max(CASE WHEN g = '{b}' THEN {n} END) AS {c}" for c, (b, n) in _EACH.items())} FROM pa GROUP BY month),
  speech AS MATERIALIZED (SELECT sp.month, pw.* EXCLUDE (month), {", ".join(f"{b}_speeches / nullif({b}_speakers, 0)::DOUBLE AS {b}_speeches_per_speaker" for b in _BLOCS)}, {", ".join(f"{b}_speeches / nullif(speeches, 0)::DOUBLE AS {b}_speech_share" for b in _BLOCS)} FROM sp LEFT JOIN pw ON pw.month = sp.month)"""
_COUNTS = [n for n in [*_WHOLE, *_EACH] if n.endswith(("speeches", "speakers", "words")) and n != "mean_words"]
_RATIOS = [n for n in [*_WHOLE, *_EACH] if n not in _COUNTS] + [f"{b}_{n}" for n in ("speeches_per_speaker", "speech_share") for b in _BLOCS]


def _rounded_sql(names: list[str]) -> str:
    return ", ".join(f"{r6(n)} AS {n}" for n in names)


def _spine(spark):
    return joins.month_spine(X.terms(spark))


def _speech(spark, sf):
    return panels.monthly_panel(X.mentions(spark, sf), _spine(spark), X.bloc(F.col("party")), _BLOCS)


@query("monthly_speech_panel", X.with_m(f"{_SPINE}, {_SPEECH_SQL} SELECT month, {', '.join(_COUNTS)}, {_rounded_sql(_RATIOS)} FROM speech"), dates="month")
def monthly_speech_panel(spark, sf):
    return rounded(_speech(spark, sf))


# layers, categories and concepts
_CELLS = {f"{c.lower()}_{k}": f"layer = '{k}' AND {of} = '{c}'" for of, names in (("category", X.CATEGORIES), ("concept", X.CONCEPTS)) for c in names for k in _LAYERS}
_FEATURES_SQL = f"""{LAYERED}, lw AS (SELECT month, {", ".join(f"sum(CASE WHEN layer = '{k}' THEN weight END) AS {k}_layer_weight" for k in _LAYERS)}, {", ".join(f"sum(CASE WHEN {w} THEN weight END) AS {n}_weight" for n, w in _CELLS.items())} FROM l GROUP BY month),
  feats AS MATERIALIZED (SELECT sp.month, lw.* EXCLUDE (month), {", ".join(f"{n}_weight / nullif(total_layer_weight, 0) AS {n}_share" for n in _CELLS)}, coalesce(democratic_reform_positive_weight, 0) / nullif(total_layer_weight, 0) AS reform_positive_share,
    ({" + ".join(f"{c}_negative_weight" for c in _CRISIS)}) / nullif(total_layer_weight, 0) AS crisis_negative_share, positive_layer_weight / nullif(negative_layer_weight, 0) AS positive_negative_ratio FROM sp LEFT JOIN lw ON lw.month = sp.month)"""
_FEATURES = [f"{k}_layer_weight" for k in _LAYERS] + [f"{n}_{x}" for n in _CELLS for x in ("weight", "share")] + ["reform_positive_share", "crisis_negative_share", "positive_negative_ratio"]


def _features(spark, sf):
    return panels.layer_features(X.mentions(spark, sf), _spine(spark), X.CATEGORIES, X.CONCEPTS, "democratic_reform", _CRISIS)


@query("layer_feature_panel", X.with_m(f"{_SPINE}, {_FEATURES_SQL} SELECT month, {_rounded_sql(_FEATURES)} FROM feats"), dates="month")
def layer_feature_panel(spark, sf):
    return rounded(_features(spark, sf))


# macro indices: the five series stand for a currency, an index, prices, a rate and reserves
def _z(c: str) -> str:
    return f"(({c} - avg({c}) OVER ()) / nullif(stddev_pop({c}) OVER (), 0))"


def _mean_sql(signed: dict[str, str]) -> str:
    there = " + ".join(f"({_z(c)} IS NOT NULL)::INT" for c in signed)
    return f"({' + '.join(f'coalesce({sign}{_z(c)}, 0)' for c, sign in signed.items())}) / nullif({there}, 0)"


_VOLATILITY = _mean_sql({"usd_return": "", "index_return": "-", "inflation_mom": ""})
_STRESS = _mean_sql({"inflation_yoy": "", "usd_return": "", "index_return": "-", "rate": "", "reserves_mom": "-"})
_INDEX_SQL = f"""{X.MACRO_SQL}, mr AS (SELECT sp.month, s4 AS rate, 100 * (s1 / nullif(lag(s1) OVER w, 0) - 1) AS usd_return, 100 * (s2 / nullif(lag(s2) OVER w, 0) - 1) AS index_return, 100 * (s3 / nullif(lag(s3) OVER w, 0) - 1) AS inflation_mom,
    100 * (s3 / nullif(lag(s3, 12) OVER w, 0) - 1) AS inflation_yoy, 100 * (s5 / nullif(lag(s5) OVER w, 0) - 1) AS reserves_mom FROM sp LEFT JOIN macro ON macro.month = sp.month WINDOW w AS (ORDER BY sp.month)),
  mx AS MATERIALIZED (SELECT *, {_VOLATILITY} AS volatility, {_STRESS} AS stress, -({_STRESS}) AS improvement FROM mr)"""
_INDICES = ["usd_return", "index_return", "inflation_mom", "inflation_yoy", "rate", "reserves_mom", "volatility", "stress", "improvement"]


def _indices(spark, sf):
    w = series.ordered("month")
    p = _spine(spark).select("month").distinct().join(X.macro_monthly(spark, sf), "month", "left")
    p = p.select(
        "month", F.col("s4").alias("rate"), series.pct_change("s1", w).alias("usd_return"), series.pct_change("s2", w).alias("index_return"), series.pct_change("s3", w).alias("inflation_mom"),
        series.pct_change("s3", w, 12).alias("inflation_yoy"), series.pct_change("s5", w).alias("reserves_mom"),
    )
    return macro.indices(p)


@query("stress_indices", f"WITH {_SPINE}, {_INDEX_SQL} SELECT month, {_rounded_sql(_INDICES)} FROM mx", dates="month")
def stress_indices(spark, sf):
    return rounded(_indices(spark, sf))


# the analysis panel
_LEADS = ["stress", "index_return"]
_PANEL_SQL = f"""{_SPINE}, {_SPEECH_SQL}, {_FEATURES_SQL}, {_INDEX_SQL}, an AS MATERIALIZED (SELECT speech.*, feats.* EXCLUDE (month), mx.* EXCLUDE (month), {", ".join(f"lead({c}) OVER w AS lead1_{c}" for c in _LEADS)}
  FROM speech JOIN feats ON feats.month = speech.month JOIN mx ON mx.month = speech.month WINDOW w AS (ORDER BY speech.month))"""


def _analysis(spark, sf):
    out = _speech(spark, sf).join(_features(spark, sf), "month").join(_indices(spark, sf), "month")
    w = series.ordered("month")  # a panel of months
    return out.withColumns({f"lead1_{c}": F.lead(c).over(w) for c in _LEADS})


_SUMS = ["speeches", "words"]
_MEANS = [
    "positive_share", "negative_share", "government_speech_share", "opposition_speech_share", "opposition_speeches_per_speaker", "macro_economy_total_share", "macro_economy_positive_share",
    "macro_economy_negative_share", "economy_negative_share", "reform_positive_share", "crisis_negative_share", "stress", "volatility", "usd_return", "index_return", "inflation_yoy", "rate", "reserves_mom",
]


@query("yearly_analysis_panel", X.with_m(f"{_PANEL_SQL} SELECT CAST(year(month) AS INTEGER) AS year, {', '.join(f'coalesce(sum({c}), 0)::BIGINT AS {c}' for c in _SUMS)}, {', '.join(f'{r6(f'avg({c})')} AS {c}' for c in _MEANS)}, count(*) FILTER (WHERE speeches > 0) AS months_with_speeches FROM an GROUP BY 1"))
def yearly_analysis_panel(spark, sf):
    return rounded(panels.yearly_panel(_analysis(spark, sf), _SUMS, _MEANS))


_VARIABLES = [
    "opposition_speeches_per_speaker", "macro_economy_negative_share", "economy_negative_share", "reform_positive_share", "crisis_negative_share", "positive_negative_ratio", "security_conflict_negative_share",
    "constitutional_conflict_negative_share", "mean_score", "opposition_speech_share", "stress", "volatility", "usd_return", "index_return", "inflation_yoy", "lead1_stress", "lead1_index_return",
]
# ranks of values to ten digits, as sums in another order differ in the last ones
_LONG_SQL = " UNION ALL ".join(f"SELECT month, '{c}' AS name, round({c}::DOUBLE, 10) AS v FROM an WHERE {c} IS NOT NULL" for c in _VARIABLES)


def _ranks(keys: str, of: str) -> str:
    return ", ".join(f"rank() OVER (PARTITION BY {keys} ORDER BY {c}) + (count(*) OVER (PARTITION BY {keys}, {c}) - 1) / 2.0::DOUBLE AS r{c}" for c in of)


def _ten(panel, names):
    return panel.select("month", *[F.round(F.col(c).cast("double"), 10).alias(c) for c in dict.fromkeys(names)])


@query("correlation_table_analysis", X.with_m(f"{_PANEL_SQL}, lg AS ({_LONG_SQL}), bo AS (SELECT p.name AS a, q.name AS b, p.v AS x, q.v AS y FROM lg p JOIN lg q ON p.month = q.month AND p.name < q.name), rk AS (SELECT *, {_ranks('a, b', 'xy')} FROM bo) SELECT a, b, count(*) AS n, {r6('corr(x, y)')} AS pearson, {r6('corr(rx, ry)')} AS spearman FROM rk GROUP BY ALL HAVING count(*) >= 8"))
def correlation_table_analysis(spark, sf):
    return rounded(stats.correlations(_ten(_analysis(spark, sf), _VARIABLES), "month", _VARIABLES))


_NAMED = [
    ("stress", "opposition_speeches_per_speaker"), ("inflation_yoy", "macro_economy_negative_share"), ("usd_return", "crisis_negative_share"),
    ("reform_positive_share", "index_return"), ("crisis_negative_share", "volatility"), ("positive_negative_ratio", "stress"),
]
_NAMED_SQL = " UNION ALL ".join(f"SELECT '{a}' AS x_name, '{b}' AS y_name, round({a}::DOUBLE, 10) AS x, round({b}::DOUBLE, 10) AS y FROM an WHERE {a} IS NOT NULL AND {b} IS NOT NULL" for a, b in _NAMED)


@query("correlation_pairs", X.with_m(f"{_PANEL_SQL}, lg AS ({_NAMED_SQL}), rk AS (SELECT *, {_ranks('x_name, y_name', 'xy')} FROM lg) SELECT x_name, y_name, count(*) AS n, {r6('regr_slope(y, x)')} AS slope, {r6('regr_intercept(y, x)')} AS intercept, {r6('corr(rx, ry)')} AS spearman FROM rk GROUP BY ALL"))
def correlation_pairs(spark, sf):
    return rounded(stats.fitted_pairs(_ten(_analysis(spark, sf), [c for p in _NAMED for c in p]), _NAMED))


_PREDICTED = [("macro_economy_negative_share", "stress"), ("reform_positive_share", "index_return"), ("crisis_negative_share", "usd_return")]
_LEAD_SQL = " UNION ALL ".join(f"SELECT '{a}' AS predictor, '{b}' AS outcome, {k}::INTEGER AS lead, round({a}::DOUBLE, 10) AS x, lead(round({b}::DOUBLE, 10), {k}) OVER (ORDER BY month) AS y FROM an" for a, b in _PREDICTED for k in (1, 2, 3))


def _led(spark, sf):
    return stats.lead_correlations(_ten(_analysis(spark, sf), [c for p in _PREDICTED for c in p]), "month", _PREDICTED)


@query("lead_sensitivity", X.with_m(f"{_PANEL_SQL}, lg AS (SELECT * FROM ({_LEAD_SQL}) WHERE x IS NOT NULL AND y IS NOT NULL), rk AS (SELECT *, {_ranks('predictor, outcome, lead', 'xy')} FROM lg) SELECT predictor, outcome, lead, count(*) AS n, {r6('corr(x, y)')} AS pearson, {r6('corr(rx, ry)')} AS spearman FROM rk GROUP BY ALL HAVING count(*) >= 8"))
def lead_sensitivity(spark, sf):
    return rounded(_led(spark, sf))


@query("lead_sensitivity_p")
def lead_sensitivity_p(spark, sf):
    return rounded(stats.correlation_p(_led(spark, sf)))


_CUTS = " UNION ALL ".join(f"SELECT {q}::DOUBLE AS quantile, (SELECT quantile_cont(stress, {q}) FROM qt) AS cutoff" for q in (0.7, 0.75, 0.8))
_OTHER = "NOT coalesce(stress >= cutoff, false)"


def _tested(spark, sf):
    return stats.threshold_tests(_ten(_analysis(spark, sf), ["stress", "opposition_speeches_per_speaker"]), "stress", "opposition_speeches_per_speaker")


@query("crisis_threshold_sensitivity", X.with_m(f"""{_PANEL_SQL}, qt AS (SELECT round(stress, 10) AS stress, round(opposition_speeches_per_speaker, 10) AS v FROM an), cu AS ({_CUTS}),
  gs AS (SELECT quantile, cutoff, count(v) FILTER (WHERE stress >= cutoff) AS n1, count(v) FILTER (WHERE {_OTHER}) AS n2, avg(v) FILTER (WHERE stress >= cutoff) AS m1, avg(v) FILTER (WHERE {_OTHER}) AS m2, var_samp(v) FILTER (WHERE stress >= cutoff) AS v1, var_samp(v) FILTER (WHERE {_OTHER}) AS v2 FROM qt, cu GROUP BY ALL)
  SELECT quantile, {r6('cutoff')} AS cutoff, n1 AS crisis_months, n2 AS other_months, {r6('m1')} AS crisis_mean, {r6('m2')} AS other_mean, {r6('CASE WHEN n1 >= 2 AND n2 >= 2 THEN (m1 - m2) / nullif(sqrt(v1 / n1 + v2 / n2), 0) END')} AS welch_t FROM gs"""))
def crisis_threshold_sensitivity(spark, sf):
    return rounded(_tested(spark, sf).drop("welch_df"))


@query("crisis_threshold_sensitivity_p")
def crisis_threshold_sensitivity_p(spark, sf):
    return rounded(_tested(spark, sf).select("quantile", "welch_t", D.t_p("welch_t", "welch_df").alias("welch_p")))


# the yearly series of the blocs: their correlation and trends
_YEARLY = f"g AS (SELECT year, concept, {X.BLOC_SQL} AS bloc, avg(score) AS v FROM m GROUP BY ALL), y AS (SELECT concept, year, max(CASE WHEN bloc = 'government' THEN v END) AS gov, max(CASE WHEN bloc = 'opposition' THEN v END) AS opp FROM g GROUP BY ALL)"


@query("bloc_series_trends", X.with_m(f"{_YEARLY} SELECT concept, count(*) AS years, {r6('corr(gov, opp)')} AS pearson, {r6('regr_slope(gov, year)')} AS government_slope, {r6('regr_slope(opp, year)')} AS opposition_slope, {r6('regr_slope(gov - opp, year)')} AS gap_slope FROM y GROUP BY concept"))
def bloc_series_trends(spark, sf):
    m = X.mentions(spark, sf).withColumn("bloc", X.bloc(F.col("party"))).groupBy("year", "concept", "bloc").agg(F.avg("score").alias("v"))
    at = lambda b: F.max(F.when(F.col("bloc") == b, F.col("v")))
    y = m.groupBy("concept", "year").agg(at("government").alias("gov"), at("opposition").alias("opp"))
    slope = lambda v: F.regr_slope(v, F.col("year"))
    return rounded(y.groupBy("concept").agg(F.count("*").alias("years"), F.corr("gov", "opp").alias("pearson"), slope(F.col("gov")).alias("government_slope"), slope(F.col("opp")).alias("opposition_slope"), slope(F.col("gov") - F.col("opp")).alias("gap_slope")))


# distances of blocs and of two parties by layer
_SIDE = {"a": f"{X.BLOC_SQL} = 'government'", "b": f"{X.BLOC_SQL} = 'opposition'", "p": "party = 'BUILDING'", "q": "party = 'MACHINERY'"}
_DOT = lambda x, y, k: f"sum(CASE WHEN layer = '{k}' THEN {x} * {y} END)"
_DISTANCES = {f"{n}_distance_{k}": f"1 - {_DOT(x, y, k)} / nullif(sqrt({_DOT(x, x, k)}) * sqrt({_DOT(y, y, k)}), 0)" for n, (x, y) in (("bloc", "ab"), ("pair", "pq")) for k in _LAYERS}


@query("semantic_distance", X.with_m(f"""{_SPINE}, {LAYERED}, ls AS (SELECT month, layer, concept, {", ".join(f"sum(CASE WHEN {c} THEN weight ELSE 0 END) AS {n}" for n, c in _SIDE.items())} FROM l GROUP BY ALL),
  ld AS (SELECT month, {", ".join(f"{r6(v)} AS {n}" for n, v in _DISTANCES.items())} FROM ls GROUP BY month) SELECT sp.month, ld.* EXCLUDE (month) FROM sp LEFT JOIN ld ON ld.month = sp.month"""), dates="month")
def semantic_distance(spark, sf):
    rows = panels.layered(X.mentions(spark, sf)).withColumn("bloc", X.bloc(F.col("party")))
    return rounded(graphs.layer_distances(rows, _spine(spark), ("government", "opposition"), ("BUILDING", "MACHINERY")))


# directed mentions by month
_NEAR = ["N1", "N2", "N3"]
_CROSS = "(source IN ('N1', 'N2', 'N3')) <> (target IN ('N1', 'N2', 'N3'))"
_TOPICS = ["ECONOMY", "STANDARD"]
_DSUM = {
    "positive_cross": f"CASE WHEN {_CROSS} THEN positive ELSE 0 END", "negative_cross": f"CASE WHEN {_CROSS} THEN negative ELSE 0 END", **{f"{t.lower()}_negative": f"CASE WHEN topic = '{t}' THEN negative ELSE 0 END" for t in _TOPICS},
    "pair_negative": "CASE WHEN (source = 'N1' AND target = 'N2') OR (source = 'N2' AND target = 'N1') THEN negative ELSE 0 END",
    "first_in_negative": "CASE WHEN target = 'N1' THEN negative ELSE 0 END", "second_in_negative": "CASE WHEN target = 'N2' THEN negative ELSE 0 END",
}
_LAGGED = ["negative_cross_share", "positive_cross_share", "pair_negative_share"]


def _tone_sql(t: str) -> str:
    return f"""x{t} AS (SELECT month, source, target, sum({t}) AS w FROM directed GROUP BY ALL HAVING sum({t}) > 0), y{t} AS (SELECT a.month, coalesce(sum(CASE WHEN a.source < a.target THEN least(a.w, b.w) END) FILTER (WHERE b.w IS NOT NULL), 0) / sum(a.w) AS {t}_reciprocity, count(*) / 600.0::DOUBLE AS {t}_density
      FROM x{t} a LEFT JOIN x{t} b ON a.month = b.month AND a.source = b.target AND a.target = b.source GROUP BY a.month)"""


_DOUBLES = ["total", "positive", "negative", *_DSUM, "positive_reciprocity", "negative_reciprocity", "positive_density", "negative_density", "negative_share", *[f"{n}_share" for n in _DSUM], *[f"{n}_lag1" for n in _LAGGED]]


@query("directed_monthly_panel", f"""WITH {X.DIRECTED_SQL}, {_SPINE}, {_tone_sql("positive")}, {_tone_sql("negative")}, ds AS (SELECT month, sum(total) AS total, sum(positive) AS positive, sum(negative) AS negative, count(DISTINCT speech_id) AS speeches, count(*) AS mentions, {", ".join(f"sum({v}) AS {n}" for n, v in _DSUM.items())} FROM directed GROUP BY month),
  dj AS (SELECT sp.month, ds.* EXCLUDE (month), positive_reciprocity, negative_reciprocity, coalesce(positive_density, 0) AS positive_density, coalesce(negative_density, 0) AS negative_density, negative / nullif(total, 0) AS negative_share, {", ".join(f"{n} / nullif({'positive' if n.startswith('positive') else 'negative'}, 0) AS {n}_share" for n in _DSUM)}
    FROM sp LEFT JOIN ds ON ds.month = sp.month LEFT JOIN ypositive p ON p.month = sp.month LEFT JOIN ynegative q ON q.month = sp.month),
  dl AS (SELECT *, {", ".join(f"lag({n}) OVER (ORDER BY month) AS {n}_lag1" for n in _LAGGED)} FROM dj) SELECT month, speeches, mentions, {_rounded_sql(_DOUBLES)} FROM dl""", dates="month")
def directed_monthly_panel(spark, sf):
    cross = F.col("source").isin(_NEAR) != F.col("target").isin(_NEAR)
    return rounded(graphs.directed_panel(X.directed(spark, sf), _spine(spark), cross, _TOPICS, ("N1", "N2"), 25))


# speakers, their main parties and the most active ones
@query("speaker_main_party", X.with_m("s AS (SELECT year, speaker, party, count(*) AS n FROM m GROUP BY ALL) SELECT year, speaker, arg_min(party, (-n, party)) AS party, max(n) AS n FROM s GROUP BY ALL"))
def speaker_main_party(spark, sf):
    return panels.main_party(X.mentions(spark, sf), ["year"])


@query("speaker_tops", X.with_m("""s AS (SELECT year, speaker, party, count(*) AS n FROM m GROUP BY ALL), mp AS (SELECT year, speaker, arg_min(party, (-n, party)) AS party, sum(n)::BIGINT AS n FROM s GROUP BY ALL),
  ra AS (SELECT *, row_number() OVER (PARTITION BY year ORDER BY n DESC, speaker) AS rank FROM mp), pn AS (SELECT year, party, sum(n) AS n FROM s GROUP BY ALL), pr AS (SELECT *, row_number() OVER (PARTITION BY year ORDER BY n DESC, party) AS k FROM pn),
  rp AS (SELECT s.*, row_number() OVER (PARTITION BY s.year, s.party ORDER BY s.n DESC, speaker) AS rank FROM s JOIN pr ON pr.year = s.year AND pr.party = s.party WHERE k <= 8 AND pr.n >= 20)
  SELECT year, 'all' AS list, rank::INTEGER AS rank, speaker, party, n FROM ra WHERE rank <= 20 UNION ALL SELECT year, party, rank::INTEGER, speaker, party, n FROM rp WHERE rank <= 15"""))
def speaker_tops(spark, sf):
    return panels.speaker_tops(X.mentions(spark, sf), "year")


@query("eda_overview", X.with_m("SELECT count(*) AS rows, 14::BIGINT AS columns, count(DISTINCT speech_id) AS transcripts, count(DISTINCT speaker) AS speakers, count(DISTINCT party) AS parties, count(DISTINCT date) AS dates FROM m"))
def eda_overview(spark, sf):
    return panels.overview(X.mentions(spark, sf), {"transcripts": "speech_id", "speakers": "speaker", "parties": "party", "dates": "date"})
