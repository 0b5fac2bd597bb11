"""Registered queries of the rollups (panels, eda, concentration)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from parlance.operators import mentions as M
from parlance.operators import panels as P

from . import fixtures as X
from .registry import query
from .sqlkit import bal, r6, rounded

LAYERED = """l AS (SELECT m.*, layer, salience * CASE layer WHEN 'total' THEN 1.0::DOUBLE WHEN 'positive' THEN greatest(score, 0.0) ELSE greatest(-score, 0.0) END AS weight
  FROM m, (VALUES ('total'), ('positive'), ('negative')) v(layer) WHERE layer = 'total' OR layer = label)"""


def _edges_sql(period: str = "") -> str:
    return X.with_m(f"""{LAYERED} SELECT layer, {period} party, concept, category, count(DISTINCT speech_id) AS speech_count, sum(mention_count)::BIGINT AS mention_count,
      sum(pos)::BIGINT AS pos, sum(neg)::BIGINT AS neg, {r6("sum(salience)")} AS salience, {r6("sum(weight)")} AS layer_weight,
      round_even({bal("sum(pos)", "sum(neg)")}, 4) AS score FROM l GROUP BY ALL""")


@query("layer_edges", _edges_sql())
def layer_edges(spark, sf):
    return rounded(P.layer_edges(X.mentions(spark, sf)))


@query("layer_edges_yearly", _edges_sql("year,"))
def layer_edges_yearly(spark, sf):
    return rounded(P.layer_edges(X.mentions(spark, sf), ["year"]))


@query("layer_edges_monthly", _edges_sql("month,"), dates="month")
def layer_edges_monthly(spark, sf):
    return rounded(P.layer_edges(X.mentions(spark, sf), ["month"]))


def _feature(keys: str, last: str = "concept") -> str:
    return f"""s AS (SELECT {keys}, {last}, sum(mention_count)::BIGINT AS mention_count, sum(pos)::BIGINT AS pos, sum(neg)::BIGINT AS neg FROM m GROUP BY ALL),
    f AS (SELECT *, {bal("pos", "neg")} AS balance, mention_count / greatest(sum(mention_count) OVER (PARTITION BY {keys}), 1)::DOUBLE AS agenda FROM s),
    x AS (SELECT *, balance * agenda AS feature FROM f)"""


@query("signed_agenda_feature", X.with_m(f"{_feature('party')} SELECT party, concept, mention_count, pos, neg, {r6('balance')} AS balance, {r6('agenda')} AS agenda, {r6('feature')} AS feature FROM x"))
def signed_agenda_feature(spark, sf):
    return rounded(P.signed_agenda_feature(X.mentions(spark, sf), ["party", "concept"]))


_PIVOT = ", ".join(f"coalesce({r6(f'''max(CASE WHEN concept = '{c}' THEN feature END)''')}, 0.0) AS {c}" for c in X.CONCEPTS)


@query("feature_matrix", X.with_m(f"{_feature('year, party')} SELECT year, party, {_PIVOT} FROM x GROUP BY year, party"))
def feature_matrix(spark, sf):
    f = P.signed_agenda_feature(X.mentions(spark, sf), ["year", "party", "concept"])
    return rounded(P.feature_matrix(f, ["year", "party"], X.CONCEPTS))


@query("feature_matrix_speaker", X.with_m(f"{_feature('speaker')} SELECT speaker, {_PIVOT} FROM x GROUP BY speaker"))
def feature_matrix_speaker(spark, sf):
    f = P.signed_agenda_feature(X.mentions(spark, sf), ["speaker", "concept"])
    return rounded(P.feature_matrix(f, ["speaker"], X.CONCEPTS))


@query("active_speakers", X.with_m("""t AS (SELECT speaker, party, sum(mention_count)::BIGINT AS mentions FROM m GROUP BY ALL)
  SELECT speaker, party, mentions FROM t WHERE mentions >= (SELECT greatest(8.0, quantile_cont(mentions, 0.4)) FROM t)"""))
def active_speakers(spark, sf):
    return P.active_speakers(X.mentions(spark, sf))


_RATES = f"""{r6(bal('pos', 'neg'))} AS balance, {r6('mentions / sum(mentions) OVER ()::DOUBLE')} AS agenda_share,
  {r6('CASE WHEN mentions > 0 THEN neg / mentions::DOUBLE ELSE 0 END')} AS negative_rate, {r6('CASE WHEN mentions > 0 THEN pos / mentions::DOUBLE ELSE 0 END')} AS positive_rate"""
_SUMS = "sum(mention_count)::BIGINT AS mentions, sum(pos)::BIGINT AS pos, sum(neg)::BIGINT AS neg"


@query("party_summary", X.with_m(f"s AS (SELECT party, {_SUMS} FROM m GROUP BY 1) SELECT party, mentions, pos, neg, {_RATES} FROM s"))
def party_summary(spark, sf):
    return rounded(P.party_summary(X.mentions(spark, sf)))


def _shares(period: str, item: str, where: str = "") -> str:
    return f"""s AS (SELECT {period}, {item}, {_SUMS} FROM m {where} GROUP BY ALL) SELECT *, {r6(f'mentions / nullif(sum(mentions) OVER (PARTITION BY {period}), 0)::DOUBLE')} AS agenda_share,
      {r6('pos / greatest(mentions, 1)::DOUBLE')} AS pos_rate, {r6('neg / greatest(mentions, 1)::DOUBLE')} AS neg_rate FROM s"""


@query("monthly_topic_panel", X.with_m(_shares("month", "category")), dates="month")
def monthly_topic_panel(spark, sf):
    return rounded(P.period_shares(X.mentions(spark, sf), ["month"], ["category"]))


@query("monthly_party_panel", X.with_m(_shares("month", "party", "WHERE category = 'macro_economy'")), dates="month")
def monthly_party_panel(spark, sf):
    return rounded(P.period_shares(X.mentions(spark, sf).where("category = 'macro_economy'"), ["month"], ["party"]))


@query("party_topic_monthly", X.with_m(_shares("month, party", "category")), dates="month")
def party_topic_monthly(spark, sf):
    return rounded(P.period_shares(X.mentions(spark, sf), ["month", "party"], ["category"]))


@query("panel_month_party_cat", X.with_m(f"""s AS (SELECT month, party, category, {_SUMS} FROM m GROUP BY ALL), t AS (SELECT month, party, sum(mentions)::BIGINT AS party_total FROM s GROUP BY ALL)
  SELECT s.*, party_total, {r6('mentions / greatest(party_total, 1)::DOUBLE')} AS agenda_share, {r6('pos / greatest(mentions, 1)::DOUBLE')} AS pos_rate, {r6('neg / greatest(mentions, 1)::DOUBLE')} AS neg_rate FROM s JOIN t USING (month, party)"""), dates="month")
def panel_month_party_cat(spark, sf):
    s = P.sums_by(X.mentions(spark, sf), ["month", "party", "category"])
    t = s.groupBy("month", "party").agg(F.sum("mentions").alias("party_total"))
    d, p = F.greatest("mentions", F.lit(1)), F.greatest("party_total", F.lit(1))
    out = s.join(t, ["month", "party"]).select("*", (F.col("mentions") / p).alias("agenda_share"), (F.col("pos") / d).alias("pos_rate"), (F.col("neg") / d).alias("neg_rate"))
    return rounded(out)


_WIDE = ", ".join(f"round(coalesce(sum(CASE WHEN category = '{c}' THEN mention_count END) / sum(mention_count)::DOUBLE, 0.0), 6) AS {c}" for c in X.CATEGORIES)


@query("agenda_series_wide", X.with_m(f"SELECT month, {_WIDE} FROM m GROUP BY month"), dates="month")
def agenda_series_wide(spark, sf):
    shares = P.period_shares(X.mentions(spark, sf), ["month"], ["category"])
    return rounded(P.series_wide(shares, "month", "category", "agenda_share", X.CATEGORIES))


@query("topic_year_share", X.with_m(f"SELECT year, {_WIDE} FROM m GROUP BY year HAVING sum(mention_count) > 0"))
def topic_year_share(spark, sf):
    shares = P.period_shares(X.mentions(spark, sf), ["year"], ["category"]).where("agenda_share is not null")
    return rounded(P.series_wide(shares, "year", "category", "agenda_share", X.CATEGORIES))


def _gov_opp_columns():
    out = {}
    for b in ("government", "opposition"):
        for c in ("constitutional_conflict", "democratic_reform"):
            for v in ("pos", "neg"):
                out[f"{b[:3]}_{c[:5]}_{v}"] = (b, c, v)
    return out


@query("gov_opp_year_stats", X.with_m("SELECT year, " + ", ".join(f"sum(CASE WHEN {X.BLOC_SQL} = '{b}' AND category = '{c}' THEN {v} ELSE 0 END)::BIGINT AS {n}" for n, (b, c, v) in _gov_opp_columns().items()) + " FROM m GROUP BY year"))
def gov_opp_year_stats(spark, sf):
    m = X.mentions(spark, sf).withColumn("bloc", X.bloc(F.col("party")))
    return m.groupBy("year").agg(*[F.sum(F.when((F.col("bloc") == b) & (F.col("category") == c), F.col(v)).otherwise(0)).alias(n) for n, (b, c, v) in _gov_opp_columns().items()])


@query("stress_index_year", X.with_m(f"SELECT year, {r6('''sum(CASE WHEN category = 'constitutional_conflict' THEN neg ELSE 0 END) / (sum(CASE WHEN category = 'democratic_reform' THEN pos ELSE 0 END) + 0.01::DOUBLE)''')} AS stress FROM m GROUP BY year"))
def stress_index_year(spark, sf):
    part = lambda c, v: F.sum(F.when(F.col("category") == c, F.col(v)).otherwise(0))
    return rounded(X.mentions(spark, sf).groupBy("year").agg((part("constitutional_conflict", "neg") / (part("democratic_reform", "pos") + F.lit(0.01))).alias("stress")))


@query("stress_index_month", X.with_m(f"""s AS (SELECT month, (sum(CASE WHEN category = 'constitutional_conflict' THEN neg ELSE 0 END) + 0.5::DOUBLE * sum(CASE WHEN category = 'security_conflict' THEN neg ELSE 0 END))
  / (sum(CASE WHEN category = 'democratic_reform' THEN pos ELSE 0 END) + 0.01::DOUBLE) AS stress FROM m GROUP BY month)
  SELECT month, {r6('stress')} AS stress, month = (SELECT arg_max(month, stress) FROM s) AS is_peak FROM s"""), dates="month")
def stress_index_month(spark, sf):
    part = lambda c, v: F.sum(F.when(F.col("category") == c, F.col(v)).otherwise(0))
    top = part("constitutional_conflict", "neg") + F.lit(0.5) * part("security_conflict", "neg")
    s = X.mentions(spark, sf).groupBy("month").agg((top / (part("democratic_reform", "pos") + F.lit(0.01))).alias("stress"))
    peak = s.agg(F.max_by("month", "stress").alias("peak"))
    return rounded(s.crossJoin(F.broadcast(peak)).select("month", "stress", (F.col("month") == F.col("peak")).alias("is_peak")))


def _dominance(period: str) -> str:
    return X.with_m(f"s AS (SELECT {period}, party, sum(mention_count)::BIGINT AS mentions FROM m WHERE category = 'macro_economy' GROUP BY ALL) SELECT *, {r6(f'mentions / sum(mentions) OVER (PARTITION BY {period})::DOUBLE')} AS share FROM s")


def _dominance_of(spark, sf, period):
    s = X.mentions(spark, sf).where("category = 'macro_economy'").groupBy(period, "party").agg(F.sum("mention_count").alias("mentions"))
    return rounded(s.withColumn("share", P.share(F.col("mentions"), [period])))


@query("dominance_year", _dominance("year"))
def dominance_year(spark, sf):
    return _dominance_of(spark, sf, "year")


@query("dominance_month", _dominance("month"), dates="month")
def dominance_month(spark, sf):
    return _dominance_of(spark, sf, "month")


@query("sentiment_balance_top", X.with_m(f"s AS (SELECT party, sum(pos)::BIGINT AS pos, sum(neg)::BIGINT AS neg FROM m GROUP BY 1) SELECT *, {r6('pos / (pos + neg + 0.001::DOUBLE)')} AS pos_share, {r6('neg / (pos + neg + 0.001::DOUBLE)')} AS neg_share FROM s ORDER BY pos DESC, party LIMIT 5"))
def sentiment_balance_top(spark, sf):
    s = X.mentions(spark, sf).groupBy("party").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).orderBy(F.desc("pos"), "party").limit(5)
    d = F.col("pos") + F.col("neg") + F.lit(0.001)
    return rounded(s.select("*", (F.col("pos") / d).alias("pos_share"), (F.col("neg") / d).alias("neg_share")))


@query("topic_ownership", X.with_m(f"{LAYERED}, s AS (SELECT month, layer, concept, party, sum(weight) AS w FROM l GROUP BY ALL) SELECT month, layer, concept, party, {r6('w')} AS layer_weight, {r6('w / nullif(sum(w) OVER (PARTITION BY month, layer, concept), 0)')} AS ownership FROM s"), dates="month")
def topic_ownership(spark, sf):
    s = P.layered(X.mentions(spark, sf)).groupBy("month", "layer", "concept", "party").agg(F.sum("weight").alias("layer_weight"))
    return rounded(s.withColumn("ownership", P.share(F.col("layer_weight"), ["month", "layer", "concept"])))


_PANEL = f"""count(DISTINCT speech_id) AS speeches, count(DISTINCT speaker) AS speakers, sum(mention_count)::BIGINT AS words, {r6('avg(mention_count)')} AS mean_words, {r6('avg(score)')} AS mean_score,
  {r6("avg(CASE WHEN label = 'positive' THEN 1.0 ELSE 0.0 END)")} AS positive_share, {r6("avg(CASE WHEN label = 'negative' THEN 1.0 ELSE 0.0 END)")} AS negative_share, {r6("avg(CASE WHEN label = 'mixed' THEN 1.0 ELSE 0.0 END)")} AS mixed_share"""


@query("bloc_speech_panel", X.with_m(f"SELECT month, {X.BLOC_SQL} AS bloc, {_PANEL} FROM m GROUP BY ALL"), dates="month")
def bloc_speech_panel(spark, sf):
    m = X.mentions(spark, sf).withColumn("bloc", X.bloc(F.col("party")))
    return rounded(P.speech_panel(m, ["month", "bloc"]))


_LAYERS = ["total", "positive", "negative"]


@query("layer_concept_shares", X.with_m(f"{LAYERED} SELECT month, " + ", ".join(f"{r6(f'''sum(CASE WHEN concept = '{c}' AND layer = '{k}' THEN weight ELSE 0 END) / nullif(sum(CASE WHEN layer = '{k}' THEN weight ELSE 0 END), 0)''')} AS {c.lower()}_{k}" for c in X.CONCEPTS for k in _LAYERS) + " FROM l GROUP BY month"), dates="month")
def layer_concept_shares(spark, sf):
    rows = P.layered(X.mentions(spark, sf))
    cell = lambda k, c=None: F.sum(F.when((F.col("layer") == k) & (F.lit(c is None) | (F.col("concept") == c)), F.col("weight")).otherwise(0.0))
    return rounded(rows.groupBy("month").agg(*[(cell(k, c) / F.nullif(cell(k), F.lit(0.0))).alias(f"{c.lower()}_{k}") for c in X.CONCEPTS for k in _LAYERS]))


@query("yearly_speech_panel", X.with_m(f"s AS (SELECT month, count(DISTINCT speech_id) AS speeches, sum(mention_count)::BIGINT AS words, avg(score) AS mean_score FROM m GROUP BY 1) SELECT CAST(year(month) AS INTEGER) AS year, sum(speeches)::BIGINT AS speeches, sum(words)::BIGINT AS words, {r6('avg(mean_score)')} AS mean_score, count(*) FILTER (WHERE speeches > 0) AS months FROM s GROUP BY 1"))
def yearly_speech_panel(spark, sf):
    s = P.speech_panel(X.mentions(spark, sf), ["month"])
    return rounded(s.groupBy(F.year("month").alias("year")).agg(F.sum("speeches").alias("speeches"), F.sum("words").alias("words"), F.avg("mean_score").alias("mean_score"), F.count_if(F.col("speeches") > 0).alias("months")))


@query("wide_metric_pivots", X.with_m(f"{LAYERED} SELECT month, " + ", ".join(f"{r6(f'''sum(CASE WHEN layer = '{k}' THEN weight ELSE 0 END)''')} AS {k}_weight, count(DISTINCT CASE WHEN layer = '{k}' THEN speech_id END) AS {k}_speeches" for k in _LAYERS) + " FROM l GROUP BY month"), dates="month")
def wide_metric_pivots(spark, sf):
    rows = P.layered(X.mentions(spark, sf)).groupBy("month").pivot("layer", _LAYERS).agg(F.sum("weight").alias("weight"), F.countDistinct("speech_id").alias("speeches"))
    return rounded(rows.na.fill(0.0).na.fill(0))


@query("eda_overview_conversations", "SELECT count(*) AS rows, count(DISTINCT conv_id) AS transcripts, count(DISTINCT role) AS parties, 4::BIGINT AS columns FROM conversations")
def eda_overview_conversations(spark, sf):
    t = X.table(spark, sf, "conversations")
    return t.agg(F.count("*").alias("rows"), F.countDistinct("conv_id").alias("transcripts"), F.countDistinct("role").alias("parties"), F.lit(len(t.columns)).cast("bigint").alias("columns"))


@query("eda_missing", "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS nulls, {r6(f'100.0::DOUBLE * count(*) FILTER (WHERE {c} IS NULL) / count(*)')} AS percent FROM documents" for c in ("doc_id", "text", "lang", "source", "n_chars")) + ")")
def eda_missing(spark, sf):
    d = X.table(spark, sf, "documents")
    counts = d.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in d.columns], F.count("*").alias("_all"))
    return rounded(counts.unpivot("_all", d.columns, "column_name", "nulls").select("column_name", "nulls", (F.lit(100.0) * F.col("nulls") / F.col("_all")).alias("percent")))


_WORDS = "len(regexp_split_to_array(trim(text), '\\s+'))"


@query("eda_length", f"SELECT {r6(f'avg({_WORDS})')} AS mean_words, {r6(f'quantile_cont({_WORDS}, 0.5)')} AS median_words, {r6(f'quantile_cont({_WORDS}, 0.9)')} AS p90_words, {r6(f'quantile_cont({_WORDS}, 0.99)')} AS p99_words, {r6('avg(length(text))')} AS mean_chars, {r6('quantile_cont(length(text), 0.5)')} AS median_chars FROM documents")
def eda_length(spark, sf):
    d = X.table(spark, sf, "documents").select(F.size(F.split(F.trim("text"), r"\s+")).alias("w"), F.length("text").alias("c"))
    q = lambda c, p: F.percentile(c, F.lit(p))
    return rounded(d.agg(F.avg("w").alias("mean_words"), q("w", 0.5).alias("median_words"), q("w", 0.9).alias("p90_words"), q("w", 0.99).alias("p99_words"), F.avg("c").alias("mean_chars"), q("c", 0.5).alias("median_chars")))


@query("eda_by_term", X.with_m(f"{X.TERMS_SQL} SELECT term, count(*) AS speeches, count(DISTINCT speaker) AS speakers, count(DISTINCT party) AS parties, {r6('avg(mention_count)')} AS mean_words, {r6('quantile_cont(mention_count, 0.5)')} AS median_words FROM m JOIN terms ON date BETWEEN start AND stop GROUP BY term"))
def eda_by_term(spark, sf):
    from parlance.operators.joins import term_of

    m = term_of(X.mentions(spark, sf), X.terms(spark)).where("term is not null")
    return rounded(m.groupBy("term").agg(F.count("*").alias("speeches"), F.countDistinct("speaker").alias("speakers"), F.countDistinct("party").alias("parties"), F.avg("mention_count").alias("mean_words"), F.percentile("mention_count", F.lit(0.5)).alias("median_words")))


@query("eda_top_party", X.with_m(f"SELECT party, count(*) AS speeches, count(DISTINCT speaker) AS speakers, {r6('avg(mention_count)')} AS mean_words FROM m GROUP BY party ORDER BY speeches DESC, party LIMIT 15", nation=True))
def eda_top_party(spark, sf):
    m = X.mentions(spark, sf, nation=True)
    return rounded(m.groupBy("party").agg(F.count("*").alias("speeches"), F.countDistinct("speaker").alias("speakers"), F.avg("mention_count").alias("mean_words")).orderBy(F.desc("speeches"), "party").limit(15))


@query("eda_top_speaker", X.with_m(f"SELECT speaker, party, count(*) AS speeches, {r6('avg(mention_count)')} AS mean_words FROM m WHERE party <> 'HOUSEHOLD' GROUP BY ALL ORDER BY speeches DESC, speaker LIMIT 20"))
def eda_top_speaker(spark, sf):
    m = X.mentions(spark, sf).where("party <> 'HOUSEHOLD'")
    return rounded(m.groupBy("speaker", "party").agg(F.count("*").alias("speeches"), F.avg("mention_count").alias("mean_words")).orderBy(F.desc("speeches"), "speaker").limit(20))


@query("eda_quality", "SELECT count(*) FILTER (WHERE lang IS NULL) AS unknown_party, count(*) FILTER (WHERE source = 'src0') AS default_city, count(*) - count(DISTINCT text) AS duplicates, min(n_chars) AS min_words, max(n_chars) AS max_words FROM documents")
def eda_quality(spark, sf):
    d = X.table(spark, sf, "documents")
    return d.agg(F.count_if(F.col("lang").isNull()).alias("unknown_party"), F.count_if(F.col("source") == "src0").alias("default_city"), (F.count("*") - F.countDistinct("text")).alias("duplicates"), F.min("n_chars").alias("min_words"), F.max("n_chars").alias("max_words"))


@query("period_distribution", X.with_m("s AS (SELECT year, party, count(*) AS n, count(DISTINCT speaker) AS speakers FROM m GROUP BY ROLLUP(year, party)), r AS (SELECT *, row_number() OVER (PARTITION BY year, party IS NULL ORDER BY n DESC, party) AS rank FROM s) SELECT coalesce(year, 0)::INTEGER AS year, coalesce(party, 'all') AS party, n, speakers, rank FROM r WHERE rank <= 3"))
def period_distribution(spark, sf):
    s = X.mentions(spark, sf).rollup("year", "party").agg(F.count("*").alias("n"), F.countDistinct("speaker").alias("speakers"))
    out = P.top_in(s.withColumn("_t", F.col("party").isNull()), ["year", "_t"], [F.desc("n"), F.col("party")], 3)
    return out.select(F.coalesce("year", F.lit(0)).alias("year"), F.coalesce("party", F.lit("all")).alias("party"), "n", "speakers", F.col("rank").cast("bigint").alias("rank"))


@query("party_power", X.with_m(f"{X.TERMS_SQL} SELECT term, party, count(DISTINCT speaker) AS speakers, {r6('count(*) / count(DISTINCT speaker)::DOUBLE')} AS per_speaker FROM m JOIN terms ON date BETWEEN start AND stop GROUP BY ALL"))
def party_power(spark, sf):
    from parlance.operators.joins import term_of

    m = term_of(X.mentions(spark, sf), X.terms(spark)).where("term is not null")
    return rounded(m.groupBy("term", "party").agg(F.countDistinct("speaker").alias("speakers"), (F.count("*") / F.countDistinct("speaker")).alias("per_speaker")))


@query("term_party_volume", X.with_m(f"{X.TERMS_SQL} SELECT term, party, count(DISTINCT speech_id) AS speeches, count(DISTINCT speaker) AS speakers FROM m JOIN terms ON date BETWEEN start AND stop GROUP BY ALL"))
def term_party_volume(spark, sf):
    from parlance.operators.joins import term_of

    m = term_of(X.mentions(spark, sf), X.terms(spark)).where("term is not null")
    return m.groupBy("term", "party").agg(F.countDistinct("speech_id").alias("speeches"), F.countDistinct("speaker").alias("speakers"))


@query("speaker_main_concept", X.with_m("s AS (SELECT speaker, concept AS party, count(*) AS n FROM m GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY speaker ORDER BY n DESC, party) AS k FROM s) SELECT speaker, party, n FROM r WHERE k = 1"))
def speaker_main_concept(spark, sf):
    s = X.mentions(spark, sf).groupBy("speaker", F.col("concept").alias("party")).agg(F.count("*").alias("n"))
    return P.top_in(s, ["speaker"], [F.desc("n"), F.col("party")], 1).select("speaker", "party", "n")


@query("speech_labels", X.with_m(f"""s AS (SELECT speech_id, count(DISTINCT concept) AS concept_hit_count, sum(mention_count)::BIGINT AS mention_count, sum(pos)::BIGINT AS pos, sum(neg)::BIGINT AS neg FROM m GROUP BY 1), t AS (SELECT *, {bal('pos', 'neg')} AS b FROM s)
  SELECT * EXCLUDE (b), round_even(b, 4) AS score, CASE WHEN b >= 0.2 THEN 'positive' WHEN b <= -0.2 THEN 'negative' ELSE 'mixed' END AS label FROM t"""))
def speech_labels(spark, sf):
    return M.speech_labels(X.mentions(spark, sf))


@query("hhi", X.with_m(f"s AS (SELECT month, party, sum(mention_count) AS n FROM m GROUP BY ALL), t AS (SELECT month, n / sum(n) OVER (PARTITION BY month)::DOUBLE AS s FROM s) SELECT month, {r6('sum(s * s)')} AS hhi FROM t GROUP BY month"), dates="month")
def hhi(spark, sf):
    s = P.period_shares(X.mentions(spark, sf), ["month"], ["party"])
    return rounded(P.hhi(s, ["month"], "agenda_share"))


@query("brokerage_hhi", X.with_m(f"s AS (SELECT year, party, greatest(avg(score), 0.0) AS v FROM m GROUP BY ALL) SELECT year, {r6('CASE WHEN sum(v) > 0 THEN sum(v * v) / (sum(v) * sum(v)) END')} AS hhi FROM s GROUP BY year"))
def brokerage_hhi(spark, sf):
    return rounded(P.brokerage_hhi(X.mentions(spark, sf), ["year"], "party", "score"))


_COUNTS = "c AS (SELECT party, speaker, count(*) AS n FROM m GROUP BY ALL)"


def _speaker_counts(spark, sf):
    return X.mentions(spark, sf).groupBy("party", "speaker").agg(F.count("*").alias("n"))


@query("lorenz_curve", X.with_m(f"{_COUNTS} SELECT party, speaker, n, {r6('row_number() OVER w / count(*) OVER (PARTITION BY party)::DOUBLE')} AS people, {r6('sum(n) OVER (w ROWS UNBOUNDED PRECEDING) / sum(n) OVER (PARTITION BY party)::DOUBLE')} AS held FROM c WINDOW w AS (PARTITION BY party ORDER BY n, speaker)"))
def lorenz_curve(spark, sf):
    return rounded(P.lorenz(_speaker_counts(spark, sf), ["party"], "n", "speaker"))


@query("gini_lorenz", X.with_m(f"{_COUNTS}, r AS (SELECT *, row_number() OVER (PARTITION BY party ORDER BY n, speaker) AS k, count(*) OVER (PARTITION BY party) AS z FROM c) SELECT party, {r6('2.0::DOUBLE * sum(k * n) / (any_value(z) * sum(n)) - (any_value(z) + 1) / any_value(z)::DOUBLE')} AS gini FROM r GROUP BY party"))
def gini_lorenz(spark, sf):
    return rounded(P.gini(_speaker_counts(spark, sf), ["party"], "n"))


@query("top_share", X.with_m(f"{_COUNTS}, r AS (SELECT *, row_number() OVER (PARTITION BY party ORDER BY n DESC, speaker) AS k, count(*) OVER (PARTITION BY party) AS z FROM c) SELECT party, {r6('sum(CASE WHEN k <= ceil(z * 0.1::DOUBLE) THEN n END) / sum(n)::DOUBLE')} AS top_share FROM r GROUP BY party"))
def top_share(spark, sf):
    return rounded(P.top_share(_speaker_counts(spark, sf), ["party"], "n", 0.1))


@query("rank_powerlaw", X.with_m(f"{_COUNTS}, r AS (SELECT party, ln(row_number() OVER (PARTITION BY party ORDER BY n DESC, speaker)) AS x, ln(n) AS y FROM c) SELECT party, {r6('regr_slope(y, x)')} AS slope, {r6('regr_r2(y, x)')} AS r2 FROM r GROUP BY party"))
def rank_powerlaw(spark, sf):
    return rounded(P.rank_powerlaw(_speaker_counts(spark, sf), ["party"], "n", "speaker"))


@query("top_n_per_layer", X.with_m(f"{LAYERED}, s AS (SELECT layer, concept, sum(weight) AS w FROM l GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY layer ORDER BY w DESC, concept) AS rank FROM s) SELECT layer, concept, {r6('w')} AS w, rank FROM r WHERE rank <= 3"))
def top_n_per_layer(spark, sf):
    s = P.layered(X.mentions(spark, sf)).groupBy("layer", "concept").agg(F.sum("weight").alias("w"))
    return rounded(P.top_in(s, ["layer"], [F.desc("w"), F.col("concept")], 3).withColumn("rank", F.col("rank").cast("bigint")))


@query("strongest_party", X.with_m("s AS (SELECT year, party, sum(neg)::BIGINT AS neg, sum(pos)::BIGINT AS pos, sum(mention_count)::BIGINT AS n FROM m GROUP BY ALL) SELECT year, arg_max(party, (neg, party)) AS attack, arg_max(party, (pos, party)) AS defense, arg_max(party, (n, party)) AS owner FROM s GROUP BY year"))
def strongest_party(spark, sf):
    s = P.sums_by(X.mentions(spark, sf), ["year", "party"])
    top = lambda c: F.max(F.struct(c, "party"))["party"]
    return s.groupBy("year").agg(top("neg").alias("attack"), top("pos").alias("defense"), top("mentions").alias("owner"))


@query("share_of_total", X.with_m(f"s AS (SELECT year, concept, sum(mention_count)::BIGINT AS n FROM m GROUP BY ALL) SELECT *, {r6('n / sum(n) OVER (PARTITION BY year)::DOUBLE')} AS share FROM s"))
def share_of_total(spark, sf):
    s = X.mentions(spark, sf).groupBy("year", "concept").agg(F.sum("mention_count").alias("n"))
    return rounded(s.withColumn("share", P.share(F.col("n"), ["year"])))


@query("cumulative_sum", X.with_m("s AS (SELECT month, sum(mention_count)::BIGINT AS n FROM m GROUP BY 1) SELECT month, n, (sum(n) OVER (ORDER BY month))::BIGINT AS running FROM s"), dates="month")
def cumulative_sum(spark, sf):
    from parlance.operators.series import ordered

    s = X.mentions(spark, sf).groupBy("month").agg(F.sum("mention_count").alias("n"))
    return s.withColumn("running", F.sum("n").over(ordered("month").rowsBetween(Window.unboundedPreceding, 0)))


@query("rank_top_k", X.with_m("s AS (SELECT speaker, count(*) AS n FROM m GROUP BY 1) SELECT speaker, n, row_number() OVER (ORDER BY n DESC, speaker) AS rank FROM s ORDER BY n DESC, speaker LIMIT 25"))
def rank_top_k(spark, sf):
    top = X.mentions(spark, sf).groupBy("speaker").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "speaker").limit(25)
    return P.top_in(top, [], [F.desc("n"), F.col("speaker")], 25).withColumn("rank", F.col("rank").cast("bigint"))
