"""Registered queries of the text, date, number and label functions and of tagging."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.functions import text as T
from parlance.operators import tagging
from parlance.sources.tables import spread

from . import fixtures as X
from .registry import query
from .sqlkit import bal, r6, rounded

_FOLD = f"translate(replace(lower(text), 'i̇', 'i'), '{T.FOLD_FROM}', '{T.FOLD_TO.replace(chr(39), chr(39) * 2)}')"
_NORMAL = rf"trim(regexp_replace(regexp_replace({_FOLD}, '[^\p{{L}}\p{{N}}_\s\-.]', ' ', 'g'), '\s+', ' ', 'g'))"


def _docs(spark, sf):
    return X.table(spark, sf, "documents")


@query("normalize_text", f"SELECT doc_id, md5({_NORMAL}) AS normal FROM documents")
def normalize_text(spark, sf):
    return _docs(spark, sf).select("doc_id", F.md5(T.normalize_text(F.col("text")).cast("binary")).alias("normal"))


@query("normalize_light", "SELECT doc_id, md5(translate(replace(lower(text), 'i̇', 'i'), 'âîû', 'aiu')) AS normal FROM documents")
def normalize_light(spark, sf):
    return _docs(spark, sf).select("doc_id", F.md5(T.normalize_light(F.col("text")).cast("binary")).alias("normal"))


@query("normalize_name_key", r"SELECT s_suppkey, trim(regexp_replace(lower(translate(translate(upper(s_name), 'ÇĞİÖŞÜÂÎÛI', 'CGIOSUAIUI'), '.,''', '   ')), '\s+', ' ', 'g')) AS name_key FROM supplier")
def normalize_name_key(spark, sf):
    return X.table(spark, sf, "supplier").select("s_suppkey", T.normalize_name_key(F.col("s_name")).alias("name_key"))


@query("slugify", "SELECT p_partkey, translate(lower(p_name), ' /-', '___') AS event_slug, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g'), '_') AS text_slug, trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', '_', 'g'), '_') AS series_slug FROM part")
def slugify(spark, sf):
    p = X.table(spark, sf, "part")
    return p.select("p_partkey", T.slug_event(F.col("p_name")).alias("event_slug"), T.slug_text(F.col("p_name")).alias("text_slug"), T.slug_series(F.col("p_brand")).alias("series_slug"))


_ASCII = r"regexp_replace(lower(text), '[^a-z0-9 .\-]', ' ', 'g')"


def _ascii():
    return F.regexp_replace(F.lower("text"), r"[^a-z0-9 .\-]", " ")


@query("word_count", rf"SELECT doc_id, len(regexp_extract_all({_ASCII}, '[a-z]+')) AS words, len(regexp_split_to_array(trim(text), '\s+')) AS tokens, length(text) AS chars FROM documents")
def word_count(spark, sf):
    return _docs(spark, sf).select("doc_id", T.count_words(_ascii()).cast("bigint").alias("words"), F.size(F.split(F.trim("text"), r"\s+")).cast("bigint").alias("tokens"), F.length("text").cast("bigint").alias("chars"))


_TOKENS = "regexp_extract_all(translate(replace(lower(text), 'i̇', 'i'), 'âîû', 'aiu'), '[a-zçğıöşüâîû]{2,}')"


@query("tokenize", f"SELECT doc_id, len({_TOKENS}) AS n, md5(array_to_string({_TOKENS}, ' ')) AS tokens, len(list_filter({_TOKENS}, lambda w: w NOT IN ('the', 'of', 'and'))) AS content FROM documents")
def tokenize(spark, sf):
    t = T.tokens(F.col("text"))
    return _docs(spark, sf).select("doc_id", F.size(t).cast("bigint").alias("n"), F.md5(F.array_join(t, " ").cast("binary")).alias("tokens"), F.size(T.tokens(F.col("text"), 2, ["the", "of", "and"])).cast("bigint").alias("content"))


# stems that occur in the driver's prose
STEMS = [("c_th", "", "macro_economy", [r"\bthe\w*", r"\bthen\w*"]), ("c_er", "", "security_conflict", [r"\ber\w*"]), ("c_de", "", "democratic_reform", [r"\bde\b"])]
POS, NEG = [r"\bon\w*", r"\ban\b"], [r"\ble\w*", r"\bstion\w*"]


@query("pattern_hits", f"SELECT doc_id, ({' + '.join(f'''len(regexp_extract_all({_ASCII}, '{p}'))''' for p in POS)}) AS hits FROM documents")
def pattern_hits(spark, sf):
    return _docs(spark, sf).select("doc_id", T.pattern_hits(_ascii(), POS).cast("bigint").alias("hits"))


_WINDOWS = "w AS (" + " UNION ALL ".join(
    f"""SELECT doc_id, '{s}' AS concept, '{c}' AS category, unnest(list_transform(range(1, len(hits) + 1), lambda i: [coalesce(list_sum(list_transform(parts[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(hits[1:i-1], lambda x: length(x))), 0), length(hits[i])])) AS loc, t
    FROM (SELECT doc_id, t, string_split_regex(t, '{p}') AS parts, regexp_extract_all(t, '{p}') AS hits FROM d)"""
    for s, _, c, ps in STEMS
    for p in ps
) + "), k AS (SELECT doc_id, concept, category, substring(t, (greatest(loc[1] - 90, 0) + 1)::BIGINT, (least(loc[1], 90) + loc[2] + 90)::BIGINT) AS win FROM w)"
_D = rf"d AS (SELECT doc_id, {_ASCII} AS t FROM documents WHERE regexp_matches({_ASCII}, 'the|er|de'))"


def _tag_texts(spark, sf):
    return spread(_docs(spark, sf).select("doc_id", "text")).select("doc_id", _ascii().alias("text"))


@query("concept_prefilter", rf"SELECT count(*) AS n, count(*) FILTER (WHERE regexp_matches({_ASCII}, 'thatt|edsh|avec')) AS passed FROM documents")
def concept_prefilter(spark, sf):
    return _tag_texts(spark, sf).agg(F.count("*").alias("n"), F.count_if(F.col("text").rlike("thatt|edsh|avec")).alias("passed"))


@query("kwic_windows", f"WITH {_D}, {_WINDOWS} SELECT doc_id, concept, md5(win) AS win, count(*) AS n FROM k GROUP BY ALL")
def kwic_windows(spark, sf):
    w = tagging.concept_windows(_tag_texts(spark, sf), STEMS, "the|er|de")
    return w.groupBy("doc_id", "concept", F.md5(F.col("window").cast("binary")).alias("win")).agg(F.count("*").alias("n"))


def _hits(ps):
    return " + ".join(f"len(regexp_extract_all(win, '{p}'))" for p in ps)


@query("concept_edges", f"""WITH {_D}, {_WINDOWS}, s AS (SELECT doc_id, concept, category, count(*) AS mention_count, sum({_hits(POS)})::BIGINT AS pos, sum({_hits(NEG)})::BIGINT AS neg FROM k GROUP BY ALL),
  t AS (SELECT *, {bal('pos', 'neg')} AS b FROM s) SELECT * EXCLUDE (b), {r6('mention_count + 0.35::DOUBLE * (pos + neg)')} AS salience, round_even(b, 4) AS score, CASE WHEN b >= 0.2 THEN 'positive' WHEN b <= -0.2 THEN 'negative' ELSE 'mixed' END AS label FROM t""")
def concept_edges(spark, sf):
    return rounded(tagging.concept_edges(_tag_texts(spark, sf), ["doc_id"], POS, NEG, concepts=STEMS, prefilter="the|er|de"))


@query("parse_local_date", """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date, CAST(date_trunc('month', o_orderdate) AS DATE) AS month FROM orders""", dates="date month")
def parse_local_date(spark, sf):
    o = X.table(spark, sf, "orders")
    raw = F.concat_ws(".", F.dayofmonth("o_orderdate"), F.month("o_orderdate"), F.year("o_orderdate"))
    return o.select("o_orderkey", T.parse_local_date(raw).alias("date"), T.parse_local_date(F.concat_ws(".", F.month("o_orderdate"), F.year("o_orderdate"))).alias("month"))


@query("parse_date_mixed", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS a, CAST(date_trunc('month', o_orderdate) AS DATE) AS b, CAST(o_orderdate AS DATE) AS c FROM orders", dates="a b c")
def parse_date_mixed(spark, sf):
    o, f = X.table(spark, sf, "orders"), lambda p: T.parse_date_mixed(F.date_format("o_orderdate", p))
    return o.select("o_orderkey", f("dd-MM-yyyy").alias("a"), f("yyyy-MM").alias("b"), f("d.M.yyyy").alias("c"))


@query("to_number_locale", "SELECT c_custkey, c_acctbal AS number, CAST(c_custkey AS BIGINT) AS n, CASE WHEN c_acctbal > 1000 THEN c_acctbal / 1000000 ELSE c_acctbal END AS rate FROM customer")
def to_number_locale(spark, sf):
    raw = F.replace(F.col("c_acctbal").cast("string"), F.lit("."), F.lit(","))
    return X.table(spark, sf, "customer").select("c_custkey", T.to_number(raw).alias("number"), T.to_count(F.regexp_replace(F.col("c_custkey").cast("string"), r"(\d)(\d{3})$", "$1.$2")).alias("n"), T.to_rate(raw).alias("rate"))


@query("month_floor", "SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, strftime(o_orderdate, '%Y-%m') AS month_key, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m FROM orders", dates="month")
def month_floor(spark, sf):
    d = F.col("o_orderdate")
    return X.table(spark, sf, "orders").select("o_orderkey", F.trunc(d, "MM").alias("month"), F.date_format(d, "yyyy-MM").alias("month_key"), F.year(d).alias("y"), F.month(d).alias("m"))


@query("month_diff", "SELECT l_orderkey, l_linenumber, l_partkey, CAST((year(l_shipdate) - year(o_orderdate)) * 12 + month(l_shipdate) - month(o_orderdate) AS INTEGER) AS months FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def month_diff(spark, sf):
    j = X.table(spark, sf, "lineitem").join(X.table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.select("l_orderkey", "l_linenumber", "l_partkey", T.month_diff(F.col("l_shipdate"), F.col("o_orderdate")).alias("months"))


@query("safe_divide", f"SELECT l_orderkey, l_linenumber, l_partkey, {r6('l_quantity / nullif(l_discount, 0)')} AS ratio, {r6('l_quantity / greatest(l_discount, 1)')} AS clipped FROM lineitem")
def safe_divide(spark, sf):
    q, d = F.col("l_quantity"), F.col("l_discount")
    return rounded(X.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", T.safe_divide(q, d).alias("ratio"), (q / F.greatest(d, F.lit(1.0))).alias("clipped")))


@query("first_available", "SELECT o_orderkey, coalesce(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END, CASE WHEN o_orderpriority LIKE '1%' THEN -o_totalprice END, 0.0) AS value FROM orders")
def first_available(spark, sf):
    p = F.col("o_totalprice")
    return X.table(spark, sf, "orders").select("o_orderkey", F.coalesce(F.when(F.col("o_orderstatus") == "F", p), F.when(F.col("o_orderpriority").startswith("1"), -p), F.lit(0.0)).alias("value"))


@query("map_label", "SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'bld' WHEN 'MACHINERY' THEN 'mach' ELSE c_mktsegment END AS short FROM customer")
def map_label(spark, sf):
    return X.table(spark, sf, "customer").select("c_custkey", T.recode(F.col("c_mktsegment"), {"BUILDING": "bld", "MACHINERY": "mach"}).alias("short"))


@query("party_bloc", f"{X.with_m(f'SELECT party, {X.BLOC_SQL} AS bloc, count(*) AS n FROM m GROUP BY ALL')}")
def party_bloc(spark, sf):
    blocs = spark.createDataFrame([(p, "government") for p in X.GOVERNMENT], "party string, bloc string")
    m = X.mentions(spark, sf).join(F.broadcast(blocs), "party", "left")
    return m.groupBy("party", F.coalesce("bloc", F.lit("opposition")).alias("bloc")).agg(F.count("*").alias("n"))


@query("canonical_party", "SELECT n_nationkey, CASE WHEN n_nationkey < 5 THEN 'Canon ' || n_nationkey ELSE n_name END AS party FROM nation")
def canonical_party(spark, sf):
    canon = spark.createDataFrame([(f"nation_{i}", f"Canon {i}") for i in range(5)], "name_key string, canon string")
    n = X.table(spark, sf, "nation").withColumn("name_key", T.normalize_text(F.col("n_name")))
    return n.join(F.broadcast(canon), "name_key", "left").select("n_nationkey", F.coalesce("canon", "n_name").alias("party"))


@query("party_from_prefix", "SELECT p_partkey, CASE WHEN contains(upper(p_name), 'RED') THEN 'r' WHEN contains(upper(p_name), 'WIDGET') THEN 'w' END AS party FROM part")
def party_from_prefix(spark, sf):
    return X.table(spark, sf, "part").select("p_partkey", T.first_match(F.col("p_name"), [("RED", "r"), ("WIDGET", "w")]).alias("party"))


@query("clean_cell", "SELECT p_partkey, p_name AS cell FROM part")
def clean_cell(spark, sf):
    return X.table(spark, sf, "part").select("p_partkey", T.clean_cell(F.concat(F.lit(" "), F.replace(F.col("p_name"), F.lit(" "), F.lit("  ")), F.lit("[12] "))).alias("cell"))


@query("term_from_id", "SELECT o_orderkey, CASE WHEN o_orderkey BETWEEN 0 AND 999 THEN 't1' WHEN o_orderkey BETWEEN 1000 AND 4999 THEN 't2' ELSE 'Bilinmiyor' END AS term FROM orders")
def term_from_id(spark, sf):
    return X.table(spark, sf, "orders").select("o_orderkey", T.range_label(F.col("o_orderkey").cast("string"), [(0, 999, "t1"), (1000, 4999, "t2")]).alias("term"))


@query("label_threshold", X.with_m("SELECT label, CASE WHEN score >= 0 THEN 'positive' ELSE 'negative' END AS binary_label, count(*) AS n FROM m GROUP BY ALL"))
def label_threshold(spark, sf):
    return X.mentions(spark, sf).groupBy("label", F.when(F.col("score") >= 0, "positive").otherwise("negative").alias("binary_label")).agg(F.count("*").alias("n"))


@query("round_half_even", "SELECT c_custkey, round_even(c_custkey / 32.0::DOUBLE, 4) AS four, round_even(c_custkey / 128.0::DOUBLE, 6) AS six FROM customer")
def round_half_even(spark, sf):
    return X.table(spark, sf, "customer").select("c_custkey", F.bround(F.col("c_custkey") / 32.0, 4).alias("four"), F.bround(F.col("c_custkey") / 128.0, 6).alias("six"))


_LINES = "ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)"


def _lines(spark, sf):
    return _docs(spark, sf).select("doc_id", F.explode(F.split("text", "\n")).alias("line"))


@query("speaker_confidence", rf"WITH {_LINES}, c AS (SELECT doc_id, line, len(regexp_extract_all(line, '\p{{L}}')) AS a, len(regexp_extract_all(line, '\p{{Ll}}')) AS b FROM ln) SELECT doc_id, md5(line) AS line, count(*) AS n, {r6('max(CASE WHEN a < 3 THEN 0.0::DOUBLE ELSE (a - b) / nullif(a, 0)::DOUBLE END)')} AS confidence FROM c GROUP BY ALL")
def speaker_confidence(spark, sf):
    rows = _lines(spark, sf).groupBy("doc_id", "line").agg(F.count("*").alias("n"))
    return rounded(rows.select("doc_id", F.md5(F.col("line").cast("binary")).alias("line"), "n", T.speaker_confidence(F.col("line")).alias("confidence")))


@query("fuzzy_name_match", "WITH w AS (SELECT p_partkey, list_distinct(string_split(lower(p_name || ' ' || p_brand), ' ')) AS ws FROM part) SELECT p_partkey, len(list_intersect(ws, ['red', 'widget', 'brand#1'])) >= 2 AND (len(list_intersect(ws, ['red', 'widget', 'brand#1'])) IN (3, len(ws))) AS fuzzy FROM w")
def fuzzy_name_match(spark, sf):
    return X.table(spark, sf, "part").select("p_partkey", T.fuzzy_name(F.lower(F.concat_ws(" ", "p_name", "p_brand")), F.lit("red widget brand#1")).alias("fuzzy"))


@query("term_doc_freq", f"WITH t AS (SELECT doc_id, lang, unnest({_TOKENS}) AS word FROM documents) SELECT word, count(*) AS tf, count(DISTINCT doc_id) AS df, {r6('count(DISTINCT doc_id) / (SELECT count(*) FROM documents)::DOUBLE')} AS doc_ratio, count(DISTINCT lang) AS party_span FROM t GROUP BY word ORDER BY tf DESC, word LIMIT 500")
def term_doc_freq(spark, sf):
    d = _docs(spark, sf)
    t = spread(d).select("doc_id", "lang", F.explode(T.tokens(F.col("text"))).alias("word"))
    n = d.agg(F.count("*").alias("_n"))
    # counted per text first, so a frequent word is one row per text when it is shuffled
    t = t.groupBy("word", "doc_id", "lang").agg(F.count("*").alias("c"))
    # a text has one language, so texts add up over languages and no distinct count is left
    t = t.groupBy("word", "lang").agg(F.sum("c").alias("c"), F.count("*").alias("docs"))
    w = t.groupBy("word").agg(F.sum("c").alias("tf"), F.sum("docs").alias("df"), F.count("lang").alias("party_span")).orderBy(F.desc("tf"), "word").limit(500)
    return rounded(w.crossJoin(F.broadcast(n)).select("word", "tf", "df", (F.col("df") / F.col("_n")).alias("doc_ratio"), "party_span"))


@query("group_top_words", f"WITH t AS (SELECT lang, source, unnest({_TOKENS}) AS word FROM documents), s AS (SELECT lang, source, word, count(*) AS n FROM t GROUP BY GROUPING SETS ((word), (lang, word), (source, word), (lang, source, word))), r AS (SELECT coalesce(lang, '*') AS lang, coalesce(source, '*') AS source, word, n FROM s), k AS (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY n DESC, word) AS rank FROM r) SELECT * FROM k WHERE rank <= 10")
def group_top_words(spark, sf):
    t = _docs(spark, sf).select("lang", "source", F.explode(T.tokens(F.col("text"))).alias("word"))
    t = t.groupBy("lang", "source", "word").agg(F.count("*").alias("n"))
    sets = [[], [F.col("lang")], [F.col("source")], [F.col("lang"), F.col("source")]]
    s = t.groupingSets([[F.col("word"), *x] for x in sets], "lang", "source", "word").agg(F.sum("n").alias("n"))
    s = s.withColumns({c: F.coalesce(c, F.lit("*")) for c in ("lang", "source")})
    from parlance.operators.panels import top_in

    return top_in(s, ["lang", "source"], [F.desc("n"), F.col("word")], 10).withColumn("rank", F.col("rank").cast("bigint"))
