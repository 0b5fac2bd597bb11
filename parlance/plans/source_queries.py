"""Registered queries of sources, sinks, turns and speaker resolution."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from parlance.operators import turns
from parlance.operators.lineage import shared_dir
from parlance.sources import readers, sinks

from . import fixtures as X
from .registry import query
from .sqlkit import r6, rounded


#: Rows of events from which the documents of ``scan_json_chart`` are made together.
CHART_ROWS = 1000


def _path(spark) -> str:
    return f"{shared_dir(spark)}/parlance-{uuid.uuid4().hex}"


@query("scan_csv_pruned", "SELECT o_orderkey, o_orderpriority FROM orders")
def scan_csv_pruned(spark, sf):
    o = X.table(spark, sf, "orders").drop("o_orderdate")
    o.write.option("header", True).csv(path := _path(spark))
    return readers.csv_pruned(spark, path, ", ".join(f"`{c}` {t}" for c, t in o.dtypes), ["o_orderkey", "o_orderpriority"])


@query("scan_csv_flexible", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_mktsegment FROM customer")
def scan_csv_flexible(spark, sf):
    X.table(spark, sf, "customer").select("c_custkey", "c_mktsegment").write.option("header", True).option("sep", "|").csv(path := _path(spark))
    return readers.csv_flexible(spark, path)


@query("scan_text_corpus", "SELECT conv_id::VARCHAR AS doc_id, sum(length(coalesce(text, '')) + 1)::BIGINT AS chars FROM conversations GROUP BY 1")
def scan_text_corpus(spark, sf):
    # a folder holds the one file of a conversation, and its name has the id
    c = X.table(spark, sf, "conversations").select("conv_id", F.coalesce("text", F.lit("")).alias("text"))
    c.repartition(8, "conv_id").write.partitionBy("conv_id").text(path := _path(spark))
    t = readers.text_corpus(spark, f"{path}/*", r"conv_id=([^/]+)/")
    return t.select("doc_id", F.length("text").cast("bigint").alias("chars"))


@query("scan_json_chart", "SELECT user_id, floor(epoch(ts))::BIGINT AS timestamp, CAST(ts AS DATE) AS date, value AS open, value + 1 AS high, value - 1 AS low, value AS close, CASE WHEN user_id % 3 > 0 THEN value / 2 END AS adjclose, CAST(json_extract(props, '$.k') AS BIGINT) AS volume FROM events WHERE value > 20", dates="date")
def scan_json_chart(spark, sf):
    e = X.table(spark, sf, "events").withColumn("k", F.from_json("props", "k bigint").k)
    # a document holds the events of a user in one block of rows, so none outgrows the block
    v = F.col("value")
    e = e.select("user_id", F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))").alias("t"), v.alias("o"), (v + 1).alias("h"), (v - 1).alias("l"), F.when(v > 20, v).alias("c"), (v / 2).alias("a"), "k", F.floor(F.monotonically_increasing_id() / CHART_ROWS).alias("block"))
    docs = e.groupBy("user_id", "block").agg(F.collect_list(F.struct("t", "o", "h", "l", F.coalesce("c", F.lit(float("nan"))).alias("c"), "a", "k")).alias("r"))
    quote = F.struct(*[F.col(f"r.{c}").alias(n) for c, n in (("o", "open"), ("h", "high"), ("l", "low"), ("c", "close"), ("k", "volume"))])
    # every third user's document has no adjusted closes
    adjusted = F.when(F.col("user_id") % 3 > 0, F.array(F.struct(F.col("r.a").alias("adjclose"))))
    result = F.struct(F.col("r.t").alias("timestamp"), F.struct(F.array(quote).alias("quote"), adjusted.alias("adjclose")).alias("indicators"))
    json = F.regexp_replace(F.to_json(F.struct(F.struct(F.array(result).alias("result")).alias("chart"))), '"NaN"', "null")
    return readers.chart(docs.select("user_id", json.alias("json")), "json", ["user_id"])


_OBSERVED = "ob AS (SELECT event_type AS code, 'i_' || event_type AS name, 1990 + CAST(json_extract(props, '$.k') AS INTEGER) % 30 AS year, sum(value) AS value FROM events GROUP BY ALL)"
_WIDE = lambda t: r6(f"max(CASE WHEN name = 'i_{t}' THEN value END)") + f" AS i_{t}"


def _indicators(spark, sf):
    e = X.table(spark, sf, "events").withColumn("k", F.from_json("props", "k bigint").k)
    y = e.groupBy("event_type", (1990 + F.col("k") % 30).alias("year")).agg(F.sum("value").alias("value"))
    one = F.struct(F.struct(F.col("event_type").alias("id")).alias("indicator"), F.col("year").cast("string").alias("date"), "value")
    docs = y.groupBy("event_type").agg(F.collect_list(one).alias("rows"))  # at most thirty years
    json = F.concat(F.lit('[{"page":1,"pages":1},'), F.to_json("rows"), F.lit("]"))
    return readers.indicators(docs.select("event_type", F.concat(F.lit("i_"), "event_type").alias("name"), json.alias("json")), "json", "event_type", "name", 2002, 2015)


@query("scan_json_indicator", f"WITH {_OBSERVED} SELECT year, code, name, {r6('value')} AS value FROM ob WHERE year BETWEEN 2002 AND 2015")
def scan_json_indicator(spark, sf):
    return rounded(_indicators(spark, sf))


@query("scan_json_indicator_wide", f"WITH {_OBSERVED} SELECT year, {', '.join(map(_WIDE, X.TYPES))} FROM ob WHERE year BETWEEN 2002 AND 2015 GROUP BY year")
def scan_json_indicator_wide(spark, sf):
    return rounded(readers.indicators_wide(_indicators(spark, sf), [f"i_{t}" for t in X.TYPES]))


@query("scan_xml_rates", f"WITH b AS (SELECT o_orderkey, o_totalprice AS buying, CASE WHEN o_orderstatus <> 'F' THEN o_totalprice + 2 END AS selling FROM orders WHERE o_orderstatus <> 'P') SELECT o_orderkey, {r6('buying')} AS buying, {r6('selling')} AS selling, {r6('coalesce((buying + selling) / 2, buying)')} AS mid, {r6('coalesce(selling, buying)')} AS high, {r6('buying')} AS low FROM b")
def scan_xml_rates(spark, sf):
    o = X.table(spark, sf, "orders")
    one = lambda code, *parts: F.concat(F.lit(f'<Currency CurrencyCode="{code}">'), *parts, F.lit("</Currency>"))
    rate = lambda tag, v: F.concat(F.lit(f"<{tag}>"), v.cast("string"), F.lit(f"</{tag}>"))
    ask = F.when(F.col("o_orderstatus") == "F", "<ForexSelling/>").otherwise(rate("ForexSelling", F.col("o_totalprice") + 2))
    mine = F.when(F.col("o_orderstatus") == "P", "").otherwise(one("USD", rate("ForexBuying", F.col("o_totalprice")), ask))
    xml = F.concat(F.lit("<Tarih_Date>"), one("EUR", F.lit("<ForexBuying>1</ForexBuying>")), mine, F.lit("</Tarih_Date>"))
    return rounded(readers.rates(o.select("o_orderkey", xml.alias("xml")), "xml", ["o_orderkey"]))


_MONTHS = [f"m{i:02d}" for i in range(1, 13)]


@query("scan_matrix_wide", "SELECT substr(o_orderpriority, 1, 1) AS label, CAST(date_trunc('month', o_orderdate) AS DATE) AS date, count(*)::DOUBLE AS value FROM orders GROUP BY ALL", dates="date")
def scan_matrix_wide(spark, sf):
    o = X.table(spark, sf, "orders").select(F.substring("o_orderpriority", 1, 1).alias("label"), F.year("o_orderdate").cast("string").alias("year"), F.month("o_orderdate").alias("m"))
    wide = o.groupBy("label", "year").pivot("m", list(range(1, 13))).count().toDF("label", "year", *_MONTHS)
    return readers.matrix_long(wide, "year", _MONTHS, ["label"])


@query("scan_multi_term_union", X.with_m(f"{X.TERMS_SQL} SELECT term, count(*) AS n FROM m JOIN terms ON date BETWEEN start AND stop GROUP BY term"))
def scan_multi_term_union(spark, sf):
    m = X.mentions(spark, sf)
    parts = [m.where(F.col("date").between(a, b)).select(F.lit(t).alias("term"), "speech_id") for t, a, b in X.TERMS]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p, allowMissingColumns=True)
    return every.groupBy("term").agg(F.count("*").alias("n"))


@query("load_term_inputs", X.with_m("i AS (SELECT 'speech' AS source, date FROM m WHERE date BETWEEN DATE '1997-01-01' AND DATE '1998-12-31' UNION ALL SELECT 'market', CAST(o_orderdate AS DATE) FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1996-12-02' AND DATE '1998-12-31') SELECT source, count(*) AS rows, string_agg(DISTINCT strftime(date, '%Y-%m'), ',' ORDER BY strftime(date, '%Y-%m')) AS months FROM i GROUP BY source"))
def load_term_inputs(spark, sf):
    from parlance.operators import joins

    _, start, stop = X.TERMS[1]
    speech = joins.term_rows(X.mentions(spark, sf).select(F.lit("speech").alias("source"), "date"), start, stop)
    days = X.table(spark, sf, "orders").select(F.lit("market").alias("source"), F.to_date("o_orderdate").alias("date"))
    return joins.month_list(speech.unionByName(joins.term_rows(days, start, stop, lead=30)), ["source"])


@query("sink_csv_tables", "SELECT n_name, CAST(n_regionkey AS VARCHAR) AS n_regionkey FROM nation")
def sink_csv_tables(spark, sf):
    sinks.csv_table(X.table(spark, sf, "nation").select("n_name", "n_regionkey"), path := _path(spark))
    return spark.read.option("header", True).csv(path)


@query("sink_partitioned_year", "SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n FROM orders WHERE year(o_orderdate) >= 1999 GROUP BY 1")
def sink_partitioned_year(spark, sf):
    sinks.by_year(X.table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), path := _path(spark), "o_orderdate")
    return spark.read.parquet(path).where("year >= 1999").groupBy("year").agg(F.count("*").alias("n"))


@query("sink_json_report", "SELECT role, count(*) AS n FROM conversations GROUP BY 1")
def sink_json_report(spark, sf):
    sinks.json_report(X.table(spark, sf, "conversations").groupBy("role").agg(F.count("*").alias("n"), F.min("turn").alias("first")), path := _path(spark), "role")
    return spark.read.json(path).select("role", "report.n")


_SPEAKER = "^[A-Z][a-z]+( [a-z]+){0,2}[.]$"
_LINES = "ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents)"


def _numbered(spark, sf):
    return turns.numbered_lines(X.table(spark, sf, "documents"), "doc_id")


@query("segment_turns", f"""WITH {_LINES}, s AS (SELECT *, regexp_matches(line, '{_SPEAKER}') AS s FROM ln), t AS (SELECT *, sum(CASE WHEN s THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS turn FROM s),
  g AS (SELECT doc_id, turn::BIGINT AS turn, max(CASE WHEN s THEN line END) AS speaker, coalesce(string_agg(line, ' ' ORDER BY pos) FILTER (WHERE NOT s), '') AS speech FROM t WHERE turn > 0 GROUP BY ALL) SELECT doc_id, turn, speaker, md5(speech) AS speech FROM g WHERE length(speech) > 15""")
def segment_turns(spark, sf):
    t = turns.segment_turns(_numbered(spark, sf), "doc_id", F.col("line").rlike(_SPEAKER))
    return t.withColumn("speech", F.md5(F.col("speech").cast("binary")))


@query("line_diagnostics", f"WITH {_LINES} SELECT doc_id, count(*) FILTER (WHERE regexp_matches(line, '{_SPEAKER}')) AS header_only, count(*) FILTER (WHERE NOT regexp_matches(line, '{_SPEAKER}') AND regexp_matches(line, '@|!!')) AS garbage, count(*) FILTER (WHERE NOT regexp_matches(line, '{_SPEAKER}') AND NOT regexp_matches(line, '@|!!')) AS other FROM ln GROUP BY doc_id")
def line_diagnostics(spark, sf):
    return turns.line_classes(_numbered(spark, sf), "doc_id", {"header_only": F.col("line").rlike(_SPEAKER), "garbage": F.col("line").rlike("@|!!")})


@query("trim_to_session", "SELECT doc_id, md5(CASE WHEN regexp_matches(text, 'the|der') THEN substring(text, length(regexp_extract(text, '(?s)^(.*?)(the|der)', 1)) + 1) ELSE text END) AS text FROM documents")
def trim_to_session(spark, sf):
    return X.table(spark, sf, "documents").select("doc_id", F.md5(turns.trim_to(F.col("text"), "the|der").cast("binary")).alias("text"))


# the first words of a text stand for the head of a transcript, with the date of the document's length
_HEAD = "concat(substring(text, 1, 40), chr(10), n_chars % 31, ' ', CASE n_chars % 3 WHEN 0 THEN 'Kasım' WHEN 1 THEN '.  ' ELSE 'Juli' END, '  20', lpad((n_chars % 90 + 10)::VARCHAR, 2, '0'), ' x')"


@query("extract_session_date", f"SELECT doc_id, coalesce(nullif(replace(regexp_extract({_HEAD}, '{turns.DATE}', 0), ' ', ''), ''), 'Bilinmiyor') AS date FROM documents WHERE text IS NOT NULL")
def extract_session_date(spark, sf):
    d, n = X.table(spark, sf, "documents").where("text IS NOT NULL"), F.col("n_chars")
    month = F.when(n % 3 == 0, "Kasım").when(n % 3 == 1, ".  ").otherwise("Juli")
    head = F.concat(F.substring("text", 1, 40), F.lit("\n"), (n % 31).cast("string"), F.lit(" "), month, F.lit("  20"), F.lpad((n % 90 + 10).cast("string"), 2, "0"), F.lit(" x"))
    return d.select("doc_id", turns.first_date(head).alias("date"))


@query("roster_forward_fill", "WITH r AS (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN p_brand ELSE ' ' END AS city FROM part) SELECT p_partkey, last_value(nullif(trim(city), '') IGNORE NULLS) OVER (ORDER BY p_partkey ROWS UNBOUNDED PRECEDING) AS city FROM r")
def roster_forward_fill(spark, sf):
    r = X.table(spark, sf, "part").select("p_partkey", F.when(F.col("p_partkey") % 7 == 0, F.col("p_brand")).otherwise(" ").alias("city"))
    return turns.forward_fill(r, "p_partkey", ["city"])


# a roster of customers: labels that name a party, that can't, and that stay as they are; changed parties
_LABELS = "CASE c_custkey % 7 WHEN 0 THEN 'Yeni Yol' WHEN 1 THEN '12' WHEN 2 THEN c_name || ' · ' || c_mktsegment WHEN 3 THEN 'mhp ' || c_name WHEN 4 THEN ' ' WHEN 5 THEN repeat(c_name, 6) ELSE c_name END"
_CHANGED = "CASE c_custkey % 5 WHEN 0 THEN ' Doğru Yol Partisi ' WHEN 1 THEN 'NaN' WHEN 2 THEN '7' END"
_ROSTER = """ro AS (SELECT c_nationkey % 5 AS term, lower(c_mktsegment) || ' ' || c_custkey % 40 AS name_key, c_custkey AS row, CASE WHEN c_custkey % 5 = 0 THEN 'Doğru Yol Partisi'
  ELSE CASE c_custkey % 7 WHEN 0 THEN 'YENİ YOL Partisi' WHEN 3 THEN 'Milliyetçi Hareket Partisi' WHEN 4 THEN '' WHEN 6 THEN c_name ELSE 'Bilinmeyen' END END AS party FROM customer)"""


def _roster(spark, sf):
    name = F.concat_ws(" ", "c_mktsegment", (F.col("c_custkey") % 40).cast("string"))
    r = X.table(spark, sf, "customer").select((F.col("c_nationkey") % 5).alias("term"), name.alias("name"), F.col("c_custkey").alias("row"), F.expr(_LABELS).alias("party"), F.expr(_CHANGED).alias("changed"))
    return turns.roster_index(r, "term", "name", "row", "party", "changed").select("term", "name_key", "row", "place", "party")


@query("roster_index", f"WITH {_ROSTER} SELECT term, name_key, max(row) AS row, min(row) AS place, arg_max(party, row) AS party FROM ro GROUP BY ALL")
def roster_index(spark, sf):
    return _roster(spark, sf)


@query("roster_name_index", f"WITH {_ROSTER} SELECT name_key, arg_max(term, row) AS term, max(row) AS row, arg_max(party, row) AS party FROM ro GROUP BY 1")
def roster_name_index(spark, sf):
    return turns.name_index(_roster(spark, sf)).drop("place")


@query("invalid_party_report", X.with_m("SELECT year, party, count(*) AS n FROM m WHERE party NOT IN ('BUILDING', 'MACHINERY', 'FURNITURE') GROUP BY ALL"))
def invalid_party_report(spark, sf):
    good = spark.createDataFrame([("BUILDING",), ("MACHINERY",), ("FURNITURE",)], "party string")
    return X.mentions(spark, sf).join(F.broadcast(good), "party", "left_anti").groupBy("year", "party").agg(F.count("*").alias("n"))


@query("invalid_party_fix", X.with_m("SELECT CASE WHEN party IN ('BUILDING', 'MACHINERY', 'FURNITURE') THEN party ELSE 'Bilinmeyen' END AS party, count(*) AS n FROM m GROUP BY ALL"))
def invalid_party_fix(spark, sf):
    good = spark.createDataFrame([("BUILDING", True), ("MACHINERY", True), ("FURNITURE", True)], "party string, ok boolean")
    m = X.mentions(spark, sf).join(F.broadcast(good), "party", "left")
    return m.groupBy(F.when(F.col("ok"), F.col("party")).otherwise("Bilinmeyen").alias("party")).agg(F.count("*").alias("n"))


def _lexicon_sql() -> str:
    from parlance.functions.lexicon import CONCEPTS

    from .text_queries import _NORMAL

    hits = lambda c: " + ".join(f"len(regexp_extract_all(t, '{p}'))" for _, _, k, ps in CONCEPTS if k == c for p in ps)
    kinds = sorted({k for _, _, k, _ in CONCEPTS})
    n = {k: [x for x in CONCEPTS if x[2] == k] for k in kinds}
    each = " UNION ALL ".join(f"SELECT '{k}' AS category, {len(n[k])} AS concepts, {sum(len(x[3]) for x in n[k])} AS patterns, count(*) FILTER (WHERE {k} > 0) AS documents, sum({k})::BIGINT AS hits FROM h" for k in kinds)
    return f"WITH d AS (SELECT {_NORMAL} AS t FROM documents), h AS (SELECT {', '.join(f'{hits(k)} AS {k}' for k in kinds)} FROM d) {each}"


@query("lexicon_table", _lexicon_sql())
def lexicon_table(spark, sf):
    """The lexicon's size by category, and how many documents it meets how often."""
    from parlance.functions import text as T
    from parlance.functions.lexicon import CONCEPTS

    t = spark.createDataFrame([(c, len(p)) for _, _, c, p in CONCEPTS], "category string, n int")
    kinds = sorted({c for _, _, c, _ in CONCEPTS})
    d = X.table(spark, sf, "documents").select(T.normalize_text(F.col("text")).alias("t"))
    h = d.select(*[T.pattern_hits(F.col("t"), [p for _, _, c, ps in CONCEPTS if c == k for p in ps]).alias(k) for k in kinds])
    long = h.select(F.inline(F.array(*[F.struct(F.lit(k).alias("category"), F.col(k).alias("n")) for k in kinds])))
    met = long.groupBy("category").agg(F.count_if(F.col("n") > 0).alias("documents"), F.sum("n").cast("bigint").alias("hits"))
    return t.groupBy("category").agg(F.count("*").cast("int").alias("concepts"), F.sum("n").cast("int").alias("patterns")).join(met, "category")
