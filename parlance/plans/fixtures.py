"""Views over the star-schema tables in the shape of the library's inputs, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.operators.mentions import score_columns
from parlance.sources.tables import table

CATEGORY = {
    "ECONOMY": "macro_economy",
    "MEDIUM": "macro_economy",
    "STANDARD": "constitutional_conflict",
    "PROMO": "democratic_reform",
    "SMALL": "security_conflict",
    "LARGE": "security_conflict",
}
CONCEPTS = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
CATEGORIES = ["constitutional_conflict", "democratic_reform", "macro_economy", "security_conflict"]
PARTIES = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
ANCHORS = {"AUTOMOBILE": -1.0, "BUILDING": 0.8, "FURNITURE": 0.2, "HOUSEHOLD": -0.3, "MACHINERY": 1.2}
TERMS = [(1, "1995-01-01", "1996-12-31"), (2, "1997-01-01", "1998-12-31"), (3, "1999-01-01", "2000-12-31"), (4, "2001-01-01", "2001-12-31")]
#: term, label, requested month, kind; the last one isn't in the data.
EVENTS = [
    (1, "e1", "1995-09-01", "core"), (1, "e2", "1996-05-01", "other"), (2, "e3", "1997-08-01", "core"), (2, "e4", "1998-04-01", "core"),
    (3, "e5", "1999-06-01", "other"), (3, "e6", "2000-03-01", "core"), (4, "e7", "2001-04-01", "core"), (4, "e8", "2002-01-01", "other"),
]
GOVERNMENT = ["BUILDING", "MACHINERY"]


#: Line items of a task of the join with the orders.
TASK_ROWS = 500_000


def tasks(spark: SparkSession, sf_dir: str, name: str = "lineitem") -> int:
    """The shuffle partitions, or more where the table has more rows than these take by ``TASK_ROWS`` each."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-table(spark, sf_dir, name).count() // TASK_ROWS))


def _by_order(line: DataFrame, order: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with their orders, dealt out by order: aggregations by speech follow without a shuffle.

    Where a table has more rows than the shuffle partitions take by ``TASK_ROWS`` each, it gets more of them.
    """
    n = tasks(spark, sf_dir)
    if n > int(spark.conf.get("spark.sql.shuffle.partitions")):
        line, order = line.repartition(n, "l_orderkey"), order.repartition(n, "o_orderkey")
    return line.join(order, F.col("l_orderkey") == F.col("o_orderkey"))


def mentions(spark: SparkSession, sf_dir: str, nation: bool = False) -> DataFrame:
    """Signed mentions: a line item is a mention of its part's type by its customer's segment (or nation)."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_linenumber", "l_returnflag")
    order = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    line = line.join(part, F.col("l_partkey") == F.col("p_partkey"))
    rows = _by_order(line, order.join(customer, F.col("o_custkey") == F.col("c_custkey")), spark, sf_dir)
    category = F.create_map(*[F.lit(x) for kv in CATEGORY.items() for x in kv])[F.col("p_type")]
    signed = lambda flag: F.when(F.col("l_returnflag") == flag, F.col("l_linenumber")).otherwise(0).cast("bigint")
    party = F.concat(F.lit("N"), F.col("c_nationkey").cast("string")) if nation else F.col("c_mktsegment")
    rows = rows.select(
        F.col("l_orderkey").alias("speech_id"), F.col("o_orderdate").cast("date").alias("date"), F.year("o_orderdate").alias("year"),
        F.trunc("o_orderdate", "MM").alias("month"), F.col("o_custkey").alias("speaker"), party.alias("party"), F.col("p_type").alias("concept"),
        category.alias("category"), F.col("l_quantity").cast("bigint").alias("mention_count"), signed("A").alias("pos"), signed("R").alias("neg"),
    )
    return score_columns(rows)


def mentions_sql(name: str = "m", nation: bool = False) -> str:
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CATEGORY.items())
    party = "'N' || c_nationkey" if nation else "c_mktsegment"
    return f"""{name}0 AS (SELECT l_orderkey AS speech_id, CAST(o_orderdate AS DATE) AS date, CAST(year(o_orderdate) AS INTEGER) AS year,
      CAST(date_trunc('month', o_orderdate) AS DATE) AS month, o_custkey AS speaker, {party} AS party, p_type AS concept,
      CASE p_type {cases} END AS category, CAST(l_quantity AS BIGINT) AS mention_count,
      CAST(CASE WHEN l_returnflag = 'A' THEN l_linenumber ELSE 0 END AS BIGINT) AS pos,
      CAST(CASE WHEN l_returnflag = 'R' THEN l_linenumber ELSE 0 END AS BIGINT) AS neg
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey),
    {name} AS (SELECT *, mention_count + 0.35::DOUBLE * (pos + neg) AS salience, round((pos - neg) / (pos + neg + 1.0::DOUBLE), 4) AS score,
      CASE WHEN (pos - neg) / (pos + neg + 1.0::DOUBLE) >= 0.2 THEN 'positive' WHEN (pos - neg) / (pos + neg + 1.0::DOUBLE) <= -0.2 THEN 'negative' ELSE 'mixed' END AS label
      FROM {name}0)"""


def with_m(body: str, nation: bool = False) -> str:
    """SQL over the mentions view ``m``."""
    return f"WITH {mentions_sql(nation=nation)} {body}" if body.lstrip().startswith("SELECT") else f"WITH {mentions_sql(nation=nation)}, {body}"


def terms(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TERMS, "term int, start string, stop string").select("term", F.to_date("start").alias("start"), F.to_date("stop").alias("stop"))


TERMS_SQL = "terms(term, start, stop) AS (VALUES " + ", ".join(f"({t}, DATE '{a}', DATE '{b}')" for t, a, b in TERMS) + ")"


def events(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(EVENTS, "term int, event string, target string, kind string").withColumn("target", F.to_date("target"))


EVENTS_SQL = "events_c(term, event, target, kind) AS (VALUES " + ", ".join(f"({t}, '{e}', DATE '{d}', '{k}')" for t, e, d, k in EVENTS) + ")"


def anchors(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(ANCHORS.items()), "party string, anchor double")


ANCHORS_SQL = "anchors(party, anchor) AS (VALUES " + ", ".join(f"('{p}', {a}::DOUBLE)" for p, a in ANCHORS.items()) + ")"


def bloc(party) -> object:
    return F.when(party.isin(GOVERNMENT), "government").otherwise("opposition")


BLOC_SQL = "CASE WHEN party IN (" + ", ".join(f"'{p}'" for p in GOVERNMENT) + ") THEN 'government' ELSE 'opposition' END"


def macro_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly order value by priority: five series s1 to s5."""
    o = table(spark, sf_dir, "orders").select(F.trunc("o_orderdate", "MM").alias("month"), F.substring("o_orderpriority", 1, 1).alias("p"), "o_totalprice")
    return o.groupBy("month").agg(*[F.round(F.sum(F.when(F.col("p") == str(i), F.col("o_totalprice"))), 2).alias(f"s{i}") for i in range(1, 6)])


MACRO_SQL = (
    "macro AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, "
    + ", ".join(f"round(sum(CASE WHEN o_orderpriority LIKE '{i}%' THEN o_totalprice END), 2) AS s{i}" for i in range(1, 6))
    + " FROM orders GROUP BY 1)"
)
TYPES = ["click", "error", "purchase", "signup", "view"]


def market_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily mean event value of each type: five closes."""
    e = table(spark, sf_dir, "events").select(F.to_date("ts").alias("date"), "event_type", "value")
    return e.groupBy("date").agg(*[F.round(F.avg(F.when(F.col("event_type") == t, F.col("value"))), 6).alias(f"{t}_close") for t in TYPES])


MARKET_SQL = (
    "market AS (SELECT CAST(ts AS DATE) AS date, " + ", ".join(f"round(avg(CASE WHEN event_type = '{t}' THEN value END), 6) AS {t}_close" for t in TYPES) + " FROM events GROUP BY 1)"
)


def directed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directed mentions: customer nation to supplier nation, signed by the return flag."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey", "l_quantity", "l_returnflag")
    order = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    line = line.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(part, F.col("l_partkey") == F.col("p_partkey"))
    rows = _by_order(line, order.join(customer, F.col("o_custkey") == F.col("c_custkey")), spark, sf_dir).where("c_nationkey <> s_nationkey")
    n = lambda c: F.concat(F.lit("N"), F.col(c).cast("string"))
    part_of = lambda f: F.when(F.col("l_returnflag") == f, F.col("l_quantity")).otherwise(0.0)
    return rows.select(
        F.col("l_orderkey").alias("speech_id"), F.trunc("o_orderdate", "MM").alias("month"), F.year("o_orderdate").alias("year"), n("c_nationkey").alias("source"),
        n("s_nationkey").alias("target"), F.col("p_type").alias("topic"), F.col("l_quantity").alias("total"), part_of("A").alias("positive"), part_of("R").alias("negative"),
    )


DIRECTED_SQL = """directed AS (SELECT l_orderkey AS speech_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, CAST(year(o_orderdate) AS INTEGER) AS year,
  'N' || c_nationkey AS source, 'N' || s_nationkey AS target, p_type AS topic, l_quantity AS total,
  CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0.0 END AS positive, CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0.0 END AS negative
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN part ON l_partkey = p_partkey WHERE c_nationkey <> s_nationkey)"""
