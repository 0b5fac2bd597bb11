"""Readers of text, delimited, JSON and XML inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def csv_pruned(spark: SparkSession, path: str, schema: str, columns: list[str]) -> DataFrame:
    """Header CSV with a stated schema; only the named columns are parsed."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path).select(*columns)


#: Bytes that windows-1254 reads otherwise than ISO-8859-1, their signs there, and the bytes that it leaves undefined.
_BYTES = [(chr(b), bytes([b]).decode("cp1254", "ignore")) for b in range(128, 256)]
_LATIN, _TURKISH = ("".join(x) for x in zip(*[(a, c) for a, c in _BYTES if c and a != c]))
_UNDEFINED = "[" + "".join(a for a, c in _BYTES if not c) + "]"


def _encoding(lines: DataFrame) -> str:
    """The first of UTF-8, windows-1254 and ISO-8859-1 that can decode every line."""
    if lines.where(~F.is_valid_utf8("value")).isEmpty():
        return "UTF-8"
    latin = F.decode(F.col("value").cast("binary"), "ISO-8859-1")
    return "windows-1254" if lines.where(latin.rlike(_UNDEFINED)).isEmpty() else "ISO-8859-1"


def csv_flexible(spark: SparkSession, path: str, seps: str = ",|;\t") -> DataFrame:
    """Unknown delimiter and encoding: the first line decides the delimiter, all lines decide the encoding.

    Spark doesn't read windows-1254, so such a file is read as ISO-8859-1 and its signs are exchanged.
    """
    lines = spark.read.text(path)
    encoding = _encoding(lines)
    head = lines.first()
    sep = max(seps, key=(head.value if head else "").lstrip("\ufeff").count)
    turkish = encoding == "windows-1254"
    df = spark.read.option("header", True).option("sep", sep).option("encoding", "ISO-8859-1" if turkish else encoding).csv(path)
    names = [c.lstrip("\ufeff") for c in df.columns]
    if not turkish:
        return df.toDF(*names)
    df = df.toDF(*[f"_c{i}" for i in range(len(names))])
    table = str.maketrans(_LATIN, _TURKISH)
    return df.select(*[F.translate(c, _LATIN, _TURKISH).alias(n.translate(table)) for c, n in zip(df.columns, names)])


def text_corpus(spark: SparkSession, path: str, name: str = r"([^/]+?)(?:\.[^./]*)?$") -> DataFrame:
    """One transcript per file; its id is what ``name`` finds in the file's path, by default the stem of the file."""
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("_f"), F.col("value").alias("text"))
    return rows.select(F.regexp_extract("_f", name, 1).alias("doc_id"), "text")


_CHART = """chart struct<result array<struct<timestamp array<bigint>, indicators struct<
    quote array<struct<open array<double>, high array<double>, low array<double>, close array<double>, volume array<bigint>>>,
    adjclose array<struct<adjclose array<double>>>>>>>, _bad string"""


def _json(text: Column, schema: str) -> Column:
    return F.from_json(text, schema, {"columnNameOfCorruptRecord": "_bad"})


def malformed(docs: DataFrame, text: str, schema: str = _CHART) -> DataFrame:
    """Documents that aren't JSON of the schema, kept apart from what the readers give."""
    got = _json(F.col(text), schema)
    return docs.where(got.isNull() | got["_bad"].isNotNull())


def chart(docs: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """Market documents to rows (keys, timestamp, date in UTC, open, high, low, close, adjclose, volume).

    A document holds parallel arrays; the first result and its first quote count. Arrays that are missing
    or short give nulls; rows without a close and documents that can't be read give nothing.
    """
    rows = docs.select(*keys, _json(F.col(text), _CHART).alias("_d")).where("_d._bad IS NULL")
    rows = rows.select(*keys, F.get("_d.chart.result", F.lit(0)).alias("_r"))
    rows = rows.select(*keys, F.col("_r.timestamp").alias("_t"), F.get("_r.indicators.quote", F.lit(0)).alias("_q"), F.get("_r.indicators.adjclose", F.lit(0))["adjclose"].alias("_a"))
    some = lambda c, kind: F.coalesce(c, F.array().cast(f"array<{kind}>"))
    prices = [some(F.col(f"_q.{c}"), "double").alias(c) for c in ("open", "high", "low", "close")]
    rows = rows.select(*keys, some(F.col("_t"), "bigint").alias("timestamp"), *prices, some(F.col("_a"), "double").alias("adjclose"), some(F.col("_q.volume"), "bigint").alias("volume"))
    columns = ["timestamp", "open", "high", "low", "close", "adjclose", "volume"]
    flat = rows.select(*keys, F.inline(F.arrays_zip(*columns))).where("timestamp IS NOT NULL AND close IS NOT NULL AND NOT isnan(close)")
    return flat.select(*keys, "timestamp", F.date_from_unix_date(F.floor(F.col("timestamp") / 86400).cast("int")).alias("date"), *columns[1:])


def indicators(docs: DataFrame, text: str, code: str, name: str, first: int = 2002, last: int | None = None) -> DataFrame:
    """Indicator documents, lists of a header and the observations, to long rows (year, code, name, value).

    Years outside first to last (this year where not given) or that aren't numbers go; values that aren't
    numbers are null. A document without a list of observations gives nothing.
    """
    parts = F.from_json(F.col(text), "array<string>")
    rows = docs.select(F.col(code).alias("code"), F.col(name).alias("name"), F.from_json(F.get(parts, F.lit(1)), "array<struct<date string, value string>>").alias("_o"))
    rows = rows.select("code", "name", F.inline("_o")).select(F.expr("try_cast(date AS int)").alias("year"), "code", "name", F.expr("try_cast(value AS double)").alias("value"))
    return rows.where(F.col("year").between(first, F.lit(last) if last else F.year(F.current_date())))


def indicators_wide(long: DataFrame, names: list[str]) -> DataFrame:
    """One row per year, one column per indicator; of several values the one with the smallest code, then the smallest value."""
    some = long.where("value IS NOT NULL")
    return some.groupBy("year").pivot("name", names).agg(F.min_by("value", F.struct("code", "value")))


def rates(docs: DataFrame, text: str, keys: list[str], currency: str = "USD") -> DataFrame:
    """Exchange-rate documents to (keys, buying, selling, mid, high, low) of one of their currency elements.

    The first element with the currency's code (either attribute) counts. mid is the mean of both rates or
    the one there is; documents without the element, without a rate, or that can't be read give nothing.
    """
    parsed = F.from_xml(F.col(text), "Currency array<struct<_CurrencyCode string, _Kod string, ForexBuying string, ForexSelling string>>")
    mine = F.filter(parsed["Currency"], lambda c: (F.coalesce(c["_CurrencyCode"], F.lit("")) == currency) | (F.coalesce(c["_Kod"], F.lit("")) == currency))
    rows = docs.select(*keys, F.get(mine, F.lit(0)).alias("_c"))
    number = lambda c: F.replace(F.trim(F.col(f"_c.{c}")), F.lit(","), F.lit(".")).try_cast("double")
    rows = rows.select(*keys, number("ForexBuying").alias("buying"), number("ForexSelling").alias("selling")).where("buying IS NOT NULL OR selling IS NOT NULL")
    mid = F.coalesce((F.col("buying") + F.col("selling")) / 2, "buying", "selling")
    return rows.select(*keys, "buying", "selling", mid.alias("mid"), F.greatest("buying", "selling").alias("high"), F.least("buying", "selling").alias("low"))


def matrix_long(wide: DataFrame, year: str, months: list[str], labels: list[str]) -> DataFrame:
    """Year x month matrix with labels to (labels, date, value); rows with a bad year and null cells go."""
    y = wide.withColumn("_y", F.trim(year).try_cast("int")).where("_y is not null")
    long = y.select(*labels, "_y", *[F.replace(F.col(m).cast("string"), F.lit(","), F.lit(".")).try_cast("double").alias(m) for m in months]).unpivot([*labels, "_y"], months, "_m", "value")
    number = F.create_map(*[F.lit(x) for i, m in enumerate(months) for x in (m, i + 1)])
    return long.where("value is not null").select(*labels, F.make_date("_y", number[F.col("_m")], F.lit(1)).alias("date"), "value")
