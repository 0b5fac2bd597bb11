"""Writers of result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def csv_table(df: DataFrame, path: str) -> None:
    """One CSV file with a header; for results, which are small."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def by_year(df: DataFrame, path: str, date: str, rows_per_file: int = 5_000_000) -> None:
    """Parquet in one folder per year; a year's rows are gathered to one file for each ``rows_per_file`` of them."""
    rows = df.withColumn("year", F.year(date))
    sizes = rows.groupBy("year").agg(F.ceil(F.count("*") / rows_per_file).alias("_files")).withColumnRenamed("year", "_y")
    dealt = rows.join(F.broadcast(sizes), F.col("year").eqNullSafe(F.col("_y")))  # one row a year
    part = F.pmod(F.monotonically_increasing_id(), F.col("_files"))
    dealt.withColumn("_part", part).repartition("year", "_part").drop("_y", "_files", "_part").write.mode("overwrite").partitionBy("year").parquet(path)


def json_report(df: DataFrame, path: str, key: str) -> None:
    """A JSON object per key with the other columns."""
    df.select(key, F.struct(*[c for c in df.columns if c != key]).alias("report")).coalesce(1).write.mode("overwrite").json(path)
