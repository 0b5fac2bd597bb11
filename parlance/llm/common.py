"""Shared helpers: tables in the folder all executors see, and column plumbing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset, a temporary one in local mode and an error on a cluster."""
    sc = spark.sparkContext
    got = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not got:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        got = sc.getCheckpointDir()
    return got


def staged(df: DataFrame, what: str, options: dict[str, str] | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    This cuts the lineage in a way that survives the loss of any executor.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.options(**(options or {})).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def unstage(df: DataFrame) -> None:
    """Delete a table that ``staged`` wrote and that no later plan reads."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.staged_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Inside, the shuffle files of a query are deleted when it ends, not some time after its plan is garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have (names compare case-insensitively)."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def ranked(df: DataFrame, by: list[str], within: str | None = None, out: str = "rank") -> DataFrame:
    """Exact ranks from 0 in the order of ``by`` (over all rows, or inside each value of ``within``).

    Rows are dealt out by range on ``within`` and ``by``, so no task gets one whole group; each task's
    part is numbered alone and moved up by the rows of the tasks before it. ``by`` must make rows
    distinct, or else ties are numbered in any order.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [within] if within else []
    part, tie = fresh(df, "_part"), fresh(df, "_tie")
    rows = df.repartitionByRange(n, *keys, *by).withColumn(part, F.spark_partition_id()).withColumn(tie, F.monotonically_increasing_id())
    rows = staged(rows, "ranges")
    here = Window.partitionBy(part, *keys).orderBy(*by, tie)
    # one row per task and group that it holds: at most the tasks plus the groups
    counts = rows.groupBy(part, *keys).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    counts = staged(counts.select(part, *keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")), "offsets")
    rows = rows.withColumn(out, F.row_number().over(here) - 1)
    counts = counts.withColumnRenamed(part, "_in")
    same = rows[part] == counts["_in"]
    if within:
        counts = counts.withColumnRenamed(within, "_within")
        same = same & rows[within].eqNullSafe(counts["_within"])
    return rows.join(counts, same).select(*df.columns, (F.col("_before") + F.col(out)).alias(out))


def running(df: DataFrame, within: list[str], by: list[str], sums: dict[str, str]) -> DataFrame:
    """Running sums of long columns (``sums``: new name to column) along ``by`` inside each value of ``within``.

    Rows are dealt out by range, so a large group is spread over tasks; each task adds up its part in one
    pass, and the groups that cross a border get the sums of the tasks before. ``within`` and the summed
    columns hold no nulls; rows equal in ``by`` come in any order. The result is read from a written table.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = fresh(df, "_part")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + "".join(f", `{c}` long" for c in sums)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, carry = None, {c: 0 for c in sums}
        for b in batches:
            if not b.num_rows:
                continue
            keys = [b.column(k).to_numpy(zero_copy_only=False) for k in within]
            new = np.zeros(b.num_rows, bool)
            for k in keys:
                new[1:] |= k[1:] != k[:-1]
            new[0] = last != tuple(k[0] for k in keys)
            start = np.maximum.accumulate(np.where(new, np.arange(b.num_rows), -1))  # -1: the group began in an earlier batch
            cols = list(b.columns)
            for out, c in sums.items():
                total = np.append(0, np.cumsum(b.column(c).to_numpy(zero_copy_only=False), dtype=np.int64))
                got = total[1:] - np.where(start < 0, 0, total[np.maximum(start, 0)]) + np.where(start < 0, carry[out], 0)
                carry[out] = int(got[-1])
                cols.append(pa.array(got))
            last = tuple(k[-1] for k in keys)
            yield pa.RecordBatch.from_arrays(cols, names=[*b.schema.names, *sums])

    rows = df.repartitionByRange(n, *within, *by).sortWithinPartitions(*within, *by).mapInArrow(add, schema).withColumn(part, F.spark_partition_id())
    rows = staged(rows, "running")
    totals = rows.groupBy(part, *within).agg(*[F.sum(c).alias(f"_before_{out}") for out, c in sums.items()])
    spans = Window.partitionBy(*within)
    before = spans.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_parts", F.count("*").over(spans))
    totals = totals.select(part, *within, "_parts", *[F.sum(f"_before_{out}").over(before).alias(f"_before_{out}") for out in sums])
    # only groups that cross a border: at most two per task
    totals = F.broadcast(staged(totals.where("_parts > 1").drop("_parts"), "borders"))
    rows = rows.join(totals, [part, *within], "left")
    return rows.select(*df.columns, *[(F.col(out) + F.coalesce(F.col(f"_before_{out}"), F.lit(0))).alias(out) for out in sums])
