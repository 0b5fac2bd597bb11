"""Cutting the lineage of iterative plans in a way that survives lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


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


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def staged(df: DataFrame) -> DataFrame:
    """A Parquet table in the shared folder, for rows of which later plans read some columns each."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/parlance-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
