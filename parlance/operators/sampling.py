"""Seeded samples with a portable order (md5 of id and seed), top-ups, unions and de-duplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(id_col: str, seed: int) -> Column:
    return F.md5(F.concat_ws("|", F.col(id_col).cast("string"), F.lit(str(seed))).cast("binary"))


def per_group(rows: DataFrame, keys: list[str], id_col: str, n: int, seed: int) -> DataFrame:
    """Up to n rows of each group, the same on every run and partitioning."""
    w = Window.partitionBy(*keys).orderBy(draw(id_col, seed), id_col)
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def stratified(rows: DataFrame, strata: list[str], id_col: str, n: int, seed: int) -> DataFrame:
    """n // strata rows (at least 1) of each stratum, topped up from the rest to n, cut to n."""
    w = Window.partitionBy(*strata).orderBy(draw(id_col, seed), id_col)
    # no stratum gives more than n rows, so only n rows of each reach the common order
    some = rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).withColumn("_d", draw(id_col, seed))
    many = rows.select(*strata).distinct().agg(F.greatest(F.floor(F.lit(n) / F.count("*")), F.lit(1)).alias("_each"))
    some = some.crossJoin(F.broadcast(many)).withColumn("_late", (F.col("_r") > F.col("_each")).cast("int"))
    return some.orderBy("_late", "_d", id_col).limit(n).select(*rows.columns)


def keep_last(frames: list[DataFrame], key: list[str]) -> DataFrame:
    """Union of sources; for each key the row of the last source stays."""
    every = None
    for i, f in enumerate(frames):
        f = f.withColumn("_source", F.lit(i))
        every = f if every is None else every.unionByName(f, allowMissingColumns=True)
    w = Window.partitionBy(*key).orderBy(F.desc("_source"))
    return every.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_source")


def duplicate_count(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))


def candidate_pools(rows: DataFrame, labelled: DataFrame, id_col: str, words: int = 30, band: float = 0.05) -> DataFrame:
    """Rows that may be annotated, with their pool; those of other pools, of few words or already labelled are left out.

    ``rows`` has label, score, hits and word_count. Pools: the signed labels, and the border: mixed rows
    with a score of at least ``band`` in size or with any hit.
    """
    border = (F.col("label") == "mixed") & ((F.abs("score") >= band) | (F.col("hits") > 0))
    pool = F.when(F.col("label").isin("positive", "negative"), F.col("label")).when(border, "border")
    return rows.where(F.col("word_count") >= words).join(labelled.select(id_col).distinct(), id_col, "left_anti").withColumn("pool", pool).where("pool is not null")


def gold_union(first: DataFrame, second: DataFrame, label: str = "label") -> DataFrame:
    """All rows of the first gold set and the labelled rows of the second, with their source and whether they belong to the binary subset."""
    some = second.where(F.trim(F.coalesce(F.col(label).cast("string"), F.lit(""))) != "")
    every = first.withColumn("source", F.lit("v1")).unionByName(some.withColumn("source", F.lit("v2")), allowMissingColumns=True)
    return every.withColumn("binary", F.coalesce(F.col(label) != "mixed", F.lit(False)))


def annotation_table(verified: DataFrame, candidates: DataFrame, id_col: str, heuristic: str, annotators: list[str]) -> DataFrame:
    """Verified rows and the candidates that aren't among them, a column for each annotator, a flag, and the final label: the verified one, else the heuristic."""
    new = candidates.join(verified.select(id_col), id_col, "left_anti").withColumn("verified", F.lit(False))
    every = verified.withColumn("verified", F.lit(True)).unionByName(new, allowMissingColumns=True)
    blank = {a: F.lit(None).cast("string") for a in annotators if a not in every.columns}
    every = every.withColumns(blank) if blank else every
    final = F.coalesce(F.when(F.col("verified"), F.col("final_label")), F.col(heuristic)) if "final_label" in every.columns else F.col(heuristic)
    return every.withColumn("final_label", final)
