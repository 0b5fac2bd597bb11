"""Result tables over events: families, findings, focus events, readings, and the edges worth showing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def family_summary(rows: DataFrame, family: str, values: list[str], flags: list[str]) -> DataFrame:
    """Per family the events, the mean of each value and the share of true flags (null counts as false)."""
    means = [F.avg(v).alias(f"mean_{v}") for v in values]
    shares = [F.avg(F.coalesce(F.col(f), F.lit(False)).cast("double")).alias(f"share_{f}") for f in flags]
    return rows.groupBy(family).agg(F.count("*").alias("events"), *means, *shares)


def focus(rows: DataFrame, keys: list[str], value: str, core: Column, name: str) -> DataFrame:
    """Of each group the row with the largest absolute value among the core rows (all rows without one), ties by name."""
    w = Window.partitionBy(*keys)
    some = rows.withColumn("_c", core).withColumn("_any", F.max("_c").over(w)).where(F.col("_c") == F.col("_any"))
    best = w.orderBy(F.desc_nulls_last(F.abs(value)), name)
    return some.withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r", "_c", "_any")


def most_frequent(rows: DataFrame, name: str, n: int) -> DataFrame:
    """The n most frequent values, ties in order."""
    return rows.where(F.col(name).isNotNull()).groupBy(name).agg(F.count("*").alias("n")).orderBy(F.desc("n"), name).limit(n)


def key_findings(shifts: DataFrame, owners: DataFrame, intervals: DataFrame, core: Column) -> DataFrame:
    """One row: the core event with the largest shift, the most frequent owner, and the extreme intervals.

    ``shifts``: event, shift; ``owners``: owner; ``intervals``: party, center, left_end, right_end.
    """
    top = shifts.where(core).agg(F.max_by(F.struct("event", "shift"), F.struct(F.abs("shift"), "event")).alias("t"))
    own = most_frequent(owners, "owner", 1).select(F.col("owner").alias("top_owner"), F.col("n").alias("owned"))
    ends = intervals.agg(F.min_by("party", F.struct("center", "party")).alias("leftmost"), F.max_by("party", F.struct("center", "party")).alias("rightmost"), F.max_by("party", F.struct(F.col("right_end") - F.col("left_end"), F.col("party"))).alias("widest"))
    return top.select(F.col("t.event").alias("event"), F.col("t.shift").alias("shift")).crossJoin(own).crossJoin(ends)  # single rows


def support(rows: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """Support flags, their number and its reading: strong from 4, partial from 2, else weak."""
    out = rows.select("*", *[F.coalesce(c, F.lit(False)).alias(k) for k, c in flags.items()])
    count = sum((F.col(k).cast("int") for k in flags), F.lit(0))
    reading = F.when(F.col("support_count") >= 4, "strong").when(F.col("support_count") >= 2, "partial").otherwise("weak")
    return out.withColumn("support_count", count).withColumn("reading", reading)


def top_edges(edges: DataFrame, item: str, other: str, weight: str, per_item: int = 3, most: int = 30) -> DataFrame:
    """The strongest edges of each item, of these the strongest overall; ties by names."""
    order = [F.desc(weight), F.col(item), F.col(other)]
    some = edges.withColumn("_r", F.row_number().over(Window.partitionBy(item).orderBy(*order))).where(F.col("_r") <= per_item)
    return some.drop("_r").dropDuplicates([item, other]).orderBy(*order).limit(most)


def strong_edges(edges: DataFrame, weight: str, least: int, share: float = 0.18, quantile: float = 0.65) -> DataFrame:
    """Edges from max(share x largest, quantile) up, but at least ``least`` of them."""
    positive = edges.where(F.col(weight) > 0)
    cut = positive.agg(F.greatest(share * F.max(weight), F.percentile(weight, F.lit(quantile))).alias("_cut"))
    best = positive.orderBy(F.desc(weight), "source", "target").limit(least).withColumn("_top", F.lit(True)).select("source", "target", "_top")
    rows = positive.crossJoin(F.broadcast(cut)).join(F.broadcast(best), ["source", "target"], "left")  # one row; at most ``least``
    return rows.where((F.col(weight) >= F.col("_cut")) | F.col("_top")).drop("_cut", "_top")


def largest(rows: DataFrame, value: str, names: list[str]) -> DataFrame:
    """The row with the largest value (to 9 digits), of equal ones the one with the last names."""
    return rows.orderBy(F.desc(F.round(value, 9)), *[F.desc(n) for n in names]).limit(1)


def regimes(rows: DataFrame, term: str, value: str) -> DataFrame:
    """Number of terms (one row each, a few) whose value rose, fell or stayed against the term before."""
    change = F.round(F.col(value) - F.lag(value).over(Window.partitionBy(F.lit(0)).orderBy(term)), 9)
    name = F.when(F.col("_d") > 0, "widening").when(F.col("_d") < 0, "narrowing").otherwise("level")
    return rows.select(change.alias("_d")).where("_d IS NOT NULL").groupBy(name.alias("regime")).agg(F.count("*").alias("terms"))
