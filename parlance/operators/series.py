"""Window functions over ordered series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def ordered(order: str, keys: list[str] | None = None) -> WindowSpec:
    """Rows of one series in order; a series without keys is a panel of periods, not of raw rows."""
    return Window.partitionBy(*(keys or [F.lit(0)])).orderBy(order)


def lags_leads(rows: DataFrame, w: WindowSpec, lag: dict[str, list[int]], lead: dict[str, list[int]]) -> DataFrame:
    back = [F.lag(c, k).over(w).alias(f"{c}_lag{k}") for c, ks in lag.items() for k in ks]
    ahead = [F.lead(c, k).over(w).alias(f"{c}_lead{k}") for c, ks in lead.items() for k in ks]
    return rows.select("*", *back, *ahead)


def pct_change(value: str, w: WindowSpec, k: int = 1) -> Column:
    """Change to the value k rows before, in percent; gaps aren't filled."""
    before = F.lag(value, k).over(w)
    return 100 * (F.col(value) / F.nullif(before, F.lit(0.0)) - 1)


def difference(value: str, w: WindowSpec) -> Column:
    return F.col(value) - F.lag(value).over(w)


def interpolate(rows: DataFrame, value: str, order: str, keys: list[str] | None = None, ends: bool = False, out: str = "filled") -> DataFrame:
    """Linear gap fill by row position; with ``ends``, the first and last value extend outwards."""
    w = ordered(order, keys)
    n = F.row_number().over(w)
    at = rows.withColumn("_n", n)
    w0, w1 = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col(value).isNotNull(), F.col("_n"))
    at = at.select(
        "*", F.last(value, True).over(w0).alias("_a"), F.first(value, True).over(w1).alias("_b"), F.last(known, True).over(w0).alias("_na"), F.first(known, True).over(w1).alias("_nb")
    )
    step = (F.col("_n") - F.col("_na")) / F.nullif(F.col("_nb") - F.col("_na"), F.lit(0))
    filled = F.coalesce(F.col(value), F.col("_a") + (F.col("_b") - F.col("_a")) * step)
    if ends:
        filled = F.coalesce(filled, "_a", "_b")
    return at.withColumn(out, filled).drop("_n", "_a", "_b", "_na", "_nb")


def first_last(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """First and last non-null value in order, their return in percent (null with under two values or a zero start)."""
    some = rows.where(F.col(value).isNotNull())
    out = some.groupBy(*keys).agg(F.min_by(value, order).alias("first"), F.max_by(value, order).alias("last"), F.count("*").alias("n"))
    change = 100 * (F.col("last") / F.nullif(F.col("first"), F.lit(0.0)) - 1)
    return out.withColumn("return_pct", F.when(F.col("n") >= 2, change))


def relative_index(rows: DataFrame, events: DataFrame, value: str, span: int = 4, at: str = "event_month") -> DataFrame:
    """Rows by their position around each event among available months, and value over the mean before it."""
    joined = events.join(rows)
    w = Window.partitionBy("event").orderBy("month")
    n = joined.withColumn("_n", F.row_number().over(w))
    zero = F.min(F.when(F.col("month") >= F.col(at), F.col("_n"))).over(Window.partitionBy("event"))
    n = n.withColumn("relative", (F.col("_n") - zero).cast("int")).where(F.col("relative").between(-span, span))
    base = F.avg(F.when(F.col("relative") < 0, F.col(value))).over(Window.partitionBy("event"))
    return n.withColumn("index", F.col(value) / F.when(F.coalesce(base, F.lit(0.0)) == 0, 0.001).otherwise(base)).drop("_n")
