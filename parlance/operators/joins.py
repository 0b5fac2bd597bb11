"""Spines, range and as-of joins, window tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def month_spine(bounds: DataFrame, start: str = "start", stop: str = "stop", out: str = "month") -> DataFrame:
    """A row per month-start between two dates (inclusive) of each row of ``bounds``."""
    months = F.sequence(F.trunc(start, "MM"), F.trunc(stop, "MM"), F.expr("interval 1 month"))
    return bounds.select("*", F.explode(months).alias(out))


def business_days(bounds: DataFrame, start: str = "start", stop: str = "stop", out: str = "date") -> DataFrame:
    """A row per weekday from Monday to Friday."""
    days = F.sequence(F.col(start), F.col(stop), F.expr("interval 1 day"))
    return bounds.select("*", F.explode(days).alias(out)).where(F.weekday(out) < 5)


def term_of(rows: DataFrame, terms: DataFrame, date: str = "date") -> DataFrame:
    """Inclusive range join to a term table of a few rows; rows outside all windows get nulls."""
    inside = F.col(date).between(F.col("start"), F.col("stop"))
    return rows.join(F.broadcast(terms), inside, "left").drop("start", "stop")


def multiway_left(base: DataFrame, others: list[DataFrame], key: str) -> DataFrame:
    """Left joins of frames on one key; a column that is there already isn't taken again."""

    def add(left: DataFrame, right: DataFrame) -> DataFrame:
        return left.join(right.select(key, *[c for c in right.columns if c not in left.columns]), key, "left")

    return reduce(add, others, base)


def outer_merge(frames: list[DataFrame], key: str) -> DataFrame:
    """Full outer merge of series on one key."""
    return reduce(lambda a, b: a.join(b, key, "full"), frames)


def resolve_month(events: DataFrame, months: DataFrame, target: str = "target", month: str = "month") -> DataFrame:
    """Effective month of an event: the first month at or after the target, else the last one there is."""
    rows = events.join(F.broadcast(months.select(month).distinct()))
    later = F.min(F.when(F.col(month) >= F.col(target), F.col(month)))
    return rows.groupBy(*events.columns).agg(F.coalesce(later, F.max(month)).alias("event_month"))


def stage_windows(events: DataFrame, pre: int = 3, post: int = 3, at: str = "event_month") -> DataFrame:
    """Calendar months of each event's stages pre, shock and post."""
    months = F.sequence(F.add_months(at, -pre), F.add_months(at, post), F.expr("interval 1 month"))
    rows = events.select("*", F.explode(months).alias("month"))
    stage = F.when(F.col("month") < F.col(at), "pre").when(F.col("month") == F.col(at), "shock").otherwise("post")
    return rows.withColumn("stage", stage)


def eligible_months(months: DataFrame, pre: int = 3, post: int = 3, month: str = "month") -> DataFrame:
    """Months whose ``pre`` predecessors and ``post`` successors are all there."""
    m = months.select(month).distinct()
    near = F.sequence(F.add_months(month, -pre), F.add_months(month, post), F.expr("interval 1 month"))
    wanted = m.select(month, F.explode(near).alias("_need"))
    there = wanted.join(m.select(F.col(month).alias("_need")), "_need", "left_semi")
    return there.groupBy(month).agg(F.count("*").alias("_n")).where(F.col("_n") == pre + post + 1).select(month)


def day_windows(events: DataFrame, at: str = "event_month", pre: int = 2, post: int = 2) -> DataFrame:
    """pre: [event - 2 months, event - 1 day]; post: [event, event + 2 months + 27 days]."""
    return events.select(
        "*", F.add_months(at, -pre).alias("pre_start"), F.date_sub(at, 1).alias("pre_stop"), F.col(at).alias("post_start"), F.date_add(F.add_months(at, post), 27).alias("post_stop")
    )


def available_window(events: DataFrame, months: DataFrame, n: int, at: str = "event_month") -> DataFrame:
    """The last n months before each event and the first n at or after it that are in the data."""
    rows = events.join(F.broadcast(months.select("month").distinct()))
    side = F.when(F.col("month") < F.col(at), "pre").otherwise("post")
    rows = rows.withColumn("side", side)
    far = F.abs(F.months_between("month", at))
    w = Window.partitionBy("event", "side").orderBy(far)
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def anchor_day(events: DataFrame, days: DataFrame, at: str = "event_date") -> DataFrame:
    """First weekday at or after the event with data."""
    rows = events.join(F.broadcast(days.select("date").distinct()), (F.col("date") >= F.col(at)) & (F.weekday("date") < 5), "left")
    return rows.groupBy(*events.columns).agg(F.min("date").alias("anchor"))


def pairs(rows: DataFrame, keys: list[str], entity: str) -> DataFrame:
    """Unordered pairs of the distinct entities of each group."""
    d = rows.select(*keys, entity).distinct()
    other = d.select(*keys, F.col(entity).alias(f"{entity}_b"))
    joined = d.join(other, keys) if keys else d.crossJoin(other)  # entities of one small group, such as parties
    return joined.where(F.col(entity) < F.col(f"{entity}_b"))


def window_mean(rows: DataFrame, windows: DataFrame, value: Column, date: str = "date") -> DataFrame:
    """Mean of a value before and after each event, by day windows."""
    joined = windows.join(rows, F.col(date).between(F.col("pre_start"), F.col("post_stop")), "left")
    pre, post = F.col(date).between(F.col("pre_start"), F.col("pre_stop")), F.col(date).between(F.col("post_start"), F.col("post_stop"))
    return joined.groupBy(*windows.columns).agg(F.avg(F.when(pre, value)).alias("pre_mean"), F.avg(F.when(post, value)).alias("post_mean"))


def term_rows(rows: DataFrame, start, stop, date: str = "date", lead: int = 0) -> DataFrame:
    """Rows of a term's window, from ``lead`` days before it on, with their month; rows without a date are dropped."""
    first, last = F.lit(start).cast("date"), F.lit(stop).cast("date")
    return rows.where(F.col(date).between(F.date_sub(first, lead), last)).withColumn("month", F.date_format(date, "yyyy-MM"))


def month_list(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per key the rows and the distinct months, in order and joined by commas."""
    months = rows.groupBy(*keys, "month").agg(F.count("*").alias("_n"))
    return months.groupBy(*keys).agg(F.sum("_n").alias("rows"), F.array_join(F.array_sort(F.collect_list("month")), ",").alias("months"))
