"""Economic series: monthly and daily panels, z-scores, composite indices."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def observations_to_month(daily: DataFrame, columns: list[str], date: str = "date") -> DataFrame:
    """Month mean and last observation of each column."""
    aggs = [x for c in columns for x in (F.avg(c).alias(f"{c}_avg"), F.max_by(c, F.when(F.col(c).isNotNull(), F.col(date))).alias(f"{c}_last"))]
    return daily.groupBy(F.trunc(date, "MM").alias("month")).agg(*aggs)


def zscore(value: str, population: bool = False) -> Column:
    """Over the whole panel; sample deviation (0 becomes 1, null becomes 0) or population deviation (0 gives null)."""
    w = Window.partitionBy(F.lit(0))  # a panel of periods
    if population:
        return (F.col(value) - F.avg(value).over(w)) / F.nullif(F.stddev_pop(value).over(w), F.lit(0.0))
    dev = F.stddev_samp(value).over(w)
    return F.coalesce((F.col(value) - F.avg(value).over(w)) / F.when(F.coalesce(dev, F.lit(0.0)) == 0, 1.0).otherwise(dev), F.lit(0.0))


def row_mean(columns: list[Column]) -> Column:
    """Mean of the values that are there."""
    there = [c.isNotNull().cast("int") for c in columns]
    total = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) for c in columns])
    return total / F.nullif(reduce(lambda a, b: a + b, there), F.lit(0))


def composite(panel: DataFrame, signed: dict[str, int], out: str) -> DataFrame:
    """Row mean of signed population z-scores."""
    rows = panel.withColumns({f"_z_{c}": s * zscore(c, True) for c, s in signed.items()})
    return rows.withColumn(out, row_mean([F.col(f"_z_{c}") for c in signed])).drop(*[f"_z_{c}" for c in signed])


def crisis(panel: DataFrame, index: str, quantile: float = 0.75) -> DataFrame:
    """1.0 in months at or above the quantile of the index, null counts as 0."""
    cut = panel.agg(F.percentile(index, F.lit(quantile)).alias("_cut"))
    flag = F.coalesce((F.col(index) >= F.col("_cut")).cast("double"), F.lit(0.0))
    return panel.crossJoin(F.broadcast(cut)).withColumn("crisis", flag).drop("_cut")


def series_catalog(panel: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Per column: non-null observations, first and last key; columns without any are left out."""
    long = panel.select(F.col(key).cast("string").alias("_k"), *[F.col(c).cast("double") for c in columns]).unpivot("_k", columns, "series", "v").where("v is not null")
    return long.groupBy("series").agg(F.count("*").alias("observations"), F.min("_k").alias("first_key"), F.max("_k").alias("last_key"))


def mid(a: Column, b: Column) -> Column:
    """Mean of two quotes, or the one that is there."""
    return F.coalesce((a + b) / 2, a, b)


def policy_rates(older: DataFrame, recent: DataFrame) -> DataFrame:
    """(date, rate) from ``older`` (raw: a month and a value in one string) and ``recent`` (month, value with a decimal comma).

    Rows without a month are dropped; of one date the recent source wins, else the last in order.
    """
    form = r"(\d{4}-\d{2})\s+([-+]?\d+(?:\.\d+)?)"
    day = lambda m: F.try_to_date(F.concat(m, F.lit("-01")), "yyyy-MM-dd")
    a = older.select(day(F.regexp_extract("raw", form, 1)).alias("date"), F.regexp_extract("raw", form, 2).try_cast("double").alias("rate"), F.lit(0).alias("source"))
    b = recent.where(F.col("month").rlike(r"^\d{4}-\d{2}$"))
    b = b.select(day(F.col("month")).alias("date"), F.replace("value", F.lit(","), F.lit(".")).try_cast("double").alias("rate"), F.lit(1).alias("source"))
    every = a.unionByName(b).where("date is not null")
    return every.groupBy("date").agg(F.max(F.struct("source", "rate")).alias("t")).select("date", "t.rate")


def assemble_index(long: DataFrame, spine: DataFrame, picks: dict[str, tuple[str, str]], fallback: dict[str, str], yearly: tuple[str, str]) -> DataFrame:
    """Series of a long matrix (date, series_label, metric_label, value) side by side on a month spine.

    ``picks``: column -> (text of its series label, text of its metric label, or empty); ``fallback``:
    column -> the column that fills its gaps (and is dropped); ``yearly``: (column, index) whose change
    over twelve months in percent fills the column's gaps.
    """
    at = lambda s, m: F.max(F.when(F.contains("series_label", F.lit(s)) & F.contains("metric_label", F.lit(m)), F.col("value")))
    wide = long.groupBy("date").agg(*[at(s, m).alias(c) for c, (s, m) in picks.items()])
    rows = spine.join(wide, "date", "left")
    for c, other in fallback.items():
        rows = rows.withColumn(c, F.coalesce(c, other)).drop(other)
    column, index = yearly
    before = F.lag(index, 12).over(Window.partitionBy(F.lit(0)).orderBy("date"))  # a spine of months
    return rows.withColumn(column, F.coalesce(column, (F.col(index) / F.nullif(before, F.lit(0.0)) - 1) * 100))


def labor_annual(rows: DataFrame, employment: DataFrame, categories: dict[str, str]) -> DataFrame:
    """Per year the labor force, unemployed and rate of each category side by side, and the employment rate.

    ``rows``: year, category, force and unemployed (text with thousands dots), rate.
    """
    number = lambda c: F.replace(c, F.lit("."), F.lit("")).try_cast("double")
    clean = rows.select(F.col("year").try_cast("int").alias("year"), "category", number("force").alias("force"), number("unemployed").alias("unemployed"), F.col("rate").try_cast("double").alias("rate")).where("year is not null")
    at = lambda c, v: F.max(F.when(F.col("category") == c, F.col(v)))
    wide = clean.groupBy("year").agg(*[at(c, v).alias(f"{v}_{slug}") for c, slug in categories.items() for v in ("force", "unemployed", "rate")])
    return wide.join(employment, "year", "left")


def market_months(daily: DataFrame, columns: list[str], date: str = "date") -> DataFrame:
    """Per month the days, and of each series the mean, the last value and the return from first to last in percent (null under two values)."""
    on = lambda c: F.when(F.col(c).isNotNull(), F.col(date))
    aggs = [F.count("*").alias("days")]
    for c in columns:
        first, last = F.min_by(c, on(c)), F.max_by(c, on(c))
        aggs += [F.avg(c).alias(f"{c}_avg"), last.alias(f"{c}_last"), F.when(F.count(c) >= 2, 100 * (last / F.nullif(first, F.lit(0.0)) - 1)).alias(f"{c}_return")]
    return daily.groupBy(F.trunc(date, "MM").alias("month")).agg(*aggs)


def indices(panel: DataFrame) -> DataFrame:
    """``panel`` (a row per month) with volatility, stress and improvement.

    Volatility is the row mean of three signed z-scores, stress that of five, improvement its negative.
    ``panel`` holds usd_return, index_return, inflation_mom, inflation_yoy, rate and reserves_mom.
    """
    out = composite(panel, {"usd_return": 1, "index_return": -1, "inflation_mom": 1}, "volatility")
    out = composite(out, {"inflation_yoy": 1, "usd_return": 1, "index_return": -1, "rate": 1, "reserves_mom": -1}, "stress")
    return out.withColumn("improvement", -F.col("stress"))
