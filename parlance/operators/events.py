"""Event studies: metrics by stage, displacement, placebo months, rate ratios."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .joins import stage_windows


def stage_means(panel: DataFrame, events: DataFrame, values: list[str], pre: int = 3, post: int = 3) -> DataFrame:
    """Mean of each value over the months of each stage that are there, wide, with deltas to pre."""
    w = stage_windows(events, pre, post)
    rows = w.join(panel, "month", "left")
    at = lambda v, s: F.avg(F.when(F.col("stage") == s, F.col(v)))
    out = rows.groupBy(*events.columns).agg(*[at(v, s).alias(f"{v}_{s}") for v in values for s in ("pre", "shock", "post")])
    return out.select("*", *[(F.col(f"{v}_{s}") - F.col(f"{v}_pre")).alias(f"{v}_delta_{s}") for v in values for s in ("shock", "post")])


def displacement(rows: DataFrame, gains: list[str], loss: str, stages: tuple[str, ...] = ("shock", "post")) -> DataFrame:
    """Gains of competing topics less the change of the topic itself; it persists when both stages are above 0."""
    index = {s: sum((F.greatest(F.lit(0.0), F.col(f"{g}_delta_{s}")) for g in gains), F.lit(0.0)) - F.col(f"{loss}_delta_{s}") for s in stages}
    out = rows.select("*", *[x.alias(f"displacement_{s}") for s, x in index.items()])
    both = F.col(f"displacement_{stages[0]}") > 0
    for s in stages[1:]:
        both = both & (F.col(f"displacement_{s}") > 0)
    return out.withColumn("persists", F.coalesce(both, F.lit(False)))


def placebo(panel: DataFrame, events: DataFrame, eligible: DataFrame, value: str) -> DataFrame:
    """The observed change at each event against the changes at all other eligible months.

    Placebo months are events like any other, so the observed and null changes come from one plan. A
    null change that is missing counts in the denominator of p.
    """
    months = events.select(F.col("event_month")).union(eligible.select(F.col("month").alias("event_month"))).distinct()
    changes = stage_means(panel, months, [value]).select("event_month", F.col(f"{value}_delta_shock").alias("change"))
    observed = events.join(F.broadcast(changes), "event_month", "left").withColumnRenamed("change", "observed")
    null = changes.join(eligible.select(F.col("month").alias("event_month")), "event_month", "left_semi").select(F.col("event_month").alias("_m"), "change")
    rows = observed.join(F.broadcast(null), F.col("_m") != F.col("event_month"))
    far = F.avg(F.coalesce(F.abs("change") >= F.abs("observed"), F.lit(False)).cast("double"))
    out = rows.groupBy("event", "event_month", "observed").agg(F.count("*").alias("null_draws"), F.avg("change").alias("null_mean"), F.stddev_pop("change").alias("null_std"), far.alias("null_p"))
    return out.withColumn("z", (F.col("observed") - F.col("null_mean")) / F.nullif(F.col("null_std"), F.lit(0.0)))


def rate_ratio(rows: DataFrame, keys: list[str], count: str, exposure: str, stage: str = "stage") -> DataFrame:
    """Rates before and after, their ratio, log ratio, standard error and z; not ok when a count or exposure isn't positive."""
    part = lambda c, s: F.sum(F.when(F.col(stage) == s, F.col(c)).otherwise(0)).cast("double")
    s = rows.groupBy(*keys).agg(part(count, "pre").alias("c1"), part(exposure, "pre").alias("e1"), part(count, "post").alias("c2"), part(exposure, "post").alias("e2"))
    ok = (F.col("c1") > 0) & (F.col("c2") > 0) & (F.col("e1") > 0) & (F.col("e2") > 0)
    ratio = F.when(ok, (F.col("c2") / F.col("e2")) / (F.col("c1") / F.col("e1")))
    s = s.select("*", ok.alias("ok"), ratio.alias("ratio"))
    se = F.when(F.col("ok"), F.sqrt(1 / F.col("c1") + 1 / F.col("c2")))
    return s.select("*", F.log("ratio").alias("log_ratio"), se.alias("se"), (F.log("ratio") / se).alias("z"))


def registry(events: DataFrame, windows: DataFrame, eligible: DataFrame) -> DataFrame:
    """Per event its effective month, the months of each stage as one string, and the size of the eligible pool without it."""
    text = lambda s: F.array_join(F.array_sort(F.collect_list(F.when(F.col("stage") == s, F.date_format("month", "yyyy-MM")))), ",")
    months = windows.groupBy("event").agg(*[text(s).alias(f"{s}_months") for s in ("pre", "shock", "post")])
    pool = events.join(eligible.withColumnRenamed("month", "_m"), F.col("_m") != F.col("event_month"), "left").groupBy("event").agg(F.count("_m").alias("eligible_pool"))
    return events.join(months, "event").join(pool, "event")


def null_zscores(rows: DataFrame, observed: str = "observed", mean: str = "null_mean", std: str = "null_std") -> DataFrame:
    """``rows`` with z, null without a spread of the null."""
    return rows.withColumn("z", (F.col(observed) - F.col(mean)) / F.nullif(F.col(std), F.lit(0.0)))


def null_summary(rows: DataFrame, keys: list[str], p: str = "null_p", at: float = 0.10) -> DataFrame:
    """Mean and least p, share of p at or under ``at``, mean and largest absolute z."""
    return rows.groupBy(*keys).agg(
        F.count("*").alias("events"), F.avg(p).alias("mean_p"), F.min(p).alias("min_p"), F.avg((F.col(p) <= at).cast("double")).alias("share_low_p"), F.avg(F.abs("z")).alias("mean_abs_z"), F.max(F.abs("z")).alias("max_abs_z")
    )


def stage_rows(windows: DataFrame, rows: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """Sums of the rows of each stage of each event, all events in one plan keyed by (event, stage)."""
    return windows.select("event", "stage", "month").join(rows, "month").groupBy("event", "stage", *keys).agg(*[F.sum(c).alias(c) for c in sums])


def stage_wide(rows: DataFrame, values: list[str], deltas: list[str], keys: tuple[str, ...] = ("event",)) -> DataFrame:
    """Values by stage side by side, with deltas of shock and post to pre for some of them."""
    at = lambda v, s: F.max(F.when(F.col("stage") == s, F.col(v)))
    out = rows.groupBy(*keys).agg(*[at(v, s).alias(f"{v}_{s}") for v in values for s in ("pre", "shock", "post")])
    return out.select("*", *[(F.col(f"{v}_{s}") - F.col(f"{v}_pre")).alias(f"{v}_delta_{s}") for v in deltas for s in ("shock", "post")])


def trading_days(days: DataFrame, anchors: DataFrame, close: str, span: int = 15) -> DataFrame:
    """(event, date, relative, cumulative return in percent) over the trading days around each event's anchor day.

    Days are rows with a close, numbered once; an event then takes the numbers around its anchor's.
    """
    w = Window.partitionBy(F.lit(0)).orderBy("date")  # a panel of days
    rows = days.where(F.col(close).isNotNull()).select("date", F.col(close).alias("_c")).withColumn("_n", F.row_number().over(w))
    at = anchors.select("event", F.col("anchor").alias("date")).join(rows, "date").select("event", F.col("_n").alias("_a"), F.col("_c").alias("_ac"))
    out = rows.join(F.broadcast(at), F.col("_n").between(F.col("_a") - span, F.col("_a") + span))
    return out.select("event", "date", (F.col("_n") - F.col("_a")).alias("relative"), ((F.col("_c") / F.nullif(F.col("_ac"), F.lit(0.0)) - 1) * 100).alias("cumulative_return"))


def sides(windows: DataFrame) -> DataFrame:
    """(event, side, month) of stage windows: months before an event are pre, its own and those after it post."""
    return windows.select("event", F.when(F.col("stage") == "pre", "pre").otherwise("post").alias("side"), "month")


def prepost(windows: DataFrame, rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Per event and keys: the means of monthly values before and from the event on, and their difference.

    ``windows``: (event, side, month), a few months of a few events. A side without values is null.
    """
    j = rows.join(F.broadcast(windows), "month")
    at = lambda v, s: F.avg(F.when(F.col("side") == s, F.col(v))).alias(f"{v}_{s}")
    out = j.groupBy("event", *keys).agg(*[at(v, s) for v in values for s in ("pre", "post")])
    return out.withColumns({f"{v}_delta": F.col(f"{v}_post") - F.col(f"{v}_pre") for v in values})


def top_share(windows: DataFrame, rows: DataFrame, keys: list[str], entity: str, value: str) -> DataFrame:
    """Per event and keys: the entity of the highest mean monthly value before and from the event on, ties to the last name."""
    m = rows.join(F.broadcast(windows), "month").groupBy("event", "side", *keys, entity).agg(F.round(F.avg(value), 9).alias("_v"))
    at = lambda s: F.max(F.when((F.col("side") == s) & F.col("_v").isNotNull(), F.struct("_v", entity)))[entity].alias(f"top_{entity}_{s}")
    return m.groupBy("event", *keys).agg(at("pre"), at("post"))


def monthly_spread(positions: DataFrame, one: str, other: str) -> DataFrame:
    """Per month: the spread of positions, and the distance of two parties (null where one is missing)."""
    of = lambda p: F.max(F.when(F.col("party") == p, F.col("position")))
    return positions.groupBy("month").agg((F.max("position") - F.min("position")).alias("spread"), F.abs(of(one) - of(other)).alias("gap"))
