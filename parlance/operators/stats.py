"""Tests and classifier metrics from grouped moments."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions import distributions as D

from .lineage import cut


def ols(rows: DataFrame, keys: list[str], y: str, x: str) -> DataFrame:
    """Simple regression with intercept: slope, intercept, R2 and adjusted R2."""
    out = rows.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.regr_count(y, x).alias("n"))
    return out.withColumn("adjusted_r2", 1 - (1 - F.col("r2")) * (F.col("n") - 1) / F.nullif(F.col("n") - 2, F.lit(0)))


def average_ranks(rows: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    w = Window.partitionBy(*(keys or [F.lit(0)]))
    ties = F.count("*").over(Window.partitionBy(*(keys or [F.lit(0)]), value))
    return rows.withColumn(out, F.rank().over(w.orderBy(value)) + (ties - 1) / 2)


def correlations(rows: DataFrame, date: str, columns: list[str], least: int = 8) -> DataFrame:
    """Pearson and Spearman of all pairs of columns over their common dates, pairs with at least ``least``."""
    long = rows.select(date, *columns).unpivot(date, columns, "name", "v").where("v is not null")
    a = long.select(date, F.col("name").alias("a"), F.col("v").alias("x"))
    b = long.select(date, F.col("name").alias("b"), F.col("v").alias("y"))
    both = a.join(b, date).where("a < b")
    both = average_ranks(average_ranks(both, ["a", "b"], "x", "rx"), ["a", "b"], "y", "ry")
    return both.groupBy("a", "b").agg(F.count("*").alias("n"), F.corr("x", "y").alias("pearson"), F.corr("rx", "ry").alias("spearman")).where(F.col("n") >= least)


def lead_correlations(panel: DataFrame, order: str, pairs: list[tuple[str, str]], leads: tuple[int, ...] = (1, 2, 3), least: int = 8) -> DataFrame:
    """(predictor, outcome, lead, n, pearson, spearman) of each predictor with the outcome some rows later.

    ``panel`` is a table of periods; pairs of complete rows fewer than ``least`` are left out.
    """
    w = Window.partitionBy(F.lit(0)).orderBy(order)  # a panel of periods
    cells = [F.struct(F.lit(a).alias("predictor"), F.lit(b).alias("outcome"), F.lit(k).alias("lead"), F.col(a).cast("double").alias("x"), F.lead(b, k).over(w).cast("double").alias("y")) for a, b in pairs for k in leads]
    long = panel.select(F.array(*cells).alias("_c")).select(F.inline("_c")).where("x is not null and y is not null")
    keys = ["predictor", "outcome", "lead"]
    ranked = average_ranks(average_ranks(long, keys, "x", "rx"), keys, "y", "ry")
    return ranked.groupBy(*keys).agg(F.count("*").alias("n"), F.corr("x", "y").alias("pearson"), F.corr("rx", "ry").alias("spearman")).where(F.col("n") >= least)


def threshold_tests(panel: DataFrame, driver: str, outcome: str, quantiles: tuple[float, ...] = (0.70, 0.75, 0.80)) -> DataFrame:
    """Per quantile of ``driver``: the cutoff, and size and mean of ``outcome`` in periods at or over it and in all others, with Welch's t.

    Periods without a driver are among the others; the test is null where a side has fewer than two values.
    """
    at = panel.agg(F.percentile(driver, F.array(*map(F.lit, quantiles))).alias("_c")).select(F.explode(F.arrays_zip(F.array(*map(F.lit, quantiles)).alias("quantile"), F.col("_c").alias("cutoff"))).alias("_z")).select("_z.*")
    high = F.coalesce(F.col(driver) >= F.col("cutoff"), F.lit(False))
    rows = panel.select(driver, outcome).join(F.broadcast(at))  # a few rows
    part = lambda f, g: f(F.when(g, F.col(outcome)))
    s = rows.groupBy("quantile", "cutoff").agg(
        part(F.count, high).alias("crisis_months"), part(F.count, ~high).alias("other_months"), part(F.avg, high).alias("crisis_mean"), part(F.avg, ~high).alias("other_mean"), part(F.var_samp, high).alias("_v1"), part(F.var_samp, ~high).alias("_v2")
    )
    a, b = F.col("_v1") / F.col("crisis_months"), F.col("_v2") / F.col("other_months")
    t = (F.col("crisis_mean") - F.col("other_mean")) / F.nullif(F.sqrt(a + b), F.lit(0.0))
    df = (a + b) * (a + b) / F.nullif(a * a / (F.col("crisis_months") - 1) + b * b / (F.col("other_months") - 1), F.lit(0.0))
    enough = (F.col("crisis_months") >= 2) & (F.col("other_months") >= 2)
    return s.withColumns({"welch_t": F.when(enough, t), "welch_df": F.when(enough, df)}).drop("_v1", "_v2")


def fitted_pairs(panel: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(x_name, y_name, n, slope, intercept, spearman) of each pair of columns over the rows that hold both."""
    cells = [F.struct(F.lit(a).alias("x_name"), F.lit(b).alias("y_name"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y")) for a, b in pairs]
    long = panel.select(F.inline(F.array(*cells))).where("x is not null and y is not null")
    keys = ["x_name", "y_name"]
    ranked = average_ranks(average_ranks(long, keys, "x", "rx"), keys, "y", "ry")
    return ranked.groupBy(*keys).agg(F.count("*").alias("n"), F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.corr("rx", "ry").alias("spearman"))


def correlation_p(rows: DataFrame) -> DataFrame:
    """``rows`` of ``correlations`` with the two-sided p of both coefficients."""
    p = lambda r: D.t_p(F.col(r) * F.sqrt((F.col("n") - 2) / F.nullif(1 - F.col(r) * F.col(r), F.lit(0.0))), (F.col("n") - 2).cast("double"))
    return rows.withColumns({f"{r}_p": p(r) for r in ("pearson", "spearman")})


def signs(t: np.ndarray, v: np.ndarray) -> int:
    """Sum of sign(v_j - v_i) over all pairs with t_i < t_j, in n log n."""

    def count(x: np.ndarray) -> tuple[int, np.ndarray]:
        """The sum over pairs in order, and the sorted values."""
        if len(x) <= 64:
            d = np.sign(x[None, :] - x[:, None])
            return int(np.triu(d, 1).sum()), np.sort(x)
        half = len(x) // 2
        one, left = count(x[:half])
        two, right = count(x[half:])
        across = np.searchsorted(left, right, "left").sum() - (len(left) * len(right) - np.searchsorted(left, right, "right").sum())
        return one + two + int(across), np.sort(np.concatenate([left, right]), kind="stable")

    order = np.lexsort((v, t))
    t, v = t[order], v[order]
    total = count(v)[0]
    borders = np.flatnonzero(t[1:] != t[:-1]) + 1
    for x in np.split(v, borders):  # values of one time are sorted: all their pairs but ties were counted as rising
        ties = np.unique(x, return_counts=True)[1]
        total -= len(x) * (len(x) - 1) // 2 - int((ties * (ties - 1) // 2).sum())
    return total


def mann_kendall(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """S, its variance without ties, and z with continuity correction; series of at least four.

    Series are cut by ranges of time and by ranges of value. Pairs inside a time range, and pairs inside a
    value range from different times, are counted in its task in n log n; all other pairs follow from
    running sums over the table of cell counts, so no series is joined with itself or held by one task.
    """
    at = F.col(order).cast("timestamp") if dict(rows.dtypes)[order] in ("date", "timestamp") else F.col(order)
    d = rows.where(F.col(value).isNotNull()).select(*keys, at.cast("double").alias("t"), F.col(value).cast("double").alias("v"))
    parts = int(d.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = cut(d.repartitionByRange(parts, *keys, "t").withColumn("_c", F.spark_partition_id()))
    d = cut(d.repartitionByRange(parts, *keys, "v").withColumn("_b", F.spark_partition_id()))
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)

    def inside(time: str):
        def of(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({**{k: [x] for k, x in zip(keys, key)}, "s": [signs(g[time].to_numpy(), g["v"].to_numpy())]})

        return of

    own = d.groupBy(*keys, "_c").applyInPandas(inside("t"), f"{kinds}, s bigint")
    same = d.groupBy(*keys, "_b").applyInPandas(inside("_c"), f"{kinds}, s bigint")
    cells = cut(d.groupBy(*keys, "_c", "_b").agg(F.count("*").alias("n")))
    grid = cells.select(*keys, "_c").distinct().join(cells.select(*keys, "_b").distinct(), keys).join(cells, [*keys, "_c", "_b"], "left")
    grid = grid.withColumn("_e", F.coalesce(F.sum("n").over(Window.partitionBy(*keys, "_b").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    line = Window.partitionBy(*keys, "_c")
    low = F.coalesce(F.sum("_e").over(line.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    grid = grid.withColumns({"_low": low, "_all": F.sum("_e").over(line)})
    across = grid.select(*keys, (F.coalesce("n", F.lit(0)) * (2 * F.col("_low") + F.col("_e") - F.col("_all"))).alias("s"))
    s = own.unionByName(same).unionByName(across).groupBy(*keys).agg(F.sum("s").cast("double").alias("s"))
    n = cells.groupBy(*keys).agg(F.sum("n").alias("n"))
    out = s.join(n, keys).where("n >= 4").withColumn("variance", F.col("n") * (F.col("n") - 1) * (2 * F.col("n") + 5) / 18)
    z = F.when(F.col("s") > 0, (F.col("s") - 1) / F.sqrt("variance")).when(F.col("s") < 0, (F.col("s") + 1) / F.sqrt("variance")).otherwise(0.0)
    return out.withColumn("z", z)


def two_sample(rows: DataFrame, keys: list[str], group: str, one: str, other: str, value: str) -> DataFrame:
    """Sizes, means, Student and Welch t, Hedges g (sizes of at least two)."""
    part = lambda f, g: f(F.when(F.col(group) == g, F.col(value)))
    s = rows.groupBy(*keys).agg(
        part(F.count, one).alias("n1"), part(F.count, other).alias("n2"), part(F.avg, one).alias("m1"), part(F.avg, other).alias("m2"), part(F.var_samp, one).alias("v1"), part(F.var_samp, other).alias("v2")
    )
    n1, n2, v1, v2, d = F.col("n1"), F.col("n2"), F.col("v1"), F.col("v2"), F.col("m2") - F.col("m1")
    pooled = ((n1 - 1) * v1 + (n2 - 1) * v2) / F.nullif(n1 + n2 - 2, F.lit(0))
    student = d / F.nullif(F.sqrt(pooled * (1 / n1 + 1 / n2)), F.lit(0.0))
    welch = d / F.nullif(F.sqrt(v1 / n1 + v2 / n2), F.lit(0.0))
    g = d / F.nullif(F.sqrt(pooled), F.lit(0.0)) * (1 - 3 / (4 * (n1 + n2) - 9))
    return s.where("n1 >= 2 and n2 >= 2").select(*keys, "n1", "n2", "m1", "m2", d.alias("difference"), student.alias("student_t"), welch.alias("welch_t"), g.alias("hedges_g"))


def rank_sum(rows: DataFrame, keys: list[str], group: str, one: str, value: str) -> DataFrame:
    """Mann-Whitney U of group ``one`` against the others, by average ranks."""
    r = average_ranks(rows.where(F.col(value).isNotNull()), keys, value, "_rank")
    mine = F.col(group) == one
    s = r.groupBy(*keys).agg(F.sum(F.when(mine, F.col("_rank"))).alias("ranks"), F.count_if(mine).alias("n1"), F.count_if(~mine).alias("n2"))
    return s.select(*keys, "n1", "n2", (F.col("ranks") - F.col("n1") * (F.col("n1") + 1) / 2).alias("u"))


def mean_tests(rows: DataFrame, keys: list[str], group: str, one: str, other: str, value: str) -> DataFrame:
    """Per key: sizes, means, difference, Welch t with its p, Hedges g, Mann-Whitney U of ``one`` with its p."""
    some = rows.where(F.col(value).isNotNull())
    t = two_sample(some, keys, group, one, other, value).drop("student_t")
    v = some.groupBy(*keys).agg(*[F.var_samp(F.when(F.col(group) == g, F.col(value))).alias(n) for g, n in ((one, "_v1"), (other, "_v2"))])
    same = some.groupBy(*keys, value).agg(F.count("*").alias("_t")).groupBy(*keys).agg(F.sum(F.col("_t") * F.col("_t") * F.col("_t") - F.col("_t")).cast("double").alias("_ties"))
    j = t.join(v, keys).join(same, keys).join(rank_sum(some, keys, group, one, value).select(*keys, "u"), keys)
    a, b = F.col("_v1") / F.col("n1"), F.col("_v2") / F.col("n2")
    df = (a + b) * (a + b) / F.nullif(a * a / (F.col("n1") - 1) + b * b / (F.col("n2") - 1), F.lit(0.0))
    double = lambda c: F.col(c).cast("double")
    return j.select(*t.columns, "u", D.t_p("welch_t", df).alias("welch_p"), D.rank_sum_p(double("u"), double("n1"), double("n2"), double("_ties")).alias("u_p"))


def confusion(rows: DataFrame, truth: str, prediction: str) -> DataFrame:
    c = rows.groupBy(F.col(truth).alias("truth"), F.col(prediction).alias("prediction")).agg(F.count("*").alias("n"))
    return c.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("truth")))


def class_metrics(counts: DataFrame) -> DataFrame:
    """Precision, recall and F1 of each class from confusion counts; 0 where a denominator is 0."""
    t = counts.groupBy(F.col("truth").alias("label")).agg(F.sum("n").alias("support"))
    p = counts.groupBy(F.col("prediction").alias("label")).agg(F.sum("n").alias("predicted"))
    hit = counts.where("truth = prediction").select(F.col("truth").alias("label"), F.col("n").alias("hit"))
    rows = t.join(p, "label", "full").join(hit, "label", "left").na.fill(0, ["support", "predicted", "hit"])
    over = lambda b: F.coalesce(F.col("hit") / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))
    rows = rows.select("label", "support", "predicted", "hit", over("predicted").alias("precision"), over("support").alias("recall"))
    both = F.col("precision") + F.col("recall")
    return rows.withColumn("f1", F.coalesce(2 * F.col("precision") * F.col("recall") / F.nullif(both, F.lit(0.0)), F.lit(0.0)))


def overall_metrics(counts: DataFrame) -> DataFrame:
    """Accuracy, macro and weighted F1, Cohen's kappa."""
    c = class_metrics(counts).where("support > 0 or predicted > 0")
    s = c.agg(F.sum("hit").alias("h"), F.sum("support").alias("n"), F.avg("f1").alias("macro_f1"), (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"), F.sum(F.col("support") * F.col("predicted")).alias("e"))
    chance = F.col("e") / (F.col("n") * F.col("n"))
    return s.select((F.col("h") / F.col("n")).alias("accuracy"), "macro_f1", "weighted_f1", ((F.col("h") / F.col("n") - chance) / F.nullif(1 - chance, F.lit(0.0))).alias("kappa"))


def fleiss_kappa(rows: DataFrame, item: str, raters: list[str]) -> DataFrame:
    """Fleiss' kappa and the rate of full agreement over items that all raters have labelled."""
    k = len(raters)
    long = rows.dropna(subset=raters).select(item, *raters).unpivot(item, raters, "rater", "label")
    c = long.groupBy(item, "label").agg(F.count("*").alias("n"))
    per = c.groupBy(item).agg(((F.sum(F.col("n") * F.col("n")) - k) / (k * (k - 1))).alias("p"), (F.max("n") == k).alias("full"))
    total = per.agg(F.avg("p").alias("p"), F.avg(F.col("full").cast("double")).alias("full_agreement"), F.count("*").alias("items"))
    chance = c.groupBy("label").agg(F.sum("n").alias("n")).crossJoin(F.broadcast(total)).agg(F.sum(F.pow(F.col("n") / (F.col("items") * k), F.lit(2))).alias("e"))
    return total.crossJoin(F.broadcast(chance)).select(((F.col("p") - F.col("e")) / F.nullif(1 - F.col("e"), F.lit(0.0))).alias("kappa"), "full_agreement", "items")


def majority(rows: DataFrame, item: str, raters: list[str]) -> DataFrame:
    """Most frequent label of the raters, ties to the first in the alphabet."""
    c = rows.select(item, *raters).unpivot(item, raters, "rater", "label").where("label is not null").groupBy(item, "label").agg(F.count("*").alias("votes"))
    return c.groupBy(item).agg(F.min(F.struct((-F.col("votes")).alias("v"), "label"))["label"].alias("label"))
