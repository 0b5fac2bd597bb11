"""Regressions from aggregated sums of products, and bootstrap comparison of models."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions import distributions as D

from . import resample
from .lineage import cut


def _flat(columns: list[str], of=lambda a, b: F.sum(F.col(a) * F.col(b))) -> Column:
    """All sums of products of two columns, row by row of the square."""
    return F.array(*[of(a, b) for a in columns for b in columns])


def _scaled(panel: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """``columns`` as population z-scores _z0.. (0 where constant), with means _m and deviations _d of each key."""
    moments = panel.groupBy(*keys).agg(F.array(*[F.avg(c) for c in columns]).alias("_m"), F.array(*[F.stddev_pop(c) for c in columns]).alias("_d"))
    rows = panel.join(moments, keys)
    z = {f"_z{i}": F.coalesce((F.col(c) - F.col("_m")[i]) / F.nullif(F.col("_d")[i], F.lit(0.0)), F.lit(0.0)) for i, c in enumerate(columns)}
    return rows.withColumns({**z, "_one": F.lit(1.0)})


def newey_west(panel: DataFrame, keys: list[str], order: str, y: str, xs: list[str], lag: int = 1, standardize: bool = False) -> DataFrame:
    """Least squares with Bartlett-weighted HAC errors: (keys, variable, beta, std_error, t_stat, p_value, ci_low, ci_high, n_obs, r_squared).

    A model is a key; models with fewer than columns + 6 complete rows give nothing. Everything that
    grows with the panel is an aggregation by key: the Gram matrix of the scaled columns, then the
    products of the scores with themselves and with their lags. Only those sums (one row a model) are
    solved in Python. ``standardize``: coefficients of z-scores.
    """
    columns = [*xs, y]
    rows = _scaled(panel.dropna(subset=columns), keys, columns)
    x, target = ["_one", *[f"_z{i}" for i in range(len(xs))]], f"_z{len(xs)}"
    k = len(x)
    gram = rows.groupBy(*keys).agg(_flat(x).alias("_g"), F.array(*[F.sum(F.col(c) * F.col(target)) for c in x]).alias("_xy"), F.count("*").alias("_n"))
    kinds = ", ".join(f"`{c}` {panel.schema[c].dataType.simpleString()}" for c in keys)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            beta = [np.linalg.pinv(np.reshape(g, (k, k))) @ np.array(v) for g, v in zip(b["_g"], b["_xy"])]
            yield b.assign(_beta=beta)[[*keys, "_beta", "_g", "_n"]]

    fits = gram.where(F.col("_n") >= len(columns) + 6).mapInPandas(solve, f"{kinds}, _beta array<double>, _g array<double>, _n bigint")
    fits = cut(fits)
    rest = rows.join(F.broadcast(fits), keys)  # one row a model
    error = F.col(target) - sum((F.col("_beta")[i] * F.col(c) for i, c in enumerate(x)), F.lit(0.0))
    rest = rest.withColumn("_e", error)
    rest = rest.withColumns({f"_s{i}": F.col("_e") * F.col(c) for i, c in enumerate(x)})
    w = Window.partitionBy(*keys).orderBy(order)
    rest = rest.withColumns({f"_s{i}_{step}": F.lag(f"_s{i}", step).over(w) for i in range(k) for step in range(1, lag + 1)})

    def meat(i: int, j: int) -> Column:
        total = F.sum(F.col(f"_s{i}") * F.col(f"_s{j}"))
        for step in range(1, lag + 1):
            both = F.col(f"_s{i}") * F.col(f"_s{j}_{step}") + F.col(f"_s{i}_{step}") * F.col(f"_s{j}")
            total = total + (1 - step / (lag + 1)) * F.coalesce(F.sum(both), F.lit(0.0))
        return total

    sums = rest.groupBy(*keys).agg(
        F.array(*[meat(i, j) for i in range(k) for j in range(k)]).alias("_w"), F.sum(F.col("_e") * F.col("_e")).alias("_sse"), F.sum(F.col(target) * F.col(target)).alias("_sst"),
        *[F.first(c).alias(c) for c in ("_beta", "_g", "_n", "_m", "_d")],
    )

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.to_dict("records"):
                inv = np.linalg.pinv(np.reshape(r["_g"], (k, k)))
                cov, beta = inv @ np.reshape(r["_w"], (k, k)) @ inv, np.array(r["_beta"])
                if not standardize:
                    m, d = np.array(r["_m"]), np.array(r["_d"])
                    scale = np.divide(d[-1], d[:-1], out=np.zeros(k - 1), where=d[:-1] > 0)
                    back = np.diag(np.append(d[-1], scale))
                    back[0, 1:] = -scale * m[:-1]
                    beta, cov = back @ beta, back @ cov @ back.T
                    beta[0] += m[-1]
                df = max(int(r["_n"]) - k, 1)
                se = np.sqrt(np.maximum(np.diag(cov), 0))
                t = np.divide(beta, se, out=np.full(k, np.nan), where=se > 0)
                reach = D.t_quantile(0.975, df) * se
                yield pd.DataFrame({**{c: r[c] for c in keys}, "variable": ["intercept", *xs], "beta": beta, "std_error": se, "t_stat": t, "p_value": [D.t_two_sided(v, df) if np.isfinite(v) else np.nan for v in t], "ci_low": beta - reach, "ci_high": beta + reach, "n_obs": int(r["_n"]), "r_squared": 1 - r["_sse"] / r["_sst"] if r["_sst"] > 0 else np.nan})

    return sums.mapInPandas(finish, f"{kinds}, variable string, beta double, std_error double, t_stat double, p_value double, ci_low double, ci_high double, n_obs bigint, r_squared double")


def supported(coefficients: DataFrame, specs: DataFrame, keys: list[str], level: float = 0.10) -> DataFrame:
    """Per model the primary coefficient and whether its p and sign support it. ``specs``: keys, primary, expected (+ or -)."""
    j = coefficients.join(F.broadcast(specs), [*keys]).where(F.col("variable") == F.col("primary"))
    sign = F.when(F.col("expected") == "+", F.col("beta") > 0).otherwise(F.col("beta") < 0)
    return j.select(*keys, "primary", "expected", "n_obs", "r_squared", "beta", "p_value", F.coalesce((F.col("p_value") <= level) & sign, F.lit(False)).alias("supported"))


def granger(panel: DataFrame, order: str, pairs: list[tuple[str, str]], lags: int = 3, both: bool = True) -> DataFrame:
    """(cause, effect, lag, n_obs, f_stat, p_value, neg_log10_p, sum_cause_beta) of each pair, both ways, and lag.

    Series with fewer than 12 common periods, and lags with at most 2 lag + 4 rows, give nothing. All
    models are rows of one plan; sums of products by (cause, effect, lag) are what is solved.
    """
    every = [*pairs, *((b, a) for a, b in pairs if both)]
    series = [panel.select(F.lit(c).alias("cause"), F.lit(e).alias("effect"), F.col(order).alias("_o"), F.col(c).cast("double").alias("x"), F.col(e).cast("double").alias("y")) for c, e in every]
    rows = reduce(DataFrame.unionByName, series).dropna(subset=["x", "y"])
    w = Window.partitionBy("cause", "effect")
    rows = rows.withColumns({"_n": F.count("*").over(w), "_mx": F.avg("x").over(w), "_my": F.avg("y").over(w), "_dx": F.stddev_pop("x").over(w), "_dy": F.stddev_pop("y").over(w)}).where("_n >= 12")
    one = lambda d: F.when(F.coalesce(F.col(d), F.lit(0.0)) == 0, 1.0).otherwise(F.col(d))
    rows = rows.withColumns({"x": (F.col("x") - F.col("_mx")) / one("_dx"), "y": (F.col("y") - F.col("_my")) / one("_dy"), "_ratio": one("_dy") / one("_dx")})
    back = w.orderBy("_o")
    rows = rows.withColumns({f"{v}{i}": F.lag(v, i).over(back) for v in "xy" for i in range(1, lags + 1)})
    parts = []
    for n in range(1, lags + 1):
        columns = ["_one", *[f"y{i}" for i in range(1, n + 1)], *[f"x{i}" for i in range(1, n + 1)], "y"]
        sums = rows.dropna(subset=[f"y{n}"]).withColumn("_one", F.lit(1.0)).groupBy("cause", "effect")
        parts.append(sums.agg(F.lit(n).alias("lag"), F.count("*").alias("n_obs"), _flat(columns).alias("_g"), F.first("_ratio").alias("_ratio")).where(F.col("n_obs") > 2 * n + 4))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.to_dict("records"):
                n = int(r["lag"])
                size = 2 * n + 2
                g = np.reshape(r["_g"], (size, size))

                def fit(k: int) -> tuple[np.ndarray, float]:
                    beta = np.linalg.pinv(g[:k, :k]) @ g[:k, -1]
                    return beta, max(g[-1, -1] - beta @ g[:k, -1], 0.0)

                (_, less), (beta, full) = fit(n + 1), fit(2 * n + 1)
                df = int(r["n_obs"]) - (2 * n + 1)
                f = max(less - full, 0.0) / n / (full / df) if df > 0 and full > 0 else np.nan
                p = D.f_upper(f, n, df) if np.isfinite(f) else np.nan
                out.append((r["cause"], r["effect"], n, int(r["n_obs"]), f, p, -np.log10(max(p, 1e-300)) if np.isfinite(p) else np.nan, beta[n + 1 :].sum() * r["_ratio"]))
            yield pd.DataFrame(out, columns=["cause", "effect", "lag", "n_obs", "f_stat", "p_value", "neg_log10_p", "sum_cause_beta"])

    return reduce(DataFrame.unionByName, parts).mapInPandas(solve, "cause string, effect string, lag int, n_obs bigint, f_stat double, p_value double, neg_log10_p double, sum_cause_beta double")


def bootstrap_f1(rows: DataFrame, item: str, truth: str, models: list[str], negative: str, draws: int = 2000) -> DataFrame:
    """(draw, model, macro_f1, negative_f1) over Poisson bootstrap resamples of the items.

    ``rows`` has a prediction column for each model; a cell of a confusion table is one row with the
    weighted counts of all draws, so the table is never copied.
    """
    long = rows.unpivot([item, truth], models, "model", "prediction").withColumnRenamed(truth, "truth").withColumn("n", F.lit(1))
    keys = ["model", "truth", "prediction"]
    cells = resample.by_draw(resample.drawn_sums(long, keys, ["n"], [F.col(item)], draws), keys, ["n"]).where("n > 0")
    return _f1(cells, ["draw", "model"], negative).select("draw", "model", "macro_f1", "negative_f1")


def _f1(cells: DataFrame, keys: list[str], negative: str) -> DataFrame:
    """Macro, negative and weighted F1 of confusion counts (keys, truth, prediction, n)."""
    hit = F.when(F.col("truth") == F.col("prediction"), F.col("n")).otherwise(0)
    sides = cells.select(*keys, F.col("truth").alias("label"), F.col("n").alias("s"), F.lit(0).alias("p"), hit.alias("h"))
    sides = sides.unionByName(cells.select(*keys, F.col("prediction").alias("label"), F.lit(0).alias("s"), F.col("n").alias("p"), F.lit(0).alias("h")))
    per = sides.groupBy(*keys, "label").agg(F.sum("s").alias("s"), F.sum("p").alias("p"), F.sum("h").alias("h"))
    per = per.withColumn("f1", F.coalesce(2 * F.col("h") / F.nullif(F.col("s") + F.col("p"), F.lit(0)), F.lit(0.0)))
    own = F.coalesce(F.max(F.when(F.col("label") == negative, F.col("f1"))), F.lit(0.0))
    return per.groupBy(*keys).agg(F.avg("f1").alias("macro_f1"), own.alias("negative_f1"), (F.sum(F.col("f1") * F.col("s")) / F.sum("s")).alias("weighted_f1"))


def f1_scores(rows: DataFrame, truth: str, negative: str) -> DataFrame:
    """(model, macro_f1, negative_f1, weighted_f1) of long predictions (model, prediction)."""
    return _f1(rows.groupBy("model", F.col(truth).alias("truth"), "prediction").agg(F.count("*").alias("n")), ["model"], negative)


def metric_differences(scores: DataFrame, metric: str, draw: str = "draw", model: str = "model") -> DataFrame:
    """For each pair of models the mean difference (b - a), its 95 % interval and the share of draws at or under 0."""
    a = scores.select(draw, F.col(model).alias("a"), F.col(metric).alias("_a"))
    b = scores.select(draw, F.col(model).alias("b"), F.col(metric).alias("_b"))
    d = a.join(b, draw).where("a < b").withColumn("d", F.col("_b") - F.col("_a"))
    q = lambda x: F.percentile("d", F.lit(x))
    return d.groupBy("a", "b").agg(F.avg("d").alias("difference"), q(0.025).alias("low"), q(0.975).alias("high"), F.avg((F.col("d") <= 0).cast("double")).alias("p_one_sided"))


def choose(metrics: DataFrame, base: str, macro: float = 0.08, negative: float = 0.10, least: float = 0.03) -> DataFrame:
    """One row: the best other model (macro F1, negative F1, weighted F1) and the rule that its gains over ``base`` meet."""
    order = F.struct("macro_f1", "negative_f1", "weighted_f1", "model")
    best = metrics.where(F.col("model") != base).agg(F.max(order).alias("t"))
    own = metrics.where(F.col("model") == base).select(F.col("macro_f1").alias("_m"), F.col("negative_f1").alias("_n"))
    j = own.crossJoin(best)  # single rows
    gain, less = F.col("t.macro_f1") - F.col("_m"), F.col("t.negative_f1") - F.col("_n")
    rule = F.when(F.col("t").isNull(), "no_competing_model_available").when((gain >= macro) & (less >= negative), "replace_primary").when(gain >= least, "keep_with_robustness_check").otherwise("keep_primary")
    return j.select(F.coalesce("t.model", F.lit(base)).alias("model"), rule.alias("rule"), gain.alias("macro_gain"), less.alias("negative_gain"))
