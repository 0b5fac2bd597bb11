import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.functions import distributions as D
from parlance.functions import text as T
from parlance.operators import axis, graphs, models, resample, stats


def test_tails_have_known_values():
    assert abs(D.t_two_sided(2.228138852, 10) - 0.05) < 1e-9 and abs(D.t_quantile(0.975, 10) - 2.228138852) < 1e-7
    assert abs(D.f_upper(4.102821015, 2, 10) - 0.05) < 1e-8 and abs(D.normal_two_sided(1.959963985) - 0.05) < 1e-9
    assert abs(D.t_two_sided(1.0, 1) - 0.5) < 1e-12 and D.f_upper(0.0, 3, 5) == 1.0
    # four and four values with U = 3
    assert abs(D.rank_sum_exact(3, 4, 4) - 0.2) < 1e-12 and D.rank_sum_ways(3, 2).sum() == math.comb(5, 2)


def brute_hac(y, x, lag=1):
    x = np.column_stack([np.ones(len(x)), x])
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    u = x * (y - x @ beta)[:, None]
    s = u.T @ u
    for k in range(1, lag + 1):
        c = u[k:].T @ u[:-k]
        s += (1 - k / (lag + 1)) * (c + c.T)
    inv = np.linalg.inv(x.T @ x)
    return beta, np.sqrt(np.diag(inv @ s @ inv))


def test_newey_west_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    a, b = rng.normal(1e6, 1e4, 60), rng.normal(size=60)
    y = 3 * a - 5e4 * b + np.cumsum(rng.normal(0, 1e4, 60))
    rows = [("m", i, float(y[i]), float(a[i]), float(b[i])) for i in range(60)] + [("short", i, 1.0 * i, 2.0, 3.0) for i in range(8)] + [("m", 99, None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "k string, t int, y double, a double, b double")
    for lag in (1, 3):
        got = {r.variable: r for r in models.newey_west(df, ["k"], "t", "y", ["a", "b"], lag).collect()}
        beta, se = brute_hac(y, np.column_stack([a, b]), lag)
        for i, v in enumerate(["intercept", "a", "b"]):
            assert got[v].beta == pytest.approx(beta[i], rel=1e-6) and got[v].std_error == pytest.approx(se[i], rel=1e-6) and got[v].n_obs == 60
            assert got[v].p_value == pytest.approx(D.t_two_sided(beta[i] / se[i], 57), rel=1e-5, abs=1e-12)


def test_granger_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=50)
    y = np.append(0, 0.8 * x[:-1]) + rng.normal(0, 0.3, 50)
    df = spark.createDataFrame([(i, float(x[i]), float(y[i])) for i in range(50)], "t int, x double, y double")
    got = {(r.cause, r.lag): r for r in models.granger(df, "t", [("x", "y")], 2).collect()}
    for n in (1, 2):
        own = np.column_stack([np.ones(50 - n), *[y[n - k : 50 - k] for k in range(1, n + 1)]])
        full = np.column_stack([own, *[x[n - k : 50 - k] for k in range(1, n + 1)]])
        sse = lambda m: float(np.sum((y[n:] - m @ np.linalg.lstsq(m, y[n:], rcond=None)[0]) ** 2))
        f = (sse(own) - sse(full)) / n / (sse(full) / (50 - n - 2 * n - 1))
        r = got["x", n]
        assert r.f_stat == pytest.approx(f, rel=1e-6) and r.p_value == pytest.approx(D.f_upper(f, n, 50 - 3 * n - 1), abs=1e-12) and r.n_obs == 50 - n
        assert r.sum_cause_beta == pytest.approx(np.linalg.lstsq(full, y[n:], rcond=None)[0][n + 1 :].sum(), rel=1e-6)
    assert got["x", 1].p_value < 1e-6 < got["y", 1].p_value
    assert models.granger(df.limit(11), "t", [("x", "y")]).count() == 0


def test_leading_vector_and_a_long_path(spark):
    m = np.array([[0, 3, 2, 0, 0], [3, 0, 2.5, -1, 0], [2, 2.5, 0, 0.5, 0], [0, -1, 0.5, 0, 1], [0, 0, 0, 1, 0]])
    pairs = spark.createDataFrame([("g", f"n{i}", f"n{j}", float(m[i, j])) for i in range(5) for j in range(i + 1, 5) if m[i, j]], "g string, a string, b string, w double")
    got = {r.node: r.v for r in graphs.leading_vector(pairs, ["g"], 30).collect()}
    values, vectors = np.linalg.eigh(m)
    v = vectors[:, np.argmax(np.abs(values))]
    v = v * np.sign(v[np.argmax(np.abs(v))])
    assert np.allclose([got[f"n{i}"] for i in range(5)], v, atol=1e-3)
    long = spark.createDataFrame([("g", f"p{i:03}", f"p{i + 1:03}", 1.0) for i in range(100)], "g string, a string, b string, distance double")
    assert graphs.shortest_paths(long, ["g"]).agg(F.max("distance")).first()[0] == 100.0


def test_gatekeeper_score_of_known_reach(spark):
    """Values of a published table: reach of both signs, one pole each."""
    known = [(1.5944106820274775, 0.0, 0.0, 1.4391802081014398, 0.47441473150186864, 2.059777054310622), (2.060942882618064, 0.0, 0.0, 1.5932867552714547, 0.43601166667665625, 1.9732352705100538)]
    for k, (pp, pm, np_, nm, balance, score) in enumerate(known):
        ties = [(1, "x", "p", pp - np_), (1, "x", "q", pm - nm)]
        df = spark.createDataFrame([(g, a, b, w) for g, a, b, w in ties], "g int, a string, b string, w double")
        side = spark.createDataFrame([(1, "x", 1), (1, "p", 1), (1, "q", -1)], "g int, node string, side int")
        r = {x.node: x for x in graphs.gatekeepers(df, side, ["g"], "node").collect()}["x"]
        assert r.balance == pytest.approx(balance, rel=1e-6) and r.gatekeeper_score == pytest.approx(score, rel=1e-6) and r.cross_pressure == pytest.approx(0, abs=1e-6)


def test_sides_of_positions_of_one_sign(spark):
    df = spark.createDataFrame([(1, "a", -2.0), (1, "b", -1.0), (1, "c", 0.0), (2, "a", -1.0), (2, "b", 1.0)], "g int, p string, v double")
    got = {(r.g, r.p): r.side for r in graphs.sides(df, ["g"], "p", "v").collect()}
    assert got == {(1, "a"): -1, (1, "b"): 1, (1, "c"): 1, (2, "a"): -1, (2, "b"): 1}


def test_mean_tests(spark):
    rows = [("e", "pre", float(v)) for v in (1, 2, 3, 7)] + [("e", "post", float(v)) for v in (4, 5, 6, 8)]
    r = stats.mean_tests(spark.createDataFrame(rows, "k string, g string, v double"), ["k"], "g", "pre", "post", "v").first()
    assert (r.n1, r.n2, r.u) == (4, 4, 3.0) and r.u_p == pytest.approx(0.2)


def test_bootstrap_weights_are_poisson(spark):
    seeds = np.array([r.s for r in spark.range(4000).select(resample.seed(F.col("id")).alias("s")).collect()])
    w = resample.weights(seeds, *resample.multipliers(250))
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02 and abs(np.corrcoef(w[:-1].ravel(), w[1:].ravel())[0, 1]) < 0.01
    rows = spark.range(4000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN NULL ELSE 'g' END AS k", "id % 5 AS v").repartition(3)
    got = {r.k: r.v for r in resample.drawn_sums(rows, ["k"], ["v"], [F.col("id")], 250).collect()}
    for k, keep in ((None, np.arange(4000) % 3 == 0), ("g", np.arange(4000) % 3 > 0)):
        assert got[k] == ((np.arange(4000) % 5 * keep) @ w).tolist()


def test_positions_of_absent_concepts_count_as_zero(spark):
    scales = spark.createDataFrame([("a", 1.0, 2.0), ("b", 3.0, 1.0)], "concept string, mu double, sd double")
    weights = spark.createDataFrame([("a", 0.6), ("b", 0.8)], "concept string, w double")
    f = spark.createDataFrame([("x", "a", 5.0), ("y", "c", 1.0), ("y", "b", 3.0)], "party string, concept string, value double")
    got = {r.party: r.position for r in axis.scored(f, scales, weights, ["party"]).collect()}
    assert got == pytest.approx({"x": 0.6 * 2 - 0.8 * 3, "y": -0.6 / 2})


def test_windows_are_linear_in_matches(spark):
    import time

    text = "word of the house and "
    took = {}
    for n in (1000, 1000, 4000):
        df = spark.createDataFrame([(1, text * n)], "i int, t string").withColumn("w", T.windows(F.col("t"), r"\bhouse\b", 90))
        start = time.time()
        assert df.select(F.size("w")).first()[0] == n
        took[n] = time.time() - start
    assert took[4000] <= 4.5 * max(took[1000], 0.3)
    r = spark.createDataFrame([("a house x house",)], "t string").select(T.windows(F.col("t"), "house", 3).alias("w")).first().w
    assert r == ["a house x ", " x house"]


def test_bootstrap_weights_are_bytes_with_the_steps_of_the_fraction(spark):
    """The old way is the yardstick, at the seeds around every step and at random; sums stay exact for huge values and null keys."""
    at = [int(p * resample.PRIME) + d for p in resample.POISSON for d in range(-2, 3)] + [0, 1, resample.PRIME - 1]
    one = resample.weights(np.array(at), np.array([1]), np.array([0]))
    assert one.dtype == np.uint8 and one[:, 0].tolist() == np.searchsorted(resample.POISSON, np.array(at) / resample.PRIME, side="right").tolist()
    seeds, (a, b) = np.random.default_rng(5).integers(0, resample.PRIME, 5000), resample.multipliers(40)
    w = np.searchsorted(resample.POISSON, ((seeds[:, None] * a + b) % resample.PRIME) / resample.PRIME, side="right")
    assert (resample.weights(seeds, a, b) == w).all()
    big = (1 << 55) + 1
    rows = spark.createDataFrame([(None if i % 3 == 0 else "x", f"c{i % 2}", i, big if i % 50 == 7 else i) for i in range(700)], "k string, c string, id long, v long")
    kept = rows.withColumn("_seed", resample.seed(F.col("id"))).collect()
    got = {(r.k, r.c): r.v for r in resample.drawn_sums(rows, ["k", "c"], ["v"], [F.col("id")], 40).collect()}
    for key in {(r.k, r.c) for r in kept}:
        mine = [r for r in kept if (r.k, r.c) == key]
        w = np.searchsorted(resample.POISSON, ((np.array([r._seed for r in mine])[:, None] * a + b) % resample.PRIME) / resample.PRIME, side="right")
        assert got[key] == [sum(int(k) * r.v for k, r in zip(w[:, d], mine)) for d in range(40)]


def test_axis_is_fitted_anew_to_resamples_and_without_each_anchor(spark):
    """Against plain loops; party e is no anchor, in the second table no concept correlates, so the axis is a singular vector."""
    import hashlib

    scores = {"a": -1.0, "b": 0.5, "c": 0.2, "d": 1.1}
    anchors = spark.createDataFrame(list(scores.items()), "party string, anchor double")
    rng, parties, concepts, years = np.random.default_rng(3), list("abcde"), ["x", "y", "q"], range(4)
    cells = {(y, p, c): float(rng.normal()) for y in years for p in parties for c in concepts}

    def fit(mean, who):
        w = {}
        for c in concepts:
            x, y = [mean[p][c] for p in who], [scores[p] for p in who]
            w[c] = 0.0 if len(who) < 2 or np.std(x) == 0 or np.std(y) == 0 else float(np.corrcoef(x, y)[0, 1])
        v = np.array([w[c] for c in concepts])
        v /= np.linalg.norm(v)
        r = np.corrcoef([sum(mean[p][c] * v[i] for i, c in enumerate(concepts)) for p in who], [scores[p] for p in who])[0, 1]
        return v * (-1 if r < 0 else 1), abs(r)

    def means(rows):
        return {p: {c: np.mean([cells[y, q, c] for y, q in rows if q == p]) for c in concepts} for p in {q for _, q in rows}}

    panel = [(y, p) for y in years for p in parties]
    mean = means(panel)
    full, seen = fit(mean, list(scores))
    place = lambda m, v: np.array([sum(m[p][c] * v[i] for i, c in enumerate(concepts)) for p in parties])
    loo = {p: abs(np.corrcoef(place(mean, full), place(mean, fit(mean, [q for q in scores if q != p])[0]))[0, 1]) for p in scores}
    boot = {}
    for d in range(1, 21):
        taken = [panel[int(hashlib.md5(f"{d}|{i}".encode()).hexdigest()[:8], 16) % len(panel)] for i in range(len(panel))]
        m = means(taken)
        boot[d] = fit(m, [p for p in scores if p in m])
    z = spark.createDataFrame([(*k, v) for k, v in cells.items()], "year int, party string, concept string, z double")
    centers = spark.createDataFrame([(p, float(i * i)) for i, p in enumerate(parties)], "party string, center double")
    got = {(r.metric, r.name): r.value for r in axis.validation(z, anchors, centers, ["year"], 20, 50).collect()}
    assert got["observed_anchor_correlation", None] == pytest.approx(seen) and got["anchors", None] == 4
    assert {p: got["leave_one_anchor_out", p] for p in scores} == pytest.approx(loo)
    assert {d: got["anchor_corr_bootstrap", str(d)] for d in boot} == pytest.approx({d: r for d, (_, r) in boot.items()})
    assert got["bootstrap_anchor_corr_mean", None] == pytest.approx(np.mean([r for _, r in boot.values()])) and got["bootstrap_anchor_corr_std", None] == pytest.approx(np.std([r for _, r in boot.values()]))
    for i, c in enumerate(concepts):
        w = np.array([v[i] for v, _ in boot.values()])
        assert [got[f"weight_bootstrap_{m}", c] for m in ("mean", "std", "q10", "q90")] == pytest.approx([w.mean(), w.std(ddof=1), np.quantile(w, 0.1), np.quantile(w, 0.9)])
        assert got["weight", c] == pytest.approx(full[i])
    # constant rows: the first singular vector of (1, 2) is along it; without anchors the weights are equal
    same = spark.createDataFrame([("s", p, c, v, 1.0 * i if p != "n" else None) for i, p in enumerate(["a", "b", "n"]) for c, v in (("x", 3.0), ("y", 4.0))] + [("t", "n", "x", 1.0, None), ("t", "n", "y", 2.0, None)], "g string, party string, concept string, z double, anchor double")
    w, _ = axis.fitted(same, ["g"])
    assert {(r.g, r.concept): r.w for r in w.collect()} == pytest.approx({("s", "x"): 0.6, ("s", "y"): 0.8, ("t", "x"): 0.5**0.5, ("t", "y"): 0.5**0.5})
