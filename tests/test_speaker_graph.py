"""The graph of many speakers, principal directions and signs of pairs against plain numpy."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.operators import graphs, panels, speaker_graph, stats
from parlance.plans import registry, study_queries  # noqa: F401 (the registry loads the queries in order)


def test_strongest_ties_equal_all_pairs(spark):
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for g, n in ((1, 40), (2, 7)):
        x = np.round(rng.normal(size=(n, 5)), 1) * (rng.random((n, 5)) < 0.7)
        x[1] = x[0]  # equal speakers tie
        rows += [(g, f"s{i:02}", f"c{j}", float(x[i, j])) for i in range(n) for j in range(5) if x[i, j] or j == 0]
        z = (x - x.mean(0)) / x.std(0, ddof=1)
        u = z / np.linalg.norm(z, axis=1)[:, None]
        w = u @ u.T
        for i in range(n):
            for sign in (1, -1):
                near = sorted((-round(sign * w[i, j], 12), j) for j in range(n) if j != i and round(sign * w[i, j], 12) > 0)[:3]
                for _, j in near:
                    e = (g, f"s{min(i, j):02}", f"s{max(i, j):02}")
                    want[e] = want.get(e, 0) + w[i, j] / 2
    long = spark.createDataFrame(rows, "g int, speaker string, concept string, value double")
    vectors = speaker_graph.unit_vectors(long, ["g"], "speaker", "value")
    for block in (8, 1024):
        got = {(r.g, r.a, r.b): r.w for r in speaker_graph.signed_knn(vectors, ["g"], "speaker", 3, block).collect()}
        assert got == pytest.approx(want)


def test_copies_are_one_node_with_the_scores_of_all_pairs(spark):
    rng = np.random.default_rng(8)
    x = np.round(rng.normal(size=(15, 4)), 1)
    rows = [(1, f"s{i:02}-{j:02}", f"c{d}", float(x[i, d])) for i in range(15) for j in range(1 if i < 5 else 30) for d in range(4)]
    long = spark.createDataFrame(rows, "g int, speaker string, concept string, value double")
    vectors = speaker_graph.unit_vectors(long, ["g"], "speaker", "value")
    nodes, members, picks = speaker_graph.lumped(vectors, ["g"], "speaker", 3, 4)
    assert nodes.agg(F.sum("times")).first()[0] == members.count() == 305 and picks.count() < 100 * 6
    knn = speaker_graph.signed_knn(vectors, ["g"], "speaker").cache()
    v = graphs.leading_vector(knn, ["g"], 2).withColumn("v", F.round("v", 9))
    tau = graphs.best_poles(graphs.pole_sweep(knn, v, ["g"]), ["g"]).first().tau
    side = F.when(F.col("v") >= tau, 1).when(F.col("v") <= -tau, -1).otherwise(0)
    want = {r.node: (r.side, r.gatekeeper_score) for r in graphs.gatekeepers(knn, v.select("g", "node", side.alias("side")), ["g"], "node").collect()}
    got = {r.node: (r.side, r.gatekeeper_score) for r in speaker_graph.gatekeepers(long, ["g"], "speaker", "value", 2).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_principal_components(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(60, 4)) * [3, 2, 0.5, 0.1]
    vectors = spark.createDataFrame([(1, f"s{i}", x[i].tolist()) for i in range(60)], "g int, e string, u array<double>")
    got = {r.e: (r.x, r.y) for r in graphs.embedding(vectors, ["g"], "e", 100).collect()}
    c = x - x.mean(0)
    _, _, vt = np.linalg.svd(c, full_matrices=False)
    vt = vt[:2] * np.sign(vt[[0, 1], np.abs(vt[:2]).argmax(1)])[:, None]
    assert np.allclose([got[f"s{i}"] for i in range(60)], c @ vt[:2].T, atol=1e-6)


def test_signs_of_pairs(spark):
    rng = np.random.default_rng(1)
    for n in (1, 5, 300):
        t, v = rng.integers(0, max(n // 2, 2), n), rng.integers(0, 20, n)
        want = sum(int(np.sign(v[j] - v[i])) for i in range(n) for j in range(n) if t[i] < t[j])
        assert stats.signs(t, v.astype(float)) == want
    rows = [(k, int(t), float(v)) for k, n in (("a", 200), ("b", 5), ("c", 3)) for t, v in zip(rng.permutation(n), rng.integers(0, 12, n))] + [("a", 999, None)]
    got = {r.k: (r.s, r.n) for r in stats.mann_kendall(spark.createDataFrame(rows, "k string, t int, v double"), ["k"], "t", "v").collect()}
    plain = {k: sum(np.sign(b[2] - a[2]) for a in rows for b in rows if a[0] == b[0] == k and a[1] < b[1] and a[2] is not None and b[2] is not None) for k in ("a", "b")}
    assert got == {"a": (plain["a"], 200), "b": (plain["b"], 5)}


def test_arcs_are_rows_of_nodes_in_the_power_iteration(spark):
    rng = np.random.default_rng(4)
    rows, want = [], {}
    for g, n in ((1, 30), (2, 5)):
        a = np.triu(np.round(rng.normal(size=(n, n)), 2), 1)
        a[0, 1:] = 1.0  # a node that all others are tied to
        a += a.T
        rows += [(g, 100 * g + i, 100 * g + j, float(a[i, j])) for i in range(n) for j in range(i + 1, n) if a[i, j]]
        v = np.linalg.matrix_power(a / np.abs(a).sum(), 20) @ np.ones(n)
        want |= {(g, 100 * g + i): x for i, x in enumerate(v / np.linalg.norm(v))}
    pairs = spark.createDataFrame(rows, "g int, a long, b long, w double")
    arcs = graphs._arcs(pairs, ["g"])
    small = graphs.adjacent(arcs, ["g"], 8)
    assert small.agg(F.max(F.size("to"))).first()[0] < 16 and small.where("b = 100").count() > 1
    assert sorted(small.select("g", "b", F.inline("to")).select("g", "a", "b", "w").collect()) == sorted(arcs.collect())
    assert graphs.adjacent(arcs, ["g"]).count() == 35
    start = arcs.select("g", F.col("a").alias("node"), F.lit(1.0).alias("v")).distinct()
    got = {(r.g, r.node): r.v for r in graphs.power_vector(pairs, start, ["g"], 10).collect()}
    assert got == pytest.approx(want)


def test_turnover_and_overlap_work_out_the_scores_once(spark):
    s = spark.range(40).selectExpr("CAST(id % 4 AS INT) AS year", "CAST(id AS STRING) AS speaker", "id / 7 AS gatekeeper_score").repartition(3)
    rows = s.groupBy("year").agg(F.max_by("speaker", "gatekeeper_score").alias("broker"), F.sum("gatekeeper_score").alias("hhi"))
    for got in (graphs.turnover(rows, "year"), graphs.overlap(s, "year", "speaker", "gatekeeper_score", 3)):
        assert got.count() == 3
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "Range" not in plan and "Aggregate" not in plan


def test_values_of_the_active_speakers_come_from_one_pass(spark):
    rng = np.random.default_rng(4)
    rows = [(int(rng.integers(3)) or None, f"s{int(rng.integers(30))}" if rng.random() < 0.9 else None, f"c{int(rng.integers(4))}" if rng.random() < 0.8 else None, *map(int, rng.integers(0, 6, 3))) for _ in range(900)]
    m = spark.createDataFrame(rows, "g int, speaker string, concept string, mention_count long, pos long, neg long")
    f = panels.signed_agenda_feature(m, ["g", "speaker", "concept"]).join(speaker_graph.active(m, ["g"], "speaker"), ["g", "speaker"], "left_semi")
    want = {(r.g, r.speaker, r.concept): r.feature for r in f.collect()}
    read = spark.sparkContext.accumulator(0)

    def passed(batches):
        for b in batches:
            read.add(len(b))
            yield b

    got = study_queries._speaker_values(m.mapInPandas(passed, m.schema), ["g"])
    got = {(r.g, r.speaker, r.concept): r.value for r in got.collect()}
    assert got == pytest.approx(want) and 0 < len(want) < len({r[:3] for r in rows if None not in r[:3]})
    assert read.value == len(rows)


def test_power_iteration_of_small_graphs_is_one_task_with_the_same_vector(spark):
    """Both ways, each graph by its own way, and shuffles that don't grow with the steps."""
    rng = np.random.default_rng(9)
    rows = [(g, 1000 * g + int(i), 1000 * g + int(j), float(w)) for g, n in ((1, 60), (2, 12)) for i, j, w in zip(rng.integers(0, n, 6 * n), rng.integers(0, n, 6 * n), rng.normal(size=6 * n).round(2)) if i != j]
    rows += [(3, 3001, 3002, 0.0), (1, 1001, 1900, 0.0)]  # no ties
    pairs = spark.createDataFrame(rows, "g int, a long, b long, w double")
    start = pairs.select("g", F.explode(F.array("a", "b")).alias("node")).distinct().select("g", "node", graphs.start_value(F.col("node")).alias("v"))
    got = [{(r.g, r.node): r.v for r in graphs.power_vector(pairs, start, ["g"], 8, in_task=n).collect()} for n in (0, 100, 10_000)]
    assert got[0].keys() == got[1].keys() == got[2].keys() and not any(g == 3 or n == 1900 for g, n in got[0])
    assert got[1] == pytest.approx(got[0]) and got[2] == pytest.approx(got[0])
    plan = graphs._in_task(pairs, start, ["g"], 40)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 3
