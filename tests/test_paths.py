"""Paths, betweenness, PageRank and forests against plain loops."""

from __future__ import annotations

import heapq
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.operators import paths


def graph(seed: int, n: int, m: int, directed: bool):
    rng = random.Random(seed)
    arcs = {}
    while len(arcs) < m:
        a, b = rng.sample(range(n), 2)
        w = rng.choice([1.0, 1.0, 2.0, 3.0])
        arcs[a, b] = w
        if not directed:
            arcs[b, a] = w
    return arcs


def brandes(arcs, n):
    out = {v: [] for v in range(n)}
    for (a, b), w in arcs.items():
        out[a].append((b, w))
    total, dist = np.zeros(n), {}
    for s in range(n):
        d, sigma, pred, order, heap, done = {s: 0.0}, np.zeros(n), {v: [] for v in range(n)}, [], [(0.0, s)], set()
        sigma[s] = 1
        while heap:
            x, v = heapq.heappop(heap)
            if v in done:
                continue
            done.add(v)
            order.append(v)
            for u, w in out[v]:
                if u not in d or x + w < d[u] - 1e-12:
                    d[u], sigma[u], pred[u] = x + w, sigma[v], [v]
                    heapq.heappush(heap, (x + w, u))
                elif abs(x + w - d[u]) < 1e-12:
                    sigma[u] += sigma[v]
                    pred[u].append(v)
        dist.update({(s, v): x for v, x in d.items() if v != s})
        delta = np.zeros(n)
        for v in reversed(order):
            for u in pred[v]:
                delta[u] += sigma[u] / sigma[v] * (1 + delta[v])
            if v != s:
                total[v] += delta[v]
    return dist, total / ((n - 1) * (n - 2))


@pytest.mark.parametrize("directed", [True, False])
def test_distances_and_betweenness(spark, directed):
    graphs = {k: (graph(k, 14, 30, directed), 14) for k in (1, 2)}
    graphs[3] = ({(0, 1): 1.0}, 3)
    arcs = spark.createDataFrame([(k, a, b, w) for k, (g, _) in graphs.items() for (a, b), w in g.items()], "g int, source int, target int, distance double")
    nodes = spark.createDataFrame([(k, v) for k, (_, n) in graphs.items() for v in range(n)], "g int, node int")
    far = {(r.g, r.a, r.b): r.distance for r in paths.distances(arcs, ["g"]).collect()}
    mid = {(r.g, r.node): r.betweenness for r in paths.betweenness(arcs, nodes, ["g"]).collect()}
    want_far, want_mid = {}, {}
    for k, (g, n) in graphs.items():
        d, b = brandes(g, n)
        want_far |= {(k, *ab): x for ab, x in d.items()}
        want_mid |= {(k, v): x for v, x in enumerate(b)}
    assert far == pytest.approx(want_far) and mid == pytest.approx(want_mid, abs=1e-12)


def test_pagerank_of_several_graphs(spark):
    graphs = {k: graph(k, 9, 20, True) for k in (5, 6)}
    graphs[6] = {ab: w for ab, w in graphs[6].items() if ab[0] != 4}  # node 4 leads nowhere
    edges = spark.createDataFrame([(k, a, b, w) for k, g in graphs.items() for (a, b), w in g.items()], "g int, source int, target int, w double")
    nodes = spark.createDataFrame([(k, v) for k in graphs for v in range(9)], "g int, node int")
    got = {(r.g, r.node): r["rank"] for r in paths.pagerank(edges, nodes, ["g"], "w", rounds=120, every=20).collect()}
    for k, g in graphs.items():
        p = np.zeros((9, 9))
        for (a, b), w in g.items():
            p[a, b] = w
        out = p.sum(1)
        p[out > 0] /= out[out > 0, None]
        p[out == 0] = 1 / 9
        r = np.full(9, 1 / 9)
        for _ in range(300):
            r = 0.15 / 9 + 0.85 * r @ p
        assert [got[k, v] for v in range(9)] == pytest.approx(r.tolist(), abs=1e-8)


def kruskal(edges):
    root = {}
    find = lambda v: v if root.setdefault(v, v) == v else find(root[v])
    tree = set()
    for w, a, b in sorted((-w, a, b) for a, b, w in edges):
        if find(a) != find(b):
            root[find(a)] = find(b)
            tree.add((a, b))
    return tree


def test_forest_and_backbone(spark):
    rng = random.Random(8)
    rows, want = [], set()
    for k in (1, 2, 3):
        pairs = {tuple(sorted(rng.sample(range(40), 2))) for _ in range(70 if k < 3 else 20)}
        edges = [(a, b, rng.choice([0.2, 0.5, 0.5, 0.9, rng.random()])) for a, b in pairs]
        rows += [(k, a, b, w) for a, b, w in edges]
        want |= {(k, a, b) for a, b in kruskal(edges)}
    df = spark.createDataFrame(rows, "g int, a int, b int, w double")
    tree = paths.spanning_forest(df, ["g"], [-F.col("w"), F.col("a"), F.col("b")])
    got = [tuple(r) for r in tree.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    kept = {(r.g, r.a, r.b) for r in paths.backbone(df, ["g"], 0.6).collect()}
    for k in (1, 2, 3):
        own = sorted(((-round(w, 9), a, b) for g, a, b, w in rows if g == k))
        n = len({v for _, a, b in own for v in (a, b)})
        left = max(n - 1, -(-len(own) * 6 // 10)) - sum(1 for e in want if e[0] == k)
        extra = [(k, a, b) for _, a, b in own if (k, a, b) not in want][:left]
        assert {e for e in kept if e[0] == k} == {e for e in want if e[0] == k} | set(extra)
    assert paths.spanning_forest(df.limit(0), ["g"], [F.col("w"), F.col("a"), F.col("b")]).count() == 0


def test_betweenness_reads_the_mentions_once(spark, monkeypatch):
    """Every hop reads the small table of years and nations, not the join of line items and orders."""
    from parlance.plans import fixtures, registry

    sf, read, real = "/root/testdata/sf0.001", spark.sparkContext.accumulator(0), fixtures.mentions

    def passed(batches):
        for b in batches:
            read.add(len(b))
            yield b

    monkeypatch.setattr(fixtures, "mentions", lambda *a, **k: (m := real(*a, **k)).mapInPandas(passed, m.schema))
    registry.QUERIES["betweenness"](spark, sf).collect()
    assert read.value == real(spark, sf, True).count()
