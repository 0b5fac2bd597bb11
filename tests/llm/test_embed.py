import numpy as np
import pytest

from parlance.llm import embed_dedup


def brute(rows, least=0.95):
    ok = {}
    for k, (_, v) in enumerate(rows):
        if v and all(c is not None and np.isfinite(c) for c in v) and any(v):
            x = np.array(v, float)
            x = x / np.abs(x).max()
            ok[k] = x / np.linalg.norm(x)
    links, root = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ok:
        for b in ok:
            if a < b and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] >= least:
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    names = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            names[find(k)] = min(names.get(find(k), i), i)
    return {(i, k): (links[k], names.get(find(k)) if k in ok else i) for k, (i, _) in enumerate(rows)}


def vectors(n_groups, size, noise, dim=24, alone=150):
    rng = np.random.default_rng(4)
    out = []
    for _ in range(n_groups):
        base = rng.normal(size=dim)
        out += [(base + rng.normal(size=dim) * noise).tolist() for _ in range(size)]
    return out + rng.normal(size=(alone, dim)).tolist()


@pytest.mark.parametrize("cap", [3000, 100])
def test_links_and_components_equal_brute_force(spark, cap):
    vs = vectors(12, 9, 0.1) + vectors(1, 70, 0.05, alone=0)
    vs += [vs[0], vs[0], [2 * x for x in vs[1]], None, [], [0.0] * 24, [None] + [1.0] * 23, [float("nan")] * 24, [float("inf")] * 24, [1e200] * 24, [1e-200] * 24, [1.0, 2.0], [2.0, 4.0]]
    rows = [(i * 7 % 2003, v) for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in embed_dedup.near_duplicates(df, cap=cap).collect()}
    want = brute(rows)
    true = sum(n for n, _ in want.values())
    found = sum(got[i].n_links for i, _ in want)
    assert 0.97 * true <= found <= true
    if cap == 3000:
        for (i, _), (n, c) in want.items():
            assert (got[i].n_links, got[i].component_id, got[i].kept) == (n, c, i == c)
    else:
        assert sum(got[i].component_id == c for (i, _), (_, c) in want.items()) >= 0.98 * len(rows)


def test_odd_rows(spark):
    df = spark.createDataFrame([(None, [1.0, 0.0]), (5, [1.0, 0.0]), (5, [1.0, 0.0]), (None, None), (7, None)], "vec_id long, embedding array<float>")
    got = sorted([tuple(r) for r in embed_dedup.near_duplicates(df).collect()], key=str)
    assert got == sorted([(None, 2, 5, False), (5, 2, 5, True), (5, 2, 5, True), (None, 0, None, False), (7, 0, 7, True)], key=str)
    assert embed_dedup.near_duplicates(df.limit(0)).count() == 0


def test_pruned_graph_reaches_all_near_nodes():
    x = np.array(vectors(20, 12, 0.08, alone=400))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    start, adjacency = embed_dedup.build(x)
    s = x @ x.T >= 0.95
    np.fill_diagonal(s, False)
    found = sum(len(embed_dedup.range_search(x, [np.array(a, int) for a in adjacency], q, start, 0.95, embed_dedup.BEAM)) for q in range(len(x)))
    assert found >= 0.97 * s.sum()


def test_a_large_component_is_counted_by_its_core(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "CORE", 20)
    monkeypatch.setattr(embed_dedup, "BLOCK", 16)
    monkeypatch.setattr(embed_dedup, "CHUNK", 30)
    rng = np.random.default_rng(8)
    base = rng.normal(size=24)
    vs = [(base + rng.normal(size=24) * s).tolist() for s in [0.05] * 70 + [0.2] * 40]
    rows = list(enumerate(vs)) + [(500, vs[3]), (501, vs[80])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, node int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embed_dedup.near_duplicates(df).collect()}
    assert got == {i: w for (i, _), w in brute(rows).items()}
