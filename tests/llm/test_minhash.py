import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from parlance.llm import components, minhash

SF = "/root/testdata/sf0.01"


def brute_shingles(t):
    w = re.findall(r"[^\W_]+", (t or "").lower())
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def brute_classes(rows, weighted=False, least=0.8):
    """doc_id -> smallest doc_id of its class, by all pairs through a root table."""
    sets = {}
    for i, t in rows:
        sets.setdefault(t or "", []).append(i)
    texts = list(sets)
    grams = [brute_shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    index = {}
    for k, g in enumerate(grams):
        for s in g:
            index.setdefault(s, []).append(k)
    for k, g in enumerate(grams):
        near = {j for s in g for j in index[s] if j < k}
        for j in near:
            o = grams[j]
            inter = sum(min(g[s], o[s]) for s in g) if weighted else len(g.keys() & o.keys())
            total = sum(g.values()) + sum(o.values()) if weighted else len(g) + len(o)
            if inter / (total - inter) >= least:
                root[find(k)] = find(j)
    least_id = {}
    for k, t in enumerate(texts):
        r = find(k)
        least_id[r] = min([least_id.get(r, min(sets[t])), *sets[t]])
    return {i: (least_id[find(k)] if grams[k] else i) for k, t in enumerate(texts) for i in sets[t]}


def test_shingles_equal_brute_force():
    texts = ["", "one", "A b, c D e f!", "a_b a_b x", "é" * 5000, "1 2 3 4 5 6 1 2 3 4 5 6", "--- !!", "Zwölf Boxkämpfer jagen Viktor quer über"]
    got = minhash.shingles(texts)
    for t, g in zip(texts, got):
        assert sorted(np.unique(g, return_counts=True)[1]) == sorted(brute_shingles(t).values())
    assert np.array_equal(minhash.shingles(["x y z p q"])[0], minhash.shingles(["w", "X  y-z;p q"])[1])


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(1)
    e = rng.integers(0, 2**63, 400, dtype=np.uint64)
    a, b = minhash.signature(e[:300], None, 2000), minhash.signature(e[100:], None, 2000)
    assert abs((a == b).mean() - 0.5) < 0.05
    wa, wb = rng.uniform(0.1, 3, 400), rng.uniform(0.1, 3, 400)
    want = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
    got = (minhash.signature(e, wa, 2000) == minhash.signature(e, wb, 2000)).mean()
    assert abs(got - want) < 0.05
    one = minhash.signature(e[:1], None, 300)
    assert len(np.unique(one)) == 300


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 50), (50, 100), (7, 7), (60, 61), (None, 3)] + [(200, i) for i in range(201, 400)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {50: 50, 100: 50, 60: 60, 61: 60} | {i: 200 for i in range(200, 400)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def make_docs():
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(500)]
    base = [list(rng.choice(words, 120)) for _ in range(6)]
    rows = []
    for k, b in enumerate(base):
        for _ in range(25):
            t = list(b)
            for _ in range(int(rng.integers(0, 7))):
                t[int(rng.integers(0, 120))] = f"n{rng.integers(0, 10**6)}"
            rows.append(" ".join(t))
    # a chain: each close to the next, the ends far apart
    t = list(base[0][::-1])
    for k in range(12):
        rows.append(" ".join(t))
        t[k * 9] = f"c{k}"
        t[k * 9 + 4] = f"d{k}"
    rows += ["", None, "only four words here", "Only, four words HERE", "!!", "x", rows[0], rows[0], " ".join(words) * 20]
    return [(i * 7 % 1009, t) for i, t in enumerate(rows)]


def test_near_duplicates_equal_brute_force(spark):
    rows = make_docs()
    docs = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, digest int")
    for weights in ("set", "count"):
        got = {r.doc_id: (r.class_id, r.kept) for r in minhash.near_duplicates(docs, weights=weights).collect()}
        want = brute_classes(rows, weights == "count")
        assert {i: c for i, (c, _) in got.items()} == want
        assert all(k == (i == c) for i, (c, k) in got.items())
    odd = spark.createDataFrame([(None, rows[0][1], 1), (None, None, 2), (9999, rows[0][1], 3), (9999, rows[0][1], 3)], docs.schema)
    left = minhash.keep_one(docs.unionByName(odd))
    ids = [r.doc_id for r in left.collect()]
    assert left.columns == docs.columns and sorted(i for i in ids if i is not None) == sorted(set(want.values())) and ids.count(None) == 2
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_near_duplicates_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("key", F.lit(1))
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(docs).collect()}
    want = brute_classes(rows)
    assert got == want and len(set(want.values())) < len(want)
