"""Vector codes against plain loops over whole numbers."""

from __future__ import annotations

import hashlib
import random
from collections import defaultdict
from fractions import Fraction
from math import floor, isfinite

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.llm import vector_codes

SCHEMA = "vec_id long, embedding array<double>, label string"


def plain(rows, parts=8, entries=16, rounds=6):
    kept = [r for r in rows if r[1] is not None and all(x is not None and isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    n = len(kept[0][1]) if kept else 0
    odd = [r for r in kept if len(r[1]) != n or n == 0 or n % parts]
    kept = [r for r in kept if r not in odd]
    step = n // parts
    cut = [[tuple(floor(Fraction(x) * 4096) for x in r[1][p * step : (p + 1) * step]) for p in range(parts)] for r in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda x, book: min(range(len(book)), key=lambda i: (dist(x, book[i]), i))
    for _ in range(rounds):
        for p in range(parts):
            groups = defaultdict(list)
            for c in cut:
                groups[near(c[p], books[p])].append(c[p])
            for e, g in groups.items():
                books[p][e] = tuple(sum(col) // len(g) for col in zip(*g))
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    code = [[near(c[p], books[p]) for p in range(parts)] for c in cut]
    error = [sum(dist(c[p], books[p][k[p]]) for p in range(parts)) for c, k in zip(cut, code)]
    total = defaultdict(int)
    for r, e in zip(kept, error):
        total[r[2]] += e
    out = [(r[0], "".join(f"{x:02x}" for x in k), e, total[r[2]], sha) for r, k, e in zip(kept, code, error)]
    return sorted(out + [(r[0], None, None, None, sha) for r in odd], key=str)


def found(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("code", F.lit(1)).withColumn("ids", F.lit(1)).repartition(3)
    return sorted([tuple(r) for r in vector_codes.codes(df).collect()], key=str)


@pytest.mark.parametrize("kind", ["clusters", "ties", "huge", "few"])
def test_codes_equal_plain_loops(spark, monkeypatch, kind):
    monkeypatch.setattr(vector_codes, "BLOCK", 64)
    rng = random.Random(kind)
    if kind == "ties":  # many equal parts and repeated rows
        rows = [(i // 2, [rng.choice([-0.5, 0.0, 0.25]) for _ in range(16)], rng.choice(["a", None])) for i in range(300)]
    elif kind == "huge":  # distances beyond 64 bits cancel out only where vectors are equal
        rows = [(i, [1e30 * (i % 3)] * 8, "a") for i in range(40)]
    elif kind == "few":
        rows = [(i, [rng.gauss(0, 1) for _ in range(16)], "a") for i in range(5)]
    else:
        centres = [[rng.gauss(0, 1) for _ in range(24)] for _ in range(9)]
        rows = [(i, [c + rng.gauss(0, 0.1) for c in rng.choice(centres)], str(i % 4)) for i in range(400)]
        rows += [(None, [0.1] * 24, None), (900, None, "a"), (901, [None] * 24, "a"), (902, [float("nan")] * 24, "a"), (903, [float("inf")] * 24, "a")]
        rows += [(904, [0.5] * 23, "a"), (905, [], "b")]
    rng.shuffle(rows)
    assert found(spark, rows) == plain(rows)


def test_empty_table_and_first_row_of_odd_length(spark):
    assert found(spark, []) == []
    rows = [(0, [1.0, 2.0], "a"), (1, [0.5] * 8, "a")]
    assert [r[1:4] for r in found(spark, rows)] == [(None, None, None)] * 2


def test_assignment_prunes_and_stays_exact():
    rng = np.random.default_rng(5)
    points = (rng.normal(size=(700, 8)) * 400).astype(np.int64) + rng.integers(0, 6, (700, 1)) * 5000
    book = points[:13].copy()
    order = vector_codes.halved(points, vector_codes.LEAF)
    sums, counts, code = vector_codes.assign(points[order], book)
    want = ((points[order][:, None] - book[None]) ** 2).sum(2).argmin(1)
    assert (code == want).all() and (counts == np.bincount(want, minlength=13)).all()
    assert (sums == np.array([points[order][want == i].sum(0) for i in range(13)])).all()
