"""Prefix trie against a plain dictionary of prefixes."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows: list[tuple]) -> set[tuple]:
    convs: dict[int, list] = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            convs.setdefault(c, []).append((turn is not None, turn or 0, tie, (role, text)))
    own = {c: [t[3] for t in sorted(ts)] for c, ts in convs.items()}
    nodes: dict[tuple, list[int]] = {}
    ends: dict[tuple, list[int]] = {}
    for c, ts in own.items():
        base, h = c - int(np.fmod(c, 20)), zlib.crc32(str(c).encode()) % 4
        full = tuple(own.get(base, [])[:h] + ts[h:])
        for d in range(len(full) + 1):
            nodes.setdefault(full[:d], []).append(c)
        ends.setdefault(full, []).append(c)
    kids: dict[tuple, int] = {}
    for p in nodes:
        if p:
            kids[p[:-1]] = kids.get(p[:-1], 0) + 1
    leaves, saved = dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0)
    for p, members in nodes.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in kids
            saved[p[:d]] += (len(members) - 1) * words
    sha = lambda p: hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()
    return {(min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), kids.get(p, 0), leaves[p], saved[p], sha(p)) for p, m in nodes.items()}


def found(spark, rows: list[tuple]) -> set[tuple]:
    got = prefix_trie.trie(spark.createDataFrame(rows, SCHEMA).withColumn("depth", F.lit("x"))).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
    )
    out = [tuple(r) for r in got.collect()]
    assert len(out) == len(set(out))
    return set(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_conversations_match_a_dictionary(spark, seed):
    rng = random.Random(seed)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    rows: list[tuple] = []
    for c in rng.sample(range(-60, 300), 140):
        for t in range(rng.choice([0, 1, 2, 3, 4, 5, 9])):
            rows.append((c, t if rng.random() < 0.9 else None, rng.choice(["user", "assistant", None]) if rng.random() < 0.3 else "user", rng.choice(["a b", "a\x0bb  c", "", None, "x"])))
    rows += rows[:5] + [(None, 0, "user", "lost")]
    rows += [(c, t, "user", "same") for c in (400, 401, 402, 403, 420, 440, 441) for t in range(5)]  # copies
    rows += [(500, t, "user", "long " * 3) for t in range(400)] + [(501, t, "user", "long " * 3) for t in range(200)]  # a prefix of a long one
    rng.shuffle(rows)
    try:
        assert found(spark, rows) == plain(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_empty_turnless_and_single(spark):
    assert found(spark, []) == set()
    rows = [(7, 0, None, None)]  # crc32("7") % 4 is not 0, and there is no conversation 0
    assert zlib.crc32(b"7") % 4 > 0 and found(spark, rows) == plain(rows)
    assert found(spark, [(0, 0, "user", "a")]) == plain([(0, 0, "user", "a")])


def test_ids_of_a_large_node_are_hashed_in_pieces(spark):
    ends = spark.range(1000).select(F.lit(1).cast("long").alias("k1"), F.lit(2).cast("long").alias("k2"), (F.col("id") * 7).alias("conv"))
    counts = ends.groupBy("k1", "k2").agg(F.count("*").alias("ends"))
    want = hashlib.sha256(",".join(str(7 * i) for i in range(1000)).encode()).hexdigest()
    assert prefix_trie.ends_digest(ends, counts, chunk=64).collect() == [(1, 2, want)] == prefix_trie.ends_digest(ends, counts).collect()


def test_find_close_over_many_blocks():
    rng = np.random.default_rng(3)
    for n in (1, 5, 700):
        bits, depth, left = [], 0, n
        while left or depth:
            if left and (depth == 0 or rng.random() < 0.6):
                bits.append(1)
                left, depth = left - 1, depth + 1
            else:
                bits.append(0)
                depth -= 1
        stack, close = [], {}
        for i, b in enumerate(bits):
            if b:
                stack.append(i)
            else:
                close[stack.pop()] = i
        opens = np.array(sorted(close))
        assert prefix_trie.Parentheses(np.array(bits), span=8).find_close(opens).tolist() == [close[i] for i in opens.tolist()]
