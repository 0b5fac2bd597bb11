"""Prefix trie of conversations, encoded as balanced parentheses in shards.

A node is a distinct sequence of first turns. Its key is the sum of the 128-bit digests of its turns,
each hashed with its depth, so all keys of a conversation are running sums over range partitions and no
conversation is held by one task. Of equal conversations that end in a leaf, the smallest id stands for
all.

The trie's paths: the lead of a node is the smallest such id under it. Going down, the lead only
changes to larger ids, and a conversation is written as the depths and leads of these changes. Sorted by
it (deeper changes first), the leaves under any node lie together. The sorted leaves are cut into
blocks (Arrow batches); each block encodes its compact trie as balanced parentheses, with the path to its first leaf as
spine. ``find_close`` over blocks of minimum excess delimits a node's subtree, the rank of ``()``
counts its leaves and a cumulative array gives what they save. Blocks send only what hangs off another
lead's path; spines shared by blocks merge by adding these up, and running sums along each lead's path
give the totals of every node.

Defined results
    null conv_id: the row is left out. null turn: first. null role or text: empty. Equal turns of a
    conversation (ties, repeated rows): all count, in the order of their digests. Negative ids: the
    remainder has the sign of the id. Empty table: empty result. A table whose conversations are all
    turnless has a root that is a leaf. Extra columns are never read. Keys of different sequences are
    equal with a chance of about 2^-128 a pair.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import running, staged, unstage

#: Leading turns taken from another conversation are fewer than SHARED; conversations in BATCH share a source.
SHARED, BATCH = 4, 20
#: Ids in one piece of a node's list.
CHUNK = 4096
#: Positions of a block of the excess array.
SPAN = 64
LOW = 0xFFFFFFFF
LIMBS = ["_l0", "_l1", "_l2", "_l3"]


def turns(conversations: DataFrame) -> DataFrame:
    """conv, pos (from 1), digest and words of each turn."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv"),
        F.col("turn").isNotNull().alias("_later"),
        F.coalesce("turn", F.lit(0)).alias("_turn"),
        F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("digest"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
        F.lit(1).cast("long").alias("_one"),
    )
    return running(rows, ["conv"], ["_later", "_turn", "digest"], {"pos": "_one"}).select("conv", "pos", "digest", "words")


def rebuilt(own: DataFrame, shared: int = SHARED, batch: int = BATCH) -> tuple[DataFrame, DataFrame]:
    """The rebuilt conversations: one row per conversation (conv, n), and one per turn (conv, depth, digest, words, last)."""
    convs = own.groupBy("conv").agg(F.max("pos").alias("_len"))
    convs = convs.withColumn("_h", F.crc32(F.col("conv").cast("string")) % shared).withColumn("_base", F.col("conv") - F.col("conv") % batch)
    base = convs.select(F.col("conv").alias("_base"), F.col("_len").alias("_has"))
    convs = convs.join(base, "_base", "left").withColumn("_lent", F.least("_h", F.coalesce("_has", F.lit(0))))
    convs = convs.withColumn("n", F.col("_lent") + F.greatest(F.col("_len") - F.col("_h"), F.lit(0)))
    convs = staged(convs.select("conv", "_base", "_h", "_lent", "n"), "conversations")
    rest = own.join(convs, "conv").where("pos > _h").withColumn("depth", F.col("pos") - F.col("_h") + F.col("_lent"))
    # at most shared - 1 turns of a source for each of the batch conversations that use it
    lent = own.where(F.col("pos") < shared).withColumnRenamed("conv", "_base").join(convs, "_base").where("pos <= _h").withColumn("depth", F.col("pos"))
    cols = ["conv", F.col("depth").cast("long").alias("depth"), "digest", "words", (F.col("depth") == F.col("n")).alias("last")]
    return convs, rest.select(*cols).unionByName(lent.select(*cols))


def _packed(a: Column, b: Column) -> Column:
    return F.shiftleft(a.bitwiseAND(F.lit(LOW)), 32).bitwiseOR(b.bitwiseAND(F.lit(LOW)))


def keyed(rows: DataFrame) -> DataFrame:
    """Adds the key (k1, k2) of each turn's node and of its parent (p1, p2); the root's is (0, 0)."""
    code = F.md5(F.concat(F.col("depth").cast("string"), F.lit(":"), F.col("digest")))
    for i, limb in enumerate(LIMBS):
        rows = rows.withColumn(limb, F.conv(F.substring(code, 8 * i + 1, 8), 16, 10).cast("long"))
    rows = running(rows.drop("digest"), ["conv"], ["depth"], {f"_r{i}": limb for i, limb in enumerate(LIMBS)})
    r = [F.col(f"_r{i}") for i in range(4)]
    before = [c - F.col(limb) for c, limb in zip(r, LIMBS)]
    return rows.select(
        "conv", "depth", "words", "last",
        _packed(r[0], r[1]).alias("k1"), _packed(r[2], r[3]).alias("k2"), _packed(before[0], before[1]).alias("p1"), _packed(before[2], before[3]).alias("p2"),
    )


class Parentheses:
    """A sequence of balanced parentheses (1 opens, 0 closes) with range min-max blocks over its excess."""

    def __init__(self, bits: np.ndarray, span: int = SPAN):
        self.bits, self.span, n = bits, span, len(bits)
        self.excess = np.cumsum(np.where(bits == 1, 1, -1))
        wide = np.full(-(-max(n, 1) // span) * span, np.iinfo(np.int64).max)
        wide[:n] = self.excess
        self.blocks = wide.reshape(-1, span)
        self.levels = [self.blocks.min(1)]
        while len(self.levels[-1]) > 1:
            low = self.levels[-1]
            if len(low) % 2:
                low = np.append(low, np.iinfo(np.int64).max)
            self.levels.append(low.reshape(-1, 2).min(1))
        pair = np.zeros(n, np.int64)
        if n:
            pair[:-1] = (bits[:-1] == 1) & (bits[1:] == 0)
        self.opens, self.pairs = np.append(0, np.cumsum(bits)), np.append(0, np.cumsum(pair))

    def find_close(self, at: np.ndarray) -> np.ndarray:
        """The position that closes each open position: the first later one whose excess is lower."""
        out = np.empty(len(at), np.int64)
        for lo in range(0, len(at), 8192):
            out[lo : lo + 8192] = self._find(at[lo : lo + 8192])
        return out

    def _find(self, at: np.ndarray) -> np.ndarray:
        need, block = self.excess[at], at // self.span
        hit = (self.blocks[block] < need[:, None]) & (np.arange(self.span) > (at % self.span)[:, None])
        found = hit.any(1)
        out = block * self.span + hit.argmax(1)
        todo = np.flatnonzero(~found)
        if len(todo):
            node, level, want = block[todo].copy(), np.zeros(len(todo), np.int64), need[todo]
            climb = np.ones(len(todo), bool)
            for k, low in enumerate(self.levels):  # up to a right sibling that goes low enough
                right = node + 1
                ok = climb & (node % 2 == 0) & (right < len(low))
                ok[ok] = low[right[ok]] < want[ok]
                node[ok], level[ok] = right[ok], k
                climb &= ~ok
                node[climb] //= 2
            for k in range(len(self.levels) - 1, 0, -1):  # down to its first block that does
                here = level == k
                left = 2 * node[here]
                node[here] = np.where(self.levels[k - 1][left] < want[here], left, left + 1)
                level[here] = k - 1
            out[todo] = node * self.span + (self.blocks[node] < want[:, None]).argmax(1)
        return out

    def leaves(self, at: np.ndarray, close: np.ndarray) -> np.ndarray:
        return self.pairs[close + 1] - self.pairs[at]


def encode(paths: list[tuple[list[int], list[int]]]) -> tuple[np.ndarray, list, list[int], list[int], list[int]]:
    """Parentheses of the compact trie of sorted leaves, and per node in preorder: its lead, its depth
    (leaves: -1), the place of its leaf (inner nodes: -1) and its parent's place (the root: -1).

    A path is the depths and the leads of its changes. The root has no lead and depth 0; the nodes on
    the path to the first leaf at which other leads' paths branch off are always there.
    """
    n = len(paths)
    depths, leads = paths[0]
    spine = [(0, None)] + [(depths[j] - 1, leads[j - 1]) for j in range(1, len(depths))]
    opened: list[list] = [[] for _ in range(n)]  # inner nodes that begin with a leaf, and how many end with it
    closed = [0] * n
    opened[0] += spine
    live = [(d, 0) for d, _ in spine]  # depth and first leaf of the nodes around the leaf at hand
    for i in range(1, n):
        (pd, pl), (nd, nl) = paths[i - 1], paths[i]
        j = 0
        while j < len(pd) and j < len(nd) and pd[j] == nd[j] and pl[j] == nl[j]:
            j += 1
        depth, first = nd[j] - 1, i - 1
        while live[-1][0] > depth:
            first = live.pop()[1]
            closed[i - 1] += 1
        if live[-1][0] < depth:
            opened[first].append((depth, nl[j - 1]))
            live.append((depth, first))
    closed[n - 1] += len(live)
    bits, lead, depth_of, leaf, parent, above = [], [], [], [], [], [-1]
    for i in range(n):
        for d, who in sorted(opened[i], key=lambda x: x[0]):
            parent.append(above[-1])
            above.append(len(lead))
            bits.append(1)
            lead.append(who)
            depth_of.append(d)
            leaf.append(-1)
        parent.append(above[-1])
        bits += [1, 0]
        lead.append(paths[i][1][-1])
        depth_of.append(-1)
        leaf.append(i)
        bits += [0] * closed[i]
        del above[len(above) - closed[i] :]
    return np.array(bits, np.int8), lead, depth_of, leaf, parent


def hanging(paths: list[tuple[list[int], list[int]]], saved: list[int]) -> list[tuple]:
    """What hangs off other leads' paths in one block of leaves: lead, depth, leaves and tokens saved below."""
    bits, lead, depth, leaf, parent = encode(paths)
    code, opens = Parentheses(bits), np.flatnonzero(bits == 1)
    close = code.find_close(opens)
    own = np.array([saved[i] if i >= 0 else 0 for i in leaf], np.int64)
    total = np.append(0, np.cumsum(own))
    leaves, below = code.leaves(opens, close), total[code.opens[close + 1]] - total[: len(opens)]
    return [(lead[p], depth[p], int(leaves[i]), int(below[i])) for i, p in enumerate(parent) if p >= 0 and lead[i] != lead[p]]


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("lead", pa.int64()), ("depth", pa.int64()), ("leaves", pa.int64()), ("below", pa.int64())])
    for batch in batches:
        if batch.num_rows:
            path = batch.column("path").to_pylist()
            paths = [([-e["up"] for e in p], [e["lead"] for e in p]) for p in path]
            got = hanging(paths, batch.column("saved").to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*got), schema.types)], schema=schema) if got else pa.RecordBatch.from_pylist([], schema=schema)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each key's pieces, which come in order; only the state of one hash is held."""
    key, state, schema = None, None, pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("sha", pa.string())])
    for batch in batches:
        out = []
        for a, b, text in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "ids"))):
            if (a, b) != key:
                if key is not None:
                    out.append((*key, state.hexdigest()))
                key, state = (a, b), hashlib.sha256()
            else:
                state.update(b",")
            state.update(text.encode())
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in out], schema=schema)
    if key is not None:
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, (*key, state.hexdigest())))], schema=schema)


def ends_digest(ends: DataFrame, counts: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """SHA-256 of each node's ids, ascending and joined by commas.

    A node with more than ``chunk`` ids has them numbered over range partitions and joined to pieces of
    ``chunk`` ids first; its hash, which is sequential, reads only these.
    """
    large = counts.where(F.col("ends") > chunk).select("k1", "k2")
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda x: x.cast("string")), ",")
    few = ends.join(large, ["k1", "k2"], "left_anti").groupBy("k1", "k2").agg(F.sha2(ids, 256).alias("sha"))
    many = ends.join(large, ["k1", "k2"], "left_semi").withColumn("_one", F.lit(1).cast("long"))
    many = running(many, ["k1", "k2"], ["conv"], {"at": "_one"}).withColumn("piece", F.floor((F.col("at") - 1) / chunk))
    many = many.groupBy("k1", "k2", "piece").agg(ids.alias("ids"))
    many = many.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "piece").select("k1", "k2", "ids")
    return few.unionByName(many.mapInArrow(_digest, "k1 long, k2 long, sha string"))


def trie(conversations: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256."""
    spark = conversations.sparkSession
    own = staged(turns(conversations), "turns")
    convs, rows = rebuilt(own)
    rows = staged(keyed(staged(rows, "rebuilt")), "prefixes")
    key, root = ["k1", "k2"], (F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"))

    node = rows.groupBy(key).agg(
        F.min("conv").alias("conv_id"), F.min("depth").alias("depth"), F.min("words").alias("words"), F.min("p1").alias("p1"), F.min("p2").alias("p2"),
        F.count("*").alias("n_convs"), F.count_if("last").alias("ends"),
    )
    node = staged(node, "nodes")
    children = node.groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"))
    node = node.join(children, key, "left").fillna(0, ["n_children"])

    # rows of the conversations that stand for a leaf, and the smallest of these under each node
    stand = node.where("n_children = 0").select(F.col("conv_id").alias("conv"))
    leafy = staged(rows.join(stand, "conv", "left_semi").select("conv", "depth", *key), "leaves")
    lead = staged(leafy.groupBy(key).agg(F.min("conv").alias("lead")), "leads")
    node = node.join(lead, key).withColumn("own", (F.col("n_convs") - 1) * F.col("words"))
    node = staged(node, "led")
    path = leafy.join(lead, key).groupBy("conv", "lead").agg((-F.min("depth")).alias("up"))
    path = path.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("up", "lead")), asc=False).alias("path"))
    saved = node.groupBy(F.col("lead").alias("conv")).agg(F.sum("own").alias("saved"))
    path = staged(path.join(saved, "conv").select("path", "saved"), "paths")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = path.repartitionByRange(n, "path").sortWithinPartitions("path").mapInArrow(_shards, "lead long, depth long, leaves long, below long")
    hung = staged(shards.groupBy("lead", "depth").agg(F.sum("leaves").alias("leaves"), F.sum("below").alias("below")), "spines")

    node = node.join(hung, ["lead", "depth"], "left").fillna(0, ["leaves", "below"]).withColumn("below", F.col("below") + F.col("own")).withColumn("_up", -F.col("depth"))
    node = running(node, ["lead"], ["_up"], {"_leaves": "leaves", "_saved": "below"})
    inner = ["conv_id", "depth", "p1", "p2", "n_convs", "n_children", (F.col("_leaves") + 1).alias("n_leaves"), F.col("_saved").alias("saved_tokens"), *key]
    node = node.select(*inner)
    everyone = convs.agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    below = hung.where("lead IS NULL").agg(F.sum("leaves").alias("_l"), F.sum("below").alias("_s"))
    tops = node.where("depth = 1").agg(F.count("*").alias("n_children"))
    top = everyone.crossJoin(below).crossJoin(tops)  # three tables of one row
    top = top.select(
        "conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", "n_children",
        F.coalesce("_l", F.lit(1)).alias("n_leaves"), F.coalesce("_s", F.lit(0)).alias("saved_tokens"), *root,
    )
    parent = node.select(F.col("conv_id").alias("parent_conv_id"), F.col("k1").alias("p1"), F.col("k2").alias("p2"))
    first = node.where("depth = 1").crossJoin(F.broadcast(everyone.select(F.col("conv_id").alias("parent_conv_id"))))
    rest = node.where("depth > 1").join(parent, ["p1", "p2"])
    out = first.select(top.columns).unionByName(rest.select(top.columns)).unionByName(top)

    ends = rows.where("last").select(*key, "conv").unionByName(convs.where("n = 0").select(*root, "conv"))
    sha = ends_digest(ends, ends.groupBy(key).agg(F.count("*").alias("ends")))
    out = out.join(sha, key, "left").withColumn("ends_sha256", F.coalesce("sha", F.sha2(F.lit("").cast("binary"), 256)))
    unstage(own)
    return out.drop("k1", "k2", "sha")
