"""Near duplicates by DartMinHash signatures, banded joining and exact verification.

Shingles are five consecutive words (runs of letters and digits, lower-cased; a shorter text is one
shingle). Darts are thrown at the plane of weight and rank of every shingle: a hash of the shingle and
of the unit cell draws a Poisson number of darts, their places and their coordinates, so equal
shingles get equal darts in any document. A dart counts if it lies below the shingle's weight; each of
the ``k`` coordinates keeps its earliest dart, which makes an unbiased signature of weighted Jaccard
in time that depends on the shingles plus k log k, not on their product. Ranks are searched up to the
bound at which all coordinates are hit; the rare document with an empty coordinate goes on further.

Documents whose signatures agree in all rows of a band share a bucket. Texts that are equal are
collapsed first. Members of a bucket are verified against the bucket's smallest node, which is linear
in the bucket's size: first in ``FIRST_BANDS`` bands, then in all bands where the two are still in
different components, then against up to ``PIVOT_ROUNDS`` pivots drawn by a hash, again only where
the components differ. At last members of one bucket that are still in different components are
verified against each other inside one join, but of those only pairs that the triangle inequality of
the Jaccard distance leaves open given their distances to the smallest node. In a bucket of many
documents that are alike but under the threshold this last step is quadratic in the bucket. So a bucket of thousands of near
copies isn't expanded to pairs, and no pair is capped away.

With 50 bands of 6 rows a pair of similarity 0.8 misses all bands with probability 2.5e-7.

Defined results
    Similarity is the Jaccard similarity of the shingle sets (``weights="count"``: of the multisets),
    computed exactly on 64-bit shingle hashes. null or wordless text: linked to nothing, its own
    class. null doc_id: its own class, class_id null, kept. Repeated rows: one class; each row of the
    class's smallest doc_id counts as kept in the report, ``keep_one`` returns one of them. Empty
    table: empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, staged
from .components import components, merged
from .exact_dedup import sha256
from .langid import chunks
from .quality import _POWERS, _classes, _mix

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 50, 6
#: Bands whose stars are verified before the others, so the others skip what these have joined.
FIRST_BANDS = 5
#: Rounds in which each bucket with several components gets one more node that all others are verified against.
PIVOT_ROUNDS = 3
_CDF = np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, 16)]))  # of a Poisson number with mean 1
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def shingles(texts: list[str], words: int = WORDS) -> list[np.ndarray]:
    """The 64-bit hashes of the shingles of each text, with repetitions."""
    low = [t.lower() for t in texts]
    codes = np.frombuffer("".join(f"{t} " for t in low).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    is_word = np.concatenate([[False], _classes()[codes] == 1])
    change = np.flatnonzero(is_word[1:] != is_word[:-1])
    start, end = change[::2], change[1::2]
    n_words = np.diff(np.searchsorted(start, np.cumsum([0] + [len(t) + 1 for t in low])))
    if len(start):
        size = end - start
        first = np.concatenate([[0], np.cumsum(size)[:-1]])
        inside = np.repeat(start - first, size) + np.arange(size.sum())
        value = (codes[inside].astype(np.uint64) + np.uint64(1)) * _POWERS[(inside - np.repeat(start, size)) & 4095]
        h = _mix(np.add.reduceat(value, first) + size.astype(np.uint64))
    out, at = [], 0
    for n in n_words.tolist():
        w = h[at : at + n] if n else np.empty(0, np.uint64)
        at += n
        k = min(n, words)
        s = np.zeros(n - k + 1 if n else 0, np.uint64)
        for i in range(k):
            s = _mix(s * _GOLD + w[i : n - k + 1 + i])
        out.append(s)
    return out


def _unit(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(11)).astype(np.float64) * 2.0**-53


def signature(elements: np.ndarray, weights: np.ndarray | None, k: int) -> np.ndarray:
    """The earliest dart of each coordinate for a weighted set (weights None: all 1)."""
    if weights is not None:
        cells = np.ceil(weights).astype(np.int64)
        layer = np.arange(cells.sum()) - np.repeat(np.cumsum(cells) - cells, cells)
        weight = np.repeat(weights, cells)
        elements = _mix(np.repeat(elements, cells) + layer.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        total = weights.sum()
    else:
        total = float(len(elements))
    bound = int(np.ceil(k * (np.log(k) + 4) / total))
    while True:
        rank = np.arange(bound, dtype=np.uint64)
        cell = _mix(elements[:, None] + _mix((rank + np.uint64(1)) * _GOLD)[None, :]).ravel()
        n = np.searchsorted(_CDF, _unit(cell), side="right")
        which = np.repeat(np.arange(len(cell)), n)
        nth = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        dart = _mix(cell[which] + nth.astype(np.uint64) * np.uint64(0xA0761D6478BD642F) + np.uint64(1))
        more = _mix(dart + _GOLD)
        if weights is not None:
            e = which // bound
            below = layer[e] + _unit(_mix(more + _GOLD)) < weight[e]
            which, dart, more = which[below], dart[below], more[below]
        coordinate = (dart >> np.uint64(32)).astype(np.int64) * k >> 32
        late = np.argsort(-(which % bound + _unit(more)), kind="stable")
        out, hit = np.zeros(k, np.uint64), np.zeros(k, bool)
        out[coordinate[late]] = dart[late]  # the earliest is written last
        hit[coordinate] = True
        if hit.all():
            return out
        bound *= 2


def band_keys(elements: np.ndarray, weights: np.ndarray | None, bands: int, rows: int) -> np.ndarray:
    s = signature(elements, weights, bands * rows).reshape(bands, rows)
    key = np.arange(1, bands + 1, dtype=np.uint64) * _GOLD
    for i in range(rows):
        key = _mix(key * _GOLD + s[:, i])
    return key.view(np.int64)


def _sketches(docs: DataFrame, bands: int, rows: int, words: int, weights: str) -> DataFrame:
    """(doc_id, digest, keys) of each document with a word; keys: one bucket per band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digests, texts, done, keys = b["digest"].to_pylist(), b["text"].to_pylist(), {}, []
            for start, some in chunks(texts):
                for i, s in enumerate(shingles(some, words)):
                    d = digests[start + i]
                    if d not in done:
                        e, n = np.unique(s, return_counts=True)
                        w = n.astype(float) if weights == "count" else None
                        done[d] = band_keys(e, w, bands, rows) if len(e) else np.empty(0, np.int64)
                    keys.append(done[d])
            flat = pa.array(np.concatenate(keys) if keys else np.empty(0, np.int64))
            ends = pa.array(np.cumsum([0] + [len(x) for x in keys]), pa.int32())
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["digest"], pa.ListArray.from_arrays(ends, flat)], names=["doc_id", "digest", "keys"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, digest binary, keys array<bigint>").where("size(keys) > 0")


def _shingle_sets(rows: DataFrame, words: int, weights: str) -> DataFrame:
    """(node, set, size): sorted hashes; a repeated shingle of a multiset has a hash for each repetition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = []
            for _, some in chunks(b["text"].to_pylist()):
                for s in shingles(some, words):
                    e, n = np.unique(s, return_counts=True)
                    if weights == "count":
                        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                        e = _mix(np.repeat(e, n) + nth.astype(np.uint64) * _GOLD)
                    sets.append(e.view(np.int64))
            flat = pa.array(np.concatenate(sets) if sets else np.empty(0, np.int64))
            ends = pa.array(np.cumsum([0] + [len(x) for x in sets]), pa.int32())
            yield pa.RecordBatch.from_arrays([b["node"], pa.ListArray.from_arrays(ends, flat)], names=["node", "set"])

    return rows.select("node", "text").mapInArrow(run, "node bigint, set array<bigint>")


def _verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, similarity) of the pairs; the arrays meet in a join that splits a hot node, and stay in the JVM."""
    x = sets.select(F.col("node").alias("a"), F.col("set").alias("x"))
    y = sets.select(F.col("node").alias("b"), F.col("set").alias("y"))
    rows = pairs.join(x, "a").join(y, "b")
    shared = F.size(F.array_intersect("x", "y"))
    rows = rows.select("a", "b", shared.alias("s"), (F.size("x") + F.size("y")).alias("n"))
    return rows.select("a", "b", (F.col("s") / (F.col("n") - F.col("s"))).alias("similarity"))


def _with_component(rows: DataFrame, comp: DataFrame, node: str, out: str) -> DataFrame:
    """The component of a node; a node without links is its own."""
    named = comp.select(F.col("node").alias("_node"), F.col("component").alias(out))
    return rows.join(named, F.col(node) == F.col("_node"), "left").drop("_node").withColumn(out, F.coalesce(out, node))


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, words: int = WORDS, bands: int = BANDS, rows: int = ROWS, weights: str = "set") -> DataFrame:
    """A row per document: doc_id, digest, class_id (the smallest doc_id of its class), kept."""
    docs = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    docs = docs.withColumn("digest", sha256(F.col("text")))
    sketches = staged(_sketches(docs, bands, rows, words, weights), "sketches")
    named = sketches.where("doc_id is not null")
    # one node per distinct text
    nodes = named.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("keys").alias("keys"))
    nodes = staged(nodes.select(F.monotonically_increasing_id().alias("node"), "*"), "nodes")
    members = nodes.select("node", F.posexplode("keys").alias("band", "key"))
    leaders = members.groupBy("key").agg(F.min("node").alias("leader"), F.count("*").alias("n")).where("n > 1")
    leaders = staged(leaders.select("key", "leader"), "leaders")
    members = staged(members.join(leaders, "key"), "members")
    # texts only of nodes that share a bucket
    met = members.select("node").distinct().join(nodes.select("node", "rep", F.col("digest").alias("d")), "node")
    found = docs.join(met, (docs["doc_id"] == met["rep"]) & (docs["digest"] == met["d"])).select("node", "text").dropDuplicates(["node"])
    sets = staged(_shingle_sets(found, words, weights), "sets")

    def verified(pairs: DataFrame, what: str) -> DataFrame:
        return staged(_verify(staged(pairs.distinct(), "pairs"), sets), what)

    star = members.where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b"), "band")
    near = F.col("similarity") >= similarity
    known = verified(star.where(F.col("band") < FIRST_BANDS).select("a", "b"), "first")
    comp = staged(components(known.where(near)), "components")
    apart = _with_component(_with_component(star.where(F.col("band") >= FIRST_BANDS), comp, "a", "ca"), comp, "b", "cb")
    second = verified(apart.where("ca <> cb").select("a", "b"), "second")
    known = known.unionByName(second)

    def with_links(comp: DataFrame, links: DataFrame) -> DataFrame:
        links = staged(_with_component(_with_component(links, comp, "a", "ca"), comp, "b", "cb"), "links")
        return comp if links.isEmpty() else staged(merged(comp, links), "components")

    comp = with_links(comp, second.where(near))
    # buckets that still hold several components
    for turn in range(PIVOT_ROUNDS + 1):
        open_ = _with_component(members, comp, "node", "component")
        pivot = F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("h"), "node", "component")).alias("p")
        mixed = open_.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n"), pivot).where("lo < hi and n > 2")
        mixed = staged(mixed.select("key", F.col("p.node").alias("pivot"), F.col("p.component").alias("pc")), "mixed")
        open_ = staged(open_.join(mixed, "key"), "open")
        if turn == PIVOT_ROUNDS or mixed.isEmpty():
            break
        new = open_.where("component <> pc").select(F.least("pivot", "node").alias("a"), F.greatest("pivot", "node").alias("b"))
        new = verified(new.join(known, ["a", "b"], "left_anti"), "pivots")
        known, comp = known.unionByName(new), with_links(comp, new.where(near))
        members = open_.select("node", "band", "key", "leader")
    # what is left: members of one bucket in different components, which their common leader leaves open
    open_ = open_.where("node <> leader")
    open_pairs = open_.select(F.col("leader").alias("a"), F.col("node").alias("b"))
    third = verified(open_pairs.join(known, ["a", "b"], "left_anti"), "third")
    known = known.unionByName(third)
    far = known.groupBy(F.col("a").alias("leader"), F.col("b").alias("node")).agg((1 - F.max("similarity")).alias("far"))
    open_ = open_.join(far, ["leader", "node"]).join(sets, "node").join(nodes.select("node", "keys"), "node")
    open_ = staged(open_.select("key", "band", "node", "component", "far", "set", "keys"), "open")
    other = open_.select("key", *[F.col(c).alias(f"{c}_b") for c in ("node", "component", "far", "set", "keys")])
    # verified in the join itself, so only links leave it; a pair is looked at in the first band that it shares
    reach = F.abs(F.col("far") - F.col("far_b")) <= 1 - similarity + 1e-9
    earlier = F.arrays_overlap(F.slice("keys", F.lit(1), F.col("band")), F.slice("keys_b", F.lit(1), F.col("band")))
    shared, both = F.size(F.array_intersect("set", "set_b")), F.size("set") + F.size("set_b")
    linked = (open_["key"] == other["key"]) & (F.col("node") < F.col("node_b")) & (F.col("component") != F.col("component_b")) & reach & ~earlier
    more = open_.join(other, linked & (shared / (both - shared) >= similarity))
    more = staged(more.select(F.col("node").alias("a"), F.col("node_b").alias("b")), "more")
    comp = with_links(comp, third.where(near).select("a", "b").unionByName(more))
    classes = nodes.select("node", "rep", "digest").join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = staged(classes.groupBy("component").agg(F.min("rep").alias("class_id")), "classes")
    classes = staged(classes.join(least, "component").select("digest", "class_id"), "named")
    out = docs.select("doc_id", "digest").join(classes, "digest", "left")
    wordless = F.col("class_id").isNull()
    out = out.withColumn("class_id", F.when(F.col("doc_id").isNull() | wordless, F.col("doc_id")).otherwise(F.col("class_id")))
    return out.select("doc_id", "digest", "class_id", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` with one document of each class, all columns as they were."""
    d, i = fresh(docs, "_digest"), fresh(docs, "_id")
    kept = near_duplicates(docs.select("doc_id", "text"), **options).where("kept").select(F.col("digest").alias(d), F.col("doc_id").alias(i)).distinct()
    rows = docs.withColumn(d, sha256(F.coalesce(F.col("text"), F.lit("")))).withColumn(i, F.col("doc_id"))
    rows = rows.join(kept, (rows[d] == kept[d]) & rows[i].eqNullSafe(kept[i]), "left_semi")
    named = rows.where(F.col(i).isNotNull()).dropDuplicates([d, i])
    return named.unionByName(rows.where(F.col(i).isNull())).drop(d, i)
