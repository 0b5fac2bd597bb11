"""Product codes of vectors by dual-tree Lloyd rounds in whole numbers.

Each component x becomes floor(scale * x), and a vector is cut into equal parts with a codebook each.
Rows are packed into blocks; a block has one tree per part position: points are halved level by level
along the widest side, and each node keeps its bounding box, its count and its sum. The entries of a
codebook form a tree of the same kind. Both are traversed together: a pair of nodes is dropped if its
least distance is larger than the greatest distance to another entry node. A point node left with one
entry is assigned whole by its cached sum; the points of leaves that stay uncertain are compared with
what is left in whole numbers, ties to the lower index. Bounds are whole numbers too, so codes are exact.

A round sends sums and counts of at most parts x entries from each task; the new codebooks, whose size
doesn't depend on the data, go out with the next round's tasks.

Defined results
    Vectors that are null or hold null or non-finite components: left out. Vectors whose length isn't
    that of the first row in the order of vec_id (then of the vector), or no positive multiple of the parts: code,
    error and label_error are null and they don't count. null vec_id: coded like others, after all
    others in the order of ids. Repeated rows and equal entries: each counts, the lower index wins.
    Fewer rows than entries: a smaller codebook. Components of any size: whole numbers of any length are
    used where 64 bits could overflow; an error sum beyond 64 bits fails. Empty table: empty result. Extra columns are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import staged, unstage

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Vectors of a block, and points of a tree's leaf.
BLOCK, LEAF = 2048, 16


def small(top: float, dims: int, n: int) -> bool:
    """Whether squared distances and sums of components up to ``top`` stay far below 2^63."""
    return bool(np.isfinite(top)) and 4.0 * top * top * max(dims, 1) < 2.0**61 and top * n < 2.0**61


def whole(vectors: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x): 64-bit numbers where distances can't overflow, Python's own elsewhere."""
    with np.errstate(over="ignore"):
        x = np.floor(vectors * scale)
    if scale & (scale - 1) == 0 and small(np.abs(x).max(initial=0), x.shape[1], len(x)):
        return x.astype(np.int64)
    exact = [[Fraction(v) * scale // 1 for v in row] for row in vectors.tolist()]
    return np.array(exact, dtype=object).reshape(vectors.shape)


def packed(x: np.ndarray) -> bytes:
    """Whole numbers as text, or in the fewest bytes behind the size of one."""
    if x.dtype == object:
        return b"," + ",".join(map(str, x.ravel())).encode()
    size = next(t for t in ("<i2", "<i4", "<i8") if np.abs(x).max(initial=0) < np.iinfo(t).max)
    return size[-1].encode() + x.astype(size).tobytes()


def unpacked(b: bytes, dims: int) -> np.ndarray:
    if b[:1] == b",":
        return np.array([int(v) for v in b[1:].split(b",")], dtype=object).reshape(-1, dims)
    return np.frombuffer(b, f"<i{b[:1].decode()}", offset=1).astype(np.int64).reshape(-1, dims)


def levels(n: int, leaf: int) -> list[np.ndarray]:
    """Borders of the nodes of each level when n points are halved until no node has more than ``leaf``."""
    cuts = [np.array([0, n])]
    while np.diff(cuts[-1]).max() > leaf:
        c = cuts[-1]
        cuts.append(np.sort(np.concatenate([c, (c[:-1] + c[1:]) // 2])))
    return cuts


def halved(points: np.ndarray, leaf: int) -> np.ndarray:
    """The order of points in a tree whose nodes are halved along their widest side."""
    order = np.arange(len(points))
    for c in levels(len(points), leaf)[:-1]:
        for a, b in zip(c[:-1], c[1:]):
            part = points[order[a:b]]
            side = int(np.argmax(part.max(0) - part.min(0)))
            order[a:b] = order[a:b][np.argsort(part[:, side], kind="stable")]
    return order


class Tree:
    """Points in tree order with the box, sum and count of each node; level k has 2^k nodes."""

    def __init__(self, points: np.ndarray, leaf: int):
        self.points, self.cuts = points, levels(len(points), leaf)
        self.depth = len(self.cuts) - 1
        total = np.concatenate([np.zeros((1, points.shape[1]), points.dtype), np.cumsum(points, 0)])
        self.low = [np.minimum.reduceat(points, c[:-1], 0) for c in self.cuts]
        self.high = [np.maximum.reduceat(points, c[:-1], 0) for c in self.cuts]
        self.sum = [total[c[1:]] - total[c[:-1]] for c in self.cuts]
        self.count = [np.diff(c) for c in self.cuts]


def assign(points: np.ndarray, book: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums and counts of each entry, and the nearest entry of each point; points are in tree order."""
    if points.dtype != book.dtype:
        points, book = points.astype(object), book.astype(object)
    k, dims = book.shape
    wide = 1 << (k - 1).bit_length()
    book = np.concatenate([book, np.repeat(book[-1:], wide - k, 0)])  # copies of the last entry never win a tie
    name = halved(book, 1)
    tree, entries = Tree(points, leaf), Tree(book[name], 1)
    sums, counts, code = np.zeros((wide, dims), book.dtype), np.zeros(wide, np.int64), np.empty(len(points), np.int64)
    node, allowed = np.array([0]), np.ones((1, 1), bool)  # live nodes of a level, and the entry nodes left to each
    level = at = 0
    while len(node):
        p, e = np.nonzero(allowed)
        low, high, elow, ehigh = tree.low[level][node[p]], tree.high[level][node[p]], entries.low[at][e], entries.high[at][e]
        gap, reach = np.maximum(np.maximum(elow - high, low - ehigh), 0), np.maximum(ehigh - low, high - elow)
        least, most = (gap * gap).sum(1), (reach * reach).sum(1)
        best = np.minimum.reduceat(most, np.searchsorted(p, np.arange(len(node))))
        far = least > best[p]
        allowed[p[far], e[far]] = False
        if at == entries.depth:
            sure = allowed.sum(1) == 1
            who = name[allowed[sure].argmax(1)]
            np.add.at(sums, who, tree.sum[level][node[sure]])
            np.add.at(counts, who, tree.count[level][node[sure]])
            for n, c in zip(node[sure], who):
                code[tree.cuts[level][n] : tree.cuts[level][n + 1]] = c
            node, allowed = node[~sure], allowed[~sure]
        if at == entries.depth and level == tree.depth:
            break
        if at < entries.depth:
            at, allowed = at + 1, np.repeat(allowed, 2, axis=1)
        if level < tree.depth:
            level, node, allowed = level + 1, np.stack([2 * node, 2 * node + 1], 1).ravel(), np.repeat(allowed, 2, axis=0)
    for i, n in enumerate(node):  # leaves that stay uncertain
        a, b = tree.cuts[level][n], tree.cuts[level][n + 1]
        left = np.sort(name[allowed[i]])
        d = points[a:b, None, :] - book[None, left, :]
        c = left[np.argmin((d * d).sum(2), axis=1)]
        np.add.at(sums, c, points[a:b])
        np.add.at(counts, c, 1)
        code[a:b] = c
    return sums[:k], counts[:k], code


def _blocks(batches: Iterator[pa.RecordBatch], label: pa.DataType, scale: int, parts: int, size: int) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("ids", pa.list_(pa.int64())), ("labels", pa.list_(label)), ("orders", pa.list_(pa.binary())), ("points", pa.list_(pa.binary()))])
    held, n = [], 0

    def block(table: pa.Table) -> pa.RecordBatch:
        x = whole(np.array(table["_vector"].to_pylist(), dtype=np.float64), scale)
        cut = np.split(x, parts, axis=1)
        orders = [halved(c, LEAF) for c in cut]
        values = [[table["_id"].to_pylist()], [table["_label"].to_pylist()], [[packed(o) for o in orders]], [[packed(c[o]) for c, o in zip(cut, orders)]]]
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, schema)], schema=schema)

    for b in batches:
        if b.num_rows:
            held.append(b)
            n += b.num_rows
        while n >= size:
            table = pa.Table.from_batches(held)
            yield block(table.slice(0, size))
            held, n = table.slice(size).to_batches(), n - size
    if n:
        yield block(pa.Table.from_batches(held))


SUMS = pa.schema([("part", pa.int32()), ("counts", pa.list_(pa.int64())), ("sums", pa.list_(pa.string()))])
SUMS_DDL = "part int, counts array<long>, sums array<string>"


def _rows_of(totals: dict[int, tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    rows = [{"part": p, "counts": c.tolist(), "sums": [str(v) for v in s.ravel()]} for p, (s, c) in totals.items()]
    return pa.RecordBatch.from_pylist(rows, schema=SUMS)


def _round(batches: Iterator[pa.RecordBatch], books: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    totals: dict[int, tuple] = {}
    for batch in batches:
        for blob in batch.column("points"):
            for p, b in enumerate(blob.as_py()):
                s, c, _ = assign(unpacked(b, books[p].shape[1]), books[p])
                s0, c0 = totals.get(p, (0, 0))
                totals[p] = (s.astype(object) + s0, c + c0)
    yield _rows_of(totals)


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[int, tuple] = {}
    for batch in batches:
        for r in batch.to_pylist():
            s0, c0 = totals.get(r["part"], (0, 0))
            totals[r["part"]] = (np.array([int(v) for v in r["sums"]], dtype=object) + s0, np.array(r["counts"]) + c0)
    yield _rows_of(totals)


def _codes(batches: Iterator[pa.RecordBatch], books: list[np.ndarray], label: pa.DataType) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("vec_id", pa.int64()), ("_label", label), ("code", pa.string()), ("error", pa.int64())])
    for batch in batches:
        for row in batch.to_pylist():
            n = len(row["ids"])
            code, error = np.empty((n, len(books)), np.int64), np.zeros(n, object)
            for p, (order, blob) in enumerate(zip(row["orders"], row["points"])):
                points, order, book = unpacked(blob, books[p].shape[1]), unpacked(order, 1)[:, 0], books[p]
                if points.dtype != book.dtype:
                    points, book = points.astype(object), book.astype(object)
                c = assign(points, book)[2]
                d = points - book[c]
                code[order, p] = c
                error[order] += (d * d).sum(1)
            text = ["".join(f"{c:02x}" for c in line) for line in code.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(row["ids"], pa.int64()), pa.array(row["labels"], label), pa.array(text), pa.array([int(v) for v in error], pa.int64())], schema=schema)


def codes(embeddings: DataFrame, vector: str = "embedding", scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of each kept vector."""
    spark = embeddings.sparkSession
    v = F.col("_vector")
    finite = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    kept = embeddings.select(F.col("vec_id").cast("long").alias("_id"), F.col("label").alias("_label"), F.col(vector).cast("array<double>").alias("_vector")).where(finite)
    first = [F.col("_id").asc_nulls_last(), v]
    head = kept.orderBy(*first).select(F.size(v).alias("n")).head()
    dims = head.n if head else 0
    fits = (F.size(v) == dims) & (F.lit(dims > 0 and dims % parts == 0))
    label_type = kept.schema["_label"].dataType
    label = to_arrow_type(label_type)
    name = label_type.simpleString()

    blocks = kept.where(fits).mapInArrow(lambda b: _blocks(b, label, scale, parts, BLOCK), f"ids array<long>, labels array<{name}>, orders array<binary>, points array<binary>")
    blocks = staged(blocks, "blocks")
    start = kept.where(fits).orderBy(*first).limit(entries).select(v).collect()  # as many rows as a codebook has entries
    books = np.split(whole(np.array([r[0] for r in start], dtype=np.float64), scale), parts, axis=1) if start else []
    for _ in range(rounds if books else 0):
        now = books
        got = blocks.select("points").mapInArrow(lambda b: _round(b, now), SUMS_DDL).repartition(parts, "part").mapInArrow(_added, SUMS_DDL)
        new = [b.astype(object) for b in books]
        for r in got.collect():  # one row for each part
            sums = np.array([int(x) for x in r.sums], dtype=object).reshape(new[r.part].shape)
            for e, n in enumerate(r.counts):
                if n:
                    new[r.part][e] = sums[e] // n
        books = [b.astype(np.int64) if small(float(np.abs(b).max()), dims, 1) else b for b in new]
    sha = hashlib.sha256(",".join(str(x) for b in books for x in b.ravel()).encode()).hexdigest()
    final = books
    out = blocks.mapInArrow(lambda b: _codes(b, final, label), f"vec_id long, _label {name}, code string, error long")
    out = staged(out, "codes")
    unstage(blocks)
    by_label = out.groupBy("_label").agg(F.sum("error").alias("label_error")).withColumnRenamed("_label", "_group")
    out = out.join(by_label, F.col("_label").eqNullSafe(F.col("_group"))).select("vec_id", "code", "error", "label_error")
    none = kept.where(~fits).select(F.col("_id").alias("vec_id"), *[F.lit(None).cast(t).alias(c) for c, t in (("code", "string"), ("error", "long"), ("label_error", "long"))])
    return out.unionByName(none).withColumn("codebooks_sha256", F.lit(sha))
