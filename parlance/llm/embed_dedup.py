"""Embedding near-duplicates on a robust-pruned flat graph.

Equal vectors are collapsed to nodes. Nodes are dealt to overlapping cluster shards: pivots are a
bounded sample, a node goes to the shard of its nearest pivot and to at most ``OVERLAP`` - 1 others
whose cosine is within ``MARGIN`` of it, so the copies per node don't grow with the table. A shard of
more than ``CAP`` nodes is split again by pivots of its own until none is larger. Pivots are twice the
range apart; a large shard without two such pivots, or one that a split doesn't make smaller, is worked
through in pairs of blocks. Each shard builds a graph: nodes are inserted in batches in a random order;
the nodes that a greedy search from the medoid opens, and the nearest of the same batch, are
robust-pruned to ``DEGREE`` neighbours; links go both ways. The adjacency lists of a node in all its
shards are united. Every node then searches from the medoid: greedy with a beam, then expanding through
all nodes within ``SLACK`` of the range. All nodes of a shard search at once, as array operations.

Links that the searches and the united lists give are joined to components over all shards. The
vectors of each component are then verified against each other in double precision, in blocks, so a
link counts once whatever shards its ends are in. In a component of more than ``CORE`` nodes, the nodes
within half the range's angle of a centre are linked with each other for certain (angles obey the
triangle inequality) and are only counted; the others are compared with all.

Recall is audited against brute force for a bounded set of query nodes over all nodes, half of them
nodes that have links; below ``RECALL`` the search runs again with twice the beam and more overlap.
If the third try stays below ``LEAST_RECALL`` too, an error is raised.

Defined results
    Vectors that are null, empty, zero or hold null or non-finite components: no links, their own
    component. Only vectors of equal length link. n_links counts rows: equal vectors link with each
    other. null vec_id: counted as a link of others, never names a component; its own kept is false.
    Repeated rows: each counts. Extra columns are never read. Empty table: empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged, unstage
from .components import components

COSINE = 0.95
#: Shards of a node, how much farther than the nearest pivot the others may be, nodes of a shard at most.
OVERLAP, MARGIN, CAP = 3, 0.12, 2400
#: Nodes for each first pivot, first pivots at most, pivots for the split of a large shard at most.
PER_SHARD, FIRST_PIVOTS, MORE_PIVOTS = 400, 1024, 64
#: Rows of a chunk in which a large shard is dealt out, and nodes of a block in which components are verified.
CHUNK, BLOCK = 8000, 1000
#: Nodes from which on a component's certain links are counted and not compared.
CORE = 2000
DEGREE, ALPHA, BEAM, SLACK = 20, 1.2, 24, 0.08
AUDIT, RECALL, LEAST_RECALL = 256, 0.97, 0.9
#: Nodes opened in one step of a search, and nodes inserted in one batch.
STEP, BATCH = 4, 128


def valid(v: Column) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    ok = (F.size(v) > 0) & F.forall(v, finite) & F.exists(v, lambda x: x != 0)
    return F.coalesce(ok, F.lit(False))


def matrix(col: pd.Series) -> np.ndarray:
    """Unit rows in double precision; scaled by the largest component first, so squares neither overflow nor vanish."""
    x = np.array([np.asarray(v, dtype=np.float64) for v in col])
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def robust_prune(x: np.ndarray, rows: np.ndarray, near: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """The neighbours of each of ``rows`` out of its line of ``near`` (-1: none), padded with -1.

    The nearest candidate stays and drops those that are much nearer to it than to the node.
    """
    some = x[near]
    far = 1 - np.einsum("ijk,ik->ij", some, x[rows])
    far[(near < 0) | (near == rows[:, None])] = np.inf
    out = np.full((len(rows), degree), -1)
    at = np.arange(len(rows))
    for k in range(degree):
        best = far.argmin(1)
        ok = np.isfinite(far[at, best])
        if not ok.any():
            break
        node = near[at, best]
        out[ok, k] = node[ok]
        far[alpha * (1 - np.einsum("ijk,ik->ij", some, x[node])) <= far] = np.inf
        far[near == node[:, None]] = np.inf
    return out


def padded(lists: list[np.ndarray], width: int = 1) -> np.ndarray:
    """Lists as rows of one array, padded with -1."""
    out = np.full((len(lists), max([width, *map(len, lists)])), -1)
    for i, a in enumerate(lists):
        out[i, : len(a)] = a
    return out


def _rows(r: np.ndarray, n: int, *values: tuple[np.ndarray, float]) -> list[np.ndarray]:
    """Values dealt to rows r (ascending) of n, each as an array padded with the value beside it."""
    count = np.bincount(r, minlength=n)
    slot = np.arange(len(r)) - np.repeat(np.cumsum(count) - count, count)
    out = []
    for v, pad in values:
        a = np.full((n, int(count.max(initial=0))), pad, dtype=v.dtype)
        a[r, slot] = v
        out.append(a)
    return out


def greedy(x: np.ndarray, adjacency: np.ndarray, q: np.ndarray, start: int, beam: int, low: float = 2.0):
    """Best-first searches from ``start`` for all nodes q at once.

    Returns the opened nodes of each query (padded with -1), what each has seen (query x node), and the
    pairs (place in q, node, cosine) of at least ``low``.
    """
    n, m = len(q), len(x)
    pool, cos, todo = np.full((n, beam), -1), np.full((n, beam), -np.inf, x.dtype), np.zeros((n, beam), bool)
    pool[:, 0], cos[:, 0], todo[:, 0] = start, x[q] @ x[start], True
    seen = np.zeros((n, m), bool)
    seen[:, start] = True
    opened, live = [], np.arange(n)
    first = np.flatnonzero(cos[:, 0] >= low)
    near = [(first, pool[first, 0], cos[first, 0])]
    while len(live):
        own = live[:, None]
        pick = np.argpartition(-np.where(todo[live], cos[live], -np.inf), STEP, axis=1)[:, :STEP]
        node = np.where(todo[own, pick], pool[own, pick], -1)
        todo[own, pick] = False
        opened.append(np.full((n, STEP), -1))
        opened[-1][live] = node
        to = np.where(node[:, :, None] >= 0, adjacency[node], -1).reshape(len(live), -1)
        r, k = np.nonzero(to >= 0)
        v = to[r, k]
        new = ~seen[live[r], v]
        code = np.unique(r[new] * m + v[new])
        r, v = code // m, code % m
        if len(r):
            seen[live[r], v] = True
            c = np.einsum("ij,ij->i", x[q[live[r]]], x[v])
            hit = c >= low
            near.append((live[r[hit]], v[hit], c[hit]))
            more, more_c = _rows(r, len(live), (v, -1), (c, -np.inf))
            every = np.concatenate([cos[live], more_c], 1)
            top = np.argpartition(-every, beam - 1, axis=1)[:, :beam]
            cos[live] = np.take_along_axis(every, top, 1)
            todo[live] = np.take_along_axis(np.concatenate([todo[live], more >= 0], 1), top, 1)
            pool[live] = np.take_along_axis(np.concatenate([pool[live], more], 1), top, 1)
        live = live[todo[live].any(1)]
    return np.concatenate(opened, 1), seen, [np.concatenate(c) for c in zip(*near)]


def _link_back(x: np.ndarray, adjacency: np.ndarray, v: np.ndarray, p: np.ndarray, degree: int, alpha: float) -> None:
    """Adds p to the neighbours of v; lists that get too long are pruned."""
    order = np.argsort(v, kind="stable")
    at, r = np.unique(v[order], return_inverse=True)
    (new,) = _rows(r, len(at), (p[order], -1))
    new = np.where((new[:, :, None] == adjacency[at][:, None, :]).any(2), -1, new)
    every = np.concatenate([adjacency[at], new], 1)
    fits = (every >= 0).sum(1) <= adjacency.shape[1]
    order = np.argsort(every < 0, axis=1, kind="stable")[:, : adjacency.shape[1]]
    adjacency[at[fits]] = np.take_along_axis(every, order, 1)[fits]
    if not fits.all():
        adjacency[at[~fits]] = -1
        adjacency[at[~fits], :degree] = robust_prune(x, at[~fits], every[~fits], degree, alpha)


def medoid(x: np.ndarray) -> int:
    return int(np.argmax(x @ x.mean(0)))


def build(x: np.ndarray, beam: int = BEAM, degree: int = DEGREE, alpha: float = ALPHA) -> tuple[int, list[np.ndarray]]:
    """Medoid and adjacency lists of a robust-pruned graph over the rows of x, inserted in batches in a random order."""
    x = x.astype(np.float32)
    start = medoid(x)
    adjacency = np.full((len(x), 2 * degree), -1)
    order = np.random.default_rng(len(x)).permutation(len(x))
    order, at = order[order != start], 0
    while at < len(order):
        b = order[at : at + min(BATCH, max(at, 16))]
        opened, *_ = greedy(x, adjacency, b, start, beam)
        # nodes of one batch don't find each other by search
        same = x[b] @ x[b].T
        np.fill_diagonal(same, -np.inf)
        mates = b[np.argsort(-same, axis=1)[:, : min(8, len(b) - 1)]]
        adjacency[b, :degree] = robust_prune(x, b, np.concatenate([opened, mates], 1), degree, alpha)
        r, k = np.nonzero(adjacency[b, :degree] >= 0)
        _link_back(x, adjacency, adjacency[b[r], k], b[r], degree, alpha)
        at += len(b)
    return start, [a[a >= 0] for a in adjacency]


def search(x: np.ndarray, adjacency: np.ndarray, q: np.ndarray, start: int, least: float, beam: int, slack: float = SLACK) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (place in q, node) with a cosine of at least ``least``: greedy from ``start``, then through all nodes near the range."""
    small = x.astype(np.float32)
    _, seen, (a, b, c) = greedy(small, adjacency, q, start, beam, least - slack)
    found = [(a, b, c)]
    while len(a):
        # one step from all near nodes of all queries that have some
        rows, r = np.unique(a, return_inverse=True)
        cols, k = np.unique(b, return_inverse=True)
        edge, step = np.zeros((len(rows), len(cols)), np.float32), np.zeros((len(cols), len(x)), np.float32)
        edge[r, k] = 1
        i, j = np.nonzero(adjacency[cols] >= 0)
        step[i, adjacency[cols][i, j]] = 1
        i, b = np.nonzero((edge @ step > 0) & ~seen[rows])
        a = rows[i]
        seen[a, b] = True
        c = _cosines(small, q[a], b)
        near = c >= least - slack
        a, b, c = a[near], b[near], c[near]
        found.append((a, b, c))
    a, b, c = (np.concatenate(y) for y in zip(*found))
    near = (c >= least - 1e-3) & (q[a] != b)
    a, b = a[near], b[near]
    ok = _cosines(x, q[a], b) >= least
    return a[ok], b[ok]


def _cosines(x: np.ndarray, a: np.ndarray, b: np.ndarray, rows: int = 1 << 16) -> np.ndarray:
    parts = [np.einsum("ij,ij->i", x[a[i : i + rows]], x[b[i : i + rows]]) for i in range(0, len(a), rows)]
    return np.concatenate(parts) if parts else np.empty(0, x.dtype)


def range_search(x: np.ndarray, adjacency: list[np.ndarray], q: int, start: int, least: float, beam: int, slack: float = SLACK) -> np.ndarray:
    """Nodes with a cosine of at least ``least`` to node q."""
    return np.unique(search(x, padded(adjacency), np.array([q]), start, least, beam, slack)[1])


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest row that each of n rows reaches over the pairs (a, b)."""
    root = np.arange(n)
    while len(a):
        low = root.copy()
        x, y = root[a], root[b]
        np.minimum.at(low, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(low, low[low]):
            low = low[low]
        nxt = low[root]
        if np.array_equal(nxt, root):
            break
        root = nxt
    return root


def apart(x: np.ndarray, least: float) -> np.ndarray:
    """Pivots out of x that are twice the range apart, so a group within the range isn't dealt out among pivots of its own."""
    limit = 2 * least * least - 1
    kept: list[int] = []
    for i in range(len(x)):
        if not kept or (x[kept] @ x[i]).max() < limit:
            kept.append(i)
    return x[kept]


def _deal(x: np.ndarray, pivots: np.ndarray, overlap: int, margin: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of x and their pivots: the nearest, and further ones within the margin up to ``overlap`` in all."""
    c = x @ pivots.T
    k = min(overlap, len(pivots))
    top = np.argpartition(-c, k - 1, axis=1)[:, :k] if k < len(pivots) else np.tile(np.arange(k), (len(x), 1))
    best = np.take_along_axis(c, top, 1)
    row, place = np.nonzero(best >= best.max(1, keepdims=True) - margin)
    return row, top[row, place]


def shards(nodes: DataFrame, overlap: int, cap: int, least: float) -> DataFrame:
    """(shard, node, vec, was) with each node in one shard or several; the name of a shard that isn't to be split ends in !."""
    n = nodes.count()
    k = int(np.clip(-(-n // PER_SHARD), 1, FIRST_PIVOTS))
    # pivots: a bounded sample in the order of a hash
    first = nodes.orderBy(F.xxhash64("node"), "node").limit(k).select("vec").toPandas()
    by_dim = {d: apart(matrix(g["vec"]), least) for d, g in first.groupby(first["vec"].map(len))}
    pivots = nodes.sparkSession.sparkContext.broadcast(by_dim)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for d, g in b.groupby(b["vec"].map(len)):
                row, to = _deal(matrix(g["vec"]), pivots.value[d], overlap, MARGIN) if d in pivots.value else (np.arange(len(g)), np.zeros(len(g), int))
                yield g.iloc[row].assign(shard=[f"{d}.{i}" for i in to], was=np.int64(1 << 62))[["shard", "node", "vec", "was"]]

    schema = f"shard string, node bigint, vec {nodes.schema['vec'].dataType.simpleString()}, was bigint"
    rows = staged(nodes.select("node", "vec").mapInPandas(deal, schema), "dealt")
    while True:
        sizes = rows.groupBy("shard").agg(F.count("*").alias("n"), F.max("was").alias("parent"))
        large = staged(sizes.where((F.col("n") > cap) & ~F.endswith("shard", F.lit("!"))), "large")
        if large.isEmpty():
            return rows
        # about MORE_PIVOTS members of each large shard by a hash; none where the last split didn't help
        u = F.pmod(F.xxhash64("node", F.lit(3)), F.lit(1 << 30)) / F.lit(float(1 << 30))
        picked = rows.join(large, "shard").where((u < F.lit(float(MORE_PIVOTS)) / F.col("n")) & (F.col("n") < 0.8 * F.col("parent")))
        picked = picked.groupBy("shard").agg(F.collect_list("vec").alias("pivots"))
        chunk = F.explode(F.sequence(F.lit(0), F.floor(F.col("n") / CHUNK).cast("int")))
        picked = staged(large.join(picked, "shard", "left").select("shard", "pivots", chunk.alias("chunk")), "pivots")
        where = F.pmod(F.xxhash64("node", F.lit(9)), F.floor(F.col("n") / CHUNK) + 1).cast("int")
        open_ = rows.join(large.select("shard", "n"), "shard").withColumn("chunk", where)

        def split(g: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
            if g.empty:
                return g.reindex(columns=["shard", "node", "vec", "was"])
            some = p["pivots"].iloc[0]
            some = apart(matrix(pd.Series(list(some))), least) if some is not None and len(some) else []
            if len(some) < 2:
                return g.assign(shard=g["shard"] + "!")[["shard", "node", "vec", "was"]]
            row, to = _deal(matrix(g["vec"]), some, 2 if len(some) >= 4 else 1, MARGIN)
            g = g.iloc[row]
            return g.assign(shard=[f"{s}.{i}" for s, i in zip(g["shard"], to)], was=g["n"])[["shard", "node", "vec", "was"]]

        parts = open_.groupBy("shard", "chunk").cogroup(picked.groupBy("shard", "chunk")).applyInPandas(split, schema)
        small = rows.join(large.select("shard"), "shard", "left_anti").select("shard", "node", "vec", "was")
        last, rows = rows, staged(small.unionByName(parts), "dealt")
        unstage(last)


def _blocks(rows: DataFrame, cap: int) -> DataFrame:
    """(task, node, vec): shards, those of more than ``cap`` nodes as pairs of blocks."""
    half = max(cap // 2, 1)
    large = rows.groupBy("shard").count().where(F.col("count") > cap).select("shard", F.ceil(F.col("count") / half).cast("int").alias("b"))
    rows = rows.join(large, "shard", "left").withColumn("block", F.pmod(F.xxhash64("node", F.lit(5)), F.coalesce("b", F.lit(1))).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("b"), F.lit(1)) - 1))
    rows = rows.select("shard", "node", "vec", "block", "b", other.alias("with")).where("b is null or b < 2 or block <> with or with = 0")
    # a pair of two blocks also works through each block itself
    low, high = F.least("block", "with"), F.greatest("block", "with")
    high = F.when((F.col("b") > 1) & (low == high), F.lit(1)).otherwise(high)
    return rows.select(F.concat_ws("/", "shard", low.cast("string"), high.cast("string")).alias("task"), "node", "vec").distinct()


def _links(rows: DataFrame, least: float, beam: int) -> DataFrame:
    """Edges (a, b) with the range's cosine: from the united adjacency lists, and from each node to its root in each shard."""

    def graph(g: pd.DataFrame) -> pd.DataFrame:
        node, x = g["node"].to_numpy(), matrix(g["vec"])
        _, adjacency = build(x, beam)
        linked = [node[a[x[a] @ x[i] >= least]] for i, a in enumerate(adjacency)]
        return pd.DataFrame({"node": node, "near": [node[a] for a in adjacency], "linked": linked})

    graphs = rows.groupBy("task").applyInPandas(graph, "node bigint, near array<bigint>, linked array<bigint>")
    # a node is in a bounded number of tasks, each with a bounded degree
    united = graphs.groupBy("node").agg(*[F.array_distinct(F.flatten(F.collect_list(c))).alias(c) for c in ("near", "linked")])
    united = staged(united, "graph")

    def roots(g: pd.DataFrame) -> pd.DataFrame:
        x, node = matrix(g["vec"]), g["node"].to_numpy()
        order = np.argsort(node)
        flat, n = np.concatenate(g["near"].to_list()), g["near"].map(len).to_numpy()
        place = np.minimum(np.searchsorted(node[order], flat), len(node) - 1)
        here = node[order][place] == flat
        owner = np.repeat(np.arange(len(node)), n)[here]
        (adjacency,) = _rows(owner, len(node), (order[place[here]], -1))
        if not adjacency.shape[1]:
            return pd.DataFrame({"a": [], "b": []})
        a, b = search(x, adjacency, np.arange(len(x)), medoid(x), least, beam)
        root = _forest(a, b, len(x))
        some = root != np.arange(len(x))
        return pd.DataFrame({"a": node[some], "b": node[root[some]]})

    found = rows.join(united.select("node", "near"), "node").groupBy("task").applyInPandas(roots, "a bigint, b bigint")
    return found.unionByName(united.select(F.col("node").alias("a"), F.explode("linked").alias("b")))


def _verified(nodes: DataFrame, comp: DataFrame, least: float) -> DataFrame:
    """(node, links) of the nodes of components: the rows of other nodes of the component within the range."""
    comp = staged(comp, "comp")
    sizes = staged(comp.groupBy("component").agg(F.count("*").alias("n")), "sizes")
    rows = comp.join(sizes, "component").join(nodes.select("node", "vec", "mult"), "node")
    rows = staged(rows.select("component", "n", "node", "vec", "mult"), "members")
    small = rows.where(F.col("n") <= CORE)
    groups = max(1, small.count() // CORE)

    def whole(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("component", kind="stable")
        vec, mult, links = g["vec"], g["mult"].to_numpy(), np.zeros(len(g), np.int64)
        edge = np.flatnonzero(np.diff(g["component"].to_numpy(), prepend=np.int64(-1), append=np.int64(-1)))
        for lo, hi in zip(edge, edge[1:]):
            x = matrix(vec.iloc[lo:hi])
            links[lo:hi] = (x @ x.T >= least) @ mult[lo:hi] - mult[lo:hi]
        return pd.DataFrame({"node": g["node"], "links": links})

    schema = "node bigint, links bigint"
    some = small.withColumn("group", F.pmod(F.xxhash64("component"), F.lit(groups)))
    out = some.groupBy("group").applyInPandas(whole, schema)
    large = rows.where(F.col("n") > CORE)
    if sizes.where(F.col("n") > CORE).isEmpty():
        return out
    # the centre is a member by hash; it is compared with the others in chunks
    last = F.floor(F.col("n") / CHUNK).cast("int")
    centre = large.groupBy("component", "n").agg(F.min_by("vec", F.xxhash64("node", F.lit(11))).alias("centre"))
    centre = staged(centre.select("component", "centre", F.explode(F.sequence(F.lit(0), last)).alias("chunk")), "centres")
    limit = float(np.cos(np.arccos(least) / 2 * (1 - 1e-9)))

    def near(g: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        core = matrix(g["vec"]) @ matrix(c["centre"])[0] >= limit if len(g) else []
        return g.assign(core=core)[["component", "node", "vec", "mult", "core"]]

    chunked = large.withColumn("chunk", F.pmod(F.xxhash64("node", F.lit(9)), last + 1).cast("int"))
    kind = nodes.schema["vec"].dataType.simpleString()
    cored = chunked.groupBy("component", "chunk").cogroup(centre.groupBy("component", "chunk"))
    cored = staged(cored.applyInPandas(near, f"component bigint, node bigint, vec {kind}, mult bigint, core boolean"), "cored")
    mass = cored.groupBy("component").agg(F.sum(F.when(F.col("core"), F.col("mult"))).alias("mass"), F.count("*").alias("all"), F.count(F.when(~F.col("core"), 1)).alias("others"))
    mass = staged(mass, "mass")
    out = out.unionByName(cored.where("core").join(mass, "component").select("node", (F.col("mass") - F.col("mult")).alias("links")))
    # nodes outside the core against all, in blocks
    blocks = lambda c: F.greatest(F.ceil(F.col(c) / BLOCK).cast("int"), F.lit(1))
    dealt = cored.join(mass, "component").withColumns({"bq": blocks("others"), "bv": blocks("all")})
    q = dealt.where("not core").withColumns({"i": F.pmod(F.xxhash64("node", F.lit(5)), "bq").cast("int"), "j": F.explode(F.sequence(F.lit(0), F.col("bv") - 1))})
    v = dealt.where("others > 0").withColumns({"j": F.pmod(F.xxhash64("node", F.lit(6)), "bv").cast("int"), "i": F.explode(F.sequence(F.lit(0), F.col("bq") - 1))})

    def across(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"node": [], "links": []})
        near = (matrix(a["vec"]) @ matrix(b["vec"]).T >= least) & (a["node"].to_numpy()[:, None] != b["node"].to_numpy()[None, :])
        core = b["core"].to_numpy()
        links = np.concatenate([near @ b["mult"].to_numpy(), (near.T @ a["mult"].to_numpy())[core]])
        return pd.DataFrame({"node": np.concatenate([a["node"].to_numpy(), b["node"].to_numpy()[core]]), "links": links.astype(np.int64)})

    pick = [F.col(c).alias(c) for c in ("component", "i", "j", "node", "vec", "mult", "core")]
    more = q.select(pick).groupBy("component", "i", "j").cogroup(v.select(pick).groupBy("component", "i", "j")).applyInPandas(across, schema)
    return out.unionByName(more)


def _audit(nodes: DataFrame, links: DataFrame, least: float) -> float:
    """Mean share of its links that the search has found over up to AUDIT query nodes, half of them with links, by brute force over all nodes."""
    by_hash = lambda df: df.orderBy(F.xxhash64("node", F.lit(7)), "node").limit(AUDIT // 2)
    some = by_hash(nodes.select("node")).unionByName(by_hash(links.where("links > 0").select("node"))).distinct()
    some = nodes.join(F.broadcast(some), "node").select("node", "vec").toPandas()  # AUDIT rows at most
    queries = nodes.sparkSession.sparkContext.broadcast(some)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for d, g in b.groupby(b["vec"].map(len)):
                q = queries.value[queries.value["vec"].map(len) == d]
                if len(q):
                    near = matrix(q["vec"]) @ matrix(g["vec"]).T >= least
                    near &= q["node"].to_numpy()[:, None] != g["node"].to_numpy()[None, :]
                    yield pd.DataFrame({"node": q["node"].to_numpy(), "there": near @ g["mult"].to_numpy()})

    there = nodes.select("node", "vec", "mult").mapInPandas(count, "node bigint, there bigint").groupBy("node").agg(F.sum("there").alias("there"))
    got = there.where("there > 0").join(links, "node", "left").agg(F.avg(F.coalesce("links", F.lit(0)) / F.col("there")).alias("share")).first()
    return 1.0 if got.share is None else got.share


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vec_col: str = "embedding", cap: int = CAP, recall: float = RECALL) -> DataFrame:
    """A row per vector: vec_id, n_links, component_id, kept."""
    kind = "array<float>" if vectors.schema[vec_col].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vec_col).cast(kind).alias("vec"))
    # the digest of a vector's text form stands for it in joins
    digest = F.when(valid(F.col("vec")), F.unhex(F.sha2(F.to_json(F.struct("vec")), 256)))
    rows = rows.select("vec_id", "vec", digest.alias("digest"))
    good = rows.where("digest is not null")
    nodes = good.groupBy("digest").agg(F.first("vec").alias("vec"), F.min("vec_id").alias("rep"), F.count("*").alias("mult"))
    nodes = staged(nodes.select(F.monotonically_increasing_id().alias("node"), "*"), "nodes")
    beam, overlap, audited = BEAM, OVERLAP, []
    for _ in range(3):
        parts = staged(_blocks(shards(nodes, overlap, cap, cosine), cap), "parts")
        comp = staged(components(_links(parts, cosine, beam)), "components")
        unstage(parts)
        links = staged(_verified(nodes, comp, cosine).groupBy("node").agg(F.sum("links").alias("links")), "links")
        audited.append(_audit(nodes, links, cosine))
        if audited[-1] >= recall:
            break
        beam, overlap = 2 * beam, overlap + 2
    if audited[-1] < LEAST_RECALL:
        raise RuntimeError(f"audited recall {audited} is under {LEAST_RECALL}")
    named = nodes.join(links, "node", "left").join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = staged(named.select("digest", "rep", "component", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links")), "named")
    least = staged(named.groupBy("component").agg(F.min("rep").alias("component_id")), "components")
    named = staged(named.join(least, "component").select("digest", "n_links", "component_id"), "answers")
    out = good.select("vec_id", "digest").join(named, "digest").select("vec_id", "n_links", "component_id")
    rest = rows.where("digest is null").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = out.unionByName(rest)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
