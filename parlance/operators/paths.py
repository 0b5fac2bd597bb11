"""Paths, betweenness, PageRank and spanning forests of many graphs at once, as rounds of joins over edge rows.

All tables are keyed by the graph's columns. A round joins only what changed in the round before, and its
result is checkpointed, so plans stay short and lost executors are survived.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut

#: Two ways are equally long if their lengths differ by less than this part of the length.
SAME = 1e-9
#: Pointer jumps between two looks at the roots.
JUMPS = 3


def both_ways(pairs: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """(keys, source, target, weight) of undirected pairs a, b."""
    one = pairs.select(*keys, F.col("a").alias("source"), F.col("b").alias("target"), weight)
    return one.unionByName(pairs.select(*keys, F.col("b").alias("source"), F.col("a").alias("target"), weight))


def distances(arcs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, a, b, distance) of all reachable pairs a <> b of directed ``arcs`` (keys, source, target, distance).

    Semi-naive: a round extends only the distances that fell in the round before, so over all rounds
    each (source, node) is joined with its arcs once per improvement. Distances are positive.
    """
    step = cut(arcs.where("source <> target").groupBy(*keys, "source", "target").agg(F.min("distance").alias("_d")))
    known = step.select(*keys, F.col("source").alias("a"), F.col("target").alias("b"), F.col("_d").alias("distance"))
    fell = known
    hop = step.select(*keys, F.col("source").alias("b"), F.col("target").alias("_to"), "_d")
    while True:
        longer = fell.join(hop, [*keys, "b"]).where("a <> _to").groupBy(*keys, "a", F.col("_to").alias("b")).agg(F.min(F.col("distance") + F.col("_d")).alias("_new"))
        # both tables have one row per pair, so an outer join merges them
        both = known.join(longer, [*keys, "a", "b"], "full")
        better = F.coalesce(F.col("_new") < F.col("distance") * (1 - SAME / 1000), F.col("distance").isNull())
        merged = cut(both.select(*keys, "a", "b", F.when(better, F.col("_new")).otherwise(F.col("distance")).alias("distance"), better.alias("_fell")))
        known, fell = merged.drop("_fell"), merged.where("_fell").drop("_fell")
        if fell.isEmpty():
            return known


def betweenness(arcs: DataFrame, nodes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, node, betweenness) of every node: the normalised share of shortest paths that pass through it.

    Brandes' sums from all sources at once. The arcs that lie on shortest paths form a graph without
    cycles per source; the numbers of paths are summed hop by hop from the source (frontier rows: graph,
    source, node, count), then the dependencies hop by hop back. Both stop when no row is left. Undirected
    graphs have both directions in ``arcs``. Graphs of fewer than three nodes have 0.
    """
    arcs = cut(arcs.where("source <> target").groupBy(*keys, "source", "target").agg(F.min("distance").alias("distance")))
    far = distances(arcs, keys)
    starts = nodes.select(*keys, F.col("node").alias("a"), F.col("node").alias("b"), F.lit(0.0).alias("distance"))
    reach = cut(far.unionByName(starts))
    before = reach.select(*keys, "a", F.col("b").alias("source"), F.col("distance").alias("_d"))
    after = reach.select(*keys, "a", F.col("b").alias("target"), F.col("distance").alias("_e"))
    tight = before.join(arcs, [*keys, "source"]).join(after, [*keys, "a", "target"]).where(F.abs(F.col("_d") + F.col("distance") - F.col("_e")) <= SAME * F.col("_e"))
    on = cut(tight.select(*keys, "a", "source", "target"))

    def swept(front: DataFrame, here: str, there: str) -> DataFrame:
        """Sums of values pushed along the arcs from ``here`` to ``there``, over all numbers of hops."""
        total = front
        while True:
            front = cut(front.withColumnRenamed("node", here).join(on, [*keys, "a", here]).groupBy(*keys, "a", F.col(there).alias("node")).agg(F.sum("v").alias("v")))
            if front.isEmpty():
                return total
            total = cut(total.unionByName(front).groupBy(*keys, "a", "node").agg(F.sum("v").alias("v")))

    paths = swept(starts.select(*keys, "a", F.col("b").alias("node"), F.lit(1.0).alias("v")), "source", "target").withColumnRenamed("v", "paths")
    back = swept(paths.select(*keys, "a", "node", (1 / F.col("paths")).alias("v")), "target", "source")
    passed = back.join(paths, [*keys, "a", "node"]).where("a <> node").groupBy(*keys, "node").agg(F.sum(F.col("v") * F.col("paths") - 1).alias("_sum"))
    n = nodes.groupBy(*keys).agg(F.count("*").alias("_n"))
    out = nodes.select(*keys, "node").join(n, keys).join(passed, [*keys, "node"], "left")
    pairs = (F.col("_n") - 1) * (F.col("_n") - 2)
    return out.select(*keys, "node", F.when(F.col("_n") > 2, F.coalesce(F.col("_sum"), F.lit(0.0)) / pairs).otherwise(0.0).alias("betweenness"))


def pagerank(edges: DataFrame, nodes: DataFrame, keys: list[str], weight: str, rounds: int = 60, damping: float = 0.85, every: int = 5, close: float = 1e-10) -> DataFrame:
    """(keys, node, rank) of each graph; the mass of nodes without a way out is spread evenly in their graph.

    Stops after ``rounds`` or, looked at every few rounds, when no rank moves by more than ``close``.
    """
    edges = cut(edges.select(*keys, "source", "target", F.col(weight).alias("_w")))
    out = edges.groupBy(*keys, "source").agg(F.sum("_w").alias("_out"))
    steps = cut(edges.join(out, [*keys, "source"]).select(*keys, "source", "target", (F.col("_w") / F.col("_out")).alias("_p")))
    n = nodes.groupBy(*keys).agg(F.count("*").alias("_n"))
    ends = out.select(*keys, F.col("source").alias("node"), F.lit(True).alias("_leads"))
    nodes = cut(nodes.select(*keys, "node").join(n, keys).join(ends, [*keys, "node"], "left"))
    rank = nodes.withColumn("rank", 1.0 / F.col("_n"))
    done = 0
    while done < rounds:
        first = rank
        for _ in range(min(every, rounds - done)):
            got = rank.withColumnRenamed("node", "source").join(steps, [*keys, "source"]).groupBy(*keys, F.col("target").alias("node")).agg(F.sum(F.col("rank") * F.col("_p")).alias("_in"))
            lost = rank.groupBy(*keys).agg(F.sum(F.when(F.col("_leads"), 0.0).otherwise(F.col("rank"))).alias("_lost"))
            new = nodes.join(got, [*keys, "node"], "left").join(lost, keys)
            value = (1 - damping) / F.col("_n") + damping * (F.coalesce("_in", F.lit(0.0)) + F.col("_lost") / F.col("_n"))
            rank = new.select(*keys, "node", "_n", "_leads", value.alias("rank"))
        rank = cut(rank)
        done += every
        moved = rank.join(first.select(*keys, "node", F.col("rank").alias("_old")), [*keys, "node"]).agg(F.max(F.abs(F.col("rank") - F.col("_old")))).first()[0]
        if moved is None or moved <= close:
            break
    return rank.select(*keys, "node", "rank")


def spanning_forest(edges: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The edges (keys, a, b) of the forest that takes edges in ``order`` (the first is the best), by Borůvka rounds.

    Each round every component picks the best edge that leaves it; the picked edges join the forest and
    the components they link are contracted to their roots by pointer jumps, which halves the number of
    components at least. ``order`` makes the edges of a graph distinct.
    """
    names = [f"_o{i}" for i in range(len(order))]
    live = cut(edges.select(*keys, "a", "b", F.col("a").alias("_x"), F.col("b").alias("_y"), F.struct(*[o.alias(n) for o, n in zip(order, names)]).alias("_at")).where("a <> b"))
    forest = edges.select(*keys, "a", "b").limit(0)
    while not live.isEmpty():
        ends = live.select(*keys, F.col("_x").alias("c"), F.col("_y").alias("p"), "a", "b", "_at").unionByName(live.select(*keys, F.col("_y").alias("c"), F.col("_x").alias("p"), "a", "b", "_at"))
        best = cut(ends.groupBy(*keys, "c").agg(F.min_by(F.struct("p", "a", "b"), "_at").alias("e")).select(*keys, "c", "e.*"))
        forest = forest.unionByName(best.select(*keys, "a", "b").distinct())
        # every component points to the one it picked; of two that picked each other the smaller is a root
        to = best.select(*keys, F.col("c").alias("p"), F.col("p").alias("_pp"))
        name = best.select(*keys, "c", "p").join(to, [*keys, "p"]).select(*keys, "c", F.when((F.col("_pp") == F.col("c")) & (F.col("c") < F.col("p")), F.col("c")).otherwise(F.col("p")).alias("p"))
        while True:
            for _ in range(JUMPS):  # each jump doubles the way to the root that is done
                to = name.select(*keys, F.col("c").alias("p"), F.col("p").alias("_pp"))
                name = name.join(to, [*keys, "p"]).select(*keys, "c", F.col("_pp").alias("p"))
            name = cut(name)
            roots = name.where("c = p").select(*keys, "p")
            if name.join(roots, [*keys, "p"], "left_anti").isEmpty():
                break
        x = name.select(*keys, F.col("c").alias("_x"), F.col("p").alias("_nx"))
        y = name.select(*keys, F.col("c").alias("_y"), F.col("p").alias("_ny"))
        live = cut(live.join(x, [*keys, "_x"]).join(y, [*keys, "_y"]).where("_nx <> _ny").select(*keys, "a", "b", F.col("_nx").alias("_x"), F.col("_ny").alias("_y"), "_at"))
    return forest


def backbone(pairs: DataFrame, keys: list[str], ratio: float) -> DataFrame:
    """Maximum spanning forest and the strongest other edges, up to max(n - 1, ceil(E x ratio)); graphs of two nodes stay as they are.

    Edges are taken from the strongest (weights to 9 digits, ties by names). n counts nodes without a
    positive tie too.
    """
    nodes = pairs.select(*keys, F.col("a").alias("node")).unionByName(pairs.select(*keys, F.col("b").alias("node"))).distinct()
    n = nodes.groupBy(*keys).agg(F.count("*").alias("_n"))
    some = cut(pairs.where("w > 0"))
    strength = F.round("w", 9)
    tree = spanning_forest(some, keys, [-strength, F.col("a"), F.col("b")]).withColumn("_tree", F.lit(True))
    rows = some.join(tree, [*keys, "a", "b"], "left").withColumn("_tree", F.col("_tree").isNotNull())
    count = rows.groupBy(*keys).agg(F.count("*").alias("_e"), F.count_if("_tree").alias("_t")).join(n, keys)
    count = count.withColumn("_left", F.greatest(F.col("_n") - 1, F.ceil(F.col("_e") * ratio)) - F.col("_t"))
    rows = rows.join(count, keys)
    place = F.row_number().over(Window.partitionBy(*keys, "_tree").orderBy(F.desc(strength), "a", "b"))
    return rows.withColumn("_r", place).where((F.col("_n") <= 2) | F.col("_tree") | (F.col("_r") <= F.col("_left"))).select(*keys, "a", "b", "w")
