"""Similarity and directed networks as edge tables keyed by a graph id; many small graphs run at once."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import paths
from .lineage import cut

G = "graph"


def zscores(long: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Column z-scores per graph and concept: sample deviation, 0 becomes 1, null becomes 0."""
    w = Window.partitionBy(*keys, "concept")
    dev = F.stddev_samp(value).over(w)
    z = (F.col(value) - F.avg(value).over(w)) / F.when(F.coalesce(dev, F.lit(0.0)) == 0, 1.0).otherwise(dev)
    return long.withColumn("z", F.coalesce(z, F.lit(0.0)))


def cosine_edges(long: DataFrame, keys: list[str], entity: str, value: str, item: str = "concept") -> DataFrame:
    """Cosine similarity of the entities of each graph over their items; pairs a < b, zero norm gives 0.

    A self join on (graph, item): as many rows as entities squared per item, for graphs of bounded size.
    """
    norm = long.groupBy(*keys, entity).agg(F.sqrt(F.sum(F.col(value) * F.col(value))).alias("_norm"))
    rows = long.join(norm, [*keys, entity]).withColumn("_u", F.when(F.col("_norm") > 0, F.col(value) / F.col("_norm")).otherwise(0.0))
    a = rows.select(*keys, item, F.col(entity).alias("a"), F.col("_u").alias("ua"))
    b = rows.select(*keys, item, F.col(entity).alias("b"), F.col("_u").alias("ub"))
    return a.join(b, [*keys, item]).where("a < b").groupBy(*keys, "a", "b").agg(F.sum(F.col("ua") * F.col("ub")).alias("w"))


def weighted_edges(similar: DataFrame) -> DataFrame:
    """Positive weights with their distance 1 / weight."""
    return similar.where("w > 0").withColumn("distance", 1 / F.col("w"))


def strengths(edges: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """Out, in and total strength of every node of a directed edge table."""
    out = edges.select(*keys, F.col("source").alias("node"), F.col(weight).alias("o"), F.lit(0.0).alias("i"))
    into = edges.select(*keys, F.col("target").alias("node"), F.lit(0.0).alias("o"), F.col(weight).alias("i"))
    both = out.unionByName(into).groupBy(*keys, "node").agg(F.sum("o").alias("out_strength"), F.sum("i").alias("in_strength"))
    return both.withColumn("strength", F.col("out_strength") + F.col("in_strength"))


def density(edges: DataFrame, nodes: DataFrame, keys: list[str], directed: bool = False) -> DataFrame:
    n = nodes.groupBy(*keys).agg(F.count("*").alias("nodes"))
    e = edges.groupBy(*keys).agg(F.count("*").alias("edges"))
    rows = n.join(e, keys, "left").withColumn("edges", F.coalesce("edges", F.lit(0)))
    pairs = F.col("nodes") * (F.col("nodes") - 1)
    return rows.withColumn("density", F.coalesce((1 if directed else 2) * F.col("edges") / F.nullif(pairs, F.lit(0)), F.lit(0.0)))


def assortativity(edges: DataFrame, keys: list[str], bloc_a: Column, bloc_b: Column) -> DataFrame:
    """Attribute assortativity of undirected edges; null when there is a single bloc."""
    ab = edges.select(*keys, bloc_a.alias("x"), bloc_b.alias("y"))
    both = ab.unionByName(ab.select(*keys, F.col("y").alias("x"), F.col("x").alias("y")))
    total = both.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.col("x") == F.col("y")).alias("same"))
    ends = both.groupBy(*keys, "x").agg(F.count("*").alias("k")).groupBy(*keys).agg(F.sum(F.col("k") * F.col("k")).alias("kk"))
    rows = total.join(ends, keys)
    expected = F.col("kk") / (F.col("n") * F.col("n"))
    return rows.select(*keys, ((F.col("same") / F.col("n") - expected) / F.nullif(1 - expected, F.lit(0.0))).alias("assortativity"))


def signed_affinity(long: DataFrame, keys: list[str], entity: str, value: str) -> DataFrame:
    """Cosine of z-scored rows, pairs a < b; graphs of one entity have none."""
    return cosine_edges(zscores(long, keys, value), keys, entity, "z")


def affinity_summary(pairs: DataFrame, keys: list[str]) -> DataFrame:
    w, low = F.col("w"), F.when(F.col("w") < 0, -F.col("w")).otherwise(0.0)
    return pairs.groupBy(*keys).agg((F.sum(low) / F.nullif(F.sum(F.abs(w)), F.lit(0.0))).alias("negative_share"), F.avg(F.abs(w)).alias("mean_absolute"), F.avg(low).alias("mean_negative"))


def sides(positions: DataFrame, keys: list[str], entity: str, position: str) -> DataFrame:
    """+1 from position 0 up, else -1; from the median if all share a sign; the lower half if that fails too."""
    w = Window.partitionBy(*keys)
    p = F.coalesce(F.col(position), F.lit(0.0))
    rows = positions.withColumn("_p", p)
    rows = rows.withColumns({"_lo": F.min("_p").over(w), "_hi": F.max("_p").over(w), "_m": F.median("_p").over(w)})
    cut = F.when((F.col("_lo") >= 0) | (F.col("_hi") <= 0), F.col("_m")).otherwise(0.0)
    rows = rows.withColumn("_s", F.when(F.col("_p") >= cut, 1).otherwise(-1))
    rows = rows.withColumns({"_one": F.abs(F.avg("_s").over(w)) == 1, "_r": F.row_number().over(w.orderBy("_p", entity)), "_n": F.count("*").over(w)})
    side = F.when(F.col("_one"), F.when(F.col("_r") <= F.col("_n") / 2, -1).otherwise(1)).otherwise(F.col("_s"))
    return rows.select(*keys, entity, side.alias("side"))


def modularity(pairs: DataFrame, side: DataFrame, keys: list[str], entity: str, sign: int = 1) -> DataFrame:
    """Modularity of the positive (or negative) part of an affinity for the given partition."""
    w = F.greatest(sign * F.col("w"), F.lit(0.0))
    ends = pairs.select(*keys, "a", "b", w.alias("w")).unionByName(pairs.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"), w.alias("w")))
    k = ends.groupBy(*keys, "a").agg(F.sum("w").alias("k"))
    k = k.join(side.withColumnRenamed(entity, "a"), [*keys, "a"])
    m2 = k.groupBy(*keys).agg(F.sum("k").alias("m2"))
    expected = k.groupBy(*keys, "side").agg(F.sum("k").alias("ks")).groupBy(*keys).agg(F.sum(F.col("ks") * F.col("ks")).alias("kk"))
    sa, sb = side.withColumnRenamed(entity, "a").withColumnRenamed("side", "sa"), side.withColumnRenamed(entity, "b").withColumnRenamed("side", "sb")
    inside = ends.join(sa, [*keys, "a"]).join(sb, [*keys, "b"]).groupBy(*keys).agg(F.sum(F.when(F.col("sa") == F.col("sb"), F.col("w")).otherwise(0.0)).alias("inside"))
    rows = m2.join(expected, keys).join(inside, keys)
    return rows.select(*keys, F.coalesce(F.col("inside") / F.nullif(F.col("m2"), F.lit(0.0)) - F.col("kk") / F.nullif(F.col("m2") * F.col("m2"), F.lit(0.0)), F.lit(0.0)).alias("q"))


def signed_modularity(pairs: DataFrame, side: DataFrame, keys: list[str], entity: str) -> DataFrame:
    plus, minus = modularity(pairs, side, keys, entity), modularity(pairs, side, keys, entity, -1)
    return plus.join(minus.withColumnRenamed("q", "q_minus"), keys).select(*keys, (F.col("q") - F.col("q_minus")).alias("modularity"))


def signed_knn(pairs: DataFrame, keys: list[str], k: int = 8) -> DataFrame:
    """Per node the k strongest positive and the k strongest negative ties, made symmetric: half the sum of both sides."""
    ends = pairs.select(*keys, "a", "b", "w").unionByName(pairs.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    w = Window.partitionBy(*keys, "a", F.signum("w")).orderBy(F.desc(F.abs("w")), "b")
    kept = ends.where("w <> 0").withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
    return kept.groupBy(*keys, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg((F.sum("w") / 2).alias("w"))


def gatekeepers(pairs: DataFrame, membership: DataFrame, keys: list[str], entity: str) -> DataFrame:
    """Reach of each node to both poles over ties of either sign, balance of the two, and the gatekeeper score.

    score = ln(1 + 25 reach) x balance (x 1.15 for a node of no pole); cross pressure is the same over
    negative ties alone, without the bonus. ``membership`` has side 1, -1 or 0.
    """
    return reach_scores(_arcs(pairs, keys), membership, keys, entity)


def reach_scores(arcs: DataFrame, membership: DataFrame, keys: list[str], entity: str) -> DataFrame:
    """``gatekeepers`` over arcs: a row (a, b, w) counts for a."""
    to = membership.select(*keys, F.col(entity).alias("b"), F.col("side").alias("pole"))
    rows = arcs.join(to, [*keys, "b"])
    tie = lambda pole, sign: F.sum(F.when((F.col("pole") == pole) & (F.signum("w") == sign), F.abs("w")).otherwise(0.0))
    r = rows.groupBy(*keys, F.col("a").alias(entity)).agg(tie(1, 1).alias("pos_to_plus"), tie(-1, 1).alias("pos_to_minus"), tie(1, -1).alias("neg_to_plus"), tie(-1, -1).alias("neg_to_minus"))
    r = r.withColumns({"reach_plus": F.col("pos_to_plus") + F.col("neg_to_plus"), "reach_minus": F.col("pos_to_minus") + F.col("neg_to_minus")})
    even = lambda a, b: F.least(a, b) / (F.col(a) + F.col(b) + 1e-9)
    weight = lambda a, b: F.log1p(25 * (F.col(a) + F.col(b)))
    bonus = F.when(F.col("side") == 0, 1.15).otherwise(1.0)
    score = weight("reach_plus", "reach_minus") * even("reach_plus", "reach_minus") * bonus
    cross = weight("neg_to_plus", "neg_to_minus") * even("neg_to_plus", "neg_to_minus")
    out = r.join(membership, [*keys, entity])
    return out.select(*keys, entity, "side", even("reach_plus", "reach_minus").alias("balance"), score.alias("gatekeeper_score"), cross.alias("cross_pressure"))


def directed_edges(d: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return d.groupBy(*(keys or []), "source", "target").agg(F.countDistinct("speech_id").alias("speeches"), F.sum("total").alias("total"), F.sum("positive").alias("positive"), F.sum("negative").alias("negative"))


def reciprocity(edges: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """Weighted: sum of min(w_ij, w_ji) over pairs / sum of all weights; binary: share of edges with a reverse edge."""
    back = edges.select(*keys, F.col("source").alias("target"), F.col("target").alias("source"), F.col(weight).alias("_back"))
    rows = edges.join(back, [*keys, "source", "target"], "left")
    low = F.when(F.col("source") < F.col("target"), F.least(F.col(weight), F.col("_back")))
    return rows.groupBy(*keys).agg((F.coalesce(F.sum(F.when(F.col("_back").isNotNull(), low)), F.lit(0.0)) / F.sum(weight)).alias("weighted"), F.avg(F.col("_back").isNotNull().cast("double")).alias("binary"))


def shortest_paths(edges: DataFrame, keys: list[str]) -> DataFrame:
    """All pairs' weighted distances (keys, a, b, distance) inside each undirected graph."""
    return paths.distances(paths.both_ways(edges, keys, "distance"), keys)


def largest_component_path(far: DataFrame, keys: list[str]) -> DataFrame:
    """Average distance in the largest component of each graph (of several, the one with the smallest node) and its size."""
    reach = far.groupBy(*keys, "a").agg(F.least(F.min("b"), F.col("a")).alias("_c"), (F.count("*") + 1).alias("_n"), F.avg("distance").alias("_d"))
    comp = reach.groupBy(*keys, "_c").agg(F.first("_n").alias("nodes"), F.avg("_d").alias("average_path"))
    w = Window.partitionBy(*keys).orderBy(F.desc("nodes"), "_c")
    return comp.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(*keys, F.col("nodes").alias("largest_component"), "average_path")


def network_summary(edges: DataFrame, nodes: DataFrame, keys: list[str], bloc: Column) -> DataFrame:
    """Per graph: nodes, edges, density, assortativity of ``bloc`` (of column node), mean closeness, largest component and its average path."""
    far = shortest_paths(edges, keys)
    of = nodes.select(*keys, "node", bloc.alias("_bloc"))
    marked = edges.join(of.withColumnsRenamed({"node": "a", "_bloc": "_x"}), [*keys, "a"]).join(of.withColumnsRenamed({"node": "b", "_bloc": "_y"}), [*keys, "b"])
    out = density(edges, nodes, keys).join(assortativity(marked, keys, F.col("_x"), F.col("_y")), keys, "left")
    near = closeness(far, nodes, keys).groupBy(*keys).agg(F.avg("closeness").alias("mean_closeness"))
    return out.join(near, keys, "left").join(largest_component_path(far, keys), keys, "left")


def _arcs(pairs: DataFrame, keys: list[str]) -> DataFrame:
    return pairs.select(*keys, "a", "b", "w").unionByName(pairs.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"), "w"))


def leading_vector(pairs: DataFrame, keys: list[str], rounds: int = 20, every: int = 5) -> DataFrame:
    """(keys, node, v): the eigenvector of the largest absolute eigenvalue of each symmetric graph, unit norm.

    Power iteration on the square of the matrix, which is safe for a negative eigenvalue: each step is
    two joins along the edges and a norm. The start is a hash of the node's name; the entry of largest
    size is positive. Lineage is cut by reliable checkpoints.
    """
    arcs = cut(_arcs(pairs, keys).where("w <> 0"))
    v = arcs.select(*keys, "a").distinct().select(*keys, F.col("a").alias("node"), start_value(F.col("a")).alias("v"))
    return signed_entries(_power(arcs, v, keys, 2 * rounds, 2 * every), keys, "node").select(*keys, "node", "v")


#: Pairs of a graph whose whole power iteration runs in one task (under 300 MB in it).
IN_TASK = 3_000_000


def power_vector(pairs: DataFrame, start: DataFrame, keys: list[str], rounds: int = 20, every: int = 5, in_task: int = IN_TASK) -> DataFrame:
    """``leading_vector`` from ``start`` (keys, node, v), of the nodes that have ties and with either sign; no two graphs share a node.

    Graphs of up to ``in_task`` pairs take all their steps in one task each, larger ones go along their arcs step by step.
    """
    pairs = cut(pairs.where("w <> 0").select(*keys, "a", "b", "w"))
    size = pairs.groupBy(*keys).agg((F.count("*") <= in_task).alias("_small"))
    sizes = {r["_small"] for r in size.select("_small").distinct().collect()}
    if sizes == {False}:
        return _stepwise(pairs, start, keys, rounds, every)
    if False not in sizes:
        return cut(_in_task(pairs, start, keys, 2 * rounds))
    size = cut(size)  # a row per graph
    only = lambda d, small: d.join(F.broadcast(size.where("_small" if small else "not _small").select(*keys)), keys)
    few = _in_task(only(pairs, True), only(start, True), keys, 2 * rounds)
    return cut(few.unionByName(_stepwise(only(pairs, False), only(start, False), keys, rounds, every)))


def _stepwise(pairs: DataFrame, start: DataFrame, keys: list[str], rounds: int, every: int) -> DataFrame:
    arcs = cut(_arcs(pairs, []).groupBy("a", "b").agg(F.sum("w").alias("w")))
    return _power(arcs, start, keys, 2 * rounds, 2 * every, [])


def _in_task(pairs: DataFrame, start: DataFrame, keys: list[str], steps: int) -> DataFrame:
    """``_power`` with each graph's pairs in one task."""

    def run(key: tuple, x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        node, at = np.unique(np.concatenate([x["a"].to_numpy(), x["b"].to_numpy()]), return_inverse=True)
        a, b, w = at[: len(x)], at[len(x) :], x["w"].to_numpy(float)
        first = pd.Series(y["v"].to_numpy(float), index=y["node"].to_numpy())
        v = first.reindex(node).fillna(0.0).to_numpy()
        for _ in range(steps if len(node) else 0):
            v = np.bincount(a, w * v[b], len(node)) + np.bincount(b, w * v[a], len(node))
            norm = np.sqrt(v @ v)
            v = v / norm if norm > 0 else np.zeros(len(node))
        out = pd.DataFrame({"node": node, "v": v})
        for k, value in zip(keys, key):
            out[k] = value
        return out[[*keys, "node", "v"]]

    kind = lambda c: f"`{c}` {start.schema[c].dataType.simpleString()}"
    schema = ", ".join([*map(kind, keys), kind("node"), "v double"])
    first = start.select(*[F.col(c).alias(c) for c in (*keys, "node", "v")])  # columns of its own where both come from one table
    return pairs.groupBy(*keys).cogroup(first.groupBy(*keys)).applyInPandas(run, schema)


def start_value(name: Column) -> Column:
    """0.5 to 1.5 by a hash of the name."""
    return F.conv(F.substring(F.md5(name.cast("string").cast("binary")), 1, 6), 16, 10).cast("double") / float(1 << 24) + 0.5


def signed_entries(v: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``v`` with the sign that makes the entry of largest size (to 9 digits, then by ``name``) positive."""
    top = v.groupBy(*keys).agg(F.max_by(F.signum("v"), F.struct(F.round(F.abs("v"), 9), name)).alias("_sign"))
    return v.join(top, keys).withColumn("v", F.col("v") * F.col("_sign")).drop("_sign")


QUANTILES = [round(0.2 + 0.65 * i / 17, 10) for i in range(18)]


def pole_sweep(pairs: DataFrame, vector: DataFrame, keys: list[str], quantiles: list[float] = QUANTILES, fallback: float = 0.6, times: Column | None = None) -> DataFrame:
    """(keys, q, tau, score, n_plus, n_minus, active, ok) of each threshold on the absolute vector.

    Nodes from tau up are +1, from -tau down -1, others 0; score is x'Ax over the active nodes. A threshold
    is ok if both groups have max(4, 2 % of the nodes); q = -1 is the fallback threshold. A pair counts for
    the thresholds up to its smaller entry, so all are summed in one pass. ``times``: column of multiplicities.
    """
    m = F.lit(1) if times is None else times
    levels = [*quantiles, fallback]
    cuts = vector.groupBy(*keys).agg(F.percentile(F.abs("v"), F.array(*[F.lit(q) for q in levels]), m).alias("_q"), F.sum(m).alias("_n"))
    with_cuts = lambda d: d.join(cuts, keys) if keys else d.crossJoin(F.broadcast(cuts))
    at = lambda i: F.get("_q", F.lit(i))
    end = lambda c, v: vector.select(*keys, F.col("node").alias(c), F.col("v").alias(v))
    tied = pairs.join(end("a", "_va"), [*keys, "a"]).join(end("b", "_vb"), [*keys, "b"])
    tied = tied.select(*keys, F.least(F.abs("_va"), F.abs("_vb")).alias("_low"), (2 * F.when((F.col("_va") >= 0) == (F.col("_vb") >= 0), F.col("w")).otherwise(-F.col("w"))).alias("_s"))
    total = with_cuts(tied).groupBy(*keys).agg(F.array(*[F.coalesce(F.sum(F.when(F.col("_low") >= at(i), F.col("_s"))), F.lit(0.0)) for i in range(len(levels))]).alias("_s"))
    part = lambda c: F.coalesce(F.sum(F.when(c, m)), F.lit(0)).cast("long")
    plus, minus = (lambda i: F.col("v") >= at(i)), (lambda i: (F.col("v") <= -at(i)) & (F.col("v") < at(i)))
    n = with_cuts(vector).groupBy(*keys, "_q", "_n").agg(F.array(*[F.struct(F.lit(-1 if i == len(quantiles) else i).alias("q"), part(plus(i)).alias("n_plus"), part(minus(i)).alias("n_minus")) for i in range(len(levels))]).alias("_t"))
    j = n.join(total, keys, "left") if keys else n.crossJoin(F.broadcast(total))
    j = j.select(*keys, "_n", F.explode(F.arrays_zip("_t", F.col("_q").alias("tau"), F.coalesce("_s", F.array_repeat(F.lit(0.0), len(levels))).alias("s"))).alias("x")).select(*keys, "_n", "x._t.*", "x.tau", "x.s")
    least = F.greatest(F.lit(4), F.bround(0.02 * F.col("_n")))
    active = F.col("n_plus") + F.col("n_minus")
    return j.where(active > 0).select(*keys, "q", "tau", (F.col("s") / active).alias("score"), "n_plus", "n_minus", active.alias("active"), ((F.col("n_plus") >= least) & (F.col("n_minus") >= least)).alias("ok"))


def best_poles(sweep: DataFrame, keys: list[str]) -> DataFrame:
    """The ok threshold of highest score of each graph (ties: the lowest), the fallback where none is ok."""
    rank = F.struct((F.col("ok") & (F.col("q") >= 0)).cast("int"), (F.col("q") < 0).cast("int"), F.round("score", 9), -F.col("q"))
    keep = sweep.where("ok or q < 0").groupBy(*keys).agg(F.max_by(F.struct("tau", "score", "n_plus", "n_minus", "active"), rank).alias("t"))
    return keep.select(*keys, "t.*")


def poles(vector: DataFrame, keys: list[str], quantile: float = 0.6) -> DataFrame:
    """(keys, node, side): sides by the quantile of the absolute vector."""
    tau = vector.groupBy(*keys).agg(F.percentile(F.abs("v"), F.lit(quantile)).alias("_t"))
    side = F.when(F.col("v") >= F.col("_t"), 1).when(F.col("v") <= -F.col("_t"), -1).otherwise(0)
    return vector.join(tau, keys).select(*keys, "node", side.alias("side"))


def composition(membership: DataFrame, keys: list[str], group: str) -> DataFrame:
    """Nodes per group, in all and on each side."""
    n = lambda s: F.count_if(F.col("side") == s)
    return membership.groupBy(*keys, group).agg(F.count("*").alias("nodes"), n(1).alias("plus"), n(0).alias("neutral"), n(-1).alias("minus"))


def shuffled(long: DataFrame, keys: list[str], entity: str, value: str, draws: int, item: str = "concept") -> DataFrame:
    """``long`` once per draw with the values of each (graph, item) dealt to its entities in the order of a hash; column draw comes on."""
    rows = long.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    group = Window.partitionBy("draw", *keys, item)
    mixed = F.md5(F.concat_ws("|", F.col("draw").cast("string"), *[F.col(k).cast("string") for k in keys], item, entity).cast("binary"))
    own = rows.select("draw", *keys, item, entity, F.row_number().over(group.orderBy(entity)).alias("_r"))
    dealt = rows.select("draw", *keys, item, F.col(value).alias(value), F.row_number().over(group.orderBy(mixed)).alias("_r"))
    return own.join(dealt, ["draw", *keys, item, "_r"]).drop("_r")


def closeness(far: DataFrame, nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Closeness with the correction for the size of the component; isolated nodes have 0."""
    n = nodes.groupBy(*keys).agg(F.count("*").alias("_n"))
    reach = far.groupBy(*keys, F.col("a").alias("node")).agg(F.count("*").alias("_r"), F.sum("distance").alias("_d"))
    rows = nodes.join(n, keys).join(reach, [*keys, "node"], "left")
    value = (F.col("_r") / F.col("_d")) * (F.col("_r") / F.nullif(F.col("_n") - 1, F.lit(0)))
    return rows.select(*keys, "node", F.coalesce(value, F.lit(0.0)).alias("closeness"))


def bloc_distance(m: DataFrame, keys: list[str], value: str) -> DataFrame:
    """1 - cosine of the mean concept vectors of both blocs; a cell that isn't there counts as 0, a zero vector gives null."""
    n = m.groupBy(*keys, "bloc").agg(F.countDistinct("party").alias("_n"))
    mean = m.groupBy(*keys, "bloc", "concept").agg(F.sum(value).alias("_v")).join(n, [*keys, "bloc"])
    at = lambda b: F.sum(F.when(F.col("bloc") == b, F.col("_v") / F.col("_n")).otherwise(0.0))
    j = mean.groupBy(*keys, "concept").agg(at("government").alias("g"), at("opposition").alias("o"))
    norm = F.sqrt(F.sum(F.col("g") * F.col("g"))) * F.sqrt(F.sum(F.col("o") * F.col("o")))
    return j.groupBy(*keys).agg((1 - F.sum(F.col("g") * F.col("o")) / F.nullif(norm, F.lit(0.0))).alias("distance"))


def layer_distances(edges: DataFrame, spine: DataFrame, blocs: tuple[str, str], pair: tuple[str, str], month: str = "month") -> DataFrame:
    """A row per month of ``spine``: by layer, 1 - cosine of the concept weights of two blocs and of two parties.

    ``edges``: month, layer, bloc, party, concept, weight. The mean vector of a bloc points where its sum does, so
    sums are compared. Concepts that one side lacks count as 0; a side without any weight gives null.
    """
    of = lambda c, v: F.sum(F.when(F.col(c) == v, F.col("weight")).otherwise(0.0))
    sums = edges.groupBy(month, "layer", "concept").agg(of("bloc", blocs[0]).alias("a"), of("bloc", blocs[1]).alias("b"), of("party", pair[0]).alias("p"), of("party", pair[1]).alias("q"))

    def distance(x: str, y: str, layer: str) -> Column:
        dot = lambda u, v: F.sum(F.when(F.col("layer") == layer, F.col(u) * F.col(v)))
        return 1 - dot(x, y) / F.nullif(F.sqrt(dot(x, x)) * F.sqrt(dot(y, y)), F.lit(0.0))

    cols = [distance(*v, k).alias(f"{n}_distance_{k}") for n, v in (("bloc", ("a", "b")), ("pair", ("p", "q"))) for k in ("total", "positive", "negative")]
    return spine.select(month).distinct().join(sums.groupBy(month).agg(*cols), month, "left")


def directed_panel(d: DataFrame, spine: DataFrame, cross: Column, topics: list[str], pair: tuple[str, str], nodes: int, month: str = "month") -> DataFrame:
    """A row per month of ``spine`` of directed mentions (source, target, topic, speech_id, total, positive, negative).

    Weights, speeches and mentions; shares across blocs (``cross``), of negative weight on topics, between two
    parties and into each of them; reciprocity and density (among ``nodes`` nodes, 0 in months without edges) of
    both tones, of mentions with a source and a target; the month before of three shares. A share of nothing is null.
    """
    w = {t: F.col(t) for t in ("total", "positive", "negative")}
    add = lambda v, c: F.sum(F.when(c, v).otherwise(0.0))
    both = ((F.col("source") == pair[0]) & (F.col("target") == pair[1])) | ((F.col("source") == pair[1]) & (F.col("target") == pair[0]))
    parts = {f"{t}_cross": add(w[t], cross) for t in ("positive", "negative")} | {f"{t.lower()}_negative": add(w["negative"], F.col("topic") == t) for t in topics}
    parts |= {"pair_negative": add(w["negative"], both), "first_in_negative": add(w["negative"], F.col("target") == pair[0]), "second_in_negative": add(w["negative"], F.col("target") == pair[1])}
    sums = d.groupBy(month).agg(*[F.sum(v).alias(t) for t, v in w.items()], F.countDistinct("speech_id").alias("speeches"), F.count("*").alias("mentions"), *[v.alias(n) for n, v in parts.items()])
    out = spine.select(month).distinct().join(sums, month, "left")
    # one row per month and pair of parties, both directions side by side
    there, onward = F.col("source") <= F.col("target"), F.col("source") > F.col("target")
    ways = {f"{t}_{n}": add(w[t], c) for t in ("positive", "negative") for n, c in (("there", there), ("back", onward))}
    pairs = d.where("source is not null and target is not null").groupBy(month, F.least("source", "target").alias("_a"), F.greatest("source", "target").alias("_b")).agg(*[v.alias(n) for n, v in ways.items()])
    shape = []
    for t in ("positive", "negative"):
        x, y = F.col(f"{t}_there"), F.col(f"{t}_back")
        shape.append((F.sum(F.least(x, y)) / F.nullif(F.sum(x + y), F.lit(0.0))).alias(f"{t}_reciprocity"))
        shape.append((F.sum((x > 0).cast("int") + (y > 0).cast("int")) / (nodes * (nodes - 1))).alias(f"{t}_density"))
    out = out.join(pairs.groupBy(month).agg(*shape), month, "left").na.fill(0.0, ["positive_density", "negative_density"])
    over = lambda v, t: F.col(v) / F.nullif(F.col(t), F.lit(0.0))
    out = out.withColumns({"negative_share": over("negative", "total")} | {f"{n}_share": over(n, "positive" if n.startswith("positive") else "negative") for n in parts})
    before = Window.partitionBy(F.lit(0)).orderBy(month)  # a panel of months
    return out.withColumns({f"{n}_lag1": F.lag(n).over(before) for n in ("negative_cross_share", "positive_cross_share", "pair_negative_share")})


def eigenvector(edges: DataFrame, keys: list[str], rounds: int = 60, every: int = 10) -> DataFrame:
    """Weighted eigenvector centrality of graphs with positive weights by power iteration of A + I, unit norm.

    Each step is a join along the edges; the norm is taken where a checkpoint cuts the lineage.
    """
    arcs = _arcs(edges, keys)
    own = arcs.select(*keys, "a").distinct()
    arcs = cut(arcs.unionByName(own.select(*keys, "a", F.col("a").alias("b"), F.lit(1.0).alias("w"))))
    v = _power(arcs, own.select(*keys, F.col("a").alias("node"), F.lit(1.0).alias("v")), keys, rounds, every)
    return v.select(*keys, "node", F.col("v").alias("centrality"))


#: Arcs of a row of ``adjacent``, about; a node of more has several rows.
ARCS = 256


def adjacent(arcs: DataFrame, keys: list[str], size: int = ARCS) -> DataFrame:
    """(keys, b, to): the arcs (keys, a, b, w) as arrays of (a, w), a row per node b and about ``size`` arcs."""
    n = arcs.groupBy(*keys, "b").agg(F.count("*").alias("_n"))
    part = F.pmod(F.xxhash64("a"), F.ceil(F.col("_n") / size)).alias("_part")
    rows = arcs.join(n, [*keys, "b"]).select(*keys, "b", part, F.struct("a", "w").alias("_t"))
    return rows.groupBy(*keys, "b", "_part").agg(F.collect_list("_t").alias("to")).drop("_part")


def _power(arcs: DataFrame, v: DataFrame, keys: list[str], steps: int, every: int, on: list[str] | None = None) -> DataFrame:
    """``v`` (keys, node, v) after ``steps`` multiplications by the arcs (keys, a, b, w), unit norm.

    A step joins a row per node, not per arc. ``on``: the keys without which a node isn't known, all where not given.
    """
    on = keys if on is None else on
    rows = cut(adjacent(arcs, on))
    place = v.select(*keys, "node")
    done = 0
    while done < steps:
        some = min(every, steps - done)
        for _ in range(some):
            ends = v.select(*on, F.col("node").alias("b"), "v")
            v = rows.join(ends, [*on, "b"]).select(*on, "v", F.inline("to")).groupBy(*on, F.col("a").alias("node")).agg(F.sum(F.col("w") * F.col("v")).alias("v"))
        # the norm reads the rows a second time, so they are written first
        v = cut(v if on == keys else v.join(place, [*on, "node"]).select(*keys, "node", "v"))
        norm = v.groupBy(*keys).agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("_norm"))
        v = v.join(norm, keys).select(*keys, "node", F.coalesce(F.col("v") / F.nullif("_norm", F.lit(0.0)), F.lit(0.0)).alias("v"))
        done += some
    return cut(v)


def gatekeeper_groups(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Mean and median gatekeeper score, mean cross pressure and number of nodes of each group."""
    return scores.groupBy(*keys).agg(F.avg("gatekeeper_score").alias("mean_score"), F.median("gatekeeper_score").alias("median_score"), F.avg("cross_pressure").alias("mean_cross_pressure"), F.count("*").alias("speakers"))


def top_broker(scores: DataFrame, keys: list[str], entity: str) -> DataFrame:
    """The node with the highest gatekeeper score of each graph, ties by name."""
    return scores.groupBy(*keys).agg(F.max_by(entity, F.struct(F.round("gatekeeper_score", 9), entity)).alias("broker"))


def turnover(rows: DataFrame, period: str) -> DataFrame:
    """Per period (an integer) with a period before it: whether the top broker changed and stays, and the change of the concentration.

    ``rows``: period, broker, hhi.
    """
    rows = cut(rows)  # a row a period, read three times
    before = rows.select((F.col(period) + 1).alias(period), F.col("broker").alias("broker_before"), F.col("hhi").alias("_h"))
    after = rows.select((F.col(period) - 1).alias(period), F.col("broker").alias("_next"))
    j = rows.join(before, period).join(after, period, "left")
    return j.select(period, "broker", "broker_before", (F.col("broker") != F.col("broker_before")).alias("turnover"), (F.col("_next") == F.col("broker")).alias("persists"), (F.col("hhi") - F.col("_h")).alias("hhi_delta"))


def main_group(m: DataFrame, entity: str, group: str) -> DataFrame:
    """(entity as a string, group): the group in which an entity has the most rows, ties to the last name."""
    n = m.groupBy(F.col(entity).cast("string").alias(entity), group).agg(F.count("*").alias("_n"))
    return n.groupBy(entity).agg(F.max(F.struct("_n", group))[group].alias(group))


def gatekeeper_shift(scores: DataFrame, group: str, pre: str = "pre", post: str = "post") -> DataFrame:
    """(event, group, pre, post, delta): mean scores by group on both sides of an event, 0 where a group has no score there."""
    at = lambda s: F.coalesce(F.avg(F.when(F.col("side") == s, F.col("gatekeeper_score"))), F.lit(0.0))
    out = scores.groupBy("event", group).agg(at(pre).alias("pre"), at(post).alias("post"))
    return out.withColumn("delta", F.col("post") - F.col("pre"))


def stage_turnover(scores: DataFrame, group: str, first: str = "pre", then: str = "shock", last: str = "post") -> DataFrame:
    """Per event: top speaker and top group (by mean score) of each stage, whether they change and stay, and the change of score and concentration.

    ``scores``: event, stage, speaker, ``group``, gatekeeper_score. Scores are compared to nine digits, ties by name;
    the concentration is that of the groups' mean scores, negatives as 0.
    """
    nine = lambda v: F.round(v, 9)
    mean = scores.groupBy("event", "stage", group).agg(F.avg("gatekeeper_score").alias("_m"), F.max(F.struct(nine("gatekeeper_score").alias("s"), "speaker")).alias("_best"))
    mean = mean.withColumn("_p", F.greatest("_m", F.lit(0.0)))
    by = mean.groupBy("event", "stage").agg(
        F.max("_best")["speaker"].alias("speaker"), F.max(F.struct(nine("_m").alias("s"), group))[group].alias(group), F.max("_m").alias("score"), (F.sum(F.col("_p") * F.col("_p")) / F.nullif(F.sum("_p") * F.sum("_p"), F.lit(0.0))).alias("hhi")
    )
    at = lambda v, s: F.max(F.when(F.col("stage") == s, F.col(v)))
    wide = by.groupBy("event").agg(*[at(v, s).alias(f"{v}_{s}") for v in ("speaker", group, "score", "hhi") for s in (first, then, last)])
    same = lambda v, a, b: F.coalesce(f"{v}_{a}", F.lit("")) == F.coalesce(f"{v}_{b}", F.lit(""))
    flags = {"speaker_turnover": ~same("speaker", first, then), f"{group}_turnover": ~same(group, first, then), f"{group}_persists": same(group, then, last)}
    return wide.withColumns(flags | {f"{v}_delta": F.col(f"{v}_{then}") - F.col(f"{v}_{first}") for v in ("score", "hhi")}).drop(*[f"score_{s}" for s in (first, then, last)], *[f"hhi_{s}" for s in (first, then, last)])


def polarization_null(long: DataFrame, keys: list[str], entity: str, value: str, draws: int = 220, rounds: int = 20) -> DataFrame:
    """Per graph the best polarization score, and mean, deviation and p of the score over shuffled graphs; all draws in one plan."""
    null = shuffled(long, keys, entity, value, draws)
    every = null.unionByName(long.withColumn("draw", F.lit(0)))
    many = ["draw", *keys]
    knn = cut(signed_knn(signed_affinity(every, many, entity, value), many))
    best = cut(best_poles(pole_sweep(knn, leading_vector(knn, many, rounds), many), many).select(*many, "score"))
    seen = best.where("draw = 0").select(*keys, F.col("score").alias("observed"))
    j = best.where("draw > 0").join(seen, keys)
    far = F.avg((F.col("score") >= F.col("observed") - 1e-9).cast("double"))
    return j.groupBy(*keys, "observed").agg(F.avg("score").alias("null_mean"), F.stddev_pop("score").alias("null_std"), far.alias("null_p"))


def principal(vectors: DataFrame, keys: list[str], count: int = 2, steps: int = 60, every: int = 10, center: bool = True) -> DataFrame:
    """(keys, k, item, v): the leading directions of each graph's rows (``vectors``: keys, u, an array over the items), k from 1.

    The items' Gram matrix is an aggregation of the rows (items are few); each direction comes from power
    iteration along its entries, and is taken out of the matrix before the next. Unit norm, the entry of
    largest size (to 9 digits) is positive.
    """
    long = vectors.select(*keys, F.posexplode("u").alias("i", "x"))
    n = vectors.groupBy(*keys).agg(F.count("*").alias("_n"))
    mean = long.groupBy(*keys, "i").agg(F.avg("x").alias("m"))
    pair = vectors.select(*keys, "u", F.posexplode("u").alias("a", "x")).select(*keys, "a", "x", F.posexplode("u").alias("b", "y"))
    gram = pair.groupBy(*keys, "a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("w")).join(n, keys)
    if center:
        gram = gram.join(mean.withColumnsRenamed({"i": "a", "m": "_ma"}), [*keys, "a"]).join(mean.withColumnsRenamed({"i": "b", "m": "_mb"}), [*keys, "b"])
        gram = gram.withColumn("w", F.col("w") - F.col("_n") * F.col("_ma") * F.col("_mb"))
    gram = cut(gram.select(*keys, "a", "b", "w"))
    out = None
    for k in range(1, count + 1):
        start = F.conv(F.substring(F.md5(F.col("a").cast("string").cast("binary")), 1, 6), 16, 10).cast("double") / float(1 << 24) + 0.5
        v = _power(gram, gram.select(*keys, "a").distinct().select(*keys, F.col("a").alias("node"), start.alias("v")), keys, steps, every)
        top = v.groupBy(*keys).agg(F.max_by(F.signum("v"), F.struct(F.round(F.abs("v"), 9), "node")).alias("_sign"))
        v = cut(v.join(top, keys).select(*keys, "node", (F.col("v") * F.col("_sign")).alias("v")))
        one = v.select(*keys, F.lit(k).alias("k"), F.col("node").alias("item"), "v")
        out = one if out is None else out.unionByName(one)
        if k < count:
            both = gram.join(v.withColumnsRenamed({"node": "a", "v": "_va"}), [*keys, "a"]).join(v.withColumnsRenamed({"node": "b", "v": "_vb"}), [*keys, "b"])
            size = both.groupBy(*keys).agg(F.sum(F.col("w") * F.col("_va") * F.col("_vb")).alias("_l"))
            gram = cut(both.join(size, keys).select(*keys, "a", "b", (F.col("w") - F.col("_l") * F.col("_va") * F.col("_vb")).alias("w")))
    return out


def embedding(vectors: DataFrame, keys: list[str], entity: str, steps: int = 60) -> DataFrame:
    """(keys, entity, x, y): the first two principal components of each graph's centered unit rows (``vectors``: keys, entity, u)."""
    vectors = cut(vectors)
    load = principal(vectors, keys, 2, steps).groupBy(*keys, "item").agg(*[F.max(F.when(F.col("k") == k, F.col("v"))).alias(c) for k, c in ((1, "lx"), (2, "ly"))])
    long = vectors.select(*keys, entity, F.posexplode("u").alias("item", "u"))
    mean = long.groupBy(*keys, "item").agg(F.avg("u").alias("_m"))
    rows = long.join(load.join(mean, [*keys, "item"]), [*keys, "item"])
    at = lambda c: F.sum((F.col("u") - F.col("_m")) * F.col(c))
    return rows.groupBy(*keys, entity).agg(at("lx").alias("x"), at("ly").alias("y"))


def overlap(scores: DataFrame, period: str, entity: str, score: str, k: int = 20) -> DataFrame:
    """Jaccard similarity of the k nodes of highest score of a period (an integer) and of the one before, ties by name."""
    w = Window.partitionBy(period).orderBy(F.desc(F.round(score, 9)), entity)
    top = scores.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).groupBy(period).agg(F.collect_set(entity).alias("_now"))
    top = cut(top)  # k names a period, read twice
    both = top.join(top.select((F.col(period) + 1).alias(period), F.col("_now").alias("_old")), period)
    return both.select(period, (F.size(F.array_intersect("_now", "_old")) / F.size(F.array_union("_now", "_old"))).alias("jaccard"))


def layer_arcs(edges: DataFrame, keys: list[str], weights: list[str]) -> DataFrame:
    """(keys, layer, source, target, w, distance): one layer for each weight column, its positive weights without self loops."""
    long = edges.select(*keys, "source", "target", *[F.col(w).cast("double").alias(w) for w in weights]).unpivot([*keys, "source", "target"], weights, "layer", "w")
    return long.where("w > 0 AND source <> target").withColumn("distance", 1 / F.col("w"))


def directed_metrics(arcs: DataFrame, nodes: DataFrame, keys: list[str], rounds: int = 60) -> DataFrame:
    """Per node of each directed graph: strengths, betweenness, outward closeness and PageRank; 0 for a node without ties.

    ``arcs``: keys, source, target, w, distance; ``nodes``: keys, node.
    """
    arcs, nodes = cut(arcs), cut(nodes.select(*keys, "node"))
    s = strengths(arcs, keys, "w").drop("strength")
    near = closeness(paths.distances(arcs, keys), nodes, keys)
    between = paths.betweenness(arcs, nodes, keys)
    rank = paths.pagerank(arcs, nodes, keys, "w", rounds).withColumnRenamed("rank", "pagerank")
    out = nodes.join(s, [*keys, "node"], "left").join(between, [*keys, "node"]).join(near, [*keys, "node"]).join(rank, [*keys, "node"])
    return out.fillna(0.0, ["out_strength", "in_strength"])


def directed_summary(arcs: DataFrame, nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Per directed graph: nodes, edges, density, and binary and weighted reciprocity (null without edges)."""
    back = reciprocity(arcs, keys, "w").withColumnsRenamed({"binary": "binary_reciprocity", "weighted": "weighted_reciprocity"})
    return density(arcs, nodes, keys, directed=True).join(back, keys, "left")


def layer_brokers(long: DataFrame, keys: list[str], entity: str, value: str, ratio: float = 0.5) -> DataFrame:
    """(keys, entity, betweenness) in the pruned similarity network of each graph."""
    long = cut(long)
    edges = weighted_edges(paths.backbone(cosine_edges(long, keys, entity, value), keys, ratio))
    nodes = long.select(*keys, F.col(entity).alias("node")).distinct()
    return paths.betweenness(paths.both_ways(edges, keys, "distance"), nodes, keys).withColumnRenamed("node", entity)
