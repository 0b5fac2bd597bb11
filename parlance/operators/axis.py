"""Latent axis: concept weights from anchors, positions of parties, spread."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import graphs, resample
from .lineage import cut


def anchor_weights(z: DataFrame, anchors: DataFrame, keys: list[str] | None = None, least: int = 3) -> DataFrame:
    """Per concept the correlation of the parties' mean z-scores with the anchor scores, to unit norm; 0 if constant or under ``least`` anchors."""
    keys = keys or []
    mean = z.groupBy(*keys, "party", "concept").agg(F.avg("z").alias("z"))
    rows = mean.join(F.broadcast(anchors), "party")
    flat = (F.stddev_pop("z") == 0) | (F.stddev_pop("anchor") == 0) | (F.count("*") < least)
    w = rows.groupBy(*keys, "concept").agg(F.when(flat, 0.0).otherwise(F.corr("z", "anchor")).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(*(keys or [F.lit(0)]))))
    return w.withColumn("w", F.coalesce(F.col("w") / F.nullif(norm, F.lit(0.0)), F.lit(0.0)))


def singular_weights(z: DataFrame, steps: int = 60) -> DataFrame:
    """Per concept the first right singular vector of the parties' mean z-scores (a cell that isn't there counts as 0)."""
    mean = z.groupBy("party", "concept").agg(F.avg("z").alias("z"))
    items = mean.agg(F.array_sort(F.collect_set("concept")).alias("_items"))  # concepts of the lexicon
    rows = mean.groupBy("party").agg(F.map_from_entries(F.collect_list(F.struct("concept", "z"))).alias("_z")).crossJoin(F.broadcast(items))
    vectors = rows.select(F.lit(0).alias("axis"), F.transform("_items", lambda i: F.coalesce(F.col("_z")[i], F.lit(0.0))).alias("u"))
    v = graphs.principal(vectors, ["axis"], 1, steps, center=False)
    return items.select(F.posexplode("_items").alias("item", "concept")).join(v, "item").select("concept", F.col("v").alias("w"))


def weights(z: DataFrame, anchors: DataFrame, least: int = 3) -> DataFrame:
    """Concept weights from the anchors; the singular vector if under ``least`` of them are parties here or nothing correlates."""
    by_anchor = anchor_weights(z, anchors, least=least)
    if by_anchor.where("w <> 0").isEmpty():
        return singular_weights(z)
    return by_anchor


def positions(z: DataFrame, weights: DataFrame, period: list[str]) -> DataFrame:
    """Position of each party in each period: its z-scores along the weights."""
    return z.join(F.broadcast(weights), "concept").groupBy(*period, "party").agg(F.sum(F.col("z") * F.col("w")).alias("position"))


def spread(rows: DataFrame, period: list[str]) -> DataFrame:
    return rows.groupBy(*period).agg(
        (F.max("position") - F.min("position")).alias("spread"), F.stddev_samp("position").alias("deviation"), F.min("position").alias("lowest"), F.max("position").alias("highest")
    )


def gap(rows: DataFrame, period: list[str], one: str, other: str) -> DataFrame:
    at = lambda p: F.max(F.when(F.col("party") == p, F.col("position")))
    return rows.groupBy(*period).agg((at(one) - at(other)).alias("gap"), F.abs(at(one) - at(other)).alias("distance"))


def net_shift(rows: DataFrame, order: str) -> DataFrame:
    return rows.groupBy("party").agg((F.max_by("position", order) - F.min_by("position", order)).alias("net_shift"))


def drift(rows: DataFrame, order: str) -> DataFrame:
    """First and last period and center, net drift, mean, population deviation, extremes."""
    first, last = F.min_by("position", order), F.max_by("position", order)
    return rows.groupBy("party").agg(
        F.min(order).alias("first_term"), F.max(order).alias("last_term"), first.alias("first_center"), last.alias("last_center"), (last - first).alias("net_drift"),
        F.avg("position").alias("mean_center"), F.stddev_pop("position").alias("std_center"), F.min("position").alias("min_center"), F.max("position").alias("max_center"),
    )


def intervals(rows: DataFrame) -> DataFrame:
    return rows.groupBy("party").agg(F.median("position").alias("center"), F.min("position").alias("left_end"), F.max("position").alias("right_end"), F.count("*").alias("years"))


def leave_one_out(z: DataFrame, anchors: DataFrame) -> DataFrame:
    """For each anchor: correlation of the parties' positions on the axis without it and on the full axis."""
    full = positions(z, anchor_weights(z, anchors), []).withColumnRenamed("position", "full")
    left = anchors.select(F.col("party").alias("left_out"))
    other = anchors.join(F.broadcast(left), F.col("party") != F.col("left_out"))
    mean = z.groupBy("party", "concept").agg(F.avg("z").alias("z"))
    rows = mean.join(F.broadcast(other), "party")
    flat = (F.stddev_pop("z") == 0) | (F.count("*") < 3)
    w = rows.groupBy("left_out", "concept").agg(F.when(flat, 0.0).otherwise(F.corr("z", "anchor")).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("left_out")))
    w = w.withColumn("w", F.col("w") / F.nullif(norm, F.lit(0.0)))
    pos = z.join(F.broadcast(w), "concept").groupBy("left_out", "party").agg(F.sum(F.col("z") * F.col("w")).alias("position"))
    return pos.join(full, "party").groupBy("left_out").agg(F.corr("position", "full").alias("r"))


def scale(long: DataFrame, value: str = "value") -> DataFrame:
    """(concept, mu, sd) over all rows; a deviation of 0 counts as 1."""
    dev = F.coalesce(F.stddev_samp(value), F.lit(0.0))
    return long.groupBy("concept").agg(F.avg(value).alias("mu"), F.when(dev == 0, 1.0).otherwise(dev).alias("sd"))


def scored(features: DataFrame, scales: DataFrame, weights: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Positions of other rows on a known axis: stored means and deviations, a concept that isn't there counts as 0."""
    known = weights.join(scales, "concept")
    base = F.sum(-F.col("mu") / F.col("sd") * F.col("w"))
    zero = known.agg(base.alias("_zero"))
    moved = features.join(F.broadcast(known), "concept").groupBy(*keys).agg(F.sum(F.col(value) / F.col("sd") * F.col("w")).alias("_moved"))
    return moved.crossJoin(F.broadcast(zero)).select(*keys, (F.col("_moved") + F.col("_zero")).alias("position"))  # one row


def bootstrap(m: DataFrame, row: list[str], scales: DataFrame, weights: DataFrame, draws: int = 250, least: int = 8) -> DataFrame:
    """(draw, party, position) over Poisson bootstrap resamples of each party's mentions; parties with fewer than ``least`` rows are left out.

    A row's weights are hashes of ``row``; each party and concept is one row with the sums of all draws.
    """
    enough = m.groupBy("party").agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select("party")
    rows = m.join(F.broadcast(enough), "party")  # one row a party
    keys, values = ["party", "concept"], ["mention_count", "pos", "neg"]
    s = resample.by_draw(resample.drawn_sums(rows, keys, values, [F.col(c) for c in row], draws), keys, values).where("mention_count > 0")
    total = F.greatest(F.sum("mention_count").over(Window.partitionBy("draw", "party")), F.lit(1))
    balance = (F.col("pos") - F.col("neg")) / (F.col("pos") + F.col("neg") + 1.0)
    return scored(s.select("draw", "party", "concept", (balance * F.col("mention_count") / total).alias("value")), scales, weights, ["draw", "party"])


def quantiles(rows: DataFrame) -> DataFrame:
    """Per party the 10, 25, 50, 75 and 90 % quantiles and the population deviation of the draws."""
    q = {"boot_q10": 0.1, "boot_q25": 0.25, "boot_median": 0.5, "boot_q75": 0.75, "boot_q90": 0.9}
    return rows.groupBy("party").agg(*[F.percentile("position", F.lit(v)).alias(k) for k, v in q.items()], F.stddev_pop("position").alias("boot_std"))


def _corr(x: str, y: str) -> Column:
    """Correlation over the rows that have both, null where one of both is constant."""
    dev = lambda c, other: F.stddev_pop(F.when(F.col(other).isNotNull(), F.col(c)))
    return F.covar_pop(x, y) / F.nullif(dev(x, y) * dev(y, x), F.lit(0.0))


def fitted(mean: DataFrame, keys: list[str], least: int = 2) -> tuple[DataFrame, DataFrame]:
    """Weights (keys, concept, w) and positions (keys, party, anchor, position) of the axis of each sample.

    ``mean``: keys, party, concept, z, anchor (null for parties that aren't anchors of the sample). Where nothing correlates
    the weights are the first right singular vector of the anchors' rows, and equal without any anchor. Anchors and axis go the same way.
    """
    rows = mean.where("anchor is not null")
    r = rows.groupBy(*keys, "concept").agg(F.when(F.count("*") >= least, _corr("z", "anchor")).alias("w"))
    w = cut(mean.select(*keys, "concept").distinct().join(r, [*keys, "concept"], "left").na.fill(0.0, ["w"]))  # concepts of the lexicon by sample
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(*keys)))
    none = w.groupBy(*keys).agg(F.max(F.abs("w")).alias("_m")).where("_m = 0").select(*keys)
    if not none.isEmpty():
        items = w.join(none, keys).groupBy(*keys).agg(F.array_sort(F.collect_set("concept")).alias("_items"))
        cells = rows.join(none, keys).groupBy(*keys, "party").agg(F.map_from_entries(F.collect_list(F.struct("concept", "z"))).alias("_z")).join(items, keys)
        v = graphs.principal(cells.select(*keys, F.transform("_items", lambda i: F.coalesce(F.col("_z")[i], F.lit(0.0))).alias("u")), keys, 1, center=False)
        v = items.select(*keys, F.posexplode("_items").alias("item", "concept")).join(v, [*keys, "item"]).select(*keys, "concept", F.col("v").alias("_v"))
        bare = items.join(rows.select(*keys).distinct(), keys, "left_anti").select(*keys, F.explode("_items").alias("concept"), F.lit(1.0).alias("_v"))
        w = cut(w.join(v.unionByName(bare), [*keys, "concept"], "left").select(*keys, "concept", F.coalesce("_v", "w").alias("w")))
    w = w.withColumn("w", F.coalesce(F.col("w") / F.nullif(norm, F.lit(0.0)), F.lit(0.0)))
    place = mean.join(w, [*keys, "concept"]).groupBy(*keys, "party").agg(F.max("anchor").alias("anchor"), F.sum(F.col("z") * F.col("w")).alias("position"))
    way = place.groupBy(*keys).agg(F.when(_corr("position", "anchor") < 0, -1.0).otherwise(1.0).alias("_way"))
    turn = lambda d, c: d.join(way, keys).withColumn(c, F.col(c) * F.col("_way")).drop("_way")
    return turn(w, "w"), turn(place, "position")


def permuted(rows: DataFrame, value: str, permutations: int) -> DataFrame:
    """One row (r, anchors, p): correlation of ``value`` with the anchors, and how often it is reached with the anchors dealt to the parties by a hash of draw and party."""
    many = rows.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(permutations))))
    w = Window.partitionBy("draw")
    mixed = F.md5(F.concat_ws("|", F.col("draw").cast("string"), "party").cast("binary"))
    own = many.select("draw", value, F.row_number().over(w.orderBy("party")).alias("_r"))
    dealt = many.select("draw", "anchor", F.row_number().over(w.orderBy(mixed)).alias("_r"))
    null = own.join(dealt, ["draw", "_r"]).groupBy("draw").agg(_corr(value, "anchor").alias("_null"))
    seen = rows.agg(_corr(value, "anchor").alias("r"), F.count("*").alias("anchors"))
    reached = F.when(F.col("r").isNotNull(), F.coalesce(F.abs("_null") >= F.abs("r") - 1e-12, F.lit(False)).cast("double"))
    return null.crossJoin(seen).groupBy("r", "anchors").agg(F.avg(reached).alias("p"))  # one row


def resampled(z: DataFrame, row: list[str], draws: int) -> DataFrame:
    """(draw, party, concept, z): mean z-scores of as many panel rows (``row`` and party) as there are, drawn with replacement by a hash of draw and place."""
    panel = z.select(*row, "party").distinct()  # a row per period and party
    order = Window.orderBy(*row, "party")
    panel = panel.select(*row, "party", (F.row_number().over(order) - 1).cast("long").alias("_at"))
    size = panel.agg(F.count("*").alias("_n"))
    places = size.select("_n", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw")).select("_n", "draw", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias("_i"))
    code = F.conv(F.substring(F.md5(F.concat_ws("|", F.col("draw").cast("string"), F.col("_i").cast("string")).cast("binary")), 1, 8), 16, 10).cast("long")
    times = places.where("_n > 0").groupBy("draw", (code % F.col("_n")).alias("_at")).agg(F.count("*").alias("_k"))
    rows = times.join(F.broadcast(panel), "_at").join(z.select(*row, "party", "concept", "z"), [*row, "party"])
    return rows.groupBy("draw", "party", "concept").agg((F.sum(F.col("_k") * F.col("z")) / F.sum("_k")).alias("z"))


def validation(z: DataFrame, anchors: DataFrame, centers: DataFrame, row: list[str], draws: int = 250, permutations: int = 500) -> DataFrame:
    """(metric, name, value) of the axis through ``z`` (``row``, party, concept, z).

    Correlation of the anchors' positions with their scores and its permutation p, the same of ``centers`` (party, center);
    for each resample of the panel's rows the correlation on the axis fitted anew to it, and their mean and deviation; for each
    anchor left out of the fit the correlation of all positions with those on the full axis; and the weights with mean,
    deviation and 10 and 90 % quantiles over the resamples.
    """
    of = lambda d, kind, name: d.select(F.lit(kind).alias("kind"), F.col(name).cast("string").alias("name"), "party", "concept", "z", "anchor")
    mean = cut(z.groupBy("party", "concept").agg(F.avg("z").alias("z")).join(F.broadcast(anchors), "party", "left"))
    left = F.broadcast(mean.where("anchor is not null").select(F.col("party").alias("left_out")).distinct())
    without = mean.crossJoin(left).withColumn("anchor", F.when(F.col("party") != F.col("left_out"), F.col("anchor")))  # parties by anchors
    drawn = resampled(z, row, draws).join(F.broadcast(anchors), "party", "left")
    samples = of(mean.withColumn("_f", F.lit("full")), "full", "_f").unionByName(of(without, "without", "left_out")).unionByName(of(drawn, "draw", "draw"))
    w, place = (cut(d) for d in fitted(cut(samples), ["kind", "name"]))

    full = place.where("kind = 'full'").select("party", "anchor", "position")
    by_draw = place.where("kind = 'draw'").groupBy("name").agg(_corr("position", "anchor").alias("value"))
    by_left = place.where("kind = 'without'").join(full.select("party", F.col("position").alias("_full")), "party").groupBy("name").agg(F.abs(_corr("position", "_full")).alias("value"))
    one = w.where("kind = 'draw'").groupBy("concept").agg(F.avg("w").alias("mean"), F.stddev_samp("w").alias("std"), F.percentile("w", F.lit(0.1)).alias("q10"), F.percentile("w", F.lit(0.9)).alias("q90"))
    weight = w.where("kind = 'full'").select("concept", F.col("w").alias("weight")).join(one, "concept", "left")

    def named(d: DataFrame, columns: dict[str, str], name: str | None = None) -> DataFrame:
        cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(c).cast("double").alias("value")) for c, m in columns.items()])
        return d.select((F.col(name) if name else F.lit(None)).cast("string").alias("name"), F.explode(cells).alias("_c")).select("_c.metric", "name", "_c.value")

    of_centers = permuted(centers.join(F.broadcast(anchors), "party").select("party", "center", "anchor"), "center", permutations)
    parts = [
        named(permuted(full.where("anchor is not null"), "position", permutations), {"r": "observed_anchor_correlation", "anchors": "anchors", "p": "anchor_permutation_p"}),
        named(of_centers, {"r": "center_correlation", "p": "center_permutation_p"}),
        named(by_draw.agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s")), {"m": "bootstrap_anchor_corr_mean", "s": "bootstrap_anchor_corr_std"}),
        named(by_left, {"value": "leave_one_anchor_out"}, "name"), named(by_draw, {"value": "anchor_corr_bootstrap"}, "name"),
        named(weight, {"weight": "weight", "mean": "weight_bootstrap_mean", "std": "weight_bootstrap_std", "q10": "weight_bootstrap_q10", "q90": "weight_bootstrap_q90"}, "concept"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def opinion_intervals(intervals: DataFrame, boot: DataFrame, replace: bool = False) -> DataFrame:
    """Center and ends of each party beside the bootstrap columns; ``replace``: the 10 and 90 % quantiles and the median instead, where there are draws."""
    j = intervals.join(boot, "party", "left")
    new = {"center": "boot_median", "left_end": "boot_q10", "right_end": "boot_q90"}
    return j.withColumns({k: F.coalesce(v, k) for k, v in new.items()}) if replace else j
