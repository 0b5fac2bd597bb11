"""Rollups of signed mentions to party, concept, speaker and period panels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .mentions import balance


def layered(m: DataFrame) -> DataFrame:
    """Each mention in the layer ``total`` and, if signed, in the layer of its label, with its strength there."""
    layers = F.filter(F.array(F.lit("total"), F.col("label")), lambda x: x != "mixed")
    rows = m.select("*", F.explode(layers).alias("layer"))
    strength = F.when(F.col("layer") == "total", 1.0).when(F.col("layer") == "positive", F.greatest("score", F.lit(0.0))).otherwise(F.greatest(-F.col("score"), F.lit(0.0)))
    return rows.withColumn("weight", F.col("salience") * strength)


def layer_edges(m: DataFrame, period: list[str] | None = None) -> DataFrame:
    """Layer x period x party x concept: distinct speeches, sums, layer weight and the score of the sums. Null keys stay."""
    keys = ["layer", *(period or []), "party", "concept", "category"]
    out = layered(m).groupBy(*keys).agg(
        F.countDistinct("speech_id").alias("speech_count"), F.sum("mention_count").alias("mention_count"), F.sum("pos").alias("pos"),
        F.sum("neg").alias("neg"), F.sum("salience").alias("salience"), F.sum("weight").alias("layer_weight"),
    )
    return out.withColumn("score", F.bround(balance(F.col("pos"), F.col("neg")), 4))


def share(value: Column, keys: list[str], one_if_zero: bool = False) -> Column:
    """Share of a value in the total of its group."""
    total = F.sum(value).over(Window.partitionBy(*keys)) if keys else F.sum(value).over(Window.partitionBy(F.lit(0)))
    return value / (F.when(total == 0, 1).otherwise(total) if one_if_zero else F.nullif(total, F.lit(0)))


def signed_agenda_feature(m: DataFrame, keys: list[str]) -> DataFrame:
    """Balance times agenda share per key; the last key is the concept, shares are within the others. Null keys go."""
    sums = m.dropna(subset=keys).groupBy(*keys).agg(F.sum("mention_count").alias("mention_count"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    agenda = share(F.col("mention_count"), keys[:-1], one_if_zero=True)
    out = sums.select("*", balance(F.col("pos"), F.col("neg")).alias("balance"), agenda.alias("agenda"))
    return out.withColumn("feature", F.col("balance") * F.col("agenda"))


def feature_matrix(features: DataFrame, entity: list[str], concepts: list[str], concept: str = "concept", value: str = "feature") -> DataFrame:
    """Entity x concept, missing 0; ``concepts`` fixes the columns, so no pass finds them."""
    return features.groupBy(*entity).pivot(concept, concepts).agg(F.first(value)).na.fill(0.0, concepts)


def sums_by(m: DataFrame, keys: list[str]) -> DataFrame:
    return m.groupBy(*keys).agg(F.sum("mention_count").alias("mentions"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def active_speakers(m: DataFrame, least: int = 8, quantile: float = 0.4, keys: tuple[str, ...] = ("speaker", "party")) -> DataFrame:
    """Speakers (per party) with at least max(least, quantile of the totals) mentions; rows with a null key are dropped."""
    total = m.dropna(subset=list(keys)).groupBy(*keys).agg(F.sum("mention_count").alias("mentions"))
    cut = total.agg(F.greatest(F.lit(float(least)), F.percentile("mentions", F.lit(quantile))).alias("cut"))
    return total.join(F.broadcast(cut), F.col("mentions") >= F.col("cut")).select(*keys, "mentions")


def party_summary(m: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Per party: balance, agenda share of all and tone rates per mention (0 without mentions)."""
    s = sums_by(m, [*(keys or []), "party"])
    rate = lambda c: F.when(F.col("mentions") > 0, F.col(c) / F.col("mentions")).otherwise(0.0)
    return s.select("*", balance(F.col("pos"), F.col("neg")).alias("balance"), share(F.col("mentions"), keys or []).alias("agenda_share"), rate("neg").alias("negative_rate"), rate("pos").alias("positive_rate"))


def period_shares(m: DataFrame, period: list[str], item: list[str]) -> DataFrame:
    """Per period x item: sums, share of the period, tone rates with the denominator clipped at 1."""
    s = sums_by(m, [*period, *item])
    d = F.greatest(F.col("mentions"), F.lit(1))
    return s.select("*", share(F.col("mentions"), period).alias("agenda_share"), (F.col("pos") / d).alias("pos_rate"), (F.col("neg") / d).alias("neg_rate"))


def series_wide(rows: DataFrame, period: str, item: str, value: str, values: list[str]) -> DataFrame:
    return rows.groupBy(period).pivot(item, values).agg(F.first(value)).na.fill(0.0, values)


def top_in(rows: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first n rows of each group in an order that has no ties."""
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(*(keys or [F.lit(0)])).orderBy(*order))).where(F.col(rank) <= n)


def hhi(rows: DataFrame, keys: list[str], share_col: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.sum(F.pow(share_col, F.lit(2))).alias("hhi"))


def brokerage_hhi(rows: DataFrame, keys: list[str], entity: str, score: str) -> DataFrame:
    """Concentration of mean scores, negatives as 0; null when nothing is positive."""
    mean = rows.groupBy(*keys, entity).agg(F.greatest(F.avg(score), F.lit(0.0)).alias("v"))
    total, squares = F.sum("v"), F.sum(F.col("v") * F.col("v"))
    return mean.groupBy(*keys).agg(F.when(total > 0, squares / (total * total)).alias("hhi"))


def lorenz(counts: DataFrame, keys: list[str], value: str, tie: str) -> DataFrame:
    """Cumulative population and value shares in ascending order."""
    w = Window.partitionBy(*keys).orderBy(value, tie)
    every = Window.partitionBy(*keys)
    run = F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return counts.select(*keys, tie, value, (F.row_number().over(w) / F.count("*").over(every)).alias("people"), (run / F.nullif(F.sum(value).over(every), F.lit(0))).alias("held"))


def gini(counts: DataFrame, keys: list[str], value: str) -> DataFrame:
    """1 - 2 x area under the Lorenz curve, in closed form over counts of equal values: no window over all rows."""
    same = counts.groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*keys).orderBy("_v")
    before = F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = same.select("*", (before * F.col("_n") + F.col("_n") * (F.col("_n") + 1) / 2).alias("_ranks"))
    weighted, total, n = F.sum(F.col("_ranks") * F.col("_v")), F.sum(F.col("_n") * F.col("_v")), F.sum("_n")
    return ranks.groupBy(*keys).agg((2 * weighted / (n * F.nullif(total, F.lit(0))) - (n + 1) / n).alias("gini"))


def top_share(counts: DataFrame, keys: list[str], value: str, quantile: float) -> DataFrame:
    """Share held by the ceil(n x quantile) largest, over counts of equal values: no window over all rows."""
    same = counts.groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("_n").over(w.orderBy(F.desc("_v")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = same.withColumn("_k", F.ceil(F.sum("_n").over(w) * quantile) - before)
    top = F.sum(F.least("_n", F.greatest("_k", F.lit(0))) * F.col("_v"))
    return rows.groupBy(*keys).agg((top / F.nullif(F.sum(F.col("_n") * F.col("_v")), F.lit(0))).alias("top_share"))


def rank_powerlaw(counts: DataFrame, keys: list[str], value: str, tie: str) -> DataFrame:
    """Log-log slope and r2 of value on rank, values above 0."""
    rows = counts.where(F.col(value) > 0).withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(value), tie)))
    x, y = F.log(F.col("_r").cast("double")), F.log(F.col(value).cast("double"))
    return rows.select(*keys, x.alias("_x"), y.alias("_y")).groupBy(*keys).agg(F.regr_slope("_y", "_x").alias("slope"), F.regr_r2("_y", "_x").alias("r2"))


def speech_panel(m: DataFrame, keys: list[str]) -> DataFrame:
    """Per group: speeches, speakers, words, mean score and label shares."""
    label = lambda x: F.avg((F.col("label") == x).cast("double")).alias(f"{x}_share")
    return m.groupBy(*keys).agg(
        F.countDistinct("speech_id").alias("speeches"), F.countDistinct("speaker").alias("speakers"), F.sum("mention_count").alias("words"),
        F.avg("mention_count").alias("mean_words"), F.avg("score").alias("mean_score"), label("positive"), label("negative"), label("mixed"),
    )


def monthly_panel(m: DataFrame, spine: DataFrame, bloc: Column, blocs: list[str], month: str = "month") -> DataFrame:
    """A row per month of ``spine``: the speech panel of all speeches and of each bloc side by side.

    With speeches per speaker and share of all speeches of each bloc. One aggregation gives both levels;
    months without speeches and blocs without any in a month are null. A null bloc counts in the whole only.
    """
    rows = m.withColumn("_bloc", F.explode(F.array(F.lit("all"), bloc)))
    long = speech_panel(rows, [month, "_bloc"])
    at = lambda b, n: F.max(F.when(F.col("_bloc") == b, F.col(n)))
    whole = [at("all", n).alias(n) for n in long.columns[2:]]
    each = [at(b, n).alias(f"{b}_{n}") for b in blocs for n in ("speeches", "speakers", "words", "positive_share", "negative_share")]
    out = spine.select(month).distinct().join(long.groupBy(month).agg(*whole, *each), month, "left")
    per = lambda a, b: F.col(a) / F.nullif(F.col(b), F.lit(0))
    ratios = {f"{b}_speeches_per_speaker": per(f"{b}_speeches", f"{b}_speakers") for b in blocs}
    return out.withColumns(ratios | {f"{b}_speech_share": per(f"{b}_speeches", "speeches") for b in blocs})


def layer_features(m: DataFrame, spine: DataFrame, categories: list[str], concepts: list[str], reform: str, crisis: list[str], month: str = "month") -> DataFrame:
    """A row per month of ``spine``: weights of the layers, of categories and of concepts by layer, and their shares.

    Shares are of the month's weight in the layer ``total``. ``reform_positive_share`` is the positive weight of
    one category (0 where it has none), ``crisis_negative_share`` the negative weights of some together (null if
    one has none), ``positive_negative_ratio`` that of the two layers. Cells without mentions are null.
    """
    long = layered(m).groupBy(month, "layer", "category", "concept").agg(F.sum("weight").alias("w"))
    layers = ("total", "positive", "negative")
    cell = lambda k, *at: F.sum(F.when((F.col("layer") == k) & reduce(lambda a, b: a & b, at, F.lit(True)), F.col("w")))
    cells = {f"{c.lower()}_{k}": cell(k, F.col(of) == c) for of, names in (("category", categories), ("concept", concepts)) for c in names for k in layers}
    wide = long.groupBy(month).agg(*[cell(k).alias(f"{k}_layer_weight") for k in layers], *[v.alias(f"{n}_weight") for n, v in cells.items()])
    over = lambda v: v / F.nullif(F.col("total_layer_weight"), F.lit(0.0))
    bad = reduce(lambda a, b: a + b, [F.col(f"{c}_negative_weight") for c in crisis])
    more = {f"{n}_share": over(F.col(f"{n}_weight")) for n in cells} | {
        "reform_positive_share": over(F.coalesce(f"{reform}_positive_weight", F.lit(0.0))),
        "crisis_negative_share": over(bad),
        "positive_negative_ratio": F.col("positive_layer_weight") / F.nullif(F.col("negative_layer_weight"), F.lit(0.0)),
    }
    return spine.select(month).distinct().join(wide, month, "left").withColumns(more)


def yearly_panel(panel: DataFrame, sums: list[str], means: list[str], speeches: str = "speeches", month: str = "month") -> DataFrame:
    """Per year of a monthly panel: sums (0 if all are null) and means of columns, and the months with speeches."""
    return panel.groupBy(F.year(month).alias("year")).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums], *[F.avg(c).alias(c) for c in means], F.count_if(F.col(speeches) > 0).alias("months_with_speeches")
    )


def main_party(rows: DataFrame, keys: list[str], speaker: str = "speaker", party: str = "party") -> DataFrame:
    """(keys, speaker, party, n): the party in which a speaker has most rows, ties to the first name."""
    n = rows.groupBy(*keys, speaker, party).agg(F.count("*").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("_m"), party))
    return n.groupBy(*keys, speaker).agg(best.alias("_b")).select(*keys, speaker, F.col("_b")[party].alias(party), (-F.col("_b._m")).alias("n"))


def speaker_tops(rows: DataFrame, term: str, n: int = 20, parties: int = 8, each: int = 15, least: int = 20, speaker: str = "speaker", party: str = "party") -> DataFrame:
    """(term, list, rank, speaker, party, n): the most active speakers of each term, and of its largest parties.

    The list ``all`` has the first ``n`` speakers with their main party; the list of a party has its first ``each``,
    for the ``parties`` largest of a term with at least ``least`` rows. Ties go to the first name.
    """
    main = main_party(rows, [term], speaker, party).select(term, speaker, F.col(party).alias("_party"))
    one = top_in(rows.groupBy(term, speaker).agg(F.count("*").alias("n")), [term], [F.desc("n"), F.col(speaker)], n)
    one = one.join(main, [term, speaker]).select(term, F.lit("all").alias("list"), "rank", speaker, F.col("_party").alias(party), "n")
    big = top_in(rows.groupBy(term, party).agg(F.count("*").alias("n")), [term], [F.desc("n"), F.col(party)], parties).where(F.col("n") >= least)
    own = rows.join(F.broadcast(big.select(term, party)), [term, party]).groupBy(term, party, speaker).agg(F.count("*").alias("n"))  # a few parties a term
    own = top_in(own, [term, party], [F.desc("n"), F.col(speaker)], each).select(term, F.col(party).alias("list"), "rank", speaker, party, "n")
    return one.unionByName(own)


def overview(rows: DataFrame, distinct: dict[str, str]) -> DataFrame:
    """One row: rows, columns, and the number of distinct values (nulls aside) of columns under the names given."""
    return rows.agg(F.count("*").alias("rows"), F.lit(len(rows.columns)).cast("bigint").alias("columns"), *[F.countDistinct(c).alias(n) for n, c in distinct.items()])
