"""Directed mentions: windows around the names of other groups, their topic and their tone."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions import lexicon as L
from parlance.functions import text as T

from .mentions import TONE_WEIGHT, balance, label

RADIUS, TOPIC_WEIGHT, MOST_HITS = 120, 0.2, 5
_ESCAPED = str.maketrans({c: "\\" + c for c in r"\.^$*+?{}[]|()"})


def alias_pattern(alias: str) -> str:
    """A name as whole words, any white space between them."""
    return r"\b" + r"\s+".join(w.translate(_ESCAPED) for w in alias.split()) + r"\b"


def target_windows(texts: DataFrame, aliases: Mapping[str, Sequence[str]], source: str, text: str = "text", radius: int = RADIUS) -> DataFrame:
    """A row per match of a name of another group in a text of a group, with the text around it. Narrow: no shuffle.

    ``aliases`` has the normalised names of each group; texts of other sources give nothing.
    """
    of = lambda names: F.flatten(F.array(*[T.windows(F.col(text), alias_pattern(a), radius) for a in names]))
    none = F.array().cast("array<string>")
    per = [F.struct(F.lit(k).alias("target"), F.when(F.col(source) != k, of(v)).otherwise(none).alias("windows")) for k, v in aliases.items()]
    rows = texts.where(F.col(source).isin(list(aliases))).withColumn("_t", F.explode(F.array(*per)))
    return rows.select(*[c for c in texts.columns if c != text], F.col("_t.target").alias("target"), F.explode("_t.windows").alias("window"))


def _topic(hits: list[Column], concepts) -> tuple[Column, Column]:
    """The concept with most hits (the first of several) and its hits; null and 0 without a hit."""
    most = F.greatest(*hits, F.lit(0))
    topic = F.lit(None).cast("string")
    for h, (slug, *_) in reversed(list(zip(hits, concepts))):
        topic = F.when(h == most, slug).otherwise(topic)
    return F.when(most > 0, topic), most


def with_topic(windows: DataFrame, concepts=L.CONCEPTS, window: str = "window") -> DataFrame:
    """``windows`` with topic and topic_hits."""
    hits = [T.pattern_hits(F.col(window), patterns).alias(f"_h{i}") for i, (_, _, _, patterns) in enumerate(concepts)]
    rows = windows.select("*", *hits)
    topic, most = _topic([F.col(f"_h{i}") for i in range(len(hits))], concepts)
    return rows.withColumns({"topic": topic, "topic_hits": most}).drop(*[f"_h{i}" for i in range(len(hits))])


def directed_mentions(windows: DataFrame, keys: list[str], concepts=L.CONCEPTS, positive=L.POSITIVE, negative=L.NEGATIVE) -> DataFrame:
    """Per keys (text, source, target): mentions, tone hits, weights, score, label and the topic with most hits (ties: the first concept)."""
    rows = with_topic(windows, concepts)
    rows = rows.withColumns({"_p": T.pattern_hits(F.col("window"), positive), "_n": T.pattern_hits(F.col("window"), negative)})
    per = [F.sum(F.when(F.col("topic") == slug, F.col("topic_hits")).otherwise(0)).alias(f"_t{i}") for i, (slug, *_) in enumerate(concepts)]
    sums = rows.groupBy(*keys).agg(
        F.count("*").alias("mention_count"), F.sum("_p").cast("bigint").alias("pos"), F.sum("_n").cast("bigint").alias("neg"), F.sum("topic_hits").cast("bigint").alias("topic_hits"), *per
    )
    topic, _ = _topic([F.col(f"_t{i}") for i in range(len(per))], concepts)
    tone = F.col("pos") + F.col("neg")
    total = F.col("mention_count") + F.lit(TONE_WEIGHT) * tone + F.lit(TOPIC_WEIGHT) * F.least("topic_hits", F.lit(MOST_HITS))
    out = sums.select(*keys, "mention_count", "pos", "neg", "topic_hits", topic.alias("topic"), total.alias("total_weight"), balance(F.col("pos"), F.col("neg")).alias("frame_score"))
    out = out.withColumn("frame_label", label(F.col("frame_score")))
    signed = lambda part: F.when(F.col("frame_label") == "mixed", 0.0).otherwise(F.col("total_weight") * part)
    out = out.withColumns({"positive_weight": signed(F.greatest("frame_score", F.lit(0.0))), "negative_weight": signed(F.abs(F.least("frame_score", F.lit(0.0))))})
    return out.withColumn("net_weight", F.col("positive_weight") - F.col("negative_weight"))
