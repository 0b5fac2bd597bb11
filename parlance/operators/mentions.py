"""Signed scoring of mentions (concept tagging is in parlance.operators.tagging)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Weight of a tone hit in the salience of a mention, and the score from which a mention has a sign.
TONE_WEIGHT, LABEL_AT = 0.35, 0.20


def balance(pos: Column, neg: Column) -> Column:
    return (pos - neg) / (pos + neg + F.lit(1.0))


def label(score: Column, at: float = LABEL_AT) -> Column:
    return F.when(score >= at, "positive").when(score <= -at, "negative").otherwise("mixed")


def score_columns(rows: DataFrame) -> DataFrame:
    """Adds salience, score (4 decimals) and label (from the score before rounding) to mention_count, pos, neg."""
    score = balance(F.col("pos"), F.col("neg"))
    salience = F.col("mention_count") + F.lit(TONE_WEIGHT) * (F.col("pos") + F.col("neg"))
    return rows.select("*", salience.alias("salience"), F.bround(score, 4).alias("score"), label(score).alias("label"))


def speech_labels(m: DataFrame) -> DataFrame:
    """Per speech: sums, number of concepts, score and label."""
    out = m.groupBy("speech_id").agg(
        F.countDistinct("concept").alias("concept_hit_count"), F.sum("mention_count").alias("mention_count"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg")
    )
    score = balance(F.col("pos"), F.col("neg"))
    return out.select("*", F.bround(score, 4).alias("score"), label(score).alias("label"))
