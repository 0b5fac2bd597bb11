"""Concept tagging of texts: prefilter, windows around matches, tone hits in the windows, signed mentions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.functions import lexicon as L
from parlance.functions import text as T

from .mentions import score_columns

RADIUS = 90


def concept_windows(texts: DataFrame, concepts=L.CONCEPTS, prefilter: str | None = L.PREFILTER, radius: int = RADIUS, text: str = "text") -> DataFrame:
    """A row per match of a concept's pattern with the text around it. Narrow: no shuffle.

    The text is normalised already. Patterns are literals, so each is compiled once per task.
    """
    rows = texts.where(F.col(text).rlike(prefilter)) if prefilter else texts
    per = [
        F.struct(F.lit(slug).alias("concept"), F.lit(category).alias("category"), F.flatten(F.array(*[T.windows(F.col(text), p, radius) for p in patterns])).alias("windows"))
        for slug, _, category, patterns in concepts
    ]
    rows = rows.withColumn("_c", F.explode(F.array(*per)))
    return rows.select(*[c for c in texts.columns if c != text], F.col("_c.concept").alias("concept"), F.col("_c.category").alias("category"), F.explode("_c.windows").alias("window"))


def concept_edges(texts: DataFrame, key: list[str], positive=L.POSITIVE, negative=L.NEGATIVE, **options) -> DataFrame:
    """Signed mentions: per text and concept the windows and the tone hits summed over them."""
    w = concept_windows(texts, **options)
    w = w.select("*", T.pattern_hits(F.col("window"), positive).alias("_p"), T.pattern_hits(F.col("window"), negative).alias("_n"))
    sums = w.groupBy(*key, "concept", "category").agg(F.count("*").alias("mention_count"), F.sum("_p").cast("bigint").alias("pos"), F.sum("_n").cast("bigint").alias("neg"))
    return score_columns(sums)


def speech_filters(speeches: DataFrame, roles: list[str], start, stop, words: int = 6, chars: int = 40) -> tuple[DataFrame, DataFrame]:
    """The speeches that pass, and how many each step drops, in order: role, date, length."""
    role = F.col("party").isin(roles)
    date = ~F.coalesce(F.col("date").between(F.lit(start), F.lit(stop)), F.lit(False))
    short = (F.col("word_count") < words) | (F.length("text") < chars)
    step = F.when(role, "role").when(date, "date").when(short, "short").otherwise("kept")
    rows = speeches.withColumn("_step", step)
    return rows.where("_step = 'kept'").drop("_step"), rows.groupBy(F.col("_step").alias("step")).agg(F.count("*").alias("rows"))
