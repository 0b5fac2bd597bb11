"""Stopword audit of a corpus, and the distribution of labels and scores of speeches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.functions import text as T

from .mentions import balance, label

# Word endings that stand alone, words of procedure and of the transcript, further stopwords.
SUFFIX = "nin|nun|nün|nde|nda|den|dan|yle|yla|nci|inci|uncu|üncü|dır|dir|dur|dür|tir|tır|tur|tür"
PROCEDURE = ["sayin", "baskanim", "selamliyorum", "saygiyla", "alkislar", "siralarindan"]
ARTIFACT = ["otomatik", "mikrofon", "cihaz", "kapatildi"]
EXTRA = [
    "sayin", "baskan", "degerli", "milletvekilleri", "milletvekili", "tesekkur", "ediyorum", "ederim", "soz", "genel", "kurul", "meclis", "turkiye",
    "saygiyla", "selamliyorum", "efendim", "arkadaslar", "arkadaslarim", "arkadaslarimiz", "yilinda", "yili", "meclisin", "biliyor", "diyoruz",
    "tesekkurler", "katilmiyoruz",
]
ADDED, CHECKED = "add_stopword", "review_first"
#: Share of texts of a word that all terms use, and of one that many parties use.
COVERED, SHARED = 0.09, 0.04


def candidates(docs: DataFrame, k: int, known: list[str], terms: int = 7, parties: int = 10, often: int = 4000, stem: str = "text") -> DataFrame:
    """The k most frequent words of (doc_id, text, term, party) with their spread, category and recommendation.

    Tokens are counted per text first, so a frequent word is one row per text when it is shuffled.
    """
    t = docs.select("doc_id", "term", "party", F.explode(T.tokens(F.col(stem))).alias("word"))
    t = t.groupBy("word", "doc_id", "term", "party").agg(F.count("*").alias("n"))
    # spans from one row per (word, term, party), which are few
    t = t.groupBy("word", "term", "party").agg(F.sum("n").alias("n"), F.count("*").alias("docs"))
    w = t.groupBy("word").agg(F.sum("n").alias("term_freq"), F.sum("docs").alias("doc_freq"), F.countDistinct("term").alias("term_span"), F.countDistinct("party").alias("party_span"))
    w = w.orderBy(F.desc("term_freq"), "word").limit(k).crossJoin(F.broadcast(docs.agg(F.count("*").alias("_all"))))
    w = w.select("word", "term_freq", "doc_freq", "term_span", "party_span", (F.col("doc_freq") / F.col("_all")).alias("doc_ratio"))
    everywhere = F.col("term_span") == terms
    category = (
        F.when(F.col("word").rlike(f"^({SUFFIX})$"), "suffix_fragment").when(F.col("word").isin(known), "existing_stopword")
        .when(F.col("word").isin(PROCEDURE), "parliamentary_procedure").when(F.col("word").isin(ARTIFACT), "transcript_artifact")
        .when((F.col("doc_ratio") >= COVERED) & everywhere, "generic_high_coverage").when((F.col("party_span") >= parties) & (F.col("doc_ratio") >= SHARED), "cross_party_generic")
        .when((F.col("term_freq") >= often) & everywhere, "high_frequency_generic").otherwise("content_or_borderline")
    )
    advice = (
        F.when(F.col("category").isin("suffix_fragment", "parliamentary_procedure", "transcript_artifact"), ADDED).when(F.col("category") == "existing_stopword", "already_present")
        .when(F.col("category") == "content_or_borderline", "keep_for_now").otherwise(CHECKED)
    )
    return w.withColumn("category", category).withColumn("recommendation", advice)


def proposed(rows: DataFrame) -> DataFrame:
    """The candidates to add or to check, in order of priority and frequency."""
    some = rows.where(F.col("recommendation").isin(ADDED, CHECKED))
    return some.withColumn("priority", F.when(F.col("recommendation") == ADDED, 1).otherwise(2)).orderBy("priority", F.desc("term_freq"), F.desc("doc_freq"))


def stopwords(rows: DataFrame, base: list[str], extra: list[str] = EXTRA) -> DataFrame:
    """The base words, the further ones and those that the audit selects."""
    fixed = rows.sparkSession.createDataFrame([(w,) for w in [*base, *extra]], "word string")
    return proposed(rows).select("word").unionByName(fixed).distinct()


def summary(docs: DataFrame, sampled: DataFrame, rows: DataFrame, term: str = "term") -> DataFrame:
    """Per term the sampled rows, beside all rows, candidates and selected words."""
    one = docs.agg(F.count("*").alias("full_rows")).crossJoin(rows.agg(F.count("*").alias("candidates"), F.count_if(F.col("recommendation").isin(ADDED, CHECKED)).alias("selected")))
    return sampled.groupBy(term).agg(F.count("*").alias("sampled")).crossJoin(F.broadcast(one))  # one row


def label_stats(speeches: DataFrame, bins: int = 35) -> DataFrame:
    """(kind, name, n): speeches of each label, zero included, and of each of ``bins`` equal parts of the score's range."""
    s = speeches.select(balance(F.col("pos"), F.col("neg")).alias("score"))
    labels = s.groupBy(label(F.col("score")).alias("name")).agg(F.count("*").alias("n"))
    every = speeches.sparkSession.createDataFrame([("positive",), ("mixed",), ("negative",)], "name string")
    labels = every.join(labels, "name", "left").select(F.lit("label").alias("kind"), "name", F.coalesce("n", F.lit(0)).alias("n"))
    at = F.least(F.floor((F.col("score") + 1) / 2 * bins), F.lit(bins - 1)).cast("string")
    return labels.unionByName(s.groupBy(F.lit("bin").alias("kind"), at.alias("name")).agg(F.count("*").alias("n")))
