"""Language identification by multilingual mixture inference.

Training counts hashed letter trigrams of every training document by language; the model is one
smoothed distribution over ``BUCKETS`` buckets for each language. A document is a mixture: its
trigrams come from languages with unknown proportions, which expectation-maximisation estimates. The
language set is chosen by penalised likelihood: sets of the s most probable languages, s = 1, 2, .. as long as
the likelihood rises, pay half of log(trigrams) for each language beyond the first. The prediction is the set's most probable
language, the score its proportion. All arithmetic runs over many documents at once.

The model has BUCKETS x languages entries; it is counted in tasks, summed by a shuffle, and sent to
the tasks once. Languages are few (``MAX_LANGUAGES`` at most, or an error), so its size is bounded.

Defined results
    null text or a text without a letter: ``und`` with score 0. No training document: ``und`` for
    all. null doc_id: counts as the empty string in the fold rule. Ties: the first language in order.
    Repeated rows: one result each. Empty table: empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 15
BUCKETS = 1 << BITS
MAX_LANGUAGES = 256
SMOOTH = 0.05
ROUNDS, ROUNDS_PER_SET = 10, 4
#: Letters that are worked on at once in a task.
CHUNK = 1 << 20
_TABLES: dict = {}


def _letters() -> np.ndarray:
    if "letters" not in _TABLES:
        _TABLES["letters"] = np.array([chr(i).isalpha() for i in range(0x110000)])
    return _TABLES["letters"]


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For each letter of the lower-cased texts: the text's place in the list and the bucket of the trigram around it.

    What is no letter counts as a space, and so do both ends.
    """
    low = [f" {t.lower()} " for t in texts]
    codes = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    doc = np.repeat(np.arange(len(low), dtype=np.uint32), [len(t) for t in low])
    letter = _letters()[codes]
    c = np.where(letter, codes, 32).astype(np.uint32)
    mid = np.flatnonzero(letter)
    h = (c[mid - 1] * np.uint32(0x9E3779B1)) ^ (c[mid] * np.uint32(0x85EBCA6B) + np.uint32(0x27D4EB2F)) ^ (c[mid + 1] * np.uint32(0xC2B2AE35))
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return doc[mid], h >> np.uint32(32 - BITS)


def chunks(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about CHUNK characters: place of the first, the texts."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "") + 2
        if size >= CHUNK or i - start >= 60_000 or i == len(texts) - 1:
            yield start, [x or "" for x in texts[start : i + 1]]
            start, size = i + 1, 0


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def train(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order, and float32 probabilities [language, bucket], from (text, lang)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            langs, texts = np.array(b["lang"].to_pylist(), dtype=object), b["text"].to_pylist()
            for start, some in chunks(texts):
                d, h = trigrams(some)
                names, code = np.unique(langs[start : start + len(some)].astype(str), return_inverse=True)
                got = np.bincount(code[d] * BUCKETS + h, minlength=len(names) * BUCKETS).reshape(-1, BUCKETS)
                for k, name in enumerate(names):
                    sums[name] = sums.get(name, 0) + got[k]
        for name, n in sums.items():
            k = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * max(len(k), 1)), pa.array(k if len(k) else [0], pa.int32()), pa.array(n[k] if len(k) else [0], pa.int64())], names=["lang", "bucket", "n"])

    rows = docs.where("text is not null and lang is not null").select("text", "lang")
    got = rows.mapInArrow(count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    langs = sorted(r.lang for r in docs.where("text is not null and lang is not null").select("lang").distinct().limit(MAX_LANGUAGES + 1).collect())
    if len(langs) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    model = np.full((len(langs), BUCKETS), SMOOTH)
    # at most BUCKETS x languages rows
    t = got.select("lang", "bucket", "n").toArrow()
    if langs:
        model[np.searchsorted(langs, t["lang"].to_pylist()), t["bucket"].to_numpy()] += t["n"].to_numpy()
    return langs, (model / model.sum(1, keepdims=True)).astype(np.float32)


def infer(texts: list[str], model: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the predicted language (-1: no letter) and its proportion, for each text."""
    n_docs, n_lang = len(texts), len(model)
    best, score = np.full(n_docs, -1), np.zeros(n_docs)
    d, h = trigrams(texts)
    if not len(d) or not n_lang:
        return best, score
    keys, n = np.unique((d.astype(np.uint32 if n_docs <= 1 << (32 - BITS) else np.uint64) << BITS) | h, return_counts=True)
    doc, bucket, n = (keys >> BITS).astype(np.int64), keys & (BUCKETS - 1), n.astype(np.float32)
    present, starts = np.unique(doc, return_index=True)
    at = np.searchsorted(present, doc)
    p = model[:, bucket]
    total = np.add.reduceat(n, starts)

    def em(pi: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
        for r in range(rounds + 1):
            joint = p * pi[:, at]
            mass = joint.sum(0)
            if r == rounds:
                return pi, np.add.reduceat((n * np.log(mass)).astype(np.float64), starts)
            pi = np.add.reduceat(joint * (n / mass), starts, axis=1) / total

    pi, _ = em(np.full((n_lang, len(present)), 1 / n_lang, dtype=np.float32), ROUNDS)
    order = np.argsort(-pi, axis=0, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(n_lang)[:, None], axis=0)
    top, top_value, top_share, rising = None, None, None, np.ones(len(present), bool)
    for s in range(1, n_lang + 1):
        some = np.where(place < s, np.maximum(pi, 1e-6), 0).astype(np.float32)
        some, like = em(some / some.sum(0), 0 if s == 1 else ROUNDS_PER_SET)
        like = like - 0.5 * (s - 1) * np.log(total)
        lang, share = some.argmax(0), some.max(0)
        if top is None:
            top, top_value, top_share = lang, like, share
            continue
        # a text whose likelihood has fallen keeps its set
        rising &= like > top_value
        top, top_value, top_share = np.where(rising, lang, top), np.where(rising, like, top_value), np.where(rising, share, top_share)
        if not rising.any():
            break
    best[present], score[present] = top, np.clip(top_share, 0, 1)
    return best, score


def predict(docs: DataFrame, langs: list[str], model: np.ndarray) -> DataFrame:
    """doc_id, held_out, lang_pred, score; only the text decides."""
    known = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*langs, "und"], dtype=object)
        for b in batches:
            texts = b["text"].to_pylist()
            best, score = np.full(len(texts), -1), np.zeros(len(texts))
            for start, some in chunks(texts):
                best[start : start + len(some)], score[start : start + len(some)] = infer(some, known.value)
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["held_out"], pa.array(names[best], pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """Train on the documents of the two training folds, predict all."""
    return predict(docs, *train(docs.where(~held_out(F.col("doc_id"))).select("text", "lang")))
