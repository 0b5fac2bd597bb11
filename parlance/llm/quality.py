"""Quality by importance: the ratio of hashed n-gram generative models for target and raw text.

The raw model counts the hashed word and word-pair features of every document, the target model those
of labelled good documents. A document's log importance weight is the sum over its features of
log p(target) - log p(raw). The verdict compares the weight per feature with a threshold that separates
labelled good from labelled bad documents; a rejected document has the importance 0, a log weight of
minus infinity. The rest is importance-sampled without replacement by Gumbel top-k: the k largest of
log weight / ``temperature`` + Gumbel noise, which a hash of the document's id and row draws. With a
share of 1, k is the number of accepted documents: the top k are these and need no order (``keep_good``).

The labels used are at most ``MAX_LABELS`` rows in the order of a hash of doc_id, so the side that is
sent to tasks is bounded; raw counts cover all documents. A model has 2**BITS entries.

Defined results
    null or blank text: no feature, weight 0 and rejected, never sampled. null doc_id: kept as null.
    No usable label of a kind: every document with a feature is kept (the threshold is minus infinity).
    Conflicting labels of one document: the lowest quality counts. Repeated rows: one result each,
    with the same verdict and a draw of its own. Ties of the noisy weight: by doc_id. Empty table: empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, ranked, staged
from .langid import chunks

BITS = 16
BUCKETS = 1 << BITS
MAX_LABELS = 20_000
SMOOTH = 1.0
#: Features of ratio 1 that every document gets besides its own, so a text of a few words needs strong evidence.
SHRINK = 8
#: Share of the kept documents that Gumbel top-k samples.
SAMPLE = 0.5
TEMPERATURE = 1.0
SEED = 17
_POWERS = np.cumprod(np.full(4096, 0x9E3779B97F4A7C15, dtype=np.uint64))
_TABLES: dict = {}


def _classes() -> np.ndarray:
    """0 space, 1 letter or digit, 2 other, for each code point."""
    if "classes" not in _TABLES:
        _TABLES["classes"] = np.array([0 if (c := chr(i)).isspace() else 1 if c.isalnum() else 2 for i in range(0x110000)], dtype=np.uint8)
    return _TABLES["classes"]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The text's place in the list and the bucket of each token and of each pair of neighbouring tokens.

    A token is a run of letters and digits or a run of other signs; case counts.
    """
    joined = "".join(f"{t} " for t in texts)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kind = _classes()[codes]
    ends = np.cumsum([len(t) + 1 for t in texts])
    edge = np.flatnonzero(np.diff(kind, prepend=np.uint8(0), append=np.uint8(0)))
    start = edge[kind[np.minimum(edge, len(kind) - 1)] != 0]
    start = start[start < len(kind)]
    if not len(start):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    token = np.cumsum(np.bincount(start, minlength=len(kind))) - 1
    inside = np.flatnonzero(kind)
    t = token[inside]
    value = (codes[inside].astype(np.uint64) + np.uint64(1)) * _POWERS[(inside - start[t]) & 4095]
    h = _mix(np.add.reduceat(value, np.searchsorted(t, np.arange(len(start)))))
    doc = np.searchsorted(ends, start, side="right")
    same = doc[1:] == doc[:-1]
    pair = _mix(h[:-1] * np.uint64(0xD6E8FEB86659FD93) + h[1:])[same]
    shift = np.uint64(64 - BITS)
    return np.concatenate([doc, doc[1:][same]]), (np.concatenate([h, pair]) >> shift).astype(np.int64)


def _model(got: dict[str, np.ndarray]) -> np.ndarray:
    raw, target = got["raw"] + SMOOTH, got["target"] + SMOOTH
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def _counts(docs: DataFrame, good: str) -> dict[str, np.ndarray]:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for b in batches:
            is_good = np.array([x == 1 for x in b[good].to_pylist()])
            for start, some in chunks(b["text"].to_pylist()):
                d, h = features(some)
                raw += np.bincount(h, minlength=BUCKETS)
                target += np.bincount(h[is_good[start + d]], minlength=BUCKETS)
        k = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(raw[k]), pa.array(target[k])], names=["bucket", "raw", "target"])

    got = docs.select("text", good).mapInArrow(count, "bucket int, raw bigint, target bigint")
    t = got.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()  # BUCKETS rows at most
    out = {c: np.zeros(BUCKETS) for c in ("raw", "target")}
    for c in out:
        out[c][t["bucket"].to_numpy()] = t[c].to_numpy()
    return out


def _weights(docs: DataFrame, keep: list[str], model: np.ndarray) -> DataFrame:
    """``keep`` with n_features and log_weight."""
    ratio = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, w = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows)
            for start, some in chunks(b["text"].to_pylist()):
                d, h = features(some)
                n[start : start + len(some)] = np.bincount(d, minlength=len(some))
                w[start : start + len(some)] = np.bincount(d, ratio.value[h], minlength=len(some))
            yield pa.RecordBatch.from_arrays([*[b[c] for c in keep], pa.array(n), pa.array(w)], names=[*keep, "n_features", "log_weight"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, *(["text"] if "text" not in keep else [])).mapInArrow(run, f"{kinds}, n_features bigint, log_weight double")


def threshold(score: np.ndarray, good: np.ndarray) -> float:
    """The cut with the best balanced accuracy, half-way down to the next lower labelled score; -inf without both kinds."""
    if not good.any() or good.all():
        return float("-inf")
    order = np.argsort(score, kind="stable")
    s, g = score[order], good[order]
    lost, caught = np.cumsum(g) / g.sum(), np.cumsum(~g) / (~g).sum()
    value = np.append(0, caught - lost)
    value[1:-1][s[1:] == s[:-1]] = -1  # never between equal scores
    k = int(np.argmax(value))  # the k lowest are rejected
    return float("-inf") if k == 0 else float("inf") if k == len(s) else float((s[k - 1] + s[k]) / 2)


def fit(docs: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS) -> tuple[np.ndarray, float]:
    """The log ratio of the two models, and the threshold on the weight per feature."""
    some = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    some = some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labels).select(F.col("doc_id").alias("_doc"), F.col("quality").alias("_good"))
    # half of the labels make the target model, the other half the threshold
    some = F.broadcast(some.withColumn("_half", F.pmod(F.xxhash64("_doc", F.lit(SEED)), F.lit(2))))
    rows = docs.select("doc_id", "text").join(some, F.col("doc_id") == F.col("_doc"), "left")
    model = _model(_counts(rows.withColumn("_good", F.when(F.col("_half") == 0, F.col("_good"))), "_good"))
    held = _weights(rows.where("_half = 1"), ["_doc", "_good"], model).where("n_features > 0")
    # repeated rows of one document count once, so max_labels rows at most
    held = held.groupBy("_doc").agg(F.min("_good").alias("_good"), F.avg("n_features").alias("n_features"), F.avg("log_weight").alias("log_weight")).toArrow()
    score = held["log_weight"].to_numpy() / (held["n_features"].to_numpy() + SHRINK)
    return model, threshold(score, held["_good"].to_numpy() == 1)


def score(docs: DataFrame, model: np.ndarray, cut: float, keep: list[str]) -> DataFrame:
    """``keep`` with n_features, log_weight, weight (per feature) and kept."""
    rows = _weights(docs, keep, model)
    weight = F.col("log_weight") / (F.col("n_features") + SHRINK)
    return rows.select("*", weight.alias("weight")).withColumn("kept", (F.col("n_features") > 0) & (F.col("weight") >= cut))


def gumbel_top_k(rows: DataFrame, share: float = SAMPLE, temperature: float = TEMPERATURE, seed: int = SEED) -> DataFrame:
    """``rows`` (doc_id, log_weight, kept, ..) with sampled: the k largest noisy log weights of what is kept, k = ceil(share x kept)."""
    u = (F.shiftrightunsigned(F.xxhash64("doc_id", F.monotonically_increasing_id(), F.lit(seed)), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    noisy = F.when(F.col("kept"), F.col("log_weight") / temperature - F.log(-F.log(u))).otherwise(F.lit(float("-inf")))
    # scored and drawn once: the ranks read the rows several times
    scored = staged(rows.withColumn("_key", -noisy), "scored")
    placed = ranked(scored, ["_key", "doc_id"])
    k = scored.where("kept").agg(F.ceil(F.count("*") * share).alias("_k"))
    out = placed.crossJoin(F.broadcast(k))  # a table of one row
    return out.select(*rows.columns, (F.col("kept") & (F.col("rank") < F.col("_k"))).alias("sampled"))


def resample(docs: DataFrame, labels: DataFrame, share: float = SAMPLE, temperature: float = TEMPERATURE, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, log_weight, weight, kept and sampled: whether Gumbel top-k over the kept documents takes it."""
    return gumbel_top_k(score(docs, *fit(docs, labels), ["doc_id"]), share, temperature, seed)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier keeps, all columns as they were."""
    model, cut = fit(docs, labels)
    name = fresh(docs, "_kept")
    ratio = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def good(text):
        import pandas as pd

        kept = np.zeros(len(text), bool)
        for start, some in chunks([t for t in text.where(text.notna(), None)]):
            d, h = features(some)
            n, w = np.bincount(d, minlength=len(some)), np.bincount(d, ratio.value[h], minlength=len(some))
            kept[start : start + len(some)] = (n > 0) & (w / (n + SHRINK) >= cut)
        return pd.Series(kept)

    return docs.withColumn(name, good("text")).where(F.col(name)).drop(name)
