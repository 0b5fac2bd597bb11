"""Best-fit packing of tokenised documents into sequences of a fixed length.

Tokenise in tasks to pieces (a document longer than a sequence is cut; its first piece may be
shorter), range-sort the pieces by length and rank them exactly inside each length. Bulk-synchronous
best-fit then works on run lengths: open sequences are kept as runs of equal gaps. Lengths go from
long to short; a superstep gives all pieces of a length to the smallest gaps that hold them (the
successor), the piece of rank r to the r-th gap of the run, so no two pieces ever want the same gap;
runs get their new gaps, and the sweep repeats until no gap fits, when new sequences are opened. There
are at most ``seq_len`` lengths and ``seq_len`` gaps, so what the driver holds is bounded by
``seq_len`` and doesn't grow with the documents. Tasks then turn (length, rank) into a sequence and a
place by binary search in that plan.

Defined results
    null or empty text: the end token alone, one piece of length 1. null doc_id: kept as null.
    Repeated rows: each is packed. Empty table: empty result. Ties of length: by doc_id, then piece.
"""

from __future__ import annotations

import base64
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ranked, staged

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
_NAMES = [c.split()[0] for c in PIECES.split(", ")]
_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]


def byte_bpe(name: str = "byte_bpe_50k", eos_text: str = "<|endoftext|>") -> Callable[[list[str]], Iterator[np.ndarray]]:
    """Encoder of a public byte-level BPE vocabulary; runs in tasks. The ids are those of its .json file.

    The ranks file holds the same vocabulary and is several times faster; a text that holds the string of
    the special token, or a run of ``RUN`` characters of one kind (on which the fast way runs out of
    stack or takes quadratic time), goes through the .json tokenizer itself.
    """

    def encode(texts: list[str]) -> Iterator[np.ndarray]:
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        if not (kept := _LOADED.get(name)):
            with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            kept = _LOADED[name] = fast, Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))
        fast, slow = kept
        for t in texts:
            odd = eos_text in t or len(t) >= RUN and _LONG_RUN.search(t)
            ids = slow.encode(t, add_special_tokens=False).ids if odd else fast.encode_ordinary(t)
            yield np.array(ids, dtype="<u4")

    return encode


_LOADED: dict = {}
#: Characters of one kind in a row from which on a text takes the slow way.
RUN = 20_000
_LONG_RUN = re.compile(rf"\s{{{RUN}}}|[^\W\d_]{{{RUN}}}|\d{{{RUN}}}|(?:[^\w\s]|_){{{RUN}}}")


def pieces(docs: DataFrame, encode=None, seq_len: int = 2048, end_id: int = 0) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32."""
    encode = encode or byte_bpe()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for i, ids in zip(b["doc_id"].to_pylist(), encode([t or "" for t in b["text"].to_pylist()]), strict=True):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                first = len(ids) % seq_len or seq_len
                cuts = [0, *range(first, len(ids) + 1, seq_len)]
                rows += [(i, k, lo, hi - lo, zlib.crc32(ids[lo:hi].tobytes())) for k, (lo, hi) in enumerate(zip(cuts, cuts[1:]))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], names=_NAMES)

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


def plan(counts: dict[int, int], seq_len: int) -> np.ndarray:
    """Rows (length, first rank, pieces, first sequence, offset) of best-fit decreasing on run lengths."""
    runs: dict[int, list[list[int]]] = {}  # gap -> runs of sequences (first, how many)
    gaps: list[int] = []
    out, opened = [], 0

    def put(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in runs:
                runs[gap] = []
                insort(gaps, gap)
            runs[gap].append([first, n])

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect_left(gaps, length)
            if at < len(gaps):
                gap = gaps[at]
                first, n = runs[gap].pop()
                take = min(n, left)
                if take < n:
                    runs[gap].append([first + take, n - take])
                elif not runs[gap]:
                    del runs[gap], gaps[at]
                out.append((length, rank, take, first, seq_len - gap))
                put(gap - length, first, take)
            else:
                # no gap fits: sequences filled with pieces of this length, the last one with the rest
                take = max(1, left // (seq_len // length)) if left >= seq_len // length else 1
                out.append((length, rank, take, opened, 0))
                put(seq_len - length, opened, take)
                opened += take
            rank, left = rank + take, left - take
    return np.array(out, dtype=np.int64).reshape(-1, 5)


def pack(docs: DataFrame, encode=None, seq_len: int = 2048, end_id: int = 0) -> DataFrame:
    """A row per piece with its sequence_id and its offset there; offsets have no gaps from 0."""
    # written first: the range sort below reads it twice, and tokenising is what costs
    cut = staged(pieces(docs, encode, seq_len, end_id), "pieces")
    rows = ranked(cut, ["doc_id", "piece", "start", "ids_crc32"], within="length")
    counts = {r.length: r.n for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # seq_len rows at most
    steps = plan(counts, seq_len)
    steps = steps[np.lexsort((steps[:, 1], steps[:, 0]))]
    at = cut.sparkSession.sparkContext.broadcast(steps)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = at.value
        key = (s[:, 0] << 48) + s[:, 1]
        for b in batches:
            rank = b["rank"].to_numpy()
            k = np.searchsorted(key, (b["length"].to_numpy() << 48) + rank, side="right") - 1
            places = [pa.array(s[k, 3] + rank - s[k, 1]), pa.array(s[k, 4])]
            yield pa.RecordBatch.from_arrays([b[c] for c in _NAMES] + places, names=[*_NAMES, "sequence_id", "offset"])

    return rows.mapInArrow(place, PIECES + ", sequence_id bigint, offset bigint")
