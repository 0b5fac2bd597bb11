"""SentencePiece encoding and decoding by a shared-prefix forward pass.

Text becomes marked words (spaces are written as the mark, runs of marks lead a word). No piece of the
vocabulary has a mark after another character (this is checked), so words are encoded alone. Per
batch, the distinct words are sorted, which is the depth-first order of their trie; the forward states
of the common prefix with the previous word are reused and only the new characters are worked on.

A unigram model's forward state is the best score of a prefix with its last piece (Viterbi). The public
model is a BPE model, where the best-scoring segmentation isn't the encoding. There the state of a
prefix is the last piece of the encoding of that prefix, which is unique: the piece that may follow
the encoding of what is before it, that is, whose merge with the piece before doesn't happen in
another way. Backtracking from the end of a word gives the library's encoding exactly.

Characters outside the vocabulary become their UTF-8 byte pieces. Decoding joins pieces and bytes; the
mark that was put in front is dropped.

Defined results
    null text: null ids, null decoded text. Empty text: no ids, decodes to empty. A text that holds
    the mark itself decodes with spaces in its place (as the library does). Repeated rows: one result
    each. Empty table: empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

MARK = "▁"
_WORD = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
#: Characters that are split to words at once in a task, and words whose ids a task remembers.
CHUNK, REMEMBERED = 1 << 22, 1 << 18
_LOADED: dict = {}


class Codec:
    """Pieces, scores and the forward pass of one model; runs in tasks."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        with open(path, "rb") as f:
            data = f.read()
        model = proto.ModelProto.FromString(data)
        spec = model.normalizer_spec
        if spec.remove_extra_whitespaces or not spec.escape_whitespaces or spec.name != "identity":
            raise ValueError("only models with identity normalisation are supported")
        self.prefix = MARK if spec.add_dummy_prefix else ""
        self.library = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.bpe = model.trainer_spec.model_type == 2
        self.pieces = [p.piece for p in model.pieces]
        kind = model.pieces[0].Type
        normal = {kind.Value("NORMAL"), kind.Value("USER_DEFINED")}
        self.id = {p.piece: i for i, p in enumerate(model.pieces) if p.type in normal}
        self.score = [p.score for p in model.pieces]
        self.bytes = {int(p.piece[1:-1], 16): i for i, p in enumerate(model.pieces) if p.type == kind.Value("BYTE")}
        self.value = {i: b for b, i in self.bytes.items()}
        self.unknown = model.trainer_spec.unk_id
        if any(MARK in p.lstrip(MARK) for p in self.id):
            raise ValueError("a piece crosses words")
        if self.bpe:
            # a piece that merging its own characters doesn't give never ends an encoding
            self.usable = {p for p in self.id if len(p) == 1 or self.merge(list(p)) == [p]}
        else:
            self.usable = set(self.id)
        self.tails = {p[k:] for p in self.usable for k in range(len(p))}
        self.least = min(self.score) - 10
        self.valid: dict[tuple[str, str], bool] = {}
        self.known: dict[str, list[int]] = {}
        self.broken: set[str] = set()

    def merge(self, chars: list[str]) -> list[str]:
        """Pieces after merging the neighbours with the best score again and again; for short strings."""
        while len(chars) > 1:
            at = [(self.score[self.id[a + b]], -i) for i, (a, b) in enumerate(zip(chars, chars[1:])) if a + b in self.id]
            if not at:
                break
            i = -max(at)[1]
            chars[i : i + 2] = [chars[i] + chars[i + 1]]
        return chars

    def follows(self, a: str, b: str) -> bool:
        """Whether the encoding of a + b is just a, b."""
        if len(self.valid) > 1 << 19:
            self.valid.clear()
        got = self.valid[a, b] = self.merge(list(a + b)) == [a, b]
        return got

    def forward(self, word: str, shared: int, last: list[str], best: list[float]) -> None:
        """Fill the states of the prefixes longer than ``shared``."""
        del last[shared + 1 :], best[shared + 1 :]
        usable, tails, valid, follows = self.usable, self.tails, self.valid, self.follows
        for end in range(shared + 1, len(word) + 1):
            # the pieces that end here: suffixes are lengthened while some piece ends with them
            begin, found = end - 1, []
            piece = word[begin:end]
            while piece in tails:
                if piece in usable:
                    found.append((begin, piece))
                if not begin:
                    break
                begin -= 1
                piece = word[begin:end]
            if self.bpe:
                # exactly one of them may follow what is before it; longer ones are likelier
                state = word[end - 1]
                for begin, piece in reversed(found):
                    if not begin or (ok := valid.get((last[begin], piece))) or (ok is None and follows(last[begin], piece)):
                        state = piece
                        break
                last.append(state)
            else:
                options = [(best[b] + self.score[self.id[p]], p) for b, p in found]
                top, state = max(options, default=(best[end - 1] + self.least, word[end - 1]))
                last.append(state)
                best.append(top)

    def ids_of(self, piece: str) -> list[int]:
        if piece in self.id:
            return [self.id[piece]]
        return [self.bytes.get(b, self.unknown) for b in piece.encode("utf-8", "surrogatepass")] if self.bytes else [self.unknown]

    def encode_words(self, words: set[str]) -> dict[str, list[int]]:
        """Ids of distinct words: sorted order is the depth-first order of their trie."""
        out: dict[str, list[int]] = {}
        last, best, before = [""], [0.0], ""
        for word in sorted(words):
            shared = 0
            for x, y in zip(before, word):
                if x != y:
                    break
                shared += 1
            self.forward(word, shared, last, best)
            ids, end = [], len(word)
            while end:
                ids.append(self.ids_of(last[end]))
                end -= len(last[end])
            out[word] = [i for piece in reversed(ids) for i in piece]
            # decoding joins what words decode to, so a text comes back if each of its words does
            if self.text_of(out[word]) != word.replace(MARK, " "):
                self.broken.add(word)
            before = word
        return out

    def encode(self, texts: list[str | None]) -> list[np.ndarray | None]:
        out: list[np.ndarray | None] = []
        start = 0
        while start < len(texts):
            end, size = start, 0
            while end < len(texts) and (end == start or size < CHUNK):
                size += len(texts[end] or "")
                end += 1
            split = [_WORD.findall(self.prefix + t.replace(" ", MARK)) if t else [] for t in texts[start:end]]
            words = set(chain.from_iterable(split))
            new = words - self.known.keys()
            if len(self.known) + len(new) > REMEMBERED:
                self.known = {w: self.known[w] for w in words & self.known.keys()}
            self.known |= self.encode_words(new)
            ids_of = self.known.__getitem__
            for t, ws in zip(texts[start:end], split):
                out.append(None if t is None else np.fromiter(chain.from_iterable(map(ids_of, ws)), dtype=np.int32))
            start = end
        return out

    def returns(self, texts: list[str | None]) -> list[bool | None]:
        """Whether decoding the ids of each text gives the text (the mark counts as a space)."""
        if not self.broken:
            return [None if t is None else True for t in texts]
        return [None if t is None else self.decode(i) == t.replace(MARK, " ") for t, i in zip(texts, self.encode(texts))]

    def decode(self, ids: np.ndarray | None) -> str | None:
        if ids is None:
            return None
        text = self.text_of(ids.tolist())
        return text[1:] if self.prefix and text[:1] == " " else text

    def text_of(self, ids: list[int]) -> str:
        parts, value, pieces = [], self.value, self.pieces
        if value.keys().isdisjoint(ids):
            return "".join([pieces[i] for i in ids]).replace(MARK, " ")
        pending = bytearray()
        for i in ids:
            if i in value:
                pending.append(value[i])
                continue
            if pending:
                parts.append(pending.decode("utf-8", "replace"))
                pending.clear()
            parts.append(pieces[i])
        parts.append(pending.decode("utf-8", "replace"))
        return "".join(parts).replace(MARK, " ")


def codec(name: str = "piece_bpe_32k.model") -> Codec:
    if name not in _LOADED:
        import public_tokenizers

        _LOADED[name] = Codec(public_tokenizers.path(name))
    return _LOADED[name]


def encode(docs: DataFrame, name: str = "piece_bpe_32k.model") -> DataFrame:
    """doc_id, n_ids, ids and same: whether decoding the ids gives the text (the mark counts as a space).

    Decoding joins what words decode to, so ``same`` is settled per distinct word, each decoded once; only
    texts of a batch with a word that doesn't come back are decoded whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(name)
        for b in batches:
            texts = b["text"].to_pylist()
            ids = c.encode(texts)
            same = c.returns(texts)
            n = [None if i is None else len(i) for i in ids]
            arrays = [b["doc_id"], pa.array(n, pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(same, pa.bool_())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_ids", "ids", "same"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_ids bigint, ids array<int>, same boolean")


def decode(rows: DataFrame, name: str = "piece_bpe_32k.model") -> DataFrame:
    """doc_id and text from doc_id and ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(name)
        for b in batches:
            texts = [c.decode(None if i is None else np.array(i, dtype=np.int64)) for i in b["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(texts, pa.string())], names=["doc_id", "text"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")
