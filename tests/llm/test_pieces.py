import random

import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

from parlance.llm import piece_codec

LIB = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
TEXTS = [
    "", " ", "   two  spaces ", "Hello world", "it's\n\na\ttab", "été naïve Zürich", "日本語テキスト", "😀 emoji \U0001f9d1‍\U0001f680", "aaaaaaaaaaaaaaaaaaaaaaaa", "x" * 3000,
    "▁mark in text", "<s> </s> <unk> <0x41>", "0123456789 3.14159", "\u0000\u0001 control", "ａｂｃ ﬁ", "Donaudampfschifffahrtsgesellschaft", " nbsp", "=" * 70, "-----=====-----", " lead", "trail ",
]


def test_ids_equal_the_library():
    rng = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz  éüñß,.-'\n0123456789ABCDEF"
    many = TEXTS + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 200))) for _ in range(400)]
    c = piece_codec.Codec(public_tokenizers.path("piece_bpe_32k.model"))
    for t, ids in zip(many, c.encode(many)):
        assert ids.tolist() == LIB.encode(t), t
        assert c.decode(ids) == t.replace(piece_codec.MARK, " "), t


def test_shared_prefixes_do_not_change_the_result():
    c = piece_codec.Codec(public_tokenizers.path("piece_bpe_32k.model"))
    words = {f"{piece_codec.MARK}{a}{b}" for a in ("inter", "internation", "international", "in", "") for b in ("", "al", "isation", "s", "ly")} - {piece_codec.MARK}
    together = c.encode_words(words)
    assert all(c.encode_words({w})[w] == together[w] for w in words)


def test_whole_documents_round_trip(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    odd = spark.createDataFrame([(None, "null id", "a", "b", 1), (-1, None, None, None, None), (-2, "", "", "", 0)], docs.schema)
    docs = docs.unionByName(odd).withColumn("ids", F.lit("clash"))
    got = piece_codec.encode(docs)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in got.collect():
        assert (r.ids is None) == (texts[r.doc_id] is None)
        if r.ids is not None:
            assert r.same and r.n_ids == len(r.ids) and list(r.ids) == LIB.encode(texts[r.doc_id])
    assert {r.doc_id: r.text for r in piece_codec.decode(got).collect()} == texts
    assert piece_codec.encode(docs.limit(0)).count() == 0


def test_viterbi_scores_of_a_unigram_model(tmp_path):
    """A hand-made unigram vocabulary: the segmentation of the highest score, as the library finds it."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    rng = random.Random(9)
    m = proto.ModelProto()
    m.trainer_spec.model_type, m.trainer_spec.unk_id = 1, 0
    n = m.normalizer_spec
    n.name, n.add_dummy_prefix, n.remove_extra_whitespaces, n.escape_whitespaces = "identity", True, False, True
    kind = proto.ModelProto.SentencePiece.Type
    for piece, type_ in (("<unk>", "UNKNOWN"), ("<s>", "CONTROL"), ("</s>", "CONTROL")):
        m.pieces.add(piece=piece, score=0.0, type=kind.Value(type_))
    some = {"".join(rng.choice("abc") for _ in range(rng.randint(2, 5))) for _ in range(60)}
    for piece in sorted({*"abc", piece_codec.MARK, *some, *(piece_codec.MARK + x for x in list(some)[:25])}):
        m.pieces.add(piece=piece, score=-rng.uniform(1, 9) * (1 if len(piece) > 1 else 2), type=kind.Value("NORMAL"))
    path = tmp_path / "tiny.model"
    path.write_bytes(m.SerializeToString())
    lib, c = sentencepiece.SentencePieceProcessor(model_file=str(path)), piece_codec.Codec(str(path))
    texts = [" ".join("".join(rng.choice("abc") for _ in range(rng.randint(1, 14))) for _ in range(rng.randint(1, 6))) for _ in range(300)]
    for t, ids in zip(texts, c.encode(texts)):
        assert ids.tolist() == lib.encode(t), t
        assert c.decode(ids) == t
