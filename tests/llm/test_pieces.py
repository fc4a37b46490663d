import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2

from tests.llm.data import ODD, SF, clashing, docs
from tidemark.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
RAW = open(PATH, "rb").read()
BPE = pieces.PieceModel(RAW)
LIBRARY = sentencepiece.SentencePieceProcessor(model_proto=RAW)


def unigram(tokens):
    """A model of given pieces and scores; nothing is trained."""
    proto = sentencepiece_model_pb2.ModelProto()
    proto.trainer_spec.model_type = 1
    proto.trainer_spec.byte_fallback = True
    proto.normalizer_spec.name = "identity"
    proto.normalizer_spec.remove_extra_whitespaces = False
    for name, kind in (("<unk>", 2), ("<s>", 3), ("</s>", 3)):
        proto.pieces.add(piece=name, score=0, type=kind)
    for b in range(256):
        proto.pieces.add(piece=f"<0x{b:02X}>", score=0, type=6)
    for token, score in tokens:
        proto.pieces.add(piece=token, score=score, type=1)
    return proto.SerializeToString()


def lists(model, texts):
    ids, offsets = model.encode(texts)
    return [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:], strict=False)]


def random_texts(seed, n, alphabet):
    r = random.Random(seed)
    return ["".join(r.choices(alphabet, k=r.randrange(80))) for _ in range(n)]


def test_bpe_matches_the_library():
    texts = random_texts(1, 1500, " abcdefghinorst.,ñ漢😀\n\té▁") + ["", " ", "   ", "<s>", "a" * 300, "é" * 200 + " x", " " * 50]
    assert lists(BPE, texts) == LIBRARY.encode(texts)


def test_long_words_merge_alike(monkeypatch):
    words = [w for t in random_texts(2, 60, "abehinorst") if (w := t)]
    short = [BPE.encode_words([w])[0] for w in words]
    monkeypatch.setattr(pieces, "LONG", 0)
    assert [BPE.encode_words([w])[0] for w in words] == short


def test_unigram_viterbi_matches_the_library_and_brute_force():
    r = random.Random(3)
    tokens = {c: -r.randrange(16, 36) / 4 for c in "▁abcde"} | {"".join(r.choices("▁" if k % 4 == 0 else "abcde", k=1) + r.choices("abcde", k=r.randrange(1, 4))): -r.randrange(8, 36) / 4 for k in range(60)}
    raw = unigram(sorted(tokens.items()))
    model, library = pieces.PieceModel(raw), sentencepiece.SentencePieceProcessor(model_proto=raw)
    texts = random_texts(4, 400, "abcde  é")
    assert lists(model, texts) == library.encode(texts)

    def best(word):
        value = [0.0] + [-1e9] * len(word)
        for end in range(1, len(word) + 1):
            value[end] = max(value[s] + tokens.get(word[s:end], -1e9) for s in range(end))
        return value[-1]

    for word in ("▁abcabc", "dedede", "▁e", "cabbage"[:5]):
        (ids,) = model.encode_words([word])
        if all(c in tokens for c in word):
            assert sum(tokens[library.id_to_piece(i)] for i in ids) == pytest.approx(best(word), abs=1e-3)


def test_decoding_gives_texts_back():
    texts = random_texts(5, 300, " abcdñ漢😀\n\t") + ["", " ", "  a"]
    ids, offsets = BPE.encode(texts)
    assert BPE.decode(ids, offsets) == texts
    assert BPE.decode(np.array([0, 1, 2], dtype=np.int64), np.array([0, 3])) == [""]


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED", 5)
    model = pieces.PieceModel(RAW)
    texts = random_texts(6, 50, " abcdehinorst")
    assert lists(model, texts[:25]) + lists(model, texts[25:]) == LIBRARY.encode(texts)


def test_other_models_are_refused():
    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(RAW)
    proto.normalizer_spec.remove_extra_whitespaces = True
    with pytest.raises(ValueError):
        pieces.PieceModel(proto.SerializeToString())


def test_odd_documents(spark):
    got = pieces.encoded(clashing(docs(spark, ODD)), PATH).collect()
    key = lambda x: (str(x[0]), x[1])
    assert sorted(((r.doc_id, r.ids) for r in got), key=key) == sorted(((i, LIBRARY.encode(t or "")) for i, t in ODD), key=key)
    assert [r.doc_id for r in got if not r.round_trip] == [8]
    assert pieces.encoded(docs(spark, []), PATH).count() == 0
    rows = spark.createDataFrame([(1, LIBRARY.encode("a b")), (2, None), (3, [])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in pieces.decoded(rows, PATH).collect()} == {1: "a b", 2: None, 3: ""}


def test_query_matches_the_library(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = pieces.op10_piece_ids(spark, SF).collect()
    assert {r.doc_id: r.ids for r in got} == {i: LIBRARY.encode(t) for i, t in texts.items()} and all(r.round_trip for r in got)
