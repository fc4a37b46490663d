import random
import unicodedata

import public_tokenizers
from tokenizers import Tokenizer

from tests.llm.data import ODD, SF, clashing, docs
from tidemark.llm import tokens

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN
LIBRARY = Tokenizer.from_file(PATH)
COUNTER = tokens.WholeTokenCounter(PATH, PATTERN)


def want(text):
    return len(LIBRARY.encode(text or "", add_special_tokens=False).ids)


def test_whole_tokens_are_proved():
    assert len(COUNTER.whole) > 49_000
    assert all(want(t) == 1 for t in random.Random(1).sample(sorted(COUNTER.whole), 500))


def test_random_texts_of_all_scripts():
    r = random.Random(2)
    for _ in range(1500):
        text = "".join(chr(r.choice((r.randrange(32, 127), r.randrange(9, 0x600), r.randrange(0x600, 0xD800), r.randrange(0xE000, 0x110000), 32, 10))) for _ in range(r.randrange(40)))
        assert COUNTER.count(text) == want(text), text


def test_code_points_that_classes_may_disagree_on_go_to_the_library():
    for point in range(0x530, 0x110000, 7):
        c = chr(point)
        if unicodedata.category(c) != "Cs":
            assert COUNTER.count(f"a{c}1{c}!") == want(f"a{c}1{c}!"), hex(point)


def test_special_strings_and_blocks(monkeypatch):
    for text in ("<|endoftext|>", "a <|endoftext|> b<|endoftext|>", "<|endoftext", "  \n x", "can't we'll"):
        assert COUNTER.count(text) == want(text)
    long = "some words and " * 4000
    monkeypatch.setattr(tokens, "HELD", 100)
    assert COUNTER.count(long) == want(long)


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 3)
    text = "qwxz zxqw wqzx xzqw zzxx qqww"
    assert COUNTER.count(text) == COUNTER.count(text) == want(text)


def test_odd_documents(spark):
    got = tokens.count_tokens(clashing(docs(spark, ODD)), PATH, PATTERN).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == sorted((str(i), len((t or "").encode()), want(t)) for i, t in ODD)
    assert tokens.count_tokens(docs(spark, []), PATH, PATTERN).count() == 0


def test_query_matches_the_library(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = tokens.op7_token_counts(spark, SF).collect()
    assert {r.doc_id: r.n_tokens for r in got} == {i: want(t) for i, t in texts.items()}
    assert all(r.over_limit == (r.n_tokens > 512) for r in got)
