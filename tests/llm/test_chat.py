import hashlib

import pytest
from hypothesis import given
from hypothesis import strategies as st

from tidemark.llm import chat

T = chat.Template()
SCHEMA = "conv_id long, turn long, role string, text string"


@given(st.lists(st.tuples(st.text(), st.text(alphabet="\\<>/turnsay# x")), max_size=6))
def test_turns_read_back_what_segments_wrote(turns):
    formatted = "".join(s for role, text in turns for s, _ in T.segments(role, text))
    assert T.turns(formatted) == turns


def test_malformed_text_is_refused():
    for bad in ("<turn>user<say>x", "x<turn>user<say>x</turn>", "<say>x</turn>", "<turn>a<turn>b<say>c</turn>"):
        with pytest.raises(ValueError):
            T.turns(bad)


def test_ambiguous_templates_are_refused():
    for bad in ({"opening": "<a<"}, {"opening": "\\x"}, {"opening": ""}, {"opening": "</turn>"}):
        with pytest.raises(ValueError):
            chat.Template(**bad)


def by_hand(rows):
    convs = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: ((r[0] is not None, r[0]), (r[1] is not None, r[1] or 0), r[2] or "", r[3] or "")):
        convs.setdefault(conv, []).append((role or "", text or ""))
    out = {}
    for conv, turns in convs.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        digest = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        chars = sum(len(s) for r, t in turns for s, _ in T.segments(r, t))
        out[conv] = (len(turns), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest(), chars)
    return out


def test_odd_conversations(spark):
    rows = [(1, 0, "user", None), (1, 1, "assistant", "a" * 200_000), (2, None, None, "x"), (2, 0, "assistant", "</turn>\\"), (2, 0, "assistant", "</turn>\\"), (None, 3, "user", ""), (4, 1, "assistant", "é😀"), (4, 0, "user", "hi")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' as segments", "'y' as state")
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars) for r in chat.read_back(chat.format_turns(df, T), T).collect()}
    assert got == by_hand(rows)


def test_machine_marks_turn_order(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a"), (2, 0, "assistant", "a"), (3, 0, "user", "u"), (4, 0, "user", "u"), (4, 1, "user", "u"), (4, 2, "assistant", "a")]
    got = {r.conv_id: r.valid for r in chat.read_back(chat.format_turns(spark.createDataFrame(rows, SCHEMA), T), T).collect()}
    assert got == {1: True, 2: False, 3: False, 4: False}


def test_no_conversations(spark):
    assert chat.read_back(chat.format_turns(spark.createDataFrame([], SCHEMA), T), T).count() == 0


def test_query_has_the_probe(spark):
    row = chat.op1_chat_format(spark, "/root/testdata/sf0.001").where("conv_id = -7").first()
    assert (row.n_turns, row.loss_chars, row.valid) == (2, len(chat.PROBE[1]), True)
    assert row.loss_sha256 == hashlib.sha256(chat.PROBE[1].encode()).hexdigest()
