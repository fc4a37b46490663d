"""Chat formatting by a declarative template and a finite-state machine over roles.

A template names its marks, its escape character, the moves of the machine and the roles whose text is
trained on. Formatting streams over the sorted turns and keeps one machine state, so its memory does not
grow with a conversation, however long.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import read

INVALID = "invalid"


@dataclass(frozen=True)
class Template:
    """Marks, escape and machine of a chat format.

    A turn reads: opening, role, saying, text, closing. Each mark must begin with a character that occurs
    in no mark again; so no text before a mark can complete another mark with it, and an escape character
    before every mark (and every escape character) inside a text makes the format reversible.
    """

    opening: str = "<turn>"
    saying: str = "<say>"
    closing: str = "</turn>"
    escape: str = "\\"
    start: str = "start"
    moves: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "told",
            ("start", "user"): "asked",
            ("told", "user"): "asked",
            ("asked", "assistant"): "answered",
            ("answered", "user"): "asked",
        }
    )
    accepting: frozenset[str] = frozenset({"answered"})
    loss_roles: frozenset[str] = frozenset({"assistant"})

    def __post_init__(self) -> None:
        for mark in self.marks:
            if not mark or self.escape in mark or any(mark[0] in other[1:] for other in self.marks):
                raise ValueError(f"{mark!r} can't be told apart from text")
        if len(self.escape) != 1 or len(set(self.marks)) != 3:
            raise ValueError("one escape character and three different marks are needed")

    @property
    def marks(self) -> tuple[str, str, str]:
        return self.opening, self.saying, self.closing

    def hidden(self, text: str) -> str:
        """text with its control strings escaped."""
        controls = "|".join(re.escape(x) for x in (self.escape, *self.marks))
        return re.sub(controls, lambda m: self.escape + m[0], text)

    def shown(self, text: str) -> str:
        """The text that hidden() was given."""
        return re.sub(re.escape(self.escape) + "(.)", r"\1", text, flags=re.S)

    def move(self, state: str, role: str) -> str:
        return self.moves.get((state, role), INVALID)

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        """The turn's text in order, each piece with its loss flag."""
        return [(self.opening + self.hidden(role) + self.saying, False), (self.hidden(text), role in self.loss_roles), (self.closing, False)]

    def turns(self, formatted: str) -> list[tuple[str, str]]:
        """The roles and texts of formatted turns; ValueError if it isn't a row of whole turns."""
        controls = re.compile("|".join(["(?P<kept>" + re.escape(self.escape) + ".)", *(re.escape(x) for x in self.marks)]), re.S)
        found, parts, wanted, since = [], [], 0, 0
        for m in controls.finditer(formatted):
            if m["kept"]:
                continue
            if m[0] != self.marks[wanted] or (wanted == 0 and m.start() != since):
                raise ValueError(f"{m[0]!r} at {m.start()} is out of place")
            if wanted:
                parts.append(self.shown(formatted[since : m.start()]))
            since, wanted = m.end(), (wanted + 1) % 3
            if wanted == 0:
                found.append((parts[0], parts[1]))
                parts = []
        if wanted or since != len(formatted):
            raise ValueError("a turn isn't closed")
        return found


FORMATTED = "conv_id {}, turn {}, segments array<struct<text: string, loss: boolean>>, state string"


def format_turns(turns: DataFrame, template: Template) -> DataFrame:
    """Formatted turns: conv_id, turn, segments with loss flags, and the machine's state after the turn.

    Turns go in order of turn, then role and text where turns tie; equal rows are turns of their own. A
    null role or text counts as empty, a null conv_id as a conversation, a null turn comes first. A turn
    that the machine has no move for, and all after it, have the state `invalid` but are formatted all the
    same. An empty table gives no rows; other columns are ignored.

    The rows of a conversation follow each other within a partition: readers need no further shuffle. One
    task streams a conversation, since its order is one chain; it holds a batch and one state.
    """
    kinds = dict(turns.dtypes)
    ordered = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = ordered.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = object(), template.start
        segment = pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())]))
        for batch in batches:
            segments, states = [], []
            for conv, role, text in zip(batch["conv_id"].to_pylist(), batch["role"].to_pylist(), batch["text"].to_pylist(), strict=True):
                state = template.move(state if conv == last else template.start, role)
                last = conv
                segments.append([{"text": t, "loss": f} for t, f in template.segments(role, text)])
                states.append(state)
            yield pa.RecordBatch.from_pydict({"conv_id": batch["conv_id"], "turn": batch["turn"], "segments": pa.array(segments, segment), "state": pa.array(states, pa.string())})

    return ordered.mapInArrow(rows, FORMATTED.format(kinds["conv_id"], kinds["turn"]))


class _Digest:
    """What is read back of one conversation."""

    def __init__(self, conv: object) -> None:
        self.conv, self.n_turns, self.loss_chars, self.chars, self.state = conv, 0, 0, 0, ""
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, template: Template, segments: list[dict], state: str) -> None:
        formatted = "".join(s["text"] for s in segments)
        for role, text in template.turns(formatted):
            self.n_turns += 1
            self.turns.update(f"{role}\n{text}\n".encode())
        for s in segments:
            if s["loss"]:
                text = template.shown(s["text"])
                self.loss_chars += len(text)
                self.loss.update(text.encode())
        self.chars += len(formatted)
        self.state = state


def read_back(formatted: DataFrame, template: Template) -> DataFrame:
    """A row for each conversation of format_turns(), from its output text and loss flags alone.

    turns_sha256 is over role, newline, text, newline of each turn; loss_sha256 over all text under the
    loss flags; both unescaped. valid: the machine ended in an accepting state.
    """
    kind = dict(formatted.dtypes)["conv_id"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, done = None, []

        def made(schema: pa.DataType) -> pa.RecordBatch:
            out = {
                "conv_id": pa.array([d.conv for d in done], schema),
                "n_turns": pa.array([d.n_turns for d in done], pa.int64()),
                "turns_sha256": pa.array([d.turns.hexdigest() for d in done], pa.string()),
                "loss_chars": pa.array([d.loss_chars for d in done], pa.int64()),
                "loss_sha256": pa.array([d.loss.hexdigest() for d in done], pa.string()),
                "formatted_chars": pa.array([d.chars for d in done], pa.int64()),
                "valid": pa.array([d.state in template.accepting for d in done], pa.bool_()),
            }
            done.clear()
            return pa.RecordBatch.from_pydict(out)

        schema = None
        for batch in batches:
            schema = batch["conv_id"].type
            for conv, segments, state in zip(batch["conv_id"].to_pylist(), batch["segments"].to_pylist(), batch["state"].to_pylist(), strict=True):
                if open_ is None or open_.conv != conv:
                    if open_ is not None:
                        done.append(open_)
                    open_ = _Digest(conv)
                open_.add(template, segments, state)
            yield made(schema)
        if open_ is not None:
            done.append(open_)
            yield made(schema)

    return formatted.mapInArrow(
        rows, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"
    )


#: The conversation that the query adds: its texts hold the marks of common formats.
PROBE = -7, "\\### Assistant: </turn> ok"


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and the probe, formatted and read back."""
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(PROBE[0], i, role, PROBE[1]) for i, role in enumerate(("user", "assistant"))], "conv_id long, turn long, role string, text string")
    template = Template()
    return read_back(format_turns(turns.unionByName(probe), template), template)


OP1_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), marked AS (
  SELECT *, regexp_replace(role, '(\\|<turn>|<say>|</turn>)', '\\\1', 'g') AS hidden_role,
         regexp_replace(text, '(\\|<turn>|<say>|</turn>)', '\\\1', 'g') AS hidden_text,
         CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' ELSE 'x' END AS letter
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(hidden_role) + length(hidden_text) + length('<turn><say></turn>')) AS BIGINT) AS formatted_chars,
       regexp_full_match(string_agg(letter, '' ORDER BY turn, role, text), 's?(ua)+') AS valid
FROM marked GROUP BY conv_id
"""
