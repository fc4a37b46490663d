"""Captured Redis-protocol traffic: requests to operations, and replies.

Values are None (a null string or array), bytes, int, str (a simple string), Failure, or lists of values.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from tidemark.sources.commands import parse_words

SCHEMA = "path string, place long, words array<string>, error string"


class Incomplete(Exception):
    """The bytes end within a value; more may follow."""


class Malformed(Exception):
    """The bytes are no value of the protocol."""


@dataclass(frozen=True)
class Failure:
    """An error reply."""

    text: str


def _line(data: bytes, at: int) -> tuple[bytes, int]:
    end = data.find(b"\r\n", at)
    if end < 0:
        raise Incomplete
    return data[at:end], end + 2


def _number(text: bytes) -> int:
    if not text.removeprefix(b"-").isdigit():
        raise Malformed(f"{text!r} is no number")
    return int(text)


def decode(data: bytes, at: int = 0) -> tuple[object, int]:
    """The value at a place, and the place after it."""
    if at >= len(data):
        raise Incomplete
    kind = data[at : at + 1]
    text, after = _line(data, at + 1)
    if kind == b"+":
        return text.decode(), after
    if kind == b"-":
        return Failure(text.decode()), after
    if kind == b":":
        return _number(text), after
    size = _number(text) if kind in (b"$", b"*") else None
    if size is None or size < -1:
        raise Malformed(f"{kind + text!r} begins no value")
    if size == -1:
        return None, after
    if kind == b"$":
        if len(data) < after + size + 2:
            raise Incomplete
        if data[after + size : after + size + 2] != b"\r\n":
            raise Malformed("a string doesn't end where it says")
        return data[after : after + size], after + size + 2
    items = []
    for _ in range(size):
        item, after = decode(data, after)
        items.append(item)
    return items, after


def encode(value: object) -> bytes:
    """The bytes of a value."""
    if value is None:
        return b"$-1\r\n"
    if isinstance(value, Failure):
        return b"-%s\r\n" % value.text.encode()
    if isinstance(value, int):
        return b":%d\r\n" % value
    if isinstance(value, str):
        return b"+%s\r\n" % value.encode()
    if isinstance(value, bytes):
        return b"$%d\r\n%s\r\n" % (len(value), value)
    return b"*%d\r\n%s" % (len(value), b"".join(map(encode, value)))


def requests(data: bytes) -> Iterator[dict]:
    """The words of each request of a connection; a last row with an error where it is cut short or malformed."""
    at = 0
    while at < len(data):
        try:
            value, at = decode(data, at)
            if not isinstance(value, list) or not all(isinstance(w, bytes) for w in value):
                raise Malformed("a request is an array of strings")
            yield {"words": [w.decode(errors="replace") for w in value]}
        except (Incomplete, Malformed) as e:
            yield {"error": str(e) or "incomplete"}
            return


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """The operations of all captured connections at path, in the order of each file."""
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in frames:
            for name, content in zip(part["path"], part["content"], strict=True):
                found = pd.DataFrame([{"path": name, "place": k} | r for k, r in enumerate(requests(bytes(content)))], columns=names)
                yield found.astype({"words": object, "error": object}).where(lambda d: d.notna(), None)

    captured = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(rows, SCHEMA)
    return parse_words(captured.withColumnRenamed("error", "damage"), "words")
