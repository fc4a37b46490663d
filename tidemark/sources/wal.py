"""Write-ahead logs in their binary form: blocks of entries with lengths and checksums.

A block is a 32-bit length, that many bytes of entries, and their MurmurHash3 with seed 0, big-endian. An
entry is a packed key, a 64-bit segment id, and for a pending item two 48-bit times, a 32-bit count, and a
value behind its 32-bit length.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from tidemark.functions.binary import murmur3_32, pack_key, unpack_key

SCHEMA = "path string, place long, kind string, id long, deadline_ms long, enqueue_ms long, requeue_ms long, dequeue_count int, value binary, segment_id long, error string"
TRUNCATED, CHECKSUM = "Truncated", "Checksum"


def encode(entries: list[dict]) -> bytes:
    """One block of entries."""
    body = bytearray()
    for e in entries:
        gone = e["kind"] == "tombstone"
        body += pack_key(e["deadline_ms"], e["id"], gone) + struct.pack(">Q", e["segment_id"])
        if not gone:
            body += e["enqueue_ms"].to_bytes(6, "big", signed=True) + e["requeue_ms"].to_bytes(6, "big", signed=True)
            body += struct.pack(">II", e["dequeue_count"], len(e["value"])) + e["value"]
    return struct.pack(">I", len(body)) + bytes(body) + struct.pack(">I", murmur3_32(bytes(body)))


def _entries(body: bytes) -> Iterator[dict]:
    at = 0
    while at < len(body):
        deadline, id_, gone = unpack_key(body[at : at + 16])
        (segment,) = struct.unpack_from(">Q", body, at + 16)
        out = {"kind": "tombstone" if gone else "pending", "id": id_, "deadline_ms": deadline, "segment_id": segment}
        at += 24
        if not gone:
            count, size = struct.unpack_from(">II", body, at + 12)
            out |= {"enqueue_ms": int.from_bytes(body[at : at + 6], "big", signed=True), "requeue_ms": int.from_bytes(body[at + 6 : at + 12], "big", signed=True)}
            out |= {"dequeue_count": count, "value": body[at + 20 : at + 20 + size]}
            at += 20 + size
        yield out


def decode(data: bytes) -> Iterator[dict]:
    """The entries of a log, and a last row with an error where a block is cut short or damaged."""
    at = 0
    while at < len(data):
        size = int.from_bytes(data[at : at + 4], "big")
        body, check = data[at + 4 : at + 4 + size], data[at + 4 + size : at + 8 + size]
        if len(data) - at < 4 or len(check) < 4:
            yield {"error": TRUNCATED}
            return
        if int.from_bytes(check, "big") != murmur3_32(body):
            yield {"error": CHECKSUM}
            return
        yield from _entries(body)
        at += 8 + size


def read_wal(spark: SparkSession, path: str) -> DataFrame:
    """The entries of all logs at path, in the order of each file; a damaged file ends with a row that says how."""
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in frames:
            for name, content in zip(part["path"], part["content"], strict=True):
                found = pd.DataFrame([{"path": name, "place": k} | e for k, e in enumerate(decode(bytes(content)))], columns=names).astype(object)
                yield found.where(found.notna(), None)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(rows, SCHEMA)
