"""Checksums of the binary formats over Arrow batches, and packed keys as column expressions."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

_MASK = 0xFFFFFFFF


def murmur3_32(data: bytes, seed: int = 0) -> int:
    """MurmurHash3 x86_32."""
    whole = len(data) // 4
    h = seed
    blocks = np.frombuffer(data, dtype="<u4", count=whole).astype(np.uint64) * 0xCC9E2D51 & _MASK
    blocks = ((blocks << np.uint64(15) | blocks >> np.uint64(17)) & _MASK) * 0x1B873593 & _MASK
    for k in blocks.tolist():
        h ^= k
        h = (h << 13 | h >> 19) & _MASK
        h = (h * 5 + 0xE6546B64) & _MASK
    k = int.from_bytes(data[4 * whole :], "little") * 0xCC9E2D51 & _MASK
    h ^= ((k << 15 | k >> 17) & _MASK) * 0x1B873593 & _MASK
    h ^= len(data)
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 1)):
        h = (h ^ h >> shift) * factor & _MASK
    return h


def murmur3_all(values: list[bytes]) -> np.ndarray:
    """murmur3_32() with seed 0 of many values, block by block over all that are as long."""
    sizes = np.array([len(v) for v in values], dtype=np.int64)
    order = np.argsort(-sizes, kind="stable")
    words = -(-sizes // 4)
    flat = np.frombuffer(b"".join(v + b"\0" * (-len(v) % 4) for v in values), dtype="<u4").astype(np.uint32)
    starts, whole = (np.cumsum(words) - words)[order], (sizes // 4)[order]
    h = np.zeros(len(values), dtype=np.uint32)

    def turned(k: np.ndarray) -> np.ndarray:
        k = k * np.uint32(0xCC9E2D51)
        return (k << np.uint32(15) | k >> np.uint32(17)) * np.uint32(0x1B873593)

    for block in range(int(whole[0]) if len(values) else 0):
        live = int(np.searchsorted(-whole, -block, side="left"))
        own = h[:live] ^ turned(flat[starts[:live] + block])
        h[:live] = (own << np.uint32(13) | own >> np.uint32(19)) * np.uint32(5) + np.uint32(0xE6546B64)
    tails = np.flatnonzero(sizes[order] % 4)
    h[tails] ^= turned(flat[starts[tails] + whole[tails]])
    h ^= sizes[order].astype(np.uint32)
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 1)):
        h = (h ^ h >> np.uint32(shift)) * np.uint32(factor)
    out = np.zeros(len(values), dtype=np.int64)
    out[order] = h
    return out


@pandas_udf(T.LongType())
def murmur3(data: pd.Series) -> pd.Series:
    """MurmurHash3 x86_32 with seed 0 of binary values; null for null."""
    out = pd.Series([None] * len(data), dtype="Int64")
    there = data.notna().to_numpy()
    out[there] = murmur3_all([bytes(d) for d in data[there]])
    return out


@pandas_udf(T.LongType())
def adler32(data: pd.Series) -> pd.Series:
    """Adler-32 of binary values; null for null."""
    return data.map(lambda d: None if d is None else zlib.adler32(bytes(d))).astype("Int64")


def pack_key(deadline_ms: int, id_: int, tombstone: bool) -> bytes:
    """16 bytes: 48 bits of signed deadline, 64 of id, 2 of kind, below 14 zero bits."""
    if not -(1 << 47) <= deadline_ms < 1 << 47 or not 0 <= id_ < 1 << 64:
        raise ValueError(f"a key can't hold {deadline_ms}, {id_}")
    return (((deadline_ms & (1 << 48) - 1) << 66) | (id_ << 2) | (3 if tombstone else 0)).to_bytes(16, "big")


def unpack_key(key: bytes) -> tuple[int, int, bool]:
    """The deadline, id and kind of a packed key."""
    packed = int.from_bytes(key, "big")
    kind = packed & 3
    if len(key) != 16 or kind not in (0, 3):
        raise ValueError("not a packed key")
    deadline = packed >> 66 & (1 << 48) - 1
    return deadline - (1 << 48 if deadline >> 47 else 0), packed >> 2 & (1 << 64) - 1, kind == 3


def packed_key(deadline_ms: Column, id_: Column, tombstone: Column) -> Column:
    """pack_key() of columns, as two longs in hexadecimal; an id or deadline that it can't hold is an error, null is null."""
    high = F.shiftleft(deadline_ms.bitwiseAND(F.lit((1 << 48) - 1)), 2)
    low = F.shiftleft(id_, 2).bitwiseOR(F.when(tombstone, F.lit(3)).otherwise(F.lit(0)).cast("long"))
    fits = deadline_ms.between(-(1 << 47), (1 << 47) - 1) & (id_ >= 0)
    digits = [F.lpad(F.hex(part), 16, "0") for part in (high.bitwiseOR(F.shiftrightunsigned(id_, 62)), low)]
    return F.when(~fits, F.raise_error(F.concat(F.lit("a key can't hold "), deadline_ms, F.lit(", "), id_))).otherwise(F.unhex(F.concat(*digits)))


def unpacked_key(key: Column) -> Column:
    """unpack_key() of a column as a struct (deadline_ms, id, tombstone); ids beyond a long come out negative."""
    high, low = (F.conv(F.substr(F.hex(key), F.lit(at), F.lit(16)), 16, -10).cast("long") for at in (1, 17))
    kind = low.bitwiseAND(F.lit(3))
    deadline = F.shiftright(F.shiftleft(F.shiftrightunsigned(high, 2), 16), 16)
    id_ = F.shiftrightunsigned(low, 2).bitwiseOR(F.shiftleft(high.bitwiseAND(F.lit(3)), 62))
    wrong = (F.octet_length(key) != 16) | kind.isin(1, 2)
    return F.when(wrong, F.raise_error(F.lit("not a packed key"))).otherwise(F.struct(deadline.alias("deadline_ms"), id_.alias("id"), (kind == 3).alias("tombstone")))
