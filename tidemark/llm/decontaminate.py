"""Benchmark decontamination by an FM-index over each shard of the training texts.

A shard is a run of whole documents. Its index holds only the words that some benchmark window has; a run
of other words is one separator, since no window can cross it. All windows are searched backwards at once,
their occurrences located, and the hit words merged into spans.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import ASCII_LOWER, checkpoint, chunks, discard, quoted, read, stored, texts, unused
from tidemark.llm.fmindex import FMIndex

WINDOW = 10
SHARD_BYTES = 2 << 20
#: Bytes of benchmark text that one pass over the documents searches for, and the words of an item that one row of it holds.
BLOCK_BYTES, PIECE_WORDS = 8 << 20, 1 << 15

#: ASCII bytes that belong to no word become spaces; all bytes of other code points belong to words.
_WORDS = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in ASCII_LOWER)


def words(text: bytes | None) -> list[bytes]:
    """Runs of ASCII letters, digits and other code points, lower-cased in ASCII."""
    return text.translate(_WORDS).split() if text else []


@dataclass(frozen=True)
class Phrases:
    """The distinct windows of a block of items: symbols, one row each, padded with -1 at the start, and their lengths.

    The items that have window i are names[owners[firsts[i] : firsts[i + 1]]].
    """

    vocabulary: dict[bytes, int]
    windows: np.ndarray
    lengths: np.ndarray
    firsts: np.ndarray
    owners: np.ndarray
    names: list[str]

    def items(self, windows: np.ndarray) -> list[str]:
        """The sorted names of the items that have any of the windows."""
        found = [self.owners[self.firsts[w] : self.firsts[w + 1]] for w in windows.tolist()]
        return sorted({self.names[i] for i in np.unique(np.concatenate(found)).tolist()})


def phrases(items: list[tuple[object, bytes | None]], window: int = WINDOW) -> Phrases:
    """Windows of so many words, or the whole item where it has fewer; items without words have none."""
    vocabulary: dict[bytes, int] = {}
    names: dict[str, int] = {}
    rows, of = [np.zeros((0, window), dtype=np.int32)], [np.zeros(0, dtype=np.int64)]
    for item, text in items:
        own = np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in words(text)], dtype=np.int32)
        if len(own):
            padded = np.r_[np.full(max(0, window - len(own)), -1, dtype=np.int32), own]
            rows.append(np.lib.stride_tricks.sliding_window_view(padded, window))
            of.append(np.full(len(rows[-1]), names.setdefault(str(item), len(names))))
    flat = np.ascontiguousarray(np.concatenate(rows))
    _, first, which = np.unique(flat.view(np.dtype((np.void, 4 * window))).ravel(), return_index=True, return_inverse=True)
    pairs = np.unique(which * max(1, len(names)) + np.concatenate(of))
    windows = flat[first]
    firsts = np.searchsorted(pairs, np.arange(len(windows) + 1) * max(1, len(names)))
    return Phrases(vocabulary, windows, (windows >= 0).sum(axis=1), firsts, pairs % max(1, len(names)), list(names))


def _merged(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Spans of sorted starts, merged where they meet."""
    if not len(starts):
        return []
    reach = np.maximum.accumulate(ends)
    new = np.r_[True, starts[1:] > reach[:-1]]
    return list(zip(starts[new].tolist(), reach[np.r_[np.flatnonzero(new)[1:] - 1, len(starts) - 1]].tolist(), strict=True))


def hits(found: list[bytes | None], wanted: Phrases) -> tuple[list[int], list[list[tuple[int, int]]], list[list[str]]]:
    """For each text of a shard: its number of words, the merged spans of hit words, and the items found."""
    symbols, places, docs, sizes = [np.zeros(1, dtype=np.int64)], [np.zeros(1, dtype=np.int64)], [np.full(1, -1)], []
    get = wanted.vocabulary.get
    for i, text in enumerate(found):
        own = words(text)
        sizes.append(len(own))
        ids = np.array([get(w, 0) for w in own] + [0], dtype=np.int64)
        kept = (ids > 0) | np.r_[False, ids[:-1] > 0]
        symbols.append(ids[kept])
        places.append(np.flatnonzero(kept))
        docs.append(np.full(int(kept.sum()), i))
    spans: list[list[tuple[int, int]]] = [[] for _ in found]
    items: list[list[str]] = [[] for _ in found]
    text, place, doc = (np.concatenate(x) for x in (symbols, places, docs))
    if len(text) > 1 and len(wanted.windows):
        index = FMIndex(text, len(wanted.vocabulary) + 1)
        low, high = index.search(wanted.windows)
        n = np.maximum(high - low, 0)
        which = np.repeat(np.arange(len(n)), n)
        rows = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
        at = index.locate(rows)
        where, starts = doc[at], place[at]
        ends = starts + wanted.lengths[which]
        order = np.lexsort((starts, where))
        for i in np.unique(where).tolist():
            own = order[np.searchsorted(where[order], i) : np.searchsorted(where[order], i, side="right")]
            spans[i] = _merged(starts[own], ends[own])
            items[i] = wanted.items(np.unique(which[own]))
    return sizes, spans, items


def _blocks(benchmark: DataFrame, window: int) -> Iterator[list[tuple[str, bytes]]]:
    """The items in blocks of about BLOCK_BYTES of text, one block at least, each fetched when it is asked for.

    Executors cut items into pieces of PIECE_WORDS words that overlap by all but one word of a window, so that the pieces
    have the windows of the item and none is large. Of these a partition holds about a block.
    """
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                for item, text in zip(part["item"].to_pylist(), texts(part, "text"), strict=True):
                    own = words(text)
                    pieces = [b" ".join(own[k : k + PIECE_WORDS + window - 1]) for k in range(0, max(1, len(own) - window + 1), PIECE_WORDS)] if own else []
                    for k in range(0, len(pieces), 16):
                        yield pa.RecordBatch.from_pydict({"item": [item] * len(pieces[k : k + 16]), "piece": pa.array(pieces[k : k + 16], pa.binary())})

    pieces = checkpoint(rows.mapInArrow(cut, "item string, piece binary"))
    size = pieces.agg(F.coalesce(F.sum(F.octet_length("piece")), F.lit(0))).first()[0]
    if size > BLOCK_BYTES:
        pieces = checkpoint(pieces.repartition(-(-size // BLOCK_BYTES)))
    block: list[tuple[str, bytes]] = []
    held = 0
    for item, piece in pieces.toLocalIterator():
        if block and held + len(piece) > BLOCK_BYTES:
            yield block
            block, held = [], 0
        block.append((item, bytes(piece)))
        held += len(piece)
    yield block


FOUND = "n_words long, spans array<struct<start: long, end: long>>, items array<string>"


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text") -> DataFrame:
    """docs with n_words, spans and items: the merged spans of words that some window of the benchmark hits.

    A window is `window` consecutive words of an item, or the item if it has fewer words. Each row of docs
    is kept once and judged by itself, without a shuffle. A null text has no words; null ids, repeated rows
    and other columns stay, of which those named like the results are replaced; empty tables give no rows
    or no hits. An item of null id is named `null`. A block of bounded size of the benchmark is fetched, broadcast and
    searched for in one pass, and let go before the next; a larger benchmark takes a pass for each block, each adding
    to the spans and items that the one before has written to the checkpoint folder.
    """
    docs = docs.drop("n_words", "spans", "items")
    return _searched(docs, benchmark, window, text_col, None)


def _searched(docs: DataFrame, benchmark: DataFrame, window: int, text_col: str, names: dict[str, str] | None) -> DataFrame:
    """docs with what all blocks of the benchmark find; with names, the cleaned columns of those names instead, from the last pass."""
    kinds = dict(docs.dtypes)
    schema = ", ".join([*(f"{quoted(c)} {t}" for c, t in kinds.items()), FOUND])
    cleaned_schema = ", ".join(f"{quoted(c)} {kinds[old]}" for c, old in names.items()) if names else schema
    blocks = _blocks(benchmark, window)
    block, out, before = next(blocks), docs, []
    while True:
        wanted = docs.sparkSession.sparkContext.broadcast(phrases(block, window))
        block = next(blocks, None)
        if block is None:
            return out.mapInArrow(_pass(wanted, text_col, names), cleaned_schema)
        written: list[str] = []
        out = stored(out.mapInArrow(_pass(wanted, text_col, None), schema), written)
        wanted.destroy()
        discard(docs.sparkSession, before)
        before = written


def _pass(wanted, text_col: str, names: dict[str, str] | None):
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, text_col, SHARD_BYTES):
                sizes, spans, items = hits(texts(part, text_col), wanted.value)
                if "spans" in part.schema.names:
                    for i, (old, ids) in enumerate(zip(part["spans"].to_pylist(), part["items"].to_pylist(), strict=True)):
                        both = np.array(sorted([*((s["start"], s["end"]) for s in old), *spans[i]]), dtype=np.int64).reshape(-1, 2)
                        spans[i], items[i] = _merged(both[:, 0], both[:, 1]), sorted({*ids, *items[i]})
                if names is not None:
                    yield _cut(part, spans, names)
                    continue
                columns = {k: part[k] for k in part.schema.names if k not in ("n_words", "spans", "items")}
                columns["n_words"] = pa.array(sizes, pa.int64())
                columns["spans"] = pa.array([[{"start": s, "end": e} for s, e in x] for x in spans], span)
                columns["items"] = pa.array(items, pa.list_(pa.string()))
                yield pa.RecordBatch.from_pydict(columns)

    return passed


def _cut(part: pa.RecordBatch, spans: list[list[tuple[int, int]]], names: dict[str, str]) -> pa.RecordBatch:
    """The columns of those names, without the words of the spans; rows that lose all their words are left out."""
    new = [without(t, s) if s else t for t, s in zip(part["text"].to_pylist(), spans, strict=True)]
    columns = {k: part[old] for k, old in names.items()} | {"text": pa.array(new, part["text"].type)}
    if "n_chars" in names:
        old = part["n_chars"].to_pylist()
        columns["n_chars"] = pa.array([len(t) if s else n for t, s, n in zip(new, spans, old, strict=True)], part["n_chars"].type)
    kept = pa.array([not s or bool(words(t.encode())) for t, s in zip(new, spans, strict=True)], pa.bool_())
    return pa.RecordBatch.from_pydict(columns).filter(kept)


_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """text without the words of the spans and what stands between words of one span."""
    raw = text.encode()
    bounds = [m.span() for m in _WORD.finditer(raw)]
    kept, since = [], 0
    for start, end in spans:
        kept.append(raw[since : bounds[start][0]])
        since = bounds[end - 1][1]
    return b"".join([*kept, raw[since:]]).decode()


def cleaned(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs with its columns, the words of the benchmark's windows cut out of text; documents left without a word are dropped.

    n_chars, where docs has it, becomes the new text's. Rows that no window hits stay as they are, those of null, empty or
    blank text too; null ids and repeated rows stay, each judged by itself; an empty table stays empty and an empty
    benchmark changes nothing; columns of any name stay.
    """
    own = ("n_words", "spans", "items")
    aside = dict(zip(own, unused(docs.columns, *own), strict=True))
    aside = {c: aside[c.lower()] if c.lower() in own else c for c in docs.columns}
    return _searched(docs.withColumnsRenamed(aside), benchmark, WINDOW, "text", aside)


def op8_fm_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents and what the benchmark's windows hit in them."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = contaminated(docs, read(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]).alias("n_hit")
    return found.select(
        "doc_id", "n_words", n_hit, F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.size("items") > 0).alias("contaminated")
    )


OP8_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL
), items AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[k : k + least(len(w), 10) - 1], ' ') AS phrase
  FROM b, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS u(k) WHERE len(w) > 0
), sizes AS (SELECT DISTINCT size FROM items),
windows AS (
  SELECT r, k, size, array_to_string(w[k : k + size - 1], ' ') AS phrase
  FROM d, sizes, unnest(range(1, len(w) - size + 2)) AS u(k)
), found AS (
  SELECT r, k, size, item_id FROM windows JOIN items USING (size, phrase)
), hit AS (
  SELECT r, count(DISTINCT k + j) AS n_hit FROM (SELECT DISTINCT r, k, size FROM found), unnest(range(0, size)) AS u(j) GROUP BY r
), named AS (
  SELECT r, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
  FROM (SELECT DISTINCT r, item_id FROM found) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN named USING (r)
"""
