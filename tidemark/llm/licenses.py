"""Licence scans by conditional compression.

Lines with a cue word, and those between near ones, are candidate blocks, which are counted. Every template
holds a cue, so a notice lies within the template's length of one, on lines without a cue too. These words of
the text are compressed alone and with the template as a raw zstandard dictionary, unless more of the template's distinct
words are missing among them than may differ. The share of the template's information that the dictionary
saves ranks the templates, and those that rank are confirmed by the exact word edit distance between the
template and its best place.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import chunks, read, texts
from tidemark.llm.license_texts import TEMPLATES

#: Every template has a word with one of these in it.
CUES = re.compile(rb"licen[cs]e|permission|copyright|redistribut|unencumbered|spdx", re.I)
#: Lines between two lines with cues that still join them into one block.
GAP = 4
#: The share of a template's information that makes it a candidate, and of its words that may differ.
RANKED, DIFFERENT = 0.02, 0.1
LEVEL = 9

_WORD = re.compile(rb"[0-9a-z]+(?:\.[0-9]+)*")


@dataclass(frozen=True)
class Template:
    name: str
    words: tuple[bytes, ...]
    distinct: frozenset[bytes]
    compressor: zstandard.ZstdCompressor
    saving: int


def _normal(text: bytes) -> bytes:
    return b" ".join(_WORD.findall(text.lower()))


def _compressor(dictionary: bytes | None = None) -> zstandard.ZstdCompressor:
    raw = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if dictionary else None
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=raw, write_checksum=False, write_content_size=False, write_dict_id=False)


def templates(wordings: dict[str, list[str]] = TEMPLATES) -> list[Template]:
    """The wordings as dictionaries, and what each saves on its own text; wordings that are equal but for case and marks are one."""
    found, alone = {}, _compressor()
    for name in sorted(wordings):
        for wording in wordings[name]:
            text = _normal(wording.encode())
            own = _compressor(text)
            found.setdefault(text, Template(name, tuple(text.split()), frozenset(text.split()), own, max(1, len(alone.compress(text)) - len(own.compress(text)))))
    return list(found.values())


def blocks(text: bytes) -> list[tuple[int, int]]:
    """Byte spans of the candidate blocks: whole lines, from a line with a cue to the last near one."""
    found: list[list[int]] = []
    for m in CUES.finditer(text):
        start = text.rfind(b"\n", 0, m.start()) + 1
        end = text.find(b"\n", m.end())
        end = len(text) if end < 0 else end
        if found and text.count(b"\n", found[-1][1], start) <= GAP:
            found[-1][1] = max(end, found[-1][1])
        else:
            found.append([start, end])
    return [(s, e) for s, e in found]


def _ends(pattern: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The least word edits between the pattern and any run of words that ends at each place."""
    at = np.arange(len(words) + 1)
    row = np.zeros(len(words) + 1, dtype=np.int64)
    for k, word in enumerate(pattern):
        new = np.r_[k + 1, np.minimum(row[:-1] + (words != word), row[1:] + 1)]
        row = np.minimum.accumulate(new - at) + at
    return row


def differences(template: tuple[bytes, ...], words: list[bytes]) -> tuple[int, int, int]:
    """The word edits to the best place of the template in words, and that place [start, end); the first of ties."""
    numbers: dict[bytes, int] = {}
    pattern = np.array([numbers.setdefault(w, len(numbers)) for w in template])
    own = np.array([numbers.get(w, -1) for w in words], dtype=np.int64)
    row = _ends(pattern, own)
    end = int(np.argmin(row))
    back = _ends(pattern[::-1], own[:end][::-1])
    return int(row[end]), end - int(np.argmin(back)), end


def scan(text: bytes | None, known: list[Template]) -> tuple[int, list[tuple[str, int, int, int]]]:
    """The number of candidate blocks, and (licence, start, end, differences) of the notices, by bytes."""
    spans = blocks(text) if text else []
    places = [(m.start(), m.end(), m[0]) for m in _WORD.finditer(text.lower())] if spans else []
    found = [(known[i].name, places[s][0], places[e - 1][1], n) for s, e, n, i in _notices([w for _, _, w in places], known)]
    return len(spans), sorted(found, key=lambda f: (f[1], f[2], f[0]))


def _notices(words: list[bytes], known: list[Template]) -> list[tuple[int, int, int, int]]:
    """(start, end, differences, template) of the notices in a text's words; of overlapping ones the one with most words in common."""
    candidates, plain = set(), _compressor()
    for cue in (k for k, w in enumerate(words) if CUES.search(w)):
        alone: dict[int, tuple[bytes, int]] = {}
        near: dict[int, tuple[int, list[bytes], set[bytes]]] = {}
        ranked = []
        for i, t in enumerate(known):
            size = len(t.words)
            if size not in near:
                reach = size + int(DIFFERENT * size)
                low = max(0, cue - reach)
                own = words[low : cue + reach + 1]
                near[size] = low, own, set(own)
            low, own, distinct = near[size]
            if len(t.distinct - distinct) > DIFFERENT * size:
                continue
            if size not in alone:
                joined = b" ".join(own)
                alone[size] = joined, len(plain.compress(joined))
            joined, bare = alone[size]
            ranked.append(((bare - len(t.compressor.compress(joined))) / t.saving, i))
        for share, i in sorted(ranked, reverse=True):
            if share < RANKED:
                break
            low, own, _ = near[len(known[i].words)]
            n, start, end = differences(known[i].words, own)
            if n <= DIFFERENT * len(known[i].words):
                candidates.add((n - len(known[i].words), n, low + start, low + end, i))
    taken: list[tuple[int, int, int, int]] = []
    for _, n, start, end, i in sorted(candidates):
        if all(end <= s or e <= start for s, e, _, _ in taken):
            taken.append((start, end, n, i))
    return taken


SCHEMA = "n_blocks long, licenses array<string>, notices array<struct<license: string, start: long, end: long, differences: long>>"


def scanned(docs: DataFrame, wordings: dict[str, list[str]] = TEMPLATES) -> DataFrame:
    """doc_id, n_blocks, licenses, notices of each row, by itself, without a shuffle.

    notices have the byte span of each confirmed wording in the whole text and the words by which it
    differs; of overlapping ones the one with most words in common counts, then the closest. licenses are their distinct names in
    order. A null or blank text has none; null ids and repeated rows stay; an empty table gives no rows;
    other columns are ignored. Work grows with the cues, so texts of any length are scanned whole.
    """
    notice = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("differences", pa.int64())]))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = templates(wordings)
        for batch in batches:
            for part in chunks(batch, "text"):
                results = [scan(t, known) for t in texts(part, "text")]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": part["doc_id"],
                        "n_blocks": pa.array([n for n, _ in results], pa.int64()),
                        "licenses": pa.array([sorted({f[0] for f in found}) for _, found in results], pa.list_(pa.string())),
                        "notices": pa.array([[dict(zip(("license", "start", "end", "differences"), f, strict=True)) for f in found] for _, found in results], notice),
                    }
                )

    return docs.select("doc_id", "text").mapInArrow(made, f"doc_id {dict(docs.dtypes)['doc_id']}, {SCHEMA}")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence notices of all documents."""
    return scanned(read(spark, sf_dir, "documents"))
