"""Token counts of a byte-level BPE with a shortcut for pre-tokens that are one token.

Which vocabulary strings encode alone as exactly one token is proved once, on the driver before the texts are read, by
encoding each of them; the workers get the proved strings, of which there are no more than the vocabulary has. A
pre-token that is such a string counts one without a merge; only the others are merged, each distinct one
once while it is remembered.
"""

from __future__ import annotations

import os
import unicodedata
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import chunks, read

#: Pre-tokens of a piece of text that are held at once, and merged ones that are remembered.
HELD = 1 << 18
REMEMBERED = 200_000
TEXT_BYTES = 1 << 20


class WholeTokenCounter:
    """Counts tokens as the tokenizer's library does, without added or special tokens of its own."""

    def __init__(self, path: str, pattern: str, proved: frozenset[str] | None = None) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.pattern = regex.compile(pattern)
        specials = sorted((t.content for t in self.library.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.special = regex.compile("|".join(regex.escape(s) for s in specials)) if specials else None
        self.whole = self._proved() if proved is None else proved
        self.merged: dict[str, int] = {}
        self.odd: dict[str, bool] = {}

    def _proved(self) -> frozenset[str]:
        """The vocabulary strings that alone are one pre-token and one token."""
        strings = []
        for i in range(self.library.get_vocab_size(with_added_tokens=False)):
            text = self.library.decode([i], skip_special_tokens=False)
            if text and "�" not in text and self.pattern.findall(text) == [text]:
                strings.append((i, text))
        encoded = self.library.encode_batch([text for _, text in strings], add_special_tokens=False)
        return frozenset(text for (i, text), e in zip(strings, encoded, strict=True) if e.ids == [i])

    def _unassigned(self, text: str) -> bool:
        """Whether text holds a code point that Unicode versions may class differently."""
        if text.isascii() or not (rare := regex.findall(r"[^\x00-՗]", text)):
            return False
        for c in set(rare):
            if c not in self.odd:
                self.odd[c] = unicodedata.category(c) in ("Cn", "Co")
        return any(self.odd[c] for c in set(rare))

    def _learn(self, pretokens: set[str]) -> None:
        rest = [p for p in pretokens if p not in self.whole and p not in self.merged]
        if len(self.merged) + len(rest) > REMEMBERED:
            self.merged.clear()
            rest = [p for p in pretokens if p not in self.whole]
        for p, e in zip(rest, self.library.encode_batch(rest, add_special_tokens=False), strict=True):
            self.merged[p] = len(e.ids)

    def _sum(self, pretokens: list[str]) -> int:
        self._learn(set(pretokens))
        whole, merged = self.whole, self.merged
        return sum(1 if p in whole else merged[p] for p in pretokens)

    def count(self, text: str) -> int:
        """The number of tokens of the whole text."""
        if self._unassigned(text):
            return len(self.library.encode(text, add_special_tokens=False).ids)
        pieces, n = [text], 0
        if self.special is not None and self.special.search(text):
            pieces = self.special.split(text)
            n = len(pieces) - 1
        for piece in pieces:
            found = self.pattern.finditer(piece) if len(piece) > 4 * HELD else None
            if found is None:
                n += self._sum(self.pattern.findall(piece))
            else:
                while block := [m[0] for m in islice(found, HELD)]:
                    n += self._sum(block)
        return n


def count_tokens(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and n_tokens of every row, each by itself, without a shuffle.

    A null text counts as empty, with 0 tokens; null ids and repeated rows stay; an empty table gives no
    rows; other columns are ignored. Texts may be of any length: a block of pre-tokens is held at a time.
    path is a vocabulary file that the driver and every executor have, pattern its pre-tokenizer's expression.
    """
    proved = docs.sparkSession.sparkContext.broadcast(_counter(path, pattern).whole)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path, pattern, proved.value)
        for batch in batches:
            for part in chunks(batch, "text", TEXT_BYTES):
                found = part["text"].to_pylist()
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": part["doc_id"],
                        "n_bytes": pc.cast(pc.binary_length(part["text"]), pa.int64()),
                        "n_tokens": pa.array([counter.count(t) for t in found], pa.int64()),
                    }
                )

    return rows.mapInArrow(counted, f"doc_id {dict(rows.dtypes)['doc_id']}, n_bytes long, n_tokens long")


_COUNTERS: dict[tuple[str, str], WholeTokenCounter] = {}


def _counter(path: str, pattern: str, proved: frozenset[str] | None = None) -> WholeTokenCounter:
    """The process's own counter, made once."""
    if (path, pattern) not in _COUNTERS:
        _COUNTERS[path, pattern] = WholeTokenCounter(path, pattern, proved)
    return _COUNTERS[path, pattern]


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens of all documents under byte_bpe_50k.json."""
    import public_tokenizers

    counts = count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return counts.withColumn("over_limit", F.col("n_tokens") > 512)
