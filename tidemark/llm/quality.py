"""Quality rules: document statistics, fixed base rules, and gradient-boosted trees for the verdict."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import trees
from tidemark.llm.common import chunks, read, texts

WINDOW = 8
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

_BYTES = np.arange(256)
_CLASSES = {
    "points": (_BYTES & 0xC0) != 0x80,
    "space": np.isin(_BYTES, list(b" \t\n\v\f\r")),
    "symbols": np.isin(_BYTES, list(b"#*$%&|<>")),
    "upper": (_BYTES >= 65) & (_BYTES <= 90),
    "digits": (_BYTES >= 48) & (_BYTES <= 57),
    "punctuation": np.isin(_BYTES, list(b".,;:!?")),
    "shouts": np.isin(_BYTES, list(b"!")),
    "lines": _BYTES == 10,
}
_MASKS = np.stack(list(_CLASSES.values()), axis=1).astype(np.int64)

#: The trees' features, and the sign by which each may move the odds that a text is good.
FEATURES = {
    "symbol_share": -1,
    "dup_line_share": -1,
    "repeat_share": -1,
    "upper_share": -1,
    "shout_share": -1,
    "digit_share": 0,
    "punctuation_share": 0,
    "word_length": 0,
    "distinct_share": 0,
    "top_word_share": -1,
    "words_per_line": 0,
    "log_words": 0,
}


def repeated_words(words: np.ndarray, docs: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Which words lie in a window of so many words that its document has twice or more.

    words and docs are numbers, in text order. Exact: windows get ranks by doubling, never hashes.
    """
    hit = np.zeros(len(words), dtype=bool)
    if len(words) < window:
        return hit
    ranks, length = words, 1
    while length < window:
        step = min(length, window - length)
        n = len(ranks) - step
        _, ranks = np.unique(ranks[:n] * (int(ranks.max()) + 1) + ranks[step : step + n], return_inverse=True)
        length += step
    inside = docs[: len(ranks)] == docs[window - 1 :]
    keys = docs[: len(ranks)] * (int(ranks.max()) + 1) + ranks
    starts = np.flatnonzero(inside)
    if not len(starts):
        return hit
    _, which, n = np.unique(keys[starts], return_inverse=True, return_counts=True)
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    again = starts[n[which] > 1]
    np.add.at(edge, again, 1)
    np.add.at(edge, again + window, -1)
    return np.cumsum(edge[:-1]) > 0


def statistics(found: list[bytes | None]) -> dict[str, np.ndarray]:
    """Counts of each whole text; a null one has none.

    Words are runs of bytes other than ASCII white space, as bytes.split() gives them; characters are
    code points.
    """
    n = len(found)
    bytes_of = np.zeros((n, 256), dtype=np.int64)
    lines, dup_lines, distinct, top = (np.zeros(n, dtype=np.int64) for _ in range(4))
    ids: dict[bytes, int] = {}
    numbers, n_words = [], np.zeros(n, dtype=np.int64)
    for i, text in enumerate(found):
        if not text:
            continue
        bytes_of[i] = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
        words = text.split()
        own = [ids.setdefault(w, len(ids)) for w in words]
        numbers.append(np.array(own, dtype=np.int64))
        n_words[i] = len(own)
        if own:
            per_word = Counter(own)
            distinct[i], top[i] = len(per_word), max(per_word.values())
        seen: set[bytes] = set()
        for line in text.split(b"\n"):
            if line.strip():
                lines[i] += 1
                dup_lines[i] += line in seen
                seen.add(line)
    all_words = np.concatenate(numbers) if numbers else np.zeros(0, dtype=np.int64)
    docs = np.repeat(np.arange(n), n_words)
    per_class = dict(zip(_CLASSES, (bytes_of @ _MASKS).T, strict=True))
    return {
        "n_words": n_words,
        "word_chars": per_class["points"] - per_class["space"],
        "n_symbols": per_class["symbols"],
        "n_dup_lines": dup_lines,
        "n_repeat_words": np.bincount(docs, repeated_words(all_words, docs), minlength=n).astype(np.int64),
        "lines": lines,
        "distinct": distinct,
        "top": top,
        "chars": per_class["points"],
        **{k: per_class[k] for k in ("upper", "digits", "punctuation", "shouts")},
    }


def features(counts: dict[str, np.ndarray]) -> np.ndarray:
    """The trees' rows, in the order of FEATURES."""
    words, chars, lines = (np.maximum(counts[k], 1) for k in ("n_words", "word_chars", "lines"))
    columns = [
        counts["n_symbols"] / chars,
        counts["n_dup_lines"] / lines,
        counts["n_repeat_words"] / words,
        counts["upper"] / chars,
        counts["shouts"] / chars,
        counts["digits"] / chars,
        counts["punctuation"] / chars,
        counts["word_chars"] / words,
        counts["distinct"] / words,
        counts["top"] / words,
        counts["n_words"] / lines,
        np.log1p(counts["n_words"]),
    ]
    return np.stack(columns, axis=1)


def _kind(df: DataFrame, column: str) -> str:
    return dict(df.dtypes)[column]


def train(docs: DataFrame, labels: DataFrame, sample: int = 20_000) -> trees.Forest:
    """Trees for labels.quality, fitted on at most `sample` labelled documents.

    The sample is the labelled ids with the lowest hashes, so it doesn't depend on order or partitions; of
    an id's labels the lowest counts, and of its documents the one of the least features. Labels of null id or quality
    are left out. So at most `sample` rows of a dozen numbers reach the driver, however often an id is repeated.
    """
    chosen = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    known = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    fields = ", ".join(f"f{i} double" for i in range(len(FEATURES)))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                values = features(statistics(texts(part, "text")))
                columns = {f"f{i}": pa.array(values[:, i]) for i in range(len(FEATURES))}
                yield pa.RecordBatch.from_pydict({"doc_id": part["doc_id"], "quality": part["quality"].cast(pa.int64())} | columns)

    rows = known.mapInArrow(measured, f"doc_id {_kind(docs, 'doc_id')}, quality long, {fields}")
    single = rows.groupBy("doc_id", "quality").agg(F.min(F.struct(*[f"f{i}" for i in range(len(FEATURES))])).alias("f"))
    rows = single.select("doc_id", "quality", "f.*").toPandas()
    rows = rows.sort_values(list(rows.columns))
    return trees.fit(rows.iloc[:, 2:].to_numpy(dtype=np.float64).reshape(-1, len(FEATURES)), rows["quality"].to_numpy(dtype=np.float64), np.array(list(FEATURES.values())))


def judge(docs: DataFrame, forest: trees.Forest, least: float = 0.5) -> DataFrame:
    """A row for each document: doc_id, COUNTS, base_failed, kept, quality_score.

    base_failed: under 20 words, or over 30 % of the words in repeated windows. kept: not base_failed, and
    the trees give at least the odds asked for. Each row is judged by itself, without a shuffle: a null or
    empty text has no words and fails; null ids and repeated rows stay; an empty table gives no rows; other
    columns are ignored.
    """

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                counts = statistics(texts(part, "text"))
                score = forest.probability(features(counts))
                failed = (counts["n_words"] < 20) | (100 * counts["n_repeat_words"] > 30 * counts["n_words"])
                out = {"doc_id": part["doc_id"]} | {k: pa.array(counts[k], pa.int64()) for k in COUNTS}
                yield pa.RecordBatch.from_pydict(out | {"base_failed": pa.array(failed), "kept": pa.array(~failed & (score >= least)), "quality_score": pa.array(score)})

    numbers = ", ".join(f"{k} long" for k in COUNTS)
    return docs.select("doc_id", "text").mapInArrow(judged, f"doc_id {_kind(docs, 'doc_id')}, {numbers}, base_failed boolean, kept boolean, quality_score double")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents judged by the base rules and trees fitted on the labelled ones."""
    docs = read(spark, sf_dir, "documents")
    return judge(docs, train(docs, read(spark, sf_dir, "labels")))
