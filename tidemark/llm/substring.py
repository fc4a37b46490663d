"""Substring dedup: paragraphs that repeat across documents, found by MinHash bands and by anchored windows.

Two kinds of paragraphs are compared. Lines of at least LEAST words, and runs of shorter lines without a blank one
between them that have as many together, are banded by MinHash over their five-word shingles; colliding ones are
verified by Jaccard similarity and clustered by components. Passages that start or end within a line are met by
windows of PARAGRAPH words that begin at anchors: an anchor is the least shingle hash among REACH neighbours, so every
passage of REACH - 1 + PARAGRAPH = LEAST words holds one window that is the same in each of its copies, wherever it
stands. Windows are the same where two independent hashes, of 96 bits together, are. The outermost windows of a removed run are
extended by the words beyond them, up to REACH - 1 on either side, as far as another document that stays has them too,
so that runs end where the passages do. Of a cluster, the paragraph of the least document and place stays, and the
others' words are removed.

A document is a doc_id with a text: rows that have both in common are one, rows of one doc_id with different texts
are several, and so are those of null id, which come after all others; of one doc_id, rows come in the order in which
they are read. In a run, `row` numbers the rows, and `u`, a hash of id and text, finds them again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import ASCII_LOWER, Numbers, checkpoint, chunks, discard, read, release, same, stored, texts, unused
from tidemark.llm.components import components
from tidemark.llm.minhash import SHINGLE, band_keys, mixed, runs, short, similar_links, word_shingles

LEAST, REACH, PARAGRAPH = 50, 15, 36
#: Rounds in which places beyond a run are compared with one first place; it changes the work, not the result.
LED = 2

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def _sliding(values: np.ndarray, length: int, pick) -> np.ndarray:
    """The least or largest of each run of `length` values."""
    done = 1
    while done < length:
        step = min(done, length - done)
        values = pick(values[: len(values) - step], values[step:])
        done += step
    return values


def paragraphs(found: list[bytes | None]) -> dict[str, list]:
    """For each text: n_words, 32 bits of each word as bytes, the starts and both hashes of its windows, and its paragraphs.

    A paragraph is (start, end, hash, band keys); places count words. Words are runs of bytes other than ASCII white
    space, lower-cased in ASCII. Each window of a text is listed once, with all its starts.
    """
    ids = Numbers()
    number = ids.__getitem__
    numbers: list[int] = []
    sizes: list[int] = []
    lines: list[list[tuple]] = [[] for _ in found]
    long_starts: list[int] = []
    long_ends: list[int] = []
    owners: list[tuple[int, int, int]] = []
    for i, text in enumerate(found):
        first = len(numbers)
        run: list[bytes] = []

        def close(run: list[bytes], end: int, i: int = i, first: int = first) -> None:
            if len(run) >= LEAST:
                long_starts.append(end - len(run))
                long_ends.append(end)
                owners.append((i, end - len(run) - first, xxhash.xxh64_intdigest(b" ".join(run), 5)))

        for line in (text or b"").translate(ASCII_LOWER).split(b"\n"):
            words = line.split()
            if run and not 0 < len(words) < LEAST:
                close(run, len(numbers))
                run = []
            numbers.extend(map(number, words))
            if len(words) >= LEAST:
                close(words, len(numbers))
            else:
                run += words
        close(run, len(numbers))
        sizes.append(len(numbers) - first)
    hashed = np.array([xxhash.xxh64_intdigest(w, 3) for w in ids], dtype=np.uint64)
    words = hashed[np.array(numbers, dtype=np.int64)] if numbers else np.zeros(0, dtype=np.uint64)
    docs = np.repeat(np.arange(len(found)), sizes)
    firsts = np.cumsum(sizes) - sizes
    starts: list[list[np.ndarray]] = [[]] * len(found)
    hashes: list[np.ndarray] = [np.zeros(0, dtype=np.uint64)] * len(found)
    checks: list[np.ndarray] = [np.zeros(0, dtype=np.int32)] * len(found)
    if len(words) >= LEAST:
        shingles = runs(words, SHINGLE) | np.uint64(1)
        least = _sliding(shingles, REACH, np.minimum)
        inside = docs[: len(least)] == docs[REACH - 1 + SHINGLE - 1 :]
        least = np.concatenate([np.zeros(REACH - 1, dtype=np.uint64), np.where(inside, least, np.uint64(0)), np.zeros(REACH - 1, dtype=np.uint64)])
        reached = _sliding(least, REACH, np.maximum)[: len(shingles)]
        anchors = np.flatnonzero(reached == shingles)
        anchors = anchors[anchors + PARAGRAPH <= len(words)]
        anchors = anchors[docs[anchors] == docs[anchors + PARAGRAPH - 1]]
        window, checked = runs(words, PARAGRAPH)[anchors], short(runs(mixed(words), PARAGRAPH)[anchors])
        order = np.lexsort((anchors, checked, window, docs[anchors]))
        of, window, checked, at = docs[anchors][order], window[order], checked[order], anchors[order]
        heads = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (window[1:] != window[:-1]) | (checked[1:] != checked[:-1])]) if len(at) else np.zeros(0, dtype=np.int64)
        places = np.split((at - firsts[of]).astype(np.int32), heads[1:]) if len(at) else []
        cuts = np.searchsorted(of[heads], np.arange(len(found) + 1))
        starts = [places[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        hashes = [window[heads[a:b]] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        checks = [checked[heads[a:b]] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        if owners:
            counts = np.array(long_ends) - np.array(long_starts) - SHINGLE + 1
            ends = np.cumsum(counts)
            at = np.arange(ends[-1]) - np.repeat(ends - counts, counts) + np.repeat(long_starts, counts)
            for (i, start, line), size, keys in zip(owners, counts + SHINGLE - 1, band_keys(shingles[at], counts), strict=True):
                lines[i].append((start, start + int(size), line, keys))
    cut_words = np.split(short(words), np.cumsum(sizes)[:-1]) if len(sizes) else []
    kept_words = [w.tobytes() if len(s) or own else None for w, s, own in zip(cut_words, starts, lines, strict=True)]
    return {"n_words": sizes, "words": kept_words, "starts": starts, "hashes": hashes, "checks": checks, "lines": lines}


_LINE = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("hash", pa.int64()), ("bands", pa.list_(pa.int64()))])
_PARTS = "u long, n_words long, words binary, starts array<array<int>>, hashes array<long>, checks array<int>, lines array<struct<start: int, end: int, hash: long, bands: array<long>>>"


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _u(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col), F.col(text_col))


def split(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, u, the paragraphs and a number `row` of its own of each row of docs, without a shuffle.

    The number holds once the result is stored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), _u(id_col, text_col).alias("u"), F.col(text_col).alias("text"))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text", 1 << 20):
                p = paragraphs(texts(part, "text"))
                lines = [[{"start": s, "end": e, "hash": _signed(h), "bands": b} for s, e, h, b in own] for own in p["lines"]]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": part["doc_id"],
                        "u": part["u"],
                        "n_words": pa.array(p["n_words"], pa.int64()),
                        "words": pa.array(p["words"], pa.binary()),
                        "starts": pa.array(p["starts"], pa.list_(pa.list_(pa.int32()))),
                        "hashes": pa.array([h.view(np.int64) for h in p["hashes"]], pa.list_(pa.int64())),
                        "checks": pa.array(p["checks"], pa.list_(pa.int32())),
                        "lines": pa.array(lines, pa.list_(_LINE)),
                    }
                )

    return rows.mapInArrow(made, f"doc_id {dict(rows.dtypes)['doc_id']}, {_PARTS}").withColumn("row", F.monotonically_increasing_id())


#: The order of documents, in which null ids are last.
_ORDER = "doc_id IS NULL AS no_id, doc_id, row"
_IS_LOW = "row = low.row"


def _several(rows: DataFrame, *keys: str) -> DataFrame:
    """The keys that several rows have."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").select(*keys)


def _extended(parts: DataFrame, again: DataFrame, removed: DataFrame, used: list[str]) -> DataFrame:
    """doc_id, row, start, end, kept_in: the outermost windows of removed runs with the words beyond them that repeat.

    again has all places (hash, check, doc_id, row, starts) of the windows that several rows have, removed those
    of the windows to remove. A run of LEAST words has a window within REACH - 1 words of either end, so no
    more words are looked at. A document's places with the same words beyond them are one. Each place of an outermost window
    is compared with the window's first place, which is the least document's. Places that have the next word too in common with each other agree with the first
    place equally far, so one key of the words up to there brings them together, with a first place of their own. Only
    those that still agree in one word more after LED such rounds are keyed by each further word. Of places with like words the least document's keeps them.
    """
    placed = F.expr("flatten(collect_list(transform(starts, s -> struct(s AS start, hash, check))))")
    own = removed.groupBy("row").agg(F.array_sort(placed).alias("w"))
    first = f"filter(w, (x, i) -> i = 0 OR w[greatest(i, 1) - 1].start + {PARAGRAPH} < x.start)"
    last = f"filter(w, (x, i) -> i = size(w) - 1 OR x.start + {PARAGRAPH} < w[least(i + 1, size(w) - 1)].start)"
    ends = own.select(F.explode(F.expr(f"concat(transform({first}, x -> struct(x.hash, x.check, true AS first)), transform({last}, x -> struct(x.hash, x.check, false AS first)))")).alias("e"))
    outer = ends.select("e.*").groupBy("hash", "check").agg(F.max("first").alias("first"), F.max(~F.col("first")).alias("last"))
    outer = stored(outer, used)
    places = again.join(outer, ["hash", "check"]).groupBy("row").agg(F.expr("flatten(collect_list(transform(starts, s -> struct(s AS start, hash, check, first, last))))").alias("places"))
    sides = F.expr(
        "concat("
        f"transform(filter(places, p -> p.first), p -> struct(p.hash, p.check, p.start, true AS left, substring(words, 4 * greatest(0, p.start - {REACH - 1}) + 1, 4 * least({REACH - 1}, p.start)) AS near)), "
        f"transform(filter(places, p -> p.last), p -> struct(p.hash, p.check, p.start, false AS left, substring(words, 4 * (p.start + {PARAGRAPH}) + 1, {4 * (REACH - 1)}) AS near)))"
    )
    beside = parts.select("doc_id", "row", "words").join(places, "row")
    sided = beside.select("doc_id", "row", F.explode(sides).alias("p")).select("doc_id", "row", "p.*")
    sided = sided.groupBy("doc_id", "row", "hash", "check", "left", "near").agg(F.collect_list("start").alias("starts"))
    sided = stored(sided.withColumn("place", F.xxhash64("hash", "check", "left", "near")), used)
    rows, ties = sided.drop("starts").withColumn("key", F.xxhash64("hash", "check", "left")), []
    beyond, away = F.expr("octet_length(near) div 4"), "if(left, -4 * i, 4 * i - 3)"
    other = F.expr(f"array_position(transform(sequence(1, {REACH}), i -> substring(near, {away}, 4) = substring(low.near, {away}, 4) AND i <= octet_length(near) div 4), false)")

    def key(words: str) -> Column:
        """The window, and so many words that stand next to it."""
        return F.expr(f"xxhash64(hash, check, left, {words}, substring(near, if(left, -4 * ({words}), 1), 4 * ({words})))")

    for _ in range(LED):
        leads = rows.groupBy("key").agg(F.expr(f"min(struct({_ORDER}, place, near))").alias("low"))
        alike = rows.join(leads, "key").withColumn("alike", (other - 1).cast("int"))
        alike = stored(alike.select("hash", "check", "left", "doc_id", "row", "place", "near", "alike", F.expr("struct(low.doc_id, low.row) AS low")), used)
        ties.append(alike.where(f"alike > 0 AND NOT ({_IS_LOW})").select("row", "place", F.col("alike").alias("more"), F.col("low.doc_id").alias("kept_in")))
        rest = alike.where(F.col("alike") < beyond).drop("low").withColumn("key", key("alike + 1"))
        rows = rest.join(_several(rest, "key"), "key")
        release(parts.sparkSession)
    met = rows.drop("key").withColumn("more", F.explode(F.sequence(F.col("alike") + 1, beyond.cast("int"))))
    met = stored(met.select("doc_id", "row", "place", "more", key("more").alias("key")), used)
    low = met.groupBy("key").agg(F.expr(f"min(struct({_ORDER}))").alias("low"))
    ties.append(met.join(low, "key").where(f"NOT ({_IS_LOW})").select("row", "place", "more", F.col("low.doc_id").alias("kept_in")))
    furthest = reduce(DataFrame.unionByName, ties).groupBy("row", "place").agg(F.max(F.struct("more", "kept_in")).alias("f"))
    furthest = sided.select("doc_id", "row", "place", "left", F.explode("starts").alias("start")).join(furthest, ["row", "place"])
    start = F.when(F.col("left"), F.col("start") - F.col("f.more")).otherwise(F.col("start"))
    end = F.col("start") + PARAGRAPH + F.when(F.col("left"), 0).otherwise(F.col("f.more"))
    return furthest.select("doc_id", "row", start.alias("start"), end.alias("end"), F.col("f.kept_in").alias("kept_in"))


def removals(parts: DataFrame, used: list[str]) -> DataFrame:
    """doc_id, row, start, end, kept_in: words to remove, and the doc_id of the document that keeps their like.

    parts are rows of split(); the result reads the tables named in `used`. What repeats within one document only stays,
    what another keeps is removed wherever it stands.
    """
    zipped = F.explode(F.arrays_zip("starts", "hashes", "checks")).alias("w")
    windows = parts.select("doc_id", "row", zipped).select("doc_id", "row", F.col("w.starts").alias("starts"), F.col("w.hashes").alias("hash"), F.col("w.checks").alias("check"))
    again = stored(windows.join(_several(windows, "hash", "check"), ["hash", "check"]), used)
    low = again.groupBy("hash", "check").agg(F.expr(f"min(struct({_ORDER}))").alias("low"))
    removed = stored(again.join(low, ["hash", "check"]).where(f"NOT ({_IS_LOW})").select("hash", "check", "doc_id", "row", "starts", F.col("low.doc_id").alias("kept_in")), used)
    found = removed.select("doc_id", "row", F.explode("starts").alias("start"), "kept_in").select("doc_id", "row", "start", (F.col("start") + PARAGRAPH).alias("end"), "kept_in")
    release(parts.sparkSession)
    found = found.unionByName(_extended(parts, again, removed, used))
    release(parts.sparkSession)

    lines = parts.select("doc_id", "row", "words", F.explode("lines").alias("l")).select("doc_id", "row", "words", "l.*")
    classes = stored(lines.groupBy("hash").agg(F.count("*").alias("n"), F.expr(f"min(struct({_ORDER}, start))").alias("low")), used)
    release(parts.sparkSession)
    sets = lines.select("hash", "bands", F.expr("substring(words, 4 * start + 1, 4 * (end - start))").alias("words"))
    roots = components(similar_links(sets, classes.select("hash", "n"), used, "words", word_shingles("words")))
    release(parts.sparkSession)
    classed = stored(classes.join(roots, F.col("hash") == F.col("node"), "left").select("hash", "n", "low", F.coalesce("component", "hash").alias("root")), used)
    kept = classed.groupBy("root").agg(F.sum("n").alias("n"), F.min("low").alias("low")).where("n > 1")
    wanted = classed.select("hash", "root").join(kept, "root").select("hash", "low")
    near = lines.select("doc_id", "row", "start", "end", "hash").join(wanted, "hash").where(f"NOT ({_IS_LOW})")
    return found.unionByName(near.select("doc_id", "row", "start", "end", F.col("low.doc_id").alias("kept_in")))


def merged_spans(found: DataFrame) -> DataFrame:
    """row and the sorted spans of the rows (row, start, end), those that meet merged into one."""
    own = Window.partitionBy("row").orderBy("start", "end")
    before = F.max("end").over(own.rowsBetween(Window.unboundedPreceding, -1))
    new = found.withColumn("new", F.coalesce(F.col("start") > before, F.lit(True)).cast("int"))
    numbered = new.withColumn("number", F.sum("new").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    single = numbered.groupBy("row", "number").agg(F.min("start").cast("long").alias("start"), F.max("end").cast("long").alias("end"))
    return single.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))


def spans(parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Merged spans (doc_id, u, spans) of each document that loses words, and the links (doc_id, u, kept_in).

    Of rows that are one document, the first one's are the document's: it shares with others what all of them share.
    """
    used: list[str] = []
    found = checkpoint(removals(parts, used))
    discard(parts.sparkSession, used)
    first = checkpoint(parts.groupBy("doc_id", "u").agg(F.min("row").alias("row")))
    merged = merged_spans(found.select("row", "start", "end")).join(first, "row").select("doc_id", "u", "spans")
    return merged, found.select("row", "kept_in").distinct().join(first, "row").select("doc_id", "u", "kept_in")


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: doc_id, class_id, n_links, n_words, n_removed, spans.

    spans are the runs of words that stand in another document too, by word numbers from 0, and n_removed
    their words. n_links: the doc_ids that keep their like; class_id: the least doc_id that a chain of
    such links reaches. A null or blank text has no words. Rows of one doc_id and one text are one document and each
    have its result; of one doc_id with different texts, each text is a document; a row of null id is one too, with
    a null class_id, and of like documents those of null id never keep what one with an id has. Those without repeats
    have themselves as class_id and no spans. An empty table gives no
    rows; other columns are ignored. A third of all documents may share a passage: it is counted where it
    stands before it is shuffled, and only joined to its one first place.
    """
    used: list[str] = []
    parts = stored(split(docs, id_col, text_col), used)
    sizes = checkpoint(parts.select("doc_id", "u", "n_words"))
    merged, links = spans(parts)
    discard(docs.sparkSession, used)
    classes = components(links, "doc_id", "kept_in")
    degrees = links.groupBy("doc_id", "u").agg(F.count("*").alias("n_links"))
    out = sizes
    for found in (merged, degrees):
        found = found.withColumnsRenamed({"doc_id": "own_id", "u": "own_u"})
        out = out.join(found, (F.col("u") == F.col("own_u")) & F.col("doc_id").eqNullSafe(F.col("own_id")), "left").drop("own_id", "own_u")
    out = out.join(classes, F.col("doc_id") == F.col("node"), "left")
    empty = F.expr("cast(array() as array<struct<start: bigint, end: bigint>>)")
    removed = F.expr("aggregate(coalesce(spans, array()), 0L, (n, s) -> n + s.end - s.start)")
    return out.select("doc_id", F.coalesce("component", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), "n_words", removed.alias("n_removed"), F.coalesce("spans", empty).alias("spans"))


def cut(text: str, spans: list[dict]) -> str:
    """text without the words of the spans and the white space between words of one span."""
    raw = text.encode()
    bounds = [m.span() for m in _WORD.finditer(raw)]
    kept, since = [], 0
    for span in spans:
        kept.append(raw[since : bounds[span["start"]][0]])
        since = bounds[span["end"] - 1][1]
    return b"".join([*kept, raw[since:]]).decode()


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs with its columns, the repeated spans cut out of text; rows left without a word are dropped.

    n_chars, where docs has it, becomes the new text's. Rows that lose nothing stay as they are, rows
    without words and null texts too. The spans are joined to the texts by doc_id and the text itself (its hash), so rows
    of one doc_id or of null id each lose what their own text shares; rows that have both in common lose the same.
    An empty table stays empty; columns of any name stay.
    """
    used: list[str] = []
    merged, _ = spans(stored(split(docs), used))
    discard(docs.sparkSession, used)
    names = docs.columns
    own_id, own_u, lost = unused(names, "id", "u", "spans")
    merged = merged.withColumnsRenamed({"doc_id": own_id, "u": own_u, "spans": lost})
    joined = docs.join(merged, (_u("doc_id", "text") == F.col(own_u)) & F.col("doc_id").eqNullSafe(F.col(own_id)), "left").select(*same(names), lost)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                found = part[lost].to_pylist()
                new = [cut(t, s) if s else t for t, s in zip(part["text"].to_pylist(), found, strict=True)]
                columns = {k: part[k] for k in names} | {"text": pa.array(new, part["text"].type)}
                if "n_chars" in names:
                    old = part["n_chars"].to_pylist()
                    columns["n_chars"] = pa.array([len(t) if s else n for t, s, n in zip(new, found, old, strict=True)], part["n_chars"].type)
                kept = pa.array([not s or bool(t.encode().split()) for t, s in zip(new, found, strict=True)], pa.bool_())
                yield pa.RecordBatch.from_pydict(columns).filter(kept)

    return joined.mapInArrow(made, docs.schema)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents and their passages that repeat across documents."""
    return repeated(read(spark, sf_dir, "documents"))
