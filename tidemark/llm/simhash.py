"""SimHash fingerprints and covering locality-sensitive hashing.

Covering: each of the 64 bits gets a non-zero vector of radius + 1 bits, and there is a table for each
non-zero vector v, whose mask keeps the bits whose vector has an odd product with v. Any `radius` bits span
less than the whole space, so some v is orthogonal to all of them: its mask keeps none of the bits in which
a pair differs, and the pair collides there. No pair within the radius is missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import minhash
from tidemark.llm.common import ASCII_LOWER, Numbers, chunks, discard, read, same, stored, texts, unused
from tidemark.llm.common import checkpoint as written
from tidemark.llm.components import components

BITS = 64
#: Up to so many fingerprints of one table's key are compared with each other; larger keys go another way.
PAIRED = 64
_SPREAD = np.uint64(0x0101010101010101)


def shingle_hashes(text: bytes | None, size: int) -> list[int]:
    """XXH64 with seed 42 of the shingles of lower-cased words, repeats included.

    Fewer words than size make one shingle, no words none.
    """
    words = text.translate(ASCII_LOWER).split() if text else []
    if not words:
        return []
    joined = b" ".join(words)
    ends = np.flatnonzero(np.frombuffer(joined, dtype=np.uint8) == 32).tolist() + [len(joined)]
    if len(words) <= size:
        return [xxhash.xxh64_intdigest(joined, 42)]
    starts = [0] + [e + 1 for e in ends[:-1]]
    digest = xxhash.xxh64_intdigest
    return [digest(joined[s:e], 42) for s, e in zip(starts, ends[size - 1 :], strict=False)]


def fingerprints(hashes: list[np.ndarray]) -> np.ndarray:
    """A fingerprint for each array of hashes: bits set in over half of them; 0 for none.

    Eight bits at a time are counted in the bytes of a word, over runs of at most 255 hashes.
    """
    sizes = np.array([len(h) for h in hashes], dtype=np.int64)
    out = np.zeros(len(hashes), dtype=np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    flat = np.concatenate([hashes[i] for i in full])
    sizes = sizes[full]
    runs = -(-sizes // 255)
    first = np.cumsum(runs) - runs
    within = np.arange(runs.sum()) - np.repeat(first, runs)
    starts = np.repeat(np.cumsum(sizes) - sizes, runs) + 255 * within
    made = np.zeros(len(full), dtype=np.uint64)
    for k in range(8):
        sums = np.add.reduceat((flat >> np.uint64(k)) & _SPREAD, starts)
        lanes = sums.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64)
        counts = np.add.reduceat(lanes, first, axis=0)
        for lane in range(8):
            made |= (2 * counts[:, lane] > sizes).astype(np.uint64) << np.uint64(8 * lane + k)
    out[full] = made
    return out


def masks(radius: int, bits: int = BITS) -> list[int]:
    """The covering tables' masks, 2 ** (radius + 1) - 1 of them."""
    n = 2 ** (radius + 1)
    vectors = [1 + i % (n - 1) for i in range(bits)]
    return [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2) for v in range(1, n)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprinted(docs: DataFrame, size: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long, of each row of docs, without a shuffle."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text", 2 << 20):
                hashes = [np.array(shingle_hashes(t, size), dtype=np.uint64) for t in texts(part, "text")]
                yield pa.RecordBatch.from_pydict({"doc_id": part["doc_id"], "fp": pa.array(fingerprints(hashes).view(np.int64))})

    return rows.mapInArrow(made, f"doc_id {dict(rows.dtypes)['doc_id']}, fp long")


def links(distinct: DataFrame, radius: int = 2) -> DataFrame:
    """Edges (a, b) that connect all fingerprints of the column fp that differ in at most `radius` bits, 1 or 2.

    Keys of up to PAIRED fingerprints are compared pair by pair. The fingerprints of larger keys each name
    all values within one bit of themselves; those that name a value are within two bits of each other and
    are tied to its least one if the radius is 2. Every pair at two bits has a value between them, so no
    link between components is lost, and the rows stay in proportion to the fingerprints.
    """
    if radius not in (1, 2):
        raise ValueError("radius must be 1 or 2")
    tables = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in enumerate(masks(radius))])
    keyed = distinct.select("fp", F.explode(tables).alias("k")).select("k.t", "k.key", "fp")
    shared = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    members = written(keyed.join(shared, ["t", "key"]))
    small = members.where(F.col("n") <= PAIRED)
    left, right = (small.select("t", "key", F.col("fp").alias(name)) for name in "ab")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    pairs = left.join(right, ["t", "key"]).where((F.col("a") < F.col("b")) & near).select("a", "b")

    hot = members.where(F.col("n") > PAIRED).select("fp").distinct()
    flips = F.array(*[F.lit(_signed(1 << i)) for i in range(BITS)], *([F.lit(0).cast("long")] if radius > 0 else []))
    named = hot.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("value"))
    if radius == 1:
        # only the fingerprints among the values tie: a value that is nobody's own ties pairs at two bits
        named = named.join(hot.select(F.col("fp").alias("value")), "value", "left_semi")
        return pairs.union(named.select("fp", "value"))
    least = named.groupBy("value").agg(F.min("fp").alias("least"), F.count("*").alias("n")).where("n > 1")
    tied = named.join(least, "value").where("fp != least").select("fp", "least").distinct()
    return pairs.union(tied)


def _grouped(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """rows, which have doc_id and fp, with root and component_id of the fingerprints that the edges (a, b) link."""
    least = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = components(edges)
    roots = written(least.join(found, least["fp"] == found["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("root")))
    named = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(roots.join(named, "root").select("fp", "root", "component_id"), "fp")


def near_groups(docs: DataFrame, size: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, component_id of each row: the least doc_id that a chain of links reaches.

    Rows with equal fingerprints are linked, and those that differ in at most `radius` bits. A null, empty
    or blank text has the fingerprint 0 and is linked like any other. Null ids and repeated rows stay; a
    component of null ids only has a null component_id. An empty table gives no rows; other columns are
    ignored. Copies are counted once per fingerprint before anything is compared.
    """
    rows = written(fingerprinted(docs, size, id_col, text_col))
    return _grouped(rows, links(rows.select("fp").distinct(), radius)).select("doc_id", "fp", "component_id")


_SETS = "doc_id {}, u long, fp long, hash long, bands array<long>, words binary"


def _banded(found: list[bytes | None]) -> tuple[list[np.ndarray], dict[int, np.ndarray]]:
    """The 64-bit hashes of each text's lower-cased words, and the band keys of its shingles where it has a word."""
    ids = Numbers()
    own = [np.array(list(map(ids.__getitem__, t.translate(ASCII_LOWER).split())) if t else [], dtype=np.int64) for t in found]
    hashed = np.array([xxhash.xxh64_intdigest(w, 3) for w in ids], dtype=np.uint64)
    words = [hashed[w] for w in own]
    full = [i for i, w in enumerate(words) if len(w)]
    if not full:
        return words, {}
    shingles = [minhash.runs(words[i], min(minhash.SHINGLE, len(words[i]))) | np.uint64(1) for i in full]
    keys = minhash.band_keys(np.concatenate(shingles), np.array([len(x) for x in shingles]))
    return words, dict(zip(full, keys, strict=True))


def _sets(docs: DataFrame) -> DataFrame:
    """doc_id, u (a hash of id and text), the fingerprint of three-word shingles, and bands and words, of each row.

    hash stands for the sequence of words, from which fingerprint, bands and shingles follow.
    """

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text", 1 << 20):
                found = texts(part, "text")
                fps = fingerprints([np.array(shingle_hashes(t, 3), dtype=np.uint64) for t in found]).view(np.int64)
                words, bands = _banded(found)
                hashes = [xxhash.xxh64_intdigest(w.tobytes(), 9) for w in words]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": part["doc_id"],
                        "u": part["u"],
                        "fp": pa.array(fps),
                        "hash": pa.array(np.array(hashes, dtype=np.uint64).view(np.int64)),
                        "bands": pa.array([bands.get(i) for i in range(len(found))], pa.list_(pa.int64())),
                        "words": pa.array([minhash.short(w).tobytes() for w in words], pa.binary()),
                    }
                )

    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("u"), "text")
    return rows.mapInArrow(made, _SETS.format(dict(rows.dtypes)["doc_id"]))


def near_copies(docs: DataFrame, radius: int = 2) -> DataFrame:
    """doc_id, u, fp, component_id of each row, as near_groups() gives them, of links that reach further.

    u stands for the row's doc_id and text. At 64 bits a fingerprint distance of two finds few of the texts whose sets
    of five-word shingles have a Jaccard similarity of 0.8, which differ in three to nine bits; no covering of that
    radius is small. So the fingerprints that MinHash bands of five-word shingles bring together are linked too where
    their similarity is 0.8 or more. Null, empty and blank texts have the fingerprint 0 and are linked; null ids and
    repeated rows stay; an empty table gives no rows; other columns are ignored.
    """
    used: list[str] = []
    rows = stored(_sets(docs), used)
    distinct = stored(rows.groupBy("hash").agg(F.count("*").alias("n"), F.min("fp").alias("fp")), used)
    banded = rows.where("bands IS NOT NULL").select("hash", "bands", "words")
    similar = minhash.similar_links(banded, distinct.select("hash", "n"), used, "words", minhash.word_shingles("words"))
    for end in "ab":
        similar = similar.join(distinct.select(F.col("hash").alias(end), F.col("fp").alias(f"fp_{end}")), end)
    fps = written(rows.select("doc_id", "u", "fp"))
    edges = links(fps.select("fp").distinct(), radius).union(similar.select("fp_a", "fp_b"))
    groups = _grouped(fps, edges)
    discard(docs.sparkSession, used)
    return groups


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with its columns: one row of each component of near_copies().

    It is the row of the least doc_id, null ids last, and of one doc_id with several texts the one of the least hash;
    of equal rows of it one stays. A component has rows of like texts only, so texts unlike each other stay,
    whatever their ids. Null and blank texts are one component. An empty table stays empty; columns of any name stay.
    """
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "u"))
    groups = near_copies(docs)
    kept = written(groups.groupBy("root").agg(first.alias("k")).select("k.doc_id", "k.u"))
    again = groups.select("doc_id", "u").groupBy("doc_id", "u").agg(F.count("*").alias("n")).where("n > 1")
    own_id, own_u, u = unused(docs.columns, "id", "u", "own")
    kept = kept.withColumnsRenamed({"doc_id": own_id, "u": own_u})
    left = docs.withColumn(u, F.xxhash64("doc_id", "text")).join(kept, (F.col(u) == F.col(own_u)) & F.col("doc_id").eqNullSafe(F.col(own_id)), "left_semi")
    if again.take(1):
        left = left.dropDuplicates(["doc_id", u])
    return left.select(*same(docs.columns))


def op3_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with fingerprints of three-word shingles, linked at two or fewer bits."""
    found = near_groups(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
