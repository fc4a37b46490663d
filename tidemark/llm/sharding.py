"""Shards of a corpus by a consistent-hash ring with virtual nodes and bounded loads.

Every virtual node has a place of 64 bits on the ring, and a key belongs to the first node at or after its own place.
For counting, the ring is cut into segments at each node and at equal cells besides. A segment's keys go to its node's
shard; once that holds its bound, the rest of the segment's keys continue clockwise to the next virtual node whose shard
has room. The bounds are n // shards or one more, so row counts differ by at most one, and only a home shard's surplus
moves.

Only counts per segment reach the driver and only tables of cells and of segments are broadcast: they have 2 ** bits rows,
one for each virtual node, and the few rows of split segments, whatever the corpus holds.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import checkpoint, read

LEAST_BITS = 14
VIRTUAL_NODES = 128
#: Copies of a row that one task lists.
COPIES = 1 << 16


@dataclass(frozen=True)
class Ring:
    """Virtual nodes in clockwise order, and 2 ** bits cells of equal size.

    A node's place follows from the shard's number and its own alone, so a further shard adds nodes and moves none.
    Segment base[cell] + j holds the keys of a cell that lie after j of its nodes.
    """

    places: np.ndarray
    owners: np.ndarray
    bits: int

    @property
    def base(self) -> np.ndarray:
        """The first segment of each cell, and the number of segments."""
        cells = (self.places >> np.uint64(64 - self.bits)).astype(np.int64)
        return np.arange((1 << self.bits) + 1) + np.searchsorted(cells, np.arange((1 << self.bits) + 1))

    def nodes(self) -> np.ndarray:
        """The first node at or after the keys of each segment."""
        base = self.base
        cell = np.repeat(np.arange(1 << self.bits), np.diff(base))
        return (np.arange(base[-1]) - cell) % len(self.places)

    def cells(self) -> list[tuple[int, int, list[int]]]:
        """(cell, first segment, places of its nodes) as signed numbers, whose order within a cell is that of the ring."""
        base, signed = self.base, self.places.view(np.int64)
        before = base - np.arange(len(base))
        return [(c, int(base[c]), signed[before[c] : before[c + 1]].tolist()) for c in range(1 << self.bits)]


def ring(shards: int, virtual_nodes: int = VIRTUAL_NODES, bits: int | None = None) -> Ring:
    """The ring of so many shards; without bits, with at least four cells for each node."""
    made = sorted((xxhash.xxh64_intdigest(f"{s}/{v}".encode(), 7), s) for s in range(shards) for v in range(virtual_nodes))
    bits = max(LEAST_BITS, (4 * len(made) - 1).bit_length()) if bits is None else bits
    return Ring(np.array([p for p, _ in made], dtype=np.uint64), np.array([s for _, s in made], dtype=np.int64), bits)


def allot(counts: np.ndarray, on: Ring, shards: int) -> list[tuple]:
    """Rows (segment, first rank, end rank, shard, first slot, home) that place counts[segment] keys of each segment.

    Bounds: total // shards, and one more for the total % shards shards that most keys call home. Home
    keys are placed first, segment by segment; what is left then walks clockwise past full shards.
    """
    first = on.nodes()
    home = on.owners[first]
    total = int(counts.sum())
    wanted = np.bincount(home, weights=counts, minlength=shards)
    bound = np.full(shards, total // shards, dtype=np.int64)
    bound[np.lexsort((np.arange(shards), -wanted))[: total % shards]] += 1
    used = np.zeros(shards, dtype=np.int64)
    rows, surplus = [], []
    for segment in np.flatnonzero(counts).tolist():
        shard, n = int(home[segment]), int(counts[segment])
        here = min(n, int(bound[shard] - used[shard]))
        if here:
            rows.append((segment, 0, here, shard, int(used[shard]), shard))
            used[shard] += here
        if here < n:
            surplus.append((segment, here, n))
    for segment, done, n in surplus:
        node = int(first[segment])
        while done < n:
            node = (node + 1) % len(on.places)
            shard = int(on.owners[node])
            here = min(n - done, int(bound[shard] - used[shard]))
            if here:
                rows.append((segment, done, done + here, shard, int(used[shard]), int(home[segment])))
                used[shard] += here
                done += here
    return rows


def assign(docs: DataFrame, shards: int, virtual_nodes: int = VIRTUAL_NODES, bits: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, size, text_crc32, shard, slot, home_shard.

    size is the text's UTF-8 bytes plus 8. A null text counts as empty; null ids are keys like others;
    equal rows, of any number, get slots of their own; an empty table gives no rows; other columns are
    ignored. Equal rows are counted before the shuffle and listed again only when they have their ranks,
    so one row repeated a billion times is one row in every exchange but the one that deals out blocks of its copies.
    """
    on, spark = ring(shards, virtual_nodes, bits), docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    keys = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("copies"))
    keys = keys.withColumn("place", F.xxhash64("doc_id", "size", "text_crc32"))
    keys = keys.withColumn("cell", F.shiftrightunsigned("place", 64 - on.bits).cast("int"))
    cells = spark.createDataFrame(on.cells(), "cell int, base int, nodes array<long>")
    keys = keys.join(F.broadcast(cells), "cell").withColumn("segment", F.expr("base + size(filter(nodes, p -> p < place))"))
    before = Window.partitionBy("segment").orderBy("place", "doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    ranked = keys.withColumn("rank", F.coalesce(F.sum("copies").over(before), F.lit(0)))
    ranked = checkpoint(ranked.select("doc_id", "size", "text_crc32", "copies", "segment", "rank"))

    counts = np.zeros(on.base[-1], dtype=np.int64)
    for segment, n in ranked.groupBy("segment").agg(F.sum("copies")).collect():
        counts[segment] = n
    table = spark.createDataFrame(allot(counts, on, shards), "segment int, first long, end long, shard int, base long, home_shard int")
    few = ranked.where(F.col("copies") <= COPIES).withColumn("block", F.lit(0).cast("long"))
    many = ranked.where(F.col("copies") > COPIES).withColumn("block", F.explode(F.expr(f"sequence(0L, (copies - 1) div {COPIES})")))
    listed = few.union(many.repartition("segment", "rank", "block"))
    listed = listed.withColumn("copy", F.explode(F.expr(f"sequence(block * {COPIES}, least(copies - 1, block * {COPIES} + {COPIES - 1}))")))
    listed = listed.withColumn("rank", F.col("rank") + F.col("copy"))
    placed = listed.join(F.broadcast(table), (listed["segment"] == table["segment"]) & (listed["rank"] >= table["first"]) & (listed["rank"] < table["end"]))
    slot = (F.col("base") + F.col("rank") - F.col("first")).alias("slot")
    return placed.select("doc_id", "size", "text_crc32", "shard", slot, "home_shard")


def op9_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards whose row counts differ by at most one."""
    placed = assign(read(spark, sf_dir, "documents"), shards=24)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "home_shard"
    )
