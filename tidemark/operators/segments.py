"""Segments: flushed ranges of ids, their counts, and compaction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.entries import unpaired
from tidemark.sources.tables import PENDING, TOMBSTONE

#: Compaction runs above so many files, or below this share of pending items that live.
MOST_FILES, LEAST_OCCUPANCY = 16, 0.6


def metadata(log: DataFrame) -> DataFrame:
    """The pending and tombstone counts of each segment, from partial counts of each task."""
    return log.groupBy("segment_id").agg(F.count_if(F.col("kind") == PENDING).alias("pending_count"), F.count_if(F.col("kind") == TOMBSTONE).alias("tombstone_count"))


def ranges(log: DataFrame, size: int) -> DataFrame:
    """Ranges of `size` segments: first and last segment, files, counts.

    A range has one file of pending items, and one for each of its segments that have tombstones.
    """
    by_segment = metadata(log).withColumn("number", F.expr(f"segment_id div {size}"))
    return by_segment.groupBy("number").agg(
        F.min("segment_id").alias("start"),
        F.max("segment_id").alias("end"),
        (F.count_if(F.col("tombstone_count") > 0) + 1).alias("files"),
        F.sum("pending_count").alias("pending_count"),
        F.sum("tombstone_count").alias("tombstone_count"),
    )


def occupancy(of: DataFrame) -> DataFrame:
    """The share of each range's pending items that live."""
    return of.withColumn("occupancy", (F.col("pending_count") - F.col("tombstone_count")) / F.col("pending_count"))


def exhausted(of: DataFrame) -> DataFrame:
    return of.where("pending_count = tombstone_count")


def routed(log: DataFrame, of: DataFrame) -> DataFrame:
    """Each tombstone with the range that holds its pending item.

    Ranges are contiguous and cover whole numbers of segments, so a range's segments are listed and joined
    by equality; Spark broadcasts the list where it is small.
    """
    tombstones = log.where(F.col("kind") == TOMBSTONE).select("queue", "id", "deadline_ms", "segment_id")
    listed = of.select("start", "end", F.explode(F.sequence("start", "end")).alias("segment_id"))
    return tombstones.join(listed, "segment_id").select("queue", "id", "deadline_ms", "segment_id", "start", "end")


def compaction(of: DataFrame, most_files: int = MOST_FILES, least_occupancy: float = LEAST_OCCUPANCY) -> DataFrame:
    """The run of adjacent ranges whose compaction is best, or no row if none is due or possible.

    Best: the least norm of the shares of files left, of pending entries left and of pending items
    rewritten, among runs after which the files and the occupancy are within bounds. Sums over a run are
    differences of running sums, so a run is one row of the ranges joined to themselves: the ranges of a queue
    are few, as each is a segment file and compaction bounds those. Of equal norms the earliest and shortest
    counts.
    """
    ordered = Window.orderBy("start")
    whole = Window.orderBy("start").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sums = of.select(
        "start",
        "end",
        F.row_number().over(ordered).alias("i"),
        *(F.sum(c).over(ordered).alias(c) for c in ("files", "pending_count", "tombstone_count")),
        *((F.sum(c).over(ordered) - F.col(c)).alias(f"{c}_before") for c in ("files", "pending_count", "tombstone_count")),
        *(F.sum(c).over(whole).alias(name) for c, name in (("files", "all_files"), ("pending_count", "all_pending"), ("tombstone_count", "all_tombstones"))),
    )
    left = sums.select(F.col("i").alias("a"), F.col("start").alias("first"), *(F.col(f"{c}_before").alias(f"{c}_b") for c in ("files", "pending_count", "tombstone_count")))
    runs = left.join(sums, F.col("a") <= F.col("i"))
    files, pending, tombstones = (F.col(c) - F.col(f"{c}_b") for c in ("files", "pending_count", "tombstone_count"))
    runs = runs.select(
        "a",
        "i",
        "first",
        F.col("end").alias("last"),
        "all_files",
        "all_pending",
        (F.col("all_files") - files + 1).alias("net_files"),
        (F.col("all_pending") - tombstones).alias("net_pending"),
        (F.col("all_tombstones") - tombstones).alias("net_tombstones"),
        (pending - tombstones).alias("written"),
        F.col("all_tombstones"),
    )
    due = ((F.col("all_pending") - F.col("all_tombstones")) / F.col("all_pending") < least_occupancy) | (F.col("all_files") > most_files)
    within = (F.col("net_files") <= most_files) & ((F.col("net_pending") - F.col("net_tombstones")) / F.col("net_pending") >= least_occupancy)
    shares = [F.col(a) / F.col(b) for a, b in (("net_files", "all_files"), ("net_pending", "all_pending"), ("written", "all_pending"))]
    norm = F.sqrt(shares[0] * shares[0] + shares[1] * shares[1] + shares[2] * shares[2])
    return runs.where(due & within).withColumn("norm", norm).orderBy("norm", "a", "i").limit(1).select("first", "last", "net_files", "written", F.round("norm", 9).alias("norm"))


def compacted(log: DataFrame, first: int, last: int) -> DataFrame:
    """The live entries of the segments first to last, which replace them; entries of the others as they are."""
    inside = F.col("segment_id").between(first, last)
    return unpaired(log.where(inside)).withColumn("segment_id", F.lit(first).cast("long")).unionByName(log.where(~inside))
