"""A store of sorted segments: a log, flushes, a manifest, and compaction, on any file system that Spark writes.

Entries first go to the log, a folder for each batch of its writer; once the log is large it is flushed.

Each flush and each compaction is a generation: entries in Parquet, sorted by key in files of key ranges, so
that a seek skips files and row groups by their bounds. The manifest's versions name the generations that
count, and the last batch of the log that is in them; a version is written after its data, so a reader sees all of a
change or none of it. What a version supersedes is deleted only after it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tidemark.operators.entries import kind_order, merge, unpaired
from tidemark.operators.segments import LEAST_OCCUPANCY, MOST_FILES, metadata
from tidemark.sources.files import delete, numbered

# Fixed value: the bytes of the log above which it is flushed.
FLUSH_BYTES = 128 << 20
_MANIFEST = "version long, generation long, pending_count long, tombstone_count long, through long"


class SegmentStore:
    """The store in a folder; one writer at a time."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def manifest(self) -> DataFrame:
        """The generations of the last version; no rows for a new store."""
        try:
            versions = self.spark.read.schema(_MANIFEST).parquet(f"{self.folder}/manifest")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], _MANIFEST)
        return versions.join(versions.agg(F.max("version").alias("version")), "version", "left_semi").where("generation >= 0")

    def _last(self) -> tuple[int, int]:
        """The last version and the last batch of the log that its generations hold; -1 for none."""
        version, through = self.manifest().agg(F.max("version"), F.max("through")).first()
        return -1 if version is None else version, -1 if through is None else through

    def _put(self, entries: DataFrame, generation: int) -> DataFrame:
        """Writes entries as a generation; its row for the manifest."""
        path = f"{self.folder}/generation={generation}"
        ranged = entries.repartitionByRange("deadline_ms", "id").sortWithinPartitions("deadline_ms", "id", kind_order())
        ranged.write.mode("overwrite").parquet(path)
        counts = metadata(self.spark.read.parquet(path)).agg(F.sum("pending_count").alias("p"), F.sum("tombstone_count").alias("t"))
        return counts.select(F.lit(generation).cast("long").alias("generation"), F.coalesce("p", F.lit(0)).cast("long").alias("pending_count"), F.coalesce("t", F.lit(0)).cast("long").alias("tombstone_count"))

    def _commit(self, rows: DataFrame, version: int, through: int) -> None:
        row = rows.select(F.lit(version).cast("long").alias("version"), "generation", "pending_count", "tombstone_count", F.lit(through).cast("long").alias("through"))
        row.coalesce(1).write.mode("append").parquet(f"{self.folder}/manifest")

    def flush(self, entries: DataFrame, through: int | None = None) -> None:
        """Adds entries as a new generation; `through` is the last batch of the log in them, if they come from it."""
        version, before = self._last()
        kept = self.manifest().select("generation", "pending_count", "tombstone_count")
        self._commit(kept.unionByName(self._put(entries, version + 1)), version + 1, before if through is None else through)

    def _waiting(self) -> dict[int, int]:
        """The batches of the log that no generation holds yet, and their bytes."""
        _, through = self._last()
        return {n: size for n, size in numbered(self.spark, f"{self.folder}/log", "batch").items() if n > through}

    def append(self, entries: DataFrame, batch_id: int) -> None:
        """Writes a batch to the log. One that is written again replaces itself; one flushed already is left out."""
        if batch_id > self._last()[1]:
            entries.write.mode("overwrite").parquet(f"{self.folder}/log/batch={batch_id}")

    def flush_log(self, least_bytes: int = 0) -> bool:
        """Makes a generation of the log if it has more than so many bytes, and deletes it; whether it did."""
        waiting = self._waiting()
        if not waiting or sum(waiting.values()) <= least_bytes:
            return False
        self.flush(merge(*(self.spark.read.parquet(f"{self.folder}/log/batch={n}") for n in sorted(waiting))), max(waiting))
        for n in waiting:
            delete(self.spark, f"{self.folder}/log/batch={n}")
        return True

    def sink(self, flush_bytes: int = FLUSH_BYTES) -> Callable[[DataFrame, int], None]:
        """A function for writeStream.foreachBatch: each micro-batch is a batch of the log, flushed when it is large."""

        def write(entries: DataFrame, batch_id: int) -> None:
            self.append(entries, batch_id)
            self.flush_log(flush_bytes)

        return write

    def entries(self) -> DataFrame:
        """The entries of all generations that count and of the log; filters on deadline_ms and id reach the files."""
        names = [r.generation for r in self.manifest().select("generation").orderBy("generation").collect()]
        paths = [f"{self.folder}/generation={n}" for n in names] + [f"{self.folder}/log/batch={n}" for n in sorted(self._waiting())]
        if not paths:
            raise ValueError(f"{self.folder} holds no generation")
        return merge(*(self.spark.read.parquet(p) for p in paths))

    def due(self) -> bool:
        """Whether compaction would help: too many generations, or too few items that live."""
        n, pending, tombstones = self.manifest().agg(F.count("*"), F.coalesce(F.sum("pending_count"), F.lit(0)), F.coalesce(F.sum("tombstone_count"), F.lit(0))).first()
        return n > MOST_FILES or (pending > 0 and (pending - tombstones) / pending < LEAST_OCCUPANCY)

    def compact(self) -> None:
        """Replaces all generations by one without cancelled pairs, and deletes them; tombstones of absent items stay."""
        version, through = self._last()
        names = [r.generation for r in self.manifest().select("generation").collect()]
        if not names:
            return
        old = merge(*(self.spark.read.parquet(f"{self.folder}/generation={n}") for n in names))
        self._commit(self._put(unpaired(old), version + 1), version + 1, through)
        self.recover()

    def recover(self) -> list[str]:
        """Deletes what a writer that stopped or a newer version has left behind; the names of the folders deleted.

        These are generations that the last version doesn't name, written before a commit that never came or superseded
        by one, and batches of the log that a generation holds. Batches that none holds stay in the log.
        """
        _, through = self._last()
        named = {r.generation for r in self.manifest().select("generation").collect()}
        left = [f"generation={n}" for n in numbered(self.spark, self.folder, "generation") if n not in named]
        left += [f"log/batch={n}" for n in numbered(self.spark, f"{self.folder}/log", "batch") if n <= through]
        for name in left:
            delete(self.spark, f"{self.folder}/{name}")
        return sorted(left)
