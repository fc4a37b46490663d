"""What the corpus operators share: reading, checkpoints, Arrow batches and ASCII-space words."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A-Z to a-z on bytes; every other byte stays.
ASCII_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Text bytes that a Python function holds at once; one longer text is taken alone.
CHUNK_BYTES = 2 << 20
#: The C library's way to return unused memory, where it has one.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def ship(spark: SparkSession) -> None:
    """Tells the Python workers of local mode where this package is; a cluster gets it by --py-files or an image."""
    if spark.sparkContext.master.startswith("local["):
        spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """The table at sf_dir, by Spark's reader alone, so that any store it knows will do."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """A folder of this application's own below the one that all executors share.

    The latter is the session's spark.checkpoint.dir; a temporary one is made only where none is set
    and the master is local, as in tests.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local[") and context.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """df, written to the shared checkpoint folder and read from there, so lost executors cost no lineage.

    Spark deletes the files with the DataFrame where spark.cleaner.referenceTracking.cleanCheckpoints is set.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, used: list[str] | None = None) -> DataFrame:
    """df as Parquet in the shared checkpoint folder: for wide rows of which later steps read some columns.

    The path goes into `used`, whose owner gives it to discard() once all that reads it has been written
    elsewhere; otherwise the files stay until the checkpoint folder is cleared.
    """
    path = f"{checkpoint_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    if used is not None:
        used.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files and checkpoints of DataFrames that are gone.

    It does so once the driver's collectors have found them, which a driver with memory to spare puts off
    for a long time; a step of many rounds calls this after each, or all rounds' files are kept.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def discard(spark: SparkSession, used: list[str]) -> None:
    """Deletes stored tables that nothing reads any more."""
    release(spark)
    jvm = spark.sparkContext._jvm
    for path in used:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    used.clear()


def chunks(batch: pa.RecordBatch, column: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of batch whose texts in column come to about `most` bytes, at least one row each.

    After the last one, memory that earlier batches left unused goes back to the system: Spark keeps its
    Python workers, and what each of them holds counts against the executor.
    """
    if batch.num_rows == 0:
        return
    values = batch.column(batch.schema.get_field_index(column))
    sizes = pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop
    trim()


def trim() -> None:
    """Gives memory that the process no longer uses back to the system."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


class Numbers(dict):
    """A number for each thing that is looked up, from 0 on in order of first sight."""

    def __missing__(self, key: object) -> int:
        self[key] = number = len(self)
        return number


def texts(batch: pa.RecordBatch, column: str) -> list[bytes | None]:
    """The texts of a column as UTF-8 bytes."""
    values = batch.column(batch.schema.get_field_index(column))
    kind = pa.large_binary() if pa.types.is_large_string(values.type) else pa.binary()
    return values.cast(kind).to_pylist()


def quoted(name: str) -> str:
    """A column's name as SQL writes it."""
    return f"`{name.replace('`', '``')}`"


def same(names: list[str]) -> list[Column]:
    """Columns by their plain names, dots and all."""
    return [F.col(quoted(n)) for n in names]


def unused(taken: list[str], *names: str) -> list[str]:
    """Names that begin like those given and clash with none of those taken, whatever their case."""
    lower, made = {t.lower() for t in taken}, []
    for name in names:
        name = f"_{name}"
        while name in lower:
            name += "_"
        lower.add(name)
        made.append(name)
    return made
