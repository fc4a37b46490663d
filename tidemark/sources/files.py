"""Files of a folder on any file system that Spark reads: their names and sizes, and deletion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """path and length of all files below a folder, whose contents aren't read; no rows where there is no folder."""
    try:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "path string, length long")
    return found.select("path", "length")


def numbered(spark: SparkSession, folder: str, name: str) -> dict[int, int]:
    """The numbers of the folders name=<number> directly below a folder that hold files, with their bytes."""
    files = listed(spark, folder).select(F.regexp_extract("path", f"/{name}=([0-9]+)/[^/]*$", 1).alias("n"), "length").where("n != ''")
    return {int(n): size for n, size in files.groupBy("n").agg(F.sum("length")).collect()}


def delete(spark: SparkSession, folder: str) -> None:
    """Deletes a folder and all that is in it, if it is there."""
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
