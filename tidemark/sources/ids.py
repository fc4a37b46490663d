"""Ids that ascend over restarts: ranges below a ceiling that is written before they are given out."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

# The ids that a ceiling reserves, and how few may be left before it is raised.
RESERVED, LEAST_LEFT = 1_000_000, 500_000


class IdSource:
    """Ranges of ids for one writer, from 1 on; after a restart ids go on at the ceiling written last, so none is given twice."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.path = spark, f"{folder}/id-ceiling"
        self.next = self.ceiling = self._written()

    def _written(self) -> int:
        try:
            return self.spark.read.schema("ceiling long").parquet(self.path).agg(F.coalesce(F.max("ceiling"), F.lit(1))).first()[0]
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return 1

    def take(self, n: int) -> range:
        """The next n ids."""
        if n < 0:
            raise ValueError("a count of ids can't be negative")
        first, self.next = self.next, self.next + n
        if n and self.ceiling < self.next + LEAST_LEFT:
            self.ceiling = self.next + RESERVED
            self.spark.range(1).select(F.lit(self.ceiling).cast("long").alias("ceiling")).coalesce(1).write.mode("append").parquet(self.path)
        return range(first, self.next)
