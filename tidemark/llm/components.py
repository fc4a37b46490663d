"""Connected components by alternating stars, with neither edges nor nodes on the driver; few edges are followed in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import checkpoint, release, trim

#: Up to so many edges between long nodes are followed in one task; it changes the work, not the result.
HELD = 1 << 20


def _lowest(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("high").alias("node")).agg(F.min("low").alias("parent"))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("high", "low").cast("decimal(38,0)"))).first())


def _least(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct nodes of edges, and the least node that each reaches."""
    nodes, ends = np.unique(np.concatenate([high, low]), return_inverse=True)
    a, b = np.split(ends, 2)
    least = np.arange(len(nodes))
    while True:
        x, y = least[a], least[b]
        apart = x != y
        if not apart.any():
            return nodes, nodes[least]
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(least, np.maximum(x, y), np.minimum(x, y))
        while (least[least] != least).any():
            least = least[least]


def _in_one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = [(b["high"].to_numpy(), b["low"].to_numpy()) for b in batches if b.num_rows]
    if found:
        nodes, least = _least(*(np.concatenate(ends) for ends in zip(*found, strict=True)))
        del found
        yield pa.RecordBatch.from_pydict({"node": nodes, "component": least})
        del nodes, least
        trim()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component for every node of an edge; component is the least node that can be reached.

    Each round hangs every node from the least neighbour of its least neighbours (a large and a small
    star), so the rounds grow with the logarithm of the longest path. A node with many edges is one row on
    one side of each join and is summed before each shuffle. Loops and repeated edges do no harm, null
    nodes are left out; no edges give no rows. Each round is written to the checkpoint folder. Up to HELD edges take no
    rounds, if their nodes are longs.
    """
    ends = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    edges = checkpoint(ends.select(F.greatest(a, b).alias("high"), F.least(a, b).alias("low")).distinct())
    state = _state(edges)
    if state[0] <= HELD and [t for _, t in edges.dtypes] == ["bigint", "bigint"]:
        return edges.coalesce(1).mapInArrow(_in_one_task, "node long, component long")
    while True:
        parents = _lowest(edges)
        large = edges.join(parents, edges["low"] == parents["node"], "left").select("high", F.coalesce("parent", "low").alias("low")).distinct()
        large = checkpoint(large)
        parents = _lowest(large)
        small = large.join(parents, large["high"] == parents["node"])
        small = small.select(F.explode(F.array(F.struct(F.col("low").alias("high"), F.col("parent").alias("low")), F.struct("high", F.col("parent").alias("low")))).alias("e"))
        edges = checkpoint(small.select("e.high", "e.low").where("high != low").distinct())
        before, state = state, _state(edges)
        del parents, large, small
        release(edges.sparkSession)
        if state == before:
            return edges.select(F.col("high").alias("node"), F.col("low").alias("component")).union(edges.select(F.col("low"), F.col("low")).distinct())
