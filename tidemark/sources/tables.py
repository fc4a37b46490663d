"""Entry logs and operation logs derived from the driver's tables.

An entry is a pending item or a tombstone. Its key is (queue, deadline_ms, kind, id); a tombstone cancels
the pending item of the same queue, deadline and id.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PENDING, TOMBSTONE = "pending", "tombstone"

ENTRY_COLUMNS = ("queue", "kind", "id", "deadline_ms", "enqueue_ms", "requeue_ms", "dequeue_count", "value", "segment_id")

#: The instant at which the queries look at the queues; never the clock, so results can be checked.
NOW_MS = 1_705_276_800_000
#: What a requeued item's new id is above its old one, and how long it is put off.
REQUEUE_ID, REQUEUE_DELAY_MS = 1_000_000_000, 3_600_000
#: Ids of one flushed segment.
SEGMENT_IDS = 1_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """The table at sf_dir; in local mode, Python workers are told where this package is."""
    if spark.sparkContext.master.startswith("local["):
        spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def millis(ts: Column) -> Column:
    """Milliseconds since the epoch of a timestamp without time zone, truncated; the session's zone is UTC."""
    return F.unix_millis(ts.cast("timestamp"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One enqueued item for each event: its user's queue, put off by the whole seconds of its value."""
    events = read(spark, sf_dir, "events")
    enqueued = millis(F.col("ts"))
    return events.select(
        F.col("user_id").cast("string").alias("queue"),
        F.col("event_id").alias("id"),
        (enqueued + F.floor("value") * 1000).alias("deadline_ms"),
        enqueued.alias("enqueue_ms"),
        F.col("props").alias("value"),
        "event_type",
    )


def pending(enqueued: DataFrame) -> DataFrame:
    """The pending entries that enqueueing items writes."""
    return enqueued.select(
        "queue",
        F.lit(PENDING).alias("kind"),
        "id",
        "deadline_ms",
        "enqueue_ms",
        F.lit(0).cast("long").alias("requeue_ms"),
        F.lit(0).alias("dequeue_count"),
        "value",
        F.expr(f"id div {SEGMENT_IDS}").alias("segment_id"),
    )


def order_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second family of queues: orders by priority, due on their date."""
    orders = read(spark, sf_dir, "orders")
    return orders.select(F.col("o_orderpriority").alias("queue"), F.col("o_orderkey").alias("id"), millis(F.col("o_orderdate")).alias("deadline_ms"), F.col("o_orderstatus").alias("value"))


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries in which purchases were released and errors requeued."""
    from tidemark.operators import entries as op

    enqueued = items(spark, sf_dir)
    first = pending(enqueued)
    released = op.release(pending(enqueued.where("event_type = 'purchase'")))
    requeued = op.requeue(pending(enqueued.where("event_type = 'error'")), F.col("id") + REQUEUE_ID, F.col("deadline_ms") + REQUEUE_DELAY_MS, F.col("deadline_ms"))
    return op.merge(first, released, requeued)


#: The same as common table expressions of DuckDB.
ITEMS_SQL = f"""
items AS (
  SELECT CAST(user_id AS VARCHAR) AS queue, event_id AS id, epoch_us(ts) // 1000 + CAST(floor(value) AS BIGINT) * 1000 AS deadline_ms,
         epoch_us(ts) // 1000 AS enqueue_ms, props AS value, event_type
  FROM events
), first AS (
  SELECT queue, '{PENDING}' AS kind, id, deadline_ms, enqueue_ms, CAST(0 AS BIGINT) AS requeue_ms, 0 AS dequeue_count, value, id // {SEGMENT_IDS} AS segment_id, event_type
  FROM items
)"""
LOG_SQL = f"""{ITEMS_SQL}, log AS (
  SELECT * EXCLUDE (event_type) FROM first
  UNION ALL SELECT queue, '{TOMBSTONE}', id, deadline_ms, NULL, NULL, NULL, NULL, segment_id FROM first WHERE event_type IN ('purchase', 'error')
  UNION ALL SELECT queue, '{PENDING}', id + {REQUEUE_ID}, deadline_ms + {REQUEUE_DELAY_MS}, enqueue_ms, deadline_ms, 1, value, (id + {REQUEUE_ID}) // {SEGMENT_IDS}
  FROM first WHERE event_type = 'error'
)"""
LIVE_SQL = f"""{LOG_SQL}, live AS (
  SELECT * FROM log p WHERE kind = '{PENDING}'
  AND NOT EXISTS (SELECT 1 FROM log t WHERE t.kind = '{TOMBSTONE}' AND t.queue = p.queue AND t.deadline_ms = p.deadline_ms AND t.id = p.id)
)"""
