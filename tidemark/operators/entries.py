"""Operators on entry logs as DataFrame plans: scans, merges, cancellation, top-k, counts, rewrites.

Entries are rows of tidemark.sources.tables.ENTRY_COLUMNS. Every operator is a plan and starts no job.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.tables import ENTRY_COLUMNS, PENDING, SEGMENT_IDS, TOMBSTONE

ITEM = ("id", "deadline_ms", "enqueue_ms", "requeue_ms", "dequeue_count", "value")
KEY = ("queue", "deadline_ms", "id")
#: The most items that one dequeue gives.
BATCH = 100


def kind_order() -> Column:
    """A tombstone sorts directly before its own pending item."""
    return F.when(F.col("kind") == TOMBSTONE, 0).otherwise(1)


def in_order(log: DataFrame) -> DataFrame:
    """All entries in key order across queues: deadline, id, tombstone first; the queue breaks ties."""
    return log.orderBy("deadline_ms", "id", kind_order(), "queue")


def resolve(kind: Column, argument_ms: Column, now_ms: Column) -> Column:
    """The deadline that a request asks for: now, relative or absolute."""
    return F.when(kind == "relative", now_ms + argument_ms).when(kind == "absolute", argument_ms).otherwise(now_ms)


def clamp(deadline_ms: Column, id_: Column, last_deadline_ms: Column, last_id: Column) -> Column:
    """A deadline that doesn't sort before the last dequeued key; a millisecond later where the id would."""
    later = F.greatest(deadline_ms, last_deadline_ms)
    return later + F.when((later == last_deadline_ms) & (id_ < last_id), 1).otherwise(0)


def merge(*logs: DataFrame) -> DataFrame:
    """The entries of several segments; in_order() sorts them."""
    return reduce(DataFrame.unionByName, (log.select(*ENTRY_COLUMNS) for log in logs))


def release(working: DataFrame) -> DataFrame:
    """The tombstones that releasing items writes, in the segments of their pending entries."""
    gone = {c: F.lit(None).cast(t).alias(c) for c, t in working.dtypes if c in ("enqueue_ms", "requeue_ms", "dequeue_count", "value")}
    return working.select(*(F.lit(TOMBSTONE).alias(c) if c == "kind" else gone.get(c, F.col(c)) for c in ENTRY_COLUMNS))


def requeue(working: DataFrame, new_id: Column, deadline_ms: Column, now_ms: Column) -> DataFrame:
    """Tombstones of the old keys, and pending entries under new ids with value and counts kept."""
    again = working.withColumns(
        {"id": new_id, "deadline_ms": deadline_ms, "requeue_ms": now_ms, "dequeue_count": F.col("dequeue_count") + 1, "segment_id": F.floor(new_id / SEGMENT_IDS).cast("long")}
    )
    return merge(release(working), again)


def live(log: DataFrame) -> DataFrame:
    """Pending items that no tombstone cancels."""
    tombstones = log.where(F.col("kind") == TOMBSTONE).select(*(F.col(k).alias(f"gone_{k}") for k in KEY))
    same = reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"gone_{k}")) for k in KEY))
    return log.where(F.col("kind") == PENDING).join(tombstones, same, "left_anti")


def unpaired(log: DataFrame) -> DataFrame:
    """All entries but the pairs of a tombstone and its pending item; tombstones of absent items stay.

    One pass: the entries of a key meet once, and stay if they are of one kind.
    """
    own = Window.partitionBy(*KEY)
    mixed = F.min(kind_order()).over(own) < F.max(kind_order()).over(own)
    return log.select(*ENTRY_COLUMNS, mixed.alias("__mixed")).where("NOT __mixed").drop("__mixed")


def after(log: DataFrame, deadline_ms: int, id_: int, kind: str) -> DataFrame:
    """The entries whose key follows the given one; the first range term reaches the scan."""
    rest = 1 if kind == PENDING else 0
    deadline, key = F.col("deadline_ms"), F.col("id")
    follows = (key > id_) | ((key == id_) & (kind_order() > rest))
    return log.where((deadline >= deadline_ms) & ((deadline > deadline_ms) | follows))


def ready(items: DataFrame, now_ms: int) -> DataFrame:
    return items.where(F.col("deadline_ms") <= now_ms)


def future(items: DataFrame, now_ms: int) -> DataFrame:
    return items.where(F.col("deadline_ms") > now_ms)


def first_of_all(items: DataFrame, count: int) -> DataFrame:
    """The first items of all queues together, at most BATCH: a top-k without a full sort."""
    return items.orderBy("deadline_ms", "id", "queue").limit(min(count, BATCH))


def first_of_each(items: DataFrame, count: int) -> DataFrame:
    """The first items of each queue with their rank, at most BATCH each.

    The ranks are limited before the shuffle too, so a queue with a third of all items sends a few rows a task.
    """
    rank = F.row_number().over(Window.partitionBy("queue").orderBy("deadline_ms", "id"))
    return items.withColumn("rank", rank).where(F.col("rank") <= min(count, BATCH))


def heads(items: DataFrame) -> DataFrame:
    """Each queue's first item, whether its deadline has passed or not."""
    row = F.struct("deadline_ms", *(c for c in ITEM if c != "deadline_ms"))
    return items.groupBy("queue").agg(F.min_by(row, F.struct("deadline_ms", "id")).alias("head")).select("queue", "head.*")


def info(log: DataFrame, working: DataFrame) -> DataFrame:
    """Each queue's pending and dequeued items, and the bytes of its values.

    pending = pending entries - tombstones - working items.
    """
    counts = log.groupBy("queue").agg(
        (F.count_if(F.col("kind") == PENDING) - F.count_if(F.col("kind") == TOMBSTONE)).alias("net"), F.coalesce(F.sum(F.octet_length("value")), F.lit(0)).alias("value_bytes")
    )
    taken = working.groupBy("queue").agg(F.count("*").alias("dequeued"))
    joined = counts.join(taken, "queue", "left").withColumn("dequeued", F.coalesce("dequeued", F.lit(0).cast("long")))
    return joined.select("queue", (F.col("net") - F.col("dequeued")).alias("pending"), "dequeued", "value_bytes")


def queues(log: DataFrame) -> DataFrame:
    return log.select("queue").distinct()


def undeleted(log: DataFrame, deletes: DataFrame) -> DataFrame:
    """Entries written after their queue's last delete; deletes are rows (queue, id) of the ids reached then."""
    last = deletes.groupBy("queue").agg(F.max("id").alias("deleted_id"))
    return log.join(last, "queue", "left").where(F.col("deleted_id").isNull() | (F.col("id") > F.col("deleted_id"))).drop("deleted_id")


def lookup(working: DataFrame, requests: DataFrame) -> DataFrame:
    """The status and item of each request (seq, queue, id) for a working item."""
    found = working.select("queue", "id", *(c for c in ITEM if c != "id"), F.lit(True).alias("found"))
    joined = requests.join(found, ["queue", "id"], "left")
    return joined.withColumn("status", F.when(F.col("found"), "OK").otherwise("ItemNotDequeued")).drop("found")


def placed(items: DataFrame, width_ms: int = 3_600_000) -> DataFrame:
    """items with their rank from 1 in their queue's key order.

    Ranks are counted within spans of deadlines and raised by the counts of earlier spans, so a queue with a
    third of all items is sorted by many tasks; only the spans' counts of a queue meet in one.
    """
    spanned = items.withColumn("__span", F.expr(f"deadline_ms div {width_ms}"))
    earlier = Window.partitionBy("queue").orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)
    counts = spanned.groupBy("queue", "__span").agg(F.count("*").alias("__n"))
    before = counts.select("queue", "__span", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    local = F.row_number().over(Window.partitionBy("queue", "__span").orderBy("deadline_ms", "id"))
    ranked = spanned.withColumn("__local", local).join(before, ["queue", "__span"])
    return ranked.withColumn("rank", F.col("__before") + F.col("__local")).drop("__span", "__local", "__before")


def deal(items: DataFrame, dequeues: DataFrame) -> DataFrame:
    """Items of each queue dealt out greedily to its dequeues (seq, queue, count) in order of seq.

    One ranking of the ready items serves all dequeues of a queue: a dequeue takes the ranks after those
    that earlier ones asked for. As it asks for BATCH at most, it meets the ranks of two blocks of BATCH.
    """
    asked = F.least(F.col("count"), F.lit(BATCH))
    before = Window.partitionBy("queue").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    spans = dequeues.select("seq", "queue", asked.alias("asked"), F.coalesce(F.sum(asked).over(before), F.lit(0)).alias("taken"))
    ends = F.array_distinct(F.array(F.expr(f"(taken + 1) div {BATCH}"), F.expr(f"(taken + asked) div {BATCH}")))
    spans = spans.withColumn("block", F.explode(ends))
    ranked = placed(items).withColumn("block", F.expr(f"rank div {BATCH}"))
    inside = (F.col("rank") > F.col("taken")) & (F.col("rank") <= F.col("taken") + F.col("asked"))
    return ranked.join(spans, ["queue", "block"]).where(inside).select("seq", "queue", "rank", *ITEM)


def drained(items: DataFrame, count: int) -> DataFrame:
    """The dequeue, numbered from 0, that hands out each item when a queue is emptied `count` at a time."""
    return placed(items).withColumn("dequeue", F.expr(f"(rank - 1) div {min(count, BATCH)}")).drop("rank")
