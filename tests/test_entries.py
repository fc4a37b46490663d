"""Merging, cancellation, seeks and dequeue order on small logs."""

import random

import pytest

from tidemark.operators import entries as op

SCHEMA = "queue string, kind string, id long, deadline_ms long, enqueue_ms long, requeue_ms long, dequeue_count int, value string, segment_id long"


def log(spark, rows):
    """rows (kind, id, deadline) of queue q, or (kind, id, deadline, queue)."""
    full = []
    for kind, id_, deadline, *queue in rows:
        name = "pending" if kind == "P" else "tombstone"
        rest = (1, 0, 0, f"v{id_}") if kind == "P" else (None,) * 4
        full.append((queue[0] if queue else "q", name, id_, deadline, *rest, 0))
    return spark.createDataFrame(full, SCHEMA)


def keys(df):
    return [(r.id, r.deadline_ms) for r in op.in_order(df).collect()]


def test_tombstones_cancel_their_items(spark):
    a, b = log(spark, [("P", 1, 1), ("P", 2, 1)]), log(spark, [("T", 1, 1)])
    assert keys(op.live(op.merge(a, b))) == [(2, 1)] and keys(op.unpaired(op.merge(a, b))) == [(2, 1)]


def test_merge_to_nothing(spark):
    rows = [(k, i, 1) for i in range(1, 10) for k in "PT"]
    assert keys(op.unpaired(log(spark, rows))) == []


def test_unmatched_tombstones_stay(spark):
    rows = log(spark, [("P", 1, 1), ("T", 1, 2), ("T", 2, 1), ("P", 1, 1, "other")])
    assert keys(op.unpaired(rows)) == [(1, 1), (1, 1), (2, 1), (1, 2)]


def test_five_way_merge_is_sorted(spark):
    parts = [log(spark, [("P", i, i) for i in range(k, 500, 5)]) for k in range(5)]
    assert keys(op.merge(*parts)) == [(i, i) for i in range(500)]


@pytest.mark.parametrize(("pos", "first"), [(98, 100), (99, 100), (100, 101), (198, 199), (199, None), (200, None)])
def test_seek_edges(spark, pos, first):
    rows = log(spark, [("T", i, 0) for i in range(100, 200)])
    found = keys(op.after(rows, 0, pos, "tombstone"))
    assert (found[0][0] if found else None) == first


def test_a_tombstone_sorts_before_its_item(spark):
    rows = log(spark, [("P", 5, 3), ("T", 5, 3)])
    assert [r.kind for r in op.in_order(rows).collect()] == ["tombstone", "pending"]
    assert [r.kind for r in op.after(rows, 3, 5, "tombstone").collect()] == ["pending"]


def test_shuffled_deadlines_come_out_in_order(spark):
    ids = list(range(100))
    random.Random(0).shuffle(ids)
    items = log(spark, [("P", i, 1000 + d) for i, d in enumerate(ids)])
    assert [r.deadline_ms for r in op.first_of_all(items, 500).collect()] == [1000 + i for i in range(100)]
    assert op.first_of_all(log(spark, [("P", i, i) for i in range(300)]), 500).count() == op.BATCH


def test_equal_deadlines_are_fifo_and_peek_sees_the_future(spark):
    items = log(spark, [("P", 3, 9), ("P", 1, 9), ("P", 2, 9), ("P", 7, 4, "b")])
    assert [r.id for r in op.first_of_each(op.ready(items, 9), 2).where("queue = 'q'").orderBy("rank").collect()] == [1, 2]
    assert op.ready(items, 3).count() == 0 and {r.queue: r.id for r in op.heads(items).collect()} == {"q": 1, "b": 7}


def test_requeue_and_info(spark):
    from pyspark.sql import functions as F

    items = log(spark, [("P", 1, 5), ("P", 2, 6)])
    working = items.where("id = 1")
    whole = op.merge(items, op.requeue(working, F.col("id") + 10, F.lit(50), F.lit(20)))
    again = op.live(whole).where("id = 11").first()
    assert (again.deadline_ms, again.requeue_ms, again.dequeue_count, again.value) == (50, 20, 1, "v1")
    info = op.info(whole, op.live(whole).where("id = 2")).first()
    assert (info.pending, info.dequeued) == (1, 1)


def test_plans_keep_filters_and_limits_low(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    items = events.selectExpr("cast(user_id as string) as queue", "event_id as id", "event_id as deadline_ms", "0L as enqueue_ms", "0L as requeue_ms", "0 as dequeue_count", "props as value")

    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    assert "TakeOrderedAndProject" in plan(op.first_of_all(op.ready(items, 500), 10))
    assert "WindowGroupLimit" in plan(op.first_of_each(items, 3))
    assert "PushedFilters: [IsNotNull(event_id), LessThanOrEqual(event_id,500)]" in plan(op.ready(items, 500))
