"""Batch replay of an operation log, queue by queue in order."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.streaming.machine import Op, QueueMachine, Response

#: The columns of an operation log.
OPS = "seq long, batch_id long, now_ms long, queue string, op string, value string, deadline_kind string, deadline_arg_ms long, id long, id_any boolean, count long, timeout_ms long"
ITEM = "struct<id: long, deadline_ms: long, enqueue_ms: long, requeue_ms: long, dequeue_count: int, value: string>"
RESPONSES = f"queue string, seq long, status string, id long, deadline_ms long, items array<{ITEM}>, pending long, dequeued long"


def op_of(row: object) -> Op:
    def get(name: str, default: object) -> object:
        value = getattr(row, name)
        return default if value is None or value != value else value

    return Op(
        seq=int(row.seq),
        op=row.op,
        value=get("value", None),
        deadline_kind=get("deadline_kind", "now"),
        deadline_arg_ms=int(get("deadline_arg_ms", 0)),
        id=None if get("id", None) is None else int(row.id),
        id_any=bool(get("id_any", False)),
        count=int(get("count", 1)),
        timeout_ms=int(get("timeout_ms", 0)),
    )


def frame(responses: list[tuple[str | None, Response]]) -> pd.DataFrame:
    """Rows of RESPONSES for responses with their queues."""
    rows = [(queue, r.seq, r.status, r.id, r.deadline_ms, r.items, r.pending, r.dequeued) for queue, r in responses]
    out = pd.DataFrame(rows, columns=["queue", "seq", "status", "id", "deadline_ms", "items", "pending", "dequeued"])
    return out.astype({c: "Int64" for c in ("seq", "id", "deadline_ms", "pending", "dequeued")})


def replay(ops: DataFrame) -> DataFrame:
    """The response to each operation of the log; rows of OPS, in order of batch_id and seq within a queue.

    Operations that share a batch_id and a queue are one batch at the first one's now_ms. Waiting dequeues
    end at their own times, those still waiting after the log at the times that they asked for. A queue's
    operations stream through one task, since they depend on each other; it holds the queue's items and a
    batch, never the log.
    """
    names = [c.split()[0] for c in OPS.split(", ")]
    ordered = ops.select(*names).repartition("queue").sortWithinPartitions("queue", "batch_id", "seq")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine, queue, batch_id, now, batch = QueueMachine(), None, None, 0, []
        started = False

        def flush() -> list[Response]:
            nonlocal batch
            done, batch = batch, []
            return machine.run_until(now - 1) + machine.step(done, now) if done else []

        for part in frames:
            made = []
            for row in part.astype(object).itertuples(index=False):
                name = row.queue
                if not started or name != queue:
                    if started:
                        made += [(queue, r) for r in flush() + machine.run_until(1 << 62)]
                    machine, queue, batch_id, started = QueueMachine(), name, None, True
                if row.batch_id != batch_id:
                    made += [(queue, r) for r in flush()]
                    batch_id, now = row.batch_id, int(row.now_ms)
                batch.append(op_of(row))
            if made:
                yield frame(made)
        if started:
            yield frame([(queue, r) for r in flush() + machine.run_until(1 << 62)])

    return ordered.mapInPandas(run, RESPONSES)


def enqueue_then_drain(items: DataFrame, count: int, now_ms: int) -> DataFrame:
    """An operation log that enqueues all items in order of id and then empties each queue `count` at a time."""
    blank = {c: F.lit(None).cast(t) for c, t in (x.split() for x in OPS.split(", "))}
    first = items.select(
        *(
            {
                "seq": F.col("id"),
                "batch_id": F.col("id"),
                "now_ms": F.col("enqueue_ms"),
                "queue": F.col("queue"),
                "op": F.lit("enqueue"),
                "value": F.col("value"),
                "deadline_kind": F.lit("absolute"),
                "deadline_arg_ms": F.col("deadline_ms"),
                "id": F.col("id"),
            }.get(c, blank[c]).alias(c)
            for c in blank
        )
    )
    sizes = items.groupBy("queue").agg(F.count("*").alias("n"), F.max("id").alias("top"))
    turns = sizes.select("queue", F.explode(F.sequence(F.lit(1), F.ceil(F.col("n") / count) + 1)).alias("turn"))
    base = 1 << 40
    then = turns.select(
        *(
            {
                "seq": F.col("turn") + base,
                "batch_id": F.col("turn") + base,
                "now_ms": F.lit(now_ms),
                "queue": F.col("queue"),
                "op": F.lit("dequeue"),
                "count": F.lit(count),
            }.get(c, blank[c]).cast(t).alias(c)
            for c, t in (x.split() for x in OPS.split(", "))
        )
    )
    return first.unionByName(then)
