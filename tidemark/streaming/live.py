"""The state machine on a stream of operations, with event-time timers."""

from __future__ import annotations

import pickle
from collections.abc import Iterator, MutableMapping

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.streaming.machine import Item, Op, Pending, QueueMachine, Response
from tidemark.streaming.replay import RESPONSES, frame, op_of

#: State as RocksDB keeps it, which transformWithState needs.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Working(MutableMapping):
    """Working items in map state, each with its neighbours in the order of their dequeue.

    Only the last one's id and their number are kept beside the map, so a step reads the items that it touches and
    their neighbours, however many are out.
    """

    def __init__(self, stored: object, tail: int | None, count: int) -> None:
        self.stored, self.tail, self.count = stored, tail, count

    def _get(self, id_: int) -> list:
        if not self.stored.containsKey((id_,)):
            raise KeyError(id_)
        return pickle.loads(self.stored.getValue((id_,))[0])

    def _put(self, id_: int, item: Item, before: int | None, after: int | None) -> None:
        self.stored.updateValue((id_,), (pickle.dumps([item, before, after]),))

    def __getitem__(self, id_: int) -> Item:
        return self._get(id_)[0]

    def __setitem__(self, id_: int, item: Item) -> None:
        if id_ in self:
            _, before, after = self._get(id_)
            self._put(id_, item, before, after)
            return
        self._put(id_, item, self.tail, None)
        self._relink(self.tail, after=id_)
        self.tail, self.count = id_, self.count + 1

    def _relink(self, id_: int | None, **ends: int | None) -> None:
        if id_ is not None:
            item, before, after = self._get(id_)
            self._put(id_, item, ends.get("before", before), ends.get("after", after))

    def __delitem__(self, id_: int) -> None:
        _, before, after = self._get(id_)
        self.stored.removeKey((id_,))
        self._relink(before, after=after)
        self._relink(after, before=before)
        self.tail, self.count = before if id_ == self.tail else self.tail, self.count - 1

    def __contains__(self, id_: object) -> bool:
        return id_ is not None and self.stored.containsKey((id_,))

    def popitem(self) -> tuple[int, Item]:
        if self.tail is None:
            raise KeyError("no working item")
        return self.tail, self.pop(self.tail)

    def __iter__(self) -> Iterator[int]:
        at = self.tail
        while at is not None:
            yield at
            at = self._get(at)[1]

    def __len__(self) -> int:
        return self.count


class QueueProcessor(StatefulProcessor):
    """One queue's machine over stored state.

    A small value has the counters, the waiting dequeues and the index of deadline buckets; maps have the items
    of each bucket, the working items and the payloads. A micro-batch reads and writes
    the buckets and items that its operations touch, however many the queue holds.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("machine", "blob binary")
        self.buckets = handle.getMapState("pending", "bucket long", "items binary")
        self.working = handle.getMapState("working", "id long", "item binary")
        self.values = handle.getMapState("values", "id long", "value string")

    def _load(self) -> QueueMachine:
        fields, index, count, working = pickle.loads(self.state.get()[0]) if self.state.exists() else ({}, [], 0, (None, 0))

        def load(number: int) -> list:
            return pickle.loads(self.buckets.getValue((number,))[0])

        def save(number: int, items: list) -> None:
            if items:
                self.buckets.updateValue((number,), (pickle.dumps(items),))
            elif self.buckets.containsKey((number,)):
                self.buckets.removeKey((number,))

        machine = QueueMachine(Pending(load=load, save=save, index=index, count=count), _Working(self.working, *working))
        for name, value in fields.items():
            setattr(machine, name, value)
        return machine

    def _save(self, machine: QueueMachine) -> None:
        machine.pending.flush()
        fields = {k: getattr(machine, k) for k in ("exists", "next_id", "last", "waiting")}
        self.state.update((pickle.dumps((fields, machine.pending.index, machine.pending.count, (machine.working.tail, machine.working.count))),))
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if (at := machine.wake_at()) is not None:
            self.handle.registerTimer(at)

    def _filled(self, responses: list[Response]) -> list[Response]:
        """responses with the payloads of their items."""
        for r in responses:
            for item in r.items:
                key = (item["value"],) if item["value"] is not None else None
                item["value"] = self.values.getValue(key)[0] if key and self.values.containsKey(key) else None
        return responses

    def _step(self, machine: QueueMachine, batch: list[Op], now: int) -> list[Response]:
        """A batch in which the machine sees payloads as their numbers; those of items that are gone after it go too."""
        for o in batch:
            if o.op == "enqueue" and o.value is not None:
                self.values.updateValue((o.seq,), (o.value,))
                o.value = o.seq
        out = self._filled(machine.step(batch, now))
        for item in machine.dropped:
            if item.value is not None and self.values.containsKey((item.value,)):
                self.values.removeKey((item.value,))
        machine.dropped.clear()
        return out

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        machine, out = self._load(), []
        ops = pd.concat(list(rows)).sort_values(["batch_id", "seq"]).astype(object)
        for _, part in ops.groupby("batch_id", sort=True):
            now = int(part["now_ms"].iloc[0])
            out += self._filled(machine.run_until(now - 1))
            out += self._step(machine, [op_of(r) for r in part.itertuples(index=False)], now)
        self._save(machine)
        yield frame([(key[0], r) for r in out])

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        machine = self._load()
        out = self._filled(machine.run_until(expiredTimerInfo.getExpiryTimeInMs()))
        self._save(machine)
        yield frame([(key[0], r) for r in out])

    def close(self) -> None:
        pass


def respond(ops: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """The responses to a stream of operations, with columns as replay() wants them.

    Batches are the log's own, not Spark's; a batch must not be split over micro-batches. A waiting dequeue
    ends when the watermark passes its time, or the next operation of its queue does. State and responses
    are exactly-once with a checkpoint; nothing is dropped as late.
    """
    timed = ops.withColumn("at", F.timestamp_millis("now_ms")).withWatermark("at", delay)
    return timed.groupBy("queue").transformWithStateInPandas(QueueProcessor(), RESPONSES, "Update", "EventTime")
