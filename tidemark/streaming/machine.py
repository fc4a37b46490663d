"""The ordered semantics of one queue, as a plain state machine.

Operations come in batches. In a batch, looks (peek, info) see the state before it; then enqueues,
requeues and releases are applied in order; then items are dequeued, waiting dequeues first. A batch of one
operation is plain sequential processing.
"""

from __future__ import annotations

import bisect
import heapq
from collections.abc import MutableMapping
from dataclasses import asdict, dataclass, field

BATCH = 100
OK, NO_QUEUE, NOT_READY, NOT_DEQUEUED = "OK", "NoSuchQueue", "NoItemReady", "ItemNotDequeued"


@dataclass
class Op:
    seq: int
    op: str
    value: str | None = None
    deadline_kind: str = "now"
    deadline_arg_ms: int = 0
    id: int | None = None
    id_any: bool = False
    count: int = 1
    timeout_ms: int = 0


@dataclass
class Response:
    seq: int
    status: str
    id: int | None = None
    deadline_ms: int | None = None
    items: list[dict] = field(default_factory=list)
    pending: int | None = None
    dequeued: int | None = None


@dataclass
class Item:
    id: int
    deadline_ms: int
    enqueue_ms: int
    requeue_ms: int
    dequeue_count: int
    value: str | None


class Pending:
    """Pending items in key order, kept in buckets of deadlines of which only those in use are at hand.

    load and save give and take a bucket's items by its number; by default all buckets stay in memory. The
    index has the numbers of the buckets that aren't empty.
    """

    def __init__(self, width_ms: int = 60_000, load=None, save=None, index: list[int] | None = None, count: int = 0) -> None:
        self.width_ms, self.load, self.save = width_ms, load, save
        self.index, self.count = list(index or ()), count
        self.at_hand: dict[int, list[tuple[int, int, Item]]] = {}
        self.changed: set[int] = set()

    def __len__(self) -> int:
        return self.count

    def _bucket(self, number: int) -> list[tuple[int, int, Item]]:
        if number not in self.at_hand:
            known = bisect.bisect_left(self.index, number)
            stored = known < len(self.index) and self.index[known] == number
            if not stored:
                self.index.insert(known, number)
            self.at_hand[number] = list(self.load(number)) if stored else []
        return self.at_hand[number]

    def push(self, item: Item) -> None:
        number = item.deadline_ms // self.width_ms
        heapq.heappush(self._bucket(number), (item.deadline_ms, item.id, item))
        self.changed.add(number)
        self.count += 1

    def head(self) -> Item | None:
        return self._bucket(self.index[0])[0][2] if self.index else None

    def pop(self) -> Item:
        number = self.index[0]
        bucket = self._bucket(number)
        item = heapq.heappop(bucket)[2]
        self.changed.add(number)
        self.count -= 1
        if not bucket:
            del self.index[0], self.at_hand[number]
        return item

    def flush(self) -> None:
        """Saves the buckets that have changed; an emptied one as no items."""
        for number in sorted(self.changed):
            self.save(number, self.at_hand.get(number, []))
        self.changed.clear()


class QueueMachine:
    """One queue: pending items by key, working items by id in order of their dequeue, waiting dequeues.

    Ids are the machine's own counter unless an enqueue names one; they ascend either way. ANY takes the
    working item that was dequeued last. pending and working may be views of stored state.
    """

    def __init__(self, pending: Pending | None = None, working: MutableMapping[int, Item] | None = None) -> None:
        self.pending = Pending() if pending is None else pending
        self.working: MutableMapping[int, Item] = {} if working is None else working
        self.exists = False
        self.next_id = 0
        self.last = (0, 0)
        self.waiting: list[list[int]] = []
        #: Items that releases and deletes have removed for good, for whoever keeps their payloads.
        self.dropped: list[Item] = []

    def _resolve(self, op: Op, now_ms: int, id_: int, last: tuple[int, int]) -> int:
        asked = {"relative": now_ms + op.deadline_arg_ms, "absolute": op.deadline_arg_ms}.get(op.deadline_kind, now_ms)
        asked = max(asked, last[0])
        return asked + (asked == last[0] and id_ < last[1])

    def _new_id(self, wanted: int | None) -> int:
        new = max(self.next_id, 0 if wanted is None else wanted)
        self.next_id = new + 1
        return new

    def _taken(self, op: Op) -> Item | None:
        if op.id_any:
            return self.working.popitem()[1] if self.working else None
        return self.working.pop(op.id, None)

    def _dequeue(self, now_ms: int, count: int) -> list[Item]:
        out = []
        while len(out) < count and (head := self.pending.head()) and head.deadline_ms <= now_ms:
            item = self.pending.pop()
            self.last = (item.deadline_ms, item.id)
            item.dequeue_count += 1
            self.working[item.id] = item
            out.append(item)
        return out

    def step(self, batch: list[Op], now_ms: int) -> list[Response]:
        """The responses to a batch and to the waiting dequeues that it serves or that end; an empty batch is a timer."""
        out: list[Response] = []
        self.dropped.clear()
        if not self.exists and not any(o.op == "enqueue" for o in batch):
            return [Response(o.seq, NO_QUEUE) for o in batch]
        early = []
        if not self.exists:
            first = next(i for i, o in enumerate(batch) if o.op == "enqueue")
            early, batch = batch[:first], batch[first:]
            self.exists = True
        out += [Response(o.seq, NO_QUEUE) for o in early]
        head = self.pending.head() if any(o.op == "peek" for o in batch) else None
        head = asdict(head) if head else None
        stored, last = len(self.pending) + len(self.working), self.last
        dequeues, info = [], None
        for op in batch:
            if op.op == "enqueue":
                new = self._new_id(op.id)
                item = Item(new, self._resolve(op, now_ms, new, last), now_ms, 0, 0, op.value)
                self.pending.push(item)
                out.append(Response(op.seq, OK, item.id, item.deadline_ms))
            elif op.op in ("requeue", "release"):
                item = self._taken(op)
                if item is None:
                    out.append(Response(op.seq, NOT_DEQUEUED))
                elif op.op == "release":
                    self.dropped.append(item)
                    out.append(Response(op.seq, OK, item.id))
                else:
                    due = self._resolve(op, now_ms, item.id, last)
                    again = Item(self._new_id(None), due, item.enqueue_ms, now_ms, item.dequeue_count, item.value)
                    self.pending.push(again)
                    out.append(Response(op.seq, OK, again.id, due))
            elif op.op == "peek":
                out.append(Response(op.seq, OK if head else NOT_READY, items=[dict(head)] if head else []))
            elif op.op == "info":
                info = info or (stored - len(self.working), len(self.working))
                out.append(Response(op.seq, OK, pending=info[0], dequeued=info[1]))
            elif op.op == "dequeue":
                dequeues.append(op)
            else:
                out.append(Response(op.seq, OK))
        waiting, self.waiting = self.waiting, []
        asked = [[w[0], w[1], w[2]] for w in waiting] + [[o.seq, min(max(o.count, 1), BATCH), now_ms + o.timeout_ms] for o in dequeues]
        ready = self._dequeue(now_ms, sum(a[1] for a in asked))
        for seq, count, until in asked:
            if ready:
                out.append(Response(seq, OK, items=[asdict(i) for i in ready[:count]]))
                ready = ready[count:]
            elif until <= now_ms:
                out.append(Response(seq, NOT_READY))
            else:
                self.waiting.append([seq, count, until])
        if any(o.op == "delete" for o in batch):
            out += [Response(seq, NOT_READY) for seq, _, _ in self.waiting]
            while len(self.pending):
                self.dropped.append(self.pending.pop())
            while len(self.working):
                self.dropped.append(self.working.popitem()[1])
            self.exists, self.last, self.waiting = False, (0, 0), []
        return out

    def wake_at(self) -> int | None:
        """When something happens without an operation: a waiting dequeue ends, or an item is due for it."""
        if not self.waiting:
            return None
        head = self.pending.head()
        return min([w[2] for w in self.waiting] + ([head.deadline_ms] if head else []))

    def run_until(self, now_ms: int) -> list[Response]:
        """The responses of all timers up to now_ms, each at its own time."""
        out = []
        while (at := self.wake_at()) is not None and at <= now_ms:
            out += self.step([], at)
        return out
