"""The state machine: one queue's ordered semantics."""

from tidemark.streaming.machine import NO_QUEUE, NOT_DEQUEUED, NOT_READY, OK, Op, QueueMachine


def enqueue(seq, value, **k):
    return Op(seq, "enqueue", value=value, **k)


def absolute(at):
    return {"deadline_kind": "absolute", "deadline_arg_ms": at}


def one(machine, op, now):
    (response,) = machine.step([op], now)
    return response


def values(response):
    return [i["value"] for i in response.items]


def test_smoke():
    m = QueueMachine()
    assert one(m, Op(0, "dequeue"), 1).status == NO_QUEUE
    assert one(m, enqueue(1, "hello"), 10).deadline_ms == 10
    got = one(m, Op(2, "dequeue"), 11)
    assert values(got) == ["hello"] and got.items[0]["dequeue_count"] == 1
    assert one(m, Op(3, "release", id=got.items[0]["id"]), 12).status == OK
    info = one(m, Op(4, "info"), 13)
    assert (info.pending, info.dequeued) == (0, 0)
    assert one(m, Op(5, "delete"), 14).status == OK and one(m, Op(6, "peek"), 15).status == NO_QUEUE


def test_order_and_cap():
    m = QueueMachine()
    for i in range(150):
        one(m, enqueue(i, str(149 - i), **absolute(1000 + 149 - i)), 1)
    assert values(one(m, Op(200, "dequeue", count=500), 2000)) == [str(i) for i in range(100)]
    info = one(m, Op(201, "info"), 2001)
    assert (info.pending, info.dequeued) == (50, 100)


def test_requeue_keeps_value_and_counts():
    m = QueueMachine()
    one(m, enqueue(0, "v"), 5)
    first = one(m, Op(1, "dequeue"), 6).items[0]
    assert one(m, Op(2, "requeue", id=first["id"]), 7).deadline_ms == 7
    again = one(m, Op(3, "dequeue"), 8).items[0]
    assert (again["value"], again["dequeue_count"], again["requeue_ms"], again["enqueue_ms"]) == ("v", 2, 7, 5) and again["id"] != first["id"]
    assert one(m, Op(4, "requeue", id=first["id"]), 9).status == NOT_DEQUEUED
    assert one(m, Op(5, "release", id_any=True), 9).id == again["id"]
    assert one(m, Op(6, "release", id_any=True), 9).status == NOT_DEQUEUED


def test_future_items_can_be_peeked_only():
    m = QueueMachine()
    one(m, enqueue(0, "later", deadline_kind="relative", deadline_arg_ms=3_600_000), 0)
    assert one(m, Op(1, "dequeue"), 1).status == NOT_READY and values(one(m, Op(2, "peek"), 1)) == ["later"]


def test_a_blocking_dequeue_waits_for_an_item():
    m = QueueMachine()
    one(m, enqueue(0, "far", **absolute(3_600_000)), 0)
    assert m.step([Op(1, "dequeue", timeout_ms=10_000, count=5)], 0) == []
    assert m.wake_at() == 10_000
    m.step([enqueue(2, "near", deadline_kind="relative", deadline_arg_ms=100)], 5)
    assert m.wake_at() == 105 and m.run_until(104) == []
    (got,) = m.run_until(200)
    assert got.seq == 1 and values(got) == ["near"]


def test_waiting_dequeues_are_served_in_order_and_end():
    m = QueueMachine()
    one(m, enqueue(0, "x", **absolute(10**9)), 0)
    for seq, wait in ((1, 50), (2, 500), (3, 500)):
        m.step([Op(seq, "dequeue", timeout_ms=wait)], 0)
    (ended,) = m.run_until(60)
    assert (ended.seq, ended.status) == (1, NOT_READY)
    got = m.step([Op(4, "dequeue"), enqueue(5, "a"), enqueue(6, "b")], 100)
    assert {r.seq: values(r) for r in got if r.items} == {2: ["a"], 3: ["b"]}
    assert next(r for r in got if r.seq == 4).status == NOT_READY


def test_a_delivery_at_the_last_moment_wins():
    m = QueueMachine()
    one(m, enqueue(0, "x", **absolute(50)), 0)
    m.step([Op(1, "dequeue", timeout_ms=50)], 0)
    (got,) = m.run_until(50)
    assert values(got) == ["x"]


def test_writes_of_a_batch_precede_its_dequeues_and_looks_come_first():
    m = QueueMachine()
    one(m, enqueue(0, "a"), 1)
    got = {r.seq: r for r in m.step([Op(1, "dequeue", count=2), Op(2, "info"), Op(3, "peek"), enqueue(4, "b")], 2)}
    assert values(got[1]) == ["a", "b"] and (got[2].pending, values(got[3])) == (1, ["a"])
    one(m, Op(5, "dequeue"), 3)
    both = {r.seq: r for r in m.step([Op(6, "release", id_any=True), Op(7, "info")], 4)}
    assert (both[7].pending, both[7].dequeued) == (1, 1)  # the released item counts as pending until the batch is committed


def test_new_deadlines_never_sort_before_the_last_dequeued_key():
    m = QueueMachine()
    one(m, enqueue(0, "a", **absolute(100)), 1)
    first = one(m, Op(1, "dequeue"), 200).items[0]
    assert one(m, enqueue(2, "b", **absolute(50)), 201).deadline_ms == 100
    one(m, Op(3, "dequeue"), 202)
    assert one(m, Op(4, "requeue", id=first["id"], **absolute(50)), 203).deadline_ms == 101


def test_delete_ends_waiting_dequeues():
    m = QueueMachine()
    one(m, enqueue(0, "x", **absolute(10**9)), 0)
    m.step([Op(1, "dequeue", timeout_ms=10**6)], 0)
    assert sorted((r.seq, r.status) for r in m.step([Op(2, "delete")], 1)) == [(1, NOT_READY), (2, OK)]
