import random

from tidemark.sources import tables
from tidemark.streaming import live, replay
from tidemark.streaming.machine import Op, QueueMachine

SF = "/root/testdata/sf0.001"


def shown(df):
    return sorted((r.queue, r.seq, r.status, r.id, r.deadline_ms, r.pending, r.dequeued, [tuple(i) for i in r["items"]]) for r in df.collect()) if hasattr(df, "collect") else df


def random_ops(seed, n):
    r = random.Random(seed)
    rows, now = [], 1_000
    for seq in range(n):
        now += r.randrange(40)
        op = r.choice(["enqueue"] * 4 + ["dequeue"] * 3 + ["release", "requeue", "peek", "info"] + ["delete"] * (r.random() < 0.05))
        queue = r.choice(("a", "b", "c"))
        rows.append((seq, seq, now, queue, op, f"v{seq}" if op == "enqueue" else None, r.choice(("now", "relative", "absolute")), r.randrange(200), None, op in ("release", "requeue"), r.randrange(1, 4), r.choice((0, 0, 50))))
    return rows


def test_replay_matches_the_machine(spark):
    rows = random_ops(1, 400)
    want = []
    for queue in "abc":
        m = QueueMachine()
        for x in (x for x in rows if x[3] == queue):
            op = Op(x[0], x[4], x[5], x[6], x[7], x[8], x[9], x[10], x[11])
            want += [(queue, q) for q in m.run_until(x[2] - 1) + m.step([op], x[2])]
        want += [(queue, q) for q in m.run_until(1 << 62)]
    got = replay.replay(spark.createDataFrame(rows, replay.OPS)).collect()
    assert sorted((r.queue, r.seq, r.status, [i.value for i in r["items"]]) for r in got) == sorted((q, r.seq, r.status, [i["value"] for i in r.items]) for q, r in want)
    assert sorted(r.seq for r in got) == list(range(400))
    assert replay.replay(spark.createDataFrame([], replay.OPS)).count() == 0


def test_draining_gives_fifo_order(spark):
    items = tables.items(spark, SF)
    got = replay.replay(replay.enqueue_then_drain(items, 7, 1_900_000_000_000)).where("size(items) > 0").orderBy("queue", "seq").collect()
    by = {}
    for r in got:
        by.setdefault(r.queue, []).extend((i.deadline_ms, i.id) for i in r["items"])
    want = {}
    for r in items.collect():
        want.setdefault(r.queue, []).append((r.deadline_ms, r.id))
    assert by == {q: sorted(v) for q, v in want.items()}


def batched(rows, r):
    """rows of which neighbours of one queue share a batch now and then, at the first one's time."""
    out = []
    for x in rows:
        last = next((y for y in reversed(out) if y[3] == x[3]), None)
        joined = last is not None and out[-1][3] == x[3] and r.random() < 0.5
        out.append((x[0], last[1], last[2], *x[3:]) if joined else x)
    return out


def streamed(spark, folder, rows, parts, name):
    """The responses of a stream over the rows in so many micro-batches, none of which splits a batch."""
    ops = spark.createDataFrame(rows, replay.OPS)
    bounds = sorted({rows[len(rows) * k // parts][1] for k in range(1, parts)})
    for low, high in zip([-1, *bounds], [*bounds, 1 << 40]):
        ops.where(f"batch_id >= {low} AND batch_id < {high}").coalesce(1).write.mode("append").parquet(f"{folder}/ops")
    stream = spark.readStream.schema(ops.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/ops")
    query = live.respond(stream).writeStream.format("memory").queryName(name).outputMode("update").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    assert query.awaitTermination(180)
    return spark.table(name)


def test_stream_gives_what_replay_gives(spark, tmp_path):
    rows = [x for x in random_ops(2, 150) if x[11] == 0]
    assert shown(streamed(spark, tmp_path, rows, 3, "responses")) == shown(replay.replay(spark.createDataFrame(rows, replay.OPS)))


def test_stream_of_blocking_dequeues_and_of_batches(spark, tmp_path):
    """Dequeues that wait, several to a queue, batches of several operations; the last operations end all waits."""
    r = random.Random(9)
    rows = batched([(*x[:11], r.choice((0, 50, 200, 1_000)) if x[4] == "dequeue" else 0) for x in random_ops(3, 240)], r)
    assert len({(x[1], x[3]) for x in rows}) < 220
    end = rows[-1][2] + 100_000
    rows += [(1_000 + k, 1_000 + k, end, q, "info", None, "now", 0, None, False, 1, 0) for k, q in enumerate("abc")]
    want = shown(replay.replay(spark.createDataFrame(rows, replay.OPS)))
    assert sum(x[2] == "NoItemReady" for x in want) > 10
    assert shown(streamed(spark, tmp_path, rows, 5, "blocked")) == want


def test_stream_keeps_no_payload_of_an_item_that_is_gone(spark, tmp_path):
    """After items are released by id and by ANY, and a queue deleted, only payloads of items that are left are stored."""
    def op(seq, queue, name, **more):
        own = {"value": None, "deadline_kind": "now", "deadline_arg_ms": 0, "id": None, "id_any": False, "count": 1, "timeout_ms": 0} | more
        return (seq, seq, 1_000 + seq, queue, name, *own.values())

    rows = [op(k, "ab"[k % 2], "enqueue", value=f"v{k}") for k in range(12)]
    rows += [op(20, "a", "dequeue", count=4), op(21, "a", "release", id=0), op(22, "a", "release", id_any=True), op(23, "b", "dequeue", count=2), op(24, "b", "delete"), op(25, "b", "enqueue", value="new")]
    got = streamed(spark, tmp_path, rows, 2, "kept").collect()
    assert sum(x.status == "OK" for x in got) == len(rows)
    kept = spark.read.format("statestore").option("stateVarName", "values").load(f"{tmp_path}/checkpoint")
    assert sorted(x[0] for x in kept.selectExpr("user_map_value.value").collect()) == ["new", "v10", "v2", "v4", "v8"]
    assert spark.read.format("statestore").option("stateVarName", "working").load(f"{tmp_path}/checkpoint").count() == 2
