import random

from tidemark.operators import entries as op
from tidemark.sources import commands, files, ids, tables, wal
from tidemark.sources.store import SegmentStore

SF = "/root/testdata/sf0.001"


def parsed(spark, *lines):
    rows = commands.parse_commands(spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "seq long, command string"))
    return [r.asDict() for r in rows.orderBy("seq").collect()]


def test_commands(spark):
    a, b, c, d, e = parsed(spark, "ENQUEUE q v", "enqueue q v DELAY 10", "dequeue q COUNT 3 TIMEOUT 9", "REQUEUE q ANY deadline -5", "release q 12")
    assert (a["op"], a["queue"], a["value"], a["deadline_kind"], a["error"]) == ("ENQUEUE", "q", "v", "now", None)
    assert (b["deadline_kind"], b["deadline_arg_ms"]) == ("relative", 10) and (c["count"], c["timeout_ms"]) == (3, 9)
    assert (d["id_any"], d["deadline_kind"], d["deadline_arg_ms"]) == (True, "absolute", -5) and (e["id"], e["id_any"]) == (12, False)


def test_bad_commands(spark):
    bad = ["", "FLY q", "ENQUEUE q", "ENQUEUE q v DELAY -1", "ENQUEUE q v WHEN 1", "ENQUEUE q v DELAY x", "DEQUEUE q COUNT 0", "DEQUEUE q TIMEOUT x", "DEQUEUE q FAST 1", "RELEASE q x", "PEEK"]
    assert all(r["error"] for r in parsed(spark, *bad))
    assert [r["error"] for r in parsed(spark, "PING", "INFO", "INFO q", "PEEK q", "DELETE q", "COMPACT q")] == [None] * 6


def entry(r, k):
    base = {"id": k, "deadline_ms": 1_431_735_440_000 + r.randrange(10**9), "segment_id": r.randrange(9)}
    if r.random() < 0.5:
        return base | {"kind": "tombstone"}
    return base | {"kind": "pending", "enqueue_ms": r.randrange(10**12), "requeue_ms": 0, "dequeue_count": r.randrange(3), "value": r.randbytes(r.choice((0, 32, 256)))}


def test_write_ahead_logs(spark, tmp_path):
    r = random.Random(0)
    batches = [[entry(r, 100 * b + k) for k in range(r.choice((1, 10, 50)))] for b in range(30)]
    data = b"".join(map(wal.encode, batches))
    assert list(wal.decode(data)) == [e for b in batches for e in b] and list(wal.decode(b"")) == []
    block = wal.encode(batches[0])
    for cut in (1, 4, len(block) - 1):
        assert list(wal.decode(data + block[:cut]))[-1] == {"error": wal.TRUNCATED}
    assert list(wal.decode(block + block[:-4] + bytes(4)))[-1] == {"error": wal.CHECKSUM}
    (tmp_path / "a.wal").write_bytes(data)
    (tmp_path / "b.wal").write_bytes(block[:-1])
    got = wal.read_wal(spark, str(tmp_path)).collect()
    assert [(x.id, x.value) for x in sorted(got, key=lambda x: x.place) if x.error is None] == [(e["id"], e.get("value")) for b in batches for e in b]
    assert [x.error for x in got if x.error] == [wal.TRUNCATED]


def test_store_flushes_reads_and_compacts(spark, tmp_path):
    store, log = SegmentStore(spark, str(tmp_path)), tables.log(spark, SF)
    assert store.manifest().count() == 0 and not store.due()
    store.flush(log.where("kind = 'pending' AND id < 500"))
    store.flush(log.where("kind = 'tombstone' OR id >= 500"))
    key = lambda df: sorted((r.queue, r.kind, r.id, r.deadline_ms, r.value or "") for r in df.collect())
    assert key(store.entries()) == key(log) and store.manifest().count() == 2
    store.compact()
    assert key(store.entries()) == key(op.unpaired(log)) and store.manifest().count() == 1
    assert sorted(files.numbered(spark, str(tmp_path), "generation")) == [2]
    plan = store.entries().where("deadline_ms > 5")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(deadline_ms,5)" in plan


def test_replies(spark):
    rows = commands.replies(spark.createDataFrame([(s,) for s in commands.REPLIES], "status string")).collect()
    assert {r.status: (r.http, r.grpc, r.resp) for r in rows} == commands.REPLIES


def test_http_requests(spark):
    rows = [
        ("POST", "/queues/a/enqueue", '{"value": "aGk=", "deadline": "+5s"}'),
        ("POST", "/queues/a/enqueue", '{"string": "hi"}'),
        ("POST", "/queues/a/enqueue?string=a%20b&deadline=1970-01-01T00:00:01Z", None),
        ("POST", "/queues/a/enqueue", "{}"),
        ("POST", "/queues/a/enqueue", "[1"),
        ("POST", "/queues/a%2Fb/dequeue", '{"timeout": "2m", "count": 7}'),
        ("POST", "/queues/a/dequeue", None),
        ("POST", "/queues/a/dequeue?timeout=x", None),
        ("POST", "/queues/a/dequeue", '{"count": 0}'),
        ("POST", "/queues/a/requeue", '{"id": {"any": true}, "deadline": "+1h"}'),
        ("POST", "/queues/a/requeue", '{"id": {"id": 9}}'),
        ("POST", "/queues/a/release", '{"id": 4}'),
        ("POST", "/queues/a/release?any", None),
        ("POST", "/queues/a/release", '{"any": false}'),
        ("GET", "/queues/a/peek", None),
        ("GET", "/queues/a", None),
        ("DELETE", "/queues/a", None),
        ("GET", "/queues/a/poke", None),
        ("POST", "/queues/a/compact", None),
        ("PUT", "/queues/a", None),
        ("GET", "/", None),
    ]
    table = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "seq int, method string, path string, body string")
    got = [(r.op, r.queue, r.value, r.deadline_kind, r.deadline_arg_ms, r.id, r.id_any, r["count"], r.timeout_ms, r.error) for r in commands.parse_http(table).orderBy("seq").collect()]
    assert got[:3] == [
        ("ENQUEUE", "a", "hi", "relative", 5000, None, False, None, None, None),
        ("ENQUEUE", "a", "hi", "now", None, None, False, None, None, None),
        ("ENQUEUE", "a", "a b", "absolute", 1000, None, False, None, None, None),
    ]
    assert [g[-1] for g in got[3:5]] == ["missing value", "invalid body"]
    assert got[5][1] == "a/b" and got[5][7:] == (7, 120_000, None) and got[6][7:] == (1, 0, None)
    assert [g[-1] for g in got[7:9]] == ["invalid timeout", "invalid count"]
    assert got[9][3:7] == ("relative", 3_600_000, None, True) and got[10][-1] == "missing deadline"
    assert got[11][5:7] == (4, False) and got[12][5:7] == (None, True) and got[13][-1] == "invalid id"
    assert [g[0] for g in got[14:19]] == ["PEEK", "INFO", "DELETE", "POKE", "COMPACT"] and [g[-1] for g in got[14:]] == [None] * 5 + ["not found"] * 2


def test_log_flushes_and_recovery(spark, tmp_path):
    store, log = SegmentStore(spark, str(tmp_path)), tables.log(spark, SF)
    key = lambda df: sorted((r.queue, r.kind, r.id, r.deadline_ms) for r in df.collect())
    parts = [log.where(f"id % 4 = {k}") for k in range(4)]
    write = store.sink(flush_bytes=1 << 40)
    for k in (0, 1, 1):
        write(parts[k], k)
    assert key(store.entries()) == key(parts[0].union(parts[1])) and store.manifest().count() == 0
    store.sink(flush_bytes=0)(parts[2], 2)
    assert store.manifest().count() == 1 and store._waiting() == {} and store._last() == (0, 2)
    write(parts[2], 2)
    assert store._waiting() == {}
    write(parts[3], 3)
    parts[0].write.parquet(f"{tmp_path}/generation=7")
    parts[0].write.parquet(f"{tmp_path}/log/batch=1")
    assert key(SegmentStore(spark, str(tmp_path)).entries()) == key(log)
    assert SegmentStore(spark, str(tmp_path)).recover() == ["generation=7", "log/batch=1"]
    assert key(store.entries()) == key(log) and store.flush_log() and not store.flush_log()
    store.compact()
    assert key(store.entries()) == key(op.unpaired(log)) and store._last() == (2, 3)


def test_store_as_a_stream_sink(spark, tmp_path):
    log, store = tables.log(spark, SF), SegmentStore(spark, f"{tmp_path}/store")
    log.repartition(3, "id").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = stream.writeStream.foreachBatch(store.sink(flush_bytes=5_000)).option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    assert store.manifest().count() >= 1 and store.entries().count() == log.count()


def test_ids_ascend_over_restarts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ids, "RESERVED", 100)
    monkeypatch.setattr(ids, "LEAST_LEFT", 50)
    source = ids.IdSource(spark, str(tmp_path))
    assert source.take(0) == range(1, 1) and not (tmp_path / "id-ceiling").exists()
    assert source.take(3) == range(1, 4) and source.ceiling == 104 and source.take(10) == range(4, 14) and source.ceiling == 104
    assert source.take(60) == range(14, 74) and source.ceiling == 174
    again = ids.IdSource(spark, str(tmp_path))
    assert again.take(2) == range(174, 176) and again.ceiling == 276
