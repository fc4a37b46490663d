"""The named queries over the driver's tables, each with DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import binary, text
from tidemark.operators import entries as op
from tidemark.operators import segments
from tidemark.sources import commands, tables
from tidemark.sources.tables import ITEMS_SQL, LIVE_SQL, LOG_SQL, NOW_MS
from tidemark.streaming import replay

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

ENTRY = "queue, kind, id, deadline_ms, enqueue_ms, requeue_ms, dequeue_count, value, segment_id"
ITEM = "queue, id, deadline_ms, enqueue_ms, requeue_ms, dequeue_count, value"
RANGE = 4


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def named(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return named


def _live(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.live(tables.log(spark, sf_dir)).select("queue", *op.ITEM)


@query(f"WITH {LIVE_SQL} SELECT {ITEM} FROM live WHERE deadline_ms <= {NOW_MS} ORDER BY deadline_ms, id LIMIT 100")
def ready_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 100 ready items of all queues."""
    return op.first_of_all(op.ready(_live(spark, sf_dir), NOW_MS), 100).select("queue", *op.ITEM)


@query(
    f"""WITH {LIVE_SQL}, ranked AS (
      SELECT {ITEM}, row_number() OVER (PARTITION BY queue ORDER BY deadline_ms, id) AS rank FROM live WHERE deadline_ms <= {NOW_MS}
    ) SELECT * FROM ranked WHERE rank <= 3"""
)
def ready_topk_per_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each queue's first three ready items."""
    return op.first_of_each(op.ready(_live(spark, sf_dir), NOW_MS), 3).withColumn("rank", F.col("rank").cast("long"))


@query(f"WITH {LIVE_SQL} SELECT DISTINCT ON (queue) {ITEM} FROM live ORDER BY queue, deadline_ms, id")
def peek_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each queue's first item, due or not."""
    return op.heads(_live(spark, sf_dir)).select("queue", *op.ITEM)


def _working(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a dequeue of three has taken from each queue."""
    return op.first_of_each(op.ready(_live(spark, sf_dir), NOW_MS), 3).drop("rank")


@query(
    f"""WITH {LIVE_SQL}, working AS (SELECT queue, least(count(*), 3) AS dequeued FROM live WHERE deadline_ms <= {NOW_MS} GROUP BY queue),
    net AS (SELECT queue, count(*) FILTER (kind = 'pending') - count(*) FILTER (kind = 'tombstone') AS net, coalesce(sum(strlen(value)), 0) AS value_bytes FROM log GROUP BY queue)
    SELECT queue, net - coalesce(dequeued, 0) AS pending, coalesce(dequeued, 0) AS dequeued, CAST(value_bytes AS BIGINT) AS value_bytes FROM net LEFT JOIN working USING (queue)"""
)
def queue_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pending and dequeued items of each queue."""
    return op.info(tables.log(spark, sf_dir), _working(spark, sf_dir))


@query(f"WITH {LOG_SQL} SELECT DISTINCT queue FROM log")
def queue_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names of all queues."""
    return op.queues(tables.log(spark, sf_dir))


@query(f"WITH {ITEMS_SQL} SELECT {ENTRY} FROM first")
def enqueue_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pending entries that enqueueing all events writes."""
    return tables.pending(tables.items(spark, sf_dir))


@query(f"WITH {LIVE_SQL} SELECT {ITEM} FROM live")
def live_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All items that no tombstone cancels."""
    return _live(spark, sf_dir)


@query(
    f"""WITH {LOG_SQL}, part AS (SELECT * FROM log WHERE kind = 'tombstone' OR id NOT IN (SELECT id FROM first WHERE event_type = 'error'))
    SELECT {ENTRY} FROM part a WHERE NOT EXISTS (
      SELECT 1 FROM part b WHERE b.kind <> a.kind AND b.queue = a.queue AND b.deadline_ms = a.deadline_ms AND b.id = a.id)"""
)
def unpaired_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A merge without the segments that hold the errors' pending entries, so that their tombstones stay."""
    enqueued = tables.items(spark, sf_dir)
    errors = tables.pending(enqueued.where("event_type = 'error'"))
    released = op.release(tables.pending(enqueued.where("event_type = 'purchase'")))
    requeued = op.requeue(errors, F.col("id") + tables.REQUEUE_ID, F.col("deadline_ms") + tables.REQUEUE_DELAY_MS, F.col("deadline_ms"))
    return op.unpaired(op.merge(tables.pending(enqueued.where("event_type <> 'error'")), released, requeued))


@query(f"WITH {LOG_SQL} SELECT {ENTRY} FROM log")
def kway_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All segments, in four groups, merged in key order."""
    log = tables.log(spark, sf_dir)
    return op.in_order(op.merge(*(log.where(F.col("segment_id") % 4 == k) for k in range(4))))


@query(f"WITH {LIVE_SQL} SELECT {ITEM} FROM live WHERE deadline_ms > {NOW_MS}")
def future_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items whose deadline hasn't passed."""
    return op.future(_live(spark, sf_dir), NOW_MS)


@query(
    f"""WITH {LOG_SQL} SELECT {ENTRY} FROM log
    WHERE (deadline_ms, id, CASE kind WHEN 'tombstone' THEN 0 ELSE 1 END) > ({NOW_MS}, 4000, 0)"""
)
def seek_after_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries after a key."""
    return op.after(tables.log(spark, sf_dir), NOW_MS, 4000, tables.TOMBSTONE)


@query(f"WITH {LOG_SQL} SELECT {ENTRY} FROM log WHERE id >= {tables.REQUEUE_ID} OR (kind = 'tombstone' AND id IN (SELECT id FROM first WHERE event_type = 'error'))")
def requeue_rekey(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What requeueing the errors writes."""
    working = tables.pending(tables.items(spark, sf_dir).where("event_type = 'error'"))
    return op.requeue(working, F.col("id") + tables.REQUEUE_ID, F.col("deadline_ms") + tables.REQUEUE_DELAY_MS, F.col("deadline_ms"))


@query(f"WITH {ITEMS_SQL} SELECT {ENTRY} FROM first WHERE event_type <> 'purchase'")
def release_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items that are left when the purchases are released."""
    enqueued = tables.items(spark, sf_dir)
    released = op.release(tables.pending(enqueued.where("event_type = 'purchase'")))
    return op.live(op.merge(tables.pending(enqueued), released)).select(*tables.ENTRY_COLUMNS)


@query(
    f"""WITH {LOG_SQL}, deleted AS (SELECT queue, max(id) AS last FROM items WHERE event_type = 'signup' GROUP BY queue)
    SELECT {ENTRY} FROM log LEFT JOIN deleted USING (queue) WHERE last IS NULL OR id > last"""
)
def queue_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log after each queue was deleted at its last signup."""
    deletes = tables.items(spark, sf_dir).where("event_type = 'signup'").select("queue", "id")
    return op.undeleted(tables.log(spark, sf_dir), deletes)


@query(
    """SELECT event_id AS id, epoch_us(ts) // 1000 AS now_ms, CASE event_id % 3 WHEN 0 THEN 'now' WHEN 1 THEN 'relative' ELSE 'absolute' END AS deadline_kind,
    CASE event_id % 3 WHEN 0 THEN epoch_us(ts) // 1000 WHEN 1 THEN epoch_us(ts) // 1000 + user_id * 1000 ELSE user_id * 1000 END AS deadline_ms FROM events"""
)
def deadline_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deadlines asked for as now, relative and absolute."""
    events = tables.read(spark, sf_dir, "events")
    kind = F.when(F.col("event_id") % 3 == 0, "now").when(F.col("event_id") % 3 == 1, "relative").otherwise("absolute")
    rows = events.select(F.col("event_id").alias("id"), tables.millis(F.col("ts")).alias("now_ms"), kind.alias("deadline_kind"), "user_id")
    return rows.select("id", "now_ms", "deadline_kind", op.resolve(F.col("deadline_kind"), F.col("user_id") * 1000, F.col("now_ms")).alias("deadline_ms"))


@query(
    f"""WITH {ITEMS_SQL} SELECT queue, id, greatest(deadline_ms, {NOW_MS}) + CASE WHEN deadline_ms <= {NOW_MS} AND id < 5000 THEN 1 ELSE 0 END AS deadline_ms FROM items"""
)
def deadline_clamp_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deadlines clamped to a last dequeued key."""
    rows = tables.items(spark, sf_dir)
    return rows.select("queue", "id", op.clamp(F.col("deadline_ms"), F.col("id"), F.lit(NOW_MS), F.lit(5000)).alias("deadline_ms"))


@query(
    f"""WITH {ITEMS_SQL} SELECT queue, id, deadline_ms, (row_number() OVER (PARTITION BY queue ORDER BY deadline_ms, id) - 1) // 7 AS dequeue FROM items"""
)
def drain_fifo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dequeue of seven that hands out each item when all queues are emptied."""
    return op.drained(tables.items(spark, sf_dir), 7).select("queue", "id", "deadline_ms", "dequeue")


DRAIN_SQL = f"""WITH {ITEMS_SQL}, placed AS (SELECT queue, id, deadline_ms, row_number() OVER (PARTITION BY queue ORDER BY deadline_ms, id) AS place FROM items)
SELECT queue, {1 << 40} + 1 + (place - 1) // 7 AS seq, (place - 1) % 7 AS item, id, deadline_ms, CAST(1 AS BIGINT) AS dequeue_count FROM placed"""


@query(DRAIN_SQL)
def replay_drain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by replaying an operation log through the state machine."""
    ops = replay.enqueue_then_drain(tables.items(spark, sf_dir), 7, 1_900_000_000_000)
    got = replay.replay(ops).where("size(items) > 0").select("queue", "seq", F.posexplode("items").alias("item", "i"))
    return got.select("queue", "seq", F.col("item").cast("long").alias("item"), "i.id", "i.deadline_ms", F.col("i.dequeue_count").cast("long").alias("dequeue_count"))


def _ops(rows: DataFrame, **columns: Column) -> DataFrame:
    """rows as operations; columns that aren't given are null."""
    return rows.select(*(columns.get(c, F.lit(None)).cast(t).alias(c) for c, t in (x.split() for x in replay.OPS.split(", "))))


@query(
    """WITH t AS (SELECT CAST(user_id AS VARCHAR) AS queue, event_id AS seq, event_type, min(event_id) FILTER (event_type = 'click') OVER (PARTITION BY user_id) AS first FROM events)
    SELECT queue, seq, CASE WHEN seq >= first THEN 'OK' ELSE 'NoSuchQueue' END AS status FROM t"""
)
def replay_existence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks enqueue and all other events peek: a queue exists from its first enqueue on."""
    op_name = F.when(F.col("event_type") == "click", "enqueue").otherwise("peek")
    ops = _ops(tables.items(spark, sf_dir), seq=F.col("id"), batch_id=F.col("id"), now_ms=F.col("enqueue_ms"), queue=F.col("queue"), op=op_name, value=F.col("value"))
    return replay.replay(ops).select("queue", "seq", "status")


@query("""SELECT CAST(user_id AS VARCHAR) AS queue, count(*) - least(count(*), 5) + 1 AS pending, least(count(*), 5) - 3 AS dequeued FROM events GROUP BY user_id HAVING count(*) >= 3""")
def replay_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All items enqueued, five taken, two released, one requeued; then what info says."""
    enqueued = tables.items(spark, sf_dir)
    later, after = 1_900_000_000_000, 1 << 40
    first = _ops(enqueued, seq=F.col("id"), batch_id=F.col("id"), now_ms=F.col("enqueue_ms"), queue=F.col("queue"), op=F.lit("enqueue"), value=F.col("value"))
    acts = F.explode(F.array(*(F.struct(F.lit(after + i).alias("seq"), F.lit(name).alias("op")) for i, name in enumerate(("dequeue", "release", "release", "requeue", "info"))))).alias("act")
    full = enqueued.groupBy("queue").count().where("count >= 3").select("queue", acts)
    then = _ops(full, seq=F.col("act.seq"), batch_id=F.col("act.seq"), now_ms=F.lit(later), queue=F.col("queue"), op=F.col("act.op"), id_any=F.lit(True), count=F.lit(5))
    return replay.replay(first.unionByName(then)).where(f"seq = {after + 4}").select("queue", "pending", "dequeued")


@query(
    f"""WITH {ITEMS_SQL}, firsts AS (SELECT queue, min(id) AS id, arg_min(deadline_ms - enqueue_ms, id) AS wait FROM items GROUP BY queue)
    SELECT queue, CASE WHEN wait <= 100000 THEN 'OK' ELSE 'NoItemReady' END AS status, CASE WHEN wait <= 100000 THEN id END AS id FROM firsts"""
)
def replay_blocking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dequeue that waits up to 100 seconds for each queue's first item."""
    firsts = tables.items(spark, sf_dir).groupBy("queue").agg(F.min_by(F.struct("id", "enqueue_ms", "deadline_ms"), "id").alias("i")).select("queue", "i.*")
    shared = {"now_ms": F.col("enqueue_ms"), "queue": F.col("queue")}
    put = _ops(firsts, seq=F.lit(0), batch_id=F.lit(0), op=F.lit("enqueue"), id=F.col("id"), deadline_kind=F.lit("absolute"), deadline_arg_ms=F.col("deadline_ms"), **shared)
    wait = _ops(firsts, seq=F.lit(1), batch_id=F.lit(1), op=F.lit("dequeue"), timeout_ms=F.lit(100_000), **shared)
    got = replay.replay(put.unionByName(wait)).where("seq = 1")
    return got.select("queue", "status", F.get("items", F.lit(0))["id"].alias("id"))


@query(
    """WITH t AS (SELECT event_id AS id, CAST(user_id AS VARCHAR) AS queue, epoch_us(ts) // 1000 AS ms, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events)
    SELECT queue, 4 * id AS seq, 'OK' AS status, id, ms AS deadline_ms, NULL AS item, CAST(NULL AS BIGINT) AS pending, CAST(NULL AS BIGINT) AS dequeued FROM t
    UNION ALL SELECT queue, 4 * id + 1, 'OK', NULL, NULL, id, NULL, NULL FROM t
    UNION ALL SELECT queue, 4 * id + 2, 'OK', NULL, NULL, NULL, 0, r - 1 FROM t WHERE r > 1"""
)
def replay_waiters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch of as many dequeues as a queue has items, which wait; each later item goes to the oldest of them.

    Every batch of an item also asks for info, which sees the state before the batch.
    """
    events = tables.items(spark, sf_dir).select("queue", "id", "enqueue_ms")
    first = events.groupBy("queue").agg(F.min("id").alias("first_id"), F.min("enqueue_ms").alias("first_ms"))
    joined = events.join(first, "queue")
    put = _ops(events, seq=4 * F.col("id"), batch_id=2 * F.col("id"), now_ms=F.col("enqueue_ms"), queue=F.col("queue"), op=F.lit("enqueue"), id=F.col("id"))
    wait = _ops(joined, seq=4 * F.col("id") + 1, batch_id=2 * F.col("first_id") + 1, now_ms=F.col("first_ms"), queue=F.col("queue"), op=F.lit("dequeue"), timeout_ms=F.lit(1 << 40))
    look = _ops(joined.where("id > first_id"), seq=4 * F.col("id") + 2, batch_id=2 * F.col("id"), now_ms=F.col("enqueue_ms"), queue=F.col("queue"), op=F.lit("info"))
    got = replay.replay(put.unionByName(wait).unionByName(look))
    return got.select("queue", "seq", "status", "id", "deadline_ms", F.get("items", F.lit(0))["id"].alias("item"), "pending", "dequeued")


@query(
    f"""WITH {LIVE_SQL}, asks AS (SELECT event_id AS seq, CAST(user_id AS VARCHAR) AS queue, event_id % 4 + 1 AS asked FROM events WHERE event_type = 'click'),
    spans AS (SELECT seq, queue, asked, coalesce(sum(asked) OVER (PARTITION BY queue ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS taken FROM asks),
    ranked AS (SELECT {ITEM}, row_number() OVER (PARTITION BY queue ORDER BY deadline_ms, id) AS rank FROM live WHERE deadline_ms <= {NOW_MS})
    SELECT seq, {ITEM}, rank FROM ranked JOIN spans USING (queue) WHERE rank > taken AND rank <= taken + asked"""
)
def dequeue_deal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ready items dealt out to the dequeues of one batch."""
    asks = tables.read(spark, sf_dir, "events").where("event_type = 'click'")
    asks = asks.select(F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("queue"), (F.col("event_id") % 4 + 1).alias("count"))
    return op.deal(op.ready(_live(spark, sf_dir), NOW_MS), asks).withColumn("rank", F.col("rank").cast("long"))


@query(
    f"""WITH {LIVE_SQL}, working AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY queue ORDER BY deadline_ms, id) AS rank FROM live WHERE deadline_ms <= {NOW_MS}) WHERE rank <= 3)
    SELECT e.event_id AS seq, CAST(e.user_id AS VARCHAR) AS queue, e.event_id AS id, w.deadline_ms, w.enqueue_ms, w.requeue_ms, w.dequeue_count, w.value,
    CASE WHEN w.id IS NULL THEN 'ItemNotDequeued' ELSE 'OK' END AS status
    FROM events e LEFT JOIN working w ON w.queue = CAST(e.user_id AS VARCHAR) AND w.id = e.event_id"""
)
def working_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Working items by id, and a status for each request."""
    events = tables.read(spark, sf_dir, "events")
    requests = events.select(F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("queue"), F.col("event_id").alias("id"))
    return op.lookup(_working(spark, sf_dir), requests)


@query(
    f"""WITH ranked AS (SELECT o_orderpriority AS queue, o_orderkey AS id, epoch_us(o_orderdate) // 1000 AS deadline_ms,
      row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) AS rank FROM orders)
    SELECT * FROM ranked WHERE rank <= 20"""
)
def orders_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 20 orders of each priority."""
    due = op.first_of_each(tables.order_items(spark, sf_dir), 20)
    return due.select("queue", "id", "deadline_ms", F.col("rank").cast("long").alias("rank"))


META_SQL = f"""{LOG_SQL}, meta AS (
  SELECT segment_id, count(*) FILTER (kind = 'pending') AS pending_count, count(*) FILTER (kind = 'tombstone') AS tombstone_count FROM log GROUP BY segment_id
), ranges AS (
  SELECT segment_id // {RANGE} AS number, min(segment_id) AS "start", max(segment_id) AS "end", count(*) FILTER (tombstone_count > 0) + 1 AS files,
         CAST(sum(pending_count) AS BIGINT) AS pending_count, CAST(sum(tombstone_count) AS BIGINT) AS tombstone_count
  FROM meta GROUP BY 1
)"""


def _ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.ranges(tables.log(spark, sf_dir), RANGE)


@query(f"WITH {META_SQL} SELECT * FROM meta")
def segment_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pending and tombstone counts of each segment."""
    return segments.metadata(tables.log(spark, sf_dir))


@query(f"WITH {META_SQL} SELECT *, (pending_count - tombstone_count) / pending_count AS occupancy FROM ranges")
def range_occupancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges of segments and the share of their items that live."""
    return segments.occupancy(_ranges(spark, sf_dir))


@query(
    """WITH meta AS (SELECT event_id // 5 AS segment_id, count(*) AS pending_count, count(*) FILTER (event_type <> 'view') AS tombstone_count FROM events GROUP BY 1)
    SELECT segment_id, pending_count, tombstone_count FROM meta WHERE pending_count = tombstone_count"""
)
def exhausted_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges of five ids whose items are all cancelled when all but the views are."""
    events = tables.read(spark, sf_dir, "events").withColumn("segment_id", F.expr("event_id div 5"))
    gone = events.where("event_type <> 'view'")
    log = events.select("segment_id", F.lit(tables.PENDING).alias("kind")).unionByName(gone.select("segment_id", F.lit(tables.TOMBSTONE).alias("kind")))
    return segments.exhausted(segments.metadata(log))


@query(f"""WITH {META_SQL} SELECT queue, id, deadline_ms, segment_id, "start", "end" FROM log JOIN ranges ON segment_id BETWEEN "start" AND "end" WHERE kind = 'tombstone'""")
def tombstone_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The range of each tombstone."""
    return segments.routed(tables.log(spark, sf_dir), _ranges(spark, sf_dir))


CHOICE_SQL = f"""{META_SQL}, whole AS (SELECT sum(files) AS f, sum(pending_count) AS p, sum(tombstone_count) AS t FROM ranges),
runs AS (
  SELECT a."start" AS first, b."end" AS last,
         (SELECT sum(files) FROM ranges r WHERE r."start" BETWEEN a."start" AND b."start") AS rf,
         (SELECT sum(pending_count) FROM ranges r WHERE r."start" BETWEEN a."start" AND b."start") AS rp,
         (SELECT sum(tombstone_count) FROM ranges r WHERE r."start" BETWEEN a."start" AND b."start") AS rt
  FROM ranges a JOIN ranges b ON a."start" <= b."start"
), scored AS (
  SELECT first, last, f - rf + 1 AS net_files, rp - rt AS written, sqrt(pow((f - rf + 1) / f, 2) + pow((p - rt) / p, 2) + pow((rp - rt) / p, 2)) AS norm,
         ((p - t) / p < {segments.LEAST_OCCUPANCY} OR f > 6) AND f - rf + 1 <= 6 AND ((p - rt) - (t - rt)) / (p - rt) >= {segments.LEAST_OCCUPANCY} AS ok
  FROM runs, whole
)"""


@query(f"WITH {CHOICE_SQL} SELECT first, last, CAST(net_files AS BIGINT) AS net_files, CAST(written AS BIGINT) AS written, round(norm, 9) AS norm FROM scored WHERE ok ORDER BY scored.norm, first, last LIMIT 1")
def compaction_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best run of ranges to compact when at most six files may stay."""
    return segments.compaction(_ranges(spark, sf_dir), most_files=6, least_occupancy=segments.LEAST_OCCUPANCY)


@query(
    f"""WITH {LOG_SQL}, inside AS (SELECT * FROM log WHERE segment_id BETWEEN 0 AND 3)
    SELECT queue, kind, id, deadline_ms, enqueue_ms, requeue_ms, dequeue_count, value, CAST(0 AS BIGINT) AS segment_id FROM inside a WHERE NOT EXISTS (
      SELECT 1 FROM inside b WHERE b.kind <> a.kind AND b.queue = a.queue AND b.deadline_ms = a.deadline_ms AND b.id = a.id)
    UNION ALL SELECT {ENTRY} FROM log WHERE segment_id NOT BETWEEN 0 AND 3"""
)
def compact_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log after its first four segments were compacted."""
    return segments.compacted(tables.log(spark, sf_dir), 0, 3)


@query(
    """WITH t AS (SELECT event_id AS id, user_id || CASE event_id % 5 WHEN 0 THEN 'ms' WHEN 1 THEN 's' WHEN 2 THEN 'm' WHEN 3 THEN 'h' ELSE 'd' END AS text, event_id % 5 AS u, user_id FROM events)
    SELECT id, text, CASE u WHEN 0 THEN user_id WHEN 1 THEN user_id * 1000 WHEN 2 THEN user_id * 60000 WHEN 3 THEN user_id * 3600000 END AS ms FROM t"""
)
def duration_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Durations in four units, and one that is none."""
    events = tables.read(spark, sf_dir, "events")
    unit = F.element_at(F.array(*map(F.lit, ("ms", "s", "m", "h", "d"))), (F.col("event_id") % 5 + 1).cast("int"))
    rows = events.select(F.col("event_id").alias("id"), F.concat(F.col("user_id").cast("string"), unit).alias("text"))
    return rows.withColumn("ms", text.duration_ms(F.col("text")))


@query("SELECT event_id AS id, strftime(make_timestamp(epoch_us(ts) // 1000 * 1000), '%Y-%m-%dT%H:%M:%S.%gZ') AS text, epoch_us(ts) // 1000 AS ms FROM events")
def rfc3339_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times as RFC 3339 text, and read back."""
    rows = tables.read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), text.rfc3339(tables.millis(F.col("ts"))).alias("text"))
    return rows.withColumn("ms", text.rfc3339_ms(F.col("text")))


@query("SELECT event_id AS id, base64(encode(props)) AS encoded, props AS value FROM events")
def base64_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values as base64, and read back."""
    rows = tables.read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.base64(F.col("props").cast("binary")).alias("encoded"))
    return rows.withColumn("value", F.unbase64("encoded").cast("string"))


@query(
    """WITH t AS (SELECT event_id, epoch_us(ts) // 1000 AS now_ms, user_id, ts FROM events)
    SELECT event_id AS id, now_ms, CASE event_id % 4 WHEN 0 THEN now_ms WHEN 1 THEN now_ms + user_id * 1000 WHEN 2 THEN user_id * 1000 ELSE now_ms END AS deadline_ms FROM t"""
)
def deadline_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deadlines of request texts: none, a duration, digits, a date."""
    events = tables.read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), tables.millis(F.col("ts")).alias("now_ms"), "user_id")
    user = F.col("user_id").cast("string")
    kind = F.col("id") % 4
    asked = F.when(kind == 1, F.concat(F.lit("+"), user, F.lit("s"))).when(kind == 2, F.concat(user, F.lit("000"))).when(kind == 3, text.rfc3339(F.col("now_ms")))
    return events.select("id", "now_ms", text.deadline(asked, F.col("now_ms")).alias("deadline_ms"))


@query(
    """SELECT event_id AS id, TRY_CAST(event_id % 100 AS BIGINT) * CASE event_id % 8 WHEN 0 THEN 1 WHEN 1 THEN 1000 WHEN 2 THEN 1048576 WHEN 3 THEN 1000000000 WHEN 4 THEN 1125899906842624 WHEN 5 THEN 1000000000000 WHEN 6 THEN 1000000 END AS bytes,
    length(CAST(event_id AS VARCHAR)) + 3 AS integer_bytes, length(CAST(strlen(props) AS VARCHAR)) + strlen(props) + 5 AS bulk_bytes FROM events"""
)
def sizes_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes with units, and the lengths of replies."""
    events = tables.read(spark, sf_dir, "events")
    unit = F.element_at(F.array(*map(F.lit, ("", "KB", "MiB", "B", "PiB", "T", "M", "kb"))), (F.col("event_id") % 8 + 1).cast("int"))
    size = F.concat((F.col("event_id") % 100).cast("string"), unit)
    return events.select(F.col("event_id").alias("id"), text.size_bytes(size).alias("bytes"), text.integer_bytes(F.col("event_id")).alias("integer_bytes"), text.bulk_bytes(F.col("props")).alias("bulk_bytes"))


@query(
    """WITH n AS (SELECT count(*) // 7 AS size, count(*) % 7 AS more FROM events), placed AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS i FROM events)
    SELECT event_id AS id, CASE WHEN i < more * (size + 1) THEN i // (size + 1) ELSE more + (i - more * (size + 1)) // size END AS part, i // 100 AS batch FROM placed, n"""
)
def even_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events in seven even parts and in batches of 100."""
    events = tables.read(spark, sf_dir, "events").select(F.lit("").alias("queue"), F.col("event_id").alias("id"), F.col("event_id").alias("deadline_ms"))
    ranked = op.placed(events, 10_000).withColumn("i", F.col("rank") - 1)
    total = events.groupBy("queue").agg(F.count("*").alias("total"))
    return ranked.join(total, "queue").select("id", text.even_part(F.col("i"), F.col("total"), 7).alias("part"), F.expr("i div 100").alias("batch"))


@query(
    f"""WITH {ITEMS_SQL}, waits AS (SELECT queue, deadline_ms - enqueue_ms AS wait FROM items)
    SELECT queue, count(*) AS n, round(quantile_cont(wait, 0.5), 3) AS p50, round(quantile_cont(wait, 0.9), 3) AS p90, round(quantile_cont(wait, 0.99), 3) AS p99,
    round(quantile_cont(wait, 0.999), 3) AS p999 FROM waits GROUP BY queue"""
)
def dequeue_latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles of the time that items wait."""
    waits = tables.items(spark, sf_dir).withColumn("wait", F.col("deadline_ms") - F.col("enqueue_ms"))
    quantiles = [F.round(F.percentile("wait", F.lit(q)), 3).alias(name) for name, q in (("p50", 0.5), ("p90", 0.9), ("p99", 0.99), ("p999", 0.999))]
    return waits.groupBy("queue").agg(F.count("*").alias("n"), *quantiles)


@query(
    f"""WITH {ITEMS_SQL} SELECT event_type, count(*) AS n, round(count(*) / ((max(enqueue_ms) - min(enqueue_ms)) / 1000.0), 9) AS per_second FROM items GROUP BY event_type"""
)
def throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items enqueued a second."""
    span = (F.max("enqueue_ms") - F.min("enqueue_ms")) / 1000
    return tables.items(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.count("*") / span, 9).alias("per_second"))


@query(
    f"""WITH {ITEMS_SQL} SELECT id, deadline_ms // 1000 AS seconds, CAST(deadline_ms % 1000 * 1000000 AS INTEGER) AS nanos, deadline_ms AS back_ms, deadline_ms - enqueue_ms AS wait_ms FROM items"""
)
def timestamp_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deadlines as seconds and nanoseconds and back, and the time until each."""
    parts = text.seconds_and_nanos(F.col("deadline_ms"))
    found = tables.items(spark, sf_dir).withColumn("parts", parts)
    return found.select("id", "parts.seconds", "parts.nanos", text.millis_of(F.col("parts")).alias("back_ms"), text.elapsed_ms(F.col("deadline_ms"), F.col("enqueue_ms")).alias("wait_ms"))


@query(
    """WITH t AS (SELECT event_id, CAST(user_id AS VARCHAR) AS queue, event_id % 6 AS k FROM events)
    SELECT event_id AS seq, queue, CASE k WHEN 0 THEN 'ENQUEUE' WHEN 1 THEN 'DEQUEUE' WHEN 2 THEN 'RELEASE' WHEN 3 THEN 'REQUEUE' WHEN 4 THEN 'PEEK' ELSE 'DEQUEUE' END AS op,
    CASE k WHEN 0 THEN 'v' || event_id END AS value, CASE k WHEN 0 THEN 'relative' WHEN 3 THEN 'absolute' END AS deadline_kind, CASE WHEN k IN (0, 3) THEN event_id END AS deadline_arg_ms,
    CASE k WHEN 2 THEN event_id END AS id, k = 3 AS id_any, CASE k WHEN 1 THEN event_id % 9 + 1 WHEN 5 THEN 1 END AS count, CASE k WHEN 1 THEN 250 WHEN 5 THEN 0 END AS timeout_ms,
    CASE k WHEN 5 THEN 'invalid count' END AS error FROM t"""
)
def command_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captured commands as operations; one kind is invalid."""
    events = tables.read(spark, sf_dir, "events")
    i, queue = F.col("event_id").cast("string"), F.col("user_id").cast("string")
    k = F.col("event_id") % 6
    line = (
        F.when(k == 0, F.concat(F.lit("enqueue "), queue, F.lit(" v"), i, F.lit(" DELAY "), i))
        .when(k == 1, F.concat(F.lit("DEQUEUE "), queue, F.lit(" TIMEOUT 250 COUNT "), (F.col("event_id") % 9 + 1).cast("string")))
        .when(k == 2, F.concat(F.lit("Release "), queue, F.lit(" "), i))
        .when(k == 3, F.concat(F.lit("REQUEUE "), queue, F.lit(" any deadline "), i))
        .when(k == 4, F.concat(F.lit("PEEK "), queue))
        .otherwise(F.concat(F.lit("DEQUEUE "), queue, F.lit(" COUNT 0")))
    )
    parsed = commands.parse_commands(events.select(F.col("event_id").alias("seq"), line.alias("command")))
    return parsed.drop("command").withColumn("count", F.when(F.col("error").isNotNull(), 1).otherwise(F.col("count")).cast("long"))


@query(
    """SELECT event_id AS seq, props AS value, CASE event_id % 3 WHEN 0 THEN 'relative' WHEN 1 THEN 'absolute' ELSE 'now' END AS deadline_kind,
    CASE event_id % 3 WHEN 0 THEN user_id * 60000 WHEN 1 THEN epoch_us(ts) // 1000 END AS deadline_arg_ms FROM events"""
)
def json_request_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON enqueue bodies as operations."""
    events = tables.read(spark, sf_dir, "events")
    k = F.col("event_id") % 3
    due = F.when(k == 0, F.concat(F.lit("+"), F.col("user_id").cast("string"), F.lit("m"))).when(k == 1, text.rfc3339(tables.millis(F.col("ts"))))
    fields = F.struct(F.when(k != 2, F.col("props")).alias("string"), F.when(k == 2, F.base64(F.col("props").cast("binary"))).alias("value"), due.alias("deadline"))
    bodies = events.select(F.col("event_id").alias("seq"), F.to_json(fields).alias("body"))
    return commands.parse_json_enqueue(bodies)


@query(
    """WITH t AS (SELECT event_id, user_id, props, event_id % 10 AS k FROM events)
    SELECT event_id AS seq, CASE k WHEN 0 THEN 'ENQUEUE' WHEN 1 THEN 'DEQUEUE' WHEN 2 THEN 'REQUEUE' WHEN 3 THEN 'RELEASE' WHEN 4 THEN 'PEEK' WHEN 5 THEN 'INFO' WHEN 6 THEN 'DELETE'
    WHEN 7 THEN 'REQUEUE' WHEN 8 THEN 'DEQUEUE' END AS op, CAST(user_id AS VARCHAR) AS queue, CASE k WHEN 0 THEN props END AS value,
    CASE k WHEN 0 THEN 'relative' WHEN 2 THEN 'absolute' WHEN 7 THEN 'relative' END AS deadline_kind,
    CASE k WHEN 0 THEN event_id * 1000 WHEN 2 THEN event_id WHEN 7 THEN user_id * 60000 END AS deadline_arg_ms,
    CASE k WHEN 2 THEN event_id WHEN 3 THEN event_id END AS id, k = 7 AS id_any, CASE k WHEN 1 THEN event_id % 7 + 1 WHEN 8 THEN 3 END AS count,
    CASE k WHEN 1 THEN 0 WHEN 8 THEN event_id * 1000 END AS timeout_ms, CASE WHEN k = 9 THEN 'not found' END AS error FROM t"""
)
def http_request_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HTTP requests with JSON bodies and with query strings as operations; one kind has no route."""
    events = tables.read(spark, sf_dir, "events")
    i, k = F.col("event_id").cast("string"), F.col("event_id") % 10
    at = F.concat(F.lit("/queues/"), F.col("user_id").cast("string"))
    rest = F.element_at(F.array(*map(F.lit, ("/enqueue", "/dequeue", "/requeue", "/release", "/peek", "", "", "/requeue?any=true&deadline=%2B", "/dequeue?count=3&timeout=", "/nothing"))), (k + 1).cast("int"))
    more = F.when(k == 7, F.concat(F.col("user_id").cast("string"), F.lit("m"))).when(k == 8, F.concat(i, F.lit("s"))).otherwise("")
    method = F.when(k.isin(4, 5), "GET").when(k == 6, "DELETE").otherwise("POST")
    body = (
        F.when(k == 0, F.to_json(F.struct(F.base64(F.col("props").cast("binary")).alias("value"), F.concat(F.lit("+"), i, F.lit("s")).alias("deadline"))))
        .when(k == 1, F.to_json(F.struct((F.col("event_id") % 7 + 1).alias("count"))))
        .when(k == 2, F.to_json(F.struct(F.struct(F.col("event_id").alias("id")).alias("id"), F.col("event_id").alias("deadline"))))
        .when(k == 3, F.to_json(F.struct(F.col("event_id").alias("id"))))
    )
    parsed = commands.parse_http(events.select(F.col("event_id").alias("seq"), method.alias("method"), F.concat(at, rest, more).alias("path"), body.alias("body")))
    return parsed.drop("method", "path", "body")


@query(
    """SELECT event_id AS seq, CASE event_id % 3 WHEN 0 THEN 'OK' WHEN 1 THEN 'NoSuchQueue' ELSE 'ItemNotDequeued' END AS status,
    CASE event_id % 3 WHEN 0 THEN 200 WHEN 1 THEN 404 ELSE 409 END AS http, CASE event_id % 3 WHEN 0 THEN 'OK' WHEN 1 THEN 'NOT_FOUND' ELSE 'FAILED_PRECONDITION' END AS grpc,
    CASE event_id % 3 WHEN 0 THEN '+OK' WHEN 1 THEN '-ERR no such queue' ELSE '-ERR item not dequeued' END AS resp FROM events"""
)
def response_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The front ends' codes of responses."""
    k = F.col("event_id") % 3
    status = F.when(k == 0, "OK").when(k == 1, "NoSuchQueue").otherwise("ItemNotDequeued")
    return commands.replies(tables.read(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), status.alias("status")))


@query("SELECT event_id AS id, epoch_us(ts) // 1000 AS deadline_ms, event_type = 'error' AS tombstone, CAST(16 AS BIGINT) AS size FROM events")
def key_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys packed into 16 bytes, and unpacked."""
    events = tables.read(spark, sf_dir, "events")
    packed = events.select(binary.packed_key(tables.millis(F.col("ts")), F.col("event_id"), F.col("event_type") == "error").alias("key"))
    return packed.select(binary.unpacked_key(F.col("key")).alias("k"), F.octet_length("key").cast("long").alias("size")).select("k.id", "k.deadline_ms", "k.tombstone", "size")


@query(
    """WITH hexed AS (SELECT event_id, strlen(props) AS n, hex(encode(props)) AS x FROM events),
    listed AS (SELECT event_id, n, list_transform(range(n), lambda i: CAST(16 * (instr('0123456789ABCDEF', x[2 * i + 1]) - 1) + instr('0123456789ABCDEF', x[2 * i + 2]) - 1 AS UBIGINT)) AS b FROM hexed),
    words AS (
      SELECT event_id, n, b, list_transform(range(n // 4), lambda j: b[4 * j + 1] + b[4 * j + 2] * 256 + b[4 * j + 3] * 65536 + b[4 * j + 4] * 16777216) AS k,
        CAST(coalesce(list_sum(list_transform(range(n - n % 4, n), lambda i: b[i + 1] * (1 << (8 * (i % 4))))), 0) AS UBIGINT) AS t FROM listed
    ), scaled AS (
      SELECT event_id, n, b, list_transform(k, lambda v: (v * 3432918353) & 4294967295) AS k, (t * 3432918353) & 4294967295 AS t FROM words
    ), turned AS (
      SELECT event_id, n, b, list_transform(k, lambda v: ((((v << 15) | (v >> 17)) & 4294967295) * 461845907) & 4294967295) AS k, ((((t << 15) | (t >> 17)) & 4294967295) * 461845907) & 4294967295 AS t FROM scaled
    ), folded AS (
      SELECT event_id, n, b, xor(xor(list_reduce(list_prepend(CAST(0 AS UBIGINT), k), lambda h, v: ((((xor(h, v) << 13) | (xor(h, v) >> 19)) & 4294967295) * 5 + 3864292196) & 4294967295), t), CAST(n AS UBIGINT)) AS h FROM turned
    ), one AS (SELECT event_id, n, b, (xor(h, h >> 16) * 2246822507) & 4294967295 AS h FROM folded),
    two AS (SELECT event_id, n, b, (xor(h, h >> 13) * 3266489909) & 4294967295 AS h FROM one)
    SELECT event_id AS id, CAST(xor(h, h >> 16) AS BIGINT) AS murmur3,
      CAST((n + coalesce(list_sum(list_transform(range(n), lambda i: (n - i) * b[i + 1])), 0)) % 65521 * 65536 + (1 + coalesce(list_sum(b), 0)) % 65521 AS BIGINT) AS adler32 FROM two"""
)
def checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checksums of values."""
    value = F.col("props").cast("binary")
    return tables.read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), binary.murmur3(value).alias("murmur3"), binary.adler32(value).alias("adler32"))
