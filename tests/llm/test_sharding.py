import zlib
from collections import Counter

import numpy as np

from tests.llm.data import ODD, SF, clashing, docs
from tidemark.llm import sharding


def place(counts, on, shards):
    """Bounded loads key by key: each tries its home, then walks clockwise past full shards."""
    first = on.nodes()
    wanted = np.bincount(on.owners[first], weights=counts, minlength=shards)
    total = int(counts.sum())
    bound = np.full(shards, total // shards)
    bound[np.lexsort((np.arange(shards), -wanted))[: total % shards]] += 1
    load, out, late = Counter(), {}, []
    for segment, n in enumerate(counts):
        for k in range(int(n)):
            home = int(on.owners[first[segment]])
            if load[home] < bound[home]:
                load[home] += 1
                out[segment, k] = home
            else:
                late.append((segment, k))
    for segment, k in late:
        node = int(first[segment])
        while load[int(on.owners[node])] >= bound[int(on.owners[node])]:
            node = (node + 1) % len(on.owners)
        out[segment, k] = int(on.owners[node])
        load[out[segment, k]] += 1
    return out


def segment_of(on, places):
    cells = on.cells()
    shift = np.uint64(64 - on.bits)
    return [cells[int(p >> shift)][1] + sum(n < s for n in cells[int(p >> shift)][2]) for p, s in zip(places, places.view(np.int64).tolist())]


def test_every_virtual_node_owns_the_keys_before_it():
    r = np.random.default_rng(2)
    for shards, nodes, bits in ((24, 128, None), (200, 128, None), (5, 40, 3)):
        on = sharding.ring(shards, nodes, bits)
        assert len(on.places) == shards * nodes and set(on.nodes().tolist()) == set(range(shards * nodes))
        places = np.r_[r.integers(0, 1 << 64, 300, dtype=np.uint64), on.places[:50], on.places[:50] + np.uint64(1), on.places[-1] + np.uint64(1)]
        assert on.nodes()[segment_of(on, places)].tolist() == (np.searchsorted(on.places, places) % len(on.places)).tolist()


def test_segments_match_key_by_key_placement():
    r = np.random.default_rng(3)
    for shards in (1, 3, 7):
        on = sharding.ring(shards, 16, 8)
        counts = r.poisson(3, on.base[-1])
        counts[17] = 400
        rows = sharding.allot(counts, on, shards)
        got = {(segment, k): shard for segment, first, end, shard, _, _ in rows for k in range(first, end)}
        assert got == place(counts, on, shards)
        slots = Counter()
        for _, first, end, shard, base, _ in rows:
            assert base == slots[shard]
            slots[shard] += end - first
        assert max(slots.values()) - min(slots.values()) <= 1


def test_a_further_shard_moves_little():
    places = np.sort(np.random.default_rng(4).integers(0, 1 << 64, 20_000, dtype=np.uint64))

    def shards_of(shards):
        on = sharding.ring(shards)
        segments = np.array(segment_of(on, places))
        placed = {(s, k): shard for s, first, end, shard, _, _ in sharding.allot(np.bincount(segments, minlength=on.base[-1]), on, shards) for k in range(first, end)}
        seen = Counter()
        out = []
        for s in segments.tolist():
            out.append(placed[s, seen[s]])
            seen[s] += 1
        return np.array(out)

    assert (shards_of(24) != shards_of(25)).mean() < 0.2


def test_odd_documents(spark, monkeypatch):
    monkeypatch.setattr(sharding, "COPIES", 4)
    rows = [*ODD, *[(77, "copy")] * 50]
    got = sharding.assign(clashing(docs(spark, rows)), 5).collect()
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == sorted((str(i), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert sharding.assign(docs(spark, []), 5).count() == 0


def test_query_against_the_ring(spark):
    """Sizes, checksums, balance and gapless slots of the whole table; rows at home are where the ring says."""
    table = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    a, b = ({r.doc_id: r for r in sharding.op9_ring_shards(spark, SF).collect()} for _ in range(2))
    assert a == b and sorted(a) == sorted(table)
    assert {i: (r["size"], r.text_crc32) for i, r in a.items()} == {i: (len(t) + 8, zlib.crc32(t)) for i, t in table.items()}
    slots = {}
    for r in a.values():
        slots.setdefault(r.shard, []).append(r.slot)
        assert r.law == "rows" and r.grown_shard is None
    assert len(slots) == 24 and all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    on = sharding.ring(24)
    hashed = spark.createDataFrame([(i, len(t) + 8, zlib.crc32(t)) for i, t in table.items()], "i long, size long, c long").selectExpr("i", "xxhash64(i, size, c) AS p").collect()
    homes = on.owners[np.searchsorted(on.places, np.array([x.p for x in hashed]).view(np.uint64)) % len(on.places)]
    assert {x.i: int(h) for x, h in zip(hashed, homes)} == {i: r.home_shard for i, r in a.items()}
