import random

import numpy as np
import xxhash

from tests.llm.data import ODD, SF, clashing, docs, text
from tidemark.llm import components, simhash


def by_hand(t):
    words = (t or "").translate({i: i + 32 for i in range(65, 91)}).encode().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [b" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if hashes and 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def joined(pairs, nodes):
    parent = {n: n for n in nodes}

    def top(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in pairs:
        a, b = sorted((top(a), top(b)))
        parent[b] = a
    return {n: top(n) for n in nodes}


def test_masks_cover_every_pair_within_the_radius():
    for radius in (1, 2, 3):
        tables = simhash.masks(radius)
        r = random.Random(radius)
        for _ in range(500):
            difference = sum(1 << b for b in r.sample(range(64), radius))
            assert any(m & difference == 0 for m in tables)
    assert len(simhash.masks(2)) == 7 and min(m.bit_count() for m in simhash.masks(2)) >= 36


def test_fingerprints_of_many_hashes():
    r = np.random.default_rng(0)
    groups = [r.integers(0, 1 << 63, n, dtype=np.uint64) for n in (0, 1, 254, 255, 256, 1000)]
    want = [sum(1 << b for b in range(64) if 2 * sum(int(h) >> b & 1 for h in g) > len(g)) for g in groups]
    assert simhash.fingerprints(groups).tolist() == want


def test_odd_documents(spark):
    got = simhash.near_groups(clashing(docs(spark, ODD))).collect()
    assert sorted((str(r.doc_id), r.fp & (1 << 64) - 1) for r in got) == sorted((str(i), by_hand(t)) for i, t in ODD)
    classes = {r.doc_id: r.component_id for r in got}
    assert classes[2] == classes[3] == classes[1] == 1 and classes[9] == classes[6] == 6
    assert simhash.near_groups(docs(spark, [])).count() == 0


def test_links_lose_no_component(spark):
    """Random values with planted neighbours, and a key that holds far more than PAIRED of them."""
    r = random.Random(4)
    values = {r.getrandbits(64) for _ in range(60)}
    for v in list(values)[:30]:
        values |= {v ^ 1 << r.randrange(64) ^ 1 << r.randrange(64), v ^ 1 << r.randrange(64)}
    hub = r.getrandbits(64)
    low = [b for b in range(64)]
    values |= {hub ^ 1 << a ^ 1 << b for a in low[::2] for b in low[1::7]}
    signed = sorted(simhash._signed(v) for v in values)
    for radius in (1, 2):
        found = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), radius)
        edges = [(x.a, x.b) for x in found.toDF("a", "b").collect()]
        assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 2 for a, b in edges)
        near = [(a, b) for i, a in enumerate(signed) for b in signed[i + 1 :] if ((a ^ b) & (1 << 64) - 1).bit_count() <= radius]
        assert joined(edges, signed) == joined(near, signed), radius


def test_components_of_paths_stars_and_loops(spark):
    r = random.Random(5)
    edges = [(i, i + 1) for i in range(40)] + [(1000, 1000 + i) for i in range(200)] + [(7, 7), (5000, 5001), (5001, 5000)] + [(r.randrange(2000, 2300), r.randrange(2000, 2300)) for _ in range(200)]
    got = {x.node: x.component for x in components.components(spark.createDataFrame([*edges, (None, 3)], "a long, b long")).collect()}
    nodes = {n for e in edges for n in e if e[0] != e[1]}
    assert got == {n: c for n, c in joined(edges, {n for e in edges for n in e}).items() if n in nodes}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_many_edges_and_of_few(spark, monkeypatch):
    r = random.Random(12)
    edges = [(r.randint(-400, 400), r.randint(-400, 400)) for _ in range(500)] + [(1000 + k, 1001 + k) for k in range(300)] + [(None, 5), (2000, 2000)]
    table = spark.createDataFrame(edges, "a long, b long")
    want = joined([e for e in edges if None not in e and e[0] != e[1]], {x for e in edges if None not in e and e[0] != e[1] for x in e})
    for held in (components.HELD, 0):
        monkeypatch.setattr(components, "HELD", held)
        assert {x.node: x.component for x in components.components(table).collect()} == want
        names = {x.node: x.component for x in components.components(table.selectExpr("string(a) AS a", "string(b) AS b")).collect()}
        assert set(names) == {str(x) for x in want} and len(set(names.values())) == len(set(want.values()))
    assert components.components(table.limit(0)).count() == 0


def test_few_edges_take_no_rounds(spark):
    table = spark.range(200).selectExpr("id AS a", "id + 1 AS b")
    spark.sparkContext.setJobGroup("few edges", "")
    found = components.components(table)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("few edges")) <= 6
    assert {x.component for x in found.collect()} == {0}


def test_near_copies_reach_similar_texts(spark):
    words = text(1, 300).split()
    copy = list(words)
    for i in (50, 200, 280):
        copy[i] = "changed"
    other = text(2, 300)
    rows = [(1, " ".join(words)), (2, " ".join(copy)), (3, other), (4, None), (5, other)]
    got = {r.doc_id: r.component_id for r in simhash.near_copies(docs(spark, rows)).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 3}


def test_one_of_each(spark):
    table = docs(spark, ODD)
    kept = simhash.one_of_each(table)
    assert kept.columns == table.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "10", "4", "5", "6", "8", "None"]
    assert simhash.one_of_each(docs(spark, [])).count() == 0


def test_one_of_each_loses_no_text_of_a_repeated_or_null_id(spark):
    rows = [(None, text(1, 60)), (None, text(2, 60)), (7, text(3, 60)), (7, text(4, 60)), (7, text(4, 60)), (None, text(4, 60)), (8, text(1, 60)), (9, None), (None, None)]
    got = sorted((str(r.doc_id), str(r.text)) for r in simhash.one_of_each(clashing(docs(spark, rows))).collect())
    assert got == sorted([("8", text(1, 60)), ("None", text(2, 60)), ("7", text(3, 60)), ("7", text(4, 60)), ("9", "None")])


def test_near_copies_find_all_pairs_of_the_similarity(spark):
    """By brute force over a table of edited copies: every pair of 0.8 or more is in one component, whatever its key's size."""
    r = random.Random(6)
    rows, base = [], [text(50 + k, r.randint(4, 150)).split() for k in range(12)]
    for i in range(260):
        own = list(base[0] if i % 3 else base[i % 12])
        for _ in range(r.choice((0, 1, 1, 2, 3, 6))):
            own[r.randrange(len(own))] = f"edit{r.randrange(10**6)}"
        rows.append((i, " ".join(own)))
    got = {x.doc_id: x.component_id for x in simhash.near_copies(docs(spark, rows)).collect()}
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(max(1, len(t.split()) - 4))} for i, t in rows}
    near = [(a, b) for a in sets for b in sets if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    assert len(near) > 1000 and sum(got[a] == got[b] for a, b in near) >= 0.98 * len(near)


def test_query_against_brute_force(spark):
    """All fingerprints and components of the query's whole table."""
    table = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in simhash.op3_simhash_groups(spark, SF).collect()}
    fps = {r.doc_id: by_hand(r.text) for r in table}
    assert {i: int(r.fingerprint, 16) for i, r in got.items()} == fps
    want = joined([(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 2], fps)
    assert {i: r.component_id for i, r in got.items()} == want


def test_query(spark):
    got = simhash.op3_simhash_groups(spark, SF).collect()
    assert len(got) == 200 and all(len(r.fingerprint) == 16 for r in got)
