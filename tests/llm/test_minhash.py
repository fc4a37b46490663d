"""Links in large groups of similar sets, against all pairs."""

import random

import numpy as np
import pytest

from tests.llm.test_simhash import joined
from tidemark.llm import minhash


def edited(r, base, least, most, word):
    """base with so many runs of five shingles replaced, as one edited word does it."""
    own = list(base)
    for k in r.sample(range(len(base) - 5), r.randint(least, most)):
        own[k : k + 5] = [word() for _ in range(5)]
    return own


def groups(kind):
    r = random.Random(kind)
    fresh = iter(range(10_000, 10_000_000))
    word = lambda: next(fresh)
    base = [word() for _ in range(120)]
    if kind == "copies":
        return [edited(r, base, 0, 7, word) for _ in range(300)]
    if kind == "pairs":  # each pair's sets are like each other and unlike the template
        out = [base]
        for _ in range(120):
            one = edited(r, base, 6, 7, word)
            out += [one, edited(r, one, 1, 2, word)]
        return out
    if kind == "versions":  # a second version with copies of its own, and parts of both
        other = edited(r, base, 9, 9, word)
        return [edited(r, v, 0, 6, word) for v in (base, other) for _ in range(120)] + [edited(r, base[:95], 0, 2, word) for _ in range(60)] + [base[k : k + 100] for k in range(20)]
    return [r.sample(range(11), r.randint(4, 9)) for _ in range(200)] + [[1], [1, 2], [3]] * 2


@pytest.mark.parametrize("kind", ["copies", "pairs", "versions", "small"])
def test_one_key_of_all_sets_gives_the_components_of_all_pairs(spark, kind, monkeypatch):
    sets = {i: set(s) for i, s in enumerate(groups(kind))}
    near = [(a, b) for a in sets for b in sets if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    assert len(near) > 50
    table = spark.createDataFrame([(i, [*range(12)], sorted(s)) for i, s in sets.items()], "hash long, bands array<long>, shingles array<long>")
    want = joined(near, sets)
    for paired in (4, 32):
        monkeypatch.setattr(minhash, "PAIRED", paired)
        monkeypatch.setattr(minhash, "PAIRED_AGAIN", paired)
        edges = [(x.a, x.b) for x in minhash.similar_links(table, table.selectExpr("hash", "1L AS n"), []).collect()]
        assert all(5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) for a, b in edges)
        assert joined(edges, sets) == want, paired


@pytest.mark.parametrize("paired", [4, 32])
def test_pairs_unlike_a_frequent_template_are_found_under_real_keys(spark, paired, monkeypatch):
    """Four hundred sets that share their keys with a template, in pairs that are like each other only."""
    monkeypatch.setattr(minhash, "PAIRED", paired)
    monkeypatch.setattr(minhash, "PAIRED_AGAIN", paired)
    r = random.Random(11)
    fresh = iter(range(10**6, 10**8))
    base = [next(fresh) for _ in range(300)]
    sets = {0: set(base)}
    for i in range(200):
        shared = edited(r, base, 5, 6, lambda: next(fresh))
        for k in (1, 2):
            sets[2 * i + k] = set(edited(r, shared, 2, 3, lambda: next(fresh)))
    rows = []
    for i, s in sets.items():
        hashes = minhash.mixed(np.array(sorted(s), dtype=np.uint64))
        rows.append((i, minhash.band_keys(hashes, np.array([len(s)]))[0].tolist(), sorted(s)))
    table = spark.createDataFrame(rows, "hash long, bands array<long>, shingles array<long>")
    near = [(a, b) for a in sets for b in sets if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    edges = [(x.a, x.b) for x in minhash.similar_links(table, table.selectExpr("hash", "if(hash = 0, 1000L, 1L) AS n"), []).collect()]
    got = joined(edges, sets)
    assert len(near) > 150 and sum(got[a] == got[b] for a, b in near) >= 0.97 * len(near)


def test_pairs_of_one_large_key_are_found_whatever_their_other_keys(spark):
    """Sets that share one key, of more than PAIRED, and have eleven others of few sets."""
    r = random.Random(5)
    fresh = iter(range(10**6, 10**8))
    word = lambda: next(fresh)
    sets = {}
    for i in range(30):
        base = [word() for _ in range(120)]
        sets[2 * i], sets[2 * i + 1] = set(base), set(edited(r, base, 1, 2, word))
    rows = [(i, [-1, *[1000 * b + i % 20 if i % 2 else -1000 * b - i % 20 - 1 for b in range(1, 12)]], sorted(s)) for i, s in sets.items()]
    table = spark.createDataFrame(rows, "hash long, bands array<long>, shingles array<long>")
    edges = [(x.a, x.b) for x in minhash.similar_links(table, table.selectExpr("hash", "1L AS n"), []).collect()]
    assert {(min(e), max(e)) for e in edges} == {(2 * i, 2 * i + 1) for i in range(30)}


@pytest.mark.parametrize("kind", ["copies", "pairs", "versions", "small"])
def test_split_groups_and_held_ones_have_the_components_of_all_pairs(spark, kind, monkeypatch):
    sets = {i: set(s) for i, s in enumerate(groups(kind))}
    near = [(a, b) for a in sets for b in sets if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    table = spark.createDataFrame([(i, [*range(12)], sorted(s)) for i, s in sets.items()], "hash long, bands array<long>, shingles array<long>")
    for held in (0, 90):  # none, and those that a first split leaves
        monkeypatch.setattr(minhash, "HELD", held)
        edges = [(x.a, x.b) for x in minhash.similar_links(table, table.selectExpr("hash", "1L AS n"), []).collect()]
        assert all(5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) for a, b in edges)
        assert joined(edges, sets) == joined(near, sets), held


def test_a_group_that_one_task_can_hold_is_not_split(spark, monkeypatch):
    monkeypatch.setattr(minhash, "_split", lambda *a: pytest.fail("split"))
    sets = groups("copies")
    table = spark.createDataFrame([(i, [*range(12)], sorted(set(s))) for i, s in enumerate(sets)], "hash long, bands array<long>, shingles array<long>")
    edges = minhash.similar_links(table, table.selectExpr("hash", "1L AS n"), []).collect()
    assert len(edges) < 12 * len(sets)


def test_common_shingles_of_a_group_are_counted_exactly():
    r = random.Random(3)
    sets = [sorted(r.sample(range(-1500, 1500), r.randint(0, 300))) for _ in range(60)] + [[], list(range(4000))]
    owners = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    found = minhash._common(owners, np.concatenate([np.array(s, dtype=np.int64) for s in sets]), len(sets))
    assert all(found[a, b] == len(set(sets[a]) & set(sets[b])) for b in range(len(sets)) for a in range(b))
