import re
from collections import Counter

import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from tests.llm.data import ODD, SF, clashing, docs, text
from tidemark.llm import quality, trees


def by_hand(t):
    t = t or ""
    w = re.findall("[^\x20\x09-\x0d]+", t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    hit = {i for k in range(len(w) - 7) if windows[tuple(w[k : k + 8])] > 1 for i in range(k, k + 8)}
    return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(hit)]


@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab \n\t#|é ", max_size=120)), max_size=5))
def test_statistics_match_a_plain_count(found):
    got = quality.statistics([None if t is None else t.encode() for t in found])
    assert [[int(got[k][i]) for k in quality.COUNTS] for i in range(len(found))] == [by_hand(t) for t in found]


def test_monotone_trees_never_turn():
    r = np.random.default_rng(1)
    rows = r.random((800, 3))
    labels = ((rows[:, 0] > 0.4) ^ (rows[:, 1] > 0.7) ^ (r.random(800) < 0.1)).astype(float)
    forest = trees.fit(rows, labels, np.array([1, -1, 0]), trees=30)
    for feature, sign in ((0, 1), (1, -1)):
        for base in r.random((40, 3)):
            line = np.repeat(base[None, :], 50, axis=0)
            line[:, feature] = np.linspace(0, 1, 50)
            assert (sign * np.diff(forest.margin(line)) >= -1e-12).all()
    assert ((forest.probability(rows) > 0.5) == (labels > 0.5)).mean() > 0.75


def test_one_class_or_none():
    assert (trees.fit(np.zeros((5, 2)), np.ones(5), np.zeros(2)).probability(np.zeros((3, 2))) > 0.5).all()
    assert (trees.fit(np.zeros((0, 2)), np.zeros(0), np.zeros(2)).probability(np.zeros((3, 2))) == 0.5).all()


def test_odd_documents(spark):
    table = docs(spark, ODD)
    labels = spark.createDataFrame([(6, 1, 0), (None, 1, 0), (9, None, 1), (99, 0, 0)], "doc_id long, quality long, toxic long")
    got = quality.judge(clashing(table), quality.train(table, labels)).collect()
    want = sorted((str(i), by_hand(t)) for i, t in ODD)
    assert sorted((str(r.doc_id), [r[k] for k in quality.COUNTS]) for r in got) == want
    assert all(r.base_failed and not r.kept for r in got if r.n_words < 20)
    assert quality.judge(table.limit(0), quality.train(table.limit(0), labels)).count() == 0


def test_held_out_accuracy(spark):
    r = np.random.default_rng(2)
    good = [(i, text(i, 200)) for i in range(300)]
    bad = [(1000 + i, " ".join(f"{w}{r.choice(list('#$%|'))}" for w in text(1000 + i, 200).split())) for i in range(300)]
    table = docs(spark, good + bad)
    labels = spark.createDataFrame([(i, int(i < 1000), 0) for i, _ in good[:150] + bad[:150]], "doc_id long, quality int, toxic int")
    got = {x.doc_id: x.kept for x in quality.judge(table, quality.train(table, labels)).collect()}
    assert sum(got[i] == (i < 1000) for i, _ in good[150:] + bad[150:]) >= 295


def test_repeated_ids_stay_within_the_sample(spark):
    table = docs(spark, [(1, text(1, 30))] * 40 + [(1, text(2, 30)), (2, text(3, 30))])
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, 1, 0)], "doc_id long, quality long, toxic long")
    held = []
    original, trees.fit = trees.fit, lambda rows, *a, **b: held.append(len(rows)) or original(rows, *a, **b)
    try:
        quality.train(table, labels)
    finally:
        trees.fit = original
    assert held == [2]


def test_query_against_a_plain_count(spark):
    """Every column of the whole table; the verdict by a walk through each tree's nodes."""
    table = spark.read.parquet(f"{SF}/documents.parquet")
    forest = quality.train(table, spark.read.parquet(f"{SF}/labels.parquet"))
    texts = {r.doc_id: r.text for r in table.collect()}
    got = {r.doc_id: r for r in quality.op2_quality_rules(spark, SF).collect()}
    assert {i: [r[k] for k in quality.COUNTS] for i, r in got.items()} == {i: by_hand(t) for i, t in texts.items()}
    score = dict(zip(texts, forest.probability(quality.features(quality.statistics([None if t is None else t.encode() for t in texts.values()])))))
    for i, r in got.items():
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert r.kept == (not r.base_failed and score[i] >= 0.5)
