import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.data import ODD, clashing, docs, prose, text
from tidemark.llm import decontaminate as d
from tidemark.llm import fmindex


@given(st.lists(st.integers(0, 3), min_size=1, max_size=60))
@settings(max_examples=200)
def test_suffix_array(symbols):
    got = fmindex.suffix_array(np.array(symbols)).tolist()
    assert got == sorted(range(len(symbols)), key=lambda i: symbols[i:])


@given(st.lists(st.integers(1, 3), min_size=1, max_size=50), st.lists(st.integers(1, 3), min_size=1, max_size=4), st.integers(1, 9))
@settings(max_examples=200)
def test_index_finds_and_locates(symbols, phrase, every):
    full = [0, *symbols, 0]
    index = fmindex.FMIndex(np.array(full), 4, every)
    low, high = index.search(np.array([[-1] * (5 - len(phrase)) + phrase]))
    places = sorted(index.locate(np.arange(low[0], max(low[0], high[0]))).tolist())
    assert places == [i for i in range(len(full)) if full[i : i + len(phrase)] == phrase]


def test_wavelet_ranks():
    r = np.random.default_rng(0)
    symbols = r.integers(0, 11, 300)
    tree = fmindex.WaveletTree(symbols, 11)
    wanted, ends = r.integers(0, 11, 100), r.integers(0, 301, 100)
    assert tree.rank(wanted, ends).tolist() == [int((symbols[:e] == s).sum()) for s, e in zip(wanted, ends, strict=True)]


def by_hand(texts, items):
    windows = {}
    for item, t in items:
        w = d.words(None if t is None else t.encode())
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(str(item))
    out = []
    for t in texts:
        w, hit, found = d.words(None if t is None else t.encode()), set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if tuple(w[k : k + size]) in windows:
                    hit |= set(range(k, k + size))
                    found |= windows[tuple(w[k : k + size])]
        out.append((len(w), len(hit), sorted(found)))
    return out


def test_shards_match_brute_force():
    r = random.Random(1)
    items = [(i, text(i, r.choice((0, 3, 9, 10, 11, 40)))) for i in range(30)] + [(90, text(5, 40)), (91, None)]
    texts = []
    for k in range(80):
        parts = prose(500 + k, r.randrange(60))
        for _ in range(r.randrange(3)):
            own = (r.choice(items)[1] or "").split()
            cut = r.randrange(len(own) + 1)
            at = r.randrange(len(parts) + 1)
            parts = parts[:at] + own[cut:] + parts[at:]
        texts.append(r.choice((" ", ". ", "\n")).join(parts).upper() if k % 5 else " ".join(parts))
    texts += [None, "", items[3][1]]
    wanted = d.phrases([(i, None if t is None else t.encode()) for i, t in items])
    sizes, spans, found = d.hits([None if t is None else t.encode() for t in texts], wanted)
    got = [(n, sum(e - s for s, e in x), f) for n, x, f in zip(sizes, spans, found, strict=True)]
    assert got == by_hand(texts, items)
    assert all(s[i][1] < s[i + 1][0] for s in spans for i in range(len(s) - 1))


def test_words_are_cut_out():
    assert d.without("One, two three. Four!", [(1, 3)]) == "One, . Four!"
    assert d.without("é a b", [(0, 1), (2, 3)]) == " a "


def test_a_benchmark_of_several_blocks(spark, monkeypatch):
    items = [(i, text(i, 25)) for i in range(8)]
    rows = [(i, f"x {items[i % 8][1]} y {items[(i + 1) % 8][1]}") for i in range(12)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    one = sorted(map(str, d.contaminated(docs(spark, rows), bench).collect()))
    monkeypatch.setattr(d, "BLOCK_BYTES", 400)
    monkeypatch.setattr(d, "PIECE_WORDS", 7)
    blocks = list(d._blocks(bench, 10))
    assert len(blocks) > 2 and all(sum(len(t) for _, t in b) <= 400 for b in blocks)
    assert sorted(map(str, d.contaminated(docs(spark, rows), bench).collect())) == one


def test_odd_documents(spark):
    bench = spark.createDataFrame([(1, text(6, 80)), (2, None), (3, ""), (4, "one")], "item_id long, text string")
    got = d.contaminated(clashing(docs(spark, ODD)), bench).collect()
    want = by_hand([t for _, t in ODD], [(r.item_id, r.text) for r in bench.collect()])
    key = lambda x: (str(x[0]), x[1])
    assert sorted(((r.doc_id, r.n_words, list(r["items"])) for r in got), key=key) == sorted(((i, w[0], w[2]) for (i, _), w in zip(ODD, want, strict=True)), key=key)
    assert d.contaminated(docs(spark, []), bench).count() == 0
    assert d.contaminated(docs(spark, ODD), bench.limit(0)).where("size(items) > 0").count() == 0


def test_cleaned_texts(spark):
    item = text(1, 20)
    rows = [(1, f"before {item} after"), (2, item), (3, None), (4, "clean")]
    table = docs(spark, rows)
    got = {r.doc_id: r for r in d.cleaned(table, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()}
    assert sorted(got) == [1, 3, 4] and got[1].text == "before  after" and got[1].n_chars == len("before  after")


def test_memory_of_a_block():
    """A block's phrases take a small multiple of its text, so one block on the driver is bounded."""
    import tracemalloc

    block = [(i, text(i, 20_000).encode()) for i in range(12)]
    size = sum(len(t) for _, t in block)
    tracemalloc.start()
    wanted = d.phrases(block)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(wanted.windows) > 200_000 and peak < 60 * size


def test_clashing_columns_stay_in_cleaned_texts(spark):
    table = clashing(docs(spark, ODD))
    kept = d.cleaned(table, spark.createDataFrame([(7, text(6, 80))], "item_id long, text string"))
    assert kept.columns == table.columns and kept.count() == len(ODD) - 3
