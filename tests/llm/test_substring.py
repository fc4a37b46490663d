import random

import numpy as np

from tests.llm.data import ODD, SF, clashing, docs, prose, text
from tidemark.llm import minhash, substring

P = substring.PARAGRAPH


def covered(spans, start, end):
    return any(s["start"] <= start and end <= s["end"] for s in spans)


def test_runs_hash_equal_words_alike():
    words = np.arange(200, dtype=np.uint64) % np.uint64(40)
    for length in (1, 5, 31, 36):
        hashed = minhash.runs(words, length)
        assert len(hashed) == 200 - length + 1
        assert (hashed[:100] == hashed[40:140]).all() and len(set(hashed[:40].tolist())) == 40


def test_every_shared_passage_holds_one_equal_window():
    r = random.Random(3)
    for seed in range(60):
        passage = prose(seed, substring.LEAST)
        texts = [" ".join(prose(1000 + 2 * seed + k, r.randint(0, 60)) + passage + prose(5000 + 2 * seed + k, r.randint(0, 60))).encode() for k in range(2)]
        made = substring.paragraphs(texts)
        assert set(made["hashes"][0].tolist()) & set(made["hashes"][1].tolist()), seed


def test_passages_inside_lines_and_near_lines(spark):
    passage, line = text(1, 70), text(2, 90)
    changed = line.split()
    changed[60] = "changed"
    rows = [
        (1, f"{text(11, 30)} {passage} {text(12, 30)}"),
        (2, f"{text(21, 45)} {passage} {text(22, 5)}"),
        (3, f"{text(31, 20)}\n{line}\n{text(32, 20)}"),
        (4, f"{text(41, 8)}\n{' '.join(changed)}\n{text(42, 20)}"),
        (5, f"{text(51, 30)} {' '.join(passage.split()[:40])} {text(52, 30)}"),
        (6, f"{passage} {passage}"),
        (7, text(71, 200)),
    ]
    got = {r.doc_id: r for r in substring.repeated(docs(spark, rows)).collect()}
    assert [i for i, r in got.items() if r.n_removed] and {i for i, r in got.items() if r.n_removed} - {5} == {2, 4, 6}
    assert got[2].n_removed >= P and covered(got[2].spans, 45 + 20, 45 + 50)
    assert [(s["start"], s["end"]) for s in got[4].spans] == [(8, 98)]
    assert {i: r.class_id for i, r in got.items() if i != 5} == {1: 1, 2: 1, 3: 3, 4: 3, 6: 1, 7: 7}


def test_links_match_brute_force_where_keys_are_hot(spark):
    """Hundreds of edited copies of one line, far more than PAIRED to a key."""
    r = random.Random(8)
    base = prose(9, 120)
    lines = []
    for i in range(150):
        own = list(base)
        for k in r.sample(range(120), r.choice((0, 1, 2, 4, 6))):
            own[k] = f"w{i}"
        lines.append(" ".join(own))
    made = substring.paragraphs([x.encode() for x in lines])
    rows = {substring._signed(x[0][2]): ([int(b) for b in x[0][3]], w) for x, w in zip(made["lines"], made["words"])}
    table = spark.createDataFrame([(h, b, w) for h, (b, w) in rows.items()], "hash long, bands array<long>, words binary")
    edges = {(x.a, x.b) for x in minhash.similar_links(table, table.selectExpr("hash", "1L AS n"), [], "words", minhash.word_shingles("words")).collect()}
    sets = {h: {w[4 * k : 4 * k + 20] for k in range(len(w) // 4 - 4)} for h, (_, w) in rows.items()}
    near = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert all(len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) for a, b in edges)
    from tests.llm.test_simhash import joined

    got, want = joined(edges, sets), joined(near, sets)
    assert sum(got[h] == want[h] for h in sets) >= 0.95 * len(sets)


def test_odd_documents(spark):
    got = {r.doc_id: r for r in substring.repeated(clashing(docs(spark, ODD))).collect()}
    assert substring.repeated(docs(spark, ODD)).count() == len(ODD)
    assert got[1].n_words == got[2].n_words == got[3].n_words == 0 and got[5].n_words == 40_000
    assert got[9].class_id == 6 and got[9].n_removed >= 50 and got[6].n_removed == 0
    assert got[None].n_removed == 0
    assert substring.repeated(docs(spark, [])).count() == 0


def test_deduplicated_texts(spark):
    passage = text(1, 60)
    rows = [(1, passage), (2, f"before it\n{passage}\nafter  it"), (3, passage), (4, None), (5, "x")]
    got = {r.doc_id: r for r in substring.deduplicated(docs(spark, rows)).collect()}
    assert sorted(got) == [1, 2, 4, 5] and got[1].text == passage and got[4].text is None
    assert got[2].text == "before it\n\nafter  it" and got[2].n_chars == len(got[2].text)


def test_query_finds_all_long_repeats(spark):
    """Every window of LEAST words that stands in an earlier document too has PARAGRAPH of them in a span."""
    table = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    got = {r.doc_id: r.spans for r in substring.op4_substring_dedup(spark, SF).collect()}
    seen, repeats = {}, 0
    for r in table:
        words = r.text.encode().translate(substring.ASCII_LOWER).split()
        for k in range(len(words) - substring.LEAST + 1):
            first = seen.setdefault(tuple(words[k : k + substring.LEAST]), r.doc_id)
            if first != r.doc_id:
                repeats += 1
                assert max((min(s["end"], k + substring.LEAST) - max(s["start"], k) for s in got[r.doc_id]), default=0) >= P
    assert repeats > 100


def test_spans_reach_the_exact_ends(spark):
    """Passages of LEAST words and more lose all their words, the ones that only a later document has too."""
    rows, want = [], {}
    for k, size in enumerate((50, 51, 57, 64, 100)):
        passage = text(100 + k, size)
        rows += [(10 * k + 1, f"{text(200 + k, 31)} {passage} {text(300 + k, 23)}"), (10 * k + 2, f"{text(400 + k, 17)} {passage} {text(500 + k, 40)}")]
        want |= {10 * k + 1: [], 10 * k + 2: [(17, 17 + size)]}
    long = prose(600, 60)
    rows += [(91, " ".join(prose(601, 9) + long[5:] + prose(602, 9))), (92, " ".join(prose(603, 9) + long + prose(604, 9))), (93, " ".join(prose(605, 9) + long + prose(606, 9)))]
    want |= {91: [], 92: [(14, 69)], 93: [(9, 69)]}
    got = {r.doc_id: [(s["start"], s["end"]) for s in r.spans] for r in substring.repeated(docs(spark, rows)).collect()}
    assert got == want


def test_all_places_of_a_passage_in_a_later_document(spark):
    passage = text(1, 60)
    rows = [(1, f"{text(2, 20)} {passage} {text(3, 20)}"), (2, f"{text(4, 9)} {passage} {text(5, 7)} {passage} {text(6, 9)}"), (3, " ".join([text(7, 60)] * 3))]
    got = {r.doc_id: [(s["start"], s["end"]) for s in r.spans] for r in substring.repeated(docs(spark, rows)).collect()}
    assert got == {1: [], 2: [(9, 69), (76, 136)], 3: []}


def test_rows_of_one_id_or_of_none_keep_their_own_words(spark):
    passage, other = text(1, 60), text(2, 70)
    rows = [
        (1, f"{text(3, 9)} {passage} {text(4, 9)}"),
        (2, f"{passage} {text(5, 30)}"),
        (2, text(6, 20)),
        (2, text(7, 130)),
        (None, f"{text(8, 30)} {passage}"),
        (None, text(9, 90)),
        (None, f"{other} {text(10, 40)}"),
        (None, f"{text(11, 44)} {other}"),
        (3, f"{text(12, 25)} {passage}"),
        (3, f"{text(12, 25)} {passage}"),
    ]
    got = substring.repeated(docs(spark, rows)).collect()
    lost = sorted((str(r.doc_id), r.n_words, [(s["start"], s["end"]) for s in r.spans]) for r in got)
    nulls = [x for x in lost if x[0] == "None" and x[1] in (110, 114)]
    assert sum(bool(x[2]) for x in nulls) == 1 and sum(e - s for x in nulls for s, e in x[2]) == 70
    assert [x for x in lost if x not in nulls] == sorted(
        [("1", 78, []), ("2", 90, [(0, 60)]), ("2", 20, []), ("2", 130, []), ("None", 90, [(30, 90)]), ("None", 90, []), ("3", 85, [(25, 85)]), ("3", 85, [(25, 85)])]
    )
    left = sorted(r.text for r in substring.deduplicated(docs(spark, rows)).collect())
    assert len(left) == 10 and text(6, 20) in left and text(7, 130) in left and text(9, 90) in left
    assert sum(passage in t for t in left) == 1 and sum(other in t for t in left) == 1 and left.count(f"{text(12, 25)} ") == 2


def test_only_words_that_repeat_are_removed(spark):
    """By brute force: every removed word stands in a run of five words that another document has too."""
    r = random.Random(5)
    passages = [prose(700 + k, r.choice((20, 35, 49, 50, 55, 80))) for k in range(12)]
    rows = []
    for i in range(60):
        own = []
        for k in range(r.randint(1, 4)):
            own += prose(10_000 + 10 * i + k, r.randint(1, 60)) + r.choice(passages) + (["\n"] if r.random() < 0.2 else [])
        rows.append((i, " ".join(own)))
    got = {x.doc_id: x.spans for x in substring.repeated(docs(spark, rows)).collect()}
    words = {i: t.split() for i, t in rows}
    holders = {}
    for i, own in words.items():
        for k in range(len(own) - 4):
            holders.setdefault(tuple(own[k : k + 5]), set()).add(i)
    removed = 0
    for i, found in got.items():
        for s in found:
            own = words[i][s["start"] : s["end"]]
            removed += len(own)
            assert len(own) >= 36 and all(len(holders[tuple(own[k : k + 5])]) > 1 for k in range(len(own) - 4))
    assert removed > 2000


def test_wrapped_paragraphs_are_banded(spark):
    import textwrap

    base = prose(1, 90)
    changed = [w if k % 44 else "edited" for k, w in enumerate(base)]
    rows = [(1, "head line\n\n" + "\n".join(textwrap.wrap(" ".join(base), 60))), (2, "\n".join(textwrap.wrap(" ".join(changed), 70)) + "\n\nanother end")]
    got = {x.doc_id: x for x in substring.repeated(docs(spark, rows)).collect()}
    assert [(s["start"], s["end"]) for s in got[2].spans] == [(0, 90)] and got[1].spans == [] and got[2].class_id == 1


def test_a_text_of_very_many_spans(spark):
    n = 100_000
    found = spark.range(n).selectExpr("7L AS row", "cast(10 * id AS int) AS start", "cast(10 * id + if(id % 2 = 0, 10, 4) AS int) AS end")
    (row,) = substring.merged_spans(found.union(found)).collect()
    assert len(row.spans) == n // 2 and [tuple(s) for s in row.spans[:2]] == [(0, 14), (20, 34)]
