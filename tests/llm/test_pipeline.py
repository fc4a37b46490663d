import pytest
import sentencepiece

import public_tokenizers
from tests.llm.data import ODD, SF, clashing, docs, text
from tests.llm.test_simhash import by_hand, joined
from tidemark.llm import decontaminate, langid, minhash, simhash
from tidemark.llm.common import ASCII_LOWER

pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_keep_clean_documents_and_catch_planted_ones(spark, tmp_path):
    passage, leak = text(1, 60), text(2, 30)
    edited = text(11, 300).split()
    edited[100] = "edited"
    rows = [
        (1, text(11, 300), "en"),
        (2, text(11, 300), "en"),
        (3, " ".join(edited), "en"),
        (4, f"{text(12, 50)} {passage} {text(13, 50)}", "en"),
        (5, f"{text(14, 70)} {passage} {text(15, 70)}", "en"),
        (6, f"{text(16, 70)} {leak} {text(17, 70)}", "en"),
        (7, "12 34", "en"),
        (8, text(18, 200), "en"),
    ]
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    table, left = docs(spark, rows), {}
    for name, stage in pipeline.STAGES:
        out = f"{tmp_path}/{name}"
        stage(spark, table, str(tmp_path)).write.parquet(out)
        table = spark.read.parquet(out)
        left[name] = {r.doc_id: r for r in table.collect()}
    columns = docs(spark, []).columns
    assert all(list(r.asDict()) == columns for name in list(left)[:4] for r in left[name].values())
    assert sorted(left["language_id"]) == [1, 2, 3, 4, 5, 6, 8]
    assert sorted(left["simhash_near_dedup"]) == [1, 4, 5, 6, 8]
    cut = left["substring_dedup"]
    assert cut[4].text == rows[3][1] and passage not in cut[5].text and cut[5].text.startswith(text(14, 70)[:200])
    clean = left["benchmark_decontamination"]
    assert leak not in clean[6].text and clean[6].text.startswith(text(16, 70)) and clean[8].text == rows[7][1]
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert {i: r.ids for i, r in left["piece_encoding"].items()} == {i: library.encode(r.text) for i, r in clean.items()}


def test_odd_and_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for k, rows in enumerate((ODD, [])):
        table = clashing(docs(spark, rows))
        for name, stage in pipeline.STAGES:
            out = f"{tmp_path}/{k}-{name}"
            stage(spark, table, str(tmp_path)).write.parquet(out)
            table = spark.read.parquet(out)
        assert table.count() == (6 if rows else 0)


def test_near_copies_that_share_one_large_key_are_dropped(spark, tmp_path, monkeypatch):
    """Every shared key counts as large here; pairs of texts, of which some share one or two keys."""
    rows = []
    for i in range(60):
        words = text(100 + i, 110).split()
        other = [f"edited{i}" if k in (30, 70) else w for k, w in enumerate(words)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
    bands = [set(b.tolist()) for b in simhash._banded([t.encode() for _, t in rows])[1].values()]
    n_shared = [len(bands[2 * i] & bands[2 * i + 1]) for i in range(60)]
    assert sum(n in (1, 2) for n in n_shared) >= 2
    monkeypatch.setattr(minhash, "PAIRED", 1)
    left = {r.doc_id for r in pipeline.drop_near_copies(spark, docs(spark, rows), str(tmp_path)).collect()}
    assert all(2 * i in left and 2 * i + 1 not in left for i, n in enumerate(n_shared) if n)


def test_a_paragraph_of_many_edited_copies_is_cut_without_rounds(spark, tmp_path, monkeypatch):
    """Copies of a line with one word changed in each, more than PAIRED: one task compares them, none is split."""
    monkeypatch.setattr(minhash, "_split", lambda *a: pytest.fail("split"))
    line = text(1, 90).split()
    rows = [(i, f"own{i} words{i}\n{' '.join([*line[: i % 80], f'edited{i}', *line[i % 80 + 1 :]])}") for i in range(100)]
    left = {r.doc_id: r.text for r in pipeline.cut_repeats(spark, docs(spark, rows), str(tmp_path)).collect()}
    assert left.pop(0) == rows[0][1] and len(left) == 99
    assert all(left[i].strip() == f"own{i} words{i}" for i in left)


def shared(texts, size, words):
    """The ids of texts that have a run of so many words that another text has too."""
    holders = {}
    for i, t in texts.items():
        own = words(t)
        for k in range(len(own) - size + 1):
            holders.setdefault(tuple(own[k : k + size]), set()).add(i)
    return {i for found in holders.values() if len(found) > 1 for i in found}


def test_run_against_brute_force(spark):
    """The whole table: who is left, what is cut, and that nothing else changes, by plain comparison of all pairs."""
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = pipeline.run(spark, SF)
    assert got.columns == ["doc_id", "ids", "n_tokens", "round_trip"]
    left = {r.doc_id: library.decode(list(r.ids)) for r in got.collect() if r.round_trip and r.n_tokens == len(r.ids)}
    assert len(left) == got.count()
    table = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    lower = lambda t: t.encode().translate(ASCII_LOWER).split()

    in_language = {r.doc_id for r in langid.accepted(spark.read.parquet(f"{SF}/documents.parquet"), langid.taught(spark.read.parquet(f"{SF}/documents.parquet"))).collect()}
    texts = {i: t for i, t in table.items() if i in in_language}
    fps = {i: by_hand(t) for i, t in texts.items()}
    sets = {i: {tuple(lower(t)[k : k + 5]) for k in range(max(1, len(lower(t)) - 4))} for i, t in texts.items()}
    near = [(a, b) for a in texts for b in texts if a < b and ((fps[a] ^ fps[b]).bit_count() <= 2 or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]))]
    first = {i: texts[i] for i, top in joined(near, texts).items() if i == top}
    assert set(left) <= set(first)

    assert not shared(left, 50, lower)
    windows = {tuple(w[k : k + 10]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() for w in [decontaminate.words(r.text.encode())] for k in range(max(1, len(w) - 9))}
    assert not any(tuple(w[k : k + 10]) in windows for t in left.values() for w in [decontaminate.words(t.encode())] for k in range(len(w)))
    hit = {i for i, t in first.items() for w in [decontaminate.words(t.encode())] if any(tuple(w[k : k + 10]) in windows for k in range(len(w)))}
    alike = shared(first, 12, lower)
    for i, t in first.items():
        if i not in hit | alike:
            assert left[i] == t
        elif i in left:
            rest = iter(t.split())
            assert all(any(w.endswith(x) or w.startswith(x) for w in rest) for x in left[i].split())
        else:
            assert i in alike | hit
    assert len(hit) > 0 and len(first) < len(table)
