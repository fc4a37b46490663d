"""Language identification by a mixture of n-gram models for each document.

Each learned language is a distribution over hashed byte trigrams. A document is a mixture of languages
whose proportions expectation-maximisation estimates; of the nested sets of its strongest languages, of any size, the
one with the best penalised likelihood is taken, and the largest share names the document. How likely the document is
under that mixture, between random letters and the languages' own texts, says whether it is in them at all.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import chunks, quoted, read, same, texts, unused

GRAMS = 1 << 12
UNDETERMINED = "und"
ROUNDS = 12
#: Trigrams overlap, so a text has about a third as many independent observations.
INDEPENDENT = 1 / 3

_LETTERS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
_ASCII_LETTER = re.compile(rb"[A-Za-z]")


def has_letters(text: bytes | None) -> bool:
    if not text:
        return False
    return bool(_ASCII_LETTER.search(text)) or (not text.isascii() and any(map(str.isalpha, text.decode())))


def gram_counts(text: bytes) -> np.ndarray:
    """Counts of the hashed byte trigrams of lower-cased words, each with a space around it."""
    kept = b" " + b" ".join(text.decode().lower().encode().translate(_LETTERS).split()) + b" "
    b = np.frombuffer(kept, dtype=np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(GRAMS, dtype=np.int64)
    codes = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    return np.bincount((codes * np.uint32(2654435761)) >> np.uint32(20), minlength=GRAMS)


@dataclass(frozen=True)
class Model:
    """languages and, for each trigram, its probability in each of them."""

    languages: tuple[str, ...]
    probability: np.ndarray

    def mixtures(self, counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The proportions of the chosen languages of each document, a row each that sums to 1, and its likeness.

        The likeness is its mean log-likelihood, where that of a trigram drawn evenly is 0 and that of a trigram drawn
        from the languages themselves is 1. Sets are tried from the smallest on, for as long as the likelihood of all
        languages together leaves room for a larger one to be the best.
        """
        n, size = len(counts), len(self.languages)
        docs = [np.flatnonzero(c) for c in counts]
        lengths = np.array([len(d) for d in docs])
        grams = np.concatenate(docs)
        weight = np.concatenate([c[d] for c, d in zip(counts, docs, strict=True)]).astype(np.float32)
        starts = np.cumsum(lengths) - lengths
        total = np.add.reduceat(weight, starts)
        p = self.probability[grams]

        def climb(shares: np.ndarray, rounds: int, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Shares after so many rounds, and the log-likelihoods, of the documents of those numbers."""
            if len(of) < n:
                at = np.repeat(starts[of] - np.cumsum(lengths[of]) + lengths[of], lengths[of]) + np.arange(lengths[of].sum())
                own, seen_of, first = p[at], weight[at], np.cumsum(lengths[of]) - lengths[of]
            else:
                own, seen_of, first = p, weight, starts
            for _ in range(rounds):
                mixed = own * np.repeat(shares, lengths[of], axis=0)
                mixed *= (seen_of / mixed.sum(axis=1))[:, None]
                shares = np.add.reduceat(mixed, first, axis=0) / total[of, None]
            seen = (own * np.repeat(shares, lengths[of], axis=0)).sum(axis=1)
            return shares, np.add.reduceat(seen_of * np.log(seen), first)

        full, full_fit = climb(np.full((n, size), 1 / size, dtype=np.float32), ROUNDS, np.arange(n))
        order = np.argsort(-full, axis=1, kind="stable")
        penalty = 0.5 * np.log(np.maximum(total, 2))
        best, best_fit, best_value = full.copy(), full_fit.copy(), np.full(n, -np.inf)
        for k in range(1, size + 1):
            live = np.flatnonzero(INDEPENDENT * full_fit - penalty * (k - 1) > best_value)
            if not len(live):
                break
            if k < size:
                held, top = np.zeros((len(live), size), dtype=np.float32), order[live, :k]
                np.put_along_axis(held, top, np.maximum(np.take_along_axis(full[live], top, axis=1), 1e-6), axis=1)
                shares, fit = climb(held / held.sum(axis=1, keepdims=True), 0 if k == 1 else ROUNDS // 3, live)
            else:
                shares, fit = full[live], full_fit[live]
            value = INDEPENDENT * fit - penalty[live] * (k - 1)
            better = value > best_value[live]
            at = live[better]
            best[at], best_fit[at], best_value[at] = shares[better], fit[better], value[better]
        log = np.log(self.probability)
        chance, own = best @ log.mean(axis=0), best @ (self.probability * log).sum(axis=0)
        return best, (best_fit / total - chance) / np.maximum(own - chance, 1e-6)


def learn(docs: DataFrame, most_languages: int = 4096, smoothing: float = 0.5) -> Model:
    """A model from the columns text and lang of all rows of docs; rows of null text or lang teach nothing.

    The trigrams are counted where the rows are; a count for each language and trigram reaches the driver, which
    bounds what it holds and broadcasts. All languages are learned; more than most_languages are a ValueError.
    """
    rows = docs.select("text", "lang").where("text IS NOT NULL AND lang IS NOT NULL")
    known = [r[0] for r in rows.select("lang").distinct().limit(most_languages + 1).collect()]
    if len(known) > most_languages:
        raise ValueError(f"lang has more than {most_languages} values")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in chunks(batch, "text", 1 << 20):
                for text, lang in zip(texts(part, "text"), part["lang"].to_pylist(), strict=True):
                    if lang not in sums:
                        sums[lang] = np.zeros(GRAMS, dtype=np.int64)
                    sums[lang] += gram_counts(text)
        for lang, sum_ in sums.items():
            found = np.flatnonzero(sum_)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(found), pa.string()), "gram": pa.array(found, pa.int32()), "n": pa.array(sum_[found], pa.int64())})

    sums = rows.mapInArrow(counted, "lang string, gram int, n long")
    table = np.full((GRAMS, len(known)), smoothing)
    languages = tuple(sorted(known))
    for lang, gram, n in sums.groupBy("lang", "gram").agg(F.sum("n")).collect():
        table[gram, languages.index(lang)] += n
    return Model(languages, (table / table.sum(axis=0)).astype(np.float32))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred, score and likeness: the predicted language, its share of the text, and Model.mixtures()'s.

    A null text, one without letters, and any text under a model of no languages are `und` with score and likeness 0.
    Each row is judged by its whole text alone, without a shuffle; null ids, repeated rows and other
    columns stay, of which those named like the results are replaced; an empty table gives no rows.
    """
    docs = docs.drop("lang_pred", "score", "likeness")
    # a chunk's trigrams have a number for each language
    most = max(1, (1 << 22) // max(4, len(model.languages)))

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text", most):
                found = texts(part, "text")
                names, scores, likeness = [UNDETERMINED] * len(found), np.zeros(len(found)), np.zeros(len(found))
                known = [i for i, t in enumerate(found) if has_letters(t) and model.languages]
                if known:
                    shares, likeness[known] = model.mixtures([gram_counts(found[i]) for i in known])
                    for i, row in zip(known, shares, strict=True):
                        names[i] = model.languages[int(np.argmax(row))]
                        scores[i] = min(1.0, float(row.max()))
                out = {k: part[k] for k in part.schema.names}
                yield pa.RecordBatch.from_pydict(out | {"lang_pred": pa.array(names, pa.string()), "score": pa.array(scores, pa.float64()), "likeness": pa.array(likeness, pa.float64())})

    schema = ", ".join([*(f"{quoted(c)} {t}" for c, t in docs.dtypes), "lang_pred string, score double, likeness double"])
    return docs.mapInArrow(judged, schema)


def held_out(doc_id: str = "doc_id"):
    """Whether a document is kept from learning; one of null id is neither held out nor learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def taught(docs: DataFrame) -> Model:
    """A model from the documents that aren't held out."""
    return learn(docs.where(F.col("doc_id").isNotNull() & ~held_out()))


def accepted(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """docs with its columns: the rows in a learned language, or a mixture of some, with at least that likeness.

    Random letters and languages that weren't learned come to under a half, texts of those learned to more, however
    short or mixed they are. Null texts and those without letters are rejected too. A model of no languages, from
    documents without any lang, rejects only these. Null ids and repeated rows are judged by their text alone; an empty
    table stays empty; columns of any name stay.
    """
    own = ("lang_pred", "score", "likeness")
    aside = dict(zip(own, unused(docs.columns, *own), strict=True))
    renamed = {c: aside[c.lower()] for c in docs.columns if c.lower() in own}
    found = identify(docs.withColumnsRenamed(renamed), model)
    if model.languages:
        found = found.where((F.col("lang_pred") != UNDETERMINED) & (F.col("likeness") >= least))
    else:
        found = found.where(F.coalesce(F.col("text"), F.lit("")).rlike(r"\p{L}"))
    return found.drop(*own).withColumnsRenamed({v: k for k, v in renamed.items()}).select(*same(docs.columns))


def op5_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents."""
    docs = read(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), taught(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "likeness")
