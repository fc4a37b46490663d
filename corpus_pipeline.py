"""A corpus pipeline of the operators: language, near copies, repeated passages, benchmark leaks, token ids."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontaminate, langid, pieces, simhash, substring
from tidemark.llm.common import checkpoint_dir, discard, read, ship


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the others' lang teaches; see langid.accepted() and langid.taught().

    Rejects null texts, those without letters, and those too unlike all languages. Null ids teach nothing and are judged
    like others, repeated rows each for itself; an empty table stays empty; further columns of any name stay.
    """
    ship(spark)
    return langid.accepted(docs, langid.taught(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies; see simhash.one_of_each().

    Of equal rows one stays, of rows of one id or of null id those whose texts are unlike; null and blank texts are one
    group; an empty table stays empty; further columns of any name stay.
    """
    ship(spark)
    return simhash.one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one has; see substring.deduplicated().

    Documents left without a word go. Rows of one id or of null id lose what their own text shares with others; null, empty
    and blank texts stay as they are; an empty table stays empty; further columns of any name stay.
    """
    ship(spark)
    return substring.deduplicated(docs)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of benchmark windows; see decontaminate.cleaned().

    Documents left without a word go. Each row is judged by itself, whatever its id; null, empty and blank texts stay as
    they are; an empty table stays empty; further columns of any name stay.
    """
    ship(spark)
    return decontaminate.cleaned(docs, read(spark, sf_dir, "benchmark"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token ids, a row for each row; see pieces.encoded().

    A null text has no ids, like an empty one; null ids and repeated rows stay; an empty table gives no rows; further
    columns are left out.
    """
    ship(spark)
    return pieces.encoded(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("benchmark_decontamination", cut_benchmark),
    ("piece_encoding", encode_pieces),
]

#: The stages learn a model, group fingerprints and encode by merges, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's are written as Parquet, read again by the next, and deleted after it."""
    docs = read(spark, sf_dir, "documents")
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    before: list[str] = []
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        discard(spark, before)
        before.append(path)
    return docs
