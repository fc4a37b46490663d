"""The corpus operators' queries and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import chat, decontaminate, langid, licenses, pieces, quality, sharding, simhash, substring, tokens

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_format": chat.op1_chat_format,
    "op2_quality_rules": quality.op2_quality_rules,
    "op3_simhash_groups": simhash.op3_simhash_groups,
    "op4_substring_dedup": substring.op4_substring_dedup,
    "op5_language_mixture": langid.op5_language_mixture,
    "op6_license_scan": licenses.op6_license_scan,
    "op7_token_counts": tokens.op7_token_counts,
    "op8_fm_decontaminate": decontaminate.op8_fm_decontaminate,
    "op10_piece_ids": pieces.op10_piece_ids,
    "op9_ring_shards": sharding.op9_ring_shards,
}

ORACLES: dict[str, str] = {
    "op1_chat_format": chat.OP1_SQL,
    "op8_fm_decontaminate": decontaminate.OP8_SQL,
}
