"""Small tables with the cases that every operator must bear."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


def prose(seed: int, n: int) -> list[str]:
    r = random.Random(seed)
    syllables = ["an", "er", "on", "th", "in", "re", "ou", "ti", "ble", "st", "ha", "ed", "nd", "ly"]
    return ["".join(r.choices(syllables, k=r.randint(1, 4))) for _ in range(n)]


def text(seed: int, n: int) -> str:
    return " ".join(prose(seed, n))


def docs(spark, rows):
    """Documents (doc_id, text) or (doc_id, text, lang); other columns null, one of them clashing with results."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else None, None, None if r[1] is None else len(r[1])) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


#: Null, empty, blank, one-word and very long texts, repeated rows, a null id, and text of other scripts.
ODD = [
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (4, "one"),
    (5, text(5, 40_000)),
    (6, text(6, 80)),
    (6, text(6, 80)),
    (None, text(7, 80)),
    (8, "日本語のテキスト 😀 \x00 ▁ <|endoftext|>"),
    (9, text(6, 80)),
    (10, "a" * 30_000),
]


def clashing(df):
    """df with columns named like results."""
    from pyspark.sql import functions as F

    for name in ("fp", "score", "spans", "items", "n_words", "ids", "node", "component", "hash", "n_tokens", "lang_pred", "kept", "root"):
        df = df.withColumn(name, F.lit("x"))
    return df
