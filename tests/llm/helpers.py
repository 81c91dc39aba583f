"""Small document tables with the cases that every operator has to stand."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows, extra: str = ""):
    """rows of (doc_id, text) or (doc_id, text, lang, source), with the columns of documents."""
    full = [(r[0], r[1], *(r[2:] or ("en", "a")), len(r[1] or "")) for r in rows]
    df = spark.createDataFrame(full, SCHEMA)
    for name in extra.split():
        df = df.selectExpr("*", f"'x' as {name}")
    return df


def sentences(seed: int, words: int = 60, alphabet: str = "the and of ring stone river cold bright lantern") -> str:
    pick = random.Random(seed)
    kinds = alphabet.split()
    return " ".join("".join(pick.choice(kinds) for _ in range(pick.randint(1, 2))) for _ in range(words))


#: Nulls, empty and blank texts, repeated rows, ties, a long text, text beyond ASCII.
HARD = [
    (1, None, None, None),
    (2, "", "en", "a"),
    (3, " \t\n", "en", None),
    (4, "one", "en", "b"),
    (4, "one", "en", "b"),
    (5, "One two ▁ three four 😀 \x00 end", "fr", "a"),
    (None, "no id", "en", "a"),
    (None, None, None, None),
    (6, sentences(6, 3000), "en", "a"),
    (7, sentences(7), "en", "c"),
    (8, sentences(7), "en", "c"),
]
