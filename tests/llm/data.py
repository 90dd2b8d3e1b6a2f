"""Small tables for the tests of the operators on text and vectors."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, shard int, cls string, _text string"
WORDS = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "ra", "tu", "ve") for b in ("n", "st", "r", "l") for c in ("a", "en", "o", "ing")]


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


def documents(spark, rows):
    """Rows of (doc_id, text), with further columns whose names operators use themselves."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 0.5, 3, "x", "y") for i, t in rows], DOCS)


def awkward(spark):
    """Nulls, empty and blank texts, a very long one, ties, repeated rows, a repeated and a null doc_id."""
    rng = random.Random(5)
    text = sentence(rng, 60)
    long = sentence(rng, 40_000)
    return documents(spark, [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, text), (6, text), (7, text), (7, text), (8, long), (9, "Ünïcödé ﬁ 日本語 😀 \x00 ▁x"), (None, text), (None, None), (8, "other text")])


def empty(spark):
    return documents(spark, [])
