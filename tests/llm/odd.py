"""Rows that every operator must stand, and prose made of a few words."""

from __future__ import annotations

import random

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "word"), (5, "two words"), (6, "!!! ???"), (7, "\x00 odd ▁ mark"), (8, "word"), (8, "word"),
       (9, "naïve café 東京 😀 " * 3), (10, "long " * 20_000), (11, "x" * 50_000), (None, "no id here at all")]


def prose(rng: random.Random, n: int, words: list[str] = WORDS) -> str:
    return " ".join(rng.choice(words) for _ in range(n))


def documents(spark, rows):
    """A table like ``documents`` from (doc_id, text) rows, with more columns whose names operators use themselves."""
    clash = ["row", "score", "key", "word", "ids", "held_out", "size", "token", "home", "id", "y", "predicted", "class_id", "value", "tokens", "item_id"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in clash)
    return spark.createDataFrame([(i, t, "en", "src0", None if t is None else len(t), *["x"] * len(clash)) for i, t in rows], schema)
