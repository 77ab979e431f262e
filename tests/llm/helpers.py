"""Small documents with nulls, empties, ties, repeats, long texts and clashing columns."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from lectern.llm import queries as _queries  # noqa: F401

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside.
CLASHES = ("keep_id", "digest", "slice", "salt", "row", "fp", "root", "members", "tokens",
           "probability", "kept", "m", "shard", "slot", "n_words", "score", "ids", "part")


def prose(seed: int, words: int) -> str:
    draw = random.Random(seed)
    return " ".join("".join(draw.choice("aeioustnrl") for _ in range(draw.randrange(2, 9)))
                    for _ in range(words))


def documents(spark):
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \t\n", "en", "a", 3),
        (4, "\u3000", "en", "a", 1), (5, "same text here", "en", "a", 14),
        (6, "same  text\nhere", "en", "b", 15), (6, "same  text\nhere", "en", "b", 15),
        (None, "same text here", None, "b", 14), (None, prose(1, 80), "en", "a", None),
        (7, prose(2, 30_000), "de", "a", None), (8, prose(3, 70), "de", None, None),
        (9, prose(3, 70) + " end", "de", "a", None), (10, "é" * 5_000, "fr", "a", None),
        (10, "é" * 5_000, "fr", "a", None),
        *[(20 + k, prose(100 + k, 60 + k), "en", "a", None) for k in range(40)],
    ]
    return spark.createDataFrame(rows, SCHEMA)


def clashing(docs):
    """The same rows with more columns, named as the operators' own."""
    return docs.withColumns({name: F.lit(f"own {name}") for name in CLASHES})


def rows_of(frame):
    return sorted(map(tuple, frame.collect()), key=repr)
