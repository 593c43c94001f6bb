from __future__ import annotations

import random

import pytest
from prose import SCHEMA, prose


@pytest.fixture(scope="session")
def rows() -> list[tuple]:
    """Documents with nulls in every column, odd texts, copies, near copies, repeated rows and clashing columns."""
    rng = random.Random(5)
    out = [(k, prose(rng, lang := rng.choice(["en", "en", "de", "fr"]), rng.randint(5, 120)), lang, f"src{k % 3}") for k in range(1, 61)]
    base = out[10][1]
    out += [(100 + k, base, "en", "src0") for k in range(12)]  # exact copies
    words = prose(rng, "en", 300).split(" ")
    for k in range(10):  # near copies
        some = list(words)
        some[rng.randrange(len(some))] = "changed"
        out.append((200 + k, " ".join(some), "en", "src0"))
    out += [
        (300, None, "en", "src1"), (301, "", "de", "src1"), (302, " \t\n ", None, "src2"), (303, "12 34 -- !!", "fr", None), (304, "one two", None, None),
        (None, "No id here but some words that are long enough to count.", "en", None), (None, None, None, None),
        (305, "word " * 20_000, "en", "src0"), (306, "x" * 50_000, "en", "src2"), (307, "Aé\x1cb\xa0c　d", "fr", "src1"),
        (308, "same row\nsame row\nsame row here again and again", "en", "src0"), (308, "same row\nsame row\nsame row here again and again", "en", "src0"),
        (309, "<|endoftext|> special <|endoftext|>", "en", "src0"), (309, "another text of the same id, with words", "en", "src1"),
    ]
    return [(i, t, lang, s, None if t is None else len(t), "clash", 7, 0.5, "n", "r", "s", "c") for i, t, lang, s in out]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
