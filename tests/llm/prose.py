"""Invented documents for the tests."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `key` string, n_words int, fp double, n string, removed string, size string, copies string"
SYLLABLES = {"en": ["the", "and", "ing", "ion", "er", "th", "wh", "ou"], "de": ["sch", "ung", "ein", "ich", "ö", "ß", "ge", "ver"], "fr": ["eau", "ç", "ê", "ille", "tre", "oi", "eux", "que"]}


def prose(rng: random.Random, lang: str, words: int) -> str:
    """Invented text in lines of up to 14 words."""
    made = ["".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 3))) for _ in range(words)]
    lines = []
    while made:
        n = rng.randint(3, 14)
        lines.append(" ".join(made[:n]).capitalize() + ".")
        made = made[n:]
    return "\n".join(lines)
