from __future__ import annotations

import os
import random

import pytest

os.environ["TOKENIZERS_PARALLELISM"] = "false"
public_tokenizers = pytest.importorskip("public_tokenizers")

from tokenizers import Tokenizer  # noqa: E402

from tessera.llm import packing, tokens  # noqa: E402

PARTS = ["a", "A", "'s", "'S", "'", "'ll", " ", "  ", "\n", "\t", "\xa0", "\x1c", "\x00", "\x7f", "é", "É", "é", "ß", "µ", "ÿ", "Ÿ", "İ", "Σ", "日本", "1", "٣", "²", "½", "ª",
         "<|endoftext|>", "<|startoftext|>", "<|endof", "😀", "zzz", "_", "...", " the", "\x85", "\xad", "​", "　"]


@pytest.fixture(scope="module")
def texts(rows):
    rng = random.Random(1)
    return [r[1] or "" for r in rows] + ["".join(rng.choices(PARTS, k=rng.randint(0, 40))) for _ in range(1500)] + ["a" * 5000, " " * 3000, "ab" * 3000, "aaaa aaaaa aaaaaa"]


def test_counts_match_the_library(texts):
    path = public_tokenizers.path("byte_bpe_50k.json")
    want = [len(e.ids) for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert tokens.Merges(path).count(texts) == want


def test_ids_match_the_library(texts):
    path = public_tokenizers.path("word_bpe_49k.json")
    got = [memoryview(b).cast("I").tolist() for b in packing.Encoder(path).ids(texts)]
    assert got == [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]


def test_table(docs, rows, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    got = tokens.token_counts(docs, path).collect()
    library = Tokenizer.from_file(path)
    n = {r[1]: len(library.encode(r[1] or "", add_special_tokens=False).ids) for r in rows}
    assert sorted(map(str, map(tuple, got))) == sorted(str((r[0], len((r[1] or "").encode()), n[r[1]], n[r[1]] > 1024)) for r in rows)
    assert tokens.token_counts(empty, path).count() == 0
