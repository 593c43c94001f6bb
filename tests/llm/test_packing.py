from __future__ import annotations

import os
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

os.environ["TOKENIZERS_PARALLELISM"] = "false"
public_tokenizers = pytest.importorskip("public_tokenizers")

from tokenizers import Tokenizer  # noqa: E402

from tessera.llm import packing  # noqa: E402


def fewest(items, capacity):
    items, best = sorted(items, reverse=True), len(items)

    def place(k, room):
        nonlocal best
        if len(room) >= best:
            return
        if k == len(items):
            best = len(room)
            return
        for r in {r for r in room if r >= items[k]}:
            left = list(room)
            left.remove(r)
            place(k + 1, [*left, r - items[k]])
        place(k + 1, [*room, capacity - items[k]])

    place(0, [])
    return best


def held(plan, size, capacity):
    counts = np.zeros(size, int)
    for pattern, n in plan:
        assert n > 0 and 0 < sum(pattern) <= capacity
        for s in pattern:
            counts[s] += n
    return counts


def test_plan_is_optimal_on_small_cases():
    rng = random.Random(0)
    for _ in range(150):
        capacity = rng.choice([20, 30, 50])
        items = [rng.randint(1, capacity if rng.random() < 0.3 else capacity // 2) for _ in range(rng.randint(0, 9))]
        counts = np.bincount(items, minlength=capacity + 1)
        plan = packing.complete(counts, capacity)
        assert (held(plan, capacity + 1, capacity) == counts).all()
        assert sum(n for _, n in plan) == fewest(items, capacity)


def test_plan_is_optimal_where_lengths_repeat():
    """Best fit takes 6 sequences here, and so does a search that always applies a filling as often as it fits."""
    counts = np.zeros(31, int)
    for size, n in ((7, 4), (10, 2), (11, 4), (16, 3)):
        counts[size] = n
    assert sum(n for _, n in packing.best_fit(counts, 30)) == 6
    plan = packing.complete(counts, 30)
    assert (held(plan, 31, 30) == counts).all() and sum(n for _, n in plan) == 5
    rng = random.Random(1)
    for _ in range(600):
        capacity = rng.choice([20, 30, 40])
        kinds = [rng.randint(2, capacity * 2 // 3) for _ in range(rng.randint(2, 5))]
        items = [rng.choice(kinds) for _ in range(rng.randint(4, 12))]
        plan = packing.complete(np.bincount(items, minlength=capacity + 1), capacity)
        assert sum(n for _, n in plan) == fewest(items, capacity)


def test_search_decides_a_table(spark):
    """Rows whose best packing only the search finds, one of them repeated."""
    rows = [(k, 0, 0, size, k) for k, size in enumerate([7] * 4 + [10] * 2 + [11] * 4 + [16] * 3)]
    rows[1] = rows[0]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long"), 30).collect()
    assert len(got) == 13 and len({g["sequence_id"] for g in got}) == 5
    assert packing.pack(spark.createDataFrame([], "doc_id long, piece int, start long, length long, ids_crc32 long"), 30).count() == 0


def test_plan_is_near_the_bound_on_many():
    lengths = np.clip(np.random.default_rng(0).lognormal(6.3, 1, 30_000).astype(int), 1, 4096)
    counts = np.bincount(lengths, minlength=4097)
    plan = packing.complete(counts)
    assert (held(plan, 4097, 4096) == counts).all()
    assert sum(n for _, n in plan) <= -(-lengths.sum() // 4096) + 2


def test_pieces_and_places(docs, rows, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    got = packing.packed(docs, path).collect()
    library = Tokenizer.from_file(path)
    want = []
    for r in rows:
        ids = [*library.encode(r[1] or "", add_special_tokens=False).ids, 1]
        for piece, start in enumerate(range(0, len(ids), 4096)):
            part = ids[start : start + 4096]
            want.append((r[0], piece, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted(map(str, (tuple(g)[:5] for g in got))) == sorted(map(str, want))
    sequences = {}
    for g in got:
        sequences.setdefault(g["sequence_id"], []).append((g["offset"], g["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(sequences) == -(-sum(w[3] for w in want) // 4096)
    assert packing.packed(empty, path).count() == 0


def test_other_vocabularies_go_through_the_library(tmp_path):
    """A file with another split or normal form is not taken for the usual kind."""
    import json

    path = public_tokenizers.path("word_bpe_49k.json")
    assert packing.is_plain(path)
    spec = json.load(open(path, encoding="utf-8"))
    spec["normalizer"]["normalizers"] = spec["normalizer"]["normalizers"][:2]  # case kept
    other = f"{tmp_path}/other.json"
    json.dump(spec, open(other, "w", encoding="utf-8"))
    own = packing.Encoder(other)
    text = "Some TEXT, it's Ünïcode 123"
    assert not own.plain and own.ids([text, None])[0] == np.array(Tokenizer.from_file(other).encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_a_worker_keeps_no_tokenizer(spark, docs):
    """Workers outlive their tasks; the tables of a tokenizer don't."""

    def kept(batches):
        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([packing.encoder.cache_info().currsize])], names=["n"])

    assert packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json")).count()
    assert spark.range(64, numPartitions=32).mapInArrow(kept, "n long").agg({"n": "sum"}).first()[0] == 0
