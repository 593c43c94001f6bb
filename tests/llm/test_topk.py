from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, every, k, dim):
    """From the contract: each row with such an id asks, all other rows are candidates."""
    kept = []
    for i, v in rows:
        if v and len(v) == dim and not any(x is None or not math.isfinite(x) for x in v):
            kept.append((i, [math.floor(1024 * float(np.float32(x))) for x in v]))
    out = []
    for n, (q, v) in enumerate(kept):
        if q is not None and q % every == 0:
            scored = [(min(max(sum(a * b for a, b in zip(v, w)), -(2**63)), 2**63 - 1), i) for m, (i, w) in enumerate(kept) if m != n]
            scored.sort(key=lambda x: (-x[0], x[1] is None, x[1] or 0))
            out += [(q, r, i, s) for r, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out, key=str)


def table(seed, n, dim=8):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(5, dim))
    rows = [(int(i), (centre[i % 5] + rng.normal(scale=0.3, size=dim)).tolist()) for i in range(n)]
    rows += [(n + k, rows[3][1]) for k in range(20)]  # ties
    rows += [(7, rows[7][1]), (100, rows[100][1]), (200, [9.0] * dim)]  # repeated rows, and an id with two vectors
    rows += [(5000, None), (5001, []), (5002, [None] * dim), (5003, [float("nan")] * dim), (5004, [float("inf")] * dim), (None, [1.0] * dim), (5005, [1.0] * (dim + 1)), (6000, [0.0] * dim), (-100, [1.0] * dim)]
    return rows


@pytest.mark.parametrize("slice_bytes", [8 << 20, 64 * 3])
def test_matches_brute_force(spark, slice_bytes, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 32)
    rows = table(1, 400)
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).repartition(6)
    got = sorted((tuple(r) for r in topk.top_k(df, 100, 10, slice_bytes).select("query_id", "rank", "vec_id", "score").collect()), key=str)
    assert got == brute(rows, 100, 10, 8)


def test_fewer_rows_than_k_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0], 0), (1, [2.0, 1.0], 0), (2, [-1.0, 0.5], 0)], SCHEMA)
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in topk.top_k(df).orderBy("rank").collect()] == [(0, 1, 1), (0, 2, 2)]
    assert topk.top_k(df.limit(0)).count() == 0
    assert topk.top_k(df.where("vec_id = 1")).count() == 0
    assert topk.top_k(df.where("vec_id = 0")).count() == 0


def test_large_values_stay_exact(spark):
    rows = [(i, [1e5 + i, -1e4 * i, 3.0]) for i in range(0, 30)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    got = sorted((tuple(r) for r in topk.top_k(df, 10, 3).select("query_id", "rank", "vec_id", "score").collect()), key=str)
    assert got == brute(rows, 10, 3, 3)


def test_each_row_asks_and_is_a_candidate(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [2.0, 0.0]), (2, [0.0, 2.0]), (None, [9.0, 9.0]), (100, [1.0, 1.0]), (100, [1.0, 1.0]), (100, [1.0, 1.0])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    got = sorted((tuple(r) for r in topk.top_k(df, 100, 3).select("query_id", "rank", "vec_id", "score").collect()), key=str)
    assert got == brute(rows, 100, 3, 2) and len(got) == 15


def test_scores_beyond_a_long(spark):
    rows = [(0, [3e12, 1.0]), (1, [3e12, 2.0]), (2, [-3e12, 0.0]), (3, [1.0, 1.0]), (100, [0.5, 0.25])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    got = sorted((tuple(r) for r in topk.top_k(df).select("query_id", "rank", "vec_id", "score").collect()), key=str)
    assert got == brute(rows, 100, 10, 2)


def test_bounds_rule_blocks_out():
    """On vectors in clusters a query unpacks few blocks, and finds the same."""
    rng = np.random.default_rng(4)
    v = (rng.normal(size=(20, 8))[rng.integers(0, 20, 4000)] * 3 + rng.normal(scale=0.05, size=(4000, 8))) * 1024
    v = np.floor(v).astype(np.int64)
    v = v * 4000 // np.sqrt((v.astype(float) ** 2).sum(axis=1)).astype(np.int64)[:, None]  # of about one length
    top = float((v.astype(float) ** 2).sum(axis=1).max())
    whole = topk._augmented(v, top)
    at = whole[np.unique(np.linspace(0, 3999, 40).astype(int))]
    d = topk._distances(whole, at)
    near = d.argmin(axis=1)
    r = d[np.arange(4000), near]
    order = np.lexsort((r, near))
    blocks = []
    for p in np.unique(near):
        own = order[near[order] == p]
        blocks += [own[k : k + 32] for k in range(0, len(own), 32)]
    q = v[:5]
    own = topk._augmented(q, top)
    own[:, -1] = 0
    columns = [np.array([near[b[0]] for b in blocks]), np.array([r[b].min() for b in blocks]), np.array([r[b].max() for b in blocks])]
    columns += [[pa.scalar(np.arange(4000)[b].tobytes() + np.ones(len(b), bool).tobytes(), pa.binary()) for b in blocks], [pa.scalar(v[b].tobytes(), pa.binary()) for b in blocks]]
    first = topk.Search(np.arange(5), q, topk._distances(own, at), top, 10, None)
    first.visit(*columns)
    second = topk.Search(np.arange(5), q, topk._distances(own, at), top, 10, first.least)
    second.visit(*columns)
    assert second.visited < len(blocks) / 2
    for w in range(5):
        s = v @ q[w]
        s[w] = -(1 << 62)
        assert second.best[w][1].tolist() == np.lexsort((np.arange(4000), -s))[:10].tolist()
