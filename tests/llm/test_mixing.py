from __future__ import annotations

import random

import numpy as np
import pytest

from tessera.llm import mixing


def shares(totals):
    """Targets by handing the excess on, round by round."""
    order = sorted(totals, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    everything, capped = sum(totals.values()), {}
    while True:
        free = [s for s in order if s not in capped]
        if not free:
            return capped
        rest = everything - sum(capped.values())
        target = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if target[s] > 3 * totals[s]]
        if not over:
            return capped | target
        capped |= {s: 3.0 * totals[s] for s in over}


def test_mix(docs, rows):
    got = mixing.mixed(docs).collect()
    assert len(got) == len(rows)
    size = {r[1]: len((r[1] or "").encode().split()) for r in rows}
    totals = {}
    for r in rows:
        totals[r[3]] = totals.get(r[3], 0) + size[r[1]]
    want = shares(totals)
    assert sorted((str(g["doc_id"]), g["size"], str(g["source"])) for g in got) == sorted((str(r[0]), size[r[1]], str(r[3])) for r in rows)
    for s, total in totals.items():
        own = [g for g in got if g["source"] == s]
        assert all(g["source_size"] == total and g["target"] == pytest.approx(want[s]) for g in own)
        assert sum(g["taken"] for g in own) == pytest.approx(want[s], abs=1.01)
    assert all(0 <= g["taken"] <= 3 * g["size"] for g in got)
    again = mixing.mixed(docs.repartition(3)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_fit_budget_is_near_and_within_counts():
    rng = random.Random(0)
    for _ in range(400):
        sizes = np.array(rng.sample(range(1, 80), rng.randint(1, 12)))
        counts = np.array([rng.randint(1, 6) for _ in sizes])
        total = int((sizes * counts).sum())
        budget = rng.randint(0, total)
        sums = {0}
        for s, n in zip(sizes.tolist(), counts.tolist()):
            sums = {x + k * s for x in sums for k in range(n + 1)}
        for span in (1 << 16, 10):
            took = mixing.fit_below(sizes, counts, budget, span)
            assert (took >= 0).all() and (took <= counts).all()
            assert 0 <= budget - int((took * sizes).sum()) <= sizes.max()
            near = mixing.fit_budget(sizes, counts, budget, span)
            assert (near >= 0).all() and (near <= counts).all()
            assert abs(budget - int((near * sizes).sum())) <= budget - int((took * sizes).sum())
        best = min(abs(budget - x) for x in sums)
        assert abs(budget - int((mixing.fit_budget(sizes, counts, budget) * sizes).sum())) <= best + 2
    big = np.arange(1, 5000)
    for budget in (1, 99_999, 12_345_678):
        assert int((mixing.fit_budget(big, np.full(len(big), 7), budget) * big).sum()) == budget


def test_edges(spark, empty):
    assert mixing.mixed(empty).count() == 0
    one = spark.createDataFrame([(1, None, "a"), (2, "", "a")], "doc_id long, text string, source string")
    assert [(r["size"], r["taken"], r["target"]) for r in mixing.mixed(one).collect()] == [(0, 0, 0.0)] * 2


def test_stage_repeats_rows(docs, rows):
    got = mixing.apply_mix(docs)
    assert got.columns == docs.columns
    words = sum(len((r["text"] or "").encode().split()) for r in got.collect())
    assert words == sum(r["taken"] for r in mixing.mixed(docs).collect())
