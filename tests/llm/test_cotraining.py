from __future__ import annotations

import random

import numpy as np
from prose import prose

from tessera.llm import cotraining


def corpus(n, seed=0):
    rng = random.Random(seed)
    rows, labels = [], []
    for k in range(n):
        good = rng.random() < 0.7
        text = prose(rng, "en", rng.randint(20, 80))
        if not good:
            text = " ".join(w + rng.choice(["###", "$$$", " |"]) for w in text.split())
        source = f"src{rng.choice([0, 1, 2] if good == (rng.random() < 0.8) else [3, 4])}"
        rows.append((k, text, "en", source, len(text)))
        labels.append((k, int(good), 0))
    return rows, labels


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_held_out_accuracy(spark):
    rows, labels = corpus(600)
    docs = spark.createDataFrame(rows, SCHEMA)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").where("doc_id < 300")
    got = {r["doc_id"]: r for r in cotraining.classify(docs, known).collect()}
    assert len(got) == 600
    assert np.mean([got[k]["kept"] == bool(q) for k, q, _ in labels if k >= 300]) > 0.95
    assert all(0 <= r[c] <= 1 for r in got.values() for c in ("p_text", "p_meta", "score"))
    again = {r["doc_id"]: r["score"] for r in cotraining.classify(docs.repartition(7), known.repartition(3)).collect()}
    assert all(abs(again[k] - r["score"]) < 1e-9 for k, r in got.items())


def test_rounds_match_a_plain_version(spark):
    """The distributed rounds against sums over rows in plain Python."""
    rows, labels = corpus(300, 3)
    known = labels[:100]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(6)
    held = cotraining.features(docs)
    model = cotraining.fit(held, spark.createDataFrame(known, "doc_id long, quality int, toxic int"), labelled=60)
    label = {k: q for k, q, _ in known}
    every = sorted(held.collect(), key=lambda r: r["hash"])
    mine = [r for r in every if r["doc_id"] in label][:60]
    rest = [r for r in every if r["doc_id"] not in label]
    view = lambda some, a, b: cotraining.Rows.packed([bytes(r[a]) for r in some], [bytes(r[b]) for r in some])
    dot = lambda r, a, b, w: sum(float(w[i]) * float(v) for i, v in zip(np.frombuffer(r[a], np.uint16), np.frombuffer(r[b], np.float16)))
    columns = (("index", "value"), ("meta", "meta_value"))

    def teach(weights, judges):
        sums, n = [np.zeros((2 * cotraining.SUMS, w)) for w in cotraining.WIDTHS], np.zeros((2, 2 * cotraining.SUMS), int)
        for r in rest:
            for k in (0, 1):
                z, judge = dot(r, *columns[1 - k], weights[1 - k]), judges[1 - k]
                if z >= judge.high - 1e-6 or z <= judge.low + 1e-6:
                    g = (cotraining.SUMS if z >= judge.high - 1e-6 else 0) + r["hash"] % cotraining.SUMS
                    n[k, g] += 1
                    for i, v in zip(np.frombuffer(r[columns[k][0]], np.uint16), np.frombuffer(r[columns[k][1]], np.float16)):
                        sums[k][g, i] += float(v)
        return sums, n

    want = cotraining.co_train(tuple(view(mine, *c) for c in columns), np.array([label[r["doc_id"]] for r in mine], float), teach)
    assert np.allclose(model.text, want.text, atol=1e-9) and np.allclose(model.meta, want.meta, atol=1e-9)
    assert [t[:3] for t in model.taught] == [t[:3] for t in want.taught]
    assert {view for view, good, bad, *_ in model.taught if good + bad} == {0, 1}, "both views teach"


def ranked_right(z, y):
    """Share of pairs of a good and a bad row that the logits put in order."""
    rank = np.argsort(np.argsort(z))
    good = y == 1
    return (rank[good].mean() - (good.sum() - 1) / 2) / (~good).sum()


def test_views_teach_each_other():
    """Both views teach and are taught, and neither loses by it."""
    gains = []
    for seed in range(6):
        rows, labels = corpus(1500, seed)
        views = cotraining.Rows.of([cotraining.text_view(r[1]) for r in rows]), cotraining.Rows.of([cotraining.meta_view(r[3], r[2], r[4]) for r in rows])
        y = np.array([q for _, q, _ in labels], float)
        some, rest = np.arange(100), np.arange(100, 1500)
        others = tuple(v.take(rest) for v in views)
        right = []
        for rounds in (0, 3):
            model = cotraining.co_train(tuple(v.take(some) for v in views), y[some], lambda w, j: cotraining.taught_sums(others, rest % cotraining.SUMS, w, j), rounds)
            right.append([ranked_right(others[0].times(model.text), y[rest]), ranked_right(others[1].times(model.meta), y[rest])])
        assert all(good + bad for _, good, bad, *_ in model.taught)
        gains.append(np.subtract(right[1], right[0]))
    text, meta = np.mean(gains, axis=0)
    assert meta > -0.005 and text > -0.002


def test_edges(spark, docs, rows, empty):
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(1, 61)] + [(None, 1, 0), (5, None, 0), (9999, 1, 0)], "doc_id long, quality int, toxic int")
    assert cotraining.classify(docs, labels).count() == len(rows)
    assert cotraining.classify(empty, labels).count() == 0
    held, none = cotraining.features(docs), cotraining.features(empty)
    assert cotraining.fit(held, labels.where("quality = 1")) is None and cotraining.fit(none, labels.limit(0)) is None
    assert {r["score"] for r in cotraining.score(held, None).collect()} == {0.5}


def test_a_busy_id_is_bounded(spark):
    """One labelled id on many rows: no more than the stated number of rows is gathered."""
    rows = [(1, f"good text number {k} with some words", "en", "a", 30) for k in range(300)] + [(2, "### bad $$$ |", "en", "b", 13)]
    held = cotraining.features(spark.createDataFrame(rows, SCHEMA))
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    seen = []
    keep = cotraining.co_train
    cotraining.co_train = lambda views, y, teach, rounds: seen.append(len(y)) or keep(views, y, teach, rounds)
    try:
        cotraining.fit(held, labels, labelled=50)
    finally:
        cotraining.co_train = keep
    assert all(n <= 50 for n in seen)
