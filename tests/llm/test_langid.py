from __future__ import annotations

import random
import zlib

import numpy as np
from prose import prose
from pyspark.sql import functions as F

from tessera.llm import langid


def test_held_out_accuracy_and_odd_texts(spark, docs, rows):
    rng = random.Random(3)
    more = [(1000 + k, prose(rng, lang, 40), lang) for k, lang in enumerate(["en", "de", "fr"] * 60)]
    table = docs.select("doc_id", "text", "lang").union(spark.createDataFrame(more, "doc_id long, text string, lang string"))
    got = langid.identify(table).collect()
    assert len(got) == len(rows) + len(more)
    truth = {k: lang for k, _, lang in more}
    own = [r for r in got if r["doc_id"] in truth]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in own)
    held = [r for r in own if r["held_out"]]
    assert len(held) > 30 and np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in got)
    odd = {r["doc_id"]: r for r in got}
    for k in (300, 301, 302, 303):
        assert odd[k]["lang_pred"] == "und" and odd[k]["score"] == 0
    assert odd[305]["lang_pred"] == "en"


def test_matches_plain_naive_bayes():
    """Scores against a dictionary version that walks n-grams one by one."""
    rng = random.Random(4)
    texts = [prose(rng, lang, 12) for lang in ("en", "de", "fr")]
    counts = []
    for t in texts:
        row = np.zeros(langid.BUCKETS)
        for b in langid._buckets(langid._codes(t)):
            np.add.at(row, b, 1)
        counts.append(row)
    matrix = np.log((np.array(counts) + 0.5) / (np.array(counts).sum(axis=1, keepdims=True) + 0.5 * langid.BUCKETS))
    model = langid.Model(["a", "b", "c"], np.zeros(3, np.int64), np.rint(matrix * langid.SCALE).astype(np.int32))
    probes = [prose(rng, "de", 6), None, "", "?!", "x", texts[0] * 50]
    langs, scores = model.score(probes)
    for text, lang, score in zip(probes, langs, scores):
        alone = model.score([text])
        assert alone[0][0] == lang and alone[1][0] == score  # no matter what is in the batch
        if lang != "und":
            sums = np.zeros(3)
            for buckets in langid._buckets(np.append(langid._codes(text), [32, 32]).astype(np.uint32)):
                for b in buckets[: len(langid._codes(text))]:
                    sums += np.rint(matrix[:, b] * langid.SCALE)
            assert lang == "abc"[int(np.argmax(sums))]


def test_nothing_to_learn_from(docs, empty):
    assert langid.identify(empty).count() == 0
    none = langid.identify(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in none.collect()} == {"und"}


def test_accepted_keeps_columns(docs):
    got = langid.accepted(docs)
    assert got.schema == docs.schema
    kept = {r["doc_id"] for r in got.collect()}
    assert not kept & {300, 301, 302, 303} and set(range(1, 61)) <= kept
