from __future__ import annotations

import re

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORD.findall(text or "")
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    places = {}
    for i, g in enumerate(grams):
        places.setdefault(g, []).append(i)
    covered = {i + k for at in places.values() if len(at) > 1 for i in at for k in range(5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), len(lines), sum(a == b for a, b in zip(words, words[1:])))


def test_measures(rows):
    for r in rows:
        assert quality.measure(r[1]) == brute(r[1])
    for t in ("a b c d e a b c d e", "a a a a a a", "a b c d e f a b c d", "x\n\n x\nx", "# | <b> $ % & *"):
        assert quality.measure(t) == brute(t)


def test_verdicts_and_sql(spark, docs, rows):
    got = quality.judged(docs)
    assert got.count() == len(rows)
    unique = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    con = duckdb.connect()
    con.register("documents", unique.select("doc_id", "text").toPandas())
    want = con.execute(quality.ORACLE).df()
    mine = quality.judged(unique).toPandas()
    columns = sorted(mine.columns)
    assert sorted(want.columns) == columns
    assert mine.sort_values("doc_id")[columns].astype(str).values.tolist() == want.sort_values("doc_id")[columns].astype(str).values.tolist()
    assert not [r for r in got.collect() if r["base_failed"] and r["kept"]]


def test_policies_and_ablations(docs, empty):
    entries = quality.ledger(docs).cache()
    for name in quality.POLICIES:
        bits = quality.mask(quality.POLICIES[name])
        assert entries.where(quality.passes(name)).count() == sum(r["failed"] & bits == 0 for r in entries.collect())
    all_rows = [r["failed"] for r in entries.collect()]
    for r in quality.ablations(entries).collect():
        bit = 1 << list(quality.RULES).index(r["rule"])
        assert r["n_failed"] == sum(bool(f & bit) for f in all_rows)
        assert r["n_failed_alone"] == sum(f == bit for f in all_rows)
        assert r["n_kept_without"] == sum(f & ~bit == 0 for f in all_rows)
    assert quality.judged(empty).count() == 0


def test_clean_text_is_kept(spark):
    text = "This is a plain paragraph with enough different words that no rule has a reason to reject it."
    row = quality.judged(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row["kept"] and not row["base_failed"] and row["failed"] == 0
    assert quality.judged(spark.createDataFrame([(1, None)], "doc_id long, text string")).select(F.col("n_words")).first()[0] == 0


def test_stored_ledger(spark, docs, tmp_path, monkeypatch):
    """Policies read the stored ledger; one of other rules is not found; ablations equal the twin's."""
    entries = quality.write_ledger(docs, str(tmp_path))
    for policy in quality.POLICIES:
        same = lambda df: sorted(map(str, df.collect()))
        assert same(quality.verdicts(entries, policy)) == same(quality.judged(docs, policy))
    assert quality.judged(docs).columns[:8] == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    unique = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    con = duckdb.connect()
    con.register("documents", unique.select("doc_id", "text").toPandas())
    want = sorted(con.execute(quality.ABLATIONS).fetchall())
    got = quality.ablations(quality.ledger(unique)).select("rule", "n_failed", "n_failed_alone", "n_kept_without").collect()
    assert sorted(map(tuple, got)) == want
    monkeypatch.setitem(quality.RULES, "few_words", "n_words < 11")
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        quality.read_ledger(spark, str(tmp_path))
