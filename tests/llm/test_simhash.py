from __future__ import annotations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import lines, mixing, simhash
from tessera.llm.common import connected_components


def brute_print(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(prints):
    """Component of each print, by comparing all."""
    label = list(range(len(prints)))
    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= 3:
                x, y = label[i], label[j]
                label = [min(x, y) if v in (x, y) else v for v in label]
    return label


def test_matches_brute_force(docs, rows):
    got = sorted(simhash.simhash_components(docs).collect(), key=str)
    prints = [brute_print(r[1]) for r in rows]
    label = groups(prints)
    least = {}
    for r, g in zip(rows, label):
        if r[0] is not None:
            least[g] = min(least.get(g, r[0]), r[0])
    want = sorted(((r[0], f"{p:016x}", least.get(g)) for r, p, g in zip(rows, prints, label)), key=str)
    assert [tuple(x) for x in got] == want or sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_empty_table(empty):
    assert simhash.simhash_components(empty).count() == 0


@pytest.mark.parametrize("leaf", [1, 16, 4096])
def test_trie_links(leaf):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 200, dtype=np.uint64)
    flip = lambda x, k: x ^ np.bitwise_xor.reduce(np.uint64(1) << rng.integers(0, 64, (k, len(x))).astype(np.uint64))
    keys = np.unique(np.concatenate([base, flip(base, 2), flip(base, 3), flip(base, 4), base[0] ^ np.arange(64, dtype=np.uint64)]))
    cuts = np.array([0, 1, 100, len(keys)])
    got = {(int(a), int(b)) for i, j in simhash.trie_links(keys, cuts, leaf=leaf) for a, b in zip(i, j)}
    want = {(a, b) for lo, hi in zip(cuts[:-1], cuts[1:]) for a in range(lo, hi) for b in range(a + 1, hi) if int(keys[a] ^ keys[b]).bit_count() <= 3}
    assert got == want


def test_split_cells_lose_no_link(spark):
    """A dense cluster above the chunk size gives the same components as unsplit."""
    rng = np.random.default_rng(2)
    centre = 0x1234_5678_9ABC_DEF0
    prints = sorted({centre ^ int(np.bitwise_or.reduce(1 << rng.integers(0, 62, 3))) for _ in range(300)} | set(map(int, rng.integers(0, 2**62, 200))))
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    components = lambda e: {(r["node"], r["root"]) for r in connected_components(e).collect()}
    split = simhash.dealt(df, None, 20)
    assert split.where("part > 0").count() > 0
    assert split.groupBy("cell", "part").count().agg(F.max("count")).first()[0] <= 40 * 2
    got = components(split.mapInArrow(simhash._forests, "a long, b long"))
    assert got == components(simhash.links(df))
    label = groups(prints)
    assert len({r for _, r in got}) == sum(label.count(g) > 1 for g in set(label))


def test_components_of_chains_and_stars(spark):
    chain = [(k, k + 1) for k in range(200)]
    star = [(1000, 1000 + k) for k in range(1, 300)]
    found = dict(tuple(r) for r in connected_components(spark.createDataFrame(chain + star + [(5000, 5000)], "a long, b long")).collect())
    assert set(found) == set(range(201)) | set(range(1000, 1300))
    assert all(found[k] == 0 for k in range(201)) and all(found[k] == 1000 for k in range(1000, 1300))


def near_groups(texts):
    """Component of each text by the Jaccard similarity of its five-word shingles, comparing all with all."""
    sets = []
    for t in texts:
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    label = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if label[i] != label[j] and (a == b or len(a & b) >= 0.8 * len(a | b)):
                x, y = label[i], label[j]
                label = [min(x, y) if v in (x, y) else v for v in label]
    return label


def test_one_of_each(docs, rows):
    got = simhash.one_of_each(docs).collect()
    assert len(got) == len(set(near_groups([r[1] for r in rows])))
    assert [r["doc_id"] for r in got if r["text"] == rows[10][1]] == [min(r[0] for r in rows if r[1] == rows[10][1])]


def test_clashing_names(spark, docs):
    """Columns named as those inside come back as they were, from rows that repeat too."""
    odd = docs.select("doc_id", "text", F.lit("a").alias("key"), F.lit("b").alias("_key"), F.lit("c").alias("_copy"), F.lit("d").alias("_row_key"), F.lit(5).alias("rows"), F.lit(6).alias("copies"), F.lit("s").alias("source"), F.lit(7).alias("_keyn"), F.lit(8).alias("_removed"), F.lit(9).alias("_left"))
    some = odd.where("doc_id < 20 or doc_id = 308")
    for apply in (simhash.one_of_each, mixing.apply_mix, lines.without_copies):
        got = apply(some).collect()
        assert got and {tuple(r)[2:] for r in got} == {("a", "b", "c", "d", 5, 6, "s", 7, 8, 9)}


def changed(rng, words, share):
    some = list(words)
    for k in rng.choice(len(some), max(1, int(share * len(some))), replace=False):
        some[k] = f"w{rng.integers(1 << 30)}"
    return some


def test_recall_and_precision_at_the_similarity(spark):
    """Pairs around 0.8: nearly all above are found, none far below."""
    rng = np.random.default_rng(6)
    sets = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    rows, similarity = [], []
    for k in range(700):
        words = [f"v{x}" for x in rng.integers(0, 5000, int(rng.integers(60, 400)))]
        other = changed(rng, words, rng.choice([0.005, 0.01, 0.02, 0.06, 0.12]))
        a, b = sets(words), sets(other)
        similarity.append(len(a & b) / len(a | b))
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
    kept = {r["doc_id"] for r in simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(2 * k in kept for k in range(700))
    caught = np.array([2 * k + 1 not in kept for k in range(700)])
    s = np.array(similarity)
    assert caught[s >= 0.8].mean() >= 0.93 and caught[s >= 0.85].mean() >= 0.99 and caught[s < 0.68].mean() <= 0.02
