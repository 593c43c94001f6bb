from __future__ import annotations

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import hdc
from tessera.operators import beliefs, diffusion, graph, learning, nearest, temporal, traverse
from tessera.operators.ontology import Condition, Rule
from tessera.functions import belief as B

CONFIG = graph.GraphConfig("g", embedding_dim=4, hdc_dim=8)


def event(seq, kind, **payload):
    return (seq, "g", kind, json.dumps(payload), "", seq)


def log(spark, rows):
    return spark.createDataFrame(rows, "seq long, graph_id string, type string, payload string, rng_state string, wall_ms long")


def apply(events, at):
    """Edges after the events, one by one."""
    edges = {}
    for seq, _, kind, payload, _, _ in sorted(events):
        p = json.loads(payload)
        if seq > at:
            break
        if kind in ("edge:add", "edge:infer"):
            edges[p["id"]] = {"weight": p["weight"], "expires_at": p.get("expires_at"), "log_seq": seq}
        elif kind == "edge:remove":
            edges.pop(p["id"], None)
        elif kind == "edge:update" and p["id"] in edges:
            edges[p["id"]].update(p["delta"])
    return edges


def random_events(n, seed):
    rng, rows = random.Random(seed), []
    for seq in range(n):
        key = f"e{rng.randrange(12)}"
        kind = rng.choice(["edge:add", "edge:infer", "edge:update", "edge:update", "edge:remove"])
        if kind == "edge:update":
            delta = {k: v for k, v in (("weight", round(rng.random(), 3)), ("expires_at", rng.choice([None, rng.randrange(100)]))) if rng.random() < 0.6}
            rows.append(event(seq, kind, id=key, delta=delta))
        elif kind == "edge:remove":
            rows.append(event(seq, kind, id=key))
        else:
            rows.append(event(seq, kind, id=key, source_id="a", target_id="b", verb_type="v", weight=round(rng.random(), 3), authority="player", confidence=1.0, expires_at=rng.choice([None, 5])))
    return rows


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_replay_matches_one_by_one(spark, seed):
    rows = random_events(150, seed)
    events = log(spark, rows)
    for at in (20, 90, 149):
        got = {r.id: {"weight": r.weight, "expires_at": r.expires_at, "log_seq": r.log_seq} for r in temporal.edges_at(events, at).collect()}
        assert got == apply(rows, at)
    half = temporal.edges_at(events, 70)
    got = {r.id: {"weight": r.weight, "expires_at": r.expires_at, "log_seq": r.log_seq} for r in temporal.edges_at(events, None, half, 70).collect()}
    assert got == apply(rows, 149)


def test_entities_replay(spark):
    bundle = "/wH/Af8B/wE="  # -1 1 -1 1 ...
    events = log(spark, [
        event(0, "entity:create", id="a", type="npc", properties={"k": "v"}), event(1, "entity:create", id="b", type="npc"), event(2, "embedding:update", entityId="a", embedding="AACAPwAAAAAAAAAAAAAAAA=="),
        event(3, "hdc:update", entityId="a", memoryBundle=bundle), event(4, "entity:remove", id="b"), event(5, "embedding:update", entityId="b", embedding="AACAPwAAAAAAAAAAAAAAAA=="),
        event(6, "entity:create", id="c", type="npc"), event(7, "hdc:update", entityId="c", memoryBundle=bundle), event(8, "entity:create", id="c", type="new"),
    ])
    got = {r.id: r for r in temporal.entities_at(events, CONFIG).collect()}
    assert set(got) == {"a", "c"}
    assert got["a"].embedding == [1.0, 0.0, 0.0, 0.0] and got["a"].embedding_ver == 1 and got["a"].memory_bundle == [-1, 1] * 4 and got["a"].properties == {"k": "v"}
    assert got["c"].type == "new" and got["c"].memory_bundle == [1] * 8 and got["c"].log_seq == 8
    assert tuple(temporal.replay_summary(events, None, 6, "rng").first()) == (8, 2, "rng")


EDGE_COMMANDS = "ord long, id string, source_id string, target_id string, verb_type string, weight double, t_norm string, authority string, confidence double, asserted_by string, properties map<string,string>, expires_at long"


def commands(spark, rows):
    return spark.createDataFrame([(k, i, s, t, v, w, None, None, c, None, None, None) for k, (i, s, t, v, w, c) in enumerate(rows)], EDGE_COMMANDS)


def tables(spark):
    made = spark.createDataFrame([(k, i, "npc", None) for k, i in enumerate("abc")] + [(9, "a", "npc", None), (10, " ", "npc", None), (11, "d", "", None)], "ord long, id string, type string, properties map<string,string>")
    done = graph.commit_create_entities(made, spark.createDataFrame([], graph.ENTITY), CONFIG, 0)
    verbs = spark.createDataFrame([("ally", False, []), ("friend", True, [])], "id string, symmetric boolean, domain array<string>")
    return done, verbs


def test_commit_entities(spark):
    done, _ = tables(spark)
    rows = {r.id: r for r in done.rows.collect()}
    assert set(rows) == {"a", "b", "c"} and rows["a"].memory_bundle == [1] * 8 and rows["b"].embedding == [0.0] * 4 and [rows[i].log_seq for i in "abc"] == [0, 1, 2]
    assert {(r.id, tuple(r.errors)) for r in done.refused.collect()} == {("a", ("id:duplicate",)), (" ", ("id:blank",)), ("d", ("type:blank",))}
    again = temporal.entities_at(done.events, CONFIG)
    assert sorted(again.select("id", "type", "log_seq").collect()) == sorted(done.rows.select("id", "type", "log_seq").collect())


def test_commit_edges_replay_and_versions(spark):
    done, verbs = tables(spark)
    rows = [("e1", "a", "b", "ally", 0.5, None), ("e2", "b", "c", "friend", 0.8, 0.9), ("e3", "a", "x", "ally", 0.5, None), ("e1", "a", "b", "ally", 0.5, None), ("e4", "a", "b", "foe", 1.5, -1.0)]
    added = graph.commit_add_edges(commands(spark, rows), done.rows, spark.createDataFrame([], graph.EDGE), verbs, CONFIG, 3)
    got = {r.id: r for r in added.rows.collect()}
    assert set(got) == {"e1", "e2", "e2:sym"}
    twin = got["e2:sym"]
    assert (twin.source_id, twin.target_id, twin.authority, twin.confidence, twin.log_seq) == ("c", "b", "inference", 0.891, 5)
    assert got["e1"].authority == "player" and got["e1"].confidence == 1.0
    assert {r.id: set(r.errors) for r in added.refused.collect()} == {"e3": {"target:missing"}, "e1": {"id:duplicate"}, "e4": {"verb:unregistered", "weight:range", "confidence:range"}}
    assert {r.id: r.bumps for r in added.bumps.collect()} == {"a": 1, "b": 3, "c": 2}
    assert {r.id: r.version for r in graph.bump_versions(done.rows, added.bumps).collect()} == {"a": 1, "b": 3, "c": 2}
    replayed = temporal.edges_at(added.events)
    assert sorted(replayed.select("id", "weight", "confidence", "log_seq", "authority").collect()) == sorted(added.rows.select("id", "weight", "confidence", "log_seq", "authority").collect())
    assert {r.type for r in added.events.collect()} == {"edge:add", "edge:infer"}

    change = spark.createDataFrame([(0, "e1", 0.7, None, None, None), (1, "e2:sym", 0.1, None, None, None), (2, "e9", 0.1, None, None, None), (3, "e1", None, 0.5, None, 44), (4, "e1", 0.9, None, None, None)],
                                   "ord long, id string, weight double, confidence double, properties map<string,string>, expires_at long")
    changed = graph.commit_update_edges(change, added.rows, CONFIG, 6)
    now = {r.id: r for r in changed.rows.collect()}
    assert (now["e1"].weight, now["e1"].confidence, now["e1"].expires_at) == (0.9, 0.5, 44) and now["e2:sym"].weight == 0.8
    assert {r.id: r.errors for r in changed.refused.collect()} == {"e2:sym": ["edge:inferred"], "e9": ["edge:missing"]}
    assert {r.id: r.bumps for r in changed.bumps.collect()} == {"a": 3, "b": 3}

    gone = graph.commit_remove_edges(spark.createDataFrame([(0, "e2"), (1, "zz")], "ord long, id string"), changed.rows, CONFIG, 9)
    assert {r.id for r in gone.rows.collect()} == {"e1", "e2:sym"} and [r.id for r in gone.refused.collect()] == ["zz"]
    both = graph.commit_remove_edges(spark.createDataFrame([(0, "e2")], "ord long, id string"), changed.rows, CONFIG, 9, with_twins=True)
    assert {r.id for r in both.rows.collect()} == {"e1"}

    checked = graph.commit_remove_entities(spark.createDataFrame([(0, "a"), (1, "c"), (2, "x")], "ord long, id string"), done.rows, both.rows, CONFIG, 10)
    assert {r.id for r in checked.rows.collect()} == {"a", "b"} and {r.id: r.errors for r in checked.refused.collect()} == {"a": ["entity:has edges"], "x": ["entity:missing"]}


def test_lookups(spark):
    edges = spark.createDataFrame([("1", "a", "b", "v", 1.0, None), ("2", "a", "b", "w", 1.0, 5), ("3", "b", "a", "v", 1.0, 9)], "id string, source_id string, target_id string, verb_type string, weight double, expires_at long")
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(graph.edges_from(edges, "a")) == ["1", "2"] and ids(graph.edges_to(edges, "a")) == ["3"] and ids(graph.edges_by_verb(edges, "v")) == ["1", "3"]
    assert ids(graph.edges_between(edges, "a", "b")) == ["1", "2"] and ids(graph.edges_between(edges, "a", "b", "")) == ["1", "2"] and ids(graph.edges_between(edges, "a", "b", "w")) == ["2"]
    assert ids(graph.alive(edges, 5)) == ["1", "3"] and tuple(graph.counts(edges, edges).first()) == (3, 3)


def test_ordered_training_matches_one_by_one(spark):
    rng = np.random.default_rng(0)
    edges = [(k, f"n{a}", f"n{b}", f"v{k % 2}", float(w)) for k, (a, b, w) in enumerate(zip(rng.integers(0, 6, 25), rng.integers(0, 6, 25), rng.random(25)))] + [(99, "x", "y", "v0", 0.5)]
    start = {f"n{k}": rng.uniform(-1, 1, 4).astype(np.float32) for k in range(6)} | {i: np.full(4, 0.25, np.float32) for i in "xyz"}
    relation = dict(zip(["v0", "v1"], hdc.relation_floats(["v0", "v1"], 42, 4)))
    want = {k: v.copy() for k, v in start.items()}
    r6 = lambda x: np.floor(x * 1e6 + 0.5) / 1e6
    for _, a, b, v, w in edges:
        for i in range(4):
            d = r6(w * 0.01 * (float(want[a][i]) + float(relation[v][i]) - float(want[b][i])))
            want[b][i] = r6(min(1, max(-1, r6(float(want[b][i]) + d))))
            want[a][i] = r6(min(1, max(-1, r6(float(want[a][i]) - d * 0.5))))
    e = spark.createDataFrame(edges, "log_seq long, source_id string, target_id string, verb_type string, weight double")
    n = spark.createDataFrame([(k, v.tolist()) for k, v in start.items()], "id string, embedding array<float>")
    got = {r.id: r.embedding for r in learning.train_embeddings(e, n, 42, 4).collect()}
    assert set(got) == set(start)
    for k in got:
        assert np.array_equal(np.float32(got[k]), want[k]), k
    near = {r.id: r.embedding for r in learning.train_embeddings_batch(e, n, 42, 4).collect()}
    assert set(near) == set(start) and np.abs(np.array(near["x"]) - np.array(got["x"])).max() < 1e-3


@pytest.mark.parametrize("start", ["ones", "zeros"])
def test_set_wise_memory_matches_the_fold(spark, start):
    rng = np.random.default_rng(3)
    rows = [(f"k{k % 4}", k, float(rng.choice([0.05, 0.1, 0.19, 0.2, 0.9], p=[0.4, 0.2, 0.2, 0.1, 0.1])), rng.choice([-1, 1], 6).tolist()) for k in range(60)]
    df = spark.createDataFrame(rows, "id string, ord long, weight double, experience array<tinyint>")
    first = [1] * 6 if start == "ones" else [0] * 6
    facts = df.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("ord", "experience", "weight"))).alias("x"))
    folded = facts.select("id", hdc.remember_all(F.lit(first).cast("array<tinyint>"), F.col("x")).alias("b"))
    assert {r.id: r.bundle for r in learning.remember_set(df, start).collect()} == {r.id: r.b for r in folded.collect()}


def test_vector_index(spark):
    index = nearest.create_index(spark, 2).upsert("a", [0.0, 0.0]).upsert("b", [1.0, 0.0]).upsert("c", [1.0, 0.0]).upsert("a", [1.0, 0.0])
    assert [r.id for r in index.query([1.0, 0.0], 3).collect()] == ["a", "b", "c"]  # ties by first insert
    assert [r.id for r in index.remove("a").upsert("a", [1.0, 0.0]).query([1.0, 0.0], 3).collect()] == ["b", "c", "a"]
    heads = spark.createDataFrame([("q", [0.5, 0.0], [0.5, 0.0])], "query_id string, head array<float>, relation array<float>")
    assert [r.id for r in nearest.query_index(heads, index.rows, 2).orderBy("rank").collect()] == ["a", "b"]


def test_diffusion(spark):
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 1.0), ("a", "a", 1.0), ("b", "b", 1.0), ("zz", "a", 5.0)], "source_id string, target_id string, weight double")
    ids = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    matrix = diffusion.trust_matrix(edges, ids)
    assert {(r.target, r.source): r.w for r in matrix.collect()} == {("a", "a"): 0.5, ("a", "b"): 0.5, ("b", "a"): 0.5, ("b", "b"): 0.5, ("c", "c"): 1.0}
    start = spark.createDataFrame([("a", 1.0), ("b", 0.0)], "id string, value double")
    assert {r.id: r.value for r in diffusion.degroot(start, matrix).collect()} == {"a": 0.5, "b": 0.5, "c": 0.0}
    held = spark.createDataFrame([("a", 1.0)], "id string, value double")
    got = {r.id: r.value for r in diffusion.friedkin_johnsen(start, start, held, matrix).collect()}
    assert got["a"] == 1.0 and 0.3 < got["b"] < 0.35 and got["c"] == 0.0


def test_beliefs_of_many(spark):
    rows = spark.createDataFrame([("p", 0, 0.6, 0.1, 0.3, "player"), ("p", 1, 0.3, 0.2, 0.5, "system"), ("q", 0, 1.0, 0.0, 0.0, "world"), ("q", 1, 0.0, 1.0, 0.0, "world")], "proposition string, ord long, t double, f double, u double, authority string")
    made = rows.withColumn("b", B.create(F.col("proposition"), F.col("t"), F.col("f"), F.col("u")))
    got = {r.proposition: r.m_true for r in beliefs.fold(made).collect()}
    assert got == {"p": 0.670588, "q": None}
    pairs = made.where("ord = 0").select("proposition", F.col("b").alias("a"), F.col("authority").alias("a_authority")).join(made.where("ord = 1").select("proposition", "b", F.col("authority").alias("b_authority")), "proposition")
    assert {r.proposition: r.result.m_true for r in beliefs.settle(pairs, "retain")[0].collect()} == {"p": 0.670588, "q": 1.0}
    assert {r.proposition: r.result.m_true for r in beliefs.settle(pairs, "blend")[0].collect()} == {"p": 0.670588, "q": 0.5}
    settled, out = beliefs.settle(pairs, "escalate")
    assert [r.proposition for r in settled.collect()] == ["p"] and out.first().conflict.conflict_k == 1.0
    assert {r.proposition: r.t for r in beliefs.best_by_authority(rows, "proposition").collect()} == {"p": 0.3, "q": 1.0}


def test_paths_and_rules(spark):
    edges = spark.createDataFrame([("a", "b", "v", 0.5), ("b", "c", "v", 0.5), ("c", "a", "v", 0.9), ("a", "c", "v", 0.1), ("c", "d", "v", 0.8), ("d", "e", "v", 0.002)], "source_id string, target_id string, verb_type string, weight double")
    starts = spark.createDataFrame([("a",)], "id string")
    got = {(r.target_id): (r.weight, r.hops) for r in traverse.paths(edges, starts, 3).collect()}
    assert got == {"b": (0.5, 1), "c": (0.25, 2), "d": (0.2, 3)}
    rules = [Rule("t", "w", (Condition("v"), Condition("x", True))), Rule("x", "x", (Condition("y"),))]
    facts = edges.union(spark.createDataFrame([("a", "b", "y", 1.0)], edges.schema))
    made = {(r.source_id, r.target_id) for r in traverse.fixpoint(facts, rules).where("verb_type = 'w' AND authority = 'inference'").collect()}
    assert ("a", "b") not in made and ("b", "c") in made
    with pytest.raises(ValueError):
        traverse.fixpoint(facts, [Rule("1", "p", (Condition("v"), Condition("q", True))), Rule("2", "q", (Condition("p"),))])
    assert traverse.route("cached", None, edges) is edges


def test_added_edges_teach(spark):
    """Embeddings, memories and versions after a batch of edges, against the same one by one."""
    names = ["a", "b", "c", "d", "x"]
    made = spark.createDataFrame([(k, n, "npc", None) for k, n in enumerate(names)], "ord long, id string, type string, properties map<string,string>")
    entities = graph.commit_create_entities(made, spark.createDataFrame([], graph.ENTITY), CONFIG, 0).rows
    rng = random.Random(3)
    rows = [(k, f"e{k}", *rng.sample(names[:4], 2), rng.choice(["likes", "near"]), round(rng.random(), 3)) for k in range(25)]
    commands = spark.createDataFrame(
        [(*r, None, None, None, None, None, None) for r in rows],
        "ord long, id string, source_id string, target_id string, verb_type string, weight double, t_norm string, authority string, confidence double, asserted_by string, properties map<string,string>, expires_at bigint",
    )
    verbs = spark.createDataFrame([("likes", False), ("near", True)], "id string, symmetric boolean")
    done = graph.commit_add_edges(commands, entities, spark.createDataFrame([], graph.EDGE), verbs, CONFIG, 5, seed=7)
    got = {r["id"]: r for r in done.entities.collect()}
    state = {n: [np.zeros(4, np.float32), 0, np.ones(8, int), 0] for n in names}
    tokens = sorted({t for r in rows for t in r[2:5]})
    frame = spark.createDataFrame([(t,) for t in tokens], "t string")
    base = {r["t"]: np.array(r["v"], int) for r in frame.select("t", hdc.base_vector(F.col("t"), 7, 8).alias("v")).collect()}
    relation = dict(zip(tokens, hdc.relation_floats(tokens, 7, 4)))
    r6 = lambda x: np.floor(x * 1e6 + 0.5) / 1e6
    for _, _, source, target, verb, weight in rows:
        head, tail = state[source], state[target]
        delta = r6(weight * learning.LEARNING_RATE * (head[0].astype(float) + relation[verb] - tail[0]))
        tail[0] = r6(np.clip(r6(tail[0] + delta), -1, 1)).astype(np.float32)
        head[0] = r6(np.clip(r6(head[0] - delta * 0.5), -1, 1)).astype(np.float32)
        times = max(1, int(weight * hdc.SCALE))
        head[2] = np.where(head[2] + times * base[source] * base[verb] * base[target] >= 0, 1, -1)
        for one in (head, tail):
            one[1] += 1
            one[3] += 2 if verb == "near" else 1
    for n in names:
        assert np.allclose(got[n]["embedding"], state[n][0], atol=2e-6), n
        assert got[n]["embedding_ver"] == state[n][1] and got[n]["version"] == state[n][3]
        assert list(got[n]["memory_bundle"]) == state[n][2].tolist()


def test_null_and_absent_differ_in_updates(spark):
    """A cleared expiry is null in the rows and in the event, a field not named stays."""
    edge = {"id": "e", "source_id": "a", "target_id": "b", "verb_type": "v", "weight": 0.5, "authority": "player", "confidence": 1.0, "expires_at": 9}
    events = log(spark, [event(0, "edge:add", **edge), event(1, "edge:add", **(edge | {"id": "f"}))])
    edges = temporal.edges_at(events)
    schema = "ord long, id string, weight double, confidence double, properties map<string,string>, expires_at bigint, cleared array<string>"
    done = graph.commit_update_edges(spark.createDataFrame([(0, "e", None, None, None, None, ["expires_at"]), (1, "f", 0.25, None, None, None, None)], schema), edges, CONFIG, 2)
    want = {"e": (0.5, None), "f": (0.25, 9)}
    assert {r["id"]: (r["weight"], r["expires_at"]) for r in done.rows.collect()} == want
    deltas = {json.loads(r["payload"])["id"]: json.loads(r["payload"])["delta"] for r in done.events.collect()}
    assert deltas == {"e": {"expires_at": None}, "f": {"weight": 0.25}}
    assert {r["id"]: (r["weight"], r["expires_at"]) for r in temporal.edges_at(events.unionByName(done.events)).collect()} == want
    both = graph.commit_update_edges(spark.createDataFrame([(0, "e", 0.75, None, None, None, ["expires_at"])], schema), edges, CONFIG, 2)
    assert json.loads(both.events.first()["payload"])["delta"] == {"weight": 0.75, "expires_at": None}


def test_rules_that_do_not_finish_raise(spark):
    edges = spark.createDataFrame([("a", "b", "v0", 1.0)], "source_id string, target_id string, verb_type string, weight double")
    rules = [Rule(f"r{k}", f"v{k + 1}", (Condition(f"v{k}"),)) for k in range(5)]
    assert traverse.fixpoint(edges, rules).count() == 6
    with pytest.raises(RuntimeError):
        traverse.fixpoint(edges, rules, max_rounds=2)


def test_paths_over_circles(spark):
    """The strongest simple path of each pair, against all simple paths."""
    rng = random.Random(5)
    nodes = [f"n{k}" for k in range(7)]
    links = {(a, b): round(rng.uniform(0.3, 1), 3) for a in nodes for b in nodes if a != b and rng.random() < 0.5} | {("n0", "n0"): 1.0}
    best = {}

    def walk(path, weight):
        if len(path) > 1:
            key, value = (path[0], path[-1]), (weight, -(len(path) - 1))
            best[key] = max(best.get(key, (0, 0)), value)
        if len(path) <= 4:
            for (a, b), w in links.items():
                if a == path[-1] and b not in path:
                    folded = w if len(path) == 1 else min(weight, w)
                    walk([*path, b], folded)

    for n in nodes:
        walk([n], 1.0)
    edges = spark.createDataFrame([(a, b, w) for (a, b), w in links.items()], "source_id string, target_id string, weight double")
    got = traverse.paths(edges, spark.createDataFrame([(n,) for n in nodes], "id string"), 4, "minimum").collect()
    assert {(r["source_id"], r["target_id"]): (r["weight"], -r["hops"]) for r in got} == best
