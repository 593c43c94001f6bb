from __future__ import annotations

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.operators import graph, projection, temporal
from tessera.plans import harness, pool
from tessera.plans.lineage import numbered
from tessera.sources import checkpoint, eventlog
from tessera.streaming import delivery, state


def test_log(spark, tmp_path):
    path = eventlog.log_path(str(tmp_path), "g")
    assert path.endswith("/logs/g.ndjson") and eventlog.read(spark, path).count() == 0
    log = eventlog.EventLog(spark, path, "batched", 3)
    for k in range(4):
        log.append(k, "g", "entity:create", {"id": f"n{k}"}, "rng", k)
    assert log.buffered == 1 and log.total == 4 and log.read_all().count() == 3
    log.close()
    assert log.buffered == 0 and sorted(r.seq for r in log.read_from(2).collect()) == [2, 3]
    with pytest.raises(RuntimeError):
        log.append(9, "g", "entity:create", {})
    with pytest.raises(ValueError):
        eventlog.EventLog(spark, path, "?")
    now = eventlog.EventLog(spark, path, "immediate")
    now.append(9, "g", "entity:create", {"id": "x"})
    assert now.buffered == 0 and now.read_all().count() == 5
    late = eventlog.EventLog(spark, path, "none", write=lambda df, p: 1 / 0)
    late.append(10, "g", "entity:create", {"id": "y"})
    with pytest.raises(ZeroDivisionError):
        late.flush()
    assert late.buffered == 1  # a failed write loses nothing
    eventlog.to_parquet(now.read_all(), f"{tmp_path}/p")
    assert spark.read.parquet(f"{tmp_path}/p").where("seq >= 3").count() == 2


def test_checkpoint(spark, tmp_path):
    entities = spark.createDataFrame([("a", "g", "npc", {"k": "v"}, [0.5, -0.3], 1, [1, -1], 3, 2)], graph.ENTITY)
    edges = spark.createDataFrame([("e", "a", "a", "v", 0.5, None, "player", 1.0, None, {}, None, "g", 4)], graph.EDGE)
    folder = str(tmp_path)
    assert checkpoint.listed(spark, folder, "g") == [] and checkpoint.load(spark, folder, "g") is None
    checkpoint.save(folder, "g", 4, entities, edges, "rng4")
    checkpoint.save(folder, "g", 12, entities.limit(0), edges, "rng12")
    assert checkpoint.listed(spark, folder, "g") == [4, 12]
    last, first = checkpoint.load(spark, folder, "g"), checkpoint.load(spark, folder, "g", 11)
    assert (last.seq, last.rng_state, last.entities.count()) == (12, "rng12", 0) and first.seq == 4
    assert first.entities.collect() == entities.collect() and first.edges.collect() == edges.collect()
    events = spark.createDataFrame([(5, "g", "edge:update", json.dumps({"id": "e", "delta": {"weight": 0.9}}), "", 0)], eventlog.EVENT)
    assert temporal.edges_at(events, None, first.edges, first.seq).first().weight == 0.9
    edges.withColumn("weight", F.lit(0.6)).write.mode("overwrite").parquet(f"{folder}/checkpoints/g/{12:010d}/edges")
    with pytest.raises(checkpoint.ChecksumError):
        checkpoint.load(spark, folder, "g")


def test_numbered(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("x"))
    assert {r.x: r.seq for r in numbered(df, [F.col("x")], "seq", 5).collect()} == {k: k + 5 for k in range(1000)}


def test_harness(capsys):
    rows = harness.run([harness.Scenario("quick", 100, lambda s: s, iterations=10), harness.Scenario("never", -1, lambda s: s, lambda: 3, 5)])
    assert [r.passed for r in rows] == [True, False] and "1 of 2 passed" in capsys.readouterr().out
    assert harness.percentile([1, 2, 3, 4], 50) == 2 and harness.percentile([1.0], 99) == 1.0
    with pytest.raises(SystemExit):
        harness.run([harness.Scenario("never", -1, lambda s: s, iterations=1)], True, True)


def doubled(frame):
    return frame.assign(id=frame.id * 2)


def test_pool(spark):
    p = pool.WorkerPool(spark, 2)
    jobs = [p.submit(lambda n: spark.range(n).count(), k, priority="critical") for k in range(4)]
    failed = p.submit(lambda: 1 / 0)
    assert [j.result(60) for j in jobs] == [0, 1, 2, 3] and isinstance(failed.exception(60), ZeroDivisionError)
    assert p.submit("math:sqrt", 16).result(60) == 4.0
    with pytest.raises(ValueError):
        p.submit(print, priority="?")
    p.terminate()
    with pytest.raises(RuntimeError):
        p.submit(print)
    assert p.queue_depth >= 0
    counted = pool.run_on_rows(spark.range(5).repartition(2), "pandas", "DataFrame", "id long")
    assert sorted(r.id for r in counted.collect()) == [0, 1, 2, 3, 4]


def stream(spark, path, batches, schema):
    """A stream of one file a batch."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(f"{path}/{k}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").json(f"{path}/*")


def test_delivery_stream(spark, tmp_path):
    write = lambda g, o, p, at: (g, o, "write", p, at, 0.9, None)
    tick = lambda g, o, t: (g, o, "tick", None, None, None, t)
    rows = [write("g", 0, "late", 30), write("g", 1, "b", 10), write("g", 2, "a", 5), write("g", 3, "b2", 10), tick("g", 4, 10), write("h", 5, "x", 1), tick("g", 6, 29), tick("g", 7, 30)]
    source = stream(spark, f"{tmp_path}/in", [rows], delivery.INPUT)
    q = delivery.deliver(source).writeStream.format("memory").queryName("delivered").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c").start()
    q.awaitTermination()
    got = [(r.payload, r.delivered_at, r.fidelity) for r in spark.table("delivered").collect()]
    assert got == [("a", 10, 0.9), ("b", 10, 0.9), ("b2", 10, 0.9), ("late", 30, 0.9)]


def test_delivery_in_chunks():
    """Many writes of one graph take few steps on the state, and come in the order of due tick, then arrival."""
    held, steps = {}, []

    class Entries:
        def keys(self):
            return list(held)

        def containsKey(self, key):  # noqa: N802
            return key in held

        def getValue(self, key):  # noqa: N802
            steps.append(key)
            return held[key]

        def updateValue(self, key, value):  # noqa: N802
            steps.append(key)
            held[key] = value

        def removeKey(self, key):  # noqa: N802
            del held[key]

    class Number:
        value = None

        def exists(self):
            return self.value is not None

        def get(self):
            return self.value

        def update(self, value):
            self.value = value

    class Handle:
        getMapState = lambda self, *a: Entries()  # noqa: E731, N815
        getValueState = lambda self, *a: Number()  # noqa: E731, N815

    work = delivery.Delivery()
    work.init(Handle())
    names = [f.split(" ")[0] for f in delivery.INPUT.split(", ")]
    rows = [("g", o, "write", str(o), o * 7 % 90, 1.0, None) for o in range(20_000)]
    ticks = [("g", 10_000 - 1, "tick", None, None, None, 30), ("g", 30_000, "tick", None, None, None, 60), ("g", 30_001, "tick", None, None, None, 200)]
    got = []
    for batch in (rows[:10_000:2], rows[1:10_000:2] + ticks[:1], rows[10_000:][::-1] + ticks[1:]):
        frames = [pd.DataFrame(batch[k : k + 3000], columns=names) for k in range(0, len(batch), 3000)]
        got += [tuple(r) for f in work.handleInputRows(("g",), iter(frames), None) for r in f[["payload", "deliver_at", "delivered_at"]].itertuples(index=False)]
    want, rest = [], []
    arrived = [*rows[:10_000:2], *rows[1:10_000:2]]
    for tick, more in ((30, arrived), (60, rows[10_000:]), (200, [])):
        rest += more
        want += [(w[3], w[4], tick) for w in sorted(rest, key=lambda w: w[4]) if w[4] <= tick]
        rest = [w for w in rest if w[4] > tick]
    assert got == want and len(got) == 20_000 and not held
    assert len(steps) < 100


def test_state_streams(spark, tmp_path):
    r = projection.ComponentRegistry()
    r.register(projection.Component("Score", ("ally",), 0, lambda keys: keys.selectExpr("graph_id", "entity_id", "1.0 AS value")))
    change = "graph_id string, verb_type string, source_id string, target_id string"
    batches = [[("g", "ally", "a", "b")], [("g", "ally", "b", "c"), ("g", "other", "x", "y")]]
    key = "graph_id string, entity_id string, component string"
    dirty = state.Versions(spark, f"{tmp_path}/dirty", key)
    state.track_dirty(stream(spark, f"{tmp_path}/s1", batches, change), r.manifest(spark), dirty, f"{tmp_path}/c1").awaitTermination()
    assert {x.entity_id for x in dirty.read().collect()} == {"a", "b", "c"}

    cache, left = state.Versions(spark, f"{tmp_path}/cache", f"{key}, value double, derived_at_ms long"), state.Versions(spark, f"{tmp_path}/left", key)
    state.refresh_projections(spark.readStream.schema(change).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/s1/*"), r, cache, left, f"{tmp_path}/c2", lambda n: n * 100).awaitTermination()
    assert {x.entity_id for x in cache.read().collect()} == {"a", "b", "c"} and left.read().count() == 0

    updates = "ord long, op string, id string, embedding array<float>"
    index = state.Versions(spark, f"{tmp_path}/index", "id string, embedding array<float>, ordinal long")
    source = stream(spark, f"{tmp_path}/s3", [[(0, "add", "a", [1.0]), (1, "add", "b", [2.0])], [(2, "remove", "a", None), (3, "update", "b", [3.0])]], updates)
    state.track_vectors(source, index, f"{tmp_path}/c3").awaitTermination()
    assert [(x.id, x.embedding) for x in index.read().collect()] == [("b", [3.0])]

    edge = lambda s, k, **p: (s, "g", k, json.dumps(p), "", 0)
    events = [[edge(0, "edge:add", id="e", weight=0.1), edge(1, "edge:update", id="e", delta={"weight": 0.2})], [edge(2, "edge:add", id="e", weight=0.3), edge(3, "edge:update", id="e", delta={"weight": 0.4})]]
    kept = state.Versions(spark, f"{tmp_path}/edges", eventlog.EVENT)
    state.track_edges(stream(spark, f"{tmp_path}/s4", events, eventlog.EVENT), kept, f"{tmp_path}/c4").awaitTermination()
    assert sorted(x.seq for x in kept.read().collect()) == [2, 3] and temporal.edges_at(kept.read()).first().weight == 0.4

    out = f"{tmp_path}/log"
    state.log_events(spark.readStream.schema(eventlog.EVENT).json(f"{tmp_path}/s4/*"), out, f"{tmp_path}/c5").awaitTermination()
    assert eventlog.read(spark, out, 2).count() == 2
