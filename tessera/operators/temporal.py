"""State at any log position, from a log of events and, if there is one, a checkpoint.

One pass: per key the last birth at or before T, no removal after it, and per column the
last update after it.  Events apply in the order of seq.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import EDGE, ENTITY, GraphConfig

_BIRTH = "id string, type string, properties map<string,string>"
_EDGE = (
    "id string, sourceId string, source_id string, targetId string, target_id string, verbType string, verb_type string, weight double, tNorm string, t_norm string, "
    "authority string, confidence double, assertedBy string, asserted_by string, properties map<string,string>, expiresAt bigint, expires_at bigint"
)
_DELTA = "id string, delta map<string,string>"


def _upto(events: DataFrame, at: int | None, after: int | None) -> DataFrame:
    if after is not None:
        events = events.where(F.col("seq") > after)
    return events if at is None else events.where(F.col("seq") <= at)


def _either(p: str, snake: str, camel: str):
    return F.coalesce(F.col(f"{p}.{snake}"), F.col(f"{p}.{camel}"))


def edges_at(events: DataFrame, at: int | None = None, checkpoint: DataFrame | None = None, after: int | None = None) -> DataFrame:
    """Edges after the events up to `at` (all if none), as EDGE.

    `checkpoint` holds the edges at position `after`; only later events are read then.
    Updates of an edge that isn't there are ignored; a new birth resets it; a field set
    to null is null.
    """
    rows = _upto(events, at, after)
    born = rows.where(F.col("type").isin("edge:add", "edge:infer")).select("seq", "graph_id", F.from_json("payload", _EDGE).alias("p"))
    births = born.select(
        F.col("p.id").alias("id"), _either("p", "source_id", "sourceId").alias("source_id"), _either("p", "target_id", "targetId").alias("target_id"),
        _either("p", "verb_type", "verbType").alias("verb_type"), F.col("p.weight").alias("weight"), _either("p", "t_norm", "tNorm").alias("t_norm"),
        F.col("p.authority").alias("authority"), F.col("p.confidence").alias("confidence"), _either("p", "asserted_by", "assertedBy").alias("asserted_by"),
        F.coalesce(F.col("p.properties"), F.create_map().cast("map<string,string>")).alias("properties"),
        _either("p", "expires_at", "expiresAt").alias("expires_at"), "graph_id", F.col("seq").alias("log_seq"), "seq",
    )
    if checkpoint is not None:
        births = births.unionByName(checkpoint.withColumn("seq", F.lit(-1 if after is None else after).cast("long")))
    columns = [c.split()[0] for c in EDGE.split(", ")]
    changed = rows.where("type = 'edge:update'").select(
        F.get_json_object("payload", "$.id").alias("id"), "seq", F.from_json(F.get_json_object("payload", "$.delta"), "map<string,string>").alias("delta")
    )
    removed = rows.where("type = 'edge:remove'").select(F.get_json_object("payload", "$.id").alias("id"), "seq")
    # one shuffle: births, updates and removals of an edge meet in one group
    blank = {"born": "struct<" + ",".join(f"{c.split()[0]}:{c.split(' ', 1)[1]}" for c in EDGE.split(", ")) + ">", "delta": "map<string,string>"}
    facts = (
        births.select("id", "seq", F.lit("b").alias("kind"), F.struct(*columns).cast(blank["born"]).alias("born"), F.lit(None).cast(blank["delta"]).alias("delta"))
        .unionByName(changed.select("id", "seq", F.lit("u").alias("kind"), F.lit(None).cast(blank["born"]).alias("born"), "delta"))
        .unionByName(removed.select("id", "seq", F.lit("r").alias("kind"), F.lit(None).cast(blank["born"]).alias("born"), F.lit(None).cast(blank["delta"]).alias("delta")))
    )

    def last(field: str, *names: str):
        """Seq and value of the last update that names the field; a JSON null is a null value."""
        has = F.lit(False)
        for n in names:
            has = has | F.map_contains_key("delta", F.lit(n))
        hit = (F.col("kind") == "u") & F.coalesce(has, F.lit(False))
        value = F.coalesce(*[F.col("delta")[n] for n in names])
        return F.max(F.when(hit, F.struct("seq", value.alias("v")))).alias(f"_{field}")

    merged = facts.groupBy("id").agg(
        F.max_by(F.col("born"), F.when(F.col("kind") == "b", F.col("seq"))).alias("born"),
        F.max(F.when(F.col("kind") == "b", F.col("seq"))).alias("birth"),
        F.max(F.when(F.col("kind") == "r", F.col("seq"))).alias("death"),
        last("weight", "weight"), last("confidence", "confidence"), last("properties", "properties"), last("expires_at", "expires_at", "expiresAt"),
    )
    living = merged.where(F.col("birth").isNotNull() & (F.col("death").isNull() | (F.col("death") < F.col("birth"))))

    def current(field: str):
        u, kind = F.col(f"_{field}"), {"weight": "double", "confidence": "double", "expires_at": "bigint"}.get(field)
        value = u["v"].cast(kind) if kind else F.from_json(u["v"], "map<string,string>")
        return F.when(u.isNotNull() & (u["seq"] > F.col("birth")), value).otherwise(F.col(f"born.{field}")).alias(field)

    return living.select(*[current(c) if c in ("weight", "confidence", "properties", "expires_at") else F.col(f"born.{c}").alias(c) for c in columns])


def entities_at(
    events: DataFrame, config: GraphConfig, at: int | None = None, checkpoint: DataFrame | None = None, after: int | None = None
) -> DataFrame:
    """Entities after the events up to `at`, as ENTITY.

    A creation resets the entity; embedding and memory events are applied as logged
    and count for existing entities only.  Versions are not replayed.
    """
    from ..functions.codec import decode_floats, decode_signs

    rows = _upto(events, at, after)
    born = rows.where("type = 'entity:create'").select("seq", "graph_id", F.from_json("payload", _BIRTH).alias("p"))
    bundle = F.array_repeat(F.lit(1), config.hdc_dim) if config.hdc_dim else F.lit(None)
    births = born.select(
        F.col("p.id").alias("id"), "graph_id", F.col("p.type").alias("type"),
        F.coalesce(F.col("p.properties"), F.create_map().cast("map<string,string>")).alias("properties"),
        F.array_repeat(F.lit(0.0), config.embedding_dim).cast("array<float>").alias("embedding"), F.lit(0).cast("long").alias("embedding_ver"),
        bundle.cast("array<tinyint>").alias("memory_bundle"), F.col("seq").alias("log_seq"), F.lit(0).cast("long").alias("version"), "seq",
    )
    if checkpoint is not None:
        births = births.unionByName(checkpoint.withColumn("seq", F.lit(-1 if after is None else after).cast("long")))
    columns = [c.split()[0] for c in ENTITY.split(", ")]
    newest = births.groupBy("id").agg(F.max_by(F.struct(*columns), "seq").alias("born"), F.max("seq").alias("birth"))
    removed = rows.where("type = 'entity:remove'").groupBy(F.get_json_object("payload", "$.id").alias("id")).agg(F.max("seq").alias("death"))
    living = newest.join(removed, "id", "left").where(F.col("death").isNull() | (F.col("death") < F.col("birth")))
    entity = F.coalesce(F.get_json_object("payload", "$.entity_id"), F.get_json_object("payload", "$.entityId"))
    vectors = rows.where("type = 'embedding:update'").select(entity.alias("id"), "seq", F.get_json_object("payload", "$.embedding").alias("v"))
    bundle_json = F.coalesce(F.get_json_object("payload", "$.memory_bundle"), F.get_json_object("payload", "$.memoryBundle"))
    bundles = rows.where("type = 'hdc:update'").select(entity.alias("id"), "seq", bundle_json.alias("v"))
    keys = living.select("id", "birth")
    moved = vectors.join(keys, "id").where("seq > birth").groupBy("id").agg(F.max_by("v", "seq").alias("_e"), F.count(F.lit(1)).alias("_n"))
    learnt = bundles.join(keys, "id").where("seq > birth").groupBy("id").agg(F.max_by("v", "seq").alias("_m"))
    state = living.join(moved, "id", "left").join(learnt, "id", "left")
    value = {
        "embedding": F.coalesce(decode_floats(F.col("_e")), F.col("born.embedding")),
        "embedding_ver": F.col("born.embedding_ver") + F.coalesce("_n", F.lit(0)),
        "memory_bundle": F.coalesce(decode_signs(F.col("_m")), F.col("born.memory_bundle")),
    }
    return state.select(*[value.get(c, F.col(f"born.{c}")).alias(c) for c in columns])


def replay_summary(events: DataFrame, at: int | None = None, after: int | None = None, rng_state: str = "") -> DataFrame:
    """(final_seq, events_replayed, rng_state); the state is the checkpoint's."""
    rows = _upto(events, at, after)
    return rows.agg(
        F.coalesce(F.max("seq"), F.lit(after or 0).cast("long")).alias("final_seq"), F.count(F.lit(1)).alias("events_replayed"), F.lit(rng_state).alias("rng_state")
    )


def versions(events: DataFrame, edges_ever: DataFrame) -> DataFrame:
    """(id, version): how often an edge of the entity was written, changed or removed.

    edges_ever (id, source_id, target_id): ends of every edge that ever was.
    """
    touched = events.where(F.col("type").isin("edge:add", "edge:infer", "edge:update", "edge:remove"))
    edge = touched.select(F.get_json_object("payload", "$.id").alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    ends = edge.join(edges_ever, "id").select(F.explode(F.array("source_id", "target_id")).alias("id"), "n")
    return ends.groupBy("id").agg(F.sum("n").alias("version"))
