"""The graph as two tables: entities and edges, their lookups, checks and writes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.num import clamp, r6
from ..plans.lineage import numbered
from .learning import learn

ENTITY = (
    "id string, graph_id string, type string, properties map<string,string>, embedding array<float>, "
    "embedding_ver bigint, memory_bundle array<tinyint>, log_seq bigint, version bigint"
)
EDGE = (
    "id string, source_id string, target_id string, verb_type string, weight double, t_norm string, authority string, "
    "confidence double, asserted_by string, properties map<string,string>, expires_at bigint, graph_id string, log_seq bigint"
)
#: What an event of the log may be.
EVENT_TYPES = ("entity:create", "entity:remove", "edge:add", "edge:update", "edge:remove", "edge:infer", "embedding:update", "hdc:update")


@dataclass(frozen=True)
class GraphConfig:
    """Settings of one graph."""

    id: str
    label: str = ""
    mutable: bool = True
    temporal_index: bool = True
    persistence_mode: str = "full"
    embedding_dim: int = 64
    hdc_dim: int | None = 1024
    default_t_norm: str = "product"
    epsilon: float = 0.001


# -- lookups ---------------------------------------------------------------------------


def get(rows: DataFrame, key: str, column: str = "id") -> DataFrame:
    """The row of a key, or none."""
    return rows.where(F.col(column) == key)


def present(keys: DataFrame, rows: DataFrame, column: str = "id") -> DataFrame:
    """Of `keys`, those that have a row."""
    return keys.join(rows.select(column), column, "left_semi")


def put(rows: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """`rows` with those of `new` added or in place of theirs; `new` has one row for a key."""
    return rows.join(new.select(key), key, "left_anti").unionByName(new)


def remove(rows: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    """`rows` without those of the keys; edges of a removed entity stay."""
    return rows.join(keys.select(key), key, "left_anti")


def counts(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """(entity_count, edge_count)."""
    n = entities.agg(F.count(F.lit(1)).alias("entity_count"))
    return n.crossJoin(edges.agg(F.count(F.lit(1)).alias("edge_count")))  # one row by one row


def edges_from(edges: DataFrame, source: str) -> DataFrame:
    return edges.where(F.col("source_id") == source)


def edges_to(edges: DataFrame, target: str) -> DataFrame:
    return edges.where(F.col("target_id") == target)


def edges_by_verb(edges: DataFrame, verb: str) -> DataFrame:
    """Edges of exactly this verb; `ontology.with_subtypes` widens it."""
    return edges.where(F.col("verb_type") == verb)


def edges_between(edges: DataFrame, source: str, target: str, verb: str | None = None) -> DataFrame:
    """Edges of a pair, of one verb if one is given (an empty one is none)."""
    found = edges.where((F.col("source_id") == source) & (F.col("target_id") == target))
    return edges_by_verb(found, verb) if verb else found


def alive(edges: DataFrame, at: int) -> DataFrame:
    """Edges that have not expired at log position `at`."""
    return edges.where(F.col("expires_at").isNull() | (F.col("expires_at") > at))


# -- checks: each command gets `errors`, empty if it is valid --------------------------


def _errors(*checks: tuple[Column, str]) -> Column:
    return F.filter(F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(name)) for bad, name in checks]), lambda x: x.isNotNull())


def _blank(c: str) -> Column:
    return F.coalesce(F.trim(F.col(c)), F.lit("")) == ""


def _off_range(c: str) -> Column:
    """Outside [0, 1], or not finite."""
    return F.isnan(c) | (F.col(c) < 0) | (F.col(c) > 1)


def _known(commands: DataFrame, rows: DataFrame, key: str, flag: str, column: str = "id") -> DataFrame:
    """`commands` with `flag`: does the key have a row?"""
    own = rows.select(F.col(column).alias("_key")).distinct().withColumn(flag, F.lit(True))
    joined = commands.join(own, F.col(key) == F.col("_key"), "left").drop("_key")
    return joined.withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))


def _first(commands: DataFrame, order: str) -> DataFrame:
    """`commands` with `_again`: does an earlier one have the same id?"""
    return commands.withColumn("_again", F.row_number().over(Window.partitionBy("id").orderBy(order)) > 1)


def check_create_entities(commands: DataFrame, entities: DataFrame, order: str = "ord") -> DataFrame:
    """commands (ord, id, type, ...): id and type not blank, id new to the table and the batch."""
    known = _first(_known(commands, entities, "id", "_known"), order)
    errors = _errors((_blank("id"), "id:blank"), (F.col("_known") | F.col("_again"), "id:duplicate"), (_blank("type"), "type:blank"))
    return known.withColumn("errors", errors).drop("_known", "_again")


def check_add_edges(commands: DataFrame, entities: DataFrame, edges: DataFrame, verbs: DataFrame, order: str = "ord") -> DataFrame:
    """commands (ord, id, source_id, target_id, verb_type, weight, confidence): all rules, a null confidence counts as 1."""
    known = _first(_known(commands, edges, "id", "_known"), order)
    known = _known(_known(known, entities, "source_id", "_source"), entities, "target_id", "_target")
    known = _known(known, verbs, "verb_type", "_verb").withColumn("_confidence", F.coalesce(F.col("confidence"), F.lit(1.0)))
    errors = _errors(
        (_blank("id"), "id:blank"),
        (F.col("_known") | F.col("_again"), "id:duplicate"),
        (~F.col("_source"), "source:missing"),
        (~F.col("_target"), "target:missing"),
        (~F.col("_verb"), "verb:unregistered"),
        (_off_range("weight"), "weight:range"),
        (_off_range("_confidence"), "confidence:range"),
    )
    return known.withColumn("errors", errors).drop("_known", "_again", "_source", "_target", "_verb", "_confidence")


def check_update_edges(commands: DataFrame, edges: DataFrame) -> DataFrame:
    """commands (id, weight, confidence, ...): the edge is there and isn't inferred; null fields are not changed."""
    own = edges.select(F.col("id").alias("_id"), F.col("authority").alias("_authority"))
    known = commands.join(own, F.col("id") == F.col("_id"), "left")
    found = _errors(
        (F.col("_authority") == "inference", "edge:inferred"),
        (F.col("weight").isNotNull() & _off_range("weight"), "weight:range"),
        (F.col("confidence").isNotNull() & _off_range("confidence"), "confidence:range"),
    )
    errors = F.when(F.col("_id").isNull(), F.array(F.lit("edge:missing"))).otherwise(found)
    return known.withColumn("errors", errors).drop("_id", "_authority")


def degrees(edges: DataFrame) -> DataFrame:
    """(id, incoming, outgoing) of entities with an edge."""
    ends = F.inline(
        F.array(
            F.struct(F.col("source_id").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")),
            F.struct(F.col("target_id").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")),
        )
    )
    return edges.select(ends).groupBy("id").agg(F.sum("i").alias("incoming"), F.sum("o").alias("outgoing"))


def check_remove_entities(keys: DataFrame, entities: DataFrame, edges: DataFrame) -> DataFrame:
    """keys (id): there and without edges; also gives incoming and outgoing."""
    known = _known(keys, entities, "id", "_known").join(degrees(edges), "id", "left").fillna(0, ["incoming", "outgoing"])
    errors = F.when(~F.col("_known"), F.array(F.lit("entity:missing"))).otherwise(
        _errors((F.col("incoming") + F.col("outgoing") > 0, "entity:has edges"))
    )
    return known.withColumn("errors", errors).drop("_known")


def check_domain_range(edges: DataFrame, entities: DataFrame, verbs: DataFrame) -> DataFrame:
    """Edges whose ends have a type their verb's domain or range doesn't list (empty lists allow all)."""
    kinds = entities.select("id", "type")
    source = kinds.select(F.col("id").alias("source_id"), F.col("type").alias("source_type"))
    target = kinds.select(F.col("id").alias("target_id"), F.col("type").alias("target_type"))
    rules = verbs.select(F.col("id").alias("verb_type"), "domain", "range")
    off = lambda kind, listed: (F.size(listed) > 0) & ~F.array_contains(listed, F.col(kind))
    joined = edges.join(rules, "verb_type").join(source, "source_id").join(target, "target_id")
    return joined.where(off("source_type", F.col("domain")) | off("target_type", F.col("range")))


# -- writes: valid commands become events and new rows ----------------------------------


@dataclass
class Commit:
    """What a batch of commands does: refused commands with errors, events, new rows, bumps by entity, entities afterwards."""

    refused: DataFrame
    events: DataFrame
    rows: DataFrame
    bumps: DataFrame | None = None
    entities: DataFrame | None = None


def _event(kind: Column, payload: Column, config: GraphConfig, at: Column, rng: str) -> list[Column]:
    return [
        F.col("seq"), F.lit(config.id).alias("graph_id"), kind.alias("type"), payload.alias("payload"),
        F.lit(rng).alias("rng_state"), at.cast("long").alias("wall_ms"),
    ]


def commit_create_entities(commands: DataFrame, entities: DataFrame, config: GraphConfig, next_seq: int, wall_ms: int = 0, rng: str = "") -> Commit:
    """New entities have a zero embedding and a bundle of +1."""
    checked = check_create_entities(commands, entities)
    valid = numbered(checked.where(F.size("errors") == 0).drop("errors"), [F.col("ord")], "seq", next_seq)
    bag = F.coalesce(F.col("properties"), F.create_map().cast("map<string,string>"))
    bundle = F.array_repeat(F.lit(1), config.hdc_dim) if config.hdc_dim else F.lit(None)
    rows = valid.select(
        "id", F.lit(config.id).alias("graph_id"), "type", bag.alias("properties"),
        F.array_repeat(F.lit(0.0), config.embedding_dim).cast("array<float>").alias("embedding"), F.lit(0).cast("long").alias("embedding_ver"),
        bundle.cast("array<tinyint>").alias("memory_bundle"), F.col("seq").alias("log_seq"), F.lit(0).cast("long").alias("version"),
    )
    payload = F.to_json(F.struct("id", "type", bag.alias("properties")))
    events = valid.select(*_event(F.lit("entity:create"), payload, config, F.lit(wall_ms), rng))
    return Commit(checked.where(F.size("errors") > 0), events, rows)


def commit_remove_entities(commands: DataFrame, entities: DataFrame, edges: DataFrame, config: GraphConfig, next_seq: int, wall_ms: int = 0, rng: str = "") -> Commit:
    """commands (ord, id); rows: the entities that are left."""
    checked = check_remove_entities(commands, entities, edges)
    valid = numbered(checked.where(F.size("errors") == 0).select("ord", "id"), [F.col("ord")], "seq", next_seq)
    events = valid.select(*_event(F.lit("entity:remove"), F.to_json(F.struct("id")), config, F.lit(wall_ms), rng))
    return Commit(checked.where(F.size("errors") > 0), events, remove(entities, valid))


def bumps_of(edges: DataFrame) -> DataFrame:
    """(id, bumps): an edge written or removed bumps the versions of both its ends."""
    return edges.select(F.explode(F.array("source_id", "target_id")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("bumps"))


def bump_versions(entities: DataFrame, bumps: DataFrame) -> DataFrame:
    """`entities` with their versions raised."""
    raised = entities.join(bumps, "id", "left").withColumn("version", F.col("version") + F.coalesce("bumps", F.lit(0)))
    return raised.select(*entities.columns)


def symmetric_twins(edges: DataFrame, verbs: DataFrame, existing: DataFrame) -> DataFrame:
    """The reverse edges that symmetric verbs assert: id `:sym`, authority inference, confidence times 0.99.

    A twin that exists already is not asserted again.
    """
    reverse = edges.join(verbs.where("symmetric").select(F.col("id").alias("verb_type")), "verb_type", "left_semi")
    made = reverse.select(
        *[
            {
                "id": F.concat("id", F.lit(":sym")).alias("id"),
                "source_id": F.col("target_id").alias("source_id"),
                "target_id": F.col("source_id").alias("target_id"),
                "authority": F.lit("inference").alias("authority"),
                "confidence": r6(F.col("confidence") * 0.99).alias("confidence"),
            }.get(c, F.col(c))
            for c in edges.columns
        ]
    )
    return made.join(existing.select("id"), "id", "left_anti").select(*edges.columns)


def commit_add_edges(
    commands: DataFrame, entities: DataFrame, edges: DataFrame, verbs: DataFrame, config: GraphConfig, next_seq: int, wall_ms: int = 0, rng: str = "", seed: int = 0
) -> Commit:
    """Edges and the twins of symmetric verbs, each with its own log position, and bumps of their ends.

    Where `entities` are whole rows (ENTITY), they come back as the edges leave them:
    embeddings moved and memories added to in log order by edges (twins teach nothing),
    `embedding_ver` raised by the steps and `version` by the bumps.
    """
    checked = check_add_edges(commands, entities, edges, verbs)
    bag = F.coalesce(F.col("properties"), F.create_map().cast("map<string,string>"))
    plain = checked.where(F.size("errors") == 0).select(
        "ord", "id", "source_id", "target_id", "verb_type", clamp(F.col("weight")).alias("weight"), "t_norm",
        F.coalesce("authority", F.lit("player")).alias("authority"), clamp(F.coalesce("confidence", F.lit(1.0))).alias("confidence"),
        "asserted_by", bag.alias("properties"), "expires_at", F.lit(config.id).alias("graph_id"), F.col("id").alias("derived_from"),
    )
    both = plain.withColumn("_twin", F.lit(0)).unionByName(symmetric_twins(plain, verbs, edges).withColumn("_twin", F.lit(1)))
    placed = numbered(both, [F.col("ord"), F.col("_twin")], "seq", next_seq)
    rows = placed.select(*[c.split()[0] for c in EDGE.split(", ") if not c.startswith("log_seq")], F.col("seq").alias("log_seq"))
    fields = [c for c in rows.columns if c != "log_seq"]
    payload = F.to_json(F.struct(*fields, F.when(F.col("_twin") == 1, F.array("derived_from")).alias("derived_from")))
    kind = F.when(F.col("_twin") == 1, "edge:infer").otherwise("edge:add")
    after = None
    if {"embedding", "embedding_ver", "memory_bundle", "version"} <= set(entities.columns):
        after = bump_versions(learn(placed.where("_twin = 0").withColumn("log_seq", F.col("seq")), entities, config.embedding_dim, config.hdc_dim, seed), bumps_of(rows))
    return Commit(checked.where(F.size("errors") > 0), placed.select(*_event(kind, payload, config, F.lit(wall_ms), rng)), rows, bumps_of(rows), after)


def commit_update_edges(commands: DataFrame, edges: DataFrame, config: GraphConfig, next_seq: int, wall_ms: int = 0, rng: str = "") -> Commit:
    """commands (ord, id, weight, confidence, properties, expires_at, cleared): null leaves a field; the last command of a field counts.

    `cleared`, which may be absent, names fields that are set to null; it holds for
    expires_at, the only field that may be.  rows: the edges as they are afterwards;
    log_seq and embeddings stay.
    """
    if "cleared" not in commands.columns:
        commands = commands.withColumn("cleared", F.lit(None).cast("array<string>"))
    checked = check_update_edges(commands, edges)
    valid = numbered(checked.where(F.size("errors") == 0).drop("errors"), [F.col("ord")], "seq", next_seq)
    wiped = F.coalesce(F.array_contains("cleared", "expires_at"), F.lit(False)) & F.col("expires_at").isNull()
    delta = F.struct(clamp(F.col("weight")).alias("weight"), clamp(F.col("confidence")).alias("confidence"), "properties", "expires_at")
    plain = F.to_json(F.struct("id", delta.alias("delta")))
    # to_json leaves nulls out, and this one is meant
    with_null = F.regexp_replace(F.regexp_replace(plain, r'\}\}$', ',"expires_at":null}}'), r'\{,"expires_at":null', '{"expires_at":null')
    events = valid.select(*_event(F.lit("edge:update"), F.when(wiped, with_null).otherwise(plain), config, F.lit(wall_ms), rng))
    fields = ("weight", "confidence", "properties", "expires_at")
    said = {f: F.col(f).isNotNull() | (wiped if f == "expires_at" else F.lit(False)) for f in fields}
    newest = valid.groupBy("id").agg(
        *[F.max_by(F.struct(F.col(f).alias("v")), F.when(said[f], F.col("seq"))).alias(f"_{f}") for f in fields], F.count(F.lit(1)).alias("_n")
    )
    new = lambda f: clamp(F.col(f"_{f}.v")) if f in ("weight", "confidence") else F.col(f"_{f}.v")
    value = {f: F.when(F.col(f"_{f}").isNotNull(), new(f)).otherwise(F.col(f)).alias(f) for f in fields}
    joined = edges.join(newest, "id", "left")
    bumps = joined.where("_n is not null").select(F.explode(F.array("source_id", "target_id")).alias("id"), "_n").groupBy("id").agg(F.sum("_n").alias("bumps"))
    return Commit(checked.where(F.size("errors") > 0), events, joined.select(*[value.get(c, F.col(c)) for c in edges.columns]), bumps)


def commit_remove_edges(commands: DataFrame, edges: DataFrame, config: GraphConfig, next_seq: int, wall_ms: int = 0, rng: str = "", with_twins: bool = False) -> Commit:
    """commands (ord, id); a twin stays unless `with_twins`.  rows: the edges that are left."""
    known = _known(commands, edges, "id", "_known")
    checked = known.withColumn("errors", F.when(F.col("_known"), F.array().cast("array<string>")).otherwise(F.array(F.lit("edge:missing")))).drop("_known")
    valid = numbered(checked.where(F.size("errors") == 0).select("ord", "id"), [F.col("ord")], "seq", next_seq)
    events = valid.select(*_event(F.lit("edge:remove"), F.to_json(F.struct("id")), config, F.lit(wall_ms), rng))
    gone = valid.select("id")
    if with_twins:
        gone = gone.union(gone.select(F.concat("id", F.lit(":sym"))))
    dropped = edges.join(gone.distinct(), "id", "left_semi")
    return Commit(checked.where(F.size("errors") > 0), events, remove(edges, gone.distinct()), bumps_of(dropped))
