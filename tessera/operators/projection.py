"""Materialised components of entities, refreshed where edges changed; the hot zone."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = ["graph_id", "entity_id", "component"]


@dataclass(frozen=True)
class Component:
    """A derived value: what verbs it depends on, how soon it may be derived again, and how.

    derive(keys) takes (graph_id, entity_id) and returns these with `value`.
    """

    id: str
    depends_on: tuple[str, ...]
    interval_ms: int
    derive: Callable[[DataFrame], DataFrame]


class ComponentRegistry:
    def __init__(self) -> None:
        self.components: dict[str, Component] = {}

    def register(self, component: Component) -> None:
        if component.id in self.components:
            raise ValueError(f"component {component.id!r} is registered already")
        self.components[component.id] = component

    def get(self, name: str) -> Component | None:
        return self.components.get(name)

    def ids(self) -> list[str]:
        return list(self.components)

    def affected_by(self, verbs) -> set[str]:
        wanted = set(verbs)
        return {c.id for c in self.components.values() if wanted & set(c.depends_on)}

    def manifest(self, spark: SparkSession) -> DataFrame:
        """(verb_type, component)."""
        return spark.createDataFrame([(v, c.id) for c in self.components.values() for v in c.depends_on], "verb_type string, component string")

    def intervals(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(c.id, c.interval_ms) for c in self.components.values()], "component string, interval_ms long")


def affected_components(verbs: DataFrame, manifest: DataFrame) -> DataFrame:
    """(component) that depend on any of the verbs (verb_type)."""
    return manifest.join(verbs.select("verb_type").distinct(), "verb_type", "left_semi").select("component").distinct()


def dirtied(changes: DataFrame, manifest: DataFrame) -> DataFrame:
    """KEY rows that edge changes (graph_id, verb_type, source_id, target_id) make dirty: both ends, each component once."""
    hit = changes.join(manifest, "verb_type")
    return hit.select("graph_id", F.explode(F.array("source_id", "target_id")).alias("entity_id"), "component").distinct()


def mark(dirty: DataFrame, more: DataFrame) -> DataFrame:
    return dirty.select(*KEY).union(more.select(*KEY)).distinct()


def clean(dirty: DataFrame, done: DataFrame) -> DataFrame:
    return dirty.join(done.select(*KEY), KEY, "left_anti")


def due(dirty: DataFrame, cache: DataFrame, intervals: DataFrame, now_ms: int) -> DataFrame:
    """Dirty keys to derive now: not cached, or cached for the component's interval; others wait."""
    known = dirty.select(*KEY).join(intervals, "component")
    seen = known.join(cache.select(*KEY, "derived_at_ms"), KEY, "left")
    return seen.where(F.col("derived_at_ms").isNull() | (F.lit(now_ms) - F.col("derived_at_ms") >= F.col("interval_ms"))).select(*KEY)


def refresh(dirty: DataFrame, cache: DataFrame, registry: ComponentRegistry, now_ms: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cache, dirty, derived) after deriving what is due; only those keys are computed."""
    spark = cache.sparkSession
    keys = due(dirty, cache, registry.intervals(spark), now_ms)
    made = None
    for component in registry.components.values():
        own = component.derive(keys.where(F.col("component") == component.id).select("graph_id", "entity_id"))
        own = own.select("graph_id", "entity_id", F.lit(component.id).alias("component"), F.col("value").cast("double").alias("value"), F.lit(now_ms).cast("long").alias("derived_at_ms"))
        made = own if made is None else made.union(own)
    if made is None:
        return cache, dirty, cache.limit(0)
    return cache.join(keys, KEY, "left_anti").unionByName(made), clean(dirty, keys), made


def invalidate(dirty: DataFrame, cache: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(dirty, cache) with the keys dirty and without cached values, so the next refresh derives them."""
    return mark(dirty, keys), cache.join(keys.select(*KEY), KEY, "left_anti")


def read(cache: DataFrame, keys: DataFrame) -> DataFrame:
    """`keys` with cached values; a component that never was dirty has none, so null."""
    return keys.join(cache.select(*KEY, "value"), KEY, "left")


# -- hot zone: (entity_id, last_access_ms, pinned) ---------------------------------------


def accesses(touches: DataFrame) -> DataFrame:
    """Access table of touches (entity_id, at_ms, op) with op touch, pin or unpin, in the order of at_ms.

    Unpinning forgets the access, so the entity is cold at once.
    """
    last = F.max_by("op", "at_ms")
    pins = F.max(F.when(F.col("op") == "pin", F.col("at_ms")))
    unpins = F.max(F.when(F.col("op") == "unpin", F.col("at_ms")))
    state = touches.groupBy("entity_id").agg(F.max("at_ms").alias("at"), last.alias("op"), pins.alias("p"), unpins.alias("u"))
    pinned = F.col("p").isNotNull() & (F.col("u").isNull() | (F.col("p") > F.col("u")))
    return state.select("entity_id", F.when(F.col("op") != "unpin", F.col("at")).alias("last_access_ms"), pinned.alias("pinned"))


def hot(table: DataFrame, now_ms: int, max_age_ms: int) -> DataFrame:
    """Entities that are pinned or were accessed within the age."""
    return table.where(F.col("pinned") | (F.lit(now_ms) - F.col("last_access_ms") <= max_age_ms))


def evict(entities: DataFrame, edges: DataFrame, table: DataFrame, now_ms: int, max_age_ms: int) -> tuple[DataFrame, DataFrame]:
    """(kept, evicted) entities: the cold ones without edges go; one that was never accessed is cold."""
    warm = hot(table, now_ms, max_age_ms).select(F.col("entity_id").alias("id"))
    ends = edges.select(F.explode(F.array("source_id", "target_id")).alias("id")).distinct()
    gone = entities.join(warm, "id", "left_anti").join(ends, "id", "left_anti")
    return entities.join(gone.select("id"), "id", "left_anti"), gone


def tracked(table: DataFrame) -> DataFrame:
    return table.agg(F.count("last_access_ms").alias("tracked_count"))
