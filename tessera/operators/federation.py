"""Several graphs: their dependencies, the verbs that may cross, and writes that arrive later."""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codec import parse_ref


class GraphDAG:
    """Graphs and what each depends on."""

    def __init__(self) -> None:
        self.needs: dict[str, tuple[str, ...]] = {}

    def register(self, graph: str, depends_on: list[str] | tuple[str, ...] = ()) -> None:
        if graph in self.needs:
            raise ValueError(f"graph {graph!r} is registered already")
        self.needs[graph] = tuple(dict.fromkeys(depends_on))

    def has(self, graph: str) -> bool:
        return graph in self.needs

    def validate(self) -> tuple[bool, list[str]]:
        """(True, order with dependencies first), or (False, what is in the way).

        An unregistered dependency gives it and its dependent; a cycle gives every graph
        that can't be placed, those behind the cycle too.
        """
        for graph, needs in self.needs.items():
            for need in needs:
                if need not in self.needs:
                    return False, [need, graph]
        open_ = {g: set(n) for g, n in self.needs.items()}
        ready, order = deque(g for g, n in open_.items() if not n), []
        while ready:
            done = ready.popleft()
            order.append(done)
            for graph, needs in open_.items():
                if done in needs:
                    needs.discard(done)
                    if not needs:
                        ready.append(graph)
        return (True, order) if len(order) == len(open_) else (False, [g for g in self.needs if g not in set(order)])

    def order(self) -> list[str]:
        ok, found = self.validate()
        if not ok:
            raise ValueError(f"graphs depend on each other: {' -> '.join(found)}")
        return found

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(g, n) for g, needs in self.needs.items() for n in needs], "graph_id string, depends_on string")


def levels(graphs: DataFrame, dependencies: DataFrame) -> DataFrame:
    """(graph_id, level): longest way down to a graph without dependencies; graphs on or behind a cycle are absent."""
    from ..plans.lineage import saved

    placed = saved(graphs.join(dependencies.select("graph_id").distinct(), "graph_id", "left_anti").select("graph_id", F.lit(0).alias("level")))
    n, before = placed.count(), 0
    while n != before:
        below = placed.select(F.col("graph_id").alias("depends_on"), "level")
        state = dependencies.join(below, "depends_on", "left").groupBy("graph_id")
        known = state.agg(F.max("level").alias("l"), F.max(F.col("level").isNull()).alias("open")).where(~F.col("open"))
        new = known.join(placed, "graph_id", "left_anti").select("graph_id", (F.col("l") + 1).alias("level"))
        placed = saved(placed.union(new))
        n, before = placed.count(), n
    return placed


@dataclass(frozen=True)
class BoundaryVerb:
    verb: str
    source_graph: str
    target_graph: str
    direction: str = "one-way"
    fidelity: float = 1.0
    temporal_offset: int | None = None


class BoundaryRegistry:
    """Verbs that may cross from one graph to another."""

    def __init__(self) -> None:
        self.rows: dict[tuple[str, str, str], BoundaryVerb] = {}

    def register(self, row: BoundaryVerb) -> None:
        """`both` registers the way back too, where it isn't there."""
        if not 0 <= row.fidelity <= 1:
            raise ValueError("fidelity must be in [0, 1]")
        if row.temporal_offset is not None and row.temporal_offset < 0:
            raise ValueError("temporal offset must not be negative")
        key = (row.verb, row.source_graph, row.target_graph)
        if key in self.rows:
            raise ValueError(f"boundary verb {key!r} is registered already")
        self.rows[key] = row
        if row.direction == "both":
            back = BoundaryVerb(row.verb, row.target_graph, row.source_graph, "both", row.fidelity, row.temporal_offset)
            self.rows.setdefault((row.verb, row.target_graph, row.source_graph), back)

    def is_allowed(self, verb: str, source: str, target: str) -> bool:
        return (verb, source, target) in self.rows

    def get(self, verb: str, source: str, target: str) -> BoundaryVerb | None:
        return self.rows.get((verb, source, target))

    def all(self) -> list[BoundaryVerb]:
        return list(self.rows.values())

    def errors(self, verb: str, source: str, target: str) -> list[str]:
        return [] if self.is_allowed(verb, source, target) else [f"{verb!r} may not cross from {source!r} to {target!r}"]

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(r.verb, r.source_graph, r.target_graph, r.direction, r.fidelity, r.temporal_offset) for r in self.rows.values()]
        return spark.createDataFrame(rows, "verb_type string, source_graph string, target_graph string, direction string, fidelity double, temporal_offset long")


CROSSING = ["verb_type", "source_graph", "target_graph"]


def allowed(writes: DataFrame, boundary: DataFrame) -> DataFrame:
    """Writes (CROSSING, ...) that the whitelist has."""
    return writes.join(boundary.select(*CROSSING), CROSSING, "left_semi")


def refused(writes: DataFrame, boundary: DataFrame) -> DataFrame:
    return writes.join(boundary.select(*CROSSING), CROSSING, "left_anti")


def resolve_refs(refs: DataFrame, context_graph: str, entities: DataFrame, ref: str = "ref") -> DataFrame:
    """`refs` with graph_id, entity_id and `found`: does the entity exist?  A bare id is one of the context graph."""
    parsed = refs.withColumn("_p", parse_ref(F.col(ref), context_graph))
    split = parsed.select(*refs.columns, F.col("_p.graph_id").alias("graph_id"), F.col("_p.entity_id").alias("entity_id"))
    known = entities.select("graph_id", F.col("id").alias("entity_id")).distinct().withColumn("found", F.lit(True))
    return split.join(known, ["graph_id", "entity_id"], "left").fillna(False, ["found"])


def check_cross_refs(refs: DataFrame, graphs: DataFrame) -> DataFrame:
    """refs (source_graph, target_graph, ...) with `errors`: both registered, and not the same."""
    known = graphs.select("graph_id").distinct()
    source = known.select(F.col("graph_id").alias("source_graph"), F.lit(True).alias("_s"))
    target = known.select(F.col("graph_id").alias("target_graph"), F.lit(True).alias("_t"))
    joined = refs.join(source, "source_graph", "left").join(target, "target_graph", "left")
    checks = F.array(
        F.when(F.col("_s").isNull(), "source:unregistered"), F.when(F.col("_t").isNull(), "target:unregistered"),
        F.when(F.col("source_graph") == F.col("target_graph"), "graphs:same"),
    )
    return joined.withColumn("errors", F.filter(checks, lambda x: x.isNotNull())).drop("_s", "_t")


def enqueue(writes: DataFrame, tick, offset="temporal_offset") -> DataFrame:
    """`writes` with deliver_at; a null offset is none, a negative one raises."""
    offset = F.coalesce(F.col(offset) if isinstance(offset, str) else F.lit(offset), F.lit(0))
    checked = F.when(offset >= 0, offset).otherwise(F.raise_error(F.lit("temporal offset must not be negative")).cast("long"))
    return writes.withColumn("deliver_at", (F.col(tick) if isinstance(tick, str) else F.lit(tick)) + checked)


def process_tick(queue: DataFrame, tick: int, order: str = "ord") -> tuple[DataFrame, DataFrame]:
    """(due, left): writes with deliver_at up to the tick in delivery order, and the rest.  Ties keep the order of arrival."""
    due = F.col("deliver_at") <= tick
    return queue.where(due).orderBy("deliver_at", order), queue.where(~due)


def save_queue(queue: DataFrame, path: str) -> None:
    """Writes a queue as Parquet, on any file system Spark writes; what was there before is replaced."""
    queue.write.mode("overwrite").parquet(path)


def restore_queue(spark: SparkSession, path: str) -> DataFrame:
    """The queue as saved."""
    return spark.read.parquet(path)


def queue_size(queue: DataFrame) -> int:
    return queue.count()
