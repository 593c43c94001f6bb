"""Streams that keep tables up to date: dirty keys, projections, vectors, edges, accesses, the log."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import nearest, projection
from ..sources import eventlog, files


class Versions:
    """A table kept as numbered folders: a batch writes the next one and readers take the last complete one.

    A batch that is run again writes the same folder again, so its effect is there once.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path, schema

    def numbers(self) -> list[int]:
        return [int(n) for n in files.children(self.spark, self.path) if n.isdigit() and files.exists(self.spark, f"{self.path}/{n}/_SUCCESS")]

    def read(self, before: int | None = None) -> DataFrame:
        known = [n for n in self.numbers() if before is None or n < before]
        if not known:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.parquet(f"{self.path}/{known[-1]:010d}")

    def write(self, df: DataFrame, number: int, keep: int = 2) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/{number:010d}")
        for old in self.numbers()[:-keep]:
            files.delete(self.spark, f"{self.path}/{old:010d}")


def _each(stream: DataFrame, run: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict | None) -> StreamingQuery:
    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def log_events(stream: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Events of a stream into a log."""
    rows = stream.select(*[c.split()[0] for c in eventlog.EVENT.split(", ")])
    writer = rows.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def track_dirty(changes: DataFrame, manifest: DataFrame, table: Versions, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Dirty keys of a stream of edge changes, as a set."""

    def run(batch: DataFrame, number: int) -> None:
        table.write(projection.mark(table.read(number), projection.dirtied(batch, manifest)), number)

    return _each(changes, run, checkpoint, trigger)


def refresh_projections(
    changes: DataFrame, registry: projection.ComponentRegistry, cache: Versions, dirty: Versions, checkpoint: str, now_ms: Callable[[int], int], trigger: dict | None = None
) -> StreamingQuery:
    """Cached components of a stream of edge changes: each batch marks what it touches and derives what is due.

    now_ms gives the time of a batch by its number, so that a batch that is run again
    does the same.
    """

    def run(batch: DataFrame, number: int) -> None:
        marked = projection.mark(dirty.read(number), projection.dirtied(batch, registry.manifest(batch.sparkSession)))
        new, left, _ = projection.refresh(marked, cache.read(number), registry, now_ms(number))
        cache.write(new, number)
        dirty.write(left, number)

    return _each(changes, run, checkpoint, trigger)


def track_vectors(updates: DataFrame, index: Versions, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """A vector index kept up to date by a stream of updates (ord, op, id, embedding)."""

    def run(batch: DataFrame, number: int) -> None:
        index.write(nearest.apply_updates(index.read(number), batch), number)

    return _each(updates, run, checkpoint, trigger)


def track_edges(events: DataFrame, table: Versions, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Facts of edges by id - last birth, removal, updates since - for replay without the whole log.

    Kept are a birth's event, later updates and the last removal: what a lower position
    can still change.  `temporal.edges_at` over the kept events gives the state.
    """

    def run(batch: DataFrame, number: int) -> None:
        all_ = table.read(number).unionByName(batch.select(*[c.split()[0] for c in eventlog.EVENT.split(", ")]))
        own = all_.withColumn("_id", F.get_json_object("payload", "$.id"))
        birth = F.max(F.when(F.col("type").isin("edge:add", "edge:infer"), F.col("seq")))
        keys = own.groupBy("_id").agg(birth.alias("_birth"))
        kept = own.join(keys, "_id").where(F.col("_birth").isNull() | (F.col("seq") >= F.col("_birth")))
        table.write(kept.select(*[c.split()[0] for c in eventlog.EVENT.split(", ")]), number)

    return _each(events, run, checkpoint, trigger)


def last_access(touches: DataFrame, delay: str = "1 hour") -> DataFrame:
    """(entity_id, last_access_ms) of a stream of touches (entity_id, ts): a running aggregate."""
    late = touches.withWatermark("ts", delay)
    return late.groupBy("entity_id").agg(F.max(F.unix_millis(F.col("ts").cast("timestamp"))).alias("last_access_ms"))


def tumbling_counts(events: DataFrame, width: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """(start, type, n) by tumbling window of a stream (ts, type)."""
    late = events.withWatermark("ts", delay)
    return late.groupBy(F.window("ts", width).alias("w"), "type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "type", "n")
