"""Append-only log of events, as lines of JSON.

A log is a folder of files that Spark's commit protocol adds to: a batch is there in
whole or not at all.  Entries that come one by one are buffered by a strategy.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files

EVENT = "seq bigint, graph_id string, type string, payload string, rng_state string, wall_ms bigint"
STRATEGIES = ("immediate", "batched", "none")
BATCH = 50


def log_path(data_dir: str, graph_id: str) -> str:
    return f"{data_dir}/logs/{graph_id}.ndjson"


def read(spark: SparkSession, path: str, from_seq: int | None = None) -> DataFrame:
    """Events of a log, of positions from `from_seq` on; a log that isn't there is empty.  Blank lines are skipped."""
    events = spark.read.schema(EVENT).json(path) if files.exists(spark, path) else spark.createDataFrame([], EVENT)
    events = events.where("seq is not null")
    return events if from_seq is None else events.where(F.col("seq") >= from_seq)


def append(events: DataFrame, path: str) -> None:
    """Add a table of events."""
    events.select(*[c.split()[0] for c in EVENT.split(", ")]).write.mode("append").json(path)


def to_parquet(events: DataFrame, path: str) -> None:
    """The log as Parquet, by graph and sorted by position, so that reads from a position skip row groups."""
    events.repartition("graph_id").sortWithinPartitions("graph_id", "seq").write.mode("overwrite").partitionBy("graph_id").parquet(path)


class EventLog:
    """A log that takes entries one by one.

    immediate flushes after each, batched after `batch`, none only when told to.
    """

    def __init__(self, spark: SparkSession, path: str, strategy: str = "batched", batch: int = BATCH, write: Callable[[DataFrame, str], None] = append):
        if strategy not in STRATEGIES:
            raise ValueError(f"unknown strategy {strategy!r}")
        self.spark, self.path, self.strategy, self.batch, self._write = spark, path, strategy, batch, write
        self._held: list[tuple] = []
        self._closed, self.total = False, 0

    @property
    def buffered(self) -> int:
        return len(self._held)

    def append(self, seq: int, graph_id: str, type: str, payload: dict[str, Any], rng_state: str = "", wall_ms: int = 0) -> None:  # noqa: A002
        if self._closed:
            raise RuntimeError("the log is closed")
        self._held.append((seq, graph_id, type, json.dumps(payload), rng_state, wall_ms))
        self.total += 1
        if self.strategy == "immediate" or self.strategy == "batched" and len(self._held) >= self.batch:
            self.flush()

    def flush(self) -> None:
        """Write what is buffered; it stays buffered if the write fails."""
        if self._held:
            self._write(self.spark.createDataFrame(self._held, EVENT).coalesce(1), self.path)
            self._held = []

    def close(self) -> None:
        self._closed = True
        self.flush()

    def read_all(self) -> DataFrame:
        return read(self.spark, self.path)

    def read_from(self, seq: int) -> DataFrame:
        return read(self.spark, self.path, seq)
