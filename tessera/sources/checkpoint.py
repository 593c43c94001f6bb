"""Full states of a graph at a log position, with a checksum.

A checkpoint is a folder `checkpoints/<graph>/<seq, ten digits>` with Parquet tables and
a manifest, written last; a folder without one doesn't count.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files


@dataclass(frozen=True)
class Checkpoint:
    seq: int
    graph_id: str
    entities: DataFrame
    edges: DataFrame
    rng_state: str
    checksum: str


class ChecksumError(RuntimeError):
    pass


def checksum(entities: DataFrame, edges: DataFrame) -> str:
    """SHA-256 over counts and sums of row digests: the order of rows doesn't matter."""

    def digest(df: DataFrame) -> str:
        row = F.xxhash64(*[F.to_json(F.struct(F.col(c))) if "map" in t else F.col(c) for c, t in sorted(df.dtypes)])
        n, total = df.agg(F.count(F.lit(1)), F.sum(row.cast("decimal(38,0)"))).first()
        return f"{n}:{total}"

    spark = entities.sparkSession
    return spark.range(1).select(F.sha2(F.lit(f"{digest(entities)}|{digest(edges)}"), 256)).first()[0]


def _folder(data_dir: str, graph_id: str) -> str:
    return f"{data_dir}/checkpoints/{graph_id}"


def save(data_dir: str, graph_id: str, seq: int, entities: DataFrame, edges: DataFrame, rng_state: str = "") -> str:
    """Write a checkpoint and return its folder."""
    path, spark = f"{_folder(data_dir, graph_id)}/{seq:010d}", entities.sparkSession
    entities.write.mode("overwrite").parquet(f"{path}/entities")
    edges.write.mode("overwrite").parquet(f"{path}/edges")
    total = checksum(spark.read.parquet(f"{path}/entities"), spark.read.parquet(f"{path}/edges"))
    manifest = spark.createDataFrame([(seq, graph_id, rng_state, total)], "seq long, graph_id string, rng_state string, checksum string")
    manifest.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    return path


def listed(spark: SparkSession, data_dir: str, graph_id: str) -> list[int]:
    """Positions that have a checkpoint, ascending."""
    folder = _folder(data_dir, graph_id)
    return [int(n) for n in files.children(spark, folder) if n.isdigit() and files.exists(spark, f"{folder}/{n}/manifest/_SUCCESS")]


def load(spark: SparkSession, data_dir: str, graph_id: str, at: int | None = None) -> Checkpoint | None:
    """The last checkpoint, at or before `at` if given, or None; a wrong checksum raises."""
    known = [s for s in listed(spark, data_dir, graph_id) if at is None or s <= at]
    if not known:
        return None
    path = f"{_folder(data_dir, graph_id)}/{known[-1]:010d}"
    entities, edges = spark.read.parquet(f"{path}/entities"), spark.read.parquet(f"{path}/edges")
    row = spark.read.json(f"{path}/manifest", schema="seq long, graph_id string, rng_state string, checksum string").first()
    if checksum(entities, edges) != row["checksum"]:
        raise ChecksumError(f"checkpoint {path} does not have its checksum")
    return Checkpoint(row["seq"], row["graph_id"], entities, edges, row["rng_state"] or "", row["checksum"])
