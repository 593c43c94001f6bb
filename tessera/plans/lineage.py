"""Lineage cuts in the shared folder, running numbers without a single task, components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder all machines share, as the session names it in spark.checkpoint.dir.

    Only where that is unset and all runs on one machine (tests) a temporary folder is used.
    """
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="tessera-"))
    return context.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """`df` written to the shared folder as Parquet and read again: its lineage cut, columns read as asked for."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def saved(df: DataFrame) -> DataFrame:
    """`df` written to the shared folder, its lineage cut."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def numbered(df: DataFrame, order: list[Column], out: str = "seq", start: int = 0) -> DataFrame:
    """`df` with running numbers from `start` in a total order.

    Rows are dealt by range, numbered inside each partition and moved by the counts of
    the partitions before; the driver sees one row for each partition.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    held = saved(dealt.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id()))
    counts = held.groupBy("_part").agg(F.count(F.lit(1)).alias("n"), F.min("_row").alias("first")).orderBy("_part").collect()
    base, rows = start, []
    for r in counts:
        rows.append((r["_part"], base - r["first"]))
        base += r["n"]
    moved = F.broadcast(df.sparkSession.createDataFrame(rows, "_part int, _base long"))
    return held.join(moved, "_part").select(*df.columns, (F.col("_row") + F.col("_base")).alias(out))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (a, b of one type); root is the least node.

    Alternating large-star and small-star steps.  Minima are partial aggregates and
    the joins on a busy node can be split, so a component may have any size.  Each
    step is written to the shared folder; the driver sees two sums only.
    """

    def large(e: DataFrame) -> DataFrame:
        """Every node's neighbours above it move to its least neighbour."""
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()

    def small(e: DataFrame) -> DataFrame:
        """Every node and its neighbours below it move to the least of them."""
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        moved = e.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return moved.union(least.select("u", F.col("m").alias("v"))).distinct()

    def stamp(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = stamp(now)
    while mark[0]:
        now = saved(small(saved(large(now))))
        mark, old = stamp(now), mark
        if mark == old:
            break
    down = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return down.union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
