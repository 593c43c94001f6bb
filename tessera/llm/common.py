"""Helpers the operators share: bounded batches, salted ranks, rows by key and copies."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.lineage import connected_components, numbered, saved, shared_folder, stored

__all__ = ["connected_components", "numbered", "saved", "shared_folder", "stored"]

#: ASCII blanks between words, as `bytes.split()` and `[\x20\x09-\x0D]` see them.
WORD = r"[^\x20\x09-\x0D]+"


def prepare(spark: SparkSession) -> None:
    """Bound the Arrow batches Python workers get, by rows and by bytes; a worker holds a batch several times over."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def lean(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`work` on a task's batches that gives freed memory back to the system at its end, as workers outlive their tasks."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(it)
        trim()

    return batches


def trim() -> None:
    """Gives memory that this process has freed back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def release(spark: SparkSession) -> None:
    """Has Spark delete the shuffle files of plans that are done: it does so once the driver's JVM finds them unreachable."""
    gc.collect()
    spark._jvm.System.gc()


def drop(spark: SparkSession, *held: DataFrame) -> None:
    """Deletes the files of `stored` tables that nothing reads any more, and shuffle files."""
    for path in {f.rsplit("/", 1)[0] for df in held for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    release(spark)


#: Rows of some numbers each that may be broadcast.
BROADCAST_ROWS = 100_000


def small(held: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A saved table, marked for broadcast if it is counted to be small; else it is joined by shuffle."""
    return F.broadcast(held) if held.count() <= rows else held


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """Column names like `names` that `docs` has not got."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        name = f"_{name}"
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def spread(df: DataFrame) -> DataFrame:
    """A table as read, dealt over the cores where it comes in fewer parts than there are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


#: Keys of rows, with two counts each, that may be broadcast.
BROADCAST_KEYS = 500_000


def row_key(docs: DataFrame) -> Column:
    """128 bits of all columns; equal rows have one key."""
    return F.struct(F.xxhash64(F.lit(1), *docs.columns).alias("a"), F.xxhash64(F.lit(2), *docs.columns).alias("b"))


def copies_of(docs: DataFrame, changed: DataFrame) -> DataFrame:
    """`docs` where rows of the keys in `changed` (key, rows, copies) come `copies` times in all, all others as they are.

    rows: how many rows of `docs` have that key.  Only rows whose copies are no multiple
    of their number, so equal rows, are brought together; the others are copied or left
    out where they stand.  `changed` is broadcast if it is counted to be small, else
    joined by shuffle.
    """
    (name,) = fresh(docs, "key")
    changed = small(saved(changed.where("copies <> rows")), BROADCAST_KEYS)
    even = changed.select(F.col("key").alias(f"{name}of"), F.when(F.col("copies") % F.col("rows") == 0, F.col("copies") / F.col("rows")).otherwise(0).cast("int").alias(f"{name}n"))
    keyed = docs.withColumn(name, row_key(docs))
    times = F.coalesce(F.col(f"{name}n"), F.lit(1))
    here = keyed.join(even, F.col(name) == F.col(f"{name}of"), "left").where(times > 0)
    here = here.withColumn(f"{name}copy", F.explode(F.array_repeat(F.lit(0), times))).select(*docs.columns)
    odd = changed.where("copies % rows <> 0").select(F.col("key").alias(f"{name}of"), F.col("copies").cast("int").alias(f"{name}n"))
    if odd.isEmpty():
        return here
    together = keyed.join(odd, F.col(name) == F.col(f"{name}of")).dropDuplicates([name])
    return here.union(together.withColumn(f"{name}copy", F.explode(F.array_repeat(F.lit(0), f"{name}n"))).select(*docs.columns))


def ranked(df: DataFrame, keys: list[str], order: list, out: str, per_task: int = 50_000) -> DataFrame:
    """`df` with its 0-based rank `out` (long) inside each group of `keys`.

    A group may hold any share of the rows: it is dealt over salts, each salt is
    ranked alone and gets the counts of the salts before it added.  `order` must be
    made of columns; rows equal in all of them are interchangeable.  Ranks follow
    (salt, order), so they are a seeded shuffle of the group, the same on each run.
    """
    n = df.count()
    salts = 64 * max(1, -(-n // (8 * per_task)))
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(F.lit(17), *order), F.lit(salts)).cast("int"))
    slot = [*keys, "_salt"]
    counts = salted.groupBy(*slot).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(*slot, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    local = salted.withColumn("_rank", F.row_number().over(Window.partitionBy(*slot).orderBy(*order)) - 1)
    same = [local[c].eqNullSafe(base[c]) for c in slot]
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    kept = [local[c] for c in df.columns]
    return local.join(base, cond, "left").select(*kept, (F.col("_base") + F.col("_rank")).cast("long").alias(out))
