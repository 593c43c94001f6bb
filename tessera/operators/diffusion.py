"""Opinions that spread over a trust matrix, kept sparse as (target, source, w)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.num import r6
from ..plans.lineage import saved

MAX_STEPS = 100
CONVERGED = 0.001
#: Weights are added as decimals, so sums don't depend on the order of rows.
EXACT = "decimal(30,12)"


def trust_matrix(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(target, source, w): each target's weights by source, of sum one at six decimals.

    Parallel edges are added up; edges of unknown ids are dropped; an entity nobody
    influences trusts itself.
    """
    known = ids.select("id").distinct()
    own = edges.join(known.withColumnRenamed("id", "target_id"), "target_id", "left_semi").join(known.withColumnRenamed("id", "source_id"), "source_id", "left_semi")
    pairs = saved(own.groupBy(F.col("target_id").alias("target"), F.col("source_id").alias("source")).agg(F.sum(F.col("weight").cast(EXACT)).alias("s")))
    totals = pairs.groupBy("target").agg(F.sum("s").alias("total"))
    weighted = pairs.join(totals, "target").where("total <> 0")
    rows = weighted.select("target", "source", r6(F.col("s").cast("double") / F.col("total").cast("double")).alias("w"))
    alone = known.join(totals.where("total <> 0").select(F.col("target").alias("id")), "id", "left_anti")
    return rows.unionByName(alone.select(F.col("id").alias("target"), F.col("id").alias("source"), F.lit(1.0).alias("w")))


def _influence(current: DataFrame, matrix: DataFrame) -> DataFrame:
    """(id, influence): weighted sums of the sources' values; factors at nine decimals are added exactly."""
    moved = matrix.join(current.select(F.col("id").alias("source"), "value"), "source")
    return moved.groupBy(F.col("target").alias("id")).agg(F.sum((F.col("w") * F.col("value")).cast(EXACT)).cast("double").alias("influence"))


def _iterate(start: DataFrame, matrix: DataFrame, step, max_steps: int, delta: float) -> DataFrame:
    current = saved(start)
    for _ in range(max_steps):
        new = saved(step(current, _influence(current, matrix)))
        change = new.agg(F.max(F.abs(F.col("value") - F.col("before")))).first()[0]
        current = new.drop("before")
        if change is None or change <= delta:
            break
    return current


def _start(matrix: DataFrame, beliefs: DataFrame) -> DataFrame:
    ids = matrix.select(F.col("target").alias("id")).distinct()
    return ids.join(beliefs.select("id", F.col("value").cast("double").alias("value")), "id", "left").fillna(0.0, ["value"])


def degroot(beliefs: DataFrame, matrix: DataFrame, max_steps: int = MAX_STEPS, delta: float = CONVERGED) -> DataFrame:
    """(id, value) after steps value = sum of w * source's value, until no value changes by more than `delta`.

    A missing belief (id, value) is 0.  Each step is one join and one aggregate,
    written to the shared folder; the driver sees the largest change.
    """

    def step(current: DataFrame, influence: DataFrame) -> DataFrame:
        joined = current.join(influence, "id", "left")
        return joined.select("id", r6(F.coalesce("influence", F.lit(0.0))).alias("value"), F.col("value").alias("before"))

    matrix = saved(matrix)
    return _iterate(_start(matrix, beliefs), matrix, step, max_steps, delta)


def friedkin_johnsen(
    beliefs: DataFrame, initial: DataFrame, stubbornness: DataFrame, matrix: DataFrame, max_steps: int = MAX_STEPS, delta: float = CONVERGED
) -> DataFrame:
    """(id, value): as `degroot`, with each entity held by its stubbornness (default 0.5) to its initial belief (default 0)."""
    matrix = saved(matrix)
    start = _start(matrix, beliefs)
    held = start.join(initial.select("id", F.col("value").cast("double").alias("anchor")), "id", "left")
    held = held.join(stubbornness.select("id", F.col("value").cast("double").alias("lam")), "id", "left").fillna({"anchor": 0.0, "lam": 0.5})

    def step(current: DataFrame, influence: DataFrame) -> DataFrame:
        joined = current.join(influence, "id", "left")
        value = r6(F.col("lam") * F.col("anchor") + (1 - F.col("lam")) * F.coalesce("influence", F.lit(0.0)))
        return joined.select("id", value.alias("value"), "anchor", "lam", F.col("value").alias("before"))

    return _iterate(held, matrix, step, max_steps, delta).select("id", "value")
