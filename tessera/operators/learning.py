"""What edges teach: embeddings by ordered translation steps, memories by ordered majority."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hdc import SCALE, base_vector, bind, relation_floats, repetitions
from ..functions.num import UNIT
from ..functions.vector import LEARNING_RATE
from ..plans.lineage import connected_components, saved


def _r6(x: np.ndarray) -> np.ndarray:
    return np.floor(x * UNIT + 0.5) / UNIT


def train_embeddings(edges: DataFrame, entities: DataFrame, seed: int, dim: int, rate: float = LEARNING_RATE) -> DataFrame:
    """(id, embedding, steps) after one step for each edge (log_seq, source_id, target_id, verb_type, weight), in log order.

    Steps of edges that share no entity don't touch, so each connected component is
    trained by itself, exactly.  The relation vector is made anew for every edge.  A
    component is one task; for a graph that hangs together use `train_embeddings_batch`.
    """
    links = edges.select(F.col("source_id").alias("a"), F.col("target_id").alias("b"))
    roots = saved(connected_components(links))
    own = edges.select("log_seq", "source_id", "target_id", "verb_type", "weight")
    rooted = own.join(roots.withColumnRenamed("node", "source_id"), "source_id", "left")
    rooted = rooted.select(F.coalesce("root", "source_id").alias("root"), *own.columns)
    start = entities.select("id", "embedding").join(roots.withColumnRenamed("node", "id"), "id", "left")
    start = start.select(F.coalesce("root", "id").alias("root"), "id", "embedding")

    def train(key, steps: pd.DataFrame, nodes: pd.DataFrame) -> pd.DataFrame:
        vectors = {i: np.array(v, np.float32) for i, v in zip(nodes["id"], nodes["embedding"])}
        count = dict.fromkeys(vectors, 0)
        verbs = steps["verb_type"].unique()
        relations = dict(zip(verbs, relation_floats(verbs, seed, dim)))
        for r in steps.sort_values("log_seq").itertuples():
            if r.source_id not in vectors or r.target_id not in vectors:
                continue
            head, tail = vectors[r.source_id], vectors[r.target_id]
            gap = head.astype(np.float64) + relations[r.verb_type] - tail
            delta = _r6(r.weight * rate * gap)
            tail[:] = _r6(np.clip(_r6(tail + delta), -1, 1))
            head[:] = _r6(np.clip(_r6(head - delta * 0.5), -1, 1))
            count[r.source_id] += 1
            count[r.target_id] += 1
        return pd.DataFrame({"id": list(vectors), "embedding": list(vectors.values()), "steps": list(count.values())})

    return rooted.groupBy("root").cogroup(start.groupBy("root")).applyInPandas(train, "id string, embedding array<float>, steps long")


def train_embeddings_batch(edges: DataFrame, entities: DataFrame, seed: int, dim: int, rate: float = LEARNING_RATE) -> DataFrame:
    """(id, embedding): one mini-batch step, all edges against the embeddings as they are, moves averaged by entity.

    An approximation of the ordered training that needs two joins and one aggregate,
    whatever the graph's shape.
    """
    from ..functions.hdc import relation_vector

    vector = entities.select("id", F.col("embedding").cast("array<double>").alias("v"))
    # verbs are few; their vectors are made once each
    verbs = edges.select("verb_type").distinct().withColumn("r", relation_vector(F.col("verb_type"), seed, dim).cast("array<double>"))
    ends = (
        edges.join(verbs, "verb_type")
        .join(vector.select(F.col("id").alias("source_id"), F.col("v").alias("h")), "source_id")
        .join(vector.select(F.col("id").alias("target_id"), F.col("v").alias("t")), "target_id")
    )
    gap = F.zip_with(F.zip_with("h", "r", lambda x, y: x + y), "t", lambda x, y: x - y)
    moves = ends.select("source_id", "target_id", F.transform(gap, lambda e: e * F.col("weight") * rate).alias("d"))
    dims = F.posexplode("d").alias("i", "x")
    each = moves.select("source_id", "target_id", dims)
    pulls = each.select(F.inline(F.array(F.struct(F.col("source_id").alias("id"), "i", (-F.col("x") / 2).alias("x")), F.struct(F.col("target_id").alias("id"), "i", F.col("x").alias("x")))))
    mean = pulls.groupBy("id", "i").agg(F.avg("x").alias("x"))
    whole = mean.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("d"))
    moved = F.zip_with("v", "d", lambda x, d: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x + d)))
    return vector.join(whole, "id", "left").select("id", F.when(F.col("d").isNull(), F.col("v")).otherwise(moved).cast("array<float>").alias("embedding"))


def experiences(edges: DataFrame, seed: int, dim: int) -> DataFrame:
    """(id, ord, weight, experience): what each edge leaves in its source's memory."""
    made = bind(bind(base_vector(F.col("source_id"), seed, dim), base_vector(F.col("verb_type"), seed, dim)), base_vector(F.col("target_id"), seed, dim))
    return edges.select(F.col("source_id").alias("id"), F.col("log_seq").alias("ord"), "weight", made.alias("experience"))


def remember_set(facts: DataFrame, start: str = "ones", scale: int = SCALE) -> DataFrame:
    """(id, bundle) after all of an entity's experiences (id, ord, weight, experience), in order, without a fold.

    An experience added twice or more outweighs a bundle of signs and replaces it; one
    added once turns signs to +1 where it has +1.  So the bundle is the last replacing
    one, with the +1 of later ones put in.  `start`: ones (a new entity's) or zeros (an
    empty bundle, that the first experience replaces).
    """
    reps = facts.withColumn("_over", repetitions(F.col("weight"), scale) >= 2)
    if start == "zeros":
        first = facts.groupBy("id").agg(F.min("ord").alias("_first"))
        reps = reps.join(first, "id").withColumn("_over", F.col("_over") | (F.col("ord") == F.col("_first"))).drop("_first")
    last = reps.where("_over").groupBy("id").agg(F.max("ord").alias("_at"))
    late = reps.join(last, "id", "left").where(F.col("_at").isNull() | (F.col("ord") >= F.col("_at")))
    dims = late.select("id", F.col("_at").isNull().alias("_ones"), F.posexplode("experience").alias("i", "x"))
    signs = dims.groupBy("id", "i").agg(F.when(F.max("_ones"), F.lit(1)).otherwise(F.max("x")).cast("tinyint").alias("x"))
    return signs.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("bundle"))


def learn(edges: DataFrame, entities: DataFrame, dim: int, hdc_dim: int | None, seed: int) -> DataFrame:
    """`entities` after `edges` (log_seq, source_id, target_id, verb_type, weight) were added, in log order.

    Embeddings make a step for each edge, exactly; the source's memory, a bundle of
    signs, takes in what the edge leaves.  Entities without a memory get none.
    """
    own = edges.select("log_seq", "source_id", "target_id", "verb_type", "weight")
    moved = train_embeddings(own, entities, seed, dim).select(F.col("id").alias("_id"), F.col("embedding").alias("_embedding"), "steps")
    after = entities.join(moved, F.col("id") == F.col("_id"), "left")
    value = {"embedding": F.coalesce("_embedding", "embedding"), "embedding_ver": F.col("embedding_ver") + F.coalesce("steps", F.lit(0))}
    if hdc_dim:
        held = entities.where("memory_bundle is not null")
        # the memory so far is as good as one that replaces all before
        start = held.join(own.select(F.col("source_id").alias("id")).distinct(), "id", "left_semi")
        facts = experiences(own, seed, hdc_dim).join(held.select("id"), "id", "left_semi")
        first = start.select("id", F.lit(-1).cast("long").alias("ord"), F.lit(1.0).alias("weight"), F.col("memory_bundle").alias("experience"))
        memory = remember_set(first.unionByName(facts.select(*first.columns))).select(F.col("id").alias("_of"), "bundle")
        after = after.join(memory, F.col("id") == F.col("_of"), "left")
        value["memory_bundle"] = F.coalesce(F.col("bundle").cast("array<tinyint>"), F.col("memory_bundle"))
    return after.select(*[value[c].alias(c) if c in value else entities[c] for c in entities.columns])
