"""Nearest embeddings by translation score, for one query and for many."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vector import closeness, moved, score

#: Query vectors up to this many bytes are broadcast; larger sets go in slices of it.
BROADCAST_BYTES = 8 << 20


def nearest(candidates: DataFrame, query: list[float], k: int, id_col: str = "id", vector: str = "embedding", close=closeness) -> DataFrame:
    """(id, score): the k closest to one vector by `close`, ties to the smaller id."""
    scored = candidates.select(F.col(id_col).alias("id"), close(F.lit(query).cast("array<double>"), F.col(vector)).alias("score"))
    return scored.orderBy(F.desc("score"), "id").limit(k)


def nearest_each(queries: DataFrame, candidates: DataFrame, k: int, ordinal: str = "id", close=closeness) -> DataFrame:
    """(query_id, id, rank, score) for queries (query_id, query) against candidates (id, embedding).

    `close` scores a query and a candidate; of equal scores, as it rounds them, the least `ordinal` comes first.

    Queries are dealt to slices of bounded size; a slice is broadcast and meets all
    candidates in place, and only the k best of each query leave a partition's sort.
    """
    n = queries.count()
    width = queries.agg(F.max(F.size("query"))).first()[0] or 0
    slices = max(1, -(-n * width * 8 // BROADCAST_BYTES))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), ordinal)
    found = None
    for s in range(slices):
        part = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(slices)) == s) if slices > 1 else queries
        pairs = candidates.select("id", "embedding", *({ordinal} - {"id"})).join(F.broadcast(part.select("query_id", "query")), F.lit(True))
        best = pairs.withColumn("score", close(F.col("query"), F.col("embedding")))
        best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "id", "rank", "score")
        found = best if found is None else found.union(best)
    return found


def query_index(heads: DataFrame, candidates: DataFrame, k: int, close=closeness) -> DataFrame:
    """heads (query_id, head, relation): the k candidates closest to head + relation (in doubles, as `score`), as `nearest_each`."""
    return nearest_each(heads.select("query_id", moved(F.col("head"), F.col("relation")).alias("query")), candidates, k, close=close)


def score_triples(triples: DataFrame) -> DataFrame:
    """`triples` (head, relation, tail, ...) with `score`."""
    return triples.withColumn("score", score(F.col("head"), F.col("relation"), F.col("tail")))


def apply_updates(index: DataFrame, updates: DataFrame) -> DataFrame:
    """An index (id, embedding, ordinal) after queued updates (ord, op, id, embedding).

    The last operation on an id counts.  add and update put a vector, and are skipped
    without one; remove drops it.  An id keeps the place of its first insert after the
    last removal; new ones come after all there are.
    """
    useful = updates.where((F.col("op") == "remove") | F.col("embedding").isNotNull())
    gone = F.max(F.when(F.col("op") == "remove", F.col("ord")))
    cut = useful.groupBy("id").agg(gone.alias("_gone"))
    puts = useful.where("op <> 'remove'").join(cut, "id").where(F.col("_gone").isNull() | (F.col("ord") > F.col("_gone")))
    new = puts.groupBy("id").agg(F.max_by("embedding", "ord").alias("_new"), F.min("ord").alias("_first"))
    base = index.agg(F.coalesce(F.max("ordinal"), F.lit(-1)).cast("long")).first()[0] + 1
    joined = index.join(cut, "id", "full").join(new, "id", "full")
    old = F.when(F.col("_gone").isNull(), F.col("ordinal"))
    kept = F.coalesce(F.col("_new"), F.when(F.col("_gone").isNull(), F.col("embedding")))
    return joined.select("id", kept.alias("embedding"), F.coalesce(old, F.col("_first") + base).cast("long").alias("ordinal")).where("embedding is not null")


class VectorIndex:
    """An exact index over a table of vectors: `upsert`, `remove`, `query`; every change is a new plan."""

    def __init__(self, rows: DataFrame):
        self.rows = rows

    def upsert(self, id_: str, vector: list[float]) -> VectorIndex:
        spark = self.rows.sparkSession
        one = spark.createDataFrame([(0, "add", id_, vector)], "ord long, op string, id string, embedding array<float>")
        return VectorIndex(apply_updates(self.rows, one))

    def remove(self, id_: str) -> VectorIndex:
        spark = self.rows.sparkSession
        one = spark.createDataFrame([(0, "remove", id_, None)], "ord long, op string, id string, embedding array<float>")
        return VectorIndex(apply_updates(self.rows, one))

    def query(self, vector: list[float], k: int) -> DataFrame:
        scored = self.rows.select("id", "ordinal", closeness(F.lit(vector).cast("array<double>"), F.col("embedding")).alias("score"))
        return scored.orderBy(F.desc("score"), "ordinal").limit(k).select("id", "score")


def create_index(spark, dim: int | None = None) -> VectorIndex:
    """An empty exact index; `dim` is taken for the sake of the interface and not needed."""
    return VectorIndex(spark.createDataFrame([], "id string, embedding array<float>, ordinal long"))
