"""Exact top-k search by inner product over a pivot-distance index.

A vector x gets one more component, sqrt(M - |x|^2) with M the largest squared norm, so
that the distance d of a query q to it satisfies d^2 = |q|^2 + M - 2 q.x: the highest
inner product is the nearest vector.  The index keys each vector by its nearest pivot
and its distance r to that pivot, sorted, in blocks.  A query at distance D of the pivot
cannot reach vectors of a block nearer than the gap between D and the block's annulus,
so blocks are taken from the narrowest gap outwards and the search of a pivot stops at
the first whose bound is below the k-th best score.

Queries are a set that grows with the table.  They are taken in slices of bounded size;
each slice is broadcast and run over the index, first the annuli the queries lie in,
then what the scores found there do not rule out.  Vectors of blocks that no query of
the slice needs are never unpacked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare, saved

PIVOTS = 64
#: Rows whose vectors are drawn as pivots, and rows that a block of the index holds.
SAMPLE = 2000
BLOCK = 512
#: Bytes of query vectors that are broadcast at a time.
SLICE_BYTES = 8 << 20
SCALE = 1024
EXACT = 1 << 53


def quantised(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, v): components floor(1024 * x); rows that take no part are gone.

    Those are: a vector that is null, empty, or holds a null or non-finite component.
    Components beyond a long become the nearest long.
    """
    values = F.transform(F.col(vector), lambda x: x.cast("double"))
    bad = F.exists(values, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    good = rows.select(F.col(vec_id).cast("long").alias("vec_id"), values.alias("x")).where(F.col("x").isNotNull() & (F.size("x") > 0) & ~bad)
    return good.select("vec_id", F.transform("x", lambda x: F.floor(x * SCALE)).alias("v"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _augmented(v: np.ndarray, top: int) -> np.ndarray:
    v = v.astype(np.float64)
    return np.hstack([v, np.sqrt(np.maximum(0, top - (v * v).sum(axis=1)))[:, None]])


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None] - 2 * a @ b.T))


def _scores(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Integer inner products, a score beyond a long as the nearest long.

    Doubles hold a product exactly where the norms' product is below 2^53, which no sum
    of its terms exceeds; the few others go by Python's integers.
    """
    a, b = q.astype(np.float64), v.astype(np.float64)
    large = np.sqrt((a * a).sum(axis=1))[:, None] * np.sqrt((b * b).sum(axis=1)) >= EXACT
    out = np.where(large, 0, a @ b.T).astype(np.int64)
    for i, j in zip(*np.nonzero(large)):
        exact = sum(x * y for x, y in zip(q[i].tolist(), v[j].tolist()))
        out[i, j] = min(max(exact, -(1 << 63)), (1 << 63) - 1)
    return out


def pivots(vectors: DataFrame, top: int, dim: int, n: int = PIVOTS, sample: int = SAMPLE) -> np.ndarray:
    """`n` vectors far from each other, of `sample` vectors drawn by a hash of id and vector."""
    drawn = vectors.select("v", F.xxhash64(F.lit(5), "vec_id", "v").alias("h")).orderBy("h").limit(sample).collect()
    pool = _augmented(np.array([r["v"] for r in drawn], np.int64).reshape(-1, dim), top)
    chosen, gap = [0], _distances(pool, pool[:1])[:, 0]
    while len(chosen) < min(n, len(pool)) and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, _distances(pool, pool[chosen[-1:]])[:, 0])
    return pool[chosen]


def build_index(vectors: DataFrame, at: np.ndarray, top: int, dim: int, block: int = BLOCK) -> DataFrame:
    """Blocks (pivot, r_min, r_max, ids, vectors) of rows sorted by pivot and distance, written.

    Every row is indexed.  `ids` holds a block's ids, then a byte each: is the id not null?
    """
    spark = vectors.sparkSession
    shared = spark.sparkContext.broadcast(at)

    def keyed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            d = _distances(_augmented(_matrix(batch.column(1), dim), top), shared.value) if batch.num_rows else np.zeros((0, 1))
            near = d.argmin(axis=1) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(near)), near])], names=["vec_id", "v", "pivot", "r"]
            )

    def blocks(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []

        def made(rows) -> pa.RecordBatch:
            pivot, r, ids, has, v = rows
            return pa.RecordBatch.from_arrays(
                [pa.array([int(pivot[0])], pa.int32()), pa.array([float(r.min())]), pa.array([float(r.max())]), pa.array([ids.tobytes() + has.tobytes()], pa.binary()), pa.array([v.tobytes()], pa.binary())],
                names=["pivot", "r_min", "r_max", "ids", "vectors"],
            )

        for batch in it:
            if not batch.num_rows:
                continue
            ids = batch.column(0)
            new = [batch.column(2).to_numpy(), batch.column(3).to_numpy(), ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False), _matrix(batch.column(1), dim)]
            rows = [np.concatenate(x) for x in zip(held, new)] if held else new
            edges = np.concatenate([[0], np.flatnonzero(np.diff(rows[0])) + 1, [len(rows[0])]])
            for a, b in zip(edges[:-1], edges[1:]):
                while b - a >= 2 * block or (b - a >= block and b < len(rows[0])):
                    yield made([x[a : a + block] for x in rows])
                    a += block
                if b < len(rows[0]):
                    if b > a:
                        yield made([x[a:b] for x in rows])
                else:
                    held = [x[a:b] for x in rows]
        if held and len(held[0]):
            yield made(held)

    rows = vectors.mapInArrow(keyed, "vec_id long, v array<bigint>, pivot int, r double")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    ordered = rows.repartitionByRange(parts, "pivot", "r", "vec_id", "v").sortWithinPartitions("pivot", "r", "vec_id", "v")
    return saved(ordered.mapInArrow(blocks, "pivot int, r_min double, r_max double, ids binary, vectors binary"))


class Search:
    """The best k of each query in the blocks it is shown, each query from its narrowest gap outwards.

    known: the k-th best score of each query so far; None: only annuli that hold the
    query are searched, for a first such score.  A query is an id and a vector; rows
    equal to it in both are left out here.
    """

    def __init__(self, ids: np.ndarray, q: np.ndarray, far: np.ndarray, top: float, k: int, known: np.ndarray | None):
        self.ids, self.q, self.far, self.top, self.k = ids, q, far, top, k
        self.norms = (q.astype(np.float64) ** 2).sum(axis=1)
        self.first = known is None
        self.least = np.full(len(ids), np.iinfo(np.int64).min) if known is None else known.copy()
        self.best = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))] * len(ids)
        self.visited = 0

    def visit(self, pivot: np.ndarray, r_min: np.ndarray, r_max: np.ndarray, ids: list, vectors: list) -> None:
        """Blocks by columns; the last two are Arrow scalars, unpacked where some query needs them."""
        dim, far, least = self.q.shape[1], self.far, self.least
        at = far[:, pivot].T
        gaps = np.maximum(0, np.maximum(r_min[:, None] - at, at - r_max[:, None]))
        near = far.argmin(axis=1)
        for b in np.argsort(gaps.min(axis=1), kind="stable"):
            if self.first:
                want = np.flatnonzero((gaps[b] == 0) & (near == pivot[b]))
            else:
                gap = np.maximum(0, gaps[b] - 1e-6 * (1 + at[b]))
                want = np.flatnonzero(((self.norms + self.top - gap * gap) / 2 + 1 >= least) | (least == np.iinfo(np.int64).min))
            if not len(want):
                continue
            self.visited += 1
            v = np.frombuffer(vectors[b].as_buffer(), np.int64).reshape(-1, dim)
            raw = ids[b].as_buffer()
            vec_ids, has = np.frombuffer(raw, np.int64, len(v)), np.frombuffer(raw, bool, len(v), 8 * len(v))
            for row, w in zip(_scores(self.q[want], v), want):
                hit = np.flatnonzero(row >= least[w])
                same = has[hit] & (vec_ids[hit] == self.ids[w])
                if same.any():
                    hit = hit[~(same & (v[hit] == self.q[w]).all(axis=1))]
                if len(hit):
                    s, i, h = (np.concatenate(x) for x in zip(self.best[w], (row[hit], vec_ids[hit], has[hit])))
                    order = np.lexsort((i, ~h, -s))[: self.k]
                    self.best[w] = s[order], i[order], h[order]
                    if len(order) == self.k:
                        least[w] = max(least[w], s[order[-1]])


def _run(index: DataFrame, ids: np.ndarray, q: np.ndarray, at: np.ndarray, top: float, k: int, known: np.ndarray | None) -> DataFrame:
    """Rows (query, vec_id, score), query by its position, for each task the best k of each in the blocks it searches."""
    own = _augmented(q, top)
    own[:, -1] = 0
    shared = index.sparkSession.sparkContext.broadcast((ids, q, _distances(own, at), known))

    def search(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q, far, known = shared.value
        one = Search(ids, q, far, top, k, known)
        for batch in it:
            if batch.num_rows:
                one.visit(*(batch.column(c).to_numpy() for c in range(3)), *(list(batch.column(c)) for c in (3, 4)))
        for at in range(0, len(ids), 4096):
            some = one.best[at : at + 4096]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(np.arange(at, at + len(some)), [len(b[0]) for b in some])),
                    pa.array(np.concatenate([b[1] for b in some]), mask=~np.concatenate([b[2] for b in some])),
                    pa.array(np.concatenate([b[0] for b in some])),
                ],
                names=["query", "vec_id", "score"],
            )

    return index.mapInArrow(search, "query long, vec_id long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(rows: DataFrame, every: int = 100, k: int = 10, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of all other rows for each row whose id is divisible by `every`.

    Score: integer inner product of floor(1024 * x), a score beyond a long being the
    nearest long.  Ties go to the smaller vec_id, null last.  Every row is a candidate,
    but the query's own: rows that share its id or are equal to it too, and rows without
    an id, which ask nothing.  Each of several rows with a queried id has k rows of its
    own.  Vectors of another length than most have (the longer on a tie) have no product
    with them and take no part.  Fewer rows than k: all of them; an empty table: none.
    Other columns are not read, whatever their names.
    """
    spark = rows.sparkSession
    prepare(spark)
    schema = "query_id long, rank int, vec_id long, score long"
    vectors = quantised(rows)
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    dims = vectors.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.max(square).alias("top")).orderBy(F.desc("n"), F.desc("d")).first()
    if dims is None:
        return spark.createDataFrame([], schema)
    dim, top = dims["d"], dims["top"]
    vectors = vectors.where(F.size("v") == dim)
    at = pivots(vectors, top, dim)
    index = build_index(vectors, at, top, dim)
    # rows equal in id and vector ask the same: once
    asked = saved(vectors.where(F.pmod("vec_id", F.lit(every)) == 0).groupBy("vec_id", "v").agg(F.count(F.lit(1)).alias("rows")))
    n = asked.count()
    slices = max(1, -(-n * dim * 8 // slice_bytes))
    found = None
    for s in range(slices):
        part = asked.where(F.pmod(F.xxhash64("vec_id", "v"), F.lit(slices)) == s).orderBy("vec_id", "v").collect()
        if not part:
            continue
        ids, q = np.array([r["vec_id"] for r in part], np.int64), np.array([r["v"] for r in part], np.int64).reshape(-1, dim)
        first = _best(_run(index, ids, q, at, top, k, None), k).where(F.col("rank") == k).select("query", "score")
        known = np.full(len(ids), np.iinfo(np.int64).min)
        for r in first.collect():
            known[r["query"]] = r["score"]
        new = _run(index, ids, q, at, top, k, known)
        # a query's equals are candidates of each other
        twins = [(w, i, int(_scores(q[[w]], q[[w]])[0, 0]), min(k, m - 1)) for w, (i, m) in enumerate((r["vec_id"], r["rows"]) for r in part) if m > 1]
        if twins:
            held = spark.createDataFrame(twins, "query long, vec_id long, score long, copies int")
            new = new.union(held.select("query", "vec_id", "score", F.explode(F.sequence(F.lit(1), "copies")).alias("_copy")).drop("_copy"))
        names = spark.createDataFrame([(w, r["vec_id"], r["rows"]) for w, r in enumerate(part)], "query long, query_id long, rows long")
        each_row = F.explode(F.sequence(F.lit(1).cast("long"), "rows")).alias("_row")
        new = _best(new, k).join(F.broadcast(names), "query").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score", each_row).drop("_row")
        new = saved(new) if slices > 1 else new  # else one plan would hold all slices
        found = new if found is None else found.union(new)
    return spark.createDataFrame([], schema) if found is None else found


ORACLE = """
WITH e AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT q.r AS r, q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM e q JOIN e c ON q.vec_id % 100 = 0 AND q.r <> c.r AND len(q.v) = len(c.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST)::INTEGER AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
