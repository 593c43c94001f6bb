"""Embeddings as arrays: translation scores, one training step, norms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .num import clamp, col, r6

LEARNING_RATE = 0.01


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def same_size(*vectors: Column) -> Column:
    out = F.lit(True)
    for v in vectors[1:]:
        out = out & (F.size(v) == F.size(vectors[0]))
    return out


def _checked(value: Column, *vectors: Column) -> Column:
    wrong = F.raise_error(F.lit("vectors differ in dimension"))
    return F.when(same_size(*vectors), value).otherwise(wrong.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(v), F.lit(0.0), lambda s, x: s + x * x))


def normalise(v: Column) -> Column:
    """Unit vector at six decimals, as floats; a zero vector stays."""
    n = norm(v)
    return F.when(n == 0, v.cast("array<float>")).otherwise(F.transform(doubles(v), lambda x: r6(x / n)).cast("array<float>"))


def distance(a: Column, b: Column) -> Column:
    """Euclidean; over the first's dimensions, null where the second is shorter."""
    return F.sqrt(F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def closeness(a: Column, b: Column) -> Column:
    return 1 / (1 + distance(a, b))


def closeness6(a: Column, b: Column) -> Column:
    """`closeness` at six decimals, so that what differs beyond them ties."""
    return r6(closeness(a, b))


def moved(head: Column, relation: Column) -> Column:
    """head + relation, in doubles."""
    return F.zip_with(doubles(head), doubles(relation), lambda x, y: x + y)


def query_vector(head: Column, relation: Column) -> Column:
    """head + relation, as floats."""
    return F.zip_with(doubles(head), doubles(relation), lambda x, y: (x + y).cast("float"))


def score(head: Column, relation: Column, tail: Column) -> Column:
    """1 / (1 + |head + relation - tail|), in doubles; vectors of other sizes raise."""
    return _checked(closeness(moved(head, relation), tail), head, relation, tail)


def transe_step(head: Column, relation: Column, tail: Column, weight, rate: float = LEARNING_RATE) -> Column:
    """Struct (head, relation, tail) of floats after one step that pulls head + relation to tail."""
    scale = col(weight).cast("double") * rate
    gap = F.zip_with(moved(head, relation), doubles(tail), lambda x, y: x - y)
    delta = F.transform(gap, lambda e: r6(scale * e))

    def pulled(v: Column, share: float) -> Column:
        return F.zip_with(doubles(v), delta, lambda x, d: clamp(r6(x + d * share), -1.0, 1.0)).cast("array<float>")

    return F.struct(pulled(head, -0.5).alias("head"), pulled(relation, -0.5).alias("relation"), pulled(tail, 1.0).alias("tail"))
