"""Hyperdimensional memory: vectors of +1 and -1, bound by product and remembered by majority."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .num import col
from .prng import Streams, string_hash
from .vector import _checked, dot

SCALE = 10


def base_signs(ids, seed: int, dim: int) -> np.ndarray:
    """A row of +1 and -1 for each id, the same for the same id and seed."""
    streams = Streams([string_hash(i) ^ seed & 0xFFFFFFFF for i in ids])
    draws = [streams.floats() for _ in range(dim)]
    return np.where(np.stack(draws, axis=1) < 0.5, -1, 1).astype(np.int8) if draws else np.zeros((len(ids), 0), np.int8)


def base_vector(id_: Column, seed: int, dim: int) -> Column:
    """Base vector of an id column, array<tinyint>; null for null."""

    @F.pandas_udf("array<tinyint>")
    def make(ids: pd.Series) -> pd.Series:
        known = ids.dropna().unique()
        rows = dict(zip(known, base_signs(known, seed, dim)))
        return ids.map(rows.get)

    return make(id_)


def relation_floats(ids, seed: int, dim: int) -> np.ndarray:
    """A row of floats in [-1, 1) for each verb id."""
    streams = Streams([string_hash(i) ^ seed & 0xFFFFFFFF for i in ids])
    draws = [streams.floats() * 2 - 1 for _ in range(dim)]
    return np.stack(draws, axis=1).astype(np.float32) if draws else np.zeros((len(ids), 0), np.float32)


def relation_vector(verb: Column, seed: int, dim: int) -> Column:
    """Relation embedding of a verb column, array<float>."""

    @F.pandas_udf("array<float>")
    def make(verbs: pd.Series) -> pd.Series:
        known = verbs.dropna().unique()
        rows = dict(zip(known, relation_floats(known, seed, dim)))
        return verbs.map(rows.get)

    return make(verb)


def empty_bundle(dim: int) -> Column:
    return F.array_repeat(F.lit(0).cast("tinyint"), dim)


def binarise(v: Column) -> Column:
    return F.transform(v, lambda x: F.when(x >= 0, 1).otherwise(-1).cast("tinyint"))


def bind(a: Column, b: Column) -> Column:
    """Element products; vectors of other sizes raise."""
    sized = F.when(F.size(a) == F.size(b), b).otherwise(F.raise_error(F.lit("vectors differ in dimension")).cast("array<tinyint>"))
    return F.zip_with(a, sized, lambda x, y: (x * y).cast("tinyint"))


def repetitions(weight, scale: int = SCALE) -> Column:
    return F.greatest(F.lit(1).cast("long"), F.floor(col(weight).cast("double") * scale))


def remember(bundle: Column, experience: Column, weight, scale: int = SCALE) -> Column:
    """The bundle with the experience added as often as its weight says, made signs again."""
    n = repetitions(weight, scale)
    return binarise(F.zip_with(bundle.cast("array<bigint>"), experience.cast("array<bigint>"), lambda b, e: b + e * n))


def remember_all(bundle: Column, experiences: Column, scale: int = SCALE) -> Column:
    """`remember` over an array of structs (experience, weight) in its order."""
    return F.aggregate(experiences, bundle.cast("array<tinyint>"), lambda acc, e: remember(acc, e["experience"], e["weight"], scale))


def recall(bundle: Column, query: Column) -> Column:
    """Likeness in [0, 1]: half of one plus the mean product."""
    return _checked((dot(bundle, query) / F.size(bundle) + 1) / 2, bundle, query)
