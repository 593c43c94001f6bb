"""Encodings: arrays as base64 of little-endian bytes, ordered maps, property bags, references."""

from __future__ import annotations

import base64

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .num import col


def _encode(kind: str):
    @F.pandas_udf("string")
    def encode(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else base64.b64encode(np.asarray(v, kind).tobytes()).decode())

    return encode


def _decode(kind: str, spark_type: str):
    @F.pandas_udf(spark_type)
    def decode(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else np.frombuffer(base64.b64decode(v), kind))

    return decode


def encode_floats(v: Column) -> Column:
    return _encode("<f4")(v)


def decode_floats(s: Column) -> Column:
    return _decode("<f4", "array<float>")(s)


def encode_signs(v: Column) -> Column:
    return _encode("i1")(v)


def decode_signs(s: Column) -> Column:
    return _decode("i1", "array<tinyint>")(s)


def encode_map(m: Column) -> Column:
    """A map as an array of (key, value), in its order."""
    return F.map_entries(m)


def decode_map(entries: Column) -> Column:
    return F.map_from_entries(entries)


def property_bag(json: Column) -> Column:
    """A JSON object as a map of JSON values as text; null for anything that is no object."""
    return F.when(F.trim(json).startswith("{"), F.from_json(json, "map<string,string>"))


def encode_bag(m: Column) -> Column:
    return F.to_json(m)


def checksum(*columns: Column) -> Column:
    """SHA-256 of a row's JSON form."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def qualify(entity, graph) -> Column:
    """graph:entity; null where the entity has a colon of its own."""
    return F.when(~F.contains(col(entity), F.lit(":")), F.concat_ws(":", col(graph), col(entity)))


def parse_ref(ref: Column, graph=None) -> Column:
    """Struct (graph_id, entity_id) cut at the first colon; without one the graph is `graph`, or null."""
    at = F.instr(ref, ":")
    return F.struct(
        F.when(at > 0, F.substring(ref, F.lit(1), at - 1)).otherwise(col(graph).cast("string")).alias("graph_id"),
        F.when(at > 0, F.substring(ref, at + 1, F.length(ref))).otherwise(ref).alias("entity_id"),
    )
