"""Beliefs of many sources about a proposition, folded in order, with conflicts set aside."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import belief as B

FIELDS = ("proposition", "m_true", "m_false", "m_unknown", "bel", "pl", "updated_at")


def fold(beliefs: DataFrame, order: str = "ord") -> DataFrame:
    """(proposition, FIELDS) of rows (proposition, ord, b): combined in order; null masses in total conflict.

    The rounded rule isn't associative, so a proposition's sources are folded by one
    task; they are gathered as structs of seven numbers.
    """
    rows = beliefs.groupBy("proposition").agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("b")))).alias("rows"))
    folded = rows.select("proposition", B.fold(F.transform("rows", lambda r: r["b"])).alias("f"))
    return folded.select("proposition", *[F.col(f"f.{c}").alias(c) for c in FIELDS[1:]])


def settle(pairs: DataFrame, policy: str, threshold: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b, a_authority, b_authority, ...) combined, with those in conflict settled by a policy.

    Pairs whose conflict is at or above `threshold` go by the policy: retain (higher
    authority), blend (equal weights) or escalate.  Returns the pairs with `result`,
    and the escalated ones as records.
    """
    k = B.conflict(F.col("a"), F.col("b"))
    open_ = k >= threshold
    if policy == "retain":
        other = B.retain(F.col("a"), F.col("a_authority"), F.col("b"), F.col("b_authority"))
    elif policy == "blend":
        other = B.blend(F.col("a"), 1.0, F.col("b"), 1.0)
    elif policy == "escalate":
        settled = pairs.where(~open_).withColumn("result", B.combine(F.col("a"), F.col("b")))
        return settled, pairs.where(open_).select(B.escalate(F.col("a"), F.col("b")).alias("conflict"))
    else:
        raise ValueError(f"unknown conflict policy {policy!r}")
    return pairs.withColumn("result", F.when(open_, other).otherwise(B.combine(F.col("a"), F.col("b")))), pairs.limit(0).select(
        B.escalate(F.col("a"), F.col("b")).alias("conflict")
    )


def best_by_authority(beliefs: DataFrame, key: str, authority: str = "authority", order: str = "ord") -> DataFrame:
    """Of many rows for a key the one of the highest authority, the first of these."""
    rank = F.struct(B.rank(F.col(authority)).alias("r"), (-F.col(order)).alias("o"))
    columns = [c for c in beliefs.columns if c != key]
    return beliefs.groupBy(key).agg(F.max_by(F.struct(*columns), rank).alias("row")).select(key, "row.*")
