"""Decay of a weight over hops: column builders with a driver twin, and their verification."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .num import col

MAX_HOPS = 10_000


@dataclass(frozen=True)
class Policy:
    """How a weight decays: `column(w, hop)`, its twin `value(w, hop)`, and a check of the parameters."""

    id: str
    column: Callable[[Column, Column], Column]
    value: Callable[[float, int], float]
    valid: Callable[[], bool]
    epsilon: float = 0.001

    def apply(self, weight, hop) -> Column:
        return self.column(col(weight), col(hop))


def geometric(decay: float) -> Policy:
    return Policy(
        f"geometric({decay})",
        lambda w, hop: w * F.pow(F.lit(float(decay)), hop + 1),
        lambda w, hop: w * decay ** (hop + 1),
        lambda: 0 < decay < 1,
    )


def harmonic() -> Policy:
    return Policy("harmonic", lambda w, hop: w / (hop + 2), lambda w, hop: w / (hop + 2), lambda: True)


def cutoff(hops: int) -> Policy:
    return Policy(
        f"cutoff({hops})",
        lambda w, hop: F.when(hop < hops, w).otherwise(F.lit(0.0)),
        lambda w, hop: w if hop < hops else 0.0,
        lambda: isinstance(hops, int) and hops > 0,
    )


def verify(policy: Policy, max_hops: int = MAX_HOPS) -> bool:
    """Are the parameters valid, and does a full weight fall to epsilon within the hops?"""
    return policy.valid() and any(policy.value(1.0, hop) <= policy.epsilon for hop in range(max_hops))


def verified(policy: Policy, max_hops: int = MAX_HOPS) -> Column:
    """The same as a column, computed by Spark."""
    hops = F.sequence(F.lit(0), F.lit(max_hops - 1))
    return F.lit(policy.valid()) & F.exists(hops, lambda hop: policy.apply(F.lit(1.0), hop) <= policy.epsilon)
