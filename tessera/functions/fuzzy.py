"""Triangular norms, path composition and exclusion of fuzzy weights."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .num import clamp, col, sql_clamp

EPSILON = 0.001


def minimum(a, b) -> Column:
    return clamp(F.least(col(a), col(b)))


def product(a, b) -> Column:
    return clamp(col(a) * col(b))


def lukasiewicz(a, b) -> Column:
    return clamp(F.greatest(F.lit(0.0), col(a) + col(b) - 1))


def drastic(a, b) -> Column:
    """The other operand where one is exactly 1, else 0."""
    a, b = col(a), col(b)
    return F.when(a == 1, clamp(b)).when(b == 1, clamp(a)).otherwise(F.lit(0.0))


T_NORMS: dict[str, Callable[..., Column]] = {
    "minimum": minimum,
    "product": product,
    "lukasiewicz": lukasiewicz,
    "drastic": drastic,
}

#: DuckDB twins, for the oracle.
SQL = {
    "minimum": lambda a, b: sql_clamp(f"least({a}, {b})"),
    "product": lambda a, b: sql_clamp(f"({a}) * ({b})"),
    "lukasiewicz": lambda a, b: sql_clamp(f"greatest(0.0, ({a}) + ({b}) - 1)"),
    "drastic": lambda a, b: f"(CASE WHEN ({a}) = 1 THEN {sql_clamp(b)} WHEN ({b}) = 1 THEN {sql_clamp(a)} ELSE 0.0 END)",
}


def t_norm(name: str) -> Callable[..., Column]:
    """The norm of this name; the set is closed."""
    if name not in T_NORMS:
        raise ValueError(f"unknown t-norm {name!r}")
    return T_NORMS[name]


def t_norm_by(name: Column, a, b) -> Column:
    """The norm a column names, row by row; null for an unknown name."""
    out = F.lit(None).cast("double")
    for known, norm in T_NORMS.items():
        out = F.when(name == known, norm(a, b)).otherwise(out)
    return out


def compose_path(weights: Column, name: str = "product", epsilon: float = EPSILON) -> Column:
    """A path's weight: its hops folded by the norm, 0 as soon as a step is at or below epsilon.

    An empty path has weight 0; a path of one hop has that hop's weight as it is.
    """
    norm = t_norm(name)
    step = lambda acc, w: F.when(acc.isNull(), acc).otherwise(F.when(norm(acc, w) > epsilon, norm(acc, w)))
    rest = F.slice(weights, 2, F.greatest(F.size(weights) - 1, F.lit(0)))
    folded = F.aggregate(rest, F.get(weights, F.lit(0)).cast("double"), step)
    return F.when(F.size(weights) == 0, F.lit(0.0)).otherwise(F.coalesce(folded, F.lit(0.0)))


def resolve_exclusion(existing, incoming, policy: str) -> Column:
    """Struct (action, existing, incoming) when two weights exclude each other.

    reject keeps the existing one, overwrite the incoming one, and weaken takes each
    from the other; a weight that is dropped is null.
    """
    existing, incoming, none = col(existing).cast("double"), col(incoming).cast("double"), F.lit(None).cast("double")
    if policy == "reject":
        left, right = existing, none
    elif policy == "overwrite":
        left, right = none, incoming
    elif policy == "weaken":
        left, right = clamp(existing - incoming), clamp(incoming - existing)
    else:
        raise ValueError(f"unknown exclusion policy {policy!r}")
    return F.struct(F.lit(policy).alias("action"), left.alias("existing"), right.alias("incoming"))
