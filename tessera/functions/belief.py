"""Belief in a proposition as masses for true, false and unknown, and their combination."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .num import clamp, col, let, r6

TOLERANCE = 1e-4
#: Authorities from the weakest.
AUTHORITY = {"world": 0, "inference": 1, "player": 2, "system": 3}


def _struct(proposition, t, f, u, at) -> Column:
    return F.struct(
        col(proposition).alias("proposition"), t.alias("m_true"), f.alias("m_false"), u.alias("m_unknown"),
        t.alias("bel"), r6(t + u).alias("pl"), col(at).cast("long").alias("updated_at"),
    )


def masses_valid(t, f, u) -> Column:
    """Do the clamped masses sum to one?"""
    return F.abs(r6(clamp(t) + clamp(f) + clamp(u)) - 1) <= TOLERANCE


def create(proposition, t, f, u, at=0, strict: bool = True) -> Column:
    """Belief struct; masses that don't sum to one raise, or give null where `strict` is off."""
    made = _struct(proposition, clamp(t), clamp(f), clamp(u), at)
    bad = F.raise_error(F.lit("belief masses must sum to 1")) if strict else F.lit(None)
    return F.when(masses_valid(t, f, u), made).otherwise(bad.cast("struct<proposition:string,m_true:double,m_false:double,m_unknown:double,bel:double,pl:double,updated_at:bigint>"))


def unknown(proposition, at=0) -> Column:
    return _struct(proposition, F.lit(0.0), F.lit(0.0), F.lit(1.0), at)


def discount(b: Column, fidelity) -> Column:
    """Both masses scaled by the fidelity; what they lose is unknown."""
    t, f = r6(b["m_true"] * col(fidelity)), r6(b["m_false"] * col(fidelity))
    return _struct(b["proposition"], clamp(t), clamp(f), clamp(r6(1 - t - f)), b["updated_at"])


def conflict(a: Column, b: Column) -> Column:
    """Mass that the two beliefs give to opposite verdicts."""
    return r6(a["m_true"] * b["m_false"] + a["m_false"] * b["m_true"])


def combine(a: Column, b: Column, at=0) -> Column:
    """Dempster's rule, rounded at each step; null in total conflict.  The proposition is the first one's."""

    def masses(p: Column) -> Column:
        x, y, rest = p["a"], p["b"], 1 - p["k"]
        t = r6((x["m_true"] * y["m_true"] + x["m_true"] * y["m_unknown"] + x["m_unknown"] * y["m_true"]) / rest)
        f = r6((x["m_false"] * y["m_false"] + x["m_false"] * y["m_unknown"] + x["m_unknown"] * y["m_false"]) / rest)
        return F.when(rest > 0, F.struct(x["proposition"].alias("p"), t.alias("t"), f.alias("f")))

    def whole(m: Column) -> Column:
        return F.when(m.isNotNull(), _struct(m["p"], m["t"], m["f"], r6(F.greatest(F.lit(0.0), 1 - m["t"] - m["f"])), at))

    both = let(F.struct(a.alias("a"), b.alias("b")), lambda p: F.struct(p["a"].alias("a"), p["b"].alias("b"), conflict(p["a"], p["b"]).alias("k")))
    return let(let(both, masses), whole)


def fold(beliefs: Column, at=0) -> Column:
    """Combination of an array in its order; the rule is rounded, so the order counts.  Null in total conflict."""
    first = F.get(beliefs, F.lit(0))
    rest = F.slice(beliefs, 2, F.greatest(F.size(beliefs) - 1, F.lit(0)))
    return F.aggregate(rest, first, lambda acc, b: combine(acc, b, at))


def rank(authority) -> Column:
    out = F.lit(None).cast("int")
    for name, level in AUTHORITY.items():
        out = F.when(col(authority) == name, F.lit(level)).otherwise(out)
    return out


def retain(a: Column, a_authority, b: Column, b_authority, at=0) -> Column:
    """The belief of the higher authority, the first on a tie, stamped anew."""
    kept = F.when(rank(a_authority) >= rank(b_authority), a).otherwise(b)
    return _struct(kept["proposition"], kept["m_true"], kept["m_false"], kept["m_unknown"], at)


def blend(a: Column, a_weight, b: Column, b_weight, at=0) -> Column:
    """Weighted mean of the masses; null where the weights sum to zero."""
    total = col(a_weight) + col(b_weight)
    mean = lambda m: (a[m] * col(a_weight) + b[m] * col(b_weight)) / F.when(total != 0, total)
    t, f, u = (clamp(mean(m)) for m in ("m_true", "m_false", "m_unknown"))
    return F.when(total != 0, _struct(a["proposition"], t, f, u, at))


def escalate(a: Column, b: Column) -> Column:
    """Record of a conflict for someone else to settle."""
    return F.struct(a["proposition"].alias("proposition"), a.alias("first"), b.alias("second"), conflict(a, b).alias("conflict_k"))
