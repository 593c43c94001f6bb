"""Bounded paths of fuzzy weight, and the fixpoint of inference rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fuzzy import EPSILON, t_norm, t_norm_by
from ..functions.num import clamp
from ..functions.policy import Policy
from ..plans.lineage import saved
from .ontology import Rule, stratify


def paths(edges: DataFrame, starts: DataFrame, hops: int, norm: str = "product", epsilon: float = EPSILON, by_edge: bool = False) -> DataFrame:
    """(source_id, target_id, weight, hops): the strongest simple path of each pair within `hops` edges.

    Paths start at `starts` (id).  Weights fold by the norm, or with `by_edge` by each
    edge's own t_norm where it names one; a path dies at or below epsilon.  No norm raises
    a weight, so of all paths to a pair only the strongest goes on at each hop, and a
    detour over a circle never wins: the frontier holds a row a pair, whatever the degrees.
    """
    step = edges.select(F.col("source_id").alias("_from"), F.col("target_id").alias("_to"), F.col("weight").alias("_w"), *(["t_norm"] if by_edge else []))
    step = step.where("_from <> _to")
    strongest = lambda df: df.groupBy("source_id", "target_id").agg(F.max("weight").alias("weight"))
    found = None
    frontier = None
    for hop in range(1, hops + 1):
        if frontier is None:
            first = step.join(starts.select(F.col("id").alias("_from")).distinct(), "_from", "left_semi")
            new = first.select(F.col("_from").alias("source_id"), F.col("_to").alias("target_id"), F.col("_w").alias("weight"))
        else:
            met = frontier.join(step, F.col("target_id") == F.col("_from")).where("_to <> source_id")
            folded = t_norm(norm)(F.col("weight"), F.col("_w"))
            if by_edge:
                folded = F.coalesce(t_norm_by(F.col("t_norm"), F.col("weight"), F.col("_w")), folded)
            new = met.select("source_id", F.col("_to").alias("target_id"), folded.alias("weight")).where(F.col("weight") > epsilon)
        frontier = strongest(new)
        frontier = saved(frontier) if hop > 1 and hop < hops else frontier
        part = frontier.select("source_id", "target_id", "weight", F.lit(hop).alias("hops"))
        found = part if found is None else found.union(part)
    best = found.groupBy("source_id", "target_id").agg(F.max(F.struct("weight", (-F.col("hops")).alias("h"))).alias("b"))
    return best.select("source_id", "target_id", F.col("b.weight").alias("weight"), (-F.col("b.h")).alias("hops"))


FACT = ["source_id", "target_id", "verb_type"]


def _derive(rule: Rule, facts: DataFrame, norm: str, policy: Policy | None) -> DataFrame:
    """(source_id, target_id, verb_type, weight, hops) a rule derives: all positive conditions met, no negated one.

    A derived fact is one hop further from what was given than the furthest condition,
    and decays by that hop.
    """
    met = None
    for condition in rule.conditions:
        own = facts.where(F.col("verb_type") == condition.verb).select("source_id", "target_id", F.col("weight").alias("_w"), F.col("hops").alias("_h"))
        if condition.negated:
            continue
        if met is None:
            met = own.withColumnsRenamed({"_w": "weight", "_h": "hops"})
        else:
            both = met.join(own, ["source_id", "target_id"])
            met = both.select("source_id", "target_id", t_norm(norm)(F.col("weight"), F.col("_w")).alias("weight"), F.greatest("hops", "_h").alias("hops"))
    if met is None:  # a rule of negations only says nothing of a pair
        return facts.limit(0).select(*FACT, "weight", "hops")
    for condition in rule.conditions:
        if condition.negated:
            met = met.join(facts.where(F.col("verb_type") == condition.verb).select("source_id", "target_id"), ["source_id", "target_id"], "left_anti")
    weight: Column = F.col("weight") * rule.factor
    if policy is not None:
        weight = policy.apply(weight, F.col("hops"))
    return met.select("source_id", "target_id", F.lit(rule.derives).alias("verb_type"), clamp(weight).alias("weight"), (F.col("hops") + 1).alias("hops"))


def fixpoint(
    edges: DataFrame, rules: list[Rule], policies: dict[str, Policy] | None = None, norm: str = "product", epsilon: float = EPSILON, max_rounds: int | None = None
) -> DataFrame:
    """(source_id, target_id, verb_type, weight, authority) of all facts, given and inferred.

    Strata go up; inside one, rules fire until no pair is new and no weight grows by
    more than 1e-6.  Of several derivations the strongest counts, of equal ones that of
    fewest hops; results at or below epsilon are dropped.  Rules with a cycle through
    negation raise, and so does a stratum that `max_rounds`, if given, don't finish.
    """
    levels = stratify(rules, strict=True)
    if not levels.ok:
        raise ValueError(f"rules form a cycle through negation: {' -> '.join(levels.cycle)}")

    def best(df: DataFrame) -> DataFrame:
        top = df.groupBy(*FACT).agg(F.max(F.struct("weight", (-F.col("hops")).alias("h"))).alias("b"))
        return top.select(*FACT, F.col("b.weight").alias("weight"), (-F.col("b.h")).alias("hops"))

    given = saved(best(edges.select(*FACT, F.col("weight").cast("double").alias("weight"), F.lit(0).alias("hops"))))
    facts = given
    for level in sorted(set(levels.strata.values())):
        own = [r for r in rules if levels.strata[r.id] == level]
        turn = 0
        while True:
            made = None
            for rule in own:
                new = _derive(rule, facts, norm, (policies or {}).get(rule.policy_id)).where(F.col("weight") > epsilon)
                made = new if made is None else made.union(new)
            old = facts.select(*FACT, F.col("weight").alias("_old"))
            joined = best(made).join(old, FACT, "left").where(F.col("_old").isNull() | (F.col("weight") > F.col("_old") + 1e-6))
            grown = saved(joined.drop("_old"))
            if grown.isEmpty():
                break
            turn += 1
            if max_rounds is not None and turn > max_rounds:
                raise RuntimeError(f"rules of stratum {level} still derive facts after {max_rounds} rounds")
            facts = saved(best(facts.union(grown)))
    known = given.select(*FACT, F.lit("given").alias("_given"))
    out = facts.join(known, FACT, "left")
    return out.select(*FACT, "weight", F.when(F.col("_given").isNull(), "inference").otherwise("player").alias("authority"))


def route(tier: str, cached: DataFrame | None, live: DataFrame) -> DataFrame:
    """The table a freshness tier reads: `cached` if there is one, else the live plan; `graph` and `worker` read the live plan."""
    if tier not in ("cached", "graph", "worker"):
        raise ValueError(f"unknown tier {tier!r}")
    return cached if tier == "cached" and cached is not None else live
