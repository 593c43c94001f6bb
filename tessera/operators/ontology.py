"""The verbs of a graph: registry, subtype closure, stratified rules.

Verbs, taxonomy edges and rules are metadata of the driver.  What touches edges - the
polymorphic filter, inverses, implications, exclusions - is a join with a small table.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fuzzy import T_NORMS
from ..functions.policy import Policy, verify

KINDS = ("isSubtypeOf", "isInverseOf", "implies", "excludes", "requiresPolicy")


@dataclass(frozen=True)
class Verb:
    id: str
    label: str
    domain: tuple[str, ...] = ()
    range: tuple[str, ...] = ()
    default_t_norm: str = "product"
    default_policy_id: str | None = None
    symmetric: bool = False
    cross_graph_allowed: bool = False
    stratum: int = 0


@dataclass(frozen=True)
class TaxonomyEdge:
    kind: str
    source: str
    target: str
    factor: float | None = None
    resolution: str | None = None
    policy_id: str | None = None


@dataclass(frozen=True)
class Condition:
    verb: str
    negated: bool = False


@dataclass(frozen=True)
class Rule:
    id: str
    derives: str
    conditions: tuple[Condition, ...]
    policy_id: str | None = None
    factor: float = 1.0


@dataclass(frozen=True)
class Strata:
    """Stratum by rule, or the cycle through negation that forbids one."""

    ok: bool
    strata: dict[str, int] = field(default_factory=dict)
    cycle: tuple[str, ...] = ()


class OntologyError(ValueError):
    pass


def stratify(rules: list[Rule], strict: bool = False) -> Strata:
    """Strata such that a rule comes after all rules whose results it negates.

    Only direct negation counts and a rule's negation of its own verb doesn't; `strict`
    also refuses cycles that go through positive conditions and back through a negation.
    """
    makers: dict[str, list[str]] = {}
    for rule in rules:
        makers.setdefault(rule.derives, []).append(rule.id)
    after = {r.id: {m for c in r.conditions if c.negated for m in makers.get(c.verb, ()) if m != r.id} for r in rules}
    if strict:
        needs = {r.id: {m for c in r.conditions for m in makers.get(c.verb, ())} for r in rules}
        for rule in rules:
            for condition in rule.conditions:
                for maker in makers.get(condition.verb, ()) if condition.negated else ():
                    if trail := _trail(needs, maker, rule.id):
                        return Strata(False, cycle=(rule.id, *trail))
    level: dict[str, int] = {}
    ready = deque(r.id for r in rules if not after[r.id])
    waiting = {i: set(before) for i, before in after.items()}
    while ready:
        one = ready.popleft()
        level[one] = max((level[b] + 1 for b in after[one]), default=0)
        for other, before in waiting.items():
            if one in before:
                before.discard(one)
                if not before:
                    ready.append(other)
    if len(level) == len(after):
        return Strata(True, level)
    stuck = {i: after[i] - set(level) for i in after if i not in level}
    for start in stuck:
        if trail := _trail(stuck, start, start, True):
            return Strata(False, cycle=tuple(trail))
    return Strata(False)


def _trail(graph: dict[str, set[str]], start: str, goal: str, step: bool = False) -> list[str]:
    """Nodes of a shortest way from `start` to `goal`, of one step at least if asked; empty if there is none."""
    if start == goal and not step:
        return [start]
    came, ready = {}, deque([start])
    while ready:
        one = ready.popleft()
        for other in sorted(graph.get(one, ())):
            if other == goal:
                way = [goal, one]
                while way[-1] != start:
                    way.append(came[way[-1]])
                return way[::-1]
            if other not in came and other != start:
                came[other] = one
                ready.append(other)
    return []


def implied_rules(edges: list[TaxonomyEdge], keep_factor: bool = False) -> list[Rule]:
    """A rule for each implies edge.  Its factor is left out unless asked for."""
    return [
        Rule(f"__implies:{e.source}:{e.target}", e.target, (Condition(e.source),), None, (e.factor or 1.0) if keep_factor else 1.0)
        for e in edges
        if e.kind == "implies"
    ]


def subtypes(verb: str, edges: list[TaxonomyEdge]) -> set[str]:
    """All verbs below one; the verb itself only where it is below itself."""
    below: dict[str, list[str]] = {}
    for e in edges:
        if e.kind == "isSubtypeOf":
            below.setdefault(e.target, []).append(e.source)
    found, ready = set(), list(below.get(verb, ()))
    while ready:
        one = ready.pop()
        if one not in found:
            found.add(one)
            ready += below.get(one, ())
    return found


class Registry:
    """Verbs, policies, taxonomy and rules; every change is checked and then swapped in whole."""

    def __init__(self) -> None:
        self.verbs: dict[str, Verb] = {}
        self.policies: dict[str, Policy] = {}
        self.taxonomy: list[TaxonomyEdge] = []
        self.rules: dict[str, Rule] = {}

    # -- checks ------------------------------------------------------------------------

    def verb_errors(self, verb: Verb) -> list[str]:
        return _failed(
            (not (verb.id or "").strip(), "id:blank"),
            (verb.id in self.verbs, "id:duplicate"),
            (not (verb.label or "").strip(), "label:blank"),
            (verb.default_t_norm not in T_NORMS, "t_norm:unknown"),
            (verb.default_policy_id is not None and verb.default_policy_id not in self.policies, "policy:unregistered"),
        )

    def taxonomy_errors(self, edge: TaxonomyEdge) -> list[str]:
        itself = edge.source == edge.target
        return _failed(
            (edge.kind not in KINDS, "kind:unknown"),
            (edge.source not in self.verbs, "source:unregistered"),
            (edge.target not in self.verbs, "target:unregistered"),
            (edge.kind in ("isInverseOf", "excludes", "implies") and itself, "edge:self"),
            (edge.kind == "implies" and not (edge.factor is not None and 0 < edge.factor <= 1), "factor:range"),
            (edge.kind == "excludes" and not edge.resolution, "resolution:missing"),
            (edge.kind == "requiresPolicy" and edge.policy_id not in self.policies, "policy:unregistered"),
        )

    def rule_errors(self, rule: Rule) -> list[str]:
        return _failed(
            (not (rule.id or "").strip(), "id:blank"),
            (rule.id in self.rules, "id:duplicate"),
            (rule.derives not in self.verbs, "derives:unregistered"),
            (not rule.conditions, "conditions:none"),
            *((c.verb not in self.verbs, f"condition:unregistered:{c.verb}") for c in rule.conditions),
            (rule.policy_id is not None and rule.policy_id not in self.policies, "policy:unregistered"),
        )

    # -- changes -----------------------------------------------------------------------

    def register_policy(self, name: str, policy: Policy) -> None:
        """Policies may be replaced, but must converge."""
        if not verify(policy):
            raise OntologyError(f"policy {name!r} does not converge")
        self.policies[name] = replace(policy, id=name)

    def register_verb(self, verb: Verb) -> None:
        _refuse("verb", self.verb_errors(verb))
        self._swap({**self.verbs, verb.id: replace(verb, stratum=0)}, self.taxonomy, self.rules)

    def register_taxonomy_edge(self, edge: TaxonomyEdge) -> None:
        _refuse("taxonomy edge", self.taxonomy_errors(edge))
        if edge.kind == "isInverseOf" and self.verbs[edge.source].symmetric:
            raise OntologyError(f"symmetric verb {edge.source!r} is its own inverse")
        self._swap(self.verbs, [*self.taxonomy, edge], self.rules)

    def register_rule(self, rule: Rule) -> None:
        _refuse("rule", self.rule_errors(rule))
        if rule.policy_id is not None and not verify(self.policies[rule.policy_id]):
            raise OntologyError(f"policy {rule.policy_id!r} does not converge")
        self._swap(self.verbs, self.taxonomy, {**self.rules, rule.id: rule})

    def _swap(self, verbs: dict[str, Verb], taxonomy: list[TaxonomyEdge], rules: dict[str, Rule]) -> None:
        """Take the new state, if its rules have strata; a verb's is the highest of the rules that derive it."""
        every = [*rules.values(), *implied_rules(taxonomy)]
        found = stratify(every)
        if not found.ok:
            raise OntologyError(f"rules form a cycle through negation: {' -> '.join(found.cycle)}")
        level: dict[str, int] = {}
        for rule in every:
            level[rule.derives] = max(level.get(rule.derives, 0), found.strata[rule.id])
        self.verbs = {i: replace(v, stratum=level.get(i, 0)) for i, v in verbs.items()}
        self.taxonomy, self.rules = taxonomy, rules

    # -- reads -------------------------------------------------------------------------

    def has_verb(self, verb: str) -> bool:
        return verb in self.verbs

    def verb(self, verb: str) -> Verb | None:
        return self.verbs.get(verb)

    def policy(self, name: str) -> Policy | None:
        return self.policies.get(name)

    def all_verbs(self) -> list[Verb]:
        return list(self.verbs.values())

    def all_rules(self, keep_factor: bool = False) -> list[Rule]:
        return [*self.rules.values(), *implied_rules(self.taxonomy, keep_factor)]

    def subtypes(self, verb: str) -> set[str]:
        return subtypes(verb, self.taxonomy)

    def is_subtype(self, verb: str, ancestor: str) -> bool:
        return verb == ancestor or verb in self.subtypes(ancestor)

    def inverse(self, verb: str) -> str | None:
        """The target of the verb's first inverse edge; the other direction must be registered by itself."""
        return next((e.target for e in self.taxonomy if e.kind == "isInverseOf" and e.source == verb), None)

    def exclusions(self, verb: str) -> list[tuple[str, str]]:
        return [(e.target, e.resolution or "reject") for e in self.taxonomy if e.kind == "excludes" and e.source == verb]

    def implications(self, verb: str) -> list[tuple[str, float]]:
        return [(e.target, 1.0 if e.factor is None else e.factor) for e in self.taxonomy if e.kind == "implies" and e.source == verb]

    def verbs_table(self, spark: SparkSession) -> DataFrame:
        rows = [(v.id, v.label, list(v.domain), list(v.range), v.default_t_norm, v.default_policy_id, v.stratum, v.symmetric, v.cross_graph_allowed) for v in self.verbs.values()]
        return spark.createDataFrame(
            rows,
            "id string, label string, domain array<string>, range array<string>, default_t_norm string, default_policy_id string, stratum int, symmetric boolean, cross_graph_allowed boolean",
        )

    def taxonomy_table(self, spark: SparkSession) -> DataFrame:
        rows = [(e.kind, e.source, e.target, e.factor, e.resolution, e.policy_id) for e in self.taxonomy]
        return spark.createDataFrame(rows, "kind string, source string, target string, factor double, resolution string, policy_id string")


def _failed(*checks: tuple[bool, str]) -> list[str]:
    return [name for bad, name in checks if bad]


def _refuse(what: str, errors: list[str]) -> None:
    if errors:
        raise OntologyError(f"{what} refused: {', '.join(errors)}")


# -- on tables -------------------------------------------------------------------------


def closure(taxonomy: DataFrame) -> DataFrame:
    """(verb, ancestor) of isSubtypeOf edges, transitive, without the verb itself unless it is on a cycle.

    Rounds double the reach, so depth d takes log d of them.
    """
    from ..plans.lineage import saved

    known = saved(taxonomy.where("kind = 'isSubtypeOf'").select(F.col("source").alias("verb"), F.col("target").alias("ancestor")).distinct())
    n = known.count()
    while True:
        step = known.select(F.col("verb").alias("ancestor"), F.col("ancestor").alias("_up"))
        known = saved(known.union(known.join(step, "ancestor").select("verb", F.col("_up"))).distinct())
        n, before = known.count(), n
        if n == before:
            return known


def with_subtypes(edges: DataFrame, verb: str, closed: DataFrame) -> DataFrame:
    """Edges of a verb or of any verb below it."""
    below = closed.where(F.col("ancestor") == verb).select(F.col("verb").alias("verb_type"))
    wanted = below.union(below.sparkSession.createDataFrame([(verb,)], "verb_type string")).distinct()
    return edges.join(wanted, "verb_type", "left_semi")


def inverse_edges(edges: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """The edges that inverses state: ends exchanged, verb the inverse."""
    inverse = taxonomy.where("kind = 'isInverseOf'").groupBy(F.col("source").alias("verb_type")).agg(F.min("target").alias("inverse"))
    return edges.join(inverse, "verb_type").select(
        F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"), F.col("inverse").alias("verb_type"), "weight"
    )


def implied_edges(edges: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """The edges that implications state, weights times the factor (default 1)."""
    from ..functions.num import clamp

    implied = taxonomy.where("kind = 'implies'").select(F.col("source").alias("verb_type"), F.col("target").alias("implied"), F.coalesce("factor", F.lit(1.0)).alias("factor"))
    return edges.join(implied, "verb_type").select("source_id", "target_id", F.col("implied").alias("verb_type"), clamp(F.col("weight") * F.col("factor")).alias("weight"))


def excluded_pairs(existing: DataFrame, incoming: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Incoming edges that exclude an existing edge of the same ends: both ids and weights, policy, and what stays of each."""
    from ..functions.fuzzy import resolve_exclusion

    rules = taxonomy.where("kind = 'excludes'").select(F.col("source").alias("verb_type"), F.col("target").alias("other_verb"), F.coalesce("resolution", F.lit("reject")).alias("policy"))
    old = existing.select(F.col("id").alias("existing_id"), "source_id", "target_id", F.col("verb_type").alias("other_verb"), F.col("weight").alias("existing_weight"))
    new = incoming.select(F.col("id").alias("incoming_id"), "source_id", "target_id", "verb_type", F.col("weight").alias("incoming_weight"))
    met = new.join(rules, "verb_type").join(old, ["source_id", "target_id", "other_verb"])
    resolved = F.lit(None)
    for policy in ("reject", "overwrite", "weaken"):
        resolved = F.when(F.col("policy") == policy, resolve_exclusion(F.col("existing_weight"), F.col("incoming_weight"), policy)).otherwise(resolved)
    return met.select("existing_id", "incoming_id", "policy", "existing_weight", "incoming_weight", resolved.alias("r")).select(
        "existing_id", "incoming_id", "policy", "existing_weight", "incoming_weight", F.col("r.existing").alias("existing_after"), F.col("r.incoming").alias("incoming_after")
    )
