from __future__ import annotations

import pytest

from tessera.functions.policy import cutoff, geometric
from tessera.operators import federation, ontology, projection
from tessera.operators.ontology import Condition, OntologyError, Registry, Rule, TaxonomyEdge, Verb


def registry(*extra):
    r = Registry()
    r.register_policy("fade", geometric(0.5))
    for v in ("attitude", "ally", "friend", "hostile", *extra):
        r.register_verb(Verb(v, v))
    r.register_verb(Verb("peer", "peer", symmetric=True))
    return r


def test_registration(spark):
    r = registry()
    for bad in (Verb("", "x"), Verb("ally", "x"), Verb("n", " "), Verb("n", "x", default_t_norm="?"), Verb("n", "x", default_policy_id="?")):
        with pytest.raises(OntologyError):
            r.register_verb(bad)
    with pytest.raises(OntologyError):
        r.register_policy("never", cutoff(10_000))
    for bad in (
        TaxonomyEdge("implies", "ally", "friend"), TaxonomyEdge("implies", "ally", "friend", 1.5), TaxonomyEdge("implies", "ally", "ally", 0.5), TaxonomyEdge("excludes", "ally", "hostile"),
        TaxonomyEdge("isSubtypeOf", "ally", "?"), TaxonomyEdge("requiresPolicy", "ally", "friend", policy_id="?"), TaxonomyEdge("isInverseOf", "peer", "ally"), TaxonomyEdge("isInverseOf", "ally", "ally"),
    ):
        with pytest.raises(OntologyError):
            r.register_taxonomy_edge(bad)
    assert r.taxonomy == []
    r.register_taxonomy_edge(TaxonomyEdge("requiresPolicy", "ally", "friend", policy_id="fade"))
    r.register_taxonomy_edge(TaxonomyEdge("isInverseOf", "ally", "friend"))
    r.register_taxonomy_edge(TaxonomyEdge("excludes", "ally", "hostile", resolution="weaken"))
    r.register_taxonomy_edge(TaxonomyEdge("implies", "ally", "friend", 0.8))
    assert r.inverse("ally") == "friend" and r.inverse("friend") is None and r.exclusions("ally") == [("hostile", "weaken")] and r.implications("ally") == [("friend", 0.8)]
    assert [x.id for x in r.all_rules()] == ["__implies:ally:friend"] and r.all_rules()[0].factor == 1.0 and r.all_rules(True)[0].factor == 0.8
    assert r.verbs_table(spark).count() == 5 and r.taxonomy_table(spark).count() == 4 and r.has_verb("ally") and r.verb("?") is None and r.policy("fade").id == "fade"


def test_subtypes():
    r = registry()
    for a, b in (("ally", "attitude"), ("hostile", "attitude"), ("friend", "ally")):
        r.register_taxonomy_edge(TaxonomyEdge("isSubtypeOf", a, b))
    assert r.subtypes("attitude") == {"ally", "hostile", "friend"} and r.subtypes("friend") == set()
    assert r.is_subtype("friend", "attitude") and r.is_subtype("ally", "ally") and not r.is_subtype("attitude", "ally")
    r.register_taxonomy_edge(TaxonomyEdge("isSubtypeOf", "attitude", "friend"))
    assert "friend" in r.subtypes("friend")


def test_strata():
    n = lambda v: Condition(v, True)
    assert ontology.stratify([Rule("a", "x", (Condition("y"),)), Rule("b", "y", (Condition("z"),))]).strata == {"a": 0, "b": 0}
    assert ontology.stratify([Rule("a", "x", (n("y"),)), Rule("b", "y", (Condition("z"),)), Rule("c", "w", (n("x"),))]).strata == {"a": 1, "b": 0, "c": 2}
    bad = ontology.stratify([Rule("a", "x", (n("y"),)), Rule("b", "y", (n("x"),)), Rule("c", "w", (n("x"),))])
    assert not bad.ok and bad.cycle[0] == bad.cycle[-1] and set(bad.cycle) == {"a", "b"}
    assert ontology.stratify([Rule("a", "x", (n("x"),))]).ok and not ontology.stratify([Rule("a", "x", (n("x"),))], strict=True).ok
    through = [Rule("a", "x", (n("y"),)), Rule("b", "y", (Condition("x"),))]
    assert ontology.stratify(through).ok and not ontology.stratify(through, strict=True).ok


def test_rules_swap_in_whole():
    r = registry()
    r.register_rule(Rule("a", "ally", (Condition("friend", True),), "fade"))
    with pytest.raises(OntologyError, match="cycle"):
        r.register_rule(Rule("b", "friend", (Condition("ally", True),)))
    assert list(r.rules) == ["a"]
    r.register_rule(Rule("c", "hostile", (Condition("ally", True),)))
    assert r.verb("hostile").stratum == 1 and r.verb("ally").stratum == 0
    for bad in (Rule("", "ally", (Condition("friend"),)), Rule("a", "ally", (Condition("friend"),)), Rule("d", "?", (Condition("?"),), "?"), Rule("d", "ally", ())):
        with pytest.raises(OntologyError):
            r.register_rule(bad)


def test_closure_with_cycle(spark):
    t = spark.createDataFrame([("isSubtypeOf", a, b) for a, b in ("ab", "bc", "cd", "da", "ea")], "kind string, source string, target string")
    got = {(r.verb, r.ancestor) for r in ontology.closure(t).collect()}
    assert got == {(a, b) for a in "abcd" for b in "abcd"} | {("e", b) for b in "abcd"}


def test_dag():
    d = federation.GraphDAG()
    d.register("political", ["static", "world"])
    d.register("world", ["static"])
    assert d.validate() == (False, ["static", "political"])
    d.register("static")
    assert d.order() == ["static", "world", "political"] and d.has("world")
    with pytest.raises(ValueError):
        d.register("world")
    d2 = federation.GraphDAG()
    for g, n in (("a", ["b"]), ("b", ["a"]), ("c", ["a"]), ("d", [])):
        d2.register(g, n)
    assert d2.validate() == (False, ["a", "b", "c"])
    with pytest.raises(ValueError):
        d2.order()


def test_boundary(spark):
    b = federation.BoundaryRegistry()
    b.register(federation.BoundaryVerb("v", "a", "b", "both", 0.9, 100))
    assert b.is_allowed("v", "b", "a") and not b.is_allowed("w", "a", "b") and b.errors("w", "a", "b") and not b.errors("v", "a", "b") and b.get("v", "a", "b").fidelity == 0.9
    for bad in (federation.BoundaryVerb("v", "b", "a"), federation.BoundaryVerb("x", "a", "b", fidelity=1.1), federation.BoundaryVerb("x", "a", "b", temporal_offset=-1)):
        with pytest.raises(ValueError):
            b.register(bad)
    assert b.table(spark).count() == len(b.all()) == 2


def test_queue(spark):
    w = spark.createDataFrame([(0, 10, 5), (1, 10, None), (2, 8, 2), (3, 50, 1)], "ord long, tick long, temporal_offset long")
    due, left = federation.process_tick(federation.enqueue(w, "tick"), 15)
    assert [r.ord for r in due.collect()] == [1, 2, 0] and [r.ord for r in left.collect()] == [3]
    with pytest.raises(Exception, match="negative"):
        federation.enqueue(spark.createDataFrame([(0, 1, -1)], w.schema), "tick").collect()


def test_projection(spark):
    calls = []

    def derive(keys):
        calls.append(1)
        return keys.selectExpr("graph_id", "entity_id", "double(length(entity_id)) AS value")

    r = projection.ComponentRegistry()
    r.register(projection.Component("Score", ("ally",), 0, derive))
    r.register(projection.Component("Slow", ("ally", "foe"), 1000, derive))
    with pytest.raises(ValueError):
        r.register(projection.Component("Score", (), 0, derive))
    assert r.affected_by(["foe"]) == {"Slow"} and r.ids() == ["Score", "Slow"] and r.get("?") is None
    change = spark.createDataFrame([("g", "ally", "a", "bb"), ("g", "other", "a", "c")], "graph_id string, verb_type string, source_id string, target_id string")
    dirty = projection.dirtied(change, r.manifest(spark))
    assert dirty.count() == 4
    cache = spark.createDataFrame([("g", "a", "Slow", 9.0, 500)], "graph_id string, entity_id string, component string, value double, derived_at_ms long")
    new, left, made = projection.refresh(dirty, cache, r, 1000)
    assert {(x.entity_id, x.component): x.value for x in new.collect()} == {("a", "Score"): 1.0, ("bb", "Score"): 2.0, ("bb", "Slow"): 2.0, ("a", "Slow"): 9.0}
    assert [(x.entity_id, x.component) for x in left.collect()] == [("a", "Slow")] and made.count() == 3
    again, cleared = projection.invalidate(left, new, left)
    assert projection.refresh(again, cleared, r, 1001)[0].where("entity_id = 'a' AND component = 'Slow'").first().value == 1.0
    assert projection.read(new, spark.createDataFrame([("g", "zz", "Score")], "graph_id string, entity_id string, component string")).first().value is None


def test_hot_zone(spark):
    t = spark.createDataFrame([("a", 10, "touch"), ("b", 10, "pin"), ("c", 10, "pin"), ("c", 20, "unpin"), ("d", 95, "touch")], "entity_id string, at_ms long, op string")
    zone = projection.accesses(t)
    assert {r.entity_id for r in projection.hot(zone, 100, 50).collect()} == {"b", "d"}
    entities = spark.createDataFrame([(i,) for i in "abcde"], "id string")
    edges = spark.createDataFrame([("a", "d")], "source_id string, target_id string")
    kept, gone = projection.evict(entities, edges, zone, 100, 50)
    assert {r.id for r in kept.collect()} == {"a", "b", "d"} and {r.id for r in gone.collect()} == {"c", "e"}
    assert projection.tracked(zone).first()[0] == 3
