"""Classes of resources that share usersets, against plain sets."""

import random

from relgraph.operators import groups, resolve, sets
from relgraph.operators.closure import closure_of
from relgraph.operators.groups import Groups
from relgraph.operators.pairs import PairBound
from relgraph.operators.questions import lookup_resources
from relgraph.schema import parse


def test_groups_give_each_pair_once(spark, monkeypatch):
    monkeypatch.setattr(groups, "CHUNK", 3)
    rng = random.Random(1)
    kinds = [rng.sample(range(6), rng.randint(0, 4)) for _ in range(5)]
    links = {(f"r{i}", f"u{u}") for i in range(60) for u in kinds[i % 5]} | {(f"r{i}", f"own{i}") for i in range(0, 60, 4)}
    members = {(f"u{u}", f"s{rng.randrange(40)}") for u in range(7) for _ in range(12)} | {(f"own{i}", f"s{rng.randrange(40)}") for i in range(0, 60, 8)}
    more = {("r1", "s1"), ("r2", "only"), ("new", "s1")}
    want = {(r, s) for r, u in links for v, s in members if u == v} | more
    found = Groups(spark.createDataFrame(sorted(links), "r string, u string"), spark.createDataFrame(sorted(members), "u string, s string"), spark.createDataFrame(sorted(more), "r string, s string"))
    pairs = [tuple(r) for r in found.pairs().collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == want
    assert {tuple(r) for r in found.counts().collect()} == {(x, sum(r == x for r, _ in want)) for x in {r for r, _ in want}}
    assert found.subjects.count() < len(want) / 4


def test_counts_over_parts(spark):
    """Resources of one name count a subject once; so do those without a name."""
    schema = parse("definition person {} definition team { relation member: person | team#member } definition desk { relation open: team#member relation chief: person permission use = open + chief }")
    tuples = [("team", "a", "member", "person", "p", ""), ("team", "a", "member", "team", "b", "member"), ("team", "b", "member", "person", "q", "")]
    tuples += [("desk", f"d{i}", "open", "team", "a" if i < 3 else "b", "member") for i in range(6)] + [("desk", "d0", "chief", "person", "q", ""), ("desk", "d5", "chief", "person", "x", "")]
    rels = spark.createDataFrame(tuples, "resource_type string, resource_id string, relation string, subject_type string, subject_id string, subject_relation string")
    within = spark.createDataFrame([(f"d{i}", (name,)) for i, name in enumerate(["n", "n", "m", "m", None, None])], "resource_id string, r struct<name: string>")
    stored = sets.permission_sets(schema, rels, [("desk", "use")])
    found = sets.subject_counts(schema, rels, closure_of(rels), stored, ("desk", "use"), within, "person")
    assert {(r["r"]["name"], r["n"]) for r in found.collect()} == {("n", 2), ("m", 2), (None, 2)}


def test_lookups_for_many_seeds_are_grouped(spark, monkeypatch):
    schema = parse("definition person {} definition team { relation member: person | team#member permission all = member } definition desk { relation open: team#member relation barred: person relation chief: person permission use = open + chief } definition room { relation desk: desk relation key: person permission enter = key + desk->use permission calm = (enter - key) + key }")
    rng = random.Random(2)
    tuples = {("team", f"t{rng.randrange(5)}", "member", "person", f"p{rng.randrange(12)}", "") for _ in range(12)} | {("team", "t0", "member", "team", "t1", "member"), ("team", "t1", "member", "team", "t0", "member")}
    tuples |= {("desk", f"d{i}", "open", "team", f"t{i % 5}", "member") for i in range(20)} | {("desk", f"d{i}", "chief", "person", f"p{i % 12}", "") for i in range(20)}
    tuples |= {("room", f"r{i}", "desk", "desk", f"d{j}", "") for i in range(8) for j in rng.sample(range(20), 2)} | {("room", f"r{i}", "key", "person", f"p{i}", "") for i in range(8)}
    rels = spark.createDataFrame(sorted(tuples), "resource_type string, resource_id string, relation string, subject_type string, subject_id string, subject_relation string")
    seeds = spark.createDataFrame([(f"p{i}", "person", f"p{i}", "") for i in range(12)] + [("t", "team", "t1", "member")], "k string, subject_type string, subject_id string, subject_relation string")
    calls = []
    monkeypatch.setattr(resolve, "Groups", lambda *a: calls.append(a) or Groups(*a))
    for goal in (("desk", "use"), ("room", "enter"), ("room", "calm")):
        monkeypatch.setattr(resolve, "MANY", 1000)
        want = sorted(map(tuple, lookup_resources(schema, rels, goal, seeds).collect()))
        monkeypatch.setattr(resolve, "MANY", 1)
        assert want and sorted(map(tuple, lookup_resources(schema, rels, goal, seeds).collect())) == want
    assert len(calls) == 2


def test_sets_over_long_chains_and_cycles(spark, monkeypatch):
    """Paths are doubled: a chain of 40 takes few rounds; where paths multiply, the steps themselves go on."""
    schema = parse("definition person {} definition team { relation member: person relation head: person permission led = member + head } definition part { relation of: part relation by: team permission use = see permission see = by->led + of->see }")
    chain = [("part", f"p{i}", "of", "part", f"p{i + 1}", "") for i in range(40)] + [("part", "p40", "by", "team", "last", ""), ("part", "p7", "by", "team", "mid", "")]
    cycle = [("part", f"c{i}", "of", "part", f"c{(i + j) % 9}", "") for i in range(9) for j in (1, 2, 3)] + [("part", "c4", "by", "team", "ring", "")]
    rels = spark.createDataFrame(chain + cycle, "resource_type string, resource_id string, relation string, subject_type string, subject_id string, subject_relation string")
    want = {(f"p{i}", "last") for i in range(41)} | {(f"p{i}", "mid") for i in range(8)} | {(f"c{i}", "ring") for i in range(9)}
    want = sorted((r, p, s, x) for r, s in want for p in ("see", "use") for x in ("member", "head"))
    for paths in (0, 4, 1000):
        monkeypatch.setattr(sets, "MORE_PATHS", paths)
        rounds = []
        real = sets.checkpointed
        with monkeypatch.context() as m:
            m.setattr(sets, "checkpointed", lambda df, real=real, rounds=rounds: rounds.append(1) or real(df))
            found = sets.permission_sets(schema, rels, [("part", "use"), ("part", "see")])
            assert sorted(tuple(r) for r in found.select("resource_id", "permission", "set_id", "set_relation").collect()) == want
        assert paths < 1000 or len(rounds) < 20


def test_demand_leaves_no_superseded_tables(spark, monkeypatch):
    """A recursive check down a chain longer than MOST_PARTS: right answers, merged rounds deleted, and no table of what plain relations were asked."""
    schema = parse("definition person {} definition doc { relation up: doc relation reader: person relation barred: person permission read = (reader + up->read) - barred }")
    tuples = [("doc", f"d{i}", "up", "doc", f"d{i + 1}", "") for i in range(20)] + [("doc", "d20", "reader", "person", "p", ""), ("doc", "d20", "reader", "person", "q", ""), ("doc", "d9", "barred", "person", "q", "")]
    rels = spark.createDataFrame(tuples, "resource_type string, resource_id string, relation string, subject_type string, subject_id string, subject_relation string")
    gone = []
    real = resolve.forget
    monkeypatch.setattr(resolve, "forget", lambda df: gone.append(1) or real(df))
    seeds = spark.createDataFrame([(x, "person", x, "") for x in "pqz"], "k string, subject_type string, subject_id string, subject_relation string")
    bound = PairBound(schema, rels, seeds)
    held = bound.holds(("doc", "read"), spark.createDataFrame([(k, d) for k in "pqz" for d in ("d0", "d9", "d12")], "k string, id string"))
    assert sorted(map(tuple, held.collect())) == [("p", "d0"), ("p", "d12"), ("p", "d9"), ("q", "d12")]
    assert gone and ("doc", "reader") not in bound.memo and ("doc", "barred") not in bound.memo
