"""Recursive strata by objects, for many subjects: against plain Python, and without collecting all pairs."""

import itertools
import random

import pytest
from oracle import Oracle

from relgraph.errors import MaxDepthExceeded
from relgraph.model import COLUMNS
from relgraph.operators import objects, pairs
from relgraph.operators import questions as Q
from relgraph.operators.pairs import PairBound
from relgraph.schema import parse

SCHEMA = """definition guest {}
    definition host { relation chief: guest | guest:* }
    definition hall { relation up: hall relation side: hall relation by: host relation key: guest | guest:* relation ban: guest relation pass: guest | guest:* | hall#pass
        permission enter = (key + by->chief + up->enter) - ban
        permission roam = (key & side->roam) + (key - ban) + up->walk permission walk = roam - ban
        permission both = ((up->both & (key + side->both)) + key) - ban }"""
IDS = "01234567"
ASKED = "resource_type string, resource_id string, permission string, subject_type string, subject_id string, subject_relation string"


def tuples_of(rng, cyclic):
    def led():
        a, b = sorted(rng.sample(IDS, 2))
        return (b, a) if cyclic and rng.random() < 0.4 else (a, b)

    guest = lambda p=0.0: "*" if rng.random() < p else f"g{rng.randrange(9)}"
    out = {("hall", *(x := led(), x[0], rel, "hall", x[1], "")[1:]) for rel in ("up", "side") for _ in range(7)}
    out |= {("hall", rng.choice(IDS), "by", "host", rng.choice(IDS), "") for _ in range(4)} | {("host", i, "chief", "guest", guest(0.3), "") for i in "0123"}
    out |= {("hall", rng.choice(IDS), "key", "guest", guest(0.3), "") for _ in range(8)} | {("hall", rng.choice(IDS), "ban", "guest", guest(), "") for _ in range(8)}
    out |= {("hall", rng.choice(IDS), "pass", "guest", guest(0.2), "") for _ in range(3)}
    return sorted(out | {("hall", a, "pass", "hall", b, "pass") for a, b in (led() for _ in range(6))})


@pytest.mark.parametrize(("seed", "cyclic", "small"), [(1, False, 200_000), (4, True, 0)])
def test_objects_agree_with_plain_evaluation(spark, monkeypatch, seed, cyclic, small):
    monkeypatch.setattr(pairs, "MANY_SUBJECTS", 1)
    monkeypatch.setattr(objects, "SMALL", small)
    ways = []
    real = PairBound._by_objects
    monkeypatch.setattr(PairBound, "_by_objects", lambda self, s, *a: ways.append(s.goals) or real(self, s, *a))
    schema, rng = parse(SCHEMA), random.Random(seed)
    tuples = tuples_of(rng, cyclic)
    rels = spark.createDataFrame(tuples, ", ".join(f"{c} string" for c in COLUMNS))
    subjects = [("guest", f"g{i}", "") for i in range(9)] + [("guest", "nobody", ""), ("host", "1", "chief"), ("hall", "2", "enter"), ("hall", "3", "pass")]
    asked = [("hall", i, p, *s) for p, i, s in itertools.product(("enter", "roam", "walk", "both", "pass"), [*IDS, "ghost"], subjects)]
    found = {tuple(r)[:6]: r["has_permission"] for r in Q.check_bulk(schema, rels, spark.createDataFrame(asked, ASKED)).collect()}
    oracles = {s: Oracle(schema, tuples, s, IDS) for s in subjects}
    assert [a for a in asked if found[a] != (oracles[a[3:]].holds(*a[:3]) or a[:3] == (a[3], a[4], a[5]))] == []
    assert len({g for s in ways for g in s}) == 5 and any(found.values())


def test_pairs_that_no_name_concerns_are_not_collected(spark, monkeypatch):
    """40 subjects at the end of a chain of 12, three of them named on it: only these are asked about on the way."""
    monkeypatch.setattr(pairs, "MANY_SUBJECTS", 10, raising=False)
    schema = parse("definition person {} definition doc { relation up: doc relation reader: person | person:* relation barred: person permission read = (reader + up->read) - barred }")
    chain = [("doc", f"d{i}", "up", "doc", f"d{i + 1}", "") for i in range(12)]
    rels = spark.createDataFrame([*chain, ("doc", "d12", "reader", "person", "*", ""), ("doc", "d5", "barred", "person", "p1", ""), ("doc", "d7", "reader", "person", "p2", ""), ("doc", "d9", "barred", "person", "p3", ""), ("doc", "d3", "reader", "person", "p3", "")], ", ".join(f"{c} string" for c in COLUMNS))
    sizes = []
    real = pairs.checkpointed
    monkeypatch.setattr(pairs, "checkpointed", lambda df: (out := real(df), sizes.append(out.count()))[0])
    asked = spark.createDataFrame([("doc", d, "read", "person", f"p{i}", "") for i in range(40) for d in ("d0", "d6")], ASKED)
    found = {(r["resource_id"], r["subject_id"]) for r in Q.check_bulk(schema, rels, asked).where("not has_permission").collect()}
    assert found == {("d0", "p1"), ("d6", "p3")}
    assert sum(sizes) < 80 * 12 / 2
    deep = [("doc", f"d{i}", "up", "doc", f"d{i + 1}", "") for i in range(12, 20)]
    with pytest.raises(MaxDepthExceeded):
        Q.check_bulk(schema, rels.unionByName(spark.createDataFrame(deep, rels.schema)), asked, max_depth=15)
