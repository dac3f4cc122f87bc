"""Random graphs over schemas with every construct, against a set-based evaluation in plain Python."""

import itertools
import random

import pytest
from oracle import Oracle

from relgraph.model import COLUMNS, CheckRequest, ObjectRef, Operation, Relationship, SubjectRef, Update
from relgraph.operators import questions as Q
from relgraph.operators.closure import closure_of
from relgraph.schema import parse
from relgraph.service import Service
from relgraph.sources.store import Store

SCHEMAS = {
    "clubs": """definition guest {}
        definition club { relation joined: guest | guest:* | club#joined relation expelled: guest | club#joined permission welcome = joined - expelled }
        definition room { relation annex: room relation key: guest | club#joined relation pass: guest:* | club#welcome relation ban: guest
            permission enter = (key + pass + annex->enter) - ban permission dine = key & pass permission sit = nil + dine permission wait = (pass - key) & (annex->enter + pass) }""",
    "crews": """definition guest {}
        definition crew { relation chief: guest relation hand: guest | crew#hand permission aboard = chief + hand }
        definition boat { relation run_by: crew relation tows: boat permission board = run_by->aboard + tows->board permission steer = run_by->chief & board }""",
}
IDS = "0123"


def candidates(schema):
    out = []
    for t, r, st, sr, wild in schema.kinds():
        for i in IDS:
            out += [(t, i, r, st, s, sr) for s in (["*"] if wild else IDS)]
    return out


@pytest.mark.parametrize("name", SCHEMAS)
def test_checks_lookups_and_indexes_agree(spark, name):
    rng = random.Random(len(name))
    schema = parse(SCHEMAS[name])
    tuples = rng.sample(candidates(schema), 30)
    rels = spark.createDataFrame(tuples, ", ".join(f"{c} string" for c in COLUMNS)).cache()
    goals = [(t, n) for t, d in schema.definitions.items() for n in [*d.relations, *d.permissions]]
    subjects = [("guest", i, "") for i in [*IDS, "nobody"]] + [(t, i, n) for t, n in goals if t in ("club", "crew") and schema.relation(t, n) for i in "01"]
    asked = [(t, i, n, *s) for (t, n), i, s in itertools.product(goals, [*IDS, "ghost"], subjects)]
    requests = spark.createDataFrame(asked, "resource_type string, resource_id string, permission string, subject_type string, subject_id string, subject_relation string")
    expected = {}
    for s in subjects:
        o = Oracle(schema, tuples, s, IDS)
        for t, n in goals:
            for i in [*IDS, "ghost"]:
                expected[t, i, n, *s] = o.holds(t, i, n)
    for closure in (None, closure_of(rels)):
        found = {tuple(r)[:6]: r["has_permission"] for r in Q.check_bulk(schema, rels, requests, closure=closure).collect()}
        assert {k for k in expected if expected[k] != found[k]} == set()
    seeds = spark.createDataFrame([(str(i), *s) for i, s in enumerate(subjects)], "k string, subject_type string, subject_id string, subject_relation string")
    for t, n in [g for g in goals if g[0] in ("room", "boat") and schema.permission(*g)][:2]:
        held = {(r["k"], r["id"]) for r in Q.lookup_resources(schema, rels, (t, n), seeds).collect()}
        assert held == {(str(i), x) for i, s in enumerate(subjects) for x in IDS if expected[t, x, n, *s]}
        found = Q.lookup_subjects(schema, rels, ObjectRef(t, "0"), n, "guest").collect()
        holds = {r["subject_id"]: r["holds"] for r in found}
        for i in [*IDS, "nobody"]:
            assert holds.get(i, holds[Q.ANONYMOUS]) == expected[t, "0", n, "guest", i, ""]


@pytest.mark.parametrize("index", ["sets", "rebuild", "async"])
def test_writes_and_questions_in_turn(spark, tmp_path, index):
    rng = random.Random(5)
    schema = parse(SCHEMAS["crews"])
    pool = candidates(schema)
    s = Service(Store(spark, str(tmp_path)), schema, index=index)
    stored: set[tuple] = set()
    for _ in range(2):
        updates, after = [], set(stored)
        for t in rng.sample(pool, 14):
            touch = t not in after or rng.random() < 0.3
            updates.append(Update(Operation.TOUCH if touch else Operation.DELETE, Relationship(ObjectRef(t[0], t[1]), t[2], SubjectRef(*t[3:]))))
            (after.add if touch else after.discard)(t)
        s.write(updates)
        stored = after
        if index == "async":
            s.catchup()
        assert {tuple(r) for r in s.store.snapshot().rels.collect()} == stored
        assert s.index.cursor() == s.store.head() and all(d.isEmpty() for d in s.index.verify().values())
        guests = [("guest", i, "") for i in "01"] + [("crew", "2", "hand")]
        asked = [(t, i, n, g) for t, n in (("boat", "board"), ("boat", "steer"), ("crew", "hand")) for i in "012" for g in guests]
        results = s.check_bulk([CheckRequest(ObjectRef(t, i), n, SubjectRef(*g)) for t, i, n, g in asked])
        oracles = {g: Oracle(schema, stored, g, IDS) for g in guests}
        assert [r.has_permission for r in results] == [oracles[g].holds(t, i, n) for t, i, n, g in asked]
        assert s.lookup_resources("boat", "board", SubjectRef("guest", "0")) == [i for i in IDS if oracles[guests[0]].holds("boat", i, "board")]
    found = s.lookup_subjects(ObjectRef("boat", "1"), "board", "guest")
    assert found.subject_ids == tuple(i for i in IDS if Oracle(schema, stored, ("guest", i, ""), IDS).holds("boat", "1", "board"))
