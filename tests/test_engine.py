"""Answers on a small hospital, on chains and cycles, and writes: what they leave, refuse and survive."""

import json

import pytest
from oracle import Oracle

from relgraph.errors import Cancelled, FormatVersion, InvalidArgument, MaxDepthExceeded, NestingTooLarge, PreconditionFailed, RelationshipExists, RelgraphError, SchemaMismatch
from relgraph.index import Index
from relgraph.model import CheckRequest, ObjectRef, Operation, Precondition, RelationshipFilter, SubjectRef, Update, parse_relationship
from relgraph.operators import closure, sets
from relgraph.operators.resolve import SubjectBound
from relgraph.plans.deadline import deadline
from relgraph.schema import parse
from relgraph.service import Service
from relgraph.sources import store as stores
from relgraph.sources.files import validation_file
from relgraph.sources.store import Store
from relgraph.streaming.follow import catchup

HOSPITAL = """
definition person {}
definition shift {
    relation on_duty: person | shift#on_duty
    relation head: person
    permission reachable = on_duty + head
}
definition clinic {
    relation staffed_by: shift
    relation guest: person | person:*
    relation suspended: person | shift#on_duty
    relation director: person
    permission enter = (guest + director + staffed_by->reachable) - suspended
    permission inspect = director & staffed_by->head
    permission hire = director + staffed_by->head
}
definition chart {
    relation kept_at: clinic
    relation amends: chart
    relation author: person
    relation reader: person | shift#reachable
    permission read = author + reader + amends->read + kept_at->director
    permission sign = author - amends->author
}
"""
TUPLES = """shift:night#on_duty@person:ada shift:night#on_duty@shift:standby#on_duty shift:standby#on_duty@person:ben shift:standby#on_duty@person:cy
shift:day#head@person:dot shift:day#on_duty@person:eli clinic:north#staffed_by@shift:night clinic:north#staffed_by@shift:day
clinic:north#director@person:dot clinic:north#suspended@person:cy clinic:south#guest@person:* clinic:south#suspended@shift:standby#on_duty
clinic:south#director@person:fay chart:x1#kept_at@clinic:north chart:x1#author@person:eli chart:x2#amends@chart:x1 chart:x2#author@person:ada
chart:x2#reader@shift:standby#reachable chart:x3#amends@chart:x2 chart:x3#author@person:ada chart:x3#kept_at@clinic:south""".split()


def obj(text):
    return ObjectRef(*text.split(":", 1))


def subj(text):
    head, _, relation = text.partition("#")
    return SubjectRef(*head.split(":", 1), relation)


def service(spark, path, schema, tuples, **options):
    out = Service(Store(spark, str(path)), parse(schema), **options)
    if tuples:
        out.import_relationships([parse_relationship(t) for t in tuples])
    return out


def touch(s, *texts):
    return s.write([Update(Operation.TOUCH, parse_relationship(x)) for x in texts])


def delete(s, *texts):
    return s.write([Update(Operation.DELETE, parse_relationship(x)) for x in texts])


@pytest.fixture(scope="module", params=[None, "sets"])
def hospital(request, spark, tmp_path_factory):
    return service(spark, tmp_path_factory.mktemp("store"), HOSPITAL, TUPLES, index=request.param)


def test_checks(hospital):
    expected = {
        ("clinic:north", "enter", "person:ben"): True, ("clinic:north", "enter", "person:cy"): False, ("clinic:north", "enter", "person:zoe"): False,
        ("clinic:south", "enter", "person:zoe"): True, ("clinic:south", "enter", "person:ben"): False, ("clinic:south", "enter", "person:fay"): True,
        ("clinic:north", "inspect", "person:dot"): True, ("clinic:south", "inspect", "person:fay"): False, ("clinic:north", "hire", "person:eli"): False,
        ("chart:x3", "read", "person:dot"): True, ("chart:x3", "read", "person:cy"): True, ("chart:x1", "read", "person:ada"): False,
        ("chart:x2", "sign", "person:ada"): True, ("chart:x3", "sign", "person:ada"): False, ("shift:none", "on_duty", "shift:none#on_duty"): True,
        ("shift:night", "reachable", "shift:standby#on_duty"): True, ("clinic:south", "enter", "shift:night#on_duty"): False,
    }
    schema, ids = parse(HOSPITAL), {"night", "standby", "day", "north", "south", "x1", "x2", "x3", "none"}
    rows = [parse_relationship(t).row for t in TUPLES]
    for (r, p, s), yes in expected.items():
        one = subj(s)
        assert Oracle(schema, rows, (one.type, one.id, one.relation), ids).holds(*r.split(":"), p) == yes
    requests = [CheckRequest(obj(r), p, subj(s)) for r, p, s in expected]
    bad = [CheckRequest(obj("chart:x1"), "nope", subj("person:a")), CheckRequest(obj("nope:x1"), "read", subj("person:a")), CheckRequest(obj("chart:x1"), "read", subj("person:"))]
    results = hospital.check_bulk(requests + bad)
    assert [r.has_permission for r in results[: len(requests)]] == list(expected.values())
    assert all(isinstance(r.error, InvalidArgument) for r in results[len(requests) :])
    with pytest.raises(InvalidArgument):
        hospital.check(obj("chart:x1"), "nope", subj("person:a"))


@pytest.mark.parametrize(
    "type_, permission, subject, limit, ids",
    [
        ("chart", "read", "person:ada", 0, "x2 x3"), ("chart", "read", "person:dot", 0, "x1 x2 x3"), ("chart", "read", "person:dot", 2, "x1 x2"), ("clinic", "hire", "person:dot", 0, "north"),
        ("clinic", "enter", "person:cy", 0, ""), ("shift", "on_duty", "person:ben", 0, "night standby"), ("shift", "on_duty", "shift:standby#on_duty", 0, "night standby"),
    ],
)
def test_lookup_resources(hospital, type_, permission, subject, limit, ids):
    assert hospital.lookup_resources(type_, permission, subj(subject), limit) == ids.split()


@pytest.mark.parametrize(
    "resource, permission, type_, relation, wildcard, ids",
    [
        ("clinic:north", "enter", "person", "", False, "ada ben dot eli"), ("clinic:south", "enter", "person", "", True, "ben cy"), ("clinic:north", "hire", "person", "", False, "dot"),
        ("chart:x2", "read", "person", "", False, "ada ben cy dot eli"), ("shift:night", "on_duty", "shift", "on_duty", False, "night standby"),
    ],
)
def test_lookup_subjects(hospital, resource, permission, type_, relation, wildcard, ids):
    found = hospital.lookup_subjects(obj(resource), permission, type_, relation)
    assert (found.wildcard, found.excluded_ids if wildcard else found.subject_ids) == (wildcard, tuple(ids.split()))


def test_expand(hospital):
    tree = hospital.expand(obj("clinic:north"), "enter")
    assert (tree.operation, len(tree.children)) == ("exclusion", 2)
    left, right = tree.children
    assert [str(s) for s in right.subjects] == ["person:cy"] and left.operation == "union" and len(left.children) == 3
    assert {str(c.resource) for c in left.children[2].children} == {"shift:night", "shift:day"}
    assert tree.rows()[0][:5] == (0, None, 0, 0, "exclusion")
    with pytest.raises(InvalidArgument):
        hospital.expand(obj("clinic:north"), "ghost")


def test_index_is_maintained(spark, tmp_path):
    s = service(spark, tmp_path, HOSPITAL, TUPLES, index="sets")
    where = s.index._where(s.store.head())
    touch(s, "shift:day#on_duty@person:gil")  # neither nesting nor what an arrow walks: the rows stay where they are
    assert s.index._where(s.store.head()) == where
    touch(s, "shift:standby#on_duty@shift:reserve#on_duty", "shift:reserve#on_duty@person:gil")
    assert s.lookup_resources("shift", "on_duty", subj("person:gil")) == ["day", "night", "reserve", "standby"]
    delete(s, "shift:night#on_duty@shift:standby#on_duty", "clinic:north#staffed_by@shift:day")
    assert s.lookup_resources("shift", "on_duty", subj("person:gil")) == ["day", "reserve", "standby"]
    assert s.lookup_resources("clinic", "hire", subj("person:dot")) == ["north"]
    touch(s, "shift:reserve#on_duty@shift:standby#on_duty")
    assert all(d.isEmpty() for d in s.index.verify().values())
    s.index.reindex()
    assert all(d.isEmpty() for d in s.index.verify().values())


def test_intersections_are_narrowed_by_their_named_operand(spark, tmp_path):
    """Nobody's clinics by `staffed_by->head` are looked for but those that they direct."""
    s = service(spark, tmp_path, HOSPITAL, [*TUPLES, "clinic:south#staffed_by@shift:day", "clinic:south#director@person:dot", "clinic:east#staffed_by@shift:day"])
    people = spark.createDataFrame([(x, "person", x, "") for x in ("dot", "eli", "fay")], "k string, subject_type string, subject_id string, subject_relation string")
    bound = SubjectBound(parse(HOSPITAL), s.store.snapshot().rels, people)
    assert sorted(map(tuple, bound.goal(("clinic", "inspect")).collect())) == [("dot", "north"), ("dot", "south")]
    assert ("shift", "head") not in bound.done and ("clinic", "director") in bound.done


def test_checks_by_sets_go_down_from_what_is_asked(spark, tmp_path, monkeypatch):
    """No subject's usersets are all listed, of which one that stands high has far more than are asked about."""
    monkeypatch.setattr(sets, "member_of", None)
    schema = parse(HOSPITAL)
    rels = service(spark, tmp_path, HOSPITAL, TUPLES).store.snapshot().rels
    asked = spark.createDataFrame([("day", "person:eli#", "person", "eli", ""), ("night", "person:ben#", "person", "ben", ""), ("night", "person:dot#", "person", "dot", ""), ("night", "shift:standby#on_duty", "shift", "standby", "on_duty")], "resource_id string, k string, subject_type string, subject_id string, subject_relation string")
    stored = sets.permission_sets(schema, rels, [("shift", "reachable")])
    found = sets.has_permission(schema, rels, closure.closure_of(rels), stored, ("shift", "reachable"), asked)
    assert sorted(tuple(r) for r in found.select("k", "has_permission").collect()) == [("person:ben#", True), ("person:dot#", False), ("person:eli#", True), ("shift:standby#on_duty", True)]


def test_nesting_budget(spark, tmp_path):
    s = service(spark, tmp_path, HOSPITAL, ["shift:a#on_duty@shift:b#on_duty", "shift:b#on_duty@shift:c#on_duty"], index="closure", nesting_budget=3)
    with pytest.raises(NestingTooLarge):
        touch(s, "shift:c#on_duty@shift:d#on_duty", "shift:d#on_duty@shift:e#on_duty")
    assert s.store.head() == s.index.cursor() == 1 and s.index.rows()[0].count() == 3


def test_nesting_beyond_the_budget_in_the_log(spark, tmp_path):
    """Only writes are refused: the log is followed whole."""
    s = service(spark, tmp_path, HOSPITAL, [])
    index = Index(s.store, mode="closure", nesting_budget=3)
    for tuples in (["shift:a#on_duty@shift:b#on_duty", "shift:b#on_duty@shift:c#on_duty"], ["shift:c#on_duty@shift:d#on_duty", "shift:d#on_duty@shift:e#on_duty"]):
        touch(s, *tuples)
    assert catchup(index) == 2 and index.rows()[0].count() == 10


def test_edges_are_added_without_a_limit(spark):
    stars = spark.range(320).selectExpr("concat('u', id) as a", "'x' as d").unionByName(spark.range(320).selectExpr("'y' as a", "concat('v', id) as d"))
    assert closure.edges_added(closure.transitive(stars), spark.createDataFrame([("x", "y")], "a string, d string")).count() == 640 + 321 * 321


def test_a_veto_leaves_store_and_index_as_they_were(spark, tmp_path):
    vetoes = []

    def hook(transaction, changes):
        if vetoes:
            raise ValueError(vetoes.pop())

    s = service(spark, tmp_path, HOSPITAL, TUPLES, index="sets", hooks=[hook])
    vetoes.append("no")
    with pytest.raises(ValueError):
        touch(s, "shift:standby#on_duty@shift:reserve#on_duty")
    assert s.store.head() == s.index.cursor() == 1 and s.changes(1).isEmpty()
    assert touch(s, "shift:day#on_duty@shift:reserve#on_duty") == 2 == s.index.cursor()
    assert all(d.isEmpty() for d in s.index.verify().values())
    assert not s.lookup_resources("shift", "on_duty", subj("shift:reserve#on_duty")) == ["night", "reserve", "standby"]


def test_a_dead_writer(spark, tmp_path, monkeypatch):
    s = service(spark, tmp_path, HOSPITAL, TUPLES[:3])
    s.store.files.create("LOCK", json.dumps({"owner": "x", "at": 0.0}))
    monkeypatch.setattr(stores, "LEASE", float("inf"))
    with pytest.raises(RelgraphError):
        touch(s, TUPLES[4])
    monkeypatch.setattr(stores, "LEASE", 60)
    s.store.files.create("heads/000000000009.abc.new", "{")  # a head that was never renamed
    assert touch(s, TUPLES[4]) == 2 and not s.store.files.exists("LOCK")


def test_bases_changes_and_migration(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stores, "COMPACT_REVISIONS", 3)
    s = service(spark, tmp_path / "a", HOSPITAL, TUPLES[:2])
    for i in range(5):
        touch(s, f"shift:s{i}#on_duty@person:p{i}")
        delete(s, *[f"shift:s{i - 1}#on_duty@person:p{i - 1}"] if i else [TUPLES[0]])
    bases = s.store.files.names("rels")
    assert len(bases) == 2 and s.store.head() == 11
    rows = {tuple(r)[1] for r in s.store.snapshot().rels.collect()}
    assert rows == {"night", "s4"} and {tuple(r)[1] for r in s.store.snapshot(3).rels.collect()} == {"night", "s0"}
    s.store.compact()
    assert s.store.about(11)["base"] == 11 and {tuple(r)[1] for r in s.store.snapshot().rels.collect()} == rows
    old = str(tmp_path / "b")
    s.store.snapshot().rels.write.partitionBy("resource_type").parquet(f"{old}/rels/rev=7")
    for name, text in (("FORMAT", "1"), ("HEAD", '{"revision": 7}')):
        (tmp_path / "b" / name).write_text(text)
    with pytest.raises(FormatVersion):
        Store(spark, old)
    assert Store.version(spark, old) == 1 and Store.migrate(spark, old).head() == 7 and Store.version(spark, old) == 2
    assert {tuple(r)[1] for r in Store(spark, old).snapshot().rels.collect()} == rows


def test_writes(spark, tmp_path):
    seen = []
    s = service(spark, tmp_path, HOSPITAL, [], hooks=[lambda t, c: seen.append(c.count())])
    one, two = parse_relationship("shift:a#on_duty@person:x"), parse_relationship("shift:b#on_duty@person:x")
    assert s.write([Update(Operation.CREATE, one)]) == 1
    with pytest.raises(RelationshipExists):
        s.write([Update(Operation.CREATE, two), Update(Operation.CREATE, one)])
    assert s.write([Update(Operation.TOUCH, one)]) == 1  # no effect, no revision
    assert s.write([Update(Operation.TOUCH, two), Update(Operation.DELETE, two), Update(Operation.DELETE, one)]) == 2
    assert [(r.revision, r.seq, r.operation, r.resource_id) for r in s.changes().collect()] == [(1, 0, 2, "a"), (2, 0, 2, "b"), (2, 1, 3, "b"), (2, 2, 3, "a")]
    assert s.read(RelationshipFilter("shift")) == [] and seen == [1, 3]
    with pytest.raises(PreconditionFailed):
        s.write([Update(Operation.TOUCH, one)], [Precondition(True, RelationshipFilter("shift", "b"))])
    with pytest.raises(InvalidArgument):
        s.write([Update(Operation.TOUCH, parse_relationship("shift:a#on_duty@clinic:x"))])
    assert s.import_relationships([one, two]) == 3
    with pytest.raises(RelationshipExists):
        s.import_relationships([two])
    assert s.delete(RelationshipFilter("shift", "a")) == 1
    assert [str(r) for r in s.read(RelationshipFilter("shift"))] == ["shift:b#on_duty@person:x"]
    s.validate_stored()
    with pytest.raises(SchemaMismatch):
        Service(s.store, parse("definition person {} definition shift { relation head: person }")).validate_stored()
    t = s.store.transaction()
    s.write_in(t, [Update(Operation.TOUCH, one)])
    touch(s, "shift:c#on_duty@person:x")
    with pytest.raises(RelgraphError):
        t.commit()  # the store has moved on


def test_cancellation(spark, tmp_path):
    with pytest.raises(Cancelled), deadline(spark, 0.5):
        spark.range(1 << 40).selectExpr("sum(hash(id))").collect()
    assert spark.range(3).count() == 3
    s = service(spark, tmp_path, HOSPITAL, TUPLES[:3], timeout=120)
    assert s.check(obj("shift:night"), "on_duty", subj("person:ben"))
    s.timeout = 0.01
    with pytest.raises(Cancelled):
        s.lookup_resources("chart", "read", subj("person:ada"))


CHAIN = "definition person {} definition box { relation within: box relation opener: person permission open = opener + within->open }"


def test_depth_and_cycles(spark, tmp_path):
    chain = [f"box:b{i}#within@box:b{i + 1}" for i in range(8)] + ["box:b8#opener@person:u"]
    s = service(spark, tmp_path / "a", CHAIN, chain, max_depth=5)
    assert s.check(obj("box:b5"), "open", subj("person:u"))
    with pytest.raises(MaxDepthExceeded):
        s.check(obj("box:b0"), "open", subj("person:u"))
    s = service(spark, tmp_path / "b", CHAIN, ["box:a#within@box:b", "box:b#within@box:a", "box:b#opener@person:u"])
    assert s.check(obj("box:a"), "open", subj("person:u"))
    assert s.expand(obj("box:a"), "open") is not None


def test_exclusion_under_recursion(spark, tmp_path):
    schema = "definition person {} definition box { relation within: box relation opener: person permission open = opener - within->open }"
    s = service(spark, tmp_path / "a", schema, ["box:c#opener@person:u", "box:p#opener@person:u", "box:c#within@box:p"])
    assert [r.has_permission for r in s.check_bulk([CheckRequest(obj(f"box:{x}"), "open", subj("person:u")) for x in "pc"])] == [True, False]
    s = service(spark, tmp_path / "b", schema, ["box:a#opener@person:u", "box:b#opener@person:u", "box:a#within@box:b", "box:b#within@box:a"])
    with pytest.raises(InvalidArgument):
        s.check(obj("box:a"), "open", subj("person:u"))


@pytest.mark.parametrize("index", [None, "closure"])
def test_permissions_nested_in_relations(spark, tmp_path, index):
    schema = """definition person {} definition cell { relation sitter: person | person:* relation banned: person permission allowed = sitter - banned }
    definition ring { relation member: cell#allowed | ring#member } definition door { relation user: person | ring#member | cell#allowed }"""
    s = service(spark, tmp_path, schema, ["cell:g#sitter@person:*", "cell:g#banned@person:x", "ring:r#member@cell:g#allowed", "ring:q#member@ring:r#member", "door:d#user@ring:q#member", "door:e#user@cell:g#allowed", "door:e#user@person:x"], index=index)
    assert [s.lookup_subjects(obj(f"door:{d}"), "user", "person").excluded_ids for d in "de"] == [("x",), ()]
    assert s.lookup_resources("door", "user", subj("person:y")) == ["d", "e"] and s.lookup_resources("door", "user", subj("person:x")) == ["e"]


def test_validation_file(spark, tmp_path):
    text = "schema: |-\n  " + CHAIN + "\nrelationships: |-\n  box:a#within@box:b\n  // a comment\n  box:b#opener@person:u\nassertions:\n  assertTrue:\n    - 'box:a#open@person:u'\n  assertFalse:\n    - box:a#open@person:w\nvalidation:\n  box:a#open:\n    - '[person:u] is <box:b#opener>'\n"
    run_validation(spark, tmp_path, text)


def run_validation(spark, path, text):
    """The assertions of a validation file."""
    found = validation_file(text)
    s = service(spark, path, found["schema"], found["relationships"])
    asked = [(parse_relationship(x), yes) for key, yes in (("assertTrue", True), ("assertFalse", False)) for x in found[key]]
    results = s.check_bulk([CheckRequest(r.resource, r.relation, r.subject) for r, _ in asked])
    assert [r.error for r in results] == [None] * len(asked) and [r.has_permission for r in results] == [yes for _, yes in asked]
