"""Schema language, tuples, files and rule analysis; no Spark."""

import pytest

from relgraph.errors import InvalidArgument, NotMaterializable, SchemaError
from relgraph.model import parse_relationship
from relgraph.plans.compile import materializable, materialized, static_relations, strata
from relgraph.schema import arrow, build, definition, exclusion, parse, permission, ref, relation, subject, union, userset, wildcard
from relgraph.sources.files import validation_file


def test_text_and_builders_agree():
    text = """
    // comment
    definition user {}
    definition group/sub { relation member: user | group/sub#member | user:* }
    definition doc { /* note */
        relation parent: doc
        relation viewer: user | group/sub#member
        permission view = (viewer + parent->view) - nil
    }"""
    from relgraph.schema import nil

    built = build(
        definition("user"), definition("group/sub", relation("member", subject("user"), userset("group/sub", "member"), wildcard("user"))),
        definition("doc", relation("parent", subject("doc")), relation("viewer", subject("user"), userset("group/sub", "member")), permission("view", exclusion(union(ref("viewer"), arrow("parent", "view")), nil()))),
    )
    assert parse(text) == built
    assert parse("").definitions == {}


@pytest.mark.parametrize(
    "text, part",
    [
        ("definition user", "expected '{'"), ("definition User {}", "expected a type name"), ("definition user {} definition user {}", "defined twice"), ("definition d { relation r }", "expected ':'"),
        ("definition u {} definition d { relation r: u permission p = r + r & r }", "mixed"), ("definition u {} definition d { relation r: u relation r: u }", "defined twice"),
        ("definition d { relation r: ghost }", "isn't defined"), ("definition u {} definition d { relation r: u | u }", "twice"), ("definition u {} definition d { permission p = x }", "isn't defined"),
        ("definition u {} definition d { relation r: u permission p = p }", "itself"), ("definition u {} definition d { relation r: u permission p = q permission q = p }", "cycle"),
        ("definition u {} definition d { relation r: u:* permission p = r->x }", "wildcard"), ("definition u {} definition d { relation r: u permission p = r->x }", "isn't defined on any"),
        ("definition u {} definition d { relation r: u permission q = r permission p = q->r }", "starts at a relation"), ("definition u { /* open", "unterminated"), ("definition u { ? }", "unexpected character"),
        ("definition u {} definition d { relation r: u permission p = nil->r }", "expected"), ("definition u {} definition d { relation r_: u }", "expected a name"), ("caveat x", "expected 'definition'"),
    ],
)
def test_refused(text, part):
    with pytest.raises(SchemaError, match=part.replace("{", r"\{").replace("'", ".")):
        parse(text)


def test_position():
    with pytest.raises(SchemaError, match="line 3 col 14") as e:
        parse("definition user {}\ndefinition doc {\n    relation 1bad: user\n}")
    assert (e.value.line, e.value.col) == (3, 14)


def test_tuples():
    for text in ("doc:1#viewer@user:a", "a/doc:x|y=#viewer@group:g#member", "doc:007#viewer@user:*", "doc:" + "x" * 1024 + "#v@user:A_b-+"):
        assert str(parse_relationship(text)) == text
    assert str(parse_relationship("doc:1#viewer@user:a#...")) == "doc:1#viewer@user:a"
    for text in ("", "doc:1", "doc:1#viewer", "doc:1#viewer@user", "doc:#viewer@user:a", "Doc:1#viewer@user:a", "doc:1#viewer@user:a\n", "doc:*#viewer@user:a", "doc:1#viewer@user:*#member", "doc:" + "x" * 1025 + "#v@user:a", "doc:é#v@user:a"):
        with pytest.raises(InvalidArgument):
            parse_relationship(text)


SCHEMA = parse("""
definition user {} definition group { relation member: user | group#member permission all = member }
definition folder { relation parent: folder relation viewer: user | group#member relation public: user:* relation odd: group#all relation banned: user
  permission view = viewer + parent->view permission open = public permission strange = odd permission both = viewer & banned permission less = viewer - parent->less permission alias = view }
""")


def test_strata_and_sets():
    assert materializable(SCHEMA) == [("group", "all"), ("folder", "view"), ("folder", "alias")]
    assert materialized(SCHEMA, ["folder#view"]) == [("folder", "view")]
    for name in ("folder#open", "folder#strange", "folder#both", "folder#less"):
        with pytest.raises(NotMaterializable):
            materialized(SCHEMA, [name])
    with pytest.raises(InvalidArgument):
        materialized(SCHEMA, ["folder#ghost"])
    assert static_relations(SCHEMA, ("folder", "alias")) == ["viewer"]
    order = strata(SCHEMA, [("folder", "alias"), ("folder", "less")])
    found = {g: (s.recursive, s.negative) for s in order for g in s.goals}
    assert found[("folder", "view")] == (True, False) and found[("folder", "less")] == (True, True) and found[("folder", "alias")] == (False, False)
    assert [s.goals[0] for s in order].index(("group", "member")) < [s.goals[0] for s in order].index(("folder", "viewer"))


def test_validation_file():
    found = validation_file("schema: |-\n  definition user {}\n  definition doc { relation v: user }\nrelationships: |\n  doc:1#v@user:a\n  // note\nassertions:\n  assertTrue:\n    - doc:1#v@user:a\n  assertFalse:\n    - 'doc:1#v@user:b'\nvalidation:\n  doc:1#v:\n    - \"[user:a] is <doc:1#v>\"\n")
    assert parse(found["schema"]).has("doc", "v") and found["relationships"] == ["doc:1#v@user:a"]
    assert (found["assertTrue"], found["assertFalse"]) == (["doc:1#v@user:a"], ["doc:1#v@user:b"]) and found["validation"] == {"doc:1#v": ["[user:a] is <doc:1#v>"]}
