"""Schema values, their builders and their validation."""

from __future__ import annotations

from dataclasses import dataclass, field

from ..errors import SchemaError
from ..model import valid_name, valid_type_name


@dataclass(frozen=True)
class Allowed:
    """A kind of subject that a relation takes."""

    type: str
    relation: str = ""
    wildcard: bool = False

    def __str__(self) -> str:
        return self.type + (":*" if self.wildcard else f"#{self.relation}" if self.relation else "")


@dataclass(frozen=True)
class Relation:
    name: str
    subjects: tuple[Allowed, ...]

    def allows(self, type_: str, relation: str, wildcard: bool) -> bool:
        return Allowed(type_, relation, wildcard) in self.subjects

    def subject_types(self) -> list[str]:
        return list(dict.fromkeys(s.type for s in self.subjects))


class Expr:
    """An expression of a permission."""


@dataclass(frozen=True)
class Ref(Expr):
    name: str


@dataclass(frozen=True)
class Nil(Expr):
    pass


@dataclass(frozen=True)
class Arrow(Expr):
    relation: str
    target: str


@dataclass(frozen=True)
class SetOp(Expr):
    op: str  # union, intersection or exclusion
    children: tuple[Expr, ...]


@dataclass(frozen=True)
class Permission:
    name: str
    expr: Expr


@dataclass(frozen=True)
class Definition:
    type: str
    relations: dict[str, Relation] = field(hash=False)
    permissions: dict[str, Permission] = field(hash=False)

    def has(self, name: str) -> bool:
        return name in self.relations or name in self.permissions


@dataclass(frozen=True)
class Schema:
    definitions: dict[str, Definition] = field(hash=False)

    def relation(self, type_: str, name: str) -> Relation | None:
        d = self.definitions.get(type_)
        return d.relations.get(name) if d else None

    def permission(self, type_: str, name: str) -> Permission | None:
        d = self.definitions.get(type_)
        return d.permissions.get(name) if d else None

    def has(self, type_: str, name: str) -> bool:
        return type_ in self.definitions and self.definitions[type_].has(name)

    def permission_usersets(self) -> set[tuple[str, str]]:
        """Usersets that relations take as subjects and whose relation is a permission."""
        return {(s.type, s.relation) for d in self.definitions.values() for r in d.relations.values() for s in r.subjects if s.relation and self.permission(s.type, s.relation)}

    def kinds(self) -> list[tuple[str, str, str, str, bool]]:
        """(resource type, relation, subject type, subject relation, wildcard) of all tuples that are allowed."""
        return [(d.type, r.name, s.type, s.relation, s.wildcard) for d in self.definitions.values() for r in d.relations.values() for s in r.subjects]


def subject(type_: str) -> Allowed:
    return Allowed(type_)


def userset(type_: str, relation_: str) -> Allowed:
    return Allowed(type_, relation_)


def wildcard(type_: str) -> Allowed:
    return Allowed(type_, "", True)


def relation(name: str, *subjects: Allowed) -> Relation:
    return Relation(name, tuple(subjects))


def permission(name: str, expr: Expr) -> Permission:
    return Permission(name, expr)


def ref(name: str) -> Expr:
    return Ref(name)


def arrow(relation_: str, target: str) -> Expr:
    return Arrow(relation_, target)


def nil() -> Expr:
    return Nil()


def union(*children: Expr) -> Expr:
    return SetOp("union", tuple(children))


def intersection(*children: Expr) -> Expr:
    return SetOp("intersection", tuple(children))


def exclusion(left: Expr, right: Expr) -> Expr:
    return SetOp("exclusion", (left, right))


def definition(type_: str, *members: Relation | Permission) -> tuple[str, tuple]:
    return type_, members


def build(*definitions: tuple[str, tuple]) -> Schema:
    """A validated schema of `definition(…)` values."""
    out: dict[str, Definition] = {}
    for type_, members in definitions:
        if not valid_type_name(type_):
            raise SchemaError(f"invalid type name {type_!r}")
        if type_ in out:
            raise SchemaError(f"type {type_!r} is defined twice")
        d = Definition(type_, {}, {})
        for m in members:
            if not valid_name(m.name):
                raise SchemaError(f"invalid name {m.name!r} in {type_!r}")
            if d.has(m.name):
                raise SchemaError(f"{type_}#{m.name} is defined twice")
            (d.relations if isinstance(m, Relation) else d.permissions)[m.name] = m
        out[type_] = d
    schema = Schema(out)
    for d in out.values():
        for r in d.relations.values():
            _check_relation(schema, d, r)
        for p in d.permissions.values():
            _check_expr(schema, d, p, p.expr)
        _check_cycles(d)
    return schema


def _check_relation(schema: Schema, d: Definition, r: Relation) -> None:
    where = f"{d.type}#{r.name}"
    if not r.subjects:
        raise SchemaError(f"{where} takes no subjects")
    if len(set(r.subjects)) < len(r.subjects):
        raise SchemaError(f"{where} lists a subject type twice")
    for s in r.subjects:
        if s.wildcard and s.relation:
            raise SchemaError(f"{where}: a wildcard has no relation")
        if s.type not in schema.definitions:
            raise SchemaError(f"{where}: type {s.type!r} isn't defined")
        if s.relation and not schema.has(s.type, s.relation):
            raise SchemaError(f"{where}: {s.type}#{s.relation} isn't defined")


def _check_expr(schema: Schema, d: Definition, p: Permission, e: Expr) -> None:
    where = f"{d.type}#{p.name}"
    if isinstance(e, Ref):
        if e.name == p.name:
            raise SchemaError(f"{where} refers to itself")
        if not d.has(e.name):
            raise SchemaError(f"{where}: {e.name!r} isn't defined")
    elif isinstance(e, Arrow):
        r = d.relations.get(e.relation)
        if r is None:
            raise SchemaError(f"{where}: an arrow starts at a relation, and {e.relation!r} is none")
        if any(s.wildcard for s in r.subjects):
            raise SchemaError(f"{where}: an arrow can't go over a wildcard")
        if not any(schema.has(t, e.target) for t in r.subject_types()):
            raise SchemaError(f"{where}: {e.target!r} isn't defined on any subject of {e.relation!r}")
    elif isinstance(e, SetOp):
        if not e.children:
            raise SchemaError(f"{where}: an empty {e.op}")
        if e.op == "exclusion" and len(e.children) != 2:
            raise SchemaError(f"{where}: an exclusion has two sides")
        for c in e.children:
            _check_expr(schema, d, p, c)


def local_refs(e: Expr) -> list[str]:
    if isinstance(e, Ref):
        return [e.name]
    return [n for c in e.children for n in local_refs(c)] if isinstance(e, SetOp) else []


def _check_cycles(d: Definition) -> None:
    state: dict[str, int] = {}

    def visit(name: str, path: tuple[str, ...]) -> None:
        if state.get(name) == 2 or name not in d.permissions:
            return
        if state.get(name) == 1:
            raise SchemaError(f"permissions of {d.type!r} refer to each other in a cycle: {' -> '.join((*path, name))}")
        state[name] = 1
        for n in local_refs(d.permissions[name].expr):
            visit(n, (*path, name))
        state[name] = 2

    for name in d.permissions:
        visit(name, ())
