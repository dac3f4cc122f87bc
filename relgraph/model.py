"""Tuples, filters, requests and results; all ids are strings and plain subjects have the relation ''."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from enum import IntEnum

from pyspark.sql import types as T

from .errors import InvalidArgument

NAME = r"[a-z]([a-z0-9_]{0,62}[a-z0-9])?"
TYPE_NAME = rf"{NAME}(/{NAME})*"
OBJECT_ID = r"[a-zA-Z0-9/_|\-=+]+"
MAX_ID_BYTES = 1024
WILDCARD = "*"

COLUMNS = ["resource_type", "resource_id", "relation", "subject_type", "subject_id", "subject_relation"]
REL = T.StructType([T.StructField(c, T.StringType(), False) for c in COLUMNS])
CHANGE = T.StructType([T.StructField("revision", T.LongType(), False), T.StructField("seq", T.IntegerType(), False), T.StructField("operation", T.ShortType(), False), *REL.fields])
CLOSURE = T.StructType([T.StructField(f"{side}_{c}", T.StringType(), False) for side in ("ancestor", "descendant") for c in ("type", "id", "relation")])
SETS = T.StructType([T.StructField(c, T.StringType(), False) for c in ("resource_type", "resource_id", "permission", "set_type", "set_id", "set_relation")])


def valid_name(text: str) -> bool:
    return re.fullmatch(NAME, text) is not None


def valid_type_name(text: str) -> bool:
    return re.fullmatch(TYPE_NAME, text) is not None


def valid_object_id(text: str) -> bool:
    return re.fullmatch(OBJECT_ID, text) is not None and len(text.encode()) <= MAX_ID_BYTES


def _require(ok: bool, message: str) -> None:
    if not ok:
        raise InvalidArgument(message)


@dataclass(frozen=True)
class ObjectRef:
    type: str
    id: str

    def __str__(self) -> str:
        return f"{self.type}:{self.id}"

    def validate(self) -> None:
        _require(valid_type_name(self.type), f"invalid type name {self.type!r}")
        _require(valid_object_id(self.id), f"invalid object id {self.id!r}")


@dataclass(frozen=True)
class SubjectRef:
    type: str
    id: str
    relation: str = ""

    def __str__(self) -> str:
        return f"{self.type}:{self.id}" + (f"#{self.relation}" if self.relation else "")

    def validate(self, wildcard: bool = False) -> None:
        _require(valid_type_name(self.type), f"invalid type name {self.type!r}")
        if self.id == WILDCARD and wildcard:
            _require(not self.relation, "a wildcard subject has no relation")
        else:
            _require(valid_object_id(self.id), f"invalid object id {self.id!r}")
        _require(not self.relation or valid_name(self.relation), f"invalid relation name {self.relation!r}")


@dataclass(frozen=True)
class Relationship:
    resource: ObjectRef
    relation: str
    subject: SubjectRef

    def __str__(self) -> str:
        return f"{self.resource}#{self.relation}@{self.subject}"

    @property
    def row(self) -> tuple[str, ...]:
        return self.resource.type, self.resource.id, self.relation, self.subject.type, self.subject.id, self.subject.relation

    @property
    def nesting(self) -> bool:
        return bool(self.subject.relation)

    def validate(self) -> None:
        self.resource.validate()
        _require(valid_name(self.relation), f"invalid relation name {self.relation!r}")
        self.subject.validate(wildcard=True)

    @staticmethod
    def of(row) -> Relationship:
        return Relationship(ObjectRef(row[0], row[1]), row[2], SubjectRef(row[3], row[4], row[5]))


def parse_relationship(text: str) -> Relationship:
    """`type:id#relation@type:id[#relation]`; the subject relation `...` is that of a plain subject."""
    m = re.fullmatch(r"([^:@#]+):([^#@]+)#([^@#:]+)@([^:#]+):([^#]+)(?:#(.+))?", text, re.S)
    if m is None:
        raise InvalidArgument(f"malformed relationship {text!r}")
    relation = m[6] or ""
    out = Relationship(ObjectRef(m[1], m[2]), m[3], SubjectRef(m[4], m[5], "" if relation == "..." else relation))
    out.validate()
    return out


class Operation(IntEnum):
    CREATE = 1
    TOUCH = 2
    DELETE = 3


@dataclass(frozen=True)
class Update:
    operation: int
    relationship: Relationship


@dataclass(frozen=True)
class SubjectFilter:
    """relation None: any; '': plain subjects only."""

    type: str = ""
    id: str = ""
    relation: str | None = None


@dataclass(frozen=True)
class RelationshipFilter:
    resource_type: str
    resource_id: str = ""
    relation: str = ""
    subject: SubjectFilter | None = None

    def validate(self) -> None:
        _require(valid_type_name(self.resource_type), "a filter needs a resource type")
        _require(not self.resource_id or valid_object_id(self.resource_id), f"invalid object id {self.resource_id!r}")
        _require(not self.relation or valid_name(self.relation), f"invalid relation name {self.relation!r}")
        if self.subject is not None:
            s = self.subject
            _require(valid_type_name(s.type), "a subject filter needs a type")
            _require(not s.id or s.id == WILDCARD or valid_object_id(s.id), f"invalid object id {s.id!r}")
            _require(not s.relation or valid_name(s.relation), f"invalid relation name {s.relation!r}")

    def __str__(self) -> str:
        out = f"{self.resource_type}:{self.resource_id or '?'}#{self.relation or '?'}"
        if self.subject is not None:
            out += f"@{self.subject.type}:{self.subject.id or '?'}" + ("" if self.subject.relation is None else f"#{self.subject.relation}")
        return out


@dataclass(frozen=True)
class Precondition:
    must_match: bool
    filter: RelationshipFilter

    def validate(self) -> None:
        self.filter.validate()


@dataclass(frozen=True)
class CheckRequest:
    resource: ObjectRef
    permission: str
    subject: SubjectRef

    def validate(self) -> None:
        self.resource.validate()
        _require(valid_name(self.permission), f"invalid permission name {self.permission!r}")
        self.subject.validate()


@dataclass(frozen=True)
class CheckResult:
    request: CheckRequest
    has_permission: bool = False
    error: Exception | None = None


@dataclass(frozen=True)
class SubjectsResult:
    """Finite ids, or everyone but the excluded ids."""

    wildcard: bool = False
    subject_ids: tuple[str, ...] = ()
    excluded_ids: tuple[str, ...] = ()


@dataclass(frozen=True)
class PermissionTree:
    operation: str  # leaf, union, intersection or exclusion
    resource: ObjectRef
    relation: str
    subjects: tuple[SubjectRef, ...] = ()
    children: tuple[PermissionTree, ...] = field(default=())

    def rows(self, parent: int | None = None, ordinal: int = 0, depth: int = 0, out: list | None = None) -> list[tuple]:
        """The tree as a node table: (node_id, parent_id, ordinal, depth, operation, resource, relation, subjects)."""
        out = [] if out is None else out
        node = len(out)
        out.append((node, parent, ordinal, depth, self.operation, str(self.resource), self.relation, [str(s) for s in self.subjects]))
        for i, child in enumerate(self.children):
            child.rows(node, i, depth + 1, out)
        return out
