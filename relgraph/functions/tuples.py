"""Bulk forms of parsing, rendering and validating tuples, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import COLUMNS, MAX_ID_BYTES, NAME, OBJECT_ID, TYPE_NAME, RelationshipFilter

# `\z` and not `$`, which would let a last line break pass
_TUPLE = r"\A([^:@#]+):([^#@]+)#([^@#:]+)@([^:#]+):([^#]+)(?:#(.+))?\z"


def parsed(text: Column) -> list[Column]:
    """The six columns of a tuple in text; empty strings where it is malformed."""
    part = [F.regexp_extract(text, _TUPLE, i + 1) for i in range(6)]
    part[5] = F.when(part[5] == "...", "").otherwise(part[5])
    return [c.alias(n) for c, n in zip(part, COLUMNS, strict=True)]


def rendered() -> Column:
    userset = F.when(F.col("subject_relation") != "", F.concat(F.lit("#"), "subject_relation")).otherwise("")
    return F.concat("resource_type", F.lit(":"), "resource_id", F.lit("#"), "relation", F.lit("@"), "subject_type", F.lit(":"), "subject_id", userset)


def _is(column: str, pattern: str) -> Column:
    return F.col(column).rlike(rf"\A(?:{pattern})\z")


def _id(column: str) -> Column:
    return _is(column, OBJECT_ID) & (F.octet_length(column) <= MAX_ID_BYTES)


def valid() -> Column:
    """Whether a row of six columns is a legal tuple."""
    wild = (F.col("subject_id") == "*") & (F.col("subject_relation") == "")
    relation = (F.col("subject_relation") == "") | _is("subject_relation", NAME)
    return _is("resource_type", TYPE_NAME) & _id("resource_id") & _is("relation", NAME) & _is("subject_type", TYPE_NAME) & (wild | _id("subject_id")) & relation


def matches(f: RelationshipFilter) -> Column:
    """The predicate of a filter; a subject relation of None matches any, '' plain subjects only."""
    out = F.col("resource_type") == f.resource_type
    if f.resource_id:
        out &= F.col("resource_id") == f.resource_id
    if f.relation:
        out &= F.col("relation") == f.relation
    if f.subject is not None:
        out &= F.col("subject_type") == f.subject.type
        if f.subject.id:
            out &= F.col("subject_id") == f.subject.id
        if f.subject.relation is not None:
            out &= F.col("subject_relation") == f.subject.relation
    return out


def read(rels: DataFrame, f: RelationshipFilter, limit: int = 0) -> DataFrame:
    """Tuples that a filter matches, in column order; limit 0: all."""
    out = rels.where(matches(f)).orderBy(*COLUMNS)
    return out.limit(limit) if limit else out


def query(rels: DataFrame, resource_type: str = "", resource_ids: DataFrame | None = None, relation: str = "", subject_type: str = "", subject_ids: DataFrame | None = None, subject_relation: str | None = None, limit: int = 0) -> DataFrame:
    """The store's query: every part is optional, sets of ids are tables with a column `id`; None: any id."""
    out = rels
    for name, value in (("resource_type", resource_type), ("relation", relation), ("subject_type", subject_type)):
        out = out.where(F.col(name) == value) if value else out
    for name, ids in (("resource_id", resource_ids), ("subject_id", subject_ids)):
        out = out if ids is None else out.join(ids.select(F.col("id").alias(name)), name, "left_semi").select(*COLUMNS)
    if subject_relation is not None:
        out = out.where(F.col("subject_relation") == subject_relation)
    out = out.orderBy(*COLUMNS)
    return out.limit(limit) if limit else out


def kinds(rels: DataFrame) -> DataFrame:
    names = ["resource_type", "relation", "subject_type", "subject_relation"]
    return rels.select(*names).distinct().orderBy(*names)


def nonconforming(rels: DataFrame, schema) -> DataFrame:
    """Stored kinds that the schema doesn't allow; a wildcard and a concrete tuple are one kind."""
    allowed = rels.sparkSession.createDataFrame(sorted({k[:4] for k in schema.kinds()}) or [("", "", "", "")], "resource_type string, relation string, subject_type string, subject_relation string")
    found = kinds(rels)
    return found.join(F.broadcast(allowed), found.columns, "left_anti")
