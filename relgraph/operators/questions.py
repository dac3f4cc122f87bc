"""The questions: checks, lookups of resources and of subjects, and expansion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import MaxDepthExceeded
from ..model import ObjectRef, PermissionTree, Relationship, SubjectRef
from ..plans.checkpoint import checkpointed
from ..plans.compile import Goal, resolve
from ..schema.build import Arrow, Expr, Nil, Ref, Schema
from .pairs import PairBound
from .resolve import SubjectBound, restricted, union_all

#: An id that no object can have stands for every subject that no tuple names.
ANONYMOUS = ":anyone"


def key() -> Column:
    """A subject in text."""
    return F.concat("subject_type", F.lit(":"), "subject_id", F.lit("#"), "subject_relation")


def seeds_of(requests: DataFrame) -> DataFrame:
    """Distinct subjects of requests as seeds, each with its rendering as key k."""
    return requests.select("subject_type", "subject_id", "subject_relation").distinct().withColumn("k", key())


def check_bulk(schema: Schema, rels: DataFrame, requests: DataFrame, max_depth: int = 50, closure: DataFrame | None = None) -> DataFrame:
    """requests (resource_type, resource_id, permission, subject columns, any others) with has_permission and error.

    All requests for a permission are answered together, as pairs of subject and resource that narrow on the way.
    An unknown type or permission is an error of its rows alone.
    """
    asked = [(r[0], r[1]) for r in requests.select("resource_type", "permission").distinct().collect()]
    goals = [g for g in asked if schema.has(*g)]
    name = F.concat("resource_type", F.lit("#"), "permission")
    known = name.isin(["#".join(g) for g in goals]) if goals else F.lit(False)
    out = requests.withColumn("k", key())
    found = []
    if goals:
        pairs = out.where(known).select("resource_type", "permission", "k", F.col("resource_id").alias("id"))
        pairs = checkpointed(pairs.distinct()) if len(goals) > 1 else pairs
        bound = PairBound(schema, rels, seeds_of(requests.where(known)), max_depth, closure)
        for g in goals:
            held = bound.holds(g, pairs.where((F.col("resource_type") == g[0]) & (F.col("permission") == g[1])))
            found.append(held.select("k", F.col("id").alias("resource_id"), F.lit(g[0]).alias("resource_type"), F.lit(g[1]).alias("permission")))
    keys = ["k", "resource_type", "resource_id", "permission"]
    if found:
        out = out.join(union_all(found).distinct().withColumn("_yes", F.lit(True)), keys, "left")
    else:
        out = out.withColumn("_yes", F.lit(None).cast("boolean"))
    error = F.when(~known, F.concat(name, F.lit(" isn't defined")))
    return out.withColumn("has_permission", F.coalesce("_yes", F.lit(False))).withColumn("error", error).select(*requests.columns, "has_permission", "error")


def lookup_resources(schema: Schema, rels: DataFrame, goal: Goal, subjects: DataFrame, max_depth: int = 50, closure: DataFrame | None = None) -> DataFrame:
    """(k, id) of the resources on which each subject (k, subject columns) has the permission."""
    return SubjectBound(schema, rels, subjects, max_depth, closure).lookup(goal)


def lookup_subjects(schema: Schema, rels: DataFrame, resource: ObjectRef, name: str, subject_type: str, subject_relation: str = "", max_depth: int = 50, closure: DataFrame | None = None) -> DataFrame:
    """(subject_id, holds) for every subject of the kind that can matter, and for ANONYMOUS, which stands for all others."""
    spark = rels.sparkSession
    goal = resolve(schema, resource.type, name)
    seed = spark.createDataFrame([(resource.type, resource.id)], "type string, id string")
    tuples = restricted(schema, rels, seed, [goal])
    kind = (F.col("subject_type") == subject_type) & (F.col("subject_relation") == subject_relation) & (F.col("subject_id") != "*")
    named = tuples.where(kind).select("subject_id")
    if subject_relation:
        objects = tuples.where(F.col("resource_type") == subject_type).select(F.col("resource_id").alias("subject_id"))
        walked = tuples.where((F.col("subject_type") == subject_type) & (F.col("subject_id") != "*")).select("subject_id")
        named = named.unionByName(objects).unionByName(walked)
        if resource.type == subject_type:
            named = named.unionByName(seed.select(F.col("id").alias("subject_id")))
    else:
        named = named.unionByName(spark.createDataFrame([(ANONYMOUS,)], "subject_id string"))
    candidates = named.distinct().select(F.lit(subject_type).alias("subject_type"), "subject_id", F.lit(subject_relation).alias("subject_relation"), F.col("subject_id").alias("k"))
    # not a literal: the optimizer fails on what it infers from constant columns of checkpoints
    pairs = candidates.select("k", F.substr(F.concat("k", F.lit(resource.id)), F.length("k") + 1).alias("id"))
    held = PairBound(schema, tuples, candidates, max_depth, closure).holds(goal, pairs).select(F.col("k").alias("subject_id"), F.lit(True).alias("holds"))
    return candidates.select("subject_id").join(held, "subject_id", "left").select("subject_id", F.coalesce("holds", F.lit(False)).alias("holds"))


def lookup_subjects_answer(found: DataFrame) -> DataFrame:
    """(subject_id, excluded): the finite answer, or `*` and who it excludes."""
    everyone = found.where((F.col("subject_id") == ANONYMOUS) & F.col("holds")).select(F.lit("*").alias("subject_id"), F.lit(False).alias("excluded"))
    named = found.where(F.col("subject_id") != ANONYMOUS)
    flag = everyone.select(F.lit(True).alias("all"))
    one = named.sparkSession.range(1).select(F.lit(1).alias("one"))
    open_ = one.join(flag.withColumn("one", F.lit(1)), "one", "left").select("one", F.coalesce("all", F.lit(False)).alias("all"))
    return named.withColumn("one", F.lit(1)).join(open_, "one").where(F.col("holds") != F.col("all")).select("subject_id", F.col("all").alias("excluded")).unionByName(everyone)


def expand(schema: Schema, rels: DataFrame, resource: ObjectRef, name: str, max_depth: int = 50) -> PermissionTree:
    """The rewrite tree; relations are leaves with their subjects, arrows are followed, a cycle ends in an empty leaf."""
    goal = resolve(schema, resource.type, name)
    seed = rels.sparkSession.createDataFrame([(resource.type, resource.id)], "type string, id string")
    tuples: dict[tuple[str, str, str], list[SubjectRef]] = {}
    for row in restricted(schema, rels, seed, [goal]).orderBy("resource_type", "resource_id", "relation", "subject_type", "subject_id", "subject_relation").collect():
        r = Relationship.of(row)
        tuples.setdefault((r.resource.type, r.resource.id, r.relation), []).append(r.subject)
    path: set[tuple[ObjectRef, str]] = set()

    def of(obj: ObjectRef, what: str, depth: int) -> PermissionTree:
        if depth > max_depth:
            raise MaxDepthExceeded(f"the tree is deeper than {max_depth}")
        if (obj, what) in path or not schema.has(obj.type, what):
            return PermissionTree("leaf", obj, what)
        if schema.relation(obj.type, what):
            return PermissionTree("leaf", obj, what, tuple(tuples.get((obj.type, obj.id, what), ())))
        path.add((obj, what))
        try:
            return node(obj, what, schema.permission(obj.type, what).expr, depth)
        finally:
            path.discard((obj, what))

    def node(obj: ObjectRef, what: str, e: Expr, depth: int) -> PermissionTree:
        if isinstance(e, Ref):
            return of(obj, e.name, depth + 1)
        if isinstance(e, Nil):
            return PermissionTree("leaf", obj, what)
        if isinstance(e, Arrow):
            to = [s for s in tuples.get((obj.type, obj.id, e.relation), ()) if s.id != "*" and schema.has(s.type, e.target)]
            return PermissionTree("union", obj, what, (), tuple(of(ObjectRef(s.type, s.id), e.target, depth + 1) for s in to))
        return PermissionTree(e.op, obj, what, (), tuple(node(obj, what, c, depth) for c in e.children))

    return of(resource, name, 0)
