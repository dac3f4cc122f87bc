"""The userset closure: which usersets are nested in which, and its maintenance.

Nodes are written `type:id#relation` inside the loops; no legal name or id contains `:` or `#`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import NestingTooLarge
from ..model import CLOSURE
from ..plans.checkpoint import checkpointed
from .resolve import union_all

DEFAULT_BUDGET = 100_000


def node(prefix: str) -> Column:
    return F.concat(F.col(f"{prefix}_type"), F.lit(":"), F.col(f"{prefix}_id"), F.lit("#"), F.col(f"{prefix}_relation"))


def nesting_edges(rels: DataFrame) -> DataFrame:
    """(a, d): userset a directly contains userset d."""
    resource = F.concat("resource_type", F.lit(":"), "resource_id", F.lit("#"), "relation")
    return rels.where("subject_relation <> ''").select(resource.alias("a"), node("subject").alias("d")).where("a <> d").distinct()


def unpacked(pairs: DataFrame) -> DataFrame:
    """The closure's six columns for pairs (a, d)."""
    cols = []
    for c, side in (("a", "ancestor"), ("d", "descendant")):
        cols += [F.split_part(c, F.lit(":"), F.lit(1)).alias(f"{side}_type"), F.split_part(F.split_part(c, F.lit(":"), F.lit(2)), F.lit("#"), F.lit(1)).alias(f"{side}_id"), F.split_part(c, F.lit("#"), F.lit(2)).alias(f"{side}_relation")]
    return pairs.select(*cols)


def packed(closure: DataFrame) -> DataFrame:
    return closure.select(node("ancestor").alias("a"), node("descendant").alias("d"))


def _composed(left: DataFrame, right: DataFrame) -> DataFrame:
    """a contains m in left, m contains d in right."""
    return left.select("a", F.col("d").alias("m")).join(right.select(F.col("a").alias("m"), "d"), "m").select("a", "d").where("a <> d")


def transitive(edges: DataFrame) -> DataFrame:
    """All pairs (a, d), a <> d, that edges lead through, by path doubling: rounds grow with the log of the depth."""
    delta = checkpointed(edges.where("a <> d").distinct())
    known = delta
    while not delta.isEmpty():
        new = _composed(delta, known).unionByName(_composed(known, delta)).distinct()
        delta = checkpointed(new.join(known, ["a", "d"], "left_anti"))
        known = checkpointed(known.unionByName(delta))
    return known


def closure_of(rels: DataFrame) -> DataFrame:
    return unpacked(transitive(nesting_edges(rels)))


def _rectangle(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """For each edge (a, d): what is above a or a itself, with what is below d or d itself."""
    above = pairs.select(F.col("a").alias("up"), F.col("d").alias("a"))
    below = pairs.select(F.col("a").alias("d"), F.col("d").alias("down"))
    up = edges.select("a", "d", F.col("a").alias("up")).unionByName(edges.join(above, "a").select("a", "d", "up"))
    both = up.join(below, "d").select(F.col("up").alias("a"), F.col("down").alias("d"))
    return both.unionByName(up.select(F.col("up").alias("a"), "d")).where("a <> d").distinct()


def edges_added(pairs: DataFrame, added: DataFrame, budget: int | None = None) -> DataFrame:
    """The pairs after edges are added; with a `budget`, more new ones are refused before anything is written."""
    known, total = pairs, 0
    while True:
        new = checkpointed(_rectangle(known, added).join(known, ["a", "d"], "left_anti"))
        n = new.count()
        total += n
        if budget is not None and total > budget:
            raise NestingTooLarge(f"the change adds more than {budget} nested usersets")
        if not n:
            return known
        known = checkpointed(known.unionByName(new))


def edges_removed(pairs: DataFrame, removed: DataFrame, edges_after: DataFrame) -> DataFrame:
    """The pairs after edges are removed: every pair that may have led through one is dropped, and what is below is climbed again."""
    doubtful = checkpointed(_rectangle(pairs, removed))
    kept = checkpointed(pairs.join(doubtful, ["a", "d"], "left_anti"))
    below = doubtful.select("d").distinct()
    step = edges_after.select(F.col("a").alias("up"), F.col("d").alias("a"))
    frontier = checkpointed(edges_after.join(below, "d", "left_semi").select("a", "d").distinct())
    parts = [frontier]
    while not frontier.isEmpty():
        new = frontier.join(step, "a").select(F.col("up").alias("a"), "d").where("a <> d").distinct()
        frontier = checkpointed(new.join(union_all(parts), ["a", "d"], "left_anti"))
        parts.append(frontier)
    return checkpointed(kept.unionByName(union_all(parts)).distinct())


def empty_closure(spark) -> DataFrame:
    return spark.createDataFrame([], CLOSURE)


# queries on the closure


def nested_relationships(rels: DataFrame, closure: DataFrame, usersets: DataFrame, subject_type: str = "", subject_id: str = "", subject_relation: str | None = None) -> DataFrame:
    """Tuples on `usersets` (type, id, relation) and on all usersets nested in them, with subject filters."""
    below = closure.join(usersets, (F.col("ancestor_type") == F.col("type")) & (F.col("ancestor_id") == F.col("id")) & (F.col("ancestor_relation") == F.col("relation")), "left_semi")
    all_sets = usersets.select("type", "id", "relation").unionByName(below.select(F.col("descendant_type").alias("type"), F.col("descendant_id").alias("id"), F.col("descendant_relation").alias("relation"))).distinct()
    sets = all_sets.select(F.col("type").alias("resource_type"), F.col("id").alias("resource_id"), "relation")
    out = rels.join(sets, ["resource_type", "resource_id", "relation"], "left_semi")
    for name, value in (("subject_type", subject_type), ("subject_id", subject_id)):
        out = out.where(F.col(name) == value) if value else out
    return out if subject_relation is None else out.where(F.col("subject_relation") == subject_relation)


def directly_in(rels: DataFrame, subjects: DataFrame, wildcards: bool = True) -> DataFrame:
    """(k, type, id, relation): usersets that hold each subject (k, subject_type, subject_id, subject_relation) by its name, by a wildcard, or as themselves."""
    names = ["subject_type", "subject_id", "subject_relation"]
    here = ["k", F.col("resource_type").alias("type"), F.col("resource_id").alias("id"), "relation"]
    direct = rels.join(subjects, names).select(*here)
    wild = rels.where("subject_id = '*' and subject_relation = ''").join(subjects.where("subject_relation = ''").select("k", "subject_type"), "subject_type").select(*here)
    own = subjects.where("subject_relation <> ''").select("k", F.col("subject_type").alias("type"), F.col("subject_id").alias("id"), F.col("subject_relation").alias("relation"))
    return (direct.unionByName(wild) if wildcards else direct).unionByName(own).distinct()


def member_of(rels: DataFrame, closure: DataFrame, subjects: DataFrame, wildcards: bool = True) -> DataFrame:
    """(k, type, id, relation): usersets that hold each subject, directly or nested.

    Without `wildcards`, by name alone: where no wildcard can count, every subject would still be paired with all of them.
    """
    first = directly_in(rels, subjects, wildcards)
    links = closure.select(F.col("descendant_type").alias("type"), F.col("descendant_id").alias("id"), F.col("descendant_relation").alias("relation"), F.col("ancestor_type").alias("t"), F.col("ancestor_id").alias("i"), F.col("ancestor_relation").alias("r"))
    above = first.join(links, ["type", "id", "relation"]).select("k", F.col("t").alias("type"), F.col("i").alias("id"), F.col("r").alias("relation"))
    return first.unionByName(above).distinct()


def nested_resource_ids(rels: DataFrame, closure: DataFrame, resource_type: str, relation: str, subjects: DataFrame, among: DataFrame | None = None) -> DataFrame:
    """(id) of resources on whose relation any of `subjects` stands, directly or nested; `among` (id) narrows them."""
    out = member_of(rels, closure, subjects).where((F.col("type") == resource_type) & (F.col("relation") == relation)).select("id").distinct()
    return out if among is None else out.join(among, "id", "left_semi")
