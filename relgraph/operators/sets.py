"""Permission sets: for a permission on a resource, the usersets of other objects that grant it.

No wildcard counts: permissions that take one aren't materialised. Sets are reached through arrows; the resource's own relations are static and added when a question is asked.
All rules are linear, so that one table (goal, id, set) grows by joins with paths over arrows, whose length doubles.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.checkpoint import checkpointed, forget
from ..plans.compile import Goal, arrow_targets, counted_relations, deps, static_relations
from ..schema.build import Arrow, Expr, Ref, Schema, SetOp
from .closure import directly_in, member_of
from .groups import Groups
from .resolve import union_all

#: Paths for one step from which paths aren't doubled any more.
MORE_PATHS = 4


def _needed(schema: Schema, wanted: list[Goal]) -> list[Goal]:
    out, todo = [], [g for g in wanted if schema.permission(*g)]
    while todo:
        g = todo.pop()
        if g not in out:
            out.append(g)
            todo += [d for d, _ in deps(schema, g) if schema.permission(*d)]
    return out


def _parts(e: Expr) -> list[Expr]:
    return [p for c in e.children for p in _parts(c)] if isinstance(e, SetOp) else [e]


def walks_arrow(schema: Schema, wanted: list[Goal]) -> set[tuple[str, str]]:
    """(type, relation) over which some needed permission walks an arrow."""
    return {(g[0], e.relation) for g in _needed(schema, wanted) for e in _parts(schema.permission(*g).expr) if isinstance(e, Arrow)}


def permission_sets(schema: Schema, rels: DataFrame, wanted: list[Goal], resources: DataFrame | None = None) -> DataFrame:
    """Rows (resource, permission, set) of the materialised permissions; `resources` (resource_type, resource_id) restricts them."""
    rels = rels.where("subject_id <> '*'")
    goals = _needed(schema, wanted)
    number = {g: i for i, g in enumerate(goals)}
    kinds: list[tuple[str, tuple[str, ...]]] = []  # a set's type, and the relations of it that come together
    base, steps = [], []
    for g in goals:
        for e in _flat(schema, g):
            for t in arrow_targets(schema, g[0], e):
                tuples = rels.where((F.col("resource_type") == g[0]) & (F.col("relation") == e.relation) & (F.col("subject_type") == t))
                if static := tuple(static_relations(schema, (t, e.target))):
                    if (t, static) not in kinds:
                        kinds.append((t, static))
                    base.append(tuples.select(F.lit(number[g]).alias("goal"), F.col("resource_id").alias("id"), F.lit(kinds.index((t, static))).alias("kind"), F.col("subject_id").alias("set_id")))
                if schema.permission(t, e.target):
                    steps.append(tuples.select(F.lit(number[g]).alias("goal"), F.col("resource_id").alias("id"), F.lit(number[t, e.target]).alias("to_goal"), F.col("subject_id").alias("to")))
    none = rels.select(F.col("resource_type"), "resource_id", F.col("relation").alias("permission"), F.col("subject_type").alias("set_type"), F.col("subject_id").alias("set_id"), F.col("relation").alias("set_relation")).where(F.lit(False))
    if not base:
        return none
    found = _reached(union_all(base).distinct(), union_all(steps).where("goal <> to_goal or id <> to").distinct() if steps else None)
    of = lambda column, values: F.element_at(F.array(*map(F.lit, values)), F.col(column) + 1)
    found = found.where(F.col("goal").isin([number[g] for g in wanted if g in number]))
    relations = F.element_at(F.array(*[F.array(*map(F.lit, r)) for _, r in kinds]), F.col("kind") + 1)
    out = found.select(of("goal", [t for t, _ in goals]).alias("resource_type"), F.col("id").alias("resource_id"), of("goal", [p for _, p in goals]).alias("permission"), of("kind", [t for t, _ in kinds]).alias("set_type"), "set_id", F.explode(relations).alias("set_relation"))
    named = [(t, r) for t, static in kinds for r in static]
    if len(set(named)) < len(named):
        out = out.distinct()
    return out if resources is None else out.join(resources, ["resource_type", "resource_id"], "left_semi")


def _flat(schema: Schema, goal: Goal) -> list[Arrow]:
    """The arrows of a permission and of those of the same object that it refers to."""
    seen, todo, out = {goal}, [goal], []
    while todo:
        g = todo.pop()
        for e in _parts(schema.permission(*g).expr):
            if isinstance(e, Arrow):
                out.append(e)
            elif isinstance(e, Ref) and schema.permission(g[0], e.name) and (g[0], e.name) not in seen:
                seen.add((g[0], e.name))
                todo.append((g[0], e.name))
    return list(dict.fromkeys(out))


def _reached(base: DataFrame, steps: DataFrame | None) -> DataFrame:
    """(goal, id, kind, set_id), distinct: `base` and what (goal, id) reach over `steps` (goal, id, to_goal, to).

    By doubling: a step of round n is a path of 2^n of the first ones, so that few rounds shuffle what is known. Where
    the paths become many more than the steps, it goes on with the steps themselves.
    """
    if steps is None:
        return base
    keys = ["goal", "id", "kind", "set_id"]
    known, step = checkpointed(base), checkpointed(steps)
    first, most, count = step, MORE_PATHS * max(step.count(), 1), known.count()

    def over(paths: DataFrame, rows: DataFrame) -> DataFrame:
        to = rows.withColumnRenamed("goal", "to_goal").withColumnRenamed("id", "to")
        return paths.join(to, ["to_goal", "to"]).select(*keys)

    while True:
        paths = step.join(step.select(F.col("goal").alias("to_goal"), F.col("id").alias("to"), F.col("to_goal").alias("g"), F.col("to").alias("i")), ["to_goal", "to"])
        longer = checkpointed(paths.select("goal", "id", F.col("g").alias("to_goal"), F.col("i").alias("to")).distinct())
        n = longer.count()
        both = known.unionByName(over(step, known)).distinct()
        if not n:
            return both
        before, known = known, checkpointed(both)
        forget(before)
        if (now := known.count()) == count:
            return known
        count = now
        if n > most:
            break
        if step is not first:
            forget(step)
        step = longer
    delta, parts = known, [known]
    while not delta.isEmpty():
        delta = checkpointed(over(first, delta).distinct().join(union_all(parts), keys, "left_anti"))
        parts.append(delta)
        if len(parts) > 12:
            parts = [checkpointed(union_all(parts))]
    return union_all(parts)


def affected_resources(schema: Schema, rels: DataFrame, wanted: list[Goal], changed: DataFrame) -> DataFrame:
    """(resource_type, resource_id): the written resources and what reaches them through arrows."""
    over = walks_arrow(schema, wanted)
    walked = reduce(lambda a, b: a | b, [(F.col("resource_type") == t) & (F.col("relation") == r) for t, r in over], F.lit(False))
    steps = rels.where(walked).select("resource_type", "resource_id", F.col("subject_type").alias("t"), F.col("subject_id").alias("i"))
    frontier = checkpointed(changed.select("resource_type", "resource_id").distinct())
    parts = [frontier]
    while not frontier.isEmpty():
        found = steps.join(frontier.select(F.col("resource_type").alias("t"), F.col("resource_id").alias("i")), ["t", "i"]).select("resource_type", "resource_id").distinct()
        frontier = checkpointed(found.join(union_all(parts), ["resource_type", "resource_id"], "left_anti"))
        parts.append(frontier)
    return union_all(parts)


def apply_sets(schema: Schema, rels_after: DataFrame, wanted: list[Goal], stored: DataFrame, changed: DataFrame) -> DataFrame:
    """The stored rows after a write: those of the affected resources are derived again, the others stay."""
    affected = checkpointed(affected_resources(schema, rels_after, wanted, changed))
    kept = stored.join(affected, ["resource_type", "resource_id"], "left_anti")
    seeds = affected.select(F.col("resource_type").alias("type"), F.col("resource_id").alias("id"))
    from .resolve import restricted

    fresh = permission_sets(schema, restricted(schema, rels_after, seeds, wanted), wanted, affected)
    return checkpointed(kept.unionByName(fresh))


# queries on the sets

USERSET = ["type", "id", "relation"]


def _counted(schema: Schema, goal: Goal, rels: DataFrame) -> DataFrame:
    """The tuples of the relations whose subjects can have the goal."""
    return rels.where(reduce(lambda a, b: a | b, [(F.col("resource_type") == t) & (F.col("relation") == r) for t, r in counted_relations(schema, goal)], F.lit(False)))


def _links(schema: Schema, goal: Goal, closure: DataFrame) -> DataFrame:
    """The closure's rows that can matter for the goal: a userset (type, id, relation), and one within (t, i, r)."""
    own = reduce(lambda a, b: a | b, [(F.col("ancestor_type") == t) & (F.col("ancestor_relation") == r) for t, r in counted_relations(schema, goal)], F.lit(False))
    return closure.where(own).select(F.col("ancestor_type").alias("type"), F.col("ancestor_id").alias("id"), F.col("ancestor_relation").alias("relation"), F.col("descendant_type").alias("t"), F.col("descendant_id").alias("i"), F.col("descendant_relation").alias("r"))


def granting(schema: Schema, sets: DataFrame, goal: Goal, resources: DataFrame) -> DataFrame:
    """(resource_id, type, id, relation): the usersets that grant the goal on each of `resources` (resource_id)."""
    stored = sets.where((F.col("resource_type") == goal[0]) & (F.col("permission") == goal[1])).select("resource_id", F.col("set_type").alias("type"), F.col("set_id").alias("id"), F.col("set_relation").alias("relation"))
    stored = stored.join(resources, "resource_id", "left_semi")
    own = [resources.select("resource_id", F.lit(goal[0]).alias("type"), F.col("resource_id").alias("id"), F.lit(r).alias("relation")) for r in static_relations(schema, goal)]
    return union_all([stored, *own])


def resources_with_permission(schema: Schema, rels: DataFrame, closure: DataFrame, sets: DataFrame, goal: Goal, subjects: DataFrame, among: DataFrame | None = None) -> DataFrame:
    """(k, id): the resources on which each subject has the permission; `among` (id) narrows them."""
    held = checkpointed(member_of(rels, closure, subjects, wildcards=False))
    stored = sets.where((F.col("resource_type") == goal[0]) & (F.col("permission") == goal[1])).select(F.col("resource_id"), F.col("set_type").alias("type"), F.col("set_id").alias("id"), F.col("set_relation").alias("relation"))
    found = stored.join(held, ["type", "id", "relation"]).select("k", F.col("resource_id").alias("id"))
    static = held.where((F.col("type") == goal[0]) & F.col("relation").isin(static_relations(schema, goal))).select("k", "id")
    own = subjects.where((F.col("subject_type") == goal[0]) & (F.col("subject_relation") == goal[1])).select("k", F.col("subject_id").alias("id"))
    out = found.unionByName(static).unionByName(own).distinct()
    return out if among is None else out.join(among, "id", "left_semi")


def has_permission(schema: Schema, rels: DataFrame, closure: DataFrame, sets: DataFrame, goal: Goal, requests: DataFrame) -> DataFrame:
    """requests (resource_id, k, subject columns) for one goal, with has_permission: who grants it on the asked resources, and whether the subject stands there.

    The asked pairs go down from what grants the goal, since a subject can stand in far more than what it is asked about.
    """
    subjects = requests.select("k", "subject_type", "subject_id", "subject_relation").distinct()
    held = directly_in(_counted(schema, goal, rels), subjects, wildcards=False)
    pairs = requests.select("k", "resource_id").distinct()
    grants = granting(schema, sets, goal, requests.select("resource_id").distinct())
    asked = checkpointed(pairs.join(grants, "resource_id"))
    direct = asked.join(held, ["k", *USERSET], "left_semi").select("k", "resource_id")
    nested = asked.join(_links(schema, goal, closure), USERSET).select("k", "resource_id", F.col("t").alias("type"), F.col("i").alias("id"), F.col("r").alias("relation")).join(held, ["k", *USERSET], "left_semi").select("k", "resource_id")
    found = direct.unionByName(nested)
    own = subjects.where((F.col("subject_type") == goal[0]) & (F.col("subject_relation") == goal[1])).select("k", F.col("subject_id").alias("resource_id"))
    yes = found.unionByName(own).distinct().withColumn("yes", F.lit(True))
    return requests.join(yes, ["k", "resource_id"], "left").withColumn("has_permission", F.coalesce("yes", F.lit(False))).drop("yes")


def _found(schema: Schema, rels: DataFrame, closure: DataFrame, sets: DataFrame, goal: Goal, resources: DataFrame, subject_type: str, subject_relation: str, within: DataFrame | None = None) -> Groups:
    """Resources (with `within` (resource_id, r), what they are part of) and their subjects, met in usersets."""
    grants = granting(schema, sets, goal, resources)
    below = grants.join(_links(schema, goal, closure), USERSET).select("resource_id", F.col("t").alias("type"), F.col("i").alias("id"), F.col("r").alias("relation"))
    all_sets = checkpointed(grants.unionByName(below).distinct())
    all_sets = all_sets.withColumn("r", F.col("resource_id")) if within is None else all_sets.join(within, "resource_id")
    u = F.concat("type", F.lit(":"), "id", F.lit("#"), "relation").alias("u")
    tuples = _counted(schema, goal, rels).where((F.col("subject_type") == subject_type) & (F.col("subject_relation") == subject_relation))
    members = tuples.select(F.col("resource_type").alias("type"), F.col("resource_id").alias("id"), "relation", F.col("subject_id").alias("s")).select(u, "s").distinct()
    own = all_sets.where((F.col("type") == subject_type) & (F.col("relation") == subject_relation)).select("r", F.col("id").alias("s")) if subject_relation else None
    return Groups(all_sets.select("r", u), members, own)


def subjects_with_permission(schema: Schema, rels: DataFrame, closure: DataFrame, sets: DataFrame, goal: Goal, resources: DataFrame, subject_type: str, subject_relation: str = "") -> DataFrame:
    """(resource_id, subject_id): who has the permission, the granting usersets being looked through."""
    return _found(schema, rels, closure, sets, goal, resources, subject_type, subject_relation).pairs().select(F.col("r").alias("resource_id"), F.col("s").alias("subject_id"))


def subject_counts(schema: Schema, rels: DataFrame, closure: DataFrame, sets: DataFrame, goal: Goal, within: DataFrame, subject_type: str, subject_relation: str = "") -> DataFrame:
    """(r, n): the number of subjects that have the permission on any of the resources of r, for `within` (resource_id, r), without listing them."""
    return _found(schema, rels, closure, sets, goal, within.select("resource_id").distinct(), subject_type, subject_relation, within.distinct()).counts()


def drift(want: DataFrame, have: DataFrame) -> DataFrame:
    """Rows that are missing or extra, with a column `drift`."""
    have = have.select(*want.columns)
    return want.exceptAll(have).withColumn("drift", F.lit("missing")).unionByName(have.exceptAll(want).withColumn("drift", F.lit("extra")))
