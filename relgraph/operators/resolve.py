"""Subject-bound evaluation: for seed subjects k, the objects on which each goal holds, by semi-naive fixpoints.

Since subjects are concrete, wildcards need no algebra: a wildcard tuple joins every plain seed of its type.
Every goal is evaluated once for all seeds. A recursive stratum runs as one table (goal, k, id) in rounds,
each of which joins only what the last one found; exclusions inside read lower strata, or, where the right
side leads back into the stratum, the other bound of an alternating fixpoint.
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidArgument, MaxDepthExceeded
from ..plans.checkpoint import checkpointed, forget
from ..plans.compile import Goal, Stratum, arrow_targets, deps, expr_deps, strata
from ..schema.build import Arrow, Expr, Ref, Schema, SetOp
from .groups import Groups

#: Tables of rounds that are read as a union before they are written as one.
MOST_PARTS = 12
#: Seeds from which resources are grouped.
MANY = 1000


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def merged(parts: list[DataFrame]) -> list[DataFrame]:
    """Checkpoints of rounds as one, their own files deleted."""
    out = checkpointed(union_all(parts))
    for p in parts:
        forget(p)
    return [out]


class SubjectBound:
    """seeds: (k, subject_type, subject_id, subject_relation); a goal's result: (k, id), distinct."""

    def __init__(self, schema: Schema, rels: DataFrame, seeds: DataFrame, max_depth: int = 50, closure: DataFrame | None = None):
        self.schema, self.rels, self.seeds, self.max_depth = schema, rels, seeds, max_depth
        self.closure = closure
        self.done: dict[Goal, DataFrame] = {}
        self.nothing = seeds.select("k", F.col("subject_id").alias("id")).where(F.lit(False))
        self._held: DataFrame | None = None

    # with a closure

    def closed(self, goal: Goal) -> bool:
        """Whether the closure answers a relation: there is one, and no permission stands among the usersets nested in it."""
        if self.closure is None or self.schema.relation(*goal) is None:
            return False
        seen, todo = set(), [goal]
        while todo:
            if (g := todo.pop()) in seen:
                continue
            seen.add(g)
            if (r := self.schema.relation(*g)) is None:
                return False
            todo += [(s.type, s.relation) for s in r.subjects if s.relation]
        return True

    def _above(self, first: DataFrame, *keys: str) -> DataFrame:
        """Usersets (type, id, relation) and all that they are nested in, for each value of `keys`."""
        up = self.closure.selectExpr("descendant_type as type", "descendant_id as id", "descendant_relation as relation", "ancestor_type as t", "ancestor_id as i", "ancestor_relation as r")
        above = first.join(up, ["type", "id", "relation"]).select(*keys, F.col("t").alias("type"), F.col("i").alias("id"), F.col("r").alias("relation"))
        return first.unionByName(above).distinct()

    def held(self) -> DataFrame:
        """(k, type, id, relation): the usersets that the seeds stand in by name, directly or nested, and are themselves."""
        if self._held is None:
            named = self.rels.where("subject_id <> '*'").join(self.seeds, ["subject_type", "subject_id", "subject_relation"]).select("k", F.col("resource_type").alias("type"), F.col("resource_id").alias("id"), "relation")
            own = self.seeds.where("subject_relation <> ''").select("k", F.col("subject_type").alias("type"), F.col("subject_id").alias("id"), F.col("subject_relation").alias("relation"))
            self._held = checkpointed(self._above(named.unionByName(own).distinct(), "k"))
        return self._held

    def open_to(self, goal: Goal) -> DataFrame:
        """(id, subject_type): the objects on whose relation every plain subject of a type stands, by a wildcard, directly or nested."""
        if not self.closed(goal):
            return self._tuples(goal).where("subject_id = '*'").select(F.col("resource_id").alias("id"), "subject_type").distinct()
        first = self.rels.where("subject_id = '*'").select(F.col("resource_type").alias("type"), F.col("resource_id").alias("id"), "relation", "subject_type").distinct()
        return self._above(first, "subject_type").where((F.col("type") == goal[0]) & (F.col("relation") == goal[1])).select("id", "subject_type")

    def goal(self, goal: Goal) -> DataFrame:
        recursive = {g for s in strata(self.schema, [goal]) if s.recursive for g in s.goals}
        for stratum in strata(self.schema, [goal], lambda g: self._needs(g, recursive)):
            if any(g not in self.done for g in stratum.goals):
                self._evaluate(stratum)
        return self.done[goal]

    def lookup(self, goal: Goal) -> DataFrame:
        """Like `goal`; what many seeds reach over tuples is expanded from classes of resources that lead to the same objects."""
        found = self.goal(goal)
        (top,) = [s for s in strata(self.schema, [goal]) if goal in s.goals]
        if top.recursive:
            return found
        hops, plain = self._ways(goal)
        if not hops or self.seeds.limit(MANY).count() < MANY:
            return found
        u = lambda target, id_: F.concat(F.lit(f"{'#'.join(target)}:"), id_).alias("u")
        links = union_all([tuples.select(F.col("resource_id").alias("r"), u(t, F.col("subject_id"))) for tuples, t in hops])
        members = checkpointed(union_all([self.done[t].select(u(t, F.col("id")), F.col("k").alias("s")) for t in dict.fromkeys(t for _, t in hops)]))
        more = union_all([p.select(F.col("id").alias("r"), F.col("k").alias("s")) for p in plain])
        return Groups(links, members, more).pairs().select(F.col("s").alias("k"), F.col("r").alias("id"))

    def _ways(self, goal: Goal) -> tuple[list[tuple[DataFrame, Goal]], list[DataFrame]]:
        """What unites to an evaluated goal outside of recursive strata: tuples with the goals that they lead to, and pairs (k, id)."""
        hops: list[tuple[DataFrame, Goal]] = []
        plain: list[DataFrame] = []

        def over(tuples: DataFrame, t: Goal) -> None:
            hops.append((tuples.where((F.col("subject_type") == t[0]) & (F.col("subject_id") != "*")), t))

        def of(g: Goal) -> None:
            if self.schema.relation(*g) is not None:
                if any(s.recursive for s in strata(self.schema, [g]) if g in s.goals):
                    plain.append(self.done[g])
                    return
                plain.append(self._base(g))
                for w in self._walked(g):
                    over(self._tuples(g).where(F.col("subject_relation") == w[1]), w)
                return
            e = self.schema.permission(*g).expr
            if isinstance(e, SetOp) and e.op != "union":
                plain.append(self.done[g])
                return
            plain.append(self._reflexive(g))
            walk(g[0], e)

        def walk(type_: str, e: Expr) -> None:
            if isinstance(e, Ref):
                of((type_, e.name))
            elif isinstance(e, Arrow):
                for t in arrow_targets(self.schema, type_, e):
                    over(self._tuples((type_, e.relation)), (t, e.target))
            elif isinstance(e, SetOp) and e.op == "union":
                for c in e.children:
                    walk(type_, c)
            else:
                plain.append(self._expr(type_, e, self.done, self.done))

        of(goal)
        return hops, plain

    def _named(self, type_: str, e: Expr) -> Expr | None:
        """The operand of an intersection that plain tuples answer, by which the others are narrowed."""
        plain = lambda c: isinstance(c, Ref) and (r := self.schema.relation(type_, c.name)) is not None and not any(s.relation or s.wildcard for s in r.subjects)
        return next((c for c in e.children if plain(c)), None) if isinstance(e, SetOp) and e.op == "intersection" else None

    def _needs(self, goal: Goal, recursive: set[Goal]) -> list[tuple[Goal, bool]]:
        """What a goal is evaluated from: of an intersection outside of recursive strata, the operand that narrows the others."""
        if self.schema.relation(*goal) is not None or goal in recursive:
            return deps(self.schema, goal)

        def kept(e: Expr) -> Expr:
            return self._named(goal[0], e) or (replace(e, children=tuple(map(kept, e.children))) if isinstance(e, SetOp) else e)

        return expr_deps(self.schema, goal[0], kept(self.schema.permission(*goal).expr))

    def _intersection(self, type_: str, e: SetOp, state: dict, against: dict) -> DataFrame:
        first = self._named(type_, e)
        if first is None or all(d in state for d, _ in expr_deps(self.schema, type_, e)):
            return reduce(lambda a, b: a.join(b, ["k", "id"], "left_semi"), [self._expr(type_, c, state, against) for c in e.children])
        from .pairs import PairBound

        bound = PairBound(self.schema, self.rels, self.seeds, self.max_depth, self.closure)
        found = checkpointed(self._expr(type_, first, state, against))
        for c in e.children:
            if c is not first:
                found = checkpointed(bound.narrowed(type_, c, found))
        return found

    def _evaluate(self, s: Stratum) -> None:
        if not s.recursive:
            (g,) = s.goals
            self.done[g] = self._full(g, self.done, self.done).distinct()
        elif not s.negative:
            self.done |= self._least(s, self.done)
        else:
            low = dict.fromkeys(s.goals, self.nothing)
            n = -1
            while True:
                high = self._least(s, self.done | low)
                low = self._least(s, self.done | high)
                now = sum(low[g].count() for g in s.goals)
                if now == n:
                    break
                n = now
            if sum(high[g].count() for g in s.goals) != n:
                raise InvalidArgument(f"negative recursion through a data cycle in {', '.join('#'.join(g) for g in s.goals)}")
            self.done |= low

    def _least(self, s: Stratum, against: dict[Goal, DataFrame]) -> dict[Goal, DataFrame]:
        """Least fixpoint of a stratum; exclusions' right sides read `against`."""
        number = {g: i for i, g in enumerate(s.goals)}

        def tagged(frames: dict[Goal, DataFrame | None]) -> DataFrame | None:
            parts = [self._asked(g, f).select(F.lit(number[g]).alias("goal"), "k", "id") for g, f in frames.items() if f is not None]
            return union_all(parts).distinct() if parts else None

        def of(df: DataFrame) -> dict[Goal, DataFrame]:
            return {g: df.where(F.col("goal") == i).select("k", "id") for g, i in number.items()}

        empty = dict.fromkeys(s.goals, self.nothing)
        delta = checkpointed(tagged({g: self._full(g, self.done | empty, against) for g in s.goals}))
        parts, rounds = [delta], 0
        while not delta.isEmpty():
            rounds += 1
            if rounds > self.max_depth:
                raise MaxDepthExceeded(f"no end after {self.max_depth} rounds")
            known = union_all(parts)
            new = tagged({g: self._delta(g, self.done | of(known), of(delta), against, set(s.goals)) for g in s.goals})
            if new is None:
                break
            delta = checkpointed(new.join(known, ["goal", "k", "id"], "left_anti"))
            parts.append(delta)
            if len(parts) > MOST_PARTS:
                parts = merged(parts[:-1]) + parts[-1:]
        return of(union_all(parts))

    def _asked(self, goal: Goal, found: DataFrame) -> DataFrame:
        """What of `found` can matter."""
        return found

    # one goal, from the current state of the others

    def _tuples(self, goal: Goal) -> DataFrame:
        return self.rels.where((F.col("resource_type") == goal[0]) & (F.col("relation") == goal[1]))

    def _hop(self, tuples: DataFrame, type_: str, held: DataFrame) -> DataFrame:
        """Resources whose tuple leads to an object of `type_` that is held."""
        to = tuples.where((F.col("subject_type") == type_) & (F.col("subject_id") != "*")).select("resource_id", "subject_id")
        return to.join(held.withColumnRenamed("id", "subject_id"), "subject_id").select("k", F.col("resource_id").alias("id"))

    def _reflexive(self, goal: Goal) -> DataFrame:
        return self.seeds.where((F.col("subject_type") == goal[0]) & (F.col("subject_relation") == goal[1])).select("k", F.col("subject_id").alias("id"))

    def _base(self, goal: Goal) -> DataFrame:
        """What a relation's tuples say of the seeds themselves: by name, by wildcard, and of the userset that a seed is."""
        plain = self.seeds.where("subject_relation = ''").select("k", "subject_type")
        wild = self.open_to(goal).join(plain, "subject_type").select("k", "id")
        if self.closed(goal):
            named = self.held().where((F.col("type") == goal[0]) & (F.col("relation") == goal[1])).select("k", "id")
        else:
            named = self._tuples(goal).join(self.seeds, ["subject_type", "subject_id", "subject_relation"]).select("k", F.col("resource_id").alias("id")).unionByName(self._reflexive(goal))
        return named.unionByName(wild)

    def _walked(self, goal: Goal) -> list[Goal]:
        """The goals of the usersets that a relation is walked through; none, if the closure answers it."""
        return [] if self.closed(goal) else list(dict.fromkeys((s.type, s.relation) for s in self.schema.relation(*goal).subjects if s.relation))

    def _full(self, goal: Goal, state: dict, against: dict) -> DataFrame:
        if self.schema.relation(*goal) is None:
            return self._expr(goal[0], self.schema.permission(*goal).expr, state, against).unionByName(self._reflexive(goal))
        nested = [self._hop(self._tuples(goal).where(F.col("subject_relation") == g[1]), g[0], state[g]) for g in self._walked(goal)]
        return union_all([self._base(goal), *nested])

    def _expr(self, type_: str, e: Expr, state: dict, against: dict) -> DataFrame:
        if isinstance(e, Ref):
            return state[type_, e.name]
        if isinstance(e, Arrow):
            tuples = self._tuples((type_, e.relation))
            parts = [self._hop(tuples, t, state[t, e.target]) for t in arrow_targets(self.schema, type_, e)]
            return union_all(parts) if parts else self.nothing
        if isinstance(e, SetOp):
            if e.op == "exclusion":
                left, right = e.children
                return self._expr(type_, left, state, against).join(self._expr(type_, right, against, state), ["k", "id"], "left_anti")
            if e.op == "union":
                return union_all([self._expr(type_, c, state, against) for c in e.children])
            return self._intersection(type_, e, state, against)
        return self.nothing

    def _delta(self, goal: Goal, state: dict, delta: dict, against: dict, own: set[Goal]) -> DataFrame | None:
        if self.schema.relation(*goal) is None:
            return self._expr_delta(goal[0], self.schema.permission(*goal).expr, state, delta, against, own)
        parts = [self._hop(self._tuples(goal).where(F.col("subject_relation") == g[1]), g[0], delta[g]) for g in self._walked(goal) if g in own]
        return union_all(parts) if parts else None

    def _expr_delta(self, type_: str, e: Expr, state: dict, delta: dict, against: dict, own: set[Goal]) -> DataFrame | None:
        """What an expression gains when the stratum's goals gain `delta`; None if it can't gain."""
        again = lambda c: self._expr_delta(type_, c, state, delta, against, own)
        if isinstance(e, Ref):
            return delta[type_, e.name] if (type_, e.name) in own else None
        if isinstance(e, Arrow):
            tuples = self._tuples((type_, e.relation))
            parts = [self._hop(tuples, t, delta[t, e.target]) for t in arrow_targets(self.schema, type_, e) if (t, e.target) in own]
            return union_all(parts) if parts else None
        if isinstance(e, SetOp):
            if e.op == "exclusion":
                gain = again(e.children[0])
                return None if gain is None else gain.join(self._expr(type_, e.children[1], against, state), ["k", "id"], "left_anti")
            gains = [again(c) for c in e.children]
            parts = []
            for i, gain in enumerate(gains):
                if gain is not None and e.op == "intersection":
                    for j, c in enumerate(e.children):
                        if j != i:
                            gain = gain.join(self._expr(type_, c, state, against), ["k", "id"], "left_semi")
                if gain is not None:
                    parts.append(gain)
            return union_all(parts) if parts else None
        return None


def walked_relations(schema: Schema, goals: list[Goal]) -> set[Goal]:
    """(type, relation) of the tuples that lead from one object to another when `goals` are evaluated."""
    out: set[Goal] = set()

    def arrows(type_: str, e: Expr) -> None:
        if isinstance(e, Arrow):
            out.add((type_, e.relation))
        for c in e.children if isinstance(e, SetOp) else ():
            arrows(type_, c)

    for s in strata(schema, goals):
        for g in s.goals:
            if schema.relation(*g) is None:
                arrows(g[0], schema.permission(*g).expr)
            else:
                out.add(g)
    return out


def reachable(schema: Schema, rels: DataFrame, seeds: DataFrame, goals: list[Goal]) -> DataFrame:
    """(type, id): the objects that `goals` on `seeds` can lead to, breadth-first over tuples."""
    types = [t for t, d in schema.definitions.items() if d.relations or d.permissions]
    over = reduce(lambda a, b: a | b, [(F.col("resource_type") == t) & (F.col("relation") == r) for t, r in sorted(walked_relations(schema, goals))], F.lit(False))
    steps = rels.where(over & F.col("subject_type").isin(types) & (F.col("subject_id") != "*"))
    frontier = checkpointed(seeds.select("type", "id").distinct())
    parts = [frontier]
    while not frontier.isEmpty():
        seen = union_all(parts)
        found = steps.join(frontier, (F.col("resource_type") == F.col("type")) & (F.col("resource_id") == F.col("id")), "left_semi").select(F.col("subject_type").alias("type"), F.col("subject_id").alias("id")).distinct()
        frontier = checkpointed(found.join(seen, ["type", "id"], "left_anti"))
        parts.append(frontier)
        if len(parts) > MOST_PARTS:
            parts = [checkpointed(union_all(parts))]
    return union_all(parts)


def restricted(schema: Schema, rels: DataFrame, seeds: DataFrame, goals: list[Goal]) -> DataFrame:
    """The tuples that can matter for `goals` on `seeds` (type, id)."""
    found = reachable(schema, rels, seeds, goals)
    return checkpointed(rels.join(found, (F.col("resource_type") == F.col("type")) & (F.col("resource_id") == F.col("id")), "left_semi"))
