"""Pair-bound evaluation: of asked pairs (k, id), those on which a goal holds, by narrowing.

Every step asks only about the pairs that are still open: a union drops what an operand has found, an
intersection goes on with what all operands so far hold on, an exclusion asks its right side about what the left
one admits, and usersets and arrows turn pairs into pairs on the objects that tuples lead to. Wildcards stay
symbolic: a pair is looked up among the objects that are open to its subject's type. In a recursive stratum the
pairs that can matter are collected first, and the fixpoint runs over these alone. Where many subjects are asked about,
what objects grant to subjects that they don't name is found once an object (`objects`), and only pairs whose subject may
be named on the way are collected.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import MaxDepthExceeded
from ..plans.checkpoint import checkpointed
from ..plans.compile import Goal, Stratum, arrow_targets, strata
from ..schema.build import Arrow, Expr, Ref, Schema, SetOp
from .objects import MASK, NODE, Granted, Leaves, bits, small
from .resolve import MOST_PARTS, SubjectBound, merged, union_all

PAIR = ["k", "id"]
#: Subjects from which a recursive stratum is evaluated by objects, if it leads over no more tuples than so many a pair.
MANY_SUBJECTS, TUPLES_A_PAIR = 1000, 10


class PairBound(SubjectBound):
    """What has been asked of a goal is remembered, so that a pair is evaluated once."""

    def __init__(self, schema: Schema, rels: DataFrame, seeds: DataFrame, max_depth: int = 50, closure: DataFrame | None = None):
        super().__init__(schema, rels, seeds, max_depth, closure)
        self.memo: dict[Goal, tuple[DataFrame, DataFrame]] = {}
        self.demand: dict[Goal, DataFrame] = {}

    def holds(self, goal: Goal, pairs: DataFrame) -> DataFrame:
        """The distinct `pairs` on which the goal holds."""
        pairs = pairs.select(*PAIR).distinct()
        if goal not in self.memo:
            pairs = checkpointed(pairs)
            self.memo[goal] = pairs, self._evaluated(goal, pairs)
            return self.memo[goal][1]
        asked, held = self.memo[goal]
        new = checkpointed(pairs.join(asked, PAIR, "left_anti"))
        if not new.isEmpty():
            held = checkpointed(held.unionByName(self._evaluated(goal, new)))
            self.memo[goal] = checkpointed(asked.unionByName(new)), held
        return held.join(pairs, PAIR, "left_semi")

    def _held_among(self, goal: Goal, pairs: DataFrame) -> DataFrame:
        """Like `holds`; a relation that its own tuples answer is looked up without a table of what was asked."""
        if goal in self.memo or self.schema.relation(*goal) is None or not self.closed(goal) and self._walked(goal):
            return self.holds(goal, pairs)
        return checkpointed(self._said(goal, pairs).distinct())

    def _evaluated(self, goal: Goal, pairs: DataFrame) -> DataFrame:
        s = next(s for s in strata(self.schema, [goal]) if goal in s.goals)
        if s.recursive and not self.closed(goal):
            return self._fixpoint(s, goal, pairs)
        if self.schema.relation(*goal) is not None:
            return self._relation(goal, pairs)
        own = pairs.join(self._reflexive(goal), PAIR, "left_semi")
        return checkpointed(own.unionByName(self.narrowed(goal[0], self.schema.permission(*goal).expr, pairs)).distinct())

    def _said(self, goal: Goal, pairs: DataFrame) -> DataFrame:
        """The pairs on which a relation's own tuples (with a closure, also nested ones) say that it holds."""
        subjects = pairs.join(self.seeds, "k")
        plain = subjects.where("subject_relation = ''").select(*PAIR, "subject_type")
        wild = plain.join(self.open_to(goal), ["id", "subject_type"], "left_semi").select(*PAIR)
        if self.closed(goal):
            named = pairs.join(self.held().where((F.col("type") == goal[0]) & (F.col("relation") == goal[1])), PAIR, "left_semi")
            return named.unionByName(wild)
        tuples = self._tuples(goal).select(F.col("resource_id").alias("id"), "subject_type", "subject_id", "subject_relation")
        named = subjects.join(tuples, ["id", "subject_type", "subject_id", "subject_relation"], "left_semi").select(*PAIR)
        itself = subjects.where((F.col("subject_type") == goal[0]) & (F.col("subject_relation") == goal[1]) & (F.col("subject_id") == F.col("id"))).select(*PAIR)
        return union_all([named, wild, itself])

    def _led(self, pairs: DataFrame, tuples: DataFrame, type_: str) -> DataFrame:
        """(k, id, to): where tuples of the pairs' objects lead to."""
        to = tuples.where((F.col("subject_type") == type_) & (F.col("subject_id") != "*")).select(F.col("resource_id").alias("id"), F.col("subject_id").alias("to")).distinct()
        return checkpointed(pairs.join(to, "id").select(*PAIR, "to"))

    def _through(self, pairs: DataFrame, tuples: DataFrame, goal: Goal) -> DataFrame:
        """The pairs whose tuples lead to an object on which the goal holds."""
        led = self._led(pairs, tuples, goal[0])
        held = self.holds(goal, led.select("k", F.col("to").alias("id"))).withColumnRenamed("id", "to")
        return led.join(held, ["k", "to"], "left_semi").select(*PAIR).distinct()

    def _any(self, pairs: DataFrame, ways: list) -> DataFrame:
        """The pairs for which one of `ways` holds, each asked about what the ones before it haven't found."""
        found = []
        for i, way in enumerate(ways):
            found.append(checkpointed(way(pairs).distinct()))
            if i + 1 < len(ways):
                pairs = checkpointed(pairs.join(found[-1], PAIR, "left_anti"))
                if pairs.isEmpty():
                    break
        return union_all(found) if found else pairs.where(F.lit(False))

    def _relation(self, goal: Goal, pairs: DataFrame) -> DataFrame:
        ways = [lambda left: self._said(goal, left)]
        for g in self._walked(goal):
            ways.append(lambda left, g=g: self._through(left, self._tuples(goal).where(F.col("subject_relation") == g[1]), g))
        return self._any(pairs, ways)

    def narrowed(self, type_: str, e: Expr, pairs: DataFrame) -> DataFrame:
        """The `pairs` on which an expression holds."""
        if isinstance(e, Ref):
            return self.holds((type_, e.name), pairs)
        if isinstance(e, Arrow):
            tuples = self._tuples((type_, e.relation))
            return self._any(pairs, [lambda left, t=t: self._through(left, tuples, (t, e.target)) for t in arrow_targets(self.schema, type_, e)])
        if isinstance(e, SetOp):
            if e.op == "union":
                return self._any(pairs, [lambda left, c=c: self.narrowed(type_, c, left) for c in e.children])
            if e.op == "exclusion":
                left = checkpointed(self.narrowed(type_, e.children[0], pairs))
                return left.join(self.narrowed(type_, e.children[1], left), PAIR, "left_anti")
            for c in e.children:
                pairs = checkpointed(self.narrowed(type_, c, pairs))
            return pairs
        return pairs.where(F.lit(False))

    # recursive strata

    def _base(self, goal: Goal) -> DataFrame:
        return self._said(goal, self.demand[goal])

    def _reflexive(self, goal: Goal) -> DataFrame:
        found = super()._reflexive(goal)
        return found.join(self.demand[goal], PAIR, "left_semi") if goal in self.demand else found

    def _asked(self, goal: Goal, found: DataFrame) -> DataFrame:
        return found.join(self.demand[goal], PAIR, "left_semi")

    def _leads(self, goal: Goal, pairs: DataFrame) -> list[tuple[Goal, DataFrame]]:
        """The goals that a goal on `pairs` asks next, and on which pairs."""
        if self.schema.relation(*goal) is not None:
            return [(g, self._to(pairs, self._tuples(goal).where(F.col("subject_relation") == g[1]), g[0])) for g in self._walked(goal)]
        out = []

        def walk(e: Expr) -> None:
            if isinstance(e, Ref):
                out.append(((goal[0], e.name), pairs))
            elif isinstance(e, Arrow):
                for t in arrow_targets(self.schema, goal[0], e):
                    out.append(((t, e.target), self._to(pairs, self._tuples((goal[0], e.relation)), t)))
            elif isinstance(e, SetOp):
                for c in e.children:
                    walk(c)

        walk(self.schema.permission(*goal).expr)
        return out

    def _to(self, pairs: DataFrame, tuples: DataFrame, type_: str) -> DataFrame:
        to = tuples.where((F.col("subject_type") == type_) & (F.col("subject_id") != "*")).select(F.col("resource_id").alias("id"), F.col("subject_id").alias("to"))
        return pairs.join(to, "id").select("k", F.col("to").alias("id"))

    def _fixpoint(self, s: Stratum, goal: Goal, pairs: DataFrame) -> DataFrame:
        leaves = Leaves(self.schema, s, self._tuples) if self.closure is None else None
        if leaves is None or not leaves.possible or pairs.limit(MANY_SUBJECTS).count() < MANY_SUBJECTS:
            return self._collected(s, goal, pairs)
        n, subjects = pairs.agg(F.count("*"), F.approx_count_distinct("k")).first()
        if subjects < MANY_SUBJECTS or (total := leaves.edges().count()) > n * TUPLES_A_PAIR:
            return self._collected(s, goal, pairs)
        return self._by_objects(s, goal, pairs, leaves, total)

    def _by_objects(self, s: Stratum, goal: Goal, pairs: DataFrame, leaves: Leaves, total: int) -> DataFrame:
        seeds = checkpointed(self.seeds)
        first = None
        sure, open_ = [], [pairs.join(seeds.where("subject_relation <> ''").select("k"), "k", "left_semi")]
        for (t,) in seeds.where("subject_relation = ''").select("subject_type").distinct().collect():
            granted = Granted(leaves, t, self.max_depth // len(s.goals), total)
            at = lambda df: df.where(F.col("goal") == leaves.number[goal])
            asked = pairs.join(seeds.where((F.col("subject_relation") == "") & (F.col("subject_type") == t)).select("k", "subject_id"), "k")
            named = reduce(Column.__and__, [F.col(m).bitwiseAND(b) != 0 for m, b in zip(MASK, bits("subject_id"), strict=True)])
            met = checkpointed(asked.join(at(granted.found).select("id", "holds", *MASK), "id").select(*PAIR, named.alias("named"), "holds").where("named or holds"))
            sure.append(met.where("not named").select(*PAIR))
            open_.append(met.where("named").select(*PAIR))
            first = (granted.first, granted.n_first) if granted.first is not None else first
            if granted.left is not None:
                open_.append(checkpointed(asked.join(at(granted.left), "id", "left_semi").select(*PAIR)))
            granted.forget()
        rest = checkpointed(union_all(open_))
        if rest.isEmpty():
            return union_all(sure)
        named = checkpointed(seeds.join(rest.select("k").distinct(), "k", "left_semi"))
        seeds_before, self.seeds = self.seeds, named
        try:
            return union_all([*sure, self._collected(s, goal, rest, plain=True, first=first)])
        finally:
            self.seeds = seeds_before

    def _tuples_of(self, ids: DataFrame, n: int) -> DataFrame:
        """The tuples of `n` objects' ids."""
        return self.rels.join(small(ids.withColumnRenamed("id", "resource_id"), n), "resource_id", "left_semi").select(*self.rels.columns)

    def _walks(self, s: Stratum) -> Column:
        """Tuples that lead from the objects of a stratum's goals."""
        named = {g for g in s.goals if self.schema.relation(*g) is not None}

        def arrows(type_: str, e: Expr) -> None:
            if isinstance(e, Arrow):
                named.add((type_, e.relation))
            for c in e.children if isinstance(e, SetOp) else ():
                arrows(type_, c)

        for g in s.goals:
            if g not in named:
                arrows(g[0], self.schema.permission(*g).expr)
        return reduce(Column.__or__, [(F.col("resource_type") == t) & (F.col("relation") == r) for t, r in sorted(named)])

    def _collected(self, s: Stratum, goal: Goal, pairs: DataFrame, plain: bool = False, first: tuple[DataFrame, int] | None = None) -> DataFrame:
        """By the pairs that can matter.

        plain: below the stratum are relations without usersets alone, so that only the tuples of these pairs' objects are read.
        first: (goal, id) of so many objects that lead only to each other; pairs on these alone go on over their tuples.
        """
        number = {g: i for i, g in enumerate(s.goals)}
        at = lambda df, g: df.where(F.col("goal") == number[g]).select(*PAIR)
        frontier = checkpointed(pairs.select(F.lit(number[goal]).alias("goal"), *PAIR))
        parts, rounds = [frontier], 0
        before = self.rels, self.demand, self.done
        try:
            while n := frontier.count():
                rounds += 1
                if rounds > len(s.goals) * self.max_depth:
                    raise MaxDepthExceeded(f"no end after {rounds} rounds")
                if first is not None and frontier.join(small(*first), NODE, "left_anti").isEmpty():
                    among = self._tuples_of(first[0].select("id").distinct(), first[1])
                    self.rels, first = checkpointed(among.where(self._walks(s))), None
                led = [(g, to) for own in s.goals for g, to in self._leads(own, small(at(frontier, own), n)) if g in number]
                if not led:
                    break
                new = union_all([to.select(F.lit(number[g]).alias("goal"), *PAIR) for g, to in led]).distinct()
                frontier = checkpointed(new.join(union_all(parts), ["goal", *PAIR], "left_anti"))
                parts.append(frontier)
                if len(parts) > MOST_PARTS:
                    parts = merged(parts[:-1]) + parts[-1:]
            self.rels = before[0]
            demand = checkpointed(union_all(parts).repartition("id")) if plain else union_all(parts)
            known = {g: at(demand, g) for g in s.goals}
            # what the stratum asks of goals below it, evaluated for the pairs that it asks about
            below: dict[Goal, list[DataFrame]] = {}
            for own in s.goals:
                for g, to in self._leads(own, known[own]):
                    if g not in number:
                        below.setdefault(g, []).append(to)
            if plain:
                ids = checkpointed(union_all([demand.select("id"), *[a.select("id") for asked in below.values() for a in asked]]).distinct())
                self.rels = checkpointed(self._tuples_of(ids, ids.count()))
            held = {g: self._held_among(g, union_all(asked)) for g, asked in below.items()}
            self.demand, self.done = known, held
            if s.negative:
                self._evaluate(s)
                found = self.done[goal]
            else:
                found = self._least(s, self.done)[goal]
            return checkpointed(found.join(pairs, PAIR, "left_semi").distinct())
        finally:
            self.rels, self.demand, self.done = before
