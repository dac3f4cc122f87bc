"""What the objects of a recursive stratum grant to every subject that no tuple on their ways names.

Few subjects are named on the ways of an object; to all others of their type it grants the same, by wildcards. That is
found once an object instead of once a pair, in an order in which each object comes after those that it leads to. With
it goes a mask of bits of the names met on the ways: a subject with a bit that isn't in the mask isn't named there. A
subject with all bits in it may be, and is left to be asked about pair by pair.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.checkpoint import checkpointed, forget
from ..plans.compile import Goal, Stratum, arrow_targets
from ..schema.build import Arrow, Expr, Ref, Schema, SetOp

#: Words of 64 bits in a mask; a name sets one bit of each.
WORDS = 8
MASK = [f"m{i}" for i in range(WORDS)]
NODE = ["goal", "id"]
#: Rows that are sent to all tasks rather than shuffled with what they are joined with.
SMALL = 200_000
#: A leaf of a goal's expression is a bit of a number of 64.
MOST_LEAVES = 60


def small(df: DataFrame, rows: int) -> DataFrame:
    """`df`, which has so many rows, as a side of a join."""
    return F.broadcast(df) if rows <= SMALL else df


def bits(name: str) -> list[Column]:
    """The bits of a name in each word."""
    return [F.expr(f"shiftleft(1L, cast(shiftright(xxhash64({name}), {6 * i}) & 63 as int))") for i in range(WORDS)]


class Leaves:
    """The goals of a stratum as expressions over leaves: plain relations, and tuples that lead to goals of the stratum.

    `possible` is False where they aren't of that form: a goal below the stratum isn't a relation without usersets,
    an exclusion leads back, or goals of one object refer to each other in a circle.
    """

    def __init__(self, schema: Schema, s: Stratum, tuples: Callable[[Goal], DataFrame]):
        self.schema, self.number, self.tuples = schema, {g: i for i, g in enumerate(s.goals)}, tuples
        self.says: list[tuple[Goal, int, DataFrame]] = []  # tuples (id, subject_type, subject_id) that speak of subjects
        self.leads: list[tuple[Goal, int, Goal, DataFrame]] = []  # tuples to goals of the stratum
        self.formula: dict[Goal, Column] = {}
        self.leaves, self.possible = 0, not s.negative
        for g in s.goals:
            self.leaves = 0
            self.formula[g] = self._of(g, g, ())
            self.possible &= self.leaves <= MOST_LEAVES
        self.possible &= bool(self.says and self.leads)

    def _plain(self, g: Goal) -> bool:
        r = self.schema.relation(*g)
        return r is not None and not any(s.relation for s in r.subjects)

    def _spoken(self, g: Goal) -> DataFrame:
        return self.tuples(g).where("subject_relation = '' or subject_id = '*'").select("resource_id", "subject_type", "subject_id")

    def _leaf(self) -> tuple[int, Column]:
        self.leaves += 1
        n = 1 << min(self.leaves - 1, MOST_LEAVES)
        return n, F.col("bits").bitwiseAND(F.lit(n).cast("long")) != 0

    def _of(self, own: Goal, g: Goal, within: tuple[Goal, ...]) -> Column:
        """A goal of the object that `own` is evaluated for."""
        if g not in self.number or g in within:
            self.possible &= g not in within and self._plain(g)
        r = self.schema.relation(*g)
        if not self.possible:
            return F.lit(False)
        if r is None:
            return self._expr(own, self.schema.permission(*g).expr, (*within, g))
        bit, holds = self._leaf()
        self.says.append((own, bit, self._spoken(g).withColumnRenamed("resource_id", "id")))
        for to in dict.fromkeys((s.type, s.relation) for s in r.subjects if s.relation):
            self._over(own, bit, to, self.tuples(g).where(F.col("subject_relation") == to[1]))
        return holds

    def _over(self, own: Goal, bit: int, to: Goal, tuples: DataFrame) -> None:
        led = tuples.where((F.col("subject_type") == to[0]) & (F.col("subject_id") != "*")).select(F.col("resource_id").alias("id"), F.col("subject_id").alias("to"))
        if to in self.number:
            self.leads.append((own, bit, to, led))
        elif self._plain(to):
            self.says.append((own, bit, led.join(self._spoken(to).withColumnRenamed("resource_id", "to"), "to").select("id", "subject_type", "subject_id")))
        else:
            self.possible = False

    def _expr(self, own: Goal, e: Expr, within: tuple[Goal, ...]) -> Column:
        if isinstance(e, Ref):
            return self._of(own, (own[0], e.name), within)
        if isinstance(e, Arrow):
            bit, holds = self._leaf()
            for t in arrow_targets(self.schema, own[0], e):
                self._over(own, bit, (t, e.target), self.tuples((own[0], e.relation)))
            return holds
        if isinstance(e, SetOp):
            parts = [self._expr(own, c, within) for c in e.children]
            if e.op == "exclusion":
                return parts[0] & ~parts[1]
            return reduce(lambda a, b: a | b if e.op == "union" else a & b, parts)
        return F.lit(False)

    def edges(self) -> DataFrame:
        """(goal, id, bit, to_goal, to)"""
        of = lambda own, bit, to, led: led.select(F.lit(self.number[own]).alias("goal"), "id", F.lit(bit).cast("long").alias("bit"), F.lit(self.number[to]).alias("to_goal"), "to")
        return reduce(DataFrame.unionByName, [of(*x) for x in self.leads])

    def said(self, subject_type: str) -> DataFrame:
        """(goal, id, bits, name): leaves that hold by a wildcard, and names."""
        wild = F.col("subject_id") == "*"
        of = lambda own, bit, t: t.where(F.col("subject_type") == subject_type).select(F.lit(self.number[own]).alias("goal"), "id", F.when(wild, F.lit(bit)).otherwise(F.lit(0)).cast("long").alias("bits"), F.when(~wild, F.col("subject_id")).alias("name"))
        return reduce(DataFrame.unionByName, [of(*x) for x in self.says])

    def holds(self) -> Column:
        return reduce(lambda c, g: c.when(F.col("goal") == self.number[g], self.formula[g]), self.number, F.when(F.lit(False), F.lit(False)))


class Granted:
    """found: (goal, id, holds, mask words) of objects with tuples; left: (goal, id) of those on cycles, behind them, or deeper than `most_rounds`, or None.

    first: (goal, id) of `n_first` objects, the first ones in the order, that lead only to each other; or None. Where
    each object leads to one other, they are found before anything else is read, as long as a round's are few.
    """

    def __init__(self, leaves: Leaves, subject_type: str, most_rounds: int, total: int):
        edges, said = leaves.edges(), leaves.said(subject_type)
        zero = F.lit(0).cast("long")
        own = said.select(*NODE, "bits", *[F.when(F.col("name").isNull(), zero).otherwise(b).alias(m) for m, b in zip(MASK, bits("name"), strict=True)])
        united = [F.bit_or(c).alias(c) for c in ("bits", *MASK)]
        to = edges.select(F.col("to_goal").alias("goal"), F.col("to").alias("id"))
        out = edges.select(*NODE, F.lit(1).alias("n")).unionByName(union_of([to, own.select(*NODE)]).select(*NODE, F.lit(0).alias("n")))
        odd = checkpointed(out.groupBy(*NODE).agg(F.sum("n").alias("n")).where("n <> 1"))
        several = odd.where("n > 1")
        single = several.isEmpty()
        ends = odd.where("n = 0").select(*NODE)
        self.first, self.n_first = None, 0
        steps, names = self._first(edges, own, ends, most_rounds) if single else ([], None)
        ready = checkpointed(ends.select(*NODE, zero.alias("n"), zero.alias("bits"), *[zero.alias(m) for m in MASK]))
        parts, waiting, over, rounds = [], None, 0, 0
        while True:
            n, met = ready.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
            over += met
            if not n:
                break
            own_now = own if names is None or rounds > len(steps) else names
            full = own_now.join(small(ready.select(*NODE), n), NODE, "left_semi").unionByName(ready.drop("n")).groupBy(*NODE).agg(*united)
            final = checkpointed(full.select(*NODE, leaves.holds().alias("holds"), *MASK))
            parts.append(final)
            forget(ready)
            rounds += 1
            if over == total or rounds >= most_rounds:
                break
            below = small(final.select(F.col("goal").alias("to_goal"), F.col("id").alias("to"), "holds", *MASK), n)
            edges_now = steps[rounds - 1] if rounds <= len(steps) else edges
            came = edges_now.join(below, ["to_goal", "to"]).select(*NODE, F.lit(1).cast("long").alias("n"), F.when(F.col("holds"), F.col("bit")).otherwise(zero).alias("bits"), *MASK)
            if single:
                ready = checkpointed(came)
                continue
            came = came if waiting is None else came.unionByName(waiting)
            came = checkpointed(came.groupBy(*NODE).agg(F.sum("n").alias("n"), *united).join(several.withColumnRenamed("n", "due"), NODE, "left"))
            ready = came.where("n = coalesce(due, 1)").drop("due")
            waiting = came.where("n < coalesce(due, 1)").drop("due")
        self.found = union_of(parts) if parts else edges.where(F.lit(False)).select(*NODE, F.lit(False).alias("holds"), *[zero.alias(m) for m in MASK])
        self.parts = parts
        self.left = None if over == total else edges.select(*NODE).distinct().join(self.found.select(*NODE), NODE, "left_anti")

    def _first(self, edges: DataFrame, own: DataFrame, ends: DataFrame, most_rounds: int) -> tuple[list[DataFrame], DataFrame | None]:
        """The edges by which the first rounds come, and what is said of their objects; nothing, if the ends are many."""
        steps, n = [], ends.count()
        self.first, self.n_first = (ends, n) if 0 < n <= SMALL else (None, 0)
        while 0 < n <= SMALL and self.n_first <= SMALL and len(steps) + 1 < most_rounds:
            last = (steps[-1] if steps else ends).select(F.col("goal").alias("to_goal"), F.col("id").alias("to"))
            step = checkpointed(edges.join(F.broadcast(last), ["to_goal", "to"]).select(*NODE, "bit", "to_goal", "to"))
            n = step.count()
            if not 0 < n <= SMALL:
                forget(step)
                break
            steps.append(step)
            self.n_first += n
        if self.first is None:
            return [], None
        self.first = checkpointed(union_of([ends, *[s.select(*NODE) for s in steps]]))
        return steps, checkpointed(own.join(F.broadcast(self.first), NODE, "left_semi"))

    def forget(self) -> None:
        for p in self.parts:
            forget(p)


def union_of(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
