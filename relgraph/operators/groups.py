"""Pairs of resources and subjects that meet in usersets, kept by classes of resources that lead to the same ones.

Many resources share what grants them (suppliers that serve one nation), so that who is found is found once for such a
class. The classes' resources and subjects are distinct pairs as they stand: expanded, they need no shuffle, and counts
need no expansion.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Resources of a class that stand in one row, and parts that a class's subjects are dealt to, when pairs are expanded.
CHUNK, PARTS = 1024, 64


class Groups:
    """`links` (r, u), `members` (u, s) and further pairs `more` (r, s): the distinct pairs (r, s) that meet in some u, or stand in `more`."""

    def __init__(self, links: DataFrame, members: DataFrame, more: DataFrame | None = None):
        links = links.distinct().join(members.select("u").distinct(), "u", "left_semi")
        uses = links.groupBy("u").agg(F.count("*").alias("n"))
        # what one resource alone leads to would make a class of it
        tagged = links.join(uses, "u")
        shared = tagged.where("n > 1").groupBy("r").agg(F.sort_array(F.collect_list("u")).alias("key"))
        own = tagged.where("n = 1").select("r", "u").join(members, "u").select("r", "s")
        kinds = shared.groupBy("key").agg(F.min("r").alias("c"))
        #: (r, c): the class of a resource, named by its least one
        self.classes = shared.join(kinds, "key").select("r", "c")
        #: (c, s), distinct
        self.subjects = kinds.select("c", F.explode("key").alias("u")).join(members, "u").select("c", "s").distinct()
        own = own if more is None else own.unionByName(more.select("r", "s"))
        #: (r, s), distinct: what the resource's class doesn't have
        self.own = own.distinct().join(self.classes, "r", "left").join(self.subjects, ["c", "s"], "left_anti").select("r", "s")

    def pairs(self) -> DataFrame:
        """(r, s)"""
        counted = self.classes.groupBy("c").agg(F.count("*").alias("n"))
        rows = self.classes.join(counted, "c").withColumn("chunk", F.pmod(F.xxhash64("r"), F.ceil(F.col("n") / CHUNK)))
        chunks = rows.groupBy("c", "chunk").agg(F.collect_list("r").alias("rs")).select("c", "rs", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"))
        dealt = self.subjects.withColumn("part", F.pmod(F.xxhash64("s"), F.lit(PARTS)).cast("int"))
        return dealt.join(chunks, ["c", "part"]).select(F.explode("rs").alias("r"), "s").unionByName(self.own)

    def counts(self) -> DataFrame:
        """(r, n): the number of a resource's subjects, where there are any."""
        common = self.classes.join(self.subjects.groupBy("c").agg(F.count("*").alias("n")), "c").select("r", "n")
        return common.unionByName(self.own.groupBy("r").agg(F.count("*").alias("n"))).groupBy("r").agg(F.sum("n").alias("n"))
