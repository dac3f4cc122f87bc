"""Mixing sources to target weights by weighted fair queueing (operator 7); DataFrame functions only.

Every document of a source gets a virtual finish time: the source's tokens up to its end, in shuffled order
and over up to three passes, divided by the source's target. In order of these times, over all sources,
documents are taken until the total budget is used up.

No running sum is over a whole source or the whole corpus: documents are dealt into hash ranges of their
source, sums run within a range and start from the totals of the ranges before it. The place of truncation
is found from totals by range of virtual time, and only the range in which it lies is sorted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, table

WEIGHTS = (5, 2, 1)
MOST_PASSES = 3
#: Shuffled ranges of a source: 2 ** (60 - RANGE_SHIFT).
RANGE_SHIFT = 48
#: Ranges of virtual time up to 1, and the last one, which holds the rest.
TIMES, LAST_TIME = 4096, 4 * 4096
WORD = r"[^\x20\x09-\x0D]+"


def _base(docs: DataFrame, carry: bool) -> DataFrame:
    """The rows with their size, source key and place in the shuffled order."""
    extra = {
        "_size": F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("bigint"),
        "_source": F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("~null")),
        "_place": F.conv(F.substring(F.md5(F.concat(F.lit("mix"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.coalesce(F.md5("text"), F.lit("")))), 1, 15), 16, 10).cast("bigint"),
        "_id": F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63))),
        "_tie": F.xxhash64(F.col("text")),
    }
    own = F.struct(*[docs[c] for c in docs.columns]).alias("_row") if carry else F.col("doc_id").cast("bigint").alias("doc_id")
    rows = docs.select(own, *[c.alias(k) for k, c in extra.items()])
    return rows.withColumn("_range", F.shiftright("_place", RANGE_SHIFT))


def _targets(totals: DataFrame) -> DataFrame:
    """_source, source_size, target: weights fill up to a level at which the capped sources leave the rest to the others."""
    ranked = Window.orderBy("_source")
    everything = Window.partitionBy()
    s = totals.groupBy("_source").agg(F.sum("_range_size").alias("source_size"))
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(F.row_number().over(ranked) - 1, F.lit(len(WEIGHTS))) + 1).cast("int")))
    s = s.withColumn("cap", F.col("source_size") * MOST_PASSES)
    before = Window.orderBy(F.col("cap") / F.col("weight"), "_source").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("rest", F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
    s = s.withColumn("rest_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    s = s.withColumn("capped", F.col("cap").cast("double") * F.col("rest_weight") <= F.col("rest").cast("double") * F.col("weight"))
    level = F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("weight"), "_source", "rest", "rest_weight"))).over(everything)
    s = s.withColumn("level", level)
    open_target = F.col("weight").cast("double") * F.col("level.rest") / F.col("level.rest_weight")
    return s.select("_source", "source_size", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(open_target).alias("target"))


def _finish(k: int):
    """Virtual finish time of the document in pass k."""
    return (F.col("source_size") * k + F.col("_before") + F.col("_sum")) / F.col("target")


def _time(finish):
    return F.least(F.floor(finish * TIMES), F.lit(LAST_TIME))


def mix(docs: DataFrame, carry: bool = False) -> DataFrame:
    """doc_id, size, source_size, target, passes (how often it is taken), taken; with `carry`,
    `_row` with all columns of `docs` instead of doc_id.

    Sources go by code point, null last; a null text has size 0; repeated rows are documents of their own; a
    source without words has target 0 and nothing of it is taken; an empty table gives an empty result.
    """
    base = _base(docs, False)
    narrow = checkpointed(base.select("_size", "_source", "_place", "_id", "_tie", "_range", "doc_id"))
    totals = narrow.groupBy("_source", "_range").agg(F.sum("_size").alias("_range_size"))
    targets = _targets(totals)
    before = Window.partitionBy("_source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = totals.withColumn("_before", F.coalesce(F.sum("_range_size").over(before), F.lit(0))).join(targets, "_source")
    ranges = checkpointed(ranges.select("_source", "_range", "_before", "source_size", "target"))
    own = Window.partitionBy("_source", "_range").orderBy("_place", "_id", "_size", "_tie").rowsBetween(Window.unboundedPreceding, 0)

    def timed(rows: DataFrame) -> DataFrame:
        return rows.withColumn("_sum", F.sum("_size").over(own)).join(ranges, ["_source", "_range"])

    order = ["_source", "_place", "_id", "_size", "_tie"]
    entries = checkpointed(timed(narrow).where("target > 0").select(*order, F.posexplode(F.array(*[_finish(k) for k in range(MOST_PASSES)])).alias("_pass", "_finish")).withColumn("_time", _time(F.col("_finish"))))
    budget = ranges.select("_source", "source_size").distinct().agg(F.sum("source_size")).first()[0] or 0
    upto = F.sum("n").over(Window.orderBy("_time"))
    times = entries.groupBy("_time").agg(F.sum("_size").alias("n")).select("_time", "n", upto.alias("upto"))
    crossing = times.where(F.col("upto") > budget).orderBy("_time").first()
    if crossing is None:
        cut = None
    else:
        left = budget - (crossing["upto"] - crossing["n"])
        inside = entries.where(F.col("_time") == crossing["_time"])
        place = F.struct("_finish", *order, "_pass")
        taken = inside.withColumn("upto", F.sum("_size").over(Window.orderBy("_finish", *order, "_pass"))).where(F.col("upto") <= left)
        cut = (crossing["_time"], taken.agg(F.max(place)).first()[0])

    def within(k: int):
        if cut is None:
            return F.lit(1)
        time, last = cut
        finish = _finish(k)
        inside = F.lit(False)
        if last is not None:
            end = F.struct(*[F.lit(last[c]).cast({"_finish": "double", "_source": "string"}.get(c, "bigint")).alias(c) for c in ("_finish", *order)], F.lit(last["_pass"]).alias("_pass"))
            inside = F.struct(finish.alias("_finish"), *[F.col(c) for c in order], F.lit(k).alias("_pass")) <= end
        return F.when((_time(finish) < time) | ((_time(finish) == time) & inside), 1).otherwise(0)

    passes = F.when(F.col("target") > 0, sum((within(k) for k in range(1, MOST_PASSES)), within(0))).otherwise(0)
    out = timed(_base(docs, True) if carry else narrow).withColumn("passes", passes)
    return out.select("_row" if carry else "doc_id", F.col("_size").alias("size"), "source_size", "target", "passes", (F.col("passes") * F.col("_size")).alias("taken"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP7_SQL = r"""
with d as (
  select row_number() over () as row, doc_id, cast(case when text is null then 0 else len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) end as bigint) as size,
         coalesce('=' || source, '~null') as src,
         cast('0x' || substr(md5('mix' || coalesce(cast(doc_id as varchar), 'null') || coalesce(md5(text), '')), 1, 15) as bigint) as place
  from documents),
s as (
  select src, cast(sum(size) as bigint) as source_size, [5, 2, 1][cast((row_number() over (order by src) - 1) % 3 + 1 as int)] as weight
  from d group by src),
r as (
  select *, 3 * source_size as cap,
         sum(source_size) over () - coalesce(sum(3 * source_size) over b, 0) as rest,
         sum(weight) over () - coalesce(sum(weight) over b, 0) as rest_weight,
         row_number() over (order by 3 * source_size / weight, src) as k
  from s window b as (order by 3 * source_size / weight, src rows between unbounded preceding and 1 preceding)),
c as (select *, cast(cap as double) * cast(rest_weight as double) <= cast(rest as double) * cast(weight as double) as capped from r),
l as (select rest, rest_weight from c where not capped order by k limit 1),
t as (
  select src, source_size,
         case when capped then cast(cap as double)
              else cast(weight as double) * cast((select rest from l) as double) / cast((select rest_weight from l) as double) end as target
  from c),
e as (
  select d.row, d.doc_id, d.size, t.source_size, t.target, d.src, d.place, p.pass,
         case when t.target > 0 then cast(t.source_size * p.pass + sum(d.size) over (
           partition by d.src, p.pass order by d.place, coalesce(d.doc_id, -9223372036854775808), d.size, d.row
           rows between unbounded preceding and current row) as double) / t.target end as finish
  from d join t on d.src = t.src cross join (select unnest([0, 1, 2]) as pass) p),
g as (
  select *, sum(size) over (order by finish nulls last, src, place, coalesce(doc_id, -9223372036854775808), size, pass, row
                            rows between unbounded preceding and current row) as upto
  from e)
select doc_id, size, source_size, target,
       cast(sum(case when finish is not null and upto <= (select sum(source_size) from s) then size else 0 end) as bigint) as taken
from g group by row, doc_id, size, source_size, target, src, place
"""
