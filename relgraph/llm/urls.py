"""URL filters (operator 2): a path-template tree per host, judged by smoothed labelled purity.

Urls that a rule decides are the labels. Segments are first generalised by their form (numbers, hexadecimal
strings, long mixtures). The tree then grows from the host down, a level a round, for as long as a template still
holds two different leaves: literals that are rare under their parent and hardly ever come twice become a
wildcard, and branches of one parent whose smoothed shares of blocked urls are alike (within one step of a scale
on which the error of a share is the same everywhere) are merged into one branch. A node's share is smoothed
towards its parent's, the host's towards that of all urls; a template whose share is over REJECT is rejected.

All statistics are shares of different urls, so that repeated rows change nothing, and all of it is counting by
(host, template): partial sums move, never the pages of a host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, table

#: (host suffix, path prefix, verdict).
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
#: A literal is rare if it has less than this share of its parent's urls; rare literals are variable if there are so many different ones for each of their urls.
RARE, VARIABLE = 0.05, 0.5
#: Labelled urls that a smoothing prior counts as, and the share of blocked ones over which a template is rejected.
PRIOR, REJECT = 8.0, 0.5
#: Steps of the scale, the arcsine of the root of a share, within which branches are alike.
STEPS = 8


def host_path(url: Column) -> tuple[Column, Column]:
    rest = F.regexp_extract(url, r"^(?s)(.*?)://(.*)$", 2)
    host = F.translate(F.regexp_extract(rest, r"^(?s)([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^(?s)[^/?#]*(/[^?#]*)?", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (host and path of the rule, as one string), and its verdict."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for suffix, prefix, what in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):
        fits = ((host == suffix) | host.endswith("." + suffix)) & path.startswith(prefix)
        name, verdict = F.when(fits, suffix + prefix).otherwise(name), F.when(fits, what).otherwise(verdict)
    return name, verdict


def _form(segment: Column) -> Column:
    """A segment with what varies generalised: numbers, hexadecimal strings and long mixtures; endings stay."""
    s = F.regexp_replace(segment, r"^[0-9]+(\.[A-Za-z]+)?$", r"{n}$1")
    s = F.regexp_replace(s, r"^(?=[0-9a-fA-F-]*[0-9])[0-9a-fA-F-]{8,}$", "{hex}")
    return F.when(F.length(s) > 40, F.lit("{long}")).otherwise(s)


def forms(pages: DataFrame) -> DataFrame:
    """page_id, host, path, rule, by_rule (the rule's verdict) and form, the generalised segments."""
    host, path = host_path(F.col("url"))
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"))
    return rows.withColumns({"rule": rule, "by_rule": verdict, "form": F.transform(F.split(F.regexp_replace("path", "^/", ""), "/"), _form)})


def _smoothed(blocked: str, labelled: str, towards: str) -> Column:
    return (F.col(blocked) + PRIOR * F.col(towards)) / (F.col(labelled) + PRIOR)


def tree(rows: DataFrame) -> DataFrame:
    """host, form, template and share for every leaf, a different form of a host."""
    urls = rows.groupBy("host", "path", "form").agg(F.first("by_rule").alias("by_rule"))
    sums = lambda *names: [F.sum(x).alias(y) for x, y in zip(("n", "labelled", "blocked"), names, strict=False)]
    leaves = urls.groupBy("host", "form").agg(F.count("*").alias("n"), F.count("by_rule").alias("labelled"), F.count_if(F.col("by_rule") == "block").alias("blocked"))
    leaves = checkpointed(leaves)
    total = leaves.agg(F.sum("blocked").alias("b"), F.sum("labelled").alias("l")).first()
    prior = ((total["b"] or 0) + 0.5) / ((total["l"] or 0) + 1.0)
    node = ["host", "template"]
    hosts = leaves.groupBy("host").agg(F.count("*").alias("leaves"), *sums("all", "all_labelled", "all_blocked")).withColumn("all_share", F.lit(prior))
    here = leaves.join(hosts.select("host", "leaves", _smoothed("all_blocked", "all_labelled", "all_share").alias("share")), "host").withColumn("template", F.lit(""))
    done, level = [], 0
    while True:
        here = checkpointed(here)
        ends = (F.col("leaves") == 1) | (F.size("form") <= level)
        rest = F.array_join(F.slice("form", level + 1, F.greatest(F.size("form") - level, F.lit(0))), "/")
        done.append(here.where(ends).select("host", "form", F.when(F.size("form") > level, F.concat("template", F.lit("/"), rest)).otherwise(F.col("template")).alias("template"), "share"))
        here = here.where(~ends).withColumn("own", F.get("form", F.lit(level))).drop("leaves")
        if here.isEmpty():
            break
        branches = here.groupBy(*node, "own").agg(F.first("share").alias("share"), *sums("n", "labelled", "blocked"))
        parents = branches.groupBy(*node).agg(F.sum("n").alias("all"))
        literal = ~F.col("own").startswith("{") & (F.col("own") != "")
        branches = branches.join(parents, node).withColumn("rare", literal & (F.col("n") < RARE * F.col("all")))
        variety = branches.where("rare").groupBy(*node).agg((F.count("*") / F.sum("n")).alias("variety"))
        scale = F.floor(F.asin(F.sqrt(_smoothed("blocked", "labelled", "share"))) / (F.asin(F.lit(1.0)) / STEPS))
        wild = F.col("rare") & (F.coalesce("variety", F.lit(0.0)) >= VARIABLE)
        named = branches.join(variety, node, "left").withColumn("kind", F.when(wild, "*").when(literal, F.concat(F.lit("="), scale)).otherwise(F.concat(F.lit("{"), "own")))
        merged = named.groupBy(*node, "kind").agg(F.count("*").alias("fan"), F.min("own").alias("least"), F.first("share").alias("above"), *sums("n", "labelled", "blocked"))
        called = F.when(F.col("kind") == "*", "*").when(F.col("fan") > 1, F.concat(F.lit("{"), "least", F.lit(" and like it}"))).otherwise(F.col("least"))
        merged = merged.select(*node, "kind", F.concat("template", F.lit("/"), called).alias("next"), _smoothed("blocked", "labelled", "above").alias("next_share"))
        step = named.select(*node, "own", "kind").join(merged, [*node, "kind"]).drop("kind")
        here = here.join(step, [*node, "own"]).select("host", "form", "n", "labelled", "blocked", F.col("next").alias("template"), F.col("next_share").alias("share"))
        here = checkpointed(here)
        here = here.join(here.groupBy(*node).agg(F.count("*").alias("leaves")), node)
        level += 1
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


def judge(pages: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict, template and share for every row of `pages`.

    A null url, or one without `://`, has empty host and path; repeated rows are judged alike and count once;
    other columns are ignored; an empty table gives an empty result. Rounds go on to the deepest level at which
    two different leaves still share their template.
    """
    rows = forms(pages)
    judged = checkpointed(tree(rows))
    verdict = F.coalesce("by_rule", F.when(F.col("share") > REJECT, "block").otherwise("allow"))
    return rows.join(judged, ["host", "form"]).select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "share")


def op2_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")
