"""Reliable checkpoints in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
from itertools import accumulate

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of `df`; the folder is the session's spark.checkpoint.dir; where that is unset, one of our own, in local mode alone."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = sc.getConf().get("spark.checkpoint.dir", None)
        if named is None and not sc._jsc.sc().isLocal():
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="relgraph-checkpoint-"))
    try:
        return df.checkpoint(eager=True)
    except Py4JJavaError as e:  # Spark 4.1 loses track of columns in what it infers from some unions of checkpoints
        if "key not found" not in str(e.java_exception):
            raise
    conf, name = df.sparkSession.conf, "spark.sql.constraintPropagation.enabled"
    before = conf.get(name)
    conf.set(name, "false")
    try:
        return df.select("*").checkpoint(eager=True)
    finally:
        conf.set(name, before)


def forget(df: DataFrame) -> None:
    """Delete the files of a checkpoint that nothing reads any more; another table is left alone."""
    plan = df._jdf.queryExecution().analyzed()
    if plan.getClass().getSimpleName() != "LogicalRDD" or not plan.rdd().getCheckpointFile().isDefined():
        return
    sc = df.sparkSession.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(plan.rdd().getCheckpointFile().get())
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def numbered(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """`df` with its rows' places in order of `keys`, from 0, as column `name`; no task sees more than its range of them."""
    rows = checkpointed(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(name, F.monotonically_increasing_id()))
    part = F.shiftright(name, 33)
    counts = {r["part"]: r["count"] for r in rows.groupBy(part.alias("part")).count().collect()}
    before = list(accumulate((counts.get(i, 0) for i in range(max(counts, default=0) + 1)), initial=0))
    return rows.withColumn(name, F.get(F.lit(before), part) + F.col(name).bitwiseAND(F.lit((1 << 33) - 1)))
