"""The revisioned store: a change log, bases in Parquet, and a head for each revision.

    FORMAT                 version of the layout
    heads/N                one file a revision: its commit, the base under it, and how many changes lie on the base
    rels/rev=N/            a base: all tuples of revision N, partitioned by resource type and sorted by relation and subject
    changes/revision=N/    the effective changes of revision N, in order

A revision is its base with the changes since folded in, so a write costs what it changes; a new base is written when
the changes on the last one have grown to a share of it, or come from too many revisions. A question reads the newest
head once and then files that never change. A write folds its updates, in order, against the tuples they name; what
has no effect leaves no revision. Writers hold a lock file, which lapses after LEASE seconds. Hooks run after the rows
are written and before the head is, so an error of theirs vetoes the write; heads appear by rename, whole or not at all.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import FormatVersion, PreconditionFailed, RelationshipExists, RelgraphError
from ..functions.tuples import matches
from ..model import CHANGE, COLUMNS, REL, Operation, Precondition, RelationshipFilter, Update
from ..plans.checkpoint import checkpointed, numbered

FORMAT_VERSION = 2
#: A base is written anew when the changes on it are more than this share of its tuples and this many, or of so many revisions.
COMPACT_SHARE, COMPACT_ROWS, COMPACT_REVISIONS = 0.2, 10_000, 64
#: Seconds after which a lock counts as left behind by a writer that has died.
LEASE = 3600
UPDATES = "seq int, operation int, " + ", ".join(f"{c} string" for c in COLUMNS)
Hook = Callable[["Transaction", DataFrame], None]


class _Files:
    """What the store needs of Hadoop's file systems, so that its folder can be on any of them."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark._jvm, root.rstrip("/")
        self.fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._path(name))

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str, overwrite: bool = False) -> None:
        stream = self.fs.create(self._path(name), overwrite)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> None:
        """The file appears whole or not at all; it is an error if it is there already."""
        draft = f"{name}.{uuid.uuid4().hex}.new"
        self.create(draft, text)
        if self.exists(name) or not self.fs.rename(self._path(draft), self._path(name)):
            self.delete(draft)
            raise RelgraphError(f"{name} is there already")

    def names(self, folder: str) -> list[str]:
        return sorted(x.getPath().getName() for x in self.fs.listStatus(self._path(folder))) if self.exists(folder) else []

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)


@dataclass
class Snapshot:
    """One revision; `rels` never changes."""

    revision: int
    rels: DataFrame


def fold(rels: DataFrame, updates: DataFrame) -> DataFrame:
    """updates (seq, operation, tuple) in order against `rels`: with `existed`, `before`, `conflict`, `effective` and `last`.

    A tuple is present before an update if the update before it left it present, or, for the first, if it is stored.
    """
    named = updates.join(rels.select(*COLUMNS).withColumn("stored", F.lit(True)), COLUMNS, "left").withColumn("existed", F.coalesce("stored", F.lit(False))).drop("stored")
    own = Window.partitionBy(*COLUMNS).orderBy("seq")
    left = F.lag(F.col("operation") != int(Operation.DELETE)).over(own)
    out = named.withColumn("before", F.coalesce(left, F.col("existed"))).withColumn("last", F.lead("seq").over(own).isNull())
    out = out.withColumn("conflict", (F.col("operation") == int(Operation.CREATE)) & F.col("before"))
    return out.withColumn("effective", F.when(F.col("operation") == int(Operation.DELETE), F.col("before")).otherwise(~F.col("before")))


class Transaction:
    """Staged changes on one snapshot; nothing is visible before `commit`."""

    def __init__(self, store: Store):
        self.store, self.base = store, store.snapshot()
        self.rels, self.logged, self.n, self.commit_id = self.base.rels, [], 0, ""

    def require(self, preconditions: list[Precondition]) -> None:
        for p in preconditions:
            if self.rels.where(matches(p.filter)).limit(1).isEmpty() == p.must_match:
                raise PreconditionFailed(f"{'no tuple matches' if p.must_match else 'a tuple matches'} {p.filter}")

    def write(self, updates: list[Update]) -> int:
        rows = [(i, int(u.operation), *u.relationship.row) for i, u in enumerate(updates)]
        return self.apply(self.store.spark.createDataFrame(rows, UPDATES))

    def apply(self, updates: DataFrame) -> int:
        """The number of effective changes."""
        folded = checkpointed(fold(self.rels, updates))
        clash = folded.where("conflict").orderBy("seq").first()
        if clash is not None:
            raise RelationshipExists(f"{clash['resource_type']}:{clash['resource_id']}#{clash['relation']} already has {clash['subject_type']}:{clash['subject_id']}")
        effective = folded.where("effective")
        n = effective.count()
        if n:
            self._log(effective.select("seq", F.when(F.col("operation") == int(Operation.DELETE), 3).otherwise(2).alias("operation"), *COLUMNS), n)
            kept = self.rels.join(folded.where("last").select(*COLUMNS), COLUMNS, "left_anti").select(*COLUMNS)
            added = folded.where(F.col("last") & (F.col("operation") != int(Operation.DELETE))).select(*COLUMNS)
            self.rels = kept.unionByName(added) if self.base.revision or self.logged[1:] else added
        return n

    def create_all(self, rels: DataFrame) -> int:
        """Bulk import: nothing lands if any tuple is there already or comes twice."""
        rels = checkpointed(rels.select(*COLUMNS))
        if not rels.join(self.rels, COLUMNS, "left_semi").isEmpty() or not rels.groupBy(*COLUMNS).count().where("count > 1").isEmpty():
            raise RelationshipExists("an imported relationship exists already")
        n = rels.count()
        if n:
            self._log(rels.select(F.lit(2).alias("operation"), F.lit(None).cast("int").alias("seq"), *COLUMNS), n)
            self.rels = self.rels.select(*COLUMNS).unionByName(rels) if self.base.revision or self.logged[1:] else rels
        return n

    def delete_matching(self, f: RelationshipFilter) -> int:
        gone = checkpointed(self.rels.where(matches(f)).select(*COLUMNS))
        n = gone.count()
        if n:
            self._log(gone.select(F.lit(3).alias("operation"), F.lit(None).cast("int").alias("seq"), *COLUMNS), n)
            self.rels = self.rels.join(gone, COLUMNS, "left_anti").select(*COLUMNS)
        return n

    def _log(self, rows: DataFrame, n: int) -> None:
        """Add effective changes in order of seq and columns, numbered on from those before them."""
        order = numbered(rows, ["seq", *COLUMNS], "place")
        self.logged.append(order.select((F.col("place") + self.n).cast("int").alias("seq"), F.col("operation").cast("short").alias("operation"), *COLUMNS))
        self.n += n

    def changes(self) -> DataFrame:
        out = self.logged[0]
        for x in self.logged[1:]:
            out = out.unionByName(x)
        return out.orderBy("seq")

    def commit(self) -> int:
        """The new revision, or the old one if nothing changed."""
        if not self.n:
            return self.base.revision
        return self.store._commit(self)


class Store:
    """A store in a folder of any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, root: str, hooks: list[Hook] | None = None):
        self.spark, self.root, self.hooks = spark, root.rstrip("/"), list(hooks or ())
        self.files = _Files(spark, self.root)
        if not self.files.exists("FORMAT"):
            self.files.create("FORMAT", str(FORMAT_VERSION), True)
        self.check()

    # format

    @staticmethod
    def version(spark: SparkSession, root: str) -> int:
        """The format of the store in a folder; 0: there is none."""
        files = _Files(spark, root)
        return int(files.read("FORMAT").strip()) if files.exists("FORMAT") else 0

    def check(self) -> None:
        found = self.version(self.spark, self.root)
        if found != FORMAT_VERSION:
            raise FormatVersion(f"the store has format {found}, this package reads {FORMAT_VERSION}" + (", see Store.migrate" if found < FORMAT_VERSION else ""))

    @staticmethod
    def migrate(spark: SparkSession, root: str) -> Store:
        """Bring a store to this package's format, one version after another; the steps can be run again."""
        files = _Files(spark, root)
        if Store.version(spark, root) == 1:  # one HEAD file, and all tuples of every revision
            n = int(json.loads(files.read("HEAD"))["revision"]) if files.exists("HEAD") else 0
            if n and not files.exists(f"heads/{n:012d}"):
                rows = spark.read.schema(REL).parquet(f"{root.rstrip('/')}/rels/rev={n}").count()
                files.publish(f"heads/{n:012d}", json.dumps({"revision": n, "commit": uuid.uuid4().hex, "base": n, "base_rows": rows, "delta_rows": 0}))
            files.create("FORMAT", "2", True)
        return Store(spark, root)

    # reads

    def head(self) -> int:
        return max((int(x) for x in self.files.names("heads") if x.isdigit()), default=0)

    def about(self, revision: int) -> dict:
        """What the head of a revision says: commit, base, base_rows, delta_rows."""
        if revision == 0:
            return {"revision": 0, "commit": "", "base": 0, "base_rows": 0, "delta_rows": 0}
        return json.loads(self.files.read(f"heads/{revision:012d}"))

    def snapshot(self, revision: int | None = None) -> Snapshot:
        n = self.head() if revision is None else revision
        if n == 0:
            return Snapshot(0, self.spark.createDataFrame([], REL))
        base = self.about(n)["base"]
        rels = self.spark.read.schema(REL).parquet(f"{self.root}/rels/rev={base}").select(*COLUMNS) if base else None
        if base < n:
            changed = self._log().where((F.col("revision") > base) & (F.col("revision") <= n))
            last = changed.groupBy(*COLUMNS).agg(F.max_by("operation", F.struct("revision", "seq")).alias("operation"))
            added = last.where("operation <> 3").select(*COLUMNS)
            rels = added if rels is None else rels.join(last, COLUMNS, "left_anti").unionByName(added)
        return Snapshot(n, rels)

    def transaction(self) -> Transaction:
        return Transaction(self)

    def _log(self) -> DataFrame:
        return self.spark.read.schema(CHANGE).parquet(f"{self.root}/changes")

    def changes(self, after: int = 0, limit: int = 0) -> DataFrame:
        """Changes of revisions after `after`; a limit counts revisions."""
        head = self.head()
        if head == 0:
            return self.spark.createDataFrame([], CHANGE)
        log = self._log().where((F.col("revision") > after) & (F.col("revision") <= head))
        if limit:
            log = log.join(log.select("revision").distinct().orderBy("revision").limit(limit), "revision", "left_semi")
        return log.select(*CHANGE.fieldNames()).orderBy("revision", "seq")

    def change_stream(self) -> DataFrame:
        """The change log as a Structured Streaming source."""
        return self.spark.readStream.schema(CHANGE).parquet(f"{self.root}/changes")

    # writes

    def _lock(self) -> str:
        """Take the lock; one that is older than LEASE is taken over."""
        owner = uuid.uuid4().hex
        for last in (False, True):
            try:
                self.files.create("LOCK", json.dumps({"owner": owner, "at": time.time()}))
                return owner
            except Exception as e:
                held = json.loads(self.files.read("LOCK") or "{}") if self.files.exists("LOCK") else {}
                if last or held.get("at", 0) + LEASE > time.time():
                    raise RelgraphError("another writer holds the store") from e
                self.files.delete("LOCK")
        raise AssertionError

    def _unlock(self, owner: str) -> None:
        if self.files.exists("LOCK") and json.loads(self.files.read("LOCK") or "{}").get("owner") == owner:
            self.files.delete("LOCK")

    def compact(self) -> None:
        """Write the head's base anew, whatever lies on it; the revision stays."""
        n = self.head()
        if n and self.about(n)["base"] != n:
            owner = self._lock()
            try:
                if self.head() != n:
                    raise RelgraphError("the store has moved on")
                self._write_base(n, self.snapshot(n).rels)
                self.files.create(f"heads/{n:012d}", json.dumps(self.about(n) | {"base": n, "base_rows": self.spark.read.parquet(f"{self.root}/rels/rev={n}").count(), "delta_rows": 0}), True)
            finally:
                self._unlock(owner)

    def _write_base(self, n: int, rels: DataFrame) -> None:
        order = rels.repartitionByRange("resource_type", "relation", "subject_type", "subject_id", "resource_id").sortWithinPartitions("resource_type", "relation", "subject_type", "subject_id")
        order.write.mode("overwrite").partitionBy("resource_type").parquet(f"{self.root}/rels/rev={n}")

    def _commit(self, t: Transaction) -> int:
        owner = self._lock()
        try:
            before = self.about(t.base.revision)
            if self.head() != t.base.revision:
                raise RelgraphError("the store has moved on since this transaction began")
            n, t.commit_id = t.base.revision + 1, uuid.uuid4().hex
            head = before | {"revision": n, "commit": t.commit_id, "delta_rows": before["delta_rows"] + t.n}
            t.changes().write.mode("overwrite").parquet(f"{self.root}/changes/revision={n}")
            if head["delta_rows"] > max(COMPACT_ROWS, COMPACT_SHARE * head["base_rows"]) or n - head["base"] > COMPACT_REVISIONS:
                self._write_base(n, t.rels.select(*COLUMNS))
                head |= {"base": n, "base_rows": self.spark.read.parquet(f"{self.root}/rels/rev={n}").count(), "delta_rows": 0}
            try:
                for hook in self.hooks:
                    hook(t, self.spark.read.parquet(f"{self.root}/changes/revision={n}").orderBy("seq"))
            except Exception:
                self.files.delete(f"rels/rev={n}")
                self.files.delete(f"changes/revision={n}")
                raise
            self.files.publish(f"heads/{n:012d}", json.dumps(head))
            return n
        finally:
            self._unlock(owner)
