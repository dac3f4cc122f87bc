"""The optional index of a store: the userset closure and permission sets, with the revision that they describe."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .errors import ForeignSnapshot
from .model import CLOSURE, COLUMNS, SETS
from .operators import closure as C
from .operators import sets as S
from .plans.checkpoint import checkpointed
from .plans.compile import materialized
from .schema.build import Schema
from .sources.store import Snapshot, Store


class Index:
    """mode "closure": nesting only; "sets": permission sets too, of `permissions` or all that can be materialised.

    A revision's rows are in index/N-commit, with a file DONE that names the folders which hold them: a write that
    changes no nesting, or no tuple that an arrow walks, refers to the rows of an earlier revision. Rows count only
    if the store has a head of that commit, so a write that is vetoed or never ends leaves nothing behind. With
    `rebuild`, every write derives the index anew. The nesting budget refuses writes; what the log holds has been
    written, so a follower applies all of it.
    """

    def __init__(self, store: Store, schema: Schema | None = None, mode: str = "sets", permissions: list[str] | None = None, nesting_budget: int = C.DEFAULT_BUDGET, rebuild: bool = False):
        self.store, self.schema, self.mode, self.rebuild = store, schema, mode, rebuild
        self.budget = nesting_budget if nesting_budget > 0 else C.DEFAULT_BUDGET
        self.goals = materialized(schema, permissions) if mode == "sets" else []

    def _folder(self, revision: int, commit: str | None = None) -> str:
        return f"index/{revision:012d}-{self.store.about(revision)['commit'] if commit is None else commit}"

    def cursor(self) -> int:
        """The newest revision that the index describes."""
        head = self.store.head()
        for name in reversed(self.store.files.names("index")):
            n = int(name[:12])
            if n <= head and f"index/{name}" == self._folder(n) and self.store.files.exists(f"index/{name}/DONE"):
                return n
        return 0

    def _where(self, revision: int) -> dict[str, str]:
        return json.loads(self.store.files.read(f"{self._folder(revision)}/DONE"))

    def rows(self, revision: int | None = None) -> tuple[DataFrame, DataFrame]:
        """(closure, sets) of a revision; another than the index describes is refused."""
        spark, at = self.store.spark, self.cursor()
        if revision is not None and revision != at:
            raise ForeignSnapshot(f"the index describes revision {at}, not {revision}")
        if at == 0:
            return spark.createDataFrame([], CLOSURE), spark.createDataFrame([], SETS)
        where = self._where(at)
        return spark.read.schema(CLOSURE).parquet(f"{self.store.root}/{where['closure']}"), spark.read.schema(SETS).parquet(f"{self.store.root}/{where['sets']}")

    def _derive(self, rels: DataFrame) -> tuple[DataFrame, DataFrame]:
        closure = C.closure_of(rels)
        sets = S.permission_sets(self.schema, rels, self.goals) if self.goals else self.store.spark.createDataFrame([], SETS)
        return closure, sets

    def _write(self, folder: str, closure: DataFrame | None, sets: DataFrame | None) -> None:
        """Rows of a revision; None: those of the one before."""
        before = self.cursor()
        where = self._where(before) if before else {}
        for name, rows in (("closure", closure), ("sets", sets)):
            if rows is not None:
                where[name] = f"{folder}/{name}"
                rows.write.mode("overwrite").parquet(f"{self.store.root}/{where[name]}")
        self.store.files.create(f"{folder}/DONE", json.dumps(where), True)

    def reindex(self) -> None:
        """Derive everything anew from the head."""
        snapshot = self.store.snapshot()
        if snapshot.revision:
            self._write(self._folder(snapshot.revision), *self._derive(snapshot.rels))

    def _applied(self, changes: DataFrame, rels_after: DataFrame, budget: int | None = None) -> tuple[DataFrame | None, DataFrame | None]:
        """Closure and sets after a write; None for what it leaves as it was."""
        if self.rebuild or not self.cursor():
            return self._derive(rels_after)
        closure, sets = self.rows()
        new_closure = new_sets = None
        touched = C.nesting_edges(changes)
        if not touched.isEmpty():
            pairs = C.packed(closure)
            after = checkpointed(C.nesting_edges(rels_after))
            removed = touched.join(after, ["a", "d"], "left_anti")
            added = touched.join(after, ["a", "d"], "left_semi")
            if not removed.isEmpty():
                pairs = C.edges_removed(pairs, removed, after)
            if not added.isEmpty():
                pairs = C.edges_added(pairs, added, budget)
            new_closure = C.unpacked(pairs)
        if self.goals:
            over = S.walks_arrow(self.schema, self.goals)
            walked = changes.where(F.concat("resource_type", F.lit("#"), "relation").isin([f"{t}#{r}" for t, r in over]))
            if not walked.isEmpty():
                new_sets = S.apply_sets(self.schema, rels_after, self.goals, sets, walked.select("resource_type", "resource_id").distinct())
        return new_closure, new_sets

    def hook(self, transaction, changes: DataFrame) -> None:
        """Maintenance inside a write: rows for the coming revision, which count once its head is written."""
        if self.cursor() != transaction.base.revision:
            raise ForeignSnapshot("the index doesn't describe the revision that the write began at; reindex first")
        self._write(self._folder(transaction.base.revision + 1, transaction.commit_id), *self._applied(changes, transaction.rels.select(*COLUMNS), self.budget))

    def apply_revision(self, revision: int) -> None:
        """Apply one revision of the change log; one that the index has seen is skipped."""
        if revision <= self.cursor():
            return
        changes = self.store.changes(revision - 1).where(F.col("revision") == revision)
        self._write(self._folder(revision), *self._applied(changes, self.store.snapshot(revision).rels))

    def verify(self) -> dict[str, DataFrame]:
        """Rows that the stored index lacks or has too many, against a derivation from the tuples."""
        closure, sets = self.rows()
        want = self._derive(self.store.snapshot(self.cursor()).rels)
        return {"closure": S.drift(want[0], closure), "sets": S.drift(want[1], sets)}

    def describes(self, snapshot: Snapshot) -> bool:
        return self.cursor() == snapshot.revision and snapshot.revision > 0
