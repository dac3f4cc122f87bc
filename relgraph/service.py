"""The service: writes, reads and questions about one store under one schema."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .errors import InvalidArgument, SchemaMismatch
from .functions import tuples as TU
from .index import Index
from .model import COLUMNS, CheckRequest, CheckResult, ObjectRef, Operation, PermissionTree, Precondition, Relationship, RelationshipFilter, SubjectRef, SubjectsResult, Update, valid_name
from .operators import questions as Q
from .operators import sets as S
from .operators.closure import DEFAULT_BUDGET
from .plans.compile import Goal, resolve
from .plans.deadline import deadline
from .schema.build import Schema
from .sources.store import Snapshot, Store, Transaction
from .streaming.follow import catchup

_REQUEST = "i int, resource_type string, resource_id string, permission string, subject_type string, subject_id string, subject_relation string"


class Service:
    """index: None; "closure" or "sets" (maintained by every write); "rebuild" (sets, derived anew by every write);
    "async" (sets, maintained by `catchup` or a follower). With sets, questions about their permissions are answered
    from them; any other question uses the closure. timeout: seconds after which a question is cancelled; 0: never.
    """

    def __init__(
        self, store: Store, schema: Schema, max_depth: int = 50, index: str | None = None, permissions: list[str] | None = None,
        nesting_budget: int = DEFAULT_BUDGET, hooks: list[Callable] | None = None, timeout: float = 0,
    ):
        if store is None or schema is None:
            raise InvalidArgument("a service needs a store and a schema")
        if index not in (None, "closure", "sets", "rebuild", "async"):
            raise InvalidArgument(f"unknown index mode {index!r}")
        self.store, self.schema = store, schema
        self.max_depth = max_depth if max_depth > 0 else 50
        self.index = Index(store, schema, "closure" if index == "closure" else "sets", permissions, nesting_budget, index == "rebuild") if index else None
        self.timeout = timeout
        store.hooks = [*([self.index.hook] if index in ("closure", "sets", "rebuild") else []), *(hooks or ()), *store.hooks]

    # writes

    def _conforms(self, r: Relationship) -> None:
        r.validate()
        rel = self.schema.relation(r.resource.type, r.relation)
        if r.resource.type not in self.schema.definitions:
            raise InvalidArgument(f"type {r.resource.type!r} isn't defined")
        if rel is None:
            raise InvalidArgument(f"{r.resource.type}#{r.relation} isn't a relation")
        if not rel.allows(r.subject.type, r.subject.relation, r.subject.id == "*"):
            raise InvalidArgument(f"{r.resource.type}#{r.relation} doesn't take {r.subject}")

    def _validated(self, updates: list[Update], preconditions: list[Precondition]) -> None:
        if not updates:
            raise InvalidArgument("a write needs updates")
        for u in updates:
            if u.operation not in tuple(Operation):
                raise InvalidArgument(f"unknown operation {u.operation!r}")
            self._conforms(u.relationship)
        for p in preconditions:
            p.validate()

    def write_in(self, transaction: Transaction, updates: list[Update], preconditions: list[Precondition] = ()) -> int:
        """Write in a transaction that the caller commits."""
        self._validated(updates, preconditions)
        transaction.require(list(preconditions))
        return transaction.write(updates)

    def write(self, updates: list[Update], preconditions: list[Precondition] = ()) -> int:
        """All or nothing; the revision."""
        self._validated(updates, preconditions)
        t = self.store.transaction()
        self.write_in(t, updates, preconditions)
        return t.commit()

    def import_relationships(self, relationships: list[Relationship] | DataFrame) -> int:
        """Bulk import of tuples that aren't there yet; a list or a table of the six columns."""
        if isinstance(relationships, DataFrame):
            table = relationships.select(*COLUMNS)
            bad = table.where(~TU.valid()).first()
            if bad is not None:
                raise InvalidArgument(f"malformed relationship {tuple(bad)}")
            kinds = self.store.spark.createDataFrame(self.schema.kinds(), "resource_type string, relation string, subject_type string, subject_relation string, wildcard boolean")
            keyed = table.withColumn("wildcard", table["subject_id"] == "*")
            bad = keyed.join(kinds, kinds.columns, "left_anti").first()
            if bad is not None:
                raise InvalidArgument(f"the schema doesn't allow {tuple(bad)[:6]}")
        else:
            if not relationships:
                return self.store.head()
            for r in relationships:
                self._conforms(r)
            table = self.store.spark.createDataFrame([r.row for r in relationships], ", ".join(f"{c} string" for c in COLUMNS))
        t = self.store.transaction()
        t.create_all(table)
        return t.commit()

    def delete(self, f: RelationshipFilter, preconditions: list[Precondition] = ()) -> int:
        """Delete what a filter matches; the number of tuples."""
        f.validate()
        for p in preconditions:
            p.validate()
        t = self.store.transaction()
        t.require(list(preconditions))
        n = t.delete_matching(f)
        t.commit()
        return n

    # reads

    def read(self, f: RelationshipFilter, limit: int = 0) -> list[Relationship]:
        f.validate()
        return [Relationship.of(r) for r in TU.read(self.store.snapshot().rels, f, limit).collect()]

    def changes(self, after: int = 0, limit: int = 0) -> DataFrame:
        return self.store.changes(after, limit)

    def validate_stored(self) -> None:
        bad = TU.nonconforming(self.store.snapshot().rels, self.schema).collect()
        if bad:
            raise SchemaMismatch("; ".join(f"{r['resource_type']}#{r['relation']} holds {r['subject_type']}" + (f"#{r['subject_relation']}" if r["subject_relation"] else "") for r in bad))

    def catchup(self) -> int:
        if self.index is None:
            raise InvalidArgument("the service has no index")
        return catchup(self.index)

    # questions

    def _indexed(self, snapshot: Snapshot, goals: list[Goal]) -> tuple[DataFrame | None, DataFrame | None, set[Goal]]:
        """The closure, the sets, and those of `goals` that the sets answer, if the index describes the snapshot."""
        if self.index is None or not self.index.describes(snapshot):
            return None, None, set()
        closure, sets = self.index.rows(snapshot.revision)
        return closure, sets, {g for g in goals if g in self.index.goals}

    def check(self, resource: ObjectRef, permission: str, subject: SubjectRef) -> bool:
        result = self.check_bulk([CheckRequest(resource, permission, subject)])[0]
        if result.error is not None:
            raise result.error
        return result.has_permission

    def check_bulk(self, requests: list[CheckRequest]) -> list[CheckResult]:
        """One result for each request; what is wrong with a request is its own result's error."""
        results: list[CheckResult] = [CheckResult(r) for r in requests]
        rows = []
        for i, r in enumerate(requests):
            try:
                r.validate()
                resolve(self.schema, r.resource.type, r.permission)
                rows.append((i, r.resource.type, r.resource.id, r.permission, r.subject.type, r.subject.id, r.subject.relation))
            except InvalidArgument as e:
                results[i] = CheckResult(r, error=e)
        if rows:
            asked = self.store.spark.createDataFrame(rows, _REQUEST)
            with deadline(self.store.spark, self.timeout):
                for row in self.checked(asked).select("i", "has_permission").collect():
                    results[row["i"]] = CheckResult(requests[row["i"]], row["has_permission"])
        return results

    def checked(self, requests: DataFrame) -> DataFrame:
        """A table of requests (resource_type, resource_id, permission, subject columns, any others) with has_permission and error."""
        snapshot = self.store.snapshot()
        goals = [(r[0], r[1]) for r in requests.select("resource_type", "permission").distinct().collect()]
        closure, sets, stored = self._indexed(snapshot, goals)
        of = F.concat("resource_type", F.lit("#"), "permission")
        rest = requests.where(~of.isin(["#".join(g) for g in stored])) if stored else requests
        parts = [] if stored and len(stored) == len(goals) else [Q.check_bulk(self.schema, snapshot.rels, rest, self.max_depth, closure)]
        for g in sorted(stored):
            own = requests.where(of == "#".join(g)).withColumn("k", Q.key())
            found = S.has_permission(self.schema, snapshot.rels, closure, sets, g, own)
            parts.append(found.select(*requests.columns, "has_permission").withColumn("error", F.lit(None).cast("string")))
        return reduce(DataFrame.unionByName, parts)

    def resources(self, resource_type: str, permission: str, subjects: DataFrame) -> DataFrame:
        """(k, id): the resources on which each of `subjects` (k, subject columns) has the permission."""
        goal = resolve(self.schema, resource_type, permission)
        snapshot = self.store.snapshot()
        closure, sets, stored = self._indexed(snapshot, [goal])
        if stored:
            return S.resources_with_permission(self.schema, snapshot.rels, closure, sets, goal, subjects)
        return Q.lookup_resources(self.schema, snapshot.rels, goal, subjects, self.max_depth, closure)

    def lookup_resources(self, resource_type: str, permission: str, subject: SubjectRef, limit: int = 0) -> list[str]:
        subject.validate()
        resolve(self.schema, resource_type, permission)
        seed = self.store.spark.createDataFrame([("0", subject.type, subject.id, subject.relation)], "k string, subject_type string, subject_id string, subject_relation string")
        with deadline(self.store.spark, self.timeout):
            found = self.resources(resource_type, permission, seed).select("id").distinct().orderBy("id")
            return [r["id"] for r in (found.limit(limit) if limit else found).collect()]

    def subjects(self, resource: ObjectRef, permission: str, subject_type: str, subject_relation: str = "") -> DataFrame:
        """(subject_id, holds) for the subjects of the kind that can matter, and, if they are plain, Q.ANONYMOUS for all others."""
        goal = resolve(self.schema, resource.type, permission)
        snapshot = self.store.snapshot()
        closure, sets, stored = self._indexed(snapshot, [goal])
        if stored:
            one = self.store.spark.createDataFrame([(resource.id,)], "resource_id string")
            found = S.subjects_with_permission(self.schema, snapshot.rels, closure, sets, goal, one, subject_type, subject_relation).select("subject_id")
            if (subject_type, subject_relation) == goal:
                found = found.unionByName(one.select(F.col("resource_id").alias("subject_id"))).distinct()
            return found.withColumn("holds", F.lit(True))
        return Q.lookup_subjects(self.schema, snapshot.rels, resource, permission, subject_type, subject_relation, self.max_depth, closure)

    def lookup_subjects(self, resource: ObjectRef, permission: str, subject_type: str, subject_relation: str = "") -> SubjectsResult:
        resource.validate()
        if subject_relation and not valid_name(subject_relation):
            raise InvalidArgument(f"invalid relation name {subject_relation!r}")
        if subject_type not in self.schema.definitions or subject_relation and not self.schema.has(subject_type, subject_relation):
            raise InvalidArgument(f"{subject_type}#{subject_relation} isn't defined")
        with deadline(self.store.spark, self.timeout):
            rows = self.subjects(resource, permission, subject_type, subject_relation).collect()
        everyone = any(r["holds"] for r in rows if r["subject_id"] == Q.ANONYMOUS)
        ids = tuple(sorted(r["subject_id"] for r in rows if r["holds"] != everyone and r["subject_id"] != Q.ANONYMOUS))
        return SubjectsResult(True, (), ids) if everyone else SubjectsResult(False, ids, ())

    def expand(self, resource: ObjectRef, permission: str) -> PermissionTree:
        resource.validate()
        with deadline(self.store.spark, self.timeout):
            return Q.expand(self.schema, self.store.snapshot().rels, resource, permission, self.max_depth)
