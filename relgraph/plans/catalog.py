"""The registered queries over the graph of the star-schema tables, each with its SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import tuples as TU
from ..model import COLUMNS, ObjectRef, Operation, RelationshipFilter, SubjectFilter
from ..operators import closure as C
from ..operators import questions as Q
from ..operators import sets as S
from ..schema import parse
from ..sources.graph import MAPPING, SCHEMA_TEXT, graph, graph_schema
from ..sources.store import Store, fold
from .checkpoint import checkpointed

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
G = f"g as ({MAPPING})"
USER = "c1"
SETS = [("purchase", "handle"), ("supplier", "dealings")]


def _query(sql: str | None = None, name: str | None = None):
    def add(f):
        _QUERIES[name or f.__name__] = f
        if sql is not None:
            _SQL[name or f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _graph(spark: SparkSession, d: str) -> DataFrame:
    return checkpointed(graph(spark, d))


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# scans and tuples


@_query(f"with {G} select * from g where resource_type = 'purchase' and relation = 'buyer' and subject_type = 'customer' and subject_id = 'c5' and subject_relation = ''")
def read_filter(spark, d):
    return TU.read(graph(spark, d), RelationshipFilter("purchase", relation="buyer", subject=SubjectFilter("customer", "c5", "")))


@_query(f"with {G} select * from g where resource_type = 'supplier' order by resource_type, resource_id, relation, subject_type, subject_id, subject_relation limit 25")
def read_filter_limit(spark, d):
    return TU.read(graph(spark, d), RelationshipFilter("supplier"), 25)


@_query(f"with {G} select * from g where resource_type = 'purchase' and relation = 'buyer' and subject_id in (select 'c' || c_custkey from customer where c_acctbal < 0)")
def query_by_id_set(spark, d):
    ids = _table(spark, d, "customer").where("c_acctbal < 0").select(F.concat(F.lit("c"), "c_custkey").alias("id"))
    return TU.query(graph(spark, d), "purchase", relation="buyer", subject_ids=ids)


@_query(f"with {G} select * from g where resource_type = 'purchase' and resource_id in (select 'o' || o_orderkey from orders where o_totalprice > 300000)")
def query_by_resource_set(spark, d):
    ids = _table(spark, d, "orders").where("o_totalprice > 300000").select(F.concat(F.lit("o"), "o_orderkey").alias("id"))
    return TU.query(graph(spark, d), "purchase", resource_ids=ids)


@_query(f"with {G} select distinct resource_type, relation, subject_type, subject_relation from g")
def relationship_kinds(spark, d):
    return TU.kinds(graph(spark, d))


_TEXT = "resource_type || ':' || resource_id || '#' || relation || '@' || subject_type || ':' || subject_id || case when subject_relation <> '' then '#' || subject_relation else '' end"


@_query(f"with {G} select {_TEXT} as tuple from g")
def render_tuples(spark, d):
    return graph(spark, d).select(TU.rendered().alias("tuple"))


_LOST = "case when relation in ('refused', 'source', 'agent') then '' else {} end as {}"


@_query(f"with {G} select case when relation in ('refused', 'source', 'agent') then '' when relation = 'prior' then 'Purchase' else resource_type end as resource_type, {', '.join(_LOST.format(c, c) for c in ('resource_id', 'relation', 'subject_type', 'subject_id', 'subject_relation'))}, relation not in ('refused', 'source', 'agent', 'prior') as valid from g")
def parse_tuples(spark, d):
    """Tuples in text, some of which have lost their `@`, end in `#` or a line break, or begin with a capital."""
    text = TU.rendered()
    broken = F.when(F.col("relation") == "refused", F.translate(text, "@", "")).when(F.col("relation") == "source", F.concat(text, F.lit("#"))).when(F.col("relation") == "agent", F.concat(text, F.lit("#\n")))
    text = broken.when(F.col("relation") == "prior", F.regexp_replace(text, "^p", "P")).otherwise(text)
    return graph(spark, d).select(text.alias("t")).select(*TU.parsed(F.col("t"))).withColumn("valid", TU.valid())


@_query(f"with {G} select distinct resource_type, relation, subject_type, subject_relation from g where relation = 'refused' or resource_type = 'area' and subject_relation = 'resident'")
def validate_stored(spark, d):
    narrower = SCHEMA_TEXT.replace("relation refused: customer", "relation refused: area").replace("relation resident: customer | area#resident", "relation resident: customer")
    return TU.nonconforming(graph(spark, d), parse(narrower))


# nesting


_SET = "resource_type || ':' || resource_id || '#' || relation"
_EDGES = f"e as (select distinct {_SET} as a, subject_type || ':' || subject_id || '#' || subject_relation as d from g where subject_relation <> '')"
_CLOSURE = "c as (select a, d from e union select c.a, e.d from c join e on c.d = e.a)"
_UNPACKED = ", ".join(f"split_part({x}, ':', 1) as {s}_type, split_part(split_part({x}, ':', 2), '#', 1) as {s}_id, split_part({x}, '#', 2) as {s}_relation" for x, s in (("a", "ancestor"), ("d", "descendant")))


@_query(f"with {G}, {_EDGES} select {_UNPACKED} from e")
def nesting_edges(spark, d):
    return C.unpacked(C.nesting_edges(graph(spark, d)))


@_query(f"with recursive {G}, {_EDGES}, {_CLOSURE} select {_UNPACKED} from c")
def closure(spark, d):
    return C.closure_of(graph(spark, d))


#: Edges that close two cycles over the graph: the lowest tier within the highest, and the world within a nation.
_BACK = [("area:tier_9#resident", "area:tier_0#resident"), ("area:nation_3#resident", "area:world#resident")]
_BACK_SQL = " union all ".join(f"select '{a}', '{b}'" for a, b in _BACK)


@_query(f"with recursive {G}, {_EDGES.replace('e as (', 'e0 as (')}, e as (select a, d from e0 union all {_BACK_SQL}), {_CLOSURE} select a, d from c where a <> d")
def closure_of_a_cycle(spark, d):
    edges = C.nesting_edges(graph(spark, d))
    return C.transitive(edges.unionByName(spark.createDataFrame(_BACK, "a string, d string")))


_GONE = "(a = 'area:tier_4#resident' or a = 'area:region_1#resident' or a like 'supplier:%' and d = 'area:tier_7#resident')"


@_query(f"with recursive {G}, {_EDGES.replace('e as (', 'e0 as (')}, e as (select a, d from e0 where not {_GONE}), {_CLOSURE} select a, d from c")
def closure_edge_removed(spark, d):
    edges = checkpointed(C.nesting_edges(graph(spark, d)))
    return C.edges_removed(C.transitive(edges), edges.where(_GONE), edges.where(f"not {_GONE}"))


@_query(_SQL["closure_of_a_cycle"])
def closure_edge_added(spark, d):
    return C.edges_added(C.transitive(C.nesting_edges(graph(spark, d))), spark.createDataFrame(_BACK, "a string, d string"))


_BELOW = "n as (select 'supplier:' || 's1' || '#serves' as x union select c.d from c where c.a = 'supplier:s1#serves')"


@_query(f"with recursive {G}, {_EDGES}, {_CLOSURE}, {_BELOW} select g.* from g join n on {_SET} = n.x where g.subject_type = 'customer'")
def nested_relationships(spark, d):
    g = _graph(spark, d)
    start = spark.createDataFrame([("supplier", "s1", "serves")], "type string, id string, relation string")
    return C.nested_relationships(g, C.closure_of(g), start, "customer")


_HELD = f"h as (select distinct {_SET} as x from g where subject_type = 'customer' and subject_id in ('c1', '*') and subject_relation = ''), m as (select x from h union select c.a from h join c on c.d = h.x)"
_ID = "split_part(split_part(x, ':', 2), '#', 1)"


def _user(spark, name=USER):
    return spark.createDataFrame([("0", "customer", name, "")], "k string, subject_type string, subject_id string, subject_relation string")


@_query(f"with recursive {G}, {_EDGES}, {_CLOSURE}, {_HELD} select {_ID} as id from m where x like 'supplier:%#serves'")
def nested_resource_ids(spark, d):
    g = _graph(spark, d)
    return C.nested_resource_ids(g, C.closure_of(g), "supplier", "serves", _user(spark))


@_query(f"with recursive {G}, {_EDGES}, {_CLOSURE}, {_HELD} select {_ID} as id from m where x like 'supplier:%#serves' and {_ID} in (select 's' || s_suppkey from supplier where s_acctbal > 0)")
def nested_resource_ids_among(spark, d):
    g = _graph(spark, d)
    among = _table(spark, d, "supplier").where("s_acctbal > 0").select(F.concat(F.lit("s"), "s_suppkey").alias("id"))
    return C.nested_resource_ids(g, C.closure_of(g), "supplier", "serves", _user(spark), among)


# bulk checks: one request for every row of a table


def _requests(df: DataFrame, type_: str, id_, permission: str, subject_type: str, subject_id, relation: str = "") -> DataFrame:
    return df.select(F.lit(type_).alias("resource_type"), id_.alias("resource_id"), F.lit(permission).alias("permission"), F.lit(subject_type).alias("subject_type"), subject_id.alias("subject_id"), F.lit(relation).alias("subject_relation"))


def _checked(spark, d, requests: DataFrame) -> DataFrame:
    return Q.check_bulk(graph_schema(), _graph(spark, d), requests).select("resource_id", "subject_id", "has_permission")


def _purchases(spark, d, permission: str, customer=None) -> DataFrame:
    """A request for every order: of its own customer, or the one that `customer` numbers."""
    number = F.col("o_custkey") if customer is None else customer
    return _requests(_table(spark, d, "orders"), "purchase", F.concat(F.lit("o"), "o_orderkey"), permission, "customer", F.concat(F.lit("c"), number))


_ORDER = "q as (select 'o' || o_orderkey as resource_id, 'c' || o_custkey as subject_id from orders)"
#: (org, usr): whom a supplier serves, through any nesting; and with its agent.
_SERVED = f"um as (select distinct split_part(split_part(x.a, ':', 2), '#', 1) as org, g.subject_id as usr from (select a, d from c union select distinct {_SET}, {_SET} from g) x join g on {_SET} = x.d where x.a like 'supplier:%#serves' and g.subject_type = 'customer' and g.subject_relation = '')"
_DEALS = f"{_EDGES}, {_CLOSURE}, {_SERVED}, ov as (select org, usr from um union select resource_id, subject_id from g where resource_type = 'supplier' and relation = 'agent')"
_BUYS = "exists (select 1 from g where g.resource_type = 'purchase' and g.relation = 'buyer' and g.resource_id = q.resource_id and g.subject_id = q.subject_id)"
_OPEN = "exists (select 1 from g where g.resource_type = 'purchase' and g.relation = 'open' and g.resource_id = q.resource_id)"
_REFUSED = "exists (select 1 from g where g.resource_type = 'purchase' and g.relation = 'refused' and g.resource_id = q.resource_id and g.subject_id = q.subject_id)"


@_query(f"with {G}, q as (select 'o' || o_orderkey as resource_id, 'c' || (o_orderkey % (select count(*) from customer)) as subject_id from orders) select q.*, {_BUYS} as has_permission from q")
def check_bulk_relation(spark, d):
    return _checked(spark, d, _purchases(spark, d, "buyer", F.col("o_orderkey") % _table(spark, d, "customer").count()))


@_query(f"with recursive {G}, {_DEALS}, q as (select 's' || (c_custkey % (select count(*) from supplier)) as resource_id, 'c' || c_custkey as subject_id from customer) select q.*, exists (select 1 from ov where ov.org = q.resource_id and ov.usr = q.subject_id) as has_permission from q")
def check_bulk_union(spark, d):
    n = _table(spark, d, "supplier").count()
    return _checked(spark, d, _requests(_table(spark, d, "customer"), "supplier", F.concat(F.lit("s"), F.col("c_custkey") % n), "dealings", "customer", F.concat(F.lit("c"), "c_custkey")))


@_query(f"with recursive {G}, {_DEALS}, {_ORDER}, om as (select g.resource_id, ov.usr from g join ov on ov.org = g.subject_id where g.resource_type = 'purchase' and g.relation = 'source') select q.*, {_BUYS} and exists (select 1 from om where om.resource_id = q.resource_id and om.usr = q.subject_id) as has_permission from q")
def check_bulk_intersection(spark, d):
    return _checked(spark, d, _purchases(spark, d, "local"))


@_query(f"with {G}, {_ORDER} select q.*, {_OPEN} and not {_REFUSED} as has_permission from q")
def check_bulk_exclusion(spark, d):
    return _checked(spark, d, _purchases(spark, d, "open_to"))


_AGENTS = "f join g a on a.resource_type = 'supplier' and a.relation = 'agent' and a.resource_id = f.subject_id"
_HANDLES = f"oe as (select resource_id, subject_id from g where resource_type = 'purchase' and relation = 'buyer' union select f.resource_id, a.subject_id from g {_AGENTS} where f.resource_type = 'purchase' and f.relation = 'source')"


@_query(f"with {G}, {_HANDLES}, q as (select 'o' || o_orderkey as resource_id, 'c' || (o_orderkey % (select count(*) from supplier)) as subject_id from orders) select q.*, exists (select 1 from oe where oe.resource_id = q.resource_id and oe.subject_id = q.subject_id) as has_permission from q")
def check_bulk_arrow(spark, d):
    return _checked(spark, d, _purchases(spark, d, "handle", F.col("o_orderkey") % _table(spark, d, "supplier").count()))


_SEEN = (
    f"q0 as (select 'o' || o_orderkey as resource_id, 'c' || (o_orderkey % (select count(*) from customer)) as subject_id from orders), "
    "up as (select resource_id, subject_id, resource_id as at from q0 where (resource_id, subject_id) not in (select resource_id, subject_id from g where relation = 'refused') "
    "union select up.resource_id, up.subject_id, g.subject_id from up join g on g.resource_type = 'purchase' and g.relation = 'prior' and g.resource_id = up.at "
    "where (g.subject_id, up.subject_id) not in (select resource_id, subject_id from g where relation = 'refused')), "
    "yes as (select distinct up.resource_id, up.subject_id from up join g on g.resource_type = 'purchase' and g.resource_id = up.at and (g.relation = 'open' or g.relation = 'buyer' and g.subject_id = up.subject_id))"
)


@_query(f"with recursive {G}, {_SEEN} select q0.*, exists (select 1 from yes where yes.resource_id = q0.resource_id and yes.subject_id = q0.subject_id) as has_permission from q0")
def check_bulk_recursive(spark, d):
    """See, through any number of prior purchases on none of which the customer is refused."""
    asked = _purchases(spark, d, "see", F.col("o_orderkey") % _table(spark, d, "customer").count())
    return Q.check_bulk(graph_schema(), graph(spark, d), asked).select("resource_id", "subject_id", "has_permission")


@_query(f"with {G} select 'o' || o_orderkey as resource_id, 'czed' as subject_id, exists (select 1 from g where g.resource_type = 'purchase' and g.relation = 'open' and g.resource_id = 'o' || o_orderkey) as has_permission from orders")
def check_wildcard(spark, d):
    return _checked(spark, d, _purchases(spark, d, "open", F.lit("zed")))


@_query("select 's' || s_suppkey as resource_id, 'nation_3' as subject_id, s_nationkey = 3 as has_permission from supplier")
def check_userset_subject(spark, d):
    return _checked(spark, d, _requests(_table(spark, d, "supplier"), "supplier", F.concat(F.lit("s"), "s_suppkey"), "dealings", "area", F.lit("nation_3"), "resident"))


@_query(f"with recursive {G}, {_DEALS}, q as (select 's' || s_suppkey as resource_id, 'c' || s_suppkey as subject_id from supplier) select q.*, exists (select 1 from ov where ov.org = q.resource_id and ov.usr = q.subject_id) as has_permission, cast(null as varchar) as error from q union all select resource_id, subject_id, false, 'supplier#nothing isn''t defined' from q")
def check_bulk_errors(spark, d):
    """Half of the requests name a permission that there isn't."""
    supplier = _table(spark, d, "supplier")
    asked = [_requests(supplier, "supplier", F.concat(F.lit("s"), "s_suppkey"), p, "customer", F.concat(F.lit("c"), "s_suppkey")) for p in ("dealings", "nothing")]
    return Q.check_bulk(graph_schema(), _graph(spark, d), asked[0].unionByName(asked[1])).select("resource_id", "subject_id", "has_permission", "error")


# lookups of resources: every object that one customer has a permission on


def _looked_up(permission: str, type_: str = "purchase"):
    return lambda spark, d: Q.lookup_resources(graph_schema(), _graph(spark, d), (type_, permission), _user(spark)).select("id")


def _customers(spark, d) -> DataFrame:
    return _table(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("k"), F.lit("customer").alias("subject_type"), F.concat(F.lit("c"), "c_custkey").alias("subject_id"), F.lit("").alias("subject_relation"))


_OWN = "own as (select resource_id as id from g where resource_type = 'purchase' and relation = 'buyer' and subject_id = 'c1')"
_MINE = f"{_DEALS}, org as (select org as id from ov where usr = 'c1')"
_query(f"with {G}, {_OWN} select id from own", "lookup_resources_relation")(_looked_up("buyer"))
_query(f"with recursive {G}, {_MINE} select distinct id from org", "lookup_resources_union")(_looked_up("dealings", "supplier"))
_query(f"with {G} select distinct resource_id as id from g where resource_type = 'purchase' and relation = 'open' and resource_id not in (select resource_id from g where relation = 'refused' and subject_id = 'c1')", "lookup_resources_exclusion")(_looked_up("open_to"))
_query(f"with {G}, {_HANDLES} select distinct resource_id as id from oe where subject_id = 'c1'", "lookup_resources_arrow")(_looked_up("handle"))
_BANNED = "ban as (select resource_id as id from g where resource_type = 'purchase' and relation = 'refused' and subject_id = 'c1')"
_BASE = "b as (select id from own union select resource_id from g where resource_type = 'purchase' and relation = 'open')"
_VIEW = "v as (select id from b where id not in (select id from ban) union select g.resource_id from v join g on g.subject_id = v.id and g.resource_type = 'purchase' and g.relation = 'prior' where g.resource_id not in (select id from ban))"
_query(f"with recursive {G}, {_OWN}, {_BANNED}, {_BASE}, {_VIEW} select id from v", "lookup_resources_recursive")(_looked_up("see"))
_TRACED = "v as (select g.resource_id as id from g join org on g.subject_id = org.id where g.resource_type = 'purchase' and g.relation = 'source' union select g.resource_id from v join g on g.subject_id = v.id and g.resource_type = 'purchase' and g.relation = 'prior')"
_query(f"with recursive {G}, {_MINE}, {_TRACED} select id from v order by id limit 50", "lookup_resources_limit")(
    lambda spark, d: Q.lookup_resources(graph_schema(), _graph(spark, d), ("purchase", "trace"), _user(spark)).select("id").orderBy("id").limit(50)
)


@_query(f"with recursive {G}, {_DEALS} select distinct b.subject_id as k, b.resource_id as id from g b join g s on s.resource_id = b.resource_id and s.resource_type = 'purchase' and s.relation = 'source' join ov on ov.org = s.subject_id and ov.usr = b.subject_id where b.resource_type = 'purchase' and b.relation = 'buyer'")
def lookup_resources_intersection(spark, d):
    return Q.lookup_resources(graph_schema(), graph(spark, d), ("purchase", "local"), _customers(spark, d))


@_query(f"with recursive {G}, {_DEALS} select distinct usr as k, org as id from ov")
def lookup_resources_all_users(spark, d):
    return Q.lookup_resources(graph_schema(), graph(spark, d), ("supplier", "dealings"), _customers(spark, d))


@_query(f"with recursive {G}, {_EDGES}, {_CLOSURE}, {_HELD} select {_ID} as id from m where x like 'supplier:%#serves' union select resource_id from g where resource_type = 'supplier' and relation = 'agent' and subject_id = 'c1'")
def lookup_resources_indexed(spark, d):
    g = _graph(spark, d)
    return Q.lookup_resources(graph_schema(), g, ("supplier", "dealings"), _user(spark), closure=C.closure_of(g)).select("id")


# lookups of subjects


def _subjects(spark, d, resource: str, permission: str, relation: str = "", type_: str = "customer") -> DataFrame:
    return Q.lookup_subjects_answer(Q.lookup_subjects(graph_schema(), _graph(spark, d), ObjectRef(*resource.split(":")), permission, type_, relation))


@_query(f"with recursive {G}, {_DEALS} select distinct usr as subject_id, false as excluded from ov where org = 's1'")
def lookup_subjects_finite(spark, d):
    return _subjects(spark, d, "supplier:s1", "dealings")


_FIRST = "w as (select min(cast(substr(resource_id, 2) as bigint)) as n from g where resource_type = 'purchase' and relation = 'open' and resource_id in (select resource_id from g where relation = 'refused'))"


@_query(f"with {G}, {_FIRST} select subject_id, true as excluded from g where resource_type = 'purchase' and relation = 'refused' and resource_id = (select 'o' || n from w) union all select '*', false from w where n is not null")
def lookup_subjects_wildcard(spark, d):
    g = _graph(spark, d)
    refused = g.where("relation = 'refused'").select("resource_id")
    first = g.where("resource_type = 'purchase' and relation = 'open'").join(refused, "resource_id", "left_semi").agg(F.min(F.substring("resource_id", 2, 20).cast("bigint"))).first()[0]
    return Q.lookup_subjects_answer(Q.lookup_subjects(graph_schema(), g, ObjectRef("purchase", "none" if first is None else f"o{first}"), "open_to", "customer"))


@_query(f"with recursive {G}, {_EDGES}, {_CLOSURE} select split_part(split_part(d, ':', 2), '#', 1) as subject_id, false as excluded from c where a = 'area:world#resident' union all select 'world', false")
def lookup_subjects_usersets(spark, d):
    return _subjects(spark, d, "area:world", "resident", "resident", "area")


_NODE = "cast({} as int) as node_id, cast({} as int) as parent_id, cast({} as int) as ordinal, cast({} as int) as depth, '{}' as operation, {} as resource, '{}' as relation"


@_query(
    f"with {G}, f as (select min(o_orderkey) as o from orders), s as (select subject_id, row_number() over (order by subject_id) as i from g, f where resource_type = 'purchase' and relation = 'source' and resource_id = 'o' || o) "
    f"select {_NODE.format(0, 'null', 0, 0, 'union', 'f.p', 'handle')}, '' as subjects from (select 'purchase:o' || o as p from f) f "
    f"union all select {_NODE.format(1, 0, 0, 1, 'leaf', 'f.p', 'buyer')}, (select string_agg('customer:' || subject_id, ' ' order by subject_id) from g, f f2 where resource_type = 'purchase' and relation = 'buyer' and resource_id = 'o' || f2.o) from (select 'purchase:o' || o as p from f) f "
    f"union all select {_NODE.format(2, 0, 1, 1, 'union', 'f.p', 'handle')}, '' from (select 'purchase:o' || o as p from f) f "
    f"union all select {_NODE.format('2 + s.i', 2, 's.i - 1', 2, 'leaf', chr(39) + 'supplier:' + chr(39) + ' || s.subject_id', 'agent')}, (select string_agg('customer:' || a.subject_id, ' ' order by a.subject_id) from g a where a.resource_type = 'supplier' and a.relation = 'agent' and a.resource_id = s.subject_id) from s"
)
def expand_tree(spark, d):
    first = _table(spark, d, "orders").agg(F.min("o_orderkey")).first()[0]
    tree = Q.expand(graph_schema(), _graph(spark, d), ObjectRef("purchase", f"o{first}"), "handle")
    rows = [(*row[:-1], " ".join(row[-1])) for row in tree.rows()]
    return spark.createDataFrame(rows, "node_id int, parent_id int, ordinal int, depth int, operation string, resource string, relation string, subjects string")


# permission sets


@_query(f"with {G} select 'purchase' as resource_type, resource_id, 'handle' as permission, 'supplier' as set_type, subject_id as set_id, 'agent' as set_relation from g where resource_type = 'purchase' and relation = 'source'")
def permission_sets(spark, d):
    return S.permission_sets(graph_schema(), _graph(spark, d), SETS)


@_query(
    f"with recursive {G}, up as (select distinct resource_id as f, resource_id as p from g where resource_type = 'purchase' union select up.f, g.subject_id from up join g on g.resource_type = 'purchase' and g.relation = 'prior' and g.resource_id = up.p) "
    "select distinct 'purchase' as resource_type, up.f as resource_id, 'trace' as permission, 'supplier' as set_type, g.subject_id as set_id, r.r as set_relation from up join g on g.resource_type = 'purchase' and g.relation = 'source' and g.resource_id = up.p cross join (select unnest(['serves', 'agent']) as r) r"
)
def permission_sets_recursive(spark, d):
    return S.permission_sets(graph_schema(), graph(spark, d), [("purchase", "trace")])


def _indexed(spark, d, wanted=SETS):
    g = graph(spark, d)
    schema = graph_schema()
    return schema, g, C.closure_of(g), S.permission_sets(schema, g, wanted)


_query(_SQL["lookup_resources_arrow"], "resources_with_permission")(lambda spark, d: S.resources_with_permission(*_indexed(spark, d), ("purchase", "handle"), _user(spark)).select("id"))


@_query(_SQL["check_bulk_arrow"])
def has_permission_sets(spark, d):
    schema, g, c, s = _indexed(spark, d)
    requests = _purchases(spark, d, "handle", F.col("o_orderkey") % _table(spark, d, "supplier").count()).withColumn("k", Q.key())
    return S.has_permission(schema, g, c, s, ("purchase", "handle"), requests).select("resource_id", "subject_id", "has_permission")


@_query(f"with recursive {G}, {_DEALS} select distinct org as resource_id, usr as subject_id from ov")
def subjects_with_permission(spark, d):
    schema, g, c, s = _indexed(spark, d, SETS[1:])
    resources = g.where("resource_type = 'supplier'").select("resource_id").distinct()
    return S.subjects_with_permission(schema, g, c, s, ("supplier", "dealings"), resources, "customer")


@_query(f"with recursive {G}, {_DEALS} select s_name, cast(count(distinct usr) as bigint) as viewers from supplier join ov on ov.org = 's' || s_suppkey group by s_name")
def application_view(spark, d):
    """The sets as an application's view: suppliers with the number of customers that have dealings with them."""
    supplier = _table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("resource_id"), F.struct("s_name").alias("r"))
    counts = S.subject_counts(*_indexed(spark, d, SETS[1:]), SETS[1], supplier, "customer")
    return counts.select("r.s_name", F.col("n").alias("viewers"))


@_query(f"with recursive {G}, {_EDGES}, {_CLOSURE} select {_UNPACKED}, 'missing' as drift from c where a like 'supplier:s1#%' union all select 'area', 'x', 'resident', 'area', 'y', 'resident', 'extra'")
def drift_verify(spark, d):
    want = checkpointed(C.closure_of(graph(spark, d)))
    extra = spark.createDataFrame([("area", "x", "resident", "area", "y", "resident")], want.schema)
    return S.drift(want, want.where("not (ancestor_type = 'supplier' and ancestor_id = 's1')").unionByName(extra))


# writes and the change log


def _update_rows(spark, d) -> DataFrame:
    """Three updates for every order: its buyer is deleted, touched again if the total is high, and a new buyer touched twice."""
    orders = _table(spark, d, "orders")
    tup = lambda user: [F.lit("purchase").alias("resource_type"), F.concat(F.lit("o"), "o_orderkey").alias("resource_id"), F.lit("buyer").alias("relation"), F.lit("customer").alias("subject_type"), user.alias("subject_id"), F.lit("").alias("subject_relation")]
    old, new = F.concat(F.lit("c"), "o_custkey"), F.concat(F.lit("new"), "o_custkey")
    parts = [
        orders.select(F.lit(0).alias("seq"), F.lit(3).alias("operation"), *tup(old)), orders.where("o_totalprice > 150000").select(F.lit(1).alias("seq"), F.lit(2).alias("operation"), *tup(old)),
        orders.select(F.lit(2).alias("seq"), F.lit(2).alias("operation"), *tup(new)), orders.select(F.lit(3).alias("seq"), F.lit(2).alias("operation"), *tup(new)),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@_query(
    "select 'o' || o_orderkey as resource_id, 0 as seq, 3 as operation, 'c' || o_custkey as subject_id from orders "
    "union all select 'o' || o_orderkey, 1, 2, 'c' || o_custkey from orders where o_totalprice > 150000 "
    "union all select 'o' || o_orderkey, 2, 2, 'new' || o_custkey from orders"
)
def write_fold(spark, d):
    return fold(graph(spark, d), _update_rows(spark, d)).where("effective").select("resource_id", "seq", "operation", "subject_id")


def _store(spark) -> Store:
    checkpointed(spark.range(1))
    return Store(spark, f"{spark.sparkContext.getCheckpointDir()}/store-{uuid.uuid4().hex}")


#: Customers refused by failed events, in four writes by event, the last of which deletes what the first one wrote.
_WRITES = f"w as (select distinct cast(event_id % 3 as int) + 1 as revision, 2 as operation, 'o' || event_id as resource_id, 'c' || user_id as subject_id from events where event_type = 'error'), x as (select * from w union all select 4, 3, resource_id, subject_id from w where revision = 1)"


@_query(f"with {_WRITES} select cast(revision as bigint) as revision, cast(row_number() over (partition by revision order by resource_id, subject_id) - 1 as int) as seq, cast(operation as smallint) as operation, resource_id, subject_id from x where revision in (2, 3)")
def changes_since(spark, d):
    """Two revisions of a store's log, after the first."""
    return _refusals(spark, d).changes(1, 2).select("revision", "seq", "operation", "resource_id", "subject_id")


@_query(f"with {_WRITES} select resource_id, subject_id from x where operation = 2 and revision > 1")
def snapshot_of_changes(spark, d):
    """The tuples of the store's head: what its four revisions leave."""
    return _refusals(spark, d).snapshot().rels.select("resource_id", "subject_id")


def _refusals(spark, d) -> Store:
    store = _store(spark)
    events = _table(spark, d, "events").where("event_type = 'error'")
    rows = events.select((F.col("event_id") % 3).alias("part"), F.lit("purchase").alias("resource_type"), F.concat(F.lit("o"), "event_id").alias("resource_id"), F.lit("refused").alias("relation"), F.lit("customer").alias("subject_type"), F.concat(F.lit("c"), "user_id").alias("subject_id"), F.lit("").alias("subject_relation")).distinct()
    for part in range(3):
        t = store.transaction()
        t.create_all(rows.where(F.col("part") == part).drop("part"))
        t.commit()
    t = store.transaction()
    first = store.changes(0, 1).select(F.col("seq"), F.lit(int(Operation.DELETE)).alias("operation"), *COLUMNS)
    t.apply(first)
    t.commit()
    return store


@_query(f"with recursive {G}, {_EDGES}, {_CLOSURE} select {_UNPACKED} from c")
def catchup(spark, d):
    """A store whose nesting tuples come in two writes, followed as a stream; the index's closure."""
    from ..index import Index
    from ..streaming.follow import follow

    store = _store(spark)
    index = Index(store, mode="closure")
    nesting = _graph(spark, d).where("subject_relation <> ''")
    for part in (nesting.where("resource_type = 'area'"), nesting.where("resource_type <> 'area'")):
        t = store.transaction()
        t.create_all(part)
        t.commit()
    follow(index, f"{store.root}/follow", available_now=True).awaitTermination()
    return index.rows()[0]


@_query("select o_custkey as k, cast(count(*) as bigint) as n, cast(row_number() over (order by count(*) desc, o_custkey) as int) as rank from orders group by o_custkey qualify rank <= 10")
def hub_users(spark, d):
    """The users with the most direct grants on folders, a report for operators of the store."""
    owners = graph(spark, d).where("resource_type = 'purchase' and relation = 'buyer'").groupBy("subject_id").agg(F.count("*").alias("n"))
    keyed = owners.select(F.substring("subject_id", 2, 20).cast("bigint").alias("k"), "n").orderBy(F.desc("n"), "k").limit(10)
    return keyed.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "k")))


__all__ = ["oracle_sql", "queries"]
