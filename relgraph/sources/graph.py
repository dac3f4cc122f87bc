"""A relationship graph over the star-schema tables, and its schema.

Customers live in areas: nations, which are part of regions, which are part of the world. By their balance they are
also in one of ten tiers, each of which takes in the tier above it. Suppliers serve areas and have a customer as agent.
A purchase has its buyer, the supplier of its first line and the purchase of half its number as the prior one; urgent
open ones are open to everybody, and customers whose events failed are refused.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..schema import parse
from ..schema.build import Schema

SCHEMA_TEXT = """
definition customer {}
definition area { relation resident: customer | area#resident }
definition supplier {
    relation serves: area#resident
    relation agent: customer
    permission dealings = serves + agent
}
definition purchase {
    relation buyer: customer
    relation prior: purchase
    relation source: supplier
    relation open: customer:*
    relation refused: customer
    permission handle = buyer + source->agent
    permission see = (open + buyer + prior->see) - refused
    permission trace = source->dealings + prior->trace
    permission local = buyer & source->dealings
    permission open_to = open - refused
}
"""

#: The mapping, for Spark and DuckDB alike; integer division is written as floor of a quotient.
MAPPING = """
select 'area' as resource_type, 'nation_' || c_nationkey as resource_id, 'resident' as relation, 'customer' as subject_type, 'c' || c_custkey as subject_id, '' as subject_relation from customer
union all select 'area', 'region_' || n_regionkey, 'resident', 'area', 'nation_' || n_nationkey, 'resident' from nation
union all select 'area', 'world', 'resident', 'area', 'region_' || r_regionkey, 'resident' from region
union all select 'area', 'tier_' || cast(least(9, greatest(0, floor((c_acctbal + 1000) / 1100))) as bigint), 'resident', 'customer', 'c' || c_custkey, '' from customer
union all select 'area', 'tier_' || n_nationkey, 'resident', 'area', 'tier_' || (n_nationkey + 1), 'resident' from nation where n_nationkey < 9
union all select 'supplier', 's' || s_suppkey, 'serves', 'area', 'nation_' || s_nationkey, 'resident' from supplier
union all select 'supplier', 's' || s_suppkey, 'serves', 'area', 'tier_7', 'resident' from supplier where s_acctbal > 5000
union all select 'supplier', 's' || s_suppkey, 'agent', 'customer', 'c' || (s_suppkey % (select count(*) from customer)), '' from supplier
union all select 'purchase', 'o' || o_orderkey, 'buyer', 'customer', 'c' || o_custkey, '' from orders
union all select 'purchase', 'o' || o_orderkey, 'prior', 'purchase', 'o' || cast(floor(o_orderkey / 2) as bigint), '' from orders where o_orderkey > 0
union all select distinct 'purchase', 'o' || l_orderkey, 'source', 'supplier', 's' || l_suppkey, '' from lineitem where l_linenumber = 1
union all select 'purchase', 'o' || o_orderkey, 'open', 'customer', '*', '' from orders where o_orderpriority = '1-URGENT' and o_orderstatus = 'O'
union all select distinct 'purchase', 'o' || event_id, 'refused', 'customer', 'c' || user_id, '' from events where event_type = 'error'
"""
TABLES = ("customer", "nation", "region", "supplier", "orders", "lineitem", "events")


def graph_schema() -> Schema:
    return parse(SCHEMA_TEXT)


def graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tuples derived from the tables."""
    text = MAPPING
    for t in TABLES:
        text = text.replace(f"from {t}", f"from {{{t}}}")
    return spark.sql(text, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES})
