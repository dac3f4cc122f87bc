"""The driver's entry: registration, and queries of the catalog against their SQL."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_registration():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and "lookup_resources_recursive" in queries and len(queries) > 40


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", ["read_filter", "relationship_kinds", "parse_tuples", "validate_stored", "nested_relationships", "closure_edge_removed", "closure_of_a_cycle", "check_bulk_exclusion", "check_bulk_errors", "lookup_resources_recursive", "lookup_subjects_wildcard", "expand_tree", "permission_sets", "write_fold", "changes_since", "catchup"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df = entry.queries()[name](spark, DATA)
    expected = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in expected.description]
    assert sorted(map(repr, (tuple(r[n] for n in names) for r in df.collect()))) == sorted(map(repr, expected.fetchall()))
