"""Every registered query against its SQL, over whole tables."""

from __future__ import annotations

import os

import pytest

from shelfmark.plans import registry
from tests.oracle import connect, spark_rows, sql_rows

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(registry.oracles()))
def test_same_rows_as_sql(spark, duck, name):
    df = registry.queries()[name](spark, FOLDER)
    columns, expected = sql_rows(duck, registry.oracles()[name])
    assert sorted(columns) == sorted(df.columns)
    assert spark_rows(df) == expected
    types = {c[0]: str(c[1]) for c in duck.execute("DESCRIBE " + registry.oracles()[name]).fetchall()}
    assert {c: TYPES[t] for c, t in df.dtypes} == types


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["s", "hostname", "path"] and df.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_search_reaches_the_scan_pruned(spark):
    """Only the columns that a search needs are read, and its selection is broadcast, not shuffled whole."""
    plan = registry.queries()["p1_exact"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "l_comment" not in plan and "l_tax" not in plan and "CartesianProduct" not in plan


def test_no_query_pairs_rows_without_a_key(spark):
    told = {n for n, f in registry.queries().items() if n not in ("t1_refresh_stream", "t6_latency_state") and "CartesianProduct" in f(spark, FOLDER)._jdf.queryExecution().executedPlan().toString()}
    assert not told
