"""The numbered operators that SQL can express, against it."""

from __future__ import annotations

import pytest

from shelfmark.llm import registered
from tests.oracle import connect, spark_rows, sql_rows

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registered.oracles()))
def test_same_rows_as_sql(spark, name):
    df = registered.queries()[name](spark, FOLDER)
    columns, expected = sql_rows(connect(FOLDER), registered.oracles()[name])
    assert sorted(columns) == sorted(df.columns)
    assert spark_rows(df) == expected and expected
