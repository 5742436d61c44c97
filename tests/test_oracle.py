"""Every registered query against its DuckDB statement: same columns, types, rows and values."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from comparing import connect, differences
from conftest import TESTDATA
from voltlake.fixtures import oracle, queries as named_queries

SF = f"{TESTDATA}/sf0.01"
QUERIES = named_queries.queries()
STATEMENTS = oracle.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    with connect(SF) as con:
        yield con


def test_every_query_has_a_statement():
    assert set(QUERIES) == set(STATEMENTS)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_statement(name, spark, duck):
    got = QUERIES[name](spark, SF).toPandas()
    assert len(got) > 0, "an empty comparison proves nothing"
    assert differences(got, duck.execute(STATEMENTS[name]).df()) is None


def test_entry(spark):
    assert len(entry.entry(spark).collect()) == 10
