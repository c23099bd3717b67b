"""Every registered query against its SQL counterpart on the given tables."""

import os

import pytest

from __spark_entry__ import entry
from catalog.oracles import all_oracles
from catalog.queries import all_queries
from compare import connect, from_spark, from_sql

FOLDER = os.environ.get("CATALOG_FOLDER", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def tables():
    connection = connect(FOLDER)
    yield connection
    connection.close()


def test_every_query_has_sql():
    assert set(all_queries()) == set(all_oracles())


@pytest.mark.parametrize("name", sorted(all_oracles()))
def test_query_equals_sql(spark, tables, name):
    names, rows = from_spark(all_queries()[name](spark, FOLDER))
    expected_names, expected = from_sql(tables, all_oracles()[name])
    assert names == expected_names
    assert len(rows) == len(expected)
    assert rows == expected


def test_entry(spark):
    row = entry(spark).first()
    assert 0.0 <= row["hr_5"] <= row["hr_10"] <= row["hr_20"] <= 1.0
