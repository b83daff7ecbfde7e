"""Every registered query against its DuckDB answer at the smallest scale."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

import __spark_entry__
from catalog import registry
from catalog.fixtures import BASE_TABLES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = registry.QUERIES, registry.ORACLES
# No SQL can tell the rows of a random forest.
WITHOUT_ORACLE = {"train_forest", "predict", "feature_importance"}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables not present")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in BASE_TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    return connection


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.12g}")
    return value


def as_set(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([tuple(plain(row[i]) for i in order) for row in found], key=repr)


def test_all_but_model_queries_have_an_answer():
    assert set(QUERIES) - set(ORACLES) == WITHOUT_ORACLE


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    answer = duck.execute(ORACLES[name])
    names = [d[0] for d in answer.description]
    assert sorted(df.columns) == sorted(names)
    assert as_set(df.columns, df.collect()) == as_set(names, answer.fetchall())


@pytest.mark.parametrize("name", sorted(WITHOUT_ORACLE))
def test_model_query_gives_rows(spark, name):
    found = QUERIES[name](spark, SF_DIR).collect()
    assert found
    if name == "feature_importance":
        assert abs(sum(r["importance"] for r in found) - 1) < 1e-9


def test_entry_lists_every_query():
    assert set(registry.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
