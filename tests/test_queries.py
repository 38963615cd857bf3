"""Every registered query against its SQL, on the smallest test tables."""

import math
import os
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as registered
from checks import oracles, queries

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = registered.queries(), registered.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def plain(value):
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float) and math.isnan(value):
        return None
    return value


def in_order(columns, found):
    places = [columns.index(c) for c in sorted(columns)]
    return sorted((tuple(plain(r[i]) for i in places) for r in found), key=repr)


def by_sql(query):
    connection = duckdb.connect()
    for file in os.listdir(FOLDER):
        path = os.path.join(FOLDER, file)
        connection.execute(f"CREATE VIEW {file[:-8]} AS SELECT * FROM '{path}'")
    result = connection.execute(query)
    columns = [d[0] for d in result.description]
    found = in_order(columns, result.fetchall())
    connection.close()
    return sorted(columns), found


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
    assert set(queries.QUERIES) == set(oracles.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    df = QUERIES[name](spark, FOLDER)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    columns, expected = by_sql(ORACLES[name].replace(oracles.FOLDER, FOLDER))
    assert sorted(df.columns) == columns
    assert in_order(df.columns, df.collect()) == expected


def test_table_size(spark):
    found = {r[0]: r[1] for r in QUERIES["table_size"](spark, FOLDER).collect()}
    sizes = {f[:-8]: os.path.getsize(os.path.join(FOLDER, f)) for f in os.listdir(FOLDER)}
    assert found == sizes


def test_entry(spark):
    assert registered.entry(spark).count() == 14
