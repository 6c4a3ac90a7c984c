"""Every registered query against its SQL, over the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as spark_entry

SF = "/root/testdata/sf0.001"
QUERIES, SQL = spark_entry.queries(), spark_entry.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(
        (tuple(round(r[i], 9) if isinstance(r[i], float) else r[i] for i in order) for r in rows), key=repr
    )


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    if name not in SQL:
        assert rows
        return
    result = duck.execute(SQL[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert canonical(df.columns, rows) == canonical(columns, result.fetchall())


def test_every_check_has_its_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    assert spark_entry.entry(spark).count() > 0
