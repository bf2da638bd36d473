"""Every query against the SQL for the same rows."""

import math
import os

import duckdb
import pytest

from tessera import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        c.execute(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


def rows(table, columns):
    norm = lambda v: None if v is None or (isinstance(v, float) and math.isnan(v)) else v
    return sorted((tuple(map(norm, r)) for r in zip(*(table[c].to_pylist() for c in columns), strict=True)), key=repr)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, con, name):
    got = queries.QUERIES[name](spark, SF).toArrow()
    assert name in queries.ORACLES
    want = con.sql(queries.ORACLES[name]).to_arrow_table()
    columns = sorted(got.schema.names)
    assert columns == sorted(want.schema.names)
    assert got.num_rows > 0
    assert rows(got, columns) == rows(want, columns)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 500 * 64
    assert set(queries.QUERIES) <= set(__spark_entry__.queries())
