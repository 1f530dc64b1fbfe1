"""Every query against the SQL that gives the same rows, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from cucurbit.queries import QUERIES, SQL


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def rows(frame):
    return sorted(map(repr, frame[sorted(frame.columns)].itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf_dir, duck, name):
    found = QUERIES[name](spark, sf_dir).toPandas()
    if name in SQL:
        assert rows(found) == rows(duck.execute(SQL[name]).df())
    else:
        assert len(found)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
