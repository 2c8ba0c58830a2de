"""The queries over the driver's tables against DuckDB."""

import duckdb
import pytest

from goldweave.plans import gallery, showcase, workbench

SF = "/root/testdata/sf0.001"
QUERIES, ORACLE = showcase.QUERIES | gallery.QUERIES | workbench.QUERIES, showcase.ORACLE | gallery.ORACLE | workbench.ORACLE


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in showcase.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_every_query_has_sql():
    assert QUERIES.keys() == ORACLE.keys() and len(QUERIES) == len(showcase.QUERIES) + len(gallery.QUERIES) + len(workbench.QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    want = con.execute(ORACLE[name])
    columns = [d[0] for d in want.description]
    rows = want.fetchall()
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    order = [got.columns.index(c) for c in columns]
    assert sorted(repr(tuple(r[i] for i in order)) for r in got.collect()) == sorted(map(repr, rows)) and rows


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
