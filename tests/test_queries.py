import duckdb
import pytest

import __spark_entry__ as entry
from credsift.plans import queries

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(queries.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_against_sql(spark, sf, db, name):
    got = entry.queries()[name](spark, sf).toPandas()
    want = db.execute(queries.ORACLE[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    rows = lambda d: sorted(tuple(repr(round(v, 9)) if isinstance(v, float) else str(v) for v in r) for r in d[columns].itertuples(index=False))
    assert rows(got) == rows(want)
