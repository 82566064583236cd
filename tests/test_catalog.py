"""Every query of the catalog against its SQL, on the small tables."""

import os

import pytest

from tracewright.catalog import QUERIES, SQL

SF = os.environ.get("CATALOG_SF_DIR", "/root/testdata/sf0.01")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SF):
        pytest.skip("no tables")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    yield con
    con.close()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.execute(SQL[name])
    columns = sorted(got.columns)
    order = [c[0] for c in want.description]
    assert columns == sorted(order)
    key = lambda row: tuple((x is not None, x) for x in row)
    expected = sorted((tuple(r[order.index(c)] for c in columns) for r in want.fetchall()), key=key)
    assert sorted((tuple(r) for r in got.select(*columns).collect()), key=key) == expected
