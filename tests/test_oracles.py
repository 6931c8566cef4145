"""Every registered query with SQL gives what DuckDB gives on sf0.001."""

import duckdb
import pytest

from maploom.plans import catalog

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


def _sorted(rows):
    return sorted(rows, key=lambda r: tuple((v is None, repr(v)) for v in r))


#: Literal row counts in these queries are those of sf0.01 tables.
@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, DIR)
    names = sorted(df.columns)
    got = [tuple(r[c] for c in names) for r in df.collect()]
    rel = duck.sql(catalog.ORACLES[name])
    order = sorted(range(len(rel.columns)), key=lambda i: rel.columns[i])
    assert [rel.columns[i] for i in order] == names
    assert _sorted(got) == _sorted(tuple(r[i] for i in order) for r in rel.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_without_sql_runs(spark, name):
    assert catalog.QUERIES[name](spark, DIR).count() > 0
