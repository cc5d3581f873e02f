"""Each query of the library against its SQL twin in DuckDB, on the smallest tables; the others give rows."""

import glob
import os

import duckdb
import pytest

from fundloom.plans import FAMILIES

SF = "/root/testdata/sf0.001"
QUERIES = {k: v for f in FAMILIES for k, v in f.queries().items()}
SQL = {k: v for f in FAMILIES for k, v in f.oracle_sql().items()}


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else f"{v:.8g}"
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    relation = duck.sql(SQL[name])
    at = [list(relation.columns).index(c) for c in columns]
    assert sorted(relation.columns) == columns
    assert got == sorted(repr([plain(r[i]) for i in at]) for r in relation.fetchall())


def test_every_twin_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", ["optimise_mean_variance", "efficient_frontier", "chunk_documents", "context_selection"])
def test_gives_rows(spark, name):
    # The smallest tables have too few dates that all series share.
    assert QUERIES[name](spark, "/root/testdata/sf0.01").count() > 0
