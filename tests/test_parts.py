"""Memory of one task where keys are nearly as many as rows, and null keys of the queries concerned."""

import duckdb
import pytest
from pyspark.sql import functions as F

from fundloom.plans import catalogue, ingest
from fundloom.sources import adapters, csvkinds
from fundloom.sources.adapters import holdings


def aggregated_by(df, *keys):
    """Whether the plan aggregates by just these columns."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    names = [line.split("Aggregate [", 1)[1].split("]", 1)[0] for line in plan.splitlines() if "Aggregate [" in line]
    return any(sorted(k.split("#")[0].strip() for k in n.split(",")) == sorted(keys) for n in names)


def test_repeats_of_a_portfolio_are_found_without_a_table_of_all_pairs(spark):
    rows = spark.createDataFrame([(1, 1, "A", "50"), (1, 2, "A", "50"), (2, 1, "A", "100"), (3, 1, "B", "x"), (3, 2, None, "1"), (4, 1, "A", "99")], "portfolio_id long, line long, scheme_code string, weight_pct string")
    funds = spark.createDataFrame([("A",), ("B",)], "code string")
    found = csvkinds.portfolio_problems(rows, funds)
    assert not aggregated_by(found, "portfolio_id", "scheme_code")
    got = {r.portfolio_id: (r.n_rows, r.total_pct, r.problems) for r in found.collect()}
    assert got == {
        1: (2, 100.0, ["line 2: repeats line 1"]),
        2: (1, 100.0, []),
        3: (2, 1.0, ["line 1: not a weight from 0 to 100", "line 2: unknown code "]),
        4: (1, 99.0, ["weights don't add up to 100"]),
    }


def test_the_first_problems_of_a_large_portfolio_are_listed_in_order(spark):
    rows = spark.range(1, 20_001).select(F.lit(None).cast("long").alias("portfolio_id"), F.col("id").alias("line"), F.lit("A").alias("scheme_code"), F.lit("1").alias("weight_pct"))
    found = csvkinds.portfolio_problems(rows, spark.createDataFrame([("A",)], "code string"), most=3).collect()
    assert [(r.portfolio_id, r.n_rows, r.problems) for r in found] == [(None, 20_000, [f"line {k}: repeats line 1" for k in (2, 3, 4)])]


def test_lines_without_an_order_are_a_portfolio_as_in_the_sql(spark, tmp_path):
    spark.createDataFrame([(None, 7, 1, 5.0), (None, 7, 2, 15.0), (3, 7, 1, 2.0), (3, 8, 2, 2.0), (5, 8, 1, 1.0), (5, 7, 2, 1.0)], "l_orderkey long, l_suppkey long, l_linenumber int, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(7,)], "s_suppkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    con = duckdb.connect()
    for t in ("lineitem", "supplier"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    wanted = con.sql(ingest.oracle_sql()["portfolio_import"]).fetchall()
    got = [tuple(r) for r in ingest.portfolio_import(spark, str(tmp_path)).select("portfolio_id", "n_rows", "problems").collect()]
    assert (None, 2, "line 2: repeats line 1") in got
    assert sorted(got, key=str) == sorted(wanted, key=str)


@pytest.fixture(scope="module")
def odd_holdings(spark, tmp_path_factory):
    """Lines without a supplier or with parts that aren't there, and views of them in DuckDB."""
    folder = tmp_path_factory.mktemp("odd")
    lines = [(1, 1, 10.0), (1, 2, 20.0), (1, 1, 30.0), (1, 9, 40.0), (None, 1, 5.0), (None, 2, 15.0), (2, None, 1.0), (2, 2, 4.0), (3, 9, 7.0)]
    spark.createDataFrame(lines, "l_suppkey long, l_partkey long, l_extendedprice double").write.parquet(f"{folder}/lineitem.parquet")
    spark.createDataFrame([(1, "one", "B1"), (2, "two", "B2")], "p_partkey long, p_name string, p_brand string").write.parquet(f"{folder}/part.parquet")
    con = duckdb.connect()
    for t in ("lineitem", "part"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    return str(folder), con


@pytest.mark.parametrize("name", ["holdings_concentration", "sector_weights", "holdings_total_check"])
def test_holdings_of_odd_lines_equal_the_sql(spark, odd_holdings, name):
    folder, con = odd_holdings
    relation = con.sql(catalogue.oracle_sql()[name])
    got = catalogue.queries()[name](spark, folder).select(*relation.columns)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, relation.fetchall()))


def test_pairs_of_supplier_and_part_are_dealt_before_they_are_summed(spark, odd_holdings):
    """A partial sum before the deal would hold nearly all lines of a split."""
    plan = holdings(spark, odd_holdings[0])._jdf.queryExecution().optimizedPlan().toString()
    steps = [line.strip(" +-:").split(" [")[0] for line in plan.splitlines() if "Repartition" in line or "Aggregate [" in line]
    assert steps == ["RepartitionByExpression", "Aggregate", "RepartitionByExpression"]


def test_parts_of_holdings_grow_with_the_lines(spark, odd_holdings, monkeypatch):
    monkeypatch.setattr(adapters, "PART_ROWS", 1)
    assert "hashpartitioning(l_suppkey#" in (plan := holdings(spark, odd_holdings[0])._jdf.queryExecution().toString())
    assert ", 9), REPARTITION_BY_NUM" in plan
