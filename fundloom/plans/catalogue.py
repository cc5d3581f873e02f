"""Queries on funds, holdings and flows, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fundloom.operators import catalogue as ops
from fundloom.plans.common import Query, named, rounded
from fundloom.sources.adapters import FUNDS_SQL, HOLDINGS_SQL, LEVELS_SQL, funds, holdings, levels, table


def fund_search_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of ten funds with a 1 in their name or id."""
    found = ops.search(funds(spark, sf_dir), "1").drop("s_acctbal")
    return ops.page(found, "name", "fund_id", offset=10, limit=10)


def category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.counts(funds(spark, sf_dir), "category", "asset_class")


def asset_class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.counts(funds(spark, sf_dir), "asset_class")


def data_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.status(levels(spark, sf_dir))


def latest_nav(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ops.latest_rows(levels(spark, sf_dir), "series_id", "obs_date", "level"))


def holdings_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ops.concentration(holdings(spark, sf_dir)))


def sector_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ops.sector_weights(holdings(spark, sf_dir)))


def holdings_total_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights scaled by a fund's number, so that all three verdicts occur."""
    scaled = holdings(spark, sf_dir).withColumn("weight_pct", F.col("weight_pct") * (0.9 + 0.04 * (F.col("fund_id") % 4)))
    return rounded(ops.totals_check(scaled))


def aum_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    joined = orders.join(customers, orders["o_custkey"] == customers["c_custkey"]).withColumnRenamed("c_mktsegment", "series_id")
    return rounded(ops.monthly(joined, "series_id", "o_orderdate", F.sum("o_totalprice").alias("aum")), 2)


def sip_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    joined = orders.join(customers, orders["o_custkey"] == customers["c_custkey"]).withColumnRenamed("c_mktsegment", "series_id")
    return rounded(ops.monthly(joined, "series_id", "o_orderdate", F.sum("o_totalprice").alias("inflow"), F.count_distinct("o_custkey").alias("accounts")), 2)


def holdings_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct dates, the latest first."""
    return table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("as_of_date")).distinct().orderBy(F.desc("as_of_date"))


def audit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events, users and the latest time by type."""
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.max("ts").alias("latest"))


def queries() -> dict[str, Query]:
    return named(fund_search_page, category_counts, asset_class_counts, data_status, latest_nav, holdings_concentration, sector_weights, holdings_total_check, aum_history, sip_flows, holdings_dates, audit_counts)


def oracle_sql() -> dict[str, str]:
    monthly = "SELECT c_mktsegment AS series_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, {} FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL"
    return {
        "fund_search_page": f"WITH {FUNDS_SQL}, f AS (SELECT * EXCLUDE (s_acctbal) FROM funds WHERE contains(lower(name), '1') OR contains(CAST(fund_id AS VARCHAR), '1')) SELECT *, (SELECT count(*) FROM f) AS total FROM f ORDER BY name, fund_id LIMIT 10 OFFSET 10",
        "category_counts": f"WITH {FUNDS_SQL} SELECT category, asset_class, count(*) AS n FROM funds GROUP BY ALL",
        "asset_class_counts": f"WITH {FUNDS_SQL} SELECT asset_class, count(*) AS n FROM funds GROUP BY ALL",
        "data_status": f"WITH {LEVELS_SQL} SELECT series_id, min(obs_date) AS first_date, max(obs_date) AS latest_date, count(*) AS observations FROM nav GROUP BY series_id",
        "latest_nav": f"WITH {LEVELS_SQL} SELECT series_id, max(obs_date) AS obs_date, round(arg_max(level, obs_date), 6) AS level FROM nav GROUP BY series_id",
        "holdings_concentration": f"""WITH {HOLDINGS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY fund_id ORDER BY weight_pct DESC, holding_name) AS k FROM holdings WHERE lower(sector) <> 'cash')
            SELECT fund_id, count(*) AS n_holdings, round(sum(weight_pct) FILTER (k <= 10), 6) AS top10_pct, round(sum(weight_pct * weight_pct) / (sum(weight_pct) * sum(weight_pct)), 6) AS hhi,
                   round(sum(weight_pct) * sum(weight_pct) / sum(weight_pct * weight_pct), 6) AS effective_n FROM r GROUP BY fund_id""",
        "sector_weights": f"WITH {HOLDINGS_SQL} SELECT fund_id, sector, round(sum(weight_pct), 6) AS weight_pct FROM holdings GROUP BY ALL",
        "holdings_total_check": f"""WITH {HOLDINGS_SQL}, t AS (SELECT fund_id, sum(weight_pct * (0.9::DOUBLE + 0.04::DOUBLE * (fund_id % 4))) AS t FROM holdings GROUP BY fund_id)
            SELECT fund_id, round(t, 6) AS total_pct, CASE WHEN t > 100.5 THEN 'rejected' WHEN t < 95 THEN 'incomplete' ELSE 'ok' END AS verdict FROM t""",
        "aum_history": monthly.format("round(sum(o_totalprice), 2) AS aum"),
        "sip_flows": monthly.format("round(sum(o_totalprice), 2) AS inflow, count(DISTINCT o_custkey) AS accounts"),
        "holdings_dates": "SELECT DISTINCT CAST(l_shipdate AS DATE) AS as_of_date FROM lineitem",
        "audit_counts": "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, max(ts) AS latest FROM events GROUP BY event_type",
    }
