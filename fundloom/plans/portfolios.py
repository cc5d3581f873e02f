"""Queries on portfolios and projections, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fundloom.conventions import Conventions
from fundloom.operators import metrics, optimise, portfolio, series, simulate
from fundloom.plans.analytics import BETA_SQL, _aligned
from fundloom.plans.common import Query, named, rounded
from fundloom.sources.adapters import LEVELS_SQL, PORTFOLIO_SQL, benchmark, levels, table
from fundloom.sources.adapters import portfolio as portfolios

C = Conventions()


def _aligned_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.align_levels(levels(spark, sf_dir))


def buy_and_hold_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(portfolio.value_paths(_aligned_levels(spark, sf_dir), portfolios(spark)), 2)


def drifted_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(portfolio.drifted_weights(_aligned_levels(spark, sf_dir), portfolios(spark)))


def risk_contribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(portfolio.risk_contributions(_aligned_levels(spark, sf_dir), portfolios(spark)))


def portfolio_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(portfolio.portfolio_statistics(_aligned_levels(spark, sf_dir), portfolios(spark)))


def asset_class_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = spark.createDataFrame([("AUTOMOBILE", "equity"), ("BUILDING", "equity"), ("FURNITURE", "debt"), ("HOUSEHOLD", "debt")], "series_id string, asset_class string")
    return rounded(portfolio.class_rollup(portfolio.drifted_weights(_aligned_levels(spark, sf_dir), portfolios(spark)), classes))


def _order_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order as a portfolio of its parts, by their shares of its price."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("portfolio_id"), F.col("l_partkey").alias("series_id"), "l_linenumber", F.col("l_extendedprice").cast("decimal(18,2)").alias("price"))
    total = lines.groupBy("portfolio_id").agg(F.sum("price").alias("total"))
    return lines.join(total, "portfolio_id").withColumn("share", F.col("price").cast("double") / F.col("total").cast("double"))


def weight_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as portfolios whose shares are cut to four digits."""
    return rounded(portfolio.weight_verdicts(_order_shares(spark, sf_dir).withColumn("weight", F.floor(F.col("share") * 10_000) / 10_000)))


def market_shock(spark: SparkSession, sf_dir: str) -> DataFrame:
    betas = metrics.benchmark_statistics(series.aligned_returns(levels(spark, sf_dir), benchmark(spark, sf_dir)))
    return rounded(portfolio.market_shock(portfolios(spark), betas, -0.2))


def stress_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(portfolio.stressed(portfolio.portfolio_statistics(_aligned_levels(spark, sf_dir), portfolios(spark))))


def sip_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plan for each customer: what is on the account at first, and contributions, years, returns and steps by the customer's number."""
    key = F.col("c_custkey")
    plans = table(spark, sf_dir, "customer").select(key.alias("plan_id"), (100.0 + key % 50).alias("monthly"), (1 + key % 5).cast("int").alias("years"), (key % 13 / 100.0).alias("annual_return"), F.greatest("c_acctbal", F.lit(0.0)).alias("lumpsum"), (key % 3 * 0.05).alias("step_up"))
    return rounded(simulate.sip_projection(plans), 2)


def _inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    found = _aligned_levels(spark, sf_dir)
    return portfolio.estimates(found)[0], portfolio.pair_moments(found), portfolios(spark)


def optimise_mean_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return optimise.optimise(*_inputs(spark, sf_dir), high=0.6)


def efficient_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return optimise.efficient_frontier(*_inputs(spark, sf_dir))


def assumption_stress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volatilities half as high again, all correlations 0.8, returns five points lower."""
    return rounded(portfolio.assumption_stress(*portfolio.estimates(_aligned_levels(spark, sf_dir)), portfolios(spark), 1.5, 0.8, -0.05, 10))


def allocation_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each portfolio against the other's weights."""
    own = portfolios(spark)
    other = own.withColumn("portfolio_id", F.when(F.col("portfolio_id") == "balanced", "tilted").otherwise("balanced"))
    return rounded(portfolio.allocation_change(*portfolio.estimates(_aligned_levels(spark, sf_dir)), own, other))


def stored_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of the parts of each order, a seventh of them, as fractions of six digits."""
    pct = F.col("share") * F.lit(100.0) / F.lit(7.0)
    return _order_shares(spark, sf_dir).select("portfolio_id", "l_linenumber", portfolio.stored_weight(pct).cast("double").alias("stored"))


def queries() -> dict[str, Query]:
    return named(buy_and_hold_value, drifted_weights, risk_contribution, portfolio_statistics, asset_class_rollup, weight_verdicts, market_shock, stress_test, sip_projection, optimise_mean_variance, efficient_frontier, assumption_stress, allocation_change, stored_weights)


_SHARES = """sh AS (SELECT l_orderkey AS portfolio_id, l_partkey AS series_id, l_linenumber, CAST(CAST(l_extendedprice AS DECIMAL(18, 2)) AS DOUBLE) / CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2))) OVER (PARTITION BY l_orderkey) AS DOUBLE) AS share FROM lineitem)"""


def oracle_sql() -> dict[str, str]:
    w = "PARTITION BY series_id ORDER BY obs_date"
    drift = f"""e AS (SELECT series_id, arg_max(level, obs_date) / arg_min(level, obs_date) AS g FROM an GROUP BY series_id),
        dr AS (SELECT portfolio_id, series_id, weight, weight * g / sum(weight * g) OVER (PARTITION BY portfolio_id) AS drifted FROM portfolio JOIN e USING (series_id))"""
    risk = f"""ar AS (SELECT * FROM (SELECT series_id, obs_date, level / lag(level) OVER ({w}) - 1 AS ret FROM an) WHERE ret IS NOT NULL),
        es AS (SELECT series_id, avg(ret) * 252 AS mu, stddev_samp(ret) * sqrt(252) AS sigma FROM ar GROUP BY series_id),
        co AS (SELECT a.series_id AS sa, b.series_id AS sb, covar_samp(a.ret, b.ret) * 252 AS cov FROM ar a JOIN ar b USING (obs_date) GROUP BY ALL),
        mc AS (SELECT a.portfolio_id, a.series_id, any_value(a.weight) AS weight, any_value(a.weight) * sum(b.weight * cov) AS part
               FROM portfolio a JOIN co ON a.series_id = sa JOIN portfolio b ON b.series_id = sb AND a.portfolio_id = b.portfolio_id GROUP BY a.portfolio_id, a.series_id),
        rc AS (SELECT *, sqrt(sum(part) OVER (PARTITION BY portfolio_id)) AS vol FROM mc),
        ps AS (SELECT p.portfolio_id, sum(p.weight * mu) AS expected_return, any_value(vol) AS volatility, sum(p.weight * sigma) / any_value(vol) AS diversification_ratio,
                      sum(p.weight * p.weight) / (sum(p.weight) * sum(p.weight)) AS hhi FROM portfolio p JOIN es USING (series_id) JOIN rc USING (portfolio_id, series_id) GROUP BY p.portfolio_id)"""
    z, h = f"{C.quantile!r}::DOUBLE", "(10 / 252.0::DOUBLE)"
    head = f", {PORTFOLIO_SQL}, "
    return {
        "buy_and_hold_value": _aligned(head + f"b AS (SELECT series_id, obs_date, level / first_value(level) OVER ({w}) AS g FROM an) SELECT portfolio_id, obs_date, round(sum(weight * g) * 100000, 2) AS value FROM b JOIN portfolio USING (series_id) GROUP BY ALL"),
        "drifted_weights": _aligned(head + drift + " SELECT portfolio_id, series_id, weight, round(drifted, 6) AS drifted FROM dr"),
        "risk_contribution": _aligned(head + risk + " SELECT portfolio_id, series_id, weight, round(part / vol, 6) AS contribution, round(part / (vol * vol), 6) AS share FROM rc"),
        "portfolio_statistics": _aligned(head + risk + " SELECT portfolio_id, round(expected_return, 6) AS expected_return, round(volatility, 6) AS volatility, round((expected_return - 0.065::DOUBLE) / volatility, 6) AS sharpe, round(diversification_ratio, 6) AS diversification_ratio, round(hhi, 6) AS hhi, round(1 / hhi, 6) AS effective_n FROM ps"),
        "asset_class_rollup": _aligned(head + drift + " SELECT portfolio_id, CASE WHEN series_id IN ('AUTOMOBILE', 'BUILDING') THEN 'equity' WHEN series_id IN ('FURNITURE', 'HOUSEHOLD') THEN 'debt' ELSE 'other' END AS asset_class, round(sum(drifted), 6) AS weight FROM dr GROUP BY ALL"),
        "weight_verdicts": f"""WITH {_SHARES}, w AS (SELECT *, floor(share * 10000) / 10000 AS weight FROM sh), a AS (SELECT portfolio_id, sum(CAST(weight * 100 AS DECIMAL(18, 6))) AS pct, count(*) AS n_assets, count(DISTINCT series_id) AS n FROM w GROUP BY portfolio_id)
            SELECT portfolio_id, round(CAST(pct AS DOUBLE), 6) AS total_pct, n_assets, CASE WHEN n < n_assets THEN 'repeated asset' WHEN abs(pct - 100) > 0.01 THEN 'weights don''t add up to 100' ELSE 'ok' END AS verdict FROM a""",
        "market_shock": f"WITH {LEVELS_SQL}, {BETA_SQL}, {PORTFOLIO_SQL}, r AS (SELECT portfolio_id, sum(weight / total * beta * -0.2::DOUBLE) AS r FROM (SELECT *, sum(weight) OVER (PARTITION BY portfolio_id) AS total FROM portfolio) LEFT JOIN be USING (series_id) GROUP BY portfolio_id) SELECT portfolio_id, round(r, 6) AS estimated_return, round(100000 * (1 + r), 6) AS estimated_value, round(100000 * r, 6) AS estimated_change FROM r",
        "assumption_stress": _aligned(head + risk + f""", u AS (SELECT p.portfolio_id, sum(p.weight * sigma) AS s, sum(pow(p.weight * sigma, 2)) AS s2 FROM portfolio p JOIN es USING (series_id) GROUP BY p.portfolio_id),
            c AS (SELECT portfolio_id, 'baseline' AS scenario, expected_return, volatility FROM ps UNION ALL SELECT portfolio_id, 'scenario', expected_return - 0.05::DOUBLE, 1.5::DOUBLE * sqrt(0.8::DOUBLE * s * s + (1 - 0.8::DOUBLE) * s2) FROM ps JOIN u USING (portfolio_id))
            SELECT portfolio_id, scenario, round(expected_return, 6) AS expected_return, round(volatility, 6) AS volatility, round((expected_return - 0.065::DOUBLE) / volatility, 6) AS sharpe, round(-(expected_return * {h} + {z} * volatility * sqrt({h})), 6) AS parametric_var FROM c"""),
        "allocation_change": _aligned(head + risk + f""", c AS (SELECT portfolio_id, 'current' AS allocation, expected_return, volatility FROM ps UNION ALL SELECT CASE portfolio_id WHEN 'balanced' THEN 'tilted' ELSE 'balanced' END, 'proposed', expected_return, volatility FROM ps)
            SELECT portfolio_id, allocation, round(expected_return, 6) AS expected_return, round(volatility, 6) AS volatility, round((expected_return - 0.065::DOUBLE) / volatility, 6) AS sharpe, round(-(expected_return / 252 + {z} * volatility * sqrt(1 / 252.0::DOUBLE)), 6) AS parametric_var FROM c"""),
        # Whole numbers of 1e-10, rounded to 1e-6 with halves to the even neighbour.
        "stored_weights": f"""WITH {_SHARES}, v AS (SELECT *, CAST(CAST(share * 100.0::DOUBLE / 7.0::DOUBLE AS DECIMAL(18, 8)) * 100000000 AS BIGINT) AS v FROM sh)
            SELECT portfolio_id, l_linenumber, (v // 10000 + CASE WHEN v % 10000 > 5000 OR (v % 10000 = 5000 AND (v // 10000) % 2 = 1) THEN 1 ELSE 0 END) / 1000000.0::DOUBLE AS stored FROM v""",
        "stress_test": _aligned(head + risk + f""", s AS (SELECT *, expected_return - 0.05::DOUBLE AS m, volatility * 1.5::DOUBLE AS v FROM ps)
            SELECT portfolio_id, round(-(expected_return * {h} + {z} * volatility * sqrt({h})), 6) AS baseline_var, round(m, 6) AS stressed_return, round(v, 6) AS stressed_volatility,
                   round((m - 0.065::DOUBLE) / v, 6) AS stressed_sharpe, round(-(m * {h} + {z} * v * sqrt({h})), 6) AS stressed_var FROM s"""),
        "sip_projection": """WITH RECURSIVE p AS (SELECT c_custkey AS plan_id, 100.0::DOUBLE + c_custkey % 50 AS monthly, 1 + c_custkey % 5 AS years, c_custkey % 13 / 100.0::DOUBLE AS r, greatest(c_acctbal, 0) AS lumpsum, c_custkey % 3 * 0.05::DOUBLE AS step_up FROM customer),
            m(plan_id, month, value, invested, monthly) AS (SELECT plan_id, 0, lumpsum, lumpsum, monthly FROM p UNION ALL
              SELECT m.plan_id, month + 1, (value + m.monthly) * pow(1 + r, 1.0::DOUBLE / 12), invested + m.monthly,
                     CASE WHEN (month + 1) % 12 = 0 THEN m.monthly * (1 + step_up) ELSE m.monthly END FROM m JOIN p ON m.plan_id = p.plan_id WHERE month < 12 * years)
            SELECT plan_id, CAST(month // 12 AS INTEGER) AS year, round(invested, 2) AS invested, round(value, 2) AS value FROM m WHERE month > 0 AND month % 12 = 0""",
    }
