"""Queries that compose whole reports, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fundloom.operators import metrics, reports
from fundloom.plans.analytics import _FULL, BETA_SQL, DRAWDOWN_SQL, GROWTH_SQL, STATISTICS_SQL, TODAY, _r
from fundloom.plans.common import Query, named, rounded
from fundloom.sources.adapters import LEVELS_SQL, PORTFOLIO_SQL, benchmark, portfolio, table
from fundloom.sources.adapters import levels as raw_levels
from fundloom.storage import written

#: MACHINERY has no benchmark, BUILDING that of urgent orders, the others that of all.
_CHOSEN = (("AUTOMOBILE", "all"), ("BUILDING", "urgent"), ("FURNITURE", "all"), ("HOUSEHOLD", "all"))
COMPARED = ("AUTOMOBILE", "BUILDING", "MACHINERY")


def _benchmarks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").groupBy(F.to_date("o_orderdate").alias("obs_date")).agg(F.avg("o_totalprice").alias("value"))
    values = benchmark(spark, sf_dir).withColumn("benchmark_id", F.lit("all")).unionByName(urgent.withColumn("benchmark_id", F.lit("urgent")))
    return spark.createDataFrame(list(_CHOSEN), "series_id string, benchmark_id string"), written(values, "benchmarks")


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels as a table: a report asks for them many times, and each time would read all orders again."""
    return written(raw_levels(spark, sf_dir), "levels")


def _today():
    return F.lit(TODAY).cast("date")


def fund_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reports.fund_reports(_levels(spark, sf_dir), *_benchmarks(spark, sf_dir), _today()))


def fund_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three segments over the last year."""
    return rounded(reports.comparison(_levels(spark, sf_dir), *_benchmarks(spark, sf_dir), COMPARED, _today(), "1y"))


def portfolio_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reports.portfolio_reports(_levels(spark, sf_dir), portfolio(spark), *_benchmarks(spark, sf_dir), _today()), 5)


def portfolio_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reports.portfolio_positions(_levels(spark, sf_dir), portfolio(spark)), 5)


def portfolio_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of both portfolios' files; BUILDING is marked as synthetic and has a name that needs quotes."""
    names = _levels(spark, sf_dir).select("series_id").distinct().where("series_id <> 'MACHINERY'")
    funds = names.select("series_id", F.concat(F.lit("FS-"), "series_id").alias("scheme_code"), F.when(F.col("series_id") == "BUILDING", 'The "B", fund').otherwise(F.lower("series_id")).alias("name"), (F.col("series_id") == "BUILDING").alias("is_synthetic"))
    return reports.portfolio_export(_levels(spark, sf_dir), portfolio(spark), funds)


def queries() -> dict[str, Query]:
    return named(fund_report, fund_comparison, portfolio_report, portfolio_positions, portfolio_export)


_VALUES = """
bv AS (SELECT 'all' AS benchmark_id, obs_date, value FROM bench UNION ALL
       SELECT 'urgent', CAST(o_orderdate AS DATE), avg(o_totalprice) FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY ALL),
bm(series_id, benchmark_id) AS (VALUES """ + ", ".join(f"('{s}', '{b}')" for s, b in _CHOSEN) + ")"

#: Returns and metrics of the levels in ``nav``, against the benchmark levels from each series' first date on.
_METRICS = f"""
ret AS (SELECT * FROM (SELECT series_id, obs_date, level, level / lag(level) OVER (PARTITION BY series_id ORDER BY obs_date) - 1 AS ret FROM nav) WHERE ret IS NOT NULL),
bi AS (SELECT series_id, v.obs_date, value FROM cm JOIN (SELECT series_id, min(obs_date) AS f FROM nav GROUP BY series_id) USING (series_id) JOIN bv v ON v.benchmark_id = cm.benchmark_id AND v.obs_date >= f),
br AS (SELECT series_id, obs_date, value / lag(value) OVER (PARTITION BY series_id ORDER BY obs_date) - 1 AS bret FROM bi),
al AS (SELECT series_id, obs_date, ret, bret FROM ret JOIN br USING (series_id, obs_date) WHERE bret IS NOT NULL),
{STATISTICS_SQL}, {GROWTH_SQL}, {DRAWDOWN_SQL}, be AS {BETA_SQL.split("be AS", 1)[1]},
w AS (SELECT * FROM gr {_FULL})"""
_BASE = LEVELS_SQL.replace("nav AS", "lv AS", 1).split("\nret AS", 1)[0].rstrip(",\n")


def _metric_columns(digits: int) -> str:
    missing = ", ".join(f"CASE WHEN {m} IS NULL THEN '{m}' END" for m in metrics.UNITS)
    return f"{_r(*metrics.UNITS, digits=digits)}, peak_date, trough_date, recovery_date, observations, beta_observations, concat_ws(',', {missing}) AS unavailable"


def _funds(months: int, label: str, only: str = "true") -> str:
    return f"""WITH {_BASE}, {_VALUES}, cm AS (SELECT * FROM bm),
        e AS (SELECT series_id, min(obs_date) AS f, max(obs_date) AS l, CAST(max(obs_date) - INTERVAL {months} MONTH AS DATE) AS s FROM lv WHERE {only} GROUP BY series_id),
        nav AS (SELECT lv.* FROM lv JOIN e USING (series_id) WHERE obs_date >= s), {_METRICS},
        n AS (SELECT series_id, min(obs_date) AS period_start, max(obs_date) AS period_end FROM nav GROUP BY series_id HAVING count(*) >= 2),
        fr AS (SELECT series_id, '{label}' AS period, period_start, period_end, date_diff('day', f, s) >= -5 AS covered, CAST(date_diff('day', l, DATE '{TODAY}') AS INTEGER) AS age_days, date_diff('day', l, DATE '{TODAY}') > 7 AS stale,
               benchmark_id, 0.065::DOUBLE AS risk_free_rate, 0.95::DOUBLE AS confidence, {_metric_columns(6)} FROM n JOIN e USING (series_id) LEFT JOIN bm USING (series_id) JOIN w USING (series_id))"""


#: A portfolio's levels of the dates that all five assets have, in the last three years.
_HELD = f"""{PORTFOLIO_SQL}, hl AS (SELECT portfolio_id, series_id, obs_date, level, weight FROM lv JOIN portfolio USING (series_id)),
pd AS (SELECT portfolio_id, obs_date, count(*) = 5 AS whole FROM hl GROUP BY ALL),
pe AS (SELECT portfolio_id, greatest(min(obs_date) FILTER (whole), CAST(max(obs_date) FILTER (whole) - INTERVAL 36 MONTH AS DATE)) AS s, count(*) FILTER (whole) AS dates_aligned, count(*) FILTER (NOT whole) AS dates_dropped FROM pd GROUP BY portfolio_id),
fm AS (SELECT hl.* FROM hl JOIN pd USING (portfolio_id, obs_date) JOIN pe USING (portfolio_id) WHERE whole AND obs_date >= s),
gw AS (SELECT portfolio_id, series_id, any_value(weight) AS weight, any_value(weight) * arg_max(level, obs_date) / arg_min(level, obs_date) AS g FROM fm GROUP BY ALL),
cw AS (SELECT *, g / sum(g) OVER (PARTITION BY portfolio_id) AS current_weight FROM gw),
ar AS (SELECT * FROM (SELECT *, level / lag(level) OVER (PARTITION BY portfolio_id, series_id ORDER BY obs_date) - 1 AS r FROM fm) WHERE r IS NOT NULL),
co AS (SELECT a.portfolio_id, a.series_id AS sa, b.series_id AS sb, any_value(a.weight) * any_value(b.weight) * covar_samp(a.r, b.r) AS c FROM ar a JOIN ar b ON a.portfolio_id = b.portfolio_id AND a.obs_date = b.obs_date GROUP BY ALL),
vr AS (SELECT portfolio_id, nullif(sum(c), 0) AS v FROM co GROUP BY portfolio_id)"""


def oracle_sql() -> dict[str, str]:
    only = f"series_id IN {COMPARED}"
    return {
        "fund_report": f"{_funds(36, '3y')} SELECT * FROM fr",
        "fund_comparison": f"""{_funds(12, '1y', only)},
            sd AS (SELECT obs_date, count(*) = {len(COMPARED)} AS whole FROM lv WHERE {only} GROUP BY obs_date),
            sh AS (SELECT lv.* FROM lv JOIN sd USING (obs_date) WHERE whole AND {only}),
            se AS (SELECT series_id, min(obs_date) AS sf, CAST(max(obs_date) - INTERVAL 12 MONTH AS DATE) AS ss FROM sh GROUP BY series_id),
            sw AS (SELECT series_id, min(obs_date) AS common_start, max(obs_date) AS common_end, date_diff('day', any_value(sf), any_value(ss)) >= -5 AS common_covered, round(arg_max(level, obs_date) / arg_min(level, obs_date) * 100, 6) AS rebased_end FROM sh JOIN se USING (series_id) WHERE obs_date >= ss GROUP BY series_id)
            SELECT * FROM fr LEFT JOIN (SELECT *, (SELECT count(*) FROM sd WHERE whole) AS dates_aligned, (SELECT count(*) FROM sd WHERE NOT whole) AS dates_dropped FROM sw) USING (series_id)""",
        # AUTOMOBILE is the first of the equal weights and the greatest of the others, so both take its benchmark.
        "portfolio_report": f"""WITH {_BASE}, {_VALUES}, {_HELD}, cm AS (SELECT DISTINCT portfolio_id AS series_id, 'all' AS benchmark_id FROM portfolio),
            nav AS (SELECT portfolio_id AS series_id, obs_date, 100000 * sum(weight * level / l0) AS level FROM fm JOIN (SELECT portfolio_id, series_id, arg_min(level, obs_date) AS l0 FROM fm GROUP BY ALL) USING (portfolio_id, series_id) GROUP BY ALL), {_METRICS},
            ac AS (SELECT portfolio_id, count(*) AS n_assets, sum(current_weight * current_weight) AS hhi, max(current_weight) AS largest_weight FROM cw GROUP BY portfolio_id),
            sg AS (SELECT portfolio_id, sum(sd) AS spread FROM (SELECT portfolio_id, any_value(weight) * stddev_samp(r) AS sd FROM ar GROUP BY portfolio_id, series_id) GROUP BY portfolio_id),
            n AS (SELECT series_id AS portfolio_id, min(obs_date) AS period_start, max(obs_date) AS period_end, arg_max(level, obs_date) AS value_end FROM nav GROUP BY series_id)
            SELECT portfolio_id, '3y' AS period, period_start, period_end, dates_aligned, dates_dropped, CAST(date_diff('day', period_end, DATE '{TODAY}') AS INTEGER) AS age_days, date_diff('day', period_end, DATE '{TODAY}') > 7 AS stale, 'all' AS benchmark_id, n_assets,
                   100000.0::DOUBLE AS value_start, round(value_end, 5) AS value_end, round(hhi, 5) AS hhi, round(1 / hhi, 5) AS effective_n, round(largest_weight, 5) AS largest_weight, round(spread / sqrt(v), 5) AS diversification_ratio, {_metric_columns(5)}
            FROM n JOIN pe USING (portfolio_id) JOIN ac USING (portfolio_id) LEFT JOIN sg USING (portfolio_id) LEFT JOIN vr USING (portfolio_id) JOIN (SELECT * RENAME (series_id AS portfolio_id) FROM w) USING (portfolio_id)""",
        "portfolio_positions": f"""WITH {_BASE}, {_HELD}, p AS (SELECT portfolio_id, sa AS series_id, sum(c) AS c FROM co GROUP BY ALL)
            SELECT portfolio_id, series_id, round(weight, 5) AS initial_weight, round(current_weight, 5) AS current_weight, round(g * 100000, 5) AS current_value, round(c / v, 5) AS risk_share FROM cw LEFT JOIN p USING (portfolio_id, series_id) LEFT JOIN vr USING (portfolio_id)""",
        "portfolio_export": f"""WITH {_BASE}, {_HELD.replace(" - INTERVAL 36 MONTH", " - INTERVAL 1200 MONTH")}, p AS (SELECT portfolio_id, sa AS series_id, sum(c) AS c FROM co GROUP BY ALL),
            h AS (SELECT *, row_number() OVER (PARTITION BY portfolio_id ORDER BY series_id) AS line FROM cw LEFT JOIN p USING (portfolio_id, series_id) LEFT JOIN vr USING (portfolio_id)),
            d AS (SELECT portfolio_id, min(obs_date) AS a, max(obs_date) AS b FROM fm GROUP BY portfolio_id)
            SELECT portfolio_id, 0 AS line, '{",".join(reports.EXPORT_COLUMNS)}' AS text FROM d UNION ALL SELECT portfolio_id, 6, '' FROM d
            UNION ALL SELECT portfolio_id, 7, '# As of ' || b || '; buy-and-hold from ' || a || '. Historical analysis only; not investment advice.' FROM d
            UNION ALL SELECT portfolio_id, line, CASE series_id WHEN 'MACHINERY' THEN 'MACHINERY,' WHEN 'BUILDING' THEN 'FS-BUILDING,"The ""B"", fund"' ELSE 'FS-' || series_id || ',' || lower(series_id) END || printf(',%.2f,%.2f,%.2f,', weight * 100, current_weight * 100, g * 100000)
                || coalesce(printf('%.2f', c / v * 100), '') || CASE WHEN series_id = 'BUILDING' THEN ',yes' ELSE ',no' END FROM h""",
    }
