"""Queries on level series, and their SQL twins."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fundloom.conventions import Conventions
from fundloom.operators import metrics, series
from fundloom.plans.common import Query, named, rounded
from fundloom.sources.adapters import LEVELS_SQL, benchmark, levels

TODAY = "2001-08-15"
C = Conventions()


def risk_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.risk_report(levels(spark, sf_dir), benchmark(spark, sf_dir)))


def risk_report_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.wide_report(levels(spark, sf_dir), benchmark(spark, sf_dir)))


def simple_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(series.simple_returns(levels(spark, sf_dir)).select("series_id", "obs_date", "ret"))


def growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.growth(levels(spark, sf_dir)))


def return_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.return_statistics(series.simple_returns(levels(spark, sf_dir))))


def benchmark_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.benchmark_statistics(series.aligned_returns(levels(spark, sf_dir), benchmark(spark, sf_dir))))


def drawdown_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(series.drawdowns(levels(spark, sf_dir)).select("series_id", "obs_date", "drawdown"))


def max_drawdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(series.worst_drawdown(levels(spark, sf_dir)))


def historical_var_cvar(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = series.simple_returns(levels(spark, sf_dir))
    s = metrics.return_statistics(r).select("series_id", "historical_var")
    return rounded(s.join(metrics.historical_cvar(r, s), "series_id"))


def rolling_volatility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(series.rolling_volatility(series.simple_returns(levels(spark, sf_dir))).select("series_id", "obs_date", "volatility"))


def rolling_sharpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(series.rolling_sharpe(series.simple_returns(levels(spark, sf_dir))).select("series_id", "obs_date", "sharpe"))


def rolling_beta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(series.rolling_beta(series.aligned_returns(levels(spark, sf_dir), benchmark(spark, sf_dir))).select("series_id", "obs_date", "beta"))


def trailing_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(series.trailing_returns(levels(spark, sf_dir)))


def as_of_one_year_return(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(series.as_of_one_year(levels(spark, sf_dir)))


def carried_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Mondays are left out, so that some dates have no value of their own.
    days = benchmark(spark, sf_dir).where(F.dayofweek("obs_date") != 2)
    return rounded(series.carried_forward(levels(spark, sf_dir), days).select("series_id", "obs_date", "value"))


def return_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.histogram(series.simple_returns(levels(spark, sf_dir))))


def correlation_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.correlation_matrix(series.align_levels(levels(spark, sf_dir))), 4)


def aligned_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(series.align_levels(levels(spark, sf_dir)).select("series_id", "obs_date", "level"))


def alignment_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.alignment_report(levels(spark, sf_dir))


def rebased_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(series.rebase(series.align_levels(levels(spark, sf_dir))).select("series_id", "obs_date", "rebased"), 3)


def chart_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each date, one column for each series, null where a series has none."""
    from fundloom.sources.adapters import SEGMENTS

    wide = levels(spark, sf_dir).groupBy("obs_date").pivot("series_id", list(SEGMENTS)).agg(F.first("level"))
    return rounded(wide)


def period_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many levels each series has in its last year, and in 1995 by dates, with their means."""
    rows = levels(spark, sf_dir)
    parts = {"1y": series.in_period(rows, "1y"), "1995": series.in_period(rows, start=date(1995, 1, 1), end=date(1995, 12, 31))}
    one = [p.groupBy("series_id").agg(F.count("*").alias("n"), F.avg("level").alias("mean_level")).withColumn("period", F.lit(k)) for k, p in parts.items()]
    return rounded(one[0].unionByName(one[1]), 4)


def period_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for label in ("1m", "1y", "5y", "max"):
        one = series.resolve_period(levels(spark, sf_dir), label).withColumn("period", F.lit(label))
        out = one if out is None else out.unionByName(one)
    return out.withColumnRenamed("start", "start_date").withColumnRenamed("end", "end_date")


def risk_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.risk_change(levels(spark, sf_dir)))


def freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.freshness(levels(spark, sf_dir), F.lit(TODAY).cast("date"))


def outlier_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Large moves that touch the dates of the last 30 days, taken as newly imported."""
    return rounded(series.large_moves(levels(spark, sf_dir), F.col("obs_date") >= F.lit("2001-07-02").cast("date")))


def queries() -> dict[str, Query]:
    return named(risk_report, risk_report_wide, simple_returns, growth, return_statistics, benchmark_stats, drawdown_series, max_drawdown, historical_var_cvar, rolling_volatility, rolling_sharpe, rolling_beta, trailing_returns, as_of_one_year_return, carried_benchmark, return_histogram, correlation_matrix, aligned_levels, alignment_report, rebased_compare, chart_merge, period_levels, period_window, risk_change, freshness, outlier_moves)


_RATE = "(pow(1.065::DOUBLE, 1.0::DOUBLE / 252) - 1)"
_W = "PARTITION BY series_id ORDER BY obs_date"

STATISTICS_SQL = f"""
st AS (SELECT series_id, count(*) AS observations, avg(ret) * 252 AS annualized_mean_return,
  CASE WHEN count(*) >= 30 THEN stddev_samp(ret) * sqrt(252) END AS volatility,
  CASE WHEN count(*) >= 30 THEN avg(ret - {_RATE}) / nullif(stddev_samp(ret), 0) * sqrt(252) END AS sharpe_ratio,
  CASE WHEN count(*) >= 30 THEN avg(ret - {_RATE}) / nullif(sqrt(avg(pow(least(ret - {_RATE}, 0), 2))), 0) * sqrt(252) END AS sortino_ratio,
  CASE WHEN count(*) >= 30 THEN -quantile_cont(ret, 1 - 0.95::DOUBLE) END AS historical_var,
  CASE WHEN count(*) >= 30 THEN -(avg(ret) + {C.quantile!r}::DOUBLE * stddev_samp(ret)) END AS parametric_var,
  CASE WHEN count(*) >= 30 THEN -(avg(ret) - stddev_samp(ret) * {C.tail_density!r}::DOUBLE) END AS parametric_cvar
  FROM ret GROUP BY series_id),
cv AS (SELECT series_id, -avg(ret) AS historical_cvar FROM ret JOIN st USING (series_id) WHERE ret <= -historical_var GROUP BY series_id)"""

GROWTH_SQL = """
gr AS (SELECT series_id, CASE WHEN count(*) >= 2 THEN arg_max(level, obs_date) / arg_min(level, obs_date) - 1 END AS cumulative_return,
  CASE WHEN max(obs_date) > min(obs_date) THEN pow(arg_max(level, obs_date) / arg_min(level, obs_date),
       365.25::DOUBLE / nullif(date_diff('day', min(obs_date), max(obs_date)), 0)) - 1 END AS cagr FROM nav GROUP BY series_id)"""

DRAWDOWN_SQL = """
dd AS (SELECT series_id, obs_date, level, level / max(level) OVER (PARTITION BY series_id ORDER BY obs_date ROWS UNBOUNDED PRECEDING) - 1 AS drawdown FROM nav),
tr AS (SELECT series_id, min(drawdown) AS max_drawdown, arg_min(obs_date, struct_pack(v := drawdown, d := obs_date)) AS trough_date FROM dd GROUP BY series_id),
pk AS (SELECT series_id, any_value(max_drawdown) AS max_drawdown, any_value(trough_date) AS trough_date, max(level) AS peak_level,
              arg_min(obs_date, struct_pack(v := -level, d := obs_date)) AS peak_date
       FROM nav JOIN tr USING (series_id) WHERE obs_date <= trough_date GROUP BY series_id),
md AS (SELECT series_id, max_drawdown, trough_date, peak_date,
              (SELECT min(obs_date) FROM nav n WHERE n.series_id = pk.series_id AND n.obs_date >= pk.trough_date AND n.level >= pk.peak_level AND pk.max_drawdown < 0) AS recovery_date
       FROM pk)"""

BETA_SQL = """
al AS (SELECT series_id, obs_date, ret, bret FROM ret JOIN bret USING (obs_date)),
be AS (SELECT series_id, n AS beta_observations, CASE WHEN n >= 60 THEN beta END AS beta,
  CASE WHEN n >= 60 THEN (m - 252 * (pow(1.065::DOUBLE, 1 / 252.0::DOUBLE) - 1)) - beta * (k - 252 * (pow(1.065::DOUBLE, 1 / 252.0::DOUBLE) - 1)) END AS alpha_annual,
  CASE WHEN n >= 60 THEN c END AS correlation, CASE WHEN n >= 60 THEN te END AS tracking_error,
  CASE WHEN n >= 60 THEN d / nullif(te, 0) END AS information_ratio
  FROM (SELECT series_id, count(*) AS n, covar_samp(ret, bret) / nullif(var_samp(bret), 0) AS beta, avg(ret) * 252 AS m, avg(bret) * 252 AS k,
               corr(ret, bret) AS c, stddev_samp(ret - bret) * sqrt(252) AS te, avg(ret - bret) * 252 AS d FROM al GROUP BY series_id))"""

_ALL = f"WITH {LEVELS_SQL}, {STATISTICS_SQL}, {GROWTH_SQL}, {DRAWDOWN_SQL}, {BETA_SQL}"
_FULL = "LEFT JOIN st USING (series_id) LEFT JOIN cv USING (series_id) LEFT JOIN md USING (series_id) LEFT JOIN be USING (series_id)"


def _r(*columns: str, digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in columns)


def _aligned(extra: str) -> str:
    return f"""WITH {LEVELS_SQL},
    ad AS (SELECT obs_date FROM nav GROUP BY obs_date HAVING count(*) = (SELECT count(DISTINCT series_id) FROM nav)),
    an AS (SELECT nav.* FROM nav JOIN ad USING (obs_date)) {extra}"""


def _periods() -> str:
    one = """SELECT series_id, '{p}' AS period, greatest(CAST({start} AS DATE), f) AS start_date, l AS end_date,
             date_diff('day', f, CAST({start} AS DATE)) >= -5 AS covered FROM e"""
    parts = [one.format(p=p, start="f" if m is None else f"l - INTERVAL {m} MONTH") for p, m in (("1m", 1), ("1y", 12), ("5y", 60), ("max", None))]
    return f"WITH {LEVELS_SQL}, e AS (SELECT series_id, min(obs_date) AS f, max(obs_date) AS l FROM nav GROUP BY series_id) " + " UNION ALL ".join(parts)


def _risk_change() -> str:
    parts = []
    for name, cond in (("recent", "obs_date >= CAST(e - INTERVAL 6 MONTH AS DATE)"), ("previous", "obs_date >= CAST(e - INTERVAL 12 MONTH AS DATE) AND obs_date <= CAST(e - INTERVAL 6 MONTH AS DATE)")):
        parts.append(f"""{name}_n AS (SELECT nav.* FROM nav JOIN e USING (series_id) WHERE {cond}),
        {name}_r AS (SELECT *, level / lag(level) OVER ({_W}) - 1 AS ret, level / max(level) OVER ({_W} ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM {name}_n),
        {name} AS (SELECT series_id, CASE WHEN count(ret) >= 30 THEN stddev_samp(ret) * sqrt(252) END AS {name}_volatility, min(dd) AS {name}_max_drawdown,
                   CASE WHEN count(ret) >= 30 THEN -quantile_cont(ret, 1 - 0.95::DOUBLE) END AS {name}_historical_var FROM {name}_r GROUP BY series_id)""")
    columns = [f"{n}_{c}" for n in ("recent", "previous") for c in ("volatility", "max_drawdown", "historical_var")]
    return f"WITH {LEVELS_SQL}, e AS (SELECT series_id, max(obs_date) AS e FROM nav GROUP BY series_id), {', '.join(parts)} SELECT series_id, {_r(*columns)} FROM recent FULL JOIN previous USING (series_id)"


_TRAILING = f"""WITH {LEVELS_SQL},
p(period, months) AS (VALUES ('1m', 1), ('3m', 3), ('6m', 6), ('1y', 12), ('3y', 36), ('5y', 60), ('since_start', NULL)),
e AS (SELECT series_id, min(obs_date) AS f, max(obs_date) AS l, arg_max(level, obs_date) AS last FROM nav GROUP BY series_id),
a AS (SELECT *, CASE WHEN months IS NULL THEN f ELSE CAST(l - to_months(CAST(months AS INTEGER)) AS DATE) END AS s FROM e, p),
x AS (SELECT series_id, period, months, f, l, last, s, min(obs_date) AS start_date, arg_min(level, obs_date) AS base FROM a JOIN nav USING (series_id) WHERE obs_date >= s GROUP BY ALL),
y AS (SELECT *, coalesce(months > 12, date_diff('day', start_date, l) > 365) AS annualised FROM x)
SELECT series_id, period, start_date, annualised, round(CASE WHEN date_diff('day', f, s) >= -5 THEN
  CASE WHEN annualised THEN pow(last / base, 365.25::DOUBLE / nullif(date_diff('day', start_date, l), 0)) - 1 ELSE last / base - 1 END END, 6) AS value FROM y"""


def oracle_sql() -> dict[str, str]:
    tidy = []
    for m, u in metrics.UNITS.items():
        if m in ("beta", "alpha_annual", "correlation", "tracking_error", "information_ratio"):
            reason = "CASE WHEN coalesce(beta_observations, 0) < 60 THEN 'fewer than 60 common observations' ELSE 'the benchmark does not vary' END"
        else:
            reason = "CASE WHEN coalesce(observations, 0) < 30 THEN 'fewer than 30 observations' ELSE 'no variation' END"
        tidy.append(f"SELECT series_id, '{m}' AS metric, round({m}, 6) AS value, '{u}' AS unit, CASE WHEN {m} IS NULL THEN {reason} END AS reason FROM w")
    stats = ("annualized_mean_return", "volatility", "sharpe_ratio", "sortino_ratio", "historical_var", "parametric_var", "parametric_cvar")
    beta = ("beta", "alpha_annual", "correlation", "tracking_error", "information_ratio")
    return {
        "risk_report": f"{_ALL}, w AS (SELECT * FROM gr {_FULL}) " + " UNION ALL ".join(tidy),
        "risk_report_wide": f"{_ALL} SELECT series_id, {_r('cumulative_return', 'cagr')}, observations, {_r(*stats)}, {_r('historical_cvar')}, {_r('max_drawdown')}, peak_date, trough_date, recovery_date, beta_observations, {_r(*beta)} FROM gr {_FULL}",
        "simple_returns": f"WITH {LEVELS_SQL} SELECT series_id, obs_date, {_r('ret')} FROM ret",
        "growth": f"WITH {LEVELS_SQL}, {GROWTH_SQL} SELECT series_id, {_r('cumulative_return', 'cagr')} FROM gr",
        "return_statistics": f"WITH {LEVELS_SQL}, {STATISTICS_SQL} SELECT series_id, observations, {_r(*stats)} FROM st",
        "benchmark_stats": f"WITH {LEVELS_SQL}, {BETA_SQL} SELECT series_id, beta_observations, {_r(*beta)} FROM be",
        "drawdown_series": f"WITH {LEVELS_SQL}, {DRAWDOWN_SQL} SELECT series_id, obs_date, {_r('drawdown')} FROM dd",
        "max_drawdown": f"WITH {LEVELS_SQL}, {DRAWDOWN_SQL} SELECT series_id, {_r('max_drawdown')}, peak_date, trough_date, recovery_date FROM md",
        "historical_var_cvar": f"WITH {LEVELS_SQL}, {STATISTICS_SQL} SELECT series_id, {_r('historical_var', 'historical_cvar')} FROM st JOIN cv USING (series_id)",
        "rolling_volatility": f"WITH {LEVELS_SQL} SELECT series_id, obs_date, round(v, 6) AS volatility FROM (SELECT series_id, obs_date, stddev_samp(ret) OVER w * sqrt(252) AS v, count(ret) OVER w AS n FROM ret WINDOW w AS ({_W} ROWS 62 PRECEDING)) WHERE n = 63",
        "rolling_sharpe": f"WITH {LEVELS_SQL} SELECT series_id, obs_date, round((m - {_RATE}) * sqrt(252) / nullif(s, 0), 6) AS sharpe FROM (SELECT series_id, obs_date, avg(ret) OVER w AS m, stddev_samp(ret) OVER w AS s, count(ret) OVER w AS n FROM ret WINDOW w AS ({_W} ROWS 125 PRECEDING)) WHERE n = 126",
        "rolling_beta": f"WITH {LEVELS_SQL}, {BETA_SQL} SELECT series_id, obs_date, round(c / nullif(v, 0), 6) AS beta FROM (SELECT series_id, obs_date, covar_samp(ret, bret) OVER w AS c, var_samp(bret) OVER w AS v, count(*) OVER w AS n FROM al WINDOW w AS ({_W} ROWS 125 PRECEDING)) WHERE n = 126",
        "trailing_returns": _TRAILING,
        "as_of_one_year_return": f"""WITH {LEVELS_SQL}, e AS (SELECT series_id, max(obs_date) AS latest, arg_max(level, obs_date) AS last FROM nav GROUP BY series_id),
            t AS (SELECT *, CAST(latest - INTERVAL 12 MONTH AS DATE) AS target FROM e)
            SELECT t.series_id, t.latest, CASE WHEN date_diff('day', n.obs_date, target) <= 7 THEN n.obs_date END AS base_date,
                   CASE WHEN date_diff('day', n.obs_date, target) <= 7 THEN round(last / n.level - 1, 6) END AS one_year_return
            FROM t ASOF LEFT JOIN nav n ON t.series_id = n.series_id AND t.target >= n.obs_date""",
        "carried_benchmark": f"WITH {LEVELS_SQL} SELECT series_id, obs_date, round(last_value(value IGNORE NULLS) OVER ({_W} ROWS UNBOUNDED PRECEDING), 6) AS value FROM nav LEFT JOIN (SELECT * FROM bench WHERE dayofweek(obs_date) <> 1) USING (obs_date)",
        "return_histogram": f"""WITH {LEVELS_SQL}, e AS (SELECT series_id, min(ret) AS a, max(ret) AS b FROM ret GROUP BY series_id),
            f AS (SELECT series_id, CASE WHEN a = b THEN a - 0.5 ELSE a END AS a, CASE WHEN a = b THEN b + 0.5 ELSE b END AS b FROM e),
            h AS (SELECT series_id, least(CAST(floor((ret - a) / (b - a) * 40) AS INTEGER), 39) AS bin, count(*) AS n FROM ret JOIN f USING (series_id) GROUP BY ALL)
            SELECT f.series_id, CAST(i AS INTEGER) AS bin, round(a + i * ((b - a) / 40), 6) AS low, round(a + (i + 1) * ((b - a) / 40), 6) AS high, coalesce(n, 0) AS n
            FROM f CROSS JOIN range(40) t(i) LEFT JOIN h ON f.series_id = h.series_id AND i = bin""",
        "correlation_matrix": _aligned(f""", ar AS (SELECT * FROM (SELECT series_id, obs_date, level / lag(level) OVER ({_W}) - 1 AS ret FROM an) WHERE ret IS NOT NULL)
            SELECT a.series_id AS series_a, b.series_id AS series_b, count(*) AS n, CASE WHEN count(*) >= 60 THEN round(corr(a.ret, b.ret), 4) END AS correlation, round(covar_samp(a.ret, b.ret), 4) AS covariance
            FROM ar a JOIN ar b ON a.obs_date = b.obs_date AND a.series_id <= b.series_id GROUP BY ALL"""),
        "aligned_levels": _aligned(f"SELECT series_id, obs_date, {_r('level')} FROM an"),
        "alignment_report": f"WITH {LEVELS_SQL}, n AS (SELECT obs_date, count(*) AS n FROM nav GROUP BY obs_date), k AS (SELECT count(DISTINCT series_id) AS k FROM nav) SELECT count(*) AS dates_in_union, count(*) FILTER (n = k) AS dates_aligned, count(*) FILTER (n < k) AS dates_dropped FROM n, k",
        "rebased_compare": _aligned(f"SELECT series_id, obs_date, round(level / first_value(level) OVER ({_W}) * 100, 3) AS rebased FROM an"),
        "chart_merge": f"WITH {LEVELS_SQL} SELECT obs_date, " + ", ".join(f"round(max(level) FILTER (series_id = '{s}'), 6) AS \"{s}\"" for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")) + " FROM nav GROUP BY obs_date",
        "period_levels": f"""WITH {LEVELS_SQL}, e AS (SELECT series_id, min(obs_date) AS f, max(obs_date) AS l FROM nav GROUP BY series_id)
            SELECT series_id, '1y' AS period, count(*) AS n, round(avg(level), 4) AS mean_level FROM nav JOIN e USING (series_id) WHERE obs_date >= greatest(CAST(l - INTERVAL 12 MONTH AS DATE), f) GROUP BY series_id
            UNION ALL SELECT series_id, '1995', count(*), round(avg(level), 4) FROM nav WHERE year(obs_date) = 1995 GROUP BY series_id""",
        "period_window": _periods(),
        "risk_change": _risk_change(),
        "freshness": f"WITH {LEVELS_SQL} SELECT series_id, max(obs_date) AS latest, CAST(date_diff('day', max(obs_date), DATE '{TODAY}') AS INTEGER) AS age_days, date_diff('day', max(obs_date), DATE '{TODAY}') > 7 AS stale FROM nav GROUP BY series_id",
        "outlier_moves": f"""WITH {LEVELS_SQL}, m AS (SELECT series_id, obs_date, lag(obs_date) OVER w AS prev_date, level / lag(level) OVER w - 1 AS change FROM nav WINDOW w AS ({_W}))
            SELECT series_id, prev_date, obs_date, round(change, 6) AS change FROM m WHERE abs(change) > 0.2 AND obs_date >= DATE '2001-07-02'""",
    }
