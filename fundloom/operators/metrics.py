"""Risk and return statistics of level series, as one aggregate for each pass over the returns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fundloom.conventions import LEAST_FOR_BETA, LEAST_FOR_VOLATILITY, Conventions
from fundloom.operators.series import aligned_returns, simple_returns, worst_drawdown

DEFAULT = Conventions()


def enough(n: Column, least: int, value: Column) -> Column:
    return F.when(n >= least, value)


def growth(levels: DataFrame) -> DataFrame:
    """(series_id, cumulative_return, cagr)."""
    ends = levels.groupBy("series_id").agg(F.min(F.struct("obs_date", "level")).alias("a"), F.max(F.struct("obs_date", "level")).alias("b"), F.count("*").alias("n"))
    ratio, days = F.col("b.level") / F.col("a.level"), F.datediff("b.obs_date", "a.obs_date")
    return ends.select("series_id", enough(F.col("n"), 2, ratio - 1).alias("cumulative_return"), F.when(days > 0, F.pow(ratio, 365.25 / F.nullif(days, F.lit(0))) - 1).alias("cagr"))


def return_statistics(returns: DataFrame, conventions: Conventions = DEFAULT) -> DataFrame:
    """Mean, volatility, Sharpe, Sortino and value at risk of each series in one aggregate."""
    rate, root = F.lit(conventions.period_rate), conventions.periods**0.5
    n, mean, sd = F.count("ret"), F.avg("ret"), F.stddev_samp("ret")
    excess = F.col("ret") - rate
    below = F.sqrt(F.avg(F.pow(F.least(excess, F.lit(0.0)), 2)))
    z, tail = F.lit(conventions.quantile), F.lit(conventions.tail_density)
    least = LEAST_FOR_VOLATILITY
    return returns.groupBy("series_id").agg(
        n.alias("observations"),
        enough(n, 2, mean * conventions.periods).alias("annualized_mean_return"),
        enough(n, least, sd * root).alias("volatility"),
        enough(n, least, F.try_divide(F.avg(excess), F.nullif(sd, F.lit(0.0))) * root).alias("sharpe_ratio"),
        enough(n, least, F.try_divide(F.avg(excess), F.nullif(below, F.lit(0.0))) * root).alias("sortino_ratio"),
        enough(n, least, -F.percentile("ret", F.lit(1 - conventions.confidence))).alias("historical_var"),
        enough(n, least, -(mean + z * sd)).alias("parametric_var"),
        enough(n, least, -(mean - sd * tail)).alias("parametric_cvar"),
    )


def historical_cvar(returns: DataFrame, statistics: DataFrame) -> DataFrame:
    """The mean loss of the returns at or under the quantile; the quantiles are one row for each series."""
    joined = returns.join(statistics.select("series_id", "historical_var"), "series_id")
    return joined.where(F.col("ret") <= -F.col("historical_var")).groupBy("series_id").agg((-F.avg("ret")).alias("historical_cvar"))


def benchmark_statistics(aligned: DataFrame, conventions: Conventions = DEFAULT) -> DataFrame:
    """Beta, alpha, correlation, tracking error and information ratio over the dates that both sides have."""
    n = F.count("*")
    beta = F.try_divide(F.covar_samp("ret", "bret"), F.nullif(F.var_samp("bret"), F.lit(0.0)))
    diff = F.col("ret") - F.col("bret")
    error = F.stddev_samp(diff) * conventions.periods**0.5
    mean, market = F.avg("ret") * conventions.periods, F.avg("bret") * conventions.periods
    rf = conventions.period_rate * conventions.periods
    # Jensen's alpha leaves the mean excess over the rate of a period that beta doesn't explain, times the periods of a year.
    alpha = (mean - rf) - beta * (market - rf)
    least = LEAST_FOR_BETA
    return aligned.groupBy("series_id").agg(
        n.alias("beta_observations"),
        enough(n, least, beta).alias("beta"),
        enough(n, least, alpha).alias("alpha_annual"),
        enough(n, least, F.corr("ret", "bret")).alias("correlation"),
        enough(n, least, error).alias("tracking_error"),
        enough(n, least, F.try_divide(F.avg(diff) * conventions.periods, F.nullif(error, F.lit(0.0)))).alias("information_ratio"),
    )


#: Metrics of the report with their units.
UNITS = {
    "cumulative_return": "fraction", "cagr": "fraction per year", "annualized_mean_return": "fraction per year", "volatility": "fraction per year",
    "sharpe_ratio": "ratio", "sortino_ratio": "ratio", "max_drawdown": "fraction", "historical_var": "fraction of value", "historical_cvar": "fraction of value",
    "parametric_var": "fraction of value", "parametric_cvar": "fraction of value", "beta": "ratio", "alpha_annual": "fraction per year", "correlation": "ratio",
    "tracking_error": "fraction per year", "information_ratio": "ratio",
}


def wide_report(levels: DataFrame, benchmark: DataFrame, conventions: Conventions = DEFAULT) -> DataFrame:
    """One row for each series with all statistics; what can't be computed is null."""
    return wide_statistics(levels, aligned_returns(levels, benchmark), conventions)


def wide_statistics(levels: DataFrame, aligned: DataFrame, conventions: Conventions = DEFAULT) -> DataFrame:
    """``wide_report`` with the returns of both sides given: (series_id, obs_date, ret, bret)."""
    returns = simple_returns(levels)
    statistics = return_statistics(returns, conventions)
    out = growth(levels).join(statistics, "series_id", "left").join(historical_cvar(returns, statistics), "series_id", "left")
    out = out.join(worst_drawdown(levels), "series_id", "left")
    return out.join(benchmark_statistics(aligned, conventions), "series_id", "left")


def risk_report(levels: DataFrame, benchmark: DataFrame, conventions: Conventions = DEFAULT) -> DataFrame:
    """Tidy rows (series_id, metric, value, unit, reason): null values carry the reason."""
    wide = wide_report(levels, benchmark, conventions)
    short = F.coalesce(F.col("observations"), F.lit(0)) < LEAST_FOR_VOLATILITY

    def reason(metric: str) -> Column:
        if metric in ("beta", "alpha_annual", "correlation", "tracking_error", "information_ratio"):
            few = F.coalesce(F.col("beta_observations"), F.lit(0)) < LEAST_FOR_BETA
            return F.when(few, f"fewer than {LEAST_FOR_BETA} common observations").otherwise("the benchmark does not vary")
        return F.when(short, f"fewer than {LEAST_FOR_VOLATILITY} observations").otherwise("no variation")

    rows = [F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"), F.lit(u).alias("unit"), F.when(F.col(m).isNull(), reason(m)).alias("reason")) for m, u in UNITS.items()]
    return wide.select("series_id", F.explode(F.array(*rows)).alias("r")).select("series_id", "r.*")


def correlation_matrix(aligned_levels: DataFrame) -> DataFrame:
    """(series_a, series_b, n, correlation, covariance) of returns formed on the common dates; a <= b."""
    r = simple_returns(aligned_levels).select("series_id", "obs_date", "ret")
    a, b = r.toDF("series_a", "obs_date", "ret_a"), r.toDF("series_b", "obs_date", "ret_b")
    pairs = a.join(b, "obs_date").where("series_a <= series_b")
    n = F.count("*")
    return pairs.groupBy("series_a", "series_b").agg(n.alias("n"), enough(n, LEAST_FOR_BETA, F.corr("ret_a", "ret_b")).alias("correlation"), F.covar_samp("ret_a", "ret_b").alias("covariance"))


def histogram(returns: DataFrame, bins: int = 40) -> DataFrame:
    """(series_id, bin, low, high, n): equal bins between a series' extremes, the last one closed; empty bins count zero.

    A series without variation is widened by one half to each side.
    """
    ends = returns.groupBy("series_id").agg(F.min("ret").alias("a"), F.max("ret").alias("b"))
    flat = F.col("a") == F.col("b")
    ends = ends.select("series_id", F.when(flat, F.col("a") - 0.5).otherwise(F.col("a")).alias("a"), F.when(flat, F.col("b") + 0.5).otherwise(F.col("b")).alias("b"))
    place = F.least(F.floor((F.col("ret") - F.col("a")) / (F.col("b") - F.col("a")) * bins), F.lit(bins - 1)).cast("int")
    counted = returns.join(ends, "series_id").groupBy("series_id", place.alias("bin")).agg(F.count("*").alias("n"))
    edges = ends.select("series_id", "a", "b", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    width = (F.col("b") - F.col("a")) / bins
    return edges.join(counted, ["series_id", "bin"], "left").select("series_id", "bin", (F.col("a") + F.col("bin") * width).alias("low"), (F.col("a") + (F.col("bin") + 1) * width).alias("high"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def risk_change(levels: DataFrame, months: int = 6, conventions: Conventions = DEFAULT) -> DataFrame:
    """Volatility, worst drawdown and value at risk of the latest months and of as many before; both hold the middle date."""
    ends = levels.groupBy("series_id").agg(F.max("obs_date").alias("end"))
    joined = levels.join(ends, "series_id")
    mid, start = F.add_months("end", -months), F.add_months("end", -2 * months)
    out = None
    for name, cond in (("recent", F.col("obs_date") >= mid), ("previous", (F.col("obs_date") >= start) & (F.col("obs_date") <= mid))):
        part = joined.where(cond).drop("end")
        s = return_statistics(simple_returns(part), conventions).select("series_id", "volatility", "historical_var")
        d = worst_drawdown(part).select("series_id", "max_drawdown")
        one = s.join(d, "series_id").select("series_id", *(F.col(c).alias(f"{name}_{c}") for c in ("volatility", "max_drawdown", "historical_var")))
        out = one if out is None else out.join(one, "series_id", "outer")
    return out
