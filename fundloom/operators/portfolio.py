"""Portfolio operators on (portfolio_id, series_id, weight) and level series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fundloom.conventions import Conventions, require
from fundloom.operators.metrics import correlation_matrix
from fundloom.operators.series import rebase, simple_returns

DEFAULT = Conventions()


def normalised(portfolio: DataFrame) -> DataFrame:
    """Weights over their sum in each portfolio."""
    total = F.sum("weight").over(Window.partitionBy("portfolio_id"))
    return portfolio.withColumn("weight", F.try_divide("weight", total))


def weight_verdicts(portfolio: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """(portfolio_id, total_pct, n_assets, verdict): weights in percent, summed as decimals."""
    pct = F.sum((F.col("weight") * 100).cast("decimal(18,6)"))
    repeated = F.count_distinct("series_id") < F.count("*")
    verdict = F.when(repeated, "repeated asset").when(F.abs(pct - 100) > tolerance, "weights don't add up to 100").otherwise("ok")
    return portfolio.groupBy("portfolio_id").agg(pct.cast("double").alias("total_pct"), F.count("*").alias("n_assets"), verdict.alias("verdict"))


def stored_weight(percent: Column) -> Column:
    """A percentage as a fraction of six digits, halves to the even neighbour."""
    return F.bround(percent.cast("decimal(18,8)") / 100, 6)


def value_paths(aligned_levels: DataFrame, portfolio: DataFrame, initial: float = 100_000.0) -> DataFrame:
    """(portfolio_id, obs_date, value): weights bought at the first common date and held."""
    based = rebase(aligned_levels, 1.0)
    return based.join(portfolio, "series_id").groupBy("portfolio_id", "obs_date").agg((F.sum(F.col("weight") * F.col("rebased")) * initial).alias("value"))


def drifted_weights(aligned_levels: DataFrame, portfolio: DataFrame) -> DataFrame:
    """(portfolio_id, series_id, weight, drifted): weights at the last common date without rebalancing."""
    ends = aligned_levels.groupBy("series_id").agg(F.min_by("level", "obs_date").alias("a"), F.max_by("level", "obs_date").alias("b"))
    grown = portfolio.join(ends, "series_id").withColumn("g", F.col("weight") * F.col("b") / F.col("a"))
    return grown.select("portfolio_id", "series_id", "weight", (F.col("g") / F.sum("g").over(Window.partitionBy("portfolio_id"))).alias("drifted"))


def estimates(aligned_levels: DataFrame, conventions: Conventions = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """((series_id, mu, sigma), (series_a, series_b, covariance) in both orders), annualised."""
    returns = simple_returns(aligned_levels)
    single = returns.groupBy("series_id").agg((F.avg("ret") * conventions.periods).alias("mu"), (F.stddev_samp("ret") * conventions.periods**0.5).alias("sigma"))
    upper = correlation_matrix(aligned_levels).select("series_a", "series_b", (F.col("covariance") * conventions.periods).alias("covariance"))
    lower = upper.where("series_a <> series_b").select(F.col("series_b").alias("series_a"), F.col("series_a").alias("series_b"), "covariance")
    return single, upper.unionByName(lower)


def risk_contributions(aligned_levels: DataFrame, portfolio: DataFrame, conventions: Conventions = DEFAULT) -> DataFrame:
    """(portfolio_id, series_id, weight, contribution, share): parts of the annual volatility that add up to it."""
    _, cov = estimates(aligned_levels, conventions)
    a = portfolio.select("portfolio_id", F.col("series_id").alias("series_a"), F.col("weight").alias("w_a"))
    b = portfolio.select("portfolio_id", F.col("series_id").alias("series_b"), F.col("weight").alias("w_b"))
    # Covariances join each side on its assets; a portfolio has few.
    pairs = a.join(cov, "series_a").join(b, ["portfolio_id", "series_b"]).select("portfolio_id", "series_a", "w_a", "w_b", "covariance")
    marginal = pairs.groupBy("portfolio_id", "series_a", "w_a").agg((F.col("w_a") * F.sum(F.col("w_b") * F.col("covariance"))).alias("part"))
    of = Window.partitionBy("portfolio_id")
    variance = F.sum("part").over(of)
    out = marginal.withColumn("vol", F.sqrt(F.greatest(variance, F.lit(0.0))))
    return out.select("portfolio_id", F.col("series_a").alias("series_id"), F.col("w_a").alias("weight"), F.try_divide("part", F.nullif("vol", F.lit(0.0))).alias("contribution"), F.try_divide("part", F.nullif(F.col("vol") * F.col("vol"), F.lit(0.0))).alias("share"))


def portfolio_statistics(aligned_levels: DataFrame, portfolio: DataFrame, conventions: Conventions = DEFAULT) -> DataFrame:
    """(portfolio_id, expected_return, volatility, sharpe, diversification_ratio, hhi, effective_n)."""
    single, _ = estimates(aligned_levels, conventions)
    vol = risk_contributions(aligned_levels, portfolio, conventions).groupBy("portfolio_id").agg(F.sum("contribution").alias("volatility"))
    total = F.sum("weight")
    hhi = F.sum(F.col("weight") * F.col("weight")) / F.nullif(total * total, F.lit(0.0))
    base = portfolio.join(single, "series_id").groupBy("portfolio_id").agg(F.sum(F.col("weight") * F.col("mu")).alias("expected_return"), F.sum(F.col("weight") * F.col("sigma")).alias("weighted_sigma"), hhi.alias("hhi"))
    positive = F.nullif("volatility", F.lit(0.0))
    joined = base.join(vol, "portfolio_id")
    return joined.select("portfolio_id", "expected_return", "volatility", F.try_divide(F.col("expected_return") - conventions.risk_free, positive).alias("sharpe"), F.try_divide("weighted_sigma", positive).alias("diversification_ratio"), "hhi", F.try_divide(F.lit(1.0), "hhi").alias("effective_n"))


def class_rollup(drifted: DataFrame, classes: DataFrame) -> DataFrame:
    """Drifted weights by asset class of ``classes(series_id, asset_class)``; assets without one are "other"."""
    joined = drifted.join(classes, "series_id", "left").withColumn("asset_class", F.coalesce("asset_class", F.lit("other")))
    return joined.groupBy("portfolio_id", "asset_class").agg(F.sum("drifted").alias("weight"))


def market_shock(portfolio: DataFrame, betas: DataFrame, move: float, value: float = 100_000.0) -> DataFrame:
    """(portfolio_id, estimated_return, estimated_value, estimated_change): beta times the move, by normalised weights.

    An asset without a beta is an error: leaving it out would hide its part of the loss.
    """
    joined = normalised(portfolio).join(betas.select("series_id", "beta"), "series_id", "left")
    beta = F.when(F.col("beta").isNotNull(), F.col("beta")).otherwise(F.raise_error(F.concat(F.lit("no beta for "), F.col("series_id"))).cast("double"))
    ret = F.sum(F.col("weight") * beta * move)
    return joined.groupBy("portfolio_id").agg(ret.alias("estimated_return"), (value * (1 + ret)).alias("estimated_value"), (value * ret).alias("estimated_change"))


def assumption_stress(single: DataFrame, cov: DataFrame, portfolio: DataFrame, volatility_factor: float = 1.0, correlation: float | None = None, return_shift: float = 0.0, horizon_days: int = 1, conventions: Conventions = DEFAULT) -> DataFrame:
    """(portfolio_id, scenario, expected_return, volatility, sharpe, parametric_var) before and after changed assumptions.

    ``correlation`` replaces those between all assets of a portfolio; it has to
    lie from -1 / (assets - 1) to 1, where the matrix stays consistent.
    """
    require(0.1 <= volatility_factor <= 5, "the volatility factor lies between 0.1 and 5")
    require(correlation is None or -1 <= correlation <= 1, "a correlation lies between -1 and 1")
    p = normalised(portfolio)
    w = p.join(single, "series_id")
    n = F.count("*").over(Window.partitionBy("portfolio_id"))
    if correlation is not None:
        fits = F.lit(correlation) >= -1 / F.greatest(n - 1, F.lit(1))
        w = w.withColumn("sigma", F.when(fits, F.col("sigma")).otherwise(F.raise_error(F.lit("a uniform correlation below -1 / (assets - 1)")).cast("double")))
    of = w.groupBy("portfolio_id").agg(F.sum(F.col("weight") * F.col("mu")).alias("mu"), F.sum(F.col("weight") * F.col("sigma")).alias("s"), F.sum((F.col("weight") * F.col("sigma")) ** 2).alias("s2"))
    a = p.select("portfolio_id", F.col("series_id").alias("series_a"), F.col("weight").alias("w_a"))
    b = p.select("portfolio_id", F.col("series_id").alias("series_b"), F.col("weight").alias("w_b"))
    var = a.join(cov, "series_a").join(b, ["portfolio_id", "series_b"]).groupBy("portfolio_id").agg(F.sum(F.col("w_a") * F.col("w_b") * F.col("covariance")).alias("variance"))
    base = of.join(var, "portfolio_id")
    # With one correlation r for all pairs, the variance is r (sum ws)^2 + (1 - r) sum (ws)^2.
    shocked = F.col("variance") if correlation is None else correlation * F.col("s") ** 2 + (1 - correlation) * F.col("s2")
    cases = F.array(
        F.struct(F.lit("baseline").alias("scenario"), F.col("mu").alias("expected_return"), F.sqrt(F.greatest("variance", F.lit(0.0))).alias("volatility")),
        F.struct(F.lit("scenario").alias("scenario"), (F.col("mu") + return_shift).alias("expected_return"), (F.sqrt(F.greatest(shocked, F.lit(0.0))) * volatility_factor).alias("volatility")),
    )
    z, h = conventions.quantile, horizon_days / conventions.periods
    out = base.select("portfolio_id", F.explode(cases).alias("c")).select("portfolio_id", "c.*")
    return out.withColumn("sharpe", F.try_divide(F.col("expected_return") - conventions.risk_free, F.nullif("volatility", F.lit(0.0)))).withColumn("parametric_var", -(F.col("expected_return") * h + z * F.col("volatility") * h**0.5))


def allocation_change(single: DataFrame, cov: DataFrame, current: DataFrame, proposed: DataFrame, conventions: Conventions = DEFAULT) -> DataFrame:
    """``assumption_stress``'s baseline of each portfolio's current and proposed weights, as two rows (allocation)."""
    both = current.withColumn("portfolio_id", F.struct("portfolio_id", F.lit("current").alias("allocation"))).unionByName(proposed.withColumn("portfolio_id", F.struct("portfolio_id", F.lit("proposed").alias("allocation"))))
    found = assumption_stress(single, cov, both, conventions=conventions).where("scenario = 'baseline'")
    return found.select("portfolio_id.portfolio_id", "portfolio_id.allocation", "expected_return", "volatility", "sharpe", "parametric_var")


def pair_moments(aligned_levels: DataFrame) -> DataFrame:
    """(series_a, series_b, s, s2, t) in both orders: the population covariance of returns, the mean of squared products of deviations, and the observations."""
    r = simple_returns(aligned_levels)
    mean = r.groupBy("series_id").agg(F.avg("ret").alias("m"))
    d = r.join(mean, "series_id").select("series_id", "obs_date", (F.col("ret") - F.col("m")).alias("d"))
    a, b = d.toDF("series_a", "obs_date", "da"), d.toDF("series_b", "obs_date", "db")
    both = a.join(b, "obs_date").groupBy("series_a", "series_b")
    return both.agg(F.avg(F.col("da") * F.col("db")).alias("s"), F.avg((F.col("da") * F.col("db")) ** 2).alias("s2"), F.count("*").alias("t"))


def stressed(statistics: DataFrame, volatility_factor: float = 1.5, return_shift: float = -0.05, horizon_days: int = 10, conventions: Conventions = DEFAULT) -> DataFrame:
    """Normal value at risk over a horizon, before and after changed assumptions; all volatilities scale alike."""
    z, h = conventions.quantile, horizon_days / conventions.periods

    def loss(mu: Column, vol: Column) -> Column:
        return -(mu * h + z * vol * h**0.5)

    mu, vol = F.col("expected_return") + return_shift, F.col("volatility") * volatility_factor
    return statistics.select("portfolio_id", loss(F.col("expected_return"), F.col("volatility")).alias("baseline_var"), mu.alias("stressed_return"), vol.alias("stressed_volatility"), F.try_divide(mu - conventions.risk_free, F.nullif(vol, F.lit(0.0))).alias("stressed_sharpe"), loss(mu, vol).alias("stressed_var"))
