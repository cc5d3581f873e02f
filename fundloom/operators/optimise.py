"""Mean-variance optimisation of portfolios of a few assets, one portfolio and objective to a Python call.

The estimates come from Spark aggregates; a group holds N means and N x N
covariances, N at most ``MOST_ASSETS``, whatever the length of the histories.
The quadratic programs are solved by an active-set method: the equality
constraints are solved exactly on the free assets, and assets enter and leave
the bounds until the optimality conditions hold.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fundloom.conventions import Conventions, require

MOST_ASSETS = 20
RIDGE = 1e-12


def check_bounds(n: int, low: float, high: float) -> None:
    require(0 <= low <= high <= 1, "weight limits must satisfy 0 <= least <= most <= 1")
    require(n * high >= 1 - 1e-6, f"{n} assets of at most {high:.0%} can't add up to 100%")
    require(n * low <= 1 + 1e-6, f"{n} assets of at least {low:.0%} add up to more than 100%")


def check_covariance(cov: np.ndarray) -> None:
    require(cov.ndim == 2 and cov.shape[0] == cov.shape[1], "a covariance matrix is square")
    require(bool(np.isfinite(cov).all()), "a covariance matrix is finite")
    require(bool(np.allclose(cov, cov.T, atol=1e-10)), "a covariance matrix is symmetric")
    require(float(np.linalg.eigvalsh(cov).min()) >= -1e-10 * max(1.0, float(np.abs(cov).max())), "a covariance matrix is positive semi-definite")


def solve_qp(q: np.ndarray, c: np.ndarray, a: np.ndarray, b: np.ndarray, low: float, high: float, start: np.ndarray) -> np.ndarray:
    """Minimise w'Qw/2 + c'w subject to Aw = b and bounds, from a feasible start."""
    n = len(c)
    q = q + RIDGE * max(1.0, np.trace(q) / n) * np.eye(n)
    w = start.copy()
    fixed = np.where(w <= low + 1e-12, -1, np.where(w >= high - 1e-12, 1, 0))
    for _ in range(50 * n + 50):
        free = np.flatnonzero(fixed == 0)
        step, multipliers = np.zeros(n), None
        gradient = q @ w + c
        k, m = len(free), len(a)
        system = np.zeros((k + m, k + m))
        system[:k, :k] = q[np.ix_(free, free)]
        system[:k, k:], system[k:, :k] = a[:, free].T, a[:, free]
        solution = np.linalg.lstsq(system, np.concatenate([-gradient[free], np.zeros(m)]), rcond=None)[0]
        step[free], multipliers = solution[:k], solution[k:]
        if np.abs(step).max(initial=0) < 1e-11:
            if not k:
                multipliers = np.linalg.lstsq(a.T, -gradient, rcond=None)[0]
            reduced = gradient + a.T @ multipliers
            wrong = np.where(fixed == -1, -reduced, np.where(fixed == 1, reduced, -np.inf))
            worst = int(np.argmax(wrong))
            if wrong[worst] <= 1e-9:
                break
            fixed[worst] = 0
            continue
        room = np.full(n, np.inf)
        down, up = step < -1e-15, step > 1e-15
        room[down], room[up] = (low - w[down]) / step[down], (high - w[up]) / step[up]
        hit = int(np.argmin(room))
        length = min(1.0, max(0.0, room[hit]))
        w = w + length * step
        if room[hit] < 1:
            fixed[hit] = -1 if step[hit] < 0 else 1
            w[hit] = low if step[hit] < 0 else high
    return w


def best_first(mu: np.ndarray, low: float, high: float) -> np.ndarray:
    """Weights with the greatest return: the best assets are filled first."""
    w = np.full(len(mu), low)
    for i in np.argsort(-mu, kind="stable"):
        w[i] += min(high - w[i], 1 - w.sum())
    return w


def _feasible(mu: np.ndarray, target: float | None, low: float, high: float) -> np.ndarray:
    n = len(mu)
    even = np.full(n, 1 / n)
    if target is None:
        return even
    top, bottom = best_first(mu, low, high), best_first(-mu, low, high)
    end = top if target >= even @ mu else bottom
    span = (end - even) @ mu
    return even + (end - even) * (0 if abs(span) < 1e-15 else np.clip((target - even @ mu) / span, 0, 1))


def minimum_variance(mu, cov, low=0.0, high=1.0, target: float | None = None) -> np.ndarray:
    n = len(mu)
    a = np.ones((1, n)) if target is None else np.vstack([np.ones(n), mu])
    b = np.array([1.0] if target is None else [1.0, target])
    return solve_qp(cov, np.zeros(n), a, b, low, high, _feasible(mu, target, low, high))


def mean_variance(mu, cov, aversion: float, low=0.0, high=1.0) -> np.ndarray:
    require(aversion > 0, "risk aversion must be positive")
    return solve_qp(aversion * cov, -mu, np.ones((1, len(mu))), np.array([1.0]), low, high, np.full(len(mu), 1 / len(mu)))


def maximum_sharpe(mu, cov, rate: float, low=0.0, high=1.0) -> np.ndarray:
    """The best ratio along the frontier: a grid of targets, then golden sections around the best."""
    bottom, top = float(minimum_variance(mu, cov, low, high) @ mu), float(best_first(mu, low, high) @ mu)

    def ratio(target: float) -> float:
        w = minimum_variance(mu, cov, low, high, target)
        return float((w @ mu - rate) / np.sqrt(max(w @ cov @ w, 1e-16)))

    grid = np.linspace(bottom, top, 41)
    k = int(np.argmax([ratio(t) for t in grid]))
    a, b = grid[max(0, k - 1)], grid[min(40, k + 1)]
    g = (5**0.5 - 1) / 2
    for _ in range(40):
        x, y = b - g * (b - a), a + g * (b - a)
        a, b = (a, y) if ratio(x) >= ratio(y) else (x, b)
    return minimum_variance(mu, cov, low, high, (a + b) / 2)


def shrunk(s: np.ndarray, s2: np.ndarray, t: int) -> tuple[np.ndarray, float]:
    """The shrinkage estimate of Ledoit and Wolf towards a multiple of the identity, and its intensity.

    ``s`` is the population covariance of t observations, ``s2`` the mean of
    the squared products of deviations.
    """
    n = len(s)
    mu = np.trace(s) / n
    delta = ((s - mu * np.eye(n)) ** 2).sum() / n
    beta = min(delta, (s2 - s**2).sum() / (n * t))
    share = 0.0 if delta == 0 else beta / delta
    return (1 - share) * s + share * mu * np.eye(n), float(share)


def ill_conditioned(cov: np.ndarray) -> bool:
    e = np.linalg.eigvalsh(cov)
    return bool(e.min() <= 1e-12 or e.max() / max(e.min(), 1e-300) > 1e8)


def _inputs(pdf: pd.DataFrame, periods: int) -> tuple[list[str], np.ndarray, np.ndarray, float]:
    """Assets, annual means and covariances, and how far these are shrunk: only where the matrix is ill-conditioned."""
    names = sorted(pdf["series_a"].unique())
    require(len(names) <= MOST_ASSETS, f"a portfolio holds at most {MOST_ASSETS} assets")
    at = {s: i for i, s in enumerate(names)}
    mu, (s, s2) = np.zeros(len(names)), np.zeros((2, len(names), len(names)))
    for a, b, m, x, y in zip(pdf["series_a"], pdf["series_b"], pdf["mu"], pdf["s"], pdf["s2"], strict=True):
        mu[at[a]], s[at[a], at[b]], s2[at[a], at[b]] = m, x, y
    t = int(pdf["t"].iloc[0])
    cov, share = s * t / max(1, t - 1) * periods, 0.0
    if ill_conditioned(cov):
        cov, share = shrunk(s, s2, t)
        cov = cov * periods
    check_covariance(cov)
    return names, mu, cov, share


def _tasks(single: DataFrame, moments: DataFrame, portfolio: DataFrame, kinds: list, name: str, kind: str) -> DataFrame:
    """The moments of each portfolio's assets, once for each of ``kinds``: a row of work for each portfolio and kind."""
    own = portfolio.select("portfolio_id", "series_id").distinct()
    pairs = own.withColumnRenamed("series_id", "series_a").join(moments, "series_a").join(own.withColumnRenamed("series_id", "series_b"), ["portfolio_id", "series_b"])
    means = single.select(F.col("series_id").alias("series_a"), "mu")
    return pairs.join(means, "series_a").withColumn(name, F.explode(F.array(*(F.lit(k).cast(kind) for k in kinds))))


OBJECTIVES = ("mean_variance", "minimum_variance", "maximum_sharpe", "equal", "current")


def optimise(single: DataFrame, moments: DataFrame, portfolio: DataFrame, aversion: float = 4.0, low: float = 0.0, high: float = 1.0, conventions: Conventions = Conventions()) -> DataFrame:
    """(portfolio_id, objective, series_id, weight, expected_return, volatility, sharpe, shrinkage) of each portfolio's assets.

    Three objectives, equal weights and the portfolio's own, each solved in a
    call of its own; ``moments`` are those of ``portfolio.pair_moments``.
    """
    rate, periods = conventions.risk_free, conventions.periods

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names, mu, cov, share = _inputs(pdf, periods)
        check_bounds(len(names), low, high)
        objective, own = pdf["objective"].iloc[0], dict(zip(pdf["series_a"], pdf["own"], strict=True))
        solve = {
            "mean_variance": lambda: mean_variance(mu, cov, aversion, low, high),
            "minimum_variance": lambda: minimum_variance(mu, cov, low, high),
            "maximum_sharpe": lambda: maximum_sharpe(mu, cov, rate, low, high),
            "equal": lambda: np.full(len(mu), 1 / len(mu)),
            "current": lambda: np.array([own[s] for s in names]),
        }
        w = solve[objective]()
        w = np.where(w < 1e-6, 0.0, w)
        w = w / w.sum()
        ret, vol = float(w @ mu), float(np.sqrt(max(w @ cov @ w, 0)))
        rows = [(pdf["portfolio_id"].iloc[0], objective, s, float(x), ret, vol, (ret - rate) / vol if vol > 0 else None, share) for s, x in zip(names, w, strict=True)]
        return pd.DataFrame(rows, columns=["portfolio_id", "objective", "series_id", "weight", "expected_return", "volatility", "sharpe", "shrinkage"])

    weights = portfolio.select("portfolio_id", F.col("series_id").alias("series_a"), F.col("weight").alias("own"))
    tasks = _tasks(single, moments, portfolio, list(OBJECTIVES), "objective", "string").join(weights, ["portfolio_id", "series_a"])
    return tasks.groupBy("portfolio_id", "objective").applyInPandas(run, "portfolio_id string, objective string, series_id string, weight double, expected_return double, volatility double, sharpe double, shrinkage double")


def efficient_frontier(single: DataFrame, moments: DataFrame, portfolio: DataFrame, points: int = 25, low: float = 0.0, high: float = 1.0, conventions: Conventions = Conventions()) -> DataFrame:
    """(portfolio_id, point, expected_return, volatility, sharpe, weights) from the least variance to the greatest return, a call for each point."""
    rate, periods = conventions.risk_free, conventions.periods

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names, mu, cov, _ = _inputs(pdf, periods)
        check_bounds(len(names), low, high)
        bottom, top = float(minimum_variance(mu, cov, low, high) @ mu), float(best_first(mu, low, high) @ mu)
        i = int(pdf["point"].iloc[0])
        w = minimum_variance(mu, cov, low, high, float(np.linspace(bottom, top, points)[i]))
        vol = float(np.sqrt(max(w @ cov @ w, 0)))
        return pd.DataFrame([(pdf["portfolio_id"].iloc[0], i, float(w @ mu), vol, (float(w @ mu) - rate) / vol if vol > 0 else None, [round(float(x), 6) for x in w])], columns=["portfolio_id", "point", "expected_return", "volatility", "sharpe", "weights"])

    tasks = _tasks(single, moments, portfolio, list(range(points)), "point", "int")
    return tasks.groupBy("portfolio_id", "point").applyInPandas(run, "portfolio_id string, point int, expected_return double, volatility double, sharpe double, weights array<double>")
