"""Numeric conventions that all operators share, and the bounds of their parameters."""

from __future__ import annotations

from dataclasses import dataclass
from statistics import NormalDist

#: Observations that a statistic needs, at least.
LEAST_FOR_VOLATILITY = 30
LEAST_FOR_BETA = 60
LEAST_FOR_ANOMALIES = 200
LEAST_FOR_FEATURES = 282
#: Period labels and their months (None: the whole history).
PERIODS = {"1m": 1, "3m": 3, "6m": 6, "1y": 12, "3y": 36, "5y": 60, "max": None}
COVERAGE_TOLERANCE_DAYS = 5
STALE_AFTER_DAYS = 7


@dataclass(frozen=True)
class Conventions:
    """Periods of a year, the annual risk-free rate and the confidence of value at risk."""

    periods: int = 252
    risk_free: float = 0.065
    confidence: float = 0.95

    def __post_init__(self) -> None:
        require(self.periods > 0, "periods must be positive")
        require(0 <= self.risk_free <= 0.2, "the risk-free rate must lie between 0 and 0.2")
        require(0.5 < self.confidence < 1, "the confidence must lie between 0.5 and 1")

    @property
    def period_rate(self) -> float:
        """The risk-free rate of one period, compounded."""
        return (1 + self.risk_free) ** (1 / self.periods) - 1

    @property
    def quantile(self) -> float:
        """The standard normal quantile of the lower tail."""
        return NormalDist().inv_cdf(1 - self.confidence)

    @property
    def tail_density(self) -> float:
        """The normal density at the quantile, over the tail's probability."""
        return NormalDist().pdf(self.quantile) / (1 - self.confidence)


def require(good: bool, message: str) -> None:
    if not good:
        raise ValueError(message)
