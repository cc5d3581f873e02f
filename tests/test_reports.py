"""Whole reports on small series: hand-made periods, benchmarks of their own period, and portfolios by a plain loop."""

from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from fundloom.operators import learning, reports
from fundloom.sources import sinks

DAYS = [date(2020, 1, 1) + timedelta(i) for i in range(500)]


def today():
    return F.lit("2021-06-01").cast("date")


@pytest.fixture(scope="module")
def made(spark):
    draw = np.random.default_rng(7)
    steps = {s: 100 * np.cumprod(1 + draw.normal(0.0005, 0.01, len(DAYS))) for s in ("a", "b", "m")}
    rows = [(s, d, float(v)) for s in ("a", "b") for d, v in zip(DAYS, steps[s]) if s == "a" or d.day != 13]
    values = [("x", d, float(v)) for d, v in zip(DAYS, steps["m"])]
    levels = spark.createDataFrame(rows, "series_id string, obs_date date, level double")
    return steps, levels, spark.createDataFrame([("a", "x")], "series_id string, benchmark_id string"), spark.createDataFrame(values, "benchmark_id string, obs_date date, value double")


def test_fund_report_is_over_the_period_and_its_benchmark_too(made):
    steps, levels, benchmarks, values = made
    rows = {r.series_id: r for r in reports.fund_reports(levels, benchmarks, values, today(), "6m").collect()}
    a, b = rows["a"], rows["b"]
    inside = np.array([d >= date(2020, 11, 14) for d in DAYS])
    assert a.period_start == date(2020, 11, 14) and a.period_end == date(2021, 5, 14) and a.covered and a.age_days == 18 and a.stale
    x, m = steps["a"][inside], steps["m"][inside]
    r, q = x[1:] / x[:-1] - 1, m[1:] / m[:-1] - 1
    assert a.beta_observations == len(r) and a.observations == len(r)
    assert a.beta == pytest.approx(np.cov(r, q)[0, 1] / np.var(q, ddof=1))
    assert a.volatility == pytest.approx(r.std(ddof=1) * 252**0.5)
    assert b.benchmark_id is None and b.beta is None and b.unavailable == "beta,alpha_annual,correlation,tracking_error,information_ratio"


def test_short_histories_are_told(made):
    _, levels, benchmarks, values = made
    rows = reports.fund_reports(levels.where(F.col("obs_date") >= "2021-05-14"), benchmarks, values, today(), "3y")
    assert rows.count() == 0
    row = reports.fund_reports(levels.where(F.col("obs_date") >= "2021-05-01"), benchmarks, values, today(), "3y").where("series_id = 'a'").collect()[0]
    assert not row.covered and row.volatility is None and row.cumulative_return is not None and "volatility" in row.unavailable


def test_portfolio_report_equals_a_loop(spark, made):
    steps, levels, benchmarks, values = made
    portfolio = spark.createDataFrame([("p", "a", 3.0), ("p", "b", 1.0), ("q", "a", 1.0)], "portfolio_id string, series_id string, weight double")
    rows = {r.portfolio_id: r for r in reports.portfolio_reports(levels, portfolio, benchmarks, values, today(), "max").collect()}
    keep = np.array([d.day != 13 for d in DAYS])
    prices, w = np.stack([steps["a"][keep], steps["b"][keep]]), np.array([0.75, 0.25])
    value = 100_000 * (w[:, None] * prices / prices[:, :1]).sum(0)
    now = w * prices[:, -1] / prices[:, 0]
    now /= now.sum()
    cov = np.cov(prices[:, 1:] / prices[:, :-1] - 1)
    vol = (w @ cov @ w) ** 0.5
    p = rows["p"]
    assert p.value_end == pytest.approx(value[-1]) and p.cumulative_return == pytest.approx(value[-1] / value[0] - 1)
    assert p.hhi == pytest.approx((now**2).sum()) and p.largest_weight == pytest.approx(now.max())
    assert p.diversification_ratio == pytest.approx(w @ np.sqrt(np.diag(cov)) / vol)
    assert p.benchmark_id == "x" and p.beta is not None and p.dates_aligned == keep.sum() and p.dates_dropped == (~keep).sum()
    assert rows["q"].diversification_ratio == pytest.approx(1) and rows["q"].dates_dropped == 0
    shares = {r.series_id: r.risk_share for r in reports.portfolio_positions(levels, portfolio, "max").where("portfolio_id = 'p'").collect()}
    assert [shares["a"], shares["b"]] == pytest.approx(list(w * (cov @ w) / vol**2))


def test_exported_file(spark, made, tmp_path):
    import csv

    _, levels, _, _ = made
    portfolio = spark.createDataFrame([("p", "a", 3.0), ("p", "b", 1.0)], "portfolio_id string, series_id string, weight double")
    funds = spark.createDataFrame([("a", "F-1", 'A, "one"', True)], "series_id string, scheme_code string, name string, is_synthetic boolean")
    sinks.export_lines(reports.portfolio_export(levels, portfolio, funds), f"file://{tmp_path}/out")
    (path,) = (tmp_path / "out" / "portfolio_id=p").glob("*.txt")
    rows = list(csv.reader(path.open()))
    assert rows[0] == list(reports.EXPORT_COLUMNS) and len(rows) == 5 and rows[3] == []
    assert rows[1][:3] == ["F-1", 'A, "one"', "75.00"] and rows[1][6] == "yes" and rows[2][:3] == ["b", "", "25.00"]
    assert rows[4] == ["# As of 2021-05-14; buy-and-hold from 2020-01-01. Historical analysis only; not investment advice."]


def test_comparison_needs_two_to_five(made):
    _, levels, benchmarks, values = made
    for ids in (("a",), ("a", "a"), tuple("abcdef")):
        with pytest.raises(ValueError):
            reports.comparison(levels, benchmarks, values, ids, today())


def test_readings_of_moves(spark):
    rows = spark.createDataFrame([(-0.05, -0.04), (-0.05, 0.04), (-0.05, -0.019), (0.05, 0.024), (0.0123, None)], "r double, b double")
    said = [r[0] for r in rows.select(learning.move_reading(F.col("r"), F.col("b"))).collect()]
    assert said[0] == "Market-wide move: fund -5.00% while the benchmark moved -4.00%."
    assert [s.split(":")[0] for s in said[1:4]] == ["Fund-specific move"] * 3
    assert said[4] == "Unusual daily move of +1.23% for this fund."
