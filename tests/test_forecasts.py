"""Models are chosen on validation rows, for each series and horizon, and the isolation forest has its 300 trees."""

import inspect

import numpy as np

from fundloom.operators import learning
from fundloom.plans import learning as plans

SF = "/root/testdata/sf0.01"


def check(rows, parameters):
    assert {r.horizon for r in rows} == {5, 21, 63}
    assert len({(r.series_id, r.horizon) for r in rows}) == len(rows) == 3 * len({r.series_id for r in rows})
    assert all(r.chosen in parameters and 0 <= r.coverage <= 1 and r.validation_mae > 0 and r.mae > 0 for r in rows)


def test_ridge_is_chosen_by_series_and_horizon(spark):
    rows = plans.ridge_fit(spark, SF).collect()
    check(rows, (0.1, 1.0, 10.0, 100.0))


def test_forest_is_chosen_by_series_and_horizon(spark):
    check(plans.forecast_rf(spark, SF).collect(), (3.0, 5.0, 8.0))


def test_candidates():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 3))
    y = np.where(x[:, 0] > 0, 1.0, -1.0) + np.where(x[:, 1] > 0.5, 2.0, 0.0)
    at = np.array([[1.0, 1.0, 0], [1.0, -1.0, 0], [-1.0, 1.0, 0], [-1.0, -1.0, 0]])
    for got in learning.forest_candidates(x, y, at, (3.0, 8.0), trees=20):
        assert np.abs(got - [3, 1, 1, -1]).max() < 0.1
    w = np.array([1.0, -2.0, 0.5])
    little, much = learning.ridge_candidates(x, x @ w + 3, at, (1e-6, 1e9))
    assert np.abs(little - at @ w - 3).max() < 1e-3 and np.abs(much - (x @ w + 3).mean()).max() < 1e-3


def test_isolation_trees():
    assert inspect.signature(learning.isolation_forest).parameters["trees"].default == 300 and "trees=" not in inspect.getsource(plans.isolation_forest)
