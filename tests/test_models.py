"""Trees as nodes, Shapley values against all subsets, and the registry."""

import itertools
import math
import threading

import numpy as np
import pytest

from fundloom.operators import learning, models
from fundloom.sources.adapters import levels

SF = "/root/testdata/sf0.01"


def fitted(seed=1, n=120, features=4, depth=4, trees=7):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, features)).round(1)
    y = x[:, 0] * x[:, 1] + np.sin(3 * x[:, 2]) + 0.1 * rng.normal(size=n)
    return x, y, learning.forest_nodes(x, y, depth, trees)


def test_nodes_predict_as_the_trees_do():
    x, y, nodes = fitted()
    at = np.random.default_rng(2).normal(size=(50, 4)).round(1)
    assert learning.forest_predictions(nodes, at) == pytest.approx(learning.forest_candidates(x, y, at, (4.0,), 7)[0])


def conditional(nodes, k, row, known):
    """A tree's value where only ``known`` features are known: other splits are averaged by the weights of their rows."""
    _, f, cut, low, high, value, cover = nodes[k]
    if f < 0:
        return value
    if f in known:
        return conditional(nodes, low if row[f] <= cut else high, row, known)
    return sum(nodes[c][6] / cover * conditional(nodes, c, row, known) for c in (low, high))


def test_shapley_values_against_all_subsets():
    _, _, nodes = fitted()
    at = np.random.default_rng(3).normal(size=(5, 4))
    roots = [k for k in range(len(nodes)) if k == 0 or nodes[k][0] != nodes[k - 1][0]]
    got, base = learning.forest_attributions(nodes, at)
    value = lambda row, known: sum(conditional(nodes, r, row, known) for r in roots) / len(roots)
    for row, parts in zip(at, got, strict=True):
        for f in range(4):
            rest = [g for g in range(4) if g != f]
            want = sum(math.factorial(len(s)) * math.factorial(3 - len(s)) / 24 * (value(row, {*s, f}) - value(row, set(s))) for n in range(4) for s in itertools.combinations(rest, n))
            assert parts[f] == pytest.approx(want, abs=1e-12)
        assert base == pytest.approx(value(row, set()))
        assert base + parts.sum() == pytest.approx(value(row, {0, 1, 2, 3}))


@pytest.mark.parametrize("kind", ["ridge", "random_forest"])
def test_stored_models_forecast_as_fresh_ones(spark, tmp_path, monkeypatch, kind):
    if kind == "random_forest":
        monkeypatch.setitem(models.KINDS, kind, (learning.forest_candidates, (3.0,)))
    rows = levels(spark, SF).where("series_id IN ('AUTOMOBILE', 'BUILDING')").cache()
    registry = f"file://{tmp_path}/registry"
    first = {(r.series_id, r.horizon): r for r in models.stored_forecasts(rows, registry, kind, (21,)).collect()}
    assert len(first) == 2
    monkeypatch.setattr(models, "train", lambda *_: pytest.fail("trained again"))
    again = {(r.series_id, r.horizon): r for r in models.stored_forecasts(rows, registry, kind, (21,)).collect()}
    assert again == first
    parameters = (3.0,) if kind == "random_forest" else models.KINDS[kind][1]
    fresh = learning.selected_forecasts(rows, models.KINDS[kind][0], parameters, (21,)).where("part = 'latest'").collect()
    for r in fresh:
        got = first[r.series_id, r.horizon]
        assert (got.predicted, got.low, got.high) == pytest.approx((r.predicted, r.low, r.high))
        assert got.base + sum(got.attributions) == pytest.approx(got.predicted)
        assert len(got.importance) == len(learning.FEATURES) and min(got.importance) >= 0


def test_two_writers_leave_one_batch(spark, tmp_path):
    rows = levels(spark, SF).where("series_id = 'BUILDING'").cache()
    registry = f"file://{tmp_path}/registry"
    asked = models.fingerprints(rows, "ridge", (5,))
    made = models.train(rows, asked, "ridge").cache()
    results = []
    writers = [threading.Thread(target=lambda: results.append(models.publish(made, asked, registry))) for _ in range(2)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert sorted(results) == [False, True]
    assert len(list((tmp_path / "registry").iterdir())) == 1
    assert models.published(spark, registry).count() == 1
    # A model that has lost its artifact is trained again under another batch or the same name, and forecasts go on.
    made.withColumn("slope", made["slope"].cast("array<double>")).where("false").write.parquet(f"{registry}/none")
    assert models.published(spark, registry).count() == 1


def test_lost_artifacts_are_trained_again(spark, tmp_path):
    rows = levels(spark, SF).where("series_id IN ('BUILDING', 'MACHINERY')").cache()
    registry = f"file://{tmp_path}/registry"
    whole = models.fingerprints(rows, "ridge", (5,))
    part = whole.where("series_id = 'BUILDING'")
    assert models.publish(models.train(rows, part, "ridge"), part, registry)
    assert models.stored_forecasts(rows, registry, "ridge", (5,)).count() == 2
    assert models.published(spark, registry).count() == 2
    lost = next(d for d in (tmp_path / "registry").iterdir())
    lost.rename(tmp_path / "gone")
    assert models.stored_forecasts(rows, registry, "ridge", (5,)).count() == 2
