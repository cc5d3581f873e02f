"""The ordinal regression against plain formulas, numeric gradients, and awkward tables."""

import math

import numpy as np
from pyspark.sql import functions as F

from fundloom.llm import quality


def problem(seed=0, n=30):
    rng = np.random.default_rng(seed)
    rows = np.repeat(np.arange(n), 3)
    at = rng.integers(0, 12, 3 * n)
    value = rng.random(3 * n)
    y = rng.integers(0, 4, n)
    y[:4] = range(4)
    x = np.zeros(quality.BUCKETS + 3)
    x[:12] = rng.normal(size=12)
    x[quality.BUCKETS :] = (-0.5, 0.1, -0.3)
    return x, rows, at, value, y


def plain_loss(x, rows, at, value, y, ridge):
    first = x[quality.BUCKETS]
    t = [first, first + math.exp(x[quality.BUCKETS + 1]), first + math.exp(x[quality.BUCKETS + 1]) + math.exp(x[quality.BUCKETS + 2])]
    total = 0.0
    for i in range(len(y)):
        s = sum(v * x[a] for r, a, v in zip(rows, at, value) if r == i)
        over = [1.0, *(1 / (1 + math.exp(-(s - k))) for k in t), 0.0]
        total -= math.log(over[y[i]] - over[y[i] + 1])
    return total / len(y) + ridge / 2 * sum(v * v for v in x[:12])


def test_likelihood_and_gradient():
    x, rows, at, value, y = problem()
    loss, g = quality.loss_and_gradient(x, rows, at, value, y, 0.01)
    assert abs(loss - plain_loss(x, rows, at, value, y, 0.01)) < 1e-12
    for k in [*range(12), *range(quality.BUCKETS, quality.BUCKETS + 3)]:
        up, down = x.copy(), x.copy()
        up[k] += 1e-5
        down[k] -= 1e-5
        numeric = (quality.loss_and_gradient(up, rows, at, value, y, 0.01)[0] - quality.loss_and_gradient(down, rows, at, value, y, 0.01)[0]) / 2e-5
        assert abs(numeric - g[k]) < 1e-7, k


def test_fit_comes_to_the_minimum_and_keeps_thresholds_ordered():
    x, rows, at, value, y = problem(1, 400)
    s = np.bincount(rows, value * x[at], 400)
    y = np.digitize(s + np.random.default_rng(2).logistic(size=400), [-0.5, 0.5, 1.2])
    model = quality.fit(rows, at, value, y, ridge=1e-2, rounds=1500, rate=0.02)
    assert list(model.thresholds) == sorted(model.thresholds)
    steps = np.log(np.diff(model.thresholds))
    _, g = quality.loss_and_gradient(np.concatenate([model.weights, model.thresholds[:1], steps]), rows, at, value, y, 1e-2)
    assert np.abs(g).max() < 1e-3
    reach = quality.tails(model, np.array([-1.0, 0.0, 2.0]))
    want = [[1.0, *(1 / (1 + math.exp(t - v)) for t in model.thresholds)] for v in (-1.0, 0.0, 2.0)]
    assert np.allclose(reach, want)


def test_sample_is_bounded_in_rows_and_features(spark):
    docs = spark.createDataFrame([(i % 50, " ".join(f"w{i}x{k}" for k in range(40))) for i in range(500)], "doc_id long, text string")
    ratings = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id long, grade int")
    seen = []
    plain = quality.fit
    quality.fit = lambda rows, at, value, grade, **k: (seen.append((len(grade), len(at))), plain(rows, at, value, grade, rounds=2))[1]
    try:
        quality.train(docs, ratings, sample=100)
        quality.train(docs, ratings, most_features=2000)
    finally:
        quality.fit = plain
    assert seen[0][0] == 100 and seen[1][1] <= 2000 and seen[1][0] > 10


def test_nulls_empty_long_and_repeated_texts(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, "word " * 200_000, "c"), (4, "fine text", "d"), (4, "fine text", "e"), (None, "fine text", "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    ratings = spark.createDataFrame([(3, 1), (4, 0), (None, 1), (9, None), (77, 1)], "doc_id long, grade int")
    got = quality.quality(docs, ratings).orderBy("doc_id").collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert len(got) == 6 and by[1][0].expected_grade == by[2][0].expected_grade
    assert by[4][0] == by[4][1] and by[None][0].expected_grade == by[4][0].expected_grade and by[None][0].held_out is False
    assert all(0 <= r.tail_probability <= 1 for r in got)
    assert quality.quality(docs.where("false"), ratings).count() == 0
    assert quality.quality(docs, ratings.select("doc_id", F.lit(2).alias("grade"))).agg(F.min("expected_grade")).first()[0] == 2.0
