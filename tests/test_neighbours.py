"""The approximate index: every row is in a list, and most of the nearest are found."""

import numpy as np
import pytest

from fundloom.operators import neighbours, retrieval


def test_recall_on_the_given_vectors(spark):
    v = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    lists = neighbours.fit(v)
    index = neighbours.indexed(v, lists).cache()
    assert index.count() == v.count()
    queries = v.where("vec_id % 100 = 0")
    exact = retrieval.vector_search(queries, v, most=10)
    found = neighbours.approximate_search(queries, index, lists, most=10)
    assert neighbours.recall(found, exact) >= 0.9
    assert lists.probes < len(lists.centroids)
    # All lists together are the exact search.
    whole = neighbours.approximate_search(queries, index, lists, most=10, probes=len(lists.centroids), chunk=7)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, exact.collect()))


def test_clusters_need_few_lists(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 32))
    x = np.repeat(centres, 60, axis=0) + 0.2 * rng.normal(size=(2400, 32))
    v = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    lists = neighbours.fit(v, sample=800)
    assert lists.probes <= 8
    queries = v.where("vec_id % 100 = 0")
    found = neighbours.approximate_search(queries, neighbours.indexed(v, lists), lists, most=10)
    assert neighbours.recall(found, retrieval.vector_search(queries, v, most=10)) >= 0.9


def test_odd_rows(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0, 0.0]), (5, [0.5, None])], "vec_id long, embedding array<double>")
    lists = neighbours.fit(v)
    assert sorted(r.vec_id for r in neighbours.indexed(v, lists).collect()) == [1, 4]
    assert {r.passage_id for r in neighbours.approximate_search(v, neighbours.indexed(v, lists), lists, most=5).collect()} == {1, 4}
    with pytest.raises(ValueError, match="direction"):
        neighbours.fit(v.where("vec_id = 2"))
