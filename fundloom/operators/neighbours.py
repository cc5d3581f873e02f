"""Approximate nearest neighbours: inverted lists of centroids, fitted on a bounded sample, holding every row.

Centroids come from a k-means of at most ``SAMPLE`` unit vectors; that is the
only bound. How many lists a question looks into is measured on the sample: the
fewest that find ``target`` of the ten nearest of its rows. The whole table is
denser than its sample, so neighbours are nearer there and rather found.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fundloom.operators.retrieval import VECTOR_CHUNK, _nearest, ranked

#: Rows that centroids are fitted on, lists, questions for the measurement, and rounds of k-means.
SAMPLE, MOST_LISTS, MEASURED, ROUNDS = 20_000, 4096, 500, 12
NEAREST = 10


@dataclass(frozen=True)
class Lists:
    """Centroids as unit vectors, lists that a question looks into, and the share of neighbours found on the sample."""

    centroids: np.ndarray
    probes: int
    recall: float


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _sound(rows: DataFrame) -> DataFrame:
    """Rows with a vector that has a direction."""
    return rows.where("embedding IS NOT NULL AND size(filter(embedding, x -> x IS NULL OR isnan(x))) = 0 AND exists(embedding, x -> x <> 0)")


def kmeans(x: np.ndarray, k: int, seed: int = 42) -> np.ndarray:
    """Centroids of unit vectors by cosine; a centroid that loses all its rows takes the row that is worst off."""
    centroids = x[np.random.default_rng(seed).choice(len(x), k, replace=False)]
    for _ in range(ROUNDS):
        sims = x @ centroids.T
        own = sims.argmax(axis=1)
        total = np.zeros_like(centroids)
        np.add.at(total, own, x)
        lost = np.flatnonzero(np.bincount(own, minlength=k) == 0)
        total[lost] = x[np.argsort(sims.max(axis=1))[: len(lost)]]
        centroids = _unit(total)
    return centroids


def fit(vectors: DataFrame, lists: int | None = None, target: float = 0.95, sample: int = SAMPLE) -> Lists:
    """Lists for ``vectors(vec_id, embedding)``: about the root of the number of rows, 4096 at most.

    The sample are the rows with the least hash of their id, ``sample`` at
    most. Raises ValueError where no row has a direction.
    """
    sound = _sound(vectors)
    n = sound.count()
    if not n:
        raise ValueError("no vector has a direction")
    share = min(1.0, 1.2 * sample / n)
    drawn = sound.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    rows = drawn.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select(F.col("embedding").cast("array<double>").alias("e")).toArrow().column("e")
    x = _unit(np.array(rows.to_pylist(), float))
    k = min(lists or max(1, round(n**0.5)), MOST_LISTS, len(x))
    centroids = kmeans(x, k)
    own = (x @ centroids.T).argmax(axis=1)
    asked = x[:: max(1, len(x) // MEASURED)][:MEASURED]
    sims = asked @ x.T
    near = np.argsort(-sims, axis=1)[:, : min(NEAREST, len(x))]
    place = np.argsort(np.argsort(-(asked @ centroids.T), axis=1), axis=1)
    found = np.sort(np.take_along_axis(place, own[near], axis=1).ravel())
    probes = int(found[min(len(found) - 1, int(np.ceil(target * len(found))) - 1)]) + 1
    return Lists(centroids, probes, float((found < probes).mean()))


def _placed(lists: Lists, probes: int, key: str):
    """Over (key, embedding): a row for each of the ``probes`` lists whose centroids are nearest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 4096):
                part = batch.slice(at, 4096)
                x = _unit(np.array(part.column("embedding").to_pylist(), float))
                sims = x @ lists.centroids.T
                near = np.argpartition(-sims, probes - 1, axis=1)[:, :probes] if probes < sims.shape[1] else np.tile(np.arange(sims.shape[1]), (len(x), 1))
                rows = pa.array(np.repeat(np.arange(len(part)), near.shape[1]))
                yield pa.RecordBatch.from_arrays([pa.array(near.ravel().astype(np.int64)), part.column(key).take(rows), part.column("embedding").take(rows)], names=["list", key, "embedding"])

    return run


def indexed(vectors: DataFrame, lists: Lists) -> DataFrame:
    """(list, vec_id, embedding): every row with a direction in the list of its nearest centroid."""
    rows = _sound(vectors).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.mapInArrow(_placed(lists, 1, "vec_id"), "list long, vec_id long, embedding array<double>")


def approximate_search(queries: DataFrame, index: DataFrame, lists: Lists, most: int = 30, probes: int | None = None, chunk: int = VECTOR_CHUNK) -> DataFrame:
    """(query_id, passage_id, similarity, vector_rank): nearest rows of the lists that each of ``queries(vec_id, embedding)`` looks into.

    A question meets its lists only. Lists are compared in chunks, so that a
    list with very many rows is the work of many tasks.
    """
    asked = _sound(queries).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    asked = asked.mapInArrow(_placed(lists, min(probes or lists.probes, len(lists.centroids)), "vec_id"), "list long, vec_id long, embedding array<double>")
    parts = index.groupBy("list").agg(F.ceil(F.count("*") / chunk).alias("parts"))
    left = index.join(parts, "list").select("list", F.pmod(F.xxhash64("vec_id"), "parts").alias("part"), "vec_id", "embedding")
    right = asked.join(parts, "list").select(F.col("list").alias("of"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("p"), F.col("vec_id").alias("query"), F.col("embedding").alias("asked"))
    out = left.groupBy("list", "part").cogroup(right.groupBy("of", "p")).applyInArrow(_nearest(most), "query_id long, passage_id long, similarity double")
    return ranked(out.withColumn("similarity", F.round("similarity", 6)), "similarity", "vector_rank", most)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of ``exact(query_id, passage_id)`` that ``found`` has."""
    hit = exact.join(found.select("query_id", "passage_id").withColumn("hit", F.lit(1)), ["query_id", "passage_id"], "left")
    return hit.agg(F.count("hit") / F.count("*")).first()[0]
