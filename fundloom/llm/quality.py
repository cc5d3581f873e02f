"""A quality classifier: ordinal cumulative-link regression on graded ratings.

Texts become sparse vectors of hashed features: words, shapes of words, and
bands of a text's own statistics. One weight vector is shared by all grades;
ordered thresholds cut its sum into grades, P(grade > k) = logistic(s - t_k).
The expected grade and the probability of reaching a cut grade serve selection.

The regression is fitted on at most ``sample`` labelled documents and at most
``SAMPLE_FEATURES`` features of them, those with the smallest hash of their id;
every document is scored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fundloom.llm.shared import Scratch, held_out, rows_of

#: Labelled documents used for learning, at most.
SAMPLE = 20_000
#: Features of these documents, at most: 8 bytes each, so the driver receives 64 MB.
SAMPLE_FEATURES = 8_000_000
#: Weights of hashed features.
BUCKETS = 1 << 16
#: Words kept with their features in a worker, at most.
MOST_WORDS = 400_000
LETTERS = re.compile(r"[^\W\d_]+")
DIGITS = re.compile(r"\d+")

_known: dict[str, tuple[int, int]] = {}


def _bucket(feature: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(feature.encode("utf-8", "replace")) % BUCKETS


def _shape(word: str) -> str:
    """A for capitals, a for other letters, 0 for digits; runs are one sign, other signs stay."""
    return DIGITS.sub("0", LETTERS.sub(lambda m: "A" if len(m[0]) > 1 and m[0].isupper() else "a", word))


def _features_of_word(word: str) -> tuple[int, int]:
    found = _known.get(word)
    if found is None:
        if len(_known) >= MOST_WORDS:
            _known.clear()
        found = _known[word] = (_bucket("w:" + word.lower().strip(".,;:!?")), _bucket("s:" + _shape(word)))
    return found


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets in ascending order, and values: a root of each feature's share for words and shapes, one for bands."""
    words = (text or "").split()
    n = len(words)
    shares: Counter = Counter()
    for word, c in Counter(words).items():
        a, b = _features_of_word(word)
        shares[a] += c
        shares[b] += c
    if shares:
        at = np.fromiter(shares.keys(), np.int64, len(shares))
        value = np.sqrt(np.fromiter(shares.values(), np.float64, len(shares)) / n)
    else:
        at, value = np.zeros(0, np.int64), np.zeros(0)
    lines = (text or "").split("\n")
    bands = [
        f"n:{int(math.log2(n + 1))}",
        f"l:{int(sum(map(len, words)) / n) if n else 0}",
        f"u:{int(10 * len(set(words)) / n) if n else 0}",
        f"r:{int(10 * len(set(lines)) / len(lines))}",
    ]
    at = np.concatenate([at, [_bucket(b) for b in bands]])
    value = np.concatenate([value, np.full(len(bands), 0.3)])
    unique, where = np.unique(at, return_inverse=True)
    return unique.astype(np.int32), np.bincount(where, value, len(unique)).astype(np.float32)


@dataclass(frozen=True)
class Model:
    """Grades in ascending order, a threshold between each two, and the weights of the buckets."""

    grades: tuple[int, ...]
    thresholds: tuple[float, ...]
    weights: np.ndarray


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def tails(model: Model, score: np.ndarray) -> np.ndarray:
    """P(grade is at least the k-th), a column for each grade; the first is 1."""
    out = np.ones((len(score), len(model.grades)))
    for k, t in enumerate(model.thresholds):
        out[:, k + 1] = _logistic(score - t)
    return out


def thresholds_of(x: np.ndarray) -> np.ndarray:
    """Ordered thresholds from a first one and the logarithms of the steps to the next."""
    first = x[BUCKETS : BUCKETS + 1]
    return np.concatenate([first, first + np.cumsum(np.exp(x[BUCKETS + 1 :]))])


def loss_and_gradient(x: np.ndarray, rows: np.ndarray, at: np.ndarray, value: np.ndarray, y: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """The mean negative log likelihood of grade numbers ``y`` with a ridge on the weights, and its gradient.

    ``rows, at, value`` are the sparse matrix; ``x`` are the weights, then the thresholds' parameters.
    """
    n, cuts = len(y), len(x) - BUCKETS
    w = x[:BUCKETS]
    s = np.bincount(rows, value * w[at], n)
    above = _logistic(s[:, None] - thresholds_of(x))  # P(y > k)
    padded = np.column_stack([np.ones(n), above, np.zeros(n)])
    here = np.arange(n)
    p = np.maximum(padded[here, y] - padded[here, y + 1], 1e-9)
    slope = padded * (1 - padded)
    upper, lower = slope[here, y] / p, slope[here, y + 1] / p
    by_row = (lower - upper) / n  # derivative by a row's sum
    by_cut = np.array([(upper[y == k + 1].sum() - lower[y == k].sum()) / n for k in range(cuts)])
    g = np.empty_like(x)
    g[:BUCKETS] = ridge * w + np.bincount(at, value * by_row[rows], BUCKETS)
    g[BUCKETS] = by_cut.sum()
    g[BUCKETS + 1 :] = np.cumsum(by_cut[::-1])[::-1][1:] * np.exp(x[BUCKETS + 1 :])
    return float(-np.log(p).mean() + ridge / 2 * (w @ w)), g


def fit(rows: np.ndarray, at: np.ndarray, value: np.ndarray, grade: np.ndarray, ridge: float = 1e-4, rounds: int = 250, rate: float = 0.05) -> Model:
    """Maximum likelihood with a ridge, by Adam over the whole sample."""
    grades, y = np.unique(grade, return_inverse=True)
    share = [(y > k).mean() for k in range(len(grades) - 1)]
    start = np.array([-math.log(p / (1 - p)) for p in share])
    x = np.concatenate([np.zeros(BUCKETS), start[:1], np.log(np.maximum(np.diff(start), 1e-3))])
    m, v = np.zeros_like(x), np.zeros_like(x)
    for r in range(1, rounds + 1):
        _, g = loss_and_gradient(x, rows, at, value, y, ridge)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x = x - rate * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.999**r)) + 1e-8)
    return Model(tuple(int(g) for g in grades), tuple(float(t) for t in thresholds_of(x)), x[:BUCKETS].astype(np.float32))


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
    for batch in batches:
        made = []
        for doc_id, grade, text in rows_of([batch], "doc_id", "grade", "text"):
            at, value = features(text)
            made.append((doc_id, grade, len(at), at.tobytes(), value.tobytes()))
        columns = zip(*made, strict=True) if made else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "grade", "n", "at", "value"])


def train(docs: DataFrame, ratings: DataFrame, sample: int = SAMPLE, most_features: int = SAMPLE_FEATURES) -> Model:
    """Fit the regression to ``ratings(doc_id, grade)`` of rows that aren't held out.

    The ratings chosen are at most ``sample`` rows, so they are sent to each
    task and the documents aren't shuffled. Their documents' vectors are
    written to the shared folder; in the order of a hash they are taken up to
    ``sample`` rows (ids may repeat) and ``most_features`` features, so what
    the driver receives is bounded. Ratings without a document are left out;
    a null text counts as empty. With fewer than two grades the model always
    gives the one there is (0 without any).
    """
    chosen = ratings.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("grade").cast("int").alias("grade")).where("doc_id IS NOT NULL AND grade IS NOT NULL")
    rows = chosen.where(~held_out(F.col("doc_id"))).distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "grade").limit(sample).collect()
    spark = docs.sparkSession
    picked = F.broadcast(spark.createDataFrame(rows, "doc_id long, grade int"))
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with Scratch(spark, "quality") as scratch:
        made = plain.join(picked, "doc_id").mapInArrow(_vectors, "doc_id long, grade int, n long, at binary, value binary")
        key = F.struct(F.xxhash64("doc_id").alias("a"), F.col("doc_id").alias("b"), F.col("grade").alias("c"), F.xxhash64("at", "value").alias("d"))
        vectors = scratch.table(made.withColumn("key", key), "vectors")
        last, total = None, 0
        for r in vectors.select("key", "n").orderBy("key").limit(sample).collect():
            total += r["n"]
            if total > most_features and last is not None:
                break
            last = tuple(r["key"])
        if last is None:
            return Model((0,), (), np.zeros(BUCKETS, np.float32))
        within = F.col("key") <= F.struct(*(F.lit(v).cast(t).alias(n) for n, v, t in zip("abcd", last, ("long", "long", "int", "long"), strict=True)))
        # Equal rows share a key; together they may pass the bound, so the rows themselves are limited too.
        got = vectors.where(within).orderBy("key").limit(sample).drop("key").collect()
    grade = np.array([r["grade"] for r in got], np.int64)
    if len(set(grade.tolist())) < 2:
        return Model((int(grade[0]),), (), np.zeros(BUCKETS, np.float32))
    at = [np.frombuffer(r["at"], "<i4") for r in got]
    value = np.concatenate([np.frombuffer(r["value"], "<f4") for r in got]).astype(np.float64)
    return fit(np.repeat(np.arange(len(got)), [len(a) for a in at]), np.concatenate(at), value, grade)


def rate(model: Model, text: Column, cut: int, spark) -> Column:
    """A struct (expected_grade, tail_probability) of ``text``: the mean grade, and P(grade >= cut)."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("expected_grade double, tail_probability double")
    def run(texts: pd.Series) -> pd.DataFrame:
        own = shared.value
        score = np.zeros(len(texts))
        for i, t in enumerate(texts):
            at, value = features(t)
            score[i] = float(own.weights[at] @ value)
        reach = tails(own, score)
        grades = np.array(own.grades, float)
        mean = grades[0] + reach[:, 1:] @ np.diff(grades)
        over = [k for k, g in enumerate(own.grades) if g >= cut]
        return pd.DataFrame({"expected_grade": mean, "tail_probability": reach[:, over[0]] if over else np.zeros(len(texts))})

    return run(text.cast("string"))


def quality(docs: DataFrame, ratings: DataFrame, cut: int = 1, keep: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """Per document: doc_id, held_out, expected_grade, tail_probability, selected.

    ``selected`` is tail_probability >= keep, the probability of grade ``cut``
    or more. Null and empty texts are rated by the bands of an empty text.
    Null doc_ids aren't held out; repeated rows are rated one by one; an empty
    table gives no rows; other columns never enter.
    """
    model = train(docs, ratings, sample)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rated = plain.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), rate(model, F.col("text"), cut, docs.sparkSession).alias("r"))
    return rated.select("doc_id", "held_out", F.col("r.expected_grade").alias("expected_grade"), F.col("r.tail_probability").alias("tail_probability"), (F.col("r.tail_probability") >= keep).alias("selected"))
