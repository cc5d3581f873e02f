"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton.

Texts are folded first: lower case, look-alike letters of other scripts and
full-width forms become Latin letters, digits and signs that stand for letters
become those letters, everything else but letters becomes a space. Patterns are
words or word beginnings; each word counts with the weight of its longest
pattern unless an exception phrase covers it. The weights of a text are
normalised by its length, and a logistic curve turns them into a score.

The lexicon, the exceptions and the curve are learned from labelled documents:
an exception is a word of the lexicon with the word before or after it that
clean documents have at least as often as toxic ones; a caller may add others.
At most ``sample`` labels are used, those with the smallest hash of their id.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fundloom.llm.shared import Scratch, held_out, rows_of

#: Labelled documents used for learning, at most.
SAMPLE = 20_000
#: Lengths of word beginnings that may become patterns, besides whole words.
STEMS = range(4, 9)
#: Toxic documents of the sample that a pattern must be in, at least.
LEAST_TOXIC = 5
#: Log odds of a pattern, at least and at most.
LEAST_WEIGHT, MOST_WEIGHT = 1.5, 6.0
#: Clean documents of the sample that an exception must be in, at least.
LEAST_CLEAN = 5
#: Signs that stand for letters.
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i", "€": "e"}
#: Letters of the Cyrillic and Greek scripts that look like Latin letters.
LOOKALIKES = dict(zip("абвгдеёзикмнорстухіїјѕһԁԛԝαβγεικνορτυχω", "abbrdee3nkmhopctyxiijshdqwabyeiknoptuxw", strict=True))


class _Fold(dict):
    """A table for str.translate that is filled as characters are met."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        plain = unicodedata.normalize("NFKC", c).lower()
        plain = "".join(SIGNS.get(x, LOOKALIKES.get(x, x)) for x in plain)
        plain = "".join(SIGNS.get(x, x) for x in plain)
        out = "".join(x if x.isalpha() else "" if unicodedata.combining(x) or unicodedata.category(x) == "Cf" else " " for x in plain)
        self[code] = out
        return out


_FOLD = _Fold()


def fold(text: str) -> str:
    """Folded text with one space before the first word and after the last.

    Signs that stand for letters are letters only inside a word; at its edges
    they are punctuation.
    """
    return f" {' '.join(filter(None, map(_fold_word, text.split())))} "


#: Folded words kept in a worker, at most.
MOST_FOLDED = 60_000
_words: dict[str, str] = {}


def _fold_word(word: str) -> str:
    found = _words.get(word)
    if found is None:
        core = word.strip("!$@|€.,;:?\"'()[]{}<>#%&*+-_=~^/\\`")
        found = " ".join((core if core.isdigit() else core.translate(_FOLD)).split())
        if len(_words) >= MOST_FOLDED:
            _words.clear()
        _words[word] = found
    return found


@dataclass(frozen=True)
class Model:
    """Weights of folded patterns, exception phrases and the coefficients of the curve."""

    weights: dict[str, float]
    exceptions: tuple[str, ...]
    curve: tuple[float, ...]


class Matcher:
    def __init__(self, weights: dict[str, float], exceptions: tuple[str, ...]):
        import ahocorasick

        self.found = ahocorasick.Automaton()
        for pattern, weight in weights.items():
            self.found.add_word(f" {pattern}", (len(pattern) + 1, weight))
        for phrase in exceptions:
            self.found.add_word(f" {' '.join(fold(phrase).split())} ", (-len(" ".join(fold(phrase).split())) - 2, 0.0))
        self.empty = not len(self.found)
        if not self.empty:
            self.found.make_automaton()

    def hits(self, folded: str) -> list[tuple[int, float]]:
        """(place of the space before the word, weight) of the words of a folded text that count."""
        if self.empty:
            return []
        best: dict[int, tuple[int, float]] = {}
        covered: list[tuple[int, int]] = []
        for end, (length, weight) in self.found.iter(folded):
            if length < 0:
                covered.append((end + length + 1, end))
            else:
                start = end - length + 1
                if start not in best or best[start][0] < length:
                    best[start] = (length, weight)
        if not covered:
            return [(at, w) for at, (_, w) in best.items()]
        # Spans end in order and may overlap by a word.
        free = np.ones(len(folded) + 1, bool)
        for a, b in covered:
            free[a:b] = False
        return [(at, w) for at, (_, w) in best.items() if free[at]]

    def features(self, text: str | None) -> tuple[float, float, float, float]:
        """log(1 + weight), weight / sqrt(words), weight / words, log(1 + hits)."""
        folded = fold(text) if text else ""
        hits = self.hits(folded) if folded else []
        if not hits:
            return 0.0, 0.0, 0.0, 0.0
        total, n = sum(w for _, w in hits), max(1, folded.count(" ") - 1)
        return math.log1p(total), total / math.sqrt(n), total / n, math.log1p(len(hits))

    def contexts(self, text: str | None) -> set[str]:
        """The words that count, each with the word before it and with the word after it."""
        folded = fold(text) if text else ""
        out = set()
        for at, _ in self.hits(folded) if folded else ():
            end = folded.index(" ", at + 1)
            before, after = folded.rfind(" ", 0, at), folded.find(" ", end + 1)
            if before >= 0:
                out.add(folded[before + 1 : end])
            if after >= 0:
                out.add(folded[at + 1 : after])
        return out


def _patterns_of(text: str) -> set[str]:
    words = set(fold(text).split())
    return {w for w in words if len(w) >= 3} | {w[:k] for w in words for k in STEMS if len(w) > k}


def _counter(of: Callable[[str], set[str]]):
    """Over batches (text, label): how many toxic and clean texts hold each pattern of ``of``, summed within a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, clean = Counter(), Counter()

        def out() -> pa.RecordBatch:
            keys = sorted(toxic.keys() | clean.keys())
            made = pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([toxic[k] for k in keys], pa.int64()), pa.array([clean[k] for k in keys], pa.int64())], names=["pattern", "toxic", "clean"])
            toxic.clear()
            clean.clear()
            return made

        for text, label in rows_of(batches, "text", "label"):
            (toxic if label == 1 else clean).update(of(text or ""))
            if len(clean) + len(toxic) > 150_000:
                yield out()
        if toxic or clean:
            yield out()

    return run


def _by_half(texts: DataFrame, of: Callable[[str], set[str]]) -> DataFrame:
    """(pattern, toxic0, clean0, toxic1, clean1): texts of each half of the sample that hold a pattern."""
    halves = [texts.where(F.col("half") == h).select("text", "label").mapInArrow(_counter(of), "pattern string, toxic long, clean long").withColumn("half", F.lit(h)) for h in (0, 1)]
    sums = (F.sum(F.when(F.col("half") == h, F.col(k)).otherwise(0)).alias(f"{k}{h}") for h in (0, 1) for k in ("toxic", "clean"))
    return halves[0].unionByName(halves[1]).groupBy("pattern").agg(*sums)


def _odds(toxic: float, clean: float, n_toxic: int, n_clean: int) -> float:
    return math.log((toxic + 0.5) / (n_toxic + 1)) - math.log((clean + 0.5) / (n_clean + 1))


def _lexicon(rows: list[tuple[str, int, int]], n_toxic: int, n_clean: int) -> dict[str, float]:
    """Patterns with their log odds; a longer one stays only where it tells more than its beginning."""
    scored = {}
    for pattern, t, c in rows:
        weight = _odds(t, c, n_toxic, n_clean)
        if weight >= LEAST_WEIGHT:
            scored[pattern] = min(weight, MOST_WEIGHT)
    kept: dict[str, float] = {}
    for pattern in sorted(scored, key=lambda p: (len(p), p)):
        weight = scored[pattern]
        before = [kept[pattern[:k]] for k in range(3, len(pattern)) if pattern[:k] in kept]
        if not before or weight > before[-1] + 0.3:
            kept[pattern] = weight
    return {p: round(w, 6) for p, w in kept.items()}


def logistic_fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Coefficients (the last is the constant) of ridge logistic regression by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    beta = np.zeros(x.shape[1])
    penalty = ridge * np.eye(x.shape[1])
    penalty[-1, -1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def _scores(matcher: Matcher, curve: tuple[float, ...], texts) -> tuple[np.ndarray, np.ndarray]:
    """(scores, features) of texts."""
    x = np.array([matcher.features(t) for t in texts], dtype=float).reshape(-1, 4)
    z = x @ np.array(curve[:-1]) + curve[-1]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30))), x


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, exceptions: tuple[str, ...] = ()) -> Model:
    """Learn lexicon, exceptions and curve from ``labels(doc_id, toxic)`` of rows that aren't held out.

    The labels chosen are at most ``sample`` rows, small enough to be sent to
    each task, so the documents aren't shuffled. The curve is fitted out of
    fold, on at most ``sample`` rows (ids may repeat): each half of the sample
    is scored by lexicon and exceptions of the other half. Without toxic or
    without clean examples every text gets the share of toxic labels (0
    without labels). ``exceptions`` are phrases besides those learned.
    """
    chosen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label"))
    chosen = chosen.where("doc_id IS NOT NULL AND label IN (0, 1)").where(~held_out(F.col("doc_id"))).distinct()
    rows = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(sample).collect()
    spark = docs.sparkSession
    picked = F.broadcast(spark.createDataFrame(rows, "doc_id long, label int"))
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = plain.join(picked, "doc_id").withColumn("half", F.pmod(F.xxhash64("doc_id"), F.lit(2)))
    with Scratch(spark, "toxicity") as scratch:
        both = scratch.table(texts.where("text IS NOT NULL"), "sample")
        n = {(r["half"], r["label"]): r["count"] for r in both.groupBy("half", "label").count().collect()}
        n_toxic, n_clean = ([n.get((h, k), 0) for h in (0, 1)] for k in (1, 0))
        if not sum(n_toxic) or not sum(n_clean):
            share = sum(n_toxic) / max(1, sum(n_toxic) + sum(n_clean))
            return Model({}, exceptions, (0.0, 0.0, 0.0, 0.0, math.log((share + 1e-4) / (1 - share + 1e-4))))
        toxic, clean = F.col("toxic0") + F.col("toxic1"), F.col("clean0") + F.col("clean1")
        strong = (toxic >= LEAST_TOXIC) & ((toxic + 0.5) / (sum(n_toxic) + 1) >= math.exp(LEAST_WEIGHT / 2) * (clean + 0.5) / (sum(n_clean) + 1))
        rows = [tuple(r) for r in _by_half(both, _patterns_of).where(strong).collect()]
        whole = _lexicon([(r[0], r[1] + r[3], r[2] + r[4]) for r in rows], sum(n_toxic), sum(n_clean))
        halves = [_lexicon([(r[0], r[1 + 2 * h], r[2 + 2 * h]) for r in rows if r[1 + 2 * h] >= LEAST_TOXIC / 2], n_toxic[h], n_clean[h]) for h in (0, 1)]
        lexicon = spark.sparkContext.broadcast(whole)
        built: list[Matcher] = []

        def contexts(text: str) -> set[str]:
            if not built:
                built.append(Matcher(lexicon.value, exceptions))
            return built[0].contexts(text)

        harmless = (clean >= LEAST_CLEAN) & ((toxic + 0.5) / (sum(n_toxic) + 1) <= (clean + 0.5) / (sum(n_clean) + 1))
        rows = sorted(tuple(r) for r in _by_half(both, contexts).where(harmless).collect())
        learned = (*exceptions, *(r[0] for r in rows))
        by_half = [(*exceptions, *(r[0] for r in rows if r[2 + 2 * h] >= LEAST_CLEAN / 2 and _odds(r[1 + 2 * h], r[2 + 2 * h], n_toxic[h], n_clean[h]) <= 0)) for h in (0, 1)]
        shared = spark.sparkContext.broadcast(list(zip(halves, by_half, strict=True)))

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matchers = [Matcher(*x) for x in shared.value]
            kinds = [pa.int64(), *[pa.float64()] * 5]
            for batch in batches:
                rows = [(doc_id, *matchers[1 - half].features(text), label) for doc_id, text, half, label in rows_of([batch], "doc_id", "text", "half", "label")]
                columns = zip(*rows, strict=True) if rows else [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "a", "b", "c", "d", "y"])

        measured = both.mapInArrow(measure, "doc_id long, a double, b double, c double, d double, y double")
        rows = measured.orderBy(F.xxhash64("doc_id"), "doc_id", "y", "a", "b", "c", "d").limit(sample).drop("doc_id").collect()
    table = np.array([tuple(r) for r in rows], dtype=float)
    beta = logistic_fit(table[:, :4], table[:, 4])
    return Model(whole, learned, tuple(float(b) for b in beta))


def score(model: Model, text: Column, spark, matched_only: bool = False) -> Column:
    """The toxicity of ``text``, from 0 to 1; null and empty texts get the curve's constant.

    With ``matched_only`` a text without a word that counts is 0.
    """
    shared = spark.sparkContext.broadcast(model)
    built: list[Matcher] = []

    @F.pandas_udf(T.DoubleType())
    def run(texts: pd.Series) -> pd.Series:
        own = shared.value
        if not built:
            built.append(Matcher(own.weights, own.exceptions))
        found, x = _scores(built[0], own.curve, texts)
        return pd.Series(np.where(x[:, 3] > 0, found, 0.0) if matched_only else found)

    return run(text.cast("string"))


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, exceptions: tuple[str, ...] = ()) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted.

    Null and empty texts are scored like texts without a match. A null doc_id
    isn't held out. Labels that are null or neither 0 nor 1 teach nothing; ids
    with several labels or texts teach by each. Repeated rows are scored one
    by one; texts are matched whole; an empty table gives no rows; language,
    source and id don't enter, nor other columns.
    """
    model = train(docs, labels, sample, exceptions)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = plain.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(model, F.col("text"), docs.sparkSession).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def not_toxic(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, exceptions: tuple[str, ...] = ()) -> DataFrame:
    """The rows of ``docs``, all columns, without those that hold a word of the lexicon and have a score of one half or more.

    Texts without such a word stay, whatever the share of toxic labels, so
    null and empty texts stay, and all texts where there are no labels.
    Repeated rows are judged one by one; an empty table gives no rows; columns
    of any name keep their values.
    """
    model = train(docs, labels, sample, exceptions)
    return docs.where(score(model, docs["text"], docs.sparkSession, matched_only=True) < 0.5)
