"""Toxicity matching against naive loops, learned exceptions, and awkward tables."""

import math
import random

from fundloom.llm import toxicity


def naive(text, weights, exceptions):
    """Features by comparing every word with every pattern and every span of words with every phrase."""
    words = toxicity.fold(text).split()
    folded = [toxicity.fold(p).split() for p in exceptions]
    covered = set()
    for p in folded:
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                covered |= set(range(i, i + len(p)))
    total, hits = 0.0, 0
    for i, w in enumerate(words):
        fitting = [p for p in weights if w.startswith(p)]
        if fitting and i not in covered:
            total += weights[max(fitting, key=len)]
            hits += 1
    if not hits:
        return 0.0, 0.0, 0.0, 0.0
    return math.log1p(total), total / math.sqrt(len(words)), total / len(words), math.log1p(hits)


def test_matching_against_naive_loops():
    rng = random.Random(5)
    weights = {"idio": 2.0, "idiot": 3.0, "scum": 4.0, "tras": 1.5, "trash": 2.5}
    exceptions = ("trash can", "pond scum", "can scum trash")
    words = ["1d1ot", "іdiоtic", "scum", "SCUM!", "trash", "can", "pond", "fine", "tr4sh", "trashy", "ｓｃｕｍ", "12", "a", "…"]
    m = toxicity.Matcher(weights, exceptions)
    for _ in range(400):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(0, 14)))
        assert all(abs(a - b) < 1e-12 for a, b in zip(m.features(text), naive(text, weights, exceptions))), text


def test_exceptions_are_learned_from_clean_contexts(spark):
    rng = random.Random(6)
    plain = ["the", "house", "was", "green", "and", "old", "we", "walked"]
    rows = []
    for i in range(900):
        kind = i % 3
        extra = [f"{rng.choice(plain)} scum"] if kind == 0 else ["pond scum"] if kind == 1 and i % 4 == 0 else []
        text = [rng.choice(plain) for _ in range(20)]
        text.insert(rng.randint(0, 20), " ".join(extra)) if extra else None
        rows.append((i, " ".join(text), int(kind == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(docs, docs.select("doc_id", "toxic"))
    assert "pond scum" in model.exceptions and "scum" in model.weights and len(model.exceptions) < 4
    got = toxicity.toxicity(docs, docs.select("doc_id", "toxic")).join(docs.select("doc_id", "toxic"), "doc_id").where("held_out").toPandas()
    assert (got.predicted == got.toxic).all()


def test_texts_without_a_match_stay_where_most_labels_are_toxic(spark):
    rows = [(i, "you scum " * 3 if i % 10 else "a fine day", int(i % 10 > 0)) for i in range(200)]
    rows += [(1000, None, 0), (1001, "", 0), (None, "a fine day", 0), (1002, "fine " * 200_000, 0), (1002, "fine " * 200_000, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    labels = docs.where("doc_id < 1000").selectExpr("doc_id", "score AS toxic").union(spark.sql("SELECT 7L, CAST(NULL AS INT)"))
    kept = toxicity.not_toxic(docs, labels)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r[0]) for r in rows if r[2] == 0)
    assert toxicity.not_toxic(docs, labels.where("false")).count() == len(rows)
    assert toxicity.not_toxic(docs.where("false"), labels).count() == 0
    assert toxicity.toxicity(docs, labels).count() == len(rows)
