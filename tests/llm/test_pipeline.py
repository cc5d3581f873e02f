"""The pipeline's stages on the smallest tables: columns, kept rows and decisions."""

import math
import re

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from fundloom.llm import toxicity  # noqa: E402

SF = "/root/testdata/sf0.001"


def contract_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def naive_features(text, model):
    """What a text's words weigh, without an automaton."""
    words = toxicity.fold(text or "").split()
    covered = set()
    phrases = [p.split() for p in model.exceptions]
    for p in phrases:
        covered |= {i + k for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p for k in range(len(p))}
    total, hits = 0.0, 0
    for i, w in enumerate(words):
        fitting = [w[:k] for k in range(1, len(w) + 1) if w[:k] in model.weights]
        if fitting and i not in covered:
            total, hits = total + model.weights[fitting[-1]], hits + 1
    n = max(1, len(words))
    return math.log1p(total), total / math.sqrt(n), total / n, math.log1p(hits)


def brute_kept(texts):
    """The least doc_id of each component of texts whose five-word shingles have a Jaccard similarity of 0.8 or more."""
    shingles = {}
    for i, t in texts.items():
        w = re.sub("[A-Z]", lambda m: m[0].lower(), t or "").encode().split()
        shingles[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(texts)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            a, b = shingles[i], shingles[j]
            if (not a and not b) or (min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and 9 * len(a & b) >= 4 * (len(a) + len(b))):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {find(i) for i in ids}


def test_stages_follow_each_other(spark, tmp_path):
    first = docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == first.columns
        seen[name] = before, docs
    model = toxicity.train(first, spark.read.parquet(f"{SF}/labels.parquet"))
    kept = set()
    for r in first.collect():
        a, b, c, d = naive_features(r.text, model)
        z = a * model.curve[0] + b * model.curve[1] + c * model.curve[2] + d * model.curve[3] + model.curve[4]
        if not d or z < 0:
            kept.add(r.doc_id)
    assert {r.doc_id for r in seen["toxicity"][1].collect()} == kept
    before, after = seen["line_dedup"]
    assert {r.doc_id for r in before.collect()} == {r.doc_id for r in after.collect()}
    before, after = seen["near_dedup"]
    texts = {r.doc_id: r.text for r in before.collect()}
    assert {r.doc_id for r in after.collect()} == brute_kept(texts)
    before, after = seen["decontaminate"]
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = contract_words(r.text)
        windows |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9) if w else 0)}
    lengths = {len(w) for w in windows}
    clean = set()
    for r in before.collect():
        w = contract_words(r.text)
        if not any(tuple(w[k : k + n]) in windows for n in lengths for k in range(len(w) - n + 1)):
            clean.add(r.doc_id)
    assert {r.doc_id for r in after.collect()} == clean
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.collect()}
