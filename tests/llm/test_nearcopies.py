"""The pipeline's near copies against all pairs of exact five-word Jaccard."""

import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from fundloom.llm import nearcopies, simhash  # noqa: E402
from fundloom.llm.components import connected_components  # noqa: E402
from fundloom.llm.shared import Scratch  # noqa: E402


def shingles(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def similar(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def least_of_groups(rows):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, i in enumerate(sorted(sets)):
        for j in sorted(sets)[k + 1 :]:
            if similar(sets[i], sets[j]):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {find(i) for i in sets}


def test_stage_against_all_pairs(spark):
    rng = random.Random(3)
    rows, at = [(0, ""), (1, None), (2, "  "), (3, "two words"), (4, "Two  WORDS")], 10
    for n in (8, 30, 60, 200, 600):
        for _ in range(8):
            base = [f"w{rng.randrange(5000)}" for _ in range(n)]
            for edits in (0, 0, n // 100, n // 45, n // 30, n // 15):
                words = list(base)
                for k in rng.sample(range(n), edits):
                    words[k] = f"x{rng.randrange(10**9)}"
                rows.append((at, " ".join(words)))
                at += 1
    passage = " ".join(f"p{k}" for k in range(60))
    for _ in range(60):
        rows.append((at, passage + " " + " ".join(f"w{rng.randrange(5000)}" for _ in range(60))))
        at += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = least_of_groups(rows)
    far = sum(similar(shingles(a), shingles(b)) and (simhash.fingerprint_of(a.encode()) ^ simhash.fingerprint_of(b.encode())).bit_count() > 2 for i, a in rows[5:245] for j, b in rows[5:245] if i < j)
    assert far > 10  # SimHash at two bits misses these
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()} == want
    assert {r.doc_id for r in nearcopies.one_of_each_group(docs, together=3).collect()} == want
    assert corpus_pipeline.near_dedup(spark, docs.where("false"), "").count() == 0


def test_repeated_and_null_ids(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, "q r s"), (None, "q r s")], "doc_id long, text string")
    assert sorted(r.text for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == ["a b c d e f", "q r s"]


@pytest.mark.parametrize("leaders", [1, 3])
def test_large_groups_with_several_clusters(spark, monkeypatch, leaders):
    """A chain of clusters in one group: neighbours are alike, the least is like few."""
    monkeypatch.setattr(nearcopies, "LEADERS", leaders)
    rng = random.Random(4)
    base = [f"w{k}" for k in range(400)]
    rows = []
    for c in range(6):
        for _ in range(12):
            words = list(base)
            words[: 18 * c] = [f"c{k}" for k in range(18 * c)]
            for k in rng.sample(range(150, 400), 2):
                words[k] = f"x{rng.randrange(10**9)}"
            rows.append((len(rows), " ".join(words)))
    rows += [(len(rows) + i, " ".join(f"o{i}x{k}" for k in range(50))) for i in range(5)]
    root = least_of_groups(rows)
    members = spark.createDataFrame([(7, i, bytearray(t.encode())) for i, t in rows], "key long, node long, value binary")
    with Scratch(spark, "test") as scratch:
        links = nearcopies.group_links(members, nearcopies.TEXTS, scratch, together=10, chunk=8)
        found = {r.node: r.component for r in connected_components(links).collect()}
    assert {found.get(i, i) for i, _ in rows} == root
