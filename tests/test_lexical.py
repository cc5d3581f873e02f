"""Postings and lexical search against plain loops."""

import hashlib
import math
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from fundloom.functions.stemming import STOP_WORDS, stem
from fundloom.functions.text import REQUEST_WORDS
from fundloom.operators import lexical


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def places_of(text):
    out = {}
    for k, w in enumerate(words(text)):
        if w not in STOP_WORDS:
            out.setdefault(stem(w), []).append(k)
    return out


def all_covers(places):
    """Every range that holds each lexeme, without those that hold a smaller one."""
    at = sorted({p for x in places for p in x})
    whole = [(i, j) for i in at for j in at if i <= j and all(any(i <= p <= j for p in x) for x in places)]
    return [(i, j) for i, j in whole if not any((a, b) != (i, j) and i <= a and b <= j for a, b in whole)]


def test_covers_against_all_ranges():
    rng = random.Random(1)
    for _ in range(300):
        free = list(range(rng.randrange(4, 30)))
        rng.shuffle(free)
        places = [sorted(free.pop() for _ in range(rng.randrange(1, 4)) if free) for _ in range(rng.randrange(1, 4))]
        places = [p for p in places if p]
        every = sorted(p for x in places for p in x)
        want = sum(0.1 / (1 + (j - i) - (sum(i <= p <= j for p in every) - 1)) for i, j in all_covers(places))
        assert lexical.cover_density([np.array(p) for p in places]) == pytest.approx(want)
    assert lexical.cover_density([np.array([1, 2]), np.array([9])], every=False) == pytest.approx(0.3)


def brute(questions, passages, every, most=30):
    held = {p: places_of(t) for p, t in passages}
    text = dict(passages)
    request = {stem(w) for w in REQUEST_WORDS if w not in STOP_WORDS}
    out = []
    for q, question in questions:
        asked = sorted({stem(w) for w in words(question) if w not in STOP_WORDS} - request)[:40]
        idf = {x: math.log((len(passages) + 1) / (sum(x in h for h in held.values()) + 1)) + 1 for x in asked}
        rows = []
        for p, h in held.items():
            mine = [x for x in asked if x in h]
            if not mine or (every and len(mine) < len(asked)):
                continue
            r = sum(0.1 / (1 + (j - i) - (sum(i <= y <= j for x in mine for y in h[x]) - 1)) for i, j in all_covers([h[x] for x in mine])) if every else 0.1 * sum(len(h[x]) for x in mine)
            rows.append((p, round(r / (1 + r), 9), hashlib.sha256(text[p].encode()).hexdigest(), round(sum(idf[x] for x in mine) / sum(idf.values()), 6), len(mine)))
        rows = sorted(rows, key=lambda x: (-x[1], x[2], x[0]))[:90]
        for k, (p, d, _, c, m) in enumerate(sorted(rows, key=lambda x: (-x[3], -x[1], x[2], x[0]))[:most], 1):
            out.append((q, p, c, m, d, k))
    return sorted(out)


@pytest.mark.parametrize("block", [5000, 2])
@pytest.mark.parametrize("every", [False, True])
def test_search_against_a_plain_loop(spark, every, block):
    rng = random.Random(2)
    vocabulary = "fee fees charged charging fund funds yield yields yielded returns the of annual annually risk risky Größe größe 2024 liquidity liquid".split()
    passages = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 25)))) for k in range(300)] + [(300, None), (301, ""), (302, "the of")]
    passages += [(400 + k, "fees of annual funds") for k in range(3)]
    questions = [(1, "What fees does the fund charge?"), (2, "latest yield"), (3, "Größe"), (4, "tell me, please"), (5, None), (6, "nothing matches xyzzy"), (7, "annual liquidity returns")]
    q = spark.createDataFrame(questions, "query_id long, question string")
    p = spark.createDataFrame(passages, "passage_id long, content string").repartition(4)
    got = lexical.lexical_search(q, p, every=every, block=block)
    assert got.columns == ["query_id", "passage_id", "coverage", "matched", "density", "lexical_rank"]
    rows = sorted(tuple(r) for r in got.collect())
    assert [r[:2] + r[3:] for r in rows] == [r[:2] + r[3:] for r in brute([x for x in questions if x[1]], [(i, t or "") for i, t in passages], every)]
    assert [r[2] for r in rows] == pytest.approx([r[2] for r in brute([x for x in questions if x[1]], [(i, t or "") for i, t in passages], every)], abs=2e-6)


def test_fees_finds_fee(spark):
    p = spark.createDataFrame([(1, "The fee is low."), (2, "Nothing here.")], "passage_id long, content string")
    q = spark.createDataFrame([(1, "fees")], "query_id long, question string")
    assert [r.passage_id for r in lexical.lexical_search(q, p).collect()] == [1]
    places = {(r.passage_id, r.lexeme): r.places for r in lexical.lexeme_places(p).collect()}
    assert places == {(1, "fee"): [1], (1, "low"): [3], (2, "noth"): [0]}
    assert lexical.lexeme_places(p.where("false")).count() == 0
    assert lexical.lexical_search(q, p.where("false")).count() == 0 == lexical.lexical_search(q.where("false"), p).count()


def peak(run) -> int:
    tracemalloc.start()
    run()
    out = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return out


def test_memory_is_bounded_by_neither_pairs_nor_the_longest_word():
    ids = list(range(4000))
    lexemes = [f"w{k}" for k in range(10)]
    text = " ".join(lexemes)
    asked = pa.table({"query_id": [q for q in range(200) for _ in lexemes], "lexeme": lexemes * 200, "k": list(range(10)) * 200})
    batch = pa.RecordBatch.from_pydict({"passage_id": ids, "content": [text] * len(ids)})
    found = []
    assert peak(lambda: found.extend(lexical._best_of_batches(asked, 90, False)(lexical._posted(iter([batch]))))) < 100e6
    # A task sends on each question's best once, the counts of ten lexemes and of the passages.
    assert sum(b.num_rows for b in found) == 200 * 90 + 11
    assert set(found[0].column("passage_id").to_pylist()[:90]) == set(range(90))
    odd = pa.RecordBatch.from_pydict({"passage_id": [1], "content": [" ".join(["x" * 100_000, *(f"v{k}" for k in range(1000))])]})
    assert peak(lambda: list(lexical._posted(iter([odd])))) < 50e6
