"""Retrieval in one plan: access first, three modes, named funds, chunks; snippets against a plain loop."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fundloom.operators import chunking, hybrid, retrieval
from fundloom.plans import documents as plans


def library(spark):
    rows = [(1, "indexed", "shared", 9, "A", 1, "report", "2025-01-01"), (2, "indexed", "private", 7, "B", 1, "report", "2025-02-01"), (3, "indexed", "private", 8, "C", 2, "report", "2025-03-01"), (4, "pending", "shared", 7, "D", 1, "report", "2025-04-01"), (5, "indexed", "shared", 9, "E", None, "note", None)]
    return spark.createDataFrame(rows, "doc_id long, status string, visibility string, owner_id long, title string, fund_id int, doc_type string, as_of_date string").withColumn("as_of_date", F.col("as_of_date").cast("date"))


def passages(spark):
    texts = {1: "The exit load of the fund is one percent.", 2: "A private note on the exit load and its waiver.", 3: "Exit load secrets of another owner.", 4: "Exit load, not indexed yet.", 5: "Loads on exits are explained here."}
    return spark.createDataFrame([(10 * d, d, t) for d, t in texts.items()], "passage_id long, doc_id long, content string")


@pytest.mark.parametrize("mode", hybrid.MODES)
def test_nobody_sees_what_is_not_theirs(spark, mode):
    asked = spark.createDataFrame([(1, "What is the exit load?")], "query_id long, question string")
    for user, seen in ((7, {10, 20, 50}), (8, {10, 30, 50}), (0, {10, 50})):
        found = hybrid.retrieve(asked, passages(spark), library(spark), F.lit(user), mode).collect()
        assert {r.passage_id for r in found} == seen
        assert sorted(r.final_rank for r in found) == list(range(1, len(seen) + 1))
        chosen = [r for r in found if r.position is not None]
        assert all(r.supported for r in chosen) and chosen
        if mode == "lexical":
            assert all(r.similarity is None for r in found)
        if mode == "vector":
            assert all(r.coverage is None for r in found)


def test_rarity_does_not_tell_of_other_documents(spark):
    """A user's scores are those of a library without what this user may not read."""
    asked = spark.createDataFrame([(1, "exit load waiver secrets")], "query_id long, question string")
    all_, own = passages(spark), passages(spark).where("doc_id IN (1, 5)")
    key = lambda df: sorted((r.passage_id, r.coverage, r.similarity, r.final_score, r.supported, r.final_rank) for r in df.collect())
    assert key(hybrid.retrieve(asked, all_, library(spark), F.lit(0))) == key(hybrid.retrieve(asked, own, library(spark), F.lit(0)))


def test_other_funds_are_no_evidence(spark):
    asked = spark.createDataFrame([(1, "exit load")], "query_id long, question string")
    named = spark.createDataFrame([(1, 2)], "query_id long, fund_id int")
    found = {r.passage_id: r for r in hybrid.retrieve(asked, passages(spark), library(spark), F.lit(8), "hybrid", named).collect()}
    assert not found[10].supported and found[30].boost > found[10].boost
    assert found[30].final_rank == 1


def test_snippets_against_a_plain_loop(spark):
    rng = random.Random(5)
    words = ["Ab", "bA", "ab  ba", "c.", "ÉT", "x"]
    texts = [(k, " ".join(rng.choice(words) for _ in range(rng.randrange(12)))) for k in range(120)] + [(500, None)]
    snippets = [(k % 7, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 4)))) for k in range(40)] + [(1, "")]
    fold = lambda t: " ".join((t or "").lower().split())
    want = {(q, fold(s), i) for q, s in snippets if s for i, t in texts if fold(s) in fold(t)}
    p, s = spark.createDataFrame(texts, "passage_id long, content string"), spark.createDataFrame(snippets, "query_id long, snippet string")
    for block in (50_000, 5):
        got = [tuple(r) for r in hybrid.snippet_holders(p, s, block).collect()]
        assert set(got) == want and len(got) == len(want)


def test_evaluation_finds_leaks_and_declines(spark):
    docs = library(spark)
    asked = spark.createDataFrame([(1, "What is the exit load?"), (2, "Who wrote the almanac?")], "query_id long, question string")
    snippets = spark.createDataFrame([(1, "exit load of the fund"), (2, "almanac")], "query_id long, snippet string")
    rows = {(r["mode"], r.query_id): r for r in hybrid.evaluate(asked, snippets, passages(spark), docs, F.lit(0)).collect()}
    assert len(rows) == 6
    for mode in hybrid.MODES:
        assert rows[mode, 1].recall_3 == 1 and rows[mode, 1].leaked == 0 and rows[mode, 1].abstained is None
        assert rows[mode, 2].abstained == 1 and rows[mode, 2].recall_1 is None
    # A search that forgets the filter is told.
    everything = passages(spark).join(docs, "doc_id")
    found = hybrid.candidates(asked, everything, *hybrid.ranked_lists(asked, everything), "hybrid")
    bad = passages(spark).where("doc_id IN (2, 3, 4)").select("passage_id")
    assert sum(r.leaked for r in hybrid.evaluation_records(found, hybrid.snippet_holders(everything, snippets), snippets, bad).collect()) == 6


def test_hashed_vectors_meet_in_stems(spark):
    p = spark.createDataFrame([(1, "charging fees"), (2, "the fee charged"), (3, "of the"), (4, None)], "passage_id long, content string")
    v = {r.vec_id: r.embedding for r in hybrid.hashed_vectors(p).collect()}
    assert v[3] is None and v[4] is None and np.array_equal(v[1], v[2])


def test_search_over_chunks(spark):
    sf = "/root/testdata/sf0.001"
    rows = plans.chunk_search(spark, sf).collect()
    chunks = {r.doc_id * 100_000 + r.chunk_index: r for r in chunking.chunk_documents(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    assert rows and all(r.passage_id in chunks for r in rows)
    lib = plans._library(spark, sf)
    may = {r.doc_id for r in lib.where(retrieval.readable(lib, F.lit(2))).collect()}
    assert {r.passage_id // 100_000 for r in rows} <= may
    assert any(r.position == 1 for r in rows)


def test_lists_are_tables_that_no_plan_computes_again(spark):
    asked = spark.createDataFrame([(1, "What is the exit load?")], "query_id long, question string")
    for rows in hybrid.ranked_lists(asked, passages(spark)):
        assert "Arrow" not in rows._jdf.queryExecution().optimizedPlan().toString()
        assert rows.count() == 5


def test_passages_are_made_once(spark, tmp_path):
    """Each passage leaves a byte in a file whenever it is made: both lists, the counts and the candidates read a table."""
    made = tmp_path / "made"

    def run(batches):
        for batch in batches:
            with open(made, "ab") as out:
                out.write(b"x" * batch.num_rows)
            yield batch

    asked = spark.createDataFrame([(1, "What is the exit load?")], "query_id long, question string")
    docs = passages(spark).select("doc_id").distinct().selectExpr("doc_id", "'indexed' AS status", "'shared' AS visibility", "0L AS owner_id", "'t' AS title", "1L AS fund_id", "'report' AS doc_type", "date'2025-01-01' AS as_of_date")
    rows = passages(spark)
    hybrid.retrieve(asked, rows.mapInArrow(run, rows.schema), docs, F.lit(2)).collect()
    assert made.stat().st_size == rows.count()
