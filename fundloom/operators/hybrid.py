"""Retrieval over passages of documents in three modes, with access, evidence and context in one plan, and its evaluation.

Documents are (doc_id, status, visibility, owner_id, title, fund_id, doc_type,
as_of_date), passages (passage_id, doc_id, content), questions (query_id,
question). A search for a user reads what this user may read and nothing else:
the filter stands before the search, so ranks, rarity and evidence don't tell
of other documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fundloom.conventions import require
from fundloom.functions.text import folded, processed_question
from fundloom.operators import lexical, retrieval
from fundloom.storage import written

MODES = ("hybrid", "vector", "lexical")
#: Dimensions of hashed vectors, and how many of them a task compares at once.
DIMENSIONS, VECTOR_CHUNK = 256, 5000


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import hashlib

    known: dict[str, tuple[int, int]] = {}

    def place(lexeme: str) -> tuple[int, int]:
        if lexeme not in known:
            if len(known) > 200_000:
                known.clear()
            digest = hashlib.md5(lexeme.encode()).digest()
            known[lexeme] = digest[0], 1 - 2 * (digest[1] >> 4 & 1)
        return known[lexeme]

    for batch in lexical._posted(batches):
        vectors = []
        for lexemes, places in zip(batch.column("lexemes").to_pylist(), batch.column("places").to_pylist(), strict=True):
            v = np.zeros(DIMENSIONS)
            for lexeme, at in zip(lexemes, places, strict=True):
                d, sign = place(lexeme)
                v[d] += sign * len(at)
            vectors.append(v if v.any() else None)
        yield pa.RecordBatch.from_arrays([batch.column("passage_id"), pa.array(vectors, pa.list_(pa.float64()))], names=["vec_id", "embedding"])


def hashed_vectors(passages: DataFrame) -> DataFrame:
    """(vec_id, embedding): a vector of 256 signed counts of a passage's stems, by their MD5; null without stems.

    It stands where an embedder would: nothing is trained, equal stems meet in
    equal dimensions.
    """
    rows = passages.select(F.col("passage_id").cast("long").alias("passage_id"), F.col("content").cast("string").alias("content"))
    return rows.mapInArrow(_hashed, "vec_id long, embedding array<double>")


def readable_passages(passages: DataFrame, documents: DataFrame, user: Column) -> DataFrame:
    """Passages of documents that the user may read, with their documents' columns."""
    return passages.join(documents.where(retrieval.readable(documents, user)), "doc_id")


def ranked_lists(questions: DataFrame, readable: DataFrame, most: int = 30) -> tuple[DataFrame, DataFrame]:
    """The vector list and the lexical list of each question over readable passages."""
    asked = hashed_vectors(questions.select(F.col("query_id").alias("passage_id"), F.col("question").alias("content"))).where("embedding IS NOT NULL")
    # All are written, as several plans read them: each would hash and stem all passages again, the count of the vectors too.
    near = retrieval.vector_search(asked, written(hashed_vectors(readable), "vectors"), most, chunk=VECTOR_CHUNK)
    return written(near, "near"), written(lexical.lexical_search(questions, readable, most), "words")


def candidates(questions: DataFrame, readable: DataFrame, near: DataFrame, words: DataFrame, mode: str, named: DataFrame | None = None) -> DataFrame:
    """A question's candidates in the order of ``final_rank``: fused, boosted, gated by evidence, supported ones first.

    ``named(query_id, fund_id)`` are funds that questions name; documents of
    other funds are then no evidence, those of none are. Ties go by content,
    title and id.
    """
    require(mode in MODES, "the mode is hybrid, vector or lexical")
    lists = retrieval.fused(near.where(F.lit(mode != "lexical")), words.where(F.lit(mode != "vector"))).drop("fused_rank")
    flags = processed_question(F.col("question"), F.lit(None).cast("string"))
    asked = questions.select("query_id", flags.alias("p")).select("query_id", "p.mentions_period", "p.wants_latest")
    rows = lists.join(readable, "passage_id").join(asked, "query_id")
    if named is None:
        rows = rows.withColumn("named", F.lit(False)).withColumn("eligible", F.lit(True))
    else:
        funds = named.groupBy("query_id").agg(F.collect_set("fund_id").alias("funds"))
        rows = rows.join(funds, "query_id", "left").withColumn("named", F.coalesce(F.array_contains("funds", F.col("fund_id")), F.lit(False)))
        rows = rows.withColumn("eligible", F.col("funds").isNull() | F.col("fund_id").isNull() | F.col("named")).drop("funds")
    boosted = retrieval.boosted(rows, F.col("named"), F.col("mentions_period"), F.col("wants_latest"))
    scored = boosted.withColumn("final_score", F.round(F.col("score") * F.col("boost"), 12))
    order = Window.partitionBy("query_id").orderBy(F.desc("final_score"), "content", "title", "passage_id")
    gated = retrieval.evidence(scored.withColumn("fused_rank", F.row_number().over(order)))
    return retrieval.supported_first(gated)


def retrieve(questions: DataFrame, passages: DataFrame, documents: DataFrame, user: Column, mode: str = "hybrid", named: DataFrame | None = None, most: int = 30) -> DataFrame:
    """A user's candidates for each question, with ``position`` in the context for those that are chosen (null for others)."""
    # Passages may be costly to make, as chunks are, and both lists and all candidates read them.
    readable = written(readable_passages(passages, documents, user), "readable")
    found = written(candidates(questions, readable, *ranked_lists(questions, readable, most), mode, named), "candidates")
    chosen = retrieval.select_context(found.withColumn("fused_rank", F.col("final_rank")))
    return found.join(chosen, ["query_id", "passage_id"], "left")


def _holding(names: list[tuple[int, str]]):
    """Over (passage_id, folded content): the snippets that each holds, by an automaton of all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        of: dict[str, list[int]] = {}
        for k, (_, snippet) in enumerate(names):
            of.setdefault(snippet, []).append(k)
        for snippet, rows in of.items():
            automaton.add_word(snippet, rows)
        automaton.make_automaton()
        for batch in batches:
            out = []
            for i, text in zip(batch.column("passage_id").to_pylist(), batch.column("content").to_pylist(), strict=True):
                out += [(names[k][0], names[k][1], i) for k in sorted({k for _, rows in automaton.iter(text or "") for k in rows})]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate((pa.int64(), pa.string(), pa.int64()))], names=["query_id", "snippet", "passage_id"])

    return run


def snippet_holders(passages: DataFrame, snippets: DataFrame, block: int = 50_000) -> DataFrame:
    """(query_id, snippet, passage_id): which passages hold which of the stated ``snippets(query_id, snippet)``, in any case and spacing.

    Snippets are folded in the result. All passages are read once for each
    block of snippets.
    """
    given = snippets.select("query_id", folded(F.col("snippet")).alias("snippet")).where("snippet <> ''").distinct()
    blocks = max(1, -(-given.count() // block))
    rows = passages.select(F.col("passage_id").cast("long").alias("passage_id"), folded(F.col("content")).alias("content"))
    out = None
    for k in range(blocks):
        part = [(r.query_id, r.snippet) for r in given.where(F.pmod(F.xxhash64("query_id", "snippet"), F.lit(blocks)) == k).toLocalIterator()]
        found = rows.mapInArrow(_holding(part), "query_id long, snippet string, passage_id long") if part else rows.where("false").select(F.lit(0).cast("long").alias("query_id"), F.lit("").alias("snippet"), "passage_id")
        out = found if out is None else out.unionByName(found)
    return out


def evaluation_records(found: DataFrame, holders: DataFrame, snippets: DataFrame, forbidden: DataFrame) -> DataFrame:
    """(query_id, metrics...) of one mode's ``found`` candidates.

    ``holders`` are the snippets' holders among the readable passages: a
    question without one can't be answered and must be declined
    (``abstained``); the others have recall, precision, reciprocal rank, nDCG
    and ``false_abstention``. Recall is the share of a question's snippets that
    the first k candidates hold. ``leaked`` counts candidates of
    ``forbidden(passage_id)``.
    """
    total = snippets.select("query_id", folded(F.col("snippet")).alias("snippet")).where("snippet <> ''").distinct().groupBy("query_id").agg(F.count("*").alias("n"))
    relevant = holders.groupBy("query_id").agg(F.count_distinct("passage_id").alias("n_relevant"))
    hits = found.select("query_id", "passage_id", F.col("final_rank").alias("rank")).join(holders, ["query_id", "passage_id"])
    first = hits.groupBy("query_id", "snippet").agg(F.min("rank").alias("rank"))
    recall = first.groupBy("query_id").agg(*(F.count_if(F.col("rank") <= k).alias(f"s{k}") for k in (1, 3, 5)))
    of = hits.select("query_id", "rank").distinct().groupBy("query_id").agg(*(F.count_if(F.col("rank") <= k).alias(f"h{k}") for k in (1, 3, 5)), F.max(1 / F.col("rank")).alias("rr"), F.sum(F.when(F.col("rank") <= 5, 1 / F.log2(F.col("rank") + 1.0))).alias("dcg"))
    leaks = found.join(forbidden.withColumn("bad", F.lit(1)), "passage_id", "left")
    told = leaks.groupBy("query_id").agg(F.bool_or("supported").alias("supported"), F.count("bad").alias("leaked"))
    rows = total.join(relevant, "query_id", "left").join(recall, "query_id", "left").join(of, "query_id", "left").join(told, "query_id", "left")
    can = F.col("n_relevant").isNotNull()
    declined = (~F.coalesce("supported", F.lit(False))).cast("double")
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n_relevant", F.lit(5)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    metrics = [(zero(f"s{k}") / F.col("n")).alias(f"recall_{k}") for k in (1, 3, 5)] + [(zero(f"h{k}") / F.lit(float(k))).alias(f"precision_{k}") for k in (1, 3, 5)] + [F.coalesce("rr", F.lit(0.0)).alias("reciprocal_rank"), (F.coalesce("dcg", F.lit(0.0)) / ideal).alias("ndcg_5")]
    return rows.select("query_id", *(F.when(can, m).alias(n) for m, n in zip(metrics, [*(f"recall_{k}" for k in (1, 3, 5)), *(f"precision_{k}" for k in (1, 3, 5)), "reciprocal_rank", "ndcg_5"], strict=True)), F.when(~can, declined).alias("abstained"), F.when(can, declined).alias("false_abstention"), zero("leaked").alias("leaked"))


def evaluate(questions: DataFrame, snippets: DataFrame, passages: DataFrame, documents: DataFrame, user: Column, named: DataFrame | None = None, most: int = 30) -> DataFrame:
    """(mode, query_id, metrics...) of all three modes for a user; both lists are searched once."""
    readable = readable_passages(passages, documents, user)
    # The forbidden passages come from the rights alone, not from the search's own filter.
    allowed = retrieval.rights(documents, user, F.lit(False)).where("can_read AND status = 'indexed'").select("doc_id")
    forbidden = passages.join(allowed, "doc_id", "left_anti").select("passage_id")
    near, words = ranked_lists(questions, readable, most)
    holders = written(snippet_holders(readable, snippets), "holders")
    # The modes' candidates are all in these lists.
    listed = near.select("passage_id").unionByName(words.select("passage_id")).distinct()
    readable = written(readable.join(listed, "passage_id", "left_semi"), "listed")
    records = [evaluation_records(candidates(questions, readable, near, words, mode, named), holders, snippets, forbidden).withColumn("mode", F.lit(mode)) for mode in MODES]
    return records[0].unionByName(records[1]).unionByName(records[2])
