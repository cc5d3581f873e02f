"""Batched retrieval: one plan for all questions of a table.

Passages are (passage_id, doc_id, content), questions (query_id, question).
What follows a question's ranked list is bounded by the list's length.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fundloom.conventions import require
from fundloom.functions.text import folded, lexemes, sentences, shingles

#: Questions' vectors, and passages' vectors, that a task compares at once.
QUERY_BLOCK, VECTOR_CHUNK = 4096, 20_000
#: Fusion, boosts and thresholds of evidence.
VECTOR_WEIGHT, LEXICAL_WEIGHT = 0.3, 1.0
FUSION_K, NAMED_BOOST, LATEST_BOOST, ASKED_LATEST_BOOST = 60, 1.15, 1.05, 1.25
ANSWER_COVERAGE, ANSWER_SIMILARITY = 0.5, 0.6
INCLUDE_COVERAGE, INCLUDE_RATIO, INCLUDE_MARGIN = 0.3, 0.6, 0.08
#: Words of an excerpt, and shares of the best score or coverage that prose and tables must reach.
EXCERPT_WORDS, PROSE_SHARE, TABLE_SHARE = 90, 0.5, 0.75


def readable(documents: DataFrame, user: Column) -> Column:
    """Whether a user may read a document: indexed, and shared or the user's own."""
    return (documents["status"] == "indexed") & ((documents["visibility"] == "shared") | (documents["owner_id"] == user))


def rights(documents: DataFrame, user: Column, admin: Column) -> DataFrame:
    """``can_read`` (the user's own, or shared) and ``can_manage`` (the user's own, or an admin's where nobody owns it)."""
    own = F.coalesce(documents["owner_id"] == user, F.lit(False))
    return documents.withColumn("can_read", own | (documents["visibility"] == "shared")).withColumn("can_manage", own | (documents["owner_id"].isNull() & admin))


def ranked(rows: DataFrame, by: str, name: str, most: int | None = None) -> DataFrame:
    """``name``: the rank by ``by``, greatest first, ties by passage_id."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(by), "passage_id"))
    out = rows.withColumn(name, rank)
    return out.where(F.col(name) <= most) if most else out


def _nearest(most: int):
    """Over a chunk of vectors and a block of questions: the questions' nearest vectors of the chunk, ties included."""

    def unit(table: pa.Table, key: str, value: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids = table.column(key).to_numpy()
        x = np.asarray(table.column(value).combine_chunks().flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(ids), -1)
        size = np.linalg.norm(x, axis=1)
        return ids, x / np.where(size > 0, size, 1)[:, None], size > 0

    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        names, kinds = ["query_id", "passage_id", "similarity"], [pa.int64(), pa.int64(), pa.float64()]
        if not vectors.num_rows or not queries.num_rows:
            return pa.table([pa.array([], k) for k in kinds], names=names)
        ids, x, good = unit(vectors, "vec_id", "embedding")
        asked, q, sound = unit(queries, "query", "asked")
        require(bool(sound.all()), "a question's vector is zero")
        got: list[tuple[np.ndarray, ...]] = []
        for at in range(0, len(asked), 64):
            sims = np.where(good, q[at : at + 64] @ x.T, -2.0)
            k = min(most, len(ids))
            edge = np.partition(sims, len(ids) - k, axis=1)[:, len(ids) - k]
            i, j = np.nonzero((sims >= edge[:, None] - 1e-6) & (sims > -2))  # ties go on to the ranking
            got.append((asked[at + i], ids[j], sims[i, j]))
        return pa.table([pa.array(np.concatenate(c), k) for c, k in zip(zip(*got, strict=True), kinds, strict=True)], names=names)

    return run


def vector_search(queries: DataFrame, vectors: DataFrame, most: int = 30, block: int = QUERY_BLOCK, chunk: int = VECTOR_CHUNK) -> DataFrame:
    """(query_id, passage_id, similarity, vector_rank): exact cosine neighbours of ``queries(vec_id, embedding)``.

    The stated queries meet all vectors in tasks of one block of the former
    and one chunk of the latter; a task sends on its nearest ones only, and
    the driver holds no vector.
    """
    n_blocks, n_chunks = (max(1, -(-t.count() // size)) for t, size in ((queries, block), (vectors, chunk)))

    def dealt(rows: DataFrame, own: str, parts: int, other: str, others: int) -> DataFrame:
        return rows.where("embedding IS NOT NULL").select("vec_id", "embedding", F.pmod(F.xxhash64("vec_id"), F.lit(parts)).alias(own), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(others - 1).cast("long"))).alias(other))

    left = dealt(vectors, "c", n_chunks, "b", n_blocks)
    # Names of their own, as both may come from one table.
    right = dealt(queries, "b", n_blocks, "c", n_chunks).select(F.col("vec_id").alias("query"), F.col("embedding").alias("asked"), F.col("b").alias("block"), F.col("c").alias("chunk"))
    out = left.groupBy("b", "c").cogroup(right.groupBy("block", "chunk")).applyInArrow(_nearest(most), "query_id long, passage_id long, similarity double")
    return ranked(out.withColumn("similarity", F.round("similarity", 6)), "similarity", "vector_rank", most)


def fused(vector: DataFrame, lexical: DataFrame, vector_weight: float = VECTOR_WEIGHT, lexical_weight: float = LEXICAL_WEIGHT) -> DataFrame:
    """Both lists by reciprocal rank: score = sum of weight / (60 + rank), with the rank in the fused order."""
    both = vector.join(lexical, ["query_id", "passage_id"], "full_outer")

    def part(rank: str, weight: float) -> Column:
        return F.coalesce(weight / (FUSION_K + F.col(rank)), F.lit(0.0))

    scored = both.withColumn("score", F.round(part("vector_rank", vector_weight) + part("lexical_rank", lexical_weight), 12))
    return ranked(scored, "score", "fused_rank")


def boosted(candidates: DataFrame, named: Column, mentions_period: Column | None = None, wants_latest: Column | None = None) -> DataFrame:
    """``boost`` for passages of a named fund, and for the latest date of each fund and type among the candidates.

    The latest date counts more where the question asks for it, and not at all
    where it names a period.
    """
    latest = F.max("as_of_date").over(Window.partitionBy("query_id", "fund_id", "doc_type"))
    fresh = F.coalesce((F.col("as_of_date") == latest) & F.col("fund_id").isNotNull(), F.lit(False))
    if mentions_period is not None:
        fresh = fresh & ~mentions_period
    more = F.lit(LATEST_BOOST) if wants_latest is None else F.when(wants_latest, ASKED_LATEST_BOOST).otherwise(LATEST_BOOST)
    return candidates.withColumn("boost", F.when(named, NAMED_BOOST).otherwise(1.0) * F.when(fresh, more).otherwise(1.0))


def supported_first(candidates: DataFrame, rank: str = "fused_rank") -> DataFrame:
    """``final_rank``: supported candidates first, otherwise in the order of ``rank``."""
    return candidates.withColumn("final_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(~F.col("supported"), rank)))


def evidence(candidates: DataFrame) -> DataFrame:
    """``supported``: first whether the best candidate can answer, then which others are close to it.

    Candidates that aren't ``eligible`` (of a fund that isn't asked for) don't
    count and are never supported.
    """
    of = Window.partitionBy("query_id")
    coverage, similarity = F.coalesce("coverage", F.lit(0.0)), F.coalesce("similarity", F.lit(0.0))
    best_c = F.coalesce(F.max(F.when(F.col("eligible"), coverage)).over(of), F.lit(0.0))
    best_s = F.coalesce(F.max(F.when(F.col("eligible"), similarity)).over(of), F.lit(0.0))
    lexical = (best_c >= ANSWER_COVERAGE) & (coverage >= F.greatest(F.lit(INCLUDE_COVERAGE), INCLUDE_RATIO * best_c))
    vector = (best_s >= ANSWER_SIMILARITY) & (similarity >= F.greatest(F.lit(ANSWER_SIMILARITY - INCLUDE_MARGIN), best_s - INCLUDE_MARGIN))
    return candidates.withColumn("supported", F.col("eligible") & (lexical | vector))


def near_duplicates(candidates: DataFrame, least: float = 0.8) -> DataFrame:
    """(query_id, a, b, similarity): pairs inside one question's list whose five-word runs agree."""
    runs = candidates.select("query_id", "passage_id", shingles(F.col("content")).alias("s")).where("s IS NOT NULL").withColumn("n", F.size("s"))
    a, b = runs.toDF("query_id", "a", "sa", "na"), runs.toDF("query_id", "b", "sb", "nb")
    # Sets of very unlike sizes can't agree enough; only the rest are intersected.
    pairs = a.join(b, "query_id").where((F.col("a") < F.col("b")) & (F.least("na", "nb") >= least * F.greatest("na", "nb")))
    common = pairs.select("query_id", "a", "b", (F.col("na") + F.col("nb")).alias("both"), F.size(F.array_intersect("sa", "sb")).alias("common"))
    return common.select("query_id", "a", "b", F.round(F.col("common") / (F.col("both") - F.col("common")), 6).alias("similarity")).where(F.col("similarity") >= least)


def select_context(candidates: DataFrame, top: int = 6, words: int = 1600, per_document: int = 4) -> DataFrame:
    """(query_id, passage_id, position): supported passages in order, without near copies, within a budget of words.

    What doesn't fit is passed over and later ones may still fit; the first is
    always taken. Each call holds one question's list.
    """

    def runs(text: str) -> frozenset:
        w = text.lower().split()
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        taken, used, per = [], 0, {}
        for row in pdf[pdf["supported"]].sort_values("fused_rank").itertuples():
            n, s = len(row.content.split()), runs(row.content)
            if per.get(row.doc_id, 0) >= per_document or (taken and used + n > words):
                continue
            if any(s and t and len(s & t) / len(s | t) >= 0.8 for _, t in taken):
                continue
            taken.append((row.passage_id, s))
            used += n
            per[row.doc_id] = per.get(row.doc_id, 0) + 1
            if len(taken) == top:
                break
        return pd.DataFrame({"query_id": [pdf["query_id"].iloc[0]] * len(taken), "passage_id": [p for p, _ in taken], "position": range(1, len(taken) + 1)})

    return candidates.groupBy("query_id").applyInPandas(choose, "query_id long, passage_id long, position int")


def _prose_excerpt(ranked: DataFrame, asked: Column) -> DataFrame:
    """``score`` and ``excerpt`` of the best sentence: it and the next, or the three after it where it is itself a question."""
    parts = ranked.withColumn("parts", F.when(F.size(sentences(F.col("content"))) > 0, sentences(F.col("content"))).otherwise(F.array("content")))

    def score(sentence: Column) -> Column:
        words = lexemes(sentence)
        common = F.size(F.array_intersect(asked, words))
        cosine = F.coalesce(F.try_divide(common.cast("double"), F.sqrt(F.size(asked) * F.size(words))), F.lit(0.0))
        return F.round(0.5 * cosine + 0.5 * common / F.greatest(F.lit(1), F.size(asked)), 6)

    scored = parts.withColumn("scores", F.transform("parts", score)).withColumn("score", F.array_max("scores"))
    scored = scored.withColumn("at", F.array_position("scores", F.col("score")).cast("int"))
    asks = F.element_at("parts", F.col("at")).endswith("?") & (F.col("at") < F.size("parts"))
    window = F.when(asks, F.slice("parts", F.col("at") + 1, 3)).otherwise(F.slice("parts", F.col("at"), 2))
    words = F.filter(F.split(F.array_join(window, " "), r"\s+"), lambda w: w != "")
    cut = F.concat(F.array_join(F.slice(words, 1, EXCERPT_WORDS), " "), F.when(F.size(words) > EXCERPT_WORDS, " ...").otherwise(""))
    return scored.withColumn("excerpt", cut).drop("parts", "scores", "at")


def _table_rows(content: Column, asked: Column) -> Column:
    """The header and up to four rows that hold the most of the words asked for beyond the header's."""
    lines = F.split(content, "\n")
    header, body = F.get(lines, F.lit(0)), F.slice(lines, 2, F.greatest(F.lit(0), F.size(lines) - 1))
    wanted = F.array_except(asked, lexemes(header))
    hits = F.transform(body, lambda row: F.size(F.array_intersect(wanted, lexemes(row))))
    best = F.array_max(hits)
    return F.concat(header, F.lit(" → "), F.array_join(F.slice(F.filter(body, lambda row, i: F.get(hits, i) == best), 1, 4), "; "))


def excerpts(candidates: DataFrame, most: int = 3) -> DataFrame:
    """(query_id, passage_id, place, excerpt, score): what an answer quotes from a question's best passages.

    ``candidates(query_id, question, passage_id, content, coverage, is_table, place)``
    with ``place`` from 1. The first ``most`` are quoted, and where none of
    these is a table the first table with three quarters of the best coverage.
    Prose that scores under half of the question's first prose is left out;
    tables have no score. A sentence's score is half the share of the asked
    words it holds and half the cosine of both sets of words. Rows without
    content are left out.
    """
    of = Window.partitionBy("query_id")
    table = F.coalesce("is_table", F.lit(False))
    rows = candidates.where("content IS NOT NULL").withColumn("is_table", table).withColumn("best", F.max("coverage").over(of))
    rows = rows.withColumn("tables", F.count_if(F.col("is_table") & (F.col("place") <= most)).over(of))
    strong = F.col("is_table") & (F.col("coverage") >= TABLE_SHARE * F.col("best"))
    rows = rows.withColumn("extra", F.min(F.when(strong, F.col("place"))).over(of))
    rows = rows.where((F.col("place") <= most) | ((F.col("tables") == 0) & (F.col("place") == F.col("extra"))))
    rows = rows.withColumn("asked", lexemes(F.coalesce("question", F.lit(""))))
    prose = _prose_excerpt(rows.where("NOT is_table"), F.col("asked"))
    prose = prose.withColumn("first", F.min_by("score", "place").over(of)).where(F.col("score") >= PROSE_SHARE * F.col("first"))
    out = ["query_id", "passage_id", "place", "excerpt", "score"]
    tables = rows.where("is_table").withColumn("excerpt", _table_rows(F.col("content"), F.col("asked"))).withColumn("score", F.lit(None).cast("double"))
    return prose.select(*out).unionByName(tables.select(*out))


def conflicts(selected: DataFrame) -> DataFrame:
    """(query_id, fund_id, dates): funds for which passages of more than one date were chosen."""
    dates = F.sort_array(F.collect_set("as_of_date"))
    return selected.where("fund_id IS NOT NULL AND as_of_date IS NOT NULL").groupBy("query_id", "fund_id").agg(dates.alias("dates")).where(F.size("dates") > 1)


def retrieval_metrics(ranks: DataFrame, hits: DataFrame, totals: DataFrame) -> DataFrame:
    """Per question: recall and precision at 1, 3 and 5, reciprocal rank and nDCG at 5.

    ``ranks(query_id, passage_id, rank)``, ``hits(query_id, passage_id)``: the
    relevant ones among the ranked; ``totals(query_id, n_relevant)``: all
    relevant ones, counted. Questions without any are left out.
    """
    found = ranks.join(hits.select("query_id", "passage_id").distinct(), ["query_id", "passage_id"], "left_semi")
    found = found.groupBy("query_id").agg(*(F.count_if(F.col("rank") <= k).alias(f"h{k}") for k in (1, 3, 5)), F.max(1 / F.col("rank")).alias("rr"), F.sum(F.when(F.col("rank") <= 5, 1 / F.log2(F.col("rank") + 1.0))).alias("dcg"))
    joined = totals.where("n_relevant > 0").join(found, "query_id", "left")
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n_relevant", F.lit(5)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return joined.select("query_id", *((zero(f"h{k}") / F.col("n_relevant")).alias(f"recall_{k}") for k in (1, 3, 5)), *((zero(f"h{k}") / F.lit(float(k))).alias(f"precision_{k}") for k in (1, 3, 5)), F.coalesce("rr", F.lit(0.0)).alias("reciprocal_rank"), (F.coalesce("dcg", F.lit(0.0)) / ideal).alias("ndcg_5"))


def containing(passages: DataFrame, snippets: DataFrame) -> DataFrame:
    """(query_id, passage_id, snippet) of ``snippets(query_id, snippet)`` in ``passages(query_id, passage_id, content)``, without regard to case and white space.

    Both are of one question, so a snippet meets that question's list only.
    """
    joined = passages.join(snippets, "query_id")
    return joined.where(F.contains(folded(F.col("content")), folded(F.col("snippet")))).select("query_id", "passage_id", "snippet")


def evidence_recall(selected: DataFrame, snippets: DataFrame) -> DataFrame:
    """(query_id, evidence_recall): the share of a question's snippets that its selected passages hold."""
    found = containing(selected, snippets).select("query_id", "snippet").distinct().groupBy("query_id").agg(F.count("*").alias("found"))
    total = snippets.groupBy("query_id").agg(F.count("*").alias("n"))
    return total.join(found, "query_id", "left").select("query_id", (F.coalesce("found", F.lit(0)) / F.col("n")).alias("evidence_recall"))


#: Means that a summary of an evaluation gives, over the questions that have the value.
SUMMARISED = ("recall_1", "recall_3", "recall_5", "precision_1", "precision_3", "precision_5", "reciprocal_rank", "ndcg_5", "evidence_recall", "false_abstention", "abstained", "conflict_detected")


def evaluation_summary(records: DataFrame) -> DataFrame:
    """Means of ``records(mode, split, category, ...)`` by mode, by mode and split, and by mode and category, in one pass.

    ``grouping`` says which; of the columns of ``SUMMARISED`` those that are
    there are averaged to four digits, nulls left out.
    """
    there = [c for c in SUMMARISED if c in records.columns]
    grouped = records.groupingSets([["mode"], ["mode", "split"], ["mode", "category"]], "mode", "split", "category")
    level = F.when(F.grouping("split") == 0, "split").when(F.grouping("category") == 0, "category").otherwise("mode")
    return grouped.agg(level.alias("grouping"), F.count("*").alias("questions"), *(F.round(F.avg(F.col(c).cast("double")), 4).alias(c) for c in there))


def acceptance(summary: DataFrame, minima: dict[str, float], mode: str, leaks: int = 0, most_leaks: int = 0) -> DataFrame:
    """(metric, value, minimum, met, passed): whether the means of ``mode`` reach their minima, and whether all do without too many leaks."""
    row = summary.where((F.col("grouping") == "mode") & (F.col("mode") == mode))
    long = row.select(F.explode(F.array(*(F.struct(F.lit(k).alias("metric"), F.col(k).alias("value"), F.lit(float(v)).alias("minimum")) for k, v in sorted(minima.items())))).alias("c")).select("c.*")
    met = F.coalesce(F.col("value") >= F.col("minimum"), F.lit(False))
    return long.withColumn("met", met).withColumn("passed", F.bool_and("met").over(Window.partitionBy(F.lit(1))) & F.lit(leaks <= most_leaks))


def repeated_lines(pages: DataFrame, width: int = 80) -> DataFrame:
    """(doc, line, pages): short lines, digits as #, on at least two and three fifths of a document's ``pages(doc, page, text)``."""
    lines = pages.select("doc", "page", F.explode(F.split("text", "\n")).alias("line")).withColumn("line", F.regexp_replace(F.lower(F.trim("line")), r"\d+", "#"))
    short = lines.where((F.length("line") > 0) & (F.length("line") <= width)).distinct()
    counted = short.groupBy("doc", "line").agg(F.count("*").alias("pages"))
    total = pages.groupBy("doc").agg(F.count_distinct("page").alias("total"))
    return counted.join(total, "doc").where(F.col("pages") >= F.greatest(F.lit(2), F.floor(0.6 * F.col("total")))).select("doc", "line", "pages")
