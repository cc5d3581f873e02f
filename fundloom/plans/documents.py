"""Queries on documents, retrieval and conversations, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fundloom.functions import stemming
from fundloom.functions import text as tx
from fundloom.operators import catalogue, chunking, hybrid, lexical, neighbours, retrieval
from fundloom.plans.common import Query, named, rounded
from fundloom.sources.adapters import table
from fundloom.storage import written


#: Mail addresses, plainly.
MAIL = r"[\w.+-]+@[\w-]+\.[\w.]+"


def _passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("passage_id"), "doc_id", F.col("text").alias("content"))


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))


def _vector_queries(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    v = table(spark, sf_dir, "embeddings")
    return v.where("vec_id % 100 = 0"), v


def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("s", tx.sentences(F.col("text")))
    return docs.select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.try_element_at("s", F.lit(-1)).alias("last"))


def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_documents(table(spark, sf_dir, "documents"))


def injection_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", tx.looks_like_instructions(F.col("text")).alias("flagged"))


def lexeme_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.document_frequencies(_passages(spark, sf_dir))


def lexical_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.lexical_search(_questions(spark, sf_dir), _passages(spark, sf_dir))


def lexeme_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.lexeme_places(_passages(spark, sf_dir)).withColumn("places", F.array_join("places", ","))


def cover_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages that hold both words of a phrase, by how close they stand: the first two longer words of each benchmark text."""
    words = F.filter(F.split("question", r"[^\p{L}\p{N}]+"), lambda w: F.length(w) > 3)
    phrases = _questions(spark, sf_dir).select("query_id", F.array_join(F.slice(words, 1, 2), " ").alias("question"))
    return lexical.lexical_search(phrases, _passages(spark, sf_dir), every=True)


def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.vector_search(*_vector_queries(spark, sf_dir), most=10)


def vector_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest ten by the inverted lists, for the questions of ``vector_topk``."""
    queries, vectors = _vector_queries(spark, sf_dir)
    lists = neighbours.fit(vectors)
    return neighbours.approximate_search(queries, neighbours.indexed(vectors, lists), lists, most=10)


def _question_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A benchmark text's vector is the one whose id is that of the text; a document's, the one with its id."""
    v = table(spark, sf_dir, "embeddings")
    return v.join(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("vec_id")), "vec_id", "left_semi")


def _fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lexical list and the vector list of each question, fused."""
    near = retrieval.vector_search(_question_vectors(spark, sf_dir), table(spark, sf_dir, "embeddings"))
    return retrieval.fused(near, lexical_topk(spark, sf_dir))


def _placed(rows: DataFrame) -> DataFrame:
    """A fund, a type and a date for each passage of ``rows``, by its id; the last question words say which period is asked for."""
    made = F.date_add(F.lit("2025-01-01").cast("date"), (F.col("passage_id") % 300).cast("int"))
    return rows.withColumn("fund_id", F.col("passage_id") % 5).withColumn("doc_type", F.lit("report")).withColumn("as_of_date", made)


def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(spark, sf_dir).select("query_id", "passage_id", "score", "fused_rank")


def evidence_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of the fund (id mod 5) that the question (id mod 5) names are eligible, as are those of fund 0."""
    own = (F.col("passage_id") % 5 == 0) | (F.col("passage_id") % 5 == F.col("query_id") % 5)
    return retrieval.evidence(_fused(spark, sf_dir).withColumn("eligible", own)).select("query_id", "passage_id", "eligible", "supported")


def latest_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions of every third id name a period, those of the next ask for the latest one."""
    period, latest = F.col("query_id") % 3 == 0, F.col("query_id") % 3 == 1
    rows = retrieval.boosted(_placed(_fused(spark, sf_dir)), F.col("fund_id") == F.col("query_id") % 5, period, latest)
    return rounded(rows.select("query_id", "passage_id", "boost"))


def final_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fused score times the boost, gated by evidence, supported passages first."""
    own = (F.col("passage_id") % 5 == 0) | (F.col("passage_id") % 5 == F.col("query_id") % 5)
    rows = retrieval.boosted(_placed(_fused(spark, sf_dir)), F.col("fund_id") == F.col("query_id") % 5, F.lit(False), F.lit(True))
    rows = retrieval.ranked(rows.drop("fused_rank").withColumn("final_score", F.round(F.col("score") * F.col("boost"), 12)), "final_score", "fused_rank")
    gated = retrieval.supported_first(retrieval.evidence(rows.withColumn("eligible", own)))
    return gated.select("query_id", "passage_id", "final_score", "supported", "final_rank")


def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lexical_topk(spark, sf_dir).join(_passages(spark, sf_dir), "passage_id")
    return retrieval.near_duplicates(found)


def context_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = retrieval.evidence(_fused(spark, sf_dir).withColumn("eligible", F.lit(True)))
    return retrieval.select_context(rows.join(_passages(spark, sf_dir), "passage_id"))


def extractive_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Excerpts of the three best passages of each benchmark text; documents hold prose, no tables."""
    found = lexical_topk(spark, sf_dir).join(_passages(spark, sf_dir), "passage_id").join(_questions(spark, sf_dir), "query_id")
    rows = found.withColumn("is_table", F.lit(False)).withColumn("place", F.col("lexical_rank"))
    return retrieval.excerpts(rows)


def conflict_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lexical_topk(spark, sf_dir).where("lexical_rank <= 6").withColumn("fund_id", F.col("passage_id") % 5).withColumn("as_of_date", F.date_add(F.lit("2025-01-01").cast("date"), (F.col("passage_id") % 3).cast("int")))
    return retrieval.conflicts(rows).withColumn("dates", F.array_join(F.transform("dates", lambda d: d.cast("string")), ","))


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vector search judged by labels: a vector is relevant to one of the same label, itself included."""
    queries, vectors = _vector_queries(spark, sf_dir)
    ranks = retrieval.vector_search(queries, vectors, most=10).select("query_id", "passage_id", F.col("vector_rank").alias("rank"))
    label = vectors.select(F.col("vec_id").alias("passage_id"), F.col("label").alias("found"))
    asked = queries.select(F.col("vec_id").alias("query_id"), "label").where("label IS NOT NULL")
    # Labels are looked up for the ranked vectors only, and counted for the rest.
    hits = ranks.join(label, "passage_id").join(asked, "query_id").where("found = label")
    totals = asked.join(vectors.groupBy("label").agg(F.count("*").alias("n_relevant")), "label").drop("label")
    return retrieval.retrieval_metrics(ranks, hits, totals)


def ir_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_judged(spark, sf_dir))


def _library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their states: every tenth is pending, every third is private to one of seven owners."""
    d = table(spark, sf_dir, "documents")
    made = F.date_add(F.lit("2025-01-01").cast("date"), (F.col("doc_id") % 300).cast("int"))
    return d.select("doc_id", F.when(F.col("doc_id") % 10 == 9, "pending").otherwise("indexed").alias("status"), F.when(F.col("doc_id") % 3 == 0, "private").otherwise("shared").alias("visibility"), (F.col("doc_id") % 7).alias("owner_id"), F.concat(F.lit("Document "), "doc_id").alias("title"), (F.col("doc_id") % 5).alias("fund_id"), F.lit("report").alias("doc_type"), made.alias("as_of_date"))


def _snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _questions(spark, sf_dir).select("query_id", F.explode(tx.sentences(F.col("question"))).alias("snippet"))


def evaluation_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark texts asked by user 2 in three modes; their sentences are what a relevant document holds."""
    found = hybrid.evaluate(_questions(spark, sf_dir), _snippets(spark, sf_dir), _passages(spark, sf_dir), _library(spark, sf_dir), F.lit(2))
    return rounded(found)


def chunk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User 2's hybrid search over the chunks of all documents: what is found, and what is chosen for the context."""
    chunks = chunking.chunk_documents(table(spark, sf_dir, "documents"))
    passages = chunks.select((F.col("doc_id") * 100_000 + F.col("chunk_index")).alias("passage_id"), "doc_id", "content", "heading", "page_start")
    found = hybrid.retrieve(_questions(spark, sf_dir), passages, _library(spark, sf_dir), F.lit(2))
    return found.select("query_id", "passage_id", "title", "heading", "page_start", "coverage", "similarity", "final_score", "supported", "final_rank", "position")


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evaluation's records with a split and a category: the fifth with ids divisible by five is held out, categories are by length."""
    items = _questions(spark, sf_dir).select("query_id", F.when(F.col("query_id") % 5 == 0, "holdout").otherwise("dev").alias("split"), F.when(F.length("question") < 300, "short").otherwise("long").alias("category"))
    return written(evaluation_records(spark, sf_dir).join(items, "query_id"), "records")


def evaluation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.evaluation_summary(_records(spark, sf_dir))


def evaluation_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The means of the hybrid mode against the published minima; one leak fails all."""
    records = _records(spark, sf_dir)
    minima = {"recall_5": 0.8, "reciprocal_rank": 0.7, "abstained": 0.8}
    leaks = records.agg(F.sum("leaked").alias("leaks"))
    checks = retrieval.acceptance(retrieval.evaluation_summary(records), minima, "hybrid").join(F.broadcast(leaks))
    return checks.withColumn("passed", F.col("passed") & (F.col("leaks") == 0))


def evidence_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of a benchmark text's sentences that its three best passages hold, in any case and spacing."""
    asked = _questions(spark, sf_dir)
    snippets = asked.select("query_id", F.explode(tx.sentences(F.col("question"))).alias("snippet")).distinct()
    best = lexical_topk(spark, sf_dir).where("lexical_rank <= 3").join(_passages(spark, sf_dir), "passage_id")
    return rounded(retrieval.evidence_recall(best, snippets))


def document_rights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What user 2 and an administrator (user -1) may read and manage; every eleventh document has no owner."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, "private").otherwise("shared").alias("visibility"), F.when(F.col("doc_id") % 11 > 0, F.col("doc_id") % 7).alias("owner_id"))
    users = ((2, False), (-1, True))
    both = [retrieval.rights(d, F.lit(u), F.lit(a)).withColumn("user_id", F.lit(u)) for u, a in users]
    return both[0].unionByName(both[1]).select("doc_id", "user_id", "can_read", "can_manage")


def access_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    d = d.select("doc_id", F.when(F.col("doc_id") % 10 == 9, "pending").otherwise("indexed").alias("status"), F.when(F.col("doc_id") % 3 == 0, "private").otherwise("shared").alias("visibility"), (F.col("doc_id") % 7).alias("owner_id"))
    return d.where(retrieval.readable(d, F.lit(2)))


def boilerplate_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of one source and language in tens, as the pages of a document."""
    d = table(spark, sf_dir, "documents")
    pages = d.select(F.concat_ws("-", "source", "lang", F.floor(F.col("doc_id") / 100)).alias("doc"), F.col("doc_id").alias("page"), "text")
    return retrieval.repeated_lines(pages)


def follow_up_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's turn as a question after the one before; every other conversation names a year, and later turns begin like follow-ups."""
    asked = table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", F.concat(F.when(F.col("turn") % 4 == 2, "And ").otherwise(""), "text", F.when(F.col("conv_id") % 2 == 0, " 2024 now").otherwise("")).alias("question"))
    before = F.lag("question").over(Window.partitionBy("conv_id").orderBy("turn"))
    found = asked.withColumn("before", before).withColumn("p", tx.processed_question(F.col("question"), F.col("before")))
    return found.select("conv_id", "turn", F.col("p.is_follow_up").alias("follow_up"), F.col("p.mentions_period").alias("mentions_period"), F.col("p.wants_latest").alias("wants_latest"), F.length("p.retrieval_text").alias("n_chars"))


def secret_scrub(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the settings' secrets that stand in them, and whether they had one; here mail addresses are the secrets."""
    docs = table(spark, sf_dir, "documents")
    found = F.regexp_extract_all("text", F.lit(MAIL), F.lit(0))
    return docs.select("doc_id", F.sha2(tx.scrubbed(F.col("text"), F.array_distinct(found)), 256).alias("scrubbed_sha256"), F.size(found).cast("long").alias("n_secrets"))


def conversation_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last six turns of each conversation."""
    back = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn"), F.desc("role"), F.desc("text")))
    return table(spark, sf_dir, "conversations").withColumn("back", back).where("back <= 6").select("conv_id", "turn", "role", "back")


def number_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of orders' made-up answers that their sources don't give: signs, percents, rounding, years, small integers and marks."""
    o = table(spark, sf_dir, "orders")
    price = F.col("o_totalprice").cast("decimal(18,2)")
    source = F.concat(F.lit("The price was "), F.format_number("o_totalprice", 2), F.lit(" and v2.5 of x"), "o_orderkey", F.lit(" is no number."))
    answer = F.concat(F.lit("[S1] About "), F.round(price, 1).cast("string"), F.lit("%, or -"), "o_custkey", F.lit(" in 1998, 7 times; "), price.cast("string"), F.lit(" and +"), (F.col("o_orderkey") % 100).cast("string"), F.lit(".25 [T2]"))
    claimed, pool = tx.numbers(answer), tx.numbers(source)
    return o.select("o_orderkey", F.size(claimed).alias("n_numbers"), F.array_join(tx.ungrounded(claimed, pool), "|").alias("missing"))


def citation_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks of made-up answers, single and in groups; a turn has as many sources as its number and one calculation."""
    c = table(spark, sf_dir, "conversations")
    answer = F.concat(F.lit("As shown [S1, T"), F.col("turn"), F.lit("; S"), F.col("turn") + 1, F.lit("] and  [S"), F.col("turn") * 2, F.lit("][T1], not [1, 3] nor [S]."))
    sources = F.transform(F.sequence(F.lit(0), F.col("turn")), lambda i: F.concat(F.lit("S"), i))
    found = c.select("conv_id", "turn", "role", tx.checked_citations(answer, sources, F.array(F.lit("T1"))).alias("x"))
    joined = lambda n: F.array_join(f"x.{n}", ",").alias(n)
    return found.select("conv_id", "turn", "role", F.col("x.text").alias("text"), joined("used_sources"), joined("used_calculations"), joined("invalid_markers"))


def _named_funds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as funds, named by the words of their names; three plans to a family."""
    plan = F.when(F.col("p_partkey") % 3 == 0, " Fund - Direct").when(F.col("p_partkey") % 3 == 1, " Fund (Regular)").otherwise(" Index")
    family = F.initcap(F.array_join(F.slice(F.split("p_name", " "), 1, 2), " "))
    return table(spark, sf_dir, "part").where("p_name IS NOT NULL").select(F.col("p_partkey").alias("fund_id"), F.concat(F.lit("FS"), "p_partkey").alias("code"), F.concat(family, plan).alias("name"))


def fund_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.fund_aliases(_named_funds(spark, sf_dir))


def fund_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions that name a fund by its code, its name, or in part."""
    funds = _named_funds(spark, sf_dir)
    asked = funds
    question = F.when(F.col("fund_id") % 20 == 0, F.concat(F.lit("What is the NAV of "), "code", F.lit("?"))).otherwise(F.concat(F.lit("How did "), F.regexp_replace("name", catalogue.PLAN_SUFFIX, ""), F.lit(" do, and pre-"), "code", F.lit("?")))
    return catalogue.mentioned_funds(asked.select(F.col("fund_id").alias("query_id"), question.alias("question")), catalogue.fund_aliases(funds))


def queries() -> dict[str, Query]:
    return named(sentence_split, chunk_documents, injection_flags, lexeme_df, lexeme_positions, lexical_topk, cover_density, vector_topk, vector_index, rrf_fusion, evidence_gate, latest_boost, final_ranking, near_duplicates, context_selection, extractive_excerpts, conflict_detection, ir_metrics, evaluation_records, chunk_search, evaluation_summary, evaluation_gate, evidence_recall, access_filter, document_rights, boilerplate_lines, follow_up_detection, secret_scrub, conversation_history, number_grounding, citation_check, fund_aliases, fund_mentions)


_STOP = "['" + "', '".join(tx.STOP_WORDS) + "']"


def _lexemes(c: str) -> str:
    return f"list_filter(list_distinct(regexp_extract_all(lower({c}), '[a-z0-9]+')), lambda w: NOT list_contains({_STOP}, w))"


#: The stemmer's rules as layers of regular expressions over distinct words; suffixes are the leftmost, so the longest, match.
_SHORT = "regexp_matches({}, '(^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$')"
_REGION = "nullif(length(regexp_extract({}, '^[^aeiouy]*[aeiouy]+[^aeiouy]')), 0)"


def _suffix(c: str, endings) -> str:
    return f"regexp_extract({c}, '(" + "|".join(endings) + ")$')"


def _cases(c: str, table: dict[str, str]) -> str:
    return f"CASE {c} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in table.items()) + " END"


def _listed(words) -> str:
    return ", ".join(f"'{w}'" for w in sorted(words))


def _stems(words: str) -> str:
    """CTEs that end in ``stems(w, lexeme)`` for the words of ``words``, stop words left out."""
    return rf"""
sw AS (SELECT DISTINCT w FROM ({words}) WHERE w <> '' AND w NOT IN ({_listed(stemming.STOP_WORDS)})),
s0 AS (SELECT w, regexp_replace(w, '(^|[aeiouy])y', '\1Y', 'g') AS y FROM sw WHERE length(w) > 2 AND w NOT IN ({_listed(stemming.WHOLE)})),
s1 AS (SELECT *, CASE WHEN y LIKE 'gener%' OR y LIKE 'arsen%' THEN 5 WHEN y LIKE 'commun%' THEN 6 ELSE coalesce({_REGION.format("y")}, length(y)) END AS r1 FROM s0),
s2 AS (SELECT *, r1 + coalesce({_REGION.format("substr(y, r1 + 1)")}, length(y) - r1) AS r2 FROM s1),
s3 AS (SELECT w, r1, r2, CASE WHEN y LIKE '%sses' THEN left(y, -2) WHEN y LIKE '%ied' OR y LIKE '%ies' THEN left(y, CASE WHEN length(y) > 4 THEN -2 ELSE -1 END)
         WHEN y LIKE '%s' AND y NOT LIKE '%us' AND y NOT LIKE '%ss' AND regexp_matches(left(y, -2), '[aeiouy]') THEN left(y, -1) ELSE y END AS a FROM s2),
s4 AS (SELECT *, {_suffix("a", ("eedly", "ingly", "edly", "eed", "ing", "ed"))} AS e FROM s3),
s5 AS (SELECT *, left(a, length(a) - length(e)) AS t FROM s4),
s6 AS (SELECT w, r1, r2, a, CASE WHEN e LIKE 'eed%' THEN CASE WHEN length(t) >= r1 THEN t || 'ee' ELSE a END
         WHEN e <> '' AND regexp_matches(t, '[aeiouy]') THEN CASE WHEN regexp_matches(t, '(at|bl|iz)$') THEN t || 'e' WHEN regexp_matches(t, '({"|".join(stemming.DOUBLES)})$') THEN left(t, -1)
           WHEN length(t) <= r1 AND {_SHORT.format("t")} THEN t || 'e' ELSE t END ELSE a END AS b FROM s5),
s7 AS (SELECT *, CASE WHEN length(b) > 2 AND regexp_matches(b, '[^aeiouy][yY]$') THEN left(b, -1) || 'i' ELSE b END AS c FROM s6),
s8 AS (SELECT *, {_suffix("c", stemming.STEP2)} AS e FROM s7),
s9 AS (SELECT w, r1, r2, a, CASE WHEN e <> '' AND length(c) - length(e) >= r1 AND NOT (e = 'ogi' AND NOT regexp_matches(c, 'logi$')) AND NOT (e = 'li' AND NOT regexp_matches(c, '[cdeghkmnrt]li$'))
         THEN left(c, length(c) - length(e)) || {_cases("e", stemming.STEP2)} ELSE c END AS d FROM s8),
s10 AS (SELECT *, {_suffix("d", stemming.STEP3)} AS e FROM s9),
s11 AS (SELECT w, r1, r2, a, CASE WHEN e <> '' AND length(d) - length(e) >= CASE WHEN e = 'ative' THEN r2 ELSE r1 END THEN left(d, length(d) - length(e)) || {_cases("e", stemming.STEP3)} ELSE d END AS f FROM s10),
s12 AS (SELECT *, {_suffix("f", stemming.STEP4)} AS e FROM s11),
s13 AS (SELECT w, r1, r2, a, CASE WHEN e <> '' AND length(f) - length(e) >= r2 AND NOT (e = 'ion' AND NOT regexp_matches(f, '[st]ion$')) THEN left(f, length(f) - length(e)) ELSE f END AS g FROM s12),
stems AS (SELECT w, replace(CASE WHEN a IN ({_listed(stemming.KEPT)}) THEN a WHEN g LIKE '%e' AND (length(g) - 1 >= r2 OR (length(g) - 1 >= r1 AND NOT {_SHORT.format("left(g, -1)")})) THEN left(g, -1)
            WHEN g LIKE '%ll' AND length(g) - 1 >= r2 THEN left(g, -1) ELSE g END, 'Y', 'y') AS lexeme FROM s13
          UNION ALL SELECT w, coalesce({_cases("w", stemming.WHOLE)}, w) FROM sw WHERE length(w) <= 2 OR w IN ({_listed(stemming.WHOLE)}))"""


_WORDS = r"list_filter(string_split_regex(lower({}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
#: Words of documents with their places, and their stems with those of the questions' words.
_PLACES = f"""
dw AS (SELECT doc_id AS passage_id, unnest(ws) AS w, unnest(range(len(ws))) AS place FROM (SELECT doc_id, {_WORDS.format("text")} AS ws FROM documents)),
qw AS (SELECT DISTINCT item_id AS query_id, unnest({_WORDS.format("text")}) AS w FROM benchmark),
{_stems("SELECT w FROM dw UNION ALL SELECT w FROM qw UNION ALL SELECT unnest(['" + "', '".join(tx.REQUEST_WORDS) + "'])")},
req AS (SELECT lexeme FROM stems WHERE w IN ({_listed(tx.REQUEST_WORDS)})),
pl AS (SELECT passage_id, lexeme, place FROM dw JOIN stems USING (w)),
dfs AS (SELECT lexeme, count(DISTINCT passage_id) AS df FROM pl GROUP BY lexeme)"""
_LEXICAL = f"""{_PLACES},
qs AS (SELECT DISTINCT query_id, lexeme FROM qw JOIN stems USING (w) WHERE lexeme NOT IN (SELECT lexeme FROM req)),
ask AS (SELECT query_id, lexeme, ln(((SELECT count(*) FROM documents) + 1.0::DOUBLE) / (coalesce(df, 0) + 1.0::DOUBLE)) + 1 AS idf
        FROM (SELECT * FROM qs QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY lexeme) <= 40) LEFT JOIN dfs USING (lexeme)),
tot AS (SELECT query_id, sum(idf) AS total FROM ask GROUP BY query_id),
occ AS (SELECT query_id, passage_id, lexeme, any_value(idf) AS idf, count(*) AS n FROM pl JOIN ask USING (lexeme) GROUP BY ALL),
den AS (SELECT query_id, passage_id, round(0.1::DOUBLE * sum(n) / (1 + 0.1::DOUBLE * sum(n)), 9) AS density, sum(idf) AS share, count(*) AS matched FROM occ GROUP BY ALL),
top AS (SELECT den.*, sha256(text) AS digest FROM den JOIN documents ON doc_id = passage_id QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY density DESC, sha256(text), passage_id) <= 90),
hit AS (SELECT query_id, passage_id, round(share / total, 6) AS coverage, matched, density, digest FROM top JOIN tot USING (query_id)),
lex AS (SELECT query_id, passage_id, coverage, matched, density, CAST(row_number() OVER (PARTITION BY query_id ORDER BY coverage DESC, density DESC, digest, passage_id) AS INTEGER) AS lexical_rank FROM hit QUALIFY lexical_rank <= 30),
vec AS (SELECT * FROM (SELECT query_id, passage_id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, passage_id) AS vector_rank FROM (
  SELECT q.vec_id AS query_id, v.vec_id AS passage_id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) AS similarity
  FROM embeddings q, embeddings v WHERE q.vec_id IN (SELECT item_id FROM benchmark))) WHERE vector_rank <= 30),
fus AS (SELECT query_id, passage_id, coverage, similarity, round(coalesce(0.3::DOUBLE / (60 + vector_rank), 0) + coalesce(1.0::DOUBLE / (60 + lexical_rank), 0), 12) AS score FROM lex FULL JOIN vec USING (query_id, passage_id))"""
_VECTOR = """
nn AS (SELECT * FROM (SELECT query_id, passage_id, similarity, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, passage_id) AS INTEGER) AS vector_rank FROM (
  SELECT q.vec_id AS query_id, v.vec_id AS passage_id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) AS similarity
  FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0)) WHERE vector_rank <= 10)"""


_ALIASES = r"""
nf AS (SELECT p_partkey AS fund_id, 'FS' || p_partkey AS code, lower(array_to_string(string_split(p_name, ' ')[1:2], ' ')) || CASE WHEN p_partkey % 3 < 2 THEN ' fund' ELSE ' index' END AS base FROM part WHERE p_name IS NOT NULL),
wf AS (SELECT *, string_split(base, ' ') AS w FROM nf),
ca AS (SELECT fund_id, base AS family, unnest(list_distinct(list_filter([lower(code), base, CASE WHEN w[-1] = 'fund' THEN array_to_string(w[1:len(w) - 1], ' ') END, CASE WHEN len(w) >= 2 THEN array_to_string(w[1:2], ' ') END,
   CASE WHEN length(w[1]) >= 4 AND w[1] NOT IN (@GENERIC@) THEN w[1] END], lambda x: x IS NOT NULL AND x <> ''))) AS alias FROM wf),
al AS (SELECT fund_id, alias, family FROM ca JOIN (SELECT alias, count(DISTINCT family) AS n FROM ca GROUP BY alias) USING (alias) WHERE n = 1 OR contains(alias, ' '))""".replace("@GENERIC@", ", ".join(f"'{g}'" for g in catalogue.GENERIC))
_JUDGED = f"""{_VECTOR}, r AS (SELECT q.vec_id AS query_id, v.vec_id AS passage_id FROM embeddings q JOIN embeddings v USING (label) WHERE q.vec_id % 100 = 0),
t AS (SELECT query_id, count(*) AS n FROM r GROUP BY query_id),
h AS (SELECT query_id, count(*) FILTER (vector_rank <= 1) AS h1, count(*) FILTER (vector_rank <= 3) AS h3, count(*) FILTER (vector_rank <= 5) AS h5, max(1.0::DOUBLE / vector_rank) AS rr, sum(1 / log2(vector_rank + 1)) FILTER (vector_rank <= 5) AS dcg FROM nn JOIN r USING (query_id, passage_id) GROUP BY query_id),
judged AS (SELECT query_id, round(coalesce(h1, 0) / n, 6) AS recall_1, round(coalesce(h3, 0) / n, 6) AS recall_3, round(coalesce(h5, 0) / n, 6) AS recall_5, round(coalesce(h1, 0) / 1.0::DOUBLE, 6) AS precision_1, round(coalesce(h3, 0) / 3.0::DOUBLE, 6) AS precision_3,
  round(coalesce(h5, 0) / 5.0::DOUBLE, 6) AS precision_5, round(coalesce(rr, 0), 6) AS reciprocal_rank, round(coalesce(dcg, 0) / list_sum([1 / log2(i + 1) for i in range(1, least(n, 5) + 1)]), 6) AS ndcg_5 FROM t LEFT JOIN h USING (query_id))"""
_METRICS = ("recall_1", "recall_3", "recall_5", "precision_1", "precision_3", "precision_5", "reciprocal_rank", "ndcg_5")
_MODES = {"hybrid": (True, True), "vector": (True, False), "lexical": (False, True)}


def _evaluated() -> str:
    """The evaluation's records of user 2, written as the reference's rules state them: readable documents first, three modes, five ranks."""
    lib = "lib AS (SELECT doc_id, text, doc_id % 5 AS fund_id, doc_id % 300 AS day, 'Document ' || doc_id AS title FROM documents WHERE doc_id % 10 <> 9 AND (doc_id % 3 <> 0 OR doc_id % 7 = 2))"
    lexical = _LEXICAL[: _LEXICAL.rindex("vec AS (SELECT * FROM")].replace("FROM documents", "FROM lib").replace("JOIN documents", "JOIN lib")
    parts = []
    for mode, (near, words) in _MODES.items():
        parts.append(f"""
f_{mode} AS (SELECT query_id, passage_id, coverage, similarity, round(coalesce(0.3::DOUBLE / (60 + vector_rank), 0) + coalesce(1.0::DOUBLE / (60 + lexical_rank), 0), 12) AS score
  FROM (SELECT * FROM lex WHERE {str(words).lower()}) FULL JOIN (SELECT * FROM near WHERE {str(near).lower()}) USING (query_id, passage_id)),
b_{mode} AS (SELECT f.*, text, title, round(score * CASE WHEN NOT period AND day = max(day) OVER (PARTITION BY query_id, fund_id) THEN CASE WHEN wants THEN 1.25::DOUBLE ELSE 1.05 END ELSE 1 END, 12) AS final_score,
    max(coalesce(coverage, 0)) OVER (PARTITION BY query_id) AS bc, max(coalesce(similarity, 0)) OVER (PARTITION BY query_id) AS bs
  FROM f_{mode} f JOIN lib ON doc_id = passage_id JOIN asked USING (query_id)),
g_{mode} AS (SELECT *, (bc >= 0.5 AND coalesce(coverage, 0) >= greatest(0.3, 0.6::DOUBLE * bc)) OR (bs >= 0.6 AND coalesce(similarity, 0) >= greatest(0.52, bs - 0.08::DOUBLE)) AS supported FROM b_{mode}),
r_{mode} AS (SELECT query_id, passage_id, supported, row_number() OVER (PARTITION BY query_id ORDER BY supported DESC, final_score DESC, text, title, passage_id) AS rank FROM g_{mode}),
h_{mode} AS (SELECT '{mode}' AS mode, tot2.query_id, n, n_relevant, s1, s3, s5, h1, h3, h5, rr, dcg, supported
  FROM tot2 LEFT JOIN rel USING (query_id)
  LEFT JOIN (SELECT query_id, count(*) FILTER (rank <= 1) AS s1, count(*) FILTER (rank <= 3) AS s3, count(*) FILTER (rank <= 5) AS s5 FROM (SELECT query_id, t, min(rank) AS rank FROM r_{mode} JOIN hold USING (query_id, passage_id) GROUP BY ALL) GROUP BY query_id) USING (query_id)
  LEFT JOIN (SELECT query_id, count(*) FILTER (rank <= 1) AS h1, count(*) FILTER (rank <= 3) AS h3, count(*) FILTER (rank <= 5) AS h5, max(1.0::DOUBLE / rank) AS rr, sum(1 / log2(rank + 1)) FILTER (rank <= 5) AS dcg
             FROM r_{mode} WHERE (query_id, passage_id) IN (SELECT (query_id, passage_id) FROM hold) GROUP BY query_id) USING (query_id)
  LEFT JOIN (SELECT query_id, bool_or(supported) AS supported FROM r_{mode} GROUP BY query_id) USING (query_id))""")
    sentences = r"""list_filter([trim(x) FOR x IN string_split(regexp_replace(text, '([.!?])\s+([A-Z0-9("''])', '\1' || chr(1) || '\2', 'g'), chr(1))], lambda x: x <> '')"""
    return rf"""{lib}, {lexical}
asked AS (SELECT item_id AS query_id, regexp_matches(text, '(?i)\b(19|20)\d{{2}}\b|\b(jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)[a-z]*\b|\bfy\s?\d{{2}}') AS period,
          regexp_matches(text, '(?i)\b(latest|current|currently|now|recent|most recent|today)\b') AS wants
          FROM (SELECT item_id, substr(trim(regexp_replace(text, '\s+', ' ', 'g')), 1, 1000) AS text FROM benchmark)),
hv AS (SELECT lexeme, CAST(('0x' || md5(lexeme)[1:2]) AS INTEGER) AS d, 1 - 2 * (CAST(('0x' || md5(lexeme)[3:3]) AS INTEGER) & 1) AS sign FROM (SELECT DISTINCT lexeme FROM stems)),
pv AS (SELECT passage_id, d, sum(sign) AS v FROM pl JOIN hv USING (lexeme) GROUP BY ALL),
qwords AS (SELECT item_id AS query_id, unnest({_WORDS.format("text")}) AS w FROM benchmark),
qv AS (SELECT query_id, d, sum(sign) AS v FROM qwords JOIN stems USING (w) JOIN hv USING (lexeme) GROUP BY ALL),
pn AS (SELECT passage_id, sqrt(sum(v * v)) AS size FROM pv GROUP BY passage_id HAVING sum(v * v) > 0), qn AS (SELECT query_id, sqrt(sum(v * v)) AS size FROM qv GROUP BY query_id),
dots AS (SELECT query_id, passage_id, sum(qv.v * pv.v) AS dot FROM qv JOIN pv USING (d) GROUP BY ALL),
near AS (SELECT query_id, passage_id, round(coalesce(dot, 0) / (qn.size * pn.size), 6) AS similarity, row_number() OVER (PARTITION BY query_id ORDER BY round(coalesce(dot, 0) / (qn.size * pn.size), 6) DESC, passage_id) AS vector_rank
         FROM qn CROSS JOIN pn LEFT JOIN dots USING (query_id, passage_id) QUALIFY vector_rank <= 30),
sn AS (SELECT DISTINCT query_id, trim(regexp_replace(lower(t), '\s+', ' ', 'g')) AS t FROM (SELECT item_id AS query_id, unnest({sentences}) AS t FROM benchmark)),
tot2 AS (SELECT query_id, count(*) AS n FROM sn WHERE t <> '' GROUP BY query_id),
hold AS (SELECT query_id, t, doc_id AS passage_id FROM sn JOIN (SELECT doc_id, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS body FROM lib) ON t <> '' AND contains(body, t)),
rel AS (SELECT query_id, count(DISTINCT passage_id) AS n_relevant FROM hold GROUP BY query_id),{",".join(parts)},
judged2 AS (SELECT mode, query_id, CASE WHEN n_relevant > 0 THEN round(coalesce(s1, 0) / CAST(n AS DOUBLE), 6) END AS recall_1, CASE WHEN n_relevant > 0 THEN round(coalesce(s3, 0) / CAST(n AS DOUBLE), 6) END AS recall_3, CASE WHEN n_relevant > 0 THEN round(coalesce(s5, 0) / CAST(n AS DOUBLE), 6) END AS recall_5,
  CASE WHEN n_relevant > 0 THEN round(coalesce(h1, 0) / 1.0::DOUBLE, 6) END AS precision_1, CASE WHEN n_relevant > 0 THEN round(coalesce(h3, 0) / 3.0::DOUBLE, 6) END AS precision_3, CASE WHEN n_relevant > 0 THEN round(coalesce(h5, 0) / 5.0::DOUBLE, 6) END AS precision_5,
  CASE WHEN n_relevant > 0 THEN round(coalesce(rr, 0), 6) END AS reciprocal_rank, CASE WHEN n_relevant > 0 THEN round(coalesce(dcg, 0) / list_sum([1 / log2(i + 1) FOR i IN range(1, least(n_relevant, 5) + 1)]), 6) END AS ndcg_5,
  CASE WHEN n_relevant IS NULL THEN CASE WHEN coalesce(supported, false) THEN 0.0::DOUBLE ELSE 1.0 END END AS abstained, CASE WHEN n_relevant > 0 THEN CASE WHEN coalesce(supported, false) THEN 0.0::DOUBLE ELSE 1.0 END END AS false_abstention, 0 AS leaked
  FROM ({" UNION ALL ".join(f"SELECT * FROM h_{mode}" for mode in _MODES)})),
rec AS (SELECT judged2.*, CASE WHEN query_id % 5 = 0 THEN 'holdout' ELSE 'dev' END AS split, CASE WHEN length(text) < 300 THEN 'short' ELSE 'long' END AS category FROM judged2 JOIN benchmark ON item_id = query_id)"""


_SUMMARY = "SELECT mode, split, category, CASE WHEN grouping(split) = 0 THEN 'split' WHEN grouping(category) = 0 THEN 'category' ELSE 'mode' END AS \"grouping\", count(*) AS questions, " + ", ".join(f"round(avg({m}), 4) AS {m}" for m in (*_METRICS, "false_abstention", "abstained")) + " FROM rec GROUP BY GROUPING SETS ((mode), (mode, split), (mode, category))"


def oracle_sql() -> dict[str, str]:
    best = "max(CASE WHEN eligible THEN coalesce({}, 0) END) OVER (PARTITION BY query_id)"
    dup = "regexp_replace(lower(text), '^\\s+|\\s+$', '', 'g')"
    return {
        "sentence_split": r"""WITH s AS (SELECT doc_id, list_filter([trim(x) FOR x IN string_split(regexp_replace(text, '([.!?])\s+([A-Z0-9("''])', '\1' || chr(1) || '\2', 'g'), chr(1))], lambda x: x <> '') AS s FROM documents)
            SELECT doc_id, len(s) AS n_sentences, s[-1] AS last FROM s""",
        "injection_flags": "SELECT conv_id, turn, regexp_matches(text, '" + tx.INJECTION.replace("'", "''") + "') AS flagged FROM conversations",
        "lexeme_df": f"WITH {_PLACES} SELECT lexeme, df FROM dfs",
        "lexeme_positions": f"WITH {_PLACES} SELECT passage_id, lexeme, string_agg(CAST(place AS VARCHAR), ',' ORDER BY place) AS places FROM pl GROUP BY ALL",
        "lexical_topk": f"WITH {_LEXICAL} SELECT query_id, passage_id, coverage, matched, density, lexical_rank FROM lex",
        # A cover ends at a place and begins where the last of each lexeme before it is furthest back; of those with one beginning the first counts.
        "cover_density": f"""WITH {_PLACES}, ph AS (SELECT item_id AS query_id, unnest(list_filter(string_split_regex(text, '[^\\p{{L}}\\p{{N}}]+'), lambda x: length(x) > 3)[1:2]) AS w FROM benchmark),
            qs AS (SELECT DISTINCT query_id, lexeme FROM ph JOIN stems ON stems.w = lower(ph.w) WHERE lexeme NOT IN (SELECT lexeme FROM req)), many AS (SELECT query_id, count(*) AS n FROM qs GROUP BY query_id),
            ask AS (SELECT query_id, lexeme, ln(((SELECT count(*) FROM documents) + 1.0::DOUBLE) / (df + 1.0::DOUBLE)) + 1 AS idf FROM qs JOIN dfs USING (lexeme)),
            m AS (SELECT query_id, passage_id, lexeme, place FROM pl JOIN ask USING (lexeme)),
            e AS (SELECT a.query_id, a.passage_id, a.place AS j, b.lexeme, max(b.place) AS last FROM m a JOIN m b ON a.query_id = b.query_id AND a.passage_id = b.passage_id AND b.place <= a.place GROUP BY ALL),
            l AS (SELECT query_id, passage_id, j, min(last) AS i FROM e JOIN many USING (query_id) GROUP BY query_id, passage_id, j HAVING count(*) = any_value(n)),
            c AS (SELECT query_id, passage_id, i, min(j) AS j FROM l GROUP BY ALL),
            r AS (SELECT c.query_id, c.passage_id, i, c.j, 0.1::DOUBLE / (1 + (c.j - i) - (count(*) - 1)) AS part FROM c JOIN m ON m.query_id = c.query_id AND m.passage_id = c.passage_id AND place BETWEEN i AND c.j GROUP BY c.query_id, c.passage_id, i, c.j),
            t AS (SELECT query_id, passage_id, round(sum(part) / (1 + sum(part)), 9) AS density FROM r GROUP BY ALL),
            f AS (SELECT t.*, sha256(text) AS digest, n FROM t JOIN documents ON doc_id = passage_id JOIN many USING (query_id) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY density DESC, sha256(text), passage_id) <= 90)
            SELECT query_id, passage_id, 1.0::DOUBLE AS coverage, n AS matched, density, CAST(row_number() OVER (PARTITION BY query_id ORDER BY density DESC, digest, passage_id) AS INTEGER) AS lexical_rank FROM f QUALIFY lexical_rank <= 30""",
        "vector_topk": f"WITH {_VECTOR} SELECT * FROM nn",
        "rrf_fusion": f"WITH {_LEXICAL} SELECT query_id, passage_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, passage_id) AS INTEGER) AS fused_rank FROM fus",
        "evidence_gate": f"""WITH {_LEXICAL}, e AS (SELECT *, passage_id % 5 = 0 OR passage_id % 5 = query_id % 5 AS eligible FROM fus),
            b AS (SELECT *, coalesce({best.format("coverage")}, 0) AS bc, coalesce({best.format("similarity")}, 0) AS bs FROM e)
            SELECT query_id, passage_id, eligible, eligible AND ((bc >= 0.5 AND coalesce(coverage, 0) >= greatest(0.3, 0.6::DOUBLE * bc)) OR (bs >= 0.6 AND coalesce(similarity, 0) >= greatest(0.52, bs - 0.08::DOUBLE))) AS supported FROM b""",
        "latest_boost": f"""WITH {_LEXICAL}, d AS (SELECT query_id, passage_id, passage_id % 5 AS f, passage_id % 300 AS day FROM fus)
            SELECT query_id, passage_id, round(CASE WHEN f = query_id % 5 THEN 1.15::DOUBLE ELSE 1 END * CASE WHEN query_id % 3 <> 0 AND day = max(day) OVER (PARTITION BY query_id, f) THEN CASE WHEN query_id % 3 = 1 THEN 1.25::DOUBLE ELSE 1.05 END ELSE 1 END, 6) AS boost FROM d""",
        "final_ranking": f"""WITH {_LEXICAL}, d AS (SELECT *, passage_id % 5 AS f, passage_id % 300 AS day, passage_id % 5 = 0 OR passage_id % 5 = query_id % 5 AS eligible FROM fus),
            s AS (SELECT *, round(score * CASE WHEN f = query_id % 5 THEN 1.15::DOUBLE ELSE 1 END * CASE WHEN day = max(day) OVER (PARTITION BY query_id, f) THEN 1.25::DOUBLE ELSE 1 END, 12) AS final_score FROM d),
            b AS (SELECT *, coalesce({best.format("coverage")}, 0) AS bc, coalesce({best.format("similarity")}, 0) AS bs FROM s),
            g AS (SELECT *, eligible AND ((bc >= 0.5 AND coalesce(coverage, 0) >= greatest(0.3, 0.6::DOUBLE * bc)) OR (bs >= 0.6 AND coalesce(similarity, 0) >= greatest(0.52, bs - 0.08::DOUBLE))) AS supported FROM b)
            SELECT query_id, passage_id, final_score, supported, CAST(row_number() OVER (PARTITION BY query_id ORDER BY supported DESC, final_score DESC, passage_id) AS INTEGER) AS final_rank FROM g""",
        "extractive_excerpts": rf"""WITH {_LEXICAL}, q AS (SELECT item_id AS query_id, {_lexemes("text")} AS q FROM benchmark),
            sn AS (SELECT doc_id AS passage_id, list_filter([trim(x) FOR x IN string_split(regexp_replace(text, '([.!?])\s+([A-Z0-9("''])', '\1' || chr(1) || '\2', 'g'), chr(1))], lambda x: x <> '') AS s FROM documents),
            o AS (SELECT query_id, passage_id, lexical_rank AS place, q, s FROM lex JOIN q USING (query_id) JOIN sn USING (passage_id) WHERE lexical_rank <= 3),
            x AS (SELECT query_id, passage_id, place, q, s, unnest(s) AS t, generate_subscripts(s, 1) AS i FROM o),
            l AS (SELECT *, {_lexemes("t")} AS w FROM x),
            c AS (SELECT *, round(0.5::DOUBLE * coalesce(len(list_intersect(q, w)) / nullif(sqrt(len(q) * len(w)), 0), 0) + 0.5::DOUBLE * len(list_intersect(q, w)) / greatest(1, len(q)), 6) AS score FROM l),
            b AS (SELECT *, list_filter(string_split_regex(array_to_string(CASE WHEN t LIKE '%?' AND i < len(s) THEN s[i + 1:i + 3] ELSE s[i:i + 1] END, ' '), '\s+'), lambda y: y <> '') AS e
                  FROM c QUALIFY row_number() OVER (PARTITION BY query_id, passage_id ORDER BY score DESC, i) = 1)
            SELECT query_id, passage_id, place, array_to_string(e[1:90], ' ') || CASE WHEN len(e) > 90 THEN ' ...' ELSE '' END AS excerpt, score
            FROM b QUALIFY score >= 0.5::DOUBLE * arg_min(score, place) OVER (PARTITION BY query_id)""",
        "near_duplicates": f"""WITH {_LEXICAL}, w AS (SELECT doc_id AS passage_id, string_split_regex({dup}, '\\s+') AS w FROM documents WHERE trim(text) <> '' AND doc_id IN (SELECT passage_id FROM lex)),
            x AS (SELECT passage_id, len(w) AS n, array_to_string(w[1:4], ' ') AS short, unnest(w) AS x, unnest(range(len(w))) AS i FROM w),
            r AS (SELECT passage_id, n, i, CASE WHEN n < 5 THEN short ELSE concat_ws(' ', x, {", ".join(f"lead(x, {k}) OVER o" for k in range(1, 5))}) END AS t FROM x WINDOW o AS (PARTITION BY passage_id ORDER BY i)),
            s AS (SELECT query_id, passage_id, s FROM lex JOIN (SELECT passage_id, list(DISTINCT t) AS s FROM r WHERE i = 0 OR i <= n - 5 GROUP BY passage_id) USING (passage_id)),
            c AS (SELECT a.query_id, a.passage_id AS a, b.passage_id AS b, len(list_intersect(a.s, b.s)) AS i, len(a.s) + len(b.s) AS n FROM s a JOIN s b ON a.query_id = b.query_id AND a.passage_id < b.passage_id AND least(len(a.s), len(b.s)) >= 0.8::DOUBLE * greatest(len(a.s), len(b.s)))
            SELECT query_id, a, b, round(i / CAST(n - i AS DOUBLE), 6) AS similarity FROM c WHERE round(i / CAST(n - i AS DOUBLE), 6) >= 0.8""",
        "conflict_detection": f"""WITH {_LEXICAL} SELECT query_id, passage_id % 5 AS fund_id, string_agg(DISTINCT CAST(DATE '2025-01-01' + CAST(passage_id % 3 AS INTEGER) AS VARCHAR), ',' ORDER BY CAST(DATE '2025-01-01' + CAST(passage_id % 3 AS INTEGER) AS VARCHAR)) AS dates
            FROM lex WHERE lexical_rank <= 6 GROUP BY ALL HAVING count(DISTINCT passage_id % 3) > 1""",
        "ir_metrics": f"""WITH {_JUDGED} SELECT * FROM judged""",
        "evaluation_records": f"""WITH {_evaluated()} SELECT * FROM judged2""",
        "evaluation_summary": f"""WITH {_evaluated()} {_SUMMARY}""",
        "evaluation_gate": f"""WITH {_evaluated()}, s AS ({_SUMMARY}), hy AS (SELECT * FROM s WHERE "grouping" = 'mode' AND mode = 'hybrid'), lk AS (SELECT sum(leaked) AS leaks FROM judged2),
            c AS (SELECT 'recall_5' AS metric, recall_5 AS value, 0.8::DOUBLE AS minimum FROM hy UNION ALL SELECT 'reciprocal_rank', reciprocal_rank, 0.7::DOUBLE FROM hy UNION ALL SELECT 'abstained', abstained, 0.8::DOUBLE FROM hy)
            SELECT c.*, coalesce(value >= minimum, false) AS met, bool_and(coalesce(value >= minimum, false)) OVER () AND leaks = 0 AS passed, CAST(leaks AS BIGINT) AS leaks FROM c, lk""",
        "evidence_recall": rf"""WITH {_LEXICAL}, q AS (SELECT item_id AS query_id, [trim(x) FOR x IN string_split(regexp_replace(text, '([.!?])\s+([A-Z0-9("''])', '\1' || chr(1) || '\2', 'g'), chr(1))] AS s FROM benchmark),
            n AS (SELECT DISTINCT query_id, t FROM (SELECT query_id, unnest(s) AS t FROM q) WHERE t <> ''),
            p AS (SELECT query_id, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS body FROM lex JOIN documents ON doc_id = passage_id WHERE lexical_rank <= 3),
            f AS (SELECT DISTINCT n.query_id, t FROM n JOIN p USING (query_id) WHERE contains(body, trim(regexp_replace(lower(t), '\s+', ' ', 'g'))))
            SELECT query_id, round(count(f.t) / CAST(count(*) AS DOUBLE), 6) AS evidence_recall FROM n LEFT JOIN f USING (query_id, t) GROUP BY query_id""",
        "document_rights": """WITH d AS (SELECT doc_id, doc_id % 3 > 0 AS shared, CASE WHEN doc_id % 11 > 0 THEN doc_id % 7 END AS owner FROM documents), u(user_id, admin) AS (VALUES (2, false), (-1, true))
            SELECT doc_id, user_id, coalesce(owner = user_id, false) OR shared AS can_read, coalesce(owner = user_id, false) OR (owner IS NULL AND admin) AS can_manage FROM d, u""",
        "access_filter": "WITH d AS (SELECT doc_id, CASE WHEN doc_id % 10 = 9 THEN 'pending' ELSE 'indexed' END AS status, CASE WHEN doc_id % 3 = 0 THEN 'private' ELSE 'shared' END AS visibility, doc_id % 7 AS owner_id FROM documents) SELECT * FROM d WHERE status = 'indexed' AND (visibility = 'shared' OR owner_id = 2)",
        "boilerplate_lines": r"""WITH p AS (SELECT concat_ws('-', source, lang, CAST(floor(doc_id / 100) AS BIGINT)) AS doc, doc_id AS page, text FROM documents),
            l AS (SELECT DISTINCT doc, page, regexp_replace(lower(trim(line)), '\d+', '#', 'g') AS line FROM (SELECT doc, page, unnest(string_split(text, chr(10))) AS line FROM p)),
            c AS (SELECT doc, line, count(*) AS pages FROM l WHERE length(line) BETWEEN 1 AND 80 GROUP BY ALL), t AS (SELECT doc, count(DISTINCT page) AS total FROM p GROUP BY doc)
            SELECT doc, line, pages FROM c JOIN t USING (doc) WHERE pages >= greatest(2, floor(0.6::DOUBLE * total))""",
        "follow_up_detection": r"""WITH a AS (SELECT conv_id, turn, CASE WHEN turn % 4 = 2 THEN 'And ' ELSE '' END || text || CASE WHEN conv_id % 2 = 0 THEN ' 2024 now' ELSE '' END AS x FROM conversations WHERE role = 'user'),
            n AS (SELECT conv_id, turn, substr(trim(regexp_replace(regexp_replace(x, '[\x00-\x08\x0b-\x1f\x7f]', ' ', 'g'), '\s+', ' ', 'g')), 1, 1000) AS q FROM a),
            b AS (SELECT *, lag(q) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM n),
            c AS (SELECT *, coalesce(before IS NOT NULL AND len(list_filter(string_split(q, ' '), lambda w: w <> '')) <= 14 AND (regexp_matches(q, '(?i)^(and|also|what about|how about|and what|then|why|so)\b')
              OR regexp_matches(q, '(?i)\b(it|its|it''s|this|that|these|those|they|them|their|the fund|the scheme|this fund|that fund|same fund|the document|the factsheet|the report)\b')), false) AS follow_up FROM b)
            SELECT conv_id, turn, follow_up, regexp_matches(q, '(?i)\b(19|20)\d{2}\b|\b(jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)[a-z]*\b|\bfy\s?\d{2}') AS mentions_period,
                   regexp_matches(q, '(?i)\b(latest|current|currently|now|recent|most recent|today)\b') AS wants_latest, CAST(least(2000, CASE WHEN follow_up THEN length(before) + 1 ELSE 0 END + length(q)) AS INTEGER) AS n_chars FROM c""",
        "secret_scrub": rf"""WITH d AS (SELECT doc_id, text, regexp_extract_all(text, '{MAIL}') AS s FROM documents)
            SELECT doc_id, sha256(list_reduce(list_concat([text], list_distinct(s)), lambda x, y: replace(x, y, '[REDACTED]'))) AS scrubbed_sha256, len(s) AS n_secrets FROM d""",
        "conversation_history": "SELECT conv_id, turn, role, CAST(back AS INTEGER) AS back FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS back FROM conversations) WHERE back <= 6",
        # What the text gives, stated by value: the price to one digit is grounded, v2.5 and x... are no numbers.
        "number_grounding": r"""WITH o AS (SELECT o_orderkey, o_custkey, CAST(o_totalprice AS DECIMAL(18, 2)) AS price FROM orders),
            c AS (SELECT o_orderkey, price, unnest([struct_pack(raw := CAST(CAST(round(price, 1) AS DECIMAL(18, 1)) AS VARCHAR) || '%', v := CAST(round(price, 1) AS DOUBLE), d := 1),
                struct_pack(raw := '-' || o_custkey, v := -CAST(o_custkey AS DOUBLE), d := 0), struct_pack(raw := '1998', v := 1998.0::DOUBLE, d := 0), struct_pack(raw := '7', v := 7.0::DOUBLE, d := 0),
                struct_pack(raw := CAST(price AS VARCHAR), v := CAST(price AS DOUBLE), d := 2), struct_pack(raw := '+' || (o_orderkey % 100) || '.25', v := (o_orderkey % 100) + 0.25::DOUBLE, d := 2)]) AS x FROM o)
            SELECT o_orderkey, CAST(6 AS INTEGER) AS n_numbers, coalesce(string_agg(DISTINCT x.raw, '|' ORDER BY x.raw) FILTER (NOT (x.d = 0 AND (abs(x.v) <= 12 OR x.v BETWEEN 1900 AND 2100)) AND abs(x.v - CAST(price AS DOUBLE)) > 0.5::DOUBLE * pow(10.0::DOUBLE, -x.d) + 1e-9), '') AS missing
            FROM c GROUP BY o_orderkey""",
        "citation_check": r"""WITH a AS (SELECT conv_id, turn, role, 'As shown [S1, T' || turn || '; S' || (turn + 1) || '] and  [S' || (turn * 2) || '][T1], not [1, 3] nor [S].' AS t, list_concat(['T1'], [('S' || i) FOR i IN range(0, turn + 1)]) AS known FROM conversations),
            g AS (SELECT *, flatten([regexp_extract_all(x, '[ST]\d{1,3}') FOR x IN regexp_extract_all(t, '\[[ST]\d{1,3}(?:\s*[,;]\s*[ST]\d{1,3})*\]')]) AS m,
                         'As shown [S1][T' || turn || '][S' || (turn + 1) || '] and  [S' || (turn * 2) || '][T1], not [1, 3] nor [S].' AS single FROM a),
            k AS (SELECT *, list_filter(m, lambda x: NOT list_contains(known, x)) AS bad, list_filter(m, lambda x: list_contains(known, x)) AS good FROM g),
            c AS (SELECT *, list_reduce(list_concat([single], list_distinct(bad)), lambda x, y: replace(x, '[' || y || ']', '')) AS cut, [m2 FOR m2 IN good IF starts_with(m2, 'S')] AS s FROM k)
            SELECT conv_id, turn, role, trim(regexp_replace(cut, '[ \t]{2,}', ' ', 'g')) AS text,
                   array_to_string(list_filter(s, lambda x, i: list_position(s, x) = i), ',') AS used_sources, CASE WHEN list_contains(good, 'T1') THEN 'T1' ELSE '' END AS used_calculations, array_to_string(bad, ',') AS invalid_markers FROM c""",
        "fund_aliases": f"WITH {_ALIASES} SELECT fund_id, alias, family FROM al",
        # Every question against every alias, with the guard at both ends.
        "fund_mentions": rf"""WITH {_ALIASES}, q AS (SELECT fund_id AS query_id, CASE WHEN fund_id % 20 = 0 THEN 'what is the nav of ' || lower(code) || '?' ELSE 'how did ' || base || ' do, and pre-' || lower(code) || '?' END AS question FROM nf),
            d AS (SELECT DISTINCT alias FROM al)
            SELECT DISTINCT query_id, fund_id FROM q JOIN d ON CASE WHEN contains(question, alias) THEN regexp_matches(question, '(^|[^\w-])' || alias || '([^\w-]|$)') ELSE false END JOIN al USING (alias)""",
    }
