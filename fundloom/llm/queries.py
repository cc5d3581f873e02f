"""The queries of this package for ``__spark_entry__``, and their SQL twins."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fundloom.llm import align, covertree, decontaminate, licences, linedup, media, packing, quality, repair, simhash, tokencount, toxicity, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_tokencount(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The length of each document in flat token files, found by their separators."""
    found = tokencount.token_counts(table(spark, sf_dir, "documents"), from_files=True)
    return found.select("doc_id", "n_tokens", "complete")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade, and the probability of a grade of 1 or more, from the ``quality`` grades of ``labels``."""
    ratings = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("grade"))
    found = quality.quality(table(spark, sf_dir, "documents"), ratings)
    score = F.col("tail_probability")
    return found.withColumn("score", score).withColumn("predicted", F.when(score >= 0.5, 1).otherwise(0))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of benchmark windows in each document; null texts have no words, long ones are searched whole (``decontaminate.decontaminate``)."""
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join(F.array_sort("items"), ","), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of three-word shingles and components within two bits; texts without words have fingerprint zero (``simhash.near_duplicates``)."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text, learned from ``labels.toxic`` of rows that aren't held out; empty texts are scored too (``toxicity.toxicity``)."""
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens; a null text is its end id alone (``packing.pack_documents``)."""
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as WARC archives and read back; null html is an empty payload, a gap is an error (``warc.archive_round_trip``)."""
    return warc.archive_round_trip(table(spark, sf_dir, "pages"))


def op8_linedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without later copies of repeated line runs; null texts stay null (``linedup.without_repeats``)."""
    found = linedup.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_deleted", "words_deleted", "text")


def op9_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence that each document states or inherits from a directory above; empty texts state none (``licences.scan_licences``)."""
    docs = table(spark, sf_dir, "documents")
    return licences.scan_licences(docs.select("doc_id", licences.corpus_path(docs).alias("path"), "text"))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts stored as lossless WebP images and read back; null and empty texts are 192 spaces (``media.media_round_trip``)."""
    return media.media_round_trip(table(spark, sf_dir, "documents"))


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damaged conversations with their faults and cheapest repairs; conversations that lost all rows are told too (``repair.repair_reports``)."""
    given = table(spark, sf_dir, "conversations")
    return repair.repair_reports(repair.damage(given), given)


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of two vocabularies over each text, their groups, and how their links rank in the corpus; texts without tokens have zeros (``align.aligned``)."""
    return align.aligned(table(spark, sf_dir, "documents"))


def op13_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, components and representatives of vectors with a cosine of 0.95 or more; vectors without a direction link with nothing (``covertree.near_duplicate_vectors``)."""
    return covertree.near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_tokencount, op2_quality, op3_decontamination, op4_simhash, op5_toxicity, op6_packing, op7_warc, op8_linedup, op9_licences, op10_media, op11_repair, op12_alignment, op13_vectors)}


#: Words, windows, occurrences and covered words, as the contract of the query states them.
OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
p AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS s
  FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
o AS (
  SELECT DISTINCT c.r, c.i, c.n, p.item
  FROM (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS s
        FROM (SELECT d.r, d.w, m.n, unnest(range(1, len(d.w) - m.n + 2)) AS i
              FROM d, (SELECT DISTINCT n FROM p) m WHERE len(d.w) >= m.n)) c
  JOIN p ON c.n = p.n AND c.s = p.s),
h AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS x FROM o) GROUP BY r),
g AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, item FROM o) GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(g.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(g.names, '')) AS items_sha256,
       coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON d.r = h.r LEFT JOIN g ON d.r = g.r
"""


OP7_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, sha1(b) AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> first THEN first END AS refers_to
FROM m
"""

#: All runs of lines with 50 words or more, from one line to another, instead of a suffix array.
OP8_SQL = r"""
WITH d AS (SELECT doc_id, text, row_number() OVER () AS r FROM documents),
x AS (SELECT doc_id, r, generate_subscripts(ls, 1) - 1 AS no, trim(unnest(ls)) AS line
      FROM (SELECT doc_id, r, string_split(text, chr(10)) AS ls FROM d)),
l AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY no) - 1 AS seq,
             len(regexp_extract_all(line, '\S+')) AS words FROM x WHERE line <> ''),
f AS (SELECT line FROM l GROUP BY line HAVING count(*) > 1),
s AS (SELECT l.*, sum(words) OVER (PARTITION BY r ORDER BY seq) AS done FROM l),
k AS (SELECT s.*, seq - row_number() OVER (PARTITION BY r ORDER BY seq) AS stretch FROM s JOIN f USING (line)),
w AS (SELECT a.doc_id, a.r, a.seq AS i, b.seq AS j FROM k a JOIN k b
      ON a.r = b.r AND a.stretch = b.stretch AND b.seq >= a.seq AND b.done - a.done + a.words >= 50
      AND (b.done - b.words - a.done + a.words < 50 OR b.done - a.done < 50)),
n AS (SELECT w.doc_id, w.r, w.i, w.j, string_agg(k.line, chr(10) ORDER BY k.seq) AS run
      FROM w JOIN k ON w.r = k.r AND k.seq BETWEEN w.i AND w.j GROUP BY ALL),
e AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, i) AS copy FROM n),
g AS (SELECT DISTINCT k.r, k.no, k.words FROM e JOIN k ON e.r = k.r AND k.seq BETWEEN e.i AND e.j WHERE e.copy > 1),
t AS (SELECT r, count(*) AS n_deleted, sum(words) AS words_deleted, list(no) AS gone FROM g GROUP BY r)
SELECT d.doc_id,
       CAST(coalesce(len(list_filter(string_split(d.text, chr(10)), lambda y: trim(y) <> '')), 0) AS BIGINT) AS n_lines,
       CAST(coalesce(t.n_deleted, 0) AS BIGINT) AS n_deleted, CAST(coalesce(t.words_deleted, 0) AS BIGINT) AS words_deleted,
       CASE WHEN t.gone IS NULL THEN d.text
            ELSE array_to_string(list_filter(string_split(d.text, chr(10)), lambda y, q: NOT list_contains(t.gone, q - 1)), chr(10)) END AS text
FROM d LEFT JOIN t ON d.r = t.r
"""


#: The operator's definition with set operations: every sentence is compared with every template.
OP9_SQL = r"""
WITH t(template, licence, body, must) AS (VALUES @TEMPLATES@),
tt AS (SELECT template, licence, must, term, count(*) AS tf
       FROM (SELECT template, licence, must, unnest(regexp_extract_all(lower(body), '[a-z0-9]+')) AS term FROM t) GROUP BY ALL),
d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS r,
             concat_ws('/', coalesce(source, 'unknown'), coalesce(lang, 'unknown'),
                       coalesce(CAST(CAST(floor(doc_id / 1000) AS BIGINT) AS VARCHAR), 'none')) AS dir,
             coalesce(CAST(doc_id AS VARCHAR), 'none') || '.txt' AS base FROM documents),
w AS (SELECT r, len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS n_terms,
             list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS terms FROM d),
df AS (SELECT term, count(*) AS df FROM (SELECT unnest(terms) AS term FROM w) GROUP BY term),
n AS (SELECT count(*) AS n FROM d),
tw AS (SELECT template, licence, must, term, tf * (ln((n.n + 1.0::DOUBLE) / (coalesce(df.df, 0) + 1.0::DOUBLE)) + 1) AS w
       FROM tt LEFT JOIN df USING (term) CROSS JOIN n),
tn AS (SELECT template, sqrt(sum(w * w)) AS tn FROM tw GROUP BY template),
u AS (SELECT DISTINCT r, lines, body FROM (
        SELECT r, true AS lines, unnest(string_split(regexp_replace(part, '([.!?])\s+', '\1' || chr(10), 'g'), chr(10))) AS body
        FROM (SELECT r, unnest(string_split(text, chr(10))) AS part FROM d)
        UNION ALL
        SELECT r, false, unnest(string_split(regexp_replace(regexp_replace(part, '[ \t\r]*\n[ \t]*[#*/;%-]*[ \t]*', ' ', 'g'), '([.!?])\s+', '\1' || chr(10), 'g'), chr(10)))
        FROM (SELECT r, unnest(regexp_split_to_array(text, '\n[ \t\r#*/;%-]*\n')) AS part FROM d))),
ub AS (SELECT DISTINCT body FROM u),
ut AS (SELECT body, term, count(*) AS tf FROM (SELECT body, unnest(regexp_extract_all(lower(body), '[a-z0-9]+')) AS term FROM ub) GROUP BY ALL),
uw AS (SELECT body, term, tf * (ln((n.n + 1.0::DOUBLE) / (coalesce(df.df, 0) + 1.0::DOUBLE)) + 1) AS w FROM ut LEFT JOIN df USING (term) CROSS JOIN n),
un AS (SELECT body, sqrt(sum(w * w)) AS un FROM uw GROUP BY body),
s AS (SELECT uw.body, tw.template, tw.licence, sum(uw.w * tw.w) AS product FROM uw JOIN tw USING (term)
      GROUP BY ALL HAVING count(tw.must) = 0 OR bool_or(term = tw.must)),
c AS (SELECT body, licence, round(product / (un * tn), 6) AS cosine FROM s JOIN un USING (body) JOIN tn USING (template)
      WHERE round(product / (un * tn), 6) >= 0.6),
e AS (SELECT DISTINCT body, licence, cosine FROM c WHERE cosine = (SELECT max(cosine) FROM c c2 WHERE c2.body = c.body)),
v AS (SELECT r, licence, count(*) AS n, max(cosine) AS cosine FROM (SELECT DISTINCT r, body FROM u) JOIN e USING (body) GROUP BY ALL),
b AS (SELECT r, arg_min(licence, struct_pack(c := -cosine, n := -n, l := licence)) AS own,
             arg_min(cosine, struct_pack(c := -cosine, n := -n, l := licence)) AS cosine FROM v GROUP BY r),
m AS (SELECT r, count(DISTINCT body) AS n_mentions,
             greatest(coalesce(sum(CASE WHEN lines THEN len(regexp_extract_all(lower(body), '[a-z0-9]+')) END), 0),
                      coalesce(sum(CASE WHEN NOT lines THEN len(regexp_extract_all(lower(body), '[a-z0-9]+')) END), 0)) AS covered
      FROM u WHERE body IN (SELECT body FROM e) GROUP BY r),
o AS (SELECT r, own, cosine, n_mentions, covered FROM b JOIN m USING (r)),
f AS (SELECT d.dir, o.own, o.cosine FROM o JOIN d USING (r) JOIN w USING (r) WHERE o.covered >= 0.5 * w.n_terms),
h AS (SELECT dir AS above, arg_min(own, struct_pack(c := -cosine, l := own)) AS held FROM f GROUP BY dir),
a AS (SELECT dir, array_to_string(string_split(dir, '/')[1:k], '/') AS above, k
      FROM (SELECT DISTINCT dir FROM d), (SELECT unnest([0, 1, 2, 3]) AS k)),
i AS (SELECT dir, arg_max(above, k) AS above, arg_max(held, k) AS held FROM a JOIN h USING (above) GROUP BY dir)
SELECT d.doc_id, d.dir || '/' || d.base AS path, coalesce(o.own, i.held) AS licence, o.cosine,
       CAST(coalesce(o.n_mentions, 0) AS BIGINT) AS n_mentions,
       CASE WHEN o.own IS NOT NULL THEN 'own' WHEN i.held IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
       CASE WHEN o.own IS NULL THEN i.above END AS licensed_by
FROM d LEFT JOIN o USING (r) LEFT JOIN i USING (dir)
"""


#: The crc32 bit by bit; weights are texts of a cost and a label string, so that the least text is the least weight.
OP11_SQL = r"""
WITH RECURSIVE g AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
h AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(name, ''),
          lambda c: [ord(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
        lambda x, y: xor(xor(x, y) >> 1, 3988292384 * (xor(x, y) & 1))), 4294967295) % 20 AS kind FROM g),
m AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
             CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
             unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM h),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text)) AS i,
             rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t FROM m),
d AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, left(role, 1) AS r,
             lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM o),
f AS (SELECT *, CASE WHEN t = '' THEN 'b' WHEN again THEN 'd' WHEN right(t, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault FROM d),
c AS (SELECT conv_id, count(*) AS n, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
             count(*) FILTER (fault = 't') AS truncated,
             count(*) FILTER (before IS NOT NULL AND before || r NOT IN ('su', 'ua', 'au')) AS illegal,
             coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps FROM f GROUP BY conv_id),
-- Distances to the end before row i, of the four grammar states (nothing, after s, after u, after a), insertions done.
w(conv_id, i, a0, a1, a2, a3) AS (
  SELECT conv_id, n + 1, '000000000', '000000010II', '000000005I', '000000000' FROM c
  UNION ALL
  SELECT conv_id, i, least(x0, add(x2, 5, 'I'), add(x3, 10, 'II')), least(x1, add(x2, 5, 'I'), add(x3, 10, 'II')),
         least(x2, add(x3, 5, 'I')), least(x3, add(x2, 5, 'I'))
  FROM (SELECT w.conv_id, f.i,
          least(add(a0, 2, 'D'), CASE WHEN ok AND r = 's' THEN add(a1, stay, 'K') END, CASE WHEN ok AND r = 'u' THEN add(a2, stay, 'K') END, CASE WHEN ok THEN add(a2, stay + 1, 'R') END) AS x0,
          least(add(a1, 2, 'D'), CASE WHEN ok AND r = 'u' THEN add(a2, stay, 'K') END, CASE WHEN ok THEN add(a2, stay + 1, 'R') END) AS x1,
          least(add(a2, 2, 'D'), CASE WHEN ok AND r = 'a' THEN add(a3, stay, 'K') END, CASE WHEN ok THEN add(a3, stay + 1, 'R') END) AS x2,
          least(add(a3, 2, 'D'), CASE WHEN ok AND r = 'u' THEN add(a2, stay, 'K') END, CASE WHEN ok THEN add(a2, stay + 1, 'R') END) AS x3
        FROM w JOIN (SELECT *, fault NOT IN ('b', 'd') AS ok, CASE WHEN fault = 't' THEN 5 ELSE 0 END AS stay FROM f) f
          ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i - 1)),
p AS (SELECT c.*, CAST(left(a0, 9) AS BIGINT) AS cost, substr(a0, 10) AS audit FROM w JOIN c ON c.conv_id IS NOT DISTINCT FROM w.conv_id WHERE w.i = 1),
e AS (SELECT conv_id, audit, k, audit[k] AS edit, len(translate(audit, 'D', '')) AS made,
             len(translate(audit[1:k], 'D', '')) AS place, len(translate(audit[1:k], 'I', '')) AS i
      FROM (SELECT conv_id, audit, unnest(range(1, len(audit) + 1)) AS k FROM p)),
s AS (SELECT e.conv_id, string_agg(CASE WHEN edit = 'K' THEN f.role WHEN (place - made) % 2 = 0 THEN 'assistant' ELSE 'user' END
                 || ':' || CASE WHEN edit = 'I' THEN '' ELSE f.text END, chr(10) ORDER BY k) AS body
      FROM e LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM e.conv_id AND f.i = e.i WHERE edit <> 'D' GROUP BY e.conv_id)
SELECT a.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit,
       sha256(coalesce(body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a
LEFT JOIN p ON p.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM a.conv_id
"""
# DuckDB has no local functions in a single statement: add(weight, cost, label) is written out.
OP11_SQL = re.sub(r"add\((\w+), ([\w +]+), ('\w+')\)", r"(printf('%09d', CAST(left(\1, 9) AS INTEGER) + \2) || \3 || substr(\1, 10))", OP11_SQL)


#: Every pair of vectors, and all that can be reached by links.
OP13_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, row_number() OVER () AS r FROM embeddings),
g AS (SELECT * FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.r AS a, b.r AS b FROM g a JOIN g b ON a.r <> b.r AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
c(a, b) AS (SELECT a, b FROM l UNION SELECT c.a, l.b FROM c JOIN l ON c.b = l.a),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a),
m AS (SELECT c.a, min(v.vec_id) AS least FROM c JOIN v ON v.r = c.b GROUP BY c.a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, least(vec_id, m.least) AS component_id, vec_id IS NOT DISTINCT FROM least(vec_id, m.least) AS kept
FROM v LEFT JOIN n ON n.a = v.r LEFT JOIN m ON m.a = v.r
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_decontamination": OP3_SQL, "op7_warc": OP7_SQL, "op8_linedup": OP8_SQL, "op11_repair": OP11_SQL, "op13_vectors": OP13_SQL, "op9_licences": OP9_SQL.replace("@TEMPLATES@", licences.template_values())}
