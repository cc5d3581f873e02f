"""Lexical search: stemmed words with their places, cover density, and coverage by rarity.

Passages are (passage_id, content), questions (query_id, question). A word is
a run of letters and digits in lower case; stop words have a place and no
lexeme. A passage's places count its words from 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fundloom.functions.stemming import Stems
from fundloom.functions.text import REQUEST_WORDS
from fundloom.storage import written

#: Lexemes of a question that count, passages by density that are ranked by coverage, and the weight of a place.
MOST_LEXEMES, FETCHED, PLACE_WEIGHT = 40, 90, 0.1
#: Questions whose lexemes a task holds at once.
QUESTION_BLOCK = 5000
#: Bytes of text whose words are held at once, and lexemes of passages that meet questions at once, and candidates that wait to be ranked.
TOGETHER, MEETINGS, WAITING = 4 << 20, 1 << 18, 1 << 16
POSTINGS = "passage_id long, content_hash string, lexemes array<string>, places array<array<int>>"

_stems = Stems()


def words_with_places(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """(text of each word, its place, its lexeme's number, lexemes) of some texts, stop words left out."""
    split = pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")), r"[^\p{L}\p{N}]+")
    flat = split.flatten().dictionary_encode()
    names = flat.dictionary.to_pylist()
    numbers: dict[str, int] = {}
    code = np.array([-2 if not w else -1 if (s := _stems[w]) is None else numbers.setdefault(s, len(numbers)) for w in names] or [-2], np.int64)
    each = code[flat.indices.to_numpy(zero_copy_only=False)] if len(flat) else np.zeros(0, np.int64)
    text = np.repeat(np.arange(len(texts)), np.diff(split.offsets.to_numpy()))
    # Only the ends of a text can give empty words; they have no place.
    real = each > -2
    text, each = text[real], each[real]
    place = np.arange(len(text)) - np.searchsorted(text, text)
    kept = each >= 0
    return text[kept], place[kept], each[kept], list(numbers)


def _posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``POSTINGS`` from (passage_id, content): each passage's lexemes in order, with their places."""
    import hashlib

    for whole in batches:
        size = pc.fill_null(pc.binary_length(whole.column("content")), 0).to_numpy()
        part = np.cumsum(size) // TOGETHER
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(whole)]
        for at, to in zip(cuts, cuts[1:], strict=False):
            batch = whole.slice(at, to - at)
            text, place, code, names = words_with_places(batch.column("content"))
            # As a list: an array of texts would be as wide as the longest word.
            sorting = np.array(sorted(range(len(names)), key=names.__getitem__), np.int64)
            rank = np.empty(len(names), np.int64)
            rank[sorting] = np.arange(len(names))
            ordered = [names[k] for k in sorting.tolist()]
            key = text * max(1, len(names)) + (rank[code] if names else code)
            order = np.argsort(key, kind="stable")
            key, place = key[order], place[order]
            first = np.flatnonzero(np.diff(key, prepend=-1))
            of, lexeme = key[first] // max(1, len(names)), key[first] % max(1, len(names))
            ends = np.searchsorted(of, np.arange(len(batch) + 1)).astype(np.int32)
            places = pa.ListArray.from_arrays(pa.array(np.append(first, len(key)).astype(np.int32)), pa.array(place.astype(np.int32)))
            lexemes = pa.DictionaryArray.from_arrays(pa.array(lexeme), pa.array(ordered, pa.string())).cast(pa.string()) if names else pa.array([], pa.string())
            digests = [None if t is None else hashlib.sha256(t.encode()).hexdigest() for t in batch.column("content").to_pylist()]
            columns = [batch.column("passage_id"), pa.array(digests, pa.string()), pa.ListArray.from_arrays(pa.array(ends), lexemes), pa.ListArray.from_arrays(pa.array(ends), places)]
            yield pa.RecordBatch.from_arrays(columns, names=["passage_id", "content_hash", "lexemes", "places"])


def postings(passages: DataFrame) -> DataFrame:
    """(passage_id, content_hash, lexemes, places): each passage's distinct stems in order, and at which words they stand.

    A null or empty content has none. Contents are taken whole.
    """
    return passages.select(F.col("passage_id").cast("long").alias("passage_id"), F.col("content").cast("string").alias("content")).mapInArrow(_posted, POSTINGS)


def lexeme_places(passages: DataFrame) -> DataFrame:
    """(passage_id, lexeme, places): a row for each lexeme of a passage."""
    pairs = F.explode(F.arrays_zip("lexemes", "places")).alias("p")
    return postings(passages).select("passage_id", pairs).select("passage_id", F.col("p.lexemes").alias("lexeme"), F.col("p.places").alias("places"))


def document_frequencies(passages: DataFrame) -> DataFrame:
    """(lexeme, df): passages that hold a lexeme, summed before the shuffle."""
    return postings(passages).select(F.explode("lexemes").alias("lexeme")).groupBy("lexeme").agg(F.count("*").alias("df"))


@F.udf(T.ArrayType(T.StringType()), useArrow=True)
def _asked(question: str) -> list[str]:
    import re

    words = re.findall(r"[^\W_]+", (question or "").lower())
    request = {_stems[w] for w in REQUEST_WORDS}
    return sorted({s for w in words if (s := _stems[w]) is not None} - request)[:MOST_LEXEMES]


def question_lexemes(questions: DataFrame) -> DataFrame:
    """(query_id, k, lexeme): a question's first 40 stems in order, numbered from 0, without those of words of the request itself."""
    return questions.select("query_id", F.posexplode(_asked("question")).alias("k", "lexeme"))


def cover_density(places: list[np.ndarray], every: bool = True) -> float:
    """The sum of 0.1 / (1 + other words inside) over minimal covers of a passage by a question's lexemes.

    ``places`` are those of each lexeme, none empty. If ``every``, a cover holds
    each lexeme and no smaller one does; otherwise each place is a cover by itself.
    """
    if not every:
        return PLACE_WEIGHT * sum(map(len, places))
    at = np.concatenate(places)
    of = np.repeat(np.arange(len(places)), [len(p) for p in places])
    order = np.argsort(at, kind="stable")
    at, of = at[order].tolist(), of[order].tolist()
    held, missing, left, total = [0] * len(places), len(places), 0, 0.0
    for right, k in enumerate(of):
        missing -= held[k] == 0
        held[k] += 1
        if missing:
            continue
        while held[of[left]] > 1:
            held[of[left]] -= 1
            left += 1
        # The window ends where its last lexeme came in, and begins where another would be lost: it is minimal.
        total += PLACE_WEIGHT / (1 + (at[right] - at[left]) - (right - left))
        held[of[left]] -= 1
        missing += 1
        left += 1
    return total


FOUND = "query_id long, passage_id long, content_hash string, density double, held long, lexeme string, n long"


def _best_of_batches(asked: pa.Table, most: int, every: bool):
    """Over a task's postings: for each question the passages that may be among its ``most`` densest, and counts of the lexemes asked for.

    Passages meet questions ``MEETINGS`` lexemes at a time, and what is held is each question's best so far.
    """
    queries, row = np.unique(asked.column("query_id").to_numpy(), return_inverse=True)
    by_lexeme: dict[str, list[tuple[int, int]]] = {}
    for lexeme, q, k in zip(asked.column("lexeme").to_pylist(), row.tolist(), asked.column("k").to_pylist(), strict=True):
        by_lexeme.setdefault(lexeme, []).append((q, k))
    numbers = {lexeme: n for n, lexeme in enumerate(by_lexeme)}
    start = np.cumsum([0, *(len(v) for v in by_lexeme.values())])
    of, bit = (np.array([x[c] for v in by_lexeme.values() for x in v], np.int64) for c in (0, 1))
    size = np.bincount(row, minlength=len(queries))

    def met(n: int, passage: np.ndarray, found: np.ndarray, times: np.ndarray, places) -> list[np.ndarray]:
        """(question, passage, density, held) of ``n`` passages by their known lexemes' rows."""
        # Each lexeme of a passage meets the questions that ask for it.
        each = start[found + 1] - start[found]
        at = np.repeat(start[found] - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))
        pairs, where = np.unique(of[at] * n + np.repeat(passage, each), return_inverse=True)
        held = np.zeros(len(pairs), np.int64)
        np.add.at(held, where, np.int64(1) << bit[at])
        q = pairs // max(1, n)
        if every:
            whole = np.flatnonzero(np.bincount(where, minlength=len(pairs)) == size[q])
            source, order = np.repeat(np.arange(len(found)), each), np.argsort(where, kind="stable")
            ends = np.searchsorted(where[order], np.arange(len(pairs) + 1))
            density = np.array([cover_density([places(int(r)) for r in source[order[ends[p] : ends[p + 1]]]]) for p in whole.tolist()])
            pairs, q, held = pairs[whole], q[whole], held[whole]
        else:
            density = PLACE_WEIGHT * np.bincount(where, np.repeat(times, each), len(pairs))
        return [q, pairs % max(1, n), np.round(density / (1 + density), 9), held]

    def merged(parts: list[list[np.ndarray]], least: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """Each question's best of ``parts``, and the least density that still counts for each."""
        best = [np.concatenate(c) for c in zip(*parts, strict=True)]
        order = np.lexsort((best[1], best[4], -best[2], best[0]))
        rank = np.arange(len(order)) - np.searchsorted(best[0][order], best[0][order])
        best = [c[order[rank < most]] for c in best]
        enough = np.bincount(best[0], minlength=len(queries)) == most
        last = np.searchsorted(best[0], np.flatnonzero(enough), side="right") - 1
        least = least.copy()
        least[enough] = best[2][last]
        return best, least

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # (question, id, density, held, digest) of the best so far, and of those that wait.
        waiting: list[list[np.ndarray]] = []
        best = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, "S64")]
        least = np.full(len(queries), -1.0)
        counts, seen = np.zeros(len(numbers), np.int64), 0
        for whole in batches:
            seen += whole.num_rows
            for lo in range(0, whole.num_rows, 1024):
                batch = whole.slice(lo, 1024)
                words, places = batch.column("lexemes"), batch.column("places").flatten()
                flat = words.flatten().dictionary_encode()
                known = np.array([numbers.get(w, -1) for w in flat.dictionary.to_pylist()] or [-1], np.int64)
                found = known[flat.indices.to_numpy(zero_copy_only=False)] if len(flat) else np.zeros(0, np.int64)
                rows = np.flatnonzero(found >= 0)
                passage = np.repeat(np.arange(batch.num_rows), pc.fill_null(pc.list_value_length(words), 0).to_numpy())[rows]
                found = found[rows]
                times = pc.list_value_length(places).to_numpy()[rows]
                counts += np.bincount(found, minlength=len(numbers))
                # Cuts between passages, by what meets before the end of each.
                before = np.cumsum(np.bincount(passage, start[found + 1] - start[found], batch.num_rows))
                cuts = [0, *(np.flatnonzero(np.diff(before // MEETINGS)) + 1).tolist(), batch.num_rows]
                digests, ids = batch.column("content_hash").to_pylist(), batch.column("passage_id").to_numpy()
                for first, last in zip(cuts, cuts[1:], strict=False):
                    a, b = np.searchsorted(passage, (first, last)).tolist()
                    q, p, density, held = met(last - first, passage[a:b] - first, found[a:b], times[a:b], lambda r, a=a, rows=rows, places=places: places[int(rows[a + r])].values.to_numpy())
                    keep = np.flatnonzero(density >= least[q])
                    # Each question's densest of these before their digests are asked for; what equals the last one stays.
                    keep = keep[np.lexsort((-density[keep], q[keep]))]
                    rank = np.arange(len(keep)) - np.searchsorted(q[keep], q[keep])
                    edge = np.full(len(queries), -1.0)
                    edge[q[keep[rank == most - 1]]] = density[keep[rank == most - 1]]
                    keep = keep[density[keep] >= edge[q[keep]]]
                    if not len(keep):
                        continue
                    at = p[keep] + first
                    digest = np.array([digests[k] or "" for k in at.tolist()], "S64")
                    waiting.append([q[keep], ids[at], density[keep], held[keep], digest])
                    if sum(len(w[0]) for w in waiting) > WAITING:
                        best, least = merged([best, *waiting], least)
                        waiting = []
        best, _ = merged([best, *waiting], least)
        told = [name for name, c in zip(by_lexeme, counts.tolist(), strict=True) if c]
        n, m = len(best[0]), len(told) + 1
        columns = [
            pa.concat_arrays([pa.array(queries[best[0]], pa.int64()), pa.nulls(m, pa.int64())]), pa.concat_arrays([pa.array(best[1], pa.int64()), pa.nulls(m, pa.int64())]),
            pa.array([d.decode() for d in best[4].tolist()] + [None] * m, pa.string()), pa.concat_arrays([pa.array(best[2], pa.float64()), pa.nulls(m, pa.float64())]),
            pa.concat_arrays([pa.array(best[3], pa.int64()), pa.nulls(m, pa.int64())]), pa.array([None] * n + told + [""], pa.string()), pa.array([None] * n + counts[counts > 0].tolist() + [seen], pa.int64()),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in FOUND.split(", ")])

    return run


def lexical_search(questions: DataFrame, passages: DataFrame, most: int = 30, fetched: int = FETCHED, every: bool = False, block: int = QUESTION_BLOCK) -> DataFrame:
    """(query_id, passage_id, coverage, matched, density, lexical_rank): a question's best passages.

    The ``fetched`` densest are taken first: r / (1 + r) with r the cover
    density of any lexeme of the question, or of all of them if ``every``.
    They are then ranked by coverage, the share of the question's idf that a
    passage holds; idf is ln((N + 1) / (df + 1)) + 1 over all passages. Ties
    go by density, then by the content's SHA-256, then by id.

    Passages are read and stemmed once. The stated questions' lexemes go to
    the tasks that read, in blocks of ``block``; a task sends on its densest
    passages for each question and its counts of the lexemes asked for.
    """
    asked = written(question_lexemes(questions), "asked")
    blocks = max(1, -(-questions.count() // block))
    posted = passages.select(F.col("passage_id").cast("long").alias("passage_id"), F.col("content").cast("string").alias("content"))
    if blocks > 1:
        posted = written(posted.mapInArrow(_posted, POSTINGS), "postings")
    found = None
    for k in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == k).orderBy("query_id", "k").toArrow()
        best = _best_of_batches(part, fetched, every)
        now = written(posted.mapInArrow(best if blocks > 1 else lambda batches, best=best: best(_posted(batches)), FOUND), "found").withColumn("block", F.lit(k))
        found = now if found is None else found.unionByName(now)
    # Each block counts its own lexemes in all passages, so blocks that share one agree.
    counted = found.where("lexeme IS NOT NULL").groupBy("lexeme", "block").agg(F.sum("n").alias("df")).groupBy("lexeme").agg(F.max("df").alias("df"))
    total = F.broadcast(counted.where("lexeme = ''").select(F.col("df").alias("passages")))
    weighted = asked.join(counted.where("lexeme <> ''"), "lexeme", "left").join(total)
    idf = F.log((F.col("passages") + 1.0) / (F.coalesce(F.col("df"), F.lit(0)) + 1.0)) + 1.0
    weights = weighted.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", idf.alias("idf")))), lambda x: x["idf"]).alias("idf"))
    order = Window.partitionBy("query_id").orderBy(F.desc("density"), "content_hash", "passage_id")
    dense = found.where("query_id IS NOT NULL").withColumn("place", F.row_number().over(order)).where(F.col("place") <= fetched)
    met = dense.join(weights, "query_id")
    bits = F.transform(F.sequence(F.lit(0), F.size("idf") - 1), lambda i: F.getbit(F.col("held"), i).cast("int"))
    share = F.aggregate(F.zip_with(bits, "idf", lambda b, w: b * w), F.lit(0.0), lambda s, x: s + x) / F.aggregate("idf", F.lit(0.0), lambda s, x: s + x)
    scored = met.select("query_id", "passage_id", "content_hash", F.round(share, 6).alias("coverage"), F.bit_count("held").cast("long").alias("matched"), "density")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("coverage"), F.desc("density"), "content_hash", "passage_id"))
    return scored.withColumn("lexical_rank", rank).where(F.col("lexical_rank") <= most).drop("content_hash")
