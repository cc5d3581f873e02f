"""Benchmark decontamination by the multi-pattern search of Wu and Manber, on words.

The patterns are the benchmark items' word windows. A table of shifts, indexed
by a hash of blocks of two words, tells how far the search may skip; where it
may not skip, the bucket of the block that ends there selects the patterns with
that suffix, and a comparison of bytes confirms an occurrence. A text without
contamination is read at one word in nine.

A benchmark is searched in passes over bounded parts of its text. What a worker
holds of a part are its folded bytes and flat arrays: word offsets, shifts,
buckets and the distinct windows, some 60 bytes for each word of the part.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fundloom.llm.shared import Scratch, free_name, materialise

WINDOW = 10
#: Bytes of item texts whose patterns are searched at once; a larger benchmark is searched in several passes.
PASS_BYTES = 8 << 20
RESULT = "n_words long, hits array<struct<first:int, last:int>>, items array<string>"
#: A-Z become a-z, digits, letters and bytes above 127 stay, all else separates words.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(FOLD).split() if text else []


class Words:
    """Folded items as one text, with the place and two hashes of each word: its own, and that of the block it ends."""

    def __init__(self, pieces: list[list[bytes]]):
        n = sum(map(len, pieces))
        self.text = b" ".join(b" ".join(p) for p in pieces)
        spaces = np.flatnonzero(np.frombuffer(self.text, np.uint8) == 32).astype(np.int32)
        self.starts = np.concatenate([np.zeros(1, np.int32), spaces + 1]).astype(np.int32)[:n]
        self.ends = np.concatenate([spaces, [len(self.text)]]).astype(np.int32)[:n]
        self.hashes = np.fromiter((hash((w,)) for p in pieces for w in p), np.int64, n)
        self.pairs = np.fromiter((hash(b) for p in pieces for b in ((p[i - 1], p[i]) for i in range(len(p)))), np.int64, n)

    def distinct(self, places: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(chosen, number): indexes of the distinct windows that begin at ``places``, and for each place which it is."""
        mixed = np.zeros(len(places), np.uint64)
        for k in range(length):
            mixed = (mixed ^ self.hashes[places + k].view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
        order = np.argsort(mixed, kind="stable")
        fresh = np.concatenate([[True], mixed[order[1:]] != mixed[order[:-1]]]) if len(order) else np.zeros(0, bool)
        chosen = order[fresh].tolist()
        number = np.empty(len(places), np.int32)
        number[order] = np.cumsum(fresh) - 1
        # Windows with one hash are compared; one that differs is a pattern of its own.
        first, last, text = self.starts[places], self.ends[places + length - 1], self.text
        other: dict[bytes, int] = {}
        for i in order[~fresh].tolist():
            k = chosen[number[i]]
            own = text[first[i] : last[i]]
            if own != text[first[k] : last[k]]:
                if own not in other:
                    other[own] = len(chosen)
                    chosen.append(i)
                number[i] = other[own]
        return np.array(chosen, np.int64), number


class Patterns:
    """Shift and suffix tables for the distinct windows of one length, in words, of some items.

    ``begin`` and ``count`` are the items' first words and numbers of words,
    ``owner`` their names' numbers.
    """

    def __init__(self, length: int, words: Words, begin: np.ndarray, count: np.ndarray, owner: np.ndarray):
        self.length, self.block, self.text = length, min(2, length), words.text
        self.skip = min(length - self.block + 1, 255)
        windows = count - length + 1
        each = np.repeat(np.arange(len(begin)), windows)
        inside = np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows)
        places = (begin[each] + inside).astype(np.int32)
        chosen, number = words.distinct(places, length)
        self.first, self.last = words.starts[places[chosen]], words.ends[places[chosen] + length - 1]
        pairs = np.unique(number.astype(np.int64) << 32 | owner[each])
        self.item_at = np.searchsorted(pairs >> 32, np.arange(len(chosen) + 1)).astype(np.int32)
        self.item_of = (pairs & 0xFFFFFFFF).astype(np.int32)
        self.mask = (1 << max(8, int(2 * len(chosen)).bit_length())) - 1
        slots = (words.pairs if self.block == 2 else words.hashes) & self.mask
        # A block that ends at an item's e-th word lies nearest to an end in the item's first window, or is itself an end.
        shift = np.full(self.mask + 1, self.skip, np.uint8)
        for end in range(self.block, length):
            np.minimum.at(shift, slots[begin + end - 1], length - end)
        ends = slots[places[chosen] + length - 1]
        shift[ends] = 0
        self.shift = shift.tobytes()
        # A bucket is ordered by a hash of the windows' first block, so a frequent suffix doesn't make it long to search.
        first_block = (words.pairs if self.block == 2 else words.hashes)[places[chosen] + self.block - 1]
        keys = ends << 32 | (first_block & 0xFFFFFFFF)
        self.order = np.argsort(keys, kind="stable").astype(np.int32)
        self.keys = keys[self.order]

    def search(self, words: list[bytes]) -> Iterator[tuple[int, int]]:
        """(end, pattern) of each occurrence."""
        shift, length, block, mask = self.shift, self.length, self.block, self.mask
        end, n = length, len(words)
        while end <= n:
            slot = hash((words[end - 2], words[end - 1]) if block == 2 else (words[end - 1],)) & mask
            step = shift[slot]
            if step:
                end += step
                continue
            start = end - length
            key = slot << 32 | (hash(tuple(words[start : start + block])) & 0xFFFFFFFF)
            k = int(self.keys.searchsorted(key))
            if k < len(self.keys) and self.keys[k] == key:
                here = b" ".join(words[start:end])
                while k < len(self.keys) and self.keys[k] == key:
                    p = int(self.order[k])
                    if self.text[self.first[p] : self.last[p]] == here:
                        yield end, p
                        break  # distinct patterns: no other is equal
                    k += 1
            end += 1

    def items(self, pattern: int) -> np.ndarray:
        return self.item_of[self.item_at[pattern] : self.item_at[pattern + 1]]


class Tables:
    """The search tables of a part of a benchmark: one for each length of window, and the items' names."""

    def __init__(self, items: Iterable[tuple], window: int = WINDOW):
        self.names: list[str] = []
        number: dict[str, int] = {}
        pieces, owner = [], []
        for item_id, text in items:
            words = words_of(text)
            if words:
                name = "null" if item_id is None else str(item_id)
                if name not in number:
                    number[name] = len(self.names)
                    self.names.append(name)
                pieces.append(words)
                owner.append(number[name])
        counts, owners = np.array([len(p) for p in pieces], np.int64), np.array(owner, np.int64)
        words = Words(pieces)
        del pieces
        begin = np.cumsum(counts) - counts
        lengths = np.minimum(counts, window)
        self.tables = []
        for n in np.unique(lengths).tolist():
            of = lengths == n
            self.tables.append(Patterns(n, words, begin[of], counts[of], owners[of]))

    def bytes_held(self) -> int:
        """Bytes of the text and the arrays."""
        arrays = ("first", "last", "item_at", "item_of", "order", "keys")
        return sum(len(t.shift) + sum(getattr(t, a).nbytes for a in arrays) for t in self.tables) + (len(self.tables[0].text) if self.tables else 0)


def find(tables: Tables, text: str | None, hits: Iterable[tuple[int, int]] = (), items: Iterable[str] = ()) -> tuple[int, list[tuple[int, int]], list[str]]:
    """Number of words, disjoint hit ranges (first and last word) and items, added to those known."""
    words = words_of(text)
    found, numbers = list(hits), set()
    for table in tables.tables:
        patterns = set()
        for end, p in table.search(words):
            found.append((end - table.length, end - 1))
            patterns.add(p)
        for p in patterns:
            numbers.update(table.items(p).tolist())
    merged: list[tuple[int, int]] = []
    for first, last in sorted(found):
        if merged and first <= merged[-1][1] + 1:
            merged[-1] = (merged[-1][0], max(last, merged[-1][1]))
        else:
            merged.append((first, last))
    return len(words), merged, sorted({*items, *(tables.names[i] for i in numbers)})


def _scan(shared, window: int):
    """Column functions over (text) or (text, what passes before found) for the broadcast items."""
    built: list[Tables] = []

    def run(texts: pd.Series, known: pd.DataFrame | None) -> pd.DataFrame:
        if not built:
            built.append(Tables(shared.value, window))
        before = known.to_dict("records") if known is not None else [None] * len(texts)
        rows = []
        for text, k in zip(texts, before, strict=True):
            n, hits, names = find(built[0], text, [(h["first"], h["last"]) for h in k["hits"]] if k else (), k["items"] if k else ())
            rows.append((n, [{"first": a, "last": b} for a, b in hits], names))
        return pd.DataFrame(rows, columns=["n_words", "hits", "items"])

    @F.pandas_udf(RESULT)
    def first(texts: pd.Series) -> pd.DataFrame:
        return run(texts, None)

    @F.pandas_udf(RESULT)
    def more(texts: pd.Series, known: pd.DataFrame) -> pd.DataFrame:
        return run(texts, known)

    return first, more


def scanned(docs: DataFrame, benchmark: DataFrame, name: str, window: int = WINDOW, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """``docs`` with a struct column ``name`` (n_words, hits, items) for its ``text`` against ``benchmark(item_id, text)``.

    Repeated items are dropped, the benchmark's bytes are summed, and items go
    to passes by a hash, so that a pass has about ``pass_bytes`` of them (more
    only where one item alone has more). Each pass but the last is written to
    the shared folder before the next is collected, so driver and workers hold
    the items of one pass at a time. Hits of all passes are joined.
    """
    spark = docs.sparkSession
    plain = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL AND text <> ''")
    text = F.col("text").cast("string")
    with Scratch(spark, "decontaminate") as scratch:
        items = scratch.table(plain.distinct(), "items")
        # A word counts as six bytes at least, as its tables take room however short it is.
        weight = F.greatest(F.octet_length("text"), 6 * F.regexp_count("text", F.lit(r"[0-9A-Za-z\x{80}-\x{10FFFF}]+")))
        size = items.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0]
        passes = max(1, -(-size // pass_bytes))
        found = docs
        for i in range(passes):
            part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == i)
            shared = spark.sparkContext.broadcast([tuple(r) for r in part.collect()])
            first, more = _scan(shared, window)
            found = found.withColumn(name, first(text) if i == 0 else more(text, F.col(name)))
            if i < passes - 1:
                found = scratch.table(found, "pass")
                shared.unpersist()
        # The last pass is left to the caller's plan, unless it reads a table that goes with the block.
        return found if passes == 1 else materialise(found, "decontaminate")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items, hits, contaminated.

    ``hits`` are disjoint ranges of word numbers. A null or empty text has no
    words and is clean; so are all texts when the benchmark is empty. An item
    with a null id is named "null"; items that share an id count once, items
    with a null text or without words are never found. Texts are searched
    whole, however long. Repeated rows are judged one by one; an empty table
    gives no rows; other columns are ignored.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    x = scanned(plain, benchmark, "x", window, pass_bytes)
    n_hit = F.aggregate("x.hits", F.lit(0).cast("long"), lambda s, h: s + (h["last"] - h["first"] + 1))
    return x.select("doc_id", F.col("x.n_words").alias("n_words"), n_hit.alias("n_hit"), F.size("x.items").cast("long").alias("n_items"), F.col("x.items").alias("items"), F.col("x.hits").alias("hits")).withColumn("contaminated", F.col("n_hit") > 0)


def clean_of_benchmark(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no benchmark window.

    Null and empty texts stay, and all rows stay when the benchmark is empty.
    Repeated rows are judged one by one; an empty table gives no rows; columns
    of any name keep their values.
    """
    name = free_name(docs, "benchmark_found")
    found = scanned(docs, benchmark, name, window, pass_bytes)
    return found.where(F.size(F.col(name)["hits"]) == 0).select(*(f"`{c}`" for c in docs.columns))
