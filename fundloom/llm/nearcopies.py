"""SimHash near-duplicates of five-word shingles with a Jaccard similarity of 0.8 or more.

At that similarity 64-bit fingerprints differ in 9.7 bits on average, with a
deviation of 2.9, and in more than ``RADIUS`` with a chance of 1e-6. Keys of
shared blocks, as for two bits, can't be selective at such a radius (25 blocks
of two or three bits). So buckets come from bands of minima instead: 160 minima
in 40 bands of 4, of which two such texts share none with a chance of 7e-10.
Inside a bucket fingerprints are compared bit-sliced within the radius. One bit
of each minimum is a sketch: those of two such texts differ in more than
``SKETCH_RADIUS`` of 160 bits with a chance of 1.4e-8, while texts of similarity
0.23, as a common passage makes them, do so in all but 2 of 10,000 cases; pairs
are candidates if both tests hold. Texts with the same shingles are one class
from the start. The texts of candidates' groups are then compared by their
whole sets of shingles, as 64-bit hashes.

Only what joins components is looked for. A group of up to ``TOGETHER`` members
and ``TOGETHER_BYTES`` is compared in one task. In a larger one all members are
compared with the least of them, and with the least of those that stay apart,
by joins that Spark can split. What is apart after ``LEADERS`` rounds is, in a
bucket, divided by a second band: two such texts share only one of 40 with a
chance of 2e-8, so those that are apart meet only the members that share
another band with them. What is still too large, and in a group of texts what
is apart, is compared with all members in tasks of two chunks. So no task holds
a group that isn't bounded.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fundloom.llm.components import connected_components
from fundloom.llm.shared import Scratch, free_name, materialise
from fundloom.llm.simhash import roots_in_buckets

WORDS = 5
#: Least similarity, as a fraction so that it is compared in whole numbers.
LEAST = (4, 5)
BANDS, ROWS = 40, 4
#: Bits in which fingerprints of candidates differ, at most, and sketches.
RADIUS, SKETCH_RADIUS = 24, 40
#: Bytes of a fingerprint with its sketch.
WIDTH = 32
#: Members and bytes of a group that one task compares, and members of a chunk of larger groups.
TOGETHER, TOGETHER_BYTES, CHUNK = 2000, 32 << 20, 1000
#: Words whose hashes a worker keeps, at most.
MOST_WORDS = 100_000
#: Rounds in which a larger group is compared with one of its members.
LEADERS = 3
_WEIGHTS = np.random.default_rng(5).integers(1, 2**63, WORDS, dtype=np.uint64) | np.uint64(1)
_FACTORS = np.random.default_rng(6).integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_BAND_FACTORS = np.random.default_rng(7).integers(1, 2**63, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > MOST_WORDS:
            self.clear()
        self[word] = out = xxhash.xxh64_intdigest(word, 42)
        return out


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles_of(text: bytes | None, known: dict) -> np.ndarray:
    """The sorted distinct hashes of a text's five-word shingles; all words are one shingle where there are fewer.

    A-Z are lower-cased and words split at ASCII white space, as for fingerprints.
    """
    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    h = np.array([known[w] for w in words], np.uint64)
    if len(h) < WORDS:
        return _mixed((h * _WEIGHTS[: len(h)]).sum(keepdims=True, dtype=np.uint64) + np.uint64(len(h)))
    total = np.zeros(len(h) - WORDS + 1, np.uint64)
    for k in range(WORDS):
        total += h[k : len(h) - WORDS + 1 + k] * _WEIGHTS[k]
    return np.unique(_mixed(total))


def fingerprint_of_hashes(shingles: np.ndarray) -> np.ndarray:
    """The SimHash of distinct shingles, as an array of one unsigned 64-bit number."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(shingles), 65_536):
        counts += np.unpackbits(shingles[at : at + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > len(shingles), bitorder="little").view("<u8")


def minima_of(shingles: np.ndarray) -> np.ndarray:
    out = np.full(len(_FACTORS), 2**64 - 1, np.uint64)
    for at in range(0, len(shingles), 2048):
        np.minimum(out, np.multiply.outer(_FACTORS, shingles[at : at + 2048]).min(axis=1), out=out)
    return out


def sketch_of(minima: np.ndarray) -> bytes:
    """One bit of each minimum, in three words of 64 bits."""
    return np.packbits((_mixed(minima) & np.uint64(1)).astype(bool), bitorder="little").tobytes().ljust(24, b"\0")


@F.pandas_udf(T.StructType([T.StructField("same", T.BinaryType()), T.StructField("print", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))]))
def _sketch(texts: pd.Series) -> pd.DataFrame:
    known, same, prints, bands = _Words(), [], [], []
    for text in texts:
        s = shingles_of(text, known)
        same.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
        m = minima_of(s)
        prints.append(fingerprint_of_hashes(s).tobytes() + sketch_of(m))
        keys = _mixed((m.reshape(BANDS, ROWS) * _BAND_FACTORS).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))
        bands.append(keys.view(np.int64) if len(s) else np.zeros(0, np.int64))
    return pd.DataFrame({"same": same, "print": prints, "bands": bands})


def _groups(n: int, partners: Callable[[int, np.ndarray], np.ndarray]) -> np.ndarray:
    """The least index of each one's component; ``partners`` is asked only for pairs that are still apart."""
    root = np.arange(n)
    for i in range(n - 1):
        apart = np.flatnonzero(root[i + 1 :] != root[i]) + i + 1
        if len(apart):
            found = np.unique(root[partners(i, apart)])
            if len(found):
                root[np.isin(root, found) | (root == root[i])] = min(root[i], found[0])
    return root


def similar_groups(sets: list[np.ndarray]) -> np.ndarray:
    """For sorted distinct hashes of each text, the least index of its component of pairs of similarity 0.8 or more."""
    sizes = np.array([len(s) for s in sets])
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    start = np.concatenate([[0], np.cumsum(sizes)])
    marked = np.zeros(len(ids) + 1, bool)
    p, q = LEAST

    def partners(i: int, js: np.ndarray) -> np.ndarray:
        js = js[(q * np.minimum(sizes[js], sizes[i]) >= p * np.maximum(sizes[js], sizes[i]))]
        own = ids[start[i] : start[i + 1]]
        marked[own] = True
        common = np.array([np.count_nonzero(marked[ids[start[j] : start[j + 1]]]) for j in js], np.int64)
        marked[own] = False
        return js[(p + q) * common >= p * (sizes[js] + sizes[i])]

    return _groups(len(sets), partners)


FOUND = "a long, b long, large long"


def _found(links: list[tuple[int, int]], large: list[int]) -> pa.RecordBatch:
    columns = [[x[0] for x in links] + [None] * len(large), [x[1] for x in links] + [None] * len(large), [None] * len(links) + large]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a", "b", "large"])


def _texts(together: int, together_bytes: int):
    """Over rows (key, node, value) sorted by key: (a, b) for each node a whose component in its key has a lesser node b.

    A key with more members or bytes than that is not compared but told as ``large``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(nodes: list, values: list) -> pa.RecordBatch:
            known = _Words()
            root = similar_groups([shingles_of(v, known) for v in values]) if len(values) > 1 else [0]
            return _found([(nodes[i], nodes[root[i]]) for i in range(len(nodes)) if root[i] != i], [])

        now, nodes, values, size, skip = None, [], [], 0, False
        for batch in batches:
            for key, node, value in zip(*(batch.column(c).to_pylist() for c in ("key", "node", "value")), strict=True):
                if key != now:
                    if nodes:
                        yield made(nodes, values)
                    now, nodes, values, size, skip = key, [], [], 0, False
                if skip:
                    continue
                nodes.append(node)
                values.append(value)
                size += len(value or b"")
                if len(nodes) > 1 and (len(nodes) > together or size > together_bytes):
                    nodes, values, skip = [], [], True
                    yield _found([], [key])
        if nodes:
            yield made(nodes, values)

    return run


def _words_of(values: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(values), "<u8").reshape(-1, WIDTH // 8)


def _prints(together: int, together_bytes: int):
    """``_texts`` for fingerprints with sketches as values, all keys of a batch together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(key: np.ndarray, node: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
            start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            size = np.diff(np.concatenate([start, [len(key)]]))
            each = np.repeat(size, size)
            chosen = np.flatnonzero((each > 1) & (each <= together))
            sketch = value[chosen, 1:]
            root = roots_in_buckets(key[chosen], value[chosen, 0], RADIUS, lambda a, b: np.bitwise_count(sketch[a] ^ sketch[b]).sum(axis=1) <= SKETCH_RADIUS)
            linked = np.flatnonzero(root != np.arange(len(root)))
            own = node[chosen]
            return _found(list(zip(own[linked].tolist(), own[root[linked]].tolist(), strict=True)), key[start[size > together]].tolist())

        held, skip = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, WIDTH // 8), np.uint64)], None
        for batch in batches:
            rows = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "node")] + [_words_of(batch.column("value").to_pylist())]
            held = [np.concatenate(x) for x in zip(held, rows, strict=True)]
            if skip is not None:
                held = [h[of_others] for of_others in [held[0] != skip] for h in held]
            if not len(held[0]):
                continue
            cut = int(np.searchsorted(held[0], held[0][-1]))  # the last key may go on
            if cut:
                yield made(*(h[:cut] for h in held))
            held = [h[cut:] for h in held]
            if len(held[0]) > together:
                skip = held[0][0]
                yield _found([], [int(skip)])
                held = [h[:0] for h in held]
        if len(held[0]):
            yield made(*held)

    return run


def _prints_alike(one: bytes, other: bytes) -> bool:
    a, b = int.from_bytes(one, "little"), int.from_bytes(other, "little")
    apart = a ^ b
    return (apart & (2**64 - 1)).bit_count() <= RADIUS and (apart >> 64).bit_count() <= SKETCH_RADIUS


def _texts_alike(one: np.ndarray, other: np.ndarray) -> bool:
    p, q = LEAST
    if q * min(len(one), len(other)) < p * max(len(one), len(other)):
        return False
    return (p + q) * len(np.intersect1d(one, other, assume_unique=True)) >= p * (len(one) + len(other))


@dataclass(frozen=True)
class Likeness:
    """How members of a group are compared: all in one task, and one with another."""

    groups: Callable[[int, int], Callable]
    prepared: Callable
    alike: Callable[..., bool]
    size: Callable[[Column], Column]


PRINTS = Likeness(_prints, lambda value, _: value, _prints_alike, lambda value: F.lit(WIDTH))
TEXTS = Likeness(_texts, shingles_of, _texts_alike, lambda value: F.coalesce(F.octet_length(value), F.lit(0)))


def _with_leader(likeness: Likeness):
    """Over rows (node, value, leader, leader_value): (a, b) for each node that is like its leader."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, leader, prepared = _Words(), None, None
        for batch in batches:
            found = []
            for n, v, m, w in zip(*(batch.column(c).to_pylist() for c in ("node", "value", "leader", "leader_value")), strict=True):
                if m != leader:
                    leader, prepared = m, likeness.prepared(w, known)
                if n != m and likeness.alike(likeness.prepared(v, known), prepared):
                    found.append((n, m))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return run


def _in_tasks(members: DataFrame, key: Column, likeness: Likeness, together: int, together_bytes: int) -> DataFrame:
    rows = members.select(key.alias("key"), "node", "value").repartition("key").sortWithinPartitions("key", "node")
    return rows.mapInArrow(likeness.groups(together, together_bytes), FOUND)


def group_links(members: DataFrame, likeness: Likeness, scratch: Scratch, together: int = TOGETHER, together_bytes: int = TOGETHER_BYTES, chunk: int = CHUNK, bands: DataFrame | None = None) -> DataFrame:
    """(a, b): links that join the members of ``members(key, node, value)`` into the components of all links within their key.

    With ``bands(node, bands)`` two members of a large key need only be
    compared if they share another of these bands besides it.
    """
    # Large groups are found by an aggregate with partial sums, so none is dealt out to one task.
    sizes = members.groupBy("key").agg(F.count("*").alias("n"), F.sum(likeness.size(F.col("value"))).alias("size"))
    big = scratch.table(sizes.where((F.col("n") > together) | ((F.col("n") > 1) & (F.col("size") > together_bytes))).select("key"), "large-keys")
    any_big = bool(big.take(1))
    small = members.join(big, "key", "left_anti") if any_big else members
    met = scratch.table(_in_tasks(small, F.col("key"), likeness, together, together_bytes), "met")
    links = met.where("a IS NOT NULL").select("a", "b")
    if not any_big:
        return links
    all_ = scratch.table(members.join(big, "key").select("key", "node", "value"), "large")
    apart, first, found = all_, None, None
    for _ in range(LEADERS):
        least = apart.groupBy("key").agg(F.min("node").alias("node"))
        leaders = scratch.table(all_.join(least, ["key", "node"]).select("key", F.col("node").alias("leader"), F.col("value").alias("leader_value")), "leaders")
        first = first if first is not None else leaders.select("key", F.col("leader").alias("first"))
        new = scratch.table(all_.join(leaders, "key").select("node", "value", "leader", "leader_value").mapInArrow(_with_leader(likeness), "a long, b long"), "links")
        found = new if found is None else found.unionByName(new)
        groups = connected_components(found, "near-leaders")
        of = groups.select("node", "component")
        main = first.join(of.toDF("first", "main"), "first", "left").select("key", F.coalesce("main", "first").alias("main"))
        placed = all_.join(of, "node", "left").withColumn("own", F.coalesce("component", "node")).join(main, "key")
        apart = scratch.table(placed.where("own <> main").select(*all_.columns), "apart")
        if not apart.take(1):
            return links.unionByName(found)
    if bands is not None:
        # Those that stay apart meet what shares a second band with them; bands tell their own number, so no key is its own second one.
        def second(side: DataFrame) -> DataFrame:
            pairs = side.join(bands, "node").select("key", "node", "value", F.explode("bands").alias("band")).where("band <> key")
            return pairs.select(F.xxhash64("key", "band").alias("key"), "node", "value")

        asked = second(apart).select("key").distinct()
        divided = scratch.table(second(all_).join(asked.hint("merge"), "key", "left_semi"), "divided")
        return links.unionByName(found).unionByName(group_links(divided, likeness, scratch, together, together_bytes, chunk))
    # All that stays apart against all members, in tasks of a chunk of each.
    counts = all_.groupBy("key").agg(F.count("*").alias("n")).join(apart.groupBy("key").agg(F.count("*").alias("m")), "key")
    parts = scratch.table(counts, "apart-sizes")
    rows, columns = F.ceil(F.col("m") / chunk), F.ceil(F.col("n") / chunk)

    def dealt(side: DataFrame, own: Column, other: Column, i: str, j: str) -> DataFrame:
        at = F.pmod(F.xxhash64("node"), own)
        return side.join(parts, "key").select("key", "node", "value", at.alias(i), F.explode(F.sequence(F.lit(0).cast("long"), other - 1)).alias(j))

    pairs = dealt(apart, rows, columns, "i", "j").unionByName(dealt(all_, columns, rows, "j", "i")).distinct()
    # Chunks are of bounded size by the hash; a pair of chunks that isn't would be a key of its own again, so no bound is set here.
    last = _in_tasks(pairs, F.xxhash64("key", "i", "j"), likeness, 1 << 60, 1 << 60)
    return links.unionByName(found).unionByName(last.select("a", "b"))


def one_of_each_group(docs: DataFrame, together: int = TOGETHER) -> DataFrame:
    """The rows of ``docs``, all columns, without near copies of a document with a smaller doc_id.

    Groups are the components of pairs whose five-word shingles have a Jaccard
    similarity of 0.8 or more. Null and empty texts and texts of white space
    are copies of each other. Of repeated rows with the same doc_id, and of a
    group without any doc_id, one row stays. Texts are compared whole; an
    empty table gives no rows; columns of any name keep their values.
    """
    row = free_name(docs, "near_row")
    columns = [f"`{c}`" for c in docs.columns]
    marked = materialise(docs.withColumn(row, F.monotonically_increasing_id()), "near-docs")
    text = F.col("text").cast("string").cast("binary")
    with Scratch(docs.sparkSession, "near") as scratch:
        prints = scratch.table(marked.select(F.col(row).alias("node"), F.col("doc_id").cast("long").alias("doc_id"), _sketch(text).alias("s")).select("node", "doc_id", "s.*"), "prints")
        least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")).alias("least")
        classes = scratch.table(prints.groupBy("same").agg(least).select(F.col("least.node").alias("node"), "least"), "classes")
        first = scratch.table(prints.join(classes.select("node"), "node", "left_semi"), "first")
        keyed = first.select("node", F.col("print").alias("value"), F.explode("bands").alias("key"))
        candidates = scratch.table(group_links(keyed, PRINTS, scratch, together, bands=first.select("node", "bands")).distinct(), "candidates")
        groups = connected_components(candidates, "near-candidates")
        texts = scratch.table(groups.hint("merge").join(marked.select(F.col(row).alias("node"), text.alias("value")), "node").select(F.col("component").alias("key"), "node", "value"), "texts")
        found = connected_components(group_links(texts, TEXTS, scratch, together), "near-groups")
        member = classes.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
        keep = materialise(member.groupBy("component").agg(F.min("least").alias("least")).select(F.col("least.node").alias(row)), "near-kept")
    # The rows that stay grow with the documents, so their table is never sent to all tasks.
    return marked.join(keep.hint("merge"), row, "left_semi").select(*columns)
