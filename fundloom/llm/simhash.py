"""SimHash near-duplicates with an exact search inside a small Hamming radius.

Texts become 64-bit fingerprints of their word shingles. Equal fingerprints are
one class from the start. Distinct fingerprints that differ in at most two bits
agree on at least two of four 16-bit blocks, so six keys of two blocks bring
each such pair into a common bucket. Buckets are compared bit-sliced: the
fingerprints stand as 64 vertical bit planes, 64 candidates to a machine word;
carry-save counters add up a query's differences to all of them at once, and a
word is abandoned when all its candidates exceed the radius.

A bucket with too many fingerprints is divided by further keys on its other
bits in the same way; at the third level only eight bits are open, so buckets
have 256 fingerprints at most. No pair is lost and no bucket is unbounded.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fundloom.llm.components import connected_components
from fundloom.llm.shared import free_name, materialise

RADIUS = 2
#: Fingerprints of a bucket that one task compares; larger buckets are divided.
BUCKET = 4096
LANES = 64
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint_of(text: bytes | None, size: int = 3) -> int:
    """The SimHash of a UTF-8 text, as an unsigned 64-bit number; zero without words."""
    import xxhash

    words = text.lower().split() if text else []
    if not words:
        return 0
    if len(words) < size:
        shingles = [b" ".join(words)]
    else:
        shingles = [b" ".join(x) for x in zip(*(words[i:] for i in range(size)))]
    digest, n = xxhash.xxh64_intdigest, len(shingles)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 65_536):
        h = np.array([digest(s, 42) for s in shingles[at : at + 65_536]], dtype="<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


@F.pandas_udf(T.LongType())
def _fingerprint(texts: pd.Series) -> pd.Series:
    return pd.Series(np.array([fingerprint_of(t) for t in texts], dtype=np.uint64).view(np.int64))


def fingerprint(text: Column) -> Column:
    """SimHash of a string column as a signed long: A-Z lower-cased, words split at ASCII white space, 3-word shingles."""
    return _fingerprint(text.cast("string").cast("binary"))


def _block(value: Column, start: int, width: int) -> Column:
    return F.shiftrightunsigned(value, start).bitwiseAND(F.lit((1 << width) - 1))


def _keys(level: int) -> Column:
    """An array of (bucket key, bits still open) that covers all pairs within the radius.

    Level 1 chooses two of four 16-bit blocks; each further level chooses two
    of four equal blocks of the bits that the bucket leaves open. ``path``
    holds the choices, ``bits`` the chosen bits.
    """
    out = []
    if level == 1:
        for t, (i, j) in enumerate(combinations(range(4), 2)):
            bits = F.shiftleft(_block(F.col("fp"), 16 * i, 16), 16).bitwiseOR(_block(F.col("fp"), 16 * j, 16))
            rest = [x for x in range(4) if x not in (i, j)]
            still = F.shiftleft(_block(F.col("fp"), 16 * rest[1], 16), 16).bitwiseOR(_block(F.col("fp"), 16 * rest[0], 16))
            out.append(F.struct(F.lit(t).alias("path"), bits.alias("bits"), still.alias("open")))
        return F.array(*out)
    width = 8 if level == 2 else 4
    for t, (i, j) in enumerate(combinations(range(4), 2)):
        chosen = F.shiftleft(_block(F.col("open"), width * i, width), width).bitwiseOR(_block(F.col("open"), width * j, width))
        rest = [x for x in range(4) if x not in (i, j)]
        still = F.shiftleft(_block(F.col("open"), width * rest[1], width), width).bitwiseOR(_block(F.col("open"), width * rest[0], width))
        out.append(F.struct((F.col("path") * 6 + t).alias("path"), F.shiftleft(F.col("bits"), 2 * width).bitwiseOR(chosen).alias("bits"), still.alias("open")))
    return F.array(*out)


def _beyond(counters: list[np.ndarray], over: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose count, in bits from the lowest counter up, is above the radius."""
    more, same = over, np.full_like(over, FULL)
    for k in reversed(range(len(counters))):
        if radius >> k & 1:
            same = same & counters[k]
        else:
            more = more | same & counters[k]
            same = same & ~counters[k]
    return more


def within_radius(fps: np.ndarray, query: np.ndarray, word: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For each (query, word) a mask of the word's lanes that differ in at most ``radius`` bits.

    ``query`` indexes ``fps``; word w holds fps[64 w : 64 w + 64]. Bitwise
    counters, as many as the radius has bits, and a sticky overflow are updated
    from each bit plane.
    """
    lanes = -(-len(fps) // LANES) * LANES
    padded = np.zeros(lanes, np.uint64)
    padded[: len(fps)] = fps
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    planes = np.ascontiguousarray(np.packbits(bits.reshape(-1, LANES, 64).transpose(2, 0, 1), axis=2, bitorder="little")).view("<u8")[:, :, 0]
    out = np.zeros(len(query), np.uint64)
    alive = np.arange(len(query))
    q, w = fps[query], word
    counters = [np.zeros(len(query), np.uint64) for _ in range(max(1, radius.bit_length()))]
    over = np.zeros(len(query), np.uint64)
    for p in range(64):
        carry = planes[p][w] ^ np.where((q >> np.uint64(p)) & np.uint64(1), FULL, np.uint64(0))
        for k, c in enumerate(counters):
            counters[k], carry = c ^ carry, c & carry
        over = over | carry
        if p % 8 == 7 and p > radius:
            keep = _beyond(counters, over, radius) != FULL
            if not keep.all():
                alive, q, w, over = alive[keep], q[keep], w[keep], over[keep]
                counters = [c[keep] for c in counters]
    out[alive] = ~_beyond(counters, over, radius)
    return out


def links_in_buckets(bucket: np.ndarray, fps: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links (fingerprint, least fingerprint of its group) inside buckets, which lie one after the other.

    Groups are the components within a bucket, so a bucket gives fewer links
    than it has fingerprints.
    """
    root = roots_in_buckets(bucket, fps, radius)
    linked = np.flatnonzero(root != np.arange(len(fps)))
    return fps[linked], fps[root[linked]]


def roots_in_buckets(bucket: np.ndarray, fps: np.ndarray, radius: int = RADIUS, confirm: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> np.ndarray:
    """For each fingerprint the least index of its component of links inside its bucket; ``confirm`` may turn down pairs of indices."""
    n = len(fps)
    if n < 2:
        return np.arange(n)
    edge = np.flatnonzero(bucket[1:] != bucket[:-1]) + 1
    start = np.zeros(n, np.int64)
    start[edge] = edge
    start = np.maximum.accumulate(start)
    root = np.arange(n)
    first, last = start // LANES, np.arange(n) // LANES
    count = last - first + 1  # a query looks at what stands before it in its bucket
    count[start == np.arange(n)] = 0
    ends = np.cumsum(count)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 65_536, side="right")))
        query = np.repeat(np.arange(at, to), count[at:to])
        if len(query):
            word = first[query] + np.arange(len(query)) - np.repeat(ends[at:to] - count[at:to] - (ends[at - 1] if at else 0), count[at:to])
            mask = within_radius(fps, query, word, radius)
            some = mask != 0
            query, word, mask = query[some], word[some], mask[some]
            for lo in range(0, len(query), 8192):
                lanes = np.unpackbits(mask[lo : lo + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                i, lane = np.nonzero(lanes)
                a, b = query[lo + i], word[lo + i] * LANES + lane
                good = (b < a) & (b >= start[a])
                a, b = a[good], b[good]
                if confirm is not None and len(a):
                    a, b = a[good := confirm(a, b)], b[good]
                _unite(root, a, b)
        at = to
    return root


def _unite(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the groups of a and b; ``root`` holds the least index of each node's group."""
    while len(a):
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            return
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root[:] = up


def _compare(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def made(path, bits, fp) -> pa.RecordBatch:
            change = np.flatnonzero((path[1:] != path[:-1]) | (bits[1:] != bits[:-1])) + 1
            bucket = np.zeros(len(fp), np.int64)
            bucket[change] = 1
            a, b = links_in_buckets(np.cumsum(bucket), fp.view(np.uint64), radius)
            return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (a, b)], names=["a", "b"])

        for batch in batches:
            held.append(tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in ("path", "bits", "fp")))
            path, bits, fp = (np.concatenate(x) for x in zip(*held, strict=True))
            whole = np.flatnonzero((path != path[-1]) | (bits != bits[-1])) if len(fp) else []
            cut = int(whole[-1]) + 1 if len(whole) else 0  # the last bucket may go on
            if cut:
                yield made(path[:cut], bits[:cut], fp[:cut])
            held = [(path[cut:], bits[cut:], fp[cut:])]
        if held and len(held[0][2]):
            yield made(*held[0])

    return run


def near_links(fps: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of ``fps(fp)`` within ``radius`` (2 at most).

    ``fps`` holds distinct longs. Buckets of one fingerprint are dropped before
    the rows are dealt out; those of more than ``bucket`` go to the next level.
    """
    open_rows, links = fps, None
    for level in (1, 2, 3):
        keyed = open_rows.select("fp", F.explode(_keys(level)).alias("k")).select("fp", "k.*")
        sizes = keyed.groupBy("path", "bits").agg(F.count("*").alias("size")).where("size > 1")
        sized = keyed.join(sizes, ["path", "bits"])
        if level < 3:
            sized = materialise(sized, f"simhash-buckets-{level}")
        cold = sized.where(F.col("size") <= bucket) if level < 3 else sized
        dealt = cold.select("path", "bits", "fp").repartition("path", "bits").sortWithinPartitions("path", "bits", "fp")
        found = dealt.mapInArrow(_compare(radius), "a long, b long")
        links = found if links is None else links.unionByName(found)
        if level == 3:
            break
        open_rows = sized.where(F.col("size") > bucket).select("fp", "path", "bits", "open")
        if not open_rows.take(1):
            break
    return links.distinct()


def near_duplicates(docs: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Per document: doc_id, fingerprint (16 hex digits), component_id, n_in_class.

    ``component_id`` is the least doc_id that links of at most ``radius`` bits
    reach; ``n_in_class`` counts the documents with the same fingerprint. Null
    and empty texts and texts of white space have fingerprint zero and are
    linked like any other. Null doc_ids are labelled like any document but
    give no component its name (null where no other is in it). Repeated rows
    are in one class; an empty table gives no rows; other columns are ignored.
    """
    prints = materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), fingerprint(F.col("text")).alias("fp")), "simhash-prints")
    classes = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n_in_class")), "simhash-classes")
    links = near_links(classes.select("fp"), radius, bucket)
    groups = connected_components(links, "simhash-links")
    member = classes.join(groups.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = member.groupBy("component").agg(F.min("least").alias("component_id"))
    named = member.join(least, "component").select("fp", "component_id", "n_in_class")
    return prints.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "n_in_class")


def one_of_each_group(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs``, all columns, without near copies of a document with a smaller doc_id.

    Of repeated rows with the same doc_id, and of a component without any
    doc_id, one row stays.
    """
    fp, least, row = (free_name(docs, n) for n in ("simhash_fp", "simhash_least", "simhash_row"))
    marked = materialise(docs.withColumn(fp, fingerprint(docs["text"])).withColumn(row, F.monotonically_increasing_id()), "simhash-docs")
    classes = materialise(marked.groupBy(F.col(fp).alias("fp")).agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col(row).alias("row"))).alias("least")), "simhash-classes")
    groups = connected_components(near_links(classes.select("fp"), radius), "simhash-links")
    member = classes.join(groups.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    keep = member.groupBy("component").agg(F.min("least").alias("least")).select(F.col("least.row").alias(least))
    return marked.join(keep, F.col(row) == F.col(least), "left_semi").drop(fp, row)
