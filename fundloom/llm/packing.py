"""Packing of tokenised documents into fixed windows by multiway differencing.

Documents are tokenised where they lie and packed in the same task, so no row
is shuffled. Each task gathers pieces until they fill a group of windows, and
partitions the group by the largest differencing method of Karmarkar and Karp:
partial partitions with the largest imbalance are merged, large sums against
small ones, until one partition of near-equal windows is left. When a window
exceeds the capacity, the partition is made again with one window more.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fundloom.llm.tokens import default_vocabulary, encoded_rows, tokenizer_of

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
END_ID = (1).to_bytes(4, "little")


def differencing(sizes: list[int], windows: int) -> list[tuple[int, list[int]]]:
    """Partition ``sizes`` into ``windows`` near-equal sums: (sum, indices) of those not empty.

    A partial partition holds its sums in descending order and leaves out
    empty windows. Ties are broken by age, so the result is determined.
    """
    heap = [(-s, i, [(s, [i])]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    age = len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        both = max(0, len(a) + len(b) - windows)
        merged = a[: len(a) - both] + b[: len(b) - both]
        merged += [(x[0] + y[0], x[1] + y[1]) for x, y in zip(a[len(a) - both :], reversed(b[len(b) - both :]), strict=True)]
        merged.sort(key=lambda w: -w[0])
        least = merged[-1][0] if len(merged) == windows else 0
        heapq.heappush(heap, (least - merged[0][0], age, merged))
        age += 1
    return heap[0][2] if heap else []


def pack_group(sizes: list[int], capacity: int) -> list[tuple[int, list[int]]]:
    """Windows of at most ``capacity``; their count rises from the least possible."""
    windows = max(1, -(-sum(sizes) // capacity))
    while True:
        found = differencing(sizes, windows)
        if not found or found[0][0] <= capacity:
            return found
        windows += 1


def _packer(capacity: int, piece: int, group_windows: int, vocabulary: str):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tokenizer = tokenizer_of(vocabulary)
        sequence = TaskContext.get().partitionId() << 40
        waiting: list[tuple] = []
        held = 0
        out: list[tuple] = []

        def close_group() -> None:
            nonlocal sequence, held
            for _, members in pack_group([w[2] for w in waiting], capacity):
                at = 0
                for i in members:
                    out.append((*waiting[i], sequence, at))
                    at += waiting[i][2]
                sequence += 1
            waiting.clear()
            held = 0

        def batch() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=[c.split()[0] for c in SCHEMA.split(", ")])
            out.clear()
            return made

        for doc_id, encoded in encoded_rows(batches, tokenizer):
            ids = encoded + END_ID
            n = len(ids) // 4
            start = 0
            while start < n:
                length = min(capacity if n - start >= capacity else piece, n - start)
                part = (doc_id, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), n)
                if length == capacity:
                    out.append((*part, sequence, 0))
                    sequence += 1
                else:
                    waiting.append(part)
                    held += length
                start += length
                if held >= group_windows * capacity:
                    close_group()
                if len(out) >= 10_000:
                    yield batch()
        close_group()
        if out:
            yield batch()

    return pack


def pack_documents(docs: DataFrame, capacity: int = 2048, piece: int = 512, group_windows: int = 128, vocabulary: str | None = None) -> DataFrame:
    """One row for each piece of a document, with the sequence and offset where it lies.

    A document's ids are those of the tokenizer, then id 1. Full windows are
    cut from its front; what is left over is cut into pieces of at most
    ``piece`` ids and packed. A null or empty text is one piece, the end id.
    Rows with a null ``doc_id`` and repeated rows are packed like any other;
    an empty table gives no rows; other columns are ignored. Sequence ids are
    unique: the partition's number above 40 bits of a running number.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return plain.mapInArrow(_packer(capacity, min(piece, capacity), group_windows, vocabulary or default_vocabulary()), SCHEMA)
