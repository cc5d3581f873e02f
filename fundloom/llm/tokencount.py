"""Token counts of documents in flat, unindexed token files, by a separator scan.

A token file is a stream of fixed-width ids; an end-of-document id follows each
document and nothing tells where it stands. Spark's text reader cuts files into
splits at a byte that the end id doesn't hold, so a file of any size is read by
many tasks, a task holds one block of some hundred kB, and no end id lies
across two blocks. Each block is searched for the end id's bytes with
vectorised comparisons, wherever they stand. A prefix scan over the blocks then
tells each one's first position, which tells the ends from bytes that only look
like one, how many documents stand before it and where the last of them ended.
So documents are stitched across any number of blocks, splits and tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fundloom.llm.shared import fresh_folder, materialise
from fundloom.llm.tokens import default_vocabulary, encoded_rows, tokenizer_of

#: The end-of-document id of the 49k vocabulary; texts never give it, as its string is ordinary text here.
END_ID = 49_407
#: Ids of a block, about; a block ends where the reader's next piece does.
BLOCK_IDS = 1 << 18
SCANNED = "file string, split long, block long, size long, n long, found array<int>"


def _ids(vocabulary: str, width: int):
    kind = np.dtype(f"<u{width}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, ids in encoded_rows(batches, tokenizer_of(vocabulary, True)):
            yield pa.RecordBatch.from_arrays([pa.array([np.frombuffer(ids, "<u4").astype(kind).tobytes()], pa.binary())], names=["ids"])

    return run


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))


def write_token_files(docs: DataFrame, folder: str, vocabulary: str | None = None, end_id: int = END_ID, width: int = 2) -> None:
    """Write the texts' ids as flat files, one for each partition, to any store that Spark can write to; the end id follows each document."""
    ids = _plain(docs).mapInArrow(_ids(vocabulary or default_vocabulary(), width), "ids binary")
    end = end_id.to_bytes(width, "little").decode("latin-1")
    ids.select(F.col("ids").cast("string").alias("value")).write.option("lineSep", end).option("encoding", "ISO-8859-1").text(folder)


def _scan(width: int, end_id: int, cut: bytes, block_bytes: int):
    end = np.frombuffer(end_id.to_bytes(width, "little"), np.uint8)

    def scanned(key: tuple, block: int, pieces: list[bytes]) -> pa.RecordBatch:
        data = np.frombuffer(cut.join([*pieces, b""]), np.uint8)
        like = data[: len(data) - width + 1] == end[0] if len(data) >= width else np.zeros(0, bool)
        for k in range(1, width):
            like &= data[k : len(data) - width + 1 + k] == end[k]
        found = np.flatnonzero(like).astype(np.int32)
        file, split, size = key
        columns = [pa.array([file]), pa.array([split], pa.int64()), pa.array([block], pa.int64()), pa.array([size], pa.int64()), pa.array([len(data)], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(found)], pa.int32()), pa.array(found))]
        return pa.RecordBatch.from_arrays(columns, names=["file", "split", "block", "size", "n", "found"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, block, pieces, held = None, 0, [], 0
        for batch in batches:
            # Rows of a split follow each other; a batch may hold several.
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("file", "split", "size")), strict=True))
            data = batch.column("data").to_pylist()
            for key, piece in zip(keys, data, strict=True):
                if key != now or held >= block_bytes:
                    if pieces:
                        yield scanned(now, block, pieces)
                    block = block + 1 if key == now else 0
                    now, pieces, held = key, [], 0
                pieces.append(piece)
                held += len(piece) + 1
        if pieces:
            yield scanned(now, block, pieces)

    return run


def stitch(scanned: DataFrame, width: int = 2) -> DataFrame:
    """Documents of scanned blocks: file, ordinal, start, n_tokens, complete.

    ``start`` is the position of the first id. Ids after the last end id of a
    file are a document that isn't complete.
    """
    before = Window.partitionBy("file").orderBy("split", "block").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("file").orderBy("split", "block")
    placed = scanned.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)))
    whole = F.when(F.col("size") % width == 0, F.lit(width)).otherwise(F.raise_error(F.concat(F.col("file"), F.lit(f" ends inside an id of {width} bytes"))).cast("int"))
    ends = F.transform(F.filter("found", lambda at: (F.col("first") + at) % width == 0), lambda at: F.floor((F.col("first") + at) / width))
    placed = placed.withColumn("ends", ends).withColumn("ids", F.floor(F.col("size") / whole))
    placed = placed.withColumn("ordinal", F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0)))
    last = F.try_element_at("ends", F.lit(-1))
    placed = placed.withColumn("open", F.coalesce(F.max(last).over(before), F.lit(-1).cast("long")) + 1).withColumn("final", F.lead("n").over(after).isNull())
    pairs = F.transform("ends", lambda e, i: F.struct(e.alias("end"), F.when(i == 0, F.col("open")).otherwise(F.get(F.col("ends"), i - 1) + 1).alias("start")))
    done = placed.select("file", "ordinal", F.posexplode(pairs).alias("i", "d"))
    done = done.select("file", (F.col("ordinal") + F.col("i")).alias("ordinal"), F.col("d.start").alias("start"), (F.col("d.end") - F.col("d.start")).alias("n_tokens"), F.lit(True).alias("complete"))
    start = F.coalesce(last + 1, F.col("open"))
    rest = placed.where("final").select("file", (F.col("ordinal") + F.size("ends")).cast("long").alias("ordinal"), start.alias("start"), (F.col("ids") - start).alias("n_tokens"), F.lit(False).alias("complete"))
    return done.unionByName(rest.where("n_tokens > 0"))


def count_token_files(spark: SparkSession, folder: str, end_id: int = END_ID, width: int = 2, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Token counts of the documents in flat files of ``width``-byte little-endian ids: file, ordinal, start, n_tokens, complete.

    Files are read in splits, however large they are. An empty file has no
    document; a file that ends inside an id is an error. Files are plain, not
    compressed.
    """
    end = end_id.to_bytes(width, "little")
    cut = next(bytes([b]) for b in (10, 0, 32, 1) if b not in end)
    lines = spark.read.option("lineSep", cut.decode("latin-1")).text(folder)
    pieces = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("_metadata.file_size").alias("size"), F.col("value").cast("binary").alias("data"))
    scanned = pieces.mapInArrow(_scan(width, end_id, cut, block_ids * width), SCANNED)
    return stitch(materialise(scanned, "token-scan"), width)


def token_counts(docs: DataFrame, vocabulary: str | None = None, end_id: int = END_ID, width: int = 2, block_ids: int = BLOCK_IDS, from_files: bool = False) -> DataFrame:
    """Store ``docs(doc_id, text)`` as flat token files, scan them and return file, ordinal, start, n_tokens, complete, doc_id.

    The files hold ids only; a table of doc_ids by file and place, which the
    scan doesn't read, is joined to what it finds. For that the rows are read
    twice and have to come in the same partitions and order, as they do from
    files: ``from_files`` says so. Other rows are written as a table first. A
    document without a name, or a name without a document, is an error.

    ``n_tokens`` leaves the end id out. A null or empty text has no tokens; a
    text of any length may lie across files' blocks. Null doc_ids and repeated
    rows give a row each; an empty table gives no rows; other columns are
    ignored.
    """
    spark = docs.sparkSession
    rows = docs if from_files else materialise(docs.select("doc_id", "text"), "token-docs")
    folder = fresh_folder(spark, "tokens")
    write_token_files(rows, folder, vocabulary, end_id, width)
    found = count_token_files(spark, folder, end_id, width, block_ids).withColumn("part", F.regexp_extract("file", r"part-(\d+)-[^/]*$", 1).cast("int"))
    row = F.monotonically_increasing_id()
    names = rows.select(F.shiftright(row, 33).cast("int").alias("p"), row.bitwiseAND(F.lit((1 << 33) - 1)).alias("o"), F.col("doc_id").cast("long").alias("doc_id"))
    both = found.join(names, (found["part"] == names["p"]) & (found["ordinal"] == names["o"]), "full")
    matched = F.when(F.col("p").isNotNull() & F.col("part").isNotNull(), F.col("ordinal")).otherwise(F.raise_error(F.lit("token files and documents differ")).cast("long"))
    return both.select("file", matched.alias("ordinal"), "start", "n_tokens", "complete", "doc_id")
