"""Helpers that several operators use: shared storage and row streaming."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors share.

    Where the setting is empty a local session gets a temporary folder, set as
    its checkpoint folder. On a cluster that would be a folder of the driver
    alone, so there it is an error.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not folder:
        folder = context.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def fresh_folder(spark: SparkSession, tag: str) -> str:
    """A new folder in the shared one, below a folder of this application."""
    return f"{shared_folder(spark)}/fundloom/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared storage, if it is there."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    This cuts the lineage: a lost executor costs no recomputation of what
    stands before, and a frame used twice is computed once. The table stays
    for as long as its frame may be read; ``Scratch`` is for tables that needn't.
    """
    path = fresh_folder(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables in the shared folder that are deleted where the ``with`` block ends, also after an error.

    What leaves the block has to be written by ``materialise``.
    """

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.folder, self.count = spark, fresh_folder(spark, tag), 0
        self.held: list[tuple[DataFrame, str]] = []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        delete_folder(self.spark, self.folder)

    def path(self, tag: str) -> str:
        self.count += 1
        return f"{self.folder}/{self.count}-{tag}"

    def table(self, df: DataFrame, tag: str, compression: str | None = None) -> DataFrame:
        path = self.path(tag)
        df.write.parquet(path, compression=compression)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.held.append((out, path))
        return out

    def drop(self, table: DataFrame) -> None:
        """Delete a table that nothing reads any more; a frame that isn't one of these tables stays."""
        for k, (held, path) in enumerate(self.held):
            if held is table:
                delete_folder(self.spark, path)
                del self.held[k]
                return


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Within the block, files of a shuffle go where the query that wrote them ends, not when the driver collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def free_name(df: DataFrame, wish: str) -> str:
    """A column name that ``df`` has not, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish += "_"
    return wish


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id's digits has remainder 0 when divided by 5; such rows teach nothing, a null id isn't one."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def rows_of(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """The rows of Arrow batches as tuples of Python values."""
    for batch in batches:
        yield from zip(*(batch.column(n).to_pylist() for n in names), strict=True)
