"""A Spark data source of text files for documents: ``spark.read.format("research_texts").load(folder)``.

Rows are (path, name, content, content_hash, reason) as ``read_documents``
gives them, with two differences: an empty file has a row, and a file whose
content another file of the folder has is refused as a copy of the one with the
least path. Partitions hold files of some MB in all, listed by path and size;
their contents are read by the tasks. Folders are those that every executor
reaches by a path of its own, as a data source has no Spark file system.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, name string, content string, content_hash string, reason string"
#: Bytes of files in a partition, and the largest file, at most.
PARTITION, LONGEST = 64 << 20, 20_000_000
ENDINGS = (".txt", ".md")


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class TextReader(DataSourceReader):
    def __init__(self, folder: str, longest: int, together: int):
        self.folder, self.longest, self.together = folder.removeprefix("file://"), longest, together

    def partitions(self) -> list[Files]:
        found = sorted((os.path.join(d, n), os.path.getsize(os.path.join(d, n))) for d, _, names in os.walk(self.folder) for n in names if n.lower().endswith(ENDINGS))
        parts, now, size = [], [], 0
        for path, n in found:
            if now and size + n > self.together:
                parts.append(Files(now))
                now, size = [], 0
            now.append(path)
            size += n
        return [*parts, Files(now)]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        import hashlib

        names, string = ["path", "name", "content", "content_hash", "reason"], pa.string()
        for path in partition.paths:
            content, digest, reason = None, None, None
            if os.path.getsize(path) > self.longest:
                reason = "the file is too large"
            else:
                with open(path, "rb") as f:
                    data = f.read()
                digest = hashlib.sha256(data).hexdigest()
                try:
                    content = data.decode()
                except UnicodeDecodeError:
                    reason = "the file isn't UTF-8 text"
                if content and "\0" in content:
                    content, reason = None, "the file holds a NUL character"
                elif content is not None and not content.strip():
                    content, reason = None, "the file is empty"
            row = [path, os.path.basename(path), content, digest, reason]
            yield pa.RecordBatch.from_arrays([pa.array([x], string) for x in row], names=names)


class TextFiles(DataSource):
    """Options: ``longest``, bytes of the largest file that is read, and ``together``, bytes of files in a partition."""

    @classmethod
    def name(cls) -> str:
        return "research_texts"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> TextReader:
        return TextReader(self.options["path"], int(self.options.get("longest", LONGEST)), int(self.options.get("together", PARTITION)))


def read_texts(spark: SparkSession, folder: str, **options: object) -> DataFrame:
    """The text files below ``folder``; of files with the same content all but the one with the least path are refused."""
    spark.dataSource.register(TextFiles)
    rows = spark.read.format("research_texts").options(**options).load(folder)
    first = F.min("path").over(Window.partitionBy("content_hash"))
    copy = F.col("reason").isNull() & (F.col("path") != first)
    rows = rows.withColumn("copy", copy)
    return rows.select("path", "name", F.when(~F.col("copy"), F.col("content")).alias("content"), "content_hash", F.when(F.col("copy"), "another file has this content").otherwise(F.col("reason")).alias("reason"))
