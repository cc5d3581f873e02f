"""A corpus pipeline over ``documents``: five stages, each one operator of ``fundloom.llm``.

Each stage reads all that its predecessor wrote. The first four return rows
with the columns of ``documents``; the last returns the packed pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fundloom.llm.decontaminate import clean_of_benchmark
from fundloom.llm.linedup import cut_repeats
from fundloom.llm.nearcopies import one_of_each_group
from fundloom.llm.packing import pack_documents
from fundloom.llm.shared import delete_folder, fresh_folder
from fundloom.llm.toxicity import not_toxic

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without those that hold a toxic word and score one half or more; the lexicon is learned from ``labels``.

    Null and empty texts stay, as do all texts where no label is usable.
    Repeated rows are judged one by one; an empty table gives no rows.
    """
    return not_toxic(docs, _table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without later copies of repeated runs of lines.

    Null and empty texts stay as they are; a text that loses all lines becomes
    empty. Rows with the same id and text are one document and get the same
    text; ``n_chars`` is the new length; an empty table gives no rows.
    """
    return cut_repeats(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word Jaccard of 0.8 or more), the one with the least doc_id.

    Null, empty and blank texts are copies of each other. Of repeated rows
    with one id, and of a group without ids, one row stays; an empty table
    gives no rows.
    """
    return one_of_each_group(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item.

    Null and empty texts stay, as do all texts where the benchmark is empty.
    Repeated rows are judged one by one; an empty table gives no rows.
    """
    return clean_of_benchmark(docs, _table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents' tokens in sequences of 2048.

    A null or empty text is its end id alone; repeated rows are documents of
    their own; a long text is cut; an empty table gives no rows.
    """
    return pack_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("packing", packing),
]

#: SQL can't express the learned lexicon, the fingerprints' hash or the tokenizer.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each one's rows are a table in the shared folder for the next, deleted once that is written."""
    docs, before = _table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = fresh_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            delete_folder(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
