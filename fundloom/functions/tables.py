"""Table functions for SQL: ``register(spark)`` makes ``chunks`` and ``lexemes`` callable with LATERAL."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from fundloom.operators.chunking import chunks_of


# LATERAL takes no table function over whole Arrow arrays; rows go to and from these in Arrow batches.
@udtf(returnType="chunk_index int, page_start int, page_end int, heading string, content string, word_count int, is_table boolean, flags array<string>", useArrow=True)
class Chunks:
    """The chunks of a text; a null or empty text has none."""

    def eval(self, text: str) -> Iterator[tuple]:
        if text:
            yield from chunks_of(text)


@udtf(returnType="lexeme string, place int", useArrow=True)
class Lexemes:
    """The stems of a text with the places of their words; stop words have a place and no row."""

    def eval(self, text: str) -> Iterator[tuple]:
        import pyarrow as pa

        from fundloom.operators.lexical import words_with_places

        _, place, code, names = words_with_places(pa.array([text], pa.string()))
        yield from zip([names[c] for c in code.tolist()], place.tolist(), strict=True)


def register(spark: SparkSession) -> None:
    """``SELECT d.doc_id, c.* FROM documents d, LATERAL chunks(d.text) c``, and ``lexemes`` likewise."""
    spark.udtf.register("chunks", Chunks)
    spark.udtf.register("lexemes", Lexemes)
