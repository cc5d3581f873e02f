"""Runs of 50 words that are longer than 63 lines, as lines of CRLF texts between them hold no word."""

from fundloom.llm import linedup


def test_long_runs_with_wordless_lines(spark):
    passage = "\n\r\n".join(f"word{i}" for i in range(50))
    docs = spark.createDataFrame([(1, passage), (2, "other\n" + passage)], "doc_id long, text string")
    got = {r.doc_id: (r.n_deleted, r.words_deleted) for r in linedup.without_repeats(docs).collect()}
    assert got == {1: (0, 0), 2: (99, 50)}
