"""Table functions in SQL and the data source of text files."""

from fundloom.functions import tables
from fundloom.operators import chunking, lexical
from fundloom.sources import textfiles

SF = "/root/testdata/sf0.001"


def test_chunks_in_sql_are_those_of_the_operator(spark):
    tables.register(spark)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    docs.unionByName(spark.createDataFrame([(-1, None), (-2, ""), (-3, "# A\nOne two.")], "doc_id long, text string")).createOrReplaceTempView("research")
    got = spark.sql("SELECT d.doc_id, c.* FROM research d, LATERAL chunks(d.text) c")
    want = chunking.chunk_documents(spark.table("research"))
    assert got.columns == want.columns
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    lexemes = spark.sql("SELECT d.doc_id, l.lexeme, l.place FROM research d, LATERAL lexemes(d.text) l").collect()
    passages = spark.table("research").selectExpr("doc_id AS passage_id", "text AS content")
    assert sorted(tuple(r) for r in lexemes) == sorted((r.passage_id, r.lexeme, p) for r in lexical.lexeme_places(passages).collect() for p in r.places)


def test_text_files(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    for name, data in {"a.txt": b"One. Two.", "deep/b.md": b"\xff\xfe", "c.TXT": b"", "d.txt": b"x\x00y", "e.pdf": b"%PDF", "f.txt": b"One. Two.", "g.md": b"y" * 50, "h.txt": "Größe".encode()}.items():
        (tmp_path / name).write_bytes(data)
    rows = textfiles.read_texts(spark, str(tmp_path), longest=40, together=12)
    got = {r.name: (r.content, r.reason) for r in rows.collect()}
    assert got == {
        "a.txt": ("One. Two.", None), "b.md": (None, "the file isn't UTF-8 text"), "c.TXT": (None, "the file is empty"), "d.txt": (None, "the file holds a NUL character"),
        "f.txt": (None, "another file has this content"), "g.md": (None, "the file is too large"), "h.txt": ("Größe", None),
    }
    assert spark.read.format("research_texts").option("together", 12).load(str(tmp_path)).rdd.getNumPartitions() > 2
    (tmp_path / "none").mkdir()
    assert textfiles.read_texts(spark, str(tmp_path / "none")).count() == 0
