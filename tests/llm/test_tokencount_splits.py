"""The separator scan against plain loops, over files that Spark reads in many splits."""

import numpy as np
import pytest

from fundloom.llm import tokencount


def loop(ids, end):
    out, start = [], 0
    for i, x in enumerate(ids):
        if x == end:
            out.append((start, i - start, True))
            start = i + 1
    return out + ([(start, len(ids) - start, False)] if start < len(ids) else [])


@pytest.mark.parametrize("end", [tokencount.END_ID, 0x0A0A, 0x0A00, 7])
@pytest.mark.parametrize("trailing", [True, False])
def test_splits_and_bytes_that_look_like_ends(spark, tmp_path, end, trailing):
    rng = np.random.default_rng(end)
    low, high = end & 255, end >> 8
    odd = [low << 8 | high, high << 8 | high, low << 8 | low, 0x0A0A ^ 1, 0x0A41, 0x410A, end]
    ids = rng.choice(np.array(odd, np.uint16), 6000)
    ids = np.concatenate([ids, [end] if trailing else [0x0A42 if end != 0x0A42 else 1]]).astype("<u2")
    (tmp_path / "a.bin").write_bytes(ids.tobytes())
    (tmp_path / "b.bin").write_bytes(np.array([end, end, 9], "<u2").tobytes())
    (tmp_path / "empty.bin").write_bytes(b"")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    try:
        got = tokencount.count_token_files(spark, f"file://{tmp_path}", end_id=end, block_ids=40).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    by = {"a": [], "b": []}
    for r in sorted(got, key=lambda r: r.ordinal):
        by[r.file[-5]].append((r.start, r.n_tokens, r.complete))
    assert by["a"] == loop(ids.tolist(), end)
    assert by["b"] == [(0, 0, True), (1, 0, True), (2, 1, False)]


def test_a_file_that_ends_inside_an_id_is_an_error(spark, tmp_path):
    (tmp_path / "half.bin").write_bytes(b"\x01\x00\x02")
    with pytest.raises(Exception, match="ends inside an id"):
        tokencount.count_token_files(spark, f"file://{tmp_path}").collect()


def test_long_and_repeated_texts_keep_their_names(spark):
    rows = [(1, "word " * 150_000), (2, ""), (2, ""), (None, None), (5, "a b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((str(r.doc_id), r.n_tokens) for r in tokencount.token_counts(docs, block_ids=1000).collect())
    assert got == [("1", 150_000), ("2", 0), ("2", 0), ("5", 2), ("None", 0)]


def test_registered_path_over_several_files(spark, tmp_path):
    """op1 on a table of several files, in more than one split: each document's name and count are its own."""
    from tokenizers import Tokenizer

    from fundloom.llm import queries
    from fundloom.llm.tokens import default_vocabulary

    rng = np.random.default_rng(5)
    words = ["alpha", "beta's", "gamma,", "Größe", "x1", "don't"]
    rows = [(i, None if i % 17 == 0 else " ".join(rng.choice(words, rng.integers(0, 40)))) for i in range(400)] + [(7, "twice"), (None, "no name")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for k in range(5):
        df.where(f"pmod(xxhash64(text, doc_id), 5) = {k}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/documents.parquet")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        found = queries.op1_tokencount(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    tokenizer = Tokenizer.from_file(default_vocabulary())
    want = [(i, len(tokenizer.encode(t or "", add_special_tokens=False).ids), True) for i, t in rows]
    assert sorted((tuple(r) for r in found), key=repr) == sorted(want, key=repr)
