"""near_duplicates compares all pairs of a question's list, up to rank 30."""

import pyarrow as pa
import pyarrow.parquet as pq

from fundloom.plans import documents


def test_pairs_beyond_rank_ten(spark, tmp_path):
    words = [f"alpha{chr(97 + i)}" for i in range(12)]
    texts = [" ".join(words)] * 30
    pq.write_table(pa.table({"doc_id": pa.array(range(30), pa.int64()), "text": texts}), f"{tmp_path}/documents.parquet")
    pq.write_table(pa.table({"item_id": pa.array([1], pa.int64()), "text": [" ".join(words)]}), f"{tmp_path}/benchmark.parquet")
    got = {(r.query_id, r.a, r.b, r.similarity) for r in documents.near_duplicates(spark, str(tmp_path)).collect()}
    assert got == {(1, a, b, 1.0) for a in range(30) for b in range(a + 1, 30)}
