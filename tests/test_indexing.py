"""The indexing queue over restarts, repeats and a job that never ends."""

import time

from fundloom.operators.chunking import chunks_of
from fundloom.streaming import indexing

SCHEMA = "doc_id long, event_id long, kind string, text string, scanned boolean, message string"
TEXT = " ".join(f"Word{k} ends here." for k in range(300))


def ran(spark, tmp_path, rows, timeout=600.0, stay=0.0):
    """What one run of the stream adds; each run begins from the checkpoint of the one before.

    With timers by processing time there is always another batch to come, so a run is stopped once its rows are done.
    """
    spark.createDataFrame([(*r, *[None] * (6 - len(r))) for r in rows], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
    out = []
    states = indexing.indexing_states(stream, timeout, "v1").writeStream.foreachBatch(lambda df, n: out.extend((n, r) for r in df.collect())).outputMode("update").option("checkpointLocation", f"{tmp_path}/check")
    query = states.trigger(processingTime="1 second").start()
    try:
        end = time.time() + 60
        while not any(p["numInputRows"] for p in query.recentProgress) and query.isActive and time.time() < end:
            time.sleep(0.2)
        time.sleep(stay)
    finally:
        query.stop()
    rows = [r for _, r in out]
    return [(r.doc_id, r.before, r.status) for r in rows], rows


def test_states_over_restarts(spark, tmp_path):
    got, _ = ran(spark, tmp_path, [(1, 1, "uploaded"), (2, 1, "uploaded"), (3, 1, "uploaded"), (4, 1, "started"), (1, 2, "started"), (2, 2, "started"), (3, 2, "started")])
    assert sorted(got, key=str) == sorted([(d, None, "pending") for d in (1, 2, 3)] + [(d, "pending", "processing") for d in (1, 2, 3)], key=str)
    got, rows = ran(spark, tmp_path, [(1, 3, "extracted", TEXT), (2, 3, "extracted", None, True), (3, 3, "failed", None, None, "x" * 900)])
    assert sorted(got) == [(1, "processing", "indexed"), (2, "processing", "needs_ocr"), (3, "processing", "failed")]
    by = {r.doc_id: r for r in rows}
    assert (by[1].chunk_count, by[1].index_config) == (len(chunks_of(TEXT)), "v1") and len(by[3].message) == 500 and by[2].chunk_count == 0
    # Repeats and events that don't fit change nothing; a failed one can go again.
    got, rows = ran(spark, tmp_path, [(1, 3, "extracted", TEXT), (1, 4, "started"), (3, 4, "reindex"), (3, 5, "started"), (3, 6, "extracted", " ")])
    assert got == [(3, "failed", "pending"), (3, "pending", "processing"), (3, "processing", "failed")]
    assert rows[-1].message == indexing.NO_TEXT and rows[-1].attempt == 2
    got, _ = ran(spark, tmp_path, [(1, 5, "deleted"), (1, 6, "reindex"), (1, 7, "uploaded")])
    assert got == [(1, "indexed", "deleted"), (1, None, "pending")]


def test_a_job_that_never_ends_fails(spark, tmp_path):
    got, _ = ran(spark, tmp_path, [(1, 1, "uploaded"), (1, 2, "started"), (2, 1, "uploaded"), (2, 2, "started"), (2, 3, "extracted", TEXT)], 1.0)
    more, _ = ran(spark, tmp_path, [(3, 1, "uploaded")], 1.0, stay=6)
    both = got + more
    assert (1, "processing", "failed") in both and (2, "processing", "indexed") in both and (2, "processing", "failed") not in both
    late, _ = ran(spark, tmp_path, [(1, 3, "extracted", TEXT)], 1.0)
    assert late == []
