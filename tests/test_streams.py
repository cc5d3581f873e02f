"""Streams: sessions, rates and corrections against the same rows as a batch."""

import random

import pytest
from pyspark.sql import functions as F

from fundloom.operators import catalogue, chunking
from fundloom.sources import sinks
from fundloom.streaming import events

EVENTS = "/root/testdata/sf0.001/events.parquet"


def _stream(spark, rows, folder):
    rows.write.mode("append").parquet(folder)
    return spark.readStream.schema(rows.schema).parquet(folder)


def test_stream_sessions_are_those_of_the_batch(spark, tmp_path):
    rows = spark.read.parquet(EVENTS)
    events.run_to_table(events.sessions(_stream(spark, rows, f"{tmp_path}/in")), f"{tmp_path}/out", f"{tmp_path}/check")
    done = {tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").select("user_id", "start", "n").collect()}
    batch = {tuple(r) for r in events.sessions(rows).select("user_id", "start", "n").collect()}
    assert done and done <= batch


def plain_limit(rows, limit, window):
    """The rule as a plain loop: what is in the window is dropped from the left, and only allowed hits are appended."""
    out, kept = {}, {}
    for at, event, user in sorted((at, event, user) for event, user, at in rows):
        hits = kept.setdefault(user, [])
        while hits and at - hits[0] >= window:
            hits.pop(0)
        out[event] = (len(hits), len(hits) < limit, 0 if len(hits) < limit else window - (at - hits[0]))
        if len(hits) < limit:
            hits.append(at)
    return out


def test_refused_hits_do_not_count(spark):
    at = [0, 10, 20, 30, 40, 50, 65, 75, 85]
    rows = spark.createDataFrame([(k, 1, t) for k, t in enumerate(at)], "event_id long, user_id long, s long").select("event_id", "user_id", F.timestamp_seconds("s").alias("ts"))
    got = {r.event_id: r for r in events.rate_limit(rows, 60, 2).collect()}
    assert [at[k] for k in range(9) if got[k].allowed] == [0, 10, 65, 75]
    assert got[2].retry_us == 40_000_000 and got[8].retry_us == 40_000_000


def _hits(rng, n):
    rows, clock = [], 0
    for k in range(n):
        clock += rng.choice([0, 1, 3, 20, 59, 60, 61, 500])
        rows.append((k, rng.choice([1, 1, 1, 2, 3]), clock))
    return rows


def test_rate_limit_against_a_plain_loop(spark):
    rng = random.Random(26)
    rows = _hits(rng, 3000)
    shuffled = rng.sample(rows, len(rows))
    df = spark.createDataFrame(shuffled, "event_id long, user_id long, s long").repartition(5).select("event_id", "user_id", F.timestamp_seconds("s").alias("ts"))
    for limit in (1, 2, 5):
        want = plain_limit([(e, u, s * 1_000_000) for e, u, s in rows], limit, 60_000_000)
        got = {r.event_id: (r.hits, r.allowed, r.retry_us) for r in events.rate_limit(df, 60, limit).collect()}
        assert got == want
        assert len({x[1] for x in want.values()}) == 2
    odd = spark.createDataFrame([(1, None, 5), (2, None, 6), (3, 1, None)], "event_id long, user_id long, s long").select("event_id", "user_id", F.timestamp_seconds("s").alias("ts"))
    assert sorted((r.event_id, r.allowed) for r in events.rate_limit(odd, 60, 1).collect()) == [(1, True), (2, False)]
    assert events.rate_limit(df.where("false"), 60, 1).count() == 0


def test_stream_rate_limit_goes_on_after_a_restart(spark, tmp_path):
    """Three runs of one stream from its checkpoint decide as one batch does; states are cleared behind the watermark."""
    rng = random.Random(27)
    rows = _hits(rng, 600)
    for k in range(3):
        part = spark.createDataFrame(rows[200 * k : 200 * k + 200], "event_id long, user_id long, s long").select("event_id", "user_id", F.timestamp_seconds("s").alias("ts"))
        stream = events.stream_rate_limit(_stream(spark, part.coalesce(1), f"{tmp_path}/in"), 60, 2, "10 minutes")
        events.run_to_table(stream, f"{tmp_path}/out", f"{tmp_path}/check")
    got = {r.event_id: (r.hits, r.allowed, r.retry_us) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == plain_limit([(e, u, s * 1_000_000) for e, u, s in rows], 2, 60_000_000)


def test_session_checks(spark):
    stamp = lambda *names: [F.timestamp_seconds(n).alias(n) for n in names]
    issued = spark.createDataFrame([(1, 7, 0, 1000), (2, 8, 0, 1000), (3, 9, 0, 1000)], "session_id long, user_id long, issued_at long, expires_at long").select("session_id", "user_id", *stamp("issued_at", "expires_at"))
    users = spark.createDataFrame([(7, True), (8, False)], "user_id long, is_active boolean")
    data = [(10, 1, 60), (11, 1, 61), (12, 1, 121), (13, 1, 122), (14, 1, 999), (15, 1, 1000), (16, 1, 1001), (20, 2, 5), (21, 2, 6), (22, 2, 2000), (30, 3, 1), (40, None, 1), (41, 99, 1), (9, 1, -5)]
    requests = spark.createDataFrame(data, "event_id long, session_id long, ts long").select("event_id", "session_id", *stamp("ts"))
    got = {r.event_id: (r.reason or r.valid, r.refreshed) for r in events.session_checks(requests.repartition(3), issued, users).collect()}
    assert got == {
        9: ("unknown", False), 10: (True, False), 11: (True, True), 12: (True, False), 13: (True, True), 14: (True, True), 15: ("expired", False), 16: ("unknown", False),
        20: ("inactive", False), 21: ("unknown", False), 22: ("unknown", False), 30: ("inactive", False), 40: ("unknown", False), 41: ("unknown", False),
    }


def test_late_corrections_are_applied_once(spark, tmp_path):
    path = f"{tmp_path}/table"
    spark.createDataFrame([(1, "2024-01", 1.0), (2, "2024-01", 2.0)], "k int, month string, v double").write.partitionBy("month").parquet(path)
    rows = spark.createDataFrame([(2, "2024-02", 2.5), (3, "2024-02", 3.0)], "k int, month string, v double")
    stream = _stream(spark, rows, f"{tmp_path}/in")

    def apply(batch, _):
        for _ in range(2):  # as after a failure between the write and the commit
            sinks.upsert_partitions(spark, path, sinks.last_of_each(batch, ["k"], F.col("v")), ["k"], "month")

    events.upsert_each_batch(stream, apply, f"{tmp_path}/check")
    events.upsert_each_batch(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), apply, f"{tmp_path}/check")
    assert sorted(tuple(r) for r in spark.read.parquet(path).select("k", "month", "v").collect()) == [(1, "2024-01", 1.0), (2, "2024-02", 2.5), (3, "2024-02", 3.0)]


def test_documents_are_read_with_reasons(spark, tmp_path):
    (tmp_path / "a.txt").write_text("One. Two.", encoding="utf-8")
    (tmp_path / "b.md").write_bytes(b"\xff\xfe")
    (tmp_path / "c.txt").write_bytes(b"")
    (tmp_path / "d.txt").write_bytes(b"x\x00y")
    (tmp_path / "e.pdf").write_bytes(b"%PDF")
    got = {r.name: (r.content, r.reason) for r in chunking.read_documents(spark, f"file://{tmp_path}").collect()}
    assert got == {"a.txt": ("One. Two.", None), "b.md": (None, "the file isn't UTF-8 text"), "d.txt": (None, "the file holds a NUL character")}


def test_reindex_follows_the_settings(spark):
    docs = spark.createDataFrame([(1, "indexed", {"a": "1", "b": "2"}), (2, "indexed", {"a": "1"}), (3, "indexed", None), (4, "failed", None)], "doc_id int, status string, index_config map<string,string>")
    assert sorted(r.doc_id for r in chunking.needing_reindex(docs, {"a": "1", "b": "2"}).collect()) == [2, 3]


def test_ambiguous_words_name_no_fund(spark):
    funds = spark.createDataFrame([(1, "A1", "Aurora Bond Fund - Growth"), (2, "A2", "Aurora Gilt Fund (Direct)"), (3, "B1", "Boreal Fund"), (4, "A3", "Aurora Bond Fund - IDCW")], "fund_id int, code string, name string")
    asked = spark.createDataFrame([(1, "How is Aurora doing?"), (2, "How is Boreal doing?"), (3, "the aurora bond fund, please"), (4, "what of pre-A1 or A2."), (5, "Boreal-like funds")], "query_id int, question string")
    found = catalogue.mentioned_funds(asked, catalogue.fund_aliases(funds)).collect()
    assert sorted((r.query_id, r.fund_id) for r in found) == [(2, 3), (3, 1), (3, 4), (4, 2)]


def test_names_of_many_words_are_found(spark):
    name = "Alpha Beta Gamma Delta Epsilon Zeta Eta Theta Iota Kappa Lambda Fund"
    funds = spark.createDataFrame([(1, "A1", name), (2, "A2", "Alpha Beta Fund")], "fund_id int, code string, name string")
    asked = spark.createDataFrame([(1, f"How is {name} doing?"), (2, "and alpha beta gamma delta"), (3, name.replace("Kappa", "K"))], "query_id int, question string")
    aliases = catalogue.fund_aliases(funds)
    assert max(len(r.alias.split()) for r in aliases.collect()) == 12
    got = sorted((r.query_id, r.fund_id) for r in catalogue.mentioned_funds(asked, aliases).collect())
    assert got == [(1, 1), (1, 2), (2, 1), (2, 2), (3, 1), (3, 2)]
    only = aliases.where("alias LIKE '% lambda fund'")
    assert [(r.query_id, r.fund_id) for r in catalogue.mentioned_funds(asked, only).collect()] == [(1, 1)]


def test_an_upsert_that_broke_off_is_finished(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/table"
    spark.createDataFrame([(1, "a/1", 1.0), (2, "b", 2.0), (3, None, 3.0), (4, "c", 4.0)], "k int, part string, v double").write.partitionBy("part").parquet(path)
    first = spark.createDataFrame([(1, "b", 1.5), (3, "c", 3.5)], "k int, part string, v double")
    finish, calls = sinks.finish_upsert, []

    def breaks(*args):
        calls.append(args)
        if len(calls) == 2:
            raise OSError("the driver is gone")
        return finish(*args)

    monkeypatch.setattr(sinks, "finish_upsert", breaks)
    with pytest.raises(OSError, match="gone"):
        sinks.upsert_partitions(spark, path, first, ["k"], "part")
    monkeypatch.setattr(sinks, "finish_upsert", finish)
    read = lambda: sorted((r.k, r.part, r.v) for r in spark.read.parquet(path).select("k", "part", "v").collect())
    assert (1, "a/1", 1.0) in read()
    sinks.upsert_partitions(spark, path, spark.createDataFrame([(4, "c", 4.5)], "k int, part string, v double"), ["k"], "part")
    assert read() == [(1, "b", 1.5), (2, "b", 2.0), (3, "c", 3.5), (4, "c", 4.5)]
    assert not sinks.finish_upsert(spark, path, "part")
    assert sorted(p.name for p in (tmp_path / "table").iterdir() if p.name.startswith("part=")) == ["part=b", "part=c"]


def test_mentions_meet_classes_of_funds(spark):
    n = 2500
    funds = spark.range(n).select(F.col("id").alias("fund_id"), F.concat(F.lit("C"), "id").alias("code"), F.lit("Aurora Bond Fund").alias("name")).unionByName(spark.createDataFrame([(n, "X1", "Boreal Gilt Fund")], "fund_id long, code string, name string"))
    asked = spark.createDataFrame([(1, "how is aurora bond, C7?"), (2, "what of C7 and X1?"), (3, "nothing"), (None, "boreal or X1")], "query_id int, question string")
    found = catalogue.mentioned_funds(asked, catalogue.fund_aliases(funds))
    assert sorted(((r.query_id or 0, r.fund_id) for r in found.collect())) == [(0, n), *((1, i) for i in range(n)), (2, 7), (2, n)]
    # No row of a pair is dealt out: the exchanges hold blocks.
    sorts = found._jdf.queryExecution().optimizedPlan().toString().split("Generate explode(fund_ids")[0]
    assert "Aggregate [query_id" not in sorts and "Distinct" not in sorts
