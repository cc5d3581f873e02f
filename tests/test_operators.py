import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fundloom.functions import text as tx
from fundloom.operators import catalogue, chunking, learning, metrics, optimise, retrieval, series, simulate
from fundloom.sources import csvkinds, sinks
from fundloom.streaming import events


def levels(spark, values, name="a"):
    day = dt.date(2024, 1, 1)
    return spark.createDataFrame([(name, day + dt.timedelta(days=i), float(v)) for i, v in enumerate(values)], "series_id string, obs_date date, level double")


def test_drawdown_takes_first_ties_and_recovery(spark):
    r = series.worst_drawdown(levels(spark, [100, 120, 90, 120, 90, 130])).first()
    assert (r["max_drawdown"], r["peak_date"].day, r["trough_date"].day, r["recovery_date"].day) == (-0.25, 2, 3, 4)
    flat = series.worst_drawdown(levels(spark, [1, 2, 3])).first()
    assert flat["max_drawdown"] == 0 and flat["recovery_date"] is None


def test_cumulative_return_and_short_series(spark):
    assert metrics.growth(levels(spark, [100, 110, 99])).first()["cumulative_return"] == pytest.approx(-0.01)
    few = metrics.return_statistics(series.simple_returns(levels(spark, [100, 110, 99]))).first()
    assert few["volatility"] is None and few["observations"] == 2
    assert metrics.growth(levels(spark, [])).count() == 0


def test_beta_of_twice_the_benchmark(spark):
    r = 0.01 * np.sin(np.arange(80))
    b = levels(spark, np.cumprod(np.concatenate([[1], 1 + r]))).select("obs_date", F.col("level").alias("value"))
    got = metrics.benchmark_statistics(series.aligned_returns(levels(spark, np.cumprod(np.concatenate([[1], 1 + 2 * r]))), b)).first()
    assert got["beta"] == pytest.approx(2) and got["correlation"] == pytest.approx(1)


def test_histogram_of_equal_returns(spark):
    rows = metrics.histogram(series.simple_returns(levels(spark, [1, 2, 4, 8])), 4).collect()
    assert sum(r["n"] for r in rows) == 3 and len(rows) == 4


def test_sip_projection(spark):
    plans = spark.createDataFrame([("p", 100.0, 1, 0.12, 0.0, 0.0)], "plan_id string, monthly double, years int, annual_return double, lumpsum double, step_up double")
    m = 1.12 ** (1 / 12)
    assert simulate.sip_projection(plans).first()["value"] == pytest.approx(sum(100 * m**k for k in range(1, 13)))


def test_optimiser_against_a_grid():
    rng = np.random.default_rng(3)
    for _ in range(20):
        a = rng.normal(size=(40, 3))
        mu, cov = rng.normal(0.1, 0.05, 3), np.cov(a, rowvar=False)
        w = optimise.mean_variance(mu, cov, 3.0, 0.05, 0.7)
        assert w.sum() == pytest.approx(1) and w.min() >= 0.05 - 1e-9 and w.max() <= 0.7 + 1e-9
        best = max(x @ mu - 1.5 * x @ cov @ x for i in np.linspace(0.05, 0.7, 66) for j in np.linspace(0.05, 0.7, 66) for x in [np.array([i, j, 1 - i - j])] if 0.05 <= 1 - i - j <= 0.7)
        assert w @ mu - 1.5 * w @ cov @ w >= best - 1e-9
    with pytest.raises(ValueError):
        optimise.check_bounds(3, 0.0, 0.2)


def test_minimum_variance_of_two_assets():
    w = optimise.minimum_variance(np.array([0.1, 0.2]), np.diag([0.04, 0.16]))
    assert w == pytest.approx([0.8, 0.2], abs=1e-6)
    x = np.random.default_rng(0).normal(size=(100, 4))
    x = x - x.mean(axis=0)
    cov, share = optimise.shrunk(x.T @ x / 100, (x**2).T @ (x**2) / 100, 100)
    assert 0 <= share <= 1 and np.allclose(cov, cov.T)


def test_isolation_forest_finds_the_planted_day():
    x = np.random.default_rng(1).normal(0, 0.01, (600, 2))
    x[500] = -0.12
    assert int(np.argmax(learning.isolation_scores(x, 100, 42))) == 500


def test_csv_file_with_errors(spark, tmp_path):
    lines = ["Scheme Code,Date,NAV", "FS-1,2025-01-01,10", "FS-1,2025-01-01,10.0", "FS-2,02-01-2025,11", "FS-2,2025-01-03,", "FS-2,99-99-2025,1", "FS-2,2025-01-05,-3", "FS-3,2025-01-01,1", "FS-3,2025-01-01,2", "FS-4,2030-01-01,5", ",,"]
    (tmp_path / "nav.csv").write_text("\n".join(lines))
    raw = csvkinds.read_csv(spark, str(tmp_path / "nav.csv"), "nav")
    got = {r["line"]: r["reason"] for r in csvkinds.resolved_keys(csvkinds.validated(raw, "nav", F.lit("2025-10-05").cast("date")), "nav").collect()}
    assert got[2] is None and got[4] is None
    assert got[3] == "duplicate of line 2" and got[5] == "nav: value is missing" and got[6] == "date: not a date" and got[7] == "nav: must be positive"
    assert got[8] == "conflicting duplicate key" and got[9] == "conflicts with line 8" and got[10] == "date: is in the future" and len(got) == 9


def test_upsert_rewrites_touched_partitions(spark, tmp_path):
    old = spark.createDataFrame([(1, "a", 1), (2, "a", 1), (3, "b", 1)], "k int, p string, v int")
    old.write.partitionBy("p").parquet(f"{tmp_path}/t")
    sinks.upsert_partitions(spark, f"{tmp_path}/t", spark.createDataFrame([(2, "a", 9), (4, "a", 9)], "k int, p string, v int"), ["k"], "p")
    assert sorted((r["k"], r["v"]) for r in spark.read.parquet(f"{tmp_path}/t").collect()) == [(1, 1), (2, 9), (3, 1), (4, 9)]


def test_chunks_hold_headings_tables_and_all_words():
    text = "INTRO\nOne two three. Four five six.\n\n# Part\n" + " ".join(f"Word{i} is here." for i in range(200)) + "\n\na | b\n1 | 2\n3 | 4\n"
    got = chunking.chunks_of(text, 60, 10, 5)
    assert [c[0] for c in got] == list(range(len(got))) and got[0][3] == "INTRO" and got[-1][6]
    assert all(f"Word{i}" in " ".join(c[4] for c in got) for i in range(200)) and max(c[5] for c in got) <= 90
    assert chunking.chunks_of("", 60, 10, 5) == []


def test_near_duplicates_brute_force(spark):
    texts = ["a b c d e f g h i j k l m n o p q r s t u v w x y z", "a b c d e f g h i j k l m n o p q r s t u v w x y zz", "entirely other words stand in this one here", "", None]
    rows = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "query_id long, passage_id long, content string")
    got = retrieval.near_duplicates(rows).collect()
    assert [(r["a"], r["b"]) for r in got] == [(0, 1)]


def test_text_functions(spark):
    row = spark.createDataFrame([("We grew 12.5% [S1, T3] to 1,250 in 2024 [S9] and [1].", "It was 12.46 and 1250")], "a string, b string")
    got = row.select(tx.marks(F.col("a")).alias("m"), tx.ungrounded(tx.numbers(F.col("b")), tx.numbers(F.col("a"))).alias("u"), tx.shingles(F.lit("x y")).alias("s")).first()
    assert got["m"] == ["S1", "T3", "S9"] and got["u"] == ["12.46"] and got["s"] == ["x y"]


def test_stream_of_event_files(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    source.write.parquet(f"{tmp_path}/in")
    stream = events.windowed_counts(spark.readStream.schema(source.schema).parquet(f"{tmp_path}/in"))
    events.run_to_table(stream, f"{tmp_path}/out", f"{tmp_path}/check")
    done = {tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").select("start", "event_type", "n").collect()}
    batch = {tuple(r) for r in events.windowed_counts(source).select("start", "event_type", "n").collect()}
    assert done and done <= batch  # the last windows are still open


def test_vector_search_blocks(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 8))
    v = spark.createDataFrame([(i, [float(y) for y in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = retrieval.vector_search(v.where("vec_id < 9"), v, most=5, block=4).collect()
    u = x / np.linalg.norm(x, axis=1)[:, None]
    for q in range(9):
        assert [r["passage_id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["vector_rank"])] == np.argsort(-(u @ u[q]))[:5].tolist()
    assert math.isclose(max(r["similarity"] for r in got), 1.0)


def test_excerpts_of_prose_and_tables(spark):
    asked = "expense ratio of Aurora fund"
    rows = [
        (1, asked, 10, "Intro words here. The Aurora fund has an expense ratio of one percent. It is low. More text.", 1.0, False, 1),
        (1, asked, 11, "What is the expense ratio of Aurora fund? It is 0.72 percent. See notes. Also read this. Never this.", 0.9, False, 2),
        (1, asked, 12, "Nothing relevant at all. Other matters.", 0.2, None, 3),
        (1, asked, 13, "Fund ratio\nBoreal 1\nAurora expense 2\nCirrus 3", 0.8, True, 4),
        (1, asked, 14, "Later table\nAurora 9", 0.8, True, 5),
        (2, "", 15, "", None, False, 1),
        (3, asked, 16, None, 1.0, False, 1),
        (4, asked, 17, "expense " * 200, 1.0, False, 1),
    ]
    frame = spark.createDataFrame(rows, "query_id int, question string, passage_id int, content string, coverage double, is_table boolean, place int")
    got = {r["passage_id"]: r for r in retrieval.excerpts(frame).collect()}
    assert sorted(got) == [10, 11, 13, 15, 17]
    assert got[10]["excerpt"] == "The Aurora fund has an expense ratio of one percent. It is low."
    assert got[11]["excerpt"] == "It is 0.72 percent. See notes. Also read this."
    assert got[13]["excerpt"] == "Fund ratio → Aurora expense 2" and got[13]["score"] is None
    assert got[15]["excerpt"] == "" and got[15]["score"] == 0
    assert got[17]["excerpt"] == " ".join(["expense"] * 90) + " ..."
    assert retrieval.excerpts(frame.limit(0)).count() == 0


def test_fund_mentions_collects_nothing_in_the_driver(spark):
    """Sides of its joins grow with the funds, whatever the size of the files they come from."""
    funds = spark.createDataFrame([(1, "FS1", "Alpha Growth Fund - Direct"), (2, "FS2", "Alpha Growth Fund (Regular)"), (3, "FS3", "Beta Fund")], "fund_id long, code string, name string")
    asked = spark.createDataFrame([(7, "How did Alpha Growth do?"), (8, "And FS3, pre-FS2?"), (9, "Nothing.")], "query_id long, question string")
    found = catalogue.mentioned_funds(asked, catalogue.fund_aliases(funds))
    assert sorted(map(tuple, found.collect())) == [(7, 1), (7, 2), (8, 3)]
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
