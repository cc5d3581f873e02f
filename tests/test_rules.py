"""Rules worked out by hand: alpha, splits, citations, questions, numbers, validation, upserts, shrinkage, evaluation."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fundloom.conventions import Conventions
from fundloom.functions import text as tx
from fundloom.operators import learning, metrics, optimise, portfolio, retrieval, series
from fundloom.sources import sinks


def test_alpha_takes_the_compounded_rate_of_a_period(spark):
    rng = np.random.default_rng(1)
    market = rng.normal(0.0005, 0.01, 80)
    own = 0.0002 + 0.8 * market + rng.normal(0, 0.002, 80)
    rows = spark.createDataFrame([("a", float(x), float(y)) for x, y in zip(own, market)], "series_id string, ret double, bret double")
    got = metrics.benchmark_statistics(rows).first()
    beta = np.cov(own, market, ddof=1)[0, 1] / np.var(market, ddof=1)
    rate = 1.065 ** (1 / 252) - 1
    assert got.alpha_annual == pytest.approx(((own.mean() - rate) - beta * (market.mean() - rate)) * 252, abs=1e-12)
    flat = spark.createDataFrame([("a", 0.01 + 0.001 * (i % 2), 0.01 + 0.001 * (i % 2)) for i in range(60)], "series_id string, ret double, bret double")
    assert metrics.benchmark_statistics(flat).first().alpha_annual == pytest.approx(0, abs=1e-12)
    assert Conventions().period_rate == pytest.approx(0.00024993, abs=1e-8)


def test_split_purges_after_each_cut(spark):
    rows = spark.sql("SELECT 's' AS series_id, date_add(DATE '2020-01-01', CAST(id AS INT)) AS obs_date FROM range(100)")
    parts = [r.part for r in learning.purged_split(rows, 5).orderBy("obs_date").collect()]
    assert parts == ["train"] * 70 + ["purged"] * 5 + ["validation"] * 10 + ["purged"] * 5 + ["test"] * 10
    few = learning.enough_history(learning.purged_split(rows, 5)).first()
    assert (few.n_train, few.n_validation, few.n_test, few.enough) == (70, 10, 10, False)


def test_numbers_and_grounding(spark):
    row = spark.createDataFrame([("Up 14.7%, -3.25 and 1,200.50 (v2.5, x7); 2024, 9 and 13 [S3].", "14.65% of 1,200.5 or 3.25")], "a string, b string")
    got = row.select(tx.numbers(F.col("a")).alias("n"), tx.ungrounded(tx.numbers(F.col("a")), tx.numbers(F.col("b"))).alias("u")).first()
    assert [x["raw"] for x in got.n] == ["14.7%", "-3.25", "1,200.50", "2024,", "9", "13"]
    assert got.u == ["-3.25", "13"]


def test_citations(spark):
    row = spark.createDataFrame([("Yes [S1, S9; T2] and [T1]  [S1], see [1] [S2,].",)], "a string")
    got = row.select(tx.checked_citations(F.col("a"), F.array(F.lit("S1"), F.lit("S2")), F.array(F.lit("T1"))).alias("c")).first().c
    assert got.text == "Yes [S1] and [T1] [S1], see [1] [S2,]."
    assert (got.used_sources, got.used_calculations, got.invalid_markers) == (["S1"], ["T1"], ["S9", "T2"])


def test_questions(spark):
    rows = [("What about its expense ratio?", "Tell me about Fund A", True), ("And in 2023?", None, False), ("List all large cap funds", "x", False), (" ".join(["it"] * 15), "x", False), ("Is  that\x00the latest? FY 24", "Q1", True)]
    d = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, q string, b string, f boolean")
    got = d.select("i", "f", tx.processed_question(F.col("q"), F.col("b")).alias("p")).orderBy("i").collect()
    assert all(r.p.is_follow_up == r.f for r in got)
    assert got[0].p.retrieval_text == "Tell me about Fund A What about its expense ratio?"
    assert got[1].p.mentions_period and got[4].p.mentions_period and got[4].p.wants_latest and not got[2].p.wants_latest
    assert got[4].p.original == "Is that the latest? FY 24"


def test_sentences_keep_digits_of_their_place(spark):
    texts = ["A.\n1 b 1! 21 c 2", "", None, "A.\x0bB"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(tx.sentences(F.col("t")).alias("s")).collect()
    assert [r.s for r in rows] == [["A.", "1 b 1!", "21 c 2"], [], None, ["A.\x0bB"]]


def test_words_of_questions_end_at_letters_beyond_ascii(spark):
    rows = spark.createDataFrame([("\u00e4auge \u00e4now \u00e4it",)], "q string")
    p = rows.select(tx.processed_question(F.col("q"), F.lit("before")).alias("p")).first().p
    assert p.mentions_period and p.wants_latest and p.is_follow_up


def test_text_clean_up(spark):
    row = spark.createDataFrame([("a fixed-\nterm de\u00adposit \n\n with\ttabs\u00a0 here -\nThere", "C:\\x\\..\\re\x01port.pdf", " ")], "a string, b string, c string")
    got = row.select(tx.joined_lines(F.col("a")).alias("a"), tx.display_name(F.col("b")).alias("b"), tx.display_name(F.col("c")).alias("c"), tx.scrubbed(F.lit("key abc, abc"), F.array(F.lit("abc"), F.lit(""))).alias("s")).first()
    assert (got.a, got.b, got.c, got.s) == ("a fixed-term deposit with tabs here - There", "report.pdf", "document", "key [REDACTED], [REDACTED]")


def test_levels_that_are_no_prices_are_refused(spark):
    rows = spark.createDataFrame([("a", "2024-01-01", 1.0), ("a", "2024-01-02", None), ("a", "2024-01-03", 0.0), ("a", "2024-01-04", 2.0), ("a", "2024-01-04", 2.0)], "series_id string, d string, level double").withColumn("obs_date", F.to_date("d")).drop("d")
    assert sorted(r.reason for r in series.level_faults(rows).collect()) == ["duplicate date", "missing value", "non-positive level"]
    with pytest.raises(Exception, match="missing or not positive"):
        series.simple_returns(rows).collect()


def test_shock_refuses_an_asset_without_beta(spark):
    own = spark.createDataFrame([("p", "a", 1.0), ("p", "b", 3.0)], "portfolio_id string, series_id string, weight double")
    betas = spark.createDataFrame([("a", 1.0), ("b", 0.5)], "series_id string, beta double")
    assert portfolio.market_shock(own, betas, -0.2).first().estimated_return == pytest.approx(-0.2 * (0.25 + 0.75 * 0.5))
    with pytest.raises(Exception, match="no beta for b"):
        portfolio.market_shock(own, betas.where("series_id = 'a'"), -0.2).collect()


def test_stress_with_one_correlation_equals_the_matrix(spark):
    sigma, w, mu = np.array([0.1, 0.2, 0.3]), np.array([0.5, 0.3, 0.2]), np.array([0.05, 0.07, 0.09])
    single = spark.createDataFrame([(s, float(m), float(v)) for s, m, v in zip("abc", mu, sigma)], "series_id string, mu double, sigma double")
    cov = spark.createDataFrame([(a, b, float(sigma[i] * sigma[j] * (1.0 if i == j else 0.2))) for i, a in enumerate("abc") for j, b in enumerate("abc")], "series_a string, series_b string, covariance double")
    own = spark.createDataFrame([("p", s, float(x)) for s, x in zip("abc", w)], "portfolio_id string, series_id string, weight double")
    got = {r.scenario: r for r in portfolio.assumption_stress(single, cov, own, 2.0, 0.7, -0.01).collect()}
    base = np.outer(sigma, sigma) * (0.2 + 0.8 * np.eye(3))
    hard = 4 * np.outer(sigma, sigma) * (0.7 + 0.3 * np.eye(3))
    assert got["baseline"].volatility == pytest.approx(np.sqrt(w @ base @ w)) and got["scenario"].volatility == pytest.approx(np.sqrt(w @ hard @ w))
    assert got["scenario"].expected_return == pytest.approx(w @ mu - 0.01)
    with pytest.raises(Exception, match="correlation"):
        portfolio.assumption_stress(single, cov, own, correlation=-0.9).collect()


def test_shrinkage_from_moments_and_its_trigger(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 0.01, (40, 3))
    x[:, 2] = x[:, 0] + x[:, 1]
    levels = [(s, i, float(v)) for k, s in enumerate("abc") for i, v in enumerate(np.concatenate([[1.0], np.cumprod(1 + x[:, k])]))]
    d = spark.createDataFrame(levels, "series_id string, i int, level double").select("series_id", F.date_add(F.lit("2024-01-01").cast("date"), F.col("i")).alias("obs_date"), "level")
    moments = portfolio.pair_moments(d)
    c = x - x.mean(axis=0)
    by = {(r.series_a, r.series_b): r for r in moments.collect()}
    assert by["a", "c"].s == pytest.approx((c[:, 0] * c[:, 2]).mean()) and by["a", "b"].s2 == pytest.approx(((c[:, 0] * c[:, 1]) ** 2).mean())
    own = spark.createDataFrame([("p", s, 1 / 3) for s in "abc"] + [("q", "a", 0.5), ("q", "b", 0.5)], "portfolio_id string, series_id string, weight double")
    single, _ = portfolio.estimates(d)
    got = optimise.optimise(single, moments, own).toPandas()
    assert set(got.objective) == set(optimise.OBJECTIVES) and np.allclose(got.groupby(["portfolio_id", "objective"]).weight.sum(), 1)
    assert (got[got.portfolio_id == "p"].shrinkage > 0).all() and (got[got.portfolio_id == "q"].shrinkage == 0).all()
    least = got[(got.portfolio_id == "q")].groupby("objective").volatility.first()
    assert least["minimum_variance"] <= least.min() + 1e-12
    front = optimise.efficient_frontier(single, moments, own, points=5).toPandas()
    assert front.groupby("portfolio_id").size().to_dict() == {"p": 5, "q": 5}
    assert all((g.sort_values("point").volatility.diff().dropna() >= -1e-9).all() for _, g in front.groupby("portfolio_id"))


def test_ridge_is_the_normal_equations_and_attributions_add_up():
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(60, 4)) * [1, 5, 0.1, 2], rng.normal(size=60)
    slope, constant = learning.ridge_fit(x, y, 3.0)
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    w = np.linalg.inv(z.T @ z + 3.0 * np.eye(4)) @ z.T @ (y - y.mean())
    assert np.allclose(constant + x @ slope, y.mean() + z @ w)
    parts = learning.ridge_attributions(x, y, 3.0, x[-20:], x[:2])
    assert np.allclose(parts.sum(axis=1) + (constant + x[-20:] @ slope).mean(), constant + x[:2] @ slope)


def test_upsert_moves_keys_between_partitions(spark, tmp_path):
    path = f"{tmp_path}/t"
    spark.createDataFrame([(1, "a", 1), (2, "a", 1), (3, "b", 1), (4, "c", 1)], "k int, p string, v int").write.partitionBy("p").parquet(path)
    sinks.upsert_partitions(spark, path, spark.createDataFrame([(2, "b", 9), (4, "a", 9)], "k int, p string, v int"), ["k"], "p")
    assert sorted((r["k"], r["p"], r["v"]) for r in spark.read.parquet(path).collect()) == [(1, "a", 1), (2, "b", 9), (3, "b", 1), (4, "a", 9)]
    with pytest.raises(ValueError, match="comes twice"):
        sinks.upsert_partitions(spark, path, spark.createDataFrame([(2, "b", 9), (2, "a", 9)], "k int, p string, v int"), ["k"], "p")
    twice = spark.createDataFrame([(2, "b", 1), (2, "a", 7)], "k int, p string, v int")
    assert [tuple(r) for r in sinks.last_of_each(twice, ["k"], F.col("v")).collect()] == [(2, "a", 7)]


def test_csv_export_is_quoted(spark, tmp_path):
    sinks.export_csv(spark.createDataFrame([('a "b", c', 1.25)], "n string, v double").coalesce(1), f"{tmp_path}/out")
    (file,) = (tmp_path / "out").glob("*.csv")
    assert file.read_text().splitlines() == ["n,v", '"a ""b"", c",1.25']


def test_boosts_and_order(spark):
    rows = spark.createDataFrame([(1, 10, 1, "r", "2024-01-01", 2, True), (1, 11, 1, "r", "2024-06-01", 1, False), (1, 12, None, "r", "2024-07-01", 3, True)], "query_id int, passage_id int, fund_id int, doc_type string, d string, fused_rank int, supported boolean").withColumn("as_of_date", F.to_date("d"))
    boost = lambda *a: {r.passage_id: round(r.boost, 4) for r in retrieval.boosted(rows, F.coalesce(F.col("fund_id") == 1, F.lit(False)), *a).collect()}
    assert boost(F.lit(False), F.lit(True)) == {10: 1.15, 11: 1.4375, 12: 1.0}
    assert boost(F.lit(False), F.lit(False)) == {10: 1.15, 11: 1.2075, 12: 1.0} and boost(F.lit(True), F.lit(True))[11] == 1.15
    assert [r.passage_id for r in retrieval.supported_first(rows).orderBy("final_rank").collect()] == [10, 12, 11]


def test_evidence_recall_and_gate(spark):
    passages = spark.createDataFrame([(1, 10, "The  Expense\nratio is 1%."), (1, 11, "other"), (2, 12, "nothing")], "query_id int, passage_id int, content string")
    snippets = spark.createDataFrame([(1, "expense ratio"), (1, "exit load"), (2, "x y")], "query_id int, snippet string")
    assert {r.query_id: r.evidence_recall for r in retrieval.evidence_recall(passages, snippets).collect()} == {1: 0.5, 2: 0.0}
    records = spark.createDataFrame([("hybrid", "dev", "a", 1.0, None), ("hybrid", "dev", "b", 0.5, None), ("hybrid", "holdout", "a", None, 1.0), ("vector", "dev", "a", 0.0, None)], "mode string, split string, category string, recall_5 double, abstained double")
    s = retrieval.evaluation_summary(records)
    got = {(r.grouping, r.mode, r.split, r.category): (r.questions, r.recall_5) for r in s.collect()}
    assert got["mode", "hybrid", None, None] == (3, 0.75) and got["category", "hybrid", None, "a"] == (2, 1.0) and len(got) == 8
    assert all(r.passed for r in retrieval.acceptance(s, {"recall_5": 0.75, "abstained": 1.0}, "hybrid").collect())
    assert not any(r.passed for r in retrieval.acceptance(s, {"recall_5": 0.8, "abstained": 1.0}, "hybrid").collect())
    assert not any(r.passed for r in retrieval.acceptance(s, {"recall_5": 0.5}, "hybrid", leaks=1).collect())


def test_context_selection_against_a_plain_loop(spark):
    words = lambda k, n: " ".join(f"w{k}_{i}" for i in range(n))
    rows = [(1, i, doc, words(k, n), sup, i) for i, (doc, k, n, sup) in enumerate([(1, 0, 30, True), (1, 0, 30, True), (1, 2, 40, False), (1, 3, 30, True), (2, 4, 500, True), (1, 5, 20, True), (3, 6, 10, True)])]
    d = spark.createDataFrame(rows, "query_id long, passage_id long, doc_id long, content string, supported boolean, fused_rank int")
    got = [r.passage_id for r in retrieval.select_context(d, top=4, words=100, per_document=2).orderBy("position").collect()]
    taken, used, per = [], 0, {}
    for _, i, doc, text, sup, _ in rows:
        n = len(text.split())
        if sup and text not in [rows[t][3] for t in taken] and per.get(doc, 0) < 2 and (not taken or used + n <= 100) and len(taken) < 4:
            taken.append(i)
            used, per[doc] = used + n, per.get(doc, 0) + 1
    assert got == taken == [0, 3, 6]


def test_a_period_by_dates(spark):
    from datetime import date

    rows = spark.createDataFrame([("a", date(2024, 1, d), 1.0) for d in (1, 2, 3, 4)], "series_id string, obs_date date, level double")
    assert series.in_period(rows, start=date(2024, 1, 2), end=date(2024, 1, 3)).count() == 2 and series.in_period(rows, end=date(2024, 1, 1)).count() == 1
    with pytest.raises(ValueError, match="starts after its end"):
        series.in_period(rows, start=date(2024, 1, 3), end=date(2024, 1, 2))
