"""Queries on features, models, anomalies and event streams, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fundloom.operators import learning, models, series
from fundloom.plans.common import Query, named, rounded
from fundloom.sources.adapters import LEVELS_SQL, benchmark, levels, table
from fundloom.storage import shared_folder
from fundloom.streaming import events

ANOMALY_COLUMNS = ("ret", "shock", "vol_ratio", "excess_return")


def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = learning.complete(learning.target(learning.features(levels(spark, sf_dir)), 5))
    return learning.purged_split(rows, 5)


def ml_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(learning.features(levels(spark, sf_dir)).drop("level"))


def ml_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(learning.target(levels(spark, sf_dir), 21).select("series_id", "obs_date", "target"))


def purged_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = learning.complete(learning.target(learning.features(levels(spark, sf_dir)), 21))
    return learning.purged_split(rows, 21).select("series_id", "obs_date", "part")


def split_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = learning.complete(learning.target(learning.features(levels(spark, sf_dir)), 63))
    return learning.enough_history(learning.purged_split(rows, 63))


def benchmark_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features against a benchmark that lacks every tenth date."""
    part = benchmark(spark, sf_dir).where("dayofyear(obs_date) % 10 > 0")
    return rounded(learning.benchmark_features(levels(spark, sf_dir), part).select("series_id", "obs_date", *learning.BENCHMARK_FEATURES))


def historical_mean_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(learning.mean_baseline(_split(spark, sf_dir)).select("series_id", "obs_date", "actual", "predicted"))


def regression_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(learning.regression_metrics(learning.mean_baseline(_split(spark, sf_dir))))


def ridge_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.forecast_metrics(learning.ridge_forecasts(levels(spark, sf_dir)))


def forecast_rf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.forecast_metrics(learning.forest_forecasts(levels(spark, sf_dir)))


def forecast_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ridge model's forecast from the latest row of each series, for each horizon, with features of the benchmark."""
    return learning.latest_forecasts(learning.ridge_forecasts(levels(spark, sf_dir), benchmark(spark, sf_dir)))


def forecast_attributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.attributions(learning.ridge_forecasts(levels(spark, sf_dir), benchmark(spark, sf_dir)), learning.FEATURES + learning.BENCHMARK_FEATURES)


def anomaly_drivers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three features that stand out most, for the days of each series with a return beyond four robust deviations."""
    rows = learning.anomaly_features(series.simple_returns(levels(spark, sf_dir)), benchmark(spark, sf_dir)).dropna()
    far = learning.robust_scores(rows, "ret").where(F.abs("z") > 4).select("series_id", "obs_date")
    found = learning.drivers(rows, ANOMALY_COLUMNS).join(far, ["series_id", "obs_date"])
    return found.select("series_id", "obs_date", F.array_join(F.transform("drivers", lambda d: d["feature"]), ",").alias("drivers"), F.round(F.get("drivers", F.lit(0))["z"], 6).alias("first_z"))


def anomaly_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(learning.anomaly_features(series.simple_returns(levels(spark, sf_dir)), benchmark(spark, sf_dir)))


def robust_zscores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(learning.robust_scores(series.simple_returns(levels(spark, sf_dir)).select("series_id", "obs_date", "ret"), "ret"))


def isolation_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = learning.anomaly_features(series.simple_returns(levels(spark, sf_dir)), benchmark(spark, sf_dir))
    return learning.isolation_forest(rows, ANOMALY_COLUMNS)


def move_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each day's move in words, its figures written as x."""
    rows = learning.anomaly_features(series.simple_returns(levels(spark, sf_dir)), benchmark(spark, sf_dir))
    ret, bench = (F.round(c, 6) for c in ("ret", "benchmark_return"))
    return rows.select("series_id", "obs_date", F.regexp_replace(learning.move_reading(ret, bench), r"[+-]\d+\.\d+%", "x").alias("kind"), F.round("ret", 6).alias("ret"))


def anomaly_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The isolation forest's days with their scores, drivers and readings."""
    rows = learning.anomaly_features(series.simple_returns(levels(spark, sf_dir)), benchmark(spark, sf_dir))
    return learning.anomaly_report(rows, learning.isolation_forest(rows, ANOMALY_COLUMNS), ANOMALY_COLUMNS)


def model_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.fingerprint(levels(spark, sf_dir), "ridge", 21)


def stored_forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecasts of ridge models from a registry of this session, which is filled first where it lacks one."""
    found = models.stored_forecasts(levels(spark, sf_dir), f"{shared_folder(spark)}/fundloom/{spark.sparkContext.applicationId}/registry", "ridge")
    return rounded(found.drop("attributions", "importance"))


def forest_explanations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tree Shapley values of each series' latest 21-day forecast by a random forest, and their mean sizes over recent rows."""
    rows = levels(spark, sf_dir)
    found = models.forecast(models.train(rows, models.fingerprints(rows, "random_forest", (21,)), "random_forest"), rows)
    long = found.select("series_id", "horizon", "base", "predicted", F.posexplode(F.arrays_zip("attributions", "importance")).alias("i", "p"))
    name = F.get(F.array(*(F.lit(c) for c in learning.FEATURES)), F.col("i"))
    return rounded(long.select("series_id", "horizon", "base", "predicted", name.alias("feature"), F.col("p.attributions").alias("attribution"), F.col("p.importance").alias("mean_size")), 8)


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(events.windowed_counts(table(spark, sf_dir, "events")).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm")), 2)


def rate_limit_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.rate_limit(table(spark, sf_dir, "events"), 86_400, 2)


def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = events.sessions(table(spark, sf_dir, "events"))
    return found.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("last_seen").alias("last_us"), "n")


def session_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions are issued by sign-ups for two days; every other event bears its user's latest one. Customers in debt are inactive."""
    all_ = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    issue = F.col("event_type") == "signup"
    latest = F.last(F.when(issue, F.col("event_id")), ignorenulls=True).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    requests = all_.withColumn("session_id", latest).where(~issue)
    issued = all_.where(issue).select(F.col("event_id").alias("session_id"), "user_id", F.col("ts").alias("issued_at"), (F.col("ts") + F.expr("INTERVAL 2 DAYS")).alias("expires_at"))
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), (F.col("c_acctbal") >= 0).alias("is_active"))
    return events.session_checks(requests, issued, users)


def queries() -> dict[str, Query]:
    return named(ml_features, ml_target, purged_split, split_sizes, benchmark_features, historical_mean_baseline, regression_metrics, ridge_fit, forecast_rf, forecast_latest, forecast_attributions, anomaly_drivers, anomaly_features, robust_zscores, isolation_forest, move_readings, anomaly_report, model_fingerprint, stored_forecasts, forest_explanations, event_windows, rate_limit_window, user_sessions, session_validity)


_W = "PARTITION BY series_id ORDER BY obs_date"
_RAW = f"""x0 AS (SELECT *, ln(level) AS x FROM nav), l0 AS (SELECT *, {", ".join(f"x - lag(x, {k}) OVER ({_W}) AS log_{k}" for k in (1, 5, 21, 63))} FROM x0)"""
#: Rows with all features: 252 levels make the drawdown, and 63 returns the longest volatility, which no row may have as zero.
_SPLIT = f"""{_RAW},
fl AS (SELECT *, row_number() OVER ({_W}) AS k, ln(lead(level, @H@) OVER ({_W})) - x AS target, stddev_samp(log_1) OVER ({_W} ROWS 62 PRECEDING) AS v63 FROM l0),
ok AS (SELECT * FROM fl WHERE k >= 252 AND v63 > 0 AND target IS NOT NULL),
sp AS (SELECT *, CASE WHEN i <= a THEN 'train' WHEN i <= a + @H@ THEN 'purged' WHEN i <= b THEN 'validation' WHEN i <= b + @H@ THEN 'purged' ELSE 'test' END AS part
       FROM (SELECT *, row_number() OVER ({_W}) AS i, floor(0.7::DOUBLE * count(*) OVER (PARTITION BY series_id)) AS a, floor((0.7::DOUBLE + 0.15::DOUBLE) * count(*) OVER (PARTITION BY series_id)) AS b FROM ok)),
mb AS (SELECT series_id, obs_date, target AS actual, predicted FROM sp JOIN (SELECT series_id, avg(target) AS predicted FROM sp WHERE part = 'train' GROUP BY series_id) USING (series_id) WHERE part = 'test')"""
_ANOMALY = """bn AS (SELECT r.*, last_value(b.value IGNORE NULLS) OVER (PARTITION BY r.series_id ORDER BY r.obs_date ROWS UNBOUNDED PRECEDING) AS bv FROM ret r LEFT JOIN bench b USING (obs_date)),
br AS (SELECT *, bv / lag(bv) OVER (PARTITION BY series_id ORDER BY obs_date) - 1 AS benchmark_return FROM bn)"""


def oracle_sql() -> dict[str, str]:
    base = f"WITH {LEVELS_SQL}"
    split = _SPLIT.replace("@H@", "5")
    full = lambda v, n, c: f"CASE WHEN count({c}) OVER ({_W} ROWS {n - 1} PRECEDING) = {n} THEN {v} OVER ({_W} ROWS {n - 1} PRECEDING) END"
    return {
        "ml_features": f"""{base}, x AS (SELECT *, ln(level) AS x FROM nav), l AS (SELECT *, {", ".join(f"x - lag(x, {k}) OVER ({_W}) AS log_{k}" for k in (1, 5, 21, 63))} FROM x),
            v AS (SELECT *, {full("stddev_samp(log_1)", 21, "log_1")} * sqrt(252) AS vol_21, {full("stddev_samp(log_1)", 63, "log_1")} * sqrt(252) AS vol_63, level / ({full("max(level)", 252, "level")}) - 1 AS drawdown_252 FROM l)
            SELECT series_id, obs_date, {", ".join(f"round({c}, 6) AS {c}" for c in learning.FEATURES if c != "vol_ratio")}, round(vol_21 / nullif(vol_63, 0), 6) AS vol_ratio FROM v""",
        "ml_target": f"{base} SELECT series_id, obs_date, round(ln(lead(level, 21) OVER ({_W})) - ln(level), 6) AS target FROM nav",
        "purged_split": f"{base}, {_SPLIT.replace('@H@', '21')} SELECT series_id, obs_date, part FROM sp",
        "split_sizes": f"""{base}, {_SPLIT.replace('@H@', '63')}, c AS (SELECT series_id, count(*) FILTER (part = 'train') AS n_train, count(*) FILTER (part = 'validation') AS n_validation, count(*) FILTER (part = 'test') AS n_test FROM sp GROUP BY series_id)
            SELECT *, n_train >= 200 AND n_validation >= 40 AND n_test >= 40 AS enough FROM c""",
        "benchmark_features": f"""{base}, {_RAW}, m AS (SELECT l.*, last_value(CASE WHEN dayofyear(b.obs_date) % 10 > 0 THEN b.value END IGNORE NULLS) OVER (PARTITION BY l.series_id ORDER BY l.obs_date ROWS UNBOUNDED PRECEDING) AS v FROM l0 l LEFT JOIN bench b USING (obs_date)),
            g AS (SELECT *, ln(v) - lag(ln(v), 5) OVER ({_W}) AS b5, ln(v) - lag(ln(v), 21) OVER ({_W}) AS b21 FROM m)
            SELECT series_id, obs_date, round(b5, 6) AS bench_5, round(b21, 6) AS bench_21, round(log_21 - b21, 6) AS relative_21 FROM g""",
        "anomaly_drivers": f"""{base}, {_ANOMALY}, f AS (SELECT *, CASE WHEN count(ret) OVER ({_W} ROWS BETWEEN 63 PRECEDING AND 1 PRECEDING) = 63 THEN stddev_samp(ret) OVER ({_W} ROWS BETWEEN 63 PRECEDING AND 1 PRECEDING) END AS b, {full("stddev_samp(ret)", 21, "ret")} AS s, {full("stddev_samp(ret)", 126, "ret")} AS l FROM br),
            a AS (SELECT series_id, obs_date, ret, ret / nullif(b, 0) AS shock, s / nullif(l, 0) AS vol_ratio, ret - benchmark_return AS excess_return FROM f),
            u AS (UNPIVOT (SELECT * FROM a WHERE shock IS NOT NULL AND vol_ratio IS NOT NULL AND excess_return IS NOT NULL) ON ret, shock, vol_ratio, excess_return INTO NAME feature VALUE v),
            m AS (SELECT series_id, feature, median(v) AS mid FROM u GROUP BY ALL), d AS (SELECT series_id, feature, median(abs(v - mid)) AS mad FROM u JOIN m USING (series_id, feature) GROUP BY ALL),
            z AS (SELECT series_id, obs_date, feature, (v - mid) / nullif(1.4826::DOUBLE * mad, 0) AS z FROM u JOIN m USING (series_id, feature) JOIN d USING (series_id, feature)),
            k AS (SELECT *, row_number() OVER (PARTITION BY series_id, obs_date ORDER BY abs(z) DESC, feature) AS p FROM z WHERE z IS NOT NULL)
            SELECT series_id, obs_date, string_agg(feature, ',' ORDER BY p) FILTER (p <= 3) AS drivers, round(max(z) FILTER (p = 1), 6) AS first_z FROM k GROUP BY series_id, obs_date HAVING max(abs(z)) FILTER (feature = 'ret') > 4""",
        "historical_mean_baseline": f"{base}, {split} SELECT series_id, obs_date, round(actual, 6) AS actual, round(predicted, 6) AS predicted FROM mb",
        "regression_metrics": f"{base}, {split} SELECT series_id, count(*) AS n, round(avg(abs(actual - predicted)), 6) AS mae, round(sqrt(avg((actual - predicted) * (actual - predicted))), 6) AS rmse, round(avg(CAST(sign(actual) = sign(predicted) AS DOUBLE)) FILTER (actual <> 0 AND predicted <> 0), 6) AS directional_accuracy FROM mb GROUP BY series_id",
        "anomaly_features": f"""{base}, {_ANOMALY}, f AS (SELECT *, CASE WHEN count(ret) OVER ({_W} ROWS BETWEEN 63 PRECEDING AND 1 PRECEDING) = 63 THEN stddev_samp(ret) OVER ({_W} ROWS BETWEEN 63 PRECEDING AND 1 PRECEDING) END AS b,
            {full("stddev_samp(ret)", 21, "ret")} AS s, {full("stddev_samp(ret)", 126, "ret")} AS l FROM br)
            SELECT series_id, obs_date, round(ret, 6) AS ret, round(ret / nullif(b, 0), 6) AS shock, round(s / nullif(l, 0), 6) AS vol_ratio, round(benchmark_return, 6) AS benchmark_return, round(ret - benchmark_return, 6) AS excess_return FROM f""",
        "move_readings": f"""{base}, {_ANOMALY}, f AS (SELECT series_id, obs_date, round(ret, 6) AS ret, round(benchmark_return, 6) AS b FROM br)
            SELECT series_id, obs_date, ret, CASE WHEN b IS NULL THEN 'Unusual daily move of x for this fund.' WHEN abs(b) >= 0.02 AND sign(b) = sign(ret) AND abs(ret - b) < abs(ret) * 0.5 THEN 'Market-wide move: fund x while the benchmark moved x.'
                   ELSE 'Fund-specific move: fund x versus benchmark x on the same day.' END AS kind FROM f""",
        "robust_zscores": f"""{base}, m AS (SELECT series_id, median(ret) AS mid FROM ret GROUP BY series_id), d AS (SELECT series_id, median(abs(ret - mid)) AS mad FROM ret JOIN m USING (series_id) GROUP BY series_id)
            SELECT series_id, obs_date, round(ret, 6) AS ret, round((ret - mid) / nullif(1.4826::DOUBLE * mad, 0), 6) AS z FROM ret JOIN m USING (series_id) JOIN d USING (series_id)""",
        "model_fingerprint": f"{base} SELECT series_id, sha256('1|' || series_id || '|ridge|21|' || count(*) || '|' || min(obs_date) || '|' || max(obs_date) || '|' || printf('%.4f', arg_max(level, obs_date))) AS fingerprint FROM nav GROUP BY series_id",
        "event_windows": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL",
        "rate_limit_window": """WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) AS tm, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE ts IS NOT NULL),
            f(user_id, n, event_id, kept, hits, allowed, retry_us) AS (
              SELECT DISTINCT user_id, 0::BIGINT, NULL::BIGINT, []::BIGINT[], 0::BIGINT, false, 0::BIGINT FROM e
              UNION ALL
              SELECT user_id, n, event_id, CASE WHEN len(k) < 2 THEN list_append(k, tm) ELSE k END, len(k), len(k) < 2, CASE WHEN len(k) < 2 THEN 0 ELSE 86400000000 - (tm - k[1]) END
              FROM (SELECT e.user_id, e.n, e.event_id, e.tm, list_filter(f.kept, lambda x: e.tm - x < 86400000000) AS k FROM f JOIN e ON e.user_id IS NOT DISTINCT FROM f.user_id AND e.n = f.n + 1))
            SELECT event_id, user_id, hits, allowed, retry_us FROM f WHERE n > 0""",
        "session_validity": """WITH RECURSIVE a AS (SELECT *, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session_id FROM events),
            r AS (SELECT a.event_id, a.session_id, a.user_id, epoch_us(a.ts) AS tm, epoch_us(i.ts) AS issued, epoch_us(i.ts) + 172800000000 AS expires, coalesce(c_acctbal >= 0, false) AS active
                  FROM a LEFT JOIN events i ON i.event_id = a.session_id LEFT JOIN customer ON c_custkey = a.user_id WHERE a.event_type <> 'signup'),
            o AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY tm, event_id) AS n FROM r),
            f(session_id, n, event_id, ended, seen, valid, reason, refreshed) AS (
              SELECT DISTINCT session_id, 0::BIGINT, NULL::BIGINT, session_id IS NULL, issued, false, NULL::VARCHAR, false FROM o
              UNION ALL
              SELECT o.session_id, o.n, o.event_id, f.ended OR o.tm >= o.expires OR NOT o.active,
                CASE WHEN NOT f.ended AND o.tm < o.expires AND o.active AND o.tm - f.seen > 60000000 THEN o.tm ELSE f.seen END,
                NOT f.ended AND o.tm < o.expires AND o.active,
                CASE WHEN f.ended THEN 'unknown' WHEN o.tm >= o.expires THEN 'expired' WHEN NOT o.active THEN 'inactive' END,
                coalesce(NOT f.ended AND o.tm < o.expires AND o.active AND o.tm - f.seen > 60000000, false)
              FROM f JOIN o ON o.session_id IS NOT DISTINCT FROM f.session_id AND o.n = f.n + 1)
            SELECT event_id, session_id, coalesce(valid, false) AS valid, reason, refreshed FROM f WHERE n > 0""",
        "user_sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM events),
            s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
            SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS last_us, count(*) AS n FROM s GROUP BY user_id, k""",
    }
