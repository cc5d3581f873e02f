"""Forecasting features, purged evaluation, models and anomalies of level series."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fundloom.conventions import LEAST_FOR_ANOMALIES, require
from fundloom.operators.series import in_order, trailing

HORIZONS = (5, 21, 63)
FEATURES = ("log_1", "log_5", "log_21", "log_63", "vol_21", "vol_63", "vol_ratio", "drawdown_252")
BENCHMARK_FEATURES = ("bench_5", "bench_21", "relative_21")
#: Rows that the parts of a split need, at least, and shares of train and validation.
LEAST_TRAIN, LEAST_VALIDATION, LEAST_TEST = 200, 40, 40
SHARES = (0.7, 0.15)
#: Rows that stand for the usual values of the features in attributions.
BACKGROUND = 200


def _guarded(value: Column, n: int, column: str) -> Column:
    return F.when(F.count(column).over(trailing(n)) == n, value)


def features(levels: DataFrame) -> DataFrame:
    """Log returns over 1 to 63 rows, volatilities, their ratio and the drawdown from a year's peak; full windows only."""
    w = in_order()
    logs = levels.withColumn("x", F.log("level"))
    for k in (1, 5, 21, 63):
        logs = logs.withColumn(f"log_{k}", F.col("x") - F.lag("x", k).over(w))
    for n in (21, 63):
        logs = logs.withColumn(f"vol_{n}", _guarded(F.stddev_samp("log_1").over(trailing(n)) * 252**0.5, n, "log_1"))
    logs = logs.withColumn("vol_ratio", F.try_divide("vol_21", F.nullif("vol_63", F.lit(0.0))))
    peak = F.max("level").over(trailing(252))
    return logs.withColumn("drawdown_252", _guarded(F.col("level") / peak - 1, 252, "level")).select("series_id", "obs_date", "level", *FEATURES)


def with_benchmark(rows: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``bench``: the value of ``benchmark(obs_date, value)`` on each date of a series, or the last before it on such a date."""
    joined = rows.join(benchmark, "obs_date", "left")
    return joined.withColumn("bench", F.last("value", True).over(in_order().rowsBetween(Window.unboundedPreceding, 0))).drop("value")


def benchmark_features(levels: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``features`` with the benchmark's log returns over 5 and 21 rows, and the series' own over 21 less that."""
    w = in_order()
    seen = with_benchmark(levels.select("series_id", "obs_date"), benchmark).withColumn("b", F.log("bench"))
    steps = seen.select("series_id", "obs_date", *((F.col("b") - F.lag("b", k).over(w)).alias(f"bench_{k}") for k in (5, 21)))
    return features(levels).join(steps, ["series_id", "obs_date"]).withColumn("relative_21", F.col("log_21") - F.col("bench_21"))


def target(levels: DataFrame, horizon: int) -> DataFrame:
    """``target``: the log return over the next ``horizon`` rows, null at the end."""
    require(horizon in HORIZONS, f"the horizon is one of {HORIZONS}")
    return levels.withColumn("target", F.log("level").cast("double") * -1 + F.log(F.lead("level", horizon).over(in_order())))


def complete(rows: DataFrame, columns: tuple[str, ...] = FEATURES) -> DataFrame:
    """Rows with all features and a target: those that a split takes."""
    return rows.dropna(subset=[*columns, "target"])


def purged_split(rows: DataFrame, gap: int, shares: tuple[float, float] = SHARES) -> DataFrame:
    """``part``: train, validation and test by date, with the first ``gap`` rows after each cut purged.

    A target spans ``gap`` rows, so the last ones of a part would see prices
    of the next. Pass ``complete`` rows, as the shares are of what is given.
    """
    i = F.row_number().over(in_order())
    n = F.count("*").over(Window.partitionBy("series_id"))
    a, b = F.floor(shares[0] * n), F.floor((shares[0] + shares[1]) * n)
    part = F.when(i <= a, "train").when(i <= a + gap, "purged").when(i <= b, "validation").when(i <= b + gap, "purged").otherwise("test")
    return rows.withColumn("part", part)


def enough_history(split: DataFrame) -> DataFrame:
    """(series_id, n_train, n_validation, n_test, enough): whether the parts have the rows that a model needs."""
    counts = split.groupBy("series_id").agg(*(F.count_if(F.col("part") == p).alias(f"n_{p}") for p in ("train", "validation", "test")))
    return counts.withColumn("enough", (F.col("n_train") >= LEAST_TRAIN) & (F.col("n_validation") >= LEAST_VALIDATION) & (F.col("n_test") >= LEAST_TEST))


def regression_metrics(rows: DataFrame, by: str | tuple[str, ...] = "series_id", *more: Column) -> DataFrame:
    """MAE, RMSE and the share of equal signs, over committed rows, of (actual, predicted)."""
    e = F.col("actual") - F.col("predicted")
    committed = (F.col("predicted") != 0) & (F.col("actual") != 0)
    return rows.groupBy(*([by] if isinstance(by, str) else by)).agg(F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.when(committed, (F.signum("actual") == F.signum("predicted")).cast("double"))).alias("directional_accuracy"), *more)


def mean_baseline(split: DataFrame) -> DataFrame:
    """Test rows with the train mean of their series as the prediction."""
    mean = split.where("part = 'train' AND target IS NOT NULL").groupBy("series_id").agg(F.avg("target").alias("predicted"))
    return split.where("part = 'test' AND target IS NOT NULL").withColumnRenamed("target", "actual").join(mean, "series_id")


def _best_split(x: np.ndarray, w: np.ndarray, wy: np.ndarray, least: int) -> tuple[int, float] | None:
    """(feature, cut) of the greatest gain in squared error, or None; both sides keep ``least`` distinct rows at least."""
    m = len(x)
    order = np.argsort(x, axis=0, kind="stable")
    sorted_x = np.take_along_axis(x, order, axis=0)
    wl, sl = w[order].cumsum(axis=0)[:-1], wy[order].cumsum(axis=0)[:-1]
    gain = sl**2 / wl + (wy.sum() - sl) ** 2 / (w.sum() - wl)
    k = np.arange(1, m)[:, None]
    gain[(sorted_x[:-1] >= sorted_x[1:]) | (k < least) | (m - k < least)] = -np.inf
    best = int(np.argmax(gain))
    if not gain.flat[best] > wy.sum() ** 2 / w.sum():
        return None
    k, f = divmod(best, x.shape[1])
    cut = (sorted_x[k, f] + sorted_x[k + 1, f]) / 2
    return f, cut if cut < sorted_x[k + 1, f] else sorted_x[k, f]


def _tree(x: np.ndarray, y: np.ndarray, weight: np.ndarray, at: np.ndarray, depths: tuple[int, ...], least: int = 5) -> np.ndarray:
    """Predictions (depth, row of ``at``) of a regression tree cut off at each of ``depths``; leaves hold ``least`` distinct rows at least."""
    out, stack = np.zeros((len(depths), len(at))), [(np.flatnonzero(weight), np.arange(len(at)), 0)]
    while stack:
        own, rows, level = stack.pop()
        w = weight[own]
        wy = w * y[own]
        split = _best_split(x[own], w, wy, least) if level < max(depths) and len(own) >= 2 * least else None
        for d, depth in enumerate(depths):
            if level == depth or (level < depth and split is None):
                out[d, rows] = wy.sum() / w.sum()
        if split:
            f, cut = split
            stack.append((own[x[own, f] <= cut], rows[at[rows, f] <= cut], level + 1))
            stack.append((own[x[own, f] > cut], rows[at[rows, f] > cut], level + 1))
    return out


#: A forest's nodes, one after the other: tree, split feature (-1 in a leaf), cut, the nodes at or below and above it, mean target, weight of the rows.
NODES = "tree int, feature int, cut double, low int, high int, value double, cover double"


def bootstrap(n: int, tree: int, seed: int) -> np.ndarray:
    return np.bincount(np.random.default_rng([seed, tree]).integers(0, n, n), minlength=n).astype(float)


def forest_nodes(x: np.ndarray, y: np.ndarray, depth: int, trees: int = 200, seed: int = 42, least: int = 5) -> list[tuple]:
    """The nodes of a random forest as rows of ``NODES``; its predictions are those of ``forest_candidates``."""
    nodes: list[list] = []
    for t in range(trees):
        weight = bootstrap(len(x), t, seed)
        stack = [(np.flatnonzero(weight), 0, None)]
        while stack:
            own, level, above = stack.pop()
            w = weight[own]
            wy = w * y[own]
            split = _best_split(x[own], w, wy, least) if level < depth and len(own) >= 2 * least else None
            if above:
                nodes[above[0]][above[1]] = len(nodes)
            k = len(nodes)
            nodes.append([t, split[0] if split else -1, split[1] if split else 0.0, -1, -1, wy.sum() / w.sum(), w.sum()])
            if split:
                below = x[own, split[0]] <= split[1]
                stack += [(own[~below], level + 1, (k, 4)), (own[below], level + 1, (k, 3))]
    return [(int(a), int(b), float(c), int(d), int(e), float(f), float(g)) for a, b, c, d, e, f, g in nodes]


def forest_predictions(nodes: list[tuple], at: np.ndarray) -> np.ndarray:
    """What a forest of ``NODES`` predicts for rows of features."""
    tree, feature, cut, low, high, value, _ = (np.array(c) for c in zip(*nodes, strict=True))
    roots = np.flatnonzero(np.diff(tree, prepend=-1))
    total = np.zeros(len(at))
    for root in roots:
        now = np.full(len(at), root)
        while (inner := feature[now] >= 0).any():
            rows = np.flatnonzero(inner)
            k = now[rows]
            now[rows] = np.where(at[rows, feature[k]] <= cut[k], low[k], high[k])
        total += value[now]
    return total / len(roots)


def forest_attributions(nodes: list[tuple], at: np.ndarray) -> tuple[np.ndarray, float]:
    """(Shapley values of each row and feature, expected value) of a forest, by the weights that its training rows left on the paths.

    A leaf's share for a feature of its path is its value times (o - z) times
    the weighted sum over subsets of the others, where o tells whether the row
    takes the feature's turns and z is the share of rows that do. The sums over
    subsets of one size are the coefficients of the product of (z + o t), which
    is built once for each leaf and divided by the feature's own factor: a
    polynomial in the depth instead of all subsets. Leaves of equally many
    features are taken together, for all rows at once.
    """
    n_features, out, expected = at.shape[1], np.zeros(at.shape), 0.0
    trees: dict[int, list[int]] = {}
    for k, node in enumerate(nodes):
        trees.setdefault(node[0], []).append(k)
    for members in trees.values():
        leaves: dict[int, list[tuple]] = {}
        stack = [(members[0], {})]
        while stack:
            k, path = stack.pop()
            _, f, cut, low, high, value, cover = nodes[k]
            if f < 0:
                leaves.setdefault(len(path), []).append((path, value))
                expected += value * math.prod(z for z, _, _ in path.values())
                continue
            z, least, most = path.get(f, (1.0, -math.inf, math.inf))
            stack.append((low, path | {f: (z * nodes[low][6] / cover, least, min(most, cut))}))
            stack.append((high, path | {f: (z * nodes[high][6] / cover, max(least, cut), most)}))
        for d, group in leaves.items():
            if not d:
                continue
            features = np.array([list(p) for p, _ in group])
            z, least, most = (np.array([[x[c] for x in p.values()] for p, _ in group]) for c in range(3))
            x = at[:, features]
            o = ((x > least) & (x <= most)).astype(float)
            value = np.array([v for _, v in group])
            # Without one factor at a time; d is at most the depth.
            for j in range(d):
                poly = np.zeros((*o.shape[:2], d))
                poly[..., 0] = 1
                for n, i in enumerate([i for i in range(d) if i != j]):
                    grown = poly * z[None, :, i, None]
                    grown[..., 1 : n + 2] += poly[..., : n + 1] * o[:, :, i, None]
                    poly = grown
                weights = np.array([math.factorial(k) * math.factorial(d - 1 - k) / math.factorial(d) for k in range(d)])
                part = value * (o[..., j] - z[:, j]) * (poly @ weights)
                for f in range(n_features):
                    own = features[:, j] == f
                    if own.any():
                        out[:, f] += part[:, own].sum(axis=1)
    return out / len(trees), expected / len(trees)


def forest_candidates(x: np.ndarray, y: np.ndarray, at: np.ndarray, depths: tuple[float, ...], trees: int = 200, seed: int = 42) -> np.ndarray:
    """Predictions (depth, row of ``at``) of random forests of all features; forests of unlike depth share their bootstrap samples."""
    total = np.zeros((len(depths), len(at)))
    for t in range(trees):
        total += _tree(x, y, bootstrap(len(x), t, seed), at, tuple(int(d) for d in depths))
    return total / trees


def ridge_fit(x: np.ndarray, y: np.ndarray, alpha: float) -> tuple[np.ndarray, float]:
    """(coefficients of the features as they are, constant) of a ridge regression on standardised features."""
    mean, sd = x.mean(axis=0), x.std(axis=0)
    sd = np.where(sd > 0, sd, 1)
    z = (x - mean) / sd
    slope = np.linalg.solve(z.T @ z + alpha * np.eye(z.shape[1]), z.T @ (y - y.mean())) / sd
    return slope, float(y.mean() - mean @ slope)


def ridge_candidates(x: np.ndarray, y: np.ndarray, at: np.ndarray, alphas: tuple[float, ...]) -> np.ndarray:
    """Predictions (alpha, row of ``at``) of ridge regressions on standardised features."""
    fits = [ridge_fit(x, y, a) for a in alphas]
    return np.array([constant + at @ slope for slope, constant in fits])


def ridge_attributions(x: np.ndarray, y: np.ndarray, alpha: float, background: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Shapley values of a linear model for each row of ``at``: coefficient times the distance from the background's mean."""
    slope, _ = ridge_fit(x, y, alpha)
    return (at - background.mean(axis=0)) * slope


_FORECAST = "series_id string, horizon int, obs_date date, part string, level double, actual double, predicted double, low double, high double, baseline double, chosen double, validation_mae double, attributions array<double>"


def selected_forecasts(levels: DataFrame, candidates, parameters: tuple[float, ...], horizons: tuple[int, ...] = HORIZONS, benchmark: DataFrame | None = None, attribute=None) -> DataFrame:
    """Test rows of each series and horizon, and the latest row: level, actual, predicted, low, high, baseline, chosen, validation_mae.

    Each series has its own model for each horizon. The candidate with the
    least validation MAE (the first of ties) is fitted again on all rows up to
    the end of validation. ``low`` and ``high`` are the 80 % band: quantiles of
    the validation residuals over the volatility expected then, times that of
    the row. ``baseline`` is the mean target of the rows fitted on. The latest
    row (part "latest") has no actual; with ``attribute`` it has each feature's
    part in the forecast. A series with under 200 train, 40 validation or 40
    test rows has too little history and gives no rows.
    """
    columns = FEATURES + (BENCHMARK_FEATURES if benchmark is not None else ())
    names = [c.split()[0] for c in _FORECAST.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("obs_date").reset_index(drop=True)
        train, val, test, last = (np.flatnonzero(pdf["part"] == p) for p in ("train", "validation", "test", "latest"))
        if len(train) < LEAST_TRAIN or len(val) < LEAST_VALIDATION or len(test) < LEAST_TEST:
            return pd.DataFrame({c: [] for c in names})
        x, y = pdf[list(columns)].to_numpy(float), pdf["target"].to_numpy(float)
        scale = np.maximum(pdf["vol_63"].to_numpy(float), 1e-4) * math.sqrt(int(pdf["horizon"][0]) / 252)
        tried = candidates(x[train], y[train], x[val], parameters)
        mae = np.abs(tried - y[val]).mean(axis=1)
        best = int(np.argmin(mae))
        low, high = np.quantile((y[val] - tried[best]) / scale[val], [0.1, 0.9])
        fit = slice(0, val[-1] + 1)
        at = np.concatenate([test, last])
        predicted = candidates(x[fit], y[fit], x[at], (parameters[best],))[0]
        out = pdf.loc[at, ["series_id", "horizon", "obs_date", "part", "level"]]
        out = out.assign(actual=y[at], predicted=predicted, low=predicted + low * scale[at], high=predicted + high * scale[at], baseline=float(y[fit].mean()), chosen=float(parameters[best]), validation_mae=float(mae[best]))
        labelled = x[: test[-1] + 1][-BACKGROUND:]
        parts = attribute(x[fit], y[fit], parameters[best], labelled, x[last]) if attribute else np.zeros((len(last), 0))
        out["attributions"] = [None] * len(test) + [list(map(float, r)) if attribute else None for r in parts]
        return out[names]

    rows = benchmark_features(levels, benchmark) if benchmark is not None else features(levels)
    newest = F.row_number().over(Window.partitionBy("series_id").orderBy(F.desc("obs_date")))
    latest = rows.dropna(subset=[*columns]).withColumn("k", newest).where("k = 1").drop("k").withColumn("target", F.lit(None).cast("double")).withColumn("part", F.lit("latest"))
    split = None
    for h in horizons:
        one = purged_split(complete(target(rows, h), columns), h).unionByName(latest).withColumn("horizon", F.lit(h))
        split = one if split is None else split.unionByName(one)
    return split.groupBy("series_id", "horizon").applyInPandas(run, _FORECAST)


def ridge_forecasts(levels: DataFrame, benchmark: DataFrame | None = None) -> DataFrame:
    return selected_forecasts(levels, ridge_candidates, (0.1, 1.0, 10.0, 100.0), benchmark=benchmark, attribute=ridge_attributions)


def forest_forecasts(levels: DataFrame, benchmark: DataFrame | None = None) -> DataFrame:
    return selected_forecasts(levels, forest_candidates, (3.0, 5.0, 8.0), benchmark=benchmark)


def latest_forecasts(rows: DataFrame) -> DataFrame:
    """What the latest row of each series and horizon says: returns and levels with their 80 % band."""
    back = lambda c: F.exp(F.col(c)) - 1
    at = lambda c: F.col("level") * F.exp(F.col(c))
    return rows.where("part = 'latest'").select("series_id", "horizon", F.col("obs_date").alias("as_of"), "level", F.col("predicted").alias("predicted_log_return"), back("predicted").alias("predicted_return"), back("low").alias("lower_return"), back("high").alias("upper_return"), at("predicted").alias("predicted_level"), at("low").alias("lower_level"), at("high").alias("upper_level"))


def attributions(rows: DataFrame, columns: tuple[str, ...] = FEATURES) -> DataFrame:
    """(series_id, horizon, feature, attribution, place) of the latest forecasts, the greatest in size first."""
    long = rows.where("part = 'latest' AND attributions IS NOT NULL").select("series_id", "horizon", F.posexplode("attributions").alias("i", "attribution"))
    named = long.withColumn("feature", F.get(F.array(*(F.lit(c) for c in columns)), F.col("i")))
    place = F.row_number().over(Window.partitionBy("series_id", "horizon").orderBy(F.desc(F.abs("attribution")), "i"))
    return named.select("series_id", "horizon", "feature", "attribution", place.alias("place"))


def forecast_metrics(rows: DataFrame) -> DataFrame:
    """Per series and horizon, over test rows: the metrics, the parameter chosen, the coverage of the band, and the skill.

    ``skill`` is one less the MAE over that of the historical mean;
    ``zero_mae`` is that of no change.
    """
    test = rows.where("part = 'test'")
    chosen = (F.first(c).alias(c) for c in ("chosen", "validation_mae"))
    base = F.avg(F.abs(F.col("actual") - F.col("baseline")))
    out = regression_metrics(test, ("series_id", "horizon"), *chosen, coverage(F.col("low"), F.col("high")), base.alias("baseline_mae"), F.avg(F.abs("actual")).alias("zero_mae"))
    return out.withColumn("skill", 1 - F.try_divide("mae", "baseline_mae")).withColumn("beats_baseline", F.coalesce(F.col("skill") > 0, F.lit(False)))


def coverage(low: Column, high: Column) -> Column:
    """The share of actual values from ``low`` to ``high``, as an aggregate."""
    return F.avg(F.col("actual").between(low, high).cast("double")).alias("coverage")


def robust_scores(rows: DataFrame, column: str, by: tuple[str, ...] = ("series_id",)) -> DataFrame:
    """``z``: distance from the median in units of 1.4826 median absolute deviations; null where these are 0."""
    middle = rows.where(F.col(column).isNotNull()).groupBy(*by).agg(F.median(column).alias("mid"))
    centred = rows.join(middle, list(by))
    spread = centred.groupBy(*by).agg(F.median(F.abs(F.col(column) - F.col("mid"))).alias("mad"))
    return centred.join(spread, list(by)).withColumn("z", F.try_divide(F.col(column) - F.col("mid"), F.nullif(1.4826 * F.col("mad"), F.lit(0.0)))).drop("mid", "mad")


def anomaly_features(returns: DataFrame, benchmark: DataFrame | None = None) -> DataFrame:
    """The return, the return over the volatility of the 63 rows before, and the ratio of 21- to 126-row volatility.

    With a benchmark also its return between the series' dates and the return less that.
    """
    before = F.when(F.count("ret").over(trailing(63, 1)) == 63, F.stddev_samp("ret").over(trailing(63, 1)))
    short, long = (_guarded(F.stddev_samp("ret").over(trailing(n)), n, "ret") for n in (21, 126))
    columns = ["series_id", "obs_date", "ret", F.try_divide("ret", F.nullif(before, F.lit(0.0))).alias("shock"), F.try_divide(short, F.nullif(long, F.lit(0.0))).alias("vol_ratio")]
    if benchmark is None:
        return returns.select(*columns)
    seen = with_benchmark(returns, benchmark)
    own = seen.withColumn("benchmark_return", F.try_divide("bench", F.lag("bench").over(in_order())) - 1)
    return own.select(*columns, "benchmark_return", (F.col("ret") - F.col("benchmark_return")).alias("excess_return"))


def move_reading(ret: Column, bench: Column) -> Column:
    """A day's move in words: market-wide where the benchmark moved by 2 % or more to the same side and explains over half of it."""
    both = (F.abs(bench) >= 0.02) & (F.signum(bench) == F.signum(ret)) & (F.abs(ret - bench) < F.abs(ret) * 0.5)
    own, other = (F.format_string("%+.2f%%", x * 100) for x in (ret, bench))
    alone = F.concat(F.lit("Unusual daily move of "), own, F.lit(" for this fund."))
    wide = F.concat(F.lit("Market-wide move: fund "), own, F.lit(" while the benchmark moved "), other, F.lit("."))
    single = F.concat(F.lit("Fund-specific move: fund "), own, F.lit(" versus benchmark "), other, F.lit(" on the same day."))
    return F.when(bench.isNull(), alone).when(both, wide).otherwise(single)


def drivers(rows: DataFrame, columns: tuple[str, ...], most: int = 3) -> DataFrame:
    """(series_id, obs_date, drivers): the columns whose robust distance from a series' median is greatest, first the greatest."""
    whole = rows.dropna(subset=[*columns])
    long = whole.select("series_id", "obs_date", F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).alias("value")) for c in columns))).alias("x")).select("series_id", "obs_date", "x.*")
    scored = robust_scores(long, "value", ("series_id", "feature")).where("z IS NOT NULL")
    far = F.array_sort(F.collect_list(F.struct((-F.abs("z")).alias("far"), "feature", "z")))
    listed = scored.groupBy("series_id", "obs_date").agg(F.slice(far, 1, most).alias("d"))
    return listed.select("series_id", "obs_date", F.transform("d", lambda p: F.struct(p["feature"].alias("feature"), p["z"].alias("z"))).alias("drivers"))


def _path_length(n: float) -> float:
    return 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else float(n == 2)


def isolation_scores(x: np.ndarray, trees: int, seed: int, sample: int = 256) -> np.ndarray:
    """Scores 2^(-mean depth / expected depth) of an isolation forest over the rows of x."""
    rng = np.random.default_rng(seed)
    size = min(sample, len(x))
    limit, depth = math.ceil(math.log2(max(2, size))), np.zeros(len(x))
    for _ in range(trees):
        stack = [(rng.choice(len(x), size, replace=False), np.arange(len(x)), 0)]
        while stack:
            own, rows, level = stack.pop()
            spans = np.ptp(x[own], axis=0) if len(own) else np.zeros(x.shape[1])
            if level >= limit or len(own) <= 1 or not spans.any():
                depth[rows] += level + _path_length(len(own))
                continue
            f = rng.choice(np.flatnonzero(spans))
            cut = rng.uniform(x[own, f].min(), x[own, f].max())
            stack.append((own[x[own, f] < cut], rows[x[rows, f] < cut], level + 1))
            stack.append((own[x[own, f] >= cut], rows[x[rows, f] >= cut], level + 1))
    return 2 ** (-depth / trees / max(_path_length(size), 1e-9))


def isolation_forest(rows: DataFrame, columns: tuple[str, ...], contamination: float = 0.01, trees: int = 300, seed: int = 42) -> DataFrame:
    """(series_id, obs_date, score, anomaly) for series with at least 200 full rows; one series to a call."""
    require(0.001 <= contamination <= 0.1, "contamination lies between 0.001 and 0.1")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("obs_date")
        if len(pdf) < LEAST_FOR_ANOMALIES:
            return pd.DataFrame({"series_id": [], "obs_date": [], "score": [], "anomaly": []})
        score = isolation_scores(pdf[list(columns)].to_numpy(float), trees, seed)
        return pd.DataFrame({"series_id": pdf["series_id"], "obs_date": pdf["obs_date"], "score": score, "anomaly": score > np.quantile(score, 1 - contamination)})

    return rows.dropna(subset=[*columns]).select("series_id", "obs_date", *columns).groupBy("series_id").applyInPandas(run, "series_id string, obs_date date, score double, anomaly boolean")


def fingerprint(levels: DataFrame, model: str, horizon: int, version: str = "1") -> DataFrame:
    """(series_id, fingerprint): a hash of the data and settings from which a stored model is known again."""
    ends = levels.groupBy("series_id").agg(F.count("*").alias("n"), F.min("obs_date").alias("a"), F.max("obs_date").alias("b"), F.max_by("level", "obs_date").alias("last"))
    text = F.concat_ws("|", F.lit(version), "series_id", F.lit(model), F.lit(str(horizon)), F.col("n").cast("string"), F.col("a").cast("string"), F.col("b").cast("string"), F.format_string("%.4f", "last"))
    return ends.select("series_id", F.sha2(text, 256).alias("fingerprint"))


def anomaly_report(rows: DataFrame, flagged: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """(series_id, place, obs_date, score, ret, benchmark_return, drivers, reading) of the flagged days, those of the highest scores first."""
    marked = flagged.where("anomaly").select("series_id", "obs_date", "score")
    said = rows.select("series_id", "obs_date", "ret", "benchmark_return", move_reading(F.col("ret"), F.col("benchmark_return")).alias("reading"))
    place = F.row_number().over(Window.partitionBy("series_id").orderBy(F.desc("score"), "obs_date"))
    joined = marked.join(said, ["series_id", "obs_date"]).join(drivers(rows, columns), ["series_id", "obs_date"], "left").withColumn("place", place)
    return joined.select("series_id", "place", "obs_date", "score", "ret", "benchmark_return", "drivers", "reading")
