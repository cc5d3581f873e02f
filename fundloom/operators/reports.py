"""Whole reports of funds, portfolios and comparisons: a row for each, with its period, age, assumptions and metrics.

``benchmarks(series_id, benchmark_id)`` names the benchmark of a series, and
``values(benchmark_id, obs_date, value)`` holds the levels of all benchmarks.
A series without a benchmark has null for what needs one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fundloom.conventions import PERIODS, STALE_AFTER_DAYS, Conventions, require
from fundloom.operators import metrics, series
from fundloom.storage import written

DEFAULT = Conventions()


def _against(levels: DataFrame, benchmarks: DataFrame, values: DataFrame) -> DataFrame:
    """(series_id, obs_date, ret, bret) on dates of both sides, from benchmark levels of the series' own period only.

    A benchmark's return counts where the level that it starts from isn't
    older than the series' first one, which needs no join on ranges of dates.
    """
    w = Window.partitionBy("benchmark_id").orderBy("obs_date")
    returns = values.select("benchmark_id", "obs_date", F.lag("obs_date").over(w).alias("since"), (F.col("value") / F.lag("value").over(w) - 1).alias("bret")).where("bret IS NOT NULL")
    first = levels.groupBy("series_id").agg(F.min("obs_date").alias("first")).join(benchmarks, "series_id")
    joined = series.simple_returns(levels).join(first, "series_id").join(returns, ["benchmark_id", "obs_date"])
    return joined.where("since >= first").select("series_id", "obs_date", "ret", "bret")


def _missing() -> Column:
    """The names of the metrics that a row couldn't be given, in the order of the report."""
    return F.concat_ws(",", *(F.when(F.col(m).isNull(), m) for m in metrics.UNITS))


def _measured(levels: DataFrame, benchmarks: DataFrame, values: DataFrame, conventions: Conventions) -> DataFrame:
    """All metrics of the given levels, a row for each series."""
    found = metrics.wide_statistics(levels, _against(levels, benchmarks, values), conventions)
    return found.withColumn("unavailable", _missing())


def fund_reports(levels: DataFrame, benchmarks: DataFrame, values: DataFrame, today: Column, label: str = "3y", conventions: Conventions = DEFAULT) -> DataFrame:
    """A row for each series with two levels in the period that ends at its latest date.

    ``covered`` tells whether the history reaches back over the whole period;
    where it doesn't, the metrics are of what there is. ``unavailable`` lists
    the metrics that are null.
    """
    inside = series.in_period(levels, label)
    span = inside.groupBy("series_id").agg(F.min("obs_date").alias("period_start"), F.max("obs_date").alias("period_end"), F.count("*").alias("n")).where("n >= 2").drop("n")
    covered = series.resolve_period(levels, label).select("series_id", "covered")
    out = span.join(covered, "series_id").join(series.freshness(levels, today).select("series_id", "age_days", "stale"), "series_id").join(benchmarks, "series_id", "left")
    out = out.select("series_id", F.lit(label).alias("period"), "period_start", "period_end", "covered", "age_days", "stale", "benchmark_id", F.lit(conventions.risk_free).alias("risk_free_rate"), F.lit(conventions.confidence).alias("confidence"))
    return out.join(_measured(inside, benchmarks, values, conventions), "series_id")


def comparison(levels: DataFrame, benchmarks: DataFrame, values: DataFrame, ids: tuple[str, ...], today: Column, label: str = "3y", conventions: Conventions = DEFAULT) -> DataFrame:
    """``fund_reports`` of two to five series, each over its own history, and their levels over the dates that all have.

    ``common_start``, ``common_end``, ``dates_aligned`` (of all dates, not only the
    period's), ``dates_dropped`` and ``common_covered`` are those of the shared chart;
    ``rebased_end`` is the last shared level in hundredths of the first one.
    """
    require(2 <= len(set(ids)) <= 5, "two to five distinct series can be compared")
    own = levels.where(F.col("series_id").isin(*ids))
    shared = series.align_levels(own)
    window = series.in_period(shared, label)
    ends = window.groupBy("series_id").agg(F.min("obs_date").alias("common_start"), F.max("obs_date").alias("common_end"), (F.max_by("level", "obs_date") / F.min_by("level", "obs_date") * 100).alias("rebased_end"))
    covered = series.resolve_period(shared, label).select("series_id", F.col("covered").alias("common_covered"))
    counts = series.alignment_report(own).select(F.struct("dates_aligned", "dates_dropped")).scalar()
    common = ends.join(covered, "series_id").withColumn("c", counts).select("series_id", "common_start", "common_end", "common_covered", "rebased_end", "c.*")
    return fund_reports(own, benchmarks, values, today, label, conventions).join(common, "series_id", "left")


def _frame(levels: DataFrame, portfolio: DataFrame, label: str) -> DataFrame:
    """(portfolio_id, series_id, obs_date, level, weight, dates): a portfolio's levels of the dates that all its assets have, in the period.

    Weights are over their sum. ``dates`` is a struct of how many dates were aligned and dropped before the period was cut.
    """
    total = Window.partitionBy("portfolio_id")
    weights = portfolio.select("portfolio_id", "series_id", F.try_divide("weight", F.sum("weight").over(total)).alias("weight"), F.count("*").over(total).alias("assets"))
    held = levels.join(weights, "series_id")
    per_date = held.groupBy("portfolio_id", "obs_date", "assets").agg(F.count("*").alias("n"))
    full = F.col("n") == F.col("assets")
    ends = per_date.groupBy("portfolio_id").agg(F.min(F.when(full, F.col("obs_date"))).alias("first"), F.max(F.when(full, F.col("obs_date"))).alias("last"), F.struct(F.count_if(full).alias("aligned"), F.count_if(~full).alias("dropped")).alias("dates"))
    months = PERIODS[label]
    start = F.col("first") if months is None else F.greatest(F.add_months("last", -months), "first")
    dates = per_date.where(full).join(ends, "portfolio_id").where(F.col("obs_date") >= start).select("portfolio_id", "obs_date", "dates")
    return held.join(dates, ["portfolio_id", "obs_date"]).select("portfolio_id", "series_id", "obs_date", "level", "weight", "dates")


def _asset_returns(frame: DataFrame) -> DataFrame:
    """The frame's returns with ``of``, the return at the portfolio's first weights on the same date."""
    w = Window.partitionBy("portfolio_id", "series_id").orderBy("obs_date")
    returns = frame.withColumn("ret", F.col("level") / F.lag("level").over(w) - 1).where("ret IS NOT NULL")
    whole = returns.groupBy("portfolio_id", "obs_date").agg(F.sum(F.col("weight") * F.col("ret")).alias("of"))
    return returns.join(whole, ["portfolio_id", "obs_date"])


def portfolio_positions(levels: DataFrame, portfolio: DataFrame, label: str = "3y", initial: float = 100_000.0) -> DataFrame:
    """(portfolio_id, series_id, initial_weight, current_weight, current_value, risk_share) of assets bought at the period's start and held.

    An asset's share of the variance is its weight times its covariance with
    the whole, so assets needn't meet in pairs.
    """
    return _positions(_frame(levels, portfolio, label), initial)


def _positions(frame: DataFrame, initial: float) -> DataFrame:
    grown = frame.groupBy("portfolio_id", "series_id", "weight").agg((F.col("weight") * F.max_by("level", "obs_date") / F.min_by("level", "obs_date")).alias("g"))
    total = F.sum("g").over(Window.partitionBy("portfolio_id"))
    shares = _asset_returns(frame).groupBy("portfolio_id", "series_id").agg(F.covar_samp("ret", "of").alias("c"), F.nullif(F.var_samp("of"), F.lit(0.0)).alias("v"))
    out = grown.withColumn("current_weight", F.col("g") / total).join(shares, ["portfolio_id", "series_id"], "left")
    return out.select("portfolio_id", "series_id", F.col("weight").alias("initial_weight"), "current_weight", (F.col("g") * initial).alias("current_value"), F.try_divide(F.col("weight") * F.col("c"), "v").alias("risk_share"))


def portfolio_reports(levels: DataFrame, portfolio: DataFrame, benchmarks: DataFrame, values: DataFrame, today: Column, label: str = "3y", initial: float = 100_000.0, conventions: Conventions = DEFAULT) -> DataFrame:
    """A row for each portfolio, bought at the period's start and held: period, age, value, metrics of the value, and allocation.

    The benchmark is that of the asset with the greatest weight, the first in
    order where weights tie. The aligned levels are written to the shared
    folder once, for all that is asked of them. Herfindahl index, effective number and largest
    weight are of the weights today, the diversification ratio of the first.
    """
    frame = written(_frame(levels, portfolio, label), "portfolio-levels")
    first = Window.partitionBy("portfolio_id", "series_id").orderBy("obs_date")
    path = frame.withColumn("g", F.col("level") / F.first("level").over(first)).groupBy("portfolio_id", "obs_date").agg((F.sum(F.col("weight") * F.col("g")) * initial).alias("level"))
    path = path.withColumnRenamed("portfolio_id", "series_id")
    # The least of (negative weight, id) is the first asset of the greatest weight.
    largest = portfolio.groupBy("portfolio_id").agg(F.min(F.struct((-F.col("weight")).alias("w"), "series_id")).alias("m")).select("portfolio_id", "m.series_id")
    chosen = largest.join(benchmarks, "series_id").select(F.col("portfolio_id").alias("series_id"), "benchmark_id")
    facts = frame.groupBy("portfolio_id").agg(F.min("obs_date").alias("period_start"), F.max("obs_date").alias("period_end"), F.count_distinct("series_id").alias("n_assets"), F.any_value("dates").alias("d"))
    ends = path.groupBy("series_id").agg(F.max_by("level", "obs_date").alias("value_end"))
    positions = _positions(frame, initial)
    hhi = F.sum(F.col("current_weight") * F.col("current_weight"))
    allocation = positions.groupBy("portfolio_id").agg(hhi.alias("hhi"), (1 / hhi).alias("effective_n"), F.max("current_weight").alias("largest_weight"))
    returns = _asset_returns(frame)
    # The whole's deviation is the same for each asset, as all have the same dates.
    spread = returns.groupBy("portfolio_id", "series_id", "weight").agg((F.col("weight") * F.stddev_samp("ret")).alias("s"), F.stddev_samp("of").alias("v"))
    ratio = spread.groupBy("portfolio_id").agg(F.try_divide(F.sum("s"), F.nullif(F.max("v"), F.lit(0.0))).alias("diversification_ratio"))
    age = F.datediff(today, F.col("period_end"))
    out = facts.join(allocation, "portfolio_id").join(ratio, "portfolio_id", "left").withColumnRenamed("portfolio_id", "series_id").join(ends, "series_id").join(chosen, "series_id", "left")
    out = out.select("series_id", F.lit(label).alias("period"), "period_start", "period_end", F.col("d.aligned").alias("dates_aligned"), F.col("d.dropped").alias("dates_dropped"), age.alias("age_days"), (age > STALE_AFTER_DAYS).alias("stale"), "benchmark_id", "n_assets", F.lit(initial).alias("value_start"), "value_end", "hhi", "effective_n", "largest_weight", "diversification_ratio")
    return out.join(_measured(path, chosen, values, conventions), "series_id").withColumnRenamed("series_id", "portfolio_id")


#: The columns of an exported portfolio, and its last line around the two dates.
EXPORT_COLUMNS = ("scheme_code", "fund_name", "initial_weight_pct", "current_weight_pct", "current_value_inr", "risk_contribution_pct", "synthetic_data")
EXPORT_NOTE = ("# As of ", "; buy-and-hold from ", ". Historical analysis only; not investment advice.")


def csv_field(text: Column) -> Column:
    """A text as a field of a CSV line: in quotes where it holds a comma, a quote or a line end; null is empty."""
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.coalesce(F.when(text.rlike('[,"\r\n]'), quoted).otherwise(text), F.lit(""))


def portfolio_export(levels: DataFrame, portfolio: DataFrame, funds: DataFrame, label: str = "max", initial: float = 100_000.0) -> DataFrame:
    """(portfolio_id, line, text): each portfolio as the lines of a CSV file, with its assets in order of their ids and a note at the end.

    ``funds(series_id, scheme_code, name, is_synthetic)`` describes the assets;
    one that it doesn't know has its id for a code, and no name. A portfolio
    without common dates has no lines. ``sinks.export_lines`` writes the files.
    """
    frame = written(_frame(levels, portfolio, label), "portfolio-levels")
    named = _positions(frame, initial).join(funds, "series_id", "left")

    def two(c: Column) -> Column:
        return F.format_string("%.2f", c)

    risk = F.when(F.col("risk_share").isNotNull(), two(F.col("risk_share") * 100))
    cells = (F.coalesce("scheme_code", "series_id"), F.col("name"), two(F.col("initial_weight") * 100), two(F.col("current_weight") * 100), two(F.col("current_value")), risk, F.when(F.col("is_synthetic"), "yes").otherwise("no"))
    place = F.row_number().over(Window.partitionBy("portfolio_id").orderBy("series_id"))
    rows = named.select("portfolio_id", place.alias("line"), F.concat_ws(",", *(csv_field(c) for c in cells)).alias("text"))
    ends = frame.groupBy("portfolio_id").agg(F.count_distinct("series_id").cast("int").alias("n"), F.min("obs_date").cast("string").alias("a"), F.max("obs_date").cast("string").alias("b"))
    note = csv_field(F.concat(F.lit(EXPORT_NOTE[0]), "b", F.lit(EXPORT_NOTE[1]), "a", F.lit(EXPORT_NOTE[2])))
    around = F.array(F.struct(F.lit(0).alias("line"), F.lit(",".join(EXPORT_COLUMNS)).alias("text")), F.struct((F.col("n") + 1).alias("line"), F.lit("").alias("text")), F.struct((F.col("n") + 2).alias("line"), note.alias("text")))
    return rows.unionByName(ends.select("portfolio_id", F.explode(around).alias("x")).select("portfolio_id", "x.*"))
