"""Operators on long tables of level series: (series_id, obs_date, level).

All windows are over one series in order of date. A series holds one level for
a date, so a window is as long as a history has trading days.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fundloom.conventions import COVERAGE_TOLERANCE_DAYS, PERIODS, STALE_AFTER_DAYS, Conventions, require


def in_order(*more: Column | str):
    return Window.partitionBy("series_id", *more).orderBy("obs_date")


def trailing(n: int, last: int = 0):
    """The frame of the n rows that end ``last`` rows before this one."""
    return in_order().rowsBetween(-(n - 1) - last, -last)


def level_faults(levels: DataFrame) -> DataFrame:
    """(series_id, obs_date, reason) of dates that make a series unfit: missing, non-positive or repeated levels."""
    seen = levels.groupBy("series_id", "obs_date").agg(F.count("*").alias("n"), F.count("level").alias("known"), F.min("level").alias("least"))
    reason = F.when(F.col("n") > 1, "duplicate date").when(F.col("known") == 0, "missing value").when((F.col("least") <= 0) | F.isnan("least"), "non-positive level")
    return seen.select("series_id", "obs_date", reason.alias("reason")).where("reason IS NOT NULL")


def checked_level() -> Column:
    """The level, where it is a positive number; another one is an error, not a gap."""
    name = F.concat_ws(" ", F.lit("a level that is missing or not positive:"), "series_id", F.col("obs_date").cast("string"))
    return F.when(F.col("level") > 0, F.col("level")).otherwise(F.raise_error(name).cast("double"))


def simple_returns(levels: DataFrame) -> DataFrame:
    """``ret``: this level over the one before, less one; the first date is left out. Levels that aren't positive are an error."""
    sound = levels.withColumn("level", checked_level())
    before = F.lag("level").over(in_order())
    return sound.withColumn("ret", F.col("level") / before - 1).where("ret IS NOT NULL")


def rebase(levels: DataFrame, base: float = 100.0, *more: str) -> DataFrame:
    """``rebased``: the level in units of the series' first, times ``base``."""
    return levels.withColumn("rebased", F.col("level") / F.first("level").over(in_order(*more)) * base)


def drawdowns(levels: DataFrame) -> DataFrame:
    """``drawdown``: the level over the greatest so far, less one."""
    peak = F.max("level").over(in_order().rowsBetween(Window.unboundedPreceding, 0))
    return levels.withColumn("drawdown", F.col("level") / peak - 1)


def worst_drawdown(levels: DataFrame) -> DataFrame:
    """(series_id, max_drawdown, peak_date, trough_date, recovery_date) for each series.

    The first trough and the first peak win ties. A recovery is the first date
    from the trough on with at least the peak's level, and only after a loss.
    """
    below = drawdowns(levels)
    trough = below.groupBy("series_id").agg(F.min(F.struct("drawdown", "obs_date")).alias("t"))
    trough = trough.select("series_id", F.col("t.drawdown").alias("max_drawdown"), F.col("t.obs_date").alias("trough_date"))
    joined = below.join(trough, "series_id")
    first_peak = F.max(F.when(F.col("obs_date") <= F.col("trough_date"), F.struct("level", (-F.unix_date("obs_date")).alias("d"))))
    peak = joined.groupBy("series_id", "max_drawdown", "trough_date").agg(first_peak.alias("p"))
    peak = peak.select("series_id", "max_drawdown", "trough_date", F.date_from_unix_date(-F.col("p.d")).alias("peak_date"), F.col("p.level").alias("peak_level"))
    again = (F.col("obs_date") >= F.col("trough_date")) & (F.col("level") >= F.col("peak_level")) & (F.col("max_drawdown") < 0)
    recovered = levels.join(peak, "series_id").groupBy("series_id").agg(F.min(F.when(again, F.col("obs_date"))).alias("recovery_date"))
    return peak.drop("peak_level").join(recovered, "series_id")


def rolling_volatility(returns: DataFrame, n: int = 63, conventions: Conventions = Conventions()) -> DataFrame:
    """Windows of n returns; dates without a full window are left out."""
    sd = F.stddev_samp("ret").over(trailing(n)) * conventions.periods**0.5
    return returns.withColumn("full", F.count("ret").over(trailing(n)) == n).withColumn("volatility", sd).where("full").drop("full")


def rolling_sharpe(returns: DataFrame, n: int = 126, conventions: Conventions = Conventions()) -> DataFrame:
    """Null where the window doesn't vary."""
    excess = (F.avg("ret").over(trailing(n)) - conventions.period_rate) * conventions.periods**0.5
    value = F.try_divide(excess, F.nullif(F.stddev_samp("ret").over(trailing(n)), F.lit(0.0)))
    return returns.withColumn("full", F.count("ret").over(trailing(n)) == n).withColumn("sharpe", value).where("full").drop("full")


def aligned_returns(levels: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Returns of both sides on the dates that both have: (series_id, obs_date, ret, bret).

    Each side's returns are formed before the join, from its own dates.
    """
    own = benchmark.select(F.lit("benchmark").alias("series_id"), "obs_date", F.col("value").alias("level"))
    return simple_returns(levels).join(simple_returns(own).select("obs_date", F.col("ret").alias("bret")), "obs_date").select("series_id", "obs_date", "ret", "bret")


def rolling_beta(aligned: DataFrame, n: int = 126) -> DataFrame:
    beta = F.try_divide(F.covar_samp("ret", "bret").over(trailing(n)), F.nullif(F.var_samp("bret").over(trailing(n)), F.lit(0.0)))
    return aligned.withColumn("full", F.count("ret").over(trailing(n)) == n).withColumn("beta", beta).where("full").drop("full")


def align_levels(levels: DataFrame) -> DataFrame:
    """The rows of dates that every series has."""
    wanted = levels.select(F.count_distinct("series_id")).scalar()
    dates = levels.groupBy("obs_date").agg(F.count("*").alias("n")).where(F.col("n") == wanted).select("obs_date")
    return levels.join(dates, "obs_date", "left_semi")


def alignment_report(levels: DataFrame) -> DataFrame:
    """One row: dates_in_union, dates_aligned, dates_dropped."""
    wanted = levels.select(F.count_distinct("series_id")).scalar()
    per_date = levels.groupBy("obs_date").agg(F.count("*").alias("n"))
    return per_date.agg(F.count("*").alias("dates_in_union"), F.count_if(F.col("n") == wanted).alias("dates_aligned"), F.count_if(F.col("n") < wanted).alias("dates_dropped"))


def resolve_period(levels: DataFrame, label: str) -> DataFrame:
    """(series_id, start, end, covered) of a period that ends at each series' latest date.

    The start is clamped to the first date; ``covered`` tells whether the
    history reaches back to the start asked for, within five days.
    """
    months = PERIODS[label]
    ends = levels.groupBy("series_id").agg(F.min("obs_date").alias("first"), F.max("obs_date").alias("end"))
    asked = F.col("first") if months is None else F.add_months("end", -months)
    return ends.select("series_id", F.greatest(asked, F.col("first")).alias("start"), "end", (F.datediff(asked, F.col("first")) >= -COVERAGE_TOLERANCE_DAYS).alias("covered"))


def in_period(levels: DataFrame, label: str | None = None, start: date | None = None, end: date | None = None) -> DataFrame:
    """The levels of a labelled period, or of the dates from ``start`` to ``end``, of which either may be open."""
    if label is not None:
        require(start is None and end is None, "a period is given by its label or by dates")
        periods = resolve_period(levels, label).select("series_id", "start", "end")
        return levels.join(periods, "series_id").where("obs_date BETWEEN start AND end").drop("start", "end")
    require(start is None or end is None or start <= end, "a period starts after its end")
    out = levels if start is None else levels.where(F.col("obs_date") >= F.lit(start))
    return out if end is None else out.where(F.col("obs_date") <= F.lit(end))


def freshness(levels: DataFrame, today: Column) -> DataFrame:
    """(series_id, latest, age_days, stale): a series is stale when its latest date is over seven days old."""
    latest = levels.groupBy("series_id").agg(F.max("obs_date").alias("latest"))
    age = F.datediff(today, F.col("latest"))
    return latest.select("series_id", "latest", age.alias("age_days"), F.coalesce(age > STALE_AFTER_DAYS, F.lit(True)).alias("stale"))


def trailing_returns(levels: DataFrame) -> DataFrame:
    """Returns over 1m to 5y and since the start, from the first date on or after each start.

    Periods over a year, and a history of more than 365 days, are annualised.
    A period that the history doesn't cover has a null return.
    """
    months = [(k, m) for k, m in PERIODS.items() if m] + [("since_start", None)]
    ends = levels.groupBy("series_id").agg(F.min("obs_date").alias("first"), F.max("obs_date").alias("latest"), F.max_by("level", "obs_date").alias("last_level"))
    wanted = F.array(*(F.struct(F.lit(k).alias("period"), F.lit(m).cast("int").alias("months")) for k, m in months))
    asked = ends.select("*", F.explode(wanted).alias("w")).select("series_id", "first", "latest", "last_level", "w.*")
    start = F.when(F.col("months").isNull(), F.col("first")).otherwise(F.add_months("latest", -F.col("months")))
    asked = asked.withColumn("start", start).withColumn("covered", F.datediff("start", "first") >= -COVERAGE_TOLERANCE_DAYS)
    # The range is an equi-join on the series, then a filter; an aggregate keeps the first level.
    at = levels.join(asked, "series_id").where("obs_date >= start")
    first = at.groupBy("series_id", "period", "months", "covered", "latest", "last_level").agg(F.min(F.struct("obs_date", "level")).alias("f"))
    growth = F.col("last_level") / F.col("f.level")
    days = F.datediff("latest", "f.obs_date")
    long = (F.col("months") > 12) | (F.col("months").isNull() & (days > 365))
    value = F.when(long & (days > 0), F.pow(growth, 365.25 / F.nullif(days, F.lit(0))) - 1).otherwise(growth - 1)
    return first.select("series_id", "period", F.col("f.obs_date").alias("start_date"), F.when(F.col("covered"), value).alias("value"), F.coalesce(long, F.lit(False)).alias("annualised"))


def as_of_one_year(levels: DataFrame, tolerance_days: int = 7) -> DataFrame:
    """The return since the latest level at or before a year ago, if it is not over seven days older."""
    latest = levels.groupBy("series_id").agg(F.max("obs_date").alias("latest"), F.max_by("level", "obs_date").alias("last_level")).withColumn("target", F.add_months("latest", -12))
    found = levels.join(latest, "series_id").where(F.col("obs_date").between(F.date_sub("target", tolerance_days), F.col("target")))
    base = found.groupBy("series_id", "last_level").agg(F.max(F.struct("obs_date", "level")).alias("b"))
    base = base.select("series_id", F.col("b.obs_date").alias("base_date"), (F.col("last_level") / F.col("b.level") - 1).alias("one_year_return"))
    return latest.select("series_id", "latest").join(base, "series_id", "left")


def carried_forward(levels: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``value``: the benchmark at each date of a series, or the last one seen on the series' dates before."""
    joined = levels.join(benchmark, "obs_date", "left")
    return joined.withColumn("value", F.last("value", ignorenulls=True).over(in_order().rowsBetween(Window.unboundedPreceding, 0)))


def large_moves(levels: DataFrame, new: Column, threshold: float = 0.2) -> DataFrame:
    """Changes beyond the threshold between neighbouring dates, of which ``new`` marks at least one."""
    w = in_order()
    moved = levels.withColumn("is_new", new).withColumn("prev_date", F.lag("obs_date").over(w)).withColumn("prev_new", F.lag("is_new").over(w)).withColumn("change", F.try_divide("level", F.lag("level").over(w)) - 1)
    return moved.where((F.abs("change") > threshold) & (F.col("is_new") | F.col("prev_new"))).select("series_id", "prev_date", "obs_date", "change")
