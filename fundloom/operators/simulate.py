"""What-if projections of regular investments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sip_projection(plans: DataFrame) -> DataFrame:
    """Yearly invested amount and value of ``plans(plan_id, monthly, years, annual_return, lumpsum, step_up)``.

    Contributions come at the start of a month and rise by ``step_up`` each
    year. Years are folded one after the other, each as a sum of a geometric
    series, so a plan costs as many steps as it has years.
    """
    rate = F.pow(1 + F.col("annual_return"), 1 / 12) - 1
    base = plans.withColumn("g", 1 + F.col("annual_return")).withColumn("due", F.when(F.abs(rate) < 1e-12, F.lit(12.0)).otherwise((F.pow(1 + rate, 12) - 1) / rate * (1 + rate)))
    # A year's contributions are worth monthly * (1 + step_up)^(year - 1) * due at its end.
    start = F.struct(F.col("lumpsum").cast("double").alias("value"), F.col("lumpsum").cast("double").alias("invested"), F.col("monthly").cast("double").alias("monthly"), F.array().cast("array<struct<year:int,invested:double,value:double>>").alias("rows"))

    def step(state, year):
        value = state["value"] * F.col("g") + state["monthly"] * F.col("due")
        invested = state["invested"] + 12 * state["monthly"]
        row = F.struct(year.cast("int").alias("year"), invested.alias("invested"), value.alias("value"))
        return F.struct(value.alias("value"), invested.alias("invested"), (state["monthly"] * (1 + F.col("step_up"))).alias("monthly"), F.array_append(state["rows"], row).alias("rows"))

    folded = base.withColumn("s", F.aggregate(F.sequence(F.lit(1), "years"), start, step))
    return folded.select("plan_id", F.explode("s.rows").alias("r")).select("plan_id", "r.*")
