"""Forecast models as rows: trained for a series and horizon, published in a registry, used again, explained.

A model is known by its fingerprint, a hash of the data and settings that it
was trained on. A registry is a folder of batches, each a table of models. A
batch is written beside the registry and renamed to the hash of the
fingerprints that it was asked for, which fails if that name is there; so of
two writers of the same models one leaves its batch, and the other reads it.
Where batches overlap, a fingerprint's model is that of the least batch name.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fundloom.conventions import require
from fundloom.operators import learning
from fundloom.operators.learning import BACKGROUND, FEATURES, HORIZONS, NODES

KINDS = {"ridge": (learning.ridge_candidates, (0.1, 1.0, 10.0, 100.0)), "random_forest": (learning.forest_candidates, (3.0, 5.0, 8.0))}
#: A model: how it was chosen, the band's residual quantiles, a ridge's coefficients or a forest's nodes, and the means of sizes of Shapley values.
MODEL = f"series_id string, horizon int, chosen double, validation_mae double, low double, high double, constant double, slope array<double>, background array<double>, nodes array<struct<{', '.join(f'{a}: {b}' for a, b in (c.split() for c in NODES.split(', ')))}>>, importance array<double>"
NAMES = [c.split()[0] for c in ("series_id string, horizon int, chosen double, validation_mae double, low double, high double, constant double, slope a, background a, nodes a, importance a").split(", ")]


def fingerprints(levels: DataFrame, kind: str, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """(series_id, horizon, fingerprint) of the models that the data asks for."""
    each = [learning.fingerprint(levels, kind, h).select("series_id", F.lit(h).alias("horizon"), "fingerprint") for h in horizons]
    out = each[0]
    for one in each[1:]:
        out = out.unionByName(one)
    return out


def train(levels: DataFrame, asked: DataFrame, kind: str) -> DataFrame:
    """Models of ``MODEL`` with their fingerprints, for the series and horizons of ``asked(series_id, horizon, fingerprint)``.

    Chosen by validation error and fitted again up to the end of validation,
    as ``learning.selected_forecasts`` does. A series with too little history
    gives no model.
    """
    require(kind in KINDS, "the model is ridge or random_forest")
    candidates, parameters = KINDS[kind]
    columns = list(FEATURES)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("obs_date").reset_index(drop=True)
        train_, val, test = (np.flatnonzero(pdf["part"] == p) for p in ("train", "validation", "test"))
        if len(train_) < learning.LEAST_TRAIN or len(val) < learning.LEAST_VALIDATION or len(test) < learning.LEAST_TEST:
            return pd.DataFrame({c: [] for c in NAMES})
        x, y = pdf[columns].to_numpy(float), pdf["target"].to_numpy(float)
        scale = np.maximum(pdf["vol_63"].to_numpy(float), 1e-4) * math.sqrt(int(pdf["horizon"][0]) / 252)
        tried = candidates(x[train_], y[train_], x[val], parameters)
        mae = np.abs(tried - y[val]).mean(axis=1)
        best = int(np.argmin(mae))
        low, high = np.quantile((y[val] - tried[best]) / scale[val], [0.1, 0.9])
        fit = slice(0, val[-1] + 1)
        recent = x[-BACKGROUND:]
        row = {"series_id": pdf["series_id"][0], "horizon": int(pdf["horizon"][0]), "chosen": parameters[best], "validation_mae": float(mae[best]), "low": low, "high": high, "constant": None, "slope": None, "background": recent.mean(axis=0), "nodes": None}
        if kind == "ridge":
            row["slope"], row["constant"] = learning.ridge_fit(x[fit], y[fit], parameters[best])
            row["importance"] = np.abs((recent - row["background"]) * row["slope"]).mean(axis=0)
        else:
            nodes = learning.forest_nodes(x[fit], y[fit], int(parameters[best]))
            names = [c.split()[0] for c in NODES.split(", ")]
            row["nodes"] = [dict(zip(names, n, strict=True)) for n in nodes]
            row["importance"] = np.abs(learning.forest_attributions(nodes, recent)[0]).mean(axis=0)
        return pd.DataFrame([row])[NAMES]

    rows = learning.features(levels)
    split = None
    for (h,) in asked.select("horizon").distinct().collect():
        wanted = asked.where(F.col("horizon") == h).select("series_id")
        one = learning.purged_split(learning.complete(learning.target(rows.join(wanted, "series_id", "left_semi"), h), tuple(columns)), h).withColumn("horizon", F.lit(h))
        split = one if split is None else split.unionByName(one)
    if split is None:
        return asked.sparkSession.createDataFrame([], MODEL + ", fingerprint string")
    return split.groupBy("series_id", "horizon").applyInPandas(run, MODEL).join(asked, ["series_id", "horizon"])


def _latest(levels: DataFrame) -> DataFrame:
    newest = F.row_number().over(Window.partitionBy("series_id").orderBy(F.desc("obs_date")))
    return learning.features(levels).dropna(subset=[*FEATURES]).withColumn("k", newest).where("k = 1").drop("k")


def forecast(models: DataFrame, levels: DataFrame) -> DataFrame:
    """(series_id, horizon, as_of, predicted, low, high, base, attributions, importance): what stored models say of each series' latest row.

    Log returns with their 80 % band. ``attributions`` are the features' parts:
    with ``base`` they add up to the forecast. ``importance`` is the mean of
    their sizes over the last rows of the training table.
    """
    columns = list(FEATURES)

    def run(pdfs):
        for pdf in pdfs:
            out = []
            for r in pdf.itertuples():
                at = np.array([[getattr(r, c) for c in columns]], float)
                if r.nodes is not None:
                    nodes = [tuple(n.values()) if isinstance(n, dict) else tuple(n) for n in r.nodes]
                    parts, base = learning.forest_attributions(nodes, at)
                    value = float(learning.forest_predictions(nodes, at)[0])
                else:
                    slope, centre = np.array(r.slope), np.array(r.background)
                    parts, base = (at - centre) * slope, float(r.constant + centre @ slope)
                    value = float(r.constant + at[0] @ slope)
                scale = max(r.vol_63, 1e-4) * math.sqrt(r.horizon / 252)
                out.append((r.series_id, r.horizon, r.obs_date, value, value + r.low * scale, value + r.high * scale, base, parts[0].tolist(), list(r.importance)))
            yield pd.DataFrame(out, columns=["series_id", "horizon", "as_of", "predicted", "low", "high", "base", "attributions", "importance"])

    met = models.join(_latest(levels), "series_id")
    return met.mapInPandas(run, "series_id string, horizon int, as_of date, predicted double, low double, high double, base double, attributions array<double>, importance array<double>")


def published(spark: SparkSession, registry: str) -> DataFrame:
    """(fingerprint, model...) of a registry: one model of each fingerprint; rows that have lost their coefficients and nodes are no models."""
    schema = MODEL + ", fingerprint string"
    path = spark._jvm.org.apache.hadoop.fs.Path(registry)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(registry).withColumn("batch", F.input_file_name())
    rows = rows.where("slope IS NOT NULL OR nodes IS NOT NULL")
    first = rows.groupBy("fingerprint").agg(F.min("batch").alias("batch"))
    return rows.join(first, ["fingerprint", "batch"], "left_semi").drop("batch")


def publish(models: DataFrame, asked: DataFrame, registry: str) -> bool:
    """Write a batch of models; False if a batch for the same fingerprints was there first, and this one is dropped."""
    spark = models.sparkSession
    digest = F.sha2(F.concat_ws(",", F.array_sort(F.collect_set("fingerprint"))), 256)
    name = asked.agg(digest.alias("name")).first().name
    made = f"{registry.rstrip('/')}-writing/{uuid.uuid4().hex}"
    models.coalesce(1).write.parquet(made)
    fs = spark._jvm.org.apache.hadoop.fs
    source, target = fs.Path(made), fs.Path(f"{registry.rstrip('/')}/{name}")
    conf = spark._jsc.hadoopConfiguration()
    context = fs.FileContext.getFileContext(source.toUri(), conf)
    files = source.getFileSystem(conf)
    files.mkdirs(target.getParent())
    try:
        # Without an option to overwrite, a rename onto a name that is there fails.
        context.rename(source, target, spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0))
        return True
    except Exception as e:
        if "FileAlreadyExists" not in str(e) and not files.exists(target):
            raise
        files.delete(source, True)
        return False


def stored_forecasts(levels: DataFrame, registry: str, kind: str = "ridge", horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """``forecast`` by models of the registry; those that it lacks are trained and published first."""
    asked = fingerprints(levels, kind, horizons)
    missing = asked.join(published(levels.sparkSession, registry).select("fingerprint"), "fingerprint", "left_anti")
    if missing.take(1):
        publish(train(levels, missing, kind), missing, registry)
    models = published(levels.sparkSession, registry).join(asked.select("fingerprint"), "fingerprint", "left_semi")
    return forecast(models, levels)
