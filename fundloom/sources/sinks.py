"""Writers that load imports once, whatever is imported again."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def upsert_changes(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """``incoming`` with ``change``: inserted, updated or unchanged, by a join on the keys."""
    old = existing.select(*keys, F.lit(True).alias("_known"), *(F.col(v).alias(f"_old_{v}") for v in values))
    joined = incoming.join(old, list(keys), "left")
    same = F.lit(True)
    for v in values:
        same = same & F.col(v).eqNullSafe(F.col(f"_old_{v}"))
    change = F.when(F.col("_known").isNull(), "inserted").when(same, "unchanged").otherwise("updated")
    return joined.select(*incoming.columns, change.alias("change"))


def upserted(existing: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Existing rows whose key isn't among the incoming ones, and all incoming rows."""
    kept = existing.join(incoming.select(*keys).distinct(), list(keys), "left_anti")
    return kept.select(*incoming.columns).unionByName(incoming)


def last_of_each(incoming: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """One row for each key: that with the greatest ``order``, by an aggregate with partial results."""
    last = incoming.groupBy(*keys).agg(F.max_by(F.struct(*(c for c in incoming.columns if c not in keys)), order).alias("_last"))
    return last.select(*(F.col(c) if c in keys else F.col("_last")[c].alias(c) for c in incoming.columns))


def upsert_partitions(spark: SparkSession, path: str, incoming: DataFrame, keys: Sequence[str], partition: str) -> None:
    """Insert or update rows of a Parquet table; only partitions that lose or get rows are written anew.

    A key whose partition changes leaves its old one, so partitions that hold
    an incoming key count as touched too. Repeated keys in ``incoming`` are an
    error. What is to be done goes to a folder beside the table first, and
    stands once that is renamed: the new rows of the touched partitions, and
    those partitions that are emptied. A call that ends between there and its
    end is done over by the next one, or by ``finish_upsert``.
    """
    finish_upsert(spark, path, partition)
    table = spark.read.parquet(path)
    repeated = incoming.groupBy(*keys).count().where("count > 1").limit(1).collect()
    if repeated:
        raise ValueError(f"a key comes twice: {repeated[0]}")
    held = table.join(incoming.select(*keys), list(keys), "left_semi").select(partition)
    touched = held.unionByName(incoming.select(partition)).distinct()
    same = F.col(partition).eqNullSafe(F.col("_touched"))
    old = table.join(touched.withColumnRenamed(partition, "_touched"), same, "left_semi")
    made, stands = f"{path.rstrip('/')}.writing", f"{path.rstrip('/')}.new"
    upserted(old, incoming, keys).write.mode("overwrite").parquet(f"{made}/rows")
    new = spark.read.parquet(f"{made}/rows").select(F.col(partition).alias("_touched")).distinct()
    touched.join(new, same, "left_anti").write.mode("overwrite").parquet(f"{made}/emptied")
    files, at = _files(spark, made)
    if not files.rename(at(made), at(stands)):
        raise OSError(f"{made} can't be renamed")
    finish_upsert(spark, path, partition)


def _files(spark: SparkSession, path: str):
    """The file system of a path, and what makes paths of it."""
    at = spark._jvm.org.apache.hadoop.fs.Path
    return at(path).getFileSystem(spark._jsc.hadoopConfiguration()), at


def finish_upsert(spark: SparkSession, path: str, partition: str) -> bool:
    """Do what ``upsert_partitions`` has written down and not done yet; whether there was anything. It may be done twice.

    Emptied partitions go first, so a key that moves is never there twice.
    """
    root = path.rstrip("/")
    files, at = _files(spark, root)
    if not files.exists(at(f"{root}.new")):
        return False
    escape = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    for (value,) in spark.read.parquet(f"{root}.new/emptied").select(F.col(partition).cast("string")).toLocalIterator():
        files.delete(at(f"{root}/{partition}={'__HIVE_DEFAULT_PARTITION__' if value is None else escape(value)}"), True)
    spark.read.parquet(f"{root}.new/rows").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
    files.delete(at(f"{root}.new"), True)
    return True


def snapshot_changes(existing: DataFrame, incoming: DataFrame, group: Sequence[str], row: Sequence[str]) -> DataFrame:
    """(group, verdict): "same" where both hold the same rows of a group, else "replace" or "new".

    Groups are compared by an order-free sum of row hashes, which is summed
    where the rows lie; no group is collected.
    """
    mark = (F.count("*").alias("n"), F.sum(F.xxhash64(*row).cast("decimal(38,0)")).alias("h"))
    old = existing.groupBy(*group).agg(*mark).select(*group, F.col("n").alias("old_n"), F.col("h").alias("old_h"))
    new = incoming.groupBy(*group).agg(*mark)
    verdict = F.when(F.col("old_n").isNull(), "new").when((F.col("n") == F.col("old_n")) & (F.col("h") == F.col("old_h")), "same").otherwise("replace")
    return new.join(old, list(group), "left").select(*group, verdict.alias("verdict"))


def ledger(rows: DataFrame, batch_id: str, kind: str, most: int = 500, width: int = 120) -> DataFrame:
    """One row for an import: counts, and at most ``most`` of its rejected lines with their reasons."""
    bad = rows.where("reason IS NOT NULL").orderBy("line").limit(most).select(F.struct("line", F.substring("reason", 1, width).alias("reason")).alias("r"))
    rejected = bad.agg(F.sort_array(F.collect_list("r")).alias("rejected"))
    counts = rows.agg(F.count("*").alias("rows_total"), F.count_if(F.col("reason").isNotNull()).alias("rows_rejected"))
    return counts.withColumn("rejected", rejected.scalar()).select(F.lit(batch_id).alias("batch_id"), F.lit(kind).alias("kind"), "rows_total", "rows_rejected", "rejected")


def ledger_with_values(rows: DataFrame, warnings: DataFrame, batch_id: str, kind: str, most: int = 500, most_warnings: int = 200, width: int = 120) -> DataFrame:
    """``ledger`` with its rejected rows as JSON of line, reason and the texts of their columns, and ``warnings`` as a JSON list in order.

    Texts are cut to ``width`` characters and the lists to their first entries,
    as both are for people to read; the counts are over all rows. ``rows`` hold
    ``raw``, a map of texts; ``warnings`` holds the column ``warning``.
    """
    values = F.transform_values("raw", lambda _, v: F.substring(v, 1, width))
    bad = rows.where("reason IS NOT NULL").orderBy("line").limit(most).select(F.struct("line", "reason", values.alias("values")).alias("r"))
    # Structs with a map can't be sorted as such.
    rejected = bad.agg(F.to_json(F.array_sort(F.collect_list("r"), lambda a, b: (a["line"] - b["line"]).cast("int"))).alias("j"))
    told = warnings.orderBy("warning").limit(most_warnings).agg(F.to_json(F.array_sort(F.collect_list("warning"))).alias("j"))
    counts = rows.agg(F.count("*").alias("rows_total"), F.count_if(F.col("reason").isNotNull()).alias("rows_rejected"))
    return counts.select(F.lit(batch_id).alias("batch_id"), F.lit(kind).alias("kind"), "rows_total", "rows_rejected", rejected.scalar().alias("rejected"), told.scalar().alias("warnings"))


def export_csv(df: DataFrame, folder: str) -> None:
    """Quoted CSV with a header; numbers with two digits."""
    df.select(*(F.format_string("%.2f", F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes)).write.option("header", True).option("quote", '"').option("escape", '"').csv(folder)


def export_lines(lines: DataFrame, folder: str, key: str = "portfolio_id") -> None:
    """Write ``lines(key, line, text)`` as text files, one for each key in a folder of its own, its lines in order."""
    lines.repartition(key).sortWithinPartitions(key, "line").select(key, F.col("text").alias("value")).write.partitionBy(key).text(folder)
