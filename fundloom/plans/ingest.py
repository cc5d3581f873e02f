"""Queries on imports, and their SQL twins. Orders stand for a CSV file, damaged by rules on their key."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fundloom.operators import series
from fundloom.plans.common import Query, named, rounded
from fundloom.sources import csvkinds, csvsplit, sinks
from fundloom.sources.adapters import LEVELS_SQL, levels, table
from fundloom.storage import shared_folder, small_methods, written

TODAY = "2001-06-30"


def _raw_nav(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows (line, scheme_code, date, nav) as text: odd dates, blanks, negatives, duplicates and conflicts."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    k = F.col("o_orderkey")
    day = F.to_date("o_orderdate")
    date = F.when(k % 11 == 0, F.date_format(day, "dd-MM-yyyy")).when(k % 13 == 0, F.date_format(day, "d/M/yyyy")).when(k % 17 == 0, "never").otherwise(day.cast("string"))
    price = F.format_string("%.2f", "o_totalprice")
    nav = F.when(k % 19 == 0, "").when(k % 23 == 0, F.concat(F.lit("-"), price)).when(k % 29 == 0, F.concat(F.lit("Rs. "), price)).otherwise(price)
    code = F.when(k % 31 == 0, "-bad code-").otherwise(F.concat(F.lit("FS-"), k))
    first = o.select((2 * k).alias("line"), code.alias("scheme_code"), date.alias("date"), nav.alias("nav"))
    # Every seventh row comes again, every 21st with another value.
    again = o.where(k % 7 == 0).select((2 * k + 1).alias("line"), code.alias("scheme_code"), date.alias("date"), F.when(k % 3 == 0, "1.00").otherwise(nav).alias("nav"))
    return first.unionByName(again)


def _validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return csvkinds.validated(_raw_nav(spark, sf_dir), "nav", F.lit(TODAY).cast("date"))


def csv_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _validated(spark, sf_dir).withColumn("nav", F.col("nav").cast("double"))


def csv_dedup_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return csvkinds.resolved_keys(_validated(spark, sf_dir), "nav").select("line", "scheme_code", "date", "reason")


def import_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return csvkinds.import_counts(csvkinds.resolved_keys(_validated(spark, sf_dir), "nav"))


def import_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger row of the damaged file, its rejected lines as text."""
    row = sinks.ledger(csvkinds.resolved_keys(_validated(spark, sf_dir), "nav"), "batch-1", "nav")
    lines = F.array_join(F.transform("rejected", lambda r: F.concat(r["line"].cast("string"), F.lit(" "), r["reason"])), "|")
    return row.withColumn("rejected", lines)


def price_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates of level series damaged by rules on the day: missing, zero and repeated levels."""
    day = F.dayofyear("obs_date")
    hurt = levels(spark, sf_dir).withColumn("level", F.when(day % 50 == 0, None).when(day % 70 == 0, 0.0).otherwise(F.col("level")))
    return series.level_faults(hurt.unionByName(hurt.where(day % 90 == 0)))


def portfolio_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as portfolios of their lines' suppliers by quantity; every fifth order has an odd line."""
    # Dealt by number, so that orders of a part are as few as the session's parts make them.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", F.col("l_quantity").cast("double").alias("q")).repartition(parts, "l_orderkey")
    lines = lines.withColumn("total", F.sum("q").over(Window.partitionBy("l_orderkey")))
    odd = (F.col("l_orderkey") % 5 == 0) & (F.col("l_linenumber") == 2)
    rows = lines.select(F.col("l_orderkey").alias("portfolio_id"), F.col("l_linenumber").alias("line"), F.when(odd & (F.col("l_orderkey") % 2 == 0), "FS-none").otherwise(F.concat(F.lit("FS-"), "l_suppkey")).alias("scheme_code"), F.when(odd & (F.col("l_orderkey") % 2 == 1), "n/a").otherwise(F.round(100 * F.col("q") / F.col("total"), 6).cast("string")).alias("weight_pct"))
    funds = table(spark, sf_dir, "supplier").select(F.concat(F.lit("FS-"), "s_suppkey").alias("code"))
    found = csvkinds.portfolio_problems(rows, funds)
    return found.select("portfolio_id", "n_rows", F.array_join("problems", "|").alias("problems"))


def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("value"))
    new = o.where("key % 2 = 0").withColumn("value", F.when(F.col("key") % 10 == 0, F.col("value") + 1).otherwise(F.col("value")))
    return o.where("key % 3 <> 0"), new


def upsert_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(sinks.upsert_changes(*_versions(spark, sf_dir), ["key"], ["value"]), 2)


def upsert_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(sinks.upserted(*_versions(spark, sf_dir), ["key"]), 2)


def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as a snapshot: every fifth order lost its first line, every seventh is new."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    old = rows.where("l_orderkey % 7 <> 0 AND NOT (l_orderkey % 5 = 0 AND l_linenumber = 1)")
    return sinks.snapshot_changes(old, rows, ["l_orderkey"], ["l_linenumber", "l_partkey"])


def unknown_code_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of customers that the directory, here without every ninth customer, doesn't know."""
    known = table(spark, sf_dir, "customer").where("c_custkey % 9 <> 0").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf_dir, "orders").join(known, "o_custkey", "left_anti").select("o_orderkey", "o_custkey")


def key_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines whose (part, supplier) an order of large quantity names too."""
    lines = table(spark, sf_dir, "lineitem")
    keys = lines.where("l_quantity >= 49").select("l_partkey", "l_suppkey")
    return lines.join(keys, ["l_partkey", "l_suppkey"], "left_semi").select("l_orderkey", "l_linenumber")


def nav_file_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    text = F.concat_ws(";", (k % 500).cast("string"), F.lit("-"), F.lit("-"), F.concat(F.lit("Scheme "), k % 500), F.when(k % 41 == 0, "N.A.").otherwise(F.format_string("%.4f", "o_totalprice")), F.date_format("o_orderdate", "dd-MMM-yyyy"))
    lines = o.select(k.alias("line"), F.when(k % 37 == 0, "Open Ended Schemes").otherwise(text).alias("value"))
    return rounded(csvkinds.parse_nav_lines(lines).withColumn("nav", F.col("nav").cast("double")), 4)


#: For each kind the table whose rows stand for a file's, and its columns; each rule on the key damages a column.
_FILES = {
    "benchmarks": ("part", {"benchmark_code": "if(p_partkey % 7 = 0, '-x', 'BM-' || p_partkey)", "name": "if(p_partkey % 11 = 0, ' ', p_name || ' \"A\", \n' || p_brand)", "return_basis": "if(p_partkey % 5 = 0, 'net', if(p_partkey % 2 = 0, 'Price', 'TOTAL_RETURN'))"}),
    "benchmark_values": ("orders", {"benchmark_code": "'BM-' || o_orderkey", "date": "if(o_orderkey % 7 = 0, '31-02-2000', date_format(o_orderdate, 'dd MMM yyyy'))", "value": "if(o_orderkey % 5 = 0, '0', '1,234.5')"}),
    "funds": ("supplier", {"scheme_code": "'FS-' || s_suppkey", "name": "s_name", "category": "if(s_suppkey % 7 = 0, repeat('x', 81), 'Large \n  cap')", "asset_class": "if(s_suppkey % 5 = 0, 'gold', 'Equity')", "launch_date": "if(s_suppkey % 3 = 0, 'soon', '')", "expense_ratio_pct": "if(s_suppkey % 4 = 0, '101%', '1.25%')"}),
    "nav": ("orders", {"scheme_code": "'FS-' || o_orderkey", "date": "date_format(o_orderdate, 'd/M/yyyy')", "nav": "if(o_orderkey % 5 = 0, 'n/a', if(o_orderkey % 7 = 0, '-1', 'Rs 1,234.50'))"}),
    "aum": ("customer", {"scheme_code": "'FS-' || c_custkey", "as_of_date": "'2000-01-31'", "aum_crore": "if(c_custkey % 3 = 0, '-0.01', '0')"}),
    "sip_flows": ("customer", {"scheme_code": "'FS-' || (c_custkey - c_custkey % 2)", "month": "'15-03-2000'", "sip_inflow_crore": "'10'", "sip_accounts": "if(c_custkey % 8 >= 6, '2.5', if(c_custkey % 4 = 0, '12', ''))"}),
    "holdings": ("lineitem", {"scheme_code": "'FS-' || l_suppkey", "as_of_date": "date_format(l_shipdate, 'yyyy-MM-01')", "holding_name": "l_orderkey || ' \"' || l_linenumber || '\",\n'", "sector": "'s'", "asset_type": "'equity'", "weight_pct": "'' || cast(l_quantity as int)"}),
}


def _imported(spark: SparkSession, sf_dir: str, kind: str, *kept: str) -> DataFrame:
    """Columns of a kind's rows, written as quoted files of the shared folder, read by splits and checked once, into a table."""
    source, columns = _FILES[kind]
    folder = f"{shared_folder(spark)}/fundloom/{spark.sparkContext.applicationId}/csv-{kind}-{uuid.uuid4().hex}"
    rows = table(spark, sf_dir, source).select(*(F.expr(e).alias(c) for c, e in columns.items()))
    rows.write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(folder)
    blocks = csvsplit.scanned(spark, folder)
    problems = csvsplit.file_problems(spark, folder, kind, blocks=blocks).select("path")
    raw = csvsplit.read_csv_split(spark, folder, kind, blocks).join(problems, "path", "left_anti")
    checked = csvkinds.validated(raw, kind, F.lit(TODAY).cast("date"))
    with small_methods(spark):
        return written(checked.select(*kept), f"checked-{kind}")


def csv_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each kind's files, how many rows there are for each reason of refusal; null for good rows."""
    out = None
    for kind in _FILES:
        found = _imported(spark, sf_dir, kind, "reason")
        one = found.groupBy(F.lit(kind).alias("kind"), "reason").agg(F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


def holdings_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holdings by fund and month from quoted files: how many rows stay or go, and the warning or the reason. A month's rows count over all files."""
    found = _imported(spark, sf_dir, "holdings", "scheme_code", "as_of_date", "weight_pct", "reason")
    kept = csvkinds.refused_totals(found)
    key = ["scheme_code", "as_of_date"]
    # By reason first, as a greatest text is found by sorting all rows of a key.
    reasons = kept.groupBy(*key, "reason").agg(F.count("*").alias("n"))
    counted = reasons.groupBy(*key).agg(F.sum("n").alias("n_rows"), F.sum(F.when(F.col("reason").isNotNull(), F.col("n")).otherwise(0)).alias("n_refused"), F.max("reason").alias("reason"))
    return counted.join(csvkinds.incomplete_totals(kept), key, "left")


def queries() -> dict[str, Query]:
    return named(csv_validate, csv_dedup_conflict, import_counts, import_ledger, price_faults, portfolio_import, upsert_diff, upsert_result, snapshot_diff, unknown_code_anti, key_semi, nav_file_parse, csv_kinds, holdings_import)


_RAW = """
o AS (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS d, printf('%.2f', o_totalprice) AS p FROM orders),
r1 AS (SELECT 2 * k AS line, k, CASE WHEN k % 31 = 0 THEN '-bad code-' ELSE 'FS-' || k END AS scheme_code,
  CASE WHEN k % 11 = 0 THEN d WHEN k % 13 = 0 THEN d WHEN k % 17 = 0 THEN NULL ELSE d END AS d,
  CASE WHEN k % 19 = 0 THEN NULL WHEN k % 23 = 0 THEN '-' || p ELSE p END AS nav FROM o),
r AS (SELECT * FROM r1 UNION ALL SELECT line + 1, k, scheme_code, d, CASE WHEN k % 3 = 0 THEN '1.00' ELSE nav END FROM r1 WHERE k % 7 = 0),
v AS (SELECT line, CASE WHEN k % 31 = 0 THEN '-bad code-' ELSE scheme_code END AS scheme_code, d AS date, CAST(nav AS DOUBLE) AS nav,
  CASE WHEN k % 31 = 0 THEN 'scheme_code: not a valid code' WHEN d IS NULL THEN 'date: not a date' WHEN d > DATE '2001-06-30' THEN 'date: is in the future'
       WHEN nav IS NULL THEN 'nav: value is missing' WHEN CAST(nav AS DOUBLE) <= 0 THEN 'nav: must be positive' END AS reason FROM r),
g AS (SELECT scheme_code, date, min(line) AS first, arg_min(nav, line) AS first_nav, min(nav) <> max(nav) AS differs FROM v WHERE reason IS NULL GROUP BY ALL),
x AS (SELECT v.line, v.scheme_code, v.date, coalesce(v.reason, CASE WHEN v.line > g.first AND v.nav = g.first_nav THEN 'duplicate of line ' || g.first
        WHEN v.line > g.first THEN 'conflicts with line ' || g.first WHEN g.differs THEN 'conflicting duplicate key' END) AS reason
      FROM v LEFT JOIN g ON v.reason IS NULL AND v.scheme_code = g.scheme_code AND v.date = g.date)"""

_VERSIONS = """
a AS (SELECT o_orderkey AS key, o_totalprice AS value FROM orders WHERE o_orderkey % 3 <> 0),
b AS (SELECT o_orderkey AS key, CASE WHEN o_orderkey % 10 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS value FROM orders WHERE o_orderkey % 2 = 0)"""


def oracle_sql() -> dict[str, str]:
    return {
        "csv_validate": f"WITH {_RAW} SELECT line, scheme_code, date, nav, reason FROM v",
        "csv_dedup_conflict": f"WITH {_RAW} SELECT line, scheme_code, date, reason FROM x",
        "import_counts": f"WITH {_RAW} SELECT count(*) AS rows_total, count(*) FILTER (reason IS NULL) AS rows_accepted, count(*) FILTER (reason IS NOT NULL) AS rows_rejected FROM x",
        "import_ledger": f"""WITH {_RAW}, b AS (SELECT line, reason FROM x WHERE reason IS NOT NULL ORDER BY line LIMIT 500)
            SELECT 'batch-1' AS batch_id, 'nav' AS kind, (SELECT count(*) FROM x) AS rows_total, (SELECT count(*) FROM x WHERE reason IS NOT NULL) AS rows_rejected, (SELECT string_agg(line || ' ' || left(reason, 120), '|' ORDER BY line) FROM b) AS rejected""",
        "portfolio_import": """WITH t AS (SELECT l_orderkey AS p, l_linenumber AS line, l_suppkey, CAST(l_quantity AS DOUBLE) AS q, sum(CAST(l_quantity AS DOUBLE)) OVER (PARTITION BY l_orderkey) AS total FROM lineitem),
            r AS (SELECT p, line, CASE WHEN p % 5 = 0 AND line = 2 AND p % 2 = 0 THEN 'FS-none' ELSE 'FS-' || l_suppkey END AS code, CASE WHEN p % 5 = 0 AND line = 2 AND p % 2 = 1 THEN NULL ELSE round(100 * q / total, 6) END AS w FROM t),
            f AS (SELECT *, min(line) OVER (PARTITION BY p, code) AS first, EXISTS (SELECT 1 FROM supplier WHERE code = 'FS-' || s_suppkey) AS known FROM r),
            y AS (SELECT *, CASE WHEN NOT known THEN 'unknown code ' || code WHEN line > first THEN 'repeats line ' || first WHEN w IS NULL OR w < 0 OR w > 100 THEN 'not a weight from 0 to 100' END AS why FROM f)
            SELECT p AS portfolio_id, count(*) AS n_rows, CASE WHEN count(why) = 0 THEN CASE WHEN abs(coalesce(sum(CAST(w AS DECIMAL(18, 6))), 0) - 100) > 0.01 THEN 'weights don''t add up to 100' ELSE '' END
                   ELSE string_agg('line ' || line || ': ' || why, '|' ORDER BY line, why) FILTER (why IS NOT NULL) END AS problems FROM y GROUP BY p""",
        "csv_kinds": """WITH x AS (
            SELECT 'benchmarks' AS kind, CASE WHEN p_partkey % 7 = 0 THEN 'benchmark_code: not a valid code' WHEN p_partkey % 11 = 0 THEN 'name: value is missing' WHEN p_partkey % 5 = 0 THEN 'return_basis: must be one of price, total_return' END AS reason FROM part
            UNION ALL SELECT 'benchmark_values', CASE WHEN o_orderkey % 7 = 0 THEN 'date: not a date' WHEN o_orderdate > DATE '2001-06-30' THEN 'date: is in the future' WHEN o_orderkey % 5 = 0 THEN 'value: must be positive' END FROM orders
            UNION ALL SELECT 'funds', CASE WHEN s_suppkey % 7 = 0 THEN 'category: longer than 80 characters' WHEN s_suppkey % 5 = 0 THEN 'asset_class: must be one of equity, debt, hybrid, other' WHEN s_suppkey % 3 = 0 THEN 'launch_date: not a date' WHEN s_suppkey % 4 = 0 THEN 'expense_ratio_pct: must lie between 0 and 100' END FROM supplier
            UNION ALL SELECT 'nav', CASE WHEN o_orderdate > DATE '2001-06-30' THEN 'date: is in the future' WHEN o_orderkey % 5 = 0 THEN 'nav: not a number' WHEN o_orderkey % 7 = 0 THEN 'nav: must be positive' END FROM orders
            UNION ALL SELECT 'aum', CASE WHEN c_custkey % 3 = 0 THEN 'aum_crore: must not be negative' END FROM customer
            UNION ALL SELECT 'sip_flows', CASE WHEN c_custkey % 8 >= 6 THEN 'sip_accounts: must be a whole number' END FROM customer
            UNION ALL SELECT 'holdings', CASE WHEN date_trunc('month', l_shipdate) > DATE '2001-06-30' THEN 'as_of_date: is in the future' END FROM lineitem)
            SELECT kind, reason, count(*) AS n FROM x GROUP BY ALL""",
        "holdings_import": """WITH g AS (SELECT 'FS-' || l_suppkey AS scheme_code, CAST(date_trunc('month', l_shipdate) AS DATE) AS as_of_date, count(*) AS n_rows, CAST(sum(CAST(l_quantity AS INTEGER)) AS BIGINT) AS t FROM lineitem GROUP BY ALL),
            f AS (SELECT *, as_of_date > DATE '2001-06-30' AS late, t > 100.5 AS over FROM g)
            SELECT scheme_code, as_of_date, n_rows, CASE WHEN late OR over THEN n_rows ELSE 0 END AS n_refused,
                   CASE WHEN late THEN 'as_of_date: is in the future' WHEN over THEN 'holdings for ' || scheme_code || ' on ' || as_of_date || ' sum to ' || t || '% (> 100%)' END AS reason,
                   CASE WHEN NOT late AND t < 95 THEN scheme_code || ' holdings on ' || as_of_date || ' sum to ' || t || '% (less than 95%); the remainder is not described.' END AS warning FROM f""",
        "price_faults": f"""WITH {LEVELS_SQL}, h AS (SELECT series_id, obs_date, CASE WHEN dayofyear(obs_date) % 50 = 0 THEN NULL WHEN dayofyear(obs_date) % 70 = 0 THEN 0.0::DOUBLE ELSE level END AS level FROM nav), a AS (SELECT * FROM h UNION ALL SELECT * FROM h WHERE dayofyear(obs_date) % 90 = 0)
            SELECT * FROM (SELECT series_id, obs_date, CASE WHEN count(*) > 1 THEN 'duplicate date' WHEN count(level) = 0 THEN 'missing value' WHEN min(level) <= 0 THEN 'non-positive level' END AS reason FROM a GROUP BY ALL) WHERE reason IS NOT NULL""",
        "upsert_diff": f"WITH {_VERSIONS} SELECT b.key, round(b.value, 2) AS value, CASE WHEN a.key IS NULL THEN 'inserted' WHEN a.value = b.value THEN 'unchanged' ELSE 'updated' END AS change FROM b LEFT JOIN a USING (key)",
        "upsert_result": f"WITH {_VERSIONS} SELECT coalesce(b.key, a.key) AS key, round(coalesce(b.value, a.value), 2) AS value FROM a FULL JOIN b ON a.key = b.key",
        "snapshot_diff": "SELECT l_orderkey, CASE WHEN l_orderkey % 7 = 0 THEN 'new' WHEN l_orderkey % 5 <> 0 OR min(l_linenumber) > 1 THEN 'same' WHEN max(l_linenumber) = 1 THEN 'new' ELSE 'replace' END AS verdict FROM lineitem GROUP BY l_orderkey",
        "unknown_code_anti": "SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_custkey % 9 <> 0)",
        "key_semi": "SELECT l_orderkey, l_linenumber FROM lineitem l WHERE EXISTS (SELECT 1 FROM lineitem k WHERE k.l_quantity >= 49 AND k.l_partkey = l.l_partkey AND k.l_suppkey = l.l_suppkey)",
        "nav_file_parse": """SELECT CAST(o_orderkey % 500 AS VARCHAR) AS code, CAST(o_orderdate AS DATE) AS nav_date, 'Scheme ' || (o_orderkey % 500) AS name, round(arg_max(CAST(printf('%.4f', o_totalprice) AS DOUBLE), o_orderkey), 4) AS nav
            FROM orders WHERE o_orderkey % 37 <> 0 AND o_orderkey % 41 <> 0 GROUP BY ALL""",
    }
