"""CSV imports of seven kinds: typed columns, a reason for each rejected row, and keys.

Rows are read as text and checked by column expressions, so a file of any size
is validated where its rows lie. Only the search for repeated keys shuffles.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fundloom.conventions import require

#: Date formats that are understood, the first that fits counts.
DATE_FORMATS = ("yyyy-M-d", "d-M-yyyy", "d/M/yyyy", "d-MMM-yyyy", "d MMM yyyy")
CODE = r"^[A-Za-z0-9][\w\-./]{0,39}$"


@dataclass(frozen=True)
class Field:
    name: str
    kind: str  # code, text, date, month, positive, non_negative, percent, whole, choice
    required: bool = True
    size: int = 0
    choices: tuple[str, ...] = ()


@dataclass(frozen=True)
class Kind:
    fields: tuple[Field, ...]
    key: tuple[str, ...]


_CODE = Field("scheme_code", "code")
#: The columns and keys of the kinds.
KINDS = {
    "benchmarks": Kind((Field("benchmark_code", "code"), Field("name", "text", size=160), Field("return_basis", "choice", choices=("price", "total_return"))), ("benchmark_code",)),
    "benchmark_values": Kind((Field("benchmark_code", "code"), Field("date", "date"), Field("value", "positive")), ("benchmark_code", "date")),
    "funds": Kind((_CODE, Field("name", "text", size=200), Field("category", "text", size=80), Field("asset_class", "choice", choices=("equity", "debt", "hybrid", "other")), Field("amc", "text", False, 120), Field("plan", "text", False, 16), Field("option", "text", False, 16), Field("benchmark_code", "code", False), Field("launch_date", "date", False), Field("expense_ratio_pct", "percent", False), Field("risk_label", "text", False, 40)), ("scheme_code",)),
    "nav": Kind((_CODE, Field("date", "date"), Field("nav", "positive")), ("scheme_code", "date")),
    "aum": Kind((_CODE, Field("as_of_date", "date"), Field("aum_crore", "non_negative")), ("scheme_code", "as_of_date")),
    "sip_flows": Kind((_CODE, Field("month", "month"), Field("sip_inflow_crore", "non_negative"), Field("sip_accounts", "whole", False)), ("scheme_code", "month")),
    "holdings": Kind((_CODE, Field("as_of_date", "date"), Field("holding_name", "text", size=160), Field("sector", "text", size=80), Field("asset_type", "text", size=40), Field("weight_pct", "percent")), ("scheme_code", "as_of_date", "holding_name")),
}


def header_name(name: str) -> str:
    """A header in lower case, with one underscore for what isn't a letter or digit."""
    out = "".join(c if c.isascii() and c.isalnum() else " " for c in name.strip().lower())
    return "_".join(out.split())


def clean_number(text: Column) -> Column:
    """A decimal from text with thousands commas, rupee signs or a percent sign."""
    plain = F.regexp_replace(F.trim(text), r"(?i)^(₹|rs\.?)\s*|,|%|\s", "")
    return plain.try_cast("decimal(18,6)")


#: What a text of each format begins like; a format is only tried where it can fit, as each failure costs an exception.
DATE_SHAPES = (r"^[+-]?\d+-\d{1,2}-\d", r"^\d{1,2}-\d{1,2}-", r"^\d{1,2}/", r"^\d{1,2}-\D", r"^\d{1,2} ")


def parsed_date(text: Column) -> Column:
    plain = F.trim(text)
    return F.coalesce(*(F.when(plain.rlike(shape), F.try_to_date(plain, f)) for f, shape in zip(DATE_FORMATS, DATE_SHAPES, strict=True)))


def _parsed(field: Field) -> Column:
    raw = F.trim(F.coalesce(F.col(field.name), F.lit("")))
    return parsed_date(raw) if field.kind in ("date", "month") else F.lit(None) if field.kind in ("code", "text", "choice") else clean_number(raw)


def _checked(field: Field, today: Column) -> tuple[Column, Column]:
    """(value, why it is refused) of a raw column that ``_parsed`` stands beside; a blank optional value is null."""
    raw = F.trim(F.coalesce(F.col(field.name), F.lit("")))
    number = day = F.col(f"_{field.name}")
    if field.kind in ("date", "month"):
        value = F.trunc(day, "MM") if field.kind == "month" else day
        bad = F.when(day.isNull(), "not a date").when(value > today, "is in the future")
    elif field.kind == "code":
        value, bad = raw, F.when(~raw.rlike(CODE), "not a valid code")
    elif field.kind == "text":
        value = F.regexp_replace(raw, r"\s+", " ")
        bad = F.when(F.length(value) > field.size, f"longer than {field.size} characters")
    elif field.kind == "choice":
        value = F.lower(raw)
        bad = F.when(~value.isin(*field.choices), f"must be one of {', '.join(field.choices)}")
    else:
        value = number.cast("long") if field.kind == "whole" else number
        rules = {"positive": (number > 0, "must be positive"), "non_negative": (number >= 0, "must not be negative"), "percent": (number.between(0, 100), "must lie between 0 and 100"), "whole": ((number >= 0) & (number == F.floor(number)), "must be a whole number")}
        good, message = rules[field.kind]
        bad = F.when(number.isNull(), "not a number").when(~good, message)
    blank = raw == ""
    missing = F.when(blank, "value is missing") if field.required else F.when(blank, None)
    reason = F.coalesce(missing, F.when(~blank, bad))
    return F.when(~blank, value), F.when(reason.isNotNull(), F.concat(F.lit(f"{field.name}: "), reason))


def read_csv(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Raw rows with the kind's columns as text and ``line``, the number of the line in its file.

    Unknown columns are left out and a missing required one is an error.
    Numbers follow the order of bytes in a file, which is read by one task:
    rows of such imports have quoted line ends, so files aren't split.
    """
    raw = spark.read.option("header", True).option("multiLine", True).option("mode", "PERMISSIVE").option("encoding", "UTF-8").csv(path)
    names = {header_name(c.lstrip("﻿")): c for c in raw.columns}
    require(len(names) == len(raw.columns), "the header contains duplicate column names")
    wanted = KINDS[kind].fields
    missing = [f.name for f in wanted if f.required and f.name not in names]
    require(not missing, f"missing required columns: {', '.join(missing)}")
    columns = [F.col(f"`{names[f.name]}`").alias(f.name) if f.name in names else F.lit(None).cast("string").alias(f.name) for f in wanted]
    line = F.monotonically_increasing_id() % F.lit(1 << 33) + 2
    rows = raw.select(line.alias("line"), *columns)
    return rows.where(F.coalesce(*(F.nullif(F.trim(f.name), F.lit("")) for f in wanted)).isNotNull())


def validated(raw: DataFrame, kind: str, today: Column) -> DataFrame:
    """``line``, the typed columns and ``reason``, the first field's reason for refusal (null for good rows).

    A ``path``, ``raw`` texts and a ``fault`` of the whole row, which comes before its fields' reasons, may come along.
    """
    checks = {f.name: _checked(f, today) for f in KINDS[kind].fields}
    # Dates and numbers are parsed once, for the value and for all that is asked of it.
    raw = raw.select("*", *(_parsed(f).alias(f"_{f.name}") for f in KINDS[kind].fields))
    along = [c for c in ("path", "raw") if c in raw.columns]
    faults = [F.col("fault")] if "fault" in raw.columns else []
    return raw.select(*along, "line", *(v.alias(n) for n, (v, _) in checks.items()), F.coalesce(*faults, *(r for _, r in checks.values())).alias("reason"))


def resolved_keys(rows: DataFrame, kind: str) -> DataFrame:
    """Rows with ``reason`` for repeated keys: an equal repeat of the first row is a duplicate; of rows that differ none stays.

    Values of a key are compared by their hash. Keys that come more than once
    are found by an aggregate with partial results and joined back. Rows with
    a ``path`` are compared with those of their own file.
    """
    spec = KINDS[kind]
    key = [c for c in ("path",) if c in rows.columns] + list(spec.key)
    good = F.col("reason").isNull()
    hashed = rows.withColumn("h", F.xxhash64(*(f.name for f in spec.fields)))
    keys = [F.col(k).alias(f"_{k}") for k in key]
    seen = hashed.where(good).groupBy(*keys).agg(F.count("*").alias("n"), F.min("line").alias("first_line"), F.min_by("h", "line").alias("first_h"), (F.min("h") != F.max("h")).alias("differs")).where("n > 1").drop("n")
    same = good
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    marked = hashed.join(seen, same, "left")
    later = F.col("line") > F.col("first_line")
    why = F.when(later & (F.col("h") == F.col("first_h")), F.concat(F.lit("duplicate of line "), F.col("first_line")))
    why = why.when(later, F.concat(F.lit("conflicts with line "), F.col("first_line"))).when(F.col("differs"), "conflicting duplicate key")
    return marked.withColumn("reason", F.coalesce("reason", why)).select(*rows.columns)


def _holding_totals(rows: DataFrame) -> tuple[list[str], DataFrame]:
    key = [c for c in ("path", "scheme_code", "as_of_date") if c in rows.columns]
    return key, rows.where("reason IS NULL").groupBy(*key).agg(F.sum("weight_pct").alias("total"))


def _percent(total: str) -> Column:
    return F.concat(F.regexp_replace(F.col(total).cast("string"), r"\.?0+$", ""), F.lit("%"))


def refused_totals(rows: DataFrame, most: float = 100.5) -> DataFrame:
    """Resolved rows of holdings with ``reason`` where a fund's good rows of one date add up to more than ``most`` percent: none of them stays."""
    key, totals = _holding_totals(rows)
    over = totals.where(F.col("total") > F.lit(str(most)).cast("decimal(18,6)")).select(*(F.col(k).alias(f"_{k}") for k in key), "total")
    same = F.col("reason").isNull()
    for k in key:
        same = same & (F.col(k) == F.col(f"_{k}"))
    why = F.concat(F.lit("holdings for "), "scheme_code", F.lit(" on "), F.col("as_of_date").cast("string"), F.lit(" sum to "), _percent("total"), F.lit(" (> 100%)"))
    return rows.join(over, same, "left").withColumn("reason", F.coalesce("reason", F.when(F.col("total").isNotNull(), why))).select(*rows.columns)


def incomplete_totals(rows: DataFrame, least: int = 95) -> DataFrame:
    """(path where there, scheme_code, as_of_date, warning) of totals under ``least`` percent; their rows stay."""
    key, totals = _holding_totals(rows)
    text = F.concat("scheme_code", F.lit(" holdings on "), F.col("as_of_date").cast("string"), F.lit(" sum to "), _percent("total"), F.lit(f" (less than {least}%); the remainder is not described."))
    return totals.where(F.col("total") < least).select(*key, text.alias("warning"))


def import_counts(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("rows_total"), F.count_if(F.col("reason").isNull()).alias("rows_accepted"), F.count_if(F.col("reason").isNotNull()).alias("rows_rejected"))


def parse_nav_lines(lines: DataFrame) -> DataFrame:
    """(code, name, nav, nav_date) from ``lines(line, value)`` of six fields between semicolons.

    Lines that aren't a record with a positive level are skipped; of several
    for a code and date the last one counts.
    """
    f = F.split("value", ";")
    rows = lines.where(F.size(f) == 6).select("line", *(F.trim(F.get(f, F.lit(i))).alias(n) for i, n in ((0, "code"), (3, "name"), (4, "level"), (5, "day"))))
    rows = rows.select("line", "code", "name", F.col("level").try_cast("decimal(18,6)").alias("nav"), F.try_to_date("day", "dd-MMM-yyyy").alias("nav_date"))
    good = rows.where(F.col("code").rlike(r"^\d+$") & (F.col("nav") > 0) & F.col("nav_date").isNotNull())
    last = good.groupBy("code", "nav_date").agg(F.max_by(F.struct("name", "nav"), "line").alias("r"))
    return last.select("code", "nav_date", "r.name", "r.nav")


def portfolio_problems(rows: DataFrame, funds: DataFrame, most: int = 50, tolerance: float = 0.01) -> DataFrame:
    """(portfolio_id, n_rows, total_pct, problems): what keeps ``rows(portfolio_id, line, scheme_code, weight_pct)`` from being stored.

    A portfolio is stored whole or not at all: unknown codes, repeated codes,
    weights that aren't numbers from 0 to 100, and a sum other than 100 are
    problems, of which the first ``most`` are listed. Rows are dealt by
    portfolio and code, in as many parts as shuffles have, to find repeats;
    only problems are dealt by portfolio, ``most`` of each part at the most.
    """
    known = funds.select(F.col("code").alias("scheme_code"), F.lit(True).alias("known")).distinct()
    weight = F.col("weight_pct").try_cast("double")
    # By number, as parts that are put together again would be sorted together.
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.join(known, "scheme_code", "left").repartition(parts, "portfolio_id", "scheme_code")
    first = F.min("line").over(Window.partitionBy("portfolio_id", "scheme_code"))
    joined = dealt.select("portfolio_id", "line", "scheme_code", "known", weight.alias("w"), first.alias("first"))
    why = F.when(F.col("known").isNull(), F.concat(F.lit("unknown code "), F.coalesce("scheme_code", F.lit(""))))
    why = why.when(F.col("line") > F.col("first"), F.concat(F.lit("repeats line "), F.col("first"))).when(F.col("w").isNull() | (F.col("w") < 0) | (F.col("w") > 100), "not a weight from 0 to 100")
    place = F.row_number().over(Window.partitionBy("portfolio_id").orderBy("line", "why"))
    bad = joined.select("portfolio_id", "line", why.alias("why")).where("why IS NOT NULL").withColumn("place", place).where(F.col("place") <= most)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("line", "why"))), lambda x: F.concat(F.lit("line "), x["line"], F.lit(": "), x["why"]))
    lists = bad.groupBy(F.col("portfolio_id").alias("_portfolio")).agg(listed.alias("listed"))
    summed = rows.groupBy("portfolio_id").agg(F.count("*").alias("n_rows"), F.sum(weight.cast("decimal(18,6)")).cast("double").alias("total_pct"))
    off = F.abs(F.coalesce("total_pct", F.lit(0.0)) - 100) > tolerance
    problems = F.coalesce("listed", F.when(off, F.array(F.lit("weights don't add up to 100"))), F.array().cast("array<string>"))
    return summed.join(lists, F.col("portfolio_id").eqNullSafe(F.col("_portfolio")), "left").select("portfolio_id", "n_rows", "total_pct", problems.alias("problems"))
