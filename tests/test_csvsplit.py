"""Quoted CSV files read by splits, against Python's csv module, and what is refused."""

import csv
import io
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fundloom.plans import ingest
from fundloom.sources import csvkinds, csvsplit, sinks

HEADER = ["Scheme Code", "Date", "NAV", "More"]


def _write(folder, name, rows, header=HEADER):
    text = io.StringIO()
    out = csv.writer(text, lineterminator="\r\n")
    out.writerow(header)
    out.writerows(rows)
    (folder / name).write_bytes(text.getvalue().encode())
    return text.getvalue()


def _read(spark, path):
    got = csvsplit.read_csv_split(spark, f"file://{path}", "nav").select("path", "line", "raw", "fault").collect()
    return sorted((r.path.rsplit("/", 1)[1], r.line, r.raw, r.fault) for r in got)


def _loop(name, text):
    rows = csv.reader(io.StringIO(text, newline=""))
    names = [csvkinds.header_name(h) for h in next(rows)]
    out = []
    for line, row in enumerate(rows, 2):
        if any(c.strip() for c in row):
            fault = None if len(row) == len(names) else f"expected {len(names)} fields, found {len(row)}"
            out.append((name, line, dict(zip(names, row)), fault))
    return out


@pytest.mark.parametrize("split", [7, 64, 1 << 20])
def test_equals_the_csv_module_at_any_split(spark, tmp_path, split):
    draw = random.Random(split)
    want = []
    for name in ("a.csv", "b.csv"):
        pieces = ["x", "é", '"', ",", "\n", "\r\n", " ", "12.5", '""', "\n\n"]
        rows = [["".join(draw.choices(pieces, k=draw.randint(0, 5))) for _ in range(draw.choice((4, 4, 4, 3, 5)))] for _ in range(60)]
        rows += [[], ["", "", "", ""]]
        want += _loop(name, _write(tmp_path, name, rows))
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        got = _read(spark, tmp_path)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == sorted(want)


def test_files_that_are_refused(spark, tmp_path):
    head = b"scheme_code,date,nav\n"
    files = {
        "good.csv": head + b"A,2000-01-01,1\n", "open.csv": head + b'A,"2000-01-01,1\nB,2000-01-01,2\n', "nul.csv": head + b"A,2000-01-01,\x00\n", "torn.csv": head + b"A\xff,2000-01-01,1\n",
        "missing.csv": b"scheme_code,nav\nA,1\n", "twice.csv": b"scheme_code,date,nav,NAV\nA,2000-01-01,1,1\n", "blank.csv": b"\n  \n", "rows.csv": head + b"A,2000-01-01,1\n" * 4,
        "long.csv": head + b'A,2000-01-01,"' + b"1\n" * 300_000 + b'"\n',
        "bytes.csv": head + b"A,2000-01-01,1\n" + b" " * 700_000,
    }
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    found = csvsplit.file_problems(spark, f"file://{tmp_path}", "nav", most_rows=3, most_bytes=650_000).collect()
    assert {r.path.rsplit("/", 1)[1]: r.problem for r in found} == {
        "open.csv": "a quote isn't closed", "nul.csv": "the file is binary", "torn.csv": "the file isn't UTF-8", "missing.csv": "missing columns: date", "twice.csv": "a column comes twice",
        "blank.csv": "the file is empty", "rows.csv": "more than 3 rows", "long.csv": "a record is too long", "bytes.csv": "the file is too large",
    }


def test_quotes_inside_plain_fields_and_a_mark_at_the_front(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿Scheme Code,date,nav,Mood\n5\"\",2000-01-01,1,x\nA,\"2000\"-01-01,1,y\nB,2000-01-01,\"1\",z".encode())
    assert [(line, fault) for _, line, _, fault in _read(spark, tmp_path)] == [(2, "a quote inside a plain field"), (3, "a quote inside a plain field"), (4, None)]
    assert [r.warning for r in csvsplit.unknown_columns(spark, f"file://{tmp_path}", "nav").collect()] == ["Ignored unknown column(s): mood."]


def test_holdings_over_a_hundred_go_and_the_ledger_keeps_texts(spark, tmp_path):
    rows = [["F1", "2000-01-01", "a", "s", "t", "60"], ["F1", "2000-01-01", "b", "s", "t", "40.51"], ["F1", "2000-02-01", "a", "s", "t", "94.5"], ["F1", "2000-01-01", "a", "s", "t", "60"], ["F2", "2000-01-01", "a", "s", "t", "100"], ["F2", "2000-01-01", "x", "s", "t"], ["F2", "2000-01-01", "y" * 200, "s", "t", "1"]]
    _write(tmp_path, "h.csv", rows, [f.name for f in csvkinds.KINDS["holdings"].fields])
    raw = csvsplit.read_csv_split(spark, f"file://{tmp_path}", "holdings")
    found = csvkinds.refused_totals(csvkinds.resolved_keys(csvkinds.validated(raw, "holdings", F.lit("2010-01-01").cast("date")), "holdings"))
    over = "holdings for F1 on 2000-01-01 sum to 100.51% (> 100%)"
    assert {r.line: r.reason for r in found.collect()} == {2: over, 3: over, 4: None, 5: "duplicate of line 2", 6: None, 7: "expected 6 fields, found 5", 8: "holding_name: longer than 160 characters"}
    told = csvkinds.incomplete_totals(found)
    assert [r.warning for r in told.collect()] == ["F1 holdings on 2000-02-01 sum to 94.5% (less than 95%); the remainder is not described."]
    row = sinks.ledger_with_values(found, told, "b", "holdings").collect()[0]
    assert (row.rows_total, row.rows_rejected) == (7, 5)
    import json

    rejected = json.loads(row.rejected)
    assert [r["line"] for r in rejected] == [2, 3, 5, 7, 8]
    assert rejected[4]["values"]["holding_name"] == "y" * 120
    assert len(json.loads(row.warnings)) == 1


def test_whole_records_are_not_dealt_out(spark, tmp_path):
    _write(tmp_path, "a.csv", [["A", "2000-01-01", "1\n2", "x"]] * 5)
    plan = csvsplit.read_csv_split(spark, f"file://{tmp_path}", "nav")._jdf.queryExecution().optimizedPlan().toString()
    # Windows and aggregates are over blocks and parts of records, not over lines.
    assert "Window" not in plan or "quotes" not in "".join(x for x in plan.splitlines() if "Window" in x)
    assert plan.count("collect_list") and "(edge" in plan


def test_fields_are_cut_as_the_csv_module_does():
    draw = random.Random(5)
    for _ in range(300):
        rows = []
        for _ in range(draw.randint(1, 6)):
            text = io.StringIO()
            csv.writer(text, lineterminator="").writerow(["".join(draw.choices(["x", "é", '"', ",", "\n", " ", '""'], k=draw.randint(0, 4))) for _ in range(draw.randint(2, 4))])
            rows.append(text.getvalue())
        fields, odd, filled = csvsplit._cut(pa.array([(r + draw.choice(["", "\r"])).encode() for r in rows], pa.binary()))
        want = [next(csv.reader(io.StringIO(r, newline=""))) for r in rows]
        assert fields.to_pylist() == want and not odd.any()
        assert filled.tolist() == [any(c.strip() for c in r) for r in want]
    assert csvsplit._cut(pa.array([b'a,b"c",d', b'"a" ,b', b'"a,b', b"a,b"], pa.binary()))[1].tolist() == [True, True, True, False]


def test_lines_are_read_once_for_blocks_and_rows_are_checked_once(spark, tmp_path):
    _write(tmp_path, "a.csv", [["A", "2000-01-01", "1\n2", "x"]] * 5)
    blocks = csvsplit.scanned(spark, f"file://{tmp_path}")
    problems = csvsplit.file_problems(spark, f"file://{tmp_path}", "nav", blocks=blocks)
    assert problems.collect() == [] and "Relation [value" not in problems._jdf.queryExecution().optimizedPlan().toString()
    assert csvsplit.read_csv_split(spark, f"file://{tmp_path}", "nav", blocks).count() == 5
    plan = ingest.holdings_import(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan and "Relation [value" not in plan
