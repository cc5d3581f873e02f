"""Quoted CSV files read by splits: where a record ends is known in any split from the quotes that come before it.

A file is read as lines wherever Spark cuts it. One pass (``scanned``) sums up
each block for either state it may begin in: quotes, records that begin, their
sizes, and what would refuse the file; a prefix scan over blocks then gives each
block's state and the number of its first record. A second pass cuts records
into fields where their lines are read; only parts of a record that two blocks
share are dealt out, and only records with odd quotes are cut by expressions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fundloom.sources.csvkinds import KINDS
from fundloom.storage import written

#: Fixed value: characters that one field may hold.
FIELD_SIZE = 131_072
#: A field after its comma: in quotes, which are doubled inside, or plain up to the next comma.
_FIELD = r',("[^"]*+(?:""[^"]*+)*+"|[^,]*+)'


#: Bytes that are blanks in regular expressions, and those that aren't.
_BLANKS = b" \t\n\x0b\x0c\r"
_SOLID = np.array([x not in _BLANKS for x in range(256)])
#: For either state that a block may begin in: records that begin; characters of its longest whole record, of what comes before the first one, and of the last one; rows, and lines that hold something, likewise.
_SUMS = ("begun", "inner", "before", "last", "rows", "before_filled", "last_filled")
_COUNTED = "file long, block long, q long, bytes long, torn boolean, nul boolean, filled boolean, head binary, " + ", ".join(f"{c}_{s} long" for s in (0, 1) for c in _SUMS)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, value): the lines of all files, in the order in which each block's task reads them; a file is its path's hash, as paths are long."""
    raw = spark.read.option("lineSep", "\n").text(path)
    return raw.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def _files(spark: SparkSession, path: str) -> DataFrame:
    """(file, path): no file is opened for it."""
    return spark.read.format("binaryFile").load(path).select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_path").alias("path"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], pa.RecordBatch]]:
    """The stretches of one block in batches of lines, in order; a block is read by one task."""
    for batch in batches:
        if not batch.num_rows:
            continue
        file, block = batch.column("file").to_numpy(), batch.column("block").to_numpy()
        cuts = [0, *(np.flatnonzero((np.diff(file) != 0) | (np.diff(block) != 0)) + 1).tolist(), len(block)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield (int(file[a]), int(block[a])), batch.slice(a, b - a)


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, where each text begins and the last one ends) of texts or binaries without nulls."""
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    held = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return held[at[0] : at[-1]], at - at[0]


def _quotes(rows: pa.RecordBatch) -> np.ndarray:
    """Quotes of each line."""
    data, at = _bytes_of(rows.column("value"))
    return np.diff(np.searchsorted(np.flatnonzero(data == 34), at))


class _Sums:
    """Sums of one block for one state it may begin in."""

    def __init__(self, state: int, first_block: bool):
        self.state, self.header = state, first_block and not state
        self.begun = self.inner = self.before = self.last = self.rows = self.before_filled = self.last_filled = 0

    def _close(self, longest: int, rows: int) -> None:
        self.inner, self.rows = max(self.inner, longest), self.rows + rows

    def add(self, quotes_before: np.ndarray, n: np.ndarray, filled: np.ndarray) -> None:
        begins = np.flatnonzero((quotes_before + self.state) & 1 == 0)
        ends = np.append(0, np.cumsum(n)), np.append(0, np.cumsum(filled))
        lead = len(n) if not len(begins) else int(begins[0])
        if self.begun:
            self.last, self.last_filled = self.last + int(ends[0][lead]), self.last_filled + int(ends[1][lead])
        else:
            self.before, self.before_filled = self.before + int(ends[0][lead]), self.before_filled + int(ends[1][lead])
        if not len(begins):
            return
        if self.begun:
            self._close(self.last, int(self.last_filled > 0 and not (self.header and self.begun == 1)))
        if len(begins) > 1:
            size, held = np.diff(ends[0][begins]), np.diff(ends[1][begins]) > 0
            self._close(int(size.max()), int(held.sum()) - int(self.header and not self.begun and held[0]))
        self.last, self.last_filled = (int(e[-1] - e[begins[-1]]) for e in ends)
        self.begun += len(begins)


def _counted(rows: bool):
    """Over lines: the sums of each block, rows among them if asked for."""
    filled_line = re.compile(rb'[^\s,"]|"""')
    names = [c.split()[0] for c in _COUNTED.split(", ")]
    kinds = [{"long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}[c.split()[1]] for c in _COUNTED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, out, sums = None, [], []

        def told() -> pa.RecordBatch:
            values = [*key, *out, *(getattr(x, c) for x in sums for c in _SUMS)]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], names=names)

        for now, run_ in _runs(batches):
            value = run_.column("value")
            if now != key:
                if key is not None:
                    yield told()
                key, sums = now, [_Sums(s, now[1] == 0) for s in (0, 1)]
                out = [0, 0, False, False, False, value[0].as_buffer().to_pybytes() if now[1] == 0 else None]
            data, at = _bytes_of(value)
            quotes, n = _quotes(run_), np.diff(at)
            out[1] += int(at[-1]) + len(n)
            out[3] = out[3] or bool((data == 0).any())
            out[4] = out[4] or bool((data != 32).any())
            if len(data) and data.max() >= 128:
                n = n - np.diff(np.searchsorted(np.flatnonzero(data & 0xC0 == 0x80), at))
                if not out[2]:
                    try:
                        value.validate(full=True)
                    except pa.ArrowInvalid:
                        out[2] = True
            held = np.array([filled_line.search(x) is not None for x in value.cast(pa.binary()).to_pylist()], np.int64) if rows else np.zeros(len(n), np.int64)
            before = out[0] + np.cumsum(quotes) - quotes
            for x in sums:
                x.add(before, n + 1, held)
            out[0] += int(quotes.sum())
        if key is not None:
            yield told()

    return run


def scanned(spark: SparkSession, path: str, rows: bool = False) -> DataFrame:
    """(file, path, block, state, first, ...): the blocks of all files, by one pass over their lines; a row for each split of a file.

    ``state`` tells whether a block begins inside quotes, ``first`` how many
    records begin before it. ``file_problems`` and ``read_csv_split`` take
    this table, so that neither reads the lines for it again; ``rows`` are
    only counted for a limit of rows.
    """
    counted = _lines(spark, path).mapInArrow(_counted(rows), _COUNTED)
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    stated = counted.withColumn("state", F.coalesce(F.sum("q").over(earlier), F.lit(0)) % 2)
    own = stated.select("file", "block", "q", "bytes", "torn", "nul", "filled", "head", "state", *(F.when(F.col("state") == 0, F.col(f"{c}_0")).otherwise(F.col(f"{c}_1")).alias(c) for c in _SUMS))
    placed = own.withColumn("first", F.coalesce(F.sum("begun").over(earlier), F.lit(0)))
    # Lines are summed where they lie; what is left is a row for each split, so it is one small file.
    return written(placed.join(F.broadcast(_files(spark, path)), "file").coalesce(1), "blocks")


def _stated(lines: DataFrame, blocks: DataFrame) -> DataFrame:
    """Lines in their order, with the state and the first record of their block."""
    states = F.broadcast(blocks.select("file", "block", "state", "first"))
    return lines.join(states, ["file", "block"]).select("file", "block", "state", "first", "value")


def _records(batches: Iterator[pa.RecordBatch], add) -> Iterator[list]:
    """[key, line, edge, parts...] of each record, or part of one in its block (``edge``), by ``add``.

    Lines of batches are summed up by ``add(rows, starts)``, a list of one
    value for each stretch from one of ``starts`` to the next. All records
    but those at the ends of a stretch come as arrays: lines, values.
    """
    key, held, line, odd, inside = None, [], 0, 0, False
    for now, rows in _runs(batches):
        if now != key:
            if held:
                yield [key, [line], bool(odd) or inside, [held]]
            key, held, line, odd = now, [], rows.column("first")[0].as_py(), rows.column("state")[0].as_py()
            inside = bool(odd)
        quotes = _quotes(rows)
        begins = np.flatnonzero((odd + np.cumsum(quotes) - quotes) & 1 == 0)
        odd = (odd + int(quotes.sum())) & 1
        starts = begins if len(begins) and begins[0] == 0 else np.append(0, begins)
        values = add(rows, starts)
        if len(starts) > len(begins):
            held.append(values[0])
            values = values[1:]
        if len(begins):
            if held:
                yield [key, [line], inside, [held]]
                inside = False
            if len(begins) > 1:
                yield [key, line + np.arange(1, len(begins)), False, values[: len(begins) - 1]]
            held, line = [values[len(begins) - 1]], line + len(begins)
            inside = False
    if held:
        yield [key, [line], bool(odd) or inside, [held]]


def _cut(record: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(fields, odd, filled) of records: ``odd`` ones are to be cut by expressions, as they may have quotes elsewhere than around whole fields; ``filled`` ones hold more than blanks."""
    data, at = _bytes_of(record)
    starts, ends, n = at[:-1], at[1:].copy(), len(record)
    padded = np.concatenate([data, np.zeros(1, np.uint8)])
    long = ends > starts
    odd = np.zeros(n, bool)
    for back in (2, 3, 4):
        odd |= (ends - back >= starts) & (padded[np.maximum(ends - back, 0)] == 13)
    returns = np.flatnonzero(long & (padded[ends - 1] == 13))
    ends[returns] -= 1
    quote = np.flatnonzero(data == 34)
    low = np.searchsorted(quote, starts)
    count = np.searchsorted(quote, at[1:]) - low
    odd |= count & 1 == 1
    of = np.repeat(np.arange(n), count)
    opens = (np.arange(len(quote)) - low[of]) & 1 == 0
    begins = quote == starts[of]
    left, right = padded[quote - 1], padded[quote + 1]
    fits = np.where(opens, begins | (left == 44) | (left == 34), (quote == ends[of] - 1) | (right == 44) | (right == 34))
    odd[of[~fits]] = True
    comma = np.flatnonzero(data == 44)
    in_row = np.searchsorted(at[1:], comma, side="right")
    between = (np.searchsorted(quote, comma) - low[in_row]) & 1 == 0
    comma, in_row = comma[between], in_row[between]
    first, last = np.sort(np.concatenate([starts, comma + 1])), np.sort(np.concatenate([ends, comma]))
    quoted = (last - first >= 2) & (padded[first] == 34) & (padded[np.maximum(last - 1, 0)] == 34)
    gone = np.unique(np.concatenate([comma, at[1:][returns] - 1, first[quoted], last[quoted] - 1, quote[opens & ~begins & (left == 34)]]))
    keep = np.ones(len(data), bool)
    keep[gone] = False
    kept = data[keep]
    texts = np.append(first - np.searchsorted(gone, first), len(kept))
    rows = np.append(0, np.cumsum(np.bincount(in_row, minlength=n) + 1))
    fields = pa.StringArray.from_buffers(len(first), pa.py_buffer(texts.astype(np.int32).tobytes()), pa.py_buffer(kept.tobytes()))
    here = texts[rows]
    filled = (here[1:] > here[:-1]) & _SOLID[np.append(kept, 32)[np.minimum(here[:-1], len(kept))]]
    for k in np.flatnonzero(~filled & (here[1:] > here[:-1])).tolist():
        filled[k] = bool(kept[here[k] : here[k + 1]].tobytes().strip(_BLANKS))
    return pa.ListArray.from_arrays(pa.array(rows.astype(np.int32)), fields), odd, filled


_PIECES = "file long, line long, block long, record binary, edge boolean, fields array<string>"


def _texts(edges: bool):
    """Over lines: the ``edges`` of blocks, which are parts of a record that another block has more of, as texts; or all other records as fields, odd ones as texts. A header and blank records are left out."""

    def add(rows: pa.RecordBatch, starts: np.ndarray) -> pa.Array:
        ends = pa.array(np.append(starts, rows.num_rows).astype(np.int32))
        return pc.binary_join(pa.ListArray.from_arrays(ends, rows.column("value").cast(pa.binary())), b"\n")

    def add_ends(rows: pa.RecordBatch, starts: np.ndarray) -> list[pa.Scalar | None]:
        """Texts of the first and the last stretch, which alone may be edges."""
        value, cuts = rows.column("value").cast(pa.binary()), [*starts.tolist(), rows.num_rows]
        text = lambda k: pa.scalar(b"\n".join(value[cuts[k] : cuts[k + 1]].to_pylist()), pa.binary())
        return [text(k) if k in (0, len(starts) - 1) else None for k in range(len(starts))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (file, block), lines, edge, values in _records(batches, add_ends if edges else add):
            whole = not edge
            if whole == edges:
                continue
            record = values if isinstance(values, pa.Array) else pa.array([b"\n".join(v.as_py() for v in values[0])], pa.binary())
            n, line = len(record), np.asarray(lines, np.int64)
            if edges:
                fields, text, use = pa.nulls(n, pa.list_(pa.string())), record, line > 1
            else:
                fields, odd, filled = _cut(record)
                text, use = pa.nulls(n, pa.binary()), (line > 1) & (odd | filled)
                if odd.any():
                    text = pa.array([record[k].as_py() if o else None for k, o in enumerate(odd.tolist())], pa.binary())
            out = pa.RecordBatch.from_arrays([pa.array(np.full(n, file)), pa.array(line), pa.array(np.full(n, block)), text, pa.array(np.full(n, edge)), fields], names=["file", "line", "block", "record", "edge", "fields"])
            yield out if use.all() else out.filter(pa.array(use))

    return run


def _fields(record: Column) -> Column:
    """A record's fields, without their quotes."""
    found = F.regexp_extract_all(F.concat(F.lit(","), record), F.lit(_FIELD), F.lit(1))

    def inside(x: Column) -> Column:
        return F.replace(F.substring(x, F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))

    return F.transform(found, lambda x: F.when(x.rlike(r'(?s)^".*"$'), inside(x)).otherwise(x))


def _stray(record: Column) -> Column:
    """Whether a quote stands elsewhere than around a whole field."""
    plain = F.translate(record, "\u0001", " ")
    marked = F.regexp_replace(F.regexp_replace(plain, '"[^"]*+"', "\u0001"), "\u0001+", "\u0001")
    return marked.rlike("[^,]\u0001|\u0001[^,]")


def file_problems(spark: SparkSession, path: str, kind: str, most_rows: int | None = None, most_bytes: int | None = None, blocks: DataFrame | None = None) -> DataFrame:
    """(path, problem) of files that are refused whole; a file without problems has no row.

    Refused are files that are too large, not UTF-8, hold a NUL, have a quote
    that nothing closes, a record longer than all its fields may be, no
    header, a repeated or missing column, or too many rows. ``blocks`` are
    those of ``scanned``, with its rows if they have a limit.
    """
    blocks = scanned(spark, path, most_rows is not None) if blocks is None else blocks
    sizes = blocks.groupBy("file", "path").agg(F.sum("bytes").alias("bytes"), F.bool_or("torn").alias("torn"), F.bool_or("nul").alias("nul"), (F.sum("q") % 2).alias("open"), F.bool_or("filled").alias("filled"))
    early = F.when(F.col("bytes") > most_bytes, "the file is too large") if most_bytes is not None else F.when(F.lit(False), "")
    early = early.when(~F.col("filled"), "the file is empty").when(F.col("nul"), "the file is binary").when(F.col("torn"), "the file isn't UTF-8").when(F.col("open") == 1, "a quote isn't closed")
    sized = sizes.select("file", "path", early.alias("early"))
    header = _header(blocks).drop("path")
    wanted = F.array(*(F.lit(f.name) for f in KINDS[kind].fields if f.required))
    missing = F.array_sort(F.array_except(wanted, "names"))
    late = F.when(F.size(missing) > 0, F.concat(F.lit("missing columns: "), F.array_join(missing, ", "))).when(F.size(F.array_distinct("names")) < F.size("names"), "a column comes twice")
    long = _longest(blocks).join(header, "file", "left").select("file", "longest", "rows", F.coalesce(F.size("names"), F.lit(0)).alias("width"), late.alias("late"))
    over = F.when(F.col("longest") > F.greatest("width", F.lit(1)) * (FIELD_SIZE + 3), "a record is too long")
    many = F.when(F.col("rows") > most_rows, F.concat(F.lit("more than "), F.lit(most_rows), F.lit(" rows"))) if most_rows is not None else F.lit(None)
    problem = F.coalesce("early", over, "late", many)
    return sized.join(long, "file", "left").select("path", problem.alias("problem")).where("problem IS NOT NULL")


def _longest(blocks: DataFrame) -> DataFrame:
    """(file, longest, rows): characters of a file's longest record and its rows below the header, by the sums of its blocks alone."""
    ends = F.array(F.struct(F.col("first").alias("line"), F.col("before").alias("n"), F.col("before_filled").alias("held")), F.struct((F.col("first") + F.col("begun")).alias("line"), F.col("last").alias("n"), F.col("last_filled").alias("held")))
    shared = blocks.select("file", F.explode(ends).alias("e")).groupBy("file", "e.line").agg(F.sum("e.n").alias("n"), F.sum("e.held").alias("held"))
    by_file = shared.groupBy("file").agg(F.max("n").alias("n"), F.count_if((F.col("line") > 1) & (F.col("held") > 0)).alias("more"))
    inner = blocks.groupBy("file").agg(F.max("inner").alias("inner"), F.sum("rows").alias("rows"))
    return inner.join(by_file, "file").select("file", F.greatest("inner", "n").alias("longest"), (F.col("rows") + F.col("more")).alias("rows"))


def _header(blocks: DataFrame) -> DataFrame:
    """(file, path, names): the normalised names of each file's first line. A header is one line."""
    first = blocks.where("block = 0").select("file", "path", F.col("head").cast("string").alias("head"))
    text = F.regexp_replace(F.regexp_replace("head", "^﻿", ""), "\r$", "")

    def name(x: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(F.lower(F.trim(x)), "[^a-z0-9]+", "_"), "^_|_$", "")

    return first.select("file", "path", F.transform(_fields(text), name).alias("names"))


def read_csv_split(spark: SparkSession, path: str, kind: str, blocks: DataFrame | None = None) -> DataFrame:
    """(path, line, the kind's columns as text, raw, fault) of the rows of one file or of all files of a folder.

    ``line`` counts a file's records, its header being 1; blank records count
    but give no row. ``raw`` maps header names to texts, for the ledger.
    ``fault`` tells of rows with too few or too many fields, or a quote inside
    a plain field. Unknown columns are in ``raw`` only. Files that
    ``file_problems`` tells of are to be left out by the caller. ``blocks`` are
    those of ``scanned``.
    """
    blocks = scanned(spark, path) if blocks is None else blocks
    lines = _stated(_lines(spark, path), blocks)
    # Records that lie in one block stay where they are read; only parts at the ends of blocks are dealt out.
    parts = F.array_sort(F.collect_list(F.struct("block", F.col("record").cast("string").alias("record")))).alias("parts")
    cut = lines.mapInArrow(_texts(True), _PIECES).where("edge").groupBy("file", "line").agg(parts).select("file", "line", F.array_join(F.transform("parts", lambda p: p["record"]), "\n").alias("record"), F.lit(None).cast("array<string>").alias("fields"))
    rows = lines.mapInArrow(_texts(False), _PIECES).select("file", "line", F.col("record").cast("string").alias("record"), "fields").unionByName(cut).withColumn("record", F.regexp_replace("record", "\r$", ""))
    record = F.col("record")
    fields = F.when(record.isNotNull(), _fields(record)).otherwise(F.col("fields"))
    split = rows.select("file", "line", fields.alias("fields"), F.when(record.isNotNull(), _stray(record)).otherwise(False).alias("stray"), record.isNull().alias("even"))
    split = split.where(F.col("even") | F.exists("fields", lambda x: x.rlike(r"\S")))
    columns = [f.name for f in KINDS[kind].fields]
    header = _header(blocks).select("file", "path", "names", *(F.nullif(F.array_position("names", c), F.lit(0)).cast("int").alias(f"_{c}") for c in columns))
    named = split.join(F.broadcast(header), "file")
    n, width = F.size("fields"), F.size("names")
    fault = F.when(F.col("stray"), "a quote inside a plain field").when(n != width, F.concat(F.lit("expected "), width, F.lit(" fields, found "), n))
    shared = F.least(n, width)
    raw = F.map_from_arrays(F.slice("names", 1, shared), F.slice("fields", 1, shared))
    return named.select("path", "line", *(F.get("fields", F.col(f"_{c}") - 1).alias(c) for c in columns), raw.alias("raw"), fault.alias("fault"))


def unknown_columns(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(path, warning) of files with columns that the kind doesn't know."""
    known = F.array(*(F.lit(f.name) for f in KINDS[kind].fields))
    more = F.filter("names", lambda x: ~F.array_contains(known, x))
    return _header(scanned(spark, path)).where(F.size(more) > 0).select("path", F.concat(F.lit("Ignored unknown column(s): "), F.array_join(more, ", "), F.lit(".")).alias("warning"))
