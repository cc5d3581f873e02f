"""WARC archives: a writer with deduplicating revisits and a salvage reader.

The writer makes each record a gzip member, or leaves it plain, and lets
Spark's text sink write them. What separates values there is an empty member,
or the two empty lines that end a record. So archives are written by any number
of tasks to any store that Spark can write to.

The reader lets Spark's text reader cut archives where a member or a version
line may begin, so an archive of any size is read by many tasks, one piece in
memory at a time. A piece that is whole gives its records. One that fails a
check (no version line, bad header, wrong length, damaged member, wrong digest)
stays open: it may be damaged, or be part of a member whose bytes look like a
beginning somewhere. Open pieces that touch are joined, and the salvage loop
searches them for the next version line or member that can be read, goes on
there, and logs the bytes between as quarantined gaps. A prefix scan over the
splits' sizes gives the places of records and gaps.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fundloom.llm.shared import fresh_folder, materialise, rows_of

CRLF = "\r\n"
VERSION = "WARC/1.0"
END = b"\r\n\r\n"
#: Payloads of fewer bytes are written out each time.
LEAST_DEDUP = 1000
START = re.compile(rb"WARC/(?:0\.1[78]|1\.[01])\r\n")
MEMBER = re.compile(rb"\x1f\x8b\x08[\x00-\x1f]")
EITHER = re.compile(START.pattern + b"|" + MEMBER.pattern)
#: What pieces of an archive begin with: gzip members, or records.
MAGIC, VERSIONS = b"\x1f\x8b\x08", b"WARC/"
COLUMNS = "kind string, record_type string, record_id string, target_uri string, refers_to string, digest string, payload_bytes long, payload_sha1 string, payload binary, reason string, gap_bytes long"
SCANNED = f"path string, split long, place long, length long, {COLUMNS}"
SCHEMA = f"path string, offset long, {COLUMNS}"
KINDS = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}


def with_revisits(pages: DataFrame, least: int = LEAST_DEDUP) -> DataFrame:
    """Pages as (page_id, url, payload, payload_bytes, digest, record_type, refers_to).

    Of pages with equal payloads of at least ``least`` bytes, the one with the
    largest page_id is the response and the others refer to it. The largest ids
    are an aggregate with partial sums, and the join is on digests that occur
    more than once, which Spark may split, so a payload that very many pages
    share holds up no task. Null html is an empty payload. Rows with the
    largest page_id of their group are all responses, as are rows with a null
    page_id where their group has no other ids.
    """
    plain = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string").cast("binary"), F.lit(b"")).alias("payload"))
    plain = plain.withColumn("payload_bytes", F.length("payload").cast("long")).withColumn("digest", F.sha1("payload"))
    same = plain.where(F.col("payload_bytes") >= least).groupBy("digest", "payload_bytes").agg(F.max("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    joined = plain.join(same, ["digest", "payload_bytes"], "left")
    again = F.coalesce(~F.col("page_id").eqNullSafe(F.col("first")) & F.col("first").isNotNull(), F.lit(False))
    return joined.select("page_id", "url", "payload", "payload_bytes", "digest", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first")).alias("refers_to"))


def record_text(urn: str = "urn:page:") -> F.Column:
    """A record, without its last two line ends, from the columns of ``with_revisits``."""
    block = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))

    def line(name, value):
        return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(CRLF)), F.lit(""))

    def named(c):
        return F.concat(F.lit(f"<{urn}"), c.cast("string"), F.lit(">"))

    url = F.regexp_replace(F.col("url"), r"[\r\n]", "%0A")
    head = F.concat(
        F.lit(VERSION + CRLF),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", named(F.col("page_id"))),
        line("WARC-Target-URI", url),
        line("WARC-Refers-To", named(F.col("refers_to"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("WARC-Payload-Length", F.col("payload_bytes")),
        line("Content-Length", F.length(block)),
        F.lit(CRLF),
    )
    return F.concat(head.cast("binary"), block)


def zipped(data: bytes) -> bytes:
    """The data as one gzip member, the same for the same data."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _zip_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for (record,) in rows_of(batches, "record"):
        yield pa.RecordBatch.from_arrays([pa.array([zipped(record + END)], pa.binary())], names=["member"])


def write_archives(records: DataFrame, folder: str, compress: bool = True) -> None:
    """Write the records of ``with_revisits`` as WARC files, one for each partition.

    Compressed archives hold one gzip member for each record, with an empty
    member after it, which adds nothing to what the archive unpacks to.
    """
    text = records.select(record_text().alias("record"))
    if compress:
        text = text.mapInArrow(_zip_records, "member binary").select(F.col("member").cast("string").alias("value"))
        writer = text.write.option("lineSep", zipped(b"").decode("latin-1")).option("encoding", "ISO-8859-1")
    else:
        writer = text.select(F.col("record").cast("string").alias("value")).write.option("lineSep", END.decode())
    writer.text(folder)


@dataclass
class Salvaged:
    """A record (kind "record") or a quarantined gap (kind "gap") of an archive."""

    offset: int
    kind: str
    headers: dict[str, str]
    payload: bytes = b""
    reason: str = ""
    length: int = 0


def _headers(data: bytes, at: int) -> tuple[dict[str, str], int] | None:
    """Header fields after a version line, and where the block starts."""
    end = data.find(END, at)
    if end < 0:
        return None
    found: dict[str, str] = {}
    last = ""
    for line in data[at:end].split(b"\r\n")[1:]:
        if line[:1] in (b" ", b"\t") and last:
            found[last] += " " + line.strip().decode("utf-8", "replace")
            continue
        name, colon, value = line.partition(b":")
        if not colon or not re.fullmatch(rb"[!#-'*+\-.0-9A-Z^-z|~]+", name):
            return None
        last = name.decode().lower()
        found[last] = value.strip().decode("utf-8", "replace")
    return found, end + 4


def _has_digest(block: bytes, stated: str, fields: dict[str, str]) -> bool:
    """Whether a SHA-1, in hex or base32, is that of the block, or of its body where the block is an HTTP message."""
    parts = [block]
    if fields.get("content-type", "").lower().startswith("application/http"):
        parts.append(block.partition(b"\r\n\r\n")[2])
    for part in parts:
        own = hashlib.sha1(part).digest()
        if stated.lower() == own.hex() or stated.upper() == base64.b32encode(own).decode():
            return True
    return False


def _record(data: bytes, at: int) -> tuple[dict[str, str], bytes, int] | str:
    """(headers, payload, end) of the record at ``at``, or why there is none."""
    if not START.match(data, at):
        return "no version line"
    head = _headers(data, at)
    if head is None:
        return "bad header"
    fields, start = head
    size = fields.get("content-length", "")
    if not re.fullmatch(r"[0-9]{1,18}", size):
        return "bad length"
    end = start + int(size)
    if data[end : end + 4] != END:
        return "wrong length"
    payload = data[start:end]
    digest = fields.get("warc-payload-digest", "")
    if fields.get("warc-type") == "response" and digest.startswith("sha1:") and not _has_digest(payload, digest[5:], fields):
        return "wrong digest"
    return fields, payload, end + 4


def _member(data: bytes, at: int) -> tuple[bytes, int] | None:
    """The content of the gzip member at ``at`` and its end, if it is whole."""
    unzip, out = zlib.decompressobj(31), []
    while at < len(data) and not unzip.eof:
        try:
            out.append(unzip.decompress(data[at : at + 65_536]))
        except zlib.error:
            return None
        at = min(len(data), at + 65_536)
    return (b"".join(out), at - len(unzip.unused_data)) if unzip.eof else None


def _unpacked(content: bytes, at: int, length: int) -> list[Salvaged] | str:
    """What the unpacked content of a gzip member holds, or why it is no record; all of it is at the member's place."""
    if not content:
        return []
    whole = _record(content, 0)
    if not isinstance(whole, str) and whole[2] == len(content):
        return [Salvaged(at, "record", whole[0], whole[1], length=length)]
    found = list(salvage(content))
    if not any(s.kind == "record" for s in found):
        return whole if isinstance(whole, str) else "bytes after the record of a member"
    for s in found:
        s.offset = at
    return found


def salvage(data: bytes) -> Iterator[Salvaged]:
    """Records and gaps of an archive, in order; with members that hold nothing they cover all its bytes.

    A member with several records gives each of them at its own place; gaps
    inside it count its unpacked bytes.
    """
    at, gap, reason = 0, None, ""
    while at < len(data):
        found: list[Salvaged] | str
        end = at
        if MEMBER.match(data, at):
            member = _member(data, at)
            found = _unpacked(member[0], at, member[1] - at) if member else "damaged member"
            end = member[1] if member else at
        else:
            got = _record(data, at)
            found = got if isinstance(got, str) else [Salvaged(at, "record", got[0], got[1], length=got[2] - at)]
            end = at if isinstance(got, str) else got[2]
        if not isinstance(found, str):
            if gap is not None:
                yield Salvaged(gap, "gap", {}, reason=reason, length=at - gap)
                gap = None
            yield from found
            at = end
            continue
        if gap is None:
            gap, reason = at, found
        after = EITHER.search(data, at + 1)
        at = after.start() if after else len(data)
    if gap is not None:
        yield Salvaged(gap, "gap", {}, reason=reason, length=len(data) - gap)


def _piece(data: bytes) -> list[Salvaged]:
    """What a piece that begins like a member or a record holds; all of it open if it doesn't begin with a whole one."""
    if not data:
        return []
    if MEMBER.match(data):
        member = _member(data, 0)
        end = member[1] if member else 0
        found = _unpacked(member[0], 0, end) if member else "damaged member"
    else:
        got = _record(data, 0)
        end = 0 if isinstance(got, str) else got[2]
        found = got if isinstance(got, str) else [Salvaged(0, "record", got[0], got[1], length=end)]
    if isinstance(found, str):
        return [Salvaged(0, "open", {}, data, found, len(data))]
    rest = data[end:]
    return found + ([Salvaged(end, "gap", {}, reason="bytes behind a record", length=len(rest))] if rest else [])


def _row(s: Salvaged, payloads: bool) -> tuple:
    h, record = s.headers, s.kind == "record"
    full = h.get("warc-payload-length", "")
    size = (int(full) if full.isdigit() and h.get("warc-type") != "response" else len(s.payload)) if record else None
    return (
        s.kind,
        h.get("warc-type"),
        h.get("warc-record-id", "").strip("<>") or None,
        h.get("warc-target-uri"),
        h.get("warc-refers-to", "").strip("<>") or None,
        h.get("warc-payload-digest"),
        size,
        hashlib.sha1(s.payload).hexdigest() if record else None,
        s.payload if s.kind == "open" or record and payloads else None,
        s.reason or None,
        None if record else s.length,
    )


def _batches(rows: Iterator[tuple], schema: str) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of some MB of payload; a row's payload is its third value from the end."""
    fields = [f.split() for f in schema.split(", ")]

    def made(held: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, KINDS[k]) for c, (_, k) in zip(zip(*held, strict=True), fields, strict=True)], names=[n for n, _ in fields])

    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-3] or b"") + 200
        if size > 8 << 20:
            yield made(held)
            held, size = [], 0
    if held:
        yield made(held)


def _scan(cut: bytes, payloads: bool):
    none = (None,) * 11

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        now, place = None, 0
        for path, split, data in rows_of(batches, "path", "split", "data"):
            fresh = (path, split) != now
            if fresh:
                if now is not None:
                    yield (*now, place, 0, "split", *none[1:])
                now, place = (path, split), 0
            # The first piece of a file has nothing before it; all others were cut off behind ``cut``.
            piece = data if fresh and split == 0 else cut + data
            for s in _piece(piece):
                yield (path, split, place + s.offset, s.length, *_row(s, payloads))
            place += len(piece)
        if now is not None:
            yield (*now, place, 0, "split", *none[1:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(rows(batches), SCANNED)

    return run


def _chains(payloads: bool):
    """Over rows (path, offset, pieces): the records and gaps of pieces that touch."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for path, offset, pieces in rows_of(batches, "path", "offset", "pieces"):
            for s in salvage(b"".join(pieces)):
                yield (path, offset + s.offset, *_row(s, payloads))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(rows(batches), SCHEMA)

    return run


def read_archives(spark: SparkSession, folder: str, compress: bool = True, payloads: bool = True) -> DataFrame:
    """Records (kind "record") and quarantined gaps (kind "gap") of all archives in ``folder``.

    ``compress`` says whether archives consist of gzip members. They may be of
    any size; a task holds a piece, and where pieces are damaged those that
    touch. Records of one member share its offset. Gaps carry a reason and
    their length, records the SHA-1 and, with ``payloads``, the bytes of their
    payload; an empty archive gives nothing. Files named ``.gz`` would be
    unpacked by Spark's reader, damaged ones with an error; give them another
    name, or no ``compress``.
    """
    cut = MAGIC if compress else VERSIONS
    lines = spark.read.option("lineSep", cut.decode("latin-1")).option("encoding", "ISO-8859-1").text(folder)
    pieces = lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"), F.col("value").cast("binary").alias("data"))
    scanned = materialise(pieces.mapInArrow(_scan(cut, payloads), SCANNED), "warc-scan")
    columns = [c.split()[0] for c in COLUMNS.split(", ")]
    before = Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = scanned.where("kind = 'split'").select(F.col("path").alias("p"), F.col("split").alias("s"), F.coalesce(F.sum("place").over(before), F.lit(0)).alias("base"))
    placed = scanned.where("kind <> 'split'").join(splits, (F.col("path") == F.col("p")) & (F.col("split") == F.col("s"))).withColumn("offset", F.col("base") + F.col("place"))
    whole = placed.where("kind <> 'open'").select("path", "offset", *columns)
    return whole.unionByName(_resolved(placed.where("kind = 'open'"), payloads))


def _resolved(opened: DataFrame, payloads: bool) -> DataFrame:
    along = Window.partitionBy("path").orderBy("offset")
    apart = F.when(F.lag(F.col("offset") + F.col("length")).over(along) == F.col("offset"), 0).otherwise(1)
    chains = opened.select("path", "offset", "length", "payload").withColumn("apart", apart).withColumn("chain", F.sum("apart").over(along))
    pieces = F.transform(F.array_sort(F.collect_list(F.struct("offset", "payload"))), lambda x: x["payload"])
    joined = chains.groupBy("path", "chain").agg(F.min("offset").alias("offset"), pieces.alias("pieces")).select("path", "offset", "pieces")
    return joined.mapInArrow(_chains(payloads), SCHEMA)


def archive_round_trip(pages: DataFrame, least: int = LEAST_DEDUP) -> DataFrame:
    """Write ``pages(page_id, url, html)`` as archives, read them back, and return one row for each page.

    Columns: page_id, payload_bytes, payload_digest, record_type, refers_to,
    of what the archives hold; for a response, size and digest are those of
    the bytes read back. A quarantined gap is an error here, as the archives
    are new. Null html is an empty payload, a null page_id or url a record
    without that line, repeated rows are records of their own, an empty table
    gives no rows, other columns are ignored.
    """
    spark = pages.sparkSession
    folder = fresh_folder(spark, "warc")
    write_archives(with_revisits(pages, least), folder)
    return measured(read_archives(spark, folder, payloads=False))


def measured(found: DataFrame) -> DataFrame:
    """The result of ``archive_round_trip`` from what ``read_archives`` found."""
    whole = F.col("record_type") == "response"
    damage = F.raise_error(F.concat(F.lit("a gap of "), F.col("gap_bytes").cast("string"), F.lit(" bytes in "), F.col("path"), F.lit(": "), F.coalesce("reason", F.lit(""))))
    kind = F.when(F.col("kind") == "record", F.col("record_type")).otherwise(damage.cast("string"))
    return found.select(
        F.regexp_extract("record_id", r"^urn:page:(-?\d+)$", 1).try_cast("long").alias("page_id"),
        "payload_bytes",
        F.when(whole, F.col("payload_sha1")).otherwise(F.regexp_replace("digest", "^sha1:", "")).alias("payload_digest"),
        kind.alias("record_type"),
        F.regexp_extract("refers_to", r"^urn:page:(-?\d+)$", 1).try_cast("long").alias("refers_to"),
    )
