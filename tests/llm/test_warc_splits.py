"""The salvage reader over archives that Spark reads in many splits, with false beginnings and damage."""

import base64
import hashlib
import random

from fundloom.llm import warc


def record(i, payload, digest=None, extra=b""):
    head = [b"WARC/1.0", b"WARC-Type: response", b"WARC-Record-ID: <urn:page:%d>" % i]
    if digest:
        head.append(b"WARC-Payload-Digest: sha1:" + digest.encode())
    return b"\r\n".join([*head, *([extra] if extra else []), b"Content-Length: %d" % len(payload), b"", b""]) + payload + warc.END


def stored(data):
    """A gzip member that stores its bytes, so that false beginnings stay in it."""
    import zlib

    packer = zlib.compressobj(0, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def read_in_splits(spark, folder, compress, size="700"):
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    try:
        return warc.read_archives(spark, f"file://{folder}", compress).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_splits_give_what_the_whole_file_gives(spark, tmp_path):
    rng = random.Random(9)
    for compress in (True, False):
        parts = []
        for i in range(40):
            payload = rng.randbytes(rng.randint(0, 900)) + (b"\x1f\x8b\x08\x00false" + b"WARC/1.0\r\nfalse: x\r\n" if i % 4 == 0 else b"")
            r = record(i, payload, hashlib.sha1(payload).hexdigest())
            parts.append((stored(r) if i % 2 else warc.zipped(r)) if compress else r)
        data = bytearray(b"".join(parts))
        at = sum(map(len, parts[:10])) - 10
        data[at : at + 4] = b"\xff\xfe\xfd\xfc"
        at = sum(map(len, parts[:25]))
        data[at:at] = b"junk between records " * 100
        folder = tmp_path / str(compress)
        folder.mkdir()
        (folder / "a.bin").write_bytes(bytes(data))
        want = sorted((s.offset, s.kind, s.payload if s.kind == "record" else s.length) for s in warc.salvage(bytes(data)))
        assert sum(k == "record" for _, k, _ in want) == 39
        got = sorted((r.offset, r.kind, bytes(r.payload) if r.kind == "record" else r.gap_bytes) for r in read_in_splits(spark, folder, compress))
        assert [g for g in got if g[1] == "record"] == [w for w in want if w[1] == "record"]
        # A gap that holds a whole piece may be cut where the pieces are.
        assert sum(g[2] for g in got if g[1] == "gap") == sum(w[2] for w in want if w[1] == "gap")


def test_members_of_several_records_and_other_digests(spark, tmp_path):
    http = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nbody"
    base32 = base64.b32encode(hashlib.sha1(b"body").digest()).decode()
    good = record(1, http, base32, b"Content-Type: application/http; msgtype=response")
    bad = record(2, http, base32)  # not said to be a message, so the digest is wrong
    (tmp_path / "a.bin").write_bytes(warc.zipped(good + record(3, b"x") + b"junk" + record(4, b"y")) + warc.zipped(bad) + warc.zipped(record(5, b"")))
    got = warc.read_archives(spark, f"file://{tmp_path}").collect()
    assert sorted(r.record_id for r in got if r.kind == "record") == [f"urn:page:{i}" for i in (1, 3, 4, 5)]
    assert sorted(r.reason for r in got if r.kind == "gap") == ["no version line", "wrong digest"]


def test_repeated_rows_and_clashing_columns(spark):
    big = "x" * 1500
    pages = spark.createDataFrame([(1, None, big, "a"), (1, None, big, "b"), (0, "u", big, "c"), (2, "u", "y" * 2_000_000, "d")], "page_id long, url string, html string, digest string")
    got = sorted((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in warc.archive_round_trip(pages).collect())
    assert got == [(0, "revisit", 1, 1500), (1, "response", None, 1500), (1, "response", None, 1500), (2, "response", None, 2_000_000)]
