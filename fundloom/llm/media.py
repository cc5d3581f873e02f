"""Media columns: texts as lossless WebP images, stored, read back and measured."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fundloom.llm.shared import materialise
from fundloom.llm.webp import WIDTH, decode, decode_payloads, encode_payload, streams_of

UNIT = 192
#: Payload bytes that a task encodes or decodes together.
TOGETHER = 16 << 20


def padded(data: bytes) -> bytes:
    """Spaces after the data, up to a positive multiple of 192 bytes."""
    return data + b" " * (-len(data) % UNIT if data else UNIT)


def feature_of(rgb: np.ndarray) -> str:
    """Mean red, green and blue as hex, then a 64-bit hash: whether each column is brighter than the next."""
    columns = rgb.reshape(-1, WIDTH, 3).sum(axis=(0, 2), dtype=np.int64)
    bits = np.packbits(columns > np.roll(columns, -1)).tobytes().hex()
    means = rgb.sum(axis=0, dtype=np.int64) // len(rgb)
    return f"{''.join(f'{int(m):02x}' for m in means)}-{bits}"


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, sizes, media, held = [], [], [], 0

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

        for i in range(batch.num_rows):
            data = batch.column("text")[i].as_py() or b""
            ids.append(batch.column("doc_id")[i].as_py())
            sizes.append(len(data))
            media.append(encode_payload(padded(data)))
            held += len(data)
            if held >= TOGETHER:
                yield made()
                ids, sizes, media, held = [], [], [], 0
        if ids:
            yield made()


MEASURED = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in MEASURED.split(", ")]

    def made(rows: list[tuple]) -> pa.RecordBatch:
        out = []
        for (doc_id, n, m), rgb in zip(rows, decode_payloads([r[2] for r in rows]), strict=True):
            payload = rgb.tobytes()
            out.append((doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(m), hashlib.sha256(m).hexdigest(), feature_of(rgb)))
        columns = list(zip(*out, strict=True))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    for batch in batches:
        rows, held = [], 0
        for i in range(batch.num_rows):
            rows.append(tuple(batch.column(c)[i].as_py() for c in ("doc_id", "n_bytes", "media")))
            held += rows[-1][1]
            if held >= TOGETHER:
                yield made(rows)
                rows, held = [], 0
        if rows:
            yield made(rows)


def store_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text's UTF-8 bytes, padded, as WebP files; a table in the shared folder."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return materialise(plain.mapInArrow(_encode, "doc_id long, n_bytes long, media binary"), "media")


def media_round_trip(docs: DataFrame) -> DataFrame:
    """Store every text as a media column, read the stored bytes back and measure them.

    A null or empty text is a payload of 192 spaces. Payloads of more than
    4096 pixels take several images, so no image is long whatever the text.
    Null doc_ids and repeated rows give a row each; an empty table gives no
    rows; other columns are ignored.
    """
    return store_media(docs).mapInArrow(_measure, MEASURED)


def _pixels(column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("width", pa.int32()), ("height", pa.int32()), ("rgba", pa.binary())])
        for batch in batches:
            for i in range(batch.num_rows):
                data = batch.column(column)[i].as_py()
                try:
                    images, error = decode(streams_of(data)) if data else [], None
                except (ValueError, IndexError, KeyError, struct.error) as e:
                    images, error = [], str(e) or "damaged image"
                value = [{"width": x.shape[1], "height": x.shape[0], "rgba": x.tobytes()} for x in images]
                rest = batch.slice(i, 1)
                yield pa.RecordBatch.from_arrays([*rest.columns, pa.array([value], pa.list_(kind)), pa.array([error], pa.string())], names=[*rest.schema.names, "images", "error"])

    return run


def decode_media(table: DataFrame, column: str = "media") -> DataFrame:
    """Add ``images`` (width, height, RGBA bytes in rows) and ``error`` to a table with WebP files in ``column``.

    A null or empty value has no images and no error; a damaged or lossy one
    has no images and says why. Columns named ``images`` or ``error`` are
    replaced.
    """
    plain = table.drop("images", "error")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema.fields)
    return plain.mapInArrow(_pixels(column), f"{schema}, images array<struct<width:int, height:int, rgba:binary>>, error string")
