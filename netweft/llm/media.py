"""Media columns: bytes kept as progressive JPEG files, read back as coefficients and RGB tensors.

A payload is a multiple of 64 bytes, and each 64 bytes are the coefficients of
one block, one byte each, so that the file holds them without loss: JPEG loses
in the transform and the quantiser, and neither stands between a payload and
its coefficients. The image is YCbCr with chroma at half resolution; the blocks
of the three components follow each other. Coefficients come in nine scans:
first the upper bits of DC and of bands of AC, then the last bit of each.

A byte is a coefficient of magnitude 2 to 129, never zero before its last bit,
and the Huffman code of a magnitude is as much shorter as its bits are more: a
scan of upper bits has just one byte for each coefficient.

Reading takes any progressive file (see ``jpeg``). A row depends on itself
alone: no shuffle, and a lost executor costs its running tasks. Null or empty
texts are 64 zero bytes. Repeated rows have one result each; other columns are
ignored; an empty table gives no rows. Null media give null results. A very long
text is one image of as many rows of blocks as it takes, or of more columns from
65,535 rows of samples on; one task holds it whole.
"""
from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netweft.llm import jpeg
from netweft.llm.batches import keyed_texts, pieces
from netweft.plans.scratch import stored

#: Units between restarts; rows of units in an image, 16 samples each and 65,535 samples at most.
EVERY, ROWS = 16, 4_095

_bytes = np.arange(256)
_VALUE = np.where(_bytes < 128, -(_bytes + 2), _bytes - 126).astype(np.int64)
_BYTE = np.zeros(512, np.uint8)
_BYTE[_VALUE + 256] = _bytes
_half = np.abs(_VALUE) >> 1
_size = np.floor(np.log2(_half)).astype(np.int64) + 1
# Code lengths 1 to 7 for sizes 7 to 1: ones as many as the length less one, and a zero.
_code = (1 << (8 - _size)) - 2
_FIRST = (_code << _size | np.where(_VALUE > 0, _half, (1 << _size) - 1 - _half)).astype(np.uint8)
_LAST = (np.abs(_VALUE) & 1).astype(np.uint8)


def _segment(kind: int, body: bytes) -> bytes:
    return bytes((0xFF, kind)) + struct.pack(">H", len(body) + 2) + body


def _table(kind: int, number: int, codes: dict[int, list[int]]) -> bytes:
    """codes: by length, the values in order."""
    return _segment(0xC4, bytes((kind << 4 | number, *(len(codes.get(n, ())) for n in range(1, 17)), *(v for n in sorted(codes) for v in codes[n]))))


_TABLES = (
    _segment(0xDB, bytes((0,)) + b"\x01" * 64)
    + _table(0, 0, {4: list(range(9))})
    + _table(1, 0, {8 - s: [s] for s in range(7, 0, -1)})
    + _table(1, 1, {3: [r << 4 for r in range(6)]})
    + _segment(0xDD, struct.pack(">H", EVERY))
)


def _scan(parts: list[int], tables: int, start: int, end: int, high: int, low: int, segments: list[bytes]) -> bytes:
    head = bytes((len(parts), *(x for c in parts for x in (c + 1, tables)), start, end, high << 4 | low))
    body = segments[0].replace(b"\xff", b"\xff\x00")
    for k, x in enumerate(segments[1:]):
        body += bytes((0xFF, 0xD0 + k % 8)) + x.replace(b"\xff", b"\xff\x00")
    return _segment(0xDA, head) + body


def _packed(bits: np.ndarray) -> bytes:
    """Bits as bytes, filled up with ones."""
    return np.packbits(np.concatenate((bits, np.ones(-len(bits) % 8, np.uint8)))).tobytes()


def _bits(values: np.ndarray, n: int) -> np.ndarray:
    return (values[..., None] >> np.arange(n - 1, -1, -1) & 1).astype(np.uint8)


def encode(payload: bytes) -> bytes:
    """A progressive JPEG file of a payload of 64 bytes or a multiple of that."""
    if not payload or len(payload) % 64:
        raise ValueError("a payload is a positive multiple of 64 bytes")
    units = -(-len(payload) // 384)
    cols = -(-units // ROWS)
    rows = -(-units // cols)
    data = np.zeros((rows * cols * 6, 64), np.uint8)
    data.reshape(-1)[: len(payload)] = np.frombuffer(payload, np.uint8)
    y, cb, cr = np.split(data, (rows * cols * 4, rows * cols * 5))
    groups = lambda x: [x[k : k + EVERY] for k in range(0, len(x), EVERY)]
    # A unit is two by two blocks of the first component and one each of the others.
    dc = np.concatenate(
        (y[:, 0].reshape(rows, 2, cols, 2).transpose(0, 2, 1, 3).reshape(-1, 4), cb[:, :1].reshape(-1, 1), cr[:, :1].reshape(-1, 1)), axis=1
    )

    def dc_first(x: np.ndarray) -> bytes:
        upper = _VALUE[x] >> 1
        diff = upper.copy()
        luma = upper[:, :4].ravel()
        diff[:, :4] = np.diff(luma, prepend=0).reshape(-1, 4)
        diff[:, 4:] = np.diff(upper[:, 4:], axis=0, prepend=0)
        d = diff.ravel()
        size = np.where(d == 0, 0, np.floor(np.log2(np.maximum(np.abs(d), 1))).astype(np.int64) + 1)
        value = np.where(d >= 0, d, d + (1 << size) - 1)
        # Four bits of code and the value's own, at the left of twelve.
        whole = _bits((size << 8) | (value << (8 - size)), 12)
        return _packed(whole[np.arange(12) < (4 + size)[:, None]])

    first = lambda x, a, b: [_FIRST[g[:, a : b + 1]].tobytes() for g in groups(x)]

    def last(x: np.ndarray) -> list[bytes]:
        out = []
        for g in groups(x):
            r = len(g).bit_length() - 1
            head = _bits(np.array(r << r | (len(g) - (1 << r))), 3 + r).ravel()
            out.append(_packed(np.concatenate((head, _LAST[g[:, 1:]].ravel()))))
        return out

    frame = struct.pack(">BHHB", 8, rows * 16, cols * 16, 3) + bytes((1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0))
    return b"".join(
        (
            b"\xff\xd8",
            _segment(0xFE, b"payload %d" % len(payload)),
            _segment(0xC2, frame),
            _TABLES,
            _scan([0, 1, 2], 0x00, 0, 0, 0, 1, [dc_first(g) for g in groups(dc)]),
            _scan([0], 0x00, 1, 5, 0, 1, first(y, 1, 5)),
            _scan([1], 0x00, 1, 63, 0, 1, first(cb, 1, 63)),
            _scan([2], 0x00, 1, 63, 0, 1, first(cr, 1, 63)),
            _scan([0], 0x00, 6, 63, 0, 1, first(y, 6, 63)),
            _scan([0], 0x01, 1, 63, 1, 0, last(y)),
            _scan([0, 1, 2], 0x00, 0, 0, 1, 0, [_packed(_VALUE[g].ravel().astype(np.uint8) & 1) for g in groups(dc)]),
            _scan([1], 0x01, 1, 63, 1, 0, last(cb)),
            _scan([2], 0x01, 1, 63, 1, 0, last(cr)),
            b"\xff\xd9",
        )
    )


def payload_of(im: jpeg.Image) -> bytes | None:
    """The payload of a file that ``encode`` made, out of its coefficients; None for any other image."""
    said = [int(x[8:]) for x in im.comments if x.startswith(b"payload ") and x[8:].isdigit()]
    if not said:
        return None
    return _BYTE[np.concatenate([c.blocks.reshape(-1) for c in im.components]).astype(np.int64) + 256].tobytes()[: said[0]]


def feature(pixels: np.ndarray) -> str:
    """Size, hundredths of the channels' means, and a checksum."""
    height, width = pixels.shape[:2]
    means = [int(x) * 100 // (height * width) for x in pixels.reshape(-1, 3).sum(axis=0, dtype=np.int64)]
    return f"{height}x{width}:{means[0]},{means[1]},{means[2]}:{zlib.crc32(np.ascontiguousarray(pixels)):08x}"


def padded(text: bytes) -> bytes:
    return text + bytes(-len(text) % 64 or (0 if text else 64))


def store(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, media binary): each whole text as a file; n_bytes counts the text without its padding."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, limit=2 << 20):
            texts = [x.encode() for x in part.column("text").to_pylist()]
            files = pa.array([encode(padded(x)) for x in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(map(len, texts), pa.int64()), files], ["key", "n_bytes", "media"])

    return keyed_texts(docs, key, text).mapInArrow(mapped, "key long, n_bytes long, media binary").withColumnRenamed("key", key)


def read(rows: DataFrame, media: str = "media", tensors: bool = True) -> DataFrame:
    """Adds to each row: payload (binary, null for files that hold none), feature, height, width, and rgb: the
    full-resolution tensor, rows of pixels of three bytes (null where ``tensors`` is off)."""
    added = [("payload", pa.binary()), ("feature", pa.string()), ("height", pa.int64()), ("width", pa.int64()), ("rgb", pa.binary())]

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, media, 3 << 20):
            files = part.column(media).to_pylist()
            images = iter(jpeg.decode([x for x in files if x is not None]))
            columns: list[list] = [[], [], [], [], []]
            for x in files:
                row: tuple = (None,) * 5
                if x is not None:
                    im = next(images)
                    pixels = jpeg.rgb(im)
                    row = payload_of(im), feature(pixels), im.height, im.width, pixels.tobytes() if tensors else None
                for c, v in zip(columns, row):
                    c.append(v)
            for (name, kind), c in zip(added, columns):
                part = part.append_column(name, pa.array(c, kind))
            yield part

    schema = rows.schema.simpleString()[7:-1]
    return rows.mapInArrow(mapped, f"{schema},payload:binary,feature:string,height:bigint,width:bigint,rgb:binary".replace(":", " "))


def write_tensors(rows: DataFrame, path: str, media: str = "media") -> None:
    """Writes rows with a media column, and payload, feature, height, width and the full-resolution rgb of each, as parquet.

    A pixel is three bytes: of a file that ``encode`` made, about twice the payload's bytes before compression.
    """
    read(rows, media).write.mode("overwrite").parquet(path)


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes whole ``documents`` as a media column and returns what is read back from there, the RGB tensors with it."""
    files, _ = stored(store(spark.read.parquet(f"{sf_dir}/documents.parquet")), "media")
    return read(files).select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -64, 64)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
        "height",
        "width",
        "rgb",
    )
