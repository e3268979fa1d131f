"""WARC archives of gzip members: a writer, and a reader that splits files at any byte.

The reader's tasks each take a byte range of a file. A task looks for the bytes
that begin a gzip member, takes a place for a member only if what is
decompressed there is a WARC header that can be decoded, and owns the records
that start inside its range; it reads past the end of the range to finish the
last of them. Two tasks never own the same record, and every record has one
owner, wherever the files are cut.

The writer stores equal payloads of at least ``least`` bytes once: the record
of the smallest id is a response, the others are revisits that name it. Only
digests and ids are grouped, so a payload that a third of the rows share costs
one partial minimum in each task; compressed records, not pages, are shuffled.

Null html: an empty payload. Null url: ``about:blank``. A row with a null id is
always a response. Repeated rows: all copies that have the smallest id are
responses. An empty table: no records. Other columns are ignored. A very long
page is one record like any other, which one task holds whole.

A task writes under a name of its own attempt and then gives the file its name;
a second attempt that comes later leaves the first one's file, which is the same.
"""
from __future__ import annotations

import base64
import hashlib
import posixpath
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netweft.llm.batches import bounded, pieces
from netweft.llm.files import settle
from netweft.plans.scratch import new_folder, passing, remove, stored

MAGIC = b"\x1f\x8b\x08"
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of a file that one task takes, and that it reads at a time.
SPLIT, BLOCK = 16 << 20, 1 << 20


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _uri(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _id(uri: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", uri or "")
    return int(m[1]) if m else None


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, first: int | None = None) -> bytes:
    """One gzip member: a response with its payload, or where ``first`` is given, a revisit without it."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    body = head if first is not None else head + payload
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "about:blank")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if first is None else 'revisit'}",
        f"WARC-Record-ID: {_uri(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {size}",
        *([f"WARC-Refers-To: {_uri(first)}", f"WARC-Profile: {PROFILE}"] if first is not None else []),
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    whole = "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(whole) + pack.flush()


def _digested(pages: DataFrame, key: str, url: str, html: str) -> DataFrame:
    """(page_id, digest, size, response, url): each row's record as a response, compressed."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "html"):
            ids, urls = part.column("page_id").to_pylist(), part.column("url").to_pylist()
            bodies = [x.encode() for x in part.column("html").to_pylist()]
            digests = [payload_digest(x) for x in bodies]
            members = [record(i, u, b, d, len(b)) for i, u, b, d in zip(ids, urls, bodies, digests)]
            yield pa.RecordBatch.from_arrays(
                [part.column("page_id"), part.column("url"), pa.array(digests), pa.array(map(len, bodies), pa.int64()), pa.array(members, pa.binary())],
                ["page_id", "url", "digest", "size", "member"],
            )

    rows = bounded(pages).select(
        F.col(f"`{key}`").cast("long").alias("page_id"),
        F.col(f"`{url}`").cast("string").alias("url"),
        F.coalesce(F.col(f"`{html}`").cast("string"), F.lit("")).alias("html"),
    )
    return rows.mapInArrow(mapped, "page_id long, url string, digest string, size long, member binary")


def write(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html", least: int = 0) -> DataFrame:
    """Writes archives to ``folder``, one for each partition; returns their (path, size).

    The records are made once and kept as a table, of which the grouping reads
    ids and digests only.
    """
    spark = pages.sparkSession
    made, made_uri = stored(_digested(pages, key, url, html), "members")
    large = made.where((F.col("size") >= least) & F.col("page_id").isNotNull())
    firsts = large.groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("first <> last")
    again = (
        large.select("page_id", "digest")
        .join(firsts, "digest")
        .where("page_id <> first")
        .select("page_id", "digest", "first")
        .distinct()
    )

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, out, at = TaskContext.get(), None, 0
        name = f"part-{task.partitionId():05d}.warc.gz"
        store, base = fs.FileSystem.from_uri(folder)
        draft, final = (posixpath.join(base, x) for x in (f"{name}.{task.taskAttemptId()}.draft", name))
        for batch in batches:
            for x in batch.to_pylist():
                if out is None:
                    store.create_dir(base, recursive=True)
                    out = store.open_output_stream(draft)
                data = x["member"] if x["first"] is None else record(x["page_id"], x["url"], b"", x["digest"], x["size"], x["first"])
                out.write(data)
                at += len(data)
        if out is not None:
            out.close()
            settle(store, draft, final)
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "size": [at]}, pa.schema([("path", pa.string()), ("size", pa.int64())]))

    on = (F.col("a.page_id") == F.col("b.page_id")) & (F.col("a.digest") == F.col("b.digest"))
    (
        made.alias("a")
        .join(again.alias("b"), on, "left")
        .select("a.page_id", "a.url", "a.digest", "a.size", F.when(F.col("b.first").isNull(), F.col("a.member")).alias("member"), "b.first")
        .mapInArrow(mapped, "path string, size long")
        .write.parquet(f"{folder}/files")
    )
    remove(spark, made_uri)
    return files(spark, folder)


def files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("path string, size long").parquet(f"{folder}/files")


class Window:
    """A stretch of a file, read in blocks as it is needed and let go as it is done with."""

    def __init__(self, file: pa.NativeFile, start: int, size: int):
        self.file, self.start, self.size, self.held = file, start, size, bytearray()

    def reach(self, end: int) -> bool:
        """Whether bytes up to ``end`` exist; holds them then."""
        while self.start + len(self.held) < min(end, self.size):
            at = self.start + len(self.held)
            self.held += self.file.read_at(min(BLOCK, self.size - at), at)
        return end <= self.size

    def drop(self, start: int) -> None:
        del self.held[: start - self.start]
        self.start = start

    def find(self, what: bytes, start: int, end: int) -> int:
        """The first place of ``what`` from start that is before ``end``, or -1."""
        while start < end:
            self.reach(min(start + BLOCK, end) + len(what) - 1)
            at = self.held.find(what, start - self.start)
            if at >= 0:
                return self.start + at if self.start + at < end else -1
            start = max(start, self.start + len(self.held) - len(what) + 1)
            self.drop(start)
            if start + len(what) > self.size:
                return -1
        return -1


def _header(data: bytes) -> dict[str, str] | None:
    """The fields of a WARC header at the start of ``data``; None if there isn't one."""
    end = data.find(b"\r\n\r\n")
    if end < 0 or not re.match(rb"WARC/\d+\.\d+\r\n", data):
        return None
    try:
        lines = data[:end].decode().split("\r\n")[1:]
    except UnicodeDecodeError:
        return None
    fields = dict(x.split(": ", 1) for x in lines if ": " in x)
    return fields if len(fields) == len(lines) and fields.get("Content-Length", "").isdigit() and "WARC-Type" in fields else None


def _member(window: Window, at: int) -> tuple[dict[str, str], bytes, int] | None:
    """(header fields, block, end) of the record whose member starts at ``at``; None if none does."""
    unpack, out, pos, fields = zlib.decompressobj(31), bytearray(), at, None
    while not unpack.eof:
        if not window.reach(pos + 1):
            if fields:
                raise EOFError(f"a record at byte {at} has no end")
            return None
        window.reach(pos + 4096)
        some = bytes(window.held[pos - window.start : pos - window.start + (4096 if fields is None else BLOCK)])
        try:
            out += unpack.decompress(some)
        except zlib.error:
            if fields:
                raise
            return None
        pos += len(some) - len(unpack.unused_data)
        if fields is None:
            if not out.startswith(b"WARC/"[: len(out)]):
                return None
            if b"\r\n\r\n" in out and (fields := _header(bytes(out))) is None:
                return None
    if fields is None:
        return None
    start = out.find(b"\r\n\r\n") + 4
    return fields, bytes(out[start : start + int(fields["Content-Length"])]), pos


def records(path: str, start: int, end: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, header fields, block) of the records that start in bytes start to end of a file."""
    store, base = fs.FileSystem.from_uri(path)
    with store.open_input_file(base) as file:
        window, at = Window(file, start, file.size()), start
        while (at := window.find(MAGIC, at, end)) >= 0:
            window.drop(at)
            found = _member(window, at)
            if found is None:
                at += 1
                continue
            yield at, found[0], found[1]
            at = found[2]
            window.reach(at)
            window.drop(min(at, window.start + len(window.held)))


FOUND = pa.schema(
    [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary())]
)


def _parsed(fields: dict[str, str], block: bytes) -> dict:
    """A row of FOUND. A response's size and digest are those of the payload that was read; its header must agree."""
    said, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
    row = {"page_id": _id(fields["WARC-Record-ID"]), "record_type": kind, "url": fields["WARC-Target-URI"], "payload_digest": said}
    if kind == "revisit":
        return row | {"payload_bytes": int(fields["X-Payload-Length"]), "refers_to": _id(fields["WARC-Refers-To"]), "payload": None}
    payload = block[block.find(b"\r\n\r\n") + 4 :]
    if payload_digest(payload) != said:
        raise ValueError(f"the payload of {fields['WARC-Record-ID']} is damaged")
    return row | {"payload_bytes": len(payload), "refers_to": None, "payload": payload}


def read(archives: DataFrame, split: int = SPLIT, payloads: bool = True) -> DataFrame:
    """The records of archives (path, size), with payloads or null in their place; every ``split`` bytes are a task's."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                rows, held = [], 0
                for _, fields, block in records(x["path"], x["start"], x["end"]):
                    rows.append(_parsed(fields, block))
                    if not payloads:
                        rows[-1]["payload"] = None
                    held += len(block)
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, FOUND)
                        rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, FOUND)

    ranges = (
        archives.where("size > 0")
        .select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split).cast("long"))).alias("start"))
        .select("path", "start", F.least(F.col("start") + split, "size").alias("end"))
    )
    n = max(1, ranges.count())
    return ranges.repartition(n).mapInArrow(
        mapped, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"
    )


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes whole ``pages`` to archives and returns what the archives hold."""
    archives = write(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder := new_folder(spark, "warc"))
    passing(spark, folder)
    return read(archives, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
