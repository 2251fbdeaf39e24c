"""WARC archives: writer and splittable reader (operator 4).

The writer stores every row as a gzip member of its own; rows with equal payloads
become revisits of one of them. The reader cuts the archives into byte ranges, one
row each, and spreads the ranges over tasks. A task scans its range for the gzip magic;
a candidate counts if it inflates to a WARC header, as the magic also occurs inside
compressed data. A record belongs to the range its member starts in and is read to its
end, past the range if need be, so every record is read once whatever the ranges.

Archives are read and written through pyarrow's file systems by their URI, in a folder
that all tasks reach. A writing task fills a file of its own name and moves it in
place when it is complete, so that a repeated task leaves one file.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.session import shared_dir, ship_package, stored

MAGIC = b"\x1f\x8b\x08"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed: the URL namespace of RFC 4122
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
DATE = "2000-01-01T00:00:00Z"
STEP = 1 << 20


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'page:{page}')}>"


def record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One gzip member: a response with its payload, or a revisit of ``refers_to`` with headers only."""
    block = HTTP if refers_to is not None else HTTP + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page)}",
        f"WARC-Target-URI: {' '.join((url or '').split())}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
        f"X-Payload-Length: {len(payload)}",
        f"X-Page-ID: {'' if page is None else page}",
    ]
    if refers_to is not None:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {record_id(refers_to)}",
            f"X-Refers-To-Page: {refers_to}",
        ]
    raw = "\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def with_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Adds payload_digest and refers_to: the largest page_id with the same payload, null for that one itself.

    Payloads under ``least_bytes`` bytes and pages without an id never revisit. Only payloads
    that repeat are joined back, so that most pages find no partner in a small table.
    """

    def add_digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = [payload_digest((h or "").encode("utf-8")) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, pa.string())], names=[*batch.schema.names, "payload_digest"])

    pages = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    digested = pages.mapInArrow(add_digest, "page_id long, url string, html string, payload_digest string")
    size = F.octet_length(F.coalesce("html", F.lit("")))
    heads = (
        digested.where(size >= least_bytes)
        .groupBy("payload_digest")
        .agg(F.max("page_id").alias("head"), F.count("page_id").alias("n"))
        .where("n > 1")
    )
    heads = stored(heads.select(F.col("payload_digest").alias("d"), "head"), "warc-heads")
    joined = digested.join(heads, (F.col("payload_digest") == F.col("d")) & (size >= least_bytes), "left")
    return joined.select(
        "page_id", "url", "html", "payload_digest", F.when(F.col("page_id") < F.col("head"), F.col("head")).alias("refers_to")
    )


def write(pages: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """Writes a record per row of ``pages`` (page_id, url, html; null html: an empty payload); returns path, bytes and records per file.

    Rows that repeat a page_id get a record each. An empty table writes no file.
    """
    ship_package(pages.sparkSession)
    system, top = file_system(folder)
    system.create_dir(top, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = file_system(folder)
        context = TaskContext.get()
        name = f"{top}/part-{context.partitionId():05d}.warc.gz"
        draft = f"{top}/_part-{context.partitionId():05d}-{context.taskAttemptId()}"
        n, size, out = 0, 0, None
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("page_id", "url", "html", "payload_digest", "refers_to")]
            for page, url, html, digest, refers_to in zip(*columns):
                out = out or system.open_output_stream(draft, compression=None)
                member = record(page, url, (html or "").encode("utf-8"), digest, refers_to)
                out.write(member)
                n, size = n + 1, size + len(member)
        if out:
            out.close()
            system.move(draft, name)
            yield pa.RecordBatch.from_pydict({"path": [name], "bytes": [size], "records": [n]})

    return with_revisits(pages, least_bytes).mapInArrow(run, "path string, bytes long, records long")


class _Window:
    """Bytes of a file from an offset on, fetched step by step."""

    def __init__(self, handle, at: int):
        self.handle, self.start, self.data = handle, at, b""

    def more(self) -> bool:
        self.handle.seek(self.start + len(self.data))
        got = self.handle.read(STEP)
        self.data += got
        return bool(got)

    def drop(self, upto: int) -> None:
        self.data, self.start = self.data[upto:], self.start + upto


def member(window: _Window, at: int) -> tuple[bytes, int] | None:
    """Inflated member at ``at`` of the window and the offset behind it; None if it is none with a WARC header."""
    inflate, out, fed, checked = zlib.decompressobj(31), bytearray(), at, False
    while not inflate.eof:
        if fed >= len(window.data) and not window.more():
            return None  # cut off
        piece = window.data[fed : fed + STEP]
        fed += len(piece)
        try:
            out += inflate.decompress(piece)
        except zlib.error:
            return None
        if not checked and len(out) >= 5:
            if not out.startswith(b"WARC/"):
                return None
            checked = True
    return (bytes(out), fed - len(inflate.unused_data)) if checked else None


def records(handle, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(offset, inflated record) of the members that start in [start, end)."""
    window, at = _Window(handle, start), 0
    while window.start + at < end:
        found = window.data.find(MAGIC, at)
        if found < 0:
            keep = max(at, len(window.data) - len(MAGIC) + 1)
            if window.start + keep >= end or not window.more():
                return
            at = keep
            continue
        if window.start + found >= end:
            return
        got = member(window, found)
        if got is None:
            at = found + 1
            continue
        yield window.start + found, got[0]
        window.drop(got[1])
        at = 0


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and content block of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    return fields, rest[: int(fields.get("content-length") or 0)]


def read(spark: SparkSession, folder: str, range_bytes: int = 8 << 20) -> DataFrame:
    """Records of all ``*.warc.gz`` files of a folder: headers and payload (without the HTTP header), read in byte ranges."""
    ship_package(spark)
    system, top = file_system(folder)
    found = system.get_file_info(fs.FileSelector(top)) if system.get_file_info(top).type != fs.FileType.NotFound else []
    files = [(f.path, f.size) for f in found if f.path.endswith(".warc.gz")]
    listed = spark.createDataFrame(files, "path string, size long")
    ranges = listed.withColumn("at", F.explode(F.expr(f"sequence(0L, greatest(size - 1, 0L), {range_bytes}L)")))
    n = max(1, sum(-(-size // range_bytes) for _, size in files))
    ranges = ranges.select("path", "at").repartition(n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = file_system(folder)
        for batch in batches:
            for path, at in zip(batch.column("path").to_pylist(), batch.column("at").to_pylist()):
                with system.open_input_file(path) as handle:
                    rows, held = [], 0
                    for offset, raw in records(handle, at, at + range_bytes):
                        fields, block = parse(raw)
                        payload = block.partition(b"\r\n\r\n")[2]
                        rows.append({"path": path, "offset": offset, "fields": list(fields.items()), "payload": payload})
                        held += len(payload)
                        if held > 16 << 20:
                            yield pa.RecordBatch.from_pylist(rows, SCHEMA)
                            rows, held = [], 0
                    yield pa.RecordBatch.from_pylist(rows, SCHEMA)

    return ranges.mapInArrow(run, "path string, offset long, fields map<string,string>, payload binary")


SCHEMA = pa.schema(
    [("path", pa.string()), ("offset", pa.int64()), ("fields", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())]
)


def archive_folder(spark: SparkSession) -> str:
    """A new folder for archives below the shared one."""
    return f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
