"""WARC archives: a writer that records repeated payloads as revisits, and a reader that salvages damaged files.

Written archives hold one gzip member per record, of at most about ARCHIVE_BYTES of payload each file. Of records with equal
payloads of at least ``least`` bytes the one with the largest id is a response, the others are revisits
that refer to it and carry the HTTP header only. Files that finished tasks wrote are in a manifest;
what lost or repeated tasks left is not read.

The reader checks each member (its checksum) and each record (version line, header, length, closing
blank lines, block digest). After a failed check it goes on at the next version line or the next gzip
member that begins with one, whichever is nearer, and logs the bytes between as a quarantined gap. Of a member with a fault,
the records that inflate before the fault and pass their own checks come back too; its bytes are a gap all the same.

Null payloads are empty; a null id is written as ``null`` and comes back as null, as the smallest of ids.
Repeated rows are written as often as they come; of equal rows with the largest id each is a response. An empty table
gives no archives and an empty result. Only id, URL and payload are read, so other columns may have any names. A payload
is held whole in a worker, about three times; a file to be read at most 2 GB, in which written archives stay by far unless
one payload is as large.
"""

from __future__ import annotations

import hashlib
import posixpath
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filesystem, released, shared_dir, small, staged

ARCHIVE_BYTES = 64 << 20
LEAST_REVISIT = 1000
#: Fixed values of the format.
VERSION = b"WARC/1.1\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN = "urn:millrace:page:"
GZIP = b"\x1f\x8b\x08"
_VERSION_LINE = re.compile(rb"WARC/1\.[01]\r?\n")


def _record(id: str, url: str, payload: bytes, digest: str, kind: str, refers: str | None, date: str) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if kind == "response" else http
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <{URN}{id}>", f"WARC-Date: {date}", f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%-._~')}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{hashlib.sha1(block).hexdigest()}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{URN}{refers}>"]
    return VERSION + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def with_roles(pages: DataFrame, id: str, url: str, payload: str, least: int = LEAST_REVISIT) -> DataFrame:
    """id, url, payload, digest, kind and refers (the response's id, for revisits)."""
    rows = pages.select(F.col(id).cast("long").alias("id"), F.coalesce(F.col(url).cast("string"), F.lit("")).alias("url"), F.coalesce(F.col(payload).cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", F.sha1(F.col("payload").cast("binary")))
    sizes = rows.where(F.octet_length("payload") >= least).groupBy("digest").agg(F.max("id").alias("keeper"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    sizes = staged(sizes)
    marked = rows.join(small(sizes, sizes.count()), "digest", "left")
    again = F.col("keeper").isNotNull() & ~F.col("id").eqNullSafe(F.col("keeper"))
    return marked.select("id", "url", "payload", "digest", F.when(again, "revisit").otherwise("response").alias("kind"), F.when(again, F.col("keeper")).alias("refers"))


def write(pages: DataFrame, folder: str, id: str = "page_id", url: str = "url", payload: str = "html", date: str = "2024-01-01T00:00:00Z", least: int = LEAST_REVISIT) -> DataFrame:
    """Write archives into the folder; returns the manifest (file, records)."""
    fs, path = filesystem(folder)
    fs.create_dir(path, recursive=True)

    @released
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = filesystem(folder)
        made, stream, size, records = [], None, 0, 0
        for b in batches:
            for id, url, payload, digest, kind, refers in zip(*(b.column(c).to_pylist() for c in ("id", "url", "payload", "digest", "kind", "refers")), strict=True):
                if stream is None:
                    name, size, records = f"part-{uuid.uuid4().hex}.warc.gz", 0, 0
                    stream = fs.open_output_stream(posixpath.join(path, name), compression=None)
                data = payload.encode("utf-8", "surrogatepass")
                z = zlib.compressobj(3, zlib.DEFLATED, 31)
                stream.write(z.compress(_record("null" if id is None else str(id), url, data, digest, kind, str(refers), date)) + z.flush())
                size, records = size + len(data), records + 1
                if size >= ARCHIVE_BYTES:
                    stream.close()
                    made.append((name, records))
                    stream = None
        if stream is not None:
            stream.close()
            made.append((name, records))
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in made], pa.string()), pa.array([n for _, n in made], pa.int64())], names=["file", "records"])

    manifest = with_roles(pages, id, url, payload, least).mapInArrow(run, "file string, records long")
    manifest.write.parquet(posixpath.join(folder, "manifest"))
    return pages.sparkSession.read.parquet(posixpath.join(folder, "manifest"))


class Gap(Exception):
    """A failed check."""


def _parse(data: bytes, at: int) -> tuple[dict, int]:
    """The record at ``at`` and where the next one begins."""
    m = _VERSION_LINE.match(data, at)
    if not m:
        raise Gap("no version line")
    end = data.find(b"\r\n\r\n", m.end())
    if end < 0:
        raise Gap("no end of header")
    head: dict[str, str] = {}
    for line in data[m.end() : end].split(b"\r\n"):
        name, sep, value = line.partition(b":")
        if not sep:
            raise Gap("bad header line")
        head[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    length = head.get("content-length", "")
    if not length.isdigit():
        raise Gap("no length")
    start, stop = end + 4, end + 4 + int(length)
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise Gap("record does not end where its length says")
    block = data[start:stop]
    digest = head.get("warc-block-digest", "")
    if digest.startswith("sha1:") and len(digest) == 45 and hashlib.sha1(block).hexdigest() != digest[5:].lower():
        raise Gap("block digest differs")
    return {"head": head, "block": block, "offset": at}, stop + 4


def _plain(data: bytes, base: int = 0, scale: bool = True) -> Iterator[tuple[str, object]]:
    """("record", record) and ("gap", (from, to, why)) of uncompressed data."""
    at = 0
    while at < len(data):
        try:
            record, to = _parse(data, at)
        except Gap as e:
            m = _VERSION_LINE.search(data, at + 1)
            to = m.start() if m else len(data)
            yield "gap", ((base + at, base + to) if scale else (base, base)) + (str(e),)
        else:
            record["offset"] = base + at if scale else base
            yield "record", record
        at = to


class _Broken(Gap):
    """A fault in a gzip member; ``before`` is what inflates before it."""

    def __init__(self, why: str, before: bytes) -> None:
        super().__init__(why)
        self.before = before


def _member(data: memoryview, at: int) -> tuple[bytes, int]:
    z, out, to, step = zlib.decompressobj(31), [], at, 65536
    while not z.eof and to < len(data):
        before = z.copy()
        try:
            out.append(z.decompress(data[to : to + step]))
        except zlib.error as e:
            raise _Broken(f"bad member: {e}", b"".join([*out, _until(before, data[to : to + step])])) from None
        to, step = to + step, 1 << 20
    if not z.eof:
        raise _Broken("member is cut off", b"".join(out))
    return b"".join(out), min(to, len(data)) - len(z.unused_data)


def _until(z: object, data: memoryview) -> bytes:
    """What of the data inflates before the fault in it."""
    out = []
    for size in (4096, 64, 1):
        at = 0
        while at < len(data):
            before = z.copy()
            try:
                out.append(z.decompress(data[at : at + size]))
            except zlib.error:
                z, data = before, data[at : at + size]
                break
            at += size
    return b"".join(out)


def _next(data: bytes, view: memoryview, at: int) -> int:
    """The nearest place from ``at`` on with a version line, or a whole gzip member that begins with one."""
    m = _VERSION_LINE.search(data, at)
    line = m.start() if m else len(data)
    to = data.find(GZIP, at, line)
    while to >= 0:
        try:
            if _VERSION_LINE.match(_member(view, to)[0]):
                return to
        except Gap:
            pass
        to = data.find(GZIP, to + 1, line)
    return line


def salvage(data: bytes) -> Iterator[tuple[str, object]]:
    """Records and gaps of a file's bytes, compressed by member or not, decided at each place; places are those in the file."""
    view, at = memoryview(data), 0
    while at < len(data):
        try:
            if data.startswith(GZIP, at):
                text, to = _member(view, at)
            else:
                text = None
                record, to = _parse(data, at)
        except Gap as e:
            for kind, x in _plain(e.before, at, scale=False) if isinstance(e, _Broken) else ():
                if kind == "record":
                    yield kind, x
            to = _next(data, view, at + 1)
            yield "gap", (at, to, str(e))
        else:
            if text is None:
                yield "record", record
            else:
                for kind, x in _plain(text, at, scale=False):
                    yield kind, x if kind == "record" else (at, to, x[2])
        at = to


READ = "file string, offset long, status string, why string, gap_bytes long, record_id string, kind string, url string, payload binary, payload_bytes long, payload_digest string, refers string"


def _row(file: str, kind: str, x) -> tuple:
    if kind == "gap":
        return (file, x[0], "quarantined", x[2], x[1] - x[0], None, None, None, None, None, None, None)
    head, block = x["head"], x["block"]
    http, sep, payload = block.partition(b"\r\n\r\n")
    if not sep:
        http, payload = b"", block
    role = head.get("warc-type", "")
    size = len(payload)
    if role == "revisit":
        m = re.search(rb"(?im)^content-length:\s*(\d+)", http)
        size, payload = int(m[1]) if m else None, None
        digest = head.get("warc-payload-digest", "").removeprefix("sha1:") or None
    else:
        digest = hashlib.sha1(payload).hexdigest()
        told = head.get("warc-payload-digest", "")
        if told.startswith("sha1:") and len(told) == 45 and told[5:] != digest:
            return (file, x["offset"], "quarantined", "payload digest differs", len(block), None, None, None, None, None, None, None)
    return (file, x["offset"], "ok", None, None, head.get("warc-record-id", "").strip("<>"), role, head.get("warc-target-uri"), payload, size, digest, head.get("warc-refers-to", "").strip("<>") or None)


def read(spark: SparkSession, folder: str, with_payload: bool = True) -> DataFrame:
    """One row per record (status ok) and per gap (status quarantined) of the archives of a folder.

    With a manifest beside them only its files are read. The payload may be left out.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    fs, path = filesystem(folder)
    if fs.get_file_info(posixpath.join(path, "manifest")).type.name == "Directory":
        files = files.join(spark.read.parquet(posixpath.join(folder, "manifest")).select("file"), "file", "left_semi")
    schema = READ if with_payload else READ.replace(" payload binary,", "")
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    types = [kinds[x.split()[1]] for x in schema.split(", ")]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    @released
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, content in zip(b.column("file").to_pylist(), b.column("content"), strict=True):
                rows, size = [], 0
                for kind, x in salvage(content.as_py()):
                    row = _row(file, kind, x)
                    size += len(row[8] or b"")
                    rows.append(row if with_payload else row[:8] + row[9:])
                    if size > 8 << 20 or len(rows) >= 2000:
                        yield batch(rows)
                        rows, size = [], 0
                if rows:
                    yield batch(rows)

    return files.mapInArrow(run, schema)


def page_records(pages: DataFrame, folder: str | None = None, **columns: str) -> DataFrame:
    """Write all pages and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    folder = folder or shared_dir(pages.sparkSession)
    write(pages, folder, **columns)
    number = lambda c: F.when(F.substring_index(c, ":", -1) != "null", F.substring_index(c, ":", -1).cast("long"))
    back = read(pages.sparkSession, folder, with_payload=False).where("status = 'ok'")
    return back.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), number("refers").alias("refers_to"))


ORACLE = """
with p as (select page_id, encode(coalesce(html, '')) b from pages),
q as (select page_id, octet_length(b) payload_bytes, sha1(b) payload_digest from p),
k as (select payload_digest, max(page_id) keeper from q where payload_bytes >= 1000 group by payload_digest having count(*) > 1)
select page_id, payload_bytes, payload_digest, case when keeper is not null and keeper is distinct from page_id then 'revisit' else 'response' end record_type,
  case when keeper is not null and keeper is distinct from page_id then keeper end refers_to
from q left join k using (payload_digest)
"""
