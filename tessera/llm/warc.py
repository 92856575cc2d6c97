"""WARC archives: a writer that leaves out repeated payloads, and a Python data source that reads them.

Archives are written as record-at-a-time gzip members (WARC 1.1, annex D) whose extra field ``sl`` holds the
member's compressed and uncompressed sizes. The data source plans byte ranges of the files as
partitions. A task looks for the first member that begins in its range and goes from member to member by
their sizes: it inflates a record's header block alone, applies the pushed predicates on record type and
headers to it, and inflates the payload only if the record stays and its payload is asked for.

Defined results (writer): a null payload counts as empty; a null page id counts as the smallest; of records
with equal payloads of at least ``least`` bytes those with the largest page id are responses (more than one
only if a page id is repeated) and the others revisit them; smaller records are all responses. Payloads of any size are kept
whole, one record in memory at a time. An empty table makes no records. Extra columns are not read.
(Reader): files without the ``sl`` field are read member by member; gzip damage and a payload that doesn't
match its digest raise an error.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from . import files
from .common import written

#: Bytes of a file in one partition.
RANGE = 32 << 20
_FIXED = struct.Struct("<4sIBBH")  # gzip: magic, method and flags; time; two bytes; length of the extra field
_EXTRA = struct.Struct("<2sHII")  # subfield sl: sizes, compressed and not

SCHEMA = "file string, offset long, record_type string, record_id string, target_uri string, date string, payload_digest string, refers_to_uri string, refers_to string, page_id string, payload_length string, content_length long, payload binary"
#: Columns that come from headers; predicates on them and on record_type are pushed down.
HEADERS = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "date": "warc-date", "payload_digest": "warc-payload-digest",
           "refers_to_uri": "warc-refers-to-target-uri", "refers_to": "warc-page-refers-to", "page_id": "warc-page-id", "payload_length": "warc-page-payload-length"}
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(headers: dict[str, str], body: bytes) -> bytes:
    """A gzip member with one WARC record."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers.items()) + f"Content-Length: {len(body)}\r\n\r\n"
    data = head.encode() + body + b"\r\n\r\n"
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    deflated = deflate.compress(data) + deflate.flush()
    size = _FIXED.size + _EXTRA.size + len(deflated) + 8
    if max(size, len(data)) >= 1 << 32:
        raise ValueError("a record of 4 GB or more has no place in the size field")
    start = _FIXED.pack(b"\x1f\x8b\x08\x04", 0, 0, 255, _EXTRA.size) + _EXTRA.pack(b"sl", 8, size, len(data))
    return start + deflated + struct.pack("<II", zlib.crc32(data), len(data))


def _clean(value: str) -> str:
    """A header value on one line."""
    return " ".join(value.split())


def capture(page_id: int | None, url: str | None, payload: bytes, sha: str, revisit_of: int | None, date: str) -> bytes:
    """A page's record: a response, or a revisit of the page ``revisit_of`` without payload."""
    kind = "response" if revisit_of is None else "revisit"
    headers = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url} {sha}')}>", "WARC-Date": date, "WARC-Target-URI": _clean(url or ""),
               "Content-Type": "application/http; msgtype=response", "WARC-Payload-Digest": f"sha1:{sha}", "WARC-Page-Payload-Length": str(len(payload))}
    if page_id is not None:
        headers["WARC-Page-ID"] = str(page_id)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    if revisit_of is not None:
        headers |= {"WARC-Profile": REVISIT, "WARC-Page-Refers-To": str(revisit_of)}
        return record(headers, http)
    return record(headers, http + payload)


def write(df: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0, date: str = "2024-01-01T00:00:00Z", salts: int = 8) -> DataFrame:
    """Writes ``part-00000.warc.gz`` ... to ``folder``; (part, records, bytes), one row for each file."""
    payload = F.coalesce(F.col(f"`{payload_col}`").cast("binary"), F.lit(b""))
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").alias("url"), payload.alias("payload"), F.unhex(F.sha1(payload)).alias("sha"))
    slim = rows.select("page_id", "sha", F.length("payload").alias("bytes")).where(F.col("bytes") >= least)
    winners = slim.groupBy("sha").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    # Winners of repeated payloads go to a few salts, so that the rows of one payload are spread over as many tasks.
    winners = winners.select("sha", "first", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    marked = rows.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(salts)).cast("int")).join(winners, ["sha", "salt"], "left")
    marked = marked.withColumn("revisit", F.when(F.length("payload") >= least, F.when(F.coalesce(F.col("page_id") != F.col("first"), F.col("first").isNotNull()), F.col("first"))))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        part, n, size = TaskContext.get().partitionId(), 0, 0
        with files.written_file(f"{folder}/part-{part:06d}.warc.gz") as out:
            batch = first
            while batch is not None:
                for i in range(batch.num_rows):
                    page, url, body, sha, of = (batch.column(c)[i].as_py() for c in ("page_id", "url", "payload", "sha", "revisit"))
                    data = capture(page, url, body, base64.b32encode(sha).decode(), of, date)
                    out.write(data)
                    n, size = n + 1, size + len(data)
                batch = next(batches, None)
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()), "records": pa.array([n], pa.int64()), "bytes": pa.array([size], pa.int64())})

    return written(marked.select("page_id", "url", "payload", "sha", "revisit").mapInArrow(put, "part long, records long, bytes long"), "archives")


class WarcRange(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


class WarcSource(DataSource):
    """``spark.read.format("warc").option("path", folder).load()``, after ``spark.dataSource.register(WarcSource)``.

    Options: path (a folder of ``*.warc.gz``), range (bytes in a partition), payload (true, false: null without
    being inflated), types (comma-separated record types) and verify (true: payload digests of responses).
    """

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.range = int(options.get("range", RANGE))
        self.payload = options.get("payload", "true").lower() == "true"
        self.verify = options.get("verify", "true").lower() == "true"
        types = options.get("types")
        self.wanted: list[tuple[str, frozenset[str]]] = [("warc-type", frozenset(types.split(",")))] if types else []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes equality and IN on header columns; Spark applies the rest."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute[0] in HEADERS and isinstance(f.value, str):
                self.wanted.append((HEADERS[f.attribute[0]], frozenset([f.value])))
            elif isinstance(f, In) and f.attribute[0] in HEADERS and all(isinstance(v, str) for v in f.value):
                self.wanted.append((HEADERS[f.attribute[0]], frozenset(f.value)))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        return [WarcRange(path, a, min(a + self.range, size)) for path, size in files.listed(self.path, ".warc.gz") for a in range(0, size, self.range)]

    def read(self, part: WarcRange) -> Iterator[tuple]:
        if part is None:  # a folder without archives
            return
        at, _ = files.opened(self.path)
        with at.open_input_file(part.path) as f:
            size = f.size()
            start = _member_at(f, part.start, part.end, size)
            while start is not None and start < part.end:
                row, start = self._record(f, part.path, start, size)
                if row:
                    yield row

    def _record(self, f, path: str, start: int, size: int) -> tuple[tuple | None, int | None]:
        """The row of the member at ``start``, or None if it isn't wanted, and the place of the next member."""
        f.seek(start)
        chunk = f.read(2048)
        body, length = _body_at(chunk)
        inflate, text, cut = zlib.decompressobj(-15), b"", -1
        chunk = chunk[body:]
        while cut < 0:  # the header block alone
            text += inflate.decompress(chunk, 4096)
            cut = text.find(b"\r\n\r\n")
            chunk = inflate.unconsumed_tail or f.read(2048)
            if cut < 0 and (inflate.eof or not chunk):
                raise ValueError(f"{path}: the record at {start} has no complete header")
        headers = _parsed(text[:cut])
        fits = all(headers.get(k) in v for k, v in self.wanted)
        if length and not (fits and (self.payload or self.verify)):
            data = b""
        else:
            f.seek(start)
            whole = f.read(length or size - start)
            inflate = zlib.decompressobj(-15)
            data = inflate.decompress(whole[body:])
            if not inflate.eof or struct.unpack("<II", inflate.unused_data[:8]) != (zlib.crc32(data), len(data) & 0xFFFFFFFF):
                raise ValueError(f"{path}: the record at {start} is damaged")
            length = len(whole) - len(inflate.unused_data) + 8
        after = start + length
        return (self._row(path, start, headers, data[cut + 4 :]) if fits else None), (after if after < size else None)

    def _row(self, path: str, start: int, headers: dict[str, str], body: bytes) -> tuple:
        n = int(headers.get("content-length", 0))
        payload = None
        if headers.get("warc-type") == "response" and (self.payload or self.verify):
            payload = body[:n].partition(b"\r\n\r\n")[2]
            sha = headers.get("warc-payload-digest", "")
            if self.verify and sha.startswith("sha1:") and sha[5:] != digest(payload):
                raise ValueError(f"{path}: the payload of the record at {start} doesn't match its digest")
            if self.verify and int(headers.get("warc-page-payload-length", len(payload))) != len(payload):
                raise ValueError(f"{path}: the payload of the record at {start} hasn't its length")
        return (path, start, *[headers.get(k) for k in HEADERS.values()], n, payload if self.payload else None)


def _body_at(head: bytes) -> tuple[int, int]:
    """(place of the deflated data in a member, the member's size or 0 if it doesn't say)."""
    flags, at, length = head[3], 10, 0
    if flags & 4:
        n = struct.unpack_from("<H", head, at)[0]
        extra, at = head[at + 2 : at + 2 + n], at + 2 + n
        while len(extra) >= 4:
            name, k = extra[:2], struct.unpack_from("<H", extra, 2)[0]
            if name == b"sl" and k == 8:
                length = struct.unpack_from("<I", extra, 4)[0]
            extra = extra[4 + k :]
    for flag in (8, 16):  # file name, comment
        if flags & flag:
            at = head.index(b"\0", at) + 1
    return at + (2 if flags & 2 else 0), length


def _member_at(f, start: int, end: int, size: int) -> int | None:
    """The first member that begins in [start, end): a gzip header whose data begins with a WARC version."""
    if start == 0:
        return 0 if size else None
    overlap = 4096
    at = start
    while at < end:
        f.seek(at)
        data = f.read(min(1 << 20, size - at) + overlap)
        place = data.find(b"\x1f\x8b\x08")
        while 0 <= place < (1 << 20) and at + place < end:
            try:
                body, _ = _body_at(data[place : place + 2048])
                if zlib.decompressobj(-15).decompress(data[place + body : place + 2048], 5) == b"WARC/":
                    return at + place
            except (zlib.error, ValueError, struct.error, IndexError):
                pass
            place = data.find(b"\x1f\x8b\x08", place + 1)
        at += 1 << 20
    return None


def _parsed(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def load(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("warc").options(path=folder, **options).load()
