"""Legacy ARC archives to WARC: version-specific header lines in, synthesised WARC records out.

Steps, each a Spark job over archive files: pages are written as ARC files; their records are
scanned for payload digests; per digest one record stays a response and the others become
revisits of it; the ARC files are converted with those decisions; the WARC files are read back and
their digests checked. Payloads never go through a shuffle: decisions are narrow rows and meet the file they belong
to. Files have names no other attempt of a task uses, and only those that a
committed manifest names are read.

Null html is an empty payload, a null url is written as ``about:blank``, a null page id as an empty header value and
comes back null. Of repeated rows with the largest id exactly one is the response. An empty table makes no archives.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheafspark.llm import storage
from sheafspark.llm.storage import stage

#: A new archive is begun at this size (compressed) or number of records.
FILE_BYTES, FILE_RECORDS = 64 * 1024 * 1024, 10_000
#: Payloads shorter than this are never revisits.
REVISIT_BYTES = 1000
ID_HEADER = "X-Page-Id"

# The fields of URL records by ARC version.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length".split(),
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length".split(),
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:sheafspark:arc-record")

MANIFEST = "file string, bytes long, records long"
SCAN = "file string, record int, page_id long, url string, date string, payload_bytes long, digest string, record_id string"
READ = "page_id long, payload_bytes long, payload_digest string, record_type string, record_id string, refers string"


@dataclass
class ArcRecord:
    """A URL record: its header fields by name, and its content."""

    version: int
    fields: dict[str, str]
    content: bytes
    place: int

    @property
    def url(self) -> str:
        return self.fields["URL"]


def parse_header(line: bytes, version: int) -> dict[str, str]:
    """Fields of a header line; old writers left spaces in URLs, so the line is split from the right."""
    names = ARC_FIELDS[version]
    values = line.decode("utf-8", "replace").rstrip("\r\n").rsplit(" ", len(names) - 1)
    if len(values) != len(names):
        raise ValueError(f"ARC header with {len(values)} of {len(names)} fields")
    return dict(zip(names, values))


def read_arc(stream) -> Iterator[ArcRecord]:
    """The records of an ARC file, plain or gzip; the first is its version block."""
    start = stream.read(2)
    stream.seek(0)
    source = gzip.GzipFile(fileobj=stream) if start == b"\x1f\x8b" else stream
    source = io.BufferedReader(source, 1 << 20) if not isinstance(source, io.BufferedReader) else source
    line = source.readline()
    if not line.startswith(b"filedesc://"):
        raise ValueError("not an ARC file")
    # The version block's own header always has the fields of version 1 or 2; its content tells which.
    words = line.split()
    version = 2 if len(words) == len(ARC_FIELDS[2]) else 1
    place = 0
    while line:
        fields = parse_header(line, version)
        length = int(fields["Archive-length"])
        content = source.read(length)
        if len(content) != length:
            raise ValueError(f"ARC record {place} is shorter than its declared length")
        if place == 0:
            version = int(content.split(b" ", 1)[0])
        yield ArcRecord(version, fields, content, place)
        place += 1
        line = source.readline()
        while line in (b"\n", b"\r\n"):
            line = source.readline()


def split_http(content: bytes) -> tuple[bytes, bytes]:
    """(status line and headers with the blank line, payload) of an HTTP response; no headers if it is none."""
    if not content.startswith(b"HTTP/"):
        return b"", content
    for mark in (b"\r\n\r\n", b"\n\n"):
        at = content.find(mark)
        if at >= 0:
            return content[: at + len(mark)], content[at + len(mark) :]
    return content, b""


def http_header(head: bytes, name: str) -> str | None:
    wanted = name.lower().encode()
    for line in head.splitlines()[1:]:
        key, colon, value = line.partition(b":")
        if colon and key.strip().lower() == wanted:
            return value.strip().decode("utf-8", "replace")
    return None


def _number(text: str | None) -> int | None:
    return int(text) if text else None


def warc_date(date: str) -> str:
    """ISO 8601 of a 14-digit ARC date; shorter ones (old archives) are filled up to the first moment."""
    digits = (date + "00000101000000"[len(date) :])[:14]
    return f"{digits[:4]}-{digits[4:6]}-{digits[6:8]}T{digits[8:10]}:{digits[10:12]}:{digits[12:]}Z"


def record_id(record: ArcRecord, archive: str, digest: str) -> str:
    """Always the same id for the same record of an archive."""
    key = f"{archive}#{record.place} {record.url} {record.fields['Archive-date']} {digest}"
    return f"urn:uuid:{uuid.uuid5(_NAMESPACE, key)}"


def warc_type(record: ArcRecord) -> str:
    if record.place == 0:
        return "warcinfo"
    return "response" if record.content.startswith(b"HTTP/") else "resource"


def _base32(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


def warc_record(record: ArcRecord, archive: str, refers: dict | None) -> bytes:
    """The WARC record of an ARC record: identifiers, date, type and digests synthesised.

    With ``refers`` (record_id, url, date) it is a revisit, which keeps the HTTP headers but not the payload.
    """
    kind = warc_type(record)
    head, payload = split_http(record.content) if kind == "response" else (b"", record.content)
    digest = hashlib.sha1(payload).digest()
    block = head if refers else record.content
    media = {"warcinfo": "text/plain", "response": "application/http; msgtype=response"}
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if refers else kind}",
        f"WARC-Record-ID: <{record_id(record, archive, digest.hex())}>",
        f"WARC-Date: {warc_date(record.fields['Archive-date'])}",
    ]
    if kind == "warcinfo":
        lines.append(f"WARC-Filename: {archive}")
    else:
        lines += [
            f"WARC-Target-URI: {record.url}",
            f"WARC-IP-Address: {record.fields['IP-address']}",
            f"WARC-Payload-Digest: {_base32(digest)}",
        ]
    if refers:
        lines += [
            f"WARC-Profile: {REVISIT_PROFILE}",
            f"WARC-Refers-To: <{refers['record_id']}>",
            f"WARC-Refers-To-Target-URI: {refers['url']}",
            f"WARC-Refers-To-Date: {warc_date(refers['date'])}",
        ]
    lines += [
        f"WARC-Block-Digest: {_base32(hashlib.sha1(block).digest())}",
        f"Content-Type: {media.get(kind, record.fields['Content-type'])}",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def read_warc(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of the records of a gzip WARC file."""
    source = io.BufferedReader(gzip.GzipFile(fileobj=stream), 1 << 20)
    while line := source.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        headers = {}
        while (line := source.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        length = int(headers["content-length"])
        block = source.read(length)
        if len(block) != length:
            raise ValueError("a WARC record is shorter than its declared length")
        yield headers, block


def deflated(record: bytes) -> bytes:
    """A gzip member of its own, as archives have them."""
    tool = zlib.compressobj(1, zlib.DEFLATED, 31)
    return tool.compress(record) + tool.flush()


class _Archives:
    """Archive files of one task, a new one when the last is full."""

    def __init__(self, folder: str, kind: str, file_bytes: int, file_records: int):
        self.folder, self.kind = folder, kind
        self.file_bytes, self.file_records = file_bytes, file_records
        self.attempt = uuid.uuid4().hex
        self.count, self.stream, self.name, self.bytes, self.records = 0, None, "", 0, 0

    @property
    def full(self) -> bool:
        return self.stream is None or self.bytes >= self.file_bytes or self.records >= self.file_records

    def begin(self, name: str) -> None:
        self.name, self.bytes, self.records = name, 0, 0
        files, path = storage.open_uri(f"{self.folder}/{name}")
        self.stream = files.open_output_stream(path, compression=None)
        self.count += 1

    def add(self, record: bytes) -> None:
        data = deflated(record)
        self.stream.write(data)
        self.bytes += len(data)
        self.records += 1

    def end(self) -> pa.RecordBatch | None:
        if self.stream is None:
            return None
        self.stream.close()
        self.stream = None
        values = [pa.array([self.name]), pa.array([self.bytes]), pa.array([self.records])]
        return pa.RecordBatch.from_arrays(values, ["file", "bytes", "records"])


def _arc_header(version: int, url: str, date: str, kind: str, length: int, name: str, offset: int) -> bytes:
    common = f"{url} 0.0.0.0 {date} {kind}"
    if version == 1:
        return f"{common} {length}\n".encode()
    return f"{common} 200 - - {offset} {name} {length}\n".encode()


def _arc_url(url: str | None) -> str:
    """A URL as one word of a header line."""
    return "".join(c if c > " " else f"%{ord(c):02X}" for c in url) if url else "about:blank"


def write_arcs(pages: DataFrame, folder: str, file_bytes: int = FILE_BYTES, file_records: int = FILE_RECORDS) -> DataFrame:
    """ARC files of ``pages`` (page_id, url, html), both versions in turn; returns the manifest."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        out = _Archives(folder, "arc", file_bytes, file_records)
        version = 1
        for batch in batches:
            for page, url, html in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html"))):
                if out.full:
                    if done := out.end():
                        yield done
                    version = 1 + (part + out.count) % 2
                    out.begin(f"pages-{part:06d}-{out.count:04d}-{out.attempt}.arc.gz")
                    about = f"{version} 0 sheafspark\n{' '.join(ARC_FIELDS[version])}\n".encode()
                    first = _arc_header(version, f"filedesc://{out.name}", "20240101000000", "text/plain", len(about), out.name, 0)
                    out.add(first + about + b"\n")
                payload = (html or "").encode()
                named = "" if page is None else page
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n{ID_HEADER}: {named}\r\nContent-Length: {len(payload)}\r\n\r\n"
                content = head.encode() + payload
                second = (page or 0) % 86_400
                date = f"20240101{second // 3600:02d}{second // 60 % 60:02d}{second % 60:02d}"
                line = _arc_header(version, _arc_url(url), date, "text/html", len(content), out.name, out.bytes)
                out.add(line + content + b"\n")
        if done := out.end():
            yield done

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return stage(rows.mapInArrow(write, MANIFEST))


def _one_per_task(manifest: DataFrame) -> DataFrame:
    return manifest.repartition(max(1, min(manifest.count(), 10_000)))


def scan_arcs(manifest: DataFrame, folder: str) -> DataFrame:
    """Per URL record of the archives: place, page id, url, date, payload size, digest and WARC id."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("file").to_pylist():
                rows = []
                with storage.reading(f"{folder}/{name}") as stream:
                    for record in read_arc(stream):
                        if record.place == 0:
                            continue
                        head, payload = split_http(record.content)
                        digest = hashlib.sha1(payload).hexdigest()
                        page = _number(http_header(head, ID_HEADER))
                        rows.append((name, record.place, page, record.url, record.fields["Archive-date"], len(payload), digest, record_id(record, name, digest)))
                yield _rows(rows, SCAN)

    return _one_per_task(manifest).mapInArrow(scan, SCAN)


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}
    fields = [field.split() for field in schema.split(", ")]
    columns = list(zip(*rows)) or [()] * len(fields)
    arrays = [pa.array(c, kinds[kind]) for c, (_, kind) in zip(columns, fields)]
    return pa.RecordBatch.from_arrays(arrays, [name for name, _ in fields])


def revisit_decisions(scanned: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """Every record of the archives with the record it revisits (nulls if it stays as it is).

    The response of a digest is found by an aggregate that is combined before its shuffle; the join by digest is a plain
    one that Spark can split where a digest has very many records.
    """
    long = F.col("payload_bytes") >= least
    key = F.struct("page_id", "record_id", "url", "date")
    first = scanned.where(long).groupBy("digest").agg(F.max(key).alias("first"))
    joined = scanned.join(first.withColumnRenamed("digest", "_digest"), long & (F.col("digest") == F.col("_digest")), "left")
    other = F.col("first.record_id") != F.col("record_id")
    return joined.select(
        "file", "record", *[F.when(other, F.col(f"first.{c}")).alias(f"refers_{c}") for c in ("record_id", "url", "date")]
    )


def convert(decisions: DataFrame, n_files: int, arc_folder: str, warc_folder: str) -> DataFrame:
    """Convert each ARC file with the decisions about its records; returns the manifest of WARC files.

    A group is the decisions of one file, whose number of records is bounded. The decisions are thin and the files
    are not, so the number of tasks follows from the files and is not left to the size of the decisions.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        name = frame["file"].iloc[0]
        refers = {
            int(r.record): {"record_id": r.refers_record_id, "url": r.refers_url, "date": r.refers_date}
            for r in frame.itertuples()
            if isinstance(r.refers_record_id, str)
        }
        out = _Archives(warc_folder, "warc", 1 << 62, 1 << 62)
        out.begin(f"{name.removesuffix('.arc.gz')}-{out.attempt}.warc.gz")
        with storage.reading(f"{arc_folder}/{name}") as stream:
            for record in read_arc(stream):
                out.add(warc_record(record, name, refers.get(record.place)))
        return out.end().to_pandas()

    by_file = decisions.repartition(max(1, min(n_files, 10_000)), "file")
    return stage(by_file.groupBy("file").applyInPandas(run, MANIFEST))


def read_warcs(manifest: DataFrame, folder: str) -> DataFrame:
    """Responses and revisits of WARC files, digests checked."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("file").to_pylist():
                rows = []
                with storage.reading(f"{folder}/{name}") as stream:
                    for headers, block in read_warc(stream):
                        if _base32(hashlib.sha1(block).digest()) != headers["warc-block-digest"]:
                            raise ValueError(f"{name}: a block does not have its digest")
                        kind = headers["warc-type"]
                        if kind not in ("response", "revisit"):
                            continue
                        head, payload = split_http(block)
                        size = _number(http_header(head, "Content-Length"))
                        if kind == "response":
                            size = len(payload)
                            if _base32(hashlib.sha1(payload).digest()) != headers["warc-payload-digest"]:
                                raise ValueError(f"{name}: a payload does not have its digest")
                        digest = base64.b32decode(headers["warc-payload-digest"].removeprefix("sha1:")).hex()
                        refers = headers.get("warc-refers-to")
                        rows.append((_number(http_header(head, ID_HEADER)), size, digest, kind, headers["warc-record-id"].strip("<>"), refers and refers.strip("<>")))
                yield _rows(rows, READ)

    return _one_per_task(manifest).mapInArrow(read, READ)


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Per page, read back from WARC: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    arcs, warcs = storage.make_folder(spark), storage.make_folder(spark)
    manifest = write_arcs(pages, arcs)
    decisions = revisit_decisions(stage(scan_arcs(manifest, arcs)))
    found = stage(read_warcs(convert(decisions, manifest.count(), arcs, warcs), warcs))
    originals = found.where("record_type = 'response'").select(F.col("record_id").alias("_id"), F.col("page_id").alias("refers_to"))
    # Only revisits look for their response; a response has no reference and meets nothing.
    return found.join(originals, found["refers"] == originals["_id"], "left").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )
