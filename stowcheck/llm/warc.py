"""WARC archives as a PySpark Python data source, format ``warc``.

Reading plans one partition per file, parses a record's headers first, and passes over the block of a record
that the pushed filters reject, or whose payload isn't wanted, without reading or decoding it. Pushed are
comparisons of ``record_type``, ``record_id``, ``target_uri`` and ``payload_digest`` with literals.

Writing rolls files at ``max_file_bytes``. A task writes hidden files; the driver gives them their names when
all tasks have succeeded, so that attempts of lost executors leave nothing that is read.

Paths may lie in any file system that pyarrow reaches (``file``, ``hdfs``, ``s3``, ``gs``); ``.warc.gz`` is
read too. Payloads of response records are stored as HTTP messages with a gzip body, those of other records
as they are.

Archives of any writer are read: header values stay as written, but for RFC 2047 encoded words, which the
format allows and this writer uses for values that don't fit a line. Folded lines are joined by a space;
headers of one name, in any case, by ``, ``, and of a field the first counts. The payload of an HTTP message,
request or response, is its body, chunks joined, gzip and deflate decoded; a body that doesn't decode, and any
other block, is its own payload.

Defined results: a response's NULL payload is written as an empty one, others' leave the record without a
block; a record without a block has a NULL payload; NULL headers and fields are left out and read as NULL;
repeated rows are repeated records; an empty table makes an archive without files, which reads as empty.
Truncated records raise an error, whether their payload is wanted or not, and so does writing a header whose
name is no token or belongs to a field.
"""

from __future__ import annotations

import base64
import gzip
import io
import posixpath
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from email.errors import HeaderParseError
from email.header import decode_header, make_header

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    In,
    InputPartition,
    StringStartsWith,
    WriterCommitMessage,
)

SCHEMA = (
    "record_type string, record_id string, target_uri string, date string, payload_digest string, "
    "refers_to string, headers map<string,string>, payload binary"
)
FIELDS = {
    "record_type": "WARC-Type",
    "record_id": "WARC-Record-ID",
    "target_uri": "WARC-Target-URI",
    "date": "WARC-Date",
    "payload_digest": "WARC-Payload-Digest",
    "refers_to": "WARC-Refers-To",
}
PUSHED = ("record_type", "record_id", "target_uri", "payload_digest")
ARROW = pa.schema(
    [(name, pa.string()) for name in FIELDS] + [("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())]
)
BATCH_BYTES = 8 << 20
RESERVED = {field.lower() for field in FIELDS.values()} | {"content-length"}
TOKEN = re.compile(r"[!#$%&'*+.^_`|~0-9A-Za-z-]+")
_WORD = r"=\?[^?\s]+\?[bBqQ]\?[^?\s]*\?="
ENCODED_WORDS = re.compile(rf"{_WORD}(?:\s+{_WORD})*")


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _header_value(value: str) -> str:
    """A value that stands on one line: itself, or one encoded word."""
    if re.search(r"[\x00-\x1F\x7F\x85\u2028\u2029]|^\s|\s$|=\?", value):
        return f"=?utf-8?B?{base64.b64encode(value.encode()).decode()}?="
    return value


def _plain_value(value: str) -> str:
    """A header value as meant: a sequence of encoded words is decoded, all else is untouched."""
    if not ENCODED_WORDS.fullmatch(value):
        return value
    try:
        return str(make_header(decode_header(value)))
    except (HeaderParseError, LookupError, ValueError):
        return value


def record_bytes(fields: dict[str, str | None], headers: list[tuple[str, str | None]], payload: bytes | None) -> bytes:
    """One record. A response's block is an HTTP message; the block of others is their payload, if any."""
    is_response = fields.get("record_type") == "response"
    headers = [(name, value) for name, value in headers if not (is_response and name.lower() == "content-type")]
    for name, _ in headers:
        if not TOKEN.fullmatch(name) or name.lower() in RESERVED:
            raise ValueError(f"not a name for a further WARC header: {name!r}")
    block = payload or b""
    if is_response:
        body = gzip.compress(block, 5, mtime=0)
        block = b"HTTP/1.1 200 OK\r\nContent-Encoding: gzip\r\nContent-Length: %d\r\n\r\n" % len(body) + body
        headers.append(("Content-Type", "application/http;msgtype=response"))
    lines = ["WARC/1.1"]
    named = [(FIELDS[name], value) for name, value in fields.items()]
    lines += [f"{name}: {_header_value(value)}" for name, value in [*named, *headers] if value is not None]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _joined_chunks(body: bytes) -> bytes:
    parts, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].partition(b";")[0], 16)
        at = end + 2
        if not size:
            return b"".join(parts)
        if at + size > len(body):
            raise ValueError("chunk ends early")
        parts.append(body[at : at + size])
        at += size + 2


def _payload(block: bytes, content_type: str) -> bytes:
    """The decoded body of an HTTP message; another block, or a body that doesn't decode, as it is."""
    if not (block.startswith(b"HTTP/") or content_type.lower().startswith("application/http")):
        return block
    head, _, body = block.partition(b"\r\n\r\n")
    fields = re.findall(rb"(?m)^([^:\r\n]+):[ \t]*([^\r\n]*)", head)
    http = {name.strip().lower(): value.strip().lower() for name, value in fields}
    try:
        plain = _joined_chunks(body) if http.get(b"transfer-encoding") == b"chunked" else body
    except ValueError:
        # archives often keep the header of a body whose chunks were joined
        plain = body
    try:
        coding = http.get(b"content-encoding")
        if coding in (b"gzip", b"x-gzip"):
            return gzip.decompress(plain)
        return zlib.decompress(plain) if coding == b"deflate" else plain
    except (OSError, EOFError, zlib.error):
        return plain


def _headers(stream) -> dict[str, tuple[str, str]]:
    """Headers up to the empty line: name as first written and value, by lower-case name."""
    lines: list[str] = []
    while True:
        line = stream.readline()
        if not line.endswith(b"\n"):
            raise ValueError("truncated WARC record")
        if not line.strip():
            break
        text = line.decode("utf-8", "replace")
        if text[0] in " \t" and lines:
            lines[-1] += " " + text.strip()
        else:
            lines.append(text.strip())
    found: dict[str, tuple[str, str]] = {}
    for text in lines:
        name, _, value = text.partition(":")
        name, value = name.strip(), _plain_value(value.strip())
        first = found.get(name.lower())
        if first is None:
            found[name.lower()] = (name, value)
        elif name.lower() not in RESERVED:
            found[name.lower()] = (first[0], f"{first[1]}, {value}")
    return found


def read_records(stream, accept, with_payload: bool) -> Iterator[dict]:
    """Records of an open archive whose fields ``accept`` agrees to; blocks of the others are skipped."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at {line[:40]!r}")
        headers = _headers(stream)
        if "content-length" not in headers:
            raise ValueError("WARC record without Content-Length")
        length = int(headers["content-length"][1])
        record = {name: headers.get(field.lower(), (None, None))[1] for name, field in FIELDS.items()}
        accepted = accept(record)
        record["payload"] = None
        if accepted and with_payload and length:
            block = stream.read(length)
            if len(block) < length:
                raise ValueError("truncated WARC record")
            record["payload"] = _payload(block, headers.get("content-type", ("", ""))[1])
        elif length:
            # the last byte shows that the block is whole
            stream.seek(length - 1, 1)
            if not stream.read(1):
                raise ValueError("truncated WARC record")
        if accepted:
            record["headers"] = [pair for name, pair in headers.items() if name not in RESERVED]
            yield record


@dataclass
class WarcFile(InputPartition):
    path: str


class WarcReader(DataSourceReader):
    def __init__(self, path: str, with_payload: bool):
        self.path, self.with_payload, self.filters = path, with_payload, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo | In | StringStartsWith) and len(f.attribute) == 1 and f.attribute[0] in PUSHED:
                self.filters.append(f)
            else:
                yield f

    def accepts(self, record: dict) -> bool:
        for f in self.filters:
            value = record[f.attribute[0]]
            if value is None:
                return False
            if isinstance(f, EqualTo) and value != f.value:
                return False
            if isinstance(f, In) and value not in f.value:
                return False
            if isinstance(f, StringStartsWith) and not value.startswith(f.value):
                return False
        return True

    def partitions(self) -> list[InputPartition]:
        system, path = _open(self.path)
        found = system.get_file_info(fs.FileSelector(path, recursive=False, allow_not_found=True))
        names = [f.path for f in found if f.is_file and re.fullmatch(r"[^._].*\.warc(\.gz)?", f.base_name)]
        return [WarcFile(name) for name in sorted(names)] or [WarcFile("")]

    def read(self, partition: WarcFile) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        system, _ = _open(self.path)
        rows, size = [], 0
        with system.open_input_file(partition.path) as raw:
            raw = gzip.GzipFile(fileobj=raw) if partition.path.endswith(".gz") else raw
            stream = io.BufferedReader(raw, 1 << 18)
            for record in read_records(stream, self.accepts, self.with_payload):
                rows.append(record)
                size += 500 + len(record["payload"] or b"")
                if size > BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, ARROW)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, ARROW)


@dataclass
class WarcCommit(WriterCommitMessage):
    files: list[str]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, max_file_bytes: int):
        self.path, self.max_file_bytes = path, max_file_bytes

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WarcCommit:
        system, path = _open(self.path)
        system.create_dir(path, recursive=True)
        files, out, size = [], None, 0
        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    if out is None:
                        files.append(posixpath.join(path, f".{uuid.uuid4().hex}.warc"))
                        out, size = system.open_output_stream(files[-1]), 0
                    fields = {name: row.get(name) for name in FIELDS}
                    data = record_bytes(fields, list(row.get("headers") or []), row.get("payload"))
                    out.write(data)
                    size += len(data)
                    if size >= self.max_file_bytes:
                        out.close()
                        out = None
        finally:
            if out is not None:
                out.close()
        return WarcCommit(files)

    def commit(self, messages: list[WarcCommit | None]) -> None:
        system, path = _open(self.path)
        for message in messages:
            for name in message.files if message else []:
                system.move(name, posixpath.join(path, posixpath.basename(name).lstrip(".")))

    def abort(self, messages: list[WarcCommit | None]) -> None:
        system, _ = _open(self.path)
        for message in messages:
            for name in message.files if message else []:
                system.delete_file(name)


class WarcDataSource(DataSource):
    """Options: ``path``; ``payload`` (``false`` reads headers only); ``max_file_bytes`` for writing."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], self.options.get("payload", "true").lower() == "true")

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], int(self.options.get("max_file_bytes", 128 << 20)))


def write_warc(records: DataFrame, path: str, **options) -> None:
    """Records with the columns of SCHEMA, or some of them; ``record_type`` is needed."""
    records.sparkSession.dataSource.register(WarcDataSource)
    records.write.format("warc").mode("append").options(**options).save(path)


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    spark.dataSource.register(WarcDataSource)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)
