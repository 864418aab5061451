"""WARC archives as a Spark data source, for reading and writing.

Reading plans a partition per stretch of a file. Of each record the headers are
inflated and parsed first. Filters on the columns of ``HEADER_COLUMNS`` are
pushed down (where Spark's setting for Python sources is on) and applied to the
headers; the payload of a record that fails them, or of every record under the
option ``payload=false``, is neither inflated nor decoded.

Writing makes one file per task, each record a gzip member of its own. A member
notes its size in the ``sl`` field of the gzip header, so a reader can skip it.
A task's file counts only if the job's manifest lists it, so files of lost or
repeated tasks are ignored. Files by others, without manifest or sizes, compressed
or not, are read too, each as one partition.

Defined results: a null payload is written as an empty one. A null uri, date or
id has no header and is null again on reading. Control characters in a header
value are percent-encoded. An empty table gives an archive without records.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    In,
    InputPartition,
    IsNotNull,
    StringStartsWith,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

from wardflow.llm.files import located, write_bytes
from wardflow.session import run_dir, settle

SCHEMA = ("record_id string, record_type string, target_uri string, warc_date string, "
          "refers_to string, payload_digest string, payload_bytes long, payload binary")
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
HEADER_COLUMNS = {
    "record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri",
    "warc_date": "warc-date", "refers_to": "warc-refers-to",
    "payload_digest": "warc-payload-digest",
}
# A partition reads about this many bytes of a file with noted offsets.
SPLIT_BYTES = 32 << 20
_BATCH_BYTES = 4 << 20
_HEAD_BYTES = 4096
_MANIFEST = "_manifest"
_CONTROL = re.compile(r"[\x00-\x20\x7f]")
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def digest(payload: bytes) -> str:
    """SHA-1 in upper-case base 32."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# -- records ------------------------------------------------------------------

def record(row: dict) -> bytes:
    """One uncompressed record. A revisit holds the headers of its response only."""
    payload = row["payload"] or b""
    if row["record_type"] in ("response", "revisit"):
        kind = "application/http; msgtype=response"
        block = _HTTP % len(payload) + (payload if row["record_type"] == "response" else b"")
    else:
        kind, block = "application/octet-stream", payload
    head = [("WARC-Type", row["record_type"]), ("WARC-Record-ID", row["record_id"]),
            ("WARC-Date", row["warc_date"]), ("WARC-Target-URI", row["target_uri"]),
            ("WARC-Refers-To", row["refers_to"]),
            ("WARC-Payload-Digest", "sha1:" + digest(payload)),
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
             if row["record_type"] == "revisit" else None),
            ("X-Payload-Length", str(len(payload))),
            ("Content-Type", kind), ("Content-Length", str(len(block)))]
    lines = [f"{name}: " + _CONTROL.sub(lambda m: f"%{ord(m.group()):02X}", str(value))
             if name != "Content-Type" else f"{name}: {value}"
             for name, value in head if value is not None]
    return "\r\n".join(["WARC/1.1", *lines, "", ""]).encode() + block + b"\r\n\r\n"


def member(raw: bytes) -> bytes:
    """A gzip member that notes its own and its content's size."""
    packer = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = packer.compress(raw) + packer.flush()
    size = 24 + len(body) + 8
    return (b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x0c\0sl\x08\0" + struct.pack("<II", size, len(raw))
            + body + struct.pack("<II", zlib.crc32(raw), len(raw)))


def _headers(head: bytes) -> dict[str, str]:
    found = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            found[name.strip().lower()] = value.strip()
    return found


def _row(headers: dict[str, str]) -> dict:
    row = {c: headers.get(h) for c, h in HEADER_COLUMNS.items()}
    if row["payload_digest"]:
        row["payload_digest"] = row["payload_digest"].removeprefix("sha1:")
    length = headers.get("x-payload-length")
    row["payload_bytes"] = int(length) if length else None
    return row


def _payload(headers: dict[str, str], block: bytes) -> bytes | None:
    if headers.get("warc-type") == "revisit":
        return None
    if headers.get("content-type", "").startswith("application/http"):
        return block.partition(b"\r\n\r\n")[2]
    return block


def _matches(row: dict, filters: list) -> bool:
    for f in filters:
        value = row.get(f.attribute[0])
        if isinstance(f, EqualTo) and (value is None or value != f.value):
            return False
        if isinstance(f, In) and value not in f.value:
            return False
        if isinstance(f, IsNotNull) and value is None:
            return False
        if isinstance(f, StringStartsWith) and not (value or "").startswith(f.value):
            return False
    return True


# -- reading ------------------------------------------------------------------

class Stretch(InputPartition):
    """Records of a file that begin in a range of offsets; no end: the whole rest."""

    def __init__(self, uri: str, start: int, end: int | None):
        self.uri, self.start, self.end = uri, start, end


def _inflated(source, start: int, wanted):
    """Headers, block and end of a gzip member of unknown size.

    Of a member whose headers are not ``wanted`` only the head is held: what follows is
    inflated for its end, chunk by chunk, and dropped.
    """
    unpack, head, headers, block = zlib.decompressobj(31), b"", None, []
    source.seek(start)
    read = 0
    while not unpack.eof:
        chunk = source.read(1 << 16)
        if not chunk:
            raise ValueError("a gzip member is cut off")
        read += len(chunk)
        while True:
            raw = unpack.decompress(chunk, 1 << 20)
            full = len(raw) == 1 << 20
            if headers is None:
                head += raw
                if b"\r\n\r\n" in head:
                    head, _, raw = head.partition(b"\r\n\r\n")
                    headers = _headers(head)
                    keep = wanted(headers)
            if headers is not None and keep:
                block.append(raw)
            chunk = unpack.unconsumed_tail
            if unpack.eof or not (chunk or full):
                break
    if headers is None:
        headers = _headers(head)
    return headers, b"".join(block), start + read - len(unpack.unused_data)


def _whole(row: dict, payload: bytes | None) -> dict:
    """``row`` with its payload, which must be the one whose digest was written."""
    if payload is not None and row["payload_digest"] != digest(payload):
        raise ValueError(f"the payload of {row['record_id']} does not have its digest")
    return {**row, "payload": payload}


def _records(source, size: int, start: int, end: int, filters: list, wanted: bool):
    """Rows of the records that begin in ``[start, end)``."""
    at = start
    while at < min(end, size):
        source.seek(at)
        first = source.read(24)
        if first[:2] != b"\x1f\x8b":
            at, row = _plain(source, at, size, filters, wanted)
        elif len(first) == 24 and first[3] == 4 and first[12:14] == b"sl":
            length = struct.unpack("<I", first[16:20])[0]
            body = source.read(min(_HEAD_BYTES, length - 24))
            unpack = zlib.decompressobj(-15)
            raw = unpack.decompress(body, 2 * _HEAD_BYTES)
            while b"\r\n\r\n" not in raw and not unpack.eof:
                raw += unpack.decompress(unpack.unconsumed_tail or source.read(_HEAD_BYTES),
                                         2 * _HEAD_BYTES)
            head, _, block = raw.partition(b"\r\n\r\n")
            headers = _headers(head)
            row = _row(headers)
            if not _matches(row, filters):
                row = None
            elif wanted and row["record_type"] != "revisit":
                left = at + length - source.tell()
                block += unpack.decompress(unpack.unconsumed_tail + source.read(left))
                block = block[:int(headers.get("content-length", 0))]
                row = _whole(row, _payload(headers, block))
            at += length
        else:
            headers, block, at = _inflated(
                source, at, lambda h: wanted and _matches(_row(h), filters))
            row = _row(headers)
            if not _matches(row, filters):
                row = None
            elif wanted:
                row["payload"] = _payload(headers, block[:int(headers.get("content-length", 0))])
        if row is not None:
            yield row


def _plain(source, at: int, size: int, filters: list, wanted: bool):
    """A record that is not compressed: its end and its row, if it passes."""
    source.seek(at)
    raw = b""
    while b"\r\n\r\n" not in raw:
        chunk = source.read(_HEAD_BYTES)
        if not chunk:
            return size, None  # blank lines at the end
        raw = (raw + chunk).lstrip(b"\r\n") if not raw else raw + chunk
    skipped = source.tell() - at - len(raw)
    head, _, _ = raw.partition(b"\r\n\r\n")
    headers = _headers(head)
    start = at + skipped + len(head) + 4
    length = int(headers.get("content-length", 0))
    row = _row(headers)
    if not _matches(row, filters):
        return start + length + 4, None
    if wanted:
        source.seek(start)
        row["payload"] = _payload(headers, source.read(length))
    return start + length + 4, row


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payload: bool):
        self._path, self._payload, self._filters = path, payload, []

    def pushFilters(self, filters):
        for f in filters:
            simple = isinstance(f, (EqualTo, In, IsNotNull, StringStartsWith))
            if simple and len(f.attribute) == 1 and f.attribute[0] in HEADER_COLUMNS:
                self._filters.append(f)
            else:
                yield f

    def partitions(self):
        fs, path = located(self._path)
        listed = f"{path}/{_MANIFEST}"
        if fs.get_file_info(listed).type == pafs.FileType.File:
            with fs.open_input_stream(listed) as source:
                files = json.loads(source.read())
            return [Stretch(f"{self._path}/{name}", *span) for name, starts, size in files
                    for span in zip(starts, [*starts[1:], size], strict=True)]
        info = fs.get_file_info(path)
        if info.type == pafs.FileType.File:
            return [Stretch(self._path, 0, None)]
        found = fs.get_file_info(pafs.FileSelector(path))
        return [Stretch(f"{self._path}/{x.base_name}", 0, None) for x in found
                if x.base_name.endswith((".warc", ".warc.gz"))]

    def read(self, partition: Stretch | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # an archive without files
            return
        fs, path = located(partition.uri)
        names = pa.schema([(c, pa.int64() if c == "payload_bytes" else
                            pa.binary() if c == "payload" else pa.string()) for c in COLUMNS])
        size = fs.get_file_info(path).size
        with fs.open_input_file(path) as source:
            rows, held = [], 0
            for row in _records(source, size, partition.start,
                                size if partition.end is None else partition.end,
                                self._filters, self._payload):
                rows.append(row)
                held += len(row.get("payload") or b"") + 512
                if held > _BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema=names)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=names)


# -- writing ------------------------------------------------------------------

class Written(WriterCommitMessage):
    def __init__(self, name: str, starts: list[int], size: int):
        self.name, self.starts, self.size = name, starts, size


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self._path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        name = f"part-{uuid.uuid4().hex}.warc.gz"
        fs, path = located(f"{self._path}/{name}")
        fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
        starts, at = [], 0
        with fs.open_output_stream(path, compression=None) as out:
            for batch in iterator:
                for row in batch.to_pylist():
                    if not starts or at - starts[-1] >= SPLIT_BYTES:
                        starts.append(at)
                    packed = member(record(row))
                    out.write(packed)
                    at += len(packed)
        return Written(name, starts, at)

    def commit(self, messages) -> None:
        files = sorted((m.name, m.starts, m.size) for m in messages if m is not None and m.size)
        write_bytes(f"{self._path}/{_MANIFEST}", json.dumps(files).encode())

    def abort(self, messages) -> None:
        """Nothing to undo: without a manifest entry a file does not count."""


class WarcSource(DataSource):
    """``format("warc")``; options ``path`` and ``payload`` (true by default)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options["path"].rstrip("/"),
                          self.options.get("payload", "true").lower() != "false")

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"].rstrip("/"))


def register(spark: SparkSession) -> None:
    """Make the source known to a session and let Spark push filters to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


# -- pages --------------------------------------------------------------------

def page_records(pages: DataFrame, page_id: str, url: str, payload: Column) -> DataFrame:
    """A record per page: of pages with equal payloads all but the last are revisits.

    The rows that hold a payload's greatest id are its responses. A null id takes
    no part and is a response.
    """
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"),
                        F.coalesce(payload, F.lit("").cast("binary")).alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload"))
    # Few rows, written so that the join with a hot payload can be split.
    last = settle(rows.groupBy("sha1").agg(F.max("page_id").alias("last_id"),
                                           F.count("page_id").alias("_n"))
                  .filter("_n > 1").drop("_n"), "repeated-payloads")
    revisit = F.coalesce(F.col("page_id") < F.col("last_id"), F.lit(False))
    name = F.concat(F.lit("<urn:page:"), F.col("page_id").cast("string"), F.lit(">"))
    return rows.join(last, "sha1", "left").select(
        name.alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.col("url").alias("target_uri"), F.lit("2024-01-01T00:00:00Z").alias("warc_date"),
        F.when(revisit, F.concat(F.lit("<urn:page:"), F.col("last_id").cast("string"),
                                 F.lit(">"))).alias("refers_to"),
        F.lit(None).cast("string").alias("payload_digest"),
        F.lit(None).cast("long").alias("payload_bytes"), "payload")


def archived(pages: DataFrame, page_id: str = "page_id", url: str = "url",
             html: str = "html", path: str | None = None) -> DataFrame:
    """The records of the pages, written to an archive and read back."""
    spark = pages.sparkSession
    register(spark)
    path = path or run_dir(spark, "warc")
    (page_records(pages, page_id, url, F.col(html).cast("binary")).write.format("warc")
     .mode("append").option("path", path).save())
    return spark.read.format("warc").option("path", path).load()
