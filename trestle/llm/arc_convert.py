"""Legacy web archives (ARC) to WARC, and reading WARC back.

An ARC file begins with a version block whose header line names the file; the
block says which version the file has and so which fields a header line has
(version 1: URL, IP, date, type, length; version 2: also result code, checksum,
location, offset and file name).  Records follow one another: header line, as
many bytes as it declares, line feed.  The converter reads lines and declared
lengths only (never searches for a separator), and makes a WARC record of each
with the equivalent identifier, timestamp, type and digests.  Identifiers are
name-based UUIDs, so a repeated task writes the same ones.

Of records with equal payloads (by SHA-1, at least ``min_bytes`` long) the one
with the largest page id is written in full; the others become revisit records
that refer to it and hold the HTTP header only.

On Spark: archives are rows of one binary value, written by the text writer as
gzip files of one row each: real archives, on any file system that Spark knows,
with Spark's commit protocol, so a lost executor leaves no half archive behind.
Reading is ``binaryFile``.  An archive holds about ``archive_bytes`` (or one
larger record), which bounds the memory of a task.  Digests are compared in a
narrow table (a partial aggregate per digest, then a join with the digests that
occur more than once); payloads are shuffled once, by record, never by digest,
so a payload with a third of all rows stays spread.

Defined results: null html is an empty payload; a null id is below all others
and stays null; rows with equal ids and payloads are told apart by their place
in the archive, one is the response; a header line's URL is percent-encoded
where it has white space, a null URL is ``urn:none``; a body that ends before
its declared length is marked ``WARC-Truncated``; an empty table gives an empty
result.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trestle.llm.common import quoted, scratch_dir, utf8

# The formats' field names and media types.
_V1 = b"URL IP-address Archive-date Content-type Archive-length"
_V2 = b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"
_HTTP = "application/http; msgtype=response"
_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
_PAGE = b"X-Page-Id"
_NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:trestle:arc")


@dataclass(frozen=True)
class ArcRecord:
    url: bytes
    ip: bytes
    date: bytes  # 14 digits
    kind: bytes  # media type
    body: bytes
    declared: int
    version: int

    @property
    def is_http(self) -> bool:
        return self.body.startswith(b"HTTP/") and self.url[:4].lower() == b"http" or self.body.startswith(b"HTTP/1.")

    def split(self) -> tuple[bytes, bytes]:
        """(HTTP header, payload); the header is empty for other records."""
        if not self.is_http:
            return b"", self.body
        end = re.search(rb"\r?\n\r?\n", self.body)
        return (self.body[: end.end()], self.body[end.end() :]) if end else (self.body, b"")


# ---------------------------------------------------------------- ARC


def arc_line(version: int, url: bytes, ip: bytes, date: bytes, kind: bytes, body: bytes, status: bytes = b"200", name: bytes = b"-") -> bytes:
    """A version-specific header line."""
    url = re.sub(rb"[\x00-\x20]", lambda m: b"%%%02X" % m[0][0], url) or b"urn:none"
    if version == 1:
        return b" ".join((url, ip, date, kind, b"%d" % len(body))) + b"\n"
    checksum = hashlib.md5(body).hexdigest().encode()
    return b" ".join((url, ip, date, kind, status, checksum, b"-", b"0", name, b"%d" % len(body))) + b"\n"


def version_block(version: int, name: bytes, date: bytes) -> bytes:
    body = b"%d 0 trestle\n%s\n" % (version, _V1 if version == 1 else _V2)
    return arc_line(version, b"filedesc://" + name, b"0.0.0.0", date, b"text/plain", body, name=name) + body + b"\n"


def read_arc(data: bytes) -> Iterator[ArcRecord]:
    """The records of an archive, its version blocks left out."""
    at, version = 0, 1
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):  # what separates records
            at += 1
            continue
        end = data.find(b"\n", at)
        line = data[at : end if end >= 0 else len(data)].rstrip(b"\r")
        start = end + 1 if end >= 0 else len(data)
        if line.startswith(b"filedesc://"):
            length = int(line.rsplit(b" ", 1)[1])
            block = data[start : start + length]
            version = int(block.split(None, 1)[0])
            at = start + length
            continue
        # URLs of old crawlers may hold spaces: the fields count from the right
        fields = line.rsplit(b" ", 4 if version == 1 else 9)
        if len(fields) != (5 if version == 1 else 10):
            raise ValueError(f"not a version {version} header line at byte {at}")
        length = int(fields[-1])
        yield ArcRecord(fields[0], fields[1], fields[2], fields[3], data[start : start + length], length, version)
        at = start + length


def write_arc(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    date: str = "20080430204825",
    archive_bytes: int = 16 << 20,
) -> None:
    """``pages`` as ARC files under ``path``; versions 1 and 2 take turns."""
    stamp = date.encode()

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, bytes, bytes]]:
        for b in batches:
            for page, url, html in zip(b.column(0).to_pylist(), utf8(b.column(1)), utf8(b.column(2)), strict=True):
                payload = html or b""
                own = b"" if page is None else b"%s: %d\r\n" % (_PAGE, page)
                head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n%sContent-Length: %d\r\n\r\n" % (own, len(payload))
                yield url or b"", head, payload

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[bytes] = []
        size, turn = 0, TaskContext.get().partitionId()
        for url, head, payload in records(batches):
            version = 1 + turn % 2
            if not parts:
                parts.append(version_block(version, b"archive-%d.arc" % turn, stamp))
            body = head + payload
            parts += [arc_line(version, url, b"0.0.0.0", stamp, b"text/html", body), body, b"\n"]
            size += len(body)
            if size >= archive_bytes:
                yield _row(parts)
                parts, size, turn = [], 0, turn + 1
        if parts:
            yield _row(parts)

    rows = pages.select(F.col(quoted(id_col)).cast("long"), F.col(quoted(url_col)), F.col(quoted(html_col)))
    _write(rows.mapInArrow(run, "value binary"), path, "\n")


def _row(parts: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary())], names=["value"])


def _write(archives: DataFrame, path: str, after: str) -> None:
    """One gzip file per row; ``after`` ends each file."""
    options = {"compression": "gzip", "lineSep": after, "maxRecordsPerFile": 1}
    archives.select(F.col("value").cast("string")).write.options(**options).text(path)


def _archives(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")


def _data(content: bytes) -> bytes:
    return gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content


# ---------------------------------------------------------------- WARC


def _digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def page_of(head: bytes) -> int | None:
    m = re.search(rb"^X-Page-Id: *(-?\d+)", head, re.M | re.I)
    return int(m[1]) if m else None


def _iso(date: bytes) -> str:
    d = (date.decode("ascii", "replace") + "00000101000000"[len(date) :])[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(place: str, url: bytes, date: bytes) -> str:
    """The identifier of a record: a UUID of its place in the archives, URL and date."""
    return f"urn:uuid:{uuid.uuid5(_NAMESPACE, f'{place} {url.decode("utf-8", "replace")} {date.decode("ascii", "replace")}')}"


def warc_record(fields: Iterable[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", len(block))])
    return b"WARC/1.0\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def read_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields by lower-case name, block) of each record, by declared lengths."""
    at = 0
    while at < len(data):
        if data[at : at + 2] == b"\r\n":
            at += 2
            continue
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record at byte {at}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        length = int(fields["content-length"])
        yield fields, data[end + 4 : end + 4 + length]
        at = end + 4 + length


_RECORD = "place string, page long, url binary, ip binary, date binary, kind binary, head binary, payload binary, declared long, digest string, size long"


def arc_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the ARC files under ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), *[pa.binary()] * 6, pa.int64(), pa.string(), pa.int64()]
        names = [x.split()[0] for x in _RECORD.split(", ")]
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows, size = [], 0
                for i, r in enumerate(read_arc(_data(content.as_py()))):
                    head, payload = r.split()
                    place = f"{name.rsplit('/', 1)[-1]}:{i}"
                    size += len(r.body)
                    rows.append(
                        (place, page_of(head), r.url, r.ip, r.date, r.kind, head, payload, r.declared, _digest(payload), len(payload))
                    )
                    if size >= 4 << 20:
                        yield _batch(rows, kinds, names)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows, kinds, names)

    return _archives(spark, path).mapInArrow(run, _RECORD)


def _batch(rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def decisions(records: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(of, to_place, to_page, to_url, to_date): the revisits and the response each refers to."""
    narrow = records.select("place", "page", "url", "date", "digest", "size").where(F.col("size") >= min_bytes)
    # the largest page id, null ids last; then the largest place
    rank = F.struct(F.col("page").isNotNull().alias("named"), "page", "place", "url", "date")
    repeated = narrow.groupBy(F.col("digest").alias("same")).agg(F.max(rank).alias("to"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return (
        narrow.select("place", "digest")
        .join(repeated, F.col("digest") == F.col("same"))
        .where("place <> to.place")
        .select(F.col("place").alias("of"), *[F.col(f"to.{c}").alias(f"to_{c}") for c in ("place", "page", "url", "date")])
    )


def convert(spark: SparkSession, arc_path: str, warc_path: str, min_bytes: int = 0, archive_bytes: int = 16 << 20) -> None:
    """The ARC files under ``arc_path`` as WARC files under ``warc_path``."""
    records = arc_records(spark, arc_path)
    joined = records.join(decisions(arc_records(spark, arc_path), min_bytes), F.col("place") == F.col("of"), "left").drop("of", "size")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[bytes] = []
        size = 0
        for b in batches:
            for r in b.to_pylist():
                made = _converted(r)
                if not parts:
                    info = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<{record_id(r['place'] + ' info', r['url'], r['date'])}>")]
                    info += [("WARC-Date", _iso(r["date"])), ("Content-Type", "application/warc-fields")]
                    parts.append(warc_record(info, b"software: trestle\r\nformat: WARC File Format 1.0\r\n"))
                parts.append(made)
                size += len(made)
                if size >= archive_bytes:
                    yield _row([*parts[:-1], parts[-1][:-4]])
                    parts, size = [], 0
        if parts:
            yield _row([*parts[:-1], parts[-1][:-4]])

    _write(joined.mapInArrow(run, "value binary"), warc_path, "\r\n\r\n")


def _converted(r: dict) -> bytes:
    """The WARC record of a row of ``arc_records`` with its decision."""
    http = bool(r["head"])
    revisit = r["to_place"] is not None
    kind = "revisit" if revisit else "response" if http else "resource"
    block = r["head"] if revisit else r["head"] + r["payload"]
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<{record_id(r['place'], r['url'], r['date'])}>"),
        ("WARC-Date", _iso(r["date"])),
        ("WARC-Target-URI", r["url"].decode("utf-8", "replace")),
        ("WARC-IP-Address", r["ip"].decode("ascii", "replace")),
        ("WARC-Payload-Digest", f"sha1:{r['digest']}"),
        ("WARC-Block-Digest", f"sha1:{_digest(block)}"),
        ("X-Payload-Length", str(len(r["payload"]))),
        ("Content-Type", _HTTP if http else r["kind"].decode("ascii", "replace")),
    ]
    if r["page"] is not None:
        fields.append((_PAGE.decode(), str(r["page"])))
    if len(r["head"]) + len(r["payload"]) < r["declared"]:
        fields.append(("WARC-Truncated", "length"))
    if revisit:
        fields += [
            ("WARC-Profile", _PROFILE),
            ("WARC-Refers-To", f"<{record_id(r['to_place'], r['to_url'], r['to_date'])}>"),
            ("WARC-Refers-To-Target-URI", r["to_url"].decode("utf-8", "replace")),
            ("WARC-Refers-To-Date", _iso(r["to_date"])),
        ]
        if r["to_page"] is not None:
            fields.append(("X-Refers-To-Page", str(r["to_page"])))
    return warc_record(fields, block)


_READ = "page_id long, url string, record_id string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def warc_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the WARC files under ``path``, warcinfo records left out.

    The digest and length of every payload that a record holds are checked.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        names = [x.split()[0] for x in _READ.split(", ")]
        for b in batches:
            for content in b.column(1):
                rows = []
                for f, block in read_warc(_data(content.as_py())):
                    kind = f["warc-type"]
                    if kind == "warcinfo":
                        continue
                    digest = f["warc-payload-digest"].removeprefix("sha1:")
                    length = int(f.get("x-payload-length", -1))
                    if kind != "revisit":
                        end = re.search(rb"\r?\n\r?\n", block) if f["content-type"] == _HTTP else None
                        payload = block[end.end() :] if end else block
                        if _digest(payload) != digest:
                            raise ValueError(f"payload of {f['warc-record-id']} doesn't match its digest")
                        length = len(payload)
                    page, to = f.get("x-page-id"), f.get("x-refers-to-page")
                    rows.append(
                        (
                            None if page is None else int(page), f["warc-target-uri"], f["warc-record-id"].strip("<>"),
                            length, digest, kind, None if to is None else int(to),
                        )
                    )
                if rows:
                    yield _batch(rows, kinds, names)

    return _archives(spark, path).mapInArrow(run, _READ)


def round_trip(pages: DataFrame, min_bytes: int = 0, archive_bytes: int = 16 << 20) -> DataFrame:
    """``pages`` through ARC files and the converter: the records of the WARC files, read back."""
    spark = pages.sparkSession
    arc, warc = scratch_dir(spark) + "-arc", scratch_dir(spark) + "-warc"
    write_arc(pages, arc, archive_bytes=archive_bytes)
    convert(spark, arc, warc, min_bytes, archive_bytes)
    return warc_records(spark, warc)
