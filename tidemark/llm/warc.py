"""Legacy archives to WARC.

ARC files of version 1 and 2 begin with a version block that names the fields of
the header lines; each record is a header line and as many bytes as it declares.
A converter parses them and makes the equivalent WARC records: identifiers are
derived from what a record holds, timestamps and types from its header line and
content, digests from its payload.

A task gathers records into ARC archives of both versions, of ARCHIVE_BYTES or
one record; an archive that is full is parsed and becomes a WARC archive. Spark's
text writer puts each into a compressed file of its own in the shared folder, and
the binary file reader gives them back; so any store that Spark knows will do.
Records with equal payloads (length and SHA-1 agree) are stored once: that of the
smallest page is a response, the others revisits that refer to it, with HTTP
headers but no payload. A revisit names the page that it refers to beside the
record, so archives are read once.

Defined results: a null payload is empty; a very long one has an archive of its
own, up to what a value of Spark can hold (2 GB). Other columns, of any name, are
not looked at. A null URL is written as "unknown:";
white space in a URL is percent-encoded, as header lines need. Null ids come
after all others; if all ids of equal payloads are null, all are responses, and
so are rows that repeat the smallest id. In damaged archives, what a broken
header line or a length beyond the end leaves is passed over. An empty table
gives an empty result.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import new_path

#: Fields of a header line, by ARC version.
ARC_FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # names that are URLs
DATE = "20240101000000"
#: Payload bytes after which an archive is full.
ARCHIVE_BYTES = 32 << 20


def sha1_32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


@dataclass(frozen=True)
class ArcRecord:
    url: str
    ip: str
    date: str
    mime: str
    content: bytes
    version: int = 1


def arc_url(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "unknown:")


def write_arc(records: list[ArcRecord], version: int, name: str = "pages.arc") -> bytes:
    """An ARC file of one version."""
    about = f"{version} 0 tidemark\n{' '.join(ARC_FIELDS[version])}\n".encode()
    # The version block's own header line has the fields of its version, too.
    rest = "200 - - 0 " + name + " " if version == 2 else ""
    out = [f"filedesc://{name} 0.0.0.0 {DATE} text/plain {rest}{len(about)}\n".encode(), about, b"\n"]
    at = sum(map(len, out))
    for r in records:
        more = f"200 {sha1_32(r.content)} - {at} {name} " if version == 2 else ""
        head = f"{arc_url(r.url)} {r.ip} {r.date} {r.mime} {more}{len(r.content)}\n".encode("utf-8", "surrogatepass")
        out += [head, r.content, b"\n"]
        at += len(head) + len(r.content) + 1
    return b"".join(out)


def read_arc(data: bytes) -> Iterator[ArcRecord]:
    """Records of an ARC file, without the version block."""
    version, at = 1, 0
    while at < len(data):
        end = data.find(b"\n", at)
        if end < 0:
            return
        line, at = data[at:end].decode("utf-8", "surrogateescape"), end + 1
        if not line.strip():
            continue
        first = line.startswith("filedesc://")
        # A URL may hold blanks: fields are counted from the end.
        parts = line.split(" ")
        count = len(ARC_FIELDS[version]) if not first else 10 if len(parts) >= 10 else 5
        if len(parts) < count or not parts[-1].isdigit() or at + int(parts[-1]) > len(data):
            continue
        content, at = data[at : at + int(parts[-1])], at + int(parts[-1])
        if first:
            said = content.split(b" ", 1)[0]
            version = int(said) if said in (b"1", b"2") else 1
            continue
        url, (ip, date, mime) = " ".join(parts[: len(parts) - count + 1]), parts[len(parts) - count + 1 :][:3]
        yield ArcRecord(url, ip, date, mime, content, version)


def split_http(content: bytes) -> tuple[bytes, bytes]:
    """Head, with the empty line after it, and payload of an HTTP response;
    without a head, all is payload."""
    if not content.startswith(b"HTTP/"):
        return b"", content
    for mark in (b"\r\n\r\n", b"\n\n"):
        at = content.find(mark)
        if at >= 0:
            return content[: at + len(mark)], content[at + len(mark) :]
    return content, b""


def warc_date(date: str) -> str:
    """Of the 14 digits of a header line, fewer of them filled up."""
    d = (re.sub("[^0-9]", "", date) + "00000101000000"[len(re.sub("[^0-9]", "", date)) :])[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(url: str, date: str, mark: str, digest: str) -> str:
    """An identifier that depends on what is recorded alone; mark tells captures
    of one URL, time and payload apart."""
    return f"<urn:uuid:{uuid.uuid5(SPACE, ' '.join((arc_url(url), date, mark, digest)))}>"


def to_warc(r: ArcRecord, own_id: str | None = None, refers_to: str | None = None, more: tuple[tuple[str, str], ...] = ()) -> bytes:
    """The WARC record of an ARC record; a revisit if it refers to another one.
    More fields, of names that begin with X-, may be given."""
    head, payload = split_http(r.content)
    digest = sha1_32(payload)
    kind = "revisit" if refers_to else "response" if head else "resource"
    block = head if kind == "revisit" else r.content
    fields = [
        ("WARC-Type", kind), ("WARC-Record-ID", own_id or record_id(r.url, r.date, "", digest)), ("WARC-Date", warc_date(r.date)), ("WARC-Target-URI", arc_url(r.url)),
        ("WARC-IP-Address", r.ip), ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{sha1_32(block)}"),
        *([("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", refers_to)] if kind == "revisit" else []), *more,
        ("Content-Type", "application/http; msgtype=response" if head else r.mime), ("Content-Length", str(len(block))),
    ]
    return b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode("utf-8", "surrogateescape") + b"\r\n" + block + b"\r\n\r\n"


def read_warc(data: bytes | BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields, names in lower case, and block of each record; of a stream
    one record is held at a time."""
    stream = io.BytesIO(data) if isinstance(data, bytes) else data
    while line := stream.readline():
        if not line.startswith(b"WARC/1."):
            continue
        fields = {}
        while (line := stream.readline()).strip():
            k, _, v = line.decode("utf-8", "surrogateescape").partition(":")
            fields[k.strip().lower()] = v.strip()
        size = fields.get("content-length", "")
        if size.isdigit() and len(block := stream.read(int(size))) == int(size):
            yield fields, block


PAGE, FIRST_PAGE = "X-Page-Id", "X-Refers-To-Page-Id"


def http_response(payload: bytes, page_id: object) -> bytes:
    mark = "" if page_id is None else f"{PAGE}: {page_id}\r\n"
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{mark}Content-Length: {len(payload)}\r\n\r\n".encode() + payload


def http_fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("latin-1").split("\r\n")[1:])}


def first_pages(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """pages (page_id, url, payload) with first_id, the smallest page of equal
    payloads, where a payload occurs more than once. Only payloads that do are
    joined; counts are summed before the shuffle, and a payload that many pages
    have is split by Spark's skew join."""
    keyed = pages.withColumns({"sha": F.unhex(F.sha1("payload")), "size": F.length("payload")})
    many = keyed.where(F.col("size") >= least_bytes).groupBy("sha", "size").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return keyed.join(many, ["sha", "size"], "left").select("page_id", "url", "payload", "first_id", "sha")


def converted(pages: list[tuple], version: int, date: str) -> bytes:
    """One WARC archive of pages (page_id, url, payload, first_id): their ARC
    archive is written, parsed and converted record by record."""
    arc = write_arc([ArcRecord(url or "", "0.0.0.0", date, "text/html", http_response(payload, page)) for page, url, payload, _ in pages], version)
    out = []
    for r, (page, _, payload, first) in zip(read_arc(arc), pages, strict=True):
        # Identifiers come from page and payload, so that a revisit knows that
        # of the record it refers to.
        digest = sha1_32(payload)
        own, to = (record_id("page:", date, str(x), digest) for x in (page, first))
        again = first is not None and page != first
        out.append(to_warc(r, own, to, ((FIRST_PAGE, str(first)),)) if again else to_warc(r, own))
    return b"".join(out)


def convert(pages: DataFrame, path: str, date: str = DATE, least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Writes a WARC record for each page into archives: ARC archives, of version
    1 for even pages and 2 for odd ones, are parsed and converted."""
    known = first_pages(pages, least_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_pages: dict[int, list[tuple]] = {1: [], 2: []}
        held = {1: 0, 2: 0}

        def full(version: int) -> pa.RecordBatch:
            archive = converted(open_pages[version], version, date)
            open_pages[version], held[version] = [], 0
            return pa.RecordBatch.from_arrays([pa.array([archive[:-1]], pa.binary())], names=["archive"])  # the writer ends each line

        for b in batches:
            for page, url, payload, first in zip(*(b.column(i) for i in range(4)), strict=True):
                row = page.as_py(), url.as_py(), payload.as_py(), first.as_py()
                version = 1 + (0 if row[0] is None else row[0] % 2)
                open_pages[version].append(row)
                held[version] += len(row[2])
                if held[version] >= archive_bytes:
                    yield full(version)
        for version, rows in open_pages.items():
            if rows:
                yield full(version)

    archives = known.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "payload", F.col("first_id").cast("long")).mapInArrow(run, "archive binary")
    archives.select(F.col("archive").cast("string").alias("value")).write.option("lineSep", "\n").option("maxRecordsPerFile", 1).option("compression", "gzip").text(path)


def described(fields: dict[str, str], block: bytes) -> tuple:
    """What read() tells of a record; an error if payload or reference are not
    what the record says."""
    head, payload = split_http(block)
    http, kind, told = http_fields(head), fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
    page, first = http.get(PAGE.lower()), fields.get(FIRST_PAGE.lower())
    if kind != "revisit" and sha1_32(payload) != told:
        raise ValueError(f"record {fields['warc-record-id']} has another payload than its digest tells")
    if first is not None and fields["warc-refers-to"] != record_id("page:", re.sub("[^0-9]", "", fields["warc-date"]), first, told):
        raise ValueError(f"record {fields['warc-record-id']} refers to another record than that of its page")
    size = int(http["content-length"]) if kind == "revisit" else len(payload)
    return fields["warc-record-id"], fields.get("warc-refers-to"), kind, page and int(page), first and int(first), size, told


def read(spark, path: str) -> DataFrame:
    """What the archives in a folder hold: record_id, refers_to_id, record_type,
    page_id, refers_to, payload_bytes and payload_digest, the last two of the
    full payload. Payloads of responses are measured again and must have the
    digest told; of an archive one record is held beside it."""
    names = ["record_id", "refers_to_id", "record_type", "page_id", "refers_to", "payload_bytes", "payload_digest"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                rows = [described(*record) for record in read_warc(gzip.open(io.BytesIO(content.as_py())))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i in (3, 4, 5) else pa.string()) for i, c in enumerate(zip(*rows, strict=True))], names=names)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, "record_id string, refers_to_id string, record_type string, page_id long, refers_to long, payload_bytes long, payload_digest string")


def round_trip(pages: DataFrame, least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Pages (page_id, url, html) written as archives and read back: page_id,
    payload_bytes, payload_digest, record_type and refers_to."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    kind = pages.schema["page_id"].dataType
    convert(pages.select("page_id", "url", payload.alias("payload")), path, least_bytes=least_bytes, archive_bytes=archive_bytes)
    return read(spark, path).select(F.col("page_id").cast(kind), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))
