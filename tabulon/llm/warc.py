"""Legacy archive conversion: ARC records into WARC records, archives written through Spark, and read back.

*Converter.* ``arc_records`` reads an ARC file, plain or gzip members: its first record, ``filedesc://``, names the version, by
which header lines are parsed. Version 1 has URL, address, date, type and length; version 2 adds result code, checksum, location,
offset and file name before the length. The declared length cuts the body, and so the next record. A body that begins with an
HTTP head keeps it in the WARC block, and what follows the head is the payload; any other body is the payload, and a head is made
for it. From that come the WARC fields: the type, an identifier derived from the record's key, place and payload, an ISO
timestamp from the 14-digit date, block and payload digests, and the content length.

*Revisits.* Of records with equal payloads of at least ``REVISIT_BYTES`` the one with the largest id is the response, the
others revisit it and carry no payload. Keys are decided on narrow rows (id, digest, length) by a pre-aggregated maximum.

*Archives.* Each page becomes an ARC file of its own and is converted from that. Records are dealt by a hash of id and digest and
written in the shared folder by Spark's text writer, one gzip member a record: the writer's line end is a member's last byte.
Files hold about ``ARCHIVE_BYTES``, whatever the size of the table. Reading parses each archive as a stream by declared lengths;
memory is one compressed archive and one record.

Defined cases: a null payload is empty, a null URL is written as ``urn:none``; a null id is carried as such; repeated ids give
a record each, with identifiers of their own, rows alike in all columns included; the payload is held by byte length, so any
content survives, record marks and line ends included. Other columns of the pages are left out; an empty table gives no records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm.common import bound_batches, cuts, new_path, written

REVISIT_BYTES = 1000
ARCHIVE_BYTES = 32 << 20
#: The most partitions that are dealt; beyond, each writes several archives.
PARTITIONS = 1 << 15
ARC_DATE = "20240101000000"
ADDRESS = "0.0.0.0"
CRLF = b"\r\n"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def arc_file(version: int, url: str, body: bytes, mime: str = "text/html", date: str = ARC_DATE, code: int = 200) -> bytes:
    """An ARC file of one record behind its version block."""
    names = "URL IP-address Archive-date Content-type Archive-length" if version == 1 else "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"
    about = f"{version} 0 tabulon\n{names}\n".encode()
    first = ["filedesc://made.arc", ADDRESS, date, "text/plain"]
    fields = [url, ADDRESS, date, mime]
    if version == 2:
        first += ["200", "-", "-", "0", "made.arc"]
        fields += [str(code), base64.b32encode(hashlib.sha1(body).digest()).decode(), "-", "0", "made.arc"]
    line = lambda parts, block: " ".join([*parts, str(len(block))]).encode() + b"\n" + block + b"\n"
    return line(first, about) + line(fields, body)


def arc_header(line: bytes, version: int) -> dict:
    """Fields of a record's header line; raises where it has not the version's form."""
    # a URL may hold blanks, the other fields don't
    names = ("url", "ip", "date", "mime", "code", "checksum", "location", "offset", "filename", "length") if version == 2 else ("url", "ip", "date", "mime", "length")
    parts = line.decode().rsplit(" ", len(names) - 1)
    if len(parts) != len(names) or not parts[-1].isdigit():
        raise ValueError(f"not an ARC version {version} header line: {line[:200]!r}")
    head = dict(zip(names, parts, strict=True))
    if not re.fullmatch(r"\d{14}", head["date"]):
        raise ValueError(f"a wrong date: {line[:200]!r}")
    return head


def arc_records(raw: bytes) -> Iterator[tuple[dict, bytes]]:
    """Header fields and body of each record of an ARC file, without its version block. Line ends between records are skipped."""
    stream, version = Stream(raw), None
    while stream.held or stream.more():
        line = stream.until(b"\n")
        if not line.strip():
            continue
        if version is None:
            if not line.startswith(b"filedesc://"):
                raise ValueError(f"an ARC file begins with its version block, not {line[:200]!r}")
            about = stream.take(int(line.rsplit(b" ", 1)[1]))
            version = int(about.split(b" ", 1)[0])
            if version not in (1, 2):
                raise ValueError(f"ARC version {version} isn't known")
            continue
        head = arc_header(line, version)
        yield head, stream.take(int(head["length"]))


def record_id(key: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, 'record:' + key)}>"


def iso(date: str) -> str:
    return f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z"


def http_parts(head: dict, body: bytes) -> tuple[bytes, bytes]:
    """The HTTP head, blank line included, and the payload of an ARC record's body; a head is made where the body has none."""
    if body.startswith(b"HTTP/") and (k := body.find(CRLF + CRLF)) >= 0:
        return body[: k + 4], body[k + 4 :]
    return f"HTTP/1.1 {head.get('code', '200')} OK\r\nContent-Type: {head['mime']}\r\nContent-Length: {len(body)}\r\n\r\n".encode(), body


def convert(head: dict, body: bytes, key: str, refers_to: str | None, copy: int = 0) -> bytes:
    """The WARC record of an ARC record; a revisit if ``refers_to`` names another key. ``copy`` tells records alike apart."""
    http, payload = http_parts(head, body)
    block = http if refers_to is not None else http + payload
    sha = hashlib.sha1(payload)
    digest = lambda b: "sha1:" + base64.b32encode(b.digest()).decode()
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(f"{key} {sha.hexdigest()} {head['url']} {copy}" if copy or refers_to is not None else f"{key} {sha.hexdigest()}")),
        ("WARC-Date", iso(head["date"])),
        ("WARC-Target-URI", head["url"]),
        ("WARC-IP-Address", head["ip"]),
        ("WARC-Payload-Digest", digest(sha)),
        ("WARC-Block-Digest", digest(hashlib.sha1(block))),
        ("Content-Type", "application/http; msgtype=response"),
        ("X-Source-Key", key),
        ("X-Payload-Bytes", str(len(payload))),
    ]
    if refers_to is not None:
        # the response's own identifier: its key and the payload that both have
        fields += [("WARC-Refers-To", record_id(f"{refers_to} {sha.hexdigest()}")), ("WARC-Profile", PROFILE), ("X-Refers-To-Key", refers_to)]
    fields.append(("Content-Length", str(len(block))))
    return b"WARC/1.0\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in fields) + CRLF + block + CRLF + CRLF


def member(record: bytes) -> bytes:
    """A gzip member whose last byte is zero: that of a length under 2 ** 24; an empty member ends a longer one."""
    made = gzip.compress(record, 6, mtime=0)
    return made if made.endswith(b"\0") else made + gzip.compress(b"", 6, mtime=0)


class Stream:
    """Bytes of a gzip (or plain) archive, inflated as they are asked for."""

    def __init__(self, raw: bytes) -> None:
        self.raw, self.at, self.held = memoryview(raw), 0, bytearray()
        self.inflate = zlib.decompressobj(31) if raw[:2] == b"\x1f\x8b" else None

    def more(self) -> bool:
        if self.at >= len(self.raw):
            return False
        part = self.raw[self.at : self.at + (1 << 16)]
        self.at += len(part)
        if self.inflate is None:
            self.held += part
            return True
        while part:
            self.held += self.inflate.decompress(part)
            part = self.inflate.unused_data
            if part:  # the next member
                self.inflate = zlib.decompressobj(31)
        return True

    def until(self, mark: bytes) -> bytes:
        """Up to and without the mark; all that is left if it doesn't come."""
        start = 0
        while (k := self.held.find(mark, start)) < 0:
            start = max(0, len(self.held) - len(mark) + 1)
            if not self.more():
                out = bytes(self.held)
                self.held.clear()
                return out
        out = bytes(self.held[:k])
        del self.held[: k + len(mark)]
        return out

    def take(self, n: int) -> bytes:
        while len(self.held) < n:
            if not self.more():
                raise ValueError(f"the archive ends {n - len(self.held)} bytes early")
        out = bytes(self.held[:n])
        del self.held[:n]
        return out


def records(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record."""
    stream = Stream(raw)
    while head := stream.until(CRLF + CRLF):
        version, *lines = head.decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"not a WARC record: {version[:100]!r}")
        fields = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines)}
        yield fields, stream.take(int(fields["content-length"]))
        if stream.take(4) != CRLF + CRLF:
            raise ValueError("a record doesn't end where its length says")


def payload_of(fields: dict[str, str], block: bytes) -> tuple[int, str]:
    """Full payload's length and hex SHA-1: of a response as read, of a revisit as declared."""
    payload = block.partition(CRLF + CRLF)[2]
    digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
    if fields["warc-type"] == "revisit":
        return int(fields["x-payload-bytes"]), digest
    if (found := hashlib.sha1(payload).hexdigest()) != digest:
        raise ValueError(f"payload digest {found} where {digest} is declared")
    return len(payload), digest


def revisits(keyed: DataFrame) -> DataFrame:
    """(key, digest, refers_to) of the rows that revisit another, from narrow rows (key, digest); a null digest never revisits.

    A digest's rows may be a third of all; the maximum is aggregated before the shuffle and joined back to one row a digest,
    a join whose skewed side Spark may split.
    """
    last = keyed.where("digest is not null").groupBy("digest").agg(F.max("key").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    return keyed.join(last, "digest").where("not (key <=> refers_to) and refers_to is not null").select("key", "digest", "refers_to").distinct()


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> None:
    """Archives of all pages at ``path``: each page as an ARC file (version 1 or 2 by its id), converted to WARC.

    The payloads are shuffled once, by the key of the join with the revisits. Where a key has several rows, a number tells their
    identifiers apart; only such rows are counted, within their partition.
    """
    bound_batches(pages.sparkSession)
    body = F.coalesce(F.col(payload_col), F.lit(""))
    # what rows are dealt and joined by, without nulls
    name = F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("name")
    digest = F.when(F.octet_length(body) >= REVISIT_BYTES, F.sha2(body, 256))
    rows = pages.select(F.col(id_col).alias("key"), F.col(url_col).alias("url"), body.alias("body"), name, F.coalesce(digest, F.lit("")).alias("digest"))
    keyed = written(rows.select("key", "name", F.when(F.col("digest") != "", F.col("digest")).alias("digest"), F.octet_length("body").alias("size")), "keyed")
    size, n = keyed.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    partitions = max(1, min(PARTITIONS, -(-size // ARCHIVE_BYTES)))
    each = max(1, n * ARCHIVE_BYTES // max(1, size))
    repeated = keyed.groupBy("name").agg(F.count("*").alias("n")).where("n > 1").select("name")
    known = revisits(keyed).select(F.coalesce(F.col("key").cast("string"), F.lit("")).alias("name"), "digest", "refers_to", F.lit(None).cast("boolean").alias("again"))
    marked = keyed.join(repeated, "name").select("name", F.coalesce("digest", F.lit("")).alias("digest"), F.lit(None).cast("long").alias("refers_to"), F.lit(True).alias("again"))
    others = known.unionByName(marked).groupBy("name", "digest").agg(F.max("refers_to").alias("refers_to"), F.max("again").alias("again"))
    # written first, so that the plan of the join doesn't change when its pieces are done, which would shuffle the payloads again
    others = written(others, "others").repartition(partitions, "name", "digest").hint("shuffle_hash")
    rows = rows.repartition(partitions, "name", "digest").join(others, ["name", "digest"], "left").select("key", "url", "body", "refers_to", "again")

    def run(batches):
        seen: Counter = Counter()
        for whole in batches:
            for at, rows_ in cuts(whole, ["body"]):
                out = []
                for key, url, body, other, again in zip(*(c.to_pylist() for c in whole.slice(at, rows_).columns), strict=True):
                    raw, copy = body.encode(), 0
                    if again:
                        mark = (key, hashlib.sha1(raw).digest()[:12])
                        copy, seen[mark] = seen[mark], seen[mark] + 1
                    arc = arc_file(1 + (key or 0) % 2, re.sub(r"[\r\n]", " ", url) if url else "urn:none", HTTP % len(raw) + raw)
                    for head, block in arc_records(arc):
                        out.append(member(convert(head, block, "null" if key is None else str(key), None if other is None else str(other), copy))[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    made = rows.mapInArrow(run, "record binary")
    # the writer's line end is the member's last byte; casting keeps the bytes as they are
    text = made.select(F.expr("cast(record as string)").alias("value")).write.option("lineSep", "\0").option("maxRecordsPerFile", each)
    text.text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: page_id, payload_bytes, payload_digest, record_type, refers_to, url, warc_date, record_id."""

    def run(batches):
        for batch in batches:
            for raw in batch.column(0):
                out = []
                for fields, block in records(raw.as_py()):
                    key, other = fields["x-source-key"], fields.get("x-refers-to-key")
                    out.append((None if key == "null" else int(key), *payload_of(fields, block), fields["warc-type"], other and int(other), fields["warc-target-uri"], fields["warc-date"], fields["warc-record-id"]))
                    if len(out) == 1000:
                        yield packed(out)
                        out = []
                if out:
                    yield packed(out)

    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "warc_date", "record_id"]

    def packed(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, warc_date string, record_id string")


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Writes the archives to a new folder in the shared one, and reads them back."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write(pages, path, id_col, url_col, payload_col)
    return read(spark, path)
