"""WARC: converts legacy ARC archives and writes and reads WARC archives.

ARC files start with a `filedesc://` record that names the version; a record is a header line (five fields in version
1, ten in version 2, the last the declared length), that many bytes and a line feed. `arc_to_warc` synthesises what
WARC needs beside: record identifiers (from file and offset, so a repeated task gives the same), ISO timestamps, types
and SHA-256 digests. `mark_revisits` turns all but the first record of equal payloads into revisits.

Archives are written by Spark's text writer, whose line separator is the record separator of the format, as gzip files
of a bounded number of records, fewer where records are large, so that a file holds about `FILE_BYTES` before
compression. They are read as binary files, unpacked as streams and cut by declared lengths: a task holds a compressed
file and one record. No archive passes through the driver and nothing is written outside the shared folder.

Defined results: null html is an empty payload; a null URL is `-`; white space in a URL is percent-encoded; a null id
stays null. Of repeated rows with one id, the record with the smallest record identifier is the response. A truncated
last record keeps the bytes there are and is marked. Lines that are no record header are skipped. A very long payload is
one record, held whole by the task that writes or reads it. Extra columns of the pages, whatever their names, do not
take part. An empty table gives an archive without records and an empty result.
"""

from __future__ import annotations

import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialframe.llm.common import durable, scratch, sized_broadcast, small_batches, table

ARC_FIELDS = {
    "1": b"URL IP-address Archive-date Content-type Archive-length",
    "2": b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
#: Archives are large and written once: the fastest level of gzip, as Hadoop's codec names it.
GZIP = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED"}
#: Records in one archive file at most, its version record included, and bytes on average.
FILE_RECORDS, FILE_BYTES = 10_000, 128 << 20
#: Payloads below so many bytes are never revisits.
REVISIT_BYTES = 100
#: Duplicate payload digests that may be broadcast; more are joined by a shuffle.
BROADCAST_DIGESTS = 100_000
ITEM = b"X-Archive-Item"

ARC_SCHEMA = "file string, offset long, url string, ip string, date string, content_type string, block binary, truncated boolean"
WARC_SCHEMA = (
    "record_id string, warc_type string, target_uri string, warc_date string, content_type string, item_id long, "
    "http_head binary, payload binary, payload_bytes long, payload_digest string, refers_to_id string, refers_to_item long"
)


def _batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    size = 0
    for r in rows:
        held.append(r)
        size += 64 + sum(len(x) for x in r if isinstance(x, bytes))
        if size >= most or len(held) >= 2000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _text(rows: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
    """Rows for the text writer; the bytes go through as they are."""
    for b in _batches(((r,) for r in rows), pa.schema([("value", pa.binary())])):
        yield pa.RecordBatch.from_arrays([b.column(0).view(pa.string())], names=["value"])


class _Inflated(io.RawIOBase):
    """The gzip members of some bytes end to end, as far as they are whole."""

    def __init__(self, content: bytes):
        self.rest, self.z = content, zlib.decompressobj(31)

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        while True:
            if self.z.eof:
                self.rest = self.z.unused_data
                if self.rest[:2] != b"\x1f\x8b":
                    return 0
                self.z = zlib.decompressobj(31)
            out = self.z.decompress(self.rest, len(into))
            self.rest = self.z.unconsumed_tail
            if out or not (self.rest or self.z.eof):
                into[: len(out)] = out
                return len(out)


def _opened(content: bytes):
    """A stream of gzip members, or of plain bytes."""
    return io.BufferedReader(_Inflated(content), 1 << 18) if content[:2] == b"\x1f\x8b" else io.BytesIO(content)


def _records_a_file(sizes: DataFrame, size: str) -> int:
    """How many records of that many bytes a file may hold."""
    mean = sizes.agg(F.avg(size)).first()[0] or 0
    return int(min(FILE_RECORDS, max(1, FILE_BYTES // max(1, mean))))


# ---------------------------------------------------------------- ARC


def _arc_url(url: str | None) -> bytes:
    raw = (url or "-").encode("utf-8", "surrogatepass")
    return re.sub(rb"[\x00-\x20\x7f]", lambda m: b"%%%02X" % m[0][0], raw) or b"-"


def arc_record(url: str | None, block: bytes, date: str, version: str = "1", content_type: str = "text/html", ip: str = "0.0.0.0") -> bytes:
    more = b" 200 - - 0 -" if version == "2" else b""
    return b"%s %s %s %s%s %d\n%s" % (_arc_url(url), ip.encode(), date.encode(), content_type.encode(), more, len(block), block)


def arc_start(date: str, version: str = "1", name: str = "pages") -> bytes:
    body = b"%s 0 archive\n%s\n" % (version.encode(), ARC_FIELDS[version])
    more = b" 200 - - 0 -" if version == "2" else b""
    return b"filedesc://%s.arc 0.0.0.0 %s text/plain%s %d\n%s" % (name.encode(), date.encode(), more, len(body), body)


def parse_arc(data) -> Iterator[tuple[int, list[str], bytes, bool]]:
    """Offset, header fields, block and whether it is cut short, of each record of a stream but the version records."""
    stream = io.BytesIO(data) if isinstance(data, bytes) else data
    pos, fields = 0, 5
    while whole := stream.readline():
        at, pos = pos, pos + len(whole)
        line = whole.rstrip(b"\r\n")
        head = line.rsplit(b" ", fields - 1)
        start = line.startswith(b"filedesc://")
        if start:  # its own block says the version, so count its fields
            fields = 10 if len(line.split(b" ")) >= 10 else 5
            head = line.rsplit(b" ", fields - 1)
        if len(head) != fields or not head[-1].isdigit() or not head[2].isdigit():
            continue
        size = int(head[-1])
        block = stream.read(size)
        pos += len(block)
        if start:
            named = re.match(rb"(\d+) ", block)
            fields = 10 if named and named[1] == b"2" else 5
        else:
            yield at, [x.decode("utf-8", "replace") for x in head], block, len(block) < size


def write_arc(pages: DataFrame, path: str, item: str, url: str, body: str, date: str = "20240101000000", version: str = "1") -> None:
    """An archive of HTTP responses; the item's id is a response header."""
    rows = pages.select(F.col(f"`{item}`").alias("i"), F.col(f"`{url}`").alias("u"), F.encode(F.coalesce(F.col(f"`{body}`"), F.lit("")), "UTF-8").alias("b"))

    most = _records_a_file(rows.select((F.length("b") + 256).alias("n")), "n")

    def build(batches):
        def records():
            k = 0
            for batch in batches:
                for i, u, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if k % most == 0:
                        yield arc_start(date, version)
                        k += 1
                    named = b"" if i is None else b"%s: %d\r\n" % (ITEM, i)
                    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n%s\r\n" % (len(b), named)
                    yield arc_record(u, head + b, date, version)
                    k += 1

        yield from _text(records())

    small_batches(pages.sparkSession)
    rows.mapInArrow(build, "value string").write.options(lineSep="\n", maxRecordsPerFile=str(most), **GZIP).text(path)


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    schema = pa.schema([("file", pa.string()), ("offset", pa.int64()), *[(c, pa.string()) for c in ("url", "ip", "date", "content_type")], ("block", pa.binary()), ("truncated", pa.bool_())])

    def parse(batches):
        def records():
            for batch in batches:
                for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    for at, head, block, cut in parse_arc(_opened(content)):
                        yield name.rpartition("/")[2], at, *head[:4], block, cut

        yield from _batches(records(), schema)

    return files.mapInArrow(parse, ARC_SCHEMA)


# ---------------------------------------------------------------- conversion


def _record_id(name: str, offset: int) -> str:
    return f"urn:uuid:{uuid.UUID(bytes=hashlib.sha256(f'{name}@{offset}'.encode()).digest()[:16], version=5)}"


def _iso(date: str) -> str:
    d = re.sub(r"\D", "", date)[:14].ljust(8, "0").ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def arc_to_warc(records: DataFrame) -> DataFrame:
    """One WARC record per ARC record: a response where the block is an HTTP message, else a resource."""
    schema = pa.schema([
        *[(c, pa.string()) for c in ("record_id", "warc_type", "target_uri", "warc_date", "content_type")], ("item_id", pa.int64()),
        ("http_head", pa.binary()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
        ("refers_to_id", pa.string()), ("refers_to_item", pa.int64()),
    ])

    def convert(batches):
        def out():
            for batch in batches:
                for name, at, url, _, date, kind, block, _ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    head, item = b"", None
                    if block.startswith(b"HTTP/"):
                        cut = re.search(rb"\r?\n\r?\n", block)
                        head = block[: cut.end()] if cut else block
                        found = re.search(rb"(?im)^" + re.escape(ITEM) + rb":\s*(-?\d+)\s*$", head)
                        item = int(found[1]) if found else None
                    payload = block[len(head) :]
                    yield (
                        _record_id(name, at), "response" if head else "resource", url, _iso(date),
                        "application/http; msgtype=response" if head else kind, item, head, payload, len(payload),
                        hashlib.sha256(payload).hexdigest(), None, None,
                    )

        yield from _batches(out(), schema)

    return records.select("file", "offset", "url", "ip", "date", "content_type", "block", "truncated").mapInArrow(convert, WARC_SCHEMA)


def mark_revisits(records: DataFrame, least_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Of records with equal payloads, that with the smallest (item, record id) stays; the others refer to it.

    The digests that occur twice or more are written before the join, so that a payload shared by a large part of the
    records is a skewed side of a plain join, which Spark splits; where they are few they are broadcast.
    """
    large = records.where(F.col("payload_bytes") >= least_bytes)
    first = F.min(F.struct(F.col("item_id").isNull().alias("none"), F.col("item_id"), F.col("record_id")))
    dups = large.groupBy("payload_digest", "payload_bytes").agg(first.alias("f"), F.count("*").alias("n")).where("n > 1")
    dups = durable(dups.select("payload_digest", "payload_bytes", F.col("f.item_id").alias("first_item"), F.col("f.record_id").alias("first_id")))
    known = sized_broadcast(dups, dups.count(), BROADCAST_DIGESTS)
    again = F.col("first_id").isNotNull() & (F.col("first_id") != F.col("record_id"))
    return (
        records.join(known, ["payload_digest", "payload_bytes"], "left")
        .withColumns({
            "warc_type": F.when(again, "revisit").otherwise(F.col("warc_type")),
            "refers_to_id": F.when(again, F.col("first_id")), "refers_to_item": F.when(again, F.col("first_item")),
        })
        .select(*records.columns)
    )


# ---------------------------------------------------------------- WARC


def warc_record(r: dict) -> bytes:
    """One record without its separator; a revisit has the HTTP head only."""
    revisit = r["warc_type"] == "revisit"
    block = (r["http_head"] or b"") + (b"" if revisit else r["payload"] or b"")
    lines = [
        f"WARC-Type: {r['warc_type']}", f"WARC-Record-ID: <{r['record_id']}>", f"WARC-Target-URI: {r['target_uri']}", f"WARC-Date: {r['warc_date']}",
        f"WARC-Payload-Digest: sha256:{r['payload_digest']}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        f"X-Archive-Payload-Length: {r['payload_bytes']}", f"Content-Type: {r['content_type']}", f"Content-Length: {len(block)}",
    ]
    if r["item_id"] is not None:
        lines.append(f"X-Archive-Item: {r['item_id']}")
    if revisit:
        lines += [f"WARC-Refers-To: <{r['refers_to_id']}>", "WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"]
        if r["refers_to_item"] is not None:
            lines.append(f"X-Archive-Refers-To-Item: {r['refers_to_item']}")
    return b"WARC/1.0\r\n" + "\r\n".join(lines).encode("utf-8", "replace") + b"\r\n\r\n" + block


def parse_warc(data) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-case names) and block of each record of a stream."""
    stream = io.BytesIO(data) if isinstance(data, bytes) else data
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            continue
        head = {}
        while (line := stream.readline()) and line.strip():
            k, _, v = line.decode("utf-8", "replace").partition(":")
            head[k.strip().lower()] = v.strip()
        yield head, stream.read(int(head.get("content-length", 0)))


def write_warc(records: DataFrame, path: str) -> None:
    def build(batches):
        yield from _text(warc_record(r) for batch in batches for r in batch.to_pylist())

    small_batches(records.sparkSession)
    most = _records_a_file(records.select((F.col("payload_bytes") + 1024).alias("n")), "n")
    records.mapInArrow(build, "value string").write.options(lineSep="\r\n\r\n", maxRecordsPerFile=str(most), **GZIP).text(path)


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of an archive; payload is null for revisits, and for all where payloads are not asked for."""
    files = spark.read.format("binaryFile").load(path).select("content")
    schema = pa.schema([
        *[(c, pa.string()) for c in ("record_id", "warc_type", "target_uri", "warc_date", "content_type")], ("item_id", pa.int64()),
        ("http_head", pa.binary()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
        ("refers_to_id", pa.string()), ("refers_to_item", pa.int64()),
    ])

    def parse(batches):
        def out():
            for batch in batches:
                for content in batch.column(0).to_pylist():
                    for h, block in parse_warc(_opened(content)):
                        cut = re.search(rb"\r?\n\r?\n", block) if h.get("content-type", "").startswith("application/http") else None
                        head = block[: cut.end()] if cut else b""
                        body, revisit = block[len(head) :], h.get("warc-type") == "revisit"
                        size = int(h.get("x-archive-payload-length", 0)) if revisit else len(body)
                        digest = h.get("warc-payload-digest", "").rpartition(":")[2] if revisit else hashlib.sha256(body).hexdigest()
                        number = lambda k: int(h[k]) if k in h else None  # noqa: B023, E731
                        yield (
                            h.get("warc-record-id", "").strip("<>"), h.get("warc-type"), h.get("warc-target-uri"), h.get("warc-date"),
                            h.get("content-type"), number("x-archive-item"), head, None if revisit or not payloads else body, size, digest,
                            h["warc-refers-to"].strip("<>") if "warc-refers-to" in h else None, number("x-archive-refers-to-item"),
                        )

        yield from _batches(out(), schema)

    return files.mapInArrow(parse, WARC_SCHEMA)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages as a legacy archive, converted to WARC with revisits, read back."""
    arc, warc = scratch(spark), scratch(spark)
    write_arc(table(spark, sf_dir, "pages"), arc, "page_id", "url", "html")
    # The converted records are written once: the search for equal payloads then reads their digests only.
    write_warc(mark_revisits(durable(arc_to_warc(read_arc(spark, arc)), compression="zstd")), warc)
    back = read_warc(spark, warc, payloads=False)
    return back.select(
        F.col("item_id").alias("page_id"), "payload_bytes", "payload_digest",
        F.col("warc_type").alias("record_type"), F.col("refers_to_item").alias("refers_to"),
    )


ORACLE = f"""
WITH q AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM q),
r AS (SELECT *, payload_bytes >= {REVISIT_BYTES} AND page_id <> first AS again FROM m)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first END AS refers_to FROM r
"""
