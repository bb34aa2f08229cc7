"""WARC writing and a splittable reader.

Writing: each task writes one archive of gzip members, one record a member, to a folder that driver and
executors share. Of rows with equal payloads, that with the largest page_id is a `response` and the
others are `revisit` records that refer to it. A task names its file anew in each attempt and the
manifest, written by Spark, lists the files of the attempts that counted; so a lost executor leaves at
most an unlisted file.

Reading: archives are cut into byte ranges of `split_bytes`. A task scans its range for the gzip magic,
takes a candidate for a member only if it decodes to a WARC header and on to the record's full length,
and owns the records that start inside its range, reading past the range's end where one goes on.

Defined cases: a null html is an empty payload; a null page_id is written as such and read back as null;
of rows that repeat a page_id and payload all are responses if that id is the largest; an empty table
gives an empty manifest and no records; other columns are ignored; payloads below `min_revisit_bytes`
are always responses.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perfusia.llm.shared import Scratch, table

MAGIC = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNK = 1 << 20
RECORDS = "record_type string, page_id long, target_uri string, payload_digest string, payload_bytes long, refers_to long, payload binary, archive string, offset long"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(page_id, url, payload: bytes, refers_to) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {re.sub(r'[\r\n]+', ' ', url or '')}",
        f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
        "Content-Type: application/http; msgtype=response",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def write_archives(pages: DataFrame, scratch: Scratch, min_revisit_bytes: int = 0, level: int = 3) -> DataFrame:
    """Writes pages (page_id, url, html); gives the manifest (archive, bytes, records)."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    small = rows.select("page_id", F.sha1("html").alias("sha"), F.octet_length("html").alias("n"))
    largest = small.where(F.col("n") >= min_revisit_bytes).groupBy("sha").agg(F.max("page_id").alias("first"))
    revisits = (
        small.where(F.col("n") >= min_revisit_bytes).join(largest, "sha").where(F.col("first") > F.coalesce("page_id", F.col("first") - 1))
        .select(F.col("page_id").alias("rid"), F.col("sha").alias("rsha"), "first").distinct()
    )
    told = rows.withColumn("sha", F.sha1("html")).join(revisits, F.col("page_id").eqNullSafe(F.col("rid")) & (F.col("sha") == F.col("rsha")), "left")
    folder = scratch.path()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = out = None
        size = records = 0
        for batch in batches:
            for page_id, url, html, first in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "first"))):
                if out is None:
                    store, path = fs.FileSystem.from_uri(folder)
                    store.create_dir(path)
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    at, out = f"{folder}/{name}", store.open_output_stream(f"{path}/{name}", compression=None)
                z = zlib.compressobj(level, zlib.DEFLATED, 31)
                member = z.compress(_record(page_id, url, html.encode("utf-8", "surrogatepass"), first)) + z.flush()
                out.write(member)
                size += len(member)
                records += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"archive": [at], "bytes": [size], "records": [records]})

    return scratch.keep(told.select("page_id", "url", "html", "first").mapInArrow(write, "archive string, bytes long, records long"))


class _Window:
    """The bytes of a file from a moving position on."""

    def __init__(self, file, size: int, at: int):
        self.file, self.size, self.start, self.held = file, size, at, b""

    def grow(self) -> bool:
        more = self.file.read_at(min(CHUNK, self.size - self.start - len(self.held)), self.start + len(self.held))
        self.held += more
        return bool(more)

    def advance(self, n: int) -> None:
        self.held = self.held[n:]
        self.start += n


def _member(window: _Window) -> tuple[bytes, int] | None:
    """The WARC record of a gzip member at the window's start and its compressed length; None if there is none."""
    z, text, fed = zlib.decompressobj(31), bytearray(), 0
    try:
        while not z.eof:
            if fed == len(window.held) and not window.grow():
                return None
            piece = window.held[fed : fed + CHUNK]
            fed += len(piece)
            text += z.decompress(piece)
            if len(text) >= 5 and not text.startswith(b"WARC/"):
                return None
    except zlib.error:
        return None
    head, _, rest = bytes(text).partition(b"\r\n\r\n")
    declared = re.search(rb"(?im)^content-length: *(\d+)\r?$", head)
    if not head.startswith(b"WARC/") or not declared or len(rest) < int(declared[1]):
        return None
    return bytes(text), fed - len(z.unused_data)


def _parsed(record: bytes) -> dict:
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])}
    http, _, payload = rest[: int(fields["content-length"])].partition(b"\r\n\r\n")
    length = int(re.search(rb"(?im)^content-length: *(\d+)\r?$", http)[1])
    number = lambda x: int(x) if (x := x.strip("<>").rpartition(":")[2]) else None
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    if fields["warc-type"] == "response" and (len(payload) != length or base32_sha1(payload) != digest):
        raise ValueError(f"payload of {fields['warc-record-id']} doesn't match its digest or length")
    return {
        "record_type": fields["warc-type"], "page_id": number(fields["warc-record-id"]), "target_uri": fields["warc-target-uri"],
        "payload_digest": digest, "payload_bytes": length, "refers_to": number(fields["warc-refers-to"]) if "warc-refers-to" in fields else None,
        "payload": payload if fields["warc-type"] == "response" else None,
    }


def records_of_range(archive: str, start: int, end: int) -> Iterator[dict]:
    """The records that start in [start, end) of an archive."""
    store, path = fs.FileSystem.from_uri(archive)
    with store.open_input_file(path) as file:
        window = _Window(file, file.size(), start)
        while window.start < end:
            found = window.held.find(MAGIC)
            if found < 0:
                window.advance(max(0, len(window.held) - len(MAGIC) + 1))
                if not window.grow():
                    return
                continue
            window.advance(found)
            if window.start >= end:
                return
            member = _member(window)
            if member is None:
                window.advance(1)
                continue
            yield _parsed(member[0]) | {"archive": archive, "offset": window.start}
            window.advance(member[1])


def read_archives(manifest: DataFrame, split_bytes: int = 8 << 20, payloads: bool = True) -> DataFrame:
    """All records of the archives (archive, bytes), in columns RECORDS; payloads=False leaves that column null."""
    step = F.lit(split_bytes).cast("long")
    tasks = manifest.agg(F.sum(F.ceil(F.col("bytes") / step))).first()[0] or 1
    ranges = manifest.where("bytes > 0").select("archive", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, step)).alias("start"))
    names = [x.split()[0] for x in RECORDS.split(", ")]
    schema = pa.schema([(n, {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[t]) for n, t in (x.split() for x in RECORDS.split(", "))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for archive, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for x in records_of_range(archive, start, start + split_bytes):
                    held.append(x if payloads else x | {"payload": None})
                    size += 300 + len(held[-1]["payload"] or b"")
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_pylist(held, schema=schema)
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=schema)

    return ranges.repartition(int(tasks)).mapInArrow(read, RECORDS).select(*names)


def op6_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_archives(table(spark, sf_dir, "pages"), Scratch(spark, "warc"))
    return read_archives(manifest, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op6_warc_round_trip": op6_warc_round_trip}

ORACLES = {
    "op6_warc_round_trip": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS sha FROM pages),
q AS (SELECT *, max(page_id) OVER (PARTITION BY sha) AS resp FROM p)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes,
  list_aggregate(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (((('0x' || substr(sha, 10 * (k // 8) + 1, 10))::BIGINT >> (5 * (7 - k % 8))) & 31) + 1)::BIGINT, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = resp THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> resp THEN resp END AS refers_to
FROM q
"""
}
