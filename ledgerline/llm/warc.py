"""WARC archives: one record for each page, equal payloads stored once, and a reader that goes on behind damage."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerline.runtime import scratch_path

LEAST_BYTES = 100
GZIP = b"\x1f\x8b\x08"
VERSION = b"WARC/1."
# Between two members. A padding byte, which readers of gzip files skip: Spark's text sink needs a separator that is not empty.
PADDING = "\0"
HEAD = re.compile(rb"WARC/1\.[01]\r\n((?:[!-9;-~]+:[^\r\n]*\r\n)+)\r\n")
ID = "urn:page:"
DIGESTS = ("md5", "sha1", "sha256", "sha512")
# Compressed bytes that are unpacked at a time.
UNPACK_BYTES = 1 << 16


def record(page: int | None, url: str | None, payload: bytes, first: int | None, digest: str) -> bytes:
    """One record: a response with an HTTP message, or a revisit that names the page holding the equal payload."""
    if first is None:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
        kind, more = "response", []
    else:
        block, kind, more = b"HTTP/1.1 200 OK\r\n\r\n", "revisit", [f"WARC-Refers-To: <{ID}{first}>"]
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{ID}{'' if page is None else page}>", f"WARC-Target-URI: {target}",
        "WARC-Date: 1970-01-01T00:00:00Z", *more, f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """The record as a gzip member of its own."""
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


@dataclass(frozen=True)
class Record:
    """Headers (names in lower case) and block of a record, and where it stood in its archive.

    Of a compressed record, [start, end) is its member and ``inner`` its place in the unpacked content.
    """

    headers: dict[str, str]
    block: bytes
    start: int
    end: int
    inner: int | None = None

    @property
    def payload(self) -> bytes:
        return self.block.partition(b"\r\n\r\n")[2]


@dataclass(frozen=True)
class Gap:
    """Bytes that belong to no valid record, and why the reader gave up at their start.

    Where the member is sound but its content is not, [start, end) is the member and ``inner`` the range in the unpacked content.
    """

    start: int
    end: int
    reason: str
    inner: tuple[int, int] | None = None


def _parse(data: bytes, at: int) -> tuple[dict[str, str], int, int] | str:
    """Headers, start and end of the block of the plain record at ``at``; or what is wrong with it."""
    head = HEAD.match(data, at)
    if not head:
        return "no header"
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head[1].decode("utf-8", "replace").split("\r\n")[:-1])}
    length = headers.get("content-length", "")
    if not length.isdigit():
        return "no length"
    end = head.end() + int(length)
    if data[end : end + 4] != b"\r\n\r\n":
        return "wrong length"
    kind, _, digest = headers.get("warc-block-digest", "").partition(":")
    if kind.strip().lower() in DIGESTS:
        found = hashlib.new(kind.strip().lower(), data[head.end() : end]).digest()
        # Digests are written in base 32 or as hexadecimal numbers.
        if digest.strip().lower() not in (found.hex(), base64.b32encode(found).decode().lower()):
            return "wrong digest"
    return headers, head.end(), end


def _unpacked(data: bytes, at: int) -> tuple[bytes, int | None, str]:
    """Content of the gzip member at ``at``, its end, and what is wrong with it; of a broken one what could be unpacked, and no end."""
    unpacker = zlib.decompressobj(31)
    view = memoryview(data)[at:]
    parts = []
    for start in range(0, len(view), UNPACK_BYTES):
        try:
            parts.append(unpacker.decompress(view[start : start + UNPACK_BYTES]))
        except zlib.error:
            return b"".join(parts), None, "damaged member"
        if unpacker.eof:
            end = at + min(start + UNPACK_BYTES, len(view)) - len(unpacker.unused_data)
            return b"".join(parts), end, ""
    return b"".join(parts), None, "cut member"


def _inside(content: bytes, start: int, end: int) -> Iterator[Record | Gap]:
    """The records in the content of a member that lies at [start, end), and a gap for each run of bytes between them."""
    at, lost, reason = 0, -1, ""
    while at < len(content):
        got = _parse(content, at)
        if isinstance(got, str):
            lost, reason = (at, got) if lost < 0 else (lost, reason)
            further = content.find(VERSION, at + 1)
            at = len(content) if further < 0 else further
            continue
        if lost >= 0:
            yield Gap(start, end, reason, (lost, at))
            lost = -1
        yield Record(got[0], content[got[1] : got[2]], start, end, at)
        at = got[2] + 4
    if lost >= 0 or not content:
        yield Gap(start, end, reason or "no header", (max(lost, 0), len(content)))


def _next(data: bytes, at: int) -> int:
    """Where a member or a version line may begin next."""
    return min((x for x in (data.find(GZIP, at), data.find(VERSION, at)) if x >= 0), default=len(data))


def salvage(data: bytes) -> Iterator[Record | Gap]:
    """All valid records of an archive, compressed by member or plain, and a gap for each run of bytes between them.

    A record counts if its length, the line breaks behind it and its block digest (any of DIGESTS) hold. A member may hold several;
    of a member whose stream breaks off or fails its checksum, the records unpacked up to there count too, and the rest of it is a
    gap. Behind a failure the search goes on at the next place that looks like a member or a version line, one byte further at
    least, so damage costs the records that it touches and no others. Every byte but padding is in a record or a gap.
    """
    at, lost, reason = 0, -1, ""
    while at < len(data):
        if data[at] == 0 and lost < 0:
            at += 1
            continue
        got: list[Record | Gap] | str
        if data.startswith(GZIP, at):
            content, end, wrong = _unpacked(data, at)
            if end is None:
                # The records in front of the break; their member has no end, so it is told by its first byte alone.
                got = [x for x in _inside(content, at, at) if isinstance(x, Record)] if HEAD.match(content) else []
                if got and lost >= 0:
                    yield Gap(lost, at, reason)
                    lost = -1
                yield from got
                got = wrong
            else:
                got = list(_inside(content, at, end))
        else:
            inner = _parse(data, at)
            end = len(data) if isinstance(inner, str) else inner[2] + 4
            got = inner if isinstance(inner, str) else [Record(inner[0], data[inner[1] : inner[2]], at, end)]
        if isinstance(got, str):
            lost, reason = (at, got) if lost < 0 else (lost, reason)
            at = _next(data, at + 1)
            continue
        if lost >= 0:
            yield Gap(lost, at, reason)
            lost = -1
        yield from got
        at = end
    if lost >= 0:
        yield Gap(lost, len(data), reason)


def write_archives(pages: DataFrame, folder: str, id: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST_BYTES) -> None:
    """One archive for each partition of ``pages``: a gzip member for each row, its payload the html in UTF-8 (null: empty).

    Of rows with equal payloads of ``least`` bytes or more, that with the smallest id is stored and the others refer to it. Only ids
    and digests are shuffled to find them, and payloads only meet the ids of those that occur more than once.
    """
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(id).cast("long").alias("id"), F.col(url).cast("string").alias("url"), payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    firsts = rows.where(F.octet_length("payload") >= least).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1")
    known = rows.join(firsts.select("digest", "first"), "digest", "left")

    def pack(batches):
        for batch in batches:
            ids, urls, payloads, digests, first = (batch.column(i).to_pylist() for i in range(5))
            made = [
                member(record(i, u, p, f if f is not None and f != i else None, d)) for i, u, p, d, f in zip(ids, urls, payloads, digests, first)
            ]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], names=["member"])

    packed = known.select("id", "url", "payload", "digest", "first").mapInArrow(pack, "member binary")
    # The sink writes the bytes of a string as they are.
    packed.select(F.col("member").cast("string")).write.option("lineSep", PADDING).text(folder)


def _number(urn: str) -> int | None:
    found = re.fullmatch(rf"<{ID}(-?\d+)>", urn)
    return int(found[1]) if found else None


RECORDS = (
    "path string, first long, last long, id long, kind string, refers_to long, bytes long, digest string, reason string, "
    "inner_first long, inner_last long"
)


def read_archives(spark, folder: str) -> DataFrame:
    """A row for each record and each quarantined gap of the archives below ``folder``, read through Spark.

    Records have id, kind, refers_to, and the size and SHA-256 of the payload read (of a revisit: the digest it names). Gaps have
    kind ``gap`` and a reason. [first, last) are the bytes in the archive, and for what lies inside a compressed member ``inner_first``
    and (of gaps) ``inner_last`` those in its content. One archive is held in memory at a time.
    """
    files = spark.read.format("binaryFile").load(folder).select("path", "content")

    def unpack(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = []
                for x in salvage(content.as_py()):
                    if isinstance(x, Gap):
                        rows.append((path, x.start, x.end, None, "gap", None, None, None, x.reason, *(x.inner or (None, None))))
                        continue
                    kind, h = x.headers.get("warc-type", ""), x.headers
                    stored = kind != "revisit"
                    digest = hashlib.sha256(x.payload).hexdigest() if stored else h.get("warc-payload-digest", "").partition(":")[2]
                    refers = None if stored else _number(h.get("warc-refers-to", ""))
                    rows.append((path, x.start, x.end, _number(h.get("warc-record-id", "")), kind, refers, len(x.payload) if stored else None, digest, None, x.inner, None))
                kinds = tuple(pa.string() if x.endswith("string") else pa.int64() for x in RECORDS.split(", "))
                columns = list(zip(*rows)) or [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[x.split()[0] for x in RECORDS.split(", ")])

    return files.mapInArrow(unpack, RECORDS)


def round_trip(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(id, payload_bytes, payload_digest, record_type, refers_to) of every row, as read back from archives of them.

    A revisit gets size and digest from the record that it refers to. Null and empty html is an empty payload, a null id stays
    null (such a row is stored whole unless an equal payload has an id), repeated rows are records of their own, and an empty table
    gives an empty one.
    """
    spark = pages.sparkSession
    folder = scratch_path(spark, "warc")
    write_archives(pages, folder, id, url, html)
    records = read_archives(spark, folder).where("kind != 'gap'")
    stored = records.where("kind = 'response' and id is not null").groupBy(F.col("id").alias("refers_to"), "digest").agg(F.max("bytes").alias("stored_bytes"))
    joined = records.join(stored, ["refers_to", "digest"], "left")
    return joined.select(
        F.col("id").cast(dict(pages.dtypes)[id]).alias(id), F.coalesce("bytes", "stored_bytes").alias("payload_bytes"),
        F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), "refers_to",
    )
