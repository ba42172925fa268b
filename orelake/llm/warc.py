"""WARC records in seekable Zstandard bundles.

Method. Records are grouped into independent Zstandard frames of about ``FRAME_BYTES``; a bundle is a run of frames and
a footer seek table in a skippable frame (magic 0x184D2A5E, one pair of sizes for each frame, then the number of frames,
a descriptor and 0x8F92EAB1). An index maps each record's identifier to its frame and its offset in that frame, so one
record is read by opening one frame. A bundle ends after ``BUNDLE_BYTES``; none grows with the input.

Bundles are rows of a Parquet table (name, data, index) in a shared folder, written and read by Spark alone, so they
reach any store that Spark reaches and survive lost executors; ``export`` puts them down as ``.warc.zst`` files.

Of records with equal payloads of at least ``min_bytes`` bytes, the one with the smallest id is the response and the
others are revisits, which name it and carry no payload. Only payloads' digests are compared: they are grouped with
partial aggregation, and only those found twice are joined back.

Defined cases: a null payload is an empty one; a null url is written as ``urn:none``; of rows that repeat an id, each
gives a record, and rows with the smallest id are all responses; a row with a null id refers to the others as any
other, and is the response only where no row has an id; an empty table gives no bundle and no row.
"""

from __future__ import annotations

import hashlib
import os
import struct
from collections.abc import Iterator

import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import BROADCAST_BYTES, arrow_map, cut, shared_dir

FRAME_BYTES, BUNDLE_BYTES, LEVEL = 1 << 18, 1 << 24, 3
#: The magic numbers of the seekable format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, kind: str) -> bytes:
    """One WARC/1.1 record; the block of a revisit is empty, its headers give the full payload's digest and length."""
    block = payload if kind == "response" else b""
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {(url or 'urn:none').replace(chr(13), '%0D').replace(chr(10), '%0A')}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and end of the record at an offset."""
    stop = data.index(b"\r\n\r\n", at)
    lines = data[at:stop].decode("utf-8", "surrogatepass").split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("no WARC record at this offset")
    head = dict(x.split(": ", 1) for x in lines[1:])
    begin = stop + 4
    end = begin + int(head["Content-Length"])
    return head, data[begin:end], end + 4


class Bundle:
    """Collects records; ``close`` gives the archive's bytes and its index."""

    def __init__(self) -> None:
        self.zstd = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True)
        self.frames: list[bytes] = []
        self.sizes: list[tuple[int, int]] = []
        self.held, self.length, self.total = [], 0, 0
        self.index: list[tuple[str, int, int, int]] = []

    def add(self, identifier: str, data: bytes) -> None:
        self.index.append((identifier, len(self.sizes), self.length, len(data)))
        self.held.append(data)
        self.length += len(data)
        if self.length >= FRAME_BYTES:
            self._frame()

    def _frame(self) -> None:
        if self.held:
            packed = self.zstd.compress(b"".join(self.held))
            self.frames.append(packed)
            self.sizes.append((len(packed), self.length))
            self.total += len(packed)
            self.held, self.length = [], 0

    def close(self) -> tuple[bytes, list[tuple[str, int, int, int]]]:
        self._frame()
        table = b"".join(struct.pack("<II", *s) for s in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        return b"".join([*self.frames, struct.pack("<II", SKIPPABLE, len(table)), table]), self.index


class Reader:
    """Opens single frames of a bundle by its footer."""

    def __init__(self, data: bytes):
        n, _, magic = struct.unpack("<IBI", data[-9:])
        if magic != SEEKABLE:
            raise ValueError("no seek table")
        sizes = struct.unpack(f"<{2 * n}I", data[-9 - 8 * n : -9])
        self.data, self.starts, at = data, [], 0
        for packed in sizes[::2]:
            self.starts.append((at, at + packed))
            at += packed
        self.zstd = zstandard.ZstdDecompressor()
        self.open: tuple[int, bytes] = (-1, b"")

    def record(self, frame: int, offset: int) -> tuple[dict[str, str], bytes]:
        if self.open[0] != frame:
            a, b = self.starts[frame]
            self.open = frame, self.zstd.decompress(self.data[a:b])
        head, block, _ = parse(self.open[1], offset)
        return head, block


def with_kinds(pages: DataFrame, min_bytes: int = 100) -> DataFrame:
    """page_id, url, html, and the digest, record_type and refers_to of each row."""
    d = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    d = d.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256)).withColumn("size", F.octet_length("html"))
    copies = d.where(F.col("size") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    copies = cut(copies.select(F.col("digest").alias("d2"), "first"))
    side = F.broadcast(copies) if copies.count() * 100 <= BROADCAST_BYTES else copies.hint("merge")
    d = d.join(side, (F.col("digest") == F.col("d2")) & (F.col("size") >= min_bytes), "left").drop("d2")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return d.select("page_id", "url", "html", "digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first")).alias("refers_to"))


def write_bundles(pages: DataFrame, path: str, min_bytes: int = 100) -> None:
    """Writes the bundles of all pages as a Parquet table at ``path``."""

    def rows(it: Iterator[tuple]) -> Iterator[tuple]:
        def close(b: Bundle) -> tuple:
            data, index = b.close()
            return hashlib.sha256(data).hexdigest()[:32] + ".warc.zst", data, [dict(zip(("id", "frame", "offset", "length"), x)) for x in index]

        bundle = Bundle()
        for page_id, url, html, digest, kind, refers_to in it:
            data = record(page_id, url, html.encode("utf-8", "surrogatepass"), digest, refers_to, kind)
            bundle.add(f"urn:page:{'' if page_id is None else page_id}", data)
            if bundle.total + bundle.length >= BUNDLE_BYTES:
                yield close(bundle)
                bundle = Bundle()
        if bundle.index:
            yield close(bundle)

    arrow_map(with_kinds(pages, min_bytes), rows, "name string, data binary, index array<struct<id:string,frame:int,offset:int,length:int>>", 1).write.option("compression", "uncompressed").parquet(path)


def read_bundles(bundles: DataFrame) -> DataFrame:
    """Reads all records of a bundle table by seek table and index: page_id, url, payload_bytes, payload_digest, record_type, refers_to."""

    def number(urn: str) -> int | None:
        got = urn.removeprefix("<urn:page:").removesuffix(">")
        return int(got) if got else None

    def rows(it: Iterator[tuple]) -> Iterator[tuple]:
        for data, index in it:
            reader = Reader(data)
            for x in index:
                head, block = reader.record(x["frame"], x["offset"])
                digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
                kind = head["WARC-Type"]
                if kind == "response" and hashlib.sha256(block).hexdigest() != digest:
                    raise ValueError(f"damaged record {x['id']}")
                size = len(block) if kind == "response" else int(head["X-Payload-Length"])
                yield number(head["WARC-Record-ID"]), head["WARC-Target-URI"], size, digest, kind, number(head["WARC-Refers-To"]) if kind == "revisit" else None

    return arrow_map(bundles.select("data", "index"), rows, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def export(bundles: DataFrame, folder: str) -> int:
    """Puts bundles down as files in a folder of the driver; one bundle is in memory at a time."""
    os.makedirs(folder, exist_ok=True)
    n = 0
    for name, data in bundles.select("name", "data").toLocalIterator():
        with open(os.path.join(folder, name), "wb") as f:
            f.write(data)
        n += 1
    return n


def archive_digests(pages: DataFrame) -> DataFrame:
    """Writes the archives of all pages to the shared folder and reads them back."""
    spark = pages.sparkSession
    path = shared_dir(spark, "warc")
    write_bundles(pages, path)
    return read_bundles(spark.read.parquet(path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS n, sha256(html) AS h FROM p),
f AS (SELECT h, min(page_id) AS first FROM d WHERE n >= 100 GROUP BY h)
SELECT d.page_id, d.n::BIGINT AS payload_bytes, d.h AS payload_digest,
       CASE WHEN f.first IS NOT NULL AND d.page_id IS DISTINCT FROM f.first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f.first IS NOT NULL AND d.page_id IS DISTINCT FROM f.first THEN f.first END AS refers_to
FROM d LEFT JOIN f ON d.h = f.h AND d.n >= 100
"""
