"""WARC records in seekable Zstandard bundles.

Records are packed into bundles; within a bundle groups of records are independent Zstandard
frames, then comes a skippable frame that maps record ids to (frame, offset, length), and last
the seek table: the compressed and decompressed size of every frame. A reader takes the table
from the end of the file, finds a record's frame by its sizes, and decompresses that frame only.
Any Zstandard tool can read a bundle as a whole.

Bundles are written by Spark's own committer, one row a file: the row is the bundle without its
last four bytes, the magic number of the seek table, and that number is the line separator.
So executors write nothing beside Spark, and a lost task leaves nothing behind.

Payloads of at least `min_bytes` that are equal are stored once, in the record with the largest
id; the others are revisit records that refer to it.

Defined results: a null html is an empty payload; a null page_id is written as an empty id and
read back as null; rows that repeat are records of their own, and of repeated ids with one
payload each refers to the id they share; an empty table gives no bundles and no records; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import struct
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.sources.scratch import materialize, scratch_path

SKIPPABLE_INDEX, SKIPPABLE_TABLE = 0x184D2A50, 0x184D2A5E
#: Magic number at the end of a seek table (a fixed value of the format), little-endian.
TABLE_MAGIC = b"\xb1\xea\x92\x8f"
#: Bytes of a frame before compression, and of a bundle's frames after it.
FRAME_BYTES, BUNDLE_BYTES = 1 << 18, 64 << 20
#: Table of at most this many files (a path and a list of records each) is broadcast.
BROADCAST_FILES = 1000


def encode_record(
    record_id: str, kind: str, uri: str, payload: bytes, digest: str, payload_bytes: int, refers_to: str | None,
    date: str
) -> bytes:
    """One WARC record, whose block is an HTTP response. A revisit has its head alone, but the digest
    and size of the full payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n".encode()
    block = head + payload if kind == "response" else head
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{record_id}>", f"WARC-Date: {date}",
        f"WARC-Target-URI: {uri}", "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Payload-Length: {payload_bytes}"
    ]
    if refers_to is not None:
        lines += [
            f"WARC-Refers-To: <urn:page:{refers_to}>",
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        ]
    return "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def decode_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (by lower-case name) and payload of a record: its block without the HTTP head."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if version != "WARC/1.1":
        raise ValueError(f"not a WARC record: {version[:40]!r}")
    headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
    return headers, rest[: int(headers["content-length"])].partition(b"\r\n\r\n")[2]


class Bundle:
    """Collects records into frames."""

    def __init__(self, frame_bytes: int = FRAME_BYTES, level: int = 3):
        self.frame_bytes, self.compressor = frame_bytes, zstd.ZstdCompressor(level=level)
        self.frames: list[tuple[bytes, int]] = []
        self.index: list[tuple[str, int, int, int]] = []
        self.open, self.size = bytearray(), 0  # size: of the compressed frames

    def add(self, record_id: str, record: bytes) -> None:
        self.index.append((record_id, len(self.frames), len(self.open), len(record)))
        self.open += record
        if len(self.open) >= self.frame_bytes:
            self._close_frame()

    def _close_frame(self) -> None:
        if self.open:
            self.frames.append((self.compressor.compress(bytes(self.open)), len(self.open)))
            self.size += len(self.frames[-1][0])
            self.open = bytearray()

    def finish(self) -> bytes:
        self._close_frame()
        index = zstd.ZstdCompressor(level=3).compress(json.dumps(self.index, separators=(",", ":")).encode())
        skip = struct.pack("<II", SKIPPABLE_INDEX, len(index)) + index
        sizes = [(len(c), n) for c, n in self.frames] + [(len(skip), 0)]
        table = b"".join(struct.pack("<II", *x) for x in sizes) + struct.pack("<IB", len(sizes), 0) + TABLE_MAGIC
        return b"".join([*(c for c, _ in self.frames), skip, struct.pack("<II", SKIPPABLE_TABLE, len(table)), table])


def seek_table(data: bytes) -> list[tuple[int, int, int]]:
    """(start, compressed size, decompressed size) of each frame, from the end of a bundle."""
    if data[-4:] != TABLE_MAGIC:
        raise ValueError("no seek table at the end")
    n = struct.unpack("<I", data[-9:-5])[0]
    at, out = 0, []
    for packed, size in struct.iter_unpack("<II", data[-9 - 8 * n : -9]):
        out.append((at, packed, size))
        at += packed
    return out


def record_index(data: bytes) -> list[list]:
    """[record id, frame, offset in the decompressed frame, length] of each record."""
    at, packed, _ = seek_table(data)[-1]
    return json.loads(zstd.ZstdDecompressor().decompress(data[at + 8 : at + packed]))


def read_frame(data: bytes, frame: int) -> bytes:
    at, packed, size = seek_table(data)[frame]
    return zstd.ZstdDecompressor().decompress(data[at : at + packed], max_output_size=size)


def revisits(pages: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """digest, n_bytes and keeper (the largest page_id) of each payload that several pages
    share; partial sums make a hot payload one row a task."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    sums = pages.select(
        "page_id", F.sha1(payload).alias("digest"), F.length(payload).cast("long").alias("n_bytes")
    ).where(F.col("n_bytes") >= min_bytes)
    shared = sums.groupBy("digest", "n_bytes").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n"))
    return materialize(shared.where("n > 1").drop("n"), "warc-shared")


def write_bundles(
    pages: DataFrame, path: str, min_bytes: int = 1000, bundle_bytes: int = BUNDLE_BYTES,
    frame_bytes: int = FRAME_BYTES, date: str | None = None
) -> None:
    """Writes a record for every page to bundles below path. date (now by default, one for all): when
    the pages were fetched, which their table doesn't tell. A page's role is joined by its
    digest: both sides are plain shuffles, so a hot digest is split by adaptive execution."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    known = pages.select("page_id", "url", payload.alias("payload"), F.sha1(payload).alias("digest"))
    shared = revisits(pages, min_bytes).select(F.col("digest").alias("its_digest"), "n_bytes", "keeper")
    same = (F.col("digest") == F.col("its_digest")) & (F.length("payload") == F.col("n_bytes"))
    rows = known.join(shared.hint("merge"), same, "left").select("page_id", "url", "payload", "digest", "keeper")
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle = Bundle(frame_bytes)

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"body": pa.array([bundle.finish()[:-4]], pa.binary())})

        for batch in batches:
            for page, url, data, digest, keeper in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                name = "" if page is None else str(page)
                visit = keeper is not None and keeper != page
                uri = (url or "").replace("\r", "%0D").replace("\n", "%0A")
                bundle.add(
                    name,
                    encode_record(
                        name, "revisit" if visit else "response", uri, data, digest, len(data),
                        str(keeper) if visit else None, date
                    )
                )
                if bundle.size >= bundle_bytes:
                    yield close()
                    bundle = Bundle(frame_bytes)
        if bundle.index:
            yield close()

    bodies = rows.mapInArrow(run, "body binary").select(F.col("body").cast("string").alias("value"))
    separator = TABLE_MAGIC.decode("latin-1")
    bodies.write.option("maxRecordsPerFile", 1).option("encoding", "ISO-8859-1").option("lineSep", separator).option("compression", "none").text(path)


def bundles(spark: SparkSession, path: str) -> DataFrame:
    """path and content of every bundle; a file of no bytes is Spark's mark of an empty write."""
    return spark.read.format("binaryFile").load(path).select("path", "content").where(F.length("content") > 0)


def index_bundles(spark: SparkSession, path: str) -> DataFrame:
    """record_id, path, frame, offset and length of every record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids, frames, offsets, lengths = zip(*record_index(data.as_py()), strict=True)
                yield pa.RecordBatch.from_pydict(
                    {
                        "record_id": pa.array(ids, pa.string()), "path": pa.array([name] * len(ids), pa.string()),
                        "frame": pa.array(frames, pa.int32()), "offset": pa.array(offsets, pa.int64()),
                        "length": pa.array(lengths, pa.int64())
                    }
                )

    return bundles(spark, path).mapInArrow(run, "record_id string, path string, frame int, offset long, length long")


def fetch(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """record_id, headers and payload of the records in wanted (record_id, path, frame, offset,
    length: rows of the index). Only the frames that hold them are decompressed. A file is read as
    a whole, once: Spark's readers have no ranges."""
    per_file = wanted.groupBy("path").agg(
        F.collect_list(F.struct("record_id", "frame", "offset", "length")).alias("records")
    )
    per_file = materialize(per_file, "warc-wanted")
    per_file = per_file.hint("broadcast" if per_file.count() <= BROADCAST_FILES else "merge")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, records in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                data, held = data.as_py(), {}
                for r in records:
                    if r["frame"] not in held:
                        held[r["frame"]] = read_frame(data, r["frame"])
                    headers, block = decode_record(held[r["frame"]][r["offset"] : r["offset"] + r["length"]])
                    yield pa.RecordBatch.from_pydict(
                        {
                            "record_id": pa.array([r["record_id"]]),
                            "headers": pa.array([list(headers.items())], pa.map_(pa.string(), pa.string())),
                            "payload": pa.array([block], pa.binary())
                        }
                    )

    return bundles(spark, path).join(per_file, "path").select("content", "records").mapInArrow(
        run, "record_id string, headers map<string,string>, payload binary"
    )


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to and url of every record,
    frame by frame. The digest and size of a response are taken from the payload that was read
    and must agree with its headers; those of a revisit are its headers'."""

    def number(urn: str | None) -> int | None:
        digits = (urn or "").removeprefix("<urn:page:").removesuffix(">")
        return int(digits) if digits else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                data = data.as_py()
                by_frame: dict[int, list] = {}
                for _, frame, offset, length in record_index(data):
                    by_frame.setdefault(frame, []).append((offset, length))
                for frame, places in by_frame.items():
                    raw, rows = read_frame(data, frame), []
                    for offset, length in places:
                        h, block = decode_record(raw[offset : offset + length])
                        digest, size = h["warc-payload-digest"].removeprefix("sha1:"), int(h["warc-payload-length"])
                        if h["warc-type"] == "response" and (
                            hashlib.sha1(block).hexdigest(), len(block)
                        ) != (digest, size):
                            raise ValueError(f"payload of {h['warc-record-id']} doesn't agree with its headers")
                        rows.append(
                            (
                                number(h["warc-record-id"]), size, digest, h["warc-type"],
                                number(h.get("warc-refers-to")), h["warc-target-uri"]
                            )
                        )
                    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                        names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"]
                    )

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"
    return bundles(spark, path).select("content").mapInArrow(run, schema)


def round_trip(pages: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """Writes all pages to bundles in the shared folder and reads them back."""
    path = scratch_path(pages.sparkSession, "warc")
    write_bundles(pages, path, min_bytes)
    return read_records(pages.sparkSession, path).drop("url")
