"""WARC records in seekable Zstandard bundles.

A bundle is a row of independent Zstandard frames, each of whole records up to about `frame_bytes`, and ends with a seek
table: a skippable frame (so that any Zstandard reader can still read the bundle from front to back) of the frames' sizes
packed and unpacked, and a footer that names its length. The manifest maps each record to its bundle, its frame and its
offset and length in the unpacked frame; read_record() unpacks one frame only.

Of records with equal payloads of at least `least` bytes, the one with the smallest key is a response and the others are
revisits of it without a payload; their headers carry the full payload's digest and length. Digests are SHA-256.

A bundle's name is unique to the attempt that wrote it, and only bundles of attempts that ended are in the manifest, which
is written before anything reads it.

Cases: a null payload is empty; null URLs are left out; with several rows of the smallest key all of them are responses;
rows with a null key revisit the smallest key, and are responses if there is none; an empty table has no bundle and gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meridia.llm._store import bounded_batches, file_system, put, tasks, written

LEAST = 100
#: Bytes of records in a frame and of frames in a bundle; one larger record has a frame of its own.
FRAME, BUNDLE = 1 << 20, 64 << 20
#: Magic numbers of the seekable format: the skippable frame and the end of its footer.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The footer of frames of (packed, unpacked) bytes."""
    body = b"".join(struct.pack("<II", *f) for f in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


class Bundle:
    """A bundle opened for reading."""

    def __init__(self, uri: str) -> None:
        fs, path = file_system(uri)
        size = fs.get_file_info(path).size
        self.file = fs.open_input_file(path)
        self.file.seek(size - 9)
        n, flags, magic = struct.unpack("<IBI", self.file.read(9))
        if magic != SEEKABLE or flags:
            raise ValueError(f"{uri} has no seek table")
        self.file.seek(size - 9 - 8 * n)
        self.frames, at = [], 0
        for packed, unpacked in struct.iter_unpack("<II", self.file.read(8 * n)):
            self.frames.append((at, packed, unpacked))
            at += packed

    def frame(self, i: int) -> bytes:
        at, packed, unpacked = self.frames[i]
        self.file.seek(at)
        return zstandard.ZstdDecompressor().decompress(self.file.read(packed), max_output_size=unpacked)

    def close(self) -> None:
        self.file.close()


def record(key: str, url: str | None, payload: bytes | None, digest: str, size: int, refers_to: str | None) -> bytes:
    """A WARC/1.1 record; payload None makes it a revisit of the record refers_to."""
    head = [
        ("WARC-Type", "response" if payload is not None else "revisit"),
        ("WARC-Record-ID", f"<urn:key:{key}>"),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("Content-Type", "text/html; charset=utf-8"),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("X-Payload-Length", str(size)),
        ("Content-Length", str(len(payload or b""))),
    ]
    if url is not None:
        head.insert(3, ("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    if payload is None:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:key:{refers_to}>")]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + (payload or b"") + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """The headers and the block of the record at an offset, and where the next begins."""
    end = data.index(b"\r\n\r\n", at)
    first, *lines = data[at:end].decode().split("\r\n")
    if first != "WARC/1.1":
        raise ValueError("no WARC record begins here")
    head = dict(x.split(": ", 1) for x in lines)
    block = end + 4
    stop = block + int(head["Content-Length"])
    return head, data[block:stop], stop + 4


def read_record(uri: str, frame: int, offset: int) -> tuple[dict[str, str], bytes]:
    """One record by what the manifest says of it."""
    bundle = Bundle(uri)
    try:
        return parse(bundle.frame(frame), offset)[:2]
    finally:
        bundle.close()


def _key(uri: str) -> int | None:
    key = uri.removeprefix("<urn:key:").removesuffix(">")
    return None if key == "none" else int(key)


def write_bundles(pages: DataFrame, folder: str, least: int = LEAST, frame_bytes: int = FRAME, bundle_bytes: int = BUNDLE, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Writes a record for every row; returns the manifest (key, path, frame, offset, length)."""
    spark = pages.sparkSession
    bounded_batches(spark)
    rows = pages.select(F.col(key).cast("long").alias("key"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(payload), F.lit("")).alias("body"))
    rows = rows.withColumn("digest", F.sha2(F.encode("body", "UTF-8"), 256)).withColumn("size", F.octet_length("body").cast("long"))
    # keys of payloads that occur twice or more: without payloads, and few
    same = rows.filter(F.col("size") >= least).groupBy("digest").agg(F.min("key").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    rows = rows.join(same, "digest", "left").withColumn("refers_to", F.when(~F.col("key").eqNullSafe(F.col("first")), F.col("first")))
    rows = rows.withColumn("body", F.when(F.col("refers_to").isNull(), F.col("body"))).select("key", "url", "body", "digest", "size", "refers_to")
    schema = T.StructType.fromDDL("key bigint, path string, frame int, offset bigint, length bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, task = zstandard.ZstdCompressor(level=3), TaskContext.get().partitionId()
        frames, index, held, places, total = [], [], b"", [], 0

        def flush() -> None:
            nonlocal held, places, total
            packed = packer.compress(held)
            index.extend((k, len(frames), at, size) for k, at, size in places)
            frames.append((packed, len(held)))
            held, places, total = b"", [], total + len(packed)

        def bundle() -> pa.RecordBatch:
            nonlocal frames, index, total
            path = f"{folder}/pages-{task:06d}-{uuid.uuid4().hex}.warc.zst"
            put(path, [*[f for f, _ in frames], seek_table([(len(f), n) for f, n in frames])])
            keys, numbers, offsets, sizes = zip(*index, strict=True)
            out = pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([path] * len(keys)), pa.array(numbers, pa.int32()), pa.array(offsets, pa.int64()), pa.array(sizes, pa.int64())], names=schema.names)
            frames, index, total = [], [], 0
            return out

        buffer = bytearray()
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                k, u, body, digest, size, refers = row
                x = record("none" if k is None else str(k), u, None if body is None else body.encode(), digest, size, None if refers is None else str(refers))
                places.append((k, len(buffer), len(x)))
                buffer += x
                if len(buffer) >= frame_bytes:
                    held, buffer = bytes(buffer), bytearray()
                    flush()
                    if total >= bundle_bytes:
                        yield bundle()
        if buffer:
            held = bytes(buffer)
            flush()
        if frames:
            yield bundle()

    return written(rows.mapInArrow(run, schema))


def read_bundles(manifest: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url, path, frame, offset) of every record, from the bundles.

    The digest of a response is taken from the payload that was read, and held against its header.
    """
    spark = manifest.sparkSession
    bundles = manifest.select("path").distinct().repartition(tasks(spark))  # not by path: distinct() would take that over, and its few rows join in one task
    schema = T.StructType.fromDDL("page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string, path string, frame int, offset bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        shape = to_arrow_schema(schema)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                bundle = Bundle(path)
                for i in range(len(bundle.frames)):
                    data, at, rows = bundle.frame(i), 0, []
                    while at < len(data):
                        head, block, after = parse(data, at)
                        kind, digest, size = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha256:"), int(head["X-Payload-Length"])
                        if kind == "response" and (hashlib.sha256(block).hexdigest() != digest or len(block) != size):
                            raise ValueError(f"{path}, frame {i}, offset {at}: the payload doesn't fit its header")
                        refers = _key(head["WARC-Refers-To"]) if kind == "revisit" else None
                        rows.append((_key(head["WARC-Record-ID"]), size, digest, kind, refers, head.get("WARC-Target-URI"), path, i, at))
                        at = after
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), shape, strict=True)], schema=shape)
                bundle.close()

    return bundles.mapInArrow(run, schema)
