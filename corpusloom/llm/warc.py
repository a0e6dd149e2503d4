"""Operator 9: web archive files, compressed record by record with a dictionary of their own.

Pages become WARC/1.1 resource records, after a warcinfo record. A shard is a file's worth of records,
taken in order from one task's pages until SHARD_BYTES are gathered, and never split over tasks, so
that nothing is shuffled. A Zstandard dictionary is built from all records of the shard: trained on
them, or, where they are too few or too short for training, which Zstandard reports, their first
bytes as they stand. The file starts with a
skippable frame (magic 0x184D2A5D) that holds it, and each record follows as a frame of its own, so
that a reader needs only the file's head and an offset. Zstandard checks each record's content sum.

Rows of the result are frames: row 0 of a shard is the dictionary's, row 1 the warcinfo record's, both
with null page_id; the frames of a shard in order of record_no are the file; raw_bytes is what a
frame holds. The shard's name is the task's number and a running
number: a task that runs again on the same input writes the same shards, byte for byte.

Defined results: page_id is a number; null or empty html is a record with an empty block; null url leaves
the target URI out; line feeds in a url are percent-encoded; repeated rows and rows with equal
page_id are archived as often as they come (no ties arise); rows with null page_id are archived as well
(read_shard gives them back, their row has record_no but null page_id); a page of any length is one
record, which may make its shard longer than SHARD_BYTES; an empty table has no shards; the date of
capture is that of ``date_column``, if named and not null, else ``date``; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAGIC = 0x184D2A5D
SHARD_BYTES = 16 << 20
DICTIONARY_BYTES = 64 << 10
LEVEL = 3
DATE = "1970-01-01T00:00:00Z"
_SPACE = uuid.UUID("5f0b1d44-7a0c-4b5a-9a35-0f6f0b7f3c11")


def record(page_id: int | None, url: str | None, html: str | None, date: str = DATE) -> bytes:
    block = (html or "").encode()
    digest = hashlib.sha256(block).hexdigest()
    name = uuid.uuid5(_SPACE, f"{page_id}\n{url}\n{digest}")
    head = ["WARC/1.1", "WARC-Type: resource", f"WARC-Record-ID: <urn:uuid:{name}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    head += ["Content-Type: text/html; charset=utf-8", f"WARC-Block-Digest: sha256:{digest}", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def info(shard: str, date: str = DATE) -> bytes:
    """The warcinfo record of a shard."""
    block = b"software: corpusloom\r\nformat: WARC File Format 1.1\r\n"
    head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(_SPACE, shard)}>", f"WARC-Date: {date}", f"WARC-Filename: {shard}.warc.zst", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def build_dictionary(records: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary of at most size bytes and about a sixteenth of the records'; none if size is 0."""
    import zstandard

    size = min(size, max(256, sum(map(len, records)) // 16))
    if not size or not records:
        return b""
    try:
        return zstandard.train_dictionary(size, records, k=512, d=8, f=18, accel=1, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # too few samples: a dictionary of content, which Zstandard takes as well
        return b"".join(records)[:size]


def shard_frames(records: list[bytes], level: int = LEVEL, dictionary_bytes: int = DICTIONARY_BYTES) -> list[bytes]:
    import zstandard

    raw = build_dictionary(records, dictionary_bytes)
    used = zstandard.ZstdCompressionDict(raw) if raw else None
    c = zstandard.ZstdCompressor(level=level, dict_data=used, write_checksum=True, write_content_size=True)
    return [struct.pack("<II", MAGIC, len(raw)) + raw, *(c.compress(r) for r in records)]


def read_shard(data: bytes) -> Iterator[tuple[dict[str, str], str]]:
    """Headers and html of each page's record of a file."""
    for r in read_records(data):
        head, _, block = r.partition(b"\r\n\r\n")
        headers = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        if headers["WARC-Type"] == "resource":
            yield headers, block[:-4].decode()


def read_records(data: bytes) -> Iterator[bytes]:
    import zstandard

    magic, size = struct.unpack_from("<II", data)
    if magic != MAGIC:
        raise ValueError("no dictionary frame at the start")
    raw, at = data[8 : 8 + size], 8 + size
    d = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw) if raw else None)
    while at < len(data):
        end = _next(data, at)
        yield d.decompressobj().decompress(data[at:end])
        at = end


def _next(data: bytes, at: int) -> int:
    """Where the frame that starts at ``at`` ends, by its block headers."""
    flags = data[at + 4]
    head = 5 + (0 if flags & 32 else 1) + (0, 1, 2, 4)[flags & 3] + ((1 if flags & 32 else 0), 2, 4, 8)[flags >> 6]
    at += head
    while True:
        block = int.from_bytes(data[at : at + 3], "little")
        at += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)
        if block & 1:
            return at + (4 if flags & 4 else 0)


def _write(shard_bytes: int, level: int, dictionary_bytes: int, date: str):
    names = ["shard", "record_no", "page_id", "offset", "raw_bytes", "frame"]

    def emit(shard: str, ids: list, records: list[bytes]) -> pa.RecordBatch:
        records = [info(shard, date), *records]
        frames = shard_frames(records, level, dictionary_bytes)
        offset, at = [], 0
        for f in frames:
            offset.append(at)
            at += len(f)
        n = len(frames)
        return pa.RecordBatch.from_arrays([pa.array([shard] * n), pa.array(range(n), pa.int64()), pa.array([None, None, *ids], pa.int64()), pa.array(offset, pa.int64()), pa.array([len(frames[0]) - 8, *map(len, records)], pa.int64()), pa.array(frames, pa.binary())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, number, ids, records, size = TaskContext.get().partitionId(), 0, [], [], 0
        for b in batches:
            for page, url, html, day in zip(*(b.column(i).to_pylist() for i in range(4))):
                r = record(page, url, html, day or date)
                ids.append(page)
                records.append(r)
                size += len(r)
                if size >= shard_bytes:
                    yield emit(f"{task:06d}-{number:04d}", ids, records)
                    number, ids, records, size = number + 1, [], [], 0
        if records:
            yield emit(f"{task:06d}-{number:04d}", ids, records)

    return run


def archive(pages: DataFrame, shard_bytes: int = SHARD_BYTES, level: int = LEVEL, dictionary_bytes: int = DICTIONARY_BYTES, date: str = DATE, date_column: str | None = None) -> DataFrame:
    """The frames of all shards. date_column: a timestamp of each page's capture."""
    day = F.date_format(F.col(date_column), "yyyy-MM-dd'T'HH:mm:ss'Z'") if date_column else F.lit(None).cast("string")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), day.alias("day"))
    return rows.mapInArrow(_write(shard_bytes, level, dictionary_bytes, date), "shard string, record_no long, page_id long, offset long, raw_bytes long, frame binary")


def write_files(frames: DataFrame, folder: str) -> DataFrame:
    """Write each shard of an archive to folder/shard.warc.zst; returns shard, path, bytes. folder is
    a path that all executors share, or a URI of a file system that Arrow knows. A file is written
    aside and renamed, so that a task that runs again replaces it as a whole."""

    def write(key, group):
        from pyarrow import fs

        order = sorted(zip(group["record_no"].to_pylist(), group["frame"].to_pylist()))
        name = key[0].as_py()
        store, root = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        path = f"{root}/{name}.warc.zst"
        aside = f"{path}.{uuid.uuid4().hex}.part"
        with store.open_output_stream(aside, compression=None) as f:
            for _, frame in order:
                f.write(frame)
        store.move(aside, path)
        return pa.table({"shard": [name], "path": [path], "bytes": pa.array([sum(len(f) for _, f in order)], pa.int64())})

    return frames.select("shard", "record_no", "frame").groupBy("shard").applyInArrow(write, "shard string, path string, bytes long")


def query(spark, sf_dir: str) -> DataFrame:
    return archive(spark.read.parquet(f"{sf_dir}/pages.parquet"))
