"""WARC archives in seekable Zstandard bundles.

Each executor task writes one bundle or more: records are grouped into independent Zstandard frames of
about FRAME_BYTES, and a skippable frame at the end holds the seek table (the published seekable format:
compressed and uncompressed size of each frame). The index maps a record id to bundle, frame, offset in
the frame and length, so one record is read with two range reads: the seek table and its frame. Archives are
read through the index, too: its rows are dealt by groups of frames to as many tasks as their size asks for.

Bundles are written under the shared folder through pyarrow.fs, to a name of their own for each task
attempt; only the index of a task that ended well names its bundle.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formicary.llm.shared import HOT_KEYS, arrow_map, byte_rows, delete_on_exit, discard, join_spread, materialize, new_path

FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 256 << 20
#: Frames that are read by one task, one after the other, and plain bytes of all that one task reads.
FRAMES_TOGETHER = 4
TASK_BYTES = 256 << 20
MIN_REVISIT_BYTES = 1000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

# fixed values of the Zstandard seekable format
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1

INDEX = "record_id string, bundle string, frame int, offset long, length long"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, bundle string, frame int, offset long, length long"


# --- records ----------------------------------------------------------------------------------


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}:{digest}>"


def page_of(identifier: str) -> int | None:
    number = identifier.strip("<>").split(":")[2]
    return None if number == "none" else int(number)


def _uri(url: str) -> str:
    """A URL in a header line: control characters are percent-encoded."""
    return "".join(c if ord(c) >= 0x20 and ord(c) != 0x7F else f"%{ord(c):02X}" for c in url)


def make_record(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None) -> bytes:
    """A response with the payload, or a revisit of the response that has an equal one."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_uri(url)}")
    lines.append(f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {record_id(refers_to, digest)}", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


@dataclass
class Record:
    headers: dict[str, str]
    http: dict[str, str]
    payload: bytes
    offset: int
    length: int


def _headers(block: bytes) -> dict[str, str]:
    return {name.lower(): value.strip() for name, _, value in (x.partition(":") for x in block.decode().split("\r\n")[1:])}


def parse_records(data: bytes) -> Iterator[Record]:
    """The records of an uncompressed frame."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        head = _headers(data[at:end])
        body = data[end + 4 : end + 4 + int(head["content-length"])]
        http, _, payload = body.partition(b"\r\n\r\n")
        stop = end + 4 + len(body) + 4
        if not data.startswith(b"WARC/", at) or data[stop - 4 : stop] != b"\r\n\r\n":
            raise ValueError(f"no WARC record at offset {at}")
        yield Record(head, _headers(http), payload, at, stop - at)
        at = stop


# --- bundles ----------------------------------------------------------------------------------


class BundleWriter:
    """Frames to a stream; close() adds the seek table."""

    def __init__(self, stream, level: int = 3) -> None:  # noqa: ANN001
        self.stream, self.packer = stream, zstandard.ZstdCompressor(level=level)
        self.sizes: list[tuple[int, int]] = []
        self.frame, self.written = bytearray(), 0

    def add(self, record: bytes) -> tuple[int, int]:
        """(frame, offset in it) of the record."""
        if self.frame and len(self.frame) + len(record) > FRAME_BYTES:
            self.flush()
        spot = len(self.sizes), len(self.frame)
        self.frame += record
        return spot

    def flush(self) -> None:
        if self.frame:
            packed = self.packer.compress(bytes(self.frame))
            self.sizes.append((len(packed), len(self.frame)))
            self.stream.write(packed)
            self.written += len(packed)
            self.frame = bytearray()

    def close(self) -> None:
        self.flush()
        table = b"".join(struct.pack("<II", *x) for x in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE_MAGIC)
        self.stream.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table)
        self.stream.close()


class BundleReader:
    """Random access to the frames of a bundle by its seek table."""

    def __init__(self, path: str) -> None:
        fs, inner = pyarrow.fs.FileSystem.from_uri(path)
        self.file = fs.open_input_file(inner)
        size = self.file.size()
        frames, _, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEKABLE_MAGIC:
            raise ValueError(f"{path} has no seek table")
        table = self.file.read_at(8 * frames, size - 9 - 8 * frames)
        self.sizes = [struct.unpack_from("<II", table, 8 * k) for k in range(frames)]
        self.starts = [0]
        for packed, _ in self.sizes:
            self.starts.append(self.starts[-1] + packed)

    def frame(self, number: int) -> bytes:
        packed, plain = self.sizes[number]
        return zstandard.ZstdDecompressor().decompress(self.file.read_at(packed, self.starts[number]), max_output_size=plain)

    def record(self, frame: int, offset: int, length: int) -> Record:
        return next(parse_records(self.frame(frame)[offset : offset + length]))

    def close(self) -> None:
        self.file.close()


def _write_bundles(root: str, bundle_bytes: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, inner = pyarrow.fs.FileSystem.from_uri(root)
        writer, name, number = None, "", 0
        task = TaskContext.get()
        held: list[tuple] = []

        def rows() -> pa.RecordBatch:
            columns = list(zip(*held, strict=True)) if held else [[]] * 5
            held.clear()
            types = (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], ["record_id", "bundle", "frame", "offset", "length"])

        try:
            for batch in batches:
                ids, urls, digests = (batch.column(n).to_pylist() for n in ("page_id", "url", "digest"))
                sizes, refers = batch.column("bytes").to_pylist(), batch.column("refers_to").to_pylist()
                for k, payload in enumerate(byte_rows(batch.column("html"))):
                    if writer is None:
                        name = f"part-{task.partitionId():06d}-{number:04d}-{task.attemptNumber()}-{uuid.uuid4().hex[:8]}.warc.zst"
                        fs.create_dir(inner, recursive=True)
                        writer, number = BundleWriter(fs.open_output_stream(f"{inner}/{name}", compression=None)), number + 1
                    record = make_record(ids[k], urls[k], payload or b"", digests[k], sizes[k], refers[k])
                    frame, offset = writer.add(record)
                    held.append((record_id(ids[k], digests[k]), f"{root}/{name}", frame, offset, len(record)))
                    if writer.written >= bundle_bytes:
                        writer.close()
                        writer = None
                yield rows()
            if writer is not None:
                writer.close()
                writer = None
        finally:
            if writer is not None:
                writer.stream.close()

    return run


def write_archive(pages: DataFrame, root: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Write a record per row of pages under root; the index (record_id, bundle, frame, offset, length).

    Which payloads repeat is found on their digests; a digest of many rows doesn't bring these together. The payload
    is the html in UTF-8, empty if it is null. Of equal payloads of at least
    MIN_REVISIT_BYTES, the rows with the largest id are responses and the others revisit it; without
    any id in the group all are responses. Repeated rows give repeated records. Nothing is written
    for an empty table.
    """
    payload = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), F.sha1(payload).alias("digest"), F.octet_length(payload).cast("long").alias("bytes"))
    large = rows.filter(F.col("bytes") >= MIN_REVISIT_BYTES)
    keepers = materialize(large.groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("_n")).filter("_n > 1").withColumnRenamed("digest", "_large"), "warc-keepers")
    repeated = keepers.agg(F.sum("_n")).first()[0] or 0
    hot = [r[0] for r in keepers.filter(F.col("_n") >= max(50, -(-repeated // HOT_KEYS))).select("_large").collect()]  # HOT_KEYS at most
    joined = join_spread(rows.withColumn("_large", F.when(F.col("bytes") >= MIN_REVISIT_BYTES, F.col("digest"))), keepers, "_large", ["keeper"], hot)
    revisit = F.col("keeper").isNotNull() & (F.coalesce(F.col("page_id") < F.col("keeper"), F.lit(True)))
    decided = joined.withColumn("refers_to", F.when(revisit, F.col("keeper"))).select("page_id", "url", "html", "digest", "bytes", "refers_to")
    index = materialize(arrow_map(decided, _write_bundles(root, bundle_bytes), INDEX), "warc-index")
    discard(keepers)
    return index


def _read_places(with_payload: bool) -> Callable:
    """Records by their places; the places come sorted by bundle and frame, so that each frame is read once."""
    names = [x.split()[0] for x in RECORDS.split(", ")]
    types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, path, at, data = None, None, -1, b""
        for batch in batches:
            rows = []
            for identifier, bundle, frame, offset, length in zip(*(batch.column(c).to_pylist() for c in ("record_id", "bundle", "frame", "offset", "length")), strict=True):
                if bundle != path:
                    if reader:
                        reader.close()
                    reader, path, at = BundleReader(bundle), bundle, -1
                if frame != at:
                    data, at = reader.frame(frame), frame
                r = next(parse_records(data[offset : offset + length]))
                digest = base64.b32decode(r.headers["warc-payload-digest"].removeprefix("sha1:")).hex()
                kind, size = r.headers["warc-type"], int(r.http["content-length"])
                if r.headers["warc-record-id"] != identifier or r.length != length:
                    raise ValueError(f"{path}, frame {frame}, offset {offset}: not the record {identifier}")
                if kind == "response" and (len(r.payload) != size or hashlib.sha1(r.payload).hexdigest() != digest):
                    raise ValueError(f"{path}, frame {frame}, offset {offset}: the payload isn't what its headers say")
                refers = page_of(r.headers["warc-refers-to"]) if kind == "revisit" else None
                rows.append((page_of(identifier), r.headers.get("warc-target-uri"), size, digest, kind, refers, path, frame, offset, length, r.payload))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 11
            arrays = [pa.array(x, t) for x, t in zip(columns, (*types, pa.binary()), strict=True)]
            yield pa.RecordBatch.from_arrays(arrays if with_payload else arrays[:-1], [*names, "payload"] if with_payload else names)
        if reader:
            reader.close()

    return run


def read_records(index: DataFrame, with_payload: bool = False) -> DataFrame:
    """The record of every row of the index (or some rows of it), read at its place and verified.

    Neither bundles nor their seek tables are searched. As many tasks as partitions are set, at least, and as many
    as TASK_BYTES asks for; FRAMES_TOGETHER neighbouring frames go to one task.
    """
    size = index.agg(F.sum("length")).first()[0] or 0
    frames = -(-size // FRAME_BYTES)
    tasks = max(1, min(frames, int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))), -(-size // TASK_BYTES))
    task = F.pmod(F.xxhash64("bundle", F.floor(F.col("frame") / FRAMES_TOGETHER)), F.lit(tasks)).cast("int")
    dealt = index.select("record_id", "bundle", "frame", "offset", "length").repartitionById(tasks, task).sortWithinPartitions("bundle", "frame", "offset")
    return arrow_map(dealt, _read_places(with_payload), RECORDS + (", payload binary" if with_payload else ""))


def fetch(index: DataFrame, record_ids: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records whose record_id is among those of record_ids; only their frames are read."""
    return read_records(index.join(record_ids.select("record_id").distinct(), "record_id", "left_semi"), with_payload)


def read_archive(index: DataFrame) -> DataFrame:
    """Every record that the index names."""
    return read_records(index)


def round_trip(pages: DataFrame, **columns: str) -> DataFrame:
    """Write pages as an archive in the shared folder and read all of it again."""
    root = new_path(pages.sparkSession, "warc")
    index = write_archive(pages, root, **columns)
    delete_on_exit(pages.sparkSession, root)
    return read_archive(index)
