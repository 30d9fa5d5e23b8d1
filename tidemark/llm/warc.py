"""WARC archives in seekable Zstandard bundles.

A bundle is one file. Its records are grouped into frames that decompress on their own; a skippable
frame at the end is the seek table, in the published seekable format. The index maps a record to its
bundle, frame and place in the frame, so a record is read by one seek and one frame. Records with an
equal payload are written once and revisited by the others.

Tasks write files of a name of their own in the shared folder and return index rows; only rows of
tasks that succeeded are written to the index, so a repeated task leaves a file nobody refers to.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch
from tidemark.session import fresh_path

FRAME_BYTES = 256 << 10  # of records before compression; a larger record has a frame to itself
BUNDLE_BYTES = 64 << 20  # of compressed frames before the next file begins
TASK_BYTES = 32 << 20  # of records that a task reads back
REVISIT_BYTES = 100  # payloads from this size on are written once
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1  # magic numbers of the seek table's frame and its end
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def open_store(path: str):
    """The file system of a path or URI and the path within it."""
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
    return fs.LocalFileSystem(), path


# --- records ----------------------------------------------------------------------------------

def record(kind: str, key: str, uri: str, digest: str, payload: bytes, refers_to: str | None = None) -> bytes:
    """One WARC/1.1 record."""
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{key}>", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {' '.join(uri.split())}", f"WARC-Payload-Digest: sha256:{digest}"]
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + payload + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers, payload and the place after the record that begins at `at`."""
    head = data.index(b"\r\n\r\n", at)
    lines = data[at:head].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record here")
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    start = head + 4
    end = start + int(headers["Content-Length"])
    return headers, data[start:end], end + 4


# --- bundles ----------------------------------------------------------------------------------

class BundleWriter:
    """Writes one bundle; `add` returns (frame, offset, length) of the record."""

    def __init__(self, out, level: int = 3):
        import zstandard

        self.out, self.packer = out, zstandard.ZstdCompressor(level=level)
        self.frames: list[tuple[int, int]] = []
        self.waiting, self.waiting_size, self.written = [], 0, 0

    def add(self, data: bytes) -> tuple[int, int, int]:
        if self.waiting and self.waiting_size + len(data) > FRAME_BYTES:
            self.flush()
        place = len(self.frames), self.waiting_size, len(data)
        self.waiting.append(data)
        self.waiting_size += len(data)
        return place

    def flush(self) -> None:
        if self.waiting:
            packed = self.packer.compress(b"".join(self.waiting))
            self.out.write(packed)
            self.frames.append((len(packed), self.waiting_size))
            self.written += len(packed)
            self.waiting, self.waiting_size = [], 0

    def close(self) -> None:
        self.flush()
        table = b"".join(struct.pack("<II", *f) for f in self.frames)
        table += struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.out.close()


class BundleReader:
    """Random access to a bundle: the seek table is read from the end of the file."""

    def __init__(self, source):
        import zstandard

        self.source, self.unpacker = source, zstandard.ZstdDecompressor()
        size = source.size()
        source.seek(size - 9)
        count, flags, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEKABLE:
            raise ValueError("no seek table")
        entry = 12 if flags & 0x80 else 8
        source.seek(size - 9 - entry * count)
        table = source.read(entry * count)
        self.frames, at = [], 0
        for i in range(count):
            packed, plain = struct.unpack_from("<II", table, entry * i)
            self.frames.append((at, packed, plain))
            at += packed

    def frame(self, i: int) -> bytes:
        at, packed, plain = self.frames[i]
        self.source.seek(at)
        return self.unpacker.decompress(self.source.read(packed), max_output_size=plain)

    def record(self, frame: int, offset: int) -> tuple[dict[str, str], bytes]:
        return parse(self.frame(frame), offset)[:2]


# --- Spark ------------------------------------------------------------------------------------

def _writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_store(folder)
        bundle, path = None, None
        for whole in batches:
            for i in range(0, whole.num_rows, 200):
                batch = whole.slice(i, 200)
                rows = []
                for key, url, html, digest, first in zip(
                        *(batch.column(c).to_pylist() for c in ("rid", "url", "html", "digest", "first")), strict=True):
                    if bundle is None:
                        path = f"{base}/{uuid.uuid4().hex}.warc.zst"
                        store.create_dir(base, recursive=True)
                        bundle = BundleWriter(store.open_output_stream(path, compression=None))
                    payload = (html or "").encode() if first is None else b""
                    kind = "response" if first is None else "revisit"
                    rows.append((key, path, *bundle.add(record(kind, str(key), url or "", digest, payload, None if first is None else str(first)))))
                    if bundle.written > BUNDLE_BYTES:
                        bundle.close()
                        bundle = None
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["rid", "bundle", "frame", "offset", "length"])
        if bundle is not None:
            bundle.close()
    return run


def _reader(folder: str):
    def run(batches):
        store, _ = open_store(folder)
        for batch in batches:
            for path, frames in zip(batch.column("bundle").to_pylist(), batch.column("frames").to_pylist(), strict=True):
                with store.open_input_file(path) as source:
                    bundle = BundleReader(source)
                    for i in frames:
                        data, at, rows = bundle.frame(i), 0, []
                        while at < len(data):
                            start = at
                            headers, payload, at = parse(data, at)
                            refers = headers.get("WARC-Refers-To")
                            rows.append((
                                int(headers["WARC-Record-ID"][10:-1]), headers["WARC-Type"], headers["WARC-Payload-Digest"][7:],
                                len(payload), hashlib.sha256(payload).hexdigest(), int(refers[10:-1]) if refers else None, i, start, path))
                        cols = list(zip(*rows, strict=True)) if rows else [[]] * 9
                        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], [
                            "rid", "record_type", "digest", "bytes", "sha256", "refers", "frame", "offset", "bundle"])
    return run


def write_archives(pages: DataFrame, scratch: Scratch, folder: str, id_col="page_id", url_col="url", html_col="html"):
    """Write every page as a record under `folder`. Returns the numbered pages without their html
    (rid, id, payload_bytes, digest, first) and the index (rid, bundle, frame, offset, length).

    Of records with an equal payload of at least REVISIT_BYTES, that of the smallest id (null ids last,
    then the lowest row number) is the response; `first` is its row number for the others.
    """
    payload = F.coalesce(F.col(html_col), F.lit(""))
    rows = scratch.write(pages.select(
        F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"),
        F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha2(payload.cast("binary"), 256).alias("digest")), "pages")
    narrow = rows.select("rid", "id", "payload_bytes", "digest").where(F.col("payload_bytes") >= REVISIT_BYTES)
    # One row per payload that occurs more than once; a third of all pages may share one.
    shared = scratch.write(narrow.groupBy("digest").agg(
        F.count(F.lit(1)).alias("k"), F.min(F.struct(F.col("id").isNull(), "id", "rid")).alias("one")).where("k > 1").selectExpr(
            "digest", "one.rid as first"), "shared")
    again = scratch.write(narrow.join(shared, "digest").where("rid <> first").select("rid", "first"), "again")
    joined = rows.join(again.hint("shuffle_hash"), "rid", "left")
    index = scratch.write(joined.select("rid", "url", "html", "digest", "first").mapInArrow(
        _writer(folder), "rid long, bundle string, frame long, offset long, length long"), "index")
    return rows.join(again.hint("shuffle_hash"), "rid", "left").select("rid", "id", "payload_bytes", "digest", "first"), index


def read_archives(spark: SparkSession, index: DataFrame, folder: str, task_bytes: int = TASK_BYTES) -> DataFrame:
    """Every record of the bundles in `index`, read back frame by frame: rid, record_type, digest (as its
    header says), bytes and sha256 (of the payload in the record), refers, and bundle, frame, offset.

    Tasks share a bundle: each reads slices of its frames. Their number follows from the bytes to read, as
    the rows that name the slices are too small for adaptive execution to see the work behind them.
    """
    frames = index.groupBy("bundle", "frame").agg(F.sum("length").alias("bytes")).groupBy(
        "bundle", F.floor(F.col("frame") / 8).alias("slice")).agg(F.sort_array(F.collect_list("frame")).alias("frames"), F.sum("bytes").alias("bytes"))
    size = frames.agg(F.sum("bytes")).first()[0] or 0
    tasks = max(spark.sparkContext.defaultParallelism, -(-size // task_bytes))
    # Without a key the slices are dealt out evenly; a number given is kept.
    return frames.select("bundle", "frames").repartition(tasks).mapInArrow(
        _reader(folder), "rid long, record_type string, digest string, bytes long, sha256 string, refers long, frame long, offset long, bundle string")


def archive(pages: DataFrame, scratch: Scratch, id_col="page_id", url_col="url", html_col="html") -> DataFrame:
    """Write all pages, read the archives back: one row per page with page_id, payload_bytes,
    payload_digest, record_type, refers_to, and bundle, frame, offset of its record.

    Size and digest of a response are those of the payload read back; a revisit takes them from the
    response it refers to, after its own header has named the same digest. Null html is an empty
    payload; pages of an empty or short payload are all responses. Repeated rows and null ids are
    pages like any other. Other columns are ignored, whatever their names; an empty table gives no rows.
    """
    folder = fresh_path(pages.sparkSession, "warc")
    numbered, index = write_archives(pages, scratch, folder, id_col, url_col, html_col)
    back = scratch.write(read_archives(pages.sparkSession, index, folder), "back")
    ids = numbered.select("rid", "id")
    response = back.where("record_type = 'response'").select(
        F.col("rid").alias("refers"), F.col("bytes").alias("r_bytes"), F.col("sha256").alias("r_sha256")).join(
            back.where("refers is not null").select("refers").distinct(), "refers", "left_semi").join(
                ids.select(F.col("rid").alias("refers"), F.col("id").alias("r_id")), "refers")
    response = scratch.write(response, "responses")
    place = ["bundle", "frame", "offset"]
    own = back.where("refers is null").join(ids, "rid").select(
        F.col("id").alias("page_id"), F.col("bytes").alias("payload_bytes"), F.col("sha256").alias("payload_digest"),
        "record_type", F.lit(None).cast(ids.schema["id"].dataType).alias("refers_to"), *place)
    # One response may have very many revisits; it is in a written table, so adaptive execution splits them.
    same = F.col("digest") == F.col("r_sha256")
    revisits = back.where("refers is not null").join(response, "refers").join(ids, "rid").select(
        F.col("id").alias("page_id"), F.col("r_bytes").alias("payload_bytes"), F.when(same, F.col("r_sha256")).alias("payload_digest"),
        "record_type", F.col("r_id").alias("refers_to"), *place)
    return own.unionByName(revisits)
