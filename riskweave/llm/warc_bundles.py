"""WARC records in seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each with whole WARC records, and a last skippable frame with the
seek table: the compressed and plain size of each frame, their number, and a magic number (the public seekable
format). Any reader of .zst files gets the plain WARC file. The index maps a record's identifier to its bundle, its
frame, and its offset and length in that frame, so one record costs one small read.

Of the records with equal payloads of at least ``revisit_from`` bytes, those with the largest page_id are responses, and
the others are revisits without payload that refer to it.

Scale: rows are written once with a number and the digest of their payload. Each task then writes bundles of its own under names that
no other attempt has, in the shared folder; the index table is written with Spark's commit protocol, so it names only files
of tasks that succeeded. Equal payloads are found by digest with partial aggregation; only digests that repeat are joined
back to the large payloads, broadcast if there are few; beyond that the rows of a hot digest are dealt to ``SALTS`` keys. Reading
deals ranges of ``RANGE`` frames, not bundles, so that neither few bundles nor a large one leaves the work to one task.

Defined results: a null html is an empty payload; a null url leaves out the target header; null page_ids come before
all others; rows equal in page_id and payload become records of their own, whose identifiers differ by the row's number (the
first has none, and revisits refer to it); an empty table gives no bundle and no rows; a very large payload is a frame
of its own; further columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_few, in_batches, materialize, new_folder, quoted, spread_out, table

# Fixed values of the seekable format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
FRAME_BYTES, BUNDLE_BYTES = 1 << 18, 1 << 28
#: Frames that one reading step takes, and keys over which the rows of one digest are dealt.
RANGE, SALTS = 32, 16
DATE = "2024-01-01T00:00:00Z"
INDEX = "record_id string, bundle string, frame int, offset long, length long"
RECORDS = "record_id string, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def record_id(page_id: int | None, digest: str, copy: int | None = None) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'page/{page_id}/{digest}' + (f'/{copy}' if copy is not None else ''))}>"


def safe(value: str) -> str:
    """A header value on one line: control characters and percent signs before two hex digits are percent-encoded."""
    if value.isprintable():
        return value
    return "".join(c if c.isprintable() else "".join(f"%{b:02X}" for b in c.encode()) for c in value)


def warc_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, copy: int | None = None) -> tuple[str, bytes]:
    name = record_id(page_id, digest, copy)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = {"WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": name, "WARC-Date": DATE}
    if url is not None:
        head["WARC-Target-URI"] = safe(url)
    if page_id is not None:
        head["X-Page-Id"] = str(page_id)
    head["WARC-Payload-Digest"] = f"sha1:{digest}"
    if revisit:
        head["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        head["WARC-Refers-To"] = record_id(refers_to, digest)
        if refers_to is not None:
            head["X-Refers-To-Page"] = str(refers_to)
    head |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    return name, b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def parsed(data: bytes, at: int = 0) -> tuple[dict, int]:
    """The record that starts at ``at``, as a row of RECORDS, and where it ends."""
    cut = data.index(b"\r\n\r\n", at)
    lines = data[at:cut].decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    head = dict(line.split(": ", 1) for line in lines[1:])
    block = data[cut + 4 : cut + 4 + int(head["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(http.rpartition(b"Content-Length: ")[2])
    number = lambda k: int(head[k]) if k in head else None
    revisit = head["WARC-Type"] == "revisit"
    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
    if not revisit and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"{head['WARC-Record-ID']} is damaged")
    row = {"record_id": head["WARC-Record-ID"], "page_id": number("X-Page-Id"), "url": head.get("WARC-Target-URI"), "record_type": head["WARC-Type"]}
    row |= {"refers_to": number("X-Refers-To-Page"), "payload_bytes": size, "payload_digest": digest, "payload": None if revisit else payload}
    return row, cut + 4 + int(head["Content-Length"]) + 4


@dataclass
class Bundle:
    """A bundle that is being written."""

    uri: str
    sizes: list[tuple[int, int]] = field(default_factory=list)
    plain: int = 0
    open_frame: bytearray = field(default_factory=bytearray)

    def __post_init__(self):
        store, path = fs.FileSystem.from_uri(self.uri)
        self.out = store.open_output_stream(path, compression=None)
        self.packer = zstandard.ZstdCompressor(level=3, write_checksum=True)

    def add(self, record: bytes) -> tuple[int, int, int]:
        """(frame, offset, length) of the record."""
        place = len(self.sizes), len(self.open_frame), len(record)
        self.open_frame += record
        if len(self.open_frame) >= FRAME_BYTES:
            self.end_frame()
        return place

    def end_frame(self) -> None:
        if self.open_frame:
            packed = self.packer.compress(bytes(self.open_frame))
            self.out.write(packed)
            self.sizes.append((len(packed), len(self.open_frame)))
            self.plain += len(self.open_frame)
            self.open_frame = bytearray()

    def close(self) -> None:
        self.end_frame()
        entries = b"".join(struct.pack("<II", *s) for s in self.sizes)
        self.out.write(struct.pack("<II", SKIPPABLE, len(entries) + 9) + entries + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE))
        self.out.close()


class BundleReader:
    """Frames of a bundle by number, found through its seek table."""

    def __init__(self, uri: str):
        store, path = fs.FileSystem.from_uri(uri)
        self.file = store.open_input_file(path)
        end = self.file.size()
        frames, _, magic = struct.unpack("<IBI", self.read(end - 9, 9))
        if magic != SEEKABLE:
            raise ValueError(f"{uri} has no seek table")
        table_bytes = self.read(end - 9 - 8 * frames, 8 * frames)
        self.starts, at = [], 0
        for packed, plain in struct.iter_unpack("<II", table_bytes):
            self.starts.append((at, packed, plain))
            at += packed

    def read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def frame(self, i: int) -> bytes:
        at, packed, plain = self.starts[i]
        return zstandard.ZstdDecompressor().decompress(self.read(at, packed), max_output_size=plain)

    def records(self, first: int = 0, end: int | None = None) -> Iterator[dict]:
        """The records of the frames from first up to end."""
        for i in range(first, len(self.starts) if end is None else end):
            data, at = self.frame(i), 0
            while at < len(data):
                row, at = parsed(data, at)
                yield row

    def close(self) -> None:
        self.file.close()


def numbered(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) as written rows (page_id, url, payload, n_bytes, digest, number)."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload"), F.octet_length(payload).alias("n_bytes"), F.sha1(payload).alias("digest"))
    return materialize(rows.withColumn("number", F.monotonically_increasing_id()), "pages")


def with_revisits(rows: DataFrame, revisit_from: int = 1000, few: int = 100_000) -> DataFrame:
    """Numbered rows with revisit and refers_to, and copy: the number of those that equal an earlier row in page_id and payload."""
    sized = F.col("n_bytes") >= revisit_from
    each = rows.groupBy("digest", "page_id").agg(F.count("*").alias("n"), F.min("number").alias("first"), F.first("n_bytes").alias("n_bytes"))
    each = materialize(each, "digests")
    again = broadcast_if_few(each.filter("n > 1").select("digest", F.col("page_id").alias("p"), "first"), few)
    newest = each.filter(sized).groupBy("digest").agg(F.max("page_id").alias("newest"), F.sum("n").alias("n")).filter("n > 1").select("digest", "newest")
    newest = materialize(newest, "newest")
    if newest.limit(few + 1).count() <= few:
        joined = rows.join(F.broadcast(newest.withColumnRenamed("digest", "d")), sized & (F.col("digest") == F.col("d")), "left").drop("d")
    else:
        salt = F.pmod(F.col("number"), F.lit(SALTS)).cast("int")
        side = newest.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        large = rows.filter(sized).withColumn("salt", salt).join(side, ["digest", "salt"], "left").drop("salt")
        joined = large.unionByName(rows.filter(~sized).withColumn("newest", F.lit(None).cast("long")).select(large.columns))
    repeats = again.withColumnRenamed("digest", "d")
    joined = joined.join(repeats, (F.col("digest") == F.col("d")) & F.col("page_id").eqNullSafe(F.col("p")), "left").drop("d", "p")
    known = F.col("newest").isNotNull()
    revisit = known & ~F.col("page_id").eqNullSafe(F.col("newest"))
    return joined.select("page_id", "url", "payload", "digest", revisit.alias("revisit"), F.when(revisit, F.col("newest")).alias("refers_to"), F.when(F.col("number") > F.col("first"), F.col("number")).alias("copy"))


def write_bundles(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", revisit_from: int = 1000, few: int = 100_000) -> DataFrame:
    """Writes a record for each row and returns the index (INDEX)."""
    rows = numbered(pages.select(quoted(id_col).cast("long").alias("page_id"), quoted(url_col).alias("url"), quoted(html_col).alias("html")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, bundle, count = TaskContext.get(), None, 0
        for batch in batches:
            places = []
            for row in batch.to_pylist():
                if bundle is None:
                    bundle = Bundle(f"{folder}/part-{task.partitionId():05d}-{task.taskAttemptId()}-{count:04d}.warc.zst")
                    count += 1
                name, record = warc_record(row["page_id"], row["url"], row["payload"], row["digest"], row["refers_to"], row["revisit"], row["copy"])
                places.append((name, bundle.uri, *bundle.add(record)))
                if bundle.plain >= BUNDLE_BYTES:
                    bundle.close()
                    bundle = None
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*places, strict=True), kinds, strict=True)] if places else [pa.array([], t) for t in kinds], names)
        if bundle is not None:
            bundle.close()

    kinds = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64()]
    names = ["record_id", "bundle", "frame", "offset", "length"]
    return materialize(in_batches(with_revisits(rows, revisit_from, few), run, INDEX), "warc-index")


def _rows(records: Iterator[dict]) -> Iterator[pa.RecordBatch]:
    kinds = {"record_id": pa.string(), "page_id": pa.int64(), "url": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "payload": pa.binary()}
    schema = pa.schema(list(kinds.items()))
    held, size = [], 0
    for row in records:
        held.append(row)
        size += len(row["payload"] or b"") + 300
        if size > 8_000_000:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def read_bundles(index: DataFrame) -> DataFrame:
    """All records of the bundles that the index names (RECORDS), each digest checked against its payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[dict]:
            for batch in batches:
                for uri, first, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    reader = BundleReader(uri)
                    yield from reader.records(first, end)
                    reader.close()

        yield from _rows(records())

    frames = index.groupBy("bundle").agg((F.max("frame") + 1).alias("n"))
    first = F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(RANGE))).alias("first")
    ranges = frames.select("bundle", "n", first).select("bundle", "first", F.least(F.col("first") + RANGE, F.col("n")).alias("end"))
    return in_batches(spread_out(ranges), run, RECORDS)


def fetch(index: DataFrame) -> DataFrame:
    """The records of some index rows, each read from its own frame."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[dict]:
            uri = reader = number = data = None
            for batch in batches:
                for row in batch.to_pylist():
                    if row["bundle"] != uri:
                        uri, reader, number = row["bundle"], BundleReader(row["bundle"]), None
                    if row["frame"] != number:
                        number, data = row["frame"], reader.frame(row["frame"])
                    yield parsed(memoryview(data)[row["offset"] : row["offset"] + row["length"]].tobytes())[0]

        yield from _rows(records())

    ranges = F.floor(F.col("frame") / RANGE)
    return in_batches(index.repartition("bundle", ranges).sortWithinPartitions("bundle", "frame", "offset"), run, RECORDS)


def op7_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = write_bundles(table(spark, sf_dir, "pages"), new_folder(spark, "warc"))
    return read_bundles(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def oracle() -> str:
    """The same rows in DuckDB SQL."""
    return """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, ''))::BIGINT AS n FROM pages),
m AS (SELECT *, count(*) OVER (PARTITION BY h) AS c, max(page_id) OVER (PARTITION BY h) AS newest FROM p)
SELECT page_id, n AS payload_bytes, sha1(h) AS payload_digest,
    CASE WHEN n >= 1000 AND c > 1 AND page_id IS DISTINCT FROM newest THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN n >= 1000 AND c > 1 AND page_id IS DISTINCT FROM newest THEN newest END AS refers_to FROM m"""
