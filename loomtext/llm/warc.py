"""Operator 4, WARC in seekable Zstandard bundles.

A bundle is a seekable Zstandard file: independent frames and a footer, a skippable frame with the public
seek table (compressed and decompressed size of each frame, then the number of frames, a descriptor and
the magic number). Records are grouped into frames of about ``frame_bytes`` and frames into bundles of
about ``bundle_bytes``; the index has for every record its frame and its offset inside the decompressed
frame. Reading goes through both: the footer tells where a frame lies, the index where the record begins
in it, so a record costs the footer and one frame.

A folder of bundles is a table with a row a bundle: its name, the bytes of its file and the index entries
of its records. Spark's writer commits it task by task, so a lost executor leaves nothing behind, and any
store that Spark knows will do. bundle_file() gives one bundle's bytes, bundle_index() the index.

Payloads are equal if SHA-256 and length agree. Pages are numbered in a stored table, hashed in a narrow
pass and grouped by hash after a partial aggregation; what groups learn goes back to pages by their
number, so a payload that a third of all pages share is never gathered.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import new_path, small_side, spread_lookup, stash, text_or_empty
from .tokenizer_files import text_batches

#: Fixed values of the seekable Zstandard format: skippable frame magic, footer magic.
SKIPPABLE, FOOTER = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BUNDLES = "bundle string, data binary, records array<struct<record_id:string,frame:long,frame_offset:long,n_record:long>>"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page: int | None, number: int) -> str:
    """Unique in an archive: the page's identifier may repeat or be absent, its number doesn't."""
    return f"<urn:page:{'none' if page is None else page}:{number}>"


def page_of(record: str) -> int | None:
    value = record[1:-1].split(":")[2]
    return None if value == "none" else int(value)


def warc_record(own: str, url: str | None, payload: bytes, refers_to: str | None) -> bytes:
    """A WARC/1.1 record, a revisit if it refers to another. A revisit holds the HTTP headers alone; they tell
    the full payload's length."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {own}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        "WARC-Target-URI: " + (url or "").replace("\r", "%0D").replace("\n", "%0A"),
        f"WARC-Payload-Digest: sha1:{payload_digest(payload)}",
        "Content-Type: application/http; msgtype=response",
    ]
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {refers_to}"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes | memoryview, at: int) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and the next record's place."""
    data = bytes(data) if isinstance(data, memoryview) else data
    end = data.index(b"\r\n\r\n", at)
    first, *lines = data[at:end].decode("utf-8").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"no WARC record at {at}")
    headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
    size = int(headers["Content-Length"])
    return headers, data[end + 4 : end + 4 + size], end + 4 + size + 4


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    """The footer for frames of the given (compressed, decompressed) sizes."""
    body = b"".join(struct.pack("<II", *x) for x in sizes) + struct.pack("<IBI", len(sizes), 0, FOOTER)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(data: bytes) -> list[tuple[int, int, int]]:
    """(offset, compressed, decompressed) of each frame, from a bundle's bytes; a footer that does not fit them is an error."""
    if len(data) < 17:
        raise ValueError("no seek table")
    n, descriptor, magic = struct.unpack("<IBI", data[-9:])
    width = 12 if descriptor & 0x80 else 8
    start = len(data) - 9 - n * width - 8
    if magic != FOOTER or start < 0 or struct.unpack_from("<II", data, start) != (SKIPPABLE, n * width + 9):
        raise ValueError("no seek table")
    out, place = [], 0
    for i in range(n):
        packed, raw = struct.unpack_from("<II", data, start + 8 + i * width)
        out.append((place, packed, raw))
        place += packed
    if place != start:
        raise ValueError("the seek table does not cover the frames")
    return out


def pack(records: Iterator[tuple[str, bytes]], name: str, frame_bytes: int, bundle_bytes: int, level: int = 3) -> Iterator[tuple[str, bytes, list]]:
    """(name, file, index entries) of bundle after bundle."""
    packer = zstandard.ZstdCompressor(level=level)
    number, sizes, frame, held, stored, index = 0, [], [], 0, [], []

    def close_frame():
        nonlocal frame, held
        raw = b"".join(frame)
        data = packer.compress(raw)
        sizes.append((len(data), len(raw)))
        stored.append(data)
        frame, held = [], 0

    def bundle():
        nonlocal number, sizes, stored, index
        out = f"{name}-{number:05d}", b"".join([*stored, seek_table(sizes)]), index
        number, sizes, stored, index = number + 1, [], [], []
        return out

    for key, data in records:
        index.append({"record_id": key, "frame": len(sizes), "frame_offset": held, "n_record": len(data)})
        frame.append(data)
        held += len(data)
        if held >= frame_bytes:
            close_frame()
            if sum(map(len, stored)) >= bundle_bytes:
                yield bundle()
    if frame:
        close_frame()
    if sizes:
        yield bundle()


def write_bundles(
    pages: DataFrame,
    path: str,
    min_revisit_bytes: int = 0,
    frame_bytes: int = 256 << 10,
    bundle_bytes: int = 4 << 20,
    id_col: str = "page_id",
    url_col: str = "url",
    text_col: str = "html",
) -> None:
    """Writes one record per page below ``path``.

    Of records with equal payloads of at least ``min_revisit_bytes`` the one with the largest identifier
    is the response and the others are revisits that refer to it; smaller payloads are all responses.
    A null payload counts as empty and a null address as an empty one. A null identifier is smaller than
    any other. Rows that repeat the largest identifier and its payload are all responses, and revisits
    refer to the first of them. An empty table gives no bundles. Columns other than the three are not read.
    """
    import pyarrow as pa

    spark = pages.sparkSession
    text_batches(spark, 500)
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        text_or_empty(text_col).alias("html"),
        F.monotonically_increasing_id().alias("number"),
        F.spark_partition_id().alias("part"),
    )
    rows = stash(rows.withColumns({"hash": F.unhex(F.sha2("html", 256)), "n": F.octet_length("html")}), "pages")
    marks = rows.drop("url", "html")
    holder = F.max(F.struct("page_id", (-F.col("number")).alias("less"))).alias("holder")
    groups = marks.where(F.col("n") >= min_revisit_bytes).groupBy("hash", "n").agg(holder, F.count("*").alias("size"))
    groups = groups.where("size > 1").select("hash", "n", F.col("holder.page_id").alias("holder"), (-F.col("holder.less")).alias("first"))
    later = spread_lookup(marks, groups, ["hash", "n"], "part").where("first is not null and not page_id <=> holder")
    later = small_side(later.select("number", "holder", "first"), "revisits")
    rows = rows.select("page_id", "url", "number", F.encode("html", "UTF-8").alias("payload")).join(later, "number", "left")

    def run(batches):
        from pyspark import TaskContext

        def records():
            for batch in batches:
                columns = [batch.column(c) for c in ("page_id", "url", "payload", "number", "holder", "first")]
                for i in range(batch.num_rows):
                    page, url, payload, number, holder, first = (c[i].as_py() for c in columns)
                    own = record_id(page, number)
                    yield own, warc_record(own, url, payload, None if first is None else record_id(holder, first))

        context = TaskContext.get()
        name = f"{context.stageId():06d}-{context.partitionId():06d}"
        kind = pa.list_(pa.struct([("record_id", pa.string()), ("frame", pa.int64()), ("frame_offset", pa.int64()), ("n_record", pa.int64())]))
        for bundle, data, index in pack(records(), name, frame_bytes, bundle_bytes):
            yield pa.RecordBatch.from_arrays(
                [pa.array([bundle]), pa.array([data], pa.binary()), pa.array([index], kind)], names=["bundle", "data", "records"]
            )

    # Bundles are compressed already.
    rows.mapInArrow(run, BUNDLES).write.option("compression", "none").parquet(path)


def bundle_rows(spark: SparkSession, path: str) -> DataFrame:
    """The bundles, as BUNDLES has them."""
    return spark.read.schema(BUNDLES).parquet(path)


def bundle_index(spark: SparkSession, path: str) -> DataFrame:
    """One row a record: record_id, bundle, frame, frame_offset, n_record."""
    return bundle_rows(spark, path).select("bundle", F.explode("records").alias("r")).select("r.record_id", "bundle", "r.frame", "r.frame_offset", "r.n_record")


def bundle_file(spark: SparkSession, path: str, bundle: str) -> bytes:
    """One bundle as the bytes of a seekable Zstandard file (its size is bounded by bundle_bytes and a frame)."""
    return bytes(bundle_rows(spark, path).where(F.col("bundle") == bundle).select("data").first().data)


class Bundle:
    """Random access to one bundle file; the last frame that was unpacked is held."""

    def __init__(self, data: bytes):
        self.data, self.table, self.held = memoryview(data), read_seek_table(data), (-1, b"")
        self.unpacker = zstandard.ZstdDecompressor()

    def frame(self, number: int) -> bytes:
        if self.held[0] != number:
            place, packed, raw = self.table[number]
            unpacked = self.unpacker.decompress(self.data[place : place + packed], max_output_size=max(1, raw))
            if len(unpacked) != raw:
                raise ValueError(f"frame {number} has another length than the seek table tells")
            self.held = number, unpacked
        return self.held[1]

    def record(self, frame: int, frame_offset: int) -> tuple[dict[str, str], bytes, int]:
        """Headers, block and length of the record at an offset of a frame."""
        headers, block, end = parse_record(self.frame(frame), frame_offset)
        return headers, block, end - frame_offset


def read_record(bundle: bytes, frame: int, frame_offset: int) -> tuple[dict[str, str], bytes]:
    """One record of a bundle file: the footer gives the frame's place, and only that frame is decompressed."""
    return Bundle(bundle).record(frame, frame_offset)[:2]


def read_bundles(spark: SparkSession, path: str) -> DataFrame:
    """One row a record, from the archives alone: page_id, url, payload_bytes, payload_digest, record_type,
    refers_to and payload (null for revisits). A response's length and digest are those of its block.

    Every record is fetched by its index entry through its bundle's seek table; a footer, an entry or a
    record that don't agree are an error."""
    import pyarrow as pa

    text_batches(spark, 500)
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]

    def row(bundle: Bundle, entry: dict) -> tuple:
        headers, block, size = bundle.record(entry["frame"], entry["frame_offset"])
        if headers["WARC-Record-ID"] != entry["record_id"] or size != entry["n_record"]:
            raise ValueError(f"the index does not fit the record {headers['WARC-Record-ID']}")
        kind, start = headers["WARC-Type"], block.index(b"\r\n\r\n") + 4
        if kind == "response":
            payload = block[start:]
            n, digest, refers = len(payload), payload_digest(payload), None
        else:
            told = [x for x in block[:start].decode().split("\r\n") if x.startswith("Content-Length: ")]
            n, digest, refers, payload = int(told[0][16:]), headers["WARC-Payload-Digest"][5:], page_of(headers["WARC-Refers-To"]), None
        return page_of(entry["record_id"]), headers["WARC-Target-URI"], n, digest, kind, refers, payload

    def run(batches):
        for batch in batches:
            for data, records in zip(batch.column("data"), batch.column("records"), strict=True):
                bundle, held, size = Bundle(data.as_py()), [], 0
                entries = records.as_py()
                for i, entry in enumerate(entries):
                    held.append(row(bundle, entry))
                    size += len(held[-1][-1] or b"")
                    if size > 8 << 20 or i == len(entries) - 1:
                        columns = zip(*held, strict=True)
                        yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types, strict=True)], names=names)
                        held, size = [], 0

    kind = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    return bundle_rows(spark, path).select("data", "records").mapInArrow(run, kind)


def archive_round_trip(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """Writes the pages to bundles in the shared folder and reads them back; see write_bundles for its rules."""
    path = new_path(pages.sparkSession, "warc")
    write_bundles(pages, path, min_revisit_bytes)
    return read_bundles(pages.sparkSession, path)
