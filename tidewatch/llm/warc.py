"""WARC records in seekable Zstandard bundles.

A bundle is a .warc.zst file: records are grouped into independent Zstandard frames, and a skippable frame at the end holds the seek
table (compressed size, size, checksum of each frame) and its footer, as in the public seekable format. An index maps each record's
identifier to its bundle, frame, offset in the frame and length, so one record costs one frame. Bundles are rows of a table that Spark
writes to the shared folder: (bundle_id, records, content).
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import materialize

#: Fixed values of the seekable Zstandard format and of WARC.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80
WARC_VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Where a page was captured is not known unless a column says so; the field is mandatory.
CAPTURED = "1970-01-01T00:00:00Z"
#: A payload that more than this share of all pages hold is looked up in a broadcast table, of 1000 rows at most.
HOT_SHARE = 0.001

BUNDLE_SCHEMA = "bundle_id string, records array<struct<record_id:string,page_id:bigint,frame:int,offset:bigint,length:bigint>>, content binary"
RECORD_SCHEMA = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary, record_id string"


def warc_record(record_id: str, headers: dict[str, str], block: bytes) -> bytes:
    lines = [WARC_VERSION, f"WARC-Record-ID: <{record_id}>", *(f"{k}: {v}" for k, v in headers.items()), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return headers, rest[: int(headers["Content-Length"])]


class Bundle:
    """Gathers records into frames of about frame_bytes and closes with the seek table."""

    def __init__(self, frame_bytes: int, level: int = 3) -> None:
        self.frame_bytes, self.packer = frame_bytes, zstandard.ZstdCompressor(level=level)
        self.out, self.frames, self.index, self.open = bytearray(), [], [], bytearray()

    def add(self, record_id: str, page_id: int | None, record: bytes) -> None:
        if self.open and len(self.open) + len(record) > self.frame_bytes:
            self.flush()
        self.index.append((record_id, page_id, len(self.frames), len(self.open), len(record)))
        self.open += record

    def flush(self) -> None:
        packed = self.packer.compress(bytes(self.open))
        self.frames.append((len(packed), len(self.open), xxhash.xxh64_intdigest(bytes(self.open)) & 0xFFFFFFFF))
        self.out += packed
        self.open = bytearray()

    def close(self) -> bytes:
        if self.open:
            self.flush()
        entries = b"".join(struct.pack("<III", *f) for f in self.frames)
        footer = struct.pack("<IBI", len(self.frames), CHECKSUM_FLAG, SEEKABLE_MAGIC)
        return bytes(self.out) + struct.pack("<II", SKIPPABLE_MAGIC, len(entries) + len(footer)) + entries + footer


class BundleReader:
    """Frames of a bundle by number, found through the seek table alone."""

    def __init__(self, content: bytes) -> None:
        self.content = content
        count, flags, magic = struct.unpack("<IBI", content[-9:])
        if magic != SEEKABLE_MAGIC:
            raise ValueError("no seek table")
        width = 12 if flags & CHECKSUM_FLAG else 8
        table = content[-9 - count * width : -9]
        self.places, at = [], 0
        for i in range(count):
            size, plain = struct.unpack_from("<II", table, i * width)
            check = struct.unpack_from("<I", table, i * width + 8)[0] if width == 12 else None
            self.places.append((at, size, plain, check))
            at += size

    def frame(self, i: int) -> bytes:
        at, size, plain, check = self.places[i]
        out = zstandard.ZstdDecompressor().decompress(self.content[at : at + size], max_output_size=plain)
        if len(out) != plain or check is not None and xxhash.xxh64_intdigest(out) & 0xFFFFFFFF != check:
            raise ValueError("damaged frame")
        return out


def record_uri(page_id: int | None, row: int) -> str:
    """A record's identifier: pages of one id are told apart by their row, so it is unique, and a lost task makes the same again."""
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page/{page_id}/{row}')}"


def resolved(pages: DataFrame, id_col: str, url_col: str, payload_col: str, min_bytes: int) -> DataFrame:
    """Each page with its row, the digest of its payload and, for revisits, the smallest id that holds the same payload and the first row of that id."""
    payload = F.encode(F.coalesce(F.col(payload_col).cast("string"), F.lit("")), "UTF-8")
    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload")).withColumn("row", F.monotonically_increasing_id())
    own = own.withColumns({"payload_bytes": F.length("payload").cast("long"), "payload_digest": F.sha2("payload", 256)})
    first = own.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest").agg(F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "row"))).alias("first"), F.count("page_id").alias("holders"))
    first = materialize(first.where("holders > 1"), "payloads")
    total = first.agg(F.sum("holders")).first()[0] or 0
    hot = F.col("holders") > max(1000, HOT_SHARE * total)
    often = F.broadcast(first.where(hot).select("payload_digest", F.col("first").alias("often")))  # each of a thousandth of the rows or more: 1000 at most
    marked = own.join(often, "payload_digest", "left")
    rest = first.where(~hot).select("payload_digest", "first")
    # A common payload does not meet in one task: its rows are dealt by their own number and find nothing in rest.
    key = F.when(F.col("often").isNull(), F.col("payload_digest")).otherwise(F.concat(F.lit("row "), F.col("row").cast("string")))
    joined = marked.withColumn("key", key).join(rest.withColumnRenamed("payload_digest", "key"), "key", "left").withColumn("first", F.coalesce("often", "first"))
    later = F.col("page_id") > F.col("first.page_id")
    return joined.withColumns({"refers_to": F.when(later, F.col("first.page_id")), "refers_row": F.when(later, F.col("first.row"))}).drop("first", "often", "key")


def write_bundles(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 100, frame_bytes: int = 1 << 18, bundle_bytes: int = 8 << 20, captured: str = CAPTURED) -> DataFrame:
    """The bundles of all pages (BUNDLE_SCHEMA); of equal payloads of min_bytes or more, that of the smallest id is stored, others revisit it.

    A null payload is empty. Rows of one id are a record each; the rows that hold the smallest id of a payload are all responses, and a
    null id is a response that none refers to. A record longer than frame_bytes has a frame of its own. An empty table gives no bundle;
    further columns play no part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle = None

        def closed() -> pa.RecordBatch:
            content = bundle.close()
            keys = ("record_id", "page_id", "frame", "offset", "length")
            kind = pa.list_(pa.struct([("record_id", pa.string()), ("page_id", pa.int64()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())]))
            return pa.RecordBatch.from_arrays([pa.array([hashlib.sha256(content).hexdigest()[:32]]), pa.array([[dict(zip(keys, r, strict=True)) for r in bundle.index]], kind), pa.array([content], pa.binary())], ["bundle_id", "records", "content"])

        for batch in batches:
            for row in batch.to_pylist():
                bundle = bundle or Bundle(frame_bytes)
                page, refers, digest = row["page_id"], row["refers_to"], row["payload_digest"]
                record_id = record_uri(page, row["row"])
                headers = {"WARC-Date": captured, "Content-Type": "text/html; charset=utf-8", "X-Page-Id": "" if page is None else str(page), "WARC-Type": "revisit" if refers is not None else "response", "WARC-Target-URI": (row["url"] or "").replace("\r", "%0D").replace("\n", "%0A"), "WARC-Payload-Digest": f"sha256:{digest}", "X-Payload-Length": str(row["payload_bytes"])}
                if row["url"] is None:
                    headers.pop("WARC-Target-URI")
                if refers is not None:
                    headers |= {"WARC-Refers-To": f"<{record_uri(refers, row['refers_row'])}>", "X-Refers-To-Page": str(refers), "WARC-Profile": REVISIT_PROFILE}
                bundle.add(record_id, page, warc_record(record_id, headers, b"" if refers is not None else row["payload"]))
                if len(bundle.out) >= bundle_bytes:
                    yield closed()
                    bundle = None
        if bundle:
            yield closed()

    return resolved(pages, id_col, url_col, payload_col, min_bytes).select("page_id", "url", "payload", "payload_bytes", "payload_digest", "refers_to", "row", "refers_row").mapInArrow(run, BUNDLE_SCHEMA)


def _row(raw: bytes) -> tuple:
    headers, block = parse_record(raw)
    number = lambda v: int(v) if v else None
    kind = headers["WARC-Type"]
    digest = headers["WARC-Payload-Digest"].partition(":")[2]
    if kind == "response" and hashlib.sha256(block).hexdigest() != digest:
        raise ValueError(f"payload of {headers['WARC-Record-ID']} is damaged")
    size = len(block) if kind == "response" else int(headers["X-Payload-Length"])
    return number(headers["X-Page-Id"]), headers.get("WARC-Target-URI"), size, digest, kind, number(headers.get("X-Refers-To-Page")), block, headers["WARC-Record-ID"].strip("<>")


def read_bundles(bundles: DataFrame) -> DataFrame:
    """Every record of the bundles (RECORD_SCHEMA), frame by frame, checked against the seek table and the payload digests."""
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string()]
    names = [f.split()[0] for f in RECORD_SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                reader = BundleReader(batch.column(1)[i].as_py())
                by_frame: dict[int, list] = {}
                for r in batch.column(0)[i].as_py():
                    by_frame.setdefault(r["frame"], []).append(r)
                for number, records in by_frame.items():
                    frame = reader.frame(number)
                    rows = [_row(frame[r["offset"] : r["offset"] + r["length"]]) for r in records]
                    yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return bundles.select("records", "content").mapInArrow(run, RECORD_SCHEMA)


def lookup(bundles: DataFrame, record_ids: list[str] | None = None, page_ids: list[int] | None = None) -> DataFrame:
    """The records of these identifiers or pages: only their frames are unpacked."""
    wanted = bundles.select(F.filter("records", lambda r: F.coalesce(r["record_id"].isin(record_ids or []) | r["page_id"].isin(page_ids or []), F.lit(False))).alias("records"), "content").where(F.size("records") > 0)
    return read_bundles(wanted)
