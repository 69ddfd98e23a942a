"""Operator 2: WARC records in seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each of whole records, closed by a skippable frame
that holds the seek table (sizes of every frame). An index maps each record to its bundle, its frame
and its place in the unpacked frame, so a reader opens one frame for one record.

Cases: null html is an empty payload; null urls give an empty target; a record larger than a frame
has a frame of its own; rows that repeat an id have a record each, and of equal payloads all rows that
carry the largest id are responses (a record cannot revisit itself); a null id never is the largest,
and among equal payloads of null ids only, all are responses; other columns are ignored; an empty
table writes no bundle.

Bundles are written by the tasks straight into the shared folder, through the file system of its
address. A file's name holds a random part for each attempt and only the index of the attempt that
succeeded names it, so a repeated task leaves at worst a file that nothing refers to.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluiceway.llm.common import blobs, land, table, utf8
from sluiceway.operators.sequence import lookup
from sluiceway.session import scratch

FRAME_BYTES = 1 << 20
BUNDLE_BYTES = 1 << 28
REVISIT_BYTES = 1000
LEVEL = 3
DATE = "2024-01-01T00:00:00Z"
# fixed values of the formats: skippable frame, seek table footer, revisit profile
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page_id: object) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def warc_record(page_id, url, payload: bytes, sha1: str, refers_to=None, revisit: bool = False) -> bytes:
    """One WARC/1.1 record with an HTTP head; a revisit has no body."""
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    block = http if revisit else http + payload
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Target-URI: {uri}", f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(sha1)).decode()}",
    ]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def read_record(record: bytes) -> dict:
    """The fields of a record; payload length and digest are those of the full payload."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[:int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(re.search(rb"Content-Length: (\d+)", http)[1])
    sha1 = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != length or hashlib.sha1(payload).hexdigest() != sha1):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    refers = fields.get("WARC-Refers-To")
    return {
        "id": fields["WARC-Record-ID"], "type": kind, "bytes": length, "sha1": sha1, "payload": payload,
        "refers_to": refers and refers.removeprefix("<urn:page:").removesuffix(">"),
    }


class BundleWriter:
    """Appends records to bundles below ``root``; says where each one went."""

    def __init__(self, root: str, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES):
        self.fs, self.root = pafs.FileSystem.from_uri(root)
        self.fs.create_dir(self.root, recursive=True)
        self.frame_bytes, self.bundle_bytes = frame_bytes, bundle_bytes
        self.packer, self.file = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True), None

    def add(self, record: bytes) -> tuple[str, int, int, int]:
        """(bundle, frame, offset in the unpacked frame, length)"""
        if self.file is None:
            self.name = f"{uuid.uuid4().hex}.warc.zst"
            self.file = self.fs.open_output_stream(f"{self.root}/{self.name}", compression=None)
            self.sizes, self.held, self.size, self.written = [], [], 0, 0
        at = (self.name, len(self.sizes), self.size, len(record))
        self.held.append(record)
        self.size += len(record)
        if self.size >= self.frame_bytes:
            self._frame()
            if self.written >= self.bundle_bytes:
                self.close()
        return at

    def _frame(self) -> None:
        packed = self.packer.compress(b"".join(self.held))
        self.file.write(packed)
        self.sizes.append((len(packed), self.size))
        self.written += len(packed)
        self.held, self.size = [], 0

    def close(self) -> None:
        if self.file is None:
            return
        if self.held:
            self._frame()
        table = b"".join(struct.pack("<II", *s) for s in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        self.file.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.file.close()
        self.file = None


class BundleReader:
    """Reads records by frame; keeps one bundle open and one frame unpacked."""

    def __init__(self, root: str):
        self.fs, self.root = pafs.FileSystem.from_uri(root)
        self.bundle = self.frame = self.file = None

    def _open(self, bundle: str) -> None:
        if self.file is not None:
            self.file.close()
        self.file = self.fs.open_input_file(f"{self.root}/{bundle}")
        end = self.file.size()
        self.file.seek(end - 9)
        count, flags, magic = struct.unpack("<IBI", self.file.read(9))
        if magic != SEEKABLE:
            raise ValueError(f"{bundle} has no seek table")
        width = 12 if flags & 128 else 8
        self.file.seek(end - 9 - width * count)
        cells = self.file.read(width * count)
        self.starts, self.sizes, at = [], [], 0
        for i in range(count):
            packed, plain = struct.unpack_from("<II", cells, i * width)
            self.starts.append((at, packed))
            self.sizes.append(plain)
            at += packed
        self.bundle, self.frame = bundle, None

    def get(self, bundle: str, frame: int, offset: int, length: int) -> bytes:
        if bundle != self.bundle:
            self._open(bundle)
        if frame != self.frame:
            at, packed = self.starts[frame]
            self.file.seek(at)
            self.plain = zstandard.ZstdDecompressor().decompress(self.file.read(packed), max_output_size=self.sizes[frame])
            self.frame = frame
        return self.plain[offset:offset + length]


def write_bundles(
    pages: DataFrame, root: str, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES
) -> DataFrame:
    """Archive ``pages`` (page_id, url, html) below ``root``; returns the landed index
    (page_id, record_id, bundle, frame, offset, length)."""
    kind = dict(pages.dtypes)["page_id"]
    cells = pages.select("page_id", "url", utf8("html").alias("payload")).withColumn(
        "sha1", F.sha1("payload")
    ).withColumn("size", F.octet_length("payload"))
    shared = (
        cells.where(F.col("size") >= REVISIT_BYTES).groupBy("sha1", "size")
        .agg(F.max("page_id").alias("last_id"), F.count("*").alias("n"))
        .where("n > 1 and last_id is not null").drop("n")
    )
    shared = land(shared, "equal-payloads")
    cells = lookup(cells, shared, ["sha1", "size"], "left").withColumn(
        "revisit", F.col("last_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last_id"))
    )

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = BundleWriter(root, frame_bytes, bundle_bytes)
        for batch in batches:
            rows = zip(*(batch[c].to_pylist() for c in ("page_id", "url", "sha1", "last_id", "revisit")), blobs(batch["payload"]))
            places = [
                writer.add(warc_record(page_id, url, payload, sha1, last_id, revisit))
                for page_id, url, sha1, last_id, revisit, payload in rows
            ]
            names = [record_id(p) for p in batch["page_id"].to_pylist()]
            columns = list(zip(*places)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [batch["page_id"], pa.array(names, pa.string()), pa.array(columns[0], pa.string())]
                + [pa.array(c, pa.int64()) for c in columns[1:]],
                ["page_id", "record_id", "bundle", "frame", "offset", "length"],
            )
        writer.close()

    index = cells.select("page_id", "url", "payload", "sha1", "last_id", "revisit").mapInArrow(
        archive, f"page_id {kind}, record_id string, bundle string, frame long, offset long, length long"
    )
    return land(index, "warc-index")


def read_bundles(index: DataFrame, root: str) -> DataFrame:
    """The records that ``index`` names, read from their frames."""
    kind = dict(index.dtypes)["page_id"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = BundleReader(root)
        for batch in batches:
            places = zip(*(batch[c].to_pylist() for c in ("bundle", "frame", "offset", "length")))
            found = [read_record(reader.get(*p)) for p in places]
            yield pa.RecordBatch.from_arrays(
                [
                    batch["page_id"], pa.array([r["id"] for r in found], pa.string()),
                    pa.array([r["bytes"] for r in found], pa.int64()),
                    pa.array([r["sha1"] for r in found], pa.string()),
                    pa.array([r["type"] for r in found], pa.string()),
                    pa.array([r["refers_to"] for r in found], pa.string()),
                    pa.array([r["payload"] for r in found], pa.binary()),
                ],
                ["page_id", "record_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"],
            )

    return index.select("page_id", "bundle", "frame", "offset", "length").mapInArrow(
        read,
        f"page_id {kind}, record_id string, payload_bytes long, payload_digest string, "
        "record_type string, refers_to string, payload binary",
    )


def op2_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch(spark, "warc")
    pages = table(spark, sf_dir, "pages")
    index = write_bundles(pages, root)
    back = read_bundles(index, root)
    return back.select(
        "page_id", "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast(dict(pages.dtypes)["page_id"]).alias("refers_to"),
    )


QUERIES = {"op2_warc_bundles": op2_warc_bundles}
ORACLES = {
    "op2_warc_bundles": """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
  FROM pages
), r AS (
  SELECT *, CASE WHEN payload_bytes >= 1000
                 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) ELSE page_id END AS last_id
  FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = last_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = last_id THEN NULL ELSE last_id END AS refers_to
FROM r
""",
}
