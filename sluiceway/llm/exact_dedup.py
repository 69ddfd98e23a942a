"""Operator 4: exact deduplication by composable polynomial fingerprints.

A text is reduced to its UTF-8 bytes without the characters of [\\x20\\x09-\\x0D] and cut into chunks.
Each chunk is hashed by itself as a polynomial in three prime fields; a chunk followed by m bytes is
shifted by base**m, and the shifted hashes add up to the fingerprint of the whole, in any order, on
any executor. Texts of equal fingerprint and length are then compared chunk by chunk.

Cases: null and empty texts are equal and form one group; null ids come last among equals; rows that
repeat an id take part one by one, exactly one row of a group is kept; other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluiceway.llm.common import WHITE, blobs, keep_rows, land, numbered, table, utf8
from sluiceway.operators.sequence import lookup

CHUNK = 1 << 16
PRIMES = (2147483647, 2147483629, 2147483587)
BASES = (1089436357, 1754298617, 620912663)


def powers(primes: tuple[int, ...], chunk: int) -> list[np.ndarray]:
    """For each field, base**(chunk - 1), ..., base, 1."""
    out = []
    for prime, base in zip(primes, BASES):
        row, x = np.empty(chunk, np.uint64), 1
        for i in range(chunk - 1, -1, -1):
            row[i] = x
            x = x * base % prime
        out.append(row)
    return out


def chunk_hash(data: bytes, prime: int, falling: np.ndarray) -> int:
    """The polynomial of one chunk; a byte counts one more than its value, so zeros count too."""
    cells = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)
    return int(np.dot(cells, falling[len(falling) - len(cells):]) % np.uint64(prime))


def combine(left: int, right: int, right_length: int, field: int, primes=PRIMES) -> int:
    """The hash of two texts one after the other."""
    return (left * pow(BASES[field], right_length, primes[field]) + right) % primes[field]


def _chunks(data: bytes, chunk: int) -> list[bytes]:
    return [data[i:i + chunk] for i in range(0, len(data), chunk)] or [b""]


def fingerprints(
    docs: DataFrame, chunk: int = CHUNK, primes: tuple[int, ...] = PRIMES, row: str | None = None
) -> DataFrame:
    """One row per document: row, doc_id, n_points, sha, n_bytes, f0, f1, f2. Column ``row`` numbers the rows if given."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        falling = powers(primes, chunk)
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for i, raw in enumerate(blobs(batch["data"])):
                data = raw.translate(None, WHITE)
                sha, left = hashlib.sha256(data).hexdigest(), len(data)
                for piece in _chunks(data, chunk):
                    left -= len(piece)
                    out[0].append(i)
                    out[1].append(sha)
                    out[2].append(len(piece))
                    for f, (prime, base, row) in enumerate(zip(primes, BASES, falling)):
                        h = chunk_hash(piece, prime, row)
                        out[3 + f].append(h * pow(base, left, prime) % prime if left else h)
            at = pa.array(out[0], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch[c].take(at) for c in ("row", "doc_id", "n_points")]
                + [pa.array(out[1], pa.string())] + [pa.array(x, pa.int64()) for x in out[2:]],
                ["row", "doc_id", "n_points", "sha", "n_bytes", "f0", "f1", "f2"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    cells = docs.select(
        (F.col(row) if row else F.monotonically_increasing_id()).alias("row"), "doc_id",
        F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_points"), utf8("text").alias("data"),
    ).mapInArrow(
        hashed,
        f"row long, doc_id {kind}, n_points long, sha string, n_bytes long, f0 long, f1 long, f2 long",
    )
    return cells.groupBy("row", "doc_id", "n_points", "sha").agg(
        F.sum("n_bytes").alias("n_bytes"),
        *[(F.sum(f"f{i}") % F.lit(p)).alias(f"f{i}") for i, p in enumerate(primes)],
    )


PRINT = ["n_bytes", "f0", "f1", "f2"]


def _torn(docs: DataFrame, repeated: DataFrame, chunk: int, primes: tuple[int, ...]) -> DataFrame:
    """The fingerprints among ``repeated`` whose texts are not all the same.

    All chunks of one place stream through a running least and greatest value, first in the task
    that read them, then once for each place; they are all equal if and only if the two are.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        falling = powers(primes, chunk)
        names = [*PRINT, "place", "chunk"]
        for batch in batches:
            rows: list[tuple] = []
            for raw in blobs(batch["data"]):
                data = raw.translate(None, WHITE)
                pieces, sums = _chunks(data, chunk), [0, 0, 0]
                for piece in pieces:
                    for f, (prime, row) in enumerate(zip(primes, falling)):
                        sums[f] = combine(sums[f], chunk_hash(piece, prime, row), len(piece), f, primes)
                rows += [(len(data), *sums, i, piece) for i, piece in enumerate(pieces)]
            columns = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in columns[:5]] + [pa.array(columns[5], pa.binary())], names
            )

    pieces = docs.select(utf8("text").alias("data")).mapInArrow(
        cut, "n_bytes long, f0 long, f1 long, f2 long, place long, chunk binary"
    )
    places = lookup(pieces, repeated.select(*PRINT), PRINT, "left_semi").groupBy(*PRINT, "place").agg(
        (F.min("chunk") == F.max("chunk")).alias("same")
    )
    return places.where("not same").select(*PRINT).distinct()


def exact_dedup(docs: DataFrame, chunk: int = CHUNK, primes: tuple[int, ...] = PRIMES) -> DataFrame:
    """Per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    return decided(docs, chunk, primes).drop("row")


def decided(
    docs: DataFrame, chunk: int = CHUNK, primes: tuple[int, ...] = PRIMES, row: str | None = None
) -> DataFrame:
    """Per row of ``docs``: its number, doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the one with the most code points stays, then the smallest id. Fingerprints that
    the comparison finds torn are split by SHA-256.
    """
    prints = land(fingerprints(docs, chunk, primes, row), "fingerprints")
    key = [*PRINT, "part"]
    prints = prints.withColumn("part", F.lit(""))
    best = F.min(F.struct(
        (-F.col("n_points")).alias("shorter"), F.col("doc_id").isNull().alias("nameless"),
        F.col("doc_id").alias("id"), F.col("row").alias("at"),
    ))

    def grouped(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*key).agg(F.count("*").alias("group_size"), best.alias("best"))

    groups = land(grouped(prints), "groups")
    torn = land(_torn(docs, groups.where("group_size > 1"), chunk, primes), "torn")
    if not torn.isEmpty():
        prints = lookup(prints, torn.withColumn("is_torn", F.lit(True)), PRINT, "left").withColumn(
            "part", F.when(F.col("is_torn"), F.col("sha")).otherwise(F.lit(""))
        ).drop("is_torn")
        groups = grouped(prints)
    return prints.join(groups, key).select(
        "row", "doc_id", F.col("best.id").alias("keep_id"), "group_size",
        (F.col("row") == F.col("best.at")).alias("kept"), F.col("sha").alias("text_sha256"),
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that exact deduplication drops."""
    docs, row = numbered(docs)
    return keep_rows(docs, row, decided(docs, row=row).where("kept"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


QUERIES = {"op4_exact_dedup": op4_exact_dedup}
ORACLES = {
    "op4_exact_dedup": r"""
WITH texts AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
), ranked AS (
  SELECT doc_id, text_sha256, count(*) OVER (PARTITION BY text_sha256) AS group_size,
         first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id
  FROM texts
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM ranked
""",
}
