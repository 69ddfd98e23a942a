"""Operator 6: SimHash near-deduplication by bit-sliced comparison.

Fingerprints that differ in at most r bits agree in full in k - r of k bit segments. Rows are dealt
to one bucket for each such choice of segments; the fingerprints of a bucket are stored as vertical
bit planes, and the distances of a fingerprint to all lanes grow together in carry-save counters, one
plane at a time, until every lane of the block is beyond the radius.

Cases: null and empty texts and texts of white space have fingerprint zero and link with each other
like any others; a text with fewer words than a shingle is one shingle; equal fingerprints are one
node; rows that repeat an id are all returned; other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluiceway.llm.common import block_pairs, blobs, groups_of, keep_rows, land, numbered, table, utf8
from sluiceway.llm.components import components

SHINGLE = 3
RADIUS = 3
SEGMENTS = 5
BLOCK = 2048
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(data: bytes, shingle: int = SHINGLE) -> int:
    """The SimHash of one text in UTF-8."""
    words = data.translate(LOWER).split()
    if not words:
        return 0
    if len(words) <= shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(g, 42) for g in grams), np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = hashes[at:at + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, row: str | None = None) -> DataFrame:
    """(doc_id, print): the fingerprint as a signed long; with the number of the row in column ``row``, also that as row."""
    kept = ["doc_id", *([F.col(row).alias("row")] if row else [])]
    schema = docs.select(*kept).schema.add("print", "long")
    names = schema.names[:-1]

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.fromiter((fingerprint(b, shingle) for b in blobs(batch["data"])), np.uint64)
            yield pa.RecordBatch.from_arrays(
                [*(batch[c] for c in names), pa.array(prints.view(np.int64), pa.int64())], [*names, "print"]
            )

    return docs.select(*kept, utf8("text").alias("data")).mapInArrow(hashed, schema)


def bit_planes(prints: np.ndarray) -> np.ndarray:
    """64 planes; lane i of plane k is bit k of the i-th fingerprint. Lanes are filled up with the last."""
    lanes = -(-len(prints) // 64) * 64
    filled = np.concatenate([prints, np.repeat(prints[-1:], lanes - len(prints))]).astype("<u8")
    bits = np.unpackbits(filled.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")


def within(queries: np.ndarray, prints: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """(query, lane) of each two fingerprints that differ in at most ``radius`` bits.

    Counters are bit-sliced: bit j of all lane counts is one word row, a plane of differences is
    added by half adders, and a carry out of the top marks the lane as over for good. Counts start
    so that the carry comes at radius + 1. Queries whose lanes are all over are abandoned.
    """
    planes, depth = bit_planes(prints), max(1, int(radius).bit_length())
    alive, full = np.arange(len(queries)), np.uint64(2**64 - 1)
    start = (1 << depth) - (radius + 1)
    counts = [np.full((len(queries), planes.shape[1]), full if start >> j & 1 else 0, np.uint64) for j in range(depth)]
    over = np.zeros((len(queries), planes.shape[1]), np.uint64)
    for k in range(64):
        bit = (queries[alive] >> np.uint64(k)) & np.uint64(1)
        carry = planes[k][None, :] ^ (np.uint64(0) - bit)[:, None]
        for j in range(depth):
            counts[j], carry = counts[j] ^ carry, counts[j] & carry
        over |= carry
        if k % 4 == 3:
            left = (over != full).any(axis=1)
            if not left.all():
                alive, over, counts = alive[left], over[left], [c[left] for c in counts]
                if not len(alive):
                    break
    if not len(alive):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    near = np.unpackbits(np.ascontiguousarray(~over).astype("<u8").view(np.uint8), axis=1, bitorder="little")[:, :len(prints)]
    query, lane = np.nonzero(near)
    return alive[query], lane


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least node reachable from each of n nodes over the links (a, b)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def segment_keys(segments: int, radius: int) -> list[int]:
    """The bit mask of each choice of segments - radius out of all segments."""
    cuts = [round(i * 64 / segments) for i in range(segments + 1)]
    masks = [(1 << cuts[i + 1]) - (1 << cuts[i]) for i in range(segments)]
    return [sum(c) for c in combinations(masks, segments - radius)]


def links(prints: DataFrame, radius: int = RADIUS, segments: int = SEGMENTS, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) that join all distinct fingerprints of ``prints`` within the radius.

    Every block gives a spanning forest of what it found, never all its pairs. Buckets above ``block``
    fingerprints are dealt to pairs of blocks.
    """
    signed = [m - (1 << 64) if m >> 63 else m for m in segment_keys(segments, radius)]
    bucketed = prints.select(
        "print", F.posexplode(F.array(*[F.col("print").bitwiseAND(F.lit(m)) for m in signed])).alias("band", "key")
    )
    dealt = block_pairs(bucketed, ["band", "key"], "print", block)
    keys = ["band", "key", "_a", "_b"]

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def edges(nodes: np.ndarray) -> pa.RecordBatch:
            # links across the groups of one block are true links too
            nodes = np.unique(nodes)
            root = np.arange(len(nodes))
            pairs = [
                (q + at, lane) for at in range(0, len(nodes), block)
                for q, lane in [within(nodes[at:at + block], nodes, radius)]
            ]
            if pairs:
                root = forest(np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs]), len(nodes))
            child = np.flatnonzero(root != np.arange(len(nodes)))
            signed = nodes.view(np.int64)
            return pa.RecordBatch.from_arrays(
                [pa.array(signed[child], pa.int64()), pa.array(signed[root[child]], pa.int64())], ["a", "b"]
            )

        for rows, bounds in groups_of(batches, keys):
            values = rows["print"].to_numpy().view(np.uint64)
            held: list[np.ndarray] = []
            size = 0
            spans = np.flatnonzero(np.diff(bounds) > 1)
            for s in spans:
                lo, hi = bounds[s], bounds[s + 1]
                if held and size + hi - lo > block:
                    yield edges(np.concatenate(held))
                    held, size = [], 0
                held.append(values[lo:hi])
                size += hi - lo
            if held:
                yield edges(np.concatenate(held))

    return (
        dealt.select(*keys, "print").repartition(*keys).sortWithinPartitions(*keys)
        .mapInArrow(compared, "a long, b long")
    )


def _homes(nodes: DataFrame, radius: int = RADIUS, segments: int = SEGMENTS, block: int = BLOCK) -> DataFrame:
    """``nodes``, one for each fingerprint, with their component."""
    linked = components(links(nodes.select("print"), radius, segments, block))
    return nodes.join(linked.withColumnRenamed("node", "print"), "print", "left").withColumn(
        "component", F.coalesce("component", "print")
    )


def simhash_dedup(
    docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, segments: int = SEGMENTS, block: int = BLOCK
) -> DataFrame:
    """Per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id (least id reachable)."""
    prints = land(fingerprints(docs, shingle), "simhash")
    nodes = land(prints.groupBy("print").agg(F.min("doc_id").alias("least_id")), "simhash-nodes")
    home = _homes(nodes, radius, segments, block)
    named = home.join(home.groupBy("component").agg(F.min("least_id").alias("component_id")), "component")
    return prints.join(named.select("print", "component_id"), "print").select(
        "doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id"
    )


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: that with its least id, null ids last, then the first."""
    docs, row = numbered(docs)
    first = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "row")
    prints = fingerprints(docs, row=row).groupBy("print").agg(F.min(first).alias("first"))
    homes = _homes(land(prints, "simhash-nodes"))
    return keep_rows(docs, row, homes.groupBy("component").agg(F.min("first").alias("first")).select("first.row"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup(table(spark, sf_dir, "documents"))


QUERIES = {"op6_simhash": op6_simhash}
ORACLES: dict[str, str] = {}
