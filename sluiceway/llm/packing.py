"""Operator 1: packing along a space-filling curve.

Documents are tokenised, their hashed token vectors are projected to a few dimensions, and the
documents are range-sorted by the Hilbert key of their projections. Along the curve the ids of all
documents form one stream that is cut every ``length`` ids, so neighbours share sequences and only
the last sequence has padding.

Cases: null and empty texts have only the closing id; a document longer than a sequence has several
pieces; equal documents have equal keys and lie side by side, in the order of their ids (null first);
rows that repeat an id are packed one by one; other columns are ignored; an empty table gives an
empty result.

Words are looked up in a bounded cache: the pre-tokeniser never joins across ASCII white space, so a
text's ids are its words' ids. Ids move as 16-bit cells where the vocabulary allows it.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sluiceway.llm.common import blobs, land, table, utf8

LENGTH = 4096
CLOSING = 2
CACHED_WORDS = 300_000
HASHED = 1024
DIMENSIONS = 4
BITS = 12


#: Words of printable ASCII need no normalising but lower case; UNIT is the word model's rule for them.
PLAIN = re.compile(rb"[!-~]+")
UNIT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")


def _splits_like(tokenizer) -> bool:
    """Whether the tokeniser lowers and cuts ASCII words as UNIT does, judged by its own pre-tokeniser."""
    probe = "It'S a-B2b3's,.x'llY'd!!_Z'TM'm"
    if tokenizer.normalizer is None or tokenizer.pre_tokenizer is None:
        return False
    cut = tokenizer.pre_tokenizer.pre_tokenize_str(tokenizer.normalizer.normalize_str(probe))
    return [u for u, _ in cut] == [u for w in probe.split() for u in UNIT.findall(w.lower())]


class WordEncoder:
    """Token ids of whole texts by way of their words; unseen words go to the tokeniser in bulk.

    Words are kept in two generations of at most ``cached_words``: when the newer is full it becomes
    the older one, and words that are met again move to the newer.
    """

    def __init__(self, tokenizer_path: str, cached_words: int = CACHED_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.cells = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.cached_words, self.known, self.older = cached_words, {}, {}
        # a unit of the pre-tokeniser is one call of the model; only of the word model, whose rule this is
        self.plain = PLAIN if _splits_like(self.tokenizer) else None
        self.units: dict[str, bytes] = {}

    def _bytes(self, ids: list[int]) -> bytes:
        return array("H" if self.cells.itemsize == 2 else "I", ids).tobytes()

    def _of_units(self, word: str) -> bytes:
        out = b""
        for unit in UNIT.findall(word.lower()):
            ids = self.units.get(unit)
            if ids is None:
                ids = self.units[unit] = self._bytes([t.id for t in self.tokenizer.model.tokenize(unit)])
            out += ids
        return out

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text as packed cells."""
        if len(self.known) > self.cached_words:
            self.known, self.older, self.units = {}, self.known, {}
        words = [text.split() for text in texts]
        new = []
        for word in set().union(*words).difference(self.known):
            ids = self.older.get(word)
            if ids is not None:
                self.known[word] = ids
            elif self.plain and self.plain.fullmatch(word) and b"<|" not in word:
                self.known[word] = self._of_units(word.decode())
            else:
                new.append(word)
        for at in range(0, len(new), 1 << 14):
            part = new[at:at + (1 << 14)]
            coded = self.tokenizer.encode_batch_fast([w.decode() for w in part], add_special_tokens=False)
            self.known.update((w, self._bytes(c.ids)) for w, c in zip(part, coded))
        return [b"".join(map(self.known.__getitem__, own)) for own in words]


@lru_cache(maxsize=2)
def word_encoder(tokenizer_path: str) -> WordEncoder:
    """One encoder for all tasks of a worker process."""
    return WordEncoder(tokenizer_path)


def hashed_vectors(texts: list[np.ndarray]) -> np.ndarray:
    """Signed feature hashing of token counts, damped by a logarithm, at unit length."""
    out = np.zeros((len(texts), HASHED), np.float32)
    for i, ids in enumerate(texts):
        mixed = ids.astype(np.uint32) * np.uint32(2654435761)
        cell, sign = mixed >> np.uint32(22), (mixed >> np.uint32(21)) & np.uint32(1)
        counts = np.bincount(cell + HASHED * sign, minlength=2 * HASHED).astype(np.float32)
        out[i] = np.log1p(counts[:HASHED]) - np.log1p(counts[HASHED:])
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def projection() -> np.ndarray:
    return np.random.default_rng(20240229).standard_normal((HASHED, DIMENSIONS)).astype(np.float32)


def hilbert_key(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The place on the Hilbert curve of integer points, one a row, each cell below 2**bits."""
    x = points.T.astype(np.int64).copy()
    top = 1 << (bits - 1)
    q = top
    while q > 1:
        for i in range(len(x)):
            turned = (x[i] & q) > 0
            swap = np.where(turned, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] = np.where(turned, x[0] ^ (q - 1), x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    flips, q = np.zeros_like(x[0]), top
    while q > 1:
        flips ^= np.where((x[-1] & q) > 0, q - 1, 0)
        q >>= 1
    x ^= flips
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for row in x:
            key = (key << 1) | ((row >> bit) & 1)
    return key


def tokenised(docs: DataFrame, tokenizer_path: str, closing: int = CLOSING) -> DataFrame:
    """row, doc_id, n, ids (packed cells), width and the projections p0, p1, ..."""
    names = [f"p{i}" for i in range(DIMENSIONS)]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, basis = word_encoder(tokenizer_path), projection()
        end = np.array([closing], encoder.cells).tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                packed = [ids + end for ids in encoder.encode(blobs(part["data"]))]
                cells = [np.frombuffer(p, encoder.cells) for p in packed]
                spots = hashed_vectors(cells) @ basis
                yield pa.RecordBatch.from_arrays(
                    [
                        part["row"], part["doc_id"], pa.array([len(c) for c in cells], pa.int64()),
                        pa.array(packed, pa.binary()),
                        pa.array(np.full(len(cells), encoder.cells.itemsize, np.int32), pa.int32()),
                        *(pa.array(spots[:, i], pa.float32()) for i in range(DIMENSIONS)),
                    ],
                    ["row", "doc_id", "n", "ids", "width", *names],
                )

    return docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", utf8("text").alias("data")).mapInArrow(
        encode,
        f"row long, doc_id {dict(docs.dtypes)['doc_id']}, n long, ids binary, width int, "
        + ", ".join(f"{p} float" for p in names),
    )


def _keyed(tokens: DataFrame) -> DataFrame:
    """row, doc_id, n and the Hilbert key; projections are scaled by the corpus's mean and deviation."""
    names = [f"p{i}" for i in range(DIMENSIONS)]
    stats = tokens.agg(*[f(p) for p in names for f in (F.avg, F.stddev_pop)]).first()
    mean = np.array([x or 0.0 for x in stats[0::2]])
    scale = np.array([x or 1.0 for x in stats[1::2]])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spots = np.stack([batch[p].to_numpy() for p in names], axis=1).astype(np.float64)
            even = 1 / (1 + np.exp(-1.702 * np.clip((spots - mean) / scale, -30, 30)))
            points = np.minimum((even * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)
            yield pa.RecordBatch.from_arrays(
                [batch["row"], batch["doc_id"], batch["n"], pa.array(hilbert_key(points), pa.int64())],
                ["row", "doc_id", "n", "key"],
            )

    return tokens.select("row", "doc_id", "n", *names).mapInArrow(
        place, f"row long, doc_id {dict(tokens.dtypes)['doc_id']}, n long, key long"
    )


def _starts(tokens: DataFrame) -> DataFrame:
    """Each row's place in the stream of all ids: running sums within the ranges of the curve, then
    the sum of the ranges before (a table of one row for each range)."""

    def running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            n = batch["n"].to_numpy()
            ends = total + np.cumsum(n)
            yield pa.RecordBatch.from_arrays(
                [batch["row"], batch["part"], batch["n"], pa.array(ends - n, pa.int64())], ["row", "part", "n", "at"]
            )
            if len(ends):
                total = int(ends[-1])

    order = ["key", "doc_id", "row"]
    ranged = _keyed(tokens).repartitionByRange(*order).sortWithinPartitions(*order)
    placed = land(
        ranged.select("row", F.spark_partition_id().alias("part"), "n")
        .mapInArrow(running, "row long, part int, n long, at long"),
        "curve",
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = placed.groupBy("part").agg(F.sum("n").alias("sum")).select(
        "part", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("base")
    )
    # one row for each range partition, so its size is bounded by the number of partitions
    return placed.join(F.broadcast(ranges), "part").select("row", (F.col("base") + F.col("at")).alias("at"))


def pack(docs: DataFrame, tokenizer_path: str, length: int = LENGTH, closing: int = CLOSING) -> DataFrame:
    """Pieces of documents: doc_id, start, length, doc_tokens, sequence_id, offset and ids (unsigned
    32-bit, little-endian)."""
    tokens = tokenised(docs, tokenizer_path, closing)
    tokens = land(tokens, "tokens")
    kind = dict(docs.dtypes)["doc_id"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, at = batch["n"].to_numpy(), batch["at"].to_numpy()
            first, last = at // length, (at + n - 1) // length
            pieces = last - first + 1
            owner = np.repeat(np.arange(len(n)), pieces)
            nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            sequence = first[owner] + nth
            lo = np.maximum(sequence * length, at[owner])
            hi = np.minimum((sequence + 1) * length, at[owner] + n[owner])
            width = batch["width"].to_numpy()
            cells = [
                np.frombuffer(ids.as_buffer(), "<u2" if width[i] == 2 else "<u4") for i, ids in enumerate(batch["ids"])
            ]
            ids = [cells[o][a:b].astype("<u4").tobytes() for o, a, b in zip(owner, lo - at[owner], hi - at[owner])]
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"].take(pa.array(owner)), pa.array(lo - at[owner], pa.int64()),
                    pa.array(hi - lo, pa.int64()), pa.array(n[owner], pa.int64()),
                    pa.array(sequence, pa.int64()), pa.array(lo - sequence * length, pa.int64()),
                    pa.array(ids, pa.binary()),
                ],
                ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
            )

    return (
        tokens.select("row", "doc_id", "n", "ids", "width").join(_starts(tokens), "row")
        .select("doc_id", "n", "ids", "width", "at")
        .mapInArrow(
            cut,
            f"doc_id {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary",
        )
    )


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op1_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(pack(table(spark, sf_dir, "documents"), word_tokenizer()))


QUERIES = {"op1_curve_packing": op1_curve_packing}
ORACLES: dict[str, str] = {}
