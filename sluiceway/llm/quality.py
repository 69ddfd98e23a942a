"""Operator 3: quality by a convolutional network over bytes.

A text's UTF-8 bytes are cut into overlapping chunks that cover all of it. Learned filters slide over
the embedded bytes of each chunk and are max-pooled; the mean and the maximum of the chunks' pooled
filters and the logarithm of the text's size go through one hidden layer to one probability. Training
and scoring are numpy; Spark deals out the documents and ships the weights.

Cases: null and empty texts are one chunk of padding and get a score like any other; without labelled
rows of both classes every score is the share of class 1 among them (0.5 if there are none); labels
that contradict each other for one document count as 1; rows that repeat an id are all scored; other
columns pass through; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from sluiceway.llm.common import blobs, fresh, land, table, utf8

CHUNK = 512
STEP = 448
WIDTH = 8
STRIDE = 2
CELLS = 8
FILTERS = 40
HIDDEN = 24
#: The sample that training sees: so many labelled documents at most, of so many bytes together, each whole.
MAX_TRAINING_ROWS = 4000
MAX_TRAINING_BYTES = 16 << 20
STEPS = 500
#: Documents of a step: fewer, but four at least, where they are long, so that a step holds about BATCH_CHUNKS chunks.
BATCH = 48
BATCH_CHUNKS = 1024
SLICE = 64


def chunk_starts(size: int) -> range:
    """Starts of the overlapping chunks that cover ``size`` bytes."""
    return range(0, max(1, size - CHUNK + STEP), STEP) if size > CHUNK else range(1)


def chunks_of(data: bytes) -> np.ndarray:
    """All chunks of a text, filled up with zero bytes."""
    starts = chunk_starts(len(data))
    out = np.zeros((len(starts), CHUNK), np.uint8)
    cells = np.frombuffer(data, np.uint8)
    for row, at in zip(out, starts):
        part = cells[at:at + CHUNK]
        row[:len(part)] = part
    return out


def windows(chunks: np.ndarray, embedding: np.ndarray) -> np.ndarray:
    """(chunks, positions, WIDTH * CELLS) embedded bytes under each filter position."""
    cells = embedding[chunks].reshape(len(chunks), CHUNK * CELLS)
    view = np.lib.stride_tricks.sliding_window_view(cells, WIDTH * CELLS, axis=1)[:, ::STRIDE * CELLS]
    return np.ascontiguousarray(view)


def pooled(chunks: np.ndarray, model: dict) -> np.ndarray:
    """Max-pooled filters of each chunk."""
    out = np.empty((len(chunks), FILTERS), np.float32)
    for at in range(0, len(chunks), SLICE):
        seen = windows(chunks[at:at + SLICE], model["embedding"])
        n, positions, width = seen.shape
        out[at:at + SLICE] = (seen.reshape(-1, width) @ model["filters"]).reshape(n, positions, -1).max(axis=1)
    return np.maximum(out + model["bias"], 0)


def combined(features: np.ndarray, counts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A document's row: mean and maximum over its chunks, and its size."""
    at = np.cumsum(counts) - counts
    mean = np.add.reduceat(features, at, axis=0) / counts[:, None]
    return np.hstack([mean, np.maximum.reduceat(features, at, axis=0), np.log1p(sizes)[:, None] / 10]).astype(np.float32)


def probability(rows: np.ndarray, model: dict) -> np.ndarray:
    hidden = np.maximum(rows @ model["w1"] + model["b1"], 0)
    return 1 / (1 + np.exp(-np.clip(hidden @ model["w2"] + model["b2"], -30, 30)))


def scores(texts: list[bytes], model: dict) -> np.ndarray:
    """One probability for each text, from all of its bytes."""
    if "share" in model:
        return np.full(len(texts), model["share"])
    out = []
    for at in range(0, len(texts), SLICE):
        part = texts[at:at + SLICE]
        counts = np.array([len(chunk_starts(len(t))) for t in part])
        features = np.empty((counts.sum(), FILTERS), np.float32)
        done, held, size = 0, [], 0
        for text in part:
            held.append(chunks_of(text))
            size += len(held[-1])
            if size >= 4 * SLICE:
                features[done:done + size] = pooled(np.concatenate(held), model)
                done, held, size = done + size, [], 0
        if held:
            features[done:] = pooled(np.concatenate(held), model)
        out.append(probability(combined(features, counts, np.array([len(t) for t in part])), model))
    return np.concatenate(out).astype(np.float64) if out else np.empty(0)


def train(chunks: list[np.ndarray], sizes: np.ndarray, labels: np.ndarray, steps: int = STEPS, seed: int = 7) -> dict:
    """Fit by Adam on the logistic loss; chunks holds all chunks of each document."""
    if len(set(labels.tolist())) < 2:
        return {"share": float(labels.mean()) if len(labels) else 0.5}
    rng = np.random.default_rng(seed)
    normal = lambda *shape, fan: (rng.standard_normal(shape) / np.sqrt(fan)).astype(np.float32)
    model = {
        "embedding": normal(256, CELLS, fan=1), "filters": normal(WIDTH * CELLS, FILTERS, fan=WIDTH * CELLS),
        "bias": np.zeros(FILTERS, np.float32), "w1": normal(2 * FILTERS + 1, HIDDEN, fan=2 * FILTERS),
        "b1": np.zeros(HIDDEN, np.float32), "w2": normal(HIDDEN, fan=HIDDEN), "b2": np.zeros((), np.float32),
    }
    model["embedding"][0] = 0
    first = {k: np.zeros_like(v) for k, v in model.items()}
    second = {k: np.zeros_like(v) for k, v in model.items()}
    by_class = [np.flatnonzero(labels == c) for c in (0, 1)]
    batch = max(4, min(BATCH, int(BATCH_CHUNKS / np.mean([len(c) for c in chunks]))))
    for step in range(1, steps + 1):
        # a quarter of each batch from class 0 at least, so that a rare class is seen
        rare = max(batch // 4, round(batch * len(by_class[0]) / len(labels)))
        rare = min(rare, batch - batch // 4)
        chosen = np.concatenate([rng.choice(by_class[0], rare), rng.choice(by_class[1], batch - rare)])
        chosen, drawn = np.unique(chosen, return_counts=True)
        grads = _gradients(model, [chunks[i] for i in chosen], sizes[chosen], labels[chosen], drawn)
        rate = 0.004 * (1 - 0.9 * step / steps)
        for k, g in grads.items():
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            model[k] = (
                model[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
            ).astype(np.float32)
        model["embedding"][0] = 0
    return model


def _gradients(model: dict, chunks: list[np.ndarray], sizes: np.ndarray, labels: np.ndarray, drawn: np.ndarray) -> dict:
    """Of the mean loss over the documents, each counted as often as it was drawn."""
    counts, flat = np.array([len(c) for c in chunks]), np.concatenate(chunks)
    owner = np.repeat(np.arange(len(chunks)), counts)
    n = len(flat)
    best, features = np.empty((n, FILTERS), np.int64), np.empty((n, FILTERS), model["filters"].dtype)
    for at in range(0, n, SLICE):
        seen = windows(flat[at:at + SLICE], model["embedding"])
        response = (seen.reshape(-1, seen.shape[2]) @ model["filters"]).reshape(len(seen), -1, FILTERS)
        best[at:at + SLICE] = response.argmax(axis=1)
        features[at:at + SLICE] = np.take_along_axis(response, best[at:at + SLICE, None], axis=1)[:, 0]
    features = np.maximum(features + model["bias"], 0)
    rows = combined(features, counts, sizes)
    hidden = np.maximum(rows @ model["w1"] + model["b1"], 0)
    p = 1 / (1 + np.exp(-np.clip(hidden @ model["w2"] + model["b2"], -30, 30)))
    d = ((p - labels) * drawn / drawn.sum()).astype(np.float32)
    grads = {"w2": hidden.T @ d, "b2": d.sum()}
    d_hidden = np.outer(d, model["w2"]) * (hidden > 0)
    grads |= {"w1": rows.T @ d_hidden, "b1": d_hidden.sum(axis=0)}
    d_rows = d_hidden @ model["w1"].T
    top = features.astype(np.float32) == rows[owner, FILTERS:2 * FILTERS]
    # chunks overlap, so two may hold the maximum; they share its gradient
    top = top / np.add.reduceat(top, np.cumsum(counts) - counts, axis=0, dtype=np.float32)[owner]
    d_features = (d_rows[owner, :FILTERS] / counts[owner][:, None] + d_rows[owner, FILTERS:2 * FILTERS] * top) * (features > 0)
    grads["bias"] = d_features.sum(axis=0)
    spots = best[:, :, None] * STRIDE + np.arange(WIDTH)
    at_bytes = flat[np.arange(n)[:, None, None], spots]
    under = model["embedding"][at_bytes].reshape(n, FILTERS, -1)  # the window each filter chose
    grads["filters"] = np.einsum("nfw,nf->wf", under, d_features)
    d_cells = (d_features[:, :, None] * model["filters"].T[None]).reshape(-1, CELLS)
    grads["embedding"] = np.stack(
        [np.bincount(at_bytes.ravel(), weights=d_cells[:, c], minlength=256) for c in range(CELLS)], axis=1
    ).astype(np.float32)
    return grads


def held_out(doc_id: str = "doc_id"):
    """Rows that training never sees."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1


def training_ids(sizes: list[tuple], most: int = MAX_TRAINING_BYTES) -> list:
    """Ids of the (id, size) rows, in their order, that fit into ``most`` bytes together."""
    out, left = [], most
    for doc_id, size in sizes:
        if size <= left:
            out.append(doc_id)
            left -= size
    return out


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS, max_bytes: int = MAX_TRAINING_BYTES) -> dict:
    """Train on at most ``max_rows`` labelled documents, drawn by a hash of their ids, that together hold at most
    ``max_bytes``; each is seen whole. Of rows that repeat an id, the greatest text counts."""
    known = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
        .groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    )
    drawn = land(
        docs.select("doc_id", utf8("text").alias("data")).join(F.broadcast(known), "doc_id")
        .groupBy("doc_id").agg(F.max("data").alias("data"), F.max("quality").alias("quality"))
        .withColumn("size", F.octet_length("data").cast("long")).withColumn("draw", F.xxhash64("doc_id")),
        "quality-sample",
    )
    # one row of at most max_rows ids, then their texts, max_bytes at most
    sizes = sorted((r["draw"], r["doc_id"], r["size"]) for r in drawn.select("draw", "doc_id", "size").collect())
    chosen = training_ids([(doc_id, size) for _, doc_id, size in sizes], max_bytes)
    rows = drawn.where(F.col("doc_id").isin(chosen)).select("doc_id", "quality", "data").collect() if chosen else []
    rows.sort(key=lambda r: r["doc_id"])
    texts = [bytes(r["data"]) for r in rows]
    return train(
        [chunks_of(t) for t in texts], np.array([len(t) for t in texts]), np.array([min(1, max(0, r["quality"])) for r in rows])
    )


def with_score(docs: DataFrame, model: dict, name: str) -> DataFrame:
    """``docs`` with the probability of class 1 in column ``name``."""
    data = fresh(docs, "_data")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [c for c in batch.schema.names if c != data]
            values = scores(blobs(batch[data]), model)
            yield pa.RecordBatch.from_arrays([batch[c] for c in kept] + [pa.array(values, pa.float64())], [*kept, name])

    schema = StructType([*docs.schema, StructField(name, DoubleType())])
    return docs.withColumn(data, utf8("text")).mapInArrow(score, schema)


def keep_good(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the documents that the classifier rejects."""
    name = fresh(docs, "score")
    columns = docs.columns
    return with_score(docs, fit(docs, labels), name).where(F.col(name) >= 0.5).select(*columns)


def op3_quality_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = with_score(docs.select("doc_id", "text"), fit(docs, labels), "score")
    return scored.select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


QUERIES = {"op3_quality_network": op3_quality_network}
ORACLES: dict[str, str] = {}
