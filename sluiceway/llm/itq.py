"""Operator 5: near-duplicate vectors by iterative quantisation.

Rotations are learned on a bounded sample so that the signs of rotated vectors are balanced binary codes
(alternating between codes and an orthogonal Procrustes step). The codes of several rotations are cut
into substrings; each substring indexes one Hamming table, every vector stands in all tables, and
vectors that share a substring are compared by their original components in double precision.

Codes are taken about the mean, so the plan of tables is measured: pairs at the threshold are made of the
sample and found in it, and the length of substrings and number of tables are the cheapest that find
``recall`` of them or more, closer pairs more often. Few vectors, and vectors so crowded about their mean that codes tell
little, get one table without bits, which compares all pairs in blocks.

Cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing;
vectors of different lengths do not link; equal vectors are one node that carries its number; rows
that repeat an id are all returned (an id is not its own link, but its copy counts); null ids never
are the smallest; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluiceway.llm.common import block_pairs, groups_of, land, table
from sluiceway.llm.components import components

THRESHOLD = 0.9
RECALL = 0.97
SAMPLE = 8192
ITERATIONS = 25
BLOCK = 1024
PAIRS = 2048
TRIAL_BITS = 1024


def learn_rotation(sample: np.ndarray, seed: int, iterations: int = ITERATIONS) -> np.ndarray:
    """An orthogonal matrix under which the signs of the (centred) sample lose least."""
    d = sample.shape[1]
    rotation, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    for _ in range(iterations):
        turned = sample @ rotation
        u, _, v = np.linalg.svd(sample.T @ np.where(turned >= 0, 1.0, -1.0))
        rotation = u @ v
    return rotation


def near_pairs(sample: np.ndarray, threshold: float, seed: int = 0) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sets of pairs at the threshold or just above: vectors of the sample turned towards another vector of it,
    turned in any direction, and, if it has enough, pairs of the sample itself."""
    n, d = sample.shape
    rng = np.random.default_rng(seed)
    x = sample[rng.integers(n, size=PAIRS)]
    sets = []
    for towards in (sample[rng.integers(n, size=PAIRS)], rng.standard_normal((PAIRS, d))):
        across = towards - (towards * x).sum(axis=1, keepdims=True) * x
        size = np.linalg.norm(across, axis=1)
        able = size > 1e-6
        across = across[able] / size[able, None]
        if len(across):
            sets.append((x[able], threshold * x[able] + math.sqrt(max(0.0, 1 - threshold**2)) * across))
    left, right = [], []
    for at in range(0, n, 256):
        cosine = sample[at:at + 256] @ sample.T
        i, j = np.nonzero((cosine >= threshold) & (cosine < threshold + (1 - threshold) / 5))
        i += at
        left.append(i[i < j])
        right.append(j[i < j])
    left, right = np.concatenate(left), np.concatenate(right)
    if len(left) >= 100:
        drawn = rng.permutation(len(left))[:PAIRS]
        sets.append((sample[left[drawn]], sample[right[drawn]]))
    return sets


def plan_tables(n: int, d: int, agreements: list[np.ndarray], crowd: list[float], recall: float = RECALL) -> tuple[int, int]:
    """(bits of a substring, number of tables) of least cost for n vectors of d components.

    ``agreements`` holds, for sets of pairs at the threshold, each pair's share of equal bits; ``crowd`` the share of all
    pairs that agree in 0, 1, 2, ... bits of a substring. A copy costs its bytes, a comparison one. No bits
    and one table compare all pairs.
    """
    best = (math.inf, 0, 1)
    for bits in range(len(crowd)):
        met = max(1.0, n * max(crowd[bits], 2.0**-bits))  # vectors of a bucket

        def cost(tables: int) -> float:
            return tables * ((4 * d + 8 * tables) * max(1.0, met / BLOCK) + met)

        def found(tables: int) -> float:
            return min((float(np.mean(1 - (1 - q**bits) ** tables)) for q in agreements), default=1.0)

        low, high = 0, 1
        while found(high) < recall and cost(high) < best[0]:
            low, high = high, 2 * high
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (low, middle) if found(middle) >= recall else (middle, high)
        if found(high) >= recall and cost(high) < best[0]:
            best = (cost(high), bits, high)
    return best[1:]


def fit(sample: np.ndarray, n: int, threshold: float = THRESHOLD, recall: float = RECALL) -> dict:
    """Mean, rotations and table plan for unit vectors; ``sample`` is bounded.

    Codes are signs about the mean, where the angle of a pair is wider than its own, so the plan follows from the bits
    in which pairs at the threshold do agree, and tables are added until the fitted codes find enough of them.
    """
    d = sample.shape[1]
    mean = sample.mean(axis=0)
    rotations: list[np.ndarray] = []

    def turned(bits: int) -> np.ndarray:
        while d * len(rotations) < bits:
            rotations.append(learn_rotation(sample - mean, len(rotations)))
        return np.hstack(rotations)[:, :bits] if bits else np.empty((d, 0))

    def signs(vectors: np.ndarray, rotation: np.ndarray) -> np.ndarray:
        return (vectors - mean) @ rotation >= 0

    pairs = near_pairs(sample, threshold)
    trial = turned(TRIAL_BITS)
    agreements = [(signs(x, trial) == signs(y, trial)).mean(axis=1) for x, y in pairs]
    most = int(min(48, max(6, math.ceil(math.log2(max(n, 2))) - 2)))
    code, crowd = signs(sample, trial), [1.0]
    for bits in range(1, most + 1):
        shares = []
        for at in range(0, min(TRIAL_BITS // bits, 8) * bits, bits):
            counts = np.unique(code[:, at:at + bits] @ (1 << np.arange(bits, dtype=np.int64)), return_counts=True)[1]
            shares.append((counts * (counts - 1)).sum() / max(1, len(sample) * (len(sample) - 1)))
        crowd.append(float(np.mean(shares)))
    bits, tables = plan_tables(n, d, agreements, crowd, recall)
    # equal bits of one rotation are not independent: count what is really found
    while bits:
        rotation = turned(bits * tables)
        found = [
            (signs(x, rotation) == signs(y, rotation)).reshape(len(x), tables, bits).all(axis=2).any(axis=1).mean()
            for x, y in pairs
        ]
        if min(found, default=1.0) >= recall:
            break
        tables += max(1, tables // 10)
    return {"mean": mean, "rotation": turned(bits * tables), "bits": bits, "tables": tables}


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows at unit length; scaled first, so that no square under- or overflows."""
    vectors = vectors.astype(np.float64)
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def substrings(vectors: np.ndarray, model: dict) -> np.ndarray:
    """(rows, tables) substrings of the codes of unit vectors."""
    code = ((vectors - model["mean"]) @ model["rotation"] >= 0).reshape(len(vectors), model["tables"], model["bits"])
    return code.astype(np.int64) @ (1 << np.arange(model["bits"], dtype=np.int64))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _sound(column: str = "embedding"):
    """Whether a vector can link at all."""
    vector = F.col(column)
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce((F.size(vector) > 0) & ~odd & F.exists(vector, lambda x: x != 0), F.lit(False))


def _links(nodes: DataFrame, model: dict, threshold: float, block: int) -> DataFrame:
    """(a, b, links): rows with b name a link of a block's spanning forest, rows without give the
    number of vectors that the block newly links to node a."""
    tables = model["tables"]

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = substrings(unit(_matrix(batch["embedding"])), model) if batch.num_rows else np.empty((0, tables), np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch["node"], batch["size"], batch["embedding"],
                    pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel()), tables).cast(pa.list_(pa.int64())),
                ],
                ["node", "size", "embedding", "keys"],
            )

    kind = dict(nodes.dtypes)["embedding"]
    rows = nodes.select("node", "size", "embedding").mapInArrow(
        indexed, f"node long, size long, embedding {kind}, keys array<long>"
    )
    rows = rows.select("node", "size", "embedding", "keys", F.posexplode("keys").alias("band", "key"))
    dealt = block_pairs(rows, ["band", "key"], "node", block)
    groups = ["band", "key", "_a", "_b"]

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from sluiceway.llm.simhash import forest

        def found(part: pa.Table, group: np.ndarray) -> pa.RecordBatch:
            x, keys = unit(_matrix(part["embedding"])), _matrix(part["keys"])
            node, size = part["node"].to_numpy(), part["size"].to_numpy()
            band, own = part["band"].to_numpy(), part["_blk"].to_numpy()
            across = part["_a"].to_numpy() != part["_b"].to_numpy()
            left, right, degree = [], [], np.zeros(len(x), np.int64)
            for at in range(0, len(x), 256):
                to = min(at + 256, len(x))
                near = x[at:to] @ x.T >= threshold
                near &= (group[at:to, None] == group) & (np.arange(at, to)[:, None] < np.arange(len(x)))
                near &= ~across[at:to, None] | (own[at:to, None] != own)
                i, j = np.nonzero(near)
                i += at
                # a pair counts in the first table that it shares
                earlier = np.zeros(len(i), bool)
                for t in range(int(band[at:to].max(initial=0))):
                    earlier |= (keys[i, t] == keys[j, t]) & (t < band[i])
                i, j = i[~earlier], j[~earlier]
                np.add.at(degree, i, size[j])
                np.add.at(degree, j, size[i])
                left.append(i)
                right.append(j)
            root = forest(np.concatenate(left), np.concatenate(right), len(x))
            counted, child = np.flatnonzero(degree), np.flatnonzero(root != np.arange(len(x)))
            other = np.concatenate([np.zeros(len(counted), np.int64), node[root[child]]])
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([node[counted], node[child]]), pa.int64()),
                    pa.array(other, pa.int64(), mask=np.arange(len(other)) < len(counted)),
                    pa.array(np.concatenate([degree[counted], np.zeros(len(child), np.int64)]), pa.int64()),
                ],
                ["a", "b", "links"],
            )

        for held, bounds in groups_of(batches, groups):
            sizes = np.diff(bounds)
            first = 0
            while first < len(sizes):  # whole groups, together up to a block
                last, total = first, 0
                while last < len(sizes) and (last == first or total + sizes[last] <= block // 2):
                    total += sizes[last] if sizes[last] > 1 else 0
                    last += 1
                several = [g for g in range(first, last) if sizes[g] > 1]
                if several:
                    at = np.concatenate([np.arange(bounds[g], bounds[g + 1]) for g in several])
                    yield found(held.take(pa.array(at)), np.repeat(several, sizes[several]))
                first = last

    return (
        dealt.select(*groups, "_blk", "node", "size", "embedding", "keys")
        .repartition(*groups).sortWithinPartitions(*groups).mapInArrow(compared, "a long, b long, links long")
    )


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """Per row of ``vectors`` (vec_id, embedding): vec_id, n_links, component_id, kept."""
    sound = vectors.where(_sound()).select("vec_id", "embedding")
    nodes = land(
        sound.groupBy("embedding").agg(F.min("vec_id").alias("least_id"), F.count("*").alias("size"))
        .withColumn("node", F.monotonically_increasing_id()),
        "vectors",
    )
    lengths = nodes.groupBy(F.size("embedding").alias("d")).count().collect()  # one row for each length
    found = None
    for d, n in sorted((r["d"], r["count"]) for r in lengths):
        same = nodes.where(F.size("embedding") == d)
        sample = same.orderBy(F.xxhash64("node")).limit(SAMPLE).select("embedding").collect()
        model = fit(unit(np.array([r[0] for r in sample])), n, threshold, recall)
        part = _links(same, model, threshold, block)
        found = part if found is None else found.unionByName(part)
    if found is None:
        linked = nodes.select("embedding", F.lit(0).cast("long").alias("n_links"), F.col("least_id").alias("component_id"))
    else:
        found = land(found, "vector-links")
        reach = components(found.where("b is not null").select("a", "b"))
        degree = found.where("b is null").groupBy("a").agg(F.sum("links").alias("links"))
        home = nodes.join(reach, "node", "left").withColumn("component", F.coalesce("component", "node"))
        least = home.groupBy("component").agg(F.min("least_id").alias("component_id"))
        linked = home.join(least, "component").join(degree.withColumnRenamed("a", "node"), "node", "left").select(
            "embedding", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), "component_id"
        )
    linked = sound.join(linked, "embedding").select("vec_id", "n_links", "component_id")
    alone = vectors.where(~_sound()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op5_itq_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


QUERIES = {"op5_itq_vectors": op5_itq_vectors}
ORACLES = {}
