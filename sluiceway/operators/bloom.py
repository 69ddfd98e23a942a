"""Train a Bloom model as a table and filter rows by it."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluiceway.functions.hashing import bloom_shape, hash_pair
from sluiceway.operators.sequence import BROADCAST_BYTES

# The configured capacity and false-positive rate.
EXPECTED_INSERTIONS = 20_000_000
FALSE_POSITIVE_RATE = 0.01

SHARD_BITS = 1 << 19


class BloomModel(NamedTuple):
    """``table`` has one row (shard, words) per shard; 64 KiB of bits each."""

    table: DataFrame
    bits: int
    shards: int
    hashes: int

    @property
    def size_bytes(self) -> int:
        """Known from the parameters, whatever the data."""
        return self.shards * self.bits // 8


def _positions(h1: Column, h2: Column, shards: int, bits: int, hashes: int) -> list[Column]:
    start = F.floor(h1 / shards) if shards > 1 else h1
    return [(start.cast("bigint") + h2 * i) % bits for i in range(hashes)]


def bloom_train(
    df: DataFrame,
    field: str,
    expected: int = EXPECTED_INSERTIONS,
    fpp: float = FALSE_POSITIVE_RATE,
    shard_bits: int = SHARD_BITS,
) -> BloomModel:
    """OR the hash positions of the field's values into 64-bit words."""
    bits, shards, hashes = bloom_shape(expected, fpp, shard_bits)
    words = bits // 64
    set_bits = (
        df.select(field).where(F.col(field).isNotNull()).distinct()
        .select(F.inline(F.array(hash_pair(F.col(field)))))
        .select(
            (F.col("h1") % shards).alias("shard"),
            F.explode(
                F.array(*_positions(F.col("h1"), F.col("h2"), shards, bits, hashes))
            ).alias("pos"),
        )
        .select(
            (F.col("shard") * words + F.shiftright("pos", 6)).alias("word"),
            F.expr("shiftleft(1L, cast(pos % 64 as int))").alias("mask"),
        )
    )
    empty = df.sparkSession.range(shards * words).select(
        F.col("id").alias("word"), F.lit(0).cast("bigint").alias("mask")
    )
    table = (
        set_bits.unionByName(empty)
        .groupBy("word").agg(F.bit_or("mask").alias("mask"))
        .groupBy(F.floor(F.col("word") / words).alias("shard"))
        .agg(F.array_sort(F.collect_list(F.struct("word", "mask")))["mask"].alias("words"))
    )
    return BloomModel(table, bits, shards, hashes)


def bloom_filter(
    df: DataFrame, model: BloomModel, field: str, max_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """Keep rows whose field might be in the model; rows without the field pass.

    The model is broadcast while its size, fixed by its parameters, stays under
    ``max_bytes``; past that rows and shards meet in a shuffled semi join.
    """
    # generated, not projected: the join's null checks then read the numbers
    # instead of hashing again below
    probe = df.select(
        "*", F.inline(F.array(hash_pair(F.coalesce(F.col(field).cast("string"), F.lit(""))))).alias("_h1", "_h2")
    ).withColumn("_shard", F.col("_h1") % model.shards)
    table = F.broadcast(model.table) if model.size_bytes <= max_bytes else model.table
    tests = [
        F.bit_get(F.get("words", F.shiftright(p, 6).cast("int")), (p % 64).cast("int")) == 1
        for p in _positions(F.col("_h1"), F.col("_h2"), model.shards, model.bits, model.hashes)
    ]
    hit = F.col(field).isNull() | reduce(lambda a, b: a & b, tests)
    return probe.join(table, (F.col("_shard") == F.col("shard")) & hit, "left_semi").select(*df.columns)


def bloom_filters(df: DataFrame, models: Mapping[str, BloomModel]) -> DataFrame:
    """Every (field, model) pair must pass."""
    return reduce(lambda rows, pair: bloom_filter(rows, pair[1], pair[0]), models.items(), df)


def exact_filter(df: DataFrame, keys: DataFrame, field: str) -> DataFrame:
    """The filter without false positives: a semi join on the known keys."""
    return df.join(keys.select(field).distinct(), field, "left_semi")
