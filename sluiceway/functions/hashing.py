"""Hash positions that any SQL engine with md5 can recompute."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_pair(key: Column) -> Column:
    """STRUCT<h1, h2>: two 48-bit numbers from the first 24 hex digits of md5."""
    def number(digest: Column, at: int) -> Column:
        return F.conv(F.substring(digest, at, 12), 16, 10).cast("bigint")

    digest = F.array(F.md5(key.cast("string").cast("binary")))
    # the digest is taken once and read twice
    pairs = F.transform(digest, lambda d: F.struct(number(d, 1).alias("h1"), number(d, 13).alias("h2")))
    return F.get(pairs, F.lit(0))


def hash60(key: Column) -> Column:
    """A 60-bit number from the first 15 hex digits of md5."""
    return F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 15), 16, 10).cast("bigint")


def bloom_shape(expected: int, fpp: float, shard_bits: int) -> tuple[int, int, int]:
    """(bits per shard, shards, hashes) for ``expected`` keys at ``fpp``.

    The bit total is the textbook -n ln p / (ln 2)^2; it is rounded up to whole
    64-bit words and dealt over as many shards as ``shard_bits`` demands.
    """
    if expected < 1 or not 0 < fpp < 1:
        raise ValueError("expected must be positive and fpp between 0 and 1")
    bits = math.ceil(-expected * math.log(fpp) / math.log(2) ** 2)
    shards = max(1, math.ceil(bits / shard_bits))
    per_shard = 64 * math.ceil(bits / shards / 64)
    hashes = max(1, round(bits / expected * math.log(2)))
    return per_shard, shards, hashes


def dense_bucket(*keys: Column, digits: int = 3) -> Column:
    """Even, reproducible bucket of a row: leading hex digits of md5 over its key."""
    text = F.concat_ws("|", *[k.cast("string") for k in keys])
    return F.substring(F.md5(text.cast("binary")), 1, digits)
