"""Ordered work per key that survives a key holding a third of all rows.

A window partitioned by the key alone puts a key's whole history into one task.
Here only keys above ``hot_rows`` rows are cut, along all their order columns, into
chunks below ``hot_rows`` rows; windows run per (key, chunk) and what a chunk
needs from its past is carried over by small summary tables. Without a hot key
the plan is the plain window.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluiceway.functions.hashing import dense_bucket
from sluiceway.session import pin

HOT_ROWS = 20_000_000
BROADCAST_BYTES = 64 << 20


def fits_broadcast(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Measure ``df`` with one aggregate: is it small enough to copy to every executor?"""
    width = F.lit(0)
    for name, kind in df.dtypes:
        cell = F.col(f"`{name}`")
        text = cell if kind in ("binary", "string") else cell.cast("string")
        width = width + F.coalesce(F.octet_length(text), F.lit(0)) + 16
    total = df.agg(F.sum(width.cast("double"))).first()[0]
    return (total or 0) <= max_bytes


def lookup(
    df: DataFrame,
    table: DataFrame,
    on: str | Sequence[str] | Column,
    how: str = "inner",
    max_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Join a table that is usually small.

    Broadcast when its measured size allows it, else a shuffled join whose hot
    keys adaptive execution splits.
    """
    side = F.broadcast(table) if fits_broadcast(table, max_bytes) else table
    return df.join(side, on, how)


@dataclass(frozen=True)
class Chunked:
    """Rows with a ``_chunk`` column: -1 for ordinary keys, 0.. for hot ones."""

    rows: DataFrame
    keys: tuple[str, ...]
    order: tuple[str, ...]
    hot: bool

    @property
    def by(self) -> list[str]:
        return [*self.keys, "_chunk"] if self.hot else list(self.keys)

    @property
    def hot_rows(self) -> DataFrame:
        return self.rows.where("_chunk >= 0")


def chunked(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    hot_rows: int = HOT_ROWS,
    sizes: DataFrame | None = None,
) -> Chunked:
    """Cut hot keys into ranges of the whole order tuple.

    A range partitioning by keys and order samples the rows, so bursts are cut like calm times, any
    sortable columns will do, and only rows that agree in all of them stay together. A chunk is a
    partition, a third of ``hot_rows`` on average, so that sampling keeps it below ``hot_rows``. Rows
    with a missing key are never cut.

    Rows are counted per key to find the hot ones. Where that would run a costly
    plan twice, give ``sizes``: (keys, rows) from something cheaper, such as the
    raw table; too large a number does no harm.
    """
    keys, order = tuple(keys), tuple(order)
    if sizes is None:
        counts = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    else:
        counts = sizes.select(*keys, F.col("rows").alias("_n"))
    counts = counts.where(F.col("_n") > hot_rows).dropna(subset=list(keys))
    if counts.isEmpty():
        return Chunked(df.withColumn("_chunk", F.lit(-1).cast("bigint")), keys, order, False)

    # at most rows / hot_rows keys
    counts = pin(counts)
    parts = math.ceil(3 * counts.agg(F.sum("_n")).first()[0] / hot_rows)
    hot_keys = counts.select(*keys)
    # pinned: the bounds come from a sample, and rows and their summaries must be cut at the same places
    hot = pin(
        lookup(df, hot_keys, list(keys), "left_semi").repartitionByRange(parts, *keys, *order)
        .withColumn("_chunk", F.spark_partition_id().cast("bigint"))
    )
    cold = lookup(df, hot_keys, list(keys), "left_anti").withColumn("_chunk", F.lit(-1).cast("bigint"))
    return Chunked(cold.unionByName(hot), keys, order, True)


def with_position(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], hot_rows: int = HOT_ROWS
) -> tuple[DataFrame, list[str]]:
    """Add ``_pos``, the 1-based place of a row within its key.

    Also returns the columns the rows are now partitioned by.
    """
    cut = chunked(df, keys, order, hot_rows)
    here = F.row_number().over(Window.partitionBy(*cut.by).orderBy(*cut.order)).cast("bigint")
    rows = cut.rows.withColumn("_pos", here)
    if cut.hot:
        earlier = Window.partitionBy(*cut.keys).orderBy("_chunk").rowsBetween(
            Window.unboundedPreceding, -1
        )
        offsets = cut.hot_rows.groupBy(*cut.by).agg(F.count("*").alias("_n")).select(
            *cut.by, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset")
        )
        rows = (
            rows.join(offsets, cut.by, "left")
            .withColumn("_pos", F.col("_pos") + F.coalesce("_offset", F.lit(0)))
            .drop("_offset")
        )
    return rows, cut.by


def with_lookback(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    rows: int,
    qualifies: Column | None = None,
    hot_rows: int = HOT_ROWS,
    sizes: DataFrame | None = None,
) -> tuple[DataFrame, list[str]]:
    """Copy into each chunk the last ``rows`` qualifying rows that precede it.

    Returns the rows with a ``_halo`` flag (drop the flagged ones after the
    window) and the window's partition columns.
    """
    cut = chunked(df, keys, order, hot_rows, sizes)
    own = cut.rows.withColumn("_halo", F.lit(False))
    if not cut.hot or rows < 1:
        return own, cut.by

    hot = cut.hot_rows
    backwards = Window.partitionBy(*cut.by).orderBy(*[F.col(c).desc() for c in cut.order])
    tails = (
        (hot if qualifies is None else hot.where(qualifies))
        .withColumn("_back", F.row_number().over(backwards))
        .where(F.col("_back") <= rows)
    )
    # from here on a key has at most rows x chunks rows
    forwards = Window.partitionBy(*cut.keys).orderBy("_chunk", F.col("_back").desc())
    numbered = tails.withColumn("_i", F.row_number().over(forwards).cast("bigint")).drop("_back")
    held = numbered.groupBy(*cut.by).agg(F.count("*").alias("_held"))
    before = Window.partitionBy(*cut.keys).orderBy("_chunk").rowsBetween(
        Window.unboundedPreceding, -1
    )
    wanted = (
        hot.groupBy(*cut.by).agg(F.count("*").alias("_n"))
        .join(held, cut.by, "left")
        .withColumn("_before", F.sum(F.coalesce("_held", F.lit(0))).over(before))
        .where("_before > 0")
        .select(
            *cut.by,
            F.explode(
                F.sequence(F.greatest(F.lit(1), F.col("_before") - rows + 1), F.col("_before"))
            ).alias("_i"),
        )
    )
    halo = (
        numbered.drop("_chunk").join(wanted, [*cut.keys, "_i"])
        .drop("_i").withColumn("_halo", F.lit(True))
    )
    return own.unionByName(halo), cut.by


def dense_index(
    df: DataFrame, keys: Sequence[str], name: str = "index", digits: int = 4
) -> DataFrame:
    """Number the rows 0.. without gaps, in the order of (md5 of the key, key).

    Rows are bucketed by leading md5 digits, so buckets are even whatever the
    keys are; keys must be unique. Only the bucket counts, 16^digits at most
    (65,536 by default), are ever summed in one place and broadcast.
    """
    buckets = df.withColumn("_bucket", dense_bucket(*[F.col(k) for k in keys], digits=digits))
    digest = F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys]).cast("binary"))
    within = Window.partitionBy("_bucket").orderBy(digest, *keys)
    running = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = buckets.groupBy("_bucket").agg(F.count("*").alias("_n")).select(
        "_bucket", F.coalesce(F.sum("_n").over(running), F.lit(0)).alias("_offset")
    )
    return (
        buckets.withColumn("_here", F.row_number().over(within) - 1)
        .join(F.broadcast(offsets), "_bucket")  # 16^digits rows at most
        .withColumn(name, (F.col("_offset") + F.col("_here")).cast("bigint"))
        .drop("_bucket", "_here", "_offset")
    )


def side_by_side(
    df: DataFrame, keys: Sequence[str], order: Sequence[str] = (), partitions: int | None = None
) -> DataFrame:
    """Whole keys per partition, in order, for code that streams a partition.

    Partitioned by a hash of its own: a repartition that equals the one of a join
    below is planned away, and adaptive execution may then split that join's
    output anywhere.
    """
    placed = df.withColumn("_at", F.xxhash64(*keys))
    laid = placed.repartition(partitions, "_at") if partitions else placed.repartition("_at")
    return laid.sortWithinPartitions(*keys, *order).drop("_at")


def same_key(a: tuple | None, b: tuple | None) -> bool:
    """Equality of pandas group keys in which a missing part equals a missing part."""
    return a is not None and b is not None and all(
        x == y or (x != x and y != y) for x, y in zip(a, b)
    )


def digits_for(rows: int, per_bucket: int = 1_000_000) -> int:
    """Hex digits that keep buckets near ``per_bucket`` rows (at most 16^5 buckets)."""
    return min(5, max(1, math.ceil(math.log(max(rows / per_bucket, 1), 16))))
