"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluiceway.operators.sequence import lookup
from sluiceway.session import scratch, ship

WHITE = b" \t\n\x0b\x0c\r"


def land(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and go on from the files: later steps neither repeat the
    work nor depend on the executors that did it."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


BATCH_BYTES = 8 << 20


def prepare(spark: SparkSession) -> None:
    """Ship the package, and bound what a Python worker holds of whole texts at once: Arrow batches of
    ``BATCH_BYTES`` at most, unless the session asks for less already."""
    ship(spark)
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    size = spark.conf.get(name) or ""
    if not 0 < int(size.rstrip("b") if size.rstrip("b").isdigit() else 0) <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened by underscores until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def blobs(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """Binary cells; null is empty."""
    return [b if b is not None else b"" for b in column.to_pylist()]


def utf8(column: str):
    """A text column as UTF-8 bytes; null is empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a number for each row, landed so that it stays the same, and the column's name."""
    row = fresh(docs, "_row")
    return land(docs.withColumn(row, F.monotonically_increasing_id()), "numbered"), row


def keep_rows(docs: DataFrame, row: str, kept: DataFrame) -> DataFrame:
    """The rows of numbered ``docs`` whose number is in column ``row`` of ``kept``; the number is dropped."""
    return lookup(docs, kept.select(F.col("row").alias(row)), row, "left_semi").drop(row)


def groups_of(
    batches: Iterator[pa.RecordBatch], keys: list[str]
) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Cut a sorted stream where a key ends: tables of whole groups and their bounds in the table.

    Holds one batch and the rows of its last group.
    """
    held: pa.Table | None = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        held = rows if held is None else pa.concat_tables([held, rows])
        bounds = _bounds(held, keys)
        if len(bounds) > 2:
            yield held.slice(0, bounds[-2]), bounds[:-1]
            held = held.slice(bounds[-2])
    if held is not None and held.num_rows:
        yield held, _bounds(held, keys)


def _bounds(rows: pa.Table, keys: list[str]) -> np.ndarray:
    if not rows.num_rows:
        return np.array([0])
    new = np.zeros(rows.num_rows, bool)
    new[0] = True
    for key in keys:
        values = rows[key].to_numpy()
        new[1:] |= values[1:] != values[:-1]
    return np.append(np.flatnonzero(new), rows.num_rows)


def block_pairs(rows: DataFrame, keys: list[str], salt: str, block: int) -> DataFrame:
    """Deal rows of a bucket that is larger than ``block`` to pairs of blocks.

    Adds ``_a <= _b`` (the pair of blocks) and ``_blk`` (the row's own block). A bucket of n rows
    gets about n / block blocks; each two rows of it meet in exactly one pair if their blocks
    differ, and in (x, x) if not. So no task ever holds more than about two blocks.
    """
    sizes = land(
        rows.groupBy(*keys).count().where(F.col("count") > block)
        .select(*keys, F.ceil(F.col("count") / block).cast("int").alias("_blocks")),
        "bucket-sizes",
    )
    dealt = lookup(rows, sizes, keys, "left") if not sizes.isEmpty() else rows.withColumn("_blocks", F.lit(None).cast("int"))
    dealt = dealt.withColumn("_blk", F.coalesce(F.pmod(F.xxhash64(salt), F.col("_blocks")), F.lit(0)).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_blocks"), F.lit(1)) - 1))
    return (
        dealt.withColumn("_other", other)
        .withColumn("_a", F.least("_blk", "_other")).withColumn("_b", F.greatest("_blk", "_other"))
        .drop("_other", "_blocks")
    )
