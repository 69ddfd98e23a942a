"""Micro-batch gating, fan-in and fan-out, dealing, sampling, user code per batch."""

from __future__ import annotations

import contextlib
import subprocess
import threading
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluiceway.functions.hashing import hash60
from sluiceway.operators.sequence import (
    HOT_ROWS,
    dense_index,
    digits_for,
    lookup,
    same_key,
    side_by_side,
    with_position,
)


def _nth_arrival(batch: str, order: Sequence[str]) -> Column:
    return F.row_number().over(Window.partitionBy(batch).orderBy(*order))


def batch_gate(
    df: DataFrame,
    size: int = 10,
    batch: str = "batch_id",
    order: Sequence[str] = ("arrival",),
    repeat: bool = False,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """The item that brings a batch to ``size``; smaller batches are held back.

    ``repeat`` restarts the count, so every further ``size`` items emit again.
    """
    if repeat:
        placed, _ = with_position(df, [batch], order, hot_rows)
        return placed.where(F.col("_pos") % size == 0).drop("_pos", "_chunk")
    # the rank bound is applied before the shuffle: each task ships `size` rows per batch
    return df.withColumn("_nth", _nth_arrival(batch, order)).where(F.col("_nth") == size).drop("_nth")


def dedup_batch(
    df: DataFrame, batch: str = "batch_id", order: Sequence[str] = ("arrival",)
) -> DataFrame:
    """The first arrival of each batch."""
    return df.withColumn("_nth", _nth_arrival(batch, order)).where("_nth = 1").drop("_nth")


def limit_batch(df: DataFrame, order: Sequence[str], size: int = 10) -> DataFrame:
    """At most ``size`` items per iteration, oldest first."""
    return df.orderBy(*order).limit(size)


def except_processed(
    listing: DataFrame, *done: DataFrame, keys: Sequence[str] = ("path",)
) -> DataFrame:
    """The listing without what is in process or recently processed."""
    return reduce(
        lambda rows, other: rows.join(other.select(*keys), list(keys), "left_anti"), done, listing
    )


def fan_in(*inputs: DataFrame) -> DataFrame:
    """Bag union of the wires into one stage; columns absent on a wire are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), inputs)


def fan_out(
    df: DataFrame, stages: Sequence[Callable[[DataFrame], DataFrame]]
) -> list[DataFrame]:
    """Feed the same rows to several stages."""
    return [stage(df) for stage in stages]


def deal_round_robin(
    df: DataFrame,
    keys: Sequence[str],
    workers: int,
    pins: DataFrame | None = None,
    pin_on: str = "stream",
    offset: int = 0,
    digits: int = 4,
) -> DataFrame:
    """Assign ``worker``: pinned rows first, the others dealt in turn from ``offset``."""
    if pins is None:
        free, pinned = df, None
    else:
        marked = lookup(df, pins.withColumnRenamed("worker", "_pin").dropDuplicates([pin_on]), pin_on, "left")
        pinned = marked.where("_pin is not null").withColumn("worker", F.col("_pin").cast("bigint"))
        free = marked.where("_pin is null")
    dealt = (
        dense_index(free, keys, "_turn", digits)
        .withColumn("worker", (F.col("_turn") + offset) % workers)
        .drop("_turn")
    )
    out = dealt if pinned is None else pinned.unionByName(dealt)
    return out.drop("_pin")


def sample_batches(
    listing: DataFrame,
    keys: Sequence[str],
    batches: int,
    size: int = 10,
    seed: int = 0,
) -> DataFrame:
    """``batches`` batches of ``size`` items drawn with replacement, reproducibly.

    Draw i takes item h mod n, h being the first 15 hex digits of md5 over ``<seed>:<i>``.
    """
    spark = listing.sparkSession
    n = listing.count()
    indexed = dense_index(listing, keys, "_index", digits_for(n))
    draws = spark.range(batches * size).select(
        F.col("id").alias("draw"),
        F.floor(F.col("id") / size).alias("batch_id"),
        (hash60(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string"))) % n).alias("_index"),
    )
    return lookup(draws, indexed, "_index").drop("_index")


def apply_batch(
    df: DataFrame,
    fn: Callable[[pd.DataFrame], pd.DataFrame],
    schema: str,
    merge: Sequence[Column],
    batch: str = "batch_id",
    slice_on: Sequence[str] = (),
    slice_rows: int = 1_000_000,
) -> DataFrame:
    """Run a user function over slices of each batch and fold what it returns.

    ``fn`` sees rows of one batch, about ``slice_rows`` of them at most; ``merge`` (aggregate columns over its
    output) makes one row of all slices of a batch, however many there are.
    """
    counts = df.groupBy(batch).agg(F.count("*").alias("_n")).where(F.col("_n") > slice_rows)
    if counts.isEmpty():
        parts = df.withColumn("_slice", F.lit(0).cast("bigint"))
    else:
        on = [F.col(c) for c in (slice_on or df.columns)]
        slices = F.ceil(F.col("_n") / slice_rows)
        parts = (
            lookup(df, counts, batch, "left")
            .withColumn("_slice", F.coalesce(F.pmod(F.xxhash64(*on), slices), F.lit(0)))
            .drop("_n")
        )
    columns, group = df.columns, [batch, "_slice"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # slices lie side by side; the last one of a frame may go on in the next
        held: list[pd.DataFrame] = []
        held_key = None
        for frame in frames:
            done = []
            for key, part in frame.groupby(group, sort=False, dropna=False):
                if held and not same_key(key, held_key):
                    done.append(fn(pd.concat(held)[columns]))
                    held = []
                held.append(part)
                held_key = key
            if done:
                yield pd.concat(done)
        if held:
            yield fn(pd.concat(held)[columns])

    # a fixed number of partitions: user code is worth a task even where rows are few
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = side_by_side(parts, group, partitions=width).mapInPandas(run, schema)
    return out.groupBy(batch).agg(*merge)


def run_per_batch(
    batches: DataFrame, command: Sequence[str], root: str, batch: str = "batch_id", timeout: int = 3600
) -> DataFrame:
    """Run ``command <root>/<batch>`` once per batch; its stdout is the content.

    The command reads the batch from shared storage; only batch ids pass here.
    """
    kind = dict(batches.dtypes)[batch]
    command = list(command)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for b in frame[batch]:
                where = f"{root}/{b}"
                done = subprocess.run([*command, where], capture_output=True, text=True, check=True, timeout=timeout)
                yield pd.DataFrame({batch: [b], "source_dir": [where], "content": [done.stdout]})

    # a fixed number of partitions: a command is worth a task even where ids are few
    width = int(batches.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return batches.select(batch).distinct().repartition(width, batch).mapInPandas(
        run, f"{batch} {kind}, source_dir string, content string"
    )


def pipe_lines(df: DataFrame, column: str, command: Sequence[str]) -> DataFrame:
    """Stream a text column through an external command, one process per partition.

    Empty output lines are dropped; a failing command fails the task.
    """
    command = list(command)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        proc = subprocess.Popen(command, stdin=subprocess.PIPE, stdout=subprocess.PIPE, text=True)
        errors: list[BaseException] = []

        def feed() -> None:
            try:
                for frame in frames:
                    proc.stdin.writelines(f"{line}\n" for line in frame[column].dropna())
            except BaseException as error:  # noqa: BLE001 - raised again below
                errors.append(error)
            finally:
                with contextlib.suppress(BrokenPipeError):
                    proc.stdin.close()

        feeder = threading.Thread(target=feed, daemon=True)
        feeder.start()
        lines: list[str] = []
        for line in proc.stdout:
            if line.strip():
                lines.append(line.rstrip("\n"))
            if len(lines) == 10_000:
                yield pd.DataFrame({column: lines})
                lines = []
        feeder.join()
        code = proc.wait()
        if code:
            raise RuntimeError(f"{command[0]} ended with {code}")
        if errors and not isinstance(errors[0], BrokenPipeError):
            raise errors[0]  # a command may stop reading early and still succeed
        if lines:
            yield pd.DataFrame({column: lines})

    return df.select(column).mapInPandas(run, f"{column} string")


def user_map(df: DataFrame, fn: Callable[[Iterable], object], inputs: Sequence[str], output: str, kind: str) -> DataFrame:
    """Add ``output`` = a vectorised user function over the input columns."""
    return df.withColumn(output, F.pandas_udf(fn, kind)(*inputs))


def user_predicate(df: DataFrame, fn: Callable[[Iterable], object], inputs: Sequence[str]) -> DataFrame:
    """Keep rows for which a vectorised user function is true."""
    return df.where(F.pandas_udf(fn, "boolean")(*inputs))
