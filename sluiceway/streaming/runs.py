"""Start and drain streaming queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from sluiceway.session import STATE_STORE, query_id


@contextmanager
def state_partitions(spark: SparkSession, n: int | None = None) -> Iterator[None]:
    """Shuffle partitions (default one per core) and the state store for the stateful queries started inside."""
    wanted = {"spark.sql.shuffle.partitions": str(n or spark.sparkContext.defaultParallelism), **STATE_STORE}
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def to_files(
    stream: DataFrame, out: str, checkpoint: str, every: str | None = None, name: str | None = None
) -> StreamingQuery:
    """Append to parquet files, exactly once; ``every`` is the trigger period."""
    writer = (
        stream.writeStream.format("parquet").outputMode("append")
        .option("path", out).option("checkpointLocation", checkpoint)
    )
    if name:
        writer = writer.queryName(name)
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return writer.trigger(**trigger).start()


def by_epoch(out: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that gives each epoch of a query a directory of its own, so a
    replayed epoch replaces what it wrote before. Readers see the columns ``run`` and ``epoch``."""
    def write(rows: DataFrame, epoch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/run={query_id(rows)}/epoch={epoch}")

    return write


def updates_to_files(stream: DataFrame, out: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """The same for queries in update mode."""
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return (
        stream.writeStream.outputMode("update").foreachBatch(by_epoch(out))
        .option("checkpointLocation", checkpoint).trigger(**trigger).start()
    )


def to_sinks(
    stream: DataFrame,
    sinks: Sequence[Callable[[DataFrame, int], None]],
    checkpoint: str,
    every: str | None = None,
) -> StreamingQuery:
    """Give each trigger's rows to several sinks, computing them once."""
    def write(rows: DataFrame, epoch: int) -> None:
        rows.persist()
        try:
            for sink in sinks:
                sink(rows, epoch)
        finally:
            rows.unpersist()

    trigger = {"processingTime": every} if every else {"availableNow": True}
    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint).trigger(**trigger).start()
    )


def drain(query: StreamingQuery) -> None:
    """Wait for a query that stops by itself; its failure is raised here."""
    query.awaitTermination()
