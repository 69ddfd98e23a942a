"""Insert-or-replace by key on layers of parquet (``sinks.commits``).

Every micro-batch adds a layer to the buckets its keys fall into, under the id of its query and its epoch, so
a replayed epoch changes nothing and a new checkpoint, which counts from zero again, does not meet the old.
Readers fold by key only the buckets that have several layers; ``compact`` rewrites only those.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluiceway.session import query_id
from sluiceway.sinks.commits import BUCKETS, Change, CommitLog

#: The run of updates that no streaming query hands over.
BY_HAND = "by-hand"


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The current row of each key; one row per key and task reaches the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    return (
        df.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
        .select(*keys, "_row.*")
        .select(*df.columns)
    )


def upsert(
    updates: DataFrame, root: str, epoch: int, keys: Sequence[str], order: Sequence[str], run: str = BY_HAND,
    buckets: int = BUCKETS,
) -> None:
    """Record one batch of updates under its run and epoch; epochs of a run grow. ``buckets`` is fixed by the
    first batch."""
    log = CommitLog(updates.sparkSession, root, buckets)

    def build(seen) -> Change | None:
        if seen.runs.get(run, -1) >= epoch:
            return None
        rows = log.bucketed(latest_per_key(updates, keys, order), keys, seen)
        _, layers = log.stage(rows, seen, over=True)
        return Change(tuple(layers.values()), touched=frozenset(), schema=updates.schema.json(), run=run, epoch=epoch)

    log.write(build)


def upsert_sink(
    root: str, keys: Sequence[str], order: Sequence[str], buckets: int = BUCKETS
) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``."""
    return lambda rows, epoch: upsert(rows, root, epoch, keys, order, query_id(rows), buckets)


def read_current(spark: SparkSession, root: str, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The table as of the last recorded epoch."""
    log = CommitLog(spark, root)
    seen = log.latest()
    if seen.schema is None:
        raise ValueError(f"nothing was ever written to {root}")
    return log.read(seen, seen.layers, keys, order)


def compact(spark: SparkSession, root: str, keys: Sequence[str], order: Sequence[str]) -> int:
    """Fold the buckets that have several layers into one layer each; returns how many buckets were rewritten.

    The layers it replaced stay for readers of older commits until ``CommitLog.vacuum``.
    """
    log = CommitLog(spark, root)
    rewritten: set[int] = set()

    def build(seen) -> Change | None:
        counts: dict[int, int] = {}
        for layer in seen.layers:
            counts[layer.bucket] = counts.get(layer.bucket, 0) + 1
        stacked = {b for b, n in counts.items() if n > 1}
        rewritten.clear()
        rewritten.update(stacked)
        if not stacked:
            return None
        old = seen.of(stacked)
        _, layers = log.stage(log.bucketed(log.read(seen, old, keys, order), keys, seen), seen)
        return Change(tuple(layers.values()), tuple(old), frozenset(stacked))

    log.write(build)
    return len(rewritten)
