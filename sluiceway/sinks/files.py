"""Batches of files and append tables."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from sluiceway.operators.sequence import lookup, with_position
from sluiceway.session import pin, query_id
from sluiceway.sinks.commits import BUCKETS, Change, CommitLog, Layer


class Written(NamedTuple):
    success: DataFrame
    failure: DataFrame


def _place(df: DataFrame, order: str | None):
    """What tells rows of one name apart; maps have no hash."""
    plain = [f.name for f in df.schema if "map<" not in f.dataType.simpleString()]
    return F.col(order) if order else F.xxhash64(*plain)


def write_batches(
    df: DataFrame,
    root: str,
    batch: str = "batch_id",
    name: str = "filename",
    conflict: str = "fail",
    max_files: int | None = None,
    order: str | None = None,
    max_records: int = 5_000_000,
    unique: bool = False,
    buckets: int = BUCKETS,
    run: str | None = None,
    epoch: int = -1,
) -> Written:
    """Store items by batch; names are unique within a batch.

    A name that is already stored fails, is ignored (counts as success, keeps the
    old content) or is replaced; a name that repeats within ``df`` is treated as if its
    rows came one after the other (``unique`` says that none does, and saves a sort). Items past
    ``max_files`` per batch, in the order of the numeric column ``order``, fail.

    Batches are dealt to ``buckets``, fixed by the first write; only buckets that receive rows are looked at. All of
    it counts at once or not at all (``sinks.commits``), and an ``epoch`` of a ``run`` counts once. What failed
    is kept beside the rows until ``vacuum``.
    """
    if conflict not in ("fail", "ignore", "replace"):
        raise ValueError(f"unknown conflict mode {conflict!r}")
    spark, keys = df.sparkSession, [batch, name]
    log = CommitLog(spark, root, buckets)
    columns, where = df.columns, {}
    # of rows that share a name the first is stored; where names are replaced, the last
    again = F.lit(False)
    if not unique:
        place = _place(df, order)
        own = Window.partitionBy(*keys).orderBy(place.desc() if conflict == "replace" else place)
        again = F.row_number().over(own) > 1
    incoming = df.withColumn("_again", again)
    pinned: list[DataFrame] = []

    def build(seen) -> Change | None:
        if run is not None and seen.runs.get(run, -1) >= epoch:
            return None
        rows = log.bucketed(pinned[0] if pinned else incoming, [batch], seen)
        repeated = F.when(F.col("_again"), F.lit(conflict)).otherwise(F.lit("write"))
        touched: set[int] = set()
        stored = None
        if seen.layers or max_files is not None:
            # the routes depend on what is stored now, so the rows are fixed before they are decided
            if not pinned:
                pinned.append(pin(incoming))
                rows = log.bucketed(pinned[0], [batch], seen)
            touched = {r[0] for r in rows.select("_bucket").distinct().collect()}
            if seen.of(touched):
                stored = log.read(seen, seen.of(touched), keys).select(*keys)
        routed = rows.withColumn("_route", repeated)
        if stored is not None and conflict != "replace":
            known = stored.withColumn("_known", F.lit(True))
            routed = rows.join(known, keys, "left").withColumn(
                "_route", F.when(F.col("_known"), F.lit(conflict)).otherwise(repeated)
            ).drop("_known")
        if max_files is not None:
            waiting = routed.where("_route = 'write'")
            held = F.lit(0)
            if stored is not None and conflict == "replace":  # a stored name takes no new place
                mine = stored.withColumn("_known", F.lit(True))
                waiting = waiting.join(mine, keys, "left")
            else:
                waiting = waiting.withColumn("_known", F.lit(None).cast("boolean"))
            ready, waiting = waiting.where("_known").drop("_known"), waiting.where("_known is null").drop("_known")
            placed, _ = with_position(
                waiting.withColumn("_order", F.col(order) if order else F.xxhash64(name)), [batch], ["_order", name]
            )
            if stored is not None:
                counts = stored.groupBy(batch).agg(F.count("*").alias("_held"))
                placed = lookup(placed, counts, batch, "left")
                held = F.coalesce("_held", F.lit(0))
            over = F.col("_pos") + held > max_files
            placed = placed.withColumn("_route", F.when(over, F.lit("fail")).otherwise(F.lit("write")))
            routed = placed.select(*routed.columns).unionByName(routed.where("_route <> 'write'")).unionByName(ready)
        where["path"], layers = log.stage(
            routed.select(*columns, "_bucket", "_route"), seen, stat=batch, over=conflict == "replace" and bool(seen.layers),
            split=("_route",), max_records=max_records,
        )
        return Change(tuple(layers.values()), touched=frozenset(touched | set(layers)), schema=df.schema.json(), run=run, epoch=epoch)

    log.write(build)
    if "path" not in where:
        nothing = spark.createDataFrame([], df.schema)
        return Written(nothing, nothing)
    done = spark.read.schema(StructType([*df.schema, StructField("_route", StringType())])).parquet(where["path"])
    return Written(done.where("_route <> 'fail'").select(*columns), done.where("_route = 'fail'").select(*columns))


def read_batches(
    spark: SparkSession, root: str, requests: DataFrame | None = None, batch: str = "batch_id", name: str = "filename"
) -> DataFrame | None:
    """The stored items, of the requested batches only if given; None while nothing was ever written.

    Layers whose range of batches lies apart from that of the requests are not opened.
    """
    log = CommitLog(spark, root)
    seen = log.latest()
    if seen.schema is None:
        return None
    if requests is None:
        return log.read(seen, seen.layers, [batch, name])
    wanted = requests.select(F.col(batch).cast(seen.struct()[batch].dataType).alias(batch)).distinct()
    low, high = wanted.agg(F.min(batch), F.max(batch)).first()

    def near(layer: Layer) -> bool:
        return low is not None and (layer.low is None or (layer.low <= high and layer.high >= low))

    # layers of one bucket stay together, as one may replace rows of another
    open_buckets = {x.bucket for x in seen.layers if near(x)}
    return lookup(log.read(seen, seen.of(open_buckets), [batch, name]), wanted, batch, "left_semi")


def batch_sink(
    root: str, batch: str = "batch_id", name: str = "filename", conflict: str = "fail", **options
) -> Callable[[DataFrame, int], None]:
    """``write_batches`` for ``foreachBatch``; a replayed epoch changes nothing."""
    def write(rows: DataFrame, epoch: int) -> None:
        write_batches(rows, root, batch, name, conflict, run=query_id(rows), epoch=epoch, **options)

    return write


def write_batches_url(
    df: DataFrame, root: str, batch: str = "batch_id", name: str = "filename"
) -> DataFrame:
    """Store items, replacing silently, and add the ``url`` of their batch directory."""
    done = write_batches(df, root, batch, name, conflict="replace").success
    return done.withColumn("url", F.concat(F.lit(f"{root.rstrip('/')}/"), F.col(batch).cast("string")))


def append_batch_table(
    df: DataFrame, root: str, batch: str = "batch_id", content: str = "content"
) -> None:
    """Append (id, batch_id, content) rows; the id is random."""
    df.select(
        F.expr("uuid()").alias("id"), F.col(batch).alias("batch_id"), F.col(content).alias("content")
    ).write.mode("append").parquet(root)


def append_jdbc_table(df: DataFrame, url: str, table: str, **options: str) -> None:
    """The same into a table behind JDBC."""
    df.write.format("jdbc").options(url=url, dbtable=table, **options).mode("append").save()
