"""The two dataflows the operators were made for, as typed plans."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluiceway.operators.batches import batch_gate
from sluiceway.operators.bloom import BloomModel, bloom_filter
from sluiceway.operators.clean import as_columns, batch_has_label, range_filter, senml_parse, split_bad
from sluiceway.operators.impute import impute_mean
from sluiceway.operators.joins import annotate, join_batch_exists
from sluiceway.schemas import TRIP_RANGES
from sluiceway.session import query_id
from sluiceway.sinks.files import write_batches
from sluiceway.sinks.topics import FileOutbox, messages, put_messages
from sluiceway.sinks.upsert import upsert

TRIP_COLUMNS = (
    "msg_id", "taxi_identifier", "hack_license", "trip_time_in_secs", "trip_distance",
    "fare_amount", "surcharge", "tip_amount", "tolls_amount", "payment_type",
)


def clean_trips(
    lines: DataFrame, metadata: DataFrame, model: BloomModel | None = None, spec: str = TRIP_RANGES
) -> DataFrame:
    """SenML lines to valid, known, annotated trips; each step is stateless, so it
    serves a stream as well as a table."""
    good, _ = split_bad(senml_parse(lines))
    return clean_parsed(good, metadata, model, spec)


def clean_parsed(
    good: DataFrame, metadata: DataFrame, model: BloomModel | None = None, spec: str = TRIP_RANGES
) -> DataFrame:
    """The same from lines that are parsed."""
    trips = as_columns(good.select("timestamp", "observations"), TRIP_COLUMNS)
    trips = range_filter(trips, spec)
    if model is not None:
        trips = bloom_filter(trips, model, "taxi_identifier")
    return annotate(trips, metadata)


class FlowSinks(NamedTuple):
    """Where a flow leaves its results: the current trip of each key, trips as files of batches, lines
    that did not parse, and messages. The outbox belongs to one checkpoint."""

    table: str
    files: str
    dead: str
    outbox: str


FLOW_KEYS, FLOW_ORDER = ("hack_license", "taxi_identifier"), ("timestamp", "msg_id")


def into_sinks(
    sinks: FlowSinks, metadata: DataFrame, model: BloomModel | None = None, spec: str = TRIP_RANGES, batch_rows: int = 500
) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch`` over parsed lines: clean them once, and give them to every sink.

    Each sink takes an epoch once, so an epoch that is replayed because one of them failed is completed,
    and the query's checkpoint is the commit they share.
    """
    def write(rows: DataFrame, epoch: int) -> None:
        run, outbox = query_id(rows), FileOutbox(sinks.outbox)
        rows.persist()
        good, bad = split_bad(rows)
        trips = clean_parsed(good, metadata, model, spec).withColumn("msg_id", F.col("msg_id").cast("bigint")).persist()
        try:
            upsert(trips, sinks.table, epoch, FLOW_KEYS, FLOW_ORDER, run)
            files = trips.select(
                F.floor(F.col("msg_id") / batch_rows).alias("batch_id"),
                F.concat(F.lit("f"), F.col("msg_id").cast("string")).alias("filename"), "fare_amount", "taxi_company",
            )
            write_batches(files, sinks.files, conflict="replace", run=run, epoch=epoch)
            letters = bad.select(
                F.lit(epoch).cast("bigint").alias("batch_id"), F.expr("uuid()").alias("filename"), F.col("bad_line").alias("line")
            )
            write_batches(letters, sinks.dead, unique=True, run=run, epoch=epoch)
            sent = messages(trips.withColumn("id", F.col("msg_id").cast("string")), "trips/{payment_type}", "id")
            outbox.release(epoch, put_messages(sent, partial(FileOutbox, sinks.outbox)))
        finally:
            trips.unpersist()
            rows.unpersist()

    return write


def clean_and_impute(
    lines: DataFrame, metadata: DataFrame, model: BloomModel, window: int, spec: str
) -> DataFrame:
    """The same with missing surcharges filled before the metadata is joined.

    Lines are prefixed by their taxi, so its rows are counted without parsing.
    """
    sizes = lines.groupBy(F.substring_index("line", ",", 1).alias("taxi_identifier")).agg(
        F.count("*").alias("rows")
    )
    good, _ = split_bad(senml_parse(lines))
    trips = as_columns(good.select("timestamp", "observations"), TRIP_COLUMNS)
    trips = trips.withColumn("msg_id", trips["msg_id"].cast("bigint"))
    trips = bloom_filter(range_filter(trips, spec), model, "taxi_identifier")
    return annotate(impute_mean(trips, "surcharge", window, sizes=sizes), metadata)


def confirmed_batches(
    files: DataFrame, stored: DataFrame, label: str, size: int = 10
) -> DataFrame:
    """Batches that hold the label and whose full set was stored before the verdict.

    ``files`` has (batch_id, content, arrival); ``stored`` has (batch_id, arrival).
    """
    verdicts = batch_has_label(files, label).join(
        files.groupBy("batch_id").agg({"arrival": "max"}).withColumnRenamed("max(arrival)", "arrival"),
        "batch_id",
    )
    return join_batch_exists(verdicts, batch_gate(stored, size))
