"""Queue sources and the decoding of what they carry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluiceway.functions.frames import unpack_envelope, unpack_frame


def kafka_source(
    spark: SparkSession, servers: str, topic: str, stream: bool = True, **options: str
) -> DataFrame:
    """Topic rows from the earliest offset; needs the Kafka connector on the classpath."""
    reader = spark.readStream if stream else spark.read
    return (
        reader.format("kafka")
        .options(**{"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": "earliest"})
        .options(**options)
        .load()
    )


def decode_envelopes(df: DataFrame, value: str = "value") -> DataFrame:
    """JSON envelopes to ``attributes`` and ``content``."""
    kept = [c for c in df.columns if c != value]
    return df.withColumn("_e", unpack_envelope(F.col(value))).select(*kept, "_e.*")


def decode_frames(df: DataFrame, value: str = "value", offset: str = "offset") -> DataFrame:
    """Binary frames to id, topic type, payload; the message id is the queue offset.

    A topic type that mentions ``entry`` reads ``entry``, any other ``exit``.
    """
    kept = [c for c in df.columns if c not in (value, offset)]
    frame = F.col("_f")
    return df.withColumn("_f", unpack_frame(F.col(value))).select(
        *kept,
        frame["id"].alias("id"),
        F.when(frame["topic_type"].contains("entry"), "entry").otherwise("exit").alias("topic_type"),
        F.col(offset).cast("string").alias("msg_id"),
        frame["payload"].alias("payload"),
    )
