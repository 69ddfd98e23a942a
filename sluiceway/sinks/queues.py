"""Queue sinks: what is sent, and the send itself."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluiceway.functions.frames import pack_envelope, pack_frame


def encode_envelopes(
    df: DataFrame, key: str | None = None, attributes: str = "attributes", content: str = "content"
) -> DataFrame:
    """(key, value): the JSON envelope under the row's key, or a random one."""
    label = F.col(key).cast("string") if key else F.expr("uuid()")
    return df.select(label.alias("key"), pack_envelope(F.col(attributes), F.col(content)).alias("value"))


def encode_frames(
    df: DataFrame, frame_id: str = "id", topic_type: str = "topic_type", payload: str = "payload"
) -> DataFrame:
    """(key, value): the binary frame."""
    return df.select(
        F.col(frame_id).cast("string").alias("key"),
        pack_frame(F.col(frame_id), F.col(topic_type), F.col(payload)).alias("value"),
    )


def kafka_sink(messages: DataFrame, servers: str, topic: str, checkpoint: str | None = None, **options: str):
    """Send (key, value) rows; a stream gives back its query. Needs the Kafka connector."""
    settings = {"kafka.bootstrap.servers": servers, "topic": topic, "kafka.acks": "all", **options}
    if messages.isStreaming:
        return (
            messages.writeStream.format("kafka").options(**settings)
            .option("checkpointLocation", checkpoint).start()
        )
    return messages.write.format("kafka").options(**settings).save()
