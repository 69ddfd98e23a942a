"""Queue payloads: the JSON envelope and the binary frame."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sluiceway.schemas import ENVELOPE


def pack_envelope(attributes: Column, content: Column) -> Column:
    """``{"attributes": {...}, "content": "..."}``."""
    return F.to_json(F.struct(attributes.alias("attributes"), content.alias("content")))


def unpack_envelope(value: Column) -> Column:
    return F.from_json(value.cast("string"), ENVELOPE)


def _big_endian(value: Column, size: int) -> Column:
    digits = 2 * size
    return F.unhex(F.substring(F.lpad(F.hex(value), digits, "0"), -digits, digits))


def pack_frame(frame_id: Column, topic_type: Column, payload: Column) -> Column:
    """int64 id, int32 byte length of the topic type, topic type, payload."""
    name = F.encode(topic_type, "UTF-8")
    return F.concat(
        _big_endian(frame_id.cast("bigint"), 8),
        _big_endian(F.octet_length(name).cast("bigint"), 4),
        name,
        payload,
    )


def _as_long(part: Column) -> Column:
    # conv gives the unsigned reading; the upper half of int64 is negative
    unsigned = F.conv(F.hex(part), 16, 10).cast("decimal(20,0)")
    wrapped = F.when(
        unsigned > F.lit(2**63 - 1), unsigned - F.lit(str(2**64)).cast("decimal(20,0)")
    ).otherwise(unsigned)
    return wrapped.cast("bigint")


def unpack_frame(value: Column) -> Column:
    """STRUCT<id, topic_type, payload> of a frame."""
    size = F.conv(F.hex(F.substring(value, 9, 4)), 16, 10).cast("int")
    return F.struct(
        _as_long(F.substring(value, 1, 8)).alias("id"),
        F.decode(F.substring(value, F.lit(13), size), "UTF-8").alias("topic_type"),
        F.substring(value, size + 13, F.octet_length(value)).alias("payload"),
    )
