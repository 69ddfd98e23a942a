"""Message assembly, annotation and batch joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluiceway.operators.sequence import BROADCAST_BYTES, lookup
from sluiceway.schemas import TRIP_FIELDS


def field_aggregates(
    fields: Sequence[str], name: str, value: str, seq: str, meta: Sequence[str] = ()
) -> list[Column]:
    """Per field its latest value, plus ``_seen``: how many fields have arrived.

    ``meta`` fields are columns of every piece instead of pieces. Every piece
    folds into a fixed-size buffer before the shuffle, so neither duplicates nor
    a message with very many pieces gather anywhere.
    """
    def latest(f: str) -> Column:
        if f in meta:
            return F.max(f)
        mine = F.col(name) == f
        return F.max_by(F.when(mine, F.col(value)), F.when(mine, F.col(seq)))

    def arrived(f: str) -> Column:
        here = F.col(f).isNotNull() if f in meta else F.col(name) == f
        return F.coalesce(F.bool_or(here), F.lit(False)).cast("int")

    seen = sum((arrived(f) for f in fields), F.lit(0))
    return [*[latest(f).alias(f) for f in fields], seen.alias("_seen")]


def joined_text(fields: Sequence[str], separator: str = "@") -> Column:
    """Values in schema order; a missing one reads ``null``."""
    return F.concat_ws(separator, *[F.coalesce(F.col(f).cast("string"), F.lit("null")) for f in fields])


def assemble_message(
    pieces: DataFrame,
    fields: Sequence[str] = TRIP_FIELDS,
    expected: int | None = None,
    msg_id: str = "msg_id",
    name: str = "obs_type",
    value: str = "obs_val",
    seq: str = "seq",
    meta: Sequence[str] = (),
) -> DataFrame:
    """Gather the pieces of a message; rows appear once ``expected`` fields have arrived.

    A repeated piece replaces the earlier one. Fields named in ``meta`` (such as
    ``schemas.META_FIELDS``) come as columns of the pieces. ``joined_value``
    holds the values in schema order.
    """
    expected = len(fields) if expected is None else expected
    return (
        pieces.groupBy(msg_id)
        .agg(*field_aggregates(fields, name, value, seq, meta))
        .where(F.col("_seen") >= expected)
        .drop("_seen")
        .withColumn("joined_value", joined_text(fields))
    )


def last_per_key(metadata: DataFrame, key: str, line_no: str | None) -> DataFrame:
    """The last line of a key counts; without line numbers keys must be unique."""
    if line_no is None:
        return metadata.dropDuplicates([key])
    rest = [c for c in metadata.columns if c not in (key, line_no)]
    return (
        metadata.groupBy(key)
        .agg(F.max_by(F.struct(*rest), line_no).alias("_last"))
        .select(key, "_last.*")
    )


def annotate(
    df: DataFrame,
    metadata: DataFrame,
    key: str = "taxi_identifier",
    line_no: str | None = None,
    max_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Append the metadata columns of the row's key; unmatched rows stay."""
    return lookup(df, last_per_key(metadata, key, line_no), key, "left", max_bytes)


def read_annotations(lines: DataFrame, line: str = "value") -> DataFrame:
    """``key:value`` lines to (key, annotation)."""
    parts = F.split(line, ":")
    return lines.where(F.size(parts) >= 2).select(
        *[c for c in lines.columns if c != line],
        F.get(parts, F.lit(0)).alias("key"), F.get(parts, F.lit(1)).alias("annotation"),
    )


def annotate_text(
    df: DataFrame,
    annotations: DataFrame,
    joined: str = "joined_value",
    field: int = 0,
    line_no: str | None = None,
    max_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Text form: look up field ``field`` of the ``@``-joined value, append, use commas."""
    keyed = df.withColumn("key", F.get(F.split(joined, "@", -1), F.lit(field)))
    matched = lookup(keyed, last_per_key(annotations, "key", line_no), "key", "left", max_bytes)
    return matched.withColumn(
        joined, F.concat_ws(",", F.translate(joined, "@", ","), F.translate("annotation", "@", ","))
    ).drop("key", "annotation")


def join_batch_exists(
    left: DataFrame, right: DataFrame, batch: str = "batch_id", arrival: str = "arrival"
) -> DataFrame:
    """Left rows whose batch was already seen on the right when they arrived."""
    first = right.groupBy(batch).agg(F.min(arrival).alias("_first"))
    mine, theirs = left.alias("l"), first.alias("r")
    return mine.join(
        theirs,
        (F.col(f"l.{batch}") == F.col(f"r.{batch}")) & (F.col("r._first") < F.col(f"l.{arrival}")),
        "left_semi",
    )


def join_batch_complete(
    items: DataFrame, requests: DataFrame, size: int, batch: str = "batch_id"
) -> DataFrame:
    """All items of the requested batches that hold at least ``size`` items."""
    complete = items.groupBy(batch).agg(F.count("*").alias("_n")).where(F.col("_n") >= size)
    wanted = complete.join(requests.select(batch), batch, "left_semi").select(batch)
    return items.join(wanted, batch, "left_semi")


def join_batch_lookup(requests: DataFrame, store: DataFrame, batch: str = "batch_id") -> DataFrame:
    """The stored rows of each requested batch; a repeated request counts once."""
    return requests.select(batch).distinct().join(store, batch)


def link_transport(wires: DataFrame, placement: DataFrame, visibility: DataFrame) -> DataFrame:
    """How data travels along each wire (src, dst), given (stage, device) and (src, dst, visible).

    LOCAL on one device; PUSH where the source sees the destination; PULL where
    only the destination sees the source; BROKER otherwise. UNPLACED if an end has no device.
    """
    sees = visibility.where("visible")
    placed = lookup(
        wires, placement.select(F.col("stage").alias("src"), F.col("device").alias("src_device")), "src", "left"
    )
    placed = lookup(
        placed, placement.select(F.col("stage").alias("dst"), F.col("device").alias("dst_device")), "dst", "left"
    )
    forward = sees.select(
        F.col("src").alias("src_device"), F.col("dst").alias("dst_device"), F.lit(True).alias("_push")
    )
    backward = sees.select(
        F.col("dst").alias("src_device"), F.col("src").alias("dst_device"), F.lit(True).alias("_pull")
    )
    ends = ["src_device", "dst_device"]
    seen = lookup(lookup(placed, forward, ends, "left"), backward, ends, "left")
    transport = (
        F.when(F.col("src_device").isNull() | F.col("dst_device").isNull(), "UNPLACED")
        .when(F.col("src_device") == F.col("dst_device"), "LOCAL")
        .when(F.col("_push"), "PUSH")
        .when(F.col("_pull"), "PULL")
        .otherwise("BROKER")
    )
    return seen.withColumn("transport", transport).drop("_push", "_pull")
