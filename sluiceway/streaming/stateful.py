"""Keyed state on streams: message assembly, batch gate, imputation, semi join, first arrivals.

All state leaves by event time.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sluiceway.operators.joins import joined_text
from sluiceway.schemas import TRIP_FIELDS
from sluiceway.streaming.assembly import Assembly, dealt, unpacked
from sluiceway.streaming.timers import GATHERED, Imputation, pack, unpack

#: Buckets that keys are dealt to: one call of Python a trigger for all keys of a bucket.
BUCKETS, MESSAGE_BUCKETS = 256, 32
NO_TIME, NEVER = -1 << 62, 1 << 62


def _timed(rows: DataFrame, event_time: str, delay: str) -> DataFrame:
    """Watermarked rows with their event time in milliseconds; rows without a time count as the oldest."""
    ms = F.coalesce(F.unix_millis(F.col(event_time).cast("timestamp")), F.lit(0))
    return rows.withColumn("_ms", ms).withWatermark(event_time, delay)


def _keyed(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` with the key as text in ``_key``: a null among whole numbers would turn all of a frame to floats."""
    return rows.withColumn("_key", F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit("")))


def _bucketed(rows: DataFrame, buckets: int) -> DataFrame:
    return rows.withColumn("_bucket", F.pmod(F.xxhash64("_key"), F.lit(buckets)).cast("int"))


def _whole(rows: DataFrame, order: Sequence[str] = ()) -> tuple[DataFrame, list[str], list[str]]:
    """``rows`` whose whole numbers are 0 where they were null, with a flag each, as a null among them would turn all
    of a frame to floats; the names of the flags; and the columns that sort by ``order``, nulls last."""
    numbers = [f.name for f in rows.schema if isinstance(f.dataType, T.IntegralType)]
    flags = {f"_null_{n}": F.col(n).isNull() for n in numbers}
    zeros = {n: F.coalesce(F.col(n), F.lit(0).cast(rows.schema[n].dataType)) for n in numbers}
    by = [c for o in order for c in ([f"_null_{o}", o] if o in numbers else [o])]
    return rows.withColumns(flags).withColumns(zeros), list(flags), by


def _nulled(rows: DataFrame, names: Sequence[str], flags: Sequence[str]) -> DataFrame:
    """The columns ``names`` with the nulls that ``_whole`` took out."""
    return rows.select(*[F.when(~F.col(f"_null_{n}"), F.col(n)).alias(n) if f"_null_{n}" in flags else n for n in names])


def _with_flags(schema: T.StructType, flags: Sequence[str]) -> T.StructType:
    return T.StructType([*schema.fields, *[T.StructField(f, T.BooleanType()) for f in flags]])


def _reduced(rows: DataFrame, keys: Sequence[str], order: Sequence[str], keep: str) -> DataFrame:
    """One row for each key and Arrow batch, before the shuffle: a hot key ships a few rows per task."""
    def reduce(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.sort_values(list(order), kind="stable").drop_duplicates(list(keys), keep=keep)

    return rows.mapInPandas(reduce, rows.schema)


def message_join(
    pieces: DataFrame,
    fields: Sequence[str] = TRIP_FIELDS,
    expected: int | None = None,
    event_time: str = "event_time",
    delay: str = "10 minutes",
    within: str = "1 hour",
    msg_id: str = "msg_id",
    name: str = "obs_type",
    value: str = "obs_val",
    seq: str = "seq",
    meta: Sequence[str] = (),
    buckets: int = MESSAGE_BUCKETS,
) -> DataFrame:
    """Assemble messages from a stream of pieces, each with a time of its own.

    Pieces of a message meet while each follows another of them ``within`` that time. The message leaves once,
    when the watermark has passed that long without a piece: with ``complete`` if ``expected`` fields came,
    else without. Of a field the piece with the largest ``seq`` counts. Pieces are folded in the tasks that read
    them and dealt to ``buckets``; state is their packed pieces. A trigger writes what it brings and reads back only
    what the watermark has reached, of a bucket at once: set ``buckets`` to the open messages over about 100,000.
    """
    expected = len(fields) if expected is None else expected
    places = F.coalesce(*[F.when(F.col(name) == f, F.lit(i)) for i, f in enumerate(fields) if f not in meta], F.lit(-1))
    ends = F.col(event_time) + F.expr(f"INTERVAL {within}")
    parts = _bucketed(_keyed(pieces.withWatermark(event_time, delay), msg_id), buckets).select(
        "_bucket", "_key", F.unix_micros(F.col(event_time).cast("timestamp")).alias("_start"),
        F.unix_micros(ends.cast("timestamp")).alias("_end"), places.alias("_field"),
        F.col(value).alias("_value"), F.col(seq).alias("_seq"), *meta,
    ).where("_end > _start")
    packed = parts.mapInArrow(dealt(buckets, len(fields), tuple(meta)), "_bucket int, _rows binary")
    gathered = packed.groupBy("_bucket").transformWithStateInPandas(
        Assembly(fields, expected, meta), "_rows binary", "Append", "eventTime"
    )
    kinds = [T.StructField(f, pieces.schema[f if f in meta else value].dataType) for f in fields]
    out = T.StructType([T.StructField("_key", T.StringType()), *kinds, T.StructField("complete", T.BooleanType())])
    ids = F.when(F.col("_key") != "", F.expr("substr(_key, 2)")).cast(pieces.schema[msg_id].dataType)
    return gathered.mapInArrow(unpacked, out).select(
        ids.alias(msg_id), *fields, "complete", joined_text(fields).alias("joined_value")
    )


def early_messages(
    pieces: DataFrame,
    fields: Sequence[str] = TRIP_FIELDS,
    expected: int | None = None,
    event_time: str = "event_time",
    delay: str = "10 minutes",
    within_ms: int = 3_600_000,
    msg_id: str = "msg_id",
    name: str = "obs_type",
    value: str = "obs_val",
    seq: str = "seq",
    meta: Sequence[str] = (),
) -> DataFrame:
    """``message_join`` for those who cannot wait: a message leaves in the trigger that completes it.

    It leaves with ``complete`` as soon as ``expected`` fields have come, or without it
    ``within_ms`` after the time of the pieces that came first. Of a field the piece with the largest ``seq``
    counts. What is sent again to a message that has left is swallowed until its timer has passed. Each
    message is a call of Python in each trigger that touches it; ``message_join`` has one for each bucket of messages.
    """
    expected = len(fields) if expected is None else expected
    columns = [msg_id, event_time, name, value, seq, *meta]
    parts = pieces.select(*columns).withColumn(value, F.col(value).cast("string")).withColumn(seq, F.col(seq).cast("bigint"))
    parts = _reduced(_keyed(parts, msg_id).drop(msg_id), ["_key", name, *meta], [seq, value], "last")
    parts = _timed(parts, event_time, delay)
    out = T.StructType([T.StructField("_key", T.StringType())] + [T.StructField(f, T.StringType()) for f in fields])
    out = out.add("complete", "boolean").add("joined_value", "string")

    def row(key: str, pieces: dict, complete: bool) -> pd.DataFrame:
        values = {f: pieces[f][1] if f in pieces else None for f in fields}
        text = "@".join("null" if v is None else v for v in values.values())
        return pd.DataFrame({"_key": [key], **{f: [v] for f, v in values.items()}, "complete": [complete], "joined_value": [text]})

    def gather(key: Any, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        names, values, seqs, until, left = state.get if state.exists else ((), (), (), None, False)
        found = {n: (s, v) for n, v, s in zip(names, values, seqs)}
        if state.hasTimedOut:
            state.remove()
            if not left:
                yield row(key[0], found, False)
            return
        was_left, earliest = left, None
        for frame in frames:
            if was_left:
                continue
            for column in meta:
                for own in frame[column].dropna().astype(str):
                    if column not in found or own > found[column][1]:
                        found[column] = (0, own)
            for field, own, n, ms in zip(*(frame[c].tolist() for c in (name, value, seq, "_ms"))):
                earliest = ms if earliest is None else min(earliest, ms)
                if field in wanted:
                    piece = (-1 if pd.isna(n) else int(n), None if pd.isna(own) else own)
                    if field not in found or (piece[0], piece[1] or "") > (found[field][0], found[field][1] or ""):
                        found[field] = piece
        watermark = state.getCurrentWatermarkMs()
        if until is None:
            until = max(int(earliest), watermark) + within_ms
        left = was_left or len(found) >= expected
        kept = [] if left else list(found)
        state.update((kept, [found[n][1] for n in kept], [found[n][0] for n in kept], until, left))
        state.setTimeoutTimestamp(max(until, watermark + 1))
        if left and not was_left:
            yield row(key[0], found, True)

    wanted = frozenset(fields) - frozenset(meta)
    found = parts.groupBy("_key").applyInPandasWithState(
        gather, out, "names array<string>, vals array<string>, seqs array<bigint>, until bigint, left boolean",
        "append", GroupStateTimeout.EventTimeTimeout,
    )
    ids = F.when(F.col("_key") != "", F.expr("substr(_key, 2)")).cast(pieces.schema[msg_id].dataType)
    return found.select(ids.alias(msg_id), *found.columns[1:])


def batch_gate(
    items: DataFrame,
    size: int = 10,
    batch: str = "batch_id",
    order: str = "arrival",
    event_time: str = "event_time",
    delay: str = "10 minutes",
    idle_ms: int = 86_400_000,
    buckets: int = BUCKETS,
) -> DataFrame:
    """The item that brings its batch to ``size``; later items are swallowed.

    State is a count per batch, kept in one table for each of ``buckets``; a batch is dropped once the watermark is
    ``idle_ms`` past its last item. Of a trigger only the first items of each batch, up to the gate, are held.
    """
    names = items.schema.names
    timed = _keyed(items, batch).withColumn("_ms", F.coalesce(F.unix_millis(F.col(event_time).cast("timestamp")), F.lit(NO_TIME)))
    # the key is taken before its nulls become zeros
    rows, flags, by = _whole(timed, [order])
    flags = [f for f in flags if f != "_null__ms"]
    rows = _bucketed(rows.drop("_null__ms"), buckets).withWatermark(event_time, delay)
    out = _with_flags(items.schema, flags)

    def first_rows(rows: pd.DataFrame, seen: pd.Series) -> pd.DataFrame:
        """Of each batch the rows up to the gate, with ``_left``: how many more it needs from each on."""
        rows = rows.sort_values(["_key", *by], kind="stable")
        place = rows.groupby("_key", sort=False).cumcount()
        need = size - rows["_key"].map(seen).fillna(0).astype("int64")
        return rows.assign(_left=need - place)[(place < need).to_numpy()]

    def gate(key: Any, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        watermark = state.getCurrentWatermarkMs()
        if state.exists:
            known = unpack(bytes(state.get[0])).set_index("_key")
        else:
            known = pd.DataFrame({"seen": 0, "until": 0}, index=pd.Index([], dtype=object, name="_key"), dtype="int64")
        first, touched = None, []
        if not state.hasTimedOut:
            held, n = [], 0

            def fold(rows: pd.DataFrame) -> pd.DataFrame:
                return first_rows(rows if first is None else pd.concat([first, rows], ignore_index=True), known["seen"])

            for frame in frames:
                found = frame.groupby("_key")["_ms"]
                touched.append(pd.DataFrame({"seen": found.size(), "until": found.max()}))
                held.append(frame)
                n += len(frame)
                if n >= max(GATHERED, 0 if first is None else len(first)):
                    first, held, n = fold(pd.concat(held, ignore_index=True)), [], 0
            if n:
                first = fold(pd.concat(held, ignore_index=True))
        stays = known["until"] >= watermark
        if touched:
            own = pd.concat(touched).groupby(level=0).agg({"seen": "sum", "until": "max"}).rename_axis("_key")
            own["seen"] += known["seen"].reindex(own.index).fillna(0).astype("int64")
            latest = own["until"].to_numpy()
            own["until"] = np.where(latest == NO_TIME, NEVER, np.maximum(latest, watermark) + idle_ms)
            known = pd.concat([known[stays & ~known.index.isin(own.index)], own])
        else:
            known = known[stays]
        if len(known):
            state.update((pack(known.reset_index()),))
            if known["until"].min() < NEVER:
                state.setTimeoutTimestamp(max(int(known["until"].min()), watermark + 1))
        elif state.exists:
            state.remove()
        if first is not None:
            yield first[first["_left"] == 1][out.names]

    gated = rows.groupBy("_bucket").applyInPandasWithState(gate, out, "batches binary", "append", GroupStateTimeout.EventTimeTimeout)
    return _nulled(gated, names, flags)


def impute_mean(
    readings: DataFrame,
    field: str,
    window: int,
    sensor: str = "taxi_identifier",
    order: Sequence[str] = ("msg_id",),
    output: str = "imputed",
    event_time: str = "event_time",
    delay: str = "10 minutes",
    slot_ms: int = 60_000,
    idle_ms: int = 86_400_000,
    buckets: int = BUCKETS,
) -> DataFrame:
    """Fill missing readings from the sensor's last ``window`` readings in event time.

    Rows wait until the watermark has passed their time slot and are then taken in the order of
    (event time, ``order``), whatever trigger they came in. Slots of ``slot_ms`` bound what is sorted at once: a slot
    of one of the ``buckets`` that sensors are dealt to. A sensor's history is forgotten ``idle_ms`` after its last slot.
    """
    if window < 1:
        return readings.withColumn(output, F.col(field).cast("double"))
    own = readings.schema
    keyed = _keyed(readings, sensor).withColumn("_value", F.col(field).cast("double"))
    rows, flags, by = _whole(keyed, order)
    timed = _bucketed(_timed(rows, event_time, delay), buckets)
    schema = _with_flags(own, flags).add(output, "double")
    filled = timed.groupBy("_bucket").transformWithStateInPandas(
        Imputation(window, by, output, timed.columns, schema.names, slot_ms, idle_ms), schema, "Append", "eventTime"
    )
    return _nulled(filled, [*own.names, output], flags)


def semi_join(
    left: DataFrame,
    right: DataFrame,
    batch: str = "batch_id",
    event_time: str = "event_time",
    delay: str = "10 minutes",
    within: str = "1 hour",
) -> DataFrame:
    """Left rows whose batch arrived on the right before them, at most ``within`` earlier."""
    mine = left.withWatermark(event_time, delay).alias("l")
    theirs = right.select(F.col(batch).alias("_batch"), F.col(event_time).alias("_time")).withWatermark(
        "_time", delay
    ).alias("r")
    earlier = F.expr(f"r._time < l.{event_time} AND r._time >= l.{event_time} - INTERVAL {within}")
    return mine.join(theirs, (F.col(f"l.{batch}") == F.col("r._batch")) & earlier, "left_semi")


def dedup_batch(
    items: DataFrame,
    batch: str = "batch_id",
    event_time: str = "event_time",
    delay: str = "1 hour",
    order: Sequence[str] = (),
    within: str = "1 day",
) -> DataFrame:
    """The first item of each batch by (event time, ``order``), whole; it leaves when the watermark has passed
    ``within`` without an item of the batch, and the batch is forgotten."""
    first = F.min_by(F.struct(*items.columns), F.struct(event_time, *order))
    return (
        items.withWatermark(event_time, delay)
        .groupBy(F.col(batch).alias("_batch"), F.session_window(event_time, within).alias("_open"))
        .agg(first.alias("_first")).select("_first.*")
    )


def windowed(
    readings: DataFrame, field: str, length: str, slide: str | None = None,
    by: Sequence[str] = (), event_time: str = "event_time", delay: str = "10 minutes",
) -> DataFrame:
    """Count and mean per event-time window; late rows are those behind the watermark."""
    bounds = F.window(event_time, length, slide) if slide else F.window(event_time, length)
    return (
        readings.withWatermark(event_time, delay).groupBy(bounds, *by)
        .agg(F.count("*").alias("readings"), F.avg(field).alias("mean"))
        .select(F.col("window.start").alias("window_start"), *by, "readings", "mean")
    )
