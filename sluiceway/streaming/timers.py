"""Readings in the order of their event times, whatever order they come in.

The processor runs under ``transformWithStateInPandas``, which needs the RocksDB state store
(``session.SETTINGS`` and ``runs.state_partitions`` choose it). Rows carry ``_bucket``, the bucket their key
is dealt to, ``_key``, their key as text, ``_ms``, their event time in epoch milliseconds, and ``_value``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Rows of a bucket that are split by slot, or sorted, at once.
GATHERED = 100_000


def pack(rows: pd.DataFrame) -> bytes:
    """Rows as an Arrow stream."""
    batch = pa.RecordBatch.from_pandas(rows, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def named(rows: Iterator[pd.DataFrame], columns: Sequence[str]) -> Iterator[pd.DataFrame]:
    """Frames under their own column names: Spark hands names that Python could not use on as numbers."""
    for frame in rows:
        yield frame.set_axis(list(columns), axis=1)


def unpack(data: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(data).read_pandas()


def gathered(frames: Iterator[pd.DataFrame], rows: int = GATHERED) -> Iterator[pd.DataFrame]:
    """The frames in larger ones of about ``rows`` rows."""
    held, n = [], 0
    for frame in frames:
        held.append(frame)
        n += len(frame)
        if n >= rows:
            yield pd.concat(held, ignore_index=True)
            held, n = [], 0
    if n:
        yield pd.concat(held, ignore_index=True)


def last_means(owner: np.ndarray, values: np.ndarray, window: int) -> np.ndarray:
    """For each row the mean of its owner's last ``window`` values up to it that are numbers, NaN without one.
    Rows of an owner lie side by side."""
    at = np.flatnonzero(~np.isnan(values))
    out = np.full(len(values), np.nan)
    if not len(at):
        return out
    known, whose = values[at], owner[at]
    place = np.arange(len(at))
    first = np.maximum.accumulate(np.where(np.append(True, whose[1:] != whose[:-1]), place, 0))
    since = np.maximum(first, place - window + 1)
    sums = np.add.reduceat(np.append(known, 0.0), np.stack([since, place + 1], axis=1).ravel())[::2]
    means = sums / (place + 1 - since)
    latest = np.searchsorted(at, np.arange(len(values)), side="right") - 1
    mine = (latest >= 0) & (whose[latest] == owner)
    out[mine] = means[latest[mine]]
    return out


def last_known(owner: np.ndarray, values: np.ndarray, window: int) -> np.ndarray:
    """Places of each owner's last ``window`` values that are numbers."""
    at = np.flatnonzero(~np.isnan(values))[::-1]
    if not len(at):
        return at
    whose, place = owner[at], np.arange(len(at))
    first = np.maximum.accumulate(np.where(np.append(True, whose[1:] != whose[:-1]), place, 0))
    return at[place - first < window][::-1]


class Imputation(StatefulProcessor):
    """Fills the missing readings of the sensors of a bucket in the order of their event times.

    Rows wait in time slots, each in pieces as they came (a map by slot and piece), until the
    watermark passes the end of the slot. Then the slot is sorted and filled from each sensor's last
    ``window`` readings. At most one slot of one bucket, or small ones together, and the histories of its
    sensors are in memory.
    """

    def __init__(
        self, window: int, order: Sequence[str], output: str, columns: Sequence[str], out: Sequence[str], slot_ms: int, idle_ms: int
    ):
        self.window, self.order, self.output = window, ["_ms", *order], output
        self.columns, self.out, self.slot_ms, self.idle_ms = list(columns), list(out), slot_ms, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.slots = handle.getValueState("slots", "starts array<bigint>, pieces array<int>")
        self.waiting = handle.getMapState("waiting", "slot bigint, piece int", "rows binary")
        # of each sensor its last slot that waits and when it is forgotten; its last readings, oldest first
        self.sensors = handle.getValueState("sensors", "sensors binary, readings binary")

    def _open(self) -> dict[int, int]:
        return dict(zip(*(self.slots.get() or ((), ()))))

    def _known(self) -> tuple[pd.DataFrame, pd.DataFrame]:
        found = self.sensors.get()
        if found:
            return tuple(unpack(bytes(part)).set_index("_key").copy() for part in found)
        none = pd.Index([], dtype=object, name="_key")
        return pd.DataFrame({"open": 0, "until": 0}, index=none, dtype="int64"), pd.DataFrame({"value": 0.0}, index=none)

    def _keep(self, sensors: pd.DataFrame, readings: pd.DataFrame) -> None:
        self.sensors.update((pack(sensors.reset_index()), pack(readings.reset_index())))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        slots, opened = self._open(), []
        for frame in gathered(named(rows, self.columns)):
            starts = frame["_ms"] // self.slot_ms * self.slot_ms
            opened.append(starts.groupby(frame["_key"]).max())
            for slot, part in frame.groupby(starts):
                slot = int(slot)
                if slot not in slots:
                    self.handle.registerTimer(slot + self.slot_ms)
                self.waiting.updateValue((slot, slots.get(slot, 0)), (pack(part),))
                slots[slot] = slots.get(slot, 0) + 1
        self.slots.update((list(slots), list(slots.values())))
        sensors, readings = self._known()
        if opened:
            never = np.iinfo("int64").min
            new = pd.concat(opened).groupby(level=0).max().rename("open").to_frame().assign(until=never)
            self._keep(pd.concat([sensors, new]).groupby(level=0).max().rename_axis("_key"), readings)
        return iter(())

    def _filled(self, rows: pd.DataFrame, readings: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
        """The rows of a slot with their output, and what the sensors go on from."""
        sensors, names = pd.factorize(np.concatenate([readings.index.to_numpy(object), rows["_key"].to_numpy(object)]))
        rows = rows.assign(_sensor=sensors[len(readings):]).sort_values(["_sensor", *self.order], kind="stable")
        owner = np.concatenate([sensors[:len(readings)], rows["_sensor"].to_numpy()])
        values = np.concatenate([readings["value"].to_numpy(), rows["_value"].to_numpy("float64")])
        # the readings kept come before the sensor's rows
        by_owner = np.argsort(owner, kind="stable")
        means = np.empty(len(values))
        means[by_owner] = last_means(owner[by_owner], values[by_owner], self.window)
        filled = np.where(np.isnan(values), means, values)[len(readings):]
        kept = by_owner[last_known(owner[by_owner], values[by_owner], self.window)]
        index = pd.Index(names[owner[kept]], dtype=object, name="_key")
        return rows.assign(**{self.output: filled}), pd.DataFrame({"value": values[kept]}, index)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark, slots = timerValues.getCurrentWatermarkInMs(), self._open()
        due = sorted(s for s in slots if s + self.slot_ms <= watermark)
        sensors, readings = self._known()
        held, n = [], 0
        for slot in due:
            for piece in [(slot, i) for i in range(slots.pop(slot))]:
                held.append(unpack(bytes(self.waiting.getValue(piece)[0])))
                self.waiting.removeKey(piece)
                n += len(held[-1])
                sensors.loc[held[-1]["_key"].unique(), "until"] = slot + self.slot_ms + self.idle_ms
            # small slots are sorted together
            if n >= GATHERED or slot == due[-1]:
                filled, readings = self._filled(pd.concat(held, ignore_index=True), readings)
                held, n = [], 0
                yield filled[self.out]
        if due:
            self.slots.update((list(slots), list(slots.values())))
        # whoever has rows waiting is not idle
        idle = (sensors["until"] <= watermark) & (sensors["open"] + self.slot_ms <= watermark)
        if due or idle.any():
            sensors = sensors[~idle]
            self._keep(sensors, readings[readings.index.isin(sensors.index)])
            later = sensors["until"][sensors["until"] > watermark]
            if len(later):
                self.handle.registerTimer(int(later.min()))

    def close(self) -> None:
        pass
