"""Messages from pieces in buckets of keys, as packed Arrow tables.

Pieces travel packed: a task deals what it reads to buckets and ships one Arrow stream a bucket, the processor keeps
these streams as they came, and messages leave it packed. So a trigger writes what it brings and reads back only what
the watermark has reached, and no column passes pandas (nulls among whole numbers stay nulls).

A table of pieces has the columns ``_key`` (the message's id as text), ``_start`` and ``_end`` (microseconds: the piece's
time, and until when another is waited for), ``_field`` (place of the piece's field, -1 if it is none), ``_value``,
``_seq`` and the ``meta`` columns. Folded, a row stands for several pieces and has the bounds of their session.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Pieces that a task deals, or a bucket keeps in one stream, at once.
GATHERED = 500_000
NEVER = -1 << 62


def pack(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as writer:
        writer.write_table(rows)
    return sink.getvalue().to_pybytes()


def unpack(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of packed tables in column ``_rows``."""
    for batch in batches:
        for data in batch["_rows"]:
            yield from unpack(data.as_py()).to_batches(max_chunksize=10_000)


def _gathered(parts: Iterator[pa.Table]) -> Iterator[pa.Table]:
    held, n = [], 0
    for part in parts:
        held.append(part)
        n += part.num_rows
        if n >= GATHERED:
            yield pa.concat_tables(held)
            held, n = [], 0
    if n:
        yield pa.concat_tables(held)


def _ranks(column: pa.ChunkedArray) -> np.ndarray:
    """The dense rank of each value from 1, 0 for nulls."""
    column = column.combine_chunks()
    ranks = pc.rank(column, "ascending", null_placement="at_end", tiebreaker="dense").to_numpy().astype("int64")
    return np.where(column.is_null().to_numpy(zero_copy_only=False), 0, ranks)


def _largest(cell: np.ndarray, cells: int, ranks: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each cell the row of largest rank, the first in a tie, -1 if it has none; and that rank."""
    best = np.zeros(cells, "int64")
    np.maximum.at(best, cell, ranks << 32 | (n - rows))
    return np.where(best > 0, n - (best & 0xFFFFFFFF), -1), best >> 32


class Sessions:
    """The sessions of a table of pieces."""

    def __init__(self, rows: pa.Table, fields: int, meta: Sequence[str]):
        self.rows, self.meta = rows.combine_chunks(), meta
        n = rows.num_rows
        key = rows["_key"].combine_chunks().dictionary_encode().indices.to_numpy().astype("int64")
        start, end = rows["_start"].to_numpy(), rows["_end"].to_numpy()
        order = np.lexsort((start, key))
        key, start, end = key[order], start[order], end[order]
        ends, place = np.unique(end, return_inverse=True)
        # latest end of the key up to each row
        so_far = ends[np.maximum.accumulate(key * len(ends) + place) - key * len(ends)]
        new = np.append(True, (key[1:] != key[:-1]) | (start[1:] > so_far[:-1]))
        self.first = np.flatnonzero(new)
        sessions = len(self.first)
        self.of = np.empty(n, "int64")
        self.of[order] = np.cumsum(new) - 1
        self.start, self.end = start[self.first], np.maximum.reduceat(end, self.first)
        self.first = order[self.first]
        field = rows["_field"].to_numpy()
        known = np.flatnonzero(field >= 0)
        best, ranks = _largest(self.of[known] * fields + field[known], sessions * fields, _ranks(rows["_seq"])[known], known, n)
        # the row that a field's value is taken from, -1 if the field has not come; whether that row has a sequence number
        self.best, self.numbered = best.reshape(sessions, fields), (ranks > 0).reshape(sessions, fields)
        self.latest = {m: _largest(self.of, sessions, _ranks(rows[m]), np.arange(n), n)[0] for m in meta}

    def folded(self, which: np.ndarray | None = None) -> pa.Table:
        """The rows that count of the sessions ``which``."""
        counts = np.where((self.best >= 0).any(axis=1), -1, self.first)
        kept = np.column_stack([self.best, counts])[slice(None) if which is None else which].ravel()
        kept = kept[kept >= 0]
        of = self.of[kept]
        columns = {c: self.rows[c].take(pa.array(kept)) for c in self.rows.column_names}
        columns |= {"_start": pa.array(self.start[of]), "_end": pa.array(self.end[of])}
        columns |= {m: self.rows[m].take(pa.array(self.latest[m][of])) for m in self.meta}
        return pa.table(columns, schema=self.rows.schema)

    def messages(self, which: np.ndarray, fields: Sequence[str], expected: int) -> pa.Table:
        """One row for each of the sessions ``which``: ``_key``, the fields and ``complete``."""
        columns, seen = {"_key": self.rows["_key"].take(pa.array(self.first[which]))}, 0
        for i, f in enumerate(fields):
            if f in self.meta:
                columns[f] = self.rows[f].take(pa.array(self.latest[f][which]))
                seen = seen + columns[f].is_valid().to_numpy()
            else:
                row = self.best[which, i]
                columns[f] = self.rows["_value"].take(pa.array(row, mask=~self.numbered[which, i]))
                seen = seen + (row >= 0)
        return pa.table({**columns, "complete": pa.array(np.broadcast_to(seen >= expected, len(which)))})


def dealt(buckets: int, fields: int, meta: Sequence[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Deals pieces, which carry ``_bucket``, to packed tables: ``_bucket``, ``_rows``."""
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _gathered(pa.Table.from_batches([b]) for b in batches):
            found = Sessions(rows, fields, meta).folded()
            bucket = found["_bucket"].to_numpy()
            order = np.argsort(bucket, kind="stable")
            found = found.drop_columns(["_bucket"]).take(pa.array(order))
            bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))
            for i in np.flatnonzero(np.diff(bounds)):
                packed = pack(found.slice(bounds[i], bounds[i + 1] - bounds[i]).combine_chunks())
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([packed], pa.binary())], ["_bucket", "_rows"])

    return deal


class Assembly(StatefulProcessor):
    """Keeps the pieces of a bucket until the watermark has passed their messages.

    Pieces wait in runs as they came. When the watermark passes the earliest end of a run, the runs that begin before
    the watermark, and only these, are read and folded; messages that ended leave, the others stay as new runs.
    Pieces whose message would have left when the bucket was last looked at are dropped.
    """

    def __init__(self, fields: Sequence[str], expected: int, meta: Sequence[str]):
        self.fields, self.expected, self.meta = list(fields), expected, list(meta)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # of each run its earliest start and end; the next number of a run; the watermark up to which messages have left
        self.runs = handle.getValueState("runs", "numbers array<bigint>, starts array<bigint>, ends array<bigint>, next bigint, gone bigint")
        self.waiting = handle.getMapState("waiting", "number bigint", "rows binary")

    def _known(self) -> tuple[dict[int, tuple[int, int]], int, int]:
        numbers, starts, ends, following, gone = self.runs.get() or ((), (), (), 0, NEVER)
        return dict(zip(numbers, zip(starts, ends))), following, gone

    def _keep(self, known: dict[int, tuple[int, int]], following: int, gone: int) -> None:
        self.runs.update((list(known), [s for s, _ in known.values()], [e for _, e in known.values()], following, gone))

    def _wait(self, known: dict[int, tuple[int, int]], number: int, rows: pa.Table) -> int:
        start, end = (pc.min(rows[c]).as_py() for c in ("_start", "_end"))
        known[number] = (start, end)
        self.waiting.updateValue((number,), (pack(rows),))
        self.handle.registerTimer(-(-end // 1000))
        return number + 1

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known, following, gone = self._known()
        for table in _gathered(unpack(data) for frame in rows for data in frame.iloc[:, -1]):
            table = table.filter(pc.greater(table["_end"], gone))
            if table.num_rows:
                following = self._wait(known, following, table.combine_chunks())
        self._keep(known, following, max(gone, timerValues.getCurrentWatermarkInMs() * 1000))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        known, following, gone = self._known()
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        if not any(end <= watermark for _, end in known.values()):
            return
        reached = [number for number, (start, _) in known.items() if start <= watermark]
        found = Sessions(pa.concat_tables([unpack(bytes(self.waiting.getValue((n,))[0])) for n in reached]), len(self.fields), self.meta)
        for number in reached:
            self.waiting.removeKey((number,))
            del known[number]
        late = np.flatnonzero(found.end > watermark)
        # those that end first lie in runs of their own
        late = late[np.argsort(found.start[late], kind="stable")]
        share = max(1, GATHERED // (len(self.fields) + 1))
        for at in range(0, len(late), share):
            following = self._wait(known, following, found.folded(late[at:at + share]))
        self._keep(known, following, watermark)
        due = np.flatnonzero(found.end <= watermark)
        for at in range(0, len(due), share):
            yield pd.DataFrame({"_rows": [pack(found.messages(due[at:at + share], self.fields, self.expected))]})

    def close(self) -> None:
        pass
