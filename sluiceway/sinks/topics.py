"""Publish rows to a broker, or log them.

``topic_sink`` makes a streaming sink of an outbox: tasks put messages into it, and an epoch's messages are
released together when all its tasks are done. ``FileOutbox`` releases files that ``sources.topics.FileLog`` reads.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, WriterCommitMessage


class Client(Protocol):
    def publish(self, topic: str, payload: str, qos: int, retain: bool) -> object: ...

    def close(self) -> object: ...


class Outbox(Protocol):
    def put(self, messages: Iterator[tuple[str, str, int, bool]]) -> str:
        """Take a task's messages (topic, payload, qos, retain); a token for them."""

    def release(self, epoch: int, tokens: list[str]) -> None: ...

    def discard(self, tokens: list[str]) -> None: ...


class Direct:
    """An outbox before a broker without transactions: messages leave at once, so a repeated task sends them again."""

    def __init__(self, connect: Callable[[], Client]):
        self.connect = connect

    def put(self, messages: Iterator[tuple[str, str, int, bool]]) -> str:
        client = self.connect()
        try:
            for message in messages:
                client.publish(*message)
        finally:
            client.close()
        return ""

    def release(self, epoch: int, tokens: list[str]) -> None:
        pass

    def discard(self, tokens: list[str]) -> None:
        pass


class FileOutbox:
    """Messages as files of JSON lines. A task writes a hidden file; the release moves an epoch's files to names
    made of the epoch and their number, and does nothing for an epoch that is out already. An outbox belongs to one
    checkpoint, which counts its epochs."""

    def __init__(self, root: str):
        self.fs, self.root = pafs.FileSystem.from_uri(root)
        self.fs.create_dir(f"{self.root}/_open", recursive=True)

    def put(self, messages: Iterator[tuple[str, str, int, bool]]) -> str:
        name = f"_open/{uuid.uuid4().hex}"
        with self.fs.open_output_stream(f"{self.root}/{name}") as out:
            for topic, payload, qos, retain in messages:
                line = {"topic": topic, "payload": payload, "qos": qos, "retain": retain}
                out.write(json.dumps(line).encode() + b"\n")
        return name

    def _there(self, name: str) -> bool:
        return self.fs.get_file_info(f"{self.root}/{name}").type != pafs.FileType.NotFound

    def release(self, epoch: int, tokens: list[str]) -> None:
        # the list is written first, so that a release cut short goes on with the same files
        plan = f"_open/epoch-{epoch}"
        if self._there(plan):
            with self.fs.open_input_stream(f"{self.root}/{plan}") as file:
                first = json.loads(file.read())
            self.discard([t for t in tokens if t not in first])
            tokens = first
        else:
            with self.fs.open_output_stream(f"{self.root}/{plan}.draft") as out:
                out.write(json.dumps(tokens).encode())
            self.fs.move(f"{self.root}/{plan}.draft", f"{self.root}/{plan}")
        for i, token in enumerate(tokens):
            if self._there(token):
                self.fs.move(f"{self.root}/{token}", f"{self.root}/{epoch:010d}-{i:06d}.json")

    def discard(self, tokens: list[str]) -> None:
        for token in tokens:
            if self._there(token):
                self.fs.delete_file(f"{self.root}/{token}")


def put_messages(df: DataFrame, outbox: Callable[[], Outbox]) -> list[str]:
    """Put message rows into an outbox; a token for each task, to be released together."""
    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (tuple(row.values()) for batch in batches for row in batch.to_pylist())
        yield pa.RecordBatch.from_pydict({"token": [outbox().put(rows)]})

    sent = df.select("topic", "payload", "qos", "retain").mapInArrow(put, "token string")
    return [r["token"] for r in sent.collect()]


@dataclass
class Sent(WriterCommitMessage):
    token: str


class _Publisher(DataSourceStreamWriter):
    def __init__(self, outbox: Callable[[], Outbox]):
        self.outbox = outbox

    def write(self, iterator) -> Sent:
        return Sent(self.outbox().put((r["topic"], r["payload"], r["qos"], r["retain"]) for r in iterator))

    def commit(self, messages, batchId: int) -> None:
        self.outbox().release(batchId, [m.token for m in messages if m is not None])

    def abort(self, messages, batchId: int) -> None:
        self.outbox().discard([m.token for m in messages if m is not None])


def topic_sink(spark: SparkSession, outbox: Callable[[], Outbox], name: str = "publish") -> str:
    """Register an outbox as a format for ``writeStream`` of message rows."""
    class Publish(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamWriter:
            return _Publisher(outbox)

    spark.dataSource.register(Publish)
    return name


def messages(
    df: DataFrame, topic: str, payload: str, qos: int = 1, retain: bool = True
) -> DataFrame:
    """(topic, payload, qos, retain); ``topic`` may hold ``{column}`` placeholders."""
    parts = []
    for i, piece in enumerate(topic.replace("}", "{").split("{")):
        parts.append(F.col(piece).cast("string") if i % 2 else F.lit(piece))
    kept = [c for c in df.columns if c not in ("topic", "payload", "qos", "retain")]
    return df.select(
        *kept, F.concat(*parts).alias("topic"), F.col(payload).alias("payload"),
        F.lit(qos).alias("qos"), F.lit(retain).alias("retain"),
    )


def retained(published: DataFrame, order: str) -> DataFrame:
    """What a late subscriber is given: the last retained payload of each topic."""
    return published.where("retain").groupBy("topic").agg(F.max_by("payload", order).alias("payload"))


def publish(df: DataFrame, connect: Callable[[], Client]) -> None:
    """Send message rows, one client per partition. At least once: a retried task resends."""
    def send(rows) -> None:
        client = connect()
        try:
            for row in rows:
                client.publish(row["topic"], row["payload"], row["qos"], row["retain"])
        finally:
            client.close()

    df.select("topic", "payload", "qos", "retain").foreachPartition(send)


def log_rows(df: DataFrame, name: str, *aggregates) -> tuple[DataFrame, Observation]:
    """Pass rows through and count them (and more) on the way."""
    seen = Observation(name)
    return df.observe(seen, F.count("*").alias("rows"), *aggregates), seen
