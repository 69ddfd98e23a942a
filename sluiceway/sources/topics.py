"""Messages of a publish/subscribe broker.

A broker is read through a log: partitions of messages with growing offsets, from which any range can be
read again. ``topic_source`` makes a streaming (and batch) source of one; ``FileLog`` is such a log in files. A
broker that cannot be asked again, as plain MQTT, needs a bridge that writes what it hears into a log.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "topic string, payload string, part string, position bigint"


class Log(Protocol):
    def parts(self) -> list[str]: ...

    def end(self, part: str) -> int:
        """The offset behind the last whole message."""

    def read(self, part: str, start: int, end: int) -> Iterator[tuple[str, str, int]]:
        """(topic, payload, offset) of the messages that start in [start, end); ``start`` need not be the start of one."""


class FileLog:
    """Files of JSON lines ``{"topic": …, "payload": …}`` that only grow; a file is a part, offsets are bytes."""

    BLOCK = 1 << 20

    def __init__(self, root: str):
        self.fs, self.root = pafs.FileSystem.from_uri(root)

    def parts(self) -> list[str]:
        if self.fs.get_file_info(self.root).type == pafs.FileType.NotFound:
            return []
        found = self.fs.get_file_info(pafs.FileSelector(self.root, recursive=True))
        return sorted(
            i.path[len(self.root):].lstrip("/") for i in found if i.is_file and i.base_name[:1] not in "._"
        )

    def end(self, part: str) -> int:
        with self.fs.open_input_file(f"{self.root}/{part}") as file:
            at = file.size()
            while at > 0:
                start = max(at - self.BLOCK, 0)
                file.seek(start)
                last = file.read(at - start).rfind(b"\n")
                if last >= 0:
                    return start + last + 1
                at = start
        return 0

    def read(self, part: str, start: int, end: int) -> Iterator[tuple[str, str, int]]:
        with self.fs.open_input_file(f"{self.root}/{part}") as file:
            # a message belongs to the range that holds its first byte
            at = max(start - 1, 0)
            file.seek(at)
            skip, rest = start > 0, b""
            while at < end:
                block = file.read(self.BLOCK)
                if not block:
                    return
                rest += block
                lines = rest.split(b"\n")
                rest = lines.pop()
                for line in lines:
                    if not skip and at < end:
                        message = json.loads(line)
                        yield message["topic"], message["payload"], at
                    skip = False
                    at += len(line) + 1


@dataclass
class Range(InputPartition):
    part: str
    start: int
    end: int


def _ranges(start: dict[str, int], end: dict[str, int], slice_size: int) -> list[Range]:
    """What lies between two offsets, in slices, so that a hot part is read by many tasks."""
    return [
        Range(part, at, min(at + slice_size, last))
        for part, last in end.items() for at in range(start.get(part, 0), last, slice_size)
    ]


class _Reader:
    def __init__(self, connect: Callable[[], Log], topic_filter: str, slice_size: int):
        self.connect, self.topic_filter, self.slice_size = connect, topic_filter, slice_size

    def read(self, partition: Range) -> Iterator[tuple]:
        wanted = re.compile(topic_pattern(self.topic_filter).replace(r"\z", r"\Z")).match
        for topic, payload, at in self.connect().read(partition.part, partition.start, partition.end):
            if wanted(topic):
                yield topic, payload, partition.part, at

    def _ends(self) -> dict[str, int]:
        log = self.connect()
        return {part: log.end(part) for part in log.parts()}


class _BatchReader(_Reader, DataSourceReader):
    def partitions(self) -> list[Range]:
        return _ranges({}, self._ends(), self.slice_size) or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[tuple]:
        return super().read(partition) if partition.part else iter(())


class _StreamReader(_Reader, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return self._ends()

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return _ranges(start, end, self.slice_size)

    def commit(self, end: dict) -> None:
        pass


def topic_source(spark: SparkSession, connect: Callable[[], Log], name: str = "topics") -> str:
    """Register the log behind ``connect`` as a format for ``spark.read`` and ``spark.readStream``.

    Options: ``topicFilter`` (all topics if not given) and ``sliceSize``, the offsets one task reads. The checkpoint
    holds the offsets of all parts, so a restart goes on where the last trigger ended.
    """
    class Topics(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return SCHEMA

        def _arguments(self) -> tuple:
            return connect, self.options.get("topicFilter", "#"), int(self.options.get("sliceSize", 64 << 20))

        def reader(self, schema) -> DataSourceReader:
            return _BatchReader(*self._arguments())

        def streamReader(self, schema) -> DataSourceStreamReader:
            return _StreamReader(*self._arguments())

    spark.dataSource.register(Topics)
    return name


def topic_pattern(topic_filter: str) -> str:
    """Topic filter (``+`` one level, a final ``#`` the rest) as a regular expression."""
    levels = topic_filter.split("/")
    rest = levels[-1] == "#"
    parts = ["[^/]*" if p == "+" else re.escape(p) for p in (levels[:-1] if rest else levels)]
    body = "/".join(parts)
    if rest:
        body = f"{body}(/.*)?" if body else ".*"
    return rf"\A{body}\z"


def subscribe(messages: DataFrame, topic_filter: str, topic: str = "topic") -> DataFrame:
    """Messages, batch or stream, whose topic the filter covers."""
    return messages.where(F.col(topic).rlike(topic_pattern(topic_filter)))
