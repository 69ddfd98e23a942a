"""Tables as parquet layers under a log of commits.

A write puts its rows into a directory of its own, cut by bucket (a hash of the key columns), and counts
once its commit is in the log. A commit is a small JSON file that lists the live layers of every bucket
with their row counts and the range of one column, and the last epoch of every streaming query that fed
the table. Commits are numbered, and a number is taken by a rename that fails if it is taken already: who
comes second looks again. So readers never list data directories, a crash between data and
commit leaves only files that nothing names (``vacuum`` removes them), and a replayed epoch is known.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 16
#: commits that stay readable behind the last one
KEPT_COMMITS = 20
LAYER = "_layer"


class Conflict(RuntimeError):
    """Others kept changing the same buckets."""


@dataclass(frozen=True)
class Layer:
    """Rows of one bucket from one write; ``over`` rows replace older ones of their key."""

    path: str
    bucket: int
    version: int
    rows: int
    low: object = None
    high: object = None
    over: bool = False


@dataclass(frozen=True)
class Snapshot:
    version: int = -1
    buckets: int = BUCKETS
    schema: str | None = None
    layers: tuple[Layer, ...] = ()
    runs: dict[str, int] = field(default_factory=dict)

    def of(self, buckets: set[int] | None) -> list[Layer]:
        return [x for x in self.layers if buckets is None or x.bucket in buckets]

    def struct(self) -> T.StructType:
        return T.StructType.fromJson(json.loads(self.schema))


@dataclass(frozen=True)
class Change:
    """What a write adds and drops, and the buckets its decisions rest on."""

    adds: tuple[Layer, ...]
    drops: tuple[Layer, ...] = ()
    touched: frozenset[int] = frozenset()
    schema: str | None = None
    run: str | None = None
    epoch: int = -1


class CommitLog:
    """The commits below ``root``; file operations are the driver's and small."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.fs = self._path("").getFileSystem(self.conf)

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _numbers(self) -> list[int]:
        if not self.fs.exists(self._path("log")):
            return []
        names = [f.getPath().getName() for f in self.fs.listStatus(self._path("log"))]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _file(self, version: int) -> str:
        return f"log/{version:020d}.json"

    def latest(self) -> Snapshot:
        numbers = self._numbers()
        if not numbers:
            return Snapshot(buckets=self.buckets)
        stream = self.fs.open(self._path(self._file(numbers[-1])))
        try:
            held = json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return Snapshot(**{**held, "layers": tuple(Layer(**x) for x in held["layers"])})

    def commit(self, snapshot: Snapshot) -> bool:
        """Publish a snapshot; False if its number is taken."""
        draft, target = self._path(f"log/.{uuid.uuid4().hex}"), self._path(self._file(snapshot.version))
        stream = self.fs.create(draft, False)
        try:
            stream.write(json.dumps(asdict(snapshot)).encode())
        finally:
            stream.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.conf)
        modes = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(context.makeQualified(draft), context.makeQualified(target), modes)
        except Exception:
            self.fs.delete(draft, False)
            if not self.fs.exists(target):
                raise
            return False
        for old in self._numbers():
            if old <= snapshot.version - KEPT_COMMITS:
                self.fs.delete(self._path(self._file(old)), False)
        return True

    def write(self, build: Callable[[Snapshot], Change | None], tries: int = 10) -> Snapshot:
        """Build a change on the last snapshot and commit it.

        If others committed meanwhile the change is kept where they touched other buckets, and
        built again where they touched the same.
        """
        for _ in range(tries):
            seen = self.latest()
            change = build(seen)
            if change is None:
                return seen
            base = seen
            while True:
                layers = tuple(x for x in base.layers if x not in change.drops) + change.adds
                runs = dict(base.runs)
                if change.run is not None:
                    runs[change.run] = max(change.epoch, runs.get(change.run, -1))
                made = replace(
                    base, version=base.version + 1, layers=layers, runs=runs, schema=base.schema or change.schema
                )
                if self.commit(made):
                    return made
                base = self.latest()
                moved = {x.bucket for x in set(base.layers) ^ set(seen.layers)}
                if moved & change.touched or base.buckets != seen.buckets or base.runs != seen.runs or not seen.schema:
                    break
        raise Conflict(f"{self.root} changed {tries} times while it was written")

    def bucketed(self, rows: DataFrame, keys: Sequence[str], seen: Snapshot) -> DataFrame:
        return rows.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(seen.buckets)).cast("int"))

    def stage(
        self, rows: DataFrame, seen: Snapshot, stat: str | None = None, over: bool = False,
        split: Sequence[str] = (), max_records: int = 5_000_000,
    ) -> tuple[str, dict[int, Layer]]:
        """Write bucketed rows; the new directory and a layer for each bucket (of ``split`` columns, those whose
        value is ``write``)."""
        name = f"data/{uuid.uuid4().hex}"
        path = f"{self.root}/{name}"
        # rebalancing splits a hot bucket over several tasks and files
        (
            rows.withColumn(LAYER, F.lit(seen.version + 1).cast("bigint")).hint("rebalance", *split, "_bucket")
            .write.option("maxRecordsPerFile", max_records).partitionBy(*split, "_bucket").parquet(path)
        )
        written = self.spark.read.schema(
            T.StructType([*rows.drop("_bucket", *split).schema, *[T.StructField(s, T.StringType()) for s in split],
                          T.StructField("_bucket", T.IntegerType())])
        ).parquet(path)
        for column in split:
            written = written.where(F.col(column) == "write")
        ends = [F.min(stat).alias("low"), F.max(stat).alias("high")] if stat else []
        below = "".join(f"/{c}=write" for c in split)
        layers = {}
        for r in written.groupBy("_bucket").agg(F.count("*").alias("rows"), *ends).collect():
            low, high = (r["low"], r["high"]) if stat else (None, None)
            plain = isinstance(low, (int, float, str)) and isinstance(high, (int, float, str))
            layers[r["_bucket"]] = Layer(
                f"{name}{below}/_bucket={r['_bucket']}", r["_bucket"], seen.version + 1, r["rows"],
                low if plain else None, high if plain else None, over,
            )
        return path, layers

    def read(self, snapshot: Snapshot, layers: Sequence[Layer], keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
        """The current rows of some layers. Only buckets with a layer over another are folded by key."""
        stacked = {x.bucket for x in layers if x.over} & {
            b for b in {x.bucket for x in layers} if sum(x.bucket == b for x in layers) > 1
        }
        shape = snapshot.struct()
        with_layer = T.StructType([*shape, T.StructField(LAYER, T.LongType())])

        def load(chosen: list[Layer]) -> DataFrame:
            if not chosen:
                return self.spark.createDataFrame([], with_layer)
            return self.spark.read.schema(with_layer).parquet(*[f"{self.root}/{x.path}" for x in chosen])

        flat = load([x for x in layers if x.bucket not in stacked]).select(*shape.names)
        if not stacked:
            return flat
        rest = [c for c in shape.names if c not in keys]
        folded = load([x for x in layers if x.bucket in stacked]).groupBy(*keys).agg(
            F.max_by(F.struct(*rest), F.struct(*order, LAYER)).alias("_row")
        )
        return flat.unionByName(folded.select(*keys, "_row.*").select(*shape.names))

    def vacuum(self, older_than_secs: float = 86_400) -> int:
        """Delete directories of rows that no readable commit names; returns how many.

        Spare those younger than any write may take, and those old commits still name.
        """
        named = set()
        for number in self._numbers():
            stream = self.fs.open(self._path(self._file(number)))
            held = json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            stream.close()
            named |= {x["path"].split("/")[1] for x in held["layers"]}
        if not self.fs.exists(self._path("data")):
            return 0
        limit = self.jvm.java.lang.System.currentTimeMillis() - older_than_secs * 1000
        gone = 0
        for status in self.fs.listStatus(self._path("data")):
            if status.getPath().getName() not in named and status.getModificationTime() <= limit:
                self.fs.delete(status.getPath(), True)
                gone += 1
        return gone
