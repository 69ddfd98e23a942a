"""Sources and sinks on real files."""

import json
import os
import time
from functools import partial

import pytest
from pyspark.sql import functions as F

from sluiceway.sinks import files as sinks
from sluiceway.sinks import topics as topic_sinks
from sluiceway.sinks import upsert
from sluiceway.sinks.commits import CommitLog
from sluiceway.sources import dataflow, files, sidecar, topics
from sluiceway.streaming import runs


@pytest.fixture
def tree(tmp_path):
    for name, size, age in [("a.txt", 5, 0), ("b.csv", 50, 9000), (".hid", 5, 0), ("sub/c.txt", 5, 0), ("sub/deep/d.txt", 1, 0), ("sub/none.txt", 0, 0)]:
        p = tmp_path / "in" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(b"x" * size)
        os.utime(p, (time.time() - age,) * 2)
    return str(tmp_path / "in")


def test_scan(spark, rows, tree):
    def names(**k):
        return [r[0] for r in rows(files.scan_files(spark, tree, **k), "filename")]

    assert names() == ["a.txt", "b.csv", "c.txt", "d.txt"]
    assert names(recurse=False) == ["a.txt", "b.csv"]
    assert names(file_filter=r".*\.txt", min_size=2) == ["a.txt", "c.txt"]
    assert names(path_filter="sub") == ["a.txt", "b.csv", "c.txt"]
    assert names(max_size=10, min_size=2) == ["a.txt", "c.txt"]
    assert names(min_age_secs=3600) == ["b.csv"]
    assert names(max_age_secs=3600) == ["a.txt", "c.txt", "d.txt"]
    got = {r["filename"]: r for r in files.file_attributes(files.scan_files(spark, tree)).collect()}
    assert got["d.txt"]["path"] == "sub/deep/" and got["a.txt"]["path"] == "/"
    assert got["c.txt"]["absolute_path"].endswith("/in/sub/")
    asked = spark.createDataFrame([("sub",), ("sub",), ("none",), (None,), ("sub/deep/",), ("",)], "directory string")
    got = rows(files.scan_dirs_from_table(tree, asked), "directory", "filename", "length")
    assert got == [("", "a.txt", 5), ("", "b.csv", 50), ("sub", "c.txt", 5), ("sub", "none.txt", 0), ("sub/deep/", "d.txt", 1)]
    got = rows(files.scan_dirs_from_table(tree, asked, file_filter=r".*\.csv"), "filename")
    assert got == [("b.csv",)]


def test_blobs_come_in_slices(spark, rows, tree):
    names = spark.createDataFrame([("a.txt",), ("b.csv",), ("b.csv",), ("missing",), (None,), ("sub/none.txt",), ("sub",)], "filename string")
    got = rows(files.blob_download(tree, names, slice_bytes=20), "filename", "position", "content")
    assert got == [
        ("a.txt", 0, b"xxxxx"), ("b.csv", 0, b"x" * 20), ("b.csv", 20, b"x" * 20), ("b.csv", 40, b"x" * 10), ("sub/none.txt", 0, b""),
    ]


def test_lines_are_numbered_through_splits(spark, tmp_path):
    want = []
    for name in ("b.txt", "a.txt", "c.txt"):
        lines = [f"{name} {i} {'y' * (i % 13)}" for i in range(400)]
        (tmp_path / name).write_text("\n".join(lines) + "\n")
        want.append((name, lines))
    want = [line for _, lines in sorted(want) for line in lines]
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        got = {r.line_no: r.value for r in files.numbered_lines(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert [got[i + 1] for i in range(1200)] == want


def test_listing_reads_no_content(spark, tree):
    plan = files.scan_files(spark, tree).select("path", "length")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<path:string,length:bigint>" in plan.replace("modificationTime:timestamp,", "")


def test_sidecar(spark, tmp_path):
    (tmp_path / "s.csv").write_text("taxi,timestamp,fare\nstring,timestamp,dollar\nsv,sv,v\n")
    shape = sidecar.read_sidecar(spark, str(tmp_path / "s.csv"))
    assert [r["position"] for r in shape.where("is_time").collect()] == [1]
    schema = sidecar.sidecar_schema(sidecar.sidecar_fields(shape))
    assert [f.dataType.simpleString() for f in schema] == ["string", "string", "double"]
    assert schema["fare"].metadata == {"unit": "dollar", "kind": "v"}


def test_dataflow_documents(spark, rows, tmp_path):
    doc = {"processors": [{"name": "A", "class": "X", "uuid": "0", "isInput": True, "relationships": [], "properties": [{"Batch Size": "10"}, {"None": None}]}],
           "wiring": [], "QOS": 1}
    (tmp_path / "good.json").write_text("// why\n" + json.dumps(doc, indent=1))
    (tmp_path / "comma.json").write_text('{"processors": [{"name": "A",}], "wiring": []}')
    (tmp_path / "quote.json").write_text('{"processors: [], "wiring": []}')
    flow = dataflow.read_dataflows(spark, str(tmp_path))
    assert rows(flow.nodes, "filename", "stage", "is_input") == [("good.json", "0", True)]
    assert rows(flow.properties, "property", "value") == [("Batch Size", "10"), ("None", None)]
    assert rows(flow.rejected, "filename") == [("comma.json",), ("quote.json",)]


def items(spark, names, content, batch=1):
    return spark.createDataFrame([(batch, n, content) for n in names], "batch_id int, filename string, content string")


@pytest.mark.parametrize("conflict,content,failed", [("fail", "old", 1), ("ignore", "old", 0), ("replace", "new", 0)])
def test_conflicts(spark, rows, path, conflict, content, failed):
    sinks.write_batches(items(spark, ["a", "b"], "old"), path)
    sinks.write_batches(items(spark, ["z"], "old", 7), path)
    done = sinks.write_batches(items(spark, ["b", "c"], "new"), path, conflict=conflict)
    stored = {(r["batch_id"], r["filename"]): r["content"] for r in sinks.read_batches(spark, path).collect()}
    assert stored == {(1, "a"): "old", (1, "b"): content, (1, "c"): "new", (7, "z"): "old"}
    assert done.failure.count() == failed and done.success.count() == 2 - failed


def test_file_cap(spark, path):
    first = spark.range(5).selectExpr("1 as batch_id", "concat('f', id) as filename", "id as arrival")
    done = sinks.write_batches(first, path, max_files=3, order="arrival")
    assert sorted(r["arrival"] for r in done.failure.collect()) == [3, 4]
    more = spark.range(2).selectExpr("1 as batch_id", "concat('g', id) as filename", "id as arrival")
    assert sinks.write_batches(more, path, max_files=4, order="arrival").failure.count() == 1
    assert sinks.read_batches(spark, path).count() == 4
    # a name that is replaced takes no new place
    again = spark.range(1, 6).selectExpr("1 as batch_id", "concat('f', id) as filename", "id as arrival")
    done = sinks.write_batches(again, path, conflict="replace", max_files=5, order="arrival")
    assert sorted(r["arrival"] for r in done.failure.collect()) == [4, 5]
    assert sinks.read_batches(spark, path).count() == 5


KEYS, ORDER = ("k",), ("t",)


def test_upsert(spark, rows, path):
    def batch(*r):
        return spark.createDataFrame(list(r), "k string, t int, v string")

    upsert.upsert(batch(("a", 1, "x"), ("a", 2, "y"), ("b", 1, "p")), path, 0, KEYS, ORDER)
    upsert.upsert(batch(("a", 3, "z")), path, 1, KEYS, ORDER)
    expected = [("a", 3, "z"), ("b", 1, "p")]
    read = lambda: rows(upsert.read_current(spark, path, KEYS, ORDER))
    assert read() == expected
    upsert.upsert(batch(("a", 3, "z")), path, 1, KEYS, ORDER)  # a replayed epoch
    assert read() == expected
    assert upsert.compact(spark, path, KEYS, ORDER) > 0
    assert read() == expected
    upsert.upsert(batch(("b", 5, "q")), path, 2, KEYS, ORDER)
    # rows whose commit was never written are not read
    batch(("junk", 9, "junk")).write.parquet(f"{path}/data/junk/_bucket=0")
    assert read() == [("a", 3, "z"), ("b", 5, "q")]
    assert CommitLog(spark, path).vacuum(0) == 1
    assert read() == [("a", 3, "z"), ("b", 5, "q")]


def test_untouched_buckets_are_neither_read_nor_rewritten(spark, path):
    first = spark.range(200).selectExpr("cast(id as string) k", "1 t", "'x' v")
    upsert.upsert(first, path, 0, KEYS, ORDER, buckets=8)
    log = CommitLog(spark, path)
    before = {x.bucket: x for x in log.latest().layers}
    upsert.upsert(first.where("k = '7'").selectExpr("k", "2 t", "'y' v"), path, 1, KEYS, ORDER)
    touched = {x.bucket for x in log.latest().layers if x.version == 1}
    assert len(touched) == 1 and len(before) == 8
    plan = upsert.read_current(spark, path, KEYS, ORDER)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1  # only the touched bucket is folded
    assert upsert.compact(spark, path, KEYS, ORDER) == 1
    after = {x.bucket: x for x in log.latest().layers}
    assert {b for b in before if before[b] != after[b]} == touched
    plan = upsert.read_current(spark, path, KEYS, ORDER)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert upsert.read_current(spark, path, KEYS, ORDER).where("v = 'y'").count() == 1


def test_first_write_of_no_rows(spark, path):
    none = items(spark, ["a"], "old").where("false")
    assert sinks.read_batches(spark, path) is None
    sinks.write_batches(none, path)
    assert sinks.read_batches(spark, path).count() == 0
    sinks.write_batches(items(spark, ["a"], "new"), path)
    assert sinks.read_batches(spark, path).count() == 1


def test_crash_between_data_and_commit(spark, path, monkeypatch):
    sinks.write_batches(items(spark, ["a"], "old"), path)

    def crash(self, snapshot):
        raise OSError("gone")

    with monkeypatch.context() as m:
        m.setattr(CommitLog, "commit", crash)
        with pytest.raises(OSError):
            sinks.write_batches(items(spark, ["a", "b"], "new"), path, conflict="replace")
    assert [tuple(r) for r in sinks.read_batches(spark, path).collect()] == [(1, "a", "old")]
    sinks.write_batches(items(spark, ["a", "b"], "new"), path, conflict="replace")
    assert sorted(tuple(r) for r in sinks.read_batches(spark, path).collect()) == [(1, "a", "new"), (1, "b", "new")]
    assert CommitLog(spark, path).vacuum(0) == 1


def test_writers_at_once(spark, path, monkeypatch):
    """Another writer commits while this one has its rows written: same batch, then another."""
    sinks.write_batches(items(spark, ["a"], "old"), path)
    commit, others = CommitLog.commit, [items(spark, ["b"], "other"), items(spark, ["x"], "other", 2)]

    def late(self, snapshot):
        if others:
            monkeypatch.setattr(CommitLog, "commit", commit)
            sinks.write_batches(others.pop(0), path)
            monkeypatch.setattr(CommitLog, "commit", late if others else commit)
        return commit(self, snapshot)

    monkeypatch.setattr(CommitLog, "commit", late)
    done = sinks.write_batches(items(spark, ["b", "c"], "mine"), path)
    assert [r.filename for r in done.failure.collect()] == ["b"]
    stored = sorted((r.batch_id, r.filename, r.content) for r in sinks.read_batches(spark, path).collect())
    assert stored == [(1, "a", "old"), (1, "b", "other"), (1, "c", "mine"), (2, "x", "other")]


def test_replayed_epochs_and_maps(spark, path):
    rows = spark.createDataFrame([(1, "a", {"k": "v"}), (1, "a", {"k": "w"})], "batch_id int, filename string, m map<string,string>")
    for _ in range(2):
        sinks.write_batches(rows, path, run="r", epoch=0)
    assert sinks.read_batches(spark, path).count() == 1
    assert CommitLog(spark, path).latest().version == 0


def test_requested_batches_open_their_layers_only(spark, path):
    rows = spark.range(100).selectExpr("id div 10 as batch_id", "concat('f', id) as filename")
    sinks.write_batches(rows, path, buckets=4)
    got = sinks.read_batches(spark, path, spark.createDataFrame([(3,), (3,), (99,)], "batch_id long"))
    assert sorted(r.filename for r in got.collect()) == [f"f{i}" for i in range(30, 40)]
    assert sinks.read_batches(spark, path, spark.createDataFrame([], "batch_id long")).count() == 0


def file_client(path):
    class FileClient:
        def __init__(self):
            self.out = open(f"{path}-{os.getpid()}-{time.time_ns()}", "w")

        def publish(self, topic, payload, qos, retain):
            self.out.write(f"{topic}|{payload}|{qos}|{retain}\n")

        def close(self):
            self.out.close()

    return FileClient


def test_publish(spark, tmp_path, rows):
    df = spark.range(20).selectExpr("id", "id % 2 as parity", "cast(id as string) as body")
    sent = topic_sinks.messages(df, "t/{parity}", "body")
    topic_sinks.publish(sent, file_client(str(tmp_path / "sent")))
    lines = sorted(x for p in tmp_path.iterdir() for x in p.read_text().splitlines())
    assert len(lines) == 20 and "t/1|19|1|True" in lines
    assert rows(topic_sinks.retained(sent, "id")) == [("t/0", "18"), ("t/1", "19")]


def log_lines(path, *messages):
    with open(path, "a", encoding="utf-8") as f:
        f.writelines(json.dumps({"topic": t, "payload": p}) + "\n" for t, p in messages)


def test_subscribe_over_restarts(spark, tmp_path):
    root, out, log = (str(tmp_path / n) for n in ("topics", "out", "log"))
    os.mkdir(root)
    source = topics.topic_source(spark, partial(topics.FileLog, root))
    got = lambda: sorted(r.payload for r in spark.read.parquet(out).collect())

    def run(size=7):
        stream = spark.readStream.format(source).option("topicFilter", "a/+").option("sliceSize", size).load()
        runs.drain(runs.to_files(stream, out, log))

    log_lines(f"{root}/one", ("a/b", "1"), ("a/b/c", "no"), ("a/é", "2"))
    with open(f"{root}/one", "a") as f:
        f.write('{"topic": "a/x", "payl')  # a message that is still being written
    run()
    assert got() == ["1", "2"]
    with open(f"{root}/one", "a") as f:
        f.write('oad": "3"}\n')
    log_lines(f"{root}/two", *[("a/b", str(i)) for i in range(4, 10)])
    run(1000)
    run()
    assert got() == [str(i) for i in range(1, 10)]
    batch = spark.read.format(source).option("sliceSize", 5).load()
    assert batch.count() == 10 and batch.select("part", "position").distinct().count() == 10


def test_publish_commits_an_epoch_at_once(spark, tmp_path):
    root, source, log = (str(tmp_path / n) for n in ("outbox", "in", "log"))
    rows = spark.range(20).selectExpr("concat('t/', id % 2) topic", "cast(id as string) payload", "1 qos", "true retain")
    rows.repartition(3).write.parquet(source)
    sink = topic_sinks.topic_sink(spark, partial(topic_sinks.FileOutbox, root))
    stream = lambda: spark.readStream.schema(rows.schema).parquet(source).writeStream.format(sink).option("checkpointLocation", log)
    runs.drain(stream().trigger(availableNow=True).start())
    read = lambda: sorted(int(r.payload) for r in spark.read.json(root).collect())
    assert read() == list(range(20))
    # the epoch is sent again, as after a crash between release and checkpoint: nothing comes out twice
    box = topic_sinks.FileOutbox(root)
    box.release(0, [box.put(iter([("t/0", "0", 1, True)]))])
    assert read() == list(range(20))
    token = box.put(iter([("t/0", "99", 1, True)]))
    box.discard([token])
    assert read() == list(range(20)) and not [p for p in (tmp_path / "outbox" / "_open").iterdir() if p.name == token]
    rows.limit(2).write.mode("append").parquet(source)
    runs.drain(stream().trigger(availableNow=True).start())
    assert len(read()) == 22


def test_direct_outbox(tmp_path):
    box = topic_sinks.Direct(file_client(str(tmp_path / "sent")))
    box.release(0, [box.put(iter([("t", "p", 1, False)]))])
    assert [p.read_text() for p in tmp_path.iterdir()] == ["t|p|1|False\n"]


@pytest.mark.parametrize("pattern,hits", [("a/+", ["a/b"]), ("a/#", ["a", "a/b", "a/b/c"]), ("#", ["a", "a.b", "a/b", "a/b/c"]), ("a.b", ["a.b"])])
def test_topic_filters(spark, rows, pattern, hits):
    df = spark.createDataFrame([("a",), ("a/b",), ("a/b/c",), ("a.b",)], "topic string")
    assert [r[0] for r in rows(topics.subscribe(df, pattern))] == hits


def test_log_rows(spark):
    logged, seen = topic_sinks.log_rows(spark.range(9), "ids", F.max("id").alias("top"))
    logged.write.format("noop").mode("overwrite").save()
    assert seen.get == {"rows": 9, "top": 8}
