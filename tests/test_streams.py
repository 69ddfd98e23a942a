"""Streams over several runs of one checkpoint, late data and expiry."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from sluiceway.operators.impute import impute_mean
from sluiceway.streaming import runs, stateful
from sluiceway.streaming.files import stream_files


@pytest.fixture
def feed(spark, tmp_path):
    """Append rows to a source directory, run the stream to its end, read the sink."""
    source, out, log = (str(tmp_path / n) for n in ("source", "out", "log"))

    class Feed:
        def add(self, rows, schema):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
            self.schema = schema

        def stream(self):
            return stream_files(spark, source, "parquet", self.schema, batch_files=100)

        def run(self, df, update=False):
            runs.drain((runs.updates_to_files if update else runs.to_files)(df, out, log))
            return spark.read.parquet(out)

    return Feed()


PIECE = "msg_id int, event_time timestamp, obs_type string, obs_val string, seq int"


def clock(hour, minute=0, day=1):
    return dt.datetime(2024, 1, day, hour, minute)


def test_early_messages_over_restarts(feed, rows):
    join = lambda: stateful.early_messages(feed.stream(), ["a", "b"], within_ms=86_400_000)
    feed.add([(1, clock(0), "a", "x", 1), (2, clock(0, 9), "b", "y", 2)], PIECE)
    assert feed.run(join()).count() == 0
    feed.add([(1, clock(3), "b", "z", 2)], PIECE)  # a piece with a time of its own, in a later run
    assert rows(feed.run(join()), "msg_id", "joined_value", "complete") == [(1, "x@z", True)]
    # what is sent again to a message that has left is swallowed; an older piece does not replace a newer one
    feed.add([(1, clock(3), "b", "again", 9), (2, clock(3), "b", "stale", 1), (2, clock(3), "a", "w", 1)], PIECE)
    assert rows(feed.run(join()), "msg_id", "joined_value") == [(1, "x@z"), (2, "w@y")]


def test_incomplete_messages_leave_by_their_timer(feed, rows):
    join = lambda: stateful.early_messages(feed.stream(), ["a", "b"], within_ms=3_600_000)
    feed.add([(1, clock(0), "a", "x", 1), (2, clock(0), "a", "x", 1), (2, clock(0), "b", "y", 2)], PIECE)
    feed.run(join())
    feed.add([(3, clock(0, day=2), "a", "q", 1), (None, clock(0, day=2), "a", "q", 1)], PIECE)
    got = rows(feed.run(join()), "msg_id", "joined_value", "complete")
    assert got == [(1, "x@null", False), (2, "x@y", True)]
    # both messages were forgotten with their timers, so the id can be used again
    feed.add([(2, clock(1, day=2), "a", "new", 1), (2, clock(1, day=2), "b", "new", 1)], PIECE)
    assert (2, "new@new", True) in rows(feed.run(join()), "msg_id", "joined_value", "complete")


def test_message_join_over_restarts(feed, rows):
    join = lambda: stateful.message_join(feed.stream(), ["a", "b"], within="1 day")
    got = lambda: rows(feed.run(join()), "msg_id", "joined_value", "complete")
    feed.add([(1, clock(0), "a", "x", 1), (2, clock(0, 9), "b", "y", 2), (3, clock(1), "a", "q", 1)], PIECE)
    assert got() == []
    # pieces with times of their own, in a later run, some sent again
    feed.add([(1, clock(3), "b", "z", 2), (1, clock(3), "b", "stale", 1), (2, clock(3), "a", "w", 1), (2, clock(9), "a", "v", 2)], PIECE)
    assert got() == []
    feed.add([(9, clock(0, day=5), "a", "q", 1), (None, clock(0, day=5), "a", "q", 1)], PIECE)
    assert got() == [(1, "x@z", True), (2, "v@y", True), (3, "q@null", False)]
    # the messages were forgotten, so an id can be used again
    feed.add([(2, clock(1, day=5), "a", "new", 1), (2, clock(1, day=5), "b", "new", 1), (8, clock(0, day=9), "a", "q", 1)], PIECE)
    assert (2, "new@new", True) in got()


def test_message_join_of_odd_pieces(feed, rows):
    schema = PIECE.replace("obs_val string", "obs_val int") + ", kind string"
    join = lambda: stateful.message_join(feed.stream(), ["kind", "a", "b"], within="1 hour", delay="1 hour", meta=["kind"], buckets=2)
    feed.add([
        (1, clock(1), "a", 7, 1, None), (1, clock(2), "b", None, 2, "j"), (1, clock(1, 30), "b", 5, 1, "k"),  # each just in time
        (2, clock(1), "a", 1, 1, "k"), (2, clock(2, 1), "b", 2, 1, "k"),  # too late for one another
        (3, clock(1), "a", 3, None, None), (4, clock(1), "unknown", 4, 1, None), (None, clock(1), "b", 6, 1, None), (5, None, "a", 1, 1, "k"),
    ], schema)
    feed.run(join())
    feed.add([(1, clock(2, 59), "a", 8, 2, None), (9, clock(9), "a", 1, 1, None)], schema)
    got = rows(feed.run(join()), "msg_id", "kind", "a", "b", "complete")
    assert got == sorted([
        (1, "k", 8, None, True), (2, "k", 1, None, False), (2, "k", None, 2, False), (3, None, None, None, False),
        (4, None, None, None, False), (None, None, None, 6, False),
    ], key=repr)


def test_message_join_keeps_buckets(spark, tmp_path):
    """State has entries for buckets and triggers, not for each open message."""
    source = str(tmp_path / "source")
    for part in range(3):
        spark.range(3000).select(
            "id", F.lit(clock(1)).alias("event_time"), F.lit("abc"[part]).alias("obs_type"), F.lit("x").alias("obs_val"), F.lit(1).alias("seq")
        ).coalesce(1).write.mode("append").parquet(source)
    stream = stream_files(spark, source, "parquet", spark.read.parquet(source).schema, batch_files=1)
    query = runs.to_files(stateful.message_join(stream, ["a", "b", "c"], msg_id="id"), str(tmp_path / "out"), str(tmp_path / "log"))
    runs.drain(query)
    assert max(o.numRowsTotal for p in query.recentProgress for o in p.stateOperators) < 600


def test_meta_fields_and_repeated_pieces(feed, rows):
    schema = PIECE + ", kind string"
    feed.add([(1, clock(0), "a", "old", 1, None), (1, clock(0), "a", None, 2, "k"), (1, clock(0), "z", "unknown", 1, "j")], schema)
    got = feed.run(stateful.early_messages(feed.stream(), ["kind", "a"], meta=["kind"]))
    assert rows(got, "kind", "a", "joined_value") == [("k", None, "k@null")]


def test_gate_over_restarts(feed, rows):
    schema = "batch_id int, arrival int, event_time timestamp"
    at = lambda b, n: (b, n, clock(0, n))
    gate = lambda: stateful.batch_gate(feed.stream(), 4)
    feed.add([at(1, 0), at(1, 1), at(1, 2), at(2, 3)], schema)
    assert feed.run(gate()).count() == 0
    feed.add([at(1, 9), at(1, 8), at(2, 7)], schema)
    assert rows(feed.run(gate()), "batch_id", "arrival") == [(1, 8)]
    feed.add([at(1, 10), at(2, 11), at(2, 12), at(2, 13)], schema)
    for _ in range(2):
        assert rows(feed.run(gate()), "batch_id", "arrival") == [(1, 8), (2, 12)]


def test_impute_in_event_order_equals_batch(spark, feed, rows):
    schema = "msg_id int, taxi_identifier string, v double, event_time timestamp"
    data = [(i, f"t{i % 3}", None if i % 4 == 0 else float(i * i % 17), clock(0, i)) for i in range(60)]
    shuffled = [data[i * 37 % 60] for i in range(60)]
    fill = lambda: stateful.impute_mean(feed.stream(), "v", 3, output="o", delay="2 hours", slot_ms=600_000)
    for part in (shuffled[:7], shuffled[7:31], shuffled[31:]):
        feed.add(part, schema)
        assert feed.run(fill()).count() == 0
    feed.add([(99, "heartbeat", None, clock(4))], schema)
    got = feed.run(fill())
    batch = impute_mean(spark.createDataFrame(data, schema), "v", 3, output="o")
    rounded = lambda df: rows(df.select("msg_id", F.round("o", 9).alias("o")))
    assert rounded(got) == rounded(batch)
    # later readings go on from the history kept
    more = [(60 + i, f"t{i % 3}", None, clock(4, i)) for i in range(6)]
    feed.add(more, schema)
    feed.run(fill())
    feed.add([(999, "heartbeat", None, clock(12))], schema)
    batch = impute_mean(spark.createDataFrame(data + more, schema), "v", 3, output="o")
    assert rounded(feed.run(fill()).where("taxi_identifier <> 'heartbeat'")) == rounded(batch)


def test_imputation_forgets_idle_sensors(feed, rows):
    schema = "msg_id int, taxi_identifier string, v double, event_time timestamp"
    fill = lambda: stateful.impute_mean(feed.stream(), "v", 3, delay="1 minute", idle_ms=3_600_000)
    feed.add([(1, "t", 4.0, clock(0)), (2, "h", None, clock(0, 30))], schema)
    feed.run(fill())
    feed.add([(3, "t", None, clock(0, 40)), (4, "h", None, clock(5))], schema)
    feed.run(fill())
    feed.add([(5, "t", None, clock(6)), (6, "h", None, clock(9))], schema)
    got = {r.msg_id: r.imputed for r in feed.run(fill()).collect()}
    assert got[3] == 4.0 and got[5] is None


def test_first_arrival_whatever_the_trigger(feed, rows):
    schema = "batch_id int, item_id int, event_time timestamp, note string"
    first = lambda: stateful.dedup_batch(feed.stream(), delay="1 hour", order=["item_id"], within="6 hours")
    feed.add([(1, 5, clock(1), "later"), (2, 3, clock(1), "x"), (2, 2, clock(1), "tie")], schema)
    feed.run(first())
    feed.add([(1, 9, clock(0, 30), "first"), (1, 10, clock(0, 45), "y")], schema)
    assert feed.run(first()).count() == 0
    feed.add([(1, 11, clock(4), "swallowed"), (3, 1, clock(18), "heartbeat")], schema)
    assert rows(feed.run(first()), "batch_id", "item_id", "note") == [(1, 9, "first"), (2, 2, "tie")]


def test_idle_state_expires(feed, rows):
    schema = "batch_id int, arrival int, event_time timestamp"
    day = lambda n: dt.datetime(2024, 1, n)
    gate = lambda: stateful.batch_gate(feed.stream(), 2, event_time="event_time", delay="1 minute", idle_ms=3_600_000)
    feed.add([(1, 0, day(1))], schema)
    feed.run(gate())
    feed.add([(9, 1, day(3))], schema)
    feed.run(gate())
    feed.add([(1, 2, day(4))], schema)
    # the first item of batch 1 was forgotten, so this one does not complete it
    assert feed.run(gate()).count() == 0
    feed.add([(1, 3, day(4))], schema)
    assert rows(feed.run(gate()), "batch_id", "arrival") == [(1, 3)]


def test_window_drops_late_rows(feed, rows):
    schema = "event_time timestamp, v double"
    at = lambda h: dt.datetime(2024, 1, 1, h)
    win = lambda: stateful.windowed(feed.stream(), "v", "1 hour", delay="30 minutes")
    feed.add([(at(1), 1.0), (at(5), 2.0)], schema)
    feed.run(win())
    feed.add([(at(1), 100.0), (at(9), 3.0)], schema)
    got = feed.run(win())
    assert rows(got, "readings", "mean") == [(1, 1.0), (1, 2.0)]


def test_source_is_archived(spark, tmp_path):
    source, archive = tmp_path / "in", tmp_path / "archive"
    source.mkdir()
    for i in range(3):
        (source / f"{i}.txt").write_text(f"line {i}\n")
    df = stream_files(spark, str(source), batch_files=1, archive=str(archive), recurse=False)
    runs.drain(runs.to_files(df, str(tmp_path / "out"), str(tmp_path / "log")))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    assert len(list(source.glob("*.txt"))) < 3


def test_several_sinks(spark, feed, tmp_path):
    feed.add([(i,) for i in range(5)], "v int")
    targets = [str(tmp_path / n) for n in ("one", "two")]
    query = runs.to_sinks(feed.stream(), [runs.by_epoch(t) for t in targets], str(tmp_path / "sinks-log"))
    runs.drain(query)
    assert [spark.read.parquet(t).count() for t in targets] == [5, 5]


def test_upsert_after_a_new_checkpoint(spark, feed, tmp_path):
    """A new checkpoint counts its epochs from zero; nothing recorded before is lost, also after a fold."""
    from sluiceway.sinks import upsert

    table = str(tmp_path / "table")
    sink = upsert.upsert_sink(table, ["k"], ["t"])
    read = lambda: sorted(tuple(r) for r in upsert.read_current(spark, table, ["k"], ["t"]).collect())
    feed.add([(k, 1) for k in range(5)], "k int, t int")
    runs.drain(runs.to_sinks(feed.stream(), [sink], str(tmp_path / "log-one")))
    assert read() == [(k, 1) for k in range(5)]
    upsert.compact(spark, table, ["k"], ["t"])
    feed.add([(4, 2), (5, 2)], "k int, t int")
    runs.drain(runs.to_sinks(feed.stream(), [sink], str(tmp_path / "log-two")))
    expected = [(k, 1) for k in range(4)] + [(4, 2), (5, 2)]
    assert read() == expected
    upsert.compact(spark, table, ["k"], ["t"])
    assert read() == expected
    feed.add([(6, 3)], "k int, t int")
    runs.drain(runs.to_sinks(feed.stream(), [sink], str(tmp_path / "log-two")))
    assert read() == [*expected, (6, 3)]


def test_flow_goes_on_after_a_sink_failed(spark, tmp_path, monkeypatch):
    """An epoch that failed between two sinks is replayed: what was written stays, the rest is completed."""
    from sluiceway.operators.clean import senml_emit, senml_parse
    from sluiceway.plans import flows
    from sluiceway.plans.record_queries import TRIP_VIEW_FIELDS
    from sluiceway.sinks import upsert
    from sluiceway.sinks.files import read_batches
    from sluiceway.sinks.topics import FileOutbox

    good = [(i, "T1", f"H{i % 2}", 1000 * i, 200.0, 2.0, 10.0 + i, 0.5, 1.0, 3.0, "CSH") for i in range(6)]
    names = [n for n, _, _ in TRIP_VIEW_FIELDS]
    schema = "msg_id long, taxi_identifier string, hack_license string, bt long, " + ", ".join(f"{n} double" for n in names[3:-1]) + ", payment_type string"
    trips = spark.createDataFrame(good, schema)
    lines = senml_emit(trips, TRIP_VIEW_FIELDS, "bt", key="taxi_identifier").select("line")
    source, log = str(tmp_path / "in"), str(tmp_path / "log")
    lines.union(spark.createDataFrame([("T1,{broken",)], "line string")).coalesce(1).write.text(source)
    metadata = spark.createDataFrame([("T1", "acme")], "taxi_identifier string, taxi_company string")
    at = flows.FlowSinks(*[str(tmp_path / n) for n in flows.FlowSinks._fields])

    def run():
        stream = senml_parse(stream_files(spark, source).withColumnRenamed("value", "line"))
        sink = flows.into_sinks(at, metadata)
        runs.drain(stream.writeStream.foreachBatch(sink).option("checkpointLocation", log).trigger(availableNow=True).start())

    def full(self, epoch, tokens):
        raise OSError("no room")

    with monkeypatch.context() as m:
        m.setattr(FileOutbox, "release", full)
        with pytest.raises(Exception, match="no room"):
            run()
    assert read_batches(spark, at.files).count() == 6
    run()
    run()
    current = upsert.read_current(spark, at.table, flows.FLOW_KEYS, flows.FLOW_ORDER)
    assert sorted((r.hack_license, r.msg_id, r.taxi_company) for r in current.collect()) == [("H0", 4, "acme"), ("H1", 5, "acme")]
    assert read_batches(spark, at.files).count() == 6
    assert [r.line for r in read_batches(spark, at.dead).collect()] == ["T1,{broken"]
    assert sorted(int(r.payload) for r in spark.read.json(at.outbox).collect()) == list(range(6))


def test_sensors_of_one_bucket_and_large_numbers_beside_nulls(spark, feed, rows):
    """All sensors in one bucket are filled each from its own readings, those without history stay missing, and whole
    numbers stay exact although other rows of the bucket have none."""
    schema = "msg_id bigint, taxi_identifier string, v double, event_time timestamp"
    big = (1 << 60) + 1
    data = [(big + i, f"t{i % 5}", None if i % 3 or i % 5 == 4 else float(i), clock(0, i)) for i in range(60)]
    data += [(None, "t1", None, clock(0, 59)), (1, None, 8.0, clock(0, 1)), (2, None, None, clock(0, 2))]
    fill = lambda: stateful.impute_mean(feed.stream(), "v", 2, output="o", delay="2 hours", slot_ms=600_000, buckets=1)
    for part in (data[1::2], data[::2]):
        feed.add(part, schema)
        assert feed.run(fill()).count() == 0
    feed.add([(3, "heartbeat", None, clock(9))], schema)
    got = rows(feed.run(fill()).select("msg_id", "taxi_identifier", F.round("o", 9)))
    batch = impute_mean(spark.createDataFrame(data, schema), "v", 2, order=("event_time", "msg_id"), output="o")
    assert got == rows(batch.select("msg_id", "taxi_identifier", F.round("o", 9)))


def test_batches_of_one_bucket_pass_the_gate_and_expire_apart(feed, rows):
    schema = "batch_id bigint, arrival bigint, event_time timestamp"
    big = (1 << 60) + 1
    gate = lambda: stateful.batch_gate(feed.stream(), 3, delay="1 minute", idle_ms=3_600_000, buckets=1)
    feed.add([(b, big + n, clock(0, n)) for b in range(50) for n in range(2)] + [(None, n, clock(0)) for n in (7, 5, 6, 4)], schema)
    assert rows(feed.run(gate()), "batch_id", "arrival") == [(None, 6)]
    feed.add([(b, None if b == 3 else big + 2, clock(0, 30)) for b in range(0, 50, 2)] + [(3, None, clock(0, 30)), (1, big, None)], schema)
    passed = [(None, 6), (1, big), (3, None), *[(b, big + 2) for b in range(0, 50, 2)]]
    assert rows(feed.run(gate()), "batch_id", "arrival") == sorted(passed, key=repr)
    feed.add([(99, 1, clock(5))], schema)
    feed.run(gate())
    # batch 5 was forgotten; batch 1, whose last item has no time, was not and stays passed
    feed.add([(5, 8, clock(5)), (1, 8, clock(5))], schema)
    assert rows(feed.run(gate()), "batch_id", "arrival") == sorted(passed, key=repr)


def test_landed_lines_are_small_files_of_the_same_lines(spark, rows, path, monkeypatch):
    from sluiceway.plans import record_queries

    monkeypatch.setattr(record_queries, "LINES_PER_FILE", 40)
    lines = spark.range(100).selectExpr("concat('T', id, ',{\"bt\":', id, repeat('x', 200), '}') AS line").coalesce(1)
    record_queries.write_lines(lines, path)
    files = spark.read.format("binaryFile").load(path)
    assert files.count() == 3 and files.agg(F.sum("length")).first()[0] < 100 * 200 / 4
    assert rows(spark.read.text(path)) == rows(lines)
