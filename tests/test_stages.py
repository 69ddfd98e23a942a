"""Joins, gates, catalogue and telemetry beyond what the SQL twins cover."""

import sys

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sluiceway.operators import analytics, batches, catalog, joins, telemetry
from sluiceway.plans.compose import compose


def test_assembly(spark, rows):
    df = spark.createDataFrame(
        [(1, "a", "x", 1), (1, "b", "y", 2), (1, "a", "z", 3), (2, "a", "q", 1), (3, "a", None, 1), (3, "b", "r", 2),
         (1, "other", "o", 9)],
        "msg_id int, obs_type string, obs_val string, seq int",
    )
    assert rows(joins.assemble_message(df, ["a", "b"]), "msg_id", "joined_value") == [(1, "z@y"), (3, "null@r")]
    assert joins.assemble_message(df, ["a", "b"], expected=1).count() == 3
    carried = df.withColumn("paid", F.when(F.col("msg_id") == 1, "CRD"))
    got = joins.assemble_message(carried, ["a", "paid", "b"], meta=["paid"])
    assert rows(got, "msg_id", "joined_value") == [(1, "z@CRD@y")]


def test_annotation(spark, rows):
    text = spark.createDataFrame([("k@1",), ("z@2",)], "joined_value string")
    lines = spark.createDataFrame([(1, "k:old"), (2, "k:new"), (3, "broken")], "n int, value string")
    got = joins.annotate_text(text, joins.read_annotations(lines), line_no="n")
    assert rows(got, "joined_value") == [("k,1,new",), ("z,2",)]
    big = joins.annotate_text(text, joins.read_annotations(lines), line_no="n", max_bytes=0)
    assert rows(big, "joined_value") == rows(got, "joined_value")


@pytest.mark.parametrize("n,expected", [(9, []), (10, [(9,)]), (11, [(9,)])])
def test_gate_sizes(spark, rows, n, expected):
    df = spark.range(n).select(F.lit(1).alias("batch_id"), F.col("id").alias("arrival"))
    assert rows(batches.batch_gate(df), "arrival") == expected
    complete = joins.join_batch_complete(df, df, 10)
    assert complete.count() == (n if n >= 10 else 0)


def test_transport(spark, rows):
    wires = spark.createDataFrame([("a", "b"), ("a", "c"), ("c", "a"), ("b", "d"), ("a", "a2")], "src string, dst string")
    placed = spark.createDataFrame([("a", 1), ("a2", 1), ("b", 2), ("c", 3), ("d", 4)], "stage string, device int")
    seen = spark.createDataFrame([(1, 2, True), (3, 1, True), (2, 4, False)], "src int, dst int, visible boolean")
    assert rows(joins.link_transport(wires, placed, seen), "src", "dst", "transport") == [
        ("a", "a2", "LOCAL"), ("a", "b", "PUSH"), ("a", "c", "PULL"), ("b", "d", "BROKER"), ("c", "a", "PUSH")]


def test_apply_batch_in_slices(spark, rows):
    df = spark.range(1000).select(F.when(F.col("id") < 900, 1).otherwise(F.col("id") % 7 + 2).alias("batch_id"), "id")
    sizes = []

    def total(frame):
        return pd.DataFrame({"batch_id": frame["batch_id"].iloc[:1], "rows": len(frame), "largest": len(frame)})

    merge = [F.sum("rows").alias("rows"), F.max("largest").alias("largest")]
    out = batches.apply_batch(df, total, "batch_id long, rows long, largest long", merge=merge, slice_rows=100)
    got = {r["batch_id"]: r for r in out.collect()}
    assert got[1]["rows"] == 900 and got[1]["largest"] < 200 and sum(r["rows"] for r in got.values()) == 1000
    whole = batches.apply_batch(df, total, "batch_id long, rows long, largest long", merge)
    assert {r["batch_id"]: r["rows"] for r in whole.collect()} == {b: r["rows"] for b, r in got.items()}


def test_commands(spark, rows):
    df = spark.createDataFrame([(3,), (3,), (5,)], "batch_id int")
    out = batches.run_per_batch(df, ["printf", "done %s\\n"], "/data")
    assert rows(out) == [(3, "/data/3", "done /data/3\n"), (5, "/data/5", "done /data/5\n")]
    lines = spark.range(25000).select(F.concat(F.lit("r"), "id").alias("line"))
    piped = batches.pipe_lines(lines, "line", [sys.executable, "-c", "import sys\nfor x in sys.stdin: print(x.upper(), end='')"])
    assert piped.where("line like 'R%'").count() == 25000
    with pytest.raises(Exception, match="ended with"):
        batches.pipe_lines(lines, "line", ["false"]).count()


def test_children_pages(spark):
    df = spark.range(1000).select(
        F.lit("d").alias("device_id"), F.lit("containers").alias("child_kind"), F.col("id").cast("string").alias("child_id"),
        F.lit(1).alias("port"), F.lit(None).cast("string").alias("type"))
    pages = catalog.children_per_device(df, page_rows=100).collect()
    assert len(pages) == 10 and sum(p["children_count"] for p in pages) == 1000
    assert len({c["child_id"] for p in pages for c in p["children"]}) == 1000


def test_catalogue(spark, rows):
    items = spark.createDataFrame(
        [("/device/meta/1", [("isAccelerated", "1"), ("DeviceUUID", "1")]), ("/x/device/meta/2", [("DeviceUUID", "2")])],
        "href string, `item-metadata` array<struct<rel string, val string>>",
    )
    assert catalog.catalog_prefix(items, "/device").count() == 1
    assert catalog.catalog_prefix(items, "/device", "contains").count() == 2
    assert rows(catalog.pivot_devices(items), "device_id", "accelerated") == [("1", True)]
    assert rows(catalog.pivot_devices(items, strict_boolean=True), "accelerated") == [(False,)]
    doc = catalog.catalog_envelopes(items, "mine", 1000).first()["document"]
    assert '"catalogue-metadata"' in doc and '"item-metadata"' in doc
    changes = spark.createDataFrame(
        [(1, "POST", "a", "1"), (2, "POST", "a", "2"), (3, "POST", "b", "1"), (4, "DELETE", "b", None), (5, "DELETE", "z", None)],
        "seq int, op string, href string, body string")
    assert rows(catalog.catalog_apply(changes)) == [("a", "2")]


def test_usage(spark, rows):
    lines = spark.createDataFrame(
        [("2020-01-01 10:00:00 CPU usage = 10.5    MEM usage = 20",), ("2020-01-01 10:30:00 CPU usage = 11.5    MEM usage = 30",),
         ("noise",)], "line string")
    usage = telemetry.parse_usage(lines)
    assert rows(telemetry.resource_usage(usage), "samples", "avg_cpu", "max_mem") == [(2, 11.0, 30.0)]


def test_second_moment_is_exact_past_64_bits(spark):
    one = spark.range(1).select(F.lit(4_000_000_000).alias("n"))
    square = F.col("n").cast("decimal(19,0)") * F.col("n").cast("decimal(19,0)")
    assert int(one.select(F.sum(square)).first()[0]) == 16 * 10**18
    assert int(analytics.second_moment(spark.range(10).selectExpr("id % 2 as v"), "v").first()[0]) == 50


def test_compose(spark):
    out = compose(
        {"split": lambda d: {"even": d.where("id % 2 = 0"), "odd": d.where("id % 2 = 1")}, "join": lambda d: d},
        [("in", "split"), ("split", "even", "join"), ("split", "odd", "join")], {"in": spark.range(10)})
    assert list(out) == [("join", "success")] and out["join", "success"].count() == 10
    with pytest.raises(KeyError):
        compose({}, [("in", "nowhere")], {"in": spark.range(1)})
    with pytest.raises(KeyError):
        compose({"a": lambda d: d}, [("in", "no-such", "a")], {"in": spark.range(1)})
