"""A key that is cut into chunks gives what the plain window gives."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sluiceway.operators import analytics, batches, sequence, telemetry
from sluiceway.operators.impute import impute_mean

PLAIN, CUT = 10**9, 40


@pytest.fixture(scope="module")
def readings(spark):
    """Sensor ``hot`` holds most rows, in bursts, with long runs of missing values."""
    rng = random.Random(5)
    out, t = [], 0
    for i in range(3000):
        t += 1 if rng.random() < 0.9 else rng.choice([50, 5000])
        sensor = "hot" if rng.random() < 0.7 else f"s{rng.randrange(40)}"
        gap = 900 < i < 1400
        value = None if gap or rng.random() < 0.3 else round(rng.uniform(0, 100), 2)
        out.append((i, t, sensor, value))
    return spark.createDataFrame(out, "msg_id bigint, t bigint, sensor string, value double").cache()


def same(a, b, digits=9):
    a, b = a.collect(), b.collect()
    assert len(a) == len(b)
    left, right = {r[0]: r[1:] for r in a}, {r[0]: r[1:] for r in b}
    assert left.keys() == right.keys()
    for k, v in left.items():
        for x, y in zip(v, right[k]):
            assert (x is None) == (y is None), (k, v, right[k])
            assert x == y if not isinstance(x, float) else abs(x - y) < 10**-digits, (k, v, right[k])


def test_chunks_follow_the_order(readings):
    cut = sequence.chunked(readings, ["sensor"], ["t", "msg_id"], CUT)
    assert cut.hot
    hot = [r for r in cut.hot_rows.orderBy("t", "msg_id").collect()]
    assert {r["sensor"] for r in hot} >= {"hot"}
    chunks = [r["_chunk"] for r in hot if r["sensor"] == "hot"]
    assert chunks == sorted(chunks) and len(set(chunks)) > 20
    largest = max(chunks.count(c) for c in set(chunks))
    assert largest <= 3 * CUT
    assert cut.rows.count() == readings.count()


@pytest.mark.parametrize("order", [["t", "n"], ["word", "n"], ["at", "n"]])
def test_chunks_stay_bounded_in_bursts_and_ties(spark, order):
    """Nine rows of ten lie in one burst, and a third of all share one first order value."""
    n, limit = 20_000, 400
    df = spark.range(n).select(
        F.lit("k").alias("sensor"), F.col("id").alias("n"),
        F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 10 > 0, F.col("id") % 5000).otherwise(F.col("id") * 10**6).alias("t"),
    ).withColumn("word", F.concat(F.lit("w"), F.col("t"))).withColumn("at", F.timestamp_seconds("t").cast("timestamp_ntz"))
    cut = sequence.chunked(df, ["sensor"], order, limit)
    sizes = cut.hot_rows.groupBy("_chunk").count()
    assert sizes.agg(F.max("count")).first()[0] <= 2 * limit
    assert sizes.agg(F.sum("count")).first()[0] == n
    spans = cut.hot_rows.groupBy("_chunk").agg(F.min(F.struct(*order)).alias("low"), F.max(F.struct(*order)).alias("high"))
    spans = spans.orderBy("_chunk").collect()
    assert all(a["high"] < b["low"] for a, b in zip(spans, spans[1:]))


def test_no_hot_key_means_the_plain_plan(readings):
    cut = sequence.chunked(readings, ["sensor"], ["t"], PLAIN)
    assert not cut.hot and cut.by == ["sensor"]


@pytest.mark.parametrize("window", [1, 5, 60])
def test_impute(readings, window):
    run = lambda hot: impute_mean(readings, "value", window, "sensor", ["t", "msg_id"], "out", hot).select("msg_id", "out")
    same(run(CUT), run(PLAIN))


def test_impute_edges(spark, rows):
    df = spark.createDataFrame(
        [(1, "a", None), (2, "a", 2.0), (3, "a", None), (4, "a", 4.0), (5, "a", None), (6, "a", None)],
        "msg_id bigint, taxi_identifier string, v double",
    )
    got = impute_mean(df, "v", 1, output="o").orderBy("msg_id").select("o")
    assert [r[0] for r in got.collect()] == [None, 2.0, 2.0, 4.0, 4.0, 4.0]
    assert rows(impute_mean(df, "v", 0), "msg_id", "v") == rows(df, "msg_id", "v")


def test_positions(readings):
    w = Window.partitionBy("sensor").orderBy("t", "msg_id")
    expected = readings.select("msg_id", F.row_number().over(w).cast("bigint"))
    got, _ = sequence.with_position(readings, ["sensor"], ["t", "msg_id"], CUT)
    same(got.select("msg_id", "_pos"), expected)


def test_blocks(readings, rows):
    def run(hot):
        return analytics.block_aggregate(
            readings, [F.count("value").alias("n"), F.min("msg_id").alias("first")], 5, "sensor", ["t", "msg_id"], False, hot
        )

    assert rows(run(CUT), "sensor", "block", "n", "first") == rows(run(PLAIN), "sensor", "block", "n", "first")


def test_kalman(readings):
    def run(hot):
        return analytics.kalman(readings, "value", "sensor", ["t", "msg_id"], hot_rows=hot).select("msg_id", "estimate")

    same(run(CUT), run(PLAIN))


def test_kalman_is_the_recursion(spark):
    values = [random.Random(i).uniform(0, 9) for i in range(400)]
    df = spark.createDataFrame([(i, "a", v) for i, v in enumerate(values)], "msg_id bigint, taxi_identifier string, v double")
    got = [r["estimate"] for r in analytics.kalman(df, "v").orderBy("msg_id").collect()]
    x, p, expected = None, 30.0, []
    for z in values:
        p += 0.125
        k = p / (p + 0.32)
        x = z if x is None else x + k * (z - x)
        p *= 1 - k
        expected.append(x)
    assert max(abs(a - b) for a, b in zip(got, expected)) < 1e-9


def test_regression(readings):
    def run(hot):
        return analytics.sliding_regression(
            readings, "value", "sensor", ["t", "msg_id"], hot_rows=hot
        ).select("msg_id", "slope", "forecast")

    same(run(CUT), run(PLAIN), 6)


def test_pairs(spark, readings, rows):
    log = readings.select(
        "sensor", (F.col("t") * 10 + F.col("msg_id") % 10).alias("ts_ms"),
        F.when(F.col("msg_id") % 3 == 0, "ENTRY").otherwise("EXIT").alias("event"),
    ).distinct()
    run = lambda hot: telemetry.pair_entry_exit(log, ["sensor"], ["ts_ms", "event"], hot)
    assert run(CUT).count() > 0
    assert rows(run(CUT), "sensor", "entry_ms", "exit_ms") == rows(run(PLAIN), "sensor", "entry_ms", "exit_ms")


def test_gate_repeats(readings, rows):
    def run(hot):
        return batches.batch_gate(readings, 7, "sensor", ["t", "msg_id"], True, hot)

    assert rows(run(CUT), "msg_id") == rows(run(PLAIN), "msg_id")


def test_dense_index(spark):
    df = spark.range(5000).select((F.col("id") * 3).alias("k"))
    got = sequence.dense_index(df, ["k"], "i")
    assert [r["i"] for r in got.orderBy("i").collect()] == list(range(5000))


def test_lookup_measures_its_side(spark):
    big = spark.range(100).withColumnRenamed("id", "k")
    side = spark.range(50).select(F.col("id").alias("k"), F.lit("x" * 20).alias("v"))
    assert sequence.fits_broadcast(side) and not sequence.fits_broadcast(side, 500)
    small = sequence.lookup(big, side, "k")._jdf.queryExecution().optimizedPlan().toString()
    large = sequence.lookup(big, side, "k", max_bytes=500)._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in small and "strategy=broadcast" not in large


def test_chunks_stay_whole_over_several_files(spark, tmp_path):
    """Files hold the rows in order, so a chunk that is not regrouped would show."""
    n = 200_000
    rows = spark.range(0, n, 1, 8).select(
        F.col("id").alias("msg_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("T"), F.col("id") % 5000)).alias("taxi_identifier"),
        ((F.col("id") * 37) % 1000 / 10).alias("v"))
    rows.write.parquet(str(tmp_path / "r"))
    df = spark.read.parquet(str(tmp_path / "r"))
    run = lambda hot: analytics.kalman(df, "v", output="o", hot_rows=hot).agg(F.count("*"), F.round(F.sum("o"), 3)).first()
    assert run(3000) == run(PLAIN)
    starts = analytics._chunk_starts(
        sequence.chunked(df, ["taxi_identifier"], ["msg_id"], 3000), "v", analytics._Gains(0.125, 0.32, 30.0))
    assert starts.count() == starts.select("taxi_identifier", "_chunk").distinct().count() > 60
