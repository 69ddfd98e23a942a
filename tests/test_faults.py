"""Faults that were found once and must stay mended."""

from pyspark.sql import functions as F

from sluiceway.operators import analytics, joins, telemetry
from sluiceway.sources.files import _relative_dir


def test_gains_fall_for_ever_without_process_noise():
    gains = analytics._Gains(0.0, 1.0, 1.0)
    assert gains.at(29_999) == 1 / 30_001 and not gains.constant(10**9)
    slow = analytics._Gains(1e-9, 1.0, 1.0)
    p = 1.0
    for step in range(12_000):
        p += 1e-9
        gain = p / (p + 1.0)
        p *= 1 - gain
        assert slow.at(step) == gain


def test_kalman_without_process_noise_is_the_mean(spark):
    rows = spark.range(12_000).selectExpr("id AS msg_id", "'T' AS taxi_identifier", "cast(id % 3 AS double) AS v")
    out = analytics.kalman(rows, "v", process_noise=0.0, sensor_noise=1.0, initial_error=1.0)
    last = out.orderBy(F.desc("msg_id")).first()["estimate"]
    assert abs(last - 1.0) < 1e-3


def test_predictions_keep_rows_with_missing_features(spark):
    rows = spark.createDataFrame(
        [(float(i), float(i * i), 2.0 * i + 1) for i in range(5)] + [(None, 1.0, 2.0)], "a double, b double, y double"
    )
    out = analytics.predict(rows, analytics.train_linear(rows, ["a", "b"], "y")).collect()
    assert len(out) == 6 and [r.prediction is None for r in out if r.a is None] == [True]
    assert all(abs(r.prediction - r.y) < 1e-6 for r in out if r.a is not None)


def test_planes_come_from_complete_rows(spark):
    rows = [(i, float(i % 7), float(i % 5) if i % 4 else None, 0.0) for i in range(200)]
    rows = [(i, a, b, 3 * a + 2 * (b or 0) + 1) for i, a, b, _ in rows]
    frame = spark.createDataFrame(rows, "msg_id long, a double, b double, y double")
    out = analytics.retrained_regression(frame, ("a", "b"), "y", every=100).where("msg_id >= 100 and b is not null")
    assert all(abs(r.prediction - r.y) < 1e-9 for r in out.collect())


def test_root_name_again_below(spark):
    path = spark.createDataFrame([("file:/in/a/in/f.txt",), ("file:///in/f.txt",)], "p string")
    assert [r[0] for r in path.select(_relative_dir(F.col("p"), "/in")).collect()] == ["a/in", ""]


def test_unplaced_wires_stay(spark):
    wires = spark.createDataFrame([("a", "b"), ("a", "z")], "src string, dst string")
    placement = spark.createDataFrame([("a", "d1"), ("b", "d1")], "stage string, device string")
    sees = spark.createDataFrame([("d1", "d1", True)], "src string, dst string, visible boolean")
    out = {r.dst: r.transport for r in joins.link_transport(wires, placement, sees).collect()}
    assert out == {"b": "LOCAL", "z": "UNPLACED"}


def test_rows_without_a_reading_stay(spark):
    rows = [(i, f"T{i % 2}", None if i % 3 == 0 else float(i * i % 11)) for i in range(40)]
    frame = spark.createDataFrame(rows, "msg_id int, taxi_identifier string, v double")
    for noise in (0.125, 0.0):
        whole = {r.msg_id: r.estimate for r in analytics.kalman(frame, "v", process_noise=noise).collect()}
        cut = {r.msg_id: r.estimate for r in analytics.kalman(frame, "v", process_noise=noise, hot_rows=6).collect()}
        assert len(whole) == len(cut) == 40 and whole[0] is None
        known = {r.msg_id: r.estimate for r in analytics.kalman(frame.where("v is not null"), "v", process_noise=noise).collect()}
        last = {}
        for i, taxi, v in rows:
            last[taxi] = known[i] if v is not None else last.get(taxi)
            for got in (whole[i], cut[i]):
                assert got == last[taxi] or abs(got - last[taxi]) < 1e-9
    out = {r.msg_id: r.slope for r in analytics.sliding_regression(frame, "v").collect()}
    assert len(out) == 40 and all(out[i] is None for i, _, v in rows if v is None)


def test_percentiles_without_a_buffer(spark):
    rows = [(f"c{i % 3}" if i % 7 else None, 100 * i, 100 * i + i * i % 97, i * i % 97) for i in range(500)]
    pairs = spark.createDataFrame(rows, "class string, entry_ms long, exit_ms long, latency_ms long")
    marks = (0.0, 0.1, 0.5, 0.95, 1.0)
    want = {
        r["class"]: r for r in
        pairs.groupBy("class").agg(*[F.percentile("latency_ms", p).alias(f"p{round(p * 100)}_ms") for p in marks]).collect()
    }
    for hot in (10**9, 20):
        got = telemetry.latency_summary(pairs, percentiles=marks, hot_rows=hot).collect()
        assert len(got) == 4
        for r in got:
            assert all(abs(r[f"p{round(p * 100)}_ms"] - want[r["class"]][f"p{round(p * 100)}_ms"]) < 1e-9 for p in marks)


def test_trees_of_odd_blocks(spark):
    rows = [(i, float(i % 10), "BAD" if i % 10 < 5 else "GOOD") for i in range(60)] + [(70, None, "GOOD"), (75, 1.0, "unknown"), (200, 1.0, "BAD")]
    frame = spark.createDataFrame(rows, "msg_id long, x double, y string")
    out = {r.msg_id: r.predicted for r in analytics.retrained_tree(frame, ["x"], "y", every=30).collect()}
    assert len(out) == 63
    assert all(out[i] is None for i in range(30)) and all(out[i] == y for i, _, y in rows[30:60])
    assert out[70] is None and out[75] == "BAD" and out[200] is None
    one = frame.where("msg_id < 60").withColumn("x", F.lit(1.0))
    assert {r.predicted for r in analytics.retrained_tree(one, ["x"], "y", every=30).where("msg_id >= 30").collect()} == {"BAD"}
