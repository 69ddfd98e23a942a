"""Edge cases of single-record operators."""

import pytest
from pyspark.sql import functions as F

from sluiceway.functions.frames import pack_envelope, pack_frame, unpack_envelope, unpack_frame
from sluiceway.operators import bloom, clean


def parsed(spark, *lines):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, line string")
    return [r for r in clean.senml_parse(df).orderBy("i").collect()]


def test_senml_edges(spark):
    out = parsed(
        spark,
        'k,{"e":[{"n":"a","v":"1"}]}',
        'k,{"bt":7,"e":[{"v":2.5},{"n":"b","sv":"x"}]}',
        'k,{"bt":7,"e":[{"n":"a","v":1},{"n":"b","v":2},{"n":"a","v":3}]}',
        'k,{"bt":7,"e":[{"n":"a","v":"null"},{"n":"b","sv":""}]}',
        'k,{"bt":7,"e":[{"n":"a"',
        '{"no comma": 1}',
        'k,{"bt":5}',
    )
    assert [r["timestamp"] for r in out] == [0, 7, 7, 7, None, None, None]
    assert out[0]["observations"] == {"a": "1"}
    assert out[1]["observations"] == {"": "2.5", "b": "x"}
    assert out[2]["observations"] == {"a": "3", "b": "2"}
    assert out[3]["observations"] == {"a": None, "b": None}
    assert [r["bad_line"] is not None for r in out] == [False] * 4 + [True] * 3
    assert out[5]["bad_line"] == '{"no comma": 1}'


def test_senml_round_trip(spark, rows):
    fields = [("taxi", "string", "sv"), ("fare_amount", "dollar", "v")]
    df = spark.createDataFrame([(1, 'a"b,c', 2.5), (2, "ü", None)], "timestamp bigint, taxi string, fare_amount double")
    text = clean.senml_emit(df, fields, key="taxi").select("line")
    # the key may hold a comma, so only the second row survives the text form
    back = clean.as_columns(clean.senml_parse(text.where("line like 'ü%'")), ["taxi", "fare_amount"])
    assert rows(back, "timestamp", "taxi", "fare_amount") == [(2, "ü", None)]


def test_text_survives(spark, rows):
    odd = ['"', "\\", "a,b", "{}", "tab\there", "line\nbreak", "☃ü", " pad ", "[1]", "nullable"]
    df = spark.createDataFrame(list(enumerate(odd)), "timestamp bigint, s string")
    text = clean.senml_emit(df, [("s", "string", "sv")], key="timestamp").select("line")
    back = clean.as_columns(clean.split_bad(clean.senml_parse(text))[0], ["s"])
    assert rows(back, "timestamp", "s") == rows(df)
    packed = df.select(pack_envelope(F.create_map(F.lit("k"), F.col("s")), F.col("s")).alias("v"))
    unpacked = packed.select(unpack_envelope(F.col("v")).alias("e")).select(F.col("e.attributes")["k"], "e.content")
    assert rows(unpacked) == sorted([(x, x) for x in odd], key=repr)


def test_ranges_are_open(spark, rows):
    df = spark.createDataFrame([(1.0, 5.0), (1.1, 5.0), (2.0, 5.0), (None, 5.0), (1.5, 9.0)], "a double, b double")
    spec = "a:1:2,b:0:8"
    assert rows(clean.range_filter(df, spec), "a") == [(1.1,)]
    assert clean.range_filter(df, spec, mode="last").count() == 4
    with pytest.raises(ValueError):
        clean.in_ranges(spec, "first")


def test_labels(spark, rows):
    df = spark.createDataFrame(
        [(1, "[]"), (1, '[{"label":"cat"},{"label":"person","confidence":0.4}]'), (2, "[{oops"), (3, None)],
        "batch_id int, content string",
    )
    assert rows(clean.label_filter(df, "person"), "batch_id") == [(1,)]
    assert rows(clean.batch_has_label(df, "person")) == [(1, "", "1")]


def test_split_text(spark, rows):
    df = spark.createDataFrame([(1, "h\na\nb\nc\n\n"), (2, ""), (3, "\n\n"), (4, "h")], "id int, text string")
    got = rows(clean.split_text(df, lines=2), "id", "fragment_index", "fragment")
    assert got == [(1, 0, "h\na"), (1, 1, "b\nc"), (4, 0, "h")]
    kept = rows(clean.split_text(df, lines=2, trim_newlines=False), "id", "fragment_index", "fragment")
    assert (1, 2, "\n") in kept and (2, 0, "") in kept
    headed = rows(clean.split_text(df.where("id = 1"), lines=2, header_lines=1), "fragment_index", "fragment")
    assert headed == [(0, "h\na\nb"), (1, "h\nc")]


def test_coerce(spark):
    values = ["t", "h", "p", "d", '"5"', "null", "1", "2", "3", "4", "CRD", "x", "", "0.5", "1", "2", "3"]
    df = spark.createDataFrame([(",".join(values),), (",".join(values + ["co", "dr", "ci"]),)], "line string")
    plain, annotated = clean.coerce_trip(df).collect()
    assert plain["trip_time_in_secs"] == 5.0 and plain["trip_distance"] == 0.0 and plain["fare_amount"] == 0.0
    assert plain["taxi_company"] is None and annotated["taxi_city"] == "ci"


@pytest.mark.parametrize("ids", [[0, 1, -1, 2**63 - 1, -(2**63)]])
def test_frame_round_trip(spark, rows, ids):
    df = spark.createDataFrame([(i, "entrée-☃", b"") for i in ids] + [(9, "", bytes(range(256)))], "id bigint, t string, p binary")
    back = df.select(unpack_frame(pack_frame(F.col("id"), F.col("t"), F.col("p"))).alias("f")).select("f.*")
    assert rows(back) == rows(df)
    assert bytes(df.select(pack_frame(F.lit(1), F.lit("ab"), F.lit(b"z"))).first()[0]) == b"\0" * 7 + b"\1\0\0\0\2abz"


@pytest.mark.parametrize("shard_bits", [1 << 19, 2048])
def test_bloom(spark, shard_bits):
    known = spark.range(5000).select(F.concat(F.lit("k"), F.col("id")).alias("key"))
    others = spark.range(20000).select(F.concat(F.lit("x"), F.col("id")).alias("key"))
    model = bloom.bloom_train(known, "key", 5000, 0.02, shard_bits)
    assert model.size_bytes < 10_000
    assert bloom.bloom_filter(known, model, "key").count() == 5000
    false = bloom.bloom_filter(others, model, "key")
    assert false.count() < 20000 * 0.04
    shuffled = bloom.bloom_filter(others, model, "key", max_bytes=0)
    assert "strategy=broadcast" not in shuffled._jdf.queryExecution().optimizedPlan().toString()
    assert shuffled.count() == false.count()
    missing = spark.createDataFrame([(None,)], "key string")
    assert bloom.bloom_filter(missing, model, "key").count() == 1
    assert bloom.bloom_filters(known, {"key": model}).columns == ["key"]


def test_attributes_and_routes(spark, rows):
    df = spark.createDataFrame([({"a": "1"}, 5)], "attributes map<string,string>, v int")
    assert clean.set_attribute(df, {"a": "2", "b": "3"}).first()["attributes"] == {"a": "2", "b": "3"}
    routed = clean.route(spark.range(6), {"low": F.col("id") < 2, "mid": F.col("id") < 4})
    out = clean.branches(routed, ["low", "mid", "failure"], auto_terminate=["mid"])
    assert {k: v.count() for k, v in out.items()} == {"low": 2, "failure": 2}
