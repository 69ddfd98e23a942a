"""Queries over single records: SenML, projection, filters, Bloom, queue payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluiceway.operators import analytics, batches, bloom, clean
from sluiceway.plans.tables import landed, table, with_views
from sluiceway.schemas import TRIP_RANGES_WITH_TOLLS
from sluiceway.sinks import queues as queue_sinks
from sluiceway.sources import queues as queue_sources

# (name, unit, kind) of the trip view's columns
TRIP_VIEW_FIELDS = (
    ("msg_id", "count", "sv"), ("taxi_identifier", "string", "sv"), ("hack_license", "string", "sv"),
    ("trip_time_in_secs", "second", "v"), ("trip_distance", "meter", "v"),
    ("fare_amount", "dollar", "v"), ("surcharge", "percentage", "v"),
    ("tip_amount", "dollar", "v"), ("tolls_amount", "dollar", "v"), ("payment_type", "string", "sv"),
)
TRIP_VIEW_COLUMNS = tuple(n for n, _, _ in TRIP_VIEW_FIELDS)
#: Lines of a landed file: bounds what a trigger of the flow holds, however large the table.
LINES_PER_FILE = 250_000
BLOOM_EXPECTED, BLOOM_FPP = 2000, 0.01


def trips(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "trips")


def senml_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The trips as SenML text, with every 97th line broken."""
    lines = clean.senml_emit(trips(spark, sf), TRIP_VIEW_FIELDS, "bt", key="taxi_identifier")
    return lines.select(
        F.when(F.col("msg_id") % 97 == 5, F.substring("line", 1, 40)).otherwise(F.col("line")).alias("line")
    )


def write_lines(lines: DataFrame, path: str) -> None:
    """Compressed, in files that one task reads and a few of which make a trigger."""
    lines.write.option("compression", "gzip").option("maxRecordsPerFile", LINES_PER_FILE).text(path)


def landed_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The SenML text as files, which is how a flow meets it."""
    lines = senml_lines(spark, sf)
    path = landed(spark, sf, "senml-lines", lambda p: write_lines(lines, p))
    return spark.read.text(path).withColumnRenamed("value", "line")


def q_senml_parse(spark, sf):
    good, _ = clean.split_bad(clean.senml_parse(landed_lines(spark, sf)))
    wide = clean.as_columns(good, TRIP_VIEW_COLUMNS)
    return wide.select(
        F.col("timestamp").alias("bt"), F.col("msg_id").cast("bigint").alias("msg_id"),
        *TRIP_VIEW_COLUMNS[1:],
    )


def q_senml_emit(spark, sf):
    text = clean.senml_emit(trips(spark, sf), TRIP_VIEW_FIELDS, "bt", output="text")
    shape = "bt bigint, e array<struct<n string, u string, v string, sv string>>"
    return text.select("msg_id", F.inline(F.array(F.from_json("text", shape)))).select(
        "msg_id", "bt",
        F.col("e")[1]["n"].alias("second_name"), F.col("e")[1]["sv"].alias("second_value"),
        F.col("e")[3]["u"].alias("fourth_unit"), F.col("e")[3]["v"].cast("double").alias("fourth_value"),
        F.size("e").cast("bigint").alias("elements"),
    )


def q_project_sensor(spark, sf):
    return clean.project_sensor(trips(spark, sf))


def trip_csv(spark: SparkSession, sf: str) -> DataFrame:
    """Positional trip lines: quoted, with ``null`` for what is missing, some annotated."""
    def number(name):
        return F.coalesce(F.col(name).cast("string"), F.lit("null"))

    line = F.concat_ws(
        ",", "taxi_identifier", "hack_license", F.lit("2013-01-14 03:57:00"), F.col("bt").cast("string"),
        F.concat(F.lit('"'), number("trip_time_in_secs"), F.lit('"')), number("trip_distance"),
        F.lit("-73.9"), F.lit("40.7"), F.lit("-73.7"), F.lit("40.6"), "payment_type",
        number("fare_amount"), number("surcharge"), F.lit("0.5"), number("tip_amount"),
        number("tolls_amount"), F.lit("null"),
    )
    annotated = F.concat(line, F.lit(",acme,"), F.concat(F.lit("d"), F.col("msg_id").cast("string")), F.lit(",NYC"))
    return trips(spark, sf).select("msg_id", F.when(F.col("msg_id") % 2 == 0, annotated).otherwise(line).alias("line"))


def q_coerce_trip(spark, sf):
    return clean.coerce_trip(trip_csv(spark, sf)).select(
        "msg_id", "taxi_identifier", "hack_license", "trip_time_in_secs", "trip_distance",
        "fare_amount", "surcharge", "tip_amount", "total_amount", "payment_type", "taxi_company",
        "drivername", "taxi_city",
    )


def _flow_rows(spark, sf):
    return trips(spark, sf).select(
        "msg_id", F.create_map(F.lit("id"), F.col("msg_id").cast("string"), F.lit("taxi"), F.col("taxi_identifier"))
        .alias("attributes"), F.col("payment_type").alias("content"),
    )


def q_set_attribute(spark, sf):
    rows = clean.set_attribute(_flow_rows(spark, sf), {"id.id2": "2", "taxi": "T"})
    return rows.select(
        "msg_id", F.col("attributes")["id"].alias("id"), F.col("attributes")["id.id2"].alias("id2"),
        F.col("attributes")["taxi"].alias("taxi"),
    )


def q_mark_processed(spark, sf):
    return clean.mark_processed(table(spark, sf, "documents").select("doc_id", F.col("text").alias("content")))


def q_split_text(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return clean.split_text(docs, lines=10).withColumn("fragment_index", F.col("fragment_index").cast("bigint"))


def q_range_filter(spark, sf):
    return clean.range_filter(trips(spark, sf)).select("msg_id", "taxi_identifier", "fare_amount")


def q_range_filter_tolls(spark, sf):
    return clean.range_filter(trips(spark, sf), TRIP_RANGES_WITH_TOLLS).select("msg_id", "tolls_amount")


def q_range_filter_last(spark, sf):
    return clean.range_filter(trips(spark, sf), mode="last").select("msg_id", "surcharge")


def bloom_model(spark, sf) -> bloom.BloomModel:
    known = trips(spark, sf).where("msg_id % 97 < 3").select("hack_license")
    return bloom.bloom_train(known, "hack_license", BLOOM_EXPECTED, BLOOM_FPP, shard_bits=4096)


def q_bloom_train(spark, sf):
    return bloom_model(spark, sf).table.select("shard", F.posexplode("words").alias("word", "bits")).select(
        F.col("shard").cast("bigint").alias("shard"), F.col("word").cast("bigint").alias("word"),
        F.bit_count("bits").cast("bigint").alias("ones"),
    ).where("ones > 0")


def q_bloom_filter(spark, sf):
    rows = trips(spark, sf).withColumn("hack_license", F.when(F.col("msg_id") % 50 != 0, F.col("hack_license")))
    return bloom.bloom_filter(rows, bloom_model(spark, sf), "hack_license").select("msg_id", "hack_license")


def q_bloom_exact(spark, sf):
    known = trips(spark, sf).where("msg_id % 97 < 3").select("hack_license")
    return bloom.exact_filter(trips(spark, sf), known, "hack_license").select("msg_id", "hack_license")


def q_label_filter(spark, sf):
    return clean.label_filter(table(spark, sf, "detections"), "person").select("item_id", "batch_id")


def q_batch_has_label(spark, sf):
    return clean.batch_has_label(table(spark, sf, "detections"), "person")


def q_route(spark, sf):
    routed = clean.route(
        trips(spark, sf),
        {"success": clean.in_ranges(), "splits": F.col("surcharge").isNull()},
    )
    out = clean.branches(routed, ["success", "splits", "failure"], auto_terminate=["failure"])
    return batches.fan_in(*[d.withColumn("relationship", F.lit(n)) for n, d in out.items()]).select(
        "msg_id", "relationship"
    )


def q_user_map(spark, sf):
    return batches.user_map(
        trips(spark, sf).select("msg_id", "payment_type"), _upper, ["payment_type"], "shout", "string"
    ).drop("payment_type")


def _upper(names):
    import pandas as pd

    return pd.Series(names).str.lower() + "!"


_upper.__annotations__ = {}


def q_user_predicate(spark, sf):
    return batches.user_predicate(trips(spark, sf).select("msg_id", "fare_amount"), _dear, ["fare_amount"])


def _dear(fares):
    return fares > 100.0


def q_envelope_json(spark, sf):
    sent = queue_sinks.encode_envelopes(_flow_rows(spark, sf), key="msg_id")
    return sent.select(
        F.col("key").cast("bigint").alias("msg_id"),
        F.get_json_object("value", "$.attributes.taxi").alias("taxi"),
        F.get_json_object("value", "$.content").alias("content"),
    )


def q_kafka_json_source(spark, sf):
    sent = queue_sinks.encode_envelopes(_flow_rows(spark, sf), key="msg_id")
    queue = sent.select(F.col("value").cast("binary").alias("value"))
    return queue_sources.decode_envelopes(queue).select(
        F.col("attributes")["id"].cast("bigint").alias("msg_id"),
        F.col("attributes")["taxi"].alias("taxi"), "content",
    )


def _frame_rows(spark, sf):
    return trips(spark, sf).select(
        (F.col("msg_id") - 50).alias("id"),
        F.when(F.col("msg_id") % 2 == 0, F.lit("entry-caméra")).otherwise(F.lit("gate")).alias("topic_type"),
        F.when(F.col("msg_id") % 10 == 0, F.lit("")).otherwise(F.col("taxi_identifier")).cast("binary").alias("payload"),
    )


def q_envelope_frame(spark, sf):
    sent = queue_sinks.encode_frames(_frame_rows(spark, sf))
    return sent.select(F.col("key").cast("bigint").alias("id"), F.hex("value").alias("frame"))


def q_kafka_frame_source(spark, sf):
    sent = queue_sinks.encode_frames(_frame_rows(spark, sf)).select(
        (F.col("key").cast("bigint") + 1000).alias("offset"), "value"
    )
    return queue_sources.decode_frames(sent).withColumn("payload", F.decode("payload", "UTF-8"))


def q_kafka_sink(spark, sf):
    from sluiceway.session import scratch

    path = scratch(spark, "queue")
    queue_sinks.encode_envelopes(_flow_rows(spark, sf), key="msg_id").write.parquet(path)
    return queue_sources.decode_envelopes(spark.read.parquet(path)).groupBy("content").agg(
        F.count("*").alias("messages"), F.max(F.col("attributes")["id"].cast("bigint")).alias("last_id")
    )


def q_csv_parse(spark, sf):
    schema = T.StructType([
        T.StructField("taxi_identifier", T.StringType()), T.StructField("fare_amount", T.DoubleType()),
        T.StructField("surcharge", T.DoubleType()),
    ])
    lines = trips(spark, sf).select("msg_id", F.concat_ws(
        ",", "taxi_identifier", F.col("fare_amount").cast("string"),
        F.coalesce(F.col("surcharge").cast("string"), F.lit("null"))).alias("line"))
    return analytics.csv_parse(lines, schema)


def q_xml_parse(spark, sf):
    docs = trips(spark, sf).select("msg_id", F.concat(
        F.lit("<trip><taxi>"), "taxi_identifier", F.lit("</taxi><fare unit='dollar'>"),
        F.col("fare_amount").cast("string"), F.lit("</fare></trip>")).alias("xml"))
    parsed = analytics.xml_parse(docs, "taxi string, fare struct<_VALUE: double, _unit: string>")
    return parsed.select("msg_id", "taxi", F.col("fare._VALUE").alias("fare"), F.col("fare._unit").alias("unit"))


def q_table_range_lookup(spark, sf):
    return analytics.table_range(
        table(spark, sf, "events"), "event_type", "click", "event_id", 1, 1_220_000
    ).select("event_id", "user_id", "value")


_T = with_views("trips")
_RANGES = ("trip_time_in_secs > 140 AND trip_time_in_secs < 3155 AND trip_distance > CAST(1.37 AS DOUBLE) "
           "AND trip_distance < CAST(29.86 AS DOUBLE) AND fare_amount > 6 AND fare_amount < 201 "
           "AND tip_amount > CAST(0.65 AS DOUBLE) AND tip_amount < CAST(38.55 AS DOUBLE) "
           "AND surcharge > CAST(0.1 AS DOUBLE) AND surcharge < 1")


def _bloom_sql(tail: str) -> str:
    """Recompute the model's bit positions: same shape, same hashes."""
    bits, shards, hashes = bloom.bloom_shape(BLOOM_EXPECTED, BLOOM_FPP, 4096)
    pair = "('0x' || substr(md5({k}), 1, 12))::BIGINT AS h1, ('0x' || substr(md5({k}), 13, 12))::BIGINT AS h2"
    start = f"h1 // {shards}" if shards > 1 else "h1"
    pos = f"h1 % {shards} AS shard, ({start} + i * h2) % {bits} AS pos"
    return with_views("trips") + f""",
    known AS (SELECT DISTINCT hack_license FROM trips WHERE msg_id % 97 < 3),
    hashed AS (SELECT {pair.format(k='hack_license')} FROM known),
    bits AS (SELECT DISTINCT {pos} FROM hashed, range({hashes}) r(i)),
    keys AS (SELECT DISTINCT hack_license AS k FROM trips),
    probes AS (SELECT k, {pos} FROM (SELECT k, {pair.format(k='k')} FROM keys), range({hashes}) r(i)),
    maybe AS (SELECT p.k FROM probes p LEFT JOIN bits b ON p.shard = b.shard AND p.pos = b.pos
              GROUP BY p.k HAVING count(*) = count(b.pos))
    """ + tail


ORACLES = {
    "q_senml_parse": _T + "SELECT bt, msg_id, taxi_identifier, hack_license, trip_time_in_secs, trip_distance, "
        "fare_amount, surcharge, tip_amount, tolls_amount, payment_type FROM trips WHERE msg_id % 97 <> 5",
    "q_senml_emit": _T + "SELECT msg_id, bt, 'taxi_identifier' AS second_name, taxi_identifier AS second_value, "
        "'second' AS fourth_unit, trip_time_in_secs AS fourth_value, "
        "CAST(CASE WHEN surcharge IS NULL THEN 9 ELSE 10 END AS BIGINT) AS elements FROM trips",
    "q_project_sensor": _T + 'SELECT taxi_identifier AS "SENSORID", trip_time_in_secs, trip_distance, fare_amount, '
        "tip_amount, surcharge FROM trips",
    "q_coerce_trip": _T + "SELECT msg_id, taxi_identifier, hack_license, trip_time_in_secs, trip_distance, fare_amount, "
        "coalesce(surcharge, 0) AS surcharge, tip_amount, CAST(0 AS DOUBLE) AS total_amount, payment_type, "
        "CASE WHEN msg_id % 2 = 0 THEN 'acme' END AS taxi_company, "
        "CASE WHEN msg_id % 2 = 0 THEN 'd' || msg_id END AS drivername, "
        "CASE WHEN msg_id % 2 = 0 THEN 'NYC' END AS taxi_city FROM trips",
    "q_set_attribute": _T + "SELECT msg_id, CAST(msg_id AS VARCHAR) AS id, '2' AS id2, 'T' AS taxi FROM trips",
    "q_mark_processed": "SELECT doc_id, text || chr(10) || ' Processed' AS content FROM documents",
    "q_split_text": """
        WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
                              generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
        parts AS (SELECT doc_id, (n - 1) // 10 AS fragment_index, string_agg(line, chr(10) ORDER BY n) AS fragment
                  FROM lines GROUP BY ALL)
        SELECT doc_id, CAST(fragment_index AS BIGINT) AS fragment_index,
               rtrim(fragment, chr(10) || chr(13)) AS fragment
        FROM parts WHERE rtrim(fragment, chr(10) || chr(13)) <> ''""",
    "q_range_filter": _T + f"SELECT msg_id, taxi_identifier, fare_amount FROM trips WHERE {_RANGES}",
    "q_range_filter_tolls": _T + "SELECT msg_id, tolls_amount FROM trips WHERE "
        f"{_RANGES} AND tolls_amount > CAST(2.5 AS DOUBLE) AND tolls_amount < 18",
    "q_range_filter_last": _T + "SELECT msg_id, surcharge FROM trips WHERE surcharge > CAST(0.1 AS DOUBLE) AND surcharge < 1",
    "q_bloom_train": _bloom_sql("SELECT CAST(shard AS BIGINT) AS shard, CAST(pos // 64 AS BIGINT) AS word, "
                                "count(*) AS ones FROM bits GROUP BY ALL"),
    "q_bloom_filter": _bloom_sql(
        "SELECT msg_id, CASE WHEN msg_id % 50 <> 0 THEN hack_license END AS hack_license FROM trips "
        "WHERE msg_id % 50 = 0 OR hack_license IN (SELECT k FROM maybe)"),
    "q_bloom_exact": _T + "SELECT msg_id, hack_license FROM trips WHERE hack_license IN "
        "(SELECT hack_license FROM trips WHERE msg_id % 97 < 3)",
    "q_label_filter": with_views("detections") + "SELECT item_id, batch_id FROM detections WHERE is_person",
    "q_batch_has_label": with_views("detections") + "SELECT batch_id, '' AS image_id, '1' AS from_filter "
        "FROM detections GROUP BY batch_id HAVING bool_or(is_person)",
    "q_route": _T + f"SELECT msg_id, CASE WHEN {_RANGES} THEN 'success' ELSE 'splits' END AS relationship "
        f"FROM trips WHERE ({_RANGES}) OR surcharge IS NULL",
    "q_user_map": _T + "SELECT msg_id, lower(payment_type) || '!' AS shout FROM trips",
    "q_user_predicate": _T + "SELECT msg_id, fare_amount FROM trips WHERE fare_amount > 100",
    "q_envelope_json": _T + "SELECT msg_id, taxi_identifier AS taxi, payment_type AS content FROM trips",
    "q_kafka_json_source": _T + "SELECT msg_id, taxi_identifier AS taxi, payment_type AS content FROM trips",
    "q_envelope_frame": _T + """SELECT msg_id - 50 AS id,
        upper(lpad(CASE WHEN msg_id < 50 THEN to_hex(CAST(18446744073709551616 + msg_id - 50 AS HUGEINT))
                        ELSE to_hex(msg_id - 50) END, 16, '0')
        || CASE WHEN msg_id % 2 = 0 THEN '0000000D' || hex(encode('entry-caméra')) ELSE '00000004' || hex(encode('gate')) END
        || CASE WHEN msg_id % 10 = 0 THEN '' ELSE hex(encode(taxi_identifier)) END) AS frame FROM trips""",
    "q_kafka_frame_source": _T + "SELECT msg_id - 50 AS id, CASE WHEN msg_id % 2 = 0 THEN 'entry' ELSE 'exit' END AS topic_type, "
        "CAST(msg_id + 950 AS VARCHAR) AS msg_id, CASE WHEN msg_id % 10 = 0 THEN '' ELSE taxi_identifier END AS payload FROM trips",
    "q_kafka_sink": _T + "SELECT payment_type AS content, count(*) AS messages, max(msg_id) AS last_id FROM trips GROUP BY ALL",
    "q_csv_parse": _T + "SELECT msg_id, taxi_identifier, fare_amount, surcharge FROM trips",
    "q_xml_parse": _T + "SELECT msg_id, taxi_identifier AS taxi, fare_amount AS fare, 'dollar' AS unit FROM trips",
    "q_table_range_lookup": "SELECT event_id, user_id, value FROM events WHERE event_type = 'click' "
        "AND event_id BETWEEN 1 AND 1220000",
}
QUERIES = {n: f for n, f in list(globals().items()) if n.startswith("q_")}
