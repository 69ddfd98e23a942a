"""Sensor views over the driver tables, in SQL text both engines read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sluiceway.session import scratch

# name -> (text, tables it reads)
VIEWS: dict[str, tuple[str, tuple[str, ...]]] = {}

VIEWS["trips"] = ("""
SELECT event_id AS msg_id,
       'T' || CAST(user_id AS STRING) AS taxi_identifier,
       'H' || CAST(event_id % 997 AS STRING) AS hack_license,
       1704067200000 + event_id * 1000 AS bt,
       CAST((event_id * 37) % 4000 AS DOUBLE) AS trip_time_in_secs,
       value / CAST(10 AS DOUBLE) AS trip_distance,
       value * CAST(2 AS DOUBLE) AS fare_amount,
       CASE WHEN event_id % 5 = 0 THEN NULL
            ELSE CAST((event_id * 3) % 12 AS DOUBLE) / CAST(10 AS DOUBLE) END AS surcharge,
       CAST((event_id * 13) % 500 AS DOUBLE) / CAST(10 AS DOUBLE) AS tip_amount,
       CAST((event_id * 7) % 200 AS DOUBLE) / CAST(10 AS DOUBLE) AS tolls_amount,
       CASE WHEN event_id % 3 = 0 THEN 'CSH' ELSE 'CRD' END AS payment_type
FROM {events}""", ("events",))

VIEWS["metadata"] = ("""
SELECT 'T' || CAST(c_custkey AS STRING) AS taxi_identifier,
       c_mktsegment AS taxi_company, c_name AS drivername, n_name AS taxi_city
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey
WHERE c_custkey > 0""", ("customer", "nation"))

# annotation lines, some keys given twice: the later line counts
VIEWS["annotation_lines"] = ("""
SELECT c_custkey AS line_no, 'T' || CAST(c_custkey AS STRING) || ':' || c_mktsegment || ',' || c_name AS value
FROM {customer} WHERE c_custkey > 0
UNION ALL
SELECT c_custkey - 1000000 AS line_no, 'T' || CAST(c_custkey AS STRING) || ':old,old' AS value
FROM {customer} WHERE c_custkey % 4 = 1""", ("customer",))

VIEWS["batch_items"] = ("""
SELECT event_id AS item_id, CAST(FLOOR(event_id / 10) AS BIGINT) AS batch_id,
       'img_' || CAST(event_id AS STRING) || '.json' AS filename, event_id AS arrival
FROM {events} WHERE event_id % 70 <> 6""", ("events",))

VIEWS["detections"] = ("""
SELECT vec_id AS item_id, CAST(FLOOR(vec_id / 10) AS BIGINT) AS batch_id,
       CASE WHEN vec_id % 50 = 9 THEN '[{{broken' WHEN vec_id % 50 = 8 THEN '[]'
       ELSE '[{{"label":"' || CASE WHEN label = 3 THEN 'person' ELSE 'obj' || CAST(label AS STRING) END
         || '","confidence":0.5,"topleft":{{"x":1,"y":2}},"bottomright":{{"x":3,"y":4}}}}]' END AS content,
       vec_id % 50 NOT IN (8, 9) AND label = 3 AS is_person
FROM {embeddings}""", ("embeddings",))

VIEWS["stages"] = ("""
SELECT 'P' || CAST(p_partkey AS STRING) AS stage, p_partkey % 25 + 1 AS device,
       CASE WHEN p_size > 45 THEN (p_partkey + 3) % 25 + 1 ELSE p_partkey % 25 + 1 END AS new_device,
       p_partkey % 100 = 7 AS vanished
FROM {part}
UNION ALL
SELECT 'S' || CAST(s_suppkey AS STRING) AS stage, CAST(s_nationkey + 1 AS BIGINT) AS device,
       CAST(s_nationkey + 1 AS BIGINT) AS new_device, false AS vanished
FROM {supplier}""", ("part", "supplier"))

VIEWS["wires"] = ("""
SELECT 'P' || CAST(l_partkey AS STRING) AS src, 'S' || CAST(l_suppkey AS STRING) AS dst FROM {lineitem}
""", ("lineitem",))

VIEWS["catalog_changes"] = ("""
SELECT event_id AS seq, CASE WHEN event_id % 10 = 0 THEN 'DELETE' ELSE 'POST' END AS op,
       '/device/' || event_type || '/' || CAST(user_id AS STRING) AS href,
       '{{"href":"/device/' || event_type || '/' || CAST(user_id AS STRING)
         || '","item-metadata":[{{"rel":"CPUUtil","val":"' || CAST(event_id % 100 AS STRING) || '"}}]}}' AS body
FROM {events}""", ("events",))

_ITEM = """
SELECT '/device/{kind}/' || CAST(c_custkey AS STRING){tail} AS href,
       '{{{{"href":"/device/{kind}/' || CAST(c_custkey AS STRING){tail} || '","item-metadata":[{rels}]}}}}' AS body
FROM {{customer}}{where}"""


def _item(kind: str, rels: list[tuple[str, str]], tail: str = "", where: str = "") -> str:
    text = ",".join('{{{{"rel":"' + r + '","val":"\' || ' + v + ' || \'"}}}}' for r, v in rels)
    # one level of braces is spent here, one when the tables are named
    return _ITEM.format(kind=kind, rels="@@", tail=tail, where=where).replace("@@", text.replace("{{{{", "{{").replace("}}}}", "}}"))


_ID = "CAST(c_custkey AS STRING)"
VIEWS["device_items"] = (" UNION ALL ".join([
    _item("meta", [("DeviceUUID", _ID), ("Total CPU Available", "'400'"),
                   ("Total Memory Available", "'1000'"),
                   ("isAccelerated", "CASE WHEN c_custkey % 2 = 0 THEN '1' ELSE 'false' END")]),
    _item("cpu", [("CPUUtil", "CAST(c_custkey % 100 AS STRING) || '.5'")]),
    _item("mem", [("MemUtil", "CAST(c_custkey % 77 AS STRING) || '.25'")]),
    _item("ip", [("IP", "'10.0.0.' || CAST(c_nationkey AS STRING)")], where=" WHERE c_custkey % 9 <> 0"),
    _item("containers", [("Port", "CAST(9000 + c_custkey % 50 AS STRING)"), ("DeviceUUID", _ID),
                         ("ContainerUUID", "'c0-' || " + _ID)], tail=" || '/c0'"),
    _item("containers", [("Port", "CAST(9500 + c_custkey % 50 AS STRING)"), ("DeviceUUID", _ID),
                         ("ContainerUUID", "'c1-' || " + _ID)], tail=" || '/c1'", where=" WHERE c_custkey % 3 = 0"),
    _item("input_stream", [("Type", "'camera'"), ("DeviceUUID", _ID),
                           ("Input_Stream_UUID", "'s-' || " + _ID)], where=" WHERE c_custkey % 4 = 0"),
]), ("customer",))

VIEWS["oplog_lines"] = ("""
SELECT CAST(user_id AS STRING) || ',' || event_type || ',' || CAST(event_id * 1000 AS STRING) || ',ENTRY' AS line
FROM {events}
UNION ALL
SELECT CAST(user_id AS STRING) || ',' || event_type || ','
       || CAST(event_id * 1000 + 1 + (event_id * 37) % 400 AS STRING) || ',EXIT' AS line
FROM {events} WHERE event_id % 11 <> 0""", ("events",))

VIEWS["usage_lines"] = ("""
SELECT CASE WHEN event_id % 41 = 0 THEN 'agent restarted' ELSE
       '2024-01-' || lpad(CAST(1 + event_id % 28 AS STRING), 2, '0') || ' '
       || lpad(CAST((event_id * 7) % 24 AS STRING), 2, '0') || ':'
       || lpad(CAST(event_id % 60 AS STRING), 2, '0') || ':00 CPU usage = '
       || CAST(event_id % 100 AS STRING) || '.5    MEM usage = ' || CAST((event_id * 3) % 100 AS STRING) || '.25'
       END AS line
FROM {events}""", ("events",))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, or a view over some."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text, reads = VIEWS[name]
    return spark.sql(text, **{r: table(spark, sf_dir, r) for r in reads})


def with_views(*names: str) -> str:
    """``WITH`` clause that defines the views for the SQL twin of a query."""
    parts = [f"{n} AS ({VIEWS[n][0].format(**{r: r for r in VIEWS[n][1]})})" for n in names]
    return "WITH " + ",\n".join(parts) + "\n"


_landed: dict[tuple[str, str, str], str] = {}


def landed(spark: SparkSession, sf: str, name: str, write: Callable[[str], None]) -> str:
    """Write a landing area once per session and remember where."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _landed:
        path = scratch(spark, name)
        write(path)
        _landed[key] = path
    return _landed[key]
