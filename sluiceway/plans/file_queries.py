"""Queries that write driver tables to files and read them back through the sources and sinks."""

from __future__ import annotations

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluiceway.operators.batches import batch_gate, run_per_batch
from sluiceway.plans.record_queries import trip_csv, trips
from sluiceway.plans.tables import landed, table, with_views
from sluiceway.session import scratch
from sluiceway.sinks import files as file_sinks
from sluiceway.sinks import topics as topic_sinks
from sluiceway.sinks import upsert
from sluiceway.sources import dataflow, files, sidecar

def documents_by_lang(spark: SparkSession, sf: str) -> str:
    """Text files ``lang=…/part-*.txt``."""
    docs = table(spark, sf, "documents").select("lang", "text")
    return landed(
        spark, sf, "documents",
        lambda path: docs.hint("rebalance", "lang").write.option("maxRecordsPerFile", 100_000)
        .partitionBy("lang").text(path),
    )


def batch_dirs(spark: SparkSession, sf: str) -> str:
    items = table(spark, sf, "batch_items").select(
        F.floor(F.col("batch_id") / 50).alias("batch_id"), "item_id", "filename"
    )
    return landed(
        spark, sf, "batches",
        lambda path: items.hint("rebalance", "batch_id").write.partitionBy("batch_id").parquet(path),
    )


def q_scan_files(spark, sf):
    found = files.scan_files(
        spark, documents_by_lang(spark, sf), file_filter=r".*\.txt", path_filter="lang=(en|de)", min_size=1
    )
    return found.groupBy("relative_dir").agg(F.sum("length").alias("bytes"))


def q_file_attributes(spark, sf):
    found = files.file_attributes(files.scan_files(spark, documents_by_lang(spark, sf)))
    return found.groupBy("path").agg(
        F.sum("size").alias("bytes"),
        F.bool_and(F.col("last_modified").rlike(r"^\d{4}-\d\d-\d\dT") & F.col("absolute_path").endswith("/")).alias("dated"),
    )


def q_scan_dirs_from_table(spark, sf):
    asked = table(spark, sf, "documents").where("source = 'src3' and lang <> 'en'").select(
        F.concat(F.lit("lang="), "lang").alias("directory")
    )
    found = files.scan_dirs_from_table(documents_by_lang(spark, sf), asked, file_filter=r".*\.txt")
    return found.groupBy(F.col("directory").alias("relative_dir")).agg(F.sum("length").alias("bytes"))


def q_scan_batch_dir(spark, sf):
    asked = table(spark, sf, "batch_items").where("batch_id % 150 = 7").select(F.floor(F.col("batch_id") / 50).alias("batch_id"))
    return files.read_batch_dirs(spark, batch_dirs(spark, sf), asked).select(
        F.col("batch_id").cast("bigint").alias("batch_id"), "item_id", "filename"
    )


def q_read_batch_table(spark, sf):
    asked = table(spark, sf, "detections").where("is_person").select("batch_id")
    return files.read_batch_table(table(spark, sf, "batch_items"), asked).select("batch_id", "item_id")


def blobs(spark: SparkSession, sf: str) -> str:
    """The detections as one file each."""
    def write(root):
        def put(batches):
            fs, base = pafs.FileSystem.from_uri(root)
            fs.create_dir(base, recursive=True)
            for batch in batches:
                for item, content in zip(batch["item_id"].to_pylist(), batch["content"].to_pylist()):
                    with fs.open_output_stream(f"{base}/img_{item}.json") as out:
                        out.write(content.encode())
                yield batch.select(["item_id"])

        rows = table(spark, sf, "detections").select("item_id", "content")
        rows.mapInArrow(put, "item_id bigint").write.format("noop").mode("overwrite").save()

    return landed(spark, sf, "blobs", write)


def q_blob_download(spark, sf):
    """The content of the files that batch items name; most names have no file."""
    found = files.blob_download(blobs(spark, sf), table(spark, sf, "batch_items"))
    return found.groupBy("filename").agg(
        F.sum(F.octet_length("content")).cast("bigint").alias("bytes"), F.md5(F.max("content")).alias("digest")
    )


def _coarse(spark, sf):
    return table(spark, sf, "batch_items").withColumn("batch_id", F.floor(F.col("batch_id") / 50))


def batch_files(spark: SparkSession, sf: str) -> str:
    """One text file for each batch, a file name a line."""
    def write(root):
        def put(batches):
            fs, base = pafs.FileSystem.from_uri(root)
            fs.create_dir(base, recursive=True)
            for batch in batches:
                for b, names in zip(batch["batch_id"].to_pylist(), batch["names"].to_pylist()):
                    with fs.open_output_stream(f"{base}/{b}") as out:
                        out.write("".join(f"{n}\n" for n in names).encode())
                yield batch.select(["batch_id"])

        # a batch has 500 items at most
        rows = _coarse(spark, sf).groupBy("batch_id").agg(F.collect_list("filename").alias("names"))
        rows.mapInArrow(put, "batch_id bigint").write.format("noop").mode("overwrite").save()

    return landed(spark, sf, "batch-files", write)


def q_run_per_batch(spark, sf):
    """``wc -l`` once for each batch."""
    ids = _coarse(spark, sf).select("batch_id").distinct()
    done = run_per_batch(ids, ["wc", "-l"], batch_files(spark, sf).removeprefix("file:"))
    return done.select(
        "batch_id", F.regexp_extract("content", r"^\s*(\d+)", 1).cast("bigint").alias("lines"),
        (F.substring_index("source_dir", "/", -1) == F.col("batch_id").cast("string")).alias("placed"),
    )


def q_read_dir_pairs(spark, sf):
    pairs = files.read_dir_pairs(spark, documents_by_lang(spark, sf))
    return pairs.agg(
        F.sum(F.octet_length("content")).alias("bytes"),
        F.bool_and(F.col("filename").endswith(".txt")).alias("named"),
    )


def q_read_sidecar_schema(spark, sf):
    """Write the trips as CSV with a sidecar beside them, then read both back."""
    names = ("taxi_identifier", "timestamp", "fare_amount", "surcharge")
    units = ("string", "timestamp", "dollar", "percentage")
    kinds = ("sv", "sv", "v", "v")
    rows = trips(spark, sf).select("taxi_identifier", F.col("bt").alias("timestamp"), "fare_amount", "surcharge")

    def write(path):
        header = "\n".join(",".join(line) for line in (names, units, kinds))
        spark.range(1).coalesce(1).select(F.lit(header).alias("value")).write.text(f"{path}/sidecar")
        rows.write.option("nullValue", "null").csv(f"{path}/data")

    path = landed(spark, sf, "sidecar", write)
    shape = sidecar.read_sidecar(spark, f"{path}/sidecar")
    fields = sidecar.sidecar_fields(shape)
    data = spark.read.option("nullValue", "null").csv(f"{path}/data", schema=sidecar.sidecar_schema(fields))
    counts = data.agg(*[F.count(n).alias(n) for n, _, _ in fields]).unpivot([], [n for n, _, _ in fields], "name", "readings")
    return shape.join(counts, "name").select(
        F.col("position").cast("bigint").alias("position"), "name", "unit", "kind", "is_time", "readings"
    )


def dag_documents(spark, sf):
    """One dataflow document per customer, comments included; every 50th is malformed."""
    key = F.col("c_custkey").cast("string")
    text = F.concat(
        F.lit('{"processors":[ /* source */ {"name":"Read","class":"FileReader","uuid":"0","isInput":true,'
              '"relationships":[{"name":"success","autoTerminate":false}],"properties":[{"Batch Size":"10"},{"Input Directory":"/in/'),
        key,
        F.lit('"}]},{"name":"Filter","class":"Range","uuid":"1","isInput":false,'
              '"relationships":[{"name":"success","autoTerminate":false},{"name":"failure","autoTerminate":true}],"properties":[]}],'
              '"wiring":[{"sourceProcessor":"0","destinationProcessor":"1","selectedRelationships":["success"]}],'
              '"inputstreams":["s"],"QOS":1'),
        F.when(F.col("c_custkey") % 50 == 4, "").otherwise("}"),
    )
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("dataflow"), text.alias("document"))


def q_read_dag(spark, sf):
    flow = dataflow.parse_dataflows(dag_documents(spark, sf))
    nodes = flow.nodes.select("dataflow", F.lit("node").alias("part"), F.col("stage").alias("a"), F.col("class").alias("b"))
    edges = flow.edges.select("dataflow", F.lit("edge"), "src", "dst")
    rels = flow.relationships.where("auto_terminate").select("dataflow", F.lit("ends"), "stage", "relationship")
    props = flow.properties.select("dataflow", F.lit("property"), "property", "value")
    bad = flow.rejected.select("dataflow", F.lit("rejected"), F.lit(None).cast("string"), F.lit(None).cast("string"))
    return nodes.union(edges).union(rels).union(props).union(bad)


def _files(spark, sf, condition, version):
    return trips(spark, sf).where(condition).select(
        F.floor(F.col("msg_id") / 500).alias("batch_id"),
        F.concat(F.lit("f"), F.col("msg_id").cast("string")).alias("filename"),
        F.lit(version).alias("content"),
    )


# two sides that hold every trip between them and a third of the even ones twice
FIRST, SECOND = "msg_id % 2 = 0", "msg_id % 2 = 1 OR msg_id % 3 = 0"


def q_write_batches(spark, sf):
    path = scratch(spark, "write-batches")
    file_sinks.write_batches(_files(spark, sf, FIRST, "v1"), path)
    file_sinks.write_batches(_files(spark, sf, SECOND, "v2"), path, conflict="ignore")
    return file_sinks.read_batches(spark, path)


def q_write_batches_fail(spark, sf):
    path = scratch(spark, "write-batches")
    file_sinks.write_batches(_files(spark, sf, FIRST, "v1"), path)
    return file_sinks.write_batches(_files(spark, sf, SECOND, "v2"), path, conflict="fail").failure.select("batch_id", "filename")


def q_write_batches_url(spark, sf):
    path = scratch(spark, "write-url")
    file_sinks.write_batches(_files(spark, sf, FIRST, "v1"), path)
    done = file_sinks.write_batches_url(_files(spark, sf, SECOND, "v2"), path)
    last = done.select("batch_id", "filename", F.regexp_extract("url", r"/(\d+)$", 1).alias("url_end"))
    return file_sinks.read_batches(spark, path).join(last, ["batch_id", "filename"], "left")


UPSERT_KEYS, UPSERT_ORDER = ("hack_license", "taxi_identifier"), ("bt", "msg_id")


def q_upsert_trips(spark, sf):
    path = scratch(spark, "upsert")
    rows = trips(spark, sf).select("msg_id", "bt", "hack_license", "taxi_identifier", "fare_amount")
    for epoch in range(3):
        upsert.upsert(rows.where(f"msg_id % 3 = {epoch}"), path, epoch, UPSERT_KEYS, UPSERT_ORDER)
        if epoch == 1:
            upsert.compact(spark, path, UPSERT_KEYS, UPSERT_ORDER)
    return upsert.read_current(spark, path, UPSERT_KEYS, UPSERT_ORDER)


def q_append_batch_table(spark, sf):
    path = scratch(spark, "images")
    items = table(spark, sf, "batch_items").select("batch_id", F.encode("filename", "UTF-8").alias("content"), "arrival")
    file_sinks.append_batch_table(items.where("arrival % 2 = 0"), path)
    file_sinks.append_batch_table(items.where("arrival % 2 = 1"), path)
    stored = spark.read.parquet(path).groupBy("batch_id").agg(F.count("*").alias("images"))
    return stored.join(batch_gate(items, 10).select("batch_id", "arrival"), "batch_id")


def q_log_rows(spark, sf):
    """What was counted on the way, beside the rows."""
    logged, seen = topic_sinks.log_rows(trips(spark, sf), "trips", F.max("fare_amount").alias("top"))
    counts = logged.groupBy("payment_type").agg(F.count("*").alias("n")).cache()
    counts.count()
    found = seen.get
    return counts.withColumn("rows", F.lit(found["rows"])).withColumn("top", F.lit(found["top"]))


def q_coerced_csv_files(spark, sf):
    """Trip lines written as text files, listed, read and coerced."""
    from sluiceway.operators.clean import coerce_trip

    path = landed(spark, sf, "trip-csv", lambda p: trip_csv(spark, sf).select("line").write.text(p))
    return coerce_trip(spark.read.text(path).withColumnRenamed("value", "line")).groupBy("payment_type", "taxi_company").agg(
        F.count("*").alias("n"), F.sum(F.col("trip_time_in_secs").cast("bigint")).alias("seconds")
    )


_T, _B = with_views("trips"), with_views("batch_items")
_STORED = "CAST(msg_id // 500 AS BIGINT) AS batch_id, 'f' || msg_id AS filename"

ORACLES = {
    "q_scan_files": "SELECT 'lang=' || lang AS relative_dir, CAST(sum(strlen(text) + 1) AS BIGINT) AS bytes FROM documents "
        "WHERE lang IN ('en', 'de') GROUP BY lang",
    "q_file_attributes": "SELECT 'lang=' || lang || '/' AS path, CAST(sum(strlen(text) + 1) AS BIGINT) AS bytes, true AS dated "
        "FROM documents GROUP BY lang",
    "q_scan_dirs_from_table": "SELECT 'lang=' || lang AS relative_dir, CAST(sum(strlen(text) + 1) AS BIGINT) AS bytes FROM documents "
        "WHERE lang IN (SELECT lang FROM documents WHERE source = 'src3' AND lang <> 'en') GROUP BY lang",
    "q_scan_batch_dir": _B + """SELECT batch_id // 50 AS batch_id, item_id, filename FROM batch_items
        WHERE batch_id // 50 IN (SELECT batch_id // 50 FROM batch_items WHERE batch_id % 150 = 7)""",
    "q_read_batch_table": with_views("batch_items", "detections") + "SELECT batch_id, item_id FROM batch_items "
        "WHERE batch_id IN (SELECT batch_id FROM detections WHERE is_person)",
    "q_blob_download": with_views("batch_items", "detections") + "SELECT filename, strlen(content) AS bytes, md5(content) AS digest "
        "FROM detections d JOIN batch_items b ON filename = 'img_' || d.item_id || '.json'",
    "q_run_per_batch": _B + "SELECT batch_id // 50 AS batch_id, count(*) AS lines, true AS placed FROM batch_items GROUP BY ALL",
    "q_read_dir_pairs": "SELECT CAST(sum(strlen(text) + 1) AS BIGINT) AS bytes, true AS named FROM documents",
    "q_read_sidecar_schema": _T + """SELECT CAST(0 AS BIGINT) AS position, 'taxi_identifier' AS name, 'string' AS unit, 'sv' AS kind, false AS is_time, count(*) AS readings FROM trips
        UNION ALL SELECT 1, 'timestamp', 'timestamp', 'sv', true, count(*) FROM trips
        UNION ALL SELECT 2, 'fare_amount', 'dollar', 'v', false, count(fare_amount) FROM trips
        UNION ALL SELECT 3, 'surcharge', 'percentage', 'v', false, count(surcharge) FROM trips""",
    "q_read_dag": """WITH good AS (SELECT c_custkey AS dataflow FROM customer WHERE c_custkey % 50 <> 4)
        SELECT dataflow, 'node' AS part, '0' AS a, 'FileReader' AS b FROM good UNION ALL SELECT dataflow, 'node', '1', 'Range' FROM good
        UNION ALL SELECT dataflow, 'edge', '0', '1' FROM good UNION ALL SELECT dataflow, 'ends', '1', 'failure' FROM good
        UNION ALL SELECT dataflow, 'property', 'Batch Size', '10' FROM good
        UNION ALL SELECT dataflow, 'property', 'Input Directory', '/in/' || dataflow FROM good
        UNION ALL SELECT c_custkey, 'rejected', NULL, NULL FROM customer WHERE c_custkey % 50 = 4""",
    "q_write_batches": _T + f"SELECT {_STORED}, CASE WHEN msg_id % 2 = 0 THEN 'v1' ELSE 'v2' END AS content FROM trips",
    "q_write_batches_fail": _T + f"SELECT {_STORED} FROM trips WHERE msg_id % 6 = 0",
    "q_write_batches_url": _T + f"""SELECT {_STORED}, CASE WHEN {SECOND} THEN 'v2' ELSE 'v1' END AS content,
        CASE WHEN {SECOND} THEN CAST(msg_id // 500 AS VARCHAR) END AS url_end FROM trips""",
    "q_upsert_trips": _T + """SELECT max(msg_id) AS msg_id, max(bt) AS bt, hack_license, taxi_identifier, arg_max(fare_amount, msg_id) AS fare_amount
        FROM trips GROUP BY hack_license, taxi_identifier""",
    "q_append_batch_table": _B + """SELECT batch_id, count(*) AS images, max(arrival) AS arrival FROM batch_items GROUP BY batch_id HAVING count(*) >= 10""",
    "q_log_rows": _T + """SELECT payment_type, count(*) AS n, (SELECT count(*) FROM trips) AS rows,
        (SELECT max(fare_amount) FROM trips) AS top FROM trips GROUP BY payment_type""",
    "q_coerced_csv_files": _T + """SELECT payment_type, CASE WHEN msg_id % 2 = 0 THEN 'acme' END AS taxi_company, count(*) AS n,
        CAST(sum(trip_time_in_secs) AS BIGINT) AS seconds FROM trips GROUP BY ALL""",
}
QUERIES = {n: f for n, f in list(globals().items()) if n.startswith("q_")}
