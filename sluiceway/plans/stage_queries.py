"""Queries over keys and batches: joins, gates, windows, statistics, catalogue, telemetry."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluiceway.operators import analytics, batches, catalog, joins, telemetry
from sluiceway.operators.impute import impute_mean
from sluiceway.plans.compose import compose
from sluiceway.operators.clean import range_filter
from sluiceway.plans.record_queries import _RANGES, trips
from sluiceway.plans.tables import landed, table, with_views
from sluiceway.schemas import SENSOR_FIELDS
from sluiceway.sources import files

PIECE_FIELDS = ("taxi_identifier", *SENSOR_FIELDS)


def pieces(spark, sf):
    """A trip in pieces; some pieces are sent twice, a missing reading sends none."""
    rows = trips(spark, sf)
    sent = [
        F.struct(F.lit(n).alias("obs_type"), F.col(n).cast("string").alias("obs_val"), F.lit(i + 1).alias("seq"))
        for i, n in enumerate(PIECE_FIELDS)
    ]
    stale = F.struct(F.lit("tip_amount").alias("obs_type"), F.lit("-1").alias("obs_val"), F.lit(0).alias("seq"))
    every = F.array(*sent)
    parts = F.when(F.col("msg_id") % 7 == 0, F.concat(every, F.array(stale))).otherwise(every)
    return rows.select("msg_id", "bt", F.inline(parts)).where("obs_val is not null")


def q_assemble_message(spark, sf):
    whole = joins.assemble_message(pieces(spark, sf), PIECE_FIELDS)
    return whole.select("msg_id", "joined_value")


def q_annotate(spark, sf):
    whole = joins.assemble_message(pieces(spark, sf), PIECE_FIELDS)
    # the lines as text files: their numbers come from reading
    path = landed(spark, sf, "annotations", lambda p: table(spark, sf, "annotation_lines").orderBy("line_no").select("value").write.text(p))
    notes = joins.read_annotations(files.numbered_lines(spark, path))
    return joins.annotate_text(whole, notes, line_no="line_no").select("msg_id", F.col("joined_value").alias("line"))


def q_annotate_columns(spark, sf):
    return joins.annotate(trips(spark, sf), table(spark, sf, "metadata")).select(
        "msg_id", "taxi_identifier", "taxi_company", "drivername", "taxi_city"
    )


def q_join_batch_exists(spark, sf):
    """Every item that another item of its batch came before."""
    items = table(spark, sf, "batch_items").select("batch_id", "item_id", "arrival")
    return joins.join_batch_exists(items, items)


def q_join_batch_complete(spark, sf):
    items = table(spark, sf, "batch_items")
    requests = items.where("batch_id % 3 <> 0").select("batch_id")
    return joins.join_batch_complete(items, requests, 10).select("batch_id", "item_id", "filename")


def q_join_batch_lookup(spark, sf):
    requests = table(spark, sf, "batch_items").where("batch_id % 4 = 1").select("batch_id")
    return joins.join_batch_lookup(requests, table(spark, sf, "detections")).select("batch_id", "item_id", "content")


def visibility(spark, sf):
    """Which of the 25 sites sees which, from one 0/1 line per nation."""
    row = F.col("n_nationkey") + 1
    cells = F.transform(F.sequence(F.lit(1), F.lit(25)), lambda j: F.when((row * 7 + j * 3) % 4 == 0, "1").otherwise("0"))
    lines = table(spark, sf, "nation").select(row.alias("src"), F.array_join(cells, ",").alias("line"))
    return catalog.matrix_edges(lines)


def q_link_transport(spark, sf):
    placement = table(spark, sf, "stages").select("stage", "device")
    linked = joins.link_transport(table(spark, sf, "wires"), placement, visibility(spark, sf))
    return linked.groupBy("src_device", "dst_device", "transport").agg(F.count("*").alias("wires"))


def q_batch_gate(spark, sf):
    return batches.batch_gate(table(spark, sf, "batch_items"), 10).select("batch_id", "item_id")


def q_batch_gate_repeat(spark, sf):
    items = table(spark, sf, "batch_items").withColumn("batch_id", F.floor(F.col("batch_id") / 5))
    return batches.batch_gate(items, 10, repeat=True).select("batch_id", "item_id")


def q_dedup_batch(spark, sf):
    return batches.dedup_batch(table(spark, sf, "batch_items")).select("batch_id", "item_id", "filename")


def q_impute_mean(spark, sf):
    filled = impute_mean(trips(spark, sf), "surcharge", 5, output="imputed")
    return filled.select("msg_id", "taxi_identifier", F.round("imputed", 6).alias("imputed"))


def _items(spark, sf):
    return catalog.parse_items(table(spark, sf, "device_items"))


def q_pivot_devices(spark, sf):
    return catalog.pivot_devices(_items(spark, sf))


def q_device_children(spark, sf):
    children = catalog.device_children(_items(spark, sf))
    return catalog.children_per_device(children).select(
        "device_id", "child_kind", "page", "children_count",
        F.array_join(F.transform("children", lambda c: F.concat_ws(":", c["child_id"], c["port"], c["type"])), ";")
        .alias("children"),
    )


def q_device_streams(spark, sf):
    return catalog.device_children(_items(spark, sf)).where("child_kind = 'input_stream'").select(
        "device_id", "child_id", "type"
    )


def q_limit_batch(spark, sf):
    return batches.limit_batch(table(spark, sf, "batch_items"), ["arrival"], 10).select("item_id", "filename")


def q_except_processed(spark, sf):
    items = table(spark, sf, "batch_items")
    return batches.except_processed(
        items, items.where("item_id % 3 = 0"), items.where("item_id % 5 = 0"), keys=["filename"]
    ).select("item_id", "filename")


def q_fan_in(spark, sf):
    rows = trips(spark, sf)
    return batches.fan_in(
        rows.where("payment_type = 'CSH'").select("msg_id", "fare_amount"),
        rows.where("surcharge is null").select("msg_id", "tip_amount"),
    )


def q_fan_out(spark, sf):
    cash, dear = batches.fan_out(
        trips(spark, sf).select("msg_id", "payment_type", "fare_amount"),
        [lambda d: d.where("payment_type = 'CSH'"), lambda d: d.where("fare_amount > 500")],
    )
    return batches.fan_in(cash.withColumn("sink", F.lit("cash")), dear.withColumn("sink", F.lit("dear"))).select("msg_id", "sink")


def q_pair_entry_exit(spark, sf):
    log = telemetry.parse_oplog(table(spark, sf, "oplog_lines"))
    return telemetry.pair_entry_exit(log).select("id", "class", "entry_ms", "exit_ms", "latency_ms")


def q_latency_summary(spark, sf):
    log = telemetry.parse_oplog(table(spark, sf, "oplog_lines"))
    summary = telemetry.latency_summary(telemetry.pair_entry_exit(log))
    return summary.select(
        "class", "runs", "min_ms", "max_ms", F.round("mean_ms", 6).alias("mean_ms"),
        F.round("p50_ms", 6).alias("p50_ms"), F.round("p95_ms", 6).alias("p95_ms"), "span_ms",
        F.round("runs_per_sec", 6).alias("runs_per_sec"),
    )


def q_resource_usage(spark, sf):
    usage = telemetry.parse_usage(table(spark, sf, "usage_lines"))
    return telemetry.resource_usage(usage, "1 hour").select(
        F.date_format("period_start", "yyyy-MM-dd HH").alias("hour"), "samples",
        F.round("avg_cpu", 6).alias("avg_cpu"), "max_cpu", F.round("avg_mem", 6).alias("avg_mem"), "max_mem",
    )


def q_deal_round_robin(spark, sf):
    rows = trips(spark, sf).select("msg_id", F.col("taxi_identifier").alias("stream"))
    pins = table(spark, sf, "customer").where("c_custkey % 10 = 3").select(
        F.concat(F.lit("T"), F.col("c_custkey").cast("string")).alias("stream"), (F.col("c_custkey") % 7).alias("worker")
    )
    return batches.deal_round_robin(rows, ["msg_id"], 7, pins, offset=3).select("msg_id", "worker")


def q_sample_batches(spark, sf):
    listing = table(spark, sf, "batch_items").select("item_id", "filename")
    return batches.sample_batches(listing, ["item_id"], listing.count() // 10, 10, seed=17)


def _batch_total(frame):
    import pandas as pd

    return pd.DataFrame({"batch_id": [frame["batch_id"].iloc[0]], "n": [len(frame)], "total": [frame["item_id"].sum()]})


def q_apply_batch(spark, sf):
    items = table(spark, sf, "batch_items").select("batch_id", "item_id")
    return batches.apply_batch(
        items, _batch_total, "batch_id bigint, n bigint, total bigint",
        merge=[F.sum("n").alias("n"), F.sum("total").alias("total")],
    )


def q_pipe_lines(spark, sf):
    names = table(spark, sf, "batch_items").select("filename")
    return batches.pipe_lines(names, "filename", ["tr", "a-z", "A-Z"])


def q_compose(spark, sf):
    def split(rows):
        return {"cash": rows.where("payment_type = 'CSH'"), "card": rows.where("payment_type <> 'CSH'")}

    out = compose(
        stages={
            "clean": range_filter,
            "split": split,
            "totals": lambda rows: rows.groupBy("payment_type").agg(
                F.count("*").alias("n"), F.round(F.avg("fare_amount"), 6).alias("avg_fare")),
        },
        wires=[("read", "clean"), ("clean", "split"), ("split", "cash", "totals"), ("split", "card", "totals")],
        sources={"read": trips(spark, sf)},
    )
    return out["totals", "success"]


def q_approx_distinct(spark, sf):
    rows = trips(spark, sf)
    estimate = analytics.distinct_merge(
        analytics.distinct_sketch(rows, "hack_license", ["payment_type", (F.col("msg_id") % 10).alias("bucket")]),
        ["payment_type"],
    )
    exact = rows.groupBy("payment_type").agg(F.countDistinct("hack_license").alias("exact"))
    near = F.abs(F.col("distinct_estimate") - F.col("exact")) / F.col("exact") <= 0.05
    return estimate.join(exact, "payment_type").select("payment_type", near.alias("within_5_percent"))


def q_block_count(spark, sf):
    return analytics.block_aggregate(
        trips(spark, sf), [F.count("*").alias("readings"), F.count("surcharge").alias("surcharges")]
    )


def q_block_average(spark, sf):
    return analytics.block_aggregate(
        trips(spark, sf), [F.round(F.avg("fare_amount"), 6).alias("avg_fare")], partial=True
    )


def q_second_moment(spark, sf):
    return analytics.second_moment(trips(spark, sf), "taxi_identifier").select(
        F.col("second_moment").cast("bigint").alias("second_moment")
    )


def q_kalman(spark, sf):
    return analytics.kalman(trips(spark, sf).select("msg_id", "taxi_identifier", "trip_distance"), "trip_distance").select(
        "msg_id", F.round("estimate", 6).alias("estimate")
    )


def q_sliding_regression(spark, sf):
    out = analytics.sliding_regression(trips(spark, sf).select("msg_id", "taxi_identifier", "fare_amount"), "fare_amount")
    return out.select("msg_id", F.round("slope", 5).alias("slope"), F.round("forecast", 5).alias("forecast"))


def _labelled(spark, sf):
    return trips(spark, sf).withColumn("paid", F.col("fare_amount") + F.col("tip_amount"))


def q_linear_regression(spark, sf):
    data = _labelled(spark, sf)
    model = analytics.train_linear(data, ["trip_time_in_secs", "trip_distance"], "paid")
    out = analytics.predict(data, model)
    return out.select("msg_id", F.round("prediction", 4).alias("prediction"))


def q_linear_retrain(spark, sf):
    out = analytics.retrained_regression(_labelled(spark, sf), ("trip_time_in_secs", "trip_distance"), "paid")
    return out.select("msg_id", F.round("prediction", 4).alias("prediction"))


TREE_FEATURES = ("trip_time_in_secs", "trip_distance", "fare_amount")


def _graded(spark, sf):
    fare = F.col("fare_amount")
    return trips(spark, sf).withColumn(
        "grade", F.when(fare < 50, "BAD").when(fare < 100, "GOOD").when(fare < 200, "VERYGOOD").otherwise("EXCELLENT")
    )


def q_decision_tree(spark, sf):
    """Each 300 trips graded by the tree of the 300 before."""
    return analytics.retrained_tree(_graded(spark, sf), TREE_FEATURES, "grade").select("msg_id", "predicted")


def q_tree_model(spark, sf):
    """One tree for all trips, by the machine learning library."""
    data = _graded(spark, sf)
    out = analytics.predict(data, analytics.train_tree(data, list(TREE_FEATURES), "grade"))
    return out.groupBy("grade", "class_index").agg(F.count("*").alias("n"))


def q_catalog_exact(spark, sf):
    return catalog.catalog_exact(table(spark, sf, "device_items"), "/device/cpu/7")


def q_catalog_prefix(spark, sf):
    return catalog.catalog_prefix(table(spark, sf, "device_items"), "/device/containers/1").select("href")


def q_catalog_contains(spark, sf):
    return catalog.catalog_prefix(table(spark, sf, "device_items"), "/1", "contains").select("href")


def q_catalog_all(spark, sf):
    pages = catalog.catalog_envelopes(_items(spark, sf), "devices", 500)
    back = catalog.read_envelopes(pages)
    return back.select("href", F.size("item-metadata").cast("bigint").alias("facts"))


def q_catalog_apply(spark, sf):
    return catalog.catalog_apply(table(spark, sf, "catalog_changes"))


def q_dataflow_registry(spark, sf):
    key = F.col("c_custkey").cast("string")
    mapping = F.to_json(F.create_map(
        F.lit("0"), F.col("c_nationkey").cast("string"), F.lit("1"), (F.col("c_custkey") % 7).cast("string")))
    def rel(name, value):
        return F.struct(F.lit(name).alias("rel"), value.alias("val"))

    items = table(spark, sf, "customer").select(
        F.concat(F.lit("/dataflow/"), key).alias("href"),
        F.array(
            rel("urn:X-hypercat:rels:hasDescription:en", F.lit("DataFlow")),
            rel("originalJSON", F.concat(F.lit('{"name":"'), "c_name", F.lit('"}'))),
            rel("DataFlowUUID", key),
            rel("Mapping JSON", F.regexp_replace(mapping, '"', '\\\\\\\\"')),
        ).alias("item-metadata"),
    )
    return catalog.dataflow_registry(items).select(
        "dataflow", F.get_json_object("original_json", "$.name").alias("name"), "stage", "device"
    )


def q_placement_map(spark, sf):
    rows = table(spark, sf, "stages")
    devices = table(spark, sf, "nation").select((F.col("n_nationkey") + 1).cast("bigint").alias("device"), "n_name")
    return catalog.placement_map(
        rows.select("stage"), rows.where("not vanished").select("stage", "device"), devices
    ).select("stage", "device", "n_name")


def _placements(spark, sf):
    rows = table(spark, sf, "stages")
    return rows.select("stage", "device"), rows.where("not vanished").select("stage", F.col("new_device").alias("device"))


def q_placement_diff(spark, sf):
    return catalog.placement_diff(*_placements(spark, sf)).select("stage", "old_device", "new_device")


def q_affected_neighbours(spark, sf):
    moved = catalog.placement_diff(*_placements(spark, sf))
    return catalog.affected_neighbours(table(spark, sf, "wires"), moved)


def q_matrix_edges(spark, sf):
    row = F.col("c_custkey") + 1
    cells = F.transform(F.sequence(F.lit(1), F.lit(25)), lambda j: F.when((row * 7 + j * 3) % 4 == 0, "1").otherwise("0"))
    lines = table(spark, sf, "customer").orderBy(row).select(F.array_join(cells, ",").alias("line"))
    path = landed(spark, sf, "matrix", lambda p: lines.write.text(p))
    numbered = files.numbered_lines(spark, path, "line")
    return catalog.matrix_edges(numbered, "line_no").withColumn("dst", F.col("dst").cast("bigint"))


def _tree_sql() -> str:
    """The tree of depth 2 in SQL: per level a histogram, its running sums, the best cut, and the rows one level down."""
    classes = ("BAD", "GOOD", "VERYGOOD", "EXCELLENT")
    spans = ", ".join(f"min({f}) AS lo{i}, max({f}) AS hi{i}" for i, f in enumerate(TREE_FEATURES))
    bins = "[" + ", ".join(
        f"CASE WHEN hi{i} > lo{i} THEN least(CAST(floor(({f} - lo{i}) / (hi{i} - lo{i}) * 16) AS BIGINT), 15) ELSE 0 END"
        for i, f in enumerate(TREE_FEATURES)
    ) + "]"
    counts = ", ".join(f"count(*) FILTER (grade = '{c}') AS n{i}" for i, c in enumerate(classes))
    left = ", ".join(f"sum(n{i}) OVER (PARTITION BY block, node, feature ORDER BY bin) AS l{i}" for i in range(4))
    total = ", ".join(f"sum(n{i}) OVER (PARTITION BY block, node, feature) AS t{i}" for i in range(4))

    def purity(cell: str) -> str:
        cells = [cell.format(i=i) for i in range(4)]
        return f"CAST({' + '.join(f'{c} * {c}' for c in cells)} AS DOUBLE) / nullif(CAST({' + '.join(cells)} AS DOUBLE), 0)"

    def descend(rows: str, level: int) -> str:
        return f"""SELECT r.* REPLACE (CASE WHEN s.feature IS NULL THEN r.node
            WHEN r.bins[s.feature] <= s.bin THEN 2 * r.node + 1 ELSE 2 * r.node + 2 END AS node)
            FROM {rows} r LEFT JOIN s{level} s ON s.block = r.block AND s.node = r.node"""

    parts = [f"""g AS (SELECT *, msg_id // 300 AS block, CASE WHEN fare_amount < 50 THEN 'BAD' WHEN fare_amount < 100 THEN 'GOOD'
            WHEN fare_amount < 200 THEN 'VERYGOOD' ELSE 'EXCELLENT' END AS grade FROM trips)""",
        f"spans AS (SELECT block, {spans} FROM g GROUP BY block)",
        f"r0 AS (SELECT block, CAST(0 AS BIGINT) AS node, grade, {bins} AS bins FROM g JOIN spans USING (block))",
        f"p0 AS (SELECT msg_id, g.block - 1 AS block, CAST(0 AS BIGINT) AS node, {bins} AS bins FROM g LEFT JOIN spans ON spans.block = g.block - 1)"]
    for level in range(2):
        parts += [
            f"h{level} AS (SELECT block, node, feature, bins[feature] AS bin, {counts} FROM r{level}, range(1, 4) f(feature) GROUP BY ALL)",
            f"c{level} AS (SELECT block, node, feature, bin, {left}, {total} FROM h{level})",
            f"v{level} AS (SELECT block, node, feature, bin, {purity('l{i}')} + {purity('(t{i} - l{i})')} AS score, {purity('t{i}')} AS before FROM c{level})",
            f"""s{level} AS (SELECT block, node, feature, bin FROM v{level} WHERE score > before + 1e-9
                QUALIFY row_number() OVER (PARTITION BY block, node ORDER BY score DESC, feature, bin) = 1)""",
            f"r{level + 1} AS ({descend(f'r{level}', level)})",
            f"p{level + 1} AS ({descend(f'p{level}', level)})",
        ]
    best = "CASE " + " ".join(
        f"WHEN {' AND '.join(f'n{i} >= n{j}' for j in range(4))} THEN '{c}'" for i, c in enumerate(classes)
    ) + " END"
    parts.append(f"leaves AS (SELECT block, node, {best} AS predicted FROM (SELECT block, node, {counts} FROM r2 GROUP BY ALL))")
    return with_views("trips") + ", " + ",\n".join(parts) + """
        SELECT msg_id, predicted FROM p2 LEFT JOIN leaves ON leaves.block = p2.block AND leaves.node = p2.node"""


_T, _B, _S = with_views("trips"), with_views("batch_items"), with_views("stages")
_JOINED = " || '@' || ".join(f"CAST({f} AS VARCHAR)" for f in PIECE_FIELDS)
_LOG = with_views("oplog_lines") + """,
log AS (SELECT string_split(line, ',') AS p FROM oplog_lines),
rows AS (SELECT CAST(p[1] AS BIGINT) AS id, p[2] AS class, CAST(p[3] AS BIGINT) AS ts, p[4] AS event FROM log),
seen AS (SELECT *, lag(event) OVER w AS before, lag(ts) OVER w AS entry_ms FROM rows
         WINDOW w AS (PARTITION BY id ORDER BY ts, event)),
pairs AS (SELECT id, class, entry_ms, ts AS exit_ms, ts - entry_ms AS latency_ms FROM seen
          WHERE event = 'EXIT' AND before = 'ENTRY')
"""
_DENSE = "row_number() OVER (ORDER BY md5(CAST({k} AS VARCHAR)), {k}) - 1"
_FIT = """covar_pop(trip_time_in_secs, trip_time_in_secs) AS aa, covar_pop(trip_distance, trip_distance) AS bb,
       covar_pop(trip_time_in_secs, trip_distance) AS ab, covar_pop(trip_time_in_secs, paid) AS ay,
       covar_pop(trip_distance, paid) AS by_, avg(trip_time_in_secs) AS ma, avg(trip_distance) AS mb, avg(paid) AS my"""
_GUESS = """my + (ay * bb - by_ * ab) / (aa * bb - ab * ab) * (trip_time_in_secs - ma)
             + (by_ * aa - ay * ab) / (aa * bb - ab * ab) * (trip_distance - mb)"""

ORACLES = {
    "q_assemble_message": _T + f"SELECT msg_id, {_JOINED} AS joined_value FROM trips WHERE surcharge IS NOT NULL",
    "q_annotate": with_views("trips", "annotation_lines") + f""",
        notes AS (SELECT line_no, string_split(value, ':')[1] AS k, string_split(value, ':')[2] AS v FROM annotation_lines),
        last AS (SELECT k, arg_max(v, line_no) AS v FROM notes GROUP BY k)
        SELECT msg_id, replace({_JOINED}, '@', ',') || coalesce(',' || v, '') AS line
        FROM trips LEFT JOIN last ON k = taxi_identifier WHERE surcharge IS NOT NULL""",
    "q_annotate_columns": with_views("trips", "metadata") + "SELECT msg_id, taxi_identifier, taxi_company, drivername, "
        "taxi_city FROM trips LEFT JOIN metadata USING (taxi_identifier)",
    "q_join_batch_exists": _B + """SELECT l.batch_id, l.item_id, l.arrival FROM batch_items l
        WHERE EXISTS (SELECT 1 FROM batch_items r WHERE r.batch_id = l.batch_id AND r.arrival < l.arrival)""",
    "q_join_batch_complete": _B + """SELECT batch_id, item_id, filename FROM batch_items
        WHERE batch_id % 3 <> 0 AND batch_id IN (SELECT batch_id FROM batch_items GROUP BY batch_id HAVING count(*) >= 10)""",
    "q_join_batch_lookup": with_views("batch_items", "detections") + """SELECT d.batch_id, d.item_id, d.content FROM detections d
        WHERE d.batch_id IN (SELECT batch_id FROM batch_items WHERE batch_id % 4 = 1)""",
    "q_link_transport": with_views("wires", "stages") + """,
        ends AS (SELECT a.device AS s, b.device AS d FROM wires JOIN stages a ON a.stage = src JOIN stages b ON b.stage = dst)
        SELECT s AS src_device, d AS dst_device,
               CASE WHEN s = d THEN 'LOCAL' WHEN (s * 7 + d * 3) % 4 = 0 THEN 'PUSH'
                    WHEN (d * 7 + s * 3) % 4 = 0 THEN 'PULL' ELSE 'BROKER' END AS transport, count(*) AS wires
        FROM ends GROUP BY ALL""",
    "q_batch_gate": _B + """SELECT batch_id, item_id FROM (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY arrival) AS n
        FROM batch_items) WHERE n = 10""",
    "q_batch_gate_repeat": _B + """SELECT batch_id, item_id FROM (SELECT batch_id // 5 AS batch_id, item_id,
        row_number() OVER (PARTITION BY batch_id // 5 ORDER BY arrival) AS n FROM batch_items) WHERE n % 10 = 0""",
    "q_dedup_batch": _B + """SELECT batch_id, item_id, filename FROM (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY arrival) AS n
        FROM batch_items) WHERE n = 1""",
    "q_impute_mean": _T + """, m AS (SELECT *, CASE WHEN surcharge IS NOT NULL THEN avg(surcharge) OVER (
            PARTITION BY taxi_identifier, surcharge IS NULL ORDER BY msg_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) END AS mean FROM trips)
        SELECT msg_id, taxi_identifier, round(coalesce(surcharge, last_value(mean IGNORE NULLS) OVER (
            PARTITION BY taxi_identifier ORDER BY msg_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 6) AS imputed FROM m""",
    "q_pivot_devices": """SELECT CAST(c_custkey AS VARCHAR) AS device_id, CAST(c_custkey AS VARCHAR) AS device_uuid,
        CASE WHEN c_custkey % 9 <> 0 THEN '10.0.0.' || c_nationkey END AS ip, c_custkey % 100 + CAST(0.5 AS DOUBLE) AS cpu_util,
        c_custkey % 77 + CAST(0.25 AS DOUBLE) AS mem_util, CAST(400 AS DOUBLE) AS cpu_avail, CAST(1000 AS DOUBLE) AS mem_avail,
        c_custkey % 2 = 0 AS accelerated FROM customer""",
    "q_device_children": """WITH c AS (
        SELECT c_custkey AS k, 'containers' AS child_kind, 'c0-' || c_custkey || ':' || (9000 + c_custkey % 50) AS child FROM customer
        UNION ALL SELECT c_custkey, 'containers', 'c1-' || c_custkey || ':' || (9500 + c_custkey % 50) FROM customer WHERE c_custkey % 3 = 0
        UNION ALL SELECT c_custkey, 'input_stream', 's-' || c_custkey || ':camera' FROM customer WHERE c_custkey % 4 = 0)
        SELECT CAST(k AS VARCHAR) AS device_id, child_kind, CAST(0 AS BIGINT) AS page, count(*) AS children_count,
               string_agg(child, ';' ORDER BY child) AS children FROM c GROUP BY k, child_kind""",
    "q_device_streams": "SELECT CAST(c_custkey AS VARCHAR) AS device_id, 's-' || c_custkey AS child_id, 'camera' AS type "
        "FROM customer WHERE c_custkey % 4 = 0",
    "q_limit_batch": _B + "SELECT item_id, filename FROM batch_items ORDER BY arrival LIMIT 10",
    "q_except_processed": _B + "SELECT item_id, filename FROM batch_items WHERE item_id % 3 <> 0 AND item_id % 5 <> 0",
    "q_fan_in": _T + "SELECT msg_id, fare_amount, CAST(NULL AS DOUBLE) AS tip_amount FROM trips WHERE payment_type = 'CSH' "
        "UNION ALL SELECT msg_id, NULL, tip_amount FROM trips WHERE surcharge IS NULL",
    "q_fan_out": _T + "SELECT msg_id, 'cash' AS sink FROM trips WHERE payment_type = 'CSH' "
        "UNION ALL SELECT msg_id, 'dear' FROM trips WHERE fare_amount > 500",
    "q_pair_entry_exit": _LOG + "SELECT * FROM pairs",
    "q_latency_summary": _LOG + """SELECT class, count(*) AS runs, min(latency_ms) AS min_ms, max(latency_ms) AS max_ms,
        round(avg(latency_ms), 6) AS mean_ms, round(quantile_cont(latency_ms, 0.5), 6) AS p50_ms,
        round(quantile_cont(latency_ms, 0.95), 6) AS p95_ms, max(exit_ms) - min(entry_ms) AS span_ms,
        round(count(*) * 1000 / CAST(max(exit_ms) - min(entry_ms) AS DOUBLE), 6) AS runs_per_sec FROM pairs GROUP BY class""",
    "q_resource_usage": """WITH u AS (SELECT '2024-01-' || lpad(CAST(1 + event_id % 28 AS VARCHAR), 2, '0') || ' '
            || lpad(CAST((event_id * 7) % 24 AS VARCHAR), 2, '0') AS hour, event_id % 100 + CAST(0.5 AS DOUBLE) AS cpu,
            (event_id * 3) % 100 + CAST(0.25 AS DOUBLE) AS mem FROM events WHERE event_id % 41 <> 0)
        SELECT hour, count(*) AS samples, round(avg(cpu), 6) AS avg_cpu, max(cpu) AS max_cpu, round(avg(mem), 6) AS avg_mem,
               max(mem) AS max_mem FROM u GROUP BY hour""",
    "q_deal_round_robin": _T + f""", pins AS (SELECT 'T' || c_custkey AS stream, c_custkey % 7 AS worker FROM customer WHERE c_custkey % 10 = 3),
        marked AS (SELECT msg_id, worker FROM trips LEFT JOIN pins ON stream = taxi_identifier)
        SELECT msg_id, worker FROM marked WHERE worker IS NOT NULL
        UNION ALL SELECT msg_id, ({_DENSE.format(k='msg_id')} + 3) % 7 FROM marked WHERE worker IS NULL""",
    "q_sample_batches": _B + f""", listing AS (SELECT item_id, filename, {_DENSE.format(k='item_id')} AS i FROM batch_items),
        total AS (SELECT count(*) AS n FROM batch_items),
        draws AS (SELECT range AS draw, CAST('0x' || substr(md5('17:' || range), 1, 15) AS BIGINT) % n AS i
                  FROM total, range(0, (SELECT count(*) // 10 * 10 FROM batch_items)))
        SELECT draw, CAST(draw // 10 AS BIGINT) AS batch_id, item_id, filename FROM draws JOIN listing USING (i)""",
    "q_apply_batch": _B + "SELECT batch_id, count(*) AS n, CAST(sum(item_id) AS BIGINT) AS total FROM batch_items GROUP BY batch_id",
    "q_pipe_lines": _B + "SELECT upper(filename) AS filename FROM batch_items",
    "q_compose": _T + f"SELECT payment_type, count(*) AS n, round(avg(fare_amount), 6) AS avg_fare FROM trips WHERE {_RANGES} GROUP BY payment_type",
    "q_approx_distinct": _T + "SELECT DISTINCT payment_type, true AS within_5_percent FROM trips",
    "q_block_count": _T + """, b AS (SELECT *, (row_number() OVER (PARTITION BY taxi_identifier ORDER BY msg_id) - 1) // 5 AS block FROM trips)
        SELECT taxi_identifier, CAST(block AS BIGINT) AS block, count(*) AS readings, count(surcharge) AS surcharges FROM b
        GROUP BY taxi_identifier, block HAVING count(*) = 5""",
    "q_block_average": _T + """, b AS (SELECT *, (row_number() OVER (PARTITION BY taxi_identifier ORDER BY msg_id) - 1) // 5 AS block FROM trips)
        SELECT taxi_identifier, CAST(block AS BIGINT) AS block, round(avg(fare_amount), 6) AS avg_fare FROM b GROUP BY taxi_identifier, block""",
    "q_second_moment": _T + "SELECT CAST(sum(n * n) AS BIGINT) AS second_moment FROM (SELECT count(*) AS n FROM trips GROUP BY taxi_identifier)",
    "q_kalman": with_views("trips").replace("WITH ", "WITH RECURSIVE ", 1) + """,
        z AS (SELECT msg_id, taxi_identifier AS k, trip_distance AS z, row_number() OVER (PARTITION BY taxi_identifier ORDER BY msg_id) AS t FROM trips),
        f AS (SELECT msg_id, k, t, z AS x, (30 + 0.125::DOUBLE) * (1 - (30 + 0.125::DOUBLE) / (30 + 0.125::DOUBLE + 0.32::DOUBLE)) AS p FROM z WHERE t = 1
              UNION ALL
              SELECT z.msg_id, z.k, z.t, x + (p + 0.125::DOUBLE) / (p + 0.125::DOUBLE + 0.32::DOUBLE) * (z.z - x),
                     (p + 0.125::DOUBLE) * (1 - (p + 0.125::DOUBLE) / (p + 0.125::DOUBLE + 0.32::DOUBLE))
              FROM f JOIN z ON z.k = f.k AND z.t = f.t + 1)
        SELECT msg_id, round(x, 6) AS estimate FROM f""",
    "q_sliding_regression": _T + """, n AS (SELECT msg_id, taxi_identifier AS k, fare_amount AS y,
            CAST(row_number() OVER (PARTITION BY taxi_identifier ORDER BY msg_id) AS DOUBLE) AS x FROM trips),
        r AS (SELECT msg_id, x, regr_slope(y, x) OVER w AS s, avg(y) OVER w AS my, avg(x) OVER w AS mx FROM n
              WINDOW w AS (PARTITION BY k ORDER BY msg_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)),
        c AS (SELECT msg_id, x, my, mx, CASE WHEN isnan(s) OR x = 1 THEN NULL ELSE s END AS s FROM r)
        SELECT msg_id, round(s, 5) AS slope, round(my + s * (x + 10 - mx), 5) AS forecast FROM c""",
    "q_linear_regression": _T + f""", d AS (SELECT *, fare_amount + tip_amount AS paid FROM trips), f AS (SELECT {_FIT} FROM d)
        SELECT msg_id, round({_GUESS}, 4) AS prediction FROM d, f""",
    "q_linear_retrain": _T + f""", d AS (SELECT *, fare_amount + tip_amount AS paid, msg_id // 300 AS block FROM trips),
        f AS (SELECT block + 1 AS block, {_FIT} FROM d GROUP BY block)
        SELECT msg_id, round({_GUESS}, 4) AS prediction FROM d LEFT JOIN f USING (block)""",
    "q_decision_tree": _tree_sql(),
    "q_catalog_exact": with_views("device_items") + "SELECT href, body FROM device_items WHERE href = '/device/cpu/7'",
    "q_catalog_prefix": with_views("device_items") + "SELECT href FROM device_items WHERE starts_with(href, '/device/containers/1')",
    "q_catalog_contains": with_views("device_items") + "SELECT href FROM device_items WHERE contains(href, '/1')",
    "q_catalog_all": with_views("device_items") + """SELECT href, CAST(CASE WHEN href LIKE '/device/meta/%' THEN 4
        WHEN href LIKE '/device/containers/%' OR href LIKE '/device/input_stream/%' THEN 3 ELSE 1 END AS BIGINT) AS facts FROM device_items""",
    "q_catalog_apply": with_views("catalog_changes") + """SELECT href, body FROM (SELECT href, arg_max(op, seq) AS op, arg_max(body, seq) AS body
        FROM catalog_changes GROUP BY href) WHERE op <> 'DELETE'""",
    "q_dataflow_registry": """SELECT CAST(c_custkey AS VARCHAR) AS dataflow, c_name AS name, '0' AS stage, CAST(c_nationkey AS VARCHAR) AS device FROM customer
        UNION ALL SELECT CAST(c_custkey AS VARCHAR), c_name, '1', CAST(c_custkey % 7 AS VARCHAR) FROM customer""",
    "q_placement_map": _S + "SELECT stage, device, n_name FROM stages JOIN nation ON n_nationkey + 1 = device WHERE NOT vanished",
    "q_placement_diff": _S + "SELECT stage, device AS old_device, CASE WHEN NOT vanished THEN new_device END AS new_device "
        "FROM stages WHERE vanished OR device <> new_device",
    "q_affected_neighbours": with_views("wires", "stages") + """, moved AS (SELECT stage FROM stages WHERE vanished OR device <> new_device),
        near AS (SELECT dst AS stage FROM wires WHERE src IN (SELECT stage FROM moved)
                 UNION SELECT src FROM wires WHERE dst IN (SELECT stage FROM moved))
        SELECT stage FROM near WHERE stage NOT IN (SELECT stage FROM moved)""",
    "q_matrix_edges": "SELECT c_custkey + 1 AS src, j AS dst, ((c_custkey + 1) * 7 + j * 3) % 4 = 0 AS visible FROM customer, range(1, 26) t(j)",
}
QUERIES = {n: f for n, f in list(globals().items()) if n.startswith("q_")}
