"""Shapes of physical plans that must hold at scale."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from sluiceway.operators import analytics, batches, catalog, clean
from sluiceway.operators.impute import impute_mean
from sluiceway.plans.tables import table

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# a cartesian or nested-loop join grows with the product of its sides
@pytest.mark.parametrize("name", [
    "q_etl", "q_bloom_filter", "q_annotate", "q_join_batch_exists", "q_join_batch_complete", "q_link_transport",
    "q_affected_neighbours", "q_deal_round_robin", "q_sample_batches", "q_placement_diff", "q_linear_retrain",
])
def test_no_product_joins(spark, name):
    text = plan(entry.queries()[name](spark, SF))
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_range_lookup_reaches_the_scan(spark):
    text = plan(entry.queries()["q_table_range_lookup"](spark, SF))
    for part in ("EqualTo(event_type,click)", "GreaterThanOrEqual(event_", "ReadSchema: struct<event_id:bigint,user_id:bigint,event_type:string,value:double>"):
        assert part in text


def test_catalog_prefix_is_pushed(spark, tmp_path):
    spark.range(3).select(F.concat(F.lit("/device/"), "id").alias("href")).write.parquet(str(tmp_path / "c"))
    from sluiceway.operators.catalog import catalog_prefix

    assert "StringStartsWith(href,/device/)" in plan(catalog_prefix(spark.read.parquet(str(tmp_path / "c")), "/device/"))


def test_impute_shuffles_once(spark):
    rows = table(spark, SF, "trips").select("msg_id", "taxi_identifier", "surcharge")
    text = plan(impute_mean(rows, "surcharge", 5))
    assert text.count("Exchange hashpartitioning") == 1
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint>" in text


def test_kalman_shuffles_once(spark):
    rows = table(spark, SF, "trips").select("msg_id", "taxi_identifier", "fare_amount")
    assert plan(analytics.kalman(rows, "fare_amount")).count("Exchange hashpartitioning") == 1


def test_stateless_steps_do_not_shuffle(spark):
    for name in ("q_senml_parse", "q_senml_emit", "q_coerce_trip", "q_split_text", "q_range_filter", "q_label_filter", "q_route", "q_envelope_frame"):
        assert "Exchange" not in plan(entry.queries()[name](spark, SF)), name
    cells = spark.createDataFrame([(1, "0,1")], "src long, line string")
    assert "Exchange" not in plan(catalog.matrix_edges(cells))


def test_documents_are_parsed_once(spark):
    for name, tables in (("q_pivot_devices", 1), ("q_read_dag", 5)):
        text = entry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert text.count("from_json") <= tables, name


def test_gate_limits_before_the_shuffle(spark):
    text = plan(batches.batch_gate(table(spark, SF, "batch_items")))
    assert "WindowGroupLimit" in text and "Partial" in text


def test_parsing_is_not_repeated_by_filters(spark):
    lines = spark.createDataFrame([("k,{}",)], "line string")
    wide = clean.as_columns(clean.split_bad(clean.senml_parse(lines))[0], ["fare_amount", "trip_distance"])
    text = plan(wide.where("fare_amount > 1 and trip_distance < 5"))
    assert text.count("from_json") == 1 and text.count("map_from_entries") == 1


def test_batch_dirs_are_pruned(spark, tmp_path):
    from sluiceway.sources.files import read_batch_dirs

    path = str(tmp_path / "b")
    spark.range(100).select((F.col("id") % 10).alias("batch_id"), "id").write.partitionBy("batch_id").parquet(path)
    df = read_batch_dirs(spark, path, spark.range(2).withColumnRenamed("id", "batch_id"))
    assert df.count() == 20 and "dynamicpruning" in plan(df)
