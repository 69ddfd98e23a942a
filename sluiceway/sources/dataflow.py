"""Dataflow documents as node, edge, relationship and property tables."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluiceway.schemas import DATAFLOW


class Dataflow(NamedTuple):
    """Tables of one or many documents, keyed by the kept columns.

    ``rejected`` has the documents that are not valid JSON.
    """

    nodes: DataFrame
    edges: DataFrame
    relationships: DataFrame
    properties: DataFrame
    rejected: DataFrame


def parse_dataflows(df: DataFrame, document: str = "document") -> Dataflow:
    """Split JSON documents (comments allowed) into tables."""
    kept = [c for c in df.columns if c != document]
    doc = F.from_json(
        document, f"{DATAFLOW}, _bad string",
        {"allowComments": "true", "columnNameOfCorruptRecord": "_bad"},
    )
    # generated rather than projected, so that the tables below do not copy the parser
    parsed = df.select("*", F.inline(F.array(F.struct(doc.alias("_doc")))))
    good = parsed.where("_doc._bad is null and _doc.processors is not null")
    stages = good.select(*kept, F.explode("_doc.processors").alias("p"))
    nodes = stages.select(
        *kept, F.col("p.uuid").alias("stage"), "p.name", F.col("p.class").alias("class"),
        F.coalesce("p.isInput", F.lit(False)).alias("is_input"),
    )
    edges = good.select(*kept, F.inline("_doc.wiring")).select(
        *kept, F.col("sourceProcessor").alias("src"), F.col("destinationProcessor").alias("dst"),
        F.explode_outer("selectedRelationships").alias("relationship"),
    )
    relationships = stages.select(
        *kept, F.col("p.uuid").alias("stage"), F.inline("p.relationships")
    ).select(
        *kept, "stage", F.col("name").alias("relationship"),
        F.coalesce("autoTerminate", F.lit(False)).alias("auto_terminate"),
    )
    properties = stages.select(
        *kept, F.col("p.uuid").alias("stage"), F.explode("p.properties").alias("entry")
    ).select(*kept, "stage", F.explode("entry").alias("property", "value"))
    rejected = parsed.where("not (_doc._bad is null and _doc.processors is not null)").drop("_doc")
    return Dataflow(nodes, edges, relationships, properties, rejected)


def read_dataflows(spark: SparkSession, path: str) -> Dataflow:
    """One document per file, keyed by ``filename``."""
    files = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_name").alias("filename"), F.col("value").alias("document")
    )
    return parse_dataflows(files)
