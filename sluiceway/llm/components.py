"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluiceway.llm.common import land


def _stars(edges: DataFrame) -> DataFrame:
    """Each node's (node, other) rows with the least node among it and its others."""
    least = edges.groupBy("node").agg(F.min("other").alias("least"))
    return edges.join(least, "node").withColumn("least", F.least("node", "least"))


def _tidy(edges: DataFrame) -> DataFrame:
    return edges.where("node <> other").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of ``edges`` (a, b) that reach a lesser node; component is the
    least node they reach. A node that is missing here is its own component.

    Nothing is gathered in one place: a step is a
    map-side aggregated minimum, a join whose hot nodes adaptive execution splits, and a distinct;
    each step's edges land in the shared folder. The number of steps is logarithmic in the nodes.
    """
    now = land(
        _tidy(edges.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("other"))), "edges"
    )
    before = None
    while True:
        # large star: neighbours above the node move to the least of its neighbourhood
        both = now.union(now.select(F.col("other").alias("node"), F.col("node").alias("other")))
        large = _tidy(
            _stars(both).where("other > node")
            .select(F.col("other").alias("node"), F.col("least").alias("other"))
        )
        # small star: the node and its lesser neighbours move to the least of them
        small = _stars(large)
        now = land(
            _tidy(
                small.select(F.col("other").alias("node"), F.col("least").alias("other"))
                .union(small.select("node", F.col("least").alias("other")))
            ),
            "edges",
        )
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("node", "other").cast("decimal(38,0)"))).first()
        if seen == before:
            break
        before = seen
    return now.withColumnRenamed("other", "component")
