"""Three-line sidecar schemas: names, units, kinds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluiceway.schemas import TRIP_KINDS


def read_sidecar(spark: SparkSession, path: str) -> DataFrame:
    """(position, name, unit, kind, is_time), one row per column of the data."""
    text = spark.read.text(path, wholetext=True)
    lines = F.split("value", r"\r?\n")

    def cells(i: int):
        return F.split(F.get(lines, F.lit(i)), ",")

    zipped = F.arrays_zip(cells(0).alias("name"), cells(1).alias("unit"), cells(2).alias("kind"))
    return text.select(F.posexplode(zipped).alias("position", "c")).select(
        "position", F.trim("c.name").alias("name"), F.trim("c.unit").alias("unit"),
        F.trim("c.kind").alias("kind"), (F.trim("c.name") == "timestamp").alias("is_time"),
    )


def sidecar_fields(sidecar: DataFrame) -> list[tuple[str, str, str]]:
    """(name, unit, kind) in order; a sidecar has one row per column, so this is small."""
    return [(r["name"], r["unit"], r["kind"]) for r in sidecar.orderBy("position").collect()]


def sidecar_schema(fields: list[tuple[str, str, str]]) -> T.StructType:
    """Kind ``v`` is a number, ``sv`` a string; the unit is kept as metadata."""
    numeric = set(TRIP_KINDS) - {"sv"}
    return T.StructType([
        T.StructField(n, T.DoubleType() if k in numeric else T.StringType(), True, {"unit": u, "kind": k})
        for n, u, k in fields
    ])
