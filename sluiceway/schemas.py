"""Record layouts of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

# Field names, units and kinds of the taxi trip sidecar schema.
TRIP_FIELDS = (
    "taxi_identifier", "hack_license", "pickup_datetime", "timestamp",
    "trip_time_in_secs", "trip_distance", "pickup_longitude", "pickup_latitude",
    "dropoff_longitude", "dropoff_latitude", "payment_type", "fare_amount",
    "surcharge", "mta_tax", "tip_amount", "tolls_amount", "total_amount",
)
TRIP_UNITS = (
    "string", "string", "time", "timestamp", "second", "meter", "lon", "lat",
    "lon", "lat", "string", "dollar", "percentage", "percentage", "dollar",
    "dollar", "dollar",
)
TRIP_KINDS = (
    "sv", "sv", "sv", "sv", "v", "v", "sv", "sv", "sv", "sv", "sv", "v", "v",
    "v", "v", "v", "v",
)
ANNOTATION_FIELDS = ("taxi_company", "drivername", "taxi_city")
TRIP_NUMERIC = (
    "trip_time_in_secs", "trip_distance", "fare_amount", "surcharge",
    "mta_tax", "tip_amount", "tolls_amount", "total_amount",
)
META_FIELDS = (
    "pickup_datetime", "pickup_longitude", "pickup_latitude",
    "dropoff_longitude", "dropoff_latitude", "payment_type",
)
SENSOR_FIELDS = (
    "trip_time_in_secs", "trip_distance", "fare_amount", "tip_amount", "surcharge",
)
# The configured open ranges.
TRIP_RANGES = (
    "trip_time_in_secs:140:3155,trip_distance:1.37:29.86,fare_amount:6.00:201.00,"
    "tip_amount:0.65:38.55,surcharge:0.1:1.0"
)
TRIP_RANGES_WITH_TOLLS = (
    "trip_time_in_secs:140:3155,trip_distance:1.37:29.86,fare_amount:6.00:201.00,"
    "tip_amount:0.65:38.55,tolls_amount:2.50:18.00,surcharge:0.1:1.0"
)
# Descriptive header of a catalogue document.
CATALOGUE_METADATA = (
    ("urn:X-hypercat:rels:isContentType", "application/vnd.hypercat.catalogue+json"),
    ("urn:X-hypercat:rels:supportsSearch", "urn:X-hypercat:search:multi"),
    ("urn:X-hypercat:rels:supportsSearch", "urn:X-hypercat:search:prefix"),
)

# unit and element time are not read: neither reaches the observations
SENML = "bt bigint, e array<struct<n string, v string, sv string>>"
DETECTIONS = (
    "array<struct<label string, confidence double, "
    "topleft struct<x double, y double>, bottomright struct<x double, y double>>>"
)
ENVELOPE = "attributes map<string,string>, content string"
CATALOG_ITEM = "href string, `item-metadata` array<struct<rel string, val string>>"
DATAFLOW = (
    "processors array<struct<name string, class string, uuid string, isInput boolean, "
    "sourceUuid string, "
    "relationships array<struct<name string, autoTerminate boolean>>, "
    "properties array<map<string,string>>, config array<map<string,string>>>>, "
    "wiring array<struct<sourceProcessor string, destinationProcessor string, "
    "selectedRelationships array<string>>>, inputstreams array<string>, QOS int"
)

IMAGE_TABLE = T.StructType([
    T.StructField("ID", T.IntegerType()),
    T.StructField("BATCH_ID", T.IntegerType()),
    T.StructField("IMAGE", T.BinaryType()),
])


def trip_record(annotated: bool = False) -> T.StructType:
    """Typed trip: 17 fields, 20 once annotated."""
    names = TRIP_FIELDS + (ANNOTATION_FIELDS if annotated else ())
    return T.StructType([
        T.StructField(n, T.DoubleType() if n in TRIP_NUMERIC else T.StringType())
        for n in names
    ])
