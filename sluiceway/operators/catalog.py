"""The device catalogue as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluiceway.operators.sequence import HOT_ROWS, lookup, with_position
from sluiceway.schemas import CATALOG_ITEM, CATALOGUE_METADATA

META = "item-metadata"


def parse_items(df: DataFrame, body: str = "body") -> DataFrame:
    """JSON bodies to (href, item-metadata)."""
    item = F.from_json(body, CATALOG_ITEM)
    kept = [c for c in df.columns if c not in (body, "href")]
    # generated rather than projected, so that filters on the parts do not copy the parser below themselves
    return df.select(*kept, F.inline(F.array(item))).select(*kept, "href", f"`{META}`")


def _href_part(at: int) -> Column:
    return F.get(F.split("href", "/"), F.lit(at))


def _rel(name: str) -> Column:
    """The last value given for a relation."""
    hits = F.filter(F.col(f"`{META}`"), lambda m: m["rel"] == name)
    return F.get(hits, F.size(hits) - 1)["val"]


# Href kind and relation of each device property.
DEVICE_RELS = (
    ("device_uuid", "meta", "DeviceUUID", "string"),
    ("ip", "ip", "IP", "string"),
    ("cpu_util", "cpu", "CPUUtil", "double"),
    ("mem_util", "mem", "MemUtil", "double"),
    ("cpu_avail", "meta", "Total CPU Available", "double"),
    ("mem_avail", "meta", "Total Memory Available", "double"),
)


def pivot_devices(items: DataFrame, strict_boolean: bool = False) -> DataFrame:
    """One row per device from its catalogue items.

    ``1`` and ``true`` count as accelerated; ``strict_boolean`` accepts only ``true``.
    """
    flat = items.where(F.col("href").startswith("/device/")).select(
        _href_part(3).alias("device_id"), _href_part(2).alias("kind"), F.inline(F.col(f"`{META}`"))
    )

    def pick(kind: str, rel: str) -> Column:
        return F.max(F.when((F.col("kind") == kind) & (F.col("rel") == rel), F.col("val")))

    truthy = ["true"] if strict_boolean else ["true", "1"]
    return flat.groupBy("device_id").agg(
        *[pick(kind, rel).try_cast(cast).alias(name) for name, kind, rel, cast in DEVICE_RELS],
        F.coalesce(F.lower(pick("meta", "isAccelerated")).isin(truthy), F.lit(False)).alias("accelerated"),
    )


def device_children(items: DataFrame) -> DataFrame:
    """Containers and input streams, one row each, with their device."""
    kind = _href_part(2)
    return items.where(kind.isin("containers", "input_stream")).select(
        _href_part(3).alias("device_id"),
        kind.alias("child_kind"),
        F.when(kind == "containers", _rel("ContainerUUID"))
        .otherwise(_rel("Input_Stream_UUID")).alias("child_id"),
        _rel("Port").try_cast("int").alias("port"),
        _rel("Type").alias("type"),
    )


def children_per_device(children: DataFrame, page_rows: int = 10_000, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Children as sorted arrays per device, in pages: page k holds the children from place k * ``page_rows`` on.

    No row holds more than a page, and a device with very many children is put in order in ranges.
    """
    entry = ["child_id", "port", "type"]
    placed, _ = with_position(children, ["device_id", "child_kind"], entry, hot_rows)
    paged = placed.withColumn("page", F.floor((F.col("_pos") - 1) / page_rows))
    return paged.groupBy("device_id", "child_kind", "page").agg(
        F.count("*").alias("children_count"),
        F.array_sort(F.collect_list(F.struct(*entry))).alias("children"),
    )


def catalog_exact(items: DataFrame, href: str) -> DataFrame:
    return items.where(F.col("href") == href)


def catalog_prefix(items: DataFrame, prefix: str, mode: str = "prefix") -> DataFrame:
    """Items below an href; ``mode="contains"`` matches anywhere in it."""
    if mode not in ("prefix", "contains"):
        raise ValueError(f"unknown mode {mode!r}")
    href = F.col("href")
    return items.where(href.startswith(prefix) if mode == "prefix" else href.contains(prefix))


def catalog_envelopes(
    items: DataFrame, description: str, page_items: int = 10_000
) -> DataFrame:
    """The catalogue as JSON documents of about ``page_items`` items, dealt by hash of href."""
    pages = max(1, -(-items.count() // page_items))
    header = [(r, v) for r, v in CATALOGUE_METADATA]
    header.insert(1, ("urn:X-hypercat:rels:hasDescription:en", description))
    meta = F.array(*[F.struct(F.lit(r).alias("rel"), F.lit(v).alias("val")) for r, v in header])
    item = F.struct("href", F.col(f"`{META}`").alias(META))
    return (
        items.groupBy(F.pmod(F.xxhash64("href"), F.lit(pages)).alias("page"))
        .agg(F.collect_list(item).alias("items"))
        .select("page", F.to_json(F.struct(meta.alias("catalogue-metadata"), "items")).alias("document"))
    )


def read_envelopes(documents: DataFrame, document: str = "document") -> DataFrame:
    """Catalogue documents back to items."""
    parsed = F.from_json(document, f"items array<struct<{CATALOG_ITEM}>>")
    return documents.select(F.inline(parsed["items"]))


def catalog_apply(changes: DataFrame) -> DataFrame:
    """Fold a change log (seq, op, href, body): POST stores by href, DELETE removes."""
    return (
        changes.groupBy("href")
        .agg(F.max_by(F.struct("op", "body"), "seq").alias("_last"))
        .where("_last.op <> 'DELETE'")
        .select("href", "_last.body")
    )


def dataflow_registry(items: DataFrame) -> DataFrame:
    """Stored dataflows as (dataflow, original_json, stage, device) rows; one without mapping has NULLs."""
    mapping = F.from_json(F.regexp_replace(_rel("Mapping JSON"), r'\\+"', '"'), "map<string,string>")
    return items.where(F.col("href").startswith("/dataflow/")).select(
        _rel("DataFlowUUID").alias("dataflow"),
        _rel("originalJSON").alias("original_json"),
        F.explode_outer(mapping).alias("stage", "device"),
    )


def placement_map(stages: DataFrame, mapping: DataFrame, devices: DataFrame) -> DataFrame:
    """(stage, device) with the columns of both ends; unknown ends drop out."""
    return stages.join(mapping, "stage").join(devices, "device")


def placement_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Stages whose device changed, appeared or vanished."""
    return (
        old.withColumnRenamed("device", "old_device")
        .join(new.withColumnRenamed("device", "new_device"), "stage", "full_outer")
        .where(~F.col("old_device").eqNullSafe(F.col("new_device")))
    )


def affected_neighbours(wires: DataFrame, moved: DataFrame) -> DataFrame:
    """Stages next to a moved stage that do not move themselves."""
    # both directions of a wire in one pass: the neighbour and what it touches
    ends = F.array(
        F.struct(F.col("src").alias("stage"), F.col("dst").alias("touches")),
        F.struct(F.col("dst").alias("stage"), F.col("src").alias("touches")),
    )
    moving = moved.select("stage").distinct()
    near = lookup(
        wires.select(F.inline(ends)), moving.withColumnRenamed("stage", "touches"), "touches", "left_semi"
    )
    return near.select("stage").distinct().join(moving, "stage", "left_anti")


def matrix_edges(lines: DataFrame, row: str = "src", line: str = "line") -> DataFrame:
    """0/1 CSV rows, numbered from 1, to (src, dst, visible)."""
    return lines.select(F.col(row).alias("src"), F.posexplode(F.split(line, ","))).select(
        "src", (F.col("pos") + 1).alias("dst"), (F.trim("col") == "1").alias("visible")
    )
