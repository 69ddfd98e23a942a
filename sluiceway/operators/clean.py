"""Per-record parsing, projection, validation and routing."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluiceway.functions.senml import emit_message, observations, parse_message
from sluiceway.schemas import (
    ANNOTATION_FIELDS,
    DETECTIONS,
    SENSOR_FIELDS,
    TRIP_FIELDS,
    TRIP_NUMERIC,
    TRIP_RANGES,
)


def senml_parse(df: DataFrame, line: str = "line") -> DataFrame:
    """Add ``timestamp``, ``observations`` and ``bad_line`` to lines of SenML.

    ``bad_line`` is NULL on good rows. A line that does not parse keeps its whole
    text there instead of the fields read before the error.
    """
    # each step is generated rather than projected, so that later filters on its
    # columns do not copy the parsing expression below themselves
    parsed = df.select("*", F.inline(F.array(parse_message(F.col(line)))).alias("_bt", "_e", "_bad"))
    good = F.col("_bad").isNull() & F.col("_e").isNotNull()
    result = F.struct(
        F.when(good, F.coalesce("_bt", F.lit(0))).alias("timestamp"),
        F.when(good, observations(F.col("_e"))).alias("observations"),
        F.when(~good, F.col(line)).alias("bad_line"),
    )
    return parsed.select(*df.columns, F.inline(F.array(result)))


def split_bad(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, dead letters) of :func:`senml_parse`."""
    return df.where("bad_line is null").drop("bad_line"), df.where("bad_line is not null")


def as_columns(
    df: DataFrame, fields: Sequence[str], numeric: Sequence[str] = TRIP_NUMERIC
) -> DataFrame:
    """Promote observations to typed columns."""
    def column(name: str) -> Column:
        value = F.col("observations")[name]
        return (value.try_cast("double") if name in numeric else value).alias(name)

    kept = [c for c in df.columns if c != "observations"]
    return df.select(*kept, *[column(f) for f in fields])


def senml_emit(
    df: DataFrame,
    fields: Sequence[tuple[str, str, str]],
    base_time: str = "timestamp",
    key: str | None = None,
    output: str = "line",
) -> DataFrame:
    """Add SenML text with one element per (name, unit, kind); ``key`` gives a prefix."""
    message = emit_message(F.col(base_time), [f for f in fields if f[0] != base_time])
    if key:
        message = F.concat(F.col(key).cast("string"), F.lit(","), message)
    return df.withColumn(output, message)


def project_sensor(df: DataFrame) -> DataFrame:
    """The sensor tuple: identifier renamed, five readings as DOUBLE."""
    return df.select(
        F.col("taxi_identifier").alias("SENSORID"),
        *[F.col(f).cast("double").alias(f) for f in SENSOR_FIELDS],
    )


def coerce_trip(df: DataFrame, line: str = "line") -> DataFrame:
    """Positional CSV of 17 or 20 fields to the typed trip record.

    Quotes are stripped; a numeric field that is empty, ``null`` or unreadable is 0.
    """
    parts = F.col("_parts")

    def field(at: int, name: str) -> Column:
        text = F.regexp_replace(F.get(parts, F.lit(at)), '"', "")
        if name in TRIP_NUMERIC:
            text = F.coalesce(text.try_cast("double"), F.lit(0.0))
        return text.alias(name)

    base = [field(i, n) for i, n in enumerate(TRIP_FIELDS)]
    extra = [
        F.when(F.size(parts) == 20, F.get(parts, F.lit(17 + i))).alias(n)
        for i, n in enumerate(ANNOTATION_FIELDS)
    ]
    kept = [c for c in df.columns if c != line]
    return df.withColumn("_parts", F.split(line, ",", -1)).select(*kept, *base, *extra)


def set_attribute(df: DataFrame, values: Mapping[str, str], attributes: str = "attributes") -> DataFrame:
    """Set constant attributes; a name that is already there is overwritten."""
    added = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    kept = F.map_filter(attributes, lambda k, _: ~k.isin(*values))
    return df.withColumn(attributes, F.map_concat(kept, added))


def mark_processed(df: DataFrame, content: str = "content", mark: str = "\n Processed") -> DataFrame:
    return df.withColumn(content, F.concat(content, F.lit(mark)))


def split_text(
    df: DataFrame,
    text: str = "text",
    lines: int = 10,
    header_lines: int = 0,
    trim_newlines: bool = True,
) -> DataFrame:
    """One row per fragment of ``lines`` lines, with ``fragment_index`` and ``fragment``.

    Header lines are repeated in front of every fragment; a fragment that holds
    nothing but newlines is not emitted when they are trimmed. No shuffle.
    """
    all_lines = F.split(text, "\n", -1)
    body = F.slice(all_lines, header_lines + 1, F.size(all_lines))
    starts = F.when(
        F.size(body) > 0, F.sequence(F.lit(0), F.floor((F.size(body) - 1) / lines).cast("int"))
    ).otherwise(F.array().cast("array<int>"))

    def fragment(i: Column) -> Column:
        piece = F.array_join(F.slice(body, i * lines + 1, F.lit(lines)), "\n")
        if trim_newlines:
            piece = F.regexp_replace(piece, r"[\r\n]+\z", "")
        return F.struct(i.alias("fragment_index"), piece.alias("fragment"))

    pieces = F.transform(starts, fragment)
    if trim_newlines:
        pieces = F.filter(pieces, lambda p: p["fragment"] != "")
    kept = [c for c in df.columns if c != text]
    rows = df.select(*kept, F.inline(pieces), *([F.col(text)] if header_lines else []))
    if header_lines:
        head = F.array_join(F.slice(F.split(text, "\n", -1), 1, header_lines), "\n")
        rows = rows.withColumn("fragment", F.concat(head, F.lit("\n"), "fragment")).drop(text)
    return rows


def parse_ranges(spec: str) -> list[tuple[str, float, float]]:
    """``field:lo:hi,field:lo:hi`` to bounds."""
    out = []
    for part in filter(None, (p.strip() for p in spec.split(","))):
        name, low, high = part.split(":")
        out.append((name, float(low), float(high)))
    return out


def in_ranges(spec: str = TRIP_RANGES, mode: str = "all") -> Column:
    """Open-interval test of every configured field; a NULL reading fails.

    ``mode="last"`` lets only the last field of the list decide.
    """
    bounds = parse_ranges(spec)
    if mode == "last":
        bounds = bounds[-1:]
    elif mode != "all":
        raise ValueError(f"unknown mode {mode!r}")
    return reduce(
        lambda a, b: a & b, [(F.col(n) > lo) & (F.col(n) < hi) for n, lo, hi in bounds]
    )


def range_filter(df: DataFrame, spec: str = TRIP_RANGES, mode: str = "all") -> DataFrame:
    return df.where(in_ranges(spec, mode))


def has_label(content: Column, label: str) -> Column:
    """Does the JSON array of detections hold ``label``? Broken JSON does not."""
    found = F.exists(F.from_json(content, DETECTIONS), lambda d: d["label"] == label)
    return F.coalesce(found, F.lit(False))


def label_filter(df: DataFrame, label: str, content: str = "content") -> DataFrame:
    return df.where(has_label(F.col(content), label))


def batch_has_label(
    df: DataFrame, label: str, batch: str = "batch_id", content: str = "content"
) -> DataFrame:
    """One row per batch in which at least one file holds ``label``."""
    # filtered first: the partial aggregate then ships one row per batch and task
    return (
        label_filter(df, label, content)
        .groupBy(batch)
        .agg(F.count("*").alias("files"))
        .select(batch, F.lit("").alias("image_id"), F.lit("1").alias("from_filter"))
    )


def route(
    df: DataFrame, rules: Mapping[str, Column], otherwise: str = "failure"
) -> DataFrame:
    """Tag each row with the first relationship whose condition holds."""
    (name, first), *rest = rules.items()
    tag = F.when(first, F.lit(name))
    for name, condition in rest:
        tag = tag.when(condition, F.lit(name))
    return df.withColumn("relationship", tag.otherwise(F.lit(otherwise)))


def branches(
    routed: DataFrame, names: Sequence[str], auto_terminate: Sequence[str] = ()
) -> dict[str, DataFrame]:
    """One DataFrame per relationship that is not auto-terminated."""
    return {
        n: routed.where(F.col("relationship") == n).drop("relationship")
        for n in names
        if n not in auto_terminate
    }
