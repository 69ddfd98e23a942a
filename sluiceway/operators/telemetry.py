"""Operator logs and usage logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluiceway.operators.sequence import HOT_ROWS, chunked, lookup, with_lookback
from sluiceway.session import pin


def parse_oplog(lines: DataFrame, line: str = "line") -> DataFrame:
    """``id,class,epoch_ms,event`` lines to columns."""
    parts = F.split(line, ",")
    return lines.select(
        F.get(parts, F.lit(0)).try_cast("bigint").alias("id"),
        F.get(parts, F.lit(1)).alias("class"),
        F.get(parts, F.lit(2)).try_cast("bigint").alias("ts_ms"),
        F.get(parts, F.lit(3)).alias("event"),
    )


def pair_entry_exit(
    log: DataFrame,
    keys: Sequence[str] = ("id",),
    order: Sequence[str] = ("ts_ms", "event"),
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Each EXIT that directly follows an ENTRY of the same id, with ``latency_ms``."""
    rows, by = with_lookback(log, keys, order, 1, hot_rows=hot_rows)
    w = Window.partitionBy(*by).orderBy(*order)
    return (
        rows.withColumn("_event", F.lag("event").over(w))
        .withColumn("entry_ms", F.lag(order[0]).over(w))
        .where("event = 'EXIT' and _event = 'ENTRY' and not _halo")
        .withColumnRenamed(order[0], "exit_ms")
        .withColumn("latency_ms", F.col("exit_ms") - F.col("entry_ms"))
        .drop("_event", "event", "_halo", "_chunk")
    )


def latency_summary(
    pairs: DataFrame,
    by: Sequence[str] = ("class",),
    percentiles: Sequence[float] = (0.5, 0.95),
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Count, min, mean, exact percentiles, span and throughput per group.

    Latencies are first counted per distinct millisecond. Their places in the order of a group are running sums, and
    a percentile is found at its places, so no task holds a group; a group with very many
    distinct latencies is cut into ranges (``sequence.chunked``).
    """
    histogram = pairs.groupBy(*by, "latency_ms").agg(
        F.count("*").alias("n"), F.min("entry_ms").alias("lo"), F.max("exit_ms").alias("hi")
    )
    # read for the totals, the sizes and the places
    histogram = pin(histogram)
    total, span = F.sum("n"), F.max("hi") - F.min("lo")
    summary = histogram.groupBy(*by).agg(
        total.alias("runs"),
        F.min("latency_ms").alias("min_ms"),
        F.max("latency_ms").alias("max_ms"),
        (F.sum(F.col("latency_ms") * F.col("n")) / total).alias("mean_ms"),
        span.alias("span_ms"),
        F.try_divide(total * 1000, span).alias("runs_per_sec"),
    )
    keys = {f"_key{i}": F.coalesce(F.col(c).cast("string"), F.lit("")) for i, c in enumerate(by)}
    keys |= {f"_null{i}": F.col(c).isNull() for i, c in enumerate(by)}
    cut = chunked(histogram.select("latency_ms", "n", *[c.alias(k) for k, c in keys.items()]), list(keys), ["latency_ms"], hot_rows)
    order = Window.partitionBy(*cut.by).orderBy("latency_ms").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = cut.rows.withColumn("_end", F.sum("n").over(order))
    if cut.hot:
        earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
        before = cut.hot_rows.groupBy(*cut.by).agg(F.sum("n").alias("_n")).select(
            *cut.by, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")
        )
        placed = lookup(placed, before, cut.by, "left").withColumn("_end", F.col("_end") + F.coalesce("_before", F.lit(0)))
    totals = histogram.select("n", *[c.alias(k) for k, c in keys.items()]).groupBy(*keys).agg(F.sum("n").alias("_total"))
    placed = lookup(placed, totals, list(keys))
    found = []
    for i, p in enumerate(percentiles):
        place = F.lit(p) * (F.col("_total") - 1)
        for side, at in (("low", F.floor(place)), ("high", F.ceil(place))):
            here = (at < F.col("_end")) & (at >= F.col("_end") - F.col("n"))
            found.append(F.max(F.when(here, F.col("latency_ms"))).alias(f"_{side}{i}"))
        found.append(F.first(place - F.floor(place)).alias(f"_part{i}"))
    picked = placed.groupBy(*keys).agg(*found)
    out = lookup(summary.withColumns(keys), picked, list(keys))
    values = {
        f"p{round(p * 100)}_ms": F.col(f"_low{i}") * (1 - F.col(f"_part{i}")) + F.col(f"_high{i}") * F.col(f"_part{i}")
        for i, p in enumerate(percentiles)
    }
    return out.withColumns(values).select(
        *by, "runs", "min_ms", "max_ms", "mean_ms", *values, "span_ms", "runs_per_sec"
    )


# Fixed value: layout of a usage line.
USAGE_LINE = r"^(.+?) CPU usage = ([0-9.]+)\s+MEM usage = ([0-9.]+)"


def parse_usage(lines: DataFrame, line: str = "line") -> DataFrame:
    """Usage lines to (ts, cpu, mem); lines of another shape drop out."""
    def part(i: int):
        return F.regexp_extract(line, USAGE_LINE, i)

    return lines.where(F.col(line).rlike(USAGE_LINE)).select(
        part(1).try_cast("timestamp").alias("ts"),
        part(2).try_cast("double").alias("cpu"),
        part(3).try_cast("double").alias("mem"),
    )


def resource_usage(usage: DataFrame, period: str = "1 hour") -> DataFrame:
    """Mean and maximum of CPU and memory per period."""
    return usage.groupBy(F.window("ts", period)).agg(
        F.count("*").alias("samples"),
        F.avg("cpu").alias("avg_cpu"), F.max("cpu").alias("max_cpu"),
        F.avg("mem").alias("avg_mem"), F.max("mem").alias("max_mem"),
    ).select(F.col("window.start").alias("period_start"), "samples", "avg_cpu", "max_cpu", "avg_mem", "max_mem")
