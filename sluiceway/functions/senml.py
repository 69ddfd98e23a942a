"""SenML text as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from sluiceway.schemas import SENML


def message_text(line: Column) -> Column:
    """What follows the first comma of ``key,json``; NULL when there is no comma."""
    at = F.locate(",", line)
    return F.when(at > 0, F.substring(line, at + 1, F.length(line)))


def parse_message(line: Column) -> Column:
    """STRUCT<bt, e, _bad>; ``_bad`` is set for a line that is not SenML."""
    text = F.coalesce(message_text(line), F.lit("?"))
    return F.from_json(text, f"{SENML}, _bad string", {"columnNameOfCorruptRecord": "_bad"})


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _known(text: Column) -> Column:
    return F.when(~text.isin("", "null"), text)


def observations(elements: Column) -> Column:
    """MAP<name, value> of the elements; ``v`` before ``sv``; the last of a name wins.

    The texts ``null`` and the empty text become NULL.
    """
    def last_of_name(pairs: Column) -> Column:
        return F.filter(
            pairs,
            lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"]),
        )

    def as_map(pairs: Column) -> Column:
        # the search for repeated names runs only on rows that have some
        distinct = F.size(F.array_distinct(F.transform(pairs, lambda p: p["key"])))
        return F.map_from_entries(F.when(distinct == F.size(pairs), pairs).otherwise(last_of_name(pairs)))

    pairs = F.transform(
        elements,
        lambda e: F.struct(
            F.coalesce(e["n"], F.lit("")).alias("key"),
            _known(F.coalesce(e["v"], e["sv"])).alias("value"),
        ),
    )
    return _let(pairs, as_map)


def emit_message(base_time: Column, fields: Sequence[tuple[str, str, str]]) -> Column:
    """JSON text with one element per (name, unit, kind) in the given order.

    A NULL reading gives no element, so parsing the text yields NULL again.
    """
    def element(name: str, unit: str, kind: str) -> Column:
        value = F.col(name).cast("string")
        nothing = F.lit(None).cast("string")
        return F.struct(
            F.lit(name).alias("n"),
            F.lit(unit).alias("u"),
            (value if kind == "v" else nothing).alias("v"),
            (nothing if kind == "v" else value).alias("sv"),
        )

    elements = F.array(*[element(*f) for f in fields])
    present = F.filter(elements, lambda e: e["v"].isNotNull() | e["sv"].isNotNull())
    return F.to_json(F.struct(base_time.cast("bigint").alias("bt"), present.alias("e")))
