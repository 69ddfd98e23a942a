"""Operator 9: chat formatting by tool-call linking.

Calls and results are joined by conversation and identifier; a call's place in the topological order
comes from its chain of ``after`` references by pointer doubling; arguments are parsed, checked against
the tool's schema and written as canonical JSON (sorted keys, no spaces, no escapes that can be left out).

Every call and every result comes out once. Cases: of calls with one identifier the first by position (then by
name and arguments) counts, the others are ``duplicate``, with their own arguments; of several results the first
(by position, then content) counts, the others are ``repeated``; results without a call come out as ``orphan``, those
with a null key one by one; both keep their content; a reference to a call that does not exist counts as none; calls on or behind a cycle of
references are ``cyclic`` without a level; null and empty arguments are ``malformed``, as are numbers
that are not finite and keys that repeat; a tool without schema is ``unknown``; null identifiers
match nothing, so such calls have no result; other columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluiceway.llm.common import land, table

KINDS = {
    "object": dict, "array": list, "string": str, "boolean": bool, "integer": int, "number": (int, float),
    "null": type(None),
}


def canonical(value: object) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def parse(text: str | None) -> object:
    """JSON without repeated keys and without numbers that are not finite."""

    def unique(pairs: list) -> dict:
        out = dict(pairs)
        if len(out) != len(pairs):
            raise ValueError("a key repeats")
        return out

    def refuse(name: str) -> None:
        raise ValueError(f"{name} is no number")

    value = json.loads(text or "", object_pairs_hook=unique, parse_constant=refuse)
    canonical(value)  # refuses numbers beyond the range of doubles
    return value


def problems(value: object, schema: dict, at: str = "$") -> list[str]:
    """What of ``value`` the schema refuses; the usual subset of JSON Schema."""
    kind = schema.get("type")
    if kind and (not isinstance(value, KINDS[kind]) or isinstance(value, bool) and kind in ("integer", "number")):
        return [f"{at}: not {kind}"]
    out = []
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{at}: not in enum")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        out += [f"{at}: below minimum"] * (value < schema.get("minimum", value))
        out += [f"{at}: above maximum"] * (value > schema.get("maximum", value))
    if isinstance(value, str):
        out += [f"{at}: too short"] * (len(value) < schema.get("minLength", 0))
        out += [f"{at}: too long"] * (len(value) > schema.get("maxLength", len(value)))
    if isinstance(value, list) and "items" in schema:
        out += [p for i, item in enumerate(value) for p in problems(item, schema["items"], f"{at}[{i}]")]
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in sorted(schema.get("required", [])) if k not in value]
        if schema.get("additionalProperties") is False:
            out += [f"{at}.{k}: not known" for k in sorted(value) if k not in known]
        out += [p for k in sorted(known) if k in value for p in problems(value[k], known[k], f"{at}.{k}")]
    return out


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) of distinct calls with ``after``: how many calls come before on the
    chain of references; null on and behind cycles. Each round doubles the span of every pointer."""
    ids = calls.select("conv_id", "call_id")
    known = ids.select(F.col("conv_id"), F.col("call_id").alias("after"), F.lit(True).alias("exists"))
    now = land(
        calls.select("conv_id", "call_id", "after").join(known, ["conv_id", "after"], "left")
        .select(
            "conv_id", "call_id", F.when(F.col("exists"), F.col("after")).alias("jump"),
            F.when(F.col("exists"), 1).otherwise(0).cast("long").alias("level"),
        ),
        "levels",
    )
    span, total = 1, None
    while True:
        open_, n = now.agg(F.count("jump"), F.count("*")).first()
        total = n if total is None else total
        if not open_ or span > total:
            break
        to = now.select("conv_id", F.col("call_id").alias("jump"), F.col("jump").alias("next"), F.col("level").alias("more"))
        now = land(
            now.join(to, ["conv_id", "jump"], "left").select(
                "conv_id", "call_id", F.col("next").alias("jump"),
                (F.col("level") + F.coalesce("more", F.lit(0))).alias("level"),
            ),
            "levels",
        )
        span *= 2
    return now.select("conv_id", "call_id", F.when(F.col("jump").isNull(), F.col("level")).alias("level"))


def link_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """One row per call, and per result that no call takes: conv_id, call_id, level, status, problems, message.

    ``calls``: conv_id, call_id, position, name, arguments, after; ``results``: conv_id, call_id,
    position, content. ``message`` is the call and its result, or the result alone, as canonical JSON. A conversation's messages in the order of (level, call_id) respect all references.
    """
    key = ["conv_id", "call_id"]
    # numbered and landed, so that of equal rows one and the same is the first
    calls = land(calls.select(*key, "position", "name", "arguments", "after").withColumn("row", F.monotonically_increasing_id()), "calls")
    results = land(results.select(*key, "position", "content").withColumn("row", F.monotonically_increasing_id()), "results")
    whole = F.col("call_id").isNotNull() & F.col("conv_id").isNotNull()
    first = land(
        calls.where(whole).groupBy(*key).agg(F.min(F.struct("position", "name", "arguments", "after", "row")).alias("c"))
        .select(*key, "c.*"), "first-calls",
    )
    answer = land(
        results.where(whole).groupBy(*key).agg(F.min(F.struct("position", "content", "row")).alias("r"))
        .select(*key, "r.content", F.col("r.row").alias("answer")), "first-results",
    )
    kinds = dict(calls.dtypes)
    columns = ["conv_id", "call_id", "level", "kind", "name", "arguments", "content", "answered"]

    def shaped(rows: DataFrame, kind, level=F.lit(None), answered=F.lit(False)) -> DataFrame:
        given = {c: F.col(c) if c in rows.columns else F.lit(None).cast("string") for c in ("name", "arguments", "content")}
        made = {"kind": kind, "level": level.cast("long"), "answered": answered, **given}
        return rows.select(*[made[c].alias(c) if c in made else F.col(c) for c in columns])

    joined = first.withColumn("called", F.lit(True)).join(levels(first), key).join(answer, key, "full")
    linked = shaped(joined, F.when(F.col("called"), "call").otherwise("orphan"), F.col("level"), F.col("answer").isNotNull())
    rows = (
        linked
        .unionByName(shaped(calls.where(~whole), F.lit("call"), F.lit(0)))
        .unionByName(shaped(calls.where(whole).join(first.select("row"), "row", "left_anti"), F.lit("duplicate")))
        .unionByName(shaped(results.where(~whole), F.lit("orphan")))
        .unionByName(shaped(
            results.where(whole).join(answer.select(F.col("answer").alias("row")), "row", "left_anti"), F.lit("repeated")
        ))
    )

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            status, wrong, messages = [], [], []
            for row in batch.select(columns[1:]).to_pylist():
                found, state = [], row["kind"]
                if state in ("orphan", "repeated"):
                    message = canonical({"id": row["call_id"], "result": row["content"]})
                else:
                    try:
                        arguments, fit = parse(row["arguments"]), True
                    except (ValueError, RecursionError):
                        arguments, fit = None, False
                    if state == "call":
                        schema = schemas.get(row["name"])
                        found = problems(arguments, schema) if fit and schema is not None else []
                        state = "malformed" if not fit else "unknown" if schema is None else "invalid" if found else "ok"
                        if row["level"] is None:
                            state = "cyclic"
                    message = canonical({
                        "arguments": arguments, "id": row["call_id"], "name": row["name"],
                        "result": row["content"] if row["answered"] else None,
                    })
                status.append(state)
                wrong.append("; ".join(found))
                messages.append(message)
            yield pa.RecordBatch.from_arrays(
                [batch[c] for c in ("conv_id", "call_id", "level")] + [pa.array(c, pa.string()) for c in (status, wrong, messages)],
                ["conv_id", "call_id", "level", "status", "problems", "message"],
            )

    return rows.mapInArrow(
        written,
        f"conv_id {kinds['conv_id']}, call_id {kinds['call_id']}, level long, status string, problems string, message string",
    )


def plain_turns(turns: DataFrame) -> DataFrame:
    """Turns that neither call nor answer, in the same columns: their status is ``turn``."""
    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.select(["role", "text"]).to_pylist()
            n, none = len(rows), pa.nulls(len(rows), pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch["conv_id"], none, pa.nulls(n, pa.int64()), pa.array(["turn"] * n, pa.string()), pa.array([""] * n, pa.string()),
                 pa.array([canonical({"content": r["text"], "role": r["role"]}) for r in rows], pa.string())],
                ["conv_id", "call_id", "level", "status", "problems", "message"],
            )

    kind = dict(turns.dtypes)["conv_id"]
    return turns.select("conv_id", "role", "text").mapInArrow(
        written, f"conv_id {kind}, call_id string, level long, status string, problems string, message string"
    )


#: The tools of the query: a short turn looks something up, a long one starts a search.
SCHEMAS = {
    "lookup": {
        "type": "object", "required": ["query", "turn"], "additionalProperties": False,
        "properties": {"query": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0}},
    },
    "search": {
        "type": "object", "required": ["query", "turn"], "additionalProperties": False,
        "properties": {"query": {"type": "string", "maxLength": 500}, "turn": {"type": "integer"}},
    },
}


def op9_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user turn calls a tool, the assistant's next turn is its result, and a call builds on that
    of the user turn before. Turns of other roles are kept as they are."""
    turns = table(spark, sf_dir, "conversations")
    call_id = lambda turn: F.concat(F.lit("call-"), turn.cast("string"))
    short = F.length(F.coalesce("text", F.lit(""))) < 200
    calls = turns.where("role = 'user'").select(
        "conv_id", call_id(F.col("turn")).alias("call_id"), F.col("turn").alias("position"),
        F.when(short, "lookup").otherwise("search").alias("name"),
        F.to_json(F.struct("turn", F.coalesce("text", F.lit("")).alias("query"))).alias("arguments"),
        call_id(F.col("turn") - 2).alias("after"),
    )
    results = turns.where("role = 'assistant'").select(
        "conv_id", call_id(F.col("turn") - 1).alias("call_id"), F.col("turn").alias("position"),
        F.coalesce("text", F.lit("")).alias("content"),
    )
    others = turns.where("role is null or role not in ('user', 'assistant')")
    return link_calls(calls, results, SCHEMAS).unionByName(plain_turns(others))


QUERIES = {"op9_tool_calls": op9_tool_calls}
ORACLES = {
    "op9_tool_calls": """
WITH u AS (
  SELECT conv_id, turn, coalesce(text, '') AS query,
         CASE WHEN length(coalesce(text, '')) < 200 THEN 'lookup' ELSE 'search' END AS name
  FROM conversations WHERE role = 'user' AND conv_id IS NOT NULL AND turn IS NOT NULL
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, turn
                               ORDER BY name, '{"turn":' || turn || ',"query":' || to_json(query) || '}') AS nth FROM u
), calls AS (
  SELECT *, turn // 2 - row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS island
  FROM ranked WHERE nth = 1
), levels AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, turn % 2, island ORDER BY turn) - 1 AS level FROM calls
), results AS (
  SELECT conv_id, turn - 1 AS turn, coalesce(text, '') AS content,
         row_number() OVER (PARTITION BY conv_id, turn ORDER BY coalesce(text, '')) AS nth
  FROM conversations WHERE role = 'assistant'
)
SELECT coalesce(l.conv_id, r.conv_id) AS conv_id, 'call-' || coalesce(l.turn, r.turn) AS call_id, l.level,
       CASE WHEN l.turn IS NULL THEN 'orphan'
            WHEN name = 'lookup' AND length(query) < 1 OR name = 'lookup' AND l.turn < 0
                 OR name = 'search' AND length(query) > 500 THEN 'invalid' ELSE 'ok' END AS status,
       CASE WHEN l.turn IS NULL THEN ''
            ELSE concat_ws('; ', CASE WHEN name = 'lookup' AND length(query) < 1 THEN '$.query: too short' END,
                 CASE WHEN name = 'search' AND length(query) > 500 THEN '$.query: too long' END,
                 CASE WHEN name = 'lookup' AND l.turn < 0 THEN '$.turn: below minimum' END) END AS problems,
       CASE WHEN l.turn IS NOT NULL THEN
         '{"arguments":{"query":' || to_json(query) || ',"turn":' || l.turn || '},"id":"call-' || l.turn || '","name":"' || name
         || '","result":' || coalesce(CAST(to_json(content) AS VARCHAR), 'null') || '}'
         ELSE '{"id":"call-' || r.turn || '","result":' || to_json(content) || '}' END AS message
FROM levels l FULL JOIN (SELECT * FROM results WHERE nth = 1) r ON l.conv_id = r.conv_id AND l.turn = r.turn
UNION ALL
SELECT conv_id, 'call-' || turn, NULL, 'duplicate', '', '{"arguments":{"query":' || to_json(query) || ',"turn":' || turn
       || '},"id":"call-' || turn || '","name":"' || name || '","result":null}' FROM ranked WHERE nth > 1
UNION ALL
SELECT conv_id, 'call-' || turn, NULL, 'repeated', '', '{"id":"call-' || turn || '","result":' || to_json(content) || '}'
FROM results WHERE nth > 1
UNION ALL
SELECT conv_id, NULL, NULL, 'turn', '', '{"content":' || coalesce(CAST(to_json(text) AS VARCHAR), 'null') || ',"role":'
       || coalesce(CAST(to_json(role) AS VARCHAR), 'null') || '}'
FROM conversations WHERE role IS NULL OR role NOT IN ('user', 'assistant')
""",
}
