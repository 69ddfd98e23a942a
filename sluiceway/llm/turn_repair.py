"""Operator 11: repair of the turn structure of conversations.

Rows are repartitioned by conversation once. Three sorts within these partitions follow each other:
by role and text, to mark what was said before; by turn downwards, where ``mapInPandas`` carries the
costs of the best repair of what follows from batch to batch and leaves a backpointer of one byte in
each row (two bits for each of four states); and by turn upwards, where a second ``mapInPandas``
follows the backpointers and writes the repair. The backpointers travel with the rows through Spark's
external sort, so a giant conversation spills to disk, and a task holds one batch, four costs, and for
``digest`` the edits of one conversation (a byte each). A conversation is one stream because its
repaired text has one hash from its first row to its last; others are spread by their ids.

Faults and edits. The first fault of a row counts: blank (no character beyond white space), duplicate
(role and text seen earlier), truncated (the last such character is none of ``.!?``). Keep costs 0,
Rerole to user or assistant 3, Delete 4 (required for blank and duplicate rows), Insert of an empty
user or assistant turn 3; a truncated row that stays adds 3. The cheapest edits whose roles begin with
``(s?(ua)+)?`` are taken, of equally cheap ones those with the least ``audit`` (initials D, I, K, R).

Cases: a null conversation is one of its own; null turns come first; rows of one turn are ordered by
role and text; null roles and texts are one space; a role is judged by its first character, so an
empty one fits nowhere; rows that repeat are duplicates; a conversation without rows has zeros, an
empty audit and the hash of nothing; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sluiceway.llm.common import table

WHITE = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: states: nothing yet, after system, after user, after assistant; the state after one more user or assistant
NEXT = (2, 2, 3, 2)
SPOKEN = {2: "user", 3: "assistant"}
EDITS = "DIKR"
#: the state after a kept row, by its initial
KEPT = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}
#: costs to end from each state, by insertions alone
END = (0, 6, 3, 0)
BLANK, DUPLICATE, CUT = 1, 2, 3

Costs = tuple[int, int, int, int]


def step_back(after: Costs, initial: str, fault: int) -> tuple[Costs, int]:
    """Costs from before a row, given those from after it, and the first edit from each state (two bits each)."""
    extra = TRUNCATED if fault == CUT else 0
    options = []
    for state in range(4):
        cost = {"D": DELETE + after[state]}
        if fault not in (BLANK, DUPLICATE):
            cost["R"] = REROLE + extra + after[NEXT[state]]
            kept = KEPT.get(initial, (None,) * 4)[state]
            if kept is not None:
                cost["K"] = KEEP + extra + after[kept]
        options.append(cost)
    best = [min(o.values()) for o in options]
    for _ in range(3):  # no state needs more insertions in a row
        best = [min(b, INSERT + best[NEXT[s]]) for s, b in enumerate(best)]
    edits = 0
    for state, cost in enumerate(options):
        cost["I"] = INSERT + best[NEXT[state]]
        edits |= EDITS.index(min(e for e in EDITS if cost.get(e) == best[state])) << 2 * state
    return tuple(best), edits


def turns(rows: DataFrame) -> DataFrame:
    """Rows ready to be repaired: conv (the id as text, marked), gone, turn, role, text, seen, fault, initial.

    Rows with ``gone`` only name their conversation.
    """
    gone = F.col("gone") if "gone" in rows.columns else F.lit(False)
    said = rows.select(
        F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("conv"), gone.alias("gone"),
        F.col("turn").cast("long").alias("turn"),
        *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")],
    )
    seen = F.row_number().over(Window.partitionBy("conv", "gone", "role", "text").orderBy("turn"))
    rest = F.rtrim("text", F.lit(WHITE))
    return (
        said.repartition("conv").withColumn("seen", seen)
        .withColumn("fault", F.when(rest == "", BLANK).when(F.col("seen") > 1, DUPLICATE)
                    .when(F.right(rest, F.lit(1)).isin(".", "!", "?"), 0).otherwise(CUT).cast("byte"))
        .withColumn("initial", F.substring("role", 1, 1))
    )


def _backpointers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    memory: dict[tuple, tuple[Costs, int]] = {}
    conv, costs = None, END
    for batch in batches:
        edits = []
        for own, gone, initial, fault in zip(*(batch[c].tolist() for c in ("conv", "gone", "initial", "fault"))):
            if own != conv:
                conv, costs = own, END
            if gone:
                edits.append(0)
                continue
            key = (costs, initial if initial in KEPT else "", fault)
            if key not in memory:
                before, edit = step_back(*key)
                least = min(before)
                memory[key] = tuple(c - least for c in before), edit
            costs, edit = memory[key]
            edits.append(edit)
        yield batch.assign(edits=np.array(edits, np.int16))


def planned(rows: DataFrame) -> DataFrame:
    """``turns`` in their order with the backpointer of each row (edits)."""
    order = ["turn", "role", "text", "seen"]
    said = turns(rows)
    schema = ", ".join(f"{n} {t}" for n, t in said.dtypes) + ", edits smallint"
    # a null turn is least in both directions of Spark's order; as a float it would lose digits, so it travels apart
    said = said.withColumn("unplaced", F.col("turn").isNull()).withColumn("turn", F.coalesce("turn", F.lit(0)))
    back = said.sortWithinPartitions(F.desc("conv"), F.asc("unplaced"), *[F.desc(c) for c in order])
    return back.mapInPandas(_backpointers, schema + ", unplaced boolean").sortWithinPartitions(
        F.asc("conv"), F.desc("unplaced"), *[F.asc(c) for c in order]
    )


class Replay:
    """Follows the backpointers of one conversation."""

    def __init__(self) -> None:
        self.state = 0

    def insertions(self, edits: int | None) -> Iterator[str]:
        """Roles inserted here; without ``edits``, at the end."""
        while (self.state in (1, 2)) if edits is None else (edits >> 2 * self.state & 3 == 1):
            self.state = NEXT[self.state]
            yield SPOKEN[self.state]

    def row(self, edits: int, role: str, initial: str) -> tuple[str, str | None]:
        """The edit of a row and its role afterwards, None if it goes."""
        edit = EDITS[edits >> 2 * self.state & 3]
        if edit == "D":
            return edit, None
        self.state = KEPT[initial][self.state] if edit == "K" else NEXT[self.state]
        return edit, role if edit == "K" else SPOKEN[self.state]


def _conversations(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[str | None, tuple | None]]:
    """(conversation, row) of a sorted stream, and (conversation, None) behind its last row."""
    conv = None
    names = ("conv", "gone", "unplaced", "turn", "role", "text", "initial", "fault", "edits")
    for batch in batches:
        for own, *row in zip(*(batch[c].tolist() for c in names)):
            if own != conv:
                if conv is not None:
                    yield conv, None
                conv = own
            yield conv, tuple(row)
    if conv is not None:
        yield conv, None


BATCH = 4096


def _framed(rows: Iterator[tuple], names: list[str]) -> Iterator[pd.DataFrame]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(c) for c in row if isinstance(c, str))
        if len(held) >= BATCH or size > 1 << 23:
            yield pd.DataFrame(held, columns=names)
            held, size = [], 0
    if held:
        yield pd.DataFrame(held, columns=names)


def _restored(df: DataFrame, kind: str) -> DataFrame:
    conv = F.when(F.col("conv") != "", F.col("conv").substr(F.lit(2), F.length("conv"))).cast(kind)
    return df.select(conv.alias("conv_id"), *[c for c in df.columns if c != "conv"])


def repair(rows: DataFrame) -> DataFrame:
    """The repaired turns: conv_id, place (from 0), edit (K, R or I), turn (null if inserted), role, text."""

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        replay, place = Replay(), 0
        for conv, row in _conversations(batches):
            gone, unplaced, turn, role, text, initial, _, edits = row or (False,) * 8
            if gone:
                continue
            for spoken in replay.insertions(edits if row else None):
                yield conv, place, "I", None, spoken, ""
                place += 1
            if row is None:
                replay, place = Replay(), 0
                continue
            edit, kept = replay.row(edits, role, initial)
            if kept is not None:
                yield conv, place, edit, None if unplaced else str(turn), kept, text
                place += 1

    names = ["conv", "place", "edit", "turn", "role", "text"]
    found = planned(rows).mapInPandas(
        lambda batches: _framed(lines(batches), names),
        "conv string, place long, edit string, turn string, role string, text string",
    )
    return _restored(found.withColumn("turn", F.col("turn").cast("long")), dict(rows.dtypes)["conv_id"])


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def digest(rows: DataFrame) -> DataFrame:
    """Per conversation: faults, cost and audit of the repair, and the SHA-256 of the repaired turns."""

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        fresh = True
        for conv, row in _conversations(batches):
            if fresh:
                replay, audit, sha, faults = Replay(), bytearray(), hashlib.sha256(), [0, 0, 0, 0]
                first = last = before = None
                distinct = illegal = cost = written = 0
                fresh = False

            def write(role: str, text: str) -> None:
                nonlocal written
                sha.update(f"{chr(10) if written else ''}{role}:{text}".encode("utf-8", "replace"))
                written += 1

            gone, unplaced, turn, role, text, initial, fault, edits = row or (False,) * 8
            if gone:
                continue
            for spoken in replay.insertions(edits if row else None):
                write(spoken, "")
                audit += b"I"
                cost += INSERT
            if row is None:
                gaps = last - first + 1 - distinct if distinct else 0
                yield conv, gaps, *faults[1:], illegal, cost, audit.decode(), sha.hexdigest()
                fresh = True
                continue
            faults[fault] += 1
            if not unplaced:
                distinct += turn != last
                first, last = turn if first is None else first, turn
            if before is not None:
                illegal += before + initial not in ("su", "ua", "au")
            before = initial
            edit, kept = replay.row(edits, role, initial)
            audit += edit.encode()
            cost += {"K": KEEP, "R": REROLE, "D": DELETE}[edit]
            if kept is not None:
                write(kept, text)
                cost += TRUNCATED if fault == CUT else 0

    names = ["conv", *COUNTS, "audit", "repaired_sha256"]
    found = planned(rows).mapInPandas(
        lambda batches: _framed(summed(batches), names),
        f"conv string, {', '.join(f'{c} long' for c in COUNTS)}, audit string, repaired_sha256 string",
    )
    return _restored(found, dict(rows.dtypes)["conv_id"])


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with faults put in by a hash of conversation and turn; rows that are dropped stay as ``gone``."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    rows = conversations.select(
        "conv_id", "turn", *[F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")],
        (F.crc32(key.cast("binary")) % 20).alias("harm"),
    )
    return rows.select(
        "conv_id", "turn", F.when(F.col("harm") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("harm") <= 1, "").when(F.col("harm") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        (F.col("harm") == 0).alias("gone"),
        F.explode(F.when(F.col("harm") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(damaged(table(spark, sf_dir, "conversations")))


QUERIES = {"op11_turn_repair": op11_turn_repair}
_WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
ORACLES = {
    "op11_turn_repair": f"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key
  FROM conversations
), hashed AS (
  SELECT *, xor(4294967295, list_reduce(
    flatten(list_prepend([4294967295], [[ord(c), -1, -1, -1, -1, -1, -1, -1, -1] for c in string_split(key, '')])),
    lambda h, x: CASE WHEN x >= 0 THEN xor(h, x) WHEN h % 2 = 1 THEN xor(h // 2, 3988292384) ELSE h // 2 END)) % 20 AS harm
  FROM keyed
), harmed AS (
  SELECT conv_id, turn, CASE harm WHEN 4 THEN 'user' ELSE role END AS role,
         CASE harm WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(range(CASE harm WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM hashed
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen,
         rtrim(text, {_WHITE}) AS said
  FROM harmed
), judged AS (
  SELECT conv_id, turn, role, text, i, left(role, 1) AS initial,
         CASE WHEN said = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate'
              WHEN right(said, 1) IN ('.', '!', '?') THEN '' ELSE 'truncated' END AS fault,
         lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS step
  FROM placed
), inserted(q, q2, n, lines) AS (
  VALUES (0, 0, 0, ''), (1, 1, 0, ''), (2, 2, 0, ''), (3, 3, 0, ''),
         (0, 2, 1, 'user:' || chr(10)), (1, 2, 1, 'user:' || chr(10)), (2, 3, 1, 'assistant:' || chr(10)), (3, 2, 1, 'user:' || chr(10)),
         (0, 3, 2, 'user:' || chr(10) || 'assistant:' || chr(10)), (1, 3, 2, 'user:' || chr(10) || 'assistant:' || chr(10)),
         (2, 2, 2, 'assistant:' || chr(10) || 'user:' || chr(10)), (3, 3, 2, 'user:' || chr(10) || 'assistant:' || chr(10))
), edits(q2, edit, initial, q3, price, spoken) AS (
  VALUES (0, 'D', NULL, 0, 4, NULL), (1, 'D', NULL, 1, 4, NULL), (2, 'D', NULL, 2, 4, NULL), (3, 'D', NULL, 3, 4, NULL),
         (0, 'R', NULL, 2, 3, 'user'), (1, 'R', NULL, 2, 3, 'user'), (2, 'R', NULL, 3, 3, 'assistant'), (3, 'R', NULL, 2, 3, 'user'),
         (0, 'K', 's', 1, 0, NULL), (0, 'K', 'u', 2, 0, NULL), (1, 'K', 'u', 2, 0, NULL), (2, 'K', 'a', 3, 0, NULL), (3, 'K', 'u', 2, 0, NULL)
), best AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS i, 0 AS q, {{'cost': 0::BIGINT, 'audit': '', 'lines': ''}} AS b FROM conversations
  UNION ALL
  SELECT p.conv_id, j.i, q3, min({{
    'cost': b.cost + 3 * n + price + CASE WHEN edit <> 'D' AND fault = 'truncated' THEN 3 ELSE 0 END,
    'audit': b.audit || repeat('I', n) || edit,
    'lines': b.lines || s.lines || CASE WHEN edit = 'D' THEN '' ELSE coalesce(spoken, role) || ':' || text || chr(10) END}})
  FROM best p JOIN judged j ON j.conv_id IS NOT DISTINCT FROM p.conv_id AND j.i = p.i + 1
  JOIN inserted s USING (q) JOIN edits e USING (q2)
  WHERE (e.initial IS NULL OR e.initial = j.initial) AND (edit = 'D' OR fault NOT IN ('blank', 'duplicate'))
  GROUP BY p.conv_id, j.i, q3
), counts AS (
  SELECT conv_id, count(*) AS rows, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (step NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY conv_id
), ended AS (
  SELECT conv_id, i, min({{'cost': b.cost + 3 * n, 'audit': b.audit || repeat('I', n), 'lines': b.lines || s.lines}}) AS b
  FROM best JOIN inserted s USING (q) WHERE q2 IN (0, 3) GROUP BY conv_id, i
)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, b.cost AS cost, b.audit AS audit,
       sha256(CASE WHEN b.lines = '' THEN '' ELSE left(b.lines, length(b.lines) - 1) END) AS repaired_sha256
FROM ended e LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM e.conv_id WHERE e.i = coalesce(c.rows, 0)
""",
}
