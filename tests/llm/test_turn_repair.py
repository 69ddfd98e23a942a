"""Conversation repair against a search over all repairs."""

import hashlib
import itertools
import os
import random
import re
import zlib
from collections import defaultdict

import pytest

import oracle
from sluiceway.llm import turn_repair as tr

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
VALID = re.compile(r"(s?(ua)+)?")


def trimmed(text):
    return text.rstrip(" \t\n\x0b\x0c\r")


def best_edits(rows):
    """(cost, audit, lines) of the cheapest repair: shortest paths over (rows done, roles so far cut to what matters)."""
    level = {"": (0, "", ())}
    for role, text, fault in rows:
        level = _inserted(level)
        after = {}
        for roles, (cost, audit, lines) in level.items():
            moves = [("D", 4, None)]
            if fault not in ("blank", "duplicate"):
                more = 3 if fault == "truncated" else 0
                moves += [("K", more, role), ("R", 3 + more, "user"), ("R", 3 + more, "assistant")]
            for edit, price, spoken in moves:
                key = roles if spoken is None else _short(roles + (spoken[:1] or "-"))
                if key is None:
                    continue
                new = (cost + price, audit + edit, lines if spoken is None else lines + (f"{spoken}:{text}",))
                after[key] = min(after.get(key, new), new)
        level = after
    return min(v for k, v in _inserted(level).items() if VALID.fullmatch(k))


def _short(roles):
    """Roles that can still become valid, without whole pairs behind the first."""
    if not re.fullmatch(r"s?(ua)*u?", roles):
        return None
    return re.sub(r"(ua)+", "ua", roles)


def _inserted(level):
    level = dict(level)
    for _ in range(4):
        for roles, (cost, audit, lines) in list(level.items()):
            for spoken in ("user", "assistant"):
                key = _short(roles + spoken[0])
                if key is not None:
                    new = (cost + 3, audit + "I", lines + (f"{spoken}:",))
                    level[key] = min(level.get(key, new), new)
    return level


def brute(rows, harm=True):
    """The digest of each conversation of (conv_id, turn, role, text) rows."""
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        convs[conv]
        key = ":".join(" " if v is None else str(v) for v in (conv, turn))
        kind = zlib.crc32(key.encode()) % 20 if harm else 19
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        convs[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, own in convs.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, judged, counts = set(), [], defaultdict(int)
        for turn, role, text in own:
            fault = (
                "blank" if not trimmed(text) else "duplicate" if (role, text) in seen
                else "truncated" if trimmed(text)[-1] not in ".!?" else None
            )
            seen.add((role, text))
            counts[fault] += 1
            judged.append((role, text, fault))
        known = [t for t, _, _ in own if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        cost, audit, lines = best_edits(judged)
        out[conv] = (
            gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


def got(df):
    return {r.conv_id: tuple(r)[1:] for r in df.collect()}


def frame(spark, rows):
    return spark.createDataFrame(
        [(*r, "x", 1, 2) for r in rows], "conv_id long, turn long, role string, text string, conv string, seen int, edits int"
    )


@pytest.fixture(scope="module")
def rows():
    r = random.Random(11)
    said = ["Yes.", "No!", "cut", "", "  \t", "Why?  ", "Yes. ", "é…", "."]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", " ", "u"]
    out = []
    for conv in range(300):
        for turn in range(r.randrange(1, 9)):
            out.append((conv, r.choice([turn, turn, turn, turn + 1, None]), r.choice(roles), r.choice(said)))
    out += [(None, 1, "user", "Yes."), (None, 2, "assistant", "Right."), (None, None, None, None), (-5, 10**15 + 1, "user", "a."),
            (-5, 10**15 + 7, "user", "b."), (-5, None, "user", "c."), (2**62 + 1, 0, "system", "s.")]
    return out


def test_brute_force(spark, rows):
    assert got(tr.digest(tr.damaged(frame(spark, rows)))) == brute(rows)
    assert got(tr.digest(frame(spark, rows))) == brute(rows, harm=False)


def test_repaired_turns(spark, rows):
    want, lines = brute(rows, harm=False), defaultdict(list)
    for r in tr.repair(frame(spark, rows)).orderBy("conv_id", "place").collect():
        assert r.place == len(lines[r.conv_id])
        lines[r.conv_id].append(f"{r.role}:{r.text}")
    for conv, digest in want.items():
        assert hashlib.sha256("\n".join(lines[conv]).encode()).hexdigest() == digest[-1]
        assert VALID.fullmatch("".join(line[:1] for line in lines[conv]))


def test_a_giant_conversation_streams_over_many_batches(spark):
    rows = [(7, i, ["user", "assistant"][i % 2], f"turn {i}{'.' if i % 5 else ''}") for i in range(5000) if i % 11]
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        assert got(tr.digest(frame(spark, rows))) == brute(rows, harm=False)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)


def test_one_shuffle(spark, rows):
    plan = tr.digest(frame(spark, rows))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_empty(spark, rows):
    assert tr.digest(frame(spark, rows).where("false")).count() == tr.repair(frame(spark, rows).where("false")).count() == 0


def test_whole_table(spark):
    df = spark.read.parquet(f"{SF}/conversations.parquet")
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    assert got(tr.op11_turn_repair(spark, SF)) == brute(rows)


def test_sql(spark):
    for name, sql in tr.ORACLES.items():
        assert oracle.differences(tr.QUERIES[name](spark, SF), oracle.connect(SF), sql) is None
