"""Compare a registered query with its SQL twin in DuckDB."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    return value


def differences(df, con, sql: str) -> str | None:
    """None when both sides hold the same rows, else what differs."""
    names = sorted(df.columns)
    ours = [tuple(_cell(r[n]) for n in names) for r in df.collect()]
    result = con.execute(sql)
    their_names = [d[0] for d in result.description]
    if sorted(their_names) != names:
        return f"columns {names} != {sorted(their_names)}"
    at = [their_names.index(n) for n in names]
    theirs = [tuple(_cell(r[i]) for i in at) for r in result.fetchall()]
    left, right = Counter(ours), Counter(theirs)
    if left == right:
        return None
    only_ours, only_theirs = list((left - right).elements())[:3], list((right - left).elements())[:3]
    return f"{len(ours)} rows against {len(theirs)}; {names}: only ours {only_ours}, only theirs {only_theirs}"
