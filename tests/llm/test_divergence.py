"""The source divergence audit against plain Python and its SQL."""

import os
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

import oracle
from sluiceway.llm import divergence

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
BILLION = 10**9


def brute(rows, min_docs=3, top=200):
    rows = [tuple(c or "" for c in r) for r in rows]
    words = [re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) for t, _, _ in rows]
    seen, counts = defaultdict(Counter), defaultdict(Counter)
    for (_, lang, source), found in zip(rows, words):
        seen[lang].update(set(found))
        counts[lang, source].update(found)
    out = []
    for lang in {r[1] for r in rows}:
        kept = sorted(t for t, n in seen[lang].items() if n >= min_docs)
        sources = sorted(s for l, s in counts if l == lang)
        whole = Counter()
        for s in sources:
            whole.update(counts[lang, s])

        def share(own):
            total = sum(own[t] for t in kept) + len(kept)
            return {t: 1 + BILLION * (own[t] + 1) // total for t in kept}

        p, q = {s: share(counts[lang, s]) for s in sources}, share(whole)
        for s in sources:
            pairs = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in sources if o != s]
            terms = [((p[s][t] - q[t]) ** 2 // q[t], t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, limit in (("pair", pairs, len(pairs)), ("term", terms, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(found[:limit])]
    return sorted(out)


TEXTS = [
    ("The cat sat; the CAT ran", "en", "a"), ("the cat_cat 9 lives\x00the", "en", "b"), ("a cat, THE end", "en", "a"),
    ("", "en", "empty"), (None, "en", None), (None, None, None), ("!!! 123", "xx", "x"), ("nur einmal", "de", "d"),
    ("Äpfel äpfel 日本 naïve", "en", "c"), ("Äpfel the 日本", "en", "c"), ("Äpfel 日本 😀 cat", "en", "a"),
    ("the cat sat; the cat ran", "en", "a"), ("x " * 70000 + "cat", "en", "long"), ("one two", "zz", "p"), ("one", "zz", "q"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(
        [(*t, i, "clash") for i, t in enumerate(TEXTS)], "text string, lang string, source string, n long, term string"
    )


@pytest.mark.parametrize("min_docs,top,cells", [(3, 200, 1 << 20), (1, 2, 4), (99, 200, 1)])
def test_audit(docs, min_docs, top, cells):
    got = sorted(tuple(r) for r in divergence.audit(docs, min_docs, top, cells).collect())
    assert got == brute(TEXTS, min_docs, top)


def test_counts_are_merged_within_a_task(docs, monkeypatch):
    batches = docs.select("text", "lang", "source").na.fill("").toArrow().to_batches(2)
    whole = divergence._merged([divergence.count_batch(b) for b in batches])
    monkeypatch.setattr(divergence, "HELD_ROWS", 3)
    cut = divergence._merged([divergence.pa.table(b.to_pydict(), b.schema) for b in divergence.counted(iter(batches))])
    assert sorted(map(tuple, zip(*whole.to_pydict().values()))) == sorted(map(tuple, zip(*cut.to_pydict().values())))


def test_shares_are_exact_for_large_counts():
    rng = np.random.default_rng(5)
    totals = rng.integers(1, 2 * 10**14, 2000)
    counts = (totals * rng.random(2000) ** 9).astype(np.int64) + 1
    counts = np.minimum(counts, totals)
    want = [1 + BILLION * int(c) // int(t) for c, t in zip(counts, totals)]
    assert divergence.shares(counts, totals).tolist() == want


def test_empty(docs):
    assert divergence.audit(docs.where("false")).count() == 0


def test_sql(spark):
    for name, query in divergence.QUERIES.items():
        assert oracle.differences(query(spark, SF), oracle.connect(SF), divergence.ORACLES[name]) is None
