"""Decontamination against plain Python and its SQL."""

import os
import random
import re

import pytest

import oracle
from sluiceway.llm import decontamination as dc

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, bench, window):
    wins = {}
    for item, text in bench:
        w = words(text)
        n = min(len(w), window)
        for i in range(len(w) - n + 1 if n else 0):
            wins.setdefault(tuple(w[i:i + n]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, items = words(text), set(), set()
        for n in {len(g) for g in wins}:
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in wins:
                    hit |= set(range(i, i + n))
                    items |= wins[tuple(w[i:i + n])]
        out.append((doc, len(w), len(hit), sorted(str(i) for i in items if i is not None)))
    return sorted(out, key=repr)


def seen(df):
    return sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in df.collect()), key=repr)


def tables(spark, docs, bench):
    return (
        spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, items string, n_words int"),
        spark.createDataFrame([(*b, "x") for b in bench], "item_id long, text string, words string"),
    )


# few words, so that items share substrings and documents hold many of them
@pytest.mark.parametrize("seed,window,shard_words", [(1, 3, 10**6), (2, 4, 40), (3, 2, 1), (4, 10, 10**6)])
def test_random(spark, seed, window, shard_words):
    r = random.Random(seed)

    def text(n):
        return " ".join(r.choice("abcdeé") for _ in range(n))

    bench = [(i // 2, text(r.randrange(0, 25))) for i in range(40)] + [(None, text(12)), (3, None), (4, "!!"), (5, "a b")]
    docs = [(i, text(r.randrange(0, 80))) for i in range(40)]
    docs += [(90, None), (91, ""), (90, docs[0][1]), (None, bench[0][1]), (93, (bench[1][1] + " zz ") * 50)]
    a, b = tables(spark, docs, bench)
    assert seen(dc.matches(a, b, window, shard_words)) == brute(docs, bench, window)


def test_normalisation_and_short_items(spark):
    ten = "One two-three FOUR five; six 7 éight Nine ten"
    bench = [(1, ten), (2, "alpha Beta"), (3, "beta"), (12, "x alpha beta y"), (100, "six 7 éight")]
    docs = [
        (1, "zero " + ten.lower().replace(";", "\x00") + " eleven"), (2, "one two three four five six 7 éight nine"),
        (3, "ALPHA_beta"), (4, "x alpha, beta. Y"), (5, "Éight"), (6, "x" * 3_000_000 + " beta " + "beta\n" * 300_000),
    ]
    a, b = tables(spark, docs, bench)
    assert seen(dc.matches(a, b)) == brute(docs, bench, 10)


def test_pieces_of_long_items_lose_no_window(spark):
    r = random.Random(9)
    long = [r.choice("abcdefgh") for _ in range(500)]
    bench = [(1, " ".join(long))]
    docs = [(i, " ".join(long[i:i + 10])) for i in range(0, 491)] + [(1000, " ".join(long)), (1001, " ".join(long[::-1]))]
    folder = dc.automata(tables(spark, docs, bench)[1], 10, 50, 20)
    for doc, text in docs:
        n, spans, items = dc._scanned([text.encode()], folder, 10)[0]
        assert (doc, n, sum(b - a for a, b in spans), sorted(items)) in brute([(doc, text)], bench, 10)


def test_remove_spans(spark):
    bench = [(1, "a b c d e f g h i j"), (2, "k l")]
    docs = [
        (1, "Start. A b, c d e f g h i J! end of it all and some more words here"), (2, "a b c d e f g h i j"),
        (3, "k l and many other words follow"), (4, None), (5, ""), (6, "clean"),
    ]
    a, b = tables(spark, docs, bench)
    got = dc.remove_spans(a, b)
    assert got.columns == a.columns
    assert {r.doc_id: r.text for r in got.collect()} == {
        1: "Start. ! end of it all and some more words here", 3: docs[2][1], 4: None, 5: "", 6: "clean",
    }
    shorter = {r.doc_id: r.text for r in dc.remove_spans(a, b, max_words=1).collect()}
    assert shorter[3] == " and many other words follow"


def test_empty(spark):
    a, b = tables(spark, [(1, "a b")], [(1, "a b")])
    assert dc.matches(a.where("false"), b).count() == 0
    assert seen(dc.matches(a, b.where("false"))) == [(1, 2, 0, [])]


def test_sql(spark):
    for name, query in dc.QUERIES.items():
        assert oracle.differences(query(spark, SF), oracle.connect(SF), dc.ORACLES[name]) is None
