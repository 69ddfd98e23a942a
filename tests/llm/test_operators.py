"""The dealt operators against brute force, on small fixtures and on the given tables."""

import hashlib
import os
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import oracle
from sluiceway.llm import (
    components, exact_dedup, html_text, itq, packing, pieces, quality, registry, simhash, surrogates, tool_calls, warc,
)

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TEXTS = [
    "one two three four", None, "", " \t\n", "one  two\nthree four", "One two three four", "one", "x" * 70_000,
    "naïve café – Ünïcode 日本語 😀", "one two three four", "a\x00b", "the cat sat on the mat " * 2000,
]


@pytest.fixture(scope="module")
def docs(spark):
    """Odd texts, a repeated row, a null id, and columns whose names operators use themselves."""
    rows = [(i, t, "en", i % 2) for i, t in enumerate(TEXTS)] + [(0, TEXTS[0], "en", 0), (None, "one two three four", None, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, row int").withColumn("score", F.lit("x"))


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def text(t):
    return t or ""


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_sql(spark, name):
    assert oracle.differences(registry.QUERIES[name](spark, SF), oracle.connect(SF), registry.ORACLES[name]) is None


# exact deduplication

def test_fingerprints_compose():
    data = os.urandom(1000)
    for f, prime in enumerate(exact_dedup.PRIMES):
        falling = exact_dedup.powers(exact_dedup.PRIMES, 1024)[f]
        whole = exact_dedup.chunk_hash(data, prime, falling)
        left, right = (exact_dedup.chunk_hash(d, prime, falling) for d in (data[:311], data[311:]))
        assert exact_dedup.combine(left, right, 689, f) == whole


# a tiny field makes almost all fingerprints of one length collide
@pytest.mark.parametrize("chunk,primes", [(1 << 16, exact_dedup.PRIMES), (7, exact_dedup.PRIMES), (7, (2, 2, 2))])
def test_exact_dedup(docs, chunk, primes):
    rows = docs.collect()
    norm = [re.sub(r"[\x20\x09-\x0D]", "", text(r.text)) for r in rows]
    got = exact_dedup.exact_dedup(docs, chunk, primes).collect()
    assert len(got) == len(rows)
    want = {}
    for n in set(norm):
        own = [r for r, m in zip(rows, norm) if m == n]
        best = min(own, key=lambda r: (-len(text(r.text)), r.doc_id is None, r.doc_id or 0))
        want[hashlib.sha256(n.encode()).hexdigest()] = (best.doc_id, len(own))
    assert all((r.keep_id, r.group_size) == want[r.text_sha256] for r in got)
    assert sum(r.kept for r in got) == len(want)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_exact_stage(docs, none):
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len({re.sub(r"\s", "", text(t)) for t in TEXTS})
    assert exact_dedup.exact_dedup(none).count() == exact_dedup.drop_copies(none).count() == 0


# SimHash

def slow_fingerprint(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    grams = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    import xxhash
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_bit_slices():
    rng = np.random.default_rng(3)
    near = [int(b) ^ (1 << int(k)) for b in rng.integers(0, 2**63, 40) for k in rng.integers(0, 63, 5)]
    prints = np.unique(np.array(near, np.uint64))
    apart = np.bitwise_count(prints[:, None] ^ prints)
    for radius in (0, 1, 3, 7, 40):
        query, lane = simhash.within(prints, prints, radius)
        assert set(zip(query.tolist(), lane.tolist())) == set(map(tuple, np.argwhere(apart <= radius).tolist()))


def reach(n, pairs):
    root = list(range(n))
    for _ in range(n):
        new = list(root)
        for a, b in pairs:
            new[a] = new[b] = min(new[a], new[b])
        if new == root:
            return root
        root = new


@pytest.mark.parametrize("block", [2048, 3])
def test_simhash_links(spark, block):
    rng = np.random.default_rng(4)
    values = {0}
    for base in rng.integers(0, 2**62, 30):
        for _ in range(6):
            base = int(base) ^ (1 << int(rng.integers(0, 62))) ^ (1 << int(rng.integers(0, 62)))
            values.add(base)
    prints = np.array(sorted(values), np.uint64)
    frame = spark.createDataFrame([(int(v),) for v in prints], "print long")
    got = {r.node: r.component for r in components.components(simhash.links(frame, block=block)).collect()}
    apart = np.bitwise_count(prints[:, None] ^ prints)
    root = reach(len(prints), np.argwhere(apart <= 3).tolist())
    assert [got.get(int(v), int(v)) for v in prints] == [int(prints[r]) for r in root]


def test_simhash(docs, none):
    got = simhash.simhash_dedup(docs).collect()
    by_id = dict(enumerate(TEXTS))
    assert len(got) == docs.count()
    for r in got:
        want = slow_fingerprint(text(by_id.get(r.doc_id, "one two three four")))
        assert r.fingerprint == f"{want:016x}"
    assert {r.component_id for r in got if r.doc_id in (1, 2, 3)} == {1}
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns and simhash.drop_near_copies(none).count() == 0


def test_stages_keep_the_rows_they_decide(spark):
    """Rows that share an id, or have none, are kept or dropped one by one."""
    words = [f"{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"]
    alone = [" ".join(words[i:i + 12]) for i in range(0, 60, 12)]
    rows = [(None, t) for t in alone] + [(None, "a copy of three"), (3, "a copy of three"), (None, "a  copy of three")]
    rows += [(7, "one text of seven here"), (7, "the other text of it"), (8, "the other text of it"), (7, "THE OTHER TEXT OF IT")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    first = [(None, t) for t in alone] + [(7, "one text of seven here"), (7, "the other text of it")]
    key = lambda r: (str(r[0]), r[1])
    exact = sorted(map(tuple, exact_dedup.drop_copies(frame).collect()), key=key)
    assert exact == sorted([*first, (None, "a  copy of three"), (7, "THE OTHER TEXT OF IT")], key=key)
    near = sorted(map(tuple, simhash.drop_near_copies(frame).collect()), key=key)
    assert near in [sorted([*first[:-1], (3, "a copy of three"), (7, t)], key=key) for t in ("the other text of it", "THE OTHER TEXT OF IT")]


# packing

@pytest.mark.parametrize("length", [4096, 50])
def test_packing(docs, none, length):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(packing.word_tokenizer())
    rows = packing.pack(docs, packing.word_tokenizer(), length).collect()
    ids = {i: [*plain.encode(text(t), add_special_tokens=False).ids, 2] for i, t in enumerate(TEXTS)} | {
        None: [*plain.encode("one two three four").ids, 2]}
    places = {}
    for r in rows:
        cells = np.frombuffer(bytes(r.ids), "<u4").tolist()
        assert cells == ids[r.doc_id][r.start:r.start + r.length] and r.doc_tokens == len(ids[r.doc_id])
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    total = sum(len(ids[r.doc_id]) for r in docs.select("doc_id").collect())
    assert sum(r.length for r in rows) == total and len(places) == -(-total // length)
    for spans in places.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= length
    assert packing.pack(none, packing.word_tokenizer()).count() == 0


def test_hilbert_curve_visits_neighbours():
    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    order = np.argsort(packing.hilbert_key(grid, 3))
    assert sorted(packing.hilbert_key(grid, 3).tolist()) == list(range(512))
    assert (np.abs(np.diff(grid[order], axis=0)).sum(axis=1) == 1).all()


# WARC

def test_warc(spark, tmp_path):
    big = "ü" * 700
    rows = [(1, "http://a/ b", "x"), (2, None, None), (3, "u", big), (5, "u", big), (4, "u", big), (6, "v", "y" * 999),
            (7, "v", "y" * 999), (5, "u", big), (None, "n", big), (8, "w", "z" * 3_000_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("sha1", F.lit(1))
    root = f"file://{tmp_path}/bundles"
    index = warc.write_bundles(pages.repartition(1), root, frame_bytes=2000)
    got = warc.read_bundles(index, root).collect()
    assert len(got) == len(rows)
    html = {i: text(h).encode() for i, _, h in rows}
    for r in got:
        assert r.payload_bytes == len(html[r.page_id]) and r.payload_digest == hashlib.sha1(html[r.page_id]).hexdigest()
        assert (r.record_type, r.refers_to) == (("revisit", "5") if r.page_id in (3, 4, None) else ("response", None))
        assert bytes(r.payload) == (html[r.page_id] if r.record_type == "response" else b"")
    import zstandard
    names = list((tmp_path / "bundles").iterdir())
    plain = b"".join(zstandard.ZstdDecompressor().stream_reader(n.read_bytes(), read_across_frames=True).read() for n in names)
    assert plain.count(b"WARC/1.1\r\n") == len(rows)
    assert warc.read_bundles(warc.write_bundles(pages.where("false"), root + "2"), root + "2").count() == 0


# quality

def test_quality_is_learned(spark):
    sf = "/root/testdata/sf0.01"
    got = quality.op3_quality_network(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in got]) > 0.9


def test_quality_cases(docs, none):
    spark = docs.sparkSession
    labels = spark.createDataFrame([(0, 1), (7, 0), (8, 1), (None, 0), (3, None)], "doc_id long, quality int")
    scored = quality.with_score(docs, quality.fit(docs, labels), "q").collect()
    assert len(scored) == docs.count() and all(0 <= r.q <= 1 for r in scored)
    assert quality.fit(docs, labels.where("false")) == {"share": 0.5}
    assert quality.keep_good(spark, docs, labels.where("quality = 1")).columns == docs.columns
    assert quality.keep_good(spark, none, labels).count() == 0


def small_network(texts, seed=5):
    """Random weights in double precision, and the chunks of the texts."""
    labels = np.arange(len(texts)) % 2
    sizes = np.array([len(t) for t in texts])
    model = quality.train([quality.chunks_of(t) for t in texts], sizes, labels, steps=3, seed=seed)
    return {k: v.astype(np.float64) for k, v in model.items()}, sizes, labels


def slow_probability(text, model):
    """The network written out, position by position."""
    rows = []
    for start in range(0, max(1, len(text) - quality.CHUNK + quality.STEP), quality.STEP) if len(text) > quality.CHUNK else [0]:
        chunk = text[start:start + quality.CHUNK].ljust(quality.CHUNK, b"\0")
        rows.append([max(0.0, model["bias"][f] + max(
            sum(model["embedding"][chunk[p + w]] @ model["filters"][w * quality.CELLS:(w + 1) * quality.CELLS, f] for w in range(quality.WIDTH))
            for p in range(0, quality.CHUNK - quality.WIDTH + 1, quality.STRIDE)
        )) for f in range(quality.FILTERS)])
    row = np.concatenate([np.mean(rows, axis=0), np.max(rows, axis=0), [np.log1p(len(text)) / 10]])
    hidden = np.maximum(row @ model["w1"] + model["b1"], 0)
    return 1 / (1 + np.exp(-(hidden @ model["w2"] + model["b2"])))


def test_quality_by_brute_force():
    rng = np.random.default_rng(1)
    texts = [b"", b"short text", bytes(rng.integers(1, 255, 700).tolist())]
    model, _, _ = small_network(texts)
    assert np.allclose(quality.scores(texts, model), [slow_probability(t, model) for t in texts], atol=1e-5)


def test_quality_gradients(monkeypatch):
    """Gradients equal small differences of the loss, over texts of more chunks than a slice holds."""
    monkeypatch.setattr(quality, "SLICE", 3)
    rng = np.random.default_rng(2)
    texts = [bytes(rng.integers(1, 255, n).tolist()) for n in (40, 600, 3000, 5000)]
    model, sizes, labels = small_network(texts)
    chunks = [quality.chunks_of(t) for t in texts]

    def loss():
        p = quality.scores(texts, model)
        return -np.mean(np.where(labels == 1, np.log(p), np.log(1 - p)))

    grads = quality._gradients(model, chunks, sizes, labels, np.ones(len(texts)))
    for name in ("embedding", "filters", "bias", "w1", "b1", "w2"):
        steepest = np.argsort(-np.abs(grads[name]).ravel())[:4]
        for at in steepest:
            cell, eps = model[name].reshape(-1), 2e-3
            kept = cell[at]
            cell[at] = kept + eps
            up = loss()
            cell[at] = kept - eps
            down = loss()
            cell[at] = kept
            assert np.isclose((up - down) / (2 * eps), grads[name].ravel()[at], rtol=0.1, atol=2e-3), name


def test_quality_trains_on_whole_documents(spark, monkeypatch):
    """All chunks of a long text, one row of a repeated id, and no more bytes than the bound."""
    seen = []
    monkeypatch.setattr(quality, "train", lambda chunks, sizes, labels: seen.append((chunks, sizes, labels)) or {"share": 0.5})
    ids = [i for i in range(40) if quality_rest(i) != 1][:4]
    long = "long words " * 4000
    docs = spark.createDataFrame([(ids[0], long)] + [(ids[1], "b")] * 50 + [(ids[2], None), (ids[3], "x" * 90_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, quality int")
    quality.fit(docs, labels)
    chunks, sizes, _ = seen[0]
    assert sorted(sizes) == sorted([len(long), 1, 0, 90_000]) and max(map(len, chunks)) == len(quality.chunk_starts(90_000))
    quality.fit(docs, labels, max_bytes=50_000)
    assert sorted(seen[1][1]) == [0, 1, len(long)]


def quality_rest(i):
    import zlib

    return zlib.crc32(str(i).encode()) % 3


@pytest.mark.parametrize("size", [0, 1, 511, 512, 513, 960, 961, 5000])
def test_chunks_cover_all(size):
    data = bytes(1 + i % 250 for i in range(size))
    seen = np.zeros(size, bool)
    for at, chunk in zip(quality.chunk_starts(size), quality.chunks_of(data)):
        part = data[at:at + quality.CHUNK]
        assert chunk[:len(part)].tobytes() == part
        seen[at:at + quality.CHUNK] = True
    assert seen.all()


# vectors

@pytest.mark.parametrize("block", [1024, 64])
def test_vectors(spark, block):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((60, 32))
    made = [base[rng.integers(60)] + rng.uniform(0, .5) * np.linalg.norm(base[0]) * rng.standard_normal(32) / 6 for _ in range(400)]
    made += [base[0] + 0.02 * rng.standard_normal(32) for _ in range(200)] + [made[3]] * 5
    x = np.array(made, np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(9000, None), (9001, [0.0] * 32), (9002, [float("nan")] * 32), (9003, [None] + [1.0] * 31), (9004, []), (9005, [1.0])]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumn("node", F.lit(1))
    got = {r.vec_id: r for r in itq.near_vectors(frame, block=block).collect()}
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    links = np.array([got[i].n_links for i in range(len(x))])
    assert (links <= near.sum(axis=1)).all() and links.sum() >= 0.95 * near.sum()
    for i, _ in odd:
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    if links.sum() == near.sum():
        root = reach(len(x), np.argwhere(near).tolist())
        assert [got[i].component_id for i in range(len(x))] == root
    assert itq.near_vectors(frame.where("false")).count() == 0


@pytest.mark.parametrize("norm", [0.0, 0.7, 0.8, 0.95])
def test_vectors_with_a_common_mean(norm):
    """Pairs just above the threshold, among vectors that share a large mean: as many found as are required."""
    rng = np.random.default_rng(6)
    n, d = 20_000, 64
    mean = np.zeros(d)
    mean[0] = norm
    x = rng.standard_normal((n, d))
    x[:, 0] = 0
    x = mean + x * np.sqrt(1 - norm**2) / np.linalg.norm(x, axis=1, keepdims=True)
    # partners at cosine 0.905 that have the same mean, where that is possible
    inner = (0.905 - norm**2) / (1 - norm**2)
    r, other = x[:2000] - mean, rng.standard_normal((2000, d))
    other[:, 0] = 0
    other -= (other * r).sum(axis=1, keepdims=True) * r / (r * r).sum(axis=1, keepdims=True)
    other *= np.sqrt(1 - norm**2) / np.linalg.norm(other, axis=1, keepdims=True)
    y = mean + inner * r + np.sqrt(1 - inner**2) * other
    assert np.allclose((x[:2000] * y).sum(axis=1), 0.905)
    every = np.vstack([x, y])
    model = itq.fit(every[rng.permutation(len(every))[:2048]], 1_000_000)
    same = itq.substrings(x[:2000], model) == itq.substrings(y, model)
    assert same.any(axis=1).mean() >= 0.95


def test_vectors_by_brute_force_with_a_common_mean(spark):
    rng = np.random.default_rng(7)
    mean, n = np.eye(32)[0] * 0.8, 3000
    r = rng.standard_normal((n, 32)) * np.r_[0, np.ones(31)]
    r *= 0.6 / np.linalg.norm(r, axis=1, keepdims=True)
    r[1::2] = r[::2] + 0.72 * rng.uniform(0.2, 1.0, (n // 2, 1)) * np.roll(r[::2], 1, axis=0)
    r *= 0.6 / np.linalg.norm(r, axis=1, keepdims=True)
    x = (mean + r).astype(np.float32)
    got = {v.vec_id: v.n_links for v in itq.near_vectors(
        spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<float>")).collect()}
    unit = itq.unit(x)
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    assert sum(got.values()) >= 0.95 * near.sum() > 0


# pages

PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header>
<nav><a href=x>Home</a></nav><div class="cookie-notice">We use the cookies of this site and you agree to all of it.</div>
<article><h1>Head &amp; line</h1><p>The first of the paragraphs is in the article, and it is
 long.<p>Short.<br>Line<ul><li>point</li></ul><div class="ad">Buy the thing that is the best of all the things now.</div>
<script>var a = "<p>x</p>";</script><form><p>The mail of you is what we ask for in this form.</p></form>
<section id="comments"><p>The comment of a reader is not in the text of the article at all.</p></section></article>
<aside>The side of the page</aside><footer>&copy; 2024</footer>"""


def test_pages(spark):
    want = "Head & line\nThe first of the paragraphs is in the article, and it is long.\nShort. Line\npoint"
    assert html_text.main_text(PAGE) == want
    plain = "<body><div><a href=1>One</a> <a href=2>Two</a></div><p>This is the text of a page that is without an article.</p><p>So it is.</p>"
    assert html_text.main_text(plain) == "This is the text of a page that is without an article.\nSo it is."
    frame = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (2, "", ""), (3, "x", "<<p <a b='")], "page_id long, url string, html string")
    got = html_text.extract(frame.withColumn("text", F.lit(1))).collect()
    assert [(r.page_id, r.n_chars) for r in sorted(got, key=lambda r: (r.page_id, r.n_chars))][:3] == [(1, len(want)), (2, 0), (2, 0)]


def test_pages_that_leave_tags_open():
    first, last = "This is the text of a page that is in the head of no one.", "And so it is for the rest of the text of this page."
    for start in ("<html><head><title>T</title><body>", "<head><meta charset=x><title>T</title>", "<head><script>x</script>"):
        assert html_text.main_text(f"{start}<article><p>{first}<p>{last}") == f"{first}\n{last}"
    for link in ("<p><a href=x>Home</p>", "<div><a href=x>Home</div>", "<a href=x>Home", "<a name=top>"):
        got = html_text.main_text(f"<body>{link}<div><p>{first}</p><p>{last}</p></div>")
        assert got.endswith(f"{first}\n{last}"), link
    assert html_text.main_text(f"<body><a href=x><div><p>{first}</p><p>{last}</p></div></a>") == ""


def test_pages_in_wrappers():
    one, two = "This is the text of a page that is in a wrapper of the site.", "And so it is for the rest of the text of this page."
    for name in ("layout has-sidebar", "content-sidebar-wrap", "sidebar", "page-header-fixed"):
        assert html_text.main_text(f"<body><div class='{name}'><article><p>{one}<p>{two}</article></div>") == f"{one}\n{two}", name
    assert html_text.main_text(f"<form id=form1><main><p>{one}<p>{two}</main></form>") == f"{one}\n{two}"
    assert html_text.main_text(f"<div class=banner><p>{one}<p>{two}</div>") == f"{one}\n{two}"
    assert html_text.main_text(f"<article><div class=entry-header><h1>Title</h1></div><p>{one}<div class='related-links'><p>{two}</div>") == f"Title\n{one}"
    assert html_text.main_text(f"<main><p>{one}</main><section id=comments><article><p>{two}</article></section>") == one


@pytest.mark.parametrize("words", [
    "Tämä on pitkä kappale, jossa kerrotaan kaupungin historiasta ja sen asukkaista hyvin laajasti",
    "これは日本語で書かれた長い段落であり、町の歴史とその住民について詳しく説明しています。",
    "Эта длинная страница рассказывает об истории города и его жителях очень подробно и интересно",
])
def test_pages_in_other_languages(words):
    menu = "<ul><li><a href=1>One long link of a menu</a><li><a href=2>Two</a></ul>"
    assert html_text.main_text(f"<body>{menu}<div><p>{words}</p><p>{words}</p></div>") == f"{words}\n{words}"


def test_open_blocks_take_after_neighbours():
    assert html_text.second_pass(["good", "open", "bad", "open", "open", "good"], False) == [True, False, False, False, True, True]
    assert html_text.second_pass(["open", "open"], True) == [True, True]


# tool calls

def test_tool_calls(spark):
    calls = spark.createDataFrame([
        (1, "a", 0, "t", '{"y":2,"x":1}', None), (1, "b", 1, "t", '{"x":"1"}', "a"), (1, "c", 2, "u", "{}", "b"),
        (1, "d", 3, "t", "{", "missing"), (1, "e", 4, "t", '{"x":1}', "f"), (1, "f", 5, "t", '{"x":1}', "e"),
        (1, "a", 9, "t", '{"x":5}', None), (2, "a", 0, "t", '{"x":1,"x":2}', None), (2, None, 0, "t", '{"x":3}', None),
        (2, "g", 0, "t", None, None), (2, "h", 0, "t", '{"x":1e999}', None),
    ], "conv_id long, call_id string, position long, name string, arguments string, after string")
    results = spark.createDataFrame(
        [(1, "a", 1, "ok"), (1, "a", 2, "late"), (1, "z", 3, "who"), (2, "a", 1, None), (None, "a", 1, "m"), (None, "a", 2, "m"),
         (1, None, 1, "n"), (1, None, 1, "n"), (1, None, 2, None)],
        "conv_id long, call_id string, position long, content string",
    )
    schema = {"type": "object", "required": ["x"], "properties": {"x": {"type": "integer"}}}
    rows = tool_calls.link_calls(calls, results, {"t": schema}).collect()
    got = {(r.conv_id, r.call_id, r.status): r for r in rows}
    # eleven calls; of nine results two are taken
    assert len(rows) == 18 and sum(r.status == "orphan" and r.call_id == "a" for r in rows) == 2
    assert sorted(r.message for r in rows if r.conv_id == 1 and r.call_id is None) == [
        '{"id":null,"result":"n"}', '{"id":null,"result":"n"}', '{"id":null,"result":null}']
    assert got[1, "a", "duplicate"].message == '{"arguments":{"x":5},"id":"a","name":"t","result":null}'
    assert got[1, "a", "repeated"].message == '{"id":"a","result":"late"}' and got[1, "z", "orphan"].message == '{"id":"z","result":"who"}'
    assert set(got) == {(1, "a", "repeated"), (1, None, "orphan"), (None, "a", "orphan"),
        (1, "a", "ok"), (1, "b", "invalid"), (1, "c", "unknown"), (1, "d", "malformed"), (1, "e", "cyclic"),
        (1, "f", "cyclic"), (1, "a", "duplicate"), (1, "z", "orphan"), (2, "a", "malformed"), (2, None, "ok"),
        (2, "g", "malformed"), (2, "h", "malformed"),
    }
    assert got[1, "a", "ok"].message == '{"arguments":{"x":1,"y":2},"id":"a","name":"t","result":"ok"}'
    assert [got[1, c, s].level for c, s in (("a", "ok"), ("b", "invalid"), ("c", "unknown"), ("d", "malformed"))] == [0, 1, 2, 0]
    assert got[1, "b", "invalid"].problems == "$.x: not integer"
    assert tool_calls.link_calls(calls.where("false"), results.where("false"), {}).count() == 0


# pieces

def test_pieces(spark, docs, none):
    import sentencepiece

    raw = open(pieces.piece_model(), "rb").read()
    at = raw.index(b"\x18\x02 \x80\xfa\x01")  # the trainer's model type: 2 merges pairs, 1 takes the best path
    best = sentencepiece.SentencePieceProcessor(model_proto=raw[:at] + b"\x18\x01" + raw[at + 2:])
    vocabulary = pieces.Vocabulary(pieces.piece_model())
    for head in (100, 0):
        got = pieces.decode(pieces.encode(docs, vocabulary, head_atoms=head), vocabulary).collect()
        assert sorted(r.decoded for r in got) == sorted(text(r.text) for r in docs.collect())
    assert pieces.encode(none, vocabulary).count() == 0
    words = sorted({w for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect() for w in text(r.text).split()})
    frame = spark.createDataFrame(list(enumerate(words)), "doc_id long, text string")
    score = {i: s for _, i, s in vocabulary.pieces}
    for r in pieces.encode(frame, vocabulary).collect():
        ours, several = np.frombuffer(bytes(r.ids), "<u4").tolist(), best.nbest_encode(words[r.doc_id], nbest_size=8)
        assert len(words[r.doc_id]) > 40 or ours == [
            i for a in pieces.atoms_of("▁" + words[r.doc_id], vocabulary.pairs) for i in pieces.best_path(a, vocabulary)]
        worth = lambda ids: sum(score.get(i, -1e9) for i in ids)
        assert worth(ours) == pytest.approx(max(map(worth, several))), words[r.doc_id]


def test_pieces_in_slices(docs, monkeypatch):
    """Texts cut at once are cut like their words; the join with rare atoms ships codes, not texts."""
    vocabulary = pieces.Vocabulary(pieces.piece_model())
    odd = [*TEXTS[:7], "", " a  b ", "▁x▁▁ y▁", "qx\n\tzq ", "日本語 qx日本語 😀"]
    want = [[a for w in pieces.words_of(text(t)) for a in pieces.atoms_of(w, vocabulary.pairs)] for t in odd]
    for cut in (pieces.Cutter(vocabulary.pairs), pieces.Cutter(vocabulary.pairs, 3)):
        if cut.most == 3:  # a vocabulary of too many letters for a table of pairs
            cut.table = None
        places, distinct, bounds = cut(pa.array(odd, pa.string()))
        found = [distinct[int(p)].as_py() for p in places]
        assert [found[a:b] for a, b in zip(bounds, bounds[1:])] == want
    ids = lambda atom: [len(atom), 7]
    known = sorted({a for w in want for a in w})[::3]
    head = pieces.Head(pa.array(known, pa.string()), pa.array([ids(a) for a in known], pa.list_(pa.int32())), 1000, vocabulary.pairs)
    texts, rare = pa.array(odd, pa.string()), []
    codes, bounds = head.codes(texts)
    owner, atoms = head.others(texts)
    for i, atoms_ in enumerate(want):
        own = [a for a, o in zip(atoms.to_pylist(), owner) if o == i]
        assert own == list(dict.fromkeys(a for a in atoms_ if a not in known))
        rare.append([{"place": p, "ids": ids(a)} for p, a in enumerate(own)][::-1] or None)
    got, bounds = pieces.filled(codes, bounds, 1000, pa.array(rare, pa.list_(pa.struct({"place": pa.int32(), "ids": pa.list_(pa.int32())}))))
    assert [got[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [[x for a in atoms_ for x in ids(a)] for atoms_ in want]
    monkeypatch.setattr(pieces, "RARE_BYTES", -1)
    encoded = pieces.encode(docs.where("length(text) < 100"), vocabulary, head_atoms=3)
    above = encoded._jdf.queryExecution().executedPlan().toString().split("Join ")[0]
    assert "codes#" in above and "text#" not in above
    got = pieces.decode(encoded, vocabulary).collect()
    assert sorted(r.decoded for r in got) == sorted(r.text for r in docs.where("length(text) < 100").collect())


# surrogates

def test_surrogates(docs, none):
    spark = docs.sparkSession
    rows = [
        "Mr John Smith, Mrs. Ann Smith; Mr Smith!", "call +1 (942) 555-3625 or +1-942-555-3625", "4111 1111 1111 1111 4111111111111111",
        "A.b@Mail7.example.com a.B@mail7.example.com", "at 253.10.218.129.", 'token = "9233A8ECF7C5B09FE5949719B6B82BC439E9329B"', None, "",
        "clean text with version 2.0 and 3", "госпожа Анна Петрова", "x" * 100_000 + " 123-45-6789", "A.b@Mail7.example.com a.B@mail7.example.com",
    ]
    frame = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").withColumn("_cells", F.lit(1))
    got = {r.doc_id: r for r in surrogates.with_surrogates(frame, count="n").collect()}
    assert [got[i].n for i in range(12)] == [3, 2, 2, 2, 1, 1, 0, 0, 0, 1, 1, 2]
    assert all(got[i].text == rows[i] for i in (6, 7, 8)) and got[3].text == got[11].text
    names = re.findall(r"Mrs?\.? (?:\w+ )?(\w+)[,;!]", got[0].text)
    assert len(set(names)) == 1 and "Smith" not in got[0].text
    phones = re.fullmatch(r"call \+1 \((\d{3})\) (\d{3})-(\d{4}) or \+1-\1-\2-\3", got[1].text)
    assert phones and phones[1] + phones[2] + phones[3] != "9425553625"
    card = got[2].text[20:]
    assert got[2].text[:19].replace(" ", "") == card != "4111111111111111" and got[2].text[4] == " "
    assert sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(card))) % 10 == 0
    assert len(set(got[3].text.split())) == 1 and "mail7" not in got[3].text.lower()
    assert re.fullmatch(r'token = "[0-9A-F]{40}"', got[5].text) and got[5].text != rows[5]
    assert re.fullmatch(r"госпожа [А-Я][а-я]+ [А-Я][а-я]+", got[9].text)
    assert surrogates.with_surrogates(none).count() == 0
    assert surrogates.with_surrogates(docs).columns == docs.columns


def rewritten(spark, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.text for r in surrogates.with_surrogates(frame).orderBy("doc_id").collect()]


def test_whole_names(spark):
    texts = [
        "Mr. O'Neil met Ms McDonald and Dr Jean-Paul Roux there", "Mr JOHN SMITH and Mr John Smith's dog, Mr J. Smith too",
        "Sir D’Angelo, Sir D'Angelo; Prof MacLeod.",
    ]
    got = rewritten(spark, texts)
    name = r"([A-Z][a-z]+)"
    first = re.fullmatch(rf"Mr\. {name} met Ms {name} and Dr {name}-{name} {name} there", got[0])
    assert first and not {"Neil", "Donald", "Jean", "Paul", "Roux"} & set(re.findall(r"[A-Z][a-z]+", got[0]))
    second = re.fullmatch(rf"Mr ([A-Z]+) ([A-Z]+) and Mr {name} {name}'s dog, Mr J\. {name} too", got[1])
    assert second and second[1].capitalize() == second[3] and second[2].capitalize() == second[4] == second[5] != "Smith"
    third = re.fullmatch(rf"Sir {name}, Sir {name}; Prof {name}\.", got[2])
    assert third and third[1] == third[2] and third[3] != "Macleod"


def test_figures_stay(spark):
    texts = [
        "a total of 10.000.000 and 1.234.567.890", "12 345 6789 units", "ISBN 978-3-16-148410-0", "ISBN 978-12-345-6789-0",
        "100 200 300", "version 1.2.3, 3.1415 and 1990-2000",
    ]
    assert rewritten(spark, texts) == texts
    numbers = ["020 7946 0958", "212-555-0123", "212 555 0123", "(020) 7946 0958", "+44 20 7946 0958", "12-345-6789", "030.1234.5678"]
    for before, after in zip(numbers, rewritten(spark, numbers)):
        assert before != after and re.sub(r"\d", "9", before) == re.sub(r"\d", "9", after)


def test_surrogates_by_brute_force(spark):
    """Texts put together from known entities and clean words: the words stay, each entity has one surrogate, in the
    format of the mention, and no two share one."""
    rng = np.random.default_rng(3)
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    people = {
        "mail": [f"u{digits(5)}@host{digits(2)}.org" for _ in range(20)],
        "national": [f"{digits(3)}-{digits(2)}-{digits(4)}" for _ in range(20)],
        "phone": [f"+49 {1 + i} {digits(8)}".replace(f" {1 + i} ", f" {30 + i} ") for i in range(20)],
        "secret": [hashlib.sha256(digits(9).encode()).hexdigest() for _ in range(20)],
    }
    clean = "the report of 2024 lists 3 pages, 10.000.000 words and version 2.1 of it".split()
    shapes = [[(str(k), v) if rng.random() < 0.3 else (None, str(rng.choice(clean))) for k in rng.choice(list(people), 30)
               for v in [str(rng.choice(people[k]))]] for _ in range(60)]
    made: dict[tuple[str, str], str] = {}
    for shape, got in zip(shapes, rewritten(spark, [" ; ".join(v for _, v in s) for s in shapes])):
        cells = got.split(" ; ")
        assert len(cells) == len(shape)
        for (kind, before), after in zip(shape, cells):
            if kind is None:
                assert before == after
            else:
                assert before != after == made.setdefault((kind, before), after)
                if kind != "mail":
                    assert re.sub(r"\d", "9", before if kind != "secret" else "") == re.sub(r"\d", "9", after if kind != "secret" else "")
    for kind, entities in people.items():
        own = [n for (k, _), n in made.items() if k == kind]
        assert len(set(own)) == len(own) and not set(own) & set(entities)


def test_crowded_formats_change_places(spark, monkeypatch):
    """More entities than free forms: still one to one, and none keeps its own."""
    monkeypatch.setattr(surrogates, "CROWDED", 3)
    monkeypatch.setattr(surrogates, "CIRCLE", 100)
    rows = spark.range(800).selectExpr("'national_id' AS kind", "lpad(cast(id AS string), 3, '0') AS canon").unionByName(
        spark.createDataFrame([("family", "smith"), ("title", "mr")], "kind string, canon string")
    )
    made = surrogates.surrogate_table(rows).collect()
    ids = [r for r in made if r.kind == "national_id"]
    assert len(made) == 802 and len({r.surrogate for r in ids}) == 800
    assert all(r.surrogate != r.canon and re.fullmatch(r"\d{3}", r.surrogate) for r in ids)


def test_surrogates_stay_distinct(spark):
    """Short numbers: many collide at first, none in the end."""
    rows = spark.range(300).selectExpr("'national_id' AS kind", "lpad(cast(id AS string), 3, '0') AS canon")
    made = surrogates.surrogate_table(rows).collect()
    assert len({r.surrogate for r in made}) == 300 and not {r.surrogate for r in made} & {r.canon for r in made}


def test_written_numbers_stay_distinct(spark):
    """Country codes stay, so what is written, not only what was drawn, must be distinct and not real."""
    raws = [f"+49 {i * 331 % 1_000_000:06d}"[:6] + f" {i * 331 % 10_000:04d}" for i in range(3000)]
    raws = sorted(set(raws)) + ["+49-00-0000", "+49000000"]
    made = {r.raw: r.replacement for r in surrogates.replacements(spark.createDataFrame([(r,) for r in raws], "raw string")).collect()}
    plain = lambda t: re.sub(r"\D", "", t)
    assert all(n.startswith("+49") for n in made.values())
    entities = {plain(r): plain(n) for r, n in made.items()}
    assert all(plain(made[r]) == entities[plain(r)] for r in raws)
    assert len(set(entities.values())) == len(entities) and not set(entities.values()) & set(entities)


def test_addresses_come_from_the_whole_space(spark):
    raws = [f"172.16.{i}.1" for i in range(64)] + ["172.16.0.01"]
    made = {r.raw: r.replacement for r in surrogates.replacements(spark.createDataFrame([(r,) for r in raws], "raw string")).collect()}
    assert made["172.16.0.01"] == made["172.16.0.1"] and len(set(made.values())) == 64
    assert len({n.split(".")[0] for n in made.values()}) > 30 and all(all(0 <= int(b) < 256 for b in n.split(".")) for n in made.values())


# pipeline

def test_pipeline(spark, docs):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, SF).collect()
    start = spark.read.parquet(f"{SF}/documents.parquet")
    state = start
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, state = state.count(), stage(spark, state, SF)
        assert state.columns == start.columns
        assert (state.count() == before) if name == "private" else (0 < state.count() <= before)
    assert {r.doc_id for r in out} == {r.doc_id for r in state.select("doc_id").collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact", "near", "private", "packing"]
