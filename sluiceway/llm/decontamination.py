"""Operator 12: benchmark decontamination by a generalised suffix automaton.

The normalised words of all test items form one automaton of their substrings (several, of at most
about ``SHARD_WORDS`` words each, where the benchmark is large; an item longer than ``PIECE_WORDS`` is
cut into pieces that overlap by a window less a word, so that no window is lost). Documents stream
through it word by word: at each word the automaton knows the longest run of words ending there that
occurs in an item. Where it reaches a window, the last words of the window are a hit, and the state
names the items that hold it. Items shorter than a window count whole.

Automata are built by Spark, one task each, and written to the shared folder; the tasks that stream
documents read them there, one after the other for each Arrow batch. No rows are shuffled but
the words of the benchmark.

A word is a run of [0-9A-Za-z] and characters beyond ASCII, A-Z lower-cased. Texts of any length
stream in slices of ``SLICE`` bytes.

Cases: null and empty texts have no words; items without words match nothing; an item without id
hits words but is not listed; items that share an id are one item; rows that repeat are handled one
by one; ties cannot occur (hits are a set of words); an empty benchmark hits nothing, an empty table
gives an empty result; other columns are ignored, by ``remove_spans`` kept.
"""

from __future__ import annotations

import re
from collections import OrderedDict, defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluiceway.llm.common import blobs, fresh, table, utf8
from sluiceway.session import scratch

WINDOW = 10
SHARD_WORDS = 200_000
PIECE_WORDS = 10_000
SLICE = 1 << 20
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if WORD.match(bytes([b])) else 32 for b in range(256))


def words_of(data: bytes) -> Iterator[list[bytes]]:
    """The normalised words of a text, a slice at a time."""
    data = data.translate(FOLD)
    at = 0
    while at < len(data):
        end = at + SLICE
        if end < len(data):
            end = data.rfind(b" ", at, end) + 1 or data.find(b" ", end) + 1 or len(data)
        yield data[at:end].split()
        at = end


class Builder:
    """A suffix automaton over several items."""

    def __init__(self, window: int = WINDOW):
        self.window, self.words = window, {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.items: list[tuple[str | None, list[int]]] = []

    def _state(self, length: int, edges: dict[int, int], link: int) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(link)
        return len(self.link) - 1

    def _split(self, before: int, word: int, state: int) -> int:
        """The state for the strings of ``state`` that are no longer than a step from ``before``."""
        if self.length[state] == self.length[before] + 1:
            return state
        copy = self._state(self.length[before] + 1, dict(self.next[state]), self.link[state])
        self.link[state] = copy
        while before >= 0 and self.next[before].get(word) == state:
            self.next[before][word] = copy
            before = self.link[before]
        return copy

    def _step(self, last: int, word: int) -> int:
        if word in self.next[last]:
            return self._split(last, word, self.next[last][word])
        new, before = self._state(self.length[last] + 1, {}, 0), last
        while before >= 0 and word not in self.next[before]:
            self.next[before][word] = new
            before = self.link[before]
        if before >= 0:
            self.link[new] = self._split(before, word, self.next[before][word])
        return new

    def add(self, item: str | None, words: list[bytes]) -> None:
        ids = [self.words.setdefault(w, len(self.words)) for w in words]
        self.items.append((item, ids))
        state = 0
        for word in ids:
            state = self._step(state, word)

    def finish(self) -> dict:
        """Columns of the automaton's row: words, edges, links, lengths, and per state the window it
        stands in, the longest short item that ends there, and the items of a window or short item."""
        owners: dict[int, set[str]] = defaultdict(set)
        window, short = [-1] * len(self.link), [-1] * len(self.link)
        for item, ids in self.items:
            if 0 < len(ids) < self.window:
                state = 0
                for word in ids:
                    state = self.next[state][word]
                short[state] = state
                owners[state] |= {item} - {None}
        for state in np.argsort(self.length, kind="stable").tolist()[1:]:
            link = self.link[state]
            if self.length[state] >= self.window:
                window[state] = window[link] if self.length[link] >= self.window else state
            if short[state] < 0:
                short[state] = short[link]
        for item, ids in self.items:
            state = 0
            for at, word in enumerate(ids):
                state = self.next[state][word]
                if at + 1 >= self.window and item is not None:
                    owners[window[state]].add(item)
        edges = [(s, w, t) for s, out in enumerate(self.next) for w, t in out.items()]
        owned = sorted(owners)
        return {
            "words": list(self.words), "edge_from": [e[0] for e in edges], "edge_word": [e[1] for e in edges],
            "edge_to": [e[2] for e in edges], "link": self.link, "length": self.length, "window": window, "short": short,
            "owned": owned, "owners": [sorted(owners[s]) for s in owned],
        }


ROW = pa.schema([
    ("words", pa.list_(pa.binary())), *[(c, pa.list_(pa.int64())) for c in
    ("edge_from", "edge_word", "edge_to", "link", "length", "window", "short", "owned")],
    ("owners", pa.list_(pa.list_(pa.string()))),
])
ROW_TYPE = ", ".join(
    f"{f.name} array<{'binary' if f.name == 'words' else 'array<string>' if f.name == 'owners' else 'bigint'}>" for f in ROW
)


class Automaton:
    """An automaton ready to stream documents through."""

    def __init__(self, row: dict, window: int = WINDOW):
        self.size = max(len(row["words"]), 1)
        self.words = {w: i for i, w in enumerate(row["words"])}
        keys = np.array(row["edge_from"], np.int64) * self.size + np.array(row["edge_word"], np.int64)
        self.edges = dict(zip(keys.tolist(), row["edge_to"]))
        self.link, self.length, self.at_window, self.short = row["link"], row["length"], row["window"], row["short"]
        self.owners = dict(zip(row["owned"], row["owners"]))
        self.window = window

    def scan(self, data: bytes) -> tuple[int, list[list[int]], set[str]]:
        """Words of a text, the runs [from, to) of hit words, and the items they are of."""
        known, step, size, link, length = self.words.get, self.edges.get, self.size, self.link, self.length
        at_window, short, window = self.at_window, self.short, self.window
        state = run = at = 0
        spans: list[list[int]] = []
        states: set[int] = set()
        for words in words_of(data):
            for word in map(known, words, repeat(-1)):
                at += 1
                if word < 0:
                    state = run = 0
                    continue
                to = step(state * size + word)
                while to is None:  # ends at the root, which knows every word
                    state = link[state]
                    run = length[state]
                    to = step(state * size + word)
                state = to
                run += 1
                start = at
                if run >= window:
                    states.add(at_window[state])
                    start = at - window
                end = short[state]
                if end == state and run < length[state]:
                    end = short[link[state]]
                while end > 0:
                    states.add(end)
                    start = min(start, at - length[end])
                    end = short[link[end]]
                if start < at:
                    while spans and spans[-1][1] >= start:
                        start = min(start, spans.pop()[0])
                    spans.append([start, at])
        return at, spans, {item for s in states for item in self.owners.get(s, ())}


def automata(bench: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS, piece_words: int = PIECE_WORDS) -> str:
    """Build the automata of a benchmark; the folder with one row for each."""
    spark = bench.sparkSession

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item, data in zip(batch["item"].to_pylist(), blobs(batch["data"])):
                words = [w for part in words_of(data) for w in part]
                step = max(piece_words - window + 1, 1)
                last = max(len(words) - window + 1, 1) if len(words) > piece_words else 1
                size = piece_words if len(words) > piece_words else len(words)
                rows += [(item, at, words[at:at + max(size, window)]) for at in range(0, last, step) if words]
            items, at, found = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(items, pa.string()), pa.array(at, pa.int64()), pa.array(found, pa.list_(pa.binary()))],
                ["item", "at", "words"],
            )

    pieces = bench.select(F.col("item_id").cast("string").alias("item"), utf8("text").alias("data")).mapInArrow(
        cut, "item string, at bigint, words array<binary>"
    )
    total = pieces.agg(F.sum(F.size("words"))).first()[0] or 0
    shards = max(-(-total // shard_words), 1)

    def build(rows: pa.Table) -> pa.Table:
        builder = Builder(window)
        for item, words in zip(rows["item"].to_pylist(), rows["words"].to_pylist()):
            builder.add(item, words)
        return pa.Table.from_pylist([builder.finish()], ROW)

    path = scratch(spark, "automata")
    shard = F.pmod(F.xxhash64("item", "at", "words"), F.lit(shards)).alias("shard")
    pieces.withColumn("shard", shard).groupBy("shard").applyInArrow(build, ROW_TYPE).write.parquet(path)
    return path


#: automata a worker keeps; others are read again for each batch
KEPT = 2
_kept: OrderedDict[tuple, list[Automaton]] = OrderedDict()


def load(folder: str, window: int) -> Iterator[Automaton]:
    """The automata of a folder, one after the other."""
    fs, root = pafs.FileSystem.from_uri(folder)
    files = sorted(i.path for i in fs.get_file_info(pafs.FileSelector(root)) if i.path.endswith(".parquet"))
    for path in files:
        with fs.open_input_file(path) as file:
            rows = pq.ParquetFile(file)
            for group in range(rows.num_row_groups):
                key = (folder, path, group, window)
                if key not in _kept:
                    built = [Automaton(r, window) for r in rows.read_row_group(group).to_pylist()]
                    _kept[key] = built
                    while len(_kept) > KEPT:
                        _kept.popitem(last=False)
                else:
                    _kept.move_to_end(key)
                    built = _kept[key]
                yield from built


def united(spans: list[list[int]]) -> list[list[int]]:
    """Runs without overlap, in order."""
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


def _scanned(datas: list[bytes], folder: str, window: int) -> list[tuple[int, list[list[int]], set[str]]]:
    out = [(0, [], set())] * len(datas)
    first = True
    for automaton in load(folder, window):
        for i, data in enumerate(datas):
            n, spans, items = automaton.scan(data)
            out[i] = (n, spans, items) if first else (n, united(out[i][1] + spans), out[i][2] | items)
        first = False
    if first:  # no item has words
        out = [(sum(map(len, words_of(d))), [], set()) for d in datas]
    return out


def matches(docs: DataFrame, bench: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, spans (runs of hit words), items (ids as strings, sorted)."""
    folder = automata(bench, window, shard_words)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
        for batch in batches:
            found = _scanned(blobs(batch["data"]), folder, window)
            yield pa.RecordBatch.from_arrays([
                batch["doc_id"], pa.array([n for n, _, _ in found], pa.int64()),
                pa.array([sum(b - a for a, b in spans) for _, spans, _ in found], pa.int64()),
                pa.array([[{"start": a, "end": b} for a, b in spans] for _, spans, _ in found], pa.list_(span)),
                pa.array([sorted(items) for _, _, items in found], pa.list_(pa.string())),
            ], ["doc_id", "n_words", "n_hit", "spans", "items"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", utf8("text").alias("data")).mapInArrow(
        stream, f"doc_id {kind}, n_words bigint, n_hit bigint, spans array<struct<start bigint, end bigint>>, items array<string>"
    )


def without(data: bytes, spans: list[list[int]]) -> bytes:
    """A text without the runs of words ``spans``, from the first byte of a run to its last."""
    out, done, cuts = [], 0, iter(spans)
    span = next(cuts, None)
    for at, word in enumerate(WORD.finditer(data)):
        if span is None:
            break
        if at == span[0]:
            out.append(data[done:word.start()])
        if at == span[1] - 1:
            done, span = word.end(), next(cuts, None)
    return b"".join([*out, data[done:]])


def remove_spans(
    docs: DataFrame, bench: DataFrame, max_words: int = WINDOW - 1, max_coverage: float = 0.5, window: int = WINDOW
) -> DataFrame:
    """``docs`` without runs of more than ``max_words`` hit words, and without the documents of whose
    words more than the share ``max_coverage`` is hit."""
    folder = automata(bench, window)
    data, cut = fresh(docs, "_data"), fresh(docs, "_cut")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keep = [], []
            raw = blobs(batch[data])
            for text, (n, spans, _) in zip(raw, _scanned(raw, folder, window)):
                keep.append(sum(b - a for a, b in spans) <= max_coverage * n)
                long = [s for s in spans if s[1] - s[0] > max_words]
                texts.append(without(text, long).decode("utf-8") if long else None)
            out = batch.drop_columns([data]).append_column(cut, pa.array(texts, pa.string()))
            yield out.filter(pa.array(keep, pa.bool_()))

    rest = docs.withColumn(cut, F.lit(None).cast("string"))
    found = docs.withColumn(data, utf8("text")).mapInArrow(stream, rest.schema)
    return found.withColumn("text", F.coalesce(cut, "text")).select(*docs.columns)


def op12_suffix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


QUERIES = {"op12_suffix_decontamination": op12_suffix_decontamination}
_WORDS = (
    r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)
ORACLES = {
    "op12_suffix_decontamination": f"""
WITH docs AS (
  SELECT row_number() OVER () AS row, doc_id, {_WORDS} AS words FROM documents
), items AS (
  SELECT item_id, {_WORDS} AS words FROM benchmark
), starts AS (
  SELECT item_id, words, least(len(words), {WINDOW}) AS n,
         unnest(range(1, len(words) - least(len(words), {WINDOW}) + 2)) AS place
  FROM items WHERE len(words) > 0
), windows AS (
  SELECT DISTINCT item_id, n, array_to_string(list_slice(words, place, place + n - 1), ' ') AS gram FROM starts
), places AS (
  SELECT row, words, n, unnest(range(1, len(words) - n + 2)) AS place
  FROM docs JOIN (SELECT DISTINCT n FROM windows) ON len(words) >= n
), grams AS (
  SELECT row, n, place, array_to_string(list_slice(words, place, place + n - 1), ' ') AS gram FROM places
), hits AS (
  SELECT row, n, place, item_id FROM grams JOIN windows USING (n, gram)
), found AS (
  SELECT row, count(DISTINCT item_id) AS n_items,
         string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
  FROM hits GROUP BY row
), covered AS (
  SELECT row, count(DISTINCT word) AS n_hit
  FROM (SELECT row, unnest(range(place, place + n)) AS word FROM (SELECT DISTINCT row, place, n FROM hits)) GROUP BY row
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN found USING (row) LEFT JOIN covered USING (row)
""",
}
