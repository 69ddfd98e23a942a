"""Operator 7: SentencePiece encoding and decoding on a relational lattice.

Texts are cut into atoms: before each run of spaces, and between two characters that no piece of the
vocabulary holds side by side, so no segmentation crosses a cut. The distinct atoms form a table. Each
atom's substrings up to the longest piece are exploded and equi-joined to the piece table; the edges are
grouped by atom, and a higher-order aggregate folds Viterbi over its ends from left to right: the best path to
an end is the best of its edges, by 32-bit score and then by the longer piece, as the reference library
does. Characters no piece covers fall back to their UTF-8 bytes.

Encoding a document looks its atoms up. The most frequent atoms (a bounded number) travel to every
task; the rest reach the documents by a join, so the table may grow with the corpus.

Cases: null and empty texts have no ids; a text of spaces only is encoded like any other; decoding drops
the space that encoding puts in front; U+2581 decodes to a space; rows that repeat an id are all returned;
other columns are ignored; an empty table gives an empty result. The fold copies its path at every end,
n**2 steps for n characters, so atoms beyond LONG_ATOM characters take the same best path by a linear
loop in the task that holds them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from sluiceway.llm.common import land, table
from sluiceway.operators.sequence import lookup

SPACE = "▁"
HEAD_ATOMS = 400_000
UNKNOWN_PENALTY = 10.0
LONG_ATOM = 256
TASK_ATOMS = 20_000
RARE_BYTES = 16 << 20
SLICE_BYTES = 3 << 20
PART_ROWS = 128


class Vocabulary:
    """The pieces, scores and byte pieces of a model file."""

    def __init__(self, model_path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        every = range(model.vocab_size())
        odd = {i for i in every if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)}
        self.pieces = [(model.id_to_piece(i), i, float(model.get_score(i))) for i in every if i not in odd]
        self.known = {p: (i, np.float32(s)) for p, i, s in self.pieces}
        self.bytes = {int(model.id_to_piece(i)[1:-1], 16): i for i in every if model.is_byte(i)}
        self.unknown = model.unk_id()
        self.longest = max(len(p) for p, _, _ in self.pieces)
        self.lowest = min(s for _, _, s in self.pieces)
        self.pairs = frozenset(p[i:i + 2] for p, _, _ in self.pieces for i in range(len(p) - 1))
        if any(SPACE in p.lstrip(SPACE) for p, _, _ in self.pieces):
            raise ValueError("a piece goes on after a space: words cannot be encoded by themselves")
        self.words = {i: p.replace(SPACE, " ").encode() for p, i, _ in self.pieces} | {i: bytes([b]) for b, i in self.bytes.items()}


WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


def words_of(text: str) -> list[str]:
    """The words of a text, each with the spaces before it."""
    return WORD.findall(SPACE + text.replace(" ", SPACE)) if text else []


def atoms_of(word: str, pairs: frozenset[str]) -> list[str]:
    out, start = [], 0
    for i in range(1, len(word)):
        if word[i - 1:i + 1] not in pairs:
            out.append(word[start:i])
            start = i
    return [*out, word[start:]]


class Cutter:
    """Cuts texts at once wherever ``atoms_of`` cuts their words.

    No piece holds a space behind another character, so each word begins at a cut. ``most`` characters are looked at
    at once.
    """

    def __init__(self, pairs: frozenset[str], most: int = 1 << 16):
        self.most = most
        letters = sorted({c for p in pairs for c in p} | {SPACE})
        self.classes = np.zeros(0x110000, "int32" if len(letters) < 40_000 else "int64")
        self.classes[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.classes[ord(" ")] = self.classes[ord(SPACE)]
        self.width = len(letters) + 1
        self.joined = np.sort(np.array([self._pair(*self.classes[[ord(p[0]), ord(p[1])]]) for p in pairs], "int64"))
        self.table = None
        if self.width ** 2 <= 1 << 25:
            self.table = np.zeros(self.width ** 2, bool)
            self.table[self.joined] = True

    def _pair(self, left, right):
        return left * self.width + right

    def _together(self, classes: np.ndarray) -> np.ndarray:
        pair = self._pair(classes[:-1], classes[1:])
        if self.table is not None:
            return self.table[pair]
        place = np.minimum(np.searchsorted(self.joined, pair), len(self.joined) - 1)
        return self.joined[place] == pair if len(self.joined) else np.zeros(len(pair), bool)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        """The atoms of ``texts`` as places among the distinct ones, these, and the bounds of each text's atoms."""
        texts = texts.fill_null("")
        led = pc.if_else(pc.greater(pc.binary_length(texts), 0), " ", "")
        texts = pc.replace_substring(pc.binary_join_element_wise(led, texts, ""), SPACE, " ")
        bounds = np.append(0, np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype="int64"))
        if not bounds[-1]:
            return np.zeros(0, "int64"), pa.array([], pa.string()), bounds
        data = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), texts), "")[0].as_buffer()
        whole, starts, done = str(data, "utf-8"), [], 0
        for i in range(0, len(whole), self.most):
            part = whole[i:i + self.most]
            raw = part.encode()
            before = whole[i - 1] if i else ""
            cut = ~self._together(self.classes[np.frombuffer((before + part).encode("utf-32-le"), "<u4")])
            at = np.flatnonzero(cut if i else np.append(True, cut))
            if len(raw) > len(part):  # from characters to bytes
                at = np.flatnonzero((np.frombuffer(raw, "uint8") & 0xC0) != 0x80)[at]
            starts.append(at + done)
            done += len(raw)
        starts, heads = np.concatenate(starts), bounds[:-1][np.diff(bounds) > 0]
        heads = heads[starts[np.minimum(np.searchsorted(starts, heads), len(starts) - 1)] != heads]
        starts = np.sort(np.append(starts, heads)) if len(heads) else starts
        offsets = np.append(starts, bounds[-1]).astype("int32")
        found = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(offsets), data]).dictionary_encode()
        return found.indices.to_numpy(), pc.replace_substring(found.dictionary, " ", SPACE), np.searchsorted(starts, bounds)


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of texts of about ``SLICE_BYTES``."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False).astype("int64")
        part = np.cumsum(sizes) // SLICE_BYTES
        at = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for start, end in zip(at, at[1:]):
            if end > start:
                yield batch.slice(start, end - start)


def atoms(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(atom, n) for each distinct atom of ``docs``, counted in the tasks first."""
    pairs = vocabulary.pairs

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = Cutter(pairs)
        for batch in slices(batches):
            places, distinct, _ = cut(batch["text"])
            n = np.bincount(places, minlength=len(distinct))
            yield pa.RecordBatch.from_arrays([distinct, pa.array(n, pa.int64())], ["atom", "n"])

    return docs.select("text").mapInArrow(count, "atom string, n long").groupBy("atom").agg(F.sum("n").alias("n"))


def lattice(words: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(atom, n, edges): the edges of each row of ``words`` (atom, n) as (start, end, score, id); id is
    -1 for a character that no piece covers.

    Where ``words`` are partitioned by atom, the edges are joined and grouped without leaving their task.
    """
    spark = words.sparkSession
    table_ = spark.createDataFrame(vocabulary.pieces, "piece string, id int, score float")
    fallback = float(np.float32(vocabulary.lowest - UNKNOWN_PENALTY))
    spans = words.select("atom", "n", F.explode(F.sequence(F.lit(0), F.length("atom") - 1)).alias("start")).select(
        "atom", "n", "start",
        F.explode(F.sequence(F.lit(1), F.least(F.lit(vocabulary.longest), F.length("atom") - F.col("start")))).alias("size"),
    ).withColumn("piece", F.col("atom").substr(F.col("start") + 1, F.col("size")))
    # the piece table is as large as the vocabulary, whatever the corpus
    edges = spans.join(F.broadcast(table_), "piece", "left").where("id is not null or size = 1")
    return edges.groupBy("atom", "n").agg(F.collect_list(F.struct(
        "start", (F.col("start") + F.col("size")).alias("end"),
        F.coalesce("score", F.lit(fallback).cast("float")).alias("score"), F.coalesce("id", F.lit(-1)).alias("id"),
    )).alias("edges"))


def viterbi(edges: DataFrame) -> DataFrame:
    """(atom, n, steps): the best path of each atom as (id, start, end)."""
    origin = F.array(F.struct(
        F.lit(0).cast("float").alias("score"), F.lit(0).alias("later"), F.lit(0).alias("start"), F.lit(-2).alias("id")
    ))

    def step(best, end):
        reached = F.transform(F.filter("edges", lambda e: e["end"] == end), lambda e: F.struct(
            (F.get(best, e["start"])["score"] + e["score"]).alias("score"), (-e["start"]).alias("later"),
            e["start"].alias("start"), e["id"].alias("id"),
        ))
        return F.concat(best, F.array(F.array_max(reached)))

    def back(path, _):
        # follow the pointer at the path's first start, until it is the origin
        first = F.get(path, F.lit(0))["start"]
        best = F.get(F.col("best"), first)
        return F.when(first == 0, path).otherwise(
            F.concat(F.array(F.struct(best["id"].alias("id"), best["start"].alias("start"), first.alias("end"))), path)
        )

    last = F.size("best") - 1
    tail = F.get("best", last)
    seed = F.array(F.struct(tail["id"].alias("id"), tail["start"].alias("start"), last.alias("end")))
    return (
        edges.select("atom", "n", F.explode(F.array(
            F.aggregate(F.sequence(F.lit(1), F.length("atom")), origin, step)
        )).alias("best"))
        .select("atom", "n", F.aggregate("best", seed, back).alias("steps"))
    )


def best_path(atom: str, vocabulary: Vocabulary) -> list[int]:
    """The ids of one atom in one pass, by the rules of the fold: 32-bit scores, the longer piece in a tie."""
    known = vocabulary.known
    fallback = np.float32(vocabulary.lowest - UNKNOWN_PENALTY)
    best = [np.float32(0)] + [None] * len(atom)
    back: list[tuple[int, int]] = [(0, -2)] * (len(atom) + 1)
    for start in range(len(atom)):
        for end in range(start + 1, min(len(atom), start + vocabulary.longest) + 1):
            piece = known.get(atom[start:end])
            if piece is None:
                if end > start + 1:
                    continue
                piece = (-1, fallback)
            score = best[start] + piece[1]
            if best[end] is None or score > best[end]:
                best[end], back[end] = score, (start, piece[0])
    out: list[list[int]] = []
    end = len(atom)
    while end:
        start, piece = back[end]
        spelt = [vocabulary.bytes.get(b, vocabulary.unknown) for b in atom[start:end].encode()] if vocabulary.bytes else [vocabulary.unknown]
        out.append([piece] if piece >= 0 else spelt)
        end = start
    return [i for ids in reversed(out) for i in ids]


def dictionary(
    words: DataFrame, vocabulary: Vocabulary, long_atom: int = LONG_ATOM, task_atoms: int = TASK_ATOMS
) -> DataFrame:
    """(atom, n, ids): the encoding of each atom; uncovered characters are spelt in bytes.

    Atoms are dealt to tasks of about ``task_atoms`` first, so that only atoms are shuffled and a task
    groups its edges in memory.
    """
    words = words.repartition(max(1, -(-words.count() // task_atoms)), "atom")

    def direct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [best_path(a, vocabulary) for a in batch["atom"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch["atom"], pa.array(ids, pa.list_(pa.int32())), batch["n"]], ["atom", "ids", "n"]
            )

    long = words.where(F.length("atom") > long_atom).select("atom", "n").mapInArrow(direct, "atom string, ids array<int>, n long")
    words = words.where(F.length("atom") <= long_atom)
    by_byte = F.array(*[F.lit(vocabulary.bytes.get(b, vocabulary.unknown)) for b in range(256)])
    byte_fallback = bool(vocabulary.bytes)
    found = viterbi(lattice(words, vocabulary))

    def spelt(s):
        letter = F.hex(F.encode(F.col("atom").substr(s["start"] + 1, s["end"] - s["start"]), "UTF-8"))
        cells = F.transform(F.sequence(F.lit(1), F.length(letter), F.lit(2)), lambda i: F.get(
            by_byte, F.conv(F.substring(letter, i, F.lit(2)), 16, 10).cast("int")
        ))
        return F.when(s["id"] >= 0, F.array(s["id"])).otherwise(cells if byte_fallback else F.array(F.lit(vocabulary.unknown)))

    ids = F.flatten(F.transform("steps", spelt))
    return found.select("atom", ids.alias("ids"), "n").unionByName(long)


class Head:
    """The encodings of the most frequent atoms, and texts as codes: ids, and from ``base`` on the places of
    the text's other atoms in the order in which they first come."""

    def __init__(self, atoms: pa.Array, ids: pa.Array, base: int, pairs: frozenset[str]):
        self.atoms, self.base, self.cut = atoms, base, Cutter(pairs)
        self.ids = _words(ids)

    def _places(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array, tuple[np.ndarray, ...]]:
        """Of each atom of ``texts`` its row in the head, or behind it; the bounds of each text's atoms; the other
        atoms; and where these stand, and for each text and other atom the text, the atom and at which of these places."""
        places, distinct, bounds = self.cut(texts)
        known = pc.index_in(distinct, value_set=self.atoms)
        rare = np.flatnonzero(known.is_null().to_numpy(zero_copy_only=False))
        entry = pc.fill_null(known, 0).to_numpy(zero_copy_only=False).astype("int64")
        entry[rare] = len(self.atoms) + np.arange(len(rare))
        entry = entry[places]
        at = np.flatnonzero(entry >= len(self.atoms))
        text, n = np.searchsorted(bounds, at, side="right") - 1, max(1, len(rare))
        pair, first, which = np.unique(text * n + entry[at] - len(self.atoms), return_index=True, return_inverse=True)
        # in the order in which they first come
        order = np.argsort(first)
        number = np.empty(len(order), "int64")
        number[order] = np.arange(len(order))
        return entry, bounds, distinct.take(pa.array(rare)), (at, pair[order] // n, pair[order] % n, number[which])

    def others(self, texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
        """For each text and other atom of it: text, atom."""
        _, _, rare, (_, owner, atom, _) = self._places(texts)
        return owner, rare.take(pa.array(atom))

    def codes(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Codes, and the bounds of each text's codes."""
        entry, bounds, rare, (at, owner, _, which) = self._places(texts)
        every = pa.concat_arrays([self.ids, _words(np.arange(self.base, self.base + len(rare)))])
        taken = every.take(pa.array(entry))
        ends = np.frombuffer(taken.buffers()[1], "int32")[:len(entry) + 1] // 4 if len(entry) else np.zeros(1, "int32")
        codes = _ids(taken).copy()
        codes[ends[at]] = self.base + (np.arange(len(owner)) - np.searchsorted(owner, owner))[which]
        return codes, ends[bounds]


def _words(ids: pa.Array | np.ndarray) -> pa.Array:
    """Lists of ids, or single ones, as unsigned 32-bit little-endian bytes."""
    if isinstance(ids, pa.Array):
        ends, flat = np.append(0, np.cumsum(pc.list_value_length(ids).to_numpy(zero_copy_only=False), dtype="int64")), ids.flatten().to_numpy()
    else:
        ends, flat = np.arange(len(ids) + 1), ids
    buffers = [None, pa.py_buffer((ends * 4).astype("int32")), pa.py_buffer(flat.astype("<u4"))]
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, buffers)


def _ids(cells: pa.Array) -> np.ndarray:
    """The ids in binary cells that were just taken, one after the other."""
    data = cells.buffers()[2]
    return np.frombuffer(data, "<u4") if data is not None else np.zeros(0, "<u4")


def filled(codes: np.ndarray, bounds: np.ndarray, base: int, rare: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The ids of texts' codes and their bounds, given ``place`` and ``ids`` of the other atoms of each text."""
    at = np.flatnonzero(codes >= base)
    if not len(at):
        return codes, bounds
    n = pc.fill_null(pc.list_value_length(rare), 0).to_numpy(zero_copy_only=False)
    own, before = rare.flatten(), np.cumsum(n) - n
    place, ids = pc.struct_field(own, "place").to_numpy(), pc.struct_field(own, "ids")
    row = np.empty(len(place), "int64")
    row[np.repeat(before, n) + place] = np.arange(len(place))
    row = row[before[np.searchsorted(bounds, at, side="right") - 1] + codes[at] - base]
    sizes = pc.list_value_length(ids).to_numpy(zero_copy_only=False).astype("int64")
    size = np.ones(len(codes), "int64")
    size[at] = sizes[row]
    ends = np.append(0, np.cumsum(size))
    out = np.empty(ends[-1], "<u4")
    out[np.delete(ends[:-1], at)] = np.delete(codes, at)
    # each id's distance from the first of its atom
    step = np.arange(size[at].sum()) - np.repeat(np.cumsum(size[at]) - size[at], size[at])
    out[np.repeat(ends[at], size[at]) + step] = ids.flatten().to_numpy()[np.repeat((np.cumsum(sizes) - sizes)[row], size[at]) + step]
    return out, ends[bounds]


def encode(docs: DataFrame, vocabulary: Vocabulary, head_atoms: int = HEAD_ATOMS) -> DataFrame:
    """doc_id and ids (unsigned 32-bit, little-endian) of each document."""
    spark = docs.sparkSession
    words = land(dictionary(land(atoms(docs, vocabulary), "atoms"), vocabulary), "atom-ids")
    # bounded: head_atoms rows, an atom of up to 32 characters each
    head_rows = words.where(F.length("atom") <= 32).orderBy(F.desc("n"), "atom").limit(head_atoms).select("atom", "ids")
    head_rows = land(head_rows, "atom-head")
    columns = head_rows.toArrow().combine_chunks()
    sent = spark.sparkContext.broadcast(tuple(
        columns[c].chunk(0) if columns.num_rows else pa.array([], columns.schema.field(c).type) for c in ("atom", "ids")
    ))
    del columns
    tail = words.join(head_rows.select("atom"), "atom", "left_anti").select("atom", "ids")
    pairs, kind, base = vocabulary.pairs, dict(docs.dtypes)["doc_id"], max([*vocabulary.words, vocabulary.unknown]) + 1
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = Head(*sent.value, base, pairs)
        for batch in slices(batches):
            owner, atom = head.others(batch["text"])
            place = np.arange(len(owner)) - np.searchsorted(owner, owner)
            yield pa.RecordBatch.from_arrays([batch["row"].take(pa.array(owner)), pa.array(place, pa.int32()), atom], ["row", "place", "atom"])

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = Head(*sent.value, base, pairs)
        for batch in slices(batches):
            codes, bounds = head.codes(batch["text"])
            narrow = codes.astype("<u2" if len(codes) and codes.max() < 1 << 16 else "<u4")
            cells = [narrow[a:b].tobytes() for a, b in zip(bounds, bounds[1:])]
            yield pa.RecordBatch.from_arrays([
                batch["row"], batch["doc_id"], pa.array(np.diff(bounds), pa.int64()), pa.array([len(c) for c in cells], pa.int64()),
                pa.array([pa.compress(c, "zstd", asbytes=True) if c else b"" for c in cells], pa.binary()),
            ], ["row", "doc_id", "n", "size", "codes"])

    lists = land(
        rows.mapInArrow(wanted, "row long, place int, atom string").join(tail, "atom")
        .groupBy("row").agg(F.collect_list(F.struct("place", "ids")).alias("rare")),
        "rare-atoms",
    )

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PART_ROWS):
                part, found = batch.slice(at, PART_ROWS), []
                for n, size, cell in zip(*(part[c].to_pylist() for c in ("n", "size", "codes"))):
                    data = pa.decompress(cell, size, "zstd", asbytes=True) if n else b""
                    found.append(np.frombuffer(data, f"<u{size // n}" if n else "<u4").astype("<u4", copy=False))
                bounds = np.append(0, np.cumsum([len(f) for f in found]))
                ids, bounds = filled(np.concatenate(found).astype("<u4"), bounds, base, part["rare"])
                data = ids.tobytes()
                out = [data[4 * a:4 * b] for a, b in zip(bounds.tolist(), bounds[1:].tolist())]
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(out, pa.binary())], ["doc_id", "ids"])

    # where the rare atoms are too many to travel, codes are shuffled, not texts
    texts = rows.mapInArrow(coded, f"row long, doc_id {kind}, n long, size long, codes binary")
    return lookup(texts, lists, "row", "left", RARE_BYTES).select("doc_id", "n", "size", "codes", "rare").mapInArrow(
        whole, f"doc_id {kind}, ids binary"
    )


def decode(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``encoded`` with the text its ids spell, in column ``decoded``."""
    unknown = " ⁇ ".encode()
    # the last stands for all that are not pieces
    words = [vocabulary.words.get(i, unknown) for i in range(max(vocabulary.words, default=0) + 2)]

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_, sizes = pa.array(words, pa.binary()), np.array([len(w) for w in words])
        for batch in batches:
            for at in range(0, batch.num_rows, PART_ROWS):
                part = batch.slice(at, PART_ROWS)
                cells = [c or b"" for c in part["ids"].to_pylist()]
                places = np.minimum(np.frombuffer(b"".join(cells), "<u4"), len(words) - 1)
                spelt = table_.take(pa.array(places))
                data = bytes(spelt.buffers()[2] or b"")
                ends = np.append(0, np.cumsum(sizes[places]))[np.append(0, np.cumsum([len(c) // 4 for c in cells]))].tolist()
                out = [data[a:b].decode("utf-8", "replace").removeprefix(" ") for a, b in zip(ends, ends[1:])]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.string())], [*part.schema.names, "decoded"])

    return encoded.mapInArrow(spell, StructType([*encoded.schema, StructField("decoded", StringType())]))


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op7_lattice_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its number of ids, their CRC, and the SHA-256 of the text decoded from them."""
    vocabulary = Vocabulary(piece_model())
    encoded = encode(table(spark, sf_dir, "documents"), vocabulary)
    return decode(encoded, vocabulary).select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_ids"), F.crc32("ids").alias("ids_crc32"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


QUERIES = {"op7_lattice_pieces": op7_lattice_pieces}
ORACLES: dict[str, str] = {}
