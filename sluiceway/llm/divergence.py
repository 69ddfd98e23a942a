"""Operator 13: how far the sources of a language diverge, and by which terms.

Arrow kernels count inside ``mapInArrow``: ``ascii_lower``, ``split_pattern_regex``,
``dictionary_encode`` and the hash ``group_by`` turn a batch of texts into counts per (lang, source,
term), which a task merges until they are many and hands on. Spark sums them. The terms of a language
are then dealt to columnar shards (terms by sources, at most about ``CELLS`` cells), each shard adds up
its part of every divergence in numpy integers, and Spark sums the shards.

Terms are runs of letters A-Z (lower-cased) and characters beyond ASCII. A language keeps the V terms
found in at least ``min_docs`` of its rows. A group (lang, source) gives each kept term
p = 1 + floor(10^9 (count + 1) / (N + V)), N being its occurrences of kept terms; the language itself
likewise q. The divergence of two numbers is floor((p - q)^2 / q). All of it is exact as long as a
group has fewer than 2 * 10^14 occurrences.

Cases: null texts, languages and sources are empty strings; a group without terms takes part with
count 0 everywhere; in a language that keeps no term all pairs have the value 0; a language of one
source has no pairs; rows that repeat count again, also as documents; other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sluiceway.llm.common import land, table
from sluiceway.operators.sequence import lookup

BREAK = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
SCALE = 1_000_000_000
#: cells (terms by sources) of a shard
CELLS = 1 << 20
#: counts that a task merges before it hands them on
HELD_ROWS = 1 << 18
KEYS = ["lang", "source", "term"]


def count_batch(batch: pa.RecordBatch) -> pa.Table:
    """lang, source, term, n (occurrences) and docs (rows with the term) of a batch without nulls."""
    terms = pc.split_pattern_regex(pc.ascii_lower(batch["text"]), pattern=BREAK)
    found = pa.table({"row": pc.list_parent_indices(terms), "term": pc.list_flatten(terms)})
    found = found.filter(pc.not_equal(found["term"], ""))
    coded = pc.dictionary_encode(found["term"]).combine_chunks()
    if not len(coded):
        coded = pa.array([], pa.string()).dictionary_encode()
    rows = pa.table({"row": found["row"], "code": coded.indices}).group_by(["row", "code"]).aggregate([([], "count_all")])
    rows = pa.table({
        "lang": batch["lang"].dictionary_encode().indices.take(rows["row"]),
        "source": batch["source"].dictionary_encode().indices.take(rows["row"]),
        "code": rows["code"], "n": rows["count_all"],
    }).group_by(["lang", "source", "code"]).aggregate([("n", "sum"), ([], "count_all")])
    return pa.table({
        "lang": batch["lang"].dictionary_encode().dictionary.take(rows["lang"]),
        "source": batch["source"].dictionary_encode().dictionary.take(rows["source"]),
        "term": coded.dictionary.take(rows["code"]), "n": rows["n_sum"], "docs": rows["count_all"],
    })


def _merged(parts: list[pa.Table]) -> pa.Table:
    rows = pa.concat_tables(parts).group_by(KEYS).aggregate([("n", "sum"), ("docs", "sum")])
    return rows.rename_columns([*KEYS, "n", "docs"])


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.Table] = []
    size = 0
    for batch in batches:
        held.append(count_batch(batch))
        size += held[-1].num_rows
        if size > HELD_ROWS:
            held = [_merged(held)]
            size = held[0].num_rows
            if size > HELD_ROWS // 2:
                yield from held[0].to_batches(1 << 16)
                held, size = [], 0
    if held:
        yield from _merged(held).to_batches(1 << 16)


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, docs: occurrences of a term in a group and rows that hold it."""
    texts = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    return (
        texts.mapInArrow(counted, "lang string, source string, term string, n long, docs long")
        .groupBy(*KEYS).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    )


def shares(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 counts / totals) for counts <= totals, without leaving 64 bits."""
    coarse, fine = 32_000, SCALE // 32_000
    high = counts * coarse
    return 1 + high // totals * fine + high % totals * fine // totals


def pair_sums(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Of a terms-by-groups matrix of counts: the divergence of each group (row) from each other (column)."""
    p = shares(counts + 1, totals[None, :])
    out = np.empty((len(totals), len(totals)), np.int64)
    for g in range(len(totals)):
        gap = p[:, g:g + 1] - p
        out[g] = (gap * gap // p).sum(axis=0)
    return out


def _shard(cells: pa.Table, groups: pa.Table) -> pa.Table:
    names = groups["source"].to_pylist()
    totals = (groups["total"].to_numpy() + groups["kept"].to_numpy()).astype(np.int64)
    if cells.num_rows:
        terms = cells["term"].combine_chunks().dictionary_encode()
        at = pc.index_in(cells["source"], groups["source"].combine_chunks()).to_numpy()
        counts = np.zeros((len(terms.dictionary), len(names)), np.int64)
        counts[terms.indices.to_numpy(), at] = cells["n"].to_numpy()
        sums = pair_sums(counts, totals)
    else:
        sums = np.zeros((0, 0), np.int64)
    a, b = np.nonzero(~np.eye(len(sums), dtype=bool)) if len(sums) else (np.array([], int), np.array([], int))
    source = groups["source"].combine_chunks()
    return pa.table({
        "lang": groups["lang"].combine_chunks().take(pa.array(np.zeros(len(a), np.int64))),
        "source": source.take(pa.array(a)), "item": source.take(pa.array(b)), "value": pa.array(sums[a, b], pa.int64()),
    })


def audit(docs: DataFrame, min_docs: int = 3, top: int = 200, cells: int = CELLS) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank."""
    counts = land(term_counts(docs), "term-counts")
    kept = land(
        counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n"))
        .where(F.col("docs") >= min_docs).drop("docs"),
        "kept-terms",
    )
    counts = land(counts.drop("docs").join(kept, ["lang", "term"]), "kept-counts")
    langs = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("lang_n").alias("lang_total"))
    sources = (
        docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
        .join(counts.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left")
        .join(langs, "lang", "left").na.fill(0, ["total", "kept", "lang_total"])
    )
    groups = land(
        sources.withColumn("shards", F.ceil(F.col("kept") * F.count("*").over(Window.partitionBy("lang")) / cells).cast("int")),
        "source-groups",
    )

    per_lang = groups.groupBy("lang").agg(F.first("shards").alias("shards"))
    dealt = lookup(counts, per_lang, "lang").withColumn("shard", F.pmod(F.xxhash64("term"), F.col("shards")).cast("int"))
    copies = groups.where("shards > 0").withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    sums = (
        dealt.select("lang", "shard", "source", "term", "n").groupBy("lang", "shard")
        .cogroup(copies.select("lang", "shard", "source", "total", "kept").groupBy("lang", "shard"))
        .applyInArrow(_shard, "lang string, source string, item string, value long")
        .groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    )
    pairs = (
        groups.select("lang", "source").join(groups.select("lang", F.col("source").alias("item")), "lang")
        .where("source != item").join(sums, ["lang", "source", "item"], "left")
        .select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))
    )

    def share(n: str, total: str):
        return F.expr(f"1 + cast({n} + 1 as decimal(20, 0)) * cast({SCALE} as decimal(10, 0)) div ({total} + kept)")

    terms = (
        lookup(counts, groups.select("lang", "source", "total", "kept", "lang_total"), ["lang", "source"])
        .withColumn("p", share("n", "total")).withColumn("q", share("lang_n", "lang_total")).where("p > q")
        .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
                F.expr("(p - q) * (p - q) div q").alias("value"))
    )
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(order))
    terms = terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.unionByName(terms)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


QUERIES = {"op13_source_divergence": op13_source_divergence}
ORACLES = {
    "op13_source_divergence": r"""
WITH docs AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM documents
), uses AS (
  SELECT row, lang, source, unnest(words) AS term FROM docs
), vocabulary AS (
  SELECT lang, term FROM uses GROUP BY lang, term HAVING count(DISTINCT row) >= 3
), counts AS (
  SELECT lang, source, term, count(*) AS n FROM uses JOIN vocabulary USING (lang, term) GROUP BY ALL
), groups AS (
  SELECT DISTINCT lang, source FROM docs
), sizes AS (
  SELECT lang, count(*) AS v FROM vocabulary GROUP BY lang
), totals AS (
  SELECT lang, source, coalesce(sum(n), 0)::HUGEINT AS total
  FROM groups LEFT JOIN counts USING (lang, source) GROUP BY ALL
), p AS (
  SELECT lang, source, term, coalesce(n, 0) AS n,
         1 + (1000000000::HUGEINT * (coalesce(n, 0) + 1)) // (total + v) AS p
  FROM totals JOIN sizes USING (lang) JOIN vocabulary USING (lang) LEFT JOIN counts USING (lang, source, term)
), q AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 1)) // (any_value(t.total) + any_value(v)) AS q
  FROM counts JOIN sizes USING (lang)
  JOIN (SELECT lang, sum(total) AS total FROM totals GROUP BY lang) t USING (lang) GROUP BY lang, term
), sums AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM found
)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200
""",
}
