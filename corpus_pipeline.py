"""From raw documents to packed training sequences.

STAGES are applied one after the other; each reads what its predecessor wrote:

1. quality    the byte network rejects documents that score below 0.5 (trained on labelled rows)
2. exact      of texts that are equal without white space, one stays
3. near       of documents linked by SimHash, the one with the least id stays
4. private    personal data give way to surrogates
5. packing    what is left is packed along the Hilbert curve; its pieces are the result

Stages keep the columns of ``documents`` until the last. Null texts count as empty; an empty table
passes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sluiceway.llm import exact_dedup, packing, quality, simhash, surrogates
from sluiceway.llm.common import land, prepare, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(spark, docs, table(spark, sf_dir, "labels"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return simhash.drop_near_copies(docs)


def replace_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return surrogates.with_surrogates(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return packing.digest(packing.pack(docs, packing.word_tokenizer()))


STAGES = [
    ("quality", keep_quality),
    ("exact", drop_exact_copies),
    ("near", drop_near_copies),
    ("private", replace_private),
    ("packing", pack_sequences),
]

#: A trained network, union by reachability and a tokeniser have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = land(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


QUERIES = {"pipeline": run}
ORACLES = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
