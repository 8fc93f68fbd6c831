"""From raw documents to encoded training data: one operator a stage, each on all that its predecessor kept.

``documents`` -> rows of good quality -> one row of equal texts -> one row of near duplicates (five-word
shingles, similarity 0.8) -> the mix of sources -> token ids. All stages but the last return the columns of
documents; between stages the rows are written as Parquet and read again.

In every stage an empty table gives an empty table, null texts count as empty, ids may be null or repeat, and other columns
may have any names and pass through as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leafmill.llm import bpe, common, exact, minhash, mixing, quality


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field scores at 0.3 or more; clean ones stay. A null or empty text is scored as one empty line."""
    return quality.keep_good(docs, common.table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (but for A-Z in either case) the row with the largest doc_id; null ids lose to others. Null and empty texts are equal."""
    return exact.exact_dedup(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near duplicates the row with the smallest doc_id; texts without words all stay."""
    return minhash.near_dedup(docs, k=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them, in shards, shuffled. A null source is a source; repeats are taken one by one."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, with digests of the ids and of the text decoded from them; a null text has no ids."""
    return bpe.encode_documents(docs, ids=True)


STAGES = [
    ("quality_filter", quality_filter),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("encode", encode),
]

#: SQL has no near-duplicate components, fitted field or byte-pair merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.stage(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
