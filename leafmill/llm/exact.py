"""Exact dedup by a heavy-hitter split, with DataFrame functions only.

Texts are equal when identical after lower-casing A-Z. Each text's SHA-256 stands for it. A frequent-items
sketch (Misra-Gries with bounded counters; Spark's ``approx_top_k_*``) finds the digests that may be frequent.
Their exact winners are counted from the digests themselves and broadcast: at most ``counters`` rows, whatever
the input's size. Copies of those texts are settled in the tasks that scan them, so that a text which fills a
third of the table never meets in one task; all others go through one ordinary shuffle by digest.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .common import fresh, stage

#: Counters of the sketch. A digest with more than rows / (0.75 * counters) copies is surely found.
COUNTERS = 2048
#: Groups below this size are left to the ordinary shuffle, even if the sketch has them.
LEAST_HEAVY = 16


def normalised(text: Column) -> Column:
    """``text`` with A-Z lower-cased and nothing else changed; null counts as empty."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    ascii_only = F.octet_length(text) == F.length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def heavy_winners(ids: DataFrame, counters: int = COUNTERS, least: int = LEAST_HEAVY) -> DataFrame:
    """digest, keep_id and group_size of digests that are frequent in ``ids`` (doc_id, digest).

    The sketches are combined in two levels, so that no task gets one of each scan task. The sketch only
    nominates; winners and sizes come from an exact aggregation of the nominees, so it cannot cause an error.
    """
    part = (
        ids.select(F.xxhash64("digest").alias("key"), (F.spark_partition_id() % 64).alias("part"))
        .groupBy("part")
        .agg(F.expr(f"approx_top_k_accumulate(key, {counters})").alias("state"))
    )
    # grouped, so that tasks without sketches give none: an empty one cannot be combined
    top = part.groupBy((F.col("part") * 0).alias("all")).agg(F.expr(f"approx_top_k_estimate(approx_top_k_combine(state, {counters}), {counters})").alias("top"))
    keys = top.select(F.explode("top").alias("x")).where(F.col("x.count") >= least).select(F.col("x.item").alias("key"))
    named = ids.withColumn("key", F.xxhash64("digest")).join(F.broadcast(keys), "key", "left_semi")
    exact = named.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    return exact.where(F.col("group_size") >= least)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """One row per input row: doc_id, digest (binary), keep_id, group_size, kept.

    keep_id is the largest id among equal texts; null ids lose to all others, and a group with only null ids
    has keep_id null. kept is true where doc_id equals keep_id (null equals null), so that rows repeated
    with their id are all marked kept; ``exact_dedup`` returns just one of them. A null text counts as the
    empty text. An empty table gives an empty result.
    """
    ids = stage(docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.sha2(normalised(F.col(text_col)), 256)).alias("digest")), "digests")
    return settled(ids, stage(heavy_winners(ids, counters), "winners"))


def settled(ids: DataFrame, heavy: DataFrame) -> DataFrame:
    """doc_id, digest, keep_id, group_size, kept of ``ids``: frequent digests by their broadcast winners, the rest by a shuffle."""
    known = ids.join(F.broadcast(heavy), "digest")
    group = Window.partitionBy("digest")
    rest = ids.join(F.broadcast(heavy.select("digest")), "digest", "left_anti").select(
        "digest", "doc_id", F.max("doc_id").over(group).alias("keep_id"), F.count("*").over(group).alias("group_size")
    )
    both = known.select("digest", "doc_id", "keep_id", "group_size").unionByName(rest)
    return both.select("doc_id", "digest", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of equal texts the one with the largest id.

    Of rows that share text and id (or have no id at all), one stays. Groups are settled on ids and digests alone. Rows that
    go are then dropped in the scan if there are few enough of them to be broadcast. If not, frequent texts lose their
    copies in the scan, each other text's rows meet by digest, and only one per digest and task is shuffled.
    """
    digest = fresh(docs, "digest")
    keyed = docs.withColumn(digest, F.unhex(F.sha2(normalised(F.col(text_col)), 256)))
    ids = stage(keyed.select(F.col(id_col).alias("doc_id"), F.col(digest).alias("digest")), "digests")
    heavy = stage(heavy_winners(ids, counters), "winners")
    groups = stage(settled(ids, heavy).groupBy("doc_id", "digest", "kept").agg(F.count("*").alias("n")).where("n > 1 OR NOT kept"), "groups")
    if groups.count() <= common.BROADCAST_ROWS:
        names = [fresh(docs, "few_id"), fresh(docs, "few_digest")]
        same = F.col(id_col).eqNullSafe(F.col(names[0])) & (F.col(digest) == F.col(names[1]))
        out = keyed.join(F.broadcast(groups.where("NOT kept").select("doc_id", "digest").toDF(*names)), same, "left_anti")
        twice = groups.where("kept").select("doc_id", "digest").toDF(*names)
        if not twice.isEmpty():  # rows that repeat their id and text
            out = out.join(F.broadcast(twice), same, "left_anti").unionByName(out.join(F.broadcast(twice), same, "left_semi").dropDuplicates([id_col, digest]))
        return out.select(*docs.columns)
    keep, rank = fresh(docs, "keep"), fresh(docs, "rank")
    heavy = heavy.select(F.col("digest").alias(digest), F.col("keep_id").alias(keep), F.lit(True).alias(rank))
    left = keyed.join(F.broadcast(heavy), digest, "left").where(F.col(rank).isNull() | F.col(id_col).eqNullSafe(F.col(keep)))
    order = Window.partitionBy(digest).orderBy(F.col(id_col).desc_nulls_last())
    return left.select(digest, *[docs[c] for c in docs.columns]).withColumn(rank, F.row_number().over(order)).where(F.col(rank) == 1).drop(rank, digest)


def op8_exact_dedup(spark, sf_dir: str) -> DataFrame:
    from .common import table

    out = exact_groups(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


SQL = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""
