"""Segments to parents and children: paragraphs merged, code split, long parents sharded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions import text as T


def merge_paragraphs(df: DataFrame, key: list[str], pos: str, text: str, tokens: str, least: int = 40, glue: str = "\n\n") -> DataFrame:
    """Paragraphs (one a row) merged: short ones join the next long one, trailing ones the last.

    The number of long paragraphs before one is its group; what follows the last long one stays in its group.
    Where rows share a key, paragraphs at one position go by their text.
    """
    order = Window.partitionBy(*key).orderBy(pos, text)
    big = (F.col(tokens) >= least).cast("int")
    before = F.coalesce(F.sum(big).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum(big).over(Window.partitionBy(*key))
    grouped = df.withColumn("grp", F.least(before, F.greatest(total - 1, F.lit(0))).cast("int"))
    merged = grouped.groupBy(*key, "grp").agg(F.array_sort(F.collect_list(F.struct(pos, text))).alias("parts"), F.count("*").alias("n_parts"))
    return merged.select(*key, F.col("grp").alias("par_ord"), F.array_join(F.transform("parts", lambda p: p[text]), glue).alias("content"), "n_parts")


def text_parents(segments: DataFrame, cfg: Config = DEFAULT, boundary: str = T.PARAGRAPH, count=T.token_count) -> DataFrame:
    """Parents of text segments (document_id, seg_ord, page, text, image_path)."""
    paras = segments.select("document_id", "seg_ord", F.posexplode(T.paragraphs(F.col("text"), boundary)).alias("pos", "para"))
    paras = paras.withColumn("n_tok", count(F.col("para")))
    merged = merge_paragraphs(paras, ["document_id", "seg_ord"], "pos", "para", "n_tok", cfg.min_para_tokens)
    meta = segments.select("document_id", "seg_ord", "page", "image_path")
    rows = merged.join(meta, ["document_id", "seg_ord"])
    return rows.select("document_id", "seg_ord", "par_ord", "content", F.col("content").alias("raw"), count(F.col("content")).alias("token_count"), F.lit("text").alias("content_type"), F.lit(None).cast("string").alias("language"), "page", "image_path")


def code_parents(segments: DataFrame, count=T.token_count) -> DataFrame:
    """Parents of code segments: split where definitions start; tokens are counted before trailing space goes."""
    rows = segments.select("document_id", "seg_ord", "page", "language", F.posexplode(T.code_blocks(F.col("text"))).alias("par_ord", "raw"))
    return rows.select("document_id", "seg_ord", "par_ord", T.rstrip(F.col("raw")).alias("content"), "raw", count(F.col("raw")).alias("token_count"), F.lit("code").alias("content_type"), "language", "page", F.lit(None).cast("string").alias("image_path"))


def image_parents(segments: DataFrame, count=T.token_count) -> DataFrame:
    """A figure is a parent of its caption; figures without one are dropped."""
    rows = segments.where(T.strip(F.coalesce("text", F.lit(""))) != "")
    text = T.strip(F.col("text"))
    return rows.select("document_id", "seg_ord", F.lit(0).alias("par_ord"), text.alias("content"), text.alias("raw"), count(text).alias("token_count"), F.lit("image").alias("content_type"), F.lit(None).cast("string").alias("language"), "page", "image_path")


def children(parents: DataFrame, cfg: Config = DEFAULT, tokenize=T.tokens, glue: str = " ") -> DataFrame:
    """Each parent's children: itself if it is short, else windows of its tokens."""
    long = F.col("token_count") > cfg.max_parent_tokens
    windows = F.transform(T.shards(tokenize(F.col("raw")), cfg.child_tokens, cfg.child_overlap), lambda w: F.struct(F.array_join(w, glue).alias("content"), F.size(w).alias("token_count")))
    whole = F.array(F.struct(F.col("content"), F.col("token_count").cast("int").alias("token_count")))
    keep = [c for c in parents.columns if c not in ("content", "raw", "token_count")]
    return parents.select(*keep, F.posexplode(F.when(long, windows).otherwise(whole)).alias("shard", "c")).select(*keep, "shard", "c.content", "c.token_count")


def chunk_segments(segments: DataFrame, cfg: Config = DEFAULT, boundary: str = T.PARAGRAPH) -> tuple[DataFrame, DataFrame]:
    """(parents, children) of all segments, by kind."""
    kind: Column = F.col("kind")
    parents = text_parents(segments.where(kind == "text"), cfg, boundary).unionByName(code_parents(segments.where(kind == "code"))).unionByName(image_parents(segments.where(kind == "image")))
    parents = parents.withColumn("id", F.xxhash64("document_id", "seg_ord", "par_ord"))
    return parents, children(parents.withColumnRenamed("id", "parent_chunk_id"), cfg).withColumn("id", F.xxhash64("parent_chunk_id", F.lit("child"), "shard"))
