"""Parsed page blocks to segments: code by its fonts, scanned pages, figures with their captions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, MONO_FONTS, Config
from ..functions import text as T

#: How a line of code and a caption start.
CODE_START = r"^\s*(def |class |import |from |#include|using namespace|fn |let |const |async |await |return |if |for |while |//|#)"
CAPTION_START = r"(?i)^\s*(fig(?:ure)?\.?|table|chart|scheme|plot|diagram)\b"


def text_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks of type 0 that hold text, with the share of their characters in a monospaced font and whether they are code."""
    spans = F.coalesce("spans", F.array().cast("array<struct<text:string,font:string>>"))
    mono_font = "|".join(MONO_FONTS)
    chars = F.aggregate(spans, F.lit(0), lambda s, x: s + F.length(x["text"]))
    mono = F.aggregate(F.filter(spans, lambda x: x["font"].rlike(mono_font)), F.lit(0), lambda s, x: s + F.length(x["text"]))
    text = F.array_join(F.transform(spans, lambda x: x["text"]), "")
    rows = blocks.where("type = 0").withColumn("text", text).where(T.strip(F.col("text")) != "")
    rows = rows.withColumn("mono", F.when(chars > 0, mono / chars).otherwise(0.0))
    return rows.withColumn("is_code", (F.col("mono") > 0.6) | ((F.col("mono") > 0.3) & F.col("text").rlike(CODE_START)))


def page_segments(blocks: DataFrame, code_aware: bool = True) -> DataFrame:
    """Text and code segments in reading order: runs of text blocks join by line feeds, each code block stands alone."""
    rows = text_blocks(blocks)
    if not code_aware:
        rows = rows.withColumn("is_code", F.lit(False))
    order = Window.partitionBy("doc_id", "page").orderBy("block")
    code = F.col("is_code").cast("int")
    island = F.sum(code).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) * 2 - code
    runs = rows.withColumn("island", island).groupBy("doc_id", "page", "island", "is_code")
    joined = runs.agg(F.array_sort(F.collect_list(F.struct("block", "text"))).alias("parts"), F.min("block").alias("first"))
    text = F.array_join(F.transform("parts", lambda p: p["text"]), "\n")
    kind = F.when(F.col("is_code"), "code").otherwise("text")
    return joined.select("doc_id", "page", F.col("first").alias("ord"), text.alias("text"), kind.alias("kind"), F.when(F.col("is_code"), T.detect_language(text)).alias("language"))


def image_blocks(blocks: DataFrame, least: int = DEFAULT.min_image_area) -> DataFrame:
    """Images of at least ``least`` pixels, numbered on their page, with a file name and a rounded box."""
    order = Window.partitionBy("doc_id", "page").orderBy("block")
    rows = blocks.where(f"type = 1 AND width * height >= {least}").withColumn("idx", F.row_number().over(order))
    box = F.struct(*[F.round(F.col(f"bbox.{c}"), 1).alias(c) for c in ("x0", "y0", "x1", "y1")])
    return rows.withColumn("image_name", F.format_string("p%04d_img%02d", "page", "idx")).withColumn("bbox", box)


def scanned_pages(blocks: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """doc_id, page of pages with hardly any text and an image over most of them."""
    text = text_blocks(blocks).groupBy("doc_id", "page").agg(F.sum(F.length(T.strip(F.col("text")))).alias("chars"))
    area = F.abs((F.col("bbox.x1") - F.col("bbox.x0")) * (F.col("bbox.y1") - F.col("bbox.y0")))
    images = blocks.where("type = 1").groupBy("doc_id", "page").agg(F.max(area / (F.col("page_w") * F.col("page_h"))).alias("share"))
    both = images.join(text, ["doc_id", "page"], "left")
    return both.where((F.coalesce("chars", F.lit(0)) < cfg.scan_text_max) & (F.col("share") > cfg.scan_area_frac)).select("doc_id", "page")


def nearest_caption(images: DataFrame, texts: DataFrame, reach: float = 40.0) -> DataFrame:
    """Each image's caption: of blocks that begin below it and are near or begin like one, the nearest; the first of ties; else ''.

    images: doc_id, page, img, iy1. texts: doc_id, page, block, by0, text. Joined on the page, which bounds the pairs.
    """
    t = texts.withColumnRenamed("by0", "by")
    gap = F.col("by") - F.col("iy1")
    pairs = images.join(t, ["doc_id", "page"]).where((F.col("by") >= F.col("iy1") - 2) & (F.col("text").rlike(CAPTION_START) | (gap < reach)))
    best = pairs.groupBy("doc_id", "page", "img").agg(T.strip(F.min_by("text", F.struct(gap, "block"))).alias("caption"))
    return images.join(best, ["doc_id", "page", "img"], "left").withColumn("caption", F.coalesce("caption", F.lit("")))


def document_segments(blocks: DataFrame, cfg: Config = DEFAULT, code_aware: bool = True) -> DataFrame:
    """doc_id, page, seg_ord, text, kind, language, image_path, is_scan: a page's text and code first, then its figures.

    The figures of a scanned page stand for its text; others have the caption that is found near them.
    """
    text = page_segments(blocks, code_aware).select("doc_id", "page", F.lit(0).alias("rank"), "ord", "text", "kind", "language", F.lit(None).cast("string").alias("image_path"), F.lit(False).alias("is_scan"))
    images = image_blocks(blocks, cfg.min_image_area).withColumn("img", F.col("block"))
    near = nearest_caption(images.select("doc_id", "page", "img", F.col("bbox.y1").alias("iy1")), text_blocks(blocks).select("doc_id", "page", "block", F.col("bbox.y0").alias("by0"), "text"))
    scans = scanned_pages(blocks, cfg).withColumn("is_scan", F.lit(True))
    named = images.join(near.select("doc_id", "page", "img", "caption"), ["doc_id", "page", "img"]).join(scans, ["doc_id", "page"], "left")
    figures = named.select("doc_id", "page", F.lit(1).alias("rank"), F.col("block").alias("ord"), F.col("caption").alias("text"), F.lit("image").alias("kind"), F.lit(None).cast("string").alias("language"), F.col("image_name").alias("image_path"), F.coalesce("is_scan", F.lit(False)).alias("is_scan"))
    order = Window.partitionBy("doc_id").orderBy("page", "rank", "ord")  # one document
    return text.unionByName(figures).withColumn("seg_ord", F.row_number().over(order) - 1).drop("rank", "ord")


def caption_counts(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """One row: images that were captioned, scans that became text, images that the model left as they were."""
    b, a = before.select(*keys, F.col("kind").alias("was"), F.col("text").alias("old")), after.select(*keys, "kind", "text")
    both = b.where("was = 'image'").join(a, keys)
    same = F.col("text").eqNullSafe(F.col("old")) & (F.col("kind") == "image")
    return both.agg(F.count_if((F.col("kind") == "image") & ~same).alias("captioned"), F.count_if(F.col("kind") == "text").alias("transcribed"), F.count_if(same).alias("left"))


def caption_images(segments: DataFrame, caption, transcribe) -> DataFrame:
    """Image segments with generated text: scans become text, figures get their found caption and the generated one.

    ``caption`` and ``transcribe`` are columns made from image_path by an injected model; null where it fails, which
    leaves the row as it is.
    """
    image, scan = F.col("kind") == "image", F.col("is_scan")
    made = F.when(image & scan, transcribe).when(image, caption)
    text = F.when(made.isNull(), F.col("text")).when(scan | (F.coalesce("text", F.lit("")) == ""), made).otherwise(F.concat("text", F.lit("\n"), made))
    return segments.withColumns({"kind": F.when(image & scan & made.isNotNull(), "text").otherwise(F.col("kind")), "text": text})
