"""Reading documents: scans of folders, source files, parsed pages, and data sets in the first format that is there."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CODE_EXTENSIONS, SKIP_DIRS


#: What an extractor tells of a page's blocks.
BLOCKS = "page int, block int, type int, bbox struct<x0:double,y0:double,x1:double,y1:double>, width int, height int, spans array<struct<text:string,font:string>>, page_w double, page_h double"


def scan(spark: SparkSession, root: str, domain: str, content: bool = True) -> DataFrame:
    """Files under root/domain: PDF for every domain, source files for ``ai`` too; folders in SKIP_DIRS are left out.

    path, relative, suffix, language, length, and content unless it is not wanted. A missing folder gives no rows,
    and neither do files of length 0. Other suffixes are left out when files are listed, before any is read. Folders are
    judged by the path below the root, not by where the root lies. A list without contents is in order of paths;
    contents are not sorted.
    """
    base = f"{root.rstrip('/')}/{domain}"
    letters = lambda s: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in s)
    glob = "*{" + ",".join(map(letters, [".pdf", *(CODE_EXTENSIONS if domain == "ai" else ())])) + "}"
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(base)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        files = spark.createDataFrame([], "path string, modificationTime timestamp, length long, content binary")
    tail = base.split(":", 1)[-1].lstrip("/")
    below = F.element_at(F.split("path", F.lit("\\Q" + tail + "/\\E")), -1)
    known = F.create_map(*[F.lit(x) for kv in CODE_EXTENSIONS.items() for x in kv])
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    rows = files.withColumn("relative", below).withColumn("suffix", suffix).withColumn("language", F.element_at(known, suffix))
    wanted = (F.col("suffix") == ".pdf") | (F.col("language").isNotNull() if domain == "ai" else F.lit(False))
    parts = F.split("relative", "/")
    skipped = F.arrays_overlap(parts, F.array(*map(F.lit, SKIP_DIRS)))
    cols = ["path", "relative", "suffix", "language", "length", *(["content"] if content else [])]
    found = rows.where(wanted & ~skipped).select(*cols)
    return found if content else found.orderBy("path")


def source_files(files: DataFrame) -> DataFrame:
    """Code files as documents of one segment; blank files have none. Bytes that are not UTF-8 become replacement characters."""

    @F.pandas_udf("string")
    def text(content: pd.Series) -> pd.Series:
        return content.map(lambda b: None if b is None else bytes(b).decode("utf-8", "replace"))

    code = files.where("language IS NOT NULL").withColumn("text", text("content"))
    blank = F.regexp_replace("text", r"(?U)\s+", "") == ""
    return code.select("path", "language", F.sha2("content", 256).alias("sha256"), F.regexp_extract("path", r"([^/]+)$", 1).alias("title"), F.when(blank, 0).otherwise(1).alias("n_pages"), F.when(~blank, F.col("text")).alias("text"))


def pdf_files(files: DataFrame, extract: Callable[[bytes], list[dict]], schema: str) -> DataFrame:
    """PDF files through an extractor of blocks (bytes -> rows of ``schema``), a file at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                rows = extract(bytes(content))
                if rows:
                    yield pd.DataFrame(rows).assign(path=path)

    return files.where("suffix = '.pdf'").select("path", "content").mapInPandas(run, schema + ", path string")


def segments_of(spark: SparkSession, root: str, domain: str, extract: Callable[[bytes], list[dict]] | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, segments) of all files of a domain: source files as one code segment, PDF files through ``extract``.

    Files go by their suffix, in any letter case. ``extract`` gives a file's blocks as rows of ``BLOCKS``, with the file's title in
    ``title`` if it has one; without it PDF files have documents but no segments. A title is that of the file, else its name
    without the suffix.
    """
    from ..operators.segments import document_segments

    found = scan(spark, root, domain)
    key = F.xxhash64("path").alias("document_id")
    code = source_files(found)
    docs = code.select(key, "path", "title", "sha256", "n_pages")
    segs = code.where("text IS NOT NULL").select(key, F.lit(1).alias("page"), F.lit(0).alias("seg_ord"), "text", F.lit("code").alias("kind"), "language", F.lit(None).cast("string").alias("image_path"), F.lit(False).alias("is_scan"))
    pdf = found.where("suffix = '.pdf'")
    stem = F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)
    named = pdf.select(key, "path", stem.alias("stem"), F.sha2("content", 256).alias("sha256"))
    if extract is None:
        return docs.unionByName(named.select("document_id", "path", F.col("stem").alias("title"), "sha256", F.lit(0).alias("n_pages"))), segs
    blocks = pdf_files(found, extract, BLOCKS + ", title string").withColumn("document_id", F.xxhash64("path"))
    told = blocks.groupBy("document_id").agg(F.max("title").alias("told"), F.max("page").alias("n_pages"))
    title = F.when(F.trim("told") != "", F.col("told")).otherwise(F.col("stem"))
    docs = docs.unionByName(named.join(told, "document_id", "left").select("document_id", "path", title.alias("title"), "sha256", F.coalesce("n_pages", F.lit(0)).alias("n_pages")))
    return docs, segs.unionByName(document_segments(blocks.withColumn("doc_id", F.col("document_id"))).withColumnRenamed("doc_id", "document_id"))


def load_any(spark: SparkSession, path: str, tables: tuple[str, ...] = ()) -> DataFrame:
    """Parquet files of a folder if there are any, else JSON lines, else a catalog table, else a data set on disk.

    A data set on disk is a folder of splits, each a folder of Parquet files; ``train`` is taken, else the first by name.
    """
    for kind, pattern in (("parquet", "*.parquet"), ("json", "*.jsonl")):
        try:
            return spark.read.format(kind).load(f"{path.rstrip('/')}/{pattern}")
        except AnalysisException as e:
            if not any(x in str(e) for x in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")):
                raise
    for name in tables:
        if spark.catalog.tableExists(name):
            return spark.table(name)
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path).select("path")
        splits = files.select(F.element_at(F.split("path", "/"), -2).alias("split")).distinct()
        first = splits.orderBy(F.col("split") != "train", "split").first()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        first = None
    if first is None:
        raise FileNotFoundError(path)
    return spark.read.parquet(f"{path.rstrip('/')}/{first['split']}")


def load_or_build(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """What is stored at ``path``; built and stored there first if nothing is."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if not any(x in str(e) for x in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")):
            raise
    build().write.parquet(path)
    return spark.read.parquet(path)
