"""Token counts from flat, unindexed token files by a separator scan.

A file is nothing but ids of fixed width, with an end-of-document id after every document. Files are cut into
blocks; a block's separators are found by one vectorised comparison, without knowing where documents begin. A
prefix scan over the blocks' numbers of tokens and separators then gives each document's ordinal and length,
also where it spans blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .arrays import tidy
from .bpe import BLOCK, Encoder, blocks, default_path, merges_at
from .common import new_path, stage

#: Bytes of an id, the id that ends documents, bytes of a block.
WIDTH, END, BLOCK_BYTES = 2, 50256, 1 << 22
#: Documents are written by length, so that a file stays small whatever their lengths: longest text in characters, and
#: documents of a file. A text has at most one id a byte.
CLASSES = ((1 << 14, 8192), (1 << 20, 128), (None, 1))


def of_class(docs: DataFrame, text_col: str, k: int) -> DataFrame:
    """The rows whose texts have the lengths of a class."""
    n = F.coalesce(F.length(docs[text_col].cast("string")), F.lit(0))
    low, high = CLASSES[k - 1][0] if k else -1, CLASSES[k][0]
    return docs.where((n > low) if high is None else (n > low) & (n <= high))


def write_flat(docs: DataFrame, path: str, text_col: str = "text", tokenizer: str | None = None, width: int = WIDTH, end: int = END) -> None:
    """Encode every row's text (null: empty) and write the ids, each document's followed by ``end``, into a folder a class of lengths.

    Strings of special tokens in a text are ordinary text here, so that only real ends are separators. The files come
    from Spark's text sink, with the end's bytes for the line separator; any store that Spark writes will do. An empty
    table gives files without documents. Ids that do not fit into ``width`` bytes are an error.
    """
    tokenizer = tokenizer or default_path()
    if max(merges_at(tokenizer).bytes_of) >= 256**width or end >= 256**width:
        raise ValueError(f"ids need more than {width} bytes")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(merges_at(tokenizer))
        encoder.special = None
        for batch in batches:
            for texts in blocks((x.as_py() for x in batch.column(0)), BLOCK):
                for group in ([texts[:-1], texts[-1:]] if len(texts[-1]) > BLOCK else [texts]):
                    if len(group) == 1:
                        rows = [b"".join(x.astype(f"<u{width}").tobytes() for x in encoder.stream(group[0]))]
                    else:
                        flat, ends = encoder.ids(group)
                        raw = flat.astype(f"<u{width}").tobytes()
                        at = [0, *(int(e) * width for e in ends)]
                        rows = [raw[a:b] for a, b in zip(at, at[1:])]
                    yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], names=["ids"])

    separator = end.to_bytes(width, "little").decode("latin-1")
    for k, (_, files) in enumerate(CLASSES):
        rows = of_class(docs, text_col, k).select(F.col(text_col).cast("string")).mapInArrow(run, "ids binary").select(F.col("ids").cast("string").alias("value"))
        rows.write.option("encoding", "ISO-8859-1").option("lineSep", separator).option("maxRecordsPerFile", files).text(f"{path}/class={k}")


def count_tokens(spark: SparkSession, path: str, width: int = WIDTH, end: int = END, block: int = BLOCK_BYTES) -> DataFrame:
    """path, ordinal, start, n_tokens of every document in the token files of a folder.

    Ends next to each other give empty documents; ids after the last end are a last document. Bytes that make no whole
    id at a file's end are ignored; empty files have no documents, and a folder of such files gives no rows. Folders below
    are read too. A file must fit into a task's memory, about three times.
    """
    block = block // width * width

    @tidy
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                data = batch.column(2)[i].as_buffer()
                ids = np.frombuffer(data, f"<u{width}", count=data.size // width)
                seps = np.flatnonzero(ids == end)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[i : i + 1], batch.column(1)[i : i + 1], pa.array([len(ids)], pa.int64()), pa.array([seps], pa.list_(pa.int64()))], names=["path", "block", "tokens", "seps"]
                )

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).where("length > 0")
    n = F.ceil(F.col("length") / block)
    cut = files.select("path", "content", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("block"))
    cut = cut.select("path", "block", F.expr(f"substring(content, cast(block * {block} + 1 as int), {block})").alias("bytes"))
    found = stage(cut.mapInArrow(scan, "path string, block long, tokens long, seps array<long>"), "seps")
    # the prefix scan: what stands before each block of its file
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy("path")
    zero = F.lit(0).cast("long")
    own_last = F.when(F.size("seps") > 0, F.element_at("seps", -1))
    placed = found.withColumn("base", F.coalesce(F.sum("tokens").over(before), zero)).withColumn("docs", F.coalesce(F.sum(F.size("seps").cast("long")).over(before), zero))
    placed = placed.withColumn("last", F.coalesce(F.max(F.col("base") + own_last).over(before), F.lit(-1).cast("long"))).withColumn("final", F.col("block") == F.max("block").over(every))
    ends = F.transform("seps", lambda s: s + F.col("base"))
    total = F.col("base") + F.col("tokens")
    ends = F.when(F.col("final") & (F.coalesce(F.element_at(ends, F.when(F.size("seps") > 0, F.lit(-1))), F.col("last")) < total - 1), F.concat(ends, F.array(total))).otherwise(ends)
    listed = placed.select("path", "docs", "last", ends.alias("ends")).where(F.size("ends") > 0)
    starts = F.concat(F.array(F.col("last") + 1), F.transform(F.slice("ends", F.lit(1), F.size("ends") - 1), lambda e: e + 1))
    pairs = F.arrays_zip(starts.alias("start"), F.col("ends").alias("end"))
    out = listed.select("path", "docs", F.posexplode(pairs).alias("k", "x"))
    return out.select("path", (F.col("docs") + F.col("k")).alias("ordinal"), F.col("x.start").alias("start"), (F.col("x.end") - F.col("x.start")).alias("n_tokens"))


def op10_token_counts(spark, sf_dir: str) -> DataFrame:
    """doc_id and n_tokens of all documents, counted in flat files that are written first.

    The files hold no ids of documents. A partition's files hold its documents of a class in the order of the scan, so that
    scanning the same rows again, with the same partitions, tells which document is which; a document on one
    side only is an error.
    """
    from .common import table

    docs = table(spark, sf_dir, "documents")
    path = new_path(spark, "tokens")
    write_flat(docs.select("text"), path)
    counts = count_tokens(spark, path)
    name = F.element_at(F.split("path", "/"), -1)
    files = F.element_at(F.array(*[F.lit(n) for _, n in CLASSES]), F.col("class") + 1)
    counts = counts.withColumn("part", F.regexp_extract(name, r"^part-(\d+)", 1).cast("int")).withColumn("file", F.regexp_extract(name, r"-c(\d+)\.\w+$", 1).cast("int"))
    counts = counts.withColumn("class", F.regexp_extract("path", r"/class=(\d+)/[^/]*$", 1).cast("int"))
    ids = None
    for k in range(len(CLASSES)):
        pos = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
        mine = of_class(docs.select("doc_id", "text"), "text", k).select("doc_id", F.lit(k).alias("class"), F.spark_partition_id().alias("part"), pos.alias("pos"))
        ids = mine if ids is None else ids.unionByName(mine)
    a, b = ids.alias("a"), counts.select("class", "part", (F.col("file") * files + F.col("ordinal")).alias("pos"), "n_tokens").alias("b")
    out = a.join(b, ["class", "part", "pos"], "full")
    missing = F.col("n_tokens").isNull() | F.col("a.pos").isNull()
    agree = F.when(missing, F.raise_error(F.lit("token files and documents differ")).cast("boolean")).otherwise(True)
    return out.where(agree).select("doc_id", "n_tokens")
