"""python -m leafmill ingest|query: the engine from a shell."""

from __future__ import annotations

import argparse
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import DEFAULT, DOMAINS
from .functions import text as T
from .functions.vector import hashed_embedding, mean_pool
from .operators import chunk, search, store
from .operators.tree import build_tree
from .sources import files
from .staging import stage


def ingest(spark: SparkSession, root: str, domains: list[str], out: str, dim: int, extract: Callable[[bytes], list[dict]] | None = None, tree: bool = True) -> None:
    """Files under root/<domain> to stored documents, parents, children and summaries; a domain's partition is replaced.

    PDF files need ``extract`` (bytes to blocks). The tree's leaves are the children.
    """
    for domain in domains:
        docs, segs = files.segments_of(spark, root, domain, extract)
        docs, segs = stage(docs, "documents"), stage(segs, "segments")
        parents, kids = chunk.chunk_segments(segs)
        parents, kids = stage(parents, "parents"), stage(kids.withColumn("embedding", hashed_embedding(T.tokens(F.col("content")), dim)), "children")
        pooled = mean_pool(kids.select("parent_chunk_id", "embedding"), ["parent_chunk_id"], out="embedding").withColumn("embedding", F.col("embedding").cast("array<float>"))
        cols = ["id", "document_id", "level", "parent_chunk_id", "is_searchable", "parent_ids", "children_ids", "content", "content_type", "language", "token_count", "page_start", "page_end", "embedding"]
        pages = {"page_start": F.col("page"), "page_end": F.col("page")}
        rows = store.parent_rows(parents, pooled).withColumns(pages).select(*cols).unionByName(store.child_rows(kids.drop("embedding"), kids.select("id", "embedding")).withColumns(pages).select(*cols))
        if tree and (leaves := kids.select("id", "content", "embedding")).count() > DEFAULT.min_nodes:
            rows = store.insert_summaries(rows, build_tree(leaves))
        rows.write.mode("overwrite").parquet(f"{out}/chunks/domain={domain}")
        docs.join(parents.select("document_id").distinct(), "document_id", "left_semi").select("document_id", "path", "title", "sha256", "n_pages").write.mode("overwrite").parquet(f"{out}/documents/domain={domain}")


def ask(spark: SparkSession, store_dir: str, r: search.Request, dim: int) -> DataFrame:
    """parent_id, content, score: the parents that answer, best first."""
    chunks = spark.read.parquet(f"{store_dir}/chunks")
    docs = spark.read.parquet(f"{store_dir}/documents").select("document_id", F.col("path").alias("source_path"))
    chunks = chunks.join(docs, "document_id", "left")
    edges = chunks.where(F.size("children_ids") > 0).select(F.col("id").alias("parent_id"), F.explode("children_ids").alias("child_id"))
    vector = spark.range(1).select(hashed_embedding(T.tokens(F.lit(r.query)), dim).alias("v")).first()["v"]
    hits = search.search(chunks, edges, r, vector)
    return hits.join(chunks.select(F.col("id").alias("parent_id"), "content", "source_path"), "parent_id").orderBy(F.col("score").desc(), "parent_id")


def shown(rows: DataFrame, as_json: bool) -> list[str]:
    """A line for each row, as JSON or for people: the score and the text, shortened."""
    if as_json:
        return [json.dumps(x.asDict(), default=str) for x in rows.collect()]  # at most k rows
    return [f"{x['score']:.3f}  {x['text']}" for x in rows.select("score", T.shortened(F.coalesce("content", F.lit("")), 160).alias("text")).collect()]


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="leafmill")
    sub = p.add_subparsers(dest="what", required=True)
    i = sub.add_parser("ingest")
    i.add_argument("--root", required=True)
    i.add_argument("--out", required=True)
    i.add_argument("--domains", nargs="+", default=list(DOMAINS))
    i.add_argument("--no-tree", action="store_true")
    q = sub.add_parser("query")
    q.add_argument("text")
    q.add_argument("--store", required=True)
    q.add_argument("--domain")
    q.add_argument("--source")
    q.add_argument("--mode", choices=search.MODES, default="collapsed")
    q.add_argument("--fusion", choices=search.FUSIONS, default="dense")
    q.add_argument("--k", type=int, default=5)
    q.add_argument("--beam", type=int, default=DEFAULT.beam)
    q.add_argument("--fanout", type=int, default=DEFAULT.fanout)
    q.add_argument("--alpha", type=float, default=DEFAULT.alpha)
    q.add_argument("--json", action="store_true")
    for x in (i, q):
        x.add_argument("--dim", type=int, default=DEFAULT.dim)
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("leafmill").getOrCreate()
    if a.what == "ingest":
        ingest(spark, a.root, a.domains, a.out, a.dim, tree=not a.no_tree)
        return
    r = search.Request(a.text, a.mode, a.fusion, a.domain, a.source, a.k, a.beam, a.fanout, a.alpha)
    for line in shown(ask(spark, a.store, r, a.dim), a.json):
        print(line)


if __name__ == "__main__":
    main()
