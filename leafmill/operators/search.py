"""Search in all its modes: where candidates come from, how they are ranked, and the parents that answer."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, DOMAINS
from ..functions.vector import cosine
from . import lexical, retrieve

MODES, FUSIONS = ("top_down", "collapsed"), ("dense", "lexical", "hybrid")


@dataclass(frozen=True)
class Request:
    """What is asked; values out of range are an error.

    ``top_down`` descends from the top level through the best ``beam`` nodes of each; ``collapsed`` ranks all leaves by their own similarity
    and ``alpha`` times that of their best ancestor. Either gives ``fanout`` candidates, which ``fusion`` ranks.
    """

    query: str
    mode: str = "top_down"
    fusion: str = "dense"
    domain: str | None = None
    source: str | None = None
    k: int = DEFAULT.top_k_parents
    beam: int = DEFAULT.beam
    fanout: int = DEFAULT.fanout
    alpha: float = DEFAULT.alpha
    rrf_k: int = DEFAULT.rrf_k

    def __post_init__(self) -> None:
        for name, value, low, high in (("query length", len(self.query), 1, 2000), ("k", self.k, 1, 50), ("beam", self.beam, 1, 32), ("fanout", self.fanout, 1, 500), ("alpha", self.alpha, 0, 2), ("rrf_k", self.rrf_k, 1, 1000)):
            if not low <= value <= high:
                raise ValueError(f"{name} must be from {low} to {high}, not {value}")
        for name, value, known in (("mode", self.mode, MODES), ("fusion", self.fusion, FUSIONS)):
            if value not in known:
                raise ValueError(f"{name} must be one of {', '.join(known)}, not {value!r}")
        if self.domain is not None and self.domain not in DOMAINS:
            raise ValueError(f"unknown domain {self.domain!r}")


def chosen(chunks: DataFrame, r: Request) -> DataFrame:
    """The rows of the asked domain and source; nodes above the leaves have no source."""
    rows = chunks.where(F.col("domain") == r.domain) if r.domain is not None else chunks
    return rows.where((F.col("level") > 0) | F.col("source_path").contains(r.source)) if r.source is not None else rows


def candidates(chunks: DataFrame, edges: DataFrame, r: Request, vector) -> DataFrame:
    """id, score of the ``fanout`` best leaves; chunks: id, level, embedding, edges: parent_id, child_id."""
    rows = chosen(chunks, r).where("is_searchable AND embedding IS NOT NULL")
    if r.mode == "top_down":
        top = rows.agg(F.max("level")).first()[0]
        found = retrieve.descend(rows.select("id", "level", "embedding"), edges, vector, top, r.beam).select("id", F.col("sim").alias("score")) if top else _leaves(rows, vector)
    else:
        sims = rows.select("id", "level", cosine(F.col("embedding"), retrieve.query_column(vector)).alias("sim"))
        top = sims.where("level > 0").select(F.col("id").alias("ancestor"), "sim")
        above = retrieve.ancestors(edges, DEFAULT.max_levels).join(top, "ancestor").select("leaf", "sim")
        found = retrieve.collapsed(sims.where("level = 0").select(F.col("id").alias("leaf"), "sim"), above, r.alpha).select(F.col("leaf").alias("id"), "score")
    return found.orderBy(F.col("score").desc(), "id").limit(r.fanout)


def _leaves(rows: DataFrame, vector) -> DataFrame:
    return rows.where("level = 0").select("id", cosine(F.col("embedding"), retrieve.query_column(vector)).alias("score"))


def ranked(found: DataFrame, chunks: DataFrame, r: Request) -> DataFrame:
    """id, score of candidates by the asked ranking; hybrid joins the best ``4 * k`` of both by their ranks."""
    if r.fusion == "dense":
        return found
    words = "".join(c.lower() if c.isascii() and c.isalnum() else " " for c in r.query).split()
    texts = chunks.join(F.broadcast(found.select("id")), "id").select("id", "content")  # at most ``fanout``
    lex = lexical.tf_idf(texts, words, "id", "content")
    if r.fusion == "lexical":
        return lex
    order = Window.orderBy(F.col("score").desc(), "id")  # of candidates
    lists = [x.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= 4 * r.k).select("id", "rank") for x in (found, lex)]
    return retrieve.rrf(lists[0].unionByName(lists[1]), r.rrf_k)


def search(chunks: DataFrame, edges: DataFrame, r: Request, vector) -> DataFrame:
    """parent_id, score, matched_child_id, n_children_hit: each parent once, by its best child; leaves without a parent are their own."""
    hits = ranked(candidates(chunks, edges, r, vector), chunks, r)
    rows = chunks.select("id", F.coalesce("parent_chunk_id", "id").alias("parent_id")).join(F.broadcast(hits), "id")
    best = rows.groupBy("parent_id").agg(F.max("score").alias("score"), F.min_by("id", F.struct(-F.col("score"), F.col("id"))).alias("matched_child_id"), F.count("*").alias("n_children_hit"))
    return best.orderBy(F.col("score").desc(), "parent_id").limit(r.k)


def tree_path(edges: DataFrame, hits: DataFrame) -> DataFrame:
    """matched_child_id, path: the nodes above each hit."""
    up = retrieve.ancestors(edges, DEFAULT.max_levels).join(F.broadcast(hits.select(F.col("matched_child_id").alias("leaf"))), "leaf")
    return up.groupBy(F.col("leaf").alias("matched_child_id")).agg(F.array_sort(F.collect_set("ancestor")).alias("path"))


def answer(chunks: DataFrame, edges: DataFrame, r: Request, vector, generate: Callable[[str, str], str], worker: str = "base") -> dict:
    """answer, sources, tree_path, fusion_used, worker_used, latency_ms; ``generate`` makes the answer from the question and its context."""
    began = time.perf_counter()
    hits = search(chunks, edges, r, vector)
    full = hits.join(chunks.select(F.col("id").alias("parent_id"), "content", "content_type", "language", "page_start", "page_end"), "parent_id")
    context = retrieve.llm_context(full).first()["context"]
    path = tree_path(edges, hits).collect()  # at most k
    sources = [x["parent_id"] for x in hits.select("parent_id", "score").orderBy(F.col("score").desc(), "parent_id").collect()]  # at most k
    said = generate(r.query, context or "")
    return {"answer": said, "sources": sources, "tree_path": {x["matched_child_id"]: x["path"] for x in path}, "fusion_used": r.fusion, "worker_used": worker, "latency_ms": (time.perf_counter() - began) * 1000}
