"""Retrieval: dense top-k over children, parents once each, tree search, fusion, routing and the answer cache."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..config import DEFAULT, Config
from ..functions.vector import cosine, literal, nearest_rows, rows_of


def query_column(query) -> Column:
    """A query vector as a column: a column as it is, numbers as literals."""
    return query if isinstance(query, Column) else literal(query)


def searchable_children(chunks: DataFrame, domain: str | None = None) -> DataFrame:
    rows = chunks.where("is_searchable AND level = 0 AND parent_chunk_id IS NOT NULL")
    return rows.where(F.col("domain") == domain) if domain is not None else rows


def dense_topk(rows: DataFrame, query, k: int, id_col: str = "id", vec: str = "embedding") -> DataFrame:
    """The k nearest rows by cosine distance, exact; ties by id."""
    return rows.withColumn("dist", 1 - cosine(F.col(vec), query_column(query))).drop(vec).orderBy("dist", id_col).limit(k)


def to_parents(hits: DataFrame, child: str = "id", parent: str = "parent_chunk_id") -> DataFrame:
    """Hits by parent: the best distance, the child that has it and the number of hits."""
    return hits.groupBy(F.col(parent).alias("parent_id")).agg(F.min("dist").alias("best_dist"), F.count("*").alias("n_children_hit"), F.min_by(child, F.struct("dist", child)).alias("matched_child_id"))


def retrieve(chunks: DataFrame, query, domain: str | None = None, cfg: Config = DEFAULT) -> DataFrame:
    """The best parents of the nearest children: parents are grouped after the children's cut."""
    hits = dense_topk(searchable_children(chunks, domain).select("id", "parent_chunk_id", "embedding"), query, cfg.top_k_children)
    ranked = to_parents(hits)  # as many rows as children were cut to, at most
    cols = ["content", "content_type", "language", "page_start", "page_end"]
    rows = chunks.select(F.col("id").alias("parent_id"), *cols).join(F.broadcast(ranked), "parent_id")
    return rows.withColumn("score", 1 - F.col("best_dist")).orderBy("best_dist", "parent_id").limit(cfg.top_k_parents)


def llm_context(passages: DataFrame) -> DataFrame:
    """One row: passages by falling score, each under its number, page and score; code in fences."""
    order = Window.orderBy(F.col("score").desc(), "parent_id")  # a few rows
    code = F.concat(F.lit("```"), F.coalesce("language", F.lit("")), F.lit("\n"), F.col("content"), F.lit("\n```"))
    head = F.format_string("[%d] (p.%d, score=%.3f)\n", F.row_number().over(order), "page_start", F.col("score").cast("double"))
    body = F.when(F.col("content_type") == "code", code).otherwise(F.col("content"))
    rows = passages.select(F.row_number().over(order).alias("n"), F.concat(head, body).alias("part"))
    return rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "part"))), lambda x: x["part"]), "\n\n---\n\n").alias("context"))


def descend(nodes: DataFrame, edges: DataFrame, query, top: int, beam: int = 6, id_col: str = "id") -> DataFrame:
    """Leaves under the best ``beam`` nodes of each level, from ``top`` down; all children of the last frontier.

    nodes: id, level, embedding. edges: parent_id, child_id. One step a level, each with a frontier of at most ``beam``.
    """
    scored = nodes.select(F.col(id_col).alias("id"), "level", cosine(F.col("embedding"), query_column(query)).alias("sim"))
    frontier = scored.where(F.col("level") == top).orderBy(F.col("sim").desc(), "id").limit(beam)
    for level in range(top - 1, -1, -1):
        below = edges.join(F.broadcast(frontier.select(F.col("id").alias("parent_id"))), "parent_id").select(F.col("child_id").alias("id")).distinct()
        frontier = scored.where(F.col("level") == level).join(below, "id")
        if level:
            frontier = frontier.orderBy(F.col("sim").desc(), "id").limit(beam)
    return frontier.select("id", "sim")


def ancestors(edges: DataFrame, levels: int) -> DataFrame:
    """leaf, ancestor over at most ``levels`` steps, each pair once."""
    up = edges.select(F.col("child_id").alias("leaf"), F.col("parent_id").alias("ancestor"))
    out, last = up, up
    for _ in range(levels - 1):
        last = last.join(edges, F.col("ancestor") == F.col("child_id")).select("leaf", F.col("parent_id").alias("ancestor"))
        out = out.unionByName(last)
    return out.distinct()


def collapsed(leaves: DataFrame, above: DataFrame, alpha: float = 0.3) -> DataFrame:
    """leaf, score: its similarity and ``alpha`` times the best similarity among its ancestors (leaf, sim)."""
    best = above.groupBy("leaf").agg(F.max("sim").alias("best"))
    return leaves.join(best, "leaf", "left").select("leaf", (F.col("sim") + F.lit(alpha) * F.coalesce("best", F.lit(0.0))).alias("score"))


def rrf(lists: DataFrame, k: int = 60) -> DataFrame:
    """id, score from ranked lists (id, rank)."""
    return lists.groupBy("id").agg(F.sum(1.0 / (F.lit(k) + F.col("rank"))).alias("score"))


def similarities(queries: DataFrame, nodes: DataFrame, key: str, on: list[str] | None = None, blocks: int = 64) -> DataFrame:
    """query_id, ``key``, sim of all pairs of a query with a node, or of those equal ``on`` columns.

    For stated queries against tree roots or cluster centres: nodes are dealt to blocks, and each block
    meets all queries, so that no task holds more of the nodes than a block.
    """
    q = queries.select("query_id", F.col("embedding").alias("q"), *(on or []), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    n = nodes.select(key, F.col("embedding").alias("e"), *(on or []), F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("block"))
    pairs = q.join(n, [*(on or []), "block"])
    return pairs.select("query_id", key, cosine(F.col("q"), F.col("e")).alias("sim"))


def nearest(queries: DataFrame, nodes: DataFrame, key: str, least: float = -1.0, apart: bool = False, blocks: int = 32, block_numbers: int = 2_000_000) -> DataFrame:
    """query_id, ``key``, sim of each query's most similar node, if that is at least ``least``; the smallest key of ties.

    With ``apart`` a query does not meet nodes of its own id. Vectors that are null, zero or hold null or non-finite components
    meet nothing, nor do those of different lengths. Every query meets every node: both are dealt to blocks of at most
    ``block_numbers`` numbers (queries an eighth), a task multiplies a block of either, and the best of all blocks is taken.
    """
    whole = lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf"))  # noqa: E731  # NaN is above infinity
    sound = F.forall("embedding", whole) & (F.size("embedding") > 0)
    q = queries.where(F.col("query_id").isNotNull() & sound).select("query_id", F.col("embedding").alias("e"), F.size("embedding").alias("dim"))
    n = nodes.where(F.col(key).isNotNull() & sound).select(key, F.col("embedding").alias("e"), F.size("embedding").alias("dim"))
    numbers = [df.agg(F.coalesce(F.sum("dim"), F.lit(0))).first()[0] for df in (q, n)]
    n_q, n_n = 1 + numbers[0] * 8 // block_numbers, max(blocks, 1 + numbers[1] // block_numbers)
    part = lambda c, k: F.pmod(F.xxhash64(c), F.lit(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    q = q.select("*", part("query_id", n_q).alias("qb")).select("*", every(n_n).alias("nb"))
    n = n.select("*", part(key, n_n).alias("nb")).select("*", every(n_q).alias("qb"))
    out = StructType([StructField("query_id", q.schema["query_id"].dataType), StructField(key, n.schema[key].dataType), StructField("sim", DoubleType())])

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        types = [left["query_id"].type, right[key].type, pa.float64()]
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], t) for t in types], names=out.names)
        ids, keys = (c.to_numpy() for c in (left["query_id"], right[key]))
        at, found, sims = nearest_rows(ids, rows_of(left["e"]), keys, rows_of(right["e"]), least, apart)
        return pa.table([pa.array(x, t) for x, t in zip((ids[at], found, sims), types)], names=out.names)

    on = ["qb", "nb", "dim"]
    met = q.groupBy(*on).cogroup(n.groupBy(*on)).applyInArrow(meet, out)
    best = met.groupBy("query_id").agg(F.min_by(F.struct(key, "sim"), F.struct(-F.col("sim"), F.col(key))).alias("b"))
    return best.select("query_id", f"b.{key}", "b.sim")


def route(queries: DataFrame, roots: DataFrame, margin: float = 0.0) -> DataFrame:
    """query_id, domain, sim, lead: each query's domain by its nearest root; null, for all, where its lead is under ``margin``."""
    by_domain = similarities(queries, roots, "domain").groupBy("query_id", "domain").agg(F.max("sim").alias("sim"))
    order = Window.partitionBy("query_id").orderBy(F.col("sim").desc(), "domain")
    ranked = by_domain.withColumn("lead", F.col("sim") - F.lead("sim").over(order)).withColumn("n", F.row_number().over(order)).where("n = 1")
    sure = F.col("lead").isNull() | (F.col("lead") >= margin)
    return ranked.select("query_id", F.when(sure, F.col("domain")).alias("domain"), "sim", "lead")


def cache_hits(queries: DataFrame, cache: DataFrame, least: float = 0.95) -> DataFrame:
    """query_id, cached_id, sim where a cached query is similar enough."""
    return nearest(queries, cache, "cached_id", least)
