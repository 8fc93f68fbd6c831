"""The stored tables: upserts, inserts, links between levels, deletes, and the counts that verify them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..staging import stage


def upsert_documents(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row a source_path. What exists keeps id, domain, metadata and created_at, and takes title, n_pages and sha256."""
    one = new.groupBy("source_path").agg(F.max_by(F.struct(*[c for c in new.columns if c != "source_path"]), F.struct("sha256", "title")).alias("n"))
    o = old.alias("o")
    joined = o.join(one, F.col("o.source_path") == one["source_path"], "full")
    there = F.col("o.source_path").isNotNull()
    cols = []
    for c in old.columns:
        if c == "source_path":
            cols.append(F.coalesce(F.col("o.source_path"), one["source_path"]).alias(c))
        elif c in ("title", "n_pages", "sha256"):
            given = T.strip_nul(F.col(f"n.{c}")) if c == "title" else F.col(f"n.{c}")
            cols.append(F.when(one["source_path"].isNotNull(), given).otherwise(F.col(f"o.{c}")).alias(c))
        elif c == "id":
            cols.append(F.coalesce(F.col("o.id"), F.xxhash64(one["source_path"])).alias(c))
        elif c in new.columns:
            cols.append(F.when(there, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c))
        else:
            cols.append(F.col(f"o.{c}").alias(c))
    return joined.select(*cols)


def content_dedup(docs: DataFrame, content: str = "text", keep: str = "doc_id") -> DataFrame:
    """sha256, the smallest id and the number of rows of each content."""
    return docs.groupBy(F.sha2(F.col(content), 256).alias("sha256")).agg(F.min(keep).alias("keep_id"), F.count("*").alias("n_copies"))


def parent_rows(parents: DataFrame, pooled: DataFrame) -> DataFrame:
    """Stored parents: level 0, not searchable, embedded by the mean of their children."""
    rows = parents.join(pooled.withColumnRenamed("parent_chunk_id", "id"), "id")
    none = F.lit(None)
    return rows.withColumns({"level": F.lit(0), "parent_chunk_id": none.cast("long"), "is_searchable": F.lit(False), "parent_ids": F.array().cast("array<long>"), "children_ids": F.array().cast("array<long>")})


def child_rows(children: DataFrame, vectors: DataFrame) -> DataFrame:
    """Stored children: level 0, searchable. A child without a vector, or a vector without a child, is an error."""
    rows = children.alias("c").join(vectors.alias("v"), F.col("c.id") == F.col("v.id"), "full")
    ok = F.col("c.id").isNotNull() & F.col("v.embedding").isNotNull()
    rows = rows.withColumn("ok", F.when(ok, True).otherwise(F.raise_error(F.lit("children and vectors differ")).cast("boolean"))).where("ok")
    return rows.select("c.*", "v.embedding").withColumns({"level": F.lit(0), "is_searchable": F.lit(True), "parent_ids": F.array().cast("array<long>"), "children_ids": F.array().cast("array<long>")})


def link_parents(chunks: DataFrame, nodes: DataFrame) -> DataFrame:
    """``chunks`` with the ids of ``nodes`` (id, children_ids) appended to their parent_ids; repeats stay."""
    edges = nodes.select(F.col("id").alias("parent"), F.explode("children_ids").alias("id"))
    more = edges.groupBy("id").agg(F.array_sort(F.collect_list("parent")).alias("more"))
    rows = chunks.join(more, "id", "left")
    return rows.withColumn("parent_ids", F.concat("parent_ids", F.coalesce("more", F.array().cast("array<long>")))).drop("more").select(*chunks.columns)


def insert_summaries(chunks: DataFrame, nodes: DataFrame) -> DataFrame:
    """``chunks`` with a row for each of ``nodes`` (id, domain, level, cluster_id, children_ids, content, embedding), and the children pointing back.

    Summaries are always searchable text; their token count is that of words between white space. Columns that nodes do not
    have are null.
    """
    count = F.size(F.filter(F.split(F.col("content"), r"\s+"), lambda w: w != ""))
    clean = nodes.withColumn("content", T.strip_nul(F.col("content"))).withColumn("token_count", count)
    given = {"is_searchable": F.lit(True), "content_type": F.lit("text"), "parent_ids": F.array().cast("array<long>"), "children_ids": F.col("children_ids"), "token_count": F.col("token_count")}
    rows = clean.select(*[(given.get(f.name, F.col(f.name)) if f.name in (*given, *clean.columns) else F.lit(None)).cast(f.dataType).alias(f.name) for f in chunks.schema.fields])
    return link_parents(chunks.unionByName(rows), nodes)


def append_missing(old: DataFrame, new: DataFrame, on: str) -> DataFrame:
    """``old`` and those rows of ``new`` whose key it does not have; of new rows with one key the first by their other columns."""
    one = missing(new, old, on).groupBy(on).agg(F.min(F.struct(*[c for c in old.columns if c != on])).alias("r"))
    return old.unionByName(one.select(on, "r.*").select(*old.columns))


def with_documents(chunks: DataFrame, documents: DataFrame, source: str | None = None) -> DataFrame:
    """Chunks with the path and title of their documents; with ``source`` those of documents whose path holds it. In order of chunks."""
    docs = documents.select(F.col("id").alias("document_id"), "source_path", "title")
    docs = docs.where(F.col("source_path").contains(source)) if source else docs
    return chunks.join(docs, "document_id").orderBy("id")


def readiness(chunks: DataFrame, nodes: DataFrame) -> DataFrame:
    """what, n: leaves, leaves without an embedding, nodes without children, and leaves less those that a node holds."""
    leaves = chunks.where("level = 0")
    held = leaves.join(nodes.select(F.explode("children_ids").alias("id")).distinct(), "id", "left_semi")
    one = lambda what, df, n: df.agg(n.cast("long").alias("n")).select(F.lit(what).alias("what"), "n")
    out = one("leaves", leaves, F.count("*")).unionByName(one("unembedded", leaves, F.count_if(F.col("embedding").isNull())))
    out = out.unionByName(one("childless", nodes, F.count_if(F.size("children_ids") == 0)))
    orphans = one("", leaves, F.count("*")).unionByName(one("", held, -F.count("*"))).agg(F.sum("n").alias("n"))
    return out.unionByName(orphans.select(F.lit("orphans").alias("what"), "n"))


def resolve_ids(refs: DataFrame, names: DataFrame) -> DataFrame:
    """``refs`` (ref) with the real id of placeholders (placeholder, real), or as they are."""
    return refs.join(names, refs["ref"] == names["placeholder"], "left").select(*refs.columns, F.coalesce("real", "ref").alias("id"))


def missing(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Rows of ``left`` that ``right`` has no partner for."""
    return left.join(right.select(on), on, "left_anti")


def delete_documents(chunks: DataFrame, gone: DataFrame) -> DataFrame:
    """Chunks without those of the documents ``gone`` (id), nor chunks below them."""
    kept = chunks.join(gone.select(F.col("id").alias("document_id")), "document_id", "left_anti")
    edges = stage(kept.where("parent_chunk_id IS NOT NULL").select("id", "parent_chunk_id"), "edges")
    lost = stage(chunks.join(gone.select(F.col("id").alias("document_id")), "document_id", "left_semi").select("id"), "lost")
    every = None
    while not lost.isEmpty():  # a level of the hierarchy a round, each written once
        below = edges.join(lost.select(F.col("id").alias("parent_chunk_id")), "parent_chunk_id", "left_semi").select("id").distinct()
        lost = stage(below.join(every, "id", "left_anti") if every is not None else below, "lost")
        every = lost if every is None else every.unionByName(lost)
    return (kept.join(every, "id", "left_anti") if every is not None else kept).select(*chunks.columns)


def chunk_stats(chunks: DataFrame, by: list[str], tokens: str = "token_count") -> DataFrame:
    t = F.col(tokens)
    return chunks.groupBy(*by).agg(F.count("*").alias("n"), F.min(t).alias("min_tok"), F.round(F.avg(t)).cast("int").alias("avg_tok"), F.max(t).alias("max_tok"))


def token_histogram(chunks: DataFrame, tokens: str = "token_count", low: float = 0, high: float = 600, bins: int = 12) -> DataFrame:
    bucket = F.width_bucket(F.col(tokens).cast("double"), F.lit(float(low)), F.lit(float(high)), F.lit(bins))
    return chunks.groupBy(bucket.cast("int").alias("bucket")).agg(F.count("*").alias("n"))
