"""A watched folder: files seen before are skipped, new ones are placed in the nearest cluster."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.vector import cosine

FILES = "path string, modificationTime timestamp, length long, content binary"


def watch(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of files: path, sha256, content; of equal contents the first only, across restarts too.

    The set of digests seen is the query's state: 32 bytes a file, without end, as files carry no event time.
    """
    files = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", True).load(folder)
    return files.select("path", F.sha2("content", 256).alias("sha256"), "content").dropDuplicates(["sha256"])


def ingest(stream: DataFrame, target: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Process what has arrived and append it to ``target`` as Parquet, then stop."""

    def batch(df: DataFrame, n: int) -> None:
        # a batch that is tried again writes the same folder
        (transform(df) if transform else df).write.mode("overwrite").parquet(f"{target}/batch={n}")

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(batch).start()


def place(leaves: DataFrame, clusters: DataFrame) -> DataFrame:
    """Each leaf (id, domain, embedding) with the most similar cluster of its domain (cluster_id, domain, centre); leaves of other domains have none.

    Clusters are dealt with their domains to 64 parts of the leaves, so that one domain may have most leaves.
    """
    part = F.pmod(F.xxhash64("id"), F.lit(64))
    many = clusters.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(63).cast("long"))))
    pairs = leaves.withColumn("part", part).join(many, ["domain", "part"]).select("id", "cluster_id", cosine(F.col("embedding"), F.col("centre")).alias("sim"))
    best = pairs.groupBy("id").agg(F.min_by(F.struct("cluster_id", "sim"), F.struct(-F.col("sim"), F.col("cluster_id"))).alias("b"))
    return best.select("id", "b.cluster_id", "b.sim")


def incremental(clusters: DataFrame, embed: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """A transform for ``ingest``: new files become leaves by ``embed`` (id, domain, embedding and others), each with its nearest cluster."""

    def transform(files: DataFrame) -> DataFrame:
        leaves = embed(files)
        return leaves.join(place(leaves.select("id", "domain", "embedding"), clusters), "id", "left")

    return transform


def to_summarise(edges: DataFrame, placed: DataFrame, most: int) -> DataFrame:
    """Clusters with more than ``most`` members after the leaves ``placed`` (id, cluster_id) have joined ``edges`` (id, cluster_id)."""
    return stale(edges.select("cluster_id", "id").unionByName(placed.where("cluster_id IS NOT NULL").select("cluster_id", "id")).distinct(), most)


def stale(edges: DataFrame, most: int) -> DataFrame:
    """Clusters with more than ``most`` members, to be summarised again."""
    return edges.groupBy("cluster_id").agg(F.count("*").alias("n")).where(F.col("n") > most)
