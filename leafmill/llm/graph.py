"""Connected components of a distributed list of links."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import tidy
from .common import stage, unstage

#: Links that a task contracts at a time.
PART = 200_000


def contract(links: DataFrame) -> DataFrame:
    """u, v: links (a, b) of each task replaced by links of every node to the smallest that it reaches in it."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: dict[int, int] = {}

        def stars() -> pa.RecordBatch:
            pairs = [(x, find(x)) for x in root]
            pairs = [p for p in pairs if p[0] != p[1]]
            root.clear()
            return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["u", "v"])

        def find(x: int) -> int:
            while (up := root[x]) != x:
                root[x] = x = root[up]
            return x

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                root.setdefault(a, a)
                root.setdefault(b, b)
                a, b = find(a), find(b)
                if a != b:
                    root[max(a, b)] = min(a, b)
            if len(root) > 2 * PART:  # memory stays bounded in tasks of any size
                yield stars()
        yield stars()

    return links.toDF("a", "b").where("a IS NOT NULL AND b IS NOT NULL").mapInArrow(run, "u long, v long")


def components(links: DataFrame) -> DataFrame:
    """node, root: each node of ``links`` (a, b: long; any order, repeats allowed) with the smallest node it reaches.

    Every task contracts its own links to stars; those go together in parts of about ``PART`` links, and are
    contracted again. If they make one part, that is the result. If not, alternating large and small stars
    follow: a round joins each node's neighbours to the smallest of them, and rounds end when nothing
    changes, after about the logarithm of the longest path. A hub's links are combined before the shuffle
    for its minimum, and AQE may split the join that follows. Each step is written to the shared folder.
    """
    own = stage(contract(links), "links")
    parts = max(1, -(-own.count() // PART))
    edges = stage(contract(own.coalesce(parts)), "links")
    unstage(own)
    seen = None
    while parts > 1:
        mark = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if mark["n"] == 0 or mark == seen:
            break
        seen = mark
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select("v", "m").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        after = stage(small.distinct(), "stars")
        unstage(edges)
        edges = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
