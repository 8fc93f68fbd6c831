"""The summary tree: soft clusters of nodes by Gaussian mixtures, summarised level by level."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.clustering import GaussianMixture
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions import text as T
from ..functions.vector import hashed_embedding, mean_pool
from ..staging import stage


def reduced(df: DataFrame, n: int, cfg: Config = DEFAULT) -> tuple[DataFrame, int]:
    """``df`` (id, embedding) with features of few dimensions; as they are if the nodes are few.

    Principal components stand in for a manifold projection, whose geometry differs.
    """
    vec = df.withColumn("full", array_to_vector(F.col("embedding").cast("array<double>")))
    dim = len(df.select("embedding").first()["embedding"])
    k = min(cfg.reduced_dim, n - 2, dim)
    if n <= cfg.reduced_dim + 1 or k < 1:
        return vec.withColumnRenamed("full", "features"), dim
    return PCA(k=k, inputCol="full", outputCol="features").fit(vec).transform(vec).drop("full"), k


def bic(log_likelihood: float, k: int, d: int, n: int) -> float:
    return -2 * log_likelihood + ((k - 1) + k * d + k * d * (d + 1) / 2) * math.log(n)


def best_mixture(df: DataFrame, n: int, d: int, ks: list[int], seed: int, tries: int = 3, refine: bool = False):
    """The mixture of least BIC among ``ks``; the first of ties. None for a single cluster.

    With ``refine``, sizes half way to the best one's tried neighbours follow until both stand next to it.
    More components cannot fit worse, so a likelihood that falls shows a bad start; then other seeds are tried.
    """
    tried: dict[int, tuple] = {}

    def fit(k: int) -> None:
        if k < 2:
            # one Gaussian in closed form
            _, logdet = np.linalg.slogdet(_covariance(df) + 1e-4 * np.eye(d))
            likelihood, model = -0.5 * n * (d * math.log(2 * math.pi) + logdet + d), None
        else:
            model, likelihood = None, -math.inf
            reached = max((x[2] for j, x in tried.items() if j < k), default=-math.inf)
            for t in range(tries):
                fitted = GaussianMixture(k=k, seed=seed + t, featuresCol="features", probabilityCol="probability").fit(df)
                if fitted.summary.logLikelihood > likelihood:
                    model, likelihood = fitted, fitted.summary.logLikelihood
                if likelihood > reached:
                    break
        tried[k] = (bic(likelihood, k, d, n), model, likelihood)

    for k in ks:
        fit(k)
    while True:
        best = min(tried, key=lambda k: (tried[k][0], k))
        below, above = max((k for k in tried if k < best), default=best), min((k for k in tried if k > best), default=best)
        more = [k for k in {(below + best) // 2, (best + above) // 2} if k not in tried] if refine else []
        if not more:
            return tried[best][1]
        for k in sorted(more):
            fit(k)


def _covariance(df: DataFrame) -> np.ndarray:
    """Sums of products of centred features, pair by pair of positions; d * (d + 1) / 2 numbers come to the driver."""
    d = len(df.select("features").first()["features"])
    pairs = F.explode(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(d - 1)), lambda i: F.transform(F.sequence(i, F.lit(d - 1)), lambda j: F.struct(i.alias("i"), j.alias("j"))))))
    at = lambda k: F.element_at("f", F.col(f"p.{k}") + 1)
    each = df.select(vector_to_array("features").alias("f")).select("f", pairs.alias("p")).groupBy("p.i", "p.j").agg(F.covar_samp(at("i"), at("j")).alias("c"))
    out = np.zeros((d, d))
    for r in each.collect():
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["c"]
    return out


def soft_clusters(df: DataFrame, cfg: Config = DEFAULT, ks: list[int] | None = None) -> DataFrame:
    """id, cluster_id: every cluster that a node belongs to with at least the threshold, else its likeliest.

    Without ``ks`` the number of clusters is sought among all up to the limit, first on a coarse grid that holds the
    limit, then around its best. That is the least BIC of all where BIC has one valley.
    """
    n = df.count()
    top = max(min(cfg.max_clusters, n - 1), 1)
    refine = not ks
    ks = [k for k in ks if k <= top] if ks else sorted({k for k in (1, 2, 3, 5, 8, 12, 20, 30, 50) if k < top} | {top})
    model = None
    if n >= 3:
        rows, d = reduced(df, n, cfg)
        rows = stage(rows, "reduced")
        model = best_mixture(rows, n, d, ks, cfg.seed, refine=refine)
    if model is None:
        return df.select("id", F.lit(0).alias("cluster_id"))
    probs = model.transform(rows).select("id", vector_to_array("probability").alias("p"))
    likely = F.array_position("p", F.array_max("p")).cast("int") - 1
    strong = F.filter(F.sequence(F.lit(0), F.size("p") - 1), lambda i: F.element_at("p", i + 1) >= cfg.prob_threshold)
    return probs.select("id", F.explode(F.when(F.size(strong) > 0, strong).otherwise(F.array(likely))).alias("cluster_id"))


def cluster_texts(members: DataFrame, most: int = DEFAULT.summary_chars) -> DataFrame:
    """cluster_id, n_members, joined: members' texts by id between rules, cut at ``most`` characters."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "content"))), lambda m: m["content"]), "\n\n---\n\n")
    return members.groupBy("cluster_id").agg(F.count("*").alias("n_members"), F.substring(joined, 1, most).alias("joined"))


def lead_summary(joined, n_words: int = 80):
    """The default summary: the first words."""
    return F.array_join(F.slice(F.split(T.strip(joined), r"\s+"), 1, n_words), " ")


def build_tree(leaves: DataFrame, cfg: Config = DEFAULT, summarise: Callable = lead_summary, embed: Callable | None = None, ks: list[int] | None = None) -> DataFrame:
    """All nodes above ``leaves`` (id, content, embedding): id, level, content, embedding, children_ids, cluster_id.

    Levels rise until few nodes or a single cluster are left. ``summarise`` maps a column of joined texts to summaries and
    ``embed`` a column of texts to vectors; ``functions.models`` makes such columns from Python models. Each level is written
    to the shared folder.
    """
    spark = leaves.sparkSession
    dim = len(leaves.select("embedding").first()["embedding"])
    embed = embed or (lambda c: hashed_embedding(T.tokens(c), dim))
    current, out = leaves.select("id", "content", "embedding"), None
    for level in range(1, cfg.max_levels + 1):
        if current.count() <= cfg.min_nodes:
            break
        member = stage(soft_clusters(current, cfg, ks), "members")
        if member.select("cluster_id").distinct().count() <= 1:
            break
        joined = member.join(current.select("id", "content"), "id")
        texts = cluster_texts(joined, cfg.summary_chars)
        kids = member.groupBy("cluster_id").agg(F.array_sort(F.collect_list("id")).alias("children_ids"))
        nodes = texts.join(kids, "cluster_id").select(
            F.xxhash64(F.lit(level), "cluster_id", "children_ids").alias("id"), F.lit(level).alias("level"), summarise(F.col("joined")).alias("content"), "children_ids", "cluster_id"
        )
        nodes = stage(nodes.withColumn("embedding", embed(F.col("content"))), "nodes")
        out = nodes if out is None else out.unionByName(nodes)
        current = nodes.select("id", "content", "embedding")
    if out is None:
        return spark.createDataFrame([], "id long, level int, content string, children_ids array<long>, cluster_id int, embedding array<float>")
    return out


__all__ = ["bic", "build_tree", "cluster_texts", "lead_summary", "mean_pool", "reduced", "soft_clusters"]
