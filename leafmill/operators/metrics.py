"""Measures of retrieval, answers and trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def retrieval_metrics(ranked: DataFrame, gold: DataFrame, by: list[str] | None = None, cut: int = 10) -> DataFrame:
    """Recall@1, 5, 10, MRR@cut and nDCG@cut, for one relevant parent a query; queries without hits count as 0."""
    hit = gold.join(ranked, (gold["query_id"] == ranked["query_id"]) & (gold["gold_parent_id"] == ranked["parent_id"]), "left")
    one = hit.groupBy(gold["query_id"], *[gold[b] for b in by or []]).agg(F.min("rank").alias("rank"))
    r = F.col("rank")
    within = lambda k: F.avg(F.when(r <= k, 1.0).otherwise(0.0))
    cols = [within(k).alias(f"recall_{k}") for k in (1, 5, 10)]
    cols.append(F.avg(F.when(r <= cut, 1.0 / r).otherwise(0.0)).alias("mrr"))
    cols.append(F.avg(F.when(r <= cut, 1.0 / F.log2(r + 1.0)).otherwise(0.0)).alias("ndcg"))
    return one.groupBy(*(by or [])).agg(F.count("*").alias("n_queries"), *cols)


def _words(c: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9]+"), lambda x: x != "")


def shared_words(df: DataFrame, left: str, right: str, keys: list[str]) -> DataFrame:
    """``keys``, n_left, n_right, n_same of every row: the words of two texts, and those they share with repeats.

    Words are counted by row and word, so the work grows with the words and not with their square.
    """
    rows = df.select(F.monotonically_increasing_id().alias("__row"), *keys, _words(F.col(left)).alias("a"), _words(F.col(right)).alias("b"))
    both = F.concat(F.transform("a", lambda w: F.struct(w.alias("w"), F.lit(1).alias("x"), F.lit(0).alias("y"))), F.transform("b", lambda w: F.struct(w.alias("w"), F.lit(0).alias("x"), F.lit(1).alias("y"))))
    each = rows.select("__row", *keys, F.explode_outer(both).alias("z")).groupBy("__row", *keys, F.col("z.w").alias("w")).agg(F.sum("z.x").alias("x"), F.sum("z.y").alias("y"))
    zero = F.lit(0)
    return each.groupBy("__row", *keys).agg(F.coalesce(F.sum("x"), zero).alias("n_left"), F.coalesce(F.sum("y"), zero).alias("n_right"), F.coalesce(F.sum(F.least("x", "y")), zero).alias("n_same")).drop("__row")


def token_f1(df: DataFrame, answer: str, reference: str, keys: list[str]) -> DataFrame:
    """``keys`` and f1 of every row's texts, by words with repeats; two texts without words agree."""
    n = F.col("n_left") + F.col("n_right")
    return shared_words(df, answer, reference, keys).select(*keys, F.when(n > 0, 2.0 * F.col("n_same") / n).otherwise(1.0).alias("f1"))


def faithfulness(df: DataFrame, answer: str, context: str, keys: list[str]) -> DataFrame:
    """``keys`` and the share of an answer's words that its context gives, with repeats; null for an answer without words."""
    return shared_words(df, answer, context, keys).select(*keys, F.when(F.col("n_left") > 0, F.col("n_same") / F.col("n_left")).alias("faithfulness"))


def citation_precision(cited: Column, given: Column) -> Column:
    """The share of cited passages that were given; null if none is cited."""
    return F.when(F.size(cited) > 0, F.size(F.array_intersect(cited, given)) / F.size(F.array_distinct(cited)))


def refusal_metrics(df: DataFrame, refused: str = "refused", should: str = "should_refuse") -> DataFrame:
    both = F.sum((F.col(refused) & F.col(should)).cast("int"))
    return df.agg((both / F.nullif(F.sum(F.col(refused).cast("int")), F.lit(0))).alias("precision"), (both / F.nullif(F.sum(F.col(should).cast("int")), F.lit(0))).alias("recall"))


def tree_quality(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """By level: nodes, nodes without a parent, and the share of parents with a single child."""
    has = edges.select(F.col("child_id").alias("id"), F.lit(1).alias("has")).distinct()
    fan = edges.groupBy(F.col("parent_id").alias("id")).agg(F.count("*").alias("fan"))
    rows = nodes.select("id", "level").join(has, "id", "left").join(fan, "id", "left")
    return rows.groupBy("level").agg(F.count("*").alias("n"), F.count_if(F.col("has").isNull()).alias("orphans"), F.avg(F.when(F.col("fan").isNotNull(), (F.col("fan") == 1).cast("double"))).alias("singleton_share"))


def tree_report(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: depth, nodes, clusters with a single member, and nodes under the top level that nothing holds."""
    fan = edges.groupBy(F.col("parent_id").alias("id")).agg(F.count("*").alias("fan"))
    held = edges.select(F.col("child_id").alias("id"), F.lit(1).alias("held")).distinct()
    depth = nodes.agg(F.max("level")).first()[0]
    rows = nodes.select("id", "level").join(fan, "id", "left").join(held, "id", "left")
    return rows.agg(F.max("level").alias("depth"), F.count("*").alias("n_nodes"), F.count_if(F.col("fan") == 1).alias("n_singletons"), F.count_if(F.col("held").isNull() & (F.col("level") < F.lit(depth))).alias("n_orphans"))


def silhouette(df: DataFrame, features: str = "features", cluster: str = "cluster_id") -> float:
    from pyspark.ml.evaluation import ClusteringEvaluator

    return ClusteringEvaluator(featuresCol=features, predictionCol=cluster, distanceMeasure="cosine").evaluate(df)
