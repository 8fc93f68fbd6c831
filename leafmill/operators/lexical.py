"""Lexical search: a named tf-idf score over tokens, trigram similarity and containment for identifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.trigrams import scorer

STOP = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "with")


def terms(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, term, tf of lower-case words without stop words."""
    words = F.explode(F.split(F.lower(F.col(text_col)), "[^a-z0-9]+"))
    rows = df.select(F.col(id_col).alias("id"), words.alias("term")).where((F.col("term") != "") & ~F.col("term").isin(*STOP))
    return rows.groupBy("id", "term").agg(F.count("*").alias("tf"))


def tf_idf(docs: DataFrame, query: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score = sum over query terms of (1 + ln tf) * ln(1 + N / df); documents with none of them are left out.

    Only the query's terms leave the scan, so the shuffle carries matches and not the corpus.
    """
    wanted = [q.lower() for q in dict.fromkeys(query) if q.lower() not in STOP]
    hit = terms(docs, id_col, text_col).where(F.col("term").isin(*wanted))
    df = hit.groupBy("term").agg(F.count("*").alias("df"))  # one row a query term
    total = docs.agg(F.count("*").alias("n"))
    weight = (1 + F.log("tf")) * F.log(1 + F.col("n") / F.col("df"))
    scored = hit.join(F.broadcast(df), "term").join(F.broadcast(total), F.lit(True))
    return scored.groupBy("id").agg(F.sum(weight).alias("score"))


def trigram(docs: DataFrame, query: str, least: float = 0.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score: shared trigrams by all trigrams of text and query. A null text has none."""
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = StructType([StructField("id", rows.schema["id"].dataType), StructField("score", DoubleType())])
    return rows.mapInArrow(scorer(query), out).where(F.col("score") > least)


def containing(docs: DataFrame, token: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score 1 where an identifier stands in the text as it is."""
    return docs.where(F.col(text_col).contains(token)).select(F.col(id_col).alias("id"), F.lit(1.0).alias("score"))


def lexical(docs: DataFrame, query: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The better of a document's scores: words by tf-idf scaled to the best, identifiers by containment."""
    parts = query.split()
    ident = [p for p in parts if any(c.isdigit() for c in p) or (p == p.upper() and p != p.lower() and len(p) <= 8)]
    words = tf_idf(docs, [w for p in parts for w in "".join(c.lower() if c.isascii() and c.isalnum() else " " for c in p).split()], id_col, text_col)
    best = words.agg(F.max("score").alias("best"))
    out = words.join(F.broadcast(best), F.lit(True)).select("id", (F.col("score") / F.col("best")).alias("score"))
    for p in ident:
        out = out.unionAll(containing(docs, p, id_col, text_col))
    return out.groupBy("id").agg(F.max("score").alias("score"))
