"""Vectors as arrays: expressions, pooling, and a deterministic embedder for tests and defaults."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Similarity in double precision; null if either vector is zero."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def normalised(a: Column) -> Column:
    """Of length one; zero vectors stay."""
    n = norm(a)
    return F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))


def literal(values) -> Column:
    return F.array(*[F.lit(float(x)) for x in values])


def mean_pool(df: DataFrame, by: list[str], vec: str = "embedding", out: str = "pooled") -> DataFrame:
    """The normalised mean of each group's vectors.

    Sums run by position, so tasks combine before the shuffle and a group of any size is spread.
    """
    means = df.select(*by, F.posexplode(vec).alias("pos", "x")).groupBy(*by, "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    rows = means.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias(out))
    return rows.withColumn(out, normalised(F.col(out)))


@F.pandas_udf(ArrayType(FloatType()))
def _counted(at: pd.Series, sign: pd.Series, dim: pd.Series) -> pd.Series:
    """By row the sum of signs by position, of length one; tokens of all rows are added up at once."""
    n, width = len(at), int(dim.iloc[0]) if len(dim) else 1
    size = np.array([len(x) for x in at])
    out = np.zeros(n * width)
    if size.sum():
        np.add.at(out, np.repeat(np.arange(n), size) * width + np.concatenate(at.to_list()), np.concatenate(sign.to_list()))
    out = out.reshape(n, width)
    length = np.sqrt((out * out).sum(1))
    return pd.Series(list((out / np.where(length > 0, length, 1)[:, None]).astype(np.float32)))


def hashed_embedding(toks: Column, dim: int = 64) -> Column:
    """A bag of hashed tokens, normalised: tokens add one to or take one from a position that their hash names; null is empty."""
    toks = F.coalesce(toks, F.array().cast("array<string>"))
    at = F.transform(toks, lambda t: F.pmod(F.xxhash64(t), F.lit(dim)))
    sign = F.transform(toks, lambda t: F.lit(1.0) - 2 * F.pmod(F.shiftright(F.xxhash64(t), 32), F.lit(2)))
    return _counted(at, sign, F.lit(dim))


def rows_of(vectors: pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length and without nulls as the rows of a matrix, in double precision."""
    flat = vectors.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(vectors), -1)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each row of ``a`` and the row of ``b`` beside it, summed in order of positions, so that equal vectors have equal results anywhere."""
    ab, aa, bb = np.zeros(len(a)), np.zeros(len(a)), np.zeros(len(a))
    for x, y in zip(np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)):
        ab += x * y
        aa += x * x
        bb += y * y
    with np.errstate(all="ignore"):
        return np.clip(ab / np.sqrt(aa * bb), -1.0, 1.0)


def nearest_rows(ids: np.ndarray, q: np.ndarray, keys: np.ndarray, n: np.ndarray, least: float, apart: bool, step: int = 256, slack: float = 1e-9) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of ``q``, key, cosine) of the nearest row of ``n`` to each of ``q`` that has one of at least ``least``; the smallest key of ties.

    Matrix products leave what is within ``slack`` of a row's best, far above their error; those are settled by ``cosines``. Equal vectors
    are met once, by their smallest key, or the next one where ``apart`` and the smallest is the query's own id.
    """
    keys, code = np.unique(keys, return_inverse=True)  # codes follow the order of keys
    _, at, group = np.unique(np.ascontiguousarray(n).view(np.dtype((np.void, n.shape[1] * 8))).ravel(), return_index=True, return_inverse=True)
    order = np.lexsort((code, group))
    g, c = group[order], code[order]
    first = c[np.searchsorted(g, np.arange(len(at)))]
    second = np.full(len(at), -1)
    more = np.flatnonzero(c != first[g])
    has, where = np.unique(g[more], return_index=True)
    second[has] = c[more[where]]
    own = np.full(len(q), -1)
    if apart:
        i = np.minimum(np.searchsorted(keys, ids), len(keys) - 1)
        own = np.where(keys[i] == ids, i, -1)
    vectors, by = n[at], np.argsort(first, kind="stable")
    with np.errstate(all="ignore"):
        a, b = (x / np.sqrt((x * x).sum(1))[:, None] for x in (q, vectors))
    b[~np.isfinite(b).all(1)] = np.nan
    out = []
    for i in range(0, len(q), step):
        with np.errstate(all="ignore"):
            sims = a[i : i + step] @ b.T
        sims[~np.isfinite(sims)] = -np.inf
        mine = own[i : i + step]
        low, high = np.searchsorted(first[by], mine), np.searchsorted(first[by], mine, side="right")
        for r in np.flatnonzero(high > low):  # nothing but the query itself has this vector
            same = by[low[r] : high[r]]
            sims[r, same[second[same] < 0]] = -np.inf
        r, v = np.nonzero(sims >= np.maximum(sims.max(1), max(least, -1.0))[:, None] - slack)
        sim = np.concatenate([cosines(q[i + r[j : j + 8192]], vectors[v[j : j + 8192]]) for j in range(0, len(r), 8192)] or [np.zeros(0)])
        key = np.where(first[v] == mine[r], second[v], first[v])
        best = np.lexsort((key, -sim, r))
        best = best[sim[best] >= least]
        best = best[np.unique(r[best], return_index=True)[1]]
        out.append((i + r[best], keys[key[best]], sim[best]))
    return tuple(np.concatenate(x) for x in zip(*out))
