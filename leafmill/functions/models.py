"""Python models as column functions: embedders, summarisers and captioners, over batches and with their failures handled.

A model is a plain function over a list; it is called for batches of rows in Arrow workers. What it raises for a batch is tried
again row by row, so one bad row costs no other.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StringType


def _tolerant(model: Callable[[list], Sequence], values: list) -> list:
    """What the model makes of each value; None where it fails."""
    try:
        out = list(model(values))
        if len(out) == len(values):
            return out
    except Exception:  # noqa: BLE001  # any model, any error: its rows are tried alone
        pass
    if len(values) == 1:
        return [None]
    return [_tolerant(model, [v])[0] for v in values]


def _parts(n: int, size: int):
    return ((i, min(n, i + size)) for i in range(0, n, size))


def embedder(model: Callable[[list[str]], Sequence], dim: int, batch: int = 32) -> Callable[[Column], Column]:
    """A function from a text column to vectors of length one and of ``dim`` numbers. Null is the empty text.

    Vectors of another length, and failures, are errors: a store with holes in it is of no use.
    """

    @F.pandas_udf(ArrayType(FloatType()))
    def embed(texts: pd.Series) -> pd.Series:
        out, all_ = [], texts.fillna("").tolist()
        for i, j in _parts(len(all_), batch):
            got = np.asarray(model(all_[i:j]), np.float64)
            if got.shape != (j - i, dim):
                raise ValueError(f"expected {j - i} vectors of {dim} numbers, got {got.shape}")
            size = np.sqrt((got * got).sum(1))
            out += list((got / np.where(size > 0, size, 1)[:, None]).astype(np.float32))
        return pd.Series(out)

    return embed


def summariser(model: Callable[[list[str], str | None], str], otherwise: Callable[[list[str]], str] | None = None, rule: str = "\n\n---\n\n") -> Callable[..., Column]:
    """A function (joined texts, domain or None) to summaries; ``model`` takes the texts and the domain.

    Where the model fails or says nothing, the summary is ``otherwise``'s, by default the texts' first words.
    """
    lead = otherwise or (lambda texts: " ".join(" ".join(texts).split()[:80]))

    @F.pandas_udf(StringType())
    def summarise(joined: pd.Series, domain: pd.Series) -> pd.Series:
        out = []
        for text, d in zip(joined.fillna(""), domain):
            parts = text.split(rule)
            said = _tolerant(lambda xs, d=d: [model(x, d) for x in xs], [parts])[0]
            out.append(said.strip() if said and said.strip() else lead(parts))
        return pd.Series(out)

    return lambda joined, domain=None: summarise(joined, F.lit(None).cast("string") if domain is None else domain)


def captioner(model: Callable[[list[str]], Sequence[str]], batch: int = 8) -> Callable[[Column], Column]:
    """A function from image paths to texts; null where there is no path, the model fails or says nothing."""

    @F.pandas_udf(StringType())
    def caption(paths: pd.Series) -> pd.Series:
        out: list[str | None] = [None] * len(paths)
        there = [i for i, p in enumerate(paths) if isinstance(p, str)]
        for i, j in _parts(len(there), batch):
            for k, said in zip(there[i:j], _tolerant(model, [paths.iloc[k] for k in there[i:j]])):
                out[k] = said.strip() if isinstance(said, str) and said.strip() else None
        return pd.Series(out, dtype=object)

    return caption
