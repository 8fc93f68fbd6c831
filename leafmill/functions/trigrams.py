"""Trigrams of texts as numbers: whole batches of texts are read by the byte in arrays."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Digits and letters of either case by their number from 1, all else, bytes of longer characters included, by 0.
_CLASS = np.zeros(256, np.int32)
for _i, _c in enumerate("0123456789abcdefghijklmnopqrstuvwxyz", 1):
    _CLASS[[ord(_c), ord(_c.upper())]] = _i
#: The only characters beyond these that are such letters in lower case.
_LOWER = (("\u212a".encode(), b"k"), ("\u0130".encode(), b"i"))
_SIZE = 37**3
_TEXTS, _PIECE = 64, 1 << 18


def _seen(texts: list[bytes]) -> np.ndarray:
    """By text the trigrams that it holds: words are padded by two blanks before and one after; number 0 is none.

    A trigram ends at each character of a word and at the first one after it. In pieces, so that a text of any length
    takes little more than its own bytes.
    """
    for old, new in _LOWER:
        texts = [t.replace(old, new) for t in texts]
    data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    starts = np.concatenate([[0], ends[:-1]])
    seen = np.zeros((len(texts), _SIZE), bool)
    flat, row = seen.ravel(), np.arange(len(texts), dtype=np.int32) * _SIZE
    for p in range(0, len(data), _PIECE):
        q = min(p + _PIECE, len(data))
        x = np.zeros(q - p + 2, np.int32)  # and the two before
        x[max(0, 2 - p) :] = _CLASS[data[max(0, p - 2) : q]]
        code = x[:-2] * (x[1:-1] > 0)
        code *= 37
        code += x[1:-1]
        code *= 37
        code += x[2:]
        code += np.repeat(row, np.maximum(np.minimum(ends, q) - np.maximum(starts, p), 0))
        flat[code] = True
    seen[:, 0] = False
    return seen


def scorer(query: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function over batches (id, text) to batches (id, score): trigrams shared with the query by all trigrams of both."""
    asked = np.flatnonzero(_seen([query.encode()])[0])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [np.zeros(0)]
            for i in range(0, batch.num_rows, _TEXTS):
                seen = _seen(batch.column(1).slice(i, _TEXTS).cast(pa.large_binary()).to_pylist())
                shared = seen[:, asked].sum(1)
                out.append(shared / np.maximum(1, np.array([np.count_nonzero(s) for s in seen]) + len(asked) - shared))
            yield pa.record_batch([batch.column(0), pa.array(np.concatenate(out), pa.float64())], names=["id", "score"])

    return score
