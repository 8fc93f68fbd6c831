"""Array operations on the bytes of many texts at once."""

from __future__ import annotations

import ctypes
import functools

import numpy as np
import pyarrow as pa

MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))
ODD_STEP = np.uint64(0x9E3779B97F4A7C15)
#: The first so many bytes of an 8-byte number.
HEAD = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: The bytes between words.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def spread(base: np.ndarray, count: np.ndarray) -> np.ndarray:
    """base[0], base[0]+1, ... (count[0] of them), base[1], ..."""
    out = np.arange(int(count.sum()), dtype=np.int64)
    out += np.repeat(base - (np.cumsum(count) - count), count)
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers that spreads every bit over all others."""
    x = x ^ (x >> np.uint64(33))
    x = x * MIX[0]
    x ^= x >> np.uint64(33)
    x *= MIX[1]
    x ^= x >> np.uint64(33)
    return x


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where each text starts in them, with the end at last; null is empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    flat = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return flat, at - at[0]


def lanes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each data[start:end] as 8-byte numbers, the last padded by zeros: the numbers, each one's place in its segment, and how many a segment has."""
    count = (ends - starts + 7) // 8
    place = spread(np.zeros(len(count), np.int64), count)
    at = np.repeat(starts, count) + 8 * place
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    value = np.ndarray((len(data) + 1,), "<u8", buffer=padded, strides=(1,))[at]
    full = ends - starts - 8 * (count - 1)  # bytes in the last number
    last = (np.cumsum(count) - 1)[count > 0]
    value[last] &= HEAD[full[count > 0]]
    return value, place, count


def segment_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit hash of each data[start:end]; see ``lane_hashes``. Needs about 30 bytes for 8 bytes of text."""
    return lane_hashes(*lanes(data, starts, ends), ends - starts, salt)


def lane_hashes(value: np.ndarray, place: np.ndarray, count: np.ndarray, size: np.ndarray, salt: int = 0) -> np.ndarray:
    """Hashes of segments from their 8-byte numbers; another ``salt`` gives other hashes.

    Every number goes through a bijection that depends on its place before they are added up, so no structure of the
    text (periods, complements) makes sums agree: equal hashes of different bytes are as rare as among random numbers.
    """
    value = mixed(mixed(value + ODD_STEP * (place + 1 + (salt << 40)).astype(np.uint64)) ^ value)
    sums = np.zeros(len(value) + 1, np.uint64)
    np.cumsum(value, out=sums[1:])
    upto = np.cumsum(count)
    return mixed(sums[upto] - sums[upto - count] + mixed(size.astype(np.uint64) * MIX[0] + MIX[1]))


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all texts, and by text how many words stand before it (the sum at last)."""
    gap = SPACE[data]
    inside = ~gap
    first = inside.copy()
    first[1:] &= gap[:-1]
    last = inside.copy()
    last[:-1] &= gap[1:]
    edge = at[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    first[edge] = inside[edge]
    last[edge - 1] = inside[edge - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, at)


def slices(at: np.ndarray, most: int):
    """Ranges of texts of about ``most`` bytes together; a longer text is alone."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def tidy(run):
    """A function over batches that gives memory back to the system when its task ends.

    Workers are used again and again; what their allocators keep would count against the executor all the while.
    """

    @functools.wraps(run)
    def out(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim()

    return out


def trim() -> None:
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
