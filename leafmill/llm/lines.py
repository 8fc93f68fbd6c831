"""Line dedup by windows of neighbouring lines.

Every two neighbouring lines are a window, and so is each line of many words alone. What a window holds depends on
nothing around it, so every passage of two lines or more that stands elsewhere too is covered by repeated
windows from its first line to its last. A window stays where it occurs first; the lines of its other occurrences
go, once their bytes have been compared.

This is the limit of content-defined chunks in which every rolling value over two line hashes is a boundary. With fewer
boundaries the chunks at a passage's ends run into the lines around it, and short passages are lost; the README has
figures of that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import SPACE, buffers, segment_hashes, slices, tidy
from .common import fresh, join_hot, stage

#: Words from which a line is a window alone. A shorter line that repeats by itself (a brace, a heading) is no passage.
LONE = 50
TEXT = 500_000


def split(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First byte and end (without the line feed) of each line; by text its lines, and those before it (the sum at last)."""
    feeds = np.flatnonzero(data == 10)
    n = len(at) - 1
    per = np.bincount(np.searchsorted(at, feeds, "right") - 1, minlength=n) + 1
    first = np.concatenate(([0], np.cumsum(per)))
    total = int(first[-1])
    starts, ends = np.empty(total, np.int64), np.empty(total, np.int64)
    opens, closes = np.zeros(total, bool), np.zeros(total, bool)
    opens[first[:-1]] = True
    closes[first[1:] - 1] = True
    starts[opens], starts[~opens] = at[:-1], feeds + 1
    ends[closes], ends[~closes] = at[1:], feeds
    return starts, ends, per, first


def long_lines(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which lines have ``LONE`` words or more."""
    inside = ~SPACE[data]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    line = starts[starts < ends]
    opens[line] = inside[line]
    before = np.concatenate(([0], np.cumsum(opens)))
    return before[ends] - before[starts] >= LONE


def _tag(docs: DataFrame, id_col: str, text_col: str):
    return F.xxhash64(F.lit(11), docs[id_col], docs[text_col])


def repeated_windows(docs: DataFrame, id_col: str, text_col: str, salt: int = 0) -> DataFrame:
    """tag, no (of the first line), wide (number of lines), both lines' hashes and stays of each window that occurs more than once.

    The first occurrence stays: that in the smallest id (nulls last), there the earliest.
    """

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = buffers(batch.column(2))
            for i, j in slices(at, TEXT):
                part = data[at[i] : at[j]]
                starts, ends, per, first = split(part, at[i : j + 1] - at[i])
                h = segment_hashes(part, starts, ends, salt).view(np.int64)
                text = np.repeat(np.arange(j - i), per)
                no = np.arange(len(h)) - first[text]
                two = np.flatnonzero(text[1:] == text[:-1])
                lone = np.flatnonzero(long_lines(part, starts, ends))
                line = np.concatenate((two, lone))
                take = pa.array(text[line] + i)
                second = np.concatenate((h[two + 1], np.zeros(len(lone), np.int64)))
                wide = np.repeat(np.array([2, 1], np.int32), [len(two), len(lone)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(take), batch.column(1).take(take), pa.array(no[line], pa.int32()), pa.array(wide), pa.array(h[line]), pa.array(second)],
                    names=["tag", "doc_id", "no", "wide", "hash", "second"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(_tag(docs, id_col, text_col).alias("tag"), docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    every = stage(rows.mapInArrow(run, f"tag long, doc_id {kind}, no int, wide int, hash long, second long"), "windows")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "tag", "no"))
    known = every.groupBy("hash", "second", "wide").agg(first.alias("first"), F.count("*").alias("n")).where("n > 1")
    known = stage(known.select("hash", "second", "wide", F.col("first.tag").alias("first_tag"), F.col("first.no").alias("first_no"), "n"), "repeats")
    met = join_hot(every, known, ["hash", "second", "wide"], "n")
    return met.select("tag", "no", "wide", "hash", "second", ((F.col("tag") == F.col("first_tag")) & (F.col("no") == F.col("first_no"))).alias("stays"))


def listed(column: pa.Array, i: int, j: int, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The windows listed with texts i to j: each one's first line, counted over these texts, wide and stays."""
    at = column.offsets.to_numpy()[i : j + 1]
    values = column.values.slice(at[0], at[-1] - at[0])
    no, wide, stays = (values.field(x).to_numpy(zero_copy_only=False) for x in ("no", "wide", "stays"))
    return np.repeat(first[:-1], np.diff(at)) + no.astype(np.int64), wide, stays.astype(bool)


def covered(total: int, line: np.ndarray, wide: np.ndarray) -> np.ndarray:
    """Which of ``total`` lines the windows hold."""
    out = np.zeros(total, bool)
    out[line] = True
    out[line[wide == 2] + 1] = True
    return out


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counts: bool = False, salt: int = 0) -> DataFrame:
    """``docs`` with repeated passages removed from their texts; with ``counts`` also n_lines and n_removed.

    A passage is two neighbouring lines or more, or a line of ``LONE`` words or more. Wherever it occurs but for the first
    time, all its lines go; each of them stays somewhere. A shorter line goes only with a neighbour.
    Every row stays, perhaps with an empty text. A null text stays null and has no lines; other texts have one line more
    than line feeds. Rows equal in id and text are one document: what stays in one stays in all of them. An empty table
    gives an empty result. If lines of equal hash differ in their bytes, all is done again with another ``salt``. The longest
    text needs about 25 bytes of memory a byte.
    """
    tag, gone = fresh(docs, "tag"), fresh(docs, "gone")
    n_lines, n_removed = (fresh(docs, "n_lines"), fresh(docs, "n_removed")) if not counts else ("n_lines", "n_removed")
    met = stage(repeated_windows(docs, id_col, text_col, salt).distinct(), "met")

    by_doc = met.groupBy("tag").agg(F.collect_list(F.struct("no", "wide", "stays")).alias(gone)).withColumnRenamed("tag", tag)  # windows of one document
    joined = stage(docs.withColumn(tag, _tag(docs, id_col, text_col)).join(by_doc.hint("shuffle_hash"), tag, "left"), "joined")
    text_at, gone_at, names = joined.columns.index(text_col), joined.columns.index(gone), list(joined.columns)

    @tidy
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The bytes of every line in a repeated window."""
        for batch in batches:
            data, at = buffers(batch.column(1))
            for i, j in slices(at, TEXT):
                part = data[at[i] : at[j]]
                starts, ends, _, first = split(part, at[i : j + 1] - at[i])
                line, wide, _ = listed(batch.column(0), i, j, first)
                held = np.flatnonzero(covered(len(starts), line, wide))
                lo, hi = starts[held], ends[held]
                found = {(h, part[a:b].tobytes()) for h, a, b in zip(segment_hashes(part, lo, hi, salt).view(np.int64).tolist(), lo, hi)}
                yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in found], pa.int64()), pa.array([x for _, x in found], pa.binary())], names=["hash", "bytes"])

    seen = joined.where(F.col(gone).isNotNull()).select(gone, F.col(text_col).cast("string")).mapInArrow(read, "hash long, bytes binary")
    distinct = seen.groupBy("hash", "bytes").agg(F.count("*").alias("n"))  # combined in the tasks that read
    differ = stage(distinct.groupBy("hash").agg(F.count("*").alias("variants")).where("variants > 1").select("hash"), "differ")
    if not differ.isEmpty():  # equal hashes of different bytes: none is expected in any corpus
        return line_dedup(docs, id_col, text_col, counts, salt + 1)

    @tidy
    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = buffers(batch.column(text_at))
            for i, j in slices(at, TEXT):
                part = data[at[i] : at[j]]
                starts, ends, per, first = split(part, at[i : j + 1] - at[i])
                line, wide, stays = listed(batch.column(gone_at), i, j, first)
                off = covered(len(starts), line[~stays], wide[~stays])
                removed = np.diff(np.concatenate(([0], np.cumsum(off)))[first])
                out = []
                valid = batch.column(text_at)[i:j].is_valid().to_numpy(zero_copy_only=False)
                for r in range(j - i):
                    if not valid[r]:
                        out.append(None)
                    elif not removed[r]:
                        out.append(part[at[i + r] - at[i] : at[i + r + 1] - at[i]].tobytes().decode("utf-8", "replace"))
                    else:
                        kept = np.flatnonzero(~off[first[r] : first[r + 1]]) + first[r]
                        out.append(b"\n".join(part[starts[c] : ends[c]].tobytes() for c in kept).decode("utf-8", "replace"))
                cols = [batch.column(c)[i:j] for c in range(batch.num_columns)]
                cols[text_at] = pa.array(out, pa.string())
                yield pa.RecordBatch.from_arrays([*cols, pa.array(np.where(valid, per, 0), pa.int64()), pa.array(removed, pa.int64())], names=[*names, n_lines, n_removed])

    from pyspark.sql.types import LongType, StructType

    cleaned = joined.mapInArrow(drop, StructType([*joined.schema.fields]).add(n_lines, LongType()).add(n_removed, LongType()))
    return cleaned.select(*docs.columns, *([n_lines, n_removed] if counts else []))


def op7_lines(spark, sf_dir: str) -> DataFrame:
    from .common import table

    out = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), counts=True)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
