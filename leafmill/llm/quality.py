"""Document quality by a linear-chain conditional random field over lines.

Each line is good or bad. Its features describe the line itself and the lines beside it; transition weights
tie neighbours together. A document's score is the mean of its lines' forward-backward marginals of being
good, weighted by the lines' lengths. The field is fitted on the driver from whole labelled documents, at most ``SAMPLE`` of
them with at most ``SAMPLE_LINES`` lines together; scoring reads every whole text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructType

from .arrays import buffers, mixed, segment_hashes, slices, words, tidy
from .common import fresh, stage

#: Bounds of the fit's sample: labelled documents, and lines of all of them (136 bytes each on the driver).
SAMPLE, SAMPLE_LINES = 8000, 400_000
THRESHOLD = 0.3
TEXT = 500_000


def _of(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode())] = True
    return out


CLASSES = [
    _of("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    _of("abcdefghijklmnopqrstuvwxyz"),
    _of("0123456789"),
    _of("!"),
    _of("#$%&*@^~_=+<>{}[]\\/"),
    _of(".,;:?"),
    _of("|"),
    np.arange(256) >= 128,
]
OWN = 14
#: Features that a line also takes from the lines before and after it.
BESIDE = [4, 5, 6, 7, 8, 9, 10, 11, 12]
SIZE = OWN + 2 * len(BESIDE) + 2


def line_features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features by line, weights by line, and where each text's lines start (the sum at last).

    Lines end at line feeds; every text has at least one line, which may be empty.
    """
    feeds = np.flatnonzero(data == 10)
    n_texts = len(at) - 1
    of_text = np.searchsorted(at, feeds, "right") - 1
    first = np.arange(n_texts + 1) + np.concatenate(([0], np.cumsum(np.bincount(of_text, minlength=n_texts)))) if n_texts else np.zeros(1, np.int64)
    n = int(first[-1])
    is_first = np.zeros(n, bool)
    is_first[first[:-1]] = True
    starts = np.empty(n, np.int64)
    starts[first[:-1]] = at[:-1]
    starts[~is_first] = feeds + 1
    ends = np.empty(n, np.int64)
    is_last = np.zeros(n, bool)
    is_last[first[1:] - 1] = True
    ends[is_last] = at[1:]
    ends[~is_last] = feeds
    size = ends - starts
    counts = []
    for c in CLASSES:
        total = np.zeros(len(data) + 1, np.int32)
        np.cumsum(c[data], out=total[1:], dtype=np.int32)
        counts.append((total[ends] - total[starts]).astype(np.float32))
    upper, lower, digit, shout, symbol, stop, pipe, wide = counts
    ws, we, _ = words(data, at)
    line_of = np.searchsorted(starts, ws, "right") - 1
    n_words = np.bincount(line_of, minlength=n).astype(np.float32)
    tags = segment_hashes(data, ws, we) ^ mixed(line_of.astype(np.uint64))
    _, once = np.unique(tags, return_index=True)
    distinct = np.bincount(line_of[once], minlength=n).astype(np.float32)
    lines = segment_hashes(data, starts, ends) ^ mixed(np.repeat(np.arange(n_texts, dtype=np.uint64), np.diff(first)) + np.uint64(7))
    _, once = np.unique(lines, return_index=True)
    repeated = np.ones(n, np.float32)
    repeated[once] = 0
    repeated[size == 0] = 0
    x = np.zeros((n, SIZE), np.float32)
    w, b = np.maximum(n_words, 1), np.maximum(size, 1).astype(np.float32)
    last_char = np.zeros(n, np.float32)
    full = size > 0
    last_char[full] = CLASSES[5][data[ends[full] - 1]]
    for k, v in enumerate(
        (1, np.log1p(size) / 5, np.log1p(n_words) / 3, np.minimum((size - n_words) / w, 30) / 10, upper / np.maximum(upper + lower, 1), digit / b * 3, np.minimum(shout / w, 1), np.minimum(symbol / w, 2), np.minimum(stop / w, 1), np.minimum(pipe / w, 1), wide / b, repeated, 1 - distinct / w * (n_words > 0) - (n_words == 0), last_char)
    ):
        x[:, k] = v
    own = x[:, BESIDE]
    m = len(BESIDE)
    x[1:, OWN : OWN + m] = own[:-1]
    x[:-1, OWN + m : OWN + 2 * m] = own[1:]
    x[is_first, OWN : OWN + m] = 0
    x[is_last, OWN + m : OWN + 2 * m] = 0
    x[:, -2], x[:, -1] = is_first, is_last
    return x, np.maximum(size, 1), first


@dataclass
class Field:
    """Weights of the state "good" against "bad", and log-potentials of neighbouring states [from][to]."""

    weight: np.ndarray
    pair: np.ndarray

    def marginals(self, x: np.ndarray, first: np.ndarray, share: np.ndarray | None = None):
        """P(good) by line; with ``share``, a weight by text, also the expected number of each transition, so weighted."""
        score = (x @ self.weight.astype(np.float32)).astype(np.float64)
        n_lines = np.diff(first)
        order = np.argsort(-n_lines, kind="stable")
        starts, lens = first[:-1][order], n_lines[order]
        alive = np.searchsorted(-lens, -np.arange(1, (lens[0] if len(lens) else 0) + 1), "right")  # texts with more than t lines
        good, bad = np.empty(len(score)), np.empty(len(score))
        p = self.pair
        for t, k in enumerate(alive.tolist()):
            i = starts[:k] + t
            if t == 0:
                good[i], bad[i] = score[i], 0
            else:
                g, b = good[i - 1], bad[i - 1]
                good[i] = score[i] + np.logaddexp(g + p[1, 1], b + p[0, 1])
                bad[i] = np.logaddexp(g + p[1, 0], b + p[0, 0])
        ends = starts + lens - 1
        log_z = np.logaddexp(good[ends], bad[ends])
        back_g, back_b = np.zeros(len(score)), np.zeros(len(score))
        total = np.zeros((2, 2))
        by = share[order] if share is not None else None
        for t in range(len(alive) - 2, -1, -1):
            k = alive[t + 1]
            i = starts[:k] + t
            g, b = score[i + 1] + back_g[i + 1], back_b[i + 1]
            back_g[i] = np.logaddexp(p[1, 1] + g, p[1, 0] + b)
            back_b[i] = np.logaddexp(p[0, 1] + g, p[0, 0] + b)
            if by is not None:
                z, w = log_z[:k], by[:k]
                total += [[w @ np.exp(bad[i] + p[0, 0] + b - z), w @ np.exp(bad[i] + p[0, 1] + g - z)], [w @ np.exp(good[i] + p[1, 0] + b - z), w @ np.exp(good[i] + p[1, 1] + g - z)]]
        a, c = good + back_g, bad + back_b
        m = 1 / (1 + np.exp(np.clip(c - a, -700, 700)))
        return (m, total) if share is not None else m

    def scores(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        x, weight, first = line_features(data, at)
        m = self.marginals(x, first)
        return np.clip(np.add.reduceat(m * weight, first[:-1]) / np.add.reduceat(weight, first[:-1]), 0, 1) if len(at) > 1 else np.zeros(0)


def fit(x: np.ndarray, first: np.ndarray, label: np.ndarray, steps: int = 200, rate: float = 0.1, decay: float = 1e-3) -> Field:
    """Maximum likelihood by gradient steps; every line of a document carries the document's label.

    Each document counts as much as any other, long or short: lines of a document share its weight, which is the mean
    number of lines.
    """
    field = Field(np.zeros(x.shape[1]), np.zeros((2, 2)))
    n_lines = np.diff(first)
    y = np.repeat(label.astype(np.float64), n_lines)
    share = n_lines.mean() / n_lines if len(label) else np.ones(0)
    line_share = np.repeat(share, n_lines)
    seen = np.zeros((2, 2))
    seen[1, 1], seen[0, 0] = share[label == 1] @ (n_lines[label == 1] - 1), share[label == 0] @ (n_lines[label == 0] - 1)
    n = max(1, len(label))
    mean = [np.zeros(x.shape[1]), np.zeros((2, 2))]
    square = [np.zeros(x.shape[1]), np.zeros((2, 2))]
    for step in range(1, steps + 1):
        m, pairs = field.marginals(x, first, share)
        grads = [(x.T @ ((y - m) * line_share)) / n - decay * field.weight, (seen - pairs) / n - decay * field.pair]
        for k, (g, value) in enumerate(zip(grads, (field.weight, field.pair), strict=True)):
            mean[k] = 0.9 * mean[k] + 0.1 * g
            square[k] = 0.99 * square[k] + 0.01 * g * g
            value += rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8)
    return field


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, lines: int = SAMPLE_LINES, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Field:
    """Fit on at most ``sample`` labelled documents that are not held out, taken by a hash of their ids.

    Documents are taken whole, while they have ``lines`` lines together at most; one that has more than a quarter of them is passed over. Labels other than 0 and 1 are ignored, as are null ids; of several labels of one id the smallest counts.
    Without any labelled document, as in empty tables, every score is 0.5. Of rows that share an id all are taken.
    """
    known = labels.select(labels["doc_id"].alias("doc_id"), labels[label_col].alias("label")).where("label IN (0, 1) AND doc_id IS NOT NULL")
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("label").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    @tidy
    def run(batches):
        for batch in batches:
            data, at = buffers(batch.column(3))
            for i, j in slices(at, TEXT):
                x, _, first = line_features(data[at[i] : at[j]], at[i : j + 1] - at[i])
                rows = [x[a:b].tobytes() for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
                yield pa.RecordBatch.from_arrays([*(batch.column(c)[i:j] for c in range(3)), pa.array(np.diff(first), pa.int64()), pa.array(rows, pa.binary())], names=["label", "k", "t", "n", "x"])

    texts = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    rows = texts.join(F.broadcast(chosen), texts["id"] == chosen["doc_id"])
    size = 1 + F.length("text") - F.length(F.replace("text", F.lit("\n")))
    rows = rows.where(size <= lines // 4).select(F.col("label").cast("int").alias("label"), F.xxhash64("id").alias("k"), F.xxhash64("text").alias("t"), "text")
    made = stage(rows.mapInArrow(run, "label int, k long, t long, n long, x binary"), "lines")
    upto = F.sum("n").over(Window.orderBy("k", "t"))  # numbers of at most ``sample`` documents and their repeats
    kept = made.select("k", "t", "n").withColumn("upto", upto).where(F.col("upto") <= lines).select("k", "t").distinct()
    got = made.join(F.broadcast(kept), ["k", "t"]).select("label", "x").collect()  # bounded by lines
    # the order of collected rows may differ from run to run, and sums of floats with it
    got = sorted((r["label"], bytes(r["x"])) for r in got)
    if not got:
        return Field(np.zeros(SIZE), np.zeros((2, 2)))
    xs = [np.frombuffer(b, np.float32).reshape(-1, SIZE) for _, b in got]
    first = np.cumsum([0, *map(len, xs)])
    return fit(np.concatenate(xs), first, np.array([r[0] for r in got]))


def score_documents(docs: DataFrame, field: Field, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with a column of quality scores from 0 to 1; null texts count as empty, which is one empty line.

    Rows are scored one by one, whatever their other columns; an empty table gives an empty result. The longest text needs
    about 40 bytes of memory a byte.
    """
    names = [*docs.columns, name]
    n, where = len(docs.columns), docs.columns.index(text_col)

    @tidy
    def run(batches):
        for batch in batches:
            data, at = buffers(batch.column(where))
            for i, j in slices(at, TEXT):
                s = field.scores(data[at[i] : at[j]], at[i : j + 1] - at[i])
                yield pa.RecordBatch.from_arrays([batch.column(c)[i:j] for c in range(n)] + [pa.array(s, pa.float64())], names=names)

    return docs.mapInArrow(run, StructType([*docs.schema.fields]).add(name, DoubleType()))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score reaches ``threshold``, with all their columns."""
    field = train(docs, labels, id_col=id_col, text_col=text_col)
    score = fresh(docs, "score")
    return score_documents(docs, field, text_col, score).where(F.col(score) >= threshold).select(*docs.columns)


def op9_quality(spark, sf_dir: str) -> DataFrame:
    from .common import table

    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    field = train(docs, labels)
    kind = docs.schema["doc_id"].dataType

    @tidy
    def run(batches):
        for batch in batches:
            data, at = buffers(batch.column(1))
            for i, j in slices(at, TEXT):
                s = field.scores(data[at[i] : at[j]], at[i : j + 1] - at[i])
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], batch.column(2)[i:j], pa.array(s, pa.float64())], names=["doc_id", "held_out", "score"])

    schema = StructType().add("doc_id", kind).add("held_out", BooleanType()).add("score", DoubleType())
    out = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")).mapInArrow(run, schema)
    return out.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))
