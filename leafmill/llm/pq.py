"""Near-duplicate embeddings by product quantisation over coarse inverted lists.

Vectors with equal bits and label collapse to one. Unit vectors go to the list of their nearest centroid; what
is left after it is coded by subspace. Every vector then visits its own list and the others that a near vector
may be in, and there asymmetric table look-ups give its distance to each code. A code's own error, which is
stored with it, bounds how far that distance can be from the true one; pairs that the bound cannot rule out
are settled by the exact cosine, so within a visited list no link is lost.

Lists to visit follow from two bounds that hold for any vectors. A vector within distance R of the visitor that lies in
another list is beyond the border between the two centroids, so the border is at most R away; and it is no further from
its centroid than the list's furthest vector, so the visitor is at most R further. Both together leave no link out,
whatever the vectors' structure; the price is that vectors without structure visit nearly all lists. Of two lists the
one with the larger number visits the other, so a pair of vectors meets once.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import tidy
from .common import small, stage
from .graph import components

THRESHOLD = 0.93
#: Vectors that a list of one label has on average, fewest lists (of more than as many times LIST_LEAST vectors), most lists.
LIST_SIZE, LEAST_LISTS, LIST_LEAST, MOST_LISTS = 1000, 4, 32, 4096
#: Vectors in the sample for centroids and codebooks, and numbers in it.
SAMPLE, SAMPLE_NUMBERS = 16384, 1 << 22
SUBSPACES, CODES = 8, 64
#: Residents and visitors that meet in one task at a time.
BLOCK = 2048
SEED = 7
#: What rounding may add to a distance.
SLACK = 1e-4


def kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    k = max(1, min(k, len(x)))
    centre = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        at = nearest(x, centre)
        n = np.bincount(at, minlength=k)
        total = np.zeros_like(centre)
        np.add.at(total, at, x)
        centre[n > 0] = total[n > 0] / n[n > 0, None]
    return centre


def nearest(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return (x @ centre.T - 0.5 * (centre**2).sum(1)).argmax(1)


class Model:
    """Centroids of the lists and codebooks of the residuals' subspaces, fitted on a bounded sample."""

    def __init__(self, sample: np.ndarray, lists: int):
        rng = np.random.default_rng(SEED)
        self.dim = sample.shape[1]
        self.centre = kmeans(sample, lists, 8, rng)
        rest = sample - self.centre[nearest(sample, self.centre)]
        parts = min(SUBSPACES, self.dim)
        self.edge = [self.dim * i // parts for i in range(parts + 1)]
        self.book = [kmeans(rest[:, a:b], CODES, 8, rng) for a, b in zip(self.edge, self.edge[1:])]
        self.apart = np.sqrt(np.maximum(((self.centre[:, None] - self.centre[None]) ** 2).sum(-1), 1e-12))

    def place(self, x: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
        """The list of each vector, its distance from that list's centroid, the lists up to its own that it may have to visit, and its distances from all centroids."""
        d = np.maximum((x**2).sum(1)[:, None] - 2 * x @ self.centre.T + (self.centre**2).sum(1), 0)
        row = np.arange(len(x))
        home = d.argmin(1)
        border = (d - d[row, home][:, None]) / (2 * self.apart[home])
        border[row, home] = 0
        border[np.arange(len(self.centre))[None, :] > home[:, None]] = np.inf
        return home, np.sqrt(d[row, home]), [np.flatnonzero(b <= radius + SLACK) for b in border], np.sqrt(d)

    def code(self, x: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes, and the length of what they leave out."""
        rest = x - self.centre[home]
        codes = np.stack([nearest(rest[:, a:b], book) for a, b, book in zip(self.edge, self.edge[1:], self.book)], 1).astype(np.uint8)
        back = np.concatenate([book[codes[:, m]] for m, book in enumerate(self.book)], 1)
        return codes, np.sqrt(((rest - back) ** 2).sum(1))

    def estimate(self, queries: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Distances of queries to codes of a list, from one table of distances a subspace."""
        rest = queries - self.centre[cell]
        out = np.zeros((len(queries), len(codes)), np.float32)
        for m, (a, b) in enumerate(zip(self.edge, self.edge[1:])):
            part, book = rest[:, a:b], self.book[m]
            table = (part**2).sum(1)[:, None] - 2 * part @ book.T + (book**2).sum(1)
            out += np.take(table.astype(np.float32), codes[:, m], axis=1)
        return np.sqrt(np.maximum(out, 0))


def dense(column) -> np.ndarray:
    """The lists of an Arrow column, all of one length, as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def unit(rows) -> np.ndarray:
    x = np.asarray(rows, np.float64)
    return x / np.sqrt((x * x).sum(1))[:, None]


def links_of(queries: np.ndarray, residents: np.ndarray, near: np.ndarray, threshold: float) -> np.ndarray:
    """Which candidate pairs have a cosine of at least the threshold, in double precision."""
    i, j = np.nonzero(near)
    for k in range(0, len(i), 1 << 16):
        a, b = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
        near[a, b] = np.einsum("ij,ij->i", queries[a], residents[b]) >= threshold
    return near


def embedding_groups(vectors: DataFrame, threshold: float = THRESHOLD, lists: int | None = None, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Only vectors with equal labels link. Vectors that are null, empty, zero or hold null or non-finite
    components, and vectors without a label, link with nothing: n_links 0, component_id their own id. Vectors
    of different lengths never link. Null ids give a null component_id unless another id is reached; rows that
    repeat are vectors of their own. Cosines equal to the threshold link. An empty table gives an empty result. Other
    columns are not read. ``lists`` sets the number of inverted lists.
    """
    v = F.col("v")
    kind = "float" if vectors.schema[vec_col].dataType.simpleString() == "array<float>" else "double"
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vec_col).cast(f"array<{kind}>").alias("v"))
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(math.inf).cast(kind)))
    fine = F.col("label").isNotNull() & v.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0)
    rows = stage(rows.withColumn("fine", F.coalesce(fine, F.lit(False))).withColumn("hash", F.when(F.col("fine"), F.xxhash64("v"))), "vectors")
    nodes = rows.where("fine").groupBy("hash", "label", "v").agg(F.min("vec_id").alias("low"), F.count("*").alias("weight"))
    nodes = stage(nodes.withColumn("node", F.monotonically_increasing_id()).withColumn("dim", F.size("v")), "nodes")
    dims = [r["dim"] for r in nodes.groupBy("dim").count().orderBy("dim").collect()]  # lengths, not vectors
    found = None
    for dim in dims:  # nearly always one
        part = _links(nodes.where(F.col("dim") == dim), dim, kind, threshold, lists)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = stage(found, "found")
    counted = found.where("b IS NULL").groupBy("a").agg(F.sum("n").alias("n"))
    roots = components(found.where("b IS NOT NULL").select("a", "b"))
    joined = nodes.join(counted, F.col("node") == F.col("a"), "left").select("node", "hash", "label", "v", "low", "weight", "n")
    joined = joined.join(roots.withColumnRenamed("node", "r"), F.col("node") == F.col("r"), "left").withColumn("root", F.coalesce("root", "node"))
    smallest = joined.groupBy("root").agg(F.min("low").alias("component"))
    settled = joined.join(smallest, "root").select("hash", "label", "v", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n"), "component")
    a, b = rows.alias("a"), settled.alias("b")
    out = a.join(b, (F.col("a.hash") == F.col("b.hash")) & (F.col("a.label") == F.col("b.label")) & (F.col("a.v") == F.col("b.v")), "left")
    component = F.when(F.col("a.fine"), F.col("component")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def _links(nodes: DataFrame, dim: int, kind: str, threshold: float, lists: int | None) -> DataFrame:
    """a, b, n: for every node the weight of other nodes linked to it (b null), and links that span components (n null)."""
    count = nodes.agg(F.count("*").alias("n"), F.approx_count_distinct("label").alias("labels")).first()
    fewest = LEAST_LISTS if count["n"] >= LEAST_LISTS * LIST_LEAST else 1
    lists = lists or max(fewest, min(MOST_LISTS, count["n"] // (LIST_SIZE * max(1, count["labels"]))))
    most = max(2 * lists, min(SAMPLE, max(64 * lists, 2048), SAMPLE_NUMBERS // dim))
    drawn = nodes.orderBy(F.xxhash64("hash"), "node").limit(most).select("v").toArrow()  # bounded by SAMPLE and SAMPLE_NUMBERS
    model = Model(unit(dense(drawn.column("v"))), lists)
    radius = math.sqrt(max(0.0, 2 - 2 * threshold))

    @tidy
    def place(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 4096):
                b = batch.slice(k, 4096)
                x = unit(dense(b.column(2)))
                home, out, visits, far = model.place(x, radius)
                codes, error = model.code(x, home)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), b.column(2), b.column(3), pa.array(home, pa.int32()), pa.array(out, pa.float64()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error, pa.float64())]
                    + [pa.array([v.astype("i4") for v in visits], pa.list_(pa.int32())), pa.array([f[v] for f, v in zip(far, visits)], pa.list_(pa.float64()))],
                    names=["node", "label", "v", "weight", "home", "out", "code", "error", "visits", "far"],
                )

    schema = f"node long, label string, v array<{kind}>, weight long, home int, out double, code binary, error double, visits array<int>, far array<double>"
    placed = stage(nodes.select("node", "label", "v", "weight").mapInArrow(place, schema), "placed")
    sizes = stage(placed.groupBy("label", F.col("home").alias("cell")).agg(F.count("*").alias("n"), F.max("out").alias("reach")), "sizes")
    calls = placed.select("node", "label", "weight", "home", F.explode(F.arrays_zip("visits", "far")).alias("z")).select("node", "label", "weight", "home", F.col("z.visits").alias("cell"), F.col("z.far").alias("far"))
    calls = calls.join(small(sizes), ["label", "cell"]).where(F.col("far") <= F.col("reach") + F.lit(radius + SLACK))
    calls = stage(calls.select("node", "label", "cell", "weight", (F.col("home") == F.col("cell")).alias("own"), F.ceil(F.col("n") / BLOCK).cast("int").alias("n_in")), "calls")
    blocks = stage(calls.groupBy("label", "cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("n_out"), F.max("n_in").alias("n_in")), "blocks")
    few = small(blocks)
    h = F.xxhash64("node", F.lit(SEED))
    none = F.lit(None)
    ins = placed.withColumnRenamed("home", "cell").join(few, ["label", "cell"])
    ins = ins.select("label", "cell", F.pmod(h, "n_in").cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("n_out") - 1)).alias("o"), "node", "v", "weight", "code", "error", none.cast("boolean").alias("own"))
    outs = calls.drop("n_in").join(few, ["label", "cell"]).join(placed.select("node", "v"), "node")
    outs = outs.select("label", "cell", F.explode(F.sequence(F.lit(0), F.col("n_in") - 1)).alias("i"), F.pmod(h, "n_out").cast("int").alias("o"), "node", "v", "weight", none.cast("binary").alias("code"), none.cast("double").alias("error"), "own")

    def meet(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        cell = key[1].as_py()
        resident = group.column("code").is_valid().to_numpy()
        x = unit(dense(group.column("v")))
        node, weights = group.column("node").to_numpy(), group.column("weight").to_numpy().astype(float)
        inside, outside = np.flatnonzero(resident), np.flatnonzero(~resident)
        a, b, n = [], [], []
        if len(inside) and len(outside):
            codes = np.stack([np.frombuffer(c, np.uint8) for c in group.column("code").take(pa.array(inside)).to_pylist()]).astype(np.int64)
            error = group.column("error").to_pandas().to_numpy()[inside].astype(float)
            near = model.estimate(x[outside], cell, codes) <= radius + error[None, :] + SLACK
            near &= node[outside][:, None] != node[inside][None, :]
            near = links_of(x[outside], x[inside], near, threshold)
            other = ~group.column("own").take(pa.array(outside)).to_numpy().astype(bool)
            for who, total in ((outside, near @ weights[inside]), (inside, weights[outside[other]] @ near[other])):
                some = np.flatnonzero(total)
                a += node[who[some]].tolist()
                b += [None] * len(some)
                n += total[some].astype(np.int64).tolist()
            part = np.arange(len(inside))  # residents joined so far
            for q in np.flatnonzero(near.any(1)).tolist():
                hit = np.flatnonzero(near[q])
                groups, first = np.unique(part[hit], return_index=True)
                a += [int(node[outside[q]])] * len(first)
                b += node[inside[hit[first]]].tolist()
                n += [None] * len(first)
                if len(groups) > 1:
                    part[np.isin(part, groups[1:])] = groups[0]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "n": pa.array(n, pa.int64())})

    return ins.unionByName(outs).groupBy("label", "cell", "i", "o").applyInArrow(meet, "a long, b long, n long")


def op6_embeddings(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return embedding_groups(table(spark, sf_dir, "embeddings"))


#: The links by comparing all vectors of a label, and the components by following them. Cosines are of vectors of one length.
SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r(id, reached) AS (SELECT a, b FROM l UNION SELECT r.id, l.b FROM r JOIN l ON r.reached = l.a),
c AS (SELECT id, min(reached) AS low FROM r GROUP BY id), n AS (SELECT a AS id, count(*) AS n_links FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n.n_links, 0)::BIGINT AS n_links, least(e.vec_id, coalesce(c.low, e.vec_id)) AS component_id, least(e.vec_id, coalesce(c.low, e.vec_id)) = e.vec_id AS kept
FROM embeddings e LEFT JOIN c ON c.id = e.vec_id LEFT JOIN n ON n.id = e.vec_id
"""
