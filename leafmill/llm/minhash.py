"""Near-duplicate documents by min-max hashing.

Every permutation of the shingles gives two signature values, the minimum and the maximum, so 120 values cost
60 evaluations a shingle. 24 bands of 5 values nominate candidates: a pair at similarity 0.8 shares a band
with probability 0.9999. Documents with equal shingle sets collapse to one before that; a set's 128-bit digest
stands for it. Sets joined through shared bands make a family. Pairs are confirmed on the full sets, in blocks
of bounded numbers of sets and of shingles, and without emitting the pairs: a block emits a spanning forest of its links.

A family that fits in a block is compared in full. Of a larger one every block is compared with itself and with the
family's most central set, which settles near copies of one text in one pass. After that, only bands whose sets are not
yet connected are left: in each, the sets outside its largest component are compared with all of the band. What is
left out cannot change a component, so the work grows with bands and not with families.

Texts are hashed once for the signatures. The sets of candidates are computed again from their texts, which
the scan looks up by a hash of the text; only candidates' texts are shuffled, unless the candidates are too many to be broadcast.
The longest text needs about 25 bytes of memory a byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import LOWER, MIX, buffers, mixed, segment_hashes, slices, words, tidy
from .common import fresh, join_hot, salted, small, stage
from .graph import components

PERMUTATIONS, BANDS, ROWS = 60, 24, 5
#: Sets in a block, and shingles of a block's sets on average; a task compares two blocks at most.
BLOCK, BLOCK_SHINGLES = 128, 1 << 20
#: Bytes of text in work at a time, and shingles in work at a time.
TEXT, PART = 500_000, 1 << 15
ODD = mixed(np.arange(1, 513, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(data: np.ndarray, at: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of each text's k-word shingles; with fewer words, of the whole sequence."""
    data = LOWER[data]
    starts, ends, before = words(data, at)
    hashes = segment_hashes(data, starts, ends)
    rolled = np.zeros(max(0, len(hashes) - k + 1), np.uint64)
    for j in range(k):
        rolled += hashes[j : j + len(rolled)] * ODD[j]
    rolled = mixed(rolled)
    for lo, hi in zip(before[:-1].tolist(), before[1:].tolist()):
        n = hi - lo
        if n >= k:
            yield np.unique(rolled[lo : hi - k + 1])
        elif n:
            yield mixed((hashes[lo:hi] * ODD[:n]).sum(keepdims=True) + np.array([n], np.uint64) * MIX[1])
        else:
            yield np.zeros(0, np.uint64)


def set_key(hashes: np.ndarray) -> bytes:
    """A digest of a sorted set."""
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def text_key(text: F.Column) -> F.Column:
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def signatures(sets: list[np.ndarray], bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """The band keys of sets that are not empty, one line a set."""
    values = bands * rows
    sig = np.zeros((len(sets), values), np.uint64)
    i = 0
    while i < len(sets):
        j, size = i, 0
        while j < len(sets) and (j == i or size + len(sets[j]) <= PART):
            size += len(sets[j])
            j += 1
        flat = np.concatenate(sets[i:j])
        begin = np.cumsum([0, *map(len, sets[i : j - 1])])
        for p in range((values + 1) // 2):
            v = flat * ODD[2 * p + 64] + ODD[2 * p + 65]
            sig[i:j, 2 * p] = np.minimum.reduceat(v, begin)
            if 2 * p + 1 < values:
                sig[i:j, 2 * p + 1] = np.maximum.reduceat(v, begin)
        i = j
    # a band takes values of different permutations
    sig = sig.reshape(len(sets), rows, bands)
    key = np.zeros((len(sets), bands), np.uint64)
    for r in range(rows):
        key = mixed(key * MIX[0] + sig[:, r, :])
    return mixed(key + ODD[:bands] * MIX[1]).view(np.int64)


def features(docs: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, t (a hash of the text), n_shingles, fp (null for an empty set) and bands of every row."""

    @tidy
    def run(batches):
        for batch in batches:
            data, at = buffers(batch.column(2))
            for i, j in slices(at, TEXT):
                sets = list(shingle_sets(data[at[i] : at[j]], at[i : j + 1] - at[i], k))
                full = [s for s in sets if len(s)]
                keys = signatures(full).tolist() if full else []
                it = iter(zip(map(set_key, full), keys))
                got = [next(it) if len(s) else (None, None) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[i:j], batch.column(1)[i:j], pa.array([len(s) for s in sets], pa.int64()), pa.array([g[0] for g in got], pa.binary()), pa.array([g[1] for g in got], pa.list_(pa.int64()))],
                    names=["doc_id", "t", "n_shingles", "fp", "bands"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col], text_key(docs[text_col]), docs[text_col].cast("string")).mapInArrow(run, f"doc_id {kind}, t long, n_shingles long, fp binary, bands array<long>")


def with_sets(named: DataFrame, k: int) -> DataFrame:
    """node, family, block and the set of each row (fp, node, family, block, text) whose text has the set ``fp``."""

    @tidy
    def run(batches):
        for batch in batches:
            data, at = buffers(batch.column(4))
            for i, j in slices(at, TEXT):
                sets = list(shingle_sets(data[at[i] : at[j]], at[i : j + 1] - at[i], k))
                same = [r for r, s in enumerate(sets) if len(s) and set_key(s) == batch.column(0)[i + r].as_py()]
                take = pa.array([i + r for r in same], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(c).take(take) for c in (1, 2, 3)] + [pa.array([sets[r].tobytes() for r in same], pa.binary())], names=["node", "family", "block", "members"])

    return named.mapInArrow(run, "node long, family long, block int, members binary")


def candidate_sets(docs: DataFrame, named: DataFrame, k: int, text_col: str) -> DataFrame:
    """node, family, block, members for the staged candidates ``named`` (t, fp, node, family, block)."""
    text = docs.select(text_key(docs[text_col]).alias("t"), F.xxhash64(F.lit(3), docs[text_col].cast("string")).alias("u"), docs[text_col].cast("string").alias("text"))
    cols = ["fp", "node", "family", "block"]
    few = small(named)
    if few is not named:
        # copies of a text are combined in the tasks that read them
        return stage(with_sets(text.join(few, "t").groupBy("t", "u", *cols).agg(F.any_value("text").alias("text")).select(*cols, "text"), k), "candidates")
    once = text.groupBy("t").agg(F.any_value("text").alias("text"))
    sets = stage(with_sets(once.join(named, "t").select(*cols, "text"), k), "candidates")
    lost = stage(named.join(sets.select("node"), "node", "left_anti"), "lost")  # another text had the same hash
    return sets if lost.isEmpty() else sets.unionByName(candidate_sets(docs, lost, k, text_col))


def linked(sets: list[np.ndarray], percent: int, part: int = 1 << 14) -> np.ndarray:
    """Which pairs have 100 * intersection >= percent * union; counts shared hashes by matrix products."""
    n = len(sets)
    size = np.array(list(map(len, sets)), np.int64)
    owner = np.repeat(np.arange(n), size)
    _, which, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[which] > 1
    owner, which = owner[shared], which[shared]
    order = np.argsort(which, kind="stable")
    owner, which = owner[order], which[order]
    column = np.cumsum(np.concatenate(([False], which[1:] != which[:-1]))) if len(which) else which
    common = np.zeros((n, n))
    lo = 0
    while lo < len(column):
        hi = int(np.searchsorted(column, column[lo] + part))
        m = np.zeros((n, part), np.float32)
        m[owner[lo:hi], column[lo:hi] - column[lo]] = 1
        common += m @ m.T
        lo = hi
    union = size[:, None] + size[None, :] - common
    return 100 * common >= percent * union


def forest(ok: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the linked pairs."""
    n, root, out = len(ok), list(range(len(ok))), []

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, j in zip(*(x.tolist() for x in np.nonzero(np.triu(ok, 1)))):
        a, b = find(i), find(j)
        if a != b:
            root[b] = a
            out.append((i, j))
    return out


def confirm(rows: DataFrame, keys: list[str], percent: int) -> DataFrame:
    """a, b: links confirmed within each group of rows (node, members), as a spanning forest of the group."""

    def run(group: pa.Table) -> pa.Table:
        nodes = group.column("node").to_pylist()
        seen = {f: i for i, f in enumerate(nodes)}  # a set may come twice, as member and as centre
        nodes, at = list(seen), list(seen.values())
        members = group.column("members")
        pairs = []
        if len(nodes) > 1:
            pairs = forest(linked([np.frombuffer(members[i].as_py(), np.uint64) for i in at], percent))
        return pa.table({"a": pa.array([nodes[i] for i, _ in pairs], pa.int64()), "b": pa.array([nodes[j] for _, j in pairs], pa.int64())})

    return rows.groupBy(*keys).applyInArrow(run, "a long, b long")


def n_blocks(sets: F.Column, shingles: F.Column, block: int) -> F.Column:
    return F.greatest(F.ceil(sets / block), F.ceil(shingles / BLOCK_SHINGLES), F.lit(1)).cast("int")


def near_components(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(rows, sets): rows has doc_id, t, n_shingles and fp of every row; sets has fp, root, n_rows, component_id and n_docs of every set.

    Words are runs of characters other than space and 09-0D, with A-Z lower-cased. component_id is the
    smallest doc_id among rows whose sets are connected by links, null if all their ids are null.
    """
    rows = stage(features(docs, k, id_col, text_col), "features")
    reps = rows.where("fp IS NOT NULL").groupBy("fp", "bands", "n_shingles").agg(F.min("doc_id").alias("doc_id"), F.min("t").alias("t"), F.count("*").alias("n_rows"))
    reps = stage(reps.withColumn("node", F.monotonically_increasing_id()), "sets")
    banded = reps.select("node", F.explode("bands").alias("band"))
    buckets = banded.groupBy("band").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("n")).where("n > 1")
    buckets = stage(buckets, "buckets")
    more = stage(banded.join(buckets.where("n > 2"), "band").select("node", "low", "n"), "members")
    near = buckets.select(F.col("low").alias("a"), F.col("high").alias("b")).unionByName(more.select(F.col("low").alias("a"), F.col("node").alias("b")))
    families = components(near).select("node", F.col("root").alias("family")).join(reps.select("node", "fp", "t", "n_shingles"), "node")
    families = stage(families, "families")
    sizes = families.groupBy("family").agg(F.count("*").alias("n_sets"), F.sum("n_shingles").alias("total"))
    large = sizes.select("family", n_blocks(F.col("n_sets"), F.col("total"), block).alias("n_blocks")).where("n_blocks > 1")
    placed = stage(salted(families, stage(large, "large"), "family", "node", "left"), "placed")
    # the most central set of a family that is split
    weight = more.groupBy("node").agg(F.sum("n").alias("weight"))
    split = placed.where("n_blocks IS NOT NULL")
    centres = split.join(weight, "node").groupBy("family", "n_blocks").agg(F.max_by("node", F.struct("weight", "node")).alias("node"))
    of_node = F.when(F.col("n_blocks").isNull(), 0).otherwise(F.pmod(F.xxhash64("node"), F.col("n_blocks"))).cast("int")
    sets = candidate_sets(docs, stage(placed.select("t", "fp", "node", "family", of_node.alias("block")), "named"), k, text_col)
    # every block with itself and with the family's centre
    centre = sets.drop("block").join(centres.select("node", "n_blocks"), "node").select("node", "family", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("block"), "members")
    joint = stage(components(confirm(sets.unionByName(centre), ["family", "block"], percent)), "joint")
    open_ = stage(open_bands(split.select("node", "n_shingles"), reps, joint, block), "open")
    if not open_.isEmpty():
        todo = sets.select("node", "members").join(open_, "node")
        h = F.xxhash64("node", F.lit(1))
        outs = todo.where("outside").select("node", "band", F.pmod(h, "n_out").cast("int").alias("o"), F.explode(F.sequence(F.lit(0), F.col("n_in") - 1)).alias("i"), "members")
        ins = todo.select("node", "band", F.explode(F.sequence(F.lit(0), F.col("n_out") - 1)).alias("o"), F.pmod(h, "n_in").cast("int").alias("i"), "members")
        rest = confirm(outs.unionByName(ins), ["band", "o", "i"], percent)
        joint = stage(components(joint.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(rest)), "joint")
    rooted = reps.select("node", "fp", "doc_id", "n_rows").join(joint, "node", "left")
    alone = rooted.where("root IS NULL").select("fp", F.col("node").alias("root"), "n_rows", F.col("doc_id").alias("component_id"), F.col("n_rows").alias("n_docs"))
    linked_ = stage(rooted.where("root IS NOT NULL").select("fp", "root", "doc_id", "n_rows"), "rooted")
    smallest = stage(linked_.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.sum("n_rows").alias("n_docs"), F.count("*").alias("n_sets")), "components")
    sets = join_hot(linked_.select("fp", "root", "n_rows"), smallest, "root", "n_sets").select(*alone.columns).unionByName(alone)
    return rows.select("doc_id", "t", "n_shingles", "fp"), stage(sets, "settled")


def open_bands(nodes: DataFrame, reps: DataFrame, joint: DataFrame, block: int) -> DataFrame:
    """node, band, outside, n_out, n_in: the sets of each band that is not one component yet; of bands with the same sets, one."""
    parts = nodes.join(joint, "node", "left").select("node", "n_shingles", F.coalesce("root", "node").alias("part"))
    inside = parts.join(reps.select("node", "bands"), "node").select("node", "n_shingles", "part", F.explode("bands").alias("band"))
    inside = stage(inside, "inside")
    marks = [F.sum(F.xxhash64("node", F.lit(x)).cast("decimal(38,0)")).alias(f"mark{x}") for x in (1, 2)]
    mixed_ = inside.groupBy("band").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.count("*").alias("n"), F.sum("n_shingles").alias("total"), *marks).where("low <> high")
    chosen = mixed_.groupBy("n", "total", "mark1", "mark2").agg(F.min("band").alias("band"))
    chosen = stage(chosen.select("band", "n", "total"), "mixed")
    members = stage(salted(inside, chosen, "band", "node"), "mixed-members")
    counted = members.groupBy("band", "part").agg(F.count("*").alias("n_part"), F.sum("n_shingles").alias("t_part"))
    main = counted.groupBy("band").agg(F.max_by(F.struct("part", "n_part", "t_part"), F.struct("n_part", "part")).alias("m"))
    plan = chosen.join(main, "band").select(
        "band", F.col("m.part").alias("main"), n_blocks(F.col("n") - F.col("m.n_part"), F.col("total") - F.col("m.t_part"), block).alias("n_out"), n_blocks(F.col("n"), F.col("total"), block).alias("n_in")
    )
    return salted(members.select("node", "band", "part"), stage(plan, "plan"), "band", "node").select("node", "band", (F.col("part") != F.col("main")).alias("outside"), "n_out", "n_in")


def near_groups(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Null, empty and blank texts have no shingles, link with nothing and are their own component. Rows that
    repeat an id are separate rows; ``kept`` compares ids, so all rows of the smallest id are kept. An empty
    table gives an empty result; other columns are not read.
    """
    rows, sets = near_components(docs, k, percent, id_col, text_col)
    out = join_hot(rows.where("fp IS NOT NULL"), sets.select("fp", "n_rows", "component_id"), "fp", "n_rows").select("doc_id", "n_shingles", "component_id")
    out = out.unionByName(rows.where("fp IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def near_dedup(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of each component the row with the smallest id.

    Texts without shingles all stay. Of rows that share the smallest id, or of a component without any id,
    one stays. Rows that go are told by id and a hash of the text: texts are not shuffled for it, unless those rows are
    too many to be broadcast.
    """
    rows, sets = near_components(docs, k, percent, id_col, text_col)
    several = sets.where("n_docs > 1")
    mine = F.col("doc_id").eqNullSafe(F.col("component_id"))
    met = join_hot(rows, several, "fp", "n_rows").groupBy("root", "component_id", "doc_id", "t").agg(F.count("*").alias("n"))
    best = met.where(mine).groupBy("root").agg(F.min("t").alias("best"))
    met = stage(met.join(best, "root").select("doc_id", "t", "n", (mine & (F.col("t") == F.col("best"))).alias("stays")), "met")
    lost, twice = stage(met.where("NOT stays").select("doc_id", "t"), "lost"), stage(met.where("stays AND n > 1").select("doc_id", "t"), "twice")
    key, named = fresh(docs, "t"), (fresh(docs, "few_id"), fresh(docs, "few_t"))
    keyed = docs.withColumn(key, text_key(docs[text_col]))

    def among(df: DataFrame, few: DataFrame, how: str) -> DataFrame:
        return df.join(small(few).toDF(*named), F.col(id_col).eqNullSafe(F.col(named[0])) & (F.col(key) == F.col(named[1])), how)

    out = among(keyed, lost, "left_anti")
    if not twice.isEmpty():  # rows that repeat their id and text
        out = among(out, twice, "left_anti").unionByName(among(out, twice, "left_semi").dropDuplicates([id_col, key]))
    return out.select(*docs.columns)


def op5_minhash(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return near_groups(table(spark, sf_dir, "documents"), k=2)


#: The same by all pairs that share a rare shingle: of two sets at 0.8, each one's rarest fifth and one more hold a common shingle.
SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS a FROM documents),
s AS (SELECT doc_id, CASE WHEN len(a) < 2 THEN a ELSE list_distinct(list_transform(range(1, len(a)), lambda i: a[i] || ' ' || a[i + 1])) END AS g FROM w),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
f AS (SELECT x, count(*) AS df FROM e GROUP BY x),
p AS (SELECT doc_id, n, x, row_number() OVER (PARTITION BY doc_id ORDER BY df, x) AS place FROM e JOIN f USING (x)),
rare AS (SELECT doc_id, n, x FROM p WHERE place <= n - (80 * n + 99) // 100 + 1),
c AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM rare a JOIN rare b ON a.x = b.x AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
l AS (SELECT a, b FROM c JOIN s sa ON sa.doc_id = a JOIN s sb ON sb.doc_id = b WHERE 180 * len(list_intersect(sa.g, sb.g)) >= 80 * (len(sa.g) + len(sb.g))),
ways AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(id, reached) AS (SELECT a, b FROM ways UNION SELECT r.id, ways.b FROM r JOIN ways ON r.reached = ways.a),
low AS (SELECT id, min(reached) AS low FROM r GROUP BY id)
SELECT s.doc_id, len(s.g) AS n_shingles, least(s.doc_id, coalesce(low, s.doc_id)) AS component_id, least(s.doc_id, coalesce(low, s.doc_id)) = s.doc_id AS kept
FROM s LEFT JOIN low ON low.id = s.doc_id
"""
