"""Operators against brute force on small fixtures, with nulls, ties, repeats, empty tables and clashing names."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafmill.llm import bpe, chat, common, exact, graph, lines, minhash, mixing, pii, pq, quality, tokencount

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __digest string, label int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 1, "x", 2) for i, t, s in rows], SCHEMA)


def odd_rows():
    base = "the quick brown fox jumps over the lazy dog and runs far away from here today " * 3
    return [
        (1, base, "a"), (2, base.upper(), "a"), (3, base + "extra", "b"), (4, None, "b"), (5, "", None), (6, " \n\t ", "c"), (7, "one", "c"), (8, "ONE", None),
        (9, "two words", "a"), (9, "two words", "a"), (None, "two words", "a"), (None, None, None), (10, "É " * 30, "d"), (11, "é " * 30, "d"), (12, "w " * 40_000, "d"), (13, "x" * 30_000, "d"),
    ]


LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_exact_groups(spark, monkeypatch):
    docs = table(spark, odd_rows() + [(100 + i, "Hot Text", "a") for i in range(50)])
    groups = defaultdict(list)
    for r in docs.collect():
        groups[(r["text"] or "").translate(LOW)].append(r["doc_id"])
    want = Counter()
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        for i in ids:
            want[i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()] += 1
    got = Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], bytes(r["digest"]).hex()) for r in exact.exact_groups(docs).collect())
    assert got == want
    ends = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    for rows_broadcast in (500_000, 0):
        monkeypatch.setattr(common, "BROADCAST_ROWS", rows_broadcast)
        kept = exact.exact_dedup(docs)
        assert kept.columns == docs.columns
        assert Counter(((r["text"] or "").translate(LOW), r["doc_id"]) for r in kept.collect()) == Counter(ends.items())
    assert exact.exact_dedup(docs.limit(0)).count() == exact.exact_groups(docs.limit(0)).count() == 0


def test_heavy_texts_are_found_without_the_shuffle(spark):
    ids = table(spark, [(i, "hot" if i % 3 == 0 else f"t{i}", "a") for i in range(600)]).select("doc_id", F.unhex(F.sha2("text", 256)).alias("digest"))
    rows = exact.heavy_winners(ids, counters=64).collect()
    assert [(r["keep_id"], r["group_size"]) for r in rows] == [(597, 200)]


def near_want(rows, k):
    sets, ids = defaultdict(list), {}
    for i, t in rows:
        w = words_of((t or "").translate(LOW))
        s = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
        sets[s].append(i)
        ids[i] = s
    every = [s for s in sets if s]
    root = {s: s for s in every}

    def find(s):
        while root[s] is not s:
            s = root[s]
        return s

    for a in range(len(every)):
        for b in range(a):
            x, y = every[a], every[b]
            if 100 * len(x & y) >= 80 * len(x | y) and find(x) is not find(y):
                root[find(x)] = find(y)
    low = {}
    for s in every:
        for i in sets[s]:
            if i is not None:
                low[find(s)] = min(low.get(find(s), i), i)
    return Counter((i, len(s), (low.get(find(s)) if s else i)) for s, v in sets.items() for i in v)


def near_rows():
    rnd = random.Random(4)
    rows = [(i, t) for i, t, _ in odd_rows()]
    for family in range(6):
        base = [f"w{rnd.randrange(500)}" for _ in range(rnd.choice([12, 60, 200]))]
        for copy in range(12 if family else 300):
            w = list(base)
            for _ in range(rnd.randrange(0, max(2, len(w) // 12))):
                w[rnd.randrange(len(w))] = f"z{rnd.randrange(9999)}"
            rows.append((1000 * (family + 1) + copy, " ".join(w)))
    return rows


@pytest.mark.parametrize("k", [2, 5])
def test_near_groups_are_exact_components(spark, k):
    rows = near_rows()
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, fp int")
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in minhash.near_groups(docs, k=k).collect())
    assert got == near_want(rows, k)


def twins(n):
    """Two words that sums of powers of any odd number cannot tell apart."""
    x = "a"
    while len(x) < n:
        x += x.translate(str.maketrans("ab", "ba"))
    return x, x.translate(str.maketrans("ab", "ba"))


def test_near_groups_tell_twin_words_apart(spark):
    a, b = twins(1024)
    rows = [(1, f"{a} {a}"), (2, f"{b} {b}"), (3, a), (4, b), (5, a)] + [(10 + i, x) for i, x in enumerate(twins(4096))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in minhash.near_groups(docs, k=2).collect()) == near_want(rows, 2)
    assert sorted(r["doc_id"] for r in minhash.near_dedup(docs).collect()) == [1, 2, 3, 4, 10, 11]


def test_near_groups_of_many_unnamed_and_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)  # the way of tables too large to be broadcast
    base = [f"w{i}" for i in range(200)]
    rows = [(None, " ".join(base[: 190 + i % 11])) for i in range(1000)] + [(7, " ".join(base))] * 1000 + [(8, "other words here")] * 3 + [(None, "lone text here")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = minhash.near_groups(docs, k=2)
    assert Counter((r["doc_id"], r["component_id"]) for r in got.collect()) == Counter({(None, 7): 1000, (7, 7): 1000, (8, 8): 3, (None, None): 2})
    assert sorted(map(str, (r["doc_id"] for r in minhash.near_dedup(docs, k=2).collect()))) == ["7", "8", "None"]


def test_bands_that_blocks_leave_open(spark):
    # two chains of copies: links between blocks are needed beyond those of the most central set
    base = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(base[i * 4 : i * 4 + 60])) for i in range(80)] + [(1000 + i, " ".join(base[:60] + [f"x{i}"])) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    rows_, sets = minhash.near_components(docs, k=2, block=4)
    got = {r["doc_id"]: r["component_id"] for r in rows_.join(sets, "fp").collect()}
    assert Counter((i, got[i]) for i, _ in rows) == Counter({(i, c): n for (i, _, c), n in near_want(rows, 2).items()})


def test_near_dedup_keeps_one_row_of_each_component(spark):
    rows = near_rows()
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, fp int")
    want = near_want(rows, 5)
    got = minhash.near_dedup(docs, k=5)
    assert got.columns == docs.columns
    kept = [r["doc_id"] for r in got.collect()]
    wordless = [i for (i, n, _), c in want.items() for _ in range(c) if n == 0]
    assert sorted(map(str, kept)) == sorted(map(str, [*{c for _, n, c in want if n}, *wordless]))
    assert minhash.near_dedup(docs.limit(0)).count() == minhash.near_groups(docs.limit(0)).count() == 0


def test_components_of_many_parts(spark, monkeypatch):
    rnd = random.Random(1)
    links = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(150)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, i) for i in range(1900, 2000)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    want = {x: find(x) for a, b in links for x in (a, b) if a != b}
    df = spark.createDataFrame(links, "a long, b long")
    for part in (200_000, 40):
        monkeypatch.setattr(graph, "PART", part)
        assert dict(graph.components(df).collect()) == want
    assert graph.components(df.limit(0)).count() == 0


def test_embeddings_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    rows, n = [], 0
    for c in range(30):
        centre = rng.normal(size=16)
        for _ in range(8 if c else 60):
            rows.append((n, [float(np.float32(x)) for x in centre + rng.normal(size=16) * 0.12], c % 3))
            n += 1
    rows += [(n, rows[0][1], 0), (n + 1, rows[0][1], None), (n + 2, None, 0), (n + 3, [0.0] * 16, 0), (n + 4, [float("nan")] * 16, 0), (n + 5, [1.0, 2.0], 0), (n + 6, [], 0), (n + 7, [None] + [1.0] * 15, 0), (n + 8, [1.0, 2.0], 0), (None, rows[0][1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    good = [(i, np.array(v, float), y) for i, v, y in rows if y is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    links = defaultdict(set)
    for a, (i, v, y) in enumerate(good):
        for b, (j, w, z) in enumerate(good):
            if a != b and y == z and len(v) == len(w) and v @ w / np.sqrt((v @ v) * (w @ w)) >= 0.93:
                links[a].add(b)
    want = {}
    for a, (i, _, _) in enumerate(good):
        seen, todo = {a}, [a]
        while todo:
            for b in links[todo.pop()] - seen:
                seen.add(b)
                todo.append(b)
        want[i] = (len(links[a]), min(good[b][0] for b in seen if good[b][0] is not None))
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in pq.embedding_groups(df, lists=8).collect()}
    assert all(got[i] == w for i, w in want.items())
    assert all(got[i] == (0, i) for i, _, _ in rows if i not in want)
    assert pq.embedding_groups(df.limit(0)).count() == 0


def lost_links(x, lists):
    """Links that lists and codes leave out, of all."""
    x = x / np.sqrt((x * x).sum(1))[:, None]
    radius = np.sqrt(2 - 2 * 0.93)
    model = pq.Model(x[: len(x) // 2], lists)
    home, out, visits, far = model.place(x, radius)
    codes, error = model.code(x, home)
    reach = np.array([out[home == c].max(initial=0) for c in range(lists)])
    seen = np.zeros((len(x), lists), bool)
    for i, v in enumerate(visits):
        seen[i, v[far[i, v] <= reach[v] + radius + pq.SLACK]] = True
    near = x @ x.T >= 0.93
    i, j = np.nonzero(near)
    met = seen[i, home[j]] | seen[j, home[i]]
    for c in range(lists):
        at = np.flatnonzero(home == c)
        met[np.isin(j, at)] &= (model.estimate(x, c, codes[at]) <= radius + error[at][None, :] + pq.SLACK)[i, np.searchsorted(at, j).clip(0, len(at) - 1)][np.isin(j, at)]
    return (~met).sum(), len(i) - len(x)


@pytest.mark.parametrize("dim", [64, 256, 1024])
def test_lists_and_codes_lose_no_link(dim):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(750, dim))
    spread_ = np.concatenate([base, base + rng.normal(size=base.shape) * 0.2])
    flat = rng.normal(size=(1500, 8)) @ rng.normal(size=(8, dim)) + rng.normal(size=(1500, dim)) * 0.05 * 8**0.5
    for x in (spread_, flat):
        lost, links = lost_links(x, 16)
        assert lost == 0 and links > 100


def test_line_chunks_shift_and_go_once(spark):
    rnd = random.Random(6)
    passage = [f"line {i} of a passage" for i in range(60)]
    rows = [(i, "\n".join([f"own {i} {j}" for j in range(rnd.randrange(5))] + passage + [f"end {i}"])) for i in range(20)] + [(50, None), (51, ""), (52, "a\nb"), (52, "a\nb"), (None, "a\nb\nc\nd\ne\nf")]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, n_lines int")
    out = lines.line_dedup(df)
    assert out.columns == df.columns
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    assert got[0] == rows[0][1] and got[50] is None and got[51] == "" and got[52] == "a\nb"
    assert all(sum(x in got[i].split("\n") for x in passage) <= 30 and f"end {i}" in got[i] for i in range(1, 20))
    assert lines.line_dedup(df.limit(0)).count() == 0


def brute_line_dedup(docs):
    """Texts by id after every later occurrence of two neighbouring lines, or of a line of LONE words, has gone."""
    known, off = set(), defaultdict(set)
    for i, t in sorted(docs):
        x = t.split("\n")
        for a in range(len(x)):
            for key in ([tuple(x[a : a + 2])] if a + 1 < len(x) else []) + ([x[a]] if len(words_of(x[a])) >= lines.LONE else []):
                if key in known:
                    off[i] |= {a, a + 1} if isinstance(key, tuple) else {a}
                known.add(key)
    return {i: "\n".join(y for a, y in enumerate(t.split("\n")) if a not in off[i]) for i, t in docs}


def test_lines_of_equal_hash_are_told_apart(spark, monkeypatch):
    docs = [(1, "a\nb\nc"), (2, "c\nd\ne"), (3, "x\na\nb"), (4, "twin one\ntwin two"), (5, "q\ntwin one\ntwin two")]
    weak = lines.segment_hashes
    monkeypatch.setattr(lines, "segment_hashes", lambda d, a, b, salt=0: weak(d, a, b, salt) & np.uint64(1 if salt == 0 else 2**64 - 1))
    out = {r["doc_id"]: r["text"] for r in lines.line_dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert out == brute_line_dedup(docs)


def test_repeated_passages_go_whole(spark):
    rnd, docs, passages = random.Random(3), [], []
    for m in (1, 2, 3, 5, 8, 20):
        for k in range(20):
            p = [f"line {m} {k} {i} é" for i in range(m)]
            passages.append(p)
            docs += [(len(docs) + c, "\n".join([f"before {c} {m} {k}"] * (k % 3 > 0) + p + [f"after {c} {m} {k}"] * (k % 4 > 0))) for c in range(2)]
    long = " ".join(f"w{i}" for i in range(60))
    docs += [(1000, long), (1001, f"x\n{long}\ny"), (1002, "\n\n\nq"), (1003, "q\n\n\n\n\nq"), (1004, "")]
    docs += [(2000 + i, "\n".join(rnd.choice(["a", "b", "c", "", "é"]) for _ in range(rnd.randrange(1, 9)))) for i in range(60)]
    out = {r["doc_id"]: r["text"] for r in lines.line_dedup(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).collect()}
    assert out == brute_line_dedup(docs)
    for n, p in enumerate(passages):
        left = set(out[2 * n + 1].split("\n")) & set(p)
        assert left == (set(p) if len(p) == 1 else set())
    assert out[1001] == "x\ny"
    kept = {y for t in out.values() for y in t.split("\n")}
    assert {y for _, t in docs for y in t.split("\n")} <= kept | {""}


def mix_targets(sizes, weights=(5, 2, 1)):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = 1.5 * sum(sizes.values()), set()
    while True:
        rest = total - sum(2 * sizes[s] for s in full)
        at = {s: 2 * sizes[s] if s in full else rest * w[s] / sum(w[x] for x in names if x not in full) for s in names}
        more = {s for s in names if s not in full and at[s] > 2 * sizes[s]}
        if not more:
            return at
        full |= more


def mix_digest(docs, **how):
    """Rows of a mix's plan with their shards, as op1_mixing gives them."""
    rows, blocks, extras, _ = mixing.plan(docs, "doc_id", "text", "source", **how)
    return mixing.shards_of(rows, mixing.dealt(blocks, None)[0], extras, "source", "block", "tag", "shards").withColumn("copies", F.size("shards")).collect()


def test_mix_meets_targets(spark):
    rnd = random.Random(8)
    rows = [(1000 + i, " ".join(["w"] * rnd.randrange(1, 60)), rnd.choice(["a", "a", "a", "b", "B", "é", None])) for i in range(500)] + odd_rows()
    rows += [(5, "ten words " * 5, "r")] * 400 + [(i, None, "empty") for i in range(3000, 3200)] + [(3500, "w " * 50, "empty")]
    docs = table(spark, rows)
    got = mix_digest(docs)
    assert len(got) == len(rows)
    sizes, taken = Counter(), Counter()
    for r in got:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["size"] * r["copies"]
        assert 0 <= r["copies"] <= 2
    want = mix_targets(sizes)
    assert {r["source"]: round(r["__target"], 6) for r in got} == {s: round(t, 6) for s, t in want.items()}
    assert {r["source"]: r["__source_size"] for r in got} == sizes
    longest = {s: max(r["size"] for r in got if r["source"] == s) for s in sizes}
    assert all(abs(taken[s] - want[s]) <= max(0.01 * want[s], longest[s]) for s in sizes)
    assert abs(taken["r"] - want["r"]) <= 10  # repeats are taken one by one
    mixed = mixing.mix(docs, shard_col="shard", levels=3)
    assert mixed.columns == [*docs.columns, "shard"] and mixed.rdd.getNumPartitions() == 8
    rows_of = Counter((r["doc_id"], r["text"], r["source"]) for r in mixed.collect())
    wanted = Counter()
    for r in got:
        wanted[r["doc_id"], r["source"], r["size"]] += r["copies"]
    assert Counter({(i, s, len(words_of(t))): 0 for i, t, s in rows} | {}) | wanted == wanted
    have = Counter()
    for (i, t, s), n in rows_of.items():
        have[i, s, len(words_of(t))] += n
    assert have == +wanted
    again = {(r["doc_id"], r["tag"]): r["copies"] for r in mix_digest(docs.repartition(7))}
    assert again == {(r["doc_id"], r["tag"]): r["copies"] for r in got}
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mix_fills_behind_a_long_document(spark):
    rows = []
    for s in range(24):
        rows += [(1000 * s + i, "w " * (9 + i % 3), f"s{s}" if s else None) for i in range(200)] + [(1000 * s + 999, "w " * (1500 + s), f"s{s}" if s else None)]
    rest, least = {}, {}
    for r in mix_digest(table(spark, rows), weights=(1,), share=0.3):
        assert r["copies"] <= 1
        rest[r["source"]] = rest.get(r["source"], r["__target"]) - r["size"] * r["copies"]
        if not r["copies"]:
            least[r["source"]] = min(r["size"], least.get(r["source"], r["size"]))
    assert len(rest) == 24 and all(0 <= rest[s] < least[s] for s in rest)


def test_splitting_tree_is_exact_and_disjoint(spark, monkeypatch):
    rows = [(s, b, 1 + (b % 2), b == 3) for s in ("a", "b", None) for b in range(20)]
    blocks = spark.createDataFrame(rows, "source string, block int, whole int, part boolean")
    monkeypatch.setattr(mixing, "RANKED", 7)
    got = mixing.split(blocks, levels=3).collect()
    assert Counter((r["source"], r["block"], r["copy"]) for r in got) == Counter((s, b, c) for s, b, w, p in rows for c in range(1, w + p + 1))
    per = Counter(r["shard"] for r in got)
    assert set(per) == set(range(8)) and max(per.values()) - min(per.values()) <= 1


PATTERNS = [re.compile(x) for x in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")]


def brute_spans(t):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in p.finditer(t):
            d = re.sub("[^0-9]", "", m[0])
            if k == 1 and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if k == 2 and not (12 <= len(d) <= 19 and sum((y := int(c) * (1 + i % 2)) - 9 * (y > 9) for i, c in enumerate(reversed(d))) % 10 == 0):
                continue
            if k == 3 and not 9 <= len(d) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_match_the_patterns():
    rnd = random.Random(3)
    parts = ["a", "1", "22", "255", "256", ".", "@", "-", "+", " ", "(", ")", "x.y", "@b.c", "é", "\n", "4111 1111 1111 1111", "+1 555 123 4567", "%", "_"]
    for _ in range(20_000):
        t = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14)))
        assert pii.base_spans(t) == brute_spans(t)
    assert pii.base_spans("9" * 200_000 + "@" * 1000 + "a." * 50_000) == brute_spans("9" * 2_000) == []


def brute_beliefs(rows, least=3, trust=0.8, accept=0.95):
    """word: kind by the scoring of the graph, from rows of (kind, fails, word, shape, pattern)."""
    import math

    seed, bad, form, met = {}, {}, {}, defaultdict(set)
    for k, f, w, sh, p in rows:
        seed[w], bad[w] = max(seed.get(w, -1), k), max(bad.get(w, -1), f)
        form[w] = min(form.get(w, sh), sh)
        met[p].add(w)
    shapes = {(k, form[w]) for w, k in seed.items() if k >= 0}
    needs = {k: max(least, math.ceil(math.log2(1 + sum(x == k for x in seed.values())))) for k in set(seed.values())}
    found = {}
    while True:
        score = {}
        for p, ws in met.items():
            for k in {seed[w] for w in ws if seed[w] >= 0}:
                own = sum(seed[w] == k for w in ws)
                if own < needs[k]:
                    continue
                mine = [w for w in ws if found.get(w) == k]
                against = sum(seed[w] >= 0 and seed[w] != k for w in ws) + sum(seed[w] < 0 and ((k, form[w]) not in shapes or bad[w] == k) and w not in mine for w in ws)
                s = (own + len(mine)) / (own + len(mine) + against + 1)
                if s >= trust:
                    score[p, k] = s
        now = {}
        for w in seed:
            if seed[w] < 0:
                best = [(1 - math.prod(1 - s for (p, k), s in score.items() if k == kind and w in met[p]), -kind) for kind in range(5) if bad[w] != kind and any(k == kind and w in met[p] for p, k in score)]
                best = max((b for b in best if b[0] >= accept), default=None)
                if best:
                    now[w] = -best[1]
        if len(now) <= len(found):
            return now
        found = now


def private_rows():
    rnd, h = random.Random(9), lambda: "".join(rnd.choice("0123456789abcdef") for _ in range(40))
    rows = [(i, f"please write to contact me at user{i}@mail.example.com today ok") for i in range(60)] + [(100, "please write to contact me at john7(at)hidden today ok")]
    rows += [(200 + i, f'w{i} token = "{h()}" end{i}') for i in range(40)] + [(300 + i, f"seen{i} in {h()} here{i}") for i in range(10)] + [(320 + i, f'x{i} token = "{"q" * (i + 3)}-{i}7" y') for i in range(5)]
    rows += [(400 + i, f"card{i} {4_000_000_000_000_000 + rnd.randrange(10**12)} z{i}") for i in range(60)]
    return rows + [(101, "the number 12345678 is fine"), (None, None), (102, ""), (103, "version 10.2.333.4 and 99999 of 2024-01-02"), (104, "a" * 3000 + " 12345 " + "b" * 3000)]


def test_contexts_find_unseen_identifiers(spark):
    rows = private_rows()
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, row int").repartition(3)
    got = {r["doc_id"]: r for r in pii.find_private(df).collect()}
    edges = [(s["kind"], s["fails"], s["word"], s["shape"], p) for r in pii.scan(df, "doc_id", "text").collect() for s in r["slots"] for p in s["patterns"]]
    want = brute_beliefs(edges)
    slots = {r["doc_id"]: r["slots"] for r in pii.scan(df, "doc_id", "text").collect()}
    for i, t in rows:
        spans = sorted([*brute_spans(t or ""), *((s["start"], s["kind"], s["end"]) for s in slots[i] if s["kind"] == 4), *((s["start"], want[s["word"]], s["end"]) for s in slots[i] if s["kind"] < 0 and s["word"] in want)])
        assert [tuple(s) for s in got[i]["spans"]] == spans and [tuple(s) for s in got[i]["base"]] == brute_spans(t or "")
    # a word in the place of many addresses, and secrets by their shape alone
    assert [tuple(s) for s in got[100]["spans"]] == [(30, 0, 45)] and got[100]["base"] == []
    assert all([s["kind"] for s in got[i]["spans"]] == [4] for i in [*range(200, 240), *range(300, 310)])
    assert all(got[i]["spans"] == got[i]["base"] for i in (*range(400, 460), 101, 102, 103, 104, None))  # numbers that fail the check of cards stay out
    assert len(got) == len(rows) and pii.find_private(df.limit(0)).count() == 0


def test_written_spans(spark):
    rows = [(1, "a@b.c 1.2.3.4"), (2, "+1 555 123 4567"), (3, None), (4, "x 4111 1111 1111 1111")]
    df = pii.find_private(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", pii.written(F.col("spans")).alias("w"))
    assert {r["doc_id"]: r["w"] for r in df.collect()} == {1: "email:0:5,ip:6:13", 2: "phone:0:15", 3: "", 4: "card:2:21"}


def test_bpe_matches_the_library(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_path())
    e = bpe.Encoder(bpe.merges_at(bpe.default_path()))
    rnd = random.Random(1)
    parts = ["a", "e", "th", "ing", " ", "  ", "\n", "\t", "'s", "'re", "'", "é", "ß", "1", "½", "!", "<|endoftext|>", "<|endof", " ", "日本", "🙂", "́", "\x1c", "\x85", "_", "\r\n", "ª", "Ⅷ", "\x00"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12))) for _ in range(3000)] + ["a" * 5000, "ab" * 4000, "=-" * 3000, "\n" * 5000, "1234567890" * 700, "etaoin" * 2000]
    flat, ends = e.ids(texts)
    at = 0
    for x, end in zip(texts, ends.tolist()):
        ids = t.encode(x, add_special_tokens=False).ids
        assert flat[at:end].tolist() == ids
        at = end
    for x in [*texts[:100], "a" * 60, " " * 50 + "b", "'" * 30 + "s" * 40, "日本" * 20, "x 's\n\ny"]:
        for block in (7, 64):
            assert np.concatenate([*e.stream(x * 20, block), np.zeros(0, np.int32)]).tolist() == t.encode(x * 20, add_special_tokens=False).ids
    for n in (512, 1024, 2048, 4096):
        both = [*twins(n), " ".join(twins(n))]
        flat, ends = e.ids(both)
        assert [flat[a:b].tolist() for a, b in zip([0, *ends[:-1]], ends)] == [t.encode(x, add_special_tokens=False).ids for x in both]
    df = spark.createDataFrame([(1, "a <|endoftext|> é🙂", 0), (2, None, 0), (2, "", 0), (None, "x" * 100_000, 0)], "doc_id long, text string, n_tokens int")
    got = bpe.encode_documents(df, ids=True)
    for r in got.collect():
        text = {r["ids_sha256"]: x for x in ("a <|endoftext|> é🙂", "", "x" * 100_000) if hashlib.sha256(np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes()).hexdigest() == r["ids_sha256"]}[r["ids_sha256"]]
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest() and r["n_tokens"] == len(r["ids"])
    assert {r[0] for r in got.select(bpe.decode_column()("ids")).collect()} == {"a <|endoftext|> é🙂", "", "x" * 100_000}
    assert bpe.encode_documents(df.limit(0)).count() == 0


def test_windows_of_a_long_run_change_nothing():
    m = bpe.merges_at(bpe.default_path())
    rnd = random.Random(5)
    run = "".join(rnd.choice("etaoinshr") for _ in range(6000))
    whole = m.merge([m.start[b] for b in run.encode()])
    for window in (1, 200, 500):
        assert bpe.Encoder(m, window).ids([run])[0].tolist() == whole
        assert np.concatenate(list(bpe.Encoder(m, window).stream(run, 900))).tolist() == whole


def test_equal_hashes_of_unequal_pretokens(monkeypatch):
    from tokenizers import Tokenizer

    t, text = Tokenizer.from_file(bpe.default_path()), "one two tow six longer words one two"
    monkeypatch.setattr(bpe, "lane_hashes", lambda value, place, count, size: np.zeros(len(count), np.uint64))
    assert bpe.Encoder(bpe.merges_at(bpe.default_path())).ids([text])[0].tolist() == t.encode(text, add_special_tokens=False).ids


def test_decoder_holds_back_open_characters():
    m = bpe.merges_at(bpe.default_path())
    d, data = bpe.Decoder(m), "aé日🙂".encode()
    assert "".join(d.feed_bytes(data[i : i + 1]) for i in range(len(data))) + d.feed_bytes(b"", last=True) == "aé日🙂"
    for bad in (b"\xf0\x9f\x98", b"\xff", b"\xe2\x28\xa1", b"\xc3"):
        d = bpe.Decoder(m)
        assert "".join(d.feed_bytes(bytes([b])) for b in bad) + d.feed_bytes(b"", last=True) == bad.decode("utf-8", "replace")


def best_cost(roles):
    """The least cost over all labellings: 3 for another label of a known role, 1 for joining the turn before, 2 for an empty turn."""
    least = [0 if not roles else 1 << 30]
    gap = {("", "s"): 0, ("", "u"): 0, ("", "a"): 2, ("s", "s"): 1, ("s", "u"): 0, ("s", "a"): 2, ("u", "u"): 1, ("u", "a"): 0, ("a", "a"): 1, ("a", "u"): 0}
    end = {"s": 4, "u": 2, "a": 0}

    def go(i, last, cost):
        if cost < least[0]:
            if i == len(roles):
                least[0] = min(least[0], cost + end[last])
            else:
                for label in sorted("sua", key=lambda x: x != roles[i]):
                    if (last, label) in gap:
                        go(i + 1, label, cost + gap[last, label] + 3 * (roles[i] not in ("", label)))

    go(0, "", 0)
    return least[0]


def test_role_repair_is_cheapest_and_legal(spark):
    rnd = random.Random(5)
    rows = [(c, t, rnd.choice(["user", "assistant", "system", "gpt", "tool", None]), rnd.choice([f"t{t}", "", None])) for c in [*range(20), None] for t in range(300 if c == 7 else rnd.randrange(1, 8))]
    rows += [(30, None, "user", "x"), (30, None, "user", "x"), (31, 0, "assistant", "only")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, role string, text string, place int")
    order = lambda r: (r[1] is None, r[1] or 0, r[2] is None, r[2] or "", r[3] is None, r[3] or "")
    seen = {}
    for piece in (3, 12):
        got = defaultdict(list)
        for r in chat.format_chats(df, piece=piece).collect():
            got[r["conv_id"]].append(r)
        for c, v in got.items():
            v.sort(key=lambda r: r["place"])
            roles = [{"user": "u", "assistant": "a", "gpt": "a", "system": "s"}.get(r[2], "") for r in sorted((r for r in rows if r[0] == c), key=order)]
            assert len(v) == len(roles)
            assert len(roles) > 20 or sum(r["cost"] for r in v) == best_cost(roles)
            text = "".join(r["piece"] for r in v)
            said = re.findall(r"<\|(\w+)\|>", text)
            said = said[said[0] == "system" :]
            assert said == ["user", "assistant"] * (len(said) // 2) and said
            assert seen.setdefault(c, text) == text
    assert chat.format_chats(df.limit(0)).count() == 0


def test_token_counts_by_document(spark, tmp_path, monkeypatch):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_path())
    t.encode_special_tokens = True
    monkeypatch.setattr(tokencount, "CLASSES", ((4, 3), (30, 2), (None, 1)))
    rows = [(i, (None, "", "a b", "word " * (i % 11), "é" * i, "long text " * i)[i % 6]) for i in range(60)] + [(7, "again"), (None, "no id")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet("file://" + str(tmp_path / "documents.parquet"))
    got = Counter((r["doc_id"], r["n_tokens"]) for r in tokencount.op10_token_counts(spark, "file://" + str(tmp_path)).collect())
    assert got == Counter((i, len(t.encode(x or "", add_special_tokens=False).ids)) for i, x in rows)


def test_token_files(spark, tmp_path, monkeypatch):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_path())
    t.encode_special_tokens = True
    texts = ["a b", None, "", "x" * 500, "<|endoftext|> y", "last one"]
    df = spark.createDataFrame([(x, 0) for x in texts], "text string, ids int").coalesce(1)
    monkeypatch.setattr(tokencount, "CLASSES", ((None, 100),))
    path = "file://" + str(tmp_path / "flat")
    tokencount.write_flat(df, path)
    want = [len(t.encode(x or "", add_special_tokens=False).ids) for x in texts]
    for block in (2, 6, 1 << 20):
        rows = tokencount.count_tokens(spark, path, block=block).orderBy("ordinal").collect()
        assert [r["n_tokens"] for r in rows] == want and [r["start"] for r in rows] == [sum(want[:i]) + i for i in range(len(want))]
    tokencount.write_flat(df.limit(0), path + "-empty")
    assert tokencount.count_tokens(spark, path + "-empty").count() == 0
    with pytest.raises(ValueError):
        tokencount.write_flat(df, path + "-narrow", width=1)
    own = tmp_path / "own"
    own.mkdir()
    (own / "a.bin").write_bytes(np.array([7, 50256, 50256, 8, 9], "<u2").tobytes() + b"\x01")
    (own / "b.bin").write_bytes(b"")
    for block in (2, 4, 1 << 20):
        assert [(r["ordinal"], r["start"], r["n_tokens"]) for r in tokencount.count_tokens(spark, str(own), block=block).orderBy("ordinal").collect()] == [(0, 0, 1), (1, 2, 0), (2, 3, 2)]


def test_quality_of_held_out_documents(spark, sf_dir):
    docs, labels = spark.read.parquet(sf_dir.replace("sf0.001", "sf0.01") + "/documents.parquet"), spark.read.parquet(sf_dir.replace("sf0.001", "sf0.01") + "/labels.parquet")
    field = quality.train(docs, labels)
    rows = quality.score_documents(docs, field).join(labels.select("doc_id", "quality"), "doc_id").where(quality.held_out(F.col("doc_id"))).select("score", "quality").collect()
    good, bad = [r[0] for r in rows if r[1] == 1], [r[0] for r in rows if r[1] == 0]
    assert len(bad) > 5 and sum(g > b for g in good for b in bad) >= 0.95 * len(good) * len(bad)
    assert sum((s >= quality.THRESHOLD) == bool(y) for s, y in rows) >= 0.95 * len(rows)


def test_quality_of_odd_rows(spark):
    docs = table(spark, odd_rows())
    labels = spark.createDataFrame([(1, 1, 0), (3, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    field = quality.train(docs, labels)
    assert all(0 <= r["score"] <= 1 for r in quality.score_documents(docs, field).collect())
    assert all(r["score"] == 0.5 for r in quality.score_documents(docs, quality.train(docs, labels.limit(0))).collect())
    assert quality.keep_good(docs, labels).columns == docs.columns and quality.keep_good(docs.limit(0), labels).count() == 0


def test_marginals_against_all_labellings():
    rng = np.random.default_rng(0)
    field = quality.Field(rng.normal(size=3), rng.normal(size=(2, 2)))
    x, first = rng.normal(size=(9, 3)).astype(np.float32), np.array([0, 1, 4, 9])
    got = field.marginals(x, first)
    for a, b in zip(first, first[1:]):
        total, good = 0.0, np.zeros(b - a)
        for code in range(2 ** (b - a)):
            y = [(code >> i) & 1 for i in range(b - a)]
            p = np.exp(sum(float(x[a + i] @ field.weight.astype(np.float32)) * v for i, v in enumerate(y)) + sum(field.pair[u, v] for u, v in zip(y, y[1:])))
            total += p
            good += p * np.array(y)
        assert np.allclose(got[a:b], good / total, atol=1e-5)
