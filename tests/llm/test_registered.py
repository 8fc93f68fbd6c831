"""Registered queries on the smallest tables against brute force, a library or SQL, and the pipeline's stages."""

from __future__ import annotations

import hashlib
import os
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from test_operators import LOW, best_cost, brute_line_dedup, brute_spans, mix_targets, near_want, words_of

from leafmill.llm import bpe, registry

NAMES = ("email", "ip", "card", "phone")


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").collect()


def columns(df):
    return {f.name: f.dataType.simpleString() for f in df.schema}


def run(spark, sf_dir, name, **types):
    df = registry.queries()[name](spark, sf_dir)
    got = columns(df)
    assert {k: got[k] for k in types} == types
    return df.collect()


def digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def test_op1(spark, sf_dir, docs):
    rows = run(spark, sf_dir, "op1_mixing", doc_id="bigint", size="bigint", source_size="bigint", target="double", taken="bigint")
    words, source = {r["doc_id"]: len(words_of(r["text"])) for r in docs}, {r["doc_id"]: r["source"] for r in docs}
    sizes, taken = Counter(), Counter()
    for r in rows:
        assert r["size"] == words[r["doc_id"]] and r["taken"] == r["size"] * r["copies"] <= 2 * r["size"] and len([x for x in r["shards"].split(",") if x]) == r["copies"]
        sizes[source[r["doc_id"]]] += r["size"]
        taken[source[r["doc_id"]]] += r["taken"]
    want = mix_targets(sizes)
    assert len(rows) == len(docs)
    for r in rows:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s] and abs(r["target"] - want[s]) < 1e-6
    least = {s: min((r["size"] for r in rows if source[r["doc_id"]] == s and r["copies"] < 2 and r["size"]), default=0) for s in sizes}
    assert all(-1e-6 <= want[s] - taken[s] <= max(least[s], 1) for s in sizes)
    # the targets once more, in SQL
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    got = dict(c.execute("SELECT source, sum(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))) FROM documents GROUP BY source").fetchall())
    assert got == dict(sizes)


def test_op2(spark, sf_dir, docs):
    rows = run(spark, sf_dir, "op2_pii", doc_id="bigint", **{f"n_{k}": "bigint" for k in NAMES}, base_sha256="string", spans="string")
    text = {r["doc_id"]: r["text"] for r in docs}
    for r in rows:
        spans = brute_spans(text[r["doc_id"]] or "")
        assert [r[f"n_{k}"] for k in NAMES] == [sum(s[1] == i for s in spans) for i in range(4)]
        written = [f"{NAMES[k]}:{s}:{e}" for s, k, e in spans]
        assert r["base_sha256"] == digest(",".join(written).encode())
        every = r["spans"].split(",") if r["spans"] else []
        assert set(written) <= set(every) and len(every) == r["n_spans"] and every == sorted(every, key=lambda x: (int(x.split(":")[1]), [*NAMES, "secret"].index(x.split(":")[0])))
    assert len(rows) == len(docs)


def test_op3(spark, sf_dir):
    turns = sorted(spark.read.parquet(f"{sf_dir}/conversations.parquet").collect(), key=lambda r: (r["conv_id"], r["turn"], r["role"], r["text"]))
    rows = run(spark, sf_dir, "op3_chat", conv_id="bigint", cost="bigint", piece="string")
    assert len(rows) == len(turns)
    for c in {r["conv_id"] for r in turns}:
        roles = [{"user": "u", "assistant": "a", "system": "s"}.get(r["role"], "") for r in turns if r["conv_id"] == c]
        if len(roles) <= 20:
            assert sum(r["cost"] for r in rows if r["conv_id"] == c) == best_cost(roles)


def test_op4(spark, sf_dir, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_path())
    t.no_truncation()
    t.no_padding()
    rows = {r["doc_id"]: r for r in run(spark, sf_dir, "op4_bpe", doc_id="bigint", n_tokens="bigint", ids_sha256="string", decoded_sha256="string")}
    for d in docs:
        ids = t.encode(d["text"] or "", add_special_tokens=False).ids
        r = rows[d["doc_id"]]
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), digest(np.array(ids, "<u4").tobytes()), digest(t.decode(ids, skip_special_tokens=False).encode()))


def test_op5(spark, sf_dir, docs):
    rows = run(spark, sf_dir, "op5_minhash", doc_id="bigint", n_shingles="bigint", component_id="bigint", kept="boolean")
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows) == near_want([(r["doc_id"], r["text"]) for r in docs], 2)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)


def test_op7(spark, sf_dir, docs):
    rows = run(spark, sf_dir, "op7_lines", doc_id="bigint", n_lines="bigint", n_removed="bigint", text_sha256="string")
    want = brute_line_dedup([(r["doc_id"], r["text"]) for r in docs])
    before = {r["doc_id"]: r["text"].count("\n") + 1 for r in docs}
    assert len(rows) == len(docs)
    for r in rows:
        assert r["text_sha256"] == digest(want[r["doc_id"]].encode()) and r["n_lines"] == before[r["doc_id"]]


def test_op9(spark, sf_dir, docs):
    rows = run(spark, sf_dir, "op9_quality", doc_id="bigint", held_out="boolean", score="double", predicted="int")
    assert len(rows) == len(docs)
    for r in rows:
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    label = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    known = [(r["predicted"], label[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in label]
    assert sum(a == b for a, b in known) >= 0.85 * len(known)


def test_op10(spark, sf_dir, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_path())
    t.encode_special_tokens = True
    rows = run(spark, sf_dir, "op10_token_counts", doc_id="bigint", n_tokens="bigint")
    assert {r["doc_id"]: r["n_tokens"] for r in rows} == {d["doc_id"]: len(t.encode(d["text"] or "", add_special_tokens=False).ids) for d in docs}


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_queries_agree_with_sql(spark, sf_dir, name):
    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{sf_dir}/{f}'")
    df, want = registry.queries()[name](spark, sf_dir), c.execute(registry.oracle_sql()[name])
    cols = [x[0] for x in want.description]
    assert sorted(cols) == sorted(df.columns)
    assert sorted(tuple(r[x] for x in cols) for r in df.collect()) == sorted(want.fetchall())


def test_pipeline(spark, sf_dir, docs):
    import corpus_pipeline as p

    assert [n for n, _ in p.STAGES] == ["quality_filter", "exact_dedup", "near_dedup", "mix_sources", "encode"]
    at = spark.read.parquet(f"{sf_dir}/documents.parquet")
    cols, seen = at.columns, {}
    for name, stage in p.STAGES:
        at = p.common.stage(stage(spark, at, sf_dir), f"test-{name}")
        seen[name] = at.collect()
        assert name == "encode" or at.columns == cols
    sizes = [len(docs), *(len(seen[n]) for n, _ in p.STAGES)]
    assert sizes[0] > sizes[1] > 0 and sizes[1] >= sizes[2] >= sizes[3] and sizes[4] == sizes[5]
    last = {}
    for r in seen["quality_filter"]:
        k = (r["text"] or "").translate(LOW)
        last[k] = max(last.get(k, -1), r["doc_id"])
    assert {r["doc_id"] for r in seen["exact_dedup"]} == set(last.values())
    near = near_want([(r["doc_id"], r["text"]) for r in seen["exact_dedup"]], 5)
    assert {r["doc_id"] for r in seen["near_dedup"]} == {c for _, _, c in near}
    assert {r["doc_id"] for r in seen["mix_sources"]} <= {r["doc_id"] for r in seen["near_dedup"]}
    assert sorted(r["doc_id"] for r in seen["encode"]) == sorted(r["doc_id"] for r in seen["mix_sources"])
    assert p.exact_dedup(spark, spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0), sf_dir).count() == 0


def test_pipeline_of_odd_rows(spark, sf_dir):
    import corpus_pipeline as p
    from test_operators import odd_rows, table

    at = table(spark, odd_rows())
    columns_, n = at.columns, at.count()
    for name, stage in p.STAGES[1:]:  # the first may drop any of these rows
        at = p.common.stage(stage(spark, at, sf_dir), f"odd-{name}")
        assert name == "encode" or at.columns == columns_
        if name == "exact_dedup":
            assert at.count() == len({(t or "").translate(LOW) for _, t, _ in odd_rows()}) < n
    assert {"bigint"} == {columns(at)["n_tokens"], columns(at)["doc_id"]} and at.count() > 0
    empty = table(spark, odd_rows()).limit(0)
    assert all(stage(spark, empty, sf_dir).count() == 0 for _, stage in p.STAGES)
