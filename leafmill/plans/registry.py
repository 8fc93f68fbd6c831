"""Queries over the driver's tables, each with the SQL that gives the same rows.

The tables hold no retrieval corpus, so: domain is label % 3, four vectors in a row are one parent's children,
the label is the cluster, and the query is vector 0.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from ..config import DEFAULT
from ..functions import text as T
from ..functions.vector import cosine, mean_pool
from ..operators import chunk, lexical, metrics, retrieve, search, segments, store, trainprep, tree
from ..staging import shared_root
from ..streaming import watch

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), (F.col("label") % 3).alias("domain"), F.expr("vec_id div 4").alias("parent_chunk_id"), "label", "embedding")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children and their parents in one table."""
    kids = vectors(spark, sf_dir).select(
        "id", F.col("domain").cast("string").alias("domain"), F.lit(0).alias("level"), F.lit(True).alias("is_searchable"), (F.col("parent_chunk_id") + 10_000_000).alias("parent_chunk_id"),
        F.lit(None).cast("string").alias("content"), F.lit("text").alias("content_type"), F.lit(None).cast("string").alias("language"), F.lit(1).alias("page_start"), F.lit(1).alias("page_end"), "embedding",
    )
    group = F.col("parent_chunk_id") - 10_000_000
    parents = kids.groupBy("parent_chunk_id").agg(F.min("domain").alias("domain")).select(
        F.col("parent_chunk_id").alias("id"), "domain", F.lit(0).alias("level"), F.lit(False).alias("is_searchable"), F.lit(None).cast("long").alias("parent_chunk_id"),
        F.concat(F.lit("passage "), group.cast("string")).alias("content"), F.when(group % 5 == 0, "code").otherwise("text").alias("content_type"), F.when(group % 5 == 0, "python").alias("language"),
        (group % 9 + 1).cast("int").alias("page_start"), (group % 9 + 1).cast("int").alias("page_end"), F.lit(None).cast("array<float>").alias("embedding"),
    )
    return kids.unionByName(parents)


def first_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return table(spark, sf_dir, "embeddings").where("vec_id = 0").first()["embedding"]


Q = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)"
SIM = f"list_cosine_similarity(embedding::DOUBLE[], {Q})"
HITS = f"hits AS (SELECT vec_id, vec_id // 4 AS parent_id, 1 - {SIM} AS dist FROM embeddings WHERE label % 3 = 0 ORDER BY dist, vec_id LIMIT 30)"
RANKED = HITS + ", ranked AS (SELECT parent_id, min(dist) AS best_dist, count(*) AS n_children_hit, arg_min(vec_id, {'d': dist, 'v': vec_id}) AS matched_child_id FROM hits GROUP BY parent_id), best AS (SELECT * FROM ranked ORDER BY best_dist, parent_id LIMIT 6)"


@query(f"WITH {HITS} SELECT vec_id AS id, parent_id, round(dist, 6) AS dist FROM hits")
def dense_topk_children(spark, d):
    hits = retrieve.dense_topk(vectors(spark, d).where("domain = 0").select("id", "parent_chunk_id", "embedding"), first_vector(spark, d), DEFAULT.top_k_children)
    return hits.select("id", F.col("parent_chunk_id").alias("parent_id"), F.round("dist", 6).alias("dist"))


@query(f"WITH {RANKED} SELECT parent_id, 'passage ' || parent_id AS content, round(1 - best_dist, 6) AS score, n_children_hit, matched_child_id FROM best")
def parent_child_retrieve(spark, d):
    got = retrieve.retrieve(chunks(spark, d), first_vector(spark, d), "0")
    return got.select((F.col("parent_id") - 10_000_000).alias("parent_id"), "content", F.round("score", 6).alias("score"), "n_children_hit", "matched_child_id")


@query(
    f"WITH {RANKED}, r AS (SELECT *, row_number() OVER (ORDER BY best_dist, parent_id) AS n FROM best) SELECT string_agg('[' || n || '] (p.' || (parent_id % 9 + 1) || ', score=' || printf('%.3f', 1 - best_dist) || ')' || chr(10) || "
    "CASE WHEN parent_id % 5 = 0 THEN '```python' || chr(10) || 'passage ' || parent_id || chr(10) || '```' ELSE 'passage ' || parent_id END, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY n) AS context FROM r"
)
def llm_context_pack(spark, d):
    return retrieve.llm_context(retrieve.retrieve(chunks(spark, d), first_vector(spark, d), "0"))


PARAS = r"""paras AS (SELECT doc_id, pos, trim(p) AS para FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS p, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents) WHERE trim(p) <> ''),
n AS (SELECT *, len(string_split(para, ' ')) AS tok FROM paras),
g AS (SELECT *, least(coalesce(sum((tok >= 40)::INT) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), greatest(sum((tok >= 40)::INT) OVER (PARTITION BY doc_id) - 1, 0))::INT AS par_ord FROM n),
merged AS (SELECT doc_id, par_ord, string_agg(para, chr(10) || chr(10) ORDER BY pos) AS content, count(*) AS n_parts FROM g GROUP BY doc_id, par_ord)"""


def merged_paragraphs(spark, d) -> DataFrame:
    docs = table(spark, d, "documents")
    parts = docs.select("doc_id", F.posexplode(F.filter(F.transform(F.split("text", "\n"), T.trim), lambda p: p != "")).alias("pos", "para"))
    return chunk.merge_paragraphs(parts.withColumn("tok", T.space_count(F.col("para"))), ["doc_id"], "pos", "para", "tok", DEFAULT.min_para_tokens)


@query(f"WITH {PARAS} SELECT doc_id, par_ord, n_parts, md5(content) AS digest FROM merged")
def paragraph_merge(spark, d):
    return merged_paragraphs(spark, d).select("doc_id", "par_ord", "n_parts", F.md5("content").alias("digest"))


@query(
    "WITH w AS (SELECT doc_id, string_split(text, ' ') AS t FROM documents), m AS (SELECT doc_id, t, len(t) AS n FROM w WHERE len(t) > 1200), s AS (SELECT doc_id, t, unnest(range(0, ceil((n - 350) / 290)::INT + 1)) AS shard FROM m) "
    "SELECT doc_id, shard::INT AS shard, len(t[shard * 290 + 1 : shard * 290 + 350])::INT AS token_count, md5(array_to_string(t[shard * 290 + 1 : shard * 290 + 350], ' ')) AS digest FROM s"
)
def shard_children(spark, d):
    toks = F.split("text", " ")
    rows = table(spark, d, "documents").where(F.size(toks) > DEFAULT.max_parent_tokens)
    return rows.select("doc_id", F.posexplode(T.shards(toks)).alias("shard", "w")).select("doc_id", "shard", F.size("w").alias("token_count"), F.md5(F.array_join("w", " ")).alias("digest"))


@query(
    f"WITH {PARAS}, p AS (SELECT doc_id, par_ord, content, string_split(replace(content, chr(10), ' '), ' ') AS t FROM merged), l AS (SELECT *, len(t) AS n FROM p), "
    "c AS (SELECT doc_id, par_ord, CASE WHEN n <= 1200 THEN 1 ELSE ceil((n - 350) / 290)::INT + 1 END AS n_children, n AS token_count FROM l) "
    "SELECT doc_id, count(*) AS n_parents, sum(n_children)::BIGINT AS n_children, sum(token_count)::BIGINT AS tokens FROM c GROUP BY doc_id"
)
def chunk_parents_children(spark, d):
    toks = lambda c: F.split(F.replace(c, F.lit("\n"), F.lit(" ")), " ")
    parents = merged_paragraphs(spark, d).withColumns({"raw": F.col("content"), "token_count": F.size(toks("content"))})
    kids = chunk.children(parents.withColumn("tokens", F.col("token_count").cast("long")), tokenize=toks)
    first = F.col("shard") == 0  # each parent's first child stands for it
    return kids.groupBy("doc_id").agg(F.count_if(first).alias("n_parents"), F.count("*").alias("n_children"), F.sum(F.when(first, F.col("tokens"))).alias("tokens"))


#: A source file of a document: its whole text as comments' place in a class and a function.
SOURCE_SQL = "'import os' || chr(10) || 'class A' || doc_id || ':' || chr(10) || '    def f(self): return 1' || chr(10) || text || chr(10) || 'def g(x):' || chr(10) || '    return x'"


def source_text():
    return F.concat(F.lit("import os\nclass A"), F.col("doc_id").cast("string"), F.lit(":\n    def f(self): return 1\n"), F.col("text"), F.lit("\ndef g(x):\n    return x"))


@query(
    f"WITH s AS (SELECT doc_id, string_split(regexp_replace({SOURCE_SQL}, '(?m)^([ \\t]*(?:def |async def |class |fn |pub fn |function |#include|namespace ))', chr(1) || '\\1', 'g'), chr(1)) AS parts FROM documents) "
    "SELECT doc_id, (i - 1)::INT AS block, md5(rtrim(parts[i], chr(10) || ' ')) AS content_md5 FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM s)"
)
def code_split(spark, d):
    """Whole texts inside of code."""
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(T.code_blocks(source_text())).alias("block", "raw"))
    return rows.select("doc_id", "block", F.md5(T.rstrip(F.col("raw"))).alias("content_md5"))


#: What stands before a document's text, by the remainder of its id.
HEADS = ("def f(x):\n  pass", "x = 1\nfrom a import b", "#include <v>\nint x;", "fn main() { let mut x = 1; }", "const a = () => { }", "std::vec", "plain words", "let x = 1; impl Foo")
LANGUAGE_SQL = "CASE WHEN regexp_matches(h, '(?m)\\bdef\\s+\\w+\\(|\\bimport\\s+\\w+|^from\\s+\\w+\\s+import') THEN 'python' WHEN regexp_matches(h, '#include\\s*<|::|std::') THEN 'cpp' WHEN regexp_matches(h, '\\bfn\\s+\\w+\\(|let\\s+mut\\b|impl\\s+\\w+') THEN 'rust' WHEN regexp_matches(h, '\\bfunction\\s+\\w+\\(|=>\\s*\\{|const\\s+\\w+\\s*=') THEN 'javascript' END"


@query(f"WITH c AS (SELECT doc_id, substr(CASE doc_id % 8 {' '.join(f"WHEN {i} THEN '" + h.replace(chr(10), "' || chr(10) || '") + "'" for i, h in enumerate(HEADS))} END || chr(10) || text, 1, 500) AS h FROM documents) SELECT doc_id, {LANGUAGE_SQL} AS language FROM c")
def detect_language(spark, d):
    heads = F.element_at(F.array(*map(F.lit, HEADS)), (F.col("doc_id") % 8 + 1).cast("int"))
    return table(spark, d, "documents").select("doc_id", T.detect_language(F.concat(heads, F.lit("\n"), "text")).alias("language"))


@query("SELECT sha256(text) AS sha256, min(doc_id) AS keep_id, count(*) AS n_copies FROM documents GROUP BY 1")
def content_hash_dedup(spark, d):
    return store.content_dedup(table(spark, d, "documents"))


@query(
    "WITH o AS (SELECT doc_id AS id, 'p' || doc_id AS source_path, source AS title, 1 AS n_pages, sha256(text) AS sha256 FROM documents), n AS (SELECT 'p' || (doc_id + 100) AS source_path, lang AS title, 2 AS n_pages, md5(text) AS sha256, doc_id FROM documents) "
    "SELECT coalesce(o.source_path, n.source_path) AS source_path, o.id, coalesce(n.title, o.title) AS title, coalesce(n.n_pages, o.n_pages)::INT AS n_pages, coalesce(n.sha256, o.sha256) AS sha256 FROM o FULL JOIN n ON o.source_path = n.source_path"
)
def document_upsert(spark, d):
    docs = table(spark, d, "documents")
    path = F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("source_path")
    old = docs.select(F.col("doc_id").alias("id"), path, F.col("source").alias("title"), F.lit(1).alias("n_pages"), F.sha2("text", 256).alias("sha256"))
    new = docs.select(F.concat(F.lit("p"), (F.col("doc_id") + 100).cast("string")).alias("source_path"), F.col("lang").alias("title"), F.lit(2).alias("n_pages"), F.md5("text").alias("sha256"))
    got = store.upsert_documents(old, new)
    known = old.select("source_path", F.col("id").alias("old_id"))
    return got.join(known, "source_path", "left").select("source_path", F.col("old_id").alias("id"), "title", "n_pages", "sha256")


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_leaves_anti(spark, d):
    return store.missing(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id").select("doc_id", "source")


@query("SELECT lang, count(*) AS n_missing FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) GROUP BY lang")
def orphan_count(spark, d):
    return store.missing(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id").groupBy("lang").agg(F.count("*").alias("n_missing"))


NODES_SQL = "nodes AS (SELECT 1000 + label AS id, list(vec_id ORDER BY vec_id) AS kids FROM embeddings GROUP BY label UNION ALL SELECT 2000 + label % 3, list(vec_id ORDER BY vec_id) FROM embeddings GROUP BY label % 3)"


@query(f"WITH {NODES_SQL}, e AS (SELECT id AS parent, unnest(kids) AS child FROM nodes) SELECT child AS id, array_to_string(list(parent ORDER BY parent), ',') AS parent_ids FROM e GROUP BY child")
def cluster_membership_edges(spark, d):
    v = vectors(spark, d)
    a = v.groupBy((F.col("label") + 1000).cast("long").alias("id")).agg(F.collect_list("id").alias("children_ids"))
    b = v.groupBy((F.col("domain") + 2000).cast("long").alias("id")).agg(F.collect_list("id").alias("children_ids"))
    got = store.link_parents(v.select("id", F.array().cast("array<long>").alias("parent_ids")), a.unionByName(b))
    return got.select("id", F.array_join(F.transform("parent_ids", lambda x: x.cast("string")), ",").alias("parent_ids"))


POOL = "e AS (SELECT vec_id // 4 AS parent_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings), m AS (SELECT parent_id, pos, avg(x) AS m FROM e GROUP BY parent_id, pos), p AS (SELECT parent_id, pos, m / sqrt(sum(m * m) OVER (PARTITION BY parent_id)) AS v FROM m)"


@query(f"WITH {POOL} SELECT parent_id, pos::INT AS pos, round(v, 6) AS v FROM p")
def mean_pool_parent(spark, d):
    pooled = mean_pool(vectors(spark, d).withColumnRenamed("parent_chunk_id", "parent_id"), ["parent_id"])
    return pooled.select("parent_id", F.posexplode("pooled").alias("pos", "v")).select("parent_id", "pos", F.round("v", 6).alias("v"))


@query("SELECT lang, source, count(*) AS n, min(len(string_split(text, ' ')))::INT AS min_tok, round(avg(len(string_split(text, ' '))))::INT AS avg_tok, max(len(string_split(text, ' ')))::INT AS max_tok FROM documents GROUP BY lang, source")
def chunk_stats(spark, d):
    return store.chunk_stats(table(spark, d, "documents").withColumn("token_count", T.space_count(F.col("text"))), ["lang", "source"])


@query("WITH t AS (SELECT len(string_split(text, ' ')) AS n FROM documents) SELECT (CASE WHEN n < 0 THEN 0 WHEN n >= 600 THEN 13 ELSE n // 50 + 1 END)::INT AS bucket, count(*) AS n FROM t GROUP BY 1")
def token_histogram(spark, d):
    return store.token_histogram(table(spark, d, "documents").withColumn("token_count", T.space_count(F.col("text"))))


@query("SELECT (label % 3)::INT AS domain, (CASE WHEN vec_id % 16 = 0 THEN 2 WHEN vec_id % 4 = 0 THEN 1 ELSE 0 END)::INT AS level, count(*) AS n, min(vec_id) AS first_id FROM embeddings GROUP BY 1, 2")
def tree_shape(spark, d):
    level = F.when(F.col("id") % 16 == 0, 2).when(F.col("id") % 4 == 0, 1).otherwise(0)
    return vectors(spark, d).groupBy("domain", level.alias("level")).agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


@query(
    f"WITH s AS (SELECT vec_id, {SIM} AS sim FROM embeddings), e AS (SELECT v.vec_id AS leaf, a.sim FROM s v JOIN s a ON a.vec_id = v.vec_id // 4 OR a.vec_id = v.vec_id // 16), "
    "b AS (SELECT leaf, max(sim) AS best FROM e GROUP BY leaf) SELECT s.vec_id AS leaf, round(sim + 0.3 * coalesce(best, 0), 6) AS score FROM s LEFT JOIN b ON b.leaf = s.vec_id ORDER BY sim + 0.3 * coalesce(best, 0) DESC, s.vec_id LIMIT 50"
)
def collapsed_rerank(spark, d):
    sims = vectors(spark, d).select("id", cosine(F.col("embedding"), retrieve.query_column(first_vector(spark, d))).alias("sim"))
    up = sims.select(F.col("id").alias("leaf"), F.explode(F.array(F.expr("id div 4"), F.expr("id div 16"))).alias("id")).distinct()
    above = up.join(sims, "id").select("leaf", "sim")
    got = retrieve.collapsed(sims.withColumnRenamed("id", "leaf"), above, DEFAULT.alpha)
    return got.orderBy(F.col("score").desc(), "leaf").limit(DEFAULT.fanout).select("leaf", F.round("score", 6).alias("score"))


@query(
    f"WITH s AS (SELECT vec_id, {SIM} AS sim, CASE WHEN vec_id < 8 THEN 2 WHEN vec_id < 32 THEN 1 ELSE 0 END AS level FROM embeddings), top AS (SELECT vec_id FROM s WHERE level = 2 ORDER BY sim DESC, vec_id LIMIT 6), "
    "mid AS (SELECT vec_id FROM s WHERE level = 1 AND vec_id // 4 IN (SELECT vec_id FROM top) ORDER BY sim DESC, vec_id LIMIT 6) SELECT vec_id AS id, round(sim, 6) AS sim FROM s WHERE level = 0 AND (vec_id % 24 + 8) IN (SELECT vec_id FROM mid)"
)
def beam_descend(spark, d):
    nodes = vectors(spark, d).withColumn("level", F.when(F.col("id") < 8, 2).when(F.col("id") < 32, 1).otherwise(0))
    edges = nodes.where("level < 2").select(F.when(F.col("level") == 1, F.expr("id div 4")).otherwise(F.col("id") % 24 + 8).alias("parent_id"), F.col("id").alias("child_id"))
    return retrieve.descend(nodes, edges, first_vector(spark, d), 2, DEFAULT.beam).select("id", F.round("sim", 6).alias("sim"))


@query(
    "WITH RECURSIVE up AS (SELECT vec_id AS leaf, vec_id // 4 AS ancestor, 1 AS n FROM embeddings WHERE vec_id > 0 UNION ALL SELECT leaf, ancestor // 4, n + 1 FROM up WHERE n < 3 AND ancestor > 0) SELECT DISTINCT leaf, ancestor FROM up"
)
def ancestor_closure(spark, d):
    edges = vectors(spark, d).where("id > 0").select(F.expr("id div 4").alias("parent_id"), F.col("id").alias("child_id"))
    return retrieve.ancestors(edges, DEFAULT.max_levels)


LISTS = f"a AS (SELECT vec_id AS id, row_number() OVER (ORDER BY 1 - {SIM}, vec_id) AS rank FROM embeddings), b AS (SELECT vec_id AS id, row_number() OVER (ORDER BY md5(vec_id::VARCHAR)) AS rank FROM embeddings), l AS (SELECT * FROM a WHERE rank <= 24 UNION ALL SELECT * FROM b WHERE rank <= 24)"


@query(f"WITH {LISTS} SELECT id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM l GROUP BY id")
def rrf_fusion(spark, d):
    k = 4 * DEFAULT.top_k_parents
    v = vectors(spark, d)
    dense = retrieve.dense_topk(v.select("id", "embedding"), first_vector(spark, d), k).select("id", F.row_number().over(Window.orderBy("dist", "id")).alias("rank"))
    other = v.select("id", F.md5(F.col("id").cast("string")).alias("o")).orderBy("o").limit(k).select("id", F.row_number().over(Window.orderBy("o")).alias("rank"))
    return retrieve.rrf(dense.unionByName(other), DEFAULT.rrf_k).select("id", F.round("score", 9).alias("score"))


def stop_list() -> str:
    return ", ".join(f"'{w}'" for w in lexical.STOP)


TFIDF = f"w AS (SELECT doc_id AS id, unnest(string_split_regex(lower(text), '[^a-z0-9]+')) AS term FROM documents), tf AS (SELECT id, term, count(*) AS tf FROM w WHERE term IN ('tion', 'ering', 'une', 'nicht') AND term NOT IN ({stop_list()}) GROUP BY id, term), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), lex AS (SELECT id, sum((1 + ln(tf)) * ln(1 + (SELECT count(*) FROM documents)::DOUBLE / df)) AS score FROM tf JOIN df USING (term) GROUP BY id)"


@query(f"WITH {TFIDF} SELECT id, round(score, 6) AS score FROM lex ORDER BY lex.score DESC, id LIMIT 20")
def lexical_search(spark, d):
    got = lexical.tf_idf(table(spark, d, "documents"), ["tion", "ering", "une", "nicht"])
    return got.orderBy(F.col("score").desc(), "id").limit(20).select("id", F.round("score", 6).alias("score"))


@query(
    f"WITH {TFIDF}, a AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM lex), b AS (SELECT vec_id AS id, row_number() OVER (ORDER BY 1 - {SIM}, vec_id) AS rank FROM embeddings), l AS (SELECT * FROM a WHERE rank <= 24 UNION ALL SELECT * FROM b WHERE rank <= 24), s AS (SELECT id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM l GROUP BY id) SELECT id, round(score, 9) AS score FROM s ORDER BY s.score DESC, id LIMIT 6"
)
def hybrid_search(spark, d):
    k = 4 * DEFAULT.top_k_parents
    dense = retrieve.dense_topk(vectors(spark, d).select("id", "embedding"), first_vector(spark, d), k).select("id", F.row_number().over(Window.orderBy("dist", "id")).alias("rank"))
    words = lexical.tf_idf(table(spark, d, "documents"), ["tion", "ering", "une", "nicht"]).orderBy(F.col("score").desc(), "id").limit(k)
    words = words.select("id", F.row_number().over(Window.orderBy(F.col("score").desc(), "id")).alias("rank"))
    got = retrieve.rrf(dense.unionByName(words), DEFAULT.rrf_k).orderBy(F.col("score").desc(), "id").limit(DEFAULT.top_k_parents)
    return got.select("id", F.round("score", 9).alias("score"))


TRI = "list_distinct(flatten(list_transform(list_filter(string_split_regex(lower({0}), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: list_transform(range(1, len(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


@query(f"WITH t AS (SELECT item_id AS id, {TRI.format('text')} AS a, {TRI.format(chr(39) + 'the thing' + chr(39))} AS q FROM benchmark), s AS (SELECT id, len(list_intersect(a, q))::DOUBLE / greatest(1, len(list_distinct(list_concat(a, q)))) AS score FROM t) SELECT id, round(score, 6) AS score FROM s WHERE score > 0")
def trigram_search(spark, d):
    return lexical.trigram(table(spark, d, "benchmark"), "the thing", id_col="item_id").select("id", F.round("score", 6).alias("score"))


@query(f"WITH t AS (SELECT doc_id AS id, {TRI.format('text')} AS a, {TRI.format(chr(39) + 'the thing' + chr(39))} AS q FROM documents), s AS (SELECT id, len(list_intersect(a, q))::DOUBLE / greatest(1, len(list_distinct(list_concat(a, q)))) AS score FROM t) SELECT id, round(score, 6) AS score FROM s WHERE score > 0")
def trigram_search_documents(spark, d):
    """The same over the whole of documents; ``trigram_search`` keeps its table and SQL."""
    return lexical.trigram(table(spark, d, "documents"), "the thing").select("id", F.round("score", 6).alias("score"))


@query("WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS t FROM documents) SELECT doc_id, count(*) AS n FROM w WHERE regexp_matches(t, '[0-9]') OR (regexp_matches(t, '[A-Z]') AND t = upper(t) AND length(t) <= 8) GROUP BY doc_id")
def identifier_tokens(spark, d):
    words = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", " ")).alias("t"))
    return words.where(T.is_identifier(F.col("t"))).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("SELECT doc_id, 1.0::DOUBLE AS score FROM documents WHERE contains(text, '@mail1.example.com')")
def identifier_containment(spark, d):
    return lexical.containing(table(spark, d, "documents"), "@mail1.example.com").select(F.col("id").alias("doc_id"), "score")


CENTRES = "ce AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings), cm AS (SELECT label, pos, avg(x) AS m FROM ce GROUP BY label, pos), c AS (SELECT label, list(m ORDER BY pos) AS centre FROM cm GROUP BY label)"
PAIRS = CENTRES + ", p AS (SELECT q.vec_id AS query_id, q.label AS own, (n.label % 3)::INT AS domain, n.label AS node, list_cosine_similarity(q.embedding::DOUBLE[], n.centre) AS sim FROM embeddings q, c n WHERE q.vec_id % 50 = 0)"


def centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """label, domain, embedding: the mean of each label's vectors."""
    return mean_pool(vectors(spark, sf_dir), ["label", "domain"], out="pooled").withColumnRenamed("pooled", "embedding")


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated queries: every vector whose id is divisible by 50."""
    return vectors(spark, sf_dir).where("id % 50 = 0").withColumnRenamed("id", "query_id")


@query(f"WITH {PAIRS}, b AS (SELECT query_id, domain, max(sim) AS sim FROM p GROUP BY query_id, domain), r AS (SELECT *, sim - lead(sim) OVER w AS lead, row_number() OVER w AS n FROM b WINDOW w AS (PARTITION BY query_id ORDER BY sim DESC, domain)) SELECT query_id, CASE WHEN lead IS NULL OR lead >= 0.05 THEN domain END AS domain, round(sim, 6) AS sim, round(lead, 6) AS lead FROM r WHERE n = 1")
def domain_route(spark, d):
    got = retrieve.route(asked(spark, d), centres(spark, d), 0.05)
    return got.select("query_id", "domain", F.round("sim", 6).alias("sim"), F.round("lead", 6).alias("lead"))


@query("WITH p AS (SELECT q.vec_id AS query_id, n.vec_id AS node, list_cosine_similarity(q.embedding::DOUBLE[], n.embedding::DOUBLE[]) AS sim FROM embeddings q, embeddings n WHERE q.vec_id % 50 = 0 AND n.vec_id <> q.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, node) AS n FROM p WHERE sim >= 0.4) SELECT query_id, node AS cached_id, round(sim, 6) AS sim FROM r WHERE n = 1")
def semantic_cache_hit(spark, d):
    got = retrieve.nearest(asked(spark, d), vectors(spark, d).withColumnRenamed("id", "cached_id"), "cached_id", 0.4, apart=True)
    return got.select("query_id", "cached_id", F.round("sim", 6).alias("sim"))


@query(f"WITH {CENTRES}, r AS (SELECT l.vec_id AS id, c.label AS cluster_id, list_cosine_similarity(l.embedding::DOUBLE[], c.centre) AS sim FROM embeddings l JOIN c ON l.label % 3 = c.label % 3), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, cluster_id) AS n FROM r) SELECT id, cluster_id, round(sim, 6) AS sim FROM k WHERE n = 1")
def nearest_cluster_assign(spark, d):
    cs = centres(spark, d).select(F.col("label").alias("cluster_id"), "domain", F.col("embedding").alias("centre"))
    got = watch.place(vectors(spark, d).select("id", "domain", "embedding"), cs)
    return got.select("id", "cluster_id", F.round("sim", 6).alias("sim"))


RANKS = "k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, node) AS rank FROM p), h AS (SELECT g.query_id, min(k.rank) AS rank FROM (SELECT DISTINCT query_id, own FROM p) g LEFT JOIN k ON k.query_id = g.query_id AND k.node = g.own GROUP BY g.query_id)"


@query(f"WITH {PAIRS}, {RANKS} SELECT count(*) AS n_queries, round(avg((coalesce(rank, 99) <= 1)::INT), 6) AS recall_1, round(avg((coalesce(rank, 99) <= 5)::INT), 6) AS recall_5, round(avg((coalesce(rank, 99) <= 10)::INT), 6) AS recall_10, round(avg(CASE WHEN rank <= 10 THEN 1.0::DOUBLE / rank ELSE 0 END), 6) AS mrr, round(avg(CASE WHEN rank <= 10 THEN 1.0::DOUBLE / log2(rank + 1) ELSE 0 END), 6) AS ndcg FROM h")
def recall_mrr_ndcg(spark, d):
    queries = asked(spark, d)
    sims = retrieve.similarities(queries, centres(spark, d).withColumnRenamed("label", "parent_id"), "parent_id")
    ranked = sims.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("sim").desc(), "parent_id")))
    gold = queries.select("query_id", F.col("label").alias("gold_parent_id"))
    got = metrics.retrieval_metrics(ranked, gold)
    return got.select("n_queries", *[F.round(c, 6).alias(c) for c in ("recall_1", "recall_5", "recall_10", "mrr", "ndcg")])


@query(
    "WITH u AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user'), a AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant'), w AS (SELECT u.conv_id, u.turn, list_filter(string_split_regex(lower(u.text), '[^a-z0-9]+'), lambda x: x <> '') AS x, list_filter(string_split_regex(lower(a.text), '[^a-z0-9]+'), lambda x: x <> '') AS y FROM u JOIN a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1), "
    "f AS (SELECT conv_id, turn, CASE WHEN len(x) + len(y) > 0 THEN 2.0::DOUBLE * coalesce(list_sum(list_transform(list_distinct(x), lambda t: least(len(list_filter(x, lambda q: q = t)), len(list_filter(y, lambda q: q = t))))), 0) / (len(x) + len(y)) ELSE 1.0 END AS f1 FROM w) SELECT conv_id, turn, round(f1, 6) AS f1, count(*) AS n FROM f GROUP BY ALL"
)
def token_f1(spark, d):
    t = table(spark, d, "conversations")
    u, a = t.where("role = 'user'").alias("u"), t.where("role = 'assistant'").alias("a")
    pairs = u.join(a, (F.col("u.conv_id") == F.col("a.conv_id")) & (F.col("a.turn") == F.col("u.turn") + 1))
    pairs = pairs.select("u.conv_id", "u.turn", F.col("u.text").alias("left"), F.col("a.text").alias("right"))
    return metrics.token_f1(pairs, "left", "right", ["conv_id", "turn"]).withColumn("f1", F.round("f1", 6)).groupBy("conv_id", "turn", "f1").agg(F.count("*").alias("n"))


EXAMPLES = "x AS (SELECT u.conv_id, u.turn, u.text AS instruction, CASE WHEN u.turn % 4 = 0 THEN '' ELSE 'turn ' || u.turn END AS input, a.text AS output FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant')"


def examples(spark, d) -> DataFrame:
    t = table(spark, d, "conversations")
    u, a = t.where("role = 'user'").alias("u"), t.where("role = 'assistant'").alias("a")
    rows = u.join(a, (F.col("u.conv_id") == F.col("a.conv_id")) & (F.col("a.turn") == F.col("u.turn") + 1))
    given = F.when(F.col("u.turn") % 4 == 0, "").otherwise(F.concat(F.lit("turn "), F.col("u.turn").cast("string")))
    return rows.select(F.col("u.text").alias("instruction"), given.alias("input"), F.col("a.text").alias("output"))


@query(f"WITH {EXAMPLES}, m AS (SELECT CASE WHEN input <> '' THEN instruction || chr(10) || chr(10) || input ELSE instruction END AS usr, output AS ans FROM x) SELECT md5(usr) AS user_md5, md5(ans) AS assistant_md5, count(*) AS n FROM m WHERE length(ans) > 10 AND usr <> '' AND len(string_split(usr || ' ' || ans, ' ')) <= 200 GROUP BY ALL")
def sft_prepare(spark, d):
    rows = trainprep.valid(trainprep.instructions_b(examples(spark, d)))
    rows = trainprep.fits(rows.withColumn("text", F.concat("user", F.lit(" "), "assistant")), most=200, count=T.space_count)
    return rows.groupBy(F.md5("user").alias("user_md5"), F.md5("assistant").alias("assistant_md5")).agg(F.count("*").alias("n"))


@query(f"WITH {EXAMPLES} SELECT md5('system:You are a helpful assistant.|user:' || CASE WHEN input <> '' THEN instruction || chr(10) || chr(10) || input ELSE instruction END || '|assistant:' || output) AS chat_md5, 3 AS n_messages, count(*) AS n FROM x GROUP BY ALL")
def chat_messages(spark, d):
    rows = trainprep.instructions_b(examples(spark, d))
    chat = trainprep.messages(("system", F.col("system")), ("user", F.col("user")), ("assistant", F.col("assistant")))
    rows = rows.withColumn("m", chat)
    text = F.array_join(F.transform("m", lambda x: F.concat(x["role"], F.lit(":"), x["content"])), "|")
    return rows.groupBy(F.md5(text).alias("chat_md5"), F.size("m").alias("n_messages")).agg(F.count("*").alias("n"))


@query("WITH r AS (SELECT doc_id AS id, quality = 1 AS ok, md5('0:' || doc_id) AS o FROM labels), b AS (SELECT * FROM r WHERE NOT ok ORDER BY o, id LIMIT 38), a AS (SELECT * FROM r WHERE ok ORDER BY o, id LIMIT (SELECT 128 - least(38, count(*)) FROM r WHERE NOT ok)) SELECT id, ok FROM a UNION ALL SELECT id, ok FROM b")
def calibration_stratified(spark, d):
    rows = table(spark, d, "labels").select(F.col("doc_id").alias("id"), (F.col("quality") == 1).alias("ok"))
    return trainprep.stratified(rows, F.col("ok"))


@query("SELECT doc_id FROM documents ORDER BY md5('0:' || doc_id), doc_id LIMIT 128")
def calibration_sample(spark, d):
    return trainprep.sample(table(spark, d, "documents").select("doc_id"), 128, 0, "doc_id")


@query(
    "SELECT md5(text) AS problem_md5, CASE WHEN turn % 3 = 2 THEN 'assert g()' ELSE 'assert f(' || conv_id || ')' || chr(10) || 'assert f(2)' END AS test_code, CASE WHEN turn % 3 = 2 THEN '' ELSE 'f' END AS entry_point FROM conversations WHERE role = 'user' AND turn % 3 <> 1 AND text <> ''"
)
def grpo_prepare(spark, d):
    """User turns as problems, with tests as JSON under either name or malformed."""
    c = F.col("conv_id").cast("string")
    full = F.concat(F.lit('{"test_cases": ["assert f('), c, F.lit(')", "assert f(2)"], "function_name": "f"}'))
    info = F.when(F.col("turn") % 3 == 0, full).when(F.col("turn") % 3 == 1, F.lit("{broken")).otherwise(F.lit('{"tests": ["assert g()"]}'))
    rows = table(spark, d, "conversations").where("role = 'user'").select(F.col("text").alias("prompt"), info.alias("verification_info"))
    chats = trainprep.coding_chats(trainprep.coding_a(rows))
    return chats.select(F.md5(F.element_at("prompt", 2)["content"]).alias("problem_md5"), "test_code", "entry_point")


COMPLETIONS = "c AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '<reasoning>' || text || '</reasoning>' || chr(10) || '<code>' || chr(10) || '```python' || chr(10) || 'x = ' || doc_id || chr(10) || '```' || chr(10) || '</code>' WHEN doc_id % 3 = 1 THEN text || chr(10) || '```' || chr(10) || 'y = ' || doc_id || chr(10) || '```' ELSE text END AS t FROM documents)"


def completions(spark, d) -> DataFrame:
    i = F.col("doc_id").cast("string")
    full = F.concat(F.lit("<reasoning>"), F.col("text"), F.lit("</reasoning>\n<code>\n```python\nx = "), i, F.lit("\n```\n</code>"))
    bare = F.concat(F.col("text"), F.lit("\n```\ny = "), i, F.lit("\n```"))
    return table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, full).when(F.col("doc_id") % 3 == 1, bare).otherwise(F.col("text")).alias("t"))


@query(f"WITH {COMPLETIONS} SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 0.5::DOUBLE ELSE 0.0 END AS format, CASE WHEN len(string_split(t, ' ')) >= 100 AND len(string_split(t, ' ')) < 800 THEN 0.1::DOUBLE ELSE 0.0 END AS length FROM c")
def reward_format_length(spark, d):
    return completions(spark, d).select("doc_id", T.reward_format(F.col("t")).alias("format"), T.reward_length(T.space_count(F.col("t"))).alias("length"))


@query(f"WITH {COMPLETIONS} SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'x = ' || doc_id WHEN 1 THEN 'y = ' || doc_id ELSE '' END AS code FROM c")
def extract_code(spark, d):
    return completions(spark, d).select("doc_id", T.python_code(F.col("t")).alias("code"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 0.25::DOUBLE ELSE 0.0 END AS reward FROM documents")
def reward_syntax(spark, d):
    """Whole texts as a string in code that parses, or after code that does not."""
    safe = F.replace(F.replace(F.replace("text", F.lit("\\"), F.lit(" ")), F.lit("'"), F.lit(" ")), F.lit("\u0000"), F.lit(" "))
    code = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("x = \'\'\'"), safe, F.lit("\'\'\'"))).otherwise(F.concat(F.lit("def (\n"), F.col("text")))
    return table(spark, d, "documents").select("doc_id", trainprep.reward_syntax(code).alias("reward"))


#: Documents as parsed pages: a line is a block, eight lines a page; every sixth block is an image, some text is in a code font.
BLOCKS = """b AS (SELECT doc_id, (pos // 8 + 1)::INT AS page, (pos % 8)::INT AS block, (pos % 8 = 5)::INT AS type, 40 + (doc_id % 50)::INT AS side, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS bare, line,
 pos % 4 = 2 AS code FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents)),
t AS (SELECT * FROM b WHERE type = 0 AND bare <> ''), im AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY block) AS idx FROM b WHERE type = 1 AND side * side >= 4096)"""
SEGS = BLOCKS + """, i AS (SELECT *, 2 * sum(code::INT) OVER (PARTITION BY doc_id, page ORDER BY block) - code::INT AS island FROM t),
s AS (SELECT doc_id, page, island, code, min(block) AS ord, string_agg(line, chr(10) ORDER BY block) AS text FROM i GROUP BY doc_id, page, island, code)"""
CAPTION_SQL = "(?i)^\\s*(fig(?:ure)?\\.?|table|chart|scheme|plot|diagram)\\b"
CAPTIONS = f"""n AS (SELECT im.doc_id, im.page, im.block, arg_min(t.bare, {{'g': t.block * 100 - (im.block * 100 + 90), 'b': t.block}}) AS caption FROM im JOIN t ON t.doc_id = im.doc_id AND t.page = im.page
 WHERE t.block * 100 >= im.block * 100 + 88 AND (regexp_matches(t.line, '{CAPTION_SQL}') OR t.block * 100 - (im.block * 100 + 90) < 40) GROUP BY im.doc_id, im.page, im.block)"""


def blocks(spark, d) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    block, side = F.col("pos") % 8, (40 + F.col("doc_id") % 50).cast("int")
    image, y = block == 5, block * 100.0
    font = F.when(F.col("pos") % 4 == 2, "Courier").otherwise("Times")
    spans = F.when(~image, F.array(F.struct(F.col("line").alias("text"), font.alias("font"))))
    box = F.struct(F.lit(0.0).alias("x0"), y.alias("y0"), F.lit(60.26).alias("x1"), (y + 90).alias("y1"))
    return rows.select("doc_id", (F.floor(F.col("pos") / 8) + 1).cast("int").alias("page"), block.alias("block"), image.cast("int").alias("type"), box.alias("bbox"), side.alias("width"), side.alias("height"), spans.alias("spans"), F.lit(100.0).alias("page_w"), F.lit(90.0).alias("page_h"))


@query(f"WITH {BLOCKS}, {CAPTIONS} SELECT im.doc_id, im.page, im.block, md5(coalesce(n.caption, '')) AS caption_md5 FROM im LEFT JOIN n USING (doc_id, page, block)")
def nearest_caption(spark, d):
    rows = blocks(spark, d)
    images = segments.image_blocks(rows).select("doc_id", "page", F.col("block").alias("img"), F.col("bbox.y1").alias("iy1"))
    texts = segments.text_blocks(rows).select("doc_id", "page", "block", F.col("bbox.y0").alias("by0"), "text")
    return segments.nearest_caption(images, texts).select("doc_id", "page", F.col("img").alias("block"), F.md5("caption").alias("caption_md5"))


@query(f"WITH {SEGS} SELECT doc_id, page, ord, CASE WHEN code THEN 'code' ELSE 'text' END AS kind, md5(text) AS text_md5, CASE WHEN code THEN (SELECT {LANGUAGE_SQL} FROM (SELECT substr(s.text, 1, 500) AS h)) END AS language FROM s")
def page_segments(spark, d):
    return segments.page_segments(blocks(spark, d)).select("doc_id", "page", "ord", "kind", F.md5("text").alias("text_md5"), "language")


SCANS = "sc AS (SELECT b.doc_id, b.page FROM b LEFT JOIN (SELECT doc_id, page, sum(length(bare)) AS chars FROM t GROUP BY doc_id, page) c USING (doc_id, page) WHERE b.type = 1 AND coalesce(c.chars, 0) < 100)"


@query(f"WITH {BLOCKS}, {SCANS} SELECT doc_id, page FROM sc")
def scanned_pages(spark, d):
    return segments.scanned_pages(blocks(spark, d))


@query(f"WITH {BLOCKS} SELECT doc_id, page, block, 'p' || lpad(page::VARCHAR, 4, '0') || '_img' || lpad(idx::VARCHAR, 2, '0') AS image_name, 60.3::DOUBLE AS x1 FROM im")
def image_blocks(spark, d):
    return segments.image_blocks(blocks(spark, d)).select("doc_id", "page", "block", "image_name", F.col("bbox.x1").alias("x1"))


@query(
    f"WITH {SEGS}, {CAPTIONS}, {SCANS}, u AS (SELECT doc_id, page, 0 AS rank, ord, CASE WHEN code THEN 'code' ELSE 'text' END AS kind, text, false AS is_scan FROM s UNION ALL "
    "SELECT im.doc_id, im.page, 1, im.block, 'image', coalesce(n.caption, ''), sc.page IS NOT NULL FROM im LEFT JOIN n USING (doc_id, page, block) LEFT JOIN sc ON sc.doc_id = im.doc_id AND sc.page = im.page) "
    "SELECT doc_id, page, (row_number() OVER (PARTITION BY doc_id ORDER BY page, rank, ord) - 1)::INT AS seg_ord, kind, md5(text) AS text_md5, is_scan FROM u"
)
def document_segments(spark, d):
    """Text, code and figures of all pages in one order."""
    return segments.document_segments(blocks(spark, d)).select("doc_id", "page", "seg_ord", "kind", F.md5("text").alias("text_md5"), "is_scan")


@query(f"WITH {BLOCKS}, {SCANS} SELECT count(*) FILTER (WHERE sc.page IS NULL AND im.doc_id % 3 <> 0) AS captioned, count(*) FILTER (WHERE sc.page IS NOT NULL AND im.doc_id % 3 <> 0) AS transcribed, count(*) FILTER (WHERE im.doc_id % 3 = 0) AS \"left\" FROM im LEFT JOIN sc ON sc.doc_id = im.doc_id AND sc.page = im.page")
def caption_counts(spark, d):
    """A model that fails for a third of the documents."""
    segs = segments.document_segments(blocks(spark, d))
    said = F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("seen "), "image_path"))
    return segments.caption_counts(segs, segments.caption_images(segs, said, said), ["doc_id", "seg_ord"])


@query("SELECT doc_id, 'domain' AS broken FROM documents WHERE lang = 'de' UNION ALL SELECT doc_id, 'no_code_in_trading' FROM documents WHERE lang = 'es' AND doc_id % 2 = 0 UNION ALL SELECT doc_id, 'language_only_for_code' FROM documents WHERE lang = 'fr' AND doc_id % 2 = 1")
def schema_violations(spark, d):
    domain = F.when(F.col("lang") == "de", "none").when(F.col("lang") == "es", "trading").otherwise("ai")
    kind = F.when(F.col("doc_id") % 2 == 0, "code").otherwise("text")
    rows = table(spark, d, "documents").select("doc_id", domain.alias("domain"), kind.alias("content_type"), F.when((F.col("lang") == "fr"), "python").alias("language"))
    return schemas.violations(rows).select("doc_id", F.array_join("broken", ",").alias("broken"))


@query("SELECT doc_id AS ref, coalesce((SELECT l.doc_id + 5000000 FROM (SELECT DISTINCT doc_id FROM labels) l WHERE l.doc_id = d.doc_id), doc_id) AS id FROM documents d")
def resolve_placeholders(spark, d):
    names = table(spark, d, "labels").select(F.col("doc_id").alias("placeholder"), (F.col("doc_id") + 5_000_000).alias("real")).distinct()
    return store.resolve_ids(table(spark, d, "documents").select(F.col("doc_id").alias("ref")), names)


@query("SELECT vec_id AS id FROM embeddings WHERE vec_id NOT IN (SELECT vec_id FROM embeddings WHERE label = 1) AND (vec_id = 0 OR vec_id // 4 NOT IN (SELECT vec_id FROM embeddings WHERE label = 1)) AND (vec_id // 4 = 0 OR vec_id // 16 NOT IN (SELECT vec_id FROM embeddings WHERE label = 1)) AND (vec_id // 16 = 0 OR vec_id // 64 NOT IN (SELECT vec_id FROM embeddings WHERE label = 1)) AND (vec_id // 64 = 0 OR vec_id // 256 NOT IN (SELECT vec_id FROM embeddings WHERE label = 1)) AND (vec_id // 256 = 0 OR vec_id // 1024 NOT IN (SELECT vec_id FROM embeddings WHERE label = 1)) AND (vec_id // 1024 = 0 OR vec_id // 4096 NOT IN (SELECT vec_id FROM embeddings WHERE label = 1))")
def cascade_delete(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("document_id"), F.when(F.col("vec_id") > 0, F.expr("vec_id div 4")).alias("parent_chunk_id"))
    return store.delete_documents(rows, spark.createDataFrame([(1,)], "id long")).select("id")


@query()
def soft_gmm_membership(spark, d):
    """Memberships of all vectors; cluster numbers depend on the fit."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return tree.soft_clusters(rows)


@query()
def build_tree(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.concat(F.lit("leaf "), F.col("vec_id").cast("string")).alias("content"), "embedding")
    return tree.build_tree(rows, ks=[4])


@query("SELECT sha256(item) AS sha256, count(*) AS n FROM (SELECT DISTINCT text AS item FROM benchmark) GROUP BY 1")
def stream_ingest_dedup(spark, d):
    """Files dropped in a folder, some of them twice; each content is ingested once."""
    base = f"{shared_root(spark)}/stream-{uuid.uuid4().hex[:12]}"
    items = table(spark, d, "benchmark").select("text")
    items.unionByName(items.limit(7)).repartition(8).write.option("maxRecordsPerFile", 1).text(f"{base}/in")
    stream = watch.watch(spark, f"{base}/in").select("path", F.sha2(F.expr("substring(content, 1, length(content) - 1)"), 256).alias("sha256"))
    watch.ingest(stream, f"{base}/out", f"{base}/state").awaitTermination()
    return spark.read.parquet(f"{base}/out").groupBy("sha256").agg(F.count("*").alias("n"))


TREE = f"""sims AS (SELECT vec_id AS id, {SIM} AS sim, CASE WHEN vec_id < 8 THEN 2 WHEN vec_id < 32 THEN 1 ELSE 0 END AS level FROM embeddings),
top2 AS (SELECT id FROM sims WHERE level = 2 ORDER BY sim DESC, id LIMIT 6), top1 AS (SELECT id FROM sims WHERE level = 1 AND id // 4 IN (SELECT id FROM top2) ORDER BY sim DESC, id LIMIT 6),
up AS (SELECT l.id, greatest(m.sim, t.sim) AS best FROM sims l JOIN sims m ON m.id = l.id % 24 + 8 JOIN sims t ON t.id = (l.id % 24 + 8) // 4 WHERE l.level = 0),
cand AS ((SELECT 'top_down' AS mode, id, sim AS score FROM sims WHERE level = 0 AND id % 24 + 8 IN (SELECT id FROM top1) ORDER BY sim DESC, id LIMIT 50) UNION ALL (SELECT 'collapsed', id, sim + 0.3 * best FROM sims JOIN up USING (id) WHERE level = 0 ORDER BY sim + 0.3 * best DESC, id LIMIT 50)),
ws AS (SELECT mode, id, unnest(string_split_regex(lower(text), '[^a-z0-9]+')) AS term FROM cand JOIN documents ON doc_id = id), tf AS (SELECT mode, id, term, count(*) AS tf FROM ws WHERE term IN ('tion', 'une', 'der') GROUP BY ALL),
df AS (SELECT mode, term, count(*) AS df FROM tf GROUP BY ALL), nn AS (SELECT mode, count(*) AS n FROM cand GROUP BY mode), lex AS (SELECT mode, id, sum((1 + ln(tf)) * ln(1 + n::DOUBLE / df)) AS score FROM tf JOIN df USING (mode, term) JOIN nn USING (mode) GROUP BY mode, id),
rk AS (SELECT *, row_number() OVER (PARTITION BY mode ORDER BY score DESC, id) AS r FROM cand UNION ALL SELECT *, row_number() OVER (PARTITION BY mode ORDER BY score DESC, id) FROM lex), rrf AS (SELECT mode, id, sum(1.0::DOUBLE / (60 + r)) AS score FROM rk WHERE r <= 24 GROUP BY mode, id),
hit AS (SELECT mode, 'dense' AS fusion, id, score FROM cand UNION ALL SELECT mode, 'lexical', id, score FROM lex UNION ALL SELECT mode, 'hybrid', id, score FROM rrf),
par AS (SELECT mode, fusion, id // 4 AS parent_id, max(score) AS score, count(*) AS n_children_hit FROM hit GROUP BY ALL), best AS (SELECT *, row_number() OVER (PARTITION BY mode, fusion ORDER BY score DESC, parent_id) AS n FROM par)"""


def searched(spark, d) -> tuple[DataFrame, DataFrame]:
    """(chunks, edges): vectors as leaves and two levels above them, with the texts of the documents of the same number."""
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    level = F.when(F.col("id") < 8, 2).when(F.col("id") < 32, 1).otherwise(0)
    chunks = vectors(spark, d).withColumn("level", level).withColumn("is_searchable", F.lit(True)).join(texts, "id", "left")
    edges = chunks.where("level < 2").select(F.when(F.col("level") == 1, F.expr("id div 4")).otherwise(F.col("id") % 24 + 8).alias("parent_id"), F.col("id").alias("child_id"))
    return chunks, edges


@query(f"WITH {TREE} SELECT mode, fusion, parent_id, round(score, 6) AS score, n_children_hit FROM best WHERE n <= 6")
def search_modes(spark, d):
    """All six ways to search, by the same request otherwise."""
    chunks, edges = searched(spark, d)
    out = None
    for mode in search.MODES:
        for fusion in search.FUSIONS:
            got = search.search(chunks, edges, search.Request("tion une der", mode, fusion), first_vector(spark, d))
            got = got.select(F.lit(mode).alias("mode"), F.lit(fusion).alias("fusion"), "parent_id", F.round("score", 6).alias("score"), "n_children_hit")
            out = got if out is None else out.unionByName(got)
    return out


STORED = "n AS (SELECT 1000000 + label AS id, 1 AS level, list(vec_id) AS kids, 'summary of  ' || label AS content FROM embeddings GROUP BY label), m AS (SELECT 1000000 + label AS parent, vec_id FROM embeddings)"


@query(f"WITH {STORED} SELECT vec_id AS id, 0 AS level, 1::BIGINT AS n_parents, 0::BIGINT AS n_children, NULL::INT AS token_count, NULL AS content FROM m UNION ALL SELECT id, level, 0, len(kids), 3, content FROM n")
def stored_summaries(spark, d):
    """Summary rows among chunks, and the chunks pointing back to them."""
    v = vectors(spark, d)
    empty = F.array().cast("array<long>")
    chunks = v.select("id", F.lit(0).alias("level"), F.lit(True).alias("is_searchable"), empty.alias("parent_ids"), empty.alias("children_ids"), F.lit(None).cast("string").alias("content"), F.lit(None).cast("int").alias("token_count"), "embedding")
    nodes = v.groupBy("label").agg(F.collect_list("id").alias("children_ids")).select((F.col("label") + 1_000_000).cast("long").alias("id"), F.lit(1).alias("level"), "children_ids", F.concat(F.lit("summary of  "), F.col("label").cast("string")).alias("content"))
    got = store.insert_summaries(chunks, nodes)
    return got.select("id", "level", F.size("parent_ids").cast("long").alias("n_parents"), F.size("children_ids").cast("long").alias("n_children"), "token_count", "content")


@query("SELECT 'leaves' AS what, count(*) AS n FROM embeddings UNION ALL SELECT 'unembedded', 0 UNION ALL SELECT 'childless', 0 UNION ALL SELECT 'orphans', count(*) FILTER (WHERE label % 3 = 0) FROM embeddings")
def store_readiness(spark, d):
    v = vectors(spark, d)
    nodes = v.where("domain <> 0").groupBy("label").agg(F.collect_list("id").alias("children_ids"))
    return store.readiness(v.withColumn("level", F.lit(0)), nodes)


@query("SELECT doc_id AS id, coalesce(quality, -1)::INT AS quality FROM (SELECT doc_id, quality FROM labels UNION ALL SELECT doc_id, NULL FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels))")
def append_missing(spark, d):
    old = table(spark, d, "labels").select("doc_id", "quality")
    new = table(spark, d, "documents").select("doc_id", F.lit(None).cast("int").alias("quality"))
    return store.append_missing(old, new, "doc_id").select(F.col("doc_id").alias("id"), F.coalesce("quality", F.lit(-1)).alias("quality"))


@query("SELECT l.doc_id AS id, d.source || '/' || d.doc_id AS source_path, d.lang AS title FROM labels l JOIN documents d ON d.doc_id = l.doc_id WHERE contains(d.source || '/' || d.doc_id, 'src1')")
def chunks_of_source(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("source_path"), F.col("lang").alias("title"))
    chunks = table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("document_id"))
    return store.with_documents(chunks, docs, "src1").select("id", "source_path", "title")


@query("WITH t AS (SELECT trim(regexp_replace(text, '\\s+', ' ', 'g')) AS x, doc_id FROM documents) SELECT doc_id, CASE WHEN length(x) > 100 THEN left(x, 99) || '…' ELSE x END AS short FROM t")
def shortened_text(spark, d):
    return table(spark, d, "documents").select("doc_id", T.shortened(F.col("text"), 100).alias("short"))


@query("WITH w AS (SELECT u.conv_id, u.turn, list_filter(string_split_regex(lower(a.text), '[^a-z0-9]+'), lambda x: x <> '') AS x, list_filter(string_split_regex(lower(u.text), '[^a-z0-9]+'), lambda x: x <> '') AS y FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant') SELECT conv_id, turn, round(CASE WHEN len(x) > 0 THEN coalesce(list_sum(list_transform(list_distinct(x), lambda t: least(len(list_filter(x, lambda q: q = t)), len(list_filter(y, lambda q: q = t))))), 0)::DOUBLE / len(x) END, 6) AS faithfulness FROM w")
def answer_faithfulness(spark, d):
    t = table(spark, d, "conversations")
    u, a = t.where("role = 'user'").alias("u"), t.where("role = 'assistant'").alias("a")
    pairs = u.join(a, (F.col("u.conv_id") == F.col("a.conv_id")) & (F.col("a.turn") == F.col("u.turn") + 1)).select("u.conv_id", "u.turn", F.col("a.text").alias("answer"), F.col("u.text").alias("context"))
    return metrics.faithfulness(pairs, "answer", "context", ["conv_id", "turn"]).withColumn("faithfulness", F.round("faithfulness", 6))


@query("SELECT 2::INT AS depth, count(*) AS n_nodes, 0::BIGINT AS n_singletons, 0::BIGINT AS n_orphans FROM embeddings")
def tree_report(spark, d):
    chunks, edges = searched(spark, d)
    return metrics.tree_report(chunks, edges)


@query("SELECT md5(trim(text)) AS question_md5, count(*) AS n FROM conversations WHERE role = 'user' AND trim(text) <> '' GROUP BY 1")
def coder_rows(spark, d):
    rows = trainprep.coder_rows(table(spark, d, "conversations").where("role = 'user'").select(F.col("text").alias("problem"), F.lit("x").alias("solution")))
    return rows.groupBy(F.md5("question").alias("question_md5")).agg(F.count("*").alias("n"))


@query("SELECT md5('Context:' || chr(10) || left(d.text, 1500) || chr(10) || chr(10) || 'Question: ' || b.text || chr(10) || chr(10) || 'Answer:') AS prompt_md5 FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % 40")
def grounded_prompts(spark, d):
    docs, items = table(spark, d, "documents"), table(spark, d, "benchmark").select("item_id", F.col("text").alias("q"))
    return docs.join(items, F.col("item_id") == F.col("doc_id") % 40).select(F.md5(trainprep.grounded_prompt(F.col("text"), F.col("q"))).alias("prompt_md5"))


@query("SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY md5('0:' || doc_id), doc_id) AS n FROM documents) WHERE n <= 20")
def capped_sources(spark, d):
    return trainprep.capped(table(spark, d, "documents"), "source", 20).select("source", "doc_id")


@query("SELECT id, domain, CASE WHEN n % 2 = 1 THEN 'paraphrase' ELSE 'exact' END AS kind FROM (SELECT vec_id AS id, (label % 3)::INT AS domain, row_number() OVER (PARTITION BY label % 3 ORDER BY md5('0:' || vec_id), vec_id) AS n FROM embeddings) WHERE n <= 100")
def question_sample(spark, d):
    return trainprep.question_sample(vectors(spark, d).select("id", F.col("domain").cast("int").alias("domain")))


@query("SELECT 'd' AS which, count(*) AS n FROM documents UNION ALL SELECT 'b', count(*) FROM benchmark")
def concatenated(spark, d):
    docs = table(spark, d, "documents").select("text", F.lit("d").alias("which"))
    return trainprep.all_of(docs, table(spark, d, "benchmark").select(F.lit("b").alias("which"), "text")).groupBy("which").agg(F.count("*").alias("n"))


@query("WITH p AS (SELECT item_id AS cand, substr(text, 1, 1500) AS context FROM benchmark) SELECT (SELECT count(*) FROM documents) AS n_rows, (SELECT count(*) FROM documents) AS n_three, 0::BIGINT AS n_foreign")
def distractor_contexts(spark, d):
    """Rows with three parts, and parts that are neither the row's own nor of the pool."""
    pool = table(spark, d, "benchmark").select(F.col("item_id").alias("cand"), F.concat(F.lit("item "), F.col("item_id").cast("string")).alias("context"))
    got = trainprep.distractors(table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("own "), F.col("doc_id").cast("string")).alias("context")), pool)
    parts = F.split("retrieved", "\n\n---\n\n")
    known = F.filter(parts, lambda x: (x == F.col("context")) | x.rlike("^item [0-9]+$"))
    return got.agg(F.count("*").alias("n_rows"), F.count_if(F.size(F.array_distinct(parts)) == 3).alias("n_three"), F.sum(F.size(parts) - F.size(known)).alias("n_foreign"))


@query(f"WITH {CENTRES}, r AS (SELECT l.vec_id AS id, c.label AS cluster_id, list_cosine_similarity(l.embedding::DOUBLE[], c.centre) AS sim FROM embeddings l JOIN c ON l.label % 3 = c.label % 3 WHERE l.vec_id % 50 = 0), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, cluster_id) AS n FROM r), e AS (SELECT label AS cluster_id, vec_id AS id FROM embeddings WHERE vec_id % 50 <> 0 UNION SELECT cluster_id, id FROM k WHERE n = 1) SELECT cluster_id, count(*) AS n FROM e GROUP BY cluster_id HAVING count(*) > 40")
def stale_clusters(spark, d):
    """Clusters that have grown too large once new leaves are placed."""
    v = vectors(spark, d)
    cs = centres(spark, d).select(F.col("label").alias("cluster_id"), "domain", F.col("embedding").alias("centre"))
    place = watch.incremental(cs, lambda files: files)
    placed = place(v.where("id % 50 = 0").select("id", "domain", "embedding"))
    return watch.to_summarise(v.where("id % 50 <> 0").select("id", F.col("label").alias("cluster_id")), placed, 40)


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
