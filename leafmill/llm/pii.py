"""Personal data: fixed patterns as seeds, and contexts learned from them that find more.

1. ``base_spans`` finds e-mail addresses, IP addresses, card and phone numbers by their form; ``secrets`` finds values that
   are assigned to a name like token or password. These are the seeds.
2. Every seed has patterns: the word before it with what stands between, the two words before it, the words on either
   side, and its shape (runs of letters and digits). Other identifier-like words (with a digit or an @) are instances
   of unknown kind, with patterns of their own; some are known not to be of a kind, as they fail its checks.
3. On the graph of patterns and instances Spark scores in turns until no instance is added. For a kind, a pattern's instances
   of that kind speak for it; those of other kinds, those that fail the kind's checks, and unknown ones of shapes that
   the kind's seeds never have speak against it. Unknown ones of a known shape do neither, as they are what is sought.
   A pattern counts if it has seeds enough, which grows with the logarithm of the kind's seeds. An instance is believed by the
   chance that not all its patterns are wrong.
4. Instances whose belief reaches ``ACCEPT`` are added to the spans; base spans always stay.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructType

from .arrays import tidy
from .common import small, stage

#: The base kinds, and the one that the method adds.
KINDS = ("email", "ip", "card", "phone")
SECRET = len(KINDS)
#: Least seeds of a pattern, and beliefs from which patterns and words count.
LEAST, TRUST, ACCEPT = 3, 0.8, 0.95

DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DIGIT = re.compile(r"[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")
WORDLIKE = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+")
#: Characters of texts in work at a time.
SLICE = 500_000
EDGE = "\"'()[]{}<>,.;:!?*#$%&|="


def emails(text: str):
    """Leftmost matches of local@domain: found from each @, whose local part is the run before it."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            done = m.end()
            yield start, done
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of everything that the fixed patterns find, sorted."""
    found = [(s, 0, e) for s, e in emails(text)]
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split(".")):
                found.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 12 and 12 <= len(digits := NOT_DIGIT.sub("", m[0])) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
        for m in PHONE.finditer(text):
            if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


ASSIGNED = re.compile(r"[=:]\s{0,3}[\"']?([^\s\"',;]{12,})")
NAMED = re.compile(r"(?:token|secret|passwor[dt]|passwd|api[_-]?key|access[_-]?key)[\"']?\s{0,3}$", re.I)
HEX = re.compile(r"(?=[0-9a-f]*[a-f])(?=[0-9a-f]*[0-9])[0-9a-f]{16,}$")
RUNS = re.compile(r"[0-9]+|[^\W\d_]+")


def secrets(text: str) -> list[tuple[int, int]]:
    """Start and end of values with letters and digits that are assigned to a telling name."""
    out = []
    for m in ASSIGNED.finditer(text):
        value = m[1]
        if NAMED.search(text[max(0, m.start() - 24) : m.start()]) and DIGIT.search(value) and any(c.isalpha() for c in value):
            out.append(m.span(1))
    return out


def shape(word: str) -> str:
    """Runs of digits with their length, runs of letters without; a hexadecimal word only by its length."""
    if HEX.match(word):
        return f"x{len(word)}"
    return key_of(RUNS.sub(lambda m: f"d{len(m[0])}" if m[0][0].isdigit() else "a", word))


def around(text: str, start: int, end: int) -> tuple[list[str], str, str]:
    """The two words before a place, what stands between the last of them and the place, and the word after it."""
    reach = 64
    while True:  # whole words, however long
        lo = max(0, start - reach)
        found = [m for m in re.finditer(r"\w+", text[lo:start])][-3:]
        if lo == 0 or len(found) == 3:
            break
        reach *= 4
    before = [key_of(m[0]) for m in found[-2:]]
    between = " ".join(text[lo + found[-1].end() : start].split()) if found else ""
    reach = 64
    while True:
        m = re.search(r"\w+", text[end : end + reach])
        if (m and m.end() < reach) or end + reach >= len(text):
            return before, key_of(between), key_of(m[0]) if m else ""
        reach *= 4


def contexts(text: str, start: int, end: int) -> list[str]:
    """Patterns of a place: by the words around it, and by its own shape."""
    before, between, after = around(text, start, end)
    out = ["S:" + shape(text[start:end])]
    if before:
        out.append(f"1:{before[-1]} {between}")
        if after:
            out.append(f"B:{before[-1]} _ {after}")
    if len(before) == 2:
        out.append("2:" + " ".join(before))
    return out


def fails(word: str) -> int:
    """The kind whose form a word has without passing its checks, or -1."""
    if word.isascii() and word.isdigit() and 12 <= len(word) <= 19:
        return 2
    return 1 if IP.fullmatch(word) else -1


def key_of(word: str) -> str:
    return word.lower() if len(word) <= 64 else hashlib.sha256(word.lower().encode()).hexdigest()


def others(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Identifier-like words that no base span touches."""
    out, i = [], 0
    by_start = sorted(spans)
    reach = 0
    for m in WORDLIKE.finditer(text) if "@" in text or DIGIT.search(text) else ():
        while i < len(by_start) and by_start[i][0] < m.end():
            reach = max(reach, by_start[i][2])
            i += 1
        if reach > m.start():
            continue
        word = m[0]
        left = len(word) - len(word.lstrip(EDGE))
        bare = word.strip(EDGE)
        if len(bare) >= 5 and ("@" in bare or DIGIT.search(bare)):
            out.append((m.start() + left, m.start() + left + len(bare)))
    return out


def scan(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per row: doc_id, base (start, kind, end) and slots (start, end, kind or -1, word, patterns)."""
    span = StructType().add("start", IntegerType()).add("kind", IntegerType()).add("end", IntegerType())
    slot = StructType().add("start", IntegerType()).add("end", IntegerType()).add("kind", IntegerType()).add("fails", IntegerType()).add("word", StringType()).add("shape", StringType()).add("patterns", ArrayType(StringType()))
    span_type = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])
    slot_type = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.int32()), ("fails", pa.int32()), ("word", pa.string()), ("shape", pa.string()), ("patterns", pa.list_(pa.string()))])

    @tidy
    def run(batches):
        for batch in batches:
            base, slots, at, size = [], [], 0, 0
            for k in range(batch.num_rows + 1):
                if k == batch.num_rows or size > SLICE:
                    if k > at:
                        yield pa.RecordBatch.from_arrays([batch.column(0)[at:k], pa.array(base, pa.list_(span_type)), pa.array(slots, pa.list_(slot_type))], names=["doc_id", "base", "slots"])
                    base, slots, at, size = [], [], k, 0
                if k < batch.num_rows:
                    text = batch.column(1)[k].as_py() or ""
                    size += len(text)
                    found = base_spans(text)
                    base.append([{"start": s, "kind": n, "end": e} for s, n, e in found])
                    hidden = [(s, SECRET, e) for s, e in secrets(text) if not any(s < f[2] and f[0] < e for f in found)]
                    places = [(s, e, n) for s, n, e in found + hidden] + [(s, e, -1) for s, e in others(text, found + hidden)]
                    slots.append([{"start": s, "end": e, "kind": n, "fails": fails(text[s:e]) if n < 0 else -1, "word": key_of(text[s:e]), "shape": shape(text[s:e]), "patterns": contexts(text, s, e)} for s, e, n in places])

    schema = StructType().add("doc_id", docs.schema[id_col].dataType).add("base", ArrayType(span)).add("slots", ArrayType(slot))
    return docs.select(docs[id_col], docs[text_col].cast("string")).mapInArrow(run, schema)


def believed(slots: DataFrame, least: int = LEAST, trust: float = TRUST, accept: float = ACCEPT) -> DataFrame:
    """word, kind of words that are no seeds but are believed to be of a kind; from slots (kind, fails, word, shape, pattern).

    The graph has one edge for a pattern and a word, however often they meet, so nothing grows with copies. The highest kind
    counts where a word is a seed of several, and of kinds equally believed the first.
    """
    edges = stage(slots.groupBy("pattern", "word").agg(F.max("kind").alias("kind"), F.max("fails").alias("fails"), F.min("shape").alias("shape")), "edges")
    words = edges.groupBy("word").agg(F.max("kind").alias("seed"), F.max("fails").alias("fails"))
    edges = stage(edges.select("pattern", "word", "shape").join(words, "word"), "graph")
    seeds, unknown = edges.where("seed >= 0"), edges.where("seed < 0")
    if unknown.isEmpty():
        return slots.sparkSession.createDataFrame([], "word string, kind int")
    # by kind: the seeds that a pattern needs
    needs = seeds.groupBy(F.col("seed").alias("kind")).agg(F.greatest(F.lit(least), F.ceil(F.log2(1.0 + F.count_distinct("word")))).alias("needs"))
    own = seeds.groupBy("pattern", F.col("seed").alias("kind")).agg(F.count("*").alias("seeds"))
    total = edges.groupBy("pattern").agg(F.count_if(F.col("seed") >= 0).alias("all_seeds"), F.count_if(F.col("seed") < 0).alias("n_unknown"))
    shapes = seeds.select(F.col("seed").alias("kind"), "shape").distinct()
    # unknown words that may be of a kind: of a shape that its seeds have, and not known to fail
    may = unknown.join(shapes, "shape")
    like = may.groupBy("pattern", "kind").agg(F.count("*").alias("n_like"), F.count_if(F.col("fails") == F.col("kind")).alias("n_fails"))
    known = own.join(needs, "kind").where("seeds >= needs").join(total, "pattern").join(like, ["pattern", "kind"], "left").na.fill(0, ["n_like", "n_fails"])
    against = F.col("all_seeds") - F.col("seeds") + F.col("n_fails") + F.col("n_unknown") - F.col("n_like")
    known = stage(known.select("pattern", "kind", "seeds", against.alias("against")), "known")
    rest = stage(unknown.join(small(stage(known.select("pattern").distinct(), "names")), "pattern", "left_semi"), "unknown")
    found, n = None, 0
    while True:
        more = known
        if found is not None:  # accepted words speak for a pattern, and not against it any more
            got = rest.select("pattern", "word", "shape").join(found, "word").join(shapes.withColumn("like", F.lit(1)), ["kind", "shape"], "left")
            got = got.groupBy("pattern", "kind").agg(F.count("*").alias("found"), F.count_if(F.col("like").isNull()).alias("unlike"))
            more = known.join(got, ["pattern", "kind"], "left").na.fill(0, ["found", "unlike"])
            more = more.select("pattern", "kind", (F.col("seeds") + F.col("found")).alias("seeds"), (F.col("against") - F.col("unlike")).alias("against"))
        score = F.col("seeds") / (F.col("seeds") + F.col("against") + 1)
        patterns = stage(more.select("pattern", "kind", score.alias("score")).where(F.col("score") >= trust), "patterns")
        doubt = F.sum(F.log(1 - F.col("score")))
        met = rest.join(small(patterns), "pattern").where("fails <> kind").groupBy("word", "kind").agg((1 - F.exp(doubt)).alias("p"))
        best = met.where(F.col("p") >= accept).groupBy("word").agg(F.max(F.struct("p", (-F.col("kind")).alias("neg"))).alias("best"))
        found = stage(best.select("word", (-F.col("best.neg")).cast("int").alias("kind")), "found")
        before, n = n, found.count()
        if n <= before:
            return found


def find_private(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """doc_id, base and spans (arrays of start, kind, end; code points, end exclusive) of every row.

    spans holds base, assigned secrets and the words that the graph adds, by start and then kind. Null texts count as empty;
    ids may be null or repeat, as each row is followed by a number of its own. An empty table gives an empty result. A
    very long text is read as a whole, by its task alone; besides the text its memory grows with its spans.
    """
    rows = stage(scan(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "slots")
    slots = rows.select("row", F.explode("slots").alias("s")).select("row", "s.*")
    words = stage(believed(slots.select("kind", "fails", "word", "shape", F.explode("patterns").alias("pattern")), **how), "words")
    more = slots.where("kind < 0").drop("kind").join(small(words), "word").select("row", F.struct("start", F.col("kind").cast("int").alias("kind"), "end").alias("s"))
    more = more.unionByName(slots.where(F.col("kind") == SECRET).select("row", F.struct("start", "kind", "end").alias("s")))
    more = more.groupBy("row").agg(F.collect_list("s").alias("more"))  # of one document
    out = rows.select("row", "doc_id", "base").join(more, "row", "left")
    return out.select("doc_id", "base", F.array_sort(F.concat("base", F.coalesce("more", F.expr("slice(base, 1, 0)")))).alias("spans"))


def written(spans) -> F.Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, (*KINDS, "secret")))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op2_pii(spark, sf_dir: str) -> DataFrame:
    from .common import table

    out = find_private(table(spark, sf_dir, "documents"))
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = {k})) as long)").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return out.select("doc_id", *counts, F.size("spans").cast("long").alias("n_spans"), F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
