"""Training examples: fields normalised, filtered, sampled, turned into chats, and completions rewarded."""

from __future__ import annotations

import ast
import subprocess
import sys
import tempfile

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import text as T
from ..staging import stage

SYSTEM = "You are a helpful assistant."
REFUSAL = "The answer is not in the context."


def pick(df: DataFrame, *names: str) -> Column:
    """The first of the columns that exist that is neither null nor empty, else ''."""
    have = [F.col(n) for n in names if n in df.columns]
    return F.coalesce(*[F.when(c != "", c) for c in have], F.lit(""))


def instructions_a(df: DataFrame, system: str = SYSTEM) -> DataFrame:
    """Rows with prompts and answers under any of several names."""
    user = pick(df, "user_prompt", "inputs", "instruction", "question")
    answer = pick(df, "answer", "outputs", "output", "response")
    given = pick(df, "system_prompt")
    return df.select(F.when(given != "", given).otherwise(system).alias("system"), user.alias("user"), answer.alias("assistant"))


def instructions_b(df: DataFrame, system: str = SYSTEM) -> DataFrame:
    """Rows with instruction, input and output: the input, if any, follows a blank line."""
    instr, given = F.coalesce("instruction", F.lit("")), F.coalesce("input", F.lit(""))
    user = F.when(given != "", T.strip(F.concat(instr, F.lit("\n\n"), given))).otherwise(instr)
    return df.select(F.lit(system).alias("system"), user.alias("user"), F.coalesce("output", F.lit("")).alias("assistant"))


def valid(df: DataFrame, least: int = 10) -> DataFrame:
    """With a user turn and an answer longer than ``least`` characters."""
    return df.where((F.coalesce("user", F.lit("")) != "") & (F.length(F.coalesce("assistant", F.lit(""))) > least))


def fits(df: DataFrame, text: str = "text", most: int = 2048, count=T.token_count) -> DataFrame:
    return df.where(count(F.col(text)) <= most)


def messages(*parts: tuple[str, Column]) -> Column:
    """An array of role and content."""
    return F.array(*[F.struct(F.lit(r).alias("role"), c.alias("content")) for r, c in parts])


def coding_a(df: DataFrame) -> DataFrame:
    """problem, test_code, entry_point from rows whose verification_info is JSON text; malformed text counts as {}."""
    info = F.col("verification_info")
    lists = [F.from_json(F.get_json_object(info, f"$.{k}"), "array<string>") for k in ("test_cases", "tests")]
    code = F.coalesce(*[F.when(F.size(x) > 0, F.array_join(x, "\n")) for x in lists], *[F.when(F.get_json_object(info, f"$.{k}") != "", F.get_json_object(info, f"$.{k}")) for k in ("test_cases", "tests")], F.lit(""))
    return df.select(pick(df, "prompt", "problem", "question").alias("problem"), code.alias("test_code"), F.coalesce(F.get_json_object(info, "$.function_name"), F.lit("")).alias("entry_point"))


def coding_b(df: DataFrame) -> DataFrame:
    return df.select(pick(df, "prompt", "problem").alias("problem"), pick(df, "test").alias("test_code"), pick(df, "entry_point").alias("entry_point"))


def coding_chats(df: DataFrame, system: str = SYSTEM) -> DataFrame:
    """Rows with a problem and tests, as prompts."""
    return df.where("problem <> '' AND test_code <> ''").select(messages(("system", F.lit(system)), ("user", F.col("problem"))).alias("prompt"), "test_code", "entry_point")


def legal_a(df: DataFrame) -> DataFrame:
    return df.select("context", "question", F.try_element_at("answers.text", F.lit(1)).alias("answer"))


def legal_b(df: DataFrame) -> DataFrame:
    return df.select(F.col("text").alias("context"), "question", F.try_element_at("answers", F.lit(1))["text"].alias("answer"))


def vision_question(df: DataFrame) -> Column:
    """The first turn without its image mark if there are two turns, else a question under any of several names."""
    first = T.strip(F.replace(F.try_element_at("conversations", F.lit(1))["value"], F.lit("<image>"), F.lit("")))
    return F.when(F.size("conversations") >= 2, first).otherwise(pick(df, "question", "prompt"))


def shuffle_key(seed, *cols) -> Column:
    """A repeatable random order."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") if isinstance(c, Column) else F.col(c).cast("string") for c in cols]))


def sample(df: DataFrame, n: int, seed: int, *cols: str) -> DataFrame:
    """n rows without replacement, or all."""
    return df.orderBy(shuffle_key(seed, *cols), *cols).limit(n)


def stratified(df: DataFrame, flag: Column, n: int = 128, share: float = 0.30, seed: int = 0, key: str = "id") -> DataFrame:
    """n rows, of which int(share * n) have no ``flag`` if there are so many; strata that fall short are not made up.

    Each stratum is a top-n, which keeps n rows a task, so no stratum meets in one.
    """
    order = [shuffle_key(seed, key), F.col(key)]
    without = df.where(~flag).orderBy(*order).limit(int(share * n))
    n_without = min(int(share * n), without.count())
    return df.where(flag).orderBy(*order).limit(n - n_without).unionByName(without)


def numbered(df: DataFrame, key: Column, *order: str) -> DataFrame:
    """``df`` with place: 0, 1, ... in the order of ``key`` and then the columns ``order``.

    Rows are numbered within 4096 ranges of their key's first digits (hexadecimal) and ranges by their sizes, so no task holds all.
    """
    keyed = stage(df.withColumn("__key", key).withColumn("__bin", F.substring("__key", 1, 3)), "numbered")
    sizes = keyed.groupBy("__bin").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1))  # 4096 rows
    sizes = sizes.select("__bin", F.coalesce(before, F.lit(0)).alias("__before"))
    at = F.row_number().over(Window.partitionBy("__bin").orderBy("__key", *order)) - 1
    return keyed.withColumn("__at", at).join(F.broadcast(sizes), "__bin").withColumn("place", F.col("__before") + F.col("__at")).drop("__key", "__bin", "__at", "__before")


def distractors(df: DataFrame, pool: DataFrame, k: int = 2, seed: int = 0, cut: int = 1500) -> DataFrame:
    """Each row's context with k others of a pool (cand, context), cut at ``cut`` characters, in a repeatable random order.

    The pool is numbered as a whole, in a hash order; row i takes the entries at places drawn by hashes of i and of the draw,
    all different if the pool has as many. So rows and pool join by place and are never crossed.
    """
    places = numbered(pool.select("cand", F.substring("context", 1, cut).alias("other")), shuffle_key(seed, "cand"), "cand").select("place", "other")
    places = stage(places, "pool")
    n = places.count()
    first, step = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(max(n, 1))), F.pmod(F.xxhash64(F.lit(seed + 1), "id"), F.lit(max((n - 1) // max(k, 1), 1))) + 1
    draws = df.select("id", first.alias("first"), step.alias("step"), F.explode(F.sequence(F.lit(1), F.lit(min(k, n)))).alias("draw")) if min(k, n) else df.select("id", F.lit(0).alias("first"), F.lit(0).alias("step"), F.lit(0).alias("draw")).limit(0)
    draws = draws.select("id", F.pmod(F.col("first") + F.col("step") * F.col("draw"), F.lit(max(n, 1))).alias("place"))
    got = draws.join(places, "place").groupBy("id").agg(F.collect_list("other").alias("others"))  # k of a row
    parts = F.array_sort(F.transform(F.concat(F.array(F.substring("context", 1, cut)), F.coalesce("others", F.array().cast("array<string>"))), lambda c: F.struct(F.md5(F.concat(F.lit(str(seed)), c)).alias("o"), c.alias("c"))))
    return df.join(got, "id", "left").withColumn("retrieved", F.array_join(F.transform(parts, lambda p: p["c"]), "\n\n---\n\n")).drop("others")


def all_of(*tables: DataFrame) -> DataFrame:
    """The rows of all tables, as many times as they have them; columns go by name."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def coder_rows(df: DataFrame) -> DataFrame:
    """question, answer of coding examples under any of several names, without those that have no question."""
    rows = df.select(T.strip(pick(df, "question", "problem", "prompt", "instruction")).alias("question"), T.strip(pick(df, "answer", "solution", "output", "response")).alias("answer"))
    return rows.where(F.col("question") != "")


def grounded_prompt(context: Column, question: Column, cut: int = 1500) -> Column:
    """A question with its context, cut at ``cut`` characters."""
    return F.concat(F.lit("Context:\n"), F.substring(context, 1, cut), F.lit("\n\nQuestion: "), question, F.lit("\n\nAnswer:"))


def capped(df: DataFrame, source: str, most: int = 5000, seed: int = 0, key: str = "doc_id") -> DataFrame:
    """At most ``most`` rows of each source, in a repeatable random order; a null source is one of its own.

    Rows are cut in 64 parts of each source first, so a source that has most rows does not meet in one task.
    """
    order = [F.col("__key"), F.col(key)]
    keyed = df.withColumn("__key", shuffle_key(seed, key)).withColumn("__part", F.pmod(F.xxhash64(key), F.lit(64)))
    few = keyed.withColumn("__n", F.row_number().over(Window.partitionBy(source, "__part").orderBy(*order))).where(F.col("__n") <= most)
    return few.withColumn("__n", F.row_number().over(Window.partitionBy(source).orderBy(*order))).where(F.col("__n") <= most).select(*df.columns)


def question_sample(parents: DataFrame, n: int = 100, seed: int = 0) -> DataFrame:
    """id, domain, kind: ``n`` parents (id, domain) of each domain, half to be asked about in other words and half in exact terms."""
    got = capped(parents.select("id", "domain"), "domain", n, seed, "id")
    rank = F.row_number().over(Window.partitionBy("domain").orderBy(shuffle_key(seed, "id"), "id"))  # n of a domain
    return got.select("id", "domain", F.when(rank % 2 == 1, "paraphrase").otherwise("exact").alias("kind"))


def _parses(code: str | None) -> bool:
    try:
        return bool(code) and isinstance(ast.parse(code), ast.Module)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return False


@F.pandas_udf(DoubleType())
def reward_syntax(code: pd.Series) -> pd.Series:
    """0.25 for code that parses; nothing is run."""
    return code.map(_parses) * 0.25


def reward_correctness(allow: bool = False, seconds: int = 8):
    """A pandas UDF (code, tests) that runs both in a child process: 2.0 if it ends well. It runs untrusted code, so ``allow`` must be set."""
    if not allow:
        raise PermissionError("running completions must be allowed explicitly")

    @F.pandas_udf(DoubleType())
    def reward(code: pd.Series, tests: pd.Series) -> pd.Series:
        def one(c, t):
            if not c or not t:
                return 0.0
            program = f"{c}\n\n{t}\n" + ("\ncheck(Solution())\n" if "def check(" in t and "check(Solution" not in t else "")
            with tempfile.NamedTemporaryFile("w", suffix=".py") as f:
                f.write(program)
                f.flush()
                try:
                    return 2.0 if subprocess.run([sys.executable, "-I", f.name], capture_output=True, timeout=seconds).returncode == 0 else 0.0
                except subprocess.TimeoutExpired:
                    return 0.0

        return pd.Series([one(c, t) for c, t in zip(code, tests)])

    return reward
