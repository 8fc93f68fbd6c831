"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Starts of code blocks, the blank line between paragraphs, languages by what marks them.
CODE_BOUNDARY = r"(?md)^(?=\s*(?:def |async def |class |fn |pub fn |function |#include|namespace ))"
PARAGRAPH = r"\n\s*\n+"
LANGUAGES = (
    ("python", r"(?md)\bdef\s+\w+\(|\bimport\s+\w+|^from\s+\w+\s+import"),
    ("cpp", r"#include\s*<|::|std::"),
    ("rust", r"\bfn\s+\w+\(|let\s+mut\b|impl\s+\w+"),
    ("javascript", r"\bfunction\s+\w+\(|=>\s*\{|const\s+\w+\s*="),
)
TOKEN = r"\w+|[^\w\s]"
#: What SQL's trim takes: the space and the other separators of category Zs, neither tabs nor line ends.
SPACES = " \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Without white space at either end, Unicode included."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def trim(c: Column) -> Column:
    """Without spaces at either end, as SQL's trim."""
    return F.trim(c, F.lit(SPACES))


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+$", "")


def strip_nul(c: Column) -> Column:
    return F.translate(c, "\u0000", "")


def filled(*cols: Column) -> Column:
    """The first that is neither null nor empty, else the last."""
    return F.coalesce(*[F.when(c != "", c) for c in cols[:-1]], cols[-1])


def paragraphs(c: Column, boundary: str = PARAGRAPH) -> Column:
    return F.filter(F.transform(F.split(c, boundary), strip), lambda p: p != "")


def code_blocks(c: Column) -> Column:
    """Blocks of code, blank ones dropped; the whole text if none is left."""
    parts = F.filter(F.split(c, CODE_BOUNDARY), lambda p: strip(p) != "")
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(c))


def detect_language(c: Column) -> Column:
    head, out = F.substring(c, 1, 500), F.lit(None).cast("string")
    for name, pattern in reversed(LANGUAGES):
        out = F.when(head.rlike(pattern), name).otherwise(out)
    return out


def tokens(c: Column) -> Column:
    """The default tokenizer: words and single marks."""
    return F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0))


def token_count(c: Column) -> Column:
    return F.size(tokens(c))


def space_count(c: Column) -> Column:
    """Fields between single spaces."""
    return F.size(F.split(c, " "))


def shards(toks: Column, window: int = 350, overlap: int = 60) -> Column:
    """Windows of tokens; the last is the first that reaches the end."""
    step = window - overlap
    last = F.greatest(F.lit(0), F.ceil((F.size(toks) - window) / F.lit(step)).cast("int"))
    starts = F.sequence(F.lit(0), last * step, F.lit(step))
    return F.when(F.size(toks) > 0, F.transform(starts, lambda s: F.slice(toks, s + 1, F.lit(window)))).otherwise(F.array().cast("array<array<string>>"))


def python_code(c: Column) -> Column:
    """What the first python fence holds, else the first bare fence, else ''."""
    named, bare = r"(?s)```python\s*\n(.*?)```", r"(?s)```\s*\n(.*?)```"
    return F.when(c.rlike(named), strip(F.regexp_extract(c, named, 1))).when(c.rlike(bare), strip(F.regexp_extract(c, bare, 1))).otherwise("")


def reward_format(c: Column) -> Column:
    return F.when(c.rlike(r"(?s)<reasoning>.*?</reasoning>\s*<code>\s*```python\s*\n.*?```\s*</code>"), 0.5).otherwise(0.0)


def reward_length(n: Column) -> Column:
    return F.when((n >= 100) & (n < 800), 0.1).otherwise(0.0)


def shortened(c: Column, n: int) -> Column:
    """White space collapsed, cut at n characters with an ellipsis."""
    one = strip(F.regexp_replace(c, r"\s+", " "))
    return F.when(F.length(one) > n, F.concat(F.substring(one, 1, n - 1), F.lit("…"))).otherwise(one)


def is_identifier(t: Column) -> Column:
    """A digit in it, or all capitals and at most eight characters."""
    return t.rlike(r"[0-9]") | (t.rlike("[A-Z]") & (t == F.upper(t)) & (F.length(t) <= 8))
