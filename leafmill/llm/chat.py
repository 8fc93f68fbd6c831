"""Chat formatting by minimum-cost role repair.

Legal conversations are: perhaps a system turn, then user and assistant turns in alternation, from a user turn
to an assistant turn. Dynamic programming over that automaton chooses, for every turn, whether it stays,
takes another role or joins the turn before it, and where empty turns come in, at the least total cost.

The state between turns is one of four, so a run of turns is a 4 x 4 matrix of costs, and runs combine like
matrices under minimum and plus. Turns are dealt out by ranges of (conversation, turn): a long conversation is
cut wherever that falls, and ranges into pieces of 4096 turns. A first pass sums up each piece by the matrices of
its first and last conversation; from those follows what the rest costs after each piece, by the state in
which it ends. A second pass repairs the pieces, for every state in which a piece may begin if its conversation
began in another; which state that is, the pieces' end states tell. Only these summaries of a conversation
meet in one task.
"""

from __future__ import annotations

import math
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage

#: Roles, and names that stand for them.
ROLES = ("system", "user", "assistant")
NAMES = {"system": "system", "developer": "system", "user": "user", "human": "user", "prompter": "user", "assistant": "assistant", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
#: States are the role last written, START before any. MOVES: where a state may go in one turn.
START, SYSTEM, USER, ASSISTANT = range(4)
MOVES = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
#: Costs of joining the turn before, of another role (none for an unknown role), and of an empty turn.
MERGE, RELABEL, INSERT = 1, 3, 2
TEMPLATE = ("<|", "|>\n", "\n")
INF = math.inf
#: Turns of a piece, as a power of two.
PIECE = 12
PREFIX = 64


def _paths() -> dict[tuple[int, int], tuple[int, ...]]:
    """The shortest way from a state to writing a role: the empty turns that must come before it."""
    out = {}
    for s in range(4):
        edge, seen = [(s, ())], {s}
        while edge:
            grown = []
            for at, via in edge:
                for t in MOVES[at]:
                    out.setdefault((s, t), via)
                    if t not in seen:
                        seen.add(t)
                        grown.append((t, (*via, t)))
            edge = grown
    return out


PATHS = _paths()


def options(role: int) -> list[tuple[int, int, int, bool]]:
    """(from, to, cost, merged) of writing a turn of this role (0 if unknown), cheapest first, ties in fixed order."""
    out = []
    for s in range(4):
        for t in (SYSTEM, USER, ASSISTANT):
            extra = RELABEL if role and role != t else 0
            if s == t:
                out.append((s, t, extra + MERGE, True))
            elif (s, t) in PATHS:
                out.append((s, t, extra + INSERT * len(PATHS[s, t]), False))
    return sorted(out, key=lambda o: (o[2], not o[3], o[0], o[1]))


OPTIONS = {r: options(r) for r in range(4)}
#: Cost of ending in a state: an empty assistant turn if the last is not one; nothing for no turns at all.
ENDING = [0, INSERT * 2, INSERT, 0]


def role_of(name: str | None) -> int:
    known = NAMES.get((name or "").strip().lower())
    return ROLES.index(known) + 1 if known else 0


def identity() -> list[list[float]]:
    return [[0 if i == j else INF for j in range(4)] for i in range(4)]


def step(m: list[list[float]], role: int) -> list[list[float]]:
    """The matrix after one more turn."""
    out = [[INF] * 4 for _ in range(4)]
    for s, t, c, _ in OPTIONS[role]:
        for i in range(4):
            out[i][t] = min(out[i][t], m[i][s] + c)
    return out


def repair(roles: list[int], begin: int, ending: list[float]) -> list[tuple[int, int, bool, tuple[int, ...]]]:
    """(state before, role written, merged, empty turns before) of each turn, at the least cost.

    ``ending[s]`` is the cost of what follows when the piece ends in state s. Costs of the rest are computed
    from the back, so of equal choices the first in the order of ``options`` is taken from the front.
    """
    rest = [list(ending)]
    for role in reversed(roles):
        nxt = rest[-1]
        now = [INF] * 4
        for s, t, c, _ in OPTIONS[role]:
            now[s] = min(now[s], c + nxt[t])
        rest.append(now)
    rest.reverse()
    out, s = [], begin
    for i, role in enumerate(roles):
        _, t, _, merged = next(o for o in OPTIONS[role] if o[0] == s and o[2] + rest[i + 1][o[1]] == rest[i][s])
        out.append((s, t, merged, () if merged else PATHS[s, t]))
        s = t
    return out


def rendered(role: int, text: str) -> str:
    return TEMPLATE[0] + ROLES[role - 1] + TEMPLATE[1] + text + TEMPLATE[2]


def chain(lines: list[tuple[int, list[float]]]) -> list[tuple[int, list[float], bool]]:
    """(piece, cost of what follows it by end state, whether it is the first) for a conversation's pieces."""
    lines = sorted(lines)
    out, rest = [], [float(x) for x in ENDING]
    for k in range(len(lines) - 1, -1, -1):
        piece, m = lines[k]
        out.append((piece, rest, k == 0))
        rest = [min(m[4 * i + j] + rest[j] for j in range(4)) for i in range(4)]
    return out


def format_chats(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", piece: int = PIECE) -> DataFrame:
    """One row per input turn, in repaired form.

    conv_id, turn, role, role_out, action (keep, relabel, merge or relabel+merge), inserted (empty turns
    before it, comma-joined), cost, and piece: what the turn adds to the rendered conversation, with
    the empty turn after the last turn if there is one. Pieces joined in order are the conversation. Turns
    are ordered by turn (nulls last), then role and text; rows that repeat are turns of their own. Null text
    is empty; a null or unknown role becomes whichever role costs least; null ids are one conversation. Of
    repairs that cost the same the first choice in the order of ``options`` is taken, turn by turn from the
    front. An empty table gives an empty result. A very long text costs its task the memory of a few copies of it; ranges are
    found from the first ``PREFIX`` characters of texts, so that no whole text comes to the driver.
    """
    cols = turns.select(turns[id_col].alias("conv_id"), turns[turn_col].alias("turn"), turns[role_col].cast("string").alias("role"), turns[text_col].cast("string").alias("text"))
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_last(), F.col("role").asc_nulls_last(), F.col("text").asc_nulls_last()]
    # rows that agree in all of these fall into one range, so ranges are in order of whole texts as well
    start = [*order[:3], F.substring("text", 1, PREFIX).asc_nulls_last()]
    ranged = cols.repartitionByRange(*start).sortWithinPartitions(*order)
    ranged = ranged.withColumn("place", F.monotonically_increasing_id()).withColumn("part", F.shiftright("place", piece))
    ranged = ranged.withColumn("ck", F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("null")))
    ranged = stage(ranged, "turns")  # places and pieces are fixed from here

    def sums(group: pa.Table) -> pa.Table:
        """The matrices of a piece's first and last conversation; others begin and end within it."""
        group = group.sort_by("place")
        keys, roles = group.column("ck").to_pylist(), group.column("role").to_pylist()
        out = []
        head = next((i for i, k in enumerate(keys) if k != keys[0]), len(keys))
        tail = next((i + 1 for i in range(len(keys) - 1, -1, -1) if keys[i] != keys[-1]), 0)
        for lo, hi in {(0, head), (tail, len(keys))}:
            m = identity()
            for r in roles[lo:hi]:
                m = step(m, role_of(r))
            out.append((keys[lo], [float(x) for row in m for x in row]))
        part = group.column("part")[0].as_py()
        return pa.table({"ck": pa.array([o[0] for o in out]), "part": pa.array([part] * len(out), pa.int64()), "matrix": pa.array([o[1] for o in out], pa.list_(pa.float64()))})

    lines = ranged.select("ck", "role", "place", "part").groupBy("part").applyInArrow(sums, "ck string, part long, matrix array<double>")

    def follow(group: pa.Table) -> pa.Table:
        found = chain(list(zip(group.column("part").to_pylist(), group.column("matrix").to_pylist())))
        return pa.table({"ck": pa.array([group.column("ck")[0].as_py()] * len(found)), "part": pa.array([f[0] for f in found], pa.int64()), "ending": pa.array([f[1] for f in found], pa.list_(pa.float64())), "opens": pa.array([f[2] for f in found])})

    follows = lines.groupBy("ck").applyInArrow(follow, "ck string, part long, ending array<double>, opens boolean")

    def mend(group: pa.Table, ends: pa.Table) -> pa.Table:
        group = group.sort_by("place")
        after = {k: (e, o) for k, e, o in zip(*(ends.column(c).to_pylist() for c in ("ck", "ending", "opens")))}
        keys, roles, texts, places = (group.column(c).to_pylist() for c in ("ck", "role", "text", "place"))
        out: dict[str, list] = {c: [] for c in ("place", "alt", "role_out", "action", "inserted", "cost", "piece", "ck", "part", "ends")}
        part = group.column("part")[0].as_py()
        lo = 0
        while lo < len(keys):
            hi = lo
            while hi < len(keys) and keys[hi] == keys[lo]:
                hi += 1
            ending, opens = after.get(keys[lo], (ENDING, True))
            known = [role_of(r) for r in roles[lo:hi]]
            finals = []
            for begin in (START,) if opens else range(4):
                path = repair(known, begin, ending)
                finals.append(path[-1][1])
                for i, (_, role, merged, empty) in enumerate(path):
                    text = texts[lo + i] or ""
                    changed = known[i] != role and known[i] != 0
                    out["place"].append(places[lo + i])
                    out["alt"].append(None if opens else begin)
                    out["role_out"].append(ROLES[role - 1])
                    out["action"].append("relabel+merge" if changed and merged else "relabel" if changed else "merge" if merged else "keep")
                    out["inserted"].append(",".join(ROLES[e - 1] for e in empty))
                    out["cost"].append(MERGE * merged + RELABEL * changed + INSERT * len(empty))
                    out["piece"].append("".join(rendered(e, "") for e in empty) + (text + TEMPLATE[2] if merged else rendered(role, text)))
                    for c in ("ck", "part", "ends"):
                        out[c].append(None)
            if hi == len(keys) or not opens:  # may go on in the next piece, or came from the one before
                for c in ("place", "alt", "role_out", "action", "inserted", "cost", "piece"):
                    out[c].append(None)
                out["ck"].append(keys[lo])
                out["part"].append(part)
                out["ends"].append(finals)
            lo = hi
        types = {"place": pa.int64(), "alt": pa.int32(), "cost": pa.int64(), "part": pa.int64(), "ends": pa.list_(pa.int32())}
        return pa.table({c: pa.array(v, types.get(c, pa.string())) for c, v in out.items()})

    schema = "place long, alt int, role_out string, action string, inserted string, cost long, piece string, ck string, part long, ends array<int>"
    mended = ranged.select("ck", "role", "text", "place", "part").groupBy("part").cogroup(follows.groupBy("part")).applyInArrow(mend, schema)
    mended = stage(mended, "mended")

    def enter(group: pa.Table) -> pa.Table:
        """The state with which each piece of a conversation begins."""
        state, out = START, []
        for p, finals in sorted(zip(group.column("part").to_pylist(), group.column("ends").to_pylist())):
            out.append((p, state))
            state = finals[0] if len(finals) == 1 else finals[state]
        return pa.table({"part": pa.array([o[0] for o in out], pa.int64()), "ck": pa.array([group.column("ck")[0].as_py()] * len(out)), "begin": pa.array([o[1] for o in out], pa.int32())})

    begins = mended.where("place IS NULL").select("ck", "part", "ends").groupBy("ck").applyInArrow(enter, "part long, ck string, begin int")
    begins = stage(begins, "begins")
    rows = mended.where("place IS NOT NULL").drop("ck", "part", "ends")
    keyed = rows.join(ranged.select("place", "part", "ck", "conv_id", "turn", "role"), "place")
    joined = keyed.join(begins.select("part", "ck", "begin"), ["part", "ck"], "left").where("alt IS NULL OR alt = begin")
    # the end of each conversation: its last place takes the empty turn that closes it
    lasts = joined.groupBy("ck").agg(F.max(F.struct("place", "role_out")).alias("z")).where(F.col("z.role_out") != "assistant")
    close = F.when(F.col("z.role_out") == "user", F.lit(rendered(ASSISTANT, ""))).when(F.col("z.role_out") == "system", F.lit(rendered(USER, "") + rendered(ASSISTANT, "")))
    closing = lasts.select(F.col("z.place").alias("place"), close.alias("close"), F.when(F.col("z.role_out") == "user", INSERT).otherwise(2 * INSERT).alias("more"))
    out = joined.join(closing, "place", "left")
    return out.select("conv_id", "turn", "role", "role_out", "action", "inserted", (F.col("cost") + F.coalesce("more", F.lit(0))).alias("cost"), F.concat("piece", F.coalesce("close", F.lit(""))).alias("piece"), "place")


def op3_chat(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return format_chats(table(spark, sf_dir, "conversations"))
