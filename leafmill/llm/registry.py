"""Queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import bpe, chat, exact, lines, minhash, mixing, pii, pq, quality, tokencount


def queries() -> dict:
    return {
        "op10_token_counts": tokencount.op10_token_counts,
        "op1_mixing": mixing.op1_mixing,
        "op2_pii": pii.op2_pii,
        "op3_chat": chat.op3_chat,
        "op4_bpe": bpe.op4_bpe,
        "op5_minhash": minhash.op5_minhash,
        "op6_embeddings": pq.op6_embeddings,
        "op7_lines": lines.op7_lines,
        "op8_exact_dedup": exact.op8_exact_dedup,
        "op9_quality": quality.op9_quality,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_minhash": minhash.SQL, "op6_embeddings": pq.SQL, "op8_exact_dedup": exact.SQL}
