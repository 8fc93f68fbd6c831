"""Schemas of the stored tables, and their constraints as queries for violations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import CONTENT_TYPES, DOMAINS

DOCUMENTS = ("id long, domain string, source_path string, title string, n_pages int, sha256 string, metadata string, created_at timestamp")
CHUNKS = (
    "id long, document_id long, domain string, level int, parent_chunk_id long, is_searchable boolean, parent_ids array<long>, children_ids array<long>, "
    "content string, content_type string, language string, token_count int, page_start int, page_end int, image_path string, embedding array<float>, metadata string, created_at timestamp"
)
SEGMENTS = ("doc_id long, seg_ord int, text string, page int, kind string, language string, image_path string, bbox struct<x0:double,y0:double,x1:double,y1:double>, is_scan boolean")

#: A null result passes, as it does in a CHECK.
CHECKS = {
    "domain": f"domain IN {DOMAINS}",
    "content_type": f"content_type IN {CONTENT_TYPES}",
    "no_code_in_trading": "NOT (domain = 'trading' AND content_type = 'code')",
    "language_only_for_code": "content_type = 'code' OR language IS NULL",
}


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def violations(df: DataFrame, checks: dict[str, str] = CHECKS) -> DataFrame:
    """Rows that break a check, with the checks' names in ``broken``; checks on absent columns are skipped."""
    have = {k: v for k, v in checks.items() if k not in ("domain", "content_type") or k in df.columns}
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(F.expr(v), F.lit(True)), F.lit(k)) for k, v in have.items()]))
    return df.withColumn("broken", broken).where(F.size("broken") > 0)
