"""Data-quality rules: what breaks an enum, a range, a key or a reference."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The states that rows may have.
DOMAINS = {
    "document_type": ("strategy", "meeting", "email", "sop", "idea", "audio", "video", "whitepaper", "project-plan", "project-charter", "workshop", "knowledge"),
    "media_type": ("text", "audio", "video"),
    "transcription_status": ("pending", "processing", "completed", "error"),
    "source_status": ("active", "paused", "error", "completed"),
    "page_status": ("pending", "processing", "completed", "error", "skipped"),
    "job_type": ("scheduled", "manual", "retry", "one_time"),
    "job_status": ("pending", "running", "completed", "failed", "cancelled"),
    "link_type": ("internal", "external", "subdomain"),
    "log_level": ("debug", "info", "warn", "error"),
    "metric_unit": ("ms", "count", "bytes", "percentage"),
    "health": ("healthy", "degraded", "unhealthy"),
    "query_type": ("search", "chat", "api", "intelligent"),
}


def check_enum(df: DataFrame, col: str, domain) -> DataFrame:
    """Rows outside the domain: a list of values, or a (least, most) range given as a range object. Null breaks no rule."""
    c = F.col(col)
    ok = c.between(domain.start, domain.stop - 1) if isinstance(domain, range) else c.isin(*domain)
    return df.where(c.isNotNull() & ~ok)


def check_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def check_fk(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Children whose parent (id) is missing; a null key refers to none."""
    return child.where(F.col(key).isNotNull()).join(parent.select(F.col("id").alias(key)), key, "left_anti")
