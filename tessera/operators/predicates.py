"""Filters over documents, logs and metrics. An argument of None leaves its predicate out."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import columns as C

#: Values beyond which a membership test joins instead of listing them.
LISTED = 200


def filter_type(df: DataFrame, type: str | None = None) -> DataFrame:
    return df if type is None else df.where(F.col("type") == type)


def filter_tags_overlap(df: DataFrame, tags: list[str] | None = None, col: str = "tags") -> DataFrame:
    """Rows that have any of the tags; null tags never match."""
    return df if tags is None else df.where(F.arrays_overlap(F.col(col), F.array(*map(F.lit, tags)).cast("array<string>")))


def filter_in(df: DataFrame, col: str, values: list | None = None) -> DataFrame:
    if values is None:
        return df
    if len(values) <= LISTED:
        return df.where(F.col(col).isin(values))
    wanted = df.sparkSession.createDataFrame([(v,) for v in dict.fromkeys(values)], f"{col} {dict(df.dtypes)[col]}")
    return df.join(wanted, col, "left_semi")


def filter_null(df: DataFrame, col: str, is_null: bool = False) -> DataFrame:
    return df.where(F.col(col).isNull() if is_null else F.col(col).isNotNull())


FLAGS = {"code": "contains_code", "diagrams": "contains_diagrams", "text": "contains_text", "ui": "contains_ui_elements"}


def filter_any_of(df: DataFrame, content_filters: list[str] | None = None) -> DataFrame:
    """Frames with any of the flags; an unknown name matches nothing."""
    if content_filters is None:
        return df
    known = [F.col(FLAGS[f]) for f in content_filters if f in FLAGS]
    return df.where(reduce(or_, known, F.lit(False)))


def pending_sweep(docs: DataFrame, limit: int = 10) -> DataFrame:
    """Documents that lack content, transcription or a vector, but for errors; a null status is no status to sweep."""
    lacks = F.col("content_text").isNull() | F.col("transcription").isNull() | F.col("embedding").isNull()
    return docs.where(lacks & (F.col("transcription_status") != "error")).orderBy("id").limit(limit)


def pending_text(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("transcription_status").isNull() | (F.col("transcription_status") == "pending") | F.col("content_text").isNull()).orderBy("created_at", "id")


def pending_media(docs: DataFrame, media: tuple[str, ...] = ("audio", "video")) -> DataFrame:
    return docs.where(F.col("media_type").isin(*media) & (F.col("transcription_status") == "pending")).orderBy("created_at", "id")


def pending_embedding(docs: DataFrame) -> DataFrame:
    return docs.where((C.content_or_transcription("content_text", "transcription") != "") & ~C.has_vector("embedding"))


def stuck_uploads(docs: DataFrame, as_of: str, hours: int = 24) -> DataFrame:
    lacks = F.col("content_text").isNull() | (F.col("transcription_status") == "pending")
    return docs.where(lacks & (F.col("created_at") >= F.expr(f"TIMESTAMP_NTZ '{as_of}' - INTERVAL '{hours}' HOUR")))


def needs_processing(docs: DataFrame) -> DataFrame:
    text = (F.col("media_type") == "text") & F.col("content_text").isNull()
    media = F.col("media_type").isin("audio", "video") & F.col("transcription_status").isNull()
    return docs.where(text | F.coalesce(F.col("transcription_status") == "pending", F.lit(False)) | media)


def unchunked(docs: DataFrame, types: list[str] | None = None, ids: list | None = None, force: bool = False) -> DataFrame:
    out = filter_in(filter_in(docs, "type", types), "id", ids)
    return out if force else out.where(F.col("chunk_count").isNull() | (F.col("chunk_count") == 0))


def log_query(logs: DataFrame, level=None, component=None, start=None, end=None, limit: int = 100) -> DataFrame:
    """Newest first; at most `limit`, which is 1,000 at most."""
    for col, value in (("level", level), ("component", component)):
        logs = logs if value is None else logs.where(F.col(col) == value)
    logs = logs if start is None else logs.where(F.col("ts") >= F.expr(f"TIMESTAMP_NTZ '{start}'"))
    logs = logs if end is None else logs.where(F.col("ts") <= F.expr(f"TIMESTAMP_NTZ '{end}'"))
    return logs.orderBy(F.desc("ts"), F.desc("id")).limit(min(limit, 1_000))


def metric_query(metrics: DataFrame, component=None, name=None, start=None, end=None) -> DataFrame:
    for col, value in (("component", component), ("name", name)):
        metrics = metrics if value is None else metrics.where(F.col(col) == value)
    metrics = metrics if start is None else metrics.where(F.col("ts") >= F.expr(f"TIMESTAMP_NTZ '{start}'"))
    metrics = metrics if end is None else metrics.where(F.col("ts") <= F.expr(f"TIMESTAMP_NTZ '{end}'"))
    return metrics.orderBy(F.desc("ts"), F.desc("id"))


def page_offset(df: DataFrame, order: list, page: int = 1, limit: int = 20) -> DataFrame:
    return df.orderBy(*order).offset((page - 1) * limit).limit(limit)


def page_count(df: DataFrame, limit: int = 20) -> DataFrame:
    return df.agg(F.count("*").alias("total"), F.ceil(F.count("*") / limit).cast("long").alias("total_pages"))


def substring_search(df: DataFrame, q: str, cols: list[str]) -> DataFrame:
    return df.where(reduce(or_, [F.coalesce(F.lower(F.col(c)).contains(q.lower()), F.lit(False)) for c in cols]))


def browse_filter(docs: DataFrame, type: str | None = None, media_type: str | None = None, n: int = 20) -> DataFrame:
    """The filters, over the newest n documents."""
    newest = docs.orderBy(F.desc("created_at"), F.desc("id")).limit(n)
    out = filter_type(newest, type)
    return out if media_type is None else out.where(F.col("media_type") == media_type)


def get_by_id(df: DataFrame, ids: DataFrame) -> DataFrame:
    """A row for each wanted id (column id), with found telling whether df has it."""
    return ids.select("id").distinct().join(df.withColumn("found", F.lit(True)), "id", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def resource_filter_report(docs: DataFrame, tags: list[str] | None = None, types: list[str] | None = None) -> DataFrame:
    out = filter_in(filter_tags_overlap(docs, tags), "type", types)
    return out.agg(F.count("*").alias("matched"), F.count_if(C.has_vector("embedding")).alias("usable"))
