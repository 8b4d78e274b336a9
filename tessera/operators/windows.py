"""Selections within groups, sorts and limits. row_number filters keep what a group can return before they shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _nth(df: DataFrame, key: list, order: list, n: int) -> DataFrame:
    by = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_nth", F.row_number().over(by)).where(F.col("_nth") <= n).drop("_nth")


def first_per_bucket(frames: DataFrame, interval: float = 30.0) -> DataFrame:
    """The earliest frame of each bucket of a document's timeline."""
    return _nth(frames.withColumn("bucket", F.floor(F.col("frame_timestamp") / interval)), ["document_id", "bucket"], ["frame_timestamp", "id"], 1)


def dedup_keep_first(hits: DataFrame) -> DataFrame:
    """The first hit of each chunk (without one: document) of a session, by sub-query and place."""
    return _nth(hits.withColumn("_key", F.coalesce(F.concat(F.lit("c"), F.col("chunk_id")), F.concat(F.lit("d"), F.col("id")))), ["session_id", "_key"], ["query_no", "pos"], 1).drop("_key")


def latest_version(versions: DataFrame) -> DataFrame:
    rest = [c for c in versions.columns if c != "page_id"]
    return versions.groupBy("page_id").agg(F.max_by(F.struct(*rest), "version_number").alias("v")).select("page_id", "v.*")


def reindex_chunks(chunks: DataFrame) -> DataFrame:
    """A dense index from 0 in each document, by section and place in it."""
    by = Window.partitionBy("document_id").orderBy("section", "place")
    return chunks.withColumn("chunk_index", (F.row_number().over(by) - 1).cast("long"))


def topk_per_query(scored: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def change_lag(versions: DataFrame) -> DataFrame:
    """Each version beside the one before: hash equality, difference of length, and percentage of the older length (100 where a side is missing)."""
    by = Window.partitionBy("page_id").orderBy("version_number")
    before, length = F.lag("content_hash").over(by), F.lag("content_length").over(by)
    delta = F.abs(F.col("content_length") - F.col("old_length"))
    out = versions.withColumn("old_hash", before).withColumn("old_length", length)
    pct = F.when(F.col("old_hash").isNull(), 100.0).when(F.col("old_hash") == F.col("content_hash"), 0.0).when(delta.isNull(), 100.0).otherwise(delta * 100.0 / F.greatest("old_length", F.lit(1)))
    significant = F.when(F.col("old_hash").isNull(), True).when(F.col("old_hash") == F.col("content_hash"), False).otherwise((pct > 10) | F.coalesce(delta > 1000, F.lit(False)))
    return out.select("page_id", "version_number", (~F.col("old_hash").eqNullSafe(F.col("content_hash"))).alias("changed"), pct.alias("change_percentage"), significant.alias("significant_change"))


def current_job(jobs: DataFrame) -> DataFrame:
    """Of each source its newest pending or running job, and its newest job; of jobs of one time the larger id."""
    at = F.struct("created_at", "id")
    return jobs.groupBy("source_id").agg(F.max_by("id", F.when(F.col("status").isin("pending", "running"), at)).alias("active_job"), F.max_by("id", at).alias("latest_job"))


def recent_n(df: DataFrame, key: str, order: str, n: int) -> DataFrame:
    return _nth(df, [key], [F.desc(order), F.desc("id")], n)


def topk(df: DataFrame, score: str, k: int) -> DataFrame:
    return df.orderBy(F.desc(score), "id").limit(k)


def multi_key_sort(sources: DataFrame) -> DataFrame:
    return sources.orderBy(F.desc("priority"), F.coalesce("last_crawled", F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'")), "id")


def error_sort(df: DataFrame) -> DataFrame:
    return df.orderBy(F.desc("error_count"), F.desc("last_occurrence"), "component", "error_type")


def queue_order(queue: DataFrame) -> DataFrame:
    return queue.orderBy("status", F.desc("priority"), "created_at", "id")
