"""Roll-ups of documents, sources, jobs, frames and telemetry. Partial aggregation happens before each shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import columns as C
from tessera.operators.predicates import metric_query


def _since(as_of: str, hours: float) -> Column:
    return F.col("ts") >= F.expr(f"TIMESTAMP_NTZ '{as_of}' - INTERVAL '{int(hours * 3600)}' SECOND")


def _count(condition) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def status_domain_counts(sources: DataFrame) -> DataFrame:
    """Counts by status, by domain and in all, in one pass over grouping sets."""
    status, domain = F.col("status"), F.col("domain")
    grouped = sources.groupingSets([[status], [domain], []], status, domain).agg(F.grouping_id().alias("g"), F.count("*").alias("n"))
    return grouped.select(F.when(F.col("g") == 1, "status").when(F.col("g") == 2, "domain").otherwise("total").alias("dim"), F.when(F.col("g") == 1, status).when(F.col("g") == 2, domain).alias("key"), "n")


def ext_counts(docs: DataFrame) -> DataFrame:
    return docs.groupBy(C.file_extension("file_path", "title").alias("ext")).agg(F.count("*").alias("n"))


def total_size(docs: DataFrame) -> DataFrame:
    return docs.agg(F.coalesce(F.sum("file_size"), F.lit(0)).alias("total_size"))


def processing_status(docs: DataFrame) -> DataFrame:
    state = docs.select(C.status_waterfall().alias("s"))
    return state.agg(*[F.count_if(F.col("s") == s).alias(s) for s in ("pending", "processed", "embedded", "error")])


def background_stats(docs: DataFrame) -> DataFrame:
    status = F.col("transcription_status")
    return docs.agg(
        F.count("*").alias("total"),
        F.count_if(status.isNull() | (status == "pending")).alias("pending"),
        _count(status == "completed").alias("completed"),
        _count(status == "error").alias("error"),
        F.count_if(F.coalesce(F.col("content_text"), F.lit("")) != "").alias("with_content"),
        F.count_if(F.coalesce(F.col("transcription"), F.lit("")) != "").alias("with_transcription"),
        F.count_if(F.col("embedding").isNotNull()).alias("with_embedding"),
    )


def corpus_debug_summary(docs: DataFrame) -> DataFrame:
    """Rows in all, by type and by media type, with how many have content and a vector."""
    kind, media = F.col("type"), F.col("media_type")
    out = docs.groupingSets([[kind], [media], []], kind, media).agg(F.grouping_id().alias("g"), F.count("*").alias("n"), F.count_if(F.coalesce(F.col("content_text"), F.lit("")) != "").alias("with_content"), F.count_if(C.has_vector("embedding")).alias("with_embedding"))
    return out.select(F.when(F.col("g") == 1, "type").when(F.col("g") == 2, "media_type").otherwise("total").alias("dim"), F.when(F.col("g") == 1, kind).when(F.col("g") == 2, media).alias("key"), "n", "with_content", "with_embedding")


def pending_report(docs: DataFrame) -> DataFrame:
    """A row for each status (null: no_status), and of each the documents with an issue: no text, no transcript of media, no vector for their text."""
    no_text = (F.col("media_type") == "text") & (F.coalesce(F.col("content_text"), F.lit("")) == "")
    no_transcript = F.col("media_type").isin("audio", "video") & (F.coalesce(F.col("transcription"), F.lit("")) == "")
    no_vector = (C.content_or_transcription("content_text", "transcription") != "") & ~C.has_vector("embedding")
    return docs.groupBy(F.coalesce("transcription_status", F.lit("no_status")).alias("status")).agg(
        F.count("*").alias("n"), _count(no_text).alias("no_text"), _count(no_transcript).alias("no_transcript"), _count(no_vector).alias("no_vector"), _count(no_text | no_transcript | no_vector).alias("with_issue")
    )


def processing_stats(docs: DataFrame) -> DataFrame:
    n, done, chunks = F.count("*"), _count(F.col("transcription_status") == "completed"), F.coalesce(F.sum("chunk_count"), F.lit(0))
    return docs.where("chunk_count IS NOT NULL").agg(
        n.alias("total"), done.alias("completed"), F.when(n > 0, done * 100.0 / n).otherwise(0.0).alias("rate"), chunks.alias("total_chunks"), F.when(n > 0, chunks / n).otherwise(0.0).alias("avg_chunks")
    )


def reprocess_summary(results: DataFrame) -> DataFrame:
    """results: id, ok, error. Successes, failures, the rate, and how often each error text occurs."""
    counts = results.agg(F.count_if("ok").alias("succeeded"), F.count_if(~F.col("ok")).alias("failed"), F.when(F.count("*") > 0, F.count_if("ok") * 100.0 / F.count("*")).otherwise(0.0).alias("rate"))
    errors = results.where("NOT ok").groupBy("error").agg(F.count("*").alias("n")).agg(F.array_sort(F.collect_list(F.concat_ws(": ", "error", F.col("n").cast("string")))).alias("errors"))
    return counts.crossJoin(errors)


def _newest(df: DataFrame, key: str, n: int, at: str = "created_at") -> DataFrame:
    order = Window.partitionBy(key).orderBy(F.desc(at), F.desc("id"))
    return df.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= n).drop("nth")


def crawl_job_stats(jobs: DataFrame, n: int = 10) -> DataFrame:
    """Of each source's newest n jobs: how many, and how many in each state."""
    return _newest(jobs, "source_id", n).groupBy("source_id").agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in ("completed", "failed", "running", "pending")])


def recent_page_status(pages: DataFrame, jobs: DataFrame, n: int = 100) -> DataFrame:
    """Of each source: states of its newest n pages, all its pages, and its last job."""
    newest = _newest(pages, "source_id", n, "crawled_at").groupBy("source_id").agg(*[F.count_if(F.col("processing_status") == s).alias(s) for s in ("pending", "completed", "error", "skipped")])
    whole = pages.groupBy("source_id").agg(F.count("*").alias("total_pages"))
    last = jobs.groupBy("source_id").agg(F.max_by("id", F.struct("created_at", "id")).alias("last_job"))
    return whole.join(newest, "source_id").join(last, "source_id", "left")


def frame_summary(frames: DataFrame, scenes: DataFrame) -> DataFrame:
    f = frames.groupBy("document_id").agg(F.count("*").alias("frames"), *[_count(F.col(c)).alias(f"with_{n}") for n, c in (("code", "contains_code"), ("diagrams", "contains_diagrams"), ("ui", "contains_ui_elements"))])
    return f.join(scenes.groupBy("document_id").agg(F.count("*").alias("scenes")), "document_id", "left").withColumn("scenes", F.coalesce("scenes", F.lit(0)))


def search_summary(hits: DataFrame) -> DataFrame:
    return hits.agg(F.count("*").alias("total"), F.count_if(F.col("origin") == "frame").alias("frames"), F.count_if(F.col("origin") == "document").alias("documents"), F.coalesce(F.avg("similarity"), F.lit(0.0)).alias("mean_similarity"))


def health_trend(snapshots: DataFrame, as_of: str, hours: int = 24, bucket: str = "hour") -> DataFrame:
    recent = snapshots.where(_since(as_of, hours))
    return recent.groupBy(F.date_trunc(bucket, "ts").cast("timestamp_ntz").alias("time_bucket")).agg(
        F.avg("avg_response_time").alias("avg_response_time"), F.avg("error_rate").alias("avg_error_rate"), F.avg("throughput").alias("avg_throughput"), (F.count_if(F.col("overall_status") == "healthy") * 100.0 / F.count("*")).alias("healthy_percentage")
    )


def error_summary(errors: DataFrame, as_of: str, hours: int = 24) -> DataFrame:
    return errors.where(_since(as_of, hours)).groupBy("component", "error_type").agg(F.count("*").alias("error_count"), F.max("ts").alias("last_occurrence"), F.count_if("resolved").alias("resolved_count"))


def performance_summary(metrics: DataFrame, as_of: str, component: str | None = None, hours: int = 24) -> DataFrame:
    recent = metrics.where(_since(as_of, hours))
    recent = recent if component is None else recent.where(F.col("component") == component)
    return recent.groupBy("name", "unit").agg(F.avg("value").alias("avg_value"), F.min("value").alias("min_value"), F.max("value").alias("max_value"), F.count("*").alias("sample_count"))


def query_analytics_summary(q: DataFrame, as_of: str, hours: int = 24) -> DataFrame:
    recent = q.where(F.col("created_at") >= F.expr(f"TIMESTAMP_NTZ '{as_of}' - INTERVAL '{hours}' HOUR"))
    return recent.groupBy("query_type", "search_strategy").agg(F.count("*").alias("query_count"), F.avg("response_time_ms").alias("avg_response_time"), F.avg("confidence_score").alias("avg_confidence"), F.avg("result_count").alias("avg_results"))


AGGREGATES = {"avg": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "count": F.count}


def metric_aggregate(metrics: DataFrame, agg: str, component=None, name=None, start=None, end=None) -> DataFrame:
    if agg not in AGGREGATES:
        raise ValueError(f"agg must be one of {', '.join(AGGREGATES)}")
    return metric_query(metrics, component, name, start, end).groupBy("component", "name").agg(AGGREGATES[agg]("value").alias("value"))


def throughput(logs: DataFrame, as_of: str, component: str = "api") -> DataFrame:
    """Log rows of a component in the last 24 hours, an hour."""
    return logs.where(_since(as_of, 24) & (F.col("component") == component)).agg((F.count("*") / 24.0).alias("throughput"))


# Milliseconds under which a component is healthy, and degraded.
HEALTH_LIMITS = {"database": (1000.0, 3000.0), "vector_search": (2000.0, 5000.0), "embedding_api": (3000.0, 10000.0), "storage": (2000.0, 5000.0)}


def health_limits(spark: SparkSession) -> DataFrame:
    """HEALTH_LIMITS as a table (component, healthy, degraded)."""
    return spark.createDataFrame([(name, *limits) for name, limits in HEALTH_LIMITS.items()], "component string, healthy double, degraded double")


def health_rollup(checks: DataFrame, thresholds: DataFrame | None = None, components: int = 4) -> DataFrame:
    """checks (component, response_time, ok) against thresholds (component, healthy, degraded; without them health_limits): one row of states, means over a fixed number of components."""
    thresholds = health_limits(checks.sparkSession) if thresholds is None else thresholds
    state = F.when(~F.col("ok"), "unhealthy").when(F.col("response_time") < F.col("healthy"), "healthy").when(F.col("response_time") < F.col("degraded"), "degraded").otherwise("unhealthy")
    rated = checks.join(thresholds, "component").withColumn("state", state)
    overall = F.when(F.bool_and(F.col("state") == "healthy"), "healthy").when(F.bool_or(F.col("state") == "unhealthy"), "unhealthy").otherwise("degraded")
    return rated.agg(overall.alias("overall_status"), (F.sum("response_time") / components).alias("avg_response_time"), (F.count_if(F.col("state") == "unhealthy") * 100.0 / components).alias("error_rate"))


def string_agg_distinct(df: DataFrame, key: str, col: str, sep: str = " | ") -> DataFrame:
    return df.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(col)), sep).alias(col))


def distinct_tags(docs: DataFrame) -> DataFrame:
    return docs.select(F.explode("tags").alias("tag")).distinct()


def share_of_total(counts: DataFrame) -> DataFrame:
    """counts (key, n) with each row's percentage of the sum, to one decimal."""
    whole = counts.agg(F.sum("n").alias("whole"))
    return counts.crossJoin(F.broadcast(whole)).select("key", "n", F.round(F.col("n") * 100.0 / F.col("whole"), 1).alias("pct"))


def scene_stats(frames: DataFrame, durations: DataFrame, keys: int = 10) -> DataFrame:
    """durations (document_id, duration): mean scene length by frames, and at most `keys` evenly spaced timestamps (one: 0.0)."""
    n = frames.groupBy("document_id").agg(F.count("*").alias("n"))
    k = F.least(F.col("n"), F.lit(keys))
    at = F.when(k == 1, F.array(F.lit(0.0))).when(k > 1, F.transform(F.sequence(F.lit(0).cast("long"), k - 1), lambda i: i * F.col("duration") / (k - 1))).otherwise(F.array().cast("array<double>"))
    out = durations.join(n, "document_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.select("document_id", (F.col("duration") / F.greatest(F.col("n"), F.lit(1))).alias("avg_scene_length"), at.alias("key_timestamps"))


def avg_page_time(pages: DataFrame) -> DataFrame:
    """pages (job_id, seconds, status): totals of each job."""
    return pages.groupBy("job_id").agg(F.count("*").alias("pages"), F.count_if(F.col("status") == "completed").alias("processed"), F.count_if(F.col("status") == "error").alias("failed"), F.avg("seconds").alias("avg_page_time"), F.sum("seconds").alias("duration"))
