"""Registered queries: scans, predicates, joins, aggregates, windows, sorts and sets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import columns as C
from tessera.operators import aggregates as A
from tessera.operators import joins as J
from tessera.operators import predicates as P
from tessera.operators import windows as W
from tessera.operators.vectors import every_score
from tessera.plans.registry import query
from tessera.session import AS_OF

TS = f"TIMESTAMP '{AS_OF}'"
TEXT = "coalesce(nullif(content_text, ''), nullif(transcription, ''), '')"
VEC = "embedding IS NOT NULL"

query("P1_filter_type", "SELECT id, type FROM kb_documents WHERE type = 'strategy'")(lambda t: P.filter_type(t("kb_documents"), "strategy").select("id", "type"))
query("P2_filter_tags_overlap", "SELECT id FROM kb_documents WHERE list_has_any(tags, ['de', 'src3'])")(lambda t: P.filter_tags_overlap(t("kb_documents"), ["de", "src3"]).select("id"))
query("P3_filter_in", "SELECT id, media_type FROM kb_documents WHERE media_type IN ('audio', 'video')")(lambda t: P.filter_in(t("kb_documents"), "media_type", ["audio", "video"]).select("id", "media_type"))
query("P4_filter_null", "SELECT id FROM kb_documents WHERE embedding IS NOT NULL")(lambda t: P.filter_null(t("kb_documents"), "embedding").select("id"))
query("P5_filter_any_of", "SELECT id FROM kb_frames WHERE contains_code OR contains_ui_elements")(lambda t: P.filter_any_of(t("kb_frames"), ["code", "ui", "unknown"]).select("id"))
query("P6_pending_sweep", "SELECT id FROM kb_documents WHERE (content_text IS NULL OR transcription IS NULL OR embedding IS NULL) AND transcription_status <> 'error' ORDER BY id LIMIT 10")(lambda t: P.pending_sweep(t("kb_documents")).select("id"))
query("P7_pending_text", "SELECT id FROM kb_documents WHERE transcription_status IS NULL OR transcription_status = 'pending' OR content_text IS NULL")(lambda t: P.pending_text(t("kb_documents")).select("id"))
query("P8_pending_media", "SELECT id FROM kb_documents WHERE media_type IN ('audio', 'video') AND transcription_status = 'pending'")(lambda t: P.pending_media(t("kb_documents")).select("id"))
query("P9_pending_embedding", f"SELECT id FROM kb_documents WHERE {TEXT} <> '' AND NOT ({VEC})")(lambda t: P.pending_embedding(t("kb_documents")).select("id"))
query("P10_stuck_uploads", f"SELECT id FROM kb_documents WHERE (content_text IS NULL OR transcription_status = 'pending') AND created_at >= {TS} - INTERVAL '24' HOUR")(lambda t: P.stuck_uploads(t("kb_documents"), AS_OF).select("id"))
query("P11_needs_processing", "SELECT id FROM kb_documents WHERE (media_type = 'text' AND content_text IS NULL) OR coalesce(transcription_status = 'pending', false) OR (media_type IN ('audio', 'video') AND transcription_status IS NULL)")(lambda t: P.needs_processing(t("kb_documents")).select("id"))
query("P12_unchunked", "SELECT id FROM kb_documents WHERE (chunk_count IS NULL OR chunk_count = 0) AND type IN ('sop', 'idea')")(lambda t: P.unchunked(t("kb_documents"), types=["sop", "idea"]).select("id"))
query("P13_log_query", "SELECT id, ts FROM kb_logs WHERE level = 'error' AND ts >= TIMESTAMP '2024-01-10 00:00:00' ORDER BY ts DESC, id DESC LIMIT 1000")(lambda t: P.log_query(t("kb_logs"), level="error", start="2024-01-10 00:00:00", limit=5_000).select("id", "ts"))
query("P14_metric_query", "SELECT id, value FROM kb_metrics WHERE component = 'component_2' AND name = 'purchase' AND ts <= TIMESTAMP '2024-01-20 00:00:00'")(lambda t: P.metric_query(t("kb_metrics"), "component_2", "purchase", end="2024-01-20 00:00:00").select("id", "value"))
query("P15_page_offset", "SELECT id, priority FROM kb_web_sources ORDER BY priority DESC, id LIMIT 20 OFFSET 40")(lambda t: P.page_offset(t("kb_web_sources"), [F.desc("priority"), "id"], page=3).select("id", "priority"))
query("P15_page_count", "SELECT count(*) AS total, cast(ceil(count(*) / 20.0) AS bigint) AS total_pages FROM kb_web_sources")(lambda t: P.page_count(t("kb_web_sources")))
query("P16_substring_search", "SELECT id FROM kb_web_sources WHERE contains(lower(url), 'a1') OR contains(lower(domain), 'a1')")(lambda t: P.substring_search(t("kb_web_sources"), "A1", ["url", "domain"]).select("id"))
query("P17_browse_filter", "SELECT id, type FROM (SELECT * FROM kb_documents ORDER BY created_at DESC, id DESC LIMIT 20) WHERE media_type = 'text'")(lambda t: P.browse_filter(t("kb_documents"), media_type="text").select("id", "type"))
query("P18_content_preview", f"SELECT id, CASE WHEN {TEXT} = '' THEN 'No content available' WHEN length({TEXT}) > 200 THEN concat(substring({TEXT}, 1, 200), '...') ELSE {TEXT} END AS preview FROM kb_documents")(lambda t: t("kb_documents").select("id", C.content_preview("content_text", "transcription").alias("preview")))
query("P19_content_or_transcription", f"SELECT id, {TEXT} AS body FROM kb_documents")(lambda t: t("kb_documents").select("id", C.content_or_transcription("content_text", "transcription").alias("body")))
EXT = "concat('.', list_extract(split(lower(file_path), '.'), -1))"
query("P20_file_extension", f"SELECT id, {EXT} AS ext FROM kb_documents")(lambda t: t("kb_documents").select("id", C.file_extension("file_path", "title").alias("ext")))
STATE = f"CASE WHEN transcription_status = 'error' THEN 'error' WHEN {VEC} THEN 'embedded' WHEN {TEXT} <> '' THEN 'processed' ELSE 'pending' END"
query("P21_status_waterfall", f"SELECT id, {STATE} AS state FROM kb_documents")(lambda t: t("kb_documents").select("id", C.status_waterfall().alias("state")))
query("P23_resource_filter_report", f"SELECT count(*) AS matched, count(*) FILTER (WHERE {VEC}) AS usable FROM kb_documents WHERE list_has_any(tags, ['en']) AND type IN ('sop', 'email')")(lambda t: P.resource_filter_report(t("kb_documents"), ["en"], ["sop", "email"]))
query("P24_get_by_id", "SELECT w.id, d.title, d.id IS NOT NULL AS found FROM (SELECT DISTINCT item_id * 29 AS id FROM benchmark) w LEFT JOIN kb_documents d ON d.id = w.id")(lambda t: P.get_by_id(t("kb_documents").select("id", "title"), t("benchmark").select((F.col("item_id") * 29).alias("id"))))

query("J1_chunk_join_document", "SELECT c.id, c.document_id, d.title, d.type FROM kb_chunks c JOIN kb_documents d ON d.id = c.document_id")(lambda t: J.chunk_join_document(t("kb_chunks"), t("kb_documents")).select("id", "document_id", "title", "type"))
query("J2_vector_left_text", "SELECT v.id, v.type, x.n FROM (SELECT id, type FROM kb_documents WHERE embedding IS NOT NULL) v LEFT JOIN (SELECT document_id AS id, count(*) AS n FROM kb_chunks GROUP BY 1) x ON v.id = x.id")(
    lambda t: J.vector_left_text(t("kb_documents").where("embedding IS NOT NULL").select("id", "type"), t("kb_chunks").groupBy(F.col("document_id").alias("id")).agg(F.count("*").alias("n")))
)
SCENES = "SELECT f.id, s.scene_number, s.scene_type FROM kb_frames f LEFT JOIN kb_scenes s ON f.document_id = s.document_id AND f.frame_timestamp BETWEEN s.start_timestamp AND s.end_timestamp"
query("J3_frame_scene_interval", SCENES)(lambda t: J.frame_scene_interval(t("kb_frames"), t("kb_scenes")).select("id", "scene_number", "scene_type"))
query("J3_frame_scene_bucketed", SCENES)(lambda t: J.frame_scene_interval(t("kb_frames"), t("kb_scenes"), width=25.0).select("id", "scene_number", "scene_type"))
query("J4_chunk_neighbours", "SELECT x.id AS target_id, c.id, c.id = x.id AS is_target FROM kb_chunks x JOIN kb_chunks c ON c.document_id = x.document_id AND c.chunk_index BETWEEN x.chunk_index - 2 AND x.chunk_index + 2")(lambda t: J.chunk_neighbours(t("kb_chunks"), t("kb_chunks")).select("target_id", "id", "is_target"))
query("J5_no_active_job", "SELECT id, domain FROM kb_web_sources s WHERE NOT EXISTS (SELECT 1 FROM kb_crawl_jobs j WHERE j.source_id = s.id AND j.status IN ('pending', 'running'))")(lambda t: J.no_active_job(t("kb_web_sources"), t("kb_crawl_jobs")).select("id", "domain"))
query("J6_technical_3way", "SELECT x.frame_id, x.content_type, f.frame_number, d.title AS document_title FROM kb_technical x JOIN kb_frames f ON f.id = x.frame_id JOIN kb_documents d ON d.id = f.document_id")(lambda t: J.technical_3way(t("kb_technical"), t("kb_frames"), t("kb_documents")).select("frame_id", "content_type", "frame_number", "document_title"))
query(
    "J7_nest_children",
    """SELECT s.id, coalesce(j.jobs, '') AS jobs, coalesce(p.pages, '') AS pages FROM kb_web_sources s
LEFT JOIN (SELECT source_id, string_agg(concat(cast(id AS varchar), ':', status), ',' ORDER BY id) AS jobs FROM kb_crawl_jobs GROUP BY 1) j ON j.source_id = s.id
LEFT JOIN (SELECT source_id, string_agg(concat(cast(id AS varchar), ':', processing_status), ',' ORDER BY id) AS pages FROM kb_pages GROUP BY 1) p ON p.source_id = s.id""",
)(
    lambda t: J.nest_children(t("kb_web_sources").select("id"), {"jobs": (t("kb_crawl_jobs"), "source_id", ["id", "status"]), "pages": (t("kb_pages"), "source_id", ["id", "processing_status"])}).select(
        "id", F.array_join(F.transform("jobs", lambda x: F.concat_ws(":", x["id"].cast("string"), x["status"])), ",").alias("jobs"), F.array_join(F.transform("pages", lambda x: F.concat_ws(":", x["id"].cast("string"), x["processing_status"])), ",").alias("pages")
    )
)
query("J8_enrich_hits", "SELECT f.id, count(a.frame_id) AS n_analysis, count(a.frame_id) AS n_technical FROM kb_frames f LEFT JOIN kb_technical a ON a.frame_id = f.id GROUP BY 1")(
    lambda t: J.enrich_hits(t("kb_frames").select("id"), t("kb_technical").select("frame_id", "confidence"), t("kb_technical")).select("id", F.size("analysis").cast("long").alias("n_analysis"), F.size("technical").cast("long").alias("n_technical"))
)
query("J9_bucket_join", "SELECT f.id, b.m AS bucket_start FROM kb_frames f JOIN (SELECT document_id, floor(frame_timestamp / 30.0) AS k, min(frame_timestamp) AS m FROM kb_frames GROUP BY 1, 2) b ON b.document_id = f.document_id AND b.k = floor(f.frame_timestamp / 30.0)")(lambda t: J.bucket_join(t("kb_frames"), 30.0).select("id", "bucket_start"))
query("J10_page_source_filter", "SELECT p.id, s.domain FROM kb_pages p JOIN kb_web_sources s ON s.id = p.source_id WHERE s.domain = (SELECT min(domain) FROM kb_web_sources)")(
    lambda t: J.page_source_filter(t("kb_pages"), t("kb_web_sources")).join(t("kb_web_sources").agg(F.min("domain").alias("domain")), "domain", "left_semi").select("id", "domain")
)
query("J11_query_cross_corpus", "SELECT q.vec_id AS query_id, e.vec_id AS id, round(list_inner_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score FROM embeddings e CROSS JOIN (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q")(
    lambda t: every_score(t("embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), t("embeddings").withColumnRenamed("vec_id", "id"), cosine=False).select("query_id", "id", F.round("score", 6).alias("score"))
)
META = "SELECT id, CASE WHEN id % 3 = 0 THEN concat('{\"page_id\":', cast(cast(floor(id / 5.0E0) AS bigint) AS varchar(20)), '}') END AS metadata FROM kb_documents"
query("J12_existing_doc_lookup", "SELECT p.page_id AS id, m.d AS existing_id FROM pages p LEFT JOIN (SELECT id // 5 AS k, min(id) AS d FROM kb_documents WHERE id % 3 = 0 GROUP BY 1) m ON m.k = p.page_id")(
    lambda t: J.existing_doc_lookup(t("kb_pages").select("id"), t("kb_documents").withColumn("metadata", F.when(F.col("id") % 3 == 0, F.to_json(F.struct(F.floor(F.col("id") / 5).alias("page_id"))))))
)

GS = "SELECT 'status' AS dim, status AS key, count(*) AS n FROM kb_web_sources GROUP BY status UNION ALL SELECT 'domain', domain, count(*) FROM kb_web_sources GROUP BY domain UNION ALL SELECT 'total', NULL, count(*) FROM kb_web_sources"
query("A1_status_domain_counts", GS)(lambda t: A.status_domain_counts(t("kb_web_sources")))
query("A2_ext_counts", f"SELECT {EXT} AS ext, count(*) AS n FROM kb_documents GROUP BY 1")(lambda t: A.ext_counts(t("kb_documents")))
query("A3_total_size", "SELECT cast(coalesce(sum(file_size), 0) AS bigint) AS total_size FROM kb_documents")(lambda t: A.total_size(t("kb_documents")))
query("A4_processing_status", "SELECT " + ", ".join(f"count(*) FILTER (WHERE s = '{s}') AS {s}" for s in ("pending", "processed", "embedded", "error")) + f" FROM (SELECT {STATE} AS s FROM kb_documents)")(lambda t: A.processing_status(t("kb_documents")))
query(
    "A5_background_stats",
    f"""SELECT count(*) AS total, count(*) FILTER (WHERE transcription_status IS NULL OR transcription_status = 'pending') AS pending, count(*) FILTER (WHERE transcription_status = 'completed') AS completed,
count(*) FILTER (WHERE transcription_status = 'error') AS error, count(*) FILTER (WHERE coalesce(content_text, '') <> '') AS with_content, count(*) FILTER (WHERE coalesce(transcription, '') <> '') AS with_transcription, count(*) FILTER (WHERE {VEC}) AS with_embedding FROM kb_documents""",
)(lambda t: A.background_stats(t("kb_documents")))
DEBUG = f"count(*) AS n, count(*) FILTER (WHERE coalesce(content_text, '') <> '') AS with_content, count(*) FILTER (WHERE {VEC}) AS with_embedding FROM kb_documents"
query("A6_corpus_debug_summary", f"SELECT 'type' AS dim, type AS key, {DEBUG} GROUP BY type UNION ALL SELECT 'media_type', media_type, {DEBUG} GROUP BY media_type UNION ALL SELECT 'total', NULL, {DEBUG}")(lambda t: A.corpus_debug_summary(t("kb_documents")))
NOTEXT, NOTRANS = "(media_type = 'text' AND coalesce(content_text, '') = '')", "(media_type IN ('audio', 'video') AND coalesce(transcription, '') = '')"
NOVEC = f"({TEXT} <> '' AND NOT ({VEC}))"
query("A7_pending_report", f"SELECT coalesce(transcription_status, 'no_status') AS status, count(*) AS n, count(*) FILTER (WHERE {NOTEXT}) AS no_text, count(*) FILTER (WHERE {NOTRANS}) AS no_transcript, count(*) FILTER (WHERE {NOVEC}) AS no_vector, count(*) FILTER (WHERE {NOTEXT} OR {NOTRANS} OR {NOVEC}) AS with_issue FROM kb_documents GROUP BY 1")(lambda t: A.pending_report(t("kb_documents")))
query("A8_processing_stats", "SELECT count(*) AS total, count(*) FILTER (WHERE transcription_status = 'completed') AS completed, count(*) FILTER (WHERE transcription_status = 'completed') * 100.0e0 / count(*) AS rate, cast(sum(chunk_count) AS bigint) AS total_chunks, sum(chunk_count) / cast(count(*) AS double) AS avg_chunks FROM kb_documents")(lambda t: A.processing_stats(t("kb_documents")))
RES = lambda t: t("kb_documents").select("id", F.coalesce(F.col("transcription_status") == "completed", F.lit(False)).alias("ok"), F.coalesce("transcription_status", F.lit("none")).alias("error"))
query("A9_reprocess_summary", "SELECT count(*) FILTER (WHERE ok) AS succeeded, count(*) FILTER (WHERE NOT ok) AS failed, count(*) FILTER (WHERE ok) * 100.0e0 / count(*) AS rate, (SELECT string_agg(concat(e, ': ', cast(n AS varchar)), ';' ORDER BY e) FROM (SELECT coalesce(transcription_status, 'none') AS e, count(*) AS n FROM kb_documents WHERE NOT coalesce(transcription_status = 'completed', false) GROUP BY 1)) AS errors FROM (SELECT coalesce(transcription_status = 'completed', false) AS ok FROM kb_documents)")(
    lambda t: A.reprocess_summary(RES(t)).withColumn("errors", F.array_join("errors", ";"))
)
NEWJOBS = "SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY created_at DESC, id DESC) AS nth FROM kb_crawl_jobs"
query("A10_crawl_job_stats", "SELECT source_id, count(*) AS total, " + ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS {s}" for s in ("completed", "failed", "running", "pending")) + f" FROM ({NEWJOBS}) WHERE nth <= 5 GROUP BY 1")(lambda t: A.crawl_job_stats(t("kb_crawl_jobs"), 5))
query(
    "A11_recent_page_status",
    "SELECT p.source_id, count(*) AS total_pages, " + ", ".join(f"count(*) FILTER (WHERE nth <= 3 AND processing_status = '{s}') AS {s}" for s in ("pending", "completed", "error", "skipped")) + ", max(j.last_job) AS last_job FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY crawled_at DESC, id DESC) AS nth FROM kb_pages) p LEFT JOIN (SELECT source_id, arg_max(id, created_at) AS last_job FROM kb_crawl_jobs GROUP BY 1) j ON j.source_id = p.source_id GROUP BY 1",
)(lambda t: A.recent_page_status(t("kb_pages"), t("kb_crawl_jobs"), 3))
query("A12_frame_summary", "SELECT f.document_id, count(*) AS frames, count(*) FILTER (WHERE contains_code) AS with_code, count(*) FILTER (WHERE contains_diagrams) AS with_diagrams, count(*) FILTER (WHERE contains_ui_elements) AS with_ui, (SELECT count(*) FROM kb_scenes s WHERE s.document_id = f.document_id) AS scenes FROM kb_frames f GROUP BY 1")(lambda t: A.frame_summary(t("kb_frames"), t("kb_scenes")))
query("A13_search_summary", "SELECT count(*) AS total, count(*) FILTER (WHERE chunk_id IS NOT NULL) AS frames, count(*) FILTER (WHERE chunk_id IS NULL) AS documents, round(avg(similarity), 6) AS mean_similarity FROM kb_all_hits")(
    lambda t: A.search_summary(t("kb_all_hits").withColumn("origin", F.when(F.col("chunk_id").isNotNull(), "frame").otherwise("document"))).withColumn("mean_similarity", F.round("mean_similarity", 6))
)
query("A14_health_trend", f"SELECT date_trunc('hour', ts) AS time_bucket, round(avg(avg_response_time), 6) AS avg_response_time, round(avg(error_rate), 6) AS avg_error_rate, round(avg(throughput), 6) AS avg_throughput, round(count(*) FILTER (WHERE overall_status = 'healthy') * 100.0e0 / count(*), 6) AS healthy_percentage FROM kb_health WHERE ts >= {TS} - INTERVAL '240' HOUR GROUP BY 1")(
    lambda t: A.health_trend(t("kb_health"), AS_OF, 240).select("time_bucket", *[F.round(c, 6).alias(c) for c in ("avg_response_time", "avg_error_rate", "avg_throughput", "healthy_percentage")])
)
query("A15_error_summary", f"SELECT component, error_type, count(*) AS error_count, max(ts) AS last_occurrence, count(*) FILTER (WHERE resolved) AS resolved_count FROM kb_errors WHERE ts >= {TS} - INTERVAL '240' HOUR GROUP BY 1, 2")(lambda t: A.error_summary(t("kb_errors"), AS_OF, 240))
query("A16_performance_summary", f"SELECT name, unit, round(avg(value), 6) AS avg_value, min(value) AS min_value, max(value) AS max_value, count(*) AS sample_count FROM kb_metrics WHERE ts >= {TS} - INTERVAL '240' HOUR GROUP BY 1, 2")(lambda t: A.performance_summary(t("kb_metrics"), AS_OF, hours=240).withColumn("avg_value", F.round("avg_value", 6)))
query("A17_query_analytics_summary", f"SELECT query_type, search_strategy, count(*) AS query_count, round(avg(response_time_ms), 6) AS avg_response_time, round(avg(confidence_score), 6) AS avg_confidence, round(avg(result_count), 6) AS avg_results FROM kb_queries WHERE created_at >= {TS} - INTERVAL '240' HOUR GROUP BY 1, 2")(
    lambda t: A.query_analytics_summary(t("kb_queries"), AS_OF, 240).select("query_type", "search_strategy", "query_count", *[F.round(c, 6).alias(c) for c in ("avg_response_time", "avg_confidence", "avg_results")])
)
query("A18_metric_aggregate", "SELECT component, name, max(value) AS value FROM kb_metrics WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' GROUP BY 1, 2")(lambda t: A.metric_aggregate(t("kb_metrics"), "max", start="2024-01-10 00:00:00"))
query("A19_throughput", "SELECT count(*) / 24.0e0 AS throughput FROM kb_logs WHERE ts >= TIMESTAMP '2024-01-20 00:00:00' - INTERVAL '24' HOUR AND component = 'component_1'")(lambda t: A.throughput(t("kb_logs"), "2024-01-20 00:00:00", "component_1"))
LIMITS = "(VALUES ('component_0', 30.0e0, 60.0e0), ('component_1', 50.0e0, 90.0e0), ('component_2', 60.0e0, 90.0e0), ('component_3', 50.0e0, 70.0e0)) l(component, healthy, degraded)"
query(
    "A20_health_rollup",
    f"WITH c AS (SELECT component, round(avg(value), 6) AS response_time FROM kb_metrics GROUP BY 1), s AS (SELECT c.*, CASE WHEN response_time < healthy THEN 'healthy' WHEN response_time < degraded THEN 'degraded' ELSE 'unhealthy' END AS state FROM c JOIN {LIMITS} ON l.component = c.component) SELECT CASE WHEN bool_and(state = 'healthy') THEN 'healthy' WHEN bool_or(state = 'unhealthy') THEN 'unhealthy' ELSE 'degraded' END AS overall_status, round(sum(response_time) / 4.0e0, 6) AS avg_response_time, count(*) FILTER (WHERE state = 'unhealthy') * 100.0e0 / 4.0e0 AS error_rate FROM s",
)(
    lambda t: A.health_rollup(t("kb_metrics").groupBy("component").agg(F.round(F.avg("value"), 6).alias("response_time")).withColumn("ok", F.lit(True)), t.spark.sql(f"SELECT * FROM {LIMITS}")).withColumn("avg_response_time", F.round("avg_response_time", 6))
)
query("A21_string_agg_distinct", "SELECT component, string_agg(DISTINCT action, ' | ' ORDER BY action) AS action FROM kb_logs GROUP BY 1")(lambda t: A.string_agg_distinct(t("kb_logs"), "component", "action"))
query("A22_distinct_tags", "SELECT DISTINCT unnest(tags) AS tag FROM kb_documents")(lambda t: A.distinct_tags(t("kb_documents")))
query("A24_share_of_total", "SELECT type AS key, count(*) AS n, round(count(*) * 100.0e0 / (SELECT count(*) FROM kb_documents), 1) AS pct FROM kb_documents GROUP BY 1")(lambda t: A.share_of_total(t("kb_documents").groupBy(F.col("type").alias("key")).agg(F.count("*").alias("n"))))
query("A25_scene_stats", "SELECT document_id, round(d / n, 6) AS avg_scene_length, least(n, 10) AS n_keys, CASE WHEN n > 1 THEN round(d, 6) ELSE 0e0 END AS last_key FROM (SELECT document_id, max(frame_timestamp) AS d, count(*) AS n FROM kb_frames GROUP BY 1)")(
    lambda t: A.scene_stats(t("kb_frames"), t("kb_frames").groupBy("document_id").agg(F.max("frame_timestamp").alias("duration"))).select("document_id", F.round("avg_scene_length", 6).alias("avg_scene_length"), F.size("key_timestamps").cast("long").alias("n_keys"), F.round(F.element_at("key_timestamps", -1), 6).alias("last_key"))
)
query("A26_avg_page_time", "SELECT source_id AS job_id, count(*) AS pages, count(*) FILTER (WHERE processing_status = 'completed') AS processed, count(*) FILTER (WHERE processing_status = 'error') AS failed, round(avg(id % 17), 6) AS avg_page_time, cast(sum(id % 17) AS bigint) AS duration FROM kb_pages GROUP BY 1")(
    lambda t: A.avg_page_time(t("kb_pages").select(F.col("source_id").alias("job_id"), (F.col("id") % 17).alias("seconds"), F.col("processing_status").alias("status"))).withColumn("avg_page_time", F.round("avg_page_time", 6))
)

query("W1_first_per_bucket", "SELECT DISTINCT ON (document_id, floor(frame_timestamp / 30.0)) id, document_id FROM kb_frames ORDER BY document_id, floor(frame_timestamp / 30.0), frame_timestamp, id")(lambda t: W.first_per_bucket(t("kb_frames")).select("id", "document_id"))
DEDUP = "SELECT query_id % 7 AS session_id, query_id AS query_no, id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS pos FROM kb_all_hits"
query("W2_dedup_keep_first", f"SELECT session_id, query_no, id FROM (SELECT *, row_number() OVER (PARTITION BY session_id, coalesce('c' || cast(chunk_id AS varchar), 'd' || cast(id AS varchar)) ORDER BY query_no, pos) AS nth FROM ({DEDUP})) WHERE nth = 1")(
    lambda t: W.dedup_keep_first(W.topk_per_query(t("kb_all_hits").withColumnRenamed("rank", "r").withColumn("score", F.col("similarity")), 10**9).select((F.col("query_id") % 7).alias("session_id"), F.col("query_id").alias("query_no"), "id", "chunk_id", F.col("rank").alias("pos"))).select("session_id", "query_no", "id")
)
query("W3_latest_version", "SELECT page_id, max(version_number) AS version_number, arg_max(content_length, version_number) AS content_length FROM kb_versions GROUP BY 1")(lambda t: W.latest_version(t("kb_versions")).select("page_id", "version_number", "content_length"))
query("W4_reindex_chunks", "SELECT id, row_number() OVER (PARTITION BY document_id ORDER BY chunk_index % 3, chunk_index) - 1 AS chunk_index FROM kb_chunks")(lambda t: W.reindex_chunks(t("kb_chunks").withColumn("section", F.col("chunk_index") % 3).withColumn("place", F.col("chunk_index"))).select("id", "chunk_index"))
query("W5_topk_per_query", "SELECT query_id, id, rank FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM kb_all_hits) WHERE rank <= 5")(lambda t: W.topk_per_query(t("kb_all_hits").withColumn("score", F.col("similarity")), 5).select("query_id", "id", F.col("rank").cast("long").alias("rank")))
VER = "SELECT page_id, version_number, content_length, sha256(trim(regexp_replace(content_text, '\\s+', ' ', 'g'))) AS h FROM kb_versions"
LAGGED = f"SELECT page_id, version_number, content_length AS n, h, lag(h) OVER w AS oh, lag(content_length) OVER w AS o FROM ({VER}) WINDOW w AS (PARTITION BY page_id ORDER BY version_number)"
PCT = "CASE WHEN oh IS NULL THEN 100.0e0 WHEN oh = h THEN 0.0e0 ELSE abs(n - o) * 100.0e0 / greatest(o, 1) END"
query("W6_change_lag", f"SELECT page_id, version_number, oh IS NULL OR oh <> h AS changed, round({PCT}, 6) AS change_percentage, CASE WHEN oh IS NULL THEN true WHEN oh = h THEN false ELSE {PCT} > 10 OR abs(n - o) > 1000 END AS significant_change FROM ({LAGGED})")(
    lambda t: W.change_lag(t("kb_versions").withColumn("content_hash", C.content_hash("content_text"))).withColumn("change_percentage", F.round("change_percentage", 6))
)
query("W7_current_job", "SELECT source_id, arg_max(id, (created_at, id)) FILTER (WHERE status IN ('pending', 'running')) AS active_job, arg_max(id, (created_at, id)) AS latest_job FROM kb_crawl_jobs GROUP BY 1")(lambda t: W.current_job(t("kb_crawl_jobs")))
query("W8_recent_n", "SELECT id, type FROM (SELECT *, row_number() OVER (PARTITION BY type ORDER BY created_at DESC, id DESC) AS nth FROM kb_documents) WHERE nth <= 5")(lambda t: W.recent_n(t("kb_documents"), "type", "created_at", 5).select("id", "type"))
query("W9_ordered_dedup_limit", "SELECT doc_id, cast(least(len(list_distinct(regexp_extract_all(text, '[^ \\n]+'))), 100) AS bigint) AS n FROM documents")(lambda t: t("documents").select("doc_id", F.size(C.ordered_dedup_limit(F.regexp_extract_all("text", F.lit("[^ \\n]+"), F.lit(0)))).cast("long").alias("n")))

query("O1_topk", "SELECT id, response_time_ms FROM kb_queries ORDER BY response_time_ms DESC, id LIMIT 25")(lambda t: W.topk(t("kb_queries"), "response_time_ms", 25).select("id", "response_time_ms"))
query("O2_multi_key_sort", "SELECT id, row_number() OVER (ORDER BY priority DESC, coalesce(last_crawled, TIMESTAMP '1970-01-01 00:00:00'), id) AS place FROM kb_web_sources ORDER BY place LIMIT 50")(
    lambda t: W.multi_key_sort(t("kb_web_sources")).limit(50).select("id", F.row_number().over(Window.orderBy(F.desc("priority"), F.coalesce("last_crawled", F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'")), "id")).cast("long").alias("place"))
)
query("O3_error_sort", f"SELECT component, error_type, count(*) AS error_count, max(ts) AS last_occurrence FROM kb_errors WHERE ts >= {TS} - INTERVAL '240' HOUR GROUP BY 1, 2 ORDER BY 3 DESC, 4 DESC LIMIT 4")(lambda t: W.error_sort(A.error_summary(t("kb_errors"), AS_OF, 240)).limit(4).drop("resolved_count"))
query("O4_queue_order", "SELECT id, status FROM kb_crawl_jobs ORDER BY status, pages_crawled DESC, created_at, id LIMIT 40")(lambda t: W.queue_order(t("kb_crawl_jobs").withColumn("priority", F.col("pages_crawled"))).limit(40).select("id", "status"))
query("U1_union_all", "SELECT id, 'document' AS kind FROM kb_documents UNION ALL SELECT id, 'chunk' FROM kb_chunks")(lambda t: J.union_all(t("kb_documents").select("id", F.lit("document").alias("kind")), t("kb_chunks").select(F.lit("chunk").alias("kind"), "id")))
query("U2_union_sources", "SELECT id, title, NULL AS url, 'document' AS origin FROM kb_documents UNION ALL SELECT id, NULL, NULL, 'multimodal' FROM kb_frames UNION ALL SELECT id, NULL, url, 'web' FROM kb_pages")(lambda t: J.union_sources(t("kb_documents").select("id", "title"), t("kb_frames").select("id"), t("kb_pages").select("id", "url")))
query("U3_union_ids_distinct", "SELECT id FROM kb_documents WHERE content_text IS NULL UNION SELECT id FROM kb_documents WHERE embedding IS NULL UNION SELECT id FROM kb_documents WHERE transcription_status = 'error'")(lambda t: J.union_ids_distinct(t("kb_documents").where("content_text IS NULL"), t("kb_documents").where("embedding IS NULL"), t("kb_documents").where("transcription_status = 'error'")))
query("U4_url_set_difference", "SELECT DISTINCT url FROM pages WHERE url NOT IN (SELECT url FROM pages WHERE page_id % 3 = 0) AND url NOT IN (SELECT url FROM pages WHERE page_id % 5 = 0)")(lambda t: J.url_set_difference(t("pages"), t("pages").where("page_id % 3 = 0"), t("pages").where("page_id % 5 = 0")))
