"""Registered queries: tables, text processing, media, validation and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import columns as C
from tessera.operators import media as M
from tessera.operators import text as X
from tessera.operators import validation as D
from tessera.operators.vectors import hashed_embedder
from tessera.plans.fixtures import Tables
from tessera.plans.registry import query
from tessera.session import AS_OF
from tessera.sources import files, partitioned
from tessera.sources import tables as S
from tessera.sources.scratch import folder
from tessera.streaming import streams

TS = f"TIMESTAMP '{AS_OF}'"

query("S1_scan_project", "SELECT id, title, type FROM kb_documents")(lambda t: S.scan_project(t("kb_documents"), ["id", "title", "type"]))
query("S2_count_exact", "SELECT count(*) AS n FROM kb_documents WHERE transcription_status = 'error'")(lambda t: S.count_exact(t("kb_documents"), F.col("transcription_status") == "error"))


def uploads(t: Tables) -> DataFrame:
    """Parts of uploads: twenty documents a session, but for every 37th, which is missing."""
    name = F.concat(F.lit("/in/chunks/s"), F.floor(F.col("doc_id") / 20).cast("string"), F.lit("/chunk_"), F.lpad((F.col("doc_id") % 20).cast("string"), 6, "0"))
    return t("documents").where("doc_id % 37 <> 36").select(name.alias("path"), F.col("text").alias("content"))


def promised(t: Tables) -> DataFrame:
    return t("documents").groupBy(F.concat(F.lit("s"), F.floor(F.col("doc_id") / 20).cast("string")).alias("session")).agg((F.max(F.col("doc_id") % 20) + 1).alias("expected"))


PARTS = "SELECT concat('s', cast(doc_id // 20 AS varchar)) AS session, doc_id % 20 AS part, doc_id % 37 <> 36 AS there, text FROM documents"
query("S3_blob_manifest", f"SELECT session, cast(count(*) FILTER (WHERE there) AS int) AS found, cast(max(part) + 1 AS bigint) AS expected, bool_and(there) AS complete, coalesce(string_agg(cast(part AS varchar), ',' ORDER BY part) FILTER (WHERE NOT there), '') AS missing FROM ({PARTS}) GROUP BY 1")(
    lambda t: S.blob_manifest(uploads(t), promised(t)).withColumn("missing", F.array_join(F.transform("missing", lambda x: x.cast("string")), ","))
)
query("S4_blob_reassemble", f"SELECT session, CASE WHEN bool_and(there) THEN sha256(string_agg(text, '' ORDER BY part)) END AS digest, CASE WHEN bool_and(there) THEN 'completed' ELSE 'error' END AS status FROM ({PARTS.replace('% 37 <> 36', '% 29 <> 28')}) GROUP BY 1")(
    lambda t: S.blob_reassemble(t("documents").where("doc_id % 29 <> 28").select(F.concat(F.lit("chunks/s"), F.floor(F.col("doc_id") / 20).cast("string"), F.lit("/chunk_"), F.lpad((F.col("doc_id") % 20).cast("string"), 6, "0")).alias("path"), F.col("text").alias("content")), promised(t)).select("session", F.sha2("content", 256).alias("digest"), "status")
)
query("S5_text_ingest", "SELECT id, regexp_extract(lower(file_path), '(\\.[^./]+)$', 1) AS ext, CASE WHEN lower(file_path) LIKE '%.txt' OR lower(file_path) LIKE '%.md' THEN length(trim(content_text)) END AS n, CASE WHEN lower(file_path) LIKE '%.txt' OR lower(file_path) LIKE '%.md' THEN 'completed' ELSE 'error' END AS status FROM kb_documents WHERE content_text IS NOT NULL")(
    lambda t: S.text_ingest(t("kb_documents").where("content_text IS NOT NULL").select("id", F.col("file_path").alias("path"), F.col("content_text").alias("content"))).select("id", "ext", F.length("content_text").cast("long").alias("n"), "status")
)
query("S3_file_manifest")(lambda t: files.manifest(files.read_files(t.spark, t.sf_dir, "*.parquet")).select("name", "ext", "length"))
query("S6_whitespace_clean", "SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS cleaned FROM documents")(lambda t: t("documents").select("doc_id", C.whitespace_clean("text").alias("cleaned")))
query("S7_json_field", "SELECT event_id, json_extract_string(props, '$.k') AS field FROM events")(lambda t: t("events").select("event_id", C.json_field("props", "$.k").alias("field")))
NEW = lambda t: t("kb_documents").where("id % 4 = 0").select("id", F.concat("title", F.lit(" v2")).alias("title"), "type").unionByName(t("kb_documents").where("id % 100 = 1").select((F.col("id") + 1_000_000).alias("id"), "title", "type"))
UPSERTED = "SELECT id, CASE WHEN id % 4 = 0 THEN concat(title, ' v2') ELSE title END AS title, type FROM kb_documents UNION ALL SELECT id + 1000000, title, type FROM kb_documents WHERE id % 100 = 1"
query("S8_upsert_by_key", UPSERTED)(lambda t: S.upsert_by_key(t("kb_documents").select("id", "title", "type"), NEW(t), ["id"]))
REPLACED = "SELECT id, document_id, chunk_text FROM kb_chunks WHERE document_id % 3 <> 0 UNION ALL SELECT id + 7, document_id, 'new' FROM kb_chunks WHERE document_id % 3 = 0 AND chunk_index = 0"
FIRST = lambda t: t("kb_chunks").where("document_id % 3 = 0 AND chunk_index = 0").select((F.col("id") + 7).alias("id"), "document_id", F.lit("new").alias("chunk_text"))
query("S9_replace_children", REPLACED)(lambda t: S.replace_children(t("kb_chunks").select("id", "document_id", "chunk_text"), FIRST(t), "document_id"))


@query("S8_upsert_keyed", UPSERTED)
def upserted(t: Tables) -> DataFrame:
    """The upsert into a stored table of which it rewrites the parts that it touches; a repeat finds nothing to do."""
    path = folder(t.spark, "keyed")
    partitioned.write_keyed(t("kb_documents").select("id", "title", "type"), path, ["id"], 16)
    for _ in range(2):
        partitioned.upsert_keyed(t.spark, path, NEW(t), ["id"], 16)
    return partitioned.read_keyed(t.spark, path)


@query("S9_replace_children_keyed", REPLACED)
def replaced(t: Tables) -> DataFrame:
    path = folder(t.spark, "children")
    partitioned.write_keyed(t("kb_chunks").select("id", "document_id", "chunk_text"), path, ["document_id"], 16)
    partitioned.replace_children_keyed(t.spark, path, FIRST(t), "document_id", 16)
    return partitioned.read_keyed(t.spark, path).select("id", "document_id", "chunk_text")


VALID = "coalesce(component, '') <> '' AND coalesce(action, '') <> '' AND coalesce(message, '') <> '' AND level IN ('debug', 'info', 'warn', 'error')"


@query("S10_append_sink", f"SELECT count(*) * 2 AS n FROM kb_logs WHERE {VALID}")
def appended(t: Tables) -> DataFrame:
    path = folder(t.spark, "logs")
    ok, _, _ = S.validate_records(t("kb_logs"))
    for _ in range(2):
        S.append_sink(ok, path)
    return S.count_exact(t.spark.read.parquet(path))


CHECKED = f"SELECT count(*) FILTER (WHERE {VALID}) AS ok, count(*) FILTER (WHERE NOT ({VALID})) AS failed FROM kb_logs"


@query("S11_write_validated", CHECKED)
def counted(t: Tables) -> DataFrame:
    """The counts that come with writing the logs, in one scan of them."""
    found = partitioned.write_validated(t("kb_logs"), folder(t.spark, "validated"))
    return t.spark.createDataFrame([(found["ok"], found["failed"])], "ok long, failed long")


query("S11_validate_records", CHECKED)(lambda t: S.validate_records(t("kb_logs"))[2])
query("S12_patch_update", "SELECT id, CASE WHEN id % 6 = 0 THEN 'patched' ELSE title END AS title, CASE WHEN id % 6 = 0 AND id % 12 <> 0 THEN type WHEN id % 12 = 0 THEN NULL ELSE type END AS type FROM kb_documents")(
    lambda t: S.patch_update(t("kb_documents").select("id", "title", "type"), t("kb_documents").where("id % 6 = 0").select("id", F.lit("patched").alias("title"), F.lit(None).cast("string").alias("type"), (F.col("id") % 12 == 0).alias("has_type")), "id")
)


@query("S13_cascade_delete", "SELECT 'sources' AS name, count(*) AS n FROM kb_web_sources WHERE id % 5 <> 0 UNION ALL SELECT 'pages', count(*) FROM kb_pages WHERE source_id % 5 <> 0 UNION ALL SELECT 'links', count(*) FROM kb_pages WHERE source_id % 5 <> 0 UNION ALL SELECT 'linked', count(*) FROM kb_pages p WHERE source_id % 5 <> 0 AND NOT EXISTS (SELECT 1 FROM kb_pages q WHERE q.id = p.id + 1 AND q.source_id % 5 = 0)")
def cascaded(t: Tables) -> DataFrame:
    links = t("kb_pages").select(F.col("id").alias("id"), F.col("id").alias("source_page_id"), (F.col("id") + 1).alias("target_page_id"))
    tables = {"sources": t("kb_web_sources"), "pages": t("kb_pages"), "links": links}
    gone = t("kb_web_sources").where("id % 5 = 0").select("id")
    out = S.cascade_delete(tables, "sources", gone, [("pages", "source_id", "sources"), ("links", "source_page_id", "pages")], [("links", "target_page_id", "pages")])
    parts = [S.count_exact(out[n]).select(F.lit(n).alias("name"), "n") for n in ("sources", "pages", "links")]
    parts.append(S.count_exact(out["links"], F.col("target_page_id").isNotNull()).select(F.lit("linked").alias("name"), "n"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


query("S14_orphan_cleanup", "SELECT id FROM kb_chunks WHERE document_id IN (SELECT id FROM kb_documents WHERE id % 2 = 0)")(lambda t: S.orphan_cleanup(t("kb_chunks"), t("kb_documents").where("id % 2 = 0")).select("id"))
query("S15_retention_logs", f"SELECT id, level FROM kb_logs WHERE CASE WHEN level = 'error' THEN ts >= {TS} - INTERVAL '17' DAY ELSE ts >= {TS} - INTERVAL '10' DAY END")(lambda t: S.retention(t("kb_logs"), "logs", AS_OF, 10).select("id", "level"))


@query("S15_expire_by_day", f"SELECT id, level FROM kb_logs WHERE CASE WHEN level = 'error' THEN ts >= {TS} - INTERVAL '17' DAY ELSE ts >= {TS} - INTERVAL '10' DAY END")
def expired(t: Tables) -> DataFrame:
    """Logs stored by day after what is too old is gone: whole days by their folders, days at the edge written anew."""
    path = folder(t.spark, "by-day")
    partitioned.write_by_day(t("kb_logs").select("id", "level", "ts"), path)
    partitioned.expire(t.spark, path, "logs", AS_OF, 10)
    return partitioned.retained(t.spark, path, "logs", AS_OF, 10).select("id", "level")


query("S15_retention_errors", f"SELECT id FROM kb_errors WHERE ts >= {TS} - INTERVAL '10' DAY OR NOT resolved")(lambda t: S.retention(t("kb_errors"), "errors", AS_OF, 10).select("id"))
CACHE = lambda t: t("kb_queries").select("id", F.col("created_at").alias("last_accessed"), F.col("result_count").alias("usage_count"))
query("S16_cache_evict", f"SELECT id FROM kb_queries WHERE NOT (created_at < {TS} - INTERVAL '10' DAY AND result_count < 4)")(lambda t: S.cache_evict(CACHE(t), AS_OF, 10, 4).select("id"))
query("S17_schema_evolve", "SELECT id, title, 0 AS chunk_total, 1e0 AS relevance_score FROM kb_documents")(lambda t: S.schema_evolve(t("kb_documents").select("id", "title"), {"title": ("string", ""), "chunk_total": ("int", 0), "relevance_score": ("double", 1.0)}))
query("S18_ingest_pipeline")(lambda t: S.ingest_pipeline(t("kb_documents"), hashed_embedder(), AS_OF)[0].select("id", "transcription_status", "chunk_count", "processing_error", F.col("embedding").isNotNull().alias("own_vector")))

query("T8_split_sections")(lambda t: X.split_sections(t("documents").select(F.col("doc_id").alias("id"), F.regexp_replace("text", r"(?m)^(\S+)\.$", "# $1").alias("content_text"))).select("id", "section", "title", F.length("body").alias("n_chars")))
# each line of a text is a paragraph, so that there is something to pack; packing is a fold, tested against brute force
query("T9_pack_paragraphs")(lambda t: X.pack_paragraphs(t("documents").select(F.col("doc_id").alias("id"), F.regexp_replace("text", "\n", "\n\n").alias("content_text"))).select("id", "section", F.length("body").cast("long").alias("n_chars"), F.sha2("body", 256).alias("digest")))
query("T10_chunk_section")(lambda t: X.chunk_section(t("documents").select(F.col("doc_id").alias("id"), F.col("text").alias("body"))).select("document_id", "chunk_index", "token_count", F.length("chunk_text").alias("n_chars")))
query("T11_chunk_type", "SELECT doc_id, CASE WHEN regexp_matches(text, '```(.|\\n)*```') OR regexp_matches(text, '(?m)^\\s*(function|class|def|interface|const|let|var)\\s+') THEN 'code' WHEN regexp_matches(text, '\\|.*\\|.*\\|') OR regexp_matches(text, '(?m)^\\s*\\+[-+]+\\+\\s*$') THEN 'table' WHEN regexp_matches(text, '(?m)^\\s*[-*+•]\\s+') OR regexp_matches(text, '(?m)^\\s*\\d+\\.\\s+') THEN 'list' ELSE 'text' END AS kind FROM documents")(lambda t: t("documents").select("doc_id", C.chunk_type("text").alias("kind")))
query("T12_chunk_documents")(lambda t: X.chunk_documents(t("kb_documents")).select("document_id", "chunk_index", "token_count", "chunk_type", F.sha2("chunk_text", 256).alias("digest")))
query("T13_truncate_for_model", "SELECT doc_id, length(CASE WHEN length(text) > 18000 THEN concat(substring(text, 1, 17950), '... [truncated]') ELSE text END) AS by_chars, length(CASE WHEN length(text) / 4e0 > 0.9e0 * 8191 THEN substring(text, 1, 29487) ELSE text END) AS by_tokens FROM documents")(
    lambda t: t("documents").select("doc_id", F.length(C.truncate_for_model("text")).cast("long").alias("by_chars"), F.length(C.truncate_for_model("text", "tokens")).cast("long").alias("by_tokens"))
)
CLOUD_STOPS = ", ".join(f"'{w}'" for w in X.CLOUD_STOP)
BODY = "lower(concat(coalesce(title, ''), ' ', coalesce(content_text, ''), ' ', coalesce(transcription, '')))"
CLOUD = (
    f"SELECT word, count(*) AS count, arg_min(type, id) AS category FROM (SELECT id, type, unnest(regexp_split_to_array(regexp_replace({BODY}, '[^a-zA-Z\\s]', ' ', 'g'), '\\s+')) AS word FROM kb_documents) WHERE length(word) > 3 AND word NOT IN ({CLOUD_STOPS}) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25"
)
query("T14_word_cloud", CLOUD)(lambda t: X.word_cloud(t("kb_documents")))
query("A23_word_cloud", CLOUD.replace("LIMIT 25", "LIMIT 40"))(lambda t: X.word_cloud(t("kb_documents"), 40))
query("T15_content_hash", "SELECT doc_id, sha256(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS digest FROM documents")(lambda t: t("documents").select("doc_id", C.content_hash("text").alias("digest")))
query("T16_word_count", "SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS n FROM documents")(lambda t: t("documents").select("doc_id", C.word_count("text").cast("long").alias("n")))


@query("T17_parse_analysis_json", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN concat('seen ', event_type) ELSE substring(concat('a button in ', props), 1, 500) END AS description, CASE WHEN event_id % 3 = 0 THEN event_id % 2 = 0 ELSE false END AS contains_code, event_id % 3 <> 0 AS contains_ui, CASE WHEN event_id % 3 = 0 THEN 0.5e0 ELSE 0.3e0 END AS confidence FROM (SELECT event_id, event_type, replace(replace(props, '{', '('), '}', ')') AS props FROM events)")
def analysed(t: Tables) -> DataFrame:
    json = F.to_json(F.struct(F.concat(F.lit("seen "), "event_type").alias("description"), F.struct((F.col("event_id") % 2 == 0).alias("containsCode")).alias("technicalContent")))
    said = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("Here it is: "), json, F.lit(" done"))).otherwise(F.concat(F.lit("a button in "), F.translate("props", "{}", "()")))
    out = X.parse_analysis_json(t("events").select("event_id", said.alias("said")), "said")
    return out.select("event_id", "analysis.description", "analysis.contains_code", "analysis.contains_ui", "analysis.confidence")


@query("T18_describe_visual", "SELECT event_id, concat('seen ', event_type, ' Contains programming code Technical terms: ', event_type, ', x') AS described FROM events")
def described(t: Tables) -> DataFrame:
    empty = F.array().cast("array<string>")
    none = F.lit(None).cast("string")
    record = F.struct(F.concat(F.lit("seen "), "event_type").alias("description"), F.lit("").alias("extracted_text"), F.lit(True).alias("contains_code"), none.alias("code_language"), F.lit("").alias("code_description"), F.lit(False).alias("contains_diagrams"), none.alias("diagram_type"), none.alias("diagram_description"), F.lit(False).alias("contains_ui"), empty.alias("ui_elements"), F.array("event_type", F.lit("x")).alias("technical_terms"), empty.alias("concepts"))
    return t("events").withColumn("analysis", record).select("event_id", X.describe_visual().alias("described"))


SEP = "\n\n--- Text in frames ---\n\n"
query("T19_combine_media_text", f"SELECT d.id, sha256(concat_ws('{SEP}', nullif(transcription, ''), o.seen)) AS digest FROM kb_documents d LEFT JOIN (SELECT document_id, string_agg(ocr_text, chr(10) ORDER BY frame_timestamp, id) AS seen FROM kb_frames GROUP BY 1) o ON o.document_id = d.id WHERE transcription IS NOT NULL")(
    lambda t: X.combine_media_text(t("kb_documents").where("transcription IS NOT NULL"), t("kb_frames").withColumn("frame_id", F.col("id"))).select("id", F.sha2("combined_text", 256).alias("digest"))
)
query("T20_best_ocr", "SELECT DISTINCT ON (event_id // 9) event_id // 9 AS frame_id, event_id AS pos, props AS body FROM events ORDER BY event_id // 9, value DESC, event_id")(lambda t: X.best_ocr(t("events").select(F.floor(F.col("event_id") / 9).alias("frame_id"), F.col("value").alias("confidence"), F.col("event_id").alias("pos"), F.col("props").alias("body"))).drop("confidence"))
query("T22_token_estimates", "SELECT doc_id, cast(ceil(length(text) / 4e0) AS bigint) AS by_quarter, cast(ceil(length(text) / 3e0) AS bigint) AS by_third, cast(floor(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) * 1.3e0) AS bigint) AS by_words FROM documents")(lambda t: t("documents").select("doc_id", C.token_estimates("text").alias("e")).select("doc_id", "e.*"))

query(
    "M1_video_timeline",
    "SELECT f.id, s.scene_type, c.code FROM (SELECT DISTINCT ON (document_id, floor(frame_timestamp / 30.0)) * FROM kb_frames ORDER BY document_id, floor(frame_timestamp / 30.0), frame_timestamp, id) f LEFT JOIN kb_scenes s ON s.document_id = f.document_id AND f.frame_timestamp BETWEEN s.start_timestamp AND s.end_timestamp LEFT JOIN (SELECT frame_id, string_agg(DISTINCT extracted_code, ' | ' ORDER BY extracted_code) AS code FROM kb_technical GROUP BY 1) c ON c.frame_id = f.id",
)(lambda t: M.video_timeline(t("kb_frames"), t("kb_scenes"), t("kb_technical")).select("id", "scene_type", "code"))
query("M2_similar_technical", "SELECT x.frame_id, x.confidence, d.title AS document_title FROM kb_technical x JOIN kb_frames f ON f.id = x.frame_id JOIN kb_documents d ON d.id = f.document_id WHERE x.content_type = 'diagram' AND list_has_any(x.technical_terms, ['click']) AND x.confidence > 0.3")(lambda t: M.similar_technical(t("kb_technical"), t("kb_frames"), t("kb_documents"), "diagram", ["click"]).select("frame_id", "confidence", "document_title"))
VIDEOS = "SELECT document_id, max(frame_timestamp) * 10 AS duration FROM kb_frames GROUP BY 1"
query("M3_interval_sampling_plan", f"SELECT document_id, cast(i AS int) AS frame_number, i * 30e0 AS frame_timestamp, concat(cast(document_id AS varchar), '_frame_', cast(i AS varchar)) AS frame_id FROM (SELECT document_id, unnest(range(cast(least(20, floor(duration / 30)) AS bigint))) AS i FROM ({VIDEOS}))")(lambda t: M.interval_sampling_plan(t("kb_frames").groupBy("document_id").agg((F.max("frame_timestamp") * 10).alias("duration")), 20))
query("M4_scene_sampling_plan", "SELECT document_id, nth - 1 AS frame_number, frame_number / 25e0 AS frame_timestamp FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY frame_number) AS nth FROM kb_frames WHERE frame_timestamp / 100 > 0.3) WHERE nth <= 15")(
    lambda t: M.scene_sampling_plan(t("kb_frames").select("document_id", F.col("frame_number").alias("n"), F.lit(25.0).alias("fps"), (F.col("frame_timestamp") / 100).alias("score")), max_frames=15).withColumn("frame_number", F.col("frame_number").cast("long"))
)
query("M5_frame_flags", "SELECT id, length(coalesce(ocr_text, '')) > 0 AS contains_text, contains_code OR contains_diagrams OR contains_ui_elements AS technical FROM kb_frames")(lambda t: M.frame_flags(t("kb_frames"))[0].select("id", "contains_text", F.expr("contains_code OR contains_diagrams OR contains_ui_elements").alias("technical")))
query("M6_frame_title", "SELECT id, concat('Frame at ', cast(cast(floor(frame_timestamp) AS bigint) AS varchar), 's') AS title FROM kb_frames")(lambda t: M.frame_title(t("kb_frames")).select("id", "title"))


@query("M7_frame_embeddings")
def frame_vectors(t: Tables) -> DataFrame:
    empty, none = F.array().cast("array<string>"), F.lit("").cast("string")
    record = F.struct(F.concat(F.lit("frame of "), "content_type").alias("description"), none.alias("extracted_text"), (F.col("content_type") == "code").alias("contains_code"), none.alias("code_language"), none.alias("code_description"), (F.col("content_type") == "diagram").alias("contains_diagrams"), none.alias("diagram_type"), none.alias("diagram_description"), F.lit(False).alias("contains_ui"), empty.alias("ui_elements"), F.col("technical_terms"), empty.alias("concepts"))
    out = M.frame_embeddings(t("kb_frames").select("id", "document_id", "frame_number", "ocr_text"), t("kb_technical").select("frame_id", record.alias("analysis")), hashed_embedder(), context=2)
    return out.select("id", F.round(C.norm("text_embedding"), 6).alias("text_norm"), F.round(C.norm("combined_embedding"), 6).alias("combined_norm"))


query("D1_check_enum", "SELECT id, type FROM kb_documents WHERE type IS NOT NULL AND type NOT IN ('strategy', 'meeting', 'email')")(lambda t: D.check_enum(t("kb_documents"), "type", ("strategy", "meeting", "email")).select("id", "type"))
query("D1_check_range", "SELECT id FROM kb_web_sources WHERE priority NOT BETWEEN 2 AND 8")(lambda t: D.check_enum(t("kb_web_sources"), "priority", range(2, 9)).select("id"))
query("D2_check_unique", "SELECT page_id, version_number % 2 AS half, count(*) AS n FROM kb_versions GROUP BY 1, 2 HAVING count(*) > 1")(lambda t: D.check_unique(t("kb_versions").withColumn("half", F.col("version_number") % 2), ["page_id", "half"]))
query("D3_check_fk", "SELECT id, document_id FROM kb_chunks WHERE document_id NOT IN (SELECT id FROM kb_documents WHERE id % 3 <> 0)")(lambda t: D.check_fk(t("kb_chunks"), t("kb_documents").where("id % 3 <> 0"), "document_id").select("id", "document_id"))


def streamed(t: Tables, table: str = "events") -> DataFrame:
    return streams.read_events(t.spark, f"{t.sf_dir}/{table}.parquet")


HEALTH = "CASE WHEN event_type = 'error' THEN 'unhealthy' WHEN event_type = 'click' THEN 'degraded' ELSE 'healthy' END"


def health_stream(t: Tables) -> DataFrame:
    return streamed(t).select("ts", F.expr(HEALTH).alias("overall_status"), F.col("value").alias("avg_response_time"), (F.col("value") / 10).alias("error_rate"), (F.col("value") * 2).alias("throughput"))


query("X1_stream_health_trend", "SELECT date_trunc('hour', ts) AS time_bucket, round(avg(avg_response_time), 6) AS avg_response_time, round(count(*) FILTER (WHERE overall_status = 'healthy') * 100e0 / count(*), 6) AS healthy_percentage FROM kb_health GROUP BY 1")(
    lambda t: streams.drained(streams.stream_health_trend(health_stream(t)), "complete").select("time_bucket", F.round("avg_response_time", 6).alias("avg_response_time"), F.round("healthy_percentage", 6).alias("healthy_percentage"))
)
query("X2_stream_error_summary", "SELECT as_of, component, error_type, count(*) AS error_count, max(ts) AS last_occurrence, count(*) FILTER (WHERE resolved) AS resolved_count FROM (SELECT *, unnest(list_transform(range(1, 25), lambda h: date_trunc('hour', ts) + h * INTERVAL '1' HOUR)) AS as_of FROM kb_errors) GROUP BY 1, 2, 3")(
    lambda t: streams.drained(streams.stream_error_summary(streamed(t).where("event_type = 'error'").selectExpr("ts", "concat('component_', cast(user_id % 5 AS string)) AS component", "CASE WHEN value < 20 THEN 'timeout' ELSE 'exception' END AS error_type", "event_id % 3 = 0 AS resolved")), "complete")
)


@query("X3_stream_log_sink", f"SELECT count(*) AS n FROM kb_logs WHERE {VALID}")
def log_sink(t: Tables) -> DataFrame:
    logs = streamed(t).selectExpr("event_id AS id", "ts", "CASE event_type WHEN 'error' THEN 'error' WHEN 'view' THEN 'info' WHEN 'click' THEN 'debug' ELSE 'warn' END AS level", "CASE WHEN event_id % 41 <> 0 THEN concat('component_', cast(user_id % 5 AS string)) END AS component", "event_type AS action", "CASE WHEN event_id % 43 = 0 THEN '' ELSE props END AS message")
    path = folder(t.spark, "log-sink")
    streams.stream_log_sink(logs, path, f"{path}-checkpoint", {"availableNow": True}).awaitTermination()
    return S.count_exact(t.spark.read.parquet(path))


@query("X4_stream_change_detect", "SELECT page_id, seq, oh IS NULL OR oh <> h AS changed FROM (SELECT page_id, seq, h, lag(h) OVER (PARTITION BY page_id ORDER BY seq) AS oh FROM (SELECT doc_id // 5 AS page_id, doc_id AS seq, sha256(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS h FROM documents))")
def change_stream(t: Tables) -> DataFrame:
    path = folder(t.spark, "changes")
    pages = streamed(t, "documents").select(F.floor(F.col("doc_id") / 5).alias("page_id"), F.col("doc_id").alias("seq"), F.col("text").alias("content_text"))
    streams.stream_change_detect(pages, f"{path}/rows", f"{path}/checkpoint").awaitTermination()
    return streams.current_changes(t.spark.read.parquet(f"{path}/rows")).select("page_id", "seq", "changed")


query("X5_stream_pending_sweep", "SELECT id FROM kb_documents WHERE (content_text IS NULL OR transcription IS NULL) AND id % 11 <> 0")(
    lambda t: streams.drained(streams.stream_pending_sweep(streamed(t, "documents").selectExpr("doc_id AS id", "CASE WHEN doc_id % 13 <> 0 THEN text END AS content_text", "CASE WHEN doc_id % 10 >= 8 THEN text END AS transcription", "CASE WHEN doc_id % 11 = 0 THEN 'error' ELSE 'pending' END AS transcription_status")).select("id"))
)
query("X6_stream_dedup_hash", "SELECT DISTINCT sha256(text) AS content_hash FROM documents")(lambda t: streams.drained(streams.stream_dedup_hash(streamed(t, "documents").withColumn("ts", F.expr("TIMESTAMP '2024-01-01 00:00:00'")), "text", "ts").select("content_hash")))
