"""Adapter views that give every operator an input on the star-schema and corpus tables. Spark and DuckDB read the same SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VIEWS = {
    "kb_documents": """SELECT d.doc_id AS id, concat('Doc ', cast(d.doc_id AS varchar(20))) AS title,
  CASE d.doc_id % 7 WHEN 0 THEN 'strategy' WHEN 1 THEN 'meeting' WHEN 2 THEN 'email' WHEN 3 THEN 'sop' WHEN 4 THEN 'idea' WHEN 5 THEN 'knowledge' ELSE 'whitepaper' END AS type,
  split(concat(d.lang, ',', d.source), ',') AS tags,
  CASE WHEN d.doc_id % 10 = 8 THEN 'audio' WHEN d.doc_id % 10 = 9 THEN 'video' ELSE 'text' END AS media_type,
  CASE WHEN d.doc_id % 13 = 0 THEN NULL ELSE d.text END AS content_text,
  CASE WHEN d.doc_id % 10 >= 8 THEN d.text END AS transcription,
  CASE WHEN d.doc_id % 11 = 0 THEN 'error' WHEN d.doc_id % 17 = 0 THEN NULL WHEN e.vec_id IS NULL THEN 'pending' ELSE 'completed' END AS transcription_status,
  e.embedding AS embedding, d.n_chars AS file_size,
  concat(cast(d.doc_id AS varchar(20)), CASE d.doc_id % 4 WHEN 0 THEN '.pdf' WHEN 1 THEN '.MD' WHEN 2 THEN '.txt' ELSE '' END) AS file_path,
  d.doc_id % 5 AS chunk_count,
  TIMESTAMP '2024-01-01 00:00:00' + (d.doc_id % 720) * INTERVAL '1' HOUR AS created_at
FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id""",
    "kb_chunks": """SELECT c.conv_id * 1000 + c.turn AS id, c.conv_id AS document_id, c.turn AS chunk_index, c.text AS chunk_text, e.embedding AS embedding
FROM conversations c CROSS JOIN (SELECT count(*) AS n FROM embeddings) m LEFT JOIN embeddings e ON e.vec_id = (c.conv_id * 7 + c.turn) % m.n""",
    "kb_frames": """SELECT v.event_id AS id, v.user_id AS document_id,
  cast(row_number() OVER (PARTITION BY v.user_id ORDER BY v.ts, v.event_id) - 1 AS bigint) AS frame_number,
  v.value AS frame_timestamp, v.props AS ocr_text,
  v.event_type = 'click' AS contains_code, v.event_type = 'view' AS contains_diagrams, v.event_type = 'signup' AS contains_text, v.event_type = 'purchase' AS contains_ui_elements,
  a.embedding AS visual_embedding, b.embedding AS text_embedding
FROM events v CROSS JOIN (SELECT cast(floor(count(*) * 1.2E0) AS bigint) AS n FROM embeddings) m LEFT JOIN embeddings a ON a.vec_id = v.event_id % m.n LEFT JOIN embeddings b ON b.vec_id = (v.event_id * 3 + 1) % m.n""",
    "kb_scenes": """SELECT u.user_id AS document_id, n.n_nationkey AS scene_number, cast(n.n_nationkey * 5 AS double) AS start_timestamp, cast(n.n_nationkey * 5 + 5 AS double) AS end_timestamp,
  CASE n.n_nationkey % 5 WHEN 0 THEN 'code' WHEN 1 THEN 'presentation' WHEN 2 THEN 'demonstration' WHEN 3 THEN 'discussion' ELSE 'diagram' END AS scene_type
FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN nation n""",
    "kb_technical": """SELECT event_id AS frame_id, CASE WHEN event_id % 3 = 0 THEN 'code' ELSE 'diagram' END AS content_type, props AS extracted_code,
  split(concat(event_type, ',', props), ',') AS technical_terms, (event_id % 100) / 100.0E0 AS confidence
FROM events WHERE event_type IN ('click', 'view')""",
    "kb_web_sources": """SELECT page_id AS id, url, regexp_extract(url, '^https?://([^/]+)', 1) AS domain,
  CASE page_id % 5 WHEN 0 THEN 'paused' WHEN 1 THEN 'error' ELSE 'active' END AS status, page_id % 10 + 1 AS priority,
  CASE WHEN page_id % 4 = 0 THEN NULL ELSE TIMESTAMP '2024-01-01 00:00:00' + page_id * INTERVAL '1' HOUR END AS last_crawled,
  CASE WHEN page_id % 6 = 0 THEN NULL ELSE TIMESTAMP '2024-01-25 00:00:00' + page_id * INTERVAL '1' HOUR END AS next_crawl
FROM pages""",
    "kb_crawl_jobs": """SELECT event_id AS id, cast(floor(event_id / 8.0E0) AS bigint) AS source_id,
  CASE WHEN event_id % 97 = 0 THEN 'running' WHEN event_id % 89 = 0 THEN 'pending' WHEN event_type = 'error' THEN 'failed' ELSE 'completed' END AS status,
  ts AS created_at, event_id % 40 AS pages_crawled
FROM events""",
    "kb_pages": """SELECT page_id AS id, cast(floor(page_id / 25.0E0) AS bigint) AS source_id, url, html AS content_text,
  CASE page_id % 6 WHEN 0 THEN 'pending' WHEN 1 THEN 'error' WHEN 2 THEN 'skipped' ELSE 'completed' END AS processing_status,
  TIMESTAMP '2024-01-01 00:00:00' + page_id * INTERVAL '1' MINUTE AS crawled_at
FROM pages""",
    "kb_versions": """SELECT cast(floor(doc_id / 5.0E0) AS bigint) AS page_id, doc_id % 5 + 1 AS version_number, text AS content_text, length(text) AS content_length
FROM documents""",
    "kb_metrics": """SELECT event_id AS id, ts, event_type AS name, value, CASE WHEN event_type = 'view' THEN 'count' ELSE 'ms' END AS unit, concat('component_', cast(user_id % 5 AS varchar(20))) AS component
FROM events""",
    "kb_logs": """SELECT event_id AS id, ts, CASE event_type WHEN 'error' THEN 'error' WHEN 'view' THEN 'info' WHEN 'click' THEN 'debug' ELSE 'warn' END AS level,
  CASE WHEN event_id % 41 = 0 THEN NULL ELSE concat('component_', cast(user_id % 5 AS varchar(20))) END AS component, event_type AS action, CASE WHEN event_id % 43 = 0 THEN '' ELSE props END AS message
FROM events""",
    "kb_errors": """SELECT event_id AS id, ts, concat('component_', cast(user_id % 5 AS varchar(20))) AS component, CASE WHEN value < 20 THEN 'timeout' ELSE 'exception' END AS error_type, event_id % 3 = 0 AS resolved
FROM events WHERE event_type = 'error'""",
    "kb_queries": """SELECT event_id AS id, ts AS created_at, CASE WHEN event_id % 2 = 0 THEN 'search' ELSE 'chat' END AS query_type,
  CASE event_id % 5 WHEN 0 THEN 'hybrid' WHEN 1 THEN 'semantic' WHEN 2 THEN 'keyword' WHEN 3 THEN 'chunk-based' END AS search_strategy,
  value * 10 AS response_time_ms, (event_id % 100) / 100.0E0 AS confidence_score, event_id % 20 AS result_count
FROM events""",
    "kb_health": """SELECT event_id AS id, ts, CASE WHEN event_type = 'error' THEN 'unhealthy' WHEN event_type = 'click' THEN 'degraded' ELSE 'healthy' END AS overall_status,
  value AS avg_response_time, value / 10.0E0 AS error_rate, value * 2.0E0 AS throughput
FROM events""",
    # texts that people ask: benchmark passages with words that the query rules look for
    "kb_asked": """SELECT item_id AS query_id, concat(CASE item_id % 9 WHEN 0 THEN 'How does the API code work? ' WHEN 1 THEN 'similar to ' WHEN 2 THEN '"exact" ' WHEN 3 THEN 'Compare the difference. ' WHEN 4 THEN 'summary about ' WHEN 5 THEN 'database function ' WHEN 6 THEN 'What is like ' WHEN 7 THEN 'specifically ' ELSE '' END, text) AS query
FROM benchmark""",
    # hits of searches: five documents a benchmark item, some by chunk
    "kb_hits": """SELECT b.item_id AS query_id, d.doc_id AS id, concat('Doc ', cast(d.doc_id AS varchar(20))) AS title, d.text AS content,
  (d.doc_id * 37 % 101) / 101.0E0 AS similarity, (d.doc_id * 53 % 97) / 97.0E0 AS rank,
  CASE d.doc_id % 4 WHEN 0 THEN 'knowledge' WHEN 1 THEN 'sop' WHEN 2 THEN 'strategy' ELSE 'email' END AS type,
  CASE WHEN d.doc_id % 3 = 0 THEN d.doc_id * 10 END AS chunk_id,
  TIMESTAMP '2024-01-01 00:00:00' - (d.doc_id % 60) * INTERVAL '1' DAY + INTERVAL '30' DAY AS created_at
FROM benchmark b CROSS JOIN (SELECT n_nationkey AS k FROM nation WHERE n_nationkey < 5) o CROSS JOIN (SELECT count(*) AS n FROM documents) m JOIN documents d ON d.doc_id = (b.item_id * 5 + o.k) % m.n""",
    # hits of searches: every fortieth document, by the benchmark item
    "kb_all_hits": """SELECT b.item_id AS query_id, d.doc_id AS id, concat('Doc ', cast(d.doc_id AS varchar(20))) AS title, d.text AS content,
  (d.doc_id * 37 % 101) / 101.0E0 AS similarity, (d.doc_id * 53 % 97) / 97.0E0 AS rank,
  CASE d.doc_id % 4 WHEN 0 THEN 'knowledge' WHEN 1 THEN 'sop' WHEN 2 THEN 'strategy' ELSE 'email' END AS type,
  CASE WHEN d.doc_id % 3 = 0 THEN d.doc_id * 10 END AS chunk_id,
  TIMESTAMP '2024-01-01 00:00:00' - (d.doc_id % 60) * INTERVAL '1' DAY + INTERVAL '30' DAY AS created_at
FROM benchmark b JOIN documents d ON d.doc_id % 40 = b.item_id % 40""",
}


class Tables:
    """The tables and adapter views of one input folder, as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        if name not in VIEWS:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        sql = VIEWS[name]
        for base in BASE:
            if f" {base}" in sql:
                self(base).createOrReplaceTempView(base)
        return self.spark.sql(sql)


def oracle(sql: str) -> str:
    """The SQL with the adapter views that it names defined before it."""
    used = [f"{name} AS ({VIEWS[name]})" for name in VIEWS if name in sql]
    if not used:
        return sql
    body = sql.strip()
    if body[:5].upper() == "WITH ":
        return f"WITH {', '.join(used)}, {body[5:]}"
    return f"WITH {', '.join(used)} {body}"
