"""Registered queries: vectors, hybrid and full-text search, ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import columns as C
from tessera.operators import fulltext as T
from tessera.operators import textindex as X
from tessera.operators import ranking as R
from tessera.operators import vectors as V
from tessera.operators.windows import topk_per_query
from tessera.plans.fixtures import Tables
from tessera.plans.registry import query
from tessera.session import AS_OF

D = "::DOUBLE[]"


def asked(t: Tables) -> DataFrame:
    """The query vectors: every hundredth embedding."""
    return t("embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


QUERIES = "(SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 100 = 0)"
COS = f"list_cosine_similarity(q.q{D}, x.embedding{D})"


def top(inner: str, k: int, cols: str, order: str = "similarity DESC, id") -> str:
    return f"SELECT {cols} FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {order}) AS nth FROM ({inner})) WHERE nth <= {k}"


def shown(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if c in ("similarity", "rank_score", "text_rank") else F.col(c) for c in cols])


query("V1_cosine_similarity", f"SELECT q.query_id, x.vec_id AS id, round({COS}, 6) AS similarity FROM embeddings x CROSS JOIN {QUERIES} q")(lambda t: shown(V.every_score(asked(t), t("embeddings").where("embedding IS NOT NULL").withColumnRenamed("vec_id", "id")).withColumnRenamed("score", "similarity"), "query_id", "id", "similarity"))
MATCH = f"SELECT q.query_id, x.id, x.title, x.type, {COS} AS similarity FROM kb_documents x CROSS JOIN {QUERIES} q WHERE x.embedding IS NOT NULL AND {COS} > 0.1"
query("V2_match_documents", top(MATCH, 10, "query_id, id, title, round(similarity, 6) AS similarity"))(lambda t: shown(V.match_documents(t("kb_documents"), asked(t), 0.1, 10), "query_id", "id", "title", "similarity"))
CHUNK = f"SELECT q.query_id, x.id, x.document_id, d.title, {COS} AS similarity FROM kb_chunks x JOIN kb_documents d ON d.id = x.document_id CROSS JOIN {QUERIES} q WHERE x.embedding IS NOT NULL AND {COS} > 0.1"
query("V3_search_chunks", top(CHUNK, 20, "query_id, id, title, round(similarity, 6) AS similarity"))(lambda t: shown(V.search_chunks(t("kb_chunks"), t("kb_documents"), asked(t), 0.1, 20), "query_id", "id", "title", "similarity"))
query("V4_semantic_search", top(MATCH + " AND x.type = 'sop' AND list_has_any(x.tags, ['en', 'fr']) AND x.created_at >= TIMESTAMP '2024-01-05 00:00:00'", 10, "query_id, id, round(similarity, 6) AS similarity"))(
    lambda t: shown(V.semantic_search(t("kb_documents"), asked(t), "sop", ["en", "fr"], 0.1, 10, since="2024-01-05 00:00:00"), "query_id", "id", "similarity")
)


def text_queries(t: Tables) -> DataFrame:
    return t("benchmark").where("item_id % 8 = 0").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


STOPS = ", ".join(f"'{w}'" for w in T.STOP)
INDEX = f"SELECT id, term, pos FROM (SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS term, generate_subscripts(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'), 1) - 1 AS pos FROM documents) WHERE term NOT IN ({STOPS})"
WANTED = f"SELECT query_id, cast(row_number() OVER (PARTITION BY query_id ORDER BY first) - 1 AS int) AS term_no, term FROM (SELECT item_id AS query_id, term, min(i) AS first FROM (SELECT item_id, unnest(w) AS term, generate_subscripts(w, 1) AS i FROM (SELECT item_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM benchmark WHERE item_id % 8 = 0)) WHERE term NOT IN ({STOPS}) GROUP BY 1, 2)"
NEED = "SELECT query_id, count(*) AS n FROM wanted GROUP BY 1"
ALL = "SELECT i.id, w.query_id FROM idx i JOIN wanted w ON w.term = i.term JOIN need d ON d.query_id = w.query_id GROUP BY 1, 2, d.n HAVING count(DISTINCT i.term) = d.n"
# last place of each term up to a place, for rows with all terms: a span's start is the least of them, once there are n
SPAN = "SELECT query_id, id, n, pos, min(last) AS start FROM (SELECT a.query_id, a.id, a.n, a.pos, b.term_no, max(b.pos) AS last FROM held a JOIN held b ON b.query_id = a.query_id AND b.id = a.id AND b.pos <= a.pos GROUP BY 1, 2, 3, 4, 5) GROUP BY 1, 2, 3, 4 HAVING count(*) = n"
HELD = f"SELECT w.query_id, i.id, d.n, i.pos, w.term_no FROM idx i JOIN wanted w ON w.term = i.term JOIN need d ON d.query_id = w.query_id JOIN ({ALL}) m ON m.query_id = w.query_id AND m.id = i.id"
COVER = f"SELECT query_id, id, sum(0.1e0 / (1 + pos - start + 1 - n)) AS text_rank FROM (SELECT *, coalesce(lag(start) OVER (PARTITION BY query_id, id ORDER BY pos), -1) AS before FROM ({SPAN})) WHERE start > before GROUP BY 1, 2"


def indexed(rest: str) -> str:
    return f"WITH idx AS ({INDEX}), wanted AS ({WANTED}), need AS ({NEED}), held AS ({HELD}), cover AS ({COVER}) {rest}"


def index(t: Tables) -> DataFrame:
    """The postings of all documents as they are now; a search reads those of its queries' terms."""
    return T.tokenize_index(t("documents"), "doc_id", "text")


HYBRID = f"""SELECT q.query_id, q.q_text, x.id, NULL AS chunk_id, {COS} AS similarity FROM kb_documents x CROSS JOIN qv q WHERE x.embedding IS NOT NULL AND {COS} > 0.1
UNION ALL SELECT q.query_id, q.q_text, x.document_id, x.id, {COS} FROM kb_chunks x JOIN kb_documents d ON d.id = x.document_id CROSS JOIN qv q WHERE x.embedding IS NOT NULL AND {COS} > 0.1"""


def hybrid(t: Tables) -> DataFrame:
    """Vectors and texts of the same queries: the benchmark's, with the embedding of their number."""
    texts = text_queries(t)
    vectors = texts.join(t("embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), "query_id")
    ranks = T.text_rank_cd(index(t), T.query_terms(texts))
    return V.hybrid_search(t("kb_documents"), t("kb_chunks"), vectors, ranks, 0.1, 10).withColumnRenamed("rank", "rank_score")


query("V5_hybrid_search", indexed(f", qv AS (SELECT b.item_id AS query_id, b.text AS q_text, e.embedding AS q FROM benchmark b JOIN embeddings e ON e.vec_id = b.item_id WHERE b.item_id % 8 = 0), hits AS ({HYBRID}) SELECT query_id, id, chunk_id, similarity, rank_score FROM (SELECT h.query_id, h.id, chunk_id, round(similarity, 6) AS similarity, round(coalesce(0.7e0 * similarity + 0.3e0 * c.text_rank, similarity), 6) AS rank_score, row_number() OVER (PARTITION BY h.query_id ORDER BY coalesce(0.7e0 * similarity + 0.3e0 * c.text_rank, similarity) DESC, h.id, chunk_id NULLS FIRST) AS nth FROM hits h LEFT JOIN cover c ON c.query_id = h.query_id AND c.id = h.id) WHERE nth <= 10").replace("cover AS (" + COVER + ") , qv", "cover AS (" + COVER + "), qv"))(
    lambda t: shown(hybrid(t), "query_id", "id", "chunk_id", "similarity", "rank_score")
)
VIS = f"list_cosine_similarity(q.q{D}, x.visual_embedding{D})"
query("V6_frame_visual_search", f"SELECT h.query_id, h.id, round(similarity, 6) AS similarity, s.scene_type FROM ({top(f'SELECT q.query_id, x.id, x.document_id, x.frame_timestamp, {VIS} AS similarity FROM kb_frames x CROSS JOIN {QUERIES} q WHERE x.visual_embedding IS NOT NULL AND {VIS} > 0.1', 10, '*')}) h LEFT JOIN kb_scenes s ON s.document_id = h.document_id AND h.frame_timestamp BETWEEN s.start_timestamp AND s.end_timestamp")(
    lambda t: shown(V.frame_visual_search(t("kb_frames"), t("kb_scenes"), asked(t), thr=0.1), "query_id", "id", "similarity", "scene_type")
)


def frames(t: Tables) -> DataFrame:
    """What a search by both vectors reads of a frame."""
    return t("kb_frames").select("id", "contains_code", "contains_text", "visual_embedding", "text_embedding")


def two_vectors(t: Tables) -> DataFrame:
    a = asked(t).select("query_id", F.col("q").alias("qv"))
    return a.join(t("embeddings").select((F.col("vec_id") - 1).alias("query_id"), F.col("embedding").alias("qt")), "query_id")


def by_place(vector):
    """Sum of a vector's values times their places from 1: one number that tells orders apart."""
    return F.aggregate(F.transform(vector, lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)


TWO = "(SELECT a.vec_id AS query_id, a.embedding AS qv, b.embedding AS qt FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 100 = 0)"
BOTH = f"(0.5e0 * list_cosine_similarity(q.qv{D}, x.visual_embedding{D}) + 0.5e0 * list_cosine_similarity(q.qt{D}, x.text_embedding{D}))"
FRAMES = f"SELECT q.query_id, x.id, {BOTH} AS similarity FROM kb_frames x CROSS JOIN {TWO} q WHERE x.visual_embedding IS NOT NULL AND x.text_embedding IS NOT NULL AND {BOTH} > 0.1"
query("V7_frame_multimodal_search", top(FRAMES.replace("WHERE", "WHERE (x.contains_code OR x.contains_text) AND"), 20, "query_id, id, round(similarity, 6) AS similarity"))(lambda t: shown(V.frame_multimodal_search(frames(t), two_vectors(t), content_filters=["code", "text"], thr=0.1), "query_id", "id", "similarity"))
DOCS = f"SELECT q.query_id, x.id, list_cosine_similarity(q.qt{D}, x.embedding{D}) AS similarity FROM kb_documents x CROSS JOIN {TWO} q WHERE x.embedding IS NOT NULL AND list_cosine_similarity(q.qt{D}, x.embedding{D}) > 0.1"
FUSED = f"SELECT *, 'frame' AS origin FROM ({top(FRAMES, 5, 'query_id, id, similarity')}) UNION ALL SELECT *, 'document' FROM ({top(DOCS, 10, 'query_id, id, similarity')})"
query("V8_multimodal_search", top(FUSED, 10, "query_id, id, origin, round(similarity, 6) AS similarity", "similarity DESC, origin, id"))(lambda t: shown(V.multimodal_search(t("kb_frames"), t("kb_documents"), two_vectors(t), thr=0.1), "query_id", "id", "origin", "similarity"))
query("V9_combine_embeddings", f"SELECT id, round(list_sum(list_transform(list_zip(visual_embedding{D}, text_embedding{D}, range(1, 65)), lambda p: p[3] * (coalesce(p[1], 0) * 0.5e0 + coalesce(p[2], 0) * 0.3e0) / (CASE WHEN visual_embedding IS NULL THEN 0e0 ELSE 0.5e0 END + CASE WHEN text_embedding IS NULL THEN 0e0 ELSE 0.3e0 END))), 6) AS weighted FROM kb_frames WHERE visual_embedding IS NOT NULL OR text_embedding IS NOT NULL")(
    lambda t: t("kb_frames").where("visual_embedding IS NOT NULL OR text_embedding IS NOT NULL").select("id", F.round(by_place(C.combine_embeddings(["visual_embedding", "text_embedding"], [0.5, 0.3])), 6).alias("weighted"))
)
query("V9_centroid", "SELECT label, round(sum(m * pos), 6) AS weighted FROM (SELECT label, pos, avg(x::DOUBLE) AS m FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY 1, 2) GROUP BY 1")(lambda t: V.centroid(t("embeddings"), "label").select("label", F.round(by_place(F.col("centroid")), 6).alias("weighted")))
query("V10_combined_confidence", "SELECT id, round(CASE WHEN contains_text THEN (0.9e0 * 0.5e0 + frame_timestamp / 100 * 0.5e0) ELSE frame_timestamp / 100 * 0.5e0 / 0.5e0 END, 6) AS confidence FROM kb_frames".replace("(0.9e0 * 0.5e0 + frame_timestamp / 100 * 0.5e0)", "(0.9e0 * 0.5e0 + frame_timestamp / 100 * 0.5e0) / 1.0e0"))(
    lambda t: t("kb_frames").select("id", F.round(C.combined_confidence(F.col("frame_timestamp") / 100, "contains_text"), 6).alias("confidence"))
)
query("V11_similar_content", f"SELECT q.query_id, x.vec_id AS id, round({COS}, 6) AS similarity FROM embeddings x CROSS JOIN {QUERIES} q WHERE {COS} > 0.2")(lambda t: shown(V.similar_content(asked(t), t("embeddings").withColumnRenamed("vec_id", "id"), 0.2), "query_id", "id", "similarity"))
query("V11_similar_pairs_in_cells", f"SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding{D}, b.embedding{D}), 6) AS similarity FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id WHERE list_cosine_similarity(a.embedding{D}, b.embedding{D}) > 0.3")(
    lambda t: shown(V.similar_pairs_in_cells(t("embeddings").select(F.col("vec_id").alias("id"), "embedding"), t("embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("cell")), 0.3), "a", "b", "similarity")
)


query("V11_similar_pairs")(lambda t: shown(V.similar_pairs(t("embeddings").withColumnRenamed("vec_id", "id"), 0.4), "a", "b", "similarity"))
#: Cells of the index and those that a query probes: what reaches a recall of 0.9 on vectors without clusters, measured by a test.
ANN_CELLS, ANN_PROBES = 20, 14


@query("V12_ann_search")
def ann(t: Tables) -> DataFrame:
    model, cells = V.ivf_build(t("embeddings").withColumnRenamed("vec_id", "id"), ANN_CELLS)
    return shown(V.ivf_search(model, cells, asked(t), 10, ANN_PROBES), "query_id", "id", "similarity")


CACHE = "SELECT sha256(text) AS content_hash, count(*) AS usage_count FROM documents WHERE doc_id % 3 = 0 GROUP BY 1"


@query("V13_embedding_cache_lookup", f"SELECT count(*) FILTER (WHERE c.content_hash IS NOT NULL) AS hits, count(*) FILTER (WHERE c.content_hash IS NULL) AS misses, (SELECT cast(sum(usage_count) AS bigint) FROM ({CACHE})) + count(*) FILTER (WHERE c.content_hash IS NOT NULL) AS used FROM documents d LEFT JOIN ({CACHE}) c ON c.content_hash = sha256(d.text)")
def cached(t: Tables) -> DataFrame:
    cache = t("documents").where("doc_id % 3 = 0").groupBy(F.sha2("text", 256).alias("content_hash")).agg(F.count("*").alias("usage_count"))
    cache = cache.withColumn("embedding", F.array(F.lit(1.0))).withColumn("last_accessed", F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00'"))
    hits, misses, moved = V.cache_lookup(t("documents").select(F.col("doc_id").alias("id"), "text"), cache, AS_OF)
    return hits.agg(F.count("*").alias("hits")).crossJoin(misses.agg(F.count("*").alias("misses"))).crossJoin(moved.agg(F.sum("usage_count").alias("used")))


def _unit(df: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    return df.select(key, F.size(vector).alias("dim"), F.round(C.norm(vector), 6).alias("norm"))


query("V14_embed_text", "SELECT doc_id, CASE WHEN regexp_matches(text, '\\S') THEN 64 END AS dim, CASE WHEN regexp_matches(text, '\\S') THEN 1e0 END AS norm FROM documents")(lambda t: _unit(V.embed_text(t("documents"), "text", V.hashed_embedder()), "doc_id"))
query("V15_parse_embedding", "SELECT vec_id, len(embedding) AS dim FROM embeddings WHERE vec_id % 5 <> 0")(
    lambda t: t("embeddings").withColumn("e", C.parse_embedding(F.when(F.col("vec_id") % 5 == 0, "not a vector").otherwise(F.to_json("embedding")))).where("e IS NOT NULL").select("vec_id", F.size("e").cast("long").alias("dim"))
)
query("V16_legacy_filtered_search", top(MATCH + " AND list_has_any(x.tags, ['en']) AND x.type IN ('sop', 'idea')", 10, "query_id, id, round(similarity, 6) AS similarity"))(
    lambda t: shown(V.legacy_filtered_search(t("kb_documents").withColumn("embedding", F.to_json("embedding")), asked(t), ["en"], ["sop", "idea"], 0.1), "query_id", "id", "similarity")
)
PAGEVEC = f"SELECT q.query_id, x.page_id AS id, {COS} AS similarity FROM (SELECT p.page_id, e.embedding FROM pages p JOIN embeddings e ON e.vec_id = p.page_id) x CROSS JOIN {QUERIES} q WHERE {COS} > 0.1"


def page_hits(t: Tables) -> DataFrame:
    pages = t("pages").select(F.col("page_id").alias("id")).join(t("embeddings").select(F.col("vec_id").alias("id"), "embedding"), "id")
    return V.web_page_search(pages, asked(t), 0.1)


query("V17_web_page_search", top(PAGEVEC, 5, "query_id, id, round(similarity, 6) AS similarity"))(lambda t: shown(page_hits(t), "query_id", "id", "similarity"))
THREE = f"SELECT query_id, id, similarity, 'document' AS origin FROM ({top(MATCH, 10, 'query_id, id, similarity')}) UNION ALL SELECT query_id, id, similarity, 'multimodal' FROM ({top(FRAMES, 10, 'query_id, id, similarity')}) UNION ALL SELECT query_id, id, similarity, 'web' FROM ({top(PAGEVEC, 5, 'query_id, id, similarity')})"
query("V18_fused_retrieval", top(THREE, 12, "query_id, id, origin, round(similarity, 6) AS similarity", "similarity DESC, origin, id"))(
    lambda t: shown(V.fused_retrieval(V.match_documents(t("kb_documents"), asked(t), 0.1).select("query_id", "id", "similarity"), V.frame_multimodal_search(frames(t), two_vectors(t), thr=0.1, k=10).select("query_id", "id", "similarity"), page_hits(t).select("query_id", "id", "similarity"), 12), "query_id", "id", "origin", "similarity")
)
query("V19_reembed_all", "SELECT count(*) FILTER (WHERE b <> '') AS processed, count(*) FILTER (WHERE b = '') AS skipped FROM (SELECT trim(coalesce(nullif(content_text, ''), nullif(transcription, ''), '')) AS b FROM kb_documents)")(lambda t: V.reembed_all(t("kb_documents"), V.hashed_embedder())[1])
query("V20_embed_or_placeholder", "SELECT id, CASE WHEN content_text IS NULL THEN 0e0 ELSE 1e0 END AS confidence, CASE WHEN content_text IS NULL THEN 'error' ELSE 'text' END AS method, 64 AS dim FROM kb_documents")(lambda t: V.embed_safe(t("kb_documents").drop("embedding"), "content_text", V.hashed_embedder()).select("id", "confidence", "method", F.size("embedding").alias("dim")))
query("V21_document_embedding")(lambda t: _unit(V.document_embedding(t("kb_documents").select("id", "type", "content_text"), t("kb_frames").select("document_id", "frame_number", F.col("ocr_text").alias("description")), V.hashed_embedder()), "id"))

query("T1_tokenize_index", f"SELECT id, count(*) AS n, cast(max(pos) AS bigint) AS last_pos, count(DISTINCT term) AS terms FROM ({INDEX}) GROUP BY 1")(lambda t: T.index_sizes(t("documents"), "doc_id", "text"))


@query("T1_english_terms")
def english_terms(t: Tables) -> DataFrame:
    """The English index of all documents: stems without stop words, with how often and where they stand."""
    return X.english_terms(t("documents"), "doc_id", "text").select("id", "term", "tf", F.element_at("places", 1).alias("first_pos"), F.element_at("places", -1).alias("last_pos"))


query("T2_match_all_terms", indexed(ALL))(lambda t: T.match_all_terms(index(t), T.query_terms(text_queries(t))))



@query("T3_match_websearch", f"WITH idx AS ({INDEX}), s AS (SELECT DISTINCT id FROM idx WHERE term = 'heea'), v AS (SELECT DISTINCT id FROM idx WHERE term = 'des'), p AS (SELECT DISTINCT a.id FROM idx a JOIN idx b ON a.id = b.id AND b.pos = a.pos + 1 WHERE a.term = 'license' AND b.term = 'version') SELECT id FROM s WHERE id NOT IN (SELECT id FROM v) UNION SELECT id FROM p")
def websearch(t: Tables) -> DataFrame:
    return T.match_websearch(t("documents").select(F.col("doc_id").alias("id")), index(t), 'heea -des or "license version"')


FOUND = "SELECT DISTINCT a.id FROM idx a JOIN idx b ON a.id = b.id AND b.pos = a.pos + 1 WHERE a.term = 'mit' AND b.term = 'license' UNION SELECT id FROM idx WHERE term = 'apache'"
COUNTED = "SELECT id, count(*) AS n FROM idx WHERE term IN ('mit', 'license', 'apache') GROUP BY 1"


@query("T4_keyword_search", f"WITH idx AS ({INDEX}) SELECT d.id, d.title, 0.8e0 AS similarity FROM kb_documents d JOIN ({FOUND}) f ON f.id = d.id LEFT JOIN ({COUNTED}) c ON c.id = d.id WHERE list_contains(d.tags, 'en') ORDER BY coalesce(c.n, 0) DESC, d.id LIMIT 10")
def keyword(t: Tables) -> DataFrame:
    docs = t("kb_documents").select("id", "title", "type", "tags")
    return T.keyword_search(docs, index(t), '"mit license" or apache', tags=["en"], k=10).select("id", "title", "similarity")


query("T5_text_rank_cd", indexed("SELECT query_id, id, round(text_rank, 6) AS text_rank FROM cover"))(lambda t: shown(T.text_rank_cd(index(t), T.query_terms(text_queries(t))), "query_id", "id", "text_rank"))
RANK = "SELECT f.query_id, f.id, sum(0.1e0 * (1 + ln(f.tf))) / any_value(d.n) AS text_rank FROM (SELECT w.query_id, i.id, i.term, count(*) AS tf FROM idx i JOIN wanted w ON w.term = i.term GROUP BY 1, 2, 3) f JOIN need d ON d.query_id = f.query_id GROUP BY 1, 2"
query("T6_text_rank", indexed(RANK.replace("SELECT f.query_id, f.id, sum", "SELECT f.query_id, f.id, round(sum", 1).replace("any_value(d.n) AS", "any_value(d.n), 6) AS")))(lambda t: shown(T.text_rank(index(t), T.query_terms(text_queries(t))), "query_id", "id", "text_rank"))

def short_terms(t: Tables) -> DataFrame:
    """Short queries: the first three terms of every benchmark item."""
    texts = t("benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return T.query_terms(texts).where("term_no < 3")


def shortly(rest: str) -> str:
    """SQL over the same names as indexed, for the short queries."""
    return f"WITH idx AS ({INDEX}), all_wanted AS ({WANTED.replace('WHERE item_id % 8 = 0', '')}), wanted AS (SELECT * FROM all_wanted WHERE term_no < 3), need AS ({NEED}), held AS ({HELD}), cover AS ({COVER}) {rest}"


query("T2_match_short", shortly(ALL))(lambda t: T.match_all_terms(index(t), short_terms(t)))
query("T5_rank_short", shortly("SELECT query_id, id, round(text_rank, 6) AS text_rank FROM cover"))(lambda t: shown(T.text_rank_cd(index(t), short_terms(t)), "query_id", "id", "text_rank"))


@query("T6_top_blocks", None)
def top_blocks(t: Tables) -> DataFrame:
    """The ten best documents of every benchmark item's text, from the blocks of an English index that can hold them."""
    held = X.build(t("documents"), "doc_id", "text")
    texts = t("benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return shown(X.top_ranked(held, X.english_query(texts)), "query_id", "id", "text_rank")


TITLE = "regexp_extract(html, '<title>([^<]*)</title>', 1)"
TITLED = WANTED.replace("item_id, regexp_extract_all(lower(text)", f"page_id AS item_id, regexp_extract_all(lower({TITLE})").replace("FROM benchmark WHERE item_id % 8 = 0", "FROM pages WHERE page_id % 100 = 0")
PIDX = INDEX.replace("doc_id AS id", "page_id AS id").replace("text)", "regexp_replace(html, '<[^>]*>', ' ', 'g'))").replace("FROM documents", "FROM pages")


def titles(t: Tables) -> DataFrame:
    """Query texts: the titles of every hundredth page."""
    return t("pages").where("page_id % 100 = 0").select(F.col("page_id").alias("query_id"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("query"))


@query(
    "T7_web_content_search",
    f"WITH idx AS ({PIDX}), wanted AS ({TITLED}), need AS ({NEED}), hits AS (SELECT r.*, p.url, substring(p.content_text, 1, 300) AS snippet FROM ({RANK}) r JOIN ({ALL}) a ON a.query_id = r.query_id AND a.id = r.id JOIN kb_pages p ON p.id = r.id JOIN kb_web_sources s ON s.id = p.source_id WHERE p.processing_status = 'completed') {top('SELECT * FROM hits', 20, 'query_id, id, url, snippet, round(text_rank, 6) AS text_rank', 'round(text_rank, 9) DESC, id')}",
)
def web_search(t: Tables) -> DataFrame:
    idx = T.tokenize_index(t("pages").withColumn("body", F.regexp_replace("html", "<[^>]*>", " ")), "page_id", "body")
    hits = T.web_content_search(t("kb_pages"), t("kb_web_sources"), idx, T.query_terms(titles(t)))
    return shown(hits, "query_id", "id", "url", "snippet", "text_rank")


TSD = f"TIMESTAMP '{AS_OF}'"
BOOST = f"rank * CASE WHEN date_diff('second', created_at, {TSD}) / 86400e0 < 30 THEN 1.1e0 ELSE 1e0 END * CASE WHEN chunk_id IS NOT NULL THEN 1.05e0 ELSE 1e0 END * CASE type WHEN 'knowledge' THEN 1.2e0 WHEN 'sop' THEN 1.15e0 WHEN 'strategy' THEN 1.1e0 ELSE 1e0 END"
query("R1_rerank", f"SELECT query_id, id, round({BOOST}, 6) AS rank FROM kb_all_hits")(lambda t: R.rerank(t("kb_all_hits"), AS_OF).select("query_id", "id", F.round("rank", 6).alias("rank")))
query("R2_confidence", "SELECT query_id, round(0.4e0 * avg(similarity) + 0.4e0 * first(similarity ORDER BY rank DESC, id) + 0.2e0 * least(count(*), 5) / 5e0, 6) AS confidence, count(*) AS n FROM kb_all_hits GROUP BY 1")(lambda t: R.confidence(t("kb_all_hits")).withColumn("confidence", F.round("confidence", 6)))
HAS = lambda *w: "(" + " OR ".join(f"contains(lower(query), '{x}')" for x in w) + ")"
INTENT = f"CASE WHEN {HAS('code', 'function', 'class', 'sql', 'database', 'api')} THEN 'chunk-based' WHEN {HAS(chr(34), 'exact', 'specifically')} THEN 'keyword' WHEN {HAS('similar', 'like', 'related', 'about')} THEN 'semantic' ELSE 'hybrid' END"
query("R3_classify_intent", f"SELECT query_id, {INTENT} AS strategy FROM kb_asked")(lambda t: R.classify_intent(t("kb_asked")).select("query_id", "strategy"))
TECH = "regexp_matches(query, '(?i)\\b(code|api|database|sql|function|class|technical|system)\\b')"
KIND = f"CASE WHEN {HAS('how', 'what', 'why')} THEN 'question' WHEN {HAS('compare', 'difference')} THEN 'comparison' WHEN {HAS('summarize', 'summary')} THEN 'summarization' ELSE 'search' END"
query("R4_analyze_query", f"SELECT query_id, {KIND} AS intent, {TECH} AS technical, CASE WHEN regexp_matches(query, '[.?!]') THEN 'complex' ELSE 'simple' END AS complexity, CASE WHEN {HAS('similar', 'like')} THEN 'semantic' WHEN {HAS(chr(34))} THEN 'keyword' WHEN {TECH} THEN 'chunk-based' ELSE 'hybrid' END AS strategy FROM kb_asked")(
    lambda t: R.analyze_query(t("kb_asked")).select("query_id", "intent", "technical", "complexity", "strategy")
)
query("R5_query_defaults", f"SELECT query_id, CASE WHEN regexp_matches(query, '[.?!]') THEN 15 ELSE 5 END AS max_results, CASE {KIND} WHEN 'question' THEN 0.25e0 ELSE 0.3e0 END AS threshold FROM kb_asked")(lambda t: R.query_defaults(R.analyze_query(t("kb_asked"))).select("query_id", "max_results", "threshold"))
query("R6_normalize_query", "SELECT query_id, lower(trim(regexp_replace(query, '\\s+', ' ', 'g'))) AS processed FROM kb_asked")(lambda t: t("kb_asked").select("query_id", C.normalize_query("query").alias("processed")))
RELEVANT = "len(list_filter(regexp_split_to_array(lower(q.query), '\\s+'), lambda w: length(w) > 2 AND contains(lower(concat(h.title, ' ', h.content)), w))) / len(regexp_split_to_array(lower(q.query), '\\s+'))::DOUBLE"
query("R7_query_relevance", f"SELECT h.query_id, h.id, round({RELEVANT}, 6) AS relevance FROM kb_all_hits h JOIN kb_asked q ON q.query_id = h.query_id")(lambda t: R.query_relevance(t("kb_all_hits"), t("kb_asked")).select("query_id", "id", F.round("relevance", 6).alias("relevance")))
SUB = "SELECT query_id // 8 AS session_id, query_id AS query_no, id, chunk_id, title, content, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS pos FROM kb_hits"
MERGED = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id, coalesce('c' || cast(chunk_id AS varchar), 'd' || cast(id AS varchar)) ORDER BY query_no, pos) AS nth FROM (SELECT s.*, n.n FROM ({SUB}) s JOIN (SELECT query_id // 8 AS session_id, count(DISTINCT query_id) AS n FROM kb_hits GROUP BY 1) n ON n.session_id = s.session_id WHERE s.pos <= ceil(10e0 / n.n))) WHERE nth = 1"


def sub_hits(t: Tables) -> DataFrame:
    ranked = topk_per_query(t("kb_hits").drop("rank").withColumn("score", F.col("similarity")), 10**6)
    return ranked.select(F.floor(F.col("query_id") / 8).alias("session_id"), F.col("query_id").alias("query_no"), F.col("rank").alias("pos"), "id", "chunk_id", "title", "content", "similarity")


query("R8_multi_query_merge", f"SELECT session_id, id, rank FROM (SELECT h.session_id, h.id, row_number() OVER (PARTITION BY h.session_id ORDER BY h.similarity * ({RELEVANT}) DESC, h.query_no, h.pos) AS rank FROM ({MERGED}) h JOIN kb_asked q ON q.query_id = h.session_id) WHERE rank <= 10")(
    lambda t: R.multi_query_merge(sub_hits(t), t("kb_asked").select(F.col("query_id").alias("session_id"), "query")).select("session_id", "id", F.col("rank").cast("long").alias("rank"))
)
query("R9_recommendations", f"SELECT q.query_id, concat(CASE WHEN c < 0.3 THEN 'Put the question in other words|Ask about the wider subject first|' ELSE '' END, CASE WHEN {INTENT} = 'chunk-based' AND n < 3 THEN 'Search by meaning in place of passages|' ELSE '' END, CASE WHEN {TECH} AND c < 0.5 THEN 'Name the technical terms or the code that is meant|' ELSE '' END) AS advice FROM kb_asked q JOIN (SELECT query_id, min(similarity) AS c, count(*) % 5 + 1 AS n FROM kb_hits GROUP BY 1) h ON h.query_id = q.query_id")(
    lambda t: R.recommendations(R.analyze_query(t("kb_asked")).drop("strategy").join(R.classify_intent(t("kb_asked")).select("query_id", "strategy"), "query_id").join(t("kb_hits").groupBy("query_id").agg(F.min("similarity").alias("confidence"), (F.count("*") % 5 + 1).alias("n")), "query_id")).select("query_id", F.array_join(F.transform("recommendations", lambda x: F.concat(x, F.lit("|"))), "").alias("advice"))
)


@query("R10_strategy_dispatch")
def dispatch(t: Tables) -> DataFrame:
    vectors = t("embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    hits = R.strategy_dispatch(t("kb_asked").join(vectors, "query_id"), t("kb_documents"), t("kb_chunks"), index(t), AS_OF, 0.1, 5)
    return hits.select("query_id", "id", "chunk_id", F.round("rank", 6).alias("rank"))


query("R11_context_enrich", "SELECT c.id AS chunk_id, (SELECT string_agg(cast(x.chunk_index AS varchar), ',' ORDER BY x.chunk_index) FROM kb_chunks x WHERE x.document_id = c.document_id AND x.chunk_index BETWEEN c.chunk_index - 2 AND c.chunk_index + 2) AS near FROM kb_chunks c")(
    lambda t: R.context_enrich(t("kb_chunks").select(F.col("id").alias("chunk_id"), "document_id", "chunk_index"), t("kb_chunks")).select("chunk_id", F.array_join(F.transform("context", lambda x: x["chunk_index"].cast("string")), ",").alias("near"))
)
query("R12_assemble_context", "SELECT query_id, count(*) AS n_sources, cast(sum(length(concat('[', cast(nth AS varchar), '] ', title, ' (relevance ', cast(cast(round(similarity * 100) AS int) AS varchar), '%)', chr(10))) + CASE WHEN length(content) > 500 THEN 500 + length(concat(chr(10), '[content truncated]')) ELSE length(content) END) + 2 * (count(*) - 1) AS bigint) AS n_chars FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS nth FROM kb_all_hits) WHERE nth <= 5 GROUP BY 1")(
    lambda t: R.assemble_context(topk_per_query(t("kb_all_hits").drop("rank").withColumn("score", F.col("similarity")), 5), 500).select("query_id", "n_sources", F.length("context").cast("long").alias("n_chars"))
)
query("R13_normalize_hits", "SELECT query_id, id, round(coalesce(nullif(rank, 0), nullif(similarity, 0), 0.8e0), 6) AS rank, round(coalesce(nullif(similarity, 0), 0.8e0), 6) AS similarity FROM kb_all_hits")(lambda t: R.normalize_hits(t("kb_all_hits")).select("query_id", "id", F.round("rank", 6).alias("rank"), F.round("similarity", 6).alias("similarity")))
