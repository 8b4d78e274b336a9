"""Joins between documents, chunks, frames, scenes, sources and jobs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def chunk_join_document(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    return chunks.join(docs.select(F.col("id").alias("document_id"), "title", "type", "tags"), "document_id")


def vector_left_text(vec_hits: DataFrame, text_hits: DataFrame) -> DataFrame:
    return vec_hits.join(text_hits, "id", "left")


def frame_scene_interval(frames: DataFrame, scenes: DataFrame, how: str = "left", width: float | None = None) -> DataFrame:
    """Frames with the scenes of their document whose closed interval holds them; a frame on a border has both.

    With a width, scenes are repeated for each bucket of that many seconds that they reach into and the bucket is joined too, which
    spreads a document that has most of the frames over many keys.
    """
    s = scenes.select("document_id", "scene_number", "start_timestamp", "end_timestamp", "scene_type")
    if width is None:
        inside = (frames["document_id"] == s["document_id"]) & frames["frame_timestamp"].between(s["start_timestamp"], s["end_timestamp"])
        return frames.join(s, inside, how).drop(s["document_id"])
    floor = lambda c: F.floor(F.col(c) / width)
    s = s.withColumn("bucket", F.explode(F.sequence(floor("start_timestamp"), floor("end_timestamp"))))
    f = frames.withColumn("bucket", floor("frame_timestamp"))
    inside = (f["document_id"] == s["document_id"]) & (f["bucket"] == s["bucket"]) & f["frame_timestamp"].between(s["start_timestamp"], s["end_timestamp"])
    return f.join(s, inside, how).drop(s["document_id"]).drop("bucket")


def chunk_neighbours(chunks: DataFrame, targets: DataFrame, window: int = 2) -> DataFrame:
    """Chunks of a target's document whose index is at most `window` away: an equi-join on the indexes that a target reaches."""
    reach = targets.select(F.col("id").alias("target_id"), "document_id", F.col("chunk_index").alias("target_index"), F.explode(F.sequence(F.col("chunk_index") - window, F.col("chunk_index") + window)).alias("chunk_index"))
    return reach.join(chunks, ["document_id", "chunk_index"]).withColumn("is_target", F.col("id") == F.col("target_id"))


def no_active_job(sources: DataFrame, jobs: DataFrame) -> DataFrame:
    active = jobs.where(F.col("status").isin("pending", "running")).select(F.col("source_id").alias("id"))
    return sources.join(active, "id", "left_anti")


def technical_3way(tech: DataFrame, frames: DataFrame, docs: DataFrame) -> DataFrame:
    f = frames.select(F.col("id").alias("frame_id"), "document_id", "frame_number", "frame_timestamp")
    d = docs.select(F.col("id").alias("document_id"), F.col("title").alias("document_title"))
    return tech.join(f, "frame_id").join(d, "document_id")


def nest_children(parent: DataFrame, children: dict[str, tuple[DataFrame, str, list[str]]]) -> DataFrame:
    """parent (id) with an array column for each child table (frame, its foreign key, its columns), empty where it has none.

    Children are gathered before they are joined, so several of them don't multiply each other.
    """
    out = parent
    for name, (child, key, cols) in children.items():
        nested = child.groupBy(F.col(key).alias("id")).agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(name))
        kind = dict(nested.dtypes)[name]
        out = out.join(nested, "id", "left").withColumn(name, F.coalesce(name, F.array().cast(kind)))
    return out


def enrich_hits(hits: DataFrame, analysis: DataFrame, technical: DataFrame) -> DataFrame:
    """Hits (id) with their analysis and technical rows, arrays that are empty where there are none."""
    ids = hits.select(F.col("id").alias("frame_id")).distinct()
    kept = {n: (t.join(ids, "frame_id", "left_semi"), "frame_id", [c for c in t.columns if c != "frame_id"]) for n, t in (("analysis", analysis), ("technical", technical))}
    return nest_children(hits, kept)


def bucket_join(frames: DataFrame, interval: float) -> DataFrame:
    """Frames with the least timestamp of their document's bucket; a window, where a join with the grouped buckets would shuffle twice."""
    by = Window.partitionBy("document_id", F.floor(F.col("frame_timestamp") / interval))
    return frames.withColumn("bucket_start", F.min("frame_timestamp").over(by))


def page_source_filter(pages: DataFrame, sources: DataFrame, domain: str | None = None) -> DataFrame:
    s = sources.select(F.col("id").alias("source_id"), "domain", F.col("status").alias("source_status"))
    out = pages.join(s, "source_id")
    return out if domain is None else out.where(F.col("domain") == domain)


def existing_doc_lookup(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """Pages with the document whose metadata names them (null: none); of several the least id."""
    known = docs.select(F.get_json_object("metadata", "$.page_id").cast("long").alias("id"), F.col("id").alias("existing_id")).where("id IS NOT NULL")
    return pages.join(known.groupBy("id").agg(F.min("existing_id").alias("existing_id")), "id", "left")


def union_all(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b)


def union_sources(docs: DataFrame, multimodal: DataFrame, web: DataFrame) -> DataFrame:
    named = [df.withColumn("origin", F.lit(name)) for name, df in (("document", docs), ("multimodal", multimodal), ("web", web))]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)


def union_ids_distinct(*dfs: DataFrame) -> DataFrame:
    return reduce(DataFrame.union, [d.select("id") for d in dfs]).distinct()


def url_set_difference(new: DataFrame, visited: DataFrame, queued: DataFrame) -> DataFrame:
    known = visited.select("url").union(queued.select("url"))
    return new.select("url").distinct().join(known, "url", "left_anti")


def query_cross_corpus(queries: DataFrame, corpus: DataFrame, block: int = 4_096) -> DataFrame:
    """Every query with every row of the corpus. The query set is sent to the corpus in blocks of about `block` queries, so what is broadcast is bounded."""
    n = queries.count()
    blocks = max(1, -(-n // block))
    parts = [corpus.crossJoin(F.broadcast(queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b))) for b in range(blocks)]
    return reduce(DataFrame.unionByName, parts)
