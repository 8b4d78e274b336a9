"""Frames, scenes and timelines of videos."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.joins import frame_scene_interval, technical_3way
from tessera.operators.text import describe_visual
from tessera.operators.vectors import Embedder
from tessera.operators.windows import first_per_bucket


def video_timeline(frames: DataFrame, scenes: DataFrame, tech: DataFrame, interval: float = 30.0) -> DataFrame:
    """The first frame of each bucket with its scenes and its distinct code snippets in order."""
    first = first_per_bucket(frames.select("id", "document_id", "frame_number", "frame_timestamp"), interval)
    code = tech.where(F.col("extracted_code").isNotNull()).groupBy(F.col("frame_id").alias("id")).agg(F.array_join(F.array_sort(F.collect_set("extracted_code")), " | ").alias("code"))
    return frame_scene_interval(first, scenes).join(code, "id", "left")


def similar_technical(tech: DataFrame, frames: DataFrame, docs: DataFrame, content_type: str, terms: list[str] | None = None, thr: float = 0.3) -> DataFrame:
    kept = tech.where((F.col("content_type") == content_type) & (F.col("confidence") > thr))
    kept = kept if terms is None else kept.where(F.arrays_overlap("technical_terms", F.array(*map(F.lit, terms))))
    return technical_3way(kept, frames, docs).orderBy(F.desc("confidence"), "frame_timestamp", "frame_id")


def interval_sampling_plan(videos: DataFrame, max_frames: int = 100, interval: int = 30) -> DataFrame:
    """Frames to take of each video (document_id, duration): every `interval` seconds, `max_frames` at most."""
    n = F.least(F.lit(max_frames), F.floor(F.col("duration") / interval)).cast("int")
    steps = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return videos.select("document_id", F.explode(steps).alias("frame_number")).withColumn("frame_timestamp", (F.col("frame_number") * interval).cast("double")).withColumn("frame_id", F.concat(F.col("document_id"), F.lit("_frame_"), F.col("frame_number")))


def scene_sampling_plan(scores: DataFrame, thr: float = 0.3, max_frames: int = 100) -> DataFrame:
    """The first frames of each video (document_id, n, fps, score) whose scene score exceeds thr, with their timestamps."""
    by = Window.partitionBy("document_id").orderBy("n")
    return scores.where(F.col("score") > thr).withColumn("nth", F.row_number().over(by)).where(F.col("nth") <= max_frames).select("document_id", (F.col("nth") - 1).alias("frame_number"), (F.col("n") / F.col("fps")).alias("frame_timestamp"))


def frame_flags(analysis: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Frames (ocr_text and content flags) with contains_text set, and those of them that get technical rows."""
    out = analysis.withColumn("contains_text", F.length(F.coalesce("ocr_text", F.lit(""))) > 0)
    return out, out.where("contains_code OR contains_diagrams OR contains_ui_elements")


def frame_title(frames: DataFrame) -> DataFrame:
    return frames.withColumn("title", F.concat(F.lit("Frame at "), F.floor("frame_timestamp").cast("string"), F.lit("s")))


def frame_embeddings(frames: DataFrame, analysis: DataFrame, embedder: Embedder, context: int = 0) -> DataFrame:
    """Text and combined vectors of frames (id, document_id, frame_number, ocr_text) with their analysis (frame_id, analysis); context: frames before whose text counts too."""
    seen = analysis.select(F.col("frame_id").alias("id"), describe_visual().alias("seen"))
    rows = frames.join(seen, "id", "left").withColumn("whole", F.concat_ws(" ", "seen", F.nullif("ocr_text", F.lit(""))))
    if context:
        by = Window.partitionBy("document_id").orderBy("frame_number").rowsBetween(-context, -1)
        rows = rows.withColumn("whole", F.concat_ws(" ", "whole", F.array_join(F.collect_list("ocr_text").over(by), " ")))
    text = embedder(rows, "ocr_text").withColumnRenamed("embedding", "text_embedding")
    return embedder(text, "whole").withColumnRenamed("embedding", "combined_embedding").drop("seen", "whole")
