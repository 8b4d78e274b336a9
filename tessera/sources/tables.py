"""Tables: scans, uploads in parts, upserts, patches, cascades, retention and the ingest job.

Tables are DataFrames: an operator returns what the table holds afterwards. Parquet is written as a new folder and
swapped by path, never over what is being read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import columns as C
from tessera.operators.text import chunk_documents
from tessera.operators.vectors import Embedder, embed_text


def scan_project(df: DataFrame, cols: list[str], newest: str = "created_at") -> DataFrame:
    return df.orderBy(F.desc(newest), F.desc("id")).select(*cols)


def count_exact(df: DataFrame, pred: Column | None = None) -> DataFrame:
    return (df if pred is None else df.where(pred)).agg(F.count("*").alias("n"))


PART = r"^(?:.*/)?chunks/([^/]+)/chunk_(\d+)$"


def blob_parts(files: DataFrame) -> DataFrame:
    """session and part number of files (path, ...) named chunks/<session>/chunk_<number>, as a binaryFile read has them."""
    return files.withColumn("session", F.regexp_extract("path", PART, 1)).withColumn("part", F.regexp_extract("path", PART, 2)).where("session <> ''").withColumn("part", F.col("part").cast("int"))


def blob_manifest(files: DataFrame, expected: DataFrame) -> DataFrame:
    """expected (session, expected) with the parts found, whether all are there, and the numbers that are missing."""
    found = blob_parts(files).groupBy("session").agg(F.collect_set("part").alias("parts"))
    rows = expected.join(found, "session", "left").withColumn("parts", F.coalesce("parts", F.array().cast("array<int>")))
    every = F.when(F.col("expected") > 0, F.sequence(F.lit(0), F.col("expected").cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    missing = F.array_sort(F.array_except(every, "parts"))
    return rows.select("session", F.size("parts").alias("found"), "expected", (F.size(missing) == 0).alias("complete"), missing.alias("missing"))


def blob_reassemble(parts: DataFrame, expected: DataFrame) -> DataFrame:
    """One content for each complete session, its parts in order, put together once; incomplete sessions have status error and no content.

    Only parts of complete sessions are gathered. A content is one value, so a session holds 2 GB at most; ordered_parts has larger ones.
    """
    whole = blob_manifest(parts, expected).select("session", "complete")
    joined = ordered_parts(parts, whole).groupBy("session").agg(F.array_sort(F.collect_list(F.struct("part", F.hex("content").alias("content")))).alias("p"))
    content = F.unhex(F.array_join(F.col("p.content"), ""))
    out = whole.join(joined, "session", "left")
    return out.select("session", F.when(F.col("complete"), content).alias("content"), F.when(F.col("complete"), "completed").otherwise("error").alias("status"))


def ordered_parts(parts: DataFrame, whole: DataFrame) -> DataFrame:
    """session, part and content (binary) of the complete sessions (session, complete), a row a part: a session's parts in one partition, in order."""
    rows = blob_parts(parts).select("session", "part", F.col("content").cast("binary").alias("content"))
    return rows.join(whole.where("complete").select("session"), "session", "left_semi").repartition("session").sortWithinPartitions("session", "part")


TEXT_TYPES = (".txt", ".md", ".markdown")


def text_ingest(files: DataFrame) -> DataFrame:
    """files (id, path, content) decoded by extension: id, ext, content_text, status; what can't be read has status error."""
    ext = F.regexp_extract(F.lower("path"), r"(\.[^./]+)$", 1)
    text = F.when(ext.isin(*TEXT_TYPES), F.trim(F.decode(F.col("content").cast("binary"), "UTF-8")))
    return files.select("id", ext.alias("ext"), text.alias("content_text"), F.when(ext.isin(*TEXT_TYPES), "completed").otherwise("error").alias("status"))


def upsert_by_key(target: DataFrame, source: DataFrame, keys: list[str], newest: str | None = None) -> DataFrame:
    """target with the rows of source in place of those with the same keys; of several source rows of a key the newest counts."""
    if newest:
        by = Window.partitionBy(*keys).orderBy(F.desc(newest))
        source = source.withColumn("_n", F.row_number().over(by)).where("_n = 1").drop("_n")
    else:
        source = source.dropDuplicates(keys)
    return target.join(source.select(*keys), keys, "left_anti").unionByName(source.select(*target.columns))


def replace_children(target: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """target without the children of any parent that new has children of, and with those."""
    return target.join(new.select(key).distinct(), key, "left_anti").select(*target.columns).unionByName(new.select(*target.columns))


def append_sink(df: DataFrame, path: str) -> None:
    """Adds the rows to a folder as one commit: a write that fails leaves none. streams.stream_log_sink is the form that flushes by time."""
    df.write.mode("append").parquet(path)


LEVELS = ("debug", "info", "warn", "error")


def _valid_log() -> Column:
    some = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    return some("component") & some("action") & some("message") & F.coalesce(F.col("level").isin(*LEVELS), F.lit(False))


def validate_records(logs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows that can be kept, rows that can't, and how many of each."""
    flagged = logs.withColumn("_ok", _valid_log())
    return flagged.where("_ok").drop("_ok"), flagged.where("NOT _ok").drop("_ok"), flagged.agg(F.count_if("_ok").alias("ok"), F.count_if(~F.col("_ok")).alias("failed"))


def patch_update(target: DataFrame, patch: DataFrame, key: str) -> DataFrame:
    """target with the values that patch has; null in a patch leaves a value as it is, unless the patch has a true has_<column>."""
    cols = [c for c in patch.columns if c != key and not c.startswith("has_")]
    marks = [c for c in patch.columns if c.startswith("has_")]
    p = patch.select(key, *[F.col(c).alias(f"_new_{c}") for c in cols], *marks)
    out = target.join(p, key, "left")
    for c in cols:
        given = F.coalesce(F.col(f"has_{c}"), F.lit(False)) if f"has_{c}" in marks else F.col(f"_new_{c}").isNotNull()
        out = out.withColumn(c, F.when(given, F.col(f"_new_{c}")).otherwise(F.col(c)))
    return out.select(*target.columns)


def cascade_delete(tables: dict[str, DataFrame], root: str, ids: DataFrame, children: list[tuple[str, str, str]], nulled: list[tuple[str, str, str]] = ()) -> dict[str, DataFrame]:
    """tables after the rows of root with the ids (id) and all that depends on them are gone.

    children: (child, foreign key, parent) in the order of the chain; nulled: references that become null instead.
    """
    gone = {root: ids.select("id").distinct()}
    out = dict(tables) | {root: tables[root].join(gone[root], "id", "left_anti")}
    for child, key, parent in children:
        dead = tables[child].join(gone[parent].select(F.col("id").alias(key)), key, "left_semi")
        gone[child] = dead.select("id")
        out[child] = out[child].join(gone[parent].select(F.col("id").alias(key)), key, "left_anti").select(*tables[child].columns)
    for table, key, parent in nulled:
        dead = gone[parent].select(F.col("id").alias(key), F.lit(True).alias("_dead"))
        out[table] = out[table].join(dead, key, "left").withColumn(key, F.when(F.col("_dead").isNull(), F.col(key))).select(*tables[table].columns)
    return out


def orphan_cleanup(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """Chunks whose document is there."""
    return chunks.join(docs.select(F.col("id").alias("document_id")), "document_id", "left_semi")


def retention(df: DataFrame, kind: str, as_of: str, days: int = 30) -> DataFrame:
    """What is kept: logs that aren't errors for `days`, error logs a week longer, metrics, health and activity for `days`, errors until they are resolved and `days` old."""
    cut = F.expr(f"TIMESTAMP_NTZ '{as_of}' - INTERVAL '{days}' DAY")
    ts = F.col("ts")
    if kind == "logs":
        later = F.expr(f"TIMESTAMP_NTZ '{as_of}' - INTERVAL '{days + 7}' DAY")
        return df.where(F.when(F.col("level") == "error", ts >= later).otherwise(ts >= cut))
    if kind == "errors":
        return df.where((ts >= cut) | ~F.col("resolved"))
    return df.where(ts >= cut)


def cache_evict(cache: DataFrame, as_of: str, days: int = 30, least_used: int = 2) -> DataFrame:
    old = F.col("last_accessed") < F.expr(f"TIMESTAMP_NTZ '{as_of}' - INTERVAL '{days}' DAY")
    return cache.where(~(old & (F.col("usage_count") < least_used)))


def schema_evolve(df: DataFrame, spec: dict[str, tuple[str, object]]) -> DataFrame:
    """df with the columns of spec (name: type, default) that it lacks."""
    return df.withColumns({name: F.lit(default).cast(kind) for name, (kind, default) in spec.items() if name not in df.columns})


def ingest_pipeline(docs: DataFrame, embedder: Embedder, as_of: str, chunking: bool = True, embeddings: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pending documents through text, chunks and vectors: (documents with their new state, chunks, counts).

    A document without text gets status error and a message and stops nothing; one whose text is too short for a chunk has a vector of its own.
    """
    body = C.whitespace_clean(C.content_or_transcription("content_text", "transcription"))
    wanted = docs.where(F.coalesce(F.col("transcription_status") != "error", F.lit(True)) & (F.col("content_text").isNull() | F.col("embedding").isNull() | F.coalesce(F.col("transcription_status") == "pending", F.lit(True)) | (F.coalesce("chunk_count", F.lit(0)) == 0)))
    rows = wanted.select("id", "title", "type", C.content_or_transcription("content_text", "transcription").alias("content_text"), body.alias("body"))
    chunks = chunk_documents(rows.where("body <> ''")) if chunking else chunk_documents(rows.limit(0))
    if embeddings:
        chunks = embed_text(chunks, "chunk_text", embedder)
    counted = chunks.groupBy(F.col("document_id").alias("id")).agg(F.count("*").alias("new_chunks"))
    state = rows.join(counted, "id", "left").withColumn("new_chunks", F.coalesce("new_chunks", F.lit(0)))
    if embeddings:
        state = embed_text(state, "body", embedder).withColumn("embedding", F.when(F.col("new_chunks") == 0, F.col("embedding")))
    failed = F.col("body") == ""
    out = (
        state.withColumn("transcription_status", F.when(failed, "error").otherwise("completed"))
        .withColumn("processing_error", F.when(failed, "No text content to process"))
        .withColumn("chunk_count", F.col("new_chunks"))
        .withColumn("last_processed_at", F.expr(f"TIMESTAMP_NTZ '{as_of}'"))
        .drop("new_chunks", "body")
    )
    stats = out.agg(F.count("*").alias("total"), F.count_if(F.col("transcription_status") == "completed").alias("completed"), F.count_if(F.col("transcription_status") == "error").alias("failed"), F.coalesce(F.sum("chunk_count"), F.lit(0)).alias("total_chunks"))
    return out, chunks, stats
