"""Folders of files as tables: manifests without content, texts, and uploads in parts put together without holding one as a whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.sources.tables import blob_manifest, blob_parts, text_ingest


def read_files(spark: SparkSession, path: str, glob: str = "*", most_bytes: int | None = None, since: str | None = None) -> DataFrame:
    """path, modificationTime, length and content of the files below a folder whose names match glob, by Spark's binary source, so from any store.

    most_bytes: longer files are left out before they are read. since: only files changed after that time. What selects no content reads none.
    Spark's source leaves out files without a byte, and names that begin with a dot or an underscore.
    """
    reader = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true")
    reader = reader if since is None else reader.option("modifiedAfter", since)
    files = reader.load(path)
    return files if most_bytes is None else files.where(F.col("length") <= most_bytes)


def manifest(files: DataFrame) -> DataFrame:
    """path, name, ext (lower case, with its dot, else empty), length and modificationTime of files, without their content."""
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    return files.select("path", name.alias("name"), F.regexp_extract(F.lower(name), r"[^.](\.[^.]+)$", 1).alias("ext"), "length", "modificationTime")


def ingest_folder(spark: SparkSession, path: str, glob: str = "*", most_bytes: int | None = None) -> DataFrame:
    """text_ingest() of the files of a folder, with their paths; a file's id is a hash of its path, so it stays when other files come or go."""
    files = read_files(spark, path, glob, most_bytes).withColumn("id", F.xxhash64("path"))
    return files.select("id", "path").join(text_ingest(files), "id")


def placed_parts(files: DataFrame, expected: DataFrame) -> DataFrame:
    """session, part, length, first_byte and content of the parts of complete sessions.

    first_byte is where a part begins in the whole. It comes from the lengths alone, so the window that adds them up holds no content, and a session of any
    size is the rows of its parts, which tasks read and write apart from each other.
    """
    whole = blob_manifest(files, expected).where("complete").select("session")
    sizes = blob_parts(files.select("path", "length")).join(whole, "session", "left_semi")
    before = Window.partitionBy("session").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("first_byte", F.coalesce(F.sum("length").over(before), F.lit(0))).select("path", "session", "part", "first_byte")
    return files.select("path", "length", "content").join(starts, "path").select("session", "part", "length", "first_byte", "content")


def write_sessions(files: DataFrame, expected: DataFrame, path: str, parts_a_file: int = 64) -> None:
    """The complete sessions as tables below path, one folder a session: their parts in order, parts_a_file of them in a file at most.

    Nothing holds a session as a whole: a large one is written by many tasks. Repeating it replaces the sessions that it writes and no others.
    """
    placed = placed_parts(files, expected).withColumn("file", F.floor(F.col("part") / parts_a_file))
    dealt = placed.repartition("session", "file").sortWithinPartitions("session", "part").drop("file")
    dealt.write.mode("overwrite").option("maxRecordsPerFile", parts_a_file).option("partitionOverwriteMode", "dynamic").partitionBy("session").parquet(path)


def session_bytes(spark: SparkSession, path: str, session: str, first: int, n: int) -> DataFrame:
    """part and content of what overlaps bytes first to first + n of a session, cut to them, in order: other parts' files are not read."""
    rows = spark.read.parquet(path).where((F.col("session") == session) & (F.col("first_byte") < first + n) & (F.col("first_byte") + F.col("length") > first))
    skip = F.greatest(F.lit(first) - F.col("first_byte"), F.lit(0))
    upto = F.least(F.lit(first + n) - F.col("first_byte"), F.col("length"))
    return rows.select("part", F.substring(F.col("content"), (skip + 1).cast("int"), (upto - skip).cast("int")).alias("content")).orderBy("part")
