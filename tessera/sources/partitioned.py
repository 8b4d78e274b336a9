"""Stored tables in parts: upserts that rewrite only what they touch, writes that count as they go, and retention by whole days."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tessera.sources.scratch import delete
from tessera.sources.tables import _valid_log, replace_children, retention, upsert_by_key

PART = "key_part"


def _parted(df: DataFrame, keys: list[str], parts: int) -> DataFrame:
    return df.withColumn(PART, F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int"))


def write_keyed(df: DataFrame, path: str, keys: list[str], parts: int) -> None:
    """df as a new table in `parts` folders by a hash of its keys."""
    _parted(df, keys, parts).repartition(parts, PART).write.mode("overwrite").partitionBy(PART).parquet(path)


def read_keyed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop(PART)


def _rewrite(path: str, touched: list[int], new: DataFrame, keys: list[str], parts: int) -> None:
    """Puts new, which has rows of every touched part, in place of these; the others' files stay. The old files go when all new ones are written, and a run that ends before that can be repeated."""
    out = _parted(new, keys, parts).repartition(len(touched), PART)
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PART).parquet(path)


def _touched(changed: DataFrame, keys: list[str], parts: int) -> list[int]:
    """The parts that the rows of changed are in: as many numbers as the table has parts, at most."""
    return sorted(r[PART] for r in _parted(changed, keys, parts).select(PART).distinct().collect())


def upsert_keyed(spark: SparkSession, path: str, source: DataFrame, keys: list[str], parts: int, newest: str | None = None) -> list[int]:
    """upsert_by_key() into a table of write_keyed; returns the parts that were rewritten.

    Only parts with a row that is new or differs are read as a whole and written; a repeat finds no such row and writes nothing.
    Null keys are keys that never match, as in upsert_by_key.
    """
    target = spark.read.parquet(path)
    columns = [c for c in target.columns if c != PART]
    one = upsert_by_key(target.select(*columns).limit(0), source, keys, newest)
    changed = one.exceptAll(target.select(*columns).join(one.select(*keys).distinct(), keys, "left_semi"))
    touched = _touched(changed, keys, parts)
    if touched:
        mine = target.where(F.col(PART).isin(touched)).select(*columns)
        rows = upsert_by_key(mine, _parted(one, keys, parts).where(F.col(PART).isin(touched)).drop(PART), keys)
        _rewrite(path, touched, rows, keys, parts)
    return touched


def replace_children_keyed(spark: SparkSession, path: str, new: DataFrame, key: str, parts: int) -> list[int]:
    """replace_children() in a table of write_keyed whose key is the parent; returns the parts that were rewritten, those of the parents whose children differ from what is there."""
    target = spark.read.parquet(path)
    columns = [c for c in target.columns if c != PART]
    rows = new.select(*columns)
    there = target.select(*columns).join(new.select(key).distinct(), key, "left_semi").select(*columns)
    touched = _touched(rows.exceptAll(there).unionByName(there.exceptAll(rows)), [key], parts)
    if touched:
        mine = target.where(F.col(PART).isin(touched)).select(*columns)
        wanted = _parted(rows, [key], parts).where(F.col(PART).isin(touched)).drop(PART)
        _rewrite(path, touched, replace_children(mine, wanted, key), [key], parts)
    return touched


def write_validated(logs: DataFrame, path: str) -> dict[str, int]:
    """Writes logs below path, rows that can be kept in valid=true and others in valid=false, and returns how many there are of each (ok, failed): counted while they are written, in one scan."""
    counts = Observation("validated")
    flagged = logs.withColumn("valid", _valid_log()).observe(counts, F.count_if("valid").alias("ok"), F.count_if(~F.col("valid")).alias("failed"))
    flagged.write.mode("append").partitionBy("valid").parquet(path)
    return counts.get


def write_by_day(df: DataFrame, path: str, ts: str = "ts") -> None:
    """df in one folder a day of its time."""
    df.withColumn("day", F.to_date(ts)).repartition("day").write.mode("overwrite").partitionBy("day").parquet(path)


def _first_day(kind: str, as_of: str, days: int):
    """The earliest day that can hold a row which retention keeps whatever its state: error logs stay a week longer; unresolved errors stay at any age."""
    return None if kind == "errors" else F.expr(f"to_date(TIMESTAMP_NTZ '{as_of}' - INTERVAL '{days + (7 if kind == 'logs' else 0)}' DAY)")


def retained(spark: SparkSession, path: str, kind: str, as_of: str, days: int = 30) -> DataFrame:
    """retention() of a table of write_by_day: days before the first that can hold a kept row aren't listed, let alone read."""
    rows, first = spark.read.parquet(path), _first_day(kind, as_of, days)
    rows = rows if first is None else rows.where(F.col("day") >= first)
    return retention(rows, kind, as_of, days).drop("day")


def expire(spark: SparkSession, path: str, kind: str, as_of: str, days: int = 30) -> list[str]:
    """Deletes what retention doesn't keep from a table of write_by_day; returns the days whose files changed.

    Whole days go by their folders. Days of which a part stays are written anew; those wholly kept stay as they are. A repeat changes nothing.
    """
    rows = spark.read.parquet(path)
    kept = retention(rows.withColumn("row_kept", F.lit(True)), kind, as_of, days)
    had, has = rows.groupBy("day").count(), kept.groupBy("day").agg(F.count("*").alias("kept"))
    changed = had.join(has, "day", "left").where("kept IS NULL OR kept < count").collect()  # a row a day
    edge = [r.day for r in changed if r.kept]
    if edge:
        part = retention(rows.where(F.col("day").isin(edge)), kind, as_of, days)
        part.repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)
    for r in changed:
        if not r.kept:
            delete(spark, f"{path}/day={r.day if r.day is not None else '__HIVE_DEFAULT_PARTITION__'}")
    return sorted(str(r.day) for r in changed)
