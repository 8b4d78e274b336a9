"""Streams over many batches: late rows, restarts, windows that close."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators.windows import change_lag
from tessera.streaming import streams


def source(spark, df, path):
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(path)


def versions(spark, n=160, pages=6, seed=1):
    """Versions of pages that arrive out of order."""
    rng = random.Random(seed)
    rows = [(rng.randrange(pages), i, rng.choice([None, "", "a", "b", "c"]) and rng.choice("abc") * rng.randrange(1, 2_500)) for i in range(n)]
    order = sorted(range(n), key=lambda i: i + rng.randrange(30))
    return spark.createDataFrame([rows[i] for i in order], "page_id int, seq int, content_text string"), [rows[i] for i in order]


def test_changes_over_batches_with_late_rows_and_a_restart(spark, tmp_path):
    """Eight batches in two runs of the stream give what change_lag gives over all versions at once."""
    df, rows = versions(spark)
    (tmp_path / "in").mkdir()
    stream = source(spark, df, f"{tmp_path}/in")
    for k in range(8):
        spark.createDataFrame(rows[k * 20 : k * 20 + 20], df.schema).coalesce(1).write.parquet(f"{tmp_path}/in/part{k}")
        if k in (3, 7):
            streams.stream_change_detect(stream, f"{tmp_path}/c", f"{tmp_path}/k").awaitTermination()
    found = spark.read.parquet(f"{tmp_path}/c")
    assert found.where("late").count() == 0 and found.count() > len(rows)
    hashed = df.select("page_id", F.col("seq").alias("version_number"), streams.C.content_hash("content_text").alias("content_hash"), F.length("content_text").cast("long").alias("content_length"))
    want = {tuple(r) for r in change_lag(hashed).collect()}
    assert {tuple(r)[:5] for r in streams.current_changes(found).collect()} == want
    streams.stream_change_detect(stream, f"{tmp_path}/c", f"{tmp_path}/k").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/c").count() == found.count()


def test_versions_beyond_the_kept_ones_are_late(spark, tmp_path):
    rows = [(1, s, str(s)) for s in (10, 11, 12, 13, 14)] + [(1, 5, "x"), (2, 5, "x"), (1, 13, "y"), (1, None, "z")]
    df = spark.createDataFrame(rows, "page_id int, seq int, content_text string")
    for k in range(2):
        spark.createDataFrame(rows[k * 5 : k * 5 + 5], df.schema).coalesce(1).write.parquet(f"{tmp_path}/in/part{k}")
    streams.stream_change_detect(source(spark, df, f"{tmp_path}/in"), f"{tmp_path}/c", f"{tmp_path}/k", keep=3).awaitTermination()
    got = {(r.page_id, r.seq): (r.changed, r.late) for r in streams.current_changes(spark.read.parquet(f"{tmp_path}/c")).collect()}
    assert got == {(1, s): (True, False) for s in (10, 11, 12, 13, 14)} | {(1, 5): (None, True), (2, 5): (True, False)}


def test_a_time_to_live_needs_a_stream_that_runs_on(spark, tmp_path):
    (tmp_path / "in").mkdir()
    df, _ = versions(spark, 3)
    with pytest.raises(ValueError):
        streams.stream_change_detect(source(spark, df, f"{tmp_path}/in"), f"{tmp_path}/c", f"{tmp_path}/k", ttl_hours=1)


def test_hours_close_once_and_late_rows_are_counted(spark, tmp_path):
    """Batches in order, out of order within the watermark, and one row beyond it."""
    at = lambda minutes: F.expr(f"TIMESTAMP '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, {minutes}, 0)")
    batches = [[0, 30, 59, 61], [130, 90, 125], [200, 110, 185], [330, 300], [400, 20, 395]]
    frame = lambda minutes: spark.createDataFrame([(m, float(m)) for m in minutes], "m int, v double").select(at("m").alias("ts"), F.when(F.col("m") % 2 == 0, "healthy").otherwise("degraded").alias("overall_status"), F.col("v").alias("avg_response_time"), F.col("v").alias("error_rate"), F.col("v").alias("throughput"))
    for k, minutes in enumerate(batches):
        frame(minutes).coalesce(1).write.parquet(f"{tmp_path}/in/part{k}")
    trend = streams.stream_health_trend(source(spark, frame([0]), f"{tmp_path}/in"), "2 hours")
    query = streams.write_closed(trend, f"{tmp_path}/out", f"{tmp_path}/k")
    query.awaitTermination()
    got = {(r.time_bucket.hour, round(r.avg_response_time, 6), round(r.healthy_percentage, 6)) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    kept = [m for b in batches for m in b if m != 20]  # the hour of minute 20 was closed in the batch before
    want = set()
    for hour in range(7):
        mine = [m for m in kept if m // 60 == hour]
        if mine and (hour + 1) * 60 <= 400 - 120:
            want.add((hour, round(sum(mine) / len(mine), 6), round(100 * sum(m % 2 == 0 for m in mine) / len(mine), 6)))
    assert got == want and len(want) == 4
    assert streams.dropped(query) == 1
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 2  # the open hours: 300 and 330, 395 and 400
    again = streams.write_closed(trend, f"{tmp_path}/out", f"{tmp_path}/k")
    again.awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == len(want)


def test_batches_follow_the_bytes_not_the_files(spark, tmp_path):
    """Twelve small files are one batch, and come in several where a batch is to be smaller."""
    df, rows = versions(spark)
    df.repartition(12).write.parquet(f"{tmp_path}/in")
    batches = {}
    for size in (1 << 30, 1):
        query = streams.stream_change_detect(streams.read_events(spark, f"{tmp_path}/in", size), f"{tmp_path}/c{size}", f"{tmp_path}/k{size}")
        query.awaitTermination()
        batches[size] = sum(p.numInputRows > 0 for p in query.recentProgress)
    assert batches == {1 << 30: 1, 1: 12}
    one, many = ({tuple(r) for r in streams.current_changes(spark.read.parquet(f"{tmp_path}/c{size}")).collect()} for size in batches)
    assert one == many and len(one) == len(set(rows))
