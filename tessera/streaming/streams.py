"""Structured Streaming forms of the operators that poll: the same rows as their batch twins."""

from __future__ import annotations

import json
from bisect import bisect_left, insort
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from tessera.functions import columns as C
from tessera.sources.scratch import folder
from tessera.sources.tables import validate_records


def read_events(spark: SparkSession, path: str, size: int = 1 << 30) -> DataFrame:
    """A stream over the Parquet files of a path, about so many bytes at a time: a batch has a cost of its own, so their number follows the data, not its files. The path may name one file; as a pattern it may be either."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxBytesPerTrigger", size).parquet(f"{path[:-1]}[{path[-1]}]")


def stream_health_trend(stream: DataFrame, late: str = "2 hours") -> DataFrame:
    """Hourly means of health snapshots (ts, overall_status, ...). In append mode an hour comes out once, when the watermark, `late` behind the newest row, has passed its end; rows after that are dropped."""
    return (
        stream.withColumn("ts", F.col("ts").cast("timestamp"))
        .withWatermark("ts", late)
        .groupBy(F.window("ts", "1 hour"))
        .agg(F.avg("avg_response_time").alias("avg_response_time"), F.avg("error_rate").alias("avg_error_rate"), F.avg("throughput").alias("avg_throughput"), (F.count_if(F.col("overall_status") == "healthy") * 100.0 / F.count("*")).alias("healthy_percentage"))
        .select(F.col("window.start").cast("timestamp_ntz").alias("time_bucket"), "avg_response_time", "avg_error_rate", "avg_throughput", "healthy_percentage")
    )


def stream_error_summary(stream: DataFrame, late: str = "2 hours") -> DataFrame:
    """Errors by component and type over the last 24 hours, every hour anew; in append mode each such window once, when the watermark has passed its end."""
    return (
        stream.withColumn("ts", F.col("ts").cast("timestamp"))
        .withWatermark("ts", late)
        .groupBy(F.window("ts", "24 hours", "1 hour"), "component", "error_type")
        .agg(F.count("*").alias("error_count"), F.max("ts").cast("timestamp_ntz").alias("last_occurrence"), F.count_if("resolved").alias("resolved_count"))
        .select(F.col("window.end").cast("timestamp_ntz").alias("as_of"), "component", "error_type", "error_count", "last_occurrence", "resolved_count")
    )


def stream_log_sink(stream: DataFrame, path: str, checkpoint: str, trigger: dict | None = None):
    """Appends valid log rows to a folder every 30 seconds; a batch that is repeated after a failure adds nothing twice."""
    ok, _, _ = validate_records(stream)
    return ok.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "30 seconds"})).start(path)


def stream_pending_sweep(stream: DataFrame) -> DataFrame:
    lacks = F.col("content_text").isNull() | F.col("transcription").isNull()
    return stream.where(lacks & (F.col("transcription_status") != "error"))


def stream_dedup_hash(stream: DataFrame, text: str, ts: str, late: str = "1 day") -> DataFrame:
    """The first row of each content hash within the watermark."""
    return stream.withColumn("content_hash", F.sha2(text, 256)).withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark(["content_hash"])


CHANGE = "page_id {page}, seq long, changed boolean, change_percentage double, significant_change boolean, late boolean, revision long"
STATE = "seqs array<long>, hashes array<string>, lengths array<long>, revision long, forgot boolean"


def _compared(old: tuple | None, new: tuple) -> tuple[bool, float, bool]:
    """change_lag of one version (content hash, length) and the one before."""
    (hash, length), (old_hash, old_length) = new, old or (None, None)
    if old_hash is None:
        return hash is not None, 100.0, True
    if old_hash == hash:
        return False, 0.0, False
    if length is None or old_length is None:
        return True, 100.0, True
    delta = abs(length - old_length)
    percentage = delta * 100.0 / max(old_length, 1)
    return True, percentage, percentage > 10 or delta > 1000


class PageChanges(StatefulProcessor):
    """Keeps the last versions of a page and compares what arrives with the version before it, in the order of seq."""

    def __init__(self, keep: int, ttl_ms: int | None):
        self.keep, self.ttl_ms = keep, ttl_ms

    def init(self, handle) -> None:
        self.state = handle.getValueState("versions", STATE, self.ttl_ms) if self.ttl_ms else handle.getValueState("versions", STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        seqs, hashes, lengths, revision, forgot = self.state.get() if self.state.exists() else ([], [], [], 0, False)
        seqs, versions = list(seqs), dict(zip(seqs, zip(hashes, lengths)))

        def row(seq: int, late: bool = False) -> Row:
            at = bisect_left(seqs, seq)
            values = (None, None, None) if late else _compared(versions[seqs[at - 1]] if at else None, versions[seq])
            return Row(page_id=key[0], seq=seq, changed=values[0], change_percentage=values[1], significant_change=values[2], late=late, revision=revision)

        for new in sorted(rows, key=lambda r: r.seq):
            revision += 1
            if forgot and new.seq < seqs[0]:
                yield row(new.seq, late=True)
                continue
            if new.seq not in versions:
                insort(seqs, new.seq)
            versions[new.seq] = new.content_hash, new.content_length
            yield row(new.seq)
            at = bisect_left(seqs, new.seq) + 1
            if at < len(seqs):  # the version after it has another one before it now
                yield row(seqs[at])
            while len(seqs) > self.keep:
                del versions[seqs.pop(0)]
                forgot = True
        self.state.update((seqs, [versions[s][0] for s in seqs], [versions[s][1] for s in seqs], revision, forgot))

    def close(self) -> None:
        pass


def stream_change_detect(stream: DataFrame, changes: str, checkpoint: str, trigger: dict | None = None, keep: int = 32, ttl_hours: float | None = None):
    """Change rows of a stream of pages (page_id, seq, content_text), appended to the folder changes: each version against the one before it in the order of seq.

    The last `keep` versions of each page (hash, length, number) are keyed state of the stream, forgotten ttl_hours after a page's last
    version, if that is given; no table is read or rewritten. A version that arrives out of order is put in its place, and the version after it has a new row with
    a higher revision: current_changes() has the newest row of each, which are those of change_lag over all versions. One that is older than the kept versions of a page
    that had more has `late` and no comparison. A version that arrives again replaces itself; a version whose number is null is left out. A restart from the checkpoint adds nothing twice.
    """
    trigger = trigger or {"availableNow": True}
    if ttl_hours and "processingTime" not in trigger:
        raise ValueError("a time to live needs a trigger by processing time: Spark runs such a stream on without an end")
    rows = stream.where("seq IS NOT NULL").select("page_id", F.col("seq").cast("long").alias("seq"), C.content_hash("content_text").alias("content_hash"), F.length("content_text").cast("long").alias("content_length"))
    schema = CHANGE.format(page=rows.schema["page_id"].dataType.simpleString())
    processor = PageChanges(keep, int(ttl_hours * 3_600_000) if ttl_hours else None)
    found = rows.groupBy("page_id").transformWithState(processor, schema, "append", "processingTime" if ttl_hours else "none")
    with _state_store(stream.sparkSession):
        return found.writeStream.format("parquet").option("path", changes).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def current_changes(rows: DataFrame) -> DataFrame:
    """The newest row of each version of a folder that stream_change_detect writes."""
    values = [c for c in rows.columns if c not in ("page_id", "seq")]
    return rows.groupBy("page_id", "seq").agg(F.max_by(F.struct(*values), "revision").alias("v")).select("page_id", "seq", *[f"v.{c}" for c in values if c != "revision"])


@contextmanager
def _state_store(spark: SparkSession):
    """The state store that transformWithState needs, for the stream that starts inside."""
    key, before = "spark.sql.streaming.stateStore.providerClass", spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def write_closed(out: DataFrame, path: str, checkpoint: str, trigger: dict | None = None):
    """Appends the windows of out that its watermark has closed to a folder, each once; what is closed leaves the state. dropped() tells how many rows came too late."""
    return out.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def dropped(query) -> int:
    """Rows that came after their window was closed, in the batches whose progress the query still has."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in json.loads(p.json)["stateOperators"])


def drained(out: DataFrame, mode: str = "append") -> DataFrame:
    """What a stream gives for all that is there now, as a table in the shared folder."""
    spark = out.sparkSession
    path = folder(spark, "stream")
    if mode == "append":
        query = out.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).start()
    else:

        def last(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(path)

        query = out.writeStream.outputMode(mode).foreachBatch(last).option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(out.schema).parquet(path)

