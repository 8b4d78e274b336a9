"""What the operators of this subpackage share: tables written to the cluster's shared folder, and arrays over Arrow text."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that one numpy pass works on at a time; a longer text comes alone.
CHUNK_BYTES = 2_000_000
#: `[^\x20\x09-\x0D]+`, as a table over byte values.
WORD = np.ones(256, bool)
WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: Byte values with A-Z lower-cased.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0x100000001B3)


def crc32_sql(text: str) -> str:
    """DuckDB SQL for the unsigned crc32 of a text's UTF-8 bytes, by halves of bytes."""
    table = []
    for n in range(16):
        for _ in range(4):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        table.append(n)
    digit = f"instr('0123456789ABCDEF', hex(encode({text}))[i + 2 - 2 * (i % 2)]) - 1"
    return f"xor(list_reduce(list_transform(range(2 * octet_length(encode({text}))), lambda i: {digit}), lambda c, n: xor(c >> 4, {table}[(xor(c, n) & 15) + 1]), 4294967295), 4294967295)"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or without that setting a new temporary one, in local mode (tests) only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        kept = spark.sparkContext._jsc.sc().getCheckpointDir()
        if kept.isDefined():
            found = kept.get()
        elif not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        else:
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
            found = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return found.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """df, computed once and written as a table in the shared folder; later plans read that table, whatever executor is lost."""
    path = f"{shared_dir(df.sparkSession)}/tessera-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes the table behind a materialized frame that no later plan reads."""
    path = getattr(df, "_tessera_path", None)
    if path:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column, end to end, and where each row starts (one more at the end); null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = col.buffers()
    starts = np.frombuffer(offsets, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[starts[0] : starts[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, starts - starts[0]


def text_chunks(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most limit bytes of text each; a longer text is a batch of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, starts = text_buffers(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(starts, starts[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def words(raw: np.ndarray, starts: np.ndarray, table: np.ndarray = WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of the rows: 64-bit hashes of their bytes, first bytes, lengths, and the row of each."""
    inside = table[raw]
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    heads = starts[:-1]
    before[heads[heads < len(raw)]] = False
    first = np.flatnonzero(inside & ~before)
    if not len(first):
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none
    at = np.flatnonzero(inside)
    where = np.searchsorted(at, first)
    length = np.diff(np.append(where, len(at)))
    relative = np.arange(len(at)) - np.repeat(where, length)
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(int(length.max()), _BASE, np.uint64))
        hashed = np.add.reduceat((raw[at].astype(np.uint64) + np.uint64(1)) * powers[relative], where)
        hashed = mix(hashed)
    return hashed, first, length, np.searchsorted(starts, first, "right") - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * _MULTIPLIER
        x = (x ^ (x >> np.uint64(29))) * _MULTIPLIER
        return x ^ (x >> np.uint64(32))


def whole_groups(batches: Iterable[pa.RecordBatch], key: str, least: int = 20_000) -> Iterator[pa.Table]:
    """Batches sorted by key, joined and cut anew so that no key is in two tables; least: rows to gather before a cut."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < least:
            continue
        table = pa.Table.from_batches(held)
        keys = table.column(key).to_numpy()
        cut = int(np.searchsorted(keys == keys[-1], True)) if keys[0] != keys[-1] else 0
        if cut:
            yield table.slice(0, cut)
            table = table.slice(cut)
        held, rows = table.to_batches(), table.num_rows
        least = max(least, 2 * rows) if not cut else least
    if rows:
        yield pa.Table.from_batches(held)
