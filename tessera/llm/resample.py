"""Importance resampling towards a target: hashed-feature weights, and the exact best draw by a bracket around its cutoff."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import LOWER, crc32_sql, discard, materialize, text_buffers, text_chunks, words

#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` over lower-cased bytes: digits, letters and all that isn't ASCII.
LETTERS = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])
#: Bytes of a feature up to which checksums are made for all features at once.
SHORT = 64
ORDER = ("score", "doc_id", "weight", "n_features")


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, np.uint32(0xEDB88320), np.uint32(0)) ^ (table >> np.uint32(1))
    return table


CRC = _crc_table()


def crc32(raw: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Unsigned crc32 of raw[first : first + length], for all ranges at once."""
    order = np.argsort(-length, kind="stable")
    at, size = first[order], length[order]
    state = np.full(len(at), 0xFFFFFFFF, np.uint32)
    short = int(np.searchsorted(-size, -SHORT, "left"))  # the longer ones come first
    for j in range(int(size[short]) if short < len(size) else 0):
        upto = int(np.searchsorted(-size, -j, "left"))
        s = state[short:upto]
        state[short:upto] = CRC[(s ^ raw[at[short:upto] + j]) & np.uint32(255)] ^ (s >> np.uint32(8))
    state ^= np.uint32(0xFFFFFFFF)
    for i in range(short):
        state[i] = zlib.crc32(raw[at[i] : at[i] + size[i]])
    out = np.empty_like(state)
    out[order] = state
    return out


def features(batch: pa.RecordBatch, buckets: int, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The row and bucket of every run of 1 to `longest` words, repeats included, and the words of each row."""
    raw, starts = text_buffers(batch.column("text"))
    low = LOWER[raw]
    _, first, length, row = words(low, starts, LETTERS)
    n_words = np.bincount(row, minlength=batch.num_rows)
    if longest > 1 and len(first):  # the words once more, with one space between them
        size = length + 1
        to = np.cumsum(size) - size
        relative = np.arange(int(size.sum())) - np.repeat(to, size)
        spaced = np.append(low, np.uint8(0x20))[np.where(relative < np.repeat(length, size), np.repeat(first, size) + relative, len(low))]
        low, first = spaced, to
    rows, found = [row], [crc32(low, first, length) % np.uint32(buckets)]
    for k in range(2, longest + 1):
        begins = np.flatnonzero(row[: len(row) - k + 1] == row[k - 1 :]) if len(row) >= k else np.zeros(0, np.int64)
        ends = begins + k - 1
        rows.append(row[begins])
        found.append(crc32(low, first[begins], first[ends] + length[ends] - first[begins]) % np.uint32(buckets))
    return np.concatenate(rows), np.concatenate(found).astype(np.int64), n_words


def bucket_counts(texts: DataFrame, buckets: int, longest: int) -> np.ndarray:
    """Features of all texts by bucket. A task adds up its texts, so it hands on one row a bucket."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for batch in text_chunks(batches):
            counts += np.bincount(features(batch, buckets, longest)[1], minlength=buckets)
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(counts[held])], ["bucket", "n"])

    rows = texts.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(buckets, np.int64)
    counts[rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    return counts


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A bucket's log ratio of the target's share to the source's, one added to every bucket, in thousandths, floored."""
    n = float(len(source))
    return np.floor(1000 * np.log((target + 1.0) * (source.sum() + n) / ((source + 1.0) * (target.sum() + n)))).astype(np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, longest: int) -> DataFrame:
    """doc_id, n_features, n_words and weight (the sum of its features' gains) of every row of docs. gain, one number a bucket, goes to all tasks."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches):
            row, bucket, n_words = features(batch, len(gain), longest)
            order = np.argsort(row, kind="stable")
            total = np.concatenate(([0], np.cumsum(gain[bucket[order]])))  # whole numbers, so no order of summing shows
            cut = np.searchsorted(row[order], np.arange(batch.num_rows + 1))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(cut)), pa.array(n_words), pa.array(np.diff(total[cut]))], ["doc_id", "n_features", "n_words", "weight"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_features long, n_words long, weight long")


def noise(doc_id: Column, seed: str) -> Column:
    """Gumbel noise in thousandths, floored, from the first 8 hex digits of sha256(seed:doc_id)."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8)
    share = (F.conv(digits, 16, 10).cast("double") + 0.5) / 4294967296
    return F.floor(-1000 * F.log(-F.log(share)))


def _ordered() -> list[Column]:
    return [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("weight").asc(), F.col("n_features").asc()]


def _upto(row) -> Column:
    """Whether a row comes no later than row in the order of _ordered; rows that are alike in all of it both do."""
    out = F.col("n_features") <= row.n_features
    out = (F.col("weight") < row.weight) | ((F.col("weight") == row.weight) & out)
    same = F.col("doc_id").isNull() if row.doc_id is None else F.coalesce(F.col("doc_id") == row.doc_id, F.lit(False))
    before = F.col("doc_id").isNotNull() if row.doc_id is None else F.coalesce(F.col("doc_id") < row.doc_id, F.lit(False))
    return (F.col("score") > row.score) | ((F.col("score") == row.score) & (before | (same & out)))


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """rows with position: 1, 2, 3... in the order of _ordered, by sorted ranges of rows and the number of rows before each.

    The driver sees one number a range, so no task and no window holds all rows.
    """
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    table = materialize(rows.repartitionByRange(*_ordered()).sortWithinPartitions(*_ordered()).withColumn("range", F.spark_partition_id()).withColumn("at", at), name)
    before, offsets = 0, []
    for r in sorted(table.groupBy("range").count().collect()):
        offsets.append((r["range"], before))
        before += r["count"]
    starts = rows.sparkSession.createDataFrame(offsets, "range int, before long")
    out = table.join(F.broadcast(starts), "range").withColumn("position", F.col("before") + F.col("at") + 1).drop("range", "at", "before")
    out._tessera_path = table._tessera_path
    return out


def cutoff(eligible: DataFrame, draw: int, share: float, accuracy: int, name: str = "bracket"):
    """The row that is number `draw` of eligible in the order of _ordered, found by sorting only a bracket of scores.

    A quantile sketch gives two scores around the wanted share. Rows above and inside the bracket are then counted
    exactly: if the row isn't inside, the bracket is widened fourfold and counted again, at last to all scores. A score that many rows share is inside as a whole.
    """
    width = 2.0 / accuracy
    while True:
        low, high = 1 - share - width, 1 - share + width
        wanted = [F.lit(q) for q in (low, high) if 0 < q < 1]
        found = eligible.agg(F.percentile_approx("score", F.array(*wanted), accuracy).alias("q")).first().q if wanted else []
        least = found[0] if low > 0 else None
        most = found[-1] if high < 1 else None
        above = F.col("score") > most if most is not None else F.lit(False)
        inside = (~above & (F.col("score") >= least)) if least is not None else ~above
        n_above, n_inside = eligible.agg(F.count_if(above), F.count_if(inside)).first()
        if n_above < draw <= n_above + n_inside:
            break
        width *= 4
    bracket = numbered(eligible.where(inside).select(*ORDER), name)
    row = bracket.where(F.col("position") == draw - n_above).first()
    discard(bracket)
    return row


def resample(docs: DataFrame, target: DataFrame, buckets: int = 10_000, longest: int = 1, seed: str = "2024", least_words: int = 20, percent: int = 10, accuracy: int = 10_000) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row of docs (doc_id, text), drawn towards the texts of target (text).

    Features are runs of 1 to `longest` lower-case words, hashed to buckets; a document's weight sums their gains,
    and its score adds noise that the seed and its id fix, which makes the best scores a draw without replacement
    by weight. Of the documents with least_words words or more, floor(percent * N / 100) best scores have a rank; ties go to
    the smaller id, a null id last, then to the smaller weight and fewer features, after which rows are alike.
    A null or empty text has no features and weight 0; a null id has the noise of an empty one; rows that repeat are documents each;
    an empty target makes all gains those of an even spread. Other columns are left out. buckets numbers go to the driver and to all tasks.
    """
    gain = gains(bucket_counts(docs, buckets, longest), bucket_counts(target, buckets, longest))
    scored = materialize(weigh(docs, gain, longest).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "weighed")
    enough = F.col("n_words") >= least_words
    eligible = scored.where(enough)
    draw = percent * eligible.count() // 100
    rank = F.lit(None).cast("long").alias("rank")
    if not draw:
        return scored.select("doc_id", "n_features", "weight", "score", rank)
    drawn = enough & _upto(cutoff(eligible, draw, percent / 100, accuracy))
    best = numbered(scored.where(drawn).select(*ORDER), "drawn")
    best = best.select("doc_id", "n_features", "weight", "score", F.when(F.col("position") <= draw, F.col("position")).alias("rank"))
    return scored.where(~drawn).select("doc_id", "n_features", "weight", "score", rank).unionByName(best)


ORACLE_SQL = f"""
WITH tokens AS (
    SELECT t, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS w
    FROM (SELECT 0 AS t, doc_id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark)
),
buckets AS (SELECT w, {crc32_sql("w")} % 10000 AS b FROM (SELECT DISTINCT w FROM tokens)),
counts AS (SELECT b, count(*) FILTER (t = 0)::DOUBLE AS s, count(*) FILTER (t = 1)::DOUBLE AS t FROM tokens JOIN buckets USING (w) GROUP BY b),
sums AS (SELECT sum(s) AS s, sum(t) AS t FROM counts),
gains AS (SELECT b, floor(1000 * ln((c.t + 1) * (sums.s + 10000) / ((c.s + 1) * (sums.t + 10000))))::BIGINT AS gain FROM counts c, sums),
weights AS (SELECT doc_id, count(*) AS n, sum(gain)::BIGINT AS weight FROM tokens JOIN buckets USING (w) JOIN gains USING (b) WHERE t = 0 GROUP BY doc_id),
scored AS (
    SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
        coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5) / 4294967296)))::BIGINT AS score
    FROM documents LEFT JOIN weights USING (doc_id)
),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS nth, count(*) OVER () * 10 // 100 AS draw FROM scored WHERE n_features >= 20)
SELECT s.doc_id, n_features, weight, score, CASE WHEN nth <= draw THEN nth END AS rank FROM scored s LEFT JOIN ranked USING (doc_id)
"""
