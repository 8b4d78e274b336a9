"""Quality by ordinal cumulative-link regression: shared weights of hashed words and character classes, and ordered thresholds."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import LOWER, discard, materialize, mix, text_buffers, text_chunks, words
from tessera.llm.learn import Adam, Rows, remainder, sample_texts, sigmoid

#: Buckets of hashed words (lower case), and of n-grams of character classes, with the lengths of the latter.
BUCKETS, GRAMS = 1 << 14, (2, 4)
#: Steps of the share of words that repeat the word before them, and of distinct words, each a feature of its own.
STEPS = 16
PARTS = len(GRAMS) + 1
COLUMNS = BUCKETS * PARTS + 2 * STEPS


def _classes() -> np.ndarray:
    """Classes of byte values: white space, lower, upper, digit, non-ASCII (as lower), and each mark its own."""
    table = np.arange(256, dtype=np.uint64) + 16
    table[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0
    table[97:123] = 1
    table[128:] = 1
    table[65:91] = 2
    table[48:58] = 3
    return table


CLASSES = _classes()


def features(batch: pa.RecordBatch) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, column, value) parts: shares of the class n-grams and words of a text, and a constant for the step of each share of words."""
    raw, starts = text_buffers(batch.column("text"))
    n = batch.num_rows
    size = np.diff(starts)
    kind = CLASSES[raw]
    row = np.repeat(np.arange(n), size)
    parts = []
    for g, width in enumerate(GRAMS):
        code = np.zeros(max(0, len(kind) - width + 1), np.uint64)
        for j in range(width):
            code = code * np.uint64(272) + kind[j : len(kind) - width + 1 + j]
        own = row[: len(code)]
        inside = own == row[width - 1 :] if len(code) else np.zeros(0, bool)
        bucket = (mix(code[inside] + np.uint64(width << 60)) % np.uint64(BUCKETS)).astype(np.int64)
        at = own[inside]
        parts.append((at, bucket + g * BUCKETS, 1.0 / np.maximum(size[at] - width + 1, 1)))
    hashed, _, _, of = words(LOWER[raw], starts)
    count = np.bincount(of, minlength=n)
    parts.append((of, (hashed % np.uint64(BUCKETS)).astype(np.int64) + len(GRAMS) * BUCKETS, 1.0 / count[of]))
    again = np.bincount(of[1:][(hashed[1:] == hashed[:-1]) & (of[1:] == of[:-1])], minlength=n) if len(hashed) else np.zeros(n)
    order = np.lexsort((hashed, of))
    fresh = np.ones(len(hashed), bool)
    fresh[1:] = (hashed[order][1:] != hashed[order][:-1]) | (of[order][1:] != of[order][:-1])
    distinct = np.bincount(of[order][fresh], minlength=n)
    for k, share in enumerate((again / np.maximum(count, 1), distinct / np.maximum(count, 1))):
        step = np.minimum((share * STEPS).astype(np.int64), STEPS - 1)
        parts.append((np.arange(n), BUCKETS * PARTS + k * STEPS + step, np.full(n, 0.2)))
    return parts


@dataclass
class Model:
    """P(grade > k) = sigmoid(weights . x - thresholds[k]); thresholds rise."""

    grades: list[float]
    weight: np.ndarray
    thresholds: np.ndarray

    def tails(self, batch: pa.RecordBatch) -> np.ndarray:
        """Of each row: P(grade > grades[k]) for all but the last k."""
        z = np.zeros(batch.num_rows)
        for row, column, value in features(batch):
            z += np.bincount(row, value * self.weight[column], batch.num_rows)
        return sigmoid(z[:, None] - self.thresholds[None, :])


def fit(x: Rows, grade: np.ndarray, levels: int, steps: int = 200, rate: float = 0.3, decay: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds of greatest likelihood of grades 0..levels-1.

    Thresholds are a first one plus exponentials of free steps, so they stay in order. With tails t_k = P(y > k),
    a grade's probability is t_{k-1} - t_k, and d log(t_{k-1} - t_k) has a closed form in the two logits.
    """
    share = np.array([max((grade > k).mean(), 1e-3) for k in range(levels - 1)])
    cut = -np.log(np.minimum(share, 1 - 1e-3) / (1 - np.minimum(share, 1 - 1e-3)))
    free = np.concatenate((cut[:1], np.log(np.maximum(np.diff(cut), 1e-2))))
    theta = np.concatenate((np.zeros(x.columns), free))
    adam = Adam(len(theta), rate)
    n, rows = x.columns, np.arange(x.rows)
    for _ in range(steps):
        z = x.dot(theta[:n])
        gaps = np.exp(theta[n + 1 :])
        cuts = theta[n] + np.concatenate(([0.0], np.cumsum(gaps)))
        tail = np.concatenate((np.ones((x.rows, 1)), sigmoid(z[:, None] - cuts[None, :]), np.zeros((x.rows, 1))), axis=1)
        p = np.maximum(tail[rows, grade] - tail[rows, grade + 1], 1e-9)
        slope = tail * (1 - tail)
        above, below = slope[rows, grade] / p, slope[rows, grade + 1] / p
        dz = -(above - below) / x.rows
        dcut = np.zeros(levels + 1)
        np.add.at(dcut, grade, above / x.rows)
        np.add.at(dcut, grade + 1, -below / x.rows)
        dcut = dcut[1:levels]
        gradient = np.concatenate((x.transposed_dot(dz) + decay * theta[:n], [dcut.sum()], [dcut[k + 1 :].sum() * gaps[k] for k in range(levels - 2)]))
        theta -= adam.move(gradient)
    return theta[:n], theta[n] + np.concatenate(([0.0], np.cumsum(np.exp(theta[n + 1 :]))))


def train(docs: DataFrame, labels: DataFrame, rating: str = "quality", most_rows: int = 8_192) -> Model | None:
    """A model of the rating column of labels; None if it has fewer than two grades.

    At most most_rows rated documents are read, in the order of a hash of their ids: a bounded sample. Documents
    whose crc32(doc_id) mod 4 is 2 stay out, for a held-out measure. A document that is rated twice counts with its lowest grade.
    """
    rated = labels.where(F.col(rating).isNotNull() & (remainder(F.col("doc_id"), 4) != 2)).groupBy("doc_id").agg(F.min(F.col(rating).cast("double")).alias("grade"))
    sample = materialize(sample_texts(docs, rated, most_rows), "rated")
    grades = sorted(r[0] for r in sample.select("grade").distinct().collect())  # no more than the sample has rows
    if len(grades) < 2:
        discard(sample)
        return None

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches):
            row, column, value = (np.concatenate(v) for v in zip(*features(batch), strict=True))
            pair, at = np.unique(row * COLUMNS + column, return_inverse=True)
            value = np.bincount(at, value, len(pair))
            cut = pa.array(np.searchsorted(pair, np.arange(batch.num_rows + 1) * COLUMNS).astype(np.int32))
            columns = pa.ListArray.from_arrays(cut, pa.array((pair % COLUMNS).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("grade"), columns, pa.ListArray.from_arrays(cut, pa.array(value.astype(np.float32)))], ["grade", "columns", "values"])

    rows = sample.mapInArrow(run, "grade double, columns array<int>, values array<float>").toArrow()
    discard(sample)
    grade = np.searchsorted(grades, rows.column("grade").to_numpy())
    columns, values = (rows.column(c).combine_chunks() for c in ("columns", "values"))
    del rows  # the driver holds each array once
    sizes = np.diff(columns.offsets.to_numpy())
    x = Rows(np.repeat(np.arange(len(sizes)), sizes), columns.flatten().to_numpy().astype(np.int64), values.flatten().to_numpy(), len(sizes), COLUMNS)
    del columns
    weight, thresholds = fit(x, grade, len(grades))
    return Model(grades, weight, thresholds)


def _judge(model: Model | None, text: pa.Array, keep_from: float) -> tuple[pa.Array, np.ndarray]:
    """Expected grade and P(grade >= keep_from) of each text; without a model null and 1."""
    n = len(text)
    if model is None:
        return pa.nulls(n, pa.float64()), np.ones(n)
    tails = model.tails(pa.RecordBatch.from_arrays([text], ["text"]))
    grades = np.array(model.grades, float)
    at = int(np.searchsorted(grades, keep_from))
    tail = np.ones(n) if at == 0 else np.zeros(n) if at == len(grades) else tails[:, at - 1]
    return pa.array(grades[0] + tails @ np.diff(grades)), tail


def score_quality(docs: DataFrame, labels: DataFrame, rating: str = "quality", keep_from: float = 1, least: float = 0.5, **sample) -> DataFrame:
    """doc_id, held_out, expected_grade, tail (P(grade >= keep_from)) and kept (tail >= least) of every row of docs.

    A null or empty text has the features of no words. Without two grades to learn from, nothing is rejected:
    expected_grade is null, tail 1. Repeated rows are scored each for itself. Of texts that share a rated id one is learned from.
    """
    model = train(docs, labels, rating, **sample)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches):
            grade, tail = _judge(model, batch.column("text"), keep_from)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), grade, pa.array(tail), pa.array(tail >= least)], ["doc_id", "held_out", "expected_grade", "tail", "kept"])

    held = F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, expected_grade double, tail double, kept boolean")


def keep_good(docs: DataFrame, labels: DataFrame, rating: str = "quality", keep_from: float = 1, least: float = 0.5, **sample) -> DataFrame:
    """The rows of docs that score_quality keeps, as they are, whatever their columns are named."""
    model, names = train(docs, labels, rating, **sample), docs.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches):
            _, tail = _judge(model, batch.column("text"), keep_from)
            yield batch.select(names).filter(pa.array(tail >= least))

    return docs.mapInArrow(run, docs.schema)


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents whose probability of a good grade is under one half go. Each row is judged by its own text, null and empty ones as texts without words; repeated rows go or stay together; no rows give no rows."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
