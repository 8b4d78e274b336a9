"""Toxicity by non-negative positive-unlabelled learning (Kiryo et al., 2017) over hashed words."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import LOWER, WORD, discard, materialize, mix, text_buffers, text_chunks, words
from tessera.llm.learn import Adam, Rows, bounded, remainder, sample_texts, sigmoid

#: Buckets of hashed words and word openings; openings have this many bytes.
BUCKETS, OPENING = 1 << 18, 5
#: Letters, digits and non-ASCII bytes make words here, so that marks at a word's end don't hide it.
LETTERS = WORD & (np.arange(256) >= 0x30) & ~((np.arange(256) > 0x39) & (np.arange(256) < 0x41)) & ~((np.arange(256) > 0x5A) & (np.arange(256) < 0x61)) & ~((np.arange(256) > 0x7A) & (np.arange(256) < 0x80))


def features(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every distinct feature: whole lower-case words, and the openings of longer ones."""
    raw, starts = text_buffers(batch.column("text"))
    low = LOWER[raw]
    whole, first, length, row = words(low, starts, LETTERS)
    long = length > OPENING
    opening = np.zeros(int(long.sum()), np.uint64)
    for j in range(OPENING):
        opening = opening * np.uint64(257) + low[first[long] + j].astype(np.uint64) + np.uint64(1)
    bucket = np.concatenate((whole, mix(opening + np.uint64(1 << 63)))) % np.uint64(BUCKETS)
    return np.concatenate((row, row[long])), bucket.astype(np.int64)


@dataclass
class Model:
    """Weights of the chosen buckets; slot maps a bucket to its weight, or to the last, which is 0."""

    slot: np.ndarray
    weight: np.ndarray
    bias: float

    def scores(self, batch: pa.RecordBatch) -> np.ndarray:
        row, bucket = features(batch)
        slot = self.slot[bucket]
        hit = slot < len(self.weight)
        pair = np.unique(row[hit] * len(self.weight) + slot[hit])
        return sigmoid(self.bias + np.bincount(pair // len(self.weight), self.weight[pair % len(self.weight)], batch.num_rows))


def _sample_counts(sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Documents of the sample that hold each bucket: among the positive, among the unlabelled. Counted by tasks, at most BUCKETS rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, BUCKETS), np.int64)
        for batch in text_chunks(batches):
            row, bucket = features(batch)
            pair = np.unique(row * BUCKETS + bucket)
            positive = batch.column("positive").to_numpy(zero_copy_only=False).astype(np.int64)
            np.add.at(counts, (positive[pair // BUCKETS], pair % BUCKETS), 1)
        found = np.flatnonzero(counts.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(counts[1, found]), pa.array(counts[0, found])], ["bucket", "p", "u"])

    rows = sample.mapInArrow(run, "bucket long, p long, u long").groupBy("bucket").agg(F.sum("p").alias("p"), F.sum("u").alias("u")).toArrow()
    counts = np.zeros((2, BUCKETS), np.int64)
    at = rows.column("bucket").to_numpy()
    counts[0, at], counts[1, at] = rows.column("p").to_numpy(), rows.column("u").to_numpy()
    return counts[0], counts[1]


def fit(positive: Rows, unlabelled: Rows, prior: float, steps: int = 400, rate: float = 0.05, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative PU risk with logistic loss.

    The risk is prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)): the unlabelled texts' loss as negatives, less
    what the positives among them add. Where that estimate of the negatives' risk goes below 0, the step goes
    against it instead, so that the model doesn't fit single unlabelled texts.
    """
    n = positive.columns
    theta = np.zeros(n + 1)
    theta[n] = np.log(max(prior, 1e-6) / max(1 - prior, 1e-6))
    adam = Adam(n + 1, rate)
    for _ in range(steps):
        zp, zu = positive.dot(theta[:n]) + theta[n], unlabelled.dot(theta[:n]) + theta[n]
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        sp, su = sigmoid(zp), sigmoid(zu)
        up, uu = prior * (sp - 1) / positive.rows, np.zeros(unlabelled.rows)
        sign = 1.0 if negative >= 0 else -1.0
        if sign < 0:
            up = np.zeros(positive.rows)
        up = up - sign * prior * sp / positive.rows
        uu = sign * su / unlabelled.rows
        gradient = np.append(positive.transposed_dot(up) + unlabelled.transposed_dot(uu), up.sum() + uu.sum())
        gradient[:n] += decay * theta[:n]
        theta -= adam.move(gradient)
    return theta[:n], float(theta[n])


def train(docs: DataFrame, labels: DataFrame, most_positive: int = 4_096, most_unlabelled: int = 16_384, most_features: int = 4_096, least_z: float = 4.0, least_share: float = 0.005) -> Model | None:
    """A model from confirmed toxic texts and unlabelled ones; None without any toxic one.

    Labels come from rows whose crc32(doc_id) mod 4 is not 2. At most most_positive toxic documents and
    most_unlabelled others are read, in the order of a hash of their ids: bounded samples, whatever the input.
    The class prior is the share of toxic rows among all usable labels. The most_features buckets with the
    largest |z| of their document shares between the samples carry weights, if they are in least_share of either. Equal texts count once.
    """
    usable = labels.where((remainder(F.col("doc_id"), 4) != 2) & F.col("toxic").isNotNull()).select("doc_id", F.col("toxic").cast("int").alias("toxic")).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, toxic = usable.agg(F.count("*"), F.coalesce(F.sum((F.col("toxic") == 1).cast("long")), F.lit(0))).first()
    if not toxic:
        return None
    prior = min(0.95, max(0.001, toxic / n))
    positive = sample_texts(docs, usable.where("toxic = 1").select("doc_id", F.lit(True).alias("positive")), most_positive)
    others = docs.where(remainder(F.col("doc_id"), 4) != 2).select("doc_id", F.lit(False).alias("positive"))
    # copies of a text would pass its rare words off as signs
    sample = positive.unionByName(sample_texts(docs, others, most_unlabelled)).groupBy("positive", F.xxhash64("text").alias("digest")).agg(F.first("text").alias("text"))
    sample = materialize(sample, "toxic-sample")
    p, u = _sample_counts(sample)
    np_, nu = sample.agg(F.count_if("positive"), F.count_if(~F.col("positive"))).first()
    if not np_ or not nu:
        return None
    share = (p + u) / (np_ + nu)
    z = (p / np_ - u / nu) / np.sqrt(np.maximum(share * (1 - share) * (1 / np_ + 1 / nu), 1e-12))
    common = (p >= max(5, least_share * np_)) | (u >= max(5, least_share * nu))
    strong = np.flatnonzero((np.abs(z) >= least_z) & common)
    strong = strong[np.argsort(-np.abs(z[strong]), kind="stable")][:most_features]
    slot = np.full(BUCKETS, len(strong), np.int32)
    slot[strong] = np.arange(len(strong))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches):
            row, bucket = features(batch)
            hit = slot[bucket] < len(strong)
            pair = np.unique(row[hit] * len(strong) + slot[bucket[hit]]) if len(strong) else np.zeros(0, np.int64)
            cut = np.searchsorted(pair, np.arange(batch.num_rows + 1) * max(1, len(strong)))
            slots = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array((pair % max(1, len(strong))).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("positive"), slots], ["positive", "slots"])

    rows = sample.mapInArrow(run, "positive boolean, slots array<int>").toArrow()
    discard(sample)

    def sparse(mask: np.ndarray) -> Rows:
        lists = [x for x, m in zip(rows.column("slots").to_numpy(zero_copy_only=False), mask, strict=True) if m]
        sizes = np.array([len(x) for x in lists], np.int64)
        column = np.concatenate(lists).astype(np.int64) if len(lists) and sizes.sum() else np.zeros(0, np.int64)
        return Rows(np.repeat(np.arange(len(lists)), sizes), column, np.ones(len(column)), len(lists), len(strong))

    flags = rows.column("positive").to_numpy(zero_copy_only=False).astype(bool)
    weight, bias = fit(sparse(flags), sparse(~flags), prior)
    return Model(slot, weight, bias)


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **sample) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs, by a model that train() fits.

    held_out is whether crc32(doc_id) mod 4 is 2 (a null id: false, though it is never learned from). Scores use
    the text alone; a null or empty text has the score of no features. Without a toxic label every score is 0.
    Labels that repeat count once, toxic if any row says so. The model, a fixed number of weights, goes to all tasks.
    """
    model = train(docs, labels, **sample)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches):
            score = np.zeros(batch.num_rows) if model is None else model.scores(batch)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    held = F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
