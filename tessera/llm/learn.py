"""What the text classifiers share: bounded labelled samples, and sparse rows in numpy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize


def remainder(doc_id: Column, of: int) -> Column:
    """crc32 of the id as text, modulo `of`; null stays null."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(of))


def bounded(ids: DataFrame, most: int) -> DataFrame:
    """At most `most` rows of ids (with doc_id, each once), the first in the order of a hash of the id: the same rows on every run."""
    return ids.dropDuplicates(["doc_id"]).where("doc_id IS NOT NULL").orderBy(F.xxhash64(F.lit("sample"), "doc_id"), "doc_id").limit(most)


def sample_texts(docs: DataFrame, ids: DataFrame, most: int) -> DataFrame:
    """Texts of the sample, `most` rows at most: ids (doc_id and label columns) are cut to so many, which makes them fit to be broadcast, and of texts that share an id one counts, by a hash."""
    chosen = materialize(bounded(ids, most), "sample-ids")
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return found.groupBy(*ids.columns).agg(F.min_by("text", F.xxhash64("text")).alias("text"))


class Rows:
    """Sparse rows: value[i] at column[i] of row[i]."""

    def __init__(self, row: np.ndarray, column: np.ndarray, value: np.ndarray, rows: int, columns: int):
        self.row, self.column, self.value, self.rows, self.columns = row, column, value, rows, columns

    def dot(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * weights[self.column], self.rows)

    def transposed_dot(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, self.value * x[self.row], self.columns)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


class Adam:
    """Gradient steps with moment estimates (Kingma & Ba, 2015)."""

    def __init__(self, size: int, rate: float):
        self.rate, self.first, self.second, self.step = rate, np.zeros(size), np.zeros(size), 0

    def move(self, gradient: np.ndarray) -> np.ndarray:
        self.step += 1
        self.first += 0.1 * (gradient - self.first)
        self.second += 0.001 * (gradient**2 - self.second)
        return self.rate * (self.first / (1 - 0.9**self.step)) / (np.sqrt(self.second / (1 - 0.999**self.step)) + 1e-8)
