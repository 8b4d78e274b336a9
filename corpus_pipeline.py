"""The corpus pipeline: each stage works on what the stage before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontaminate, mixing, quality, simhash, suffix
from tessera.llm.common import discard, materialize

#: (name, function of (spark, docs, sf_dir)); all but the last return the columns of documents.
STAGES = [
    ("quality_classifier", quality.stage),
    ("simhash_near_dedup", simhash.stage),
    ("suffix_array_dedup", suffix.stage),
    ("benchmark_decontamination", decontaminate.stage),
    ("mix_sources", mixing.stage),
]

#: Trained weights, fingerprint links and alignments are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written as Parquet in the shared folder and read again, after which the one before is deleted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        kept = materialize(stage(spark, docs, sf_dir), name)
        discard(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
