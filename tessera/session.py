"""Session defaults that every entry point shares."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

AS_OF = "2024-01-31 00:00:00"


def local_session(cores: int | None = None, memory: str = "8g") -> SparkSession:
    """A local session with the settings that the library is tested with."""
    cores = cores or os.cpu_count() or 8
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tessera")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, by Spark's own reader so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
