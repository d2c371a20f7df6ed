"""Writing: append-only logs, versioned tables, experiments. Spark's commit makes each write all or nothing."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import storage


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def upsert(rows: DataFrame, path: str) -> None:
    """Adds rows to the log of a table; ``read_latest`` gives one row for each key."""
    append_log(rows, path)


def read_latest(spark: SparkSession, path: str, key: list[str], order: list[Column]) -> DataFrame:
    return storage.latest(spark.read.parquet(path), key, order)


def compact(spark: SparkSession, path: str, out: str, key: list[str], order: list[Column]) -> None:
    """Writes what ``read_latest`` gives as a new version of a table; the old one stays until nothing reads it."""
    read_latest(spark, path, key, order).write.mode("errorifexists").parquet(out)


def save_experiment(spark: SparkSession, path: str, config: dict, results: DataFrame) -> None:
    """config (one JSON row) and results as JSON and CSV, one row for each system."""
    spark.createDataFrame([(json.dumps(config, sort_keys=True),)], "config string").coalesce(1).write.mode("overwrite").text(f"{path}/config")
    results.coalesce(1).write.mode("overwrite").json(f"{path}/results_json")
    flat = results.select(*[F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in results.dtypes])
    flat.coalesce(1).write.mode("overwrite").csv(f"{path}/results_csv", header=True)


def append_vectors(new: DataFrame, path: str, dims: int) -> None:
    """Adds unit vectors (id, embedding) to an index; raises ValueError where a vector has other than ``dims`` numbers."""
    if new.where(F.size("embedding") != dims).limit(1).count():
        raise ValueError(f"vectors must have {dims} numbers")
    append_log(new, path)


def training_samples(ranked: DataFrame, path: str) -> None:
    """question, context, answer rows as JSON lines."""
    ranked.select("question", "context", "answer").write.mode("overwrite").json(path)
