"""Streams of retrieval and activity logs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import affect


def open_log(spark: SparkSession, path: str, schema, files: int = 100) -> DataFrame:
    """A stream of the Parquet files of a folder, so many files a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def windowed(events: DataFrame, at: str, width: str = "1 day", late: str = "2 hours", by: str = "event_type") -> DataFrame:
    """by, start, n, total of tumbling windows; rows later than the watermark fall out, so that state stays bounded."""
    w = events.withWatermark(at, late).groupBy(F.window(at, width), by)
    return w.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(by, F.col("window.start").alias("start"), "n", "total")


def sessions(events: DataFrame, at: str, gap: str = "30 minutes", late: str = "2 hours", by: str = "user_id") -> DataFrame:
    """by, start, end, n of sessions that end after a gap."""
    w = events.withWatermark(at, late).groupBy(F.session_window(at, gap), by)
    return w.agg(F.count(F.lit(1)).alias("n")).select(by, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


_STATE = "valence double, arousal double, confidence double, stress double, updates long"


def affect_states(events: DataFrame, key: str = "user_id") -> DataFrame:
    """key and state after each batch: the fold of operators.affect, with its four numbers kept as streaming state."""
    kind = events.schema[key].dataType.simpleString()

    def run(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        names = list(affect.BASELINE)
        old = state.get if state.exists else (*affect.BASELINE.values(), 0)
        now, n = dict(zip(names, old[:4])), old[4]
        for e in pd.concat(parts).sort_values(["at", "event_id"])["kind"]:
            now = affect.step(now, e)
            n += 1
        state.update((*now.values(), n))
        yield pd.DataFrame([{key: k[0], **now, "updates": n, "label": affect.label(now)}])

    return events.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, {_STATE}, label string", _STATE, "update", GroupStateTimeout.NoTimeout)


def run_all(stream: DataFrame, path: str, mode: str = "complete") -> DataFrame:
    """Runs a stream over what is there now; each batch becomes the table ``path``/batch=n, and the last one is given back."""
    spark = stream.sparkSession

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/table/batch={n}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").foreachBatch(write).trigger(availableNow=True).start()
    q.awaitTermination()
    out = spark.read.parquet(f"{path}/table")
    if mode == "complete":
        last = out.agg(F.max("batch")).first()[0]
        return out.where(F.col("batch") == last).drop("batch")
    return out
