"""Numbers in a global order, without a task that holds all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .durable import cut

#: What a row's number within its partition takes of monotonically_increasing_id.
_WITHIN = 33


def numbered(df: DataFrame, order: list[Column | str], name: str = "i") -> DataFrame:
    """``df`` with the place of each row, from 0, in an order that no two rows share (else theirs is one of several).

    Rows go to ranges of the order and are sorted there; a row's place is its place in its range and the number of rows
    in the ranges before it. The driver adds up one number for each range.
    """
    parts = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    at = F.monotonically_increasing_id()
    sorted_ = cut(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_range", F.shiftright(at, _WITHIN)).withColumn("_place", at.bitwiseAND(F.lit((1 << _WITHIN) - 1))))
    counts = sorted(sorted_.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: r["_range"])
    starts, total = [], 0
    for r in counts:
        starts.append((r["_range"], total))
        total += r["n"]
    start = df.sparkSession.createDataFrame(starts, "_range long, _start long")
    return sorted_.join(F.broadcast(start), "_range").withColumn(name, F.col("_start") + F.col("_place")).drop("_range", "_place", "_start")
