"""Packing (operator 5): optimal length buckets and token-budget batches.

The global histogram of lengths is counted over all rows; dynamic programming over it chooses the bucket boundaries with
the least padding, exactly. The program's inner minimum runs over lines (a boundary's cost is a line in the next
boundary's length), kept as a lower envelope, so it takes time in proportion to buckets and different lengths. The driver
gets one row for each different length and nothing else: d of them need at least d * d / 2 tokens, so their number grows
at most with the root of the corpus. Inside a bucket, documents in hash order fill batches of ``budget // boundary``
documents, at least one.

A length is the number of words by default, the tokens that the other operators here count; any column will do, as the
``n_tokens`` of a token store's manifest.

Null and empty texts have length 0 and go to the first bucket. Repeated rows are packed as separate documents. An empty
table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Scratch, running_start, table, word_count

BUCKETS, BUDGET = 12, 16_384


def _layer(cost: list[int | None], upper: list[int], total: list[int]) -> tuple[list[int | None], list[int]]:
    """Least costs with one more bucket, for the first j lengths of each j, and where that bucket begins.

    A bucket over lengths i to j - 1 costs upper[j - 1] * (total[j] - total[i]), so a beginning i is a line in
    upper[j - 1] with slope -total[i]. Slopes fall and places rise, so the lines that are ever least form a queue.
    """
    n = len(upper)
    out: list[int | None] = [None] * (n + 1)
    back, queue, front = [0] * (n + 1), [], 0
    for j in range(1, n + 1):
        if (c := cost[j - 1]) is not None:
            slope = -total[j - 1]
            # a line that its neighbours undercut everywhere goes
            while len(queue) - front >= 2 and (c - queue[-2][1]) * (queue[-2][0] - queue[-1][0]) <= (queue[-1][1] - queue[-2][1]) * (queue[-2][0] - slope):
                queue.pop()
            queue.append((slope, c, j - 1))
        x = upper[j - 1]
        while len(queue) - front >= 2 and queue[front + 1][0] * x + queue[front + 1][1] <= queue[front][0] * x + queue[front][1]:
            front += 1
        if front < len(queue):
            slope, c, i = queue[front]
            out[j], back[j] = slope * x + c + x * total[j], i
    return out, back


def boundaries(upper: np.ndarray, count: np.ndarray, buckets: int = BUCKETS) -> list[int]:
    """The at most ``buckets`` of ``upper`` (rising lengths) that pad ``count`` documents of them least, the last one included."""
    n = len(upper)
    if not n:
        return []
    ends, total = [int(x) for x in upper], [0, *np.cumsum(count, dtype=object).tolist()]
    # whole numbers throughout; a cost is the padded length, and padding differs from it by the sum of all lengths, a constant
    cost: list[int | None] = [0] + [None] * n
    best, backs = None, []
    for b in range(min(buckets, n)):
        cost, back = _layer(cost, ends, total)
        backs.append(np.array(back, np.int32))
        if cost[n] is not None and (best is None or cost[n] < best[0]):
            best = (cost[n], b)
    j, b, out = n, best[1], []
    while j > 0:
        out.append(ends[j - 1])
        j, b = int(backs[b][j]), b - 1
    return out[::-1]


def pack(docs: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET, length: Column | None = None) -> DataFrame:
    """doc_id, length, bucket, bucket_length, batch_id, slot, padding for each row of ``docs`` (doc_id, text); length: tokens, else words."""
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark, "pack")
    text = F.col("text").cast("string")
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (word_count(text) if length is None else length.cast("long")).alias("length"), F.shiftrightunsigned(F.xxhash64(F.lit(5), "doc_id", text), 2).alias("h"))
    sized = scratch.keep(sized, "sized")
    histogram = sized.groupBy("length").agg(F.count(F.lit(1)).alias("n")).toArrow()
    upper, count = (np.array(histogram.column(c)) for c in ("length", "n"))
    order = np.argsort(upper)
    ends = boundaries(upper[order], count[order], buckets)
    bucket, width = F.lit(None).cast("int"), F.lit(None).cast("long")
    for i, end in reversed(list(enumerate(ends))):
        bucket = F.when(F.col("length") <= end, F.lit(i)).otherwise(bucket)
        width = F.when(F.col("length") <= end, F.lit(end).cast("long")).otherwise(width)
    rows = int(count.sum())
    placed = sized.select("doc_id", "length", "h", bucket.alias("bucket"), width.alias("bucket_length"), F.lit(1).alias("one"))
    spread = max(256, 1 << math.ceil(math.log2(max(1, rows / 100_000))))
    placed = running_start(placed, ["bucket", "bucket_length"], ["h", "doc_id", "length"], "one", "at", scratch, spread)
    each = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.col("bucket_length"), F.lit(1))))
    batch = F.floor(F.col("at") / each)
    out = placed.select("doc_id", "length", "bucket", "bucket_length", (F.shiftleft(F.col("bucket").cast("long"), 40) + batch).alias("batch_id"), F.pmod(F.col("at"), each).alias("slot"), (F.col("bucket_length") - F.col("length")).alias("padding"))
    out = scratch.keep(out, "packed")
    scratch.drop(sized)
    return out


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"))
