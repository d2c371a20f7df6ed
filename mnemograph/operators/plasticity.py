"""How use changes edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOWEST, HIGHEST = 0.05, 2.0


def bounded(weight: Column) -> Column:
    """A weight within its bounds, four places; what is no number is 1."""
    w = F.when(weight.isNull() | F.isnan(weight), F.lit(1.0)).otherwise(weight)
    return F.round(F.least(F.lit(HIGHEST), F.greatest(F.lit(LOWEST), w)), 4)


def _trust(confidence: Column) -> Column:
    return 1.0 + 0.5 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), confidence))


def reinforce(pairs: DataFrame, paths: DataFrame, rate: float = 0.10, decay: float = 0.02) -> DataFrame:
    """a, b, weight, new_weight, touched: pairs on a path (array column ``path``) gain, all others fade a little.

    How much they fade falls with the root of the number of touched pairs; without touched pairs nothing changes.
    """
    steps = paths.select(F.explode(F.arrays_zip(F.slice("path", 1, F.greatest(F.size("path") - 1, F.lit(0))).alias("x"), F.slice("path", 2, F.size("path")).alias("y"))).alias("s"))
    used = steps.select(F.least("s.x", "s.y").alias("a"), F.greatest("s.x", "s.y").alias("b")).where("a <> b").distinct().withColumn("touched", F.lit(True))
    marked = pairs.join(used, ["a", "b"], "left").withColumn("touched", F.coalesce("touched", F.lit(False)))
    n = marked.agg(F.count_if("touched").alias("n"))
    up = bounded(F.col("weight") + rate * _trust(F.col("confidence")))
    down = F.when(F.col("n") > 0, bounded(F.col("weight") * (1 - decay / F.sqrt(F.col("n"))))).otherwise(F.col("weight"))
    return marked.crossJoin(F.broadcast(n)).select("a", "b", "weight", F.when(F.col("touched"), up).otherwise(down).alias("new_weight"), "touched")


def timing_pairs(edges: DataFrame, spikes: DataFrame, window: int) -> DataFrame:
    """source_id, target_id, ltp, ltd: the earliest pair of spikes from source to target and back, ``window`` ticks apart at most.

    spikes: id, tick, seq (order in the trace). Spikes are joined by tick bucket of the window's width, the bucket and the
    next, so that the range join is an equi-join; within a tick the order of the trace decides.
    """
    width = max(1, window)
    bucket = F.floor(F.col("tick") / width)

    def earliest(first: str, second: str, name: str) -> DataFrame:
        a = edges.select("source_id", "target_id").join(spikes.select(F.col("id").alias(first), F.col("tick").alias("t1"), F.col("seq").alias("s1")), first)
        a = a.withColumn("bucket", F.explode(F.array(F.floor(F.col("t1") / width), F.floor(F.col("t1") / width) + 1)))
        b = spikes.select(F.col("id").alias(second), F.col("tick").alias("t2"), F.col("seq").alias("s2"), bucket.alias("bucket"))
        near = a.join(b, [second, "bucket"]).where((F.col("t2") >= F.col("t1")) & (F.col("t2") <= F.col("t1") + window) & ((F.col("t2") > F.col("t1")) | (F.col("s2") > F.col("s1"))))
        return near.groupBy("source_id", "target_id").agg(F.min(F.struct("t1", "s1", "t2", "s2")).alias(name))

    return earliest("source_id", "target_id", "ltp").join(earliest("target_id", "source_id", "ltd"), ["source_id", "target_id"], "full")


def spike_timing(edges: DataFrame, spikes: DataFrame, window: int = 1, rate: float = 0.06, depression: float = 0.04, decay: float = 0.0) -> DataFrame:
    """source_id, target_id, weight, new_weight, change: edges whose source fired first gain, the others lose.

    With ``decay``, edges without any active end fade, if some edge had a pair in time.
    """
    timed = timing_pairs(edges, spikes, window)
    active = spikes.select("id").distinct()
    e = edges.select("source_id", "target_id", "weight", "confidence").join(timed, ["source_id", "target_id"], "left")
    e = e.join(active.select(F.col("id").alias("source_id"), F.lit(True).alias("sa")), "source_id", "left").join(active.select(F.col("id").alias("target_id"), F.lit(True).alias("ta")), "target_id", "left")
    up = F.col("ltp").isNotNull() & (F.col("ltd").isNull() | (F.struct("ltp.t1", "ltp.s1") <= F.struct("ltd.t1", "ltd.s1")))
    idle = F.col("sa").isNull() & F.col("ta").isNull()
    n = e.agg(F.count_if(F.col("ltp").isNotNull() | F.col("ltd").isNotNull()).alias("n"))
    new = (
        F.when(up, bounded(F.col("weight") + rate * _trust(F.col("confidence")))).when(F.col("ltd").isNotNull(), bounded(F.col("weight") - depression * _trust(F.col("confidence"))))
        .when(idle & (F.col("n") > 0) & F.lit(decay > 0), bounded(F.col("weight") * (1 - decay / F.sqrt(F.col("n"))))).otherwise(bounded(F.col("weight")))
    )
    kind = F.when(up, "ltp").when(F.col("ltd").isNotNull(), "ltd").otherwise("none")
    return e.crossJoin(F.broadcast(n)).select("source_id", "target_id", "weight", new.alias("new_weight"), kind.alias("change"))


def set_weights(edges: DataFrame, new: DataFrame) -> DataFrame:
    """``edges`` with the weights of ``new`` (a, b, weight) on every record between a and b, in either direction; others stay."""
    u = new.select(F.col("a").alias("_a"), F.col("b").alias("_b"), F.col("weight").alias("_w"))
    hit = (F.least("source_id", "target_id") == F.least("_a", "_b")) & (F.greatest("source_id", "target_id") == F.greatest("_a", "_b"))
    return edges.join(u, hit, "left").withColumn("weight", F.coalesce("_w", "weight")).drop("_a", "_b", "_w")
