"""Spreading activation over a symmetric graph (src, dst, weight), for batches of queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numeric as N
from .durable import cut

HOPS, DECAY, SEED_WEIGHT, WORTH_WEIGHT, FLOOR = 2, 0.5, 1.0, 0.3, 1e-4


def shares(sym: DataFrame, scale: float = 1.0) -> DataFrame:
    """src, dst, share: what part of its input each node takes from each neighbour; a node's parts add up to 1."""
    w = F.greatest(F.lit(0.01), F.col("weight")) * scale
    e = sym.select("src", "dst", w.alias("w"))
    return e.withColumn("share", F.col("w") / F.sum("w").over(Window.partitionBy("dst"))).drop("w")


def continuous(seeds: DataFrame, nodes: DataFrame | None, sym: DataFrame, hops: int = HOPS, decay: float = DECAY, semantic: float = SEED_WEIGHT, worth: float = WORTH_WEIGHT) -> DataFrame:
    """query_id, id, activation above ``FLOOR``; seeds: query_id, id, seed_score, and importance if ``nodes`` is None.

    In each hop a node takes the larger of its own value times ``decay`` and the mean of its neighbours times the rest.
    """
    known = seeds if nodes is None else seeds.join(nodes.select("id", "importance"), "id")
    a = known.select("query_id", "id", (semantic * F.col("seed_score") + worth * F.col("importance")).alias("activation"))
    a = a.groupBy("query_id", "id").agg(F.max("activation").alias("activation"))
    part = shares(sym)
    for _ in range(hops):
        into = a.join(part.withColumnRenamed("src", "id"), "id").groupBy("query_id", F.col("dst").alias("id")).agg((F.sum(F.col("share") * F.col("activation")) * (1 - decay)).alias("new"))
        own = a.select("query_id", "id", (F.col("activation") * decay).alias("new"))
        a = own.unionByName(into).groupBy("query_id", "id").agg(F.max("new").alias("activation"))
    return a.where(F.col("activation") > FLOOR).withColumn("activation", N.rounded(N.clip(F.col("activation")), 6))


TICKS, LEAK, THRESHOLD, RESET, REFRACTORY, TOP_K = 3, 0.5, 0.8, 0.0, 1, 4


def capped(sym: DataFrame, k: int = TOP_K) -> DataFrame:
    """src, dst, w: each node's k heaviest neighbours, weights within (0, 1]."""
    w = sym.select("src", "dst", N.clip(F.col("weight")).alias("w")).where("w > 0")
    return w.withColumn("r", F.row_number().over(Window.partitionBy("src").orderBy(F.col("w").desc(), "dst"))).where(F.col("r") <= k).drop("r")


def spiking(seeds: DataFrame, nodes: DataFrame, sym: DataFrame, ticks: int = TICKS, leak: float = LEAK, threshold: float = THRESHOLD, reset: float = RESET, refractory: int = REFRACTORY, k: int = TOP_K) -> tuple[DataFrame, DataFrame]:
    """Leaky integrate-and-fire runs: (query_id, id, peak) of nodes that fired, and the trace of all events.

    trace: query_id, tick, id, before, after, spike. A node at rest after firing loses what comes in; what a node receives
    in a tick is at most 1. States are cut from their history after each tick.
    """
    near = capped(sym, k)
    cur = N.clip(SEED_WEIGHT * N.clip(F.col("seed_score")) + WORTH_WEIGHT * N.clip(F.col("importance")))
    state = seeds.join(nodes.select("id", "importance"), "id").groupBy("query_id", "id").agg(F.max(cur).alias("cur")).where("cur > 0")
    state = state.select("query_id", "id", F.lit(0.0).alias("v"), F.lit(0).alias("rest"), "cur", F.lit(0.0).alias("peak"))
    trace = None
    for tick in range(min(ticks, 32)):
        i = N.clip(F.col("v") * (1 - leak) + F.col("cur"))
        fire = (F.col("rest") == 0) & (i > 0) & (i >= threshold)
        now = state.withColumns({"i": i, "spike": fire})
        after = F.when(F.col("rest") > 0, F.lit(reset)).when(F.col("spike"), F.lit(reset)).otherwise(F.col("i"))
        now = cut(now.withColumns({"after": after, "left": F.when(F.col("rest") > 0, F.col("rest") - 1).when(F.col("spike"), F.lit(refractory)).otherwise(0), "top": F.when(F.col("spike"), F.greatest("peak", "i")).otherwise(F.col("peak"))}))
        events = now.select("query_id", F.lit(tick).alias("tick"), "id", N.rounded(F.col("v"), 6).alias("before"), N.rounded(F.col("after"), 6).alias("after"), "spike")
        trace = events if trace is None else trace.unionByName(events)
        pushed = now.where("spike").join(near.withColumnRenamed("src", "id"), "id").groupBy("query_id", F.col("dst").alias("id")).agg(F.least(F.lit(1.0), F.sum(F.col("i") * F.col("w"))).alias("got"))
        kept = now.select("query_id", "id", F.col("after").alias("v"), F.col("left").alias("rest"), F.col("top").alias("peak"))
        joined = kept.join(pushed, ["query_id", "id"], "full")
        state = joined.select("query_id", "id", F.coalesce("v", F.lit(0.0)).alias("v"), F.coalesce("rest", F.lit(0)).alias("rest"), F.coalesce("got", F.lit(0.0)).alias("cur"), F.coalesce("peak", F.lit(0.0)).alias("peak"))
    return state.where("peak > 0").select("query_id", "id", N.rounded(F.col("peak"), 6).alias("peak")), trace
