"""Metrics of ranked results, forgetting curves, and tests of differences."""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numeric as N
from .durable import cut

#: Pairs of all groups together that each task of the bootstrap holds, 8 bytes each; more are joined with their draws.
HELD_PAIRS = 4_000_000
#: Draws of a round that are worked out at once.
DRAWS = 16_384


def ranking_metrics(runs: DataFrame, gold: DataFrame, k: int = 8, by: list[str] | None = None, wanted: DataFrame | None = None) -> DataFrame:
    """by, query_id, recall, precision, mrr at k; runs: query_id, id, rank; gold: query_id, id. A query without hits has 0.

    wanted: query_id, wanted, how many there are to find, where gold has only those that runs have found.
    """
    by = by or []
    wanted = gold.groupBy("query_id").agg(F.count(F.lit(1)).alias("wanted")) if wanted is None else wanted
    hit = runs.where(F.col("rank") <= k).join(gold.select("query_id", "id").withColumn("hit", F.lit(1)), ["query_id", "id"], "left")
    per = hit.groupBy(*by, "query_id").agg(F.count("hit").alias("hits"), F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"))
    return per.join(wanted, "query_id", "left").select(
        *by, "query_id", F.coalesce(F.col("hits") / F.col("wanted"), F.lit(0.0)).alias("recall"), (F.col("hits") / k).alias("precision"), F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr")
    )


def means(rows: DataFrame, metrics: list[str], by: list[str]) -> DataFrame:
    """by, n, each metric's mean over the rows that have it (four places) and how many have it."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(m), 4).alias(m) for m in metrics], *[F.count(m).alias(f"n_scored_{m}") for m in metrics])


def forgetting(rows: DataFrame, value: str = "value") -> DataFrame:
    """task, step, value, best_previous, forgetting, retention along each task's steps."""
    before = Window.partitionBy("task").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    v, best = F.col(value), F.max(value).over(before)
    return rows.select("task", "step", v.alias("value"), best.alias("best_previous")).withColumns({
        "forgetting": F.coalesce(F.greatest(F.lit(0.0), F.col("best_previous") - F.col("value")), F.lit(0.0)),
        "retention": F.when(F.coalesce("best_previous", F.lit(0.0)) == 0, F.lit(1.0)).otherwise(F.col("value") / F.col("best_previous")),
    })


def final_forgetting(curves: DataFrame) -> DataFrame:
    """One row: mean forgetting and retention at each task's last step."""
    last = curves.groupBy("task").agg(F.max_by("forgetting", "step").alias("f"), F.max_by("retention", "step").alias("r"))
    return last.agg(F.round(F.avg("f"), 6).alias("average_forgetting"), F.round(F.avg("r"), 6).alias("mean_retention"))


def paired(a: DataFrame, b: DataFrame, key: str, metric: str) -> DataFrame:
    """key, diff: a's metric less b's, for the keys that both have."""
    return a.select(key, F.col(metric).cast("double").alias("x")).join(b.select(key, F.col(metric).cast("double").alias("y")), key).where("x is not null and y is not null").select(key, (F.col("x") - F.col("y")).alias("diff"))


def paired_bootstrap(diffs: DataFrame, by: list[str], rounds: int = 10_000, seed: int = 42) -> DataFrame:
    """by, n_pairs, mean_diff, ci_low, ci_high, p_value of the mean of ``diff``; diffs: by, query_id, diff.

    Each round draws as many of a group's pairs as there are, with replacement: draw j of round r is pair
    md5(seed:r:j) mod n. Spark spreads the rounds; a draw's number is worked out once for all groups, and up to
    ``HELD_PAIRS`` pairs are held where they are drawn, so that no draw is shuffled. Reruns agree whatever the partitions.
    The interval holds 95 of 100 rounds; the p-value is twice the share of rounds on the other
    side of zero, one round at least. A group of fewer than two pairs, or without any difference, has 0, 0, 0 and 1.
    """
    place = F.row_number().over(Window.partitionBy(*by).orderBy("query_id")) - 1
    at = cut(diffs.select(*by, place.cast("long").alias("place"), F.col("diff").cast("double").alias("diff")))
    sums = at.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("diff").alias("mean"), F.max(F.abs("diff")).alias("most"))
    tested = sums.where("n >= 2 and most > 0").select(*by, "n")
    drawing = at.join(tested, by)
    means_ = (_held_draws if at.count() <= HELD_PAIRS else _joined_draws)(drawing, by, rounds, seed).select(*by, "round", F.round("m", 9).alias("m"))
    order = F.row_number().over(Window.partitionBy(*by).orderBy("m"))
    ranked = means_.withColumn("i", order).join(sums.select(*by, "mean"), by)
    low, high = int(0.025 * rounds) + 1, int(0.975 * rounds)
    beyond = F.count_if((F.col("mean") >= 0) == (F.col("m") < 0))
    ends = ranked.groupBy(*by).agg(F.max(F.when(F.col("i") == low, F.col("m"))).alias("lo"), F.max(F.when(F.col("i") == high, F.col("m"))).alias("hi"), beyond.alias("beyond"))
    p = F.greatest(2 * F.col("beyond") / rounds, F.lit(1 / rounds))
    zero = lambda c, x=0.0: F.coalesce(c, F.lit(x))
    out = sums.join(ends, by, "left")
    return out.select(*by, F.col("n").alias("n_pairs"), F.when(F.col("lo").isNull(), 0.0).otherwise(F.round("mean", 5)).alias("mean_diff"), zero(F.round("lo", 5)).alias("ci_low"), zero(F.round("hi", 5)).alias("ci_high"), F.when(F.col("lo").isNull(), 1.0).otherwise(p).alias("p_value"))


def _joined_draws(at: DataFrame, by: list[str], rounds: int, seed: int) -> DataFrame:
    """by, round, m: the mean of each round's draws, which are rows that are joined with the pairs; at: by, place, diff, n."""
    drawn = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), "round", "place").cast("binary")), 1, 8), 16, 10).cast("long")
    draws = at.select(*by, "n", "place").withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
    hit = draws.select(*by, "round", F.pmod(drawn, F.col("n")).alias("place")).join(at.select(*by, "place", "diff"), [*by, "place"])
    return hit.groupBy(*by, "round").agg(F.avg("diff").alias("m"))


def _held_draws(at: DataFrame, by: list[str], rounds: int, seed: int) -> DataFrame:
    """by, round, m: the same, where each task holds the pairs and draws whole rounds."""
    spark, kinds = at.sparkSession, ", ".join(f"{at.schema[c].simpleString().replace(':', ' ', 1)}" for c in by)
    pairs = at.select(*by, "place", F.coalesce("diff", F.lit(0.0)).alias("diff"), F.col("diff").isNotNull().alias("known")).toPandas().sort_values("place")
    # known is kept only where some pair has no difference, which no mean counts
    held = spark.sparkContext.broadcast([(key, g["diff"].to_numpy(np.float64), None if g["known"].all() else g["known"].to_numpy(bool)) for key, g in pairs.groupby(by)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        groups = held.value
        longest = max((len(d) for _, d, _ in groups), default=0)
        for b in batches:
            for r in b["round"]:
                total, count = np.zeros(len(groups)), np.zeros(len(groups), np.int64)
                for start in range(0, longest, DRAWS):
                    drawn = N.md5_heads(f"{seed}:{r}:", start, min(longest, start + DRAWS))
                    for i, (_, d, known) in enumerate(groups):
                        if start < len(d):
                            places = drawn[: len(d) - start] % np.uint32(len(d))
                            total[i] += d[places].sum()
                            count[i] += len(places) if known is None else known[places].sum()
                yield pd.DataFrame([(*key, int(r), t / n if n else None) for (key, _, _), t, n in zip(groups, total, count)], columns=[*by, "round", "m"])

    dealt = spark.range(rounds, numPartitions=min(rounds, 8 * spark.sparkContext.defaultParallelism)).withColumnRenamed("id", "round")
    return dealt.mapInPandas(run, f"{kinds}, round long, m double")


def wilcoxon(diffs: DataFrame, by: list[str], least: int = 6) -> DataFrame:
    """by, n_pairs, statistic, p_value of the signed-rank test: mean ranks of ties, normal approximation with their correction.

    With fewer than ``least`` pairs that differ there is no test: the p-value is 1.
    """
    d = diffs.where("diff <> 0").withColumn("size", F.round(F.abs("diff"), 9))
    w = Window.partitionBy(*by).orderBy("size")
    tie = Window.partitionBy(*by, "size")
    ranked = d.withColumns({"low": F.rank().over(w), "ties": F.count(F.lit(1)).over(tie)}).withColumn("r", F.col("low") + (F.col("ties") - 1) / 2)
    s = ranked.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_pairs"), F.sum(F.when(F.col("diff") > 0, F.col("r")).otherwise(0.0)).alias("plus"),
        F.sum(F.when(F.col("diff") < 0, F.col("r")).otherwise(0.0)).alias("minus"), F.sum((F.col("ties") * F.col("ties") - 1).cast("double")).alias("tied"),
    )
    n = F.col("n_pairs")
    z = (F.least("plus", "minus") - n * (n + 1) / 4) / F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("tied") / 48)
    return s.select(*by, "n_pairs", F.least("plus", "minus").alias("statistic"), F.when(n < least, F.lit(1.0)).otherwise(F.round(2 * normal_tail(F.abs(z)), 6)).alias("p_value"))


def normal_tail(z: Column) -> Column:
    """P(Z > z) for z >= 0, by the series of Abramowitz and Stegun 26.2.17 (error below 1e-7)."""
    # The coefficients of the series.
    b = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
    t = 1 / (1 + 0.2316419 * z)
    poly = sum((c * F.pow(t, F.lit(float(i + 1))) for i, c in enumerate(b)), F.lit(0.0))
    return F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * poly


def exact_tail(z: float) -> float:
    return 1 - NormalDist().cdf(z)


def jaccard_matrix(runs: DataFrame) -> DataFrame:
    """a, b, jaccard: mean overlap of two systems' results over the queries both have; runs: system, query_id, ids (array)."""
    x = runs.select(F.col("system").alias("a"), "query_id", F.col("ids").alias("x"))
    y = runs.select(F.col("system").alias("b"), "query_id", F.col("ids").alias("y"))
    both = F.size(F.array_union("x", "y"))
    one = F.when(both == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect("x", "y")) / both)
    return x.join(y, "query_id").groupBy("a", "b").agg(F.round(F.avg(one), 6).alias("jaccard"))
