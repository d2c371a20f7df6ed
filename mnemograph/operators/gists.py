"""Summaries above details: one node for each cluster of a sector."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .durable import cut


def build(nodes: DataFrame, least: int = 3, most: int = 24) -> DataFrame:
    """sector, seed, members, importance, confidence: far-apart seeds of each sector with their nearest members.

    The first seed is farthest from the mean, each next one farthest from all seeds; members are the ``least`` nearest by
    inner product above .25. A cluster with fewer members is none. Ties go to the smaller id.

    Each round of seeds is one pass that sends on a row for each task and sector. The seeds, at most ``most`` or one for each
    sector, are held by the driver.
    """
    kept = nodes.where(F.col("embedding").isNotNull() & F.col("memory_type").isin("fact", "document", "episodic") & F.col("sector").isNotNull())
    rows = cut(kept.select("sector", "id", F.col("embedding").cast("array<double>").alias("embedding"), "importance", "confidence"))
    sizes = {r["sector"]: r["n"] for r in rows.groupBy("sector").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = max(1, most // max(1, len(sizes)))
    sums = rows.mapInPandas(_sums, "sector string, total array<double>").select("sector", F.posexplode("total")).groupBy("sector", "pos").agg(F.sum("col").alias("x"))
    means = {r["sector"]: np.array([x["x"] for x in r["xs"]]) / sizes[r["sector"]] for r in sums.groupBy("sector").agg(F.sort_array(F.collect_list(F.struct("pos", "x"))).alias("xs")).collect()}
    # what the next seed of a sector is to be far from, and its seeds so far
    points, seeds = {s: means[s][None] for s, n in sizes.items() if n >= least}, {s: [] for s in sizes}
    while points:
        far = rows.mapInPandas(_farthest(points), "sector string, gap double, id string, embedding array<double>")
        for r in far.groupBy("sector").agg(F.min_by(F.struct("id", "gap", "embedding"), F.struct(-F.col("gap"), F.col("id"))).alias("r")).collect():
            s, found = r["sector"], r["r"]
            if seeds[s] and found["gap"] < 1e-6:
                del points[s]
                continue
            seeds[s].append((found["id"], np.array(found["embedding"])))
            points[s] = np.stack([x for _, x in seeds[s]])
            if len(seeds[s]) >= min(share, sizes[s] // least):
                del points[s]

    def gist(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        m = _nearest(part, least)
        out = [(key[0], key[2], m["id"].tolist(), round(float(m["importance"].mean()) + 0.05, 4), round(float(m["confidence"].mean()), 4))] if len(m) == least else []
        return pd.DataFrame(out, columns=["sector", "seed", "members", "importance", "confidence"])

    near = rows.mapInPandas(_members(seeds, least), "sector string, place long, seed string, near double, id string, importance double, confidence double")
    return near.groupBy("sector", "place", "seed").applyInPandas(gist, "sector string, seed string, members array<string>, importance double, confidence double")


def _nearest(part: pd.DataFrame, least: int) -> pd.DataFrame:
    return part.sort_values(["near", "id"], ascending=[False, True]).head(least)


def _vectors(part: pd.DataFrame) -> np.ndarray:
    return np.stack(part["embedding"].to_numpy()).astype(np.float64)


def _sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The sum of each sector's vectors, by task."""
    total: dict[str, np.ndarray] = {}
    for b in batches:
        for s, part in b.groupby("sector"):
            total[s] = total.get(s, 0.0) + _vectors(part).sum(0)
    # no frame without rows: Arrow cannot tell what its columns hold
    if total:
        yield pd.DataFrame({"sector": list(total), "total": list(total.values())})


def _farthest(points: dict[str, np.ndarray]):
    """By task and sector, the node that is farthest from the nearest of the sector's points."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict[str, tuple] = {}
        for b in batches:
            for s, part in b.groupby("sector"):
                if s in points:
                    x, part = _vectors(part), part["id"].to_numpy()
                    gap = np.min([np.linalg.norm(x - p, axis=1) for p in points[s]], axis=0)
                    ties = np.flatnonzero(gap == gap.max())
                    i = min(ties, key=lambda i: part[i])
                    if s not in best or (-gap[i], part[i]) < best[s][:2]:
                        best[s] = -gap[i], part[i], x[i]
        if best:
            yield pd.DataFrame([(s, -g, i, x) for s, (g, i, x) in best.items()], columns=["sector", "gap", "id", "embedding"])

    return run


def _members(seeds: dict[str, list[tuple]], least: int):
    """By task and seed, the ``least`` nearest nodes above .25."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict[tuple, pd.DataFrame] = {}
        for b in batches:
            for s, part in b.groupby("sector"):
                x = _vectors(part)
                for place, (seed, vector) in enumerate(seeds[s]):
                    got = part[["id", "importance", "confidence"]].assign(sector=s, place=place, seed=seed, near=(x * vector).sum(1))
                    got = got[got["near"] > 0.25]
                    best[s, place] = _nearest(pd.concat([best[s, place], got]) if (s, place) in best else got, least)
        for got in best.values():
            yield got

    return run
