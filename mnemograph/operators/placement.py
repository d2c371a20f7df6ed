"""Where nodes stand: rings, sectors, radial distance, soft membership."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import numeric as N
from ..functions import text as T
from . import graph
from .durable import cut
from .order import numbered
from .topk import pieces

RINGS = 5
#: Weights of semantic distance, depth, lack of centrality and age.
RADIAL = {"semantic": 0.4, "hierarchy": 0.2, "centrality": 0.3, "age": 0.1}
MOST_CENTROIDS = 1024


def ranked_bands(nodes: DataFrame, order: list[Column], bands: int = RINGS) -> DataFrame:
    """id, ring: even bands over a global order; ring = floor(bands * place / n).

    Ties go by id. Places come from ``numbered``, so no task holds all nodes, however few or many values there are.
    """
    at = cut(numbered(nodes.select("id", *[c.alias(f"k{i}") for i, c in enumerate(order)]), [*(f"k{i}" for i in range(len(order))), "id"]))
    total = at.agg(F.count(F.lit(1)).alias("total"))
    return at.crossJoin(F.broadcast(total)).select("id", F.floor(F.lit(bands) * F.col("i") / F.col("total")).cast("int").alias("ring"))


def by_centrality(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, ring, sector: the most central fifth in the core."""
    deg = graph.degree(nodes, edges)
    rings = ranked_bands(deg, [-F.col("centrality")])
    return rings.select("id", "ring", F.when(F.col("ring") == 0, F.lit("core")).otherwise(F.concat(F.lit("community_"), F.col("ring"))).alias("sector"))


def by_age(nodes: DataFrame) -> DataFrame:
    """id, ring, sector: the newest fifth in the core; sectors name the fifths."""
    rings = ranked_bands(nodes, [-F.unix_micros("updated_at")])
    return rings.select("id", "ring", F.element_at(F.array(*map(F.lit, ("today", "week", "month", "quarter", "older"))), F.col("ring") + 1).alias("sector"))


def by_hierarchy(nodes: DataFrame) -> DataFrame:
    """id, ring, sector of a tree (id, parent_id, label): depth, and the first word of the label at depth 0 or 1, else the parent's sector."""
    word = F.coalesce(F.try_element_at(T.words(F.col("label")), F.lit(1)), F.lit("general"))
    level = nodes.where("parent_id is null").select("id", F.lit(0).alias("ring"), word.alias("sector"))
    out = level
    for depth in range(1, RINGS):
        up = level.select(F.col("id").alias("parent_id"), F.col("sector").alias("above"))
        level = nodes.where("parent_id is not null").join(up, "parent_id").select("id", F.lit(depth).alias("ring"), (word if depth <= 1 else F.col("above")).alias("sector"))
        out = out.unionByName(level)
    return out


def _far(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows of x and c, by norms and one product; rounded, so that ties do not depend on it."""
    return np.maximum((x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)[None], 0).round(9)


def _first_seeds(data: DataFrame, k: int) -> np.ndarray:
    return np.array([r["embedding"] for r in data.orderBy("id").limit(k).select("embedding").collect()], np.float64)


def oversampled_seeds(data: DataFrame, k: int, seed: int = 7, rounds: int = 4) -> np.ndarray:
    """k seeds by k-means||: in each round rows are drawn in proportion to their distance from the seeds so far, about 2 k of
    them; the drawn ones, weighted by the rows nearest to them, are then reduced to k by the same rule on the driver.

    Draws are by hash, so runs agree. The driver gets about 2 k rows a round.
    """
    centres = _first_seeds(data, 1)
    if not len(centres):
        return centres

    def cost(batches: Iterator[pd.DataFrame], c: np.ndarray) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({"id": b["id"].to_numpy(object), "embedding": b["embedding"].to_numpy(), "d": _far(np.stack(b["embedding"].to_numpy()).astype(np.float64), c).min(1)})

    for r in range(rounds):
        c = centres
        far = cut(data.mapInPandas(lambda it, c=c: cost(it, c), "id string, embedding array<double>, d double"))
        total = far.agg(F.sum("d")).first()[0] or 0.0
        if total <= 0:
            break
        lot = F.pmod(F.xxhash64("id", F.lit(seed), F.lit(r)), F.lit(1 << 30)) / float(1 << 30)
        more = far.where(lot < F.least(F.lit(1.0), 2.0 * k * F.col("d") / total)).orderBy("id").select("embedding").collect()
        if more:
            centres = np.unique(np.concatenate([centres, np.array([x["embedding"] for x in more], np.float64)]), axis=0)
    if len(centres) <= k:
        return centres
    weight = np.zeros(len(centres))
    for r in _sums(data, [centres]).groupBy("cluster").agg(F.sum("n").alias("n")).collect():
        weight[r["cluster"]] = r["n"]
    rng, picked = np.random.default_rng(seed), [int(weight.argmax())]
    while len(picked) < k:
        chance = weight * _far(centres, centres[picked]).min(1)
        picked.append(int(rng.choice(len(centres), p=chance / chance.sum())) if chance.sum() > 0 else next(i for i in range(len(centres)) if i not in picked))
    return centres[picked]


def _sums(data: DataFrame, starts: list[np.ndarray]) -> DataFrame:
    """start, cluster, n, total (summed vectors), cost of the rows nearest to each centre, from each batch and for each set of centres."""

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            x = np.stack(b["embedding"].to_numpy()).astype(np.float64)
            for s, c in enumerate(starts):
                far = _far(x, c)
                near, least = far.argmin(1), far.min(1)
                for j in np.unique(near):
                    yield pd.DataFrame({"start": [s], "cluster": [int(j)], "n": [int((near == j).sum())], "total": [x[near == j].sum(0)], "cost": [float(least[near == j].sum())]})

    return data.mapInPandas(sums, "start int, cluster int, n long, total array<double>, cost double")


def kmeans(nodes: DataFrame, k: int, seeds: list[np.ndarray], rounds: int = 8) -> tuple[DataFrame, np.ndarray, list[float]]:
    """(id, cluster), centroids and the cost of each start: Lloyd's rounds from several sets of seeds at once, of which the cheapest stays.

    Each round is one pass for all starts; partial sums are added up, so the driver gets k vectors a start. Costs are those
    of the centroids that are returned; of equal ones the first start stays.
    """
    data, starts = nodes.where("embedding is not null").select(F.col("id").cast("string").alias("id"), F.col("embedding").cast("array<double>").alias("embedding")), list(seeds)
    cost = [0.0] * len(starts)
    for r in range(rounds + 1):
        parts = _sums(data, starts).select("start", "cluster", "n", "cost", F.posexplode("total").alias("i", "v"))
        means = parts.groupBy("start", "cluster", "i").agg((F.sum("v") / F.sum("n")).alias("v"), F.sum("cost").alias("cost"))
        got = means.groupBy("start", "cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda e: e["v"]).alias("c"), F.max("cost").alias("cost")).collect()
        cost, moved = [sum(x["cost"] for x in got if x["start"] == s) for s in range(len(starts))], [c.copy() for c in starts]
        for x in got:
            moved[x["start"]][x["cluster"]] = x["c"]
        if r == rounds or all(np.allclose(a, b, atol=1e-9) for a, b in zip(moved, starts)):
            break
        starts = moved
    best = starts[int(np.argmin(np.round(cost, 9)))] if starts else np.zeros((0, 0))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({"id": b["id"].to_numpy(object), "cluster": _far(np.stack(b["embedding"].to_numpy()).astype(np.float64), best).argmin(1).astype("int32")})

    return data.mapInPandas(assign, "id string, cluster int"), best, cost


def clusters(nodes: DataFrame, k: int, starts: int = 3, rounds: int = 8) -> tuple[DataFrame, np.ndarray, list[float]]:
    """``kmeans`` from the k smallest ids, and from ``starts`` - 1 draws of k-means||; so never dearer than the first alone."""
    data = cut(nodes.where("embedding is not null").select(F.col("id").cast("string").alias("id"), F.col("embedding").cast("array<double>").alias("embedding")))
    return kmeans(data, k, [_first_seeds(data, k), *(oversampled_seeds(data, k, seed) for seed in range(1, starts))], rounds)


def centroid(nodes: DataFrame, groups: list[str] | None = None) -> DataFrame:
    """groups, centroid: mean vectors."""
    flat = nodes.where("embedding is not null").select(*(groups or []), F.posexplode("embedding").alias("i", "v"))
    means = flat.groupBy(*(groups or []), "i").agg(F.avg(F.col("v").cast("double")).alias("v"))
    return means.groupBy(*(groups or [])).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda e: e["v"]).alias("centroid"))


def distance_rings(nodes: DataFrame) -> DataFrame:
    """id, distance, ring: how many of the fifths of all distances to the mean vector a node's own is above."""
    c = centroid(nodes)
    gap = F.sqrt(F.aggregate(F.zip_with("embedding", "centroid", lambda a, b: F.pow(a.cast("double") - b, F.lit(2.0))), F.lit(0.0), lambda s, x: s + x))
    d = nodes.crossJoin(F.broadcast(c)).select("id", F.round(gap, 6).alias("distance"))
    cuts = d.agg(F.percentile("distance", F.array(*map(F.lit, (0.2, 0.4, 0.6, 0.8)))).alias("cuts"))
    return d.crossJoin(F.broadcast(cuts)).select("id", "distance", F.size(F.filter("cuts", lambda q: q < F.col("distance"))).alias("ring"))


def hybrid(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, ring: kind and connections decide.

    The most connected node that is no document is the core; documents are outermost; facts and events in ring 3; hubs
    (at or above the fourth fifth of connections) in 1; concepts and relations in 2; others in 2 if connected, else 3.
    Connections count the node itself.
    """
    deg = graph.degree(nodes, edges).select("id", (F.col("degree") + 1).alias("deg")).join(nodes.select("id", "memory_type"), "id")
    own = deg.where("memory_type <> 'document'")
    hub = own.agg(F.greatest(F.lit(4), F.floor(F.percentile("deg", 0.8))).alias("hub"), F.max(F.struct("deg")).alias("m"))
    core = own.join(F.broadcast(hub), F.col("deg") == F.col("m.deg")).agg(F.min("id").alias("core"))
    ring = (
        F.when(F.col("id") == F.col("core"), 0).when(F.col("memory_type") == "document", 4).when(F.col("memory_type").isin("fact", "event", "evidence"), 3)
        .when(F.col("deg") >= F.col("hub"), 1).when(F.col("memory_type").isin("concept", "relation"), 2).when(F.col("deg") >= 2, 2).otherwise(3)
    )
    return deg.crossJoin(F.broadcast(hub)).crossJoin(F.broadcast(core)).select("id", ring.alias("ring"))


def radial(nodes: DataFrame, edges: DataFrame, now: Column, weights: dict[str, float] = RADIAL) -> DataFrame:
    """id, radial_distance: distance from the mean vector, depth, lack of centrality and age, weighted; four places."""
    c = centroid(nodes)
    deg = graph.degree(nodes, edges).select("id", "centrality")
    top = deg.agg(F.greatest(F.max("centrality"), F.lit(1e-9)).alias("top"))
    d = nodes.join(deg, "id").crossJoin(F.broadcast(c)).crossJoin(F.broadcast(top))
    semantic = N.clip(1 - F.round(N.cosine(F.col("embedding"), F.col("centroid")), 6))
    value = weights["semantic"] * semantic + weights["hierarchy"] * F.coalesce("ring", F.lit(2)) / (RINGS - 1) + weights["centrality"] * (1 - F.col("centrality") / F.col("top")) + weights["age"] * N.clip(N.age_days(F.col("updated_at"), now) / 30)
    return d.select("id", F.round(N.clip(value), 4).alias("radial_distance"))


def name_sectors(nodes: DataFrame, group: str) -> DataFrame:
    """group, name: the most frequent telling word of each group's concepts, at most 24 characters."""
    words = nodes.select(group, F.explode(F.regexp_extract_all(F.lower("concept"), F.lit(r"([a-z][a-z\-]{2,})"), F.lit(1))).alias("w")).where(~F.col("w").isin(T.STOP_WORDS))
    counts = words.groupBy(group, "w").agg(F.count(F.lit(1)).alias("n"))
    first = F.row_number().over(Window.partitionBy(group).orderBy(F.col("n").desc(), "w"))
    named = counts.withColumn("r", first).where("r = 1").select(group, F.substring("w", 1, 24).alias("name"))
    return nodes.select(group).distinct().join(named, group, "left").withColumn("name", F.coalesce("name", F.concat(F.lit("sector_"), F.col(group))))


#: Hubs whose vectors go to tasks at once.
HUB_BLOCK = 16_384


def hub_similarity(nodes: DataFrame, hubs: DataFrame) -> DataFrame:
    """id, nearest: each node's largest inner product with another node of ``hubs`` (id, embedding); none where there is no other.

    Hubs go to tasks in blocks, each block one matrix product a batch.
    """
    kind, blocks = nodes.schema["id"].dataType.simpleString(), max(1, -(-hubs.count() // HUB_BLOCK))
    out = None
    for i in range(blocks):
        held = hubs.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == i).where("embedding is not null").select("id", "embedding").toPandas()
        if not len(held):
            continue
        names, x = held["id"].to_numpy(object), np.stack(held["embedding"].to_numpy()).astype(np.float64)

        def run(batches: Iterator[pd.DataFrame], names=names, x=x) -> Iterator[pd.DataFrame]:
            place = {n: j for j, n in enumerate(names)}
            for whole in batches:
                for b in pieces(whole, len(names)):
                    s = np.stack(b["embedding"].to_numpy()).astype(np.float64) @ x.T
                    own = np.array([place.get(n, -1) for n in b["id"]])
                    s[np.flatnonzero(own >= 0), own[own >= 0]] = -np.inf
                    best = s.max(1)
                    good = np.isfinite(best)
                    if good.any():
                        yield pd.DataFrame({"id": b["id"].to_numpy(object)[good], "nearest": np.round(best[good], 9)})

        part = cut(nodes.where("embedding is not null").select("id", "embedding").mapInPandas(run, f"id {kind}, nearest double"))
        out = part if out is None else out.unionByName(part)
    return nodes.sparkSession.createDataFrame([], f"id {kind}, nearest double") if out is None else out.groupBy("id").agg(F.max("nearest").alias("nearest"))


def tree_rings(nodes: DataFrame, rings: int = 5) -> DataFrame:
    """id, ring: down parent_id from all roots at once: a root is 0 if it is a concept or an entity, else 1, and a child one more, the last ring at most.

    Nodes that no root leads to have the ring two beyond their depth (0 where it is unknown), the last at most. A level is
    a round; each node is met once, as it has one parent.
    """
    last, known = F.lit(rings - 1), "depth" in nodes.columns
    front = nodes.where("parent_id is null").select("id", F.when(F.col("memory_type").isin("concept", "entity"), 0).otherwise(1).alias("ring"))
    tree, parts = cut(nodes.select("id", "parent_id").where("parent_id is not null")), [cut(front)]
    while True:
        front = cut(tree.join(parts[-1].select(F.col("id").alias("parent_id"), "ring"), "parent_id").select("id", F.least(F.col("ring") + 1, last).alias("ring")))
        if front.isEmpty():
            break
        parts.append(front)
    met = reduce(DataFrame.unionByName, parts)
    rest = nodes.join(met, "id", "left_anti").select("id", F.least(last, (F.coalesce("depth", F.lit(0)) if known else F.lit(0)) + 2).cast("int").alias("ring"))
    return met.unionByName(rest)


# Weights of the four distances of ``build``.
BUILD = {"semantic": 0.4, "hierarchy": 0.25, "graph": 0.2, "age": 0.15}


def build(nodes: DataFrame, edges: DataFrame, now: Column, rings: int = 5, days: float = 30.0) -> DataFrame:
    """id, ring, sector, radial_distance by the other builder: rings down the tree, clusters as sectors, distance from hubs.

    Hubs are the nodes of rings 0 and 1; a node's distance from them is 1 less its largest similarity to another hub
    (without any, the length of its vector, or 1). Depth counts ring 0 as the last one, as the builder always has. With
    fewer than six vectors there is one sector, "general", and nodes without a vector are in it.
    """
    placed = cut(nodes.drop("ring").join(tree_rings(nodes, rings), "id"))
    near = hub_similarity(placed, placed.where("ring <= 1").select("id", "embedding"))
    n = placed.where("embedding is not null").count()
    general = F.lit("general")
    if n >= 6:
        found, _, _ = clusters(placed, int(max(2, min(8, n**0.5))))
        named = found.join(placed.select("id", "concept"), "id")
        sectors = named.select("id", "cluster").join(name_sectors(named, "cluster"), "cluster").select("id", F.col("name").alias("found"))
    else:
        sectors = placed.select("id", general.alias("found")).limit(0)
    d = placed.drop("sector").join(near, "id", "left").join(sectors, "id", "left").join(graph.degree(nodes, edges).select("id", "centrality"), "id")
    alone = F.when(F.col("embedding").isNotNull(), N.norm(F.col("embedding"))).otherwise(1.0)
    semantic = F.coalesce(1 - F.col("nearest"), alone)
    depth = F.when(F.col("ring") == 0, rings - 1).otherwise(F.col("ring")) / float(max(1, rings - 1))
    age = F.least(F.lit(1.0), N.age_days(F.col("created_at") if "created_at" in nodes.columns else F.col("updated_at"), now) / days)
    total = BUILD["semantic"] * semantic + BUILD["hierarchy"] * depth + BUILD["graph"] * (1 - F.least(F.lit(1.0), 5 * F.col("centrality"))) + BUILD["age"] * age
    return d.select("id", "ring", F.coalesce("found", general).alias("sector"), F.round(total / sum(BUILD.values()), 4).alias("radial_distance"))


def membership(nodes: DataFrame, centroids: DataFrame, k: int = 3, floor: float = 0.0) -> DataFrame:
    """id, cid, w: each node's k nearest centroids (cid, centroid) by cosine above ``floor``; weights add up to 1.

    Centroids are at most ``MOST_CENTROIDS``, which is checked; they go to every task.
    """
    if centroids.limit(MOST_CENTROIDS + 1).count() > MOST_CENTROIDS:
        raise ValueError(f"more than {MOST_CENTROIDS} centroids")
    s = nodes.select("id", "embedding").crossJoin(F.broadcast(centroids)).select("id", "cid", F.round(N.cosine(F.col("embedding"), F.col("centroid")), 6).alias("s")).where(F.col("s") > floor)
    best = s.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy(F.col("s").desc(), "cid"))).where(F.col("r") <= k)
    return best.select("id", "cid", (F.col("s") / F.sum("s").over(Window.partitionBy("id"))).alias("w"))


def overlap(queries: DataFrame, members: DataFrame, amplitudes: bool = False, on: str | list[str] = "cid") -> DataFrame:
    """query_id, id, kernel: how much of their memberships a query and a node share.

    Linear: sum of products; with ``amplitudes``, the square of the sum of the square roots of the products.
    on: with query_id and cid, members have the query that each of their rows is for; by cid alone all pairs that share
    one come out of a matrix product for each piece of nodes, to which the queries' memberships go, and none is shuffled.
    """
    if on == "cid":
        return _held_overlap(queries, members, amplitudes)
    q = queries.select("query_id", "cid", F.col("w").alias("qw"))
    term = F.sqrt(F.col("qw") * F.col("w")) if amplitudes else F.col("qw") * F.col("w")
    total = F.sum(term)
    return q.join(members, on).groupBy("query_id", "id").agg((F.pow(total, F.lit(2.0)) if amplitudes else total).alias("kernel"))


def _held_overlap(queries: DataFrame, members: DataFrame, amplitudes: bool) -> DataFrame:
    asked = queries.select("query_id", "cid", "w").where("cid is not null").collect()
    ids, cids = sorted({r["query_id"] for r in asked}), {c: i for i, c in enumerate(sorted({r["cid"] for r in asked}))}
    place = {q: i for i, q in enumerate(ids)}
    theirs = np.zeros((len(ids), len(cids)))
    shares = np.zeros((len(ids), len(cids)), np.float32)
    for r in asked:
        theirs[place[r["query_id"]], cids[r["cid"]]] += np.sqrt(r["w"]) if amplitudes else r["w"]
        shares[place[r["query_id"]], cids[r["cid"]]] = 1
    q, n = queries.schema["query_id"].dataType, members.schema["id"].dataType.simpleString()
    kind = to_arrow_type(q)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        named = pa.array(ids, kind)
        for batch in batches:
            done = 0
            for b in pieces(batch.select(["m"]).to_pandas(), len(ids)):
                own, has = np.zeros((len(b), len(cids))), np.zeros((len(b), len(cids)), np.float32)
                for j, found in enumerate(b["m"]):
                    for x in found:
                        if x["cid"] in cids:
                            own[j, cids[x["cid"]]] += np.sqrt(x["w"]) if amplitudes else x["w"]
                            has[j, cids[x["cid"]]] = 1
                at, node = np.nonzero(shares @ has.T)
                kernel = (theirs @ own.T)[at, node]
                names = batch.column("id").slice(done, len(b)).take(pa.array(node))
                done += len(b)
                yield pa.RecordBatch.from_arrays([named.take(pa.array(at)), names, pa.array(kernel**2 if amplitudes else kernel)], names=["query_id", "id", "kernel"])

    rows = members.groupBy("id").agg(F.collect_list(F.struct("cid", "w")).alias("m"))
    return rows.mapInArrow(run, f"query_id {q.simpleString()}, id {n}, kernel double")


def geometry(r: Column, theta: Column) -> tuple[Column, Column]:
    """Ring and sector (of 8) of polar coordinates."""
    return F.least(F.lit(4), F.floor(5 * r)).cast("int"), F.pmod(F.floor(8 * (theta + np.pi) / (2 * np.pi)), F.lit(8)).cast("int")


def angles(nodes: DataFrame, sector: str) -> DataFrame:
    """id, angle: sectors share the circle evenly, and nodes their sector's slice, in id order."""
    names = nodes.select(sector).distinct()
    order = names.select(sector, (F.row_number().over(Window.orderBy(sector)) - 1).alias("s"), F.count(F.lit(1)).over(Window.partitionBy()).alias("m"))
    place = nodes.select("id", sector, F.row_number().over(Window.partitionBy(sector).orderBy("id")).alias("i"), F.count(F.lit(1)).over(Window.partitionBy(sector)).alias("n"))
    return place.join(order, sector).select("id", (2 * np.pi * (F.col("s") + (F.col("i") - 0.5) / F.col("n")) / F.col("m")).alias("angle"))


#: The strategies of ``place``.
STRATEGIES = ("embedding_clusters", "graph_centrality", "hierarchy", "temporal", "hybrid")


def place(nodes: DataFrame, edges: DataFrame, strategy: str, now: Column) -> DataFrame:
    """nodes with ring, sector, depth and radial_distance set by a strategy; unknown ones are hybrid.

    Clusters are those of ``clusters``, named by their words.
    """
    if strategy == "graph_centrality":
        spot = by_centrality(nodes, edges)
    elif strategy == "temporal":
        spot = by_age(nodes)
    elif strategy == "hierarchy":
        spot = by_hierarchy(nodes.withColumn("label", F.col("concept")))
    else:
        n = nodes.count()
        found, _, _ = clusters(nodes, int(max(2, min(8, n**0.5))))
        named = found.join(nodes.select("id", "concept"), "id")
        sectors = named.select("id", "cluster").join(name_sectors(named, "cluster"), "cluster").select("id", F.col("name").alias("sector"))
        rings = distance_rings(nodes).select("id", "ring") if strategy == "embedding_clusters" else hybrid(nodes, edges)
        spot = rings.join(sectors, "id", "left")
    placed = nodes.drop("ring", "sector", "depth", "radial_distance").join(cut(spot), "id", "left").withColumn("depth", F.col("ring"))
    return placed.join(radial(placed, edges, now), "id")
