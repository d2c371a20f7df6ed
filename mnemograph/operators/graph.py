"""Graph operators over edges (source_id, target_id, relation_type, weight, confidence)."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .durable import cut
from .order import numbered

#: Edges, both directions counted, up to which walks of any length hold the graph in each task; a larger one is joined in every round.
HELD_EDGES = 4_000_000
#: Rows of an Arrow batch that such a walk gives out.
WALK_ROWS = 50_000
#: Characters, or ids, of paths from which on a batch is given out before it has as many rows.
WALK_SIZE = 4_000_000


def collapse(edges: DataFrame) -> DataFrame:
    """a, b, weight, relations, relation, confidence: one row for each undirected pair, loops left out.

    The weight is the largest; relation and confidence are those of the largest (weight, confidence), the first in
    (source, target, relation) order among equals.
    """
    e = edges.where("source_id <> target_id")
    pair = [F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b")]
    # the least of a struct with turned numbers is the record of the largest weight and confidence, first in name order
    first = F.min(F.struct((-F.col("weight")).alias("w"), (-F.col("confidence")).alias("c"), "source_id", "target_id", "relation_type")).alias("m")
    top = e.groupBy(*pair).agg(first, F.sort_array(F.collect_set("relation_type")).alias("relations"))
    return top.select("a", "b", (-F.col("m.w")).alias("weight"), "relations", F.col("m.relation_type").alias("relation"), (-F.col("m.c")).alias("confidence"))


def pairs(edges: DataFrame) -> DataFrame:
    """a, b, weight, confidence of each undirected pair: ``collapse`` where relations do not matter, in plain aggregates."""
    e = edges.where("source_id <> target_id").groupBy(F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b"))
    return e.agg(F.max("weight").alias("weight"), F.max(F.struct("weight", "confidence"))["confidence"].alias("confidence"))


def symmetric(pair: DataFrame) -> DataFrame:
    """src, dst, weight, confidence: both directions of each pair."""
    return pair.select(F.col("a").alias("src"), F.col("b").alias("dst"), "weight", "confidence").unionByName(pair.select(F.col("b").alias("src"), F.col("a").alias("dst"), "weight", "confidence"))


def degree(nodes: DataFrame, edges: DataFrame, sym: DataFrame | None = None) -> DataFrame:
    """id, degree (distinct neighbours), centrality (degree over the number of other nodes; 1 for a single node).

    sym: the symmetric graph of ``edges``, where it is there already.
    """
    d = (symmetric(pairs(edges)) if sym is None else sym).groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree"))
    n = nodes.agg(F.count(F.lit(1)).alias("n"))
    out = nodes.select("id").join(d, "id", "left").crossJoin(F.broadcast(n)).withColumn("degree", F.coalesce("degree", F.lit(0)))
    return out.select("id", "degree", F.when(F.col("n") > 1, F.col("degree") / (F.col("n") - 1)).otherwise(F.lit(1.0)).alias("centrality"))


def incidence(edges: DataFrame) -> DataFrame:
    """id, records: edge records at each node, both ends counted."""
    return edges.select(F.explode(F.array("source_id", "target_id")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("records"))


def degree_statistics(degrees: DataFrame) -> DataFrame:
    """One row: n, lowest, highest, mean, median and population deviation of degrees."""
    return degrees.agg(F.count(F.lit(1)).alias("n"), F.min("degree").alias("lowest"), F.max("degree").alias("highest"), F.avg("degree").alias("mean"), F.percentile("degree", 0.5).alias("median"), F.stddev_pop("degree").alias("deviation"))


def neighbours_by_relation(edges: DataFrame) -> DataFrame:
    """id, relation_type, neighbours (sorted)."""
    both = edges.select(F.col("source_id").alias("id"), F.col("target_id").alias("other"), "relation_type").union(edges.select("target_id", "source_id", "relation_type"))
    return both.groupBy("id", "relation_type").agg(F.sort_array(F.collect_set("other")).alias("neighbours"))


def ego(seeds: DataFrame, sym: DataFrame, hops: int | None) -> DataFrame:
    """seed, id, hop: nodes within ``hops`` of each seed, the seed at 0; None: as far as edges lead."""
    seen = seeds.select(F.col("id").alias("seed"), "id", F.lit(0).alias("hop"))
    front, hop = seen, 0
    while hops is None or hop < hops:
        hop += 1
        near = front.join(sym.select(F.col("src").alias("id"), "dst"), "id").select("seed", F.col("dst").alias("id")).distinct()
        front = cut(near.join(seen, ["seed", "id"], "left_anti").withColumn("hop", F.lit(hop)))
        if hops is None and front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def hop_distance(seeds: DataFrame, sym: DataFrame, most: int | None = None) -> DataFrame:
    """seed, id, hop: hops on a shortest path, of any length or up to ``most``.

    Of any length: seeds are dealt to tasks that hold the graph, if that has at most ``HELD_EDGES``, so no row is shuffled.
    """
    if most is None:
        sym = cut(sym.select("src", "dst", F.lit(0).cast("long").alias("c")))
        if sym.count() <= HELD_EDGES:
            return _walks(seeds, sym, "hop int", _levels)
    return ego(seeds, sym, most).where("hop > 0")


def _walks(seeds: DataFrame, step: DataFrame, columns: str, walk) -> DataFrame:
    """seed, id and the columns that ``walk`` gives for each node that it reaches from a seed; step: src, dst, c, within ``HELD_EDGES``.

    The graph goes to every task as arrays. Each task walks from its seeds one by one, and gives out a seed's rows, piece by piece, before the next one's.
    """
    spark = step.sparkSession
    kind = step.schema["src"].dataType.simpleString()
    t = step.where("src is not null and dst is not null").toArrow()
    n, names = t.num_rows, pa.chunked_array(t["src"].chunks + t["dst"].chunks, t["src"].type).combine_chunks().dictionary_encode()
    ends = names.indices.to_numpy().astype(np.int32)
    order = np.argsort(ends[:n], kind="stable")
    first = np.concatenate(([0], np.cumsum(np.bincount(ends[:n], minlength=len(names.dictionary))))).astype(np.int64)
    held = spark.sparkContext.broadcast((names.dictionary, first, ends[n:][order], t["c"].to_numpy()[order]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, first, dst, cost = held.value
        go = walk(ids, first, dst, cost)
        for b in batches:
            for seed, start in zip(b.column(0), pc.index_in(b.column(0), value_set=ids).to_pylist()):
                if start is None:
                    continue
                for at, *rest in go(start):
                    part = ids.take(pa.array(at))
                    yield pa.RecordBatch.from_arrays([pa.repeat(seed, len(part)), part, *[pa.array(c) for c in rest]], names=out)

    out = ["seed", "id", *[c.split()[0] for c in columns.split(", ")]]
    # as many tasks as spread the seeds evenly over all cores
    dealt = seeds.select("id").where("id is not null").distinct().repartition(4 * spark.sparkContext.defaultParallelism)
    return dealt.mapInArrow(run, f"seed {kind}, id {kind}, {columns}")


def _levels(ids: pa.Array, first: np.ndarray, dst: np.ndarray, cost: np.ndarray):
    """A walk that gives the nodes other than its start, and their hops."""
    own = np.empty(len(ids), np.int64)

    def go(start: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        hop, front, h = np.full(len(ids), -1, np.int32), np.array([start]), 0
        hop[start] = 0
        while len(front):
            h += 1
            size = first[front + 1] - first[front]
            ahead = np.arange(size.sum()) + np.repeat(first[front] - np.cumsum(size) + size, size)
            near = dst[ahead]
            near = near[hop[near] < 0]
            hop[near] = h
            # of equal ends the last one stays
            own[near] = np.arange(len(near))
            front = near[own[near] == np.arange(len(near))]
        at = np.flatnonzero(hop > 0)
        for i in range(0, len(at), WALK_ROWS):
            yield at[i : i + WALK_ROWS], hop[at[i : i + WALK_ROWS]]

    return go


def _cheapest(joined: bool):
    """A walk that gives the nodes other than its start, their least costs, and their paths as one text or as arrays.

    Nodes come in the order of the tree of their paths, so that rows share most of their text with the row before, and files
    of them are small. Paths are spelled out piece by piece: what a task holds does not grow with their length.
    """

    def walk(ids: pa.Array, first: np.ndarray, dst: np.ndarray, cost: np.ndarray):
        names, ends, costs, bounds = ids.to_pylist(), dst.tolist(), cost.tolist(), first.tolist()

        def settled(start: int) -> tuple[list[int], list[int], list[int], list[int]]:
            """The nodes in the order of cost and hops, and of each node its cost, its hops and the one before it."""
            most = float("inf")
            done, known, hops, up, heap, order = bytearray(len(names)), [most] * len(names), [0] * len(names), [start] * len(names), [(0, 0, start)], []
            known[start] = 0
            while heap:
                c, h, u = heapq.heappop(heap)
                if done[u]:
                    continue
                done[u] = 1
                order.append(u)
                h += 1
                for j in range(bounds[u], bounds[u + 1]):
                    v = ends[j]
                    if not done[v]:
                        d, best = c + costs[j], known[v]
                        if d < best or d == best and h < hops[v]:
                            known[v], hops[v], up[v] = d, h, u
                            heapq.heappush(heap, (d, h, v))
                        elif d == best and h == hops[v] and sooner(u, up[v], names[v], up):
                            up[v] = u
            return order, known, hops, up

        def sooner(a: int, b: int, end: str, up: list[int]) -> bool:
            """Whether the path over a sorts before the one over b, both of as many hops and with the same end."""
            x, y = [end], [end]
            while a != b:
                x.append(names[a])
                y.append(names[b])
                a, b = up[a], up[b]
            return ">".join(reversed(x)) < ">".join(reversed(y))

        def go(start: int) -> Iterator[tuple[list[int], np.ndarray, list]]:
            order, known, hops, up = settled(start)
            # a node's place is after the node before it and the branches that left there sooner; free: where the next branch goes
            size, free, rows = [1] * len(names), [1] * len(names), [start] * len(order)
            for u in reversed(order[1:]):
                size[up[u]] += size[u]
            for u in order[1:]:
                at = free[up[u]]
                rows[at] = u
                free[up[u]], free[u] = at + size[u], at + 1
            at, paths, held, stack = [], [], 0, [names[start]]
            for u in rows[1:]:
                del stack[hops[u] :]
                stack.append(names[u])
                path = ">".join(stack) if joined else stack[:]
                at.append(u)
                paths.append(path)
                held += len(path)
                if held > WALK_SIZE or len(at) == WALK_ROWS:
                    yield at, np.array([known[u] for u in at], np.int64), paths
                    at, paths, held = [], [], 0
            if at:
                yield at, np.array([known[u] for u in at], np.int64), paths

        return go

    return walk


def cheapest_paths(seeds: DataFrame, sym: DataFrame, hops: int | None = None, joined: bool = False) -> DataFrame:
    """seed, id, cost, path: least-cost paths, of any length or of at most ``hops`` edges; an edge costs 1 / weight.

    Costs are added up in whole millionths, so that sums depend on no order or engine. Ties go to fewer hops, then to the path that sorts first. Each round keeps one path for each (seed, node) and goes on
    from those that changed. Paths of any length are walked from each seed in one task that holds the graph, if that has at most ``HELD_EDGES``; else rounds end when none changes.
    joined: paths as one text, ids joined by ">".
    """
    step = sym.select(F.col("src").alias("at"), F.col("dst").alias("id"), F.floor(1e6 / F.greatest("weight", F.lit(1e-6)) + 0.5).alias("c"))
    if hops is None:
        step = cut(step)
        if step.count() <= HELD_EDGES:
            found = _walks(seeds, step.select(F.col("at").alias("src"), F.col("id").alias("dst"), "c"), f"cost long, path {'string' if joined else 'array<string>'}", _cheapest(joined))
            return found.withColumn("cost", F.col("cost") / 1e6)
    best = seeds.select(F.col("id").alias("seed"), "id", F.lit(0).cast("long").alias("cost"), F.array("id").alias("path"))
    front, turn = best, 0
    while hops is None or turn < hops:
        turn += 1
        moved = front.select("seed", F.col("id").alias("at"), "cost", "path").join(step, "at").where(~F.array_contains("path", F.col("id")))
        moved = moved.select("seed", "id", (F.col("cost") + F.col("c")).alias("cost"), F.array_append("path", F.col("id")).alias("path"))
        order = F.struct("cost", F.size("path"), F.array_join("path", ">"))
        both = best.withColumn("new", F.lit(False)).unionByName(moved.withColumn("new", F.lit(True)))
        chosen = cut(both.groupBy("seed", "id").agg(F.min_by(F.struct("cost", "path", "new"), order).alias("p")).select("seed", "id", "p.*"))
        best, front = chosen.drop("new"), chosen.where("new").drop("new")
        if hops is None and front.isEmpty():
            break
    found = best.where("seed <> id").withColumn("cost", F.col("cost") / 1e6)
    return found.withColumn("path", F.array_join("path", ">")) if joined else found


def components(nodes: DataFrame, sym: DataFrame, most_rounds: int = 50) -> DataFrame:
    """id, component (its smallest id). Labels fall along edges and then jump, so that rounds grow with log(diameter)."""
    labels = nodes.select("id", F.col("id").alias("component"))
    for _ in range(most_rounds):
        near = sym.join(labels.select(F.col("id").alias("dst"), "component"), "dst").groupBy(F.col("src").alias("id")).agg(F.min("component").alias("near"))
        hooked = labels.join(near, "id", "left").select("id", F.col("component").alias("was"), F.least("component", "near").alias("component"))
        up = hooked.groupBy(F.col("was").alias("component")).agg(F.min("component").alias("up"))
        step = cut(hooked.join(up, "component", "left").select("id", "was", F.least("component", "up").alias("component")))
        labels = step.select("id", "component")
        if not step.where("was <> component").limit(1).count():
            return labels
    raise RuntimeError("components did not settle")


def tree_depth(nodes: DataFrame, most: int = 4) -> DataFrame:
    """id, depth: steps from a root (parent_id is null) down ``parent_id``, deeper ones counted as ``most``."""
    front = nodes.where("parent_id is null").select("id", F.lit(0).alias("depth"))
    out = front
    for depth in range(1, most + 1):
        children = nodes.select("id", "parent_id").join(front.select(F.col("id").alias("parent_id")), "parent_id").select("id")
        front = children.withColumn("depth", F.lit(depth))
        out = out.unionByName(front)
    rest = nodes.select("id").join(out, "id", "left_anti").withColumn("depth", F.lit(most))
    return out.unionByName(rest)


def induced(edges: DataFrame, keep: DataFrame) -> DataFrame:
    """Edges with both ends among ``keep`` (id)."""
    return edges.join(keep.select(F.col("id").alias("source_id")), "source_id", "left_semi").join(keep.select(F.col("id").alias("target_id")), "target_id", "left_semi")


def _wired(nodes: DataFrame, ahead) -> DataFrame:
    """source_id, target_id of the pairs that ``ahead`` (i and n -> array of other places, null for none) makes of nodes in id order, each once."""
    at = cut(numbered(nodes.select("id"), ["id"]))
    n = at.agg(F.count(F.lit(1)).alias("n"))
    out = at.crossJoin(F.broadcast(n)).withColumn("j", F.explode(ahead(F.col("i"), F.col("n")))).where("j is not null and i <> j")
    near = out.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).distinct()
    return near.join(at.select(F.col("id").alias("source_id"), "i"), "i").join(at.select(F.col("id").alias("target_id"), F.col("i").alias("j")), "j").select("source_id", "target_id")


def ring_lattice(nodes: DataFrame, reach: int = 2) -> DataFrame:
    """source_id, target_id: each node and the next ``reach`` in id order, the last ones and the first closing the ring."""
    at = cut(numbered(nodes.select("id"), ["id"]))
    n = at.agg(F.count(F.lit(1)).alias("n"))
    ahead = at.crossJoin(F.broadcast(n)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(reach))))
    ahead = ahead.select(F.col("id").alias("source_id"), F.pmod(F.col("i") + F.col("step"), F.col("n")).alias("j"))
    return ahead.join(at.select(F.col("id").alias("target_id"), F.col("i").alias("j")), "j").select("source_id", "target_id")


def hub_circulant(nodes: DataFrame) -> DataFrame:
    """source_id, target_id, each pair once: every node with the next two and the one half a ring ahead, and the first with every fourth."""
    half = lambda n: F.greatest(F.lit(1), F.floor(n / 2))
    return _wired(nodes, lambda i, n: F.array((i + 1) % n, (i + 2) % n, (i + half(n)) % n, F.when(i % 4 == 1, F.lit(0).cast("long"))))


def square_lattice(nodes: DataFrame) -> DataFrame:
    """source_id, target_id, each pair once: nodes in rows of equal length, as many rows as the root of their number, joined right and down."""
    columns = lambda n: F.ceil(n / F.greatest(F.lit(1), F.floor(F.sqrt(n.cast("double")))))
    right = lambda i, n: F.when(((i % columns(n)) + 1 < columns(n)) & (i + 1 < n), i + 1)
    return _wired(nodes, lambda i, n: F.array(right(i, n), F.when(i + columns(n) < n, i + columns(n))))


def rewire(edges: DataFrame, seed: int, swaps_per_edge: int = 4) -> DataFrame:
    """a, b: the pairs after seeded double-edge swaps, which keep every node's degree.

    In each round pairs are dealt anew into couples, each of which proposes one swap, so that ``swaps_per_edge`` swaps are
    proposed for each pair in all. A swap is accepted where none of its new pairs is there or proposed twice.
    """
    pair = cut(pairs(edges).select("a", "b"))
    blocks = max(1, pair.count() // 1000)
    for k in range(2 * swaps_per_edge):
        dealt = pair.select("a", "b", F.xxhash64("a", "b", F.lit(seed), F.lit(k)).alias("h"), F.pmod(F.xxhash64("a", "b", F.lit(seed), F.lit(-1 - k)), F.lit(blocks)).alias("block"))
        order = Window.partitionBy("block").orderBy("h", "a", "b")
        couples = dealt.select("a", "b", "h", F.row_number().over(order).alias("i"), F.lead("a").over(order).alias("c"), F.lead("b").over(order).alias("d")).where("i % 2 = 1 and c is not null")
        couples = couples.where("a <> c and a <> d and b <> c and b <> d")
        # either end of the second pair may go to a
        x, y = F.when(F.col("h") % 2 == 0, F.col("d")).otherwise(F.col("c")), F.when(F.col("h") % 2 == 0, F.col("c")).otherwise(F.col("d"))
        made = [F.struct(F.least("a", x).alias("a"), F.greatest("a", x).alias("b")), F.struct(F.least("b", y).alias("a"), F.greatest("b", y).alias("b"))]
        proposed = couples.select(F.struct("a", "b", "c", "d").alias("swap"), F.explode(F.array(*made)).alias("new")).select("swap", "new.*")
        once = proposed.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.first("swap").alias("swap")).where("n = 1").join(pair, ["a", "b"], "left_anti")
        done = cut(once.groupBy("swap").agg(F.collect_list(F.struct("a", "b")).alias("new")).where(F.size("new") == 2))
        gone = done.select(F.explode(F.array(F.struct("swap.a", "swap.b"), F.struct(F.col("swap.c").alias("a"), F.col("swap.d").alias("b")))).alias("p")).select("p.*")
        pair = cut(pair.join(gone, ["a", "b"], "left_anti").unionByName(done.select(F.explode("new").alias("p")).select("p.*")))
    return pair
