"""Worlds that differ in little: a base table of nodes and overlays of what an arm of a study has changed.

An overlay has a row only for nodes that an arm has touched, with the columns it changes. What does not depend on them
(vector hits, pairs, paths) is worked out once and shared by all arms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import benchmarks, dynamics, evaluation, experiments, graph, retrieval
from .durable import cut

COHORTS = ("aged_replayed", "aged_faded", "recent")


def overlaid(base: DataFrame, overlay: DataFrame) -> DataFrame:
    """``base`` with the columns of ``overlay`` (id, ...) in place of its own for the rows that the overlay has."""
    changed = [c for c in overlay.columns if c != "id"]
    over = overlay.select("id", F.struct(*changed).alias("_over"))
    out = base.join(over, "id", "left")
    return out.select(*[F.when(F.col("_over").isNotNull(), F.col(f"_over.{c}").cast(base.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in changed else F.col(c) for c in base.columns])


def stacked(lower: DataFrame, upper: DataFrame) -> DataFrame:
    """One overlay of two of the same columns: rows of ``upper`` stand over those of ``lower``."""
    return lower.join(upper.select("id"), "id", "left_anti").unionByName(upper)


def aged(nodes: DataFrame, now: Column, share: float = 0.8, days: int = 60, seed: int = 42) -> DataFrame:
    """Overlay (id, updated_at): a drawn share of the nodes has not been changed for some days."""
    return nodes.where(benchmarks.drawn(F.col("id"), seed, share)).select("id", (now - F.make_dt_interval(F.lit(days))).alias("updated_at"))


def ageing(nodes: DataFrame, edges: DataFrame, queries: DataFrame, gold: DataFrame, now: Column, share: float = 0.8, days: int = 60, half_life: float = 21.0, replayed: float = 0.5, seed: int = 42, k: int = 8) -> DataFrame:
    """cohort, n, mrr and recall before and after, and their differences: what ageing does to questions.

    A drawn share of the nodes ages. Of the aged ones that questions (gold: query_id, id) need, a drawn part is replayed
    and so used now; then everything fades by what it has left. A question belongs to those with a replayed node, else
    to those with an aged one, else to the recent. Both worlds are ranked in full.
    """
    on = retrieval.ground(nodes, edges, queries)
    records = graph.incidence(edges)
    old = cut(aged(nodes, now, share, days, seed))
    wanted = cut(gold.select("id").distinct().join(old.select("id"), "id", "left_semi").where(benchmarks.drawn(F.col("id"), seed + 1, replayed)))
    world = overlaid(nodes, old)
    used = world.join(wanted, "id", "left_semi").select("id", dynamics.lifted(F.col("importance")).alias("importance"), now.alias("updated_at"))
    rest = world.join(wanted, "id", "left_anti").join(records, "id", "left").withColumn("records", F.coalesce("records", F.lit(0)))
    faded = dynamics.decay(rest, dynamics.soft_retention(now, half_life)).where("faded").select("id", F.col("new_importance").alias("importance"), "updated_at")
    later = overlaid(nodes, cut(stacked(faded, used)))
    rows = []
    for name, arm in (("before", nodes), ("after", later)):
        ranked = retrieval.rank_scored(retrieval.scored_candidates(arm, edges, queries, now, on, [(tuple(retrieval.WEIGHTS), retrieval.WEIGHTS)], k), tuple(retrieval.WEIGHTS), k)
        per = evaluation.ranking_metrics(ranked, gold, k)
        rows.append(per.select("query_id", F.col("mrr").alias(f"mrr_{name}"), F.col("recall").alias(f"recall_{name}")))
    marks = gold.join(old.select("id", F.lit(1).alias("aged")), "id", "left").join(wanted.withColumn("used", F.lit(1)), "id", "left")
    cohort = marks.groupBy("query_id").agg(F.when(F.max("used") == 1, COHORTS[0]).when(F.max("aged") == 1, COHORTS[1]).otherwise(COHORTS[2]).alias("cohort"))
    both = rows[0].join(rows[1], "query_id").join(cohort, "query_id")
    mean = lambda c: F.round(F.avg(c), 6)
    return both.groupBy("cohort").agg(
        F.count(F.lit(1)).alias("n"), *[mean(f"{m}_{w}").alias(f"{m}_{w}") for m in ("mrr", "recall") for w in ("before", "after")], *[mean(F.col(f"{m}_after") - F.col(f"{m}_before")).alias(f"{m}_change") for m in ("mrr", "recall")]
    )


def nested_sample(nodes: DataFrame, group: str, shares: list[float], seed: int = 42) -> DataFrame:
    """share, id: nodes of a drawn share of the groups, for each share; a smaller one's groups are among a larger one's.

    Groups have one priority each and a rung takes all below its own bound, so no rung is drawn anew.
    """
    each = F.explode(F.array(*[F.when(F.lit(s >= 1.0) | benchmarks.drawn(F.col(group), seed, s), F.lit(float(s))) for s in sorted(shares)])).alias("share")
    return nodes.select("id", group, each).where("share is not null").select("share", "id")


def with_hubs(kept: DataFrame, sym: DataFrame, least: int = 2) -> DataFrame:
    """share, id: what is kept, and nodes outside with at least ``least`` neighbours in it."""
    near = kept.join(sym.select(F.col("src").alias("id"), "dst"), "id").groupBy("share", F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    hubs = near.where(F.col("n") >= least).join(kept, ["share", "id"], "left_anti").select("share", "id")
    return kept.unionByName(hubs)


def rungs(nodes: DataFrame, edges: DataFrame, group: str, shares: list[float], seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(share, id), (share and the columns of edges): the graphs induced by nested parts of a world and the hubs round them."""
    sym = graph.symmetric(cut(graph.pairs(edges)))
    members = cut(with_hubs(nested_sample(nodes, group, shares, seed), sym))
    end = lambda c: members.select("share", F.col("id").alias(c))
    return members, edges.join(end("source_id"), "source_id").join(end("target_id"), ["share", "target_id"]).select("share", *edges.columns)


def ladder(nodes: DataFrame, edges: DataFrame, queries: DataFrame, now: Column, group: str, shares: list[float], strategies: tuple[str, ...], least_degree: int = 5, seed: int = 42, k: int = 8) -> DataFrame:
    """share, strategy, nodes, n, mrr, recall: every placement strategy over ``rungs`` of a world.

    Questions are a rung's own: of ``queries`` (query_id, id, vector and more) those whose node is in it with
    ``least_degree`` neighbours or more, which are to be found; a rung without any has no row. All strategies of a rung
    are ranked over one set of scored candidates.
    """
    members, wires = rungs(nodes, edges, group, shares, seed)
    wires, out = cut(wires), None
    for share in sorted(shares):
        mine = members.where(F.col("share") == float(share)).select("id")
        part, wired = cut(nodes.join(mine, "id", "left_semi")), wires.where(F.col("share") == float(share)).drop("share")
        near = cut(graph.symmetric(graph.pairs(wired)))
        busy = near.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree")).where(F.col("degree") >= least_degree)
        asked = cut(queries.join(busy.select("id"), "id", "left_semi"))
        if asked.isEmpty():
            continue
        gold = asked.select("query_id", F.col("id").alias("src")).join(near, "src").select("query_id", F.col("dst").alias("id"))
        runs = experiments.placed_runs(part, wired, asked.drop("id"), now, strategies, k)
        per = evaluation.ranking_metrics(runs, gold, k, ["strategy"])
        row = per.groupBy("strategy").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("mrr"), 6).alias("mrr"), F.round(F.avg("recall"), 6).alias("recall"))
        row = row.crossJoin(F.broadcast(part.agg(F.count(F.lit(1)).alias("nodes")))).select(F.lit(float(share)).alias("share"), "strategy", "nodes", "n", "mrr", "recall")
        out = row if out is None else out.unionByName(row)
    return nodes.sparkSession.createDataFrame([], "share double, strategy string, nodes long, n long, mrr double, recall double") if out is None else out
