"""Experiments over the operators: sweeps, masks, rotations, learned weights, a sleep pass."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..sources.manifest import Manifest
from . import dynamics, evaluation, gists, graph, lexical, placement, retrieval
from .durable import cut


def leave_one_out() -> dict[str, tuple[str, ...]]:
    """minus_c for each weighted component, and the vector alone."""
    used = tuple(c for c, w in retrieval.WEIGHTS.items() if w > 0)
    return {f"minus_{c}": tuple(x for x in used if x != c) for c in used} | {"vector_only": ("semantic",)}


def rotated(vectors: DataFrame, column: str, dims: int, seed: int) -> DataFrame:
    """The vectors turned by a seeded orthogonal matrix, which changes no cosine."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    turn = q * np.sign(np.diag(r))

    @F.pandas_udf("array<double>")
    def turned(v: pd.Series) -> pd.Series:
        return pd.Series(list(np.stack(v.to_numpy()).astype(np.float64) @ turn.T)) if len(v) else v

    return vectors.withColumn(column, turned(F.col(column)))


def rotation_agreement(nodes: DataFrame, queries: DataFrame, dims: int, seed: int = 3, k: int = 8) -> DataFrame:
    """query_id, jaccard, top1: how far a rotated world gives the same results."""
    ids = lambda r: r.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "id"))).alias("r")).select("query_id", F.transform("r", lambda x: x["id"]).alias("ids"))
    a = ids(retrieval.vector_topk(nodes, queries, k))
    b = ids(retrieval.vector_topk(rotated(nodes, "embedding", dims, seed), rotated(queries, "vector", dims, seed), k)).withColumnRenamed("ids", "other")
    same = F.size(F.array_intersect("ids", "other")) / F.size(F.array_union("ids", "other"))
    return a.join(b, "query_id").select("query_id", same.alias("jaccard"), (F.col("ids")[0] == F.col("other")[0]).cast("double").alias("top1"))


def masked_lab(nodes: DataFrame, queries: DataFrame, gold: DataFrame, task: str, steps: list[int], k: int = 8) -> DataFrame:
    """step, task, n, recall, mrr: tasks up to a step are known, and every known task is tested again at each step.

    Nodes are masked before the nearest are taken. queries: query_id, vector, task.
    """
    out = None
    for step in steps:
        runs = retrieval.vector_topk(nodes.where(F.col(task) <= step), queries.where(F.col("task") <= step), k)
        per = evaluation.ranking_metrics(runs, gold, k).join(queries.select("query_id", "task"), "query_id")
        row = per.groupBy("task").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg("mrr"), 6).alias("mrr")).withColumn("step", F.lit(step))
        out = row if out is None else out.unionByName(row)
    return out


def plan_tasks(members: DataFrame, tasks: int) -> tuple[DataFrame, DataFrame]:
    """(title, task), (question, task, step): questions go to tasks by hash, a title to the earliest task that needs it, and a
    question is tested once its own task and those of all its titles are there; members: question, title."""
    asked = members.select("question", "title", F.pmod(F.xxhash64("question"), F.lit(tasks)).cast("int").alias("task"))
    owner = asked.groupBy("title").agg(F.min("task").alias("owner"))
    when = asked.join(owner, "title").groupBy("question", "task").agg(F.max(F.least("owner", "task")).alias("step"))
    return owner.withColumnRenamed("owner", "task"), when.select("question", "task", F.greatest("step", "task").alias("step"))


def placed_runs(nodes: DataFrame, edges: DataFrame, queries: DataFrame, now: Column, strategies: tuple[str, ...], k: int = 8) -> DataFrame:
    """strategy, query_id, id, rank of the full ranking after each placement.

    Candidates are scored once, with each node in the innermost ring that a strategy gives it; a strategy then takes its
    own ring and distance, and of the candidates that only share words with a query those that it puts into inner rings.
    """
    parts = [placement.place(nodes, edges, s, now).select(F.lit(s).alias("strategy"), "id", F.col("ring").alias("own"), F.col("radial_distance").alias("far")) for s in strategies]
    spots = cut(reduce(DataFrame.unionByName, parts))
    inner = nodes.drop("ring").join(spots.groupBy("id").agg(F.min("own").alias("ring")), "id")
    on, full = retrieval.ground(inner, edges, queries), tuple(retrieval.WEIGHTS)
    at = spots.groupBy("id").agg(*[F.max(F.when(F.col("strategy") == s, F.struct("own", "far"))).alias(f"_{s}") for s in strategies])
    flat = retrieval.plain(inner.where("ring <= 1").join(at, "id"), inner, edges, now, on=on, more=tuple(f"_{s}" for s in strategies))
    score_of = lambda s: retrieval.weighted(full, own={"structural": retrieval.structural(F.col(f"_{s}.own")), "radial": retrieval.nearness(F.col(f"_{s}.far"))})
    rest = F.array(*[F.when(F.col(f"_{s}.own") <= 1, score_of(s)) for s in strategies])
    systems = [(full, retrieval.WEIGHTS)] * len(strategies)
    leads = lambda union: retrieval.leading(flat.select("id", "embedding", "words", rest.alias("rest")), queries, union, systems, k)
    scored = retrieval.components(retrieval.candidates(inner, edges, queries, on=on, leads=leads), inner, edges, queries, now, on=on)
    each = scored.join(spots, "id").where((F.col("channel") != 3) | (F.col("own") <= 1))
    each = each.withColumns({"structural": retrieval.structural(F.col("own")), "radial": retrieval.nearness(F.col("far"))})
    score = N.rounded(retrieval.weighted(tuple(retrieval.WEIGHTS)), 9)
    w = Window.partitionBy("strategy", "query_id").orderBy(F.col("score").desc(), "id")
    return each.withColumn("score", score).withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k).select("strategy", "query_id", "id", "rank")


def strategy_sweep(nodes: DataFrame, edges: DataFrame, queries: DataFrame, gold: DataFrame, now: Column, strategies: tuple[str, ...], k: int = 8) -> DataFrame:
    """strategy, n, recall, precision, mrr of the full ranking after each placement."""
    runs = placed_runs(nodes, edges, queries, now, strategies, k)
    return evaluation.means(evaluation.ranking_metrics(runs, gold, k, ["strategy"]), ["recall", "precision", "mrr"], ["strategy"])


def by_language(docs: DataFrame, queries: DataFrame, key: str, k: int = 8) -> DataFrame:
    """lang, query_id, key, score, rank: the lexical ranker over the documents of each language alone.

    Each language has an index of its own (its frequencies and mean length); documents without a language are one too.
    """
    return lexical.bm25(docs, key, queries, k, by="lang").select("lang", "query_id", key, "score", "rank")


def language_runs(nodes: DataFrame, edges: DataFrame, queries: DataFrame, text: Column, k: int = 8) -> DataFrame:
    """system, lang, query_id, id, rank: the vector, graph and lexical rankers, each query among the nodes of its own language.

    nodes: with lang; queries: query_id, lang, vector, query. No ranker is run once a language: vectors of other languages
    have no score, edges between languages fall out, and the lexical ranker holds an index for each.
    """
    of = nodes.select("id", F.coalesce("lang", F.lit("")).alias("own"))
    end = lambda c: of.select(F.col("id").alias(f"{c}_id"), F.col("own").alias(c))
    within = edges.join(end("source"), "source_id").join(end("target"), "target_id").where("source = target").drop("source", "target")
    mine = queries.select("query_id", "lang")
    cols = ["query_id", "id", "rank"]
    words = lexical.bm25(nodes.select("id", text.alias("text"), "lang"), "id", queries.select("query_id", "query"), k, by="lang")
    words = words.join(mine.withColumnRenamed("lang", "asked"), "query_id").where(F.col("lang").eqNullSafe(F.col("asked")))
    runs = {"flat_vector": retrieval.vector_topk(nodes, queries, k, by="lang"), "graph_rag": retrieval.graph_rag(nodes, within, queries, k, by="lang"), "bm25": words}
    parts = [r.select(F.lit(s).alias("system"), *cols) for s, r in runs.items()]
    return reduce(DataFrame.unionByName, parts).join(mine, "query_id").select("system", "lang", *cols)


def learned_weights(scored: DataFrame, gold: DataFrame, rounds: int = 20, rate: float = 0.5, more: Callable[[Callable], np.ndarray | None] | None = None) -> dict[str, float]:
    """Weights of a logistic unit over the components: whole-data delta-rule rounds, none below 0, adding up to 1.

    scored: rows of ``retrieval.components``; gold: query_id, id. Each round is one aggregate of eleven sums. Without any
    positive weight all are equal. more: ``retrieval.word_sums`` of rows beside ``scored``, which are met anew in each round.
    """
    names = [c for c in retrieval.WEIGHTS if c not in ("stability", "constellation")]
    column = {c: "path_score" if c == "path" else c for c in names}
    data = cut(scored.join(gold.withColumn("y", F.lit(1.0)), ["query_id", "id"], "left").select(*[F.col(column[c]).alias(c) for c in names], F.coalesce("y", F.lit(0.0)).alias("y")))
    w, bias = dict.fromkeys(names, 0.0), 0.0
    for _ in range(rounds):
        error = F.col("y") - N.sigmoid(sum((F.col(c) * w[c] for c in names), F.lit(bias)))
        step = data.agg(*[F.avg(error * F.col(c)).alias(c) for c in names], F.avg(error).alias("bias"), F.count(error).alias("n")).first()
        added = more(_word_errors(names, w, bias)) if more else None
        if added is not None:
            n = step["n"] + float(added[-1])
            step = {c: ((step[c] or 0.0) * step["n"] + float(x)) / n if n else 0.0 for c, x in zip([*names, "bias"], added)}
        w, bias = {c: w[c] + rate * (step[c] or 0.0) for c in names}, bias + rate * (step["bias"] or 0.0)
    floor = {c: max(0.0, v) for c, v in w.items()}
    total = sum(floor.values())
    return {c: (v / total if total else 1 / len(names)) for c, v in floor.items()}


def _word_errors(names: list[str], w: dict[str, float], bias: float) -> Callable:
    """A step of ``retrieval.word_sums``: the sums of error times each component, of errors, and the number of rows."""
    of_node = [c for c in names if c in retrieval.OF_NODE]
    # of the others, all but the semantic one are the same in all rows
    fixed = {c: retrieval.PLAIN["path_score" if c == "path" else c] for c in names if c not in of_node and c != "semantic"}

    def step(b: pd.DataFrame, meets: np.ndarray, near: np.ndarray, same: np.ndarray) -> np.ndarray:
        x = b[of_node].to_numpy(np.float64)
        meets = meets & ~np.isnan(x).any(axis=1)[None]
        x = np.nan_to_num(x)
        z = near * w["semantic"] + (x @ np.array([w[c] for c in of_node]) + sum(w[c] * v for c, v in fixed.items()) + bias)[None]
        error = np.where(meets, same - 1 / (1 + np.exp(-np.clip(z, -30.0, 30.0))), 0.0)
        each = error.sum(axis=0)
        sums = {"semantic": (error * near).sum()} | dict(zip(of_node, each @ x)) | {c: v * each.sum() for c, v in fixed.items()}
        return np.array([*[sums[c] for c in names], each.sum(), meets.sum()], np.float64)

    return step


def of_group(runs: DataFrame, nodes: DataFrame, queries: DataFrame, group: str) -> DataFrame:
    """query_id, id of the rows of ``runs`` whose node has the query's ``group``."""
    own = runs.select("query_id", "id").distinct().join(nodes.select("id", F.col(group).alias("_g")), "id")
    return own.join(queries.select("query_id", F.col(group).alias("_q")), "query_id").where("_g = _q").select("query_id", "id")


def world_weights(nodes: DataFrame, edges: DataFrame, queries: DataFrame, group: str, now: Column, rounds: int = 20) -> dict[str, float]:
    """``learned_weights`` over all candidates of a world, where a query looks for the nodes of its ``group``.

    The candidates that only words lead to, whose number grows with queries times nodes, become no rows.
    """
    on = retrieval.ground(nodes, edges, queries)
    scored = cut(retrieval.components(retrieval.candidates(nodes, edges, queries.drop("query"), on=on), nodes, edges, queries, now, on=on))
    rows = retrieval.plain(nodes.where("ring <= 1"), nodes, edges, now, on=on, more=(group,))
    return learned_weights(scored, of_group(scored, nodes, queries, group), rounds, more=retrieval.word_sums(rows, queries, scored, group))


def held_out_world(nodes: DataFrame, edges: DataFrame, queries: DataFrame, group: str, now: Column, groups: DataFrame, share: float = 0.25, seed: int = 42, k: int = 8) -> tuple[dict[str, float], DataFrame]:
    """``held_out`` over all candidates of a world: no more than can rank are rows, of the questions held out alone."""
    from .benchmarks import grouped_split

    side = cut(grouped_split(groups.select("query_id", "group"), "group", share, seed).select("query_id", "side"))
    weights = world_weights(nodes, edges, queries.join(side.where("side = 'train'"), "query_id", "left_semi"), group, now)
    asked = cut(queries.join(side.where("side = 'holdout'"), "query_id", "left_semi"))
    systems = {"fixed": retrieval.WEIGHTS, "learned": retrieval.WEIGHTS | dict.fromkeys(retrieval.WEIGHTS, 0.0) | weights}
    scored = cut(retrieval.scored_candidates(nodes, edges, asked, now, systems=[(tuple(w), w) for w in systems.values()], k=k))
    runs = cut(reduce(DataFrame.unionByName, [retrieval.rank_scored(scored, tuple(w), k, w).select(F.lit(s).alias("system"), "query_id", "id", "rank") for s, w in systems.items()]))
    wanted = asked.select("query_id", group).join(nodes.groupBy(group).agg(F.count(F.lit(1)).alias("wanted")), group).select("query_id", "wanted")
    per = evaluation.ranking_metrics(runs, of_group(runs, nodes, asked, group), k, ["system"], wanted)
    return weights, evaluation.means(per, ["recall", "precision", "mrr"], ["system"])


def held_out(scored: DataFrame, gold: DataFrame, groups: DataFrame, share: float = 0.25, seed: int = 42, k: int = 8) -> tuple[dict[str, float], DataFrame]:
    """Weights learned from the questions of some groups, and how they rank those of the others: (weights), (system, n, recall, precision, mrr).

    groups: query_id, group, as the document that a question comes from; no group is on both sides
    (``benchmarks.grouped_split``). Systems are the fixed weights and the learned ones, over the same scored candidates.
    """
    from .benchmarks import grouped_split

    side = cut(grouped_split(groups.select("query_id", "group"), "group", share, seed).select("query_id", "side"))
    weights = learned_weights(scored.join(side.where("side = 'train'"), "query_id", "left_semi"), gold)
    asked = cut(scored.join(side.where("side = 'holdout'"), "query_id", "left_semi"))
    out = None
    for name, used in (("fixed", retrieval.WEIGHTS), ("learned", retrieval.WEIGHTS | dict.fromkeys(retrieval.WEIGHTS, 0.0) | weights)):
        per = evaluation.ranking_metrics(retrieval.rank_scored(asked, tuple(used), k, used), gold, k).withColumn("system", F.lit(name))
        out = per if out is None else out.unionByName(per)
    return weights, evaluation.means(out, ["recall", "precision", "mrr"], ["system"])


def save_weights(manifest: Manifest, weights: dict[str, float]) -> int:
    """Commits weights as the next version of a store; of two writers the later one counts."""
    return manifest.change(lambda says: says | {"weights": {c: float(w) for c, w in weights.items()}})


def load_weights(manifest: Manifest, version: int | None = None) -> dict[str, float]:
    """The stored weights, of the newest version unless one is given; the fixed ones where none are."""
    says = manifest.current()[1] if version is None else manifest.at(version)
    return retrieval.WEIGHTS | says.get("weights", {})


def sleep(nodes: DataFrame, edges: DataFrame, now: Column, replays: int = 100, most_gists: int = 24) -> tuple[DataFrame, DataFrame]:
    """(id, importance, stability), gists: replay of the neediest, then decay of the others, then summaries; nothing is placed anew."""
    stated = dynamics.with_state(nodes, graph.incidence(edges))
    awake = dynamics.replay(stated, dynamics.select_replay(stated, now, replays), now)
    faded = dynamics.decay(stated.join(awake.select("id"), "id", "left_anti"), dynamics.adaptive_retention(now))
    after = awake.select("id", F.col("new_importance").alias("importance"), F.col("new_stability").alias("stability"))
    return after.unionByName(faded.select("id", F.col("new_importance").alias("importance"), "stability")), gists.build(nodes, most=most_gists)


def inner_share(nodes: DataFrame, least_nodes: int = 2000, least_share: float = 0.02) -> DataFrame:
    """One row: nodes, inner (rings 0 and 1), sound: whether the inner rings have kept a share of a large graph."""
    return nodes.agg(F.count(F.lit(1)).alias("nodes"), F.count_if(F.col("ring") <= 1).alias("inner")).withColumn("sound", (F.col("nodes") <= least_nodes) | (F.col("inner") / F.col("nodes") >= least_share))
