"""Benchmarks of rankers: runs of many systems, answers in passages, cohorts, samples, splits and training pairs."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import text as T
from . import evaluation, lexical, placement, retrieval
from .durable import cut
from .order import numbered

#: Weight of the constellation component where it is on.
CONSTELLATION = 0.08
#: Positive pairs up to which they go to the candidates; more are joined by a shuffle.
HELD_HITS = 500_000
METRICS = ["recall", "precision", "mrr"]


def compare(runs: DataFrame, gold: DataFrame, k: int = 8) -> DataFrame:
    """system, n, recall, precision, mrr and the numbers of scored rows: the table of systems; runs: system, query_id, id, rank."""
    return evaluation.means(evaluation.ranking_metrics(runs, gold, k, ["system"]), METRICS, ["system"])


def run_systems(nodes: DataFrame, edges: DataFrame, queries: DataFrame, now: Column, k: int = 8) -> DataFrame:
    """system, query_id, id, rank: the flat and graph rankers and all named subsets of the full one, over one candidate set."""
    cols = ["system", "query_id", "id", "rank"]
    flat = retrieval.vector_topk(nodes, queries, k).withColumn("system", F.lit("flat_vector")).select(cols)
    walk = retrieval.graph_rag(nodes, edges, queries, k).withColumn("system", F.lit("graph_rag")).select(cols)
    return flat.unionByName(walk).unionByName(retrieval.ablate(nodes, edges, queries, now, k=k).select(cols))


def rankers(nodes: DataFrame, edges: DataFrame, queries: DataFrame, now: Column, text: Column, tree: DataFrame, k: int = 8) -> dict[str, Callable[[], DataFrame]]:
    """system -> its runs (query_id, id, rank): full, flat_vector, graph_rag, bm25 over each node's ``text``, hierarchical over ``tree``.

    tree: id, parent_id, ring, label; queries: query_id, vector, query.
    """
    texts = nodes.select("id", text.alias("text"))
    cols = ["query_id", "id", "rank"]
    return {
        "full": lambda: retrieval.retrieve(nodes, edges, queries, now, k=k).select(cols),
        "flat_vector": lambda: retrieval.vector_topk(nodes, queries, k).select(cols),
        "graph_rag": lambda: retrieval.graph_rag(nodes, edges, queries, k).select(cols),
        "bm25": lambda: lexical.bm25(texts, "id", queries.select("query_id", "query"), k).select(cols),
        "hierarchical": lambda: retrieval.hierarchical_rag(tree, queries.select("query_id", "query"), k).select(cols),
    }


def benchmark(systems: dict[str, Callable[[], DataFrame]], gold: DataFrame, queries: DataFrame, k: int = 8) -> tuple[DataFrame, DataFrame]:
    """(system, query_id, recall, precision, mrr), (system, questions, seconds, questions_per_s).

    Each system's runs are written before the next one starts, which is what is timed. Questions for which a system finds
    nothing count 0.
    """
    n, rows, speed = queries.count(), None, []
    for name, run in systems.items():
        began = time.perf_counter()
        found = cut(run())
        took = time.perf_counter() - began
        speed.append((name, n, round(took, 3), round(n / took, 3)))
        per = queries.select("query_id").join(evaluation.ranking_metrics(found, gold, k), "query_id", "left")
        per = per.select(F.lit(name).alias("system"), "query_id", *[F.coalesce(m, F.lit(0.0)).alias(m) for m in METRICS])
        rows = per if rows is None else rows.unionByName(per)
    return rows, queries.sparkSession.createDataFrame(speed, "system string, questions long, seconds double, questions_per_s double")


def over_seeds(rows: DataFrame, seeds: list[int], share: float = 0.5, by: tuple[str, ...] = ("system",)) -> DataFrame:
    """by, seeds, and of each metric the mean over seeds and their population deviation (_dev): each seed draws a share of the questions.

    A seed that draws none of a group's questions does not count for it.
    """
    each = F.explode(F.array(*[F.when(drawn(F.col("query_id"), s, share), F.lit(s)) for s in seeds])).alias("seed")
    one = rows.select(*by, *METRICS, each).where("seed is not null").groupBy(*by, "seed").agg(*[F.avg(m).alias(m) for m in METRICS])
    out = [f(m).alias(n) for m in METRICS for f, n in ((lambda c: F.round(F.avg(c), 6), m), (lambda c: F.round(F.stddev_pop(c), 6), f"{m}_dev"))]
    return one.groupBy(*by).agg(F.count(F.lit(1)).alias("seeds"), *out)


def cluster_kernel(nodes: DataFrame, queries: DataFrame, group: str, most: int = 3, amplitudes: bool = False) -> DataFrame:
    """query_id, id, kernel: what each query shares with each node of their ``most`` nearest centroids of ``group``."""
    k = memberships(nodes, queries, group, most, amplitudes)
    return placement.overlap(k.asked, k.members, k.amplitudes)


def memberships(nodes: DataFrame, queries: DataFrame, group: str, most: int = 3, amplitudes: bool = False) -> retrieval.Kernel:
    centroids = cut(placement.centroid(nodes, [group]).withColumnRenamed(group, "cid"))
    asked = placement.membership(queries.select(F.col("query_id").alias("id"), F.col("vector").alias("embedding")), centroids, most)
    return retrieval.Kernel(cut(asked.withColumnRenamed("id", "query_id")), cut(placement.membership(nodes, centroids, most)), amplitudes)


def constellation_runs(nodes: DataFrame, edges: DataFrame, queries: DataFrame, now: Column, arms: dict[str, tuple[int, bool] | None], group: str, k: int = 8) -> DataFrame:
    """system, query_id, id, score, rank: the full ranker under each arm, a (clusters, amplitudes) kernel or None for off.

    Candidates are drawn once for all arms; a kernel is worked out for these alone.
    """
    out, on = None, retrieval.ground(nodes, edges, queries)
    weights = {n: retrieval.WEIGHTS | ({} if arm is None else {"constellation": CONSTELLATION}) for n, arm in arms.items()}
    systems = [(tuple(w), w) for w in weights.values()]
    kernels = {i: memberships(nodes, queries, group, *arm) for i, arm in enumerate(arms.values()) if arm}
    leads = lambda union: retrieval.leading(retrieval.resting(nodes, edges, now, systems, on=on, kernels=kernels), queries, union, systems, k, kernels)
    cands = retrieval.candidates(nodes, edges, queries, on=on, leads=leads)
    for i, name in enumerate(arms):
        kernel = None
        if i in kernels:
            kernel = placement.overlap(kernels[i].asked, cands.select("query_id", "id").join(kernels[i].members, "id"), kernels[i].amplitudes, ["query_id", "cid"])
        scored = retrieval.components(cands, nodes, edges, queries, now, kernel=kernel, on=on)
        scored = scored.withColumn("score", N.rounded(retrieval.weighted(*systems[i]), 9))
        run = retrieval.top(scored, [F.col("score").desc(), F.col("id")], k).select(F.lit(name).alias("system"), "query_id", "id", "score", "rank")
        out = run if out is None else out.unionByName(run)
    return out


def answer_quality(passages: DataFrame, answers: DataFrame) -> DataFrame:
    """query_id, coverage, found; passages: query_id, text; answers: query_id, answer.

    coverage: the largest share of the answer's distinct words that one passage has. found: whether the answer's words
    stand in a row in some passage. A query without an answer or a passage has 0 and 0.
    """
    words = lambda c: T.words(F.coalesce(c, F.lit("")))
    gold = answers.select("query_id", words(F.col("answer")).alias("gold"))
    both = gold.join(passages.select("query_id", words(F.col("text")).alias("has")), "query_id", "left").withColumn("has", F.coalesce("has", F.array().cast("array<string>")))
    share = F.size(F.array_intersect("gold", "has")) / F.size(F.array_distinct("gold"))
    padded = lambda c: F.concat(F.lit(" "), F.array_join(c, " "), F.lit(" "))
    row = both.select("query_id", F.when(F.size("gold") > 0, share).otherwise(0.0).alias("c"), ((F.size("gold") > 0) & F.contains(padded("has"), padded("gold"))).alias("f"))
    return row.groupBy("query_id").agg(F.round(F.max("c"), 6).alias("coverage"), F.max(F.col("f").cast("int")).alias("found"))


def draw(key: Column, seed: int) -> Column:
    """A number for each key in which a seed puts rows in order, the same in every run and engine."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"))


def drawn(key: Column, seed: int, share: float) -> Column:
    """Whether a seed draws a row: a share of all, the same rows in every run and engine."""
    return draw(key, seed) < f"{min(int(share * 16**8), 16**8 - 1):08x}"


def sample(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows, drawn by seed and key; all of them where n is 0 or there are no more."""
    return rows.orderBy(draw(F.col(key), seed), key).limit(n) if n > 0 else rows


def grouped_split(rows: DataFrame, group: str, share: float = 0.25, seed: int = 42) -> DataFrame:
    """Adds side: "holdout" for the rows of a drawn share of the groups, two at least, else "train", so that no group is in both.

    Groups are counted and ranked, rows only join them; those without a group are left out.
    """
    groups = rows.where(F.col(group).isNotNull()).select(group).distinct()
    ordered = cut(numbered(groups.withColumn("_draw", draw(F.col(group), seed)), ["_draw", group]))
    n = ordered.agg(F.greatest(F.lit(2), F.floor(F.count(F.lit(1)) * share)).alias("n"))
    ordered = ordered.crossJoin(F.broadcast(n))
    return rows.join(ordered.select(group, F.when(F.col("i") < F.col("n"), "holdout").otherwise("train").alias("side")), group)


def training_pairs(scored: DataFrame, own: DataFrame, sym: DataFrame) -> DataFrame:
    """Rows of ``retrieval.components`` with label: 1 for the node that a query asks for and its neighbours, else 0; own: query_id, id."""
    near = own.join(sym.select(F.col("src").alias("id"), "dst"), "id").select("query_id", F.col("dst").alias("id"))
    hit = cut(own.select("query_id", "id").union(near).distinct().withColumn("label", F.lit(1)))
    # few hits go to the rows, which then need no shuffle
    hit = F.broadcast(hit) if hit.count() <= HELD_HITS else hit
    return scored.join(hit, ["query_id", "id"], "left").withColumn("label", F.coalesce("label", F.lit(0)))


def cohort_means(rows: DataFrame, cohorts: DataFrame, metrics: list[str]) -> DataFrame:
    """cohort, n and the means of metrics (a missing one counts 0) of the rows of each cohort; both with query_id."""
    means = [F.round(F.avg(F.coalesce(m, F.lit(0.0))), 4).alias(m) for m in metrics]
    return rows.join(cohorts.select("query_id", "cohort"), "query_id").groupBy("cohort").agg(F.count(F.lit(1)).alias("n"), *means)


def supersede(stated: DataFrame, replaced: DataFrame, now: Column) -> DataFrame:
    """The replaced memories as history: a version more, protected, settled, and named with what replaces them.

    stated: id, memory_version (1 where it is no column); replaced: id, by. Their validity stays, so that questions about
    the past still find them. Pairs with an unknown end, or of a memory with itself, change nothing.
    """
    known = stated.select(F.col("id").alias("by"))
    version = F.col("memory_version") if "memory_version" in stated.columns else F.lit(1)
    pairs = replaced.where("id <> by").join(known, "by", "left_semi").groupBy("id").agg(F.min("by").alias("superseded_by"))
    out = stated.withColumn("memory_version", version).join(pairs, "id")
    return out.select("id", "superseded_by", (F.col("memory_version") + 1).alias("memory_version"), F.lit("consolidated").alias("state"), F.lit(1.0).alias("stability"), F.concat(F.lit("superseded_by:"), "superseded_by").alias("reason"), now.alias("updated_at"))
