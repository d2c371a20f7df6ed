"""The forgetting lab: tasks are learned one after the other, and after each all known ones are tested, by many variants.

A variant names the components that rank and the mechanisms that run before each test. Variants that run and
rank alike live in one world, whose state of each node (importance, ring, stability, uses, failures, stamps) is carried from step to
step as a table: world, id, and the state. All worlds take a step in one plan; hits, pairs and paths, which do not depend
on a state, are worked out once a step for all of them.

A step: nodes of the new task appear; mechanisms run, in the order decay, replay, homeostasis, migration; the questions of
all known tasks are ranked among known nodes; in worlds with any mechanism what was found is used, or failed where a
question found nothing. Then every stamp of known nodes moves back by ``interval`` days, for nodes age while the next task
is waited for. Uses of one step count together: first all successes, then all failures.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numeric as N
from . import activation, dynamics, evaluation, graph, retrieval
from .durable import cut

MECHANISMS = ("decay", "consolidation", "replay", "homeostasis", "ring_migration")


@dataclass(frozen=True)
class Variant:
    """components: what ranks, None for all; mechanisms: what runs; kappa: weight of stability in the score."""

    components: tuple[str, ...] | None = None
    mechanisms: tuple[str, ...] = ()
    kappa: float = 0.0

    @property
    def world(self) -> str:
        """Variants that change nothing share a world; else all that run and rank alike do, as what is found changes it."""
        runs = "+".join(m for m in MECHANISMS if m in self.mechanisms)
        return f"{runs}/{self.kappa}/{','.join(self.components or ('all',))}" if runs else "still"

    def system(self) -> retrieval.System:
        weights = retrieval.WEIGHTS | {"stability": self.kappa}
        return self.components or tuple(weights), weights

    def score(self) -> Column:
        return retrieval.weighted(*self.system())


_DYNAMIC = ("decay", "replay", "consolidation")
# The variants of the lab.
VARIANTS = {
    "A_vector_rag": Variant(("semantic",)),
    "B_mira": Variant(),
    "C_mira_radial": Variant(("semantic", "radial", "structural")),
    "D_mira_graph": Variant(("semantic", "graph", "path")),
    "E_mira_hierarchy": Variant(("semantic", "structural")),
    "F_mira_decay": Variant(None, ("decay",)),
    "G_mira_consolidation": Variant(None, ("consolidation",)),
    "H_mira_replay": Variant(None, ("replay",)),
    "I_bio_dynamics": Variant(None, _DYNAMIC, 0.1),
    "J_biomira_tuned": Variant(None, _DYNAMIC, 0.1),
    "K_biomira_homeostasis": Variant(None, (*_DYNAMIC, "homeostasis", "ring_migration"), 0.1),
}
STATE = ("importance", "ring", "stability", "access_count", "failures", "updated_at", "last_accessed", "last_replayed", "last_decay_at")


def first_state(nodes: DataFrame, worlds: list[str]) -> DataFrame:
    """world, id, task and the state before anything has happened; nodes: id, task, and what they have of it."""
    have = set(nodes.columns)
    kinds = {"importance": "double", "ring": "int", "stability": "double", "access_count": "long", "failures": "long"}
    state = [(F.col(c) if c in have else F.lit(None)).cast(kinds.get(c, "timestamp")).alias(c) for c in STATE]
    state = [F.coalesce(c, F.lit(0).cast(kinds[n])).alias(n) if n in kinds else c for n, c in zip(STATE, state)]
    return nodes.select(F.explode(F.array(*map(F.lit, worlds))).alias("world"), "id", F.col("task").cast("int").alias("task"), *state)


def _has(mechanism: str) -> Column:
    return F.array_contains(F.split(F.substring_index("world", "/", 1), r"\+"), mechanism)


def asleep(state: DataFrame, about: DataFrame, now: Column, p: dict = dynamics.PARAMETERS) -> DataFrame:
    """The state after the mechanisms of each world; about: id, confidence, records."""
    s = state.join(about.select("id", "confidence", "records"), "id")
    s = s.withColumn("state", dynamics.consolidation_state(p))
    kept = ["world", "id", "task", *STATE]
    # decay: an interval is charged once, from the newest of the last change and the last pass
    faded = dynamics.adaptive_decay(s.withColumn("before", F.col("last_decay_at")), now, p)
    s = faded.withColumns({"importance": F.when(_has("decay"), F.col("new_importance")).otherwise(F.col("importance")), "last_decay_at": F.when(_has("decay"), now).otherwise(F.col("before"))}).drop("retention", "faded", "new_importance", "before")
    # replay: the neediest of each world
    ready = _has("replay") & (F.col("last_replayed").isNull() | (N.age_days(F.col("last_replayed"), now) >= p["cooldown_days"]))
    order = Window.partitionBy("world").orderBy(F.round(dynamics.replay_priority(now, p), 6).desc(), "id")
    chosen = s.where(ready).withColumn("r", F.row_number().over(order)).where(F.col("r") <= p["replay_size"]).select("world", "id", F.lit(True).alias("played"))
    s = s.join(chosen, ["world", "id"], "left").withColumn("played", F.coalesce("played", F.lit(False)))
    s = s.withColumns({
        "importance": F.when(F.col("played"), dynamics.lifted(F.col("importance"))).otherwise(F.col("importance")), "stability": F.when(F.col("played"), N.clip(F.col("stability") + p["stability_gain"])).otherwise(F.col("stability")),
        "updated_at": F.when(F.col("played"), now).otherwise(F.col("updated_at")), "last_replayed": F.when(F.col("played"), now).otherwise(F.col("last_replayed")),
    }).drop("played")
    # homeostasis: what stands above a world's cap is squeezed
    cap = s.where(_has("homeostasis")).groupBy("world").agg(F.least(F.lit(p["importance_cap"]), F.greatest(F.percentile(N.clip(F.col("importance")), p["percentile"]), F.lit(0.5))).alias("cap"))
    over = F.round(F.least(F.lit(p["importance_cap"]), F.col("cap") + (F.col("importance") - F.col("cap")) * p["squeeze"]), 4)
    s = s.join(F.broadcast(cap), "world", "left").withColumn("importance", F.when(F.col("importance") > F.col("cap"), over).otherwise(F.col("importance"))).drop("cap")
    # migration: the first used and stable ones inwards, faint ones outwards
    fit = _has("ring_migration") & (F.col("ring") > 0) & (F.col("access_count") >= p["migrate_accesses"]) & (F.col("stability") >= p["migrate_stability"])
    inward = s.where(fit).withColumn("r", F.row_number().over(Window.partitionBy("world").orderBy("id"))).where(F.col("r") <= p["migrate_most"]).select("world", "id", F.lit(-1).alias("moved"))
    faint = _has("ring_migration") & (F.col("ring") < 4) & (F.col("importance") <= p["decay_min_importance"]) & (dynamics.adaptive_retention(now, p) <= 1e-3)
    s = s.join(inward, ["world", "id"], "left").withColumn("ring", F.col("ring") + F.coalesce("moved", F.when(faint, 1), F.lit(0)))
    return s.select(*kept)


def used(state: DataFrame, about: DataFrame, uses: DataFrame, now: Column, p: dict = dynamics.PARAMETERS) -> DataFrame:
    """The state after uses (world, id, wins, losses): each win adds by its utility, each loss takes away, and pays once for the time since the last use."""
    s = state.join(uses, ["world", "id"], "left").join(about.select("id", "confidence", "records"), "id")
    wins, losses = F.coalesce("wins", F.lit(0)), F.coalesce("losses", F.lit(0))
    fixed = p["utility_importance"] * N.clip(F.col("importance")) + p["utility_confidence"] * N.clip(F.col("confidence")) + p["utility_degree"] * F.least(F.col("records") / p["degree_ref"], F.lit(1.0))
    # the i-th win of a step counts as one more access than the one before it
    rising = F.when(wins > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(wins, F.lit(1)).cast("int")), F.lit(0.0), lambda t, i: t + F.least((F.col("access_count") + i) / 10.0, F.lit(1.0)))).otherwise(0.0)
    gained = N.clip(F.col("stability") + p["stability_gain"] * (wins * fixed + p["utility_access"] * rising))
    idle = F.when(losses > 0, F.coalesce(N.age_days(F.col("last_accessed"), now), F.lit(0.0))).otherwise(0.0)
    return s.select(
        "world", "id", "task", "importance", "ring", N.clip(gained - losses * p["stability_gain"] - p["stability_decay_per_day"] * idle).alias("stability"), (F.col("access_count") + wins).alias("access_count"), (F.col("failures") + losses).alias("failures"),
        "updated_at", F.when(wins + losses > 0, now).otherwise(F.col("last_accessed")).alias("last_accessed"), "last_replayed", "last_decay_at",
    )


def ranked(state: DataFrame, nodes: DataFrame, edges: DataFrame, queries: DataFrame, now: Column, variants: dict[str, Variant], k: int = 8) -> DataFrame:
    """variant, query_id, id, rank among ``nodes``, by the state of each variant's world."""
    on = retrieval.ground(nodes, edges, queries)
    worlds = state.select("world").distinct()
    seeds = retrieval.first_hits(on.hits)
    # a query of a world is a query of its own to the operators
    each = F.struct("world", "query_id").alias("query_id")
    of_world = lambda df: df.crossJoin(F.broadcast(worlds)).withColumn("query_id", each)
    seeded = cut(of_world(seeds))
    paths = graph.cheapest_paths(seeds.select("id").distinct(), on.sym, 3)
    near = seeded.select("query_id", F.col("id").alias("seed"), "rank").join(on.sym.select(F.col("src").alias("seed"), F.col("dst").alias("id")), "seed").join(paths, ["seed", "id"])
    worth = state.select("world", "id", "importance")
    strong = seeded.withColumn("world", F.col("query_id.world")).join(worth, ["world", "id"]).select("query_id", "id", N.clip(F.col("score")).alias("seed_score"), "importance")
    reached = cut(retrieval.top(activation.continuous(strong, None, on.sym), [F.col("activation").desc(), F.col("id")], retrieval.ACTIVATED))
    parts = [
        of_world(on.hits).select("query_id", "id", F.array("id").alias("path"), F.lit(0).alias("channel"), F.lit(0).cast("long").alias("place")),
        near.select("query_id", "id", "path", F.lit(1).alias("channel"), F.col("rank").alias("place")),
        reached.select("query_id", "id", F.array("id").alias("path"), F.lit(2).alias("channel"), F.lit(0).cast("long").alias("place")),
    ]
    asked = cut(of_world(queries))
    inner = nodes.drop("ring").join(state.groupBy("id").agg(F.min("ring").alias("ring")), "id")

    def leads(union: DataFrame) -> DataFrame:
        found, of = [], cut(union.select("query_id.world", F.col("query_id.query_id").alias("query_id"), "id"))
        for world in sorted({v.world for v in variants.values()}):
            mine = state.where((F.col("world") == world) & (F.col("ring") <= 1)).select("id", "ring", "importance", "stability", "updated_at")
            systems = [v.system() for v in variants.values() if v.world == world]
            flat = retrieval.plain(nodes.drop("ring", "importance", "stability", "updated_at").join(mine, "id"), nodes, edges, now, on=on)
            rest = F.array(*[retrieval.weighted(*s) for s in systems])
            some = retrieval.leading(flat.select("id", "embedding", "words", rest.alias("rest")), queries, of.where(F.col("world") == world), systems, k)
            found.append(some.select(F.struct(F.lit(world).alias("world"), "query_id").alias("query_id"), "id"))
        return reduce(DataFrame.unionByName, found)

    cands = retrieval.candidates(inner, edges, asked, shared=(cut(reduce(DataFrame.unionByName, parts)), reached), leads=leads)
    scored = retrieval.components(cands, inner, edges, asked, now, on=on).withColumn("world", F.col("query_id.world"))
    own = state.select("world", "id", F.col("ring").alias("_ring"), F.col("importance").alias("_importance"), F.col("stability").alias("_stability"), F.col("updated_at").alias("_at"))
    scored = scored.join(own, ["world", "id"]).where((F.col("channel") != 3) | (F.col("_ring") <= 1))
    scored = scored.withColumns({"structural": retrieval.structural(F.col("_ring")), "importance": N.clip(F.col("_importance")), "stability": N.clip(F.col("_stability")), "recency": N.recency(F.col("_at"), now)})
    rows = F.explode(F.array(*[F.struct(F.lit(v).alias("variant"), F.lit(x.world).alias("of"), N.rounded(x.score(), 9).alias("score")) for v, x in variants.items()]))
    flat = scored.select("world", F.col("query_id.query_id").alias("query_id"), "id", rows.alias("v")).where("v.of = world").select("world", "query_id", "id", "v.variant", "v.score")
    order = Window.partitionBy("variant", "query_id").orderBy(F.col("score").desc(), "id")
    return flat.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k).select("variant", "world", "query_id", "id", "rank")


def run(nodes: DataFrame, edges: DataFrame, queries: DataFrame, gold: DataFrame, now: Column, tasks: int, variants: dict[str, Variant] = VARIANTS, interval: int = 30, k: int = 8) -> tuple[DataFrame, DataFrame]:
    """(variant, step, task, n, memory_count, mrr, recall, precision, hit_at_k), (step, world, id and the state after it).

    nodes: id, task and what ``retrieval`` reads; queries: query_id, task, vector and more; gold: query_id, id. What
    ``evaluation.forgetting`` reads are these rows of a variant.
    """
    state = first_state(nodes, sorted({v.world for v in variants.values()}))
    about = cut(nodes.select("id", "confidence").join(graph.incidence(edges), "id", "left").withColumn("records", F.coalesce("records", F.lit(0))))
    rows, states = [], []
    for step in range(tasks):
        known = F.col("task") <= step
        seen = cut(nodes.where(known))
        wires = cut(graph.induced(edges, seen.select("id")))
        now_known = cut(asleep(state.where(known), about, now))
        asked = queries.where(known)
        runs = cut(ranked(now_known, seen, wires, asked.drop("task"), now, variants, k))
        per = evaluation.ranking_metrics(runs, gold, k, ["variant"]).join(asked.select("query_id", "task"), "query_id")
        size = seen.agg(F.count(F.lit(1)).alias("memory_count"))
        mean = lambda c, n: F.round(F.avg(c), 6).alias(n)
        rows.append(per.groupBy("variant", "task").agg(F.count(F.lit(1)).alias("n"), mean("mrr", "mrr"), mean("recall", "recall"), mean("precision", "precision"), mean((F.col("recall") > 0).cast("int"), "hit_at_k")).crossJoin(F.broadcast(size)).withColumn("step", F.lit(step)))
        # one variant of each world tells what was found; the others of a still world use nothing
        leads = {x.world: v for v, x in reversed(variants.items()) if x.world != "still"}
        hit = runs.where(F.col("variant").isin(list(leads.values()))).join(gold.withColumn("hit", F.lit(1)), ["query_id", "id"], "left")
        won = F.max(F.coalesce("hit", F.lit(0))).over(Window.partitionBy("world", "query_id"))
        uses = hit.withColumn("won", won).groupBy("world", "id").agg(F.sum("won").cast("long").alias("wins"), F.sum(1 - F.col("won")).cast("long").alias("losses"))
        after = cut(used(now_known, about, uses, now))
        states.append(after.withColumn("step", F.lit(step)))
        back = {c: F.col(c) - F.make_dt_interval(F.lit(interval)) for c in ("updated_at", "last_accessed", "last_replayed", "last_decay_at")}
        state = cut(after.withColumns(back).unionByName(state.where(~known)))
    return reduce(DataFrame.unionByName, rows).select("variant", "step", "task", "n", "memory_count", "mrr", "recall", "precision", "hit_at_k"), reduce(DataFrame.unionByName, states)
