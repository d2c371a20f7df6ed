"""How memories fade, are used, settle and come back. Nodes carry importance, confidence, updated_at, access_count, failures, stability.

Every function takes the clock as a column and returns new values; nothing is changed in place and nothing is deleted.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numeric as N
from .durable import cut

# The defaults of the layer.
PARAMETERS = {
    "stability_gain": 0.12, "stability_decay_per_day": 0.01,
    "utility_importance": 0.30, "utility_confidence": 0.25, "utility_activation": 0.20, "utility_degree": 0.15, "utility_access": 0.10,
    "half_life_days": 21.0, "decay_floor": 0.15, "decay_min_importance": 0.05, "protection_gain": 0.35, "decay_stability_gain": 1.20,
    "decay_importance_gain": 0.60, "decay_access_gain": 0.80, "access_ref": 8.0, "mult_min": 0.25, "mult_max": 8.0,
    "candidate_access": 2, "stable_access": 5, "consolidated_access": 10, "candidate_score": 0.45, "stable_score": 0.60, "consolidated_score": 0.72,
    "score_access": 0.35, "score_importance": 0.20, "score_confidence": 0.15, "score_degree": 0.15, "score_stability": 0.15, "degree_ref": 8.0,
    "percentile": 0.95, "squeeze": 0.25, "importance_cap": 0.98,
    "replay_size": 500, "cooldown_days": 7.0, "risk": 0.35, "use": 0.20, "settled": 0.15, "wired": 0.10, "failed": 0.10, "state": 0.10,
    "migrate_accesses": 3, "migrate_stability": 0.55, "migrate_most": 64, "merge_similarity": 0.92, "merge_pairs": 500,
}
STATES = ("new", "candidate", "stable", "consolidated")


def state_rank(state: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*map(F.lit, STATES)), state) - 1, F.lit(0)).cast("int")


def _degree8(ref: float = 8.0) -> Column:
    return F.least(F.col("records") / ref, F.lit(1.0))


def consolidation_score(p: dict = PARAMETERS) -> Column:
    """Evidence that a memory should stay, in [0, 1]; needs records (incident edges)."""
    return N.clip(
        p["score_access"] * F.least(F.col("access_count") / float(p["consolidated_access"]), F.lit(1.0)) + p["score_importance"] * N.clip(F.col("importance"))
        + p["score_confidence"] * N.clip(F.col("confidence")) + p["score_degree"] * _degree8(p["degree_ref"]) + p["score_stability"] * N.clip(F.col("stability"))
    )


def consolidation_state(p: dict = PARAMETERS) -> Column:
    score, n = consolidation_score(p), F.col("access_count")
    return (
        F.when((n >= p["consolidated_access"]) & (score >= p["consolidated_score"]), "consolidated").when((n >= p["stable_access"]) & (score >= p["stable_score"]), "stable")
        .when((n >= p["candidate_access"]) | (score >= p["candidate_score"]), "candidate").otherwise("new")
    )


def with_state(nodes: DataFrame, incidence: DataFrame, p: dict = PARAMETERS) -> DataFrame:
    """Adds records, score and state."""
    out = nodes.join(incidence, "id", "left").withColumn("records", F.coalesce("records", F.lit(0)))
    return out.withColumns({"score": consolidation_score(p), "state": consolidation_state(p)})


def strength(p: dict = PARAMETERS) -> Column:
    """By what a memory's half-life is multiplied."""
    use = F.least(F.log1p(F.col("access_count").cast("double")) / math.log1p(p["access_ref"]), F.lit(1.0))
    return N.clip(
        1.0 + p["protection_gain"] * state_rank(F.col("state")) + p["decay_stability_gain"] * N.clip(F.col("stability")) + p["decay_importance_gain"] * (N.clip(F.col("importance")) - 0.5)
        + p["decay_access_gain"] * use + 0.10 * _degree8(), p["mult_min"], p["mult_max"],
    )


def soft_retention(now: Column, half_life: float = 21.0, boost: float = 0.5) -> Column:
    """What is left of a memory: connected and trusted ones fade more slowly."""
    settled = 1.0 + boost * _degree8() * F.col("confidence")
    return F.exp(-N.age_days(F.col("updated_at"), now) / (half_life / math.log(2.0) * settled))


def adaptive_retention(now: Column, p: dict = PARAMETERS, since: Column | None = None) -> Column:
    """What is left of a memory since ``since`` (its last change, unless given)."""
    since = F.col("updated_at") if since is None else since
    return N.clip(F.exp(-N.age_days(since, now) / (p["half_life_days"] * strength(p) / math.log(2.0))))


def decay(nodes: DataFrame, retention: Column, floor: float = 0.15, least: float = 0.05) -> DataFrame:
    """Adds retention, faded (whether it counts) and the new importance; retention of .999 and more changes nothing."""
    out = nodes.withColumn("retention", retention)
    lower = F.round(F.greatest(F.col("importance") * F.col("retention"), F.col("importance") * floor, F.lit(least)), 4)
    return out.withColumns({"faded": F.col("retention") < 0.999, "new_importance": F.when(F.col("retention") < 0.999, lower).otherwise(F.col("importance"))})


def adaptive_decay(stated: DataFrame, now: Column, p: dict = PARAMETERS) -> DataFrame:
    """``decay`` by adaptive retention, with last_decay_at set to ``now``.

    The interval runs from the newest of the last change and the last pass (last_decay_at, where it is a column), so that
    a repeated pass charges each interval once. Without either stamp nothing fades.
    """
    known = F.greatest("updated_at", "last_decay_at") if "last_decay_at" in stated.columns else F.col("updated_at")
    retention = F.coalesce(adaptive_retention(now, p, known), F.lit(1.0))
    return decay(stated, retention, least=p["decay_min_importance"]).withColumn("last_decay_at", now)


def decay_report(decayed: DataFrame) -> DataFrame:
    """One row: nodes, decayed, and the mean, least and greatest retention."""
    r = F.col("retention")
    return decayed.agg(F.count(F.lit(1)).alias("nodes"), F.count_if("faded").alias("decayed"), F.round(F.avg(r), 4).alias("retention_mean"), F.round(F.least(F.lit(1.0), F.min(r)), 4).alias("retention_min"), F.round(F.greatest(F.lit(0.0), F.max(r)), 4).alias("retention_max"))


def _two(x: Column) -> Column:
    return F.format_number(x, 2)


def reasons(stated: DataFrame, now: Column, p: dict = PARAMETERS) -> DataFrame:
    """id, state, score, retention, strength, why_decayed, why_settled: for each node, what its fading and its state rest on, in numbers and in words.

    stated: rows of ``with_state`` with last_accessed. A pass that has taken something (decay_rate, where it is a column) is named.
    """
    used = F.when(F.col("access_count") == 0, "never retrieved").otherwise(F.concat(F.col("access_count").cast("string"), F.lit(" retrievals")))
    last = F.coalesce(F.concat(F.lit("last used "), F.date_format("last_accessed", "yyyy-MM-dd HH:mm:ss")), F.lit("no recorded use"))
    left = adaptive_retention(now, p)
    taken = F.when(F.col("decay_rate") > 0, F.concat(F.lit("last decay pass removed "), F.format_number(100 * F.col("decay_rate"), 0), F.lit("%"))) if "decay_rate" in stated.columns else F.lit(None).cast("string")
    following = F.element_at(F.create_map(*[F.lit(x) for pair in zip(STATES, STATES[1:]) for x in pair]), F.col("state"))
    rests = F.concat(F.lit("score "), _two(F.col("score")), F.lit(" from access "), F.col("access_count").cast("string"), *[y for c in ("importance", "confidence", "stability") for y in (F.lit(f", {c} "), _two(N.clip(F.col(c))))])
    settled = F.concat(rests, F.coalesce(F.concat(F.lit("; next is "), following), F.lit("; fully consolidated, fades more slowly")))
    return stated.select("id", "state", "score", left.alias("retention"), strength(p).alias("strength"), F.concat_ws("; ", used, last, F.concat(F.lit("retention "), _two(left)), taken).alias("why_decayed"), settled.alias("why_settled"))


def at_risk(stated: DataFrame, now: Column, most: int = 20, below: float = 0.5, p: dict = PARAMETERS) -> DataFrame:
    """id, retention, rank of the nodes of which least is left, ``below`` a share of it; ties by id."""
    left = stated.select("id", F.round(adaptive_retention(now, p), 6).alias("retention")).where(F.col("retention") < below)
    return left.orderBy("retention", "id").limit(most).withColumn("rank", F.row_number().over(Window.orderBy("retention", "id")).cast("long"))


def lifted(importance: Column, lift: float = 0.06, ceiling: float = 0.98) -> Column:
    """Importance after use."""
    return F.round(F.least(F.lit(ceiling), importance + lift * (1.2 - importance)), 4)


def homeostasis(nodes: DataFrame, p: dict = PARAMETERS) -> DataFrame:
    """Adds cap and new_importance: what stands above the cap is squeezed. The cap is a percentile, at least .5."""
    cap = nodes.agg(F.least(F.lit(p["importance_cap"]), F.greatest(F.percentile(N.clip(F.col("importance")), p["percentile"]), F.lit(0.5))).alias("cap"))
    over = F.round(F.least(F.lit(p["importance_cap"]), F.col("cap") + (F.col("importance") - F.col("cap")) * p["squeeze"]), 4)
    return nodes.crossJoin(F.broadcast(cap)).withColumn("new_importance", F.when(F.col("importance") > F.col("cap"), over).otherwise(F.col("importance")))


def replay_priority(now: Column, p: dict = PARAMETERS) -> Column:
    """At risk but valuable, proven useful, settled, wired, part of failures."""
    risk = (1.0 - adaptive_retention(now, p)) * N.clip(F.col("importance"))
    return N.clip(
        p["risk"] * risk + p["use"] * F.least(F.col("access_count") / p["access_ref"], F.lit(1.0)) + p["settled"] * N.clip(F.col("stability")) + p["wired"] * _degree8()
        + p["failed"] * F.least(F.col("failures") / 3.0, F.lit(1.0)) + p["state"] * state_rank(F.col("state")) / 3.0
    )


def select_replay(stated: DataFrame, now: Column, size: int | None = None, p: dict = PARAMETERS) -> DataFrame:
    """id, priority, rank of the memories to replay; those replayed within the cooldown wait."""
    ready = stated
    if "last_replayed" in stated.columns:
        ready = ready.where(F.col("last_replayed").isNull() | (N.age_days(F.col("last_replayed"), now) >= p["cooldown_days"]))
    best = ready.select("id", F.round(replay_priority(now, p), 6).alias("priority")).orderBy(F.col("priority").desc(), "id").limit(size or p["replay_size"])
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.col("priority").desc(), "id")).cast("long"))


def replay(stated: DataFrame, chosen: DataFrame, now: Column, p: dict = PARAMETERS) -> DataFrame:
    """The chosen memories as after a use: id, new_importance, new_stability, updated_at."""
    return stated.join(chosen.select("id"), "id", "left_semi").select("id", lifted(F.col("importance")).alias("new_importance"), N.clip(F.col("stability") + p["stability_gain"]).alias("new_stability"), now.alias("updated_at"))


def touch(stated: DataFrame, uses: DataFrame, now: Column, p: dict = PARAMETERS) -> DataFrame:
    """id, new_stability, new_access, new_failures after one use or failure each; uses: id, failed, last_accessed (before it).

    A use adds by its utility, a failure takes away, and a failed one also pays for the time since its last use.
    """
    u = stated.drop("last_accessed").join(uses, "id")
    utility = (
        p["utility_importance"] * N.clip(F.col("importance")) + p["utility_confidence"] * N.clip(F.col("confidence")) + p["utility_activation"] * F.lit(0.0)
        + p["utility_degree"] * _degree8() + p["utility_access"] * F.least((F.col("access_count") + 1) / 10.0, F.lit(1.0))
    )
    idle = F.when(F.col("failed"), F.coalesce(N.age_days(F.col("last_accessed"), now), F.lit(0.0))).otherwise(F.lit(0.0))
    change = F.when(F.col("failed"), F.lit(-p["stability_gain"])).otherwise(p["stability_gain"] * utility) - p["stability_decay_per_day"] * idle
    return u.select("id", N.clip(F.col("stability") + change).alias("new_stability"), (F.col("access_count") + F.when(F.col("failed"), 0).otherwise(1)).alias("new_access"), (F.col("failures") + F.when(F.col("failed"), 1).otherwise(0)).alias("new_failures"))


def migrate_rings(stated: DataFrame, now: Column, p: dict = PARAMETERS, rings: int = 5) -> DataFrame:
    """id, ring, new_ring of the nodes that move: the first used and stable ones in id order inwards, faded ones outwards."""
    fit = (F.col("ring") > 0) & (F.col("access_count") >= p["migrate_accesses"]) & (F.col("stability") >= p["migrate_stability"])
    inward = stated.where(fit).orderBy("id").limit(p["migrate_most"]).select("id", "ring", (F.col("ring") - 1).alias("new_ring"))
    faint = (F.col("ring") < rings - 1) & (F.col("importance") <= p["decay_min_importance"]) & (adaptive_retention(now, p) <= 1e-3)
    outward = stated.where(faint).join(inward, "id", "left_anti").select("id", "ring", (F.col("ring") + 1).alias("new_ring"))
    return inward.unionByName(outward)


def merge_candidates(nodes: DataFrame, threshold: float = 0.92, most: int = 500, block: int = 16_384) -> DataFrame:
    """a, b, similarity of pairs of vectors whose cosine is at least ``threshold``, the nearest ``most``; ties by a, b.

    All pairs are compared at every size: each block of about ``block`` vectors goes to all tasks in turn and meets the vectors
    of its own and later blocks in matrix products. The last similarity of the best so far bounds what is sent on. The
    result, ``most`` rows, is held by the driver.
    """
    spark, kind = nodes.sparkSession, nodes.schema["id"].dataType.simpleString()
    v = nodes.where("id is not null and embedding is not null").select("id", N.unit(F.col("embedding")).alias("u"))
    v = cut(v.repartition(4 * spark.sparkContext.defaultParallelism))
    blocks = max(1, -(-v.count() // block))
    v = v.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    best: list[tuple] = []
    for k in range(blocks):
        held = v.where(F.col("block") == k).select("id", "u").toArrow()
        if not held.num_rows:
            continue
        ids = np.array(held["id"].to_pylist(), object)
        x = held["u"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        run = _nearest_pairs(ids, x, most, -best[-1][0] if len(best) == most else threshold)
        later = v.where(F.col("block") >= k).select("id", "u", (F.col("block") > k).alias("later"))
        part = later.mapInPandas(run, f"a {kind}, b {kind}, similarity double").distinct()
        found = part.orderBy(F.col("similarity").desc(), "a", "b").limit(most).collect()
        best = sorted({*best, *((-r["similarity"], r["a"], r["b"]) for r in found)})[:most]
    return spark.createDataFrame([(a, b, -s) for s, a, b in best], f"a {kind}, b {kind}, similarity double")


def _nearest_pairs(ids: np.ndarray, x: np.ndarray, most: int, least: float, rows: int = 1024, columns: int = 4096):
    """A function of batches (id, u, later) that gives the best ``most`` pairs of them with ``ids``, whose unit vectors are ``x``.

    A pair within the block is met from both sides and taken once.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best, floor = [], least
        for batch in batches:
            if not len(batch):
                continue
            y, later = np.stack(batch["u"].to_numpy()), batch["later"].to_numpy(bool)
            # numbers in the order of the ids
            names, number = np.unique(np.concatenate([ids, batch["id"].to_numpy(object)]), return_inverse=True)
            left, right = number[: len(ids)], number[len(ids) :]
            got = np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)
            for i in range(0, len(ids), rows):
                for j in range(0, len(y), columns):
                    s = x[i : i + rows] @ y[j : j + columns].T
                    p, q = np.nonzero(s >= floor - 1e-4)
                    if not len(p):
                        continue
                    # halves go up, as in SQL
                    sim = np.copysign(np.floor(np.abs(s[p, q]) * 1e4 + 0.5) / 1e4, s[p, q])
                    one, two = left[i + p], right[j + q]
                    fit = (sim >= floor) & ((one < two) | later[j + q])
                    new = sim[fit], np.minimum(one, two)[fit], np.maximum(one, two)[fit]
                    sim, a, b = (np.concatenate(z) for z in zip(got, new))
                    order = np.lexsort((b, a, -sim))
                    sim, a, b = sim[order], a[order], b[order]
                    first = np.ones(len(sim), bool)
                    first[1:] = (sim[1:] != sim[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])
                    got = sim[first][:most], a[first][:most], b[first][:most]
                    if len(got[0]) == most:
                        floor = max(floor, got[0][-1])
            best = sorted({*best, *zip((-got[0]).tolist(), names[got[1]], names[got[2]])})[:most]
            if len(best) == most:
                floor = max(floor, -best[-1][0])
        yield pd.DataFrame([(a, b, -s) for s, a, b in best], columns=["a", "b", "similarity"])

    return run
