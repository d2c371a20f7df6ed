"""Append-only version chains, conflicts and their resolution."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import text as T
from .durable import cut

#: Ids in a piece of the members of a value, pairs that a task spells out, tasks at most.
PIECE, TASK_PAIRS, MOST_TASKS = 1_000, 1_000_000, 20_000


def chain(log: DataFrame, most: int = 50) -> DataFrame:
    """subject, chain_key, n, content, source, hash, supersedes for each version that changes its subject.

    ``log``: subject, seq, content, source. A version equal to the one before is none; the last ``most`` stay and are
    numbered from 1.
    """
    w = Window.partitionBy("chain_key").orderBy("seq")
    log = log.withColumn("chain_key", T.chain_key(F.col("subject"))).withColumn("before", F.lag("content").over(w))
    changed = log.where(~F.col("content").eqNullSafe(F.col("before"))).withColumn("ordinal", F.row_number().over(w))
    changed = changed.withColumn("hash", T.stable_hash(F.concat_ws("|", "chain_key", "ordinal", "content"))).withColumn("supersedes", F.lag("hash").over(w))
    back = F.row_number().over(Window.partitionBy("chain_key").orderBy(F.col("seq").desc()))
    kept = changed.withColumn("back", back).where(F.col("back") <= most)
    return kept.select("subject", "chain_key", F.row_number().over(w).cast("long").alias("n"), "seq", "content", "source", "hash", "supersedes")


def heads(chained: DataFrame) -> DataFrame:
    """subject, n, content, hash: the current version of each subject."""
    return chained.groupBy("subject").agg(F.max("n").alias("n"), F.max_by("content", "n").alias("content"), F.max_by("hash", "n").alias("hash"))


def rollback(chained: DataFrame, n: int) -> DataFrame:
    """subject, content, source: what to append so that version n is current again."""
    return chained.where(F.col("n") == n).select("subject", "content", F.concat(F.lit("rollback:"), F.col("hash")).alias("source"))


def evidence_policy(df: DataFrame, old: Column, new: Column) -> DataFrame:
    """Adds old_class, new_class, rank_change and policy of a version that replaces another."""
    a, b = T.evidence_class(old), T.evidence_class(new)
    policy = (
        F.when(a == b, "recency_wins_keep_both").when(b == "anumana", "derived_never_overrides").when(a == "anumana", "derived_superseded_by_source")
        .when((a == "pratyaksa") | (b == "pratyaksa"), "direct_wins_testimony_dissent").otherwise("recency_wins_keep_both")
    )
    return df.withColumns({"old_class": a, "new_class": b, "rank_change": T.evidence_rank(b) - T.evidence_rank(a), "policy": policy})


def stated(nodes: DataFrame) -> DataFrame:
    """subject, value, id: what facts and events say."""
    facts = nodes.where(F.col("memory_type").isin("fact", "event")).withColumn("p", T.proposition(F.coalesce("raw_text", "concept"))).where("p is not null")
    return facts.select(F.col("p.subject").alias("subject"), F.col("p.value").alias("value"), "id")


def stated_values(nodes: DataFrame) -> DataFrame:
    """subject, value, members (ids, sorted), values (different ones of the subject): what facts and events say."""
    said = stated(nodes).groupBy("subject", "value").agg(F.sort_array(F.collect_list("id")).alias("members"))
    return said.join(said.groupBy("subject").agg(F.count(F.lit(1)).alias("values")), "subject")


def conflicts(nodes: DataFrame) -> DataFrame:
    """subject, a_value, b_value, a_members, b_members: the pairs of different values that are stated of one subject.

    Facts are first gathered by (subject, value), so that those which agree make no pairs.
    """
    said = stated_values(nodes).where("values > 1")
    a, b = (said.select("subject", F.col("value").alias(f"{x}_value"), F.col("members").alias(f"{x}_members")) for x in "ab")
    return a.join(b, "subject").where("a_value < b_value")


def conflicting_pairs(nodes: DataFrame, piece: int = PIECE) -> DataFrame:
    """subject, a, b, a_value, b_value: ``conflicts`` spelled out for their members, a before b.

    Members are held in pieces of about ``piece`` ids. Pairs of pieces, not pairs of members, are dealt over as many tasks
    as their pairs need, and spelled out there, so that a subject of many members is in no task as a whole.
    """
    facts = cut(stated(nodes))
    sizes = facts.groupBy("subject", "value").agg(F.count(F.lit(1)).alias("n"))
    n = F.col("n").cast("double")
    subjects = sizes.groupBy("subject").agg(F.count(F.lit(1)).alias("values"), ((F.sum(n) * F.sum(n) - F.sum(n * n)) / 2).alias("pairs")).where("values > 1")
    pairs = subjects.agg(F.sum("pairs")).first()[0] or 0
    held = sizes.join(subjects.select("subject"), "subject", "left_semi")
    placed = facts.join(held, ["subject", "value"]).withColumn("piece", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / piece)))
    said = placed.groupBy("subject", "value", "piece").agg(F.collect_list("id").alias("members"))
    a, b = (said.select("subject", F.col("value").alias(f"{x}_value"), F.col("members").alias(f"{x}_members")) for x in "ab")
    both = a.join(b, "subject").where("a_value < b_value").repartition(max(1, min(MOST_TASKS, math.ceil(pairs / TASK_PAIRS))))
    each = both.withColumn("a", F.explode("a_members")).withColumn("b", F.explode("b_members"))
    turn = F.col("a") > F.col("b")
    pick = lambda x, y: F.when(turn, F.col(y)).otherwise(F.col(x))
    return each.select("subject", pick("a", "b").alias("a"), pick("b", "a").alias("b"), pick("a_value", "b_value").alias("a_value"), pick("b_value", "a_value").alias("b_value"))


def resolution_score(now: Column, authority: Column | None = None, sources: Column | None = None, valid_until: Column | None = None) -> Column:
    """How much a side of a conflict weighs: validity, authority, confidence, recency and number of sources.

    Unless given, authority is .5, there is one source, and validity has no end.
    """
    authority, sources = F.lit(0.5) if authority is None else authority, F.lit(1) if sources is None else sources
    valid = F.lit(1.0) if valid_until is None else valid_until.isNull().cast("double")
    return 0.30 * valid + 0.25 * authority + 0.20 * N.clip(F.col("confidence")) + 0.15 * N.recency(F.col("updated_at"), now) + 0.10 * F.least(F.lit(1.0), sources * 0.5)


def resolve(nodes: DataFrame, now: Column) -> DataFrame:
    """subject, id, score, rank: the sides of each conflict, the strongest first."""
    sides = stated_values(nodes).where("values > 1").select("subject", F.explode("members").alias("id"))
    scored = sides.join(nodes.select("id", "confidence", "updated_at"), "id").withColumn("score", F.round(resolution_score(now), 6))
    return scored.select("subject", "id", "score", F.row_number().over(Window.partitionBy("subject").orderBy(F.col("score").desc(), "id")).cast("long").alias("rank"))


def valid_at(nodes: DataFrame, at: Column) -> DataFrame:
    """Nodes whose validity holds at a time."""
    return nodes.where((F.coalesce("valid_from", at) <= at) & (F.col("valid_until").isNull() | (at < F.col("valid_until"))))
