"""Nodes over time: a log of actions as intervals with the image before and after each, reads at any point, planned changes.

A log has id, at, seq, action and what the action brings: raw_text, summary, source_ids, importance, confidence, reason,
each null where it brings none. Rows of an id are in the order of (at, seq).

* ``create`` sets everything, for an id that is there too; whatever happens to an id before its first ``create`` is nothing;
* ``update`` sets what it brings; ``merge`` joins texts, without blanks at their ends, by a line break, unites sources, takes the summary it brings and the
  larger importance and confidence;
* ``invalidate`` ends a node's validity and lowers its confidence to .2 at most; ``supersede`` ends it only; ``archive`` and
  ``restore`` set and clear a mark, and ``restore`` an end too; ``split`` leaves a reason.

Nothing is folded row by row: what an action leaves is a running aggregate since the action that last set it. A floor of .2
put on a running maximum is the same as the maximum of what came before it, cut at .2, and of what came after. Ids are
spread over tasks, more of them for a longer log; the rows of one id are sorted in one, where they stream from disk if they are many.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import versions

ACTIONS = ("create", "update", "merge", "split", "invalidate", "supersede", "archive", "restore")
IMAGE = ("raw_text", "summary", "source_ids", "importance", "confidence", "archived", "ended_at", "reason")
#: Rows of a log that a task holds, besides those of an id that has more.
TASK_ROWS = 100_000
_LOG = {"raw_text": "string", "summary": "string", "source_ids": "array<string>", "importance": "double", "confidence": "double", "reason": "string"}


def log_of(rows: DataFrame) -> DataFrame:
    """Rows with id, at and action as a log: what they do not bring is null, and seq is 0."""
    have = set(rows.columns)
    seq = F.col("seq") if "seq" in have else F.lit(0)
    return rows.select("id", F.col("at").cast("timestamp").alias("at"), seq.cast("long").alias("seq"), "action", *[(F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in _LOG.items()])


def history(log: DataFrame, fields: tuple[str, ...] = IMAGE) -> DataFrame:
    """id, version, action, valid_from, valid_to, before, and the image after the action, for each action on a node that is there.

    valid_to is null for the newest image; before is null for the first. Images have ``fields`` only, and only these are worked out.
    Rows are dealt by id over as many tasks as their number needs, since each sorts its rows several times over.
    """
    act, known = F.col("action"), F.col("action").isin(*ACTIONS)
    order = Window.partitionBy("id").orderBy("at", "seq")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    made, changed = act == "create", act == "update"
    log = log.where(known)
    dealt = log.repartition(max(1, math.ceil(log.count() / TASK_ROWS)), "id")
    rows = dealt.withColumn("_life", F.sum(made.cast("int")).over(upto)).where("_life > 0")
    # the action that last set a field opens an era of it
    brings = {c: made | (changed & F.col(c).isNotNull()) for c in ("raw_text", "source_ids", "importance", "confidence")}
    rows = rows.withColumns({f"_{c}": F.sum(b.cast("int")).over(upto) for c, b in brings.items()})
    era = lambda c, *more: Window.partitionBy("id", f"_{c}", *more).orderBy("at", "seq").rowsBetween(Window.unboundedPreceding, 0)
    given = lambda c: F.when(brings[c] | (act == "merge"), F.col(c))
    rows = rows.withColumn("_ends", F.sum((act == "invalidate").cast("int")).over(era("confidence")))
    most, since = F.max(given("confidence")).over(era("confidence")), F.max(given("confidence")).over(era("confidence", "_ends"))
    # the largest confidence of the era when it was last lowered
    capped = F.max(F.when(act == "invalidate", F.coalesce(F.col("_most"), F.lit(0.0)))).over(era("confidence"))
    bare = F.regexp_replace(given("raw_text"), r"^\s+|\s+$", "")
    last = lambda c: F.last(c, ignorenulls=True).over(upto)
    none = F.lit(None)
    rows = rows.withColumns({
        "_texts": F.collect_list(F.when(bare != "", bare)).over(era("raw_text")), "_merged": F.max(act == "merge").over(era("raw_text")), "_plain": F.max(F.when(brings["raw_text"], F.coalesce("raw_text", F.lit("")))).over(era("raw_text")),
        "n_source_ids": F.array_sort(F.array_distinct(F.flatten(F.collect_list(given("source_ids")).over(era("source_ids"))))),
        "n_importance": F.coalesce(F.max(given("importance")).over(era("importance")), F.lit(0.0)),
        "_most": most, "_since": since,
    })
    rows = rows.withColumns({
        "n_raw_text": F.when(F.col("_merged"), F.array_join("_texts", "\n")).otherwise(F.col("_plain")),
        "n_confidence": F.when(F.col("_ends") > 0, F.greatest(F.least(capped, F.lit(0.2)), F.coalesce("_since", F.lit(0.0)))).otherwise(F.coalesce("_most", F.lit(0.0))),
        "n_summary": last(F.when(made | (act.isin("update", "merge") & F.col("summary").isNotNull()), F.struct("summary")))["summary"],
        "n_archived": last(F.when(act == "archive", True).when(act.isin("restore", "create"), False)),
        "n_ended_at": last(F.when(act.isin("invalidate", "supersede"), F.struct("at")).when(act.isin("restore", "create"), F.struct(none.cast("timestamp").alias("at"))))["at"],
        "n_reason": last(F.when(act.isin("invalidate", "supersede", "split"), F.struct("reason")).when(act.isin("restore", "create"), F.struct(none.cast("string").alias("reason"))))["reason"],
    })
    image = F.struct(*[F.col(f"n_{c}").alias(c) for c in fields])
    rows = rows.select("id", "at", "seq", "action", image.alias("image"))
    return rows.select(
        "id", F.row_number().over(order).cast("long").alias("version"), "action", F.col("at").alias("valid_from"), F.lead("at").over(order).alias("valid_to"), F.lag("image").over(order).alias("before"), "image.*",
    )


def as_of(intervals: DataFrame, at: Column) -> DataFrame:
    """The nodes as they were at a time: of ``history``, the images whose interval holds it. An interval begins with its action."""
    return intervals.where((F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (at < F.col("valid_to"))))


def plan_merges(nodes: DataFrame, incoming: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(log, edges) that merge ``incoming`` (id, target, raw_text, summary, source_ids, importance, confidence) into ``nodes``.

    Where both state something of one subject and the values differ, nothing is merged: the incoming node is created beside
    the target, with a "contradicts" edge, and if it outranks the target, the target is superseded by it. Targets that are
    not there change nothing.
    """
    old = nodes.select(F.col("id").alias("target"), F.struct(T.proposition(F.col("raw_text")).alias("p"), versions.resolution_score(now).alias("score")).alias("old"))
    new = incoming.withColumn("updated_at", now)
    both = new.withColumn("new", F.struct(T.proposition(F.col("raw_text")).alias("p"), versions.resolution_score(now).alias("score"))).join(old, "target")
    clash = F.coalesce((F.col("old.p.subject") == F.col("new.p.subject")) & (F.col("old.p.value") != F.col("new.p.value")), F.lit(False))
    both = both.withColumn("clash", clash)
    merged = both.select(F.when(F.col("clash"), F.col("id")).otherwise(F.col("target")).alias("id"), F.when(F.col("clash"), "create").otherwise("merge").alias("action"), "raw_text", "summary", "source_ids", "importance", "confidence")
    gone = both.where(F.col("clash") & (F.col("new.score") > F.col("old.score"))).groupBy("target").agg(F.min("id").alias("by"))
    gone = gone.select(F.col("target").alias("id"), F.lit("supersede").alias("action"), F.concat(F.lit("superseded_by:"), "by").alias("reason"))
    log = log_of(merged.withColumn("at", now)).unionByName(log_of(gone.withColumn("at", now)))
    edges = both.where("clash").select(F.col("target").alias("source_id"), F.col("id").alias("target_id"), F.lit("contradicts").alias("relation_type"), F.lit(0.9).alias("weight"), "confidence")
    return log, edges


def plan_splits(nodes: DataFrame, parts: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(log, edges) that split nodes into ``parts`` (id, whole, reason, raw_text, summary, source_ids, importance, confidence).

    The whole stays and says why; each part is created and has a "split_from" edge of the whole's confidence. Parts of nodes
    that are not there fall out.
    """
    both = parts.join(nodes.select(F.col("id").alias("whole"), F.col("confidence").alias("trust")), "whole")
    marked = both.groupBy(F.col("whole").alias("id")).agg(F.min("reason").alias("reason")).withColumns({"action": F.lit("split"), "at": now})
    made = both.drop("whole", "trust", "reason").withColumns({"action": F.lit("create"), "at": now})
    edges = both.select(F.col("whole").alias("source_id"), F.col("id").alias("target_id"), F.lit("split_from").alias("relation_type"), F.lit(1.0).alias("weight"), F.col("trust").alias("confidence"))
    return log_of(marked).unionByName(log_of(made)), edges
