"""Answers from ranked evidence, with a wider second look for the questions whose first one holds no text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import compression, retrieval
from .durable import cut

NOTHING = "no evidence"


def widest(k: int) -> int:
    """How far a second look goes."""
    return max(4 * k, k + 8)


def assemble(scored: DataFrame, texts: DataFrame, queries: DataFrame, k: int = 8, budget: int = 2048, lines: int = 3) -> DataFrame:
    """query_id, mode, answer, looked, n_retrieved, evidence, n_tokens, n_raw_tokens, paths for each of ``queries`` (query_id, query).

    scored: query_id, id, score, path, as ``retrieval.rank_scored`` orders them; texts: id, text, ring, sector. Candidates
    are ranked once, as far as the wider look goes, and stored; a question's cursor (looked) stands at k. Where the context
    of the first k is empty, as of nodes without a text, the cursor moves on to ``widest``; the other questions are not
    read again. What a wider look gives is what a run with that k gives. Without any text the mode is "no_evidence".

    evidence: the nodes that the context shows, in its order, at most as many as the window; paths: those of more than
    one node that led to them, by rank.
    """
    window = cut(retrieval.top(scored.select("query_id", "id", "score", "path"), [F.col("score").desc(), F.col("id")], widest(k)))
    rich = window.join(texts.select("id", "text", "ring", "sector"), "id").join(queries.select("query_id", "query"), "query_id")
    pack = lambda rows: compression.compress(rows.select("query_id", "query", "rank", "id", "text", "ring", "sector"), budget)
    first = cut(pack(rich.where(F.col("rank") <= k)))
    some = F.trim("context") != ""
    open_ = first.where(~some).select("query_id")
    second = pack(rich.join(open_, "query_id", "left_semi")).where(some).withColumn("looked", F.lit(widest(k)))
    kept = first.withColumn("looked", F.lit(k))
    kept = cut(kept.join(second.select("query_id"), "query_id", "left_anti").unionByName(second))
    seen = window.join(kept.select("query_id", "looked"), "query_id").where(F.col("rank") <= F.col("looked"))
    counts = seen.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_retrieved"))
    led = seen.where(F.size("path") > 1).join(kept.select("query_id", F.explode("ids").alias("id")), ["query_id", "id"], "left_semi")
    led = led.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "path"))), lambda x: x["path"]).alias("paths"))
    said = compression.extractive_answer(kept.where(some), lines)
    out = queries.select("query_id").join(kept, "query_id", "left").join(said, "query_id", "left").join(counts, "query_id", "left").join(led, "query_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    kind = scored.schema["id"].dataType.simpleString()
    return out.select(
        "query_id", F.when(F.col("answer").isNotNull(), "extractive").otherwise("no_evidence").alias("mode"), F.coalesce("answer", F.lit(NOTHING)).alias("answer"), F.coalesce("looked", F.lit(k)).cast("int").alias("looked"), zero("n_retrieved"),
        F.coalesce("ids", F.array().cast(f"array<{kind}>")).alias("evidence"), zero("n_tokens"), zero("n_raw_tokens"), F.coalesce("paths", F.array().cast(f"array<array<{kind}>>")).alias("paths"),
    )
