"""Tables that are only written anew: latest rows, cascades, logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(log: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The newest row of each key of an append-only log: what an upsert would have left."""
    r = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return log.withColumn("_r", r).where("_r = 1").drop("_r")


def merge_nodes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Nodes after a merge of ``new`` (id, raw_text, source_ids, importance, confidence) into those of the same id.

    Texts are joined, sources united and sorted, the larger worth kept.
    """
    n = new.select("id", *[F.col(c).alias(f"n_{c}") for c in ("raw_text", "source_ids", "importance", "confidence")])
    return old.join(n, "id", "left").select(
        "id", F.trim(F.concat_ws("\n", "raw_text", "n_raw_text")).alias("raw_text"),
        F.array_sort(F.array_union("source_ids", F.coalesce("n_source_ids", F.array().cast("array<string>")))).alias("source_ids"),
        F.greatest("importance", "n_importance").alias("importance"), F.greatest("confidence", "n_confidence").alias("confidence"),
    )


def apply_action(nodes: DataFrame, actions: DataFrame, now: Column) -> DataFrame:
    """Nodes after invalidate, archive, restore or delete; actions: id, action."""
    a = nodes.join(actions, "id", "left")
    act = F.col("action")
    return a.withColumns({
        "valid_until": F.when(act == "invalidate", now).when(act == "restore", F.lit(None)).otherwise(F.col("valid_until")),
        "confidence": F.when(act == "invalidate", F.least("confidence", F.lit(0.2))).otherwise(F.col("confidence")),
        "status": F.when(act == "archive", "archived").when(act == "restore", "active").when(act == "delete", "deleted").otherwise(F.col("status")),
    }).drop("action")


def cascade(documents: DataFrame, chunks: DataFrame, nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> dict[str, DataFrame]:
    """All four tables without the documents ``gone`` (document_id), their chunks, nodes sourced to these, and edges of those."""
    dead_chunks = chunks.join(gone, "document_id", "left_semi")
    hit = nodes.select("id", F.explode("source_ids").alias("chunk_id")).join(dead_chunks.select("chunk_id"), "chunk_id", "left_semi").select("id").distinct()
    keep = nodes.join(hit, "id", "left_anti").join(gone, "document_id", "left_anti")
    lost = nodes.select("id").join(keep.select("id"), "id", "left_anti")
    left = edges.join(lost.select(F.col("id").alias("source_id")), "source_id", "left_anti").join(lost.select(F.col("id").alias("target_id")), "target_id", "left_anti")
    return {"documents": documents.join(gone, "document_id", "left_anti"), "chunks": chunks.join(gone, "document_id", "left_anti"), "nodes": keep, "edges": left}


def provenance(nodes: DataFrame, chunks: DataFrame, documents: DataFrame, most: int = 8) -> DataFrame:
    """id, chunk_id, document_id, title, preview: where each node comes from, its first ``most`` chunks."""
    src = nodes.select("id", F.posexplode(F.slice("source_ids", 1, most)).alias("pos", "chunk_id"))
    return src.join(chunks, "chunk_id").join(documents.select("document_id", "title"), "document_id").select("id", "chunk_id", "document_id", "title", F.substring("text", 1, 200).alias("preview"))


def replay_window(log: DataFrame, now: Column, days: int, most: int = 5000) -> DataFrame:
    """The newest rows of a log (at, id) within some days."""
    return log.where(F.col("at") >= now - F.make_dt_interval(F.lit(days))).orderBy(F.col("at").desc(), F.col("id").desc()).limit(most)


def consecutive_pairs(log: DataFrame, by: list[str], order: list[str], item: str) -> DataFrame:
    """by, pair, first, second: items of each group in order, two by two; a last single one falls out."""
    i = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1
    numbered = log.withColumn("pair", F.floor(i / 2)).withColumn("side", i % 2)
    return numbered.groupBy(*by, "pair").agg(F.max(F.when(F.col("side") == 0, F.col(item))).alias("first"), F.max(F.when(F.col("side") == 1, F.col(item))).alias("second")).where("second is not null")


def telemetry(log: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, n, upper median and mean of a measured value."""
    w = Window.partitionBy(*by)
    r = log.withColumns({"i": F.row_number().over(w.orderBy(value)), "c": F.count(F.lit(1)).over(w)})
    return r.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("i") == F.floor(F.col("c") / 2) + 1, F.col(value))).alias("upper_median"), F.avg(value).alias("mean"))
