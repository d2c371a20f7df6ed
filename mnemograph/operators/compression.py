"""Packing ranked evidence into a token budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def compress(ranked: DataFrame, budget: int = 2048) -> DataFrame:
    """query_id, context, n_tokens, n_raw_tokens, ids; ranked: query_id, query, rank, id, text, ring, sector.

    Tokens are runs without white space, so a context's count is the sum of its parts': a sentence adds its own, and the
    first one of an item adds those of the item's number and tag. All counts are known before, and a running total over
    the sentences in their order of choice (item by rank, then query words, then place) decides which ones fit. A
    context shows an item's sentences in their order in the text. Items without a text, and those whose first 2000
    characters a better item has, add nothing; of equal sentences of an item one counts.
    """
    tag = F.concat(F.lit("(ring"), F.coalesce(F.col("ring").cast("string"), F.lit("?")), F.lit(" · "), F.coalesce("sector", F.lit("general")), F.lit(") "))
    asked = F.array_distinct(T.unicode_words(F.coalesce("query", F.lit(""))))
    better = F.row_number().over(Window.partitionBy("query_id", F.substring("text", 1, 2000)).orderBy("rank"))
    items = ranked.where("text is not null").withColumn("parts", T.sentences(F.col("text"))).where(F.size("parts") > 0).withColumn("again", better).where("again = 1")
    each = items.select("query_id", "rank", "id", tag.alias("tag"), asked.alias("asked"), F.posexplode("parts").alias("no", "sentence"))
    each = each.groupBy("query_id", "rank", "id", "tag", "asked", "sentence").agg(F.min("no").alias("no"))
    hits = F.size(F.array_intersect(F.array_distinct(T.unicode_words(F.col("sentence"))), F.col("asked")))
    row = F.struct("rank", (-hits).alias("away"), "no", T.piece_tokens(F.col("sentence")).alias("cost"), (1 + T.piece_tokens(F.col("tag"))).alias("extra"), "id", "tag", "sentence")
    flat = each.groupBy("query_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    kind = flat.schema["rows"].dataType.simpleString()
    state = F.struct(F.lit(0).cast("long").alias("used"), F.lit(None).cast(each.schema["rank"].dataType).alias("item"), F.array().cast(kind).alias("taken"))

    def step(total, x):
        cost = (total["used"] + x["cost"] + F.when(total["item"].eqNullSafe(x["rank"]), 0).otherwise(x["extra"])).cast("long")
        return F.when(cost <= budget, F.struct(cost.alias("used"), x["rank"].alias("item"), F.array_append(total["taken"], x).alias("taken"))).otherwise(total)

    fold = flat.select("query_id", F.aggregate("rows", state, step).alias("f")).select("query_id", "f.used", "f.taken")
    of = lambda item: F.array_sort(F.transform(F.filter("taken", lambda x: x["rank"] == item["rank"]), lambda x: F.struct(x["no"], x["sentence"])))
    line = lambda item, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), item["tag"], F.array_join(F.transform(of(item), lambda x: x["sentence"]), " "))
    heads = F.array_distinct(F.transform("taken", lambda x: F.struct(x["rank"].alias("rank"), x["id"].alias("id"), x["tag"].alias("tag"))))
    shown = fold.withColumn("heads", heads).select("query_id", "used", F.array_join(F.transform("heads", line), "\n").alias("context"), F.transform("heads", lambda x: x["id"]).alias("ids"))
    raw = ranked.groupBy("query_id").agg(F.sum(F.coalesce(T.piece_tokens(F.col("text")), F.lit(0))).alias("n_raw_tokens"))
    none = F.array().cast(f"array<{ranked.schema['id'].dataType.simpleString()}>")
    return raw.join(shown, "query_id", "left").select("query_id", F.coalesce("context", F.lit("")).alias("context"), F.coalesce("used", F.lit(0)).cast("long").alias("n_tokens"), "n_raw_tokens", F.coalesce("ids", none).alias("ids"))


def extractive_answer(context: DataFrame, lines: int = 3) -> DataFrame:
    """query_id, answer: the first lines of the context."""
    return context.select("query_id", F.array_join(F.slice(F.split("context", "\n"), 1, lines), "\n").alias("answer"))


def route(context: DataFrame, best: DataFrame, strong: float = 0.45, least_tokens: int = 12) -> DataFrame:
    """query_id, route: memory where the evidence is near and long enough, else parametric; best: query_id, semantic."""
    ok = (F.col("semantic") >= strong) & (F.col("n_tokens") >= least_tokens)
    return context.join(best, "query_id", "left").select("query_id", F.when(ok, "memory").otherwise("parametric").alias("route"))
