"""Mixing sources to target weights (operator 3), in DataFrame functions only.

A low-discrepancy source schedule: slot i of the mix falls on the point ``frac(i * golden ratio)``; the point's place
among the cumulative weights names the source, and the slot's rank among the source's slots names a block of equal
token count on that source's line of shuffled documents (read round and round). So every stretch of the mix has the
target weights, and a document is taken as often as blocks over it are.

* The golden ratio is a 31-bit integer multiplier, so points are exact and reruns agree.
* Ranks are counted inside ``SLOT_CHUNK`` slots and then over chunks; documents are laid out by ``running_start``. No
  source has to be in one task.
* Rounding leaves a source some slots short or over; surplus slots fall out and missing ones stand at the end.
* ``mix`` names the slots in which each document is read (``slots``, the first one of each reading); ``mixed`` hands out
  whole documents in the order of these slots.

Null or empty texts have size 0 and are taken 0 times. Null sources are one source, which stands last. Repeated rows
are separate documents. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import Scratch, running_start, table, word_count

#: Weights of the sources in code point order, repeating; the most often that a word is taken; words in a block.
WEIGHTS, MOST, BLOCK = (5, 2, 1), 3, 128
SLOT_CHUNK = 1 << 16
_BITS = 31
_GOLDEN = 1327217885  # the odd integer next to 2^31 / golden ratio


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, target from source, source_size: weights share all sizes, with ``most`` as a bound.

    Sources reach their bound in the order of bound / weight; the level that the others share is found with running
    sums over that order, one row for each source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("weight", w).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    by_ratio = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before, since = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    s = s.withColumn("level", (F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(since))
    free = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct((F.col("cap") / F.col("weight")).alias("r"), F.col("level").alias("level")))
    s = s.withColumn("share", F.min(free).over(Window.partitionBy())["level"])
    return s.select("source", "source_size", F.when(F.col("share").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("share") * F.col("weight"))).alias("target"))


def schedule(quotas: DataFrame, slots: int) -> DataFrame:
    """source, rank, slot: which block (by rank) of which source stands in each slot; quotas: source, quota."""
    spark = quotas.sparkSession
    upto = Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    scale, cells = float(1 << _BITS), 4096
    q = quotas.withColumn("_to", F.sum("quota").over(upto))
    q = q.select("source", "quota", F.floor((F.col("_to") - F.col("quota")) * scale / slots).alias("lo"), F.floor(F.col("_to") * scale / slots).alias("hi")).where("hi > lo")
    width = (1 << _BITS) // cells
    by_cell = q.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))))
    i = F.col("id").bitwiseAND(F.lit((1 << _BITS) - 1))
    points = spark.range(slots).select(F.col("id").alias("slot"), (i * F.lit(_GOLDEN)).bitwiseAND(F.lit((1 << _BITS) - 1)).alias("point"))
    points = points.withColumn("cell", F.floor(F.col("point") / width))
    hit = points.join(by_cell, (points.cell == by_cell.cell) & (points.point >= by_cell.lo) & (points.point < by_cell.hi)).select("slot", "source", "quota", F.floor(F.col("slot") / SLOT_CHUNK).alias("chunk"))
    counts = hit.groupBy("source", "quota", "chunk").agg(F.count(F.lit(1)).alias("n"))
    run = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(F.col("source").alias("s"), F.col("chunk").alias("c"), F.coalesce(F.sum("n").over(run), F.lit(0)).alias("base"))
    inside = Window.partitionBy("source", "chunk").orderBy("slot")
    ranked = hit.withColumn("i", F.row_number().over(inside) - 1).join(bases, F.col("source").eqNullSafe(F.col("s")) & (F.col("chunk") == F.col("c")))
    ranked = ranked.select("source", "quota", (F.col("base") + F.col("i")).alias("rank"), "slot").where("rank < quota").select("source", "rank", "slot")
    have = counts.groupBy("source").agg(F.sum("n").alias("have")).withColumnRenamed("source", "s")
    late = quotas.join(have, F.col("source").eqNullSafe(F.col("s")), "left").where(F.coalesce("have", F.lit(0)) < F.col("quota"))
    late = late.select("source", F.explode(F.sequence(F.coalesce("have", F.lit(0)), F.col("quota") - 1)).alias("rank"))
    return ranked.unionByName(late.select("source", "rank", (F.lit(slots) + F.col("rank")).alias("slot")))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, block: int = BLOCK, seed: int = 1) -> DataFrame:
    """For each row of ``docs`` (doc_id, text, source): doc_id, size, source_size, target, taken; also first_slot (null where
    nothing is taken), slots (for each reading of the source's line, the slot where this document begins, or null), start
    (its place on that line, in words), source and text_hash."""
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark, "mix")
    text, size = F.col("text").cast("string"), word_count(F.col("text").cast("string"))
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), F.xxhash64(text).alias("h2"))
    # the text is part of the order, so that rows without a doc_id spread out too
    sized = scratch.keep(sized.withColumn("h", F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "h2"), 2)), "sized")
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    goal = targets(sums.select("source", "source_size"), weights, most)
    goal = goal.withColumn("words", F.round("target").cast("long")).withColumn("quota", F.ceil(F.col("words") / block))
    goal = scratch.keep(goal, "targets")
    slots, rows = goal.agg(F.sum("quota")).first()[0] or 0, sized.count()
    cells = max(256, 1 << math.ceil(math.log2(max(1, rows / 100_000))))
    laid = scratch.keep(running_start(sized, ["source"], ["h", "doc_id", "h2", "size"], "size", "start", scratch, cells), "laid")
    g = goal.select(F.col("source").alias("s"), "source_size", "target", "words")
    # each reading of the source's line, cut where the target ends, and then into blocks
    read = laid.where("size > 0").join(g, F.col("source").eqNullSafe(F.col("s"))).withColumn("row", F.struct("doc_id", "h2", "start"))
    read = read.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(most - 1)))).withColumn("lo", F.col("start") + F.col("turn") * F.col("source_size"))
    read = read.where("lo < words").withColumn("hi", F.least(F.col("lo") + F.col("size"), F.col("words")))
    cut = read.withColumn("rank", F.explode(F.sequence(F.floor(F.col("lo") / block), F.floor((F.col("hi") - 1) / block))))
    cut = cut.withColumn("part", F.least("hi", (F.col("rank") + 1) * block) - F.greatest("lo", F.col("rank") * block))
    order = schedule(goal.where("quota > 0").select("source", "quota"), slots) if slots else spark.createDataFrame([], "source string, rank long, slot long")
    o = order.select(F.col("source").alias("os"), F.col("rank").alias("r"), "slot")
    taken = cut.select("row", "source", "turn", "rank", "part").join(o, F.col("source").eqNullSafe(F.col("os")) & (F.col("rank") == F.col("r")))
    # a reading begins in the slot of its first block, wherever the schedule has put it
    begins = F.array(*[F.min_by(F.when(F.col("turn") == t, F.col("slot")), F.when(F.col("turn") == t, F.col("rank"))) for t in range(most)])
    taken = taken.groupBy("row", F.col("source").alias("ts")).agg(F.sum("part").alias("taken"), begins.alias("slots"))
    out = laid.join(taken, F.struct("doc_id", "h2", "start").eqNullSafe(F.col("row")) & F.col("source").eqNullSafe(F.col("ts")) & (F.col("size") > 0), "left")
    out = out.join(g, F.col("source").eqNullSafe(F.col("s")))
    out = out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.array_min("slots").alias("first_slot"), "slots", "start", "source", F.col("h2").alias("text_hash"))
    out = scratch.keep(out, "mix")
    scratch.clear(out)
    return out


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as ``mix`` takes it, to the nearest whole document, in slot order.

    A copy stands at the slot where its reading begins. Partitions hold stretches of the mix, each in order. Of repeated
    rows (equal doc_id and text), each gets its share of the copies.
    """
    times = ((2 * F.col("taken") + F.col("size")) / (2 * F.greatest("size", F.lit(1)))).cast("int")
    got = mix(docs, **options).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_h"), times.alias("_times"), F.col("slots").alias("_slots"))
    same = Window.partitionBy("_id", "_h")
    got = got.withColumn("_m", F.count(F.lit(1)).over(same))
    repeated = got.where("_m > 1").limit(1).count() > 0
    last = got.agg(F.max(F.array_max("_slots"))).first()[0] or 0
    copies = got.where("_times > 0").select("_id", "_h", "_m", F.explode(F.slice("_slots", F.lit(1), F.col("_times"))).alias("_slot"))
    turn = F.pmod(F.row_number().over(same.orderBy("_slot")) - 1, F.col("_m").cast("int")) if repeated else F.lit(0)
    copies = copies.withColumn("_turn", turn)
    # whole rows travel as one column, so that their names clash with none here
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    rows = rows.withColumn("_id_", F.col("row.doc_id").cast("long")).withColumn("_h_", F.xxhash64(F.col("row.text").cast("string")))
    mine = F.row_number().over(Window.partitionBy("_id_", "_h_").orderBy(F.xxhash64(*[F.col(f"row.`{c}`") for c in docs.columns]))) - 1 if repeated else F.lit(0)
    hit = rows.withColumn("_mine", mine).join(copies, F.col("_id_").eqNullSafe(F.col("_id")) & (F.col("_h_") == F.col("_h")) & (F.col("_mine") == F.col("_turn")))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stretch = F.floor(F.col("_slot") * parts / (last + 1))
    return hit.select("row", "_slot").repartition(parts, stretch).sortWithinPartitions("_slot").select("row.*")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken", "first_slot")
