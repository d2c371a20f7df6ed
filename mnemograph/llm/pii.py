r"""Personal data by bootstrapped contextual extraction (operator 12), in DataFrame functions only.

Seeds are what four patterns find in every whole text: mail addresses, internet addresses (parts at most 255), card numbers
(12 to 19 digits that pass Luhn) and phone numbers (9 to 15 digits), leftmost and without overlap within a kind.

1. A mention is a run of words with a digit or ``@`` in them, without signs at its ends. Its letters in lower case are the
   instance; if it holds a seed, the instance has the seed's kind. Three patterns surround it: the two words before it, the
   two behind it, and the one on either side. What stands in several copies of a text is one edge of the graph, as pattern
   and instance are the same.
2. Each round scores patterns by their instances: for each kind, the scores of its instances over the number of all
   different instances of the pattern and one unknown one, in whole thousandths. From ``LEAST`` instances of the kind on and
   at ``SURE`` or more, a pattern is trusted.
3. Then instances without a kind are scored by their trusted patterns. They take the kind of the best one, if they look
   like a seed of that kind (equal but for digits and letters) or have two trusted patterns of that kind; a kind found so
   counts with the pattern's score in the next round. Rounds end when one finds nothing, after ``ROUNDS`` at the latest.
4. All mentions of an instance found so become spans of its kind, unless they overlap a seed.

The graph has a row for each different (pattern, instance), and is summed up in partial aggregates, so many tasks share a
busy pattern. Only the count of what a round finds reaches the driver. A match's place is a running sum over the matches of
its own text. Null texts are empty and have no span; null and repeated doc_ids are rows like any other; an empty table
gives no row. Texts of any length are searched whole. Other columns are not read, so their names clash with nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import SPACE_CLASS, Scratch, table

# The kinds in their order, and what finds them.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must have for a search to be worth while.
NEEDS = {"email": r"@[A-Za-z0-9-]++\.", "ip": r"[0-9]\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){11}", "phone": r"\+[0-9]"}
LEAST, SURE, ROUNDS = 4, 700, 8

_S = SPACE_CLASS
_WORD = rf"[^{_S}0-9@]*+[0-9@][^{_S}]*+"
MENTION = rf"(?<![^{_S}]){_WORD}(?:\x20{_WORD})*+"


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    n = F.length(digits)
    value = lambda i: F.substring(digits, n - i, F.lit(1)).cast("int")
    each = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(i % 2 == 0, value(i)).when(value(i) > 4, 2 * value(i) - 9).otherwise(2 * value(i)))
    return F.aggregate(each, F.lit(0), lambda s, x: s + x) % 10 == 0


def valid(kind: str, found: Column) -> Column:
    """Whether a match of the kind's pattern counts."""
    digits = F.regexp_replace(found, "[^0-9]", "")
    if kind == "ip":
        short = F.transform(F.split(found, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
        return ~F.exists(short, lambda p: F.when(F.length(p) > 3, True).otherwise(F.right(p, F.lit(3)).cast("int") > 255))
    if kind == "card":
        return F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _pattern_of(before: Column, after: Column) -> Column:
    """The patterns of a mention between two stretches of text: those whose words are all there."""
    turned = F.reverse(F.lower(before))
    left = lambda i: F.reverse(F.regexp_extract(turned, rf"^[{_S}]*+([^{_S}]*+)[{_S}]*+([^{_S}]*+)", i))
    right = lambda i: F.regexp_extract(F.lower(after), rf"^[{_S}]*+([^{_S}]*+)[{_S}]*+([^{_S}]*+)", i)
    each = [F.when(left(2) != "", F.concat(F.lit("L "), left(2), F.lit(" "), left(1))), F.when(right(2) != "", F.concat(F.lit("R "), right(1), F.lit(" "), right(2))), F.when((left(1) != "") & (right(1) != ""), F.concat(F.lit("M "), left(1), F.lit(" "), right(1)))]
    return F.filter(F.array(*each), lambda p: p.isNotNull())


def _kind_of(mention: Column) -> Column:
    """The first kind of which a mention holds a valid match, or null."""
    held = lambda k: F.when(mention.rlike(NEEDS[k]), F.exists(F.regexp_extract_all(mention, F.lit(PATTERNS[k]), F.lit(0)), lambda m: valid(k, m))).otherwise(False)
    return F.coalesce(*[F.when(held(k), F.lit(i)) for i, k in enumerate(KINDS)])


_SPAN = "array<struct<gap:int,size:int,good:boolean,kind:int,surface:string,patterns:array<string>>>"


def searched(docs: DataFrame) -> DataFrame:
    """row, doc_id, s0 to s3, mentions: for each document, its matches of each kind and its mentions, in order.

    Each match has the length of what stands between it and the one before (gap) and its own (size).
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    needs = NEEDS | {"mention": "[0-9@]"}
    for name, pattern in (PATTERNS | {"mention": MENTION}).items():
        ask = F.col("text").rlike(needs[name])
        out = out.withColumns({f"m_{name}": F.when(ask, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))), f"g_{name}": F.when(ask, F.split("text", pattern, -1))})
    none = F.array().cast(_SPAN)
    nothing = [F.lit(None).cast("string").alias("surface"), F.lit(None).cast("array<string>").alias("patterns")]
    seed = lambda i, k: F.transform(f"m_{k}", lambda m, at: F.struct(F.length(F.get(f"g_{k}", at)).alias("gap"), F.length(m).alias("size"), valid(k, m).alias("good"), F.lit(i).alias("kind"), *nothing))

    def mention(m: Column, at: Column) -> Column:
        gap, after = F.get("g_mention", at), F.get("g_mention", at + 1)
        lead, tail = F.regexp_extract(m, "^[^A-Za-z0-9+@#]*+", 0), F.regexp_extract(F.reverse(m), "^[^A-Za-z0-9]*+", 0)
        bare = F.substring(m, F.length(lead) + 1, F.length(m) - F.length(lead) - F.length(tail))
        # signs at the ends belong to what stands between; those behind it are taken off again when places are summed up
        return F.struct((F.length(gap) + F.length(lead)).alias("gap"), (F.length(m) - F.length(lead)).alias("size"), F.lit(True).alias("good"), _kind_of(m).alias("kind"), F.lower(bare).alias("surface"), _pattern_of(gap, after).alias("patterns"))

    parts = {f"s{i}": F.coalesce(seed(i, k), none) for i, k in enumerate(KINDS)}
    return out.select("row", "doc_id", *[c.alias(n) for n, c in parts.items()], F.coalesce(F.transform("m_mention", mention), none).alias("mentions"))


def placed(found: DataFrame) -> DataFrame:
    """row, kind, start, end, mention, surface, patterns: the matches that count, with their places in code points."""
    flat = [found.where(F.size(c) > 0).select("row", F.lit(i).alias("stream"), F.posexplode(c).alias("pos", "m")).select("row", "stream", "pos", "m.*") for i, c in enumerate(("s0", "s1", "s2", "s3", "mentions"))]
    order = Window.partitionBy("row", "stream").orderBy("pos")
    rows = reduce(DataFrame.unionByName, flat).withColumn("upto", F.sum(F.col("gap") + F.col("size")).over(order))
    mention = F.col("stream") == 4
    start = F.col("upto") - F.col("size")
    end = F.when(mention, start + F.length("surface")).otherwise(F.col("upto"))
    return rows.where("good").select("row", "kind", start.alias("start"), end.alias("end"), mention.alias("mention"), "surface", "patterns")


def shape(surface: Column) -> Column:
    """An instance with digits as 0 and letters, however many, as a."""
    return F.regexp_replace(F.regexp_replace(surface, "[0-9]", "0"), r"\p{L}+", "a")


def discover(spans: DataFrame, scratch: Scratch, least: int = LEAST, sure: int = SURE, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(instance, kind, score) of the instances without a seed that trusted patterns find, and the patterns (pattern, kind, score)."""
    mentions = spans.where("mention and surface <> ''")
    graph = mentions.select(F.explode("patterns").alias("pattern"), F.col("surface").alias("instance"), "kind").groupBy("pattern", "instance").agg(F.min("kind").alias("kind"))
    # patterns of fewer instances are never trusted; sizes of the others stay as they are
    sizes = graph.groupBy("pattern").agg(F.count(F.lit(1)).alias("size"), F.count("kind").alias("seeds")).where((F.col("size") >= least) & (F.col("seeds") > 0))
    graph = scratch.keep(graph.join(sizes.select("pattern", "size"), "pattern"), "graph")
    looks = scratch.keep(mentions.where("kind is not null").select(shape(F.col("surface")).alias("seen"), F.col("kind").alias("k")).distinct(), "looks")
    found = scratch.keep(graph.select("instance", "kind", F.lit(0).alias("score")).limit(0), "found")
    trusted = None
    for _ in range(rounds):
        known = graph.select("pattern", "size", "instance", "kind").join(found.select("instance", F.col("kind").alias("new"), "score"), "instance", "left")
        told = known.select("pattern", "size", F.coalesce("kind", "new").alias("kind"), F.when(F.col("kind").isNotNull(), 1000).otherwise(F.col("score")).alias("score")).where("kind is not null")
        trusted = told.groupBy("pattern", "size", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("s")).where(F.col("n") >= least)
        trusted = trusted.select("pattern", "kind", F.floor(F.col("s") / (F.col("size") + 1)).cast("int").alias("score")).where(F.col("score") >= sure)
        open_ = graph.where("kind is null").join(found, "instance", "left_anti").select("instance", "pattern")
        asked = open_.join(trusted, "pattern").groupBy("instance", "kind").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("score"))
        asked = asked.withColumn("look", shape(F.col("instance"))).join(looks, (F.col("look") == F.col("seen")) & (F.col("kind") == F.col("k")), "left")
        fine = asked.where((F.col("n") >= 2) | F.col("k").isNotNull())
        new = fine.groupBy("instance").agg(F.min(F.struct((-F.col("score")).alias("s"), "kind")).alias("b")).select("instance", "b.kind", (-F.col("b.s")).alias("score"))
        more = scratch.keep(new, "new")
        if more.isEmpty():
            break
        found = scratch.keep(found.unionByName(more), "found")
    return found, trusted


def personal_data(docs: DataFrame, least: int = LEAST, sure: int = SURE, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, base, spans for each row of ``docs`` (doc_id, text): arrays of (start, kind, end), kind as its place in KINDS, in order.

    ``base`` has what the patterns find, ``spans`` also what contexts add.
    """
    scratch = Scratch(docs.sparkSession, "personal")
    found = scratch.keep(searched(docs), "searched")
    spans = scratch.keep(placed(found), "spans")
    new, _ = discover(spans, scratch, least, sure, rounds)
    hit = spans.where("mention and kind is null").join(new.select(F.col("instance").alias("surface"), F.col("kind").alias("k")), "surface").select("row", F.col("k").alias("kind"), "start", "end", F.lit(True).alias("added"))
    base = spans.where("not mention").select("row", "kind", "start", "end", F.lit(False).alias("added"))
    # a span that is added overlaps no seed that begins before or after it
    order = Window.partitionBy("row").orderBy("start", "added", "kind")
    seed_end, seed_start = F.when(~F.col("added"), F.col("end")), F.when(~F.col("added"), F.col("start"))
    near = base.join(hit.select("row").distinct(), "row", "left_semi").unionByName(hit)
    near = near.withColumns({"before": F.max(seed_end).over(order.rowsBetween(Window.unboundedPreceding, 0)), "after": F.min(seed_start).over(order.rowsBetween(0, Window.unboundedFollowing))})
    added = near.where("added and coalesce(before <= start, true) and coalesce(after >= end, true)").select("row", "kind", "start", "end", "added")
    span = F.struct("start", "kind", "end")
    lists = base.unionByName(added).groupBy("row").agg(F.array_sort(F.collect_list(F.when(~F.col("added"), span))).alias("base"), F.array_sort(F.collect_list(span)).alias("spans"))
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    return found.select("row", "doc_id").join(lists, "row", "left").select("doc_id", F.coalesce(F.col("base").cast("array<struct<start:bigint,kind:int,end:bigint>>"), none).alias("base"), F.coalesce(F.col("spans").cast("array<struct<start:bigint,kind:int,end:bigint>>"), none).alias("spans"))


def written(spans: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kinds = F.col("base")["kind"]
    counts = [(F.size("base") - F.size(F.array_remove(kinds, i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
