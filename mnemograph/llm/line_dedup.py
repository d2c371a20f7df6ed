"""Line dedup (operator 9): a segment-partition edit join, in DataFrame functions only.

A line of at least ``MIN_CHARS`` characters is dropped when an equal line, or one within ``EDITS`` insertions, deletions
and substitutions of it, stands first elsewhere: "first" is the order of (doc_id, text hash, line number), and a line
content counts where it first stands. Shorter lines stay.

* Each distinct line is cut into ``EDITS + 1`` even segments; if two lines are within ``EDITS`` edits, a segment of the
  shorter one stands unchanged in the longer one, within the shifts of the multi-match-aware window. Segments and the
  substrings to probe are hashed together with segment number and line length, so the indexes are length-aware and the
  join is an equi-join of numbers without texts.
* Candidates are verified by a banded bit-parallel edit distance (``within_edits``): the vertical differences of the
  diagonal band are bits of two numbers, and a character of the other line moves all of them in a few bit operations.
* A segment that more than ``COMMON`` lines share would make all pairs of them. If the lines agree in segment i of 3, no
  more than i edits lie before it and 2 - i behind it, so one of a few parts of the rest agrees too, at a place that the
  number of edits fixes: ``inner_keys`` and ``outer_keys`` add such parts to the segment, which makes keys of 5/9 of a line
  or more. Lines that share even such a key in more than ``COMMON`` copies are verified inside a left semi join, by the
  built-in ``levenshtein`` with a bound: it stops at a line's first match and makes one row for each line and key at most.

Null texts have no lines. Repeated rows (equal doc_id and text) count as one document: none of them loses lines to the
other. A null doc_id stands before all others. Other columns are kept as they are.
"""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Scratch, table

EDITS, MIN_CHARS, COMMON = 2, 24, 12
#: Most candidate lines that are broadcast to pick out their texts; beyond it they are joined.
BROADCAST_ROWS = 300_000


def _segments(n: Column, edits: int) -> list[tuple[Column, Column]]:
    """(start from 1, length) of the edits + 1 even segments of a line of n characters."""
    out, start = [], F.lit(1)
    for i in range(edits + 1):
        size = F.floor((n + i) / (edits + 1)).cast("int")
        out.append((start, size))
        start = start + size
    return out


def index_keys(line: Column, n: Column, edits: int = EDITS) -> list[Column]:
    return [F.xxhash64(F.lit(i), n, F.substring(line, s, k)) for i, (s, k) in enumerate(_segments(n, edits))]


def probe_keys(line: Column, n: Column, edits: int = EDITS) -> list[Column]:
    """Keys under which lines of n characters or up to ``edits`` fewer, within ``edits`` edits, have a segment."""
    out = []
    for d in range(edits + 1):
        m = n - d
        for i, (s, k) in enumerate(_segments(m, edits)):
            for shift in range(max(-i, d - (edits - i)), min(i, d + edits - i) + 1):
                at = s + shift
                key = F.xxhash64(F.lit(i), m, F.substring(line, at, k))
                out.append(F.when((at >= 1) & (at + k - 1 <= n), key))
    return out


# The probes of a line, in the order of ``probe_keys``: segment, shift, and by how many characters the other line is shorter.
def _probes(edits: int) -> list[tuple[int, int, int]]:
    return [(i, shift, d) for d in range(edits + 1) for i in range(edits + 1) for shift in range(max(-i, d - (edits - i)), min(i, d + edits - i) + 1)]


def _thirds(part: Column, n: Column, own: Column) -> list[Column]:
    """Of a part of a line that up to two edits change to ``part``, and that has n characters: where its thirds would stand.

    The first one at the beginning, the last one at the end, and, where it is the only one without an edit, the middle
    one a place before or behind its own at most.
    """
    k = F.floor(n / 3).cast("int")
    first, last = F.substring(part, F.lit(1), k), F.substring(part, F.length(part) - (n - 2 * k) + 1, n - 2 * k)
    middle = [F.when(k + 1 + shift >= 1, F.substring(part, k + 1 + shift, k)) for shift in (-1, 0, 1)]
    return [first, F.when(F.length(part) >= n - 2 * k, last), *[F.when(own & F.lit(shift != 0), None).otherwise(m) for m, shift in zip(middle, (-1, 0, 1))]]


def _halves(part: Column, n: Column) -> list[Column]:
    """Of a part of n characters that up to one edit changes to ``part``: its halves, one at the beginning, the other at the end."""
    k = F.floor(n / 2).cast("int")
    return [F.substring(part, F.lit(1), k), F.when(F.length(part) >= n - k, F.substring(part, F.length(part) - (n - k) + 1, n - k))]


def rest_keys(line: Column, key: Column, i: Column, start: Column, size: Column, m: Column, own: bool, edits: int = EDITS) -> Column:
    """Longer keys of a line that holds a segment: number i of a line of m characters, of ``size`` characters, from ``start`` on.

    ``own``: the segment is the line's own; else it is a probe. Middle parts that are shifted are probes only.
    """
    before, behind = F.substring(line, F.lit(1), start - 1), F.substring(line, start + size, F.length(line))
    at, none = [F.floor((m + j) / (edits + 1)).cast("int") for j in range(edits + 1)], F.lit(own)
    tag = lambda no, part: F.when(part.isNotNull(), F.xxhash64(key, F.lit(no), part))
    # the same number for a middle part, whatever its shift
    three = lambda part, n: [tag(no, x) for no, x in zip((0, 1, 2, 2, 2), _thirds(part, n, none))]
    two = [tag(3 + 2 * x + y, F.concat(p, F.lit("\n"), q)) for x, p in enumerate(_halves(before, at[0])) for y, q in enumerate(_halves(behind, at[2]))]
    keys = F.when(i == 0, F.array(*three(behind, at[1] + at[2]))).when(i == 1, F.array(*two)).otherwise(F.array(*three(before, at[0] + at[1])))
    return F.filter(keys, lambda x: x.isNotNull())


def within_edits(a: Column, b: Column, edits: int = EDITS) -> Column:
    """Whether two lines, whose lengths differ by ``edits`` at most, are within so many edits.

    Bit r of vp (vn) tells that the cost rises (falls) from one row of the band to the next; the band of 2 * edits + 2 rows
    moves down a row with each character of the shorter line. The cost is followed along the band's lower edge to the last
    row of the longer line, and then along this row.
    """
    width = 2 * edits + 2
    full = (1 << width) - 1
    short = F.length(a) < F.length(b)
    longer, shorter = F.when(short, b).otherwise(a), F.when(short, a).otherwise(b)
    let = lambda value, use: F.element_at(F.transform(F.array(value), use), 1)
    is_set = lambda x, bit: F.call_function("shiftright", x, bit).bitwiseAND(F.lit(1))
    no = lambda x: x.bitwiseXOR(F.lit(full))

    def walk(pair):
        rows, columns, m, n = (pair[c] for c in ("rows", "columns", "m", "n"))

        def step(state, j):
            vp, vn, cost = state["vp"], state["vn"], state["cost"]

            def moved(d0):
                def placed(hp):
                    hn, half = d0.bitwiseAND(vp), F.shiftright(d0, 1)
                    # down the band's edge, then along the last row
                    bit = F.greatest(F.lit(0), width - 2 - (j - (m - edits)))
                    change = F.when(j < m - edits, 1 - is_set(d0, F.lit(width - 1))).otherwise(is_set(hp, bit) - is_set(hn, bit))
                    return F.struct(hn.bitwiseOR(no(half.bitwiseOR(hp))).alias("vp"), half.bitwiseAND(hp).alias("vn"), (cost + change).alias("cost"))

                return let(vn.bitwiseOR(no(d0.bitwiseOR(vp))), placed)

            def matched(pm):
                return let((pm.bitwiseAND(vp) + vp).bitwiseAND(F.lit(full)).bitwiseXOR(vp).bitwiseOR(pm).bitwiseOR(vn), moved)

            def bits(c):
                return reduce(operator.add, [F.when(F.get(rows, j + (edits + 1 - width + r)) == c, 1 << r).otherwise(0) for r in range(width)])

            # a cost that can't come down to the bound stays
            return F.when(cost > 2 * edits + n - m, state).otherwise(let(let(F.get(columns, j), bits), matched))

        start = F.struct(F.lit(full ^ ((1 << (width - edits - 1)) - 1)).alias("vp"), F.lit(0).alias("vn"), F.lit(edits).alias("cost"))
        return F.aggregate(F.sequence(F.lit(0), n - 1), start, step)["cost"]

    return let(F.struct(F.split(longer, "").alias("rows"), F.split(shorter, "").alias("columns"), F.length(longer).alias("m"), F.length(shorter).alias("n")), walk) <= edits


def lines_of(docs: DataFrame, least: int = MIN_CHARS) -> DataFrame:
    """doc_id, h (text hash), no, line, n for each line of at least ``least`` characters with a word."""
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), F.posexplode(F.split(text, "\n", -1)).alias("no", "line"))
    return rows.withColumn("n", F.length("line")).where((F.col("n") >= least) & (F.ltrim("line", F.lit(" \t\x0b\x0c\r")) != ""))


def dropped_lines(docs: DataFrame, scratch: Scratch, edits: int = EDITS, least: int = MIN_CHARS) -> DataFrame:
    """doc_id, h, no, n, near: the lines to drop; near is false where an equal line stands before."""
    docs = docs.select("doc_id", "text")
    lines = lines_of(docs, least)
    key = [F.xxhash64("line").alias("k"), F.xxhash64(F.lit(9), "line").alias("k2")]
    place = F.struct("doc_id", "h", "no")
    n = F.col("n")
    hashed = lines.select(*key, "n", place.alias("place"), F.array(*index_keys(F.col("line"), n, edits)).alias("own"), F.array(*probe_keys(F.col("line"), n, edits)).alias("probe"))
    first = hashed.groupBy("k", "k2", "n").agg(F.min("place").alias("place"), F.first("own").alias("own"), F.first("probe").alias("probe"))
    first = scratch.keep(first, "first")

    own = first.select(F.col("k").alias("ik"), "n", F.posexplode("own").alias("slot", "key"))
    probe = first.select(F.col("k").alias("pk"), "n", F.posexplode("probe").alias("slot", "key")).where("key is not null")
    # keys of many lines, counted with partial sums
    busy = scratch.keep(own.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > COMMON).select("key"), "busy")
    busy = F.broadcast(busy) if busy.count() <= BROADCAST_ROWS else busy
    rare = probe.join(own.join(busy, "key", "left_anti").select("ik", "key"), "key").where("pk <> ik").select("pk", "ik").distinct()
    rare = scratch.keep(rare, "pairs")
    common = scratch.keep(own.join(busy, "key", "left_semi"), "common")
    asked = scratch.keep(probe.join(busy, "key", "left_semi"), "asked")

    # the texts of the lines that are candidates
    wanted = rare.select(F.col("pk").alias("k")).union(rare.select("ik")).union(common.select("ik")).union(asked.select("pk")).distinct()
    wanted = scratch.keep(wanted.join(first.select("k", "k2", "place"), "k"), "wanted")
    few = wanted.count() <= BROADCAST_ROWS
    homes = wanted.select(F.col("place.doc_id").alias("home")).distinct()
    inside = docs.join(F.broadcast(homes) if few else homes, docs.doc_id.cast("long").eqNullSafe(F.col("home")), "left_semi")
    pick = wanted.select("k", "k2", F.col("place.doc_id").alias("wd"), F.col("place.h").alias("wh"), F.col("place.no").alias("wn"))
    at_home = (F.col("k_") == F.col("k")) & (F.col("no") == F.col("wn")) & (F.col("h") == F.col("wh")) & F.col("doc_id").eqNullSafe(F.col("wd"))
    texts = lines_of(inside, least).withColumn("k_", F.xxhash64("line")).join(F.broadcast(pick) if few else pick, at_home)
    texts = scratch.keep(texts.select("k", "line", F.struct("doc_id", "h", "no").alias("place")).dropDuplicates(["k"]), "texts")

    a, b = (texts.select(F.col("k").alias(x + "k"), F.col("line").alias(x + "l"), F.col("place").alias(x + "p")) for x in "pi")
    later = F.when(F.col("pp") > F.col("ip"), F.col("pk")).otherwise(F.col("ik")).alias("k")
    # busy keys are made longer by parts of the rest of the line
    segments = F.array(*[F.struct(s.alias("start"), k.alias("size")) for s, k in _segments(F.col("m"), edits)])
    probes = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(shift).alias("shift"), F.lit(d).alias("d")) for i, shift, d in _probes(edits)])
    inner = common.join(b, "ik").withColumn("m", F.col("n")).withColumn("g", F.element_at(segments, F.col("slot") + 1))
    inner = inner.select("ik", "il", "ip", F.explode(F.array_distinct(rest_keys(F.col("il"), F.col("key"), F.col("slot"), F.col("g.start"), F.col("g.size"), F.col("m"), True, edits))).alias("key"))
    inner = scratch.keep(inner, "inner")
    outer = asked.join(a, "pk").withColumn("p", F.element_at(probes, F.col("slot") + 1)).withColumn("m", F.col("n") - F.col("p.d")).withColumn("g", F.element_at(segments, F.col("p.i") + 1))
    outer = outer.select("pk", "pl", "pp", F.explode(F.array_distinct(rest_keys(F.col("pl"), F.col("key"), F.col("p.i"), F.col("g.start") + F.col("p.shift"), F.col("g.size"), F.col("m"), False, edits))).alias("key"))
    outer = scratch.keep(outer, "outer")
    still = scratch.keep(inner.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > COMMON).select("key"), "still")
    still = F.broadcast(still) if still.count() <= BROADCAST_ROWS else still
    pairs = outer.select("pk", "key").join(inner.join(still, "key", "left_anti").select("ik", "key"), "key").where("pk <> ik").select("pk", "ik")
    cold = rare.union(pairs).distinct().join(a, "pk").join(b, "ik").where(F.abs(F.length("pl") - F.length("il")) <= edits)
    cold = cold.where(within_edits(F.col("pl"), F.col("il"), edits)).select(later)
    short_side, long_side = inner.join(still, "key", "left_semi").withColumnRenamed("key", "ikey"), outer.join(still, "key", "left_semi")
    # levenshtein gives -1 beyond its bound
    match = (F.col("key") == F.col("ikey")) & (F.col("pk") != F.col("ik")) & (F.levenshtein(F.col("pl"), F.col("il"), edits) >= 0)
    hot = long_side.join(short_side, match & (F.col("ip") < F.col("pp")), "left_semi").select(F.col("pk").alias("k"))
    hot = hot.union(short_side.join(long_side, match & (F.col("pp") < F.col("ip")), "left_semi").select(F.col("ik").alias("k")))
    close = cold.union(hot).distinct().withColumn("close", F.lit(True))

    fate = scratch.keep(first.select("k", "k2", "place").join(close, "k", "left"), "fate")
    occurs = lines.select("doc_id", "h", "no", "n", *key)
    out = occurs.join(fate, ["k", "k2"]).where(F.coalesce("close", F.lit(False)) | (F.struct("doc_id", "h", "no") != F.col("place")))
    # an equal row of the same document is not "elsewhere"; its lines have the same place and stay with it
    return out.select("doc_id", "h", "no", "n", F.coalesce("close", F.lit(False)).alias("near"))


def dedup_lines(docs: DataFrame, edits: int = EDITS, least: int = MIN_CHARS) -> DataFrame:
    """``docs`` without the dropped lines; where ``n_chars`` is a column, it is set anew."""
    scratch = Scratch(docs.sparkSession, "lines")
    gone = dropped_lines(docs, scratch, edits, least).groupBy(F.col("doc_id").alias("_d"), F.col("h").alias("_h")).agg(F.collect_set("no").alias("_gone"))
    # whole rows travel as one column, so that their names clash with none here
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    text = F.col("row.text").cast("string")
    joined = rows.join(gone, F.col("row.doc_id").cast("long").eqNullSafe(F.col("_d")) & (F.xxhash64(text) == F.col("_h")), "left")
    # the numbers of the lines that stay are found as a set, and the text is split once
    stay = lambda lines: F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_gone")), lambda i: F.get(lines, i))
    kept = F.element_at(F.transform(F.array(F.split(text, "\n", -1)), lambda lines: F.array_join(stay(lines), "\n")), 1)
    out = joined.withColumn("_new", F.when(F.col("_gone").isNull(), text).otherwise(kept))
    new = {"text": F.col("_new").alias("text"), "n_chars": F.length("_new").cast("long").alias("n_chars")}
    return out.select(*[new.get(c, F.col(f"row.`{c}`").alias(c)) for c in docs.columns])


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_equal, n_near, chars_dropped for each document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    gone = dropped_lines(docs, Scratch(spark, "lines"))
    gone = gone.groupBy(F.col("doc_id").alias("d"), "h").agg(F.count_if(~F.col("near")).alias("e"), F.count_if("near").alias("m"), F.sum("n").alias("c"))
    rows = docs.select("doc_id", F.xxhash64("text").alias("th"), F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(0)).alias("n_lines"))
    out = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("h")), "left")
    return out.select("doc_id", F.greatest("n_lines", F.lit(0)).cast("long").alias("n_lines"), *[F.coalesce(c, F.lit(0)).cast("long").alias(n) for c, n in (("e", "n_equal"), ("m", "n_near"), ("c", "chars_dropped"))])


SQL = f"""
WITH l AS (
  SELECT doc_id, md5(text) AS h, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS no
  FROM documents),
u AS (
  SELECT * FROM l WHERE length(line) >= {MIN_CHARS} AND regexp_matches(line, '[^ \\t\\n\\x0B\\x0C\\r]')),
f AS (SELECT line, length(line) AS n, min((doc_id, no)) AS place FROM u GROUP BY line),
c AS (
  SELECT DISTINCT b.line FROM f a JOIN f b
  ON a.n BETWEEN b.n - {EDITS} AND b.n + {EDITS} AND a.place < b.place
  WHERE levenshtein(a.line, b.line) <= {EDITS}),
g AS (
  SELECT u.doc_id, count(*) FILTER (c.line IS NULL) AS e, count(c.line) AS m, sum(f.n) AS s
  FROM u JOIN f USING (line) LEFT JOIN c USING (line)
  WHERE c.line IS NOT NULL OR (u.doc_id, u.no) <> f.place GROUP BY u.doc_id)
SELECT d.doc_id, coalesce(len(string_split(d.text, chr(10))), 0) AS n_lines, coalesce(e, 0) AS n_equal,
       coalesce(m, 0) AS n_near, coalesce(s, 0)::BIGINT AS chars_dropped
FROM documents d LEFT JOIN g USING (doc_id)
"""
