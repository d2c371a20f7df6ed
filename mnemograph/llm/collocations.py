r"""Phrase collocations (operator 13): phrases of two to five words that stand together more often than their parts explain.

Texts are lower-cased (A-Z), split at ``[.,;:!?\x0A-\x0D]`` into pieces and those into words ``[^\x20\x09]+``. Counts are
of all texts of a language, occurrences may overlap, and none crosses a piece.

1. A first pass counts words, a second one pairs of frequent words, in each task before anything is shuffled. A word is a
   64-bit hash of its language and letters; a second hash is counted along, and should two words share the first, the pass
   is run anew with another seed.
2. Only suffixes that begin with two frequent pairs can begin a frequent phrase of three words or more. Bit filters of
   frequent words and pairs, of at most 2^``FILTER_BITS`` bits whatever their number, go to the tasks of the next pass; what
   they let through by mistake is counted and found infrequent later. Each task joins equal suffixes, cut at five words or at
   the first infrequent pair, into one with a weight.
3. Suffixes are routed by their leading words, so that all of a phrase meet. In a task, pointers to them are sorted
   by multikey three-way quicksort: a pivot word parts them into smaller, equal and larger; the weight of the equal part is
   the count of the phrase so far, and goes on to the next word; parts lighter than the least count are abandoned.
   Leading pairs with more than ``GROUP_ROWS`` different suffixes are routed by a third word too; triples with more than
   that have their prefixes counted by partial sums, so no task holds a group of any size.
4. Cuts of a phrase look their parts up in the table of frequent phrases, in decimals of 38 digits.

Null texts are empty, a null language is ``und``. Empty tables and texts without words give no row. Repeated rows count
each time, very long texts go in blocks of about 4 MB where blanks allow it. Other columns are not read, so their names
clash with nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textblocks as B
from .shared import Scratch, table

LEAST, LONGEST, BEST = 100, 5, 2000
FILTER_BITS, PROBES = 26, 3
#: Different suffixes of a leading pair, or triple, beyond which it is split; rows that a task gathers before it joins equal ones.
GROUP_ROWS, FLUSH = 250_000, 1_000_000

_BREAK, _BLANK = np.zeros(256, bool), np.zeros(256, bool)
_BREAK[[10, 11, 12, 13, *b".,;:!?"]] = True
_BLANK[[9, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ODD = np.uint64(0x9E3779B97F4A7C15)


class Pieces:
    """Words of a block of texts: their spans, hashes, languages, and whether each is followed by one of its own piece.

    langs: a number for each text; keys: a hash for each number.
    """

    def __init__(self, raw: np.ndarray, offs: np.ndarray, langs: np.ndarray, keys: np.ndarray, seed: int):
        self.raw = _LOWER[raw]
        breaks = _BREAK[raw]
        inside = ~(breaks | _BLANK[raw])
        heads = offs[:-1][np.diff(offs) > 0]
        new = np.zeros(len(raw), bool)
        new[heads] = True
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1] | new[1:]
        last[:-1] &= ~inside[1:] | new[1:]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        piece = np.cumsum(breaks | new, dtype=np.int32)[self.starts] if len(raw) else np.zeros(0, np.int32)
        self.joined = np.zeros(len(self.starts), bool)
        if len(self.starts):
            self.joined[:-1] = piece[1:] == piece[:-1]
        self.lang = np.repeat(langs, np.diff(np.searchsorted(self.starts, offs)))
        self.plain = B.span_hashes(self.raw, self.starts, self.ends)
        # 0 stands for no word
        self.hash = np.maximum(B.mix(self.plain ^ B.mix(keys + np.uint64(seed))[self.lang]), np.uint64(1))

    def checks(self) -> np.ndarray:
        return self.plain ^ B.mix(second_hashes(self.raw, self.starts, self.ends))


def second_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each span that shares nothing with the first one: sums of scrambled (byte, place)."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    sizes = ends - starts
    longest = int(sizes.max())
    if longest > 256:
        # a round for each byte of the longest: long ones go alone
        out = np.empty(len(starts), np.uint64)
        long = sizes > 256
        out[~long] = second_hashes(raw, starts[~long], ends[~long])
        for i in np.flatnonzero(long):
            part = raw[starts[i] : ends[i]].astype(np.uint64)
            out[i] = B.mix(part + np.arange(len(part), dtype=np.uint64) * np.uint64(257)).sum(dtype=np.uint64)
        return out
    out = np.zeros(len(starts), np.uint64)
    live = np.arange(len(starts))
    table_ = B.mix(np.arange(257 * (longest + 1), dtype=np.uint64))
    for j in range(longest):
        live = live[sizes[live] > j]
        out[live] += table_[raw[starts[live] + j].astype(np.int64) + 257 * j]
    return out


def _blocks(batches: Iterator[pa.RecordBatch], names: dict[str, int], seed: int) -> Iterator[Pieces]:
    """Blocks of texts; ``names`` gets a number for each language."""
    for batch in batches:
        for b in B.blocks(batch):
            raw, offs = B.text_bytes(b.column("text"))
            langs = np.array([names.setdefault(x, len(names)) for x in b.column("lang").to_pylist()], np.int32)
            keys = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8, key=bytes([seed])).digest(), "little") for x in names], np.uint64)
            yield Pieces(raw, offs, langs, keys, seed)


def _joined(columns: list[np.ndarray], weight: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Equal rows as one with their weights added. Rows are ordered by a hash; where hashes collide, some equal rows stay apart."""
    if not len(weight):
        return columns, weight
    key = np.zeros(len(weight), np.uint64)
    for c in columns:
        key = B.mix(key * _ODD + c.astype(np.uint64))
    order = np.argsort(key)
    columns, weight = [c[order] for c in columns], weight[order]
    head = np.ones(len(weight), bool)
    head[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    at = np.flatnonzero(head)
    return [c[at] for c in columns], np.add.reduceat(weight, at)


class _Gathered:
    """Rows with weights from many blocks; equal ones are joined block by block, and again when many have gathered."""

    def __init__(self, most: int):
        self.parts, self.rows, self.most = [], 0, most

    def add(self, columns: list[np.ndarray], weight: np.ndarray) -> bool:
        """Whether it is full, and should be taken."""
        self.parts.append(_joined(columns, weight))
        self.rows += len(self.parts[-1][1])
        return self.rows > self.most

    def take(self) -> tuple[list[np.ndarray], np.ndarray]:
        parts, self.parts, self.rows = self.parts, [], 0
        return _joined([np.concatenate(c) for c in zip(*[p[0] for p in parts])], np.concatenate([p[1] for p in parts])) if parts else ([], np.zeros(0, np.int64))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _langs(at: np.ndarray, names: dict[str, int]) -> pa.Array:
    return pa.DictionaryArray.from_arrays(pa.array(at, pa.int32()), pa.array(list(names), pa.string())).cast(pa.string())


def _words(seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """lang, h, check, n of words."""
        names: dict[str, int] = {}
        gathered = _Gathered(FLUSH)

        def rows() -> Iterator[pa.RecordBatch]:
            columns, n = gathered.take()
            for a in range(0, len(n), 100_000):
                lang, h, check = (c[a : a + 100_000] for c in columns)
                yield pa.RecordBatch.from_arrays([_langs(lang, names), _signed(h), _signed(check), pa.array(n[a : a + 100_000])], ["lang", "h", "check", "n"])

        for p in _blocks(batches, names, seed):
            if gathered.add([p.lang, p.hash, p.checks()], np.ones(len(p.hash), np.int64)):
                yield from rows()
        yield from rows()

    return run


def _bits(power: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The bits of a filter that each key sets."""
        for b in batches:
            key = b.column("key").to_numpy(zero_copy_only=False).view(np.uint64)
            at = np.concatenate([B.mix(key + np.uint64(j)) & np.uint64((1 << power) - 1) for j in range(PROBES)])
            yield pa.RecordBatch.from_arrays([_signed(np.unique(at))], ["bit"])

    return run


class Filter:
    """A bit filter of keys: at least 16 bits for each, at most 2^FILTER_BITS in all."""

    def __init__(self, keys: DataFrame):
        self.power = min(FILTER_BITS, max(10, (16 * max(1, keys.count())).bit_length()))
        bits = keys.mapInArrow(_bits(self.power), "bit long")
        # at most 2^FILTER_BITS / 8 rows
        set_ = bits.groupBy(F.shiftright("bit", 3).alias("at")).agg(F.bit_or(F.expr("shiftleft(1, cast(bit & 7 as int))")).alias("x")).toArrow()
        self.bits = np.zeros(1 << (self.power - 3), np.uint8)
        self.bits[set_.column("at").to_numpy()] = set_.column("x").to_numpy().astype(np.uint8)

    def passes(self, key: np.ndarray) -> np.ndarray:
        found = np.arange(len(key))
        for j in range(PROBES):
            at = B.mix(key[found] + np.uint64(j)) & np.uint64((1 << self.power) - 1)
            found = found[(self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1]
        out = np.zeros(len(key), bool)
        out[found] = True
        return out


def _pair_key(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return B.mix(x * _ODD + y)


def _pair_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([_signed(_pair_key(*(b.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in ("h1", "h2"))))], ["key"])


def _pairs(seed: int, words: Filter):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """h1, h2, n of pairs whose words pass."""
        gathered = _Gathered(FLUSH)

        def rows() -> Iterator[pa.RecordBatch]:
            columns, n = gathered.take()
            for a in range(0, len(n), 100_000):
                yield pa.RecordBatch.from_arrays([*(_signed(c[a : a + 100_000]) for c in columns), pa.array(n[a : a + 100_000])], ["h1", "h2", "n"])

        for p in _blocks(batches, {}, seed):
            good = words.passes(p.hash)
            i = np.flatnonzero(p.joined[:-1] & good[:-1] & good[1:])
            if gathered.add([p.hash[i], p.hash[i + 1]], np.ones(len(i), np.int64)):
                yield from rows()
        yield from rows()

    return run


_W = [f"w{i}" for i in range(1, LONGEST + 1)]


def _suffixes(seed: int, pairs: Filter):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """w1 to w5, n, word: suffixes of three words or more (0 where they end early); for words of pairs, w1 and word alone."""
        gathered, told = _Gathered(FLUSH // 2), np.zeros(0, np.uint64)

        def rows() -> Iterator[pa.RecordBatch]:
            w, n = gathered.take()
            for a in range(0, len(n), 100_000):
                yield pa.RecordBatch.from_arrays([*(_signed(c[a : a + 100_000]) for c in w), pa.array(n[a : a + 100_000]), pa.nulls(len(n[a : a + 100_000]), pa.binary())], [*_W, "n", "word"])

        for p in _blocks(batches, {}, seed):
            i = np.flatnonzero(p.joined)
            good = np.zeros(len(p.hash) + LONGEST, bool)
            good[i] = pairs.passes(_pair_key(p.hash[i], p.hash[i + 1])) if len(i) else False
            # letters of the words of these pairs, once a task
            used = np.flatnonzero(good[: len(p.hash)])
            used = np.union1d(used, used + 1)
            tag, one = np.unique(p.hash[used], return_index=True)
            fresh = used[one[~np.isin(tag, told)]]
            told = np.union1d(told, tag)
            if len(fresh):
                sizes = p.ends[fresh] - p.starts[fresh]
                text = B.binary_column(p.raw[B.ragged(p.starts[fresh], sizes)], np.concatenate([[0], np.cumsum(sizes)]))
                none = pa.array(np.zeros(len(fresh), np.int64))
                yield pa.RecordBatch.from_arrays([_signed(p.hash[fresh]), *[none] * LONGEST, text], [*_W, "n", "word"])
            at = np.flatnonzero(good[:-1] & good[1:])
            live, hashes = np.ones(len(at), bool), np.concatenate([p.hash, np.zeros(LONGEST, np.uint64)])
            w = []
            for d in range(LONGEST):
                if d:
                    live = live & good[at + d - 1]
                w.append(np.where(live, hashes[at + d], np.uint64(0)))
            if gathered.add(w, np.ones(len(at), np.int64)):
                yield from rows()
        yield from rows()

    return run


def frequent_prefixes(keys: list[np.ndarray], weight: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(a row, length, weight) of each prefix of the rows whose weight is at least ``least``; a key of 0 ends a row.

    Multikey three-way quicksort of pointers to rows; parts lighter than ``least`` are abandoned.
    """
    out, todo = [], [(np.arange(len(weight)), 0)] if len(weight) else []
    while todo:
        at, d = todo.pop()
        key = keys[d][at]
        pivot = np.sort(key[np.linspace(0, len(key) - 1, 9).astype(np.int64)])[4]
        less, more = key < pivot, key > pivot
        for side in (less, more):
            part = at[side]
            if len(part) and weight[part].sum() >= least:
                todo.append((part, d))
        part = at[~(less | more)]
        total = int(weight[part].sum())
        if pivot and total >= least:
            out.append((int(part[0]), d + 1, total))
            if d + 1 < len(keys):
                todo.append((part, d + 1))
    return out


def _sort(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """p, a of the frequent phrases of three words or more among the suffixes of a task."""
        parts = [[b.column(c).to_numpy(zero_copy_only=False) for c in [*_W, "n"]] for b in batches if b.num_rows]
        if not parts:
            return
        *keys, weight = (np.concatenate(c) for c in zip(*parts))
        found = [x for x in frequent_prefixes([k.view(np.uint64) for k in keys], weight, least) if x[1] >= 3]
        if found:
            row, size, total = (np.array(x, np.int64) for x in zip(*found))
            flat = np.stack([k[row] for k in keys], 1)
            offs = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
            phrase = pa.ListArray.from_arrays(pa.array(offs), pa.array(flat[np.arange(LONGEST)[None] < size[:, None]]))
            yield pa.RecordBatch.from_arrays([phrase, pa.array(total)], ["p", "a"])

    return run


def _long_phrases(suffixes: DataFrame, least: int) -> DataFrame:
    """p, a of the frequent phrases of three words or more, from weighted suffixes."""
    parts = max(int(suffixes.sparkSession.conf.get("spark.sql.shuffle.partitions")), suffixes.count() // (2 * GROUP_ROWS))
    sort = lambda df, *by: df.select(*_W, "n").repartition(parts, *by).mapInArrow(_sort(least), "p array<long>, a long")
    pair, triple = _W[:2], _W[:3]
    crowded = suffixes.groupBy(*pair).agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > GROUP_ROWS).select(*pair)
    if crowded.isEmpty():
        return sort(suffixes, *pair)
    some = suffixes.join(crowded, pair, "left_anti")
    rest = suffixes.join(crowded, pair, "left_semi")
    full = rest.groupBy(*triple).agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > GROUP_ROWS).select(*triple)
    prefixes = F.array(*[F.when(F.col(_W[i - 1]) != 0, F.array(*_W[:i])) for i in range(3, LONGEST + 1)])
    each = rest.join(full, triple, "left_semi").select(F.explode(prefixes).alias("p"), "n")
    summed = each.where("p is not null").groupBy("p").agg(F.sum("n").alias("a")).where(F.col("a") >= least)
    return sort(some, *pair).unionByName(sort(rest.join(full, triple, "left_anti"), *triple)).unionByName(summed)


def counted(docs: DataFrame, scratch: Scratch, least: int = LEAST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Frequent phrases of one to five words (lang, p as hashes, a), totals (lang, n), letters of words (h, word)."""
    text = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    for seed in range(16):
        seen = text.mapInArrow(_words(seed), "lang string, h long, check long, n long").groupBy("lang", "h")
        seen = scratch.keep(seen.agg(F.sum("n").alias("a"), F.min("check").alias("c0"), F.max("check").alias("c1")), "words")
        if seen.where("c0 <> c1").isEmpty() and seen.groupBy("h").agg(F.count(F.lit(1)).alias("langs")).where("langs > 1").isEmpty():
            break
        scratch.drop(seen)
    else:
        raise RuntimeError("hashes of words clash under every seed")
    totals, frequent = seen.groupBy("lang").agg(F.sum("a").alias("n")), seen.where(F.col("a") >= least)
    met = text.mapInArrow(_pairs(seed, Filter(frequent.select(F.col("h").alias("key")))), "h1 long, h2 long, n long")
    pairs = scratch.keep(met.repartition("h1", "h2").groupBy("h1", "h2").agg(F.sum("n").alias("a")).where(F.col("a") >= least), "pairs")
    found = text.mapInArrow(_suffixes(seed, Filter(pairs.select("h1", "h2").mapInArrow(_pair_keys, "key long"))), f"{', '.join(f'{w} long' for w in _W)}, n long, word binary")
    found = scratch.keep(found, "suffixes")
    letters = found.where("word is not null").select(F.col("w1").alias("h"), F.col("word").cast("string").alias("word")).distinct()
    ones, twos = frequent.select(F.array("h").alias("p"), "a"), pairs.select(F.array("h1", "h2").alias("p"), "a")
    phrases = ones.unionByName(twos).unionByName(_long_phrases(found.where("word is null"), least)).withColumn("h", F.col("p")[0])
    return scratch.keep(phrases.join(frequent.select("h", "lang"), "h").select("lang", "p", "a"), "phrases"), totals, letters


def scored(phrases: DataFrame, totals: DataFrame) -> DataFrame:
    """lang, p, a, l, r, n, score of each phrase of two words or more that no longer one explains, at its lowest-scoring cut."""
    many = phrases.where(F.size("p") > 1)
    longer = many.where(F.size("p") > 2)
    inside = longer.select("lang", F.explode(F.array(F.expr("slice(p, 1, size(p) - 1)"), F.expr("slice(p, 2, size(p) - 1)"))).alias("p"), "a")
    # a longer phrase is never more frequent, so one word more settles it for any number of them
    cuts = many.join(inside.distinct(), ["lang", "p", "a"], "left_anti").withColumn("k", F.explode(F.sequence(F.lit(1), F.size("p") - 1)))
    cuts = cuts.withColumns({"x": F.expr("slice(p, 1, k)"), "y": F.expr("slice(p, k + 1, size(p) - k)")})
    part = lambda c, n: phrases.select("lang", F.col("p").alias(c), F.col("a").alias(n))
    both = cuts.join(part("x", "l"), ["lang", "x"]).join(part("y", "r"), ["lang", "y"]).join(totals, "lang")
    wide = lambda c: f"cast({c} as decimal(19, 0))"
    both = both.withColumn("score", F.expr(f"(1000 * {wide('a')} * {wide('n')}) div ({wide('l')} * {wide('r')})").cast("long"))
    least = F.min(F.struct("score", "k", "l", "r")).alias("m")
    return both.groupBy("lang", "p", "a", "n").agg(least).select("lang", "p", "a", "m.l", "m.r", "n", "m.score")


def collocations(docs: DataFrame, least: int = LEAST, best: int = BEST) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``best`` collocations of each language of ``docs`` (text, lang)."""
    scratch = Scratch(docs.sparkSession, "collocations")
    phrases, totals, words = counted(docs, scratch, least)
    spelled = scratch.keep(scored(phrases, totals), "scored")
    word = spelled.select("lang", "p", F.posexplode("p").alias("i", "h")).join(words, "h")
    texts = word.groupBy("lang", "p").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = spelled.join(texts, ["lang", "p"]).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    out = scratch.keep(ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"), "collocations")
    scratch.clear(out)
    return out


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents").select("text", "lang"))


SQL = f"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS ws FROM pieces),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k::BIGINT + 2), lambda i: array_to_string(ws[i : i + k - 1], ' '))) AS phrase FROM w, range(1, {LONGEST + 1}) s(k) WHERE len(ws) >= k),
f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= {LEAST}), t AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY 1),
c AS (SELECT x.*, string_split(phrase, ' ') AS p FROM f x WHERE k >= 2),
d AS (SELECT * FROM c x WHERE NOT EXISTS (SELECT 1 FROM c y WHERE y.lang = x.lang AND y.k > x.k AND 100 * y.a >= 100 * x.a AND contains(' ' || y.phrase || ' ', ' ' || x.phrase || ' '))),
cut AS (SELECT d.lang, d.phrase, d.a, l.a AS l, r.a AS r, n, j, ((1000::HUGEINT * d.a * n) // (l.a::HUGEINT * r.a))::BIGINT AS score
  FROM d CROSS JOIN range(1, {LONGEST}) s(j) JOIN f l ON l.lang = d.lang AND l.phrase = array_to_string(p[1 : j], ' ') JOIN f r ON r.lang = d.lang AND r.phrase = array_to_string(p[j + 1 :], ' ') JOIN t ON t.lang = d.lang WHERE j < d.k),
low AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM low QUALIFY rank <= {BEST}"""
