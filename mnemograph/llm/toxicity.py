"""Toxicity (operator 7): gradient-boosted trees over dense features, with isotonic calibration.

Features of a whole text: densities of the words of lexicons (insults, profanity, threats, hostility, and one that the
labels teach), of these words next to a second-person word, capitals, punctuation, obfuscation (words of a lexicon once
digits and signs are read as letters or repeats are cut), and lengths. Language, source, doc_id and labels are no features.

The taught lexicon is for words that no written list has, such as those of other languages: word beginnings of 4 to 8
bytes (stems) that stand in toxic texts far more often than in others, at most ``STEMS`` of them.

``fit`` learns from labelled rows whose crc32(doc_id as text) mod 5 is not 0, at most ``FIT_ROWS`` of them (those with
the smallest hash of doc_id). Lexicon and trees learn from remainders 1 to 3; a row of the trees is seen through a lexicon
that the rows of the two other remainders teach. The isotonic map from margins to probabilities learns from remainder 4,
seen as new texts are: through the lexicon of remainders 1 to 3, which scores use. If one of the two classes is missing
among the rows of trees or map, every score is the mean label. Of rows that share a doc_id, the text with the smallest
hash is learned from, so that reruns agree.

Null texts are empty; they are scored too. Repeated rows are kept. Rows with a null doc_id count as held out (they
have no remainder). An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Scratch, table
from .textblocks import Words, blocks, span_hashes, text_bytes

#: Most labelled rows that the model learns from.
FIT_ROWS = 60_000
NEAR = 5
#: Most learned stems, their lengths in bytes, and how many times likelier in toxic texts a stem has to be.
STEMS, STEM_SIZES, STEM_ODDS = 400, (4, 5, 6, 7, 8), 5.0

# The lexicon.
INSULTS = "idiot idiots moron morons stupid dumb fool fools loser losers clown clowns scum trash garbage worthless pathetic disgusting imbecile jerk creep pig rat vermin filth ugly useless ignorant coward liar freak lunatic dimwit halfwit dunce cretin brainless spineless"
PROFANITY = "damn damned hell crap shit shitty fuck fucking bitch bastard ass asshole piss bloody bullshit dick slut whore"
THREATS = "kill die hurt destroy murder beat burn shoot stab smash punish choke strangle"
HOSTILITY = "hate hates hated despise loathe sick awful horrible nasty vile wretched shame ashamed shut"
SECOND = "you your yours yourself yourselves u ur youre du dich dir dein deine tu te toi ton vous votre tú usted vosotros"
LEXICONS = (INSULTS, PROFANITY, THREATS, HOSTILITY)
#: Signs and digits that stand for letters.
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": "", ".": "", "-": "", "_": ""}
FEATURES = ("stems", "stem_hits", "insult", "profanity", "threat", "hostile", "hits", "near_you", "second", "obfuscated", "capitals", "shouted", "exclaim", "question", "symbols", "repeats", "log_words", "mean_length")

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_READ = _FOLD.copy()
for _k, _v in LEET.items():
    _READ[ord(_k)] = ord(_v) if _v else 0
_ALPHA = np.zeros(256, bool)
_ALPHA[97:123] = True
_ALPHA[128:] = True


def _hash_words(words: str) -> np.ndarray:
    parts = [w.encode() for w in words.split()]
    raw = np.frombuffer(b"".join(parts), np.uint8)
    ends = np.cumsum([len(p) for p in parts])
    return np.unique(span_hashes(raw, np.concatenate([[0], ends[:-1]]), ends))


def _among(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    return known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h


def _by_text(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags)])[offs])


def _bare(raw: np.ndarray, offs: np.ndarray) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words, folded bytes, which of these are letters, and where each word begins and ends without punctuation."""
    words = Words(raw, offs)
    low = _FOLD[raw]
    alpha = _ALPHA[low]
    # bounds without punctuation at either end
    position = np.arange(len(raw) + 1)
    before = np.concatenate([[-1], np.maximum.accumulate(np.where(alpha, position[:-1], -1))]) if len(raw) else np.array([-1])
    after = np.append(np.minimum.accumulate(np.where(alpha, position[:-1], len(raw))[::-1])[::-1], len(raw))
    a = np.minimum(after[words.starts], words.ends)
    b = np.maximum(before[words.ends] + 1, a)
    return words, low, alpha, a, b


def _stem_hashes(low: np.ndarray, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each stem size, the words that are as long, and the hashes of their stems."""
    for k in STEM_SIZES:
        at = np.flatnonzero(b - a >= k)
        yield at, span_hashes(low, a[at], a[at] + k)


def text_features(raw: np.ndarray, offs: np.ndarray, stems: np.ndarray) -> np.ndarray:
    """(texts, features) of a block; stems: sorted hashes."""
    words, low, alpha, a, b = _bare(raw, offs)
    n = np.maximum(1, words.counts)
    chars = np.maximum(1, np.diff(offs))
    stemmed = np.zeros(len(words.starts), bool)
    if len(stems):
        for at, h in _stem_hashes(low, a, b):
            stemmed[at] |= _among(h, stems)
    h = span_hashes(low, a, b)
    lexicons = [_hash_words(x) for x in LEXICONS]
    hit = [_among(h, x) for x in lexicons]
    every = np.unique(np.concatenate(lexicons))
    plain = np.logical_or.reduce(hit) if len(h) else np.zeros(0, bool)
    second = _among(h, _hash_words(SECOND))
    # words with signs inside or letters repeated, read again as letters
    inner = np.concatenate([[0], np.cumsum(~alpha)])
    odd = (inner[words.ends] - inner[words.starts] > 0) & ~plain
    repeat = np.zeros(len(raw), bool)
    repeat[2:] = alpha[2:] & (low[2:] == low[1:-1]) & (low[1:-1] == low[:-2])
    thrice = np.concatenate([[0], np.cumsum(repeat)])
    odd |= (thrice[words.ends] - thrice[words.starts] > 0) & ~plain
    masked = np.zeros(len(h), bool)
    at = np.flatnonzero(odd)
    if len(at):
        read = _READ[raw]
        keep = np.where(repeat, False, read != 0)
        keep[1:] &= ~(repeat[1:] | (np.append(repeat[2:], False) & (low[1:] == low[:-1])))
        # trailing signs of a word stay what they are: only what stands between its letters is read
        tight = read[keep]
        place = np.concatenate([[0], np.cumsum(keep)])
        for x, y in ((words.starts[at], words.ends[at]), (words.starts[at], b[at]), (a[at], b[at])):
            masked[at] |= _among(span_hashes(tight, place[x], place[y]), every)
    any_hit = plain | masked
    where = np.flatnonzero(any_hit)
    near = np.zeros(len(h), bool)
    if len(where) and second.any():
        said = np.concatenate([[0], np.cumsum(second)])
        text_of = np.repeat(np.arange(len(words.counts)), words.counts)[where]
        lo = np.maximum(where - NEAR, words.per_text[:-1][text_of])
        hi = np.minimum(where + NEAR + 1, words.per_text[1:][text_of])
        near[where] = said[hi] > said[lo]
    upper = (raw >= 65) & (raw <= 90)
    ups = np.concatenate([[0], np.cumsum(upper)])
    shouted = (ups[words.ends] - ups[words.starts] >= 3) & (ups[words.ends] - ups[words.starts] >= b - a)
    rate = lambda flags: 1000.0 * _by_text(flags, words.per_text) / n
    share = lambda flags: 1000.0 * _by_text(flags, offs) / chars
    sign = np.isin(raw, np.frombuffer(b"#*$%&|<>@", np.uint8))
    columns = [rate(stemmed), np.log1p(_by_text(stemmed, words.per_text)), *map(rate, hit), np.log1p(_by_text(any_hit, words.per_text)), rate(near), rate(second), rate(masked), share(upper), rate(shouted), share(raw == 33), share(raw == 63), share(sign), share(repeat), np.log1p(words.counts), _by_text(words.inside & ((raw & 0xC0) != 0x80), offs) / n]
    return np.stack(columns, axis=1).astype(np.float64)


def features(docs: DataFrame, stems: np.ndarray) -> DataFrame:
    """doc_id, f (array of ``FEATURES``) for each row of ``docs`` (doc_id, text)."""
    schema = pa.schema([("doc_id", pa.int64()), ("f", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch):
                x = text_features(*text_bytes(b.column("text")), stems)
                offs = pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.ListArray.from_arrays(offs, pa.array(x.ravel()))], schema=schema)

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return picked.mapInArrow(run, "doc_id long, f array<double>")


def remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def stem_counts(texts: DataFrame) -> DataFrame:
    """stem, x1, y1, ...: for each stem of ``texts`` (text, r, label), the toxic and the other texts of each remainder of 1 to 3 that hold it."""
    schema = pa.schema([("stem", pa.int64()), ("r", pa.int64()), ("bad", pa.int64()), ("good", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch):
                label, part = np.array(b.column("label")), np.array(b.column("r"))
                words, low, _, x, y = _bare(*text_bytes(b.column("text")))
                text_of = np.repeat(np.arange(len(words.counts)), words.counts)
                for at, h in _stem_hashes(low, x, y):
                    order = np.lexsort((text_of[at], h))
                    hs, ts = h[order], text_of[at][order]
                    new = np.ones(len(hs), bool)
                    new[1:] = (hs[1:] != hs[:-1]) | (ts[1:] != ts[:-1])
                    for r in (1, 2, 3):
                        mine = new & (part[ts] == r)
                        stem, of = np.unique(hs[mine], return_inverse=True)
                        bad = np.bincount(of, label[ts[mine]], len(stem)).astype(np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(stem.view(np.int64)), pa.array(np.full(len(stem), r)), pa.array(bad), pa.array(np.bincount(of, minlength=len(stem)) - bad)], schema=schema)

    counts = texts.select("text", F.col("r").cast("long").alias("r"), "label").mapInArrow(run, "stem long, r long, bad long, good long")
    return counts.groupBy("stem").agg(*[F.sum(F.when(F.col("r") == r, F.col(c)).otherwise(0)).alias(f"{n}{r}") for r in (1, 2, 3) for n, c in (("x", "bad"), ("y", "good"))])


def pick_stems(counts: DataFrame, totals: dict[int, tuple[float, float]], parts: tuple[int, ...], most: int = STEMS) -> np.ndarray:
    """Sorted hashes of the stems that tell the toxic texts of some remainders from the others best.

    A stem has to be in a twentieth of the toxic texts and five of them at least, and ``STEM_ODDS`` times likelier there
    by text; the best by its gain in log-likelihood are taken. The driver gets ``most`` rows. totals: toxic and other
    texts of each remainder.
    """
    bad, good = (sum(totals.get(r, (0, 0))[i] for r in parts) for i in (0, 1))
    if not bad or not good:
        return np.zeros(0, np.uint64)
    x, y = (sum((F.col(f"{n}{r}") for r in parts), F.lit(0)) for n in "xy")
    p, q = (F.col("x") + 0.5) / (bad + 1.0), (F.col("y") + 0.5) / (good + 1.0)
    kept = counts.select("stem", x.alias("x"), y.alias("y")).where((F.col("x") >= max(5.0, bad / 20)) & (p >= STEM_ODDS * q))
    best = kept.orderBy((F.col("x") * F.log(p / q)).desc(), "stem").limit(most).select("stem").collect()
    return np.sort(np.array([r["stem"] for r in best], np.int64).view(np.uint64))


class ToxicityModel:
    """Trees, their calibration, and the class to give where there is only one."""

    def __init__(self, stems, trees, calibration, only: float = 0.0):
        self.stems, self.trees, self.calibration, self.only = stems, trees, calibration, only

    def score(self, docs: DataFrame) -> DataFrame:
        """doc_id, score for each row of ``docs`` (doc_id, text)."""
        featured = features(docs, self.stems)
        if self.trees is None:
            return featured.select("doc_id", F.lit(self.only).alias("score"))
        margin = vector_to_array("rawPrediction")[1]
        got = self.trees.transform(featured.withColumn("x", array_to_vector("f"))).withColumn("margin", margin)
        p = self.calibration.transform(got.select("doc_id", "margin"))
        return p.select("doc_id", F.least(F.lit(1.0), F.greatest(F.lit(0.0), "calibrated")).alias("score"))


def fit(docs: DataFrame, labels: DataFrame, scratch: Scratch, most: int = FIT_ROWS) -> ToxicityModel:
    """Learns from the labelled rows of remainders 1 to 4, at most ``most`` of them."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("double").alias("label"))
    known = known.where("doc_id is not null and label in (0, 1)").withColumn("r", remainder(F.col("doc_id"))).where("r <> 0")
    known = known.groupBy("doc_id", "r").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    # at most FIT_ROWS rows of three numbers
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(known), "doc_id")
    texts = texts.groupBy("doc_id", "r", "label").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t")).select("doc_id", "r", "label", "t.text")
    texts = scratch.keep(texts, "texts")
    counts = scratch.keep(stem_counts(texts.where("r < 4")), "stems")
    totals = {r["r"]: (r["bad"], r["n"] - r["bad"]) for r in texts.groupBy("r").agg(F.sum("label").alias("bad"), F.count(F.lit(1)).alias("n")).collect()}
    stems = pick_stems(counts, totals, (1, 2, 3))
    seen = [features(texts.where(F.col("r") == r), pick_stems(counts, totals, tuple({1, 2, 3} - {r}))) for r in (1, 2, 3)]
    rows = reduce(DataFrame.unionByName, [*seen, features(texts.where("r = 4"), stems)]).join(F.broadcast(known), "doc_id")
    rows = scratch.keep(rows.withColumn("x", array_to_vector("f")).select("doc_id", "x", "r", "label").orderBy("doc_id"), "fit")
    classes = {r["label"] for r in rows.where("r < 4").select("label").distinct().collect()}
    held = {r["label"] for r in rows.where("r = 4").select("label").distinct().collect()}
    if len(classes) < 2 or len(held) < 2:
        return ToxicityModel(np.zeros(0, np.uint64), None, None, texts.agg(F.avg("label")).first()[0] or 0.0)
    trees = GBTClassifier(featuresCol="x", labelCol="label", predictionCol="guess", maxIter=12, maxDepth=3, stepSize=0.3, maxBins=32, seed=7).fit(rows.where("r < 4"))
    margins = trees.transform(rows.where("r = 4")).select("label", vector_to_array("rawPrediction")[1].alias("margin"))
    calibration = IsotonicRegression(featuresCol="margin", labelCol="label", predictionCol="calibrated").fit(margins)
    return ToxicityModel(stems, trees, calibration)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scratch = Scratch(spark, "toxic")
    model = fit(docs, table(spark, sf_dir, "labels"), scratch)
    scratch.clear()
    scored = model.score(docs)
    return scored.select("doc_id", F.coalesce(remainder(F.col("doc_id")) == 0, F.lit(True)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
