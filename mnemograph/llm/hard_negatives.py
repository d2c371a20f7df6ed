"""Hard-negative mining (operator 11) by angular triangle filtering.

A score is the integer inner product of two quantised vectors. Each row stores its norm and its angles to a few reference
directions. If t and u are the angles of two rows to one direction, theirs lies between |t - u| and t + u, so its cosine
between cos(t + u) and cos(t - u); times both norms, and with slack for rounding, these bound the score.

* References are centroids of a bounded sample (``SAMPLE`` rows, the least by hash). They change no result.
* Rows are stored in the order of their nearest reference, so that a run of ``RUN`` rows covers a narrow range of angles.
  A run is skipped for an anchor if the bounds of its range stay outside the anchor's window; of the others, single rows
  are tested by the references nearest to the run and to the anchor; only pairs left are scored, in doubles that hold
  every integer that can come up.
* An anchor's window is open above for positives, from the least of the best found so far. For negatives it reaches from
  the least to the largest bound of its positives, and again from the least of the best found so far, once all are full.
* Anchors go in blocks of ``ANCHORS``, which travel with the code; answers of a block are written before the next. A task
  keeps the best of each anchor while it streams its rows, so neither its memory nor what it sends grows with the rows.

Rows with a null id, label or vector, or a component that is null or not finite, take no part. Of rows that repeat an id,
the first by label and vector does. Vectors are compared with those of their own length only. Components count up to
2^40 in absolute value after quantising, larger ones (which fit no 64-bit score) as not finite. Zero vectors score 0.
An empty table gives no row. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Scratch, table

POSITIVES, NEGATIVES = 5, 10
#: Per cent of the positive's score between which a negative's lies.
LOW, HIGH = 30, 90
EVERY, SCALE = 100, 256
REFERENCES, SAMPLE, ANCHORS, RUN, BATCH = 24, 4096, 16_384, 256, 4096
_NONE = np.iinfo(np.int64).min


def quantised(vectors: DataFrame, vec_id: str = "vec_id", label: str = "label", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """vec_id, label, q: the rows that take part, components as floor(scale * x)."""
    v = F.col(vector).cast("array<double>")
    whole = F.transform(v, lambda x: F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) * scale < float(1 << 40)), F.floor(x * scale)))
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), whole.alias("q"))
    good = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("q").isNotNull() & ~F.exists("q", lambda x: x.isNull()))
    return good.groupBy("vec_id").agg(F.min(F.struct("label", "q")).alias("r")).select("vec_id", "r.label", "r.q")


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    flat = column.flatten() if not isinstance(column, pa.ChunkedArray) else column.combine_chunks().flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def references(rows: DataFrame, dims: int, n: int = REFERENCES, sample: int = SAMPLE) -> np.ndarray:
    """Unit directions: centroids after a few rounds of spherical k-means over the ``sample`` rows of least hash."""
    some = _matrix(rows.select("vec_id", "q").orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toArrow().column("q"), dims)
    size = np.linalg.norm(some, axis=1)
    some = some[size > 0] / size[size > 0, None]
    if not len(some):
        return np.eye(1, dims)
    at = some[: min(n, len(some))]
    for _ in range(8):
        near = (some @ at.T).argmax(1)
        sums = np.zeros_like(at)
        np.add.at(sums, near, some)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        at = np.where(size > 1e-9, sums / np.maximum(size, 1e-9), at)
    return at


def _placed(refs: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Adds norm, angles (to each reference) and cell (the nearest)."""
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column("q"), refs.shape[1])
            norm = np.linalg.norm(x, axis=1)
            angle = np.arccos(np.clip(x @ refs.T / np.maximum(norm, 1e-300)[:, None], -1, 1))
            offs = pa.array(np.arange(0, angle.size + 1, angle.shape[1], dtype=np.int32))
            angles = pa.ListArray.from_arrays(offs, pa.array(angle.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), b.column("q"), pa.array(norm), angles, pa.array(angle.argmin(1).astype(np.int32))], ["vec_id", "label", "q", "norm", "angles", "cell"])

    return run


class _Rows:
    """Rows of an Arrow batch."""

    def __init__(self, b: pa.RecordBatch | pa.Table, dims: int, refs: int):
        num = lambda c: np.asarray(b.column(c).to_numpy(zero_copy_only=False) if isinstance(b, pa.RecordBatch) else b.column(c).to_numpy())
        self.ids, self.labels, self.norm = num("vec_id").astype(np.int64), num("label").astype(np.int64), num("norm").astype(np.float64)
        self.x, self.angles = _matrix(b.column("q"), dims), _matrix(b.column("angles"), refs)
        self.most = float(np.abs(self.x).max(initial=0))


def exact_scores(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products of rows of a and of x, whole numbers held in doubles."""
    if float(np.abs(a).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, a.shape[1]) < 2.0**53:
        return (a @ x.T).astype(np.int64)
    out = a.astype(np.int64).astype(object) @ x.astype(np.int64).astype(object).T
    if max((abs(v) for v in out.ravel()), default=0) >= 1 << 63:
        raise ValueError("a score does not fit 64 bits")
    return out.astype(np.int64)


def row_bounds(a_angle: np.ndarray, x_angle: np.ndarray, a_norm: np.ndarray, x_norm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lowest and highest score of pairs of rows by their angles to one reference, rounded outwards."""
    size = a_norm * x_norm
    slack = 1e-6 * size + 1e-3
    middle, reach = size * (np.cos(a_angle) * np.cos(x_angle)), size * (np.sin(a_angle) * np.sin(x_angle))
    return np.floor(middle - reach - slack), np.ceil(middle + reach + slack)


def run_bounds(anchors: _Rows, rows: _Rows, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """Lowest and highest score of each anchor with any of the rows from lo to hi, by all references."""
    t, u0, u1 = anchors.angles, rows.angles[lo:hi].min(0), rows.angles[lo:hi].max(0)
    least = np.maximum(np.maximum(t - u1, u0 - t), 0).max(1)
    most = np.minimum(np.minimum(t + u1, 2 * np.pi - t - u0), np.pi).min(1)
    sizes = anchors.norm[:, None] * np.array([rows.norm[lo:hi].min(), rows.norm[lo:hi].max()])
    low, high = np.cos(most)[:, None] * sizes, np.cos(least)[:, None] * sizes
    slack = 1e-6 * sizes[:, 1] + 1e-3
    return np.floor(low.min(1) - slack), np.ceil(high.max(1) + slack)


class Best:
    """The ``k`` best (score, then least id) of each of n slots, fed with batches of (slot, score, id)."""

    def __init__(self, n: int, k: int):
        self.k, self.score, self.id = k, np.full((n, k), _NONE), np.full((n, k), np.iinfo(np.int64).max)

    def floor(self) -> np.ndarray:
        """The least score that each slot still takes (equal ones may, by their ids)."""
        return self.score[:, -1]

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        keep = score >= self.floor()[slot]
        slot, score, ids = slot[keep], score[keep], ids[keep]
        if not len(slot):
            return
        hit = np.unique(slot)
        slot = np.concatenate([slot, np.repeat(hit, self.k)])
        score, ids = np.concatenate([score, self.score[hit].ravel()]), np.concatenate([ids, self.id[hit].ravel()])
        order = np.lexsort((ids, -score.clip(_NONE + 1), slot))
        slot, score, ids = slot[order], score[order], ids[order]
        place = np.arange(len(slot)) - np.searchsorted(slot, slot)
        good = place < self.k
        self.score[slot[good], place[good]], self.id[slot[good], place[good]] = score[good], ids[good]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        slot, place = np.nonzero(self.score != _NONE)
        return slot, self.score[slot, place], self.id[slot, place]


def _nearest(refs: int, anchors: _Rows) -> np.ndarray:
    return anchors.angles.argmin(1) if refs else np.zeros(len(anchors.ids), np.int64)


def _search(anchors: _Rows, windows: tuple[np.ndarray, np.ndarray, np.ndarray] | None, positives: int, negatives: int, stats: bool = False):
    """Streams rows past all anchors; yields (anchor, slot, score, id) of the best.

    windows: None for positives; else the anchor of each slot and its lowest and highest score, slots of an anchor together.
    stats: instead, one row with the numbers of pairs met (slot), tested row by row (score) and scored (id).
    """
    dims, refs, n = anchors.x.shape[1], anchors.angles.shape[1], len(anchors.ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _nearest(refs, anchors)
        if windows is None:
            best, low, high = Best(n, positives), np.full(n, -np.inf), np.full(n, np.inf)
        else:
            owner, slot_low, slot_high = windows
            best, low, high = Best(len(owner), negatives), np.full(n, np.inf), np.full(n, -np.inf)
            np.minimum.at(low, owner, slot_low)
            np.maximum.at(high, owner, slot_high)
            first = np.searchsorted(owner, np.arange(n + 1))
        met = tested = scored_ = 0
        for b in batches:
            rows = _Rows(b, dims, refs)
            for lo in range(0, len(rows.ids), RUN):
                hi = min(lo + RUN, len(rows.ids))
                floor = best.floor().astype(np.float64)
                if windows is not None:
                    floor_ = np.full(n, np.inf)
                    np.minimum.at(floor_, owner, np.maximum(floor, slot_low))
                    floor = floor_
                floor = np.maximum(floor, low)
                met += n * (hi - lo)
                least, most = run_bounds(anchors, rows, lo, hi)
                live = np.flatnonzero((most >= floor) & (least <= high))
                if not len(live):
                    continue
                tested += len(live) * (hi - lo)
                keep = (rows.labels[lo:hi][None] == anchors.labels[live][:, None]) == (windows is None)
                if windows is None:
                    keep &= rows.ids[lo:hi][None] != anchors.ids[live][:, None]
                cell = int(np.bincount(rows.angles[lo:hi].argmin(1)).argmax())
                for r in (np.full(len(live), cell), own[live]):
                    a, b_ = row_bounds(anchors.angles[live, r][:, None], rows.angles[lo:hi][:, r].T, anchors.norm[live][:, None], rows.norm[lo:hi][None])
                    keep &= (b_ >= floor[live][:, None]) & (a <= high[live][:, None])
                some = np.flatnonzero(keep.any(1))
                if not len(some):
                    continue
                at, j = np.nonzero(keep[some])
                scored_ += len(at)
                # one product for the anchors that have any pair left
                score = exact_scores(anchors.x[live[some]], rows.x[lo:hi])[at, j]
                who, ids = live[some][at], rows.ids[lo:hi][j]
                if windows is None:
                    best.add(who, score, ids)
                    continue
                each = first[who + 1] - first[who]
                pair = np.repeat(np.arange(len(who)), each)
                slot = np.repeat(first[who], each) + np.arange(len(pair)) - np.repeat(np.cumsum(each) - each, each)
                inside = (score[pair] >= slot_low[slot]) & (score[pair] <= slot_high[slot])
                best.add(slot[inside], score[pair][inside], ids[pair][inside])
        slot, score, ids = best.rows()
        who = anchors.ids[slot if windows is None else owner[slot]] if len(slot) else np.zeros(0, np.int64)
        if stats:
            slot, score, ids, who = (np.array([x], np.int64) for x in (met, tested, scored_, 0))
        for a in range(0, len(slot), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(c[a : a + 100_000].astype(np.int64)) for c in (who, slot, score, ids)], ["anchor_id", "slot", "score", "id"])

    return run


_FOUND = "anchor_id long, slot long, score long, id long"


def _rank(found: DataFrame, k: int) -> DataFrame:
    """The k best of each slot over all tasks, in order, as an array ``best`` of (score turned, id)."""
    part = found.groupBy("anchor_id", "slot").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "id"))).alias("best"))
    return part.select("anchor_id", "slot", F.slice("best", 1, k).alias("best"))


def windows_of(score: np.ndarray, low: int = LOW, high: int = HIGH) -> tuple[np.ndarray, np.ndarray]:
    """The least and largest whole scores between low and high per cent of a positive's; empty (least above largest) where it is negative."""
    least = [-((-low * int(s)) // 100) for s in score]
    most = [(high * int(s)) // 100 for s in score]
    return np.array(least, np.float64), np.array(most, np.float64)


def mine(vectors: DataFrame, anchor: Column | None = None, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for rows of ``vectors`` (vec_id, label, embedding).

    anchor: which rows ask, every hundredth id unless given. For each anchor and each of its first ``positives`` rows of its
    own label, the first ``negatives`` rows of another label whose score is between ``low`` and ``high`` per cent of the
    positive's; order is by score and then the smaller id.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "negatives")
    anchor = F.col("vec_id") % EVERY == 0 if anchor is None else anchor
    rows = scratch.keep(quantised(vectors, scale=scale), "rows")
    out = []
    for (dims,) in rows.groupBy(F.size("q").alias("d")).agg(F.lit(1)).select("d").collect():
        if dims < 1:
            continue
        same = rows.where(F.size("q") == dims)
        refs = references(same, dims)
        shape = "vec_id long, label long, q array<long>, norm double, angles array<double>, cell int"
        placed = same.mapInArrow(_placed(refs), shape)
        placed = scratch.keep(placed.repartitionByRange("cell", F.xxhash64("vec_id")).sortWithinPartitions("cell", F.element_at("angles", F.col("cell") + 1)), "placed")
        asking = placed.where(anchor)
        blocks = max(1, -(-asking.count() // ANCHORS))
        for i in range(blocks):
            out += _block(placed, asking.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == i), dims, len(refs), scratch, positives, negatives, low, high)
    shape = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    result = scratch.keep(reduce(DataFrame.unionByName, out), "mined") if out else spark.createDataFrame([], shape)
    scratch.clear(*([result] if out else []))
    return result


def _block(placed: DataFrame, asking: DataFrame, dims: int, refs: int, scratch: Scratch, positives: int, negatives: int, low: int, high: int) -> list[DataFrame]:
    a = _Rows(asking.orderBy("vec_id").toArrow(), dims, refs)
    if not len(a.ids):
        return []
    near = _rank(placed.mapInArrow(_search(a, None, positives, negatives), _FOUND), positives)
    near = scratch.keep(near.select("anchor_id", F.posexplode("best").alias("i", "b")).select("anchor_id", "i", F.col("b.id").alias("positive_id"), (-F.col("b.s")).alias("positive_score")), "positives")
    found = near.orderBy("anchor_id", "i").toArrow()  # at most ``positives`` for each anchor of the block
    ids, score = (found.column(c).to_numpy() for c in ("anchor_id", "positive_score"))
    owner = np.searchsorted(a.ids, ids)
    least, most = windows_of(score, low, high)
    if not len(owner):
        return []
    slots = placed.mapInArrow(_search(a, (owner, least, most), positives, negatives), _FOUND)
    best = _rank(slots, negatives).select("slot", F.posexplode("best").alias("j", "b"))
    # a slot is the place of an anchor's positive in the order above
    names = asking.sparkSession.createDataFrame(pa.table({"slot": np.arange(len(ids)), "anchor_id": ids, "positive_id": found.column("positive_id"), "positive_score": score}))
    out = best.join(F.broadcast(names), "slot")
    return [scratch.keep(out.select("anchor_id", "positive_id", (F.col("j") + 1).cast("int").alias("rank"), F.col("b.id").alias("negative_id"), "positive_score", (-F.col("b.s")).alias("negative_score")), "block")]


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of every seventh row are turned first, as the contract says."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    return mine(e.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))))


SQL = f"""
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS q FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % {EVERY} = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= {POSITIVES})
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id))::INT AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND {LOW} * positive_score <= 100 * score AND 100 * score <= {HIGH} * positive_score QUALIFY rank <= {NEGATIVES}"""
