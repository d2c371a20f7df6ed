"""Substring dedup (operator 8): content-defined chunks with a gear rolling hash.

A text is cut after each byte at which the gear hash of the last ``WINDOW`` bytes has ``CUT_BITS`` leading zeros (and
after ``MOST`` bytes without a cut), so cuts depend on nearby bytes alone: an insertion moves the chunks behind it but
does not change them. Chunks are deduplicated by a 128-bit digest (two 64-bit hashes of their bytes): of equal chunks, the one with the smallest
(doc_id, place) stays. As a chunk may be a few bytes that recur by chance, later copies are removed where a run of
neighbouring ones has at least ``LEAST_RUN`` bytes.

Blocks of texts post each distinct chunk once to the task of its digest's range; flags come back by block. So copies in
any number load no single task: a digest has at most one entry for each block.

Null texts are empty. Repeated rows are texts of their own, one of which keeps its chunks; a null doc_id comes first. An
empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Scratch, table
from .textblocks import blocks, ragged, span_hashes, text_bytes

WINDOW, CUT_BITS, MOST, LEAST_RUN = 16, 5, 512, 128
RANGE_ITEMS = 1_500_000
_GEAR = np.random.default_rng(8).integers(0, 1 << 32, 256, dtype=np.uint32)


def chunk_bounds(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start of each chunk and, at the end, that of nothing; chunks of each text (offsets)."""
    h = _GEAR[raw]
    for k in (1, 2, 4, 8):
        h[k:] = h[k:] + (h[:-k] << np.uint32(k))
    at = np.flatnonzero((h >> np.uint32(32 - CUT_BITS)) == 0) + 1
    text = np.searchsorted(offs, at, "right") - 1
    # the hash has to see bytes of its own text only
    at = at[(text < len(offs) - 1) & (at - offs[np.minimum(text, len(offs) - 2)] >= WINDOW)]
    starts = np.union1d(at, offs[:-1][np.diff(offs) > 0])
    sizes = np.diff(np.append(starts, len(raw)))
    pieces = -(-sizes // MOST)
    starts = np.repeat(starts, pieces) + MOST * ragged(np.zeros(len(pieces), np.int64), pieces)
    return np.append(starts, len(raw)), np.searchsorted(starts, offs)


_PARTS = pa.schema([("bucket", pa.int32()), ("origin", pa.int64()), *((c, pa.binary()) for c in "abcd")])
_SPARK = "bucket int, origin long, a binary, b binary, c binary, d binary"
_FLAGS = pa.schema([("bucket", pa.int32()), ("origin", pa.int64()), ("flags", pa.binary())])
_OUT = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_bytes", "n_chunks", "n_repeated", "n_removed", "n_spans")), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("size", pa.int64())])))])


def _heads(*keys: np.ndarray) -> np.ndarray:
    """Which entries of sorted keys differ from the one before."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return new


def _post(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        origin, pack = TaskContext.get().partitionId() << 32, zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for b in blocks(batch, most=2_000_000):
                origin += 1
                raw, offs = text_bytes(b.column("text"))
                starts, per = chunk_bounds(raw, offs)
                digest, more = (span_hashes(x, starts[:-1], starts[1:]) for x in (raw, raw ^ np.uint8(0x55)))
                column = b.column("doc_id").cast(pa.int64())
                known = np.array(column.is_valid())
                ids = np.where(known, np.array(column.fill_null(0)), np.iinfo(np.int64).min)
                text = np.repeat(np.arange(len(ids)), np.diff(per))
                # the first of equal chunks of this block, in the order of doc_id
                rank = np.empty(len(ids), np.int64)
                rank[np.argsort(ids, kind="stable")] = np.arange(len(ids))
                order = np.lexsort((starts[:-1], rank[text], more, digest))
                new = _heads(digest[order], more[order])
                inverse = np.empty(len(order), np.int64)
                inverse[order] = np.cumsum(new) - 1
                lead = order[new]
                one, two, times = digest[lead], more[lead], np.diff(np.append(np.flatnonzero(new), len(order)))
                bucket = (one >> np.uint64(64 - bits)).astype(np.int64)
                meta = np.concatenate([np.diff(starts), inverse, lead, times]).astype("<i4").tobytes()
                counts = np.array([len(digest), len(one)], "<i8").tobytes()
                rows = [(-1, origin, ids.astype("<i8").tobytes() + known.astype(np.uint8).tobytes(), counts + per.astype("<i8").tobytes(), offs.astype("<i8").tobytes(), pack.compress(meta))]
                # digests rise, so buckets do
                cuts = np.flatnonzero(np.diff(bucket)) + 1
                for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(bucket)]):
                    if j > i:
                        rows.append((int(bucket[i]), origin, one[i:j].astype("<u8").tobytes(), text[lead[i:j]].astype("<i4").tobytes(), ids.astype("<i8").tobytes(), two[i:j].astype("<u8").tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), _PARTS)], schema=_PARTS)

    return run


def _meet(t: pa.Table) -> pa.Table:
    """For one range of digests: which entries are the first of their digest (1), and which have others (2)."""
    rows = sorted(t.combine_chunks().to_pylist(), key=lambda r: r["origin"])
    parts = [np.frombuffer(r["a"], "<u8") for r in rows]
    ids = np.concatenate([np.frombuffer(r["c"], "<i8")[np.frombuffer(r["b"], "<i4")] for r in rows])
    digest, more = np.concatenate(parts), np.concatenate([np.frombuffer(r["d"], "<u8") for r in rows])
    order = np.lexsort((ids, more, digest))
    new = _heads(digest[order], more[order])
    flags = np.empty(len(order), np.uint8)
    flags[order] = new + 2 * (~new | ~np.append(new[1:], True))
    cuts = np.cumsum([0, *map(len, parts)])
    return pa.table([[r["bucket"] for r in rows], [r["origin"] for r in rows], [flags[x:y].tobytes() for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist())]], schema=_FLAGS)


def _mark(with_spans: bool, least: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _OUT.empty_table()
        row = left.to_pylist()[0]
        n_chunks, n_one = np.frombuffer(row["b"][:16], "<i8").tolist()
        per, offs = np.frombuffer(row["b"][16:], "<i8"), np.frombuffer(row["c"], "<i8")
        n = len(offs) - 1
        ids, known = np.frombuffer(row["a"][: 8 * n], "<i8"), np.frombuffer(row["a"][8 * n :], np.uint8).astype(bool)
        meta = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["d"]), "<i4").astype(np.int64) if n_chunks else np.zeros(0, np.int64)
        size, inverse, lead, times = np.split(meta, [n_chunks, 2 * n_chunks, 2 * n_chunks + n_one])
        flags = np.frombuffer(b"".join(r["flags"] for r in sorted(right.to_pylist(), key=lambda r: r["bucket"])), np.uint8)
        first = np.zeros(n_chunks, bool)
        first[lead] = flags & 1 == 1
        again = (flags >= 2) | (times > 1)
        repeated = again[inverse] if n_chunks else np.zeros(0, bool)
        later = repeated & ~first
        text = np.repeat(np.arange(n), np.diff(per))

        def runs(on: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Heads and sizes of the long enough runs of marked chunks within a text."""
            new = np.ones(n_chunks, bool)
            new[1:] = (on[1:] != on[:-1]) | (text[1:] != text[:-1])
            heads = np.flatnonzero(new)
            total = np.add.reduceat(size, heads) if len(heads) else np.zeros(0, np.int64)
            long = on[heads] & (total >= least)
            return heads[long], total[long]

        heads, total = runs(later)
        again_heads, again_total = runs(repeated)
        start = (np.cumsum(size) - size)[heads] - offs[text[heads]]
        by = lambda x, w: np.bincount(x, w, n).astype(np.int64)
        owner = text[heads]
        spans = None
        if with_spans:
            at = np.searchsorted(owner, np.arange(n + 1))
            pairs = [{"start": int(a), "size": int(b)} for a, b in zip(start, total)]
            spans = [pairs[at[i] : at[i + 1]] for i in range(n)]
        return pa.table([pa.array(ids, mask=~known), pa.array(np.diff(offs)), pa.array(np.diff(per)), pa.array(by(text[again_heads], again_total)), pa.array(by(owner, total)), pa.array(by(owner, np.ones(len(owner)))), pa.array(spans if with_spans else [None] * n, _OUT.field("spans").type)], schema=_OUT)

    return run


def dedup_chunks(docs: DataFrame, with_spans: bool = True, least_run: int = LEAST_RUN) -> DataFrame:
    """doc_id, n_bytes, n_chunks, n_repeated, n_removed, n_spans (and spans) for each row of ``docs`` (doc_id, text).

    n_repeated: bytes of runs of chunks that stand somewhere else too, the first copies included; n_removed: bytes of the
    runs that go, which are later copies; spans: start and
    size of these, in bytes.
    """
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark, "chunks")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(4, math.ceil(math.log2(max(1, size / (1 << CUT_BITS) / RANGE_ITEMS))))
    posted = scratch.keep(docs.mapInArrow(_post(bits), _SPARK), "posted")
    flags = posted.where("bucket >= 0").groupBy("bucket").applyInArrow(_meet, "bucket int, origin long, flags binary")
    out = posted.where("bucket < 0").groupBy("origin").cogroup(flags.groupBy("origin")).applyInArrow(_mark(with_spans, least_run), "doc_id long, n_bytes long, n_chunks long, n_repeated long, n_removed long, n_spans long, spans array<struct<start: long, size: long>>")
    out = scratch.keep(out if with_spans else out.drop("spans"), "marked")
    scratch.drop(posted)
    return out


def cut_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """What is left of a text's bytes."""
    out, at = [], 0
    for start, size in sorted(spans):
        out.append(text[at:start])
        at = start + size
    return b"".join([*out, text[at:]])


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_chunks(table(spark, sf_dir, "documents").select("doc_id", "text"), with_spans=False)
