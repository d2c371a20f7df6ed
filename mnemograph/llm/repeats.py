"""Suffix-array dedup (operator 10): exact repeated strings with a run-length index.

Every byte that a string of ``SPAN`` bytes covers which also starts anywhere else is found, exactly and over all texts.

1. *Anchors.* Each window of ``SPAN`` bytes has an anchor, its k-gram of least hash (a minimiser), so equal windows have
   equal anchors at equal places. Windows with one anchor lie side by side; the bytes under them are its context. Those
   with at least ``HALF`` bytes before the anchor share a key, the bytes that all of them hold, and so do the others:
   under these two keys a context is posted to the task of its key's hash range, equal contexts of a block once.
2. *Meeting.* Equal contexts are repeats as they stand. Contexts that share a key without being equal, at least one of
   them unique, go to an index; all others are done. A hash range with far more entries than the others (a key that
   stands in a large part of all texts) is split by context, so that no task meets more than a bounded number.
3. *Run-length index.* The contexts of some keys are suffix-sorted and the Burrows-Wheeler transform is kept as runs with
   text positions sampled at both ends of each (``RunIndex``); the suffix array goes. ``match_lengths`` streams through
   the text: a position whose suffix is not at the end of a run matches one byte less than the position before (its
   neighbour in the order is the same, one byte on), and at a run's end the match with the neighbour is measured. A
   window whose match is at least ``SPAN`` is marked.
4. *Large keys.* A key whose different contexts exceed ``INDEX_BYTES`` is refined: its windows are halved by the anchor's
   place in them, so that more bytes are common to each half and make up a longer key; equal contexts of a half count as
   repeats and go on once. At the last step a key is a whole window. Rows at most double at each of eight steps, and no
   context is compared with all others.
5. *Removal.* Marks meet the texts again, which travel compressed in blocks.

Null texts are empty. Repeated rows are texts of their own, so each repeats the other. An empty table gives an empty
result. Other columns are not read. Texts of any length are read in slices of ``SLICE`` bytes; a task holds a small
multiple of ``BLOCK`` bytes, or of its longest text. Equality of posted contexts is that of two 64-bit hashes, of the key
and of the context; of contexts of a refined key, two 64-bit hashes of the context.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Scratch, table
from .textblocks import blocks, mix, ragged, span_hashes, text_bytes

SPAN, GRAM = 200, 32
BLOCK, SLICE = 1_000_000, 500_000
#: Entries of a hash range, bytes of contexts that one index holds, and bytes of contexts of a group of keys.
RANGE_ITEMS, INDEX_BYTES, PART_BYTES = 1_000_000, 1_000_000, 1_000_000
_C = np.uint64(0x9E3779B97F4A7C15)
_PLACE = np.uint64((1 << 20) - 1)
_POWERS = np.array([1 << (8 * i) for i in range(1, 8)], np.uint64)


def gram_hashes(raw: np.ndarray, k: int = GRAM) -> np.ndarray:
    """Hash of the k bytes (a power of two) from each position; by doubling."""
    h = raw.astype(np.uint64) + np.uint64(1)
    m, c = 1, int(_C)
    while m < k:
        if len(h) <= m:
            return h[:0]
        h = h[:-m] * np.uint64(c) + h[m:]
        m, c = 2 * m, c * c & 0xFFFFFFFFFFFFFFFF
    return mix(h)


def _slice_anchors(raw: np.ndarray, k: int, w: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of the first ``most`` runs of ``w`` k-grams: place of the least, the first of equal ones."""
    h = gram_hashes(raw, k)
    n = min(most, len(h) - w + 1)
    if n <= 0:
        return np.zeros(0, np.int32)
    key = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
    del h
    grid = np.full(-(-len(key) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    grid[: len(key)] = key
    del key
    grid = grid.reshape(-1, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()[w - 1 : w - 1 + n]
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()[:n]
    return (np.minimum(behind, ahead) & _PLACE).astype(np.int32)


def window_anchors(raw: np.ndarray, offs: np.ndarray, span: int = SPAN, k: int = GRAM, step: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimisers: for each window of ``span`` bytes inside a text, its k-gram of least hash, the first of equal ones.

    Returns, for each anchor: position of the k-gram, first and last window start that it is the anchor of.
    """
    step, w = step or SLICE, span - k + 1
    parts = []
    for a in range(0, len(raw), step):
        least = _slice_anchors(raw[a : a + step + span - 1], k, w, step)
        # windows that lie inside a text
        lo, hi = np.maximum(offs[:-1], a) - a, np.minimum(offs[1:] - span, a + len(least) - 1) - a
        some = hi >= lo
        edge = np.zeros(len(least) + 1, np.int32)
        np.add.at(edge, lo[some], 1)
        np.add.at(edge, hi[some] + 1, -1)
        at = np.flatnonzero(np.cumsum(edge)[:-1] > 0)
        pos = least[at]
        new = np.ones(len(at), bool)
        new[1:] = (pos[1:] != pos[:-1]) | (at[1:] != at[:-1] + 1)
        heads = np.flatnonzero(new)
        last = np.append(heads[1:], len(at)) - 1
        if len(at):
            parts.append(np.stack([pos[heads] + a, at[heads] + a, at[last] + a]).astype(np.int64))
    pos, first, last = np.concatenate(parts, axis=1) if parts else np.zeros((3, 0), np.int64)
    # an anchor whose windows lie on both sides of a slice's end is one
    new = np.ones(len(pos), bool)
    new[1:] = (pos[1:] != pos[:-1]) | (first[1:] != last[:-1] + 1)
    heads = np.flatnonzero(new)
    return pos[heads], first[heads], last[np.append(heads[1:], len(pos)) - 1] if len(pos) else last


def suffix_order(text: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and its inverse of strings laid end to end, each with a terminator of its own behind it.

    ``text`` has byte + 1, and 0 for terminators; ``lengths`` count them in. Terminators come first, in order. Prefix
    doubling from seven bytes on; only groups that are still tied are sorted again.
    """
    n = len(text)
    ends = np.cumsum(lengths) - 1
    stop = np.repeat(ends, lengths)
    key, place = np.zeros(n, np.int64), np.arange(n)
    wide = np.append(text.astype(np.int64), np.zeros(7, np.int64))
    for j in range(7):
        key = (key << 9) | np.where(place + j <= stop, wide[j : j + n], 0)
    sa = np.argsort(key, kind="stable")
    key = key[sa]
    head = np.ones(n, bool)
    head[1:] = key[1:] != key[:-1]
    slots = np.arange(n)
    rank = np.empty(n, np.int64)
    rank[sa] = slots[head][np.cumsum(head) - 1]
    rank[ends] = np.arange(len(ends))
    sa[: len(ends)] = ends
    head[: len(ends)] = True
    h = 7
    single = head & np.append(head[1:], True)
    tied = slots[~single]
    while len(tied):
        p = sa[tied]
        both = rank[p] * n + rank[np.minimum(p + h, stop[p])]
        order = np.argsort(both)
        p, both = p[order], both[order]
        sa[tied] = p
        new = np.ones(len(p), bool)
        new[1:] = both[1:] != both[:-1]
        rank[p] = tied[new][np.cumsum(new) - 1]
        tied = tied[~(new & np.append(new[1:], True))]
        h *= 2
    return sa, rank


def common_prefix(eight: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the bytes at a and b, at most ``most``; eight: the big-endian 8 bytes at each place."""
    out = np.zeros(len(a), np.int64)
    live = np.flatnonzero(most > 0)
    while len(live):
        x = eight[a[live] + out[live]] ^ eight[b[live] + out[live]]
        same = x == 0
        out[live[same]] += 8
        rest, x = live[~same], x[~same]
        out[rest] += 7 - np.searchsorted(_POWERS, x, "right")
        live = live[same]
        live = live[out[live] < most[live]]
    return np.minimum(out, most)


class RunIndex:
    """A run-length index of strings laid end to end, as ``suffix_order`` takes them.

    Held are the runs of the Burrows-Wheeler transform (``symbol``, ``size``) and the text positions at both ends of each
    (``head``, ``tail``); the suffix array is only there while they are made. What stands before a string's first byte
    is a symbol of its own.
    """

    def __init__(self, text: np.ndarray, lengths: np.ndarray):
        self.text, self.ends = text, np.cumsum(lengths) - 1
        self.lengths = lengths
        sa, _ = suffix_order(text, lengths)
        before = np.empty(len(text), np.int64)
        before[1:] = text[:-1]
        before[self.ends - lengths + 1] = -1 - np.arange(len(lengths))
        bwt = before[sa]
        at = np.flatnonzero(np.concatenate([[True], bwt[1:] != bwt[:-1]]))
        self.symbol, self.size = bwt[at], np.diff(np.append(at, len(bwt)))
        self.head, self.tail = sa[at], sa[np.append(at[1:], len(bwt)) - 1]

    def match_lengths(self) -> np.ndarray:
        """At each position, how long the string is that starts there and somewhere else too, within one of the strings.

        The neighbour in the order of a run's head is the tail of the run before it, and that of its tail the head of the
        run behind it: only these pairs are measured, and along the text a match shrinks by one in between.
        """
        n = len(self.text)
        padded = np.concatenate([(self.text - 1).astype(np.uint8), np.zeros(16, np.uint8)])
        eight = np.ndarray(n + 9, ">u8", padded, strides=(1,)).astype(np.uint64)
        left = np.repeat(self.ends, self.lengths) - np.arange(n)
        best, place = np.zeros(n, np.int64), np.arange(n)
        for ends, p, q in ((self.head, self.head[1:], self.tail[:-1]), (self.tail, self.tail[:-1], self.head[1:])):
            length = np.full(n, -1, np.int64)
            length[ends] = 0
            length[p] = common_prefix(eight, p, q, np.minimum(left[p], left[q]))
            last = np.maximum.accumulate(np.where(length >= 0, place, 0))
            best = np.maximum(best, length[last] - (place - last))
        return best


def repeated_starts(data: list[bytes], span: int = SPAN) -> list[np.ndarray]:
    """For each of some different contexts, which of its windows of ``span`` bytes are somewhere else in them too."""
    sizes = np.array([len(d) for d in data])
    lengths = sizes + 1
    text = np.zeros(int(lengths.sum()), np.int16)
    at = np.cumsum(lengths) - lengths
    text[ragged(at, sizes)] = np.frombuffer(b"".join(data), np.uint8).astype(np.int16) + 1
    long = RunIndex(text, lengths).match_lengths() >= span
    return [long[a : a + max(0, k - span + 1)] for a, k in zip(at.tolist(), sizes.tolist())]


_BLOB = "kind int, bucket int, origin long, a binary, b binary, c binary, d binary"
_BLOBS = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("origin", pa.int64()), *((c, pa.binary()) for c in "abcd")])
_FLAG = "origin long, idx binary, flag binary, key binary"
_FLAGS = pa.schema([("origin", pa.int64()), *((c, pa.binary()) for c in ("idx", "flag", "key"))])
_ROW = "key long, origin long, pos long, lo int, hi int, at int, data binary"
_ROWS = pa.schema([("key", pa.int64()), ("origin", pa.int64()), ("pos", pa.int64()), *((c, pa.int32()) for c in ("lo", "hi", "at")), ("data", pa.binary())])
_MARK = "origin long, pos binary, n binary"
_MARKS = pa.schema([("origin", pa.int64()), ("pos", pa.binary()), ("n", pa.binary())])


def sides(span: int) -> tuple[tuple[int, int], tuple[int, int]]:
    """The two ranges of places of the anchor in a window. Windows of a range (lo, hi) hold the ``lo`` bytes before the anchor and the ``span - hi`` bytes from it on."""
    half = (span - GRAM) // 2
    return (half, span - GRAM), (0, half - 1)


def _post(bits: int, span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        origin, pack = TaskContext.get().partitionId() << 32, zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for b in blocks(batch, most=BLOCK):
                origin += 1
                raw, offs = text_bytes(b.column("text"))
                pos, first, last = window_anchors(raw, offs, span)
                shape = ((pos - first) * span + (last - first)).astype(np.uint64)
                ctx = mix(span_hashes(raw, first, last + span) ^ mix(shape + np.uint64(1)))
                one, lead, inverse, times = np.unique(ctx, return_index=True, return_inverse=True, return_counts=True)
                ids = b.column("doc_id").cast(pa.int64())
                head = np.array(ids.fill_null(0)).astype("<i8").tobytes() + np.array(ids.is_valid()).astype(np.uint8).tobytes()
                anchors = np.concatenate([np.diff(first, prepend=0).astype("<i4").view(np.uint8), inverse.astype("<i4").view(np.uint8), (pos - first).astype(np.uint8), (last - first).astype(np.uint8)]).tobytes()
                rows = [(0, 0, origin, head, offs.astype("<i8").tobytes(), pack.compress(anchors), pack.compress(raw.tobytes()))]
                p, a, z = pos[lead], first[lead], last[lead]
                keys, who = [], []
                for salt, (lo, hi) in enumerate(sides(span)):
                    at = np.flatnonzero((p - a >= lo) & (p - z <= hi))
                    keys.append(mix(span_hashes(raw, p[at] - lo, p[at] + span - hi) + np.uint64(3 + salt)))
                    who.append(2 * at + salt)
                keys, who = np.concatenate(keys), np.concatenate(who)
                bucket = (keys >> np.uint64(64 - bits)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                keys, who, bucket = keys[order], who[order], bucket[order]
                cuts = np.flatnonzero(np.diff(bucket)) + 1
                for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(bucket)]):
                    if j > i:
                        rows.append((1, int(bucket[i]), origin, keys[i:j].astype("<u8").tobytes(), one[who[i:j] >> 1].astype("<u8").tobytes(), who[i:j].astype("<i4").tobytes(), (times[who[i:j] >> 1] > 1).astype(np.uint8).tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), _BLOBS)], schema=_BLOBS)

    return run


def _deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Splits the entries of large hash ranges by context."""
    schema = pa.schema([("part", pa.int64()), *((f.name, f.type) for f in _BLOBS if f.name not in ("kind", "bucket")), ("split", pa.bool_())])
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            if r["pieces"] == 1:
                out.append((r["bucket"] << 32, r["origin"], r["a"], r["b"], r["c"], r["d"], False))
                continue
            parts = [np.frombuffer(r[c], t) for c, t in (("a", "<u8"), ("b", "<u8"), ("c", "<i4"), ("d", np.uint8))]
            piece = (mix(parts[1]) % np.uint64(r["pieces"])).astype(np.int64)
            for i in np.unique(piece).tolist():
                out.append((r["bucket"] << 32 | i, r["origin"], *(x[piece == i].tobytes() for x in parts), True))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), schema)], schema=schema)


def _meet(t: pa.Table) -> pa.Table:
    """For one range of keys: contexts that are repeated (flag 1), and those to index (flag 2) with their keys."""
    t = t.combine_chunks()
    keys, ctx, who, many = (np.frombuffer(b"".join(t.column(c).to_pylist()), d) for c, d in (("a", "<u8"), ("b", "<u8"), ("c", "<i4"), ("d", np.uint8)))
    sizes = np.array([len(x) for x in t.column("d").to_pylist()])
    order = np.lexsort((ctx, keys))
    k, c = keys[order], ctx[order]
    new_key = np.ones(len(k), bool)
    new_key[1:] = k[1:] != k[:-1]
    new_ctx = new_key.copy()
    new_ctx[1:] |= c[1:] != c[:-1]
    heads = np.flatnonzero(new_ctx)
    times = np.diff(np.append(heads, len(k)))
    twice = (times > 1) | (np.maximum.reduceat(many[order], heads) > 0)
    group = np.cumsum(new_key[heads]) - 1
    # a range that is split by context does not see all contexts of a key, so it leaves nothing out
    index = ((np.bincount(group) > 1) & (np.bincount(group, ~twice) > 0) | t.column("split")[0].as_py())[group]
    flag = np.zeros(len(k), np.uint8)
    flag[heads[index]] = 2
    flag[order] = flag + np.repeat(twice, times)
    of = np.repeat(np.arange(len(sizes)), sizes)
    at = np.flatnonzero(flag)
    cuts = np.searchsorted(of[at], np.arange(len(sizes) + 1))
    got = []
    for i, origin in enumerate(t.column("origin").to_pylist()):
        x = at[cuts[i] : cuts[i + 1]]
        if len(x):
            got.append((origin, who[x].tobytes(), flag[x].tobytes(), keys[x[flag[x] >= 2]].tobytes()))
    return pa.table([pa.array(v, f.type) for v, f in zip(zip(*got), _FLAGS)], schema=_FLAGS) if got else _FLAGS.empty_table()


class _Block:
    """A block of texts with its anchors, unpacked."""

    def __init__(self, row: dict):
        unpack = zstandard.ZstdDecompressor()
        self.offs = np.frombuffer(row["b"], "<i8")
        n = len(self.offs) - 1
        self.ids, self.known = np.frombuffer(row["a"][: 8 * n], "<i8"), np.frombuffer(row["a"][8 * n :], np.uint8).astype(bool)
        packed = unpack.decompress(row["c"])
        m = len(packed) // 10
        self.first = np.cumsum(np.frombuffer(packed[: 4 * m], "<i4").astype(np.int64))
        self.inverse = np.frombuffer(packed[4 * m : 8 * m], "<i4")
        self.pos, self.last = self.first + np.frombuffer(packed[8 * m : 9 * m], np.uint8), self.first + np.frombuffer(packed[9 * m :], np.uint8)
        self.packed = row["d"]
        self.lead = np.zeros(int(self.inverse.max()) + 1 if m else 0, np.int64)
        self.lead[self.inverse[::-1]] = np.arange(m)[::-1]

    def raw(self) -> bytes:
        return zstandard.ZstdDecompressor().decompress(self.packed)


def _contexts(span: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _ROWS.empty_table()
        block = _Block(left.to_pylist()[0])
        flags = right.to_pylist()
        who, flag, key = (np.concatenate([np.frombuffer(r[c], d) for r in flags]) for c, d in (("idx", "<i4"), ("flag", np.uint8), ("key", "<i8")))
        who = who[flag >= 2]
        if not len(who):
            return _ROWS.empty_table()
        raw, at, (lo, hi) = block.raw(), block.lead[who >> 1], np.array(sides(span))[who & 1].T
        p = block.pos[at]
        low, high = np.maximum(lo, p - block.last[at]), np.minimum(hi, p - block.first[at])
        data = [raw[a:b] for a, b in zip((p - high).tolist(), (p - low + span).tolist())]
        return pa.table([pa.array(key), pa.array(np.full(len(who), int(left.column("origin")[0].as_py()))), pa.array(p - high), *(pa.array(x.astype(np.int32)) for x in (lo, hi, high)), pa.array(data, pa.binary())], schema=_ROWS)

    return run


def _runs(on: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of the runs of true values."""
    edge = np.diff(np.concatenate([[0], on.astype(np.int8), [0]]))
    starts = np.flatnonzero(edge == 1)
    return starts, np.flatnonzero(edge == -1) - starts


def _index(span: int):
    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        key, origin, pos, data = np.array(t.column("key")), t.column("origin").to_pylist(), t.column("pos").to_pylist(), t.column("data").to_pylist()
        held: dict[int, list[tuple[int, int]]] = {}

        def put(row: int, starts: list[int], sizes: list[int]) -> None:
            held.setdefault(origin[row], []).extend((pos[row] + a, n) for a, n in zip(starts, sizes))

        def search(rows: list[int]) -> None:
            kinds: dict[bytes, list[int]] = {}
            for i in rows:
                kinds.setdefault(data[i], []).append(i)
            # equal contexts are repeats as they stand; of those, one is matched against
            for same in kinds.values():
                for i in same if len(same) > 1 else ():
                    put(i, [0], [len(data[i]) - span + 1])
            if len(kinds) > 1:
                for same, on in zip(kinds.values(), repeated_starts(list(kinds), span)):
                    if len(same) == 1 and on.any():
                        put(same[0], *(x.tolist() for x in _runs(on)))

        # keys are taken together up to the bound of an index
        order = np.argsort(key, kind="stable")
        cuts = np.flatnonzero(np.diff(key[order])) + 1
        rows: list[int] = []
        size = 0
        for group in np.split(order, cuts):
            more = sum(len(data[i]) for i in group.tolist())
            if rows and size + more > INDEX_BYTES:
                search(rows)
                rows, size = [], 0
            rows += group.tolist()
            size += more
        search(rows)
        got = [(o, np.array([a for a, _ in v], "<i8").tobytes(), np.array([n for _, n in v], "<i8").tobytes()) for o, v in held.items()]
        return pa.table([pa.array(v, f.type) for v, f in zip(zip(*got), _MARKS)], schema=_MARKS) if got else _MARKS.empty_table()

    return run


_RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])


def _remove(span: int, keep_text: bool):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _RESULT.empty_table()
        block = _Block(left.to_pylist()[0])
        whole = np.zeros(len(block.lead), bool)
        starts, ends = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for r in right.to_pylist():
            if r["n"] is None:
                whole[np.frombuffer(r["idx"], "<i4")[np.frombuffer(r["flag"], np.uint8) & 1 == 1] >> 1] = True
            else:
                at = np.frombuffer(r["pos"], "<i8")
                starts.append(at)
                ends.append(at + np.frombuffer(r["n"], "<i8") - 1 + span)
        of = np.flatnonzero(whole[block.inverse]) if len(whole) else np.zeros(0, np.int64)
        a, z = np.concatenate([block.first[of], *starts]), np.concatenate([block.last[of] + span, *ends])
        order = np.argsort(a, kind="stable")
        a, z = a[order], np.maximum.accumulate(z[order])
        text = np.searchsorted(block.offs, a, "right") - 1
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] > z[:-1]) | (text[1:] != text[:-1])
        heads = np.flatnonzero(new)
        a, z, text = a[heads], z[np.append(heads[1:], len(new)) - 1] if len(heads) else z, text[heads]
        n = len(block.offs) - 1
        removed, spans = np.bincount(text, z - a, n).astype(np.int64), np.bincount(text, minlength=n)
        raw, sums, kept = memoryview(block.raw()), [], []
        cuts = np.searchsorted(text, np.arange(n + 1))
        for i, (x, y) in enumerate(zip(block.offs[:-1].tolist(), block.offs[1:].tolist())):
            gone = slice(int(cuts[i]), int(cuts[i + 1]))
            parts = [raw[u:v] for u, v in zip([x, *z[gone].tolist()], [*a[gone].tolist(), y])]
            digest = hashlib.sha256()
            for part in parts:
                digest.update(part)
            sums.append(digest.hexdigest())
            kept.append(b"".join(parts) if keep_text else None)
        return pa.table([pa.array(block.ids, mask=~block.known), pa.array(np.diff(block.offs)), pa.array(removed), pa.array(spans), pa.array(sums), pa.array(kept, pa.binary())], schema=_RESULT)

    return run


def _halves(rows: DataFrame, span: int) -> DataFrame:
    """The contexts of large keys under two longer keys each: places of the anchor up to the middle of the range, and beyond it."""
    mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
    low = F.col("at") - (F.length("data") - span)
    cut = rows.withColumn("half", F.explode(F.array(F.struct(F.col("lo").alias("l"), mid.alias("h")), F.struct((mid + 1).alias("l"), F.col("hi").alias("h")))))
    cut = cut.withColumn("from", F.greatest(F.col("half.l"), low)).withColumn("to", F.least(F.col("half.h"), F.col("at"))).where("from <= to")
    data = F.substring(F.col("data"), F.col("at") - F.col("to") + 1, F.col("to") - F.col("from") + span)
    fixed = F.substring(F.col("data"), F.col("at") - F.col("half.l") + 1, F.col("half.l") + span - F.col("half.h"))
    return cut.select(F.xxhash64("half.l", "half.h", fixed).alias("key"), "origin", (F.col("pos") + F.col("at") - F.col("to")).alias("pos"), F.col("half.l").alias("lo"), F.col("half.h").alias("hi"), F.col("to").cast("int").alias("at"), data.alias("data"))


def _one(c: str):
    """A long as the 8 bytes, least first, that ``_remove`` reads."""
    return F.unhex(F.concat(*[F.substring(F.lpad(F.hex(c), 16, "0"), 15 - 2 * i, 2) for i in range(8)]))


def _search_large(asked: DataFrame, scratch: Scratch, span: int) -> list[DataFrame]:
    """Marks of all contexts in ``asked``; those of large keys are refined until their keys are small."""
    marks = []
    while True:
        sums = asked.groupBy("key").agg(F.sum(F.octet_length("data")).alias("bytes"))
        total, most = sums.agg(F.sum("bytes"), F.max("bytes")).first()
        if not total:
            return marks
        big = sums.where(F.col("bytes") > INDEX_BYTES).select("key")
        small = asked if most <= INDEX_BYTES else asked.join(big, "key", "left_anti")
        parts = max(12, math.ceil(total / PART_BYTES))
        found = small.select("key", "origin", "pos", "data", F.pmod(F.xxhash64("key"), F.lit(parts)).alias("part")).groupBy("part").applyInArrow(_index(span), _MARK)
        marks.append(scratch.keep(found, "marks"))
        if most <= INDEX_BYTES:
            scratch.drop(asked)
            return marks
        rows = asked.join(big, "key", "left_semi").withColumn("d", F.xxhash64("data")).withColumn("e", F.xxhash64(F.lit(17), "data"))
        rows = scratch.keep(rows, "large")
        kinds = rows.groupBy("key", "d", "e").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("origin", "pos")).alias("head")).where("times > 1")
        counted = scratch.keep(rows.join(kinds, ["key", "d", "e"], "left"), "counted")
        equal = counted.where("times > 1").withColumn("windows", (F.length("data") - span + 1).cast("long"))
        marks.append(scratch.keep(equal.select("origin", _one("pos").alias("pos"), _one("windows").alias("n")), "marks"))
        alone = counted.where("times is null or (head.origin = origin and head.pos = pos)").drop("d", "e", "times", "head")
        before, asked = asked, scratch.keep(_halves(alone, span), "halves")
        scratch.drop(before, rows, counted)


def remove_repeats(docs: DataFrame, span: int = SPAN, keep_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the bytes left) for each row of ``docs`` (doc_id, text)."""
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark, "repeats")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(4, math.ceil(math.log2(max(1, size / 40 / RANGE_ITEMS))))
    posted = scratch.keep(docs.mapInArrow(_post(bits, span), _BLOB), "posted")
    texts = posted.where("kind = 0")
    entries = posted.where("kind = 1").drop("kind")
    # a few rows: one for each hash range
    loads = entries.groupBy("bucket").agg(F.ceil(F.sum(F.octet_length("d")) / RANGE_ITEMS).cast("int").alias("pieces"))
    loads = scratch.keep(loads.withColumn("pieces", F.when(F.col("pieces") > 3, F.col("pieces")).otherwise(1)), "loads")
    if loads.where("pieces > 1").limit(1).count():
        dealt = entries.join(loads, "bucket").mapInArrow(_deal, "part long, origin long, a binary, b binary, c binary, d binary, split boolean")
    else:
        dealt = entries.withColumn("part", F.col("bucket").cast("long")).withColumn("split", F.lit(False)).drop("bucket")
    flags = scratch.keep(dealt.groupBy("part").applyInArrow(_meet, _FLAG), "flags")
    asked = texts.groupBy("origin").cogroup(flags.groupBy("origin")).applyInArrow(_contexts(span), _ROW)
    marks = _search_large(scratch.keep(asked, "contexts"), scratch, span)
    known = flags.select("origin", "idx", "flag", F.lit(None).cast("binary").alias("pos"), F.lit(None).cast("binary").alias("n"))
    for m in marks:
        known = known.unionByName(m.withColumns({"idx": F.lit(None).cast("binary"), "flag": F.lit(None).cast("binary")}))
    out = texts.groupBy("origin").cogroup(known.groupBy("origin")).applyInArrow(_remove(span, keep_text), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    out = scratch.keep(out if keep_text else out.drop("kept"), "removed")
    scratch.drop(posted, loads, flags, *marks)
    return out


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
