"""Arrow text columns as flat byte arrays: words, word hashes and shingle hashes.

All functions work on whole texts. A block is a slice of an Arrow batch that holds about
``BLOCK_BYTES`` of text (a longer text is a block of its own), so that memory per task stays
bounded whatever the number of rows in a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 4_000_000

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=np.uint64)
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def mix(h: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit values; a bijection."""
    h = (h ^ (h >> np.uint64(32))) * _A
    h = (h ^ (h >> np.uint64(29))) * _B
    return h ^ (h >> np.uint64(32))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows, one after the other, and the len + 1 offsets of the rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    column = column.cast(pa.large_string() if not pa.types.is_binary(column.type) else pa.large_binary())
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]] if len(column) else raw[:0], offs - offs[0] if len(column) else np.zeros(1, np.int64)


def blocks(batch: pa.RecordBatch, name: str = "text", most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``most`` bytes of text each."""
    if not batch.num_rows:
        return
    _, offs = text_bytes(batch.column(name))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + most, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each text of a block."""

    def __init__(self, raw: np.ndarray, offs: np.ndarray, lower: bool = False):
        self.raw = _LOWER[raw] if lower else raw
        self.offs = offs
        n = len(raw)
        inside = ~_SPACE[raw]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        edges = offs[:-1][np.diff(offs) > 0]
        first[edges] = inside[edges]
        if n:
            ends = offs[1:][np.diff(offs) > 0] - 1
            last[ends] = inside[ends]
        self.inside = inside
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        #: word positions of each text
        self.per_text = np.searchsorted(self.starts, offs)
        self.counts = np.diff(self.per_text)

    def hashes(self) -> np.ndarray:
        return span_hashes(self.raw, self.starts, self.ends)


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span, eight bytes at a time over all spans together."""
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(raw) + 1, "<u8", padded, strides=(1,))
    left = ends - starts
    h = left.astype(np.uint64) * _C
    live, at = np.arange(len(starts)), starts
    while len(live):
        part = h[live] ^ (eight[at] & _MASK[np.minimum(left, 8)])
        part = (part ^ (part >> np.uint64(31))) * _A
        h[live] = part ^ (part >> np.uint64(27))
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    return mix(h)


def equal_spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray, other_starts: np.ndarray, other_ends: np.ndarray) -> np.ndarray:
    """Whether each span of bytes equals its partner, eight bytes at a time over all pairs together."""
    x, y = (np.ndarray(len(r) + 1, "<u8", np.concatenate([r, np.zeros(8, np.uint8)]), strides=(1,)) for r in (raw, other))
    left = ends - starts
    same = left == other_ends - other_starts
    live = np.flatnonzero(same & (left > 0))
    a, b, left = starts[live], other_starts[live], left[live]
    while len(live):
        good = ((x[a] ^ y[b]) & _MASK[np.minimum(left, 8)]) == 0
        same[live[~good]] = False
        more = good & (left > 8)
        live, a, b, left = live[more], a[more] + 8, b[more] + 8, left[more] - 8
    return same


def windows(values: np.ndarray, per_text: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` neighbours within a text, and the len + 1 offsets by text.

    A text with fewer than ``k`` values, but not none, has one run: all of them.
    """
    n = len(values)
    counts = np.diff(per_text)
    runs = np.maximum(counts - k + 1, np.minimum(counts, 1))
    offs = np.concatenate([[0], np.cumsum(runs)])
    if not offs[-1]:
        return np.zeros(0, np.uint64), offs
    h = np.zeros(n, np.uint64)
    for j in range(min(k, n)):
        h[: n - j] = h[: n - j] * _B + values[j:]
    h = mix(h)
    at = np.repeat(per_text[:-1] - offs[:-1], runs) + np.arange(offs[-1])
    out = h[at]
    for t in np.flatnonzero((counts > 0) & (counts < k)):
        x = np.array([counts[t]], np.uint64) * _C
        for v in values[per_text[t] : per_text[t + 1]]:
            x = mix(x * _A + v)
        out[offs[t]] = x[0]
    return out, offs


def distinct_sorted(values: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorts and dedups ``values`` within each row; values are changed in place."""
    for a, b in zip(offs[:-1].tolist(), offs[1:].tolist()):
        values[a:b].sort()
    if not len(values):
        return values, offs
    keep = np.ones(len(values), bool)
    keep[1:] = values[1:] != values[:-1]
    heads = offs[:-1][np.diff(offs) > 0]
    keep[heads] = True
    total = np.concatenate([[0], np.cumsum(keep)])
    return values[keep], total[offs]


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of each (start, count), one after the other."""
    total = int(counts.sum())
    heads = np.cumsum(counts) - counts
    return np.repeat(starts - heads, counts) + np.arange(total)


def binary_column(raw: np.ndarray, offs: np.ndarray) -> pa.Array:
    """An Arrow binary column from bytes and offsets."""
    return pa.Array.from_buffers(pa.large_binary(), len(offs) - 1, [None, pa.py_buffer(np.ascontiguousarray(offs, np.int64)), pa.py_buffer(np.ascontiguousarray(raw))]).cast(pa.binary())
