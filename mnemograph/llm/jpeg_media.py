"""Media columns (operator 6): baseline JPEG.

``payload_images`` stores bytes losslessly as baseline JPEG: each byte is the DC coefficient of one 8 x 8 luminance
block (quantiser 8, so a flat block of exactly that sample), 192 blocks in a row, and a restart interval for each row.
Images hold at most 8191 rows, as JPEG sizes are 16-bit; a longer payload is several images, one after the other.

``store_media`` writes such images as a table and reads that table back. ``image_features`` reads images: it parses the markers, Huffman-decodes the scan and rebuilds the luminance thumbnail
from the DC coefficients alone (one sample for each block), for one or three interleaved components with any sampling
factors. It decodes all restart intervals of many images side by side in numpy. A damaged image gives nulls.

Null texts are empty, and an empty text's payload is one row of blanks. Repeated rows are kept; equal texts give equal
values. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Scratch, table
from .textblocks import binary_column, blocks, ragged, text_bytes

ROW, MAX_ROWS = 192, 8191
# The code lengths of the DC luminance table in the JPEG standard, and an AC table of one code, end of block.
DC_BITS = (0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0)
DC_SYMBOLS = tuple(range(12))
AC_BITS = (1, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0)
AC_SYMBOLS = (0,)


def codes(bits: tuple[int, ...], symbols: tuple[int, ...]) -> dict[int, tuple[int, int]]:
    """Canonical Huffman codes: symbol -> (code, length)."""
    out, code, at = {}, 0, 0
    for length, n in enumerate(bits, 1):
        for s in symbols[at : at + n]:
            out[s] = (code, length)
            code += 1
        at += n
        code <<= 1
    return out


def lookup(bits: tuple[int, ...], symbols: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Symbol and code length for each 16-bit beginning; length 0 where no code fits."""
    sym, length = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
    for s, (code, n) in codes(bits, symbols).items():
        a = code << (16 - n)
        sym[a : a + (1 << (16 - n))], length[a : a + (1 << (16 - n))] = s, n
    return sym, length


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def header(rows: int) -> bytes:
    """All that stands before the scan of an image of ``rows`` rows of blocks."""
    return b"".join([
        b"\xff\xd8",
        _segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0"),
        _segment(0xDB, b"\0" + bytes([8] * 64)),
        _segment(0xC0, struct.pack(">BHHB", 8, 8 * rows, 8 * ROW, 1) + b"\1\x11\0"),
        _segment(0xC4, b"\0" + bytes(DC_BITS) + bytes(DC_SYMBOLS)),
        _segment(0xC4, b"\x10" + bytes(AC_BITS) + bytes(AC_SYMBOLS)),
        _segment(0xDD, struct.pack(">H", ROW)),
        _segment(0xDA, b"\1\1\0\0\x3f\0"),
    ])


def encode_rows(payload: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entropy-coded bytes of each row of 192 samples, stuffed, and offsets."""
    n = len(payload) // ROW
    v = payload.reshape(n, ROW).astype(np.int32) - 128
    diff = v.copy()
    diff[:, 1:] -= v[:, :-1]
    diff = diff.ravel()
    cat = np.zeros(512, np.int32)
    cat[1:] = np.floor(np.log2(np.arange(1, 512))).astype(np.int32) + 1
    size = cat[np.abs(diff)]
    table_ = codes(DC_BITS, DC_SYMBOLS)
    code = np.array([table_[s][0] for s in DC_SYMBOLS], np.uint32)
    length = np.array([table_[s][1] for s in DC_SYMBOLS], np.int32)
    magnitude = np.where(diff < 0, diff + (1 << size) - 1, diff).astype(np.uint32)
    # the last bit is the code for "end of block"
    word = ((code[size] << size.astype(np.uint32)) | magnitude) << np.uint32(1)
    bits = length[size] + size + 1
    ends = np.cumsum(bits.reshape(n, ROW), axis=1)
    row_bytes = (ends[:, -1] + 7) // 8
    starts = np.concatenate([[0], np.cumsum(row_bytes)])
    at = (ends - bits.reshape(n, ROW)).ravel() + np.repeat(starts[:-1] * 8, ROW)
    wide = word << (24 - (at & 7) - bits).astype(np.uint32)
    cell, total = at >> 3, int(starts[-1]) + 3
    out = np.bincount(cell, wide >> np.uint32(16), total) + np.bincount(cell + 1, (wide >> np.uint32(8)) & np.uint32(255), total) + np.bincount(cell + 2, wide & np.uint32(255), total)
    out = out[: starts[-1]].astype(np.uint8)
    out[starts[1:] - 1] |= ((1 << (row_bytes * 8 - ends[:, -1])) - 1).astype(np.uint8)
    full = out == 255
    stuffed = np.zeros(len(out) + int(full.sum()), np.uint8)
    stuffed[np.arange(len(out)) + np.cumsum(full) - full] = out
    return stuffed, starts + np.concatenate([[0], np.cumsum(full)])[starts]


def encode_payloads(payload: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Images of each payload (multiples of 192 bytes, one after the other), and offsets."""
    scan, at = encode_rows(payload)
    scan = scan.tobytes()
    out, ends = [], [0]
    for a, b in zip((offs[:-1] // ROW).tolist(), (offs[1:] // ROW).tolist()):
        size = 0
        for first in range(a, b, MAX_ROWS):
            last = min(b, first + MAX_ROWS)
            parts = [header(last - first)]
            for i in range(first, last):
                parts.append(scan[at[i] : at[i + 1]])
                parts.append(b"\xff" + bytes([0xD0 + (i - first) % 8]))
            parts[-1] = b"\xff\xd9"
            image = b"".join(parts)
            out.append(image)
            size += len(image)
        ends.append(ends[-1] + size)
    return np.frombuffer(b"".join(out), np.uint8), np.array(ends)


def padded(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's bytes, filled up with blanks to a positive multiple of 192."""
    sizes = np.diff(offs)
    full = np.maximum(1, -(-sizes // ROW)) * ROW
    at = np.concatenate([[0], np.cumsum(full)])
    out = np.full(at[-1], 32, np.uint8)
    out[ragged(at[:-1], sizes)] = raw
    return out, at


class Frame:
    """One image's header: what the markers say, and where its scan is."""

    def __init__(self, data: bytes, at: int):
        self.quant, self.dc, self.ac, self.interval = {}, {}, {}, 0
        if data[at : at + 2] != b"\xff\xd8":
            raise ValueError("no start of image")
        at += 2
        while True:
            if data[at] != 0xFF:
                raise ValueError("no marker")
            marker = data[at + 1]
            size = struct.unpack(">H", data[at + 2 : at + 4])[0]
            body = data[at + 4 : at + 2 + size]
            at += 2 + size
            if marker == 0xDB:
                while body:
                    wide = 2 if body[0] >> 4 else 1
                    self.quant[body[0] & 15] = int.from_bytes(body[1 : 1 + wide], "big")
                    body = body[1 + 64 * wide :]
            elif marker == 0xC4:
                while body:
                    bits = tuple(body[1:17])
                    n = sum(bits)
                    (self.ac if body[0] >> 4 else self.dc)[body[0] & 15] = (bits, tuple(body[17 : 17 + n]))
                    body = body[17 + n :]
            elif marker == 0xC0:
                depth, self.height, self.width, n = struct.unpack(">BHHB", body[:6])
                if depth != 8:
                    raise ValueError("not 8-bit")
                self.parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            elif marker in (0xC1, 0xC2, 0xC3):
                raise ValueError("not baseline")
            elif marker == 0xDD:
                self.interval = struct.unpack(">H", body)[0]
            elif marker == 0xDA:
                tables = {body[1 + 2 * i]: (body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])}
                break
        self.scan = at
        one = len(self.parts) == 1
        self.h, self.v = (1, 1) if one else (max(p[1] for p in self.parts), max(p[2] for p in self.parts))
        self.across, self.down = -(-self.width // (8 * self.h)), -(-self.height // (8 * self.v))
        # of each block of an MCU: component, DC table, AC table
        self.blocks = tuple((i, self.dc[tables[p[0]][0]], self.ac[tables[p[0]][1]]) for i, p in enumerate(self.parts) for _ in range(1 if one else p[1] * p[2]))
        self.luma = (1, 1) if one else self.parts[0][1:3]
        self.key = (self.blocks, self.quant[self.parts[0][3]], self.h, self.v, self.luma)
        self.units = self.across * self.down


def decode_intervals(data: np.ndarray, start: np.ndarray, units: np.ndarray, pattern: tuple) -> np.ndarray:
    """DC values of the first component, (interval, MCU, block), of intervals that begin at bytes ``start`` of unstuffed data.

    All intervals advance together, one block a step. Raises ValueError on a code that no table has.
    """
    padded_ = np.concatenate([data, np.zeros(16, np.uint8)])
    eight = np.ndarray(len(data) + 9, ">u8", padded_, strides=(1,))
    luma = [i for i, b in enumerate(pattern) if b[0] == 0]
    out = np.zeros((len(start), int(units.max()), len(luma)), np.int32)
    tables = {t: lookup(*t) for b in pattern for t in b[1:]}
    order = np.argsort(-units, kind="stable")
    p, units = (start[order] * 8).astype(np.int64), units[order]
    last = np.zeros((len(start), 1 + max(b[0] for b in pattern)), np.int64)
    for unit in range(int(units.max())):
        live = int(np.searchsorted(-units, -unit, "left")) if units[-1] <= unit else len(units)
        q, seen = p[:live], 0
        for part, dc, ac in pattern:
            bits = eight[q >> 3].astype(np.uint64) << (q & 7).astype(np.uint64)
            top = (bits >> np.uint64(48)).astype(np.int64)
            size, used = tables[dc][0][top], tables[dc][1][top]
            value = ((bits << used.astype(np.uint64)) >> np.uint64(48)).astype(np.int64) >> (16 - size)
            value = np.where((size > 0) & (value < (1 << size) >> 1), value - (1 << size) + 1, value)
            last[:live, part] += value
            used = used + size
            bits <<= used.astype(np.uint64)
            q = q + used
            k = np.ones(live, np.int64)
            more = np.arange(live)
            while len(more):
                top = (bits >> np.uint64(48)).astype(np.int64)
                sym, used = tables[ac][0][top], tables[ac][1][top]
                if not used.all():
                    raise ValueError("no such code")
                skip = used + (sym & 15)
                if len(more) == live:
                    q = q + skip
                else:
                    q[more] += skip
                k[more] += (sym >> 4) + 1
                go = (sym != 0) & (k[more] < 64)
                if not go.any():
                    break
                more = more[go]
                at = q[more]
                bits = eight[at >> 3].astype(np.uint64) << (at & 7).astype(np.uint64)
            if part == 0:
                out[order[:live], unit, seen] = last[:live, 0]
                seen += 1
        p[:live] = q
    return out


def thumbnails(data: np.ndarray, frames: list[Frame], ends: list[int]) -> list[np.ndarray]:
    """DC-only luminance thumbnails (rows x columns of blocks) of images whose scans end at ``ends``; equal tables only."""
    spans = np.concatenate([np.arange(f.scan, e) for f, e in zip(frames, ends)]) if frames else np.zeros(0, np.int64)
    raw = data[spans]
    owner = np.repeat(np.arange(len(frames)), [e - f.scan for f, e in zip(frames, ends)])
    after = np.append(raw[1:], 0)
    mark = (raw == 255) & (after != 0) & np.append(owner[1:] == owner[:-1], False)
    restart = mark & (after >= 0xD0) & (after <= 0xD7)
    drop = mark.copy()
    drop[1:] |= mark[:-1] | ((raw[1:] == 0) & (raw[:-1] == 255) & (owner[1:] == owner[:-1]))
    kept = np.concatenate([[0], np.cumsum(~drop)])
    first = np.concatenate([[0], np.cumsum([e - f.scan for f, e in zip(frames, ends)])])[:-1]
    begins = np.sort(np.concatenate([first, np.flatnonzero(restart) + 2]))
    of = owner[begins]
    index = np.arange(len(begins)) - np.searchsorted(of, of)
    per = np.array([f.interval or f.units for f in frames])
    total = np.array([f.units for f in frames])
    units = np.minimum(per[of], total[of] - index * per[of])
    if (units <= 0).any() or (np.bincount(of, units, len(frames)) != total).any():
        raise ValueError("intervals do not fit the size")
    dc = decode_intervals(raw[~drop], kept[begins], units, frames[0].key[0])
    quant, _, _, (lh, lv) = frames[0].key[1:]
    out, at = [], 0
    for f, n in zip(frames, np.bincount(of, minlength=len(frames)).tolist()):
        got = dc[at : at + n].reshape(-1, dc.shape[2])
        if n * dc.shape[1] != f.units:
            got = np.concatenate([dc[at + i, : units[at + i]] for i in range(n)])
        at += n
        grid = got.reshape(f.down, f.across, lv, lh).transpose(0, 2, 1, 3).reshape(f.down * lv, f.across * lh)
        # a level shift of 128 and the DC gain of 8; whole blocks of the size only
        rows, cols = -(-f.height * lv // (8 * f.v)), -(-f.width * lh // (8 * f.h))
        out.append(np.clip((grid[:rows, :cols] * quant + 4 >> 3) + 128, 0, 255).astype(np.uint8))
    return out


def split_images(data: bytes, start: int, end: int) -> Iterator[tuple[Frame, int]]:
    """Header and end of scan of each of the images in a row."""
    while start < end:
        f = Frame(data, start)
        at = data.find(b"\xff\xd9", f.scan, end)
        if at < 0:
            raise ValueError("no end of image")
        yield f, at
        start = at + 2


def average_hash(thumb: np.ndarray) -> str:
    """64 bits: which of 64 even runs of the thumbnail are brighter than the whole."""
    flat = thumb.ravel()
    cuts = np.arange(65) * len(flat) // 64
    sums = np.diff(np.concatenate([[0], np.cumsum(flat, dtype=np.int64)])[cuts])
    return np.packbits(sums * len(flat) > flat.sum(dtype=np.int64) * np.maximum(1, np.diff(cuts))).tobytes().hex()


def payload_images(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media (JPEG) of each text's payload."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch, most=2_000_000):
                raw, offs = text_bytes(b.column("text"))
                media = binary_column(*encode_payloads(*padded(raw, offs)))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(np.diff(offs)), media], schema=schema)

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return picked.mapInArrow(run, "doc_id long, n_bytes long, media binary")


def store_media(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """The table of ``payload_images``, written and read again. Scans of equal rows are equal, which zstandard finds."""
    return scratch.keep(payload_images(docs), "media", compression="zstd")


_OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("width", pa.int32()), ("height", pa.int32())])


def image_features(media: DataFrame) -> DataFrame:
    """What the stored images hold, for each row of ``media`` (doc_id, n_bytes, media).

    payload_* are over the thumbnail's samples of all images of a row; ``feature`` is the size and the thumbnail's hash
    of each; width and height are those of the first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch, "media", 3_000_000):
                raw, offs = text_bytes(b.column("media"))
                data = raw.tobytes()
                images: list[list[tuple[Frame, int]] | None] = []
                for x, y in zip(offs[:-1].tolist(), offs[1:].tolist()):
                    try:
                        images.append(list(split_images(data, x, y)))
                    except (ValueError, KeyError, IndexError, struct.error):
                        images.append(None)
                thumbs: dict[int, np.ndarray] = {}
                groups: dict[tuple, list[tuple[int, int]]] = {}
                for i, parts in enumerate(images):
                    for f, end in parts or []:
                        groups.setdefault(f.key, []).append((id(f), (f, end)))
                for members in groups.values():
                    try:
                        got = thumbnails(raw, [m[1][0] for m in members], [m[1][1] for m in members])
                    except ValueError:
                        got = [_alone(raw, m[1]) for m in members]
                    thumbs.update((m[0], t) for m, t in zip(members, got))
                rows = []
                for doc_id, n, parts, x, y in zip(b.column("doc_id").to_pylist(), b.column("n_bytes").to_pylist(), images, offs[:-1].tolist(), offs[1:].tolist()):
                    whole = [thumbs[id(f)] for f, _ in parts] if parts else [None]
                    stored = hashlib.sha256(data[x:y]).hexdigest()
                    if any(t is None for t in whole):
                        rows.append((doc_id, n, None, None, None, y - x, stored, None, None, None))
                        continue
                    payload = b"".join(t.tobytes() for t in whole)
                    feature = ",".join(f"{f.width}x{f.height}:{average_hash(t)}" for (f, _), t in zip(parts, whole))
                    rows.append((doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), y - x, stored, feature, parts[0][0].width, parts[0][0].height))
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), _OUT)], schema=_OUT)

    picked = media.select("doc_id", "n_bytes", "media")
    return picked.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width int, height int")


def _alone(raw: np.ndarray, image: tuple[Frame, int]) -> np.ndarray | None:
    try:
        return thumbnails(raw, [image[0]], [image[1]])[0]
    except (ValueError, IndexError):
        return None


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "media")
    out = scratch.keep(image_features(store_media(table(spark, sf_dir, "documents"), scratch)), "features")
    scratch.clear(out)
    return out
