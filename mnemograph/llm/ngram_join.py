"""N-gram Jaccard join (operator 1): exact T-occurrence search with DivideSkip.

``ngram_classes`` links texts whose sets of word shingles have a Jaccard similarity of at least ``num/den`` and
returns each row's class. It is exact: no sampling, no caps.

1. *Occurrence filter.* Every text's distinct 64-bit shingle hashes go, as packed blocks, to the task of their hash
   range. There a shingle counts as shared when two different sets hold it. A set that links with another one shares
   at least ``num/den`` of its shingles, so all other sets leave. Equal sets of a block are posted once, before the
   shuffle. Only the shared shingles come back, with their frequency class.
2. *Prefixes.* Each remaining set posts its rarest ``n - ceil(n * num/den) + 1`` shingles (prefix filter), so two sets
   that link post a common one. Lists of up to ``FEW`` sets give their pairs, which are checked one by one. The sets of a
   longer list (a group of copies, or boilerplate) are tied together, and tied sets make up a block; pairs that lie
   inside one block are left to it. So rare shingles that unlike sets share by chance never chain them into blocks.
3. *DivideSkip.* In a block, ``Index.search`` merges a query's short inverted lists, keeps the documents that reach
   ``T - L`` occurrences, and probes the ``L`` long lists by binary search. The search walks over components: found
   documents leave the index, so a group of m near copies costs about m searches of a shrinking index, not m * m pairs.
4. *Crowded blocks*, of more than ``CROWD`` sets, are cut down by pivots first. All sets are compared with one of them.
   Those that link with it are of its class and leave; as the Jaccard distance is a metric, only sets within twice the
   distance of a link can link with any of these, and only they are searched for in the leaving ones, which are dealt
   over many tasks. Of the sets that are left, those found so are of one class, and need no links among themselves: if
   the others are few, they are searched for in pieces of them. Else the next pivot follows. A group of copies, however
   large, is gone after a round or two, and no task holds it. What remains after ``ROUNDS`` rounds is searched in pieces,
   two by two.

Nulls and texts without words have no shingles and link with nothing. Repeated rows are kept, a null doc_id too (a
class's id is its smallest non-null doc_id). Other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Scratch, components, table
from .textblocks import Words, blocks, distinct_sorted, ragged, text_bytes, windows

SHINGLE = 5
NUM, DEN = 3, 4
#: Shingles for each hash range, and bytes of shingle hashes that one search task holds.
RANGE_ITEMS = 3_000_000
BLOCK_BYTES = 24_000_000
#: Sets of a list that are paired, sets of a block that one task searches, and most rounds of pivots.
FEW, CROWD, ROUNDS = 6, 200, 6
_LOW = np.uint64((1 << 48) - 1)

_POSTS = "bucket int, origin long, doc binary, cnt binary, digest binary, h binary"
_BACK = "origin long, kind int, doc binary, cnt binary, digest binary, h binary, f binary"
_SETS = "doc_id long, text_hash long, n long, digest binary, live boolean, ids binary, freq binary"


def shingle_sets(raw: np.ndarray, offs: np.ndarray, k: int, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, and offsets."""
    words = Words(raw, offs, lower)
    h, at = windows(words.hashes(), words.per_text, k)
    return distinct_sorted(h, at)


def _least(n, num: int, den: int):
    """ceil(n * num / den)."""
    return -(-n * num // den)


def _six(h: np.ndarray) -> bytes:
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unsix(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _post(bits: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        origin = TaskContext.get().partitionId() << 32
        schema = pa.schema([("bucket", pa.int32()), ("origin", pa.int64()), *((c, pa.binary()) for c in ("doc", "cnt", "digest", "h"))])
        for batch in batches:
            for b in blocks(batch):
                raw, offs = text_bytes(b.column("text"))
                h, at = shingle_sets(raw, offs, k)
                sizes = np.diff(at)
                data = memoryview(h.view(np.uint8))
                digests = [hashlib.blake2b(data[8 * x : 8 * y], digest_size=16).digest() if y > x else b"" for x, y in zip(at[:-1].tolist(), at[1:].tolist())]
                seen: dict[bytes, int] = {}
                lead = np.array([seen.setdefault(d, i) == i and d != b"" for i, d in enumerate(digests)], bool)
                text_of = np.repeat(np.arange(len(sizes)), sizes)
                mine = lead[text_of]
                h, text_of = h[mine], text_of[mine]
                bucket = (h >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)
                order = np.argsort(bucket.astype(np.uint16) if bits <= 16 else bucket, kind="stable")
                h, text_of, bucket = h[order], text_of[order], bucket[order]
                new = np.ones(len(h), bool)
                new[1:] = (bucket[1:] != bucket[:-1]) | (text_of[1:] != text_of[:-1])
                heads = np.flatnonzero(new)
                cnt = np.diff(np.append(heads, len(h))).astype("<i4")
                docs, pieces = text_of[heads].astype("<i4"), bucket[heads]
                short = np.frombuffer(b"".join(d[:8] or bytes(8) for d in digests), "<u8")
                origin += 1
                ids = b.column("doc_id").cast(pa.int64())
                known = np.array(ids.is_valid())
                rows = [(-1 - origin % (1 << bits), origin, np.array(ids.fill_null(0)).astype("<i8").tobytes() + np.array(b.column("text_hash")).astype("<i8").tobytes() + known.astype(np.uint8).tobytes(), sizes.astype("<i8").tobytes(), b"".join(d or bytes(16) for d in digests), lead.astype(np.uint8).tobytes())]
                for i, j in _runs(pieces):
                    x, y = heads[i], heads[j] if j < len(heads) else len(h)
                    rows.append((int(pieces[i]), origin, docs[i:j].tobytes(), cnt[i:j].tobytes(), short[docs[i:j]].tobytes(), _six(h[x:y])))
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)

    return run


def _runs(values: np.ndarray) -> list[tuple[int, int]]:
    if not len(values):
        return []
    cuts = np.flatnonzero(values[1:] != values[:-1]) + 1
    return list(zip([0, *cuts.tolist()], [*cuts.tolist(), len(values)]))


def _meet(bits: int):
    """For one hash range: which of the posted shingles are in two different sets, and in how many about."""

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        origin = t.column("origin").to_pylist()
        out = {c: [] for c in ("origin", "kind", "doc", "cnt", "digest", "h", "f")}

        def put(*row):
            for c, v in zip(out, row):
                out[c].append(v)

        first = t.column("bucket")[0].as_py()
        cols = {c: t.column(c) for c in ("doc", "cnt", "digest", "h")}
        if first < 0:
            for i, o in enumerate(origin):
                put(o, 0, *(cols[c][i].as_py() for c in cols), None)
            return pa.table(out, schema=_back_schema())
        parts = [{"doc": np.frombuffer(cols["doc"][i].as_py(), "<i4"), "cnt": np.frombuffer(cols["cnt"][i].as_py(), "<i4"), "set": np.frombuffer(cols["digest"][i].as_py(), "<u8"), "h": _unsix(cols["h"][i].as_py())} for i in range(len(origin))]
        h = np.concatenate([p["h"] for p in parts])
        sets = np.concatenate([np.repeat(p["set"], p["cnt"]) for p in parts])
        order = np.argsort(h)
        hs, ss = h[order], sets[order]
        heads = np.flatnonzero(np.concatenate([[True], hs[1:] != hs[:-1]]))
        runs = np.diff(np.append(heads, len(hs)))
        many = np.minimum.reduceat(ss, heads) != np.maximum.reduceat(ss, heads)
        # the frequency class, 1 to 62, of a shingle; 0 where one set alone holds it
        cls = np.where(many, np.maximum(1, np.log2(runs).astype(np.int64)), 0).astype(np.uint8)
        freq = np.empty(len(h), np.uint8)
        freq[order] = np.repeat(cls, runs)
        at = 0
        for o, p in zip(origin, parts):
            f = freq[at : at + len(p["h"])]
            at += len(p["h"])
            got = f > 0
            if got.any():
                owner = np.repeat(np.arange(len(p["doc"])), p["cnt"])
                c = np.bincount(owner[got], minlength=len(p["doc"]))
                put(o, 1, p["doc"][c > 0].tobytes(), c[c > 0].astype("<i4").tobytes(), None, np.int32(first).tobytes() + _six(p["h"][got]), f[got].tobytes())
        return pa.table(out, schema=_back_schema())

    return run


def _back_schema() -> pa.Schema:
    return pa.schema([("origin", pa.int64()), ("kind", pa.int32()), *((c, pa.binary()) for c in ("doc", "cnt", "digest", "h", "f"))])


def _gather(bits: int, num: int, den: int):
    """For one block of texts: its rows, and the shared shingles of the sets that stay."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("live", pa.bool_()), ("ids", pa.binary()), ("freq", pa.binary())])

    def run(t: pa.Table) -> pa.Table:
        rows = t.combine_chunks().to_pylist()
        meta = next(r for r in rows if r["kind"] == 0)
        n = np.frombuffer(meta["cnt"], "<i8")
        lead = np.frombuffer(meta["h"], np.uint8).astype(bool)
        (ids, texts), known = np.frombuffer(meta["doc"][: 16 * len(n)], "<i8").reshape(2, -1), np.frombuffer(meta["doc"][16 * len(n) :], np.uint8).astype(bool)
        owner, low, freq = [], [], []
        for r in rows:
            if r["kind"] == 1:
                owner.append(np.repeat(np.frombuffer(r["doc"], "<i4"), np.frombuffer(r["cnt"], "<i4")))
                b = int(np.frombuffer(r["h"][:4], np.int32)[0])
                h = _unsix(r["h"][4:])
                keep = 64 - bits
                low.append((h & np.uint64((1 << min(48, keep)) - 1)) | np.uint64((b << keep) & ((1 << 64) - 1) if bits else 0))
                freq.append(np.frombuffer(r["f"], np.uint8))
        owner, low, freq = (np.concatenate(x) if x else np.zeros(0, d) for x, d in ((owner, np.int32), (low, np.uint64), (freq, np.uint8)))
        order = np.lexsort((low, owner))
        owner, low, freq = owner[order], low[order], freq[order]
        at = np.searchsorted(owner, np.arange(len(n) + 1))
        live = lead & (n > 0) & (np.diff(at) * den >= n * num)
        digests = [meta["digest"][16 * i : 16 * i + 16] if n[i] else None for i in range(len(n))]
        return pa.table([
            pa.array(ids, mask=~known), pa.array(texts), pa.array(n), pa.array(digests, pa.binary()), pa.array(live),
            pa.array([low[at[i] : at[i + 1]].tobytes() if v else None for i, v in enumerate(live)], pa.binary()),
            pa.array([freq[at[i] : at[i + 1]].tobytes() if v else None for i, v in enumerate(live)], pa.binary()),
        ], schema=schema)

    return run


def _prefix(num: int, den: int):
    schema = pa.schema([("shingle", pa.int64()), ("n", pa.int64()), ("digest", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, size, who = [], [], []
            for n, d, i, f in zip(*(b.column(c).to_pylist() for c in ("n", "digest", "ids", "freq"))):
                ids, freq = np.frombuffer(i, np.uint64), np.frombuffer(f, np.uint8)
                # those that this set has alone come first in the order and link with nothing
                rest = n - _least(n, num, den) + 1 - (n - len(ids))
                if rest > 0:
                    out.append(ids[np.lexsort((ids, freq))[:rest]])
                    size.append(n)
                    who.append(d)
            if out:
                counts = [len(x) for x in out]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64)), pa.array(np.repeat(size, counts), pa.int64()), pa.array(who, pa.binary()).take(pa.array(np.repeat(np.arange(len(who)), counts)))], schema=schema)

    return run


def _neighbours(num: int, den: int, few: int):
    """Sets that post the same shingle and whose sizes can link: pairs of short lists, ties to the first one of long lists."""
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("long", pa.bool_())])

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        s, n = (np.array(t.column(c)) for c in ("shingle", "n"))
        order = np.lexsort((n, s))
        s, n = s[order], n[order]
        new = np.ones(len(s), bool)
        new[1:] = (s[1:] != s[:-1]) | (n[:-1] * den < n[1:] * num)
        heads = np.flatnonzero(new)
        run_of = np.cumsum(new) - 1
        long = (np.diff(np.append(heads, len(s))) > few)[run_of]
        tied = np.flatnonzero(~new & long)
        a, b = [heads[run_of[tied]]], [tied]
        for step in range(1, few):
            y = np.flatnonzero(~long[step:] & (run_of[step:] == run_of[:-step])) + step
            y = y[n[y - step] * den >= n[y] * num]
            a.append(y - step)
            b.append(y)
        kind = np.repeat([1, 0], [len(tied), sum(map(len, b[1:]))])
        # the same two sets meet in many shingles of this range: once is enough
        codes = t.column("digest").combine_chunks().dictionary_encode()
        code = np.array(codes.indices)
        pairs = np.unique(np.stack([code[order[np.concatenate(a)]], code[order[np.concatenate(b)]], kind]), axis=1)
        return pa.table([codes.dictionary.take(pa.array(pairs[0])), codes.dictionary.take(pa.array(pairs[1])), pa.array(pairs[2] == 1)], schema=schema)

    return run


class Index:
    """Inverted lists of sets of a block, searched by DivideSkip."""

    #: Weight of the length of the longest list in the number of long lists.
    MU = 0.05

    def __init__(self, sizes: np.ndarray, tokens: np.ndarray, at: np.ndarray, num: int = NUM, den: int = DEN):
        self.sizes, self.tokens, self.at, self.num, self.den = sizes, tokens, at, num, den
        self.build(np.arange(len(sizes)))

    def build(self, docs: np.ndarray) -> None:
        counts = self.at[docs + 1] - self.at[docs]
        tok = self.tokens[ragged(self.at[docs], counts)]
        order = np.argsort(tok, kind="stable")
        self.lists = np.repeat(docs, counts)[order]
        self.ptr = np.searchsorted(tok[order], np.arange((self.tokens.max() if len(self.tokens) else 0) + 2))
        self.held = len(docs)

    def search(self, q: int, out: np.ndarray) -> np.ndarray:
        """The indexed documents that link with q, without those marked in ``out``."""
        toks = self.tokens[self.at[q] : self.at[q + 1]]
        start, length = self.ptr[toks], self.ptr[toks + 1] - self.ptr[toks]
        some = length > 0
        start, length = start[some], length[some]
        least = int(_least(self.sizes[q], self.num, self.den))
        if len(length) < least:
            return np.zeros(0, np.int64)
        order = np.argsort(length)
        start, length = start[order], length[order]
        n_long = min(int(least / (self.MU * np.log2(max(2, length[-1])) + 1)), least - 1, len(length) - 1)
        short = len(length) - n_long
        merged = self.lists[ragged(start[:short], length[:short])]
        merged.sort(kind="stable")
        heads = np.flatnonzero(np.concatenate([[True], merged[1:] != merged[:-1]]))
        docs, hits = merged[heads], np.diff(np.append(heads, len(merged)))
        ok = (hits >= least - n_long) & ~out[docs] & (self.sizes[docs] * self.den >= self.sizes[q] * self.num) & (self.sizes[q] * self.den >= self.sizes[docs] * self.num)
        docs, hits = docs[ok], hits[ok]
        for s, n in zip(start[short:].tolist(), length[short:].tolist()):
            if not len(docs):
                break
            part = self.lists[s : s + n]
            at = np.minimum(np.searchsorted(part, docs), n - 1)
            hits = hits + (part[at] == docs)
        both = self.sizes[docs] + self.sizes[q]
        return docs[hits * (self.num + self.den) >= self.num * both]


def spanning_links(sizes: np.ndarray, tokens: np.ndarray, at: np.ndarray, num: int = NUM, den: int = DEN) -> list[tuple[int, int]]:
    """Links that join each class of a block: one for each document but the first of a class."""
    index = Index(sizes, tokens, at, num, den)
    out = np.zeros(len(sizes), bool)
    left, links = len(sizes), []
    for root in range(len(sizes)):
        if out[root]:
            continue
        out[root], queue = True, [root]
        left -= 1
        while queue and left:
            q = queue.pop()
            found = index.search(q, out)
            out[found] = True
            left -= len(found)
            links += [(q, d) for d in found.tolist()]
            queue += found.tolist()
            if left * 2 < index.held:
                index.build(np.flatnonzero(~out))
    return links


def _search(num: int, den: int):
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def run(t: pa.Table) -> pa.Table:
        sizes = np.array(t.column("n"))
        sets = [np.frombuffer(x, np.uint64) for x in t.column("ids").to_pylist()]
        counts = np.array([len(x) for x in sets])
        tokens = np.unique(np.concatenate(sets), return_inverse=True)[1].ravel()
        links = spanning_links(sizes, tokens, np.concatenate([[0], np.cumsum(counts)]), num, den)
        digests = t.column("digest").to_pylist()
        return pa.table([pa.array([digests[i] for i, _ in links], pa.binary()), pa.array([digests[j] for _, j in links], pa.binary())], schema=schema)

    return run


def _common(x: bytes, y: bytes) -> int:
    """Number of shingles that two sets share."""
    return len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))


def _check_pairs(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*(b.column(c).to_pylist() for c in ("an", "bn", "ai", "bi")))
            ok = [_common(x, y) * (num + den) >= num * (m + n) for m, n, x, y in rows]
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _zones(num: int, den: int):
    """Where each set lies from its block's pivot: 0 linked, 1 within twice the distance of a link, 2 beyond."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            zone = []
            for n, x, m, y, own in zip(*(b.column(c).to_pylist() for c in ("n", "ids", "pn", "pids")), pa.compute.equal(b.column("digest"), b.column("pivot")).to_pylist()):
                c = _common(x, y)
                zone.append(0 if own or c * (num + den) >= num * (m + n) else 1 if c * 2 * num >= (2 * num - den) * (m + n) else 2)
            yield pa.RecordBatch.from_arrays([b.column("label"), b.column("n"), b.column("digest"), b.column("ids"), b.column("inside"), b.column("pivot"), pa.array(zone, pa.int32())], ["label", "n", "digest", "ids", "inside", "pivot", "zone"])

    return run


def _bridge(num: int, den: int):
    """Links between the sets near a pivot (zone 1) and a piece of those linked with it (zone 0): one for each of the former is enough."""
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def run(t: pa.Table) -> pa.Table:
        zone, sizes, digests = np.array(t.column("zone")), np.array(t.column("n")), t.column("digest").to_pylist()
        near, inner = np.flatnonzero(zone == 1), np.flatnonzero(zone == 0)
        if not len(near) or not len(inner):
            return schema.empty_table()
        sets = [np.frombuffer(x, np.uint64) for x in t.column("ids").to_pylist()]
        tokens = np.unique(np.concatenate(sets), return_inverse=True)[1].ravel()
        index = Index(sizes, tokens, np.concatenate([[0], np.cumsum([len(x) for x in sets])]), num, den)
        index.build(inner)
        none, links = np.zeros(len(sizes), bool), []
        for q in near.tolist():
            links += [(digests[q], digests[d]) for d in index.search(q, none)[:1].tolist()]
        return pa.table([pa.array([a for a, _ in links], pa.binary()), pa.array([b for _, b in links], pa.binary())], schema=schema)

    return run


def _pair_links(pairs: DataFrame, block: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The links among pairs (a, b) whose sets are not in one block."""
    for side in "ab":
        pairs = pairs.join(block.select(F.col("node").alias(side), F.col("label").alias(side + "l")), side, "left")
    pairs = pairs.where("al is null or bl is null or al <> bl").select("a", "b")
    for side in "ab":
        pairs = pairs.join(sets.select(F.col("digest").alias(side), F.col("n").alias(side + "n"), F.col("ids").alias(side + "i")), side)
    return pairs.mapInArrow(_check_pairs(num, den), "a binary, b binary")


def _size() -> list[Column]:
    return [F.count(F.lit(1)).alias("sets"), F.sum(F.octet_length("ids")).alias("bytes")]


def _bridges(zoned: DataFrame, num: int, den: int) -> DataFrame:
    """Links between sets of zone 1 and sets of zone 0 of a block; the latter are dealt in pieces, the former go to each."""
    pieces = F.greatest(F.least(F.ceil(F.col("sets") / CROWD), F.lit(16)), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int")
    dealt = zoned.join(zoned.where("zone = 0").groupBy("label").agg(*_size()).select("label", pieces.alias("pieces")), "label")
    every = F.when(F.col("zone") == 1, F.sequence(F.lit(0), F.col("pieces") - 1)).otherwise(F.array(F.pmod(F.xxhash64("digest"), F.col("pieces").cast("long")).cast("int")))
    return dealt.withColumn("piece", F.explode(every)).select("label", "piece", "zone", "n", "digest", "ids").groupBy("label", "piece").applyInArrow(_bridge(num, den), "a binary, b binary")


def _block_links(member: DataFrame, scratch: Scratch, num: int, den: int) -> list[DataFrame]:
    """Links that join the classes inside blocks; member: label, n, digest, ids."""
    links, ready = [], []
    # inside: in the class of the block's first pivot, so that two such sets need no link of their own
    member = member.withColumn("inside", F.lit(False))
    unknown = F.when(~F.col("inside"), F.octet_length("ids"))
    for turn in range(ROUNDS):
        sums = member.groupBy("label").agg(*_size(), F.count(unknown).alias("open"), F.coalesce(F.sum(unknown), F.lit(0)).alias("weight"))
        calm = (F.col("sets") <= CROWD) & (F.col("bytes") <= BLOCK_BYTES)
        few = F.lit(turn > 0) & (F.col("open") <= 10 * CROWD) & (F.col("weight") <= BLOCK_BYTES // 4)
        state = F.when(F.col("open") == 0, "done").when(calm, "calm").when(few, "few").otherwise("busy")
        sums = scratch.keep(sums.select("label", state.alias("state")), "sums")
        found = {r["state"] for r in sums.select("state").distinct().collect()}
        placed = member.join(sums, "label")
        ready.append(placed.where("state = 'calm' or state = 'few' and not inside"))
        if "few" in found:
            sides = placed.where("state = 'few'").withColumn("zone", F.when(F.col("inside"), 0).otherwise(1))
            links.append(scratch.keep(_bridges(sides, num, den), "links"))
        if "busy" not in found:
            member = None
            break
        open_ = placed.where("state = 'busy'")
        pick = open_.where("not inside").groupBy("label").agg(F.min("digest").alias("pivot"))
        pivots = open_.join(pick, "label").where("digest = pivot").select("label", "pivot", F.col("n").alias("pn"), F.col("ids").alias("pids"))
        zoned = open_.join(pivots, "label").mapInArrow(_zones(num, den), "label binary, n long, digest binary, ids binary, inside boolean, pivot binary, zone int")
        zoned = scratch.keep(zoned, "zones")
        links.append(zoned.where("zone = 0 and digest <> pivot").select(F.col("pivot").alias("a"), F.col("digest").alias("b")))
        bridged = scratch.keep(_bridges(zoned.where("zone < 2"), num, den), "links")
        links.append(bridged)
        member = zoned.where("zone > 0").select("label", "n", "digest", "ids", "inside")
        if turn == 0:
            hit = bridged.select(F.col("a").alias("digest")).distinct().withColumn("hit", F.lit(True))
            member = member.join(hit, "digest", "left").select("label", "n", "digest", "ids", F.col("hit").isNotNull().alias("inside"))
    left = reduce(DataFrame.unionByName, [x.select("label", "n", "digest", "ids") for x in [*ready, member] if x is not None])
    # mostly small blocks; what the rounds have left of a large one is cut into pieces
    pieces = left.groupBy("label").agg(F.ceil(F.sum(F.octet_length("ids")) / BLOCK_BYTES).cast("int").alias("pieces"))
    mine = F.pmod(F.xxhash64("digest"), F.col("pieces").cast("long")).cast("int")
    placed = left.join(pieces, "label").withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    placed = placed.withColumn("x", F.least("mine", "other")).withColumn("y", F.greatest("mine", "other"))
    links.append(scratch.keep(placed.select("label", "x", "y", "n", "digest", "ids").groupBy("label", "x", "y").applyInArrow(_search(num, den), "a binary, b binary"), "links"))
    return links


def ngram_classes(docs: DataFrame, k: int = SHINGLE, num: int = NUM, den: int = DEN) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of ``docs`` (doc_id, text); also text_hash (of the whole text),
    class_key (the same for all rows of a class, null without shingles) and class_size (its rows)."""
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark, "ngram")
    text = F.col("text").cast("string")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(4, int(np.ceil(np.log2(max(1, size / 6 / RANGE_ITEMS)))))

    posted = docs.mapInArrow(_post(bits, k), _POSTS)
    met = posted.groupBy("bucket").applyInArrow(_meet(bits), _BACK)
    sets = scratch.keep(met.groupBy("origin").applyInArrow(_gather(bits, num, den), _SETS), "sets")

    live = sets.where("live").select("n", "digest", "ids", "freq")
    parts = max(8, 1 << bits)
    near = live.mapInArrow(_prefix(num, den), "shingle long, n long, digest binary").groupBy(F.pmod(F.xxhash64("shingle"), F.lit(parts)).alias("part"))
    met = scratch.keep(near.applyInArrow(_neighbours(num, den, FEW), "a binary, b binary, long boolean"), "met")
    block = components(met.where("long").select("a", "b"), scratch)
    pairs = scratch.keep(met.where("not long").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "pairs")

    asked = block.select(F.col("node").alias("digest")).union(pairs.select("a")).union(pairs.select("b")).distinct()
    member = scratch.keep(live.select("n", "digest", "ids").join(asked, "digest", "left_semi").dropDuplicates(["digest"]), "members")
    links = scratch.keep(_pair_links(pairs, block, member, num, den), "links")
    tied = member.join(block.withColumnRenamed("node", "digest"), "digest").select("label", "n", "digest", "ids")
    for more in _block_links(tied, scratch, num, den):
        links = links.unionByName(more)
    label = components(links, scratch)

    named = sets.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("rows"))
    named = named.join(label.withColumnRenamed("node", "digest"), "digest", "left").withColumn("label", F.coalesce("label", "digest"))
    classes = named.groupBy("label").agg(F.min("first_id").alias("component_id"), F.sum("rows").alias("class_size"))
    # kept apart from the rows that it was counted from, so that a join by a label of many sets can be split
    by_set = named.select("digest", "label").join(scratch.keep(classes, "counted"), "label")
    out = sets.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), "digest").join(by_set, "digest", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"), "text_hash", F.col("label").alias("class_key"))
    out = scratch.keep(out, "classes")
    scratch.clear(out)
    return out


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_classes(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id", "class_size")
