"""Token-id output (operator 2): a content-addressed store of token ids.

``write_store`` encodes each text, appends the end id, and cuts the id stream with a rolling hash over 16 ids: a chunk
ends where the hash's low bits are zero (or at ``MOST`` ids), so equal passages give equal chunks wherever they stand.
Three parts make up a store, all of them Parquet folders:

* ``chunks``: digest, ids (little-endian unsigned 16- or 32-bit). Each distinct chunk stands once.
* ``manifest``: one recipe for each document in ascending doc_id order: doc_id, start (ids of all documents before),
  n_tokens, digests and id counts of its chunks, and the Merkle root of the digests.
* ``format``: one row with the tokenizer's file name, id width and end id.

``read_store`` gives the ids of each document back; ``verify`` reads every chunk, checks each digest and Merkle root, and
computes each document's CRC-32 from those of its chunks, which needs no second shuffle of the ids.

A null text is empty: only the end id. Repeated rows are separate documents; null doc_ids come first. An empty table
gives an empty store. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import os
import sys
import types
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import Scratch, table
from .textblocks import Words, blocks, equal_spans, ragged, span_hashes, text_bytes

LEAST, MOST, AVERAGE_BITS = 128, 4096, 9
END = 2
#: Bytes of text that are encoded at once.
ENCODE_BYTES = 1_000_000
#: Words whose ids a worker keeps, and the mark that stands between words when they are encoded together.
CACHE_WORDS, MARK = 300_000, "~"
#: 1 for ASCII letters, 2 for ASCII signs and digits but the apostrophe, 0 for all else.
_KIND = np.array([1 if chr(i).isalpha() else 2 if 32 < i < 127 and i != 39 else 0 for i in range(128)] + [0] * 128, np.uint8)
_GEAR = np.random.default_rng(11).integers(0, 1 << 32, 1 << 16, dtype=np.uint32)


class WordEncoder:
    """Encodes texts through their distinct words: this tokenizer drops white space and case, so words encode on their own.

    Words are cut further where an ASCII letter and an ASCII sign or digit meet, as the tokenizer does itself; apostrophes,
    which may begin a contraction, and other scripts are left whole, and so are blocks that spell a special token.

    The ids of the first ``CACHE_WORDS`` words that it meets, most of the frequent ones, are kept in flat arrays in the order
    of the words' hashes, some 40 bytes a word, so a worker holds about 15 MB of them whatever the number of texts. Hashes
    only lead to a word: its bytes are compared before its ids are taken.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        mark = self.tok.encode(MARK, add_special_tokens=False).ids
        assert len(mark) == 1
        self.mark = mark[0]
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.start, self.count, self.at, self.size = (np.zeros(0, np.int32) for _ in range(4))
        self.pool, self.letters = np.zeros(0, np.int32), np.zeros(0, np.uint8)

    def ids_of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and id counts of words: many are encoded as one text with marks between them; those that hold the mark, alone."""
        counts, parts = np.zeros(len(words), np.int32), [np.zeros(0, np.int32)] * len(words)
        plain = np.array([i for i, w in enumerate(words) if MARK not in w], np.int64)
        pools = []
        for a in range(0, len(plain), 4000):
            part = plain[a : a + 4000].tolist()
            ids = np.array(self.tok.encode_batch_fast([f" {MARK} ".join([words[i] for i in part]) + f" {MARK}"], add_special_tokens=False)[0].ids, np.int32)
            cuts = np.flatnonzero(ids == self.mark)
            assert len(cuts) == len(part)
            pools.append(np.delete(ids, cuts))
            counts[part] = np.diff(np.concatenate([[-1], cuts])) - 1
        if len(plain) == len(words):
            return np.concatenate([np.zeros(0, np.int32), *pools]), counts
        flat = np.concatenate([np.zeros(0, np.int32), *pools])
        for i, x in zip(plain.tolist(), np.split(flat, np.cumsum(counts[plain])[:-1])):
            parts[i] = x
        for i in set(range(len(words))) - set(plain.tolist()):
            parts[i] = np.array(self.tok.encode(words[i], add_special_tokens=False).ids, np.int32)
            counts[i] = len(parts[i])
        return np.concatenate(parts), counts

    def keep(self, keys: np.ndarray, starts: np.ndarray, counts: np.ndarray, pool: np.ndarray, raw: np.ndarray, at: np.ndarray, size: np.ndarray) -> None:
        """Adds words with hashes not yet known, up to the bound."""
        room = CACHE_WORDS - len(self.keys)
        if room <= 0 or not len(keys):
            return
        keys, starts, counts, at, size = keys[:room], starts[:room], counts[:room], at[:room], size[:room]
        place = np.cumsum(counts) - counts + len(self.pool)
        letter = np.cumsum(size) - size + len(self.letters)
        self.pool = np.concatenate([self.pool, pool[ragged(starts.astype(np.int64), counts.astype(np.int64))]])
        self.letters = np.concatenate([self.letters, raw[ragged(at, size)]])
        order = np.argsort(merged := np.concatenate([self.keys, keys]), kind="stable")
        self.keys = merged[order]
        self.start, self.count, self.at, self.size = (np.concatenate([x, y])[order].astype(np.int32) for x, y in ((self.start, place), (self.count, counts), (self.at, letter), (self.size, size)))

    def encode(self, raw: np.ndarray, offs: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with ``end`` behind it, and offsets."""
        data = raw.tobytes()
        words = Words(raw, offs, lower=True)
        starts, ends, per_text = words.starts, words.ends, words.per_text
        if b"<|" not in data and len(raw):
            kind = _KIND[raw]
            meet = kind[1:] * kind[:-1] == 2
            at = np.flatnonzero(meet & words.inside[1:] & words.inside[:-1]) + 1
            at = at[~np.isin(at, offs)]
            starts, ends = np.sort(np.concatenate([starts, at])), np.sort(np.concatenate([ends, at]))
            per_text = np.searchsorted(starts, offs)
        h = span_hashes(words.raw, starts, ends)
        order = np.argsort(h)
        head = np.ones(len(h), bool)
        head[1:] = h[order[1:]] != h[order[:-1]]
        first, inverse = order[head], np.empty(len(h), np.int64)
        inverse[order] = np.cumsum(head) - 1
        n_hashes = len(first)
        # a word with the hash of another one is an entry of its own
        odd = np.flatnonzero(~equal_spans(words.raw, starts, ends, words.raw, starts[first[inverse]], ends[first[inverse]]))
        first, inverse[odd] = np.concatenate([first, odd]), n_hashes + np.arange(len(odd))
        at, size, keys = starts[first], (ends - starts)[first], h[first]
        place = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        hit = self.keys[place] == keys if len(self.keys) else np.zeros(len(keys), bool)
        fresh = np.flatnonzero(~hit)
        held = np.flatnonzero(hit)
        there = self.at[place[held]].astype(np.int64)
        hit[held] = equal_spans(words.raw, at[held], at[held] + size[held], self.letters, there, there + self.size[place[held]])
        new = np.flatnonzero(~hit)
        added, counts = self.ids_of([data[a:b].decode() for a, b in zip(at[new].tolist(), (at[new] + size[new]).tolist())])
        pool = np.concatenate([self.pool, added, np.array([end], np.int32)])
        s, c = np.empty(len(first), np.int64), np.empty(len(first), np.int64)
        s[hit], c[hit] = self.start[place[hit]], self.count[place[hit]]
        s[new], c[new] = len(self.pool) + np.cumsum(counts) - counts, counts
        fresh = fresh[fresh < n_hashes]
        self.keep(keys[fresh], s[fresh], c[fresh], pool, words.raw, at[fresh], size[fresh])
        # the end of each text is one more word, which is the last entry of the pool
        last = per_text[1:] + np.arange(len(offs) - 1)
        mine = np.ones(len(h) + len(last), bool)
        mine[last] = False
        where = np.full(len(mine), len(pool) - 1, np.int64)
        count = np.ones(len(mine), np.int64)
        where[mine], count[mine] = s[inverse], c[inverse]
        total = np.concatenate([[0], np.cumsum(count)])
        return pool[ragged(where, count)], total[np.concatenate([[0], last + 1])]

    def encode_long(self, raw: np.ndarray, end: int, most: int) -> np.ndarray:
        """Ids of one text of any length with ``end`` behind it; it is read in pieces that end at white space."""
        parts, a = [], 0
        spaces = np.flatnonzero(raw == 32)
        while a < len(raw):
            i = np.searchsorted(spaces, a + most)
            # the last space before the bound, else the next one
            b = int(spaces[i - 1]) if i and spaces[i - 1] > a else int(spaces[i]) if i < len(spaces) else len(raw)
            b = len(raw) if len(raw) - a <= most else b
            parts.append(self.encode(raw[a:b], np.array([0, b - a]), end)[0][:-1])
            a = b
        return np.concatenate([*parts, np.array([end], np.int32)])


def worker_encoder(path: str) -> WordEncoder:
    """The encoder that this Python worker keeps from task to task: the tokenizer and a bounded cache (see the class)."""
    # functions travel by value, with globals of their own for each task, so what outlives a task is held by a module
    kept = sys.modules.setdefault("mnemograph_worker_encoders", types.ModuleType("mnemograph_worker_encoders")).__dict__
    if path not in kept:
        kept[path] = WordEncoder(path)
    return kept[path]


def cut_points(ids: np.ndarray, least: int = LEAST, most: int = MOST, bits: int = AVERAGE_BITS) -> np.ndarray:
    """Positions after which the rolling hash over the last 16 ids lets a chunk end."""
    h = _GEAR[ids & 0xFFFF].copy()
    for k in (1, 2, 4, 8):
        h[k:] = h[k:] + (h[:-k] << np.uint32(k))
    return np.flatnonzero((h >> np.uint32(32 - bits)) == 0) + 1


def chunk_ends(cuts: list[int], size: int, least: int = LEAST, most: int = MOST) -> list[int]:
    """Ends of the chunks of a stream of ``size`` ids, given where the hash would cut."""
    out, at = [], 0
    for c in [*cuts, size]:
        while c - at > most:
            at += most
            out.append(at)
        if c - at >= least and c < size:
            at = c
            out.append(at)
    if size > at:
        out.append(size)
    return out


def merkle_root(digests: list[bytes]) -> bytes:
    """Root of the binary tree over chunk digests; an odd node moves up."""
    level = digests or [b""]
    while len(level) > 1:
        level = [hashlib.blake2b(b"".join(level[i : i + 2]), digest_size=16).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


_PARTS = pa.schema([("kind", pa.int32()), ("place", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("digest", pa.binary()), ("data", pa.binary()), ("counts", pa.binary())])
_SPARK_PARTS = "kind int, place long, doc_id long, n_tokens long, digest binary, data binary, counts binary"


def _encode(path: str, end: int, width: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seen = worker_encoder(path), set()
        for batch in batches:
            for b in blocks(batch, most=ENCODE_BYTES):
                text, offs = text_bytes(b.column("text"))
                if len(text) > 2 * ENCODE_BYTES:
                    ids = encoder.encode_long(text, end, ENCODE_BYTES)
                    at = np.array([0, len(ids)])
                else:
                    ids, at = encoder.encode(text, offs, end)
                raw = memoryview(ids.astype(width).view(np.uint8))
                size = np.dtype(width).itemsize
                rows = []
                for doc_id, x, y in zip(b.column("doc_id").cast(pa.int64()).to_pylist(), at[:-1].tolist(), at[1:].tolist()):
                    digests, counts, was = [], [], 0
                    for to in chunk_ends(cut_points(ids[x:y]).tolist(), y - x):
                        data = raw[size * (x + was) : size * (x + to)]
                        d = hashlib.blake2b(data, digest_size=16).digest()
                        digests.append(d)
                        counts.append(to - was)
                        was = to
                        if d not in seen:
                            # a repeated chunk of this task goes out once; beyond the bound it goes again, and the store drops it
                            if len(seen) < 100_000:
                                seen.add(d)
                            rows.append((0, int.from_bytes(d[:8], "little", signed=True), None, None, d, data.tobytes(), None))
                    rows.append((1, doc_id, doc_id, y - x, merkle_root(digests), b"".join(digests), np.array(counts, "<u4").tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), _PARTS)], schema=_PARTS)

    return run


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Drops the chunks that this part of the digests' range has had already."""
    seen: set[bytes] = set()
    for b in batches:
        keep = []
        for kind, d in zip(b.column("kind").to_pylist(), b.column("digest").to_pylist()):
            keep.append(kind == 1 or d not in seen)
            if kind == 0:
                seen.add(d)
        yield b.filter(pa.array(keep, pa.bool_()))


def write_store(docs: DataFrame, scratch: Scratch, path: str, tokenizer: str, end: int = END) -> None:
    """Writes the ids of ``docs`` (doc_id, text) as a store in ``path``."""
    spark = docs.sparkSession
    from tokenizers import Tokenizer

    largest = max(Tokenizer.from_file(tokenizer).get_vocab_size(), end)
    width = "<u2" if largest < 1 << 16 else "<u4"
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = picked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    spread = max(12, math.ceil(size / 16_000_000))
    parts = picked.mapInArrow(_encode(tokenizer, end, width), _SPARK_PARTS)
    split = parts.repartition(spread, F.xxhash64("place", "digest")).mapInArrow(_once, _SPARK_PARTS)
    split.write.partitionBy("kind").option("compression", "zstd").parquet(f"{path}/chunks")
    recipes = spark.read.schema(_SPARK_PARTS).parquet(f"{path}/chunks").where("kind = 1")
    ordered = recipes.select("doc_id", "n_tokens", F.col("digest").alias("root"), F.col("data").alias("digests"), "counts")
    ordered = ordered.repartitionByRange(max(4, spread // 4), F.col("doc_id").asc_nulls_first(), "root").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "root")
    ordered = scratch.keep(ordered.withColumn("part", F.spark_partition_id()), "ordered")
    sums = ordered.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    base = sums.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy(F.col("doc_id").asc_nulls_first(), "root").rowsBetween(Window.unboundedPreceding, -1)
    # as many rows as partitions, so small at any size
    started = ordered.withColumn("upto", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(F.broadcast(base), "part")
    started.select("doc_id", (F.col("base") + F.col("upto")).alias("start"), "n_tokens", "root", "digests", "counts").write.parquet(f"{path}/manifest")
    scratch.drop(ordered)
    spark.range(1).select(F.lit(tokenizer.rsplit("/", 1)[-1]).alias("tokenizer"), F.lit(width).alias("width"), F.lit(end).alias("end_id")).write.parquet(f"{path}/format")


def _recipes(spark: SparkSession, path: str) -> DataFrame:
    """start, seq, digest, n, after (ids of the document behind this chunk), for each chunk of each document."""
    schema = pa.schema([("start", pa.int64()), ("seq", pa.int32()), ("digest", pa.binary()), ("n", pa.int64()), ("after", pa.int64()), ("sound", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for start, total, root, digests, counts in zip(*(b.column(c).to_pylist() for c in ("start", "n_tokens", "root", "digests", "counts"))):
                parts = [digests[i : i + 16] for i in range(0, len(digests), 16)]
                n = np.frombuffer(counts, "<u4").astype(np.int64)
                after = n.sum() - np.cumsum(n)
                sound = merkle_root(parts) == root and n.sum() == total
                rows += [(start, i, d, a, r, sound) for i, (d, a, r) in enumerate(zip(parts, n.tolist(), after.tolist()))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)

    manifest = spark.read.parquet(f"{path}/manifest").select("start", "n_tokens", "root", "digests", "counts")
    return manifest.mapInArrow(run, "start long, seq int, digest binary, n long, after long, sound boolean")


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_SPARK_PARTS).parquet(f"{path}/chunks").where("kind = 0").select("digest", "data")


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, ids (array) of each document of a store."""
    width = spark.read.parquet(f"{path}/format").first()["width"]
    unpack = F.pandas_udf(lambda s: s.map(lambda x: np.frombuffer(x, width).astype(np.int32)), "array<int>")
    pieces = _recipes(spark, path).join(_chunks(spark, path), "digest")
    whole = pieces.groupBy("start").agg(F.array_sort(F.collect_list(F.struct("seq", "data"))).alias("p"))
    ids = unpack(F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["data"])))
    return spark.read.parquet(f"{path}/manifest").select("doc_id", "start").join(whole.select("start", ids.alias("ids")), "start")


def _shift_tables() -> list[np.ndarray]:
    """For each k, four byte tables that move a CRC-32 past 2^k zero bytes."""
    one = np.arange(32, dtype=np.uint64)
    poly = 0xEDB88320

    def byte_step(c: int) -> int:
        for _ in range(8):
            c = (c >> 1) ^ (poly if c & 1 else 0)
        return c

    def apply(m: list[int], c: int) -> int:
        out = 0
        for i in range(32):
            if c >> i & 1:
                out ^= m[i]
        return out

    columns, out = [byte_step(1 << int(i)) for i in one], []
    for _ in range(44):
        out.append(np.array([[apply(columns, v << (8 * j)) for v in range(256)] for j in range(4)], np.uint32))
        columns = [apply(columns, c) for c in columns]
    return out


def shifted_crc(crc: np.ndarray, zeros: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
    """CRC-32 values moved past so many zero bytes: crc(a + b) = shifted(crc(a), len(b)) ^ crc(b)."""
    crc, zeros = crc.astype(np.uint32).copy(), zeros.astype(np.int64)
    for k, t in enumerate(tables):
        on = (zeros >> k) & 1 == 1
        c = crc[on]
        crc[on] = t[0][c & 255] ^ t[1][(c >> 8) & 255] ^ t[2][(c >> 16) & 255] ^ t[3][c >> 24]
    return crc


def verify(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, verified for each document, from the stored files."""
    width = spark.read.parquet(f"{path}/format").first()["width"]
    got = pa.schema([("digest", pa.binary()), ("crc", pa.int64()), ("count", pa.int64()), ("whole", pa.bool_())])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for d, data in zip(b.column("digest").to_pylist(), b.column("data")):
                buf = data.as_buffer()
                ids = np.frombuffer(buf, width)
                rows.append((d, zlib.crc32(ids.astype("<u4").tobytes()), len(ids), hashlib.blake2b(buf, digest_size=16).digest() == d))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), got)], schema=got)

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _shift_tables()
        for b in batches:
            crc = shifted_crc(np.array(b.column("crc")), 4 * np.array(b.column("after")), tables)
            yield pa.RecordBatch.from_arrays([b.column("start"), pa.array(crc.astype(np.int64)), b.column("n"), b.column("good")], ["start", "crc", "n", "good"])

    chunks = _chunks(spark, path).mapInArrow(sums, "digest binary, crc long, count long, whole boolean")
    joined = _recipes(spark, path).join(chunks, "digest").select("start", "crc", "after", "n", (F.col("sound") & F.col("whole") & (F.col("n") == F.col("count"))).alias("good"))
    whole = joined.mapInArrow(move, "start long, crc long, n long, good boolean").groupBy("start").agg(F.bit_xor("crc").alias("ids_crc32"), F.sum("n").alias("n_tokens"), F.bool_and("good").alias("verified"))
    return spark.read.parquet(f"{path}/manifest").select("doc_id", "start").join(whole, "start").select("doc_id", "start", "n_tokens", "ids_crc32", "verified")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    scratch = Scratch(spark, "tokens")
    path = scratch.path("store")
    write_store(table(spark, sf_dir, "documents").select("doc_id", "text"), scratch, path, public_tokenizers.path("word_bpe_49k.json"))
    out = scratch.keep(verify(spark, path), "verified")
    scratch.drop(path)
    return out
