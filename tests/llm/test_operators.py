"""Each operator against a plain version of itself, on a corpus of hard cases."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations, groupby

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mnemograph.llm import cdc_dedup, jpeg_media, line_dedup, mixing, ngram_join, packing, quality, repeats, token_store, toxicity
from mnemograph.llm.shared import Scratch, components
from mnemograph.llm.textblocks import text_bytes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def words(text):
    return WORD.findall(text or "")


def bag(rows, *columns):
    return Counter(tuple(r[c] for c in columns) for r in rows)


def shingles(text):
    w = words((text or "").translate(LOWER))
    return set(zip(*[w[i:] for i in range(5)])) if len(w) >= 5 else ({tuple(w)} if w else set())


def classes(links, items):
    up = {i: i for i in items}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        up[root(a)] = root(b)
    return {i: root(i) for i in items}


def test_components(spark):
    edges = [(f"n{i:03}", f"n{i + 1:03}") for i in range(60)] + [("x", "y"), ("y", "z"), ("q", "q")]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a string, b string"), Scratch(spark, "t")).collect()}
    assert {got[f"n{i:03}"] for i in range(61)} == {"n000"} and {got[k] for k in "xyz"} == {"x"} and "q" not in got


def test_ngram_join(docs, rows, empty):
    sets = [shingles(r[1]) for r in rows]
    links = [(i, j) for i, j in combinations(range(len(rows)), 2) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    root = classes(links, range(len(rows)))
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[root[i]].append(i)
    first = {k: min((rows[i][0] for i in v if rows[i][0] is not None), default=None) for k, v in groups.items()}
    want = Counter((rows[i][0], len(sets[i]), first[root[i]]) for i in range(len(rows)))
    assert bag(ngram_join.ngram_classes(docs).collect(), "doc_id", "n_shingles", "component_id") == want
    assert ngram_join.ngram_classes(empty).count() == 0


@pytest.mark.parametrize("few, crowd, rounds, most", [(6, 3, 8, 4000), (2, 2, 1, 4000), (2, 5, 3, 10**7), (50, 200, 8, 10**7)])
def test_ngram_paths_agree(docs, monkeypatch, few, crowd, rounds, most):
    """Pairs, blocks, pivots and pieces give the same classes."""
    whole = bag(ngram_join.ngram_classes(docs).collect(), "doc_id", "component_id", "class_size")
    for name, value in (("FEW", few), ("CROWD", crowd), ("ROUNDS", rounds), ("BLOCK_BYTES", most)):
        monkeypatch.setattr(ngram_join, name, value)
    assert bag(ngram_join.ngram_classes(docs).collect(), "doc_id", "component_id", "class_size") == whole


def test_divide_skip_equals_pairs():
    rng = np.random.default_rng(1)
    base = np.arange(200)
    sets = [np.unique(np.where(rng.random(200) < p, base, rng.integers(200, 5000, 200))) for p in rng.choice([0.99, 0.9, 0.8, 0.3], 60)]
    sizes = np.array([len(s) for s in sets])
    links = ngram_join.spanning_links(sizes, np.concatenate(sets), np.concatenate([[0], np.cumsum(sizes)]))
    true = [(i, j) for i, j in combinations(range(60), 2) if 4 * len(np.intersect1d(sets[i], sets[j])) >= 3 * len(np.union1d(sets[i], sets[j]))]
    same = lambda ls: Counter(frozenset(k for k, r in classes(ls, range(60)).items() if r == x) for x in set(classes(ls, range(60)).values()))
    assert same(links) == same(true) and len(links) <= 59


def test_token_store(spark, docs, rows, empty):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public.path("word_bpe_49k.json"))
    hard = ["it's 12,5%! don't~ <|endoftext|>x", "a~b ~ c", "ﬁne… “quoted”, ÀB≠c", "<|", "A1b2C3 x_y-z"]
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(900 + i, t) for i, t in enumerate(hard)], "doc_id long, text string"))
    scratch = Scratch(spark, "t")
    path = scratch.path("store")
    token_store.write_store(both, scratch, path, public.path("word_bpe_49k.json"))
    ids = lambda t: tok.encode(t or "", add_special_tokens=False).ids + [2]
    every = [(r[0], ids(r[1])) for r in rows] + [(900 + i, ids(t)) for i, t in enumerate(hard)]
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    got = token_store.verify(spark, path).collect()
    assert all(r["verified"] for r in got)
    assert bag(got, "doc_id", "n_tokens", "ids_crc32") == Counter((d, len(x), crc(x)) for d, x in every)
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    order = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"]) if r["doc_id"] is not None]
    assert order == sorted(order)
    read = {r["doc_id"]: list(r["ids"]) for r in token_store.read_store(spark, path).collect()}
    assert all(read[d] == x for d, x in every if d is not None)
    chunks = spark.read.parquet(f"{path}/chunks").where("kind = 0")
    assert chunks.count() == chunks.select("digest").distinct().count()
    none = scratch.path("none")
    token_store.write_store(empty, scratch, none, public.path("word_bpe_49k.json"))
    assert token_store.verify(spark, none).count() == 0


def test_crc_shift():
    a, b = b"some bytes", b"and some more"
    got = token_store.shifted_crc(np.array([zlib.crc32(a)]), np.array([len(b)]), token_store._shift_tables())
    assert int(got[0]) ^ zlib.crc32(b) == zlib.crc32(a + b)


def test_mix(docs, rows, empty):
    got = mixing.mix(docs).collect()
    sizes = [len(words(r[1])) for r in rows]
    assert bag(got, "doc_id", "size") == Counter((r[0], n) for r, n in zip(rows, sizes))
    by = Counter()
    for r, n in zip(rows, sizes):
        by[r[3]] += n
    names = sorted((s for s in by if s is not None), key=lambda s: s.encode()) + [s for s in by if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    free, left, target = set(by), float(sum(by.values())), {}
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * by[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3.0 * by[s]
            left -= target[s]
        free -= over
    source = defaultdict(set)
    for r in rows:
        source[r[0]].add(r[3])
    assert all(any(abs(g["target"] - target[s]) < 1e-6 and g["source_size"] == by[s] for s in source[g["doc_id"]]) for g in got)
    taken = defaultdict(int)
    for g in got:
        taken[g["target"]] += g["taken"]
        assert 0 <= g["taken"] <= 3 * g["size"]
    for t, n in taken.items():
        assert abs(n - sum(v for v in target.values() if abs(v - t) < 1e-6)) <= 2
    again = mixing.mix(docs.repartition(3)).collect()
    assert bag(again, "doc_id", "size", "taken") == bag(got, "doc_id", "size", "taken")
    assert mixing.mix(empty).count() == 0


def plain_schedule(quotas, slots):
    """slot of each (source, rank), from golden-ratio points one by one; quotas: source -> blocks, in order."""
    scale, at, out = 1 << 31, 0, {}
    spans = []
    for source, q in quotas.items():
        spans.append((at * scale // slots, (at + q) * scale // slots, source))
        at += q
    seen = Counter()
    for i in range(slots):
        point = i * mixing._GOLDEN % scale
        source = next(s for lo, hi, s in spans if lo <= point < hi)
        if seen[source] < quotas[source]:
            out[source, seen[source]] = i
        seen[source] += 1
    for source, q in quotas.items():
        for rank in range(min(q, seen[source]), q):
            out[source, rank] = slots + rank
    return out


def test_mix_follows_the_schedule(docs):
    got = [r for r in mixing.mix(docs).collect()]
    words = {r["source"]: round(r["target"]) for r in got}
    order = sorted((s for s in words if s is not None), key=lambda s: s.encode()) + [s for s in words if s is None]
    quotas = {s: -(-words[s] // mixing.BLOCK) for s in order if words[s]}
    slot = plain_schedule(quotas, sum(quotas.values()))
    for r in got:
        begins = [r["start"] + t * r["source_size"] for t in range(3)] if r["size"] else []
        want = [slot[r["source"], b // mixing.BLOCK] if b < words[r["source"]] else None for b in begins]
        assert list(r["slots"] or []) == (want if any(w is not None for w in want) else [])
        assert r["first_slot"] == min((w for w in want if w is not None), default=None)
    # the golden ratio deals no source its blocks in a row
    assert [s for (s, _), i in sorted(slot.items(), key=lambda x: x[1])][: len(quotas)] != [order[0]] * len(quotas)


def test_mixed_rows(spark, docs, rows):
    names = docs.columns
    got = mixing.mixed(docs)
    assert got.columns == names
    got = [tuple(r) for r in got.collect()]
    want = Counter()
    for r in mixing.mix(docs).collect():
        want[r["doc_id"], r["size"]] += int((2 * r["taken"] + r["size"]) / (2 * max(r["size"], 1)))
    assert Counter((r[0], len(words(r[1]))) for r in got) == +want
    assert set(got) <= set(rows)
    # three equal rows share what they get, and rows that differ in another column stay themselves
    same = spark.createDataFrame([(1, "a b c", "x", i) for i in range(3)] + [(2, "d e", "y", 9)], "doc_id long, text string, source string, other long")
    taken = Counter(r["other"] for r in mixing.mixed(same).where("doc_id = 1").collect())
    assert max(taken.values()) - min(taken.get(i, 0) for i in range(3)) <= 1
    assert [tuple(r) for r in mixing.mixed(docs).collect()] == got  # in order, too


def test_schedule_is_even(spark):
    quotas = spark.createDataFrame([("a", 500), ("b", 300), (None, 200)], "source string, quota long")
    slots = mixing.schedule(quotas, 1000).orderBy("slot").collect()
    assert Counter(s["source"] for s in slots) == {"a": 500, "b": 300, None: 200}
    for s in ("a", "b", None):
        assert sorted(x["rank"] for x in slots if x["source"] == s) == list(range({"a": 500, "b": 300, None: 200}[s]))
    for lo in range(0, 900, 100):
        assert abs(sum(s["source"] == "a" for s in slots[lo : lo + 100]) - 50) <= 4


def test_quality(docs, rows, empty):
    def plain(text):
        w = words(text)
        grams = Counter(zip(w, w[1:], w[2:]))
        repeated = {i + j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(3)}
        seen, dups = set(), 0
        for line in (text or "").split("\n"):
            dups += bool(words(line)) and line in seen
            seen.add(line)
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dups, len(repeated)

    book = quality.verdicts(quality.apply_policy(quality.write_ledger(docs, Scratch(docs.sparkSession, "t"))))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    got = book.select("doc_id", *names, "failures", "kept", *[f"kept_{v}" for v in quality.POLICIES]).collect()
    for version, bits in quality.POLICIES.items():
        assert all(r[f"kept_{version}"] == (r["failures"] & bits == 0) for r in got)
    assert bag(got, "doc_id", *names) == Counter((r[0], *plain(r[1])) for r in rows)
    assert all(r["kept"] == (r["failures"] == 0) for r in got)
    failed = {r["rule"]: r["failed"] for r in quality.ablation(book).collect()}
    assert failed["too_few_words"] == sum(r["n_words"] < 50 for r in got)
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in got)
    assert quality.keep_good(empty).count() == 0


def test_quality_counts_letters_of_every_script(spark, docs, rows):
    def cased(text):
        letters = [c for c in text or "" if c.isalpha()]
        return sum(c.isupper() for c in letters), len(letters)

    book = quality.ledger(quality.measure(docs))
    assert bag(book.select("row.doc_id", "n_upper", "n_letters").collect(), "doc_id", "n_upper", "n_letters") == Counter((r[0], *cased(r[1])) for r in rows)
    # words that differ, in scripts with and without case, with two acronyms
    scripts = {"cyrillic": "абвгдежзик", "greek": "αβγδεζηθικ", "arabic": "ابتثجحخدذر", "han": "天地玄黃宇宙洪荒日月", "gothic": "𐌰𐌱𐌲𐌳𐌴𐌵𐌶𐌷𐌸𐌹"}
    plain = {name: " ".join(a + b + a for a in s for b in s) for name, s in scripts.items()}
    texts = {name: f"{t} NATO {t[::-1]} USB" for name, t in plain.items()} | {f"{k} capitals": plain[k].upper() for k in ("cyrillic", "greek")}
    got = quality.ledger(quality.measure(spark.createDataFrame(list(texts.items()), "name string, text string"))).select("row.*", "n_upper", "n_letters", "failures").collect()
    assert all((r["n_upper"], r["n_letters"]) == cased(r["text"]) for r in got)
    assert {r["name"] for r in got if r["failures"] & quality.BIT["capitals"]} == {"cyrillic capitals", "greek capitals"}
    kept = {r["name"] for r in quality.keep_good(spark.createDataFrame(list(texts.items()), "name string, text string")).collect()}
    assert kept == set(scripts)


def test_packing(docs, rows, empty):
    got = packing.pack(docs, 4, 512).collect()
    assert bag(got, "doc_id", "length") == Counter((r[0], len(words(r[1]))) for r in rows)
    batches = defaultdict(list)
    for r in got:
        assert r["padding"] == r["bucket_length"] - r["length"] >= 0
        batches[r["batch_id"]].append(r)
    for members in batches.values():
        assert len({r["bucket"] for r in members}) == 1 and sorted(r["slot"] for r in members) == list(range(len(members)))
        assert len(members) == 1 or len(members) * members[0]["bucket_length"] <= 512
    assert packing.pack(empty).count() == 0


def test_boundaries_are_optimal():
    rng = np.random.default_rng(3)
    upper, count = np.cumsum(rng.integers(1, 9, 9)), rng.integers(1, 20, 9)
    cost = lambda ends: sum(c * min(e for e in ends if e >= u) for u, c in zip(upper, count))
    best = min(cost([*pick, upper[-1]]) for k in range(3) for pick in combinations(upper[:-1], k))
    assert cost(packing.boundaries(upper, count, 3)) == best
    # long and many lengths, against the plain program
    upper, count = np.sort(rng.choice(200_000, 300, replace=False)), rng.integers(1, 1000, 300)
    total = np.concatenate([[0], np.cumsum(count)])
    least = np.full(301, np.inf)
    least[0] = 0
    for _ in range(7):
        least = np.array([np.inf] + [min(least[i] + upper[j - 1] * (total[j] - total[i]) for i in range(j)) for j in range(1, 301)])
    ends = packing.boundaries(upper, count, 7)
    assert len(ends) <= 7 and sum(int(c) * min(e for e in ends if e >= u) for u, c in zip(upper, count)) == least[300]


def test_jpeg(docs, rows, empty):
    got = jpeg_media.image_features(jpeg_media.store_media(docs, Scratch(docs.sparkSession, "t"))).collect()

    def plain(text):
        b = (text or "").encode()
        p = b + b" " * ((-len(b)) % 192 or (0 if b else 192))
        return len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:])

    assert bag(got, "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32") == Counter((r[0], *plain(r[1])) for r in rows)
    assert jpeg_media.image_features(jpeg_media.payload_images(empty)).count() == 0


def test_jpeg_bit_by_bit():
    """A reader that goes bit by bit sees the same samples."""
    payload = np.random.default_rng(0).integers(0, 256, 192 * 3).astype(np.uint8)
    media, offs = jpeg_media.encode_payloads(payload, np.array([0, len(payload)]))
    data = media.tobytes()
    f = jpeg_media.Frame(data, 0)
    table = {(c, n): s for s, (c, n) in jpeg_media.codes(jpeg_media.DC_BITS, jpeg_media.DC_SYMBOLS).items()}
    out = []
    for part in re.split(rb"\xff[\xd0-\xd7]", data[f.scan : -2]):
        bits, at, last = "".join(f"{x:08b}" for x in part.replace(b"\xff\0", b"\xff")), 0, 0
        for _ in range(192):
            n = 1
            while (int(bits[at : at + n], 2), n) not in table:
                n += 1
            size = table[int(bits[at : at + n], 2), n]
            at += n
            v = int(bits[at : at + size] or "0", 2)
            last += v - (1 << size) + 1 if size and v < 1 << (size - 1) else v
            at += size + 1
            out.append(last + 128)
    assert out == payload.tolist()
    assert list(jpeg_media.split_images(data, 0, len(data)))[0][0].width == 1536
    assert len(offs) == 2


def foreign_jpeg(rng, width, height, factors, interval):
    """A baseline image with random coefficients: its bytes, and the luminance DC values by block row and column.

    factors: sampling (h, v) of each component. Code tables and quantisers are not those of the operator.
    """
    dc_bits, dc_symbols = (0, 0, 5, 3, 2, 1, 1, 0, 0, 0, 0, 0, 0, 0, 0, 0), (4, 0, 2, 1, 3, 7, 5, 6, 9, 8, 10, 11)
    ac_symbols = (0, 1, 2, 0x11, 0xF0, 3, 0x21, 0x43, 5)
    ac_bits = (0, 1, 3, 3, 2, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0)
    dc, ac = jpeg_media.codes(dc_bits, dc_symbols), jpeg_media.codes(ac_bits, ac_symbols)
    seg = lambda m, body: bytes([0xFF, m]) + (len(body) + 2).to_bytes(2, "big") + body
    quant = {0: 11, 1: 5}
    h, v = max(f[0] for f in factors), max(f[1] for f in factors)
    across, down = -(-width // (8 * h)), -(-height // (8 * v))
    lh, lv = factors[0]
    luma = np.zeros((down * lv, across * lh), int)
    head = b"\xff\xd8" + seg(0xFE, b"another encoder") + seg(0xDB, b"".join(bytes([i]) + bytes([q] * 64) for i, q in quant.items()))
    head += seg(0xC0, b"\x08" + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([len(factors)]) + b"".join(bytes([i + 1, 16 * a + b, min(i, 1)]) for i, (a, b) in enumerate(factors)))
    head += seg(0xC4, b"\x01" + bytes(dc_bits) + bytes(dc_symbols) + b"\x11" + bytes(ac_bits) + bytes(ac_symbols))
    head += seg(0xDD, interval.to_bytes(2, "big")) if interval else b""
    head += seg(0xDA, bytes([len(factors)]) + b"".join(bytes([i + 1, 0x11]) for i in range(len(factors))) + b"\0\x3f\0")
    put = lambda table, s: f"{table[s][0]:0{table[s][1]}b}"
    magnitude = lambda x, n: f"{x if x > 0 else x + (1 << n) - 1:0{n}b}" if n else ""

    def flush(bits):
        bits += "1" * (-len(bits) % 8)
        return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\0")

    out, bits, last = b"", "", [0] * len(factors)
    for m in range(across * down):
        if interval and m and m % interval == 0:
            out, bits, last = out + flush(bits) + bytes([0xFF, 0xD0 + (m // interval - 1) % 8]), "", [0] * len(factors)
        for i, (a, b) in enumerate(factors if len(factors) > 1 else [(1, 1)]):
            for y in range(b):
                for x in range(a):
                    value = int(rng.integers(-90, 90))
                    diff, last[i] = value - last[i], value
                    n = abs(diff).bit_length()
                    bits += put(dc, n) + magnitude(diff, n)
                    k = 1
                    while k < 64 and rng.random() < 0.6:
                        s = ac_symbols[int(rng.integers(1, len(ac_symbols)))]
                        if k + (s >> 4) > 63:
                            break
                        bits += put(ac, s) + (f"{int(rng.integers(0, 1 << (s & 15))):0{s & 15}b}" if s & 15 else "")
                        k += (s >> 4) + 1
                    bits += put(ac, 0) if k < 64 else ""
                    if i == 0:
                        luma[(m // across) * b + y, (m % across) * a + x] = value
    return head + out + flush(bits) + b"\xff\xd9", luma[: -(-height * lv // (8 * v)), : -(-width * lh // (8 * h))], quant[0]


@pytest.mark.parametrize("factors, interval", [([(1, 1)], 0), ([(1, 1)], 3), ([(2, 2), (1, 1), (1, 1)], 0), ([(2, 1), (1, 1), (1, 1)], 2), ([(1, 1), (1, 1), (1, 1)], 5)])
def test_images_of_another_encoder(factors, interval):
    """Three components, sampling factors, AC coefficients, with and without restart intervals, sizes that end inside a block."""
    rng = np.random.default_rng(len(factors) * 10 + interval)
    data, frames, ends, want, at = b"", [], [], [], 0
    for width, height in ((61, 45), (8, 8), (130, 17)):
        image, luma, q = foreign_jpeg(rng, width, height, factors, interval)
        data += image
        want.append(np.clip((luma * q + 4 >> 3) + 128, 0, 255))
    for f, end in jpeg_media.split_images(data, 0, len(data)):
        frames.append(f)
        ends.append(end)
    got = jpeg_media.thumbnails(np.frombuffer(data, np.uint8), frames, ends)
    assert all(a.shape == b.shape and (a == b).all() for a, b in zip(got, want)) and len(got) == 3


def test_damaged_images_give_nulls(spark):
    media = spark.createDataFrame([(1, 3, b"abc"), (2, 0, b""), (3, 1, b"\xff\xd8\xff")], "doc_id long, n_bytes long, media binary")
    got = {r["doc_id"]: r["payload_bytes"] for r in jpeg_media.image_features(media).collect()}
    assert got[1] is None and got[3] is None


def test_toxicity(spark, docs, rows, empty):
    rng = np.random.default_rng(4)
    plain = "the of and to in is that for with as on by from at an be this which or are".split()
    texts, labels = [], []
    for i in range(600):
        w = [plain[j] for j in rng.integers(0, len(plain), 60)]
        bad = int(i % 4 == 0)
        if bad:
            for _ in range(4):
                w[rng.integers(0, 60)] = ("idiot", "m0r0n", "stupid", "verabschlim" + plain[rng.integers(0, 9)])[rng.integers(0, 4)]
        texts.append((i, " ".join(w)))
        labels.append((i, bad))
    d, lab = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(d, lab, Scratch(spark, "t"))
    truth = dict(labels)
    held = [r for r in model.score(d).collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert sum((r["score"] >= 0.5) == (truth[r["doc_id"]] == 1) for r in held) >= 0.95 * len(held) > 0
    scored = model.score(docs).collect()
    assert bag(scored, "doc_id") == Counter((r[0],) for r in rows) and all(0 <= r["score"] <= 1 for r in scored)
    assert model.score(empty).count() == 0
    # reruns agree, whatever the partitions, also where a doc_id has two texts
    twice = d.unionByName(d.where("doc_id < 50").selectExpr("doc_id", "concat(text, ' idiot') AS text"))
    runs = [bag(toxicity.fit(twice.repartition(n), lab, Scratch(spark, "t")).score(d.where("doc_id < 100")).collect(), "doc_id", "score") for n in (2, 5)]
    assert runs[0] == runs[1]
    only = toxicity.fit(d, lab.where("toxic = 0"), Scratch(spark, "t"))
    assert {r["score"] for r in only.score(d).collect()} == {0.0}


def test_isotonic_map(spark):
    """The map from margins to probabilities is the least-squares rising one, found by pooling neighbours."""
    from pyspark.ml.regression import IsotonicRegression

    rng = np.random.default_rng(6)
    margin = np.sort(rng.normal(size=80)).round(6)
    label = (rng.random(80) < 1 / (1 + np.exp(-2 * margin))).astype(float)
    pools: list[list[float]] = []
    for y in label:
        pools.append([y, 1])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            y2, n2 = pools.pop()
            pools[-1] = [pools[-1][0] + y2, pools[-1][1] + n2]
    want = [y / n for y, n in pools for _ in range(n)]
    data = spark.createDataFrame([(float(m), float(y)) for m, y in zip(margin, label)], "margin double, label double")
    got = IsotonicRegression(featuresCol="margin", labelCol="label", predictionCol="p").fit(data).transform(data).orderBy("margin").collect()
    assert np.allclose([r["p"] for r in got], want)


def test_features_word_by_word(rows):
    """Densities against a plain count over words."""
    texts = [r[1] for r in rows] + ["You idiot! SHUT UP, kill. your #*$ hell?", "ID10T idiots you; a trash", "été !!! Ça va??? NO NO"]
    got = toxicity.text_features(*text_bytes(pa.array(texts)), np.zeros(0, np.uint64))
    at = {n: i for i, n in enumerate(toxicity.FEATURES)}
    lists = {"insult": toxicity.INSULTS, "profanity": toxicity.PROFANITY, "threat": toxicity.THREATS, "hostile": toxicity.HOSTILITY, "second": toxicity.SECOND}
    for t, x in zip(texts, got):
        raw = (t or "").encode().translate(bytes(b + 32 if 65 <= b < 91 else b for b in range(256)))
        bare = [re.sub(rb"^[^a-z\x80-\xff]+|[^a-z\x80-\xff]+$", b"", w) for w in re.findall(rb"[^\x20\x09-\x0d]+", raw)]
        n = max(1, len(bare))
        for name, words_ in lists.items():
            known = {w.encode() for w in words_.split()}
            assert x[at[name]] == pytest.approx(1000 * sum(w in known for w in bare) / n)
        size = max(1, len(raw))
        for name, sign in (("exclaim", b"!"), ("question", b"?")):
            assert x[at[name]] == pytest.approx(1000 * raw.count(sign) / size)
        assert x[at["capitals"]] == pytest.approx(1000 * sum(65 <= b < 91 for b in (t or "").encode()) / size)
        assert x[at["log_words"]] == pytest.approx(np.log1p(len(bare)))


def test_cdc(docs, rows, empty):
    def cut(b):
        out, a = [], 0
        for i in range(15, len(b) - 1):
            h = sum(int(cdc_dedup._GEAR[b[i - j]]) << j for j in range(16)) & 0xFFFFFFFF
            if h >> 27 == 0:
                out.append(b[a : i + 1])
                a = i + 1
        out += [b[a:]] if b else []
        return [c[k : k + 512] for c in out for k in range(0, len(c), 512)]

    short = [r for r in rows if r[0] is not None and len(r[1] or "") < 5000]
    short = list({r[0]: r for r in short}.values())
    got = cdc_dedup.dedup_chunks(docs.sparkSession.createDataFrame([(r[0], r[1]) for r in short], "doc_id long, text string").repartition(3)).collect()
    pieces = {r[0]: cut((r[1] or "").encode()) for r in sorted(short, key=lambda r: r[0])}
    count, seen, want = Counter(c for v in pieces.values() for c in v), set(), {}
    for i, v in pieces.items():
        later = []
        for c in v:
            later.append(c in seen)
            seen.add(c)
        runs = lambda on: [s for s in (sum(len(v[k]) for k, _ in g) for f, g in groupby(enumerate(on), key=lambda x: x[1]) if f) if s >= cdc_dedup.LEAST_RUN]  # noqa: B023, E731
        removed = runs(later)
        want[i] = (len(v), sum(runs([count[c] > 1 for c in v])), sum(removed), len(removed))
    assert {r["doc_id"]: (r["n_chunks"], r["n_repeated"], r["n_removed"], r["n_spans"]) for r in got} == want
    text = {r[0]: (r[1] or "").encode() for r in short}
    for r in got:
        left = cdc_dedup.cut_spans(text[r["doc_id"]], [(s["start"], s["size"]) for s in r["spans"]])
        assert len(left) == r["n_bytes"] - r["n_removed"]
    assert bag(cdc_dedup.dedup_chunks(docs).collect(), "doc_id") == Counter((r[0],) for r in rows)
    assert cdc_dedup.dedup_chunks(empty).count() == 0


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            old, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, old + (x != y))
    return row[-1]


@pytest.mark.parametrize("common", [12, 1])
def test_line_dedup(docs, rows, empty, monkeypatch, common):
    monkeypatch.setattr(line_dedup, "COMMON", common)
    lines = {}
    for r in sorted({r[0]: r for r in rows if r[0] is not None}.values(), key=lambda r: r[0]):
        for no, line in enumerate((r[1] or "").split("\n")):
            if len(line) >= 24 and words(line):
                lines[r[0], no] = line
    first = {}
    for k, line in lines.items():
        first.setdefault(line, k)
    near = {b for a in first for b in first if first[a] < first[b] and abs(len(a) - len(b)) <= 2 and edit(a, b) <= 2}
    want = Counter((k[0], k[1], line in near) for k, line in lines.items() if line in near or first[line] != k)
    plain = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    got = line_dedup.dropped_lines(plain, Scratch(plain.sparkSession, "t")).collect()
    assert bag(got, "doc_id", "no", "near") == want
    assert any(r["near"] for r in got)
    out = line_dedup.dedup_lines(docs)
    assert out.columns == docs.columns and out.count() == len(rows)
    assert line_dedup.dedup_lines(empty).count() == 0


def plain_repeats(texts, span):
    count = Counter(t[i : i + span] for t in texts for i in range(len(t) - span + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - span + 1):
            if count[t[i : i + span]] > 1:
                gone[i : i + span] = True
        gone = gone[: len(t)]
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        out.append((len(t), int(gone.sum()), int((gone & ~np.append(False, gone[:-1])).sum()) if len(t) else 0, hashlib.sha256(kept).hexdigest()))
    return out


def test_repeats(docs, rows, empty, monkeypatch):
    want = Counter((r[0], *w) for r, w in zip(rows, plain_repeats([(r[1] or "").encode() for r in rows], 200)))
    names = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert bag(repeats.remove_repeats(docs).collect(), *names) == want
    # small blocks, slices and hash ranges; keys that are refined, down to whole windows
    for most, items in ((2000, 500), (250, 50)):
        monkeypatch.setattr(repeats, "INDEX_BYTES", most)
        monkeypatch.setattr(repeats, "RANGE_ITEMS", items)
        monkeypatch.setattr(repeats, "BLOCK", 3000)
        monkeypatch.setattr(repeats, "SLICE", 1000)
        assert bag(repeats.remove_repeats(docs).collect(), *names) == want
    assert repeats.remove_repeats(empty).count() == 0


def test_repeats_of_a_common_passage(spark, monkeypatch):
    """One passage between different words in most texts, a text with periods, and one beyond a block."""
    rng = np.random.default_rng(9)
    word = lambda n: "".join(chr(97 + c) for c in rng.integers(0, 26, n))
    common = word(230)
    texts = [word(int(rng.integers(0, 300))) + common[int(rng.integers(0, 9)) :] + word(int(rng.integers(0, 300))) for _ in range(300)]
    texts += ["ab" * 400, "x" * 199, "x" * 200, "y" * 201, word(500_000) + common + word(700_000)]
    monkeypatch.setattr(repeats, "INDEX_BYTES", 20_000)
    got = repeats.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)).collect()
    assert bag(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == Counter((i, *w) for i, w in enumerate(plain_repeats([t.encode() for t in texts], 200)))


def test_anchors_of_slices_are_those_of_the_whole():
    raw = np.random.default_rng(2).integers(97, 100, 20_000).astype(np.uint8)
    offs = np.array([0, 150, 150, 5000, 5300, 20_000])
    whole = repeats.window_anchors(raw, offs, 200)
    parts = repeats.window_anchors(raw, offs, 200, step=333)
    assert all((a == b).all() for a, b in zip(whole, parts))
    assert (whole[2] - whole[1] + 1).sum() == sum(max(0, n - 199) for n in np.diff(offs))


def test_match_lengths():
    strings = [b"banana bandana", b"bandana ananas", b"\0\0zz\0\0", b"na"]
    lengths = np.array([len(s) + 1 for s in strings])
    text = np.concatenate([np.append(np.frombuffer(s, np.uint8).astype(np.int16) + 1, np.int16(0)) for s in strings])
    index = repeats.RunIndex(text, lengths)
    got = index.match_lengths()
    assert index.size.sum() == len(text) and len(index.head) == len(index.size) < len(text)
    spots = [(s, i) for s in range(4) for i in range(len(strings[s]))]
    common = lambda a, b: next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
    at = np.cumsum(lengths) - lengths
    for s, i in spots:
        assert got[at[s] + i] == max(common(strings[s][i:], strings[t][j:]) for t, j in spots if (s, i) != (t, j))


def test_features_read_obfuscation():
    x = toxicity.text_features(*text_bytes(pa.array(["You are an 1d10t, m.o.r.o.n and stuuupid", None, ""])), np.zeros(0, np.uint64))
    assert x[0][toxicity.FEATURES.index("obfuscated")] > 0 and not x[1:, :10].any()


def test_pipeline(spark, docs, rows, empty, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    folder = str(tmp_path / "sf")
    docs.write.parquet(f"{folder}/documents.parquet")
    now = docs
    scratch = Scratch(spark, "t")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = scratch.keep(stage(spark, now, folder), name)
        assert now.columns == docs.columns
    assert now.where("length(trim(text)) > 0").count() > 20
    got = corpus_pipeline.run(spark, folder)
    assert got.count() == now.count()
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).count() == 0


def test_one_of_each_class_row_by_row(spark, docs, rows, empty):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    sets = [shingles(r[1]) for r in rows]
    links = [(i, j) for i, j in combinations(range(len(rows)), 2) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    groups = defaultdict(list)
    for i, root in classes(links, range(len(rows))).items():
        groups[root].append(rows[i])
    got = [tuple(r) for r in corpus_pipeline.one_of_each_class(spark, docs, "").collect()]
    left = Counter(got)
    for members in groups.values():
        inside = [r for r in members if left[r]]
        assert len(members) == 1 and inside or sum(left[r] for r in set(inside)) == 1 or not shingles(members[0][1])
        assert min((r[0] is None, r[0]) for r in members) == (inside[0][0] is None, inside[0][0])
    assert sum(not shingles(r[1]) for r in got) == sum(not s for s in sets)
    # rows that share a doc_id, but not their texts, all stay
    odd = spark.createDataFrame([(1, "one two three four five six"), (1, "seven eight nine ten eleven twelve"), (1, "seven eight nine ten eleven twelve"), (None, "thirteen words"), (None, "")], "doc_id long, text string")
    assert Counter(r["text"] for r in corpus_pipeline.one_of_each_class(spark, odd, "").collect()) == Counter({r["text"]: 1 for r in odd.collect()})


def test_near_copy_goes_through_all_stages(spark):
    """A planted near copy, whose lines no other text shares, is caught after the quality and line stages; the clean ones stay."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = np.random.default_rng(12)
    word = lambda: "".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 9)))
    texts = {i: [word() for _ in range(150)] for i in range(12)}
    texts[50] = list(texts[3])
    for at in (10, 60, 110):
        texts[50][at] = word()
    rows = [(i, " ".join(t), "en", f"s{i % 2}", 0) for i, t in texts.items()]
    now = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[:3]:
        now = stage(spark, now, "")
        assert {r["doc_id"] for r in now.select("doc_id").collect()} == (set(range(12)) if name == "near_duplicates" else set(texts))


CONTRACT = {
    "op1_ngram_jaccard_join": "doc_id bigint, n_shingles bigint, component_id bigint",
    "op2_token_store": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op3_mix_sources": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op4_quality_rules": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op5_pack_buckets": "doc_id bigint, length bigint, bucket int, bucket_length bigint",
    "op6_jpeg_media": "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string",
    "op7_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op8_gear_chunks": "doc_id bigint, n_bytes bigint, n_repeated bigint, n_removed bigint",
    "op9_line_dedup": "doc_id bigint, n_lines bigint, n_equal bigint, n_near bigint",
    "op10_repeated_strings": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
}
SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(CONTRACT))
def test_registered_queries(spark, name):
    """Each query over its whole table: columns, one row for each document, and values that a plain version gives."""
    from mnemograph.llm.queries import QUERIES

    if name.startswith("op2"):
        pytest.importorskip("public_tokenizers")
    df = QUERIES[name](spark, SMALL)
    kinds = dict(df.dtypes)
    assert all(kinds[c.split()[0]] == c.split()[1] for c in CONTRACT[name].split(", "))
    got = {r["doc_id"]: r for r in df.collect()}
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    assert got.keys() == texts.keys() and df.count() == len(texts)
    for i, text in texts.items():
        r, raw = got[i], text.encode()
        if name.startswith("op4"):
            w = words(text)
            assert r["n_words"] == len(w) and r["base_failed"] == (len(w) < 50 or 100 * r["n_repeat_words"] > 50 * len(w))
            assert not (r["kept"] and r["base_failed"])
        if name.startswith("op7"):
            assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.5)
        if name.startswith(("op6", "op8", "op10")):
            assert r["n_bytes"] == len(raw)
        if name.startswith(("op3", "op5")):
            assert r["size" if "op3" in name else "length"] == len(words(text))
    if name.startswith("op2"):
        at = 0
        for i in sorted(got):
            assert got[i]["start"] == at
            at += got[i]["n_tokens"]
    if name.startswith("op10"):
        order = sorted(texts)
        want = dict(zip(order, plain_repeats([texts[i].encode() for i in order], 200)))
        assert all(tuple(got[i][c] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")) == want[i] for i in order)


def test_op4_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    df = quality.op4(spark, SMALL)
    rel = con.sql(quality.SQL)
    assert sorted(rel.columns) == sorted(df.columns)
    assert Counter(tuple(r[rel.columns.index(c)] for c in df.columns) for r in rel.fetchall()) == Counter(tuple(r) for r in df.collect())


def test_long_texts_and_full_caches_stay_bounded(monkeypatch):
    """A text of 20 MB is encoded in pieces; the cache of a worker keeps to its bound, and other words get their ids all the same."""
    public = pytest.importorskip("public_tokenizers")
    import tracemalloc

    monkeypatch.setattr(token_store, "CACHE_WORDS", 500)
    enc = token_store.WordEncoder(public.path("word_bpe_49k.json"))
    rng = np.random.default_rng(3)
    some = ["".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(3000)]
    text = " ".join(some[i] for i in rng.integers(0, 3000, 3_000_000))
    raw = np.frombuffer(text.encode(), np.uint8)
    tracemalloc.start()
    ids = enc.encode_long(raw, 2, token_store.ENCODE_BYTES)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(enc.keys) == 500 and ids[-1] == 2 and peak < 250_000_000
    piece = " ".join(text[:200_000].split(" ")[:-1])
    want = enc.tok.encode(piece, add_special_tokens=False).ids
    assert ids[: len(want)].tolist() == want


def test_words_with_one_hash_keep_their_ids(monkeypatch):
    """Hashes only lead to words: even if all of them collide, ids are those of the words."""
    public = pytest.importorskip("public_tokenizers")
    monkeypatch.setattr(token_store, "span_hashes", lambda raw, a, b: np.zeros(len(a), np.uint64))
    enc = token_store.WordEncoder(public.path("word_bpe_49k.json"))
    for text in ("one two two three one", "three four one", "two"):
        raw = np.frombuffer(text.encode(), np.uint8)
        assert enc.encode(raw, np.array([0, len(raw)]), 2)[0].tolist() == enc.tok.encode(text, add_special_tokens=False).ids + [2]
