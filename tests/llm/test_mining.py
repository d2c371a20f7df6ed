"""Hard negatives, personal data and collocations against plain versions of themselves."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from mnemograph.llm import collocations, hard_negatives, pii
from mnemograph.llm.queries import QUERIES, SQL
from mnemograph.llm.shared import Scratch

SMALL = "/root/testdata/sf0.001"
LOWER = {i: i + 32 for i in range(65, 91)}


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op13_collocations"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    df, rel = QUERIES[name](spark, SMALL), con.sql(SQL[name])
    assert sorted(rel.columns) == sorted(df.columns)
    rows = [tuple(r) for r in df.collect()]
    assert rows and Counter(rows) == Counter(tuple(r[rel.columns.index(c)] for c in df.columns) for r in rel.fetchall())


# ---------------------------------------------------------------- hard negatives


def vectors():
    rng = random.Random(3)
    rows = [(i, i % 4, [rng.gauss(0, 1) + (i % 4) * (d == 0) for d in range(12)]) for i in range(420)]
    rows += [(500 + i, 1, [1.0] * 12) for i in range(30)] + [(600, 2, [0.0] * 12), (700, 2, [1.0] * 12), (800, 3, [-2.0] * 12)]
    rows += [(900, None, [1.0] * 12), (1000, 1, None), (1100, 1, [1.0] * 11 + [None]), (1200, 1, [math.nan] * 12), (1300, 1, [math.inf] * 12), (None, 1, [1.0] * 12)]
    rows += [(1400, 1, [1.0, 2.0, 3.0]), (1401, 1, [1.0, 2.0, 2.0]), (1402, 2, [0.5, 1.0, 1.0]), (1500, 1, []), (1600, 9, [3.0] * 12)]
    return [*rows, rows[7], rows[7], (7, 0, [9.0] * 12)]


def plain_negatives(rows, positives=5, negatives=10):
    one = {}
    for i, label, v in rows:
        if i is None or label is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        row = (label, [math.floor(256 * x) for x in v])
        one[i] = min(one.get(i, row), row)
    out = []
    for a in (i for i in one if i % 100 == 0):
        dot = {i: sum(x * y for x, y in zip(one[a][1], v)) for i, (_, v) in one.items() if i != a and len(v) == len(one[a][1])}
        same = sorted((-s, i) for i, s in dot.items() if one[i][0] == one[a][0])[:positives]
        for p, pid in same:
            fit = sorted((-s, i) for i, s in dot.items() if one[i][0] != one[a][0] and 30 * -p <= 100 * s <= 90 * -p)
            out += [(a, pid, k + 1, i, -p, -s) for k, (s, i) in enumerate(fit[:negatives])]
    return out


@pytest.mark.parametrize("anchors", [3, 16_384])
def test_hard_negatives(spark, monkeypatch, anchors):
    rows = vectors()
    monkeypatch.setattr(hard_negatives, "ANCHORS", anchors)
    monkeypatch.setattr(hard_negatives, "RUN", 16)
    df = spark.createDataFrame([(*r, "z", "z", "z") for r in rows], "vec_id long, label int, embedding array<float>, q string, slot string, score string").repartition(4)
    got = [tuple(r) for r in hard_negatives.mine(df).collect()]
    rounded = [(i, c, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, c, v in rows]
    assert len(got) > 100 and Counter(got) == Counter(plain_negatives(rounded))
    assert hard_negatives.mine(df.limit(0)).count() == 0
    assert hard_negatives.mine(df.where("vec_id % 100 <> 0")).count() == 0


def test_bounds_hold_and_windows_are_skipped(spark):
    rng = np.random.default_rng(1)
    centre = rng.standard_normal((6, 20)) * 4
    x = np.floor(256 * (centre[rng.integers(0, 6, 1200)] + rng.standard_normal((1200, 20)) * 0.4))
    refs = centre / np.linalg.norm(centre, axis=1, keepdims=True)
    norm = np.linalg.norm(x, axis=1)
    angle = np.arccos(np.clip(x @ refs.T / norm[:, None], -1, 1))
    for r in range(6):
        low, high = hard_negatives.row_bounds(angle[:50, r][:, None], angle[:, r][None], norm[:50, None], norm[None])
        score = hard_negatives.exact_scores(x[:50], x)
        assert (low <= score).all() and (score <= high).all()
    import pyarrow as pa

    order = np.argsort(angle.argmin(1), kind="stable")
    offs = lambda n: pa.array(np.arange(0, 1200 * n + 1, n, dtype=np.int32))
    batch = pa.RecordBatch.from_arrays(
        [pa.array(order), pa.array(order % 3), pa.ListArray.from_arrays(offs(20), pa.array(x[order].astype(np.int64).ravel())), pa.array(norm[order]), pa.ListArray.from_arrays(offs(6), pa.array(angle[order].ravel()))],
        ["vec_id", "label", "q", "norm", "angles"],
    )
    anchors = hard_negatives._Rows(batch.slice(0, 12), 20, 6)
    told = next(hard_negatives._search(anchors, None, 5, 10, stats=True)(iter([batch]))).to_pylist()[0]
    met, tested, scored = (told[c] for c in ("slot", "score", "id"))
    assert met == 12 * 1200 and scored <= tested < met


def test_scores_beyond_doubles_stay_exact():
    a, x = np.array([[2.0**30, 1.0]]), np.array([[2.0**30, 1.0], [2.0**31, -1.0]])
    assert hard_negatives.exact_scores(a, x).tolist() == [[2**60 + 1, 2**61 - 1]]


# ---------------------------------------------------------------- personal data

# The contract's patterns.
BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    out = []
    for i, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            luhn = sum(d if j % 2 == 0 else d * 2 - 9 * (d > 4) for j, d in enumerate(map(int, reversed(digits)))) % 10 == 0
            good = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".") if kind == "ip"), "card": 12 <= len(digits) <= 19 and luhn, "phone": 9 <= len(digits) <= 15}
            if good[kind]:
                out.append((m.start(), i, m.end()))
    return sorted(out)


def text_of(spans):
    return ",".join(f"{list(BASE)[k]}:{a}:{e}" for a, k, e in spans)


HARD = [
    "a@b.c", "x a@b.c_d@e.f y", "a@b.c.d@e.f", "a@@b.c", "é@b.c", "aé@b.c.é.d", "1.2.3.4.5.6.7.8", "256.1.1.1 1.1.1.1", "01.002.0003.255", "0000000000000000000001.1.1.1", "12.3.4 1.2.3", "4111 1111 1111 1111",
    "4111-1111-1111-1111-", "x4111111111111111x", "1 4111111111111111", "4111  111111111111", "+1 (988) 555-2485", "+1 (269) 555-3296 4111111111111111", "++12 345 678 901 .", "+1-2", "+1 2.3.4.5.6.7.8.9 a@b.c",
    "\U0001f600 a@b.co \U0001f600 +49 (0) 30 1234567 é 10.0.0.1", "9" * 5000, "a@" * 3000, "1 " * 3000, "+" + "1" * 3000 + "(", "a" * 20_000 + "@b.c", "q@w.e," * 500, None, "", " \n",
]


def fuzzed():
    rng = random.Random(9)
    return ["".join(rng.choice(["a", "1", "23", ".", "@", "-", "+", " ", "(", ")", "é", "\n", "4111111111111111", "a@b.c", "1.2.3.4", "+12345678901", "_"]) for _ in range(rng.randint(1, 40))) for _ in range(1500)]


def test_base_spans(spark, docs, rows, empty):
    texts = [*HARD, *fuzzed()]
    df = spark.createDataFrame([(i, t, "z", "z", "z") for i, t in enumerate(texts)], "doc_id long, text string, row string, kind string, mentions string").repartition(6)
    got = {r["doc_id"]: [tuple(s) for s in r["base"]] for r in pii.personal_data(df).collect()}
    assert got == {i: plain_spans(t) for i, t in enumerate(texts)}
    assert Counter(r["doc_id"] for r in pii.personal_data(docs).collect()) == Counter(r[0] for r in rows)
    assert pii.personal_data(empty).count() == 0


def contexts():
    """Numbers in local forms where mail addresses and cards stand otherwise, twice over, and numbers in other places."""
    rng = random.Random(4)
    mail = [f"name{i}.x@mail{i}.example.com" for i in range(6)]
    rows = [f"you can reach me at {m} during office hours {rng.random() < 2}" for m in mail] + [f"please reach me at {m} after nine" for m in mail[:5]]
    rows += ["you can reach me at jane4(at)host during office hours", "please reach me at jane4(at)host after nine"]
    rows += ["the cost is 17 euros", "reach me in 2024 or later"] * 3 + ["plain words only"]
    return rows


def plain_discovery(texts, least=4, sure=700, rounds=8):
    """Instance -> kind, by the rules of the module's docstring."""
    word = re.compile(r"[^\x20\x09-\x0D]+")
    edges, kinds = defaultdict(set), {}
    for t in texts:
        items, at = [], 0
        for m in word.finditer(t):
            hot = bool(re.search("[0-9@]", m[0]))
            if items and hot and items[-1][2] and m.start() == items[-1][1] + 1 and t[items[-1][1]] == " ":
                items[-1][1] = m.end()
            else:
                items.append([m.start(), m.end(), hot])
        for i, (a, b, hot) in enumerate(items):
            if not hot:
                continue
            raw = t[a:b]
            name = re.sub(r"[^A-Za-z0-9]*$", "", re.sub(r"^[^A-Za-z0-9+@#]*", "", raw)).lower()
            held = [k for k in range(4) if any(s[1] == k for s in plain_spans(raw))]
            if held:
                kinds[name] = min(kinds.get(name, 9), held[0])
            before, after = items[max(0, i - 2) : i], items[i + 1 : i + 3]
            stop = [j for j, x in enumerate(before) if x[2]]
            before = before[stop[-1] + 1 :] if stop else before
            after = after[: next((j for j, x in enumerate(after) if x[2]), 2)]
            l, r = [t[x:y].lower() for x, y, _ in before], [t[x:y].lower() for x, y, _ in after]
            for p in ([("L", *l)] if len(l) == 2 else []) + ([("R", *r)] if len(r) == 2 else []) + ([("M", l[-1], r[0])] if l and r else []):
                edges[p].add(name)
    look = lambda s: re.sub(r"[^\W\d_]+", "a", re.sub("[0-9]", "0", s))
    looks = {(look(i), k) for i, k in kinds.items()}
    found = {}
    for _ in range(rounds):
        trusted = {}
        for p, items in edges.items():
            for k in range(4):
                scores = [1000 if kinds.get(i) == k else found[i][1] for i in items if kinds.get(i) == k or (i not in kinds and found.get(i, (9,))[0] == k)]
                if len(scores) >= least and sum(scores) // (len(items) + 1) >= sure:
                    trusted[p, k] = sum(scores) // (len(items) + 1)
        new = {}
        for i in {i for x in edges.values() for i in x} - kinds.keys() - found.keys():
            best = []
            for k in range(4):
                s = [v for (p, q), v in trusted.items() if q == k and i in edges[p]]
                if s and (len(s) >= 2 or (look(i), k) in looks):
                    best.append((-max(s), k))
            if best:
                new[i] = (min(best)[1], -min(best)[0])
        if not new:
            break
        found |= new
    return {i: k for i, (k, _) in found.items()}


def test_contexts_find_new_identifiers(spark):
    texts = contexts()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    spans = pii.placed(Scratch(spark, "t").keep(pii.searched(df)))
    got = {r["instance"]: r["kind"] for r in pii.discover(spans, Scratch(spark, "t"))[0].collect()}
    assert got == plain_discovery(texts) == {"jane4(at)host": 0}
    for r in pii.personal_data(df).collect():
        text = texts[r["doc_id"]]
        added = [text[s["start"] : s["end"]] for s in r["spans"] if s not in r["base"]]
        assert [tuple(s) for s in r["base"]] == plain_spans(text) and set(r["base"]) <= set(r["spans"])
        assert added == (["jane4(at)host"] if "jane4" in text else [])


def test_discovery_equals_a_plain_one(spark):
    rng = random.Random(11)
    near = ["aa", "bb", "cc", "dd"]
    item = lambda: rng.choice([f"u{rng.randint(0, 30)}@m.example", f"id-{rng.randint(0, 12)}", f"({rng.randint(0, 9)}.1.1.{rng.randint(0, 9)})", str(rng.randint(0, 5)), "+1 555 123 45" + str(rng.randint(0, 3)) + "7"])
    texts = [" ".join([rng.choice(near), rng.choice(near[:2]), item(), rng.choice(near[:2]), rng.choice(near)] + [item()] * (rng.random() < 0.2)) for _ in range(260)]
    texts += [f"zz yy u{i}@m.example xx ww" for i in range(9)] + [f"zz yy id-{i} xx ww" for i in range(2)] + [f"zz yy u{i}@m.example" for i in range(5)] + ["zz yy id-0 aa", "yy id-1 xx qq zz yy id-77"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    spans = pii.placed(Scratch(spark, "t").keep(pii.searched(df)))
    for least, sure in ((4, 700), (2, 400)):
        got = {r["instance"]: r["kind"] for r in pii.discover(spans, Scratch(spark, "t"), least, sure)[0].collect()}
        assert got == plain_discovery(texts, least, sure) and got


def test_op12(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = QUERIES["op12_personal_data"](spark, SMALL).collect()
    assert len(got) == len(texts)
    for r in got:
        want = plain_spans(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(text_of(want).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in BASE] == [sum(s[1] == i for s in want) for i in range(4)]
        assert set(filter(None, text_of(want).split(","))) <= set(r["spans"].split(","))


# ---------------------------------------------------------------- collocations


def plain_collocations(rows, least, best):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, 6):
                f[lang or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        often = {p: a for p, a in counts.items() if a >= least}
        some = []
        for p, a in often.items():
            if len(p) < 2 or any(len(q) > len(p) and 100 * b >= 100 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in often.items()):
                continue
            score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            some.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(some)[:best])]
    return out


def prose():
    rng = random.Random(8)
    words = [f"w{i}" for i in range(12)] + ["é", "Über", " x", "x" * 300, "@", "THE"]
    rows = []
    for i in range(120):
        w = [rng.choice(words[: rng.choice([3, 18])]) for _ in range(rng.randint(0, 60))]
        rows.append((rng.choice(["en", "de", None, "und"]), "".join(x + rng.choice([" ", " ", " ", "\t ", ", ", "\n", "."]) for x in w)))
    return [*rows, ("en", None), ("en", ""), ("xx", " . "), ("en", "the quick fox " * 400), rows[3], rows[3]]


@pytest.mark.parametrize("group,bits,flush", [(250_000, 26, 1_000_000), (5, 4, 50), (40, 26, 200)])
def test_collocations(spark, monkeypatch, group, bits, flush):
    for k, v in (("GROUP_ROWS", group), ("FILTER_BITS", bits), ("FLUSH", flush)):
        monkeypatch.setattr(collocations, k, v)
    rows = prose()
    df = spark.createDataFrame([(*r, "z", "z", "z") for r in rows], "lang string, text string, p string, h string, n string").repartition(5)
    got = [tuple(r) for r in collocations.collocations(df, 5, 40).collect()]
    assert len(got) > 60 and sorted(got) == sorted(plain_collocations(rows, 5, 40))
    assert collocations.collocations(df.limit(0), 5, 40).count() == 0


def test_products_beyond_64_bits(spark):
    phrases = spark.createDataFrame([("en", [1], 10**15 + 7), ("en", [2], 10**15 + 9), ("en", [1, 2], 10**15 - 3)], "lang string, p array<long>, a long")
    r = collocations.scored(phrases, spark.createDataFrame([("en", 10**18 + 1)], "lang string, n long")).first()
    assert r["score"] == 1000 * (10**15 - 3) * (10**18 + 1) // ((10**15 + 7) * (10**15 + 9))


def test_clashing_hashes_take_another_seed(spark, monkeypatch):
    plain = collocations.Pieces.__init__

    def clashing(self, raw, offs, langs, keys, seed):
        plain(self, raw, offs, langs, keys, seed)
        if seed == 0:
            self.hash[:] = 1

    monkeypatch.setattr(collocations.Pieces, "__init__", clashing)
    rows = prose()
    df = spark.createDataFrame(rows, "lang string, text string")
    assert sorted(tuple(r) for r in collocations.collocations(df, 5, 40).collect()) == sorted(plain_collocations(rows, 5, 40))


def test_three_way_quicksort():
    rng = np.random.default_rng(2)
    keys = [rng.integers(0, 4, 500).astype(np.uint64) for _ in range(4)]
    weight = rng.integers(1, 9, 500)
    got = {tuple(int(k[i]) for k in keys[:d]): w for i, d, w in collocations.frequent_prefixes(keys, weight, 30)}
    want = Counter()
    for i in range(500):
        for d in range(1, 5):
            p = tuple(int(k[i]) for k in keys[:d])
            if 0 in p:
                break
            want[p] += int(weight[i])
    assert got == {p: w for p, w in want.items() if w >= 30}
    assert collocations.frequent_prefixes([k[:0] for k in keys], weight[:0], 1) == []


def test_second_hashes_tell_spans_apart():
    raw = np.frombuffer(b"abcabc" + b"a" * 600 + b"b" + b"a" * 600 + b"c", np.uint8)
    starts, ends = np.array([0, 3, 0, 6, 607]), np.array([3, 6, 2, 607, 1208])
    h = collocations.second_hashes(raw, starts, ends)
    assert h[0] == h[1] and len(set(h.tolist())) == 4


def test_recall_of_columns(spark):
    assert dict(QUERIES["op13_collocations"](spark, SMALL).dtypes) == {"lang": "string", "rank": "bigint", "phrase": "string", **dict.fromkeys(("a", "l", "r", "n", "score"), "bigint")}
    kinds = dict(QUERIES["op11_hard_negatives"](spark, SMALL).dtypes)
    assert kinds.pop("rank") == "int" and set(kinds.values()) == {"bigint"}
