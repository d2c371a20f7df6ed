"""Operators on small fixtures with known results."""

import hashlib
import re
import random
from datetime import datetime, timedelta

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from mnemograph.functions import numeric as N
from mnemograph.functions import text as T
from mnemograph.operators import activation, affect, compression, dynamics, evaluation, gists, graph, ingest, placement, plasticity, retrieval, storage, versions
from mnemograph.sources import readers, sinks
from mnemograph.streaming import logs

EDGES = "source_id string, target_id string, relation_type string, weight double, confidence double"


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "x string").select(column(F.col("x")).alias("y")).first()["y"]


def test_text_functions(spark):
    assert one(spark, "a\r\nb\rc\x00d\te", T.sanitize) == "a\nb\ncd\te"
    assert one(spark, "One. Two! Three? Four", T.sentences) == ["One.", "Two!", "Three?", "Four"]
    assert one(spark, "It is 7. Then 1. Of 2", T.sentences) == ["It is 7.", "Then 1.", "Of 2"]
    assert one(spark, "pass. word=ab1", T.lead) == "pass. word=ab1"
    assert one(spark, "See [here](http://x) *now* `ok`", T.strip_markdown) == "See here now ok"
    assert one(spark, "<p>A &amp; B</p><script>no()</script>", T.html_text) == "A & B"
    r = one(spark, "Spark is a engine for data. It uses Catalyst.", T.relations)
    assert [(x["subject"], x["relation"]) for x in r][:1] == [("Spark", "is_a")]
    assert one(spark, "Python version is 3", T.proposition)["subject"] == "python version"
    assert one(spark, "no statement here", T.proposition) is None
    assert one(spark, "chha ka kha", T.syllable_digits) == "701020"
    assert one(spark, "", T.syllable_digits) == "0"
    assert one(spark, "web page", T.evidence_class) == "shabda" and one(spark, None, T.evidence_class) == "shabda"
    assert one(spark, "word " * 60, T.cut_at_word).endswith("word…")
    assert one(spark, "Title: The Thing", T.canonical_title) == "the thing"


def test_rounding_of_scaled_doubles(spark):
    """What 0.205448 adds is 0.0642025 when printed, and below the half when scaled, as SQL engines do."""
    x = 0.205448 * 0.35 / 1.12
    df = spark.createDataFrame([(x,), (-x,), (0.0009375 * 3,), (None,)], "x double")
    got = [r[0] for r in df.select(N.rounded(F.col("x"), 6)).collect()]
    assert got[:2] == [0.064202, -0.064202] and got[3] is None


def test_gists_with_tasks_without_rows(spark):
    rng = random.Random(3)
    rows = [(f"n{i:02}", "s", [rng.random(), rng.random()], "fact", i / 40, 0.5) for i in range(40)]
    nodes = spark.createDataFrame(rows, "id string, sector string, embedding array<double>, memory_type string, importance double, confidence double")
    want = sorted(map(str, gists.build(nodes.coalesce(1)).collect()))
    assert want and sorted(map(str, gists.build(nodes.repartition(16, "sector")).collect())) == want


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    got = [r[0] for r in df.select(N.cosine(F.col("a"), F.col("b"))).collect()]
    assert got[0] == pytest.approx(0.96) and got[1] == 0


def test_chunks():
    text = " ".join(f"Sentence number {i} ends here." for i in range(100))
    assert ingest.chunk_bounds(np.array([50, 60, 70, 80, 30, 30]), 150, 65) == [(0, 2), (1, 3), (3, 6)]
    chunks = ingest.pack_sentences(text, text.replace(". ", ".\0").split("\0"), 200, 40)
    assert all(len(c) <= 240 for c in chunks) and chunks[0].startswith("Sentence number 0")
    assert ingest.pack_sentences("short", ["short"]) == ["short"] and ingest.pack_sentences("  ", []) == []
    assert [len(p) for p in ingest.pack_sentences("x" * 1000, ["x" * 1000], 400, 100)] == [400, 400, 400, 100]


def test_graph(spark):
    e = spark.createDataFrame([("n0", "n1", "part", 1.0, 0.5), ("n1", "n0", "stage", 2.0, 0.4), ("n0", "n2", "part", 1.0, 1.0), ("n2", "n3", "makes", 0.5, 1.0), ("n2", "n2", "loop", 9.0, 1.0)], EDGES)
    nodes = spark.createDataFrame([(f"n{i}",) for i in range(5)], "id string")
    c = {(r["a"], r["b"]): r for r in graph.collapse(e).collect()}
    assert c["n0", "n1"]["relations"] == ["part", "stage"] and c["n0", "n1"]["relation"] == "stage" and len(c) == 3
    d = {r["id"]: (r["degree"], r["centrality"]) for r in graph.degree(nodes, e).collect()}
    assert d == {"n0": (2, 0.5), "n1": (1, 0.25), "n2": (2, 0.5), "n3": (1, 0.25), "n4": (0, 0.0)}
    sym = graph.symmetric(graph.pairs(e))
    paths = {r["id"]: r["path"] for r in graph.cheapest_paths(nodes.where("id = 'n1'"), sym, 3).collect()}
    assert paths["n3"] == ["n1", "n0", "n2", "n3"]
    comp = {r["id"]: r["component"] for r in graph.components(nodes, sym).collect()}
    assert comp == {"n0": "n0", "n1": "n0", "n2": "n0", "n3": "n0", "n4": "n4"}
    many = spark.createDataFrame([(f"a{i}", f"a{(i * 7 + 1) % 40}", "r", 1.0, 1.0) for i in range(40)], EDGES)
    degrees = lambda rows: pd.Series([x for r in rows for x in (r["a"], r["b"])]).value_counts().to_dict()
    assert degrees(graph.rewire(many, 3).collect()) == degrees(graph.pairs(many).collect())


def test_rewire_of_a_large_graph(spark):
    """From 20,000 pairs on, no pair comes twice and degrees stay."""
    rng = random.Random(6)
    ends = sorted({tuple(sorted(rng.sample(range(320), 2))) for _ in range(33_000)})
    assert len(ends) > 20_000
    e = spark.createDataFrame([(f"n{a:03}", f"n{b:03}", "r", 1.0, 1.0) for a, b in ends], EDGES)
    got = [(r["a"], r["b"]) for r in graph.rewire(e, 3).collect()]
    degrees = lambda rows: pd.Series([x for r in rows for x in r]).value_counts().to_dict()
    before = {(f"n{a:03}", f"n{b:03}") for a, b in ends}
    assert len(set(got)) == len(got) == len(before) and all(a < b for a, b in got)
    assert degrees(got) == degrees(before)
    # by chance alone, a pair that moves lands on a former one as often as such pairs fill the graph
    assert len(before & set(got)) < 0.75 * len(before)
    assert sorted(got) == sorted((r["a"], r["b"]) for r in graph.rewire(e.repartition(3), 3).collect())


def test_gists_of_a_large_sector(spark):
    """Seeds and members are those of the whole sector, above 20,000 nodes too."""
    rng = np.random.default_rng(5)
    sizes, least, most = {"big": 20_500, "small": 40, "tiny": 2, "same": 9}, 3, 12
    rows = [(f"{s}{i:05}", s, "fact", (x if s != "same" else [1.0, 1.0, 0.0]), i % 7 / 7, i % 5 / 5) for s, n in sizes.items() for i, x in enumerate(rng.integers(-9, 10, (n, 3)).astype(float).tolist())]
    df = spark.createDataFrame([*rows, ("other", "big", "concept", [99.0] * 3, 0.0, 0.0), ("none", "big", "fact", None, 0.0, 0.0)], "id string, sector string, memory_type string, embedding array<float>, importance double, confidence double")
    want = []
    for s in sizes:
        part = [r for r in rows if r[1] == s]
        if len(part) < least:
            continue
        x = np.array([r[3] for r in part])
        seeds = [int(np.argmax(np.linalg.norm(x - x.mean(0), axis=1)))] if s != "same" else [0]
        gap = np.linalg.norm(x - x[seeds[0]], axis=1)
        while len(seeds) < min(most // len(sizes), len(part) // least) and gap.max() >= 1e-6:
            seeds.append(int(np.argmax(gap)))
            gap = np.minimum(gap, np.linalg.norm(x - x[seeds[-1]], axis=1))
        for k in seeds:
            at = np.argsort(-(x @ x[k]), kind="stable")[:least]
            if (x[at] @ x[k] > 0.25).all():
                want.append((s, part[k][0], [part[i][0] for i in at], round(np.mean([part[i][4] for i in at]) + 0.05, 4), round(np.mean([part[i][5] for i in at]), 4)))
    got = [tuple(r[c] for c in ("sector", "seed", "members", "importance", "confidence")) for r in gists.build(df.repartition(7), least, most).collect()]
    assert sorted(got) == sorted(want) and len(want) > 5
    assert gists.build(df.limit(0)).count() == 0


def test_activation_golden(spark):
    """A seed of full strength fires at once; its neighbour gets its current times the edge in the next tick."""
    sym = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 1.0), ("b", "c", 0.5), ("c", "b", 0.5)], "src string, dst string, weight double")
    nodes = spark.createDataFrame([("a", 0.0), ("b", 0.0), ("c", 0.0)], "id string, importance double")
    seeds = spark.createDataFrame([(1, "a", 1.0)], "query_id int, id string, seed_score double")
    peaks, trace = activation.spiking(seeds, nodes, sym, ticks=3)
    assert {r["id"]: r["peak"] for r in peaks.collect()} == {"a": 1.0, "b": 1.0}
    assert {(r["tick"], r["id"]) for r in trace.where("spike").collect()} == {(0, "a"), (1, "b"), (2, "a")}
    spread = {r["id"]: r["activation"] for r in activation.continuous(seeds, nodes, sym).collect()}
    # a keeps half in each hop; b takes two thirds of a, then of what a has left; c takes all of b
    assert spread == {"a": 0.25, "b": pytest.approx(1 / 6, abs=1e-5), "c": pytest.approx(1 / 6, abs=1e-5)}


def test_activation_rounds_as_sql_does(spark):
    """what stands halfway between two places is rounded by the scaled double, in the order of first hits and in what they activate."""
    rows = [(1, "d", 0.500045, 1), (1, "c", 0.500043, 2), (1, "b", 0.500042, 3), (1, "a", 0.500041, 4)]
    hits = spark.createDataFrame(rows, "query_id int, id string, score double, rank long")
    for k in (1, 2, 3, 4):
        # QUALIFY means the rank of the hits, not the new one
        sql = f"SELECT id FROM (SELECT id, row_number() OVER (ORDER BY round(score::DOUBLE, 5) DESC, id) AS rank FROM (VALUES {', '.join(map(str, rows))}) t(query_id, id, score, rank) QUALIFY rank <= {k}) ORDER BY rank"
        assert [r["id"] for r in retrieval.first_hits(hits, k).orderBy("rank").collect()] == [r[0] for r in duckdb.sql(sql).fetchall()]
    alone = spark.createDataFrame([], "src string, dst string, weight double")
    seeds = spark.createDataFrame([(1, "a", 0.125014)], "query_id int, id string, seed_score double")
    nodes = spark.createDataFrame([("a", 0.0)], "id string, importance double")
    want = duckdb.sql("SELECT round(0.125014::DOUBLE * 0.5 * 0.5, 6)::DOUBLE").fetchall()[0][0]
    assert [r["activation"] for r in activation.continuous(seeds, nodes, alone).collect()] == [want] == [0.031253]


def test_spikes_round_as_sql_does(spark):
    """peaks and traces that stand halfway between two places are rounded by the scaled double."""
    sym = spark.createDataFrame([("a", "b", 0.95), ("b", "a", 0.95)], "src string, dst string, weight double")
    nodes = spark.createDataFrame([("a", 0.0), ("b", 0.0), ("c", 0.0)], "id string, importance double")
    seeds = spark.createDataFrame([(1, "a", 0.96071), (2, "c", 0.253229)], "query_id int, id string, seed_score double")
    peaks, trace = activation.spiking(seeds, nodes, sym)
    peak, left = duckdb.sql("SELECT round(0.96071::DOUBLE * 0.95, 6)::DOUBLE, round(0.253229::DOUBLE * 0.5, 6)::DOUBLE").fetchall()[0]
    assert {r["id"]: r["peak"] for r in peaks.collect()} == {"a": 0.96071, "b": peak} and peak == 0.912675
    quiet = {r["tick"]: (r["before"], r["after"]) for r in trace.where("query_id = 2").collect()}
    assert quiet[1] == (0.253229, left) and quiet[2][0] == left == 0.126614


def test_channels_start_where_sql_does(spark):
    """the fifth hit leads on, not the sixth that equals it to five places and has the smaller id; what it activates is rounded as in SQL."""
    scores = {"e": 0.9, "f": 0.8, "g": 0.7, "h": 0.6, "z": 0.500045, "a": 0.500043}
    hits = spark.createDataFrame([(1, n, s, i + 1) for i, (n, s) in enumerate(scores.items())], "query_id int, id string, score double, rank long")
    pair = spark.createDataFrame([("a", "by a", 1.0, 0.5), ("by z", "z", 1.0, 0.5)], "a string, b string, weight double, confidence double")
    nodes = spark.createDataFrame([(n, 0.0) for n in [*scores, "by a", "by z"]], "id string, importance double")
    union, reached = retrieval.channels(nodes, None, None, on=retrieval.Ground(hits, pair, graph.symmetric(pair)))
    assert [(r["id"], r["path"]) for r in union.where("channel = 1").collect()] == [("by z", ["z", "by z"])]
    half = duckdb.sql("SELECT round(0.500045::DOUBLE * 0.5 * 0.5, 6)::DOUBLE").fetchall()[0][0]
    assert {r["id"]: r["activation"] for r in reached.collect()} == {"e": 0.225, "f": 0.2, "g": 0.175, "h": 0.15, "z": half, "by z": half}


def test_components_of_retrieval():
    assert retrieval.select_components("all") == tuple(retrieval.WEIGHTS)
    assert retrieval.select_components("semantic, graph") == ("semantic", "graph")
    with pytest.raises(ValueError):
        retrieval.select_components("nothing")


def test_plasticity(spark):
    pairs = spark.createDataFrame([("a", "b", 1.0, 0.8), ("b", "c", 1.0, 0.8)], "a string, b string, weight double, confidence double")
    got = {r["a"]: r["new_weight"] for r in plasticity.reinforce(pairs, spark.createDataFrame([(["b", "a"],)], "path array<string>")).collect()}
    assert got == {"a": 1.14, "b": 0.98}
    none = plasticity.reinforce(pairs, spark.createDataFrame([(["x"],)], "path array<string>")).collect()
    assert all(r["new_weight"] == r["weight"] for r in none)
    e = spark.createDataFrame([("a", "b", "r", 1.0, 0.0), ("c", "d", "r", 1.0, 0.0)], EDGES)
    spikes = spark.createDataFrame([("a", 0, 0), ("b", 1, 1), ("d", 0, 2), ("c", 1, 3)], "id string, tick long, seq long")
    assert {r["source_id"]: (r["change"], r["new_weight"]) for r in plasticity.spike_timing(e, spikes).collect()} == {"a": ("ltp", 1.06), "c": ("ltd", 0.96)}


def test_decay_keeps_floor(spark):
    now = F.lit("2024-02-01 00:00:00").cast("timestamp")
    rows = [(f"n{i}", 0.6, 0.6, datetime(2024, 2, 1) - timedelta(days=30 * i), 0, 0, 0.5, 1) for i in range(4)]
    n = spark.createDataFrame(rows, "id string, importance double, confidence double, updated_at timestamp, access_count long, failures long, stability double, records long")
    d = dynamics.decay(n, dynamics.soft_retention(now)).orderBy("id").collect()
    assert d[0]["new_importance"] == 0.6 and not d[0]["faded"]
    assert [r["retention"] for r in d] == sorted([r["retention"] for r in d], reverse=True)
    assert all(r["new_importance"] >= 0.09 for r in d)
    assert [r["id"] for r in dynamics.select_replay(n.withColumn("state", F.lit("new")), now, 2).orderBy("rank").collect()] == ["n3", "n2"]


def _near(spark, ids, x):
    return spark.createDataFrame(list(zip(ids, np.asarray(x).tolist())), "id string, embedding array<double>")


def test_merge_candidates_blocks(spark):
    """Ties, copies, a vector of no length and a repeated row, in blocks and in one piece."""
    rng = np.random.default_rng(3)
    x = rng.integers(-1, 2, (60, 3)).astype(float)
    ids = [f"v{i:02}" for i in rng.permutation(60)]
    df = _near(spark, [*ids, ids[0]], [*x, x[0]])
    unit = {i: v / max(np.linalg.norm(v), 1e-9) for i, v in zip(ids, x)}
    want = sorted((-round(float(unit[a] @ unit[b]) + 1e-9, 4), a, b) for a in ids for b in ids if a < b and unit[a] @ unit[b] >= 0.5 - 1e-6)
    for most, block in ((70, 7), (70, 1000), (10_000, 7)):
        got = sorted((-r["similarity"], r["a"], r["b"]) for r in dynamics.merge_candidates(df, 0.5, most, block).collect())
        assert got == want[:most]
    assert dynamics.merge_candidates(df.limit(0), 0.5).count() == 0


def test_merge_candidates_of_a_large_table(spark):
    """Above 20,000 vectors the nearest pairs are still those of all pairs."""
    rng = np.random.default_rng(4)
    x = rng.standard_normal((20_500, 64))
    ids = [f"v{i:08}" for i in range(len(x))]
    got = dynamics.merge_candidates(_near(spark, ids, x), 0.45).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = []
    for i in range(0, len(u), 2000):
        s = u[i : i + 2000] @ u.T
        want += [(-round(float(s[p, q]), 4), ids[i + p], ids[q]) for p, q in zip(*np.nonzero(s >= 0.49)) if i + p < q]
    assert len(want) > 500
    assert [(-r["similarity"], r["a"], r["b"]) for r in got] == sorted(want)[:500]


def test_versions(spark):
    log = spark.createDataFrame([("S", 1, "x", "user"), ("S", 2, "x", "user"), ("S", 3, "y", "web"), (" s", 4, "z", "replay")], "subject string, seq long, content string, source string")
    c = versions.chain(log).orderBy("n").collect()
    assert [r["content"] for r in c] == ["x", "y", "z"] and c[1]["supersedes"] == c[0]["hash"] and c[0]["supersedes"] is None
    p = versions.evidence_policy(spark.createDataFrame([("user", "web"), ("web", "replay"), ("replay", "user"), ("doc", "pdf")], "o string, n string"), F.col("o"), F.col("n"))
    assert [r["policy"] for r in p.collect()] == ["direct_wins_testimony_dissent", "derived_never_overrides", "derived_superseded_by_source", "recency_wins_keep_both"]


def test_storage_and_sinks(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.upsert(spark.createDataFrame([("a", 1, "old"), ("b", 1, "b")], "id string, at long, v string"), path)
    sinks.upsert(spark.createDataFrame([("a", 2, "new")], "id string, at long, v string"), path)
    got = {r["id"]: r["v"] for r in sinks.read_latest(spark, path, ["id"], [F.col("at").desc()]).collect()}
    assert got == {"a": "new", "b": "b"}
    sinks.compact(spark, path, path + "2", ["id"], [F.col("at").desc()])
    assert spark.read.parquet(path + "2").count() == 2
    with pytest.raises(ValueError):
        sinks.append_vectors(spark.createDataFrame([("a", [1.0])], "id string, embedding array<double>"), path + "3", 2)
    pairs = storage.consecutive_pairs(spark.createDataFrame([(1, i) for i in range(5)], "k int, i int"), ["k"], ["i"], "i").orderBy("pair").collect()
    assert [(r["first"], r["second"]) for r in pairs] == [(0, 1), (2, 3)]


def test_readers(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("caf\xe9".encode("latin-1"))
    (tmp_path / "b.md").write_text("# Head\n**bold** [x](y)")
    (tmp_path / "c.csv").write_text("name,role\nAda,lead\nBob,\n")
    (tmp_path / "d.json").write_text('{"name": "Ada", "tags": ["x", "y"], "meta": {"year": 1843, "ok": true}}')
    rows = readers.documents(spark, [str(tmp_path / f) for f in ("a.txt", "b.md", "c.csv", "d.json")]).collect()
    texts = {r["text"] for r in rows}
    assert {"café", " Head\nbold x", "name: Ada; role: lead", "name: Bob", "Ada", "x", "y", "year: 1843", "ok: True"} <= texts
    with pytest.raises(ValueError):
        readers.documents(spark, ["x.exe"])
    q = readers.question_sets(spark.createDataFrame([("q", "a"), (" ", "a"), ("q2", None)], "question string, answer string"))
    assert q.count() == 1


def test_evaluation(spark):
    rows = spark.createDataFrame([("t", 0, 0.5), ("t", 1, 0.8), ("t", 2, 0.4)], "task string, step int, value double")
    c = evaluation.forgetting(rows).orderBy("step").collect()
    assert [round(r["forgetting"], 6) for r in c] == [0, 0, 0.4] and [round(r["retention"], 6) for r in c] == [1, 1.6, 0.5]
    d = spark.createDataFrame([("s", i, x) for i, x in enumerate([0.1, 0.2, -0.05, 0.3, 0.15, 0.2, 0.1, 0.25])], "system string, query_id int, diff double")
    b = evaluation.paired_bootstrap(d, ["system"], rounds=500).first()
    x = [0.1, 0.2, -0.05, 0.3, 0.15, 0.2, 0.1, 0.25]
    draw = lambda r, j: x[int(hashlib.md5(f"42:{r}:{j}".encode()).hexdigest()[:8], 16) % 8]
    boots = sorted(sum(draw(r, j) for j in range(8)) / 8 for r in range(500))
    assert (b["ci_low"], b["ci_high"]) == (round(boots[12], 5), round(boots[486], 5)) and b["p_value"] < 0.05
    assert evaluation.paired_bootstrap(d.withColumn("diff", F.lit(0.0)), ["system"], 50).first()["p_value"] == 1
    w = evaluation.wilcoxon(d, ["system"]).first()
    assert w["statistic"] == 1 and w["p_value"] < 0.05
    assert evaluation.wilcoxon(d.where("query_id in (0, 1, 3, 4, 5)"), ["system"]).first()["p_value"] == 1
    z = spark.createDataFrame([(0.5,), (1.96,)], "z double").select(evaluation.normal_tail(F.col("z"))).collect()
    assert z[0][0] == pytest.approx(evaluation.exact_tail(0.5), abs=1e-6) and z[1][0] == pytest.approx(evaluation.exact_tail(1.96), abs=1e-6)


def test_bootstrap_draws_without_rows_of_draws(spark, monkeypatch):
    """rounds drawn where the pairs are held equal draws that are joined, and no draw becomes a row."""
    import hashlib

    from mnemograph.functions import numeric

    heads = numeric.md5_heads("42:7:", 5, 12_345)
    assert heads.tolist() == [int(hashlib.md5(f"42:7:{i}".encode()).hexdigest()[:8], 16) for i in range(5, 12_345)]
    with pytest.raises(ValueError):
        numeric.md5_heads("x" * 55, 0, 2)
    rng = random.Random(3)
    rows = [(s, i, None if s == "c" and i % 5 == 0 else round(rng.uniform(-1, 1.2), 3)) for s, n in (("a", 40), ("b", 130), ("c", 30), ("d", 1)) for i in range(n)]
    d = spark.createDataFrame(rows, "system string, query_id long, diff double")
    joined = evaluation._joined_draws
    monkeypatch.setattr(evaluation, "_joined_draws", None)
    held = sorted(map(tuple, evaluation.paired_bootstrap(d, ["system"], 300).collect()))
    monkeypatch.setattr(evaluation, "_joined_draws", joined)
    monkeypatch.setattr(evaluation, "HELD_PAIRS", 0)
    assert len(held) == 4 and held == sorted(map(tuple, evaluation.paired_bootstrap(d, ["system"], 300).collect()))


def test_compress_budget(spark):
    """Against a plain greedy choice that counts the tokens of the whole context anew for each sentence."""
    rng = random.Random(3)
    word = lambda: rng.choice(["answer", "topic", "alpha", "Beta", "gamma", "é"])
    rows = []
    for q in range(12):
        for k in range(rng.randint(1, 6)):
            text = " ".join(" ".join(word() for _ in range(rng.randint(1, 8))) + rng.choice(".!?") for _ in range(rng.randint(0, 6)))
            rows.append((q, "answer topic" if q % 3 else "", k + 1, f"i{k}", rows[-1][4] if rows and rng.random() < 0.1 else None if rng.random() < 0.1 else text, k % 3, rng.choice(["s", "two words"])))
    df = spark.createDataFrame(rows, "query_id long, query string, rank int, id string, text string, ring int, sector string")

    def plain(items, budget):
        asked = set(re.findall(r"\w+", items[0][1]))
        lines, ids, seen = [], [], set()
        for _, _, _, i, text, ring, sector in items:
            parts = [p for p in re.split(r"(?<=[.!?])\s+", (text or "").strip()) if p]
            if not parts or text[:2000] in seen:
                continue
            seen.add(text[:2000])
            shown = set()
            render = lambda on: f"[{len(lines) + 1}] (ring{ring} · {sector}) " + " ".join(parts[j] for j in sorted(on))  # noqa: B023, E731
            for j in sorted(range(len(parts)), key=lambda j: (-len(asked & set(re.findall(r"\w+", parts[j].lower()))), j)):
                if parts[j] not in {parts[x] for x in shown} and len("\n".join([*lines, render(shown | {j})]).split()) <= budget:
                    shown.add(j)
            if shown:
                lines.append(render(shown))
                ids.append(i)
        return "\n".join(lines), ids

    for budget in (4, 15, 40, 400):
        got = {r["query_id"]: r for r in compression.compress(df, budget).collect()}
        for q in range(12):
            items = [r for r in rows if r[0] == q]
            text, ids = plain(items, budget)
            assert (got[q]["context"], got[q]["ids"], got[q]["n_tokens"]) == (text, ids, len(text.split()))
            assert got[q]["n_raw_tokens"] == sum(len((r[4] or "").split()) for r in items)


def test_affect():
    s = dict(affect.BASELINE)
    for k in ("memory", "parametric", "no_evidence"):
        s = affect.step(s, k)
    assert -1 <= s["valence"] <= 1 and affect.label(affect.step(s, "identity")) == "neutral"


def test_stream_keeps_fold(spark, tmp_path):
    rows = [(1, i, datetime(2024, 1, 1) + timedelta(hours=i), k) for i, k in enumerate(["memory", "web", "parametric", "memory"])]
    schema = "user_id long, event_id long, at timestamp, kind string"
    batch = spark.createDataFrame(rows, schema)
    batch.repartition(1).write.parquet(str(tmp_path / "log"))
    out = logs.run_all(logs.affect_states(logs.open_log(spark, str(tmp_path / "log"), batch.schema)), str(tmp_path / "out"), "update")
    want, got = affect.fold(batch, "user_id").first(), out.first()
    assert round(got["valence"], 6) == want["valence"] and got["updates"] == 4 and got["label"] == want["label"]


def test_placement_all_strategies(spark):
    from mnemograph.plans import adapters as A

    from .conftest import SMALL

    n, e = A.nodes(spark, SMALL).limit(60), A.edges(spark, SMALL)
    n = spark.createDataFrame(n.collect(), n.schema)
    for strategy in ("embedding_clusters", "graph_centrality", "temporal", "hybrid", "unknown"):
        p = placement.place(n, graph.induced(e, n), strategy, A.now())
        assert p.count() == 60 and p.where("ring < 0 or ring > 4 or radial_distance < 0 or radial_distance > 1").count() == 0


def test_entities_of_every_language(spark):
    """Against the patterns in Python, whose word borders know every script."""
    from mnemograph.plans import catalog

    def plain(text):
        found = [p.strip() for p in re.findall(r"\b([A-Z][a-zA-Z0-9]*(?:\s+[A-Z][a-zA-Z0-9]*)*)\b", text)]
        found = list(dict.fromkeys(p for p in found if len(p) > 2 and p.lower() not in T.STOP_WORDS))[:8]
        low = [w.lower() for w in re.findall(r"[A-Za-z][A-Za-z0-9_-]{2,}", text)]
        return "|".join(found or list(dict.fromkeys(w for w in low if len(w) >= 4 and w not in T.STOP_WORDS))[:3])

    folder = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = {r["doc_id"]: r["entities"] for r in catalog.queries()["entity_extract"](spark, folder).collect()}
    assert got == {i: plain(t) for i, t in texts.items()}


def test_decay_charges_each_interval_once(spark):
    day = lambda n: datetime(2024, 1, 1) + timedelta(days=n)
    node = spark.createDataFrame([("a", 0.8, 0.7, 0.5, 3, 2, "new", day(0))], "id string, importance double, confidence double, stability double, access_count int, records int, state string, updated_at timestamp")
    once = dynamics.adaptive_decay(node, F.lit(day(30))).first()
    again = dynamics.adaptive_decay(dynamics.adaptive_decay(node, F.lit(day(30))).withColumn("importance", F.col("new_importance")).drop("retention", "faded", "new_importance"), F.lit(day(30))).first()
    assert once["retention"] < 1 and again["retention"] == 1 and again["new_importance"] == once["new_importance"]


def test_query_blocks_give_the_same_answers(spark, monkeypatch):
    from mnemograph.operators import lexical

    rng = random.Random(8)
    nodes = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(60)], "id int, embedding array<double>")
    asked = nodes.where("id % 3 = 0").selectExpr("id AS query_id", "embedding AS vector")
    words = ["red", "green", "blue", "one", "two", "naïve"]
    docs = spark.createDataFrame([(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 30)))) for i in range(50)] + [(50, None)], "doc_id int, text string")
    texts = spark.createDataFrame([(i, f"{a} {b}") for i, (a, b) in enumerate(zip(words, words[1:]))], "query_id int, query string")
    whole = [set(map(tuple, retrieval.vector_topk(nodes, asked, 5).collect())), set(map(tuple, lexical.bm25(docs, "doc_id", texts, 5).collect()))]
    monkeypatch.setattr(retrieval, "BLOCK_QUERIES", 4)
    monkeypatch.setattr(lexical, "BLOCK_QUERIES", 2)
    parts = [set(map(tuple, retrieval.vector_topk(nodes, asked, 5).collect())), set(map(tuple, lexical.bm25(docs, "doc_id", texts, 5).collect()))]
    assert whole == parts and len(whole[0]) == 100


def test_paths_of_any_length(spark):
    """Hops and costs against breadth-first search and Dijkstra's algorithm, on a long ring with a short cut."""
    import heapq

    rng = random.Random(2)
    pairs = {(i, (i + 1) % 30): rng.choice([0.5, 1.0, 2.0]) for i in range(30)} | {(3, 17): 0.1}
    edges = spark.createDataFrame([(f"n{a:02}", f"n{b:02}", "r", w, 0.5) for (a, b), w in pairs.items()], EDGES)
    sym = graph.symmetric(graph.pairs(edges))
    near = {}
    for (a, b), w in pairs.items():
        near.setdefault(a, []).append((b, 1 / w))
        near.setdefault(b, []).append((a, 1 / w))

    def costs(unit):
        best, heap = {}, [(0, 0)]
        while heap:
            c, n = heapq.heappop(heap)
            if n not in best:
                best[n] = c
                for m, w in near[n]:
                    heapq.heappush(heap, (c + (1 if unit else w), m))
        return {f"n{n:02}": c for n, c in best.items() if n}

    seed = spark.createDataFrame([("n00",)], "id string")
    assert {r["id"]: r["hop"] for r in graph.hop_distance(seed, sym).collect()} == costs(True)
    got = {r["id"]: r["cost"] for r in graph.cheapest_paths(seed, sym).collect()}
    assert got == pytest.approx(costs(False))


def _tied_graph(spark):
    """A lattice whose edges are of two weights, so that many paths tie, and a part that no seed reaches."""
    rng = random.Random(5)
    at = lambda x, y: f"n{x * 7 + y:02}"
    rows = [(at(x, y), at(x + i, y + j), "r", rng.choice([0.5, 1.0]), 0.5) for x in range(6) for y in range(6) for i, j in ((0, 1), (1, 0))] + [("x", "y", "r", 1.0, 0.5)]
    return spark.createDataFrame([("n00",), ("n24",), ("alone",)], "id string"), graph.symmetric(graph.pairs(spark.createDataFrame(rows, EDGES)))


def test_cheapest_paths_of_any_length_write_no_rounds(spark, monkeypatch):
    """walks in tasks equal joined rounds, ties too, and only the graph is written, not each round's paths."""
    seeds, sym = _tied_graph(spark)
    written = []
    monkeypatch.setattr(graph, "cut", lambda df, cut=graph.cut: written.append(df.columns) or cut(df))
    held, text = (graph.cheapest_paths(seeds, sym, joined=j).collect() for j in (False, True))
    assert written == [["at", "id", "c"]] * 2
    monkeypatch.setattr(graph, "HELD_EDGES", 0)
    rounds = graph.cheapest_paths(seeds, sym).collect()
    key = lambda r: (r["seed"], r["id"], r["cost"], ">".join(r["path"]))
    assert len(held) == 94 and sorted(map(key, held)) == sorted(map(key, rounds)) == sorted(map(tuple, text))


def test_cheapest_paths_come_in_the_order_of_their_tree(spark, monkeypatch):
    """a row's path goes on from the path of the row before it or from a part of that, so files of them are small; small pieces give the same rows."""
    seeds, sym = _tied_graph(spark)
    whole = {j: sorted(map(tuple, graph.cheapest_paths(seeds, sym, joined=j).collect())) for j in (False, True)}
    monkeypatch.setattr(graph, "WALK_SIZE", 20)
    assert sorted(map(tuple, graph.cheapest_paths(seeds, sym).collect())) == whole[False]
    last, rows = {}, graph.cheapest_paths(seeds, sym, joined=True).collect()
    for r in rows:
        stem = r["path"].rsplit(">", 1)[0]
        assert (last.get(r["seed"], r["seed"]) + ">").startswith(stem + ">")
        last[r["seed"]] = r["path"]
    assert len(rows) == 94 and sorted(map(tuple, rows)) == whole[True]


def test_hops_of_any_length_write_no_rounds(spark, monkeypatch):
    """walks in tasks equal joined rounds, and only the graph is written."""
    seeds, sym = _tied_graph(spark)
    written = []
    monkeypatch.setattr(graph, "cut", lambda df, cut=graph.cut: written.append(df.columns) or cut(df))
    held = graph.hop_distance(seeds, sym).collect()
    assert written == [["src", "dst", "c"]]
    monkeypatch.setattr(graph, "HELD_EDGES", 0)
    assert len(held) == 94 and sorted(map(tuple, held)) == sorted(map(tuple, graph.hop_distance(seeds, sym).collect()))


def test_samples_and_splits(spark):
    from mnemograph.operators import benchmarks

    rows = spark.createDataFrame([(i, f"g{i % 7}" if i % 10 else None) for i in range(70)], "id int, grp string")
    key = lambda i: hashlib.md5(f"5:{i}".encode()).hexdigest()
    assert {r["id"] for r in benchmarks.sample(rows, "id", 9, 5).collect()} == set(sorted(range(70), key=key)[:9])
    assert benchmarks.sample(rows, "id", 0).count() == 70
    sides = {}
    for r in benchmarks.grouped_split(rows, "grp").collect():
        sides.setdefault(r["grp"], set()).add(r["side"])
    assert sorted(next(iter(v)) for v in sides.values()) == ["holdout"] * 2 + ["train"] * 5 and all(len(v) == 1 for v in sides.values())


def test_answer_quality_and_supersession(spark):
    from mnemograph.operators import benchmarks

    passages = spark.createDataFrame([(1, "The red fox ran"), (1, "a fox in the snow"), (2, None), (3, "concatenate red foxes")], "query_id int, text string")
    answers = spark.createDataFrame([(1, "Red fox!"), (2, "snow"), (3, "red fox"), (4, "")], "query_id int, answer string")
    got = {r["query_id"]: (r["coverage"], r["found"]) for r in benchmarks.answer_quality(passages, answers).collect()}
    assert got == {1: (1.0, 1), 2: (0.0, 0), 3: (0.5, 0), 4: (0.0, 0)}
    nodes = spark.createDataFrame([("a", 1), ("b", 4), ("c", 1)], "id string, memory_version int")
    gone = spark.createDataFrame([("a", "b"), ("b", "b"), ("c", "unknown")], "id string, by string")
    out = benchmarks.supersede(nodes, gone, F.lit(datetime(2024, 1, 1))).collect()
    assert [(r["id"], r["superseded_by"], r["memory_version"], r["state"]) for r in out] == [("a", "b", 2, "consolidated")]
