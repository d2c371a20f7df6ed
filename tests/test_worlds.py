"""Stored worlds: the vector index, manifests, histories, ageing and ladders, against plain versions."""

import datetime
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemograph.operators import dynamics, experiments, history, lab, placement, retrieval, vector_index, worlds
from mnemograph.operators.topk import RunningTop
from mnemograph.plans import adapters as A
from mnemograph.plans import catalog
from mnemograph.sources.manifest import Conflict, Manifest

SMALL = "/root/testdata/sf0.001"
VECTORS = "id string, embedding array<double>"


def clustered(n, seed, spread=0.15, cells=12, dims=16):
    rng = np.random.default_rng(seed)
    centre = np.random.default_rng(99).standard_normal((cells, dims))
    return (centre[rng.integers(0, cells, n)] + spread * rng.standard_normal((n, dims))).tolist()


def plain_top(rows, queries, k):
    out = set()
    for q, v in queries:
        score = lambda x: round(float(np.dot(v, x) / (np.linalg.norm(v) * np.linalg.norm(x))), 6)
        for rank, (s, i) in enumerate(sorted((-score(x), i) for i, x in rows.items())[:k]):
            out.add((q, i, round(-s, 6), rank + 1))
    return out


def test_index_after_a_mix_of_operations(spark, tmp_path):
    index = vector_index.VectorIndex(spark, f"file://{tmp_path}/index", 16)
    queries = list(enumerate(clustered(9, 5)))
    asked = spark.createDataFrame(queries, "query_id long, vector array<double>")
    rows: dict[str, list[float]] = {}

    def check(k=6):
        got = {(r["query_id"], r["id"], round(r["score"], 6), r["rank"]) for r in index.search(asked, k).collect()}
        assert got == plain_top(rows, queries, k) and index.size() == len(rows)

    check()
    first = {f"n{i:04}": v for i, v in enumerate(clustered(1500, 1))}
    rows.update(first)
    index.rebuild(spark.createDataFrame(list(first.items()), VECTORS), cells=30)
    check()
    all_, begin, more = index.cells_read
    assert all_ > 8 and begin + more < all_
    gone = [i for i in rows if int(i[1:]) % 3 == 0]
    index.delete(spark.createDataFrame([(i,) for i in gone] + [("nobody",)], "id string"))
    for i in gone:
        del rows[i]
    check()
    new = {f"n{i:04}": v for i, v in enumerate(clustered(300, 2), 1400)} | {"n0000": queries[0][1], "n0003": queries[0][1]}
    index.upsert(spark.createDataFrame(list(new.items()), VECTORS))
    rows.update(new)
    check()
    index.delete(spark.createDataFrame([("n0000",)], "id string"))
    del rows["n0000"]
    check(k=2000)
    before = index.manifest.current()[0]
    index.compact()
    check()
    assert index.manifest.current()[1]["segments"] == [] and index.live(before).count() == len(rows)
    index.rebuild(spark.createDataFrame([("a", [0.0] * 16), ("b", [1.0] * 16)], VECTORS))
    rows = {"b": [1.0] * 16}
    assert {r["id"] for r in index.search(asked, 1).collect()} <= {"a", "b"}
    with pytest.raises(ValueError):
        index.upsert(spark.createDataFrame([("x", [1.0])], VECTORS))


def test_index_with_crowded_cells(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vector_index, "FILE_ROWS", 40)
    monkeypatch.setattr(vector_index, "BLOCK_QUERIES", 2)
    index = vector_index.VectorIndex(spark, f"file://{tmp_path}/index", 16)
    rows = {f"n{i:04}": v for i, v in enumerate(clustered(300, 3, cells=2) + [[1.0] * 16] * 200)}
    index.rebuild(spark.createDataFrame(list(rows.items()), VECTORS), cells=4)
    queries = [*enumerate(clustered(4, 6)), (9, [1.0] * 16)]
    got = {(r["query_id"], r["id"], round(r["score"], 6), r["rank"]) for r in index.search(spark.createDataFrame(queries, "query_id long, vector array<double>"), 5).collect()}
    assert got == plain_top(rows, queries, 5)


def test_running_top_keeps_little(monkeypatch):
    monkeypatch.setattr("mnemograph.operators.topk.GATHERED", 50)
    rng = np.random.default_rng(0)
    best, everything = RunningTop(3, 4), []
    for i in range(40):
        ids, scores = np.array([f"i{i:02}{j:02}" for j in range(25)], object), rng.integers(0, 30, (3, 25)).astype(float)
        best.add(np.arange(3), ids, scores)
        everything += [(q, -scores[q, j], ids[j]) for q in range(3) for j in range(25)]
        assert best.rows <= 50 + 75
    got = [tuple(x) for x in best.shrink()[["q", "score", "id"]].itertuples(index=False)]
    assert got == [(q, -s, i) for k in range(3) for q, s, i in sorted(x for x in everything if x[0] == k)[:4]]


def test_blocks_of_queries_agree(spark, monkeypatch):
    nodes = spark.createDataFrame([(f"n{i:03}", v) for i, v in enumerate(clustered(200, 4))], VECTORS)
    asked = spark.createDataFrame(list(enumerate(clustered(7, 8))), "query_id long, vector array<double>")
    one = {tuple(r) for r in retrieval.vector_topk(nodes, asked, 5).collect()}
    monkeypatch.setattr(retrieval, "BLOCK_QUERIES", 2)
    assert {tuple(r) for r in retrieval.vector_topk(nodes, asked, 5).collect()} == one and len(one) == 35


def test_lost_race_leaves_the_old_version(spark, tmp_path):
    a, b = (Manifest(spark, f"file://{tmp_path}/table") for _ in "ab")
    assert a.current() == (0, {})
    a.commit(0, {"rows": 1})
    version, says = b.current()
    a.commit(1, {"rows": 2})
    with pytest.raises(Conflict):
        b.commit(version, says | {"rows": 9})
    assert b.current() == (2, {"rows": 2}) and b.at(1) == {"rows": 1} and a.versions() == [1, 2]

    def step(says):
        if says["rows"] == 2:
            a.commit(2, {"rows": 5})
        return {"rows": says["rows"] + 1}

    assert b.change(step) == 4 and a.current() == (4, {"rows": 6})


def plain_history(rows):
    """Each action applied to the node before it, one after the other."""
    nodes, out = {}, []
    for r in sorted(rows, key=lambda r: (r["id"], r["at"], r["seq"])):
        old, act = nodes.get(r["id"]), r["action"]
        if act not in history.ACTIONS or (old is None and act != "create"):
            continue
        n = dict(old or {})
        if act == "create":
            n = {"raw_text": r["raw_text"] or "", "summary": r["summary"], "source_ids": sorted(set(r["source_ids"] or [])), "importance": r["importance"] or 0.0, "confidence": r["confidence"] or 0.0, "archived": False, "ended_at": None, "reason": None}
        if act == "update":
            n |= {c: r[c] for c in ("raw_text", "summary", "importance", "confidence") if r[c] is not None}
            if r["source_ids"] is not None:
                n["source_ids"] = sorted(set(r["source_ids"]))
        if act == "merge":
            n["raw_text"] = "\n".join(x for x in (n["raw_text"].strip(), (r["raw_text"] or "").strip()) if x)
            n["summary"] = r["summary"] if r["summary"] is not None else n["summary"]
            n["source_ids"] = sorted(set(n["source_ids"]) | set(r["source_ids"] or []))
            n |= {c: max(n[c], r[c] or 0.0) for c in ("importance", "confidence")}
        if act in ("invalidate", "supersede"):
            n["ended_at"] = r["at"]
        if act == "invalidate":
            n["confidence"] = min(n["confidence"], 0.2)
        if act in ("invalidate", "supersede", "split"):
            n["reason"] = r["reason"]
        if act in ("archive", "restore"):
            n["archived"] = act == "archive"
        if act == "restore":
            n |= {"ended_at": None, "reason": None}
        out.append((r["id"], act, r["at"], old and dict(old), n))
        nodes[r["id"]] = n
    return out


def random_log(n=700):
    rng = random.Random(6)
    maybe = lambda x: x if rng.random() < 0.6 else None
    start = datetime.datetime(2024, 1, 1)
    rows = []
    for i in range(n):
        act = rng.choice([*history.ACTIONS, "merge", "merge", "invalidate", "unknown"]) if i > 40 else rng.choice(["create", "merge"])
        text = maybe(rng.choice([" a", "b ", "", f"t{i}"]))
        rows.append({"id": f"n{rng.choice([0, 0, 0, *range(1, 25)])}", "at": start + datetime.timedelta(hours=i // 3), "seq": i, "action": act, "raw_text": text, "summary": maybe(f"s{i}"), "source_ids": maybe([f"c{rng.randint(0, 5)}", "c1"]), "importance": maybe(rng.randint(0, 9) / 10), "confidence": maybe(rng.randint(0, 9) / 10), "reason": maybe(f"r{i}")})
    return rows


LOG = "id string, at timestamp, seq long, action string, raw_text string, summary string, source_ids array<string>, importance double, confidence double, reason string"


def test_history_equals_a_fold(spark):
    rows = random_log()
    df = spark.createDataFrame([tuple(r.values()) for r in rows], LOG).repartition(5)
    got = sorted((r.asDict(True) for r in history.history(df).collect()), key=lambda r: (r["id"], r["version"]))
    want = plain_history(rows)
    assert len(got) == len(want) > 300
    for g, (i, act, at, before, after) in zip(got, want):
        assert (g["id"], g["action"], g["valid_from"]) == (i, act, at)
        assert {c: g[c] for c in history.IMAGE} == after, (g, after)
        assert (g["before"] is None) == (before is None)
    for a, b in zip(got, got[1:]):
        same = a["id"] == b["id"]
        assert a["valid_to"] == (b["valid_from"] if same else None) and (not same or b["before"] == {c: a[c] for c in history.IMAGE})
    then = datetime.datetime(2024, 1, 5)
    states = {i: after for i, _, at, _, after in want if at <= then}
    seen = {r["id"]: r for r in history.as_of(history.history(df), F.lit(then)).collect()}
    assert seen.keys() == states.keys() and all(seen[i]["importance"] == s["importance"] for i, s in states.items())
    assert history.history(df.limit(0)).count() == 0


def test_conflicting_merges_stay_apart(spark):
    now = F.lit(datetime.datetime(2024, 2, 1))
    nodes = spark.createDataFrame([("a", "The sky is blue", 0.9, datetime.datetime(2023, 1, 1)), ("b", "Grass is green", 0.9, datetime.datetime(2024, 2, 1)), ("c", "No statement", 0.1, datetime.datetime(2024, 1, 1))], "id string, raw_text string, confidence double, updated_at timestamp")
    rows = [("x", "a", "The sky is grey", 0.95), ("y", "b", "Grass is brown", 0.1), ("z", "c", "More words", 0.5), ("w", "a", "The sky is blue", 0.5), ("q", "nobody", "Snow is white", 1.0)]
    incoming = spark.createDataFrame([(i, t, x, "s", ["c1"], 0.5, c) for i, t, x, c in rows], "id string, target string, raw_text string, summary string, source_ids array<string>, importance double, confidence double")
    log, edges = history.plan_merges(nodes, incoming, now)
    assert {(r["id"], r["action"], r["reason"]) for r in log.collect()} == {("x", "create", None), ("a", "supersede", "superseded_by:x"), ("y", "create", None), ("c", "merge", None), ("a", "merge", None)}
    assert {(r["source_id"], r["target_id"], r["relation_type"]) for r in edges.collect()} == {("a", "x", "contradicts"), ("b", "y", "contradicts")}


def test_overlays(spark):
    base = spark.createDataFrame([(f"n{i}", float(i), i % 3) for i in range(6)], "id string, importance double, ring int")
    low = spark.createDataFrame([("n1", 9.0), ("n2", 8.0), ("none", 1.0)], "id string, importance double")
    high = spark.createDataFrame([("n2", None), ("n3", 7.0)], "id string, importance double")
    got = {r["id"]: (r["importance"], r["ring"]) for r in worlds.overlaid(base, worlds.stacked(low, high)).collect()}
    assert got == {"n0": (0.0, 0), "n1": (9.0, 1), "n2": (None, 2), "n3": (7.0, 0), "n4": (4.0, 1), "n5": (5.0, 2)}


def test_rungs_are_nested(spark):
    nodes = spark.createDataFrame([(f"n{i:03}", i // 5) for i in range(400)], "id string, batch int")
    got = {}
    for r in worlds.nested_sample(nodes, "batch", [0.4, 0.05, 1.0, 0.15]).collect():
        got.setdefault(r["share"], set()).add(r["id"])
    rung = [got.get(s, set()) for s in (0.05, 0.15, 0.4, 1.0)]
    assert all(a < b for a, b in zip(rung, rung[1:])) and len(rung[3]) == 400 and 0.25 < len(rung[2]) / 400 < 0.55
    assert all({f"n{5 * (int(i[1:]) // 5) + j:03}" for j in range(5)} <= r for r in rung for i in r)
    sym = spark.createDataFrame([("n000", "x"), ("n001", "x"), ("n002", "y"), ("n000", "n001")], "src string, dst string")
    kept = spark.createDataFrame([(1.0, "n000"), (1.0, "n001"), (1.0, "n002")], "share double, id string")
    assert {r["id"] for r in worlds.with_hubs(kept, sym).collect()} == {"n000", "n001", "n002", "x"}


def test_ladder_has_a_row_for_each_rung_and_strategy(spark):
    nodes, some = A.nodes(spark, SMALL).withColumn("batch", F.floor(F.col("num") / 10)), ("temporal",)
    asked = nodes.where("num % 10 = 0").select(F.col("num").alias("query_id"), "id", F.col("embedding").alias("vector"), F.col("concept").alias("query"))
    rows = worlds.ladder(nodes, A.edges(spark, SMALL), asked, A.now(), "batch", [0.4, 1.0], some, least_degree=3).collect()
    assert {(r["share"], r["strategy"]) for r in rows} == {(x, s) for x in (0.4, 1.0) for s in some}
    assert all(0 <= r["mrr"] <= 1 and 0 <= r["recall"] <= 1 and r["n"] > 0 for r in rows)
    sizes = {r["share"]: r["nodes"] for r in catalog.queries()["ladder_rungs"](spark, SMALL).collect()}
    assert all(sizes[r["share"]] == r["nodes"] for r in rows) and sorted(sizes.values()) == [sizes[s] for s in sorted(sizes)]
    assert worlds.ladder(nodes, A.edges(spark, SMALL), asked.limit(0), A.now(), "batch", [0.4], some).count() == 0


def test_strategies_share_candidates(spark):
    """One scoring for all strategies gives what each strategy's own full ranking gives."""
    from mnemograph.plans.graph_queries import _queries

    n, e, q = A.nodes(spark, SMALL), A.edges(spark, SMALL), _queries(spark, SMALL)
    some = ("temporal",)
    got = {(r["strategy"], r["query_id"], r["rank"], r["id"]) for r in experiments.placed_runs(n, e, q, A.now(), some).collect()}
    want = {(s, r["query_id"], r["rank"], r["id"]) for s in some for r in retrieval.retrieve(placement.place(n, e, s, A.now()), e, q, A.now()).collect()}
    assert got == want


def lab_nodes(spark):
    now = datetime.datetime(2024, 2, 1)
    rng = random.Random(12)
    rows = [(f"n{i:02}", i % 3, rng.randint(0, 9) / 10, rng.randint(0, 4), rng.randint(0, 9) / 10, rng.randint(0, 12), rng.randint(0, 3), now - datetime.timedelta(days=rng.randint(0, 90)), rng.randint(0, 9) / 10, rng.randint(0, 9)) for i in range(60)]
    df = spark.createDataFrame(rows, "id string, task int, importance double, ring int, stability double, access_count long, failures long, updated_at timestamp, confidence double, records long")
    return now, rows, df


def plain_strength(imp, stab, acc, conf, rec):
    p = dynamics.PARAMETERS
    one = lambda x: min(max(x, 0), 1)
    score = p["score_access"] * min(acc / 10, 1) + p["score_importance"] * one(imp) + p["score_confidence"] * conf + p["score_degree"] * min(rec / 8, 1) + p["score_stability"] * one(stab)
    rank = 3 if acc >= 10 and score >= 0.72 else 2 if acc >= 5 and score >= 0.6 else 1 if acc >= 2 or score >= 0.45 else 0
    use = min(math.log1p(acc) / math.log1p(8), 1)
    return rank, min(max(1 + 0.35 * rank + 1.2 * one(stab) + 0.6 * (one(imp) - 0.5) + 0.8 * use + 0.1 * min(rec / 8, 1), 0.25), 8)


def test_lab_mechanisms_equal_a_plain_version(spark):
    now, rows, df = lab_nodes(spark)
    worlds_ = ["still", "decay/0.0/all", "replay/0.0/all", "decay+replay/0.1/all"]
    state = lab.first_state(df, worlds_)
    got = {(r["world"], r["id"]): r for r in lab.asleep(state, df, F.lit(now), dynamics.PARAMETERS | {"replay_size": 7}).collect()}
    assert len(got) == 4 * 60
    for world in worlds_:
        changed, urgent = {}, []
        for i, _, imp, _, stab, acc, fail, at, conf, rec in rows:
            rank, strong = plain_strength(imp, stab, acc, conf, rec)
            left = lambda days: min(math.exp(-days * math.log(2) / (21 * strong)), 1)
            days = (now - at).days
            if "decay" in world and left(days) < 0.999:
                imp = round(max(imp * left(days), imp * 0.15, 0.05) + 1e-12, 4)
            _, strong = rank, plain_strength(imp, stab, acc, conf, rec)[1]
            risk = (1 - left(days)) * imp
            need = 0.35 * risk + 0.2 * min(acc / 8, 1) + 0.15 * stab + 0.1 * min(rec / 8, 1) + 0.1 * min(fail / 3, 1) + 0.1 * rank / 3
            urgent.append((-round(min(max(need, 0), 1), 6), i))
            changed[i] = [imp, stab, at]
        for _, i in sorted(urgent)[:7] if "replay" in world else ():
            imp, stab, _ = changed[i]
            changed[i] = [round(min(0.98, imp + 0.06 * (1.2 - imp)) + 1e-12, 4), min(stab + 0.12, 1), now]
        for i, (imp, stab, at) in changed.items():
            r = got[world, i]
            # a state is told before its own decay, its strength after it
            assert (r["importance"], r["stability"]) == pytest.approx((imp, stab), abs=2e-4) and r["updated_at"] == at, (world, i, r)
            assert (r["last_decay_at"] == now) == ("decay" in world)


def test_uses_add_up_as_one_after_the_other(spark):
    now, rows, df = lab_nodes(spark)
    state = lab.first_state(df, ["decay/0.0/all"])
    counts = [(i, n % 4, n % 3) for n, i in enumerate(r[0] for r in rows)]
    uses = spark.createDataFrame([("decay/0.0/all", *c) for c in counts], "world string, id string, wins long, losses long")
    got = {r["id"]: r for r in lab.used(state, df, uses, F.lit(now)).collect()}
    for (i, wins, losses), (_, _, imp, _, stab, acc, fail, _, conf, rec) in zip(counts, rows):
        for _ in range(wins):
            acc, stab = acc + 1, min(stab + 0.12 * (0.3 * imp + 0.25 * conf + 0.15 * min(rec / 8, 1) + 0.1 * min(acc / 10 + 0.1, 1)), 1)
        for _ in range(losses):
            stab = max(stab - 0.12, 0)
        assert got[i]["stability"] == pytest.approx(stab) and (got[i]["access_count"], got[i]["failures"]) == (acc, fail + losses), i


def test_lab_carries_states_and_still_variants_rank_as_ever(spark):
    from mnemograph.plans.graph_queries import _queries
    from mnemograph.plans.world_queries import _near_gold

    nodes = A.nodes(spark, SMALL).withColumn("task", F.col("label") % 2)
    queries = _queries(spark, SMALL).withColumn("task", F.col("query_label") % 2).drop("query_label")
    edges, gold = A.edges(spark, SMALL), _near_gold(spark, SMALL)
    some = {v: lab.VARIANTS[v] for v in ("A_vector_rag", "B_mira", "K_biomira_homeostasis")}
    rows, states = lab.run(nodes, edges, queries, gold, A.now(), 2, some)
    table = {(r["variant"], r["step"], r["task"]): r for r in rows.collect()}
    assert {k[0] for k in table} == some.keys() and {(s, t) for _, s, t in table} <= {(0, 0), (1, 0), (1, 1)}
    for variant, runs in (("A_vector_rag", retrieval.vector_topk(nodes, queries, 8)), ("B_mira", retrieval.retrieve(nodes, edges, queries, A.now()))):
        per = retrieval_means(runs, gold, queries)
        assert {t: round(m, 6) for t, m in per.items()} == {t: table[variant, 1, t]["mrr"] for t in per}
    last = {(r["step"], r["world"], r["id"]): r for r in states.collect()}
    still, moving = ("still", some["K_biomira_homeostasis"].world)
    base = {r["id"]: r["importance"] for r in nodes.select("id", "importance").collect()}
    assert all(r["importance"] == base[i] and r["last_decay_at"] is None for (_, w, i), r in last.items() if w == still)
    first = {i: r for (s, w, i), r in last.items() if w == moving and s == 0}
    then = {i: r for (s, w, i), r in last.items() if w == moving and s == 1}
    assert first.keys() < then.keys() and any(then[i]["importance"] < r["importance"] for i, r in first.items()) and any(r["access_count"] for r in first.values())


def retrieval_means(runs, gold, queries):
    want, task, ranks = {}, {r["query_id"]: r["task"] for r in queries.select("query_id", "task").collect()}, {}
    for r in gold.collect():
        want.setdefault(r["query_id"], set()).add(r["id"])
    for r in runs.collect():
        if r["id"] in want.get(r["query_id"], ()):
            ranks[r["query_id"]] = min(ranks.get(r["query_id"], 99), r["rank"])
    out = {}
    for q, t in task.items():
        out.setdefault(t, []).append(1 / ranks[q] if q in ranks else 0.0)
    return {t: sum(x) / len(x) for t, x in out.items()}


def test_leading_nodes_give_the_rankings_of_all_candidates(spark):
    """What only words lead to is cut down to what can rank, so its rows do not grow with nodes; rankings stay."""
    from mnemograph.plans.graph_queries import _queries

    n, e, q, now = A.nodes(spark, SMALL), A.edges(spark, SMALL), _queries(spark, SMALL), A.now()
    sets = retrieval.ABLATIONS
    on = retrieval.ground(n, e, q)
    every = retrieval.scored_candidates(n, e, q, now, on).cache()
    few = retrieval.scored_candidates(n, e, q, now, on, [(s, retrieval.WEIGHTS) for s in sets.values()], 3).cache()
    words = lambda d: d.where("channel = 3").count()
    assert words(few) <= q.count() * len(sets) * 6 and words(few) < words(every)
    for names in sets.values():
        rows = lambda d: sorted((r["query_id"], r["rank"], r["id"], r["score"]) for r in retrieval.rank_scored(d, names, 3).collect())  # noqa: E731,B023
        assert rows(few) == rows(every)


def test_audits_rank_what_can_rank_and_count_the_rest(spark, monkeypatch):
    """F8: rows that only words lead to are counted where they are met, neither ranked nor spelled out; the audit stays."""
    from mnemograph.plans.graph_queries import _queries

    n, e, q, now, names = A.nodes(spark, SMALL), A.edges(spark, SMALL), _queries(spark, SMALL), A.now(), tuple(retrieval.WEIGHTS)
    every = retrieval.scored_candidates(n, e, q, now).cache()
    rows = lambda d: sorted(map(tuple, d.collect()), key=repr)
    want, sources = rows(retrieval.audit(every, names, 3, sources=n.select("id", F.col("concept").alias("source")))), n.select("id", F.col("concept").alias("source"))
    ranked = []
    monkeypatch.setattr(retrieval, "audit", lambda scored, *a, audit=retrieval.audit, **b: ranked.append(scored.where("channel = 3").count()) or audit(scored, *a, **b))
    assert rows(retrieval.retrieve_audit(n, e, q, now, k=3, sources=sources)) == want
    assert ranked[0] <= q.count() * 6 and ranked[0] < every.where("channel = 3").count()
    catalog.queries()["retrieve_audit"](spark, SMALL)
    assert len(ranked) == 2
    bare = q.drop("query")
    assert rows(retrieval.retrieve_audit(n, e, bare, now, k=3)) == rows(retrieval.audit(retrieval.scored_candidates(n, e, bare, now), names, 3))


def test_words_lead_to_rows_without_a_join_and_weights_without_rows(spark):
    """streamed pairs, sums and counts equal joined candidates, and no pair that only words lead to is written."""
    from mnemograph.plans.graph_queries import _queries

    n, e, now = A.nodes(spark, SMALL), A.edges(spark, SMALL), A.now()
    q = _queries(spark, SMALL).withColumnRenamed("query_label", "label")
    on = retrieval.ground(n, e, q)
    joined = retrieval.components(retrieval.candidates(n, e, q, on=on), n, e, q, now, on=on).cache()
    scored = retrieval.scored_candidates(n, e, q, now, on)
    assert "Join" not in scored._jdf.queryExecution().executedPlan().toString()
    rows = lambda d: sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in d.collect()), key=repr)
    assert rows(scored) == rows(joined)
    gold = q.select("query_id", "label").join(n.select("id", "label"), "label").select("query_id", "id")
    assert experiments.world_weights(n, e, q, "label", now, 2) == pytest.approx(experiments.learned_weights(joined, gold, 2))
    count = joined.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.max("semantic").alias("semantic"))
    assert rows(retrieval.evidence(n, e, q, now)) == rows(count)


def test_kernels_of_all_pairs_are_not_shuffled(spark):
    """pairs come out of products for each piece of nodes; the only shuffle is by node."""
    rng = random.Random(4)
    of = lambda name: [(name, c, rng.random()) for c in rng.sample(range(9), 3)]
    asked = spark.createDataFrame([r for i in range(7) for r in of(i)], "query_id long, cid long, w double")
    members = spark.createDataFrame([r for i in range(40) for r in of(f"n{i:02}")], "id string, cid long, w double")
    pairs = asked.select("query_id", "cid").join(members.select("id", "cid"), "cid").select("query_id", "id").distinct()
    for amplitudes in (False, True):
        got = placement.overlap(asked, members, amplitudes)
        assert got._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
        want = placement.overlap(asked, pairs.join(members, "id"), amplitudes, ["query_id", "cid"])
        rows = lambda d: sorted((r["query_id"], r["id"], round(r["kernel"], 9)) for r in d.collect())
        assert rows(got) == rows(want) and got.count() == pairs.count()
