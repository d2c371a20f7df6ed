"""What grows with the input stays spread over tasks and small in each."""

import random
from pathlib import Path

from pyspark.sql import functions as F

from mnemograph.functions import text as T
from mnemograph.operators import history, ingest, versions
from mnemograph.plans import world_queries


def test_pairs_of_a_crowded_subject_are_dealt_over_tasks(spark):
    rows = [(f"v{i:05}", "fact", f"Sky is {i % 3}") for i in range(900)] + [(f"w{i}", "event", f"Sea {i % 40} is {i % 7}") for i in range(200)] + [("x1", "fact", "Sand is dry"), ("x2", "fact", "Sand is dry"), ("x3", "concept", "Sky is 9")]
    nodes = spark.createDataFrame(rows, "id string, memory_type string, raw_text string").withColumn("concept", F.lit(""))
    facts = [(i, *_said(t)) for i, kind, t in rows if kind != "concept"]
    want = sorted((s, a, b, x, y) for a, s, x in facts for b, r, y in facts if s == r and a < b and x != y)
    versions.TASK_PAIRS, whole = 10_000, versions.TASK_PAIRS
    try:
        got = versions.conflicting_pairs(nodes, 100)
        parts = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        versions.TASK_PAIRS = whole
    assert sorted(map(tuple, got.collect())) == want and len(want) > 270_000
    assert len(parts) > 20 and max(parts) < len(want) / 3


def _said(text):
    return tuple(x.strip().lower() for x in text.split(" is "))


def _sent_to_python(df):
    """Bytes that the nodes of a plan send to Python."""
    out, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        out += p.metrics().apply("pythonDataSent").value() if p.metrics().contains("pythonDataSent") else 0
        todo += [p.children().apply(i) for i in range(p.children().size())]
    return out


def test_chunks_send_no_texts_to_python(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abé漢😀 \u0085　", k=rng.randint(1, 30)))
    texts = [None, "", "  ", "  ", "short  ", "x" * 1700, "　" * 900] + [rng.choice(("", "\t", " ")).join(word() + rng.choice((". ", ".  ", "! ", " ", ".\n")) for _ in range(rng.randint(1, 300))) for _ in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc long, text string")
    parts = {r["doc"]: r["p"] for r in docs.select("doc", T.sentences(F.col("text")).alias("p")).collect()}
    got = ingest.chunk(docs, "doc", 200, 30)
    want = [(i, k, c) for i, t in enumerate(texts) for k, c in enumerate(ingest.pack_sentences(t or "", parts[i] or [], 200, 30))]
    rows = got.collect()
    assert sorted(map(tuple, rows)) == want and len(want) > 500
    assert 0 < _sent_to_python(got) < sum(len((t or "").encode()) for t in texts) / 4


def test_histories_are_dealt_by_size_and_hold_wanted_fields_only(spark):
    log = history.log_of(spark.createDataFrame([(f"n{i % 40}", i * 7919 % 1000, i, "create" if i % 9 == 0 else "merge" if i % 3 else "update", f"t{i}", f"c{i % 7}", i * 37 % 100 / 100) for i in range(3_000)], "id string, t long, seq long, action string, raw_text string, c string, importance double")
                         .withColumns({"at": F.timestamp_seconds("t"), "source_ids": F.array("c")}))
    history.TASK_ROWS, whole = 300, history.TASK_ROWS
    try:
        some = history.history(log, ("importance",))
    finally:
        history.TASK_ROWS = whole
    dealt = [r["count"] for r in some.groupBy(F.spark_partition_id()).count().collect()]
    assert len(dealt) > 5 and max(dealt) < 1_200
    pick = lambda h: sorted((r["id"], r["version"], r["action"], r["valid_from"], r["valid_to"], r["before"] and r["before"]["importance"], r["importance"]) for r in h.collect())
    assert pick(some) == pick(history.history(log)) and some.columns[-2:] == ["before", "importance"]
    assert "collect_list" not in some._jdf.queryExecution().optimizedPlan().toString()


def test_question_files_are_written_by_several_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(world_queries, "_TASK_RECORDS", 256, raising=False)
    for n in (3_000, 2, 0):
        folder = f"{tmp_path}/{n}"
        spark.range(n).select(F.col("id").alias("doc_id"), F.concat_ws("\n", F.lit("one"), F.lit("two"), F.lit("three")).alias("text"), F.lit("web").alias("source")).write.parquet(f"{folder}/documents.parquet")
        for kind, path in world_queries._question_files(spark, folder).items():
            files = [f.name for f in Path(path).rglob("*.txt") if f.stat().st_size]
            assert len(files) == (12 if n == 3_000 else 0) or n == 2 and len(files) < 2
            assert n < 3_000 or len({f.split("-")[1] for f in files}) > 3
        got = {r["question"]: (r["kind"], r["n_ids"], r["first"]) for r in world_queries.resolve_questions(spark, folder).collect()}
        assert len(got) == n and all(got[f"q{i}"] == ("hotpotqa", 2, f"n{i}#0") for i in range(1, n, 4)) and all(got[f"q{i}"] == ("custom", 1, f"x{i}") for i in range(0, n, 4))
