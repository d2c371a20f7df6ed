"""Queries over stored, changing worlds: the vector index, histories, ageing, ladders."""

from __future__ import annotations

import math
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..operators import answers, benchmarks, evaluation, experiments, graph, history, lab, placement, retrieval, vector_index, worlds
from ..operators.durable import cut, shared_folder
from ..sources import questions, results
from . import adapters as A
from .catalog import query
from .graph_queries import _CANDS, _FULL, _HITS, _queries, _score_sql
from .store_queries import _corpus

# Rows that the index begins with, gets later, loses, and gets a new vector for, by number.
_BEGIN, _LATER, _LOST, _TURNED = "num % 5 <> 0", "num % 5 = 0", "num % 7 = 3", "num % 11 = 4 and num % 7 <> 3"


def _index(spark: SparkSession, sf_dir: str) -> vector_index.VectorIndex:
    """An index after a mix of operations."""
    nodes = A.nodes(spark, sf_dir).select("id", "num", "embedding")
    index = vector_index.VectorIndex(spark, f"{shared_folder(spark)}/index-{uuid.uuid4().hex}", len(nodes.first()["embedding"]))
    index.rebuild(nodes.where(_BEGIN))
    index.upsert(nodes.where(_LATER))
    index.delete(nodes.where(_LOST))
    index.compact()
    index.upsert(nodes.where(_TURNED).withColumn("embedding", F.reverse("embedding")))
    index.delete(nodes.where(_LOST))
    return index


@query("vector_index_topk", f"""WITH {A.NODES}, live AS (SELECT id, CASE WHEN {_TURNED} THEN list_reverse(embedding) ELSE embedding END AS e FROM nodes WHERE NOT ({_LOST})),
q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % {A.EVERY} = 0),
cos AS (SELECT query_id, id, round(list_dot_product(v, e) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(e, e))), 6) AS score FROM q, live)
SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM cos QUALIFY rank <= 8""")  # fmt: skip
def vector_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir).search(A.vector_queries(spark, sf_dir), 8)


@query("vector_index_rows", f"""WITH {A.NODES} SELECT id, round(CASE WHEN {_TURNED} THEN embedding[-1] ELSE embedding[1] END, 6) AS first FROM nodes WHERE NOT ({_LOST})""")
def vector_index_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir).live().select("id", F.round(F.col("embedding")[0], 6).alias("first"))


# What each type of event does to the node of its user.
_ACTS = {"signup": "create", "view": "merge", "click": "update", "error": "invalidate", "purchase": "restore"}


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, i = A.table(spark, sf_dir, "events"), F.col("event_id")
    act = F.coalesce(*[F.when(F.col("event_type") == k, F.when(i % 4 == 0, "archive").otherwise(v) if v == "restore" else F.lit(v)) for k, v in _ACTS.items()])
    brings = act.isin("create", "merge") | (i % 3 == 0)
    rows = e.select(
        F.concat(F.lit("u"), F.col("user_id")).alias("id"), F.col("ts").alias("at"), i.alias("seq"), act.alias("action"), F.when(brings, F.concat(F.lit("e"), i)).alias("raw_text"),
        F.when(i % 2 == 0, F.concat(F.lit("s"), i % 9)).alias("summary"), F.when(brings, F.array(F.concat(F.lit("c"), i % 7))).alias("source_ids"),
        F.when(i % 5 != 0, i * 37 % 100 / 100).alias("importance"), F.when(i % 6 != 0, i * 29 % 100 / 100).alias("confidence"), F.concat(F.lit("r"), i % 4).alias("reason"),
    )
    return history.log_of(rows)


_LOG = f"""log AS (SELECT 'u' || user_id AS id, ts AS tm, event_id AS i, CASE event_type {" ".join(f"WHEN '{k}' THEN " + (f"CASE WHEN event_id % 4 = 0 THEN 'archive' ELSE '{v}' END" if v == "restore" else f"'{v}'") for k, v in _ACTS.items())} END AS act FROM events),
rows_ AS (SELECT *, CASE WHEN act IN ('create', 'merge') OR i % 3 = 0 THEN 'e' || i END AS raw_text, CASE WHEN i % 2 = 0 THEN 's' || i % 9 END AS summary, CASE WHEN act IN ('create', 'merge') OR i % 3 = 0 THEN 'c' || i % 7 END AS src,
  CASE WHEN i % 5 <> 0 THEN (i * 37 % 100)::DOUBLE / 100 END AS importance, CASE WHEN i % 6 <> 0 THEN (i * 29 % 100)::DOUBLE / 100 END AS confidence FROM log)"""

_AT = "2024-01-16 12:00:00"


@query("node_history_as_of", f"""WITH {_LOG}, r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY tm, i) AS k FROM rows_ WHERE tm <= TIMESTAMP '{_AT}'),
b AS (SELECT id, max(k) FILTER (act = 'create') AS born, min(k) FILTER (act = 'create') AS first, max(k) FILTER (act = 'create' OR act = 'update' AND raw_text IS NOT NULL) AS kt, max(k) FILTER (act = 'create' OR act = 'update' AND importance IS NOT NULL) AS ki,
  max(k) FILTER (act = 'create' OR act = 'update' AND confidence IS NOT NULL) AS kc, max(k) FILTER (act IN ('archive', 'restore', 'create')) AS ka, max(k) FILTER (act IN ('invalidate', 'restore', 'create')) AS ke,
  max(k) FILTER (act = 'create' OR act IN ('update', 'merge') AND summary IS NOT NULL) AS ks FROM r GROUP BY 1),
l AS (SELECT r.id, max(r.k) FILTER (r.act = 'invalidate' AND r.k > kc) AS low FROM r JOIN b USING (id) GROUP BY 1)
SELECT id, (max(k) - min(first) + 1)::BIGINT AS version, trim(string_agg(raw_text, chr(10) ORDER BY k) FILTER (k >= kt AND act IN ('create', 'update', 'merge') AND (k = kt OR act = 'merge')), chr(10)) AS raw_text, max(summary) FILTER (k = ks) AS summary,
  array_to_string(list_sort(list_distinct(list(src) FILTER (k >= kt AND (k = kt OR act = 'merge') AND src IS NOT NULL))), ',') AS sources,
  coalesce(max(importance) FILTER (k >= ki AND (k = ki OR act = 'merge')), 0) AS importance,
  CASE WHEN min(low) IS NULL THEN coalesce(max(confidence) FILTER (k >= kc AND (k = kc OR act = 'merge')), 0)
    ELSE greatest(least(0.2::DOUBLE, coalesce(max(confidence) FILTER (k >= kc AND k < low AND (k = kc OR act = 'merge')), 0)), coalesce(max(confidence) FILTER (k > low AND act = 'merge'), 0)) END AS confidence,
  bool_or(k = ka AND act = 'archive') AS archived, max(tm) FILTER (k = ke AND act = 'invalidate') AS ended_at
FROM r JOIN b USING (id) LEFT JOIN l USING (id) WHERE born IS NOT NULL AND k >= first GROUP BY id""")  # fmt: skip
def node_history_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user's node as it was in the middle of the month."""
    then = history.as_of(history.history(_log(spark, sf_dir)), F.lit(_AT).cast("timestamp"))
    return then.select("id", "version", "raw_text", "summary", F.array_join("source_ids", ",").alias("sources"), "importance", "confidence", "archived", "ended_at")


@query("node_history_changes", f"""WITH {_LOG}, r AS (SELECT *, sum((act = 'create')::INT) OVER w AS life, sum((act = 'create' OR act = 'update' AND importance IS NOT NULL)::INT) OVER w AS era FROM rows_ WINDOW w AS (PARTITION BY id ORDER BY tm, i)),
s AS (SELECT id, tm, i, act, coalesce(max(CASE WHEN act IN ('create', 'update', 'merge') THEN importance END) OVER (PARTITION BY id, era ORDER BY tm, i), 0) AS importance FROM r WHERE life > 0)
SELECT id, row_number() OVER v AS version, act AS action, tm AS valid_from, lead(tm) OVER v AS valid_to, lag(importance) OVER v AS before, importance AS after FROM s WINDOW v AS (PARTITION BY id ORDER BY tm, i)""")  # fmt: skip
def node_history_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every change of every node, with the importance before and after it."""
    h = history.history(_log(spark, sf_dir), ("importance",))
    return h.select("id", "version", "action", "valid_from", "valid_to", F.col("before.importance").alias("before"), F.col("importance").alias("after"))


def _incoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A statement for every second node: the same, or another one of its subject."""
    n, i = A.nodes(spark, sf_dir).where("num % 2 = 1"), F.col("num")
    return n.select(F.concat(F.lit("new-"), "id").alias("id"), F.col("id").alias("target"), F.concat(F.lit("topic "), i % 50, F.lit(" is "), (i + i % 3) % 7).alias("raw_text"), F.col("summary"),
                    F.array(F.concat(F.lit("c"), i % 7)).alias("source_ids"), (i * 41 % 97 / 97).alias("importance"), (i * 31 % 89 / 89).alias("confidence"))


_MERGE = f"""WITH {A.NODES}, n AS (SELECT *, num % 3 <> 0 AS clash, (num * 41 % 97)::DOUBLE / 97 AS imp, (num * 31 % 89)::DOUBLE / 89 AS conf,
  0.2::DOUBLE * confidence + 0.15::DOUBLE * greatest(0, 1 - date_diff('second', updated_at, TIMESTAMP '{A.NOW}') / (86400.0 * 30))::DOUBLE AS was, 0.2::DOUBLE * (num * 31 % 89)::DOUBLE / 89 + 0.15::DOUBLE AS would FROM nodes WHERE num % 2 = 1)"""


@query("merge_plan", f"""{_MERGE}
SELECT CASE WHEN clash THEN 'new-' || id ELSE id END AS id, CASE WHEN clash THEN 'create' ELSE 'merge' END AS action, round(imp, 6) AS importance, NULL::VARCHAR AS reason FROM n
UNION ALL SELECT id, 'supersede', NULL, 'superseded_by:new-' || id FROM n WHERE clash AND would - was > 1e-9""")  # fmt: skip
def merge_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    log, _ = history.plan_merges(A.nodes(spark, sf_dir), _incoming(spark, sf_dir), A.now())
    return log.select("id", "action", F.round("importance", 6).alias("importance"), "reason")


@query("split_history", f"""WITH {A.NODES}, n AS (SELECT * FROM nodes WHERE num % 9 = 0)
SELECT id, 2::BIGINT AS version, 'split' AS action, raw_text, 'two topics' AS reason FROM n UNION ALL SELECT id, 1, 'create', raw_text, NULL FROM nodes
UNION ALL SELECT id || '-' || k, 1, 'create', CASE k WHEN 1 THEN concept ELSE summary END, NULL FROM n, range(1, 3) r(k)""")  # fmt: skip
def split_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of nodes of which every ninth is split in two, as history."""
    nodes = A.nodes(spark, sf_dir)
    log = history.log_of(nodes.select("id", "raw_text", "summary", "importance", "confidence").withColumns({"action": F.lit("create"), "at": F.lit("2024-01-01").cast("timestamp")}))
    some = nodes.where("num % 9 = 0")
    parts = some.select(F.col("id").alias("whole"), F.lit("two topics").alias("reason"), "importance", "confidence", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(c).alias("raw_text")) for k, c in ((1, "concept"), (2, "summary"))])).alias("p"))
    parts = parts.select("whole", "reason", "importance", "confidence", F.concat_ws("-", "whole", F.col("p.k").cast("string")).alias("id"), "p.raw_text")
    more, _ = history.plan_splits(nodes, parts, A.now())
    return history.history(log.unionByName(more)).select("id", "version", "action", "raw_text", "reason")


_AGE = f"greatest(0, epoch_us(TIMESTAMP '{A.NOW}') - epoch_us(updated_at)) / 86400e6::DOUBLE"
_LEFT = f"exp(-{_AGE} / (21.0::DOUBLE / ln(2::DOUBLE) * (1 + 0.5::DOUBLE * least(coalesce(records, 0) / 8.0::DOUBLE, 1) * confidence)))"
# the nodes as an arm of the study has them
_OLDER = f"""{A.NODES.replace("nodes AS (", "young AS (", 1)}, {A.EDGES.replace("FROM nodes", "FROM young").replace("JOIN nodes", "JOIN young")}, {A.PAIRS},
gold AS (SELECT num AS query_id, dst AS id FROM young JOIN sym ON src = id WHERE num % {A.EVERY} = 0),
old AS (SELECT id FROM young WHERE md5('42:' || id) < '{int(0.8 * 16**8):08x}'), used AS (SELECT DISTINCT id FROM gold SEMI JOIN old USING (id) WHERE md5('43:' || id) < '{16**8 // 2:08x}'),
inc AS (SELECT id, count(*) AS records FROM (SELECT source_id AS id FROM edges UNION ALL SELECT target_id FROM edges) GROUP BY 1),
elder AS (SELECT young.* REPLACE (CASE WHEN old.id IS NOT NULL THEN TIMESTAMP '{A.NOW}' - INTERVAL 60 DAY ELSE updated_at END AS updated_at), records, used.id IS NOT NULL AS used FROM young LEFT JOIN old USING (id) LEFT JOIN used USING (id) LEFT JOIN inc USING (id)),
fading AS (SELECT *, {_LEFT} AS r FROM elder)"""
_ARM = {
    "before": "nodes AS (SELECT * FROM young)",
    "after": f"""nodes AS (SELECT * EXCLUDE (r, records, used) REPLACE (
  CASE WHEN used THEN round(least(0.98::DOUBLE, importance + 0.06::DOUBLE * (1.2::DOUBLE - importance)), 4) WHEN r < 0.999 THEN round(greatest(importance * r, importance * 0.15::DOUBLE, 0.05), 4) ELSE importance END AS importance,
  CASE WHEN used THEN TIMESTAMP '{A.NOW}' WHEN r < 0.999 THEN updated_at ELSE (SELECT y.updated_at FROM young y WHERE y.id = fading.id) END AS updated_at) FROM fading)""",
}
_RANKED = {
    n: f"""SELECT query_id, count(*) FILTER (hit) AS hits, min(rank) FILTER (hit) AS first FROM (WITH RECURSIVE {_OLDER}, {arm}, {_CANDS},
  sc AS (SELECT query_id, id, round({_score_sql(tuple(retrieval.WEIGHTS))}, 9) AS score FROM comp)
  SELECT sc.query_id, sc.id, row_number() OVER (PARTITION BY sc.query_id ORDER BY score DESC, sc.id) AS rank, gold.id IS NOT NULL AS hit FROM sc LEFT JOIN gold ON gold.query_id = sc.query_id AND gold.id = sc.id) WHERE rank <= 8 GROUP BY 1"""
    for n, arm in _ARM.items()
}


def _near_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, id: what a query is to find are the neighbours of the node that it asks with."""
    own = A.nodes(spark, sf_dir).where(F.col("num") % A.EVERY == 0).select(F.col("num").alias("query_id"), F.col("id").alias("src"))
    return own.join(graph.symmetric(graph.pairs(A.edges(spark, sf_dir))), "src").select("query_id", F.col("dst").alias("id"))


@query("ageing_study", f"""WITH a AS ({_RANKED["before"]}), b AS ({_RANKED["after"]}), {_OLDER},
w AS (SELECT query_id, count(*) AS w, CASE WHEN bool_or(used.id IS NOT NULL) THEN 'aged_replayed' WHEN bool_or(old.id IS NOT NULL) THEN 'aged_faded' ELSE 'recent' END AS cohort FROM gold LEFT JOIN old USING (id) LEFT JOIN used USING (id) GROUP BY 1),
m AS (SELECT cohort, coalesce(1 / a.first, 0) AS m0, coalesce(1 / b.first, 0) AS m1, a.hits / w AS r0, b.hits / w AS r1 FROM w JOIN a USING (query_id) JOIN b USING (query_id))
SELECT cohort, count(*) AS n, round(avg(m0), 6) AS mrr_before, round(avg(m1), 6) AS mrr_after, round(avg(r0), 6) AS recall_before, round(avg(r1), 6) AS recall_after, round(avg(m1 - m0), 6) AS mrr_change, round(avg(r1 - r0), 6) AS recall_change FROM m GROUP BY 1""")  # fmt: skip
def ageing_study(spark: SparkSession, sf_dir: str) -> DataFrame:
    return worlds.ageing(A.nodes(spark, sf_dir), A.edges(spark, sf_dir), _queries(spark, sf_dir), _near_gold(spark, sf_dir), A.now())


# The shares of a world that rungs hold.
_SHARES = [0.05, 0.15, 0.4, 1.0]


@query("ladder_rungs", f"""WITH {A.NODES}, {A.EDGES}, {A.PAIRS}, s AS (SELECT unnest({_SHARES}::DOUBLE[]) AS share),
k AS (SELECT share, id FROM nodes, s WHERE share >= 1 OR md5('42:' || num // 10) < lpad(to_hex(floor(share * 4294967296)::BIGINT), 8, '0')),
h AS (SELECT k.share, dst AS id FROM k JOIN sym ON src = k.id GROUP BY ALL HAVING count(*) >= 2), m AS (SELECT * FROM k UNION SELECT * FROM h),
e AS (SELECT a.share, count(*) AS edges FROM edges JOIN m a ON a.id = source_id JOIN m b ON b.id = target_id AND b.share = a.share GROUP BY 1)
SELECT share, count(*) AS nodes, coalesce(any_value(edges), 0) AS edges FROM m LEFT JOIN e USING (share) GROUP BY 1""")  # fmt: skip
def ladder_rungs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How large the nested parts of the world are; ten nodes are a group."""
    nodes = A.nodes(spark, sf_dir).withColumn("batch", F.floor(F.col("num") / 10))
    members, wires = worlds.rungs(nodes, A.edges(spark, sf_dir), "batch", _SHARES)
    counted = wires.groupBy("share").agg(F.count(F.lit(1)).alias("edges"))
    return members.groupBy("share").agg(F.count(F.lit(1)).alias("nodes")).join(counted, "share", "left").withColumn("edges", F.coalesce("edges", F.lit(0)))


@query("scale_ladder")
def scale_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All strategies over nested parts of the world; questions are its nodes of three neighbours and more, every tenth of them."""
    parent = F.when(F.col("num") > 0, F.concat(F.lit("v"), F.lpad(F.floor(F.col("num") / 8).cast("string"), 8, "0")))
    nodes = A.nodes(spark, sf_dir).withColumns({"parent_id": parent, "batch": F.floor(F.col("num") / 10)})
    asked = nodes.where("num % 10 = 0").select(F.col("num").alias("query_id"), "id", F.col("embedding").alias("vector"), F.col("concept").alias("query"))
    return worlds.ladder(nodes, A.edges(spark, sf_dir), asked, A.now(), "batch", _SHARES, placement.STRATEGIES, least_degree=3)


#: Tasks of the lab; a node's task, and a query's, comes from its label.
_TASKS = 3


@query("forgetting_variants")
def forgetting_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All variants of the lab over tasks that are learned one after the other."""
    nodes = A.nodes(spark, sf_dir).withColumn("task", F.col("label") % _TASKS)
    queries = _queries(spark, sf_dir).withColumn("task", F.col("query_label") % _TASKS).drop("query_label")
    rows, _ = lab.run(nodes, A.edges(spark, sf_dir), queries, _near_gold(spark, sf_dir), A.now(), _TASKS)
    return rows


@query("answers_widened", f"""WITH RECURSIVE {A.NODES}, {A.EDGES}, {A.PAIRS}, {_CANDS}, sc AS (SELECT query_id, id, round({_score_sql(tuple(retrieval.WEIGHTS))}, 9) AS score FROM comp),
rk AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM sc QUALIFY rank <= 32),
t AS (SELECT rk.*, CASE WHEN num % 13 = 0 THEN raw_text END AS t FROM rk JOIN nodes USING (id)),
w AS (SELECT query_id, CASE WHEN count(*) FILTER (t IS NOT NULL AND rank <= 8) > 0 OR count(t) = 0 THEN 8 ELSE 32 END AS looked FROM t GROUP BY 1),
d AS (SELECT t.*, looked, row_number() OVER (PARTITION BY query_id, t ORDER BY rank) AS again FROM t JOIN w USING (query_id) WHERE rank <= looked)
SELECT query_id, CASE WHEN count(t) > 0 THEN 'extractive' ELSE 'no_evidence' END AS mode, any_value(looked) AS looked, count(*) AS n_retrieved, coalesce(string_agg(id, ',' ORDER BY rank) FILTER (t IS NOT NULL AND again = 1), '') AS evidence FROM d GROUP BY 1""")  # fmt: skip
def answers_widened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of thirteen nodes one has a text, so most questions need the wider look."""
    n, e, q = A.nodes(spark, sf_dir), A.edges(spark, sf_dir), _queries(spark, sf_dir)
    scored = retrieval.scored_candidates(n, e, q, A.now(), systems=_FULL, k=answers.widest(8)).withColumn("score", N.rounded(retrieval.weighted(tuple(retrieval.WEIGHTS)), 9))
    texts = n.select("id", F.when(F.col("num") % 13 == 0, F.col("raw_text")).alias("text"), "ring", "sector")
    return answers.assemble(scored, texts, q).select("query_id", "mode", "looked", "n_retrieved", F.array_join("evidence", ",").alias("evidence"))


# Documents whose questions a task writes, a file for each 256.
_TASK_RECORDS = 4_096


def _question_files(spark: SparkSession, sf_dir: str) -> dict[str, str]:
    """The documents as question sets of the four published shapes: kind -> folder."""
    d, i = _corpus(spark, sf_dir)[0].select("document_id", "title"), F.col("document_id")
    record = {
        "custom": F.struct("question", "answer", F.array(F.concat(F.lit("x"), i)).alias("supporting_ids")),
        "hotpotqa": F.struct("question", "answer", F.struct(F.array("title").alias("title"), F.array(F.lit(0)).alias("sent")).alias("supporting_facts")),
        "2wiki": F.struct("question", "answer", F.array(F.array(F.upper("title"), F.lit("0")), F.array(F.concat(F.lit("doc-"), i + 4, F.lit(".txt")), F.lit("1"))).alias("supporting_facts")),
        "musique": F.struct("question", "answer", F.array(F.struct(F.col("title"), F.lit(True).alias("is_supporting")), F.struct(F.concat(F.lit("doc-"), i + 4, F.lit(".txt")).alias("title"), F.lit(False).alias("is_supporting"))).alias("supporting_paragraphs")),
    }
    root, out = f"{shared_folder(spark)}/questions-{uuid.uuid4().hex}", {}
    asked = d.withColumns({"question": F.concat(F.lit("q"), i), "answer": F.concat(F.lit("a"), i), "part": F.floor(i / 256)})
    # a file for each set, in one folder, written by as many tasks as the files need
    tasks = max(1, math.ceil(d.count() / _TASK_RECORDS))
    for k, kind in enumerate(questions.KINDS):
        rows = asked.where(i % 4 == k).groupBy("part").agg(F.collect_list(record[kind]).alias("data"))
        text = F.to_json(F.struct("data")) if kind == "musique" else F.to_json("data")
        out[kind] = f"{root}/{kind}"
        rows.select("part", text.alias("value")).repartition(tasks, "part").select("value").write.option("maxRecordsPerFile", 1).text(out[kind])
    return out


@query("resolve_questions", """WITH l AS (SELECT doc_id, unnest(range(len(x))) AS seq, unnest(x) AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)),
n AS (SELECT doc_id, 'n' || doc_id || '#' || seq AS id FROM l WHERE length(t) > 0 AND seq % 2 = 0),
k AS (SELECT doc_id, doc_id AS of FROM documents WHERE doc_id % 4 > 0 UNION ALL SELECT doc_id, doc_id + 4 FROM documents WHERE doc_id % 4 = 2),
r AS (SELECT k.doc_id, count(n.id) AS n, min(n.id) AS first FROM k LEFT JOIN n ON n.doc_id = k.of GROUP BY 1)
SELECT ['custom','hotpotqa','2wiki','musique'][d.doc_id % 4 + 1] AS kind, 'q' || d.doc_id AS question, CASE WHEN d.doc_id % 4 = 0 THEN 1 ELSE coalesce(n, 0) END AS n_ids, CASE WHEN d.doc_id % 4 = 0 THEN 'x' || d.doc_id ELSE first END AS first FROM documents d LEFT JOIN r USING (doc_id)""")  # fmt: skip
def resolve_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question sets of all shapes, read from files, with the nodes of the documents that they name."""
    d, c, n, _ = _corpus(spark, sf_dir)
    titled = d.select("document_id", F.concat(F.lit("Set: "), "title").alias("title"), F.concat(F.lit("files/doc-"), "document_id", F.lit(".txt")).alias("source_path"))
    index = cut(questions.title_index(titled, c, n))
    parts = [questions.resolve(questions.read_questions(spark, path, kind), index).withColumn("kind", F.lit(kind)) for kind, path in _question_files(spark, sf_dir).items()]
    return reduce(DataFrame.unionByName, parts).select("kind", "question", F.size("supporting_ids").cast("long").alias("n_ids"), F.array_min("supporting_ids").alias("first"))


@query("tree_builder", f"""WITH RECURSIVE {A.NODES}, {A.EDGES}, {A.PAIRS}, p AS (SELECT *, CASE WHEN num >= 3 AND num % 40 <> 39 THEN 'v' || lpad((num // 8)::VARCHAR, 8, '0') END AS parent FROM nodes),
r AS (SELECT id, CASE WHEN memory_type IN ('concept', 'entity') THEN 0 ELSE 1 END AS ring FROM p WHERE parent IS NULL UNION ALL SELECT p.id, least(r.ring + 1, 4) FROM p JOIN r ON p.parent = r.id),
n AS (SELECT p.id, r.ring, embedding, updated_at, num FROM p JOIN r USING (id)), h AS (SELECT id, embedding AS e FROM n WHERE ring <= 1),
s AS (SELECT n.id, max(round(list_dot_product(embedding, e), 9)) AS near FROM n JOIN h ON h.id <> n.id GROUP BY 1), d AS (SELECT src AS id, count(*)::DOUBLE / ((SELECT count(*) FROM nodes) - 1) AS c FROM sym GROUP BY 1)
SELECT id, ring, round(0.4::DOUBLE * (1 - near) + 0.25::DOUBLE * CASE ring WHEN 0 THEN 4 ELSE ring END / 4 + 0.2::DOUBLE * (1 - least(1, 5 * coalesce(c, 0))) + 0.15::DOUBLE * least(1, {_AGE} / 30), 4) AS radial_distance FROM n JOIN s USING (id) LEFT JOIN d USING (id)""")  # fmt: skip
def tree_builder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other builder over a tree in which some branches hang from nothing."""
    up = F.when((F.col("num") >= 3) & (F.col("num") % 40 != 39), F.concat(F.lit("v"), F.lpad(F.floor(F.col("num") / 8).cast("string"), 8, "0")))
    return placement.build(A.nodes(spark, sf_dir).withColumn("parent_id", up), A.edges(spark, sf_dir), A.now()).select("id", "ring", "radial_distance")


@query("stored_results", f"""WITH {A.NODES}, {A.EDGES}, {A.PAIRS}, {_HITS}, gold AS (SELECT num AS query_id, dst AS id FROM nodes JOIN sym ON src = id WHERE num % {A.EVERY} = 0), w AS (SELECT query_id, count(*) AS w FROM gold GROUP BY 1),
runs AS (SELECT 'vector_' || k AS system, query_id, id, rank, k FROM hits, (VALUES (4), (8), (16)) v(k) WHERE rank <= k),
m AS (SELECT system, query_id, k, count(gold.id) AS hits, min(rank) FILTER (gold.id IS NOT NULL) AS first FROM runs LEFT JOIN gold USING (query_id, id) GROUP BY ALL)
SELECT system, count(*) AS n, round(avg(coalesce(hits / w, 0)), 4) AS recall, round(avg(coalesce(1 / first, 0)), 4) AS mrr, count(*) AS n_scored_recall, count(*) AS n_scored_mrr FROM m LEFT JOIN w USING (query_id) GROUP BY 1""")  # fmt: skip
def stored_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs merged one by one into stored results, one of them twice."""
    n, q, gold = A.nodes(spark, sf_dir), A.vector_queries(spark, sf_dir), _near_gold(spark, sf_dir)
    hits, kept = cut(retrieval.vector_topk(n, q, 16)), results.Results(spark, f"{shared_folder(spark)}/results-{uuid.uuid4().hex}")
    for k, name in ((4, 4), (4, 8), (16, 16), (8, 8)):
        kept.merge(f"vector_{name}", evaluation.ranking_metrics(hits, gold, k))
    return kept.table(["recall", "mrr"])


def _node_tree(nodes: DataFrame) -> DataFrame:
    parent = F.when(F.col("num") >= 5, F.concat(F.lit("v"), F.lpad(F.floor(F.col("num") / 5).cast("string"), 8, "0")))
    return nodes.select("id", parent.alias("parent_id"), F.when(F.col("num") < 5, 0).when(F.col("num") < 25, 1).otherwise(2).alias("ring"), F.col("concept").alias("label"))


_TREE_RUN = """tree AS (SELECT id, CASE WHEN num >= 5 THEN 'v' || lpad((num // 5)::VARCHAR, 8, '0') END AS p, concept AS label, CASE WHEN num < 5 THEN 0 WHEN num < 25 THEN 1 ELSE 2 END AS ring FROM nodes),
tw AS (SELECT id, unnest(list_distinct(regexp_extract_all(lower(label), '[a-z0-9]{3,}'))) AS w FROM tree WHERE ring <= 1), th AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY count(*) DESC, id) AS r FROM tq JOIN tw USING (w) GROUP BY query_id, id QUALIFY r <= 3),
tk AS (SELECT id, p AS up, row_number() OVER (PARTITION BY p ORDER BY id) AS p FROM tree WHERE p IS NOT NULL), tf AS (SELECT query_id, tk.id, r, p, 0 AS g FROM th JOIN tk ON tk.up = th.id WHERE p <= 8),
ts AS (SELECT query_id, id, r, p, g FROM tf UNION ALL SELECT tf.query_id, tk.id, tf.r, tf.p, tk.p FROM tf JOIN tk ON tk.up = tf.id WHERE tk.p <= 2), tm AS (SELECT query_id, id, min((r, p, g)) AS spot FROM ts GROUP BY ALL)"""
_BM25_RUN = r"""bd AS (SELECT id, lower(concat_ws(' ', concept, summary, raw_text)) AS t FROM nodes), bp AS (SELECT id, unnest(regexp_extract_all(t, '[\p{L}\p{N}_]+')) AS term FROM bd), btf AS (SELECT id, term, count(*) AS tf FROM bp GROUP BY ALL),
bl AS (SELECT id, sum(tf) AS dl FROM btf GROUP BY 1), bg AS (SELECT count(*) AS n, avg(dl) AS av FROM bl), bdf AS (SELECT term, count(*) AS df FROM btf GROUP BY 1), bq AS (SELECT query_id, unnest(regexp_extract_all(lower(query), '[\p{L}\p{N}_]+')) AS term FROM qt),
bs AS (SELECT query_id, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / av))), 4) AS score FROM (SELECT query_id, term FROM bq) JOIN btf USING (term) JOIN bdf USING (term) JOIN bl USING (id), bg GROUP BY ALL)"""
_SEEDS = [1, 2, 3]


@query("systems_over_seeds", f"""WITH {A.NODES}, {A.EDGES}, {A.PAIRS}, {_HITS}, qt AS (SELECT vec_id AS query_id, 'topic ' || label || ' of group ' || vec_id % 7 AS query FROM embeddings WHERE vec_id % {A.EVERY} = 0),
tq AS (SELECT query_id, unnest(list_distinct(regexp_extract_all(lower(query), '[a-z0-9]{{3,}}'))) AS w FROM qt), {_TREE_RUN}, {_BM25_RUN}, h AS (SELECT * FROM hits WHERE rank <= 8), d AS (SELECT src AS id, count(*) AS degree FROM sym GROUP BY 1),
n AS (SELECT DISTINCT query_id, dst AS id FROM h JOIN sym ON src = h.id WHERE rank <= 3), u AS (SELECT query_id, id, score FROM h UNION ALL SELECT n.query_id, n.id, 0.5 * least(1.0, degree / 5.0) FROM n JOIN d USING (id) ANTI JOIN h ON h.query_id = n.query_id AND h.id = n.id),
runs AS (SELECT 'flat_vector' AS system, query_id, id, rank FROM h UNION ALL SELECT 'graph_rag', query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) FROM u
  UNION ALL SELECT 'bm25', query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) FROM bs UNION ALL SELECT 'hierarchical', query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY spot, id) FROM tm),
gold AS (SELECT num AS query_id, dst AS id FROM nodes JOIN sym ON src = id WHERE num % {A.EVERY} = 0), w AS (SELECT query_id, count(*) AS w FROM gold GROUP BY 1),
m AS (SELECT s.system, qt.query_id, count(gold.id) AS hits, min(rank) FILTER (gold.id IS NOT NULL) AS first FROM (SELECT DISTINCT system FROM runs) s CROSS JOIN qt LEFT JOIN runs r ON r.system = s.system AND r.query_id = qt.query_id AND rank <= 8 LEFT JOIN gold ON gold.query_id = r.query_id AND gold.id = r.id GROUP BY ALL),
o AS (SELECT system, seed, avg(coalesce(hits / w, 0)) AS recall, avg(hits / 8) AS precision, avg(coalesce(1 / first, 0)) AS mrr FROM m LEFT JOIN w USING (query_id), (SELECT unnest({_SEEDS}) AS seed) WHERE md5(seed || ':' || query_id) < '80000000' GROUP BY ALL)
SELECT system, count(*) AS seeds, {", ".join(f"round(avg({x}), 6) AS {x}, round(stddev_pop({x}), 6) AS {x}_dev" for x in benchmarks.METRICS)} FROM o GROUP BY 1""")  # fmt: skip
def systems_over_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rankers beside each other, over drawn halves of the questions."""
    n, q = A.nodes(spark, sf_dir), _queries(spark, sf_dir)
    systems = benchmarks.rankers(n, A.edges(spark, sf_dir), q, A.now(), F.concat_ws(" ", "concept", "summary", "raw_text"), _node_tree(n))
    rows, _ = benchmarks.benchmark({s: r for s, r in systems.items() if s != "full"}, _near_gold(spark, sf_dir), q)
    return benchmarks.over_seeds(rows, _SEEDS)


@query("systems_by_language", f"""WITH {A.NODES}, {A.EDGES}, nl AS (SELECT n.*, lang FROM nodes n LEFT JOIN documents ON doc_id = num), {_BM25_RUN.split("bs AS")[0].rstrip().rstrip(",").replace("FROM nodes)", "FROM nl)").split("bl AS")[0].rstrip().rstrip(",")},
q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v, lang, lower('topic ' || label || ' of group ' || vec_id % 7) AS t FROM embeddings LEFT JOIN documents ON doc_id = vec_id WHERE vec_id % {A.EVERY} = 0),
bl AS (SELECT nl.id, lang, coalesce(sum(tf), 0) AS dl FROM nl LEFT JOIN btf USING (id) GROUP BY ALL), bg AS (SELECT lang, count(*) AS n, avg(dl) AS av FROM bl GROUP BY 1), bdf AS (SELECT lang, term, count(*) AS df FROM btf JOIN nl USING (id) GROUP BY ALL),
bs AS (SELECT query_id, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / av))), 4) AS score FROM (SELECT query_id, lang AS ql, unnest(regexp_extract_all(t, '[\p{{L}}\p{{N}}_]+')) AS term FROM q) JOIN btf USING (term) JOIN bl USING (id)
  JOIN bdf ON bdf.term = btf.term AND bdf.lang IS NOT DISTINCT FROM bl.lang JOIN bg ON bg.lang IS NOT DISTINCT FROM bl.lang WHERE bl.lang IS NOT DISTINCT FROM ql GROUP BY ALL),
cos AS (SELECT query_id, id, round(list_dot_product(v, embedding) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(embedding, embedding))), 6) AS score FROM q JOIN nl ON nl.lang IS NOT DISTINCT FROM q.lang),
hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM cos QUALIFY rank <= 8), we AS (SELECT least(source_id, target_id) AS a, greatest(source_id, target_id) AS b FROM edges JOIN nl x ON x.id = source_id JOIN nl y ON y.id = target_id WHERE x.lang IS NOT DISTINCT FROM y.lang AND source_id <> target_id GROUP BY ALL),
sym AS (SELECT a AS src, b AS dst FROM we UNION ALL SELECT b, a FROM we), dg AS (SELECT src AS id, count(*) AS degree FROM sym GROUP BY 1), nb AS (SELECT DISTINCT query_id, dst AS id FROM hits JOIN sym ON src = hits.id WHERE rank <= 3),
u AS (SELECT query_id, id, score FROM hits UNION ALL SELECT nb.query_id, nb.id, 0.5 * least(1.0, degree / 5.0) FROM nb JOIN dg USING (id) ANTI JOIN hits h ON h.query_id = nb.query_id AND h.id = nb.id),
runs AS (SELECT 'flat_vector' AS system, query_id, id, rank FROM hits UNION ALL SELECT 'graph_rag', query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) FROM u UNION ALL SELECT 'bm25', query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) FROM bs),
gold AS (SELECT query_id, nl.id FROM q JOIN embeddings e ON e.vec_id = query_id JOIN nl ON nl.label = e.label AND nl.lang IS NOT DISTINCT FROM q.lang), w AS (SELECT query_id, count(*) AS w FROM gold GROUP BY 1),
m AS (SELECT system, query_id, count(gold.id) AS hits, min(rank) FILTER (gold.id IS NOT NULL) AS first FROM runs LEFT JOIN gold USING (query_id, id) WHERE rank <= 8 GROUP BY ALL)
SELECT system, lang, count(*) AS n, round(avg(hits / w), 6) AS recall, round(avg(coalesce(1 / first, 0)), 6) AS mrr FROM m JOIN w USING (query_id) JOIN q USING (query_id) GROUP BY ALL""")  # fmt: skip
def systems_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A node's language is that of the document of its number; a query is to find the nodes of its class and language."""
    lang = A.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("num"), "lang")
    nodes = A.nodes(spark, sf_dir).join(lang, "num", "left")
    queries = _queries(spark, sf_dir).join(lang.withColumnRenamed("num", "query_id"), "query_id", "left")
    runs = experiments.language_runs(nodes, A.edges(spark, sf_dir), queries, F.concat_ws(" ", "concept", "summary", "raw_text"))
    near = nodes.select("id", F.col("label").alias("query_label"), F.coalesce("lang", F.lit("")).alias("_l"))
    gold = queries.select("query_id", "query_label", F.coalesce("lang", F.lit("")).alias("_l")).join(near, ["query_label", "_l"]).select("query_id", "id")
    per = evaluation.ranking_metrics(runs, gold, 8, ["system", "lang"])
    return per.groupBy("system", "lang").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg("mrr"), 6).alias("mrr"))
