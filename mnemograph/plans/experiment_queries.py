"""Queries that run experiments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import experiments, placement, retrieval
from . import adapters as A
from .catalog import query
from .graph_queries import _CANDS, _RG, _queries, _score_sql

_N = f"WITH {A.NODES}"


def _gold(spark, sf_dir):
    q = A.vector_queries(spark, sf_dir).select("query_id", F.col("query_label").alias("label"))
    return q.join(A.nodes(spark, sf_dir).select("id", "label"), "label").select("query_id", "id")


@query("rotation_invariance", f"SELECT vec_id AS query_id, 1.0::DOUBLE AS jaccard, 1.0::DOUBLE AS top1 FROM embeddings WHERE vec_id % {A.EVERY} = 0")
def rotation_invariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return experiments.rotation_agreement(A.nodes(spark, sf_dir), A.vector_queries(spark, sf_dir), 64)


_LOO = " UNION ALL ".join(f"SELECT '{n}' AS system, query_id, id, round({_score_sql(s)}, 9) AS score FROM comp" for n, s in experiments.leave_one_out().items())


@query("leave_one_out", f"""{_RG}, {_CANDS}, sc AS ({_LOO})
SELECT system, query_id, id, score, row_number() OVER (PARTITION BY system, query_id ORDER BY score DESC, id) AS rank FROM sc QUALIFY rank <= 8""")  # fmt: skip
def leave_one_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.ablate(A.nodes(spark, sf_dir), A.edges(spark, sf_dir), _queries(spark, sf_dir), A.now(), experiments.leave_one_out())


_STEP = """SELECT {s} AS step, q.label AS task, count(*) AS n, round(avg(hits / w), 6) AS recall, round(avg(coalesce(1 / first, 0)), 6) AS mrr FROM (
  SELECT c.query_id, count(*) FILTER (c.label = q.label) AS hits, min(c.rank) FILTER (c.label = q.label) AS first FROM (
    SELECT cos.query_id, cos.id, n.label, row_number() OVER (PARTITION BY cos.query_id ORDER BY score DESC, cos.id) AS rank FROM cos JOIN nodes n USING (id) WHERE n.label <= {s}) c JOIN q USING (query_id) WHERE c.rank <= 8 GROUP BY 1)
  JOIN q USING (query_id) JOIN w ON w.label = q.label WHERE q.label <= {s} GROUP BY q.label"""


@query("forgetting_lab", f"""{_N}, q AS (SELECT vec_id AS query_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % {A.EVERY} = 0), w AS (SELECT label, count(*) AS w FROM nodes GROUP BY 1),
cos AS (SELECT query_id, id, round(list_dot_product(v, embedding) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(embedding, embedding))), 6) AS score FROM q, nodes)
{" UNION ALL ".join(_STEP.format(s=s) for s in (3, 6, 9))}""")  # fmt: skip
def forgetting_lab(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = A.vector_queries(spark, sf_dir).withColumnRenamed("query_label", "task")
    return experiments.masked_lab(A.nodes(spark, sf_dir), q, _gold(spark, sf_dir), "label", [3, 6, 9])


@query("strategy_sweep")
def strategy_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All strategies; for the hierarchy, a node's parent is the one with an eighth of its number."""
    parent = F.when(F.col("num") > 0, F.concat(F.lit("v"), F.lpad(F.floor(F.col("num") / 8).cast("string"), 8, "0")))
    return experiments.strategy_sweep(A.nodes(spark, sf_dir).withColumn("parent_id", parent), A.edges(spark, sf_dir), _queries(spark, sf_dir), _gold(spark, sf_dir), A.now(), placement.STRATEGIES)


@query("bm25_by_language", r"""
WITH d AS (SELECT doc_id, lang, lower(text) AS t FROM documents), p AS (SELECT doc_id, lang, unnest(regexp_extract_all(t, '[\p{L}\p{N}_]+')) AS term FROM d),
tf AS (SELECT doc_id, lang, term, count(*) AS tf FROM p GROUP BY ALL), dl AS (SELECT d.doc_id, d.lang, coalesce(sum(tf), 0) AS dl FROM d LEFT JOIN tf USING (doc_id) GROUP BY ALL),
g AS (SELECT lang, count(*) AS n, avg(dl) AS av FROM dl GROUP BY 1), df AS (SELECT lang, term, count(*) AS df FROM tf GROUP BY ALL),
qt AS (SELECT item_id, term, count(*) AS k FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS term FROM benchmark) GROUP BY ALL),
s AS (SELECT item_id, doc_id, tf.lang, sum(k * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / av))) AS score
  FROM qt JOIN tf USING (term) JOIN df ON df.term = tf.term AND df.lang IS NOT DISTINCT FROM tf.lang JOIN dl USING (doc_id) JOIN g ON g.lang IS NOT DISTINCT FROM tf.lang GROUP BY ALL)
SELECT lang, item_id AS query_id, doc_id, round(score, 4) AS score, row_number() OVER (PARTITION BY lang, item_id ORDER BY round(score, 4) DESC, doc_id) AS rank FROM s QUALIFY rank <= 8""")  # fmt: skip
def bm25_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return experiments.by_language(A.documents(spark, sf_dir).select("doc_id", "text", "lang"), A.text_queries(spark, sf_dir), "doc_id")


def _labelled(spark, sf_dir):
    return _queries(spark, sf_dir).withColumnRenamed("query_label", "label")


@query("learned_weights")
def learned_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = experiments.world_weights(A.nodes(spark, sf_dir), A.edges(spark, sf_dir), _labelled(spark, sf_dir), "label", A.now())
    return spark.createDataFrame([(c, round(v, 6)) for c, v in w.items()], "component string, weight double")


@query("held_out_weights")
def held_out_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions of one remainder are a group; what is learned from some of them ranks the others."""
    groups = A.vector_queries(spark, sf_dir).select("query_id", (F.col("query_id") / A.EVERY % 50).cast("long").alias("group"))
    return experiments.held_out_world(A.nodes(spark, sf_dir), A.edges(spark, sf_dir), _labelled(spark, sf_dir), "label", A.now(), groups)[1]


@query("sleep_pass")
def sleep_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return experiments.sleep(A.nodes(spark, sf_dir), A.edges(spark, sf_dir), A.now())[0]


@query("inner_share", f"""{_N} SELECT count(*) AS nodes, count(*) FILTER (ring <= 1) AS "inner", count(*) <= 2000 OR count(*) FILTER (ring <= 1) / count(*) >= 0.02 AS sound FROM nodes""")
def inner_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return experiments.inner_share(A.nodes(spark, sf_dir))
