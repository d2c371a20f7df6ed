"""Queries that write the tables in other formats, or stream them, and read them through the sources."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import ingest
from ..operators.durable import shared_folder
from ..sources import readers
from ..streaming import logs
from . import adapters as A
from .catalog import query


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("csv_source", """SELECT concat_ws('; ', 'c_custkey: ' || c_custkey, 'c_name: ' || c_name, CASE WHEN c_nationkey % 5 > 0 THEN 'c_nationkey: ' || c_nationkey END) AS text FROM customer""")
def csv_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = A.table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.when(F.col("c_nationkey") % 5 > 0, F.col("c_nationkey")).alias("c_nationkey"))
    path = _folder(spark, "csv")
    c.write.csv(path, header=True)
    return readers.csv_files(spark, path).select("text")


@query("json_source", """WITH j AS (SELECT item_id, text FROM benchmark) SELECT item_id::VARCHAR AS key, unnest(['item_id: ' || item_id, text, 'n: ' || length(text)]) AS text FROM j""")
def json_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages written as one JSON file each, and read through the reader."""
    b = A.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("key"), F.to_json(F.struct("item_id", "text", F.length("text").alias("n"))).alias("value"))
    path = _folder(spark, "json")
    b.write.partitionBy("key").text(path)
    return readers.json_files(spark, f"{path}/*/*.txt").select(F.regexp_extract("path", "/key=([^/]*)/", 1).alias("key"), "text")


@query("text_source", "SELECT item_id::VARCHAR AS key, 1 AS page, text FROM benchmark")
def text_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages written as one text file each, and read through the reader."""
    path = _folder(spark, "text")
    A.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("key"), F.col("text").alias("value")).write.partitionBy("key").text(path)
    return readers.text_files(spark, f"{path}/*/*.txt").select(F.regexp_extract("path", "/key=([^/]*)/", 1).alias("key"), "page", F.rtrim("text", F.lit("\n")).alias("text"))


@query("self_question_set", f"""WITH {A.NODES} SELECT id AS query_id, concept AS question, raw_text AS answer FROM nodes WHERE length(raw_text) >= 12""")
def self_question_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.self_questions(A.nodes(spark, sf_dir), 12).select("query_id", "question", "answer")


@query("chunk_question_set")
def chunk_question_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = ingest.chunk(A.documents(spark, sf_dir).select("doc_id", "text"), "doc_id")
    return readers.chunk_questions(c.select(F.col("doc_id").alias("document_id"), "seq", F.col("chunk").alias("text")))


@query("url_extract", r"""SELECT page_id AS key, unnest(regexp_extract_all(url || ' ' || html, '(https?://[^\s"''<>\)\]]+)', 1)) AS url FROM pages""")
def url_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = A.table(spark, sf_dir, "pages").select(F.col("page_id").alias("key"), F.concat_ws(" ", "url", "html").alias("text"))
    return readers.url_lines(p).select("key", "url")


@query("relation_nodes")
def relation_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = ingest.chunk(A.documents(spark, sf_dir).select("doc_id", "text"), "doc_id")
    return ingest.relation_edges(c, ingest.concept_nodes(c, "doc_id"), "doc_id")


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a log folder, which the stream reads."""
    path = _folder(spark, "log")
    e = A.table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("at"), "user_id", "event_type", "value")
    e.write.parquet(path)
    return logs.open_log(spark, path, e.schema)


@query("stream_windows", """SELECT event_type, strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = logs.run_all(logs.windowed(_event_stream(spark, sf_dir), "at"), _folder(spark, "windows"))
    return w.select("event_type", F.date_format("start", "yyyy-MM-dd").alias("day"), "n", F.round("total", 4).alias("total"))


@query("stream_sessions", """WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS s FROM events),
h AS (SELECT user_id, ts, sum(s) OVER (PARTITION BY user_id ORDER BY ts, s ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, count(*) AS n FROM h GROUP BY user_id, k""")  # fmt: skip
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = logs.run_all(logs.sessions(_event_stream(spark, sf_dir), "at"), _folder(spark, "sessions"))
    return s.select("user_id", "n")
