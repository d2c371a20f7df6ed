"""Published question sets, and the nodes that hold their evidence.

All shapes are read by one schema, a file being a list of records or an object with a list under ``records`` or ``data``:

* ``custom``: supporting_ids as they are; records without a question or an answer fall out;
* ``hotpotqa`` and ``2wiki``: supporting_facts as an object with a list of titles, or as a list of [title, sentence];
* ``musique``: the titles of supporting_paragraphs that are supporting.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

KINDS = ("custom", "hotpotqa", "2wiki", "musique")
_RECORD = "question string, answer string, supporting_ids array<string>, supporting_facts string, supporting_paragraphs array<struct<title:string,is_supporting:boolean>>"
_FILE = f"{_RECORD}, records array<struct<{_RECORD.replace(' string', ':string').replace(' array', ':array')}>>, data array<struct<{_RECORD.replace(' string', ':string').replace(' array', ':array')}>>"


def _titles(kind: str) -> Column:
    none = F.array().cast("array<string>")
    if kind == "musique":
        some = F.filter("supporting_paragraphs", lambda p: p["is_supporting"])
        return F.coalesce(F.transform(some, lambda p: F.coalesce(p["title"], F.lit(""))), none)
    if kind == "custom":
        return none
    facts = F.col("supporting_facts")
    rows = F.filter(F.from_json(facts, "array<array<string>>"), lambda r: F.size(r) > 0)
    return F.coalesce(F.when(facts.startswith("{"), F.from_json(facts, "title array<string>")["title"]).when(facts.startswith("["), F.transform(rows, lambda r: F.get(r, F.lit(0)))), none)


def read_questions(spark: SparkSession, path: str | list[str], kind: str) -> DataFrame:
    """question, answer, supporting_ids, titles of all files; raises ValueError for an unknown kind."""
    if kind not in KINDS:
        raise ValueError(f"unknown kind of questions: {kind}")
    files = spark.read.schema(_FILE).json(path, multiLine=True)
    own = F.struct(*[c.split()[0] for c in ("question", "answer", "supporting_ids", "supporting_facts", "supporting_paragraphs")])
    rows = files.select(F.explode(F.coalesce("records", "data", F.array(own))).alias("r")).select("r.*")
    said = F.col("question").isNotNull() & (F.col("question") != "") & F.col("answer").isNotNull()
    rows = rows.where(said & (F.col("answer") != "") if kind == "custom" else said)
    ids = F.col("supporting_ids") if kind == "custom" else F.lit(None).cast("array<string>")
    return rows.select("question", "answer", F.coalesce(ids, F.array().cast("array<string>")).alias("supporting_ids"), _titles(kind).alias("titles"))


def title_index(documents: DataFrame, chunks: DataFrame, nodes: DataFrame) -> DataFrame:
    """title, id: which nodes a canonical title stands for; documents: document_id, title, source_path; chunks: chunk_id, document_id; nodes: id, source_ids.

    A document goes by its title and by the last part of its path. An inverted index to be stored: sets of questions only
    look their titles up.
    """
    base = F.regexp_extract(F.coalesce("source_path", F.lit("")), r"([^/\\]*)$", 1)
    named = documents.select("document_id", F.explode(F.array(T.canonical_title(F.col("title")), T.canonical_title(base))).alias("title")).where("title <> ''").distinct()
    held = named.join(chunks.select("document_id", "chunk_id"), "document_id").select("title", "chunk_id")
    return held.join(nodes.select("id", F.explode("source_ids").alias("chunk_id")), "chunk_id").select("title", "id").distinct()


def resolve(questions: DataFrame, index: DataFrame) -> DataFrame:
    """``questions`` with the nodes of their titles added to supporting_ids, sorted; titles that nothing stands for add none."""
    keyed = questions.withColumn("_key", F.sha2(F.to_json(F.struct("question", "answer", "titles", "supporting_ids")), 256))
    asked = keyed.select("_key", F.explode("titles").alias("t")).select("_key", T.canonical_title(F.col("t")).alias("title")).distinct()
    found = asked.join(index, "title").groupBy("_key").agg(F.collect_set("id").alias("_ids"))
    both = F.array_sort(F.array_union("supporting_ids", F.coalesce("_ids", F.array().cast("array<string>"))))
    return keyed.join(found, "_key", "left").withColumn("supporting_ids", both).drop("_key", "_ids")
