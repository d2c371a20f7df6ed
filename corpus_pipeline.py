"""A corpus pipeline of five stages: quality rules, line dedup, near duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each stage's rows to the shared folder
and reads them again as the next stage's documents. All but the last stage return the columns of ``documents``. Nulls,
empty texts, repeated rows and empty tables are handled as each operator's module says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemograph.llm import line_dedup, mixing, ngram_join, packing, quality
from mnemograph.llm.shared import Scratch, table, word_count


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current quality policy keeps."""
    return quality.keep_good(docs)


def distinct_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stand before in the corpus, up to a few edits."""
    return line_dedup.dedup_lines(docs)


def one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates: that of the smallest doc_id (null last) and, of those, text hash.

    Of rows that repeat this doc_id and text, one stays. Texts without words link with nothing, so all of them stay.
    """
    classes = ngram_join.ngram_classes(docs.select("doc_id", "text")).where("class_key is not null")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")).alias("f")
    heads = classes.groupBy("class_key").agg(first).select(F.col("f.doc_id").alias("_d"), F.col("f.text_hash").alias("_t")).distinct()
    # whole rows travel as one column, so that their names clash with none here
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("_text"))
    rows = rows.select("row", "_id", F.xxhash64("_text").alias("_h"), (word_count(F.col("_text")) > 0).alias("_words"))
    headed = rows.where("_words").join(heads, F.col("_id").eqNullSafe(F.col("_d")) & (F.col("_h") == F.col("_t")), "left_semi").dropDuplicates(["_id", "_h"])
    return headed.unionByName(rows.where("not _words")).select("row.*")


def weighted_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the source schedule takes them."""
    return mixing.mixed(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's length bucket and batch."""
    return packing.pack(docs)


STAGES = [("quality_rules", good_documents), ("line_dedup", distinct_lines), ("near_duplicates", one_of_each_class), ("mix_sources", weighted_mix), ("pack", packed)]

#: Line verification, classes of links and optimal buckets have no SQL form that ends in time; tests hold brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over all of ``documents``."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        before, docs = docs, scratch.keep(stage(spark, docs, sf_dir), name)
        if i:
            scratch.drop(before)
    return docs
