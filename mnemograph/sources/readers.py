"""Documents as rows (path, page, text), read by Spark from any store that it knows."""

from __future__ import annotations

import importlib.util
import io
import json
from collections.abc import Iterator
from functools import reduce
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T


def _decoded(content: Column) -> Column:
    """UTF-8 without a byte order mark, or else Latin-1."""
    utf8 = F.try_validate_utf8(content.cast("string")) if hasattr(F, "try_validate_utf8") else F.decode(content, "UTF-8")
    return F.regexp_replace(F.coalesce(utf8, F.decode(content, "ISO-8859-1")), "^﻿", "")


def text_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Each file is one page."""
    files = spark.read.format("binaryFile").load(paths)
    return files.select("path", F.lit(1).alias("page"), T.sanitize(_decoded(F.col("content"))).alias("text"))


def markdown_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return text_files(spark, paths).withColumn("text", T.strip_markdown(F.col("text")))


def html_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return text_files(spark, paths).withColumn("text", T.html_text(F.col("text")))


#: What may part the cells of a row, in the order of choice among equals.
SEPARATORS = (",", ";", "\t", "|")


def csv_dialects(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, header, sep for each file: the separator that its first line has most often outside quotes, a comma if it has none.

    Of a large file only the first split is read for it.
    """
    lines = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start")).where("start = 0")
    first = lines.withColumn("at", F.monotonically_increasing_id()).groupBy("path").agg(F.min_by("value", "at").alias("header"))
    bare = F.regexp_replace(F.regexp_replace("header", "^\ufeff", ""), '"[^"]*"', "")
    counted = [F.struct((F.length(F.replace(bare, F.lit(c), F.lit(""))) - F.length(bare)).alias("less"), F.lit(i).alias("i"), F.lit(c).alias("c")) for i, c in enumerate(SEPARATORS)]
    return first.select("path", "header", F.array_min(F.array(*counted))["c"].alias("sep"))


def csv_files(spark: SparkSession, paths: str | list[str], sep: str | None = None) -> DataFrame:
    """Each row is a page "head: value; head: value"; blank cells are left out.

    Files of one first line are read together, each with the separator that ``csv_dialects`` tells, unless one is given.
    """
    groups: dict[tuple[str, str], list[str]] = {}
    for r in csv_dialects(spark, paths).collect():
        groups.setdefault((r["header"], sep or r["sep"]), []).append(unquote(r["path"]))
    parts = []
    for (_, used), files in sorted(groups.items()):
        rows = spark.read.csv(sorted(files), header=True, sep=used, encoding="UTF-8", multiLine=True, ignoreLeadingWhiteSpace=False)
        cells = [F.when(F.trim(F.col(f"`{c}`")) != "", F.concat(F.lit(f"{c.strip()}: "), F.col(f"`{c}`"))) for c in rows.columns]
        parts.append(rows.select(F.col("_metadata.file_path").alias("path"), F.lit(1).alias("page"), T.sanitize(F.concat_ws("; ", *cells)).alias("text")).where("text <> ''"))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], "path string, page int, text string")


def json_pages(value, prefix: str = "") -> list[str]:
    """Texts of a JSON value in order: strings as they are, numbers and booleans behind their key."""
    if isinstance(value, dict):
        return [p for k, v in value.items() for p in json_pages(v, f"{k}: ")]
    if isinstance(value, list):
        return [p for v in value for p in json_pages(v, prefix)]
    if isinstance(value, str):
        return [value] if value.strip() else []
    return [f"{prefix}{value}"] if isinstance(value, (int, float)) else []


def json_rows(texts: DataFrame) -> DataFrame:
    """path, page, text for each text of the JSON documents of ``texts`` (path, text); the walk is recursive, so it runs in Python by batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, page) for p, t in zip(b["path"], b["text"]) for page in json_pages(json.loads(t))]
            yield pd.DataFrame(rows, columns=["path", "text"])

    walked = texts.select("path", "text").mapInPandas(run, "path string, text string")
    return walked.select("path", F.lit(1).alias("page"), T.sanitize(F.col("text")).alias("text"))


def json_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return json_rows(text_files(spark, paths))


def _by_library(spark: SparkSession, paths, module: str, read) -> DataFrame:
    if importlib.util.find_spec(module) is None:
        raise RuntimeError(f"{module} is not installed")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, i, t) for p, c in zip(b["path"], b["content"]) for i, t in read(io.BytesIO(c))]
            yield pd.DataFrame(rows, columns=["path", "page", "text"])

    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    return files.mapInPandas(run, "path string, page int, text string").withColumn("text", T.sanitize(F.col("text"))).where("trim(text) <> ''")


def pdf_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """One row for each page with text; needs pypdf."""

    def read(data):
        from pypdf import PdfReader

        return [(i, p.extract_text() or "") for i, p in enumerate(PdfReader(data).pages, 1)]

    return _by_library(spark, paths, "pypdf", read)


def docx_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Paragraphs with text, one page; needs python-docx."""

    def read(data):
        from docx import Document

        return [(1, "\n".join(p.text for p in Document(data).paragraphs if p.text.strip()))]

    return _by_library(spark, paths, "docx", read)


READERS = {"txt": text_files, "md": markdown_files, "markdown": markdown_files, "html": html_files, "htm": html_files, "csv": csv_files, "json": json_files, "pdf": pdf_files, "docx": docx_files}


def documents(spark: SparkSession, paths: list[str]) -> DataFrame:
    """All files by their endings; raises ValueError for an unknown one."""
    kinds: dict[str, list[str]] = {}
    for p in paths:
        kinds.setdefault(p.rsplit(".", 1)[-1].lower(), []).append(p)
    if unknown := set(kinds) - set(READERS):
        raise ValueError(f"unknown kinds of files: {sorted(unknown)}")
    out = None
    for kind, group in sorted(kinds.items()):
        part = READERS[kind](spark, group)
        out = part if out is None else out.unionByName(part)
    return out


def question_sets(rows: DataFrame) -> DataFrame:
    """query_id, question, answer, supporting_ids from rows (question, answer, and supporting_ids or context); those without either fall out."""
    ids = F.col("supporting_ids") if "supporting_ids" in rows.columns else F.array().cast("array<string>")
    q = rows.where((F.trim(F.coalesce("question", F.lit(""))) != "") & (F.trim(F.coalesce("answer", F.lit(""))) != ""))
    return q.select(F.substring(F.sha2("question", 256), 1, 16).alias("query_id"), "question", "answer", ids.alias("supporting_ids"))


def self_questions(nodes: DataFrame, least: int = 25) -> DataFrame:
    """query_id, question, answer, supporting_ids: each node with a long enough text asks for itself by its concept."""
    n = nodes.where(F.length("raw_text") >= least)
    return n.select(F.col("id").alias("query_id"), F.col("concept").alias("question"), F.col("raw_text").alias("answer"), F.array("id").alias("supporting_ids"))


def chunk_questions(chunks: DataFrame, per_document: int = 3, least: int = 30) -> DataFrame:
    """document_id, seq, answer: the first sentence longer than ``least`` of each document's first chunks."""
    first = F.try_element_at(F.filter(T.sentences(F.col("text")), lambda s: F.length(s) > least), F.lit(1))
    return chunks.where(F.col("seq") < per_document).select("document_id", "seq", first.alias("answer")).where("answer is not null")


def url_lines(texts: DataFrame) -> DataFrame:
    """key, url, title from texts that hold JSON lines with a url, or else bare addresses."""
    lines = texts.select("key", F.explode(F.split("text", "\n")).alias("line"))
    j = F.from_json("line", "url string, title string")
    bare = F.regexp_extract_all("line", F.lit(r"(https?://[^\s\"'<>\)\]]+)"), F.lit(1))
    found = lines.select("key", F.when(j["url"].isNotNull(), F.array(F.struct(j["url"].alias("url"), j["title"].alias("title")))).otherwise(F.transform(bare, lambda u: F.struct(u.alias("url"), F.lit(None).cast("string").alias("title")))).alias("u"))
    return found.select("key", F.explode("u").alias("u")).select("key", "u.url", "u.title")
