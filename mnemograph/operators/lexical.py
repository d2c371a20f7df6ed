"""Lexical operators: BM25, term counts, hashed embeddings, token overlap."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .durable import cut
from .topk import RunningTop

K1, B = 1.5, 0.75
#: Queries of a block, and most terms that are filtered by before rows leave the JVM.
BLOCK_QUERIES, MOST_LITERALS = 2_000, 20_000
#: Indexes of one pass.
MOST_INDEXES = 1_000


def postings(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, term, tf."""
    return docs.select(key, F.explode(T.unicode_words(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def bm25(docs: DataFrame, key: str, queries: DataFrame, k: int = 8, k1: float = K1, b: float = B, by: str | None = None) -> DataFrame:
    """query_id, key, score, rank: the ``k`` best documents for each of ``queries`` (query_id, query).

    by: a column of ``docs`` of which each value is an index of its own, with its frequencies and mean length; every query is
    asked of each, and the column comes first in the result. One pass serves all of them; they are ``MOST_INDEXES`` at most.

    Queries go in blocks of about ``BLOCK_QUERIES``, whose terms travel with the code. The corpus is cut into words once:
    what it holds of the asked terms, and each document's length, goes to the shared folder, and frequencies, mean length
    and scores come from there. A batch of documents meets the query terms as a product of two sparse matrices; a task
    keeps the k best of each query over all its batches, so that neither postings nor pairs of documents and queries are
    shuffled, and what is sent on does not grow with the documents.
    """
    n_blocks = -(-queries.count() // BLOCK_QUERIES)
    if n_blocks <= 1:
        return _block_bm25(docs, key, queries, k, k1, b, by)
    mine = F.pmod(F.xxhash64("query_id"), F.lit(n_blocks))
    return reduce(DataFrame.unionByName, [cut(_block_bm25(docs, key, queries.where(mine == i), k, k1, b, by)) for i in range(n_blocks)])


def _block_bm25(docs: DataFrame, key: str, queries: DataFrame, k: int, k1: float, b: float, by: str | None) -> DataFrame:
    rows = queries.select("query_id", T.unicode_words(F.col("query")).alias("terms")).collect()
    ids = [r["query_id"] for r in rows]
    asked = Counter((t, j) for j, r in enumerate(rows) for t in r["terms"] or ())
    place = {t: i for i, t in enumerate(sorted({t for t, _ in asked}))}
    # by term: which queries ask for it, and how often
    triples = np.array(sorted((place[t], j, n) for (t, j), n in asked.items()), np.int64).reshape(-1, 3)
    starts = np.searchsorted(triples[:, 0], np.arange(len(place) + 1))
    every = T.unicode_words(F.col("text"))
    group = F.lit(None).cast("string") if by is None else F.col(by).cast("string")
    words = docs.select(key, group.alias("_by"), F.coalesce(F.size(every), F.lit(0)).alias("dl"), every.alias("terms"))

    def held(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Of each document, the numbers of the asked terms that it holds, and how often."""
        for part in batches:
            if not len(part):
                continue
            found = [np.unique(np.array([place[t] for t in ts if t in place] if ts is not None else [], np.int32), return_counts=True) for ts in part["terms"]]
            yield pd.DataFrame({key: part[key], "_by": part["_by"], "dl": part["dl"], "term": [t for t, _ in found], "tf": [n.astype(np.int32) for _, n in found]})

    if len(place) <= MOST_LITERALS:
        words = words.withColumn("terms", F.filter("terms", lambda w: w.isin(list(place))))
    kind = docs.schema[key].dataType.simpleString()
    kept = cut(words.mapInPandas(held, f"{key} {kind}, _by string, dl int, term array<int>, tf array<int>"))
    sizes_ = kept.groupBy("_by").agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("mean")).limit(MOST_INDEXES + 1).collect()
    if len(sizes_) > MOST_INDEXES:
        raise ValueError(f"more than {MOST_INDEXES} indexes")
    index = {r["_by"]: i for i, r in enumerate(sizes_)}
    n, mean = np.array([[r["n"]] for r in sizes_], np.float64).reshape(-1, 1), np.array([r["mean"] or 1.0 for r in sizes_])
    names, df = list(index), np.zeros((len(index), len(place)))
    # a number for each index and asked term
    for r in kept.select("_by", F.explode("term").alias("term")).groupBy("_by", "term").agg(F.count(F.lit(1)).alias("df")).collect():
        df[index[r["_by"]], r["term"]] = r["df"]
    query, weights = triples[:, 1], np.log(1 + (n - df + 0.5) / (df + 0.5))[:, triples[:, 0]] * triples[:, 2]

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = RunningTop(len(ids) * len(index), k)
        parts = ((g, same.iloc[at : at + 500]) for whole in batches for g, same in whole.groupby("_by", dropna=False) for at in range(0, len(same), 500))
        for name, part in parts:
            g = index[name if isinstance(name, str) else None]
            sizes = np.array([len(t) for t in part["term"]])
            row = np.repeat(np.arange(len(part)), sizes)
            term, tf = (np.concatenate([np.zeros(0), *part[c]]) for c in ("term", "tf"))
            term, long = term.astype(np.int64), part["dl"].to_numpy()[row]
            x = tf * (k1 + 1) / (tf + k1 * (1 - b + b * long / mean[g]))
            each = starts[term + 1] - starts[term]
            spot = np.repeat(starts[term] - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))
            cell = np.repeat(row, each) * len(ids) + query[spot]
            got = np.round(np.bincount(cell, np.repeat(x, each) * weights[g, spot], len(part) * len(ids)).reshape(len(part), len(ids)), 4)
            best.add(g * len(ids) + np.arange(len(ids)), part[key].to_numpy(), np.where(got > 0, got, -np.inf).T)
        found = best.shrink()
        if len(found):
            yield pd.DataFrame({"_by": pd.Series([names[int(i) // len(ids)] for i in found["q"]], dtype=object), "query_id": [ids[int(i) % len(ids)] for i in found["q"]], key: found["id"].to_numpy(), "score": found["score"].to_numpy(dtype=np.float64)})

    kinds = f"_by string, query_id {queries.schema['query_id'].dataType.simpleString()}, {key} {kind}, score double"
    ranked = top(kept.mapInPandas(score, kinds), ["_by", "query_id"], [F.col("score").desc(), F.col(key)], k)
    return ranked.drop("_by") if by is None else ranked.withColumnRenamed("_by", by)


def top(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group, with their rank."""
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)


def frequent_terms(docs: DataFrame, key: str, groups: list[str], k: int) -> DataFrame:
    """groups, term, df: the k terms that most documents of each group hold."""
    terms = F.array_distinct(F.filter(T.salient_words(F.col("text")), lambda w: (F.length(w) >= 4) & ~w.isin(T.STOP_WORDS)))
    counts = docs.select(*groups, F.explode(terms).alias("term")).groupBy(*groups, "term").agg(F.count(F.lit(1)).alias("df"))
    rank = F.row_number().over(Window.partitionBy(*groups).orderBy(F.col("df").desc(), "term"))
    return counts.withColumn("_r", rank).where(F.col("_r") <= k).drop("_r")


def hash_embedding(docs: DataFrame, key: str, text: Column, dims: int = 384) -> DataFrame:
    """key, i, v: the non-zero entries of each text's unit hash vector."""
    entries = docs.select(key, F.explode(T.hash_features(text, dims)).alias("e")).groupBy(key, F.col("e.i").alias("i")).agg(F.sum("e.v").alias("v"))
    length = F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy(key)))
    return entries.withColumn("v", F.col("v") / length).where("v <> 0")


def token_f1(df: DataFrame, key: list[str], a: Column, b: Column) -> DataFrame:
    """key, f1: harmonic mean of precision and recall of the tokens that two texts share, as multisets."""
    count = lambda c, n: df.select(*key, F.explode(T.words(c)).alias("w")).groupBy(*key, "w").agg(F.count(F.lit(1)).alias(n))
    shared = count(a, "x").join(count(b, "y"), [*key, "w"]).groupBy(*key).agg(F.sum(F.least("x", "y")).alias("c"))
    sizes = df.select(*key, (F.size(T.words(a)) + F.size(T.words(b))).alias("total"))
    return sizes.join(shared, key, "left").select(*key, F.coalesce(2.0 * F.col("c") / F.col("total"), F.lit(0.0)).alias("f1"))
