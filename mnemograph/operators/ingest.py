"""From documents to chunks, nodes and edges."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

SIZE, OVERLAP = 800, 120
#: White space as Python's strip knows it.
BLANKS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def chunk_bounds(lengths: np.ndarray, size: int, overlap: int, cut_off: bool = False) -> list[tuple[int, int]]:
    """Ranges (from, to) of sentences, none longer than ``size``, that make up the chunks.

    Over running lengths, a range ends where the next sentence would pass ``size``, but has one new sentence at least,
    and the next one begins with those of its last sentences that ``overlap`` holds. Where a long sentence cuts the row
    off, what would carry over is a range of its own.
    """
    total = np.concatenate([[0], np.cumsum(lengths)])
    out, begin, new = [], 0, 0
    while new < len(lengths):
        end = max(new + 1, int(np.searchsorted(total, total[begin] + size, "right")) - 1)
        out.append((begin, end))
        begin, new = max(begin, int(np.searchsorted(total, total[end] - overlap))), end
    return [*out, (begin, new)] if cut_off and begin < new else out


def sentence_runs(lengths: np.ndarray, size: int, overlap: int) -> list[tuple[int, int]]:
    """Ranges (from, to) of sentences that make up the chunks of a text; a sentence longer than ``size`` stands alone, as (i, i)."""
    long = np.flatnonzero(lengths > size)
    runs = []
    # what lies between two long sentences is packed on its own
    for a, z in zip([0, *(long + 1).tolist()], [*long.tolist(), len(lengths)]):
        runs += [(a + x, a + y) for x, y in chunk_bounds(lengths[a:z], size, overlap, z < len(lengths))]
        if z < len(lengths):
            runs.append((z, z))
    return runs


def pack_sentences(whole: str, parts: list[str], size: int = SIZE, overlap: int = OVERLAP) -> list[str]:
    """Chunks of a text of at most ``size`` characters of sentences, blanks between them not counted; see ``chunk_bounds``.

    A text that fits is one chunk. A sentence longer than ``size`` stands alone, cut into pieces that overlap.
    """
    if len(whole) <= size:
        return [whole.strip()] if whole.strip() else []
    chunks = []
    for a, z in sentence_runs(np.array([len(p) for p in parts], np.int64), size, overlap):
        chunks += [" ".join(parts[a:z])] if a < z else [parts[a][i : i + size] for i in range(0, len(parts[a]), size - overlap)]
    return [c for c in map(str.strip, chunks) if c]


def chunk(docs: DataFrame, key: str, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """key, seq, chunk, as ``pack_sentences`` has them. Sentences are cut and joined in the engine; only their lengths go to Python, for the order-dependent packing."""

    @F.pandas_udf("array<array<int>>")
    def runs(lengths: pd.Series) -> pd.Series:
        return pd.Series([sentence_runs(n.astype(np.int64), size, overlap) for n in lengths], dtype=object)

    def joined(run: Column) -> Column:
        a, z = run[0], run[1]
        whole = F.get("parts", a)
        pieces = F.transform(F.sequence(F.lit(0), F.length(whole) - 1, F.lit(size - overlap)), lambda i: F.substring(whole, i + 1, F.lit(size)))
        return F.when(a < z, F.array(F.array_join(F.slice("parts", a + 1, z - a), " "))).otherwise(pieces)

    text = F.coalesce("text", F.lit(""))
    cut = docs.select(key, F.when(F.length(text) <= size, F.array(text)).otherwise(T.sentences(text)).alias("parts"))
    packed = cut.select(key, "parts", runs(F.transform("parts", F.length)).alias("runs"))
    bare = F.transform(F.flatten(F.transform("runs", joined)), lambda c: F.trim(c, F.lit(BLANKS)))
    return packed.select(key, F.posexplode(F.filter(bare, lambda c: c != "")).alias("seq", "chunk"))


def concept_nodes(chunks: DataFrame, key: str) -> DataFrame:
    """key, concept, mentions, importance, confidence of each document's concepts."""
    found = chunks.select(key, F.explode(T.concepts(F.col("chunk"))).alias("concept")).groupBy(key, "concept").agg(F.count(F.lit(1)).alias("mentions"))
    return found.withColumns({"importance": F.least(F.lit(1.0), 0.4 + 0.1 * F.col("mentions")), "confidence": F.least(F.lit(0.9), 0.5 + 0.05 * F.col("mentions"))})


def mention_edges(concepts: DataFrame, chunks: DataFrame, key: str) -> DataFrame:
    """key, concept, seq, weight, confidence: a document's concepts and its chunks whose text holds them.

    The document is the join key, so that "contains" is tried within a document only.
    """
    low = chunks.select(key, "seq", F.lower("chunk").alias("low"))
    return concepts.select(key, "concept").join(low, key).where(F.contains("low", "concept")).select(key, "concept", "seq", F.lit(1.0).alias("weight"), F.lit(0.7).alias("confidence"))


def relation_edges(chunks: DataFrame, concepts: DataFrame, key: str, most: int = 20) -> DataFrame:
    """key, subject, relation, object, new_subject, new_object: a document's first triples; new_*: no concept has the name."""
    t = chunks.select(key, "seq", F.posexplode(T.relations(F.col("chunk"))).alias("pos", "r"))
    t = t.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy("seq", "pos"))).where(F.col("n") <= most)
    t = t.select(key, F.col("r.subject").alias("subject"), F.col("r.relation").alias("relation"), F.col("r.object").alias("object"))
    for side in ("subject", "object"):
        known = concepts.select(F.col(key).alias("_k"), F.lower("concept").alias("_c")).distinct()
        t = t.join(known, (F.col(key) == F.col("_k")) & (F.lower(side) == F.col("_c")), "left").withColumn(f"new_{side}", F.col("_c").isNull()).drop("_k", "_c")
    return t


def new_documents(incoming: DataFrame, stored: DataFrame, text: str = "text") -> DataFrame:
    """Incoming documents whose text is not stored yet, one for each text."""
    sha = F.sha2(F.col(text), 256)
    return incoming.withColumn("sha", sha).dropDuplicates(["sha"]).join(stored.select("sha").distinct(), "sha", "left_anti")
