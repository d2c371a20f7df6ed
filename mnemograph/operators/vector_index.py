"""A stored vector index with upserts, deletes and exact search that reads few cells.

An inverted file: unit vectors lie in cells, one folder each, round the nearest of some centroids; of a cell its centroid,
radius (the largest angle of a member) and number of rows are stored. Upserts and deletes append segments, in which a row
without a vector is a tombstone; a row of the base counts unless its id is in a segment, and of several segments the last
one counts. ``compact`` writes base and cells anew without them. The manifest names what belongs to a version, so
readers see whole versions only and of two writers one begins again.

A search is exact. By the triangle inequality no member of a cell is closer to a query than their angle to the centroid
less the radius. The nearest cells of a query, with enough rows for an answer, and all segments are read first; then only
cells that can still beat or equal the k-th score found. The driver holds centroids (at most ``MOST_CELLS``), and
queries in blocks of ``BLOCK_QUERIES``; rows stay in tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.manifest import Manifest
from . import storage
from .durable import cut
from .topk import RunningTop

#: Cells of an index, rows that centroids are fitted on, rows of a file, and queries that go to tasks at once.
MOST_CELLS, SAMPLE, FILE_ROWS, BLOCK_QUERIES = 4096, 20_000, 500_000, 5_000
DIGITS = 6


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def centroids(vectors: DataFrame, cells: int, sample: int = SAMPLE, rounds: int = 10) -> np.ndarray:
    """Unit centroids of a spherical k-means over the ``sample`` rows of least hash. They steer what is read, never what is found."""
    some = vectors.where("embedding is not null").select("embedding").orderBy(F.xxhash64("id"), "id").limit(sample).toPandas()["embedding"]
    if not len(some):
        return np.zeros((0, 0))
    x = _unit(np.stack(some.to_numpy()).astype(np.float64))
    at = x[: min(cells, len(x))]
    for _ in range(rounds):
        near, sums = (x @ at.T).argmax(1), np.zeros_like(at)
        np.add.at(sums, near, x)
        at = np.where(np.linalg.norm(sums, axis=1, keepdims=True) > 1e-9, _unit(sums), at)
    return at


class VectorIndex:
    """An index in a folder. Rows are (id string, embedding array of ``dims`` numbers); ids are unique."""

    def __init__(self, spark: SparkSession, root: str, dims: int):
        self.spark, self.dims, self.manifest = spark, dims, Manifest(spark, root)
        #: Numbers of the last search: cells there are, read at first, and read then.
        self.cells_read = (0, 0, 0)

    def _checked(self, rows: DataFrame) -> DataFrame:
        if rows.where(F.size("embedding") != self.dims).limit(1).count():
            raise ValueError(f"vectors must have {self.dims} numbers")
        return rows.select(F.col("id").cast("string").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))

    def _base(self, rows: DataFrame, cells: int | None) -> dict:
        n = rows.count()
        at = centroids(rows, min(MOST_CELLS, cells or max(1, round(n**0.5))))

        def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    x = _unit(np.stack(b["embedding"].to_numpy()).astype(np.float64))
                    near = x @ at.T
                    cell = near.argmax(1)
                    yield b.assign(cell=cell.astype(np.int32), angle=np.arccos(np.clip(near[np.arange(len(x)), cell], -1, 1)))

        placed = cut(rows.where("embedding is not null").mapInPandas(place, "id string, embedding array<double>, cell int, angle double"))
        sizes = placed.groupBy("cell").agg(F.max("angle").alias("radius"), F.count(F.lit(1)).alias("rows"))
        # a cell of many rows is written by as many tasks as its rows need
        share = F.pmod(F.xxhash64("id"), F.ceil(F.col("rows") / FILE_ROWS))
        files = placed.join(sizes.select("cell", "rows"), "cell").withColumn("share", share).repartition("cell", "share").select("id", "embedding", "cell")
        middle = self.spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(at)], "cell int, centroid array<double>")
        return {"base": self.manifest.write(files, "base", "cell"), "cells": self.manifest.write(middle.join(sizes, "cell"), "cells"), "segments": []}

    def rebuild(self, rows: DataFrame, cells: int | None = None) -> int:
        """Makes ``rows`` all of the index; gives its version."""
        rows = self._checked(rows)
        return self.manifest.change(lambda _: self._base(rows, cells))

    def upsert(self, rows: DataFrame) -> int:
        """Adds rows or replaces those of the same id."""
        rows = self._checked(rows)
        return self._append(rows)

    def delete(self, ids: DataFrame) -> int:
        """Takes out the rows of ``ids`` (id); ids that are not there are no error."""
        return self._append(ids.select(F.col("id").cast("string").alias("id"), F.lit(None).cast("array<double>").alias("embedding")))

    def _append(self, rows: DataFrame) -> int:
        segment = self.manifest.write(rows, "segment")
        return self.manifest.change(lambda says: says | {"segments": [*says.get("segments", []), segment]})

    def compact(self, cells: int | None = None) -> int:
        """The same rows without segments."""
        return self.manifest.change(lambda says: self._base(self._live(says), cells))

    def _log(self, says: dict) -> DataFrame | None:
        """The last row of each id in the segments, tombstones too."""
        parts = [self.manifest.read(s).withColumn("no", F.lit(i)) for i, s in enumerate(says.get("segments", []))]
        return storage.latest(reduce(DataFrame.unionByName, parts), ["id"], [F.col("no").desc()]).drop("no") if parts else None

    def _kept(self, says: dict, log: DataFrame | None, cells: list[int] | None = None) -> DataFrame | None:
        """id, embedding, cell of the base's rows that no segment replaces, of some cells."""
        if not says.get("base"):
            return None
        base = self.manifest.read(says["base"])
        base = base if cells is None else base.where(F.col("cell").isin(cells))
        return base if log is None else base.join(log.select("id"), "id", "left_anti")

    def _live(self, says: dict) -> DataFrame:
        log = self._log(says)
        parts = [p for p in (self._kept(says, log), None if log is None else log.where("embedding is not null")) if p is not None]
        return reduce(DataFrame.unionByName, [p.select("id", "embedding") for p in parts]) if parts else self.spark.createDataFrame([], "id string, embedding array<double>")

    def live(self, version: int | None = None) -> DataFrame:
        """id, embedding: the rows of the current or an older version."""
        return self._live(self.manifest.current()[1] if version is None else self.manifest.at(version))

    def size(self) -> int:
        return self.live().count()

    def search(self, queries: DataFrame, k: int = 8) -> DataFrame:
        """query_id, id, score, rank: the k rows of highest cosine for each query (query_id, vector); ties by id."""
        says = self.manifest.current()[1]
        blocks = max(1, -(-queries.count() // BLOCK_QUERIES))
        mine = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
        self.cells_read = (0, 0, 0)
        parts = [self._search(says, queries.where(mine == i), k) for i in range(blocks)]
        return reduce(DataFrame.unionByName, parts)

    def _search(self, says: dict, queries: DataFrame, k: int) -> DataFrame:
        asked = queries.select("query_id", "vector").orderBy("query_id").toPandas()
        kind = queries.schema["query_id"].dataType.simpleString()
        log = self._log(says)
        log = None if log is None else cut(log)
        shape = f"query_id {kind}, id string, score double"
        if not len(asked):
            return self.spark.createDataFrame([], f"{shape}, rank long")
        ids, q = asked["query_id"].to_numpy(), _unit(np.stack(asked["vector"].to_numpy()).astype(np.float64))
        cells = self.manifest.read(says["cells"]).orderBy("cell").toPandas() if says.get("cells") else pd.DataFrame({"cell": [], "rows": []})
        number = cells["cell"].to_numpy(dtype=np.int64)
        if len(cells):
            angle = np.arccos(np.clip(q @ np.stack(cells["centroid"].to_numpy()).T, -1, 1))
            order = np.argsort(angle, axis=1, kind="stable")
            enough = np.cumsum(cells["rows"].to_numpy()[order], axis=1)
            first = np.zeros(angle.shape, bool)
            np.put_along_axis(first, order, np.concatenate([np.zeros((len(q), 1)), enough[:, :-1]], 1) < 2 * k, axis=1)
            # rounding of angles and of scores only ever adds cells
            highest = np.cos(np.maximum(angle - cells["radius"].to_numpy()[None] - 1e-6, 0)) + 2 * 10.0**-DIGITS
        else:
            first, highest = np.zeros((len(q), 0), bool), np.zeros((len(q), 0))

        def scored(rows: DataFrame, wanted: np.ndarray) -> DataFrame:
            """The best of the rows for the queries that want their cell; cell -1 is for all."""
            who = {int(number[c]): np.flatnonzero(wanted[:, c]) for c in np.flatnonzero(wanted.any(0))} | {-1: np.arange(len(q))}

            def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                best = RunningTop(len(q), k)
                for b in batches:
                    for cell, part in b.groupby("cell"):
                        x = _unit(np.stack(part["embedding"].to_numpy()).astype(np.float64))
                        best.add(who[cell], part["id"].to_numpy(), np.round(q[who[cell]] @ x.T, DIGITS))
                found = best.shrink()
                if len(found):
                    yield pd.DataFrame({"query_id": ids[found["q"].to_numpy(dtype=np.int64)], "id": found["id"].to_numpy(dtype=object), "score": found["score"].to_numpy(dtype=np.float64)})

            return rows.select("id", "embedding", "cell").mapInPandas(run, shape)

        def read(wanted: np.ndarray) -> list[DataFrame]:
            some = number[wanted.any(0)].tolist()
            return [scored(self._kept(says, log, some), wanted)] if some else []

        parts = read(first)
        if log is not None:
            parts.append(scored(log.where("embedding is not null").withColumn("cell", F.lit(-1)), first))
        if not parts:
            return self.spark.createDataFrame([], f"{shape}, rank long")
        rank = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
        top = lambda df: df.withColumn("rank", F.row_number().over(rank).cast("long")).where(F.col("rank") <= k)
        found = cut(top(reduce(DataFrame.unionByName, parts)))
        # one number for each query of the block
        least = {r["query_id"]: r["score"] for r in found.where(F.col("rank") == k).select("query_id", "score").collect()}
        more = ~first & (highest >= np.array([least.get(i, -np.inf) for i in ids])[:, None])
        self.cells_read = tuple(a + int(b) for a, b in zip(self.cells_read, (len(number), first.any(0).sum(), more.any(0).sum())))
        rest = read(more)
        return cut(top(found.drop("rank").unionByName(rest[0]))) if rest else found
