"""Stored results of experiments, into which further systems are merged."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluation
from .manifest import Manifest


class Results:
    """Rows of systems (query_id and metrics) in a folder. A system is a data folder of its own, named in the manifest.

    ``merge`` writes the rows first and then commits their name; of two writers who meet, the second takes up what the
    first has committed, and a system that both write is the later one's. Readers see whole versions.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.manifest = spark, Manifest(spark, root)

    def merge(self, system: str, rows: DataFrame) -> int:
        """Adds a system, or replaces it; the others stay as they are."""
        folder = self.manifest.write(rows, "rows")
        return self.manifest.change(lambda says: says | {"systems": says.get("systems", {}) | {system: folder}})

    def systems(self) -> list[str]:
        return sorted(self.manifest.current()[1].get("systems", {}))

    def rows(self, system: str) -> DataFrame:
        return self.manifest.read(self.manifest.current()[1]["systems"][system])

    def table(self, metrics: list[str]) -> DataFrame:
        """system, n and each metric's mean."""
        parts = [self.rows(s).withColumn("system", F.lit(s)) for s in self.systems()]
        return evaluation.means(reduce(DataFrame.unionByName, parts), metrics, ["system"])

    def differences(self, of: str, metric: str) -> DataFrame:
        """system, query_id, diff: of's metric less that of each other system, for paired tests."""
        own = self.rows(of)
        parts = [evaluation.paired(own, self.rows(s), "query_id", metric).withColumn("system", F.lit(s)) for s in self.systems() if s != of]
        return reduce(DataFrame.unionByName, parts)
