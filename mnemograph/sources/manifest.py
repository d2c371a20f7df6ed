"""Versions of a table under a manifest that two writers cannot both replace.

A table is a folder with data folders that are never changed, and ``_versions/n.json`` files, of which the one with the
largest n says what the table holds. A writer reads a version, writes new data folders, and commits n + 1: the file is
written under a passing name and renamed to a name that must not be there yet, which a shared file system such as HDFS
does as one step. Whoever comes second gets ``Conflict``; readers see the old version, whole, until the new one is there.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Conflict(RuntimeError):
    """Another writer has committed the version first."""


class Manifest:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(self._conf)

    def folder(self, label: str) -> str:
        """A new name for a data folder, relative to the table."""
        return f"{label}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, label: str, *partition_by: str) -> str:
        name = self.folder(label)
        df.write.mode("errorifexists").partitionBy(*partition_by).parquet(f"{self.root}/{name}") if partition_by else df.write.mode("errorifexists").parquet(f"{self.root}/{name}")
        return name

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}")

    def versions(self) -> list[int]:
        at = self._path(f"{self.root}/_versions")
        names = [f.getPath().getName() for f in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def at(self, version: int) -> dict:
        """What a version says; version 0 says nothing."""
        if not version:
            return {}
        stream = self._fs.open(self._path(f"{self.root}/_versions/{version:09d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def current(self) -> tuple[int, dict]:
        found = self.versions()
        return (found[-1], self.at(found[-1])) if found else (0, {})

    def commit(self, expected: int, says: dict) -> int:
        """Makes ``says`` the version after ``expected``, or raises ``Conflict`` if that is there."""
        folder, target = f"{self.root}/_versions", f"{self.root}/_versions/{expected + 1:09d}.json"
        passing = self._path(f"{folder}/.{uuid.uuid4().hex}.tmp")
        out = self._fs.create(passing, False)
        out.write(bytearray(json.dumps(says, sort_keys=True).encode()))
        out.close()
        fs = self.spark._jvm.org.apache.hadoop.fs
        try:
            never = self.spark.sparkContext._gateway.new_array(fs.Options.Rename, 1)
            never[0] = fs.Options.Rename.NONE
            fs.FileContext.getFileContext(self._path(self.root).toUri() if ":" in self.root else self._fs.getUri(), self._conf).rename(passing, self._path(target), never)
        except Exception as error:
            self._fs.delete(passing, False)
            if self._fs.exists(self._path(target)):
                raise Conflict(f"version {expected + 1} of {self.root} is there already") from error
            raise
        return expected + 1

    def change(self, step: Callable[[dict], dict], tries: int = 5) -> int:
        """Commits ``step`` of the current version; after a lost race it is worked out anew from the winner's."""
        for left in range(tries - 1, -1, -1):
            version, says = self.current()
            try:
                return self.commit(version, step(says))
            except Conflict:
                if not left:
                    raise
        raise AssertionError
