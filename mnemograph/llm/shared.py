"""What the operators share: tables in the shared folder, running sums, connected components."""

from __future__ import annotations

import functools
import operator
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word start and all of the word, for Java's regular expressions.
SPACE_CLASS = r"\x20\x09-\x0D"


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where unset in local mode (tests), a local one that is then set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


class Scratch:
    """Tables written to the shared folder; ``keep`` writes and rereads, ``drop`` removes."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root = spark, f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
        self.n = 0

    def path(self, label: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}-{label}"

    def keep(self, df: DataFrame, label: str = "t", **options) -> DataFrame:
        path = self.path(label)
        schema = df.schema
        df.write.options(**options).parquet(path)
        out = self.spark.read.schema(schema).parquet(path)
        out._mnemo_path = path
        return out

    def clear(self, *but: DataFrame) -> None:
        """Removes all tables of this folder but those given, which hold results."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        root = jvm.org.apache.hadoop.fs.Path(self.root)
        fs = root.getFileSystem(conf)
        kept = {t._mnemo_path.rsplit("/", 1)[-1] for t in but}
        for found in fs.listStatus(root) if fs.exists(root) else ():
            if found.getPath().getName() not in kept:
                fs.delete(found.getPath(), True)

    def drop(self, *tables: DataFrame) -> None:
        """Removes tables that nothing reads any more."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for t in tables:
            p = jvm.org.apache.hadoop.fs.Path(t if isinstance(t, str) else t._mnemo_path)
            p.getFileSystem(conf).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text, 0 for null: each word and what stands round it becomes one letter."""
    one = F.regexp_replace(text, rf"[{SPACE_CLASS}]*+[^{SPACE_CLASS}]++[{SPACE_CLASS}]*+", "x")
    return F.when(F.coalesce(F.length(F.translate(text, " \t\n\x0b\x0c\r", "")), F.lit(0)) > 0, F.length(one)).otherwise(0).cast("long")


def running_start(df: DataFrame, groups: list[str], order: list[str], value: str, out: str, scratch: Scratch, cells: int = 256) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows before each row, by ``groups``, in the order of ``order``.

    The first order column must be a non-negative long spread evenly over [0, 2^62); it is cut into ``cells``
    ranges. Sums run over cells (a few rows) and then inside each cell, so that no group, however large,
    has to be in one task.
    """
    cell = F.shiftright(F.col(order[0]), 62 - (cells - 1).bit_length()).cast("int")
    df = df.withColumn("_cell", cell)
    sums = df.groupBy(*groups, "_cell").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*groups).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(*groups, "_cell", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*groups, "_cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_in", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    names = [*groups, "_cell"]
    joined = df.alias("l").join(base.alias("r"), functools.reduce(operator.and_, [F.col(f"l.{n}").eqNullSafe(F.col(f"r.{n}")) for n in names]))
    keep = [F.col(f"l.{c}").alias(c) for c in df.columns if c not in ("_cell", "_in")]
    return joined.select(*keep, (F.col("r._base") + F.col("l._in")).alias(out))


def components(edges: DataFrame, scratch: Scratch, most_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges`` (a, b): rows (node, label) with the smallest node of each component.

    Each round takes the least label among a node's neighbours and then follows labels twice; rounds grow with the
    logarithm of a component's diameter. Only a count reaches the driver.
    """
    both = scratch.keep(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    labels = scratch.keep(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    for _ in range(most_rounds):
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        hooked = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        # a node's old label takes the new one too, so that whole trees move at once
        moved = hooked.groupBy(F.col("was").alias("root")).agg(F.min("label").alias("up"))
        step = hooked.join(moved.select(F.col("root").alias("label"), "up"), "label", "left").select("node", "was", F.least("label", F.coalesce("up", "label")).alias("label"))
        step = scratch.keep(step, "labels")
        changed = step.where("label <> was").limit(1).count()
        scratch.drop(labels)
        labels = step.select("node", "label")
        labels._mnemo_path = step._mnemo_path
        if not changed:
            break
    else:
        raise RuntimeError("components did not settle")
    scratch.drop(both)
    return labels
