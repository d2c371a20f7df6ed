"""The driver's tables as a memory graph: nodes, edges, queries and logs, and the same as SQL.

Vectors are nodes: their coordinates come from their numbers, their use from the events of the user with the same number
(mod 150). Benchmark passages are text queries, every hundredth vector is a query. ``NOW`` is the clock.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NOW = "2024-02-01 00:00:00"
#: Users of the log; queries and starts of walks are the vectors whose number this divides.
USERS, EVERY = 150, 100


def now():
    return F.lit(NOW).cast("timestamp")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user, access_count, failures, last_accessed."""
    e = table(spark, sf_dir, "events").select((F.col("user_id") % USERS).alias("user"), "event_type", "ts")
    return e.groupBy("user").agg(
        F.sum(F.when(F.col("event_type") != "error", 1).otherwise(0)).alias("access_count"),
        F.sum(F.when(F.col("event_type") == "error", 1).otherwise(0)).alias("failures"),
        F.max(F.col("ts").cast("timestamp")).alias("last_accessed"),
    )


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector nodes with coordinates, worth and use."""
    e, i = table(spark, sf_dir, "embeddings"), F.col("vec_id")
    kind = F.element_at(F.array(*map(F.lit, ("concept", "fact", "event", "relation", "document"))), (i % 5 + 1).cast("int"))
    base = e.select(
        F.concat(F.lit("v"), F.lpad(i.cast("string"), 8, "0")).alias("id"), i.alias("num"), F.col("label").cast("long").alias("label"), "embedding",
        F.concat(F.lit("topic "), F.col("label"), F.lit(" item "), i % 17).alias("concept"),
        F.concat(F.lit("group "), i % 7, F.lit(" of class "), F.col("label")).alias("summary"),
        F.concat(F.lit("topic "), i % 50, F.lit(" is "), i % 7).alias("raw_text"),
        kind.alias("memory_type"), (i % 5).cast("int").alias("ring"), F.concat(F.lit("sector_"), F.col("label")).alias("sector"),
        (i * 37 % 1000 / 1000).alias("radial_distance"), (i * 53 % 97 / 97).alias("importance"), (i * 29 % 89 / 89).alias("confidence"),
        F.timestamp_seconds(F.unix_seconds(now()) - (i % 45) * 86_400).alias("updated_at"), (i % USERS).alias("user"),
    )
    out = base.join(activity(spark, sf_dir), "user", "left")
    return out.withColumns({"access_count": F.coalesce("access_count", F.lit(0)).cast("long"), "failures": F.coalesce("failures", F.lit(0)).cast("long"), "stability": F.col("num") * 13 % 83 / 83})


def replicated(nodes: DataFrame, most: int) -> DataFrame:
    """As many nodes as ``most`` allows: whole copies of ``nodes`` with numbers of their own and vectors turned a little."""
    n = nodes.count()
    copies = max(1, most // max(1, n))
    each = nodes.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))).withColumn("num", F.col("num") + F.col("copy") * n)
    turned = F.transform("embedding", lambda x, i: x + F.when(F.col("copy") > 0, 0.05 * F.sin((F.col("num") * 31 + i * 7).cast("double"))).otherwise(0.0))
    return each.withColumns({"id": F.concat(F.lit("v"), F.lpad(F.col("num").cast("string"), 8, "0")), "embedding": turned}).drop("copy")


NODES = f"""
act AS (SELECT user_id % {USERS} AS usr, count(*) FILTER (event_type <> 'error') AS access_count,
  count(*) FILTER (event_type = 'error') AS failures, max(ts) AS last_accessed FROM events GROUP BY 1),
nodes AS (SELECT 'v' || lpad(vec_id::VARCHAR, 8, '0') AS id, vec_id AS num, label::BIGINT AS label, embedding::DOUBLE[] AS embedding,
  'topic ' || label || ' item ' || vec_id % 17 AS concept, 'group ' || vec_id % 7 || ' of class ' || label AS summary,
  'topic ' || vec_id % 50 || ' is ' || vec_id % 7 AS raw_text,
  ['concept','fact','event','relation','document'][vec_id % 5 + 1] AS memory_type, (vec_id % 5)::INT AS ring,
  'sector_' || label AS sector, (vec_id * 37 % 1000)::DOUBLE / 1000 AS radial_distance,
  (vec_id * 53 % 97)::DOUBLE / 97 AS importance, (vec_id * 29 % 89)::DOUBLE / 89 AS confidence,
  TIMESTAMP '{NOW}' - to_days((vec_id % 45)::INT) AS updated_at, coalesce(access_count, 0) AS access_count,
  coalesce(failures, 0) AS failures, last_accessed, (vec_id * 13 % 83)::DOUBLE / 83 AS stability
  FROM embeddings LEFT JOIN act ON vec_id % {USERS} = usr)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges_of(nodes(spark, sf_dir))


def edges_of(nodes: DataFrame) -> DataFrame:
    """source_id, target_id, relation_type, weight, confidence: neighbours within a class, and some across."""
    n = nodes.select("id", "num", "label")
    along = n.select(F.col("id").alias("source_id"), F.lead("id").over(Window.partitionBy("label").orderBy("num")).alias("target_id"), "num").where("target_id is not null")
    along = along.select("source_id", "target_id", F.lit("next").alias("relation_type"), (0.2 + F.col("num") % 10 / 10).alias("weight"), (0.5 + F.col("num") % 5 / 10).alias("confidence"))
    size = n.agg(F.count(F.lit(1)).alias("n"))
    across = n.where("num % 3 = 0").crossJoin(F.broadcast(size)).select("id", "num", F.concat(F.lit("v"), F.lpad(((F.col("num") * 7 + 3) % F.col("n")).cast("string"), 8, "0")).alias("target_id"))
    across = across.join(n.select(F.col("id").alias("target_id")), "target_id")
    across = across.select(F.col("id").alias("source_id"), "target_id", F.concat(F.lit("rel"), F.col("num") % 4).alias("relation_type"), (0.05 + F.col("num") % 20 / 10).alias("weight"), (0.4 + F.col("num") % 6 / 10).alias("confidence"))
    return along.unionByName(across)


EDGES = """
edges AS (SELECT id AS source_id, target_id, 'next' AS relation_type, 0.2::DOUBLE + (num % 10)::DOUBLE / 10 AS weight,
    0.5::DOUBLE + (num % 5)::DOUBLE / 10 AS confidence
  FROM (SELECT id, num, lead(id) OVER (PARTITION BY label ORDER BY num) AS target_id FROM nodes) WHERE target_id IS NOT NULL
  UNION ALL
  SELECT a.id, b.id, 'rel' || a.num % 4, 0.05::DOUBLE + (a.num % 20)::DOUBLE / 10, 0.4::DOUBLE + (a.num % 6)::DOUBLE / 10
  FROM nodes a JOIN nodes b ON b.num = (a.num * 7 + 3) % (SELECT count(*) FROM nodes) WHERE a.num % 3 = 0)"""

PAIRS = """
pairs AS (SELECT least(source_id, target_id) AS a, greatest(source_id, target_id) AS b, max(weight) AS weight,
    list_sort(list_distinct(list(relation_type))) AS relations, max_by(confidence, (weight, confidence)) AS confidence
  FROM edges WHERE source_id <> target_id GROUP BY 1, 2),
sym AS (SELECT a AS src, b AS dst, weight, confidence FROM pairs UNION ALL SELECT b, a, weight, confidence FROM pairs)"""


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, vector, label: the vectors that are asked with."""
    e = table(spark, sf_dir, "embeddings").where(F.col("vec_id") % EVERY == 0)
    return e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"), F.col("label").cast("long").alias("query_label"))


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores where a table has fewer splits than there are cores, as small files do; larger ones stay as read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts, on which expressions are costly."""
    return spread(table(spark, sf_dir, "documents"))


def text_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """subject, seq, content, source: each conversation is a subject, each turn a version."""
    c = table(spark, sf_dir, "conversations")
    return c.select(F.concat(F.lit("Conversation "), F.col("conv_id")).alias("subject"), F.col("turn").alias("seq"), F.col("text").alias("content"), F.col("role").alias("source"))
