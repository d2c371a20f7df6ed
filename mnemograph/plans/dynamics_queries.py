"""Queries on placement and on the dynamics of memories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dynamics, graph, placement
from . import adapters as A
from .catalog import query

_N = f"WITH {A.NODES}"
_G = f"WITH {A.NODES}, {A.EDGES}, {A.PAIRS}"
_DEG = "deg AS (SELECT n.id, count(s.dst) AS degree, count(s.dst)::DOUBLE / ((SELECT count(*) FROM nodes) - 1) AS centrality FROM nodes n LEFT JOIN sym s ON s.src = n.id GROUP BY 1)"
_AGE = f"greatest(0, date_diff('second', updated_at, TIMESTAMP '{A.NOW}') / 86400.0)::DOUBLE"
_INC = "inc AS (SELECT id, count(*) AS records FROM (SELECT source_id AS id FROM edges UNION ALL SELECT target_id FROM edges) GROUP BY 1)"
_D8 = "least(records / 8.0, 1)::DOUBLE"
_STATE = f"""{_INC}, st0 AS (SELECT nodes.*, coalesce(records, 0) AS records FROM nodes LEFT JOIN inc USING (id)),
st1 AS (SELECT *, least(1, 0.35::DOUBLE * least(access_count / 10.0::DOUBLE, 1) + 0.2::DOUBLE * importance + 0.15::DOUBLE * confidence + 0.15::DOUBLE * {_D8} + 0.15::DOUBLE * stability) AS score FROM st0),
st AS (SELECT *, CASE WHEN access_count >= 10 AND score >= 0.72 THEN 3 WHEN access_count >= 5 AND score >= 0.6 THEN 2 WHEN access_count >= 2 OR score >= 0.45 THEN 1 ELSE 0 END AS rank_ FROM st1),
ret AS (SELECT *, exp(-{_AGE} / (21.0::DOUBLE * greatest(0.25, least(8, 1 + 0.35::DOUBLE * rank_ + 1.2::DOUBLE * stability + 0.6::DOUBLE * (importance - 0.5) + 0.8::DOUBLE * least(ln(1 + access_count) / ln(9::DOUBLE), 1) + 0.1::DOUBLE * {_D8})) / ln(2::DOUBLE))) AS r FROM st)"""
_NAMES = "['new','candidate','stable','consolidated'][rank_ + 1]"


def _stated(spark, sf_dir):
    return dynamics.with_state(A.nodes(spark, sf_dir), graph.incidence(A.edges(spark, sf_dir)))


@query("place_centrality", f"""{_G}, {_DEG}, o AS (SELECT id, row_number() OVER (ORDER BY centrality DESC, id) - 1 AS i, count(*) OVER () AS n FROM deg)
SELECT id, (5 * i // n)::INT AS ring, CASE WHEN 5 * i // n = 0 THEN 'core' ELSE 'community_' || (5 * i // n) END AS sector FROM o""")  # fmt: skip
def place_centrality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placement.by_centrality(A.nodes(spark, sf_dir), A.edges(spark, sf_dir))


@query("place_temporal", f"""{_N}, o AS (SELECT id, row_number() OVER (ORDER BY updated_at DESC, id) - 1 AS i, count(*) OVER () AS n FROM nodes)
SELECT id, (5 * i // n)::INT AS ring, ['today','week','month','quarter','older'][5 * i // n + 1] AS sector FROM o""")  # fmt: skip
def place_temporal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placement.by_age(A.nodes(spark, sf_dir))


@query("place_hierarchy", """
WITH w AS (SELECT 'r' || r_regionkey AS id, NULL AS p, 0 AS ring, coalesce(regexp_extract(lower(r_name), '[a-z0-9]+'), 'general') AS sector FROM region
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 1, regexp_extract(lower(n_name), '[a-z0-9]+') FROM nation),
c AS (SELECT 'c' || c_custkey AS id, 2 AS ring, w.sector FROM customer JOIN w ON w.id = 'n' || c_nationkey)
SELECT id, ring, sector FROM w UNION ALL SELECT * FROM c UNION ALL SELECT 'o' || o_orderkey, 3, c.sector FROM orders JOIN c ON c.id = 'c' || o_custkey""")  # fmt: skip
def place_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .graph_queries import _tree

    return placement.by_hierarchy(_tree(spark, sf_dir))


@query("place_hybrid", f"""{_G}, {_DEG}, d AS (SELECT id, degree + 1 AS deg, memory_type FROM deg JOIN nodes USING (id)),
h AS (SELECT greatest(4, floor(quantile_cont(deg, 0.8))) AS hub, max(deg) AS m FROM d WHERE memory_type <> 'document'), c AS (SELECT min(id) AS core FROM d, h WHERE memory_type <> 'document' AND deg = m)
SELECT id, CASE WHEN id = core THEN 0 WHEN memory_type = 'document' THEN 4 WHEN memory_type IN ('fact', 'event') THEN 3 WHEN deg >= hub THEN 1 WHEN memory_type IN ('concept', 'relation') THEN 2 WHEN deg >= 2 THEN 2 ELSE 3 END AS ring FROM d, h, c""")  # fmt: skip
def place_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placement.hybrid(A.nodes(spark, sf_dir), A.edges(spark, sf_dir))


_CENTROID = "fl AS (SELECT unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM nodes), mean_ AS (SELECT list(v ORDER BY i) AS c FROM (SELECT i, avg(v) AS v FROM fl GROUP BY 1))"


@query("ring_bands_quantile", f"""{_N}, {_CENTROID}, d AS (SELECT id, round(sqrt(list_sum(list_transform(list_zip(embedding, c), lambda p: pow(p[1] - p[2], 2)))), 6) AS distance FROM nodes, mean_),
q AS (SELECT quantile_cont(distance, [0.2, 0.4, 0.6, 0.8]) AS q FROM d) SELECT id, distance, len(list_filter(q, lambda x: x < distance)) AS ring FROM d, q""")  # fmt: skip
def ring_bands_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placement.distance_rings(A.nodes(spark, sf_dir))


@query("radial_distance", f"""{_G}, {_DEG}, {_CENTROID}, t AS (SELECT max(centrality) AS top FROM deg)
SELECT id, round(greatest(0, least(1, 0.4::DOUBLE * greatest(0, least(1, 1 - round(list_dot_product(embedding, c) / (sqrt(list_dot_product(embedding, embedding)) * sqrt(list_dot_product(c, c))), 6)))
  + 0.2::DOUBLE * ring / 4 + 0.3::DOUBLE * (1 - centrality / top) + 0.1::DOUBLE * least(1, {_AGE} / 30))), 4)::DOUBLE AS radial_distance FROM nodes JOIN deg USING (id), mean_, t""")  # fmt: skip
def radial_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placement.radial(A.nodes(spark, sf_dir), A.edges(spark, sf_dir), A.now())


@query("sector_names", f"""{_N}, w AS (SELECT sector, unnest(regexp_extract_all(lower(concept), '[a-z][a-z\\-]{{2,}}')) AS w FROM nodes),
c AS (SELECT sector, w, row_number() OVER (PARTITION BY sector ORDER BY count(*) DESC, w) AS r FROM w GROUP BY sector, w) SELECT sector, substr(w, 1, 24) AS name FROM c WHERE r = 1""")  # fmt: skip
def sector_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placement.name_sectors(A.nodes(spark, sf_dir), "sector")


@query("figure_angles", f"""{_N}, s AS (SELECT sector, row_number() OVER (ORDER BY sector) - 1 AS s, count(*) OVER () AS m FROM (SELECT DISTINCT sector FROM nodes)),
p AS (SELECT id, sector, row_number() OVER (PARTITION BY sector ORDER BY id) AS i, count(*) OVER (PARTITION BY sector) AS n FROM nodes) SELECT id, round(2 * pi() * (s + (i - 0.5) / n) / m, 6) AS angle FROM p JOIN s USING (sector)""")  # fmt: skip
def figure_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placement.angles(A.nodes(spark, sf_dir), "sector").withColumn("angle", F.round("angle", 6))


@query("polar_geometry", f"""{_N} SELECT id, least(4, floor(5 * radial_distance))::INT AS ring, (floor(8 * (2 * pi() * stability) / (2 * pi())) % 8)::INT AS sector FROM nodes""")
def polar_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    ring, sector = placement.geometry(F.col("radial_distance"), 2 * F.pi() * F.col("stability") - F.pi())
    return A.nodes(spark, sf_dir).select("id", ring.alias("ring"), sector.alias("sector"))


_MEMBERS = """fl AS (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM nodes), ct AS (SELECT label AS cid, list(v ORDER BY i) AS c FROM (SELECT label, i, avg(v) AS v FROM fl GROUP BY ALL) GROUP BY 1),
sm AS (SELECT id, num, cid, round(list_dot_product(embedding, c) / (sqrt(list_dot_product(embedding, embedding)) * sqrt(list_dot_product(c, c))), 6) AS s FROM nodes, ct),
bm AS (SELECT * FROM sm WHERE s > 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY s DESC, cid) <= 3), mem AS (SELECT id, num, cid, s / sum(s) OVER (PARTITION BY id) AS w FROM bm)"""


def _members(spark, sf_dir):
    n = A.nodes(spark, sf_dir)
    return placement.membership(n, placement.centroid(n, ["label"]).withColumnRenamed("label", "cid"))


@query("soft_membership", f"{_N}, {_MEMBERS} SELECT id, cid, round(w, 5) AS w FROM mem")
def soft_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _members(spark, sf_dir).withColumn("w", F.round("w", 5))


def _kernel(spark, sf_dir, amplitudes):
    m = _members(spark, sf_dir)
    q = m.join(A.nodes(spark, sf_dir).where(F.col("num") % A.EVERY == 0).select("id", F.col("num").alias("query_id")), "id").select("query_id", "cid", "w")
    return placement.overlap(q, m, amplitudes).withColumn("kernel", F.round("kernel", 5))


@query("overlap_kernel", f"{_N}, {_MEMBERS} SELECT q.num AS query_id, m.id, round(sum(q.w * m.w), 5) AS kernel FROM mem q JOIN mem m USING (cid) WHERE q.num % {A.EVERY} = 0 GROUP BY ALL")
def overlap_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kernel(spark, sf_dir, False)


@query("born_kernel", f"{_N}, {_MEMBERS} SELECT q.num AS query_id, m.id, round(pow(sum(sqrt(q.w * m.w)), 2), 5) AS kernel FROM mem q JOIN mem m USING (cid) WHERE q.num % {A.EVERY} = 0 GROUP BY ALL")
def born_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kernel(spark, sf_dir, True)


@query("kmeans_clusters")
def kmeans_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placement.clusters(A.nodes(spark, sf_dir), 8)[0]


@query("place_embedding_clusters")
def place_embedding_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placement.place(A.nodes(spark, sf_dir), A.edges(spark, sf_dir), "embedding_clusters", A.now()).select("id", "ring", "sector", "depth", "radial_distance")


@query("consolidation_state", f"{_G}, {_STATE} SELECT id, round(score, 6) AS score, {_NAMES} AS state FROM st")
def consolidation_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stated(spark, sf_dir).select("id", F.round("score", 6).alias("score"), "state")


@query("state_histogram", f"{_G}, {_STATE} SELECT s AS state, count(id) AS nodes FROM (SELECT unnest(['new','candidate','stable','consolidated']) AS s) LEFT JOIN st ON s = {_NAMES} GROUP BY 1")
def state_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = spark.createDataFrame([(s,) for s in dynamics.STATES], "state string")
    return known.join(_stated(spark, sf_dir).groupBy("state").agg(F.count(F.lit(1)).alias("nodes")), "state", "left").select("state", F.coalesce("nodes", F.lit(0)).alias("nodes"))


_SOFT = f"exp(-{_AGE} / (21.0::DOUBLE / ln(2::DOUBLE) * (1 + 0.5::DOUBLE * {_D8} * confidence)))"
_FADED = "CASE WHEN r < 0.999 THEN round(greatest(importance * r, importance * 0.15::DOUBLE, 0.05), 4) ELSE importance END"


@query("soft_decay", f"{_G}, {_STATE}, z AS (SELECT id, importance, {_SOFT} AS r FROM st) SELECT id, round(r, 6) AS retention, r < 0.999 AS faded, round({_FADED}, 4)::DOUBLE AS new_importance FROM z")
def soft_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dynamics.decay(_stated(spark, sf_dir), dynamics.soft_retention(A.now()))
    return d.select("id", F.round("retention", 6).alias("retention"), "faded", F.round("new_importance", 4).alias("new_importance"))


@query("decay_report", f"{_G}, {_STATE}, z AS (SELECT {_SOFT} AS r FROM st) SELECT count(*) AS nodes, count(*) FILTER (r < 0.999) AS decayed, round(avg(r), 4) AS retention_mean, round(least(1, min(r)), 4) AS retention_min, round(greatest(0, max(r)), 4) AS retention_max FROM z")
def decay_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dynamics.decay_report(dynamics.decay(_stated(spark, sf_dir), dynamics.soft_retention(A.now())))


@query("adaptive_decay", f"{_G}, {_STATE} SELECT id, round(r, 6) AS retention, round({_FADED}, 4)::DOUBLE AS new_importance FROM ret")
def adaptive_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dynamics.decay(_stated(spark, sf_dir), dynamics.adaptive_retention(A.now()))
    return d.select("id", F.round("retention", 6).alias("retention"), F.round("new_importance", 4).alias("new_importance"))


_LATER = "TIMESTAMP '2024-02-21 00:00:00'"


@query("adaptive_decay_passes", f"""{_G}, {_STATE}, one AS (SELECT *, {_FADED} AS imp, TIMESTAMP '{A.NOW}' AS passed FROM ret),
two AS (SELECT id, r AS r1, imp, exp(-greatest(0, date_diff('second', greatest(updated_at, passed), {_LATER}) / 86400.0)::DOUBLE / (21.0::DOUBLE * greatest(0.25, least(8, 1 + 0.35::DOUBLE * rank_ + 1.2::DOUBLE * stability + 0.6::DOUBLE * (imp - 0.5) + 0.8::DOUBLE * least(ln(1 + access_count) / ln(9::DOUBLE), 1) + 0.1::DOUBLE * {_D8})) / ln(2::DOUBLE))) AS r FROM one)
SELECT id, round(r1, 6) AS first_retention, round(r, 6) AS second_retention, round(CASE WHEN r < 0.999 THEN round(greatest(imp * r, imp * 0.15::DOUBLE, 0.05), 4) ELSE imp END, 4)::DOUBLE AS new_importance FROM two""")  # fmt: skip
def adaptive_decay_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pass, and one twenty days later, which charges these twenty days alone."""
    one = dynamics.adaptive_decay(_stated(spark, sf_dir), A.now()).withColumnRenamed("retention", "first").withColumn("importance", F.col("new_importance"))
    two = dynamics.adaptive_decay(one.drop("faded", "new_importance"), F.lit("2024-02-21 00:00:00").cast("timestamp"))
    return two.select("id", F.round("first", 6).alias("first_retention"), F.round("retention", 6).alias("second_retention"), F.round("new_importance", 4).alias("new_importance"))


@query("reinforce_nodes", f"{_N} SELECT id, round(least(0.98, importance + 0.06::DOUBLE * (1.2 - importance)), 4)::DOUBLE AS importance FROM nodes WHERE access_count > 0")
def reinforce_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.nodes(spark, sf_dir).where("access_count > 0").select("id", dynamics.lifted(F.col("importance")).alias("importance"))


@query("homeostasis", f"""{_N}, c AS (SELECT least(0.98, greatest(quantile_cont(importance, 0.95), 0.5))::DOUBLE AS cap FROM nodes)
SELECT id, round(cap, 6) AS cap, round(CASE WHEN importance > cap THEN least(0.98, cap + (importance - cap) * 0.25) ELSE importance END, 4)::DOUBLE AS new_importance FROM nodes, c""")  # fmt: skip
def homeostasis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dynamics.homeostasis(A.nodes(spark, sf_dir)).select("id", F.round("cap", 6).alias("cap"), F.round("new_importance", 4).alias("new_importance"))


_PRIO = f"0.35::DOUBLE * (1 - r) * importance + 0.2::DOUBLE * least(access_count / 8.0::DOUBLE, 1) + 0.15::DOUBLE * stability + 0.1::DOUBLE * {_D8} + 0.1::DOUBLE * least(failures / 3.0::DOUBLE, 1) + 0.1::DOUBLE * rank_ / 3"


@query("replay_select", f"""{_G}, {_STATE}, p AS (SELECT id, round(least(1, {_PRIO}), 6) AS priority FROM ret)
SELECT id, priority, row_number() OVER (ORDER BY priority DESC, id) AS rank FROM p QUALIFY rank <= 100""")  # fmt: skip
def replay_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dynamics.select_replay(_stated(spark, sf_dir), A.now(), 100)


@query("replay_apply", f"""{_G}, {_STATE}, p AS (SELECT *, round(least(1, {_PRIO}), 6) AS priority FROM ret), c AS (SELECT * FROM p QUALIFY row_number() OVER (ORDER BY priority DESC, id) <= 100)
SELECT id, round(least(0.98, importance + 0.06::DOUBLE * (1.2 - importance)), 4)::DOUBLE AS new_importance, round(least(1, stability + 0.12), 6)::DOUBLE AS new_stability FROM c""")  # fmt: skip
def replay_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    stated = _stated(spark, sf_dir)
    return dynamics.replay(stated, dynamics.select_replay(stated, A.now(), 100), A.now()).select("id", "new_importance", F.round("new_stability", 6).alias("new_stability"))


@query("touch_uses", f"""{_G}, {_STATE} SELECT id, round(greatest(0, least(1, stability + CASE WHEN failures > 10 THEN -0.12::DOUBLE - 0.01::DOUBLE * greatest(0, date_diff('microsecond', last_accessed, TIMESTAMP '{A.NOW}') / 86400e6::DOUBLE)
  ELSE 0.12::DOUBLE * (0.3::DOUBLE * importance + 0.25::DOUBLE * confidence + 0.15::DOUBLE * {_D8} + 0.1::DOUBLE * least((access_count + 1) / 10.0::DOUBLE, 1)) END)), 6)::DOUBLE AS new_stability,
  access_count + (failures <= 10)::INT AS new_access, failures + (failures > 10)::INT AS new_failures FROM st WHERE last_accessed IS NOT NULL""")  # fmt: skip
def touch_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    stated = _stated(spark, sf_dir)
    uses = stated.where("last_accessed is not null").select("id", (F.col("failures") > 10).alias("failed"), "last_accessed")
    return dynamics.touch(stated, uses, A.now()).withColumn("new_stability", F.round("new_stability", 6))


@query("ring_migration", f"""{_G}, {_STATE}, i AS (SELECT id, ring, ring - 1 AS new_ring FROM ret WHERE ring > 0 AND access_count >= 3 AND stability >= 0.55 QUALIFY row_number() OVER (ORDER BY id) <= 64)
SELECT * FROM i UNION ALL SELECT id, ring, ring + 1 FROM ret ANTI JOIN i USING (id) WHERE ring < 4 AND importance <= 0.05 AND r <= 1e-3""")  # fmt: skip
def ring_migration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dynamics.migrate_rings(_stated(spark, sf_dir), A.now())


@query("merge_candidates", f"""{_N}, s AS (SELECT a.id AS a, b.id AS b, round(list_dot_product(a.embedding, b.embedding) / (sqrt(list_dot_product(a.embedding, a.embedding)) * sqrt(list_dot_product(b.embedding, b.embedding))), 4) AS similarity FROM nodes a JOIN nodes b ON a.id < b.id)
SELECT * FROM s WHERE similarity >= 0.45 ORDER BY similarity DESC, a, b LIMIT 500""")  # fmt: skip
def merge_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dynamics.merge_candidates(A.nodes(spark, sf_dir), 0.45)


@query("dynamics_summary", f"""{_G}, {_STATE} SELECT count(*) AS nodes, round(avg(access_count), 6) AS mean_access, sum(failures)::BIGINT AS failures, count(*) FILTER (r < 0.5) AS at_risk, round(avg(r), 6) AS mean_retention, count(*) FILTER (last_accessed IS NOT NULL) AS active FROM ret""")
def dynamics_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _stated(spark, sf_dir).withColumn("r", dynamics.adaptive_retention(A.now()))
    return s.agg(F.count(F.lit(1)).alias("nodes"), F.round(F.avg("access_count"), 6).alias("mean_access"), F.sum("failures").alias("failures"), F.count_if(F.col("r") < 0.5).alias("at_risk"), F.round(F.avg("r"), 6).alias("mean_retention"), F.count("last_accessed").alias("active"))


@query("dynamics_listing", f"""{_G}, {_STATE} SELECT id, {_NAMES} AS state, round(score, 6) AS score, access_count FROM st WHERE rank_ >= 1 ORDER BY round(score, 6) DESC, id LIMIT 50""")
def dynamics_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _stated(spark, sf_dir).where("state <> 'new'").select("id", "state", F.round("score", 6).alias("score"), "access_count")
    return s.orderBy(F.col("score").desc(), "id").limit(50)


@query("node_reasons", f"""{_G}, {_STATE} SELECT id, {_NAMES} AS state, CASE WHEN access_count = 0 THEN 'never retrieved' ELSE access_count || ' retrievals' END || '; ' || coalesce('last used ' || strftime(last_accessed, '%Y-%m-%d %H:%M:%S'), 'no recorded use') || '; retention ' || printf('%.2f', r) AS why_decayed,
'score ' || printf('%.2f', score) || ' from access ' || access_count || ', importance ' || printf('%.2f', importance) || ', confidence ' || printf('%.2f', confidence) || ', stability ' || printf('%.2f', stability) || ['; next is candidate', '; next is stable', '; next is consolidated', '; fully consolidated, fades more slowly'][rank_ + 1] AS why_settled FROM ret""")  # fmt: skip
def node_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dynamics.reasons(_stated(spark, sf_dir), A.now()).select("id", "state", "why_decayed", "why_settled")


@query("at_risk_nodes", f"""{_G}, {_STATE} SELECT id, round(r, 6) AS retention, row_number() OVER (ORDER BY round(r, 6), id) AS rank FROM ret WHERE round(r, 6) < 0.5 QUALIFY rank <= 20""")
def at_risk_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dynamics.at_risk(_stated(spark, sf_dir), A.now())
