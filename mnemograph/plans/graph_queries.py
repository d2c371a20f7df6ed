"""Queries over the memory graph: joins, traversals, degrees, retrieval, activation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..operators import activation, graph, retrieval
from . import adapters as A
from .catalog import query

_G = f"WITH {A.NODES}, {A.EDGES}, {A.PAIRS}"
_RG = f"WITH RECURSIVE {A.NODES}, {A.EDGES}, {A.PAIRS}"


def _sym(spark, sf_dir):
    return graph.symmetric(graph.pairs(A.edges(spark, sf_dir)))


def _some(spark, sf_dir):
    return A.nodes(spark, sf_dir).where(F.col("num") % A.EVERY == 0).select("id")


@query("edge_collapse", f"{_G} SELECT a, b, round(weight, 6) AS weight, array_to_string(relations, ',') AS relations, round(confidence, 6) AS confidence FROM pairs")
def edge_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = graph.collapse(A.edges(spark, sf_dir))
    return c.select("a", "b", F.round("weight", 6).alias("weight"), F.array_join("relations", ",").alias("relations"), F.round("confidence", 6).alias("confidence"))


@query("degree_centrality", f"""{_G}, d AS (SELECT src AS id, count(*) AS degree FROM sym GROUP BY 1)
SELECT n.id, coalesce(degree, 0) AS degree, round(coalesce(degree, 0)::DOUBLE / ((SELECT count(*) FROM nodes) - 1), 9) AS centrality FROM nodes n LEFT JOIN d USING (id)""")  # fmt: skip
def degree_centrality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degree(A.nodes(spark, sf_dir), A.edges(spark, sf_dir)).withColumn("centrality", F.round("centrality", 9))


@query("incident_records", f"{_G} SELECT id, count(*) AS records FROM (SELECT source_id AS id FROM edges UNION ALL SELECT target_id FROM edges) GROUP BY 1")
def incident_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.incidence(A.edges(spark, sf_dir))


@query("degree_statistics", f"""{_G}, d AS (SELECT n.id, count(s.dst) AS degree FROM nodes n LEFT JOIN sym s ON s.src = n.id GROUP BY 1)
SELECT count(*) AS n, min(degree) AS lowest, max(degree) AS highest, round(avg(degree), 6) AS mean, quantile_cont(degree, 0.5)::DOUBLE AS median, round(stddev_pop(degree), 6) AS deviation FROM d""")  # fmt: skip
def degree_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = graph.degree_statistics(graph.degree(A.nodes(spark, sf_dir), A.edges(spark, sf_dir)))
    return d.withColumns({"mean": F.round("mean", 6), "deviation": F.round("deviation", 6)})


@query("degree_histogram", f"""{_G}, d AS (SELECT n.id, count(s.dst) AS degree FROM nodes n LEFT JOIN sym s ON s.src = n.id GROUP BY 1)
SELECT degree, count(*) AS nodes FROM d GROUP BY 1""")  # fmt: skip
def degree_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degree(A.nodes(spark, sf_dir), A.edges(spark, sf_dir)).groupBy("degree").agg(F.count(F.lit(1)).alias("nodes"))


@query("neighbours_by_relation", f"""{_G}, b AS (SELECT source_id AS id, target_id AS o, relation_type FROM edges UNION ALL SELECT target_id, source_id, relation_type FROM edges)
SELECT id, relation_type, array_to_string(list_sort(list_distinct(list(o))), ',') AS neighbours FROM b GROUP BY ALL""")  # fmt: skip
def neighbours_by_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.neighbours_by_relation(A.edges(spark, sf_dir)).withColumn("neighbours", F.array_join("neighbours", ","))


@query("edge_lookup", f"""{_G} SELECT q.query_id, e.source_id, e.target_id, e.relation_type, round(e.weight, 6) AS weight FROM edges e
JOIN (SELECT vec_id AS query_id, 'v' || lpad(vec_id::VARCHAR, 8, '0') AS id FROM embeddings WHERE vec_id % {A.EVERY} = 0) q ON q.id = e.source_id OR q.id = e.target_id""")  # fmt: skip
def edge_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = A.nodes(spark, sf_dir).where(F.col("num") % A.EVERY == 0).select(F.col("num").alias("query_id"), F.col("id").alias("qid"))
    e = A.edges(spark, sf_dir).withColumn("ends", F.array("source_id", "target_id")).withColumn("qid", F.explode(F.array_distinct("ends")))
    return e.join(q, "qid").select("query_id", "source_id", "target_id", "relation_type", F.round("weight", 6).alias("weight"))


@query("khop_ego", f"""{_RG}, e AS (SELECT id AS seed, id, 0 AS hop FROM nodes WHERE num % {A.EVERY} = 0 UNION SELECT e.seed, s.dst, e.hop + 1 FROM e JOIN sym s ON s.src = e.id WHERE e.hop < 2)
SELECT seed, id, min(hop) AS hop FROM e GROUP BY ALL""")  # fmt: skip
def khop_ego(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.ego(_some(spark, sf_dir), _sym(spark, sf_dir), 2)


@query("shortest_path_hops", f"""{_RG}, e(seed, id, hop) USING KEY (seed, id) AS (SELECT id, id, 0 FROM nodes WHERE num % {A.EVERY} = 0
  UNION SELECT e.seed, s.dst, min(e.hop) + 1 FROM e JOIN sym s ON s.src = e.id LEFT JOIN recurring.e o ON o.seed = e.seed AND o.id = s.dst WHERE o.hop IS NULL OR o.hop > e.hop + 1 GROUP BY ALL)
SELECT seed, id, hop FROM e WHERE hop > 0""")  # fmt: skip
def shortest_path_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.hop_distance(_some(spark, sf_dir), _sym(spark, sf_dir))


_PATHS = """p AS (SELECT id AS seed, id, 0::BIGINT AS cost, [id] AS path, 0 AS h FROM {seeds}
  UNION ALL SELECT p.seed, s.dst, p.cost + floor(1e6 / greatest(s.weight, 1e-6) + 0.5)::BIGINT, list_append(p.path, s.dst), p.h + 1 FROM p JOIN sym s ON s.src = p.id WHERE p.h < 3 AND NOT list_contains(p.path, s.dst)),
best AS (SELECT seed, id, arg_min(path, (cost, h, array_to_string(path, '>'))) AS path, min(cost) AS cost FROM p WHERE seed <> id GROUP BY ALL)"""


@query("weighted_path", f"""{_RG}, e(seed, id, cost, h, path) USING KEY (seed, id) AS (SELECT id, id, 0::BIGINT, 0, id FROM nodes WHERE num % {A.EVERY} = 0
  UNION SELECT seed, id, n[1], n[2], n[3] FROM (SELECT e.seed, s.dst AS id, min((e.cost + floor(1e6 / greatest(s.weight, 1e-6) + 0.5)::BIGINT, e.h + 1, e.path || '>' || s.dst)) AS n FROM e JOIN sym s ON s.src = e.id GROUP BY ALL) x
  LEFT JOIN recurring.e o USING (seed, id) WHERE o.cost IS NULL OR n < (o.cost, o.h, o.path))
SELECT seed, id, cost / 1e6::DOUBLE AS cost, path FROM e WHERE seed <> id""")  # fmt: skip
def weighted_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.cheapest_paths(_some(spark, sf_dir), _sym(spark, sf_dir), joined=True)


@query("connected_components", f"""{_RG}, r AS (SELECT id AS root, id FROM nodes UNION SELECT r.root, sym.dst FROM r JOIN sym ON sym.src = r.id)
SELECT id, min(root) AS component FROM r GROUP BY id""")  # fmt: skip
def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.components(A.nodes(spark, sf_dir).select("id"), _sym(spark, sf_dir))


@query("tree_depth_rings", """
SELECT 'r' || r_regionkey AS id, 0 AS depth FROM region UNION ALL SELECT 'n' || n_nationkey, 1 FROM nation
UNION ALL SELECT 'c' || c_custkey, 2 FROM customer UNION ALL SELECT 'o' || o_orderkey, 3 FROM orders JOIN customer ON o_custkey = c_custkey
UNION ALL SELECT 'o' || o_orderkey, 4 FROM orders ANTI JOIN customer ON o_custkey = c_custkey""")  # fmt: skip
def tree_depth_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.tree_depth(_tree(spark, sf_dir), 4)


def _tree(spark, sf_dir):
    t = lambda n: A.table(spark, sf_dir, n)
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    out = t("region").select(key("r", "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent_id"), F.col("r_name").alias("label"), F.lit(0).alias("ring"))
    out = out.unionByName(t("nation").select(key("n", "n_nationkey").alias("id"), key("r", "n_regionkey").alias("parent_id"), F.col("n_name").alias("label"), F.lit(1).alias("ring")))
    out = out.unionByName(t("customer").select(key("c", "c_custkey").alias("id"), key("n", "c_nationkey").alias("parent_id"), F.col("c_name").alias("label"), F.lit(2).alias("ring")))
    return out.unionByName(t("orders").select(key("o", "o_orderkey").alias("id"), key("c", "o_custkey").alias("parent_id"), F.col("o_orderpriority").alias("label"), F.lit(3).alias("ring")))


@query("induced_subgraph", f"""{_G} SELECT source_id, target_id, relation_type, round(weight, 6) AS weight FROM edges
WHERE source_id IN (SELECT id FROM nodes WHERE ring <= 2) AND target_id IN (SELECT id FROM nodes WHERE ring <= 2)""")  # fmt: skip
def induced_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    keep = A.nodes(spark, sf_dir).where("ring <= 2")
    return graph.induced(A.edges(spark, sf_dir), keep).select("source_id", "target_id", "relation_type", F.round("weight", 6).alias("weight"))


@query("ring_lattice", f"""WITH {A.NODES}, o AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS i, count(*) OVER () AS n FROM nodes)
SELECT a.id AS source_id, b.id AS target_id FROM o a JOIN o b ON b.i = (a.i + 1) % a.n OR b.i = (a.i + 2) % a.n""")  # fmt: skip
def ring_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.ring_lattice(A.nodes(spark, sf_dir).select("id"))


_PLACED = f"WITH {A.NODES}, o AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS i, count(*) OVER () AS n FROM nodes)"


@query("hub_circulant", f"""{_PLACED}, p AS (SELECT i, unnest([(i + 1) % n, (i + 2) % n, (i + greatest(1, n // 2)) % n, CASE WHEN i % 4 = 1 THEN 0 END]) AS j FROM o)
SELECT DISTINCT a.id AS source_id, b.id AS target_id FROM p JOIN o a ON a.i = least(p.i, j) JOIN o b ON b.i = greatest(p.i, j) WHERE p.i <> j""")  # fmt: skip
def hub_circulant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.hub_circulant(A.nodes(spark, sf_dir).select("id"))


@query("square_lattice", f"""{_PLACED}, c AS (SELECT i, n, ceil(n / floor(sqrt(n)))::BIGINT AS w FROM o), p AS (SELECT i, i + 1 AS j FROM c WHERE i % w + 1 < w AND i + 1 < n UNION ALL SELECT i, i + w FROM c WHERE i + w < n)
SELECT a.id AS source_id, b.id AS target_id FROM p JOIN o a ON a.i = p.i JOIN o b ON b.i = j""")  # fmt: skip
def square_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.square_lattice(A.nodes(spark, sf_dir).select("id"))


@query("degree_preserving_rewiring")
def rewiring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.rewire(A.edges(spark, sf_dir), seed=7)


_HITS = f"""q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % {A.EVERY} = 0),
cos AS (SELECT query_id, id, round(list_dot_product(v, embedding) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(embedding, embedding))), 6) AS score FROM q, nodes),
hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM cos QUALIFY rank <= 24)"""


@query("vector_topk", f"WITH {A.NODES}, {_HITS} SELECT query_id, id, score, rank FROM hits WHERE rank <= 8")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.vector_topk(A.nodes(spark, sf_dir), A.vector_queries(spark, sf_dir), 8)


@query("graph_rag_topk", f"""{_G}, {_HITS}, h AS (SELECT * FROM hits WHERE rank <= 8), d AS (SELECT src AS id, count(*) AS degree FROM sym GROUP BY 1),
n AS (SELECT DISTINCT query_id, dst AS id FROM h JOIN sym ON src = h.id WHERE rank <= 3),
u AS (SELECT query_id, id, score FROM h UNION ALL SELECT n.query_id, n.id, 0.5 * least(1.0, degree / 5.0) FROM n JOIN d USING (id) ANTI JOIN h ON h.query_id = n.query_id AND h.id = n.id)
SELECT query_id, id, round(score, 6)::DOUBLE AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM u QUALIFY rank <= 8""")  # fmt: skip
def graph_rag_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = retrieval.graph_rag(A.nodes(spark, sf_dir), A.edges(spark, sf_dir), A.vector_queries(spark, sf_dir))
    return g.withColumn("score", F.round("score", 6))


@query("hierarchical_rag_topk", """
WITH tree AS (SELECT 'r' || r_regionkey AS id, NULL AS p, r_name AS label, 0 AS ring FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name, 1 FROM nation
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_name, 2 FROM customer UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey, o_orderpriority, 3 FROM orders),
q AS (SELECT n_nationkey AS query_id, unnest(list_distinct(regexp_extract_all(lower(n_name || ' and ' || r_name), '[a-z0-9]{3,}'))) AS w FROM nation JOIN region ON n_regionkey = r_regionkey),
w AS (SELECT id, unnest(list_distinct(regexp_extract_all(lower(label), '[a-z0-9]{3,}'))) AS w FROM tree WHERE ring <= 1),
h AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY count(*) DESC, id) AS r FROM q JOIN w USING (w) GROUP BY query_id, id QUALIFY r <= 3),
k AS (SELECT id, p AS up, row_number() OVER (PARTITION BY p ORDER BY id) AS p FROM tree WHERE p IS NOT NULL),
f AS (SELECT query_id, k.id, r, p, 0 AS g FROM h JOIN k ON k.up = h.id WHERE p <= 8),
s AS (SELECT query_id, id, r, p, g FROM f UNION ALL SELECT f.query_id, k.id, f.r, f.p, k.p FROM f JOIN k ON k.up = f.id WHERE k.p <= 2),
m AS (SELECT query_id, id, min((r, p, g)) AS spot FROM s GROUP BY ALL)
SELECT query_id, id, round(1 / (1 + rank), 6) AS score, rank FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY spot, id) AS rank FROM m) WHERE rank <= 8""")  # fmt: skip
def hierarchical_rag_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = A.table(spark, sf_dir, "nation"), A.table(spark, sf_dir, "region")
    q = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_nationkey").alias("query_id"), F.concat_ws(" and ", "n_name", "r_name").alias("query"))
    return retrieval.hierarchical_rag(_tree(spark, sf_dir), q)


_SEEDED = f"{_HITS}, seeds AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 5) DESC, id) AS rank FROM hits QUALIFY rank <= 5)"
_A0 = "a0 AS (SELECT query_id, id, least(greatest(score, 0), 1) + 0.3 * importance AS a FROM seeds JOIN nodes USING (id)), sh AS (SELECT src, dst, greatest(0.01, weight) / sum(greatest(0.01, weight)) OVER (PARTITION BY dst) AS s FROM sym)"
_HOP = "a{n} AS (SELECT query_id, id, max(a) AS a FROM (SELECT query_id, id, a * 0.5 AS a FROM a{m} UNION ALL SELECT query_id, dst, sum(s * a) * 0.5 FROM a{m} JOIN sh ON src = id GROUP BY ALL) GROUP BY ALL)"
_ACT = f"{_A0}, {_HOP.format(n=1, m=0)}, {_HOP.format(n=2, m=1)}, act_ AS (SELECT query_id, id, round(least(a, 1.0), 6)::DOUBLE AS activation FROM a2 WHERE a > 1e-4)"


def _seeds(spark, sf_dir):
    hits = retrieval.vector_topk(A.nodes(spark, sf_dir), A.vector_queries(spark, sf_dir), retrieval.CANDIDATES)
    return retrieval.first_hits(hits).select("query_id", "id", F.least(F.greatest("score", F.lit(0.0)), F.lit(1.0)).alias("seed_score"))


@query("activation_continuous", f"{_G}, {_SEEDED}, {_ACT} SELECT query_id, id, activation FROM act_")
def activation_continuous(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activation.continuous(_seeds(spark, sf_dir), A.nodes(spark, sf_dir), _sym(spark, sf_dir))


_TICK = """t{n} AS (SELECT *, least(greatest(v * 0.5 + cur, 0), 1) AS i, rest = 0 AND least(greatest(v * 0.5 + cur, 0), 1) > 0 AND least(greatest(v * 0.5 + cur, 0), 1) >= 0.8 AS spike FROM s{n}),
u{n} AS (SELECT *, CASE WHEN rest > 0 OR spike THEN 0 ELSE i END AS after_, CASE WHEN rest > 0 THEN rest - 1 WHEN spike THEN 1 ELSE 0 END AS rest_, CASE WHEN spike THEN greatest(peak, i) ELSE peak END AS peak_ FROM t{n}),
p{n} AS (SELECT query_id, dst AS id, least(1, sum(i * w)) AS got FROM u{n} JOIN near ON src = id WHERE spike GROUP BY ALL),
s{m} AS (SELECT query_id, id, coalesce(after_, 0)::DOUBLE AS v, coalesce(rest_, 0) AS rest, coalesce(got, 0)::DOUBLE AS cur, coalesce(peak_, 0)::DOUBLE AS peak FROM u{n} FULL JOIN p{n} USING (query_id, id))"""
_LIF = f"""{_SEEDED}, near AS (SELECT src, dst, least(weight, 1) AS w FROM sym WHERE weight > 0 QUALIFY row_number() OVER (PARTITION BY src ORDER BY least(weight, 1) DESC, dst) <= 4),
s0 AS (SELECT query_id, id, 0::DOUBLE AS v, 0 AS rest, least(1, least(greatest(score, 0), 1) + 0.3 * importance)::DOUBLE AS cur, 0::DOUBLE AS peak FROM seeds JOIN nodes USING (id)),
{_TICK.format(n=0, m=1)}, {_TICK.format(n=1, m=2)}, {_TICK.format(n=2, m=3)}"""


@query("activation_lif", f"{_G}, {_LIF} SELECT query_id, id, round(peak, 6) AS peak FROM s3 WHERE peak > 0")
def activation_lif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activation.spiking(_seeds(spark, sf_dir), A.nodes(spark, sf_dir), _sym(spark, sf_dir))[0]


@query("lif_trace", f"""{_G}, {_LIF} SELECT query_id, tick, id, round(v, 6) AS before, round(after_, 6)::DOUBLE AS after, spike
FROM (SELECT 0 AS tick, * FROM u0 UNION ALL SELECT 1, * FROM u1 UNION ALL SELECT 2, * FROM u2)""")  # fmt: skip
def lif_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activation.spiking(_seeds(spark, sf_dir), A.nodes(spark, sf_dir), _sym(spark, sf_dir))[1]


_QT = f"qt AS (SELECT vec_id AS query_id, 'topic ' || label || ' of group ' || vec_id % 7 AS query FROM embeddings WHERE vec_id % {A.EVERY} = 0)"
_CANDS = f"""{_SEEDED}, {_ACT}, top_act AS (SELECT * FROM act_ QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY activation DESC, id) <= 16),
{_PATHS.format(seeds='(SELECT DISTINCT id FROM seeds)')}, {_QT},
qw AS (SELECT query_id, unnest(list_distinct(regexp_extract_all(lower(query), '[a-z0-9]{{3,}}'))) AS w FROM qt),
nw AS (SELECT id, unnest(list_distinct(regexp_extract_all(lower(concept || ' ' || summary), '[a-z0-9]{{3,}}'))) AS w FROM nodes WHERE ring <= 1),
allc AS (SELECT query_id, id, [id] AS path, 0 AS channel, 0 AS place FROM hits
  UNION ALL SELECT query_id, best.id, best.path, 1, rank FROM seeds JOIN sym ON sym.src = seeds.id JOIN best ON best.seed = seeds.id AND best.id = sym.dst
  UNION ALL SELECT query_id, id, [id], 2, 0 FROM top_act UNION ALL SELECT DISTINCT query_id, id, [id], 3, 0 FROM qw JOIN nw USING (w)),
cands AS (SELECT query_id, id, arg_min(path, (channel, place)) AS path, min(channel) AS channel FROM allc GROUP BY ALL),
deg AS (SELECT src AS id, count(*)::DOUBLE / ((SELECT count(*) FROM nodes) - 1) AS c FROM sym GROUP BY 1),
steps AS (SELECT query_id, id, unnest(path[:-2]) AS x, unnest(path[2:]) AS y FROM cands WHERE len(path) > 1),
trust AS (SELECT query_id, steps.id, product(confidence) AS trust FROM steps JOIN pairs ON a = least(x, y) AND b = greatest(x, y) GROUP BY ALL),
comp AS (SELECT cands.query_id, cands.id, path, channel, least(greatest(score, 0), 1)::DOUBLE AS semantic, 1 - ring / 4.0::DOUBLE AS structural, 1 - radial_distance AS radial,
  least(5 * coalesce(c, 0), 1)::DOUBLE AS graph, importance, confidence, greatest(0, 1 - date_diff('second', updated_at, TIMESTAMP '{A.NOW}') / (86400.0 * 30))::DOUBLE AS recency,
  least(1, 2 * coalesce(trust, 1) / len(path))::DOUBLE AS path_score, coalesce(activation, 0)::DOUBLE AS activation
  FROM cands JOIN nodes USING (id) JOIN cos USING (query_id, id) LEFT JOIN deg USING (id) LEFT JOIN trust USING (query_id, id) LEFT JOIN top_act USING (query_id, id))"""
_TERM = {c: "path_score" if c == "path" else c for c in retrieval.WEIGHTS}


def _score_sql(active: tuple[str, ...]) -> str:
    used = [c for c in sorted(active) if retrieval.WEIGHTS[c] > 0]
    total = sum(retrieval.WEIGHTS[c] for c in active) or 1.0
    return "(" + " + ".join(f"{retrieval.WEIGHTS[c]}::DOUBLE * {_TERM[c]}" for c in used) + f") / {total}::DOUBLE"


def _queries(spark, sf_dir):
    q = A.vector_queries(spark, sf_dir)
    return q.withColumn("query", F.concat(F.lit("topic "), F.col("query_label"), F.lit(" of group "), F.col("query_id") % 7))


def _components(spark, sf_dir, systems=None, k=8):
    n, e, q = A.nodes(spark, sf_dir), A.edges(spark, sf_dir), _queries(spark, sf_dir)
    return retrieval.scored_candidates(n, e, q, A.now(), systems=systems, k=k)


_FULL = [(tuple(retrieval.WEIGHTS), retrieval.WEIGHTS)]


@query("component_scores", f"""{_RG}, {_CANDS} SELECT query_id, id, array_to_string(path, '>') AS path, channel, round(semantic, 6) AS semantic, round(structural, 6)::DOUBLE AS structural,
round(radial, 6) AS radial, round(graph, 6) AS graph, round(importance, 6) AS importance, round(confidence, 6) AS confidence, round(recency, 6) AS recency, round(path_score, 6) AS path_score, round(activation, 6) AS activation FROM comp""")  # fmt: skip
def component_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _components(spark, sf_dir)
    keep = ("structural", "radial", "graph", "importance", "confidence", "recency", "path_score", "activation")
    return c.select("query_id", "id", F.array_join("path", ">").alias("path"), "channel", F.round("semantic", 6).alias("semantic"), *[F.round(k, 6).alias(k) for k in keep])


@query("retrieve_full", f"""{_RG}, {_CANDS}, sc AS (SELECT query_id, id, array_to_string(path, '>') AS path, round({_score_sql(tuple(retrieval.WEIGHTS))}, 9) AS score FROM comp)
SELECT query_id, id, path, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM sc QUALIFY rank <= 8""")  # fmt: skip
def retrieve_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _components(spark, sf_dir, _FULL).withColumn("score", N.rounded(retrieval.weighted(tuple(retrieval.WEIGHTS)), 9))
    ranked = retrieval.top(scored, [F.col("score").desc(), F.col("id")], 8)
    return ranked.select("query_id", "id", F.array_join("path", ">").alias("path"), "score", "rank")


_EACH = " UNION ALL ".join(f"SELECT '{n}' AS system, query_id, id, round({_score_sql(s)}, 9) AS score FROM comp" for n, s in retrieval.ABLATIONS.items())


@query("retrieve_ablations", f"""{_RG}, {_CANDS}, sc AS ({_EACH})
SELECT system, query_id, id, score, row_number() OVER (PARTITION BY system, query_id ORDER BY score DESC, id) AS rank FROM sc QUALIFY rank <= 8""")  # fmt: skip
def retrieve_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.ablate(A.nodes(spark, sf_dir), A.edges(spark, sf_dir), _queries(spark, sf_dir), A.now())


@query("retrieve_explain")
def retrieve_explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.retrieve(A.nodes(spark, sf_dir), A.edges(spark, sf_dir), _queries(spark, sf_dir), A.now(), "semantic,graph,path")


_USED = [c for c in sorted(retrieval.WEIGHTS) if retrieval.WEIGHTS[c] > 0]
_ADDS = {c: f"round({_TERM[c]} * {retrieval.WEIGHTS[c]}::DOUBLE / {sum(retrieval.WEIGHTS.values())}::DOUBLE, 6)" for c in _USED}


@query("retrieve_audit", f"""{_RG}, {_CANDS}, sc AS (SELECT query_id, id, round({_score_sql(tuple(retrieval.WEIGHTS))}, 9) AS score, count(*) OVER (PARTITION BY query_id) AS candidates,
  concat_ws(', ', {", ".join(f"'{c} ' || printf('%.6f', round({_TERM[c]}, 6)::DOUBLE) || ' adds ' || printf('%.6f', {_ADDS[c]}::DOUBLE)" for c in _USED)}) AS explanation,
  list_min([{", ".join(f"{{'a': -({_ADDS[c]})::DOUBLE, 'c': '{c}'}}" for c in _USED)}]).c AS led_by FROM comp)
SELECT query_id, id, score, candidates, explanation, led_by, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM sc QUALIFY rank <= 8""")  # fmt: skip
def retrieve_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.retrieve_audit(A.nodes(spark, sf_dir), A.edges(spark, sf_dir), _queries(spark, sf_dir), A.now()).drop("path", "source")
