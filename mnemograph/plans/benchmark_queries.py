"""Queries that compare rankers, and those on samples, splits and supersession."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import benchmarks, evaluation, graph, plasticity, retrieval
from ..operators import versions as V
from ..operators.durable import cut
from . import adapters as A
from .catalog import query
from .dynamics_queries import _MEMBERS
from .experiment_queries import _gold
from .graph_queries import _CANDS, _EACH, _HITS, _RG, _TERM, _components, _queries, _sym
from .store_queries import _FACTS

_WITH = f"WITH {A.NODES}"
_ON = retrieval.WEIGHTS | {"constellation": benchmarks.CONSTELLATION}
_GOLD = f"g AS (SELECT q.vec_id AS query_id, n.id FROM embeddings q JOIN nodes n ON n.label = q.label WHERE q.vec_id % {A.EVERY} = 0), w AS (SELECT query_id, count(*) AS w FROM g GROUP BY 1)"
_METRICS = """per AS (SELECT r.system, r.query_id, count(g.id) AS hits, min(rank) FILTER (g.id IS NOT NULL) AS first FROM runs r LEFT JOIN g USING (query_id, id) WHERE rank <= 8 GROUP BY ALL),
m AS (SELECT system, query_id, hits / w AS recall, hits / 8 AS precision, coalesce(1 / first, 0) AS mrr FROM per JOIN w USING (query_id))"""
_TABLE = "SELECT system, count(*) AS n, round(avg(recall), 4) AS recall, round(avg(precision), 4) AS precision, round(avg(mrr), 4) AS mrr, count(recall) AS n_scored_recall, count(precision) AS n_scored_precision, count(mrr) AS n_scored_mrr FROM m GROUP BY 1"


def _score(weights: dict[str, float]) -> str:
    terms = " + ".join(f"{x}::DOUBLE * {_TERM[c]}" for c, x in sorted(weights.items()) if x > 0)
    return f"round(({terms}) / {sum(weights.values())}::DOUBLE, 9)"


_MEM = """bm{k} AS (SELECT * FROM sm WHERE s > 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY s DESC, cid) <= {k}), mem{k} AS (SELECT id, num, cid, s / sum(s) OVER (PARTITION BY id) AS w FROM bm{k})"""
_KERNEL = f"""SELECT q.num AS query_id, m.id, {{f}} AS kernel FROM mem{{k}} q JOIN mem{{k}} m USING (cid) WHERE q.num % {A.EVERY} = 0 GROUP BY ALL"""
_FORM = {False: "sum(q.w * m.w)", True: "pow(sum(sqrt(q.w * m.w)), 2)"}


def _arm_sql(name: str, arm: tuple[int, bool] | None) -> str:
    if arm is None:
        return f"SELECT '{name}' AS system, query_id, id, {_score(retrieval.WEIGHTS)} AS score FROM comp"
    kernel = _KERNEL.format(k=arm[0], f=_FORM[arm[1]])
    return f"SELECT '{name}' AS system, query_id, id, {_score(_ON)} AS score FROM (SELECT comp.*, coalesce(kernel, 0) AS constellation FROM comp LEFT JOIN ({kernel}) USING (query_id, id))"


def _runs_sql(arms: dict) -> str:
    mems = ", ".join(_MEM.format(k=k) for k in sorted({arm[0] for arm in arms.values() if arm}))
    each = " UNION ALL ".join(_arm_sql(n, a) for n, a in arms.items())
    return f"{_RG}, {_CANDS}, {_MEMBERS}, {mems}, sc AS ({each}), runs AS (SELECT *, row_number() OVER (PARTITION BY system, query_id ORDER BY score DESC, id) AS rank FROM sc QUALIFY rank <= 8)"


def _arms(spark, sf_dir, arms):
    n, e, q = A.nodes(spark, sf_dir), A.edges(spark, sf_dir), _queries(spark, sf_dir)
    return benchmarks.constellation_runs(n, e, q, A.now(), arms, "label")


_ONE = {"linear": (3, False)}
_PILOT = {"off": None, "linear": (3, False), "born": (3, True)}
_SWEEP = {"off": None, "k1": (1, False), "k2": (2, False), "k3": (3, False)}


@query("retrieve_constellation", f"{_runs_sql(_ONE)} SELECT query_id, id, score, rank FROM runs")
def retrieve_constellation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _arms(spark, sf_dir, _ONE).drop("system")


@query("constellation_pilot", f"{_runs_sql(_PILOT)}, {_GOLD}, {_METRICS} {_TABLE}")
def constellation_pilot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmarks.compare(_arms(spark, sf_dir, _PILOT), _gold(spark, sf_dir))


@query("constellation_sweep", f"{_runs_sql(_SWEEP)}, {_GOLD}, {_METRICS} {_TABLE}")
def constellation_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmarks.compare(_arms(spark, sf_dir, _SWEEP), _gold(spark, sf_dir))


@query("systems_table", f"""{_RG}, {_CANDS}, sc AS ({_EACH}), gh AS (SELECT * FROM hits WHERE rank <= 8), gd AS (SELECT src AS id, count(*) AS degree FROM sym GROUP BY 1),
gn AS (SELECT DISTINCT query_id, dst AS id FROM gh JOIN sym ON src = gh.id WHERE rank <= 3),
gu AS (SELECT query_id, id, score FROM gh UNION ALL SELECT gn.query_id, gn.id, 0.5 * least(1.0, degree / 5.0) FROM gn JOIN gd USING (id) ANTI JOIN gh ON gh.query_id = gn.query_id AND gh.id = gn.id),
runs AS (SELECT system, query_id, id, row_number() OVER (PARTITION BY system, query_id ORDER BY score DESC, id) AS rank FROM sc
  UNION ALL SELECT 'flat_vector', query_id, id, rank FROM hits UNION ALL SELECT 'graph_rag', query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) FROM gu),
{_GOLD}, {_METRICS} {_TABLE}""")  # fmt: skip
def systems_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = benchmarks.run_systems(A.nodes(spark, sf_dir), A.edges(spark, sf_dir), _queries(spark, sf_dir), A.now())
    return benchmarks.compare(runs, _gold(spark, sf_dir))


_WORDS = "regexp_extract_all(lower({}), '[a-z0-9]+')"


@query("answer_quality", f"""WITH c AS (SELECT conv_id, turn, text, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations),
a AS (SELECT conv_id, {_WORDS.format("list_extract(string_split(text, '.'), 1)")} AS g FROM c WHERE turn = last), p AS (SELECT conv_id, {_WORDS.format('text')} AS h FROM c WHERE turn < last),
x AS (SELECT conv_id, g, coalesce(h, []) AS h FROM a LEFT JOIN p USING (conv_id))
SELECT conv_id AS query_id, round(max(CASE WHEN len(g) > 0 THEN len(list_intersect(g, h)) / len(list_distinct(g)) ELSE 0 END), 6)::DOUBLE AS coverage,
  max(CASE WHEN len(g) > 0 AND contains(' ' || array_to_string(h, ' ') || ' ', ' ' || array_to_string(g, ' ') || ' ') THEN 1 ELSE 0 END) AS found FROM x GROUP BY 1""")  # fmt: skip
def answer_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first sentence of each conversation's last turn is the answer; the turns before it are the passages."""
    c = A.table(spark, sf_dir, "conversations")
    last = c.groupBy("conv_id").agg(F.max("turn").alias("last"))
    c = c.join(last, "conv_id").withColumnRenamed("conv_id", "query_id")
    answers = c.where("turn = last").select("query_id", F.element_at(F.split("text", r"\."), 1).alias("answer"))
    return benchmarks.answer_quality(c.where("turn < last").select("query_id", "text"), answers)


@query("seeded_sample", "SELECT item_id, text FROM benchmark ORDER BY md5('7:' || item_id), item_id LIMIT 25")
def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmarks.sample(A.table(spark, sf_dir, "benchmark").select("item_id", "text"), "item_id", 25, 7)


@query("grouped_split", """WITH g AS (SELECT source, row_number() OVER (ORDER BY md5('42:' || source), source) AS i, count(*) OVER () AS n FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL))
SELECT doc_id, d.source, CASE WHEN i <= greatest(2, floor(n * 0.25)) THEN 'holdout' ELSE 'train' END AS side FROM documents d JOIN g USING (source)""")  # fmt: skip
def grouped_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmarks.grouped_split(A.table(spark, sf_dir, "documents").select("doc_id", "source"), "source")


_FEATURES = ("semantic", "structural", "radial", "graph", "importance", "confidence", "recency", "path_score", "activation")


@query("training_pairs", f"""{_RG}, {_CANDS}, own AS (SELECT num AS query_id, id FROM nodes WHERE num % {A.EVERY} = 0), pos AS (SELECT * FROM own UNION SELECT query_id, dst FROM own JOIN sym ON src = id)
SELECT comp.query_id, comp.id, {", ".join(f"round({c}, 6)::DOUBLE AS {c}" for c in _FEATURES)}, (pos.id IS NOT NULL)::INT AS label FROM comp LEFT JOIN pos USING (query_id, id)""")  # fmt: skip
def training_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = A.nodes(spark, sf_dir).where(F.col("num") % A.EVERY == 0).select(F.col("num").alias("query_id"), "id")
    got = benchmarks.training_pairs(_components(spark, sf_dir), own, _sym(spark, sf_dir))
    return got.select("query_id", "id", *[F.round(c, 6).alias(c) for c in _FEATURES], "label")


_COHORT = "CASE WHEN access_count >= 30 THEN 'replayed' WHEN updated_at < TIMESTAMP '2024-01-10 00:00:00' THEN 'faded' ELSE 'recent' END"


@query("cohort_means", f"""{_WITH}, {_HITS}, runs AS (SELECT 'flat' AS system, * FROM hits), {_GOLD}, {_METRICS}, c AS (SELECT num AS query_id, {_COHORT} AS cohort FROM nodes)
SELECT cohort, count(*) AS n, round(avg(recall), 4) AS recall, round(avg(mrr), 4) AS mrr FROM m JOIN c USING (query_id) GROUP BY 1""")  # fmt: skip
def cohort_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = A.nodes(spark, sf_dir)
    rows = evaluation.ranking_metrics(retrieval.vector_topk(n, A.vector_queries(spark, sf_dir), 8), _gold(spark, sf_dir))
    kind = F.when(F.col("access_count") >= 30, "replayed").when(F.col("updated_at") < F.lit("2024-01-10 00:00:00").cast("timestamp"), "faded").otherwise("recent")
    return benchmarks.cohort_means(rows, n.select(F.col("num").alias("query_id"), kind.alias("cohort")), ["recall", "mrr"])


@query("supersede_conflicts", f"""{_WITH}, {_FACTS}, s AS (SELECT subject, a AS id FROM x UNION SELECT subject, b FROM x),
r AS (SELECT s.subject, s.id, round(0.3::DOUBLE + 0.125::DOUBLE + 0.2::DOUBLE * confidence + 0.15::DOUBLE * greatest(0, 1 - date_diff('second', updated_at, TIMESTAMP '{A.NOW}') / (86400.0 * 30)) + 0.1::DOUBLE * 0.5, 6)::DOUBLE AS score FROM s JOIN f USING (id)),
o AS (SELECT *, first_value(id) OVER (PARTITION BY subject ORDER BY score DESC, id) AS best FROM r)
SELECT id, best AS superseded_by, 2 AS memory_version, 'consolidated' AS state, 1.0::DOUBLE AS stability, 'superseded_by:' || best AS reason FROM o WHERE id <> best""")  # fmt: skip
def supersede_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weaker sides of each conflict become history of the strongest one."""
    n = A.nodes(spark, sf_dir)
    ranked = cut(V.resolve(n, A.now()))
    best = ranked.where("rank = 1").select("subject", F.col("id").alias("by"))
    return benchmarks.supersede(n, ranked.join(best, "subject").select("id", "by"), A.now()).drop("updated_at")


@query("edge_weight_update", f"""{_WITH}, {A.EDGES}, {A.PAIRS}, u AS (SELECT a, b, round(weight / 2, 6) AS weight FROM pairs WHERE confidence >= 0.7)
SELECT e.source_id, e.target_id, e.relation_type, round(coalesce(u.weight, e.weight), 6) AS weight FROM edges e LEFT JOIN u ON u.a = least(e.source_id, e.target_id) AND u.b = greatest(e.source_id, e.target_id)""")  # fmt: skip
def edge_weight_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = A.edges(spark, sf_dir)
    new = graph.pairs(e).where("confidence >= 0.7").select("a", "b", F.round(F.col("weight") / 2, 6).alias("weight"))
    return plasticity.set_weights(e, new).select("source_id", "target_id", "relation_type", F.round("weight", 6).alias("weight"))


@query("map_nodes", f"{_WITH} SELECT id, concept, memory_type AS type, ring, sector, radial_distance AS radial, round(importance, 3) AS importance, round(confidence, 3) AS confidence, substr(summary, 1, 200) AS summary FROM nodes")
def map_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.nodes(spark, sf_dir).select("id", "concept", F.col("memory_type").alias("type"), "ring", "sector", F.col("radial_distance").alias("radial"), F.round("importance", 3).alias("importance"), F.round("confidence", 3).alias("confidence"), F.substring("summary", 1, 200).alias("summary"))


@query("map_edges", f"{_WITH}, {A.EDGES} SELECT source_id AS s, target_id AS t, relation_type AS r, round(weight, 6) AS w FROM edges")
def map_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.edges(spark, sf_dir).select(F.col("source_id").alias("s"), F.col("target_id").alias("t"), F.col("relation_type").alias("r"), F.round("weight", 6).alias("w"))
