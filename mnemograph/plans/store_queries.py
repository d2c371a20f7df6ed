"""Queries on tables, versions, conflicts, evaluation, use of edges and folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import affect, compression, evaluation, gists, graph, ingest, plasticity, retrieval, storage
from ..operators import versions as V
from . import adapters as A
from .catalog import query
from .graph_queries import _HITS, _queries

_N = f"WITH {A.NODES}"
_G = f"WITH {A.NODES}, {A.EDGES}, {A.PAIRS}"


@query("explorer_filter", f"""{_N} SELECT id, concept, memory_type, ring FROM nodes WHERE memory_type IN ('fact', 'concept') AND ring IN (0, 1) AND contains(lower(concept || ' ' || summary), 'group 3')""")
def explorer_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = A.nodes(spark, sf_dir)
    return n.where(F.col("memory_type").isin("fact", "concept") & F.col("ring").isin(0, 1) & F.lower(F.concat_ws(" ", "concept", "summary")).contains("group 3")).select("id", "concept", "memory_type", "ring").orderBy("ring", "concept", "id")


@query("type_histogram", f"{_N} SELECT memory_type, count(*) AS nodes FROM nodes GROUP BY 1")
def type_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.nodes(spark, sf_dir).groupBy("memory_type").agg(F.count(F.lit(1)).alias("nodes"))


@query("ring_sector_histogram", f"{_N} SELECT coalesce(ring, -1) AS ring, coalesce(sector, 'unassigned') AS sector, count(*) AS nodes FROM nodes GROUP BY ALL")
def ring_sector_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.nodes(spark, sf_dir).groupBy(F.coalesce("ring", F.lit(-1)).alias("ring"), F.coalesce("sector", F.lit("unassigned")).alias("sector")).agg(F.count(F.lit(1)).alias("nodes"))


@query("json_path_counts", """SELECT json_extract_string(props, '$.k') AS k, count(*) AS n FROM events GROUP BY 1""")
def json_path_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.table(spark, sf_dir, "events").groupBy(F.get_json_object("props", "$.k").alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query("upsert_latest", """SELECT user_id, event_id, event_type, round(value, 6) AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1""")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = storage.latest(A.table(spark, sf_dir, "events"), ["user_id", "event_type"], [F.col("ts").desc(), F.col("event_id").desc()])
    return e.select("user_id", "event_id", "event_type", F.round("value", 6).alias("value"))


@query("merge_nodes", f"""{_N}, p AS (SELECT a.id, a.raw_text || chr(10) || b.raw_text AS raw_text, greatest(a.importance, b.importance) AS importance, greatest(a.confidence, b.confidence) AS confidence,
  list_sort(list_distinct(['c' || a.num % 10, 'c' || b.num % 10])) AS s FROM nodes a JOIN nodes b ON b.num = a.num + 1 WHERE a.num % 2 = 0)
SELECT id, raw_text, array_to_string(s, ',') AS sources, round(importance, 6) AS importance, round(confidence, 6) AS confidence FROM p""")  # fmt: skip
def merge_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = A.nodes(spark, sf_dir).withColumn("source_ids", F.array(F.concat(F.lit("c"), F.col("num") % 10)))
    later = n.where("num % 2 = 1").withColumn("id", F.concat(F.lit("v"), F.lpad((F.col("num") - 1).cast("string"), 8, "0")))
    m = storage.merge_nodes(n.where("num % 2 = 0").join(later.select("id"), "id", "left_semi"), later)
    return m.select("id", "raw_text", F.array_join("source_ids", ",").alias("sources"), F.round("importance", 6).alias("importance"), F.round("confidence", 6).alias("confidence"))


@query("apply_actions", f"""{_N}, a AS (SELECT *, CASE num % 4 WHEN 0 THEN 'invalidate' WHEN 1 THEN 'archive' WHEN 2 THEN 'delete' END AS action FROM nodes)
SELECT id, CASE action WHEN 'archive' THEN 'archived' WHEN 'delete' THEN 'deleted' ELSE 'active' END AS status, coalesce(action = 'invalidate', false) AS ended, round(CASE WHEN action = 'invalidate' THEN least(confidence, 0.2) ELSE confidence END, 6)::DOUBLE AS confidence FROM a""")  # fmt: skip
def apply_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = A.nodes(spark, sf_dir).withColumns({"valid_until": F.lit(None).cast("timestamp"), "status": F.lit("active")})
    act = F.when(F.col("num") % 4 == 0, "invalidate").when(F.col("num") % 4 == 1, "archive").when(F.col("num") % 4 == 2, "delete")
    done = storage.apply_action(n, n.select("id", act.alias("action")), A.now())
    return done.select("id", "status", F.col("valid_until").isNotNull().alias("ended"), F.round("confidence", 6).alias("confidence"))


def _corpus(spark, sf_dir):
    d = A.documents(spark, sf_dir).select(F.col("doc_id").alias("document_id"), F.concat_ws(" ", "source", F.col("doc_id").cast("string")).alias("title"), "text")
    c = d.select("document_id", F.posexplode(F.split("text", "\n")).alias("seq", "text")).where(F.length("text") > 0).withColumn("chunk_id", F.concat_ws("#", F.col("document_id").cast("string"), F.col("seq").cast("string")))
    n = c.where("seq % 2 = 0").select(F.concat(F.lit("n"), F.col("chunk_id")).alias("id"), "document_id", F.array("chunk_id").alias("source_ids"), "text")
    e = n.select(F.col("id").alias("source_id"), F.lead("id").over(Window.partitionBy("document_id").orderBy("id")).alias("target_id")).where("target_id is not null")
    return d.select("document_id", "title"), c.select("chunk_id", "document_id", "seq", "text"), n, e


_CORPUS = """d AS (SELECT doc_id AS document_id, concat_ws(' ', source, doc_id) AS title, text FROM documents),
c0 AS (SELECT document_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS seq FROM d),
c AS (SELECT *, document_id || '#' || seq AS chunk_id FROM c0 WHERE length(text) > 0), n AS (SELECT 'n' || chunk_id AS id, document_id, chunk_id, text FROM c WHERE seq % 2 = 0),
e AS (SELECT id AS source_id, lead(id) OVER (PARTITION BY document_id ORDER BY id) AS target_id, document_id FROM n QUALIFY target_id IS NOT NULL)"""


@query("provenance_join", f"WITH {_CORPUS} SELECT id, chunk_id, document_id, title, substr(n.text, 1, 200) AS preview FROM n JOIN d USING (document_id)")
def provenance_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, c, n, _ = _corpus(spark, sf_dir)
    return storage.provenance(n, c, d)


@query("cascade_delete", f"""WITH {_CORPUS} SELECT 'documents' AS part, count(*) AS n FROM d WHERE document_id % 3 > 0 UNION ALL SELECT 'chunks', count(*) FROM c WHERE document_id % 3 > 0
UNION ALL SELECT 'nodes', count(*) FROM n WHERE document_id % 3 > 0 UNION ALL SELECT 'edges', count(*) FROM e WHERE document_id % 3 > 0""")  # fmt: skip
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, c, n, e = _corpus(spark, sf_dir)
    left = storage.cascade(d, c, n, e, d.where("document_id % 3 = 0").select("document_id"))
    out = None
    for name, t in left.items():
        row = t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n")
        out = row if out is None else out.unionByName(row)
    return out


@query("missing_vectors", f"{_N} SELECT o.id FROM (SELECT 'v' || lpad(c_custkey::VARCHAR, 8, '0') AS id FROM customer) o ANTI JOIN nodes USING (id)")
def missing_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    want = A.table(spark, sf_dir, "customer").select(F.concat(F.lit("v"), F.lpad(F.col("c_custkey").cast("string"), 8, "0")).alias("id"))
    return want.join(A.nodes(spark, sf_dir).select("id"), "id", "left_anti")


@query("log_telemetry", """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i, count(*) OVER (PARTITION BY event_type) AS c FROM events)
SELECT event_type, count(*) AS n, round(max(value) FILTER (i = c // 2 + 1), 6) AS upper_median, round(avg(value), 6) AS mean FROM r GROUP BY 1""")  # fmt: skip
def log_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = storage.telemetry(A.table(spark, sf_dir, "events"), ["event_type"], "value")
    return t.select("event_type", "n", F.round("upper_median", 6).alias("upper_median"), F.round("mean", 6).alias("mean"))


@query("replay_window", f"SELECT event_id, user_id FROM events WHERE ts >= TIMESTAMP '{A.NOW}' - INTERVAL 7 DAY ORDER BY ts DESC, event_id DESC LIMIT 5000")
def replay_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = A.table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("id"), "user_id")
    return storage.replay_window(log, A.now(), 7).select(F.col("id").alias("event_id"), "user_id")


@query("replay_seeds", """SELECT user_id, count(*) AS uses, min(event_id) AS first_event FROM events GROUP BY 1 ORDER BY uses DESC, first_event LIMIT 40""")
def replay_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("uses"), F.min("event_id").alias("first_event")).orderBy(F.col("uses").desc(), "first_event").limit(40)


@query("sequential_pairs", """WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events)
SELECT a.user_id, a.i // 2 AS pair, a.event_id AS first, b.event_id AS second FROM r a JOIN r b ON a.user_id = b.user_id AND b.i = a.i + 1 WHERE a.i % 2 = 0""")  # fmt: skip
def sequential_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return storage.consecutive_pairs(A.table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_id")


_CHAIN = """v AS (SELECT 'Conversation ' || conv_id AS subject, turn AS seq, text AS content, role AS source FROM conversations),
k AS (SELECT *, substr(sha256(lower(trim(subject))), 1, 16) AS chain_key, lag(content) OVER (PARTITION BY subject ORDER BY seq) AS before FROM v),
o AS (SELECT *, row_number() OVER (PARTITION BY chain_key ORDER BY seq) AS ordinal FROM k WHERE content IS DISTINCT FROM before),
h AS (SELECT *, substr(sha256(chain_key || '|' || ordinal || '|' || content), 1, 16) AS hash FROM o),
s AS (SELECT *, lag(hash) OVER (PARTITION BY chain_key ORDER BY seq) AS supersedes, row_number() OVER (PARTITION BY chain_key ORDER BY seq DESC) AS back FROM h),
chain AS (SELECT *, row_number() OVER (PARTITION BY chain_key ORDER BY seq) AS n FROM s WHERE back <= 3)"""


@query("version_chain", f"WITH {_CHAIN} SELECT subject, chain_key, n, seq, hash, supersedes FROM chain")
def version_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.chain(A.versions(spark, sf_dir), 3).select("subject", "chain_key", "n", "seq", "hash", "supersedes")


@query("version_head", f"WITH {_CHAIN} SELECT subject, n, content, hash FROM chain QUALIFY row_number() OVER (PARTITION BY subject ORDER BY n DESC) = 1")
def version_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.heads(V.chain(A.versions(spark, sf_dir), 3))


@query("version_rollback", f"WITH {_CHAIN} SELECT subject, content, 'rollback:' || hash AS source FROM chain WHERE n = 1")
def version_rollback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.rollback(V.chain(A.versions(spark, sf_dir), 3), 1)


_FACTS = """f AS (SELECT id, regexp_extract(raw_text, '^(.+?) is (.+)$', 1) AS subject, regexp_extract(raw_text, '^(.+?) is (.+)$', 2) AS value, confidence, updated_at FROM nodes WHERE memory_type IN ('fact', 'event')),
x AS (SELECT a.subject, a.id AS a, b.id AS b, a.value AS a_value, b.value AS b_value FROM f a JOIN f b ON a.subject = b.subject AND a.id < b.id AND a.value <> b.value)"""


@query("proposition_conflicts", f"{_N}, {_FACTS} SELECT * FROM x")
def proposition_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.conflicting_pairs(A.nodes(spark, sf_dir))


@query("conflict_resolution", f"""{_N}, {_FACTS}, s AS (SELECT subject, a AS id FROM x UNION SELECT subject, b FROM x),
r AS (SELECT s.subject, s.id, round(0.3::DOUBLE + 0.125::DOUBLE + 0.2::DOUBLE * confidence + 0.15::DOUBLE * greatest(0, 1 - date_diff('second', updated_at, TIMESTAMP '{A.NOW}') / (86400.0 * 30)) + 0.1::DOUBLE * 0.5, 6)::DOUBLE AS score FROM s JOIN f USING (id))
SELECT subject, id, score, row_number() OVER (PARTITION BY subject ORDER BY score DESC, id) AS rank FROM r""")  # fmt: skip
def conflict_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.resolve(A.nodes(spark, sf_dir), A.now())


@query("hebbian_reinforce", f"""{_G}, u AS (SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM (SELECT 'v' || lpad((user_id % {A.USERS})::VARCHAR, 8, '0') AS a,
    'v' || lpad((lead(user_id) OVER (PARTITION BY event_type ORDER BY ts, event_id) % {A.USERS})::VARCHAR, 8, '0') AS b FROM events) WHERE a <> b),
m AS (SELECT p.*, u.a IS NOT NULL AS touched FROM pairs p LEFT JOIN u USING (a, b)), n AS (SELECT count(*) FILTER (touched) AS n FROM m)
SELECT a, b, round(weight, 6) AS weight, round(CASE WHEN touched THEN least(2, greatest(0.05, weight + 0.1::DOUBLE * (1 + 0.5::DOUBLE * confidence))) WHEN n > 0 THEN least(2, greatest(0.05, weight * (1 - 0.02::DOUBLE / sqrt(n)))) ELSE weight END, 4)::DOUBLE AS new_weight, touched FROM m, n""")  # fmt: skip
def hebbian_reinforce(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = lambda c: F.concat(F.lit("v"), F.lpad((c % A.USERS).cast("string"), 8, "0"))
    e = A.table(spark, sf_dir, "events").select(key(F.col("user_id")).alias("x"), key(F.lead("user_id").over(Window.partitionBy("event_type").orderBy("ts", "event_id"))).alias("y"))
    out = plasticity.reinforce(graph.pairs(A.edges(spark, sf_dir)), e.where("y is not null").select(F.array("x", "y").alias("path")))
    return out.select("a", "b", F.round("weight", 6).alias("weight"), F.round("new_weight", 4).alias("new_weight"), "touched")


@query("stdp_update", f"""{_G}, sp AS (SELECT 'v' || lpad((user_id % {A.USERS})::VARCHAR, 8, '0') AS id, date_diff('minute', TIMESTAMP '2024-01-01', ts) // 240 AS tick, event_id AS seq FROM events WHERE event_type = 'click'),
up AS (SELECT source_id, target_id, min((x.tick, x.seq, y.tick, y.seq)) AS k FROM (SELECT DISTINCT source_id, target_id FROM edges) JOIN sp x ON x.id = source_id JOIN sp y ON y.id = target_id WHERE y.tick BETWEEN x.tick AND x.tick + 1 AND (y.tick > x.tick OR y.seq > x.seq) GROUP BY ALL),
dn AS (SELECT source_id, target_id, min((x.tick, x.seq, y.tick, y.seq)) AS k FROM (SELECT DISTINCT source_id, target_id FROM edges) JOIN sp x ON x.id = target_id JOIN sp y ON y.id = source_id WHERE y.tick BETWEEN x.tick AND x.tick + 1 AND (y.tick > x.tick OR y.seq > x.seq) GROUP BY ALL)
SELECT source_id, target_id, relation_type, round(CASE WHEN up.k IS NOT NULL AND (dn.k IS NULL OR (up.k[1], up.k[2]) <= (dn.k[1], dn.k[2])) THEN least(2, greatest(0.05, weight + 0.06::DOUBLE * (1 + 0.5::DOUBLE * confidence)))
  WHEN dn.k IS NOT NULL THEN least(2, greatest(0.05, weight - 0.04::DOUBLE * (1 + 0.5::DOUBLE * confidence))) ELSE least(2, greatest(0.05, weight)) END, 4)::DOUBLE AS new_weight,
  CASE WHEN up.k IS NOT NULL AND (dn.k IS NULL OR (up.k[1], up.k[2]) <= (dn.k[1], dn.k[2])) THEN 'ltp' WHEN dn.k IS NOT NULL THEN 'ltd' ELSE 'none' END AS change
FROM edges LEFT JOIN up USING (source_id, target_id) LEFT JOIN dn USING (source_id, target_id)""")  # fmt: skip
def stdp_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    minutes = F.floor((F.unix_seconds(F.col("ts").cast("timestamp")) - F.unix_seconds(F.lit("2024-01-01 00:00:00").cast("timestamp"))) / 60)
    e = A.table(spark, sf_dir, "events").where("event_type = 'click'")
    spikes = e.select(F.concat(F.lit("v"), F.lpad((F.col("user_id") % A.USERS).cast("string"), 8, "0")).alias("id"), F.floor(minutes / 240).alias("tick"), F.col("event_id").alias("seq"))
    edges = A.edges(spark, sf_dir)
    one = edges.groupBy("source_id", "target_id").agg(F.first("weight").alias("weight"), F.first("confidence").alias("confidence"))
    change = plasticity.spike_timing(one, spikes).select("source_id", "target_id", "change")
    kinds = edges.join(change, ["source_id", "target_id"])
    trust = 1 + 0.5 * F.col("confidence")
    new = F.when(F.col("change") == "ltp", F.col("weight") + 0.06 * trust).when(F.col("change") == "ltd", F.col("weight") - 0.04 * trust).otherwise(F.col("weight"))
    return kinds.select("source_id", "target_id", "relation_type", plasticity.bounded(new).alias("new_weight"), "change")


@query("recall_mrr_eval", f"""{_N}, {_HITS}, g AS (SELECT q.vec_id AS query_id, n.id FROM embeddings q JOIN nodes n ON n.label = q.label WHERE q.vec_id % {A.EVERY} = 0), w AS (SELECT query_id, count(*) AS w FROM g GROUP BY 1),
h AS (SELECT hits.query_id, count(g.id) AS hits, min(rank) FILTER (g.id IS NOT NULL) AS first FROM hits LEFT JOIN g USING (query_id, id) WHERE rank <= 8 GROUP BY 1)
SELECT query_id, round(hits / w, 6) AS recall, round(hits / 8, 6) AS precision, round(coalesce(1 / first, 0), 6) AS mrr FROM h JOIN w USING (query_id)""")  # fmt: skip
def recall_mrr_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, q = A.nodes(spark, sf_dir), A.vector_queries(spark, sf_dir)
    gold = q.select("query_id", F.col("query_label").alias("label")).join(n.select("id", "label"), "label").select("query_id", "id")
    m = evaluation.ranking_metrics(retrieval.vector_topk(n, q, 8), gold)
    return m.select("query_id", *[F.round(c, 6).alias(c) for c in ("recall", "precision", "mrr")])


@query("metric_means", """SELECT event_type, count(*) AS n, round(avg(value), 4) AS value, count(value) AS n_scored_value FROM events GROUP BY 1""")
def metric_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.means(A.table(spark, sf_dir, "events"), ["value"], ["event_type"])


_LAB = "lab AS (SELECT event_type AS task, date_diff('day', TIMESTAMP '2024-01-01', ts) // 5 AS step, round(avg(value), 6) AS value FROM events GROUP BY ALL), b AS (SELECT *, max(value) OVER (PARTITION BY task ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best_previous FROM lab), c AS (SELECT *, coalesce(greatest(0, best_previous - value), 0) AS forgetting, CASE WHEN coalesce(best_previous, 0) = 0 THEN 1 ELSE value / best_previous END AS retention FROM b)"


def _lab(spark, sf_dir):
    days = F.floor((F.unix_seconds(F.col("ts").cast("timestamp")) - F.unix_seconds(F.lit("2024-01-01 00:00:00").cast("timestamp"))) / 86_400)
    return A.table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("task"), F.floor(days / 5).alias("step")).agg(F.round(F.avg("value"), 6).alias("value"))


@query("forgetting_curve", f"WITH {_LAB} SELECT task, step, value, best_previous, round(forgetting, 6) AS forgetting, round(retention, 6) AS retention FROM c")
def forgetting_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = evaluation.forgetting(_lab(spark, sf_dir))
    return c.select("task", "step", "value", "best_previous", F.round("forgetting", 6).alias("forgetting"), F.round("retention", 6).alias("retention"))


@query("forgetting_final", f"WITH {_LAB} SELECT round(avg(forgetting), 6) AS average_forgetting, round(avg(retention), 6) AS mean_retention FROM (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY task ORDER BY step DESC) = 1)")
def forgetting_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.final_forgetting(evaluation.forgetting(_lab(spark, sf_dir)))


@query("step_summary", f"WITH {_LAB} SELECT step, count(*) AS n, round(avg(value), 4) AS value, count(value) AS n_scored_value FROM lab GROUP BY 1")
def step_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.means(_lab(spark, sf_dir), ["value"], ["step"])


def _diffs(spark, sf_dir):
    e = A.table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.round(F.avg("value"), 4).alias("v"))
    base = e.where("event_type = 'view'").select(F.col("user_id").alias("query_id"), F.col("v").alias("y"))
    other = e.where("event_type <> 'view'").select(F.col("user_id").alias("query_id"), F.col("event_type").alias("system"), F.col("v").alias("x"))
    return other.join(base, "query_id").select("system", "query_id", F.round(F.col("x") - F.col("y"), 3).alias("diff"))


@query("paired_differences", """WITH e AS (SELECT user_id, event_type, round(avg(value), 4) AS v FROM events GROUP BY ALL)
SELECT a.event_type AS system, a.user_id AS query_id, round(a.v - b.v, 3) AS diff FROM e a JOIN e b USING (user_id) WHERE a.event_type <> 'view' AND b.event_type = 'view'""")  # fmt: skip
def paired_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _diffs(spark, sf_dir)


_DIFFS = """e AS (SELECT user_id, event_type, round(avg(value), 4) AS v FROM events GROUP BY ALL),
d AS (SELECT a.event_type AS system, a.user_id AS query_id, round(a.v - b.v, 3) AS diff FROM e a JOIN e b USING (user_id) WHERE a.event_type <> 'view' AND b.event_type = 'view')"""


@query("paired_bootstrap", f"""WITH {_DIFFS}, p AS (SELECT system, diff, row_number() OVER (PARTITION BY system ORDER BY query_id) - 1 AS place FROM d),
s AS (SELECT system, count(*) AS n, avg(diff) AS mean FROM d GROUP BY 1),
draws AS (SELECT p.system, r.round, ('0x' || substr(md5('42:' || r.round || ':' || p.place), 1, 8))::BIGINT % n AS place FROM p JOIN s USING (system), range(10000) AS r(round)),
m AS (SELECT system, round, round(avg(diff), 9) AS m FROM draws JOIN p USING (system, place) GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY system ORDER BY m) AS i FROM m)
SELECT system, any_value(n) AS n_pairs, round(any_value(mean), 5) AS mean_diff, round(max(m) FILTER (i = 251), 5) AS ci_low, round(max(m) FILTER (i = 9750), 5) AS ci_high,
  greatest(2 * count(*) FILTER ((mean >= 0) = (m < 0)) / 10000, 0.0001)::DOUBLE AS p_value FROM k JOIN s USING (system) GROUP BY system""")  # fmt: skip
def paired_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.paired_bootstrap(_diffs(spark, sf_dir), ["system"])


@query("wilcoxon_signed_rank", f"""WITH {_DIFFS}, r AS (SELECT *, rank() OVER (PARTITION BY system ORDER BY abs(diff)) + (count(*) OVER (PARTITION BY system, abs(diff)) - 1) / 2 AS r, count(*) OVER (PARTITION BY system, abs(diff)) AS t FROM d WHERE diff <> 0),
s AS (SELECT system, count(*) AS n, least(coalesce(sum(r) FILTER (diff > 0), 0), coalesce(sum(r) FILTER (diff < 0), 0))::DOUBLE AS w, sum(t * t - 1)::DOUBLE AS tied FROM r GROUP BY 1),
z AS (SELECT *, abs((w - n * (n + 1) / 4.0::DOUBLE) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0::DOUBLE - tied / 48)) AS z FROM s), u AS (SELECT *, 1 / (1 + 0.2316419::DOUBLE * z) AS u FROM z)
SELECT system, n AS n_pairs, w AS statistic, CASE WHEN n < 6 THEN 1.0 ELSE round(2 * exp(-z * z / 2) / sqrt(2 * pi()) * (0.319381530::DOUBLE * u - 0.356563782::DOUBLE * pow(u, 2) + 1.781477937::DOUBLE * pow(u, 3) - 1.821255978::DOUBLE * pow(u, 4) + 1.330274429::DOUBLE * pow(u, 5)), 6) END AS p_value FROM u""")  # fmt: skip
def wilcoxon_signed_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.wilcoxon(_diffs(spark, sf_dir), ["system"])


@query("jaccard_matrix", """WITH u AS (SELECT event_type AS system, user_id % 10 AS query_id, list(DISTINCT user_id) AS ids FROM events GROUP BY ALL)
SELECT a.system AS a, b.system AS b, round(avg(len(list_intersect(a.ids, b.ids)) / len(list_distinct(list_concat(a.ids, b.ids)))), 6) AS jaccard FROM u a JOIN u b USING (query_id) GROUP BY ALL""")  # fmt: skip
def jaccard_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = A.table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("system"), (F.col("user_id") % 10).alias("query_id")).agg(F.collect_set("user_id").alias("ids"))
    return evaluation.jaccard_matrix(runs)


@query("compress_context")
def compress_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import lexical

    docs = A.documents(spark, sf_dir).select("doc_id", "text", "source")
    ranked = lexical.bm25(docs, "doc_id", A.text_queries(spark, sf_dir), 8).join(docs, "doc_id").join(A.text_queries(spark, sf_dir), "query_id")
    ready = ranked.select("query_id", "query", "rank", F.col("doc_id").alias("id"), "text", F.lit(1).alias("ring"), F.col("source").alias("sector"))
    packed = compression.compress(ready, 256)
    return packed.select("query_id", "n_tokens", "n_raw_tokens", F.size("ids").alias("n_items"), T.stable_hash(F.col("context")).alias("hash"))


@query("affect_fold")
def affect_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "purchase", "memory").when(F.col("event_type") == "click", "web").when(F.col("event_type") == "error", "no_evidence").when(F.col("event_type") == "signup", "identity").otherwise("parametric")
    e = A.table(spark, sf_dir, "events").select("user_id", "event_id", F.col("ts").alias("at"), kind.alias("kind"))
    return affect.fold(e, "user_id")


@query("gist_clusters")
def gist_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gists.build(A.nodes(spark, sf_dir))


@query("mention_edges")
def mention_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = ingest.chunk(A.documents(spark, sf_dir).select("doc_id", "text"), "doc_id")
    return ingest.mention_edges(ingest.concept_nodes(chunks, "doc_id"), chunks, "doc_id")


@query("agent_route")
def agent_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = retrieval.evidence(A.nodes(spark, sf_dir), A.edges(spark, sf_dir), _queries(spark, sf_dir), A.now())
    return compression.route(e.select("query_id", (F.col("n") * 4).alias("n_tokens")), e.select("query_id", "semantic"))
