"""Queries over texts: cleaning, tokens, extraction, lexical ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import ingest, lexical, versions
from . import adapters as A
from .catalog import query

#: The same in DuckDB: a list of sentences, a list of words.
_SENTENCES = r"""list_filter(list_transform(string_split(regexp_replace(trim(text), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '')"""
_STOPS = ",".join(f"'{w}'" for w in T.STOP_WORDS)


@query("sanitize_text", r"""
SELECT doc_id, md5(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g')) AS clean FROM documents""")  # fmt: skip
def sanitize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.documents(spark, sf_dir).select("doc_id", F.md5(T.sanitize(F.col("text"))).alias("clean"))


@query("markdown_text", r"""
SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '```[\w-]*\n?', '', 'g'), '\[([^\]]+)\]\([^)]+\)', '\1', 'g'), '[#*_>`]{1,3}', '', 'g')) AS plain FROM documents""")  # fmt: skip
def markdown_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.documents(spark, sf_dir).select("doc_id", F.md5(T.strip_markdown(F.col("text"))).alias("plain"))


@query("html_to_text", r"""
SELECT page_id, url, substr(trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(
  regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'),
  '&copy;', '©'), '&middot;', '·'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g')), 1, 100000) AS body FROM pages""")  # fmt: skip
def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.table(spark, sf_dir, "pages").select("page_id", "url", T.html_text(F.col("html")).alias("body"))


@query("sentence_split_lead2", rf"""
WITH s AS (SELECT doc_id, text, {_SENTENCES} AS s FROM documents)
SELECT doc_id, len(s) AS n_sentences, CASE WHEN len(s) > 0 THEN array_to_string(s[1:2], ' ') ELSE substr(text, 1, 200) END AS lead FROM s""")  # fmt: skip
def sentence_split_lead2(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return A.documents(spark, sf_dir).select("doc_id", F.size(T.sentences(t)).cast("long").alias("n_sentences"), T.lead(t).alias("lead"))


@query("word_tokens", r"""
SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS n_words, len(regexp_extract_all(lower(text), '[a-z0-9]{3,}')) AS n_long,
  len(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS n_unicode, len(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9_-]{2,}')) AS n_salient,
  len(regexp_extract_all(text, '\S+')) AS n_pieces, greatest(1, length(text) // 4) AS n_quarters FROM documents""")  # fmt: skip
def word_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, n = F.col("text"), lambda c: F.size(c).cast("long")
    return A.documents(spark, sf_dir).select("doc_id", n(T.words(t)).alias("n_words"), n(T.words(t, 3)).alias("n_long"), n(T.unicode_words(t)).alias("n_unicode"), n(T.salient_words(t)).alias("n_salient"), T.piece_tokens(t).alias("n_pieces"), T.quarter_tokens(t).alias("n_quarters"))


@query("concept_extract", rf"""
WITH t AS (SELECT doc_id, unnest(list_transform(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9_-]{{2,}}'), lambda w: lower(w))) AS w,
  generate_subscripts(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9_-]{{2,}}'), 1) AS p FROM documents),
u AS (SELECT doc_id, w, min(p) AS p FROM t WHERE length(w) >= 4 AND w NOT IN ({_STOPS}) GROUP BY ALL),
r AS (SELECT doc_id, w, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS i FROM u)
SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS concepts FROM r WHERE i <= 12 GROUP BY doc_id""")  # fmt: skip
def concept_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = A.documents(spark, sf_dir).select("doc_id", T.concepts(F.col("text")).alias("c"))
    return found.where(F.size("c") > 0).select("doc_id", F.array_join("c", " ").alias("concepts"))


@query("tokens_df_topk", rf"""
WITH t AS (SELECT DISTINCT doc_id, lang, unnest(list_transform(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9_-]{{2,}}'), lambda w: lower(w))) AS term FROM documents),
c AS (SELECT lang, term, count(*) AS df FROM t WHERE length(term) >= 4 AND term NOT IN ({_STOPS}) GROUP BY ALL)
SELECT lang, term, df FROM c QUALIFY row_number() OVER (PARTITION BY lang ORDER BY df DESC, term) <= 12""")  # fmt: skip
def tokens_df_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.frequent_terms(A.documents(spark, sf_dir), "doc_id", ["lang"], 12)


@query("entity_extract")
def entity_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of every language; SQL's word borders know ASCII only, so a plain version in the tests stands in."""
    return A.documents(spark, sf_dir).select("doc_id", F.array_join(T.entities(F.coalesce("text", F.lit(""))), "|").alias("entities"))


_ALL_RELATIONS = " UNION ALL ".join(
    f"SELECT doc_id, {k} AS o, '{name}' AS relation, unnest(regexp_extract_all(text, '{p}', 1)) AS s, unnest(regexp_extract_all(text, '{p}', 2)) AS obj, "
    f"generate_subscripts(regexp_extract_all(text, '{p}', 1), 1) AS p FROM documents" for k, (name, p) in enumerate(T.RELATIONS))  # fmt: skip


@query("relation_extract", rf"""
WITH t AS ({_ALL_RELATIONS}),
u AS (SELECT doc_id, o, p, relation, regexp_replace(trim(s), '[.,;]+$', '') AS subject, regexp_replace(trim(obj), '[.,;]+$', '') AS object FROM t)
SELECT doc_id, subject, relation, object FROM u WHERE lower(subject) NOT IN ({_STOPS}) AND lower(object) NOT IN ({_STOPS})
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY o, p) <= 6""")  # fmt: skip
def relation_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.documents(spark, sf_dir).select("doc_id", F.explode(T.relations(F.col("text"))).alias("r")).select("doc_id", "r.subject", "r.relation", "r.object")


@query("cut_at_word", r"""
WITH t AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents)
SELECT doc_id, CASE WHEN length(t) <= 220 THEN t ELSE regexp_replace(substr(t, 1, 220), ' [^ ]*$', '') || '…' END AS short FROM t""")  # fmt: skip
def cut_at_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.documents(spark, sf_dir).select("doc_id", T.cut_at_word(F.col("text")).alias("short"))


@query("degenerate_texts", r"""
SELECT doc_id, length(regexp_replace(regexp_replace(text, '\[[0-9]+\]', '', 'g'), '[^\p{L}]', '', 'g')) < 10 AS degenerate,
  len(list_filter(regexp_extract_all(text, '\[([0-9]{1,9})\]', 1), lambda s: s::INT < 1 OR s::INT > 3)) AS bad_citations FROM documents""")  # fmt: skip
def degenerate_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return A.documents(spark, sf_dir).select("doc_id", T.degenerate(t).alias("degenerate"), T.citation_errors(t, F.lit(3)).alias("bad_citations"))


@query("stable_hashes", r"""
SELECT doc_id, substr(sha256(text), 1, 16) AS hash, substr(sha256(lower(trim(source))), 1, 16) AS chain_key FROM documents""")  # fmt: skip
def stable_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.documents(spark, sf_dir).select("doc_id", T.stable_hash(F.col("text")).alias("hash"), T.chain_key(F.col("source")).alias("chain_key"))


@query("dedup_sha", r"""
SELECT substr(sha256(text), 1, 16) AS sha, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1""")  # fmt: skip
def dedup_sha(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.documents(spark, sf_dir).groupBy(T.stable_hash(F.col("text")).alias("sha")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


@query("hash_embed_norm", r"""
WITH q AS (SELECT item_id, lower(text) AS t FROM benchmark),
g AS (SELECT item_id, substr(t, i::INT, 3) AS g, 1.0 AS w FROM q, unnest(range(1, greatest(2, length(t) - 1))) AS r(i)
  UNION ALL SELECT item_id, unnest(regexp_extract_all(t, '\S+')), 2.0 FROM q),
h AS (SELECT item_id, ('0x' || substr(md5(g), 3, 2) || substr(md5(g), 1, 2))::INT % 384 AS i, CASE WHEN ('0x' || substr(md5(g), 5, 2))::INT % 2 = 0 THEN w ELSE -w END AS v FROM g),
s AS (SELECT item_id, i, sum(v)::DOUBLE AS v FROM h GROUP BY ALL), n AS (SELECT item_id, sqrt(sum(v * v)) AS n FROM s GROUP BY 1)
SELECT item_id, i::BIGINT AS i, round(v / n, 6) AS v FROM s JOIN n USING (item_id) WHERE v <> 0""")  # fmt: skip
def hash_embed_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = A.table(spark, sf_dir, "benchmark")
    s = lexical.hash_embedding(q, "item_id", F.col("text"))
    return s.select("item_id", F.col("i").cast("long").alias("i"), F.round("v", 6).alias("v"))


_TERMS = r"SELECT {id}, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')) AS term FROM {t}"


@query("bm25_topk", rf"""
WITH p AS ({_TERMS.format(id='doc_id', t='documents')}), tf AS (SELECT doc_id, term, count(*) AS tf FROM p GROUP BY ALL),
dl AS (SELECT d.doc_id, coalesce(sum(tf), 0) AS dl FROM documents d LEFT JOIN tf USING (doc_id) GROUP BY 1),
g AS (SELECT count(*) AS n, avg(dl) AS av FROM dl), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
q AS ({_TERMS.format(id='item_id', t='benchmark')}), qt AS (SELECT item_id, term, count(*) AS k FROM q GROUP BY ALL),
s AS (SELECT item_id, doc_id, sum(k * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / av))) AS score
  FROM qt JOIN tf USING (term) JOIN df USING (term) JOIN dl USING (doc_id), g GROUP BY ALL),
r AS (SELECT item_id AS query_id, doc_id, round(score, 4) AS score, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 4) DESC, doc_id) AS rank FROM s)
SELECT * FROM r WHERE rank <= 8""")  # fmt: skip
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = A.documents(spark, sf_dir).select("doc_id", "text")
    return lexical.bm25(docs, "doc_id", A.text_queries(spark, sf_dir), k=8)


@query("mention_counts", rf"""
WITH t AS (SELECT doc_id, unnest(list_transform(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9_-]{{2,}}'), lambda w: lower(w))) AS term FROM documents),
c AS (SELECT doc_id, term, count(*) AS n FROM t WHERE length(term) >= 4 AND term NOT IN ({_STOPS}) GROUP BY ALL)
SELECT doc_id, term, n AS mentions, round(least(1, 0.4 + 0.1 * n), 4)::DOUBLE AS importance, round(least(0.9, 0.5 + 0.05 * n), 4)::DOUBLE AS confidence FROM c WHERE n >= 3""")  # fmt: skip
def mention_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = A.documents(spark, sf_dir).select("doc_id", F.explode(T.salient_words(F.col("text"))).alias("term"))
    c = t.where((F.length("term") >= 4) & ~F.col("term").isin(T.STOP_WORDS)).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("mentions")).where("mentions >= 3")
    return c.select("doc_id", "term", "mentions", F.round(F.least(F.lit(1.0), 0.4 + 0.1 * F.col("mentions")), 4).alias("importance"), F.round(F.least(F.lit(0.9), 0.5 + 0.05 * F.col("mentions")), 4).alias("confidence"))


@query("token_f1", r"""
WITH c AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations),
p AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '[a-z0-9]+') AS a, regexp_extract_all(lower(before), '[a-z0-9]+') AS b FROM c WHERE before IS NOT NULL),
x AS (SELECT conv_id, turn, w, count(*) AS n FROM (SELECT conv_id, turn, unnest(a) AS w FROM p) GROUP BY ALL),
y AS (SELECT conv_id, turn, w, count(*) AS n FROM (SELECT conv_id, turn, unnest(b) AS w FROM p) GROUP BY ALL),
m AS (SELECT conv_id, turn, sum(least(x.n, y.n)) AS c FROM x JOIN y USING (conv_id, turn, w) GROUP BY ALL)
SELECT conv_id, turn, round(CASE WHEN len(a) + len(b) = 0 OR coalesce(c, 0) = 0 THEN 0 ELSE 2.0 * c / (len(a) + len(b)) END, 6)::DOUBLE AS f1
FROM p LEFT JOIN m USING (conv_id, turn)""")  # fmt: skip
def token_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = A.table(spark, sf_dir, "conversations")
    c = c.withColumn("before", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("before is not null")
    f1 = lexical.token_f1(c, ["conv_id", "turn"], F.col("text"), F.col("before"))
    return f1.select("conv_id", "turn", F.round("f1", 6).alias("f1"))


@query("evidence_policy", r"""
WITH c AS (SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations),
k AS (SELECT conv_id, turn, CASE WHEN role ILIKE '%user%' OR role ILIKE '%chat%' OR role ILIKE '%manual%' THEN 'pratyaksa' ELSE 'shabda' END AS new,
  CASE WHEN before ILIKE '%user%' OR before ILIKE '%chat%' OR before ILIKE '%manual%' THEN 'pratyaksa' ELSE 'shabda' END AS old FROM c WHERE before IS NOT NULL)
SELECT conv_id, turn, old AS old_class, new AS new_class, CASE new WHEN 'pratyaksa' THEN 2 ELSE 1 END - CASE old WHEN 'pratyaksa' THEN 2 ELSE 1 END AS rank_change,
  CASE WHEN old = new THEN 'recency_wins_keep_both' ELSE 'direct_wins_testimony_dissent' END AS policy FROM k""")  # fmt: skip
def evidence_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("subject").orderBy("seq")
    c = A.table(spark, sf_dir, "conversations").select("conv_id", F.col("conv_id").alias("subject"), F.col("turn").alias("seq"), F.col("role").alias("source"))
    c = c.withColumn("before", F.lag("source").over(w)).where("before is not null")
    return versions.evidence_policy(c, F.col("before"), F.col("source")).select("conv_id", F.col("seq").alias("turn"), "old_class", "new_class", "rank_change", "policy")


@query("syllable_digits")
def syllable_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.table(spark, sf_dir, "part").select("p_partkey", T.syllable_digits(F.col("p_name")).alias("digits"))


@query("title_canon", r"""
SELECT p_partkey, trim(CASE WHEN contains(lower(t), ': ') THEN substr(lower(t), strpos(lower(t), ': ') + 2) ELSE lower(t) END) AS title
FROM (SELECT p_partkey, p_brand || ': ' || p_name AS t FROM part)""")  # fmt: skip
def title_canon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.table(spark, sf_dir, "part").select("p_partkey", T.canonical_title(F.concat_ws(": ", "p_brand", "p_name")).alias("title"))


@query("chunk_documents")
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.chunk(A.documents(spark, sf_dir).select("doc_id", "text"), "doc_id").select("doc_id", "seq", F.length("chunk").alias("n_chars"), T.stable_hash(F.col("chunk")).alias("hash"))
