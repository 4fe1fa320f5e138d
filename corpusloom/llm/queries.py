"""The opN_ queries of this subpackage and the SQL that gives the same rows."""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bagminhash, chat, decontaminate, langid, licences, pfair, shards, spans, topk, urls
from .common import shared_dir

#: (host, path, verdict)
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]

WORDS_SQL = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.licences(_read(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_read(spark, sf_dir, "documents"))


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_k(rows, rows.where("vec_id % 50 = 0"))


OP3_SQL = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""


def op4_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.materialise(_read(spark, sf_dir, "documents"), f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


OP5_SQL = f"""
WITH item AS (
  SELECT item_id, w, len(w) AS n FROM (SELECT item_id, {WORDS_SQL} AS w FROM benchmark WHERE text IS NOT NULL) WHERE len(w) > 0
), win AS (
  SELECT DISTINCT item_id, least(n, 10) AS size, array_to_string(w[i:i + least(n, 10) - 1], ' ') AS k
  FROM (SELECT item_id, w, n, unnest(range(1, greatest(n - 10, 0) + 2)) AS i FROM item)
), doc AS (
  SELECT doc_id, w, len(w) AS n FROM (SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE {WORDS_SQL} END AS w FROM documents)
), size AS (SELECT DISTINCT size FROM win),
dwin AS (
  SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS k
  FROM (SELECT doc_id, w, n, size, unnest(range(1, n - size + 2)) AS i FROM doc, size WHERE n >= size)
), hit AS (SELECT doc_id, i, dwin.size AS size, item_id FROM dwin JOIN win ON dwin.k = win.k AND dwin.size = win.size),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hit) GROUP BY doc_id),
its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS l
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hit) GROUP BY doc_id
)
SELECT doc.doc_id, CAST(doc.n AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)
"""


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(_read(spark, sf_dir, "conversations"))


def op7_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = spans.deduplicate(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_sentences", "n_removed", (F.col("n_removed") > 0).alias("repeats"), F.array_min("firsts").alias("first_doc_id"), F.size("firsts").cast("bigint").alias("n_firsts"), F.length("text").cast("bigint").alias("n_chars_left"), F.sha2("text", 256).alias("text_sha256"))


OP7_SQL = rf"""
WITH s0 AS (
  SELECT doc_id, list_filter(string_split(regexp_replace(text, '([.!?]\s+|[。！？]\s*|\n\s*)', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS l FROM documents
), sen AS (SELECT doc_id, unnest(l) AS text, unnest(range(len(l))) AS i FROM s0 WHERE l IS NOT NULL),
w AS (SELECT doc_id, i, {WORDS_SQL} AS w FROM sen),
x AS (
  SELECT doc_id, i, w, len(w) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k, sum(len(w)) OVER (PARTITION BY doc_id ORDER BY i) - len(w) AS before
  FROM w WHERE len(w) > 0
), r AS (
  SELECT a.doc_id, a.i AS a, a.k, min(b.k) AS kb FROM x a JOIN x b ON a.doc_id = b.doc_id AND b.k >= a.k + 2 AND b.before + b.n - a.before >= 12 GROUP BY ALL
), sp AS (
  SELECT r.doc_id, r.a, max(b.i) + 1 AS b, string_agg(array_to_string(b.w, ' '), '|' ORDER BY b.k) AS key FROM r JOIN x b ON b.doc_id = r.doc_id AND b.k BETWEEN r.k AND r.kb GROUP BY r.doc_id, r.a
), f AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id, a) AS o, first_value(doc_id) OVER (PARTITION BY key ORDER BY doc_id, a) AS fd FROM sp),
gone AS (SELECT doc_id, unnest(range(a, b)) AS i, fd FROM f WHERE o > 1),
g AS (SELECT doc_id, count(DISTINCT i) AS n_removed, min(fd) AS first_doc_id, count(DISTINCT fd) AS n_firsts FROM gone GROUP BY doc_id),
rest AS (SELECT doc_id, string_agg(text, '' ORDER BY i) AS t FROM sen ANTI JOIN (SELECT DISTINCT doc_id, i FROM gone) USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(l), 0) AS BIGINT) AS n_sentences, coalesce(n_removed, 0) AS n_removed, coalesce(n_removed, 0) > 0 AS repeats, first_doc_id,
       coalesce(n_firsts, 0) AS n_firsts, CAST(length(CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(t, '') END) AS BIGINT) AS n_chars_left,
       sha256(CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(t, '') END) AS text_sha256
FROM documents d JOIN s0 USING (doc_id) LEFT JOIN g USING (doc_id) LEFT JOIN rest USING (doc_id)
"""


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.range(1).select(F.explode(F.array(*(F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in URL_RULES))).alias("r")).select("r.*")
    return urls.judge(_read(spark, sf_dir, "pages"), rules).drop("url")


OP8_SQL = """
WITH p AS (
  SELECT row_number() OVER () AS i, page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), q AS (
  SELECT i, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p
), r(h, d, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
m AS (
  SELECT q.page_id, q.host, q.path, h || d AS rule, v, row_number() OVER (PARTITION BY q.i ORDER BY length(h || d) DESC) AS k
  FROM q LEFT JOIN r ON (q.host = h OR ends_with(q.host, '.' || h)) AND starts_with(q.path, d)
)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule, coalesce(v, 'allow') AS verdict FROM m WHERE k = 1
"""


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.near_duplicates(_read(spark, sf_dir, "documents"))


OP9_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents WHERE text IS NOT NULL),
c AS (
  SELECT doc_id, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') AS s, count(*) AS c
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0) GROUP BY ALL
), n AS (SELECT doc_id, sum(c) AS n FROM c GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, sum(least(a.c, b.c)) AS o FROM c a JOIN c b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT x, y, o = p.n AND o = q.n AS same FROM o JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE o >= 0.8 * (p.n + q.n - o) - 1e-9),
both_ways AS (SELECT x, y, same FROM e UNION ALL SELECT y, x, same FROM e),
reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, y FROM reach JOIN both_ways ON r = x),
class AS (SELECT doc_id, min(r) AS class_id, count(*) AS class_size FROM reach GROUP BY doc_id),
same AS (SELECT x AS doc_id, count(*) FILTER (same) AS k FROM both_ways GROUP BY x)
SELECT doc_id, class_id, class_size, coalesce(k, 0) + 1 AS copies FROM class LEFT JOIN same USING (doc_id)
"""


def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pfair.mix(_read(spark, sf_dir, "documents"))


def queries() -> dict:
    return {"op1_license_scan": op1_license_scan, "op2_language_id": op2_language_id, "op3_top_k": op3_top_k, "op4_token_shards": op4_token_shards, "op5_decontaminate": op5_decontaminate, "op6_chat_format": op6_chat_format, "op7_sentence_spans": op7_sentence_spans, "op8_url_filter": op8_url_filter, "op9_near_duplicates": op9_near_duplicates, "op10_mix": op10_mix}


def oracle_sql() -> dict[str, str]:
    return {"op3_top_k": OP3_SQL, "op5_decontaminate": OP5_SQL, "op7_sentence_spans": OP7_SQL, "op8_url_filter": OP8_SQL, "op9_near_duplicates": OP9_SQL}
