"""Registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dyadflow.llm import avi, bpe, divergence, language, mixing, packing, pii, quality, secrets, simhash, topk, trie, warc


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(_read(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.report(_read(spark, sf_dir, "embeddings"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(_read(spark, sf_dir, "documents"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return secrets.report(docs, secrets.train(secrets.labelled_tokens(docs)))


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return avi.report(_read(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.report(_read(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.report(_read(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record, audited against a replica with one page in 97 changed and one lost."""
    turn = F.col("page_id") % 97
    return warc.report(_read(spark, sf_dir, "pages"), turn == 13, turn == 57)


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.report(_read(spark, sf_dir, "documents"))


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.report(_read(spark, sf_dir, "conversations"))


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.report(_read(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_pii, op2_quality, op3_topk, op4_mixing, op5_secrets, op6_media, op7_simhash, op8_packing,
        op9_language, op10_warc, op11_divergence, op12_trie, op13_bpe,
    )
}

ORACLE = {
    "op3_topk": """WITH whole AS (
  SELECT row_number() OVER () AS n, vec_id,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND list_count(embedding) = len(embedding)
    AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0
), scored AS (
  SELECT q.n, q.vec_id AS query_id, c.vec_id,
         CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.n <> c.n WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT query_id, vec_id, score, CAST(row_number() OVER (
    PARTITION BY n ORDER BY score DESC, vec_id NULLS LAST) AS INTEGER) AS rank
  FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5""",
    "op10_warc": """WITH made AS (
  SELECT page_id, coalesce(url, '') AS url,
    'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10)
    || 'WARC-Record-ID: <urn:page:' || coalesce(CAST(page_id AS VARCHAR), '') || '>' || chr(13) || chr(10)
    || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10)
    || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: '
    || CAST(strlen(coalesce(html, '')) AS VARCHAR) || chr(13) || chr(10) || chr(13) || chr(10)
    || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS record
  FROM pages
), hashed AS (
  SELECT page_id, url, CAST(strlen(record) AS BIGINT) AS length, sha256(record) AS sha256 FROM made
), laid AS (
  SELECT *, coalesce(sum(length) OVER (
    ORDER BY url, page_id NULLS FIRST, sha256 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM hashed
), placed AS (
  SELECT *, CAST(floor(start / 67108864) AS BIGINT) AS archive FROM laid
)
SELECT page_id, archive, CAST(start - min(start) OVER (PARTITION BY archive) AS BIGINT) AS "offset",
  length, sha256,
  CASE WHEN page_id % 97 = 13 THEN 'changed' WHEN page_id % 97 = 57 THEN 'missing' ELSE 'intact' END AS status
FROM placed""",
    "op11_divergence": """WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(coalesce(text, ''), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS found
  FROM documents
), words AS (
  SELECT d, lang, source, translate(unnest(found), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
  FROM docs
), whole AS (
  SELECT lang, term, count(*) AS total FROM words GROUP BY lang, term HAVING count(DISTINCT d) >= 10
), counted AS (
  SELECT lang, source, term, count(*) AS n FROM words JOIN whole USING (lang, term) GROUP BY ALL
), sizes AS (
  SELECT g.lang, g.source, coalesce(any_value(w.v), 0) AS v, coalesce(any_value(w.n), 0) AS n_lang,
    coalesce(sum(c.n), 0) AS n_group
  FROM (SELECT DISTINCT lang, source FROM docs) g
  LEFT JOIN (SELECT lang, count(*) AS v, sum(total) AS n FROM whole GROUP BY lang) w ON w.lang = g.lang
  LEFT JOIN counted c ON c.lang = g.lang AND c.source = g.source
  GROUP BY g.lang, g.source
), laid AS (
  SELECT s.lang, s.source, w.term, coalesce(c.n, 0) AS n,
    CAST(1 + (CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 2)) // (s.n_group + 2 * s.v) AS HUGEINT) AS p,
    CAST(1 + (CAST(1000000000 AS HUGEINT) * (w.total + 2)) // (s.n_lang + 2 * s.v) AS HUGEINT) AS q
  FROM sizes s JOIN whole w ON w.lang = s.lang
  LEFT JOIN counted c ON c.lang = s.lang AND c.source = s.source AND c.term = w.term
), terms AS (
  SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // (p + q) AS value
  FROM laid WHERE n > 0 AND p > q
), sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM laid a JOIN laid b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
  GROUP BY a.lang, a.source, b.source
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM sizes a JOIN sizes b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
), ranked AS (
  SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (
    PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
  FROM (SELECT * FROM terms UNION ALL SELECT * FROM pairs)
)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10""",
    "op12_trie": """WITH hashed AS (
  SELECT conv_id, turn, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS words,
    sha256(CAST(length(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, '')) AS id
  FROM conversations WHERE conv_id IS NOT NULL
), placed AS (
  SELECT conv_id, id, words, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, id) - 1 AS place
  FROM hashed
), convs AS (
  SELECT conv_id, conv_id - conv_id % 20 AS origin, xor(4294967295, list_reduce(
    list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0],
      lambda x, z: xor(x >> 1, 3988292384 * (x & 1))))) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM placed)
), turns AS (
  SELECT c.conv_id, 0 AS own, p.place, p.id, p.words FROM convs c JOIN placed p ON p.conv_id = c.origin AND p.place < c.h
  UNION ALL
  SELECT c.conv_id, 1 AS own, p.place, p.id, p.words FROM convs c JOIN placed p ON p.conv_id = c.conv_id AND p.place >= c.h
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY own, place) AS depth,
    string_agg(id, '') OVER (PARTITION BY conv_id ORDER BY own, place) AS path
  FROM turns
), prefixes AS (
  SELECT conv_id, 0 AS depth, '' AS path, 0 AS words FROM convs
  UNION ALL SELECT conv_id, depth, path, words FROM numbered
), nodes AS (
  SELECT path, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words
  FROM prefixes GROUP BY path
), ends AS (
  SELECT path, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids FROM (
    SELECT conv_id, arg_max(path, depth) AS path FROM prefixes GROUP BY conv_id) GROUP BY path
), linked AS (
  SELECT n.*, p.conv_id AS parent_conv_id, p.path AS above
  FROM nodes n LEFT JOIN nodes p ON n.depth > 0 AND p.path = left(n.path, length(n.path) - 64)
), below AS (
  SELECT above AS path, count(*) AS n_children FROM linked WHERE depth > 0 GROUP BY above
), sums AS (
  SELECT left(l.path, 64 * d.level) AS path, sum((l.n_convs - 1) * l.words) AS saved_tokens,
    sum(CASE WHEN b.n_children IS NULL THEN 1 ELSE 0 END) AS n_leaves
  FROM linked l LEFT JOIN below b ON b.path = l.path, LATERAL (SELECT unnest(range(l.depth + 1)) AS level) d
  GROUP BY 1
)
SELECT l.conv_id, CAST(l.depth AS BIGINT) AS depth, l.parent_conv_id, l.n_convs,
  coalesce(b.n_children, 0) AS n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves,
  CAST(s.saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM linked l JOIN sums s ON s.path = l.path LEFT JOIN below b ON b.path = l.path LEFT JOIN ends e ON e.path = l.path""",
}
