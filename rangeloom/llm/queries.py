"""The registered queries of the text operators, each over its whole table with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .licenses import duckdb_sql

PIECES = "piece_bpe_32k.model"


def tokenizer(name: str = PIECES) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokens import token_counts

    return token_counts(table(spark, sf_dir, "documents"), tokenizer(), limit=4096)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import language_id

    return language_id(table(spark, sf_dir, "documents"))


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import personal_data

    return personal_data(table(spark, sf_dir, "documents"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sentencepieces import encoded_documents

    return encoded_documents(table(spark, sf_dir, "documents"), tokenizer())


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vectors import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"), cosine=0.98)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import secrets

    return secrets(table(spark, sf_dir, "documents"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import licences

    return licences(table(spark, sf_dir, "documents"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import main_text

    return main_text(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_language_id": op2_language_id,
    "op3_personal_data": op3_personal_data,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_minhash_dedup": op5_minhash_dedup,
    "op6_embedding_dedup": op6_embedding_dedup,
    "op7_decontamination": op7_decontamination,
    "op8_secrets": op8_secrets,
    "op9_licenses": op9_licenses,
    "op10_html_text": op10_html_text,
}

#: Lower case of ASCII letters only, as the contracts have it.
_ASCII_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP5 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_ASCII_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)
), n AS (
  SELECT w.doc_id, coalesce(c, 0) AS c FROM w LEFT JOIN (SELECT doc_id, count(*) AS c FROM s GROUP BY 1) x USING (doc_id)
), e AS (
  SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2) p
  JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b WHERE 100 * k >= 85 * (na.c + nb.c - k)
), r AS (
  SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a
), m AS (SELECT a, min(b) AS c FROM r GROUP BY 1)
SELECT doc_id, n.c AS n_shingles, m.c AS component_id, doc_id = m.c AS kept FROM n JOIN m ON m.a = n.doc_id
"""

_OP7 = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all({_ASCII_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all({_ASCII_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), dw AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw))
), m AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw USING (n, g)
), h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY 1
), t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY 1), it AS (SELECT item_id, w, row_number() OVER () AS iid FROM (SELECT DISTINCT item_id, w FROM b WHERE len(w) > 0)
), iw AS (SELECT iid, i, list_distinct(w[i:i + least(len(w), 10) - 1]) AS g FROM (SELECT iid, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM it)
), ig AS (SELECT iid, i, greatest(1, ceil(len(g) * 0.9 - 1e-9)) AS r, unnest(g) AS word FROM iw
), dc AS (SELECT doc_id, word, unnest(range(greatest(0, p // 10 - 1), p // 10 + 1)) AS cell FROM (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS p FROM d) WHERE word IN (SELECT word FROM ig)
), nc AS (SELECT DISTINCT doc_id, cell, iid FROM (
  SELECT doc_id, cell, iid, i, any_value(r) AS r, count(*) AS c FROM (SELECT DISTINCT doc_id, cell, word FROM dc) JOIN ig USING (word) GROUP BY 1, 2, 3, 4) WHERE c >= r
), ie AS (SELECT DISTINCT iid, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g FROM (SELECT iid, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM it)
), ec AS (SELECT DISTINCT doc_id, iid, cell FROM (SELECT doc_id, iid, i - 1 AS lo, n, unnest(range(greatest(0, (i - 1) // 10 - 1), (i - 1) // 10 + 1)) AS cell FROM dw JOIN ie USING (n, g)) WHERE lo + n <= cell * 10 + 20
), nn AS (SELECT doc_id, count(*) AS n_near FROM nc ANTI JOIN ec USING (doc_id, iid, cell) GROUP BY 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0) AS n_near
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id) LEFT JOIN nn USING (doc_id)
"""


_OP6 = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE label IS NOT NULL
), e AS (
  SELECT p.vec_id AS a, q.vec_id AS b FROM v p JOIN v q ON p.label = q.label AND p.vec_id <> q.vec_id
  WHERE list_cosine_similarity(p.x, q.x) >= 0.98
), r AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a
), m AS (SELECT a, min(b) AS c FROM r GROUP BY 1
), k AS (SELECT a, count(*) AS n FROM e GROUP BY 1)
SELECT m.a AS vec_id, coalesce(k.n, 0) AS n_links, m.c AS component_id, m.a = m.c AS kept FROM m LEFT JOIN k USING (a)
"""

ORACLE_SQL: dict[str, str] = {
    "op5_minhash_dedup": _OP5,
    "op6_embedding_dedup": _OP6,
    "op7_decontamination": _OP7,
    "op9_licenses": duckdb_sql(),
}
