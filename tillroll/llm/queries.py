"""The operators applied to the given tables with production parameters, and their SQL.

Each query derives the columns of its contract from what its operator returns.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm import (embedding_dedup, exact_dedup, html_extract, language_id, license_scan, minhash_dedup, mixing,
                          packing, sharding, token_counts, url_filter, vector_codes, whitening)
from tillroll.llm.support import cut, table, text_of

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
#: Shares of the mixture by size; the other sources share the rest equally.
MIX_WEIGHTS, MIX_SEED = {"src0": 0.10, "src1": 0.10, "src2": 0.15}, 7
#: (host, path prefix, verdict), and the words of hosts whose pages make up the list of bad URLs.
URL_RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"),
             ("org", "/fr/", "allow"))
BAD_HOST_WORDS = "spam|pills|casino|adult|bets|ads"
SHARDS = 8


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    bad = pages.where(url_filter.host_of(F.col("url")).rlike(f"(^|[.-])({BAD_HOST_WORDS})([.-]|$)"))
    return url_filter.judge(pages, URL_RULES, bad)


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the whole shuffled copies are written to the shared folder; the columns are read from them
    mixed = cut(mixing.mix(table(spark, sf_dir, "documents"), MIX_WEIGHTS, seed=MIX_SEED))
    return mixed.select("doc_id", "source", "copies", "copy", "shuffle_key")


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_dedup(table(spark, sf_dir, "embeddings"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = language_id.predict(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(table(spark, sf_dir, "documents"))


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.minhash_dedup(table(spark, sf_dir, "documents"), words=2)


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), TOKENIZER)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                         "sequence_id", "offset")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    # whole documents are placed; size and digest are taken from what the operator returns
    placed = sharding.shard_rows(table(spark, sf_dir, "documents"), "doc_id", SHARDS)
    return placed.select("doc_id", (F.octet_length(text_of()) + F.lit(1).cast("long")).alias("size"),
                         F.crc32(text_of().cast("binary")).alias("text_crc32"), F.lit("key").alias("law"),
                         "shard", "slot", "grown_shard")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.vector_codes(table(spark, sf_dir, "embeddings"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), TOKENIZER)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    whitened = whitening.long_form(whitening.whiten(table(spark, sf_dir, "embeddings")))
    return whitened.withColumn("deviation", whitened.deviation.cast("long"))


QUERIES = {f.__name__: f for f in (op1_exact_dedup, op2_url_filter, op3_mix_sources, op4_embedding_dedup,
                                   op5_language_id, op6_license_scan, op7_minhash_dedup, op8_html_extract,
                                   op9_packing, op10_sharding, op11_vector_codes, op12_token_counts, op13_whitening)}

OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) = 1 AS kept,
       text_sha256
FROM d
"""

OP2_SQL = rf"""
WITH cut AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS u FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(u, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                            'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(u, '^[^/?#]*([^?#]*)', 1) AS path,
         list_sort(list_filter(string_split(regexp_extract(u, '^[^?#]*\?([^#]*)', 1), '&'), lambda x: x <> ''
           AND NOT regexp_matches(x, '^({url_filter.TRACKING})(=|$)'))) AS query
  FROM cut
), canon AS (
  SELECT page_id, host, path, CASE WHEN host = '' THEN '' ELSE
         regexp_replace(host, ':\d*$', '') || regexp_replace(path, '(/index)?(\.html?)?/*$', '')
         || CASE WHEN len(query) > 0 THEN '?' || array_to_string(query, '&') ELSE '' END END AS canon
  FROM parts
), listed AS (
  SELECT DISTINCT canon FROM canon WHERE canon <> '' AND regexp_matches(host, '(^|[.-])({BAD_HOST_WORDS})([.-]|$)')
), rules(host, path, verdict) AS (
  VALUES {", ".join(str(r) for r in URL_RULES)}
), fitting AS (
  SELECT c.page_id, r.host || r.path AS rule, r.verdict,
         row_number() OVER (PARTITION BY c.page_id ORDER BY length(r.host || r.path) DESC) AS place
  FROM canon c JOIN rules r ON (c.host = r.host OR ends_with(c.host, '.' || r.host)) AND starts_with(c.path, r.path)
)
SELECT c.page_id, c.host, c.path, f.rule,
       coalesce(f.verdict, CASE WHEN l.canon IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
       l.canon IS NOT NULL AS listed
FROM canon c LEFT JOIN (SELECT * FROM fitting WHERE place = 1) f ON f.page_id = c.page_id
LEFT JOIN listed l ON l.canon = c.canon
"""

OP3_SQL = f"""
WITH sizes AS (
  SELECT source, sum(length(coalesce(text, '')) + 1) AS size FROM documents GROUP BY source
), weighted AS (
  SELECT source, size, CASE source {" ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in MIX_WEIGHTS.items())} END AS stated
  FROM sizes
), rated AS (
  SELECT source, coalesce(stated, greatest(0.0, 1.0 - (SELECT coalesce(sum(stated), 0.0) FROM weighted))
         / (SELECT count(*) FROM weighted WHERE stated IS NULL)) * (SELECT sum(size) FROM weighted)::DOUBLE / size AS rate
  FROM weighted
), mass AS (
  SELECT source, k, CASE WHEN rate > 0 THEN exp(k * ln(rate) - rate - lgamma(k + 1.0)) ELSE (k = 0)::INT END AS p
  FROM (SELECT source, rate, unnest(generate_series(0, ceil(rate + 9 * sqrt(rate) + 40)::BIGINT)) AS k FROM rated)
), below AS (
  SELECT source, list(p ORDER BY k) AS ps FROM (
    SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS p FROM mass) WHERE p < 1 - 1e-15 GROUP BY source
), drawn AS (
  SELECT d.doc_id, d.source, len(list_filter(b.ps, lambda c: c <=
         (('0x' || substr(md5('{MIX_SEED}/' || d.doc_id::VARCHAR), 1, 13))::BIGINT + 0.5) / 4503599627370496.0))::BIGINT AS copies
  FROM documents d JOIN below b ON d.source IS NOT DISTINCT FROM b.source
)
SELECT doc_id, source, copies, copy,
       ('0x' || substr(md5('{MIX_SEED}/' || doc_id::VARCHAR || '/' || copy::VARCHAR), 1, 13))::BIGINT AS shuffle_key
FROM (SELECT doc_id, source, copies, unnest(generate_series(0, copies - 1)) AS copy FROM drawn WHERE copies > 0)
"""

#: The codebooks before and after each round of op11: dimensions cut into 16 parts, 64 entries.
OP11_ROUND = """
, a{r} AS MATERIALIZED (
  SELECT vec_id, label, p, arg_min(e, (d, e)) AS e, min(d) AS d
  FROM (SELECT r.vec_id, any_value(r.label) AS label, r.p, b.e, sum((r.x - b.x) * (r.x - b.x))::BIGINT AS d
        FROM cells r JOIN b{r} b ON r.p = b.p AND r.k = b.k GROUP BY r.vec_id, r.p, b.e)
  GROUP BY vec_id, label, p
)"""
OP11_MEANS = """
, b{s} AS MATERIALIZED (
  SELECT b.p, b.e, b.k, coalesce(m.x, b.x) AS x
  FROM b{r} b LEFT JOIN (
    SELECT a.p, a.e, c.k, (sum(c.x) - ((sum(c.x) % count(*)) + count(*)) % count(*))::BIGINT // count(*) AS x
    FROM a{r} a JOIN cells c ON a.vec_id = c.vec_id AND a.p = c.p GROUP BY a.p, a.e, c.k) m
  ON b.p = m.p AND b.e = m.e AND b.k = m.k
)"""
OP11_SQL = """
WITH kept AS (
  SELECT vec_id, label, embedding, row_number() OVER (ORDER BY vec_id) - 1 AS place FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), cells AS MATERIALIZED (
  SELECT vec_id, label, place, (i - 1) // (n // 16) AS p, (i - 1) % (n // 16) AS k, floor(256 * c::DOUBLE)::BIGINT AS x
  FROM (SELECT vec_id, label, place, len(embedding) AS n, unnest(embedding) AS c,
               unnest(generate_series(1, len(embedding))) AS i FROM kept)
), b0 AS MATERIALIZED (SELECT p, place AS e, k, x FROM cells WHERE place < 64)""" + (
    OP11_ROUND.format(r=0) + OP11_MEANS.format(r=0, s=1) + OP11_ROUND.format(r=1) + OP11_MEANS.format(r=1, s=2)
    + OP11_ROUND.format(r=2)) + """
, coded AS (
  SELECT vec_id, label, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a2 GROUP BY vec_id, label
)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
       (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY p, e, k)) FROM b2) AS codebooks_sha256
FROM coded
"""

ORACLE = {"op1_exact_dedup": OP1_SQL, "op2_url_filter": OP2_SQL, "op3_mix_sources": OP3_SQL, "op11_vector_codes": OP11_SQL}
