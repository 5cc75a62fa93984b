"""The registered queries of the training-data operators, and their SQL where SQL can express them."""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probity.llm import decontam, html_text, langid, minhash, mixing, neighbours, quality, search, substrings, tokens, toxicity, urls, whitening
from probity.llm.common import fold, table

TOKENIZER = "word_bpe_49k.json"


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = quality.quality(docs, table(spark, sf_dir, "labels"))
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    out = toxicity.score(docs, model)
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = langid.identify(docs.select("doc_id", "text"), langid.train(docs))
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), g AS (
  SELECT DISTINCT item_id, n, array_to_string(list_slice(ws, p0, p0 + n - 1), ' ') AS gram
  FROM (SELECT item_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS p0 FROM (SELECT *, least(10, len(ws)) AS n FROM b WHERE len(ws) > 0))
), w AS (
  SELECT doc_id, n, p0, array_to_string(list_slice(ws, p0, p0 + n - 1), ' ') AS gram
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS p0 FROM d, (SELECT DISTINCT n FROM g) WHERE len(ws) >= n)
), h AS (
  SELECT doc_id, w.p0, w.n, item_id FROM w JOIN g ON w.gram = g.gram AND w.n = g.n
), c AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(p0, p0 + n)) AS p FROM h) GROUP BY doc_id
), i AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN i ON i.doc_id = d.doc_id
"""


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op9_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"))


def op10_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokens.count_tokens(docs, public_tokenizers.path(TOKENIZER))


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = search.build(table(spark, sf_dir, "documents").select("doc_id", "text"))
    out = search.search(index, table(spark, sf_dir, "benchmark"))
    return out.select(F.col("item_key").alias("item_id"), "rank", F.col("doc").alias("doc_id"), "score")


OP11_SQL = r"""
WITH t AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents
), s AS (
  SELECT count(*) FILTER (len(ws) > 0) AS nn, sum(len(ws)) AS ll FROM t
), p AS (
  SELECT r, doc_id, len(ws) AS n, unnest(ws) AS term FROM t
), c AS (
  SELECT r, doc_id, n, term, count(*) AS tf FROM p GROUP BY ALL
), f AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * nn + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM c, s GROUP BY term, nn
), i AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), m AS (
  SELECT item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nn) // ll)))) AS BIGINT) AS score
  FROM i JOIN c USING (term) JOIN f USING (term), s GROUP BY item_id, r, doc_id
), k AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, r) AS INTEGER) AS "rank", doc_id, score FROM m WHERE score > 0
)
SELECT item_id, "rank", doc_id, score FROM k WHERE "rank" <= 10
"""


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return out.select("vec_id", "component", "n", F.expr("try_cast(deviation as bigint)").alias("deviation"), "whitened", "explained", "identity_error")


#: host, path, verdict
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op13_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    out = urls.judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules)
    return out.select("page_id", "host", "path", "rule", "verdict", F.array_join("strict", ",").alias("strict"), F.array_join("soft", ",").alias("soft"))


def _terms_sql(words: tuple[str, ...]) -> str:
    return "array_to_string([w for w in [" + ", ".join(f"'{w}'" for w in sorted(words)) + "] if regexp_matches(lower(host || path), '(^|[^0-9a-z])' || w || '($|[^0-9a-z])')], ',')"


OP13_SQL = f"""
WITH p AS (
  SELECT page_id, row_number() OVER () AS k, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages
), r(rh, rp, rv) AS (VALUES {", ".join(map(str, URL_RULES))}
), f AS (
  SELECT k, arg_max(rh || rp, len(rh || rp)) AS rule, arg_max(rv, len(rh || rp)) AS rv FROM p JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY k
), h AS (
  SELECT page_id, k, host, path, {_terms_sql(urls.STRICT)} AS strict, {_terms_sql(urls.SOFT)} AS soft FROM p
)
SELECT page_id, host, path, rule, strict, soft, coalesce(rv, CASE WHEN strict <> '' OR len(string_split(soft, ',')) >= {urls.SEVERAL} THEN 'block' ELSE 'allow' END) AS verdict
FROM h LEFT JOIN f ON f.k = h.k
"""


QUERIES = {f.__name__: f for f in (op1_quality, op2_toxicity, op3_minhash, op4_langid, op5_neighbours, op6_decontamination, op7_mixing, op8_html, op9_suffixes, op10_tokens, op11_search, op12_whitening, op13_urls)}
ORACLE_SQL: dict[str, str] = {"op6_decontamination": OP6_SQL, "op11_search": OP11_SQL, "op13_urls": OP13_SQL}
