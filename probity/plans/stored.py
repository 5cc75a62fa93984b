"""The stored tables of the feature build, derived from the test tables.

Each derivation is SQL that Spark and DuckDB read alike; `{name}` stands for a test table. Rows cover nulls,
blank texts, mixed scripts, missing parents and repeated children.
"""
from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

AS_OF = 1706745600  # 2024-02-01 00:00 UTC

STORED = {
    "profiles": """SELECT c_custkey AS id, c_custkey + 100000 AS user_id,
  CASE WHEN c_custkey % 17 = 0 THEN NULL WHEN c_custkey % 5 = 0 THEN 'Анна' WHEN c_custkey % 7 = 0 THEN 'Iv4n' WHEN c_custkey % 11 = 0 THEN 'Mиша' WHEN c_custkey % 13 = 0 THEN ' ' ELSE c_mktsegment END AS first_name,
  CASE WHEN c_custkey % 19 = 0 THEN NULL WHEN c_custkey % 6 = 0 THEN 'Петрова' WHEN c_custkey % 4 = 0 THEN 'X' ELSE c_name END AS last_name,
  CASE WHEN c_custkey % 3 = 0 THEN c_name || ' пишет https://bit.ly/' || c_mktsegment || ' кредит' END AS status,
  CASE WHEN c_custkey % 4 = 0 THEN c_mktsegment || ' ' || lower(c_mktsegment) || ' and more Words, www.x.tk' END AS about,
  CASE WHEN c_custkey % 10 = 0 THEN '   ' WHEN c_custkey % 10 = 1 THEN 'nan' WHEN c_custkey % 10 < 4 THEN 'music, films & books' END AS interests,
  CASE WHEN c_custkey % 8 = 0 THEN 'Война и мир' END AS books, CAST(NULL AS STRING) AS tv, CASE WHEN c_custkey % 9 = 0 THEN c_name || c_name END AS quotes,
  CASE WHEN c_custkey % 14 = 0 THEN '' END AS games, CASE WHEN c_custkey % 15 = 0 THEN 'казино бонус' END AS movies, CASE WHEN c_custkey % 16 = 0 THEN 'a' END AS music,
  CASE WHEN c_custkey % 12 = 0 THEN 'https://e.org' END AS site, CASE WHEN c_custkey % 20 = 0 THEN '+7' END AS mobile_phone, CAST(NULL AS STRING) AS home_phone,
  CASE WHEN c_custkey % 2 = 0 THEN 'p' ELSE '' END AS photo_50, CASE WHEN c_custkey % 3 = 0 THEN 'p' END AS photo_100, CASE WHEN c_custkey % 5 < 3 THEN 'p' END AS photo_200, CAST(NULL AS STRING) AS photo_400,
  c_custkey % 9 = 0 AS verified, c_custkey % 31 = 0 AS is_sber_verified, CAST(NULL AS BOOLEAN) AS is_tinkoff_verified, CASE WHEN c_custkey % 2 = 0 THEN c_custkey % 8 = 0 END AS is_esia_verified,
  CASE WHEN c_custkey % 3 > 0 THEN 'City' END AS city_title, CASE WHEN c_nationkey > 5 THEN 'Country' END AS country_title, CASE WHEN c_nationkey < 9 THEN 'Town' END AS home_town,
  CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE DATE '2010-01-01' + CAST(c_custkey * 7 % 5200 AS INT) END AS registered_at,
  CASE WHEN c_custkey % 23 = 0 THEN NULL ELSE 1706000000 + c_custkey * 7919 % 700000 END AS last_seen_ts,
  CASE WHEN c_custkey % 4 = 0 THEN NULL WHEN c_custkey % 5 = 0 THEN 1 ELSE 0 END AS is_bot FROM {customer}""",
    "profile_counters": """SELECT c_custkey AS id, c_custkey AS profile_id, CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 6 = 0 THEN 0 ELSE c_custkey * 31 % 500 END AS followers,
  CASE WHEN c_custkey % 8 = 0 THEN 0 ELSE c_custkey * 17 % 300 END AS friends, c_custkey * 3 % 40 AS photos, CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 11 END AS videos, c_custkey % 70 AS audios,
  c_custkey * 5 % 90 AS groups, CASE WHEN c_custkey % 9 = 0 THEN 0 ELSE c_custkey * 7 % 60 END AS subscriptions, CASE WHEN c_custkey % 2 = 0 THEN c_custkey % 13 END AS mutual_friends, c_custkey % 5 AS online_friends
  FROM {customer} WHERE c_custkey % 10 <> 3""",
    "comments": """SELECT doc_id AS id, CASE WHEN doc_id % 37 = 0 THEN -5 WHEN doc_id % 41 = 0 THEN NULL ELSE 100001 + doc_id * 7 % 101 END AS from_id, doc_id % 9 AS owner_id, doc_id % 4 AS post_id, doc_id AS comment_id,
  CASE WHEN doc_id % 3 = 0 THEN doc_id - 36 WHEN doc_id % 10 = 7 THEN doc_id END AS reply_to_comment_id, 1704067200 + doc_id * doc_id * 13 % 2500000 AS timestamp,
  CASE WHEN doc_id % 29 = 0 THEN NULL WHEN doc_id % 31 = 0 THEN '' WHEN doc_id % 27 = 0 THEN '  ' ELSE text END AS text, doc_id * 5 % 4 AS likes, doc_id % 50 = 0 AS is_deleted, doc_id % 11 = 0 AS is_edited FROM {documents}""",
    "comment_urls": "SELECT doc_id AS id, doc_id AS comment_id_fk, 'https://e.org' AS url FROM {documents} WHERE doc_id % 4 = 0 UNION ALL SELECT doc_id + 10000000, doc_id, 'https://f.org' FROM {documents} WHERE doc_id % 12 = 0",
    "comment_hashtags": "SELECT doc_id AS id, doc_id AS comment_id_fk, source AS tag FROM {documents} WHERE doc_id % 6 = 0",
    "comment_mentions": "SELECT doc_id AS id, doc_id AS comment_id_fk, 'x' AS handle FROM {documents} WHERE doc_id % 10 = 0",
    "profile_followers_sample": """SELECT o_orderkey AS id, o_custkey AS profile_id, CASE WHEN o_orderkey % 43 = 0 THEN NULL ELSE 100001 + o_orderkey * 13 % 400 END AS follower_user_id, CAST(o_orderkey % 3 AS INT) AS sex,
  CASE WHEN o_orderkey % 2 = 0 THEN 'p' END AS photo_50, CASE WHEN o_orderkey % 5 = 0 THEN 'p' END AS photo_100, CAST(NULL AS STRING) AS photo_200, o_orderstatus = 'F' AS online FROM {orders}""",
    "profile_subscriptions_sample": """SELECT l_orderkey * 10 + l_linenumber AS id, 1 + l_orderkey % 1300 AS profile_id, CASE WHEN l_partkey % 50 = 0 THEN NULL ELSE l_partkey % 300 END AS group_id,
  CASE l_partkey % 3 WHEN 0 THEN 'group' WHEN 1 THEN 'page' END AS type, CASE l_suppkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'text' END AS description FROM {lineitem} WHERE l_linenumber < 3""",
    "profile_universities": """SELECT p_partkey AS id, 1 + p_partkey % 700 AS profile_id, CASE WHEN p_partkey % 3 = 0 THEN p_partkey END AS university_id, CASE WHEN p_partkey % 4 = 0 THEN p_name END AS name,
  CASE WHEN p_partkey % 2 = 0 THEN p_brand END AS faculty_name, CASE WHEN p_partkey % 5 = 0 THEN p_type END AS chair_name, CASE WHEN p_partkey % 6 > 0 THEN CAST(1990 + p_partkey % 30 AS INT) END AS graduation FROM {part}""",
    "profile_schools": "SELECT p_partkey AS id, 300 + p_partkey % 900 AS profile_id, CASE WHEN p_partkey % 2 = 0 THEN p_partkey END AS school_id, CASE WHEN p_partkey % 7 = 0 THEN p_name END AS name, CAST(1985 + p_partkey % 33 AS INT) AS year_graduated FROM {part} WHERE p_partkey % 3 > 0",
    "profile_careers": """SELECT p_partkey AS id, 1 + p_partkey * 3 % 1400 AS profile_id, CASE WHEN p_partkey % 3 = 0 THEN p_brand END AS company, CASE WHEN p_partkey % 4 > 0 THEN p_type END AS position,
  CAST(2000 + p_partkey % 10 AS INT) AS from_year, CASE WHEN p_partkey % 9 > 0 THEN CAST(2005 + p_partkey % 15 AS INT) END AS until_year FROM {part} WHERE p_partkey % 2 = 0""",
}


def stored(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    out = {}
    for name, sql in STORED.items():
        used = set(re.findall(r"\{(\w+)\}", sql))
        out[name] = spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})
    return out


def with_stored(names: str, sql: str) -> str:
    """sql behind the named stored tables, for DuckDB."""
    return "WITH " + ",\n".join(f"{n} AS ({re.sub(r'[{](\w+)[}]', r'\1', STORED[n])})" for n in names.split()) + sql
