"""Queries over timelines (events) and reply threads (conversations)."""
from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from probity.operators import activity as A
from probity.plans.text_queries import r6

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def events(spark, d):
    return spark.read.parquet(f"{d}/events.parquet")


@query(
    "SELECT user_id, n AS comments_count, round(m, 6) AS interval_mean_minutes, round(s, 6) AS interval_std_minutes, round(CASE WHEN m > 0 THEN s / m END, 6) AS interval_cv, CASE WHEN m > 0 AND s / m < 0.5 THEN 1 ELSE 0 END AS suspiciously_regular "
    "FROM (SELECT user_id, count(*) AS n, avg(gap) / 60 AS m, stddev_samp(gap) / 60 AS s FROM (SELECT user_id, CAST(t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS DOUBLE) AS gap FROM (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events)) GROUP BY 1 HAVING count(*) >= 2)"
)
def comment_intervals(spark, d):
    x = events(spark, d).withColumn("t", F.unix_timestamp("ts"))
    out = A.intervals(x, "user_id", "t", "event_id")
    return out.select("user_id", "comments_count", *[r6(c).alias(c) for c in ("interval_mean_minutes", "interval_std_minutes", "interval_cv")], "suspiciously_regular")


@query(
    "SELECT user_id, round(CASE WHEN n > 5 THEN ln(n) - s / n END, 6) AS hour_entropy, round(night / CAST(n AS DOUBLE), 6) AS night_rate, round(weekend / CAST(n AS DOUBLE), 6) AS weekend_rate, round(CASE WHEN hours > 1 THEN 1 - sd / (n / CAST(hours AS DOUBLE)) ELSE 0.0 END, 6) AS hour_uniformity FROM ("
    "SELECT user_id, CAST(sum(k) AS BIGINT) AS n, sum(k * ln(k)) AS s, sum(k) FILTER (h BETWEEN 0 AND 6) AS night0, coalesce(sum(k) FILTER (h BETWEEN 0 AND 6), 0) AS night, sum(we) AS weekend, count(*) AS hours, stddev_samp(k) AS sd "
    "FROM (SELECT user_id, hour(ts) AS h, count(*) AS k, count(*) FILTER (isodow(ts) >= 6) AS we FROM events GROUP BY 1, 2) GROUP BY 1)"
)
def hour_entropy_activity(spark, d):
    out = A.hours(events(spark, d), "user_id", "ts")
    return out.select("user_id", *[r6(c).alias(c) for c in ("hour_entropy", "night_rate", "weekend_rate", "hour_uniformity")])


@query(
    "SELECT user_id, max(h) AS max_in_hour, max(dd) AS max_in_day FROM (SELECT user_id, date_trunc('hour', ts) AS x, count(*) AS h, NULL AS dd FROM events GROUP BY 1, 2 UNION ALL SELECT user_id, date_trunc('day', ts), NULL, count(*) FROM events GROUP BY 1, 2) GROUP BY 1"
)
def burst_counts(spark, d):
    return A.bursts(events(spark, d), "user_id", "ts")


@query("SELECT user_id, round(avg(value), 6) AS avg_likes, round(median(value), 6) AS median_likes, round(avg(CASE WHEN value = 0 THEN 1.0 ELSE 0.0 END), 6) AS zero_rate, count(DISTINCT event_type) AS types, round(count(DISTINCT value) / CAST(count(*) AS DOUBLE), 6) AS unique_ratio FROM events GROUP BY 1")
def likes_stats(spark, d):
    return events(spark, d).groupBy("user_id").agg(
        r6(F.avg("value")).alias("avg_likes"), r6(F.median("value")).alias("median_likes"), r6(F.avg(F.when(F.col("value") == 0, 1.0).otherwise(0.0))).alias("zero_rate"),
        F.countDistinct("event_type").alias("types"), r6(F.countDistinct("value") / F.count("*")).alias("unique_ratio"),
    )


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN 60 PRECEDING AND CURRENT ROW) AS in_last_minute FROM (SELECT event_id, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events)")
def sliding_60s_rate(spark, d):
    w = W.partitionBy("user_id").orderBy("t").rangeBetween(-60, 0)
    return events(spark, d).withColumn("t", F.unix_timestamp("ts")).select("event_id", F.count("*").over(w).alias("in_last_minute"))


@query("SELECT user_id, count(DISTINCT event_type) AS types, round(CASE WHEN count(*) > 1 THEN log2(sum(k)) - sum(k * log2(k)) / sum(k) ELSE 0.0 END, 6) AS type_entropy FROM (SELECT user_id, event_type, count(*) AS k FROM events WHERE event_type IS NOT NULL GROUP BY 1, 2) GROUP BY 1")
def type_diversity_entropy(spark, d):
    return A.type_entropy(events(spark, d), "user_id", "event_type").select("user_id", "types", r6("type_entropy").alias("type_entropy"))


@query("SELECT event_id, try_cast(json_extract(props, '$.k') AS BIGINT) AS k, json_extract(props, '$.k') IS NOT NULL AS has_k FROM events")
def json_props(spark, d):
    p = F.try_parse_json("props")
    return events(spark, d).select("event_id", F.try_variant_get(p, "$.k", "bigint").alias("k"), F.try_variant_get(p, "$.k", "bigint").isNotNull().alias("has_k"))


@query("SELECT event_type, count(*) AS rows_, round(sum(value), 2) AS total FROM (SELECT * FROM events WHERE event_type = 'click' UNION ALL SELECT * FROM events WHERE event_type <> 'click' UNION ALL SELECT * FROM events WHERE user_id % 7 = 0) GROUP BY 1")
def union_all_sources(spark, d):
    e = events(spark, d)
    u = e.where("event_type = 'click'").unionByName(e.where("event_type <> 'click'")).unionByName(e.where("user_id % 7 = 0"))
    return u.groupBy("event_type").agg(F.count("*").alias("rows_"), F.round(F.sum("value"), 2).alias("total"))


@query("SELECT user_id, event_type, arg_min(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1, 2")
def first_wins_dedupe(spark, d):
    return A.keep_one(events(spark, d), ["user_id", "event_type"], ["ts", "event_id"], "event_id")


@query("SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1, 2")
def last_wins_dedupe(spark, d):
    return A.keep_one(events(spark, d), ["user_id", "event_type"], ["ts", "event_id"], "event_id", last=True)


@query("SELECT DISTINCT user_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = e.user_id AND c.c_acctbal > 0)")
def distinct_missing_users(spark, d):
    known = spark.read.parquet(f"{d}/customer.parquet").where("c_acctbal > 0").select(F.col("c_custkey").alias("user_id"))
    return events(spark, d).select("user_id").join(known, "user_id", "left_anti").distinct()


@query(None)
def upsert_merge(spark, d):
    e = events(spark, d).withColumn("t", F.unix_timestamp("ts"))
    keys = ["user_id", "event_type"]
    old = A.keep_row(e.where("event_id % 2 = 0"), keys, ["ts", "event_id"], last=True)
    new = e.where("event_id % 2 = 1").withColumn("value", F.when(F.col("value") > 50, F.col("value"))).withColumn("t", F.when(F.col("event_id") % 3 == 0, 0).otherwise(F.col("t")))
    new = A.keep_row(new, keys, ["ts", "event_id"], last=True)
    out = A.upsert(old, new, keys, {"value": lambda n, o: F.coalesce(n, o), "t": lambda n, o: F.when(F.coalesce(n, F.lit(0)) > 0, n).otherwise(F.coalesce(o, n))})
    return out.select(*keys, r6("value").alias("value"), "t")


SQL["upsert_merge"] = """WITH e AS (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events),
old AS (SELECT user_id, event_type, value, t FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM e WHERE event_id % 2 = 0) WHERE r = 1),
new AS (SELECT user_id, event_type, CASE WHEN value > 50 THEN value END AS value, CASE WHEN event_id % 3 = 0 THEN 0 ELSE t END AS t FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM e WHERE event_id % 2 = 1) WHERE r = 1)
SELECT user_id, event_type, round(coalesce(n.value, o.value), 6) AS value, CASE WHEN coalesce(n.t, 0) > 0 THEN n.t ELSE coalesce(o.t, n.t) END AS t FROM old o FULL JOIN new n USING (user_id, event_type)"""


def turns(spark, d):
    return spark.read.parquet(f"{d}/conversations.parquet")


@query("SELECT a.conv_id, a.turn, a.role AS replier, b.role AS target, a.role = b.role AS self_reply FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn - 1 = b.turn")
def reply_self_join(spark, d):
    a, b = turns(spark, d).alias("a"), turns(spark, d).alias("b")
    return a.join(b, (F.col("a.conv_id") == F.col("b.conv_id")) & (F.col("a.turn") - 1 == F.col("b.turn"))).select(F.col("a.conv_id").alias("conv_id"), F.col("a.turn").alias("turn"), F.col("a.role").alias("replier"), F.col("b.role").alias("target"), (F.col("a.role") == F.col("b.role")).alias("self_reply"))


EDGES = "SELECT a.conv_id, a.role AS src, b.role AS dst FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn - 1 = b.turn"


@query(
    f"WITH e AS ({EDGES}), o AS (SELECT conv_id, src AS who, count(*) AS out_degree, count(DISTINCT dst) AS out_partners FROM e GROUP BY 1, 2), i AS (SELECT conv_id, dst AS who, count(*) AS in_degree, count(DISTINCT src) AS in_partners FROM e GROUP BY 1, 2), "
    "m AS (SELECT x.conv_id, x.src AS who, count(*) AS mutual FROM (SELECT DISTINCT conv_id, src, dst FROM e) x JOIN (SELECT DISTINCT conv_id, src, dst FROM e) y ON x.conv_id = y.conv_id AND x.src = y.dst AND x.dst = y.src GROUP BY 1, 2) "
    "SELECT conv_id, who, coalesce(out_degree, 0) AS out_degree, coalesce(in_degree, 0) AS in_degree, coalesce(out_partners, 0) AS out_partners, coalesce(in_partners, 0) AS in_partners, round(coalesce(mutual, 0) / CAST(greatest(coalesce(out_partners, 0), coalesce(in_partners, 0)) AS DOUBLE), 6) AS reciprocity, CASE WHEN coalesce(in_degree, 0) < 0.1 * coalesce(out_degree, 0) THEN 1 ELSE 0 END AS low_engagement "
    "FROM o FULL JOIN i USING (conv_id, who) LEFT JOIN m USING (conv_id, who)"
)
def reciprocity(spark, d):
    e = reply_self_join(spark, d).select("conv_id", F.col("replier").alias("src"), F.col("target").alias("dst"))
    out = A.reply_degrees(e, ["conv_id"])
    return out.select("conv_id", "who", "out_degree", "in_degree", "out_partners", "in_partners", r6("reciprocity").alias("reciprocity"), "low_engagement")


@query("SELECT conv_id, turn FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY role, turn) AS r FROM conversations) WHERE r <= 3")
def topk_two_key(spark, d):
    w = W.partitionBy("conv_id").orderBy("role", "turn")
    return turns(spark, d).withColumn("r", F.row_number().over(w)).where("r <= 3").select("conv_id", "turn")
