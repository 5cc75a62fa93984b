"""Reports: run statistics, audits, model comparison, curves, correlations, top lists, folds, filters, model fits."""
from __future__ import annotations

from pyspark.sql import functions as F

from probity.functions import clean as C
from probity.operators import metrics as M
from probity.operators import models as L
from probity.operators import reports as R
from probity.plans.table_queries import SCORED, scored, t
from probity.plans.text_queries import r6

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


P90 = "CASE WHEN n >= 10 THEN v[lo] + (v[lo + 1] - v[lo]) * (9 * (n + 1) / 10.0e0 - lo) WHEN n > 0 THEN v[n] ELSE 0 END"


@query(
    f"WITH x AS (SELECT event_type, user_id % 40 AS host, list(value ORDER BY value) FILTER (value IS NOT NULL) AS v, count(value) AS n, median(value) AS p50 FROM events GROUP BY 1, 2), y AS (SELECT *, CAST(greatest(1, least(floor(9 * (n + 1) / 10.0e0), n - 1)) AS BIGINT) AS lo FROM x) "
    f"SELECT event_type, host, n, round(coalesce(p50, 0), 6) AS p50, round({P90}, 6) AS p90 FROM y"
)
def run_rates(spark, d):
    x = t(spark, d, "events").withColumn("host", F.col("user_id") % 40)
    return R.tenths(x, ["event_type", "host"], "value").select("event_type", "host", "n", r6("p50").alias("p50"), r6("p90").alias("p90"))


@query(f"SELECT n, round(p50, 6) AS p50, round({P90}, 6) AS p90 FROM (SELECT *, CAST(greatest(1, least(floor(9 * (n + 1) / 10.0e0), n - 1)) AS BIGINT) AS lo FROM (SELECT list(x ORDER BY x) AS v, count(x) AS n, median(x) AS p50 FROM (SELECT CAST(o_totalprice AS DOUBLE) AS x FROM orders)))")
def run_rates_overall(spark, d):
    return R.tenths(t(spark, d, "orders"), [], "o_totalprice").select("n", r6("p50").alias("p50"), r6("p90").alias("p90"))


@query("SELECT CAST(row_number() OVER (ORDER BY o_totalprice DESC, o_custkey DESC, o_orderkey DESC) AS INT) AS rank, o_totalprice, o_custkey, o_orderkey FROM orders ORDER BY rank LIMIT 3")
def slowest_three(spark, d):
    return R.ranked(t(spark, d, "orders"), [F.desc("o_totalprice"), F.desc("o_custkey"), F.desc("o_orderkey")], 3).select("rank", "o_totalprice", "o_custkey", "o_orderkey")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS items, sum(o_custkey) OVER (ORDER BY o_orderkey) AS total FROM orders")
def running_totals(spark, d):
    return R.totals(t(spark, d, "orders"), "o_orderkey", "o_custkey").select("o_orderkey", F.col("items").cast("long").alias("items"), "total")


AUDITED = {"doc_id": 1, "quality": 1, "toxic": 1, "n_chars": 1, "source": 0, "lang": 0}


@query(
    "WITH x AS (SELECT documents.doc_id, quality, toxic, n_chars, source, lang FROM documents LEFT JOIN labels USING (doc_id)) "
    + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS rows, count(*) - count({c}) AS missing" + (f", round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max" if n else ", NULL, NULL, NULL, NULL") + " FROM x" for c, n in AUDITED.items())
)
def dataset_audit(spark, d):
    x = t(spark, d, "documents").join(t(spark, d, "labels"), "doc_id", "left").select(*AUDITED)
    return R.audit(x).select("column", "rows", "missing", r6("mean").alias("mean"), r6("std").alias("std"), "min", "max")


@query("SELECT quality, count(*) AS \"count\", round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS share FROM labels GROUP BY 1")
def target_counts(spark, d):
    return R.value_counts(t(spark, d, "labels"), "quality").withColumn("share", r6("share"))


@query(
    f"WITH k AS (SELECT s, count(*) AS n, count(*) FILTER (y = 1) AS p FROM {SCORED} GROUP BY 1), c AS (SELECT s, sum(n) OVER (ORDER BY s DESC) AS pp, sum(p) OVER (ORDER BY s DESC) AS tp, sum(n) OVER () AS an, sum(p) OVER () AS ap FROM k) "
    "SELECT round(s, 6) AS threshold, round((pp - tp) / CAST(an - ap AS DOUBLE), 6) AS fpr, round(tp / CAST(ap AS DOUBLE), 6) AS tpr, round(tp / CAST(pp AS DOUBLE), 6) AS precision, round(tp / CAST(ap AS DOUBLE), 6) AS recall FROM c"
)
def roc_pr_curves(spark, d):
    x = R.curves(scored(spark, d), "y", "s")
    return x.select(*[r6(c).alias(c) for c in x.columns])


MODELS = "(SELECT doc_id, y, 'm' || m AS model, CAST((s * 7 + (doc_id * (m + 3)) % 11 * 0.1 * m) / (7 + m) AS DOUBLE) AS s FROM (SELECT doc_id, quality AS y, ((doc_id * 37) % 101) / 101.0e0 * 0.5e0 + quality * 0.3e0 AS s FROM {labels} WHERE quality IS NOT NULL) z, (SELECT 0 AS m UNION ALL SELECT 2 UNION ALL SELECT 5) mm)"


@query(
    f"WITH z AS {MODELS.format(labels='labels')}, a AS (SELECT model, count(*) FILTER (y = 1 AND s >= 0.5) AS tp, count(*) FILTER (y = 0 AND s >= 0.5) AS fp, count(*) FILTER (y = 1 AND s < 0.5) AS fn, avg(CASE WHEN (y = 1) = (s >= 0.5) THEN 1.0 ELSE 0.0 END) AS accuracy, count(*) FILTER (y = 1) AS p, count(*) FILTER (y = 0) AS q FROM z GROUP BY 1), "
    "r AS (SELECT model, sum(r) FILTER (y = 1) AS r FROM (SELECT model, y, rank() OVER (PARTITION BY model ORDER BY s) + (count(*) OVER (PARTITION BY model, s) - 1) / 2.0e0 AS r FROM z) GROUP BY 1), "
    "v AS (SELECT model, sum(prec * p) / sum(p) AS ap FROM (SELECT model, p, sum(p) OVER w / CAST(sum(n) OVER w AS DOUBLE) AS prec FROM (SELECT model, s, count(*) AS n, count(*) FILTER (y = 1) AS p FROM z GROUP BY 1, 2) WINDOW w AS (PARTITION BY model ORDER BY s DESC)) GROUP BY 1), "
    "m AS (SELECT model, CASE WHEN tp + fp > 0 THEN tp / CAST(tp + fp AS DOUBLE) ELSE 0.0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / CAST(tp + fn AS DOUBLE) ELSE 0.0 END AS recall, accuracy, (r - p * (p + 1) / 2.0e0) / (p * q) AS roc_auc, ap FROM a JOIN r USING (model) JOIN v USING (model)) "
    "SELECT model, CAST(row_number() OVER (ORDER BY roc_auc DESC, model) AS INT) AS rank, round(precision, 6) AS precision, round(recall, 6) AS recall, round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END, 6) AS f1, round(accuracy, 6) AS accuracy, round(roc_auc, 6) AS roc_auc, round(ap, 6) AS average_precision FROM m"
)
def model_comparison(spark, d):
    x = spark.sql("SELECT * FROM " + MODELS, labels=t(spark, d, "labels"))
    out = R.compare_models(x, "model", "y", "s")
    return out.select("model", "rank", *[r6(c).alias(c) for c in out.columns[2:]])


GRID = f"WITH g AS (SELECT 0.05e0 + i * ((0.95e0 - 0.05e0) / 49) AS h FROM range(50) r(i)), c AS (SELECT h, count(*) FILTER (s >= h AND y = 1) AS tp, count(*) FILTER (s >= h) AS pp, count(*) FILTER (y = 1) AS ap FROM g, (SELECT y, CAST(s AS DOUBLE) AS s FROM {SCORED}) GROUP BY 1), p AS (SELECT h, CASE WHEN pp > 0 THEN tp / CAST(pp AS DOUBLE) ELSE 0.0 END AS precision, CASE WHEN ap > 0 THEN tp / CAST(ap AS DOUBLE) ELSE 0.0 END AS recall FROM c), f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM p) "


@query(GRID + "SELECT 'f1' AS choice, * FROM (SELECT round(h, 6) AS threshold, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM f ORDER BY f.f1 DESC, h LIMIT 1) UNION ALL SELECT 'precision', * FROM (SELECT round(h, 6) AS threshold, round(precision, 6), round(recall, 6), round(f1, 6) FROM f ORDER BY f.precision DESC, f.recall DESC, h LIMIT 1)")
def chosen_thresholds(spark, d):
    g = M.threshold_grid(scored(spark, d).withColumn("s", F.col("s").cast("double")), "y", "s")
    both = M.best_threshold(g).withColumn("choice", F.lit("f1")).unionByName(M.precise_threshold(g).withColumn("choice", F.lit("precision")))
    return both.select("choice", *[r6(c).alias(c) for c in ("threshold", "precision", "recall", "f1")])


PAIRS = ["o_orderkey", "o_custkey", "o_totalprice"]


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)), 6) AS pearson FROM orders" for a in PAIRS for b in PAIRS))
def pearson_matrix(spark, d):
    return R.correlation_matrix(t(spark, d, "orders"), PAIRS).withColumn("pearson", r6("pearson"))


@query("SELECT quality, f AS fold, n // 5 + CASE WHEN f < n % 5 THEN 1 ELSE 0 END AS rows FROM (SELECT quality, count(*) AS n FROM labels WHERE quality IS NOT NULL GROUP BY 1), (SELECT CAST(i AS INT) AS f FROM range(5) r(i)) WHERE n // 5 + CASE WHEN f < n % 5 THEN 1 ELSE 0 END > 0")
def stratified_fold_counts(spark, d):
    x = M.stratified_folds(t(spark, d, "labels").where("quality is not null"), "quality", "doc_id")
    return x.groupBy("quality", "fold").agg(F.count("*").alias("rows"))


@query("SELECT CAST(quality AS DOUBLE) AS label, count(*) AS rows, round((SELECT count(quality) FROM labels) / (2.0e0 * count(*)), 6) AS weight FROM labels WHERE quality >= 0 GROUP BY 1")
def class_weights(spark, d):
    x = L.labelled(t(spark, d, "labels").select(F.col("doc_id").alias("id"), F.coalesce("quality", F.lit(-1)).alias("target_is_bot")))
    return x.groupBy(L.LABEL).agg(F.count("*").alias("rows"), r6(F.first(L.WEIGHT)).alias("weight"))


@query("SELECT CAST(count(*) AS BIGINT) AS rows, count(DISTINCT doc_id) AS ids, 10 AS top FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL")
def scored_unlabelled(spark, d):
    """Logistic regression on lengths, cross-validated thresholds aside: unlabelled rows get a probability, the ten riskiest are listed."""
    x = t(spark, d, "documents").join(t(spark, d, "labels"), "doc_id", "left").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("user_id"), F.coalesce("quality", F.lit(-1)).alias("target_is_bot"), F.length("text").cast("double").alias("chars"), F.size(F.split("text", " ")).cast("double").alias("words")).na.fill(0)
    names = ["chars", "words"]
    model = L.pipeline(L.classifiers()["logistic_regression"](), names).fit(L.labelled(x))
    out = L.predict(lambda rows: L.score(model, rows), x, 0.5)
    risky = out.orderBy(F.desc(L.SCORE), "id").limit(10)
    return out.agg(F.count("*").alias("rows"), F.countDistinct("id").alias("ids")).crossJoin(risky.agg(F.count("*").cast("int").alias("top")))  # a row each


@query("SELECT DISTINCT user_id FROM events WHERE user_id > 20 ORDER BY 1")
def sorted_unique_ids(spark, d):
    return t(spark, d, "events").where("user_id > 20").select("user_id").distinct().orderBy("user_id")


@query("SELECT source, count(DISTINCT lang) AS langs, count(lang) AS rows FROM documents GROUP BY 1")
def distinct_and_count(spark, d):
    return t(spark, d, "documents").groupBy("source").agg(F.countDistinct("lang").alias("langs"), F.count("lang").alias("rows"))


@query(
    "WITH x AS (SELECT c_custkey, CASE WHEN n > 0 THEN CAST(n AS DOUBLE) END AS order_count, CASE WHEN c_custkey % 7 = 0 THEN CAST('Infinity' AS DOUBLE) WHEN c_custkey % 5 = 0 THEN NULL ELSE n / 3.0e0 END AS per_month, CASE WHEN c_custkey % 11 > 0 THEN CAST(c_acctbal AS DOUBLE) END AS balance FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_custkey % 4 > 0 GROUP BY 1) ON o_custkey = c_custkey) "
    "SELECT c_custkey, coalesce(order_count, 0) AS order_count, round(CASE WHEN isinf(per_month) THEN 0 ELSE coalesce(per_month, 0) END, 6) AS per_month, round(coalesce(balance, (SELECT median(balance) FROM x)), 6) AS balance FROM x"
)
def final_imputation(spark, d):
    o = t(spark, d, "orders").where("o_custkey % 4 > 0").groupBy("o_custkey").agg(F.count("*").alias("n"))
    k = F.col("c_custkey")
    x = t(spark, d, "customer").join(o, k == F.col("o_custkey"), "left").select("c_custkey", F.col("n").cast("double").alias("order_count"), F.when(k % 7 == 0, float("inf")).when(k % 5 == 0, None).otherwise(F.col("n") / 3).alias("per_month"), F.when(k % 11 > 0, F.col("c_acctbal").cast("double")).alias("balance"))
    out = C.impute_final(x, ["c_custkey"])
    return out.select("c_custkey", "order_count", r6("per_month").alias("per_month"), r6("balance").alias("balance"))


@query("SELECT CAST(l_orderkey AS BIGINT) AS k, CAST(l_linenumber AS INT) AS place, CAST(l_suppkey AS BIGINT) AS v FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey) AS r FROM lineitem) WHERE r <= 2")
def first_rows_of_each(spark, d):
    """The first rows of each group in an order, as comments of each post are cut to a budget."""
    from pyspark.sql import Window as W

    x = t(spark, d, "lineitem").withColumn("r", F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_suppkey", "l_partkey"))).where("r <= 2")
    return x.select(F.col("l_orderkey").cast("long").alias("k"), F.col("l_linenumber").cast("int").alias("place"), F.col("l_suppkey").cast("long").alias("v"))
