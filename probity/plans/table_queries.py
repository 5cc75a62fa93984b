"""Queries over the star schema, pages and labels: joins, rates, graphs, parsing, model measures."""
from __future__ import annotations

from pyspark.sql import functions as F

from probity.functions import clean as C
from probity.functions import parse as P
from probity.operators import graph as G
from probity.operators import metrics as M
from probity.plans.text_queries import r6

QUERIES, SQL = {}, {}
AS_OF = "2024-02-01"


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


@query(
    "SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(CASE WHEN l_discount > 0.05 THEN 1.0 ELSE 0.0 END), 6) AS discount_rate, sum(CASE WHEN l_tax > 0.04 THEN 1 ELSE 0 END)::BIGINT AS taxed, round(coalesce(sum(CASE WHEN l_quantity > 25 THEN l_quantity - 25 END), 0), 2) AS above FROM lineitem GROUP BY 1, 2"
)
def conditional_rates(spark, d):
    return t(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n"), r6(F.avg(F.when(F.col("l_discount") > 0.05, 1.0).otherwise(0.0))).alias("discount_rate"), F.count_if(F.col("l_tax") > 0.04).alias("taxed"),
        F.round(F.coalesce(F.sum(F.when(F.col("l_quantity") > 25, F.col("l_quantity") - 25)), F.lit(0)), 2).alias("above"),
    )


SPAN = """WITH o AS (SELECT o_custkey AS k, count(*) AS orders, date_diff('day', min(CAST(o_orderdate AS DATE)), max(CAST(o_orderdate AS DATE))) AS span_days, (count(o_orderstatus) + count(o_orderpriority)) / (2.0 * count(*)) AS completeness FROM orders GROUP BY 1),
l AS (SELECT l_suppkey AS k, count(*) AS lines, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS returned FROM lineitem GROUP BY 1), c AS (SELECT c_custkey AS k, 1 AS known FROM customer WHERE c_acctbal > 5000)
SELECT k, coalesce(orders, 0) AS orders, coalesce(span_days, 0) AS span_days, round(coalesce(completeness, 0), 6) AS completeness, coalesce(lines, 0) AS lines, CAST(coalesce(returned, 0) AS BIGINT) AS returned, CAST(3 * (coalesce(orders, 0) > 0)::INT + 2 * (coalesce(lines, 0) > 0)::INT + 2 * (coalesce(known, 0) > 0)::INT AS INT) AS score FROM o FULL JOIN l USING (k) FULL JOIN c USING (k)"""


@query(SPAN)
def span_and_completeness(spark, d):
    day = F.to_date("o_orderdate")
    o = t(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("orders"), F.date_diff(F.max(day), F.min(day)).cast("long").alias("span_days"), ((F.count("o_orderstatus") + F.count("o_orderpriority")) / (2 * F.count("*"))).alias("completeness"))
    li = t(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(F.count("*").alias("lines"), F.count_if(F.col("l_returnflag") == "R").alias("returned"))
    c = t(spark, d, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("k"), F.lit(1).alias("known"))
    x = o.join(li, "k", "full").join(c, "k", "full").na.fill(0)
    score = 3 * (F.col("orders") > 0).cast("int") + 2 * (F.col("lines") > 0).cast("int") + 2 * (F.col("known") > 0).cast("int")
    return x.select("k", "orders", "span_days", r6("completeness").alias("completeness"), "lines", "returned", score.alias("score"))


CP = "(SELECT DISTINCT o_custkey AS c, l_partkey AS p FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"


def customer_parts(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c"))
    return o.join(t(spark, d, "lineitem").select("l_orderkey", F.col("l_partkey").alias("p")), F.col("o_orderkey") == F.col("l_orderkey")).select("c", "p")


@query(f"WITH m AS {CP}, q AS (SELECT p, count(*) AS pop FROM m GROUP BY 1) SELECT c, count(*) AS subscription_count, round(avg(pop), 6) AS avg_group_popularity, round(CAST(median(pop) AS DOUBLE), 6) AS median_group_popularity, round(avg(pop) - 1, 6) AS avg_group_overlap, CASE WHEN avg(pop) < 10 OR avg(pop) > 100000 THEN 1 ELSE 0 END AS extreme_group_popularity FROM m JOIN q USING (p) GROUP BY 1")
def group_popularity(spark, d):
    out = G.group_popularity(customer_parts(spark, d), "c", "p")
    return out.select("c", "subscription_count", *[r6(x).alias(x) for x in ("avg_group_popularity", "median_group_popularity", "avg_group_overlap")], "extreme_group_popularity")


@query(f"WITH m AS {CP}, g AS (SELECT c, count(*) AS deg FROM m GROUP BY 1) SELECT p, count(*) AS follower_sample_size, round(avg(deg), 6) AS follower_avg_out_degree, round(CAST(median(deg) AS DOUBLE), 6) AS follower_median_out_degree, round(avg(CASE WHEN deg = 0 THEN 1.0 ELSE 0.0 END), 6) AS follower_zero_out_degree_rate FROM m JOIN g USING (c) GROUP BY 1")
def out_degree_stats(spark, d):
    out = G.out_degree_stats(customer_parts(spark, d), "p", "c")
    return out.select("p", "follower_sample_size", *[r6(x).alias(x) for x in ("follower_avg_out_degree", "follower_median_out_degree", "follower_zero_out_degree_rate")])


@query(
    f"WITH m AS {CP}, g AS (SELECT c, count(*) AS deg FROM m GROUP BY 1), q AS (SELECT x.p, x.c AS a, y.c AS b FROM m x JOIN m y ON x.p = y.p AND x.c < y.c), k AS (SELECT a, b, count(*) AS k FROM q GROUP BY 1, 2), "
    "j AS (SELECT a, b, k / CAST(ga.deg + gb.deg - k AS DOUBLE) AS j FROM k JOIN g ga ON a = ga.c JOIN g gb ON b = gb.c), s AS (SELECT p, sum(j) AS s FROM q JOIN j USING (a, b) GROUP BY 1), n AS (SELECT p, count(*) AS n FROM m GROUP BY 1) "
    "SELECT p, round(CASE WHEN n >= 2 THEN coalesce(s, 0) / (n * (n - 1) / 2.0) ELSE 0.0 END, 6) AS avg_follower_similarity FROM n LEFT JOIN s USING (p)"
)
def follower_jaccard(spark, d):
    return G.mean_pair_jaccard(customer_parts(spark, d), "p", "c").select("p", r6("avg_follower_similarity").alias("avg_follower_similarity"))


CLUSTERING = (
    f"WITH e AS (SELECT DISTINCT {{}} FROM {CP}), k AS (SELECT src, count(*) AS n FROM e GROUP BY 1), l AS (SELECT x.src AS v, count(*) AS links FROM e x JOIN e y ON x.dst = y.src AND x.dst <> y.dst JOIN e z ON z.src = x.src AND z.dst = y.dst GROUP BY 1) "
    "SELECT src, n AS neighbour_count, round(CASE WHEN n >= 2 THEN coalesce(links, 0) / CAST(n * (n - 1) AS DOUBLE) ELSE 0.0 END, 6) AS local_clustering, CASE WHEN (CASE WHEN n >= 2 THEN coalesce(links, 0) / CAST(n * (n - 1) AS DOUBLE) ELSE 0.0 END) < 0.1 THEN 1 ELSE 0 END AS suspicious_low_clustering FROM k LEFT JOIN l ON src = v"
)


@query(CLUSTERING.format("p AS src, c AS dst"))
def local_clustering(spark, d):
    """From parts to customers; a part and a customer of the same number are one node."""
    e = customer_parts(spark, d).select(F.col("p").alias("src"), F.col("c").alias("dst"))
    return G.local_clustering(e).withColumn("local_clustering", r6("local_clustering"))


@query(CLUSTERING.format("c AS src, p AS dst"))
def local_clustering_graph(spark, d):
    """From customers to parts, likewise."""
    e = customer_parts(spark, d).select(F.col("c").alias("src"), F.col("p").alias("dst"))
    return G.local_clustering(e).withColumn("local_clustering", r6("local_clustering"))


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def anti_join_missing(spark, d):
    o = t(spark, d, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return t(spark, d, "customer").join(o, "c_custkey", "left_anti").select("c_custkey", "c_name")


@query("SELECT c_custkey, n_name, r_name, coalesce(orders, 0) AS orders, round(coalesce(total, 0), 2) AS total FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey LEFT JOIN (SELECT o_custkey, count(*) AS orders, sum(o_totalprice) AS total FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def left_join_assembly(spark, d):
    o = t(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("orders"), F.sum("o_totalprice").alias("total"))
    x = t(spark, d, "customer").join(t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left").join(t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left").join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    return x.select("c_custkey", "n_name", "r_name", F.coalesce("orders", F.lit(0)).alias("orders"), F.round(F.coalesce("total", F.lit(0.0)), 2).alias("total"))


@query("SELECT c_custkey, orders FROM customer LEFT JOIN (SELECT row_number() OVER (ORDER BY o_custkey) - 1 AS pos, count(*) AS orders FROM orders GROUP BY o_custkey) ON c_custkey = pos")
def positional_join_compat(spark, d):
    """The compat form of the social join: a profile id meets the row at that 0-based position."""
    o = t(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("orders"))
    o = M.running(o.withColumn("one", F.lit(1)), "o_custkey", ["one"]).withColumnRenamed("before_one", "pos")
    return t(spark, d, "customer").join(o, F.col("c_custkey") == F.col("pos"), "left").select("c_custkey", "orders")


@query("SELECT o_orderkey, CAST(CASE WHEN o_orderdate IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY CAST(o_orderdate AS DATE)) END AS BIGINT) AS same_day FROM orders")
def same_day_window(spark, d):
    day = F.to_date("o_orderdate")
    o = t(spark, d, "orders").select("o_orderkey", day.alias("day"))
    return o.join(o.groupBy("day").agg(F.count("*").alias("same_day")), "day", "left").select("o_orderkey", F.coalesce("same_day", F.lit(0)).alias("same_day"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def topk_desc(spark, d):
    return t(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100).select("o_orderkey", "o_totalprice")


@query(
    "WITH x AS (SELECT doc_id, CAST(n_chars AS DOUBLE) AS chars, CAST(quality AS DOUBLE) AS quality, CASE WHEN toxic = 1 THEN 1.0e0 END AS toxic_rate FROM documents LEFT JOIN labels USING (doc_id)) "
    "SELECT doc_id, chars, coalesce(quality, (SELECT median(quality) FROM x)) AS quality, coalesce(toxic_rate, 0.0e0) AS toxic_rate FROM x"
)
def median_imputation(spark, d):
    x = t(spark, d, "documents").join(t(spark, d, "labels"), "doc_id", "left").select("doc_id", F.col("n_chars").cast("double").alias("chars"), F.col("quality").cast("double").alias("quality"), F.when(F.col("toxic") == 1, 1.0).alias("toxic_rate"))
    return C.impute_advanced(x, skip=["doc_id"])


@query(
    "WITH x AS (SELECT c_custkey, coalesce(n, 0) AS friends, coalesce(b, 0) AS followers FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS b FROM orders GROUP BY 1) ON o_custkey = c_custkey) "
    "SELECT c_custkey, followers = 0 AS infinite, CASE WHEN followers > 0 THEN round(friends / CAST(followers AS DOUBLE), 6) ELSE 0.0 END AS ff_ratio, CASE WHEN followers = 0 OR friends / CAST(followers AS DOUBLE) > 10 OR friends / CAST(followers AS DOUBLE) < 0.1 THEN 1 ELSE 0 END AS ff_ratio_extreme FROM x"
)
def inf_ratio_flags(spark, d):
    o = t(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("friends"), F.count_if(F.col("o_orderstatus") == "F").alias("followers"))
    x = t(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").na.fill(0, ["friends", "followers"])
    r = C.friend_ratio(F.col("friends"), F.col("followers"))
    return x.select("c_custkey", (r == float("inf")).alias("infinite"), r6(F.coalesce(C.finite(r), F.lit(0.0))).alias("ff_ratio"), F.when((r > 10) | (r < 0.1), 1).otherwise(0).alias("ff_ratio_extreme"))


@query("SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS y, CAST(month(o_orderdate) AS INT) AS m, CAST(isodow(o_orderdate) - 1 AS INT) AS dow, CAST(hour(o_orderdate) AS INT) AS h, CASE WHEN hour(o_orderdate) BETWEEN 2 AND 6 THEN 1 ELSE 0 END AS night FROM orders")
def date_parts(spark, d):
    c = F.col("o_orderdate")
    return t(spark, d, "orders").select("o_orderkey", F.year(c).alias("y"), F.month(c).alias("m"), F.weekday(c).alias("dow"), F.hour(c).alias("h"), F.when(F.hour(c).between(2, 6), 1).otherwise(0).alias("night"))


@query(
    f"WITH x AS (SELECT o_custkey, min(CAST(o_orderdate AS DATE)) AS reg, count(*) AS n FROM orders GROUP BY 1), y AS (SELECT c_custkey, n, date_diff('day', reg, DATE '{AS_OF}') AS age, count(*) OVER (PARTITION BY reg) AS k, reg FROM customer LEFT JOIN x ON o_custkey = c_custkey) "
    "SELECT c_custkey, age AS account_age_days, round(CASE WHEN age > 0 THEN n / CAST(age AS DOUBLE) ELSE 0.0 END, 6) AS activity_per_day, CASE WHEN reg IS NULL THEN 0 ELSE k END AS accounts_registered_same_day FROM y"
)
def account_age_temporal(spark, d):
    o = t(spark, d, "orders").groupBy("o_custkey").agg(F.min(F.to_date("o_orderdate")).alias("reg"), F.count("*").alias("n"))
    x = t(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    same = x.where("reg is not null").groupBy(F.col("reg").alias("day")).agg(F.count("*").alias("k"))
    age = F.date_diff(F.lit(AS_OF).cast("date"), F.col("reg")).cast("long")
    x = x.join(same, F.col("reg") == F.col("day"), "left").withColumn("age", age)
    return x.select("c_custkey", F.col("age").alias("account_age_days"), r6(F.when(F.col("age") > 0, F.col("n") / F.col("age")).otherwise(0.0)).alias("activity_per_day"), F.coalesce("k", F.lit(0)).alias("accounts_registered_same_day"))


@query(
    r"SELECT page_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<\s*br\s*/?\s*>', chr(10), 'gi'), '<[^>]+>', '', 'g'), '[ \t\r\f\v]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^[\s\v\x{1C}-\x{1F}\x{85}\p{Z}]+|[\s\v\x{1C}-\x{1F}\x{85}\p{Z}]+$', '', 'g')) AS text_md5 FROM pages"
)
def strip_html(spark, d):
    return t(spark, d, "pages").select("page_id", F.md5(P.strip_tags(F.col("html"), entities=False)).alias("text_md5"))


@query()
def strip_html_entities(spark, d):
    s = P.strip_tags(F.col("html"))
    return t(spark, d, "pages").select("page_id", s.alias("text"))


@query(r"""SELECT page_id, array_to_string(regexp_extract_all(html, 'href="([^"]*)"', 1), ' ') AS hrefs, CAST(len(regexp_extract_all(html, '<img[^>]+src="(https?://[^"]+)"', 1)) AS INT) AS images, array_to_string(regexp_extract_all(html, 'https?://[^\s)]+'), ' ') AS urls FROM pages""")
def extract_links_images(spark, d):
    h = F.col("html")
    return t(spark, d, "pages").select("page_id", F.array_join(F.regexp_extract_all(h, F.lit(P.HREF), F.lit(1)), " ").alias("hrefs"), F.size(P.attachments(h)["images"]).alias("images"), F.array_join(P.features_in_text(h)["urls"], " ").alias("urls"))


SCORED = "(SELECT doc_id, quality AS y, ((doc_id * 37) % 101) / 101.0 * 0.5 + quality * 0.3 AS s FROM labels WHERE quality IS NOT NULL)"


def scored(spark, d):
    """A deterministic score that goes with the label."""
    return t(spark, d, "labels").where("quality is not null").select("doc_id", F.col("quality").alias("y"), ((F.col("doc_id") * 37 % 101) / F.lit(101.0) * 0.5 + F.col("quality") * 0.3).alias("s"))


@query(
    f"WITH g AS (SELECT CAST(i AS INT) AS i, 0.05e0 + i * ((0.95e0 - 0.05e0) / 49) AS h FROM range(50) r(i)), c AS (SELECT i, h, count(*) FILTER (s >= h AND y = 1) AS tp, count(*) FILTER (s >= h) AS pp, count(*) FILTER (y = 1) AS ap FROM g, (SELECT y, CAST(s AS DOUBLE) AS s FROM {SCORED}) GROUP BY 1, 2), "
    "p AS (SELECT i, h, CASE WHEN pp > 0 THEN tp / CAST(pp AS DOUBLE) ELSE 0.0 END AS precision, CASE WHEN ap > 0 THEN tp / CAST(ap AS DOUBLE) ELSE 0.0 END AS recall FROM c) "
    "SELECT round(h, 6) AS threshold, round(precision, 6) AS precision, round(recall, 6) AS recall, round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END, 6) AS f1 FROM p"
)
def threshold_grid(spark, d):
    g = M.threshold_grid(scored(spark, d).withColumn("s", F.col("s").cast("double")), "y", "s")
    return g.select(*[r6(c).alias(c) for c in ("threshold", "precision", "recall", "f1")])


@query(f"SELECT count(*) FILTER (y = 1 AND s >= 0.5) AS tp, count(*) FILTER (y = 0 AND s >= 0.5) AS fp, count(*) FILTER (y = 1 AND s < 0.5) AS fn, count(*) FILTER (y = 0 AND s < 0.5) AS tn, round(avg(CASE WHEN (y = 1) = (s >= 0.5) THEN 1.0 ELSE 0.0 END), 6) AS accuracy, round(avg(pow(s - y, 2)), 6) AS brier FROM {SCORED}")
def brier_confusion(spark, d):
    out = M.confusion(scored(spark, d), "y", "s")
    return out.select("tp", "fp", "fn", "tn", r6("accuracy").alias("accuracy"), r6("brier").alias("brier"))


@query(f"WITH x AS (SELECT y, s, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS r FROM {SCORED}) SELECT round((sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)), 6) AS roc_auc, count(*) FILTER (y = 1) AS positives, count(*) FILTER (y = 0) AS negatives FROM x")
def roc_auc_rank(spark, d):
    return M.roc_auc(scored(spark, d), "y", "s").select(r6("roc_auc").alias("roc_auc"), "positives", "negatives")


@query(f"WITH x AS (SELECT s, count(*) AS n, count(*) FILTER (y = 1) AS p FROM {SCORED} GROUP BY 1), c AS (SELECT p, sum(p) OVER (ORDER BY s DESC) / CAST(sum(n) OVER (ORDER BY s DESC) AS DOUBLE) AS prec FROM x) SELECT round(sum(prec * p) / sum(p), 6) AS average_precision FROM c")
def average_precision(spark, d):
    return M.average_precision(scored(spark, d), "y", "s").select(r6("average_precision").alias("average_precision"))


@query("SELECT quality, CAST(round(count(*) * 0.2) AS BIGINT) AS test_rows, CAST(count(*) - round(count(*) * 0.2) AS BIGINT) AS train_rows FROM labels GROUP BY 1")
def stratified_split_counts(spark, d):
    s = M.stratified_split(t(spark, d, "labels"), "quality", "doc_id")
    return s.groupBy("quality").agg(F.count_if("is_test").alias("test_rows"), F.count_if(~F.col("is_test")).alias("train_rows"))


NUMERIC = r"(SELECT doc_id, n_chars AS a, CAST(len(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS BIGINT) AS b FROM documents)"


@query(f"SELECT round(corr(ra, rb), 6) AS spearman, round((SELECT corr(a, b) FROM {NUMERIC}), 6) AS pearson FROM (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS rb FROM {NUMERIC})")
def spearman_corr(spark, d):
    from probity.functions.text import words

    x = t(spark, d, "documents").select("doc_id", F.col("n_chars").alias("a"), F.size(words(F.col("text"))).cast("long").alias("b"))
    pearson = x.agg(F.corr("a", "b").alias("pearson"))
    ranks = M.average_ranks(x, ["a", "b"], "doc_id").agg(F.corr("r_a", "r_b").alias("spearman"))
    return ranks.crossJoin(pearson).select(r6("spearman").alias("spearman"), r6("pearson").alias("pearson"))  # a row each
