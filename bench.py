"""Times the headline queries: one JSON line. BENCH_SF_DIR and BENCH_CPUS choose the data and the cores."""
import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from probity import catalog

HEADLINE = [
    "comment_text_features", "text_entropy_by_doc", "trigram_stats", "hapax_function_words", "mattr_50", "sentence_stats", "spam_keyword_presence", "comment_intervals", "hour_entropy_activity", "sliding_60s_rate",
    "conditional_rates", "span_and_completeness", "group_popularity", "follower_jaccard", "local_clustering", "reciprocity", "upsert_merge", "strip_html", "threshold_grid", "roc_auc_rank",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.local.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    catalog.QUERIES["conditional_rates"](spark, sf).write.format("noop").mode("overwrite").save()  # starts the JVM's threads
    for name in HEADLINE:
        began = time.perf_counter()
        catalog.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf.rstrip("/").rpartition("sf")[2]}))


if __name__ == "__main__":
    main()
