"""Queries that write: batches in transactions, the landing job, a stream with keyed state. Each reads back what
it has stored below spark.checkpoint.dir."""
from __future__ import annotations

from pyspark.sql import functions as F

from probity.operators import batches as B
from probity.plans import landed_queries as L
from probity.plans import landing
from probity.plans.stored import with_stored
from probity.sources import scratch
from probity.sources.tables import Tables
from probity.streaming import counters

QUERIES, SQL = {}, {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return keep


CHILDREN = "CAST({} AS STRUCT<hashtags: ARRAY<STRING>, mentions: ARRAY<STRING>, urls: ARRAY<STRING>>) AS text_features"


@query(
    L.BATCHES + "SELECT owner_id, post_id, CASE WHEN coalesce(n.url, '') <> '' THEN n.url ELSE o.url END AS url, coalesce(n.date_text, o.date_text) AS date_text, CASE WHEN coalesce(n.timestamp, 0) <> 0 THEN n.timestamp ELSE o.timestamp END AS timestamp, coalesce(n.text, o.text) AS text, coalesce(n.likes, o.likes, 0) AS likes, coalesce(n.views, o.views, 0) AS views, "
    "coalesce(n.pinned, o.pinned) AS pinned, CASE WHEN coalesce(n.collected_at, 0) <> 0 THEN n.collected_at ELSE o.collected_at END AS collected_at, CASE WHEN n.post_id IS NULL THEN 'old' || post_id % 3 ELSE 'new' || post_id % 4 END AS tags FROM old o FULL JOIN new n USING (owner_id, post_id)"
)
def stored_posts(spark, d):
    """An older batch, one that never commits, a newer batch, and the newer batch once more."""
    o = L.t(spark, d, "orders")
    none = F.lit(None).cast("struct<images:array<string>,videos:array<string>,outlinks:array<string>>")
    tags = lambda word, k: F.struct(F.array(F.concat(F.upper(F.lit(word)), F.col("post_id") % k), F.concat(F.lit(word), F.col("post_id") % k)).alias("hashtags"), F.array().cast("array<string>").alias("mentions"), F.array().cast("array<string>").alias("urls"))
    old = spark.sql(L.OLD_POSTS, orders=o).drop("id").withColumns({"_seq": F.lit(1), "attachments": none, "text_features": tags("old", 3)})
    new = spark.sql(L.NEW_POSTS, orders=o).withColumns({"attachments": none, "text_features": tags("new", 4)})
    store = Tables(spark, scratch.folder(spark, "posts"), buckets=8)
    for batch, rows, ends in ((1, old, True), (2, new.withColumn("url", F.lit("lost")), False), (2, new, True), (2, new.withColumn("text", F.lit("twice")), True)):
        tx = store.begin("posts", batch)
        if tx is not None:
            B.put_posts(tx, rows)
            if ends:
                tx.commit()
    tag = store.read("post_hashtags").select(F.col("post_id").alias("id"), F.col("tag").alias("tags"))
    return store.read("posts").join(tag, "id").select("owner_id", "post_id", "url", "date_text", "timestamp", "text", "likes", "views", "pinned", "collected_at", "tags")


@query("")
def landed_store(spark, d):
    """Pages of posts, comments and profiles, landed in two parts, taken by two calls of the job."""
    place = scratch.folder(spark, "landing")
    pages = None
    for kind, rows in (("posts", L.post_pages(spark, d)), ("comments", L.comment_pages(spark, d)), ("profile", L.profile_pages(spark, d).withColumn("collected_at", F.lit(L.NOW).cast("long")))):
        have = {"kind": F.lit(kind), "owner_id": F.lit(-5 if kind == "comments" else None).cast("long"), "user_id": F.lit(None).cast("long"), "post_id": F.lit(9 if kind == "comments" else None).cast("long"), "page_id": F.col("page_id").cast("string")}
        rows = rows.withColumns(have).select("kind", "page_id", "owner_id", "post_id", "user_id", "html", "collected_at")
        pages = rows if pages is None else pages.unionByName(rows)
    store = Tables(spark, f"{place}/store", buckets=4)
    for part in (0, 1):
        pages.where(F.pmod(F.crc32(F.col("page_id").cast("binary")), F.lit(2)) == part).write.mode("append").parquet(f"{place}/pages")
        landing.run(spark, f"{place}/pages", store, f"{place}/stream")
    said = lambda n: store.read(n)
    posts = said("posts").select(F.lit("posts").alias("of"), F.col("post_id").alias("key"), "text", "likes", "timestamp")
    comments = said("comments").select(F.lit("comments").alias("of"), F.col("comment_id").alias("key"), "text", "likes", "timestamp")
    profiles = said("profiles").join(said("profile_counters").select(F.col("profile_id").alias("id"), "friends"), "id").select(F.lit("profiles").alias("of"), F.col("user_id").alias("key"), F.col("status").alias("text"), F.col("friends").alias("likes"), F.col("last_seen_ts").alias("timestamp"))
    return posts.unionByName(comments).unionByName(profiles)


def _of(name: str, columns: str) -> str:
    return f"SELECT {columns} FROM ({L.SQL[name]}) x"


SQL["landed_store"] = with_stored(
    "profiles profile_counters",
    " " + " UNION ALL ".join([_of("landed_posts", "'posts' AS \"of\", post_id AS key, text, likes, timestamp"), _of("landed_comments", "'comments', comment_id, text, likes, timestamp"), "SELECT 'profiles', user_id, coalesce(status, ''), friends, last_seen_ts FROM profiles LEFT JOIN profile_counters c ON c.profile_id = profiles.id"]),
)


@query("SELECT user_id, t AS second, count(*) AS events, max(n) AS n FROM (SELECT user_id, t, count(*) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN 60 PRECEDING AND CURRENT ROW) AS n FROM (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL)) GROUP BY 1, 2")
def trailing_rate_stream(spark, d):
    """Events come in four parts, up to five minutes out of order; one far later event moves the watermark on."""
    place = scratch.folder(spark, "trailing")
    e = L.t(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id").where("ts is not null")
    first, last = e.agg(F.min("ts"), F.max("ts")).first()
    shifted = F.unix_timestamp("ts") + F.pmod(F.xxhash64("event_id"), F.lit(300))
    part = F.least(F.lit(3), F.floor((shifted - F.lit(int(first.timestamp()))) * 4 / F.lit(max(1, int(last.timestamp() - first.timestamp())))))
    end = e.limit(0).unionByName(spark.createDataFrame([(None, last)], "user_id long, ts timestamp").select(F.lit(-1).cast(e.schema["user_id"].dataType).alias("user_id"), (F.col("ts") + F.expr("interval 1 day")).alias("ts"), F.lit(-1).cast("long").alias("event_id")))
    was = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", counters.ROCKSDB)
    try:
        for rows in [*(e.where(part == k) for k in range(4)), end]:
            rows.select("user_id", "ts").write.mode("append").parquet(f"{place}/in")
            stream = spark.readStream.schema(rows.select("user_id", "ts").schema).parquet(f"{place}/in")
            told = counters.trailing_count(stream, "ts", "user_id")
            told.writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", was) if was else spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    return spark.read.parquet(f"{place}/out")
