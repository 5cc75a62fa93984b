"""Page parsing, keyed writes, the SQLite source, models and streaming on small fixtures."""
import json
import random
import sqlite3
import statistics

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from probity import catalog
from probity.functions import clean
from probity.operators import metrics, models, pages, reports, store
from probity.sources import schema
from probity.sources.sqlite import SqliteReader, SqliteSource, where
from probity.streaming import counters

NOW = 1705320000
POST = """<div class="x PostHeader__contentWrapper y"> <a data-post-id="-5_7"></a><a href="/wall-5_7" class="PostHeaderTime q">5 mar 2021 at 12:30 am</a>
<span class="visually-hidden">post pinned</span><div class="PostContextMenuReactMVK__root" data-exec="{&quot;isCommentsClosed&quot;: true}"></div>
<div class="wi_body"><div class="pi_text">Hello &amp; #tag <span style="display: none">rest</span><a class="PostTextMore">more</a></div><img src="https://i.x/1.png"></div>
<b class="PostBottomButtonReaction__label">1.2K</b><i data-replies-count="3"></i><u class="Socials__viewsCount">3 100</u></div>"""
COMMENT = """<a name="reply{i}" class="ReplyItem__anchor"></a><a class="ReplyItem__name" href="/id{u}">Ann <b>B</b></a><div class="ReplyItem__body">Hi<br>you</div>
<div class="ReplyItem__date"><a class="item_date" href="/wall?reply={i}&amp;thread=3">two hours ago</a></div><a class="ReplyItem__like"> 4 </a>"""


def test_pages(spark):
    df = spark.createDataFrame([(1, "<p>" + POST + POST, 9, NOW), (2, "nothing", 9, NOW), (3, COMMENT.format(i=8, u="77") + COMMENT.format(i=9, u="x") + "Replies.replyTo(a, -5, 9, 55)", 9, NOW)], "page_id int, html string, post_id long, collected_at long")
    (p,) = pages.parse_posts(df).collect()
    assert (p["owner_id"], p["post_id"], p["url"], p["likes"], p["comments"], p["views"], p["reposts"]) == (-5, 7, "/wall-5_7", 1200, 3, 3100, 0)
    assert p["timestamp"] == 1614893400 and p["pinned"] and p["is_comments_closed"] and p["text"].startswith("Hello & #tag") and p["text"].endswith("rest")
    assert p["attachments"]["images"] == ["https://i.x/1.png"] and p["text_features"]["hashtags"] == ["tag"]
    c = {r["comment_id"]: r for r in pages.parse_comments(df).collect()}
    assert set(c) == {8, 9} and c[8]["from_id"] == 77 and c[9]["from_id"] == 55 and c[8]["text"] == "Hi\nyou" and c[8]["likes"] == 4
    assert c[8]["timestamp"] == NOW - 7200 and c[8]["reply_to_comment_id"] == 3 and c[8]["author_name"] == "Ann B"


def test_sqlite_filters(spark, tmp_path):
    path = str(tmp_path / "f.sqlite")
    rows = [(i, None if i % 7 == 0 else i % 5, f"t{i % 3}", i % 2) for i in range(300)]
    with sqlite3.connect(path) as c:
        c.execute("CREATE TABLE comments (id INTEGER PRIMARY KEY, likes INTEGER, text TEXT, is_deleted BOOLEAN)")
        c.executemany("INSERT INTO comments VALUES (?, ?, ?, ?)", rows)
    asked = where(("likes", ">", 2), ("text", "in", ["t1", "t2"]), ("is_deleted", "=", False), ("likes", "is not null"))
    schema_ = "id long, likes long, text string, is_deleted boolean"
    reader = SqliteReader(StructType.fromDDL(schema_), {"path": path, "table": "comments", "where": asked})
    read = [r for p in reader.partitions() for r in reader.read(p)]
    want = [(i, k, x, bool(y)) for i, k, x, y in rows if k is not None and k > 2 and x in ("t1", "t2") and not y]
    assert sorted(read) == want and len(want) < 40
    spark.dataSource.register(SqliteSource)
    load = lambda w: spark.read.format("sqlite_table").schema(schema_).option("path", path).option("table", "comments").option("where", w).load()
    df = load(asked)
    assert sorted(tuple(r) for r in df.collect()) == want and df.where("likes = 4").count() == sum(r[1] == 4 for r in want) and df.count() == len(want)
    assert load(where(("likes", "is null"))).count() == sum(r[1] is None for r in rows) and load(where()).count() == 300
    for bad in (("a;b", "=", 1), ("a", "like", "x"), ("a", "=", None), ("a", "in", []), ("a", "is null", 1), ("a", "=")):
        with pytest.raises(ValueError):
            where(bad)


def test_quantiles_of_groups(spark):
    rng = random.Random(2)
    rows = [("hot", rng.choice([rng.random(), 0.5])) for _ in range(3000)] + [("few", float(i)) for i in range(7)] + [(None, float(i * i)) for i in range(25)] + [("none", None)] * 3
    got = {r["g"]: (r["n"], r["p50"], r["p90"]) for r in reports.tenths(spark.createDataFrame(rows, "g string, v double"), ["g"], "v").collect()}
    for g in ("hot", "few", None, "none"):
        x = [v for k, v in rows if k == g and v is not None]
        p90 = statistics.quantiles(x, n=10)[8] if len(x) >= 10 else max(x or [0.0])
        assert got[g] == (len(x), pytest.approx(statistics.median(x) if x else 0.0), pytest.approx(p90))
    (one,) = reports.tenths(spark.createDataFrame(rows, "g string, v double"), [], "v").collect()
    every = [v for _, v in rows if v is not None]
    assert (one["n"], one["p50"], one["p90"]) == (len(every), pytest.approx(statistics.median(every)), pytest.approx(statistics.quantiles(every, n=10)[8]))


def test_local_clustering_graph_keeps_ids(spark, tmp_path):
    # hub 1000 meets all; ids beyond 100 stay apart, and so do sparse neighbourhoods
    edges = {(1000, k) for k in range(1, 301)} | {(k, k + 100) for k in range(1, 201)} | {(k, 1000) for k in range(1, 301, 7)} | {(5, 5), (5, 205), (105, 205)}
    rows = sorted(edges)
    spark.createDataFrame([(i, c) for i, (c, _) in enumerate(rows)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(i, p) for i, (_, p) in enumerate(rows)] * 2, "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    out = {r["src"]: r for r in catalog.QUERIES["local_clustering_graph"](spark, str(tmp_path)).collect()}
    assert set(out) == {c for c, _ in edges}
    for v, r in out.items():
        near = [b for a, b in rows if a == v]
        links = sum((a, b) in edges for a in near for b in near if a != b)
        want = links / (len(near) * (len(near) - 1)) if len(near) > 1 else 0.0
        assert r["neighbour_count"] == len(near) and r["local_clustering"] == pytest.approx(want, abs=1e-6) and r["suspicious_low_clustering"] == (want < 0.1)


def test_profile_bundle(spark):
    cache = [{"method": "users.get", "response": [{"id": 5, "first_name": "A]", "verified": 1, "counters": {"friends": 3, "albums": "2"}, "schools": [{"id": 1, "name": "S"}], "contacts": {"mobile_phone": "1"}}]}, {"method": "friends.get", "response": {"count": 9, "items": [{"id": 6, "first_name": "F"}]}}]
    df = spark.createDataFrame([(1, f'<script>x({{"apiPrefetchCache":{json.dumps(cache)},"z":1}})</script>'), (2, "no")], "page_id int, html string")
    b = pages.profile_bundles(df)
    (r,) = b.collect()
    assert r["profile"]["user_id"] == 5 and r["profile"]["first_name"] == "A]" and r["profile"]["verified"] and r["profile"]["about"] == "" and r["profile"]["mobile_phone"] == "1"
    assert r["counters"]["friends"] == 9 and r["counters"]["albums"] == 2
    assert [x["id"] for x in pages.children(b, "friends_sample").collect()] == [6]


def test_store(spark):
    ddl = schema.DDL["comments"]
    blank = {f.split()[0]: None for f in ddl.split(", ")}
    row = lambda **k: tuple((blank | k).values())
    old = spark.createDataFrame([row(id=1, owner_id=1, post_id=1, comment_id=1, text="old", likes=3, timestamp=5)], ddl)
    new = spark.createDataFrame([(*row(owner_id=1, post_id=1, comment_id=1, timestamp=7), 1), (*row(owner_id=1, post_id=1, comment_id=2, text="a"), 2), (*row(owner_id=1, post_id=1, comment_id=2, text="b"), 3), (*row(owner_id=1, comment_id=4), 4)], ddl + ", _seq int")
    posts = spark.createDataFrame([(70, 1, 1)], "id long, owner_id long, post_id long")
    once = store.save_comments(old, new, posts)
    got = {r["comment_id"]: r for r in once.collect()}
    assert set(got) == {1, 2} and got[1]["text"] is None and got[1]["likes"] == 3 and got[1]["timestamp"] == 7 and got[2]["text"] == "b" and got[1]["post_row_id"] == 70
    again = store.save_comments(once, new, posts)
    assert sorted(map(str, again.collect())) == sorted(map(str, once.collect()))
    kept = store.replace_children(spark.createDataFrame([(1, "a"), (2, "b")], "p int, t string"), spark.createDataFrame([(1, "c")], "p int, t string"), "p")
    assert sorted(map(tuple, kept.collect())) == [(1, "c"), (2, "b")]
    assert spark.createDataFrame([([" B", "b", "", "a"],)], "x array<string>").select(store.tags(F.col("x"))).first()[0] == ["a", "b"]


def test_sqlite(spark, tmp_path):
    path = str(tmp_path / "x.db")
    with sqlite3.connect(path) as c:
        c.execute("create table comments (id integer primary key, text text, is_deleted boolean)")
        c.executemany("insert into comments values (?, ?, ?)", [(i, f"t{i}", i % 2) for i in range(1, 101)])
    spark.dataSource.register(SqliteSource)
    df = spark.read.format("sqlite_table").schema("id long, text string, is_deleted boolean").option("path", path).option("table", "comments").option("partitions", 3).load()
    assert df.count() == 100 and df.where("is_deleted").count() == 50 and df.rdd.getNumPartitions() == 3


@pytest.fixture(scope="module")
def scored(spark):
    return spark.range(400).select("id", F.col("id").alias("user_id"), F.when(F.col("id") % 10 == 0, -1).when(F.col("id") % 4 == 0, 1).otherwise(0).alias("target_is_bot"), ((F.col("id") % 4 == 0).cast("double") + (F.col("id") * 7 % 11) / 15).alias("a"), (F.col("id") % 3).cast("double").alias("b"))


def test_models(scored):
    x = metrics.stratified_split(models.labelled(scored), "label", "id")
    shares = [r["s"] for r in x.groupBy("label").agg(F.avg(F.col("is_test").cast("int")).alias("s")).collect()]
    assert len(shares) == 2 and all(abs(s - 0.2) < 0.01 for s in shares)
    names = models.feature_names(scored)
    assert names == ["a", "b"]
    make = models.classifiers()["logistic_regression"]
    scorer = models.calibrated(x.where("not is_test"), make, names, k=2)
    m = models.evaluate(scorer(x.where("is_test")))
    assert m["roc_auc"] > 0.95 and 0 <= m["brier"] < 0.2
    out = models.predict(scorer, scored, 0.5)
    assert out.columns == ["id", "user_id", "bot_probability", "predicted_bot"] and out.count() == 40
    assert models.correlations(x, names)[0][0] == "a"


def test_imputation(spark):
    df = spark.createDataFrame([(1, 1.0, None, float("inf")), (2, None, 2.0, 1.0), (3, 3.0, None, float("nan"))], "id int, days double, x_rate double, f_score double")
    assert [tuple(r) for r in clean.impute_advanced(df, ["id"]).orderBy("id").collect()] == [(1, 1.0, 0.0, 0.0), (2, 2.0, 2.0, 1.0), (3, 3.0, 0.0, 0.0)]


def test_streaming(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([(1, "2024-01-01 00:00:10"), (1, "2024-01-01 00:00:50"), (1, "2024-01-01 00:01:10"), (2, "2024-01-01 00:00:10")], "user long, s string").select("user", F.to_timestamp("s").alias("ts")).write.parquet(src)
    stream = spark.readStream.schema("user long, ts timestamp").parquet(src)
    q = counters.rate_per_minute(stream, "ts", "user").writeStream.format("memory").queryName("rates").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r["user"], r["n"]) for r in spark.table("rates").collect()) == [(1, 1), (1, 2), (2, 1)]


def test_profile_pages_are_read_once(spark):
    """The condition on the user isn't pushed below the parsed JSON, where all of it would be parsed again."""
    from probity.operators import pages as G

    pages = spark.createDataFrame([("a", '<script>{"apiPrefetchCache":[{"method":"users.get","response":[{"id":7,"status":"x"}]}]}</script>'), ("b", "none"), ("c", '"apiPrefetchCache":[{"method":"users.get","response":[]}]'), ("d", '"apiPrefetchCache":[{]')], "page_id string, html string")
    bundles, problems = G.profile_bundles(pages), G.profile_problems(pages)
    assert [(r["page_id"], r["profile"]["user_id"], r["profile"]["status"]) for r in bundles.collect()] == [("a", 7, "x")]
    assert {r["page_id"]: r["reason"] for r in problems.collect()} == {"b": "no responses", "c": "no user", "d": "broken JSON"}
    for df in (bundles, problems):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("(?s)(?:(?i)") == 1
