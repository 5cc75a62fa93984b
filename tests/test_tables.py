"""The versioned store: all or nothing, replays, snapshots; and the landing job over growing input."""
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from probity.operators import batches as B
from probity.plans import landing
from probity.sources import schema
from probity.sources.tables import Conflict, Tables

NOW = 1705320000
CHILD = "array<string>"
POST = f"owner_id long, post_id long, url string, text string, timestamp long, likes long, collected_at long, attachments struct<images:{CHILD},videos:{CHILD},outlinks:{CHILD}>, text_features struct<hashtags:{CHILD},mentions:{CHILD},urls:{CHILD}>, _seq long"


def posts(spark, rows):
    return spark.createDataFrame(rows, POST)


def post(owner, key, url="u", text="t", ts=5, likes=1, at=9, images=(), tags=(), seq=1):
    return (owner, key, url, text, ts, likes, at, (list(images), ["/v"], []), (list(tags), ["m", "m"], []), seq)


def content(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


@pytest.fixture
def store(spark, tmp_path):
    return Tables(spark, f"file://{tmp_path}/store", buckets=3)


def save(store, spark, rows, batch=None):
    tx = store.begin("w", batch)
    if tx is None:
        return None
    B.put_posts(tx, posts(spark, rows))
    return tx.commit()


def test_batches_are_whole_and_come_once(spark, store):
    first = [post(1, k, images=[f"i{k}"], tags=["A", "a", "b"]) for k in range(20)] + [post(None, 3), post(1, None)]
    assert save(store, spark, first, 1) == 1
    ids = dict(content(store.read("posts"), "post_id", "id"))
    assert len(ids) == 20 and len(set(ids.values())) == 20
    assert content(store.read("post_hashtags"), "post_id", "tag") == sorted(((ids[k], t) for k in range(20) for t in "ab"), key=repr)
    assert store.read("post_mentions").count() == 20

    # a write that dies before its manifest leaves the table as it was
    tx = store.begin("w", 2)
    B.put_posts(tx, posts(spark, [post(1, 0, url="lost"), post(1, 99)]))
    assert tx.read("posts").count() == 21 and store.read("posts").count() == 20 and store.versions() == [1]

    second = [post(1, 0, url="", text="new", ts=0, likes=None, images=["x"], tags=["C"], seq=1), post(1, 0, url="v", ts=7, text=None, images=["y"], seq=2), post(2, 0)]
    assert save(store, spark, second, 2) == 2
    assert content(store.read("posts").where("owner_id = 1 and post_id = 0"), "url", "text", "timestamp", "likes", "id") == [("v", "new", 7, 1, ids[0])]
    assert content(store.read("post_attachments").where(F.col("post_id") == ids[0]), "kind", "href", "src") == [("image", None, "y"), ("video", "/v", None)]
    assert store.read("post_hashtags").where(F.col("post_id") == ids[0]).count() == 0
    all_ids = [r[0] for r in store.read("posts").select("id").collect()]
    assert len(all_ids) == len(set(all_ids)) == 21

    # the same batch again, and an older one, change nothing
    assert save(store, spark, second, 2) is None and save(store, spark, first, 1) is None
    assert store.versions() == [1, 2] and store.read("posts").count() == 21
    # readers of an older version keep it
    assert content(store.read("posts", 1).where("post_id = 0"), "url") == [("u",)]


def test_conflicts_and_vacuum(spark, store):
    save(store, spark, [post(1, k) for k in range(6)])
    one, other = store.begin(), store.begin()
    B.put_posts(one, posts(spark, [post(1, 1, url="one")]))
    B.put_posts(other, posts(spark, [post(1, 2, url="other")]))
    assert one.commit() == 2
    with pytest.raises(Conflict):
        other.commit()
    with pytest.raises(ValueError):
        one.commit()
    assert content(store.read("posts").where("url <> 'u'"), "post_id", "url") == [(1, "one")]
    with pytest.raises(KeyError):
        store.read("nowhere")
    before = content(store.read("posts"), "post_id", "url", "id")
    assert store.vacuum(1) > 0 and store.versions() == [2] and content(store.read("posts"), "post_id", "url", "id") == before
    assert store.vacuum(1) == 0
    assert save(store, spark, [], 5) == 3 and store.read("posts").count() == 6


def test_untouched_buckets_keep_their_files(spark, store):
    save(store, spark, [post(1, k) for k in range(30)])
    old = store.manifest()["tables"]["posts"]["parts"]
    save(store, spark, [post(1, 4, url="x")])
    new = store.manifest()["tables"]["posts"]["parts"]
    assert len(old) == 3 and sum(old[b] != new[b] for b in old) == 1


def page(kind, key, html, at=NOW, owner=None, post_id=None, user=None):
    return (kind, key, owner, post_id, user, html, at)


def post_html(key, likes="3", date="2 mar 2021", text="hello #Tag"):
    return (f'<div class="PostHeader__contentWrapper"><i data-post-id="-5_{key}"></i><a href="/wall-5_{key}" class="PostHeaderTime">{date}</a><div class="wi_body"><div class="pi_text">{text}</div></div><b class="PostBottomButtonReaction__label">{likes}</b></div>')


def comment_html(key, user, text="so #One", date="2 mar 2021 at 1:05 pm"):
    return f'<div id="wall_reply-5_{key}"><a class="ReplyItem__name" href="/id{user}">Ann</a><div class="ReplyItem__body">{text}</div><div class="ReplyItem__date"><a class="item_date" href="/w?reply={key}">{date}</a></div></div>'


def profile_html(user, status="s", more=""):
    body = [{"method": "users.get", "response": [{"id": user, "first_name": "A", "status": status, "counters": {"friends": 4}, "personal": {"langs": ["ru", "en", "ru"]}, "schools": [{"id": 7, "name": "S", "class": "b"}], "verified": 1}]}]
    body += [{"method": "friends.get", "response": {"count": 8, "items": [{"id": 31, "first_name": "F", "online": 1}]}}, {"method": "photos.get", "response": {"count": 1, "items": [{"id": 6, "orig_photo": {"url": "o"}}]}}]
    return f'<script>{{"apiPrefetchCache" : {json.dumps(body)}{more}}}</script>'


LABEL = "<p>Регистрация: 5.6.2012</p>Этот аккаунт не помечен как бот"
ONE = [page("posts", "p1", post_html(1) + post_html(2, likes="1.2K")), page("comments", "c1", comment_html(10, 71) + comment_html(11, 72), owner=-5, post_id=1), page("profile", "u71", profile_html(71)), page("label", "l71", LABEL, user=71), page("label", "l99", LABEL, user=99)]
TWO = [page("posts", "p2", post_html(2, likes="7") + post_html(3), NOW + 50), page("comments", "c2", comment_html(11, 72, text="again"), NOW + 50, -5, 1), page("comments", "c3", comment_html(12, 73), NOW + 50, -5, 8), page("profile", "u71", profile_html(71, status="new ]"), NOW + 50), page("profile", "u72", profile_html(72), NOW + 50), page("label", "l72", "<b>Получить карточку бота</b>", NOW + 60, user=72)]
ODD = [page("posts", "o1", post_html(4, likes="99999999999999999999", date="32 foo 2021")), page("profile", "o2", '<script>{"apiPrefetchCache":[{"method":}]</script>'), page("profile", "o3", '{"apiPrefetchCache":[1'), page("profile", "o4", None), page("label", "o5", "nothing", user=71), page("x", "o6", "?"), page("comments", "o7", comment_html(13, 71, date="soon"), owner=-5, post_id=1)]


def state(store):
    """All tables without their row numbers."""
    out = {}
    ids = {n: store.read(n).select(F.col("id").alias("_i"), F.concat_ws("/", *schema.KEYS[n]).alias("_k")) for n in ("posts", "comments", "profiles")}
    parent = {"post_id": "posts", "comment_id_fk": "comments", "profile_id": "profiles", "post_row_id": "posts"}
    for name in schema.DDL:
        df = store.read(name).drop("id")
        for c, p in parent.items():
            if c in df.columns and not (c == "post_id" and name in ("posts", "comments")):
                df = df.join(ids[p], F.col(c) == F.col("_i"), "left").withColumn(c, F.col("_k")).drop("_i", "_k")
        out[name] = content(df, *sorted(df.columns))
    return out


def test_two_runs_over_growing_input_equal_one(spark, tmp_path):
    write = lambda rows, place: spark.createDataFrame(rows, landing.PAGES).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/{place}")
    grown = Tables(spark, f"file://{tmp_path}/grown", buckets=3)
    write(ONE, "pages")
    run = lambda: landing.run(spark, f"file://{tmp_path}/pages", grown, f"file://{tmp_path}/check")
    run()
    assert grown.read("comments").count() == 2 and grown.versions() == [1]
    write(TWO, "pages")
    run()
    run()
    assert grown.versions() == [1, 2]
    write(ONE + TWO, "all")
    whole = Tables(spark, f"file://{tmp_path}/whole", buckets=2)
    landing.run(spark, f"file://{tmp_path}/all", whole, f"file://{tmp_path}/check2")
    assert whole.versions() == [1] and state(grown) == state(whole)

    got = state(whole)
    assert [r for r in content(whole.read("posts"), "post_id", "likes", "timestamp", "collected_at")] == [(1, 3, 1614632400, NOW), (2, 7, 1614632400, NOW + 50), (3, 3, 1614632400, NOW + 50)]
    assert content(whole.read("comments"), "comment_id", "text", "from_id") == [(10, "so #One", 71), (11, "again", 72), (12, "so #One", 73)]
    assert content(whole.read("comments").where("post_row_id is null"), "comment_id") == [(12,)]
    assert content(whole.read("profiles"), "user_id", "status", "is_bot", F.col("registered_at").cast("string"), "verified") == [(71, "new ]", 0, "2012-06-05", True), (72, "s", 1, None, True)]
    assert len(got["profile_languages"]) == 4 and len(got["profile_friends_sample"]) == 2 and content(whole.read("profile_photos"), "photo_id", "url_base", "sizes_json") == [(6, "o", "[]")] * 2
    assert content(whole.read("profile_counters"), "friends") == [(8,), (8,)] and content(whole.read("profile_schools"), "school_id", "clazz") == [(7, "b")] * 2
    # a batch that comes again, as after a crash between publishing and the stream's own commit
    assert grown.begin("landing", 1) is None


def test_odd_pages_become_errors(spark, tmp_path):
    store = Tables(spark, f"file://{tmp_path}/store", buckets=2)
    spark.createDataFrame(ONE + ODD, landing.PAGES).write.parquet(f"file://{tmp_path}/pages")
    landing.run(spark, f"file://{tmp_path}/pages", store, f"file://{tmp_path}/check")
    assert content(store.read("errors"), "page_id", "field", "reason") == [
        ("o1", "likes", "number too large"), ("o1", "timestamp", "no date"), ("o2", "html", "broken JSON"), ("o3", "html", "array without end"), ("o4", "html", "no responses"), ("o5", "html", "no label"), ("o6", "kind", "unknown kind"), ("o7", "timestamp", "no date"),
    ]
    assert content(store.read("posts").where("post_id = 4"), "likes", "timestamp") == [(0, None)] or content(store.read("posts").where("post_id = 4"), "likes", "timestamp") == [(0, 0)]
    assert store.read("posts").count() == 3 and store.read("profiles").count() == 1
    assert content(store.read("runs"), "step", "pages", "found", "stored") == [("comments", 2, 3, 3), ("labels", 3, 2, 1), ("posts", 2, 3, 3), ("profiles", 4, 1, 1)]
    # the next, empty call publishes nothing
    landing.run(spark, f"file://{tmp_path}/pages", store, f"file://{tmp_path}/check")
    assert store.versions() == [1]
    assert Path(f"{tmp_path}/store/data").exists() and not any(Path(f"{tmp_path}/store/data/_batch").iterdir())
