"""Queries over landed values and pages.

The test tables hold no such pages, so pages are written from them: each value of a row is put into the page
format, the operators parse it back, and the SQL takes the values from the rows themselves.
"""
from __future__ import annotations

from pyspark.sql import functions as F

from probity.functions import parse as P
from probity.operators import activity as A
from probity.operators import pages as G
from probity.operators import store as S
from probity.plans.stored import stored, with_stored

QUERIES, SQL = {}, {}
NOW = 1705320000  # 2024-01-15 12:00 UTC, 15:00 in Moscow


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return keep


def t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


# ten ways to write a number n; what each means is computed from n
COUNTS = {0: ("CAST(n AS STRING)", "n"), 1: ("concat(n % 900, ',', 100 + n % 800)", "n % 900 * 1000 + 100 + n % 800"), 2: ("concat(n % 50, '.', n % 10, 'K')", "CAST(trunc((n % 50 + n % 10 / 10.0e0) * 1000) AS BIGINT)"), 3: ("concat(n % 50, '.', n % 10)", "n % 50"),
          4: ("concat(' ', n % 7, 'm ')", "n % 7 * 1000000"), 5: ("concat(n, ' likes')", "n"), 6: ("concat(n % 90, ' ', 100 + n % 800)", "n % 90 * 1000 + 100 + n % 800"), 7: ("concat('1', chr(160), '5 x')", "15"), 8: ("'none'", "0"), 9: ("CAST(NULL AS STRING)", "0")}


def cases(which: int, by: str) -> str:
    return f"CASE {by} " + " ".join(f"WHEN {k} THEN {v[which]}" for k, v in COUNTS.items()) + " END"


@query(f"SELECT n AS id, CAST({cases(1, 'n % 10')} AS BIGINT) AS parsed FROM (SELECT o_orderkey AS n FROM orders)")
def compact_number_parse(spark, d):
    x = t(spark, d, "orders").select(F.col("o_orderkey").alias("n"))
    return x.select(F.col("n").alias("id"), P.compact_number(F.expr(cases(0, "n % 10"))).alias("parsed"))


# date texts from the parts of a row: day 1-28, month, year 2016-2023, hour, minute
PARTS = "1 + n % 28 AS d, 1 + n % 12 AS m, 2016 + n % 8 AS y, n % 24 AS h, n % 60 AS mi, n % 9 AS form, n AS id FROM (SELECT o_orderkey AS n FROM {orders})"
CLOCK = "concat(CASE WHEN h % 12 = 0 THEN 12 ELSE h % 12 END, ':', lpad(CAST(mi AS STRING), 2, '0'), CASE WHEN h < 12 THEN ' am' ELSE ' PM' END)"
MONTH = "substring('janfebmaraprmayjunjulaugsepoctnovdec', CAST(m * 3 - 2 AS INT), 3)"
FORMS = {0: f"concat(d, ' ', {MONTH}, ' ', y, ' at ', {CLOCK})", 1: f"concat(d, '  ', {MONTH}, ' ', y)", 2: f"concat(d, ' ', {MONTH}, ' at ', {CLOCK})", 3: f"concat(d, ' ', {MONTH})", 4: f"concat('today at ', {CLOCK}, ', edited')", 5: f"concat(' Yesterday at ', h, ':', lpad(CAST(mi AS STRING), 2, '0'))",
         6: "concat(mi, ' minutes ago')", 7: "concat(CASE h % 2 WHEN 0 THEN 'two' ELSE 'ten' END, ' hours ago from web')", 8: "CASE WHEN h < 9 THEN 'just now' WHEN h < 14 THEN '' END"}
WALL = "CAST(epoch(make_timestamp({}, {}, {}, {}, {}, 0)) AS BIGINT) - 10800"
DATED = WALL.format("y", "m", "d", "h", "mi")


def near_year(h: str, mi: str) -> str:
    this = WALL.format(2024, "m", "d", h, mi)
    return f"CASE WHEN {this} - {NOW} > 86400 THEN {WALL.format(2023, 'm', 'd', h, mi)} ELSE {this} END"


@query(
    f"SELECT id, CASE form WHEN 0 THEN {DATED} WHEN 1 THEN {WALL.format('y', 'm', 'd', 0, 0)} WHEN 2 THEN {near_year('h', 'mi')} WHEN 3 THEN {near_year('0', '0')} WHEN 4 THEN {WALL.format(2024, 1, 15, 'h', 'mi')} WHEN 5 THEN {WALL.format(2024, 1, 14, 'h', 'mi')} "
    f"WHEN 6 THEN {NOW} - mi * 60 WHEN 7 THEN {NOW} - CASE h % 2 WHEN 0 THEN 7200 ELSE 36000 END ELSE 0 END AS parsed FROM (SELECT {PARTS.format(orders='orders')})"
)
def relative_date_parse(spark, d):
    x = spark.sql("SELECT " + PARTS, orders=t(spark, d, "orders"))
    text = F.expr("CASE form " + " ".join(f"WHEN {k} THEN {v}" for k, v in FORMS.items()) + " END")
    return x.select("id", P.relative_date(text, F.lit(NOW).cast("long")).alias("parsed"))


@query("SELECT id, CASE n % 5 WHEN 0 THEN make_date(y, m, d) WHEN 1 THEN make_date(y, m, d) WHEN 2 THEN make_date(y, m, d) END AS parsed FROM (SELECT o_orderkey AS id, o_orderkey AS n, 1 + o_orderkey % 28 AS d, 1 + o_orderkey % 12 AS m, 1970 + o_orderkey % 80 AS y FROM orders WHERE 1970 + o_orderkey % 80 < 2069)")
def day_first_dates(spark, d):
    x = t(spark, d, "orders").select(F.col("o_orderkey").alias("n")).selectExpr("n", "1 + n % 28 AS d", "1 + n % 12 AS m", "1970 + n % 80 AS y").where("y < 2069")
    text = F.expr("CASE n % 5 WHEN 0 THEN concat(d, '.', m, '.', y) WHEN 1 THEN concat(d, '/', m, '/', y, ' ') WHEN 2 THEN concat(lpad(CAST(d AS STRING), 2, '0'), '.', m, '.', lpad(CAST(y % 100 AS STRING), 2, '0')) WHEN 3 THEN concat(d, '-', m) ELSE NULL END")
    return x.select(F.col("n").alias("id"), P.day_first_date(text).alias("parsed"))


@query("SELECT id, CASE n % 5 WHEN 0 THEN 'a' || n || '<b>' WHEN 1 THEN '' WHEN 2 THEN 'page ' || n WHEN 3 THEN '{broken ' || n ELSE '' END AS html FROM (SELECT o_orderkey AS id, o_orderkey AS n FROM orders)")
def unwrap_ajax(spark, d):
    x = t(spark, d, "orders").select(F.col("o_orderkey").alias("n"))
    text = F.expr("""CASE n % 5 WHEN 0 THEN concat('{"data":["a', n, '",3,{"x":1},null,"<b>"]}') WHEN 1 THEN '{"x":["y"]}' WHEN 2 THEN concat(' page ', n, ' ') WHEN 3 THEN concat('{broken ', n) ELSE '{"data":[]}' END""")
    return x.select(F.col("n").alias("id"), P.unwrap_ajax(text).alias("html"))


# more ways to write a number n: long ones, other digits, signs, exact texts
WIDE = {0: ("concat('9', lpad(CAST(n AS STRING), 25, '0'), ' x')", "'9' || lpad(CAST(n AS STRING), 25, '0')"), 1: ("concat(n, '00000000000000000000 likes, 2')", "CAST(n AS STRING) || '000000000000000000002'"), 2: ("translate(CAST(n AS STRING), '0123456789', '٠١٢٣٤٥٦٧٨٩')", "CAST(n AS STRING)"), 3: ("concat(translate(CAST(n % 50 AS STRING), '0123456789', '०१२३४५६७८९'), '.5M')", "CAST((n % 50) * 1000000 + 500000 AS STRING)"), 4: ("concat('-', n, 'K')", "CAST(n AS STRING)"),
        5: ("concat('4', n % 3, '00000000000000000000000m')", "CASE n % 3 " + " ".join(f"WHEN {k} THEN '{int(float(f'4{k}' + '0' * 23) * 1e6)}'" for k in range(3)) + " END"), 6: ("concat(repeat('9', 39), 'x')", "NULL"), 7: ("concat(repeat('9', 39), 'k')", "NULL"), 8: ("concat('\u2009', n, ',000.75\u00a0')", "CAST(n * 1000 AS STRING)")}


@query("SELECT n AS id, CASE n % 9 " + " ".join(f"WHEN {k} THEN {v[1]}" for k, v in WIDE.items()) + " END AS parsed, n % 9 IN (0, 1, 5, 6, 7) AS too_wide FROM (SELECT o_orderkey AS n FROM orders)")
def compact_number_forms(spark, d):
    x = t(spark, d, "orders").select(F.col("o_orderkey").alias("n"))
    text = F.expr("CASE n % 9 " + " ".join(f"WHEN {k} THEN {v[0]}" for k, v in WIDE.items()) + " END")
    return x.select(F.col("n").alias("id"), P.compact_decimal(text).cast("string").alias("parsed"), P.compact_number(text).isNull().alias("too_wide"))


AJAX = {0: ("""concat('{"data":{"k', n, '":1,"b":[2],"k', n, '":3}}')""", "'k' || n || 'b'"), 1: ("""concat('{"data":null,"n":', n, '}')""", """'{"data":null,"n":' || n || '}'"""), 2: ("""concat(' {"data":', n, '}')""", """'{"data":' || n || '}'"""), 3: ("""concat('{"data":["old"],"x":NaN,"data":["new', n, '"]}')""", "'new' || n"), 4: ("""concat('{"data":"s', n, '"}')""", "'s' || n"),
        5: ("""concat('{"data":["a\\\\"', n, '\\\\u0436]"]} x')""", """'{"data":["a\\"' || n || '\\u0436]"]} x'"""), 6: ("""concat('{"data":["a\\\\"', n, '\\\\u0436]"]}')""", "'a\"' || n || 'ж]'"), 7: ("""concat('["', n, '"]')""", """'["' || n || '"]'"""), 8: ("""concat('{"other":', n, '}')""", "''"), 9: ("CAST(NULL AS STRING)", "''")}


@query("SELECT n AS id, CASE n % 10 " + " ".join(f"WHEN {k} THEN {v[1]}" for k, v in AJAX.items()) + " END AS html FROM (SELECT o_orderkey AS n FROM orders)")
def unwrap_ajax_forms(spark, d):
    text = F.expr("CASE n % 10 " + " ".join(f"WHEN {k} THEN {v[0]}" for k, v in AJAX.items()) + " END")
    return t(spark, d, "orders").select(F.col("o_orderkey").alias("n")).select(F.col("n").alias("id"), P.unwrap_ajax(text).alias("html"))


# a profile's JSON with brackets, quotes, escapes and a closing tag inside its strings; the key in several forms
INSIDE = '[{"method":"users.get","response":[{"id":@,"status":"old"}]},{"method":"","response":1},{"method":"users.get","response":[{"id":@,"status":"a ]] \\"[@]\\" </script> \\\\","about":"\\u0436[","langs":[[],["["]]}]}]'
STATUS = "'a ]] \"[' || n || ']\" </script> \\'"
KEYS = {0: '"apiPrefetchCache":', 1: '"apiPrefetchCache" : ', 2: '"APIprefetchcache"\n:\t', 3: '"apiPrefetchCache":', 4: '"apiPrefetchCache":', 5: '"otherCache":'}


def spread_json(form: str) -> str:
    """INSIDE with n for @, as an expression; from 3 on, cut: inside its last string, before its end."""
    whole = "replace('" + INSIDE.replace("\\", "\\\\" if form == "spark" else "\\") + "', '@', CAST(n AS STRING))"
    return f"CASE n % 6 WHEN 3 THEN substring({whole}, 1, length({whole}) - 8) WHEN 4 THEN substring({whole}, 1, length({whole}) - 1) ELSE {whole} END"


@query(f"SELECT n AS page_id, CASE WHEN n % 6 < 3 THEN {spread_json('sql')} END AS found, CASE WHEN n % 6 < 3 THEN n END AS user_id, CASE WHEN n % 6 < 3 THEN {STATUS} END AS status, CASE WHEN n % 6 < 3 THEN 'ж[' END AS about FROM (SELECT c_custkey AS n FROM customer)")
def prefetched_arrays(spark, d):
    """What stands behind the array closes no bracket of it: a later script repeats the key."""
    key = "CASE n % 6 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in KEYS.items()) + " END"
    tail = "CASE WHEN n % 6 < 3 THEN ',\"x\":[\"]\"]}</script><script>{\"apiPrefetchCache\":[]}' ELSE '' END"
    x = t(spark, d, "customer").select(F.col("c_custkey").alias("n"))
    x = x.select(F.col("n").alias("page_id"), F.expr(f"concat('<script>{{\"a\":[1,', n, '],', {key}, {spread_json('spark')}, {tail})").alias("html"))
    bundle = G.profile_bundles(x).select(F.col("page_id").alias("_id"), "profile")
    out = x.join(bundle, F.col("page_id") == F.col("_id"), "left")
    return out.select("page_id", P.json_array_after(F.col("html"), G.PREFETCH).alias("found"), "profile.user_id", "profile.status", "profile.about")


# a page for each five documents; every other page marks its comments by anchors
ROWS = "doc_id AS id, doc_id // 5 AS page_id, 100 + doc_id % 50 AS uid, doc_id * 5 % 40 AS likes, CASE WHEN doc_id % 3 = 0 THEN doc_id - 1 END AS thread, 1 + doc_id % 28 AS day, source"
COMMENT_TEXT = "'Said ' || source || ' #Tag' || id || ' to @user.' || uid || ' ' || chr(10) || 'see https://e.org/' || id || ' & more'"


@query(
    f"SELECT page_id, id AS comment_id, uid AS from_id, 'Ann ' || uid AS author_name, CASE WHEN id % 4 = 1 THEN NULL ELSE CASE WHEN id % 4 = 2 THEN '/ann' || uid ELSE '/id' || uid END END AS author_href, {COMMENT_TEXT} AS text, CAST(epoch(make_date(2021, 3, CAST(day AS INT))) AS BIGINT) + 45000 - 10800 AS timestamp, likes, thread AS reply_to_comment_id, "
    f"'https://i.org/' || id || '.png' AS images, 'Tag' || id AS hashtags, 'user.' || uid AS mentions, 'https://e.org/' || id AS urls FROM (SELECT {ROWS} FROM documents WHERE source IS NOT NULL AND doc_id > 0)".replace("'Ann ' || uid AS author_name", "CASE WHEN id % 4 <> 1 THEN 'Ann ' || uid END AS author_name")
)
def landed_comments(spark, d):
    out = G.parse_comments(comment_pages(spark, d))
    joined = lambda c: F.array_join(c, " ")
    return out.select("page_id", "comment_id", "from_id", "author_name", "author_href", "text", "timestamp", "likes", "reply_to_comment_id", joined("attachments.images").alias("images"), joined("text_features.hashtags").alias("hashtags"), joined("text_features.mentions").alias("mentions"), joined("text_features.urls").alias("urls"))


def comment_pages(spark, d):
    x = t(spark, d, "documents").where("source is not null").selectExpr(*ROWS.replace("//", "DIV").split(", "))
    marker = "CASE WHEN page_id % 2 = 0 THEN concat('<div id=\"wall_reply-5_', id, '\">') ELSE concat('<a name=\"reply', id, '\" class=\"ReplyItem__anchor\"></a>') END"
    author = "CASE WHEN id % 4 = 1 THEN concat('<a onclick=\"Replies.replyTo(x, -5, ', id, ', ', uid, ')\">reply</a>') WHEN id % 4 = 2 THEN concat('<a class=\"q ReplyItem__name\" href=\"/ann', uid, '\">Ann ', uid, '</a><i data=ImageStatus.open({\"user_id\": ', uid, '})></i>') ELSE concat('<div class=\"ReplyItem__header\"><a href=\"/id', uid, '\">Ann <b>', uid, '</b></a></div>') END"
    body = "concat('<div class=\"ReplyItem__body\">Said ', source, ' #Tag', id, ' to @user.', uid, ' <br/>see https://e.org/', id, '  &amp; more<img src=\"https://i.org/', id, '.png\"></div><div class=\"ReplyItem__date\">')"
    date = "concat('<a class=\"item_date\" href=\"/wall?reply=', id, CASE WHEN thread IS NULL THEN '' ELSE concat('&amp;thread=', thread) END, '\">', day, ' mar 2021 at 12:30 pm</a></div>')"
    like = "concat('<a class=\"ReplyItem__like\"><b></b> ', CASE WHEN likes > 0 THEN CAST(likes AS STRING) ELSE '' END, '</a>')"
    seg = x.select("page_id", "id", F.expr(f"concat({marker}, {author}, {body}, {date}, {like})").alias("seg"))
    # the last comment comes once more, changed: the first one counts
    page = seg.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("id", "seg"))).alias("s"))
    html = F.concat(F.lit("<p>head</p>"), F.array_join(F.transform("s", lambda x: x["seg"]), ""), F.replace(F.element_at("s", -1)["seg"], F.lit("Said"), F.lit("Again")))
    return page.select("page_id", html.alias("html"), F.lit(9).cast("long").alias("post_id"), F.lit(NOW).cast("long").alias("collected_at"))


@query(
    "SELECT o_custkey AS page_id, CAST(-5 AS BIGINT) AS owner_id, o_orderkey AS post_id, '/wall-5_' || o_orderkey AS url, CAST(epoch(make_date(2021, 3, CAST(1 + o_orderkey % 28 AS INT))) AS BIGINT) - 10800 AS timestamp, "
    "'Order ' || o_orderpriority || ' #o' || o_orderkey || CASE WHEN o_orderkey % 3 = 0 THEN 'hidden ' || o_orderkey || chr(10) || chr(10) || 'hidden ' || o_orderkey ELSE '' END AS text, o_orderkey % 70 * 1000 AS likes, o_orderkey % 9 AS comments, o_orderkey % 5 AS reposts, o_orderkey % 1000 AS views, "
    "o_orderkey % 7 = 0 AS pinned, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 4 = 0 END AS is_comments_closed, CASE WHEN o_orderkey % 5 = 0 THEN '/video-5_' || o_orderkey ELSE '' END AS videos, CASE WHEN o_orderkey % 6 = 0 THEN 'https://out.org/' || o_orderkey ELSE '' END AS outlinks FROM orders"
)
def landed_posts(spark, d):
    """A hidden rest shows in its place and behind the text."""
    out = G.parse_posts(post_pages(spark, d))
    return out.select("page_id", "owner_id", "post_id", "url", "timestamp", "text", "likes", "comments", "reposts", "views", "pinned", "is_comments_closed", F.array_join("attachments.videos", " ").alias("videos"), F.array_join("attachments.outlinks", " ").alias("outlinks"))


def post_pages(spark, d):
    seg = F.expr("""concat('<div class="a PostHeader__contentWrapper"><i data-post-id="-5_', o_orderkey, '"></i><a href="/wall-5_', o_orderkey, '" class="PostHeaderTime__link">', 1 + o_orderkey % 28, ' mar 2021</a>',
      CASE WHEN o_orderkey % 7 = 0 THEN '<span class="visually-hidden">post pinned</span>' ELSE '' END, CASE WHEN o_orderkey % 2 = 0 THEN concat('<i class="PostContextMenuReactMVK__root" data-exec="{&quot;isCommentsClosed&quot;: ', o_orderkey % 4 = 0, '}"></i>') ELSE '' END,
      '<div class="wi_body"><div class="pi_text">Order ', o_orderpriority, ' #o', o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN concat('<a class="PostTextMore" href="#">more</a><span style="display:none">hidden ', o_orderkey, '</span>') ELSE '' END, '</div>',
      CASE WHEN o_orderkey % 5 = 0 THEN concat('<a href="/video-5_', o_orderkey, '">v</a>') ELSE '' END, CASE WHEN o_orderkey % 6 = 0 THEN concat('<a href="https://out.org/', o_orderkey, '" rel="x nofollow">o</a>') ELSE '' END, '</div>',
      '<b class="PostBottomButtonReaction__label">', o_orderkey % 70, 'K</b><i data-replies-count="', o_orderkey % 9, '"></i><a href="/like?act=publish&x"><b class="PostBottomButton__label">', o_orderkey % 5, '</b></a><u class="Socials__viewsCount">', o_orderkey % 1000, '</u></div>')""")
    x = t(spark, d, "orders").select(F.col("o_custkey").alias("page_id"), F.struct("o_orderkey", seg.alias("seg")).alias("s"))
    page = x.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["seg"]), "").alias("html"))
    return page.withColumn("collected_at", F.lit(NOW).cast("long"))


@query(
    "SELECT user_id, first_name, coalesce(status, '') AS status, coalesce(about, '') AS about, coalesce(verified, false) AS verified, coalesce(is_esia_verified, false) AS is_esia_verified, coalesce(site, '') AS site, coalesce(mobile_phone, '') AS mobile_phone, city_title, last_seen_ts, friends, CASE WHEN user_id % 2 = 0 THEN 77 ELSE followers END AS followers, groups, CAST(user_id % 3 AS INT) AS schools "
    "FROM profiles LEFT JOIN profile_counters c ON c.profile_id = profiles.id"
)
def landed_profiles(spark, d):
    out = G.profile_bundles(profile_pages(spark, d))
    return out.select(
        "profile.user_id", "profile.first_name", "profile.status", "profile.about", "profile.verified", "profile.is_esia_verified", "profile.site", "profile.mobile_phone", "profile.city_title", "profile.last_seen_ts", "counters.friends", "counters.followers", "counters.groups", F.coalesce(F.size("schools"), F.lit(0)).alias("schools"),
    )


def profile_pages(spark, d):
    s = stored(spark, d)
    x = s["profiles"].join(s["profile_counters"].withColumnRenamed("id", "_c"), F.col("id") == F.col("profile_id"), "left")
    user = F.struct(
        F.col("user_id").alias("id"), "first_name", "status", "about", F.when(F.col("verified"), 1).otherwise(0).alias("verified"), F.when(F.col("is_esia_verified"), F.lit(True)).alias("is_esia_verified"), "site", F.struct("mobile_phone").alias("contacts"), F.struct(F.lit(3).alias("id"), F.col("city_title").alias("title")).alias("city"),
        F.struct(F.col("last_seen_ts").alias("time")).alias("last_seen"), F.struct("friends", "followers", "groups").alias("counters"), F.transform(F.sequence(F.lit(1), F.lit(2)), lambda i: F.struct(i.alias("id"))).alias("schools"),
    )
    user = user.withField("schools", F.slice(F.transform(F.sequence(F.lit(1), F.lit(3)), lambda i: F.struct(i.alias("id"), F.concat(F.lit("S"), i).alias("name"))), 1, (F.col("user_id") % 3).cast("int")))
    more = F.when(F.col("user_id") % 2 == 0, F.lit(',{"method":"users.getFollowers","response":{"count":77,"items":[]}}')).otherwise("")
    html = F.concat(F.lit('<script>a({"apiPrefetchCache":[{"method":"users.get","response":['), F.to_json(user), F.lit("]}"), more, F.lit('],"b":[1]})</script>'))
    return x.select(F.col("user_id").alias("page_id"), html.alias("html"))


SQL["landed_profiles"] = with_stored("profiles profile_counters", " " + SQL["landed_profiles"])


@query("SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN 1 END AS is_bot, CASE WHEN c_custkey % 3 = 0 THEN make_date(2010 + CAST(c_custkey % 12 AS INT), 1 + CAST(c_custkey % 12 AS INT), 1 + CAST(c_custkey % 28 AS INT)) END AS registered_at FROM customer")
def label_pages(spark, d):
    label = "CASE c_custkey % 4 WHEN 0 THEN '<a>Получить&nbsp; карточку</a> <b>бота</b>' WHEN 1 THEN 'Этот аккаунт <b>не помечен</b> как бот' WHEN 2 THEN '<a href=\"/card/1\">Карточка</a>' ELSE 'ничего' END"
    since = "CASE WHEN c_custkey % 3 = 0 THEN concat('<p>Регистрация: ', 1 + c_custkey % 28, '.', 1 + c_custkey % 12, '.', 2010 + c_custkey % 12, '</p>') ELSE '' END"
    x = t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.expr(f"concat('<div>', {label}, '</div>', {since})").alias("html"))
    return x.select("id", P.bot_label(F.col("html")).alias("is_bot"), P.registration_date(F.col("html")).alias("registered_at"))


@query(
    "SELECT doc_id, 100 + unnest(range(doc_id % 3)) * 20 AS offset_, doc_id AS thread FROM documents"
)
def thread_link_rows(spark, d):
    x = t(spark, d, "documents").select("doc_id", F.transform(F.sequence(F.lit(0), F.lit(1)), lambda i: F.concat(F.lit('<a href="/wall-5_9?offset='), 100 + i * 20, F.lit("&amp;reply="), F.col("doc_id"), F.lit('" class="RepliesThreadNext__link">more</a>'))).alias("all"))
    html = F.array_join(F.slice("all", F.lit(1), (F.col("doc_id") % 3).cast("int")), "")
    links = x.select("doc_id", F.inline(G.thread_links(html)))
    return links.select("doc_id", F.col("offset").cast("long").alias("offset_"), F.col("thread").cast("long").alias("thread"))


# keyed writes: rows of an older and a newer batch
OLD_POSTS = "SELECT o_orderkey AS id, o_orderkey % 5 AS owner_id, o_orderkey AS post_id, 'u' || o_orderkey AS url, CAST(NULL AS STRING) AS date_text, o_orderkey * 10 AS timestamp, o_orderstatus AS text, o_orderkey % 8 AS likes, CAST(NULL AS BIGINT) AS views, o_orderkey % 2 = 0 AS pinned, o_orderkey AS collected_at FROM {orders} WHERE o_orderkey % 3 > 0"
NEW_POSTS = "SELECT o_orderkey % 5 AS owner_id, o_orderkey AS post_id, CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'v' END AS url, 'now' AS date_text, CASE o_orderkey % 7 WHEN 0 THEN 0 ELSE o_orderkey * 11 END AS timestamp, o_orderpriority AS text, CASE WHEN o_orderkey % 6 > 0 THEN o_orderkey % 9 END AS likes, o_orderkey % 100 AS views, CASE WHEN o_orderkey % 5 = 0 THEN true END AS pinned, CASE WHEN o_orderkey % 10 = 0 THEN 0 ELSE o_orderkey + 5 END AS collected_at, r AS _seq FROM {orders}, (SELECT 1 AS r UNION ALL SELECT 2) x WHERE o_orderkey % 3 < 2 AND r <= 1 + o_orderkey % 2"
BATCHES = f"WITH old AS ({OLD_POSTS.format(orders='orders')}), new AS (SELECT * FROM ({NEW_POSTS.format(orders='orders')}) WHERE _seq = 1 + post_id % 2) "


@query(
    BATCHES + "SELECT owner_id, post_id, CASE WHEN coalesce(n.url, '') <> '' THEN n.url ELSE o.url END AS url, CASE WHEN n.post_id IS NULL THEN o.date_text ELSE n.date_text END AS date_text, CASE WHEN coalesce(n.timestamp, 0) <> 0 THEN n.timestamp ELSE o.timestamp END AS timestamp, "
    "coalesce(n.text, o.text) AS text, CASE WHEN n.post_id IS NULL THEN o.likes ELSE coalesce(n.likes, o.likes, 0) END AS likes, CASE WHEN n.post_id IS NULL THEN o.views ELSE coalesce(n.views, o.views, 0) END AS views, coalesce(n.pinned, o.pinned) AS pinned, CASE WHEN coalesce(n.collected_at, 0) <> 0 THEN n.collected_at ELSE o.collected_at END AS collected_at FROM old o FULL JOIN new n USING (owner_id, post_id)"
)
def save_posts(spark, d):
    o = t(spark, d, "orders")
    return S.save_posts(spark.sql(OLD_POSTS, orders=o), spark.sql(NEW_POSTS, orders=o)).drop("id")


@query(
    "WITH o AS (SELECT doc_id, doc_id % 5 AS owner_id, doc_id % 3 AS post_id, source, lang, doc_id * 3 AS likes FROM documents WHERE doc_id % 4 > 0), n AS (SELECT doc_id, doc_id % 5 AS owner_id, doc_id % 3 AS post_id, CASE WHEN doc_id % 6 > 0 THEN 'new' END AS source, CASE WHEN doc_id % 5 > 0 THEN doc_id * 4 END AS likes FROM documents WHERE doc_id % 4 < 2) "
    "SELECT coalesce(o.doc_id, n.doc_id) AS comment_id, CASE WHEN n.doc_id IS NULL THEN NULL WHEN n.post_id = 0 THEN NULL ELSE 1000 + n.owner_id * 10 + n.post_id END AS post_row_id, CASE WHEN n.doc_id IS NULL THEN o.source ELSE n.source END AS text, coalesce(n.likes, o.likes, 0) AS likes, o.lang AS author_name FROM o FULL JOIN n ON o.doc_id = n.doc_id"
)
def save_comments(spark, d):
    """author_name isn't in the newer batch, so it stays as it was."""
    x = t(spark, d, "documents")
    keys = ["doc_id % 5 AS owner_id", "doc_id % 3 AS post_id", "doc_id AS comment_id"]
    old = x.where("doc_id % 4 > 0").selectExpr(*keys, "CAST(NULL AS BIGINT) AS post_row_id", "source AS text", "doc_id * 3 AS likes", "lang AS author_name")
    new = x.where("doc_id % 4 < 2").selectExpr(*keys, "CASE WHEN doc_id % 6 > 0 THEN 'new' END AS text", "CASE WHEN doc_id % 5 > 0 THEN doc_id * 4 END AS likes", "1 AS _seq")
    posts = x.selectExpr("doc_id % 5 AS owner_id", "doc_id % 3 AS post_id").distinct().where("post_id > 0").selectExpr("*", "1000 + owner_id * 10 + post_id AS id")
    return S.save_comments(old, new.withColumn("post_row_id", F.lit(None).cast("long")), posts).select("comment_id", "post_row_id", "text", "likes", "author_name")


@query(
    "SELECT user_id, CASE WHEN user_id % 2 = 0 THEN 'renamed' ELSE first_name END AS first_name, CASE WHEN user_id % 2 = 0 THEN about ELSE about END AS about, is_bot, registered_at FROM profiles UNION ALL SELECT c_custkey + 5000000, 'renamed', NULL, NULL, NULL FROM customer WHERE c_custkey % 2 = 0"
)
def save_profiles(spark, d):
    """The bundle holds names alone; labels and the other columns stay."""
    old = stored(spark, d)["profiles"].select("user_id", "first_name", "about", "is_bot", "registered_at")
    c = t(spark, d, "customer").where("c_custkey % 2 = 0")
    new = c.selectExpr("c_custkey + 100000 AS user_id", "'renamed' AS first_name", "1 AS _seq").unionByName(c.selectExpr("c_custkey + 5000000 AS user_id", "'renamed' AS first_name", "1 AS _seq"))
    return S.save_profiles(old, new)


SQL["save_profiles"] = with_stored("profiles", " " + SQL["save_profiles"])


@query("SELECT o_orderkey, l_linenumber, l_quantity FROM (SELECT l_orderkey AS o_orderkey, CASE WHEN l_orderkey % 3 = 0 THEN l_linenumber + 100 ELSE l_linenumber END AS l_linenumber, CASE WHEN l_orderkey % 3 = 0 THEN 1.0e0 ELSE CAST(l_quantity AS DOUBLE) END AS l_quantity FROM lineitem)")
def replace_children(spark, d):
    old = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", F.col("l_quantity").cast("double").alias("l_quantity"))
    new = old.where("o_orderkey % 3 = 0").select("o_orderkey", (F.col("l_linenumber") + 100).alias("l_linenumber"), F.lit(1.0).alias("l_quantity"))
    return A.replace_children(old, new, "o_orderkey")


@query("SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter([lower(source), lower(lang), 'x' || doc_id % 7], lambda x: x IS NOT NULL AND x <> ''))), ',') AS tags FROM documents")
def comment_tags(spark, d):
    items = F.array(F.concat(F.lit(" "), F.upper("source")), F.col("lang"), F.concat(F.lit("X"), F.col("doc_id") % 7, F.lit("  ")), F.lit(" "), F.lower("source"))
    return t(spark, d, "documents").select("doc_id", F.array_join(S.tags(items), ",").alias("tags"))


@query("SELECT c_custkey + 100000 AS user_id, CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE is_bot END AS is_bot, CASE WHEN c_custkey % 2 = 0 THEN DATE '2015-05-05' ELSE registered_at END AS registered_at FROM customer JOIN profiles ON id = c_custkey")
def apply_labels(spark, d):
    lab = t(spark, d, "customer").where("c_custkey % 2 = 0 OR c_custkey % 3 = 0").select((F.col("c_custkey") + 100000).alias("user_id"), F.when(F.col("c_custkey") % 2 == 0, F.lit("2015-05-05").cast("date")).alias("registered_at"), F.when(F.col("c_custkey") % 3 == 0, 1).alias("is_bot"))
    return S.apply_labels(stored(spark, d)["profiles"], lab).select("user_id", "is_bot", "registered_at")


SQL["apply_labels"] = with_stored("profiles", " " + SQL["apply_labels"])


@query("SELECT owner_id, post_id FROM (SELECT o_custkey AS owner_id, o_orderkey AS post_id FROM orders WHERE o_orderkey % 11 > 0) p WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = post_id AND l_quantity > 45)")
def posts_to_fetch(spark, d):
    posts = t(spark, d, "orders").selectExpr("CASE WHEN o_orderkey % 11 > 0 THEN o_custkey END AS owner_id", "o_orderkey AS post_id")
    comments = t(spark, d, "lineitem").where("l_quantity > 45").join(t(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).selectExpr("o_custkey AS owner_id", "l_orderkey AS post_id")
    return S.posts_without_comments(posts, comments)


@query("SELECT DISTINCT from_id AS user_id FROM comments WHERE from_id > 0 AND from_id NOT IN (SELECT user_id FROM profiles WHERE id % 3 > 0)")
def authors_to_fetch(spark, d):
    s = stored(spark, d)
    return S.authors_without_profile(s["comments"], s["profiles"].where("id % 3 > 0"))


SQL["authors_to_fetch"] = with_stored("comments profiles", " " + SQL["authors_to_fetch"])
