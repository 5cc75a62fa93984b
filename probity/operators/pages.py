"""Landed pages to tables: posts, comments and profile bundles, by splits and patterns inside the JVM.

A page is split at its markers by look-ahead; each segment is a row, parsed by patterns. Pages that hold
nothing give no rows; segments without an id are left out.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probity.functions import parse as P
from probity.operators.activity import keep_row

# Fixed patterns of the page formats.
POST_START = r'(?i)<div[^>]+class="[^"]*\bPostHeader__contentWrapper\b[^"]*"[^>]*>'
POST_ID = r'data-post-id="(-?\d+)_(\d+)"'
POST_DATE = r'(?is)<a[^>]+href="(/wall-[-\d_]+)"[^>]*class="[^"]*PostHeaderTime[^"]*"[^>]*>(.*?)</a>'
BODY = r'(?is)<div[^>]+class="[^"]*\bwi_body\b[^"]*"[^>]*>.*'
TEXT_BLOCK = r'(?is)<div[^>]+class="[^"]*\bpi_text\b[^"]*"[^>]*>(.*?)</div>'
MORE_LINK = r'(?is)<a[^>]+class="[^"]*\bPostTextMore\b[^"]*"[^>]*>.*?</a>'
HIDDEN = r'(?is)<span[^>]+style="[^"]*display\s*:\s*none[^"]*"[^>]*>(.*?)</span>'
LIKES = r'(?i)PostBottomButtonReaction__label"[^>]*>([^<]+)<'
REPLIES = r'(?i)data-replies-count="([\d\s,.KkMm]+)"'
SHARES = r'(?is)<a[^>]+href="/like\?act=publish[^"]*"[^>]*>.*?PostBottomButton__label"[^>]*>([\d\s,.KkMm]+)<'
VIEWS = r'(?i)Socials__viewsCount"[^>]*>([^<]+)<'
EXEC_JSON = r'(?i)PostContextMenuReactMVK__root"[^>]+data-exec="(\{.+?\})"'
CLOSED = r'(?i)"isCommentsClosed"\s*:\s*(true|false)'
PINNED = r"(?i)visually-hidden[^>]*>[^<]*post pinned"
COMMENT_BLOCK = r'(?i)id="wall_reply-(-?\d+)_(\d+)"'
COMMENT_ID = r'(?i)<a[^>]+name="reply(\d+)"[^>]*class="ReplyItem__anchor"[^>]*>'
AUTHOR = r'(?is)<a[^>]+class="[^"]*\bReplyItem__name\b[^"]*"[^>]*href="(/[^"]+)"[^>]*>(.*?)</a>'
AUTHOR_LINK = r'(?is)<div class="ReplyItem__header".*?<a[^>]+href="(/[^"]+)"[^>]*>(.*?)</a>'
COMMENT_BODY = r'(?is)<div class="ReplyItem__body">(.*?)</div>\s*<div class="ReplyItem__date">'
COMMENT_BODY_ANY = r'(?is)<div class="ReplyItem__body">(.*?)</div>'
COMMENT_DATE = r'(?is)<a[^>]+class="item_date"[^>]+href="[^"]*?\?reply=(\d+)(?:&amp;|&)?(?:thread=(\d+))?[^"]*"[^>]*>(.*?)</a>'
COMMENT_LIKES = r"(?is)ReplyItem__like[^>]*>(?:\s*<[^>]+>)*\s*(\d+)?\s*</a>"
REPLY_TO = r"(?i)Replies\.replyTo\([^,]*,\s*-?\d+\s*,\s*(\d+)\s*,\s*(-?\d+)\s*\)"
IMAGE_STATUS = r'(?i)ImageStatus\.open\(\{[^}]*"user_id"\s*:\s*(\d+)'
THREADS = r'(?i)<a[^>]+href="(/wall-?\d+_\d+\?offset=(\d+)&(?:amp;)?reply=(\d+)[^"]*)"[^>]*class="RepliesThreadNext__link"'
PREFETCH = r'(?i)"apiPrefetchCache"\s*:\s*'


def pick(c: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match; null without one."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def segments(pages: DataFrame, html: str, starts: list[str], key: str) -> DataFrame:
    """(key..., place, seg): the parts of a page from each marker to the next, by the first of the patterns
    that the page holds. What comes before the first marker is no segment."""

    def cut(start: str) -> Column:
        return F.filter(F.split(F.col(html), f"(?={start})"), lambda x: x.rlike(f"^(?:{start})"))

    parts = F.array().cast("array<string>")
    for p in reversed(starts):
        parts = F.when(F.col(html).rlike(p), cut(p)).otherwise(parts)
    return pages.select(key, "collected_at", F.posexplode(parts).alias("place", "seg"))


def full_text(body: Column) -> Column:
    """A post's text block, its hidden rest behind, without the link to it."""

    def whole(inner: Column) -> Column:
        rest = P.let(F.regexp_extract_all(inner, F.lit(HIDDEN), F.lit(1)), lambda hidden: F.when(F.size(hidden) > 0, F.concat(F.lit("\n\n"), F.array_join(hidden, "\n\n"))).otherwise(""))
        return F.concat(F.regexp_replace(inner, MORE_LINK, ""), rest)

    return P.strip_tags(P.let(F.coalesce(pick(body, TEXT_BLOCK), F.lit("")), whole))


def problems(dates: dict[str, tuple[Column, Column]], counts: dict[str, tuple[Column, Column]]) -> Column:
    """array<struct(field, reason, value)>: what a segment says but its row can't hold. dates, counts: by field,
    the text and what was made of it."""
    found = [F.when((F.coalesce(text, F.lit("")) != "") & (F.coalesce(value, F.lit(0)) == 0), F.struct(F.lit(n).alias("field"), F.lit("no date").alias("reason"), text.alias("value"))) for n, (text, value) in dates.items()]
    found += [F.when(text.isNotNull() & value.isNull(), F.struct(F.lit(n).alias("field"), F.lit("number too large").alias("reason"), text.alias("value"))) for n, (text, value) in counts.items()]
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def parse_posts(pages: DataFrame, html: str = "html", key: str = "page_id", base: str = "") -> DataFrame:
    """pages(key, html, collected_at) to posts; the first of equal (owner_id, post_id) on a page."""
    s = segments(pages, html, [POST_START], key)
    seg = F.col("seg")
    x = s.withColumns({"owner_id": pick(seg, POST_ID).cast("long"), "post_id": pick(seg, POST_ID, 2).cast("long"), "body": F.coalesce(pick(seg, BODY, 0), F.lit(""))}).where("post_id is not null")
    x = keep_row(x, [key, "owner_id", "post_id"], ["place"])
    closed = F.lower(pick(P.unescape(pick(seg, EXEC_JSON)), CLOSED))
    date = P.strip_tags(pick(seg, POST_DATE, 2))
    counts = {"likes": LIKES, "reposts": SHARES, "comments": REPLIES, "views": VIEWS}
    x = x.withColumns({"text": full_text(F.col("body")), "date_text": date, **{n: P.compact_number(pick(seg, p)) for n, p in counts.items()}})
    x = x.withColumn("timestamp", P.relative_date(F.col("date_text"), F.col("collected_at")))
    odd = problems({"timestamp": (F.col("date_text"), F.col("timestamp"))}, {n: (pick(seg, p), F.col(n)) for n, p in counts.items()})
    return x.select(
        key, "owner_id", "post_id", F.concat(F.lit(base), pick(seg, POST_DATE)).alias("url"), "date_text", "timestamp", "text", *counts,
        seg.rlike(PINNED).alias("pinned"), F.when(closed.isNotNull(), closed == "true").alias("is_comments_closed"), P.attachments(F.col("body")).alias("attachments"), P.features_in_text(F.col("text")).alias("text_features"), "collected_at", "place", odd.alias("problems"),
    )


def reply_index(html: Column) -> Column:
    """Comment id to author id from a page's reply links; the last one of an id counts."""
    ids, users = (F.regexp_extract_all(html, F.lit(REPLY_TO), F.lit(g)) for g in (1, 2))
    return P.last_of_each(F.arrays_zip(ids.alias("c"), users.alias("u")), "c", "u")


def parse_comments(pages: DataFrame, html: str = "html", key: str = "page_id") -> DataFrame:
    """pages(key, html, post_id, collected_at) to comments; the first of equal ids on a page."""
    s = segments(pages, html, [COMMENT_BLOCK, COMMENT_ID], key)
    index = pages.select(key, "post_id", reply_index(F.col(html)).alias("index"))
    seg = F.col("seg")
    x = s.withColumn("comment_id", F.coalesce(F.nullif(F.coalesce(pick(seg, COMMENT_BLOCK, 2), pick(seg, COMMENT_ID)).cast("long"), F.lit(0)), pick(seg, COMMENT_DATE).cast("long"))).where("comment_id > 0")
    x = keep_row(x, [key, "comment_id"], ["place"]).join(index, key)
    href = F.coalesce(pick(seg, AUTHOR), pick(seg, AUTHOR_LINK))
    name = F.coalesce(pick(seg, AUTHOR, 2), pick(seg, AUTHOR_LINK, 2))
    uid = F.coalesce(pick(seg, REPLY_TO, 2), pick(href, r"^/id(\d+)$"), pick(seg, IMAGE_STATUS), F.try_element_at("index", F.col("comment_id").cast("string")))
    body = F.coalesce(pick(seg, COMMENT_BODY), pick(seg, COMMENT_BODY_ANY), F.lit(""))
    x = x.withColumns({"text": P.strip_tags(body), "body": body, "date_text": P.strip_tags(pick(seg, COMMENT_DATE, 3)), "author_href": href, "likes": P.compact_number(pick(seg, COMMENT_LIKES))})
    x = x.withColumn("timestamp", P.relative_date(F.col("date_text"), F.col("collected_at")))
    odd = problems({"timestamp": (F.col("date_text"), F.col("timestamp"))}, {"likes": (pick(seg, COMMENT_LIKES), F.col("likes"))})
    return x.select(
        key, "post_id", "comment_id", uid.cast("long").alias("from_id"), F.nullif(P.strip_tags(name), F.lit("")).alias("author_name"), "author_href", "text", "date_text", "timestamp", "likes",
        pick(seg, COMMENT_DATE, 2).cast("long").alias("reply_to_comment_id"), P.attachments(F.col("body")).alias("attachments"), P.features_in_text(F.col("text")).alias("text_features"), "collected_at", "place", odd.alias("problems"),
    )


def thread_links(html: Column) -> Column:
    """(thread, offset) of each link to the rest of a thread."""
    return F.arrays_zip(F.regexp_extract_all(html, F.lit(THREADS), F.lit(3)).alias("thread"), F.regexp_extract_all(html, F.lit(THREADS), F.lit(2)).alias("offset"))


def prefetched(html: Column) -> Column:
    """The map of method to response (JSON text) in a profile page; the last of a method counts. Null without
    the array of responses, or where it isn't JSON."""
    return responses(P.json_array_after(html, PREFETCH))


def responses(found: Column) -> Column:
    """The map of method to response of the array of responses."""
    items = F.from_json(found, "array<struct<method string, response string>>")
    return P.last_of_each(F.filter(items, lambda x: x["method"] != ""), "method", "response")


USER = (
    "array<struct<id long, screen_name string, domain string, first_name string, last_name string, nickname string, sex int, bdate string, bdate_visibility int, city struct<id long, title string>, country struct<id long, title string>, home_town string, verified string, is_sber_verified string, is_tinkoff_verified string, is_esia_verified string, is_nft string, is_followers_mode_on string, no_index string, wall_default string, cover struct<images array<struct<url string>>>, "
    "status string, activity string, about string, interests string, books string, tv string, quotes string, games string, movies string, music string, site string, mobile_phone string, home_phone string, contacts struct<mobile_phone string, home_phone string>, photo_rec string, photo_medium_rec string, photo_200 string, photo_400 string, photo_max string, photo_base string, photo_avg_color string, photo_id string, "
    "online string, last_seen struct<time long, platform long>, online_info struct<last_seen long, app_id long>, followers_count long, counters map<string, string>, personal struct<alcohol long, inspired_by string, life_main long, people_main long, religion string, religion_id long, smoking long, langs array<string>>, "
    "universities array<struct<id long, name string, faculty long, faculty_name string, chair long, chair_name string, graduation int>>, schools array<struct<id long, name string, year_from int, year_to int, year_graduated int, class string, speciality string>>, career array<struct<company string, position string, city_id long, city_name string, `from` int, until int>>>>"
)
PERSON = "struct<count long, items array<struct<id long, domain string, first_name string, last_name string, sex int, online string, photo_50 string, photo_100 string, photo_200 string>>>"
GROUPS = "struct<count long, items array<struct<id long, name string, screen_name string, type string, description string, status string, photo_100 string, photo_200 string>>>"
PHOTOS = "struct<count long, items array<struct<id long, album_id long, owner_id long, date long, square_crop string, orig_photo struct<url string>, sizes string>>>"
VIDEOS = "struct<count long, items array<struct<id long, owner_id long, date long, title string, description string, duration long, views long, comments long, likes struct<count long>, reposts struct<count long>, player string, image array<struct<url string>>, direct_url string, share_url string>>>"
FREE_TEXT = ["status", "activity", "about", "interests", "books", "tv", "quotes", "games", "movies", "music", "site"]


def profile_bundles(pages: DataFrame, html: str = "html", key: str = "page_id") -> DataFrame:
    """One row for each page with a user: profile, counters, and arrays for the child tables.

    Missing free texts are empty; list counts override the user's own counters."""
    x = pages.select(key, prefetched(F.col(html)).alias("m"))
    get = lambda method, kind: F.from_json(F.try_element_at("m", F.lit(method)), kind)
    parts = F.struct(F.get(get("users.get", USER), F.lit(0)).alias("u"), get("friends.get", PERSON).alias("fr"), get("users.getFollowers", PERSON).alias("fo"), get("users.getSubscriptions", GROUPS).alias("su"), get("photos.get", PHOTOS).alias("ph"), get("video.get", VIDEOS).alias("vi"))
    x = x.select(key, F.inline_outer(F.array(parts))).where("u.id is not null")  # a condition isn't pushed below it, which would read all JSON twice
    own = lambda c: F.try_element_at("u.counters", F.lit(c)).try_cast("long")
    over = {"friends": "fr.count", "followers": "fo.count", "subscriptions": "su.count", "photos": "ph.count", "videos": "vi.count"}
    names = ["albums", "audios", "followers", "friends", "groups", "online_friends", "pages", "photos", "subscriptions", "videos", "video_playlists", "mutual_friends", "clips_followers", "clips_views", "clips_likes"]
    truth = lambda c: (F.coalesce(F.col(f"u.{c}"), F.lit("")).isin("1", "true")).alias(c)
    phone = lambda c: F.coalesce(F.nullif(F.col(f"u.contacts.{c}"), F.lit("")), F.col(f"u.{c}"), F.lit("")).alias(c)
    profile = F.struct(
        F.col("u.id").alias("user_id"), *[F.col(f"u.{c}").alias(c) for c in ("screen_name", "domain", "first_name", "last_name", "nickname", "sex", "bdate", "bdate_visibility", "home_town", "no_index", "wall_default", "photo_max", "photo_base", "photo_avg_color", "photo_id")], F.col("u.city.id").alias("city_id"), F.col("u.city.title").alias("city_title"), F.col("u.country.id").alias("country_id"), F.col("u.country.title").alias("country_title"),
        *[truth(c) for c in ("verified", "is_sber_verified", "is_tinkoff_verified", "is_esia_verified", "is_nft", "is_followers_mode_on", "online")], *[F.coalesce(F.col(f"u.{c}"), F.lit("")).alias(c) for c in FREE_TEXT], phone("mobile_phone"), phone("home_phone"),
        F.col("u.photo_rec").alias("photo_50"), F.col("u.photo_medium_rec").alias("photo_100"), F.col("u.photo_200").alias("photo_200"), F.col("u.photo_400").alias("photo_400"), F.get("u.cover.images", F.lit(0))["url"].alias("cover_photo_url"), F.coalesce(F.nullif("u.last_seen.time", F.lit(0)), "u.online_info.last_seen").alias("last_seen_ts"), F.col("u.online_info.app_id").alias("online_app_id"), F.col("u.last_seen.platform").alias("last_seen_platform"), F.coalesce("fo.count", "u.followers_count").alias("followers_count"),
    )
    counters = F.struct(*[F.coalesce(F.col(over[c]), own(c)).alias(c) if c in over else own(c).alias(c) for c in names])
    return x.select(key, profile.alias("profile"), counters.alias("counters"), F.col("u.personal").alias("personal"), F.col("u.personal.langs").alias("languages"), F.col("u.universities").alias("universities"), F.col("u.schools").alias("schools"), F.col("u.career").alias("careers"), F.col("fr.items").alias("friends_sample"), F.col("fo.items").alias("followers_sample"), F.col("su.items").alias("subscriptions_sample"), F.col("ph.items").alias("photos"), F.col("vi.items").alias("videos_sample"))


def profile_problems(pages: DataFrame, html: str = "html", key: str = "page_id") -> DataFrame:
    """(key, field, reason, value) of pages that give no profile: without the array of responses, with one that
    isn't JSON, or without a user in it."""
    user = lambda m: F.get(F.from_json(F.try_element_at(m, F.lit("users.get")), USER), F.lit(0))["id"]

    def told(found: Column) -> Column:
        wrong = P.let(responses(found), lambda m: F.when(m.isNull(), "broken JSON").when(user(m).isNull(), "no user"))
        reason = F.when(~F.coalesce(F.col(html), F.lit("")).rlike(PREFETCH), "no responses").when(found.isNull(), "array without end").otherwise(wrong)
        return F.struct(reason.alias("reason"), F.substring(F.coalesce(found, F.col(html)), 1, 200).alias("value"))

    rows = pages.select(key, F.inline_outer(F.array(P.let(P.json_array_after(F.col(html), PREFETCH), told))))
    return rows.where("reason is not null").select(key, F.lit("html").alias("field"), "reason", "value")


def children(bundles: DataFrame, array: str) -> DataFrame:
    """(user_id, fields...) of one of the bundles' arrays of structs."""
    return bundles.select(F.col("profile.user_id").alias("user_id"), F.inline(array))
