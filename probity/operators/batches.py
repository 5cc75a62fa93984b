"""Batches of posts, comments, profiles and labels into the stored tables, inside one transaction.

Rows of one key in a batch count in their order, as if they came one by one: a field takes the last value that
its rule would accept. Children of the batch's parents are replaced by those of the last row.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from probity.operators import store as S
from probity.sources import schema
from probity.sources.tables import Transaction


def ddl(name: str) -> StructType:
    return StructType.fromDDL(schema.DDL[name])


# what the child tables of a kind call their parent's row
PARENT = {"post": "post_id", "comment": "comment_id_fk", "profile": "profile_id"}


def declare(tx: Transaction) -> None:
    """All stored tables, so that one that nothing was stored in is empty, not unknown."""
    for name in schema.DDL:
        tx.declare(name, ddl(name), schema.KEYS[name] if name in ("posts", "comments", "profiles") else [PARENT[name.partition("_")[0]]])


def in_order(new: DataFrame, keys: list[str], order: str, rules: dict) -> DataFrame:
    """One row of each key: the last value of each column that its rule accepts; rows without a key go."""
    for k in keys:
        new = new.where(F.col(k).isNotNull())
    accepts = {S._filled: lambda c: c.isNotNull() & (c.cast("string") != ""), S._time: lambda c: F.coalesce(c, F.lit(0)) != 0, S._known: lambda c: c.isNotNull(), S._count: lambda c: c.isNotNull()}
    out = []
    for c in new.columns:
        if c in keys or c == order:
            continue
        ok = accepts.get(rules.get(c))
        place = F.col(order) if ok is None else F.when(ok(F.col(c)), F.col(order))
        out.append(F.max_by(F.struct(c), place)[c].alias(c))
    return new.groupBy(*keys).agg(*out)


def _attachments(rows: DataFrame, parent: str) -> DataFrame:
    none = F.lit(None).cast("string")

    def kind(name: str, items: str, linked: bool) -> Column:
        return F.transform(F.coalesce(f"attachments.{items}", F.array().cast("array<string>")), lambda x: F.struct(F.lit(name).alias("kind"), (x if linked else none).alias("href"), (none if linked else x).alias("src")))

    parts = F.concat(kind("image", "images", False), kind("video", "videos", True), kind("outlink", "outlinks", True))
    return rows.select(parent, F.inline(parts)).withColumn("extra_json", none)


def _listed(rows: DataFrame, parent: str, items: Column, name: str) -> DataFrame:
    return rows.select(parent, F.explode(F.array_distinct(F.coalesce(items, F.array().cast("array<string>")))).alias(name))


def _text_children(tx: Transaction, rows: DataFrame, prefix: str, parent: str, tags: Column) -> None:
    made = {"attachments": _attachments(rows, parent), "hashtags": _listed(rows, parent, tags, "tag"), "mentions": _listed(rows, parent, F.col("text_features.mentions"), "handle"), "urls": _listed(rows, parent, F.col("text_features.urls"), "url")}
    tx.replace(rows, parent, {f"{prefix}_{name}": (new, ddl(f"{prefix}_{name}")) for name, new in made.items()})


def put_posts(tx: Transaction, posts: DataFrame, order: str = "_seq") -> DataFrame:
    """posts with attachments, text_features and `order`; returns the stored rows."""
    keys, columns = schema.KEYS["posts"], ddl("posts").names
    flat = posts.select(*[c for c in posts.columns if c in columns and c != "id"], order)
    stored = tx.upsert("posts", in_order(flat, keys, order, S.POST_RULES), keys, ddl("posts"), S.POST_RULES)
    last = S._batch(posts.select(*keys, "attachments", "text_features", order), keys, order)
    rows = tx._kept(last.join(stored.select(*keys, F.col("id").alias("_id")), keys).drop("post_id").withColumnRenamed("_id", "post_id"))
    _text_children(tx, rows, "post", "post_id", F.transform("text_features.hashtags", F.lower))
    return stored


def put_comments(tx: Transaction, comments: DataFrame, order: str = "_seq") -> DataFrame:
    """comments with attachments, text_features and `order`: the last of a key, as the batch is deduplicated
    first. A comment is linked to its post's row where that is stored; returns the stored rows."""
    keys, columns = schema.KEYS["comments"], ddl("comments").names
    last = S._batch(comments, keys, order)
    posts = tx.find("posts", last.select("owner_id", "post_id"), ["owner_id", "post_id"], ddl("posts"))
    flat = last.select(*[c for c in last.columns if c in columns and c not in ("id", "post_row_id")])
    flat = flat.join(posts.select("owner_id", "post_id", F.col("id").alias("post_row_id")), ["owner_id", "post_id"], "left")
    stored = tx.upsert("comments", flat, keys, ddl("comments"), S.COMMENT_RULES)
    rows = last.select(*keys, "attachments", "text_features").join(stored.select(*keys, F.col("id").alias("comment_id_fk")), keys)
    _text_children(tx, tx._kept(rows), "comment", "comment_id_fk", S.tags(F.col("text_features.hashtags")))
    return stored


# children of a profile: the bundle's array, and what its fields are called in the stored table
PROFILE_CHILDREN = {
    "universities": ("profile_universities", {"id": "university_id", "faculty": "faculty_id", "chair": "chair_id"}), "schools": ("profile_schools", {"id": "school_id", "class": "clazz"}), "careers": ("profile_careers", {"city_name": "city_title", "from": "from_year", "until": "until_year"}),
    "friends_sample": ("profile_friends_sample", {"id": "friend_user_id"}), "followers_sample": ("profile_followers_sample", {"id": "follower_user_id"}), "subscriptions_sample": ("profile_subscriptions_sample", {"id": "group_id"}), "photos": ("profile_photos", {"id": "photo_id"}), "videos_sample": ("profile_videos_sample", {"id": "video_id", "player": "player_url"}),
}


def put_profiles(tx: Transaction, bundles: DataFrame, order: str = "_seq") -> DataFrame:
    """bundles (operators.pages.profile_bundles, with `order` and collected_at): profiles and their children.
    Supplied columns overwrite, labels stay; returns the stored rows."""
    fields = [c for c in bundles.schema["profile"].dataType.names if c in ddl("profiles").names]
    rest = [c for c in bundles.columns if c not in ("profile", "page_id", "_page")]
    rows = S._batch(bundles.select(*[F.col(f"profile.{c}").alias(c) for c in fields], *[F.col(c).alias(f"_b_{c}") for c in rest if c != order], order), ["user_id"], order)
    flat = rows.select(*fields, F.col("_b_collected_at").alias("collected_at"), F.col("_b_collected_at").alias("updated_at"))
    stored = tx.upsert("profiles", flat, ["user_id"], ddl("profiles"), {"is_bot": lambda n, o: o, "registered_at": lambda n, o: o})
    kids = tx._kept(rows.select("user_id", *[c for c in rows.columns if c.startswith("_b_")]).join(stored.select("user_id", F.col("id").alias("profile_id")), "user_id"))
    made = {}
    for name, column in (("profile_counters", "_b_counters"), ("profile_personal", "_b_personal")):
        one = kids.where(F.col(column).isNotNull()).select("profile_id", f"{column}.*")
        made[name] = one
    made["profile_languages"] = _listed(kids, "profile_id", F.filter("_b_languages", lambda x: x != ""), "lang")
    for array, (name, renamed) in PROFILE_CHILDREN.items():
        many = kids.select("profile_id", F.inline(f"_b_{array}"))
        named = many.select(*[F.col(f"`{c}`").alias(renamed.get(c, c)) for c in many.columns])
        if array == "photos":
            named = named.withColumn("url_base", F.col("orig_photo.url")).withColumn("sizes_json", F.coalesce("sizes", F.lit("[]")))
        if array == "videos_sample":
            named = named.withColumns({"likes": F.col("likes.count"), "reposts": F.col("reposts.count"), "image_url": F.get("image", F.lit(0))["url"]})
        if "online" in named.columns:
            named = named.withColumn("online", F.coalesce(F.col("online"), F.lit("")).isin("1", "true"))
        made[name] = named
    tx.replace(kids, "profile_id", {n: (rows.select(*[c for c in rows.columns if c in ddl(n).names]), ddl(n)) for n, rows in made.items()})
    return stored


def put_labels(tx: Transaction, labels: DataFrame, order: str = "_seq") -> DataFrame:
    """labels(user_id, registered_at, is_bot, collected_at): the known ones into the profiles that are stored;
    others are not added. Profiles that have a label keep it and aren't looked at again, but for a new date."""
    rules = {"registered_at": S._known, "is_bot": S._known}
    new = in_order(labels.select("user_id", "registered_at", "is_bot", order), ["user_id"], order, rules)
    there = tx.find("profiles", new.select("user_id"), ["user_id"], ddl("profiles")).select("user_id", F.col("is_bot").alias("_old"))
    new = new.join(there, "user_id").where("_old is null").drop("_old")
    return tx.upsert("profiles", new, ["user_id"], ddl("profiles"), rules)
