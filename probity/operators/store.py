"""Keyed writes: dedupe, field-wise upserts and child replacement for the stored tables."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probity.operators.activity import keep_row, replace_children, upsert

__all__ = ["replace_children", "save_comments", "save_posts", "save_profiles", "tags", "apply_labels"]


def _filled(n: Column, o: Column) -> Column:
    """The new value unless it is null or empty."""
    return F.when(n.isNotNull() & (n.cast("string") != ""), n).otherwise(o)


def _known(n: Column, o: Column) -> Column:
    return F.coalesce(n, o)


def _count(n: Column, o: Column) -> Column:
    return F.coalesce(n, o, F.lit(0))


def _time(n: Column, o: Column) -> Column:
    return F.when(F.coalesce(n, F.lit(0)) != 0, n).otherwise(o)


POST_RULES = {"url": _filled, "date_text": _filled, "timestamp": _time, "text": _known, **dict.fromkeys(["likes", "reposts", "comments", "views"], _count), "pinned": _known, "is_comments_closed": _known, "collected_at": _time}
#: Author, reply, date, text and flags of a comment are overwritten even by null.
COMMENT_RULES = {"post_row_id": lambda n, o: F.coalesce(o, n), "timestamp": _known, "likes": _count, "collected_at": _time}


def _batch(new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows with all keys, the last one of each key."""
    for k in keys:
        new = new.where(F.col(k).isNotNull())
    return keep_row(new, keys, [order], last=True).drop(order)


def save_posts(old: DataFrame, new: DataFrame, order: str = "_seq") -> DataFrame:
    """new carries `order`, the place of a row in its batch."""
    return upsert(old, _batch(new, ["owner_id", "post_id"], order), ["owner_id", "post_id"], POST_RULES)


def save_comments(old: DataFrame, new: DataFrame, posts: DataFrame, order: str = "_seq") -> DataFrame:
    keys = ["owner_id", "post_id", "comment_id"]
    p = posts.select(F.col("owner_id").alias("_o"), F.col("post_id").alias("_p"), F.col("id").alias("_row"))
    n = _batch(new, keys, order).join(p, (F.col("owner_id") == F.col("_o")) & (F.col("post_id") == F.col("_p")), "left")
    n = n.withColumn("post_row_id", F.coalesce("_row", "post_row_id")).drop("_o", "_p", "_row")
    return upsert(old, n, keys, COMMENT_RULES)


def save_profiles(old: DataFrame, new: DataFrame, order: str = "_seq") -> DataFrame:
    """Supplied columns overwrite; the labels (is_bot, registered_at) always come from the old row."""
    return upsert(old, _batch(new, ["user_id"], order), ["user_id"], {"is_bot": lambda n, o: o, "registered_at": lambda n, o: o})


def apply_labels(profiles: DataFrame, labels: DataFrame) -> DataFrame:
    """profiles with registered_at and is_bot from labels(user_id, registered_at, is_bot) where those are known."""
    lab = labels.select(F.col("user_id").alias("_u"), F.col("registered_at").alias("_r"), F.col("is_bot").alias("_b"))
    x = profiles.join(lab, F.col("user_id") == F.col("_u"), "left")
    return x.withColumns({"registered_at": F.coalesce("_r", "registered_at"), "is_bot": F.coalesce("_b", "is_bot")}).select(*profiles.columns)


def tags(items: Column, lower: bool = True) -> Column:
    """Trimmed (and lower-cased) distinct non-empty items, sorted."""
    clean = F.transform(items, lambda x: F.lower(F.trim(x)) if lower else F.trim(x))
    return F.array_sort(F.array_distinct(F.filter(clean, lambda x: x != "")))


def posts_without_comments(posts: DataFrame, comments: DataFrame) -> DataFrame:
    return posts.where("owner_id is not null and post_id is not null").join(comments.select("owner_id", "post_id"), ["owner_id", "post_id"], "left_anti")


def authors_without_profile(comments: DataFrame, profiles: DataFrame) -> DataFrame:
    """Distinct positive author ids that no profile has."""
    return comments.where("from_id > 0").select(F.col("from_id").alias("user_id")).join(profiles.select("user_id"), "user_id", "left_anti").distinct()
